"""Joins (JOIN): lookups that resolve to exactly one row or to none, bands, as-of, merges and matching."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.plans.catalog import query, table

from .fuzzy import near_texts
from .ordering import ranked, stored


@query("join01_inner", "SELECT l_orderkey, l_linenumber, o_orderstatus FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE o_orderpriority = '1-URGENT'")
def join01(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").filter("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderstatus")
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber").join(o, "l_orderkey")


@query("join02_left", "SELECT o_orderkey, count(l_orderkey) AS n_lines FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey AND l_returnflag = 'R' GROUP BY o_orderkey")
def join02(spark: SparkSession, sf: str) -> DataFrame:
    """The child side is counted before the join: what is shuffled is one row a key and task."""
    lines = table(spark, sf, "lineitem").filter("l_returnflag = 'R'").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n_lines"))
    return table(spark, sf, "orders").select("o_orderkey").join(lines, "o_orderkey", "left").fillna(0, ["n_lines"])


@query("join03_children_list", "SELECT o_orderkey, string_agg(l_linenumber || ':' || l_returnflag, ',' ORDER BY l_linenumber, l_returnflag, l_partkey) AS lines FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey")
def join03(spark: SparkSession, sf: str) -> DataFrame:
    """Children of a parent as an ordered list; an order's lines are few by the data model."""
    rows = F.sort_array(F.collect_list(F.struct("l_linenumber", "l_returnflag", "l_partkey")))
    lists = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.array_join(F.transform(rows, lambda r: F.concat_ws(":", r["l_linenumber"].cast("string"), r["l_returnflag"])), ",").alias("lines"))
    return table(spark, sf, "orders").select("o_orderkey").join(lists, "o_orderkey", "left")


@query("join04_semi", "SELECT o_orderkey FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 45)")
def join04(spark: SparkSession, sf: str) -> DataFrame:
    big = table(spark, sf, "lineitem").filter("l_quantity > 45").select(F.col("l_orderkey").alias("o_orderkey"))
    return table(spark, sf, "orders").select("o_orderkey").join(big, "o_orderkey", "left_semi")


@query("join05_anti", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')")
def join05(spark: SparkSession, sf: str) -> DataFrame:
    done = table(spark, sf, "orders").filter("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf, "customer").select("c_custkey").join(done, "c_custkey", "left_anti")


@query("join06_mark", "SELECT doc_id, (EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND l.toxic = 1) OR n_chars < 100) AS flagged FROM documents d")
def join06(spark: SparkSession, sf: str) -> DataFrame:
    marks = table(spark, sf, "labels").filter("toxic = 1").select("doc_id", F.lit(True).alias("mark")).distinct()
    d = table(spark, sf, "documents").select("doc_id", "n_chars").join(marks, "doc_id", "left")
    return d.select("doc_id", (F.col("mark").isNotNull() | (F.col("n_chars") < 100)).alias("flagged"))


@query("join07_computed_key", "SELECT e.event_id, c.c_custkey FROM events e JOIN customer c ON CAST(e.user_id AS VARCHAR) = CAST(c.c_custkey AS VARCHAR)")
def join07(spark: SparkSession, sf: str) -> DataFrame:
    e, c = table(spark, sf, "events"), table(spark, sf, "customer")
    return e.select("event_id", F.col("user_id").cast("string").alias("k")).join(c.select("c_custkey", F.col("c_custkey").cast("string").alias("k")), "k").select("event_id", "c_custkey")


def resolved(targets: DataFrame, candidates: DataFrame, keys: list[str], value: str) -> DataFrame:
    """targets with `n_candidates`, `resolved` (the only candidate, else null) and `state`."""
    held = candidates.groupBy(*keys).agg(F.count_distinct(value).alias("n_candidates"), F.min(value).alias("one"))
    out = targets.join(held, keys, "left").withColumn("n_candidates", F.coalesce("n_candidates", F.lit(0).cast("long")))
    return out.withColumn("resolved", F.when(F.col("n_candidates") == 1, F.col("one"))).withColumn("state", F.when(F.col("n_candidates") == 0, "missing").when(F.col("n_candidates") == 1, "exact").otherwise("conflict")).drop("one")


@query("join08_composite_exactly_one", "WITH c AS (SELECT p_brand, p_size, count(DISTINCT p_partkey) AS n, min(p_partkey) AS one FROM part WHERE p_type = 'SMALL' GROUP BY ALL) SELECT p.p_partkey, coalesce(n, 0) AS n_candidates, CASE WHEN n = 1 THEN one END AS resolved, CASE WHEN n IS NULL THEN 'missing' WHEN n = 1 THEN 'exact' ELSE 'conflict' END AS state FROM part p LEFT JOIN c ON c.p_brand = p.p_brand AND c.p_size = p.p_size")
def join08(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part")
    small = p.filter("p_type = 'SMALL'").select("p_brand", "p_size", F.col("p_partkey").alias("candidate"))
    return resolved(p.select("p_partkey", "p_brand", "p_size"), small, ["p_brand", "p_size"], "candidate").select("p_partkey", "n_candidates", "resolved", "state")


@query("join09_fallback_lookup", "WITH a AS (SELECT n_name AS nm, min(n_nationkey) AS k FROM nation GROUP BY 1 HAVING count(*) = 1), b AS (SELECT s_nationkey AS nk, min(s_suppkey) AS k FROM supplier GROUP BY 1 HAVING count(*) = 1) SELECT s_suppkey, coalesce(b.k, a.k, -1) AS hit FROM supplier s LEFT JOIN b ON b.nk = s.s_nationkey LEFT JOIN nation n ON n.n_nationkey = s.s_nationkey LEFT JOIN a ON a.nm = n.n_name")
def join09(spark: SparkSession, sf: str) -> DataFrame:
    """A name resolves in its own scope if one row has it there, else in the wider scope, else not at all."""
    s, n = table(spark, sf, "supplier"), table(spark, sf, "nation")
    only = lambda df, key, value: df.groupBy(key).agg(F.count("*").alias("n"), F.min(value).alias("k")).filter("n = 1")
    own = only(s, "s_nationkey", "s_suppkey").select("s_nationkey", F.col("k").alias("own"))
    wide = only(n, "n_name", "n_nationkey").join(n, "n_name").select(F.col("n_nationkey").alias("s_nationkey"), F.col("k").cast("long").alias("wide"))
    return s.join(own, "s_nationkey", "left").join(wide, "s_nationkey", "left").select("s_suppkey", F.coalesce("own", "wide", F.lit(-1).cast("long")).alias("hit"))


@query("join10_validity_interval", "WITH v AS (SELECT user_id, min(ts) AS lo, max(ts) AS hi FROM events WHERE event_type = 'signup' GROUP BY 1) SELECT e.event_id FROM events e JOIN v ON v.user_id = e.user_id AND coalesce(lo, TIMESTAMP '1900-01-01') <= e.ts AND e.ts <= coalesce(hi, TIMESTAMP '9999-01-01') WHERE e.event_type = 'click'")
def join10(spark: SparkSession, sf: str) -> DataFrame:
    """Rows within their key's validity interval; the equality keeps it a hash or sort-merge join."""
    e = table(spark, sf, "events")
    v = e.filter("event_type = 'signup'").groupBy("user_id").agg(F.min("ts").alias("lo"), F.max("ts").alias("hi"))
    low, high = F.coalesce("lo", F.lit("1900-01-01").cast("timestamp_ntz")), F.coalesce("hi", F.lit("9999-01-01").cast("timestamp_ntz"))
    return e.filter("event_type = 'click'").join(v, "user_id").filter((low <= F.col("ts")) & (F.col("ts") <= high)).select("event_id")


def overlapping(df: DataFrame, key: str, start: str, end: str, ident: str) -> DataFrame:
    """Rows whose closed interval begins before an earlier interval of the key has ended: sort and running maximum."""
    before = Window.partitionBy(key).orderBy(start, ident).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("overlaps", F.coalesce(F.col(start) <= F.max(end).over(before), F.lit(False)))


@query("join11_overlap", "WITH i AS (SELECT event_id, user_id, ts AS s, ts + INTERVAL 2 HOUR AS e FROM events WHERE event_type = 'view') SELECT event_id, coalesce(s <= max(e) OVER (PARTITION BY user_id ORDER BY s, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS overlaps FROM i")
def join11(spark: SparkSession, sf: str) -> DataFrame:
    i = table(spark, sf, "events").filter("event_type = 'view'").select("event_id", "user_id", F.col("ts").alias("s"), F.expr("ts + INTERVAL 2 HOURS").alias("e"))
    return overlapping(i, "user_id", "s", "e", "event_id").select("event_id", "overlaps")


def band_join(left: DataFrame, right: DataFrame, keys: list[str], at: str, other: str, seconds: int) -> DataFrame:
    """Pairs with equal keys and |left.at - right.other| <= seconds, joined on time buckets of that width."""
    second = lambda c: F.unix_timestamp(F.col(c).cast("timestamp"))
    b = F.floor(second(at) / seconds)
    near = left.withColumn("bucket", F.explode(F.array(b - 1, b, b + 1)))
    return near.join(right.withColumn("bucket", F.floor(second(other) / seconds)), [*keys, "bucket"]).filter(F.abs(F.expr(f"timestampdiff(MICROSECOND, {at}, {other})")) <= seconds * 1_000_000).drop("bucket")


@query("join12_band", "SELECT a.event_id AS id_a, b.event_id AS id_b FROM events a JOIN events b ON a.user_id = b.user_id AND b.ts BETWEEN a.ts - INTERVAL 6 HOUR AND a.ts + INTERVAL 6 HOUR WHERE a.event_type = 'error' AND b.event_type = 'purchase'")
def join12(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    a = e.filter("event_type = 'error'").select("user_id", F.col("event_id").alias("id_a"), F.col("ts").alias("ta"))
    b = e.filter("event_type = 'purchase'").select("user_id", F.col("event_id").alias("id_b"), F.col("ts").alias("tb"))
    return band_join(a, b, ["user_id"], "ta", "tb", 6 * 3600).select("id_a", "id_b")


@query("join13_point_in_time", "WITH g AS (SELECT user_id, ts AS lo, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS hi, event_id AS gen FROM events WHERE event_type = 'signup') SELECT e.event_id, g.gen FROM events e JOIN g ON g.user_id = e.user_id AND e.ts >= g.lo AND (g.hi IS NULL OR e.ts < g.hi) WHERE e.event_type = 'error'")
def join13(spark: SparkSession, sf: str) -> DataFrame:
    """The generation valid at each record: union and last value, one sort instead of a range join."""
    e = table(spark, sf, "events")
    marks = e.filter("event_type in ('signup', 'error')").withColumn("gen", F.when(F.col("event_type") == "signup", F.col("event_id")))
    order = Window.partitionBy("user_id").orderBy("ts", F.col("gen").isNull(), "event_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return marks.withColumn("g", F.last("gen", ignorenulls=True).over(order)).filter("event_type = 'error' and g is not null").select("event_id", F.col("g").alias("gen"))


@query("join14_as_of", "WITH p AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'purchase') SELECT p.event_id, v.value AS last_value FROM p ASOF LEFT JOIN (SELECT user_id, ts, any_value(value) AS value FROM events WHERE event_type = 'view' GROUP BY user_id, ts) v ON v.user_id = p.user_id AND v.ts <= p.ts")
def join14(spark: SparkSession, sf: str) -> DataFrame:
    """The latest view at or before each purchase."""
    e = table(spark, sf, "events").filter("event_type in ('view', 'purchase')")
    order = Window.partitionBy("user_id").orderBy("ts", F.col("event_type") == "purchase", "event_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = F.last(F.when(F.col("event_type") == "view", F.col("value")), ignorenulls=True).over(order)
    return e.withColumn("last_value", seen).filter("event_type = 'purchase'").select("event_id", "last_value")


#: Surfaces that one pass over the texts matches; a larger term base takes several passes.
SURFACES = 200_000


def occurrences(texts: DataFrame, surfaces: DataFrame, most: int = SURFACES) -> DataFrame:
    """texts (id, text) with `spans`: longest surfaces first, overlapping ones skipped, by start.

    surfaces: one column of strings, compared in lower case. They go to the tasks in blocks of at most `most`, one pass
    over the texts a block, each as an automaton that finds all its surfaces in one run over a text. Passes send on the
    spans they find, and the choice among overlapping spans is made on those of all blocks. Ids are unique.
    """
    names = surfaces.toDF("s").filter("s <> ''").select(F.lower("s").alias("s")).distinct()
    blocks = -(-names.count() // most) or 1
    field = "array<struct<start:int,stop:int,surface:string>>"
    passes = []
    for block in range(blocks):
        own = [r[0] for r in names.filter(F.pmod(F.xxhash64("s"), F.lit(blocks)) == block).toLocalIterator()]  # about `most` strings
        sent = texts.sparkSession.sparkContext.broadcast(own)

        def find(frames: Iterator[pd.DataFrame], sent=sent) -> Iterator[pd.DataFrame]:
            import ahocorasick

            automaton = ahocorasick.Automaton()
            for s in sent.value:
                automaton.add_word(s, s)
            if len(automaton):
                automaton.make_automaton()
            for frame in frames:
                out = [[{"start": end + 1 - len(s), "stop": end + 1, "surface": s} for end, s in automaton.iter(text)] if len(automaton) else [] for text in frame["text"].fillna("").str.lower()]
                yield pd.DataFrame({"id": frame["id"], "found": out})

        passes.append(texts.select("id", "text").mapInPandas(find, f"id long, found {field}"))
    found = passes[0]
    for more in passes[1:]:
        found = found.unionByName(more)
    if blocks > 1:
        found = found.groupBy("id").agg(F.flatten(F.collect_list("found")).alias("found"))  # one row a block
    return found.mapInPandas(_chosen, f"id long, spans {field}")


def _chosen(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of all spans the longest first, those that overlap none taken before."""
    for frame in frames:
        out = []
        for found in frame["found"]:
            spans = sorted(((x["stop"] - x["start"], x["surface"], x["start"]) for x in found), key=lambda x: (-x[0], x[1], x[2]))
            covered, taken = bytearray(max((x["stop"] for x in found), default=0)), []
            for size, s, at in spans:
                if covered.find(1, at, at + size) < 0:
                    covered[at : at + size] = b"\1" * size
                    taken.append({"start": at, "stop": at + size, "surface": s})
            out.append(sorted(taken, key=lambda x: x["start"]))
        yield pd.DataFrame({"id": frame["id"], "spans": out})


#: Phrases that one pass over the texts looks for; they are longer than surfaces.
PHRASES = 50_000


def containing(texts: DataFrame, key: str, phrases: DataFrame, most: int = PHRASES) -> DataFrame:
    """(key, phrase): each of the phrases (one column of strings) that a text (key, text) contains, anywhere, as written.

    As with occurrences(), blocks of at most about `most` phrases go to the tasks, one pass over the texts a block. Texts stay
    where they are read: only keys and phrases are handed on, once a text.
    """
    names = stored(phrases.toDF("s").filter("s <> ''").distinct())
    blocks = -(-names.count() // most) or 1
    kind = texts.schema[key].dataType.simpleString()
    found = None
    for block in range(blocks):
        own = [r[0] for r in names.filter(F.pmod(F.xxhash64("s"), F.lit(blocks)) == block).toLocalIterator()]  # about `most` strings
        sent = texts.sparkSession.sparkContext.broadcast(own)

        def find(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            import ahocorasick

            automaton = ahocorasick.Automaton()
            for s in sent.value:
                automaton.add_word(s, s)
            if not len(automaton):
                return
            automaton.make_automaton()
            for batch in batches:
                at, held = [], []
                for i, text in enumerate(batch.column(1)):
                    mine = {s for _, s in automaton.iter(text.as_py() or "")}
                    at += [i] * len(mine)
                    held += mine
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(held, pa.string())], [key, "phrase"])

        own_rows = texts.select(key, "text").mapInArrow(find, f"`{key}` {kind}, phrase string")
        found = own_rows if found is None else found.unionByName(own_rows)
    return found


@query("join15_term_occurrences")
def join15(spark: SparkSession, sf: str) -> DataFrame:
    names = table(spark, sf, "part").select(F.col("p_name").alias("s")).distinct()
    surfaces = names.unionByName(names.select(F.explode(F.split("s", " ")).alias("s")))
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text")
    return occurrences(docs, surfaces).select(F.col("id").alias("doc_id"), F.size("spans").cast("long").alias("n_spans"), F.transform("spans", lambda s: s["surface"]).alias("surfaces"))


def term_states(texts: DataFrame, terms: DataFrame, evidence: DataFrame, common: list[str]) -> DataFrame:
    """(id, start, stop, surface, term_id, state) of every surface found in the texts, once all evidence is weighed.

    texts: id, text. terms: surface, term_id, registry (a formal entry; else an alias), reviewed. evidence: id, term_id of terms
    that the text is known to be about. A surface that registry entries have is read as one of those, aliases of the same surface aside.
    What is left decides, in this order: several terms conflict, unless evidence names exactly one of them; a term with evidence
    is confirmed; a common word without evidence and an alias that nobody reviewed are uncertain; anything else is confirmed.
    A conflict has no term_id. Surfaces are compared in lower case; null and empty ones are found nowhere.
    """
    own = terms.filter("surface <> '' and term_id is not null").select(F.lower("surface").alias("surface"), "term_id", F.coalesce("registry", F.lit(False)).alias("registry"), F.coalesce("reviewed", F.lit(False)).alias("reviewed"))
    own = own.groupBy("surface", "term_id").agg(F.bool_or("registry").alias("registry"), F.bool_or("reviewed").alias("reviewed"))
    # one row a surface holds what its terms say without evidence; its terms themselves are only looked up by the evidence of a text
    formal, registered = F.bool_or("registry"), F.col("registry")
    known = own.groupBy("surface").agg(
        formal.alias("registry"),
        F.when(formal, F.count_if(registered)).otherwise(F.count("*")).alias("n"),
        F.when(formal, F.min(F.when(registered, F.col("term_id")))).otherwise(F.min("term_id")).alias("only"),
        F.bool_and("reviewed").alias("reviewed"),
    )
    known = stored(known)
    found = stored(occurrences(texts, known.select("surface")).select("id", F.explode("spans").alias("s")).select("id", "s.start", "s.stop", "s.surface"))
    pairs = found.select("id", "surface").distinct().join(known, "surface")
    about = pairs.select("id", "surface", F.col("registry").alias("formal")).join(evidence.select("id", "term_id").distinct(), "id").join(own.drop("reviewed"), ["surface", "term_id"])
    about = about.filter(F.col("registry") | ~F.col("formal")).groupBy("id", "surface").agg(F.count("*").alias("n_backed"), F.min("term_id").alias("named"))
    one = pairs.join(about, ["id", "surface"], "left").withColumn("n_backed", F.coalesce("n_backed", F.lit(0)))
    state = (
        F.when((F.col("n") > 1) & (F.col("n_backed") != 1), "conflict")
        .when(F.col("n_backed") == 1, "confirmed")
        .when(F.col("surface").isin([c.lower() for c in common]), "uncertain")
        .when(~F.col("registry") & ~F.col("reviewed"), "uncertain")
        .otherwise("confirmed")
    )
    judged = one.select("id", "surface", F.when(state != "conflict", F.coalesce("named", "only")).alias("term_id"), state.alias("state"))
    return found.join(judged, ["id", "surface"]).select("id", "start", "stop", "surface", "term_id", "state")


@query("join15_term_states")
def join15_states(spark: SparkSession, sf: str) -> DataFrame:
    """Part names as registry entries, their words as aliases (reviewed from size 25 on), the part of a text's number as its evidence."""
    part = table(spark, sf, "part")
    entries = part.select(F.col("p_name").alias("surface"), F.col("p_partkey").alias("term_id"), F.lit(True).alias("registry"), F.lit(True).alias("reviewed"))
    aliases = part.select(F.explode(F.split("p_name", " ")).alias("surface"), F.col("p_partkey").alias("term_id"), F.lit(False).alias("registry"), (F.col("p_size") >= 25).alias("reviewed"))
    texts = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text")
    evidence = part.select(F.col("p_partkey").alias("id"), F.col("p_partkey").alias("term_id"))
    found = term_states(texts, entries.unionByName(aliases), evidence, ["small", "large", "the", "with"])
    return found.groupBy(F.col("id").alias("doc_id"), "surface", "term_id", "state").agg(F.count("*").alias("n"))


@query("join16_fuzzy_best", "WITH c AS (SELECT a.s_suppkey AS id_a, b.s_suppkey AS id_b, 1 - levenshtein(a.s_name, b.s_name)::DOUBLE / greatest(length(a.s_name), length(b.s_name)) AS sim FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey <> b.s_suppkey) SELECT id_a, id_b, round(sim, 6) AS sim FROM (SELECT *, row_number() OVER (PARTITION BY id_a ORDER BY sim DESC, id_b) AS k FROM c WHERE sim >= 0.88) WHERE k = 1")
def join16(spark: SparkSession, sf: str) -> DataFrame:
    """Best match by similarity within a block key: equal names first, then names that an index of what is left of them brings together.

    A similarity of t leaves t of the longer name in common, so that the sequence ratio reaches t, too. What reaches the upper level
    is found in whole there, so a name with a match at that level is done; only the others are looked for at the lower one.
    """
    rows = table(spark, sf, "supplier").select(F.col("s_nationkey").alias("region"), F.col("s_suppkey").alias("id_a"), F.col("s_name").alias("text"))
    rows = stored(rows.filter("region is not null and id_a is not null and text <> ''"))
    first = rows.groupBy("region", "text").agg(F.min("id_a").alias("first"))
    names = stored(rows.join(first, ["region", "text"]).groupBy("region", "text", "first").agg(F.min(F.when(F.col("id_a") > F.col("first"), F.col("id_a"))).alias("second")))
    other = F.when(F.col("first") != F.col("id_a"), F.col("first")).otherwise(F.col("second")).alias("id_b")
    found = rows.join(names.filter("second is not null"), ["region", "text"]).select("id_a", other, F.lit(1.0).alias("sim"))
    # names of one supplier, which have no equal
    left = names.filter("second is null").select("region", "text", F.col("first").alias("id_a"))
    for level in (0.94, 0.88):
        near = near_texts(left, names, level).withColumn("sim", 1 - F.levenshtein("text", "other").cast("double") / F.greatest(F.length("text"), F.length("other"))).filter(F.col("sim") >= level).distinct()
        near = near.join(left, ["region", "text"]).join(names.withColumnRenamed("text", "other"), ["region", "other"]).select("region", "text", "id_a", other, "sim").filter("id_b is not null")
        best = stored(near.groupBy("region", "text", "id_a").agg(F.max(F.struct("sim", -F.col("id_b"))).alias("m")))
        found = found.unionByName(best.select("id_a", (-F.col("m.col2")).alias("id_b"), "m.sim"))
        left = left.join(best, ["region", "text"], "left_anti")
    best = found.groupBy("id_a").agg(F.max(F.struct("sim", -F.col("id_b"))).alias("m"))
    return best.select("id_a", (-F.col("m.col2")).alias("id_b"), F.round("m.sim", 6).alias("sim"))


def token_set(text: Column) -> Column:
    return F.array_distinct(F.filter(F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0)), lambda w: F.length(w) > 1))


TOKENS = r"list_distinct(list_filter(regexp_extract_all(lower(substr(text, 1, 1200)), '[\p{L}\p{N}_]+'), lambda w: length(w) > 1))"


@query(
    "join17_jaccard_probe",
    f"""
WITH d AS (SELECT doc_id, ts, {TOKENS} AS t FROM documents JOIN events ON event_id = doc_id),
c AS (SELECT * FROM d ORDER BY ts DESC, doc_id DESC LIMIT 81),
p AS (SELECT d.doc_id, d.t, c.doc_id AS other, c.t AS u, row_number() OVER (PARTITION BY d.doc_id ORDER BY c.ts DESC, c.doc_id DESC) AS k
      FROM d JOIN c ON c.doc_id <> d.doc_id AND c.ts >= d.ts - INTERVAL 7 DAY),
s AS (SELECT doc_id, other, k, len(list_intersect(t, u))::DOUBLE / (len(t) + len(u) - len(list_intersect(t, u))) AS score FROM p WHERE k <= 80 AND len(list_intersect(t, u)) > 0)
SELECT doc_id, other AS best, round(score, 6) AS score, CASE WHEN score >= 0.86 THEN 'duplicate' WHEN score >= 0.72 THEN 'manual' ELSE 'new' END AS verdict
FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, k) AS r FROM s) WHERE r = 1
""",
)
def join17(spark: SparkSession, sf: str) -> DataFrame:
    """The best of each text's candidates by token Jaccard; candidates are the newest 80 others of the last 7 days.

    The newest 80 from any day on are a prefix of the newest of all, so 81 rows can be candidates. Those go to all
    tasks as an inverted index of tokens, and each text meets only candidates that share a token with it.
    """
    when = table(spark, sf, "events").select(F.col("event_id").alias("doc_id"), "ts")
    d = table(spark, sf, "documents").select("doc_id", token_set(F.substring("text", 1, 1200)).alias("t")).join(when, "doc_id")
    newest = d.orderBy(F.desc("ts"), F.desc("doc_id")).limit(81)
    newest = newest.withColumn("place", F.row_number().over(Window.orderBy(F.desc("ts"), F.desc("doc_id"))))  # 81 rows
    index = newest.select(F.col("doc_id").alias("other"), F.col("ts").alias("at"), F.size("t").alias("m"), "place", F.explode("t").alias("w"))
    own = d.select("doc_id", "ts", F.size("t").alias("n"), F.explode("t").alias("w"))
    both = own.join(F.broadcast(index), "w").filter((F.col("other") != F.col("doc_id")) & (F.col("at") >= F.col("ts") - F.expr("INTERVAL 7 DAY")))
    both = both.groupBy("doc_id", "n", "other", "m", "place").agg(F.count("*").alias("both"))
    # one of the 81 has the 80 others as candidates, the rest the first 80 of the 81
    inside = newest.select(F.col("doc_id"), F.lit(True).alias("inside"))
    both = both.join(F.broadcast(inside), "doc_id", "left").filter((F.col("place") <= 80) | F.col("inside"))
    scored = both.withColumn("score", F.col("both") / (F.col("n") + F.col("m") - F.col("both")))
    best = scored.groupBy("doc_id").agg(F.max(F.struct("score", (-F.col("place")).alias("near"), "other")).alias("b"))
    verdict = F.when(F.col("b.score") >= 0.86, "duplicate").when(F.col("b.score") >= 0.72, "manual").otherwise("new")
    return best.select("doc_id", F.col("b.other").alias("best"), F.round("b.score", 6).alias("score"), verdict.alias("verdict"))


@query("join18_multi_key_identity", "WITH k1 AS (SELECT c_nationkey, c_mktsegment, min(c_custkey) AS a FROM customer GROUP BY ALL), k2 AS (SELECT cast(floor(c_acctbal / 100) AS BIGINT) AS b, min(c_custkey) AS c FROM customer GROUP BY 1) SELECT c_custkey, len(list_distinct([a, c])) AS n_ids, CASE WHEN len(list_distinct([a, c])) = 1 THEN 'exact' ELSE 'conflict' END AS state FROM customer u JOIN k1 ON k1.c_nationkey = u.c_nationkey AND k1.c_mktsegment = u.c_mktsegment JOIN k2 ON k2.b = cast(floor(u.c_acctbal / 100) AS BIGINT)")
def join18(spark: SparkSession, sf: str) -> DataFrame:
    """One owner under every candidate key, or a conflict."""
    c = table(spark, sf, "customer").withColumn("b", F.floor(F.col("c_acctbal") / 100))
    one = c.groupBy("c_nationkey", "c_mktsegment").agg(F.min("c_custkey").alias("k1"))
    two = c.groupBy("b").agg(F.min("c_custkey").alias("k2"))
    ids = F.array_distinct(F.array_compact(F.array("k1", "k2")))
    return c.join(one, ["c_nationkey", "c_mktsegment"], "left").join(two, "b", "left").select("c_custkey", F.size(ids).cast("long").alias("n_ids"), F.when(F.size(ids) == 1, "exact").otherwise("conflict").alias("state"))


def resolved_by_keys(incoming: DataFrame, records: DataFrame, row: str, record: str, keys: list[str]) -> DataFrame:
    """Each incoming row's record under several candidate keys (columns of both sides; a null key finds nothing).

    (row, record, n_ids, state): exact where all keys that find a record find the same one, none where no key does,
    ambiguous where one key alone finds several records, conflict where keys disagree. One aggregation and join a key.
    """
    out = incoming.select(row, *keys)
    for k in keys:
        found = records.filter(F.col(k).isNotNull()).groupBy(k).agg(F.min(record).alias(f"{k}_id"), (F.min(record) != F.max(record)).alias(f"{k}_many"))
        out = out.join(found, k, "left")
    ids = F.array_distinct(F.array_compact(F.array(*[f"{k}_id" for k in keys])))
    many = F.coalesce(F.greatest(*[F.coalesce(f"{k}_many", F.lit(False)) for k in keys]), F.lit(False))
    out = out.select(row, ids.alias("ids"), many.alias("many"))
    state = F.when(F.col("many"), "ambiguous").when(F.size("ids") > 1, "conflict").when(F.size("ids") == 1, "exact").otherwise("none")
    return out.select(row, F.when(state == "exact", F.element_at("ids", 1)).alias(record), F.size("ids").cast("long").alias("n_ids"), state.alias("state"))


FOUR_KEYS = ["idempotent", "evidence", "canonical", "equivalent"]
RESOLVED = "WITH {keys} SELECT s.s_suppkey, CASE WHEN NOT many AND len(ids) = 1 THEN ids[1] END AS c_custkey, CAST(len(ids) AS BIGINT) AS n_ids, CASE WHEN many THEN 'ambiguous' WHEN len(ids) > 1 THEN 'conflict' WHEN len(ids) = 1 THEN 'exact' ELSE 'none' END AS state FROM (SELECT s_suppkey, list_distinct([x1.id, x2.id, x3.id, x4.id]) AS ids, coalesce(x1.many, false) OR coalesce(x2.many, false) OR coalesce(x3.many, false) OR coalesce(x4.many, false) AS many FROM supplier s {joins}) s"
_SQL_KEYS = ["CASE WHEN {a} > 0 THEN {k} END", "{n} * 1000000 + CAST(floor({a} / 50) AS BIGINT)", "CAST(floor({a} / 5) AS BIGINT)", "{n} * 1000000 + CAST(floor({a} / 20) AS BIGINT)"]
RESOLVED = RESOLVED.format(keys=", ".join(f"k{i} AS (SELECT {e.format(k='c_custkey', n='c_nationkey', a='c_acctbal')} AS k, min(c_custkey) AS id, min(c_custkey) <> max(c_custkey) AS many FROM customer GROUP BY 1)" for i, e in enumerate(_SQL_KEYS, 1)), joins=" ".join(f"LEFT JOIN k{i} x{i} ON x{i}.k = {e.format(k='s_suppkey', n='s_nationkey', a='s_acctbal')}" for i, e in enumerate(_SQL_KEYS, 1)))


@query("join18_four_keys", RESOLVED)
def join18_four_keys(spark: SparkSession, sf: str) -> DataFrame:
    """Suppliers resolved to customers under four keys: number, nation with coarse balance, balance, nation with fine balance."""

    def keyed(df: DataFrame, number: str, nation: str, balance: str) -> DataFrame:
        part = lambda width: F.floor(F.col(balance) / width)
        keys = [F.when(F.col(balance) > 0, F.col(number)), F.col(nation) * 1_000_000 + part(50), part(5), F.col(nation) * 1_000_000 + part(20)]
        return df.select(number, *[c.cast("long").alias(k) for k, c in zip(FOUR_KEYS, keys, strict=True)])

    suppliers = keyed(table(spark, sf, "supplier"), "s_suppkey", "s_nationkey", "s_acctbal")
    customers = keyed(table(spark, sf, "customer"), "c_custkey", "c_nationkey", "c_acctbal")
    return resolved_by_keys(suppliers, customers, "s_suppkey", "c_custkey", FOUR_KEYS)


@query("join19_cross_source", "SELECT a.l_orderkey AS k, a.l_linenumber AS line_a, b.l_linenumber AS line_b FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_shipdate::DATE = b.l_shipdate::DATE AND a.l_suppkey <> b.l_suppkey AND a.l_linenumber < b.l_linenumber AND (a.l_tax = b.l_tax OR a.l_tax = 0 OR b.l_tax = 0)")
def join19(spark: SparkSession, sf: str) -> DataFrame:
    """The same fact under two sources; an unknown value (tax 0 here) agrees with any."""
    i = table(spark, sf, "lineitem").select("l_orderkey", F.col("l_shipdate").cast("date").alias("day"), "l_suppkey", "l_linenumber", "l_tax")
    met = i.alias("a").join(i.alias("b"), ["l_orderkey", "day"]).filter("a.l_suppkey <> b.l_suppkey and a.l_linenumber < b.l_linenumber and (a.l_tax = b.l_tax or a.l_tax = 0 or b.l_tax = 0)")
    return met.select(F.col("l_orderkey").alias("k"), F.col("a.l_linenumber").alias("line_a"), F.col("b.l_linenumber").alias("line_b"))


DIFF_SQL = """WITH i AS (SELECT o_orderkey AS k, o_orderstatus AS s, year(o_orderdate) AS y FROM orders WHERE o_orderkey % 7 <> 0), x AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 5 = 0 THEN 'X' ELSE o_orderstatus END AS s, year(o_orderdate) AS y FROM orders WHERE o_orderkey % 11 <> 0)
SELECT bucket, count(*) AS n FROM (SELECT CASE WHEN x.k IS NULL THEN 'new' WHEN i.k IS NOT NULL AND i.s = x.s THEN 'unchanged' WHEN i.k IS NOT NULL THEN 'changed' WHEN x.y <= 1998 THEN 'cancelled' ELSE 'uncovered' END AS bucket FROM i FULL JOIN x ON i.k = x.k) GROUP BY bucket"""


def calendar_diff(incoming: DataFrame, existing: DataFrame, covered: Column) -> DataFrame:
    """Both sides' rows (k, s, y) with their bucket: new, changed, unchanged, cancelled (covered scope) or uncovered."""
    i, x = incoming.select("k", F.col("s").alias("si"), F.lit(True).alias("in_i")), existing.select("k", F.col("s").alias("sx"), "y", F.lit(True).alias("in_x"))
    j = i.join(x, "k", "full_outer")
    return j.withColumn("bucket", F.when(F.col("in_x").isNull(), "new").when(F.col("in_i") & F.col("si").eqNullSafe(F.col("sx")), "unchanged").when(F.col("in_i"), "changed").when(covered, "cancelled").otherwise("uncovered"))


@query("join20_calendar_diff", DIFF_SQL)
def join20(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("s"), F.year("o_orderdate").alias("y"))
    old = o.filter("k % 11 <> 0").withColumn("s", F.when(F.col("k") % 5 == 0, "X").otherwise(F.col("s")))
    return calendar_diff(o.filter("k % 7 <> 0"), old, F.col("y") <= 1998).groupBy("bucket").agg(F.count("*").alias("n"))


@query("join21_ledger_merge", "WITH u AS (SELECT user_id, ts::DATE AS day, event_type FROM events WHERE event_id % 2 = 0 UNION ALL SELECT user_id, ts::DATE, event_type FROM events WHERE event_id % 3 = 0) SELECT user_id, day, count(DISTINCT event_type) AS n_states, count(*) AS n_rows, count(DISTINCT event_type) > 1 AS conflict FROM u GROUP BY user_id, day")
def join21(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").select("event_id", "user_id", F.col("ts").cast("date").alias("day"), "event_type")
    both = e.filter("event_id % 2 = 0").unionByName(e.filter("event_id % 3 = 0"))
    return both.groupBy("user_id", "day").agg(F.count_distinct("event_type").alias("n_states"), F.count("*").alias("n_rows")).withColumn("conflict", F.col("n_states") > 1)


@query("join22_census", "SELECT CASE WHEN a.k IS NULL THEN 'unseeded' WHEN b.k IS NULL THEN 'unstable' ELSE 'matched' END AS class, count(*) AS n FROM customer c LEFT JOIN (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderstatus = 'F') a ON a.k = c.c_custkey LEFT JOIN (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderpriority = '1-URGENT') b ON b.k = c.c_custkey GROUP BY 1")
def join22(spark: SparkSession, sf: str) -> DataFrame:
    """Census against seeds and stable ids: every row in one residual class, with one pass over the facts."""
    o = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max(F.col("o_orderstatus") == "F").alias("seed"), F.max(F.col("o_orderpriority") == "1-URGENT").alias("stable"))
    c = table(spark, sf, "customer").select("c_custkey").join(o, "c_custkey", "left")
    return c.groupBy(F.when(~F.coalesce("seed", F.lit(False)), "unseeded").when(~F.coalesce("stable", F.lit(False)), "unstable").otherwise("matched").alias("class")).agg(F.count("*").alias("n"))


@query("join23_roster_merge", "WITH p AS (SELECT user_id, min(event_id) AS pos, min(value) AS v FROM events WHERE event_type = 'signup' GROUP BY 1), i AS (SELECT user_id, min(event_id) AS pos, min(value) AS v FROM events WHERE event_type = 'error' AND user_id % 3 > 0 GROUP BY 1) SELECT coalesce(p.user_id, i.user_id) AS user_id, coalesce(i.v, p.v) AS v, i.user_id IS NULL AS gap, row_number() OVER (ORDER BY p.pos NULLS LAST, i.pos) AS place FROM p FULL JOIN i ON p.user_id = i.user_id")
def join23(spark: SparkSession, sf: str) -> DataFrame:
    """A roster keeps its order, takes new values, keeps omitted rows as gaps and appends new rows."""
    e = table(spark, sf, "events")
    side = lambda df, n: df.groupBy("user_id").agg(F.min("event_id").alias(f"pos_{n}"), F.min("value").alias(f"v_{n}"))
    j = side(e.filter("event_type = 'signup'"), "p").join(side(e.filter("event_type = 'error' and user_id % 3 > 0"), "i"), "user_id", "full_outer")
    j = ranked(j, [], [F.col("pos_p").asc_nulls_last(), F.col("pos_i"), F.col("user_id")], "place")
    return j.select("user_id", F.coalesce("v_i", "v_p").alias("v"), F.col("pos_i").isNull().alias("gap"), F.col("place").cast("long").alias("place"))


def maximum_matching(edges: DataFrame) -> DataFrame:
    """(sample, size of a maximum matching) of edges (sample, left, right): augmenting paths within a sample."""

    def match(frame: pd.DataFrame) -> pd.DataFrame:
        near: dict[int, list[int]] = {}
        for a, b in sorted(zip(frame["left"], frame["right"], strict=True)):
            near.setdefault(a, []).append(b)
        owner: dict[int, int] = {}
        for start in sorted(near):
            came: dict[int, int] = {}
            queue, goal = [start], None
            while queue and goal is None:
                a = queue.pop(0)
                for b in near.get(a, ()):
                    if b not in came:
                        came[b] = a
                        if b not in owner:
                            goal = b
                            break
                        queue.append(owner[b])
            while goal is not None:
                a = came[goal]
                before = next((b for b, o in owner.items() if o == a), None)
                owner[goal] = a
                goal = before
        return pd.DataFrame({"sample": [frame["sample"].iloc[0]], "matched": [len(owner)]})

    return edges.groupBy("sample").applyInPandas(match, "sample long, matched long")


@query("join24_bipartite_matching")
def join24(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").select(F.col("user_id").alias("sample"), F.dayofmonth("ts").cast("long").alias("left"), F.get_json_object("props", "$.k").cast("long").alias("right")).distinct()
    return maximum_matching(e)


@query("join25_expected_columns", "SELECT v.name AS name, f.n IS NOT NULL AS present, coalesce(f.n, 0) AS n_filled FROM (VALUES ('doc_id'), ('text'), ('lang'), ('region')) v(name) LEFT JOIN (SELECT 'doc_id' AS name, count(doc_id) AS n FROM documents UNION ALL SELECT 'text', count(nullif(trim(text), '')) FROM documents UNION ALL SELECT 'lang', count(nullif(trim(lang), '')) FROM documents) f ON f.name = v.name")
def join25(spark: SparkSession, sf: str) -> DataFrame:
    """Expected columns against those of a table: whether each is there, and its rows with a value, in one scan of the columns asked for."""
    d, expected = table(spark, sf, "documents"), ("doc_id", "text", "lang", "region")
    found = [c for c in d.columns if c in expected]
    filled = d.agg(*[F.count(F.nullif(F.trim(c), F.lit("")) if d.schema[c].dataType.simpleString() == "string" else F.col(c)).alias(c) for c in found])
    counts = filled.select(F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).alias("n")) for c in found])).alias("f")).select("f.*")
    wanted = spark.range(1).select(F.explode(F.array(*map(F.lit, expected))).alias("name"))
    return wanted.join(counts, "name", "left").select("name", F.col("n").isNotNull().alias("present"), F.coalesce("n", F.lit(0)).alias("n_filled"))


@query(
    "join26_blocked_match",
    """
WITH p AS (SELECT item_id, array_to_string(string_split(lower(text), ' ')[1:5], ' ') AS phrase FROM benchmark WHERE len(string_split(text, ' ')) >= 5)
SELECT DISTINCT doc_id, item_id FROM documents JOIN p ON contains(lower(text), phrase)
""",
)
def join26(spark: SparkSession, sf: str) -> DataFrame:
    """Which texts contain which terms: one run over each text finds all phrases, and only what was found meets the terms."""
    words = F.split(F.lower("text"), " ", -1)
    p = table(spark, sf, "benchmark").select("item_id", words.alias("w")).filter(F.size("w") >= 5)
    p = p.select("item_id", F.array_join(F.slice("w", 1, 5), " ").alias("phrase"))
    found = containing(table(spark, sf, "documents").select("doc_id", F.lower("text").alias("text")), "doc_id", p.select("phrase"))
    return found.join(p, "phrase").select("doc_id", "item_id").distinct()


@query("join27_nearest_year", "SELECT c.c_custkey, arg_min(o_orderkey, (abs(year(o_orderdate) - 1998) * 10000 + year(o_orderdate)) * 100000000 + o_orderkey) AS nearest FROM customer c JOIN orders o ON o.o_custkey = c.c_custkey GROUP BY 1")
def join27(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").withColumn("y", F.year("o_orderdate"))
    return o.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.min_by("o_orderkey", F.struct(F.abs(F.col("y") - 1998), "y", "o_orderkey")).alias("nearest"))


@query("join28_merge_plan", "WITH own AS (SELECT p_name, count(DISTINCT p_brand) AS n, min(p_brand) AS b FROM part GROUP BY 1) SELECT p_partkey, CASE WHEN n > 1 THEN 'ambiguous_owner' WHEN b = p_brand THEN 'same_owner' ELSE 'merge' END AS reason FROM part JOIN own USING (p_name)")
def join28(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part").select("p_partkey", "p_name", "p_brand")
    own = p.groupBy("p_name").agg(F.count_distinct("p_brand").alias("n"), F.min("p_brand").alias("b"))
    return p.join(own, "p_name").select("p_partkey", F.when(F.col("n") > 1, "ambiguous_owner").when(F.col("b") == F.col("p_brand"), "same_owner").otherwise("merge").alias("reason"))
