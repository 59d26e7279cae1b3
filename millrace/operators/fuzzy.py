"""Fuzzy names (JOIN-16): an index of rare letter pairs finds all texts whose sequence ratio may reach a threshold.

A ratio of t needs M >= t * (a + b) / 2 matched code points in order, so a - M are left out of the one text and b - M of the
other. Each left out takes at most two letter pairs of its own text away, and each of the other text's at most one. So of a text's
pairs, ordered from rare to frequent, one of the first 1 + 2 * (a - M) + (b - M) is shared by every text that can match,
among whose first ones it also is. Only texts that share such a pair are compared: by their lengths, by
their letters' counts, and then by the ratio itself.

Numbered names share nearly all of their pairs, so where a text of its length has few enough ways to lose a - M code points, what is
left of it is the index in place of pairs: texts that can match have a common rest of M code points.
"""

from __future__ import annotations

import difflib
import itertools
import math
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.plans.catalog import query, table

from .ordering import stored


def plain_name(name: Column) -> Column:
    """Case and white space folded."""
    return F.trim(F.regexp_replace(F.lower(F.upper(name)), r"\s+", " "))


def rare_pairs(texts: DataFrame, threshold: float) -> DataFrame:
    """texts (side, region, text) with one row for each letter pair (pair, occurrence) to look under, and the text's size."""
    if threshold <= 2 / 3:
        raise ValueError("texts at a ratio of two thirds or less may share no pair of letters")
    letters = F.split("text", "")
    pairs = F.when(F.size(letters) > 1, F.zip_with(F.slice(letters, F.lit(1), F.size(letters) - 1), F.slice(letters, F.lit(2), F.size(letters) - 1), lambda x, y: F.concat(x, y))).otherwise(F.array("text"))
    rows = texts.filter("text <> ''").withColumn("size", F.length("text")).withColumn("pair", F.explode(pairs))
    rows = rows.groupBy("side", "region", "text", "size", "pair").agg(F.count("*").alias("times"))
    rows = rows.select("side", "region", "text", "size", "pair", F.explode(F.sequence(F.lit(1).cast("long"), "times")).alias("occurrence"))
    often = rows.groupBy("pair", "occurrence").agg(F.count("*").alias("often"))
    missing = lambda other: (2 - 1.5 * threshold) * F.col("size") + (1 - 1.5 * threshold) * other
    shortest, longest = F.ceil(threshold * F.col("size") / (2 - threshold) - 1e-9), F.floor(F.col("size") * (2 - threshold) / threshold + 1e-9)
    order = Window.partitionBy("side", "region", "text").orderBy("often", "pair", "occurrence")  # the pairs of one name
    reach = F.floor(F.greatest(missing(shortest), missing(longest)) + 1e-9) + 1
    kept = rows.join(often, ["pair", "occurrence"]).withColumn("k", F.row_number().over(order)).filter(F.col("k") <= reach).drop("k", "often")
    # a text that may lose all its pairs is looked under its letters; it is short, for any threshold above two thirds
    short = texts.filter("text <> ''").withColumn("size", F.length("text")).filter((F.col("size") <= reach))
    return kept.unionByName(short.select("side", "region", "text", "size", F.explode(F.array_distinct(F.split("text", ""))).alias("pair"), F.lit(0).cast("long").alias("occurrence")))


#: The most rests of a text that an index of rests may take, and the longest text in it.
RESTS, LONGEST = 600, 64


def _common(a: int, b: int, threshold: float) -> int | None:
    """Least number of matched code points of texts of these lengths; null where no number reaches the threshold."""
    least = math.ceil(threshold * (a + b) / 2 - 1e-9)
    return least if least <= min(a, b) else None


def near_texts(left: DataFrame, right: DataFrame, threshold: float) -> DataFrame:
    """(region, text, other): all different texts of left and right (region, text) of one region whose longest common subsequence may
    reach a sequence ratio of the threshold, and some that don't reach it. A pair may come several times."""
    sides = left.select(F.lit(0).alias("side"), "region", "text").unionByName(right.select(F.lit(1).alias("side"), "region", "text")).filter("text <> '' and region is not null").distinct()
    sides = stored(sides.withColumn("size", F.length("text")))
    sizes: tuple[set[int], set[int]] = (set(), set())
    for r in sides.select("side", "size").distinct().collect():  # lengths, not texts
        sizes[r["side"]].add(r["size"])
    rests: dict[tuple[int, int], set[int]] = {}
    longer: tuple[set[int], set[int]] = (set(), set())  # lengths with a partner that rests don't cover
    for a in sizes[0]:
        for b in sizes[1]:
            least = _common(a, b, threshold)
            if least is None:
                continue
            if max(a, b) <= LONGEST and max(math.comb(a, least), math.comb(b, least)) <= RESTS:
                rests.setdefault((0, a), set()).add(least)
                rests.setdefault((1, b), set()).add(least)
            else:
                longer[0].add(a)
                longer[1].add(b)

    def left_over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                own = batch.slice(start, 500)
                at, held = [], []
                for i, (side, text) in enumerate(zip(own.column(0).to_pylist(), own.column(2).to_pylist(), strict=True)):
                    mine = {"".join(c) for least in rests.get((side, len(text)), ()) for c in itertools.combinations(text, least)}
                    at += [i] * len(mine)
                    held += mine
                rows = pa.array(at, pa.int64())
                yield pa.RecordBatch.from_arrays([*[c.take(rows) for c in own.columns], pa.array(held, pa.string())], [*own.schema.names, "rest"])

    def met(rows: Callable[[DataFrame], DataFrame], sides: DataFrame, keys: list[str]) -> DataFrame:
        a, b = rows(sides.filter("side = 0")).drop("side"), rows(sides.filter("side = 1")).select(*keys, F.col("text").alias("other"), F.col("size").alias("size_b"))
        return a.join(b, keys).filter(F.col("text") != F.col("other"))

    region, n = sides.schema["region"].dataType.simpleString(), int(sides.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def by_rests(own: DataFrame) -> DataFrame:
        # a count is named, as the rests of a few MB of texts are work for many tasks
        rows = own.repartition(n, "region", "text").mapInArrow(left_over, f"side int, region {region}, text string, size int, rest string")
        return rows.select("side", "region", "text", "size", F.xxhash64("region", "rest").alias("key"), F.length("rest").alias("least"))

    found = met(by_rests, sides, ["region", "key", "least"]).filter(F.col("least") == F.ceil(threshold * (F.col("size") + F.col("size_b")) / 2 - 1e-9)).select("region", "text", "other")
    if longer[0]:
        rest = sides.filter((F.col("side") == 0) & F.col("size").isin(longer[0]) | (F.col("side") == 1) & F.col("size").isin(longer[1]))
        fits = 2 * F.least("size", "size_b") >= threshold * (F.col("size") + F.col("size_b")) - 1e-9
        found = found.unionByName(met(lambda own: own, stored(rare_pairs(rest.drop("size"), threshold)), ["region", "pair", "occurrence"]).filter(fits).select("region", "text", "other"))
    return found


def similar_texts(left: DataFrame, right: DataFrame, threshold: float) -> DataFrame:
    """(region, text, other, ratio): different texts of left and right (region, text), of one region, with a sequence ratio of at least the threshold."""

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = []
            for text, other in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                m = difflib.SequenceMatcher(None, text, other)
                found.append(m.ratio() if m.quick_ratio() >= threshold else 0.0)  # the counts of letters bound the ratio
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(found, pa.float64())], ["region", "text", "other", "ratio"])

    return near_texts(left, right, threshold).distinct().mapInArrow(scored, "region string, text string, other string, ratio double").filter(F.col("ratio") >= threshold)


def proposals(requests: DataFrame, names: DataFrame, threshold: float = 0.88) -> DataFrame:
    """request, status, reason, series and candidates of requests (request, name, region, year) against names (series, region, name, first_year, last_year).

    One series of the region with this very name, valid in the year: matched. Several: review, ambiguous. None: review, with
    the best score of each series whose valid names are similar, best first, ties by series. Open ends of validity are
    null. Requests without a name or region find nothing.
    """
    requests = stored(requests.select("request", "region", "year", plain_name(F.col("name")).alias("text")))
    # requests that ask the same have the same answer, which is worked out once
    asked = stored(requests.select("region", "text", "year").distinct().withColumn("question", F.monotonically_increasing_id()))
    known = stored(names.select("series", "region", "first_year", "last_year", plain_name(F.col("name")).alias("other")).distinct())
    similar = similar_texts(asked.filter("region is not null"), known.select("region", F.col("other").alias("text")), threshold)
    same = asked.filter("text <> ''").select("region", "text").distinct().select("region", "text", F.col("text").alias("other"), F.lit(1.0).alias("ratio"))
    pairs = stored(similar.unionByName(same).join(known, ["region", "other"]))
    valid = (F.coalesce("first_year", F.col("year")) <= F.col("year")) & (F.coalesce("last_year", F.col("year")) >= F.col("year"))
    best = asked.join(pairs, ["region", "text"]).filter(F.col("year").isNull() | valid).groupBy("question", "series").agg(F.max("ratio").alias("ratio"), F.bool_or(F.col("text") == F.col("other")).alias("exact"))
    # a question has a few series: those whose names are all but its own
    entry = F.struct((-F.round("ratio", 4)).alias("less"), F.col("series"))
    by = best.groupBy("question").agg(F.count_if("exact").alias("n_exact"), F.min(F.when(F.col("exact"), F.col("series"))).alias("own"), F.sort_array(F.collect_list(F.when(F.col("exact"), F.col("series")))).alias("equal"), F.sort_array(F.collect_list(entry)).alias("ranked"))
    by = asked.join(by, "question").drop("question").toDF(*[f"__{c}" if c in asked.columns else c for c in ["region", "text", "year", *by.columns[1:]]])
    same = F.col("region").eqNullSafe(F.col("__region")) & F.col("text").eqNullSafe(F.col("__text")) & F.col("year").eqNullSafe(F.col("__year"))
    found = requests.join(by, same, "left").withColumn("n_exact", F.coalesce("n_exact", F.lit(0)))
    listed = F.transform("ranked", lambda c: F.struct(c["series"].alias("series"), (-c["less"]).alias("score")))
    several = F.transform("equal", lambda s: F.struct(s.alias("series"), F.lit(1.0).alias("score")))
    reason = F.when(F.col("n_exact") == 1, "exact_historical_name").when(F.col("n_exact") > 1, "ambiguous_exact_name").when(F.col("ranked").isNotNull(), "fuzzy_match_requires_review").otherwise("no_authoritative_mapping")
    status = F.when(F.col("n_exact") == 1, "matched").otherwise("identity_review_required")
    none = F.lit(None).cast("array<struct<series:bigint,score:double>>")
    chosen = F.when(F.col("n_exact") == 1, none).when(F.col("n_exact") > 1, several).otherwise(F.coalesce(listed, F.array().cast("array<struct<series:bigint,score:double>>")))
    return found.select("request", status.alias("status"), reason.alias("reason"), F.when(F.col("n_exact") == 1, F.col("own")).alias("series"), chosen.alias("candidates"))


@query("join16_series_mapping")
def join16_mapping(spark: SparkSession, sf: str) -> DataFrame:
    """Names of suppliers and parts as they might be reported, every third part with a letter left out, against all known names of their region."""
    s, p = table(spark, sf, "supplier"), table(spark, sf, "part")
    nation = F.concat(F.lit("nation "), F.col("s_nationkey"))
    at = (F.col("p_partkey") % F.length("p_name") + 1).cast("int")
    spelled = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.substring("p_name", F.lit(1), at - 1), F.substring("p_name", at + 1, F.length("p_name")))).otherwise(F.col("p_name"))
    year = (1990 + F.col("p_partkey") % 20).cast("int")
    requests = s.select((-1 - F.col("s_suppkey")).alias("request"), F.regexp_replace("s_name", "#0", " ").alias("name"), nation.alias("region"), F.lit(None).cast("int").alias("year"))
    requests = requests.unionByName(p.select(F.col("p_partkey").cast("long").alias("request"), spelled.alias("name"), F.col("p_brand").alias("region"), year.alias("year")))
    first = (1985 + F.col("p_size") % 10).cast("int")
    names = s.select((-1 - F.col("s_suppkey")).alias("series"), nation.alias("region"), F.col("s_name").alias("name"), F.lit(None).cast("int").alias("first_year"), F.lit(None).cast("int").alias("last_year"))
    names = names.unionByName(p.select(F.col("p_size").cast("long").alias("series"), F.col("p_brand").alias("region"), F.col("p_name").alias("name"), first.alias("first_year"), (first + 12).alias("last_year")))
    found = proposals(requests, names).withColumn("best", F.get("candidates", F.lit(0)))
    return found.select("request", "status", "reason", "series", F.size(F.coalesce("candidates", F.array())).cast("long").alias("n_candidates"), F.col("best.series").alias("best_series"), F.col("best.score").alias("best_score"))
