"""Numbers, JSON and arrays (MATH, JSON, ARR)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.plans.catalog import query, table

# Metres in a mile, a furlong, a yard and a foot.
MILE, FURLONG, YARD, FOOT = 1609.344, 201.168, 0.9144, 0.3048
UNKNOWN_DISTANCE = "struct<metres:double,precision:string,unit:string>"


def distance(text: Column) -> Column:
    """struct(metres, precision, unit) of a distance as printed; all null, `unknown` and empty where it isn't understood.

    Bare digits and metres from 100 on are official; miles, furlongs, yards and feet are converted, approximately after
    `about`. A number under 100 before `m` is miles. The first rule that fits decides.
    """
    t = F.trim(text)
    rough = t.rlike("(?i)^(about|approx|approximately) ")
    raw = F.regexp_replace(F.trim(F.regexp_replace(t, "(?i)^(about|approx|approximately) ", "")), "^[芝ダ障]", "")
    number = lambda pattern, k: F.nullif(F.regexp_extract(raw, pattern, k), F.lit("")).try_cast("double")
    part = lambda pattern, k: F.coalesce(number(pattern, k), F.lit(0.0))
    found = lambda metres, precision, unit: F.struct(metres.alias("metres"), precision.alias("precision"), (F.lit(unit) if isinstance(unit, str) else unit).alias("unit"))
    exact, official = F.when(rough, "approximate_conversion").otherwise("exact_conversion"), F.lit("official_metric")
    joined = "(?i)^([0-9]+)m([0-9]+)f(?:([0-9]+)y)?(?:([0-9]+)ft)?$"
    mixed = r"(?i)^([0-9]+)\s+([0-9]+)/([0-9]+)\s*([mf])$"
    decimal = r"(?i)^([0-9]+\.[0-9]+)\s*([mfy])$"
    single = r"(?i)^([0-9]+)\s*(f|y|ft)$"
    metric = r"(?i)^([0-9]+)\s*(?:m|米)$"
    value = lambda pattern, k: F.element_at(F.create_map(*[F.lit(x) for kv in {"m": MILE, "f": FURLONG, "y": YARD, "ft": FOOT}.items() for x in kv]), F.lower(F.regexp_extract(raw, pattern, k)))
    # parts set apart by spaces: the sum of those that are understood
    tokens = F.split(raw, r"\s+")
    sized = lambda unit: F.filter(tokens, lambda x: x.rlike(f"(?i)^[0-9]+{unit}$"))
    sums = {}
    for name in ("m", "f", "y", "ft"):
        n = F.transform(sized("(?:m|米)" if name == "m" else name), lambda x: F.regexp_extract(x, "^[0-9]+", 0).try_cast("double"))
        sums[name] = F.filter(n, lambda x: x < 100) if name == "m" else n
    total = lambda name: F.aggregate(sums[name], F.lit(0.0), lambda a, x: a + x)
    spaced = total("m") * MILE + total("f") * FURLONG + total("y") * YARD + total("ft") * FOOT
    units = F.concat_ws("+", *[F.when(F.size(sums[name]) > 0, name) for name in ("f", "ft", "m", "y")])
    unknown = F.lit(None).cast(UNKNOWN_DISTANCE)
    return F.coalesce(
        F.when(raw.rlike("^[0-9]+$"), found(raw.try_cast("double"), official, "m")),
        F.when(raw.rlike(joined), found(part(joined, 1) * MILE + part(joined, 2) * FURLONG + part(joined, 3) * YARD + part(joined, 4) * FOOT, exact, "m+f+y")),
        F.when(raw.rlike(mixed) & (number(mixed, 3) > 0), found((number(mixed, 1) + number(mixed, 2) / number(mixed, 3)) * value(mixed, 4), exact, F.when(F.lower(F.regexp_extract(raw, mixed, 4)) == "m", "M").otherwise("f"))),
        F.when(raw.rlike(decimal), found(number(decimal, 1) * value(decimal, 2), exact, F.lower(F.regexp_extract(raw, decimal, 2)))),
        F.when((F.size(tokens) > 1) & F.exists(tokens, lambda x: x.rlike("(?i)^[0-9]+(f|y|ft|m|米)$")), found(spaced, exact, units)),
        F.when(raw.rlike(single), found(number(single, 1) * value(single, 2), exact, F.lower(F.regexp_extract(raw, single, 2)))),
        F.when(raw.rlike(metric) & (number(metric, 1) >= 100), found(number(metric, 1), official, "m")),
        F.when(raw.rlike("^[0-9]{1,2}[mM]$"), found(number("^([0-9]+)", 1) * MILE, exact, "m")),
        unknown,
        found(F.lit(None).cast("double"), F.lit("unknown"), ""),
    )


def settled_distance(raw: Column, official: Column) -> Column:
    """struct(metres, precision, unit, status): the official metres if given; a conflict where the text is over a metre from them."""
    d, given = distance(raw), official.cast("double")
    conflict = F.coalesce(F.abs(d["metres"] - given) > 1, F.lit(False))
    metres = F.when(~conflict, F.coalesce(given, d["metres"]))
    precision = F.when(conflict, "unknown").when(given.isNotNull(), "official_metric").otherwise(d["precision"])
    status = F.when(conflict, "conflict").when(metres.isNull(), "unknown").otherwise("normalized")
    return F.struct(metres.alias("metres"), precision.alias("precision"), F.when(conflict, "").otherwise(d["unit"]).alias("unit"), status.alias("status"))


@query(
    "math01_distance",
    """
WITH p AS (SELECT p_partkey, p_partkey % 11 AS k, p_size::DOUBLE AS s, (p_partkey % 8)::DOUBLE AS f, CASE WHEN p_partkey % 4 = 1 THEN 1000 + p_size END AS given FROM part),
d AS (SELECT *, CASE k WHEN 0 THEN s * 100 + 1000 WHEN 1 THEN s * 1609.344 WHEN 2 THEN s * 1609.344 + f * 201.168 WHEN 3 THEN (s + f / 16) * 1609.344 WHEN 4 THEN (s + 0.5) * 201.168
 WHEN 5 THEN s * 1609.344 + f * 201.168 + 110 * 0.9144 WHEN 6 THEN s * 201.168 WHEN 7 THEN 1000 + s WHEN 8 THEN 1000 + s WHEN 9 THEN s * 0.9144 END AS m FROM p),
c AS (SELECT *, coalesce(abs(m - given) > 1, FALSE) AS x FROM d)
SELECT p_partkey, CASE WHEN NOT x THEN round(coalesce(given, m), 3) END AS metres,
CASE WHEN x THEN 'unknown' WHEN given IS NOT NULL THEN 'official_metric' WHEN k = 10 THEN 'unknown' WHEN k IN (0, 7, 8) THEN 'official_metric' WHEN k = 6 THEN 'approximate_conversion' ELSE 'exact_conversion' END AS precision,
CASE WHEN x OR k = 10 THEN '' WHEN k = 2 THEN 'm+f+y' WHEN k = 3 THEN 'M' WHEN k IN (4, 6) THEN 'f' WHEN k = 5 THEN 'f+m+y' WHEN k = 9 THEN 'y' ELSE 'm' END AS unit,
CASE WHEN x THEN 'conflict' WHEN k = 10 AND given IS NULL THEN 'unknown' ELSE 'normalized' END AS status FROM c
""",
)
def math01(spark: SparkSession, sf: str) -> DataFrame:
    """Sizes of all parts as printed distances of eleven forms, some beside an official distance."""
    s, f, k = F.col("p_size").cast("string"), (F.col("p_partkey") % 8).cast("string"), F.col("p_partkey") % 11
    far = (F.col("p_size") + 1000).cast("string")
    forms = [
        (F.col("p_size") * 100 + 1000).cast("string"), F.concat(s, F.lit("m")), F.concat(s, F.lit("m"), f, F.lit("f")), F.concat(s, F.lit(" "), f, F.lit("/16M")), F.concat(s, F.lit(".5f")),
        F.concat(s, F.lit("m "), f, F.lit("f 110y")), F.concat(F.lit("About "), s, F.lit("f")), F.concat(F.lit("ダ"), far, F.lit("m")), F.concat(far, F.lit("米")), F.concat(s, F.lit("Y")), F.col("p_name"),
    ]
    raw = F.element_at(F.array(*forms), (k + 1).cast("int"))
    d = settled_distance(raw, F.when(F.col("p_partkey") % 4 == 1, F.col("p_size") + 1000))
    return table(spark, sf, "part").select("p_partkey", d.alias("d")).select("p_partkey", F.round("d.metres", 3).alias("metres"), "d.precision", "d.unit", "d.status")


@query("math02_exact_half_up", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(round(CAST(l_quantity AS DECIMAL(18,4)) / CAST(3 AS DECIMAL(18,4)) * 20) / 20 AS DOUBLE) AS margin, CAST(l_extendedprice AS DECIMAL(18,2)) AS price FROM lineitem")
def math02(spark: SparkSession, sf: str) -> DataFrame:
    """Twentieths, rounded half up on decimals, never on doubles."""
    third = F.col("l_quantity").cast("decimal(18,4)") / F.lit(3).cast("decimal(18,4)")
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", (F.round(third * 20, 0) / 20).cast("double").alias("margin"), F.col("l_extendedprice").cast("decimal(18,2)").alias("price"))


# Codes of runners without a place, as printed.
FINISH_CODES = {
    "DNF": "did_not_finish", "did_not_finish": "did_not_finish", "PU": "pulled_up", "pulled_up": "pulled_up", "UR": "unseated_rider", "unseated_rider": "unseated_rider", "F": "fell", "fell": "fell", "Fell": "fell",
    "BD": "brought_down", "brought_down": "brought_down", "DSQ": "disqualified", "disqualified": "disqualified", "DQ": "disqualified", "SCR": "scratched", "scratched": "scratched", "NR": "non_runner", "non_runner": "non_runner",
    "WV": "withdrawn", "withdrawn": "withdrawn", "Withdrawn": "withdrawn", "dead_heat": "dead_heat", "DH": "dead_heat", "取消": "scratched", "除外": "scratched", "中止": "did_not_finish", "失格": "disqualified",
}


def finish_position(raw: Column, dead_heat: Column | None = None) -> Column:
    """struct(position, status, start_status) of digits, ordinals and codes; what isn't understood is an unknown starter."""
    t = F.trim(raw)
    place = F.coalesce(*[F.nullif(F.regexp_extract(t, p, 1), F.lit("")) for p in ("^第([0-9]+)$", "(?i)^([0-9]+)(?:st|nd|rd|th)?$")]).try_cast("int")
    code = F.element_at(F.create_map(*[F.lit(x) for kv in FINISH_CODES.items() for x in kv]), t)
    run = F.when(F.coalesce(dead_heat, F.lit(False)), "dead_heat").otherwise("finished") if dead_heat is not None else F.lit("finished")
    status = F.when(place.isNotNull(), run).otherwise(F.coalesce(code, F.lit("unknown")))
    return F.struct(place.alias("position"), status.alias("status"), F.when(status.isin("scratched", "non_runner", "withdrawn"), "non_starter").otherwise("starter").alias("start_status"))


@query(
    "math03_finish_position",
    """
WITH l AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, (l_orderkey + l_linenumber) % 9 AS k, l_returnflag = 'A' AS tied FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN k <= 3 THEN l_linenumber::INT END AS position,
CASE WHEN k <= 3 THEN CASE WHEN tied THEN 'dead_heat' ELSE 'finished' END WHEN k = 4 THEN 'scratched' WHEN k = 5 THEN 'pulled_up' WHEN k = 6 THEN 'withdrawn' WHEN k = 7 THEN 'did_not_finish' ELSE 'unknown' END AS status,
CASE WHEN k IN (4, 6) THEN 'non_starter' ELSE 'starter' END AS start_status FROM l
""",
)
def math03(spark: SparkSession, sf: str) -> DataFrame:
    """Numbers of all lines as printed places of nine forms, returned ones as dead heats."""
    n = F.col("l_linenumber").cast("string")
    ordinal = F.concat(n, F.when(n == "1", "st").when(n == "2", "ND").when(n == "3", "rd").otherwise("th"))
    forms = F.array(n, F.concat(F.lit("第"), n), ordinal, F.concat(F.lit(" 0"), n, F.lit(" ")), F.lit("取消"), F.lit("PU"), F.lit("WV"), F.lit("中止"), F.concat(n, F.lit("?")))
    raw = F.element_at(forms, ((F.col("l_orderkey") + F.col("l_linenumber")) % 9 + 1).cast("int"))
    keys = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    return table(spark, sf, "lineitem").select(*keys, finish_position(raw, F.col("l_returnflag") == "A").alias("p")).select(*keys, "p.position", "p.status", "p.start_status")


def grade(raw: Column) -> Column:
    """Canonical grade of free text, by ordered patterns."""
    t = F.upper(F.translate(raw, "ⅠⅡⅢ１２３", "123123"))
    return F.when(t.rlike(r"\b(G|GR|GRADE|GROUP|JPN)\s*\.?\s*(1|I)\b"), "G1").when(t.rlike(r"\b(G|GR|GRADE|GROUP|JPN)\s*\.?\s*(2|II)\b"), "G2").when(t.rlike(r"\b(G|GR|GRADE|GROUP|JPN)\s*\.?\s*(3|III)\b"), "G3").when(t.rlike(r"\bLISTED\b|\(L\)"), "L")


# Grades as printed in full, patterns in order, and the priority of each grade.
GRADES = {
    "G1": "G1", "GI": "G1", "G2": "G2", "GII": "G2", "G3": "G3", "GIII": "G3", "JPN1": "JPN1", "JPNI": "JPN1", "JPN2": "JPN2", "JPNII": "JPN2", "JPN3": "JPN3", "JPNIII": "JPN3",
    "JG1": "JG1", "JG2": "JG2", "JG3": "JG3", "J-G1": "JG1", "J-G2": "JG2", "J-G3": "JG3", "J・G1": "JG1", "J・G2": "JG2", "J・G3": "JG3", "L": "LISTED", "LISTED": "LISTED", "OP": "OPEN", "OPEN": "OPEN",
    "3WIN": "3WIN", "2WIN": "2WIN", "1WIN": "1WIN", "NEWCOMER": "NEWCOMER", "MAIDEN": "MAIDEN", "LOCAL_GRADE": "LOCAL_GRADE", "OTHER": "OTHER",
}
GRADE_PATTERNS = [
    ("JG1", r"J[\s・.-]*G(?:1|I)"), ("JG2", r"J[\s・.-]*G(?:2|II)"), ("JG3", r"J[\s・.-]*G(?:3|III)"), ("JPN1", r"JPN\s*(?:1|I)"), ("JPN2", r"JPN\s*(?:2|II)"), ("JPN3", r"JPN\s*(?:3|III)"),
    ("G1", "(?:^|[^A-Z0-9])G\\s*(?:1|I)(?:[^A-Z0-9]|$)"), ("G2", "(?:^|[^A-Z0-9])G\\s*(?:2|II)(?:[^A-Z0-9]|$)"), ("G3", "(?:^|[^A-Z0-9])G\\s*(?:3|III)(?:[^A-Z0-9]|$)"),
    ("LISTED", "LISTED|リステッド|(?:^|[^A-Z])L(?:[^A-Z]|$)"), ("OPEN", "OPEN|オープン|(?:^|[^A-Z])OP(?:[^A-Z]|$)"), ("3WIN", "3勝|3WIN"), ("2WIN", "2勝|2WIN"), ("1WIN", "1勝|1WIN"), ("NEWCOMER", "新馬|メイクデビュー"), ("MAIDEN", "未勝利"),
]
GRADE_PRIORITIES = {"G1": 0, "JPN1": 0, "G2": 1, "JPN2": 1, "JG1": 1, "G3": 2, "JPN3": 2, "JG2": 2, "JG3": 2, "LISTED": 2, "OPEN": 2, "LOCAL_GRADE": 2, "3WIN": 3, "2WIN": 3, "1WIN": 3, "NEWCOMER": 3, "MAIDEN": 3, "OTHER": 3}
WIDE = "".join(chr(c + 0xFEE0) for c in range(0x21, 0x7F)) + "\u3000"
PLAIN = "".join(map(chr, range(0x21, 0x7F))) + " "


def race_grade(raw: Column) -> Column:
    """Canonical grade of a printed one, empty if there is none: full-width letters and Roman numerals made plain, whole names first, then patterns in order."""
    plain = F.translate(F.coalesce(raw, F.lit("")), WIDE, PLAIN)
    for sign, letters in (("Ⅰ", "I"), ("Ⅱ", "II"), ("Ⅲ", "III")):
        plain = F.replace(plain, F.lit(sign), F.lit(letters))
    t = F.upper(F.trim(plain))
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in GRADES.items() for x in kv]), t), *[F.when(t.rlike(p), g) for g, p in GRADE_PATTERNS], F.lit(""))


def grade_priority(grade: Column) -> Column:
    """0 to 3, the smaller the better; null without a grade, so that `min` keeps the better of several."""
    return F.element_at(F.create_map(*[F.lit(x) for kv in GRADE_PRIORITIES.items() for x in kv]), grade)


@query(
    "math04_grade",
    """
WITH g(k, grade, priority) AS (VALUES (0, 'G1', 0), (1, 'G2', 1), (2, 'JPN3', 2), (3, 'LISTED', 2), (4, '', NULL), (5, 'JG1', 1), (6, 'OPEN', 2), (7, '3WIN', 3), (8, 'MAIDEN', 3), (9, 'G3', 2))
SELECT p_brand, p_size, min(priority)::INT AS best, count(*) FILTER (WHERE grade <> '') AS graded, min(nullif(grade, '')) AS first_grade FROM part JOIN g ON g.k = p_partkey % 10 GROUP BY ALL
""",
)
def math04(spark: SparkSession, sf: str) -> DataFrame:
    """All parts with a printed grade of ten forms; the best priority of each brand and size."""
    forms = F.array(*map(F.lit, ("ＧⅠ", "Sprint (G2)", "JpnⅢ", "Listed race", "Handicap", "J・G1", "OP", "３勝クラス", "2歳未勝利", "Cup G III")))
    p = table(spark, sf, "part").select("p_brand", "p_size", race_grade(F.element_at(forms, (F.col("p_partkey") % 10 + 1).cast("int"))).alias("grade"))
    return p.groupBy("p_brand", "p_size").agg(F.min(grade_priority(F.col("grade"))).alias("best"), F.count_if(F.col("grade") != "").alias("graded"), F.min(F.nullif("grade", F.lit(""))).alias("first_grade"))


@query("math05_surface_going", "SELECT p_partkey, CASE WHEN p_name LIKE '%red%' OR p_name LIKE '%hot%' THEN 'dirt' WHEN p_name LIKE '%blue%' THEN 'turf' ELSE 'unknown' END AS surface, CASE WHEN p_type = 'ECONOMY' THEN 'good' WHEN p_type = 'SMALL' THEN 'firm' ELSE 'unknown' END AS going FROM part")
def math05(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("p_name")
    surface = F.when(n.contains("red") | n.contains("hot"), "dirt").when(n.contains("blue"), "turf").otherwise("unknown")
    going = F.coalesce(F.element_at(F.create_map(F.lit("ECONOMY"), F.lit("good"), F.lit("SMALL"), F.lit("firm")), F.col("p_type")), F.lit("unknown"))
    return table(spark, sf, "part").select("p_partkey", surface.alias("surface"), going.alias("going"))


@query("math06_credible_grade_filter", "SELECT o_orderkey FROM orders WHERE upper(regexp_extract(o_orderpriority, '[0-9]')) IN ('1', '2') AND o_orderstatus <> 'P'")
def math06(spark: SparkSession, sf: str) -> DataFrame:
    code = F.upper(F.regexp_extract("o_orderpriority", "[0-9]", 0))
    return table(spark, sf, "orders").filter(code.isin("1", "2") & (F.col("o_orderstatus") != "P")).select("o_orderkey")


def article_score(length: Column, source_bonus: Column, value: Column, recency: Column) -> Column:
    """min(100, source + value + recency + structure + min(15, quality // 8)), integer arithmetic throughout."""
    structure = F.when(length >= 240, 10).otherwise(5)
    quality = F.least(F.lit(100), 55 + structure + F.least(F.lit(20), F.floor(length / 120)))
    return F.least(F.lit(100), source_bonus + value + recency + structure + F.least(F.lit(15), F.floor(quality / 8))).cast("long")


SCORE = "least(100, CASE WHEN d.source = 'src0' THEN 15 ELSE 10 END + CASE WHEN l.quality = 1 THEN 25 ELSE 0 END + CASE WHEN d.doc_id % 3 = 0 THEN 10 WHEN d.doc_id % 3 = 1 THEN 6 ELSE 2 END + CASE WHEN n_chars >= 240 THEN 10 ELSE 5 END + least(15, least(100, 55 + CASE WHEN n_chars >= 240 THEN 10 ELSE 5 END + least(20, n_chars // 120)) // 8))::BIGINT"


def scored(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select("doc_id", "lang", "source", "n_chars").join(table(spark, sf, "labels").select("doc_id", "quality", "toxic"), "doc_id", "left")
    recency = F.element_at(F.array(F.lit(10), F.lit(6), F.lit(2)), (F.col("doc_id") % 3 + 1).cast("int"))
    return d.withColumn("score", article_score(F.col("n_chars"), F.when(F.col("source") == "src0", 15).otherwise(10), F.when(F.col("quality") == 1, 25).otherwise(0), recency))


@query("math07_capped_score", f"SELECT d.doc_id, {SCORE} AS score FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id")
def math07(spark: SparkSession, sf: str) -> DataFrame:
    return scored(spark, sf).select("doc_id", "score")


def clamped(c: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(c, F.lit(low)), F.lit(high))


@query("math08_clamp", "SELECT event_id, least(greatest(value - 20, 0.0::DOUBLE), 60.0::DOUBLE) AS value FROM events")
def math08(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select("event_id", clamped(F.col("value") - 20, 0.0, 60.0).alias("value"))


@query("json01_canonical_hash", """SELECT doc_id, sha256('{"doc_id":' || doc_id || ',"lang":"' || lang || '","source":"' || source || '"}') AS digest FROM documents""")
def json01(spark: SparkSession, sf: str) -> DataFrame:
    """Keys in sorted order, compact separators, nulls written: one text, one hash."""
    body = F.to_json(F.struct("doc_id", "lang", "source"), {"ignoreNullFields": "false"})
    return table(spark, sf, "documents").select("doc_id", F.sha2(body, 256).alias("digest"))


@query("json02_strict_contract", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) BETWEEN 0 AND 60 AS valid FROM events")
def json02(spark: SparkSession, sf: str) -> DataFrame:
    """Exact keys, types and bounds; anything else is invalid."""
    parsed = F.from_json("props", "k long, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    keys = F.json_object_keys("props")
    e = table(spark, sf, "events").select("event_id", parsed.alias("p"), keys.alias("keys"))
    return e.select("event_id", (F.col("p._bad").isNull() & (F.col("keys") == F.array(F.lit("k"))) & F.col("p.k").between(0, 60)).alias("valid"))


@query("json03_merge", """SELECT event_id, 'k=' || json_extract_string(props, '$.k') || ',type=' || event_type AS merged FROM events""")
def json03(spark: SparkSession, sf: str) -> DataFrame:
    """The later map's values win, key by key."""
    first = F.from_json("props", "map<string,string>")
    second = F.create_map(F.lit("type"), F.col("event_type"))
    kept = F.map_filter(first, lambda k, v: ~F.map_contains_key(second, "type") | (k != "type"))
    merged = F.map_concat(kept, second)
    return table(spark, sf, "events").select("event_id", F.array_join(F.transform(F.array_sort(F.map_entries(merged)), lambda e: F.concat_ws("=", e["key"], e["value"])), ",").alias("merged"))


@query("arr01_array_algebra", "SELECT vec_id, len(list_distinct(list_transform(embedding, lambda x: round(x::DOUBLE, 1)))) AS n_distinct, len(list_filter(embedding, lambda x: x > 0)) AS n_positive, round(list_max(embedding)::DOUBLE, 6) AS top FROM embeddings")
def arr01(spark: SparkSession, sf: str) -> DataFrame:
    v = F.col("embedding")
    rounded = F.array_distinct(F.transform(v, lambda x: F.round(x.cast("double"), 1) + 0.0))
    return table(spark, sf, "embeddings").select("vec_id", F.size(rounded).cast("long").alias("n_distinct"), F.size(F.filter(v, lambda x: x > 0)).cast("long").alias("n_positive"), F.round(F.array_max(v).cast("double"), 6).alias("top"))


AUTHORITY = "WITH c AS (SELECT o_custkey AS k, o_orderstatus AS v, CASE o_orderpriority WHEN '1-URGENT' THEN 50 WHEN '2-HIGH' THEN 40 WHEN '3-MEDIUM' THEN 30 ELSE 10 END AS r FROM orders), t AS (SELECT k, max(r) AS top FROM c GROUP BY 1), w AS (SELECT c.k, count(DISTINCT v) AS n, min(v) AS v, any_value(top) AS top FROM c JOIN t ON t.k = c.k AND c.r = t.top GROUP BY 1) SELECT k, top, CASE WHEN n = 1 THEN v END AS value, n > 1 AS blocked FROM w"


def merged_by_authority(candidates: DataFrame, key: str, value: str, rank: str) -> DataFrame:
    """The value that all candidates of the highest rank agree on; a disagreement there blocks the field."""
    c = candidates.filter(F.col(value).isNotNull() & (F.trim(value) != ""))
    own = c.groupBy(key, rank).agg(F.count_distinct(value).alias("n"), F.min(value).alias("v"))
    top = own.groupBy(key).agg(F.max_by(F.struct(F.col(rank).alias("top"), "n", "v"), rank).alias("b"))
    return top.select(F.col(key), "b.top", F.when(F.col("b.n") == 1, F.col("b.v")).alias("value"), (F.col("b.n") > 1).alias("blocked"))


@query("arr02_authority_merge", AUTHORITY)
def arr02(spark: SparkSession, sf: str) -> DataFrame:
    rank = F.when(F.col("o_orderpriority") == "1-URGENT", 50).when(F.col("o_orderpriority") == "2-HIGH", 40).when(F.col("o_orderpriority") == "3-MEDIUM", 30).otherwise(10)
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderstatus").alias("v"), rank.alias("r"))
    return merged_by_authority(o, "k", "v", "r")


@query("arr03_completeness_tier", "SELECT c_custkey, CASE WHEN (c_acctbal > 0)::INT + (c_mktsegment <> 'HOUSEHOLD')::INT + (c_nationkey > 4)::INT = 3 THEN 'full' WHEN (c_acctbal > 0)::INT + (c_mktsegment <> 'HOUSEHOLD')::INT + (c_nationkey > 4)::INT >= 2 THEN 'partial' ELSE 'thin' END AS tier FROM customer")
def arr03(spark: SparkSession, sf: str) -> DataFrame:
    present = F.array(F.col("c_acctbal") > 0, F.col("c_mktsegment") != "HOUSEHOLD", F.col("c_nationkey") > 4)
    n = F.size(F.filter(present, lambda x: x))
    return table(spark, sf, "customer").select("c_custkey", F.when(F.forall(present, lambda x: x), "full").when(n >= 2, "partial").otherwise("thin").alias("tier"))


def previous_hash(df: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """Rows whose content hash differs from the one before them."""
    w = Window.partitionBy(key).orderBy(*order)
    h = F.sha2(F.col(value).cast("string"), 256)
    return df.withColumn("changed", ~h.eqNullSafe(F.lag(h).over(w)))
