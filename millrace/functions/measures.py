"""Exact weights, margins and odds (MATH-02) and strict JSON documents (JSON-02).

Numbers stay integers and decimals, never doubles; what can't be read whole is `unresolved`, an empty text `missing`.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.plans.catalog import query, table

#: Full-width forms of 0x21-0x7E, the ideographic space and the fraction slash, as NFKC has them.
_WIDE = "".join(chr(c + 0xFEE0) for c in range(0x21, 0x7F)) + "　⁄"
_NARROW = "".join(map(chr, range(0x21, 0x7F))) + " /"

# Kilograms in a pound, labels of margins and of odds.
POUND = "0.45359237"
MARGINS = {"nose": "鼻差", "nse": "鼻差", "ハナ": "鼻差", "鼻差": "鼻差", "head": "头差", "hd": "头差", "アタマ": "头差", "头差": "头差", "neck": "颈差", "nk": "颈差", "クビ": "颈差", "颈差": "颈差", "short head": "短头差", "shd": "短头差", "short neck": "短颈差", "同着": "同着", "dead heat": "同着", "dh": "同着", "大差": "大差"}
ODDS = {"decimal": "十进制", "fractional": "分数", "hong_kong": "香港", "us_net": "美国净赔率"}


def narrow(raw: Column) -> Column:
    """Trimmed lower-case text with full-width forms made narrow; null is empty."""
    return F.lower(F.trim(F.translate(F.coalesce(raw, F.lit("")), _WIDE, _NARROW)))


def _lookup(values: dict[str, str], key: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in values.items() for x in kv]), key)


def _state(text: Column, ok: Column) -> Column:
    return F.when(text == "", "missing").when(F.coalesce(ok, F.lit(False)), "parsed").otherwise("unresolved")


#: A mixed number, a fraction or a decimal; white space and line ends as Spark's patterns have them.
RATIONAL = re.compile(r"(?:(?:([0-9]{1,9})[ \t-\r]+)?([0-9]{1,9})/([0-9]{1,9})|([0-9]{1,9})(?:\.([0-9]{1,9}))?)(?:\r\n|[\n\r\x85\u2028\u2029])?\Z")
LOWEST = pa.struct([("num", pa.int64()), ("den", pa.int64())])


def lowest(text: str | None) -> dict[str, int] | None:
    """num and den of a text in lowest terms; null where it isn't a number, or for a denominator of 0."""
    m = RATIONAL.match(text or "")
    if not m:
        return None
    whole, over, under, point, digits = m.groups("")
    num, den = (int(whole or 0) * int(under) + int(over), int(under)) if under else (int(point + digits), 10 ** len(digits))
    common = math.gcd(num, den)
    return {"num": num // common, "den": den // common} if den else None


#: A length and its unit; and a mixed number with a point, which sources of lengths write.
SPELLED = re.compile(r"([0-9]+[ \t-\r]+[0-9]+/[0-9]+|[0-9]+/[0-9]+|[0-9]+(?:\.[0-9]+)?)[ \t-\r]*(lengths?|l|马身)?(?:\r\n|[\n\r\x85\u2028\u2029])?\Z")
POINTED = re.compile(r"\A([0-9]+)\.([0-9]+/[0-9]+)(?=(?:\r\n|[\n\r\x85\u2028\u2029])?\Z)")


def length(text: str | None, unit: str | None) -> dict[str, int] | None:
    """num and den of lengths (`1½l`, `3/4 length`); a bare number only where the source gives lengths."""
    text = text or ""
    for sign, value in (("½", "1/2"), ("¼", "1/4"), ("¾", "3/4")):
        if sign in text:
            text = re.sub(f"(?<=[0-9]){sign}", " " + value, text).replace(sign, value)
    if unit == "length":
        text = POINTED.sub(r"\1 \2", text)
    m = SPELLED.match(text)
    return lowest(m[1]) if m and (m[2] or unit == "length") else None


def rational(text: Column) -> Column:
    """struct(num, den) of `3`, `2.25`, `1/3` or `1 1/2`; null otherwise, or beyond nine digits a number.

    In Arrow batches, each different text of a batch once: Spark has no greatest common divisor, and steps of Euclid's as
    expressions are evaluated again wherever a number is used.
    """

    return F.arrow_udf(_each_once(lowest), "struct<num:bigint,den:bigint>")(text)


def _each_once(f: Callable[..., dict[str, int] | None]) -> Callable[..., pa.Array]:
    """f over columns of texts, once for each different row of a batch."""

    def run(*columns: pa.Array) -> pa.Array:
        held = [c.dictionary_encode("encode") for c in columns]
        code = pa.array(np.zeros(len(columns[0]), dtype="int64"))
        for c in held:
            # numbered anew after each column, so that codes stay small
            code = pc.add(pc.multiply(code, len(c.dictionary)), c.indices.cast("int64")).dictionary_encode().indices.cast("int64")
        first = pc.index_in(pa.array(np.arange(pc.max(code).as_py() + 1 if len(code) else 0)), code)
        rows = zip(*[c.take(first).to_pylist() for c in columns], strict=True)
        return pa.array([f(*r) for r in rows], LOWEST).take(code)

    return run


def weight(raw: Column, unit: Column) -> Column:
    """struct(amount, unit, kilos, state) of `57kg`, `126 lbs`, or `9-4` where the source gives stone and pounds.

    A bare number takes the source's unit (kg or lb). Pounds become tenths of a kilogram, rounded half up; ten decimals count.
    """
    t, stones = narrow(raw), r"^([0-9]{1,2})-([0-9]{1,2})$"
    part = lambda k: F.regexp_extract(t, stones, k).try_cast("int")
    pounds = F.when(part(2) < 14, F.concat((part(1) * 14 + part(2)).cast("string"), F.lit("lb")))
    bare = t.rlike(r"^[0-9]+(\.[0-9]+)?$") & unit.isin("kg", "lb")
    whole = F.when(unit == "stone_lb", F.coalesce(pounds, F.lit("?"))).when(bare, F.concat(t, unit)).otherwise(t)
    form = r"^([0-9]{1,3}(?:\.[0-9]+)?)\s*(kg|千克|公斤|lbs?|磅)$"
    amount = F.regexp_extract(whole, form, 1).try_cast("decimal(13,10)")
    named = F.when(F.regexp_extract(whole, form, 2).isin("kg", "千克", "公斤"), "kg").otherwise("lb")
    ok = (amount > 0) & (amount <= 1000)
    kilos = F.when(named == "kg", amount).otherwise(F.round(amount * F.lit(POUND).cast("decimal(8,8)"), 1).cast("decimal(13,10)"))
    return F.struct(F.when(ok, amount).alias("amount"), F.when(ok, named).alias("unit"), F.when(ok, kilos).alias("kilos"), _state(t, ok).alias("state"))


def margin(raw: Column, unit: Column) -> Column:
    """struct(label, num, den, state) of a named margin, or of lengths as an exact fraction (`1½l`, `3/4 length`)."""
    t = narrow(raw)
    label = _lookup(MARGINS, t)
    value = F.when(label.isNull(), F.arrow_udf(_each_once(length), "struct<num:bigint,den:bigint>")(t, unit))
    return F.struct(label.alias("label"), value["num"].alias("num"), value["den"].alias("den"), _state(t, label.isNotNull() | value.isNotNull()).alias("state"))


def odds(raw: Column, form: Column) -> Column:
    """struct(label, num, den, state): fractional odds as `5/2`, others as a number; decimal odds are 1 at least."""
    t = narrow(raw)
    fits = F.when(form == "fractional", t.rlike(r"^[0-9]+/[1-9][0-9]*$")).otherwise(t.rlike(r"^[0-9]+(\.[0-9]+)?$"))
    value = F.when(fits & form.isin(*ODDS), rational(t))
    ok = value.isNotNull() & ((form != "decimal") | (value["num"] >= value["den"]))
    return F.struct(F.when(ok, F.concat(t, F.lit("（"), _lookup(ODDS, form), F.lit("）"))).alias("label"), F.when(ok, value["num"]).alias("num"), F.when(ok, value["den"]).alias("den"), _state(t, ok).alias("state"))


KEYS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]


def _items(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").select(*KEYS, F.col("l_quantity").cast("long").alias("q"))


@query("math02_weight", "WITH r AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_quantity AS BIGINT) AS q FROM lineitem) SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_linenumber % 3 = 0 THEN 'kg' ELSE 'lb' END AS unit, CAST(CASE WHEN l_linenumber % 3 = 0 THEN q ELSE round(CAST(q AS DECIMAL(13,10)) * CAST(0.45359237 AS DECIMAL(8,8)), 1) END AS DOUBLE) AS kilos, 'parsed' AS state FROM r")
def math02_weight(spark: SparkSession, sf: str) -> DataFrame:
    """Quantities written as kilograms, pounds, or stone and pounds, and read again."""
    kind, q = F.col("l_linenumber") % 3, F.col("q")
    raw = F.when(kind == 0, F.concat(q, F.lit("kg"))).when(kind == 1, F.concat(q, F.lit(" lbs"))).otherwise(F.concat(F.floor(q / 14), F.lit("-"), q % 14))
    w = weight(raw, F.when(kind == 2, "stone_lb").otherwise(""))
    return _items(spark, sf).select(*KEYS, w.alias("w")).select(*KEYS, "w.unit", F.col("w.kilos").cast("double").alias("kilos"), "w.state")


@query("math02_margin", "WITH r AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_quantity AS BIGINT) AS q, l_linenumber % 4 AS kind FROM lineitem) SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN kind = 3 THEN '颈差' END AS label, CAST(CASE WHEN kind < 2 THEN 2 * q + 1 WHEN kind = 2 THEN q // gcd(q, 4) END AS BIGINT) AS num, CAST(CASE WHEN kind < 2 THEN 2 WHEN kind = 2 THEN 4 // gcd(q, 4) END AS BIGINT) AS den FROM r")
def math02_margin(spark: SparkSession, sf: str) -> DataFrame:
    """Quantities written as margins in four ways, and read again as fractions in lowest terms."""
    kind, q = F.col("l_linenumber") % 4, F.col("q")
    raw = F.when(kind == 0, F.concat(q, F.lit(" 1/2 lengths"))).when(kind == 1, F.concat(q, F.lit("½L"))).when(kind == 2, F.concat(q, F.lit("/4马身"))).otherwise("Neck")
    return _items(spark, sf).select(*KEYS, margin(raw, F.lit("")).alias("m")).select(*KEYS, "m.label", "m.num", "m.den")


@query("math02_odds", "WITH r AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_quantity AS BIGINT) AS q, l_linenumber % 2 = 0 AS f FROM lineitem) SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN f THEN q || '/' || l_linenumber || '（分数）' WHEN q >= 10 THEN (q // 10) || '.' || (q % 10) || '（十进制）' END AS label, CASE WHEN f OR q >= 10 THEN 'parsed' ELSE 'unresolved' END AS state FROM r")
def math02_odds(spark: SparkSession, sf: str) -> DataFrame:
    """Quantities written as fractional odds, or as tenths of decimal odds, of which those below 1 are refused."""
    own, q = F.col("l_linenumber") % 2 == 0, F.col("q")
    raw = F.when(own, F.concat(q, F.lit("/"), "l_linenumber")).otherwise(F.concat(F.floor(q / 10), F.lit("."), q % 10))
    o = odds(raw, F.when(own, "fractional").otherwise("decimal"))
    return _items(spark, sf).select(*KEYS, o.alias("o")).select(*KEYS, "o.label", "o.state")


# Bounds of a document.
MOST_BYTES, MOST_DEPTH, MOST_NODES = 1 << 20, 64, 100_000


class _Refused(Exception):
    pass


def _unique(pairs: list[tuple]) -> dict:
    out = dict(pairs)
    if len(out) < len(pairs):
        raise _Refused("duplicate_json_key")
    return out


def _constant(_: str):
    raise _Refused("nonfinite_value")


def refusal(body: str | None) -> str | None:
    """Why a JSON document is refused: invalid_json, duplicate_json_key, nonfinite_value or document_limit; null if it isn't."""
    try:
        if body is None:
            return "invalid_json"
        if len(body.encode()) > MOST_BYTES:
            return "document_limit"
        level, n = [json.loads(body, object_pairs_hook=_unique, parse_constant=_constant)], 0
        for _ in range(MOST_DEPTH + 1):  # level by level
            n += len(level)
            if n > MOST_NODES:
                return "document_limit"
            if any(type(x) is float and not math.isfinite(x) for x in level):
                return "nonfinite_value"
            level = [y for x in level if type(x) in (dict, list) for y in (x.values() if type(x) is dict else x)]
            if not level:
                return None
        return "document_limit"
    except _Refused as why:
        return str(why)
    except (ValueError, RecursionError):
        return "invalid_json"


def strict_json(body: Column) -> Column:
    """refusal() in Arrow batches: Spark's own parser takes repeated keys without a word."""

    def run(values: pd.Series) -> pd.Series:
        return pd.Series([refusal(None if pd.isna(v) else v) for v in values], dtype=object)

    return F.pandas_udf(run, "string")(body)


@query("json02_strict_document", "SELECT event_id, CASE event_id % 5 WHEN 1 THEN 'duplicate_json_key' WHEN 2 THEN 'nonfinite_value' WHEN 3 THEN 'document_limit' WHEN 4 THEN 'invalid_json' END AS code FROM events")
def json02_documents(spark: SparkSession, sf: str) -> DataFrame:
    """The props of every event, whole, or with a key twice, a number that isn't finite, too deep, or cut off."""
    p, kind = F.col("props"), F.col("event_id") % 5
    inner = F.substring(p, 2, 1 << 30)
    body = F.when(kind == 1, F.concat(F.lit('{"k":0,'), inner)).when(kind == 2, F.concat(F.lit('{"x":-Infinity,'), inner)).when(kind == 3, F.concat(F.lit("[" * 65), p, F.lit("]" * 65))).when(kind == 4, F.concat(F.lit("["), p)).otherwise(p)
    return table(spark, sf, "events").select("event_id", strict_json(body).alias("code"))
