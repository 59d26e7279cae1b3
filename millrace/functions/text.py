"""Text functions (STR). Built-in expressions throughout; Arrow batches only where Spark has no equivalent."""

from __future__ import annotations

import difflib
import re
import unicodedata
from decimal import Decimal
from fractions import Fraction

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.plans.catalog import query, table

WORD = r"[\p{L}\p{N}_]+"


def _nfkc(values: pd.Series) -> pd.Series:
    return values.map(lambda v: None if v is None else unicodedata.normalize("NFKC", v).strip().casefold())


def nfkc_casefold(c: str | Column) -> Column:
    """NFKC, trimmed and case-folded: Spark has no NFKC of its own."""
    return F.pandas_udf(_nfkc, "string")(c)


def docs(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents")


@query("str01_nfkc", "SELECT item_id, lower(trim(nfc_normalize(text), ' ' || chr(10))).replace('ß', 'ss') AS key FROM benchmark")
def str01(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "benchmark").select("item_id", nfkc_casefold("text").alias("key"))


def squeezed(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, "[ \\t\\n\\r]+", " "))


@query("str02_white_space", r"SELECT doc_id, trim(regexp_replace(text, '[ \t\n\r]+', ' ', 'g')) AS text FROM documents")
def str02(spark: SparkSession, sf: str) -> DataFrame:
    return docs(spark, sf).select("doc_id", squeezed(F.col("text")).alias("text"))


@query("str03_token_set", rf"SELECT doc_id, len(list_distinct(list_filter(regexp_extract_all(lower(text), '{WORD}'), lambda w: length(w) > 1))) AS n_tokens FROM documents")
def str03(spark: SparkSession, sf: str) -> DataFrame:
    tokens = F.array_distinct(F.filter(F.regexp_extract_all(F.lower("text"), F.lit(WORD), F.lit(0)), lambda w: F.length(w) > 1))
    return docs(spark, sf).select("doc_id", F.size(tokens).cast("long").alias("n_tokens"))


@query("str04_fingerprint", r"SELECT doc_id, sha256(regexp_replace(lower(text), '[ \t\n\r]+', ' ', 'g')) AS fp FROM documents")
def str04(spark: SparkSession, sf: str) -> DataFrame:
    return docs(spark, sf).select("doc_id", F.sha2(F.regexp_replace(F.lower("text"), "[ \\t\\n\\r]+", " "), 256).alias("fp"))


@query("str05_context", "SELECT doc_id, substr(text, greatest(1, instr(text, 'token') - 50)::BIGINT, (least(length(text), instr(text, 'token') + 55) - greatest(1, instr(text, 'token') - 50) + 1)::BIGINT) AS context FROM documents WHERE contains(text, 'token')")
def str05(spark: SparkSession, sf: str) -> DataFrame:
    """A term with 50 characters around it."""
    at = F.instr("text", "token")
    start = F.greatest(F.lit(1), at - 50)
    return docs(spark, sf).filter(F.col("text").contains("token")).select("doc_id", F.substring(F.col("text"), start, F.least(F.length("text"), at + 55) - start + 1).alias("context"))


@query("str06_occurrences", "SELECT doc_id, (length(text) - length(replace(text, 'the', ''))) // 3 AS n FROM documents")
def str06(spark: SparkSession, sf: str) -> DataFrame:
    n = (F.length("text") - F.length(F.replace("text", F.lit("the"), F.lit("")))) / 3
    return docs(spark, sf).select("doc_id", n.cast("long").alias("n"))


FINDERS = (("date", r"[0-9]{4}-[0-9]{2}-[0-9]{2}", 90), ("mail", r"[A-Za-z0-9._]+@[A-Za-z0-9.]+", 80), ("number", r"[0-9]{6,}", 60))


@query("str07_entity_finders", "SELECT doc_id, kind, value, confidence, count(*) AS n FROM (" + " UNION ALL ".join(f"SELECT doc_id, '{k}' AS kind, unnest(regexp_extract_all(text, '{r}')) AS value, {c} AS confidence FROM documents" for k, r, c in FINDERS) + ") GROUP BY ALL")
def str07(spark: SparkSession, sf: str) -> DataFrame:
    def finder(kind: str, pattern: str, confidence: int) -> Column:
        return F.transform(F.regexp_extract_all("text", F.lit(pattern), F.lit(0)), lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("value"), F.lit(confidence).alias("confidence")))

    found = F.flatten(F.array(*[finder(*f) for f in FINDERS]))
    return docs(spark, sf).select("doc_id", F.explode(found).alias("f")).groupBy("doc_id", "f.kind", "f.value", "f.confidence").agg(F.count("*").alias("n"))


CLASSES = (("legal", "licen[sc]e|copyright"), ("credential", "password|secret|token"), ("contact", "@|http"), ("shout", "!!"))


@query("str08_keyword_class", "SELECT doc_id, CASE " + " ".join(f"WHEN regexp_matches(lower(text), '{r}') THEN '{k}'" for k, r in CLASSES) + " ELSE 'other' END AS class FROM documents")
def str08(spark: SparkSession, sf: str) -> DataFrame:
    out = None
    for k, r in CLASSES:
        hit = F.lower("text").rlike(r)
        out = F.when(hit, k) if out is None else out.when(hit, k)
    return docs(spark, sf).select("doc_id", out.otherwise("other").alias("class"))


REGIONS = (("north", ("der", "und")), ("south", ("los", "una")), ("west", ("les", "est")), ("isles", ("the", "with")))


@query("str09_keyword_regions", "SELECT doc_id, concat_ws(',', " + ", ".join("CASE WHEN " + " OR ".join(f"contains(lower(text), ' {w} ')" for w in words) + f" THEN '{r}' END" for r, words in REGIONS) + ") AS regions FROM documents")
def str09(spark: SparkSession, sf: str) -> DataFrame:
    low = F.lower("text")
    hits = [F.when(F.greatest(*[low.contains(f" {w} ") for w in words]), r) for r, words in REGIONS]
    return docs(spark, sf).select("doc_id", F.concat_ws(",", *hits).alias("regions"))


def replace_spans(text: str, spans: list[tuple[int, int, str]]) -> str:
    """Replaces spans from right to left, so that earlier offsets stay valid."""
    for start, stop, value in sorted(spans, reverse=True):
        text = text[:start] + value + text[stop:]
    return text


TERMS = {"the": "<T1>", "with": "<T2>", "and": "<T3>"}


@query("str10_term_replacement", r"SELECT item_id, regexp_replace(regexp_replace(regexp_replace(text, '\bthe\b', '<T1>', 'g'), '\bwith\b', '<T2>', 'g'), '\band\b', '<T3>', 'g') AS text FROM benchmark")
def str10(spark: SparkSession, sf: str) -> DataFrame:
    pattern = re.compile(r"\b(the|with|and)\b", re.A)

    @F.pandas_udf("string")
    def swapped(values: pd.Series) -> pd.Series:
        return values.map(lambda v: v and replace_spans(v, [(m.start(), m.end(), TERMS[m[0]]) for m in pattern.finditer(v)]))

    return table(spark, sf, "benchmark").select("item_id", swapped("text").alias("text"))


def normal_offsets(text: str) -> tuple[str, list[int], list[int]]:
    """The text in NFKC, and for each of its characters where the piece of the original that it comes from starts and stops.

    A piece is a character with what may combine with it: marks, the vowels and finals of Hangul, and half-width voice marks, which
    only become marks by normalisation. Pieces are normalised alone, and their results are the whole text's NFKC; starts and
    stops never fall. Where pieces give another text (none is known), the whole text is one piece.
    """
    if text.isascii():
        return text, list(range(len(text))), list(range(1, len(text) + 1))
    normal = unicodedata.normalize("NFKC", text)
    cuts = [i for i, c in enumerate(text) if i == 0 or not _joins(c)] + [len(text)]
    out, starts, stops = [], [], []
    for a, b in zip(cuts, cuts[1:], strict=False):
        piece = unicodedata.normalize("NFKC", text[a:b])
        out.append(piece)
        starts += [a] * len(piece)
        stops += [b] * len(piece)
    if "".join(out) != normal:
        return normal, [0] * len(normal), [len(text)] * len(normal)
    return normal, starts, stops


def _joins(c: str) -> bool:
    """Whether a character can become one with what stands before it."""
    if c < "\u0300":
        return False
    first = unicodedata.normalize("NFKD", c)[0]
    return unicodedata.combining(first) != 0 or "\u1161" <= first <= "\u1175" or "\u11a8" <= first <= "\u11c2" or unicodedata.category(first) == "Mc"


def replace_normalised(text: str, pattern: re.Pattern, values: dict[str, str]) -> str:
    """Replaces what the pattern finds in the case-folded NFKC text, in the text as it was written.

    Characters whose folded form is longer keep their own form, so that offsets hold. A match that ends within a piece takes the whole piece.
    """
    normal, starts, stops = normal_offsets(text)
    folded = "".join(f if len(f := c.casefold()) == 1 else c for c in normal)
    spans, end = [], 0
    for m in pattern.finditer(folded):
        if m.end() > m.start() and starts[m.start()] >= end:
            end = stops[m.end() - 1]
            spans.append((starts[m.start()], end, values[m[0]]))
    parts, at = [], 0
    for start, stop, value in spans:
        parts += [text[at:start], value]
        at = stop
    return "".join([*parts, text[at:]])


@query("str10_normalised_replacement")
def str10_normalised(spark: SparkSession, sf: str) -> DataFrame:
    """Terms replaced however they are written: full-width, composed or in other case; all else stays as it was."""
    pattern = re.compile(r"\b(the|with|and|für|été)\b")
    values = TERMS | {"für": "<T4>", "été": "<T5>"}

    @F.pandas_udf("string")
    def swapped(texts: pd.Series) -> pd.Series:
        return texts.map(lambda v: v and replace_normalised(v, pattern, values))

    return docs(spark, sf).select("doc_id", swapped("text").alias("text"))


@query("str11_protect_restore", "SELECT doc_id, text AS restored, len(regexp_extract_all(text, '[0-9]+')) AS n_protected FROM documents")
def str11(spark: SparkSession, sf: str) -> DataFrame:
    """Numbers become placeholders in order and come back: parts between and parts protected, zipped again."""
    gaps, kept = F.split("text", "[0-9]+", -1), F.regexp_extract_all("text", F.lit("[0-9]+"), F.lit(0))
    protected = F.transform(kept, lambda v, i: F.concat(F.lit("⟦"), i.cast("string"), F.lit("⟧")))
    masked = F.array_join(F.zip_with(gaps, F.concat(protected, F.array(F.lit(""))), lambda a, b: F.concat(a, b)), "")
    again = F.zip_with(F.split("masked", "⟦[0-9]+⟧", -1), F.concat("kept", F.array(F.lit(""))), lambda a, b: F.concat(a, b))
    return docs(spark, sf).select("doc_id", masked.alias("masked"), kept.alias("kept")).select("doc_id", F.array_join(again, "").alias("restored"), F.size("kept").cast("long").alias("n_protected"))


# English number words, scales, months and currencies.
NUMBER_WORDS = dict(zip("zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split(), range(20)))
TENS = dict(zip("twenty thirty forty fifty sixty seventy eighty ninety".split(), range(20, 100, 10)))
SCALES = {"hundred": 100, "thousand": 1_000, "million": 10**6, "billion": 10**9, "trillion": 10**12, "dozen": 12, "万": 10**4, "億": 10**8, "亿": 10**8}
MONTHS = {m: k for k, m in enumerate("january february march april may june july august september october november december".split(), 1)} | {m: k for k, m in enumerate("jan feb mar apr may jun jul aug sep oct nov dec".split(), 1)}
CURRENCIES = {"$": "USD", "€": "EUR", "£": "GBP", "¥": "JPY", "円": "JPY", "usd": "USD", "eur": "EUR", "gbp": "GBP", "jpy": "JPY", "dollars": "USD", "euros": "EUR", "pounds": "GBP", "yen": "JPY"}
PARTS = {"half": 2, "halves": 2, "third": 3, "thirds": 3, "quarter": 4, "quarters": 4, "fifth": 5, "fifths": 5, "sixth": 6, "sixths": 6, "eighth": 8, "eighths": 8, "tenth": 10, "tenths": 10}
_WORDS = "|".join([*NUMBER_WORDS, *TENS])
_PARTS = "|".join(sorted(PARTS, key=len, reverse=True))
_SCALE = "|".join(SCALES)
QUANTITY = re.compile(
    rf"(?P<clock>\b(?:[01]?\d|2[0-3]):[0-5]\d\b(?:\s*[ap]m\b)?)"
    rf"|(?P<cjk_month>\b(?:1[0-2]|[1-9])月)"
    rf"|(?P<slashed>(?:\b\d+\s+)?\d+⁄\d+)"
    rf"|\b(?:(?P<whole>{_WORDS})\s+and\s+)?(?P<share>a|{_WORDS})[\s-]+(?P<part>{_PARTS})\b"
    rf"|(?:(?P<minus>(?<![\w.,%)])[-−+](?=[\d$€£¥])|\b(?:minus|negative)\s)\s*)?(?:(?P<sign>[$€£¥])\s*)?(?P<digits>\d+(?:,\d{{3}})+(?:\.\d+)?|\d+(?:\.\d+)?)\s*(?P<percent>%)?(?P<scale>(?:\s*(?:{_SCALE})\b|[万億亿])*)\s*(?P<unit>円|\b(?:usd|eur|gbp|jpy|dollars|euros|pounds|yen)\b)?"
    rf"|\b(?:(?P<negative>minus|negative)\s+)?(?P<words>(?:{_WORDS}|dozen)(?:[\s-]+(?:{_WORDS}|hundred|thousand|million|billion|trillion|dozen|and(?=[\s-]+(?:{_WORDS}))))*)\b(?:\s+(?P<word_unit>usd|eur|gbp|jpy|dollars|euros|pounds|yen)\b)?"
    rf"|\b(?P<month>{'|'.join(sorted(MONTHS, key=len, reverse=True))})\.?(?=\s+\d)"
)


def spelled(words: list[str]) -> int:
    """The value of spelled-out number words."""
    total = part = 0
    for w in words:
        if w in NUMBER_WORDS or w in TENS:
            part += NUMBER_WORDS.get(w, TENS.get(w, 0))
        elif w == "hundred":
            part = max(1, part) * 100
        elif w in SCALES:
            total, part = total + max(1, part) * SCALES[w], 0
    return total + part


def quantities(text: str | None) -> list[str]:
    """Canonical tokens of a text's quantities: numbers with scales, money, clock times, months and percentages.

    Full-width forms are folded, thousands separators dropped; equal quantities give equal tokens however they are written.
    Signs count where no word or number stands before them. A fraction is a number where decimals can write it, else `fraction:n/d`.
    """
    out = []
    apart = re.sub(r"(?<=\d)(?=[¼½¾⅐-⅞])", " ", text or "")  # NFKC would join 2½ to 21⁄2
    for m in QUANTITY.finditer(unicodedata.normalize("NFKC", apart).lower()):
        g = m.groupdict()
        if g["clock"]:
            hour, minute = (int(x) for x in re.findall(r"\d+", g["clock"]))
            if g["clock"].endswith("m") and 1 <= hour <= 12:
                hour = hour % 12 + (12 if g["clock"].endswith("pm") else 0)
            out.append(f"clock:{hour:02}:{minute:02}")
        elif g["cjk_month"]:
            out.append(f"month:{int(g['cjk_month'][:-1])}")
        elif g["month"]:
            out.append(f"month:{MONTHS[g['month']]}")
        elif g["slashed"] or g["part"]:
            out += _fraction(g)
        else:
            value = Decimal(spelled(re.split(r"[\s-]+", g["words"]))) if g["words"] else Decimal(g["digits"].replace(",", ""))
            for scale in re.findall(_SCALE, g["scale"] or ""):
                value *= SCALES[scale]
            if g["negative"] or (g["minus"] or "+") != "+":
                value = -value
            money = CURRENCIES.get(g["sign"] or g["unit"] or g["word_unit"] or "")
            kind = f"money:{money}" if money else "percent" if g["percent"] else "number"
            out.append(f"{kind}:{value.normalize():f}")
    return out


def _fraction(g: dict[str, str | None]) -> list[str]:
    if g["slashed"]:
        *whole, ratio = g["slashed"].split()
        top, bottom = (int(x) for x in ratio.split("⁄"))
        if not bottom:
            return [f"number:{w}" for w in (*whole, str(top), "0")]
        value = Fraction(top, bottom) + (int(whole[0]) if whole else 0)
    else:
        value = Fraction(1 if g["share"] == "a" else spelled([g["share"]]), PARTS[g["part"]]) + (spelled([g["whole"]]) if g["whole"] else 0)
    rest = value.denominator
    for prime in (2, 5):
        while rest % prime == 0:
            rest //= prime
    if rest > 1:
        return [f"fraction:{value.numerator}/{value.denominator}"]
    return [f"number:{(Decimal(value.numerator) / Decimal(value.denominator)).normalize():f}"]


@query("str12_number_multiset")
def str12(spark: SparkSession, sf: str) -> DataFrame:
    """Multisets of canonical quantities, as equivalence checks compare them."""

    @F.pandas_udf("array<string>")
    def found(values: pd.Series) -> pd.Series:
        return values.map(quantities)

    # most texts have no quantity: what can't hold one doesn't go to Python; letters of compatibility forms may spell one
    maybe = F.col("text").rlike(rf"(?i)[\p{{Nd}}\p{{No}}\x{{FF21}}-\x{{FF5A}}\x{{2100}}-\x{{214F}}\x{{24B6}}-\x{{24E9}}\x{{1D400}}-\x{{1D7CB}}]|\b({_WORDS}|dozen|a[\s-]+({_PARTS}))\b")
    t = docs(spark, sf).filter(maybe).select("doc_id", F.explode(found("text")).alias("token"))
    return t.groupBy("doc_id", "token").agg(F.count("*").alias("n"))


@query("str13_lost_numbers", """SELECT a.conv_id, a.turn, len(list_filter(list_distinct(regexp_extract_all(a.text, '[0-9]{2,}')), lambda v: NOT contains(b.text, v))) AS n_numbers, len(list_filter(list_distinct(regexp_extract_all(a.text, '"([^"]{2,})"', 1)), lambda v: NOT contains(b.text, v))) AS n_quotes FROM conversations a JOIN conversations b ON b.conv_id = a.conv_id AND b.turn = a.turn + 1""")
def str13(spark: SparkSession, sf: str) -> DataFrame:
    """Numbers and quoted fragments of a turn that the next one doesn't keep."""
    c = table(spark, sf, "conversations")
    after = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("reply"))
    lost = lambda pattern, group: F.size(F.filter(F.array_distinct(F.regexp_extract_all("text", F.lit(pattern), F.lit(group))), lambda v: ~F.col("reply").contains(v))).cast("long")
    return c.join(after, ["conv_id", "turn"]).select("conv_id", "turn", lost("[0-9]{2,}", 0).alias("n_numbers"), lost('"([^"]{2,})"', 1).alias("n_quotes"))


@query("str14_lengths", "SELECT doc_id, length(text) AS chars, strlen(text) AS octets, length(trim(text)) = 0 AS blank FROM documents")
def str14(spark: SparkSession, sf: str) -> DataFrame:
    return docs(spark, sf).select("doc_id", F.length("text").cast("long").alias("chars"), F.octet_length("text").cast("long").alias("octets"), (F.length(F.trim("text")) == 0).alias("blank"))


def _ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else difflib.SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b, strict=True)])


def sequence_ratio(a: str | Column, b: str | Column) -> Column:
    """Ratcliff-Obershelp similarity, which Levenshtein distance doesn't give."""
    return F.pandas_udf(_ratio, "double")(a, b)


@query("str15_sequence_ratio")
def str15(spark: SparkSession, sf: str) -> DataFrame:
    b = table(spark, sf, "benchmark")
    after = b.select((F.col("item_id") - 1).alias("item_id"), F.col("text").alias("other"))
    return b.join(after, "item_id").select("item_id", F.round(sequence_ratio("text", "other"), 6).alias("ratio"))


@query("str16_series_identity", r"SELECT s_suppkey, trim(regexp_replace(regexp_replace(lower(translate(s_name, 'ÁÉÍÓÚáéíóú', 'AEIOUaeiou')), '(stakes|cup|#0*)', ' ', 'g'), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM supplier")
def str16(spark: SparkSession, sf: str) -> DataFrame:
    plain = F.regexp_replace(F.lower(F.translate("s_name", "ÁÉÍÓÚáéíóú", "AEIOUaeiou")), "(stakes|cup|#0*)", " ")
    return table(spark, sf, "supplier").select("s_suppkey", F.trim(F.regexp_replace(plain, "[^a-z0-9]+", "-"), F.lit("-")).alias("slug"))


@query("str17_canonical_url", r"SELECT page_id, regexp_replace(regexp_replace(lower(regexp_extract(url, '^[^/]*//[^/?#]*')), '//[^@/]*@', '//'), ':80$', '') || regexp_extract(url, '^[^/]*//[^/?#]*([^?#]*)', 1) AS url FROM pages")
def str17(spark: SparkSession, sf: str) -> DataFrame:
    """Scheme and host lower-cased, user and default port gone, query and fragment dropped."""
    head = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract("url", "^[^/]*//[^/?#]*", 0)), "//[^@/]*@", "//"), ":80$", "")
    return table(spark, sf, "pages").select("page_id", F.concat(head, F.regexp_extract("url", "^[^/]*//[^/?#]*([^?#]*)", 1)).alias("url"))


def _blocks(page: str) -> list[str]:
    from html.parser import HTMLParser

    class Reader(HTMLParser):
        def __init__(self):
            super().__init__()
            self.out, self.held, self.hidden = [], [], 0

        def cut(self):
            line = " ".join("".join(self.held).split())
            self.held.clear()
            if line:
                self.out.append(line)

        def handle_starttag(self, tag, attrs):
            if tag in ("script", "style"):
                self.hidden += 1
            elif tag in ("p", "div", "h1", "h2", "h3", "li", "tr", "br", "article", "section", "footer", "nav", "title"):
                self.cut()

        def handle_endtag(self, tag):
            if tag in ("script", "style"):
                self.hidden = max(0, self.hidden - 1)
            elif tag in ("p", "div", "h1", "h2", "h3", "li", "tr", "article", "section", "footer", "nav", "title"):
                self.cut()

        def handle_data(self, data):
            if not self.hidden:
                self.held.append(data)

    reader = Reader()
    reader.feed(page or "")
    reader.close()
    reader.cut()
    return reader.out


def _all_blocks(pages: pd.Series) -> pd.Series:
    return pages.map(_blocks)


def html_blocks(c: str | Column) -> Column:
    """Text of block elements, scripts and styles left out."""
    return F.pandas_udf(_all_blocks, "array<string>")(c)


@query("str18_html_blocks")
def str18(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", F.posexplode(html_blocks("html")).alias("pos", "block"))


@query("str20_paragraph_rules", "WITH p AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents), k AS (SELECT *, pos = 1 AND length(line) < 60 AS lead, contains(line, 'http') AND NOT contains(line, ' ') AS url FROM p) SELECT doc_id, count(*) FILTER (WHERE lead) AS dropped_lead, count(*) FILTER (WHERE url AND NOT lead) AS dropped_url, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT lead AND NOT url), '') AS text FROM k GROUP BY 1")
def str20(spark: SparkSession, sf: str) -> DataFrame:
    """Paragraph rules in place, without exploding: short first lines and bare links go, counted by rule."""
    lines = F.transform(F.split("text", "\n", -1), lambda v, i: F.struct(v.alias("line"), ((i == 0) & (F.length(v) < 60)).alias("lead"), (v.contains("http") & ~v.contains(" ")).alias("url")))
    d = docs(spark, sf).select("doc_id", lines.alias("p"))
    n = lambda f: F.size(F.filter("p", f)).cast("long")
    return d.select("doc_id", n(lambda x: x["lead"]).alias("dropped_lead"), n(lambda x: x["url"] & ~x["lead"]).alias("dropped_url"), F.array_join(F.transform(F.filter("p", lambda x: ~x["lead"] & ~x["url"]), lambda x: x["line"]), "\n").alias("text"))


UNIT = "array<struct<start:int,stop:int,context_start:int,context_stop:int>>"


def units(text: str, size: int = 640, around: int = 160) -> list[dict]:
    """Cut at the first sentence end once a unit has `size` characters; each carries its surroundings."""
    out, start, n = [], 0, len(text)
    while start < n:
        stop = n
        for i in range(min(n, start + size), n):
            if text[i - 1] in ".!?。！？\n":
                stop = i
                break
        out.append({"start": start, "stop": stop, "context_start": max(0, start - around), "context_stop": min(n, stop + around)})
        start = stop
    return out


@query("str21_units")
def str21(spark: SparkSession, sf: str) -> DataFrame:
    return docs(spark, sf).select("doc_id", F.posexplode(F.pandas_udf(_all_units, UNIT)("text")).alias("unit", "u")).select("doc_id", "unit", "u.*")


def _all_units(values: pd.Series) -> pd.Series:
    return values.map(lambda v: units(v or ""))


@query("str22_unique_span", "SELECT doc_id, instr(text, 'token') - 1 AS start FROM documents WHERE length(text) - length(replace(text, 'token', '')) = 5")
def str22(spark: SparkSession, sf: str) -> DataFrame:
    """Where a quote stands, if it stands there exactly once."""
    once = F.length("text") - F.length(F.replace("text", F.lit("token"), F.lit(""))) == 5
    return docs(spark, sf).filter(once).select("doc_id", (F.instr("text", "token") - 1).cast("long").alias("start"))


@query("str23_broken_text", "SELECT doc_id, CASE WHEN length(text) < 80 THEN 'too_short' WHEN length(text) - length(replace(text, chr(65533), '')) > 5 THEN 'mojibake' WHEN length(text) < 240 AND contains(lower(text), 'free') THEN 'advert' ELSE 'ok' END AS verdict FROM documents")
def str23(spark: SparkSession, sf: str) -> DataFrame:
    broken = F.length("text") - F.length(F.replace("text", F.lit("�"), F.lit("")))
    return docs(spark, sf).select("doc_id", F.when(F.length("text") < 80, "too_short").when(broken > 5, "mojibake").when((F.length("text") < 240) & F.lower("text").contains("free"), "advert").otherwise("ok").alias("verdict"))


@query("str24_masking", r"SELECT doc_id, regexp_replace(regexp_replace(text, '[A-Za-z0-9._]+@[A-Za-z0-9.]+', '[mail]', 'g'), '(token|secret|password) = \S+', '\1 = [hidden]', 'g') AS text FROM documents")
def str24(spark: SparkSession, sf: str) -> DataFrame:
    return docs(spark, sf).select("doc_id", F.regexp_replace(F.regexp_replace("text", "[A-Za-z0-9._]+@[A-Za-z0-9.]+", "[mail]"), r"(token|secret|password) = \S+", "$1 = [hidden]").alias("text"))
