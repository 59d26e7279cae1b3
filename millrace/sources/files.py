"""Sources and sinks (SRC): explicit schemas, broken rows kept apart, atomic writes with a manifest."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.plans.catalog import query, table


def scratch(spark: SparkSession) -> str:
    """A new folder that driver and executors share."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return f"{shared.rstrip('/')}/files-{uuid.uuid4().hex}"
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return "file://" + tempfile.mkdtemp(prefix="millrace-files-")


@query("src01_page_drafts", "SELECT page_id, regexp_extract(url, '^[^/]*//([^/?#]*)', 1) AS site, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, regexp_extract(html, '<html lang=.([a-z]+).>', 1) AS lang FROM pages")
def src01(spark: SparkSession, sf: str) -> DataFrame:
    """Landed pages to canonical drafts."""
    return table(spark, sf, "pages").select("page_id", F.regexp_extract("url", "^[^/]*//([^/?#]*)", 1).alias("site"), F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), F.regexp_extract("html", "<html lang=.([a-z]+).>", 1).alias("lang"))


@query("src02_relative_time", "SELECT event_id, TIMESTAMP '2024-01-30 12:00:00' - to_minutes((event_id % 50)::INT) AS at FROM events")
def src02(spark: SparkSession, sf: str) -> DataFrame:
    """`n minutes ago` against a given clock."""
    said = F.concat((F.col("event_id") % 50).cast("string"), F.lit(" minutes ago"))
    n = F.regexp_extract(said, "([0-9]+) minutes ago", 1).cast("int")
    return table(spark, sf, "events").withColumn("n", n).select("event_id", F.expr("timestampadd(MINUTE, -n, TIMESTAMP_NTZ '2024-01-30 12:00:00')").alias("at"))


@query("src03_year_inference", "SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day FROM orders")
def src03(spark: SparkSession, sf: str) -> DataFrame:
    """A heading with month and day gets its year from the url."""
    o = table(spark, sf, "orders").select("o_orderkey", F.date_format("o_orderdate", "MM/dd").alias("heading"), F.concat(F.lit("https://example.com/news/"), F.year("o_orderdate").cast("string"), F.lit("/x")).alias("url"))
    return o.select("o_orderkey", F.make_date(F.regexp_extract("url", "/([0-9]{4})/", 1).cast("int"), F.split("heading", "/")[0].cast("int"), F.split("heading", "/")[1].cast("int")).alias("day"))


@query("src04_listing_links", "SELECT page_id, pos, link FROM (SELECT page_id, unnest(regexp_extract_all(html, 'href=.(/[^>]*).>', 1)) AS link, generate_subscripts(regexp_extract_all(html, 'href=.(/[^>]*).>', 1), 1) - 1 AS pos FROM pages) WHERE link <> '/the'")
def src04(spark: SparkSession, sf: str) -> DataFrame:
    """Links of a listing page with their rank, and a topic allow-list."""
    links = F.regexp_extract_all("html", F.lit("href=.(/[^>]*).>"), F.lit(1))
    return table(spark, sf, "pages").select("page_id", F.posexplode(links).alias("pos", "link")).filter("link <> '/the'").withColumn("pos", F.col("pos").cast("long"))


@query("src05_keyword_fan_out", "SELECT DISTINCT conv_id, turn FROM conversations WHERE contains(text, 'the') OR contains(text, 'de ') OR contains(text, 'und')")
def src05(spark: SparkSession, sf: str) -> DataFrame:
    """One scan for all keywords; a post found by several counts once."""
    c = table(spark, sf, "conversations")
    return c.filter(F.greatest(*[F.col("text").contains(k) for k in ("the", "de ", "und")])).select("conv_id", "turn").distinct()


@query("src07_observation_struct", "SELECT l_orderkey, count(*) AS runners, sha256(string_agg(l_linenumber || '-' || l_partkey, ',' ORDER BY l_linenumber, l_partkey)) AS digest FROM lineitem GROUP BY 1")
def src07(spark: SparkSession, sf: str) -> DataFrame:
    """Normalised observation: an ordered array of runner structs and its digest."""
    rows = F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey")))
    o = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(rows.alias("rows"))
    return o.select("l_orderkey", F.size("rows").cast("long").alias("runners"), F.sha2(F.array_join(F.transform("rows", lambda r: F.concat_ws("-", r["l_linenumber"].cast("string"), r["l_partkey"].cast("string"))), ","), 256).alias("digest"))


def read_json_lines(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """Good rows, and broken lines as (file, line, _bad): the file's name, the line's number from 1 and its text.

    A blank line is no row and not broken. A line's number is its place in its split, which the task knows, and the lines of
    the file's splits before, one count a split: no file is numbered by one task.
    """
    parsed = F.from_json("value", schema + ", _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    lines = spark.read.text(path).select("value", F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("place"))
    held = lines.withColumn("row", F.when(F.trim("value") != "", parsed))
    broken = held.filter("row._bad is not null").select("file", "split", "place", "value")
    splits = lines.groupBy("file", "split").agg(F.min("place").alias("first"), F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("file").orderBy("split")) - F.col("n")
    numbered = broken.join(splits.withColumn("before", before), ["file", "split"])
    bad = numbered.select("file", (F.col("before") + F.col("place") - F.col("first") + 1).alias("line"), F.col("value").alias("_bad"))
    return held.filter("row is not null and row._bad is null").select("row.*").drop("_bad"), bad


def _event_lines(spark: SparkSession, sf: str, broken: Column) -> str:
    """The events as JSON lines, those that `broken` marks cut off before their end."""
    path = scratch(spark) + "/lines"
    line = F.to_json(F.struct("event_id", "event_type", "value"))
    table(spark, sf, "events").select(F.when(broken, F.regexp_replace(line, "}$", "")).otherwise(line).alias("value")).write.text(path)
    return path


@query("src08_json_lines", "SELECT event_id, event_type, value FROM events WHERE event_type IS DISTINCT FROM 'error'")
def src08(spark: SparkSession, sf: str) -> DataFrame:
    return read_json_lines(spark, _event_lines(spark, sf, F.col("event_type") == "error"), "event_id long, event_type string, value double")[0]


@query("src08_broken_lines", "SELECT event_id, CAST(1 AS BIGINT) AS n FROM events WHERE event_type = 'error'")
def src08_broken(spark: SparkSession, sf: str) -> DataFrame:
    """Each broken line once, under a number of its own within its file."""
    bad = read_json_lines(spark, _event_lines(spark, sf, F.col("event_type") == "error"), "event_id long, event_type string, value double")[1]
    event = F.regexp_extract("_bad", '"event_id":([0-9]+)', 1).cast("long")
    return bad.groupBy(event.alias("event_id")).agg(F.count_distinct("file", "line").alias("n"))


def decode(raw: bytes) -> tuple[str, str]:
    """(charset, text): the decoding with most letters of its own script and no replacement characters."""
    best = ("utf-8", raw.decode("utf-8", "replace"), -1e9)
    for name in ("utf-8-sig", "shift_jis", "gb18030", "euc-jp", "latin-1"):
        try:
            text = raw.decode(name)
        except UnicodeDecodeError:
            continue
        score = sum(2 for c in text if "぀" <= c <= "ヿ") + sum(1 for c in text if "一" <= c <= "鿿") - 3 * sum("\x80" <= c <= "\xff" for c in text) - 5 * text.count("�") + (50 if name == "utf-8-sig" else 0)
        if score > best[2]:
            best = (name, text, score)
    return best[0], best[1]


@query("src09_charset_csv", "SELECT s_suppkey, s_suppkey::VARCHAR AS id, '競馬のニュース、東京 ' || s_name AS name FROM supplier")
def src09(spark: SparkSession, sf: str) -> DataFrame:
    """A CSV file's bytes for each supplier, in one of two charsets that the reader isn't told: decoded in Arrow batches, parsed natively."""

    @F.pandas_udf("binary")
    def written(texts: pd.Series, keys: pd.Series) -> pd.Series:
        return pd.Series([t.encode("shift_jis" if k % 2 else "utf-8-sig") for t, k in zip(texts, keys, strict=True)])

    @F.pandas_udf("string")
    def read(contents: pd.Series) -> pd.Series:
        return contents.map(lambda v: decode(bytes(v))[1])

    text = F.concat(F.lit("id,name\n"), F.col("s_suppkey").cast("string"), F.lit(",競馬のニュース、東京 "), "s_name")
    lines = table(spark, sf, "supplier").filter("s_suppkey is not null and s_name is not null").select("s_suppkey", F.explode(F.slice(F.split(read(written(text, "s_suppkey")), "\n"), 2, 1 << 30)).alias("line"))
    return lines.select("s_suppkey", F.from_csv("line", "id string, name string").alias("r")).select("s_suppkey", "r.id", "r.name")


@query("src12_table_scan", "SELECT count(*) AS n, count(DISTINCT o_custkey) AS customers FROM orders")
def src12(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").agg(F.count("*").alias("n"), F.count_distinct("o_custkey").alias("customers"))


def bounded(df: DataFrame, most: int) -> DataFrame:
    """df, written once and read again, refused if it has more than `most` rows.

    One scan: the rows are counted while they are written. A task that meets more rows than allowed fails at once, so that no
    task writes more than `most`; what several tasks have together is known at the end.
    """
    message = f"more than {most} rows"
    place = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    checked = df.filter(F.when(place >= most, F.raise_error(F.lit(message)).cast("boolean")).otherwise(F.lit(True)))
    seen, path = Observation(), f"{scratch(df.sparkSession)}/bounded"
    try:
        checked.observe(seen, F.count(F.lit(1)).alias("n")).write.parquet(path)
    except PySparkException as e:
        if message in str(e):
            raise ValueError(message) from None
        raise
    if seen.get["n"] > most:
        raise ValueError(message)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@query("src13_bounded_scan", "SELECT s_suppkey FROM supplier WHERE s_nationkey = 3")
def src13(spark: SparkSession, sf: str) -> DataFrame:
    return bounded(table(spark, sf, "supplier").filter("s_nationkey = 3").select("s_suppkey"), 100_000)


def write_with_manifest(df: DataFrame, path: str) -> DataFrame:
    """Writes JSON lines (the commit protocol makes it all or nothing) and returns sha256 and bytes of each file."""
    df.write.mode("errorifexists").json(path)
    files = df.sparkSession.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    return files.select("path", F.sha2("content", 256).alias("sha256"), F.col("length").alias("bytes"))


@query("src14_sink_manifest", "SELECT count(*) AS n_rows, 1::BIGINT AS hashed FROM nation")
def src14(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch(spark) + "/nation"
    manifest = write_with_manifest(table(spark, sf, "nation"), path)
    rows = spark.read.schema("n_nationkey int, n_name string, n_regionkey int").json(path)
    ok = manifest.agg(F.bool_and(F.length("sha256") == 64).cast("long").alias("hashed")).withColumn("one", F.lit(1))
    return rows.agg(F.count("*").alias("n_rows")).withColumn("one", F.lit(1)).join(ok, "one").select("n_rows", "hashed")


@query("src15_content_pool", "SELECT sha256(text) AS sha, min(doc_id) AS first_id, count(*) AS n FROM documents GROUP BY 1")
def src15(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").groupBy(F.sha2("text", 256).alias("sha")).agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n"))


def upserted(target: DataFrame, batch: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """target with batch laid over it: new rows join, a blank never overwrites a value."""
    b = batch.select(F.col(key), *[F.nullif(F.col(c), F.lit("")).alias(f"__{c}") for c in columns])
    return target.join(b, key, "full_outer").select(key, *[F.coalesce(f"__{c}", c).alias(c) for c in columns])


@query("src16_upsert", "SELECT coalesce(t.c_custkey, b.k) AS c_custkey, coalesce(nullif(b.s, ''), t.c_mktsegment) AS c_mktsegment FROM (SELECT * FROM customer WHERE c_custkey % 10 < 8) t FULL JOIN (SELECT c_custkey AS k, CASE WHEN c_custkey % 3 = 0 THEN '' ELSE 'NEW' END AS s FROM customer WHERE c_custkey % 10 >= 6) b ON b.k = t.c_custkey")
def src16(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer").select("c_custkey", "c_mktsegment")
    batch = c.filter("c_custkey % 10 >= 6").withColumn("c_mktsegment", F.when(F.col("c_custkey") % 3 == 0, "").otherwise("NEW"))
    return upserted(c.filter("c_custkey % 10 < 8"), batch, "c_custkey", ["c_mktsegment"])


@query("src17_import_preview", "SELECT CASE WHEN s.k % 13 = 0 THEN 'error' WHEN p.p_partkey IS NULL THEN 'create' WHEN p.p_brand = s.b THEN 'unchanged' ELSE 'update' END AS action, count(*) AS n FROM (SELECT p_partkey + 5 AS k, p_brand AS b FROM part) s LEFT JOIN part p ON p.p_partkey = s.k GROUP BY 1")
def src17(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part").select("p_partkey", "p_brand")
    staged = p.select((F.col("p_partkey") + 5).alias("p_partkey"), F.col("p_brand").alias("b"))
    j = staged.join(p, "p_partkey", "left")
    return j.groupBy(F.when(F.col("p_partkey") % 13 == 0, "error").when(F.col("p_brand").isNull(), "create").when(F.col("p_brand") == F.col("b"), "unchanged").otherwise("update").alias("action")).agg(F.count("*").alias("n"))


@query("src18_good_and_bad_rows", "SELECT try_cast(CASE WHEN event_id % 9 = 0 THEN 'x' ELSE event_id::VARCHAR END AS BIGINT) IS NOT NULL AS good, count(*) AS n FROM events GROUP BY 1")
def src18(spark: SparkSession, sf: str) -> DataFrame:
    raw = F.when(F.col("event_id") % 9 == 0, "x").otherwise(F.col("event_id").cast("string"))
    return table(spark, sf, "events").groupBy(raw.try_cast(T.LongType()).isNotNull().alias("good")).agg(F.count("*").alias("n"))


@query("src19_nested_export", "SELECT o_orderkey, count(l_orderkey) AS n_lines, coalesce(min(l_linenumber), 0) AS first_line FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1")
def src19(spark: SparkSession, sf: str) -> DataFrame:
    """Parents with nested children as JSON, read back by schema."""
    kids = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey"))).alias("lines"))
    out = table(spark, sf, "orders").select("o_orderkey").join(kids, "o_orderkey", "left").select(F.to_json(F.struct("o_orderkey", "lines")).alias("j"))
    back = out.select(F.from_json("j", "o_orderkey long, lines array<struct<l_linenumber:int,l_partkey:long>>").alias("r")).select("r.*")
    return back.select("o_orderkey", F.coalesce(F.size("lines"), F.lit(0)).cast("long").alias("n_lines"), F.coalesce(F.get("lines", F.lit(0))["l_linenumber"], F.lit(0)).alias("first_line"))


def redacted(text: Column) -> Column:
    mail = F.regexp_replace(text, "[A-Za-z0-9._]+@[A-Za-z0-9.]+", "[mail]")
    return F.regexp_replace(mail, "https?://[^ ]+", "[url]")


@query("src20_redacted_export", "SELECT doc_id, substr(regexp_replace(regexp_replace(text, '[A-Za-z0-9._]+@[A-Za-z0-9.]+', '[mail]', 'g'), 'https?://[^ ]+', '[url]', 'g'), 1, 2000) AS text, strlen(text) > 2000 AS over_budget FROM documents")
def src20(spark: SparkSession, sf: str) -> DataFrame:
    """Scrubbed and cut to a budget, which is this export's feature."""
    return table(spark, sf, "documents").select("doc_id", F.substring(redacted(F.col("text")), 1, 2000).alias("text"), (F.octet_length("text") > 2000).alias("over_budget"))


SHEET = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"


def sheet_rows(content: bytes) -> list[list[str]]:
    """Cells of a workbook's first sheet, as text: a zip of XML parts, read with the standard library."""
    import io
    import zipfile
    from xml.etree import ElementTree

    with zipfile.ZipFile(io.BytesIO(content)) as z:
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = ["".join(t.text or "" for t in si.iter(SHEET + "t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iter(SHEET + "si")]
        out = []
        for row in ElementTree.fromstring(z.read("xl/worksheets/sheet1.xml")).iter(SHEET + "row"):
            cells = []
            for c in row.iter(SHEET + "c"):
                value = c.find(SHEET + "v")
                text = "".join(t.text or "" for t in c.iter(SHEET + "t")) if value is None else value.text or ""
                cells.append(shared[int(text)] if c.get("t") == "s" else text)
            out.append(cells)
        return out


def workbook(rows: list[list[str]]) -> bytes:
    """A minimal workbook with one sheet of inline strings."""
    import io
    import zipfile
    from xml.sax.saxutils import escape

    body = "".join("<row>" + "".join(f'<c t="inlineStr"><is><t>{escape(v)}</t></is></c>' for v in r) + "</row>" for r in rows)
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="{SHEET[1:-1]}"><sheetData>{body}</sheetData></worksheet>')
    return held.getvalue()


@query("src10_review_sheet", "SELECT p_partkey::VARCHAR AS key, p_name AS name FROM part WHERE p_partkey IS NOT NULL AND p_name IS NOT NULL")
def src10(spark: SparkSession, sf: str) -> DataFrame:
    """Review sheets of a thousand keys each, written by the tasks and read again; one sheet is one row, as in a binary scan."""
    cells = F.sort_array(F.collect_list(F.struct("p_partkey", "p_name")))
    keyed = table(spark, sf, "part").filter("p_partkey is not null and p_name is not null").groupBy(F.floor(F.col("p_partkey") / 1000).alias("sheet")).agg(cells.alias("cells"))

    def write(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame({"content": [workbook([["key", "name"], *[[str(c["p_partkey"]), c["p_name"]] for c in cells]]) for cells in f["cells"]]})

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for content in f["content"]:
                yield pd.DataFrame(sheet_rows(bytes(content))[1:], columns=["key", "name"])

    return keyed.select("cells").mapInPandas(write, "content binary").mapInPandas(read, "key string, name string")


def _pdf_streams(content: bytes) -> Iterator[tuple[bytes, bytes]]:
    """Dictionary and bytes of each stream, by its direct length; where that is missing or wrong, up to the next `endstream`."""
    import re

    head, end, at = re.compile(rb"(<<[^>]*(?:>(?!>)[^>]*)*>>)\s*stream\r?\n"), re.compile(rb"(?:\r\n|\r|\n)?endstream"), 0
    while m := head.search(content, at):
        size = re.search(rb"/Length\s+(\d+)\b(?!\s+\d+\s+R\b)", m[1])
        stop = m.end() + int(size[1]) if size else -1
        closed = end.match(content, stop) if size else None
        if closed is None:
            closed = end.search(content, m.end())
            if closed is None:
                return
            # a break before the word may be the last byte of deflated data, which know their own end
            stop = closed.start() if b"FlateDecode" not in m[1] else closed.end() - len(b"endstream")
        yield m[1], content[m.end() : stop]
        at = closed.end()


def pdf_text(content: bytes) -> str:
    """Text shown by the content streams of a simple PDF: literal strings of Tj and TJ, plain or deflated streams."""
    import re
    import zlib

    out = []
    for head, held in _pdf_streams(content):
        data = held
        if b"FlateDecode" in head:
            unpacked = zlib.decompressobj()
            data = unpacked.decompress(held)
            if not unpacked.eof:
                raise zlib.error("incomplete or truncated stream")
        for shown in re.finditer(rb"\[(.*?)\]\s*TJ|\(((?:\\.|[^()\\])*)\)\s*Tj", data, re.S):
            parts = [shown[2]] if shown[2] is not None else re.findall(rb"\(((?:\\.|[^()\\])*)\)", shown[1])
            out.append(re.sub(rb"\\(.)", rb"\1", b"".join(parts)).decode("latin-1"))
    return "\n".join(out)


def pdf(line: str) -> bytes:
    """A page that shows one line of Latin-1 text, in two pieces."""
    import re
    import zlib

    half = len(line) // 2
    first, second = (re.sub(rb"([\\()])", rb"\\\1", x.encode("latin-1")) for x in (line[:half], line[half:]))
    stream = zlib.compress(b"BT [(" + first + b") -20 (" + second + b")] TJ ET")
    return b"%PDF-1.4\n1 0 obj << /Filter /FlateDecode /Length " + str(len(stream)).encode() + b" >>\nstream\n" + stream + b"\nendstream endobj"


@query("src11_pdf_text", "SELECT c_custkey, c_name || ' (' || c_mktsegment || ')' AS text FROM customer")
def src11(spark: SparkSession, sf: str) -> DataFrame:
    """Text of a PDF for each customer, whose name and segment it shows."""

    @F.pandas_udf("binary")
    def shown(lines: pd.Series) -> pd.Series:
        return lines.map(lambda v: None if v is None else pdf(v))

    @F.pandas_udf("string")
    def read(contents: pd.Series) -> pd.Series:
        return contents.map(lambda v: None if v is None else pdf_text(bytes(v)))

    line = F.concat("c_name", F.lit(" ("), "c_mktsegment", F.lit(")"))
    return table(spark, sf, "customer").select("c_custkey", read(shown(line)).alias("text"))


@query("src21_delivery_ledger", "SELECT event_id, 'mail' AS channel, 'sent' AS status FROM events WHERE event_type = 'error' AND user_id % 5 = 0")
def src21(spark: SparkSession, sf: str) -> DataFrame:
    """A message sink's ledger: each micro-batch writes its own part, so that a retried batch can't send twice."""
    from millrace.streaming.replay import event_stream

    path = scratch(spark)

    def deliver(batch: DataFrame, epoch: int) -> None:
        batch.withColumn("channel", F.lit("mail")).withColumn("status", F.lit("sent")).write.mode("overwrite").parquet(f"{path}/ledger/epoch={epoch}")

    due = event_stream(spark, sf).filter("event_type = 'error' and user_id % 5 = 0").select("event_id")
    due.writeStream.foreachBatch(deliver).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("event_id long, channel string, status string").parquet(f"{path}/ledger").select("event_id", "channel", "status")
