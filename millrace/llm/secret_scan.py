"""Secret scan with an incremental blob ledger, DataFrame operations only.

Every historical version of every path is addressed by its content (sha256). The ledger lists the
(blob, rule version) pairs already scanned together with their findings; a run scans only pairs that
the ledger doesn't hold, and joins findings back to all paths that ever had the blob. A rule whose
pattern changes gets another rule version and is scanned again; unchanged rules are not.

`Ledger` stores those rows below a path: update() scans what is new and appends it in one commit, so that a run
that fails leaves the ledger as it was and a later run finds all that earlier ones have scanned.

Copies: blobs are reduced map-side before their text is shuffled, so a blob that a third of all rows
share travels once a task. The join back is salted, so that such a blob's paths don't meet in one task.

Edge cases: null text counts as empty; a row without findings keeps zero counts and empty span strings;
repeated rows each get their findings; extra columns are ignored. Texts are scanned whole, and no rule reads a
character more than a few times, however long the text and whatever it repeats.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Workspace, read_table

#: Tasks that the paths of one blob are dealt to.
SALTS = 32


@dataclass(frozen=True)
class Rule:
    """Leftmost non-overlapping matches of `pattern` whose `group` has `at_least` characters.

    The place of the kind in the rule list orders spans that start together; base rules feed the digest columns.
    """

    kind: str
    pattern: str
    group: int
    at_least: int
    base: bool = True

    @property
    def version(self) -> str:
        return f"{self.kind}/{self.pattern}/{self.group}/{self.at_least}"


# The patterns that the task states.
BASE_RULES = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]{16,}", 0, 20),
    Rule("hex", r"[0-9a-f]{24,}", 0, 24),
)
#: Further public credential formats, added to the base spans.
MORE_RULES = (
    Rule("pem", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----", 0, 0, base=False),
    # starts where a word starts and gives nothing back: a text is read once, whatever it repeats
    Rule("jwt", r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}+\.eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+", 0, 0, base=False),
)
SPAN = "array<struct<start:int,kind:string,stop:int>>"
#: Numbers that running sums are folded over at a time.
RUN = 128


def running(numbers: Column) -> Column:
    """Running sums of an array: within runs of RUN numbers, then over the runs, so that no array grows by one number a step."""
    none = F.array().cast("array<int>")

    def sums(values: Column) -> Column:
        start = F.struct(F.lit(0).alias("sum"), none.alias("list"))
        step = lambda acc, x: F.struct((acc["sum"] + x).alias("sum"), F.concat(acc["list"], F.array(acc["sum"] + x)).alias("list"))
        return F.aggregate(values, start, step, lambda acc: acc["list"])

    def shifted(runs: Column) -> Column:
        ends = F.transform(runs, F.array_max)  # no number is below 0: the largest sum is the last
        before = F.zip_with(sums(ends), ends, lambda through, own: through - own)
        return F.flatten(F.zip_with(runs, before, lambda run, b: F.transform(run, lambda v: v + b)))

    def of(a: Column) -> Column:
        return F.when(F.size(a) <= RUN, sums(a)).otherwise(long(a))

    def long(a: Column) -> Column:
        runs = F.transform(F.sequence(F.lit(0), F.floor((F.size(a) - 1) / RUN).cast("int")), lambda i: sums(F.slice(a, i * RUN + 1, RUN)))
        return bound(runs, shifted)

    # a lambda's parameter is computed once, an expression inside a lambda once an element
    bound = lambda value, then: F.element_at(F.transform(F.array(value), then), 1)
    return F.when(F.size(numbers) == 0, none).otherwise(bound(numbers, of))


def spans(text: Column, rule: Rule) -> Column:
    """The rule's spans in code points, end exclusive.

    `split` and `regexp_extract_all` walk the same matches, so the gaps that split leaves and the matches
    give each start; neither is computed for a text without a match.
    """
    pattern = F.lit(rule.pattern)
    gaps = F.transform(F.split(text, rule.pattern, -1), lambda g: F.length(g))
    whole = F.transform(F.regexp_extract_all(text, pattern, F.lit(0)), lambda m: F.length(m))
    kept = F.transform(F.regexp_extract_all(text, pattern, F.lit(rule.group)), lambda m: F.length(m)) if rule.group else whole
    # the last gap has no match after it
    steps = F.zip_with(gaps, whole, lambda gap, size: gap + F.coalesce(size, F.lit(0)))
    zipped = F.arrays_zip(running(steps).alias("stop"), whole.alias("size"), kept.alias("kept"))
    held = F.filter(zipped, lambda m: F.coalesce(m["kept"] >= rule.at_least, F.lit(False)))
    found = F.transform(held, lambda m: F.struct((m["stop"] - m["size"]).alias("start"), F.lit(rule.kind).alias("kind"), m["stop"].alias("stop")))
    return F.when(F.regexp_like(text, pattern), found).otherwise(F.array().cast(SPAN))


def address(versions: DataFrame, text: str = "text") -> DataFrame:
    """versions with `blob`, the sha256 of the text (null: of the empty text)."""
    return versions.withColumn("blob", F.sha2(F.coalesce(F.col(text), F.lit("")), 256))


def scan_blobs(versions: DataFrame, ledger: DataFrame | None, rules: tuple[Rule, ...], text: str = "text") -> DataFrame:
    """Ledger rows (blob, rule, found) of the pairs that `ledger` doesn't hold yet.

    versions: any columns with `text`. One row a blob and rule, also where nothing was found: it has been scanned.
    """
    blobs = address(versions, text).select("blob", F.coalesce(F.col(text), F.lit("")).alias("text")).groupBy("blob").agg(F.first("text").alias("text"))
    if ledger is not None:
        done = ledger.groupBy("blob").agg(F.collect_set("rule").alias("done"))  # at most one element a rule version
        blobs = blobs.join(done, "blob", "left").withColumn("done", F.coalesce("done", F.array().cast("array<string>")))
        blobs = blobs.filter(~F.forall(F.array(*[F.lit(r.version) for r in rules]), lambda v: F.array_contains(F.col("done"), v)))
    columns = []
    for k, rule in enumerate(rules):
        found = spans(F.col("text"), rule)
        columns.append((found if ledger is None else F.when(~F.array_contains("done", rule.version), found)).alias(f"f{k}"))
    scanned = blobs.select("blob", *columns)
    pairs = F.explode(F.array(*[F.struct(F.lit(r.version).alias("rule"), F.col(f"f{k}").alias("found")) for k, r in enumerate(rules)]))
    return scanned.select("blob", pairs.alias("p")).select("blob", "p.rule", "p.found").filter("found is not null")


class Ledger:
    """The stored ledger: rows (blob, rule, found) below a path that the driver and all executors reach."""

    SCHEMA = f"blob string, rule string, found {SPAN}"

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def rows(self) -> DataFrame | None:
        """What has been committed, or None for a new ledger."""
        target = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        if not target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(target):
            return None
        return self.spark.read.schema(self.SCHEMA).parquet(self.path)

    def update(self, versions: DataFrame, rules: tuple[Rule, ...], text: str = "text") -> DataFrame:
        """Scans the pairs that the ledger lacks, commits them and returns the ledger."""
        scan_blobs(versions, self.rows(), rules, text).write.mode("append").parquet(self.path)
        return self.rows()


def findings_by_path(versions: DataFrame, ledger: DataFrame, rules: tuple[Rule, ...], keys: list[str], text: str = "text") -> DataFrame:
    """keys, blob and `found` (all spans of the rules, by start and then kind) of every version."""
    wanted = ledger.filter(F.col("rule").isin([r.version for r in rules]) & (F.size("found") > 0))
    # the order of kinds is that of the rules asked for now, not of those that some run scanned with
    ranked = F.transform("found", lambda s: F.struct(s["start"], F.array_position(F.array(*[F.lit(r.kind) for r in rules]), s["kind"]).alias("rank"), s["kind"], s["stop"]))
    by_blob = wanted.select("blob", ranked.alias("found")).groupBy("blob").agg(F.array_sort(F.flatten(F.collect_list("found"))).alias("found"))  # one row a rule at most
    by_blob = by_blob.withColumn("found", F.transform("found", lambda s: F.struct(s["start"], s["kind"], s["stop"])))
    # salted: paths of one blob, however many, are dealt to SALTS tasks; only blobs with findings are repeated
    salt = F.pmod(F.xxhash64(*keys), F.lit(SALTS))
    by_blob = by_blob.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    paths = address(versions, text).select(*keys, "blob").withColumn("salt", salt)
    # a join by shuffle at every size: findings repeated by salt are larger than Spark guesses before it broadcasts them
    return paths.join(by_blob.hint("merge"), ["blob", "salt"], "left").drop("salt").withColumn("found", F.coalesce("found", F.array().cast(SPAN)))


def written(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = BASE_RULES + MORE_RULES
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    ledger = Ledger(spark, Workspace(spark, "secrets").path("ledger"))
    found = findings_by_path(docs, ledger.update(docs, rules), rules, ["doc_id"])
    base = F.filter("found", lambda s: s["kind"].isin([r.kind for r in BASE_RULES]))
    count = lambda kind: F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long")
    return found.select("doc_id", *[count(r.kind).alias(f"n_{r.kind}") for r in BASE_RULES], F.sha2(written(base), 256).alias("base_sha256"), written(F.col("found")).alias("spans"))
