"""Mixing sources to target weights, DataFrame operations only.

1. Sizes. A document's size is its number of words. A source's target is its weight's share of all words,
   capped at `most` times the source's size; what a cap leaves over is reshared by weight until no target
   is above its cap (solved in closed form over the sources, sorted by cap / weight).
2. Blocks. Each source's words, in a pseudorandom document order, are packed into blocks of `block` words;
   the last block of a source may be shorter.
3. Shards. The mix has n_s slots of source s, ceil(words wanted / block), and T in all, cut into output shards of
   `slots` slots. Each shard draws multinomial source counts with probabilities n_s / T: every slot draws a number
   below T from a hash. Draws of all shards miss the n_s by some square root of T; so a source's draws beyond n_s,
   which lie in its last shards, are settled: they go to the sources that were drawn too seldom.
4. Slots. The i-th slot that a source was drawn for takes its block in pass floor(i / blocks): whole passes over
   all its blocks, then a pass cut short. Within a pass, slot q takes the block that a permutation keyed by
   (source, pass) maps q to; the short block comes last in every pass. The last slot of a source may take only the
   front part of its block, so that a source takes its target, rounded to a word. Places in a shard are permuted too.
5. Slots and blocks are joined by (source, block index).

Permutations are swap-or-not networks (Hoang, Morris, Rogaway 2012): bijections of [0, n) for any n, computed
from the index alone. Everything is derived from hashes of ids and a seed: reruns agree.

Running sums don't need a source in one task: documents are dealt to cells of about CELL_ROWS documents of a source
by a hash (and shards to cells of CELL_ROWS in a row), the cells' sums are summed up, and each cell sums its own rows.
The targets, one row a source, are the only table that reaches the driver.

Edge cases: null text has size 0; documents of size 0 take 0; the null source is a source of its own and ranks
last; repeated rows are documents of their own; with no words at all every target is 0; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Workspace

WEIGHTS = (5.0, 2.0, 1.0)
MOST = 3.0
BLOCK = 128
SLOTS = 1024
CELL_ROWS = 20_000
ROUNDS = 12
#: Slots that a task makes, about.
TASK_SLOTS = 1 << 18


def n_words(text: Column) -> Column:
    """Runs of characters other than 0x20 and 0x09-0x0D; null: 0."""
    plain = F.translate(F.coalesce(text, F.lit("")), "\t\n\x0b\x0c\r", "     ")
    return F.size(F.array_remove(F.split(plain, " ", -1), "")).cast("long")


def permuted(i: Column, n: Column, *key: Column, inverse: bool = False) -> Column:
    """The place of i in a pseudorandom permutation of [0, n) keyed by `key`."""
    rounds = F.array(*[F.lit(r) for r in (reversed(range(ROUNDS)) if inverse else range(ROUNDS))])

    def step(x: Column, r: Column) -> Column:
        other = F.pmod(F.pmod(F.xxhash64(*key, r), n) - x, n)
        return F.when(F.xxhash64(*key, r, F.greatest(x, other)).bitwiseAND(1) == 1, other).otherwise(x)

    return F.aggregate(rounds, i.cast("long"), step)


def source_targets(sized: DataFrame, weights=WEIGHTS, most: float = MOST) -> DataFrame:
    """(k, source, source_size, target) of a table with source and size. One row a source, k counting them."""
    sums = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weighted = sums.withColumn("k", rank).withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("k") % len(weights) + 1).cast("int")))
    weighted = weighted.withColumn("cap", most * F.col("source_size"))
    order = Window.orderBy(F.col("cap") / F.col("weight"), "k")
    all_rows = Window.partitionBy()
    capped = F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1))
    left = F.sum("weight").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    level = (F.sum("source_size").over(all_rows) - F.coalesce(capped, F.lit(0.0))) / left
    level_found = weighted.withColumn("level", level)
    # the first source that its share doesn't lift above its cap sets the level for all that follow
    level_found = level_found.withColumn("level", F.first(F.when(F.col("cap") / F.col("weight") >= F.col("level"), F.col("level")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    return level_found.select("k", "source", "source_size", F.least(F.col("cap"), F.coalesce(F.col("level") * F.col("weight"), F.col("cap"))).alias("target"))


def same_source(a: str, b: str) -> Column:
    return F.col(f"{a}.source").eqNullSafe(F.col(f"{b}.source"))


class Mix:
    """A mix's tables: `sized` (uid, doc_id, source, size), `targets`, `pieces` and `slots`."""

    def __init__(self, docs: DataFrame, weights=WEIGHTS, most: float = MOST, block: int = BLOCK, seed: int = 0):
        """docs: doc_id, source, size and a row number `uid` that stays the same when read again."""
        spark = docs.sparkSession
        self.block, self.seed = block, seed
        self.sized = docs.select("uid", "doc_id", "source", "size")
        self.work = Workspace(spark, "mix")
        self.targets = self.work.save(source_targets(self.sized, weights, most), "targets")
        self.pieces = self._pieces()
        self.drawn, self.slots = self._slots()

    def _pieces(self) -> DataFrame:
        """(uid, doc_id, source, size, index, start, words, from_word): each document's part of each block."""
        order = F.xxhash64(F.lit(self.seed), "doc_id", "size")
        cells = self.sized.count() // CELL_ROWS + 1
        celled = self.sized.filter("size > 0").withColumn("h", order).withColumn("cell", F.pmod("h", F.lit(cells)))
        sums = celled.groupBy("source", "cell").agg(F.sum("size").alias("n"))
        before = sums.withColumn("before", F.sum("n").over(Window.partitionBy("source").orderBy("cell")) - F.col("n")).select("source", "cell", "before")
        own = F.sum("size").over(Window.partitionBy("source", "cell").orderBy("h", "doc_id", "uid")) - F.col("size")
        placed = celled.withColumn("own", own).alias("d").join(before.alias("b"), same_source("d", "b") & (F.col("d.cell") == F.col("b.cell")))
        placed = placed.select("uid", "doc_id", "d.source", "size", (F.col("own") + F.col("before")).alias("at"))
        b = self.block
        first, last = F.floor(F.col("at") / b), F.floor((F.col("at") + F.col("size") - 1) / b)
        cut = placed.withColumn("index", F.explode(F.sequence(first, last)))
        low = F.greatest(F.col("at"), F.col("index") * b)
        high = F.least(F.col("at") + F.col("size"), (F.col("index") + 1) * b)
        return cut.select("uid", "doc_id", "source", "size", "index", (low - F.col("index") * b).alias("start"), (high - low).alias("words"), (low - F.col("at")).alias("from_word"))

    def _slots(self) -> tuple[DataFrame, DataFrame]:
        """(shard, k, n, before): the multinomial draws; (shard, slot, source, copy, index, takes): slot takes the first words of a block."""
        b, spark = self.block, self.targets.sparkSession
        shape = "shard long, slot long, source string, copy long, index long, takes long"
        t = self.targets.filter("source_size > 0").withColumn("want", F.round("target").cast("long"))
        t = t.withColumn("full", F.floor(F.col("source_size") / b)).withColumn("blocks", F.ceil(F.col("source_size") / b))
        t = t.withColumn("passes", F.floor(F.col("want") / F.col("source_size"))).withColumn("rest", F.col("want") - F.col("passes") * F.col("source_size"))
        t = t.withColumn("n", F.col("passes") * F.col("blocks") + F.ceil(F.col("rest") / b)).filter("n > 0").orderBy("k")
        sources = [r.asDict() for r in t.collect()]  # one row a source
        n = [int(r["n"]) for r in sources]
        total = sum(n)
        if not total:
            return spark.createDataFrame([], "shard long, k int, n long, before long"), spark.createDataFrame([], shape)
        listed = lambda values, kind="long": F.array(*[F.lit(v) for v in values]).cast(f"array<{kind}>")
        pick = lambda values, k, kind="long": F.element_at(listed(values, kind), k + 1)
        starts = lambda values: [sum(values[:i]) for i in range(len(values))]
        # the part of a row of parts, laid one after the other, that x falls into
        part_of = lambda x, values: F.size(F.filter(listed(starts(values)), lambda y: y <= x)) - 1
        shards = -(-total // SLOTS)
        tasks = min(shards, max(spark.sparkContext.defaultParallelism, total // TASK_SLOTS))
        size = F.least(F.lit(SLOTS), F.lit(total) - F.col("shard") * SLOTS)
        each = spark.range(0, shards, 1, tasks).select(F.col("id").alias("shard")).withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), size - 1)))
        drawn = each.withColumn("k", part_of(F.pmod(F.xxhash64(F.lit(self.seed), F.lit("draw"), "shard", "j"), F.lit(total)), n)).groupBy("shard", "k").agg(F.count("*").alias("n"))
        drawn = self.work.save(drawn.withColumn("cell", F.floor(F.col("shard") / CELL_ROWS)), "drawn")
        cells = drawn.groupBy("k", "cell").agg(F.sum("n").alias("c"))
        cells = cells.withColumn("c", F.sum("c").over(Window.partitionBy("k").orderBy("cell")) - F.col("c"))
        own = F.sum("n").over(Window.partitionBy("k", "cell").orderBy("shard")) - F.col("n")
        drawn = self.work.save(drawn.withColumn("own", own).join(cells, ["k", "cell"]).select("shard", "k", "n", (F.col("own") + F.col("c")).alias("before")), "before")
        got = {r["k"]: r["n"] for r in drawn.groupBy("k").agg(F.sum("n").alias("n")).collect()}  # one row a source
        got = [int(got.get(k, 0)) for k in range(len(n))]
        over, under = [max(0, g - w) for g, w in zip(got, n, strict=True)], [max(0, w - g) for g, w in zip(got, n, strict=True)]
        # the number of partitions is given, as each row becomes up to SLOTS rows
        laid = drawn.repartition(tasks, "shard").withColumn("at", F.sum("n").over(Window.partitionBy("shard").orderBy("k")) - F.col("n"))
        one = laid.withColumn("r", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
        place = permuted(F.col("at") + F.col("r"), size, F.lit(self.seed), F.lit("place"), F.col("shard"))
        one = one.select("shard", (F.col("shard") * SLOTS + place).alias("slot"), "k", (F.col("before") + F.col("r")).alias("i"))
        extra = F.col("i") - pick(n, F.col("k"))  # 0 or more: drawn beyond the source's slots
        m = extra + pick(starts(over), F.col("k"))
        to = part_of(m, [max(u, 0) for u in under])
        if any(over):
            one = one.withColumn("m", F.when(extra >= 0, m)).withColumn("to", F.when(extra >= 0, to))
            settled = pick(got, F.col("to")) + F.col("m") - pick(starts(under), F.col("to"))
            one = one.select("shard", "slot", F.coalesce("to", "k").alias("k"), F.when(F.col("to").isNotNull(), settled).otherwise(F.col("i")).alias("i"))
        of = lambda name, kind="long": pick([r[name] for r in sources], F.col("k"), kind)
        one = one.withColumn("source", of("source", "string")).withColumn("copy", F.floor(F.col("i") / of("blocks"))).withColumn("q", F.col("i") - F.col("copy") * of("blocks"))
        key = (F.lit(self.seed), F.coalesce("source", F.lit("")), F.col("source").isNull(), F.col("copy"))
        index = F.when(F.col("q") >= of("full"), F.col("q")).otherwise(permuted(F.col("q"), of("full"), *key))
        takes = F.when(F.col("copy") < of("passes"), F.lit(b)).otherwise(F.least(F.lit(b), of("rest") - F.col("q") * b))
        return drawn, one.select("shard", "slot", "source", "copy", index.alias("index"), takes.cast("long").alias("takes"))

    def filled(self) -> DataFrame:
        """(shard, slot, source, copy, uid, doc_id, from_word, words): which words of which document fill each slot."""
        return self._joined().select("shard", "slot", "source", "copy", "uid", "doc_id", "from_word", "start", F.col("took").alias("words")).filter("words > 0")

    def _joined(self) -> DataFrame:
        # slots are made by explode, whose size Spark guesses far too low: without the hint it would broadcast them
        found = self.pieces.alias("p").join(self.slots.hint("merge").alias("s"), same_source("p", "s") & (F.col("p.index") == F.col("s.index")), "left")
        took = F.greatest(F.lit(0), F.least(F.col("words"), F.coalesce("takes", F.lit(0)) - F.col("start")))
        return found.select("uid", "doc_id", "p.source", "size", "from_word", "start", "copy", "shard", "slot", took.alias("took"))

    def taken(self) -> DataFrame:
        """(uid, doc_id, source, size, taken) of every document."""
        found = self._joined().groupBy("uid", "doc_id", "source", "size").agg(F.sum("took").alias("taken"))
        return found.unionByName(self.sized.filter("size = 0").withColumn("taken", F.lit(0).cast("long")))

    def shard_counts(self) -> DataFrame:
        """(shard, source, n): the slots of each source in each shard, draws settled to the totals."""
        return self.slots.groupBy("shard", "source").agg(F.count("*").alias("n"))


def sized_documents(docs: DataFrame, work: Workspace) -> DataFrame:
    """doc_id, source, size and a row number, saved: the only read of the texts."""
    return work.save(docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), F.monotonically_increasing_id().alias("uid")), "sized")


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .common import read_table

    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    mix = Mix(sized_documents(docs, Workspace(spark, "sizes")))
    t = mix.targets
    out = mix.taken().alias("d").join(t.alias("t"), same_source("d", "t"))
    return out.select("doc_id", "size", "source_size", "target", "taken")


def mixed_documents(docs: DataFrame, weights=WEIGHTS, most: float = MOST) -> DataFrame:
    """docs as the mix takes them: a row for each document and pass that takes words of it, all columns kept.

    A pass that takes all words keeps the text as it is; one that takes some words keeps those, in their order,
    joined by single spaces. Documents of which nothing is taken go. n_chars, if there, is counted anew.
    """
    work = Workspace(docs.sparkSession, "mixed")
    # columns lie in a struct, so that none of theirs can clash with one of ours
    size = n_words(F.col("text"))
    held = work.save(docs.select(F.monotonically_increasing_id().alias("uid"), size.alias("size"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc")), "docs")
    mix = Mix(held.select("uid", "doc.doc_id", "doc.source", "size"), weights, most)
    parts = mix.filled().groupBy("uid", "copy").agg(F.sum("words").alias("words"), F.array_sort(F.collect_list(F.struct("from_word", "words"))).alias("parts"))
    found = held.join(parts, "uid")
    words = F.regexp_extract_all("doc.text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    some = F.array_join(F.flatten(F.transform("parts", lambda p: F.slice(words, p["from_word"].cast("int") + 1, p["words"].cast("int")))), " ")
    text = F.when(F.col("words") == F.col("size"), F.col("doc.text")).otherwise(some)
    out = {c: F.col(f"doc.`{c}`") for c in docs.columns} | {"text": text}
    if "n_chars" in docs.columns:
        out["n_chars"] = F.length(text).cast(docs.schema["n_chars"].dataType)
    return found.select(*[v.alias(c) for c, v in out.items()])
