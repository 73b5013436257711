"""Mixing sources to target weights.  SQL functions only.

Each source's documents, in a pseudorandom order, are one stream of words, packed into blocks of `block` words (the last may be
shorter).  A source is due as many slots of the output as its target is worth in blocks, twice its blocks at most.  The output has shards
of `SHARD_SLOTS` slots.  Every slot draws its source by the shares of all slots, so the counts of sources in a shard are multinomial; the
draws that a source gets beyond its due, in the order of slots, go to the sources that fall short, in their order, so that the totals come out
exactly.  The j-th slot of a source takes block p(j) of the source's own permutation p of its blocks (a second round over the blocks has
another), and blocks are joined by index with the pieces of documents in them.  What a document gives is read from the joined blocks;
`mixed` gives the mix itself, as text.

Permutations are swap-or-not shuffles: keyed, exact on any number of items, and computed for each item by itself.

Sources are in the order of code points, null last.  The driver gets one row a source.  Edge cases: null and wordless texts have size 0
and nothing taken; rows that repeat a doc_id are mixed each; an empty table gives an empty result.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._spark import cut, without
from .quality_rules import words_of

BLOCK = 64
SHARD_SLOTS = 1024
WEIGHTS = (5, 2, 1)
ROUNDS = 12
#: A word with the white space before it, the last one with that after it too: joined, the words of a text are the text.
_SPACED = r"[\x20\x09-\x0D]*+[^\x20\x09-\x0D]++(?:[\x20\x09-\x0D]++\z)?"


def targets(sizes: list[int], weights=WEIGHTS, share: float = 1.5, most: float = 2.0) -> list[float]:
    """Targets of sources: share of the total by weight, `most` times the size at most, the excess going to the others by weight."""
    out, full, left = [0.0] * len(sizes), set(), share * sum(sizes)
    while len(full) < len(sizes):
        rest = [i for i in range(len(sizes)) if i not in full]
        total = sum(weights[i % len(weights)] for i in rest)
        over = [i for i in rest if left * weights[i % len(weights)] / total > most * sizes[i]]
        if not over:
            for i in rest:
                out[i] = left * weights[i % len(weights)] / total
            break
        for i in over:
            out[i] = most * sizes[i]
            left -= out[i]
            full.add(i)
    return out


def shuffled(df: DataFrame, column: str, n: str, key: str, out: str, inverse: bool = False) -> DataFrame:
    """Adds the place of `column` (0 to n - 1) in a keyed permutation of n items, by swap-or-not rounds."""
    df = df.withColumn(out, F.col(column))
    for r in range(ROUNDS)[:: -1 if inverse else 1]:
        df = df.withColumn("__y", F.expr(f"pmod(pmod(xxhash64({key}, {r}, 'k'), {n}) - {out}, {n})"))
        df = df.withColumn(out, F.expr(f"if(xxhash64({key}, {r}, greatest({out}, __y)) & 1 = 1, __y, {out})"))
    return df.drop("__y")


def streams(docs: DataFrame, parts: int) -> DataFrame:
    """doc_id, sid (source number), size and start: the place of each document in its source's stream.  Prefix sums go by parts of a source, so no source meets in one task."""
    dealt = docs.withColumn("part", F.pmod(F.xxhash64("doc_id", "h", F.lit("part")), F.lit(parts)))
    sums = dealt.groupBy("sid", "part").agg(F.sum("size").alias("s"))
    before = F.coalesce(F.sum("s").over(Window.partitionBy("sid").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    base = sums.withColumn("base", before).select("sid", "part", "base")
    within = Window.partitionBy("sid", "part").orderBy(F.xxhash64("doc_id"), "doc_id", "h", "size").rowsBetween(Window.unboundedPreceding, -1)
    dealt = dealt.withColumn("within", F.coalesce(F.sum("size").over(within), F.lit(0)))
    return dealt.join(base, ["sid", "part"]).withColumn("start", F.col("base") + F.col("within")).drop("part", "base", "within", "h")


def alias_table(weights: list[int]) -> tuple[list[float], list[int]]:
    """Walker's table: a bin in the range of the weights stands for itself below its threshold, and for its alias above."""
    n, total = len(weights), sum(weights)
    left = [w * n / total for w in weights]
    alias, small, large = list(range(n)), [i for i in range(n) if left[i] < 1], [i for i in range(n) if left[i] >= 1]
    threshold = [1.0] * n
    while small and large:
        i, j = small.pop(), large[-1]
        threshold[i], alias[i] = left[i], j
        left[j] -= 1 - left[i]
        if left[j] < 1:
            small.append(large.pop())
    return threshold, alias


def _array(values, kind: str) -> str:
    """A literal array of numbers, one string folded once."""
    return f"cast(split('{','.join(map(repr, values))}', ',') as array<{kind}>)" if values else f"cast(array() as array<{kind}>)"


def draws(spark, slots: list[int], key: str) -> DataFrame:
    """shard, slot, sid, k (place among the shard's slots of the source): the source that each slot of the output draws."""
    total, n = sum(slots), max(1, len(slots))
    threshold, alias = alias_table(slots) if total else ([1.0], [0])
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), total // 200_000)
    s = spark.range(0, -(-total // SHARD_SLOTS), 1, parts).select(F.col("id").alias("shard"), F.explode(F.expr(f"sequence(id * {SHARD_SLOTS}, least((id + 1) * {SHARD_SLOTS}, {total}L) - 1)")).alias("slot"))
    s = s.withColumn("bin", F.expr(f"cast(pmod(xxhash64('{key}', slot, 'bin'), {n}) as int)")).withColumn("toss", F.expr(f"shiftrightunsigned(xxhash64('{key}', slot, 'toss'), 11) / 9007199254740992D"))
    s = s.select("shard", "slot", F.expr(f"if(toss < get({_array(threshold, 'double')}, bin), bin, get({_array(alias, 'int')}, bin))").alias("sid"))
    return s.withColumn("k", F.row_number().over(Window.partitionBy("sid", "shard").orderBy("slot")) - 1)


def slots_of(spark, blocks: list[int], slots: list[int], key: str) -> DataFrame:
    """One row a slot of the output: shard, slot, sid, j (slot of the source), pass and block.  blocks, slots: of each source."""
    drawn = draws(spark, slots, key)
    counts = cut(drawn.groupBy("sid", "shard").agg(F.count("*").alias("c")))
    # where a shard's slots begin among the source's: by runs of shards, so that no source meets in one task
    runs = counts.withColumn("run", F.expr(f"shard div {SHARD_SLOTS}"))
    sums = runs.groupBy("sid", "run").agg(F.sum("c").alias("s"))
    got = {r.sid: r.s for r in sums.groupBy("sid").agg(F.sum("s").alias("s")).collect()}
    before = lambda c, *by: F.coalesce(F.sum(c).over(Window.partitionBy("sid", *by[:-1]).orderBy(by[-1]).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = runs.withColumn("within", before("c", "run", "shard")).join(sums.withColumn("base", before("s", "run")).hint("merge"), ["sid", "run"]).select("sid", "shard", (F.col("base") + F.col("within")).alias("start"))
    own = [got.get(i, 0) for i in range(len(slots))]
    over, short, m, n = [], [], 0, 0  # what the sources before got too much, and too little
    for g, w in zip(own, slots):
        over.append(m)
        short.append(n)
        m, n = m + max(0, g - w), n + max(0, w - g)
    due, have, past, lack, size = (_array(x, "bigint") for x in (slots, own, over, short, blocks))
    # merge joins throughout: what is exploded from few shards is taken for small, and would be broadcast
    s = drawn.join(starts.hint("merge"), ["sid", "shard"]).withColumn("j", F.col("start") + F.col("k"))
    s = s.withColumn("q", F.expr(f"if(j < get({due}, sid), null, get({past}, sid) + j - get({due}, sid))"))
    s = s.withColumn("to", F.expr(f"if(q is null, sid, size(filter({lack}, x -> x <= q)) - 1)"))
    s = s.withColumn("j", F.expr(f"if(q is null, j, get({have}, to) + q - get({lack}, to))"))
    s = s.select("shard", "slot", F.col("to").alias("sid"), "j", F.expr(f"get({size}, to)").alias("blocks"))
    s = s.withColumn("pass", F.expr("j div blocks")).withColumn("i", F.expr("j % blocks"))
    return shuffled(s, "i", "blocks", f"'{key}', sid, pass", "block").select("shard", "slot", "sid", "j", "pass", "block")


class Mixture:
    """The parts of a mix: sized (all documents), plan (sources), slots (the output) and pieces (documents in blocks, with where they are taken)."""

    def __init__(self, docs: DataFrame, doc_id: str = "doc_id", source: str = "source", text: str = "text", block: int = BLOCK, seed: str = "mix"):
        spark, self.block = docs.sparkSession, block
        sized = cut(docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), F.size(words_of(text)).cast("long").alias("size"), F.xxhash64(F.col(text)).alias("h")))
        per = sorted(((r.source, r.s) for r in sized.groupBy("source").agg(F.sum("size").alias("s")).collect()), key=lambda x: (x[0] is None, x[0] or ""))
        goal, rows = targets([s for _, s in per]), []
        for i, ((name, s), t) in enumerate(zip(per, goal)):
            blocks = -(-s // block)
            n = min(2 * blocks, round(t / (s / blocks))) if blocks else 0
            rows.append((i, name, s, float(t), blocks, n))
        self.plan = spark.createDataFrame(rows, "sid int, source string, source_size long, target double, blocks long, slots long")
        self.blocks, self.due, self.seed = [r[4] for r in rows], [r[5] for r in rows], seed
        number = F.create_map(*[F.lit(x) for i, (name, _) in enumerate(per) for x in (name, i) if name is not None]) if any(n is not None for n, _ in per) else None
        sid = F.lit(len(per) - 1) if number is None else F.coalesce(F.try_element_at(number, F.col("source")), F.lit(len(per) - 1))
        parts = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.docs = streams(sized.withColumn("sid", sid.cast("int")).drop("source"), parts)
        inside = f"if(size > 0, sequence(start div {block}, (start + size - 1) div {block}), null)"
        lo, hi = f"greatest(start, block * {block})", f"least(start + size, (block + 1) * {block})"
        self.pieces = self.docs.select("*", F.explode_outer(F.expr(inside)).alias("block")).withColumn("skip", F.expr(f"{lo} - start")).withColumn("n", F.expr(f"{hi} - {lo}"))

    @cached_property
    def slots(self) -> DataFrame:
        # written out: conditions on the block must not be pushed through the rounds, where they would grow with each
        return cut(slots_of(self.plan.sparkSession, self.blocks, self.due, self.seed))

    def taken(self) -> DataFrame:
        """doc_id, size, source_size, target and taken of every row."""
        got = self.pieces.where("size > 0").join(self.slots.select("sid", "block", "slot").hint("merge"), ["sid", "block"], "left")
        some = got.groupBy("doc_id", "sid", "start", "size").agg(F.sum(F.when(F.col("slot").isNull(), 0).otherwise(F.col("n"))).cast("long").alias("taken")).select("doc_id", "sid", "size", "taken")
        # documents of size 0 stand at one start and give nothing: repeated rows stay
        none = self.docs.where("size = 0").select("doc_id", "sid", "size", F.lit(0).cast("long").alias("taken"))
        of = self.plan.select("sid", "source_size", "target")  # a row a source, which the driver has anyway
        return some.union(none).join(F.broadcast(of), "sid").select("doc_id", "size", "source_size", "target", "taken")

    def output(self) -> DataFrame:
        """The mix itself: shard, slot, and the words (skip, n) of the documents (in the stream from start) in the slot's block."""
        return self.slots.hint("merge").join(self.pieces.where("size > 0").select("sid", "block", "doc_id", "start", "skip", "n"), ["sid", "block"]).select("shard", "slot", "sid", "block", "pass", "doc_id", "start", "skip", "n")


def keyed(docs: DataFrame) -> DataFrame:
    """The table with __row: 128 bits that only equal rows share."""
    every = [x for c in docs.columns for x in (F.col(c).isNull(), F.col(c))]
    return docs.withColumn("__row", F.struct(F.xxhash64(*every).alias("a"), F.xxhash64(F.lit("again"), *every).alias("b")))


def mixed(docs: DataFrame, source: str = "source", text: str = "text", block: int = BLOCK) -> DataFrame:
    """The mix itself, a row for each document in a slot: shard, slot, at (place in the source's stream) and the document's columns, its text
    cut to the words in the slot's block, with the white space before them, and after the last of the document.  A shard's rows lie in
    one partition, in order.  Ids play no part: they may repeat or lack."""
    docs = keyed(without(docs, ["shard", "slot", "at"], text))
    pieces = Mixture(docs, "__row", source, text, block).output()
    # a list for each document in a stream, so none is longer than its document; the text is joined and split once for all of a list
    lists = pieces.groupBy(F.col("doc_id").alias("__row"), "start").agg(F.collect_list(F.struct("shard", "slot", "skip", "n")).alias("__pieces"))
    cells = f"p -> struct(p.shard as shard, p.slot as slot, start + p.skip as at, array_join(slice(w, cast(p.skip as int) + 1, cast(p.n as int)), '') as `{text}`)"
    rows = F.expr(f"get(transform(array(__words), w -> transform(__pieces, {cells})), 0)")
    # equal rows are one here, with the lists of all of them
    spaced = F.regexp_extract_all(F.col(text), F.lit(_SPACED), F.lit(0))
    whole = docs.dropDuplicates(["__row"]).join(lists.hint("merge"), "__row").withColumn("__words", spaced)
    out = whole.select(*[c for c in docs.columns if c not in (text, "__row")], F.inline(rows))
    return out.repartition("shard").sortWithinPartitions("shard", "slot", "at").select("shard", "slot", "at", *[c for c in docs.columns if c != "__row"])


def op7_mixing(spark, sf_dir: str) -> DataFrame:
    return Mixture(spark.read.parquet(f"{sf_dir}/documents.parquet")).taken()
