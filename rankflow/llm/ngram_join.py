"""Exact Jaccard self-join of documents over word n-grams, as connected classes; size-aware, heavy and light.

A document's set: hashes (64 bits) of its distinct k-word shingles of `[^\\x20\\x09-\\x0D]+` words, A-Z lower-cased;
with fewer words the whole sequence is its one shingle.  Two documents link when den * |A n B| >= num * |A u B|.

1. Documents of one set form a class at once; only one document of each class goes on.
2. Document frequencies of shingles are counted in buckets (by 42 bits of the hash, which only orders shingles); shards
   get back those of their shingles that are found twice.
3. Sets of up to `boundary` shingles are *small*.  If linked sets have m <= M shingles, they share c(m) = ceil(2 num m / (num + den)):
   small sets enumerate their subsets of these fixed sizes, and small sets that link meet under a subset.
   The boundary is where subsets stop being cheaper than scans, by the sizes' histogram.
4. Larger sets scan inverted lists: shingles in ascending frequency; the first common shingle of a linked pair lies within the first
   |A| - alpha + 1 of either, alpha the overlap they need.
5. Each list links its members to its first document only (light work, linear); links are verified against whole sets; classes
   follow as connected components.  Members inside the class of their list's first document need no test.
6. A list whose other members are then in several classes is mixed, and those of different classes are tested against each other.
   Where that would be many pairs for the entries of long lists, the long ones can be split: dealt into parts by the shingles' hashes,
   linked sets differ in so few shingles that some part is equal in both but for one; so their documents are listed anew by (sizes,
   part, digest of three quarters of it), and only those that share one meet.  Both ways find every link; the cheaper one, by the
   numbers of pairs, is taken (parts tell documents of a few common passages apart, but not those that are nearly linked).

Hot keys: a list or set that more than `SHARE` rows ask for is copied to as many tasks, and long lists are paired in blocks.

Edge cases: null, empty or blank texts have an empty set, link with nothing and are their own component; rows that repeat a doc_id
are separate documents (equal rows too); null ids take part, and a component of null ids only has a null id; other columns are ignored; an
empty table gives an empty result.
"""

from __future__ import annotations

from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text
from ._spark import cut, dealt_join, many, shard_count
from ._text import U, mix
from .components import connected_components

#: What scanning one list entry costs, in subsets hashed.
SCAN_COST = 4
#: Mixed lists with more members can be split by parts; that is tried from so many pairs an entry on, and done if it makes so many times fewer.
LONG, WORTH, FEWER = 8, 4, 4
#: Rows of one key that a task gets, about.
SHARE = 1000
#: No boundary above this is tried: numbers of subsets rise steeply.
MOST_BOUNDARY = 24


def _sets(texts: pa.Array, k: int):
    """(index, sorted distinct shingles, 16-byte key of the set) of every document; no key for empty sets."""
    for a, sh, offs in _text.word_shingles(texts, k, lower=True):
        for d in range(len(offs) - 1):
            t = np.unique(sh[offs[d] : offs[d + 1]])
            yield a + d, t, _set_key(t)


def _set_key(t: np.ndarray) -> bytes | None:
    if not len(t):
        return None
    one, two = mix(t), mix(t ^ U(0x5851F42D4C957F2D))
    return np.array([one.sum() + U(len(t)), two.sum()], np.uint64).tobytes()


def _keys_of(k: int):
    schema = pa.schema([("doc_id", pa.int64()), ("th", pa.int64()), ("n", pa.int32()), ("sk", pa.binary())])

    def step(batches):
        for batch in batches:
            n, sk = [], []
            for _, t, key in _sets(_text.text_array(batch.column("text")), k):
                n.append(len(t))
                sk.append(key)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("th"), pa.array(n, pa.int32()), pa.array(sk, pa.binary())], schema=schema)

    return step


def _chosen(docs: pa.Table, ids: list, keys: list, k: int):
    """The documents of a shard that stand for their class: (doc_id, key, shingles)."""
    want = set(zip(ids, keys))
    have = {i for i, _ in want}
    at = [i for i, x in enumerate(docs.column("doc_id").to_pylist()) if x in have]
    docs = docs.take(at)
    names = docs.column("doc_id").to_pylist()
    for i, t, key in _sets(_text.text_array(docs.column("text")), k):
        if (names[i], key) in want:
            want.discard((names[i], key))
            yield names[i], key, t


def _frequency_parts(k: int, buckets: int):
    def step(docs: pa.Table, reps: pa.Table) -> pa.Table:
        out = {"b": [], "s": [], "once": [], "more": [], "times": []}
        if docs.num_rows and reps.num_rows:
            s = docs.column("s")[0].as_py()
            got = [t for _, _, t in _chosen(docs, reps.column("doc_id").to_pylist(), reps.column("sk").to_pylist(), k)]
            v, count = np.unique(np.concatenate(got) if got else np.zeros(0, np.uint64), return_counts=True)
            b = (v % U(buckets)).astype(np.int64)
            order = np.argsort(b, kind="stable")
            v, count, b = (v[order] >> U(32)).astype(np.uint32), count[order].astype(np.uint32), b[order]
            cuts = np.append(np.flatnonzero(np.diff(b, prepend=-1)), len(b))
            for x, y in zip(cuts[:-1], cuts[1:]):
                many = count[x:y] > 1
                out["b"].append(int(b[x]))
                out["s"].append(s)
                out["once"].append(v[x:y][~many].tobytes())
                out["more"].append(v[x:y][many].tobytes())
                out["times"].append(count[x:y][many].tobytes())
        return pa.table({c: pa.array(v, pa.int32() if c in "bs" else pa.binary()) for c, v in out.items()})

    return step


def _frequencies(table: pa.Table) -> pa.Table:
    """One bucket: the frequency of each shingle found twice or more, to each shard that has it."""
    b = table.column("b")[0].as_py()
    shard = table.column("s").to_pylist()
    parts, times, who = [], [], []
    for i, (a, m, t) in enumerate(zip(*(table.column(c).to_pylist() for c in ("once", "more", "times")))):
        a, m = np.frombuffer(a, np.uint32), np.frombuffer(m, np.uint32)
        parts += [a, m]
        times += [np.ones(len(a), np.uint32), np.frombuffer(t, np.uint32)]
        who.append(np.full(len(a) + len(m), i))
    v, times, who = np.concatenate(parts), np.concatenate(times), np.concatenate(who)
    order = np.argsort(v, kind="stable")
    v, times, who = v[order], times[order], who[order]
    heads = np.flatnonzero(np.concatenate([[True], v[1:] != v[:-1]]))
    total = np.add.reduceat(times, heads)[np.cumsum(np.concatenate([[False], v[1:] != v[:-1]]))]
    keep = total > 1
    v, total, who = v[keep], total[keep].astype(np.uint32), who[keep]
    order = np.argsort(who, kind="stable")
    v, total, who = v[order], total[order], who[order]
    cuts = np.searchsorted(who, np.arange(len(shard) + 1))
    rows = [(s, v[x:y].tobytes(), total[x:y].tobytes()) for s, x, y in zip(shard, cuts[:-1], cuts[1:]) if y > x]
    return pa.table({"s": pa.array([r[0] for r in rows], pa.int32()), "b": pa.array([b] * len(rows), pa.int32()), "part": pa.array([r[1] for r in rows], pa.binary()), "df": pa.array([r[2] for r in rows], pa.binary()), "doc_id": pa.nulls(len(rows), pa.int64()), "sk": pa.nulls(len(rows), pa.binary())})


def _subset_size(m: int, num: int, den: int) -> int:
    return -(-2 * num * m // (num + den))


def _partners(n: int, num: int, den: int) -> range:
    """Sizes of the sets that one of n shingles can link with and that are not larger."""
    return range(max(1, -(-num * n // den)), n + 1)


def choose_boundary(sizes: dict[int, int], num: int, den: int) -> int:
    """The largest size of small sets, by the cost of subsets against that of scans."""

    def subsets(n):
        return sum(comb(n, _subset_size(m, num, den)) for m in _partners(n, num, den))

    def scans(n):
        return SCAN_COST * (n - -(-num * n // den) + 1)

    def cost(x):
        return sum(c * ((subsets(n) if n <= x else 0) + (scans(n) if n > x or den * n >= num * (x + 1) else 0)) for n, c in sizes.items() if n)

    return min(range(MOST_BOUNDARY + 1), key=cost)


_PART = pa.schema([("kind", pa.int32()), ("key", pa.int64()), ("sk", pa.binary()), ("doc_id", pa.int64()), ("n", pa.int32()), ("pos", pa.int32()), ("tokens", pa.list_(pa.int64()))])
_PART_SQL = "kind int, key long, sk binary, doc_id long, n int, pos int, tokens array<long>"


def _subset_keys(t: np.ndarray, num: int, den: int) -> np.ndarray:
    w = mix(t)
    total, out = int(w.sum()), []
    for m in _partners(len(t), num, den):
        away = len(t) - _subset_size(m, num, den)
        if away >= 0:
            out += [(total - int(w[list(c)].sum()) + m * 0xA0761D6478BD642F) % 2**64 for c in combinations(range(len(t)), away)]
    return mix(np.array(out, np.uint64))


def _lists(k: int, num: int, den: int, buckets: int, boundary: int):
    def step(docs: pa.Table, given: pa.Table) -> pa.Table:
        lists, sets = [], []
        if docs.num_rows and given.num_rows:
            reps, freq = given.filter(given.column("sk").is_valid()), given.filter(given.column("sk").is_null())
            known, df = np.zeros(0, np.uint64), np.zeros(0, np.uint32)
            if freq.num_rows:
                part = [np.frombuffer(x, np.uint32) for x in freq.column("part").to_pylist()]
                known = np.concatenate([(U(b) << U(32)) | p.astype(np.uint64) for b, p in zip(freq.column("b").to_pylist(), part)])
                df = np.concatenate([np.frombuffer(x, np.uint32) for x in freq.column("df").to_pylist()])
                order = np.argsort(known)
                known, df = known[order], df[order]
            for doc, key, t in _chosen(docs, reps.column("doc_id").to_pylist(), reps.column("sk").to_pylist(), k):
                n = len(t)
                f = np.ones(n, np.uint32)
                if len(known):
                    look = ((t % U(buckets)) << U(32)) | (t >> U(32))
                    at = np.minimum(np.searchsorted(known, look), len(known) - 1)
                    f = np.where(known[at] == look, df[at], f)
                used = False
                if n > boundary or den * n >= num * (boundary + 1):
                    order = np.lexsort((t, f))[: n - -(-num * n // den) + 1]
                    pos = np.flatnonzero(f[order] > 1)
                    if len(pos):
                        used = True
                        lists.append((t[order[pos]], pos, key, doc, n))
                if n <= boundary:
                    used = True
                    keys = _subset_keys(t, num, den)
                    lists.append((keys, np.zeros(len(keys), np.int64), key, doc, n))
                if used:
                    sets.append((key, doc, n, t[f > 1]))
        return pa.concat_tables([_entries(lists), _sets_table(sets)])

    return step


def _binary(keys: list[bytes], times=1) -> pa.Array:
    """Keys of 16 bytes, each `times` times."""
    data = np.repeat(np.frombuffer(b"".join(keys), "V16"), times)
    return pa.Array.from_buffers(pa.binary(), len(data), [None, pa.py_buffer(np.arange(0, 16 * len(data) + 1, 16, dtype=np.int32)), pa.py_buffer(data)])


def _entries(lists: list[tuple]) -> pa.Table:
    """Rows of lists: (keys, places, set key, doc_id, size) of each document."""
    m = np.array([len(x[0]) for x in lists], np.int64)
    total = int(m.sum())
    doc = pa.array([x[3] for x in lists], pa.int64()).take(pa.array(np.repeat(np.arange(len(lists)), m)))
    key = np.concatenate([x[0] for x in lists]) if lists else np.zeros(0, np.uint64)
    pos = np.concatenate([x[1] for x in lists]) if lists else np.zeros(0, np.int64)
    n = np.repeat(np.array([x[4] for x in lists], np.int32), m)
    return pa.Table.from_arrays([pa.array(np.zeros(total, np.int32)), pa.array(key.view(np.int64)), _binary([x[2] for x in lists], m), doc, pa.array(n), pa.array(pos.astype(np.int32)), pa.nulls(total, pa.list_(pa.int64()))], schema=_PART)


def _sets_table(sets: list[tuple]) -> pa.Table:
    """Rows of sets: (set key, doc_id, size, shingles found elsewhere)."""
    k = len(sets)
    offs = np.concatenate([[0], np.cumsum([len(x[3]) for x in sets])]).astype(np.int32)
    tokens = pa.ListArray.from_arrays(pa.array(offs), pa.array(np.concatenate([x[3] for x in sets]).view(np.int64) if sets else np.zeros(0, np.int64)))
    return pa.Table.from_arrays([pa.array(np.ones(k, np.int32)), pa.nulls(k, pa.int64()), _binary([x[0] for x in sets]), pa.array([x[1] for x in sets], pa.int64()), pa.array([x[2] for x in sets], pa.int32()), pa.nulls(k, pa.int32()), tokens], schema=_PART)


def _verified(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (a, b) that link."""
    for side, n, tokens in (("a", "na", "ta"), ("b", "nb", "tb")):
        per = pairs.select("a", "b").groupBy(side).agg(F.count("*").alias("c"))
        pairs = dealt_join(pairs, sets.select(F.col("sk").alias(side), F.col("n").alias(n), F.col("tokens").alias(tokens)), side, many(per, side, SHARE))
    both = pairs.withColumn("common", F.size(F.array_intersect("ta", "tb")))
    return both.where(den * F.col("common") >= num * (F.col("na") + F.col("nb") - F.col("common"))).select("a", "b")


def sizes_of(n: int, num: int, den: int) -> tuple[int, int, int]:
    """(number, largest size, largest of the next) of the range of sizes that n is in: a set links with sets of its own range and the next or last one only."""
    i, low = 0, 1
    while (high := max(low, low * den // num)) < n:
        i, low = i + 1, high + 1
    return i, high, max(high + 1, (high + 1) * den // num)


def parts_of(tokens: np.ndarray, n: int, num: int, den: int) -> np.ndarray:
    """Keys of the parts of a set, by its own range of sizes and the next one.

    Linked sets of up to m shingles differ in d = 2 m (den - num) / (den + num) at most, so of d // 2 + 1 parts one has one difference
    at most, and of its four quarters three are equal.
    """
    i, own, after = sizes_of(n, num, den)
    out, weight = [], mix(tokens)
    deal = mix(tokens ^ U(0x2545F4914F6CDD1D))
    for group, most in ((i, own), (i + 1, after)):
        parts = most * (den - num) // (den + num) + 1
        quarters = np.zeros(4 * parts, np.uint64)
        np.add.at(quarters, (deal % U(4 * parts)).astype(np.int64), weight)
        quarters = quarters.reshape(parts, 4)
        three = quarters.sum(axis=1, keepdims=True) - quarters
        out.append(mix(three.ravel() + np.arange(4 * parts, dtype=np.uint64) * U(0x9E3779B97F4A7C15) + mix(np.array([group], np.uint64))))
    return np.concatenate(out)


def _by_parts(num: int, den: int):
    """(sk, n, root, tokens) -> (key, sk, n, pos, root), a row a part."""

    def step(batches):
        for batch in batches:
            rows = [(parts_of(t.values.to_numpy(zero_copy_only=False).view(np.uint64), n.as_py(), num, den), k.as_py(), n.as_py(), r.as_py()) for k, n, r, t in zip(*(batch.column(c) for c in ("sk", "n", "root", "tokens")))]
            if not rows:
                continue
            m = [len(r[0]) for r in rows]
            key = np.concatenate([r[0] for r in rows]).view(np.int64)
            n = np.repeat(np.array([r[2] for r in rows], np.int32), m)
            yield pa.RecordBatch.from_arrays([pa.array(key), _binary([r[1] for r in rows], m), pa.array(n), pa.array(np.zeros(len(n), np.int32)), _binary([r[3] for r in rows], m)], ["key", "sk", "n", "pos", "root"])

    return step


def _cost(entries: DataFrame) -> tuple[int, int]:
    """Entries of lists, and pairs of entries of different classes in them; entries: key, root."""
    own = entries.groupBy("key", "root").agg(F.count("*").cast("double").alias("n"))
    per = own.groupBy("key").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("same"))
    r = per.agg(F.sum("n").alias("entries"), F.sum((F.col("n") * F.col("n") - F.col("same")) / 2).alias("pairs")).first()
    return r.entries or 0, r.pairs or 0


def _mixed_pairs(placed: DataFrame, sets: DataFrame, num: int, den: int, can: str) -> DataFrame:
    """Pairs (a, b) of different classes that meet in a list; placed: key, sk, n, pos, c (members of the list), root (class)."""
    roots = placed.groupBy("key").agg(F.min("root").alias("x"), F.max("root").alias("y"), F.max("c").alias("c")).where("x <> y").select("key", "c")
    mixed = cut(dealt_join(placed.drop("c"), roots, "key", many(roots, "key", SHARE)))
    entries = mixed.drop("c")
    rows, pairs = _cost(mixed.where(F.col("c") > LONG))
    if pairs > WORTH * rows:
        far = mixed.where(F.col("c") > LONG).select("sk", "root").distinct()
        enough = f"size(tokens) * {den} >= {num} * n"  # others have no partner
        parts = sets.where(enough).join(far, "sk").select("sk", "n", "root", "tokens").mapInArrow(_by_parts(num, den), "key long, sk binary, n int, pos int, root binary")
        if _cost(parts)[1] * FEWER < pairs:
            entries = cut(mixed.where(F.col("c") <= LONG).select("key", "sk", "n", "pos", "root").union(parts))
    size = entries.groupBy("key").agg(F.count("*").alias("c"), F.min("root").alias("x"), F.max("root").alias("y")).where("x <> y").select("key", F.expr(f"1 + c div {SHARE}").alias("blocks"), "c")
    one = dealt_join(entries, size, "key", many(size, "key", SHARE)).drop("c")
    left = one.withColumn("block", F.pmod(F.xxhash64("sk"), F.col("blocks"))).drop("blocks")
    right = one.withColumn("block", F.explode(F.expr("sequence(0L, blocks - 1)"))).select("key", "block", *(F.col(c).alias("f" + c) for c in ("sk", "n", "pos", "root")))
    return left.join(right, ["key", "block"]).where(f"sk < fsk and root <> froot and {can}").select(F.col("sk").alias("a"), F.col("fsk").alias("b")).distinct()


def similar_classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = 4, num: int = 85, den: int = 100) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id of the documents it is linked with, over any number of links) of every row; and class_key, which names the component where ids repeat (null for empty sets), with text_hash (xxhash64 of the text).

    Lists and classes are led by the smallest id: work is least where that is the original of its near copies.
    """
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).withColumn("th", F.xxhash64("text"))
    s = shard_count(docs, "text")
    base = cut(docs.mapInArrow(_keys_of(k), "doc_id long, th long, n int, sk binary"))
    classes = cut(base.where("sk is not null").groupBy("sk").agg(F.min(F.struct("doc_id", "th")).alias("r"), F.max("n").alias("n")).select("sk", "r.doc_id", "r.th", "n"))
    sizes = {r["n"]: r["count"] for r in classes.where(F.col("n") <= MOST_BOUNDARY + MOST_BOUNDARY // 2).groupBy("n").count().collect()}
    boundary = choose_boundary(sizes, num, den)

    # by the text too: rows of one id, or of none, are dealt
    shard = F.pmod(F.xxhash64("doc_id", "th"), F.lit(s)).cast("int").alias("s")
    dealt, reps = docs.select("doc_id", "text", shard), classes.select("doc_id", "sk", shard)
    parts = dealt.groupBy("s").cogroup(reps.groupBy("s")).applyInArrow(_frequency_parts(k, s), "b int, s int, once binary, more binary, times binary")
    freq = parts.groupBy("b").applyInArrow(_frequencies, "s int, b int, part binary, df binary, doc_id long, sk binary")
    given = freq.unionByName(reps, allowMissingColumns=True)
    made = cut(dealt.groupBy("s").cogroup(given.groupBy("s")).applyInArrow(_lists(k, num, den, s, boundary), _PART_SQL))
    sets = made.where("kind = 1").select("sk", "n", "tokens")
    lists = made.where("kind = 0").select("key", "sk", "doc_id", "n", "pos")

    firsts = cut(lists.groupBy("key").agg(F.min(F.struct("doc_id", "sk", "n", "pos")).alias("f"), F.count("*").alias("c")).where("c > 1").select("key", "c", F.col("f.sk").alias("fsk"), F.col("f.n").alias("fn"), F.col("f.pos").alias("fpos")))
    near = cut(dealt_join(lists.drop("doc_id"), firsts, "key", many(firsts, "key", SHARE)))
    need = f"({num} * (n + fn) + {num + den - 1}) div {num + den}"  # the overlap that a pair needs
    can = f"n - pos >= {need} and fn - fpos >= {need}"
    tested = cut(near.where(f"sk <> fsk and {can}").select(F.least("sk", "fsk").alias("a"), F.greatest("sk", "fsk").alias("b")).distinct())
    links = cut(_verified(tested, sets, num, den))
    roots = connected_components(links)

    placed = cut(near.where("c > 2 and sk <> fsk").select("key", "sk", "n", "pos", "c").join(roots.withColumnRenamed("node", "sk"), "sk", "left").withColumn("root", F.coalesce("root", "sk")))
    rest = cut(_mixed_pairs(placed, sets, num, den, can).join(tested, ["a", "b"], "left_anti"))
    more = cut(_verified(rest, sets, num, den))
    if more.limit(1).count():
        roots = connected_components(links.union(more))

    named = classes.select("sk", F.col("doc_id").alias("least")).join(roots.withColumnRenamed("node", "sk"), "sk", "left").withColumn("root", F.coalesce("root", "sk"))
    ids = named.join(named.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("sk", "component_id", F.col("root").alias("class_key"))
    component = F.when(F.col("sk").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return base.join(ids, "sk", "left").select("doc_id", F.col("n").cast("long").alias("n_shingles"), component.alias("component_id"), "class_key", F.col("th").alias("text_hash"))


def op4_ngram_join(spark, sf_dir: str) -> DataFrame:
    return similar_classes(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "n_shingles", "component_id")
