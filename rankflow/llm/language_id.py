"""Language identification by interpolated Kneser-Ney character models.

Texts become letters in lower case, with one boundary symbol between runs of letters.  Each language has 4-gram counts over all its
training documents, discounted per order and interpolated with continuation counts below.  A model keeps sorted arrays of keys: of
the grams of each order, with discounted counts for every language, and of their contexts, with totals and interpolation weights for what
follows a context unseen.  A text gets the language of the lowest cross-entropy a symbol; it is rejected if that exceeds the language's
limit, which is calibrated on all distinct training texts.

The model has every gram of the training documents.  Its arrays are files of the shared folder, in parts by the key's remainder, which
workers map into memory; the driver gets their paths and a few sums.

Edge cases: null texts and texts without a letter are `und` with score 0 and not accepted; so is every text when there is nothing to learn
from; rows with a null lang teach nothing; null ids are held out; repeated rows count as often as they are there.
"""

from __future__ import annotations

import os
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text
from ._spark import cut, shared_dir, small_batches, without
from ._text import U

ORDER = 4
#: Rows of a part of a model's table, about, and the numbers of parts (primes: keys are dealt by remainder).
PART_ROWS = 1 << 20
PARTS = (1, 7, 29, 61, 127, 509, 2039, 8191)
#: The limit is this quantile of the cross-entropy of a language's own documents, with slack.
QUANTILE, SLACK = 0.995, 1.3

_tables: list[np.ndarray] = []


def _symbols_of() -> np.ndarray:
    """16-bit symbols of all code points: 0 for what is no letter."""
    if not _tables:
        low = np.zeros(0x110000, np.uint16)
        for c in range(0x110000):
            if (x := chr(c)).isalpha():
                y = ord(x.lower()[0])
                low[c] = y if y < 0x10000 else (y * 40503 & 0xFFFF) | 1
        _tables.append(low)
    return _tables[0]


def symbols(raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of a chunk and their offsets; each document is led by ORDER - 1 boundaries, which are no part of its range."""
    points = np.frombuffer(raw.tobytes().decode("utf-8", "replace").encode("utf-32-le", "surrogatepass"), np.uint32)
    heads = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])[offs]
    sym = _symbols_of()[points]
    keep = sym != 0
    keep[1:] |= sym[:-1] != 0
    first = heads[:-1][heads[:-1] < len(sym)]
    keep[first] = sym[first] != 0
    at = np.concatenate([[0], np.cumsum(keep)])[heads]
    lead = ORDER - 1
    out = np.zeros(at[-1] + lead * (len(offs) - 1), np.uint64)
    doc = np.repeat(np.arange(len(offs) - 1), np.diff(at))
    out[np.arange(at[-1]) + lead * (doc + 1)] = sym[keep]
    return out, np.stack([at[:-1] + lead * np.arange(1, len(offs)), at[1:] + lead * np.arange(1, len(offs))], axis=1)


def grams(sym: np.ndarray, order: int = ORDER) -> np.ndarray:
    """The gram that ends at each symbol, 16 bits a symbol."""
    key = sym.copy()
    for j in range(1, order):
        key[j:] |= sym[:-j] << U(16 * j)
    return key


# ---------------------------------------------------------------- learning
def count_grams(docs: DataFrame) -> DataFrame:
    """(lang, key, c): 4-gram counts of (text, lang), summed in each task first."""

    def step(batches):
        held: dict[str, list] = {}
        size = 0

        def merged(parts):
            key, c = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
            order = np.argsort(key)
            key, c = key[order], c[order]
            head = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            return key[head], np.add.reduceat(c, head)

        def flush():
            for lang, parts in held.items():
                key, c = merged(parts)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(key), pa.string()), pa.array(key.view(np.int64)), pa.array(c)], ["lang", "key", "c"])

        for batch in batches:
            langs = np.array(batch.column("lang").to_pylist(), object)
            for lang in sorted(set(langs)):
                rows = batch.filter(pa.array(langs == lang))
                for _, _, raw, offs in _text.chunks(_text.text_array(rows.column("text"))):
                    sym, spans = symbols(raw, offs)
                    own = np.ones(len(sym), bool)
                    for j in range(1, ORDER):
                        own[spans[:, 0] - j] = False
                    key = np.sort(grams(sym)[own])
                    if len(key):
                        head = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
                        held.setdefault(lang, []).append((key[head], np.diff(np.append(head, len(key)))))
                        size += len(head)
                if len(held.get(lang, [])) > 8:
                    held[lang] = [merged(held[lang])]
            if sum(len(p[0]) for parts in held.values() for p in parts) > 1 << 21:
                yield from flush()
                held = {}
        yield from flush()

    return docs.select("lang", "text").mapInArrow(step, "lang string, key long, c long").groupBy("lang", "key").agg(F.sum("c").alias("c"))


def discount(ones: int, twos: int) -> float:
    """Kneser-Ney's absolute discount of an order, from the grams seen once and twice."""
    return min(0.95, max(0.05, ones / max(1, ones + 2 * twos)))


def _lower(n: int) -> int:
    """Mask of the last n symbols of a gram."""
    return (1 << (16 * n)) - 1


def _table(key: np.ndarray, lang: np.ndarray, values: np.ndarray, n_lang: int, none: tuple) -> tuple[np.ndarray, np.ndarray]:
    """Sorted keys, and their values by language; `none` where a language doesn't have the key."""
    keys, at = np.unique(key, return_inverse=True)
    out = np.empty((len(keys), n_lang, len(none)), np.float32)
    out[:] = none
    out[at, lang] = values
    return keys, out


#: Values of a gram (count less the discount) and of a context (1 / total, weight of what follows unseen) for languages without it.
NONE = {"gram": (0.0,), "context": (0.0, 1.0)}


class Models:
    """The languages' models together: for each order a table of grams and one of contexts, in parts by `key % parts`.

    A part is (keys, values), or the path of its files, which are mapped into memory where they are read.
    """

    def __init__(self, counts: dict[str, tuple[np.ndarray, np.ndarray]] | None = None):
        """Models of (sorted keys, counts) of each language's 4-grams."""
        counts = counts or {}
        self.langs = sorted(counts)
        self.limit = np.full(len(self.langs), np.inf)
        self.vocabulary = len(np.unique(np.concatenate([k & U(0xFFFF) for k, _ in counts.values()]))) + 1 if counts else 1
        self.parts: dict[tuple[int, str], list] = {}
        orders = [self._orders(*counts[lang]) for lang in self.langs]
        for n in range(1, ORDER + 1) if orders else ():
            made: dict[str, list] = {"gram": [], "context": []}
            for ell, (k, c) in enumerate(o[n - 1] for o in orders):
                d = discount((c == 1).sum(), (c == 2).sum())
                own, inverse = np.unique(k >> U(16), return_inverse=True)
                total, kinds = np.bincount(inverse, c, len(own)), np.bincount(inverse, minlength=len(own))
                made["gram"].append((k, np.full(len(k), ell), (c - d)[:, None]))
                made["context"].append((own, np.full(len(own), ell), np.stack([1 / total, d * kinds / total], axis=1)))
            for kind, t in made.items():
                self.parts[n, kind] = [_table(*(np.concatenate(x) for x in zip(*t)), len(self.langs), NONE[kind])]

    @staticmethod
    def _orders(key: np.ndarray, c: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """Counts of 4-grams, and below them numbers of distinct symbols that precede."""
        out = [(key, c.astype(np.float64))]
        for n in range(ORDER - 1, 0, -1):
            k, kinds = np.unique(out[0][0] & U(_lower(n)), return_counts=True)
            out.insert(0, (k, kinds.astype(np.float64)))
        return out

    def _find(self, n: int, kind: str, keys: np.ndarray) -> np.ndarray:
        """Values of keys by language."""
        parts = self.parts[n, kind]
        out = np.empty((len(keys), len(self.langs), len(NONE[kind])), np.float32)
        out[:] = NONE[kind]
        of = keys.view(np.int64) % len(parts)
        for b in np.unique(of):
            if parts[b] is None:
                continue
            if isinstance(parts[b], str):
                parts[b] = tuple(np.load(f"{parts[b]}.{x}.npy", mmap_mode="r") for x in ("keys", "values"))
            have, values = parts[b]
            mine = np.flatnonzero(of == b)
            at = np.minimum(np.searchsorted(have, keys[mine]), len(have) - 1)
            hit = have[at] == keys[mine]
            out[mine[hit]] = values[at[hit]]
        return out

    def log_probabilities(self, key: np.ndarray) -> np.ndarray:
        own, back = np.unique(key, return_inverse=True)
        p = np.full((len(own), len(self.langs)), 1 / self.vocabulary)
        for n in range(1, ORDER + 1) if self.langs else ():
            k = own & U(_lower(n))
            context = self._find(n, "context", k >> U(16))
            p = self._find(n, "gram", k)[:, :, 0] * context[:, :, 0] + context[:, :, 1] * p
        return np.log(p).astype(np.float32)[back]

    def entropies(self, raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cross-entropy a symbol by document and language, and the numbers of symbols."""
        sym, spans = symbols(raw, offs)
        n = spans[:, 1] - spans[:, 0]
        out = np.zeros((len(n), len(self.langs)))
        some = np.flatnonzero(n > 0)
        if len(some):
            lp = self.log_probabilities(grams(sym))
            edges = np.stack([spans[some, 0], spans[some, 1]], axis=1).ravel()
            lp = np.concatenate([lp, np.zeros((1, lp.shape[1]), np.float32)])
            out[some] = -np.add.reduceat(lp.astype(np.float64), edges, axis=0)[::2] / n[some, None]
        return out, n

    def classify(self, texts: pa.Array):
        """(language or und, score, cross-entropy, accepted) of each text."""
        for _, _, raw, offs in _text.chunks(texts, 1 << 20):
            h, n = self.entropies(raw, offs)
            best = h.argmin(axis=1) if self.langs else np.zeros(len(n), np.int64)
            for d in range(len(n)):
                if not n[d] or not self.langs:
                    yield "und", 0.0, None, False
                else:
                    b = best[d]
                    score = 1 / np.exp(-(h[d] - h[d, b]) * min(float(n[d]), 50.0)).sum()
                    yield self.langs[b], float(score), float(h[d, b]), bool(h[d, b] <= self.limit[b])


def _build(counts: DataFrame) -> Models:
    """Models of counts of 4-grams (lang, key, c): every gram, in files of the shared folder.  The driver gets a row a language and order, and one a file."""
    spark, models = counts.sparkSession, Models()
    order = counts.select(F.lit(ORDER).alias("n"), "lang", "key", "c")
    orders = order
    for n in range(ORDER - 1, 0, -1):
        order = order.groupBy(F.lit(n).alias("n"), "lang", F.col("key").bitwiseAND(_lower(n)).alias("key")).agg(F.count("*").alias("c"))
        orders = orders.union(order)
    orders = cut(orders)
    once, twice = (F.count(F.when(F.col("c") == x, 1)).alias(f"c{x}") for x in (1, 2))
    stats = orders.groupBy("n", "lang").agg(once, twice, F.count("*").alias("k")).collect()
    if not stats:
        return models
    models.langs = sorted({r.lang for r in stats})
    models.limit = np.full(len(models.langs), np.inf)
    models.vocabulary = orders.where("n = 1").select("key").distinct().count() + 1
    place = {x: i for i, x in enumerate(models.langs)}
    less = {(r.n, place[r.lang]): discount(r.c1, r.c2) for r in stats}
    rows = {n: sum(r.k for r in stats if r.n == n) for n in range(1, ORDER + 1)}
    n_parts = next((p for p in PARTS if max(rows.values()) <= p * PART_ROWS), PARTS[-1])
    number = spark.createDataFrame(list(place.items()), "lang string, l int")
    orders = orders.join(F.broadcast(number), "lang").select("n", "l", "key", "c")
    context = F.shiftrightunsigned("key", 16)
    contexts = orders.groupBy("n", "l", context.alias("key")).agg(F.sum("c").alias("c"), F.count("*").alias("kinds"))
    every = orders.withColumn("kinds", F.lit(0).cast("long")).withColumn("kind", F.lit("gram")).unionByName(contexts.withColumn("kind", F.lit("context")))
    folder, n_lang = f"{shared_dir(spark)}/language-models-{uuid.uuid4().hex}".removeprefix("file://").removeprefix("file:"), len(models.langs)

    def write(key, t):
        n, kind, part = (x.as_py() for x in key)
        l, c, kinds = (t.column(x).to_numpy() for x in ("l", "c", "kinds"))
        d = np.array([less.get((n, i), 0.05) for i in range(n_lang)])[l]
        values = (c - d)[:, None] if kind == "gram" else np.stack([1 / c, d * kinds / c], axis=1)
        made = _table(t.column("key").to_numpy().view(np.uint64), l, values, n_lang, NONE[kind])
        os.makedirs(folder, exist_ok=True)
        at = f"{folder}/{n}-{kind}-{part}-{uuid.uuid4().hex}"  # a task that runs twice writes twice, one of them counts
        for name, x in zip(("keys", "values"), made):
            np.save(f"{at}.{name}.npy", x)
        return pa.table({"n": [n], "kind": [kind], "part": [part], "path": [at]})

    files = every.groupBy("n", "kind", F.pmod("key", F.lit(n_parts)).alias("part")).applyInArrow(write, "n long, kind string, part long, path string")
    models.parts = {(n, kind): [None] * n_parts for n in range(1, ORDER + 1) for kind in NONE}
    for r in files.collect():
        models.parts[r.n, r.kind][r.part] = r.path
    return models


def quantiles(own: DataFrame, q: float) -> dict[str, float]:
    """The q-quantile of h by lang over all rows, to 2^-29, between neighbours as `percentile`: histograms narrow down on the two ranks, so the driver gets a bounded number of counts."""
    own = own.select("lang", F.floor(F.least("h", F.lit(127.0)) * (1 << 29)).cast("long").alias("v"))
    size = {r.lang: r["count"] for r in own.groupBy("lang").count().collect()}
    # (lang, side) -> rank among the rows whose leading digits are `lead`
    sides = {(lang, up): (min(n - 1, int(q * (n - 1)) + up), 0) for lang, n in size.items() for up in (0, 1)}
    for shift in (24, 12, 0):
        wanted = own.sparkSession.createDataFrame(sorted({(lang, lead) for (lang, _), (_, lead) in sides.items()}), "lang string, lead long")
        near = own.withColumn("lead", F.shiftright("v", shift + 12)).join(F.broadcast(wanted), ["lang", "lead"])
        counts: dict[tuple, list] = {}
        for r in near.groupBy("lang", "lead", F.shiftright("v", shift).alias("d")).count().orderBy("d").collect():
            counts.setdefault((r.lang, r.lead), []).append((r.d, r["count"]))
        for side, (rank, lead) in sides.items():
            for d, n in counts[side[0], lead]:
                if rank < n:
                    sides[side] = (rank, d)
                    break
                rank -= n
    value = {side: lead / (1 << 29) for side, (_, lead) in sides.items()}
    return {lang: value[lang, 0] + (value[lang, 1] - value[lang, 0]) * (q * (n - 1) % 1) for lang, n in size.items()}


def _limits(docs: DataFrame, models: Models) -> None:
    """Sets the limits from every document given that its own language's model likes best; from all of a language where there is none."""
    shared = docs.sparkSession.sparkContext.broadcast(models)

    def step(batches):
        place = {x: i for i, x in enumerate(shared.value.langs)}
        for batch in (whole.slice(i, 1000) for whole in batches for i in range(0, whole.num_rows, 1000)):
            lang = np.array([place[x] for x in batch.column("lang").to_pylist()], np.int64)
            h, right, some = np.zeros(len(lang)), np.zeros(len(lang), bool), np.zeros(len(lang), bool)
            for a, b, raw, offs in _text.chunks(_text.text_array(batch.column("text"))):
                e, n = shared.value.entropies(raw, offs)
                h[a:b], right[a:b], some[a:b] = e[np.arange(b - a), lang[a:b]], e.argmin(axis=1) == lang[a:b], n > 0
            keep = pa.array(some)
            cols = [batch.column("lang"), batch.column("same"), pa.array(h), pa.array(right)]
            yield pa.RecordBatch.from_arrays([x.filter(keep) for x in cols], ["lang", "same", "h", "right"])

    # each text once: a text with very many copies would otherwise set its language's limit alone
    rows = docs.select("lang", F.xxhash64("text").alias("same"), "text").mapInArrow(step, "lang string, same long, h double, right boolean")
    rows = cut(rows.groupBy("lang", "same").agg(F.max("h").alias("h"), F.max("right").alias("right")))
    for found in (rows, rows.where("right")):
        for lang, h in quantiles(found, QUANTILE).items():
            models.limit[models.langs.index(lang)] = h * SLACK


def learn(docs: DataFrame) -> Models:
    """Models from the text and lang of every row given."""
    docs = docs.where("lang is not null and text is not null")
    small_batches(docs.sparkSession)
    models = _build(cut(count_grams(docs)))
    if models.langs:
        # languages without a single gram have no model
        _limits(docs.where(F.col("lang").isin(models.langs)), models)
    return models


def identify(docs: DataFrame, models: Models, text: str = "text") -> DataFrame:
    """The table with lang_pred, score, cross_entropy and accepted (false: rejected), instead of columns of these names."""
    docs = without(docs, ["lang_pred", "score", "cross_entropy", "accepted"], text)
    shared = docs.sparkSession.sparkContext.broadcast(models)

    def step(batches):
        for batch in (whole.slice(i, 1000) for whole in batches for i in range(0, whole.num_rows, 1000)):
            rows = list(shared.value.classify(_text.text_array(batch.column(text))))
            made = [pa.array([r[i] for r in rows], k) for i, k in enumerate((pa.string(), pa.float64(), pa.float64(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], [*batch.schema.names, "lang_pred", "score", "cross_entropy", "accepted"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(step, f"{kinds}, lang_pred string, score double, cross_entropy double, accepted boolean")


def held_out():
    """True for rows that are not learnt from."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(True))


def op10_language_id(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").withColumn("held_out", held_out())
    models = learn(docs.where("not held_out"))
    out = identify(docs.select("doc_id", "held_out", "text"), models)
    return out.select("doc_id", "held_out", "lang_pred", "score", "accepted")
