"""Document fingerprints by one-permutation MinHash.

Five-word shingles of `[^\\x20\\x09-\\x0D]+` words are hashed once; the low bits choose one of `BINS` bins, which keeps the smallest of
the other bits.  An empty bin takes the value of the first filled one in a pseudorandom order of bins of its own (optimal
densification).  The low byte of each value is stored; the likeness of two fingerprints is their share of equal bytes, corrected for
the 1 in 256 that agree by chance.

Edge cases: texts with fewer than five words have their whole sequence as shingle; null, empty and blank texts have the empty
string as fingerprint (likeness 1 with each other, 0 with others).
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text
from ._spark import shard_count, without
from ._text import U, mix

BINS = 256
WORDS = 5
_BIN_BITS = U(8)
_KEPT = U(42)


def fingerprints(texts: pa.Array, words: int = WORDS) -> list[bytes]:
    """BINS bytes for each text, none for texts without words."""
    out: list[bytes] = [b""] * len(texts)
    for a, sh, offs in _text.word_shingles(texts, words, lower=False):
        sh = mix(sh)
        for lo in range(0, len(offs) - 1, 1 << 13):
            hi = min(lo + (1 << 13), len(offs) - 1)
            part, n = sh[offs[lo] : offs[hi]], hi - lo
            doc = np.repeat(np.arange(n, dtype=np.uint64), np.diff(offs[lo : hi + 1]))
            slot = (doc << _BIN_BITS) | (part & U(BINS - 1))
            packed = np.sort((slot << _KEPT) | (part >> U(64) - _KEPT))
            slot = packed >> _KEPT
            head = np.ones(len(slot), bool)
            head[1:] = slot[1:] != slot[:-1]
            value = np.zeros(n * BINS, np.uint64)
            filled = np.zeros(n * BINS, bool)
            at = slot[head].astype(np.int64)
            value[at], filled[at] = packed[head] & ((U(1) << _KEPT) - U(1)), True
            some = filled.reshape(n, BINS).any(axis=1)
            _densify(value, filled, np.flatnonzero(~filled & np.repeat(some, BINS)))
            low = (value & U(255)).astype(np.uint8).reshape(n, BINS)
            for d in np.flatnonzero(some):
                out[a + lo + d] = low[d].tobytes()
    return out


def _densify(value: np.ndarray, filled: np.ndarray, empty: np.ndarray) -> None:
    """Each empty slot tries bins in its own order, the same in all documents, until one is filled."""
    turn = 0
    while len(empty):
        turn += 1
        bin_ = (empty % BINS).astype(np.uint64)
        try_ = (mix(bin_ * U(1_000_003) + U(turn)) & U(BINS - 1)).astype(np.int64)
        src = empty - (empty % BINS) + try_
        hit = filled[src]
        value[empty[hit]] = value[src[hit]]
        empty = empty[~hit]


def likeness(a: bytes, b: bytes) -> float:
    """The estimated Jaccard similarity of two fingerprints."""
    if not a or not b:
        return float(a == b)
    same = float((np.frombuffer(a, np.uint8) == np.frombuffer(b, np.uint8)).mean())
    return min(1.0, max(0.0, (same - 1 / 256) / (1 - 1 / 256)))


def with_fingerprint(docs: DataFrame, text: str = "text", column: str = "fingerprint", words: int = WORDS) -> DataFrame:
    """The table with the fingerprints of a text column, in hex (instead of a column of that name)."""
    docs = without(docs, [column], text)

    def step(batches):
        for batch in batches:
            prints = [x.hex() for x in fingerprints(_text.text_array(batch.column(text)), words)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(prints, pa.string())], [*batch.schema.names, column])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(step, f"{kinds}, `{column}` string")


# ---------------------------------------------------------------- each document and its successor
_LEAST = -(2**63)


def _ids(column) -> np.ndarray:
    return np.array([_LEAST if x is None else x for x in column.to_pylist()], np.int64)


def successors(docs: DataFrame, buckets: int) -> DataFrame:
    """(bucket, extra, doc_id, text): ids in descending order fall into consecutive buckets; extra rows are the documents that follow a bucket's last.

    The text is shuffled once.  The driver gets one id for each bucket.
    """
    ids = docs.select(F.coalesce("doc_id", F.lit(_LEAST)).alias("i"))

    def highest(batches):
        top = None
        for batch in batches:
            if batch.num_rows:
                m = int(batch.column(0).to_numpy().max())
                top = m if top is None else max(top, m)
        if top is not None:
            yield pa.RecordBatch.from_arrays([pa.array([top], pa.int64())], ["top"])

    tops = np.array(sorted(r.top for r in ids.repartitionByRange(buckets, "i").mapInArrow(highest, "top long").collect()), np.int64)

    def deal(batches):
        for batch in batches:
            i = _ids(batch.column("doc_id"))
            b = np.searchsorted(tops, i)
            for rows, bucket, extra in ((np.arange(len(i)), b, False), (r := np.flatnonzero(tops[np.minimum(b, len(tops) - 1)] == i), (b[r] + 1) % max(1, len(tops)), True)):
                part = batch.take(pa.array(rows))
                yield pa.RecordBatch.from_arrays([pa.array(bucket, pa.int64()), pa.array([extra] * len(rows), pa.bool_()), part.column("doc_id"), part.column("text")], ["bucket", "extra", "doc_id", "text"])

    return docs.select("doc_id", "text").mapInArrow(deal, "bucket long, extra boolean, doc_id long, text string")


def _compared(table: pa.Table) -> pa.Table:
    extra, names = table.column("extra").to_pylist(), table.column("doc_id").to_pylist()
    ids, texts = _ids(table.column("doc_id")), [t or "" for t in table.column("text").to_pylist()]
    order = sorted(range(len(ids)), key=lambda r: (-int(ids[r]), texts[r]))
    main = [r for r in order if not extra[r]]
    follows = [r for r in order if extra[r]]
    nexts = main[1:] + follows[:1]
    own = [texts[r] for r in main]
    edited = []
    for r, s in zip(main, nexts):
        t, half = texts[r], len(texts[r]) // 2
        edited.append(t[: len(t) - half] + texts[s][:half])
    mine = fingerprints(_text.text_array(pa.array([*own, texts[nexts[-1]]], pa.large_string()))) if main else []
    other = fingerprints(_text.text_array(pa.array(edited, pa.large_string())))
    return pa.table(
        {
            "doc_id": pa.array([names[r] for r in main], pa.int64()),
            "n_chars": pa.array([len(t) for t in own], pa.int64()),
            "edited_sha256": pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited], pa.string()),
            "fingerprint": pa.array([x.hex() for x in mine[:-1]], pa.string()),
            "edited_fingerprint": pa.array([x.hex() for x in other], pa.string()),
            "near_edited": pa.array([likeness(a, b) for a, b in zip(mine, other)], pa.float64()),
            "near_next": pa.array([likeness(a, b) for a, b in zip(mine, mine[1:])], pa.float64()),
        }
    )


def compare_with_edited(docs: DataFrame) -> DataFrame:
    """Fingerprints of each text, and of it with its second half replaced by the start of the next document's (descending doc_id, then text; null ids last; after the last the first)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    dealt = successors(docs, shard_count(docs, "text"))
    return dealt.groupBy("bucket").applyInArrow(_compared, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def op1_fingerprints(spark, sf_dir: str) -> DataFrame:
    return compare_with_edited(spark.read.parquet(f"{sf_dir}/documents.parquet"))
