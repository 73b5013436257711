"""Exact BPE encoding and decoding of whole texts, by words and by tree concatenation.

Splitting and normalisation follow the tokenizer's file.  Words meet in a cache; words that are new are encoded together by
the tokenizers library, whose tokens with the word-end mark show where each ends.  A word longer than `LEAF` symbols (text that
nothing splits) goes through the tree: its halves are encoded independently down to leaves, and at each join
the last tokens of the left and the first of the right are encoded anew in a growing window until the window's first and last
tokens are the ones that stood there.  A sequence of tokens is the encoding of its text if each two neighbours are the encoding of theirs,
so agreement on both sides makes the join exact.

Texts with an unsplit run of `LONG_RUN` characters or more go another way, in which the halves are rows of their own: a task cuts such a
word into leaves of `LEAF_ROW` symbols, which are dealt over all tasks and encoded in parallel, and meet again for the joins.

Edge cases: null and empty texts have no tokens and decode to the empty string; special tokens written in a text are encoded as
such, as the library does by default; ids may repeat or be null, other columns are ignored.
"""

from __future__ import annotations

import json
import os
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text
from ._spark import small_batches

LEAF = 64
#: Characters of an unsplit run from which on its leaves are encoded in parallel, and symbols of such a leaf.
LONG_RUN = 1 << 15
LEAF_ROW = 1 << 12
#: Words kept by a worker; when there would be more the cache starts anew before a batch, whose own words it holds all, however many.
CACHE_WORDS = 150_000
#: Characters whose normal form, lower case and class are plain: texts of these take the quick way.
_LETTERS = "a-zß-öø-ÿœšž"
_PLAIN = re.compile(r"[\t\n\r\x20-\x7e¡¿«»°§–—‘’“”…€À-ÖØ-öø-ÿŒœŠšŸŽž]*")
_WORD = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[0-9]|[^\s{_LETTERS}0-9]+")


class WordCodec:
    """Encoder and decoder for a tokenizers file of BPE with word ends."""

    def __init__(self, source: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        spec = json.loads(source)
        self.library = Tokenizer.from_str(source)
        self.library.no_truncation()
        self.library.no_padding()
        self.end = spec["model"]["end_of_word_suffix"] or ""
        self.vocab = spec["model"]["vocab"]
        self.merges = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.merges[self.vocab[a], self.vocab[b]] = (rank, self.vocab[a + b])
        self.names = {i: t for t, i in self.vocab.items()} | {t["id"]: t["content"] for t in spec["added_tokens"]}
        self.parts = {m: p for p, (_, m) in reversed(self.merges.items())}
        self.ends = np.zeros(max(self.names) + 1, bool)
        self.ends[[i for i, t in self.names.items() if self.end and t.endswith(self.end)]] = True
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special_split = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        # the quick way knows this one pattern and normaliser only
        split = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"] if spec["pre_tokenizer"]["type"] == "Sequence" else ""
        self.quick = bool(self.end) and split == r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+" and [x["type"] for x in spec["normalizer"]["normalizers"]] == ["NFC", "Replace", "Lowercase"]
        self.ids: dict[str, bytes] = {}
        self.said: dict[str, str] = {}

    # ------------------------------------------------------------ merges
    def merge(self, symbols: list[int]) -> list[int]:
        """Merges of a short run of symbols, lowest rank first, leftmost first."""
        symbols = list(symbols)
        while len(symbols) > 1:
            best, at = None, -1
            for i in range(len(symbols) - 1):
                m = self.merges.get((symbols[i], symbols[i + 1]))
                if m and (best is None or m[0] < best[0]):
                    best, at = m, i
            if best is None:
                break
            symbols[at : at + 2] = [best[1]]
        return symbols

    def spell(self, token: int) -> list[int]:
        """The symbols of a token."""
        stack, out = [token], []
        while stack:
            t = stack.pop()
            if t in self.parts:
                a, b = self.parts[t]
                stack += [b, a]
            else:
                out.append(t)
        return out

    def tree(self, symbols: list[int]) -> list[int]:
        """Halves first, then the joins."""
        if len(symbols) <= LEAF:
            return self.merge(symbols)
        half = len(symbols) // 2
        return self.join(self.tree(symbols[:half]), self.tree(symbols[half:]))

    def join(self, left: list[int], right: list[int]) -> list[int]:
        i = j = 1
        while True:
            symbols = [s for t in left[len(left) - i :] + right[:j] for s in self.spell(t)]
            window = self.merge(symbols)
            ok_left = i == len(left) or window[0] == left[-i]
            ok_right = j == len(right) or window[-1] == right[j - 1]
            if ok_left and ok_right:
                return left[: len(left) - i] + window + right[j:]
            i = i if ok_left else min(2 * i, len(left))
            j = j if ok_right else min(2 * j, len(right))

    def symbols(self, mapped: str, last: bool = True) -> list[int]:
        """The symbols of (the last part of) a word in the byte alphabet."""
        return [self.vocab[c] for c in mapped[:-1]] + [self.vocab[mapped[-1] + (self.end if last else "")]]

    def piece(self, mapped: str) -> list[int]:
        """A word in the byte alphabet."""
        return self.tree(self.symbols(mapped))

    def joined(self, leaves: list[list[int]]) -> list[int]:
        """The leaves of one word, joined two by two."""
        while len(leaves) > 1:
            leaves = [self.join(leaves[i], leaves[i + 1]) if i + 1 < len(leaves) else leaves[i] for i in range(0, len(leaves), 2)]
        return leaves[0]

    def leaves(self, text: str, size: int):
        """(number, leaf, last, symbols in the byte alphabet, ids) of a text: leaves of words above the size, and ids of all that is between them."""
        number, ids = 0, []
        for token, p in self.words(text):
            if p is None:
                ids.append(token)
            elif len(p) <= size:
                ids += self.piece(p)
            else:
                yield number, 0, True, None, ids
                for k in range(0, len(p), size):
                    yield number + 1, k // size, k + size >= len(p), p[k : k + size], None
                number, ids = number + 2, []
        yield number, 0, True, None, ids

    # ------------------------------------------------------------ texts
    def _learn(self, words: list[str]) -> None:
        short = [w for w in words if len(w) <= LEAF]
        for i in range(0, len(short), 20_000):
            some = short[i : i + 20_000]
            ids = np.array(self.library.encode(" ".join(some), add_special_tokens=False).ids, np.uint32)
            stops = np.flatnonzero(self.ends[ids]) + 1
            if len(stops) != len(some):  # a word that the library splits on its own
                words = words + some
                continue
            a = 0
            for w, b in zip(some, stops.tolist()):
                self._keep(w, ids[a:b])
                a = b
        for w in words:
            if w not in self.ids:
                self._keep(w, np.array([t for p, _ in self.library.pre_tokenizer.pre_tokenize_str(w) for t in self.piece(p)], np.uint32))

    def _keep(self, word: str, ids: np.ndarray) -> None:
        self.ids[word] = ids.astype("<u4").tobytes()
        self.said[word] = " ".join(map(self.names.__getitem__, ids.tolist()))

    def words(self, text: str):
        """(id, None) of special tokens and (None, word in the byte alphabet) of the rest."""
        for part in self.special_split.split(text) if self.special_split else [text]:
            if part in self.special:
                yield self.special[part], None
            elif part:
                plain = self.library.normalizer.normalize_str(part) if self.library.normalizer else part
                for p, _ in self.library.pre_tokenizer.pre_tokenize_str(plain):
                    yield None, p

    def _general(self, text: str) -> list[int]:
        out: list[int] = []
        for token, p in self.words(text):
            out += [token] if p is None else self.piece(p)
        return out

    def forget(self) -> None:
        """Empties the cache at the end of a task: the worker goes on with other steps."""
        self.ids, self.said = {}, {}
        _text.give_back()

    def encode_batch(self, texts: list[str]) -> tuple[list[bytes], list[str]]:
        """Ids as little-endian unsigned 32-bit integers, and the decoded text, of each."""
        split, new = [], set()
        for t in texts:
            if self.quick and "<|" not in t and _PLAIN.fullmatch(t):
                w = _WORD.findall(t.lower())
                split.append(w)
                new.update(w)
            else:
                split.append(None)
        missing = [w for w in new if w not in self.ids]
        if self.ids and len(self.ids) + len(missing) > CACHE_WORDS:
            self.ids.clear()
            self.said.clear()
            missing = list(new)
        self._learn(missing)
        ids, said = [], []
        for t, w in zip(texts, split):
            if w is None:
                x = self._general(t)
                ids.append(np.array(x, "<u4").tobytes())
                said.append(self.decode(x))
            else:
                ids.append(b"".join(map(self.ids.__getitem__, w)))
                said.append(" ".join(map(self.said.__getitem__, w)))
        return ids, said

    def decode(self, ids) -> str:
        """As the library's decode without a decoder: the tokens, special ones too, joined by spaces."""
        return " ".join(self.names[i] for i in ids if i in self.names)


_codecs: dict[int, WordCodec] = {}


def _codec(source: str) -> WordCodec:
    """One for each worker process."""
    if hash(source) not in _codecs:
        _codecs[hash(source)] = WordCodec(source)
    return _codecs[hash(source)]


def encode(docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """doc_id, the columns of `keep`, ids (little-endian unsigned 32-bit integers) and decoded of every row; tokenizer: path of a file of the tokenizers library."""
    keep = [doc_id, *(keep or [])]
    small_batches(docs.sparkSession)
    with open(tokenizer, encoding="utf-8") as f:
        source = docs.sparkSession.sparkContext.broadcast(f.read())

    def step(batches):
        codec = _codec(source.value)
        for batch in batches:
            texts = _text.text_array(batch.column("__text"))
            for a, b, *_ in _text.chunks(texts):
                ids, said = codec.encode_batch(texts.slice(a, b - a).to_pylist())
                cols = [batch.column(c).slice(a, b - a) for c in keep]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(ids, pa.binary()), pa.array(said, pa.string())], [*keep, "ids", "decoded"])
        codec.forget()

    kinds = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), "ids binary", "decoded string"])
    docs = docs.select(*keep, F.col(text).alias("__text"))
    far = F.expr(f"coalesce(length(__text) >= {LONG_RUN} and exists(split(__text, '\\\\s+'), w -> length(w) >= {LONG_RUN}), false)")
    return docs.where(~far).mapInArrow(step, schema).union(_in_leaves(docs.where(far), source, keep, kinds))


def _in_leaves(docs: DataFrame, source, keep: list[str], kinds: dict[str, str]) -> DataFrame:
    """As `encode` for texts with very long unsplit words: leaves are encoded in parallel, then joined.  Equal rows go once and are multiplied at the end."""
    docs = docs.groupBy(*keep, "__text").agg(F.count("*").alias("__copies"))
    every = [F.col(c) for c in (*keep, "__text")]
    docs = docs.withColumn("__row", F.xxhash64(*every)).withColumn("__again", F.xxhash64(F.lit("again"), *every))
    own = [*keep, "__copies", "__row", "__again"]
    named = [*(f"`{c}` {kinds[c]}" for c in keep), "__copies long", "__row long", "__again long"]
    cells = pa.schema([("number", pa.int32()), ("leaf", pa.int32()), ("last", pa.bool_()), ("symbols", pa.string()), ("ids", pa.binary())])
    size = LEAF_ROW

    def cut_up(batches):
        codec = _codec(source.value)
        for batch in batches:
            for i, t in enumerate(batch.column("__text").to_pylist()):
                got = [(n, k, last, s, None if x is None else np.array(x, "<u4").tobytes()) for n, k, last, s, x in codec.leaves(t, size)]
                one = [batch.column(c).take(pa.array([i] * len(got))) for c in own]
                yield pa.RecordBatch.from_arrays([*one, *(pa.array(v, f.type) for v, f in zip(zip(*got), cells))], [*own, *cells.names])

    def coded(batches):
        codec = _codec(source.value)
        for batch in batches:
            ids = [x if s is None else np.array(codec.tree(codec.symbols(s, last)), "<u4").tobytes() for s, last, x in zip(*(batch.column(c).to_pylist() for c in ("symbols", "last", "ids")))]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in own), batch.column("number"), batch.column("leaf"), pa.array(ids, pa.binary())], [*own, "number", "leaf", "ids"])

    def whole(table: pa.Table) -> pa.Table:
        codec = _codec(source.value)
        table = table.sort_by([("number", "ascending"), ("leaf", "ascending")])
        out, word, at = [], [], None
        for number, x in [*zip(table.column("number").to_pylist(), table.column("ids").to_pylist()), (None, b"")]:
            if number != at and word:
                out += codec.joined(word)
                word = []
            at = number
            word.append(np.frombuffer(x, "<u4").tolist())
        first = table.slice(0, 1).select([*keep, "__copies"])
        return first.append_column("ids", pa.array([np.array(out, "<u4").tobytes()], pa.binary())).append_column("decoded", pa.array([codec.decode(out)], pa.string()))

    parts = docs.mapInArrow(cut_up, ", ".join([*named, "number int, leaf int, last boolean, symbols string, ids binary"]))
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ids = parts.repartition(n, "__row", "number", "leaf").mapInArrow(coded, ", ".join([*named, "number int, leaf int, ids binary"]))
    made = ids.groupBy("__row", "__again").applyInArrow(whole, ", ".join([*named[: len(keep) + 1], "ids binary, decoded string"]))
    return made.withColumn("__copies", F.explode(F.expr("sequence(1L, __copies)"))).drop("__copies")


def op2_bpe(spark, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("word_bpe_49k.json")
    out = encode(spark.read.parquet(f"{sf_dir}/documents.parquet"), tokenizer)
    return out.select("doc_id", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
