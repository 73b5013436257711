"""Removal of repeated byte strings with per-shard suffix arrays.

A byte goes if a `length`-byte string that covers it also starts earlier in the corpus.

1. Documents are dealt into shards by a hash of their id and text.  For each window of `length` bytes the
   smallest hash of its k-byte grams is its *anchor value*.  Equal windows have equal anchor values, so
   only windows whose value is found twice can repeat.  Shards send each of their values once to the
   value's bucket, and get back which of theirs are found elsewhere too.
2. Each shard lays the regions of its candidate windows into a text, sorts its suffixes by
   Larsson-Sadakane refinement (groups that still tie are sorted again by the rank h places on, h doubling
   up to `length`), takes common prefixes by Kasai's recurrence, and so finds which windows are repeated in it.
3. Windows that are first in their shard go to the bucket of their anchor value: at most one copy a shard, so
   the hottest passage costs a bucket no more than one entry a shard.  A bucket merges the shards' windows into one
   directory, sorted by 64-bit fingerprints, and finds each shard's windows in it by binary search.  Windows so found are
   compared with the earliest byte by byte (a fingerprint that two strings share is looked up by the strings themselves);
   those that are equal to an earlier one go.
4. Shards join the removed windows with their documents and cut them out.

Edge cases: null and empty texts have no bytes and nothing removed; texts shorter than `length` lose
nothing; rows that repeat a doc_id are separate documents, ordered by a hash of their text (of equal rows one is earlier);
null ids sort first; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text
from ._spark import shard_count
from ._text import U, mix

GRAM = 32
#: Suffixes sorted at once; three fields of 21 bits then fit a machine word.
BLOCK = 1 << 21


# ---------------------------------------------------------------- anchors
def gram_hashes(raw: np.ndarray, k: int) -> np.ndarray:
    """A hash for each k-byte gram (k a power of two), by doubling."""
    h = _text._BYTE[raw]
    mult, s = 0x9E3779B97F4A7C15, 1
    while s < k:
        h = h[:-s] * U(mult) + h[s:]
        mult = mult * mult % 2**64
        s *= 2
    return mix(h)


def sliding(op, a: np.ndarray, w: int) -> np.ndarray:
    """op (minimum or maximum) over each w consecutive values."""
    r = 1
    while 2 * r <= w:
        a = op(a[:-r], a[r:])
        r *= 2
    return op(a[: len(a) - (w - r)], a[w - r :]) if r < w else a


def window_anchors(raw: np.ndarray, length: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The anchor value of each window, and the hash of each gram."""
    h = gram_hashes(raw, k)
    return sliding(np.minimum, h, length - k + 1), h


def selected(m: np.ndarray, h: np.ndarray, w: int) -> np.ndarray:
    """Hashes of the grams that some window has as its smallest, once for each place."""
    pad = np.zeros(w - 1, np.uint64)
    return h[sliding(np.maximum, np.concatenate([pad, m, pad]), w) == h]


# ---------------------------------------------------------------- suffix array
def suffix_array(sym: np.ndarray, room: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes of sym in the order of their first `depth` symbols at least (of those before the next separator, 0), and the group of each place: suffixes that tie so far share one and stand in text order.

    room: symbols from each place to its separator.
    """
    n = len(sym)
    bits = U(max(1, int(n + 1).bit_length()))
    mask = (U(1) << bits) - U(1)
    wide = 3 * int(bits) > 64
    s = np.zeros(n + 4, np.uint64)
    s[:n] = sym
    key, ahead = s[:n] << U(27), s[:n]
    for j, shift in ((1, 18), (2, 9), (3, 0)):  # nothing behind a separator counts
        ahead = np.where(ahead == 0, U(0), s[j : n + j])
        key |= ahead << U(shift)
    if 36 + int(bits) <= 64:
        packed = np.sort((key << bits) | np.arange(n, dtype=np.uint64))
        sa, key = (packed & mask).astype(np.int64), packed >> bits
    else:
        sa = np.argsort(key, kind="stable")
        key = key[sa]
    first = np.ones(n, bool)
    first[1:] = key[1:] != key[:-1]
    rank = np.zeros(2 * n + 2 * depth, np.uint64)
    at = np.arange(n)
    rank[sa] = np.maximum.accumulate(np.where(first, at, 0)).astype(np.uint64) + U(1)
    last = np.ones(n, bool)
    last[:-1] = first[1:]
    open_ = at[~(first & last)]
    h = 4
    while h < depth and len(open_):
        open_ = open_[room[sa[open_]] >= h]
        if not len(open_):
            break
        e = sa[open_]
        group, then = rank[e], rank[e + h]
        if wide:
            order = np.lexsort((then, group))
            e, group, then = e[order], group[order], then[order]
            changed = (group[1:] != group[:-1]) | (then[1:] != then[:-1])
        else:
            packed = np.sort((((group << bits) | then) << bits) | e.astype(np.uint64))
            e = (packed & mask).astype(np.int64)
            packed >>= bits
            changed = packed[1:] != packed[:-1]
        sa[open_] = e
        first = np.ones(len(e), bool)
        first[1:] = changed
        rank[e] = np.maximum.accumulate(np.where(first, open_, 0)).astype(np.uint64) + U(1)
        last = np.ones(len(e), bool)
        last[:-1] = first[1:]
        open_ = open_[~(first & last)]
        h *= 2
    return sa, rank


def common_prefixes(raw: np.ndarray, sa: np.ndarray, group: np.ndarray, room: np.ndarray, cap: int, lane: int = 128) -> np.ndarray:
    """Kasai's recurrence over text places, lanes of `lane` places in lockstep: for each place the common prefix, up to cap and the separators, with the suffix before it in the array.

    Suffixes of one group share cap places or all up to their separators.  Where the place before had a full prefix, the order behind it
    is not known to carry over, so the head of a group is then compared afresh.
    """
    n = len(raw)
    before = np.full(n, -1, np.int64)
    before[sa[1:]] = sa[:-1]
    text = np.zeros(n + cap + 16, np.uint8)
    text[:n] = raw
    eight = np.ndarray((n + cap + 8,), "<u8", text.data, strides=(1,))
    out = np.zeros(n, np.int64)
    heads = np.arange(0, n, lane)
    have = np.zeros(len(heads), np.int64)
    for t in range(lane):
        i = heads + t
        live = i < n
        if not live.all():
            heads, have, i = heads[live], have[live], i[live]
            if not len(i):
                break
        j = before[i]
        tie = (j >= 0) & (group[i] == group[j])
        have = np.where(have >= cap, 0, np.maximum(have - 1, 0))
        have[j < 0] = 0
        have[tie] = cap
        go = np.flatnonzero((j >= 0) & ~tie)
        while len(go):
            x = eight[i[go] + have[go]] ^ eight[j[go] + have[go]]
            same = x == 0
            low = x & (~x + U(1))
            have[go] += np.where(same, 8, np.log2(np.where(same, U(1), low).astype(np.float64)).astype(np.int64) >> 3)
            go = go[same & (have[go] < cap)]
        have = np.minimum(np.minimum(have, cap), np.minimum(room[i], room[j]))
        out[i] = have
    return out


def repeated_windows(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, length: int) -> np.ndarray:
    """For a text of regions [start, end) with a separator byte after each: which places start a window that also starts earlier in it."""
    n = len(raw)
    sym = raw.astype(np.uint16) + np.uint16(1)
    sym[ends] = 0
    room = np.zeros(n, np.int64)
    stop = np.repeat(ends, ends - starts + 1)
    room[:] = stop - np.arange(n)
    sa, group = suffix_array(sym, room, length)
    tied = common_prefixes(raw, sa, group, room, length)[sa] >= length
    heads = np.flatnonzero(~tied)
    group = np.cumsum(~tied) - 1  # classes of equal windows
    out = np.zeros(n, bool)
    if n:
        out[sa] = sa != np.minimum.reduceat(sa, heads)[group]
    return out


# ---------------------------------------------------------------- the shards' steps
#: Low bits of the order of rows of one id that number equal rows; the rest are the text's hash.
SAME_BITS = 24


def _ordered(table: pa.Table) -> tuple[np.ndarray, np.ndarray, list[bytes], list[int]]:
    """Ids, places among rows of one id, and bytes of a shard's documents, ordered by these; and that order."""
    ids = np.array([-(2**63) if x is None else x for x in table.column("doc_id").to_pylist()], np.int64)
    seq = table.column("h").to_numpy() >> SAME_BITS << SAME_BITS
    body = [b"" if x is None else x for x in table.column("text").cast(pa.large_binary()).to_pylist()]
    order = np.lexsort((seq, ids)).tolist()
    if len(order) and ((np.diff(ids[order]) == 0) & (np.diff(seq[order]) == 0)).any():
        order = sorted(range(len(ids)), key=lambda i: (ids[i], seq[i], body[i]))
    ids, seq = ids[order], seq[order]
    if len(ids):
        new = np.ones(len(ids), bool)
        new[1:] = (ids[1:] != ids[:-1]) | (seq[1:] != seq[:-1])
        seq = seq + np.arange(len(ids)) - np.maximum.accumulate(np.where(new, np.arange(len(ids)), 0))
    return ids, seq, [body[i] for i in order], order


def _runs(m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of runs of one anchor value."""
    edge = np.flatnonzero(m[1:] != m[:-1]) + 1
    return np.concatenate([[0], edge]), np.concatenate([edge, [len(m)]])


def _values_of(length: int, k: int, buckets: int):
    def step(table: pa.Table) -> pa.Table:
        s = table.column("s")[0].as_py()
        found = []
        for x in table.column("text").cast(pa.large_binary()).to_pylist():
            if x is not None and len(x) >= length:
                m, h = window_anchors(np.frombuffer(x, np.uint8), length, k)
                found.append(selected(m, h, length - k + 1))
        every = np.sort(np.concatenate(found)) if found else np.zeros(0, np.uint64)
        value, count = np.unique(every, return_counts=True)
        b = (value % U(buckets)).astype(np.int64)
        order = np.argsort(b, kind="stable")
        value, count, b = value[order], count[order], b[order]
        cuts = np.flatnonzero(np.diff(b, prepend=-1))
        ends = np.append(cuts[1:], len(b))
        return pa.table(
            {
                "b": pa.array(b[cuts], pa.int32()),
                "s": pa.array(np.full(len(cuts), s), pa.int32()),
                "once": pa.array([value[x:y][count[x:y] == 1].tobytes() for x, y in zip(cuts, ends)], pa.binary()),
                "more": pa.array([value[x:y][count[x:y] > 1].tobytes() for x, y in zip(cuts, ends)], pa.binary()),
            }
        )

    return step


def _shared_values(table: pa.Table) -> pa.Table:
    """For one bucket: which values of each shard are found in several shards, and which only in it, but more than once."""
    shard = table.column("s").to_numpy()
    parts, who, twice = [], [], []
    for i, (a, c) in enumerate(zip(table.column("once").to_pylist(), table.column("more").to_pylist())):
        for blob, more in ((a, False), (c, True)):
            v = np.frombuffer(blob, np.uint64)
            parts.append(v)
            who.append(np.full(len(v), i))
            twice.append(np.full(len(v), more))
    v, who, twice = np.concatenate(parts), np.concatenate(who), np.concatenate(twice)
    order = np.argsort(v, kind="stable")
    v, who, twice = v[order], who[order], twice[order]
    same = v[1:] == v[:-1]
    multi = np.zeros(len(v), bool)
    multi[1:] |= same
    multi[:-1] |= same
    out = {"s": [], "multi": [], "own": []}
    order = np.argsort(who, kind="stable")
    v, who, multi, twice = v[order], who[order], multi[order], twice[order]
    cuts = np.searchsorted(who, np.arange(len(shard) + 1))
    for i in range(len(shard)):
        x = slice(cuts[i], cuts[i + 1])
        far, own = v[x][multi[x]], v[x][twice[x] & ~multi[x]]
        if len(far) or len(own):
            out["s"].append(int(shard[i]))
            out["multi"].append(far.tobytes())
            out["own"].append(own.tobytes())
    return pa.table({"s": pa.array(out["s"], pa.int32()), "multi": pa.array(out["multi"], pa.binary()), "own": pa.array(out["own"], pa.binary())})


def _in(values: np.ndarray, among: np.ndarray) -> np.ndarray:
    if not len(among):
        return np.zeros(len(values), bool)
    at = np.minimum(np.searchsorted(among, values), len(among) - 1)
    return among[at] == values


_STEP = pa.schema([("b", pa.int32()), ("s", pa.int32()), ("ids", pa.binary()), ("seq", pa.binary()), ("pos", pa.binary()), ("cnt", pa.binary()), ("size", pa.int64()), ("body", pa.binary())])
_STEP_SQL = "b int, s int, ids binary, seq binary, pos binary, cnt binary, size long, body binary"


def _in_shard(length: int, k: int, buckets: int):
    """Suffix arrays of a shard.  Rows with body: windows for the buckets; rows without: windows to remove."""

    def step(docs: pa.Table, values: pa.Table) -> pa.Table:
        rows = {c: [] for c in _STEP.names}

        def put(b, ids, seq, pos, cnt, body=None):
            rows["b"].append(int(b))
            rows["s"].append(s)
            for name, v in (("ids", ids), ("seq", seq), ("pos", pos), ("cnt", cnt)):
                rows[name].append(np.asarray(v, np.int64).tobytes())
            rows["size"].append(None if body is None else len(body))
            rows["body"].append(None if body is None else pa.compress(body, codec="zstd", asbytes=True))

        if docs.num_rows and values.num_rows:
            s = docs.column("s")[0].as_py()
            multi = np.sort(np.concatenate([np.frombuffer(x, np.uint64) for x in values.column("multi").to_pylist()]))
            any_ = np.sort(np.concatenate([multi, *(np.frombuffer(x, np.uint64) for x in values.column("own").to_pylist())]))
            ids, seq, body, _ = _ordered(docs)
            blocks, now, size = [], [], 0
            for d, x in enumerate(body):
                if len(x) < length:
                    continue
                raw = np.frombuffer(x, np.uint8)
                m, _ = window_anchors(raw, length, k)
                a, e = _runs(m)
                keep = _in(m[a], any_)
                if not keep.any():
                    continue
                a, e, v = a[keep], e[keep], m[a[keep]]
                gap = np.flatnonzero(a[1:] > e[:-1] + length - 1) + 1
                ra, re = a[np.concatenate([[0], gap])], e[np.concatenate([gap - 1, [len(e) - 1]])] + length - 1
                cost = int((re - ra + 1).sum())
                if now and size + cost >= BLOCK:
                    blocks.append(now)
                    now, size = [], 0
                now.append((d, raw, a, e, v, ra, re))
                size += cost
            if now:
                blocks.append(now)
            for block in blocks:
                _block(block, ids, seq, multi if len(blocks) == 1 else any_, length, buckets, s, put)
        _text.give_back()
        return pa.Table.from_pydict(rows, schema=_STEP)

    return step


def _block(block, ids, seq, sent, length, buckets, s, put) -> None:
    pieces, starts, ends, owner, place, at = [], [], [], [], [], 0
    for d, raw, _, _, _, ra, re in block:
        for x, y in zip(ra, re):
            pieces += [raw[x:y], np.zeros(1, np.uint8)]
            starts.append(at)
            ends.append(at + y - x)
            owner.append(d)
            place.append(x)
            at += y - x + 1
    text = np.concatenate(pieces)
    starts, ends, owner, place = (np.array(x, np.int64) for x in (starts, ends, owner, place))
    gone = repeated_windows(text, starts, ends, length)
    flips = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(np.int8), [0]])))
    x, y = flips[::2], flips[1::2]
    if len(x):
        r = np.searchsorted(starts, x, "right") - 1
        put(s % buckets, ids[owner[r]], seq[owner[r]], place[r] + x - starts[r], y - x)
    # windows that are first here, by runs of one value
    doc = np.concatenate([np.full(len(t[2]), t[0]) for t in block])
    a, e, v = (np.concatenate([t[i] for t in block]) for i in (2, 3, 4))
    keep = _in(v, sent)
    doc, a, e, v = doc[keep], a[keep], e[keep], v[keep]
    if not len(a):
        return
    # region of each run: regions are ordered by document and place
    span = int(place.max()) + len(text) + 1
    r = np.searchsorted(owner * span + place, doc * span + a, "right") - 1
    p, q = starts[r] + a - place[r], starts[r] + e - place[r]
    here = np.concatenate([[0], np.cumsum(~gone)])
    some = here[q] > here[p]
    doc, a, v, p, q = doc[some], a[some], v[some], p[some], q[some]
    fresh = np.flatnonzero(~gone)
    lo, hi = fresh[np.searchsorted(fresh, p)], fresh[np.searchsorted(fresh, q) - 1] + 1
    b = (v % U(buckets)).astype(np.int64)
    order = np.argsort(b, kind="stable")
    cuts = np.append(np.flatnonzero(np.diff(b[order], prepend=-1)), len(order))
    view = text.tobytes()
    for x, y in zip(cuts[:-1], cuts[1:]):
        o = order[x:y]
        put(b[o[0]], ids[doc[o]], seq[doc[o]], a[o] + lo[o] - p[o], hi[o] - lo[o], b"".join(view[i : j + length - 1] for i, j in zip(lo[o].tolist(), hi[o].tolist())))


def _unequal(text: np.ndarray, starts: np.ndarray, one: np.ndarray, other: np.ndarray, length: int) -> np.ndarray:
    """Places in one (numbers of windows) whose bytes differ from those of the windows in other.

    Where the windows before were compared too, and both follow them in the text, only the last byte is left to compare.
    """
    if not len(one):
        return one
    p, q = starts[one], starts[other]
    after = np.zeros(len(one), bool)
    after[1:] = (p[1:] == p[:-1] + 1) & (q[1:] == q[:-1] + 1)
    bad = text[p + length - 1] != text[q + length - 1]
    heads = np.flatnonzero(~after)
    for lo in range(0, len(heads), 1 << 16):
        h = heads[lo : lo + (1 << 16)]
        span = np.arange(length)
        bad[h] |= (text[p[h, None] + span] != text[q[h, None] + span]).any(axis=1)
    return np.flatnonzero(bad)


def _classes(text: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """For each window (in the order of documents) the number of the first that is equal to it."""
    key = _text.span_hashes(text, starts, starts + length)
    directory = np.sort(key)
    directory = directory[np.concatenate([[True], directory[1:] != directory[:-1]])]
    at = np.searchsorted(directory, key)
    first = np.empty(len(directory), np.int64)
    first[at[::-1]] = np.arange(len(key))[::-1]
    first = first[at]
    again = np.flatnonzero(first != np.arange(len(key)))
    wrong = again[_unequal(text, starts, again, first[again], length)]
    if len(wrong):  # strings that share a fingerprint
        seen: dict[bytes, int] = {}
        for i in np.flatnonzero(_in(key, np.unique(key[wrong]))).tolist():
            first[i] = seen.setdefault(text[starts[i] : starts[i] + length].tobytes(), i)
    return first


def _merge(length: int):
    """One bucket: finds the shards' windows in the merged directory; passes on what the shards removed themselves."""

    def step(table: pa.Table) -> pa.Table:
        own = table.column("body").is_null().to_pylist()
        got = {c: table.column(c).to_pylist() for c in _STEP.names}
        out = {"s": [], "ids": [], "seq": [], "pos": [], "cnt": []}
        runs = []
        for i, done in enumerate(own):
            if done:
                for c in out:
                    out[c].append(got[c][i])
            else:
                runs.append(i)
        if len(runs) > 1:
            ids, seq, pos, cnt = (np.concatenate([np.frombuffer(got[c][i], np.int64) for i in runs]) for c in ("ids", "seq", "pos", "cnt"))
            shard = np.concatenate([np.full(len(got["ids"][i]) // 8, got["s"][i]) for i in runs])
            text = np.concatenate([np.frombuffer(pa.decompress(got["body"][i], got["size"][i], codec="zstd", asbytes=True), np.uint8) for i in runs])
            head = np.concatenate([[0], np.cumsum(cnt + length - 1)[:-1]])
            order = np.lexsort((pos, seq, ids))
            ids, seq, pos, cnt, shard, head = (x[order] for x in (ids, seq, pos, cnt, shard, head))
            first = np.concatenate([[0], np.cumsum(cnt)])
            starts = np.arange(first[-1]) - np.repeat(first[:-1], cnt) + np.repeat(head, cnt)
            gone = _classes(text, starts, length) != np.arange(len(starts))
            # runs of removed windows within one context
            edge = gone.astype(np.int8)
            begin = edge.copy()
            begin[1:] &= ~edge[:-1] & 1
            begin[first[:-1]] = edge[first[:-1]]
            stop = edge.copy()
            stop[:-1] &= ~edge[1:] & 1
            stop[first[1:] - 1] = edge[first[1:] - 1]
            x, y = np.flatnonzero(begin), np.flatnonzero(stop) + 1
            c = np.searchsorted(first, x, "right") - 1
            by = np.argsort(shard[c], kind="stable")
            x, y, c = x[by], y[by], c[by]
            cuts = np.append(np.flatnonzero(np.diff(shard[c], prepend=-1)), len(c))
            for i, j in zip(cuts[:-1], cuts[1:]):
                o = slice(i, j)
                out["s"].append(int(shard[c[i]]))
                for name, v in (("ids", ids[c[o]]), ("seq", seq[c[o]]), ("pos", pos[c[o]] + x[o] - first[c[o]]), ("cnt", y[o] - x[o])):
                    out[name].append(np.asarray(v, np.int64).tobytes())
        _text.give_back()
        return pa.table({"s": pa.array(out["s"], pa.int32())} | {c: pa.array(out[c], pa.binary()) for c in ("ids", "seq", "pos", "cnt")})

    return step


_OUT_SQL = "doc_id long, n_bytes long, n_removed long, spans array<struct<start:long,end:long>>, kept_text binary"


def _char_start(x: bytes, i: int) -> bool:
    return i >= len(x) or x[i] & 0xC0 != 0x80


def _cut_out(length: int, keep_text: bool, whole_chars: bool, carry: list[str]):
    spans = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def step(docs: pa.Table, gone: pa.Table) -> pa.Table:
        ids, seq, body, rows = _ordered(docs) if docs.num_rows else (np.zeros(0, np.int64), np.zeros(0, np.int64), [], [])
        by: dict[tuple[int, int], list] = {}
        if gone.num_rows:
            gi, gs, gp, gc = (np.concatenate([np.frombuffer(x, np.int64) for x in gone.column(c).to_pylist()]) for c in ("ids", "seq", "pos", "cnt"))
            order = np.lexsort((gp, gs, gi))
            gi, gs, gp, gc = (x[order] for x in (gi, gs, gp, gc))
            cuts = np.append(np.flatnonzero(np.concatenate([[True], (gi[1:] != gi[:-1]) | (gs[1:] != gs[:-1])])), len(gi))
            for x, y in zip(cuts[:-1], cuts[1:]):
                by[int(gi[x]), int(gs[x])] = (gp[x:y], gp[x:y] + gc[x:y] + length - 1)
        n_removed, lists, kept = [], [], []
        for d, x in enumerate(body):
            if (at := by.get((int(ids[d]), int(seq[d])))) is None:
                n_removed.append(0)
                lists.append([])
                kept.append(x)
                continue
            a, e = at
            top = np.maximum.accumulate(e)
            new = np.concatenate([[True], a[1:] > top[:-1]])
            sa, se = a[new], top[np.append(np.flatnonzero(new)[1:] - 1, len(top) - 1)]
            if whole_chars:  # a character that is not removed whole stays whole
                for i in range(len(sa)):
                    while sa[i] < se[i] and not _char_start(x, sa[i]):
                        sa[i] += 1
                    while se[i] > sa[i] and not _char_start(x, se[i]):
                        se[i] -= 1
            n_removed.append(int((se - sa).sum()))
            lists.append([{"start": int(i), "end": int(j)} for i, j in zip(sa, se)])
            kept.append(b"".join(x[i:j] for i, j in zip([0, *se.tolist()], [*sa.tolist(), len(x)])))
        none = -(2**63)
        return pa.table(
            {
                "doc_id": pa.array([None if i == none else int(i) for i in ids], pa.int64()),
                "n_bytes": pa.array([len(x) for x in body], pa.int64()),
                "n_removed": pa.array(n_removed, pa.int64()),
                "spans": pa.array(lists, spans),
                "kept_text": pa.array(kept if keep_text else [hashlib.sha256(x).hexdigest().encode() for x in kept], pa.binary()),
            }
            | ({c: docs.column("_" + c).take(pa.array(rows, pa.int64())) for c in carry} if docs.num_rows else {c: pa.nulls(0) for c in carry})
        )

    return step


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = 100, digest_only: bool = False, whole_chars: bool = False, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_bytes, n_removed, spans (removed byte runs), kept_text (the bytes left, or their SHA-256 in hex with digest_only), and the columns to carry.

    With whole_chars the runs are narrowed to whole characters, so that what is left is valid UTF-8.
    """
    k = GRAM
    while k > length:
        k //= 2
    n = shard_count(docs, text, 2 << 20)
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    dealt = docs.select(*(F.col(c).alias("_" + c) for c in carry), F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), F.xxhash64(F.col(text)).alias("h"))
    dealt = dealt.withColumn("s", F.pmod(F.xxhash64("doc_id", "h"), F.lit(n)).cast("int"))
    values = dealt.groupBy("s").applyInArrow(_values_of(length, k, n), "b int, s int, once binary, more binary")
    shared = values.groupBy("b").applyInArrow(_shared_values, "s int, multi binary, own binary")
    steps = dealt.groupBy("s").cogroup(shared.groupBy("s")).applyInArrow(_in_shard(length, k, n), _STEP_SQL)
    gone = steps.groupBy("b").applyInArrow(_merge(length), "s int, ids binary, seq binary, pos binary, cnt binary")
    return dealt.groupBy("s").cogroup(gone.groupBy("s")).applyInArrow(_cut_out(length, not digest_only, whole_chars, list(carry)), ", ".join([_OUT_SQL, *(f"`{c}` {kinds[c]}" for c in carry)]))


def op9_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = remove_repeats(docs, digest_only=True)
    return out.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.col("kept_text").cast("string").alias("kept_sha256"))
