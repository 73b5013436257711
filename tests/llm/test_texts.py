"""Operators against brute-force versions, exact round trips and the tokenizers library; then tables of hard cases."""

import base64
import collections
import hashlib
import os
import random
import re
import struct
import uuid

import numpy as np
import pytest
import xxhash

from rankflow.llm import bpe, fingerprints, language_id, licenses, mixing, ngram_join, quality_rules, suffix_dedup, toxicity, warc

WORD = re.compile("[^\x20\x09-\x0d]+")
HARD = [
    (1, None, None, None, 0),
    (2, "", "en", "a", 0),
    (3, " \n\t ", "en", "a", 4),
    (4, "word", "en", None, 4),
    (5, "same text of more than four words here", "en", "a", 38),
    (6, "same text of more than four words here", "fr", "b", 38),
    (7, "é😀 中文 \x0b #* '' !!'s <|endoftext|> ß", "fr", "b", 20),
    (8, "long " * 60_000, "en", "a", 300_000),
    (9, "q" * 5_000, "en", "b", 5_000),
    (None, "a row without an id has some words too", "en", "a", 38),
    (5, "same text of more than four words here", "en", "a", 38),
    (5, "another text under an id that is there already", "en", "a", 46),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def hard(spark):
    df = spark.createDataFrame(HARD, SCHEMA)
    # columns whose names the operators use themselves
    return df.selectExpr("*", "1 AS s", "2 AS b", "'x' AS part", "3 AS size", "4 AS n")


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def made(seed, n, words=60):
    """Copies of a few texts with a few words changed."""
    rnd = random.Random(seed)
    pool = [f"w{i}" for i in range(words)]
    base = [[rnd.choice(pool) for _ in range(rnd.choice([1, 3, 4, 6, 9, 12, 14, 20, 40, 90]))] for _ in range(n // 25)]
    rows = []
    for i in range(n):
        b = list(rnd.choice(base)) if i % 3 else list(base[0])
        for _ in range(rnd.randint(0, 4)):
            p, r = rnd.randrange(len(b) + 1), rnd.random()
            if r < 0.35 and b:
                b[min(p, len(b) - 1)] = rnd.choice(pool)
            elif r < 0.65:
                b.insert(p, rnd.choice(pool))
            elif b:
                b.pop(min(p, len(b) - 1))
        rows.append((i, " ".join(x.upper() if rnd.random() < 0.1 else x for x in b)))
    return rows


# ---------------------------------------------------------------- 1: fingerprints
def test_fingerprints_estimate_jaccard():
    rnd, texts = random.Random(4), []
    base = [f"t{i}" for i in range(400)]
    for cut in (0, 5, 20, 80, 200):
        texts.append(" ".join(base[: 400 - cut] + [f"u{rnd.random()}" for _ in range(cut)]))
    prints = fingerprints.fingerprints(fingerprints._text.text_array(__import__("pyarrow").array(texts)))
    grams = [{tuple(t.split()[i : i + 5]) for i in range(396)} for t in texts]
    for i in range(5):
        want = len(grams[0] & grams[i]) / len(grams[0] | grams[i])
        assert abs(fingerprints.likeness(prints[0], prints[i]) - want) < 0.12


def test_fingerprint_query_on_hard_rows(hard, none):
    rows = fingerprints.compare_with_edited(hard).collect()
    assert len(rows) == len(HARD)
    same = [r.fingerprint for r in rows if r.n_chars == 38 and r.doc_id in (5, 6)]
    assert len(same) == 3 and len(set(same)) == 1
    order = sorted(HARD, key=lambda r: (-(r[0] if r[0] is not None else -(2**63)), r[1] or ""))
    want = []
    for k, r in enumerate(order):
        t, nxt = r[1] or "", order[(k + 1) % len(order)][1] or ""
        half = len(t) // 2
        want.append((r[0], len(t), hashlib.sha256((t[: len(t) - half] + nxt[:half]).encode()).hexdigest()))
    assert sorted(map(str, want)) == sorted(str((r.doc_id, r.n_chars, r.edited_sha256)) for r in rows)
    assert fingerprints.compare_with_edited(none).count() == 0


# ---------------------------------------------------------------- 2: BPE
@pytest.fixture(scope="module")
def tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    return path, Tokenizer.from_file(path)


def test_bpe_equals_the_library(tokenizer):
    path, tok = tokenizer
    rnd = random.Random(3)
    alphabet = "abcdefghij eé'ñ😀中12__!?$ßİΣ́ \n\x0b<|endoftext|>"
    texts = ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 60))) for _ in range(1000)]
    texts += ["<|endoftext|>hi <|startoftext|>x", "it's we'll '' !!'s _a_ İstanbul ΑΣ", "".join(rnd.choice("abcdefgh") for _ in range(20_000)), "a" * 3001, "中" * 500 + "!" * 701]
    ids, said = bpe.WordCodec(open(path).read()).encode_batch(texts)
    for t, i, s in zip(texts, ids, said):
        e = tok.encode(t, add_special_tokens=False).ids
        assert struct.pack(f"<{len(e)}I", *e) == i and tok.decode(e, skip_special_tokens=False) == s


def test_bpe_with_more_words_than_the_cache_holds(tokenizer, monkeypatch):
    path, tok = tokenizer
    monkeypatch.setattr(bpe, "CACHE_WORDS", 8)
    codec = bpe.WordCodec(open(path).read())
    for texts in (["one two three"], ["one four five six seven eight nine ten eleven", "two twelve"], ["one two"], [""]):
        for t, i in zip(texts, codec.encode_batch(texts)[0]):
            e = tok.encode(t, add_special_tokens=False).ids
            assert struct.pack(f"<{len(e)}I", *e) == i


def test_bpe_on_hard_rows(hard, none, tokenizer):
    path, tok = tokenizer
    got = sorted((str(r.doc_id), bytes(r.ids)) for r in bpe.encode(hard, path).collect())
    want = []
    for r in HARD:
        e = tok.encode(r[1] or "", add_special_tokens=False).ids
        want.append((str(r[0]), struct.pack(f"<{len(e)}I", *e)))
    assert got == sorted(want)
    assert bpe.encode(none, path).count() == 0


def test_bpe_leaves_in_parallel(spark, tokenizer, monkeypatch):
    """Very long unsplit words as rows of leaves, among plain texts, equal rows and null ids."""
    path, tok = tokenizer
    monkeypatch.setattr(bpe, "LONG_RUN", 300)
    monkeypatch.setattr(bpe, "LEAF_ROW", 16)
    rnd = random.Random(11)
    run = lambda n, of="abcdefgh": "".join(rnd.choice(of) for _ in range(n))
    texts = ["plain text", "", None, run(300), "before " + run(700) + " between " + run(900, "!?-") + "<|endoftext|>after", "é中" * 400, "a" * 1001, run(5000)]
    rows = [(i if i % 3 else None, t, i) for i, t in enumerate(texts)] + [(9, texts[3], 1)] * 2
    df = spark.createDataFrame(rows, "doc_id long, text string, extra int")
    got = sorted((str(r.doc_id), r.extra, bytes(r.ids), r.decoded) for r in bpe.encode(df, path, keep=["extra"]).collect())
    want = []
    for i, t, x in rows:
        e = tok.encode(t or "", add_special_tokens=False).ids
        want.append((str(i), x, struct.pack(f"<{len(e)}I", *e), tok.decode(e, skip_special_tokens=False)))
    assert got == sorted(want)


# ---------------------------------------------------------------- 3: WARC
def test_warc_round_trip_by_any_split(spark):
    rnd = random.Random(5)
    rows = [(i, None if i % 9 == 0 else f"http://x/{i}\r\n", rnd.choice([None, "", "<p>a</p>", "x" * rnd.randint(0, 9000)])) for i in range(300)] + [(None, "u", "alone")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    folder = f"{warc.shared_dir(spark)}/test-warc-{uuid.uuid4().hex}"  # the shared folder may outlive a run
    manifest = warc.write_warc(warc.with_revisits(pages), folder, roll_bytes=20_000)
    cols = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    whole = sorted(map(str, warc.read_warc(manifest).select(*cols).collect()))
    assert whole == sorted(map(str, warc.read_warc(manifest, split_bytes=700).select(*cols).collect()))
    first: dict[str, int] = {}
    for i, _, h in rows:
        if i is not None:
            first[h or ""] = min(first.get(h or "", i), i)
    for r in warc.read_warc(manifest).collect():
        h = next((x[2] or "" for x in rows if x[0] == r.page_id))
        assert r.payload_bytes == len(h) and r.payload_digest == base64.b32encode(hashlib.sha1(h.encode()).digest()).decode()
        lead = first.get(h, r.page_id)
        assert (r.record_type, r.refers_to) == (("response", None) if lead == r.page_id else ("revisit", lead))
    assert warc.archive_files(spark, folder).count() == manifest.count()
    assert warc.read_warc(warc.write_warc(warc.with_revisits(pages.limit(0)), folder + "-none")).count() == 0


def test_warc_hard_rows(spark, monkeypatch):
    """One payload in most rows, repeated and null ids, a very long payload, columns of other names."""
    monkeypatch.setattr("rankflow.llm._spark.SHARE", 7)
    rnd = random.Random(6)
    long = "".join(rnd.choice("abcdefghijklmnop") for _ in range(1_500_000))
    rows = [(i, "u", "hot") for i in range(100, 200)] + [(50, None, "hot"), (50, "u", "hot"), (None, "u", "hot"), (1, "u", None), (2, "u", ""), (3, "u", long), (4, "u", long)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'x' AS sha", "1 AS first", "2 AS c", "'p' AS payload")
    folder = f"{warc.shared_dir(spark)}/test-warc-{uuid.uuid4().hex}"
    got = warc.read_warc(warc.write_warc(warc.with_revisits(pages), folder), split_bytes=100_000).collect()
    assert sorted((str(r.page_id), r.record_type, r.refers_to, r.payload_bytes) for r in got) == sorted(
        [(str(i), "revisit", 50, 3) for i in [*range(100, 200), None]] + [("50", "response", None, 3)] * 2 + [("1", "response", None, 0), ("2", "revisit", 1, 0), ("3", "response", None, len(long)), ("4", "revisit", 3, len(long))]
    )


# ---------------------------------------------------------------- 4: n-gram join
def components(rows, k=4, num=85, den=100):
    sets = {}
    for i, t in rows:
        w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in (t or "")))
        sets[i] = frozenset(tuple(w[x : x + k]) for x in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for x, i in enumerate(ids):
        for j in ids[:x]:
            both = len(sets[i] & sets[j])
            if both and den * both >= num * (len(sets[i]) + len(sets[j]) - both):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in sets}


@pytest.mark.parametrize("seed", [1, 2])
def test_join_equals_brute_force(spark, seed):
    rows = made(seed, 500)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.similar_classes(df).collect()} == components(rows)


def test_join_on_hard_rows(hard, none):
    got = collections.Counter((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.similar_classes(hard).collect())
    assert sum(got.values()) == len(HARD)
    assert got[5, 5, 5] == 2 and got[6, 5, 5] == 1 and got[1, 0, 1] == 1 and got[3, 0, 3] == 1 and got[4, 1, 4] == 1
    assert ngram_join.similar_classes(none).count() == 0


def templated(n, seed=3):
    """Ten of forty fixed sentences each: very frequent shingles, hardly any link."""
    rnd = random.Random(seed)
    stock = [" ".join(f"{rnd.choice('abcdefgh')}{rnd.randrange(500)}" for _ in range(12)) for _ in range(40)]
    return [(i, " ".join(rnd.sample(stock, 10))) for i in range(n)]


def test_unlinked_members_of_long_lists_hardly_meet(spark, monkeypatch):
    pairs, verified = [], ngram_join._verified
    monkeypatch.setattr(ngram_join, "_verified", lambda p, *more: (pairs.append(p.count()), verified(p, *more))[1])
    rows = templated(600) + [(10_000 + i, t) for i, t in made(9, 100)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.similar_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == components(rows)
    small = sum(pairs)
    pairs.clear()
    assert ngram_join.similar_classes(spark.createDataFrame(templated(2400), "doc_id long, text string")).count() == 2400
    assert sum(pairs) <= 6 * small, (sum(pairs), small)


def test_parts_of_linked_sets_meet():
    rng = np.random.default_rng(1)
    for n in (1, 5, 12, 40, 200):
        for _ in range(40):
            a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
            b = np.unique(np.concatenate([rng.permutation(a)[rng.integers(0, 1 + n // 6) :], rng.integers(0, 2**63, rng.integers(0, 1 + n // 8)).astype(np.uint64)]))
            both = len(np.intersect1d(a, b))
            if both and 100 * both >= 85 * (len(a) + len(b) - both):
                assert set(ngram_join.parts_of(a, len(a), 85, 100).tolist()) & set(ngram_join.parts_of(b, len(b), 85, 100).tolist())


def test_hot_keys_are_dealt(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "SHARE", 5)
    monkeypatch.setattr(ngram_join, "LONG", 6)
    rows = made(4, 300)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.similar_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()} == components(rows)


def test_boundary_follows_the_cost():
    assert ngram_join.choose_boundary({}, 85, 100) == 0
    assert 0 < ngram_join.choose_boundary({n: 100 for n in range(1, 25)}, 85, 100) < 24


# ---------------------------------------------------------------- 9: suffix arrays
def without_repeats(rows, length):
    seen, out = set(), {}
    for i, t in sorted(rows):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1):
            if b[p : p + length] in seen:
                gone[p : p + length] = b"\1" * length
            seen.add(b[p : p + length])
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out[i] = (len(b), sum(gone), sum(1 for j in range(len(b)) if gone[j] and not (j and gone[j - 1])), hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("length", [100, 40])
def test_repeats_equal_brute_force(spark, length):
    rnd = random.Random(1)
    pool = ["".join(rnd.choice("abc é") for _ in range(rnd.randint(80, 400))) for _ in range(6)]
    rows = [(i, "".join(rnd.choice(["".join(rnd.choice("abcdefgh ") for _ in range(rnd.randint(0, 200))), rnd.choice(pool)[rnd.randint(0, 40) :], "x" * rnd.choice([0, 50, 150, 300])]) for _ in range(rnd.randint(0, 4))) if i % 37 else None) for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_bytes, r.n_removed, len(r.spans), r.kept_text.decode()) for r in suffix_dedup.remove_repeats(df, length=length, digest_only=True).collect()}
    assert got == without_repeats(rows, length)


def test_fingerprints_that_strings_share_remove_nothing(monkeypatch):
    """With very few fingerprints windows are told apart by their bytes."""
    rng = np.random.default_rng(3)
    text = rng.integers(97, 99, 4000).astype(np.uint8)
    starts = np.arange(len(text) - 12)
    hashes = suffix_dedup._text.span_hashes
    monkeypatch.setattr(suffix_dedup._text, "span_hashes", lambda *x: hashes(*x) % np.uint64(37))
    seen, want = {}, []
    for i in starts.tolist():
        want.append(seen.setdefault(text[i : i + 12].tobytes(), i))
    assert suffix_dedup._classes(text, starts, 12).tolist() == want


def test_rows_of_one_id_are_ordered_and_dealt(spark):
    """A third of the rows has no id: each is a document, and of each passage one copy stays."""
    rnd = random.Random(4)
    passage = "".join(rnd.choice("abcdefgh ") for _ in range(150))
    rows = [(None if i % 3 else i, f"{i:05d}" * 10 + passage) for i in range(120)] + [(None, "twice " * 40)] * 3
    got = suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    kept = [bytes(r.kept_text).decode() for r in got]
    assert len(got) == len(rows) and sum(passage in k for k in kept) == 1
    assert sum("twice" in k for k in kept) == 1


def test_suffix_array_is_sorted():
    rng = np.random.default_rng(2)
    raw = rng.integers(97, 99, 3000).astype(np.uint8)
    sym = np.append(raw.astype(np.uint16) + 1, 0).astype(np.uint16)
    sa, _ = suffix_dedup.suffix_array(sym, len(raw) - np.arange(len(sym)), 4096)
    text = raw.tobytes()
    assert [int(x) for x in sa if x < len(text)] == sorted(range(len(text)), key=lambda i: text[i:])


def test_repeats_on_hard_rows(hard, none):
    rows = suffix_dedup.remove_repeats(hard, whole_chars=True, carry=("lang", "n")).collect()
    assert len(rows) == len(HARD) and all(bytes(r.kept_text).decode() is not None and r.n == 4 for r in rows)
    assert {r.doc_id: r.n_removed for r in rows if r.doc_id in (8, 9)} == {8: 299_995, 9: 4_999}
    assert suffix_dedup.remove_repeats(none).count() == 0


# ---------------------------------------------------------------- 6: quality rules
def base(t):
    t = t or ""
    w, seen, dup = WORD.findall(t), set(), 0
    for line in t.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    c, cov = collections.Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7)), set()
    for i in range(len(w) - 7):
        if c[tuple(w[i : i + 8])] > 1:
            cov.update(range(i, i + 8))
    return len(w), sum(map(len, w)), sum(x in "#*$%&|<>" for x in t), dup, len(cov)


def test_counts_equal_brute_force(spark, hard):
    extra = [" a\tb\x0bc\x0c\r\n  a b\n\n a b", "x y z w " * 10, "é# *", "a b c it's \\n 'q'\nf\nf", "f" * 9]
    rows = [(i, t) for i, t in enumerate([r[1] for r in HARD] + extra)]
    got = {r.doc_id: tuple(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) for r in quality_rules.with_counts(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: base(t) for i, t in rows}


def test_judging_keeps_the_trusted_kind(spark, hard, none):
    rnd = random.Random(6)
    good, bad = [f"g{i}" for i in range(200)], [f"b{i}" for i in range(200)]
    rows = [(i, " ".join(rnd.choice(good if i % 4 else bad) for _ in range(80))) for i in range(200)]
    docs, trusted = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(i,) for i in range(200) if i % 4 == 1], "doc_id long")
    kept = {r.doc_id: r.kept for r in quality_rules.judge(docs, trusted).collect()}
    assert all(kept[i] == bool(i % 4) for i in kept)
    assert len(quality_rules.judge(hard, trusted).collect()) == len(HARD)
    assert quality_rules.judge(none, trusted).count() == 0


# ---------------------------------------------------------------- 7: mixing
def test_targets():
    assert mixing.targets([100, 100, 100]) == [200, 450 * 0.25 * 250 / 112.5 * 2 / 3, 250 / 3] or sum(mixing.targets([100, 100, 100])) == pytest.approx(450)
    for sizes in ([1, 1000, 10, 0], [5], [], [10, 10, 10, 10, 10]):
        got = mixing.targets(sizes)
        assert all(g <= 2 * s + 1e-9 for g, s in zip(got, sizes)) and sum(got) == pytest.approx(1.5 * sum(sizes))


def test_mix_meets_its_targets(spark):
    rnd = random.Random(7)
    rows = [(i, " ".join("w" for _ in range(rnd.randint(0, 300))), None if i % 11 == 0 else f"s{rnd.choice([0, 0, 0, 1, 2, 3])}") for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    m = mixing.Mixture(df)
    got = m.taken().collect()
    assert len(got) == 600 and sorted(map(tuple, got)) == sorted(map(tuple, mixing.Mixture(df).taken().collect()))
    size = {i: len(t.split()) for i, t, _ in rows}
    of = {i: s for i, _, s in rows}
    taken, target = collections.Counter(), {}
    for r in got:
        assert r["size"] == size[r.doc_id] and 0 <= r.taken <= 2 * r["size"]
        taken[of[r.doc_id]] += r.taken
        target[of[r.doc_id]] = r.target
    assert all(abs(taken[s] - target[s]) <= 2 * mixing.BLOCK for s in target)
    slots = m.slots.collect()
    assert sorted(r.slot for r in slots) == list(range(len(slots)))
    out = m.output().groupBy("doc_id").sum("n").collect()
    assert {r[0]: r[1] for r in out} == {r.doc_id: r.taken for r in got if r.taken}


def xx(*values):
    """The engine's hash of several columns: longs of 8 bytes, ints of 4, strings."""
    h = 42
    for v in values:
        h = xxhash.xxh64_intdigest(v.encode() if isinstance(v, str) else struct.pack("<i" if isinstance(v, I) else "<q", v), h)
    return h - 2**64 if h >= 2**63 else h


class I(int):  # noqa: E742
    """A column of 32 bits."""


def place(i, n, *key):
    """Swap-or-not, by the book."""
    for r in range(mixing.ROUNDS):
        y = (xx(*key, I(r), "k") % n - i) % n
        if xx(*key, I(r), max(i, y)) & 1:
            i = y
    return i


def test_mix_equals_a_replay(spark, monkeypatch):
    """Draws, corrections, permutations and blocks, one by one in plain Python."""
    monkeypatch.setattr(mixing, "SHARD_SLOTS", 32)
    rnd = random.Random(17)
    rows = [(i, " ".join("w" for _ in range(rnd.randint(0, 90))), rnd.choice(["a", "a", "a", "b", "c", None])) for i in range(150)]
    m = mixing.Mixture(spark.createDataFrame(rows, "doc_id long, text string, source string"), block=8)
    plan = sorted(m.plan.collect(), key=lambda r: r.sid)
    due, blocks, total = [r.slots for r in plan], [r.blocks for r in plan], sum(r.slots for r in plan)
    threshold, alias = mixing.alias_table(due)
    drawn = []
    for slot in range(total):
        b = xx("mix", slot, "bin") % len(due)
        drawn.append(b if ((xx("mix", slot, "toss") % 2**64) >> 11) / 2**53 < threshold[b] else alias[b])
    got, spare, where = [0] * len(due), [], {}
    for sid in range(len(due)):
        for slot in (x for x in range(total) if drawn[x] == sid):
            if got[sid] < due[sid]:
                where[slot] = (sid, got[sid])
                got[sid] += 1
            else:
                spare.append(slot)
    for sid in range(len(due)):
        while got[sid] < due[sid]:
            where[spare.pop(0)] = (sid, got[sid])
            got[sid] += 1
    assert not spare
    want = {x: (x // 32, sid, j // blocks[sid], place(j % blocks[sid], blocks[sid], "mix", I(sid), j // blocks[sid])) for x, (sid, j) in where.items()}
    assert {r.slot: (r.shard, r.sid, r["pass"], r.block) for r in m.slots.collect()} == want
    uses = collections.Counter((sid, b) for _, sid, _, b in want.values())
    taken = collections.Counter()
    for r in m.docs.collect():
        for word in range(r.start, r.start + r["size"]):
            taken[r.doc_id] += uses[r.sid, word // 8]
    assert {r.doc_id: r.taken for r in m.taken().collect()} == {i: taken[i] for i, *_ in rows}


def test_alias_table_has_the_shares():
    for weights in ([1], [5, 2, 1, 0, 7], [3] * 9):
        threshold, alias = mixing.alias_table(weights)
        share = [sum((threshold[b] if b == i else 0) + (1 - threshold[b] if alias[b] == i else 0) for b in range(len(weights))) / len(weights) for i in range(len(weights))]
        assert share == pytest.approx([w / sum(weights) for w in weights])


def test_mix_on_hard_rows(hard, none):
    assert mixing.Mixture(hard.drop("size", "part", "s", "n")).taken().count() == len(HARD)
    assert mixing.Mixture(none).taken().count() == 0


# ---------------------------------------------------------------- 8: licences
def test_licences(spark, hard, none):
    rows = [(1, "MIT Licence\n\nCopyright (c) 2020 Jane\n\n" + licenses._MIT.upper()), (2, "text\nreleased under the  MIT license\nmore"), (3, None), (4, "no licence here")]
    got = {r.doc_id: (r.license, r.notices) for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: ("MIT", None), 2: (None, "MIT"), 3: (None, None), 4: (None, None)}
    rows = [(1, "Released under the MIT License."), (1, "nothing here"), (None, "# SPDX-License-Identifier: Apache-2.0\n\nlicensed under CC BY-NC 4.0"), (2, licenses._ZLIB)]
    got = [(r.license, r.notices) for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert got == [(None, "MIT"), (None, None), (None, "Apache-2.0,CC-BY-NC-4.0"), ("Zlib", None)]
    assert licenses.scan(hard).count() == len(HARD) and licenses.scan(none).count() == 0


def test_known_licences_are_those_of_the_system():
    for name, file in (("GPL-3.0", "GPL-3"), ("Apache-2.0", "Apache-2.0"), ("MPL-2.0", "MPL-2.0")):
        path = f"/usr/share/common-licenses/{file}"
        if not os.path.exists(path):
            pytest.skip("no licence texts here")
        text = open(path).read()
        for t in (text, text.upper().replace("\n", " \n\n")):
            assert hashlib.sha256(licenses.canonical(t).encode()).hexdigest() == licenses.DIGESTS[name]


def test_columns_of_the_names_that_are_made(spark, hard):
    """They give way to what is made."""
    odd = hard.selectExpr("doc_id", "text", "'x' AS score", "'y' AS lang_pred", "'z' AS accepted", "0 AS fingerprint", "1 AS cross_entropy")
    got = language_id.identify(odd, language_id.Models()).columns
    assert sorted(got) == sorted(set(got)) and language_id.identify(odd, language_id.Models()).count() == len(HARD)
    assert {r.score for r in toxicity.score(odd, None).collect()} == {0.0}
    got = fingerprints.with_fingerprint(odd).collect()
    assert len(got) == len(HARD) and all(isinstance(r.fingerprint, str) for r in got)


# ---------------------------------------------------------------- 5 and 10: learnt operators
def test_language_id(spark, hard, none):
    rnd = random.Random(8)
    stock = {"aa": ["the", "and", "thing", "with", "oning"], "bb": ["eaux", "les", "dans", "être", "quoi"]}
    rows = [(i, " ".join(rnd.choice(stock[lang]) for _ in range(30)), lang) for i, lang in ((i, ("aa", "bb")[i % 2]) for i in range(300))]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    models = language_id.learn(df.where("doc_id >= 100"))
    got = language_id.identify(df.where("doc_id < 100"), models).collect()
    assert all(r.lang_pred == r.lang and r.accepted and 0 <= r.score <= 1 for r in got)
    odd = {r.doc_id: r for r in language_id.identify(hard.select("doc_id", "text"), models).collect()}
    assert odd[1].lang_pred == odd[2].lang_pred == "und" and not odd[9].accepted
    assert language_id.identify(none, models).count() == 0
    assert {r.lang_pred for r in language_id.identify(hard.select("text"), language_id.learn(none)).collect()} == {"und"}


def test_models_give_distributions(spark):
    """All continuations of a context have probabilities that add up to 1 with the floor's share."""
    raw = "abracadabra abra".encode()
    sym, spans = language_id.symbols(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
    key = np.sort(language_id.grams(sym)[3:])
    k, c = np.unique(key, return_counts=True)
    m = language_id.Models({"x": (k, c)})
    context = language_id.grams(sym)[8] << np.uint64(16)
    letters = np.unique(sym)
    p = np.exp(m.log_probabilities(context | letters)[:, 0].astype(float)).sum()
    assert 0.5 < p <= 1.0001


def test_language_models_have_every_gram_and_limits_every_text(spark, monkeypatch):
    monkeypatch.setattr(language_id, "MOST_GRAMS", 8, raising=False)
    monkeypatch.setattr(language_id, "CALIBRATION_ROWS", 4, raising=False)
    monkeypatch.setattr(language_id, "PART_ROWS", 50, raising=False)
    rnd = random.Random(12)
    rows = [(i, "".join(rnd.choice(("abcdé ", "cdefgh ")[i % 2]) for _ in range(rnd.randint(5, 60))), ("aa", "bb")[i % 2]) for i in range(400)] + [(400 + i, "ab cd", "aa") for i in range(50)]
    m = language_id.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    counts, coded = {}, {}
    for lang in ("aa", "bb"):
        texts = [t for _, t, x in rows if x == lang]
        keys = []
        for t in texts:
            raw = np.frombuffer(t.encode(), np.uint8)
            sym, _ = language_id.symbols(raw, np.array([0, len(raw)]))
            keys.append(language_id.grams(sym)[3:])
        coded[lang] = dict(zip(texts, keys))
        counts[lang] = np.unique(np.concatenate(keys), return_counts=True)
    want = language_id.Models(counts)
    probe = np.concatenate([k for lang in coded for k in coded[lang].values()] + [np.arange(50, dtype=np.uint64) * np.uint64(7919 << 20)])
    assert m.langs == want.langs and np.allclose(m.log_probabilities(probe), want.log_probabilities(probe), atol=1e-5)
    for ell, lang in enumerate(want.langs):
        h = [-want.log_probabilities(k).astype(float).mean(axis=0) for k in coded[lang].values() if len(k)]
        own = [x[ell] for x in h if x.argmin() == ell]
        assert m.limit[ell] == pytest.approx(np.quantile(own, language_id.QUANTILE) * language_id.SLACK, rel=1e-5)


def test_toxicity_learns_words(spark, hard, none):
    rnd = random.Random(9)
    plain = [f"{a}{b}" for a in "bcdfghjklm" for b in ("ado", "eri", "oni", "uta")]
    rows, marks = [], []
    for i in range(900):
        w = [rnd.choice(plain) for _ in range(40)]
        if i % 4 == 0:
            w[rnd.randrange(40)] = rnd.choice(["NASTY", "nasty", "vile!"])
        rows.append((i, " ".join(w), "en"))
        marks.append((i, int(i % 4 == 0)))
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string, lang string"), spark.createDataFrame(marks, "doc_id long, toxic int")
    model = toxicity.learn(docs, labels)
    got = toxicity.score(docs.withColumn("held", ~toxicity.learnt()), model).where("held").collect()
    assert sum((r.score >= 0.7) == (r.doc_id % 4 == 0) for r in got) >= 0.95 * len(got)
    assert all(0 <= r.score <= 1 for r in toxicity.score(hard.select("doc_id", "text"), model).collect())
    assert toxicity.score(none, model).count() == 0
    assert {r.score for r in toxicity.score(hard.select("text"), toxicity.learn(docs, labels.limit(0))).collect()} == {0.0}


def test_toxicity_cut_knows_how_rare_the_label_is(spark, monkeypatch):
    """Fitting takes as many of either label; words that clean texts have too, now and then, must not set the cut low."""
    monkeypatch.setattr(toxicity, "FIT_ROWS", 150)
    rnd = random.Random(10)
    plain = [f"{a}{b}" for a in "bcdfghjklm" for b in ("ado", "eri", "oni", "uta")]
    rows, marks = [], []
    for i in range(6000):
        w, toxic = [rnd.choice(plain) for _ in range(20)], i % 20 == 0
        for word, often in (("vile", 0.6 if toxic else 0.02), ("nasty", 0.7 if toxic else 0.15), ("crude", 0.7 if toxic else 0.2)):
            if rnd.random() < often:
                w[rnd.randrange(20)] = word
        rows.append((i, " ".join(w), "en"))
        marks.append((i, int(toxic)))
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string, lang string"), spark.createDataFrame(marks, "doc_id long, toxic int")
    got = toxicity.score(docs.withColumn("held", ~toxicity.learnt()), toxicity.learn(docs, labels)).where("held").collect()
    said = [r for r in got if r.score >= toxicity.CUT]
    true = sum(r.doc_id % 20 == 0 for r in got)
    assert 0 < len(said) <= 1.5 * true
