"""The registered queries themselves on the smallest tables: contracts, and replays in plain Python."""

import collections
import math
import random
import statistics
import zlib

import numpy as np
import pyarrow as pa
import pytest

from rankflow.llm import _text, fingerprints, language_id, quality_rules, queries, toxicity

from test_texts import WORD, base, xx

DIR = "/root/testdata/sf0.001"
COLUMNS = {
    "op1_fingerprints": "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double",
    "op2_bpe": "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string",
    "op3_warc": "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint",
    "op4_ngram_join": "doc_id bigint, n_shingles bigint, component_id bigint",
    "op5_toxicity": "doc_id bigint, held_out boolean, score double, predicted int",
    "op6_quality_rules": "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, kept boolean",
    "op7_mixing": "doc_id bigint, size bigint, source_size bigint, target double, taken bigint",
    "op8_license_scan": "doc_id bigint, text_sha256 string, license string, notices string",
    "op9_suffix_dedup": "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string",
    "op10_language_id": "doc_id bigint, held_out boolean, lang_pred string, score double",
}


@pytest.fixture(scope="module")
def docs(spark):
    return {r.doc_id: r for r in spark.read.parquet(f"{DIR}/documents.parquet").collect()}


@pytest.fixture(scope="module")
def result(spark):
    made = {}

    def get(name):
        if name not in made:
            df = queries.queries()[name](spark, DIR)
            made[name] = (dict(df.dtypes), df.collect())
        return made[name]

    return get


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_columns_and_rows(spark, result, docs, name):
    kinds, rows = result(name)
    assert all(kinds[c] == k for c, k in (x.split() for x in COLUMNS[name].split(", ")))
    keys = [r[0] for r in rows]
    want = sorted(docs) if name != "op3_warc" else sorted(r.page_id for r in spark.read.parquet(f"{DIR}/pages.parquet").select("page_id").collect())
    assert sorted(keys) == want


def test_what_is_held_out(result):
    for name, n, out in (("op5_toxicity", 3, 1), ("op10_language_id", 5, 0)):
        for r in result(name)[1]:
            assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % n == out) and 0 <= r.score <= 1
    assert all(r.predicted == (r.score >= 0.7) for r in result("op5_toxicity")[1])


# ---------------------------------------------------------------- 1: a fingerprint, by the book
M = 2**64
BASE = int(_text._BASE)


def mixed(h):
    return int(_text.mix(np.array([h % M], np.uint64))[0])


def fingerprint(text):
    words = []
    for w in WORD.findall(text):
        b = w.encode()
        words.append(mixed(sum(int(_text._BYTE[x]) * pow(BASE, i, M) for i, x in enumerate(b)) + len(b) * 0xD6E8FEB86659FD93))
    if not words:
        return ""
    k = min(5, len(words))
    shingles = [mixed(mixed(sum(words[i + j] * int(_text._PLACE[j]) for j in range(k)) + k)) for i in range(len(words) - k + 1)]
    bins = [None] * 256
    for h in shingles:
        b, v = h & 255, h >> 22
        bins[b] = v if bins[b] is None else min(bins[b], v)
    out = []
    for b in range(256):
        turn, at = 0, b
        while bins[at] is None:
            turn += 1
            at = mixed(b * 1_000_003 + turn) & 255
        out.append(bins[at] & 255)
    return bytes(out).hex()


def test_fingerprints_equal_a_replay(result, docs):
    rows = sorted(result("op1_fingerprints")[1], key=lambda r: -r.doc_id)
    own = {r.doc_id: r for r in rows}
    for i, r in list(enumerate(rows))[::9]:
        t, nxt = docs[r.doc_id].text or "", docs[rows[(i + 1) % len(rows)].doc_id].text or ""
        if len(t) > 6000:
            continue
        half = len(t) // 2
        assert r.fingerprint == fingerprint(t) and r.edited_fingerprint == fingerprint(t[: len(t) - half] + nxt[:half])
        for said, other in ((r.near_edited, r.edited_fingerprint), (r.near_next, own[rows[(i + 1) % len(rows)].doc_id].fingerprint)):
            same = sum(a == b for a, b in zip(bytes.fromhex(r.fingerprint), bytes.fromhex(other))) / 256
            want = float(r.fingerprint == other) if not (r.fingerprint and other) else min(1, max(0, (same - 1 / 256) / (1 - 1 / 256)))
            assert said == pytest.approx(want)


# ---------------------------------------------------------------- 6: the verdicts
def test_verdicts_equal_a_replay(spark, result, docs):
    trusted = {r.doc_id for r in spark.read.parquet(f"{DIR}/labels.parquet").where("quality = 1").collect()}
    n, grams = quality_rules.BUCKETS, {}
    for i, r in docs.items():
        h = [xx(w) for w in WORD.findall(r.text or "")]
        grams[i] = [x % n for x in h] + [xx(a, b) % n for a, b in zip(h, h[1:])]
    raw, own = collections.Counter(), collections.Counter()
    for i, g in grams.items():
        raw.update(g)
        if i in trusted and xx(i) % 3:
            own.update(g)
    a, b = math.log(sum(raw.values()) + n), math.log(sum(own.values()) + n)
    score = {i: sum(math.log(own[x] + 1) - b - math.log(raw[x] + 1) + a for x in g) / len(g) for i, g in grams.items() if g}
    seen = sorted(round(score[i], 3) for i in score if i in trusted and xx(i) % 3 == 0)
    limit = round(seen[int(quality_rules.QUANTILE * len(seen))] - quality_rules.MARGIN - statistics.pstdev(seen), 3)
    for r in result("op6_quality_rules")[1]:
        words, *_, repeats = base(docs[r.doc_id].text)
        failed = words < 20 or 100 * repeats > 30 * words
        assert (r.n_words, r.n_repeat_words, r.base_failed) == (words, repeats, failed)
        if r.doc_id in score:
            assert r.score == pytest.approx(score[r.doc_id], abs=0.0011)
            if abs(score[r.doc_id] - limit) > 0.003:
                assert r.kept == (not failed and score[r.doc_id] >= limit)
        else:
            assert r.kept in (None, False)


# ---------------------------------------------------------------- 5: the classifier's forward pass
def test_scores_equal_a_plain_convolution():
    rnd, rng = random.Random(2), np.random.default_rng(2)
    rows = rng.integers(0, 50, toxicity.BUCKETS).astype(np.int32)
    model = toxicity.Classifier(rows, rng.normal(size=(50, toxicity.DIMS)).astype(np.float32))
    model.p["b"][0], model.scale, model.shift = 0.3, 1.7, -0.4
    texts = ["", None, "one", "Nasty, nasty é WORDS 12 and more"] + [" ".join(rnd.choice("abcdefg") * rnd.randint(1, 4) for _ in range(rnd.randint(1, 30))) for _ in range(20)]
    got = model.scores(_text.text_array(pa.array(texts, pa.string())))
    for t, said in zip(texts, got):
        letters = "".join(c if c.isascii() and c.isalpha() or ord(c) > 127 else " " for c in (t or "")).lower()
        ids = []
        for w in letters.split():
            b = w.encode()
            ids.append(rows[mixed(sum(int(_text._BYTE[x]) * pow(BASE, i, M) for i, x in enumerate(b)) + len(b) * 0xD6E8FEB86659FD93) % toxicity.BUCKETS])
        x = [model.p["e"][i] for i in ids] + [np.zeros(toxicity.DIMS)] * 2
        z = float(model.p["b"][0])
        for k, w in enumerate(toxicity.WIDTHS):
            for f in range(toxicity.FILTERS):
                responses = [max(0.0, float(np.concatenate(x[i : i + w]) @ model.p[f"w{w}"][:, f] + model.p[f"c{w}"][f])) for i in range(len(ids))]
                z += max(responses, default=0.0) * float(model.p["o"][k * toxicity.FILTERS + f])
        assert said == pytest.approx(1 / (1 + math.exp(-(z * 1.7 - 0.4))), abs=1e-4)


# ---------------------------------------------------------------- 10: Kneser-Ney, by the book
def test_probabilities_equal_plain_kneser_ney():
    text = "the other day the weather there was other than the others thought"
    sym, _ = language_id.symbols(np.frombuffer(text.encode(), np.uint8), np.array([0, len(text)]))
    s = [int(x) for x in sym]
    counts = [None, *(collections.Counter() for _ in range(4))]
    counts[4].update(tuple(s[i - 3 : i + 1]) for i in range(3, len(s)))
    for n in (3, 2, 1):  # below: kinds of what precedes
        counts[n].update(g[1:] for g in counts[n + 1])
    less = [0.0] * 5
    for n in range(1, 5):
        one, two = (sum(c == k for c in counts[n].values()) for k in (1, 2))
        less[n] = min(0.95, max(0.05, one / max(1, one + 2 * two)))

    def p(gram):
        n = len(gram)
        if not n:
            return 1 / (len(counts[1]) + 1)
        of = {g: c for g, c in counts[n].items() if g[:-1] == gram[:-1]}
        if not of:
            return p(gram[1:])
        total = sum(of.values())
        return max(0.0, of.get(gram, less[n]) - less[n]) / total + less[n] * len(of) / total * p(gram[1:])

    key = np.sort(language_id.grams(sym)[3:])
    m = language_id.Models({"x": np.unique(key, return_counts=True)})
    probe = [tuple(s[i - 3 : i + 1]) for i in range(3, len(s))] + [(1, 2, 3, 4), (0, 0, 0, ord("q")), (ord("t"), ord("h"), ord("e"), ord("z"))]
    got = m.log_probabilities(np.array([sum(x << 16 * (3 - i) for i, x in enumerate(g)) for g in probe], np.uint64))[:, 0]
    assert got == pytest.approx([math.log(p(g)) for g in probe], abs=1e-4)
