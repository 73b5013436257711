"""Toxicity by a convolutional text classifier trained in numpy.

Words (letters in lower case) are hashed to embedding rows; filters of widths 1, 2 and 3 slide over the embeddings, each keeps its
largest response, and a logistic layer scores them.  Training is by Adam over a bounded sample of labelled rows (`FIT_ROWS` of either
label at most, chosen by hash); buckets that few of its texts have share one row, so nothing is learnt by heart.  Thresholds are
calibrated on all labelled rows that training does not see, with the labels' own shares: one for all, at which the score is 0.7, and
one for each language.  Scoring runs over every whole text; its only input is the text.

Edge cases: null, empty and wordless texts score as no filter responds; without both labels to learn from every score is 0; null
labels and null ids teach nothing; rows that repeat a doc_id are scored each, and learnt from with that id's largest label.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text
from ._spark import without
from ._text import U

FIT_ROWS = 2500
MOST_FIT_ROWS = 3 * FIT_ROWS
BUCKETS = 1 << 18
#: Texts of the sample that must have a bucket for it to get a row of its own.
LEAST_TEXTS = 4
WIDTHS, FILTERS, DIMS = (1, 2, 3), 8, 8
EPOCHS, RATE, DECAY = 6, 0.02, 1e-4
CUT = 0.7
#: Steps of the histogram that the cuts are set by, for each unit of response.
BINS = 256

_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
_LETTER[128:] = True
_KEEP = np.where(_LETTER, np.arange(256), 32).astype(np.uint8)


def word_buckets(raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the words of a chunk: runs of letters, A-Z lower-cased; with their offsets."""
    raw = _KEEP[_text.lower_ascii(raw)]
    s, e, first = _text.word_spans(raw, offs)
    return (_text.span_hashes(raw, s, e) % U(BUCKETS)).astype(np.int64), first


class Classifier:
    def __init__(self, rows: np.ndarray, table: np.ndarray):
        self.rows, self.table = rows, table
        rng = np.random.default_rng(7)
        self.p = {"e": table, "b": np.zeros(1, np.float32), "o": (rng.normal(size=len(WIDTHS) * FILTERS) * 0.3).astype(np.float32)}
        for w in WIDTHS:
            self.p[f"w{w}"] = (rng.normal(size=(w * DIMS, FILTERS)) * (0.5 / np.sqrt(w * DIMS))).astype(np.float32)
            self.p[f"c{w}"] = np.zeros(FILTERS, np.float32)
        self.scale, self.shift = 1.0, 0.0
        self.by_lang: dict[str, float] = {}

    def pooled(self, ids: np.ndarray, first: np.ndarray, places: bool = False):
        """Largest responses (documents x filters) and, on demand, where they stand."""
        n, count = len(first) - 1, np.diff(first)
        top = np.zeros((n, len(WIDTHS) * FILTERS), np.float32)
        where = np.full((n, len(WIDTHS) * FILTERS), -1, np.int64)
        # two empty rows behind each document, so that no filter reaches into the next
        wide = np.full(len(ids) + 2 * n, len(self.table), np.int64)
        starts = first[:-1] + 2 * np.arange(n)
        wide[np.arange(len(ids)) + 2 * np.repeat(np.arange(n), count)] = ids
        x = np.concatenate([self.p["e"], np.zeros((1, DIMS), np.float32)])[wide]
        some = np.flatnonzero(count > 0)
        if not len(some):
            return top, where, wide
        edges = np.stack([starts[some], starts[some] + count[some]], axis=1).ravel()
        for k, w in enumerate(WIDTHS):
            r = x @ self.p[f"w{w}"][:DIMS]
            for j in range(1, w):
                r[:-j] += x[j:] @ self.p[f"w{w}"][j * DIMS : (j + 1) * DIMS]
            r += self.p[f"c{w}"]
            np.maximum(r, 0, out=r)
            cols = slice(k * FILTERS, (k + 1) * FILTERS)
            top[some, cols] = np.maximum.reduceat(r, edges, axis=0)[::2]
            if places:
                for d in some:
                    where[d, cols] = starts[d] + r[starts[d] : starts[d] + count[d]].argmax(axis=0)
        return top, where, wide

    def logits(self, raw: np.ndarray, offs: np.ndarray) -> np.ndarray:
        ids, first = word_buckets(raw, offs)
        top, _, _ = self.pooled(self.rows[ids], first)
        return top @ self.p["o"] + self.p["b"][0]

    def scores(self, texts: pa.Array) -> np.ndarray:
        out = [self.logits(raw, offs) for _, _, raw, offs in _text.chunks(texts, 1 << 20)]
        z = (np.concatenate(out) if out else np.zeros(0)) * self.scale + self.shift
        return 1 / (1 + np.exp(-np.clip(z.astype(np.float64), -60, 60)))


def _fit(texts: list[str], y: np.ndarray) -> tuple[Classifier | None, np.ndarray]:
    """Trains on four fifths, or on all where those lack a label; with the places of the texts that it trained on."""
    held = np.arange(len(y)) % 5 == 4
    if not len(y) or y.min() == y.max():
        return None, np.zeros(0, np.int64)
    if len(set(y[~held])) < 2:
        held[:] = False
    coded = []
    for t in texts:
        raw = np.frombuffer((t or "").encode(), np.uint8)
        coded.append(word_buckets(raw, np.array([0, len(raw)]))[0])
    fit = np.flatnonzero(~held)
    seen = [np.bincount(np.concatenate([np.unique(coded[d]) for d in fit if y[d] == q] or [np.zeros(0, np.int64)]), minlength=BUCKETS) for q in (0, 1)]
    common = np.flatnonzero(seen[0] + seen[1] >= min(LEAST_TEXTS, max(1, len(fit) // 50)))
    rows = np.zeros(BUCKETS, np.int32)
    rows[common] = np.arange(1, len(common) + 1)
    rng = np.random.default_rng(11)
    table = (rng.normal(size=(len(common) + 1, DIMS)) * 0.05).astype(np.float32)
    rate = [(s[common] + 0.5) / (max(1, (y[fit] == q).sum()) + 1) for q, s in enumerate(seen)]
    table[1:, 0] = np.clip(np.log(rate[1] / rate[0]), -3, 3) * 0.5
    table[0] = 0
    model = Classifier(rows, table)
    m = {k: np.zeros_like(v) for k, v in model.p.items()}
    v = {k: np.zeros_like(x) for k, x in model.p.items()}
    weight = np.where(y == 1, 0.5 / max(1, y[fit].sum()), 0.5 / max(1, (1 - y[fit]).sum())) * len(fit)
    step = 0
    for epoch in range(EPOCHS if len(fit) > 1000 else 3 * EPOCHS):
        order = rng.permutation(fit)
        for lo in range(0, len(order), 32):
            d = order[lo : lo + 32]
            ids = rows[np.concatenate([coded[i] for i in d])].astype(np.int64)
            first = np.concatenate([[0], np.cumsum([len(coded[i]) for i in d])])
            top, where, wide = model.pooled(ids, first, places=True)
            keep = rng.random(top.shape[1]) > 0.2
            z = (top * keep) @ model.p["o"] / 0.8 + model.p["b"][0]
            err = ((1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[d]) * weight[d] / len(d)).astype(np.float32)
            g = {k: np.zeros_like(x) for k, x in model.p.items()}
            g["o"], g["b"][0] = (top * keep).T @ err / 0.8 + DECAY * model.p["o"], err.sum()
            back = err[:, None] * model.p["o"][None, :] * keep / 0.8 * (top > 0)
            emb = np.concatenate([model.p["e"], np.zeros((1, DIMS), np.float32)])
            for k, w in enumerate(WIDTHS):
                for f in range(FILTERS):
                    b, at = back[:, k * FILTERS + f], where[:, k * FILTERS + f]
                    on = np.flatnonzero((at >= 0) & (b != 0))
                    if not len(on):
                        continue
                    g[f"c{w}"][f] += b[on].sum()
                    for j in range(w):
                        token = wide[np.minimum(at[on] + j, len(wide) - 1)]
                        g[f"w{w}"][j * DIMS : (j + 1) * DIMS, f] += emb[token].T @ b[on]
                        real = (token > 0) & (token < len(model.p["e"]))
                        np.add.at(g["e"], token[real], b[on][real, None] * model.p[f"w{w}"][None, j * DIMS : (j + 1) * DIMS, f])
            step += 1
            for k in model.p:
                m[k] += 0.1 * (g[k] - m[k])
                v[k] += 0.001 * (g[k] * g[k] - v[k])
                model.p[k] -= RATE * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-6)
    model.table = model.p["e"]
    return model, fit


def _best_cut(z: np.ndarray, y: np.ndarray, w: np.ndarray) -> float:
    """The middle of the gap at which F1 is best; rows weigh w."""
    order = np.argsort(-z, kind="stable")
    z, hit, w = z[order], (y * w)[order], w[order]
    f1 = 2 * np.cumsum(hit) / (np.cumsum(w) + max(1e-9, hit.sum()))
    f1[:-1][z[:-1] == z[1:]] = -1
    i = int(f1.argmax())
    return float((z[i] + z[i + 1]) / 2 if i + 1 < len(z) else z[i] - 0.5)


def _calibrate(model: Classifier, docs: DataFrame, marks: DataFrame, total: dict[int, int], fitted: DataFrame) -> None:
    """Sets the cuts by all labelled rows that were not fitted, or by all labelled ones where nothing else has both labels.

    The driver gets a histogram of the responses by language and label.  As fitting takes another part of either label, rows weigh
    as much as gives the labels their shares among all that may be learnt from.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def step(batches):
        for batch in batches:
            z = [shared.value.logits(raw, offs) for _, _, raw, offs in _text.chunks(_text.text_array(batch.column("text")), 1 << 20)]
            z = np.concatenate(z) if z else np.zeros(0)
            bins = np.floor(np.clip(z, -64, 64).astype(np.float64) * BINS).astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("lang"), pa.array(bins)], ["doc_id", "lang", "bin"])

    kinds = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    # scored before the join, so that it shuffles no texts
    scored = docs.where("doc_id is not null").where(learnt()).select("doc_id", "lang", "text").mapInArrow(step, f"doc_id {kinds['doc_id']}, lang {kinds['lang']}, bin long")
    for rest in (marks.join(F.broadcast(fitted), "doc_id", "left_anti"), marks):
        joined = scored.join(rest, "doc_id").groupBy("lang", (F.col("toxic") > 0).cast("int").alias("y"), "bin").count().collect()
        if len({r.y for r in joined}) == 2:
            break
    lang = np.array([r.lang for r in joined], object)
    y, z, n = (np.array(x, np.float64) for x in ([r.y for r in joined], [(r.bin + 0.5) / BINS for r in joined], [r["count"] for r in joined]))
    everyone = {q: sum(k for t, k in total.items() if (t > 0) == q) for q in (0, 1)}
    w = n * np.array([everyone[q] / max(1.0, n[y == q].sum()) for q in (0, 1)])[y.astype(int)]
    cut, near = _best_cut(z, y, w), np.log(CUT / (1 - CUT))
    mean = np.average(z, weights=w)
    model.scale = float(1 / max(0.25, min(4.0, np.sqrt(np.average((z - mean) ** 2, weights=w)) or 1.0)) * 2)
    model.shift = float(near - cut * model.scale)
    for name in sorted({x for x in lang if x is not None}):
        own = lang == name
        if 0 < y[own].sum() < own.sum():
            s = _best_cut(z[own], y[own], w[own]) * model.scale + model.shift
            model.by_lang[name] = float(1 / (1 + np.exp(-s)))


def learnt():
    """True for rows whose label may be learnt from."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 != 1


def learn(docs: DataFrame, labels: DataFrame) -> Classifier | None:
    """A classifier from documents (doc_id, text, lang) and labels (doc_id, toxic): FIT_ROWS of either label at most, about, by hash of the id."""
    marks = labels.where("toxic is not null and doc_id is not null").where(learnt()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    total = {r.toxic: r["count"] for r in marks.groupBy("toxic").count().collect()}
    part = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000))
    chosen = marks.where(F.expr("false"))
    for q, n in total.items():
        chosen = chosen.union(marks.where((F.col("toxic") == q) & (part < int(1_000_000 * min(1.0, FIT_ROWS / n)))))
    # 2 * FIT_ROWS ids, about; an id that very many rows have can't make it more rows than MOST_FIT_ROWS
    rows = docs.select("doc_id", "text", "lang").join(F.broadcast(chosen), "doc_id").orderBy(F.xxhash64("doc_id", "text")).limit(MOST_FIT_ROWS).collect()
    rows.sort(key=lambda r: (r.doc_id, r.text or ""))
    order = np.random.default_rng(5).permutation(len(rows))
    rows = [rows[i] for i in order]
    model, fit = _fit([r.text for r in rows], np.array([int(r.toxic > 0) for r in rows]))
    if model is not None:
        fitted = docs.sparkSession.createDataFrame([(x,) for x in sorted({rows[i].doc_id for i in fit})], docs.select("doc_id").schema)
        _calibrate(model, docs, marks, total, fitted)
    return model


def score(docs: DataFrame, model: Classifier | None, text: str = "text") -> DataFrame:
    """The table with the score of each text, 0 to 1 (instead of a column score, if there is one)."""
    docs = without(docs, ["score"], text)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def step(batches):
        for batch in batches:
            s = np.zeros(batch.num_rows) if shared.value is None else shared.value.scores(_text.text_array(batch.column(text)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(s, pa.float64())], [*batch.schema.names, "score"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(step, f"{kinds}, score double")


def op5_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    held = F.coalesce(~learnt(), F.lit(False)).alias("held_out")
    out = score(docs.select("doc_id", held, "lang", "text"), model)
    limits = F.create_map(*[F.lit(x) for kv in model.by_lang.items() for x in kv]) if model and model.by_lang else F.lit(None).cast("map<string,double>")
    return out.select("doc_id", "held_out", "score", (F.col("score") >= CUT).cast("int").alias("predicted"), (F.col("score") >= F.coalesce(limits[F.col("lang")], F.lit(CUT))).alias("flagged_by_language"))
