"""Quality rules: counting rules, and a hashed n-gram log-likelihood ratio between trusted and raw text.  SQL functions only.

Words and pairs of words are hashed into `BUCKETS` buckets.  Two multinomials over buckets, one of the trusted documents and one of the whole
corpus, give each bucket a log ratio; a document's score is the mean over its n-grams.  A document is kept if no counting rule
fails and its score is not below the limit.  One third of the trusted documents, by a hash of the id, teaches no ratio and sets the limit:
the `QUANTILE` of their scores less `MARGIN` and their standard deviation (documents that were learnt from score higher than others like them).  The same input always gives the
same verdicts: counts are exact, scores are compared after rounding to a thousandth.

Edge cases: null, empty and wordless texts have zero counts and fail the base rules; without trusted documents every ratio is 0
and only the base rules decide; rows that repeat a doc_id are judged each, and trusted if any of its labels is; null ids are never trusted.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import cut

BUCKETS = 1 << 14
WINDOW = 8
LEAST_WORDS = 20
QUANTILE, MARGIN = 0.002, 0.05
#: The characters themselves: SQL has no escapes for all of them.
_BLANKS = "' \t\n\x0b\x0c\r'"


def words_of(text: str):
    """The words of a text column as an array; null has none."""
    trimmed = f"trim(BOTH {_BLANKS} FROM coalesce(`{text}`, ''))"
    return F.expr(f"if({trimmed} = '', cast(array() as array<string>), split({trimmed}, '[\\\\x20\\\\x09-\\\\x0D]+', -1))")


def with_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """The table with words (array), n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words."""
    blank = f"translate(%s, {_BLANKS}, '')"
    df = docs.withColumn("words", words_of(text)).withColumn("n_words", F.size("words").cast("long"))
    df = df.withColumn("word_chars", F.expr(f"cast(length({blank % f'coalesce(`{text}`, {chr(39) * 2})'}) as long)"))
    df = df.withColumn("n_symbols", F.expr(f"cast(length(coalesce(`{text}`, '')) - length(translate(coalesce(`{text}`, ''), '#*$%&|<>', '')) as long)"))
    df = df.withColumn("__lines", F.expr(f"filter(split(coalesce(`{text}`, ''), '\\n', -1), x -> {blank % 'x'} <> '')"))
    df = df.withColumn("n_dup_lines", F.expr("cast(size(__lines) - size(array_distinct(__lines)) as long)"))
    df = df.withColumn("__h", F.expr(f"if(n_words < {WINDOW}, cast(array() as array<bigint>), transform(sequence(1, size(words) - {WINDOW - 1}), i -> xxhash64(slice(words, i, {WINDOW}))))"))
    df = df.withColumn("__some", F.expr("size(array_distinct(__h)) < size(__h)"))
    # places of windows that are found twice, by neighbours in the order of hashes
    df = df.withColumn("__o", F.expr("if(__some, array_sort(transform(__h, (h, i) -> struct(h as h, i as i))), null)"))
    df = df.withColumn(
        "__at",
        F.expr("if(__some, array_sort(transform(filter(transform(__o, (x, k) -> struct(x.i as i, (k > 0 and get(__o, k - 1).h = x.h) or (k + 1 < size(__o) and get(__o, k + 1).h = x.h) as t)), y -> y.t), y -> y.i)), null)"),
    )
    repeated = f"aggregate(transform(__at, (p, k) -> if(k + 1 < size(__at), least({WINDOW}, get(__at, k + 1) - p), {WINDOW})), 0L, (a, x) -> a + x)"
    df = df.withColumn("n_repeat_words", F.expr(f"if(__some, {repeated}, 0L)"))
    return df.drop("__lines", "__h", "__some", "__o", "__at")


def with_grams(df: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """The table with grams: the buckets of its words and pairs of words."""
    df = df.withColumn("__w", F.expr("transform(words, x -> xxhash64(x))"))
    pairs = f"if(size(__w) < 2, cast(array() as array<int>), transform(sequence(0, size(__w) - 2), i -> cast(pmod(xxhash64(get(__w, i), get(__w, i + 1)), {buckets}) as int)))"
    return df.withColumn("grams", F.expr(f"concat(transform(__w, h -> cast(pmod(h, {buckets}) as int)), {pairs})")).drop("__w")


def log_ratios(docs: DataFrame, trusted: DataFrame, buckets: int = BUCKETS) -> list[float]:
    """The log ratio of each bucket; docs (doc_id, text), trusted (doc_id).  One row a bucket reaches the driver."""
    # a merge join at every size: the trusted ids have no bound, so they are never broadcast
    marked = docs.select("doc_id", "text").join(trusted.select("doc_id").distinct().withColumn("t", F.lit(1)).hint("merge"), "doc_id", "left")
    exploded = with_grams(marked.withColumn("words", words_of("text")), buckets).select(F.coalesce("t", F.lit(0)).alias("t"), F.explode_outer("grams").alias("g")).where("g is not null")
    # (the plain explode adds a condition on grams that is pushed below, where it makes the words anew for each pair)
    rows = exploded.groupBy("g").agg(F.count("*").alias("r"), F.sum("t").alias("t")).collect()
    raw, own = [0] * buckets, [0] * buckets
    for r in rows:
        raw[r.g], own[r.g] = r.r, r.t
    if not sum(own):
        return [0.0] * buckets
    a, b = math.log(sum(raw) + buckets), math.log(sum(own) + buckets)
    return [math.log(t + 1) - b - math.log(r + 1) + a for r, t in zip(raw, own)]


def judge(docs: DataFrame, trusted: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, the counts, base_failed, score (null without n-grams), limit and kept of every row."""
    docs = docs.select("doc_id", F.col(text).alias("text"))
    third = F.pmod(F.xxhash64("doc_id"), F.lit(3)) == 0
    # one literal of BUCKETS numbers, folded once; a scalar subquery would be read again for each n-gram
    ratios = "cast(split('" + ",".join(map(repr, log_ratios(docs, trusted.where(~third)))) + "', ',') as array<double>)"
    df = with_grams(with_counts(docs))
    df = df.withColumn("score", F.expr(f"if(n_words = 0, null, round(aggregate(grams, 0D, (a, g) -> a + get({ratios}, g)) / size(grams), 3))"))
    df = df.withColumn("base_failed", F.expr(f"n_words < {LEAST_WORDS} or 100 * n_repeat_words > 30 * n_words"))
    df = cut(df.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "score"))
    # exact quantile from the histogram of rounded scores: a row for each thousandth at most
    seen = df.join(trusted.where(third).select("doc_id").distinct(), "doc_id", "left_semi").where("score is not null").groupBy("score").count().collect()
    total, limit, n = sum(r["count"] for r in seen), -math.inf, 0
    mean = sum(r.score * r["count"] for r in seen) / max(1, total)
    spread = math.sqrt(sum((r.score - mean) ** 2 * r["count"] for r in seen) / max(1, total))
    for r in sorted(seen, key=lambda r: r.score):
        n += r["count"]
        if n > QUANTILE * total:
            limit = round(r.score - MARGIN - spread, 3)
            break
    return df.withColumn("limit", F.lit(limit)).withColumn("kept", ~F.col("base_failed") & (F.col("score") >= F.col("limit")))


def op6_quality_rules(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    trusted = spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality = 1")
    return judge(docs, trusted).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score")
