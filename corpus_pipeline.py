"""Language ID, near-copy removal, repeat removal, mixing and tokenising of `documents`.

Each stage takes the Parquet table that its predecessor wrote, works on all of it and returns the columns of documents; the last
returns token ids.  Texts are cut by the third stage, at whole characters, and by the fourth, before white space.  Null ids pass through every stage; rows that
repeat an id are documents of their own in each; rows of one id and text are one document for the second stage.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankflow.llm import bpe, language_id, mixing, ngram_join, suffix_dedup
from rankflow.llm._spark import shared_dir

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def identify_language(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; those without letters or unlike every language go."""
    models = language_id.learn(docs.where(~language_id.held_out()))
    return language_id.identify(docs.select(*COLUMNS), models).where("accepted").select(*COLUMNS)


def join_near_copies(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near copies the row of the smallest doc_id (null last, then by the text's hash and the other columns); rows that share an id and differ in text stand for themselves."""
    classes = ngram_join.similar_classes(docs)
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")
    found = classes.where("class_key is not null").groupBy("class_key").agg(F.min(place).alias("r")).select("r.doc_id", "r.text_hash")
    first = found.union(classes.where("class_key is null").select("doc_id", "text_hash")).distinct()
    docs = docs.select(*COLUMNS).withColumn("__text", F.xxhash64("text"))
    same = docs["doc_id"].cast("long").eqNullSafe(first["doc_id"]) & (docs["__text"] == first["text_hash"])
    # rows of one id and text are copies of each other: one stays
    rest = [F.min(F.struct("text", *COLUMNS[2:])).alias("r")]
    return docs.join(first, same, "left_semi").groupBy("doc_id", "__text").agg(*rest).select("doc_id", "r.*").select(*COLUMNS)


def remove_repeats(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that an earlier one has; those with nothing left go."""
    out = suffix_dedup.remove_repeats(docs, whole_chars=True, carry=("lang", "source"))
    out = out.select("doc_id", F.col("kept_text").cast("string").alias("text"), "lang", "source")
    return out.where("trim(BOTH ' \t\n\x0b\x0c\r' FROM text) <> ''").withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*COLUMNS)


def mix_sources(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix by blocks: a row for each document in a slot of the output, with its words in the slot's block, shard by shard in the order of slots."""
    out = mixing.mixed(docs.select(*COLUMNS))
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*COLUMNS)


def tokenize(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids (packed, little-endian, 32 bits each) of every text, and the digest of what they decode to."""
    import public_tokenizers

    out = bpe.encode(docs, public_tokenizers.path("word_bpe_49k.json"), keep=["lang", "source"])
    return out.select("doc_id", "lang", "source", (F.length("ids") / 4).cast("long").alias("n_tokens"), "ids", F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


STAGES = [
    ("language ID", identify_language),
    ("n-gram Jaccard join", join_near_copies),
    ("suffix-array dedup", remove_repeats),
    ("mixing sources to target weights", mix_sources),
    ("BPE encoding and decoding", tokenize),
]

#: No stage but the last could be said in SQL: see tests/llm for brute-force versions.
ORACLE_SQL = None


def run(spark, sf_dir: str) -> DataFrame:
    """The stages over documents, each but the last written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for i, (_, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{i}")
        docs = spark.read.parquet(f"{folder}/{i}")
    return STAGES[-1][1](spark, docs, sf_dir)
