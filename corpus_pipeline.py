"""A corpus pipeline: language, near duplicates, secrets, mixture, tokens.

run(spark, sf_dir) applies STAGES to the table documents, each stage to all that the
one before kept. Each function takes (spark, docs, sf_dir), its result is written as
Parquet and read again as the next one's docs. Stages but the last keep the columns of
documents; no stage sees anything of the others but their rows.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from touchline.llm import bpe, jaccard, langid, mixing, secrets
from touchline.llm.common import drop_written, shared_dir, table, written

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: A text whose likeliest language has a smaller proportion than this is of no language.
LEAST_SHARE = 0.4
#: Keys of further texts under an id that is taken.
KEYS_FROM = 1 << 62


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents of no language: without letters, or so mixed that none has LEAST_SHARE. All stay if no row names a language to learn."""
    model = langid.train(docs)
    if not model[0]:
        return docs.select(*COLUMNS)
    rows = langid.predict(docs, *model, carry=COLUMNS[1:])
    return rows.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SHARE)).select(*COLUMNS)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group that links connect: the one with the smallest id. Texts that differ under one
    id are documents of their own: the first by its hash has the id, the others have keys above all ids. Of rows
    with the same id and text one stays. Rows without an id stay."""
    h = F.xxhash64("text")
    several = written(docs.where("doc_id is not null").groupBy("doc_id").agg(F.min(h).alias("_first"), F.max(h).alias("_last")).where("_first <> _last").select("doc_id", "_first"), "several")
    above = F.xxhash64("doc_id", "text").bitwiseAND(F.lit(KEYS_FROM - 1)).bitwiseOR(F.lit(KEYS_FROM))
    keyed = docs.where("doc_id is not null").join(several, "doc_id", "left").withColumn("_key", F.when(F.col("_first") != h, above).otherwise(F.col("doc_id")))
    kept = jaccard.join(keyed.select("_key", "text"), "_key").where("_key = component_id").select("_key").distinct()
    first = Window.partitionBy("_key").orderBy(h, "lang", "source")
    rows = keyed.join(kept, "_key", "left_semi").withColumn("_rn", F.row_number().over(first)).where("_rn = 1")
    return rows.select(*COLUMNS).unionByName(docs.where("doc_id is null").select(*COLUMNS))


def secret_spans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces every secret by [SECRET]; no document goes. Null and empty texts, and rows without an id, stay as they are; repeated rows each stay."""
    rows = secrets.scan(docs, secrets.train(secrets.labelled_samples(docs)), carry=COLUMNS[1:])
    rows = rows.withColumn("_text", secrets.redact(F.col("text"), F.col("found")))
    return rows.select("doc_id", F.col("_text").alias("text"), "lang", "source", F.when(F.size("found") > 0, F.length("_text").cast("long")).otherwise(F.col("n_chars")).alias("n_chars"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Emits every document as often as the mix of sources takes it. A null source is a source of its own. Null and empty texts have no words, but are
    taken as often as others of their source; a source without any words gives nothing. Repeated rows are documents of their own."""
    mixed = mixing.mix(docs, carry=("text", "lang", "n_chars"))
    return mixed.where("copies > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select(*COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of every row that the mix emitted, repeats included; null texts count as empty ones, ids may be null."""
    import public_tokenizers

    return bpe.encode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("language ID", language),
    ("n-gram Jaccard join", near_copies),
    ("secret scans", secret_spans),
    ("mixing sources to target weights", mixture),
    ("byte-level BPE encoding and decoding", tokens),
]

#: Two stages can't be expressed in SQL; tests compare run() with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, folder = table(spark, sf_dir, "documents"), f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        if k:
            drop_written(docs)  # the stage before; nothing reads it any more
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs
