"""A training corpus from documents: toxicity, near-duplicates, repeated passages, mixing and packing, in this order.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
stage's docs. All but the last return the columns of documents. Any column may hold nulls, a null text counts as empty, and
no rows give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from typeloom.llm import jaccard, mixing, packing, substrings, toxicity
from typeloom.llm.shared import scratch_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model does not reject, each row by its own text: repeated rows stay or go together, and a text
    without sentences stays unless most labelled documents are toxic. Rows without an id are scored like any other."""
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.score(docs, model).where("predicted = 0").select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents that share 0.8 of their shingles, the row with the smallest id; rows without an id come last,
    and of rows with one id that with the smallest hash. Groups meet by the index of fingerprints, and by MinHash bands where
    similar sets have distant ones; sets are compared whole."""
    groups = jaccard.near_duplicates(docs)
    place = F.struct(F.col("doc_id").isNull(), "doc_id", F.xxhash64(*docs.columns), "_row")
    kept = groups.groupBy("_component").agg(F.min(place).alias("first")).select(F.col("first._row").alias("_row"))
    return groups.join(kept, "_row", "left_semi").select(*docs.columns)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that a document with a smaller id holds; one that has nothing left goes. Rows without an id
    lose nothing and take nothing, and of rows with one id none takes from another."""
    others = [c for c in docs.columns if c not in ("doc_id", "text", "n_chars")]
    out = substrings.deduplicated(docs, keep=others).where("n_removed = 0 or n_removed < n_words")
    return out.withColumn("text", F.col("kept_text")).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as its source's target takes it. Null is a source; of equal rows as many are taken as come
    nearest to the target."""
    mixed = mixing.mix(mixing.sized(docs))
    return mixed.where("times > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("times")))).select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in packed sequences. Every row gives pieces, repeated ones and those without an
    id or text too."""
    cut = packing.pieces(docs).withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    return packing.pack(cut)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("substring_dedup", cut_repeats),
    ("source_mix", mix_sources),
    ("packing", pack_sequences),
]

#: Toxicity, fingerprints and token ids have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = scratch_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
