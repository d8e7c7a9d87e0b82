"""A training corpus from `documents`: rules, near copies, repeated passages, benchmark passages, packing.

Every stage reads what the one before it kept, with the columns of documents, and its decisions take effect.
Rows without a doc_id, or with that of another text, are documents of their own where texts are compared as wholes;
where passages are, they count as parts of one document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.llm import common, decontaminate, packing, quality_rules, simhash, substring
from tidewright.llm.tokens import vocabulary

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or a certified cutoff reject go."""
    rows = quality_rules.judge(docs, common.table(common.prepare(spark), sf_dir, "labels"), keep=COLUMNS[1:])
    return rows.where("kept").select(*COLUMNS)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents whose five-word shingles are similar by 0.8 or more, the one with the smallest doc_id stays.

    Of several texts with that doc_id, the one with the smallest hash stays, and one of repeated rows.
    """
    common.prepare(spark)
    rows = simhash.similar_classes(docs, shingle=5, similarity=0.8).where("stays")
    rows = common.stage_table(rows.groupBy(F.col("doc_id").alias("own_id"), "text_hash").agg(F.count("*").alias("n")), "staying")
    own = docs["doc_id"].cast("long").eqNullSafe(F.col("own_id")) & (F.xxhash64(common.utf8(docs["text"])) == F.col("text_hash"))
    once = docs.join(rows.where("n = 1"), own, "left_semi")
    # only rows that are repeated need to be brought together
    again = docs.join(rows.where("n > 1"), own).dropDuplicates(["own_id", "text_hash"])
    return once.select(*COLUMNS).union(again.select(*[docs[c] for c in COLUMNS]))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of twenty words or more that occur earlier go, and documents of which nothing is left by that."""
    common.prepare(spark)
    rows = substring.deduplicate(docs, window=20, keep=("lang", "source"), untouched=True).where("n_removed = 0 or n_removed < n_words")
    return rows.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a passage of a benchmark item go."""
    return decontaminate.remove(docs, common.table(common.prepare(spark), sf_dir, "benchmark")).select(*COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of sequences of at most 1024 tokens."""
    common.prepare(spark)
    rows = packing.pack(docs, vocabulary("byte_bpe_50k.json"), capacity=1024, end_id=0)
    return rows.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [
    ("quality rules", quality),
    ("SimHash near-dedup", near_copies),
    ("substring dedup", repeated_passages),
    ("benchmark decontamination", benchmark_passages),
    ("packing", packed),
]

#: SQL has neither the fingerprints' hash nor the tokenizer; tests/llm compares with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each but the last written to the shared folder and read again."""
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.stage_table(stage(spark, docs, sf_dir), name.lower().replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
