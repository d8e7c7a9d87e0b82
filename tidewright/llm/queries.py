"""The registered queries of this subpackage: each operator over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, decontaminate, hard_negatives, licences, merkle, packing, quality_rules, secret_scan, simhash, site_quality, substring, token_files, url_filter, warc
from .tokens import vocabulary


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = common.table(common.prepare(spark), sf_dir, "pages")
    index = warc.write(pages, common.new_folder(spark, "warc"))
    found = warc.read(index).select("page_id", F.length("payload").cast("long").alias("payload_bytes"), F.col("digest").alias("payload_digest"), "record_type", "refers_to")
    found = common.stage_table(found, "records")
    originals = found.where("record_type = 'response'").groupBy("payload_digest").agg(F.max("payload_bytes").alias("original_bytes"))
    full = found.where("record_type = 'revisit'").join(originals, "payload_digest").withColumn("payload_bytes", F.col("original_bytes"))
    return found.where("record_type = 'response'").unionByName(full.select(found.columns))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    common.prepare(spark)
    rows = quality_rules.judge(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op3_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(common.table(spark, sf_dir, "documents"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(common.prepare(spark), sf_dir, "documents")
    rows = packing.pack(docs, vocabulary("byte_bpe_50k.json"), capacity=1024, end_id=0)
    return rows.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(common.prepare(spark), sf_dir, "documents")
    rows = simhash.classes(docs, shingle=3, radius=2)
    return rows.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = common.table(common.prepare(spark), sf_dir, "pages")
    rules = tuple(url_filter.Rule.of_site(verdict, site) for verdict, site in url_filter.SITES)
    return url_filter.judge(pages, rules, tuple(url_filter.Rule(g, "block", g) for g in url_filter.SPAM))


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(common.prepare(spark), sf_dir, "documents")
    manifest = token_files.write(docs, common.new_folder(spark, "tokens"), vocabulary("word_bpe_49k.json"), end_id=1)
    rows = token_files.read(spark, manifest)
    return rows.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    common.prepare(spark)
    return decontaminate.find(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))


def op9_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(common.prepare(spark), sf_dir, "documents")
    rows = substring.deduplicate(docs, window=20)
    return rows.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op10_site_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    common.prepare(spark)
    return site_quality.judge(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = common.table(common.prepare(spark), sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("long") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(rows.withColumn("label", label), anchor="vec_id % 100 = 0")


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(common.prepare(spark), sf_dir, "documents")
    of = lambda text: merkle.leaf(*map(F.col, ("doc_id", "source", "lang", "n_chars")), text)
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, of(F.translate("text", "\n", "")))
    leaves = docs.select(F.col("source").alias("part"), common.long_id(docs, "doc_id").alias("id"), of(F.col("text")).alias("leaf"), tampered.alias("changed"))
    rows = merkle.build(leaves).fold()
    return rows.select(F.col("id").alias("doc_id"), "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def op13_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, rules = common.table(common.prepare(spark), sf_dir, "documents").select("doc_id", "text"), (*secret_scan.BASE, *secret_scan.MORE)
    ledger = secret_scan.Ledger(spark, common.new_folder(spark, "secrets"))
    ledger.scan(docs, rules)
    rows, base = ledger.findings(docs, rules), [r.kind for r in secret_scan.BASE]
    counts = [F.size(secret_scan.of_kinds("spans", k)).cast("long").alias(f"n_{k}") for k in base]
    return rows.select("doc_id", *counts, F.sha2(secret_scan.listed(secret_scan.of_kinds("spans", *base)), 256).alias("base_sha256"), secret_scan.listed("spans").alias("spans"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_warc, op2_quality_rules, op3_licences, op4_packing, op5_simhash, op6_url_filter, op7_token_files, op8_decontaminate, op9_substring, op10_site_quality, op11_hard_negatives, op12_merkle, op13_secret_scan)
}
ORACLES: dict[str, str] = {"op2_quality_rules": quality_rules.oracle_sql(), "op3_licences": licences.oracle_sql(), "op6_url_filter": url_filter.oracle_sql(), "op11_hard_negatives": hard_negatives.oracle_sql(), "op12_merkle": merkle.oracle_sql(), "op13_secret_scan": secret_scan.oracle_sql()}
