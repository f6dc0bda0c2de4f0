"""The registered queries: thin uses of the operators over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (collocations, decontam, html_text, jaccard, mixing, packing, prefix_trie, quality, repeats, secret_scan,
               sharding, topk, warc)
from .common import read, scratch, stored


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.secret_report(read(spark, sf_dir, "documents"))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "warc")
    warc.write_archive(read(spark, sf_dir, "pages"), path)
    return warc.read_archive(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op3_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(topk.integer_vectors(read(spark, sf_dir, "embeddings")), F.col("vec_id") % 100 == 0)


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.place(read(spark, sf_dir, "documents").select("doc_id")).select("doc_id", "slot", "shard")


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")).drop("h")


def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_pages(read(spark, sf_dir, "pages"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_join(read(spark, sf_dir, "documents")).drop("h", "component")


def op9_repeat_removal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored(repeats.remove_repeats(read(spark, sf_dir, "documents"), bytes_too=False), "removed", repeats.TEXT_ROWS)


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_documents(read(spark, sf_dir, "documents"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie_report(prefix_trie.prefix_trie(read(spark, sf_dir, "conversations")))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.top_phrases(collocations.collocations(read(spark, sf_dir, "documents")))


def op13_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.checksums(packing.pack(read(spark, sf_dir, "documents")))
    return packed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


QUERIES = {f.__name__: f for f in (op1_secret_scan, op2_warc, op3_exact_topk, op4_sharding, op5_decontamination,
                                  op6_html_text, op7_quality, op8_jaccard_join,
                                  op9_repeat_removal, op10_mixing, op11_prefix_trie, op12_collocations, op13_packing)}
