"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import oracles
from tidemark.llm.bpe import bpe_round_trip
from tidemark.llm.common import read, written
from tidemark.llm.infill import infill, restore
from tidemark.llm.langid import identify, train
from tidemark.llm.licenses import license_scan
from tidemark.llm.lines import line_dedup
from tidemark.llm.mixing import mix_sources, word_count
from tidemark.llm.quality import quality_rules
from tidemark.llm.search import top_k
from tidemark.llm.sharding import shard_documents
from tidemark.llm.simhash import simhash_components
from tidemark.llm.tokens import token_counts
from tidemark.llm.warc import header_lines, records_of_pages, resolve_revisits
from tidemark.llm.whitening import whiten


def op1_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "source", word_count(F.col("text")).alias("words"))
    out = mix_sources(written(docs), size="words")
    return out.select("doc_id", "size", "source_size", "target", "taken", "source", "rate", "copies")


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return quality_rules(docs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    out = line_dedup(docs, min_docs=10, keep_first=False, min_chars=1)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    out = token_counts(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)
    return out.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 512).alias("over_limit"))


def op5_top_k_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return top_k(vectors, F.col("vec_id") % 50 == 0, k=5, scale=256)


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    out = bpe_round_trip(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return out.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    part = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3))
    profiles = train(docs.where(part != 1).select("text", "lang"))
    held_out = docs.select("doc_id", F.coalesce(part == 1, F.lit(False)).alias("held_out"), "text")
    return identify(held_out, profiles)


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return shard_documents(docs, shards=24).select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    out = simhash_components(docs, words=3, radius=2)
    return out.select("doc_id", F.lower(F.hex("fp")).alias("fingerprint"), "component_id")


def op10_revisit_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = resolve_revisits(records_of_pages(read(spark, sf_dir, "pages")))
    return out.select(
        "record_id", "canonical", F.unix_timestamp("at").alias("revisit_at"), "status", "response_id",
        header_lines("headers").alias("headers"),
    )


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    digest = lambda c: F.sha2(F.col(c).cast("binary"), 256).alias(f"{c}_sha256")
    out = restore(infill(docs))
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest("output"), digest("restored"))


def op12_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return license_scan(docs).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans")


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(read(spark, sf_dir, "embeddings").select("vec_id", "embedding"), components=32, scale=64, offset=1_000_000)


QUERIES = {
    "op1_source_mix": op1_source_mix,
    "op2_quality_rules": op2_quality_rules,
    "op3_line_dedup": op3_line_dedup,
    "op4_token_counts": op4_token_counts,
    "op5_top_k_search": op5_top_k_search,
    "op6_byte_bpe": op6_byte_bpe,
    "op7_language_id": op7_language_id,
    "op8_sharding": op8_sharding,
    "op9_simhash": op9_simhash,
    "op10_revisit_resolution": op10_revisit_resolution,
    "op11_fill_in_middle": op11_fill_in_middle,
    "op12_license_scan": op12_license_scan,
    "op13_embedding_whitening": op13_embedding_whitening,
}

ORACLES = {
    "op2_quality_rules": oracles.OP2,
    "op3_line_dedup": oracles.OP3,
    "op5_top_k_search": oracles.OP5,
    "op10_revisit_resolution": oracles.OP10,
    "op11_fill_in_middle": oracles.OP11,
}
