"""The corpus pipeline: quality rules, line dedup, SimHash near-dedup, mixing, byte-level BPE.

Defined results: a document without words (a null, empty or blank text) fails the base rules and goes in the first stage;
null ids, languages and sources stay, a null source being a source of its own in the mix; repeated rows are one group of
copies, of which the first read stays; of documents with equal ids the first read stays; texts are whole at any length in
every stage; an empty table gives an empty table; extra columns pass through all stages, but in the last one columns of
the names it makes (in any case) are replaced.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.bpe import bpe_round_trip
from tidemark.llm.common import Passed, read, shared_dir
from tidemark.llm.lines import line_dedup
from tidemark.llm.mixing import mixed_documents
from tidemark.llm.quality import quality_filter
from tidemark.llm.simhash import simhash_dedup


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go; the others lose their failing lines."""
    return quality_filter(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A line that ten documents or more hold stays in its first place only."""
    own, name = Passed(docs).inner()
    out = line_dedup(own, text=name("text"), doc_id=name("doc_id"), min_docs=10, keep_first=True)
    fresh = {"n_chars": F.length(F.col(name("text"))).cast("long")}
    return out.select([fresh.get(c, F.col(f"__doc{k}")).alias(c) for k, c in enumerate(docs.columns)])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of similarity 0.8 or more over shingles of five words stays."""
    return simhash_dedup(docs, words=5, similarity=0.8)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixed_documents(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids (little-endian unsigned 32-bit integers) in the text's place, with digests of the ids and of the bytes
    they decode to."""
    own, name = Passed(docs).inner()
    text = name("text")
    encoded = bpe_round_trip(own, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, text=text)
    made = {
        "ids": F.col("ids"),
        "n_tokens": (F.octet_length("ids") / 4).cast("long"),
        "ids_sha256": F.sha2("ids", 256),
        "decoded_sha256": F.sha2("decoded", 256),
    }
    kept = [(f"__doc{k}", c) for k, c in enumerate(docs.columns) if f"__doc{k}" != text and c.lower() not in made]
    return encoded.select([F.col(k).alias(c) for k, c in kept] + [v.alias(c) for c, v in made.items()])


STAGES = [
    ("quality_rules", quality),
    ("line_dedup", lines),
    ("simhash_near_dedup", near_duplicates),
    ("source_mix", mixing),
    ("byte_bpe", tokens),
]

#: SimHash components, Newton iterations and BPE are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and reread as the next one's docs."""
    docs = read(spark, sf_dir, "documents")
    root = f"{shared_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        path = f"{root}/{k}_{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
