"""Registered queries: SQL where there is some, and the pipeline."""

import pytest

from tests.conftest import same_as_sql
from tidemark.llm.entries import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_as_sql(spark, duck, sf_dir, name):
    same_as_sql(spark, duck, sf_dir, QUERIES[name], ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES) - {"op13_embedding_whitening"}))
def test_a_row_a_document(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() == spark.read.parquet(f"{sf_dir}/documents.parquet").count()


def test_whitening_of_the_table(spark, sf_dir):
    out = QUERIES["op13_embedding_whitening"](spark, sf_dir)
    n = spark.read.parquet(f"{sf_dir}/embeddings.parquet").count()
    assert out.count() == 32 * n and out.where(f"n <> {n} OR identity_error > 0.0001").count() == 0


def test_a_query_for_each_operator():
    assert {int(n[2:].split("_")[0]) for n in QUERIES} == set(range(1, len(QUERIES) + 1))


def test_pipeline_stages(spark, sf_dir, tmp_path):
    import hashlib

    import corpus_pipeline as cp

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    start = docs.columns
    held = {}
    for k, (name, stage) in enumerate(cp.STAGES):
        stage(spark, docs, sf_dir).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        if k < 4:
            assert docs.columns == start
        held[name] = docs
    assert held["quality_rules"].count() >= held["simhash_near_dedup"].count() > 0
    mixed = {r["doc_id"]: r["text"] for r in held["source_mix"].collect()}
    assert max(r["count"] for r in held["source_mix"].groupBy("doc_id").count().collect()) <= 2
    for r in docs.collect():
        assert r["decoded_sha256"] == hashlib.sha256(mixed[r["doc_id"]].encode()).hexdigest()
        assert r["ids_sha256"] == hashlib.sha256(r["ids"]).hexdigest() and r["n_tokens"] * 4 == len(r["ids"])
    assert docs.count() == held["source_mix"].count()


def test_near_copies_of_the_pipeline_against_brute_force(spark, sf_dir):
    from tidemark.llm.simhash import simhash_dedup

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = {r["doc_id"] for r in simhash_dedup(docs).collect()}
    sets = {}
    for r in docs.collect():
        w = r["text"].lower().split()
        sets[r["doc_id"]] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}
    group = {d: d for d in sets}
    for a in sets:
        for b in sets:
            if a < b and group[a] != group[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                low, high = sorted((group[a], group[b]))
                group = {d: low if g == high else g for d, g in group.items()}
    assert kept == set(group.values())


def test_pipeline_of_odd_tables(spark, docs, nothing, tmp_path):
    """Nulls in every column, ties, repeated rows, clashing extra columns, and an empty table go through all stages."""
    import corpus_pipeline as cp

    odd = docs.withColumnsRenamed({"IDS": "row", "Kept": "node", "fp": "src", "size": "IDS"})
    for label, now in (("odd", odd), ("none", nothing)):
        start = now.columns
        for k, (_, stage) in enumerate(cp.STAGES):
            stage(spark, now, "").write.parquet(f"{tmp_path}/{label}{k}")
            now = spark.read.parquet(f"{tmp_path}/{label}{k}")
            assert k == 4 or now.columns == start
        assert [c for c in start if c not in ("text", "IDS")] == now.columns[:-4]
        if label == "none":
            assert now.count() == 0
        else:
            assert now.where("row = 'mine' AND node = 'mine' AND src IS NULL").count() == now.count() > 0


CLASHES = [
    "src", "n", "none", "part", "delta", "fixed", "__h", "__words", "__body", "__in", "__id", "best", "__row", "row", "key", "grp", "node", "low",
    "id", "k", "v", "t", "q", "at", "root", "salt", "body", "gone", "nth", "first", "end", "__b", "__kept0", "__kept1", "__kept9", "__doc0", "bands", "source_", "TEXT", "Doc_ID",
]


def test_any_extra_column_passes_through(spark):
    """Extra columns of any internal name keep their values through the eight text operators."""
    import public_tokenizers as tok

    from tidemark.llm.bpe import bpe_encode, bpe_round_trip
    from tidemark.llm.langid import identify, train
    from tidemark.llm.lines import line_dedup
    from tidemark.llm.mixing import mix_sources, mixed_documents
    from tidemark.llm.quality import quality_filter, quality_rules
    from tidemark.llm.sharding import shard_documents
    from tidemark.llm.simhash import simhash_components, simhash_dedup
    from tidemark.llm.tokens import token_counts

    text = " ".join(f"word{j} of a sentence" for j in range(12)) + "."
    rows = [(i, f"{text} Number {i // 2}." if i % 5 else None, "en", f"s{i % 2}", *[f"{c}{i}" for c in CLASHES]) for i in range(12)]
    spark.conf.set("spark.sql.caseSensitive", "true")
    try:
        df = spark.createDataFrame(rows, ["doc_id", "text", "lang", "source", *CLASHES])
    finally:
        spark.conf.set("spark.sql.caseSensitive", "false")
    ranks, whole = tok.path("byte_bpe_50k.tiktoken"), tok.path("byte_bpe_50k.json")
    outs = {
        "op1": mix_sources(df), "op1 copies": mixed_documents(df), "op2": quality_rules(df), "op2 filter": quality_filter(df), "op3": line_dedup(df),
        "op4": token_counts(df, whole, tok.PATTERN), "op6": bpe_encode(df, ranks, tok.PATTERN), "op6 both": bpe_round_trip(df, ranks, tok.PATTERN),
        "op7": identify(df, train(df)), "op8": shard_documents(df, 3), "op9": simhash_components(df), "dedup": simhash_dedup(df),
    }
    for label, out in outs.items():
        at = [out.columns.index(c) for c in CLASHES]
        got = out.collect()
        assert got or label == "op2 filter", label
        for r in got:
            i = r[out.columns.index("doc_id")]
            assert [r[k] for k in at] == [f"{c}{i}" for c in CLASHES], label
