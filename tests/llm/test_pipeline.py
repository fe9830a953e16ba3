"""The pipeline's stages against brute force on small tables."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from linkforge.llm import packing, queries, secret_scans, toxicity
from tests.llm.test_texts import brute_components, brute_lines, brute_passages, check_packing

SF = "/root/testdata/sf0.001"


def test_run_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = queries.toxicity_model(spark, SF)
    rows = [r for r in docs.orderBy("doc_id").collect() if model.score(r["text"] or "") < 0.7]
    texts = dict(zip([r["doc_id"] for r in rows], [t for t, _ in brute_passages(brute_lines([r["text"] for r in rows]))], strict=True))
    before = {r["doc_id"]: r["text"] for r in rows}
    texts = {i: t for i, t in texts.items() if (t or "").strip(" \t\r\n\v\f") or t == before[i]}
    ids = sorted(texts)
    kept = [ids[k] for k, (_, c) in enumerate(brute_components([texts[i] for i in ids], 5, 8, 10)) if c == k]
    cleaned = secret_scans.redact(spark.createDataFrame([(i, texts[i]) for i in kept], "doc_id long, text string"))
    want = {r["doc_id"]: r["text"] for r in cleaned.collect()}
    got = corpus_pipeline.run(spark, SF).collect()
    assert {r["doc_id"] for r in got} == set(kept)
    number = {i: k for k, i in enumerate(kept)}
    renamed = [r.asDict() | {"doc_id": number[r["doc_id"]]} for r in got]
    bins = check_packing(renamed, [want[i] for i in kept], 2048)
    assert bins <= -(-sum(r["length"] for r in renamed) // 2048) + 1


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES[:-1])
def test_stages_keep_columns(spark, name, stage):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = docs.limit(20).unionByName(docs.limit(3)).unionByName(docs.limit(1).withColumn("doc_id", F.lit(None).cast("long")).withColumn("text", F.lit(None).cast("string")))
    odd = odd.withColumn("component_id", F.lit("x")).withColumn("spans", F.lit(1)).withColumn("lines", F.lit(None).cast("double"))
    out = stage(spark, odd, SF)
    assert out.columns == odd.columns
    assert out.where("doc_id is null").count() == 1
    if name == "ngram_jaccard_join":
        assert out.groupBy("doc_id", "text").count().where("count > 1").count() == 0
    assert stage(spark, odd.limit(0), SF).count() == 0


def test_near_duplicates_lose_no_clean_text(spark):
    """A doc_id with two texts loses only the copy; equal rows leave one; null doc_ids stay."""
    long = " ".join(f"w{i}" for i in range(40))
    rows = [(1, long, "x"), (7, long + " w40", "x"), (7, "quite another text of this id", "x"), (7, "quite another text of this id", "b"), (5, "quite another text of that id", "x"), (None, long, "x"), (8, None, "x"), (8, None, "x"), (9, "", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, mark string").withColumn("id", F.lit(1)).withColumn("ID_", F.lit(2))
    out = corpus_pipeline.drop_near_duplicates(spark, docs, SF)
    assert out.columns == docs.columns
    assert sorted(map(tuple, out.select("doc_id", "text", "mark").collect()), key=str) == sorted([rows[0], (7, "quite another text of this id", "b"), *rows[4:7], *rows[8:]], key=str)


def test_packing_takes_clashing_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("length", F.lit("x")).withColumn("rank", F.lit(1))
    assert packing.pack(docs).select("doc_id").distinct().count() == docs.count()
    assert toxicity.score(docs, queries.toxicity_model(spark, SF)).count() == docs.count()
