"""The stages of the pipeline on a small table, and the SQL of the operators that have one."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from signalspark.llm.queries import ORACLES, QUERIES
from tests.llm.test_operators import brute_components, brute_fingerprint
from tests.oracle import assert_same, connect

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql(spark, name):
    assert_same(spark, connect(SF), SF, QUERIES[name], ORACLES[name])


def test_stages_keep_columns_and_do_their_work(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    secret = "password=e3b3ed3cc8548923d6"
    extra = [(10_001, "12345 !!", "en", "s", 8), (10_002, None, "en", "s", None), (10_003, f"The house and the tree with the {secret} in the garden.", "en", "s", 70)]
    docs = docs.union(spark.createDataFrame(extra, docs.schema)).withColumn("__extra", F.lit(1)).cache()
    (_, languages), (_, dedup), (_, clean), (_, secrets), (_, mixed) = corpus_pipeline.STAGES
    a = languages(spark, docs, SF).cache()
    assert a.columns == docs.columns and docs.join(a, "doc_id", "left_anti").where("doc_id NOT IN (10001, 10002)").count() == 0 and a.where("doc_id IN (10001, 10002)").count() == 0
    b = dedup(spark, a, SF).cache()
    listed = sorted((r["doc_id"], brute_fingerprint(r["text"])) for r in a.select("doc_id", "text").collect())
    roots = brute_components([f for _, f in listed])
    assert sorted(r["doc_id"] for r in b.select("doc_id").collect()) == sorted({listed[r][0] for r in roots}) and b.columns == docs.columns
    c = clean(spark, b, SF).cache()
    items = [r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    held = {r["doc_id"] for r in b.collect() if any(i in r["text"] for i in items)}
    assert {r["doc_id"] for r in b.join(c, "doc_id", "left_anti").collect()} >= held and c.columns == docs.columns
    d = secrets(spark, c, SF).cache()
    row = d.where("doc_id = 10003").first()
    assert secret not in row["text"] and row["n_chars"] == len(row["text"]) and d.count() == c.count()
    e = mixed(spark, d, SF)
    assert e.columns == [*docs.columns, "size", "source_size", "target", "taken"] and e.where("taken <= 0").count() == 0


def test_empty_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        assert docs.count() == 0


#: Names that stages use inside, and those of their results.
CLASHES = ("__lang", "__text", "__row", "__s", "__size", "row", "at", "fp", "root", "id", "key", "size", "taken", "target", "source_size", "own_size", "own_hash", "cut_source", "language_found", "text_read", "score", "words", "h")


def test_stages_on_edges_with_clashing_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 40")
    text = docs.first()["text"]
    long = " ".join(r["text"] or "" for r in docs.collect()) * 20
    extra = [(None, text, "en", "s", 1), (None, None, None, None, None), (1, text, "en", None, 1), (1, text, "en", None, 1), (900, "", "en", "s", 0), (901, long, "en", "s", len(long)), (902, long, "en", "s", len(long))]
    docs = docs.union(spark.createDataFrame(extra, docs.schema)).withColumns({c: F.lit("mine") for c in CLASHES})
    for name, stage in corpus_pipeline.STAGES[:4]:
        got = stage(spark, docs, SF)
        assert got.columns == docs.columns, name
        for c in CLASHES:
            assert [r[c] for r in got.select(c).distinct().collect()] == ["mine"], (name, c)
        n = {"language ID": docs.where("text IS NOT NULL AND text <> ''").count(), "secrets": docs.count(), "decontamination": None, "near-dedup": None}[name]
        assert n is None or got.count() == n, name
        if name == "near-dedup":
            ids = [r["doc_id"] for r in got.select("doc_id").collect()]
            assert len(ids) == len(set(ids)) and not {901, 902} <= set(ids)
    mixed = corpus_pipeline.mixed(spark, docs, SF)
    assert {c for c in mixed.columns if c in CLASHES} == set(CLASHES) and dict(mixed.dtypes)["size"] == "bigint"
    assert mixed.select("own_hash").distinct().collect()[0][0] == "mine" and mixed.where("taken NOT IN (size, 2 * size)").count() == 0


def test_run_leaves_nothing_behind_but_its_result(spark):
    import os

    from signalspark.functions.shared import shared_folder

    folder = shared_folder(spark).removeprefix("file://") + "/signalspark"
    before = set(os.listdir(folder)) if os.path.isdir(folder) else set()
    assert corpus_pipeline.run(spark, SF).count() > 0
    assert [name.split("-")[0] for name in set(os.listdir(folder)) - before] == ["mixing"]
