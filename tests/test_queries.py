"""Each registered query of the linkage engine runs and agrees with its SQL; decisions hold their laws."""

import math

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from linkforge.operators import decide, evaluate, windows
from linkforge.plans import catalogue
from linkforge.sources import tables

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents pages labels".split()


def plain(v):
    return "nan" if isinstance(v, float) and math.isnan(v) else repr(round(v, 9)) if isinstance(v, float) else str(v)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query(spark, con, name):
    df = catalogue.queries()[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    sql = catalogue.oracle_sql().get(name)
    if sql:
        result = con.execute(sql)
        names = [d[0] for d in result.description]
        assert sorted(names) == columns
        assert got == sorted(tuple(plain(r[names.index(c)]) for c in columns) for r in result.fetchall())


def test_entry(spark):
    assert __spark_entry__.entry(spark).columns == ["s1", "src", "t", "p"]


def scored(spark, *rows):
    return spark.createDataFrame(rows, "s1 string, src int, t string, p double")


def test_decisions(spark):
    s = scored(spark, ("a", 2, "t", 0.9), ("b", 2, "t", 0.8), ("c", 2, "u", 0.5), ("d", 2, "u", 0.5))
    assert [r["s1"] for r in decide.one_to_one(s).orderBy("s1").collect()] == ["a", "c"]
    assert decide.select_expected_f(scored(spark, ("a", 2, "t", 0.9))).count() == 1
    assert decide.select_expected_f(scored(spark, ("a", 2, "t", 0.2))).count() == 0
    counts = [decide.select_threshold(s, t).count() for t in (0.1, 0.6, 0.95)]
    assert counts == sorted(counts, reverse=True)


def test_top2(spark):
    s = scored(spark, ("a", 2, "t", 3.0), ("b", 2, "t", 5.0), ("b", 2, "u", 5.0))
    got = {(r["s1"], r["t"]): (r["x_gap"], r["x_margin"], r["x_rank"]) for r in windows.top2(s, ["s1"], "p", ["t"], "x").collect()}
    assert got == {("a", "t"): (0.0, 4.0, 0), ("b", "t"): (0.0, 0.0, 0), ("b", "u"): (0.0, 0.0, 1)}


def test_macro_f(spark):
    e = spark.createDataFrame([("a",), ("b",), ("c",)], "s1 string")
    none = spark.createDataFrame([], "s1 string, tgt string")
    pred = spark.createDataFrame([("a", "x"), ("b", "y")], "s1 string, tgt string")
    true = spark.createDataFrame([("a", "x")], "s1 string, tgt string")
    got = {r["s1"]: r["f"] for r in evaluate.per_entity(pred, true, e).collect()}
    assert got == {"a": 1.0, "b": 0.0, "c": 1.0}
    assert {r["f"] for r in evaluate.per_entity(none, none, e).collect()} == {1.0}


def test_files(spark, tmp_path):
    path = str(tmp_path / "in.tsv")
    with open(path, "w") as f:
        f.write('entity_id\tbusiness_name\tbusiness_address\tcountry\nS1-1\tA "q" \\ b\t\tUS\n')
    got = tables.read_tsv(spark, path).collect()
    assert [tuple(r) for r in got] == [("S1-1", 'A "q" \\ b', "", "US")]
    lists = spark.createDataFrame([("S1-2", "S2-1,S3-4"), ("S1-1", "")], "s1 string, m string")
    tables.write_id_lists(lists.coalesce(1), str(tmp_path / "out"), F.col("s1"))
    text = "".join(p.read_text() for p in (tmp_path / "out").glob("*.csv"))
    assert text.replace("s1\tm\n", "", text.count("s1\tm") - 1) == "s1\tm\nS1-1\t\nS1-2\tS2-1,S3-4\n"
    pairs, every = tables.explode_truth(spark.createDataFrame([("a", "x,y"), ("b", "")], "source1_entity_id string, matched_entity_ids string"))
    assert pairs.count() == 2 and every.count() == 2


def test_stream_of_arrivals(spark, tmp_path):
    from linkforge.operators import blocking
    from linkforge.streaming.arrivals import score_arrivals

    r = catalogue.records(spark, SF).drop("body")
    targets = r.where("src <> 1")
    keys = blocking.postings(targets)
    index = keys.join(blocking.key_stats(keys, targets, catalogue.CAP).drop("df"), ["country", "src", "fam", "key"])
    r.where("src = 1").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(r.schema).parquet(str(tmp_path / "in"))
    seen = []
    score_arrivals(stream, index, lambda df, n: seen.append(df.select("s1", "t").collect()), str(tmp_path / "ck")).awaitTermination()
    want = catalogue.all_scores(spark, SF).where("rank < 5 and s_tot > 0").select("s1", "t").collect()
    assert sorted(map(tuple, sum(seen, []))) == sorted(map(tuple, want))
