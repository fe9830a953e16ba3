"""Features, learned operators, enrichment, validation and files on small tables, against brute force or literal cases."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from linkforge.operators import blocking, enrich, features, learn, report, validate, whole_texts
from linkforge.plans import catalogue
from linkforge.sources import tables

SF = "/root/testdata/sf0.001"
RECORD = "id string, src int, country string, name string, core string, alt string, is_dom int, script string, addr string, nums string, state string"


def records(spark, *rows):
    return spark.createDataFrame(rows, RECORD)


def test_retrieval_against_brute_force(spark):
    """Production cap and depths over the whole records; a key of many queries is salted to the same result."""
    r = catalogue.parties_normalized(spark, SF)
    rows = [x.asDict() for x in r.collect()]
    keys = {(x["id"], x["fam"], x["key"]) for x in blocking.postings(r).collect()}
    own = defaultdict(set)
    for i, fam, key in keys:
        own[i].add((fam, key))
    of = {x["id"]: x for x in rows}
    sizes, df = Counter((x["country"], x["src"]) for x in rows), Counter((of[i]["country"], of[i]["src"], fam, key) for i, fam, key in keys)
    want = {}
    for q in (x for x in rows if x["src"] == 1):
        for src in (2, 3):
            found = {}
            for t in (x for x in rows if x["src"] == src and x["country"] == q["country"]):
                s = Counter()
                for fam, key in own[q["id"]] & own[t["id"]]:
                    if (n := df[q["country"], src, fam, key]) <= 3000:
                        s[fam] += math.log1p(sizes[q["country"], src] / n)
                if s:
                    found[t["id"]] = {f: round(s[f], 6) for f in blocking.FAMILIES}
            total = {t: round(sum(s.values()), 6) for t, s in found.items()}
            for value, depth in ((total, 30), ({t: s["name"] for t, s in found.items()}, 15), ({t: s["addr"] for t, s in found.items()}, 15)):
                order = sorted(found, key=lambda t: (-min(round(value[t] * 64), 2**20 - 1), -min(round(total[t] * 16), 4095), t))
                want.update({(q["id"], t): total[t] for t in order[:depth] if value[t] > 0})
    got = {(x["s1"], x["t"]): x["s_tot"] for x in blocking.retrieve(r).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-5 for k in want)


def test_hot_query_keys_are_salted(spark, monkeypatch):
    r = catalogue.parties_normalized(spark, SF)
    plain = {tuple(x) for x in blocking.retrieve(r).collect()}
    monkeypatch.setattr(blocking, "HOT", 3)
    assert {tuple(x) for x in blocking.retrieve(r).collect()} == plain


def test_pairs_of_a_block_meet_in_one_task(spark, monkeypatch):
    """No pair is shuffled; sums and ranks are those of the joins, with a cap that bites, repeated ids, no country and no tokens."""
    monkeypatch.setattr(blocking, "HOT", 16)
    r = catalogue.parties_normalized(spark, SF).select("id", "src", "country", "core", "addr", "state")
    odd = spark.createDataFrame([("S1-x", 1, None, "acme tools", "7 main", ""), ("S2-x", 2, None, "acme tools", "7 main", ""), ("S1-y", 1, "", "", "", ""), ("S2-y", 2, "Z", "acme", "", ""), ("S1-z", 1, "W", "acme", "", "")], "id string, src int, country string, core string, addr string, state string")
    r = r.union(r.where("id like '%7'")).union(odd).persist()
    keys = blocking.postings(r)
    targets = keys.where("src <> 1")
    want = blocking.ranked(blocking.scores(keys.where("src = 1"), targets, blocking.key_stats(targets, r.where("src <> 1"), 5))).persist()
    rows = lambda df: {(x["country"], x["src"], x["s1"], x["t"]): tuple(x[c] for c in df.columns[4:]) for x in df.collect()}
    same = lambda a, b: a.keys() == b.keys() and all(x == pytest.approx(y, abs=2e-6) for k in a for x, y in zip(a[k], b[k], strict=True))
    columns = ["country", "src", "s1", "t", "s_name", "s_addr", "s_cross", "s_tot"]
    every, few = blocking.pair_scores(r, 5), blocking.retrieve(r, 5, 4, 2, 1)
    assert same(rows(every), rows(want.select(columns)))
    assert same(rows(few), rows(blocking.cut(want, 4, 2, 1).select(*columns, *blocking.RANKS)))
    for df in (every, few):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "hashpartitioning(land" in plan and not re.search(r"hashpartitioning\([^)]*\bs1#", plan)
    assert blocking.retrieve(r.where("src = 1")).count() == 0 and blocking.retrieve(r.where("src <> 1")).count() == 0


def test_every_token_of_a_text_is_a_key(spark, tmp_path):
    """Two texts share words beyond the first 6 of the name and the first 10 of the rest only."""
    said = lambda k, name, rest: " ".join(f"n{k}x{i}q" for i in range(name)) + " zebra\n" + " ".join(f"a{k}x{i}q" for i in range(rest)) + " yak gnu"
    docs = [(0, said(0, 8, 300), "en"), (1, said(1, 7, 12), "en"), (2, said(2, 9, 40), "fr"), (4, said(4, 3, 3).replace("yak gnu", "").replace("zebra", ""), "en")]
    spark.createDataFrame(docs, "doc_id long, text string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    got = [tuple(x) for x in catalogue.blocking_scores(spark, str(tmp_path)).collect()]
    w = math.log1p(2)  # one of two targets: zebra; yak, gnu and both; zebra with yak and with gnu
    assert got == [(2, "S1-0", "S2-1", pytest.approx(w, abs=1e-6), pytest.approx(3 * w, abs=1e-6), pytest.approx(2 * w, abs=1e-6), pytest.approx(6 * w, abs=3e-6))]
    assert catalogue.retrieve_union3(spark, str(tmp_path)).count() == 0


@pytest.mark.parametrize("cap", [2, 3000])
def test_whole_texts_are_summed_as_by_joins(spark, monkeypatch, cap):
    """With a cap that bites, several blocks, repeated ids, no country and no tokens; neither pairs nor keys of pairs are shuffled."""
    monkeypatch.setattr(blocking, "HOT", 16)
    monkeypatch.setattr(whole_texts, "LEAST", 3)
    r = catalogue.records(spark, SF).drop("body").where("doc_id < 60").select("id", "src", "country", "core", F.substring("addr", 1, 500).alias("addr"), "state")
    odd = spark.createDataFrame([("S1-x", 1, None, "acme tools", "7 main", ""), ("S2-x", 2, None, "acme tools", "7 main", ""), ("S1-y", 1, "", "", "", ""), ("S2-y", 2, "Z", "acme", "", ""), ("S1-z", 1, "W", "acme", "", "")], "id string, src int, country string, core string, addr string, state string")
    r = r.union(r.where("id like '%7'")).union(odd).persist()
    keys = blocking.postings(r, None, None)
    targets = keys.where("src <> 1")
    want = blocking.scores(keys.where("src = 1"), targets, blocking.key_stats(targets, r.where("src <> 1"), cap))
    got = whole_texts.pair_scores(r, cap)
    rows = lambda df: {(x["country"], x["src"], x["s1"], x["t"]): (x["s_name"], x["s_addr"], x["s_cross"]) for x in df.collect()}
    a, b = rows(got), rows(want)
    assert len(a) > 100 and a.keys() == b.keys() and all(x == pytest.approx(y, abs=2e-6) for k in a for x, y in zip(a[k], b[k], strict=True))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(land" in plan and not re.search(r"hashpartitioning\([^)]*\b(s1|key|h)#", plan)


@pytest.mark.parametrize("share, common, pairs", [(2, 3, 7), (2, 100, 50), (10**6, 100, 3), (1, 0, 10**6)])
def test_sums_of_common_and_rare_tokens(monkeypatch, share, common, pairs):
    """Whatever is summed by matrices or one by one, in whichever parts, gives the sums of all keys."""
    for name, value in {"SHARE": share, "COMMON": common, "PAIRS": pairs, "SLICE": 5}.items():
        monkeypatch.setattr(whole_texts, name, value)
    some, cap = random.Random(5), 9
    pick = lambda most: sorted({int(some.random() ** 3 * 20) for _ in range(some.randrange(most))})
    made = [(f"t{k}", pick(6), pick(9)) for k in range(23)]
    batch = lambda rows: [pa.RecordBatch.from_pydict({"id": [x[0] for x in rows], "n": [x[1] for x in rows], "a": [x[2] for x in rows], "c": [[hash(tuple(x[1]))] * bool(x[1]) for x in rows]}, pa.schema([("id", pa.string()), *((c, pa.list_(pa.int64())) for c in "nac")]))]
    index = whole_texts._Index(whole_texts._Rows(batch(made)), cap)

    def keys(n, a):
        return {0: {("c", *n)} - {("c",)} | {(x, y) for x in n for y in n if x <= y}, 1: {(x, y) for x in a for y in a if x <= y}, 2: {(x, y) for x in n for y in a}}

    of = [keys(n, a) for _, n, a in made]
    for _, n, a in [*made[:6], ("q", pick(9), pick(15)), ("none", [], []), ("new", [77], [78])]:
        asked, whole = keys(n, a), np.array([hash(tuple(n))] * bool(n), np.int64)
        got = index.sums(index.numbers([np.array(n, np.int64), np.array(a, np.int64), whole])).sum(axis=0)
        for f in range(3):
            df = {k: sum(k in o[f] for o in of) for k in asked[f]}
            assert got[f] == pytest.approx([sum(math.log1p(len(of) / df[k]) for k in asked[f] & o[f] if df[k] <= cap) for o in of], abs=1e-9)


def joined(df):
    """The columns that go into the joins of a plan."""
    out, todo = set(), [df._jdf.queryExecution().optimizedPlan()]
    while todo:
        node = todo.pop()
        below = [node.children().apply(k) for k in range(node.children().size())]
        if node.nodeName() == "Join":
            out |= {c.output().apply(k).name() for c in below for k in range(c.output().size())}
        todo += below
    return out


@pytest.mark.parametrize("name", ["core_frequency", "token_features", "pair_flags", "translit_vote"])
def test_no_text_moves_with_a_pair(spark, name):
    assert not {c for c in joined(catalogue.queries()[name](spark, SF)) if re.match("(name|core|addr|body)_[ab]$", c)}


def test_sweep_repeats_no_pair(spark):
    todo = [catalogue.rule_sweep(spark, SF)._jdf.queryExecution().optimizedPlan()]
    while todo:
        node = todo.pop()
        assert node.nodeName() != "Generate" or "t" not in {node.output().apply(k).name() for k in range(node.output().size())}
        todo += [node.children().apply(k) for k in range(node.children().size())]


def test_truth_moves_no_text(spark):
    plan = catalogue.truth(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "sha2(" in plan and catalogue.truth(spark, SF).count() > 0


def test_pairs_beside_their_strings(spark, monkeypatch):
    """In several blocks and batches; repeated ids repeat the pair, pairs without a record go."""
    monkeypatch.setattr(blocking, "HOT", 7)
    monkeypatch.setattr(features, "PAIRS", 50)
    r = [(f"S{k % 3 + 1}-{k}", "US" if k % 2 else "FR", k % 3 + 1, f"name {k}", "" if k % 5 else None) for k in range(90)] + [("S1-0", "FR", 1, "again", "")]
    pairs = [(c, src, a, b) for a, c, s, *_ in r[:90] if s == 1 for b, d, src, *_ in r if src > 1 and c == d] + [("US", 2, "S1-none", "S2-1")]
    want = sorted((src, a, b, x[3], str(x[4]), y[3], str(y[4])) for _, src, a, b in pairs for x in r if x[0] == a for y in r if y[0] == b)
    got = features.beside(spark.createDataFrame(pairs, "country string, src int, s1 string, t string"), spark.createDataFrame(r, "id string, country string, src int, name string, more string"))
    assert got.columns == ["src", "s1", "t", "name_a", "more_a", "name_b", "more_b"]
    assert sorted((x[0], x[1], x[2], x[3], str(x[4]), x[5], str(x[6])) for x in got.collect()) == want


def test_core_frequency_by_record(spark):
    r = catalogue.records(spark, SF)
    pairs = blocking.retrieve(r, 3000, 3, 1, 1).persist()
    side = lambda on, name: r.select(F.col("id").alias(on), F.col("core").alias(name))
    columns = ["src", "s1", "t", "t_core_freq", "s1core_t_freq", "s1_core_freq"]
    plain = features.core_frequency(pairs.join(side("s1", "core_a"), "s1").join(side("t", "core_b"), "t"), r).select(columns)
    assert sorted(map(tuple, features.pair_core_frequency(pairs, r).select(columns).collect())) == sorted(map(tuple, plain.collect()))


def test_featurize(spark):
    r = records(
        spark,
        ("S1-1", 1, "US", "acme tools ltd 5551234567", "acme tools 5551234567", "", 0, "L", "7 main street , tx", "7", "tx"),
        ("S2-1", 2, "US", "acme tool 5551234567", "acme tool 5551234567", "tools acme", 0, "L", "7 main road , tx", "7", "tx"),
        ("S2-2", 2, "US", "other", "other", "", 1, "M", "", "", ""),
    )
    c = spark.createDataFrame([("S1-1", 2, "S2-1", 5.0, 3.0, 1.0), ("S1-1", 2, "S2-2", 1.0, 0.0, 0.0)], "s1 string, src int, t string, s_name double, s_addr double, s_cross double")
    f = features.featurize(c, r)
    got = {x["t"]: x.asDict() for x in f.collect()}
    a, b = got["S2-1"], got["S2-2"]
    assert a["n_alt_tset"] == 100 and b["n_alt_tset"] == -1 and (a["b_script"], b["b_script"], b["b_is_dom"], a["b_has_alt"]) == (0, 2, 1, 1)
    assert a["n_ratio"] == pytest.approx(200 * 9 / 19) and a["b_phone_tok"] == 1 and a["state_agree"] == 1 and b["state_agree"] == -1  # the phone is left out
    assert b["a_empty_b"] == 1 and b["a_ratio"] == -1 and a["num_jacc"] == 1 and b["num_jacc"] == -1
    assert a["s_total"] == 9 and a["quick"] == pytest.approx((a["n_tset"] + a["a_ptset"]) / 2) and b["quick"] == pytest.approx(b["n_tset"] / 2)
    assert (a["c_quick_rank_all"], b["c_quick_rank_all"], a["c_n_cands"]) == (0, 1, 2) and a["c_s_total_margin"] == 8 and b["c_s_total_gap"] == 8
    assert (a["t_core_freq"], a["s1core_t_freq"], a["s1_core_freq"]) == (1, 0, 1)
    assert len(features.feature_columns(f)) == 3 + 18 + 26 + 3 + 20  # scores, strings and flags, tokens, rarity, context with s_total and quick
    assert features.featurize(c.limit(0), r).count() == 0


def test_two_stage_model(spark, tmp_path):
    """Learned on some queries it finds the matches of others; saved and loaded it says the same."""
    rows = []
    for q in range(60):
        for k in range(5):
            good = float(k == q % 5)
            rows.append((f"S1-{q}", 2 + k % 2, f"t{q}-{k}", 2.0 * good + (q * 31 + k * 17) % 11 / 4, (q * 5 + k) % 7 * 1.0, good))
    df = spark.createDataFrame(rows, "s1 string, src int, t string, x double, y double, label double")
    train, test = (df.where(F.pmod(F.xxhash64("s1"), F.lit(4)) != 0), df.where(F.pmod(F.xxhash64("s1"), F.lit(4)) == 0))
    model = learn.fit_two_stage(train, ["x", "y"], "logreg", trees=5, depth=3, least=2)
    judged = model.predict(test)
    top = judged.withColumn("best", F.expr("p1 = max(p1) over (partition by s1)")).cache()
    assert top.where("best").agg(F.avg("label")).first()[0] > 0.6
    model.save(str(tmp_path / "m"))
    again = learn.TwoStage.load(str(tmp_path / "m"))
    say = lambda d: {(r["s1"], r["t"]): round(r["p"], 9) for r in d.select("s1", "t", "p").collect()}
    assert again.columns == ["x", "y"] and say(again.predict(test)) == say(judged)


def test_filter_and_candidates(spark):
    pool, true = blocking.retrieve(catalogue.parties_normalized(spark, SF)).cache(), catalogue.parties_truth(spark, SF)
    model = learn.fit_filter(pool, true, "gbt", trees=3, depth=3, least=2)
    kept = learn.build_candidates(pool, model, least=0.02)
    assert {"q", "t_n_s1", "t_s_total_rank"} <= set(kept.columns) and kept.agg(F.min("q")).first()[0] >= 0.02
    sweep = {r["threshold"]: r for r in learn.filter_sweep(pool, model, true, [0.0, 0.02]).collect()}
    assert sweep[0.02]["pairs"] == kept.count() and sweep[0.0]["pairs"] == pool.count() and sweep[0.0]["recall"] >= sweep[0.02]["recall"]
    cut = learn.build_candidates(pool, depths=(2, 0, 0))
    assert cut.count() == pool.where("rank < 2 and s_tot > 0").count()


def test_enrichment(spark):
    r = records(
        spark,
        *[(f"S1-{k}", 1, "India", "balaji store", "balaji store", "", 0, "L", "1 road , kerala", "1", "kl") for k in range(5)],
        *[(f"S2-{k}", 2, "India", "बालाजी दुकान", "बालाजी दुकान", "", 0, "I", "1 मार्ग , केरल", "1", "") for k in range(5)],
        ("S3-9", 3, "India", "राम बालाजी x", "राम बालाजी x", "", 0, "M", "कमल , केरल", "", ""),
        ("S3-8", 3, "India", "plain", "plain", "", 0, "L", "", "", ""),
    )
    true = spark.createDataFrame([(f"S1-{k}", f"S2-{k}") for k in range(5)], "s1 string, tgt string")
    tokens, states = enrich.learn_tokens(true, r), enrich.learn_states(true, r)
    assert {(x["token"], x["latin"], x["n"]) for x in tokens.collect()} == {("बालाजी", "balaji", 5), ("दुकान", "store", 5)}
    assert {(x["component"], x["state"], x["n"]) for x in states.collect()} == {("1 मार्ग", "kl", 5), ("केरल", "kl", 5)}
    got = {x["id"]: x.asDict() for x in enrich.enrich(r, tokens, states.where("component = 'केरल'")).collect()}
    assert len(got) == 12 and got["S3-8"]["name"] == "plain"
    assert (got["S2-1"]["name"], got["S2-1"]["core"], got["S2-1"]["addr"], got["S2-1"]["state"]) == ("balaji store", "balaji store", "1 marg , kl", "kl")
    assert (got["S3-9"]["name"], got["S3-9"]["addr"], got["S3-9"]["state"], got["S1-0"]["state"]) == ("ram balaji x", "kamal , kl", "kl", "kl")


def test_validation(spark, tmp_path):
    lists = spark.createDataFrame([("S1-1", "S2-1,S2-1"), ("S1-2", "S1-9,Q4,,S2-8"), ("S1-2", ""), ("S1-7", "")], "s1 string, l string")
    ents, targets = spark.createDataFrame([("S1-1",), ("S1-2",), ("S1-3",)], "s1 string"), spark.createDataFrame([("S2-1",)], "tgt string")
    cands = spark.createDataFrame([("S1-1", "S2-1")], "s1 string, tgt string")
    got = {r["finding"]: (r["severity"], r["n"], r["examples"]) for r in validate.validate_lists(lists, "l", ents, targets, cands).collect()}
    assert got == {
        "duplicate_row": ("error", 1, "S1-2"), "duplicate_id": ("error", 1, "S2-1"), "empty_id": ("error", 1, "S1-2"), "self_match": ("error", 1, "S1-9"), "wrong_prefix": ("error", 1, "Q4"),
        "unknown_id": ("error", 3, "Q4,S1-9,S2-8"), "missing_s1": ("error", 1, "S1-3"), "extra_s1": ("error", 1, "S1-7"), "not_candidate": ("warn", 3, "Q4,S1-9,S2-8"),
    }

    def write(name, text):
        (tmp_path / name).write_text(text)
        return str(tmp_path / name)

    good_m = write("m.tsv", "source1_entity_id\tmatched_entity_ids\nS1-1\tS2-1\nS1-2\t\nS1-3\t\n")
    good_c = write("c.tsv", "Source1_Entity_ID\tcandidate_entity_ids\nS1-1\tS2-1\nS1-2\tS2-1\nS1-3\t\n")
    assert validate.verdict(validate.validate_files(spark, good_m, good_c, ents, targets))
    swapped = write("s.tsv", "source1_entity_id\tcandidate_entity_ids\nS1-1\t\nS1-3\t\nS1-2\tS2-1\nno tab\n")
    found = {(r["file"], r["finding"]): (r["n"], r["examples"]) for r in validate.validate_files(spark, good_m, swapped, ents, targets).where("n > 0").collect()}
    assert found == {("candidates", "malformed_row"): (1, "5:no tab"), ("both", "out_of_step"): (2, "S1-2,S1-3"), ("both", "not_candidate"): (1, "S2-1")}
    comma = write("x.csv", "source1_entity_id,matched_entity_ids\n")
    found = {(r["file"], r["finding"]): r["n"] for r in validate.validate_files(spark, comma, good_c, ents, targets).where("n > 0").collect()}
    assert found["matches", "bad_header"] == 1 and found["matches", "missing_s1"] == 3


def test_pool_on_disk(spark, tmp_path):
    r = catalogue.parties_normalized(spark, SF).cache()
    path = tables.pool_path(str(tmp_path), "test", (30, 15, 15))
    assert path.endswith("pool_test_30_15_15")
    with pytest.raises(FileNotFoundError):
        tables.read_pool(spark, path)
    assert tables.write_pool(spark, r, path) == sorted({x["country"] for x in r.select("country").collect()})
    key = lambda d: sorted((x["s1"], x["src"], x["t"], x["country"]) for x in d.collect())
    assert key(tables.read_pool(spark, path)) == key(blocking.retrieve(r))
    assert tables.write_pool(spark, r, path) == []


def test_files_of_records(spark, tmp_path):
    raw = tmp_path / "test_source2.tsv"
    raw.write_text('entity_id\tbusiness_name\tbusiness_address\tcountry\nS2-1\tAcme "Q" Private Limited\t007 Main St., Austin, Texas\tUS\nS2-2\tसाईं\t\tIndia\n')
    tables.preprocess(spark, tables.raw_path(str(tmp_path), "test", 2), tables.cache_path(str(tmp_path), "test", 2))
    got = {r["id"]: r for r in tables.load_records(spark, tables.cache_path(str(tmp_path), "test", 2), 2).collect()}
    assert (got["S2-1"]["name"], got["S2-1"]["core"], got["S2-1"]["addr"], got["S2-1"]["nums"], got["S2-1"]["state"]) == ("acme q pvt ltd", "acme q", "7 main street , austin , tx", "7", "tx")
    own = tables.load_records(spark, tables.cache_path(str(tmp_path), "test", 2), 2, country="India")
    assert [r["id"] for r in own.collect()] == ["S2-2"] and tables.of_script(own, True).count() == 0 and tables.of_script(own, False).count() == 1
    assert tables.load_records(spark, tables.cache_path(str(tmp_path), "test", 2), 2, ids=spark.createDataFrame([("S2-1",)], "id string")).count() == 1
    lists = spark.createDataFrame([(f"S1-{k:03}", "S2-1" if k % 2 else "") for k in range(300)], "s1 string, m string").repartition(7)
    tables.write_id_lists(lists, str(tmp_path / "out"), F.col("s1"))
    (part,) = (tmp_path / "out").glob("*.csv")
    assert part.read_text() == "s1\tm\n" + "".join(f"S1-{k:03}\t{'S2-1' if k % 2 else ''}\n" for k in range(300))


def test_config(spark, tmp_path):
    (tmp_path / "c.json").write_text('{"df_cap": 50, "pool_depths": [1, 2, 3], "other": 4, "cache_dir": "%s/k"}' % tmp_path)
    c = tables.Config.load(spark, str(tmp_path / "c.json"))
    assert (c.df_cap, c.pool_depths, c.extra, c.seed) == (50, (1, 2, 3), {"other": 4}, 42) and c.path("a").endswith("/k/a") and c.to_dict()["df_cap"] == 50
    c.model_dir = c.output_dir = str(tmp_path / "o")
    c.make_folders(spark)
    assert (tmp_path / "k").is_dir() and (tmp_path / "o").is_dir()


def test_reports(spark):
    pair = lambda *rows: spark.createDataFrame(rows, "s1 string, tgt string")
    pred, true, cand = pair(("a", "x"), ("b", "y")), pair(("a", "x"), ("a", "z"), ("c", "w")), pair(("a", "x"), ("b", "y"), ("c", "w"))
    got = {tuple(r) for r in report.errors(pred, true, cand).collect()}
    assert got == {("b", "y", "fp"), ("a", "z", "fn_blocking"), ("c", "w", "fn_rejected")}
    r = spark.createDataFrame([(i, f"name {i}", "addr", "US") for i in "abcwxyz"], "id string, name string, addr string, country string")
    shown = report.error_samples(pred, true, cand, r, 5).collect()
    assert {(x["kind"], x["name_a"], x["name_b"]) for x in shown} == {("fp", "name b", "name y"), ("fn_blocking", "name a", "name z"), ("fn_rejected", "name c", "name w")}
    p = report.truth_profile(true.union(pair(("b", "x"))), spark.createDataFrame([(x,) for x in "abcd"], "s1 string")).first()
    assert tuple(p) == (4, 4, 1, 0.25, 2, 1)
    assert tables.sample_entities(pair(*[(f"s{i}", "") for i in range(20)]), 5, 1, without=pair(("s3", ""))).count() == 5
