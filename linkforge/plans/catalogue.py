"""Registered queries over the proxy tables: documents by doc_id % 3 are sources 1 to 3, lang is the country."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from linkforge.functions import keys, text
from linkforge.operators import blocking, decide, enrich, evaluate, features, learn, report, validate, whole_texts, windows
from linkforge.plans import oracle
from linkforge.sources import tables

#: Document-frequency cap and depths of the retrieval, and of the fixed cut: the operators' defaults.
CAP, DEPTHS, CUT = oracle.CAP, oracle.POOL_DEPTHS, oracle.CUT


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def squeeze(c):
    return F.trim(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", " "))


def first_line(body):
    return F.split(body, "\n", 2)[0]


def rest(body):
    """All after the first line."""
    return F.coalesce(F.get(F.split(body, "\n", 2), F.lit(1)), F.lit(""))


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, src, country, name, core, addr, state, doc_id, body): the name is the whole first line of a document, the address the rest."""
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", F.coalesce("text", F.lit("")).alias("text"))
    src = (F.col("doc_id") % 3 + 1).cast("int")
    out = d.select(
        F.concat(F.lit("S"), src.cast("string"), F.lit("-"), F.col("doc_id").cast("string")).alias("id"),
        src.alias("src"),
        F.coalesce("lang", F.lit("")).alias("country"),
        squeeze(first_line(F.col("text"))).alias("name"),
        squeeze(rest(F.col("text"))).alias("addr"),
        F.col("doc_id"),
        F.col("text").alias("body"),
    )
    return out.select("id", "src", "country", "name", text.core_of(F.col("name")).alias("core"), "addr", F.lit("").alias("state"), "doc_id", "body")


def parties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw business records, short and whole: (entity_id, src, business_name, business_address, country, kind), made of the columns of part.

    ``kind`` names what a record and its matches share.
    """
    p = table(spark, sf_dir, "part").select("*", (F.col("p_partkey") % 3 + 1).cast("int").alias("src"))
    nth = lambda values, n: F.element_at(F.array(*map(F.lit, values)), (n % len(values) + 1).cast("int"))
    size, country = F.col("p_size").cast("string"), nth(oracle.COUNTRIES, F.col("p_size"))
    name = F.concat(F.upper("p_name"), F.lit(" "), F.replace("p_brand", F.lit("Brand#"), F.lit("B")), nth(oracle.FORMS, F.col("p_partkey")))
    addr = F.concat(F.lit("0"), (F.col("p_size") * 37).cast("string"), F.lit("-"), size, F.lit(" "), F.upper("p_type"), nth(oracle.STREETS, F.col("p_partkey")), size, F.lit(", "), nth(oracle.STATES, F.col("p_size")))
    addr = F.when((F.col("src") != 1) & (F.col("p_partkey") % 29 == 0), "").otherwise(addr)
    return p.select(
        F.concat(F.lit("S"), F.col("src").cast("string"), F.lit("-"), F.col("p_partkey").cast("string")).alias("entity_id"), "src", name.alias("business_name"), addr.alias("business_address"),
        country.alias("country"), F.concat_ws("|", "p_name", (F.col("p_size") % 21).cast("string")).alias("kind"),
    )


def parties_normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The records of ``parties`` in the engine's columns."""
    raw = parties(spark, sf_dir)
    n = tables.normalized(raw)
    own = n.join(raw.select("entity_id", "src", "kind"), "entity_id")
    return own.select(
        F.col("entity_id").alias("id"), "src", "country", F.col("name_norm").alias("name"), F.col("name_core").alias("core"), F.col("name_alt").alias("alt"), "is_dom", "script",
        F.col("addr_norm").alias("addr"), F.col("addr_nums").alias("nums"), "state", "kind",
    )


def parties_truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(s1, src, tgt): each target and the least query of its kind and country."""
    r = parties(spark, sf_dir)
    first = r.where("src = 1").groupBy("country", "kind").agg(F.min("entity_id").alias("s1"))
    return r.where("src <> 1").join(first, ["country", "kind"]).select("s1", "src", F.col("entity_id").alias("tgt"))


def parties_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fixed cut of the pool of ``parties``, with the competition of a target's queries."""
    return learn.build_candidates(blocking.retrieve(parties_normalized(spark, sf_dir), CAP, *DEPTHS), depths=CUT)


def pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocking.retrieve(records(spark, sf_dir), CAP, *DEPTHS)


def all_scores(spark, sf_dir, depth: int = 2**31 - 1):
    """All pairs that share a key, ranked by their total; with ``depth`` the first of each query and source."""
    return blocking.retrieve(records(spark, sf_dir), CAP, depth, 0, 0)


def truth(spark, sf_dir):
    """(s1, src, tgt): each target and the least query of one country with its whole text; empty texts match nothing.

    As in the reference's data a target has one query at most, so copies do not make pairs by the square of their number.
    Texts are compared by their SHA-256, so that no text is shuffled.
    """
    r = records(spark, sf_dir).where("body <> ''").select("id", "src", "country", F.unhex(F.sha2(F.col("body").cast("binary"), 256)).alias("body"))
    first = r.where("src = 1").groupBy("country", "body").agg(F.min("id").alias("s1"))
    return r.where("src <> 1").join(first, ["country", "body"]).select("s1", "src", F.col("id").alias("tgt"))


def entities(spark, sf_dir):
    return records(spark, sf_dir).where("src = 1").select(F.col("id").alias("s1"), "country")


def scored(spark, sf_dir, own: DataFrame | None = None):
    return (own or pool(spark, sf_dir)).select("s1", "src", "t", F.round(F.col("s_tot") / (F.col("s_tot") + 60), 6).alias("p"))


def chosen(spark, sf_dir, own: DataFrame | None = None):
    return decide.select_expected_f(scored(spark, sf_dir, own)).select("s1", F.col("t").alias("tgt"))


def pair_cores(spark, sf_dir):
    return features.beside(pool(spark, sf_dir).select("country", "src", "s1", "t"), records(spark, sf_dir).select("id", "country", "src", "core"))


def kept_pool(spark, sf_dir):
    """The pool for a query that reads it more than once: pairs are summed once."""
    return pool(spark, sf_dir).select("s1", "src", "t", "s_tot").persist()


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decide.select_expected_f(scored(spark, sf_dir))


# ------------------------------------------------------------------ queries


def scan_normalized(spark, sf_dir):
    return records(spark, sf_dir).select("id", "src", "country", "name", "core", "addr")


def _wide(spark, sf_dir):
    t = truth(spark, sf_dir).groupBy("s1").agg(F.array_join(F.array_sort(F.collect_list("tgt")), ",").alias("list"))
    return entities(spark, sf_dir).join(t, "s1", "left").select(F.col("s1").alias("source1_entity_id"), F.coalesce("list", F.lit("")).alias("matched_entity_ids"))


def truth_explode(spark, sf_dir):
    return tables.explode_truth(_wide(spark, sf_dir))[0]


def split_entities(spark, sf_dir):
    return records(spark, sf_dir).where("src = 1").select("id", F.when(F.col("doc_id") % 10 < 2, "valid").otherwise("train").alias("part"))


def profile_tables(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.groupBy((F.col("doc_id") % 3 + 1).cast("int").alias("src")).agg(
        F.count("*").alias("n"), F.sum(F.col("text").isNull().cast("int")).alias("nulls"), F.countDistinct("doc_id").alias("ids"), (F.count("*") - F.countDistinct("text", "lang")).alias("repeats"),
        F.round(F.percentile(F.length("text"), F.lit(0.5)), 3).alias("p50"), F.round(F.percentile(F.length("text"), F.lit(0.99)), 3).alias("p99"),
    )


def country_counts(spark, sf_dir):
    return records(spark, sf_dir).groupBy("src", "country").agg(F.count("*").alias("n"))


def script_mix(spark, sf_dir):
    return records(spark, sf_dir).groupBy(text.script_of(F.col("name")).alias("script")).agg(F.count("*").alias("n"))


def name_tokens(spark, sf_dir):
    return records(spark, sf_dir).select("id", F.array_join(keys.name_tokens(F.col("core")), " ").alias("tokens"))


def addr_tokens(spark, sf_dir):
    return records(spark, sf_dir).select("id", F.array_join(keys.addr_tokens(F.col("addr"), F.col("state")), " ").alias("tokens"))


def legal_canonical(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lower("p_name"), F.element_at(F.array(*map(F.lit, oracle.SUFFIXES)), (F.col("p_partkey") % len(oracle.SUFFIXES) + 1).cast("int"))).alias("raw"))
    return p.select("p_partkey", text.canon_legal(text.squeeze(F.col("raw"))).alias("legal"), text.core_of(text.canon_legal(text.squeeze(F.col("raw")))).alias("core"))


def name_normalized(spark, sf_dir):
    """Names of documents and of parties, whole."""
    folded = records(spark, sf_dir).select("id", text.fold(first_line(F.col("body"))).alias("f"))
    both = folded.unionByName(parties(spark, sf_dir).select(F.concat(F.lit("P"), "entity_id").alias("id"), text.fold("business_name").alias("f")))
    return both.select("id", *[c.alias(n) for n, c in text.name_parts(F.col("f")).items()])


def party_names(spark, sf_dir):
    return parties_normalized(spark, sf_dir).select("id", "name", "core", "alt", "is_dom", "script")


def party_addresses(spark, sf_dir):
    return parties_normalized(spark, sf_dir).select("id", "addr", "nums", "state")


def address_normalized(spark, sf_dir):
    folded = records(spark, sf_dir).select("id", "country", text.fold(rest(F.col("body"))).alias("f"))
    return folded.select("id", *[c.alias(n) for n, c in text.address_parts(F.col("f"), F.col("country")).items()])


def rule_translit(spark, sf_dir):
    """Names of parties written in native letters, then by rule in Latin ones."""
    return parties(spark, sf_dir).select(F.col("entity_id").alias("id"), text.rule_translit(F.translate(F.lower("business_name"), oracle.LATIN, oracle.NATIVE)).alias("latin"))


def has_native_letters(spark, sf_dir):
    native = F.when(F.col("src") == 2, F.translate(F.lower("business_name"), oracle.LATIN, oracle.NATIVE)).otherwise(F.col("business_name"))
    return parties(spark, sf_dir).select(F.col("entity_id").alias("id"), text.has_indic(native).alias("native"), text.strip_phone(F.concat(F.col("business_address"), F.lit(" 5551234567"))).alias("stripped"), text.flat_addr(F.regexp_replace("business_address", ",", " ,")).alias("flat"))


def phonetic_skeleton(spark, sf_dir):
    w = records(spark, sf_dir).select(F.explode(text.words(F.regexp_replace("core", "[^a-z ]", ""))).alias("word")).distinct()
    return w.select("word", text.phonetic(F.col("word")).alias("skeleton"))


def url_domain_root(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", text.domain_root(F.regexp_extract("url", "^([a-z]+://[^/?#]*)", 1)).alias("root"))


def _keys(family):
    return lambda spark, sf_dir: blocking.postings(records(spark, sf_dir)).where(F.col("fam") == family).select("id", "key")


def key_df_idf(spark, sf_dir):
    r = records(spark, sf_dir).where("src <> 1")
    return blocking.key_stats(blocking.postings(r), r, CAP).withColumn("idf", F.round("idf", 6))


def blocking_scores(spark, sf_dir):
    """All pairs by the keys of whole texts; the queries on the pool take those of the first tokens."""
    return whole_texts.pair_scores(records(spark, sf_dir), CAP).select("src", "s1", "t", "s_name", "s_addr", "s_cross", "s_tot")


def retrieve_topk_total(spark, sf_dir):
    return all_scores(spark, sf_dir, DEPTHS[0]).select("src", "s1", "t", "s_tot", "rank")


def retrieve_union3(spark, sf_dir):
    return pool(spark, sf_dir).select("src", "s1", "t", "s_tot", "rank", "rank_name", "rank_addr")


def fixed_cut(spark, sf_dir):
    return blocking.cut(pool(spark, sf_dir), *CUT).select("src", "s1", "t")


def filter_features(spark, sf_dir):
    return windows.filter_features(pool(spark, sf_dir)).select("src", "s1", "t", "g_tot", "g_name", "g_addr", "m_tot", "n_pool", "t_n", "t_margin", "t_rank")


def target_competition(spark, sf_dir):
    return windows.target_side(pool(spark, sf_dir)).select("src", "s1", "t", "t_n_s1", "t_s_total_margin", "t_s_total_rank")


def s1_competition(spark, sf_dir):
    return windows.query_side(pool(spark, sf_dir), ["s_tot"]).select("src", "s1", "t", "c_n_cands", "c_s_tot_gap", "c_s_tot_margin", "c_s_tot_rank")


def p_context(spark, sf_dir):
    return windows.p_context(scored(spark, sf_dir).withColumnRenamed("p", "p1"))


def core_frequency(spark, sf_dir):
    return features.pair_core_frequency(pool(spark, sf_dir), records(spark, sf_dir)).select("src", "s1", "t", "t_core_freq", "s1core_t_freq", "s1_core_freq")


def token_features(spark, sf_dir):
    p = pair_cores(spark, sf_dir)
    got = features.token_features(text.words(F.col("core_a")), text.words(F.col("core_b")))
    return p.select("src", "s1", "t", *[F.round(c, 6).alias(n) for n, c in got.items() if n != "n_phon_jacc"])


def number_features(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_set(F.col("l_partkey").cast("string"))).alias("a"), F.array_sort(F.collect_set(F.col("l_suppkey").cast("string"))).alias("b"))
    return l.select("l_orderkey", *[F.round(c, 6).alias(n) for n, c in features.number_features(F.col("a"), F.col("b")).items()])


def pair_flags(spark, sf_dir):
    """Flags of a pair; what they need of a record is taken before the pairs are joined, so that no name or address moves with a pair."""
    r = records(spark, sf_dir).select("id", features.legal_forms(F.col("name")).alias("forms"), F.substring("addr", 1, 2).alias("state"), features.phone_token(F.col("name")).alias("phone"))
    side = lambda k, on, *own: r.select(F.col("id").alias(on), *[F.col(c).alias(f"{c}_{k}") for c in own])
    p = pool(spark, sf_dir).select("s1", "src", "t").join(side("a", "s1", "forms", "state"), "s1").join(side("b", "t", "forms", "state", "phone"), "t")
    legal = features.legal_flags(F.col("forms_a"), F.col("forms_b"))
    return p.select("src", "s1", "t", *[c.alias(n) for n, c in legal.items()], features.agree(F.col("state_a"), F.col("state_b")).alias("state_agree"), F.col("phone_b").alias("b_phone_tok"), (F.col("state_b") == "").cast("double").alias("a_empty_b"))


def featurize(spark, sf_dir):
    """All features of the candidates of parties."""
    return features.featurize(parties_candidates(spark, sf_dir), parties_normalized(spark, sf_dir))


def pair_token_features(spark, sf_dir):
    """The features of ``featurize`` that SQL can express, for the same pairs."""
    p = features.core_frequency(features.with_records(parties_candidates(spark, sf_dir), parties_normalized(spark, sf_dir)), parties_normalized(spark, sf_dir))
    f = features.pair_features(p)
    return f.select("s1", "src", "t", *[F.round(c, 6).alias(c) for c in oracle.PAIR_FEATURES], *[F.col(c).cast("long").alias(c) for c in ("t_core_freq", "s1core_t_freq", "s1_core_freq")])


def candidate_context(spark, sf_dir):
    """The competition of a query's candidates in all values of ``featurize``, here of the scores of the pool."""
    c = parties_candidates(spark, sf_dir).withColumns({"n_tset": F.floor("s_name").cast("double"), "a_ptset": F.floor("s_addr").cast("double") - 20, "n_ratio": F.col("s_cross")})
    out = windows.query_context(c)
    return out.select("s1", "src", "t", F.round("quick", 6).alias("quick"), "c_n_cands", *[f"c_{v}_{k}" for v in windows.CONTEXT for k in ("gap", "margin", "rank")], "c_quick_gap_all", "c_quick_rank_all")


def string_similarity(spark, sf_dir):
    """The string measures of the candidates of parties."""
    from linkforge.functions.similarity import NAMES

    return features.pair_features(features.with_records(parties_candidates(spark, sf_dir), parties_normalized(spark, sf_dir))).select("s1", "src", "t", *NAMES)


def jaro_winkler(spark, sf_dir):
    return string_similarity(spark, sf_dir).select("s1", "src", "t", F.round("n_jw", 6).alias("jw"))


def label_pairs(spark, sf_dir):
    return features.label_pairs(parties_candidates(spark, sf_dir), parties_truth(spark, sf_dir)).select("s1", "src", "t", "label")


def _split(df, valid: bool):
    own = F.pmod(F.crc32(F.col("s1").cast("binary")), F.lit(10)) < 3
    return df.where(own if valid else ~own)


def two_stage(spark, sf_dir):
    """Two stages learned from seven tenths of the queries, and the p of the others' candidates."""
    pairs = features.label_pairs(featurize(spark, sf_dir), parties_truth(spark, sf_dir)).persist()  # read for each fit
    model = learn.fit_two_stage(_split(pairs, False), features.feature_columns(pairs), "gbt", trees=5, depth=3, least=5)
    return model.predict(_split(pairs, True)).select("s1", "src", "t", "label", F.round("p", 6).alias("p"))


def blocking_filter(spark, sf_dir):
    """The learned filter at three thresholds, on the queries that it has not seen."""
    own, true = blocking.retrieve(parties_normalized(spark, sf_dir), CAP, *DEPTHS).persist(), parties_truth(spark, sf_dir)
    model = learn.fit_filter(_split(own, False), true, "gbt", trees=10, depth=4, least=5)
    return learn.filter_sweep(_split(own, True), model, _split(true, True), [0.002, 0.02, 0.2])


def model_comparison(spark, sf_dir):
    pairs = features.label_pairs(parties_candidates(spark, sf_dir), parties_truth(spark, sf_dir)).persist()
    columns = ["s_name", "s_addr", "s_cross", "s_tot", "g_tot", "m_tot", "t_n_s1"]
    return learn.compare_models(_split(pairs, False), _split(pairs, True), columns, ["logreg", "gbt"], trees=10, depth=4, least=5)


def _native(spark, sf_dir):
    """Parties whose targets of every second key have names, and states, in native letters."""
    r = parties_normalized(spark, sf_dir)
    own = (F.col("src") != 1) & (F.pmod(F.crc32(F.col("id").cast("binary")), F.lit(2)) == 0)
    say = lambda c: F.translate(c, oracle.LATIN, oracle.NATIVE)
    parts = F.split("addr", " , ", -1)
    last = F.element_at(parts, -1)
    addr = F.concat_ws(" , ", F.slice(parts, 1, F.size(parts) - 1), F.array(say(last)))
    return r.withColumns({"name": F.when(own, say(F.col("name"))).otherwise(F.col("name")), "script": F.when(own, "I").otherwise(F.col("script")), "addr": F.when(own & (F.col("addr") != ""), addr).otherwise(F.col("addr")), "state": F.when(own, "").otherwise(F.col("state"))})


def translit_tokens(spark, sf_dir):
    return enrich.learn_tokens(parties_truth(spark, sf_dir), _native(spark, sf_dir))


def state_names(spark, sf_dir):
    return enrich.learn_states(parties_truth(spark, sf_dir), _native(spark, sf_dir))


def enriched(spark, sf_dir):
    """Native names and addresses in Latin letters, by the learned dictionaries first."""
    r, true = _native(spark, sf_dir), parties_truth(spark, sf_dir)
    return enrich.enrich(r, enrich.learn_tokens(true, r), enrich.learn_states(true, r)).select("id", "name", "core", "addr", "state")


def file_profile(spark, sf_dir):
    r = parties(spark, sf_dir).select(F.col("entity_id").alias("id"), F.col("business_name").alias("name"), F.col("business_address").alias("addr"), "country")
    return report.file_profile(r, "S1-")


def truth_profile(spark, sf_dir):
    return report.truth_profile(truth(spark, sf_dir), entities(spark, sf_dir))


def decision_errors(spark, sf_dir):
    own = kept_pool(spark, sf_dir)
    return report.errors(chosen(spark, sf_dir, own), truth(spark, sf_dir), own.select("s1", F.col("t").alias("tgt")))


def error_samples(spark, sf_dir):
    """A report of at most 20 errors of each kind."""
    own = kept_pool(spark, sf_dir)
    return report.error_samples(chosen(spark, sf_dir, own), truth(spark, sf_dir), own.select("s1", F.col("t").alias("tgt")), records(spark, sf_dir), 20)


def one_to_one(spark, sf_dir):
    return decide.one_to_one(scored(spark, sf_dir))


def select_threshold(spark, sf_dir):
    return decide.select_threshold(scored(spark, sf_dir), 0.5)


def select_expected_f(spark, sf_dir):
    return decide.select_expected_f(scored(spark, sf_dir))


def macro_fbeta(spark, sf_dir):
    e = evaluate.per_entity(chosen(spark, sf_dir), truth(spark, sf_dir), entities(spark, sf_dir))
    return evaluate.summary(e, [])


def macro_fbeta_by_country(spark, sf_dir):
    """Each country, and all together (null), in one pass."""
    e = evaluate.per_entity(chosen(spark, sf_dir), truth(spark, sf_dir), entities(spark, sf_dir))
    return evaluate.summary(e, ["country"], total=True)


def f_by_truth_size(spark, sf_dir):
    e = evaluate.per_entity(chosen(spark, sf_dir), truth(spark, sf_dir), entities(spark, sf_dir))
    return e.groupBy(F.least("n_true", F.lit(8)).alias("size")).agg(F.round(F.avg("f"), 6).alias("f"), F.count("*").alias("n"))


def candidate_stats(spark, sf_dir):
    return evaluate.candidate_stats(pool(spark, sf_dir).select("s1", F.col("t").alias("tgt")), truth(spark, sf_dir).select("s1", "tgt"), entities(spark, sf_dir).select("s1"))


SWEEP = oracle.SWEEP


def rule_sweep(spark, sf_dir):
    """All 42 rules, each with macro F and the counts of ``summary``; best marks the first of the greatest macro F.

    What is counted of a query is one row for all rules of a kind, so that no pair is repeated for a rule.
    """
    true = truth(spark, sf_dir).select("s1", F.col("tgt").alias("t")).distinct()
    s = scored(spark, sf_dir).join(true.withColumn("hit", F.lit(1)), ["s1", "t"], "left").select("s1", "src", "t", "p", F.coalesce("hit", F.lit(0)).alias("hit")).persist()  # read for each kind of rule
    of = {True: decide.one_to_one(s).persist(), False: s}
    counted = lambda k, own: F.struct(F.lit(k).alias("k"), F.sum(own.cast("int")).alias("n_pred"), F.sum(F.when(own, F.col("hit")).otherwise(0)).alias("tp"))
    out = entities(spark, sf_dir).select("s1").join(true.groupBy("s1").agg(F.count("*").alias("n_true")), "s1", "left")
    for unique in (True, False):
        rules = [counted(k, F.col("p") >= r[2]) for k, r in enumerate(SWEEP) if r[0] == "threshold" and r[1] == unique]
        out = out.join(of[unique].groupBy("s1").agg(F.array(*rules).alias(f"of_{unique}")), "s1", "left")
    for k, (kind, unique, _, miss, floor) in enumerate(SWEEP):
        if kind == "expected_f":
            kept = decide.select_expected_f(of[unique], False, miss=miss, floor=floor)
            out = out.join(kept.groupBy("s1").agg(F.array(counted(k, F.lit(True))).alias(f"of_{k}")), "s1", "left")
    none = F.array().cast("array<struct<k:int,n_pred:bigint,tp:bigint>>")
    found = F.concat(*[F.coalesce(F.col(c).cast("array<struct<k:int,n_pred:bigint,tp:bigint>>"), none) for c in out.columns if c.startswith("of_")])
    of_rule = lambda k: F.coalesce(F.get(F.filter("found", lambda x: x["k"] == k), F.lit(0)), F.struct(k.cast("int").alias("k"), F.lit(0).cast("long").alias("n_pred"), F.lit(0).cast("long").alias("tp")))
    each = out.select(F.coalesce("n_true", F.lit(0)).alias("n_true"), found.alias("found")).select("n_true", F.explode(F.transform(F.sequence(F.lit(0), F.lit(len(SWEEP) - 1)), of_rule)).alias("r")).select("n_true", "r.*")
    judged = evaluate.summary(evaluate.with_f(each), ["k"])
    rules = F.broadcast(spark.createDataFrame([(k, *r) for k, r in enumerate(SWEEP)], "k int, kind string, one_to_one boolean, threshold double, miss double, floor double"))
    best = judged.agg(F.max_by("k", F.struct("macro_f", -F.col("k"))).alias("best"))
    return judged.join(rules, "k").crossJoin(F.broadcast(best)).withColumn("best", F.col("k") == F.col("best"))


def recall_at_k(spark, sf_dir):
    t = truth(spark, sf_dir).join(all_scores(spark, sf_dir, max(oracle.RECALL_DEPTHS)).select("s1", F.col("t").alias("tgt"), "rank"), ["s1", "tgt"], "left")
    return t.select(F.explode(F.array(*map(F.lit, oracle.RECALL_DEPTHS))).alias("k"), "rank").groupBy("k").agg(F.round(F.avg(F.coalesce((F.col("rank") < F.col("k")).cast("int"), F.lit(0))), 6).alias("recall"))


def error_budget(spark, sf_dir):
    own = kept_pool(spark, sf_dir)
    t = truth(spark, sf_dir).select("s1", "tgt").withColumn("in_true", F.lit(1))
    c = own.select("s1", F.col("t").alias("tgt")).withColumn("in_cand", F.lit(1))
    p = chosen(spark, sf_dir, own).withColumn("in_pred", F.lit(1))
    kind = F.when(F.col("in_true").isNotNull(), F.when(F.col("in_pred").isNotNull(), "tp").when(F.col("in_cand").isNotNull(), "fn_rejected").otherwise("fn_blocking")).when(F.col("in_pred").isNotNull(), "fp").otherwise("tn")
    return t.join(c, ["s1", "tgt"], "full").join(p, ["s1", "tgt"], "full").groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))


def translit_vote(spark, sf_dir):
    p = pair_cores(spark, sf_dir).select(text.words(F.col("core_a")).alias("a"), text.words(F.col("core_b")).alias("b"))
    return learn.vote(learn.aligned_tokens(p, "a", "b").where("a <> b"), "b", "a", 2, 0.5)


def state_vote(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_type", F.col("user_id").cast("string").alias("who"))
    return learn.vote(e, "who", "event_type", 2, 0.25)


def id_lists(spark, sf_dir, own: DataFrame | None = None):
    return tables.id_lists(chosen(spark, sf_dir, own), entities(spark, sf_dir).select("s1"), "matched_entity_ids")


def _broken(spark, sf_dir, own: DataFrame):
    lists = id_lists(spark, sf_dir, own)
    k = F.substring(F.md5(F.col("s1").cast("binary")), 1, 1)
    return lists.where(k != "0").select("s1", F.when(k == "1", F.concat("matched_entity_ids", F.lit(",S2-x,S2-x,,S1-0"))).when(k == "2", F.lit("Q9")).otherwise(F.col("matched_entity_ids")).alias("matched_entity_ids"))


def validate_lists(spark, sf_dir):
    r, own = records(spark, sf_dir), kept_pool(spark, sf_dir)
    return validate.validate_lists(_broken(spark, sf_dir, own), "matched_entity_ids", entities(spark, sf_dir).select("s1"), r.where("src <> 1").select(F.col("id").alias("tgt")), own.select("s1", F.col("t").alias("tgt")))


def matches_not_candidates(spark, sf_dir):
    return validate.not_subset(truth(spark, sf_dir), pool(spark, sf_dir).select("s1", F.col("t").alias("tgt")))


def semi_join(spark, sf_dir):
    late = table(spark, sf_dir, "lineitem").where("l_quantity > 45")
    return table(spark, sf_dir, "orders").join(late, F.col("o_orderkey") == F.col("l_orderkey"), "left_semi").select("o_orderkey", "o_custkey")


def anti_join(spark, sf_dir):
    return table(spark, sf_dir, "customer").join(table(spark, sf_dir, "orders").where("o_totalprice > 250000"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


def set_difference(spark, sf_dir):
    a, b = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k")), table(spark, sf_dir, "customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("k"))
    return a.distinct().exceptAll(b)


def set_union(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("k")).union(table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"))).distinct()


def sample_rows(spark, sf_dir):
    """A seeded sample of n rows."""
    return records(spark, sf_dir).select("id", F.md5(F.concat(F.lit("7:"), "id").cast("binary")).alias("h")).orderBy("h", "id").limit(50).select("id")


def _model_rows(spark, sf_dir):
    t = F.coalesce("text", F.lit(""))
    cols = {"length": F.length(t), "lines": F.size(F.split(t, "\n")), "digits": F.length(F.regexp_replace(t, "[^0-9]", "")), "marks": F.length(F.regexp_replace(t, "[^*%$#&]", ""))}
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    return d.select("doc_id", F.col("quality").cast("double").alias("label"), *[F.log1p(c.cast("double")).alias(n) for n, c in cols.items()]), list(cols)


def fit_predict_logreg(spark, sf_dir):
    d, cols = _model_rows(spark, sf_dir)
    return learn.predict(learn.fit(d, cols, "logreg"), d, "p").select("doc_id", F.round("p", 6).alias("p"))


def fit_predict_gbt(spark, sf_dir):
    d, cols = _model_rows(spark, sf_dir)
    return learn.predict(learn.fit(d, cols, "gbt", trees=10, depth=5, least=5), d, "p").select("doc_id", F.round("p", 6).alias("p"))


def queries() -> dict:
    own = (
        scan_normalized, truth_explode, split_entities, profile_tables, country_counts, script_mix, name_tokens, addr_tokens, legal_canonical, name_normalized,
        address_normalized, party_names, party_addresses, rule_translit, has_native_letters, phonetic_skeleton, url_domain_root, key_df_idf, blocking_scores, retrieve_topk_total,
        retrieve_union3, fixed_cut, filter_features, target_competition, s1_competition, p_context, core_frequency, token_features, number_features, pair_flags, featurize,
        pair_token_features, candidate_context, string_similarity, jaro_winkler, label_pairs, two_stage, blocking_filter, model_comparison, translit_tokens, state_names, enriched,
        file_profile, truth_profile, decision_errors, error_samples, one_to_one, select_threshold, select_expected_f, macro_fbeta, macro_fbeta_by_country, f_by_truth_size,
        candidate_stats, rule_sweep, recall_at_k, error_budget, translit_vote, state_vote, id_lists, validate_lists, matches_not_candidates, semi_join, anti_join, set_difference,
        set_union, sample_rows, fit_predict_logreg, fit_predict_gbt,
    )
    return {f.__name__: f for f in own} | {f"blocking_keys_{k}": _keys(k) for k in blocking.FAMILIES}


def oracle_sql() -> dict[str, str]:
    return oracle.oracle_sql()
