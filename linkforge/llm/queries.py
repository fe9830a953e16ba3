"""The registered queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkforge.llm import line_dedup, ngram_join, packing, secret_scans, sentencepiece_codec, token_counts, topk_search, toxicity, url_filter, vptree
from linkforge.llm.common import table


def op1_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scans.secret_scan(table(spark, sf_dir, "documents"))


def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.url_filter(table(spark, sf_dir, "pages")).drop("trust", "distrust")


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_codec.digest(table(spark, sf_dir, "documents"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents")).withColumn("over_limit", F.col("n_tokens") > 512)


def toxicity_model(spark: SparkSession, sf_dir: str) -> toxicity.Model:
    labels = table(spark, sf_dir, "labels").where(~toxicity.held_out())
    return toxicity.fit(table(spark, sf_dir, "documents"), labels)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = toxicity.score(table(spark, sf_dir, "documents"), toxicity_model(spark, sf_dir))
    return scores.select("doc_id", toxicity.held_out().alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op6_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk_search.top_k(table(spark, sf_dir, "embeddings"))


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op8_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_components(table(spark, sf_dir, "documents"), width=3, num=90, den=100)


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    lines = F.size(F.split(F.coalesce("text", F.lit("")), "\n")).cast("long")
    cut = line_dedup.line_dedup(docs.withColumn("n_lines", lines), removed_col="removed", words_col="n_words_cut")
    return cut.select("doc_id", "n_lines", F.size("removed").cast("long").alias("n_removed"), "n_words_cut", F.array_join(F.col("removed").cast("array<string>"), ",").alias("removed"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


#: From a table of factors, recall and rows compared: see the README.
FACTOR = 3.3


def op10_vantage_point_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vptree.nearest(table(spark, sf_dir, "embeddings"), factor=FACTOR)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    own = (op1_secret_scans, op2_url_filters, op3_sentencepiece, op4_token_counts, op5_toxicity, op6_topk_search, op7_best_fit_packing, op8_ngram_jaccard_join, op9_line_dedup, op10_vantage_point_search, pipeline)
    return {f.__name__: f for f in own}


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _sql_secrets() -> str:
    s = secret_scans
    kinds = [(0, s.ASSIGN, 2, 8, None), (1, s.ACCESS, 0, 0, None), (2, s.HEX, 0, 0, None), (3, s.WEAK_ID, 0, 0, None), (4, s.WEAK_SECRET, 0, 0, 40), (5, s.ENDPOINT, 0, 0, None)]
    parts = []
    for kind, pattern, group, least, most in kinds:
        p = _quoted(pattern)
        parts.append(f"""
  select id, {kind} as kind, unnest(list_transform(range(1, len(m) + 1), lambda i: {{
      'start': list_sum([length(x) for x in p[1:i]]) + coalesce(list_sum([length(x) for x in m[1:i - 1]]), 0),
      'own': length(m[i]), 'value': length(v[i])}}), recursive := true), {least} as least, {most or 2**31 - 1} as most
  from (select id, regexp_extract_all(text, {p}) as m, regexp_extract_all(text, {p}, {group}) as v, string_split_regex(text, {p}) as p from docs where regexp_matches(text, {p}))""")
    names = "[" + ", ".join(map(_quoted, s.KINDS)) + "]"
    frame = "over (partition by id order by start, kind, until rows between {})"
    up, down = frame.format("unbounded preceding and 1 preceding"), frame.format("1 following and unbounded following")
    near = lambda test: f"coalesce(start - max(case when {test} then until end) {up} <= {s.SCOPE}, false) or coalesce(min(case when {test} then start end) {down} - until <= {s.SCOPE}, false)"
    return f"""
with docs as (select row_number() over () as id, doc_id, coalesce(text, '') as text from documents),
found as ({" union all ".join(parts)}),
parts as (select id, kind, start::bigint as start, (start + own)::bigint as until from found where value between least and most),
judged as (select *, {near('kind in (1, 3)')} as with_id, {near('kind in (0, 2, 4)')} as with_secret, {near('kind = 5')} as with_end from parts),
kept as (select id, kind, start, until, ({names})[kind + 1] || ':' || start || ':' || until as span from judged
  where kind < 3 or case when kind = 4 then with_id or with_end else with_secret end),
lists as (select id, count(*) filter (kind = 0) as a, count(*) filter (kind = 1) as b, count(*) filter (kind = 2) as c,
  coalesce(string_agg(span, ',' order by start, kind) filter (kind < 3), '') as base, string_agg(span, ',' order by start, kind, until) as spans from kept group by id)
select doc_id, coalesce(a, 0)::bigint as n_assign, coalesce(b, 0)::bigint as n_access, coalesce(c, 0)::bigint as n_hex,
  sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans
from docs left join lists using (id)"""


def _sql_urls(damping: float = 0.85, rounds: int = 8) -> str:
    rest = "substr({0}, instr({0}, '://') + 3)"
    upper = _quoted(url_filter.UPPER)
    host = f"case when instr({{0}}, '://') > 0 then translate(regexp_extract({rest}, '^([^/?#]*)', 1), {upper}, {_quoted(url_filter.LOWER)}) else '' end"
    rule = verdict = "null"
    for kind, text in sorted(url_filter.RULES, key=lambda r: len(r[1])):
        name, _, tail = text.partition("/")
        fits = f"(host = '{name}' or ends_with(host, '.{name}')) and starts_with(path, '/{tail}')"
        rule, verdict = f"case when {fits} then '{text}' else {rule} end", f"case when {fits} then '{kind}' else {verdict} end"
    href = _quoted(url_filter.HREF)

    def ranks(kind: str, edges: str) -> str:
        out = f"{kind}_seed as (select host, {kind} / sum({kind}) over () as seed from seeds where {kind} > 0), {kind}_0 as (select host, seed as rank from {kind}_seed)"
        for k in range(rounds):
            out += f""", {kind}_{k + 1} as (select host, sum(rank) as rank from (select dst as host, {damping} * rank * share as rank from {edges} e join {kind}_{k} r on r.host = e.src
                union all select host, (1 - {damping}) * seed from {kind}_seed) group by host)"""
        return out

    return f"""
with judged as (select page_id, url, html, coalesce({host.format("url")}, '') as host,
    coalesce(case when instr(url, '://') > 0 then regexp_extract({rest.format("url")}, '^[^/?#]*([^?#]*)', 1) else '' end, '') as path from pages),
ruled as (select *, {rule} as rule, {verdict} as by_rule from judged),
seeds as (select host, sum(case when by_rule = 'allow' then 1.0::double else 0 end) as allow, sum(case when by_rule = 'block' then 1.0::double else 0 end) as block from ruled where by_rule is not null group by host),
links as (select host as src, unnest(regexp_extract_all(html, {href}, 1)) as raw from judged),
linked as (select src, case when starts_with(raw, '//') then 'http:' || raw else raw end as raw from links),
edges as (select src, dst, count(*)::double as weight from (select src, {host.format("raw")} as dst from linked) where src <> dst and src <> '' and dst <> '' group by src, dst),
along as (select src, dst, weight / sum(weight) over (partition by src) as share from edges),
against as (select dst as src, src as dst, weight / sum(weight) over (partition by dst) as share from edges),
{ranks("allow", "along")}, {ranks("block", "against")}
select page_id, ruled.host, path, rule, coalesce(by_rule, case when coalesce(b.rank, 0) - coalesce(a.rank, 0) > 0 then 'block' else 'allow' end) as verdict
from ruled left join allow_{rounds} a on a.host = ruled.host left join block_{rounds} b on b.host = ruled.host"""


SQL_TOPK = """
with usable as (select vec_id, [floor(256 * x::double)::bigint for x in min(embedding)] as v from embeddings
  where vec_id is not null and embedding is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0 group by vec_id),
terms as (select vec_id, unnest(v) as w, generate_subscripts(v, 1) as term from usable),
scored as (select q.vec_id as query_id, c.vec_id, sum(q.w * c.w)::bigint as score
  from terms q join terms c on q.term = c.term and q.vec_id <> c.vec_id where q.vec_id % 50 = 0 group by 1, 2)
select query_id, rank::int as rank, vec_id, score from
  (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from scored) where rank <= 5"""

SQL_NGRAMS = r"""
with words as (select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from documents),
grams as (select distinct doc_id, unnest(case when len(w) = 0 then [] when len(w) < 3 then [array_to_string(w, ' ')] else [w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] for i in range(1, len(w) - 1)] end) as g from words),
sizes as (select doc_id, count(*) as n from grams group by doc_id),
meets as (select a.doc_id as a, b.doc_id as b, count(*) as shared from grams a join grams b on a.g = b.g and a.doc_id <> b.doc_id group by 1, 2),
links as (select a, b from meets join sizes x on x.doc_id = a join sizes y on y.doc_id = b where 100 * shared >= 90 * (x.n + y.n - shared)),
reach as (with recursive r(a, b) as (select a, b from links union select r.a, l.b from r join links l on l.a = r.b) select * from r),
least as (select a, min(b) as b from reach group by a)
select d.doc_id, coalesce(n, 0)::bigint as n_shingles, least(d.doc_id, coalesce(b, d.doc_id)) as component_id
from documents d left join sizes using (doc_id) left join least on least.a = d.doc_id"""

SQL_LINES = r"""
with docs as (select doc_id, text, string_split(coalesce(text, ''), chr(10)) as lines from documents),
numbered as (select doc_id, unnest(lines) as line, generate_subscripts(lines, 1) - 1 as i from docs),
full_lines as (select * from numbered where not regexp_full_match(line, '[ \t\r\v\f]*')),
runs as (select doc_id, i as first, lead(i, 2) over w as last, line || chr(10) || lead(line) over w || chr(10) || lead(line, 2) over w as run from full_lines window w as (partition by doc_id order by i)),
placed as (select *, row_number() over (partition by run order by doc_id, first) as nth from runs where last is not null),
covered as (select distinct doc_id, unnest(range(first, last + 1)) as i from placed where nth > 1),
gone as (select doc_id, count(*) as n, string_agg(i::varchar, ',' order by i) as removed from covered group by doc_id),
kept as (select doc_id, string_agg(line, chr(10) order by i) as text from numbered anti join covered using (doc_id, i) group by doc_id),
split as (select doc_id, regexp_extract_all(text, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+') as spaced, regexp_extract_all(text, '[^\x20\x09-\x0D]+') as w, regexp_extract(text, '[\x20\x09-\x0D]*$') as tail from kept),
passages as (select doc_id, i, array_to_string(w[i:i + 50], ' ') as run from (select doc_id, w, unnest(range(1, len(w) - 49)) as i from split)),
firsts as (select run, min(doc_id) as least from passages group by run having min(doc_id) <> max(doc_id)),
cut_words as (select distinct p.doc_id, unnest(range(i, i + 51)) as k from passages p join firsts using (run) where p.doc_id <> least),
cut_counts as (select doc_id, count(*) as n_cut from cut_words group by doc_id),
pieces as (select doc_id, unnest(spaced) as piece, generate_subscripts(spaced, 1) as k from split),
left_over as (select doc_id, string_agg(piece, '' order by k) as text from pieces anti join cut_words using (doc_id, k) group by doc_id)
select d.doc_id, len(lines)::bigint as n_lines, coalesce(n, 0)::bigint as n_removed, coalesce(n_cut, 0)::bigint as n_words_cut, coalesce(removed, '') as removed,
  sha256(coalesce(l.text, '') || coalesce(tail, '')) as text_sha256
from docs d left join gone using (doc_id) left join split using (doc_id) left join left_over l using (doc_id) left join cut_counts using (doc_id)"""


def oracle_sql() -> dict[str, str]:
    return {"op1_secret_scans": _sql_secrets(), "op2_url_filters": _sql_urls(), "op6_topk_search": SQL_TOPK, "op8_ngram_jaccard_join": SQL_NGRAMS, "op9_line_dedup": SQL_LINES}
