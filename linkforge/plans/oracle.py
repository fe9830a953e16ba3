"""DuckDB SQL for the registered queries, written from common table expressions."""

from __future__ import annotations

import re

from linkforge.functions import keys, text
from linkforge.operators.features import LEGAL_GROUPS

CAP, POOL_DEPTHS, CUT = 3000, (30, 15, 15), (10, 3, 3)
RECALL_DEPTHS = [1, 3, 5, 10]
#: The rules of the sweep: thresholds one-to-one and not, then expected F by miss mass and floor.
SWEEP = [("threshold", unique, round(0.1 + 0.05 * k, 2), None, None) for unique in (True, False) for k in range(18)]
SWEEP += [("expected_f", True, None, miss, floor) for miss in (0.0, 0.05, 0.1) for floor in (0.05, 0.2)]
#: What names and addresses of the short records are made of.
FORMS = [" Private Limited", " L L C", " d/b/a Red Café", " Société", " & Sons Services", ", M/s. O'Hara Trading Company", "\nSecond Line aka Blue Sky", " 5551234567"]
STREETS = [" St., Apt #", " Rd No. ", " MG Road, Plot ", " Nagar opp. 3rd ", " Ave b"]
STATES = ["Texas", "Kerala", "Ohio", "TG", "New York", "Tamil Nadu", "Paris"]
COUNTRIES = ["US", "India", "France"]
LATIN, NATIVE = "abcdefghijklmnopqrstuvwxyz", "कखगघङचछजझञटठडढणतथदधनपफबभमय"
#: Features of a pair that SQL can express.
PAIR_FEATURES = (
    "n_jacc n_first_eq n_bag_eq n_ntok_a n_ntok_b acr_a_in_b acr_b_in_a legal_agree legal_conflict num_jacc num_unseen_b num_house_eq zip_agree b_script b_is_dom b_has_alt "
    "a_ntok_a a_ntok_b state_agree a_empty_b b_phone_tok"
).split()
SUFFIXES = [" private limited", " l l c", " p l l c", " incorporated", " company limited", " Services of the Group", " corporation"]


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def listed(values) -> str:
    return "[" + ", ".join(map(q, values)) + "]"


def case(values: dict[str, str], x: str) -> str:
    return f"case {x} " + " ".join(f"when {q(a)} then {q(b)}" for a, b in values.items()) + f" else {x} end"


def words(x: str) -> str:
    return f"list_filter(string_split_regex({x}, '\\s+'), lambda w: w <> '')"


def squeeze(x: str) -> str:
    return f"trim(regexp_replace(lower({x}), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))"


def distinct(x: str, n: int | None) -> str:
    return f"list_filter({x}, lambda w, i: list_position({x}, w) = i)" + (f"[1:{n}]" if n else "")


def core(x: str) -> str:
    stop = listed(dict.fromkeys(text.LEGAL + text.FILLER + text.HONORIFICS))
    kept = f"array_to_string(list_filter({words(x)}, lambda w: not list_contains({stop}, w)), ' ')"
    return f"case when {kept} = '' then {x} else {kept} end"


def legal(x: str) -> str:
    for pattern, form in text.LEGAL_FORMS:
        x = f"regexp_replace({x}, {q(pattern)}, {q(form)}, 'g')"
    return x


def quantised(x: str, by: int, most: int) -> str:
    return f"least(greatest(round_even({x} * {by}, 0), 0), {most})"


RECORDS = f"""rec0 as (select 'S' || (doc_id % 3 + 1) || '-' || doc_id as id, (doc_id % 3 + 1)::int as src, coalesce(lang, '') as country, doc_id, coalesce(text, '') as body,
  {squeeze("string_split(coalesce(text, ''), chr(10))[1]")} as name, '' as state,
  {squeeze("case when instr(text, chr(10)) > 0 then substr(text, instr(text, chr(10)) + 1) else '' end")} as addr from documents),
rec as (select *, {core("name")} as core from rec0)"""

_at = "list_filter(string_split(addr, ' '), lambda w: w <> '' and w <> ',' and w <> state)"
_at = f"list_transform({_at}, lambda w: regexp_replace({case(keys.ORDINALS, 'w')}, '^([0-9]+)(?:st|nd|rd|th)$', '\\1'))"
_at = f"list_filter({_at}, lambda w: not list_contains({listed(keys.STOP)}, w) and (length(w) > 1 or regexp_matches(w, '^[0-9]+$')))"
_at = f"flatten(list_transform({_at}, lambda w: case when regexp_matches(w, '^[a-z]*[0-9]+[a-z]*$') and not regexp_matches(w, '^[0-9]+$') then [w, regexp_extract(w, '([0-9]+)', 1)] else [w] end))"
_nt = "list_filter(string_split(core, ' '), lambda w: length(w) > 1 or regexp_matches(w, '^[0-9]+$'))"
def tokens(name: int | None, addr: int | None) -> str:
    return f"""tok0 as (select id, src, country, {_nt} as n0, {_at} as a0 from rec),
tok as (select id, src, country, {distinct("n0", name)} as nt, {distinct("a0", addr)} as at_ from tok0)"""


TOKENS, ALL_TOKENS = tokens(6, 10), tokens(None, None)


def _pairs(col: str, prefix: str) -> str:
    return f"select id, src, country, '{prefix}' || least(a, b) || '|' || greatest(a, b) as key from (select id, src, country, unnest({col}) as a, generate_subscripts({col}, 1) as i, {col} as l from tok) x, unnest(x.l) with ordinality as y(b, j) where j > i"


KEYS = f"""keys as (
  select id, src, country, 'name' as fam, 'n:' || unnest(nt) as key from tok
  union all select id, src, country, 'name', 'c:' || array_to_string(nt, '') from tok where len(nt) > 0
  union all select id, src, country, 'name', key from ({_pairs("nt", "nn:")})
  union all select id, src, country, 'addr', 'a:' || unnest(at_) from tok
  union all select id, src, country, 'addr', key from ({_pairs("at_", "aa:")})
  union all select id, src, country, 'cross', 'na:' || n || '|' || unnest(at_) from (select *, unnest(nt) as n from tok))"""
STATS = f"""parts as (select country, src, count(*) as n from rec where src <> 1 group by all),
stats as (select country, src, fam, key, count(*) as df, ln(1 + any_value(n) / count(*)) as idf from keys join parts using (country, src) where src <> 1 group by country, src, fam, key having count(*) <= {CAP})"""
_sum = lambda f: f"round(sum(case when fam = '{f}' then idf else 0 end), 6) as s_{f}"
SCORES = f"""sums as (select t.country, t.src, s.id as s1, t.id as t, {", ".join(_sum(f).replace("fam =", "t.fam =") for f in ("name", "addr", "cross"))}
  from keys t join stats using (country, src, fam, key) join keys s on s.src = 1 and s.country = t.country and s.fam = t.fam and s.key = t.key group by all),
total as (select *, round(s_name + s_addr + s_cross, 6) as s_tot from sums),
scores as (select *, {", ".join(f"(row_number() over (partition by country, src, s1 order by {quantised(c, 64, 2**20 - 1)} desc, {quantised('s_tot', 16, 4095)} desc, t) - 1)::int as {n}" for n, c in (("rank", "s_tot"), ("rank_name", "s_name"), ("rank_addr", "s_addr")))} from total)"""
def within(depths: tuple[int, int, int]) -> str:
    return " or ".join(f"{rank} < {k} and {score} > 0" for rank, score, k in zip(("rank", "rank_name", "rank_addr"), ("s_tot", "s_name", "s_addr"), depths, strict=True))


POOL = f"pool as (select * from scores where {within(POOL_DEPTHS)}), cuts_of_pool as (select * from pool where {within(CUT)})"
SCORED = "scored as (select s1, src, t, round(s_tot / (s_tot + 60), 6) as p from pool)"
TRUTH = """truth as (select s1, src, id as tgt from rec join (select country, body, min(id) as s1 from rec where src = 1 and body <> '' group by all) using (country, body) where src <> 1),
ents as (select id as s1, country from rec where src = 1)"""
UNIQUE = "uniq as (select s1, src, t, p from (select *, row_number() over (partition by src, t order by p desc, s1) as rn from scored) where rn = 1)"
def chosen(n: str, miss: float, floor: float) -> str:
    return f"""kept{n} as (select *, row_number() over w as j, sum(p) over (w rows unbounded preceding) as hits, sum(p) over (partition by s1) + {miss} as total,
  exp(sum(ln(1 - least(p, 1 - 1e-9))) over (partition by s1)) as none from uniq where p >= {floor} window w as (partition by s1 order by p desc, src, t)),
ef{n} as (select *, round(1.25 * hits / (0.25 * total + j), 9) as ef from kept{n}),
best{n} as (select *, max(ef) over (partition by s1) as best from ef{n}),
cuts{n} as (select *, min(case when ef = best then j end) over (partition by s1) as cut from best{n}),
chosen{n} as (select s1, src, t, t as tgt, p from cuts{n} where best > round(none, 9) and j <= cut)"""


CHOSEN = chosen("", 0.0, 0.05)
ENTITY = """marked as (select coalesce(a.s1, b.s1) as s1, a.tgt is not null as in_pred, b.tgt is not null as in_true from (select distinct s1, tgt from chosen) a full join (select distinct s1, tgt from truth) b on a.s1 = b.s1 and a.tgt = b.tgt),
counts as (select s1, count(*) filter (in_pred) as n_pred, count(*) filter (in_true) as n_true, count(*) filter (in_pred and in_true) as tp from marked group by s1),
entity as (select s1, country, coalesce(n_pred, 0) as n_pred, coalesce(n_true, 0) as n_true, coalesce(tp, 0) as tp,
  case when coalesce(n_pred, 0) = 0 and coalesce(n_true, 0) = 0 then 1.0 else 1.25 * coalesce(tp, 0) / greatest(0.25 * coalesce(n_true, 0) + coalesce(n_pred, 0), 1e-12) end as f from ents left join counts using (s1))"""
PAIRS = "pairs as (select p.src, p.s1, p.t, a.core as core_a, b.core as core_b, a.name as name_a, b.name as name_b, a.addr as addr_a, b.addr as addr_b from pool p join rec a on a.id = p.s1 join rec b on b.id = p.t)"
SUMMARY = """round(avg(f), 6) as macro_f, round(sum(tp) / greatest(sum(n_pred), 1), 6) as micro_p, round(sum(tp) / greatest(sum(n_true), 1), 6) as micro_r,
  round(count(*) filter (n_true = 0 and n_pred = 0) / greatest(count(*) filter (n_true = 0), 1), 6) as singleton_acc, count(*) as n"""


FOLD = "strip_accents(lower({}))"


def _name() -> str:
    """Normalised names of the short records, from the folded name s."""
    plain = lambda x: f"trim(regexp_replace(regexp_replace({x}, {q(text.NON_WORD)}, ' ', 'g'), '\\s+', ' ', 'g'))"
    held = lambda x, stop: f"array_to_string(list_filter({words(x)}, lambda w: not list_contains({listed(dict.fromkeys(stop))}, w)), ' ')"
    alias = q(f"(?s)^(.*?)({text.ALIAS})(.*)$")
    clean = "regexp_replace(regexp_replace(regexp_replace(x, '\\bm\\s*/\\s*s\\b', ' ', 'g'), '[''`´]', '', 'g'), '\\s*&\\s*|\\s*\\+\\s*', ' and ', 'g')"
    return f"""folded as (select *, trim({FOLD.format("business_name")}) as s, {FOLD.format("business_address")} as fa from raw),
dom as (select *, regexp_extract(s, {q(text.DOMAIN)}, 1) <> '' and not contains(s, ' ') as is_dom from folded),
txt as (select *, case when is_dom then translate(regexp_extract(s, {q(text.DOMAIN)}, 1), '.-', '  ') else s end as x from dom),
cleaned as (select * exclude (x), {clean} as x from txt),
aliased as (select *, regexp_matches(x, {q(text.ALIAS)}) as has_alt, regexp_extract(x, {alias}, 1) as pre, regexp_extract(x, {alias}, 3) as post from cleaned),
toks as (select *, {words(legal(plain("case when has_alt then pre || ' ' || post else x end")))} as tk from aliased),
firsts as (select *, list_position(list_transform(tk, lambda t: list_contains({listed(text.HONORIFICS)}, t)), false) as first from toks),
named as (select *, case when coalesce(first, 0) = 0 then '' else array_to_string(tk[first:], ' ') end as name, {held(legal(plain("case when has_alt then post else '' end")), text.LEGAL + text.FILLER)} as alt,
  case when regexp_matches(s, '[a-zA-Z]') and regexp_matches(regexp_replace(s, '[\\x00-\\x7F]', '', 'g'), '\\p{{L}}') then 'M' when regexp_matches(regexp_replace(s, '[\\x00-\\x7F]', '', 'g'), '\\p{{L}}') then 'I' else 'L' end as script from firsts)"""


def _address() -> str:
    """Normalised addresses, from the folded address fa. What look-around says in Spark is said by groups, twice for neighbours."""
    x = "translate(regexp_replace(regexp_replace(fa, '[''`´]', '', 'g'), '\\s*&\\s*|\\s*\\+\\s*', ' and ', 'g'), '#', ' ')"
    for pattern in ("([a-z0-9])[-/.]([0-9])", "([0-9])[-.]([a-z])", "(^|[^\\p{L}\\p{N}_])0+(\\p{Nd})"):
        for _ in range(2):
            x = f"regexp_replace({x}, '{pattern}', '\\1\\2', 'g')"
    plain = f"trim(regexp_replace(regexp_replace(c, {q(text.NON_WORD)}, ' ', 'g'), '\\s+', ' ', 'g'))"
    us = text.US_STATES | {c: c for c in text.US_STATES.values()}
    india = text.IN_STATES | {c: c for c in text.IN_STATES.values()} | text.IN_ALIASES
    known = lambda v: f"list_contains({listed(v)}, c)"
    code = f"case when land = 'us' and {known(us)} then {case(us, 'c')} when land = 'india' and {known(india)} then {case(india, 'c')} end"
    street = f"list_filter(list_transform({words('c')}, lambda t: {case(text.STREET, 't')}), lambda t: t <> '')"
    return f"""parted as (select *, lower(trim(coalesce(country, ''))) as land, list_filter(list_transform(string_split({x}, ','), lambda c: {plain}), lambda c: c <> '') as comps from named),
coded as (select *, list_transform(comps, lambda c: coalesce({code}, c)) as ctext, list_filter(list_transform(comps, lambda c: {code}), lambda c: c is not null) as codes from parted),
addressed as (select *, array_to_string(list_filter(list_transform(ctext, lambda c: array_to_string({street}, ' ')), lambda c: c <> ''), ' , ') as addr, coalesce(codes[len(codes)], '') as state from coded)"""


def _parties() -> str:
    nth = lambda values, n: f"{listed(values)}[({n} % {len(values)} + 1)::int]"
    return f"""raw as (select 'S' || (p_partkey % 3 + 1) || '-' || p_partkey as id, (p_partkey % 3 + 1)::int as src, upper(p_name) || ' ' || replace(p_brand, 'Brand#', 'B') || {nth(FORMS, "p_partkey")} as business_name,
  case when p_partkey % 3 <> 0 and p_partkey % 29 = 0 then '' else '0' || (p_size * 37) || '-' || p_size || ' ' || upper(p_type) || {nth(STREETS, "p_partkey")} || p_size || ', ' || {nth(STATES, "p_size")} end as business_address,
  {nth(COUNTRIES, "p_size")} as country, p_name || '|' || (p_size % 21) as kind from part),
{_name()},
{_address()},
rec as (select id, src, country, kind, name, {core("name")} as core, alt, is_dom, script, addr, array_to_string(regexp_extract_all(addr, '\\p{{Nd}}+'), ' ') as nums, state from addressed),
truth as (select s1, src, id as tgt from rec join (select country, kind, min(id) as s1 from rec where src = 1 group by all) using (country, kind) where src <> 1)"""


def _sweep() -> str:
    """All rules: each one's pairs, the measures of each query, and the best."""
    expected = [(k, *r[3:]) for k, r in enumerate(SWEEP) if r[0] == "expected_f"]
    preds = [f"select {k} as k, s1, t as tgt from {'uniq' if r[1] else 'scored'} where p >= {r[2]}" for k, r in enumerate(SWEEP) if r[0] == "threshold"]
    preds += [f"select {k}, s1, tgt from chosen{k}" for k, _, _ in expected]
    say = lambda x: "null" if x is None else q(x) if isinstance(x, str) else str(x).lower()
    rules = ", ".join(f"({k}, {', '.join(map(say, r))})" for k, r in enumerate(SWEEP))
    return f""", {", ".join(chosen(str(k), miss, floor) for k, miss, floor in expected)},
preds as ({" union all ".join(preds)}),
rules as (select k::int as k, kind, one_to_one, threshold::double as threshold, miss::double as miss, floor::double as floor from (values {rules}) v(k, kind, one_to_one, threshold, miss, floor)),
of_pred as (select k, p.s1, count(*) as n_pred, count(t.tgt) as tp from preds p left join truth t on t.s1 = p.s1 and t.tgt = p.tgt group by k, p.s1),
of_truth as (select s1, count(*) as n_true from truth group by s1),
each as (select r.k, e.s1, coalesce(n_pred, 0) as n_pred, coalesce(n_true, 0) as n_true, coalesce(tp, 0) as tp,
  case when coalesce(n_pred, 0) = 0 and coalesce(n_true, 0) = 0 then 1.0 else 1.25 * coalesce(tp, 0) / greatest(0.25 * coalesce(n_true, 0) + coalesce(n_pred, 0), 1e-12) end as f
  from ents e cross join rules r left join of_pred p on p.k = r.k and p.s1 = e.s1 left join of_truth t on t.s1 = e.s1),
judged as (select k, {SUMMARY} from each group by k)
select judged.*, kind, one_to_one, threshold, miss, floor, k = (select k from judged order by macro_f desc, k limit 1) as best from judged join rules using (k)"""


def top2(by: str, value: str, ties: str, prefix: str) -> str:
    order = f"(partition by {by} order by {value} desc, {ties}"
    whole = f"{order} rows between unbounded preceding and unbounded following)"
    first, second, rank = f"max({value}) over (partition by {by})", f"coalesce(nth_value({value}, 2) over {whole}, -1.0)", f"row_number() over {order})"
    return f"round({first} - {value}, 6) as {prefix}_gap, round(case when {rank} = 1 then {value} - {second} else {value} - {first} end, 6) as {prefix}_margin, ({rank} - 1)::int as {prefix}_rank"


def _validate() -> str:
    found = {
        "duplicate_row": "select s1 as id from lists group by s1 having count(*) > 1",
        "duplicate_id": "select tgt as id from ids where tgt <> '' group by s1, tgt having count(*) > 1",
        "empty_id": "select s1 as id from ids where tgt = ''",
        "self_match": "select tgt as id from ids where tgt like 'S1-%'",
        "wrong_prefix": "select tgt as id from ids where tgt <> '' and not regexp_matches(tgt, '^S[123]-')",
        "unknown_id": "select tgt as id from ids where tgt <> '' and tgt not in (select id from rec where src <> 1)",
        "missing_s1": "select s1 as id from ents where s1 not in (select s1 from lists)",
        "extra_s1": "select s1 as id from lists where s1 not in (select s1 from ents)",
        "not_candidate": "select distinct on (s1, tgt) tgt as id from ids where tgt <> '' and (s1, tgt) not in (select (s1, t) from pool)",
    }
    say = lambda k: "warn" if k == "not_candidate" else "error"
    every = " union all ".join(f"select '{k}' as finding, '{say(k)}' as severity, count(*) as n, coalesce(array_to_string(list_sort(list_distinct(list(id)))[1:5], ','), '') as examples from ({v})" for k, v in found.items())
    return f""", whole as (select s1, coalesce(string_agg(distinct tgt, ',' order by tgt), '') as l from ents left join chosen using (s1) group by s1),
lists as (select s1, case k when '1' then l || ',S2-x,S2-x,,S1-0' when '2' then 'Q9' else l end as l from (select *, substr(md5(s1), 1, 1) as k from whole) where k <> '0'),
ids as (select s1, unnest(string_split(l, ',')) as tgt from lists where l <> '') {every}"""


def _of_parties(ctes: str, legal_of, shared, union, initials) -> dict[str, str]:
    """Queries over the short records."""
    native = lambda x: f"translate({x}, '{LATIN}', '{NATIVE}')"
    side = lambda k: ", ".join(f"{k}.{c} as {c}_{k}" for c in ("name", "core", "addr", "nums", "state", "alt", "is_dom", "script", "at_"))
    phone = "trim(regexp_replace({0}, '\\s*\\b[0-9]{{7,}}\\b', '', 'g'))"
    strip = lambda x: f"case when {phone.format(x)} = '' then {x} else {phone.format(x)} end"
    wa, wb, na, nb = "list_distinct(wa)", "list_distinct(wb)", "list_distinct(na)", "list_distinct(nb)"
    both = "len(na) > 0 and len(nb) > 0"
    flag = lambda known, value: f"case when {known} then ({value})::int::double else -1.0 end"
    long = lambda x: f"list_filter({x}, lambda t: length(t) >= 5)"
    features = {
        "n_jacc": f"round({shared(wa, wb)} / greatest({union(wa, wb)}, 1), 6)", "n_first_eq": "coalesce(wa[1] = wb[1], false)::int::double", "n_bag_eq": "(list_sort(wa) = list_sort(wb))::int::double",
        "n_ntok_a": "len(wa)::double", "n_ntok_b": "len(wb)::double", "acr_a_in_b": flag("len(wa) > 1", f"starts_with(array_to_string(wb, ''), {initials('wa')})"),
        "acr_b_in_a": flag("len(wb) > 1", f"starts_with(array_to_string(wa, ''), {initials('wb')})"), "legal_agree": flag("len(ga) > 0 and len(gb) > 0", f"{shared('ga', 'gb')} > 0"),
        "legal_conflict": f"(len(ga) > 0 and len(gb) > 0 and {shared('ga', 'gb')} = 0)::int::double", "num_jacc": f"case when {both} then round({shared(na, nb)} / {union(na, nb)}, 6) else -1.0 end",
        "num_unseen_b": f"case when {both} then round((len({nb}) - {shared(na, nb)}) / len({nb}), 6) else -1.0 end", "num_house_eq": flag(both, "list_contains(nb, na[1]) or list_contains(na, nb[1])"),
        "zip_agree": flag(f"{both} and len({long(na)}) > 0 and len({long(nb)}) > 0", f"{shared(long(na), long(nb))} > 0"), "b_script": "case script_b when 'I' then 1.0 when 'M' then 2.0 else 0.0 end::double",
        "b_is_dom": "is_dom_b::int::double", "b_has_alt": "(alt_b <> '')::int::double", "a_ntok_a": "len(at__a)::double", "a_ntok_b": "len(at__b)::double",
        "state_agree": flag("state_a <> '' and state_b <> ''", "state_a = state_b"), "a_empty_b": "(addr_b = '')::int::double",
        "b_phone_tok": f"(len(list_filter({words('name_b')}, lambda w: regexp_matches(w, '^[0-9]{{7,}}$'))) > 0)::int::double",
    }
    value = {"s_total": "round(s_name + s_addr + s_cross, 6)", "n_tset": "floor(s_name)", "quick": "quick", "a_ptset": "(floor(s_addr) - 20)", "n_ratio": "s_cross"}
    context = ", ".join(top2("s1, src", v, "t", f"c_{n}") for n, v in value.items())
    return {
        "party_names": ctes + "select id, name, core, alt, is_dom::tinyint as is_dom, script from rec",
        "party_addresses": ctes + "select id, addr, nums, state from rec",
        "has_native_letters": ctes + f"""select id, regexp_matches(case when src = 2 then {native("lower(business_name)")} else business_name end, '[ऀ-෿]') as native,
            {strip("(business_address || ' 5551234567')")} as stripped, replace(regexp_replace(business_address, ',', ' ,', 'g'), ' , ', ' ') as flat from raw""",
        "label_pairs": ctes + "select c.s1, c.src, c.t, (truth.s1 is not null)::int::double as label from cuts_of_pool c left join truth on truth.s1 = c.s1 and truth.tgt = c.t",
        "jaro_winkler": ctes + f"select c.s1, c.src, c.t, round(jaro_winkler_similarity({strip('a.core')}, {strip('b.core')}), 6) as jw from cuts_of_pool c join rec a on a.id = c.s1 join rec b on b.id = c.t",
        "file_profile": ctes + """select country, count(*) as n, count(distinct id) as ids, count(*) filter (not starts_with(id, 'S1-')) as bad_prefix, count(*) - count(distinct (business_name, business_address)) as repeats,
            count(*) filter (business_address = '') as empty_addr, round(quantile_cont(length(business_name), 0.5), 3) as p50, round(quantile_cont(length(business_name), 0.99), 3) as p99 from raw group by rollup (country)""",
        "candidate_context": ctes + f"""select s1, src, t, round(quick, 6) as quick, count(*) over (partition by s1, src) as c_n_cands, {context}, round(max(quick) over (partition by s1) - quick, 6) as c_quick_gap_all,
            (row_number() over (partition by s1 order by quick desc, src, t) - 1)::int as c_quick_rank_all from (select *, (floor(s_name) + greatest(floor(s_addr) - 20, 0)) / 2 as quick from cuts_of_pool)""",
        "pair_token_features": ctes + f"""select s1, src, t, {", ".join(f"{v} as {k}" for k, v in features.items())}, coalesce(f1.n, 0) as t_core_freq, coalesce(f2.n, 0) as s1core_t_freq, coalesce(f3.n, 0) as s1_core_freq
            from (select *, {words("xa")} as wa, {words("xb")} as wb, {words("nums_a")} as na, {words("nums_b")} as nb, {legal_of("name_a")} as ga, {legal_of("name_b")} as gb
              from (select c.s1, c.src, c.t, {side("a")}, {side("b")}, {strip("a.core")} as xa, {strip("b.core")} as xb from cuts_of_pool c
                join (select rec.*, at_ from rec join tok using (id)) a on a.id = c.s1 join (select rec.*, at_ from rec join tok using (id)) b on b.id = c.t)) p
            left join (select src, core, count(*) as n from rec where src <> 1 group by all) f1 on f1.src = p.src and f1.core = p.core_b
            left join (select src, core, count(*) as n from rec where src <> 1 group by all) f2 on f2.src = p.src and f2.core = p.core_a
            left join (select core, count(*) as n from rec where src = 1 group by all) f3 on f3.core = p.core_a""".replace("select s1, src, t,", "select p.s1, p.src, p.t,", 1),
    }


def oracle_sql() -> dict[str, str]:
    steps = [RECORDS, TOKENS, KEYS, STATS, SCORES, POOL, SCORED, TRUTH, UNIQUE, CHOSEN, ENTITY, PAIRS]
    ctes = "with " + ",\n".join(steps) + "\n"
    of_parties = "with " + ",\n".join([_parties(), TOKENS, KEYS, STATS, SCORES, POOL]) + "\n"
    a, b = "list_distinct(wa)", "list_distinct(wb)"
    initials = lambda w: f"array_to_string(list_transform({w}, lambda x: substr(x, 1, 1)), '')"
    groups = LEGAL_GROUPS
    legal_of = lambda n: f"list_distinct(list_transform(list_filter({words(n)}, lambda w: list_contains({listed(groups)}, w)), lambda w: {case(groups, 'w')}))"
    shared = lambda x, y: f"len(list_intersect({x}, {y}))"
    union = lambda x, y: f"(len({x}) + len({y}) - {shared(x, y)})"
    out = {
        "scan_normalized": "select id, src, country, name, core, addr from rec",
        "truth_explode": "select s1, tgt from truth",
        "split_entities": "select id, case when doc_id % 10 < 2 then 'valid' else 'train' end as part from rec where src = 1",
        "profile_tables": "select (doc_id % 3 + 1)::int as src, count(*) as n, count(*) filter (text is null) as nulls, count(distinct doc_id) as ids, count(*) - count(distinct (text, lang)) as repeats, round(quantile_cont(length(text), 0.5), 3) as p50, round(quantile_cont(length(text), 0.99), 3) as p99 from documents group by 1",
        "country_counts": "select src, country, count(*) as n from rec group by all",
        "script_mix": "select case when regexp_matches(name, '[a-zA-Z]') and regexp_matches(regexp_replace(name, '[\\x00-\\x7F]', '', 'g'), '\\p{L}') then 'M' when regexp_matches(regexp_replace(name, '[\\x00-\\x7F]', '', 'g'), '\\p{L}') then 'I' else 'L' end as script, count(*) as n from rec group by 1",
        "name_tokens": "select id, array_to_string(nt, ' ') as tokens from tok",
        "addr_tokens": "select id, array_to_string(at_, ' ') as tokens from tok",
        "url_domain_root": f"select page_id, translate(regexp_extract(regexp_extract(url, '^([a-z]+://[^/?#]*)', 1), {q(text.DOMAIN)}, 1), '.-', '  ') as root from pages",
        "key_df_idf": "select country, src, fam, key, df, round(idf, 6) as idf from stats",
        "blocking_scores": "select src, s1, t, s_name, s_addr, s_cross, s_tot from scores",
        "retrieve_topk_total": f"select src, s1, t, s_tot, rank from scores where rank < {POOL_DEPTHS[0]} and s_tot > 0",
        "retrieve_union3": "select src, s1, t, s_tot, rank, rank_name, rank_addr from pool",
        "fixed_cut": "select src, s1, t from cuts_of_pool",
        "filter_features": f"select src, s1, t, x_gap as g_tot, y_gap as g_name, z_gap as g_addr, x_margin as m_tot, n_pool, t_n, t_margin, t_rank from (select *, {top2('s1, src', 's_tot', 't', 'x')}, {top2('s1, src', 's_name', 't', 'y')}, {top2('s1, src', 's_addr', 't', 'z')}, {top2('src, t', 's_tot', 's1', 't')}, count(*) over (partition by s1, src) as n_pool, count(*) over (partition by src, t) as t_n from pool)",
        "target_competition": f"select src, s1, t, t_n_s1, t_s_total_margin, t_s_total_rank from (select *, count(*) over (partition by src, t) as t_n_s1, {top2('src, t', 's_tot', 's1', 't_s_total')} from pool)",
        "s1_competition": f"select src, s1, t, count(*) over (partition by s1, src) as c_n_cands, {top2('s1, src', 's_tot', 't', 'c_s_tot')} from pool",
        "p_context": f"""select *, round(p1 - p1_margin, 6) as p1_other_max from (select s1, src, t, p as p1, {top2('s1', 'p', 'src, t', 'p1')},
            round(max(p) over (partition by s1, src) - p, 6) as p1_gap_src, (row_number() over (partition by s1, src order by p desc, t) - 1)::int as p1_rank_src,
            round(sum(p) over (partition by s1), 6) as p1_sum, count(*) filter (p >= 0.5) over (partition by s1) as p1_n50, count(*) filter (p >= 0.8) over (partition by s1) as p1_n80 from scored)""",
        "core_frequency": "select src, s1, t, (select count(*) from rec r where r.src = pairs.src and r.core = core_b) as t_core_freq, (select count(*) from rec r where r.src = pairs.src and r.core = core_a) as s1core_t_freq, (select count(*) from rec r where r.src = 1 and r.core = core_a) as s1_core_freq from pairs",
        "token_features": f"""select src, s1, t, round({shared(a, b)} / greatest({union(a, b)}, 1), 6) as n_jacc, coalesce(wa[1] = wb[1], false)::int::double as n_first_eq, (list_sort(wa) = list_sort(wb))::int::double as n_bag_eq, len(wa) as n_ntok_a, len(wb) as n_ntok_b,
            case when len(wa) > 1 then starts_with(array_to_string(wb, ''), {initials('wa')})::int::double else -1.0 end as acr_a_in_b, case when len(wb) > 1 then starts_with(array_to_string(wa, ''), {initials('wb')})::int::double else -1.0 end as acr_b_in_a
            from (select *, {words('core_a')} as wa, {words('core_b')} as wb from pairs)""",
        "number_features": f"""select l_orderkey, round({shared('a', 'b')} / {union('a', 'b')}, 6) as num_jacc, round((len(b) - {shared('a', 'b')}) / len(b), 6) as num_unseen_b, (list_contains(b, a[1]) or list_contains(a, b[1]))::int::double as num_house_eq,
            case when len(la) > 0 and len(lb) > 0 then ({shared('la', 'lb')} > 0)::int::double else -1.0 end as zip_agree
            from (select *, list_filter(a, lambda x: length(x) >= 5) as la, list_filter(b, lambda x: length(x) >= 5) as lb from (select l_orderkey, list_sort(list_distinct(list(l_partkey::varchar))) as a, list_sort(list_distinct(list(l_suppkey::varchar))) as b from lineitem group by 1))""",
        "pair_flags": f"""select src, s1, t, case when len(ga) > 0 and len(gb) > 0 then ({shared('ga', 'gb')} > 0)::int::double else -1.0 end as legal_agree, (len(ga) > 0 and len(gb) > 0 and {shared('ga', 'gb')} = 0)::int::double as legal_conflict,
            case when addr_a <> '' and addr_b <> '' then (substr(addr_a, 1, 2) = substr(addr_b, 1, 2))::int::double else -1.0 end as state_agree, (len(list_filter({words('name_b')}, lambda w: regexp_matches(w, '^[0-9]{{7,}}$'))) > 0)::int::double as b_phone_tok, (addr_b = '')::int::double as a_empty_b
            from (select *, {legal_of('name_a')} as ga, {legal_of('name_b')} as gb from pairs)""",
        "one_to_one": "select * from uniq",
        "select_threshold": "select s1, src, t, p from (select *, row_number() over (partition by src, t order by p desc, s1) as rn from scored where p >= 0.5) where rn = 1",
        "select_expected_f": "select s1, src, t, p from chosen",
        "macro_fbeta": f"select {SUMMARY} from entity",
        "macro_fbeta_by_country": f"select country, {SUMMARY} from entity group by rollup (country)",
        "f_by_truth_size": "select least(n_true, 8) as size, round(avg(f), 6) as f, count(*) as n from entity group by 1",
        "candidate_stats": """select round(avg(n), 6) as mean, quantile_cont(n, 0.5) as median, round(quantile_cont(n, 0.9), 6) as p90, round(quantile_cont(n, 0.95), 6) as p95, max(n) as most, round(avg((n = 0)::int), 6) as none,
            (select round(avg(hit), 6) from hits) as pair_recall, (select round(avg(full_hit), 6) from (select min(hit) as full_hit from hits group by s1)) as full_recall from sizes""",
        "recall_at_k": f"select k, round(avg(coalesce(rank < k, false)::int), 6) as recall from truth left join scores s on s.s1 = truth.s1 and s.t = truth.tgt, (select unnest({RECALL_DEPTHS})::int as k) group by k",
        "error_budget": """select case when max(a) = 1 then case when max(c) = 1 then 'tp' when max(b) = 1 then 'fn_rejected' else 'fn_blocking' end when max(c) = 1 then 'fp' else 'tn' end as kind from
            (select s1, tgt, 1 as a, 0 as b, 0 as c from truth union all select s1, t, 0, 1, 0 from pool union all select s1, tgt, 0, 0, 1 from chosen) group by s1, tgt""",
        "translit_vote": f"""select b, a, n from (select *, sum(n) over (partition by b) as total, row_number() over (partition by b order by n desc, a) as rn from (select a, b, count(*) as n from
            (select unnest(wa) as a, unnest(wb) as b from (select {words('core_a')} as wa, {words('core_b')} as wb from pairs) where len(wa) = len(wb)) where a <> b group by all)) where rn = 1 and n >= 2 and n / total >= 0.5""",
        "state_vote": "select who, event_type, n from (select *, sum(n) over (partition by who) as total, row_number() over (partition by who order by n desc, event_type) as rn from (select user_id::varchar as who, event_type, count(*) as n from events group by all)) where rn = 1 and n >= 2 and n / total >= 0.25",
        "id_lists": "select s1, coalesce(string_agg(distinct tgt, ',' order by tgt), '') as matched_entity_ids from ents left join chosen using (s1) group by s1",
        "matches_not_candidates": "select distinct s1, tgt from truth where (s1, tgt) not in (select (s1, t) from pool)",
        **{f"blocking_keys_{f}": f"select id, key from keys where fam = '{f}'" for f in ("name", "addr", "cross")},
    }
    out["truth_profile"] = """select sum(n)::bigint as n_pairs, count(*) as n_s1, count(*) filter (n = 0) as n_single, round(count(*) filter (n = 0) / count(*), 6) as single_rate, max(n) as most,
        (select count(*) from (select tgt from truth group by tgt having count(distinct s1) > 1)) as n_shared from (select ents.s1, count(distinct tgt) as n from ents left join truth using (s1) group by ents.s1)"""
    out["decision_errors"] = """select coalesce(c.s1, t.s1) as s1, coalesce(c.tgt, t.tgt) as tgt, case when t.s1 is null then 'fp' when p.s1 is null then 'fn_blocking' else 'fn_rejected' end as kind
        from (select distinct s1, tgt from chosen) c full join (select distinct s1, tgt from truth) t on c.s1 = t.s1 and c.tgt = t.tgt left join pool p on p.s1 = coalesce(c.s1, t.s1) and p.t = coalesce(c.tgt, t.tgt)
        where c.s1 is null or t.s1 is null"""
    out["sample_rows"] = "select id from rec order by md5('7:' || id), id limit 50"
    skeleton = "lower(word)"
    for pattern, to in text.PHONETIC:  # look-ahead as a group
        ahead = re.fullmatch(r"(.*)\(\?=(\[\w+\])\)", pattern)
        pattern, to = (f"{ahead[1]}({ahead[2]})", to + "\\1") if ahead else (pattern, to.replace("$", "\\"))
        skeleton = f"regexp_replace({skeleton}, {q(pattern)}, {q(to)}, 'g')"
    out["phonetic_skeleton"] = f"""select word, array_to_string(list_filter(chars, lambda c, i: i = 1 or c <> chars[i - 1]), '') as skeleton from (select word, string_split(regexp_replace(substr(s, 1, 1), '[aeiouy]', 'a') || regexp_replace(substr(s, 2), '[aeiouy]+', '', 'g'), '') as chars
        from (select word, {skeleton} as s from (select distinct unnest({words("regexp_replace(core, '[^a-z ]', '', 'g')")}) as word from rec)))"""
    out["error_budget"] = f"select kind, count(*) as n from ({out['error_budget']}) group by kind"
    sizes = ", sizes as (select s1, count(distinct t) as n from ents left join pool using (s1) group by s1), hits as (select truth.s1, (pool.t is not null)::int as hit from truth left join pool on pool.s1 = truth.s1 and pool.t = truth.tgt)"
    full = {k: (ctes.rstrip() + (sizes if k == "candidate_stats" else "") + "\n" if k not in ("profile_tables", "url_domain_root", "number_features", "state_vote") else "") + v for k, v in out.items()}
    name = f"lower(p_name) || {listed(SUFFIXES)}[(p_partkey % {len(SUFFIXES)} + 1)::int]"
    word = "[^\\p{L}\\p{N}_ऀ-ॣ०-෿]+"
    legal_sql = legal(f"trim(regexp_replace(regexp_replace({name}, '{word}', ' ', 'g'), '\\s+', ' ', 'g'))")
    full["blocking_scores"] = full["blocking_scores"].replace(TOKENS, ALL_TOKENS)
    full["validate_lists"] = ctes.rstrip() + _validate()
    full["rule_sweep"] = ctes.rstrip() + _sweep()
    full |= _of_parties(of_parties, legal_of, shared, union, initials)
    full |= {
        "legal_canonical": f"select p_partkey, legal, {core('legal')} as core from (select p_partkey, {legal_sql} as legal from part)",
        "semi_join": "select o_orderkey, o_custkey from orders where o_orderkey in (select l_orderkey from lineitem where l_quantity > 45)",
        "anti_join": "select c_custkey from customer where c_custkey not in (select o_custkey from orders where o_totalprice > 250000)",
        "set_difference": "select distinct o_custkey as k from orders except select c_custkey from customer where c_custkey % 2 = 0",
        "set_union": "select l_suppkey as k from lineitem union select s_suppkey from supplier",
    }
    return full
