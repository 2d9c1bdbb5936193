"""DuckDB SQL for the registered queries: the same relations written independently, as one chain of CTEs."""

from __future__ import annotations

import re

from latchkey.functions import policy as P

TODAY = "date '2026-08-19'"


def _terms(terms, full: int) -> str:
    hit = lambda t: f"regexp_matches(low, '{(re.escape(t) if ' ' in t else chr(92) + 'b' + re.escape(t) + chr(92) + 'b')}')::int"
    return f"least(1.0, ({' + '.join(map(hit, terms))}) / {full}.0)"


def _marks(marks) -> str:
    return "least(1.0, (" + " + ".join("contains(low, '" + m.replace("'", "''") + "')::int" for m in marks) + ") / 2.0)"


def _list(words) -> str:
    return "(" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + ")"


TOKENS = r"regexp_extract_all(lower({}), '[a-z0-9]+(?:[-_.][a-z0-9]+)*')"
WORDS = r"regexp_extract_all(lower({}), '[A-Za-z0-9][A-Za-z0-9\-_.'']*')"


def text_features(source: str) -> str:
    """Text features of a relation (id, query, history)."""
    found = " || ".join(f"list_transform(regexp_extract_all(query, '(?i){p}'), lambda x: trim(x))" for p in P.IDENTIFIERS)
    intents = ", ".join(f"{_marks(m)} as s_{n}" for n, m in P.INTENTS)
    best = "greatest(" + ", ".join(f"s_{n}" for n, _ in P.INTENTS) + ")"
    first = " ".join(f"when s_{n} = best then '{n}'" for n, _ in P.INTENTS)
    hints = " || ".join(f"(case when regexp_matches(low, '\\b(?:{'|'.join(map(re.escape, t))})') then ['{n}'] else [] end)" for n, t in P.DOC_TYPES)
    follow = " + ".join(f"regexp_matches(low, '\\b{re.escape(t)}\\b')::int" for t in P.FOLLOWUP)
    return rf"""
f0 as materialized (select *, lower(query) as low, {WORDS.format('query')} as words, {found} as found0 from {source}),
f1 as (select *, list_filter(found0, lambda x, i: list_position(found0, x) = i) as found, list_filter(words, lambda x: x not in {_list(P.FEATURE_STOPWORDS)}) as content,
    {_terms(P.TEMPORAL, 2)} as temporal_signal, {_terms(P.COMPARISON, 2)} as comparison_signal, {_terms(P.MULTIHOP, 3)} as multihop_signal, {intents}, {hints} as hints from f0),
f2 as (select *, {best} as best, len(words) as n, case when len(found) > 0 then least(1.0, 0.65 + 0.35 * (len(found) - 1)) else 0.0 end as identifier_signal,
    least(1.0, (len(regexp_extract_all(low, '{P.NUMERIC}')) + len(regexp_extract_all(low, '{P.DATES}'))) / 3.0) as numeric_signal,
    case when len(content) = 0 then 0.0 else list_sum(list_transform(content, lambda w: least(1.0, (case when length(w) >= 9 then 0.5 when length(w) >= 6 then 0.25 else 0.0 end)
      + (case when regexp_matches(w, '[0-9]') then 0.5 else 0.0 end) + (case when regexp_matches(w, '[-_.]') then 0.4 else 0.0 end)))) / len(content) end as spec from f1),
ft as materialized (select id, query, history, words, content, found, hints, n as query_length_tokens, least(1.0, n / 25.0) as query_length, identifier_signal, numeric_signal, temporal_signal, comparison_signal, multihop_signal,
    least(1.0, case when len(content) > 0 and len(found) > 0 then greatest(spec, 0.7) else spec end) as lexical_specificity,
    case when comparison_signal >= 0.5 then 'comparison' when temporal_signal >= 0.67 then 'temporal' when best > 0 then case {first} end else 'lookup' end as intent,
    least(1.0, 0.34 * multihop_signal + 0.34 * comparison_signal + 0.18 * least(1.0, len(regexp_extract_all(low, '\b(?:and|also|plus|as well as)\b')) / 2.0)
      + 0.14 * least(1.0, greatest(0, len(regexp_extract_all(low, '\?')) - 1) / 2.0) + 0.20 * least(1.0, greatest(0, n - 10) / 18.0)) as hop_signal,
    case when history is null then 0.0 else least(1.0, ({follow}) / 2.0 * (case when n <= 6 then 1.0 else 0.4 end) + (case when n <= 4 then 0.25 else 0.0 end)) end as followup_signal
    from f2),
fh as (select *, least(3, case when comparison_signal >= 0.5 then greatest(1 + floor(hop_signal * 2.4), 2) else 1 + floor(hop_signal * 2.4) end)::int as likely_hop_count from ft)"""


META = r"""
meta0 as (select doc_id, lang, source, case cast(substr(source, 4) as int) % 5 when 0 then 'policy' when 1 then 'runbook' when 2 then 'report' when 3 then 'finance' else 'wiki' end as doc_type,
    date '2023-01-01' + cast((doc_id * 37) % 1500 as int) as effective_date, (1 + doc_id % 5)::int as authority_score, lang || '-' || source || '-' || (doc_id % 7) as policy_family from documents),
meta as materialized (select *, lag(doc_id) over w as supersedes, lead(doc_id) over w as superseded_by, '1.' || (row_number() over w) as version, 'Doc ' || doc_id as title, source as owner,
    effective_date - 30 as created_date from meta0 window w as (partition by policy_family order by effective_date, doc_id)),
type_roles(doc_type, role) as (values ('policy','employee'),('policy','hr'),('policy','manager'),('runbook','engineering'),('report','employee'),('report','engineering'),('report','manager'),('finance','finance'),('wiki','employee')),
doc_roles as (select doc_id, role from meta join type_roles using (doc_type)),
seg_roles(seg, role) as (values ('HOUSEHOLD','hr'),('MACHINERY','engineering'),('FURNITURE','manager'),('BUILDING','finance')),
user_roles as (select c_custkey as user_id, 'employee' as role from customer where c_custkey % 50 <> 0 union all select c_custkey, role from customer join seg_roles on seg = c_mktsegment where c_custkey % 50 <> 0),
qs0 as (select item_id as query_id, regexp_split_to_array(text, '\s+') as w, 1 + (item_id * 17) % 150 as user_id, text as passage, item_id % 3 = 0 as freshness_sensitive from benchmark),
qs1 as (select *, case query_id % 5 when 1 then 'difference between ' || array_to_string(w[1:5], ' ') || ' and ' || array_to_string(w[6:10], ' ') when 2 then array_to_string(w[1:5], ' ') || ' versus ' || array_to_string(w[6:10], ' ')
    when 3 then array_to_string(w[1:6], ' ') || '; ' || array_to_string(w[7:12], ' ') when 4 then 'what about ' || array_to_string(w[7:9], ' ') else array_to_string(w[1:12], ' ') end as asked, case when query_id % 5 = 4 then array_to_string(w[1:6], ' ') end as history from qs0),
qs2 as (select *, trim(regexp_replace(asked, '\s+', ' ', 'g')) as q, TOKENS_OF_ASKED as t from qs1),
qs as materialized (select query_id, case when history is not null and len(t) <= 8 and coalesce(t[1] in PRONOUNS, false) then trim(trim(history) || ' ' || q) else q end as query, asked, history, user_id, passage, freshness_sensitive from qs2),
scope as materialized (select distinct user_id, doc_id from user_roles join doc_roles using (role) where user_id in (select user_id from qs))"""

META = META.replace("TOKENS_OF_ASKED", TOKENS.format(r"trim(regexp_replace(asked, '\s+', ' ', 'g'))")).replace("PRONOUNS", _list(P.LEADING_PRONOUNS))

CHUNKS = rf"""
texts as (select doc_id, case doc_id % 3 when 0 then '# Part ' || doc_id || chr(10) || text || chr(10) || '2. Terms of notice' || chr(10) || 'The notice period is ' || (10 + doc_id // 140 % 4) || ' days.' when 1 then text || chr(10) || 'An allowance of ' || (5 + doc_id // 140 % 5) || ' percent applies.' else text end as text from documents),
sc0 as (select doc_id, i, ls[i] as line, regexp_matches(ls[i], '{P.HEADING}') and trim(ls[i]) <> '' as h from (select doc_id, string_split(text, chr(10)) as ls from texts), unnest(range(1, len(ls) + 1)) t(i)),
sc1 as (select *, sum(h::int) over (partition by doc_id order by i) as s from sc0),
sc2 as (select doc_id, s, max(case when h then trim(regexp_replace(line, '^\s*#{{1,6}}\s+', '')) end) as heading, regexp_replace(coalesce(string_agg(case when not h then line end, chr(10) order by i), ''), '^\s+|\s+$', '', 'g') as b, min(s) over (partition by doc_id) as s0 from sc1 group by doc_id, s),
body as materialized (select doc_id, (s - s0)::bigint as section, heading, b from sc2 where b <> '' union all select doc_id, 0, null, regexp_replace(text, '^\s+|\s+$', '', 'g') from texts where doc_id not in (select doc_id from sc2 where b <> '')),
wins as (select doc_id, section, heading, i, case when length(b) <= 1440 then b else substr(b, 1 + i * 750, 900) end as w from body, unnest(case when length(b) <= 1440 then [0] else range(0, (length(b) - 1) // 750 + 1) end) as t(i)),
chunks as materialized (select printf('%d::c%03d', doc_id, ordinal) as chunk_id, * from (select doc_id, (row_number() over (partition by doc_id order by section, i) - 1)::int as ordinal, heading,
    regexp_replace(case when heading is null then w else heading || chr(10) || chr(10) || w end, '^\s+|\s+$', '', 'g') as text from wins where regexp_replace(w, '^\s+|\s+$', '', 'g') <> ''))"""

POST = rf"""
toks as (select chunk_id, doc_id, {TOKENS.format('text')} as t from chunks),
toks1 as (select chunk_id, doc_id, case when len(t) > 0 then t else ['__empty__'] end as t from toks),
post as materialized (select chunk_id, doc_id, dl, term, count(*) as tf from (select chunk_id, doc_id, len(t) as dl, unnest(t) as term from toks1) group by all),
size as materialized (select count(*) as n, avg(dl) as avgdl from (select chunk_id, any_value(dl) as dl from post group by chunk_id)),
dfs as (select term, count(*) as df from post group by term),
raw as (select term, df, ln(n - df + 0.5) - ln(df + 0.5) as raw from dfs, size),
idf as materialized (select term, df, case when raw < 0 then 0.25 * (select avg(raw) from raw) else raw end as idf from raw),
tidf as materialized (select term, df, ln((1 + n) / (1 + df)) + 1 as idf from dfs, size),
vec0 as (select chunk_id, doc_id, term, (1 + ln(tf)) * idf as w from post join tidf using (term)),
vec as materialized (select chunk_id, doc_id, term, w / greatest(sqrt(sum(w * w) over (partition by chunk_id)), 1e-9) as weight from vec0)"""

SEARCH = rf"""
qt as materialized (select query_id, user_id, term, count(*) as qtf from (select query_id, user_id, unnest({TOKENS.format('query')}) as term from qs) group by all),
sp0 as (select query_id, user_id, chunk_id, doc_id, round(sum(idf * qtf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) as score
    from qt join post using (term) join idf using (term) join scope using (user_id, doc_id) cross join size group by all having score > 0),
sparse as materialized (select *, round(score / max(score) over (partition by query_id), 6) as normalised from
    (select *, row_number() over (partition by query_id order by score desc, chunk_id) as rank from sp0) where rank <= 10),
qv0 as (select query_id, user_id, term, (1 + ln(qtf)) * idf as w from qt join tidf using (term)),
qv as (select query_id, user_id, term, w / greatest(sqrt(sum(w * w) over (partition by query_id)), 1e-9) as qw from qv0),
dn0 as (select query_id, user_id, chunk_id, doc_id, round(sum(qw * weight), 6) as score from qv join vec using (term) join scope using (user_id, doc_id) group by all),
dense as materialized (select * from (select *, row_number() over (partition by query_id order by score desc, chunk_id) as rank from dn0) where rank <= 10)"""

PROBE = r"""
pr1 as (select query_id, max(case when rank = 1 then score end) as b1, max(case when rank = 2 then score end) as b2, list(chunk_id) as s_ids from sparse where rank <= 5 group by 1),
pr2 as (select query_id, max(score) as cos, list(chunk_id) as d_ids from dense where rank <= 5 group by 1),
pr3 as (select query_id, max((n > 1)::int)::double as conflict from (select query_id, policy_family, count(*) as n from
    (select query_id, doc_id from sparse where rank <= 5 union select query_id, doc_id from dense where rank <= 5) join meta using (doc_id) group by all) group by 1),
probe as materialized (select query_id, user_id, round(coalesce(least(1.0, b1 / (b1 + 6.0) * (0.72 + 0.28 * (case when b2 is null then 1.0 else 1 - b2 / b1 end))), 0.0), 4) as sparse_confidence,
    round(least(1.0, greatest(0.0, coalesce(cos, 0.0))), 4) as dense_confidence,
    round(case when len(list_distinct(coalesce(s_ids, []) || coalesce(d_ids, []))) > 0 then len(list_intersect(coalesce(s_ids, []), coalesce(d_ids, [])))::double / len(list_distinct(coalesce(s_ids, []) || coalesce(d_ids, []))) else 0.0 end, 4) as agreement,
    coalesce(conflict, 0.0) as conflict_likelihood from qs left join pr1 using (query_id) left join pr2 using (query_id) left join pr3 using (query_id))"""

SUMMARY = r"""
per_doc as (select doc_id, count(*) as chunks from chunks group by 1),
doc_sets as (select doc_type, list_sort(list(distinct role)) as roles, doc_id from meta left join doc_roles using (doc_id) group by doc_type, doc_id),
doc_groups as materialized (select roles as dset, doc_type, count(*) as docs, sum(coalesce(chunks, 0))::bigint as chunks from doc_sets left join per_doc using (doc_id) group by all),
user_sets as (select c_custkey as user_id, coalesce(list_sort(list(distinct role) filter (role is not null)), []) as uset from customer left join user_roles on user_id = c_custkey group by 1),
summary as materialized (select user_id, sum(case when list_has_any(uset, dset) then chunks else 0 end)::bigint as allowed_chunks, sum(case when list_has_any(uset, dset) then docs else 0 end)::bigint as allowed_docs, sum(chunks)::bigint as total_chunks,
    sum(case when list_has_any(uset, dset) then 0 else chunks end)::bigint as withheld, coalesce(array_to_string(list_sort(list(distinct doc_type) filter (not list_has_any(uset, dset))), ','), '') as withheld_types,
    round(case when sum(chunks) > 0 then sum(case when list_has_any(uset, dset) then 0 else chunks end)::double / sum(chunks) else 0.0 end, 6) as restricted_fraction from user_sets, doc_groups group by user_id)"""

FEATURES = (
    "qf as (select query_id as id, query, history from qs),"
    + text_features("qf")
    + r""",
ff0 as (select fh.*, p.* exclude (query_id), allowed_chunks, restricted_fraction, fh.id as query_id from fh join probe p on p.query_id = fh.id join summary using (user_id)),
ff1 as (select *, case when len(words) = 0 then 0.5 else least(1.0, (0.40 * least(1.0, (1.0 - len(content)::double / len(words)) * 1.4) + 0.35 * (1.0 - identifier_signal) + 0.55 * greatest(0.0, dense_confidence - sparse_confidence)) * (1.0 - 0.75 * identifier_signal)) end as semantic_ambiguity from ff0),
feat as materialized (select *, least(1.0, 0.5 * least(identifier_signal, 1.0 - abs(identifier_signal - semantic_ambiguity)) + 0.5 * least(sparse_confidence, dense_confidence) * (0.5 + 0.5 * (case when least(sparse_confidence, dense_confidence) > 0.2 then 1.0 - agreement else 0.0 end))) as mixed_signal,
    temporal_signal >= 0.34 or intent = 'temporal' as freshness_required, 1.0 - greatest(sparse_confidence, dense_confidence) as unsupported_signal from ff1)"""
)


def _router() -> str:
    rows = ", ".join("(" + ", ".join(f"'{v}'" if isinstance(v, str) else str(v) for v in r) + ")" for r in P.ROUTE_TABLE)
    intents = [n for n, _ in P.INTENTS]
    quality = " ".join(
        f"when '{r}' then "
        + " + ".join(f"({w}) * " + (f"(intent = '{f[7:]}')::int" if f.startswith("intent_") and f[7:] in intents else f) for rr, f, w in P.QUALITY_WEIGHTS if rr == r)
        for r in P.ROUTES
    )
    return rf"""
routes(route, bl, pc, ti, tk, br, fr, cr, prior) as (values {rows}),
u0 as (select query_id, route, allowed_chunks, greatest(0.0, least(1.0, prior + (case route {quality} end))) as q,
    (bl + pc * 10) * (case when route = 'R4' then greatest(1, least(3, likely_hop_count)) else 1 end) as l, (ti * 3.0 + tk * 15.0) / 1e6 as c,
    greatest(0.0, least(1.0, br + (case when freshness_required then fr else 0 end) + cr * conflict_likelihood + (case when route <> 'R0' then 0.30 * restricted_fraction
      + (case when greatest(sparse_confidence, dense_confidence) < 0.65 then 0.45 * (0.65 - greatest(sparse_confidence, dense_confidence)) / 0.65 else 0 end) else 0 end))) as r,
    case when route = 'R0' then null when allowed_chunks = 0 then 'no authorised chunks in scope' when greatest(sparse_confidence, dense_confidence) < 0.12 then 'probe confidence below the minimum' end as rejection from feat, routes),
util as materialized (select query_id, route, rejection is null as admissible, rejection, round(q::double + 1e-9, 4) as quality, round(l::double + 1e-9, 4) as latency, round(c::double + 1e-9, 6) as cost, round(r::double + 1e-9, 4) as risk,
    round((q - 0.09 * l - 0.12 * c * 100 - 0.55 * r)::double + 1e-9, 4) as utility from u0),
d0 as (select *, row_number() over w as n, lead(route) over w as nx, lead(utility) over w as nu, lead(admissible) over w as nok from util window w as (partition by query_id order by admissible desc, utility desc, route)),
dec as materialized (select query_id, max(case when n = 1 then route end) as route, max(case when n = 1 then utility end) as utility, max(case when n = 1 and nok then nx end) as nx0, max(case when n = 1 then nu end) as nu0, max(case when n = 1 then nok::int end) as nok0,
    string_agg(case when n > 1 then route end, ',' order by n) as rejected from d0 group by 1),
decision as materialized (select query_id, route, coalesce(nx0, 'R0') as fallback, case when nok0 = 1 then round(greatest(0.0, least(1.0, 0.5 + 2.0 * (utility - nu0))) + 1e-9, 3) else 1.0 end as confidence, utility, rejected from dec)"""


def _topic(text: str) -> str:
    """What a part of a query is about; lists of one carry values on."""
    start = f"case when lower(array_to_string(w[1:2], ' ')) in {_list(P.OPENERS_TWO)} then 3 when lower(w[1]) in {_list(P.OPENERS_ONE)} then 2 else 1 end"
    rest = f"list_transform([string_split(trim(regexp_replace({text}, '\\s+', ' ', 'g')), ' ')], lambda w: w[{start}:])"
    whole = f"list_transform({rest}, lambda w: case when len(w) > 0 and lower(w[len(w)]) in {_list(P.TOPIC_ENDS)} then w[1:len(w) - 1] else w end)"
    return f"list_transform({whole}, lambda w: trim(array_to_string(list_filter(w, lambda v: lower(v) not in {_list(P.CHANGE_WORDS + P.ARTICLES)}), ' '), ' ,.?'))[1]"


_ABOUT = "(case when {0} <> '' then {0} || ' ' || trim({1}) else trim({1}) end)"
SUBS = rf"""
dq0 as (select query_id, user_id, trim(regexp_replace(query, '\s+', ' ', 'g')) as q from qs),
dq1 as (select *, {_topic(r"regexp_replace(q, '(?is)\bbetween\s.*$', '')")} as frame, {_topic('q')} as whole, regexp_split_to_array(q, '{P.VERSUS}') as sides, list_filter(list_transform(regexp_split_to_array(q, '{P.JOINED}'), lambda x: trim(x)), lambda x: x <> '') as parts from dq0),
dq2 as (select *, {_topic('sides[1]')} as side from dq1),
dq3 as (select query_id, user_id, q, case when regexp_matches(q, '{P.BETWEEN}') then [{_ABOUT.format('frame', f"regexp_extract(q, '{P.BETWEEN}', 1)")}, {_ABOUT.format('frame', f"regexp_extract(q, '{P.BETWEEN}', 2)")}]
    when len(sides) > 1 then list_transform(sides, lambda s, i: case when i = 1 then trim(s) else {_ABOUT.format('side', 's')} end)
    when regexp_matches(q, '(?i)\b(?:{'|'.join(P.CHANGE_WORDS)})\b') and whole <> '' then ['current ' || whole, 'previous ' || whole] when len(parts) > 1 then parts else [] end as found from dq2),
dq4 as (select query_id, user_id, [q] || list_filter(list_transform(found, lambda c: trim(trim(regexp_replace(c, '\s+', ' ', 'g')), ' ,.?')), lambda c: len(string_split(c, ' ')) >= 2) as said from dq3 where q <> ''),
dq5 as (select query_id, user_id, list_filter(said, lambda c, i: list_position(list_transform(said, lambda x: lower(x)), lower(c)) = i)[1:3] as subs from dq4),
subq as materialized (select query_id, user_id, i - 1 as sub_no, subs[i] as query from dq5, unnest(range(1, len(subs) + 1)) t(i))"""

CANDS = SUBS + rf""",
lists as (select query_id, user_id, chunk_id, doc_id, rank from sparse union all select query_id, user_id, chunk_id, doc_id, rank from dense),
r3 as (select query_id, user_id, chunk_id, doc_id, round(sum(1.0 / (60 + rank)), 9) as score from lists group by all),
bt as materialized (select query_id, user_id, sub_no, term, count(*) as qtf from (select query_id, user_id, sub_no, unnest({TOKENS.format('query')}) as term from subq) group by all),
bs as (select query_id, user_id, sub_no, chunk_id, doc_id, round(sum(idf * qtf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) as score
    from bt join post using (term) join idf using (term) join scope using (user_id, doc_id) cross join size group by all having score > 0),
bw as (select query_id, user_id, sub_no, term, (1 + ln(qtf)) * idf as w from bt join tidf using (term)),
bq as (select query_id, user_id, sub_no, term, w / greatest(sqrt(sum(w * w) over (partition by query_id, sub_no)), 1e-9) as qw from bw),
bd as (select query_id, user_id, sub_no, chunk_id, doc_id, round(sum(qw * weight), 6) as score from bq join vec using (term) join scope using (user_id, doc_id) group by all),
br as materialized (select * from (select *, row_number() over (partition by query_id, sub_no, kind order by score desc, chunk_id) as rank from (select *, 's' as kind from bs union all select *, 'd' as kind from bd)) where rank <= 5),
r4 as (select query_id, user_id, chunk_id, doc_id, round(sum(pow(0.75, sub_no) / (60 + rank)), 9) as score from br group by all),
fused as (select * from (select query_id, user_id, 'R3' as route, chunk_id, doc_id, score, row_number() over (partition by query_id order by score desc, chunk_id) as rank from r3) where rank <= 10
    union all select * from (select query_id, user_id, 'R4' as route, chunk_id, doc_id, score, row_number() over (partition by query_id order by score desc, chunk_id) as rank from r4) where rank <= 10),
cand as materialized (select query_id, user_id, 'R1' as route, chunk_id, doc_id, normalised as score, rank from sparse union all select query_id, user_id, 'R2', chunk_id, doc_id, greatest(0.0, score), rank from dense union all select * from fused)"""

RERANK = rf"""
rq as materialized (select query_id, lower(query) as ql, list_filter({TOKENS.format('query')}, lambda x: x not in {_list(P.RERANK_STOPWORDS)}) as terms from qs),
rw as (select query_id, term, coalesce(idf, ln(1.0 + n) + 1) as w from (select query_id, unnest(list_distinct(terms)) as term from rq) left join tidf using (term) cross join size),
rc as materialized (select distinct query_id, chunk_id from cand),
rp as (select query_id, chunk_id, coalesce(sum(w * tf / (tf + 0.35)), 0.0) as matched, sum(w) as total, count(tf) as hits, count(*) as n from rc join rw using (query_id) left join post using (chunk_id, term) group by all),
rb as (select query_id, chunk_id, ql, terms, case when heading is null then 0.0 else len(list_intersect(list_distinct(HEADING_TOKENS), list_distinct(terms)))::double / greatest(len(list_distinct(terms)), 1) end as hs, lower(text) as tl, len({TOKENS.format('text')}) as dl, list_filter(list_transform(range(1, len(terms)), lambda i: case when length(terms[i]) + length(terms[i + 1]) > 6 then terms[i] || ' ' || terms[i + 1] end), lambda x: x is not null) as bg
    from rc join rq using (query_id) join chunks using (chunk_id)),
rs as (select query_id, chunk_id, terms, dl, hs, case when length(ql) > 12 and contains(tl, ql) then 1.0 else least(1.0, (case when len(bg) > 0 then len(list_filter(bg, lambda x: contains(tl, x)))::double / len(bg) else 0.0 end)
    + (case when len(list_filter(terms, lambda t: length(t) >= 4 and regexp_matches(t, '[0-9]') and regexp_matches(t, '[a-z]') and not regexp_matches(t, '^(19|20)[0-9]{{2}}$') and contains(tl, t))) > 0 then 0.6 else 0.0 end)) end as phrase from rb),
scored as materialized (select query_id, chunk_id, round(coalesce(matched / total, 0.0), 4) as overlap, round(phrase::double, 4) as phrase, round(hs::double, 4) as heading_score, round(coalesce(hits::double / n, 0.0), 4) as coverage,
    round(least(1.0, case when len(terms) = 0 then 0.0 else (0.40 * coalesce(matched / total, 0.0) + 0.18 * phrase + 0.10 * hs + 0.32 * coalesce(hits::double / n, 0.0)) / (1.0 + greatest(0.0, (greatest(dl, 1) - 220) / 900.0)) end)::double, 6) as score from rs left join rp using (query_id, chunk_id)),
rr as materialized (select * from (select query_id, user_id, route, chunk_id, doc_id, overlap, phrase, heading_score, coverage, s.score, row_number() over (partition by query_id, route order by s.score desc, chunk_id) as rank
    from cand join scored s using (query_id, chunk_id)) where rank <= 8)"""

RERANK = RERANK.replace("HEADING_TOKENS", TOKENS.format("heading"))

PACK = rf"""
pk0 as (select rr.query_id, rr.user_id, route, chunk_id, rr.doc_id, m.* exclude (doc_id, lang, source, supersedes, created_date), freshness_sensitive,
    case when freshness_sensitive then round(least(1.0, score * (case when superseded_by is not null then 0.55 else 1.0 end) * (case when effective_date > {TODAY} then 0.55 else 1.0 end) * (0.9 + 0.05 * (authority_score - 1)))::double, 6) else score end as score
    from rr join scope using (user_id, doc_id) join meta m using (doc_id) join qs using (query_id) where score > 0),
pk1 as (select * from pk0 a where freshness_sensitive or not exists (select 1 from pk0 b where b.query_id = a.query_id and b.route = a.route and b.doc_id = a.superseded_by)),
pack as materialized (select * from (select *, row_number() over (partition by query_id, route order by score desc, chunk_id) as position from pk1) where position <= 5),
ask as (select query_id, user_id, query, freshness_sensitive, route from qs, (values ('R0'), ('R1'), ('R2'), ('R3'), ('R4')) r(route)),
sf0 as (select query_id, route, count(*) as chunks, count(distinct doc_id) as documents, max(score) as top, sum(round(score * 1e6)::bigint)::bigint / (count(*) * 1e6) as mean, max(case when doc_type = 'policy' then authority_score end) as authority,
    bool_or(position = 1 and superseded_by is null and effective_date <= {TODAY}) as cur from pack group by all),
suff as materialized (select query_id, route, failure_reason is null as sufficient, failure_reason, coalesce(chunks, 0) as chunks, coalesce(documents, 0) as documents, round(top + 1e-9, 4) as top_score, round(mean + 1e-9, 4) as mean_score, fresh, failing from (
    select ask.query_id, ask.route, chunks, documents, top, mean, array_to_string(list_filter([case when chunks is null then 'evidence' end, case when top < 0.10 or mean < 0.09 then 'relevance' end, case when intent in ('comparison', 'summarisation') and documents < 2 then 'diversity' end, case when authority < 3 then 'authority' end,
      case when query_length_tokens <= 4 and semantic_ambiguity >= 0.6 and top < 0.2 then 'clarity' end, case when freshness_required and not coalesce(cur, false) then 'freshness' end], lambda x: x is not null), ',') as failing, (not freshness_required) or coalesce(cur, false) as fresh,
    case when chunks is null then 'no_authorised_evidence' when top < 0.10 or mean < 0.09 then 'low_relevance' when chunks < 1 then 'insufficient_evidence' when intent in ('comparison', 'summarisation') and documents < 2 then 'insufficient_diversity'
      when authority < 3 then 'low_authority' when query_length_tokens <= 4 and semantic_ambiguity >= 0.6 and top < 0.2 then 'ambiguous_needs_clarification' end as failure_reason
    from ask join feat using (query_id) left join sf0 on sf0.query_id = ask.query_id and sf0.route = ask.route))"""

ANSWER = rf"""
tw0 as (select query_id, route, unnest(list_distinct(terms)) as term from ask join rq using (query_id)),
tdf as (select query_id, route, term, count(*) as df from pack join post using (chunk_id) group by all),
pn as (select query_id, route, count(*) as n from pack group by all),
tw as materialized (select query_id, route, term, round((ln((1 + n) / (1 + coalesce(df, 0))) + 1) * (case when regexp_matches(term, '[0-9-]') then 2.2 else 1.0 end), 6) as weight from tw0 join pn using (query_id, route) left join tdf using (query_id, route, term)),
ss0 as (select query_id, route, chunk_id, position - 1 as chunk_rank, list_filter(list_transform(string_split(regexp_replace(regexp_replace(text, '\n(?:([-*\d#])|\n+)', chr(1) || '\1', 'g'), '([.!?])\s+([A-Z0-9£$])', '\1' || chr(1) || '\2', 'g'), chr(1)),
    lambda x: trim(regexp_replace(trim(regexp_replace(x, '\s+', ' ', 'g')), '^[-*#>\s]+', ''))), lambda x: length(x) >= 12) as ss from pack join chunks using (chunk_id)),
ss1 as materialized (select query_id, route, chunk_id, chunk_rank, i - 1 as place, ss[i] as sentence from ss0, unnest(range(1, len(ss) + 1)) t(i)),
sm as (select query_id, route, chunk_id, place, sum(weight) as matched from (select query_id, route, chunk_id, place, unnest(list_distinct({TOKENS.format('sentence')})) as term from ss1) join tw using (query_id, route, term) group by all),
st as (select query_id, route, sum(weight) as total from tw group by all),
sent as materialized (select query_id, route, chunk_id, chunk_rank, place, sentence, round(coalesce(matched / total * (case when len(string_split(sentence, ' ')) < 6 then 0.6 when len(string_split(sentence, ' ')) <= 45 then 1.0 else 0.8 end) * (1 - 0.06 * chunk_rank) * (1 - 0.015 * place), 0.0), 6) as score
    from ss1 left join sm using (query_id, route, chunk_id, place) join st using (query_id, route)),
sl1 as (select *, row_number() over (partition by query_id, route, chunk_id order by score desc, chunk_rank, place) as a from sent where score > 0),
sl2 as (select * from (select *, row_number() over (partition by query_id, route order by score desc, chunk_rank, place) as b from sl1 where a <= 2) where b <= 6),
sel as materialized (select query_id, route, chunk_id, chunk_rank, place, sentence from sl2 union all select query_id, route, chunk_id, chunk_rank, place, sentence from sent s where chunk_rank = 0 and place = 0 and not exists (select 1 from sl2 where sl2.query_id = s.query_id and sl2.route = s.route)),
vc as materialized (select query_id, route, policy_family, count(distinct doc_id) as documents, array_to_string(list_sort(list(distinct title || ' v' || version || ' (effective ' || effective_date || ')')), '; ') as versions, array_to_string(list_sort(list(distinct chunk_id)), ',') as chunk_ids,
    arg_max(doc_id, ((superseded_by is null), (effective_date <= {TODAY}), effective_date, authority_score, doc_id)) as preferred from pack group by all having documents > 1),
nt as materialized (select query_id, route, string_agg('- ' || note, chr(10) order by position) as notes from (select query_id, route, position, case when superseded_by is not null then '''' || title || ''' v' || version || ' has been superseded by ' || superseded_by
    when effective_date > {TODAY} then '''' || title || ''' v' || version || ' takes effect ' || effective_date end as note from pack) where note is not null group by all),
bod as (select query_id, route, string_agg('- ' || sentence || ' [' || chunk_id || ']', chr(10) order by chunk_rank, place) as body from sel group by all),
CLAIMS,
nc as materialized (select query_id, route, policy_family, topic, unit, array_to_string(list_transform(list_sort(list(distinct value)), lambda v: v::varchar), ',') as values_stated, array_to_string(list_sort(list(distinct chunk_id)), ',') as chunk_ids from (select query_id, route, policy_family, chunk_id from pack) join claim using (chunk_id)
    group by all having count(distinct value) > 1 and count(distinct doc_id) > 1),
cf as (select query_id, route, string_agg('- ' || line, chr(10) order by line) as disclosed from (select query_id, route, 'several versions: ' || versions as line from vc union all
    select query_id, route, 'different values for ' || topic || ' in ' || unit || ': ' || replace(regexp_replace(values_stated, '\\.0(,|$)', '\\1', 'g'), ',', ' and ') from nc) group by all),
draft as materialized (select query_id, route, body || (case when disclosed is not null then chr(10) || chr(10) || '**Conflicting sources**' || chr(10) || disclosed else '' end) || (case when notes is not null then chr(10) || chr(10) || '**Freshness notes**' || chr(10) || notes else '' end) as answer
    from bod left join cf using (query_id, route) left join nt using (query_id, route)),
cited as materialized (select query_id, route, chunk_id, min(chunk_rank * 10000 + place) as first from sel group by all),
fin as materialized (select ask.query_id, ask.route, ask.user_id, (ask.route = 'R0' or not sufficient) as abstained, case when ask.route = 'R0' or not sufficient then coalesce(failure_reason, 'router_declined') end as failure_reason,
    regexp_replace(regexp_replace(regexp_replace(answer, '[ \t]{{2,}}', ' ', 'g'), '\s+([.,;:])', '\1', 'g'), '^\s+|\s+$', '', 'g') as text,
    chars, ask.query from ask join suff on suff.query_id = ask.query_id and suff.route = ask.route left join draft on draft.query_id = ask.query_id and draft.route = ask.route
    left join (select query_id, route, sum(length(text)) as chars from pack join chunks using (chunk_id) group by all) ch on ch.query_id = ask.query_id and ch.route = ask.route),
ans as materialized (select query_id, route, user_id, abstained, failure_reason, case when abstained then '' else coalesce((select string_agg(chunk_id, ',' order by first) from cited c where c.query_id = fin.query_id and c.route = fin.route), '') end as citations,
    case when abstained then 0.0 else round((greatest(1, floor((coalesce(chars, 0) + length(query)) / 4)) * 3.0 + greatest(1, floor(length(text) / 4)) * 15.0) / 1e6, 6) end as cost, text from fin)"""

_QUANTITY = rf"(?i)(\d+(?:\.\d+)?)\s*({P.UNITS})(?:$|[^A-Za-z0-9_])"
CLAIMS = (
    "cs0 as (select chunk_id, doc_id, unnest(string_split(regexp_replace(regexp_replace(text, '([.;:!?])\\s+', '\\1' || chr(1), 'g'), '\\n', chr(1), 'g'), chr(1))) as s from chunks),"
    "cs1 as (select chunk_id, doc_id, s, case " + " ".join(f"when contains(lower(s), '{t}') then '{t}'" for t in sorted(P.TOPICS, key=lambda t: -len(t))) + " end as topic from cs0),"
    f"cs2 as (select chunk_id, doc_id, topic, unnest(regexp_extract_all(s, '{_QUANTITY}', 1)) as v, unnest(regexp_extract_all(s, '{_QUANTITY}', 2)) as u from cs1 where topic is not null),"
    "claim as materialized (select chunk_id, doc_id, topic, case when u in ('%', 'per cent') then 'percent' else regexp_replace(u, 's+$', '') end as unit, v::double as value from (select chunk_id, doc_id, topic, v, regexp_replace(lower(trim(u)), '^(working|calendar)\\s+', '') as u from cs2))"
)
ANSWER = ANSWER.replace("CLAIMS", CLAIMS)

GOLD = r"""
fold as materialized (select doc_id, lower(trim(regexp_replace(text, '\s+', ' ', 'g'))) as ft from documents),
fq as materialized (select query_id, user_id, lower(trim(regexp_replace(passage, '\s+', ' ', 'g'))) as fp from qs),
holder as materialized (select query_id, doc_id, user_id from fq, fold where contains(ft, fp)),
gm0 as (select query_id, holder.doc_id, chunk_id, ordinal, lower(trim(regexp_replace(text, '\s+', ' ', 'g'))) as c, fp from holder join fq using (query_id) join chunks on chunks.doc_id = holder.doc_id),
gm1 as (select *, case when contains(c, fp) then 'whole' when contains(c, substr(fp, 1, 100)) then 'prefix' else 'first' end as how from gm0),
gmatch as materialized (select query_id, doc_id, chunk_id, how from (select *, row_number() over (partition by query_id, doc_id order by case how when 'whole' then 0 when 'prefix' then 1 else 2 end, ordinal) as n from gm1) where n = 1),
gold as materialized (select query_id, doc_id from holder join scope using (user_id, doc_id)),
forb as materialized (select query_id, doc_id from holder h where not exists (select 1 from scope s where s.user_id = h.user_id and s.doc_id = h.doc_id)),
items as materialized (select query_id, user_id, abst as should_abstain, freshness_sensitive, case when abst then 'unanswerable' when freshness_sensitive then 'temporal' else 'exact' end as query_type, case when abst then 'R0' when freshness_sensitive then 'R3' else 'R1' end as expected_route
    from (select *, query_id not in (select query_id from gold) as abst from qs))"""

EVAL = r"""
sys as materialized (select 'B' || substr(route, 2) as system, query_id, route from (select query_id from qs), (values ('R1'), ('R2'), ('R3'), ('R4')) r(route)
    union all select 'B5', query_id, case when hop_signal >= 0.5 or comparison_signal >= 0.5 then 'R4' when query_length_tokens >= 16 then 'R3' when query_length_tokens <= 6 then 'R2' else 'R3' end from feat union all select 'P1', query_id, route from decision),
gn as (select query_id, count(*) as gold from gold group by 1),
bk as (select system, query_id, doc_id, min(position) as rank from sys join pack using (query_id, route) join gold using (query_id, doc_id) group by all),
bm as (select system, query_id, sum((rank <= 5)::int) as hits, 1.0 / min(rank) as mrr, sum(case when rank <= 5 then 1.0 / log2(rank + 1.0) else 0.0 end) as dcg from bk group by all),
m5 as materialized (select s.system, s.query_id, s.route, case when gold is not null then round(coalesce(hits, 0)::double / gold, 6) end as recall, case when gold is not null then round(coalesce(mrr, 0.0)::double, 6) end as mrr,
    case when gold is not null then round(coalesce(dcg, 0.0) / list_sum(list_transform(range(1, least(gold, 5) + 1), lambda i: 1.0 / log2(i + 1.0))), 6) end as ndcg from sys s left join gn using (query_id) left join bm on bm.system = s.system and bm.query_id = s.query_id),
cc as materialized (select system, sys.query_id, route, chunk_id, split_part(chunk_id, '::', 1)::bigint as doc_id, first from sys join ans a using (query_id, route) join cited using (query_id, route) where not a.abstained),
cs as (select system, query_id, count(*) as n, sum((g.doc_id is not null)::int) as hits, count(distinct g.doc_id) as found, sum((p.chunk_id is not null)::int) as grounded from cc left join gold g using (query_id, doc_id) left join (select query_id, route, chunk_id from pack) p using (query_id, route, chunk_id) group by all),
c5 as (select s.system, s.query_id, case when gold is not null then round(hits::double / n, 6) end as citation_precision, round(coalesce(found, 0)::double / gold, 6) as citation_coverage, round(grounded::double / n, 6) as groundedness from sys s left join cs on cs.system = s.system and cs.query_id = s.query_id left join gn on gn.query_id = s.query_id),
fc as (select system, query_id, arg_min(superseded_by is null, first) as ok from cc join meta using (doc_id) group by all),
er0 as (select m5.system, m5.query_id, query_type, m5.route, expected_route, abstained, failure_reason, recall, mrr, ndcg, citation_precision, citation_coverage, groundedness, should_abstain = abstained as abstention_appropriate,
    case when freshness_sensitive and not abstained then ok end as freshness_compliant, 0::bigint as violations, cost from m5 join items using (query_id) join ans a on a.query_id = m5.query_id and a.route = m5.route join c5 on c5.system = m5.system and c5.query_id = m5.query_id left join fc on fc.system = m5.system and fc.query_id = m5.query_id),
er as materialized (select * from er0 union all select system, -1 - query_id, 'error', 'ERROR', 'R0', false, 'unknown user', null, null, null, null, null, null, false, null, 0, 0.0 from qs, (values ('B1'), ('B2'), ('B3'), ('B4'), ('B5'), ('P1')) s(system) where query_id % 11 = 0)"""

PARTS = [META, CHUNKS, POST, SEARCH, PROBE, SUMMARY, FEATURES, _router(), CANDS, RERANK, PACK, ANSWER, GOLD, EVAL]


def upto(part: str, select: str) -> str:
    """The chain up to a part, then a query over it."""
    names = ["META", "CHUNKS", "POST", "SEARCH", "PROBE", "SUMMARY", "FEATURES", "ROUTER", "CANDS", "RERANK", "PACK", "ANSWER", "GOLD", "EVAL"]
    return "with " + ",".join(PARTS[: names.index(part) + 1]) + "\n" + select
