"""The queries in DuckDB's SQL, written from their definitions, to check the engine against.

RE2 has no lookaround: sentence ends consume the white space and put it back, and single-word
keywords are looked up among the words. Literals are doubles, in the engine's order of operands.
"""

from __future__ import annotations

from loomspark.config import FACETS, Curation
from loomspark.plans.queries import KEYWORDS, VOCAB

_C = Curation()
_S = r"[\s\x0B\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_W = r"[\p{L}\p{N}_]"


def _strip(t):
    return f"regexp_replace({t}, '^{_S}+|{_S}+$', '', 'g')"


def _clean(t):
    return _strip(f"regexp_replace(regexp_replace(regexp_replace({t}, '\\r\\n?', chr(10), 'g'), '[ \\t]+', ' ', 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g')")


def _tokens(t, empty=0):
    return f"case when {t} = '' then {empty} else cast(greatest(1, floor(length({t}) / 4.0::double)) as integer) end"


def _words(t):
    return f"regexp_extract_all(lower({t}), '{_W}+')"


def _full(parts):
    return f"list_filter(list_transform({parts}, lambda x: {_strip('x')}), lambda x: x <> '')"


def _round(x, n):
    return f"floor(({x}) * 1e{n}::double + 0.5::double) / 1e{n}::double"


def _ratio(a, b):
    return f"case when {b} = 0 then 0.0::double else ({a})::double / {b} end"


def _repeats(a):
    return _ratio(f"(len({a}) - len(list_distinct({a})))", f"len({a})")


def _hits(words, keywords=KEYWORDS):
    return f"len(list_filter([{', '.join(repr(k) for k in keywords)}], lambda k: list_contains({words}, k)))"


def _clamp(x):
    return f"greatest(0.0::double, least(1.0::double, {x}))"


def _length_score(t):
    lo, mid, hi = _C.min_tokens, _C.target_tokens, _C.max_tokens
    return f"case when {t} <= 0 then 0.0::double when {t} <= {mid} then {_clamp(f'({t} - {lo}) / {mid - lo}.0::double')} when {t} <= {hi} then {_clamp(f'({hi} - {t}) / {hi - mid}.0::double')} else 0.3::double end"


_STOP, _CLOSE = ".!?…", "\"''”’»)\\]"
_QUOTED = "[\"“«](?:[^\"”»\\n]{1,1000}[^\"”»\\n]{0,1000})[\"”»]"
_SUM = "coalesce(list_sum({}), 0)".format

_BASE = f"""
with a as (select doc_id, {_clean('text')} as t from documents where text is not null),
b as (select doc_id, t, {_words('t')} as w,
  {_full(f"string_split(regexp_replace(t, '([{_STOP}]+[{_CLOSE}]*)({_S})', '\\1' || chr(1) || '\\2', 'g'), chr(1))")} as s,
  {_full("string_split_regex(t, '\\n{2,}')")} as p,
  {_SUM(f"list_transform(regexp_extract_all(t, '{_QUOTED}'), lambda x: length(x))")}
  + {_SUM(f"list_transform(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '^{_S}*[—–\\-]{_S}+{_S.replace('[', '[^', 1)}')), lambda x: length(x))")} as d,
  {_tokens('t')} as tok from a),
c as (select *, len(w) as n, length(t) as chars, {_hits('w')} as k,
  list_transform(range(1, greatest(1, len(w) - 2)), lambda i: array_to_string(w[i:i + 3], ' ')) as grams,
  list_transform(s, lambda x: regexp_replace(lower(x), '{_S}+', ' ', 'g')) as low,
  least(1.0::double, {_ratio('d', 'length(t)')}) as dlg from b),
m as (select doc_id, chars as char_count, tok as token_est, len(p) as paragraph_count, len(s) as sentence_count, n as word_count, k as keyword_hits,
  {_round(_ratio('k', 'n'), 5)} as keyword_density, {_round(f'k::double / {len(KEYWORDS)}.0::double', 4)} as keyword_ratio,
  {_round(_ratio('n', 'len(s)'), 2)} as avg_sentence_length, {_round(_ratio('n', 'len(p)'), 2)} as avg_paragraph_length,
  {_round('dlg', 4)} as dialogue_ratio, {_round('greatest(0.0::double, 1.0::double - dlg)', 4)} as narration_ratio,
  {_round(_ratio("len(regexp_extract_all(t, '[.,;:!?…—–" + chr(34) + "''“”«»()\\-]'))", 'n'), 4)} as punctuation_density,
  len(list_distinct(w)) as unique_word_count, {_round(_ratio('len(list_distinct(w))', 'n'), 4)} as lexical_diversity,
  {_round(_repeats('grams'), 4)} as repeated_phrase_score, {_round(_repeats('low'), 4)} as repeated_sentence_score,
  {_round(_ratio(_SUM('list_transform(w, lambda x: length(x))'), 'n'), 3)} as avg_word_length,
  {_round(_ratio(f"len(list_filter(s, lambda x: regexp_matches(x, '[{_STOP}][{_CLOSE}]*$')))", 'len(s)'), 4)} as punctuation_consistency,
  1.0::double as whitespace_quality,
  len(list_filter(p, lambda x: length(x) > 1500 and not regexp_matches(x, '[{_STOP}]'))) as malformed_paragraphs,
  {_round(f'least(1.0::double, greatest(0, tok - {_C.max_tokens})::double / {_C.max_tokens})', 4)} as truncation_risk,
  {_round(f'least(1.0::double, tok::double / {_C.target_tokens})', 4)} as context_utilization,
  cast(greatest(1, ceil(tok / {_C.target_tokens}.0::double)) as integer) as recommended_split_count from c),
f as (select doc_id, token_est, keyword_hits, char_count,
  {_clamp('keyword_hits / 4.0::double')} as kw, {_length_score('token_est')} as le, {_clamp('lexical_diversity')} as lx,
  {_clamp('1.0::double - abs(dialogue_ratio - 0.35::double) / 0.65::double')} as di,
  case when paragraph_count <= 1 then 0.3::double else {_clamp(_clamp('1.0::double - abs(avg_paragraph_length * 1.3::double - 60.0::double) / 60.0::double') + ' * case when malformed_paragraphs > 0 then 0.5::double else 1.0::double end + 0.1::double')} end as pa,
  {_clamp('0.5::double * punctuation_consistency + 0.5::double * whitespace_quality')} as pu,
  1.0::double - {_clamp('0.6::double * repeated_phrase_score + 0.4::double * repeated_sentence_score')} as re from m),
g as (select *, {_round(f'(0.3::double * kw + 0.25::double * le + 0.15::double * lx + 0.1::double * di + 0.1::double * pa + 0.05::double * pu + 0.05::double * re) / {sum(_C.weights.values())!r}::double', 5)} as score from f)
"""
_METRICS = "char_count token_est paragraph_count sentence_count word_count keyword_hits keyword_density keyword_ratio avg_sentence_length avg_paragraph_length dialogue_ratio narration_ratio punctuation_density unique_word_count lexical_diversity repeated_phrase_score repeated_sentence_score avg_word_length punctuation_consistency whitespace_quality malformed_paragraphs truncation_risk context_utilization recommended_split_count"
_PARTS = {"keyword": "kw", "length": "le", "lexical": "lx", "dialogue": "di", "paragraph": "pa", "punctuation": "pu", "repetition": "re"}


def _split(key, frm, seed=_C.seed):
    return f"select *, case when row_number() over (order by md5('{seed}' || {key}::varchar)) <= greatest(1, floor(count(*) over () * {_C.val_frac}::double)) then 'val' else 'train' end as split from {frm}"


_PROFILE = f"""
with s as (select conv_id::varchar as scene_id, count(*) as n_segments, {_clean("string_agg(text, chr(10) || chr(10) order by turn)")} as t
  from conversations where text is not null and text <> '' group by conv_id),
p as (select scene_id, n_segments, {_tokens('t', 1)} as tokens, {_hits(_words('t'))} >= 1 as passed from s where t <> ''),
q as (select *, cast(least(n_segments, 6) as integer) as bucket from p)
"""


def _bins(v, edges):
    return "case " + " ".join(f"when {v} >= {a} and {v} < {b} then {i}" for i, (a, b) in enumerate(zip(edges, edges[1:]))) + " end"


_TAGS = f"""
with d as (select doc_id::varchar as scene_id, doc_id, {_words('text')} as w from documents where text is not null),
t as (select scene_id, doc_id, unnest([{', '.join(repr(f) for f in FACETS)}]) as facet,
  unnest([{', '.join('list_filter([' + ', '.join(repr(v) for v in VOCAB[f]) + '], lambda v: list_contains(w, v))' for f in FACETS)}]) as labels from d),
l as (select scene_id, facet, unnest(labels) as label from t)
"""
_COUNTS = "select facet, label, count(distinct scene_id) as n from l group by 1, 2"

SQL = {
    "scene_assembly": "select conv_id::varchar as scene_id, string_agg(text, chr(10) || chr(10) order by turn) as text from conversations where text is not null and text <> '' group by conv_id",
    "row_scenes": "select doc_id::varchar as scene_id, text from documents where text <> ''",
    "scene_count": "select count(distinct conv_id) as scenes from conversations where text is not null",
    "segment_count_distribution": "select n_segments, count(*) as scenes from (select count(*) as n_segments from conversations where text is not null group by conv_id) group by 1",
    "candidate_scenes": "select conv_id::varchar as scene_id, md5('42' || conv_id::varchar) as draw from conversations where text is not null group by conv_id having count(*) between 3 and 6",
    "seam_offsets": f"""
with s as (select conv_id::varchar as scene_id, turn, length({_clean('text')}) as n from conversations where text is not null and {_strip('text')} <> ''),
o as (select scene_id, row_number() over w - 1 as i, sum(n + 2) over (partition by scene_id order by turn rows between unbounded preceding and 1 preceding) as o from s window w as (partition by scene_id order by turn))
select scene_id, cast(i - 1 as integer) as seam, cast(o as integer) as seam_offset from o where i > 0""",
    "clean_text": f"select doc_id, {_clean('text')} as text from documents",
    "token_estimate": f"select doc_id, {_tokens('t')} as tokens from (select doc_id, {_clean('text')} as t from documents)",
    "text_metrics": f"{_BASE} select doc_id, {', '.join(_METRICS.split())} from m",
    "scene_score": f"{_BASE} select doc_id, score, {', '.join(f'{_round(v, 4)} as c_{k}' for k, v in _PARTS.items())} from g",
    "analysis_summary": f"{_BASE} select count(*) as n, avg(token_est) as token_mean, max(token_est) as token_max, avg(score) as score_mean, max(score) as score_max, floor(median(token_est))::bigint as token_median, median(score) as score_median, avg(keyword_hits) as keyword_mean, max(keyword_hits) as keyword_max, count(*) filter (token_est > {_C.max_tokens}) as over_max from g",
    "length_score": f"select doc_id, {_length_score('tok')} as length_score from (select doc_id, {_tokens('t')} as tok from (select doc_id, {_clean('text')} as t from documents))",
    "keyword_hits": f"select doc_id, {_hits(_words('text'))} as hits from documents",
    "keyword_filter": f"select doc_id from documents where {_hits(_words('text'))} >= {_C.min_keyword_hits}",
    "length_gate": f"{_BASE} select doc_id::varchar as scene_id, token_est as estimated_tokens, score as original_score, {_round(f'0.7::double * score + 0.3::double * le', 5)} as score from g where char_count > 0 and token_est between {_C.min_tokens} and {_C.max_tokens}",
    "exact_dedup": "select min(doc_id) as doc_id from documents group by md5(text)",
    "train_val_split": _split("doc_id", "(select doc_id from documents)"),
    "bucket_sample": f"{_PROFILE} select bucket, scene_id from (select *, row_number() over (partition by bucket order by md5('42' || scene_id)) as r from q) where r <= 5",
    "profile_crosstab": f"{_PROFILE} select bucket, count(*) filter (passed) as n_pass, count(*) filter (not passed) as n_fail, count(*) as n_all from q group by bucket",
    "segment_coverage": f"""{_PROFILE}, u as (select bucket, count(*) as scenes, sum(tokens)::bigint as tokens, list_sort(list(tokens)) as v from q where passed group by bucket)
select bucket, scenes, tokens, (v[(scenes - 1) // 2 + 1] + v[scenes // 2 + 1]) // 2 as median_tokens, v[least(scenes - 1, floor(0.9::double * scenes))::bigint + 1] as p90_tokens,
  sum(scenes) over (order by bucket)::double / sum(scenes) over () as cum_scenes, sum(tokens) over (order by bucket)::double / sum(tokens) over () as cum_tokens from u""",
    "token_histogram": f"{_PROFILE} select {_bins('tokens', (0, 400, 800, 1200, 1600, 2000, 3000, 10**9))} as bin, count(*) filter (n_segments = 1) as single, count(*) filter (n_segments > 1) as multi from q where passed group by 1",
    "corpus_stats": f"""
with s as ({_split('doc_id', '(select doc_id, text from documents where text is not null)')}),
q as (select split, {_tokens('text')} as tok, {_hits(_words('text'))} as hits, md5(text) as h from s),
r as (select count(*) as n, count(*) filter (split = 'val') as n_val, floor(sum(tok) / count(*)::double)::bigint as token_mean, min(tok) as token_min, max(tok) as token_max,
  count(*) filter (tok > {_C.max_tokens}) as n_over, count(*) - count(distinct h) as n_duplicate, count(*) filter (hits = 0) as n_zero_keyword, sum(hits) / count(*)::double as mean_hits, floor(median(tok))::bigint as token_median from q)
select *, concat_ws(',', case when n < 50 then 'few' end, case when n_over / n::double > 0.05 then 'over_max' end, case when n_duplicate / n::double > 0.02 then 'duplicates' end,
  case when n_zero_keyword / n::double > 0.20 then 'zero_keyword' end, case when n_val = 0 then 'no_val' end) as flags from r""",
    "corpus_ttr": f"with w as (select unnest({_words('text')}) as w from documents) select count(distinct w) as distinct_words, count(*) as total_words, count(distinct w)::double / count(*) as ttr from w",
    "length_histogram": f"select {_bins('tok', (0, _C.min_tokens, _C.target_tokens // 2, _C.target_tokens, _C.max_tokens, 2 * _C.max_tokens, 10**9))} as bin, count(*) as n from (select {_tokens('text')} as tok from documents where text is not null) group by 1",
    "length_percentiles": f"""
with u as (select list_sort(list(tok)) as v, count(*) as n, sum(tok)::bigint as total from (select {_tokens('text')} as tok from documents where text is not null))
select n as examples, total as tokens_total, v[1] as tokens_min, v[n] as tokens_max, {_round('total / n::double', 1)} as tokens_mean, (v[(n - 1) // 2 + 1] + v[n // 2 + 1]) // 2 as tokens_median,
  v[least(n - 1, floor(0.95::double * n))::bigint + 1] as tokens_p95, v[least(n - 1, floor(0.99::double * n))::bigint + 1] as tokens_p99 from u""",
    "vocab_candidates": f"{_TAGS} select * from ({_COUNTS}) where length(label) >= 2",
    "label_topk": f"{_TAGS} select facet, label, n, cast(r as integer) as rank from (select *, row_number() over (partition by facet order by n desc, label) as r from ({_COUNTS})) where r <= 1",
    "label_use": f"{_TAGS} select facet || ':' || lower(label) as name, count(*) as n from l group by 1",
    "facet_coverage": f"{_TAGS} select facet, count(*) filter (len(labels) > 0) as scenes, count(*) filter (len(labels) > 0)::double / count(*) as share from t group by facet",
    "closed_tag_whitelist": f"""
with w as (select doc_id, unnest(string_split(text, ' ')) as w, generate_subscripts(string_split(text, ' '), 1) as i from documents where text is not null),
k as (select doc_id, lower({_strip('w')}) as l, arg_min(w, i) as w, min(i) as i from w where lower({_strip('w')}) in ('the', 'and') group by 1, 2)
select doc_id, coalesce(string_agg(w, '|' order by k.i), '') as labels from documents left join k using (doc_id) where text is not null group by doc_id""",
    "resume_todo": "select doc_id as scene_id from documents where doc_id not in (select doc_id from labels where doc_id is not null)",
    "tagged_corpus": f"""{_TAGS}, s as ({_split('doc_id', '(select doc_id, text from documents where text is not null)')}),
p as (select doc_id, string_agg(upper(facet[1]) || facet[2:] || ': ' || array_to_string(labels, ', '), chr(10) order by list_position([{', '.join(repr(f) for f in FACETS)}], facet)) as body
  from t where len(labels) > 0 and doc_id % 3 <> 0 group by doc_id)
select s.doc_id::varchar as scene_id, split, case when body is null then 'Write a scene.' else 'Write a scene with the following elements.' || chr(10) || body end as prompt, md5(text) as completion_md5 from s left join p using (doc_id)""",
    "entity_grounding": "select doc_id, concat_ws('|', case when not contains(lower(text), 'the') then ' ''The''' end, case when not contains(lower(text), 'thble') then 'Thble' end, case when not contains(lower(text), 'nowhere') then 'nowhere' end) as unfound from documents where text is not null",
    "chat_examples": """
with c as (select conv_id, max(turn) as last, count(*) as n from conversations group by conv_id)
select conv_id, md5(coalesce(string_agg(text, chr(10) order by turn) filter (turn < last and role <> 'assistant'), '')) as prompt_md5, md5(max(text) filter (turn = last)) as target_md5
from conversations join c using (conv_id) where n >= 2 group by conv_id""",
    "mask_labels": f"""
with d as (select doc_id, {_strip('text[1:40]')} as i, {_strip('text')} as o from documents where text is not null),
h as (select doc_id, '### Запрос:' || chr(10) || i || chr(10) || chr(10) || '### Ответ:' || chr(10) as head, o from d where i <> '' and o <> ''),
n as (select doc_id, len(list_filter(string_split_regex(head, '{_S}+'), lambda x: x <> '')) as masked, len(list_filter(string_split_regex(head || o, '{_S}+'), lambda x: x <> '')) + 1 as length from h)
select doc_id, length, masked from n where length <= 2048""",
    "curate_whole": f"""{_BASE}, h as (select g.doc_id, a.t, token_est as estimated_tokens, {_round('0.7::double * score + 0.3::double * le', 5)} as score from g join a using (doc_id)
  where keyword_hits >= 1 and token_est between {_C.min_tokens} and {_C.max_tokens}),
i as (select arg_min(doc_id, doc_id)::varchar as scene_id, arg_min(estimated_tokens, doc_id) as estimated_tokens, arg_min(score, doc_id) as score from h group by md5(t))
{_split('scene_id', 'i')}""",
}


_I = """with d as (select doc_id, case when doc_id % 10 <> 0 then 'Write no. ' || doc_id end as i, """ + f"{_strip('case when doc_id % 15 = 0 then chr(32) || chr(120) || chr(32) else text end')} as o from documents where text is not null),\n"
_CUT = _I + f"""h as (select doc_id, '### Запрос:' || chr(10) || i || chr(10) || chr(10) || '### Ответ:' || chr(10) || o as t from d where i is not null and o <> ''),
n as (select doc_id, len(list_filter(string_split_regex(t, '{_S}+'), lambda x: x <> '')) + 1 as n from h)
"""
_PILOT = "doc_id % 5 <> 0 and doc_id % 7 <> 0"
_KEYS = "['genre', 'tone', 'setting', 'pov', 'pacing', 'content_elements', 'places', 'invented_terms', 'coherence_score', 'coherence_notes', 'broken_junctions']"

SQL |= {
    "fetch_segments": "select conv_id, turn from conversations where conv_id in (select doc_id from labels)",
    "marked_scenes": f"""
with s as (select conv_id::varchar as scene_id, {_clean('text')} as t, row_number() over (partition by conv_id order by turn) as i from conversations where {_strip('text')} <> '')
select scene_id, string_agg(case when i = 1 then t else chr(10) || chr(10) || '⟦J' || (i - 1) || '⟦' || chr(10) || chr(10) || t end, '' order by i) as marked from s group by scene_id""",
    "latest_tags": "select conv_id::varchar as scene_id, arg_max(role, turn) as tone, arg_max(text, turn) as overflow from conversations where length(text) % 3 <> 0 group by conv_id",
    "slugs": "select doc_id, lower(regexp_replace(regexp_replace(concat_ws(' / ', '- Run', source, lang || '!'), '[^a-zA-Z0-9._-]+', '-', 'g'), '^-+|-+$', '', 'g')) as slug from documents",
    "version_order": "select doc_id, concat_ws(',', doc_id % 7, ((doc_id % 13)::varchar || (doc_id % 3)::varchar)::integer, 0) as parts from documents",
    "durations": "select doc_id, case when s >= 3600 then printf('%dh%02dm', s // 3600, s % 3600 // 60) when s >= 60 then printf('%dm%02ds', s // 60, s % 60) else printf('%ds', s) end as duration from (select doc_id, doc_id * 37 as s from documents)",
    "bucket_shares": f"{_PROFILE} select bucket, printf('%.1f%%', 100.0::double * count(*) filter (passed) / count(*)) as share from q group by bucket",
    "pass_counts": f"{_PROFILE} select count(*) filter (passed) as n_pass, count(*) filter (not passed) as n_fail, printf('%.1f%%', 100.0::double * count(*) filter (passed) / count(*)) as pass_share, printf('%.1f%%', 100.0::double * count(*) filter (not passed) / count(*)) as fail_share from q",
    "boundary_hits": f"select doc_id, {_hits(_words('text'))} as hits from documents",
    "keyword_analysis": f"""
with d as (select doc_id, {_words('text')} as w from documents where text is not null),
h as (select doc_id, len(w) as n, list_sort(list_filter([{', '.join(repr(k) for k in KEYWORDS)}], lambda k: list_contains(w, k))) as m from d)
select doc_id, len(m) as hits, {_round(_ratio('len(m)', 'n'), 5)} as density, {_round(f'len(m)::double / {len(KEYWORDS)}.0::double', 4)} as ratio, array_to_string(m, '|') as matched from h""",
    "given_scores": f"""{_BASE}, y as (select doc_id, max(quality)::double as y from labels group by doc_id), e as (select g.*, coalesce(y, score) as base from g left join y using (doc_id))
select doc_id::varchar as scene_id, base as original_score, {_round('0.7::double * base + 0.3::double * le', 5)} as score from e where char_count > 0 and token_est between {_C.min_tokens} and {_C.max_tokens}""",
    "projected_cost": f"""{_PROFILE}, c as (select bucket, count(*) as scenes from q where passed group by bucket)
select bucket, scenes, sum(scenes) over (order by bucket)::bigint as cum_scenes, sum(scenes * bucket / 4.0::double) over (order by bucket) as cum_seconds from c""",
    "top_scores": f"{_BASE} select doc_id, score from g order by score desc, doc_id limit 50",
    "manifest_scenes": "select doc_id as scene_id from documents where doc_id in (select doc_id from labels)",
    "missing_keys": f"select doc_id, array_to_string(list_sort(list_filter({_KEYS}, lambda k: not (k = 'genre' or (k = 'tone' and doc_id % 2 = 0) or (k = 'places' and doc_id % 3 = 0)))), '|') as missing from documents",
    "seeded_sample": "select doc_id from documents order by md5('42' || doc_id::varchar) limit 25",
    "sample_rejects": f"""
with d as (select {_hits(_words('text'))} >= 1 as ok, md5('42' || doc_id::varchar) as h from documents where text is not null),
r as (select *, sum(ok::int) over (order by h) as n from d)
select count(*) filter (ok) as passed, count(*) filter (not ok) as rejected from r where n < 20 or (n = 20 and ok)""",
    "control_pairs": f"""
with s as (select text, row_number() over (order by md5('43' || doc_id::varchar)) - 1 as i from documents where text is not null qualify i < 20),
p as (select a.i // 2 as pair, a.text as a, b.text as b from s a join s b on b.i = a.i + 1 where a.i % 2 = 0)
select pair, md5(case when {_tokens("a || chr(10) || chr(10) || '⟦J1⟦' || chr(10) || chr(10) || b", 1)} > 3600 then a[1:7200] || chr(10) || chr(10) || '⟦J1⟦' || chr(10) || chr(10) || b[1:7200]
  else a || chr(10) || chr(10) || '⟦J1⟦' || chr(10) || chr(10) || b end) as text_md5 from p""",
    "pilot_summary": f"""
with r as (select doc_id, case when doc_id % 9 <> 0 then doc_id % 8 end as c from documents)
select count(*) filter ({_PILOT}) as parsed, {', '.join(f'count(*) filter ({_PILOT} and c = {k}) as score_{k}' for k in (5, 4, 3, 2, 1))}, count(*) filter ({_PILOT} and (c is null or c not between 1 and 5)) as score_other,
  count(*) filter ({_PILOT} and c between 1 and 2) as low, count(*) filter ({_PILOT} and doc_id % 3 >= 1) as with_seams, count(*) filter ({_PILOT} and doc_id % 3 >= 1 and doc_id % 11 = 0) as broken,
  sum(case when {_PILOT} then (doc_id % 2 = 0)::int + (doc_id % 3 = 0)::int else 0 end)::bigint as entities, sum(case when {_PILOT} then (doc_id % 4 = 0)::int else 0 end)::bigint as unfound,
  count(*) filter (doc_id % 7 = 0) as controls, count(*) filter (doc_id % 7 = 0 and (doc_id % 11 = 0 or coalesce(c <= 3, false))) as caught, count(*) filter ({_PILOT} and doc_id % 13 = 0) as with_missing_keys from r""",
    "overflow_use": "select lower(label) as label, count(*) as n from (select unnest([lang, upper(source)]) as label from documents) group by 1",
    "overflow_top": "select label, n, cast(row_number() over (order by n desc, label) as integer) as rank from (select lower(label) as label, count(*) as n from (select unnest([lang, upper(source)]) as label from documents) group by 1) order by n desc, label limit 15",
    "label_top": f"{_TAGS} select name, n, cast(row_number() over (order by n desc, name) as integer) as rank from (select facet || ':' || lower(label) as name, count(*) as n from l group by 1) order by n desc, name limit 20",
    "manifest_label_use": f"{_TAGS} select facet || ':' || lower(label) as name, count(*) as n from l where scene_id::bigint % 3 <> 0 group by 1",
    "scalar_facets": "select doc_id, coalesce(lang, '') as lang, concat_ws('|', source, lang) as setting, true as no_score from documents",
    "validation_counts": _I + "j as (select case when i is null or o = '' then 'invalid' when length(o) >= 5 then 'ok' else 'short' end as s from d)\nselect count(*) as total, count(*) filter (s = 'ok') as kept, count(*) filter (s = 'invalid') as invalid, count(*) filter (s = 'short') as short from j",
    "truncated_rows": _CUT + "select doc_id, cast(least(n, 256) as integer) as length, n > 256 as truncated, cast(least(n, 256) as integer) as n_labels from n",
    "padded_batches": _CUT + "select doc_id, cast(ceil(max(least(n, 256)) over (partition by doc_id % 50) / 8.0::double) * 8 as integer) as width, cast(ceil(max(least(n, 256)) over (partition by doc_id % 50) / 8.0::double) * 8 as integer) as n_labels, cast(least(n, 256) as integer) as used from n",
}

def oracle_sql() -> dict[str, str]:
    return dict(SQL)
