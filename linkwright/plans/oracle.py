"""The registered queries in plain SQL, for an engine that is held against Spark.

Every entry is one statement over the base tables: the fixture relations and
the steps up to the one asked for are common table expressions.
"""

from __future__ import annotations

import unicodedata

from ..functions import lexicon as lex
from ..operators import decide, extra, metrics
from ..sources import fixtures
from . import queries as q


def _case(x: str, table: dict[str, str]) -> str:
    return f"case {x} " + " ".join(f"when '{a}' then '{b}'" for a, b in table.items()) + f" else {x} end"


def _split(x: str) -> str:
    return f"list_filter(string_split({x}, ' '), lambda t: t <> '')"


_BLANK = r"[\s\p{Z}\x1c-\x1f\x{85}]"
#: What accent stripping leaves whole in the SQL engine: the characters of the fixture that decompose into several.
_SPREAD = {c: unicodedata.normalize("NFKD", c) for c in "ﬁﬂ½한국"}


def _stripped(x: str) -> str:
    return f"regexp_replace({x}, '^{_BLANK}+|{_BLANK}+$', '', 'g')"


def _clean(x: str) -> str:
    none = ", ".join(f"'{t}'" for t in lex.NO_VALUE)
    plain = f"strip_accents({x})"
    for c, d in _SPREAD.items():
        plain = f"replace({plain}, '{c}', '{d}')"
    text = f"replace(lower({plain}), '&', ' and ')"
    text = rf"trim(regexp_replace(regexp_replace({text}, '[^\p{{L}}\p{{N}}_\s&]', ' ', 'g'), '{_BLANK}+', ' ', 'g'))"
    return f"case when {x} is null or lower({_stripped(x)}) in ({none}) then '' else {text} end"


def _sound(word: str) -> str:
    coded = "".join(lex.SOUND_CLASSES.values())
    digits = "".join(d * len(c) for d, c in lex.SOUND_CLASSES.items())
    silent = "".join(c for c in "abcdefghijklmnopqrstuvwxyz" if c not in coded)
    w = f"regexp_replace(lower({word}), '[^a-z]', '', 'g')"
    runs = f"translate({w}, '{coded + silent}', '{digits}')"
    for d in lex.SOUND_CLASSES:
        runs = f"regexp_replace({runs}, '{d}+', '{d}', 'g')"
    rest = f"case when regexp_matches(substr({w}, 1, 1), '[{coded}]') then substr({runs}, 2) else {runs} end"
    return f"case when {w} = '' then '' else substr(substr({w}, 1, 1) || {rest}, 1, 5) end"


def _postcode(x: str) -> str:
    runs = rf"regexp_extract_all({x}, '\d+')"
    most = f"list_max(list_transform({runs}, lambda r: length(r)))"
    return f"case when len({runs}) = 0 then '' when {most} >= 4 then list_filter({runs}, lambda r: length(r) = {most})[1] else {runs}[-1] end"


def _sorted(x: str) -> str:
    return f"array_to_string(list_sort({_split(x)}), ' ')"


def _jaccard(a: str, b: str) -> str:
    x, y = f"list_distinct({_split(a)})", f"list_distinct({_split(b)})"
    both, any_ = f"len(list_intersect({x}, {y}))", f"len(list_distinct(list_concat({x}, {y})))"
    return f"case when {any_} = 0 then 1.0::double else {both}::double / {any_} end"


def _ratio(table: str, a: str, b: str) -> str:
    """Indel ratio (0 to 100) of sorted texts a and b, whose letter masks are in the relation `table` as ma and mb.

    The longest common subsequence by bit-parallel updates of a 128-bit state,
    one per character of the second text, as a fold over its characters.
    """
    full = f"((1::hugeint << length({a})::int) - 1)"
    step = f"lambda s, c: ((s + (s & coalesce(ma[chr(c::int)], 0::hugeint))) | (s - (s & coalesce(ma[chr(c::int)], 0::hugeint)))) & {full}"
    codes = f"list_transform(range(1, length({b}) + 1), lambda i: ord(substr({b}, i::int, 1))::hugeint)"
    lcs = f"(length({a}) - bit_count(list_reduce({codes}, {step}, {full})))"
    total = f"(length({a}) + length({b}))"
    return f"case when {total} = 0 then 100.0::double when length({a}) = 0 or length({b}) = 0 then 0.0::double else 200.0::double * {lcs} / {total} end"


def _masks(relation: str, column: str) -> str:
    """Each distinct text of a column with a map from its letters to the bits of their places."""
    letters = f"list_distinct(string_split({column}, ''))"
    places = f"list_transform(list_filter(range(1, length({column}) + 1), lambda i: substr({column}, i::int, 1) = c), lambda i: (1::hugeint << (i - 1)::int))"
    mask = f"list_reduce({places}, lambda x, y: x | y)"
    return f"select {column} as t, case when {column} = '' then map([''], [0::hugeint]) else map({letters}, list_transform({letters}, lambda c: {mask})) end as m from (select distinct {column} from {relation})"


_ADDRESS = f"array_to_string(list_filter(list_transform({_split('a_text')}, lambda t: {_case('t', lex.ADDRESS_WORDS)}), lambda t: t not in ({', '.join(repr(w) for w in lex.ADDRESS_STOPWORDS)})), ' ')"
_NAME = f"array_to_string(list_transform({_split('n_text')}, lambda t: {_case('t', lex.NAME_WORDS)}), ' ')"

STEPS: dict[str, str] = {k: v for k, v in fixtures.CTES.items()}
STEPS["records"] = "select 'S1' as source, * from fx_source1 union all select 'S2', * from fx_source2 union all select 'S3', * from fx_source3"
STEPS["cleaned"] = f"select *, {_clean('business_name')} as n_text, {_clean('business_address')} as a_text, {_clean('country')} as c_text, lower({_stripped('country')}) as plain from records"
STEPS["normal"] = f"select *, {_NAME} as name, {_ADDRESS} as addr, {_case('c_text', lex.COUNTRIES)} as land from cleaned"
STEPS["prepared"] = rf"""
select *, case land when '' then '{lex.UNKNOWN_COUNTRY}' else land end as area, regexp_extract(a_text, '\d+') as house, {_postcode('a_text')} as post,
  replace(name, ' ', '') as packed, {_sound("split_part(name, ' ', 1)")} as sound, array_to_string(list_sort(regexp_extract_all(addr, '\d+')), '') as digits from normal"""
STEPS["all_keys"] = """
select source, entity_id, unnest([0, 1, 2, 3, 4])::bigint as key_type,
  unnest([area || '|' || substr(packed, 1, 4), area || '|' || digits, area || '|' || post, area || '|' || house || '|' || substr(packed, 1, 2), area || '|' || sound]) as key from prepared"""
STEPS["keys"] = "select * from all_keys where key <> '' and not ends_with(key, '|')"
STEPS["sizes"] = "select source, key_type, key, count(*) as records from keys where source <> 'S1' group by all"
STEPS["shared"] = "select a.entity_id as source1_entity_id, b.entity_id as other_id, b.source, b.key_type from keys a join keys b on a.key_type = b.key_type and a.key = b.key and a.source = 'S1' and b.source <> 'S1'"
STEPS["pairs"] = "select distinct source1_entity_id, other_id, source from shared"
STEPS["sorted_texts"] = f"select entity_id, source, name, addr, plain, {_sorted('name')} as sname, {_sorted('addr')} as saddr from prepared"
STEPS["name_masks"] = _masks("sorted_texts", "sname")
STEPS["addr_masks"] = _masks("sorted_texts", "saddr")
STEPS["name_pairs"] = "select distinct a.sname as x, b.sname as y from pairs p join sorted_texts a on a.entity_id = p.source1_entity_id join sorted_texts b on b.entity_id = p.other_id"
STEPS["name_ratios"] = f"select x, y, {_ratio('', 'x', 'y')} as ratio from (select x, y, m as ma from name_pairs join name_masks on t = x)"
STEPS["rated"] = """
select p.*, n.ratio / 100 as name_cosine_sim from pairs p join sorted_texts a on a.entity_id = p.source1_entity_id join sorted_texts b on b.entity_id = p.other_id
  join name_ratios n on n.x = a.sname and n.y = b.sname where n.ratio >= 55"""
STEPS["ranked"] = "select *, row_number() over (partition by source1_entity_id, source order by name_cosine_sim desc, other_id) as rank from rated"
STEPS["candidates"] = "select source1_entity_id, other_id, source, name_cosine_sim from ranked where rank <= 10"
STEPS["fielded"] = """
select c.*, a.name as name_a, a.addr as addr_a, a.plain as country_a, b.name as name_b, b.addr as addr_b, b.plain as country_b, a.saddr as xa, b.saddr as xb
from candidates c join sorted_texts a on a.entity_id = c.source1_entity_id join sorted_texts b on b.entity_id = c.other_id"""
STEPS["addr_pairs"] = "select distinct xa as x, xb as y from fielded"
STEPS["addr_ratios"] = f"select x, y, {_ratio('', 'x', 'y')} as ratio from (select x, y, m as ma from addr_pairs join addr_masks on t = x)"
STEPS["featured"] = f"""
select f.*, r.ratio / 100 as addr_ratio, {_jaccard('name_a', 'name_b')} as name_jaccard, {_jaccard('addr_a', 'addr_b')} as addr_jaccard
from fielded f join addr_ratios r on r.x = f.xa and r.y = f.xb"""
STEPS["scored"] = "select source1_entity_id, other_id, source, round((name_cosine_sim + name_jaccard + addr_ratio + addr_jaccard) / 4, 6) as score from featured"
STEPS["truth"] = "select distinct source1_entity_id, trim(x) as other_id from (select source1_entity_id, unnest(string_split(matched_entity_ids, ',')) as x from fx_ground_truth) where trim(x) <> ''"
STEPS["ids"] = "select entity_id as source1_entity_id from fx_source1"
STEPS["labelled"] = "select c.*, (t.other_id is not null)::bigint as label from candidates c left join truth t using (source1_entity_id, other_id)"
STEPS["accepted"] = "select * from scored where score >= 0.6"

_F05 = "case when n_pred = 0 and n_true = 0 then 1.0::double when n_pred = 0 or n_true = 0 then 0.0::double else 1.25::double * tp / (n_pred + 0.25::double * n_true) end"


def _counts(predicted: str, ids: str = "ids", more: str = "") -> str:
    """Counts per entity for pairs in `predicted`; more: further keys that both it and ids have."""
    keys = "source1_entity_id" + (f", {more}" if more else "")
    return f"""
    select i.{keys.replace(', ', ', i.')}, coalesce(p.n_pred, 0) as n_pred, coalesce(p.tp, 0) as tp, coalesce(t.n_true, 0) as n_true from {ids} i
      left join (select {', '.join('d.' + k.strip() for k in keys.split(','))}, count(*) as n_pred, count(t.other_id) as tp from (select distinct {keys}, other_id from {predicted}) d
        left join truth t on t.source1_entity_id = d.source1_entity_id and t.other_id = d.other_id group by all) p using ({keys})
      left join (select source1_entity_id, count(*) as n_true from truth group by all) t on t.source1_entity_id = i.source1_entity_id"""


_REPORT = "round(avg(f05), 9) as macro_f05, count(*) as n_s1, round(avg(case when n_true = 0 then (n_pred = 0)::int::double end), 9) as singleton_accuracy, count(*) filter (n_true = 0) as n_singletons"


def _expected(relation: str, lam: str, by: str = "source1_entity_id") -> str:
    return f"""
    select * from (select *, min(case when value = top then rank end) over w as first_top from (select *, max(value) over w as top from (
      select *, round(1.25::double * run / (rank + 0.25::double * (total + {lam})), 12) as value, round(exp(none - {lam}), 12) as zero from (
        select *, row_number() over o as rank, sum(p) over (o rows unbounded preceding) as run, sum(p) over w as total, sum(ln(1 - p)) over w as none
        from (select *, least(greatest(score, {decide.EPSILON}), 1 - {decide.EPSILON}) as p from {relation})
        window w as (partition by {by}), o as (partition by {by} order by score desc, other_id)))
      window w as (partition by {by})) window w as (partition by {by}))
    where top > zero and rank <= first_top"""


def _single(relation: str) -> str:
    return f"select * exclude (o_rank) from (select *, row_number() over (partition by other_id order by score desc, source1_entity_id) as o_rank from {relation}) where o_rank = 1"


def _policy() -> str:
    w = q.fixed_weights()
    out = repr(w["b2"])
    for k, weight in enumerate(w["w2"]):
        z = f"{w['b1'][k]!r}::double" + "".join(f" + ({w['w1'][i][k]!r}::double) * {name}" for i, name in enumerate(decide.STATE))
        out += f" + ({weight!r}::double) * greatest({z}, 0.0::double)"
    return f"round({out}, 9)"


_S = float(decide.MAX_STEPS)
STEPS["states"] = f"""
select source1_entity_id, other_id, source, score, rank, score as p, (rank - 1) / {_S}::double as step, round((run - score) / greatest(rank - 1, 1), 12) as mean_before,
  round(total - (run - score), 12) as mass_left, top - score as below_top, score - following as gap, n / {_S}::double as n from (
  select *, row_number() over o as rank, sum(score) over (o rows unbounded preceding) as run, sum(score) over w as total, count(*) over w as n, max(score) over w as top,
    coalesce(lead(score) over o, 0.0::double) as following from scored
  window w as (partition by source1_entity_id), o as (partition by source1_entity_id order by score desc, other_id))"""
STEPS["lists"] = "select i.source1_entity_id, coalesce(x.ids, []) as ids from ids i left join (select source1_entity_id, list(other_id order by score desc, other_id) as ids from scored group by all) x using (source1_entity_id)"
STEPS["match_lists"] = "select i.source1_entity_id, coalesce(x.ids, []) as ids from ids i left join (select source1_entity_id, list(other_id order by score desc, other_id) as ids from accepted group by all) x using (source1_entity_id)"
STEPS["bad_candidates"] = "select source1_entity_id, case when right(source1_entity_id, 1) = '6' then list_concat(ids, ids[1:1]) else ids end as ids from lists where right(source1_entity_id, 1) <> '7'"
STEPS["bad_matches"] = "select source1_entity_id, case right(source1_entity_id, 1) when '4' then list_concat(ids, ids[1:1]) when '5' then list_concat(ids, ['S9-1']) else ids end as ids from match_lists where right(source1_entity_id, 1) <> '3'"
STEPS["known"] = "select entity_id as other_id from fx_source2 union select entity_id from fx_source3"
STEPS["unknown"] = "select distinct source1_entity_id, other_id from (select source1_entity_id, unnest(ids) as other_id from bad_matches) where other_id not in (select other_id from known)"
STEPS["outside"] = "select distinct source1_entity_id, other_id from (select m.source1_entity_id, unnest(m.ids) as other_id, coalesce(c.ids, []) as ids from bad_matches m left join bad_candidates c using (source1_entity_id)) where not list_contains(ids, other_id)"

ORACLE: dict[str, str] = {}


def _add(name: str, sql: str, **steps: str) -> None:
    chain = STEPS | steps
    ORACLE[name] = "with " + ",\n".join(f"{k} as ({v})" for k, v in chain.items()) + f"\n{sql}"


for _name, _value in {
    "n_clean": "n_text", "n_name": "name", "n_address": "addr", "n_country": "land", "n_house_number": "house", "n_postcode": "post", "n_soundex": "sound", "n_digit_key": "digits", "n_plain_country": "plain",
    "n_token_set": f"array_to_string(list_sort(list_distinct({_split('name')})), ' ')",
}.items():
    _add(_name, f"select entity_id, {_value} as value from prepared", records=STEPS["records"] + " union all select 'odd', * from fx_odd")

_add("b_keys", "select source, entity_id, key_type, key from all_keys")
_add("b_empty_key_filter", "select source, key_type, count(*) as n, count(distinct key) as keys from keys group by all")
_add("b_bucket_sizes", f"select source, key_type, key, records from sizes where records > {q.CAP}")
_add("b_oversize_report", f"select source, count(*) as buckets, sum(records)::bigint as records from sizes s where records > {q.CAP} and exists (select 1 from keys k where k.source = 'S1' and k.key_type = s.key_type and k.key = s.key) group by source")
_add("b_bucket_join", "select source, key_type, count(*) as pairs from shared group by all")
_add("b_pair_dedup", "select source1_entity_id, other_id, source from pairs")
_add("b_capped_pairs", f"select distinct s.source1_entity_id, s.other_id, s.source from shared s join keys k on k.entity_id = s.other_id and k.source = s.source and k.key_type = s.key_type join sizes z on z.source = k.source and z.key_type = k.key_type and z.key = k.key where z.records <= {q.CAP}")
_add("b_score_floor", "select source, count(*) as pairs, round(sum(name_cosine_sim), 4) as total from rated group by source")
_add("b_topk", "select source1_entity_id, other_id, source, round(name_cosine_sim, 6) as name_cosine_sim from ranked where rank <= 3")
_add("b_candidates", "select source1_entity_id, other_id, source, round(name_cosine_sim, 6) as name_cosine_sim from candidates")
_add("b_candidate_counts", "select count(distinct source1_entity_id) as source1_ids, count(distinct other_id) as other_ids, count(*) as pairs from candidates")

_pair = "select source1_entity_id, other_id, round({}, 6) as value from featured"
_add("f_token_sort", _pair.format("name_cosine_sim"))
_add("f_addr_token_sort", _pair.format("addr_ratio"))
_add("f_jaccard", _pair.format("name_jaccard"))
_add("f_addr_jaccard", _pair.format("addr_jaccard"))
_add("f_len_diff", _pair.format("abs(length(name_a) - length(name_b))::double"))
_add("f_addr_len_diff", _pair.format("abs(length(addr_a) - length(addr_b))::double"))
_add("f_country_match", _pair.format("(country_a = country_b and country_a <> '')::int::double"))
_add("f_formula_score", "select * from scored")

_add("j_lookup_left", "select source1_entity_id, other_id, name_a, addr_a, country_a, name_b, addr_b, country_b from fielded")
_add("j_label", "select source1_entity_id, other_id, label from labelled")
_SAMPLE = "select source1_entity_id from ids order by md5('42|' || source1_entity_id), source1_entity_id limit 100"
_add("j_semi", f"select source1_entity_id, other_id from truth where source1_entity_id in ({_SAMPLE})")
_add("j_anti", "select source1_entity_id from ids where source1_entity_id not in (select source1_entity_id from candidates)")
_add("l_pairs_explode", "select source1_entity_id, other_id from truth")
_add("l_recall_ceiling", "select count(c.other_id) as recovered, count(*) as positives, round(count(c.other_id)::double / count(*), 9) as recall from truth t left join candidates c using (source1_entity_id, other_id)")
_add("l_split", "select source1_entity_id as entity_id, ('0x' || substr(md5('42|' || source1_entity_id), 1, 8))::bigint / 4294967296.0::double < 0.2 as held_out from ids")
_add("l_sample", f"select source1_entity_id as entity_id from ({_SAMPLE})")
_add("l_class_weights", "select label, count(*) as n, round(sum(count(*)) over ()::double / (2 * count(*)), 9) as weight from labelled group by label")

_add("u_union_all", "select source, entity_id, business_name from records where source <> 'S1'")
_add("u_intersect", "select source1_entity_id, other_id from candidates intersect select source1_entity_id, other_id from truth")
_add("u_except", "select source1_entity_id, other_id from truth except select source1_entity_id, other_id from candidates")
_add("u_distinct_ids", "select other_id as entity_id from known")

_cols = "select source1_entity_id, other_id, source, score from "
_add("w_one_to_one", _single("scored"))
_add("d_threshold", _cols + "accepted")
_add("d_one_to_one_threshold", _single("accepted"))
_add("d_expected_f05", _cols + f"({_expected('scored', '0.3::double')})")
_add("d_one_to_one_expected_f05", _cols + f"({_expected('single', '0.3::double')})", single=_single("scored"))
_add("d_policy_state", "select source1_entity_id, other_id, rank, " + ", ".join(f"round({c}, 12) as {c}" for c in decide.STATE) + " from states")
_add("d_policy_greedy", f"select source1_entity_id, other_id, score from (select *, bool_and({_policy()} >= 0 and rank <= {decide.MAX_STEPS}) over (partition by source1_entity_id order by rank) as go from states) where go")

_each = f"select *, {_F05} as f05 from ({{}})"
_add("m_fbeta", f"select source1_entity_id, tp, n_pred, n_true, round(f05, 9) as f05 from ({_each.format(_counts('accepted'))})")
_add("m_macro_report", f"select {_REPORT} from ({_each.format(_counts('accepted'))})")
_add("m_macro_with_candidates", f"select {_REPORT} from ({_each.format(_counts('accepted', 'some_ids'))})", some_ids="select distinct source1_entity_id from scored")
_add("m_by_country", f"select country, {_REPORT}, grouping(country) as is_total from (select x.*, land as country from ({_each.format(_counts('accepted'))}) x join (select entity_id, land from normal where source = 'S1') on entity_id = source1_entity_id) group by rollup (country)")


def _sweep(grid: list[float], predicted: str, name: str) -> str:
    return f"select {name}, round(avg(f05), 9) as macro_f05 from ({_each.format(_counts(predicted, 'grid_ids', name))}) group by {name}"


def _grid(name: str, values: list[float]) -> str:
    return f"select unnest([{', '.join(f'{v!r}::double' for v in values)}]) as {name}"


for _name, _values in (("m_threshold_sweep", metrics.TREE_GRID), ("m_neural_grid_sweep", metrics.NEURAL_GRID)):
    _add(_name, _sweep(_values, "grid_pairs", "threshold"), grid=_grid("threshold", _values), grid_ids="select source1_entity_id, threshold from ids, grid", grid_pairs="select source1_entity_id, other_id, threshold from scored, grid where score >= threshold")
for _name, _from in (("m_lambda_grid", "scored"), ("m_lambda_grid_one_to_one", "single")):
    _add(_name, _sweep(decide.LAMBDAS, "grid_pairs", '"lambda"'), single=_single("scored"), grid=_grid('"lambda"', decide.LAMBDAS), grid_ids='select source1_entity_id, "lambda" from ids, grid', grid_scored=f'select * from {_from}, grid', grid_pairs=_expected("grid_scored", '"lambda"', 'source1_entity_id, "lambda"'))
_rules = {"threshold": "accepted", "one_to_one_threshold": "single_accepted", "expected_f05": "expected", "one_to_one_expected_f05": "single_expected"}
_add(
    "m_rule_comparison",
    " union all ".join(f"select '{r}' as rule, {_REPORT} from ({_each.format(_counts(rel))})" for r, rel in _rules.items()),
    single=_single("scored"), single_accepted=_single("accepted"), expected=_expected("scored", "0.3::double"), single_expected=_expected("single", "0.3::double"),
)

_add("s_id_list", "select source1_entity_id, array_to_string(ids, ',') as matched_entity_ids from match_lists")
_add("v_missing", "select source1_entity_id from ids where source1_entity_id not in (select source1_entity_id from bad_matches)")
_add("v_duplicates", "select source1_entity_id from bad_matches where len(ids) <> len(list_distinct(ids))")
_add("v_unknown_ids", "select * from unknown")
_add("v_not_in_candidates", "select * from outside")
_add("v_report", """
select "check", count(*) as n from (
  select 'missing from matches' as "check" from ids where source1_entity_id not in (select source1_entity_id from bad_matches)
  union all select 'missing from candidates' from ids where source1_entity_id not in (select source1_entity_id from bad_candidates)
  union all select 'duplicate id in matches' from bad_matches where len(ids) <> len(list_distinct(ids))
  union all select 'match of unknown id' from unknown
  union all select 'match without candidate' from outside
  union all select 'duplicate id in candidates' from bad_candidates where len(ids) <> len(list_distinct(ids))) group by "check"
""")

_marked = "('^' || name || '$')"
_add("t_trigram_buckets", f"select entity_id, array_to_string(list_transform(range(1, greatest(length({_marked}) - 2, 1) + 1), lambda i: (('0x' || substr(md5(substr({_marked}, i::int, 3)), 1, 8))::bigint % 32768)::varchar), ',') as buckets from prepared where source = 'S1'")
_grams = "list_concat(" + ", ".join(f"list_transform(range(1, greatest(length(name) - {n - 1}, 0) + 1), lambda i: substr(name, i::int, {n}))" for n in (2, 3, 4)) + ")"
_add(
    "x_tfidf_knn",
    "select source1_entity_id, other_id, source, similarity from (select *, row_number() over (partition by source1_entity_id, source order by similarity desc, other_id) as rank from sums where similarity >= 0.2) where rank <= 15",
    grams=f"select source, entity_id, area, unnest({_grams}) as gram from prepared",
    tf="select source, entity_id, area, gram, count(*) as tf from grams group by all",
    df="select area, gram, count(*) as df from tf where source <> 'S1' group by all",
    totals="select area, count(*) as total from prepared where source <> 'S1' group by all",
    weights="select source, entity_id, area, gram, coalesce(df, 0) as df, tf * (ln((1 + coalesce(total, 0)) / (1 + coalesce(df, 0))::double) + 1) as w from tf left join df using (area, gram) left join totals using (area)",
    unit="select *, w / sqrt(sum(w * w) over (partition by source, entity_id)) as u from weights",
    sums="select a.entity_id as source1_entity_id, b.entity_id as other_id, b.source, round(sum(a.u * b.u), 6) as similarity from unit a join unit b on a.area = b.area and a.gram = b.gram and a.source = 'S1' and b.source <> 'S1' group by all",
)
_add(
    "x_rare_token",
    "select a.entity_id as source1_entity_id, b.entity_id as other_id, b.source, count(*) as shared from words a join words b on a.area = b.area and a.token = b.token and a.source = 'S1' and b.source <> 'S1' join rare r on r.area = b.area and r.token = b.token group by all",
    words=f"select source, entity_id, area, token from (select source, entity_id, area, unnest(list_distinct({_split('name')})) as token from prepared) where length(token) >= 4",
    rare="select area, token from words where source <> 'S1' group by all having count(*) <= 20",
)
ORACLE["x_embedding_knn"] = """
with v as (select vec_id, label, embedding::double[] as e from embeddings where embedding is not null),
near as (select a.vec_id as left_id, b.vec_id as right_id, round(list_dot_product(a.e, b.e) / sqrt(list_dot_product(a.e, a.e) * list_dot_product(b.e, b.e)), 6) as s
  from v a join v b on a.label = b.label and a.vec_id % 20 = 0 and a.vec_id <> b.vec_id)
select left_id, right_id, rank, s as similarity from (select *, row_number() over (partition by left_id order by s desc, right_id) as rank from near) where rank <= 10
"""
_pass = """
select '{name}' as pass, left_id, right_id, rank, s as similarity from (select *, row_number() over (partition by left_id order by s desc, right_id) as rank from (
  select a.vec_id as left_id, b.vec_id as right_id, round(list_dot_product(a.{c}, b.{c}) / sqrt(list_dot_product(a.{c}, a.{c}) * list_dot_product(b.{c}, b.{c})), 6) as s
  from v a join v b on a.label = b.label and a.vec_id % 20 = 0 and a.vec_id <> b.vec_id where a.{c} is not null and b.{c} is not null and {which})) where rank <= {k}"""
ORACLE["x_embedding_passes"] = """
with v as (select vec_id, label, e as both, e[1:len(e) // 2] as name, case when vec_id % 3 <> 0 then e[len(e) // 2 + 1:] end as addr from (select *, embedding::double[] as e from embeddings where embedding is not null))
""" + " union all ".join(_pass.format(name=n, c=f'"{c}"', k=k, which="b.addr is null" if alone else "true") for n, (c, k, alone) in extra.VECTOR_PASSES.items())
_both = "case when {0} <> '' and {1} <> '' then {0} || ' ' || {1} else '' end"
_tok = _sorted("name")
_sounds = f"array_to_string(list_transform({_split('name')}[1:2], lambda t: {_sound('t')}), ' ')"
_add("x_extra_keys", f"select entity_id, unnest([5, 6, 7, 8, 9, 10, 11])::bigint as key_type, unnest([area || '|' || name, area || '|' || {_tok}, area || '|' || addr, area || '|' || {_both.format('name', 'post')}, area || '|' || {_both.format('house', 'post')}, area || '|' || regexp_replace({_tok}, '[aeiou ]', '', 'g'), area || '|' || {_sounds}]) as key from prepared where source = 'S1'")
_side = lambda s, o, t: f"row_number() over (partition by {s} order by score desc, {o}) as {t}_rank, round(max(score) over (partition by {s}) - score, 6) as {t}_gap, count(*) over (partition by {s}) as {t}_count"
_add("x_competition", f"select *, {_side('source1_entity_id', 'other_id', 's1')}, {_side('other_id', 'source1_entity_id', 'other')} from scored")
_add("x_agreement", """
select source1_entity_id, other_id, source, score, coalesce(case when source = 'S2' then max(score) filter (source = 'S3') over e else max(score) filter (source = 'S2') over e end, 0.0::double) as cross_best,
  coalesce(case when pos = 1 then max(score) filter (pos = 2) over s else max(score) filter (pos = 1) over s end, 0.0::double) as sibling_best
from (select *, row_number() over (partition by source1_entity_id, source order by score desc, other_id) as pos from scored)
window e as (partition by source1_entity_id), s as (partition by source1_entity_id, source)""")
_add("x_relative_threshold", "select source1_entity_id, other_id, source, score from (select *, max(score) over (partition by source1_entity_id) as top from scored) where score >= 0.9::double * top")
_add("x_bucket_thresholds", """
select source1_entity_id, other_id, source, score from (select *, count(*) over (partition by source1_entity_id) as n from scored)
where score >= case when n <= 1 and source = 'S2' then 0.4 when n between 2 and 3 and source = 'S2' then 0.5 when n between 4 and 10 and source = 'S3' then 0.7 when n > 10 and source = 'S3' then 0.8 else 0.6 end""")
_add("x_pruner", "select source1_entity_id, other_id, source, score from (select *, row_number() over (partition by source1_entity_id order by score desc, other_id) as rank from scored where score >= 0.3) where rank <= 5")
_add("x_uncertain_band", "select * from scored where score >= 0.05 and score < 0.9")
_add("x_blend", "select source1_entity_id, other_id, round((score * 3.0::double + round(score * score, 6) * 1.0::double) / 4.0::double, 9) as score from scored")
_add("x_abbreviations", f"""
select short, long, count(*) as n from (select case when length(a) <= length(b) then a else b end as short, case when length(a) <= length(b) then b else a end as long from (
  select unnest({_split('x.n_text')}) as a, unnest({_split('y.n_text')}) as b from truth t join cleaned x on x.entity_id = t.source1_entity_id join cleaned y on y.entity_id = t.other_id
  where len({_split('x.n_text')}) = len({_split('y.n_text')})) where a <> b) where starts_with(long, short) group by all having count(*) >= 5""")
_french = {"r": "rue", "ch": "chemin", "q": "quai"}
_long = "('12 r du ch de q ' || a_text)"
_add("x_french_address", f"select entity_id, array_to_string(list_transform({_split(_long)}, lambda t: {_case('t', _french)}), ' ') as value from cleaned")
_names = f"unnest([area || '|' || {_tok}, area || '|' || {_sounds}]) as key"
_add(
    "x_name_key_pairs",
    "select a.entity_id as source1_entity_id, b.entity_id as other_id, b.source, b.key_type from name_keys a join name_keys b on a.key_type = b.key_type and a.key = b.key and a.source = 'S1' and b.source <> 'S1' join small s on s.source = b.source and s.key_type = b.key_type and s.key = b.key",
    name_keys=f"select * from (select source, entity_id, unnest([0, 1])::bigint as key_type, {_names} from prepared) where key <> '' and not ends_with(key, '|')",
    small="select source, key_type, key from name_keys where source <> 'S1' group by all having count(*) <= 50",
)
_match = "case when {0} = '' or {1} = '' then 0.5::double else ({0} = {1})::int::double end"
_house = lambda x: rf"regexp_extract({x}, '\d+')"
_ta, _tb, _pa, _pb = _split("name_a"), _split("name_b"), *(f"regexp_replace({_sorted(c)}, '[aeiou ]', '', 'g')" for c in ("name_a", "name_b"))
_add("x_pair_details", f"""
select source1_entity_id, other_id, house_match, post_match, case when longer = 0 then 0.0::double else round(aligned::double / longer, 9) end as aligned_share, first_token_match, plain_name_match,
  count(*) filter (house_match = 1) over (partition by source1_entity_id) as same_house from (select source1_entity_id, other_id,
  {_match.format(_house('addr_a'), _house('addr_b'))} as house_match, {_match.format(_postcode('addr_a'), _postcode('addr_b'))} as post_match, greatest(len({_ta}), len({_tb})) as longer,
  len(list_filter(range(1, least(len({_ta}), len({_tb})) + 1), lambda i: ({_ta})[i::int] = ({_tb})[i::int])) as aligned,
  (split_part(name_a, ' ', 1) <> '' and split_part(name_a, ' ', 1) = split_part(name_b, ' ', 1))::int::double as first_token_match, ({_pa} <> '' and {_pa} = {_pb})::int::double as plain_name_match from fielded)""")
_places = {d: region for region, departments in extra.FRENCH_REGIONS.items() for d in departments.split()}
_post = "right('000' || regexp_replace(entity_id, '[^0-9]', '', 'g'), 3)"
_add("x_french_region", "select source, entity_id, " + " ".join(f"{'case' if not i else ''} when starts_with({_post}, '{d}') then '{r}'" for i, (d, r) in enumerate(sorted(_places.items(), key=lambda p: -len(p[0])))) + " else '' end as value from records")
_latin = "('улица щукова юлия ъ οδος θεοψ ' || a_text)"
for _letter, _form in extra.LATIN_FORMS.items():
    _latin = f"replace({_latin}, '{_letter}', '{_form}')"
_add("x_transliterated", f"select entity_id, {_latin} as value from cleaned")
