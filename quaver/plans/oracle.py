"""DuckDB statements with the results of the queries in :mod:`quaver.plans.catalog`."""

from __future__ import annotations

from quaver.operators.errors import CATEGORIES, GARBAGE, LEAPS, OUTSIDE, OUTSIDE_ANY, TOO_LONG

ORACLE: dict[str, str] = {}
SEED = 1234

# Patterns for RE2, whose blanks are those of ASCII.
HEADER, PAPER = r"\\header\s*\{[^{}]*\}", r"\\paper\s*\{[^{}]*\}"
BAR, QUOTED = r'\\bar\s*"[^"]*"', r'"[^"\n]*"'
KEY = r"\\key\s+([a-g]|do|re|mi|fa|sol|la|si)(isis|eses|is|es|dd|d|bb|b)?\s+\\([A-Za-z]+)"
TIME = r"\\time\s+(\d+)\s*/\s*(\d+)"
NOKEY = r"\\key\s+(?:[a-g]|do|re|mi|fa|sol|la|si)(?:isis|eses|is|es|dd|d|bb|b)?\s+\\[A-Za-z]+"
PART = r"_part\d+$|_(score|violin[oI]+|viola|cello|basso|bc|continuo|flauto[12]?|tromba[12]?|corno[12]?|oboe[12]?|fagotto)$"
EVERY_PART = r"_(?:part\d+|score|violino?[12I]*|viola|cello|basso|bc|continuo|flauto\d*|tromba\d*|corno\d*|oboe\d*|fagotto\d*)$"
SEP = "chr(31)"


def q(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def strip(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def pre(x: str) -> str:
    for p, put in ((HEADER, ""), (PAPER, ""), (BAR, ""), (QUOTED, '""')):
        x = f"regexp_replace({x}, {q(p)}, {q(put)}, 'g')"
    return x


def bars(x: str) -> str:
    parts = f"string_split({pre(x)}, '|')"
    return f"list_filter(list_transform({parts}[1:len({parts})-1], lambda b: {strip('b')}), lambda b: b <> '')"


def mask(x: str) -> str:
    for p in (HEADER, PAPER, BAR, QUOTED):
        pads = f"list_append(list_transform(regexp_extract_all({x}, {q(p)}), lambda m: repeat(' ', length(m))), '')"
        x = f"array_to_string(list_transform(list_zip(regexp_split_to_array({x}, {q(p)}), {pads}), lambda z: z[1] || z[2]), '')"
    return x


def pieces(x: str) -> str:
    return f"string_split({mask(x)}, '|')"


def at(p: str, k: str) -> str:
    return f"(list_sum(list_transform({p}[1:{k}], lambda v: length(v))) + {k} - 1)::bigint"


def found(x: str, p: str, g: int) -> str:
    return f"nullif(regexp_extract({x}, {q(p)}, {g}), '')"


def key_of(x: str) -> str:
    return f"case when regexp_matches({x}, {q(KEY)}) then regexp_extract({x}, {q(KEY)}, 1) || regexp_extract({x}, {q(KEY)}, 2) || ' \\' || regexp_extract({x}, {q(KEY)}, 3) end"


def normal_key(x: str) -> str:
    p = q(r"\\key\s+([a-g](?:isis|eses|is|es|dd|d|bb|b)?)\s+\\(\w+)")
    return f"case when regexp_matches({x}, {p}) then regexp_extract({x}, {p}, 1) || ' \\' || regexp_extract({x}, {p}, 2) end"


def arr(x: str) -> str:
    return f"array_to_string(list_transform({x}, lambda x: x::varchar), {SEP})"


def prf(k: str) -> str:
    return f"('0x' || substr(md5({k}), 1, 8))::bigint"


def key(*parts: str) -> str:
    return f"concat_ws(':', '{SEED}', {', '.join(parts)})"


def shuffled(items: str, k: str) -> str:
    return f"list_transform(list_sort(list_transform({items}, lambda v: {{'o': md5(concat_ws(':', {k}, v)), 'v': v}})), lambda x: x.v)"


def on_scores(name: str, **columns: str) -> None:
    ORACLE[name] = f"select pos, {', '.join(f'{v} as {k}' for k, v in columns.items())} from {SCORES}"


SCORES = "(select *, extras['label'] as label, extras['clip_id'] as clip_id, extras['song_id'] as song_id, extras['part'] as part from scores)"
ANSWERS = """(select p.*, b.task, b.template_kind, b.gold, b.options, b.gold_index, b.gold_bars, b.category, b.rec_no
  from predictions p join (select * from bench qualify row_number() over (partition by id order by rec_no desc) = 1) b using (id))"""


def on_outputs(name: str, **columns: str) -> None:
    ORACLE[name] = f"select id, model_id, {', '.join(f'{v} as {k}' for k, v in columns.items())} from {ANSWERS}"


# --- text on scores -----------------------------------------------------------------------------

on_scores("t01_strip_preamble", v=pre("text"))
on_scores("t02_split_bars", v=arr(bars("text")))
on_scores("t03_count_bars", v=f"len({bars('text')})::int")
on_scores("t04_mask_positions", v=mask("text"))
ORACLE["t05_separators"] = f"select pos, (len(p) - 1)::int as n, case when len(p) > 3 then {at('p', '3')}::int end as third from (select pos, {pieces('text')} as p from scores)"
on_scores("t05b_bar_at", v=f"(len({bars('substr(text, 1, 400)')}) + 1)::int")
on_scores("t06_first_bars", v=f"case when len({bars('text')}) = 0 then text else array_to_string({bars('text')}[1:16], ' | ') || ' |' || chr(10) end")
on_scores("t07_key", v=key_of("text"))
METER = f"case when regexp_matches(text, {q(TIME)}) then regexp_extract(text, {q(TIME)}, 1) || '/' || regexp_extract(text, {q(TIME)}, 2) end"
on_scores("t08_meter", meter_found=METER, length_found=found("text", TIME, 2))
on_scores("t09_mask_field", no_key=f"regexp_replace(text, {q(NOKEY)}, '', 'g')", no_meter=f"regexp_replace(text, {q(TIME)}, '', 'g')")
TITLE = q(r'(?:^|[^A-Za-z_])title\s*=\s*"((?:[^"\\]|\\.)*)"')
BLOCK = q(r"\\header\s*\{([^{}]*)\}")
on_scores("t10_title", v=f"nullif({strip(f'regexp_extract(regexp_extract(text, {BLOCK}, 1), {TITLE}, 1)')}, '')")
BLANK = lambda n: f"regexp_replace(text, {q(rf'({n}\s*=\s*)' + chr(34) + '[^' + chr(34) + ']*' + chr(34))}, '\\1\"\"', 'g')"
on_scores("t11_blank", no_composer=BLANK("composer"), no_title=BLANK("title"))
on_scores("t12_work_id", v=f"regexp_replace(source_id, {q(PART)}, '')", every_part=f"regexp_replace(source_id, {q(EVERY_PART)}, '')")
SPLIT = "string_split(source_id, '_')"
on_scores("t13_song_id", v=f"case when len({SPLIT}) >= 3 then array_to_string({SPLIT}[2:len({SPLIT})-1], '_') else source_id end")
on_scores("t18_ensure_headers", v=rf"""case when contains(text, '\version') then '' else '\version "2.24.4"' || chr(10) end || case when contains(text, '\language') then '' else '\language "nederlands"' || chr(10) end || regexp_replace(text, '\s+$', '') || chr(10)""")
on_scores("t19_ensure_version", v=r"""case when contains(text, '\version') then text else '\version "2.24.4"' || chr(10) || text end""")
on_scores("t20_cut_at", v="split_part(text, '|', 1)")
on_scores("t21_truncated", v="case when length(text) > 500 then substr(text, 1, 500) || chr(10) || '% ...truncated...' || chr(10) else text end")
NOT_BLANK = lambda c, name: f"case when {c} is not null and {c} <> '' then '%% {name}: ' || {c} end"
LISTED = lambda c, name: f"case when len({c}) > 0 then '%% {name}: ' || array_to_string({c}, ', ') end"
BLOCK_SQL = f"concat_ws(chr(10), '%% === METADATA ===', {NOT_BLANK('composer', 'composer')}, {NOT_BLANK('style', 'period')}, {LISTED('musical_form', 'musical_form')}, {LISTED('ensemble', 'ensemble')}, {NOT_BLANK('part', 'part')}, '%% === END METADATA ===') || chr(10)"
on_scores("t24_metadata_block", v=BLOCK_SQL)
EITHER = lambda c, other: f"coalesce(nullif({c}, ''), {q(other)})"
JOINED = lambda c, other: f"case when len({c}) > 0 then array_to_string({c}, ', ') else {q(other)} end"
CLOSE = q("Use Dutch (nederlands) note names and lowercase relative notation. Output only the LilyPond code; no prose, no markdown.")
STYLE = f"'in the style of ' || {EITHER('composer', 'an unnamed 18th-century composer')} || ' (' || {EITHER('style', 'Baroque')} || '). Form: ' || {JOINED('musical_form', 'a short piece')}"
USER = f"'Write a LilyPond fragment ' || {STYLE} || '. Ensemble: ' || {JOINED('ensemble', 'a small ensemble')} || '. Produce ' || case when {EITHER('part', 'full')} = 'full' then 'the full ensemble score' else 'the ' || part || ' part' end || '. ' || {CLOSE}"
SHORT = f"'Compose a short LilyPond fragment of approximately 4 bars ' || {STYLE} || '. Write ' || case when {EITHER('part', 'full')} = 'full' then 'a melodic line' else 'the ' || part || ' part as a melodic line' end || ', optionally with simple accompaniment (chords or a bass line — at most one extra voice). Avoid full multi-instrument scores. ' || {CLOSE}"
on_scores("t25_user_prompt", v=USER, short=SHORT)
NUMBERED = lambda x: f"array_to_string(list_transform({x}, lambda b, i: (i - 1)::varchar || '. ' || b), chr(10))"
on_scores("t28_numbered", v=NUMBERED(f"({bars('text')})[1:4]"))
on_scores("t29_record_id", v="'bar_count_' || case when length(pos::varchar) < 4 then lpad(pos::varchar, 4, '0') else pos::varchar end")
on_scores("t30_normal_key", v=normal_key("text"))
on_scores("p04_bar_eligibility", one=f"len({bars('text')}) >= 1", four=f"len({bars('text')}) >= 4", eight=f"len({bars('text')}) >= 8")
on_scores("p02_prompt_metadata", period="style", part=EITHER("part", "full"))
on_scores("p03_fallback_list", v=arr("case when len(ensemble) > 0 then ensemble else musical_form end"))
on_scores("p01_without_empty", v=arr("list_filter(musical_form, lambda x: x is not null and x <> '')"))

# --- text on model output -----------------------------------------------------------------------

RUNS = r"regexp_extract_all(raw_output, '\d+')"
LONGEST = f"coalesce(list_reduce({RUNS}, lambda a, x: case when length(x) > length(a) then x else a end, ''), '')"
on_outputs("t14_parse_answer", v=rf"case when template_kind = 'multiple_choice' then regexp_extract(raw_output, '[0-3]') when task = 'bar_count' then regexp_extract(raw_output, '\d+') when raw_output is not null then {LONGEST} end")
on_outputs("t15_digit_sequence", v=r"regexp_replace(raw_output, '\D', '', 'g')")
DISTINCT = lambda x: f"list_filter(list_transform({x}, lambda v, i: case when list_position({x}, v) = i then v end), lambda v: v is not null)"
NUMBERS = r"list_transform(regexp_extract_all(coalesce(raw_output, ''), '\d+'), lambda x: x::hugeint)"
on_outputs("t16_bar_list", v=arr(DISTINCT(NUMBERS)))
FENCE = r"```[a-zA-Z0-9_+-]*\s*\n"
CLOSED, OPEN = q(rf"(?s){FENCE}(.*?)\n```"), q(rf"(?m)^\s*{FENCE}")
on_outputs("t17_strip_fence", v=f"case when regexp_matches(raw_output, {CLOSED}) then {strip(f'regexp_extract(raw_output, {CLOSED}, 1)')} when regexp_matches(raw_output, {OPEN}) then {strip(f'regexp_replace(raw_output, {OPEN}, ' + chr(39) * 2 + ')')} else raw_output end")
ORACLE["n01_sequencing_score"] = rf"""with d as (select id, model_id, coalesce(gold, '') as gold, regexp_replace(coalesce(raw_output, ''), '\D', '', 'g') as p from {ANSWERS}),
e as (select *, length(gold) as n, list_transform(range(length(p)), lambda i: substr(p, i + 1, 1)::int) as pl, list_transform(range(length(gold)), lambda i: try_cast(substr(gold, i + 1, 1) as int)) as gl from d),
f as (select *, len(pl) = n and len(list_distinct(pl)) = n and len(list_filter(pl, lambda x: x >= n)) = 0 as ok from e)
select id, model_id, round(case when not ok or n = 0 then 0.0 when n = 1 then case when pl[1] = gl[1] then 1.0 else 0.0 end
  else (list_sum(list_transform(range(n), lambda i: list_sum(list_transform(range(n), lambda j: sign(gl[i+1] - gl[j+1]) * sign(pl[i+1] - pl[j+1])))))::double / (n * (n - 1)) + 1.0) / 2.0 end::double, 6) as v from f"""
GOLD = "coalesce(list_distinct(list_transform(gold_bars, lambda b: b::hugeint)), [])"
F1 = f"case when len({DISTINCT(NUMBERS)}) = 0 and len({GOLD}) = 0 then 1.0 else 2.0 * len(list_intersect({DISTINCT(NUMBERS)}, {GOLD})) / (len({DISTINCT(NUMBERS)}) + len({GOLD})) end"
on_outputs("n02_set_f1", v=f"round(({F1})::double, 6)")
WHOLE = lambda c: rf"case when regexp_matches({c}, '^\s*[+-]?\d+\s*$') then trim({c})::bigint end"
on_outputs("n08_abs_diff", v=f"abs({WHOLE('parsed_answer')} - {WHOLE('gold')})")

ONLY = q("Please only output the index of the correct option (0, 1, 2, or 3), do not output any additional content.")
DIRECT = q("Please directly output the answer of the given task, without any explanation or additional content.")
CHOICE = lambda c, i, o: f"'Input: ' || {c} || chr(10) || 'Task: ' || {i} || chr(10) || 'Options:' || chr(10) || {NUMBERED(o)} || chr(10) || chr(10) || {ONLY}"
STRUCTURED = lambda c, i, t: f"'Input: ' || {c} || chr(10) || 'Task: ' || {i} || chr(10) || 'Template: ' || {t} || chr(10) || chr(10) || {DIRECT}"
ORACLE["t22_choice_prompt"] = f"select rec_no, {CHOICE('input_content', 'task_instruction', 'options')} as v from bench where template_kind = 'multiple_choice' and len(options) = 4"
ORACLE["t23_structured_prompt"] = f"select rec_no, {STRUCTURED('input_content', 'task_instruction', 'coalesce(structured_output_template, ' + chr(39) * 2 + ')')} as v from bench where template_kind = 'structured'"
READER = q("You are a music-theory assistant. Read the LilyPond score in the Input section and answer the multiple-choice question exactly as instructed.")
WRITER = q("You are a LilyPond assistant. Output only valid LilyPond code, no prose, no markdown.")
CHAT = lambda s, u: f"'### System:' || chr(10) || {s} || chr(10) || chr(10) || '### User:' || chr(10) || {u} || chr(10) || chr(10) || '### Assistant:' || chr(10)"
ORACLE["t26_bench_chat"] = f"select rec_no, {CHAT(READER, 'prompt')} as v from bench"

# --- draws --------------------------------------------------------------------------------------

DRAW = f"""(with r as (select *, row_number() over (order by md5({key("'row'", "pos")}), pos) - 1 as row from {SCORES}), n as (select count(*) as n from scores)
select i.i, r.* from (select unnest(range(200)) as i) i cross join n join r on r.row = {prf(key('i.i'))} % n.n)"""
PART_OF = EITHER("part", "full")
FULL = f"(select * replace ({PART_OF} as part) from {DRAW})"
ORACLE["r07_prompt_draw"] = f"select i, pos from {DRAW}"
ID = "'prompt_' || lpad(i::varchar, 4, '0')"
ORACLE["t27_regime_prompts"] = f"select {ID} as id, {CHAT(WRITER, f'{BLOCK_SQL} || {USER}')} as zero, {CHAT(WRITER, q("c'4 d'4 e'4 f'4 |") + f' || chr(10) || chr(10) || {BLOCK_SQL} || {USER}')} as few from {FULL}"
ORACLE["s13_prompt_bank"] = f"select {ID} as id, source_id, {USER} as user_prompt, part from {FULL}"

# --- filters and joins --------------------------------------------------------------------------

ORACLE["p05_any_metadata"] = "select pos from scores where coalesce(nullif(key, ''), nullif(meter, ''), nullif(note_length, '')) is not null"
ORACLE["p06_has_names"] = "select pos, coalesce(title, '') <> '' as has_title, coalesce(composer, '') <> '' as has_composer, coalesce(style, '') <> '' as has_style from scores"
ORACLE["p08_chosen_tasks"] = "select task, count(*) as n from bench where task in ('bar_count', 'genre_recognition') group by task"
ORACLE["p11_quadrant_label"] = f"select pos, label from {SCORES} where label in ('Q1', 'Q2', 'Q3', 'Q4')"
ORACLE["p12_valid_values"] = "select event_type, count(*) as n from events where value is not null and not isnan(value) group by event_type"
ORACLE["j01_align"] = f"select id, model_id, parsed_answer, gold, gold_index, rec_no from {ANSWERS}"
WORKS = "(select distinct regexp_extract(source_id, '^([a-z]+_[0-9]+_[a-z]+)', 1) as k from scores where regexp_extract(source_id, '^([a-z]+_[0-9]+_[a-z]+)', 1) <> '')"
STEMS = "(select distinct source_id as stem from scores)"
ORACLE["j02_longest_prefix"] = f"select stem, arg_max(k, length(k)) as work_key from {STEMS} left join {WORKS} on stem = k or starts_with(stem, k || '_') group by stem"
ORACLE["j03_part_of_stem"] = f"select stem, nullif(substr(stem, length(arg_max(k, length(k))) + 2), '') as part from {STEMS} left join {WORKS} on starts_with(stem, k || '_') group by stem"
ORACLE["j04_existing"] = "select clip_id, pos from emotion_clips join (select source_file, min(pos) as pos from scores group by 1) s on s.source_file = ly_path"
ORACLE["j05_labelled"] = f"select s.clip_id as stem, s.pos, e.label from {SCORES} s join (select distinct clip_id, label from emotion_clips where label is not null and label <> '') e using (clip_id)"
TASKS = "(values ('bar_count'), ('bar_sequencing'), ('composer_recognition'), ('emotion_recognition'), ('error_detection'), ('genre_recognition'), ('metadata_prediction'), ('metadata_qa'), ('music_captioning'), ('next_bar_prediction')) t(task)"
ORACLE["j06_tasks_with_predictions"] = f"select t.task, count(a.id) as n, count(a.id) = 0 as missing from {TASKS} left join {ANSWERS} a using (task) group by t.task"
ORACLE["j07_other_values"] = "with p as (select list(distinct style order by style) as pool from scores where style is not null and style <> '') select pos, len(pool)::int - 1 as n, list_filter(pool, lambda v: v <> style)[1] as first from scores, p where style is not null and style <> ''"
ORACLE["j08_with_split"] = f"select split, count(distinct regexp_replace(source_id, {q(PART)}, '')) as works, count(*) as files from scores join (select distinct pos, split from split_files) using (pos) group by split"

# --- aggregates ---------------------------------------------------------------------------------

EQUAL = "coalesce(parsed_answer, 'None') = coalesce(gold_index::varchar, 'None')"
CHOICES = "count(*) filter (where parsed_answer in ('0', '1', '2', '3'))"
DIGITS = r"count(*) filter (where regexp_matches(parsed_answer, '^\d+$'))"
ORACLE["a01_accuracy"] = f"select model_id, task, round(avg(({EQUAL})::int), 6) as accuracy from {ANSWERS} where template_kind = 'multiple_choice' group by all"
ORACLE["a02_parsed"] = f"select task, {CHOICES} as choices, {DIGITS} as numbers from {ANSWERS} group by task"
DIFFS = f"(select *, abs({WHOLE('parsed_answer')} - {WHOLE('gold')}) as d from {ANSWERS} where task = 'bar_count')"
WITHIN = lambda k: f"round(coalesce(avg((d <= {k})::int), 0.0), 6) as within_{k}"
ORACLE["a03_bar_count_stats"] = f"""select model_id, count(*) as n, round(avg((coalesce(parsed_answer, 'None') = coalesce(gold, 'None'))::int), 6) as accuracy, {DIGITS} as n_parsed,
{WITHIN(1)}, {WITHIN(5)}, {WITHIN(10)}, round(avg(d), 6) as mean_abs_err, (list(d order by d) filter (where d is not null))[(count(d) // 2) + 1]::double as median_abs_err from {DIFFS} group by model_id"""
SEQ = ORACLE["n01_sequencing_score"].replace("raw_output", "parsed_answer").replace(ANSWERS, f"(select * from {ANSWERS} where task = 'bar_sequencing')")
ORACLE["a04_sequencing"] = f"select model_id, count(*) as n, round(avg(v), 6) as score, count(*) filter (where v > 0) as n_valid from ({SEQ}) group by model_id"
SAID = "(select * replace (case when coalesce(parsed_answer, '') <> '' then parsed_answer else raw_output end as raw_output) from " + ANSWERS + " where task = 'error_detection')"
RATED = f"(select model_id, coalesce(category, 'unknown') as category, ({F1})::double as f1 from {SAID})"
ORACLE["a05_macro_f1"] = f"select model_id, sum(k)::bigint as n, round(sum(m * k) / sum(k), 6) as mean_f1, round(avg(m), 6) as macro_f1 from (select model_id, category, avg(f1) as m, count(*) as k from {RATED} group by all) group by model_id"
ORACLE["a06_confusion"] = f"""with r as (select e.gold, case when s.label in ('Q1','Q2','Q3','Q4') then s.label else 'off_grid' end as p from {SCORES} s join (select distinct clip_id, label as gold from emotion_clips) e using (clip_id))
select g.gold, {', '.join(f"count(*) filter (where p = '{c}') as {c}" for c in ('Q1', 'Q2', 'Q3', 'Q4', 'off_grid'))} from (values ('Q1'), ('Q2'), ('Q3'), ('Q4')) g(gold) left join r using (gold) group by g.gold"""
ORACLE["a07_compile_rate"] = "select model_id, round(avg(contains(raw_output, '```')::int), 6) as compile_rate, count(*) filter (where contains(raw_output, '```')) as n_ok, count(*) as n from predictions group by model_id"
ROWS = lambda side: f"(select user_id, avg(value) as polyphony_rate, max(value) - min(value) as groove_consistency, count(*)::double as scale_consistency from events{'' if side is None else f' where event_id % 2 = {side}'} group by user_id)"
STATS = lambda side: " union all ".join(f"select '{m}' as metric, avg({m}) as mean, stddev_samp({m}) as std, count({m}) as n from {ROWS(side)}" for m in ("polyphony_rate", "groove_consistency", "scale_consistency"))
ORACLE["a08_descriptor_stats"] = f"select metric, round(mean, 6) as mean, round(std, 6) as std, n from ({STATS(None)})"
ORACLE["j10_metric_join"] = f"select metric, round(a.mean, 6) as mean_a, round(b.mean, 6) as mean_b from ({STATS(0)}) a join ({STATS(1)}) b using (metric)"
JS = f"""with s as (select metric, a.mean as mu1, a.std as sd1, b.mean as mu2, b.std as sd2 from ({STATS(0)}) a join ({STATS(1)}) b using (metric)),
g as (select *, least(mu1 - 5 * sd1, mu2 - 5 * sd2) as lo, greatest(mu1 + 5 * sd1, mu2 + 5 * sd2) as hi from s),
x as (select g.*, (hi - lo) / 1999 as dx, lo + k.k * (hi - lo) / 1999 as x from g, (select unnest(range(2000)) as k) k),
d as (select *, exp(-0.5 * ((x - mu1) / sd1) ** 2) / (sd1 * sqrt(2 * pi())) as p, exp(-0.5 * ((x - mu2) / sd2) ** 2) / (sd2 * sqrt(2 * pi())) as q from x),
j as (select metric, sum(case when p > 0 and q + p > 0 then p * ln(p / ((p + q) / 2)) else 0 end + case when q > 0 then q * ln(q / ((p + q) / 2)) else 0 end) * 0.5 * any_value(dx) as js from d group by metric)"""
ORACLE["n03_js_divergence"] = f"{JS} select metric, round(js, 6) as js from j"
ORACLE["n04_js_similarity"] = f"{JS} select round(100 * exp(-2 * avg(js)), 4) as js_similarity from j"
ORACLE["n07_descriptors"] = """with n as (select user_id::varchar as file, event_id // 4 as onset, ceil(value)::bigint % 64 + 1 as duration, (36 + event_id % 48)::int as pitch from events where user_id is not null and value is not null),
p as (select file, avg((c >= 2)::int) as polyphony_rate from (select file, tick, count(distinct pitch) as c from (select file, pitch, unnest(range(onset, onset + duration)) as tick from n) group by file, tick) group by file),
h as (select distinct file, onset // 96 as m, onset % 96 as o from n),
l as (select file, max(m) as last from h group by file),
x as (select file, count(*) as differ from (select file, m, o from (select file, m, o from h join l using (file) where m < last union all select file, m - 1, o from h where m > 0) group by file, m, o having count(*) = 1) group by file),
g as (select file, case when last > 0 then 1 - coalesce(differ, 0) / (last * 96) end as groove_consistency from l left join x using (file)),
k as (select root, steps from (select unnest(range(12)) as root), (values ([0, 2, 4, 5, 7, 9, 11]), ([0, 2, 3, 5, 7, 8, 10])) s(steps)),
c as (select file, max(share) as scale_consistency from (select file, root, steps, avg(list_contains(steps, (pitch - root + 120) % 12)::int) as share from n, k group by file, root, steps) group by file)
select file, round(polyphony_rate, 6) as polyphony_rate, round(groove_consistency, 6) as groove_consistency, round(scale_consistency, 6) as scale_consistency from p join g using (file) join c using (file)"""
MC = "('composer_recognition', 'emotion_recognition', 'genre_recognition', 'metadata_prediction', 'metadata_qa', 'music_captioning', 'next_bar_prediction')"
PER_TASK = f"""(select model_id, task, count(*) as n, avg(({EQUAL})::int) as accuracy, null::double as score, null::double as macro_f1, {CHOICES} as n_parsed from {ANSWERS} where task in {MC} group by all
union all select model_id, 'bar_count', count(*), avg((coalesce(parsed_answer, 'None') = coalesce(gold, 'None'))::int), null, null, {DIGITS} from {ANSWERS} where task = 'bar_count' group by all
union all select model_id, 'bar_sequencing', count(*), null, avg(v), null, null from ({SEQ}) group by all
union all select model_id, 'error_detection', sum(k)::bigint, null, null, avg(m), null from (select model_id, avg(f1) as m, count(*) as k from {RATED} group by model_id, category) group by model_id)"""
ORACLE["score_all_tasks"] = f"""select m.model_id, t.task, coalesce(p.n, 0) as n, round(accuracy, 6) as accuracy, round(score, 6) as score, round(macro_f1, 6) as macro_f1, n_parsed, p.n is null as missing
from (select distinct model_id from {ANSWERS}) m cross join {TASKS} left join {PER_TASK} p on p.task = t.task and p.model_id is not distinct from m.model_id"""
ORACLE["a09_overall"] = f"select model_id, round(avg(coalesce(accuracy, score, macro_f1, 0)), 6) as macro_avg, round(sum(coalesce(accuracy, score, macro_f1, 0) * n) / sum(n), 6) as weighted_avg from {PER_TASK} group by model_id"
WORK_RANK = f"""(with s as (select *, regexp_replace(source_id, {q(PART)}, '') as work from scores),
w as (select work, row_number() over (order by md5({key('work')}), work) - 1 as i, count(*) over () as n from (select distinct work from s))
select s.*, case when i < round_even(0.8 * n, 0) then 'train' when i < round_even(0.8 * n, 0) + round_even(0.1 * n, 0) then 'val' else 'test' end as split from s join w using (work))"""
ORACLE["r08_split_by_work"] = f"select pos, work, split from {WORK_RANK}"
ORACLE["a10_split_stats"] = f"select split, count(*) as files, count(distinct work) as works, count(distinct nullif(composer, '')) as composers from {WORK_RANK} group by split"
ORACLE["a11_first_seen"] = "select composer as value, min(pos) as first from scores where composer is not null and composer <> '' group by composer"
ORACLE["a12_group_lists"] = f"""select category, chunk, array_to_string(list(rec_no::varchar order by rec_no), {SEP}) as v
from (select coalesce(category, 'None') as category, rec_no, (row_number() over (partition by coalesce(category, 'None') order by rec_no) - 1) // 1000 as chunk from bench) group by category, chunk"""
ORACLE["a13_per_task"] = "select task, count(*) as n from bench group by task"
ORACLE["a14_per_quadrant"] = "select label, count(distinct clip_id) as clips from emotion_clips group by label"
ORACLE["a15_top_counts"] = "select style, count(*) as n from scores where style is not null group by style order by n desc, style limit 5"
ORACLE["a16_mean_and_covariance"] = """with e as (select label, vec_id, unnest(embedding)::double as v, generate_subscripts(embedding, 1) as k from embeddings),
m as (select label, k, avg(v) as mean, var_samp(v) as var, count(*) as n from e group by all)
select label, max(n) as n, round(max(case when k = 1 then mean end), 5) as mean_0, round(sum(var), 4) as trace from m group by label"""
ORACLE["a17_counters"] = "select model_id, count(*) filter (where coalesce(parsed_answer, '') <> '') as n_ok, count(*) as n from predictions group by model_id"

# --- selections ---------------------------------------------------------------------------------

ORACLE["r01_seeded_order"] = f"""select pos, {prf(key("'bar_count'", 'pos'))} as v from scores"""
ORACLE["r02_sample"] = f"""select (row_number() over (order by md5({key("'r02'", 'pos')}), pos) - 1)::int as i, pos from scores qualify i < 100"""
STYLES = "(select list(distinct style order by style) as pool from scores where style is not null and style <> '')"
ORACLE["r03_distractors"] = f"select pos, {arr('(' + shuffled('list_filter(pool, lambda v: v <> style)', key('pos')) + ')[1:3]')} as v from scores, {STYLES} where style is not null and style <> ''"
ORACLE["r04_stratified"] = f"select label, row_number() over (partition by label order by md5({key('pos')}), pos)::int as r, pos from {SCORES} where label in ('Q1', 'Q2', 'Q3', 'Q4') qualify r <= 30"
MIXED = shuffled("options", key("rec_no"))
ORACLE["r05_shuffled_options"] = f"select rec_no, {arr(MIXED)} as v, (list_position({MIXED}, options[gold_index + 1]) - 1)::bigint as gold_at from bench where len(options) = 4"
PERM = shuffled("['0', '1', '2', '3']", key("pos"))
ORACLE["r06_permutation"] = f"select pos, array_to_string(p, '') as shown, array_to_string(list_transform(['0', '1', '2', '3'], lambda j: (list_position(p, j) - 1)::varchar), '') as gold from (select pos, {PERM} as p from scores)"
ORACLE["r09_limit_per_task"] = "select task, rec_no from bench qualify row_number() over (partition by task order by rec_no) <= 20"


def applicable(c: str) -> str:
    two = f"len({pieces('text')}) > 2"
    return {"invalid_metadata": f"regexp_matches(text, {q(NOKEY)})", "invalid_bar_duration": f"{two} and regexp_matches(text, {q(TIME)})"}.get(c, two)


def fill(pool: str, n: int) -> str:
    """CTEs ``k0`` to ``k4``, the rows kept for each category; ``pool`` has ``rn`` and the flags."""
    per = max(1, n // 5)
    out, cursor = [f"pool as ({pool})", "c0 as (select 0 as cur)"], "c0"
    for k, c in enumerate(CATEGORIES):
        out.append(f"l{k} as (select p.*, cur, row_number() over (order by rn) as tried, sum(ok_{c}::int) over (order by rn) as got from pool p, {cursor} where rn > cur)")
        out.append(f"k{k} as (select *, '{c}' as category, {k} as category_no from l{k} where got - ok_{c}::int < {per} and tried <= {8 * per})")
        out.append(f"c{k + 1} as (select coalesce((select max(rn) from k{k}), cur) as cur from {cursor})")
        cursor = f"c{k + 1}"
    return ", ".join(out) + ", chosen as (" + " union all ".join(f"select * exclude (cur, tried, got) from k{k} where ok_{c}" for k, c in enumerate(CATEGORIES)) + ")"


FLAGS = ", ".join(f"{applicable(c)} as ok_{c}" for c in CATEGORIES)
TRIED = 8 * max(1, 220 // 5) * 5
R11 = fill(f"""select pos, row_number() over (order by md5({key("'r11'", 'pos')}), pos) as rn, {FLAGS} from scores where len({bars('text')}) >= 4 qualify rn <= {TRIED}""", 220)
ORACLE["r11_category_fill"] = f"with {R11} select rn::int as rn, pos, category from chosen"
FIELD = lambda f: f"case when coalesce({f}, '') <> '' then {{'field': '{f}', 'value': {f}}} end"
ROTATED = lambda i: f"coalesce(case {i} % 3 when 0 then {FIELD('key')} when 1 then {FIELD('meter')} else {FIELD('note_length')} end, {FIELD('key')}, {FIELD('meter')}, {FIELD('note_length')})"
ORACLE["r12_rotated_field"] = f"select pos, f.field, f.value from (select pos, {ROTATED('pos')} as f from scores)"
ORACLE["r13_bar_slices"] = f"select pos, {arr('b[1:4]')} as first, {arr('b[6:]')} as later from (select pos, {bars('text')} as b from scores)"
ORACLE["r14_sorted_files"] = "select distinct source_file from bench order by source_file"
ORACLE["r15_limit"] = "select distinct clip_id, ly_path from emotion_clips order by clip_id, ly_path limit 50"
ORACLE["u00_union_of_tasks"] = f"select distinct b.task, id from bench b join {TASKS} on b.task = t.task"

# --- errors -------------------------------------------------------------------------------------


def strings(values: tuple[str, ...]) -> str:
    return "[" + ", ".join(q(v) for v in values) + "]"


def inserted(c: str) -> str:
    """List of what may be inserted."""
    if c == "accidental_outside_key":
        by_key = " ".join(f"when {q(k)} then {strings(v)}" for k, v in OUTSIDE.items())
        return f"list_transform(case {normal_key('text')} {by_key} else {strings(OUTSIDE_ANY)} end, lambda p: ' ' || p || '4 ')"
    return strings({"invalid_content": GARBAGE, "invalid_bar_duration": TOO_LONG, "melodic_leap": LEAPS}[c])


def injected(c: str, k: str, source: str, columns: str) -> str:
    if c == "invalid_metadata":
        return f"select {columns}, regexp_replace(text, {q(NOKEY)}, {q(chr(92) * 2 + 'key xx ' + chr(92) * 2 + 'nonsense')}) as v, 1 as bar from {source} where {applicable(c)}"
    return f"""select {columns}, substr(text, 1, {at('p', 'bar')}) || t[({prf(k + " || ':token'")} % len(t) + 1)::int] || substr(text, {at('p', 'bar')} + 1) as v, bar
from (select *, ({prf(k + " || ':bar'")} % (len(p) - 1) + 1)::int as bar from (select *, {pieces('text')} as p, {inserted(c)} as t from {source} where {applicable(c)}))"""


for _n, _c in enumerate(CATEGORIES, 1):
    ORACLE[f"e0{_n}_{_c}"] = injected(_c, key("pos"), "scores", "pos")

# --- tasks --------------------------------------------------------------------------------------


def drawn(name: str, n: int, where: str) -> str:
    return f"""(select *, (row_number() over (order by md5({key(q(name), 'source_id', 'pos')}), source_id, pos) - 1)::int as i from {SCORES} where {where} qualify i < {n})"""


def record(name: str, source: str, content: str, instruction: str, template: str | None = None, **more: str) -> str:
    cols = {
        "task": q(name), "id": f"'{name}_' || lpad(i::varchar, 4, '0')", "source_file": "source_file", "input_content": content, "task_instruction": instruction,
        "template_kind": q("structured_output" if template else "multiple_choice"), "gold": "null::varchar", "options": "null::varchar", "gold_index": "null::int",
        "structured_output_template": q(template) if template else "null::varchar", "shuffled_indices": "null::varchar", "question_field": "null::varchar",
        "clip_id": "null::varchar", "song_id": "null::varchar", "gold_bars": "null::varchar", "category": "null::varchar",
    }
    if template:
        cols["prompt"] = STRUCTURED(content, instruction, q(template))
    else:
        cols |= {"gold": "gold", "options": arr("options"), "gold_index": "(list_position(options, gold) - 1)::int", "prompt": CHOICE(content, instruction, "options")}
    cols |= more
    return f"select {', '.join(f'{v} as {k}' for k, v in cols.items())} from {source}"


def choices(name: str, source: str) -> str:
    """Adds ``options`` to rows with ``gold`` and ``pool``."""
    k = key(q(name), "source_id")
    three = f"({shuffled('list_sort(list_distinct(list_filter(pool, lambda v: v <> gold)))', k + " || ':d'")})[1:3]"
    return f"(select *, {shuffled('list_prepend(gold, three)', k + " || ':o'")} as options from (select *, {three} as three from {source}) where len(three) = 3)"


def _instructions() -> dict[str, str]:
    from quaver.plans import tasks

    return {t.name: t.instruction for t in tasks.iter_tasks()}


def _tasks() -> None:
    say = {k: q(v) for k, v in _instructions().items()}
    ORACLE["build_bar_count"] = record("bar_count", drawn("bar_count", 100, f"len({bars('text')}) >= 1"), "text", say["bar_count"], "<integer>", gold=f"len({bars('text')})::varchar")
    perm = shuffled("['0', '1', '2', '3']", key("'bar_sequencing'", "source_id", "'p'"))
    seq = f"(select *, {perm} as o, {bars('text')} as b from {drawn('bar_sequencing', 119, f'len({bars("text")}) >= 4')})"
    ORACLE["build_bar_sequencing"] = record(
        "bar_sequencing", seq, NUMBERED("list_transform(o, lambda k: b[k::int + 1])"), say["bar_sequencing"], "<four-digit index permutation, no separator>",
        gold="array_to_string(list_transform(['0', '1', '2', '3'], lambda j: (list_position(o, j) - 1)::varchar), '')", shuffled_indices=f"array_to_string(o, {SEP})",
    )
    for name, column, n, first, content in (
        ("composer_recognition", "composer", 96, "true", BLANK("composer")),
        ("genre_recognition", "style", 132, "true", "text"),
        ("music_captioning", "title", 60, "title is not null and title <> ''", BLANK("title")),
    ):
        pool = f"(select list(distinct {column}) as pool from scores where {column} is not null and {column} <> '')"
        rows = f"(select d.*, {column} as gold, pool from {drawn(name, n, first)} d, {pool} where {column} is not null and {column} <> '')"
        ORACLE[f"build_{name}"] = record(name, choices(name, rows), content, say[name])
    some = "coalesce(nullif(key, ''), nullif(meter, ''), nullif(note_length, '')) is not null"
    pools = " union all ".join(f"select '{f}' as question_field, list(distinct {f}) as pool from scores where {f} is not null and {f} <> ''" for f in ("key", "meter", "note_length"))
    for name, ask in (("metadata_qa", "Field"), ("metadata_prediction", "Masked field")):
        asked = f"(select *, f.field as question_field, f.value as gold from (select *, {ROTATED('i')} as f from {drawn(name, 60, some)}))"
        rows = choices(name, f"(select a.*, p.pool from {asked} a join ({pools}) p using (question_field))")
        content = "text" if name == "metadata_qa" else f"case when question_field = 'key' then regexp_replace(text, {q(NOKEY)}, '', 'g') else regexp_replace(text, {q(TIME)}, '', 'g') end"
        ORACLE[f"build_{name}"] = record(name, rows, content, f"{say[name]} || ' {ask}: ' || question_field || '.'", question_field="question_field")
    nxt = f"(select *, b[5] as gold, b[6:] as pool from (select *, {bars('text')} as b from {drawn('next_bar_prediction', 119, f'len({bars("text")}) >= 8')}))"
    at_gold = "(list_position(options, gold) - 1)"
    ORACLE["build_next_bar_prediction"] = record("next_bar_prediction", choices("next_bar_prediction", nxt), "array_to_string(b[1:4], ' | ') || ' |'", say["next_bar_prediction"], gold=f"{at_gold}::varchar", gold_index=f"{at_gold}::int")
    quad = f"""(select *, label as gold, (row_number() over (order by label, r) - 1)::int as i, {shuffled("['Q1', 'Q2', 'Q3', 'Q4']", key("'emotion_recognition'", "source_id", "'o'"))} as options
from (select *, row_number() over (partition by label order by md5({key("'emotion_recognition'", 'source_id', 'pos')}), source_id, pos) as r from {SCORES} where label in ('Q1', 'Q2', 'Q3', 'Q4') qualify r <= 30))"""
    ORACLE["build_emotion_recognition"] = record("emotion_recognition", quad, "text", say["emotion_recognition"], clip_id="clip_id", song_id="song_id")
    k = key("'error_detection'", "source_id")
    pool = f"""select *, row_number() over (order by md5({key("'error_detection'", 'source_id', 'pos')}), source_id, pos) as rn, {FLAGS} from scores where len({bars('text')}) >= 4 qualify rn <= {TRIED}"""
    hurt = " union all ".join(injected(c, k, f"(select * from rows where category = '{c}')", "source_file, i, category") for c in CATEGORIES)
    made = f"with {fill(pool, 220)}, rows as (select *, (row_number() over (order by category_no, rn) - 1)::int as i from chosen)"
    ORACLE["build_error_detection"] = f"{made} " + record("error_detection", f"({hurt})", "v", say["error_detection"], "<space-separated integer bar numbers, or 'none'>", gold_bars="bar::varchar", category="category")


ORACLE["s01_jsonl"] = f"select rec_no, id, input_content, gold, {arr('options')} as options, gold_index from bench"
ORACLE["s15_samples"] = "select lpad(item_id::varchar, greatest(length(item_id::varchar), 4)::int, '0') as stem, coalesce(text, '') as text from heldout_items"
ORACLE["s10_reference_documents"] = f"select doc_id, {strip('text')} as text from documents where length({strip('text')}) >= 40"
ORACLE["s16_predictions"] = f"select model_id as model, task, id, parsed_answer from {ANSWERS} where model_id is not null"
ORACLE["s19_clip_manifest"] = """with c as (select clip_id, min(label) as label, min(ly_path) as ly_path, min(n_bars_full) as n_bars_full, min(n_bars_truncated) as n_bars_truncated from emotion_clips group by clip_id)
select clip_id, case when len(string_split(clip_id, '_')) >= 3 then array_to_string(string_split(clip_id, '_')[2:len(string_split(clip_id, '_'))-1], '_') else clip_id end as song_id, label, ly_path, n_bars_full, n_bars_truncated from c where label is not null"""
_tasks()
BUILT = f"(select id, gold from ({ORACLE['build_bar_count']}))"
ORACLE["bar_count_scored"] = rf"""with a as (select gold::bigint as gold, gold::bigint + {prf(key('id'))} % 3 as p from {BUILT}), d as (select *, abs(p - gold) as d from a)
select count(*) as n, round(avg((p = gold)::int), 6) as accuracy, count(*) as n_parsed, {WITHIN(1)}, {WITHIN(5)}, {WITHIN(10)}, round(avg(d), 6) as mean_abs_err, (list(d order by d))[(count(d) // 2) + 1]::double as median_abs_err from d"""
