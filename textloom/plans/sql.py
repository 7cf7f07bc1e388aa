"""The same results in SQL over the same tables."""

from __future__ import annotations

from textloom.plans.nfkc import SPACES, compare_form, nfkc, strip

_FILES = "files as (select * from (select *, row_number() over (partition by doc_id order by loaded_at desc, file_path desc) as rn from bid_files) x where rn = 1)"
_UNITS = """units as (select * from (select *, row_number() over (partition by unit_id, pos order by (coalesce(text, '') <> '') desc, loaded_at desc, coalesce(text, '') desc) as rn
  from text_units) x where rn = 1)"""
_MATCHES = """matches as (select * exclude (similarity, rn), case when similarity > 1 then similarity / 100 else similarity end as similarity from (
  select *, row_number() over (partition by match_id order by loaded_at desc, coalesce(unit_id_a, '') desc, coalesce(unit_id_b, '') desc) as rn from similarity_matches) x where rn = 1)"""
_IMAGES = f"""{_FILES},
once as (select * from (select *, row_number() over (partition by doc_id, image_id order by group_name) as rn from doc_images) x where rn = 1),
images as (select once.*, files.case_id, lpad(cast(once.doc_id as varchar), 19, '0') || '/' || image_id as ord from once join files using (doc_id))"""
_STORED = """stored as (select case_id, pos, unit_id, min(normalized) as form, min(group_index) as group_index from text_units
  where normalized <> '' and group_index >= 0 and comparable group by case_id, pos, unit_id),
grams as (select case_id, pos, unnest(list_distinct(case when length(form) <= 3 then [form] else list_transform(range(1, length(form) - 1), lambda i: substring(form, i, 3)) end)) as gram from stored)"""


def _shared(several: str, kept: str) -> str:
    return f"""
df as (select case_id, gram from grams group by case_id, gram having count(*) {several}),
held as (select grams.* from grams join df using (case_id, gram)),
sizes as (select case_id, pos, count(*) as n from grams group by case_id, pos),
parts as (
  select a.case_id, a.pos as pos_a, b.pos as pos_b, 1 as s from held a join held b on a.case_id = b.case_id and a.gram = b.gram and a.pos < b.pos
  union all
  select a.case_id, a.pos, b.pos, greatest(sizes.n, 1) from stored a join stored b on a.case_id = b.case_id and a.form = b.form and a.pos < b.pos
  join sizes on sizes.case_id = a.case_id and sizes.pos = a.pos),
shared as (select case_id, pos_a, pos_b, cast(sum(s) as bigint) as shared from parts group by case_id, pos_a, pos_b),
top as (select case_id, pos_a, pos_b, shared from {kept})"""


_SHARED = _shared("between 2 and 300", "(select *, row_number() over (partition by case_id, pos_a order by shared desc, pos_b) as rn from shared) x where rn <= 200")
#: All pairs that share an n-gram or the form.
_ALL_SHARED = _shared(">= 2", "shared")
_ABLE = """case when regexp_matches(text, '[\\x{3400}-\\x{9fff}]') then length(regexp_replace(text, '[^\\p{L}\\p{N}_]', '', 'g')) >= coalesce(min_chars, 10)
  else len(regexp_extract_all(text, '[A-Za-z0-9_]+')) >= coalesce(min_words, 8) end"""
_OWN = f"""{_UNITS},
clear as (select * exclude (text), text as raw, {nfkc('text')} as text from units where text <> ''),
own as (select clear.*, {compare_form('text')} as form, coalesce(ngram_size, 3) as k, {_ABLE} as able,
  coalesce(similarity_threshold, 0.78) as threshold, coalesce(exclude_threshold, 0.86) as exclude_threshold from clear left join check_options using (options_id))"""
_OWN_GRAMS = f"""{_OWN},
stored as (select case_id, pos, unit_id, group_index, group_name, file_name, location, raw, form, k, threshold, exclude_threshold from own where able and form <> '' and group_index >= 0),
grams as (select case_id, pos, unnest(list_distinct(case when length(form) <= k then [form] else list_transform(range(1, length(form) - k + 2), lambda i: substring(form, i, k)) end)) as gram from stored)"""
_JACCARD = f"""{_SHARED},
overlap as (select a.case_id, a.pos as pos_a, b.pos as pos_b, count(*) as both_n from grams a join grams b on a.case_id = b.case_id and a.gram = b.gram and a.pos < b.pos group by 1, 2, 3),
full_ as (select top.*, o.both_n, ua.group_index as ga, ub.group_index as gb, length(ua.form) as la, length(ub.form) as lb, na.n as na, nb.n as nb from top
  join overlap o using (case_id, pos_a, pos_b)
  join stored ua on ua.case_id = top.case_id and ua.pos = top.pos_a join stored ub on ub.case_id = top.case_id and ub.pos = top.pos_b
  join sizes na on na.case_id = top.case_id and na.pos = top.pos_a join sizes nb on nb.case_id = top.case_id and nb.pos = top.pos_b)
select case_id, pos_a, pos_b, shared, both_n / (na + nb - both_n) as jaccard from full_
where ga <> gb and least(la, lb) / greatest(la, lb) >= 0.55 and shared >= greatest(2, floor(least(na, nb) * 0.12)) and both_n / (na + nb - both_n) >= 0.5"""
#: For pairs (id, a, b) of texts: how many characters the longest common runs hold, each found left and right of the one
#: before - of the longest the first in a, then in b.
def _runs(p: str) -> str:
    return """cells as (
  select id, i, j from (select id, b, i, substring(a, i, 1) as c from (select id, a, b, unnest(range(1, length(a) + 1)) as i from pairs) x) y
  join (select id, j, substring(b, j, 1) as c from (select id, b, unnest(range(1, length(b) + 1)) as j from pairs) x) z using (id, c)),
split as (
  select id, 1 as al, length(a) + 1 as ah, 1 as bl, length(b) + 1 as bh, cast(0 as bigint) as n from pairs
  union all
  select id, s.al, s.ah, s.bl, s.bh, s.n from (
    select id, unnest([{'al': al, 'ah': i, 'bl': bl, 'bh': j, 'n': n}, {'al': i + n, 'ah': ah, 'bl': j + n, 'bh': bh, 'n': 0}]) as s from (
      select id, al, ah, bl, bh, min(i) as i, min(j) as j, count(*) as n, row_number() over (partition by id, al, ah, bl, bh order by count(*) desc, min(i), min(j)) as best from (
        select split.id, al, ah, bl, bh, i, j, i - row_number() over (partition by split.id, al, ah, bl, bh, j - i order by i) as run
        from split join cells on cells.id = split.id and i >= al and i < ah and j >= bl and j < bh where ah > al and bh > bl) x
      group by id, al, ah, bl, bh, j - i, run) y
    where best = 1) z),
common as (select id, sum(n) as n from split group by id)""".replace("pairs", f"{p}pairs").replace("cells", f"{p}cells").replace("split", f"{p}split").replace("common", f"{p}common")


def _scored(shared: str) -> str:
    return f"""{_OWN_GRAMS}, {shared},
sides as (select top.*, a.group_index as ga, b.group_index as gb, a.form as a, b.form as b, na.n as na, nb.n as nb, a.threshold from top
  join stored a on a.case_id = top.case_id and a.pos = top.pos_a join stored b on b.case_id = top.case_id and b.pos = top.pos_b
  join sizes na on na.case_id = top.case_id and na.pos = top.pos_a join sizes nb on nb.case_id = top.case_id and nb.pos = top.pos_b),
near as (select * from sides where ga <> gb and least(length(a), length(b)) / greatest(length(a), length(b)) >= 0.55 and shared >= greatest(2, floor(least(na, nb) * 0.12))),
overlap as (select near.case_id, near.pos_a, near.pos_b, count(*) as m from near join grams x on x.case_id = near.case_id and x.pos = near.pos_a
  join grams y on y.case_id = near.case_id and y.pos = near.pos_b and y.gram = x.gram group by near.case_id, near.pos_a, near.pos_b),
jac as (select near.*, coalesce(m, 0) / (na + nb - coalesce(m, 0)) as jaccard from near left join overlap using (case_id, pos_a, pos_b)),
pairs as (select row_number() over () as id, a, b from (select distinct a, b from jac where a <> b and 0.62 * (2.0 * least(length(a), length(b)) / (length(a) + length(b))) + 0.38 * jaccard >= threshold - 1e-9) x),
{_runs("")},
ratios as (select a, b, 2.0 * cast(n as double) / (length(a) + length(b)) as ratio from pairs join common using (id)),
scored as (select case_id, pos_a, pos_b, shared, threshold, case when a = b then 1.0::double else cast(0.62 as double) * ratio + cast(0.38 as double) * jaccard end as similarity from jac left join ratios using (a, b) where a = b or ratio is not null)"""


_EXCLUDED = f"""{_scored(_SHARED)},
found as (select * from scored where similarity >= threshold),
needed as (select stored.* from stored semi join (select case_id, pos_a as pos from found union select case_id, pos_b from found) x using (case_id, pos)),
templates as (select * from own where able and form <> '' and group_index < 0),
twins as (select case_id, form, min(pos) as exclude_pos, arg_min(file_name, pos) as exclude_file from templates group by case_id, form),
rest as (select * from needed anti join twins using (case_id, form)),
template_grams as (select case_id, pos as exclude_pos, unnest(list_distinct(case when length(form) <= k then [form] else list_transform(range(1, length(form) - k + 2), lambda i: substring(form, i, k)) end)) as gram from templates),
few as (select case_id, gram from template_grams group by case_id, gram having count(*) <= 300),
asked as (select case_id, pos, exclude_pos, count(*) as shared from rest join grams using (case_id, pos) join (select * from template_grams semi join few using (case_id, gram)) g using (case_id, gram) group by case_id, pos, exclude_pos),
ranked as (select * from (select *, row_number() over (partition by case_id, pos order by shared desc, exclude_pos) as r from asked) x where r <= 80),
both_sizes as (select case_id, exclude_pos, count(*) as n from template_grams group by case_id, exclude_pos),
both_shared as (select ranked.case_id, ranked.pos, ranked.exclude_pos, count(*) as m from ranked join grams using (case_id, pos) join template_grams t on t.case_id = ranked.case_id and t.exclude_pos = ranked.exclude_pos and t.gram = grams.gram group by 1, 2, 3),
e_jac as (select r.case_id, r.pos, r.exclude_pos, r.r, u.form as a, e.form as b, e.file_name as exclude_file, u.exclude_threshold, coalesce(m, 0) / (x.n + y.n - coalesce(m, 0)) as jaccard
  from ranked r join rest u on u.case_id = r.case_id and u.pos = r.pos join templates e on e.case_id = r.case_id and e.pos = r.exclude_pos
  join sizes x on x.case_id = r.case_id and x.pos = r.pos join both_sizes y on y.case_id = r.case_id and y.exclude_pos = r.exclude_pos
  left join both_shared s on s.case_id = r.case_id and s.pos = r.pos and s.exclude_pos = r.exclude_pos
  where least(length(u.form), length(e.form)) / greatest(length(u.form), length(e.form)) >= 0.55),
e_pairs as (select row_number() over () as id, a, b from (select distinct a, b from e_jac where 0.62 * (2.0 * least(length(a), length(b)) / (length(a) + length(b))) + 0.38 * jaccard >= exclude_threshold - 1e-9) x),
{_runs("e_")},
e_scored as (select e_jac.*, cast(0.62 as double) * (2.0 * cast(n as double) / (length(e_jac.a) + length(e_jac.b))) + cast(0.38 as double) * jaccard as score from e_jac join e_pairs on e_pairs.a = e_jac.a and e_pairs.b = e_jac.b join e_common using (id)),
best as (
  select case_id, pos, exclude_file, 1.0::double as score from needed join twins using (case_id, form)
  union all
  select case_id, pos, exclude_file, score from (select *, row_number() over (partition by case_id, pos order by score desc, r) as k from e_scored where score >= exclude_threshold) x where k = 1)"""
_SIDES = """
select s.case_id, a.unit_id as unit_id_a, a.group_name as group_a, a.file_name as file_a, a.location as location_a, a.raw as text_a,
  b.unit_id as unit_id_b, b.group_name as group_b, b.file_name as file_b, b.location as location_b, b.raw as text_b, s.pos_a, s.pos_b, s.shared, s.similarity"""
_SIDES_OF = "join stored a on a.case_id = s.case_id and a.pos = s.pos_a join stored b on b.case_id = s.case_id and b.pos = s.pos_b"
_EMPHASIS = r"\*\*(.*?)\*\*|__(.*?)__|\*([^*_`\n]+)\*|_([^*_`\n]+)_|~~(.*?)~~"


def _sub(text: str, pattern: str, kept: str = "''", flags: str = "g") -> str:
    return f"regexp_replace({text}, '{pattern}', {kept}, '{flags}')"


def _markdown(text: str) -> str:
    """Markup taken out of a text, emphasis up to six deep; then line by line."""
    for pattern, kept in ((r"(?s)```.*?```|~~~.*?~~~", "chr(10)"), (r"`[^`]*`", "' '"), (r"!\[[^\]]*\]\(([^)\s]+)(?:\s+\"[^\"]*\")?\)", "' '"), (r"\[([^\]]+)\]\(([^)]+)\)", r"'\1'"), (r"<[^>]+>", "' '"), *[(_EMPHASIS, r"'\1\2\3\4\5'")] * 6):
        text = _sub(text, pattern, kept)
    lines = _sub(_sub(text, r"\r\n|[\r\v\f\x1c-\x1e\x{85}\x{2028}\x{2029}]", "chr(10)"), r"\n\z")
    line = strip("l")
    line = _sub(line, rf"^\|?{SPACES}*:?-{{3,}}:?{SPACES}*(\|{SPACES}*:?-{{3,}}:?{SPACES}*)+\|?$")
    for pattern in (rf"^#{{1,6}}{SPACES}*", rf"{SPACES}+#{{1,6}}{SPACES}*$", rf"^{SPACES}*>{SPACES}?", rf"^{SPACES}*\d+[.)、]{SPACES}+", rf"^{SPACES}*[-*+]{SPACES}+"):
        line = _sub(line, pattern)
    line = strip(_sub(f"replace({line}, '|', ' ')", f"{SPACES}{{2,}}", "' '"))
    return f"array_to_string(list_transform(string_split({lines}, chr(10)), lambda l: {line}), chr(10))"


_PAIRS = f"""{_MATCHES},
flat as (select case_id, least(group_a, group_b) as group_a, greatest(group_a, group_b) as group_b, excluded, similarity, [regexp_extract(file_a, '[^/\\\\]*$'), regexp_extract(file_b, '[^/\\\\]*$')] as f from matches),
pairs as (select case_id, group_a, group_b, count(*) filter (not excluded) as match_count, count(*) filter (excluded) as excluded_count,
  coalesce(max(similarity) filter (not excluded), 0.0) as max_similarity, coalesce(avg(similarity) filter (not excluded), 0.0) as avg_similarity,
  coalesce(array_to_string(list_sort(list_distinct(flatten(list(f) filter (not excluded)))), '|'), '') as files
  from flat group by case_id, group_a, group_b)"""
_TEXTS = f"{_FILES}, texts as (select case_id, doc_id, group_name, array_to_string(blocks, chr(10)) as text from files where group_index >= 0)"
_WORDS = "words(keyword) as (values ('光模块'), ('热力管'), ('Beacon'), ('guardrail'))"
_META = f"""{_FILES},
raw as (select case_id, group_name, field, level, kind, trim(coalesce(metadata[field], '')) as raw from files,
  (values ('author', '高', 'v'), ('company', '高', 'v'), ('last_modified_by', '中', 'v'), ('created', '中', 't'), ('modified', '中', 't')) s(field, level, kind) where group_index >= 0),
keyed as (select *, case when kind = 'v' then lower(regexp_replace(raw, '\\s+', ' ', 'g'))
  when raw like 'D:%' and length(regexp_replace(substring(raw, 3), '[^0-9]', '', 'g')) >= 12 then regexp_replace(regexp_replace(substring(raw, 3), '[^0-9]', '', 'g'), '^(\\d{{4}})(\\d\\d)(\\d\\d)(\\d\\d)(\\d\\d).*$', '\\1-\\2-\\3 \\4:\\5')
  when regexp_matches(raw, '^\\d{{4}}-\\d\\d-\\d\\d[T ]\\d\\d:\\d\\d') then substring(raw, 1, 10) || ' ' || substring(raw, 12, 5)
  when regexp_matches(raw, '^\\d{{4}}-\\d\\d-\\d\\d$') then raw || ' 00:00' else '' end as key from raw where raw <> '')"""


def oracle_sql() -> dict[str, str]:
    return {
        "document_pieces": """
with lists as (select doc_id, list_filter(list_transform(regexp_extract_all(text, '([^。！？!?；;\\r\\n]*[！？。!?；;]|[^。！？!?；;\\r\\n]+)', 1),
  lambda p: regexp_replace(p, '^[ \\t\\x{00a0}\\x{3000}]+|[ \\t\\x{00a0}\\x{3000}]+$', '', 'g')), lambda p: p <> '') as l from documents)
select doc_id, cast(i as bigint) as piece_no, l[i + 1] as piece from (select doc_id, l, unnest(range(0, len(l))) as i from lists) x""",
        "unit_features": f"""
select unit_id, pos, strftime(loaded_at at time zone 'UTC', '%Y-%m-%d %H:%M:%S') as loaded, coalesce({compare_form('text')}, '') as form,
  cast(length(regexp_replace(coalesce(text, ''), '[^\\p{{L}}\\p{{N}}_]', '', 'g')) as bigint) as chars,
  cast(len(regexp_extract_all(coalesce(text, ''), '[A-Za-z0-9_]+')) as bigint) as words,
  regexp_matches(coalesce(text, ''), '[\\x{{3400}}-\\x{{9fff}}]') as han,
  case when regexp_matches(coalesce(text, ''), '[\\x{{3400}}-\\x{{9fff}}]') then length(regexp_replace(coalesce(text, ''), '[^\\p{{L}}\\p{{N}}_]', '', 'g')) >= 10
    else len(regexp_extract_all(coalesce(text, ''), '[A-Za-z0-9_]+')) >= 8 end as able
from (select unit_id, pos, loaded_at, {nfkc('text')} as text from (select distinct unit_id, pos, loaded_at, text from text_units) v) u""",
        "unit_audit": f"""
with {_FILES} select doc_id, md5(regexp_replace({nfkc("array_to_string(blocks, '')")}, '{SPACES}+|\\x{{200b}}', '', 'g')) as kept_md5, cast(0 as bigint) as over_limit
from files where len(list_filter(blocks, lambda b: {strip('b')} <> '')) > 0""",
        "text_file_blocks": f"""
with lists as (select doc_id, list_filter(list_transform(string_split(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10)), lambda l: {strip('l')}), lambda l: l <> '') as p from documents)
select doc_id, cast(i as bigint) as block_no, p[i + 1] as block from (select doc_id, p, unnest(range(0, len(p))) as i from lists) x""",
        "markdown_plain": f"select doc_id, {_markdown('text')} as plain from documents",
        "keyword_hits_found": f"""
with {_TEXTS}, {_WORDS},
cut as (select case_id, doc_id, keyword, text, string_split(lower(text), lower(keyword)) as p from texts, words where contains(lower(text), lower(keyword))),
place as (select *, cast(list_sum(list_transform(p[1:n], lambda x: length(x))) + (n - 1) * length(keyword) as bigint) as a from (select *, unnest(range(1, len(p))) as n from cut) x)
select case_id, doc_id, keyword, cast(n as integer) as hit_no, substring(text, a + 1, length(keyword)) as matched_text,
  case when a > 50 then '...' else '' end || replace(substring(text, greatest(a - 50, 0) + 1, least(a + length(keyword) + 50, length(text)) - greatest(a - 50, 0)), chr(10), ' ')
  || case when a + length(keyword) + 50 < length(text) then '...' else '' end as snippet from place""",
        "unit_ids_from_text": f"""
with {_OWN} select file_path, location, pos, substring(sha1(concat_ws('|', group_name, file_path, location, cast(pos as varchar), substring(form, 1, 80))), 1, 16) as made_id from own""",
        "exact_duplicate_units_from_text": f"""
with {_OWN} select case_id, form as normalized, count(distinct group_name) as n_groups, count(distinct (unit_id, pos)) as n_units
from own where able and form <> '' and group_index >= 0 group by case_id, form having count(distinct group_name) >= 2""",
        "ngram_document_frequency_from_text": f"with {_OWN_GRAMS} select gram, count(*) as df from grams group by gram",
        "stop_grams_from_text": f"with {_OWN_GRAMS} select gram, count(*) as df from grams group by gram having count(*) > 300",
        "ngram_candidates_from_text": f"with {_OWN_GRAMS}, {_SHARED} select pos_a, pos_b, shared from top",
        "jaccard_pairs_from_text": f"with {_OWN_GRAMS}, {_JACCARD}",
        "exclude_exact_from_text": f"""
with {_OWN}, able_ as (select * from own where able and form <> ''),
e as (select case_id, form, min(pos) as exclude_pos from able_ where group_index < 0 group by case_id, form)
select distinct u.case_id, u.pos, u.unit_id, e.exclude_pos from able_ u join e on u.case_id = e.case_id and u.form = e.form where u.group_index >= 0""",
        "unit_ids": """
select file_path, location, pos, substring(sha1(concat_ws('|', group_name, file_path, location, cast(pos as varchar), substring(normalized, 1, 80))), 1, 16) as made_id
from (select distinct group_name, file_path, location, pos, normalized from text_units where normalized is not null) u""",
        "shortened_texts": """
with flat as (select doc_id, trim(regexp_replace(coalesce(text, ''), '[ \\t\\n\\x0b\\f\\r]+', ' ', 'g')) as t from documents)
select doc_id, case when length(t) <= 160 then t else left(t, 72) || ' ... ' || right(t, 83) end as short from flat""",
        "exact_duplicate_units": """
select case_id, normalized, count(distinct group_name) as n_groups, count(distinct (unit_id, pos)) as n_units
from text_units where comparable and normalized <> '' and group_index >= 0 group by case_id, normalized having count(distinct group_name) >= 2""",
        "ngram_document_frequency": f"with {_STORED} select gram, count(*) as df from grams group by gram",
        "stop_grams": f"with {_STORED} select gram, count(*) as df from grams group by gram having count(*) > 300",
        "ngram_candidates_topk": f"with {_STORED}, {_SHARED} select pos_a, pos_b, shared from top",
        "jaccard_pairs": f"with {_STORED}, {_JACCARD}",
        "similarity_scored": f"with recursive {_scored(_ALL_SHARED)} {_SIDES} from scored s {_SIDES_OF} where s.similarity >= s.threshold",
        "similarity_excluded": f"""
with recursive {_EXCLUDED} {_SIDES}, x.score is not null and y.score is not null as excluded,
  case when x.score is not null and y.score is not null then printf('两侧均匹配排除文件：%s (%.2f) / %s (%.2f)', x.exclude_file, x.score, y.exclude_file, y.score) end as exclude_reason
from found s {_SIDES_OF} left join best x on x.case_id = s.case_id and x.pos = s.pos_a left join best y on y.case_id = s.case_id and y.pos = s.pos_b""",
        "exclude_exact": """
with e as (select case_id, normalized, min(pos) as exclude_pos from text_units where normalized <> '' and comparable and group_index < 0 group by case_id, normalized)
select distinct u.case_id, u.pos, u.unit_id, e.exclude_pos from text_units u join e on u.case_id = e.case_id and u.normalized = e.normalized where u.comparable and u.group_index >= 0""",
        "keyword_alerts": f"""
with {_TEXTS}, {_WORDS},
hits as (select case_id, group_name, keyword, (length(lower(text)) - length(replace(lower(text), lower(keyword), ''))) // length(keyword) as n from texts, words)
select case_id, keyword, array_to_string(list_sort(list_distinct(list(group_name))), '|') as group_names, cast(sum(n) as bigint) as n_hits from hits where n > 0
group by case_id, keyword having count(distinct group_name) >= 2""",
        "regex_shared_values": f"""
with {_TEXTS}, hits as (select case_id, group_name, unnest(regexp_extract_all(text, '(?i)[A-Z]{{2}}-[0-9]{{4}}')) as canonical from texts)
select case_id, canonical, array_to_string(list_sort(list_distinct(list(group_name))), '|') as group_names, count(*) as n_hits from hits
group by case_id, canonical having count(distinct group_name) >= 2""",
        "stored_keyword_alerts": """
select case_id, keyword, is_regex, case when is_regex then matched_text else lower(keyword) end as canonical, count(distinct group_name) as n_groups, count(*) as n_hits
from keyword_hits where group_name is not null group by all having count(distinct group_name) >= 2""",
        "metadata_alerts": f"""
with {_META} select case_id, field, level, key, array_to_string(list_sort(list_distinct(list(group_name))), '|') as group_names, count(*) as n_hits from keyed
where key <> '' and not (kind = 'v' and key in ('admin', 'administrator', 'default', 'kingsoft office', 'microsoft corporation', 'microsoft office user', 'n/a', 'none', 'python-docx', 'unknown', 'user', 'wps office'))
  and not (kind = 't' and key = '2013-12-23 23:15') group by case_id, field, level, key having count(distinct group_name) >= 2""",
        "metadata_alerts_across_runs": f"""
with {_META} select field, level, key, array_to_string(list_sort(list_distinct(list(group_name))), '|') as group_names, count(*) as n_hits from keyed
where key <> '' and not (kind = 'v' and key in ('admin', 'administrator', 'default', 'kingsoft office', 'microsoft corporation', 'microsoft office user', 'n/a', 'none', 'python-docx', 'unknown', 'user', 'wps office'))
  and not (kind = 't' and key = '2013-12-23 23:15') group by field, level, key having count(distinct group_name) >= 2""",
        "image_exact_duplicates": f"""
with {_IMAGES} select case_id, sha256, array_to_string(list_sort(list_distinct(list(group_name))), '|') as group_names, count(*) as n_images from images
where sha256 is not null group by case_id, sha256 having count(distinct group_name) >= 2""",
        "image_exact_across_runs": f"""
with {_IMAGES} select sha256, array_to_string(list_sort(list_distinct(list(group_name))), '|') as group_names, count(*) as n_images from images
where sha256 is not null group by sha256 having count(distinct group_name) >= 2""",
        "image_near_duplicates": f"""
with {_IMAGES},
shared as (select case_id, sha256 from images where sha256 is not null group by case_id, sha256 having count(distinct group_name) >= 2),
known as (select distinct a.case_id, least(a.image_id, b.image_id) as lo, greatest(a.image_id, b.image_id) as hi from images a join images b on a.case_id = b.case_id and a.sha256 = b.sha256 and a.ord <> b.ord
  join shared s on s.case_id = a.case_id and s.sha256 = a.sha256),
near as (select a.case_id, a.ord as a, b.ord as b, least(a.image_id, b.image_id) as lo, greatest(a.image_id, b.image_id) as hi,
  bit_count(xor(cast('0x' || a.ahash as ubigint), cast('0x' || b.ahash as ubigint))) as distance
  from images a join images b on a.case_id = b.case_id and a.ord < b.ord and a.group_name <> b.group_name where a.ahash is not null and b.ahash is not null)
select case_id, a, b, cast(distance as bigint) as distance from near anti join known using (case_id, lo, hi) where distance <= 6""",
        "image_near_across_runs": f"""
with {_IMAGES},
shared as (select sha256 from images where sha256 is not null group by sha256 having count(distinct group_name) >= 2),
known as (select distinct least(a.image_id, b.image_id) as lo, greatest(a.image_id, b.image_id) as hi from images a join images b on a.sha256 = b.sha256 and a.ord <> b.ord
  join shared s on s.sha256 = a.sha256),
near as (select a.ord as a, b.ord as b, least(a.image_id, b.image_id) as lo, greatest(a.image_id, b.image_id) as hi,
  bit_count(xor(cast('0x' || a.ahash as ubigint), cast('0x' || b.ahash as ubigint))) as distance
  from images a join images b on a.ord < b.ord and a.group_name <> b.group_name where a.ahash is not null and b.ahash is not null)
select a, b, cast(distance as bigint) as distance from near anti join known using (lo, hi) where distance <= 20""",
        "hamming_near_pairs": """
with bits as (select vec_id, list_transform(embedding[1:64], lambda x: x > 0) as s from embeddings where embedding is not null),
b as (select vec_id, cast(array_to_string(list_transform(s, lambda x: case when x then '1' else '0' end), '') as bit) as v from bits)
select x.vec_id as a, y.vec_id as b, cast(bit_count(xor(x.v, y.v)) as bigint) as distance from b x join b y on x.vec_id < y.vec_id where bit_count(xor(x.v, y.v)) <= 16""",
        "pair_summary": f"with {_PAIRS} select * exclude (avg_similarity) from pairs",
        "all_group_pairs": f"""
with {_PAIRS}, {_FILES},
g as (select distinct case_id, group_index, group_name from files where group_index >= 0)
select a.case_id, a.group_name as group_a, b.group_name as group_b, coalesce(match_count, 0) as match_count, coalesce(excluded_count, 0) as excluded_count, coalesce(max_similarity, 0.0) as max_similarity
from g a join g b on a.case_id = b.case_id and a.group_index < b.group_index
left join pairs p on p.case_id = a.case_id and p.group_a = least(a.group_name, b.group_name) and p.group_b = greatest(a.group_name, b.group_name)""",
        "document_summary": f"""
with {_UNITS} select doc_id, count(*) as unit_count, count(*) filter (comparable) as comparable_unit_count, count(*) - count(*) filter (comparable) as short_filtered_unit_count from units group by doc_id""",
        "run_stats": f"""
with {_FILES}, {_UNITS}, {_MATCHES},
d as (select case_id, count(*) filter (group_index >= 0) as document_count, count(*) filter (group_index < 0) as exclude_document_count, count(distinct group_index) filter (group_index >= 0) as group_count from files group by case_id),
u as (select case_id, count(*) as unit_count, count(*) filter (comparable) as comparable_unit_count from units where group_index >= 0 group by case_id),
m as (select case_id, count(*) filter (not excluded) as similar_match_count, count(*) filter (excluded) as excluded_match_count from matches group by case_id)
select case_id, document_count, exclude_document_count, group_count, coalesce(unit_count, 0) as unit_count, coalesce(comparable_unit_count, 0) as comparable_unit_count,
  coalesce(similar_match_count, 0) as similar_match_count, coalesce(excluded_match_count, 0) as excluded_match_count, coalesce(unit_count, 0) - coalesce(comparable_unit_count, 0) as short_filtered_unit_count
from d left join u using (case_id) left join m using (case_id)""",
        "sampled_matches": f"""
with {_MATCHES},
a as (select *, row_number() over (partition by case_id, least(group_a, group_b), greatest(group_a, group_b) order by similarity desc, match_id) as k from matches where not excluded and similarity is not null),
b as (select *, row_number() over (partition by case_id order by similarity desc, match_id) as t from a where k <= 20)
select case_id, match_id, similarity from b where t <= 160""",
        "unit_annotations": f"""
with {_MATCHES}, ok as (select * from matches where unit_id_a is not null and unit_id_b is not null),
ends as (select case_id, unit_id_a as unit_id, similarity, excluded from ok union all select case_id, unit_id_b, similarity, excluded from ok)
select case_id, unit_id, count(*) as n_refs, max(similarity) as max_similarity, bool_and(excluded) as all_excluded from ends group by case_id, unit_id""",
    }
