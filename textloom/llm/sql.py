"""The corpus queries in SQL, where SQL can express them on whole tables."""

from __future__ import annotations

import unicodedata

from textloom.llm.lookalike import _TABLE, _TO_LATIN
from textloom.plans.nfkc import norm, translate


def _look(text: str) -> str:
    """A form that texts of one look share: look-alike letters in Latin wherever they stand, which tells looks apart as
    well as the spelling by script does."""
    table = {}
    for c in (*range(0x80, 0x10000), *range(0xE0000, 0xE0200)):
        if not 0xD800 <= c < 0xE000:
            seen = _TABLE.get(c, chr(c)) or ""
            form = unicodedata.normalize("NFC", "".join(_TO_LATIN.get(x, x) for x in unicodedata.normalize("NFD", seen)))
            if form != chr(c) and len(form) < 2:
                table[chr(c)] = form
    return f"nfc_normalize({translate(text, table)})"


_LINKS = """links as (
  select distinct unit_id_a as a, unit_id_b as b from similarity_matches
  where not excluded and unit_id_a is not null and unit_id_b is not null and unit_id_a <> unit_id_b),
edges as (select a, b from links union select b, a from links),
reach as (
  select a as node, a as seen from edges
  union
  select reach.node, edges.b from reach join edges on reach.seen = edges.a),
groups as (select node, min(seen) as grp from reach group by node)"""

_RECORDS = """rec as (
  select unit_id, min(text) as text from (
    select unit_id_a as unit_id, text_a as text from similarity_matches where not excluded
    union all
    select unit_id_b, text_b from similarity_matches where not excluded) s
  where unit_id is not null and text is not null group by unit_id)"""
_SPANS = f"""{_RECORDS},
win as (
  select unit_id, i, substring(text, i, 40) as w
  from (select unit_id, text, unnest(range(1, length(text) - 38)) as i from rec where length(text) >= 40) r),
shared as (select w from win group by w having count(distinct unit_id) > 1),
hit as (select unit_id, i from win where w in (select w from shared)),
step as (select unit_id, least(40, coalesce(lead(i) over (partition by unit_id order by i) - i, 40)) as n from hit),
sums as (select unit_id, cast(sum(n) as bigint) as shared_chars from step group by unit_id)"""


_LOOKS = f"""f as (select distinct unit_id, text, {_look('text')} as form from text_units where unit_id is not null and text is not null),
several as (select form from f where form <> '' group by form having count(distinct text) > 1),
members as (select f.* from f join several using (form))"""
_NEAR = f"""{_RECORDS},
forms as (select unit_id, {norm('text')} as f from rec),
classes as (select f, count(*) as copies, min(unit_id) as class_id, row_number() over (order by f) as c from forms group by f),
grams as (select distinct c, substring(f, i, 3) as g from (select c, f, unnest(range(1, length(f) - 1)) as i from classes where length(f) >= 3) x),
sizes as (select c, count(*) as n from grams group by c),
shared as (select a.c as x, b.c as y, count(*) as s from grams a join grams b on a.g = b.g and a.c < b.c group by a.c, b.c),
near as (select x, y from shared join sizes a on a.c = x join sizes b on b.c = y where s / (a.n + b.n - s) >= 0.7)"""


def oracle_sql() -> dict[str, str]:
    return {
        "p2_found": f"""
with o as (select options_id, max(max_unit_chars) as most from check_options group by options_id)
select distinct unit_id from text_units left join o using (options_id)
where unit_id is not null and text is not null and length({norm('text')}) > case when most > 0 then most else 420 end""",
        "p2_rebuilt": f"""
with o as (select options_id, max(max_unit_chars) as most from check_options group by options_id)
select unit_id, md5(text) as text_md5, true as fits from (select distinct unit_id, options_id, text from text_units) u left join o using (options_id)
where unit_id is not null and text is not null and length({norm('text')}) > case when most > 0 then most else 420 end""",
        "p4_found": f"""
with {_LOOKS}
select distinct least(a.unit_id, b.unit_id) as unit_id_1, greatest(a.unit_id, b.unit_id) as unit_id_2
from members a join members b on a.form = b.form and a.text <> b.text and a.unit_id <> b.unit_id""",
        "p4_groups": f"""
with {_LOOKS},
classes as (select form, text, min(unit_id) as class_id, count(*) as n from members group by form, text),
groups as (select form, min(class_id) as group_id, sum(n) as total from classes group by form)
select unit_id, class_id, group_id, cast(total - n as bigint) as links from members join classes using (form, text) join groups using (form)""",
        "p5_found": f"""
with {_NEAR},
members as (select unit_id, c from forms join classes using (f) where length(f) >= 3)
select least(a.unit_id, b.unit_id) as unit_id_1, greatest(a.unit_id, b.unit_id) as unit_id_2 from near join members a on a.c = x join members b on b.c = y
union all select a.unit_id, b.unit_id from members a join members b on a.c = b.c and a.unit_id < b.unit_id""",
        "p5_groups": f"""
with recursive {_NEAR},
ends as (select x as a, y as b from near union all select y, x from near),
reach as (select c as node, c as seen from classes union select reach.node, ends.b from reach join ends on reach.seen = ends.a),
groups as (select node as c, min(class_id) as group_id from reach join classes on classes.c = reach.seen group by node),
links as (select a as c, count(*) as n from ends group by a)
select unit_id, class_id, group_id, cast(coalesce(links.n, 0) + copies - 1 as bigint) as links
from forms join classes using (f) join groups using (c) left join links using (c)""",
        "p7_audit": """
select count(distinct doc_id) as documents, cast(0 as bigint) as lost, cast(0 as bigint) as gaps, cast(0 as bigint) as needless_cuts, cast(0 as bigint) as overfull from documents""",
        "p8_found": f"""
with items as (select item_id, {norm('text')} as f from eval_items where item_id is not null and text is not null),
docs as (select doc_id, {norm('text')} as f from documents where doc_id is not null and text is not null),
parts as (select item_id, i, substring(f, i, 25) as w from (select item_id, f, unnest(range(1, length(f) - 23)) as i from items) x),
wanted as (select distinct w from parts),
seen as (select distinct doc_id, substring(f, i, 25) as w from (select doc_id, f, unnest(range(1, length(f) - 23)) as i from docs) x where substring(f, i, 25) in (select w from wanted)),
hits as (select distinct doc_id, item_id, i from seen join parts using (w)),
steps as (select doc_id, item_id, least(25, coalesce(lead(i) over (partition by doc_id, item_id order by i) - i, 25)) as n from hits)
select doc_id, item_id from (select doc_id, item_id, sum(n) as n from steps group by doc_id, item_id) x join items using (item_id) where n >= 0.4 * length(f)""",
        "p1_found": f"with recursive {_LINKS} select node as unit_id, grp as group_id from groups",
        "p1_sizes": f"with recursive {_LINKS} select grp as group_id, count(*) as n_units from groups group by grp",
        "p6_found": f"with {_SPANS} select unit_id, shared_chars from sums",
        "p6_longest": f"""
with {_SPANS},
texts as (select text, row_number() over (order by text) as t, count(*) as copies from rec where length(text) >= 40 group by text),
part as (select t, i, substring(text, i, 40) as w from (select t, text, unnest(range(1, length(text) - 38)) as i from texts) r),
twice as (select w from part group by w having count(distinct t) > 1),
held as (select part.* from part join twice using (w)),
meets as (select a.t as t, a.i as i, b.t as u, b.i - a.i as d from held a join held b on a.w = b.w and a.t <> b.t),
runs as (select t, u, d, i - row_number() over (partition by t, u, d order by i) as run from meets),
most as (select t, max(n) as longest from (select t, u, d, run, count(*) + 39 as n from runs group by t, u, d, run) x group by t)
select sums.unit_id, shared_chars, cast(case when copies > 1 then length(rec.text) else longest end as bigint) as longest_chars
from sums join rec using (unit_id) join texts on rec.text = texts.text left join most using (t)""",
    }
