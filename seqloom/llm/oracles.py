"""DuckDB SQL for the rows of the queries that SQL can state, written from their contracts, over whole tables and texts."""

from __future__ import annotations

from .chat import END, START

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SPACE_WORDS = r"[^\x20\x09-\x0D]+"
LETTER_WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: One row a turn, read back from the format as it went in; conversation -7 is added.
CHAT = rf"""
with turns as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '</s>[INST] ok [/INST]'
  union all select -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
safe as (
  select *,
    regexp_replace(regexp_replace(replace(text, '\', '\e'), '<(\||/?s>|</?SYS>>|/?unk>|/?pad>)', '\\l\1', 'g'), '\[(/?INST\]|/?TOOL)', '\\q\1', 'g') as safe_text,
    replace(regexp_replace(regexp_replace(replace(role, '\', '\e'), '<(\||/?s>|</?SYS>>|/?unk>|/?pad>)', '\\l\1', 'g'), '\[(/?INST\]|/?TOOL)', '\\q\1', 'g'), chr(10), '\n') as safe_role
  from turns)
select conv_id, count(*)::bigint as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text)) as turns_sha256,
  coalesce(sum(length(text)) filter (where role = 'assistant'), 0)::bigint as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn nulls first, role, text) filter (where role = 'assistant'), '')) as loss_sha256,
  sum(length(safe_text) + length(safe_role) + {len(START) + 1 + len(END)})::bigint as formatted_chars
from safe group by conv_id"""

#: Windows of items by their length, met with the windows of the same lengths of every text.
CONTAMINATION = rf"""
with d as (select row_number() over () as r, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{LETTER_WORDS}') as w from documents),
b as (select item_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{LETTER_WORDS}') as w from benchmark),
spots as (select item_id, w, least(len(w), 10) as k, unnest(range(1, len(w) - least(len(w), 10) + 2)) as i from b where len(w) > 0),
item as (select distinct item_id, k, array_to_string(w[i:i + k - 1], ' ') as win from spots),
wins as (select distinct k, win from item),
sizes as (select distinct k from item),
placed as (select r, w, k, unnest(range(1, len(w) - k + 2)) as i from d, sizes where len(w) >= k),
met as (select p.r, p.k, p.i, wins.win from (select r, k, i, array_to_string(w[i:i + k - 1], ' ') as win from placed) p join wins using (k, win)),
covered as (select r, count(distinct j) as n_hit from (select r, unnest(range(i, i + k)) as j from met) group by r),
found as (select r, count(*) as n_items, string_agg(item_id::varchar, ',' order by item_id::varchar) as ids from (select distinct r, item_id from met join item using (k, win) where item_id is not null) group by r)
select doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
  sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join covered using (r) left join found using (r)"""

#: Every window of 35 words of every text, counted; a word goes where a window over it starts more than once anywhere.
REPEATS = rf"""
with d as (select row_number() over () as r, doc_id, regexp_extract_all(coalesce(text, ''), '{SPACE_WORDS}') as w from documents),
starts as (select r, i, array_to_string(w[i:i + 34], ' ') as win from (select r, w, unnest(range(1, len(w) - 33)) as i from d where len(w) >= 35)),
twice as (select win from starts group by win having count(*) > 1),
marked as (select r, i, true as again from starts where win in (select win from twice)),
words as (select r, unnest(range(1, len(w) + 1)) as i, unnest(w) as word from d),
judged as (select words.r, words.i, word, coalesce(bool_or(again) over (partition by words.r order by words.i rows between 34 preceding and current row), false) as gone from words left join marked on words.r = marked.r and words.i = marked.i),
left_over as (select r, count(*) filter (where gone) as n_removed, string_agg(word, ' ' order by i) filter (where not gone) as kept from judged group by r)
select doc_id, len(w)::bigint as n_words, coalesce(n_removed, 0)::bigint as n_removed, sha256(coalesce(kept, '')) as kept_sha256 from d left join left_over using (r)"""

#: Distinct sets linked by their shared shingles; the components by a search that only goes to smaller labels.
NEAR_COPIES = rf"""
with recursive d as (select row_number() over () as r, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{SPACE_WORDS}') as w from documents),
sets as materialized (select r, doc_id, case when len(w) = 0 then []::varchar[] when len(w) < 5 then [array_to_string(w, ' ')]
  else list_sort(list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')))) end as s from d),
classes as materialized (select row_number() over () as c, s, len(s) as n, min(doc_id) as low from (select s, doc_id from sets where len(s) > 0) group by s),
shingles as materialized (select c, n, unnest(s) as g from classes),
pairs as materialized (select a.c as a, b.c as b from shingles a join shingles b on a.g = b.g and a.c < b.c and a.n * 100 >= b.n * 75 and b.n * 100 >= a.n * 75
  group by a.c, b.c, a.n, b.n having 100 * count(*) >= 75 * (a.n + b.n - count(*))),
both_ways as materialized (select a, b from pairs union all select b, a from pairs),
reach(c, low) as (select c, low from classes union select b, low from reach join both_ways on reach.c = a),
lows as (select c, min(low) as low from reach group by c)
select doc_id, len(sets.s)::bigint as n_shingles, case when len(sets.s) = 0 then doc_id else lows.low end as component_id
from sets left join classes on sets.s = classes.s left join lows using (c)"""
