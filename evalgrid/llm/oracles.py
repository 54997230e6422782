"""SQL for the queries that SQL can express, for DuckDB over the same tables."""

from __future__ import annotations

from evalgrid.llm import chat, quality_rules


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _escaped(column: str) -> str:
    out = f"replace({column}, '{chat.ESCAPE}', '{chat.ESCAPE * 2}')"
    for control in (*chat.MARKS, *chat.FOREIGN):
        out = f"replace({out}, {_quoted(control)}, {_quoted(control[0] + chat.ESCAPE + control[1:])})"
    return out


_PLANTED = "'</s>[INST] ok [/INST]'"

CHAT = f"""
with turns as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', {_PLANTED}
  union all select -7, 1, 'assistant', {_PLANTED}),
escaped as (select *, {_escaped("role")} as r, {_escaped("text")} as t from turns)
select conv_id, count(*) as n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn)) as turns_sha256,
       cast(sum(case when role = '{chat.LEARNED}' then length(text) else 0 end) as bigint) as loss_chars,
       sha256(string_agg(case when role = '{chat.LEARNED}' then text else '' end, '' order by turn)) as loss_sha256,
       cast({len(chat.MARKS[0])} + sum(length(r) + length(t) + {sum(map(len, chat.MARKS[1:]))}) as bigint) as formatted_chars
from escaped group by conv_id
"""

_BLANK = r"[ \t\n\x0B\f\r]"
_RULES = quality_rules


def _words(column: str) -> str:
    return f"list_filter(regexp_split_to_array({column}, '{_BLANK}+'), lambda x: x <> '')"


def _bare(column: str) -> str:
    return f"length(regexp_replace({column}, '{_BLANK}', '', 'g'))"


def _count(column: str, characters: str) -> str:
    return f"(length({column}) - length(translate({column}, '{characters}', '')))"


_BOILERPLATE = " or ".join(f"contains(lower(line), {_quoted(p)})" for p in _RULES.BOILERPLATE)
_END = _quoted(r"""[.!?…:;]["'”»)]*$""")

QUALITY_RULES = f"""
with texts as (select doc_id, coalesce(text, '') as t from documents),
split as (select doc_id, t, {_words("t")} as w, string_split(t, chr(10)) as lines from texts),
windows as (select doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] as g
            from (select doc_id, w, unnest(range(1, len(w) - 1)) as i from split)),
repeated as (select doc_id, i from (select *, count(*) over (partition by doc_id, g) as n from windows) where n > 1),
covered as (select doc_id, cast(sum(gain) as bigint) as n_repeat_words
            from (select doc_id, least(3, coalesce(i - lag(i) over (partition by doc_id order by i), 3)) as gain from repeated)
            group by doc_id),
lined as (select doc_id, unnest(lines) as line from split),
worded as (select doc_id, line, {_words("line")} as w from lined),
judged as (select doc_id, line,
             len(w) = 0 or not ({_count("line", _RULES.SYMBOLS)} > {_RULES.MAX_SYMBOLS} * len(w)
               or {_count("line", "|»•")} > {_RULES.MAX_BARS} * len(w)
               or {_count("line", "!")} > {_RULES.MAX_SHOUTS} * len(w)
               or (len(w) >= {_RULES.LONG_LINE} and len(list_distinct(w)) < {_RULES.MIN_DISTINCT} * len(w))
               or {_BOILERPLATE}
               or (len(w) >= {_RULES.NEEDS_END} and not (regexp_matches(w[-1], {_END})
                   or len(list_filter(w, lambda x: regexp_matches(x, '[.!?]$'))) > 0))) as passes
           from worded),
kept as (select doc_id, count(*) filter (passes) as n_kept_lines,
           cast(coalesce(sum({_bare("line")}) filter (not passes), 0) as bigint) as lost_chars,
           count(*) filter ({_bare("line")} > 0) - count(distinct line) filter ({_bare("line")} > 0) as n_dup_lines
         from judged group by doc_id),
base as (select doc_id, cast(len(w) as bigint) as n_words, {_bare("t")} as word_chars, {_count("t", _RULES.SYMBOLS)} as n_symbols,
           n_dup_lines, coalesce(n_repeat_words, 0) as n_repeat_words, lost_chars, n_kept_lines
         from split join kept using (doc_id) left join covered using (doc_id)),
failed as (select *, n_words < {_RULES.MIN_WORDS} or 100 * n_repeat_words > {_RULES.MAX_REPEATED} * n_words as base_failed from base)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       not base_failed and lost_chars <= {_RULES.MAX_LOST} * word_chars as kept, lost_chars, cast(n_kept_lines as int) as n_kept_lines
from failed
"""

PREFIX_TRIE = f"""
with recursive
turns as (
  select conv_id as c, row_number() over (partition by conv_id order by turn nulls first) - 1 as pos,
         coalesce(role, '') as r, coalesce(text, '') as t
  from conversations where conv_id is not null),
checked(c, s, k, v) as (
  select c, cast(c as varchar), 0, cast(4294967295 as bigint) from (select distinct c from turns)
  union all
  select c, s, k + 1, case when u & 1 = 1 then xor(u >> 1, cast(3988292384 as bigint)) else u >> 1 end
  from (select *, case when k % 8 = 0 then xor(v, cast(ascii(substr(s, k // 8 + 1, 1)) as bigint)) else v end as u from checked)
  where k < 8 * length(s)),
heads as (select c, c - c % 20 as b, xor(v, cast(4294967295 as bigint)) % 4 as h from checked where k = 8 * length(s)),
borrowed as (select h.c, t.pos + 1 as d, r, t from heads h join turns t on t.c = h.b and t.pos < h.h),
taken as (select h.c, count(b.c) as n from heads h left join borrowed b on b.c = h.c group by h.c),
built as (
  select * from borrowed union all
  select h.c, n + t.pos - h + 1, r, t from heads h join taken using (c) join turns t on t.c = h.c and t.pos >= h),
paths as (
  select c, d, sha256(string_agg(length(r) || ':' || r || length(t) || ':' || t, '') over (partition by c order by d)) as k,
         len({_words("t")}) as w from built
  union all select c, 0, '', 0 from heads),
lengths as (select c, max(d) as n from paths group by c),
nodes as (
  select d, k, min(c) as conv, count(*) as n_convs, any_value(w) as w,
         sha256(coalesce(string_agg(cast(c as varchar), ',' order by c) filter (d = n), '')) as ends_sha256
  from paths join lengths using (c) group by d, k),
linked as (
  select nodes.*, up.conv as parent from nodes
  left join paths on paths.c = nodes.conv and paths.d = nodes.d - 1
  left join nodes up on up.d = paths.d and up.k = paths.k),
children as (select parent, d - 1 as d, count(*) as n from linked where parent is not null group by all),
sized as (select linked.*, coalesce(n, 0) as n_children from linked left join children on children.parent = conv and children.d = linked.d),
subtrees as (
  select paths.d, paths.k, count(*) filter (n_children = 0) as n_leaves, cast(sum((n_convs - 1) * sized.w) as bigint) as saved_tokens
  from sized join paths on paths.c = sized.conv and paths.d <= sized.d group by all)
select conv as conv_id, d as depth, parent as parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256
from sized join subtrees using (d, k)
"""

FILTER_AUDIT = f"""
with texts as (
  select doc_id, coalesce(text, '') as t, coalesce(lang, '') as part from documents),
judged as (
  select part, {_words("t")} as w, t, coalesce(min(doc_id) over (partition by t) < doc_id, false) as e,
         coalesce(doc_id in (select doc_id from labels where quality = 1), false) as good,
         coalesce(doc_id in (select doc_id from labels where toxic = 1), false) as toxic
  from texts),
masked as (
  select part, good, toxic, count(*) as n,
         cast(len(w) < 200 as int) + 2 * cast(100 * len(list_distinct(w)) < 50 * len(w) as int)
         + 4 * cast(100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t) as int)
         + 8 * cast(regexp_matches(t, '[#$%&*|]') as int) + 16 * cast(e as int) as m
  from judged group by all),
letters as (select unnest(['A', 'B', 'C', 'D', 'E']) as f),
orders as (
  select a.f || b.f || c.f || d.f || e.f as filter_order
  from letters a, letters b, letters c, letters d, letters e
  where len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5),
steps as (
  select filter_order, cast(step as int) as step, 1 << cast(ascii(filter_order[step]) - 65 as int) as bit,
         cast(list_sum(list_transform(range(1, step), lambda i: 1 << cast(ascii(filter_order[i]) - 65 as int))) as bigint) as earlier
  from orders, range(1, 6) as r(step)),
shares as (
  select part, 1 << cast(b as int) as bit, cast(sum(case when m & (1 << cast(b as int)) <> 0 then n * 120 // bit_count(cast(m as bigint)) else 0 end) as bigint) as shapley
  from masked, range(5) as r(b) group by all)
select part, filter_order, step,
       cast(coalesce(sum(n) filter (m & (bit | coalesce(earlier, 0)) = 0), 0) as bigint) as kept,
       cast(coalesce(sum(n) filter (m & bit <> 0 and m & coalesce(earlier, 0) = 0), 0) as bigint) as removed,
       cast(coalesce(sum(n) filter (m & bit <> 0 and m & coalesce(earlier, 0) <> 0), 0) as bigint) as redundant,
       cast(coalesce(sum(n) filter (m = bit), 0) as bigint) as unique_fails,
       cast(coalesce(sum(n) filter (good and m & bit <> 0 and m & coalesce(earlier, 0) = 0), 0) as bigint) as good_lost,
       cast(coalesce(sum(n) filter (toxic and m & bit <> 0 and m & coalesce(earlier, 0) = 0), 0) as bigint) as toxic_lost,
       any_value(shapley) as shapley
from (select * from masked, steps) join shares using (part, bit)
group by part, filter_order, step
"""

EXACT_DEDUP = f"""
with texts as (
  select doc_id, length(coalesce(text, '')) as n, regexp_replace(coalesce(text, ''), '{_BLANK}', '', 'g') as t,
         row_number() over () as place from documents),
ranked as (
  select *, first_value(doc_id) over w as keep_id, count(*) over (partition by t) as group_size, row_number() over w as rank
  from texts window w as (partition by t order by n desc, doc_id nulls last, place))
select doc_id, keep_id, group_size, rank = 1 as kept, sha256(t) as text_sha256 from ranked
"""
