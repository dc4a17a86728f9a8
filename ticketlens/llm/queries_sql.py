"""SQL over the source tables for the operators that SQL can state."""

from __future__ import annotations

WORDS = r"len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))"

OP1_EXACT_DEDUP = r"""
with docs as (
  select doc_id, length(coalesce(text, '')) as points,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') as plain
  from documents
)
select doc_id,
       first_value(doc_id) over best as keep_id,
       count(*) over (partition by plain) as group_size,
       row_number() over best = 1 as kept,
       sha256(plain) as text_sha256
from docs
window best as (partition by plain order by points desc, doc_id nulls last)
"""

OP2_MIXING = f"""
with docs as (
  select doc_id, source, {WORDS} as size,
         cast('0x' || substr(md5('mix-1|' || coalesce(cast(doc_id as varchar), '')), 1, 9) as bigint) as h
  from documents
), totals as (
  select source, sum(size)::bigint as total from docs group by source
), ranked as (
  select source, total, 3 * total as cap,
         [5, 2, 1][1 + (row_number() over (order by source nulls last) - 1) % 3] as w
  from totals
), prefixes as (
  select *, row_number() over (order by cap / w, source nulls last) as k,
         sum(cap) over (order by cap / w, source nulls last) as cap_to,
         sum(w) over (order by cap / w desc, source desc nulls first) as w_from,
         sum(total) over () as everything
  from ranked
), levels as (
  select k, cap, w, (everything - coalesce(lag(cap_to) over (order by k), 0))::bigint
         / w_from::bigint as level
  from prefixes
), chosen as (
  select level from levels where cap > w * level order by k limit 1
), targets as (
  select source, total,
         least(cap::double, w * coalesce((select level from chosen), 0.0)) as target
  from ranked
), planned as (
  select *, case when total > 0 then floor(target / total) else 0 end as whole from targets
), placed as (
  select d.doc_id, d.size, p.total, p.target, p.whole, p.target - p.whole * p.total as rest, d.h,
         coalesce(sum(d.size) over (partition by d.source order by d.h
                                    range between unbounded preceding and current row), 0)
         - sum(d.size) over (partition by d.source, d.h) as before,
         sum(d.size) over (partition by d.source, d.h) as at_h
  from docs d join planned p on d.source is not distinct from p.source
)
select doc_id, size, total as source_size, target,
       cast(size * (whole + case when rest > 0 and before + at_h / 2 <= rest
                            then 1 else 0 end) as bigint) as taken,
       cast(whole + case when rest > 0 and before + at_h / 2 <= rest
                    then 1 else 0 end as bigint) as repeats
from placed
"""


OP11_PREFIX_TRIE = r"""
with own as (
  select conv_id as c, list({'r': r, 't': t} order by turn nulls first, sha256(strlen(r) || ':' || r || t)) as turns
  from (select conv_id, turn, coalesce(role, '') as r, coalesce(text, '') as t
        from conversations where conv_id is not null)
  group by conv_id
), checked as (
  -- CRC-32 a bit at a time: every byte is followed by seven zeros.
  select *, xor(4294967295, list_reduce(
      flatten(list_transform(str_split(c::varchar, ''), lambda b: [ascii(b)::bigint, 0, 0, 0, 0, 0, 0, 0])),
      lambda a, x: xor(xor(a, x) >> 1, case when xor(a, x) & 1 = 1 then 3988292384 else 0 end),
      4294967295::bigint)) % 6 as h
  from own
), rebuilt as (
  select o.c, list_concat(coalesce(b.turns[1:o.h], []), o.turns[o.h + 1:]) as turns
  from checked o left join own b on b.c = o.c - o.c % 100
), prefixes as (
  select c, unnest(range(0, len(turns) + 1)) as d, turns, len(turns) as l from rebuilt
), named as (
  select c, d, l, length(turns[d].t) as chars,
         min(c) over (partition by d, turns[1:d]) as node,
         count(*) over (partition by d, turns[1:d]) as n
  from prefixes
), path as (
  select *, lag(node) over (partition by c order by d) as parent from named
), nodes as (
  select node, d, min(parent) as parent, min(n) as n, coalesce(min(chars), 0) as chars,
         sha256(coalesce(string_agg(case when l = d then c end::varchar, ',' order by c), '')) as ends
  from path group by node, d
), children as (
  select parent as node, d - 1 as d, count(*) as children from nodes where d > 0 group by all
), whole as (
  select nodes.*, coalesce(children, 0) as children from nodes left join children using (node, d)
), under as (
  select distinct a.node as top, a.d as top_d, b.node, b.d
  from path a join path b on a.c = b.c and b.d >= a.d
), sums as (
  select top as node, top_d as d, count(*) filter (w.children = 0) as leaves,
         sum((w.n - 1) * w.chars) as saved
  from under join whole w using (node, d) group by all
)
select node as conv_id, d as depth, parent as parent_conv_id, n as n_convs, children as n_children,
       leaves as n_leaves, saved::bigint as saved_tokens, ends as ends_sha256
from whole join sums using (node, d)
"""

OP12_RANKED_SEARCH = r"""
with terms as (
  select rowid as row, doc_id, unnest(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term
  from (select row_number() over () as rowid, * from documents)
), postings as (
  select row, doc_id, term, count(*) as tf from terms group by all
), lengths as (
  select row, sum(tf)::bigint as n from postings group by row
), corpus as (
  select count(*) as n_all, sum(n)::bigint as l_all from lengths
), weights as (
  select term, floor(1000 * ln((2 * n_all + 2)::double / (2 * count(*) + 1)::double))::bigint as w
  from postings, corpus group by term, n_all
), items as (
  select distinct row, item_id, unnest(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term
  from (select row_number() over () as row, * from benchmark)
), scores as (
  select i.row as item, i.item_id, p.row, p.doc_id,
         sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * n_all) // l_all))))::bigint as score
  from items i join postings p using (term) join weights using (term)
  join lengths on lengths.row = p.row, corpus
  group by all
), ranked as (
  select *, row_number() over (partition by item order by score desc, doc_id nulls last)::int as rank
  from scores where score > 0
)
select item_id, rank, doc_id, score from ranked where rank <= 50
"""


def sql() -> dict[str, str]:
    return {
        "op1_exact_dedup": OP1_EXACT_DEDUP,
        "op2_mixing": OP2_MIXING,
        "op11_prefix_trie": OP11_PREFIX_TRIE,
        "op12_ranked_search": OP12_RANKED_SEARCH,
    }
