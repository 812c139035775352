"""DuckDB SQL with the results of the queries that SQL can express."""

from __future__ import annotations

#: Words, the sizes of sources, their targets and the words taken, of any relation ``docs``.
MIX = r"""
sized as (select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as size, md5(coalesce(doc_id::varchar, '')) as ord from docs),
sources as (select source, sum(size)::bigint as source_size, row_number() over (order by source asc nulls last) - 1 as rank from sized group by source),
caps as (select *, [1.0::double, 2.0::double, 3.0::double][rank % 3 + 1] as weight, (source_size * 3)::double as cap from sources),
levels as (select *, ((sum(source_size) over ())::double - coalesce(sum(cap) over (order by cap / weight, rank rows between unbounded preceding and 1 preceding), 0))
    / (sum(weight) over (order by cap / weight, rank rows between current row and unbounded following)) as level from caps),
goals as (select source, rank, source_size, least(cap, max(level) over () * weight) as target, floor(least(cap, max(level) over () * weight) + 0.5)::bigint as stream from levels),
placed as (select s.doc_id, s.size, g.source_size, g.target, g.rank, g.stream,
    coalesce(sum(s.size) over (partition by g.rank order by s.ord, s.doc_id, s.size rows between unbounded preceding and 1 preceding), 0)::bigint as before
    from sized s join goals g on s.source is not distinct from g.source),
mixed as (select *, case when source_size > 0 then size * (stream // source_size) + greatest(0, least(size, stream % source_size - before)) else 0 end::bigint as taken,
    case when stream > 0 then before / stream end as share from placed)
"""

OP5 = (
    "with docs as (select doc_id, source, text from documents),"
    + MIX
    + """
select doc_id, size, source_size, target, taken, case when taken > 0 then case rank % 3
    when 0 then 2 * share / (1 + sqrt(1.0))
    when 1 then 2 * share / (1.5 + sqrt(2.25 - 2 * share))
    else 2 * share / (0.5 + sqrt(0.25 + 2 * share)) end end as position
from mixed
"""
)

OP1 = """
with vectors as (
    select vec_id, [floor(64 * x::double) for x in embedding] as v from embeddings
    where vec_id is not null and embedding is not null and len([x for x in embedding if x is null or not isfinite(x)]) = 0),
scores as (
    select q.vec_id as query_id, c.vec_id, list_inner_product(q.v, c.v)::bigint as score
    from vectors q join vectors c on q.vec_id <> c.vec_id where q.vec_id % 20 = 0),
ranked as (select query_id, (row_number() over (partition by query_id order by score desc, vec_id))::int as rank, vec_id, score from scores)
select * from ranked where rank <= 20
"""

#: The four measures that the sketches hold, per mille or in tenths.
RATES = {
    "symbol": "1000 * n_symbols // greatest(word_chars, 1)",
    "dup_line": "1000 * n_dup_lines // greatest(n_lines, 1)",
    "repeat": "1000 * n_repeat_words // greatest(n_words, 1)",
    "word_len": "10 * word_chars // greatest(n_words, 1)",
}


def quality(spreads: dict[str, tuple[int, int]], guards: dict[str, int], stretch: int, prior: int) -> str:
    """Measures, histogram sketches by language and source, fences and the verdict."""
    rules = " union all ".join(f"select lang, source, '{k}' as rule, {v} as v from measured where not base_failed" for k, v in RATES.items())
    low, high, guard = ("case rule " + " ".join(f"when '{k}' then {v}" for k, v in found.items()) + " end" for found in ({k: v[0] for k, v in spreads.items()}, {k: v[1] for k, v in spreads.items()}, guards))
    ends = [f"{k}_{c}" for k in spreads for c in ("low", "high")]
    fences = ", ".join(f"max({c}_fence) filter (rule = '{k}')::bigint as {k}_{c}" for k in spreads for c in ("low", "high"))
    inside = " and ".join(f"{v} between {k}_low and {k}_high" for k, v in RATES.items())
    reached = ", ".join(f"min(b) filter (upto * 100 >= total * ({share})) as {c}" for c, share in (("low", low), ("mid", "50"), ("high", high)))
    top = lambda b: f"case when {b} < 64 then {b} else (({b} - 64) % 32 + 33 << (({b} - 64) // 32 + 1)) - 1 end"
    tops = ", ".join(f"{top(c)} as {c}" for c in ("low", "mid", "high"))
    drawn = ", ".join(f"(total * least(o.{c}, 2 * m.{c} + {guard.replace('rule', 'o.rule')}) + {prior} * m.{c}) // (total + {prior}) as {c}" for c in ("low", "mid", "high"))
    return rf"""
with docs as (
    select row_number() over () as id, doc_id, lang, source, coalesce(text, '') as t,
        regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w,
        list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as lines from documents),
places as (select id, w, unnest(range(1, len(w) - 3)) as i from docs where len(w) >= 5),
grams as (select id, i, count(*) over (partition by id, w[i], w[i + 1], w[i + 2], w[i + 3], w[i + 4]) as n from places),
repeats as (select id, count(distinct i + k) as n from grams, range(0, 5) r(k) where n > 1 group by id),
counted as (
    select docs.id, doc_id, lang, source, len(w) as n_words, length(array_to_string(w, '')) as word_chars,
        len(regexp_extract_all(t, '[#*$%&|<>]')) as n_symbols, len(lines) as n_lines, len(lines) - len(list_distinct(lines)) as n_dup_lines,
        coalesce(repeats.n, 0) as n_repeat_words from docs left join repeats using (id)),
measured as (select *, n_words < 10 or 100 * n_repeat_words > 20 * n_words as base_failed from counted),
rated as ({rules}),
bins as (select lang, source, rule, case when v < 64 then v else 64 + (length(bin(v)) - 7) * 32 + (v >> (length(bin(v)) - 6)) - 32 end as b, count(*) as n from rated group by all),
run as (select *, sum(n) over (partition by lang, source, rule order by b) as upto, sum(n) over (partition by lang, source, rule) as total from bins),
own_bins as (select lang, source, rule, {reached}, max(total)::bigint as total from run group by lang, source, rule),
own as (select lang, source, rule, total, {tops} from own_bins),
pooled as (select rule, b, sum(n) as n from bins group by all),
pooled_run as (select *, sum(n) over (partition by rule order by b) as upto, sum(n) over (partition by rule) as total from pooled),
merged_bins as (select rule, {reached} from pooled_run group by rule),
merged as (select rule, {tops} from merged_bins),
drawn as (select o.lang, o.source, o.rule, {drawn} from own o join merged m using (rule)),
limits as (select *, low - {stretch} * (mid - low) - ({guard}) as low_fence, high + {stretch} * (high - mid) + ({guard}) as high_fence from drawn),
wide as (select lang, source, {fences} from limits group by all)
select doc_id, n_words::bigint as n_words, word_chars::bigint as word_chars, n_symbols::bigint as n_symbols, n_dup_lines::bigint as n_dup_lines,
    n_repeat_words::bigint as n_repeat_words, base_failed, coalesce(not base_failed and {inside}, false) as kept, {", ".join(ends)}
from measured m left join wide x on m.lang is not distinct from x.lang and m.source is not distinct from x.source
"""


OP9 = r"""
with lines as (select doc_id, text, unnest(string_split(text, chr(10))) as line, unnest(range(0, len(string_split(text, chr(10))))) as k from documents where doc_id is not null),
worded as (select doc_id, k, list_sort(list_distinct(regexp_extract_all(line, '[^\x20\x09-\x0D]+'))) as s from lines),
firsts as (select s, min((doc_id, k)) as first, row_number() over () as id from worded where len(s) > 0 group by s),
members as (select f.id, m.doc_id, m.k, f.first from worded m join firsts f using (s)),
words as (select id, len(s) as n, first, unnest(s) as w from firsts),
counts as (select w, count(*) as c from words group by w),
placed as (select id, n, first, w, row_number() over (partition by id order by c, w) as place from words join counts using (w)),
prefixes as (select * from placed where place <= n - ceil(0.8 * n - 1e-9) + 1),
pairs as (select distinct a.id as a, b.id as b from prefixes a join prefixes b on a.w = b.w and a.first < b.first and least(a.n, b.n) >= 0.8 * greatest(a.n, b.n) - 1e-9),
alike as (select distinct p.b as id from pairs p join firsts x on x.id = p.a join firsts y on y.id = p.b where len(list_intersect(x.s, y.s)) >= 0.8 / 1.8 * (len(x.s) + len(y.s)) - 1e-9),
gone as (select doc_id, k from members where (doc_id, k) <> first or id in (select id from alike)),
kept as (select l.doc_id, count(*) as n_lines, count(g.k) as n_removed, coalesce(string_agg(l.k::varchar, ',' order by l.k) filter (g.k is not null), '') as removed,
    coalesce(string_agg(l.line, chr(10) order by l.k) filter (g.k is null), '') as text from lines l left join gone g on g.doc_id = l.doc_id and g.k = l.k group by l.doc_id)
select doc_id, n_lines::bigint as n_lines, n_removed::bigint as n_removed, removed, text from kept
"""
