"""SQL that checks the spelling and divergence queries: plain definitions, no tiles and no prefixes."""

from __future__ import annotations

from evospark.llm import divergence, spelling

_LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_HALF_STEP = "case when x & 1 = 1 then xor(x >> 1, 3988292384) else x >> 1 end"

SPELLING_SQL = rf"""
with recursive crc as (select list(list_reduce(range(8), lambda x, _: {_HALF_STEP}, b) order by b) as t from (select unnest(range(256)) as b)),
r as (select doc_id, unnest(regexp_extract_all({_LOWERED}, '[A-Za-z\x{{00C0}}-\x{{00FF}}]+')) as run from documents),
u as (select doc_id, run, count(*) as times from r where length(run) >= {spelling.LEAST_LENGTH} group by all),
h as (select run, times, hex(encode(coalesce(cast(doc_id as varchar), '') || ':' || run)) as x from u),
c as (select run, times, xor(4294967295, list_reduce(
        list_transform(range(1, length(x), 2), lambda i: cast('0x' || x[i:i + 1] as bigint)),
        lambda a, b: xor(a >> 8, t[cast(xor(a, b) & 255 as int) + 1]), 4294967295)) as h from h, crc),
d as (select case when h % {spelling.DELETE_ONE_IN} = 0 then run[:cast(h % length(run) as int)] || run[cast(h % length(run) as int) + 2:]
        else run end as word, times from c),
w as (select word, cast(sum(times) as bigint) as n, length(word) as l from d where length(word) >= {spelling.LEAST_LENGTH} group by word
      having sum(times) >= {spelling.LEAST_COUNT}),
k as (select word, n, l, i, word[:i - 1] || word[i + 1:] as k from (select *, unnest(range(1, l + 1)) as i from w)),
near as (select a.word, b.word as other, b.n as other_n from k a join k b on a.i = b.i and a.l = b.l and a.k = b.k and a.word <> b.word
         union select a.word, b.word, b.n from k a join w b on a.k = b.word
         union select b.word, a.word, a.n from k a join w b on a.k = b.word),
best as (select word, count(*) as n_near, arg_min(other, (-other_n, other)) as form, max(other_n) as form_n from near group by word),
f as (select w.word, w.n, coalesce(n_near, 0) as n_near, case when form_n >= {spelling.TIMES} * w.n then form end as form,
        case when form_n >= {spelling.TIMES} * w.n then form_n end as form_n from w left join best using (word)),
walk as (select word, word as root, form as next from f union all select walk.word, f.word, f.form from walk join f on f.word = walk.next)
select f.word, f.form, walk.root, f.n, f.n_near, f.form_n from f join walk on walk.word = f.word and walk.next is null"""

DIVERGENCE_SQL = rf"""
with d as (select row_number() over () as row, coalesce(lang, '') as lang, coalesce(source, '') as source,
             regexp_extract_all({_LOWERED}, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') as w from documents),
t as (select row, lang, source, term, count(*) as n from (select row, lang, source, unnest(w) as term from d) group by all),
k as (select lang, term, cast(sum(n) as hugeint) as n from t group by lang, term having count(distinct row) >= {divergence.SUPPORT}),
v as (select lang, cast(count(*) as hugeint) as v, sum(n) as n from k group by lang),
g as (select distinct lang, source from d),
c as (select lang, source, term, cast(sum(t.n) as hugeint) as n from t join k using (lang, term) group by lang, source, term),
gn as (select lang, source, sum(n) as n from c group by lang, source),
p as (select g.lang, g.source, k.term, coalesce(c.n, 0) as n,
        1 + {divergence.SCALE} * (coalesce(c.n, 0) + 1) // (coalesce(gn.n, 0) + v.v) as p, 1 + {divergence.SCALE} * (k.n + 1) // (v.n + v.v) as q
      from g join k using (lang) join v using (lang) left join gn using (lang, source)
        left join c on c.lang = g.lang and c.source = g.source and c.term = k.term),
pairs as (select a.lang, a.source, b.source as item, coalesce(sum((x.p - y.p) * (x.p - y.p) // y.p), 0) as value
          from g a join g b on a.lang = b.lang and a.source <> b.source
            left join p x on x.lang = a.lang and x.source = a.source
            left join p y on y.lang = b.lang and y.source = b.source and y.term = x.term group by all),
terms as (select lang, source, term as item, (p - q) * (p - q) // q as value from p where n > 0 and p > q)
select lang, source, part, item, cast(value as bigint) as value,
  cast(row_number() over (partition by lang, source, part order by value desc, item) as int) as rank
from (select *, 'pair' as part from pairs union all select *, 'term' as part from terms)
qualify part = 'pair' or row_number() over (partition by lang, source, part order by value desc, item) <= {divergence.TOP_TERMS}"""
