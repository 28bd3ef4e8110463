"""SQL of the newer queries of this subpackage, with the CRC-32 that they need."""

from __future__ import annotations

#: CRC-32's table of the 256 byte values, by its rule (reversed polynomial 0xEDB88320), as one list.
CRC_TABLE = """crc_table as (
  select list(list_reduce([b, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: case when c & 1 = 1 then xor(3988292384, c >> 1) else c >> 1 end) order by b) as tab
  from (select unnest(range(256)) as b)
)"""


def crc_of(codes: str) -> str:
    """CRC-32 of a list of byte values, where ``crc_table`` is joined."""
    return f"xor(4294967295, list_reduce(list_prepend(4294967295, {codes}), lambda c, b: xor(tab[(xor(c, b) & 255) + 1], c >> 8)))"


MERKLE = f"""
with recursive {CRC_TABLE}, doc as (
  select *, coalesce({crc_of("list_transform(string_split(doc_id::varchar, ''), lambda x: ascii(x)::bigint)")} % 7 = 0, false) as hit
  from (select doc_id::bigint as doc_id, source, lang, n_chars::bigint as n_chars, text from documents), crc_table
), sized as (
  select doc_id, lang, n_chars, hit,
         coalesce(strlen(doc_id::varchar) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') as head,
         coalesce(strlen(text) || ':' || text, '-') as tail
  from doc
), leaf as (
  select doc_id, lang, sha256(head || coalesce(strlen(n_chars::varchar) || ':' || n_chars, '-') || tail) as leaf,
         sha256(head || coalesce(strlen((n_chars + hit::int)::varchar) || ':' || (n_chars + hit::int), '-') || tail) as claimed
  from sized
), placed as (
  select *, row_number() over (partition by lang order by doc_id nulls first, leaf) - 1 as pos, count(*) over (partition by lang) as n from leaf
), up as (
  select lang, 0 as lvl, pos, leaf as node, n from placed
  union all
  select lang, lvl + 1, pos // 2, sha256(string_agg(node, '' order by pos)), any_value((n + 1) // 2) from up where n > 1 group by lang, lvl, pos // 2
), subroot as (
  select lang, node, row_number() over (order by lang nulls first) - 1 as pos, count(*) over () as n from up where n = 1
), over_up as (
  select 0 as lvl, pos, node, n from subroot
  union all
  select lvl + 1, pos // 2, sha256(string_agg(node, '' order by pos)), any_value((n + 1) // 2) from over_up where n > 1 group by lvl, pos // 2
), height as (
  select lang, max(lvl) as h from up group by lang
), step as (
  select p.doc_id, p.leaf, l.lvl, (p.pos >> l.lvl) & 1 as odd, coalesce(s.node, '') as beside
  from placed p join height on height.lang is not distinct from p.lang join lateral (select unnest(range(height.h)) as lvl) l on true
  left join up s on s.lang is not distinct from p.lang and s.lvl = l.lvl and s.pos = xor(p.pos >> l.lvl, 1)
  union all
  select p.doc_id, p.leaf, 1000 + l.lvl, (r.pos >> l.lvl) & 1, coalesce(s.node, '')
  from placed p join subroot r on r.lang is not distinct from p.lang join lateral (select unnest(range((select max(lvl) from over_up))) as lvl) l on true
  left join over_up s on s.lvl = l.lvl and s.pos = xor(r.pos >> l.lvl, 1)
), proof as (
  select doc_id, leaf, list({{'odd': odd, 'beside': beside}} order by lvl) as steps from step group by doc_id, leaf
), folded as (
  select p.doc_id, p.leaf, r.node as subroot, (select node from over_up where n = 1) as root,
         sha256(coalesce(list_aggregate(list_transform(f.steps, lambda x: x.beside), 'string_agg', ''), '')) as proof_sha256,
         list_reduce(list_prepend({{'odd': 0::bigint, 'beside': p.claimed}}, coalesce(f.steps, [])),
                     lambda a, x: {{'odd': 0::bigint, 'beside': case when x.odd = 1 then sha256(x.beside || a.beside) else sha256(a.beside || x.beside) end}}).beside as folded_root
  from placed p join subroot r on r.lang is not distinct from p.lang left join proof f on f.doc_id is not distinct from p.doc_id and f.leaf = p.leaf
)
select *, folded_root = root as verified from folded
"""

#: UTF-8 bytes of a list of code points below 0x800.
_UTF8 = "flatten(list_transform(points, lambda p: case when p < 128 then [p] else [192 + (p >> 6), 128 + (p & 63)] end))"

SPELLING = f"""
with recursive {CRC_TABLE}, run as (
  select doc_id, unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\\x{{00C0}}-\\x{{00FF}}]+')) as raw from documents
), lowered as (
  select doc_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as run, count(*) as k
  from run where length(raw) >= 5 group by all
), coded as (
  select run, k, {crc_of(_UTF8)} as h
  from (select *, list_transform(string_split(doc_id || ':' || run, ''), lambda x: unicode(x)::bigint) as points from lowered), crc_table
), word as (
  select case when h % 97 = 0 then substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) else run end as word, k from coded
), vocab as (
  select word, sum(k)::bigint as n from word where length(word) >= 5 group by word having sum(k) >= 3
), cut as (
  select word, n, i, substr(word, 1, i) || substr(word, i + 2) as short, substr(word, 1, i) || '*' || substr(word, i + 2) as gap
  from (select word, n, unnest(range(length(word))) as i from vocab)
), near as (
  select a.word, b.word as other, b.n from cut a join cut b on a.gap = b.gap and a.word <> b.word
  union
  select c.word, v.word, v.n from cut c join vocab v on v.word = c.short
  union
  select v.word, c.word, c.n from cut c join vocab v on v.word = c.short
), best as (
  select word, count(*) as n_near, arg_min(other, (-n, other)) as other, max(n) as most from near group by word
), formed as (
  select v.word, v.n, coalesce(b.n_near, 0) as n_near, case when b.most >= 2 * v.n then b.other end as form, case when b.most >= 2 * v.n then b.most end as form_n
  from vocab v left join best b on b.word = v.word
), walk as (
  select word, word as here, 0 as steps from formed
  union all
  select w.word, f.form, w.steps + 1 from walk w join formed f on f.word = w.here where f.form is not null
), root as (
  select word, arg_max(here, steps) as root from walk group by word
)
select f.word, f.form, r.root, f.n, f.n_near, f.form_n from formed f join root r on r.word = f.word
"""

NGRAMS = f"""
with {CRC_TABLE}, doc as (
  select doc_id, coalesce({crc_of("list_transform(string_split(doc_id::varchar, ''), lambda x: ascii(x)::bigint)")} % 7 = 2, false) as held_out,
         list_append(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+'), '') as words
  from documents, crc_table
), token as (
  select doc_id, held_out, unnest(words) as c, unnest(range(len(words))) as pos from doc
), gram as (
  select *, coalesce(lag(c) over w, '<begin>') as b, coalesce(lag(c, 2) over w, '<begin>') as a from token window w as (partition by doc_id order by pos)
), one as (
  select c, count(*) as n from token where not held_out group by c
), total as (
  select sum(n)::bigint as train_tokens, count(*) as n_words, (select count(*) from doc where not held_out) as begins from one
), two as (
  select b, c, count(*) as n from gram where not held_out group by b, c
), three as (
  select a, b, c, count(*) as n from gram where not held_out group by a, b, c
), known as (
  select g.*, coalesce(o.n, 0) as n1, case when g.pos = 0 then t.begins else coalesce(ob.n, 0) end as nb, coalesce(t2.n, 0) as n2, coalesce(t3.n, 0) as n3,
         case when g.pos > 0 then coalesce(tc.n, 0) else 0 end as nc, t.train_tokens, (coalesce(o.n, 0) + 1.0::double) / (t.train_tokens + t.n_words + 1) as p1
  from gram g cross join total t left join one o on o.c = g.c left join one ob on ob.c = g.b left join two t2 on t2.b = g.b and t2.c = g.c
  left join three t3 on t3.a = g.a and t3.b = g.b and t3.c = g.c left join two tc on tc.b = g.a and tc.c = g.b
), coded as (
  select *, {{}} from known
), paired as (
  select *, case when nb > 0 then (1 - 1 / (1 + nb ** 0.3::double)) * least(q2 / nb, 1) + 1 / (1 + nb ** 0.3::double) * p1 else p1 end as p2 from coded
), judged as (
  select *, case when qc > 0 then (1 - 1 / (1 + qc ** 0.3::double)) * least(q3 / qc, 1) + 1 / (1 + qc ** 0.3::double) * p2 else p2 end as p3 from paired
)
select doc_id, held_out, count(*) as n_tokens, count(*) filter (where n1 > 0) as n_known, any_value(train_tokens) as train_tokens, sum(log10(p1)) as base_score, sum(log10(p3)) as score
from judged group by doc_id, held_out
""".format(", ".join(f"case when {n} < 128 then {n}::double else 128 * 2.0::double ** (round(4 * log2({n} / 128.0::double)) / 4) end as {q}" for n, q in (("n2", "q2"), ("n3", "q3"), ("nc", "qc"))))
