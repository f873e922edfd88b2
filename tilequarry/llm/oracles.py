"""DuckDB SQL of the queries that SQL can express.

No SQL: op1 (a Bloom filter's answers), op2 (pivotal rounding), op5 (approximate search), op6
(trained trees), op8 (byte-pair merges), and op4 and op7, whose byte and code point spans are
tested against brute force in tests/llm.
"""

from __future__ import annotations

from tilequarry.llm import quality, sharding

_BLANK = r"\x20\x09-\x0D"
_WORDS = f"regexp_extract_all(coalesce(text,''),'[^{_BLANK}]+')"

_UPPER = "".join(chr(c) for c in range(65, 91))

NEAR_DUPLICATES = f"""
with recursive w as (select row_number() over () rid, doc_id, regexp_extract_all(translate(coalesce(text,''),'{_UPPER}','{_UPPER.lower()}'),'[^{_BLANK}]+') ws from documents),
tok as (select rid, unnest(ws) w1, generate_subscripts(ws,1) i from w),
five as (select rid, w1||' '||lead(w1,1) over p||' '||lead(w1,2) over p||' '||lead(w1,3) over p||' '||lead(w1,4) over p x from tok window p as (partition by rid order by i)),
el as (select distinct rid, x from (select rid, x from five where x is not null union all select rid, array_to_string(ws,' ') from w where len(ws) between 1 and 4)),
n as (select w.rid, any_value(doc_id) doc_id, count(x)::bigint n from w left join el using (rid) group by 1),
links as (select a.rid l, b.rid r from el a join el b on a.x=b.x and a.rid<>b.rid join n na on na.rid=a.rid join n nb on nb.rid=b.rid group by 1,2,na.n,nb.n having 100*count(*)>=75*(na.n+nb.n-count(*))),
reach as (select rid a, rid b from n union select reach.a, links.r from reach join links on links.l=reach.b),
comp as (select a, min(doc_id) c from reach join n on n.rid=reach.b group by a)
select n.doc_id, n.n n_shingles, c component_id, n.doc_id=c kept from n join comp on comp.a=n.rid
"""


def _quality() -> str:
    left = lambda others: f"length(regexp_replace(t,'{others}','','g'))"
    known = [left("[^A-ZÀ-ÖØ-Þ]+"), left("[^0-9]+"), left(r"[^.,;:!?''\"()\-]+".replace('\\"', '"')), left("[^#*$%&|<>]+"), left(r"[\x00-\x7FÀ-ÖØ-Þ]+"), "length(t)-wc"]
    words = "[" + ",".join(f"'{w}'" for w in quality.VOCABULARY) + "]"
    none = f"[{'0,' * len(quality.VOCABULARY)}1]"
    js = lambda p, q: f"sqrt(greatest(0.0,list_sum(list_transform(list_zip(list_transform({p},lambda x: x/list_sum({p})::double),list_transform({q},lambda x: x/list_sum({q})::double)), lambda z: (case when z[1]>0 then z[1]*log2(z[1]/((z[1]+z[2])/2)) else 0 end+case when z[2]>0 then z[2]*log2(z[2]/((z[1]+z[2])/2)) else 0 end)/2))))"
    return f"""
with w as (select row_number() over () rid, doc_id, lang, coalesce(text,'') t, {_WORDS} ws from documents),
b as (select *, len(ws)::bigint n, length(array_to_string(ws,''))::bigint wc, list_filter(ws, lambda x: list_contains({words}, x)) hits from w),
k as (select *, [{','.join(known)}]::bigint[] kn, list_append(list_transform({words}, lambda v: len(list_filter(hits, lambda x: x=v)))::bigint[], (n-len(hits))::bigint) cw from b),
h as (select *, list_append(kn, (length(t)-list_sum(kn))::bigint) cc from k),
bins as (select lang, unnest(list_concat(cc,cw)) v, generate_subscripts(list_concat(cc,cw),1) pos from h where n>={quality.MIN_WORDS}),
sums as (select lang, pos, sum(v)::bigint v, count(*) docs from bins group by 1,2 having count(*)>={quality.MIN_REFERENCE}),
refs as (select lang, list(v order by pos) a from sums group by 1),
whole as (select list(v order by pos) a from (select pos, sum(v)::bigint v from bins group by 1)),
tok as (select rid, unnest(ws) wd, generate_subscripts(ws,1) i from w),
g as (select rid, i, wd, lead(wd,1) over p w2, lead(wd,2) over p w3 from tok window p as (partition by rid order by i)),
gg as (select rid, i, count(*) over (partition by rid, wd, w2, w3) c from g where w3 is not null),
rep as (select rid, count(distinct p)::bigint r from (select rid, unnest([i,i+1,i+2]) p from gg where c>1) group by rid),
lines as (select rid, (count(*)-count(distinct l))::bigint d from (select rid, unnest(string_split(t,chr(10))) l from w) where regexp_matches(l,'[^{_BLANK}]') group by rid),
j as (select h.*, coalesce(r,0) r, coalesce(d,0) d, coalesce(refs.a,whole.a)[1:{len(quality.CLASSES)}] rc, case when refs.a is not null then refs.a[{len(quality.CLASSES) + 1}:] when whole.a is not null then [(list_sum(whole.a[{len(quality.CLASSES) + 1}:])-whole.a[-1])::bigint, whole.a[-1]] end rw, case when refs.a is not null then cw else [(list_sum(cw)-cw[-1])::bigint, cw[-1]] end dwh, case when refs.a is not null then {none} else [0,1] end::bigint[] bareh from h left join rep using (rid) left join lines using (rid) left join refs on refs.lang is not distinct from h.lang, whole),
f as (select *, n<{quality.MIN_WORDS} or 100*r>50*n base_failed, case when n>0 and rc is not null then {js('cc', 'rc')} end dc, case when n>0 and rw is not null then {js('dwh', 'rw')} end dw, case when rw is not null then {js('bareh', 'rw')} end bare, n*(list_sum(rw)-rw[-1])>={quality.EXPECTED}*list_sum(rw) expected from j)
select doc_id, n n_words, wc word_chars, kn[4] n_symbols, d n_dup_lines, r n_repeat_words, base_failed, not base_failed and not coalesce(dc>{quality.MAX_CLASS_DISTANCE},false) and not coalesce(expected and dw>={quality.WORDLESS}*bare,false) kept from f
"""


#: Sizes, checksums (a fold over bytes with the table of the polynomial 0xEDB88320), jumps, and slots by the order inside shards.
SHARDING = f"""
with recursive bits as (select range n, range::ubigint c, 0 s from range(256) union all select n, case when c&1=1 then xor(c>>1, 3988292384::ubigint) else c>>1 end, s+1 from bits where s<8),
crc as (select list(c order by n) t from bits where s=8),
d as (select row_number() over () rid, doc_id, encode(coalesce(text,'')) raw from documents),
x as (select rid, doc_id, octet_length(raw)::bigint+8 size, xor(list_reduce(list_transform(range(octet_length(raw)), lambda i: ('0x'||hex(raw)[2*i+1:2*i+2])::ubigint), lambda a, b: xor(a>>8, t[(xor(a,b)&255::ubigint)::bigint+1]), 4294967295::ubigint), 4294967295::ubigint)::bigint text_crc32 from d, crc),
go as (select rid, case when coalesce(doc_id,0)<0 then doc_id::hugeint+18446744073709551616 else coalesce(doc_id,0)::hugeint end k, -1::bigint b, 0::bigint j from x
 union all select rid, k2, j, floor((j+1)::double*({sharding.STEP}/((k2//8589934592)+1)::double))::bigint from (select *, (k*{sharding.MULTIPLIER}+1)%18446744073709551616 k2 from go where j<24)),
last as (select rid, b, j from go where j>=24)
select doc_id, size, text_crc32, 'key' as law, b::int shard, (row_number() over (partition by b order by doc_id nulls first, text_crc32, size)-1)::bigint slot, (case when j=24 then 24 else b end)::int grown_shard from x join last using (rid)
"""

ORACLES: dict[str, str] = {"op3_near_duplicates": NEAR_DUPLICATES, "op9_quality": _quality(), "op10_sharding": SHARDING}
