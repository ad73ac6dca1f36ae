"""The registered queries of this subpackage, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .bpe import op4_bpe_encoding
from .chat import op10_chat_formatting
from .codebooks import op12_vector_codes
from .decontaminate import op1_benchmark_decontamination
from .embeddings import op3_embedding_near_dedup
from .langid import op11_language_id
from .licenses import op9_license_scans
from .manifest import op13_merkle_manifest
from .secrets import op2_secret_scans
from .simhash import op8_simhash_near_dedup
from .substrings import op5_suffix_array_dedup
from .toxicity import op7_toxicity
from .warc import op6_warc

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    ops = (
        op1_benchmark_decontamination,
        op2_secret_scans,
        op3_embedding_near_dedup,
        op4_bpe_encoding,
        op5_suffix_array_dedup,
        op6_warc,
        op7_toxicity,
        op8_simhash_near_dedup,
        op9_license_scans,
        op10_chat_formatting,
        op11_language_id,
        op12_vector_codes,
        op13_merkle_manifest,
    )
    return {f.__name__: f for f in ops}


_WORDS = r"list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"
OP1 = f"""
with d as (select doc_id, {_WORDS} as w from documents),
b as (select item_id::varchar as item, {_WORDS} as w from benchmark),
win as (select distinct item, array_to_string(w[i : i + n - 1], ' ') as g, n from (select item, w, least(10, len(w)) as n, unnest(range(1, len(w) - least(10, len(w)) + 2)) as i from b where len(w) > 0)),
occ as (select doc_id, i, o.n, item from (select doc_id, i, n, array_to_string(w[i : i + n - 1], ' ') as g from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) as i from d, (select distinct n from win) where len(w) >= n)) o join win on win.g = o.g and win.n = o.n),
hit as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(i, i + n)) as p from occ) group by doc_id),
its as (select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as items from (select distinct doc_id, item from occ) group by doc_id),
tok as (select doc_id, unnest(w) as term, unnest(range(0, len(w))) as pos from d),
seq as (select w, list(item) as items, row_number() over () as uid from b where len(w) > 0 group by w),
f as (select term, count(*) as freq from tok group by term),
few as (select uid, term, f.freq, row_number() over (partition by uid order by coalesce(f.freq, 0), term) as r from (select distinct uid, unnest(w) as term from seq) s left join f using (term)),
k as (select uid, term, count(*) over (partition by uid) as need, count(freq) over (partition by uid) as known from few where r <= 3),
p as (select doc_id, uid, need, term, pos from tok join k using (term) where known = need),
near as (select x.doc_id, x.uid from p x join p y on x.doc_id = y.doc_id and x.uid = y.uid and y.pos between x.pos and x.pos + 19 group by x.doc_id, x.uid, x.pos having count(distinct y.term) = any_value(x.need)),
nn as (select doc_id, count(distinct item) as n_near from (select doc_id, unnest(items) as item from (select distinct doc_id, uid from near) join seq using (uid)) group by doc_id)
select d.doc_id, len(w) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(items, '')) as items_sha256, n_hit is not null as contaminated, coalesce(n_near, 0) as n_near
from d left join hit on hit.doc_id = d.doc_id left join its on its.doc_id = d.doc_id left join nn on nn.doc_id = d.doc_id
"""
OP3 = """
with recursive v as (select vec_id, embedding::double[] as e, embedding is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0 as ok from embeddings),
l as (select a.vec_id as a, b.vec_id as b from v a join v b on a.vec_id <> b.vec_id where a.ok and b.ok and len(a.e) = len(b.e) and list_cosine_similarity(a.e, b.e) >= 0.95),
r as (select vec_id as a, vec_id as b from v union select r.a, l.b from r join l on r.b = l.a)
select v.vec_id, (select count(*) from l where l.a = v.vec_id) as n_links, min(r.b) as component_id, min(r.b) = v.vec_id as kept from v join r on r.a = v.vec_id group by v.vec_id
"""
OP5 = """
with t as (select doc_id, encode(coalesce(text, '')) as x, octet_length(encode(coalesce(text, ''))) as n from documents),
s as (select doc_id, p, md5(x[p + 1 : p + 400]) as h from (select doc_id, x, unnest(range(0, n - 399)) as p from t where n >= 400)),
r as (select doc_id, p from s where h in (select h from s group by h having count(*) > 1)),
g as (select doc_id, p, sum(new) over (partition by doc_id order by p) as run from (select doc_id, p, (p - lag(p) over (partition by doc_id order by p) > 400 or lag(p) over (partition by doc_id order by p) is null)::int as new from r)),
c as (select doc_id, min(p) as a, max(p) + 400 as b from g group by doc_id, run),
k as (select doc_id, a, b, lag(b, 1, 0) over (partition by doc_id order by a) as before from c),
o as (select k.doc_id, count(*) as n_spans, sum(b - a)::bigint as n_removed, string_agg(hex(x[before + 1 : a]), '' order by a) || hex(any_value(x)[max(b) + 1 : any_value(n)]) as kept from k join t on t.doc_id = k.doc_id group by k.doc_id)
select t.doc_id, n as n_bytes, coalesce(n_removed, 0) as n_removed, coalesce(n_spans, 0) as n_spans, sha256(case when kept is null then x else unhex(kept) end) as kept_sha256 from t left join o on o.doc_id = t.doc_id
"""
OP6 = """
with p as (select page_id, coalesce(html, '') as body from pages), h as (select page_id, octet_length(encode(body)) as n, sha1(body) as sha from p),
m as (select sha, max(page_id) as last, count(*) as n from h group by sha),
bits as (select page_id, array_to_string(list_transform(string_split(sha, ''), lambda c: to_base(strpos('0123456789abcdef', c) - 1, 2, 4)), '') as b from h)
select h.page_id, h.n as payload_bytes,
array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (1 + 16 * (b[5 * i + 1] = '1')::int + 8 * (b[5 * i + 2] = '1')::int + 4 * (b[5 * i + 3] = '1')::int + 2 * (b[5 * i + 4] = '1')::int + (b[5 * i + 5] = '1')::int)::bigint, 1)), '') as payload_digest,
case when m.last = h.page_id then 'response' else 'revisit' end as record_type, case when m.last = h.page_id then null else m.last end as refers_to
from h join m on m.sha = h.sha join bits on bits.page_id = h.page_id
"""
def _lloyd(r: int) -> str:
    """Assignment to the codebooks of round r, and the codebooks that it gives."""
    return f"""a{r} as materialized (select vec_id, j, min(d * 256 + e) % 256 as e, min(d * 256 + e) // 256 as d from (select p.vec_id, p.j, e, list_sum(list_transform(list_zip(p.x, b.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::bigint as d from p join b{r} b on b.j = p.j) group by vec_id, j),
b{r + 1} as materialized (select b.j, b.e, coalesce(m.x, b.x) as x from b{r} b left join (select j, e, list((s - ((s % n) + n) % n) // n order by i) as x from (select j, e, i, sum(v)::bigint as s, count(*) as n from (select p.j, a.e, unnest(p.x) as v, unnest(range(1, len(p.x) + 1)) as i from p join a{r} a on a.vec_id = p.vec_id and a.j = p.j) group by j, e, i) group by j, e) m on m.j = b.j and m.e = b.e)"""


OP12 = f"""
with k as (select vec_id, label, list_transform(embedding, lambda x: floor(1024 * x::double)::bigint) as x from embeddings where len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
p as materialized (select vec_id, label, j, x[j * len(x) // 4 + 1 : (j + 1) * len(x) // 4] as x from k, range(4) t(j)),
b0 as materialized (select j, row_number() over (partition by j order by vec_id) - 1 as e, x from p qualify row_number() over (partition by j order by vec_id) <= 256),
{", ".join(_lloyd(r) for r in range(5))},
c as (select vec_id, string_agg(printf('%02x', e), '' order by j) as code, sum(d)::bigint as error from a4 group by vec_id)
select c.vec_id, code, error, sum(error) over (partition by label)::bigint as label_error, (select sha256(string_agg(array_to_string(x, ','), ',' order by j, e)) from b4) as codebooks_sha256 from c join k on k.vec_id = c.vec_id
"""
OP13 = """
with recursive bits(b, c, k) as (select i::ubigint, i::ubigint, 0 from range(256) t(i) union all select b, case when c & 1 = 1 then xor(c >> 1, 3988292384::ubigint) else c >> 1 end, k + 1 from bits where k < 8),
crc as (select list(c order by b) as t from bits where k = 8),
d as (select doc_id, lang, n_chars, concat(coalesce(octet_length(encode(doc_id::varchar)) || ':' || doc_id, '-'), coalesce(octet_length(encode(source)) || ':' || source, '-'), coalesce(octet_length(encode(lang)) || ':' || lang, '-')) as a, coalesce(octet_length(encode(text)) || ':' || text, '-') as z,
  coalesce(xor(list_reduce(list_prepend(4294967295::ubigint, list_transform(string_split(doc_id::varchar, ''), lambda x: ascii(x)::ubigint)), lambda x, y: xor(x >> 8, t[(xor(x, y) & 255)::bigint + 1])), 4294967295::ubigint) % 7 = 0, false) as bad from documents, crc),
h as (select doc_id, coalesce('=' || lang, '') as g, sha256(concat(a, coalesce(octet_length(encode(n_chars::varchar)) || ':' || n_chars, '-'), z)) as leaf, sha256(concat(a, coalesce(octet_length(encode((n_chars + bad::int)::varchar)) || ':' || (n_chars + bad::int), '-'), z)) as other from d),
n as (select *, row_number() over (partition by g order by doc_id nulls first, leaf) - 1 as i from h),
lv(g, l, i, x, n) as (select g, 0, i, leaf, count(*) over (partition by g) from n union all select g, l + 1, i // 2, sha256(string_agg(x, '' order by i)), (n + 1) // 2 from lv where n > 1 group by g, l, i // 2, n),
s as (select g, x as subroot, row_number() over (order by g) - 1 as j from lv where n = 1),
tv(l, i, x, n) as (select 0, j, subroot, count(*) over () from s union all select l + 1, i // 2, sha256(string_agg(x, '' order by i)), (n + 1) // 2 from tv where n > 1 group by l, i // 2, n),
b as (select k.g, k.i, 0 as part, lv.l, lv.x from (select g, i, unnest(range(0, 64)) as l from n) k join lv on lv.g = k.g and lv.l = k.l and lv.n > 1 and lv.i = xor((k.i >> k.l)::bigint, 1::bigint)),
c as (select k.g, 1 as part, tv.l, tv.x from (select g, j, unnest(range(0, 64)) as l from s) k join tv on tv.l = k.l and tv.n > 1 and tv.i = xor((k.j >> k.l)::bigint, 1::bigint)),
p as (select g, i, sha256(string_agg(x, '' order by part, l)) as proof from (select * from b union all select n.g, n.i, part, l, x from n join c on c.g = n.g) group by g, i),
f(g, i, l, x) as (select g, i, 0, other from n union all select f.g, f.i, f.l + 1, sha256(case when (f.i >> f.l) % 2 = 1 then b.x || f.x else f.x || coalesce(b.x, '') end) from f join (select g, max(l) as top from lv group by g) m on m.g = f.g and f.l < m.top left join b on b.g = f.g and b.i = f.i and b.l = f.l),
e(g, i, j, l, x) as (select f.g, f.i, s.j, 0, f.x from f join (select g, max(l) as top from lv group by g) m on m.g = f.g and f.l = m.top join s on s.g = f.g union all select e.g, e.i, e.j, e.l + 1, sha256(case when (e.j >> e.l) % 2 = 1 then c.x || e.x else e.x || coalesce(c.x, '') end) from e join (select max(l) as top from tv) m on e.l < m.top left join c on c.g = e.g and c.l = e.l)
select n.doc_id, n.leaf, s.subroot, r.x as root, coalesce(proof, sha256('')) as proof_sha256, e.x as folded_root, e.x = r.x as verified
from n join s on s.g = n.g join (select l, x from tv where n = 1) r on true join e on e.g = n.g and e.i = n.i and e.l = r.l left join p on p.g = n.g and p.i = n.i
"""


def oracle_sql() -> dict[str, str]:
    """What DuckDB can say over whole tables in reasonable time. Not so for spans of decoded layers (2), byte-pair
    merging (4), fitting (7), XXH64 (8), canonical licence texts (9), quote levels (10) and random letter vectors (11): tests/llm holds those
    against brute force."""
    return {"op1_benchmark_decontamination": OP1, "op3_embedding_near_dedup": OP3, "op5_suffix_array_dedup": OP5, "op6_warc": OP6, "op12_vector_codes": OP12, "op13_merkle_manifest": OP13}
