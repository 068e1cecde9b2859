"""DuckDB SQL for the operators that SQL can express."""

from __future__ import annotations

from .licences import CONTAINED, SHINGLE, TEMPLATES

#: Sizes, sources, weights; the level at which sources share, raised until none passes three times its size; then a running sum by key within each source.
MIXTURE = r"""
with recursive sized as (
    select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as size,
           ('0x' || substr(md5(coalesce(doc_id::varchar, '')), 1, 13))::bigint as key
    from documents
), src as (
    select source, sum(size)::bigint as source_size,
           case (row_number() over (order by source nulls last) - 1) % 3 when 0 then 5 when 1 then 2 else 1 end as weight
    from sized group by source
), level as (
    select 0 as step, (select sum(source_size)::double / sum(weight) from src) as share
    union all
    select step + 1, (select ((select sum(source_size) from src) - coalesce(sum(3 * source_size) filter (3 * source_size < share * weight), 0))::double
                             / sum(weight) filter (3 * source_size >= share * weight) from src)
    from level where step < 200 and share is not null
), share as (
    select max(share) as share from level
), targets as (
    select source, source_size, case when 3 * source_size < share * weight then (3 * source_size)::double else share * weight end as target
    from src, share
), placed as (
    select s.*, t.source_size, t.target, round(t.target)::bigint as budget,
           coalesce(sum(size) over (partition by s.source order by key, doc_id, size rows between unbounded preceding and 1 preceding), 0)::bigint as prefix
    from sized s join targets t on s.source is not distinct from t.source
)
select doc_id, size, source_size, target,
       (case when source_size > 0 then (budget // source_size) * size else 0 end
        + greatest(0, least(size, case when source_size > 0 then budget % source_size else budget end - prefix)))::bigint as taken
from placed
"""

ORACLES = {"op7_source_mixture": MIXTURE}

#: Extendible hashing: a document's depth is the smallest at which its prefix's bytes are within the limit.
SHARDS = """
with rows as (
    select doc_id, coalesce(strlen(text), 0)::bigint as doc_bytes, ('0x' || substr(md5(coalesce(doc_id::varchar, '')), 1, 15))::bigint as h from documents
), levels as (
    select r.*, d.depth::integer as depth, r.h >> (60 - d.depth)::integer as bucket from rows r, range(0, 31) d(depth)
), buckets as (
    select depth, bucket, sum(doc_bytes)::bigint as shard_bytes from levels group by all
), placed as (
    select l.doc_id, l.doc_bytes, l.depth, l.bucket, b.shard_bytes,
           row_number() over (partition by l.doc_id order by l.depth) as n
    from levels l join buckets b on l.depth = b.depth and l.bucket = b.bucket where b.shard_bytes <= 1048576
)
select doc_id, doc_bytes, case when depth = 0 then '' else right(lpad(bin(bucket), 60, '0'), depth) end as shard, depth, shard_bytes from placed where n = 1
"""

#: Archives read back: the smallest page_id of equal payloads is the response. SHA-1 in base 32, five hex digits to four characters.
ARCHIVES = """
with p as (
    select page_id, strlen(coalesce(html, ''))::bigint as payload_bytes, sha1(encode(coalesce(html, ''))) as h,
           min(page_id) over (partition by coalesce(html, '')) as first
    from pages
)
select page_id, payload_bytes,
       array_to_string(list_transform(range(0, 8), lambda i: array_to_string(list_transform(range(0, 4), lambda j:
           substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(h, (i * 5 + 1)::integer, 5))::bigint >> (15 - 5 * j)::integer) & 31)::integer + 1, 1)), '')), '') as payload_digest,
       case when page_id = first then 'response' else 'revisit' end as record_type,
       case when page_id <> first then first end as refers_to
from p
"""

ORACLES |= {"op2_warc_zstd": ARCHIVES, "op3_extendible_sharding": SHARDS}

_WORDS = r"string_split(trim(regexp_replace(lower(coalesce(text, '')), '[^\p{L}\p{N}]+', ' ', 'g')), ' ')"
_ROWS = ", ".join("('{}', '{}')".format(k, v.replace("'", "''")) for k, v in TEMPLATES.items())

#: Licences by brute force: every window of every text against every template.
LICENCES = f"""
with w as (
    select name, {_WORDS} as w from (values {_ROWS}) v(name, text)
), t as (
    select name, least({SHINGLE}, len(w)) as n, unnest(range(0, len(w) - least({SHINGLE}, len(w)) + 1)) as i, w from w
), ts as (
    select distinct name, n, array_to_string(w[i + 1:i + n], ' ') as s from t
), sizes as (
    select name, count(*) as m, pow(2, ceil(log2(greatest(count(*), 2))))::bigint as width from ts group by name
), d as (
    select doc_id, {_WORDS} as w from documents
), ds as (
    select doc_id, n, i, array_to_string(w[i + 1:i + n], ' ') as s from (select doc_id, w, n, unnest(range(0, len(w) - n + 1)) as i from d, (select distinct n from ts) where len(w) >= n)
), hits as (
    select ds.doc_id, ts.name, ts.s, m, unnest([i // width * width, i // width * width - width]) as start from ds join ts on ds.s = ts.s and ds.n = ts.n join sizes using (name)
), windows as (
    select doc_id, name, start, count(distinct s) / m::double as containment from hits where start >= 0 group by doc_id, name, start, m
)
select doc_id, name as licence, max(containment) as containment, count(*) as windows, min(start)::bigint as first_window
from windows where containment >= {CONTAINED} group by doc_id, name
"""

ORACLES |= {"op5_licence_windows": LICENCES}

#: Vectors by brute force: all pairs within a label, then the smallest vec_id reachable.
VECTORS = """
with recursive v as (
    select vec_id, label, embedding::double[] as e from embeddings
), good as (
    select * from v where label is not null and len(e) > 0 and len(list_filter(e, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(e, lambda x: x <> 0)) > 0
), pairs as (
    select a.vec_id as a, b.vec_id as b from good a join good b on a.label = b.label and len(a.e) = len(b.e) and a.vec_id <> b.vec_id
    where list_cosine_similarity(a.e, b.e) >= 0.93
), reach(a, b) as (
    select vec_id, vec_id from v union select r.a, p.b from reach r join pairs p on r.b = p.a
), n as (
    select a, count(*) as n from pairs group by a
), least as (
    select a, min(b) as component_id from reach group by a
)
select v.vec_id, coalesce(n.n, 0)::bigint as n_links, component_id, v.vec_id = component_id as kept from v left join n on n.a = v.vec_id join least on least.a = v.vec_id
"""

ORACLES |= {"op1_hnsw_near_dedup": VECTORS}
