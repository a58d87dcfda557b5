"""SQL, in DuckDB's dialect, for the queries that SQL can express."""

#: Windows are compared as hexadecimal strings, two letters a byte.
SUFFIX_DEDUP = """
with t as (select doc_id, row_number() over () as r, hex(encode(coalesce(text, ''))) as h from documents),
w as (select r, i, substr(h, 2 * i + 1, 400) as s from (select r, h, unnest(range(0, length(h) // 2 - 199)) as i from t where length(h) >= 400)),
rep as (select r, i from w join (select s from w group by s having count(*) > 1) using (s)),
isl as (select r, i, case when i - lag(i) over (partition by r order by i) <= 200 then 0 else 1 end as head from rep),
num as (select r, i, sum(head) over (partition by r order by i) as k from isl),
span as (select r, k, min(i) as lo, max(i) + 200 as hi from num group by r, k),
gap as (select r, lo as hi, coalesce(lag(hi) over (partition by r order by lo), 0) as lo, hi as z from span),
kept as (select gap.r, string_agg(substr(h, 2 * gap.lo + 1, 2 * (gap.hi - gap.lo)), '' order by gap.lo) as k, max(z) as z, count(*) as n from gap join t using (r) group by gap.r),
sizes as (select r, sum(hi - lo) as removed from span group by r)
select doc_id, cast(length(h) // 2 as bigint) as n_bytes, cast(coalesce(removed, 0) as bigint) as n_removed, cast(coalesce(n, 0) as bigint) as n_spans,
 sha256(unhex(case when n is null then h else k || substr(h, 2 * z + 1) end)) as kept_sha256
from t left join kept using (r) left join sizes using (r)
"""

JACCARD_JOIN = r"""
with recursive d as (select row_number() over () as r, doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from documents),
s as (select distinct r, array_to_string(w[i:i + 3], ' ') as g from (select r, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) as i from d where len(w) > 0)),
n as (select r, count(*) as n from s group by r),
f as (select r, g, row_number() over (partition by r order by df, g) as p from s join (select g, count(*) as df from s group by g) using (g)),
lead_ as (select r, g from f join n using (r) where p <= n - ceil(0.85 * n) + 1),
pair as (select distinct a.r as a, b.r as b from lead_ a join lead_ b using (g) where a.r < b.r),
link as (select a, b from (select pair.a, pair.b, count(*) as c from pair join s x on x.r = pair.a join s y on y.r = pair.b and y.g = x.g group by all) join n na on na.r = a join n nb on nb.r = b where 100 * c >= 85 * (na.n + nb.n - c)),
ways as (select a, b from link union select b, a from link),
walk(r, c) as (select r, r from d union select ways.b, walk.c from walk join ways on ways.a = walk.r),
low as (select walk.r, min(d.doc_id) as component_id from walk join d on d.r = walk.c group by walk.r)
select d.doc_id, coalesce(n.n, 0) as n_shingles, low.component_id from d left join n using (r) join low using (r)
"""
