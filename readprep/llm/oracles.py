"""DuckDB SQL for the queries that SQL can express."""

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP10 = f"""
with d as (select doc_id, {_LOWER} as body from documents)
select doc_id, max(doc_id) over (partition by body) as keep_id, count(*) over (partition by body) as group_size,
       row_number() over (partition by body order by doc_id desc nulls last) = 1 as kept, sha256(body) as text_sha256
from d
"""

#: Links of all pairs of documents that share a shingle, then the smallest reachable id by repeated joins.
OP5 = r"""
with recursive t as (
  select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') as w
  from documents),
s as (
  select distinct doc_id, array_to_string(w[i:i + 4], ' ') as g from (select doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) as i from t where len(w) > 0)),
n as (select doc_id, count(*) as n from s group by doc_id),
p as (
  select a.doc_id as u, b.doc_id as v, count(*) as common from s a join s b on a.g = b.g and a.doc_id <> b.doc_id group by 1, 2),
l as (
  select u, v from p join n nu on nu.doc_id = u join n nv on nv.doc_id = v where 100 * common >= 75 * (nu.n + nv.n - common)),
r as (select doc_id as node, doc_id as seen from n union select l.v, r.seen from r join l on l.u = r.node),
c as (select node, min(seen) as component from r group by node)
select t.doc_id, coalesce(n.n, 0) as n_shingles, coalesce(c.component, t.doc_id) as component_id, t.doc_id = coalesce(c.component, t.doc_id) as kept
from t left join n using (doc_id) left join c on c.node = t.doc_id
"""

OP3 = r"""
with t as (select doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from documents),
g as (select doc_id, i, array_to_string(w[i:i + 19], ' ') as s from (select doc_id, w, unnest(range(1, len(w) - 18)) as i from t where len(w) >= 20)),
f as (select s, min({'d': doc_id, 'i': i}) as first from g group by s),
gone as (select distinct doc_id, unnest(range(i, i + 20)) as p from g join f using (s) where {'d': doc_id, 'i': i} <> first),
k as (select doc_id, p, w[p] as x from (select doc_id, w, unnest(range(1, len(w) + 1)) as p from t)),
kept as (select doc_id, string_agg(x, ' ' order by p) as body from k anti join gone using (doc_id, p) group by doc_id),
n as (select doc_id, count(*) as n from gone group by doc_id)
select t.doc_id, len(w) as n_words, coalesce(n.n, 0) as n_removed, sha256(coalesce(body, '')) as kept_sha256
from t left join n using (doc_id) left join kept using (doc_id)
"""

ORACLES = {"op3_substring_dedup": OP3, "op5_minhash_near_dedup": OP5, "op10_exact_dedup": OP10}
