"""DuckDB SQL for those numbered queries that SQL can express."""

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
WORDS = rf"regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+')"

OP6 = f"""
with recursive w as (select doc_id, {WORDS} as w from documents),
s as (select distinct doc_id, g from (
  select doc_id, unnest(case when len(w) >= 5 then list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))
                             when len(w) > 0 then [array_to_string(w, ' ')] else [] end) as g from w)),
n as (select doc_id, count(*) as n from s group by 1),
shared as (select g from s group by 1 having count(*) > 1),
inter as (select a.doc_id as a, b.doc_id as b, count(*) as c from s a join s b using (g) where a.doc_id <> b.doc_id and g in (from shared) group by 1, 2),
links as (select i.a, i.b from inter i join n x on x.doc_id = i.a join n y on y.doc_id = i.b where 100 * i.c >= 80 * (x.n + y.n - i.c)),
reach as (select doc_id as a, doc_id as b from w union select r.a, l.b from reach r join links l on l.a = r.b)
select w.doc_id, coalesce(n.n, 0) as n_shingles, min(r.b) as component_id
from w join reach r on r.a = w.doc_id left join n on n.doc_id = w.doc_id group by 1, 2
"""

OP8 = rf"""
with d as (select doc_id, source, cast(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as bigint) as size from documents),
t as (select source, sum(size)::bigint as source_size from d group by 1),
r as (select *, row_number() over (order by source is null, source) - 1 as rank from t),
f as (select *, [5, 2, 1][rank % 3 + 1] as weight, 3.0::double * source_size / [5, 2, 1][rank % 3 + 1] as fill from r),
p as (select *, row_number() over (order by fill, rank) as place,
  ((sum(source_size) over ())::bigint - coalesce(sum(3 * source_size) over (order by fill, rank rows between unbounded preceding and 1 preceding), 0)::bigint)::double
  / (sum(weight) over (order by fill, rank rows between current row and unbounded following))::double as own_level from f),
l as (select *, (select arg_min(own_level, place) from p where fill >= own_level) as level from p),
g as (select source, source_size, least(3.0::double * source_size, weight * level) as target from l),
q as (select *, case when source_size > 0 then target / source_size else 0.0::double end as rate from g),
c as (select d.*, q.source_size, q.target, floor(q.rate)::bigint as copies, q.rate - floor(q.rate) as fraction from d join q on d.source is not distinct from q.source),
u as (select *, coalesce(doc_id::varchar, 'null') as k from c),
s as (select source, seed, abs(sum(size * (copies + (('0x' || substr(md5(k || ':' || seed), 1, 8))::ubigint / 4294967296.0::double < fraction)::int)) - any_value(target)) as off
  from u, range(16) x(seed) group by 1, 2),
b as (select source, arg_min(seed, (off, seed)) as seed from s group by 1)
select doc_id, size, source_size, target,
  size * (copies + (('0x' || substr(md5(k || ':' || seed), 1, 8))::ubigint / 4294967296.0::double < fraction)::int) as taken
from u join b on u.source is not distinct from b.source
"""

OP2 = """
with v as (select vec_id, list_transform(embedding, lambda x: floor(1024 * x::double)) as v from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select q.vec_id as query_id, c.vec_id, list_inner_product(q.v, c.v)::bigint as score from v q join v c on q.vec_id % 100 = 0 and q.vec_id <> c.vec_id),
r as (select *, row_number() over (partition by query_id order by score desc, vec_id)::int as rank from s)
select query_id, rank, vec_id, score from r where rank <= 10
"""

ORACLES: dict[str, str] = {"op2_exact_topk": OP2, "op6_ngram_jaccard_join": OP6, "op8_source_mix": OP8}
