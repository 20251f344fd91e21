"""What the registered queries mean, as SQL for DuckDB."""

from __future__ import annotations

_F = """f as (select vec_id as image_id, embedding::double[] as e from embeddings),
g as (select image_id, e,
    list_transform(e, lambda x: abs(x) / list_sum(list_transform(e, lambda y: abs(y)))) as h,
    list_transform(e, lambda x: case when x > list_aggregate(e, 'median') then 1.0::double else 0.0::double end) as b from f)"""

_DISTANCE = {
    "cosine": "1 - greatest(-1.0, least(1.0, list_dot_product({a}, {b}) / (sqrt(list_dot_product({a}, {a})) * sqrt(list_dot_product({b}, {b})))))",
    "chi2": "0.5 * list_sum(list_transform(list_zip({a}, {b}), lambda z: (z[2] - z[1]) * (z[2] - z[1]) / (z[2] + z[1] + 1e-10)))",
    "hamming": "list_sum(list_transform(list_zip({a}, {b}), lambda z: case when z[1] <> z[2] then 1.0 else 0.0 end))::double",
    "euclidean": "sqrt(list_sum(list_transform(list_zip({a}, {b}), lambda z: (z[1] - z[2]) * (z[1] - z[2]))))",
    "manhattan": "list_sum(list_transform(list_zip({a}, {b}), lambda z: abs(z[1] - z[2])))",
    "dot": "-list_dot_product({a}, {b})",
    "angular": "sqrt(greatest(0.0, 2.0 - 2.0 * list_dot_product({a}, {b}) / (sqrt(list_dot_product({a}, {a})) * sqrt(list_dot_product({b}, {b})))))",
}


def _d(metric: str, column: str, a: str = "q", b: str = "c") -> str:
    return _DISTANCE[metric].format(a=f"{a}.{column}", b=f"{b}.{column}")


def _topk(column: str, metric: str) -> str:
    return f"""with {_F}, d as (select c.image_id, {_d(metric, column)} as distance from g c, (select * from g where image_id = 0) q)
select row_number() over (order by distance, image_id) as rank, image_id, round(distance, 6) as distance from d order by distance, image_id limit 5"""


_THREE = (("embedding", "e", "cosine"), ("hist", "h", "chi2"), ("bits", "b", "hamming"))


def _long(where: str = "q.image_id = 0") -> str:
    """d: query_id, feature, image_id, distance; queries are numbered by their ids."""
    parts = [f"select q.image_id as query_id, '{n}' as feature, c.image_id, {_d(m, c)} as distance from g c, g q where {where}" for n, c, m in _THREE]
    return f"{_F}, d as ({' union all '.join(parts)})"


_NORM = """r as (select query_id, feature, min(distance) as low, max(distance) as high from d group by all),
n as (select query_id, feature, image_id, case when high > low then (distance - low) / (high - low) else 0 end as norm from d join r using (query_id, feature))"""


def _score(weighted: bool = False) -> str:
    w = "case feature when 'embedding' then 0.5 when 'hist' then 0.3 else 0.2 end"
    value = f"sum({w} * norm) / sum({w})" if weighted else "avg(norm)"
    return f"s as (select query_id, image_id, {value} as score from n group by query_id, image_id)"


_BEST = "select row_number() over (order by score, image_id) as rank, image_id, round(score, 6) as score from {s} order by score, image_id limit 5"
_MEAN = "m as (select image_id, avg(score) as score from s group by image_id)"


def _candidates(where: str, n: int = 50) -> str:
    """Re-ranks the n nearest of image 0 by cosine."""
    parts = [f"select q.image_id as query_id, '{f}' as feature, c.image_id, {_d(m, c)} as distance from g c, g q where {where} and c.image_id in (select image_id from near)" for f, c, m in _THREE]
    near = f"near as (select c.image_id from g c, (select * from g where image_id = 0) q order by {_d('cosine', 'e')}, c.image_id limit {n})"
    return f"{_F}, {near}, d as ({' union all '.join(parts)})"


def _knn(column: str, metric: str, other: bool = False) -> str:
    where = " where q.image_id <> c.image_id" if other else ""
    return f"""k as (select q.image_id as query_id, c.image_id, {_d(metric, column)} as distance from g q, g c{where}),
t as (select query_id, row_number() over (partition by query_id order by distance, image_id) as rank, image_id, distance from k qualify rank <= 5)"""


def _knn_query(*how) -> str:
    return f"with {_F}, {_knn(*how)} select query_id, rank, image_id, round(distance, 6) as distance from t"


_DOCS = "docs as (select doc_id as image_id, '/' || source || '/' || doc_id::varchar || '.' || lang as path, n_chars as bytes from documents)"
_ZEROS = f"{_F}, z as (select image_id, case when image_id % 2 = 0 then e else list_transform(e, lambda x: x * 0.0) end as e from g)"


def _overlap(n: int) -> str:
    return f"(with {_candidates('q.image_id = 0', n)}, {_NORM}, {_score()}, a as (select image_id from s order by score, image_id limit 5) select image_id from a)"


_LETTERS = ", ".join(f"(length(t) - length(replace(t, '{c}', '')))::double" for c in "abcdefghijklmnopqrstuvwxyz")


def oracle_sql() -> dict[str, str]:
    exact = f"with {_long()}, {_NORM}, {_score()}"
    return {
        "cosine_topk": _topk("e", "cosine"),
        "chi2_topk": _topk("h", "chi2"),
        "hamming_topk": _topk("b", "hamming"),
        "euclidean_topk": _topk("e", "euclidean"),
        "manhattan_topk": _topk("e", "manhattan"),
        "dot_topk": _topk("e", "dot"),
        "angular_topk": _topk("e", "angular"),
        "knn_self_included": _knn_query("e", "cosine"),
        "knn_self_excluded": _knn_query("e", "euclidean", True),
        "knn_chi2": _knn_query("h", "chi2"),
        "knn_hamming": _knn_query("b", "hamming"),
        "all_distances": f"with {_long()} select query_id, feature, image_id, round(distance, 6) as distance from d",
        "minmax_normalized": f"with {_long()}, {_NORM} select query_id, feature, image_id, round(norm, 6) as norm from n",
        "fused_mean_topk": f"{exact} {_BEST.format(s='s')}",
        "fused_weighted_topk": f"with {_long()}, {_NORM}, {_score(True)} {_BEST.format(s='s')}",
        "fused_with_constant_feature": f"{exact} {_BEST.format(s='s')}",
        "multi_query_mean": f"with {_long('q.image_id in (0, 1)')}, {_NORM}, {_score()}, {_MEAN} {_BEST.format(s='m')}",
        "candidate_rerank": f"with {_candidates('q.image_id = 0')}, {_NORM}, {_score()} {_BEST.format(s='s')}",
        "multi_query_candidate": f"with {_candidates('q.image_id in (0, 1)')}, {_NORM}, {_score()}, {_MEAN} {_BEST.format(s='m')}",
        "overlap_at_k": f"""with {_F}, {_knn('e', 'cosine')}, {_knn('b', 'hamming').replace('k as', 'k2 as').replace('t as', 't2 as').replace('from k ', 'from k2 ')}
select t.query_id, round(count(t2.image_id) / count(*), 6) as overlap from t left join t2 using (query_id, image_id) group by t.query_id""",
        "self_rank": f"{exact}, o as (select image_id, row_number() over (order by score, image_id) as rank from s) select 0::bigint as query_id, image_id, rank from o where image_id = 1",
        "backend_summary": f"""with {_long()}, {_NORM}, {_score()}, x as (select image_id from s order by score, image_id limit 5),
o as (select 50 as k_candidates, (select count(*) from x where image_id in {_overlap(50)}) / 5.0 as overlap union all select 200, (select count(*) from x where image_id in {_overlap(200)}) / 5.0),
v as (select case when event_id % 2 = 0 then 50 else 200 end as k_candidates, value as exact_ms, value / 2 + 1 as approx_ms from events)
select k_candidates, round(avg(overlap)::double, 6) as avg_overlap, round(min(overlap)::double, 6) as min_overlap, round(avg(exact_ms), 6) as avg_exact_ms, round(avg(approx_ms), 6) as avg_approx_ms,
  round(avg(exact_ms) / avg(approx_ms), 6) as speedup from v join o using (k_candidates) group by k_candidates""",
        "aligned_distances": f"with {_F}, d as (select c.image_id, {_d('cosine', 'e')} as distance from g c, (select * from g where image_id = 0) q) select row_number() over (order by image_id) - 1 as position, image_id, round(distance, 6) as distance from d",
        "subset_intersection": "select vec_id as image_id from embeddings where vec_id < 200 and vec_id % 7 <> 0 and vec_id % 5 <> 0",
        "duplicate_ids": "select l_orderkey as image_id, count(*) as n from lineitem group by 1 having count(*) > 1",
        "zero_norm_filter": f"with {_ZEROS} select image_id from z where list_dot_product(e, e) > 0",
        "invalid_counters": f"with {_ZEROS} select count(*) as n, count(*) filter (list_dot_product(e, e) = 0) as n_zero, 0::bigint as n_invalid, min(len(e))::int as min_dim, max(len(e))::int as max_dim from z",
        "zero_norm_distances": f"""with {_ZEROS}, d as (select c.image_id, case when c.image_id % 2 = 0 then {_d('cosine', 'e')} end as distance from z c, (select * from z where image_id = 0) q)
select image_id, round(coalesce((distance - min(distance) over ()) / (max(distance) over () - min(distance) over ()), 1.0), 6) as norm from d""",
        "vector_norm_stats": f"with {_F} select image_id, round(sqrt(list_dot_product(e, e)), 6) as norm from g",
        "bit_signature": f"""with {_F}, p as (select image_id, unnest(b) as bit, generate_subscripts(b, 1) as i from g)
select image_id, sum(case when bit = 0 then 0 when i = 1 then -9223372036854775808 else (1::hugeint << (64 - i)::int) end)::bigint as signature, sum(bit)::bigint as ones from p group by image_id""",
        "packed_hamming_topk": _topk("b", "hamming"),
        "catalog_slice": f"with {_DOCS} select image_id, path from docs order by image_id limit 20 offset 10",
        "catalog_lookup": f"with {_DOCS} select * from docs where image_id = 7 or path = '/src3/3.fr'",
        "catalog_count": "select count(*) as n from documents",
        "catalog_upsert": f"""with {_DOCS} select image_id, path, case when image_id % 10 = 0 then bytes + 1000 else bytes end as bytes from docs
union all select (select max(doc_id) from documents) + row_number() over (order by doc_id), '/new/' || lpad(doc_id::varchar, 8, '0'), 1 from (select distinct doc_id from labels)""",
        "catalog_delete": f"with {_DOCS} select image_id, path from docs where image_id not in (1, 2, 3, 99999999) and path not in ('/src4/4.fr', '/none')",
        "catalog_new_paths": "select page_id, url as path from pages where url not in (select url from pages where page_id < 100)",
        "missing_ids": "select doc_id as image_id from documents where doc_id not in (select doc_id from labels)",
        "resolve_paths": f"""with {_DOCS}, {_F}, d as (select c.image_id, {_d('cosine', 'e')} as distance from g c, (select * from g where image_id = 0) q),
t as (select row_number() over (order by distance, image_id) as rank, image_id, distance from d order by distance, image_id limit 5)
select rank, image_id, path, round(distance, 6) as distance from t left join docs using (image_id)""",
        "pilot_join": f"with {_DOCS}, p as (select row_number() over (order by doc_id desc) - 1 as position, doc_id as image_id from labels where toxic = 1) select position, image_id, path from p join docs using (image_id)",
        "extension_filter": "with h as (select page_id, regexp_extract(url, '://([^/?#]+)', 1) as host from pages) select page_id, host, lower(regexp_extract(host, '\\.([^./]+)$', 1)) as ext from h where lower(regexp_extract(host, '\\.([^./]+)$', 1)) in ('com', 'net')",
        "string_functions": f"""with {_DOCS} select image_id, split_part(path, '.', 2) as ext, split_part(path, '/', 3) as name, image_id::varchar as stem, regexp_replace(path, '[^\\w.-]', '_', 'g') as safe,
  'shard_' || case when image_id < 10000 then lpad(image_id::varchar, 4, '0') else image_id::varchar end as shard, 2::bigint as n_parts from docs""",
        "even_split": """with n as (select count(*) as n from documents), p as (select unnest(range(7)) as part)
select part::int as part, part * (n // 7) + least(part, n % 7) as start, (part + 1) * (n // 7) + least(part + 1, n % 7) as stop from p, n""",
        "fixed_shards": "select doc_id as image_id, ((row_number() over (order by doc_id) - 1) // 64)::int as shard_id from documents",
        "pending_shards": "select unnest([3, 4, 5])::int as shard_id",
        "shard_validation": "select (vec_id // 100)::int as shard_id, count(*) as n, count(distinct vec_id) as n_ids, min(len(embedding))::bigint as min_dim, max(len(embedding))::bigint as max_dim, 0::bigint as n_invalid from embeddings group by 1",
        "memory_estimate": "select sum(len(embedding) * 4)::bigint as bytes from embeddings",
        "json_id_map": "select event_id, unnest(json_keys(props)) as key, json_extract_string(props, '$.' || unnest(json_keys(props))) as value from events",
        "timing_summary": "with m as (select event_type, user_id, median(value) as m from events group by all) select event_type, round(avg(m), 6) as mean, round(median(m), 6) as median, round(min(m), 6) as min, round(max(m), 6) as max from m group by event_type",
        "stage_breakdown": "with m as (select event_type as stage, avg(value) as mean from events group by 1) select stage, round(mean, 6) as mean, round(100 * mean / sum(mean) over (), 6) as percent from m",
        "hot_spots": "select user_id::varchar as label, round(sum(value), 6) as cumtime from events group by 1 order by sum(value) desc, label limit 10",
        "label_knn_vote": f"""with {_F}, {_knn('e', 'cosine', True)}, v as (select t.query_id, e.label, count(*) as votes from t join embeddings e on e.vec_id = t.image_id group by all)
select query_id, label, votes from v qualify row_number() over (partition by query_id order by votes desc, label) = 1""",
        "placed_vectors": f"with {_F} select image_id, round(e[1], 6) as x, round(e[2], 6) as y, round(list_sum(e), 6) as total from g",
        "document_letters_topk": f"""with c as (select doc_id as image_id, [{_LETTERS}] as v from (select doc_id, lower(coalesce(text, '')) as t from documents)),
g as (select image_id, case when list_sum(v) > 0 then list_transform(v, lambda x: x / list_sum(v)) else v end as h from c),
d as (select c.image_id, {_d('chi2', 'h')} as distance from g c, (select * from g where image_id = 0) q)
select row_number() over (order by distance, image_id) as rank, image_id, round(distance, 6) as distance from d order by distance, image_id limit 5""",
    }
