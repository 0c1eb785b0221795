"""SQL for the queries of :mod:`lakeassay.plans.reference`, for DuckDB over the same tables."""

from __future__ import annotations

_YOLO = r"""
with l as (select file_id, unnest(range(len(string_split(content, chr(10))))) as line_no, unnest(string_split(content, chr(10))) as line from label_files),
t as (select file_id, line_no, string_split_regex(trim(regexp_replace(line, '\s+', ' ', 'g')), ' ') as t from l)
select file_id, cast(line_no as integer) as line_no, try_cast(t[1] as integer) as class_id, class_name, try_cast(t[2] as double) as x_center, try_cast(t[3] as double) as y_center, try_cast(t[4] as double) as width, try_cast(t[5] as double) as height
from t left join class_names c on c.class_id = try_cast(t[1] as integer) where len(t) >= 5
"""

_LISTING = r"""
select distinct image_path, lower(regexp_extract(image_path, '\.([^./\\]+)$', 1)) as ending, regexp_replace(regexp_extract(image_path, '([^/\\]*)$', 1), '\.[^.]*$', '') as stem
from object_annotations where lower(regexp_extract(image_path, '\.([^./\\]+)$', 1)) in ('jpg', 'jpeg', 'png', 'bmp', 'tiff', 'webp')
"""

_COCO = """
with b as (select l_orderkey, l_quantity as x, l_quantity / 2 as y, l_discount * 100 as w, l_tax * 100 as h, coalesce(p_size * 10, 1) as iw, coalesce(p_size * 20, 1) as ih from lineitem left join part on p_partkey = l_partkey)
select l_orderkey, count(*) as n_boxes, round(sum((x + w / 2) / iw) + 1e-9, 4) as x_center, round(sum((y + h / 2) / ih) + 1e-9, 4) as y_center, round(sum(w / iw) + 1e-9, 4) as width, round(sum(h / ih) + 1e-9, 4) as height from b group by l_orderkey
"""

_DOMINANT = """
with c as (select l_orderkey, l_suppkey % 10 as k, count(*) as n, min(l_linenumber) as f from lineitem group by all),
r as (select l_orderkey, k, row_number() over (partition by l_orderkey order by n desc, f, k) as r from c)
select o_orderkey, cast(coalesce(k, -1) as integer) as dominant from orders left join r on l_orderkey = o_orderkey and r = 1
"""

_NAMES = "select a.class_id, class_name, n from (select class_id, count(*) as n from object_annotations where class_id is not null group by class_id) a left join class_names using (class_id)"

_VECTORS = """
with e as (select vec_id, list_transform(embedding, lambda x: cast(x as double)) as v from embeddings),
n as (select vec_id, v, list_reverse(v) as r, v[1:10] as h, sqrt(list_sum(list_transform(v, lambda x: x * x))) as n from e),
s as (select *, list_max(h) as top, list_sum(list_transform(h, lambda x: exp(x - list_max(h)))) as z from n)
select vec_id, round(sqrt(list_sum(list_transform(v, lambda x: (x / n) * (x / n)))), 5) as unit_norm, round(list_dot_product(v, r), 5) as inner,
  round(exp(-list_sum(list_transform(list_zip(v, r), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) / 64), 5) as kernel,
  round(1 / z, 5) as top_probability, cast(list_position(h, top) - 1 as integer) as top_class, round(least(greatest(v[1], -0.1), 0.1), 5) as clipped from s
"""

_UNIT = """
with recursive e as (select vec_id, list_transform(embedding, lambda x: cast(x as double)) as v from embeddings),
u as (select vec_id, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) as v from e)
"""
_LINKS = (
    _UNIT
    + """
, p as (select a.vec_id as a, b.vec_id as b, list_dot_product(a.v, b.v) as s from u a join u b on a.vec_id <> b.vec_id where list_dot_product(a.v, b.v) >= 0.45),
reach as (select a as id, a as r from p union select p.b, reach.r from reach join p on p.a = reach.id),
root as (select id, min(r) as cluster from reach group by id),
m as (select vec_id, coalesce(cluster, vec_id) as cluster, count(s) as n_links, max(s) as best from embeddings left join root on id = vec_id left join p on a = vec_id group by all)
"""
)
_MEMBERS = _LINKS + "select vec_id, cluster, n_links, round(best, 5) as max_similarity from m"
_CLUSTERS = _LINKS + "select cluster, count(*) as cluster_size, round(max(best), 5) as max_similarity from m group by cluster having count(*) >= 2"
_KNN = (
    _UNIT
    + """
, d as (select q.vec_id as query, x.vec_id as neighbour, list_dot_product(q.v, x.v) as s from u q join u x on q.vec_id <> x.vec_id where q.vec_id % 50 = 0),
r as (select *, cast(row_number() over (partition by query order by s desc, neighbour) as integer) as rank from d)
select query, neighbour, round(s, 5) as sim, rank from r where rank <= 5
"""
)
_CONTENT = "select sha256(text) as digest, count(*) as n, min(doc_id) as first_id from documents where text is not null group by text having count(*) > 1"


def _shift(add: float) -> str:
    return f"""
with e as (select vec_id, vec_id % 2 = 1 as test, list_transform(embedding, lambda x: cast(x as double) + case when vec_id % 2 = 1 then {add} else 0 end) as v from embeddings),
pts as (select test, unnest(range(len(v))) as dim, unnest(v) as x from e),
c as (select dim, x, count(*) filter (where test) as a, count(*) filter (where not test) as b from pts group by dim, x),
n as (select count(*) filter (where test) as n, count(*) filter (where not test) as m from e),
g as (select dim, abs(sum(a) over (partition by dim order by x) / n.n - sum(b) over (partition by dim order by x) / n.m) as gap from c cross join n),
ks as (select dim, max(gap) as ks from g group by dim),
k as (select p.test as pt, q.test as qt, avg(exp(-greatest(list_dot_product(p.v, p.v) + list_dot_product(q.v, q.v) - 2 * list_dot_product(p.v, q.v), 0) / 64)) as k from e p cross join e q group by all),
mmd as (select sqrt(greatest(0, sum(case when pt = qt then k else -k end))) as mmd from k),
r as (select avg(case when ks >= sqrt(-ln(0.05 / 2) / 2 * (n.n + n.m) / (n.n * n.m)) - 1e-12 then 1.0 else 0.0 end) as ks_ratio, count(*) as n_dims from ks cross join n),
out as (select round(mmd, 5) as mmd, round(ks_ratio, 6) as ks_ratio, n_dims, n.n as n_test, n.m as n_reference from mmd cross join r cross join n)
"""


_KS = _shift(0) + "select cast(dim as integer) as dim, round(ks, 6) as ks, n.n as n_test, n.m as n_reference from ks cross join n"
_METRICS = _shift(0) + "select *, case when mmd > 0.04 or ks_ratio > 0.15 then 'review' else 'accept' end as verdict from out"
_INJECTED = _shift(0.1) + "select * from out"
_SHIFT_FLAG = (
    _shift(0.1)
    + """select 'distribution_shift' as module, round(0.4 + 0.25 * (cast(mmd > 0.04 as integer) + cast(ks_ratio > 0.15 as integer)), 4) as confidence,
  case when mmd > 0.04 and ks_ratio > 0.15 then 'high' else 'medium' end as severity, 'dataset' as affected_asset, 'review' as recommended_disposition from out where mmd > 0.04 or ks_ratio > 0.15"""
)

_KL = """
with e as (select vec_id, list_transform(embedding, lambda x: cast(x as double) * 10) as v from embeddings),
h as (select vec_id, v[1:10] as a, v[11:20] as b from e),
s as (select vec_id, list_transform(a, lambda x: exp(x - list_max(a))) as a, list_transform(b, lambda x: exp(x - list_max(b))) as b from h),
p as (select vec_id, list_transform(a, lambda x: x / list_sum(a)) as p, list_transform(b, lambda x: x / list_sum(b)) as q from s),
k as (select list_sum(list_transform(list_zip(p, q), lambda z: greatest(z[1], 1e-9) * ln(greatest(z[1], 1e-9) / greatest(z[2], 1e-9)))) as kl from p)
select round(avg(kl), 5) as kl, count(*) as n_samples from k
"""

_DRIFT_ROWS = """
with t as (select max(event_id) / 2 as half from events),
r as (select event_id > half as late, event_type as layer_name, value * case when event_id > half and event_type = 'error' then 3.0 else 1.0 end as v from events cross join t),
s as (select layer_name, avg(v) filter (where late) as tm, avg(v) filter (where not late) as rm, var_pop(v) filter (where late) as tv, var_pop(v) filter (where not late) as rv from r group by layer_name),
d as (select *, abs(tm - rm) / (abs(rm) + 1e-6) as md, abs(tv - rv) / (abs(rv) + 1e-6) as vd from s where tm is not null and rm is not null)
"""
_DRIFT = _DRIFT_ROWS + "select layer_name, round(tm, 4) as test_mean, round(rm, 4) as ref_mean, round(tv, 4) as test_var, round(rv, 4) as ref_var, round(md, 4) as mean_diff, round(vd, 4) as var_diff, md > 0.25 or vd > 0.25 as drifted from d"

_MASKS = """
with m as (select label as target_class, avg(list_sum(list_transform(embedding, lambda x: abs(cast(x as double))))) / case when label = 0 then 4 else 1 end as l1_norm from embeddings group by label),
a as (select median(l1_norm) as med from m), b as (select median(abs(l1_norm - med)) as mad0 from m cross join a),
x as (select m.*, med, case when mad0 = 0 then 1e-6 else mad0 end as mad, (med - l1_norm) / (1.4826 * case when mad0 = 0 then 1e-6 else mad0 end) as idx from m cross join a cross join b)
"""
_MAD = _MASKS + "select target_class, round(l1_norm, 5) as l1_norm, round(med, 5) as median, round(mad, 5) as mad, round(idx, 2) as anomaly_index, idx > 2 as flagged from x"

_GATE = "select s_name as affected_asset, 'low' as severity, case when s_suppkey % 2 <> 0 then 'unavailable' else 'unavailable_for_jit' end as status from supplier where s_suppkey % 2 <> 0 or s_suppkey % 3 = 0"

_YOLO_FOLDER = """select row_number() over (order by printf('synth_%05d', s_suppkey)) - 1 as image_idx, printf('synth_%05d.png', s_suppkey) as image, 1 as n_annotations, s_nationkey as class_id, n_name as class_name, cast(0.5 as double) as x_center, cast(1 as double) as height
from supplier left join nation on n_nationkey = s_nationkey"""

_COCO_FILE = """with b as (select s_suppkey as k, unnest(case when s_suppkey % 7 = 0 then [null] when s_suppkey % 3 = 0 then [0, 1] else [0] end) as n, s_nationkey as c, row_number() over (order by s_suppkey) - 1 as i from supplier)
select i as image_idx, 'root/img_' || k || '.jpg' as image_path, c + n as class_id, n_name as class_name, round(case when n is not null then (10 + k % 50 / 2.0) / (100 + k % 7) end, 6) as x_center, round(case when n is not null then (k % 50) / cast(100 + k % 7 as double) end, 6) as width, cast(case when n is not null then 0.2 end as double) as y_center
from b left join nation on n_nationkey = c + n"""

_STAMP = "2024-01-01T00:00:00+00:00"


def _quoted(expr: str) -> str:
    """A text as JSON, as far as these payloads need it."""
    return f"""replace(replace({expr}, '\\', '\\\\'), '"', '\\"')"""


_CHAIN = f"""
with recursive ev as (
  select user_id as chain_id, event_id as seq, '{{"event_id":' || event_id || ',"event_type":"' || event_type || '"}}' as payload, row_number() over (partition by user_id order by event_id) as r from events
), c as (
  select chain_id, seq, r, payload, repeat('0', 64) as prev_hash, sha256('{{"payload":"' || {_quoted("payload")} || '","prev_hash":"' || repeat('0', 64) || '","timestamp":"{_STAMP}"}}') as h from ev where r = 1
  union all
  select ev.chain_id, ev.seq, ev.r, ev.payload, c.h, sha256('{{"payload":"' || {_quoted("ev.payload")} || '","prev_hash":"' || c.h || '","timestamp":"{_STAMP}"}}') from c join ev on ev.chain_id = c.chain_id and ev.r = c.r + 1
)
"""
_BUILD = _CHAIN + "select chain_id, max_by(h, seq) as head from c group by chain_id"
_VERIFY = _CHAIN + "select chain_id, count(*) as n_records, true as valid, cast(null as bigint) as broken_seq from c group by chain_id"
_TAMPER = _CHAIN + "select chain_id, count(*) as n_records, count(*) filter (where seq % 97 = 5) = 0 as valid, min(seq) filter (where seq % 97 = 5) as broken_seq from c group by chain_id"
_AUDIT = (
    _CHAIN
    + """, b as (select chain_id, seq, seq % 97 <> 5 as self_ok, lag(seq) over (partition by chain_id order by seq) as before from c)
select chain_id, seq, self_ok, coalesce(before % 97 <> 5, true) as link_ok from b where not self_ok or coalesce(before % 97 = 5, false)"""
)
_LOOKUP = f"""select user_id as chain_id, event_id as seq, event_type, repeat('0', 64) as prev_hash from events where user_id = 8 and event_id = 0"""

_SIGNATURES = "select doc_id as record_index, case when doc_id % 7 = 0 then 'missing' when doc_id % 7 in (1, 2) then 'bad' else 'checkable' end as state from documents"


def _spectrum() -> str:
    """Block spectra of 8 x 8 pictures by the discrete Fourier transform written out."""
    return """
with px as (
  select vec_id, i // 8 as y, i % 8 as x,
    case when vec_id % 25 = 0 and i // 8 >= 4 and i % 8 >= 4 then case when (i // 8 + i % 8) % 2 = 0 then 1.0 else 0.0 end else 0.5 + cast(embedding[i + 1] as double) / 10 end as v
  from embeddings cross join (select unnest(range(64)) as i)
), f as (select unnest(range(4)) as fy), g as (select unnest(range(4)) as fx),
z as (
  select vec_id, y // 4 as brow, x // 4 as bx, fy, fx, sum(v * cos(2 * pi() * (fy * (y % 4) + fx * (x % 4)) / 4)) as re, sum(v * sin(2 * pi() * (fy * (y % 4) + fx * (x % 4)) / 4)) as im
  from px cross join f cross join g group by all
), s as (
  select vec_id, brow, bx, sum(re * re + im * im) as total, sum(case when sqrt(power((fy + 2) % 4 - 2, 2) + power((fx + 2) % 4 - 2, 2)) >= 0.35 * 2 then re * re + im * im else 0 end) as high from z group by all
), r as (select vec_id, brow, bx, case when total > 0 then high / total else 0 end as ratio from s),
b as (select vec_id, max(ratio) as m, avg(ratio) as a, arg_max(struct_pack(bx := bx, brow := brow), ratio) as place, count(*) as n from r group by vec_id)
"""


_BLOCKS = _spectrum() + "select cast(vec_id as varchar) as asset, round(m, 5) as max_ratio, round(a, 5) as avg_ratio, cast(n as integer) as n_blocks from b"
_TRIGGER = (
    _spectrum()
    + """select cast(vec_id as varchar) as affected_asset, case when round(m, 6) > 0.4 then 'high' else 'medium' end as severity,
  round(greatest(0.5, least(greatest((m - 0.25) / (1 - 0.25 + 1e-6), 0), 1)), 4) as confidence, '[' || place.bx * 4 || ',' || place.brow * 4 || ']' as block from b where m > 0.25 and m > 2 * a"""
)

_FLIP = """
with k as (select vec_id from embeddings order by md5('42:' || vec_id) limit (select cast(floor(0.05 * count(*)) as bigint) from embeddings))
select e.vec_id, case when k.vec_id is not null then (label + 1) % 10 else label end as label, k.vec_id is not null as planted from embeddings e left join k using (vec_id)
"""
_FLOOD = """
with k as (select vec_id from embeddings order by md5('42:' || vec_id) limit 50)
select vec_id, label, false as planted from embeddings union all select (select max(vec_id) from embeddings) + 1 + vec_id, label, true from embeddings join k using (vec_id)
"""
_BACKDOOR = """
with k as (select vec_id from embeddings where label <> 0 order by md5('42:' || vec_id) limit 50)
select e.vec_id, case when k.vec_id is not null then 0 else label end as label, k.vec_id is not null as planted from embeddings e left join k using (vec_id)
"""


def _cte(sql: str, name: str, last: str) -> str:
    """A WITH query as one common table expression."""
    return f"{name} as ({sql} {last})"


_ALL = (
    "with "
    + ", ".join(
        [
            _cte(_spectrum(), "f0", "select 0 as check_no, 'data_integrity' as module, case when round(m, 6) > 0.4 then 'high' else 'medium' end as severity, 'quarantine' as d, 'trigger' as asset from b where m > 0.25 and m > 2 * a"),
            _cte(_MASKS, "f1", "select 1 as check_no, 'model_integrity' as module, case when idx > 3 then 'high' else 'medium' end as severity, 'quarantine' as d, 'model' as asset from x where idx > 2"),
            _cte(_DRIFT_ROWS, "f2", "select 2 as check_no, 'model_integrity' as module, case when greatest(md, vd) > 0.5 then 'high' else 'medium' end as severity, 'review' as d, 'model' as asset from d where md > 0.25 or vd > 0.25"),
            _cte(_shift(0.1), "f3", "select 3 as check_no, 'distribution_shift' as module, case when mmd > 0.04 and ks_ratio > 0.15 then 'high' else 'medium' end as severity, 'review' as d, 'dataset' as asset from out where mmd > 0.04 or ks_ratio > 0.15"),
        ]
    )
    + ", u as (select * from f0 union all select * from f1 union all select * from f2 union all select * from f3) "
)
_UNION = _ALL + "select cast(check_no as integer) as check_no, module, severity, d as recommended_disposition, count(*) as n from u group by all"
_ROLLUP = (
    _ALL
    + """, m as (select * from (values (0, 'data_integrity'), (1, 'model_integrity'), (2, 'provenance'), (3, 'distribution_shift')) v(module_ord, module))
select module_ord, m.module, count(severity) as n_flags, count(*) filter (where severity = 'low') as n_low, count(*) filter (where severity = 'medium') as n_medium, count(*) filter (where severity = 'high') as n_high
from m left join u on u.module = m.module group by all"""
)
_VERDICT = _ALL + "select case when count(*) filter (where severity = 'high') > 0 then 'quarantine' when count(*) filter (where severity = 'medium') > 0 then 'review' else 'accept' end as overall_recommendation, count(*) as n_flags, 4 as checks_executed from u"
_EXPLORER = _ALL + "select case module when 'model_integrity' then 'Model integrity' else 'Distribution shift' end as module_label, severity, asset as affected_asset, d as recommended_disposition from u where severity = 'high' and module in ('model_integrity', 'distribution_shift')"

ORACLES = {
    "sign_verify": "select doc_id as record_index, case when doc_id % 11 = 0 then 'bad' else 'ok' end as state from documents",
    "yolo_folder": _YOLO_FOLDER,
    "training_labels": "select row_number() over (order by printf('synth_%05d', s_suppkey)) - 1 as image_idx, s_nationkey as label from supplier",
    "coco_file": _COCO_FILE,
    "yolo_parse": _YOLO,
    "image_listing": _LISTING,
    "coco_normalise": _COCO,
    "dominant_label": _DOMINANT,
    "class_names_join": _NAMES,
    "vector_functions": _VECTORS,
    "duplicate_members": _MEMBERS,
    "duplicate_clusters": _CLUSTERS,
    "knn_topk": _KNN,
    "exact_content_duplicates": _CONTENT,
    "ks_per_dim": _KS,
    "shift_metrics": _METRICS,
    "shift_injected": _INJECTED,
    "shift_flag": _SHIFT_FLAG,
    "softmax_kl": _KL,
    "activation_drift": _DRIFT,
    "mad_anomaly": _MAD,
    "capability_gate": _GATE,
    "chain_build": _BUILD,
    "chain_verify": _VERIFY,
    "chain_tamper": _TAMPER,
    "chain_audit": _AUDIT,
    "chain_lookup": _LOOKUP,
    "signature_gate": _SIGNATURES,
    "block_spectrum": _BLOCKS,
    "trigger_scan": _TRIGGER,
    "label_flip_inject": _FLIP,
    "dup_flood": _FLOOD,
    "backdoor_relabel": _BACKDOOR,
    "flags_union": _UNION,
    "severity_rollup": _ROLLUP,
    "overall_verdict": _VERDICT,
    "flags_explorer": _EXPLORER,
}
