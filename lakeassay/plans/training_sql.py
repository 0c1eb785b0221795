"""SQL for the queries of :mod:`lakeassay.plans.training`, for DuckDB over the same tables."""

from __future__ import annotations

_NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"

#: Label records: image (path resolved, one step of '..' at a time), line number, five values.
_RECORDS = r"""
with paths as (
  select file_id, content, regexp_replace(regexp_replace(regexp_replace(replace(image_path, '\', '/'), '/(\./)+', '/', 'g'), '/+', '/', 'g'), '^(\./|/)+', '') as p from label_files
), images as (
  select file_id, content, regexp_replace(p, '(^|/)[^/]+/\.\./', '\1', 'g') as image from paths
), lines as (
  select file_id, image, unnest(range(1, len(string_split(content, chr(10))) + 1)) as line_no, unnest(string_split(content, chr(10))) as line from images
), tokens as (
  select file_id, image, line_no, string_split_regex(trim(regexp_replace(line, '\s+', ' ', 'g')), ' ') as t from lines
), records as (
  select file_id, image, line_no, t[1]::double as c, t[2]::double as x, t[3]::double as y, t[4]::double as w, t[5]::double as h from tokens where len(t) >= 5 and image is not null
), ranked as (
  select *, row_number() over (partition by image, c, x, y, w, h order by file_id, line_no) as r, count(*) over (partition by image, c, x, y, w, h) as n from records
)
"""

_P1_FOUND = _RECORDS + "select file_id, cast(line_no as integer) as line_no from ranked where r > 1"
_P1_RECORDS = _RECORDS + "select image, c as class_value, x as x_center, y as y_center, w as width, h as height, n as n_copies, file_id, cast(line_no as integer) as line_no from ranked where r = 1"
_P1_ROUNDTRIP = "select file_id, image_path, cast(octet_length(cast(content as blob)) as bigint) as n_bytes, md5(content) as digest, true as sound from label_files"

_DELIVERIES = """
with recursive chosen as (
  select * from assurance_reports where report_id is not null qualify row_number() over (partition by report_id order by received_at desc) = 1
), modules as (
  select report_id, cast(unnest(range(len(module_results))) as integer) as module_no, unnest(module_results) as m from chosen
), flags as (
  select report_id, module_no, cast(unnest(range(len(m.flags))) as integer) as flag_no, unnest(m.flags) as f from modules where m.flags is not null
)
"""

#: Evidence is unwrapped level by level, then walked member by member.
_EVIDENCE = (
    _DELIVERIES
    + """
, unwrapped as (
  select report_id, module_no, flag_no, try_cast(f.evidence as json) as j, 0 as depth from flags where f.evidence is not null and f.evidence <> ''
  union all
  select report_id, module_no, flag_no, try_cast(j ->> '$' as json), depth + 1 from unwrapped where json_type(j) = 'VARCHAR' and depth < 8
), roots as (
  select report_id, module_no, flag_no, j from unwrapped where json_type(j) in ('OBJECT', 'ARRAY')
), walked as (
  select report_id, module_no, flag_no, '' as path, j, 0 as level from roots
  union all
  select report_id, module_no, flag_no, path || step, v, level + 1 from (
    select report_id, module_no, flag_no, level, path, case when path = '' then k else '.' || k end as step, json_extract(j, '$."' || k || '"') as v
      from (select *, unnest(json_keys(j)) as k from walked where json_type(j) = 'OBJECT')
    union all
    select report_id, module_no, flag_no, level, path, '[' || i || ']', json_extract(j, '$[' || i || ']')
      from (select *, unnest(range(cast(json_array_length(j) as bigint))) as i from walked where json_type(j) = 'ARRAY')
  )
)
"""
)
_P2_FOUND = _EVIDENCE + "select report_id, module_no, flag_no, path as evidence_path from walked where json_type(j) not in ('OBJECT', 'ARRAY', 'NULL')"
_P2_EVIDENCE = (
    _EVIDENCE
    + """select report_id, module_no, flag_no, path as evidence_path,
  case json_type(j) when 'VARCHAR' then 'text' when 'BOOLEAN' then 'boolean' else 'number' end as kind, j ->> '$' as scalar
from walked where json_type(j) not in ('OBJECT', 'ARRAY', 'NULL')"""
)
_P2_REPORTS = _DELIVERIES + "select report_id, dataset_id, model_id, report_ts, overall_recommendation, audit_log_ref, cast(coalesce(len(module_results), 0) as integer) as n_modules from chosen"
_P2_MODULES = _DELIVERIES + "select report_id, module_no, m.module_name as module_name, m.coverage_statement as coverage_statement, m.access_mode_used as access_mode_used, coalesce(len(m.flags), 0) as n_flags from modules"
_P2_FLAGS = (
    _DELIVERIES
    + """select report_id, module_no, flag_no, f.id as id, f.module_name as module_name, f.reason as reason, f.confidence as confidence, f.severity as severity,
  f.affected_asset as affected_asset, f.recommended_disposition as recommended_disposition from flags"""
)

_LINES = r"""
with marked as (
  select line_id, export_file, raw_line as raw,
    regexp_full_match(raw_line, '(?s)("([^"]|"")*"|[^",]*)(,("([^"]|"")*"|[^",]*))*') as sound,
    regexp_extract_all(',' || raw_line, '(?s),("(?:[^"]|"")*"|[^",]*)', 1) as cells
  from raw_annotations
), bare as (
  select line_id, export_file, sound, list_transform(cells, lambda c: case when c like '"%' then replace(substr(c, 2, len(c) - 2), '""', '"') else c end) as v from marked
), parts as (
  select *, trim(v[2], ' ') as k, trim(v[4], ' ') as x, trim(v[6], ' ') as w from bare
), judged as (
  select *, case
    when not sound then 'quoting'
    when len(v) <> 7 or len(v) is null then 'column_count'
    when not regexp_full_match(k, '[0-9]+') or coalesce(try_cast(k as bigint) not in (select class_id from class_names), true) then 'class_id'
    when not regexp_full_match(x, '[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?') or not coalesce(try_cast(x as double) between 0 and 1, false) then 'x_center'
    when not regexp_full_match(w, '[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?') or not coalesce(try_cast(w as double) > 0 and try_cast(w as double) <= 1, false) then 'width' end as reason
  from parts
)
"""
_P3_FOUND = _LINES + "select line_id, reason from judged where reason is not null"
_P3_LOADED = (
    _LINES
    + """select line_id, export_file, v[1] as image_path, cast(k as bigint) as class_id, nullif(v[3], '') as class_name, cast(x as double) as x_center,
  try_cast(trim(v[5], ' ') as double) as y_center, cast(w as double) as width, try_cast(trim(v[7], ' ') as double) as height from judged where reason is null"""
)

_SHARES = """
with n as (select count(distinct annotation_id) as n from object_annotations),
c as (select class_id, count(distinct annotation_id) as observed from object_annotations where class_id is not null group by class_id),
t as (select t.*, coalesce(c.observed, 0) as observed, n.n from class_targets t cross join n left join c using (class_id)),
r as (select request_id, class_id, target_share, observed,
        greatest(cast(round(target_share * sample_fraction * n) as bigint), min_rows) as wanted,
        observed < target_share * sample_fraction * n or observed < min_rows as short from t)
"""
_P4_FOUND = _SHARES + "select request_id, class_id from r where short"
_P4_REPORT = (
    _SHARES
    + """, d as (select *, least(wanted, observed) as drawn from r)
select request_id, class_id, target_share, observed, wanted, drawn, greatest(wanted - observed, 0) as deficit,
  round(coalesce(drawn / nullif(sum(drawn) over (partition by request_id), 0), 0), 6) as reached_share from d"""
)

_P5_FOUND = r"""
with r as (
  select load_id, image_path, bbox.x_center as x, bbox.height as h, class_id as k,
    bbox.x_center >= 0 and bbox.x_center <= 1 and not isnan(bbox.x_center) as vx, bbox.height > 0 and bbox.height <= 1 and not isnan(bbox.height) as vh,
    class_id in (select class_id from class_names) as vk
  from object_annotations
), v as (
  select load_id, 'x_center' as column_name, x as val, vx as valid from r union all select load_id, 'height', h, vh from r union all select load_id, 'class_id', cast(k as double), vk from r
), s as (
  select load_id, column_name, count(*) as n_all, count(val) as n, count(*) filter (where valid and val is not null) as n_valid, count(distinct val) as d from v group by all
), b as (
  select v.load_id, v.column_name, c.bucket_no, count(*) as held from v left join column_baseline c on c.column_name = v.column_name
    and ((c.lower_bound = c.upper_bound and v.val = c.lower_bound) or (c.lower_bound < c.upper_bound and v.val >= c.lower_bound and (v.val < c.upper_bound or (v.val = 1 and c.upper_bound = 1))))
  where v.valid and v.val is not null group by all
), g as (
  select s.load_id, s.column_name, c.bucket_no, c.expected_share from s join column_baseline c using (column_name)
  union all select load_id, column_name, null, 0 from s
), shift as (
  select g.load_id, g.column_name, sum(abs(coalesce(b.held, 0) / s.n_valid - g.expected_share)) / 2 as half
  from g join s using (load_id, column_name) left join b on b.load_id = g.load_id and b.column_name = g.column_name and b.bucket_no is not distinct from g.bucket_no
  where s.n_valid > 0 group by all
), p as (
  select load_id, count(image_path) as n, count(*) filter (where image_path is not null and not regexp_full_match(image_path, 'ds_[0-9]{4}/images/[^/\\]+\.(?i:jpg|jpeg|png|bmp|tiff|webp)')) as bad from r group by load_id
)
select load_id, column_name, 'nulls' as issue from s where n_all - n > 0.05 * n_all
union all select load_id, column_name, 'range' from s where n - n_valid > 0.02 * n
union all select load_id, column_name, 'distribution' from shift where half > 0.25
union all select load_id, column_name, 'distinct' from s where column_name <> 'class_id' and n > 0 and d < 0.1 * n
union all select load_id, 'image_path', 'pattern' from p where bad > 0.02 * n
"""


def _column(expr: str, name: str, numeric: bool) -> str:
    number = f"case when not isnan(cast({expr} as double)) then cast({expr} as double) end" if numeric else "cast(null as double)"
    return (
        f"select load_id, '{name}' as column_name, count(*) as n_rows, count(*) - count({expr}) as n_nulls, round((count(*) - count({expr})) / count(*), 6) as null_rate, "
        f"count(distinct {expr}) as n_distinct, round(min({number}), 6) as min_number, round(max({number}), 6) as max_number from object_annotations group by load_id"
    )


_P5_PROFILE = " union all ".join(
    [
        _column("annotation_id", "annotation_id", True),
        _column("image_path", "image_path", False),
        _column("dataset_id", "dataset_id", False),
        _column("class_id", "class_id", True),
        _column("class_name", "class_name", False),
        *[_column(f"bbox.{c}", c, True) for c in ("x_center", "y_center", "width", "height")],
        _column("annotator", "annotator", False),
        _column("annotated_at", "annotated_at", False),
        _column("loaded_at", "loaded_at", False),
    ]
)

_P5_RANGES = " union all ".join(f"select load_id, '{c}' as column_name, min(cast({c} as varchar)) as min_text, max(cast({c} as varchar)) as max_text from object_annotations group by load_id" for c in ("image_path", "dataset_id", "class_name", "annotator", "annotated_at", "loaded_at"))

_SIDES = {"x_center": ">= 0", "y_center": ">= 0", "height": "> 0", "width": "> 0"}
_P5_INVALID = "select load_id, 'class_id' as column_name, count(class_id) as n_values, count(*) filter (where class_id is not null and class_id not in (select class_id from class_names)) as n_invalid from object_annotations group by load_id union all " + " union all ".join(
    f"select load_id, '{c}' as column_name, count(bbox.{c}) as n_values, count(*) filter (where bbox.{c} is not null and not (not isnan(bbox.{c}) and bbox.{c} {low} and bbox.{c} <= 1)) as n_invalid from object_annotations group by load_id" for c, low in _SIDES.items()
)

ORACLES = {
    "p1_found": _P1_FOUND,
    "p1_records": _P1_RECORDS,
    "p1_roundtrip": _P1_ROUNDTRIP,
    "p2_found": _P2_FOUND,
    "p2_evidence": _P2_EVIDENCE,
    "p2_reports": _P2_REPORTS,
    "p2_modules": _P2_MODULES,
    "p2_flags": _P2_FLAGS,
    "p3_found": _P3_FOUND,
    "p3_loaded": _P3_LOADED,
    "p4_found": _P4_FOUND,
    "p4_report": _P4_REPORT,
    "p5_found": _P5_FOUND,
    "p5_profile": _P5_PROFILE,
    "p5_ranges": _P5_RANGES,
    "p5_invalid": _P5_INVALID,
}
