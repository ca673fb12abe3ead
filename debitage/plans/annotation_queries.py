"""Annotations, metadata, review queues and scalar functions over events, customer, documents and pages."""

from __future__ import annotations



from pyspark.sql import functions as F

from debitage.functions import scalars as X
from debitage.operators import annotations as A
from debitage.plans import demo
from debitage.plans.demo import sql, table
from debitage.plans.registry import query, rounded

# events: user_id is the annotation, event_id the order; click and view draw, error erases, other types restore

OPS = "case when event_type in ('click', 'view') then 'draw' when event_type = 'error' then 'erase' else 'other' end"
EDGE_SQL = f"e as (select user_id as annotation_id, event_id as seq, {OPS} as op, floor(abs(value))::bigint % 40 as vertex_id from events where {OPS} <> 'other')"


def _events(spark, sf):
    e = table(spark, sf, "events")
    return e.select(F.col("user_id").alias("annotation_id"), F.col("event_id").alias("seq"), F.expr(OPS).alias("op"), (F.floor(F.abs("value")) % 40).alias("vertex_id")).where("op <> 'other'")


@query("st1_current_edge_set", f"with {EDGE_SQL} select annotation_id, vertex_id from (select *, row_number() over (partition by annotation_id, vertex_id order by seq desc) as rn from e) where rn = 1 and op = 'draw'")
def st1(spark, sf):
    return A.current_edges(_events(spark, sf))


def _sets(spark, sf):
    e = _events(spark, sf)
    return e.where("op = 'draw'").select("annotation_id", "vertex_id").distinct(), e.where("op = 'erase'").select("annotation_id", "vertex_id").distinct()


@query("u1_add_edges", f"with {EDGE_SQL} select distinct annotation_id, vertex_id from e")
def u1(spark, sf):
    return A.add_edges(*_sets(spark, sf))


@query("u2_remove_edges", f"with {EDGE_SQL} select distinct annotation_id, vertex_id from e where op = 'draw' except select annotation_id, vertex_id from e where op = 'erase'")
def u2(spark, sf):
    return A.remove_edges(*_sets(spark, sf))


def _pairs(edges, half=10):
    ids = edges.select("annotation_id").distinct()
    return ids.select(F.col("annotation_id").alias("left_id"), (F.col("annotation_id") + 1).alias("right_id"))


BY8 = "d as (select distinct user_id as annotation_id, (floor(abs(value))::bigint % 3) as vertex_id from events where event_type in ('click', 'view')), s as (select annotation_id, list_sort(list(vertex_id)) as l from d group by all), pr as (select annotation_id as left_id, annotation_id + 1 as right_id from s)"
ARROWS = "ar as (select user_id as annotation_id, list([floor(abs(value))::bigint % 2, 1::bigint] order by event_id) as l, count(*) as n from events where event_type = 'error' group by all)"


def _coarse(spark, sf):
    edges = table(spark, sf, "events").where("event_type in ('click', 'view')").select(F.col("user_id").alias("annotation_id"), (F.floor(F.abs("value")) % 3).alias("vertex_id")).distinct()
    arrows = table(spark, sf, "events").where("event_type = 'error'").select(F.col("user_id").alias("annotation_id"), F.col("event_id").alias("pos"), (F.floor(F.abs("value")) % 2).alias("start_index"), F.lit(1).cast("long").alias("end_index"))
    return edges, arrows


@query("u3_same_edges", f"with {BY8} select left_id, right_id, a.l is not distinct from b.l as same from pr left join s a on a.annotation_id = left_id left join s b on b.annotation_id = right_id")
def u3(spark, sf):
    edges, _ = _coarse(spark, sf)
    return A.same_edges(_pairs(edges), edges)


@query("u4_equal_annotations", f"with {BY8}, {ARROWS} select left_id, right_id, (a.l is not distinct from b.l) and (c.l is not distinct from d.l) as same from pr left join s a on a.annotation_id = left_id left join s b on b.annotation_id = right_id left join ar c on c.annotation_id = left_id left join ar d on d.annotation_id = right_id")
def u4(spark, sf):
    edges, arrows = _coarse(spark, sf)
    return A.equal_annotations(_pairs(edges), edges, arrows)


@query("u5_unsaved_changes", f"with {BY8}, {ARROWS} select left_id, right_id, (a.l is distinct from b.l) or coalesce(c.n, 0) <> coalesce(d.n, 0) as unsaved from pr left join s a on a.annotation_id = left_id left join s b on b.annotation_id = right_id left join ar c on c.annotation_id = left_id left join ar d on d.annotation_id = right_id")
def u5(spark, sf):
    edges, arrows = _coarse(spark, sf)
    return A.unsaved(_pairs(edges), edges, arrows)


LIB_OP = "case event_id % 7 when 0 then 'delete' when 1 then 'save' when 2 then 'save' when 3 then 'update' when 4 then 'update' when 5 then 'rename' else 'update' end"
LIB = f"lg as (select user_id % 50 as annotation_id, event_id as seq, {LIB_OP} as op, event_type as name, case when event_id % 5 = 0 then event_id end as cloud_id, ts from events)"
LIVE = """bn as (select annotation_id, max(case when op = 'delete' then seq end) as gone, min(case when op = 'save' then seq end) as b0 from lg group by all),
lv as (select lg.* from lg join bn using (annotation_id) where op <> 'delete' and (gone is null or seq > gone)),
lw as (select lv.* from lv join (select annotation_id, min(seq) as born from lv where op = 'save' group by all) using (annotation_id) where seq >= born),
lb as (select annotation_id, arg_max(name, seq) as name, arg_max(cloud_id, seq) filter (where cloud_id is not null) as cloud_id, max(ts) filter (where seq = ms) as modified_at from (select *, max(seq) over (partition by annotation_id) as ms from lw) group by annotation_id)"""


def _library(spark, sf):
    e = table(spark, sf, "events")
    log = e.select((F.col("user_id") % 50).alias("annotation_id"), F.col("event_id").alias("seq"), F.expr(LIB_OP).alias("op"), F.col("event_type").alias("name"), F.when(F.col("event_id") % 5 == 0, F.col("event_id")).alias("cloud_id"), "ts")
    return A.library(log)


@query("m5_st3_library_upsert", f"with {LIB}, {LIVE} select annotation_id, name, cloud_id, strftime(modified_at, '%Y-%m-%d %H:%M:%S') as modified from lb")
def m5(spark, sf):
    return _library(spark, sf).select("annotation_id", "name", "cloud_id", F.date_format("modified_at", "yyyy-MM-dd HH:mm:ss").alias("modified"))


@query("w6_annotations_newest_first", f"with {LIB}, {LIVE} select annotation_id % 3 as mesh_id, annotation_id, (row_number() over (partition by annotation_id % 3 order by modified_at desc, annotation_id))::int as shown from lb")
def w6(spark, sf):
    return A.newest_first(_library(spark, sf).withColumn("mesh_id", F.col("annotation_id") % 3)).select("mesh_id", "annotation_id", "shown")


@query("m6_import_by_cloud_id", f"with {LIB}, {LIVE} select i.cloud_id, coalesce(annotation_id, i.cloud_id + 1000000) as annotation_id, case when annotation_id is null then 'insert' else 'update' end as action from (select distinct event_id as cloud_id from events) i left join lb using (cloud_id)")
def m6(spark, sf):
    incoming = table(spark, sf, "events").select(F.col("event_id").alias("cloud_id"), (F.col("event_id") + 1_000_000).alias("new_id")).distinct()
    return A.import_by_cloud_id(incoming, _library(spark, sf))


@query("m7_sync_status", f"with {LIB}, {LIVE} select annotation_id % 3 as mesh_id, count(*) as n, count(*) filter (where cloud_id is null) as unsynced from lb group by 1")
def m7(spark, sf):
    return A.sync_status(_library(spark, sf).withColumn("mesh_id", F.col("annotation_id") % 3))


@query("m8_st2_history_states", None)
def m8(spark, sf):
    op = F.expr("case event_id % 4 when 0 then 'undo' when 1 then 'redo' else 'act' end")
    return A.history_states(table(spark, sf, "events").select(F.col("user_id").alias("mesh_id"), F.col("event_id").alias("seq"), op.alias("op")))


# metadata: events.props as JSON, event types as keys

KEY = "case event_id % 8 when 0 then 'annotator' when 1 then 'annotation_date' when 2 then 'two words' when 3 then 'annotation-metadata' when 4 then 'state-metadata' when 5 then 'annotation' else event_type end"
VALUE_OF = "case when event_id % 11 = 0 then null when event_id % 8 = 3 or event_id % 3 = 0 then props else event_type end"
META = f"mt as (select event_id as mesh_id, {KEY} as key, {VALUE_OF} as value from events)"
SPLIT = """sp as (select mesh_id, j.k as key, json_extract_string(mt.value, '$.' || j.k) as value, 'annotation' as side from mt, lateral (select unnest(json_keys(case when mt.value like '{%' then mt.value else '{}' end)) as k) j where mt.key in ('annotation-metadata', 'state-metadata') and value like '{%'
 union all select mesh_id, key, value, case when key in ('evaluation', 'model_params', 'annotator', 'annotation_date', 'annotation_source') then 'annotation' else 'mesh' end from mt where key not in ('annotation-metadata', 'state-metadata'))"""


def _meta(spark, sf):
    return table(spark, sf, "events").select(F.col("event_id").alias("mesh_id"), F.expr(KEY).alias("key"), F.expr(VALUE_OF).alias("value"))


@query("m1_split_metadata", f"with {META}, {SPLIT} select mesh_id, key, value, side from sp")
def m1(spark, sf):
    return A.split_metadata(_meta(spark, sf))


# two events share a mesh, so an annotation can have two members
BOTH = "case when value is null then 'null' when value like '{%' then value when regexp_full_match(value, '[0-9]+') then value else '\"' || value || '\"' end"


@query("m2_combine_metadata", f"with {META}, {SPLIT}, tw as (select mesh_id // 2 as mesh_id, key, value, side from sp) select mesh_id, key, value from tw where side = 'mesh' union all select mesh_id, 'annotation-metadata', '{{' || string_agg('\"' || key || '\":' || {BOTH}, ',' order by key, value) || '}}' from tw where side = 'annotation' group by mesh_id")
def m2(spark, sf):
    return A.combine_metadata(A.split_metadata(_meta(spark, sf)).withColumn("mesh_id", F.floor(F.col("mesh_id") / 2)))


@query("m3_metadata_lines", f"with {META} select mesh_id, case when regexp_matches(value, '^\\s*[\\[{{]') then 'comment metadata:json ' else 'comment metadata ' end || key || ' ' || value as line from mt where value is not null and not regexp_matches(key, '\\s')")
def m3(spark, sf):
    return A.metadata_lines(_meta(spark, sf))


DEEP = 40


@query("m4_s10_flatten_metadata", f"select event_id as mesh_id, 'outer.' || repeat('d.', {DEEP}) || 'k' as path, json_extract_string(props, '$.k') as value from events where props is not null union all select event_id, 'outer.list', '[1,2]' from events where props is not null union all select event_id, 'type', '\"' || event_type || '\"' from events where props is not null")
def m4(spark, sf):
    inner = F.concat(F.lit('{"d":' * DEEP), "props", F.lit("}" * DEEP))
    e = table(spark, sf, "events").where("props is not null")
    # the object in props lies under forty others
    return A.flatten_metadata(e.select(F.col("event_id").alias("mesh_id"), F.concat(F.lit('{"outer": '), F.regexp_replace(inner, r"\}$", ', "list": [1, 2], "none": {}}'), F.lit(', "type": "'), "event_type", F.lit('"}')).alias("json")))


ITEMS = "it as (select c_nationkey::bigint as dataset, c_custkey as item, c_name as original_name, 'f' || c_custkey as filename, case when c_acctbal < 0 then 'reject' when c_acctbal > 5000 then 'accept' end as verdict from customer)"


def _items(spark, sf):
    c = table(spark, sf, "customer")
    verdict = F.expr("case when c_acctbal < 0 then 'reject' when c_acctbal > 5000 then 'accept' end")
    return c.select(F.col("c_nationkey").cast("long").alias("dataset"), F.col("c_custkey").alias("item"), F.col("c_custkey").alias("mesh_id"), F.col("c_name").alias("original_name"), F.concat(F.lit("f"), "c_custkey").alias("filename"), verdict.alias("verdict"))


@query("m9_review_queue", f"with {ITEMS} select dataset, item, (row_number() over (partition by dataset order by item) - 1)::int as position from it where verdict is null")
def m9(spark, sf):
    return A.review_queue(_items(spark, sf), True).select("dataset", "item", "position")


@query("w7_first_unlabelled", f"with {ITEMS} select dataset, min(item) as item from it where verdict is null group by dataset")
def w7(spark, sf):
    return A.first_unlabelled(_items(spark, sf))


@query("a20_st4_review_progress", f"with {ITEMS} select dataset, count(verdict) as verified, count(*) filter (where verdict is null) as pending, count(*) as total from it group by dataset")
def a20(spark, sf):
    return A.review_progress(_items(spark, sf))


@query("m10_effective_parameters", f"with {ITEMS} select item as mesh_id, case when verdict = 'accept' and item % 2 = 0 then 0.3::double else 0.45::double end as max_merge_cost, case when verdict = 'accept' and item % 2 = 0 then 20::double else 50::double end as min_segment_size from it")
def m10(spark, sf):
    items = _items(spark, sf)
    states = items.where("mesh_id % 2 = 0").select("mesh_id", F.lit("verification-accept").alias("state"), F.lit(0.3).alias("max_merge_cost"), F.lit(20.0).alias("min_segment_size"))
    return A.effective_parameters(items, states, {"max_merge_cost": 0.45, "min_segment_size": 50.0})


@query("m11_verdict_records", f"with {ITEMS} select item as mesh_id, 'verification-' || verdict as state, case when verdict = 'accept' then coalesce((select count(*) from orders where o_custkey = item), 0) else 0 end as n_edges from it where verdict is not null")
def m11(spark, sf):
    edges = table(spark, sf, "orders").select(F.col("o_custkey").alias("mesh_id"))
    return A.verdict_records(_items(spark, sf), edges)


@query("f7_name_search", f"with {ITEMS} select item from it where instr(lower(original_name), '07') > 0")
def f7(spark, sf):
    return A.name_search(_items(spark, sf), " 07 ").select("item")


@query("f8_score_threshold", sql("select mesh_id, face_id, (case when p > 0.5 then 1 else 0 end)::int as label from fs"))
def f8(spark, sf):
    v = demo.vertices(spark, sf)
    return demo.face_scores(v, demo.faces(v)).select("mesh_id", "face_id", X.score_label(F.col("p")).alias("label"))


@query("x1_x5_distance_and_angle", sql("select mesh_id, face_id, round(sqrt((x1-x0)**2+(y1-y0)**2+(z1-z0)**2), 6) as side, round(degrees(acos(greatest(-1, least(1, ((x0-x1)*(x2-x1)+(y0-y1)*(y2-y1)+(z0-z1)*(z2-z1))/(sqrt((x0-x1)**2+(y0-y1)**2+(z0-z1)**2)*sqrt((x2-x1)**2+(y2-y1)**2+(z2-z1)**2)))))), 5) as angle from fp"))
def x1(spark, sf):
    from debitage.operators.geometry import face_points

    v = demo.vertices(spark, sf)
    p = face_points(demo.faces(v), v)
    at = lambda k: tuple(F.col(f"{a}{k}") for a in "xyz")
    return p.select("mesh_id", "face_id", F.round(X.distance(at(0), at(1)), 6).alias("side"), F.round(F.degrees(X.angle_at(at(0), at(1), at(2))), 5).alias("angle"))


UNITS = "case c_custkey % 6 when 0 then 'um' when 1 then 'mm' when 2 then 'cm' when 3 then 'm' when 4 then 'in' else 'raw' end"
FACTOR = "case u when 'um' then 0.001 when 'cm' then 10 when 'm' then 1000 when 'in' then 25.4 else 1 end::double"


@query("x2_unit_conversion", f"select c_custkey, round(c_acctbal * {FACTOR}, 3) + 0 as length, round(c_acctbal / 1000 * {FACTOR} * {FACTOR}, 3) + 0 as area, round(c_acctbal / {FACTOR}, 3) + 0 as back from (select *, case when c_custkey % 7 = 0 then 'furlong' else {UNITS} end as u from customer)")
def x2(spark, sf):
    c = table(spark, sf, "customer").withColumn("u", F.expr(f"case when c_custkey % 7 = 0 then 'furlong' else {UNITS} end"))
    mm = F.lit("mm")
    return rounded(c.select("c_custkey", X.converted(F.col("c_acctbal"), F.col("u"), mm).alias("length"), X.converted(F.col("c_acctbal") / 1000, F.col("u"), mm, 2).alias("area"), X.converted(F.col("c_acctbal"), mm, F.col("u")).alias("back")), 3)


# ties of one decimal are the values whose quadruple is odd
SHOWN = "case u when 'um' then case when abs(c_acctbal * 4) % 2 = 1 then format('{:.1f} μm', round(c_acctbal, 1)) else format('{:.1f} μm', c_acctbal) end when 'mm' then format('{:.2f} mm', c_acctbal) when 'cm' then format('{:.3f} cm', c_acctbal) when 'm' then format('{:.4f} m', c_acctbal) when 'in' then format('{:.3f} in', c_acctbal) else format('{:.2f}', c_acctbal) end"


@query("x3_value_with_symbol", f"select c_custkey, {SHOWN} as shown, {SHOWN} || case when u = 'raw' then '' else '²' end as area from (select *, {UNITS} as u from customer)")
def x3(spark, sf):
    shown = lambda power: X.with_symbol(F.col("c_acctbal"), F.expr(UNITS), power)
    return table(spark, sf, "customer").select("c_custkey", shown(1).alias("shown"), shown(2).alias("area"))


@query("x4_effective_unit", f"select c_custkey, coalesce(nullif(case when c_custkey % 2 = 0 then 'auto' else {UNITS} end, 'auto'), case when c_custkey % 4 = 0 then 'cm' end, 'mm') as unit from customer")
def x4(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", X.effective_unit(F.expr(f"case when c_custkey % 2 = 0 then 'auto' else {UNITS} end"), F.expr("case when c_custkey % 4 = 0 then 'cm' end"), F.lit(None).cast("string")).alias("unit"))


@query("x6_edge_keys", "select l_orderkey, l_linenumber, least(l_partkey, l_suppkey) as lo, greatest(l_partkey, l_suppkey) as hi from lineitem")
def x6(spark, sf):
    k = X.edge_key(F.col("l_partkey"), F.col("l_suppkey"))
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", k["lo"].alias("lo"), k["hi"].alias("hi"))


# The stops of the colour maps
MAPS = {
    "blueRed": "[[0.23, 0.30, 0.75], [0.13, 0.70, 0.80], [0.55, 0.83, 0.35], [0.95, 0.85, 0.20], [0.84, 0.19, 0.15]]",
    "viridis": "[[0.27, 0.00, 0.33], [0.28, 0.22, 0.55], [0.13, 0.40, 0.55], [0.15, 0.58, 0.43], [0.48, 0.73, 0.22], [0.99, 0.91, 0.14]]",
    "plasma": "[[0.05, 0.03, 0.53], [0.42, 0.00, 0.66], [0.72, 0.10, 0.54], [0.95, 0.35, 0.24], [0.98, 0.72, 0.08], [0.94, 0.97, 0.13]]",
    "coolwarm": "[[0.23, 0.30, 0.75], [0.55, 0.60, 0.88], [0.87, 0.87, 0.87], [0.88, 0.55, 0.50], [0.75, 0.15, 0.15]]",
    "turbo": "[[0.19, 0.07, 0.23], [0.14, 0.40, 0.82], [0.06, 0.72, 0.65], [0.35, 0.88, 0.30], [0.78, 0.87, 0.14], [0.98, 0.58, 0.07], [0.84, 0.19, 0.15]]",
}


def _channel(stops: str, k: int) -> str:
    n = stops.count("[") - 2
    i = f"least(floor(t * {n}), {n - 1})::int"
    low, high = f"({stops}::double[][])[{i} + 1][{k}]", f"({stops}::double[][])[{i} + 2][{k}]"
    return f"({low} + ({high} - {low}) * (t * {n} - {i}))"


CLAMPED = "(select *, greatest(0, least(1, l_discount * 12.5 - 0.1))::double as t from lineitem)"


@query("x7_colour_maps", "select l_orderkey, l_linenumber, " + ", ".join(f"round({_channel(s, k)}, 9) as {n}_{c}" for n, s in MAPS.items() for k, c in enumerate(("red", "green", "blue"), 1)) + f" from {CLAMPED}")
def x7(spark, sf):
    t = F.col("l_discount") * 12.5 - 0.1
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", *(F.round(X.colour(n, t)[c], 9).alias(f"{n}_{c}") for n in MAPS for c in ("red", "green", "blue")))


@query("x7_colour_hex", "select l_orderkey, l_linenumber, " + ", ".join("'#' || " + " || ".join(f"format('{{:02x}}', floor({_channel(s, k)} * 255 + 0.5)::int)" for k in (1, 2, 3)) + f" as {n}" for n, s in MAPS.items()) + f" from {CLAMPED}")
def x7_hex(spark, sf):
    t = F.col("l_discount") * 12.5 - 0.1
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", *(X.hex_colour(X.colour(n, t)).alias(n) for n in MAPS))


@query("x8_score_hue", "select l_orderkey, l_linenumber, round((1 - l_discount) * 0.667, 6) as hue from lineitem")
def x8(spark, sf):
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.round(X.hue(F.col("l_discount")), 6).alias("hue"))


VALUE = "case event_id % 8 when 0 then 'true' when 1 then 'false' when 2 then ' ' when 3 then '' || value when 4 then '12' when 5 then props when 6 then null else '1e3x' end"


@query("x9_x10_typed_values", f"select event_id, case when t is null or t in ('true', 'false') then 'boolean' when regexp_full_match(t, '\\s*[+-]?(\\d+\\.?\\d*|\\.\\d+)([eE][+-]?\\d+)?\\s*') then 'number' else 'string' end as kind, case when t is null or t = 'true' then true when t = 'false' then false end as flag from (select event_id, {VALUE} as t from events)")
def x9(spark, sf):
    t = X.typed_value(F.expr(VALUE))
    return table(spark, sf, "events").select("event_id", t["kind"].alias("kind"), t["flag"].alias("flag"))


TYPED = "case event_id % 12 when 0 then 'true' when 1 then '' when 2 then ' ' when 3 then ' -1.5e3 ' when 4 then '0x1F' when 5 then props when 6 then '[1, {}]' when 7 then '{broken}' when 8 then 'True' when 9 then '\"quoted\"' when 10 then 'null' else '12.' end"
TYPED_AS = "case event_id % 12 when 0 then 'true' when 1 then '\"\"' when 2 then '0' when 3 then '-1500' when 4 then '31' when 5 then replace(props, ' ', '') when 6 then '[1,{}]' when 7 then '\"{broken}\"' when 8 then '\"True\"' when 9 then '\"\\\"quoted\\\"\"' when 10 then '\"null\"' else '12' end"


@query("x10_parsed_values", f"select event_id, {TYPED_AS} as value from events where props is not null")
def x10(spark, sf):
    value = F.regexp_replace(F.to_json(X.parsed_value(F.expr(TYPED))), r"\.0$", "")
    return table(spark, sf, "events").where("props is not null").select("event_id", value.alias("value"))


TIME_KEY = "case event_id % 6 when 0 then 'createdAt' when 1 then 'exportedAt' when 2 then 'updatedAt' when 3 then 'count' when 4 then 'created' else 'upload_Date' end"
MILLIS = "case when event_id % 5 = 0 then 4102444800001 when event_id % 5 = 1 then 946684799999 else epoch_ms(ts) end"


@query("x11_timestamps", f"select event_id, k in ('createdAt', 'exportedAt') and ms between 946684800000 and 4102444800000 as is_time, k in ('createdAt', 'exportedAt', 'updatedAt', 'created', 'upload_Date') and ms between 946684800000 and 4102444800000 as shows_time from (select event_id, {TIME_KEY} as k, {MILLIS} as ms from events)")
def x11(spark, sf):
    e = table(spark, sf, "events")
    key, ms = F.expr(TIME_KEY), F.expr(MILLIS.replace("epoch_ms(ts)", "unix_millis(cast(ts as timestamp))"))
    return e.select("event_id", X.is_time(key, ms).alias("is_time"), X.shows_time(key, ms).alias("shows_time"))


ODD_NAME = r"case doc_id % 3 when 0 then chr(9) || chr(160) || ' ' || chr(1) || ' ' || coalesce(text, '') when 1 then text else text || chr(8232) end"


@query("x12_clean_names", r"select doc_id, substring(regexp_replace(regexp_replace(coalesce(t, ''), '^[\t-\r \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]+|[\t-\r \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]+$', '', 'g'), '[\x00-\x1F\x7F]', '', 'g'), 1, 200) as name from (select doc_id, " + ODD_NAME + " as t from documents)")
def x12(spark, sf):
    odd = F.expr(ODD_NAME.replace("chr(160)", "'\u00a0'").replace("chr(8232)", "'\u2028'"))
    return table(spark, sf, "documents").select("doc_id", X.clean_name(odd).alias("name"))


@query("x13_html_escape", "select page_id, replace(replace(replace(replace(coalesce(html, ''), '&', '&amp;'), chr(160), '&nbsp;'), '<', '&lt;'), '>', '&gt;') as inside, replace(replace(replace(replace(replace(coalesce(html, ''), '&', '&amp;'), '\"', '&quot;'), chr(39), '&#39;'), '<', '&lt;'), '>', '&gt;') as attribute from pages")
def x13(spark, sf):
    return table(spark, sf, "pages").select("page_id", X.html_escape(F.col("html")).alias("inside"), X.attribute_escape(F.col("html")).alias("attribute"))


@query("x14_csv_escape", "select doc_id, case when regexp_matches(text, '[\",\\n\\r]') then '\"' || replace(text, '\"', '\"\"') || '\"' else text end as field from documents")
def x14(spark, sf):
    return table(spark, sf, "documents").select("doc_id", X.csv_escape(F.col("text")).alias("field"))


@query("x15_previews", "select doc_id, case when length(text) > 80 then substring(text, 1, 77) || '...' else text end as preview, case when length(text) > 60 then substring(text, 1, 57) || '...' else text end as json_preview from documents")
def x15(spark, sf):
    return table(spark, sf, "documents").select("doc_id", X.preview(F.col("text")).alias("preview"), X.preview(F.col("text"), 60).alias("json_preview"))
