"""The operators on the test tables, each with the SQL that must give the same rows.

No network tables exist there, so every operator runs on a shape derived from whole tables:
tracks from events, points from customers and suppliers, links from orders and line items, dirty
columns from orders, text lines from documents.  Expressions that both engines understand are
written once and used on both sides.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from waterloom.functions import crs, geometry, labels, numbers, similarity, text
from waterloom.operators import (
    detect, graph, matching, merge, ordered, polylines, profiling, spatial, validate,
)
from waterloom.plans import mapping, model_text, update
from waterloom.plans.features import extent, feature_json, point_features
from waterloom.session import ensure_checkpoint_dir, materialize
from waterloom.sources import csvfiles, dxf, inp
from waterloom.sources.lines import lines_of, read_lines

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return keep


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def r4(value) -> Column:
    return numbers.round_half_up(F.col(value) if isinstance(value, str) else value, 4)


def R(expr: str) -> str:
    return f"floor(({expr}) * 1e4 + 0.5) / 1e4"


# ---- tracks ------------------------------------------------------------------------------

MICROS = "timestampdiff(MICROSECOND, timestamp_ntz'2024-01-01 00:00:00', CAST(ts AS timestamp_ntz))"
TRACK = """tr AS (SELECT user_id, event_id, ts, (epoch_us(ts) - 1704067200000000) / 1e7 AS x,
  value AS y, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS v_no FROM events)"""
STEPS = TRACK + """, st AS (SELECT *, lag(x) OVER w AS px, lag(y) OVER w AS py FROM tr
  WINDOW w AS (PARTITION BY user_id ORDER BY v_no)),
ds AS (SELECT *, coalesce(sqrt((px - x) * (px - x) + (py - y) * (py - y)), 0.0) AS step FROM st),
cu AS (SELECT *, sum(step) OVER (PARTITION BY user_id ORDER BY v_no
  ROWS UNBOUNDED PRECEDING) AS cumul FROM ds)"""
ORDER = ["ts", "event_id"]


def tracks(spark, d, numbered: bool = False) -> DataFrame:
    df = table(spark, d, "events").select(
        "user_id", "event_id", "ts", F.expr(f"{MICROS} / 1e7").alias("x"), F.col("value").alias("y"))
    return ordered.Sequence(df, "user_id", ORDER).row_number("v_no").df if numbered else df


@query("track_length", f"""WITH {STEPS} SELECT user_id, {R('sum(step)')} AS length,
 count(*) AS vertices FROM ds GROUP BY user_id""")
def track_length(spark, d):
    out = polylines.lengths(tracks(spark, d), ["user_id"], ORDER)
    return out.select("user_id", r4("length").alias("length"), "vertices")


@query("track_cumulative", f"WITH {STEPS} SELECT user_id, event_id, {R('cumul')} AS cumul FROM cu")
def track_cumulative(spark, d):
    out = polylines.cumulative(tracks(spark, d), ["user_id"], ORDER)
    return out.select("user_id", "event_id", r4("cumul").alias("cumul"))


@query("track_boxes", f"""WITH {TRACK} SELECT user_id, {R('min(x)')} AS x0, {R('min(y)')} AS y0,
 {R('max(x)')} AS x1, {R('max(y)')} AS y1, {R('avg(x)')} AS mean_x, {R('avg(y)')} AS mean_y,
 count(*) AS vertices FROM tr GROUP BY user_id""")
def track_boxes(spark, d):
    out = polylines.boxes(tracks(spark, d), ["user_id"])
    return out.select("user_id", *[r4(c).alias(c) for c in
                                   ("x0", "y0", "x1", "y1", "mean_x", "mean_y")], "vertices")


@query("track_segments", f"""WITH {TRACK}, nx AS (SELECT *, lead(x) OVER w AS x2, lead(y) OVER w AS y2
 FROM tr WINDOW w AS (PARTITION BY user_id ORDER BY v_no)), sg AS (SELECT *,
 sqrt((x - x2) * (x - x2) + (y - y2) * (y - y2)) AS len FROM nx WHERE x2 IS NOT NULL)
 SELECT user_id, event_id, {R('x2')} AS x2, {R('y2')} AS y2, {R('len')} AS length
 FROM sg WHERE len >= 0.001""")
def track_segments(spark, d):
    out = polylines.segments(tracks(spark, d), ["user_id"], ORDER, shortest=0.001)
    return out.select("user_id", "event_id", *[r4(c).alias(c) for c in ("x2", "y2", "length")])


@query("points_at_distance", f"""WITH {STEPS}, tot AS (SELECT user_id, max(cumul) AS total FROM cu
 GROUP BY user_id), tg AS (SELECT user_id, i AS pos, total * (i - 1) / 8.0 AS dist
 FROM tot, range(0, 11) t(i)), se AS (SELECT *, lag(cumul) OVER (PARTITION BY user_id ORDER BY v_no)
 AS pcum FROM cu), hit AS (SELECT tg.user_id, tg.pos, tg.dist, min(se.v_no) AS v_no FROM tg JOIN se
 ON se.user_id = tg.user_id AND se.cumul >= greatest(tg.dist, 0.0) GROUP BY ALL),
 la AS (SELECT user_id, max(v_no) AS last_no FROM tr GROUP BY user_id)
 SELECT tg.user_id, tg.pos,
 {R("CASE WHEN h.v_no IS NULL THEN l.x WHEN tg.dist > 0 AND s.pcum IS NOT NULL THEN s.px + (tg.dist - s.pcum) / (s.cumul - s.pcum) * (s.x - s.px) ELSE s.x END")} AS x,
 {R("CASE WHEN h.v_no IS NULL THEN l.y WHEN tg.dist > 0 AND s.pcum IS NOT NULL THEN s.py + (tg.dist - s.pcum) / (s.cumul - s.pcum) * (s.y - s.py) ELSE s.y END")} AS y
 FROM tg LEFT JOIN hit h ON h.user_id = tg.user_id AND h.pos = tg.pos
 LEFT JOIN se s ON s.user_id = h.user_id AND s.v_no = h.v_no
 JOIN la ON la.user_id = tg.user_id JOIN tr l ON l.user_id = tg.user_id AND l.v_no = la.last_no""")
def points_at_distance(spark, d):
    line = tracks(spark, d, numbered=True)
    total = polylines.cumulative(line, ["user_id"]).groupBy("user_id").agg(
        F.max("cumul").alias("total"))
    asked = total.select("user_id", F.explode(F.sequence(F.lit(0), F.lit(10))).alias("i"), "total")
    asked = asked.select("user_id", F.col("i").cast("bigint").alias("pos"),
                         (F.col("total") * (F.col("i") - 1) / 8.0).alias("dist"))
    out = polylines.points_at(line, asked, ["user_id"])
    return out.select("user_id", "pos", r4("x").alias("x"), r4("y").alias("y"))


PLAN_X = "CASE WHEN user_id % 3 = 0 THEN x ELSE x + 500000.0 + user_id * 100 END"
PLAN_Y = "CASE WHEN user_id % 3 = 0 THEN y WHEN user_id % 3 = 1 THEN y / 200.0 + 2000001.0 ELSE y + 2000001.0 END"


@query("geometry_class", f"""WITH {TRACK}, p AS (SELECT user_id, event_type_x.x, event_type_x.y FROM
 (SELECT user_id, {PLAN_X} AS x, {PLAN_Y} AS y FROM tr) event_type_x),
 m AS (SELECT coalesce(avg(x) > 300000 AND avg(y) > 1000000, false) AS strict FROM p),
 b AS (SELECT user_id, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM p GROUP BY user_id)
 SELECT user_id, strict, CASE WHEN NOT strict THEN 'pipe'
 WHEN NOT ((x0 + x1) / 2 > 500000 AND (y0 + y1) / 2 > 2000000) THEN 'profile_zone'
 WHEN x1 - x0 < 5 AND y1 - y0 > 50 THEN 'profile_vertical'
 WHEN y1 - y0 < 5 AND x1 - x0 > 50 THEN 'profile_horizontal'
 WHEN x1 - x0 > 100 AND y1 - y0 > 100 AND least(x1 - x0, y1 - y0) / greatest(x1 - x0, y1 - y0) < 0.05
 THEN 'profile_diagonal' ELSE 'pipe' END AS class FROM b, m""")
def geometry_class(spark, d):
    moved = tracks(spark, d).select(
        "user_id", F.lit("all").alias("file"), F.expr(PLAN_X).alias("x"), F.expr(PLAN_Y).alias("y"))
    mode = polylines.coordinate_mode(moved, ["file"])
    boxes = polylines.boxes(moved, ["file", "user_id"]).join(F.broadcast(mode), "file")
    kind = geometry.geometry_class(F.col("strict"), *[F.col(c) for c in ("x0", "y0", "x1", "y1")])
    return boxes.select("user_id", "strict", kind.alias("class"))


# ---- points ------------------------------------------------------------------------------

CX, CY = "CAST(c_acctbal AS DOUBLE)", "CAST((c_custkey * 7919) % 10007 AS DOUBLE)"
SX, SY = "CAST(s_acctbal AS DOUBLE)", "CAST((s_suppkey * 6151) % 10007 AS DOUBLE)"
POINTS = f"""c AS (SELECT c_custkey, {CX} AS x, {CY} AS y FROM customer),
s AS (SELECT s_suppkey, {SX} AS x, {SY} AS y FROM supplier),
pr AS (SELECT c_custkey, s_suppkey, sqrt((c.x - s.x) * (c.x - s.x) + (c.y - s.y) * (c.y - s.y)) AS d,
 abs(c.x - s.x) AS ax, abs(c.y - s.y) AS ay FROM c, s)"""


def customers_at(spark, d):
    return table(spark, d, "customer").select(
        "c_custkey", "c_nationkey", F.expr(CX).alias("x"), F.expr(CY).alias("y"))


def suppliers_at(spark, d):
    return table(spark, d, "supplier").select(
        "s_suppkey", F.col("s_suppkey").alias("o"), F.expr(SX).alias("x"), F.expr(SY).alias("y"))


def _nearest_sql(where: str) -> str:
    return f"""WITH {POINTS}, k AS (SELECT *, row_number() OVER (PARTITION BY c_custkey
 ORDER BY d, s_suppkey) AS n FROM pr {where}) SELECT c_custkey, s_suppkey, {R('d')} AS distance
 FROM k WHERE n = 1"""


@query("nearest_within", _nearest_sql("WHERE d < 500.0"))
def nearest_within(spark, d):
    out = spatial.nearest(customers_at(spark, d), suppliers_at(spark, d), probe_key="c_custkey",
                          point_key="s_suppkey", order="o", radius=500.0)
    return out.withColumn("distance", r4("distance"))


@query("nearest_any", _nearest_sql(""))
def nearest_any(spark, d):
    out = spatial.nearest(customers_at(spark, d), suppliers_at(spark, d), probe_key="c_custkey",
                          point_key="s_suppkey", order="o")
    return out.withColumn("distance", r4("distance"))


@query("first_around", f"""WITH {POINTS} SELECT c_custkey, min(s_suppkey) AS s_suppkey FROM pr
 WHERE ax < 900 AND ay < 900 GROUP BY c_custkey""")
def first_around(spark, d):
    return spatial.first_around(customers_at(spark, d), suppliers_at(spark, d),
                                probe_key="c_custkey", point_key="s_suppkey", order="o", half=900.0)


SEG = {"x2": f"({SX}) + (s_suppkey % 13) * 40.0", "y2": f"({SY}) + (s_suppkey % 7) * 90.0"}


@query("nearest_segment", f"""WITH c AS (SELECT c_custkey, {CX} AS px, {CY} AS py FROM customer),
 s AS (SELECT s_suppkey, {SX} AS ax, {SY} AS ay, {SEG['x2']} AS bx, {SEG['y2']} AS by_ FROM supplier),
 l AS (SELECT *, (bx - ax) * (bx - ax) + (by_ - ay) * (by_ - ay) AS ll FROM c, s),
 t AS (SELECT *, CASE WHEN ll = 0 THEN 0.0 ELSE least(1.0, greatest(0.0,
 ((px - ax) * (bx - ax) + (py - ay) * (by_ - ay)) / ll)) END AS t FROM l),
 e AS (SELECT c_custkey, s_suppkey, sqrt((px - ax - t * (bx - ax)) * (px - ax - t * (bx - ax)) +
 (py - ay - t * (by_ - ay)) * (py - ay - t * (by_ - ay))) AS d FROM t)
 SELECT c_custkey, min_by(s_suppkey, (d, s_suppkey)) AS s_suppkey, {R('min(d)')} AS distance
 FROM e GROUP BY c_custkey""")
def nearest_segment(spark, d):
    pieces = table(spark, d, "supplier").select(
        "s_suppkey", F.expr(SX).alias("x1"), F.expr(SY).alias("y1"),
        *[F.expr(e).alias(c) for c, e in SEG.items()])
    out = spatial.nearest_segment(customers_at(spark, d), pieces, probe_key="c_custkey",
                                  segment_key="s_suppkey", order="s_suppkey")
    return out.select("c_custkey", "s_suppkey", r4("distance").alias("distance"))


@query("nearest_value", f"""WITH c AS (SELECT c_custkey, c_acctbal AS a FROM customer),
 s AS (SELECT s_suppkey, s_acctbal AS b FROM supplier), k AS (SELECT c_custkey, s_suppkey,
 abs(b - a) AS gap, row_number() OVER (PARTITION BY c_custkey ORDER BY abs(b - a), s_suppkey) AS n
 FROM c, s) SELECT c_custkey, s_suppkey, {R('gap')} AS gap FROM k WHERE n = 1""")
def nearest_value(spark, d):
    out = spatial.nearest_value(
        table(spark, d, "customer"), table(spark, d, "supplier"), probe_key="c_custkey",
        probe_value="c_acctbal", value_key="s_suppkey", value="s_acctbal", order="s_suppkey")
    return out.withColumn("gap", r4("gap"))


@query("serial_match", f"""WITH RECURSIVE c AS (SELECT c_custkey, {CX} AS x, {CY} AS y,
 row_number() OVER (ORDER BY c_custkey) AS i FROM customer),
s AS (SELECT s_suppkey, {SX} AS x, {SY} AS y FROM supplier),
pr AS MATERIALIZED (SELECT * FROM (SELECT i, c_custkey, s_suppkey, sqrt((c.x - s.x) * (c.x - s.x)
 + (c.y - s.y) * (c.y - s.y)) AS d FROM c, s) WHERE d < 300.0),
m(i, used, took) AS (SELECT 0::BIGINT, []::BIGINT[], NULL::BIGINT UNION ALL SELECT i + 1, CASE WHEN k IS
 NULL THEN used ELSE list_append(used, k) END, k FROM (SELECT m.i, used, (SELECT arg_min(s_suppkey,
 (d, s_suppkey)) FROM pr WHERE pr.i = m.i + 1 AND NOT list_contains(m.used, s_suppkey)) AS k FROM m
 WHERE m.i < (SELECT count(*) FROM c)))
SELECT c_custkey, s_suppkey, {R('d')} AS distance FROM m JOIN pr ON pr.i = m.i AND pr.s_suppkey = took""")
def serial_match(spark, d):
    people = customers_at(spark, d).withColumn("turn", F.col("c_custkey"))
    out = matching.serial_match(people, suppliers_at(spark, d), probe_key="c_custkey",
                                point_key="s_suppkey", probe_order="turn", point_order="o",
                                radius=300.0)
    return out.withColumn("distance", r4("distance"))


@query("leader_cluster", f"""WITH RECURSIVE c AS (SELECT c_custkey, {CX} AS x, {CY} AS y,
 row_number() OVER (ORDER BY c_custkey) AS i FROM customer),
near AS MATERIALIZED (SELECT a.i, b.i AS j FROM c a, c b WHERE b.i <= a.i AND
 sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) < 250.0),
m(i, leaders) AS (SELECT 0::BIGINT, []::BIGINT[] UNION ALL SELECT m.i + 1, CASE WHEN (SELECT count(*) FROM near
 WHERE near.i = m.i + 1 AND list_contains(m.leaders, near.j)) = 0 THEN list_append(leaders, m.i + 1)
 ELSE leaders END FROM m WHERE m.i < (SELECT count(*) FROM c)),
l AS (SELECT unnest(leaders) AS j FROM m WHERE m.i = (SELECT count(*) FROM c))
SELECT a.c_custkey, b.c_custkey AS leader FROM (SELECT near.i, min(near.j) AS j FROM near JOIN l USING (j)
 GROUP BY near.i) o JOIN c a ON a.i = o.i JOIN c b ON b.i = o.j""")
def leader_cluster(spark, d):
    return matching.leader_cluster(customers_at(spark, d).withColumn("o", F.col("c_custkey")),
                                   key="c_custkey", order="o", radius=250.0)


# ---- graph and order ---------------------------------------------------------------------

EDGES = """e AS (SELECT o_custkey * 2 AS a, o_orderkey * 2 + 1 AS b FROM orders),
n AS (SELECT a, b FROM e UNION SELECT b, a FROM e)"""
LABELS = f"""WITH RECURSIVE {EDGES}, r AS (SELECT a AS node, a AS label FROM n UNION
 SELECT n.b, r.label FROM r JOIN n ON n.a = r.node WHERE r.label < n.b OR r.label < n.a),
 comp AS (SELECT node, min(label) AS component FROM (SELECT * FROM r UNION ALL
 SELECT b, b FROM n) GROUP BY node)"""


def order_links(spark, d):
    return table(spark, d, "orders").select(
        (F.col("o_custkey") * 2).alias("src"), (F.col("o_orderkey") * 2 + 1).alias("dst"))


@query("components", LABELS + " SELECT node, component FROM comp")
def components(spark, d):
    return graph.components(order_links(spark, d))


@query("topology_summary", LABELS + """, z AS (SELECT component, count(*) AS nodes FROM comp
 GROUP BY component) SELECT count(*) AS components, max(nodes) AS largest,
 count(*) FILTER (nodes < (SELECT max(nodes) FROM z)) AS isolated FROM z""")
def topology_summary(spark, d):
    return graph.topology_summary(graph.components(order_links(spark, d)))


@query("mode_first_to_max", """WITH k AS (SELECT l_partkey, l_quantity, count(*) AS n,
 max((l_orderkey, l_linenumber, l_extendedprice, l_suppkey)) AS last FROM lineitem GROUP BY 1, 2)
 SELECT l_partkey, l_quantity AS mode FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey
 ORDER BY n DESC, last, l_quantity) AS r FROM k) WHERE r = 1""")
def mode_first_to_max(spark, d):
    return ordered.first_to_reach_mode(
        table(spark, d, "lineitem"), ["l_partkey"], "l_quantity",
        ["l_orderkey", "l_linenumber", "l_extendedprice", "l_suppkey"])


@query("encounter_ids", """WITH p AS (SELECT printf('%.1f,%.1f', c_acctbal / 100, c_nationkey / 2.0)
 AS key, c_custkey FROM customer), f AS (SELECT key, min(c_custkey) AS c_custkey FROM p GROUP BY key)
 SELECT key, c_custkey, 'J' || row_number() OVER (ORDER BY c_custkey) AS id FROM f""")
def encounter_ids(spark, d):
    keyed = table(spark, d, "customer").select("c_custkey", F.concat_ws(
        ",", numbers.to_fixed(F.col("c_acctbal") / 100, 1),
        numbers.to_fixed(F.col("c_nationkey") / 2.0, 1)).alias("key"))
    return ordered.encounter_ids(keyed, ["key"], ["c_custkey"], "J")


@query("largest_per_key", """SELECT l_partkey, l_orderkey, l_extendedprice FROM (SELECT *,
 row_number() OVER (PARTITION BY l_partkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber,
 l_suppkey, l_quantity) AS n FROM lineitem) WHERE n = 1""")
def largest_per_key(spark, d):
    order = F.struct((-F.col("l_extendedprice")).alias("p"), "l_orderkey", "l_linenumber",
                     "l_suppkey", "l_quantity")
    best = table(spark, d, "lineitem").groupBy("l_partkey").agg(F.min(order).alias("b"))
    return best.select("l_partkey", F.col("b.l_orderkey").alias("l_orderkey"),
                       (-F.col("b.p")).alias("l_extendedprice"))


PIPES_SQL = """SELECT l_orderkey AS row_no, CAST(l_suppkey AS VARCHAR) AS node1,
 CAST(l_partkey AS VARCHAR) AS node2, l_quantity AS diameter FROM lineitem"""


@query("incident_links", f"""WITH p AS ({PIPES_SQL}), e AS (SELECT node1 AS node, diameter FROM p
 UNION ALL SELECT node2, diameter FROM p) SELECT node, count(*) AS links,
 floor(avg(diameter) + 0.5) AS mean_diameter FROM e GROUP BY node""")
def incident_links(spark, d):
    pipes = table(spark, d, "lineitem").select(
        F.col("l_suppkey").cast("string").alias("node1"),
        F.col("l_partkey").cast("string").alias("node2"), F.col("l_quantity").alias("diameter"))
    ends = graph.incident_links(pipes, ["diameter"])
    return ends.groupBy("node").agg(
        F.count(F.lit(1)).alias("links"),
        numbers.round_half_up(F.avg("diameter")).alias("mean_diameter"))


# ---- text and numbers --------------------------------------------------------------------

LINES = """ln AS (SELECT doc_id, i - 1 AS line_no, replace(t[i], chr(13), '') AS text FROM
 (SELECT doc_id, string_split(text, chr(10)) AS t FROM documents), range(1, 20001) r(i)
 WHERE i <= len(t))"""
WS = r"\s\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"


@query("normalise_text", f"""SELECT doc_id, regexp_replace(regexp_replace(translate(regexp_replace(
 lower(regexp_replace(text, '^[{WS}]+|[{WS}]+$', '', 'g')), '{text.ARABIC_MARKS}', '', 'g'),
 '{text.ARABIC_VARIANTS}', '{text.ARABIC_FOLDED}'), '[_\\-{WS}]+', '', 'g'),
 '[.,;:!?''"()/\\\\@#$%^&*+=<>~`|{{}}\\[\\]]', '', 'g') AS norm FROM documents""")
def normalise_text(spark, d):
    return table(spark, d, "documents").select(
        "doc_id", text.normalize_text(F.col("text")).alias("norm"))


@query("normalise_header", """SELECT p_partkey, regexp_replace(regexp_replace(lower(p_name || '_' ||
 p_type || '_m'), '[_\\-\\s]+', '', 'g'),
 '(?i)(mm|m|cm|ft|inch|in|pi|metres?|meters?|pieds?|pouce|بوصة|قدم|متر|ملم)$', '') AS header
 FROM part""")
def normalise_header(spark, d):
    header = F.concat_ws("_", "p_name", "p_type", F.lit("m"))
    return table(spark, d, "part").select(
        "p_partkey", text.normalize_header(header).alias("header"))


DIRTY = """CASE WHEN o_orderkey % 11 = 0 THEN 'N/A' WHEN o_orderkey % 13 = 0 THEN '-'
 WHEN o_orderkey % 17 = 0 THEN '12d' WHEN o_orderkey % 19 = 0 THEN ' 1,2' || CAST(o_custkey AS VARCHAR) || ' '
 WHEN o_orderkey % 23 = 0 THEN '' WHEN o_orderkey % 29 = 0 THEN '-7.5' WHEN o_orderkey % 31 = 0 THEN '0x1F'
 WHEN o_orderkey % 37 = 0 THEN '.5e1' ELSE CAST(o_custkey AS VARCHAR) END"""
SPARK_DIRTY = DIRTY.replace("VARCHAR", "STRING")
NUM = r"'^[+-]?([0-9]+\.?[0-9]*([eE][+-]?[0-9]+)?|\.[0-9]+([eE][+-]?[0-9]+)?)$'"


def _sql_number(e: str) -> str:
    return (f"CASE WHEN regexp_matches({e}, {NUM}) THEN CAST({e} AS DOUBLE) "
            f"WHEN {e} = '0x1F' THEN 31.0 END")


def dirty_orders(spark, d):
    return table(spark, d, "orders").select("o_orderkey", F.expr(SPARK_DIRTY).alias("value"))


@query("read_numbers", f"""WITH v AS (SELECT o_orderkey, {DIRTY} AS value FROM orders)
 SELECT o_orderkey, CASE WHEN trim(value) = '' THEN 0.0 ELSE {_sql_number('trim(value)')} END AS number,
 {_sql_number("regexp_replace(value, '[, ]', '', 'g')")} AS cell_number,
 TRY_CAST(nullif(regexp_extract(value, '^\\s*([+-]?[0-9]+)', 1), '') AS BIGINT) AS int_prefix,
 trim(lower(value)) IN ('', 'n/a', '-') AS hidden_null FROM v""")
def read_numbers(spark, d):
    v = F.col("value")
    return dirty_orders(spark, d).select(
        "o_orderkey", numbers.number(v).alias("number"), text.cell_number(v).alias("cell_number"),
        numbers.int_prefix(v).alias("int_prefix"), text.is_disguised_null(v).alias("hidden_null"))


def _fixed_sql(e: str, n: int) -> str:
    """printf with exact ties away from zero (printf itself rounds them to even)."""
    k = f"abs({e}) * {2 ** (n + 1)}.0"
    return (f"printf('%.{n}f', CASE WHEN {k} = floor({k}) AND CAST({k} AS BIGINT) % 2 = 1 "
            f"THEN (floor(abs({e}) * {10 ** n}.0) + 1) / {10 ** n}.0 ELSE {e} END)")


@query("fixed_decimals", f"""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
 {_fixed_sql('(l_extendedprice * l_discount)', 1)} AS one,
 {_fixed_sql('(l_extendedprice * l_tax)', 3)} AS three,
 {_fixed_sql('(l_quantity * 1000 / 304.8)', 2)} AS feet FROM lineitem""")
def fixed_decimals(spark, d):
    c = F.col
    return table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        numbers.to_fixed(c("l_extendedprice") * c("l_discount"), 1).alias("one"),
        numbers.to_fixed(c("l_extendedprice") * c("l_tax"), 3).alias("three"),
        model_text.feet_text(c("l_quantity") * 1000).alias("feet"))


@query("name_similarity", f"""WITH p AS (SELECT p_partkey, lower(p_name) AS a, lower(p_type) AS b FROM part),
 q AS (SELECT DISTINCT a, b FROM p),
 s AS (SELECT a, b, greatest(length(a), length(b)) AS m, levenshtein(a, b) AS lev,
 coalesce((SELECT max(n) FROM range(1, 60) i(i), range(1, 60) k(n) WHERE i.i + k.n - 1 <= length(q.a)
 AND contains(q.b, substr(q.a, i.i, k.n))), 0) AS run FROM q)
 SELECT p_partkey, {R('''CASE WHEN a = b THEN 1.0 ELSE least(1.0, 1.0 - lev / CAST(m AS DOUBLE) + CASE
 WHEN contains(a, b) OR contains(b, a) THEN 0.2 WHEN run >= 3 THEN 0.1 * (run / CAST(m AS DOUBLE))
 ELSE 0.0 END) END''')} AS similarity FROM p JOIN s USING (a, b)""")
def name_similarity(spark, d):
    return table(spark, d, "part").select(
        "p_partkey", r4(similarity.similarity(F.col("p_name"), F.col("p_type"))).alias("similarity"))


@query("label_fields", r"""WITH v AS (SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN o_orderstatus
 ELSE CAST(o_custkey AS VARCHAR) || '.5  -' || CAST(o_orderkey AS VARCHAR) || ' ' || CASE
 WHEN o_orderkey % 2 = 0 THEN '"' || o_orderpriority || '" R1' ELSE o_orderpriority END END AS t FROM orders)
 SELECT o_orderkey, CAST(regexp_extract(t, '^(-?[\d.]+)\s+(-?[\d.]+)\s+(.+)$', 1) AS DOUBLE) AS x,
 CAST(regexp_extract(t, '^(-?[\d.]+)\s+(-?[\d.]+)\s+(.+)$', 2) AS DOUBLE) AS y,
 CASE WHEN o_orderkey % 2 = 0 THEN regexp_extract(t, '"([^"]*)"', 1)
 ELSE regexp_extract(t, '^(-?[\d.]+)\s+(-?[\d.]+)\s+(.+)$', 3) END AS text,
 CASE WHEN o_orderkey % 2 = 0 THEN 'R1' END AS anchor FROM v
 WHERE regexp_matches(t, '^(-?[\d.]+)\s+(-?[\d.]+)\s+(.+)$')""")
def label_fields(spark, d):
    t = F.when(F.col("o_orderkey") % 5 == 0, F.col("o_orderstatus")).otherwise(F.concat(
        F.col("o_custkey"), F.lit(".5  -"), F.col("o_orderkey"), F.lit(" "),
        F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit('"'), "o_orderpriority", F.lit('" R1')))
        .otherwise(F.col("o_orderpriority"))))
    out = table(spark, d, "orders").select("o_orderkey", text.parse_label(t).alias("l"))
    return out.where(F.col("l").isNotNull()).select("o_orderkey", "l.*")


@query("layer_names", """SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'DN ' || p_size || '0'
 ELSE 'MA-pipe ' || p_size END AS layer, CASE WHEN p_partkey % 2 = 0 THEN p_size || '0'
 ELSE CAST(p_size AS VARCHAR) END AS diam, CASE WHEN p_size >= 40 THEN 5 WHEN p_size >= 32 THEN 4
 WHEN p_size >= 20 THEN 3 ELSE 2 END AS size_class, 'VanneDN' || (p_size + 7) || '-63' AS block FROM part""")
def layer_names(spark, d):
    layer = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("DN "), "p_size", F.lit("0"))
                   ).otherwise(F.concat(F.lit("MA-pipe "), "p_size"))
    return table(spark, d, "part").select(
        "p_partkey", layer.alias("layer"), labels.layer_diameter(layer).alias("diam"),
        geometry.size_class(F.col("p_size") * 10 - F.when(F.col("p_size") == 31, 0).otherwise(0))
        .alias("size_class"),
        labels.block_for_diameter(F.concat(F.lit("VanneDN"), "p_size", F.lit("-63")),
                                  F.col("p_size") + 7).alias("block"))


HEAD = "CASE WHEN contains(text, 'the ') THEN upper(substr(text, 1, 8)) END"


@query("section_gather", f"""WITH {LINES}, h AS (SELECT *, {HEAD} AS h FROM ln),
 n AS (SELECT *, coalesce(sum(CASE WHEN h IS NOT NULL THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id
 ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS section_no FROM h)
 SELECT doc_id, line_no, CAST(section_no AS BIGINT) AS section_no, coalesce(max(h) OVER (PARTITION BY
 doc_id, section_no), '') AS header, row_number() OVER (PARTITION BY doc_id, section_no ORDER BY line_no)
 - 1 AS pos FROM n""")
def section_gather(spark, d):
    lines = lines_of(table(spark, d, "documents"), "doc_id", "text")
    out = polylines.gather_sections(lines, ["file"], F.expr(HEAD), "line_no")
    return out.select(F.col("file").alias("doc_id"), "line_no",
                      F.col("section_no").cast("bigint").alias("section_no"), "header",
                      F.col("pos").cast("bigint").alias("pos"))


# ---- column profiles ---------------------------------------------------------------------

WIDE = {"key": "CAST(o_orderkey AS VARCHAR)", "value": DIRTY, "status":
        "CASE WHEN o_orderstatus = 'F' THEN 'Open' ELSE 'Closed' END",
        "mark": "CASE WHEN o_orderkey % 50 = 1 THEN 'x' ELSE ';;' END",
        "kind": "CASE WHEN o_orderstatus = 'F' THEN 'pipes' ELSE 'JUNCTIONS' END"}


def order_cells(spark, d):
    wide = table(spark, d, "orders").select(F.col("o_orderkey").alias("row_no"), *[
        F.expr(e.replace("VARCHAR", "STRING")).alias(n) for n, e in WIDE.items()])
    return profiling.to_cells(wide)


CELLS = "ce AS (" + " UNION ALL ".join(
    f"SELECT o_orderkey AS row_no, '{n}' AS header, {e} AS value FROM orders"
    for n, e in WIDE.items()) + ")"
LOOSE = "regexp_replace(value, '[, ]', '', 'g')"


@query("column_profile", f"""WITH {CELLS}, v AS (SELECT header, value, {_sql_number(LOOSE)} AS n
 FROM ce WHERE value <> '') SELECT header, count(*) AS total, count(DISTINCT value) AS "unique",
 count(n) AS numeric_count, min(n) AS min, max(n) AS max, {R('avg(n)')} AS mean,
 {R('count(n) / CAST(count(*) AS DOUBLE)')} AS numeric_ratio,
 {R('count(DISTINCT value) / CAST(count(*) AS DOUBLE)')} AS uniqueness,
 bool_and(lower(value) IN ('open', 'closed')) AS categorical FROM v GROUP BY header""")
def column_profile(spark, d):
    out = profiling.column_profile(order_cells(spark, d), ["header"])
    return out.select("header", "total", "unique", "numeric_count", "min", "max",
                      r4("mean").alias("mean"), r4("numeric_ratio").alias("numeric_ratio"),
                      r4("uniqueness").alias("uniqueness"), "categorical")


@query("junk_columns", f"""WITH {CELLS} SELECT header, count(*) FILTER (trim(value) <> '') AS filled,
 count(*) FILTER (regexp_matches(trim(value), '^[;#/]+$')) AS marks FROM ce GROUP BY header
 HAVING count(*) FILTER (regexp_matches(trim(value), '^[;#/]+$')) >
 0.95 * count(*) FILTER (trim(value) <> '')""")
def junk_columns(spark, d):
    return profiling.junk_columns(order_cells(spark, d), ["header"])


NAMES = "CASE WHEN c_nationkey < 9 THEN 'PIPES' WHEN c_nationkey < 17 THEN 'nodes' ELSE c_mktsegment END"


@query("discriminator", f"""WITH k AS (SELECT c_custkey // 5 AS file, {NAMES} AS v FROM customer),
 g AS (SELECT file, count(DISTINCT upper(v)) AS n, count(*) AS f, count(DISTINCT upper(v))
 FILTER (upper(v) IN ('PIPES', 'NODES')) AS known FROM k GROUP BY file)
 SELECT file, 'kind' AS header, n AS "values", known / CAST(n AS DOUBLE) AS match_ratio FROM g
 WHERE n / CAST(f AS DOUBLE) > 0.2 AND n / CAST(f AS DOUBLE) < 0.6 AND n > 1 AND n < 30 AND known >= 2""")
def discriminator(spark, d):
    cells = table(spark, d, "customer").select(
        F.floor(F.col("c_custkey") / 5).alias("file"), F.lit(0).alias("col_no"), F.lit("kind").alias("header"),
        F.expr(NAMES).alias("value"))
    return profiling.discriminator_columns(cells, ["file"])


@query("section_names", """SELECT c_custkey, CASE WHEN c_nationkey < 9 THEN 'PIPES'
 WHEN c_nationkey < 17 THEN 'JUNCTIONS' END AS section FROM customer""")
def section_names(spark, d):
    return table(spark, d, "customer").select(
        "c_custkey", profiling.section_name(F.expr(NAMES)).alias("section"))


def _csv_like(spark, d) -> DataFrame:
    """Whole tables under the headers a CSV export would give them, as long cells."""
    shapes = {
        "part": ("p_partkey", {"id": "concat('J', p_partkey)", "Elevation_m": "p_size",
                               "demand": "p_retailprice / 100000"}),
        "lineitem": ("l_orderkey * 10 + l_linenumber", {
            "pipe_id": "concat('P', l_orderkey, '-', l_linenumber)", "from": "l_suppkey",
            "to": "l_partkey", "len": "l_extendedprice", "diam": "l_quantity * 10"}),
        "customer": ("c_custkey", {"code": "c_name", "foo": "c_mktsegment", "bar": "c_nationkey"}),
    }
    frames = []
    for name, (row, columns) in shapes.items():
        wide = table(spark, d, name).select(F.expr(row).alias("row_no"), *[
            F.expr(f"CAST({e} AS STRING)").alias(c) for c, e in columns.items()])
        frames.append(profiling.to_cells(wide).withColumn("file", F.lit(name)))
    return merge.concat_tables(frames)


@query("detect_tables")
def detect_tables(spark, d):
    found = detect.column_matches(_csv_like(spark, d), ["file"])
    out = detect.detect_tables(detect.table_scores(found, ["file"]), ["file"])
    return out.withColumn("confidence", r4("confidence"))


@query("suggest_fields")
def suggest_fields(spark, d):
    found = detect.column_matches(_csv_like(spark, d), ["file"])
    best = detect.detect_tables(detect.table_scores(found, ["file"]), ["file"])
    return detect.suggest_fields(found, best, ["file"]).withColumn("score", r4("score"))


@query("mapped_projection", """SELECT l_orderkey * 10 + l_linenumber AS row_no, 'P' || l_orderkey || '-'
 || l_linenumber AS id, CAST(l_suppkey AS VARCHAR) AS node1, CAST(l_partkey AS VARCHAR) AS node2,
 l_quantity * 10 AS diameter, 140.0::DOUBLE AS roughness, 'Open' AS status FROM (SELECT DISTINCT ON
 (l_orderkey, l_linenumber) * FROM lineitem WHERE (l_orderkey, l_linenumber) IN (SELECT (l_orderkey,
 l_linenumber) FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) = 1)) UNION ALL
 SELECT l_orderkey * 10 + l_linenumber, 'P' || l_orderkey || '-' || l_linenumber,
 CAST(max(l_suppkey) AS VARCHAR), CAST(max(l_partkey) AS VARCHAR), max(l_quantity) * 10, 140.0, 'Open'
 FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1""")
def mapped_projection(spark, d):
    rows = table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(
        *[F.max(c).alias(c) for c in ("l_suppkey", "l_partkey", "l_quantity")])
    lines = rows.select(
        F.lit("f").alias("file"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("row_no"),
        F.array(*[F.lit(h) for h in ("pipe_id", "from", "to", "diam")]).alias("headers"),
        F.array(F.expr("concat('P', l_orderkey, '-', l_linenumber)"),
                F.col("l_suppkey").cast("string"), F.col("l_partkey").cast("string"),
                (F.col("l_quantity") * 10).cast("string")).alias("cells"))
    chosen = spark.createDataFrame(
        [("f", "pipe_id", "id"), ("f", "from", "node1"), ("f", "to", "node2"),
         ("f", "diam", "diameter")], "file string, header string, field string")
    out = mapping.map_table(lines, chosen, "PIPES")["pipes"]
    return out.select("row_no", "id", "node1", "node2", "diameter", "roughness", "status")


# ---- validation --------------------------------------------------------------------------

FIELDS = {"elevation": DIRTY, "diameter": "CAST(o_totalprice / 50 - 300 AS VARCHAR)",
          "status": "CASE o_orderstatus WHEN 'F' THEN 'open' WHEN 'P' THEN '?' ELSE 'odd' END",
          "demand": "CASE WHEN o_orderkey % 9 = 0 THEN 'none' ELSE CAST(o_custkey - 1500 AS VARCHAR) END",
          "parameters": "CASE WHEN o_orderkey % 4 = 0 THEN 'head 3' ELSE 'HEAD' END",
          "id": "CAST(o_custkey AS VARCHAR)",
          "node1": "CAST(o_custkey + 5 AS VARCHAR)"}
ID_FIELD = "CASE WHEN o_orderkey % 3 = 0 THEN repeat('k', 32) ELSE CAST(o_orderkey AS VARCHAR) END"
FIELDS["id"] = ID_FIELD


def field_cells(spark, d):
    wide = table(spark, d, "orders").select(F.col("o_orderkey").alias("row_no"), *[
        F.expr(e.replace("VARCHAR", "STRING")).alias(n) for n, e in FIELDS.items()])
    return profiling.to_cells(wide).withColumnRenamed("header", "field")


def _findings(spark, d):
    ids = table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("id"))
    return validate.field_findings(field_cells(spark, d), ids=ids)


FOUND = f"""o AS (SELECT o_orderkey AS row_no, o_custkey, o_totalprice, o_orderstatus,
 {', '.join(f'{e} AS f_{n}' for n, e in FIELDS.items())} FROM orders),
 el AS (SELECT row_no, f_elevation AS value, trim(lower(f_elevation)) IN ('', 'n/a', '-') AS hid,
 {_sql_number("regexp_replace(f_elevation, '[, ]', '', 'g')")} AS n FROM o),
 fi AS (
 SELECT 'elevation' AS field, 'nullable' AS "check", 'blocking' AS severity, row_no, value FROM el WHERE hid
 UNION ALL SELECT 'elevation', 'type_mismatch', 'blocking', row_no, value FROM el WHERE NOT hid AND n IS NULL
 UNION ALL SELECT 'diameter', 'out_of_range', 'warning', row_no, f_diameter FROM o
  WHERE CAST(f_diameter AS DOUBLE) < 1 OR CAST(f_diameter AS DOUBLE) > 5000
 UNION ALL SELECT 'diameter', 'negative', 'warning', row_no, f_diameter FROM o WHERE CAST(f_diameter AS DOUBLE) < 0
 UNION ALL SELECT 'status', 'default', 'info', row_no, f_status FROM o WHERE f_status = '?'
 UNION ALL SELECT 'status', 'invalid_categorical', 'warning', row_no, f_status FROM o WHERE f_status = 'odd'
 UNION ALL SELECT 'demand', 'default', 'info', row_no, f_demand FROM o WHERE f_demand = 'none'
 UNION ALL SELECT 'demand', 'out_of_range', 'warning', row_no, f_demand FROM o
  WHERE f_demand <> 'none' AND TRY_CAST(f_demand AS DOUBLE) < -1000
 UNION ALL SELECT 'demand', 'out_of_range', 'warning', row_no, f_demand FROM o
  WHERE f_demand <> 'none' AND TRY_CAST(f_demand AS DOUBLE) > 100000
 UNION ALL SELECT 'parameters', 'compound_format', 'warning', row_no, f_parameters FROM o WHERE f_parameters = 'HEAD'
 UNION ALL SELECT 'id', 'too_long', 'warning', row_no, f_id FROM o WHERE length(f_id) > 31
 UNION ALL SELECT 'id', 'duplicate_id', 'blocking', row_no, f_id FROM (SELECT *, row_number() OVER
  (PARTITION BY f_id ORDER BY row_no) AS n FROM o) WHERE n > 1
 UNION ALL SELECT 'node1', 'missing_ref', 'blocking', row_no, f_node1 FROM o WHERE f_node1 NOT IN
  (SELECT CAST(c_custkey AS VARCHAR) FROM customer))"""


@query("field_findings", f"WITH {FOUND} SELECT * FROM fi")
def field_findings(spark, d):
    return _findings(spark, d)


@query("column_severity", f"""WITH {FOUND}, k AS (SELECT DISTINCT field, "check", severity FROM fi),
 a AS (SELECT unnest({list(FIELDS)}) AS field)
 SELECT a.field, count(*) FILTER (severity = 'blocking') AS errors,
 count(*) FILTER (severity = 'warning') AS warnings, count(*) FILTER (severity = 'info') AS infos,
 CASE WHEN count(*) FILTER (severity = 'blocking') > 0 THEN 'blocking'
 WHEN count(*) FILTER (severity = 'warning') > 0 THEN 'warning' ELSE 'ok' END AS severity
 FROM a LEFT JOIN k ON k.field = a.field GROUP BY a.field""")
def column_severity(spark, d):
    return validate.column_severity(field_cells(spark, d), _findings(spark, d))


@query("finding_examples", f"""WITH {FOUND}, v AS (SELECT field, "check", value, min(row_no) AS f FROM fi
 GROUP BY ALL), n AS (SELECT *, row_number() OVER (PARTITION BY field, "check" ORDER BY f) AS n,
 count(*) OVER (PARTITION BY field, "check") AS c FROM v)
 SELECT field, "check", array_to_string(list(value ORDER BY n), '|') AS examples,
 greatest(0, any_value(c) - 5) AS more FROM n WHERE n <= 5 GROUP BY field, "check" """)
def finding_examples(spark, d):
    out = validate.example_values(_findings(spark, d))
    return out.withColumn("examples", F.array_join("examples", "|"))


@query("duplicate_ids", """WITH u AS (SELECT 'a' AS section, 0 AS p, c_custkey AS row_no, CAST(c_nationkey
 AS VARCHAR) AS id FROM customer UNION ALL SELECT 'b', 1, s_suppkey, CAST(s_nationkey AS VARCHAR)
 FROM supplier) SELECT section, id, row_no FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY
 p, row_no) AS n FROM u) WHERE n > 1""")
def duplicate_ids(spark, d):
    a = table(spark, d, "customer").select(F.col("c_custkey").alias("row_no"),
                                           F.col("c_nationkey").alias("id"))
    b = table(spark, d, "supplier").select(F.col("s_suppkey").alias("row_no"),
                                           F.col("s_nationkey").alias("id"))
    return validate.duplicate_ids({"a": a, "b": b}).select("section", "id", "row_no")


LINKS = {"id": "o_orderkey", "node1": "o_custkey", "node2": "CASE WHEN o_orderkey % 6 = 0 THEN '' "
         "ELSE CAST(o_orderkey % 2000 AS VARCHAR) END"}


def order_network(spark, d):
    links = table(spark, d, "orders").select(
        F.col("o_orderkey").alias("row_no"), F.col("o_orderkey").cast("string").alias("id"),
        F.col("o_custkey").cast("string").alias("node1"),
        F.expr(LINKS["node2"].replace("VARCHAR", "STRING")).alias("node2"))
    nodes = table(spark, d, "customer").select(
        F.col("c_custkey").alias("row_no"), F.col("c_custkey").cast("string").alias("id"))
    return links, nodes


NET = f"""l AS (SELECT CAST(o_orderkey AS VARCHAR) AS id, CAST(o_custkey AS VARCHAR) AS node1,
 {LINKS['node2']} AS node2 FROM orders), nd AS (SELECT CAST(c_custkey AS VARCHAR) AS id FROM customer)"""


@query("missing_refs", f"""WITH {NET}, e AS (SELECT id, 'node1' AS "end", node1 AS value FROM l UNION ALL
 SELECT id, 'node2', node2 FROM l) SELECT * FROM e WHERE value <> '' AND value NOT IN
 (SELECT id FROM nd)""")
def missing_refs(spark, d):
    links, nodes = order_network(spark, d)
    return validate.missing_refs(links, nodes, always=False)


@query("split_links", f"""WITH {NET} SELECT id, node1 IN (SELECT id FROM nd) AND (node2 = '' OR node2 IN
 (SELECT id FROM nd)) AS valid FROM l""")
def split_links(spark, d):
    links, nodes = order_network(spark, d)
    return validate.split_links(links, nodes).select("id", "valid")


@query("reference_findings", f"""WITH {NET}, e AS (SELECT id, 'Node1' AS field, node1 AS value FROM l
 UNION ALL SELECT id, 'Node2', node2 FROM l) SELECT 'missing_ref' AS type, 'PIPES' AS section, id, field,
 value, 'Pipe ' || id || ' ' || field || ' "' || value || '" not found in nodes' AS message FROM e
 WHERE value NOT IN (SELECT id FROM nd)""")
def reference_findings(spark, d):
    links, nodes = order_network(spark, d)
    return validate.reference_findings({"junctions": nodes, "pipes": links})


@query("project_gate", f"""WITH {NET}, m AS (SELECT (SELECT count(*) FROM l WHERE node1 NOT IN (SELECT id
 FROM nd)) + (SELECT count(*) FROM l WHERE node2 NOT IN (SELECT id FROM nd)) AS n)
 SELECT true AS has_source, true AS has_junctions, true AS has_links, n AS blocking,
 (SELECT count(*) FROM supplier WHERE CAST(s_suppkey AS VARCHAR) IN (SELECT id FROM nd)) + 2 AS warnings,
 n = 0 AS can_generate FROM m""")
def project_gate(spark, d):
    links, nodes = order_network(spark, d)
    sources = table(spark, d, "supplier").select(
        F.col("s_suppkey").alias("row_no"), F.col("s_suppkey").cast("string").alias("id"))
    return validate.project_gate({"junctions": nodes, "reservoirs": sources, "pipes": links})


# ---- merge and edits ---------------------------------------------------------------------

INCOMING = {"id": "CASE WHEN c_custkey % 97 = 0 THEN NULL ELSE 'C' || CAST(c_custkey + (c_custkey % 4) * 500 AS VARCHAR) END",
            "elevation": "CASE WHEN c_custkey % 8 = 0 THEN c_acctbal + 1 ELSE c_acctbal END"}


def _stored(spark, d):
    return table(spark, d, "customer").select(
        F.concat(F.lit("C"), "c_custkey").alias("id"), F.col("c_acctbal").alias("elevation"),
        F.col("c_mktsegment").alias("note"), F.lit("a").alias("_source"),
        F.col("c_custkey").alias("row_no"))


def _incoming(spark, d):
    return table(spark, d, "customer").select(
        *[F.expr(e.replace("VARCHAR", "STRING")).alias(n) for n, e in INCOMING.items()],
        F.lit("b").alias("_source"), F.col("c_custkey").alias("row_no"))


MERGED = f"""s AS (SELECT 'C' || c_custkey AS id, c_acctbal AS elevation, c_mktsegment AS note, c_custkey
 AS row_no FROM customer), i AS (SELECT {', '.join(f'{e} AS {n}' for n, e in INCOMING.items())},
 c_custkey AS row_no FROM customer),
 b AS (SELECT id, min_by(elevation, (p, row_no)) AS be, min((p, row_no)) AS bk, min_by(p, (p, row_no)) AS bp
 FROM (SELECT id, elevation, row_no, 0 AS p FROM s UNION ALL SELECT id, elevation, row_no, 1 FROM i
 WHERE id IS NOT NULL) GROUP BY id),
 j AS (SELECT i.id, i.elevation, i.row_no, CASE WHEN i.id IS NULL OR b.bk = (1, i.row_no) THEN 'new'
 WHEN b.bp = 1 AND b.be = i.elevation THEN 'identical'
 WHEN b.be <> i.elevation THEN 'conflict' ELSE 'compatible' END AS status
 FROM i LEFT JOIN b ON b.id = i.id)"""


@query("merge_status", f"WITH {MERGED} SELECT row_no, id, elevation, status FROM j")
def merge_status(spark, d):
    out = merge.merge_elements(_stored(spark, d), _incoming(spark, d)).incoming
    return out.select("row_no", "id", "elevation", "status")


@query("merged_elements", f"""WITH {MERGED} SELECT id, elevation, note, 'a' AS _source, row_no FROM s UNION ALL
 SELECT id, elevation, NULL, 'b', row_no FROM j WHERE status IN ('new', 'compatible')""")
def merged_elements(spark, d):
    return merge.merge_elements(_stored(spark, d), _incoming(spark, d)).elements.select(
        "id", "elevation", "note", "_source", "row_no")


DECIDE = "CASE WHEN row_no % 3 = 0 THEN 'replace' WHEN row_no % 3 = 1 THEN 'rename' ELSE 'keep_existing' END"


@query("resolve_conflicts", f"""WITH {MERGED}, m AS (SELECT id, elevation, row_no, 'a' AS src FROM s UNION ALL
 SELECT id, elevation, row_no, 'b' FROM j WHERE status IN ('new', 'compatible')),
 dc AS (SELECT id, min_by({DECIDE}, row_no) AS how FROM j WHERE status = 'conflict' GROUP BY id),
 w AS (SELECT j.id, max_by(elevation, row_no) AS e FROM j JOIN dc USING (id) WHERE status = 'conflict' AND
 how = 'replace' GROUP BY j.id),
 f AS (SELECT id, min(row_no) AS f FROM m GROUP BY id)
 SELECT m.id, CASE WHEN w.id IS NOT NULL AND m.row_no = f.f THEN w.e ELSE m.elevation END AS elevation,
 CASE WHEN w.id IS NOT NULL AND m.row_no = f.f THEN 'b' ELSE src END AS _source FROM m
 LEFT JOIN w ON w.id = m.id LEFT JOIN f ON f.id = m.id UNION ALL
 SELECT j.id || '_new', j.elevation, 'b' FROM j JOIN dc USING (id) WHERE status = 'conflict' AND how = 'rename'""")
def resolve_conflicts(spark, d):
    res = merge.merge_elements(_stored(spark, d), _incoming(spark, d))
    decisions = res.conflicts.groupBy("id").agg(
        F.min_by(F.expr(DECIDE), "row_no").alias("resolution"))
    return merge.resolve_conflicts(res.elements, res.conflicts, decisions).select(
        "id", "elevation", "_source")


@query("remove_source", f"""WITH {MERGED} SELECT id, row_no FROM j WHERE status IN ('new', 'compatible')""")
def remove_source(spark, d):
    all_ = merge.merge_elements(_stored(spark, d), _incoming(spark, d)).elements
    return merge.remove_source(all_, "a").select("id", "row_no")


@query("project_stats", f"""WITH {MERGED} SELECT 'junctions' AS kind, (SELECT count(*) FROM s) + count(*) AS
 count, CAST(2 AS BIGINT) AS sources FROM j WHERE status IN ('new', 'compatible')""")
def project_stats(spark, d):
    all_ = merge.merge_elements(_stored(spark, d), _incoming(spark, d)).elements
    return merge.project_stats(all_.withColumn("kind", F.lit("junctions")))


@query("field_differences", f"""WITH {MERGED} SELECT s.id, 'elevation' AS field FROM s JOIN (SELECT id,
 elevation FROM i) i ON i.id = s.id WHERE s.elevation <> i.elevation""")
def field_differences(spark, d):
    new = _incoming(spark, d).where(F.col("id").isNotNull())
    return merge.field_differences(_stored(spark, d), new, ["id"], ["elevation"]).select("id", "field")


@query("change_diameter", """SELECT p_partkey, CASE WHEN p_size = 11 THEN 125 ELSE p_size END AS diam,
 CASE WHEN p_size = 11 THEN 'DN125' ELSE p_brand END AS layer FROM part""")
def change_diameter(spark, d):
    pipes = table(spark, d, "part").select("p_partkey", F.col("p_size").alias("diam"),
                                           F.col("p_brand").alias("layer"))
    return merge.change_diameter(pipes, 11, 125)


@query("edit_rows", """SELECT p_partkey, coalesce(s_nationkey, p_size) AS diam, CASE WHEN s_nationkey IS NULL
 THEN p_brand ELSE 'DN ' || s_nationkey END AS layer FROM part LEFT JOIN supplier ON s_suppkey = p_partkey""")
def edit_rows(spark, d):
    pipes = table(spark, d, "part").select("p_partkey", F.col("p_size").alias("diam"),
                                           F.col("p_brand").alias("layer"))
    edits = table(spark, d, "supplier").select(F.col("s_suppkey").alias("p_partkey"),
                                               F.col("s_nationkey").alias("diam"))
    return merge.edit_rows(pipes, edits, "p_partkey", layer="layer", spaced=True)


@query("delete_nodes", f"""WITH {NET}, g AS (SELECT CAST(s_suppkey * 3 AS VARCHAR) AS id FROM supplier)
 SELECT id, node1, node2 FROM l WHERE node1 NOT IN (SELECT id FROM g) AND node2 NOT IN (SELECT id FROM g)""")
def delete_nodes(spark, d):
    links, nodes = order_network(spark, d)
    doomed = table(spark, d, "supplier").select((F.col("s_suppkey") * 3).cast("string").alias("id"))
    return merge.delete_nodes(nodes, links, doomed)[1].select("id", "node1", "node2")


# ---- files and coordinates ---------------------------------------------------------------


@query("model_round_trip", f"""SELECT 'pipe' AS kind, CAST(o_orderkey AS VARCHAR) AS id, CAST(o_custkey AS VARCHAR) AS node1,
 CAST(o_orderkey % 2000 AS VARCHAR) AS node2, CAST(printf('%.4f', o_totalprice / 7) AS DOUBLE) AS length,
 CAST(printf('%.1f', o_custkey % 90 + 10.0) AS DOUBLE) AS diameter, 'Open' AS status FROM orders UNION ALL
 SELECT 'junction', CAST(c_custkey AS VARCHAR), NULL, NULL, CAST(printf('%.3f', c_acctbal) AS DOUBLE), NULL, NULL
 FROM customer""")
def model_round_trip(spark, d):
    """Element tables -> model text -> sections -> tables."""
    o = table(spark, d, "orders")
    pipes = o.select(
        F.col("o_orderkey").alias("row_no"), F.col("o_orderkey").cast("string").alias("id"),
        F.col("o_custkey").cast("string").alias("node1"),
        (F.col("o_orderkey") % 2000).cast("string").alias("node2"),
        (F.col("o_totalprice") / 7).alias("length"), (F.col("o_custkey") % 90 + 10.0).alias("diameter"))
    nodes = table(spark, d, "customer").select(
        F.col("c_custkey").alias("row_no"), F.col("c_custkey").cast("string").alias("id"),
        F.col("c_acctbal").alias("elevation"))
    text_ = model_text.table_model(spark, {"junctions": nodes, "pipes": pipes})
    lines = materialize(model_text.numbered_lines(text_))
    back = inp.model_tables(inp.sections(lines))
    pipes = back["pipes"].select(
        F.lit("pipe").alias("kind"), "id", "node1", "node2", "length", "diameter", "status")
    return pipes.unionByName(back["junctions"].select(
        F.lit("junction").alias("kind"), "id", F.col("elevation").alias("length")),
        allowMissingColumns=True)


@query("drawing_round_trip", f"""WITH {TRACK} SELECT user_id * 2 AS layer_no, v_no,
 CAST(printf('%.6f', x) AS DOUBLE) AS x, CAST(printf('%.6f', y) AS DOUBLE) AS y FROM tr""")
def drawing_round_trip(spark, d):
    """Tracks -> drawing text -> written files -> tags -> entities -> vertices."""
    line = materialize(tracks(spark, d, numbered=True)).select(
        F.col("user_id").alias("ent_no"), "v_no", "x", "y")
    heads = line.select("ent_no").distinct().select(
        "ent_no", F.concat(F.lit("É"), (F.col("ent_no") * 2).cast("string")).alias("layer"),
        F.lit(False).alias("closed"))
    path = f"{ensure_checkpoint_dir(spark)}/drawing-{uuid.uuid4().hex}"
    model_text.write_drawing(model_text.drawing_text(spark, polylines_=[(heads, line)]), path)
    # the part files are one text: lines of single bytes, one part after the other
    parts = read_lines(spark, path).selectExpr("file AS part", "line_no AS row", "text AS line")
    lines = materialize(model_text.numbered_lines(parts, counted=True))
    tags = materialize(dxf.tags_from_lines(lines))
    kept = materialize(dxf.model_space(dxf.mark_entities(tags), ["LWPOLYLINE"]))
    named = dxf.entities(kept).select("file", "ent_no", F.expr("CASE WHEN layer LIKE 'É%' THEN substring(layer, 2, 20) END")
                                      .cast("bigint").alias("layer_no"))
    return dxf.vertices(kept).join(named, ["file", "ent_no"]).select("layer_no", "v_no", "x", "y")


@query("sectioned_rows", """SELECT o_orderkey AS row_no, CAST(o_custkey AS VARCHAR) AS id,
 CAST(o_orderkey % 7 AS VARCHAR) AS elevation FROM orders WHERE o_orderstatus = 'F'""")
def sectioned_rows(spark, d):
    section = F.when(F.col("o_orderstatus") == "F", "junctions").otherwise("PIPES")
    line = F.concat_ws(";", section, "o_custkey", F.col("o_orderkey") % 7)
    head = spark.createDataFrame([(-1, "Section;col1;col2")], "line_no long, text string")
    lines = head.unionByName(table(spark, d, "orders").select(
        F.col("o_orderkey").alias("line_no"), line.alias("text"))).withColumn("file", F.lit("f"))
    routed = csvfiles.section_rows(csvfiles.rows_of(lines))
    out = csvfiles.section_tables(routed)["junctions"]
    return out.select((F.col("row_no") - 1).alias("row_no"), "id", "elevation")


LON, LAT = "2.0 + c_nationkey * 0.1 + c_acctbal * 1e-5", "35.0 + (c_custkey % 400) * 0.01"


@query("coordinate_round_trip", f"""SELECT c_custkey, floor(({LON}) * 1e8 + 0.5) / 1e8 AS lon,
 floor(({LAT}) * 1e8 + 0.5) / 1e8 AS lat FROM customer""")
def coordinate_round_trip(spark, d):
    spots = table(spark, d, "customer").select(
        "c_custkey", F.expr(f"CAST({LON} AS DOUBLE)").alias("lon"),
        F.expr(f"CAST({LAT} AS DOUBLE)").alias("lat"))
    there = spots.withColumn("p", crs.from_lonlat(F.col("lon"), F.col("lat")))
    back = there.withColumn("b", crs.to_lonlat(F.col("p.x"), F.col("p.y")))
    return back.select("c_custkey", numbers.round_half_up(F.col("b.lon"), 8).alias("lon"),
                       numbers.round_half_up(F.col("b.lat"), 8).alias("lat"))


def _features(spark, d):
    spots = customers_at(spark, d).select(
        F.lit("f").alias("file"), "c_custkey", (F.col("x") + 500000).alias("x"),
        (F.col("y") * 10 + 4000000).alias("y"))
    return point_features(spots, "regard", "EPSG:32631", {"id": F.col("c_custkey")})


@query("features")
def features(spark, d):
    return feature_json(_features(spark, d))


@query("feature_extent")
def feature_extent(spark, d):
    return extent(_features(spark, d)).select(*[r4(c).alias(c) for c in
                                                ("west", "south", "east", "north")])


@query("model_update")
def model_update(spark, d):
    """Diameters of a model network brought back onto tracks of points."""
    nodes = customers_at(spark, d).select(F.col("c_custkey").cast("string").alias("id"),
                                          F.col("c_custkey").alias("row_no"), "x", "y")
    pipes = table(spark, d, "orders").select(
        F.col("o_custkey").cast("string").alias("node1"),
        (F.col("o_custkey") + 1).cast("string").alias("node2"), F.col("o_orderkey").alias("row_no"),
        (F.col("o_custkey") % 40 * 10.0).alias("diameter"))
    corners = customers_at(spark, d).select(
        F.floor(F.col("c_custkey") / 5).alias("ent_no"), F.col("c_custkey").alias("v_no"),
        F.col("x") + 0.25, F.col("y"))
    corners = corners.toDF("ent_no", "v_no", "x", "y")
    return update.pipe_diameters(corners, nodes, pipes, 1.0)


@query("geometry_network")
def geometry_network(spark, d):
    line = materialize(tracks(spark, d, numbered=True)).select(
        F.lit("supply").alias("family"), F.col("user_id").alias("ent_no"), "v_no", "x", "y")
    heads = line.select("family", "ent_no").distinct().withColumn("diam", F.lit("110"))
    nodes = customers_at(spark, d).select(
        F.lit("supply").alias("family"), F.col("c_custkey").alias("ent_no"), "x",
        (F.col("y") / 20).alias("y"), F.concat(F.lit("VanneDN"), F.col("c_nationkey") + 40)
        .alias("block_name"))
    net = model_text.geometry_network(heads, line, nodes)
    return net["pipes"].select("id", "node1", "node2", r4("length").alias("length"))
