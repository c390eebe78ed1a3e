"""More operators on the test tables with their SQL: table views, checks, CSV kinds, ledgers."""

from __future__ import annotations

from pyspark.sql import functions as F

from waterloom import schema
from waterloom.operators import detect, merge, validate
from waterloom.plans import views
from waterloom.queries import FOUND, NET, field_cells, order_network, query, r4, table
from waterloom.queries import _findings
from waterloom.sources import csvfiles

DIAM = ("CASE WHEN p_partkey % 7 = 0 THEN '' WHEN p_partkey % 7 = 1 THEN NULL "
        "ELSE CAST(p_size * 10 AS VARCHAR) END")


@query("distinct_diameters", f"""WITH d AS (SELECT {DIAM} AS diameter FROM part), c AS (SELECT diameter,
 count(*) AS pipes FROM d WHERE diameter <> '' GROUP BY 1) SELECT diameter, pipes, row_number() OVER
 (ORDER BY CAST(diameter AS DOUBLE), diameter) AS place FROM c""")
def distinct_diameters(spark, d):
    return views.distinct_diameters(table(spark, d, "part").select(
        F.expr(DIAM.replace("VARCHAR", "STRING")).alias("diam")))


@query("family_counts", """SELECT 'pipes' AS family, count(*) AS rows, count(*) FILTER (p_size > 25) AS marked
 FROM part UNION ALL SELECT 'manholes', count(*), count(*) FILTER (c_custkey % 3 = 0) FROM customer""")
def family_counts(spark, d):
    return views.family_counts(
        {"pipes": table(spark, d, "part"), "manholes": table(spark, d, "customer")},
        {"pipes": F.col("p_size") > 25, "manholes": F.col("c_custkey") % 3 == 0})


@query("ranked_fields", """WITH s AS (SELECT o_custkey AS header, o_orderpriority AS field,
 max(o_totalprice) AS score, min(o_orderkey) AS place FROM orders GROUP BY 1, 2)
 SELECT header, field, row_number() OVER (PARTITION BY header ORDER BY score DESC, place) AS rank FROM s""")
def ranked_fields(spark, d):
    s = table(spark, d, "orders").groupBy(
        F.col("o_custkey").alias("header"), F.col("o_orderpriority").alias("field")).agg(
        F.max("o_totalprice").alias("score"), F.min("o_orderkey").alias("place"))
    return views.ranked(s, ["header"]).select("header", "field", "rank")


@query("acceptance", """SELECT c_custkey, CASE WHEN c_acctbal / 10000 >= 0.85 THEN 'preselected'
 WHEN c_acctbal / 10000 >= 0.75 THEN 'auto' ELSE 'ask' END AS policy FROM customer""")
def acceptance(spark, d):
    return table(spark, d, "customer").select(
        "c_custkey", views.acceptance(F.col("c_acctbal") / 10000).alias("policy"))


@query("accepted_columns", """SELECT c_custkey, floor(c_acctbal / 10000 * 1e4 + 0.5) / 1e4 AS score
 FROM customer WHERE c_acctbal / 10000 >= 0.4""")
def accepted_columns(spark, d):
    s = table(spark, d, "customer").select("c_custkey", (F.col("c_acctbal") / 10000).alias("score"))
    return views.accepted_columns(s).select("c_custkey", r4("score").alias("score"))


@query("anchored_vertices", """SELECT user_id, count(*) AS vertices, count(*) FILTER (event_type = 'click')
 AS anchored FROM events GROUP BY user_id""")
def anchored_vertices(spark, d):
    e = table(spark, d, "events")
    corners = e.select("user_id", F.col("event_id").alias("v_no"))
    hit = e.where("event_type = 'click'").select(
        "user_id", F.struct(F.col("user_id").alias("ent_no"), F.col("event_id").alias("v_no"))
        .alias("corner"))
    return views.anchored_vertices(corners, hit.unionByName(hit), ["user_id"])


@query("reference_summary", f"""WITH {NET}, e AS (SELECT node1 AS value FROM l UNION ALL SELECT node2 FROM l)
 SELECT (SELECT count(*) FROM nd) AS nodes, (SELECT count(*) FROM l) AS links, (SELECT count(*) FROM e
 WHERE value NOT IN (SELECT id FROM nd)) AS missing_refs, 0 AS duplicates, NULL AS warning""")
def reference_summary(spark, d):
    links, nodes = order_network(spark, d)
    return views.reference_summary({"junctions": nodes, "pipes": links})


@query("overall_severity", f"""WITH {FOUND}, k AS (SELECT DISTINCT field, "check", severity FROM fi)
 SELECT count(*) FILTER (severity = 'blocking') AS errors, count(*) FILTER (severity = 'warning') AS warnings,
 CASE WHEN count(*) FILTER (severity = 'blocking') > 0 THEN 'blocking'
 WHEN count(*) FILTER (severity = 'warning') > 0 THEN 'warning' ELSE 'ok' END AS severity FROM k""")
def overall_severity(spark, d):
    return validate.overall_severity(
        validate.column_severity(field_cells(spark, d), _findings(spark, d)))


@query("whole_numbers", """SELECT o_orderkey AS row_no, 'count' AS field, 'non_integer' AS "check",
 'warning' AS severity, CAST(o_orderkey / 4 AS VARCHAR) AS value FROM orders WHERE o_orderkey % 4 <> 0""")
def whole_numbers(spark, d):
    """The integer rule, which none of the default fields has."""
    cells = table(spark, d, "orders").select(
        F.col("o_orderkey").alias("row_no"), F.lit("count").alias("field"),
        (F.col("o_orderkey") / 4).cast("string").alias("value"))
    rules = schema.field_rules(spark).where("field = 'x'").withColumns(
        {"field": F.lit("count"), "kind": F.lit("integer"), "low": F.lit(None).cast("double"),
         "high": F.lit(None).cast("double")})
    return validate.field_findings(cells, rules=rules)


@query("merge_key_values", """WITH e AS (SELECT *, event_id % 3 = 0 AS late FROM events)
 SELECT user_id, event_type, max_by(value, (late, ts, event_id)) AS value FROM e GROUP BY 1, 2""")
def merge_key_values(spark, d):
    """Both sides filled: an incoming value wins over a stored one that is later in time."""
    e = table(spark, d, "events").withColumn("row_no", F.struct("ts", "event_id"))
    late = F.col("event_id") % 3 == 0
    return merge.merge_key_values(e.where(~late), e.where(late), ["user_id", "event_type"]).select(
        "user_id", "event_type", "value")


@query("source_ledger", """SELECT o_orderpriority AS _source, o_orderstatus AS kind, count(*) AS n FROM orders
 GROUP BY 1, 2""")
def source_ledger(spark, d):
    return merge.source_ledger(table(spark, d, "orders").select(
        F.col("o_orderpriority").alias("_source"), F.col("o_orderstatus").alias("kind")))


@query("table_preview", """SELECT o_orderstatus, o_orderkey FROM (SELECT *, row_number() OVER
 (PARTITION BY o_orderstatus ORDER BY o_orderkey) AS n FROM orders) WHERE n <= 8""")
def table_preview(spark, d):
    """The first eight rows per file are the feature."""
    return merge.preview(table(spark, d, "orders").select("o_orderstatus", "o_orderkey"),
                         ["o_orderstatus"], "o_orderkey")


# One file per customer; the header of every third names no section column, and the second
# section of a file comes in its last rows.
SECTION = "CASE WHEN o_orderstatus = 'P' THEN 'PIPES' WHEN o_orderstatus = 'F' THEN 'junctions' ELSE 'x' END"


def _section_rows(spark, d):
    o = table(spark, d, "orders")
    return o.select(
        F.col("o_custkey").alias("file"), F.col("o_orderkey").alias("row_no"),
        F.array(F.expr(SECTION), F.col("o_orderpriority"), F.lit(";")).alias("cells"),
        F.array(F.when(F.col("o_custkey") % 3 == 0, "name").otherwise("Section"), F.lit("col1"),
                F.lit("col2")).alias("headers"))


@query("is_sectioned", f"""SELECT o_custkey AS file, o_custkey % 3 <> 0 AND count(DISTINCT {SECTION})
 FILTER (o_orderstatus IN ('P', 'F') AND o_orderkey > 0) >= 2 AS sectioned FROM orders GROUP BY 1""")
def is_sectioned(spark, d):
    return csvfiles.is_sectioned(_section_rows(spark, d))


@query("section_summary", f"""SELECT o_custkey AS file, upper({SECTION}) AS section, count(*) AS rows,
 0 AS groups FROM orders WHERE o_orderstatus IN ('P', 'F') AND o_orderkey > 0 GROUP BY 1, 2""")
def section_summary(spark, d):
    return csvfiles.section_summary(csvfiles.section_rows(_section_rows(spark, d)))


@query("short_files", """SELECT o_custkey AS file, 'File too short or empty' AS error FROM orders
 GROUP BY 1 HAVING count(*) < 2""")
def short_files(spark, d):
    return csvfiles.short_files(_section_rows(spark, d))


@query("typed_features", """SELECT l_orderkey * 10 + l_linenumber AS row_no, 'aep' AS family,
 CAST(l_suppkey AS DOUBLE) AS x1, CAST(l_partkey AS DOUBLE) AS y2, 'DN' || l_linenumber AS layer
 FROM lineitem WHERE l_returnflag = 'A' AND l_linestatus <> 'O' AND l_suppkey % 5 <> 0""")
def typed_features(spark, d):
    unique = table(spark, d, "lineitem").withColumn("file", F.monotonically_increasing_id())
    values = {"type": F.when(F.col("l_returnflag") == "A", "AEP").otherwise("note"),
              "x1": F.when(F.col("l_suppkey") % 5 == 0, "n/a").otherwise(
                  F.col("l_suppkey").cast("string")),
              "y1": F.lit("2"), "x2": F.lit("3"), "y2": F.col("l_partkey").cast("string"),
              "diam": F.col("l_linenumber").cast("string")}
    cells = unique.where("l_linestatus <> 'O'").select(
        "file", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("row_no"),
        F.inline(F.array(*[F.struct(F.lit(i).alias("col_no"), F.lit(n).alias("header"),
                                    v.alias("value")) for i, (n, v) in enumerate(values.items())])))
    return csvfiles.typed_features(cells)["pipes"].select("row_no", "family", "x1", "y2", "layer")


@query("added_links", """SELECT o_orderkey AS id, c.c_custkey AS from_node, 1000000 + n.n_nationkey AS to_node,
 315 AS diam, c.c_acctbal AS x1, CAST(n.n_regionkey AS DOUBLE) AS x2 FROM orders o JOIN customer c
 ON c.c_custkey = o.o_custkey JOIN nation n ON n.n_nationkey = o.o_orderkey % 25
 WHERE c.c_custkey > 25""")
def added_links(spark, d):
    nodes = table(spark, d, "customer").where("c_custkey > 25").select(
        F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("x"), F.lit(0.0).alias("y"))
    nodes = nodes.unionByName(table(spark, d, "nation").select(
        (F.col("n_nationkey") + 1000000).cast("bigint").alias("id"),
        F.col("n_regionkey").cast("double").alias("x"), F.lit(1.0).alias("y")))
    pairs = table(spark, d, "orders").select(
        F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("from_node"),
        (F.col("o_orderkey") % 25 + 1000000).alias("to_node"))
    none = pairs.limit(0)
    added = merge.add_links(none, pairs, nodes)
    ends = merge.edited_link_ends(added, nodes)
    return ends.select(F.col("id"), "from_node", "to_node", "diam", "x1", "x2")


# Numbers behind a letter, all of a few lengths, and names that are longer than the short index.
NEW_ID = "CASE WHEN s_suppkey % 3 = 0 THEN concat('j-', (s_suppkey * 104729) % 1000000) WHEN s_suppkey % 3 = 1 THEN concat('J', (s_suppkey * 104729) % 1000000) ELSE concat('conduite ', s_suppkey * 7919, ' nord') END"
OLD_ID = "CASE WHEN c_custkey % 2 = 0 THEN concat('J', (c_custkey * 7919) % 1000000) ELSE concat('Conduit ', c_custkey * 7919, ' nord') END"


@query("similar_ids", f"""WITH p AS (SELECT id, new_id, lower(new_id) AS a, lower(id) AS b FROM
 (SELECT {OLD_ID} AS id FROM customer), (SELECT {NEW_ID} AS new_id FROM supplier)),
r AS (SELECT *, greatest(length(a), length(b)) AS n, levenshtein(a, b) AS d FROM p),
m AS (SELECT *, CASE WHEN contains(a, b) OR contains(b, a) THEN 0 ELSE coalesce(list_max(list_filter(
 range(1, length(a) + 1), lambda k: len(list_filter(range(1, length(a) - k + 2),
 lambda i: contains(b, substring(a, i, k)))) > 0)), 0) END AS run FROM r WHERE d < 0.5 * n),
s AS (SELECT id, new_id, CASE WHEN a = b THEN 1.0 ELSE least(1.0, 1.0 - d / n::DOUBLE + CASE WHEN
 contains(a, b) OR contains(b, a) THEN 0.2 WHEN run >= 3 THEN 0.1 * (run / n::DOUBLE) ELSE 0.0 END) END
 AS similarity FROM m)
SELECT id, new_id, floor(similarity * 1e4 + 0.5) / 1e4 AS similarity FROM s
 WHERE similarity > 0.7 AND similarity < 1.0""")
def similar_ids(spark, d):
    stored = table(spark, d, "customer").select(F.expr(OLD_ID).alias("id"))
    asked = table(spark, d, "supplier").select(F.expr(NEW_ID).alias("new_id"))
    return detect.similar_ids(stored, asked).select("id", "new_id", r4("similarity").alias("similarity"))
