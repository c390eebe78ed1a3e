"""Field, reference and network checks; findings are rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waterloom import schema
from waterloom.functions.text import is_disguised_null, validation_number, validation_text
from waterloom.session import materialize

SEVERITIES = ["ok", "info", "warning", "blocking"]


def field_findings(
    cells: DataFrame, by: list[str] | None = None, *, ids: DataFrame | None = None,
    field: str = "field", row_no: str = "row_no", value: str = "value",
    rules: DataFrame | None = None,
) -> DataFrame:
    """One row per failed check: ``by``, field, check, severity, row_no, value.

    ``ids`` (column ``id``) are the identifiers references may point to; without it references
    are not checked.  Cells are read once and meet one written row per column; only filled cells
    of reference columns are joined with the identifiers, and only repeated values of identifier
    columns with their first use.
    """
    by = by or []
    keys = [*by, field]
    rules = schema.field_rules(cells.sparkSession) if rules is None else rules
    if field != "field":
        rules = rules.withColumnRenamed("field", field)
    v = F.col(value)
    staged = materialize(cells.select(
        *keys, row_no, value, validation_text(v).alias("_text"), validation_number(v).alias("_num")
    ))
    text, num, kind = F.col("_text"), F.col("_num"), F.col("kind")
    numeric = kind.isin("numeric", "integer")
    bad_number = numeric & text.isNotNull() & num.isNull()
    broken = (kind == "compound") & text.isNotNull() & ~F.coalesce(
        F.call_function("rlike", text, F.col("pattern")), F.lit(True)
    )
    ruled = staged.join(rules, field)
    counts = ruled.groupBy(*keys).agg(
        F.count_if(bad_number).alias("_bad"), F.count_if(broken).alias("_broken"),
        F.count("_text").alias("_filled"),
    )
    # one row per column with its rule, written: its size is known and it can be split against
    facts = materialize(counts.join(rules, field))
    rows = staged.join(facts, keys)
    clean = numeric & num.isNotNull() & (F.col("_bad") == 0)
    checks = [
        ("nullable", "blocking", text.isNull() & ~F.col("nullable")),
        ("default", "info",
         text.isNull() & F.col("nullable") & F.col("default_value").isNotNull()),
        ("type_mismatch", "blocking", bad_number),
        ("non_integer", "warning", clean & (kind == "integer") & (num != F.floor(num))),
        ("out_of_range", "warning", clean & ((num < F.col("low")) | (num > F.col("high")))),
        ("negative", "warning", clean & ~F.col("negative") & (num < 0)),
        ("invalid_categorical", "warning",
         (kind == "categorical") & text.isNotNull()
         & ~F.array_contains(F.coalesce("allowed", F.array().cast("array<string>")),
                             F.upper(text))),
        ("too_long", "warning", (kind == "text") & (F.length(text) > F.col("max_length"))),
        ("compound_format", "warning", broken & (F.col("_broken") < F.col("_filled"))),
    ]
    found = F.array_compact(F.array(*[
        F.when(F.coalesce(test, F.lit(False)),
               F.struct(F.lit(name).alias("check"), F.lit(level).alias("severity")))
        for name, level, test in checks
    ]))
    columns = [*keys, "check", "severity", row_no, value]
    out = [rows.select(*keys, row_no, value, F.inline(found)).select(*columns)]

    def failed(df: DataFrame, name: str) -> DataFrame:
        return df.select(*keys, F.lit(name).alias("check"), F.lit("blocking").alias("severity"),
                         row_no, value)

    if ids is not None:
        known = ids.select(F.col("id").cast("string").alias("_text"))
        out.append(failed(rows.where((kind == "id_reference") & text.isNotNull())
                          .join(known, "_text", "left_anti"), "missing_ref"))
    unique = rows.where(F.col("unique_ids") & text.isNotNull()).select(
        *keys, "_text", row_no, value)
    repeated = materialize(unique.groupBy(*keys, "_text").agg(
        F.min(row_no).alias("_first"), F.count(F.lit(1)).alias("_uses"),
    ).where("_uses > 1").drop("_uses"))
    out.append(failed(unique.join(repeated, [*keys, "_text"])
                      .where(F.col("_first") < F.col(row_no)), "duplicate_id"))
    return reduce(DataFrame.unionByName, out)


def _rank(severity: Column) -> Column:
    return F.array_position(F.array(*[F.lit(s) for s in SEVERITIES]), severity)


def column_severity(
    cells: DataFrame, findings: DataFrame, by: list[str] | None = None, field: str = "field"
) -> DataFrame:
    """Severity and number of error and warning kinds per column, ``ok`` included."""
    keys = [*(by or []), field]
    kinds = findings.groupBy(*keys, "check", "severity").agg(F.count(F.lit(1)).alias("rows"))
    worst = kinds.groupBy(*keys).agg(
        F.count_if(F.col("severity") == "blocking").alias("errors"),
        F.count_if(F.col("severity") == "warning").alias("warnings"),
        F.count_if(F.col("severity") == "info").alias("infos"),
    )
    out = cells.select(*keys).distinct().join(worst, keys, "left").na.fill(0)
    return out.withColumn("severity", severity_of(F.col("errors"), F.col("warnings")))


def severity_of(errors: Column, warnings: Column) -> Column:
    return F.when(errors > 0, "blocking").when(warnings > 0, "warning").otherwise("ok")


def overall_severity(columns: DataFrame, by: list[str] | None = None) -> DataFrame:
    totals = columns.groupBy(*(by or [])).agg(
        F.sum("errors").alias("errors"), F.sum("warnings").alias("warnings")
    )
    return totals.withColumn("severity", severity_of(F.col("errors"), F.col("warnings")))


def example_values(
    findings: DataFrame, by: list[str] | None = None, *, field: str = "field",
    row_no: str = "row_no", value: str = "value", top: int = 5,
) -> DataFrame:
    """First ``top`` distinct failing values per column and check, and how many more there are."""
    keys = [*(by or []), field, "check"]
    firsts = findings.groupBy(*keys, value).agg(F.min(row_no).alias("_first"))
    totals = firsts.groupBy(*keys).agg(F.count(F.lit(1)).alias("_distinct"))
    ranked = firsts.withColumn(
        "_n", F.row_number().over(Window.partitionBy(*keys).orderBy("_first"))
    ).where(F.col("_n") <= top)
    lists = ranked.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("_n", value))).alias("_l"))
    return lists.join(totals, keys).select(
        *keys, F.transform("_l", lambda s: s[value]).alias("examples"),
        F.greatest(F.lit(0), F.col("_distinct") - top).cast("bigint").alias("more"),
    )


def _stack(tables: dict[str, DataFrame], columns: list[str], row_no: str) -> DataFrame:
    frames = []
    for place, (name, df) in enumerate(tables.items()):
        wanted = [
            (F.col(c) if c in df.columns else F.lit(None)).cast("string").alias(c) for c in columns
        ]
        frames.append(df.select(
            F.lit(name).alias("section"), F.lit(place).alias("_place"),
            F.col(row_no).cast("bigint").alias("row_no"), *wanted,
        ))
    return reduce(DataFrame.unionByName, frames)


def duplicate_ids(tables: dict[str, DataFrame], row_no: str = "row_no") -> DataFrame:
    """Rows whose id was seen earlier, tables in the given order counting as one."""
    rows = _stack(tables, ["id"], row_no)
    first = rows.groupBy("id").agg(F.min(F.struct("_place", "row_no")).alias("_first"))
    return rows.join(first, "id").where(
        F.struct("_place", "row_no") > F.col("_first")
    ).select("section", "id", "row_no")


def missing_refs(
    links: DataFrame, nodes: DataFrame, *, always: Column | bool = True,
    ends: tuple[str, ...] = ("node1", "node2"), node_id: str = "id", carried=("id",),
) -> DataFrame:
    """Link ends that name no node: carried columns, ``end`` and ``value``.

    Ends of links outside ``always`` are checked only when filled.
    """
    always = F.lit(always) if isinstance(always, bool) else always
    long = links.withColumn("_always", always).select(
        *carried, "_always",
        F.inline(F.array(*[
            F.struct(F.lit(e).alias("end"), F.col(e).alias("value")) for e in ends
        ])),
    )
    long = long.where(F.col("_always") | (F.coalesce("value", F.lit("")) != ""))
    known = nodes.select(F.col(node_id).alias("value"))
    return long.join(known, "value", "left_anti").select(*carried, "end", "value")


def split_links(
    links: DataFrame, nodes: DataFrame, ends=("node1", "node2"), node_id: str = "id"
) -> DataFrame:
    """Links with ``valid``: every filled end names a node."""
    # written, not an aggregate: adaptive execution can then split the links of a hub
    known = materialize(nodes.select(F.col(node_id)).where(F.col(node_id).isNotNull()).distinct())
    out = links.withColumn("valid", F.lit(True))
    for end in ends:
        mark = known.select(F.col(node_id).alias(end), F.lit(True).alias("_hit"))
        filled = F.coalesce(F.col(end), F.lit("")) != ""
        out = out.join(mark, end, "left").withColumn(
            "valid", F.col("valid") & (~filled | F.col("_hit").isNotNull())
        ).drop("_hit")
    return out.select(*links.columns, "valid")


NODE_TABLES = ["junctions", "reservoirs", "tanks"]
LINK_TABLES = ["pipes", "valves", "pumps"]


def _present(tables: dict[str, DataFrame], names: list[str]) -> dict[str, DataFrame]:
    return {n: tables[n] for n in names if tables.get(n) is not None}


def reference_findings(tables: dict[str, DataFrame], row_no: str = "row_no") -> DataFrame:
    """Duplicate ids and missing references over a set of element tables."""
    nodes = _present(tables, NODE_TABLES)
    links = _present(tables, LINK_TABLES)
    spark = next(iter(tables.values())).sparkSession
    columns = ["type", "section", "id", "field", "value"]
    frames = []
    groups = ([nodes] if nodes else []) + [{n: df} for n, df in links.items()]
    for group in groups:
        frames.append(duplicate_ids(group, row_no).select(
            F.lit("duplicate_id").alias("type"), F.upper("section").alias("section"), "id",
            F.lit(None).cast("string").alias("field"), F.lit(None).cast("string").alias("value"),
        ))
    if links:
        known = (
            _stack(nodes, ["id"], row_no).select("id") if nodes
            else spark.createDataFrame([], "id string")
        )
        ends = _stack(links, ["id", "node1", "node2"], row_no)
        frames.append(missing_refs(
            ends, known, always=F.col("section") == "pipes", carried=("section", "id")
        ).select(
            F.lit("missing_ref").alias("type"), F.upper("section").alias("section"), "id",
            F.initcap("end").alias("field"), "value",
        ))
    if not frames:
        return spark.createDataFrame([], ", ".join(f"{c} string" for c in columns))
    found = reduce(DataFrame.unionByName, frames)
    singular = F.initcap(F.regexp_replace(F.lower("section"), "s$", ""))
    message = F.when(
        F.col("type") == "duplicate_id",
        F.concat(F.lit("Duplicate "), F.lower(singular), F.lit(" ID: "), F.col("id")),
    ).otherwise(F.concat(singular, F.lit(" "), F.col("id"), F.lit(" "), F.col("field"),
                         F.lit(' "'), F.coalesce("value", F.lit("")),
                         F.lit('" not found in nodes')))
    return found.withColumn("message", message)


def element_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """Rows and distinct ids per element table."""
    frames = [
        df.agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("id").alias("ids"))
        .select(F.lit(name).alias("kind"), "rows", "ids")
        for name, df in tables.items() if "id" in df.columns
    ]
    return reduce(DataFrame.unionByName, frames)


def project_gate(tables: dict[str, DataFrame], row_no: str = "row_no") -> DataFrame:
    """One row: what is present, how many problems block, whether a model can be written."""
    counts = element_counts(tables).agg(*[
        F.coalesce(F.sum(F.when(F.col("kind").isin(kinds), F.col("rows"))), F.lit(0)).alias(name)
        for name, kinds in {
            "sources": ["reservoirs", "tanks"], "junctions": ["junctions"],
            "links": ["pipes", "pumps", "valves"], "patterns": ["patterns"], "curves": ["curves"],
        }.items()
    ])
    problems = reference_findings(
        {k: v for k, v in tables.items() if k in NODE_TABLES + LINK_TABLES}, row_no
    ).agg(
        F.count_if(F.col("type") == "missing_ref").alias("missing_refs"),
        F.count_if(F.col("type") == "duplicate_id").alias("duplicates"),
    )
    has = {n: F.col(n) > 0 for n in ("sources", "junctions", "links", "patterns", "curves")}
    blocking = (
        F.col("missing_refs") + (~has["sources"]).cast("int") + (~has["junctions"]).cast("int")
        + (~has["links"]).cast("int")
    )
    warnings = (
        F.col("duplicates") + (~has["patterns"]).cast("int") + (~has["curves"]).cast("int")
    )
    # both sides are single-row aggregates
    joined = counts.withColumn("_k", F.lit(1)).join(problems.withColumn("_k", F.lit(1)), "_k")
    return joined.select(
        has["sources"].alias("has_source"), has["junctions"].alias("has_junctions"),
        has["links"].alias("has_links"), blocking.cast("bigint").alias("blocking"),
        warnings.cast("bigint").alias("warnings"), (blocking == 0).alias("can_generate"),
    )


__all__ = [
    "column_severity", "duplicate_ids", "element_counts", "example_values", "field_findings",
    "is_disguised_null", "missing_refs", "overall_severity", "project_gate",
    "reference_findings", "split_links",
]
