"""Column profiles over cells in long form (file, row_no, col_no, header, value)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waterloom.functions.numbers import SPACES, exact_sum, number, trim
from waterloom.functions.text import CATEGORY_LIST, CATEGORY_WORDS
from waterloom.schema import KNOWN_SECTIONS, SECTION_NAMES

# Headers that name a section column and are never junk.
SECTION_HEADERS = ["Section", "Type", "Categorie", "Category"]


def to_cells(table: DataFrame, row_no: str = "row_no", by: list[str] | None = None) -> DataFrame:
    """Wide all-text table to long cells; one pass, no join."""
    by = by or []
    headers = [c for c in table.columns if c != row_no and c not in by]
    cells = F.array(
        *[
            F.struct(F.lit(i).alias("col_no"), F.lit(h).alias("header"),
                     F.col(f"`{h}`").cast("string").alias("value"))
            for i, h in enumerate(headers)
        ]
    )
    return table.select(*by, row_no, F.inline(cells))


def loose_number(value: Column) -> Column:
    """Number after commas and white space are removed."""
    return number(F.regexp_replace(value, rf"[,{SPACES}]", ""))


def column_profile(
    cells: DataFrame, keys: list[str], value: str = "value", approximate: bool = False,
    counts: dict[str, Column] | None = None,
) -> DataFrame:
    """Count, distinct, numeric share, range, mean, uniqueness and category flag per column.

    Every distinct value of a column is one row with its number of cells, counted before the
    shuffle; values are parsed and tested once each, and one aggregation of them gives all
    figures.  ``counts`` adds numbers of cells that pass a test over ``_v``.  With ``approximate``
    the distinct count is estimated, and cells are not gathered by value.
    """
    v = F.col(value)
    staged = cells.select(*keys, F.when(v.isNotNull() & (v != ""), v).alias("_v"))
    if approximate:
        staged = staged.withColumn("_c", F.lit(1).cast("bigint"))
    else:
        staged = staged.groupBy(*keys, "_v").agg(F.count(F.lit(1)).alias("_c"))
    staged = staged.withColumn("_n", loose_number(F.col("_v")))

    def cells_that(test: Column) -> Column:
        return F.coalesce(F.sum(F.when(test, F.col("_c"))), F.lit(0).cast("bigint"))

    category = F.col("_v").rlike(CATEGORY_WORDS)
    words = [F.max(F.when(F.lower("_v") == w, F.lit(w))) for w in CATEGORY_LIST]
    numeric = F.col("_n").isNotNull()
    out = staged.groupBy(*keys).agg(
        cells_that(F.col("_v").isNotNull()).alias("total"),
        (F.approx_count_distinct("_v") if approximate else F.count("_v")).alias("unique"),
        cells_that(numeric).alias("numeric_count"),
        F.min("_n").alias("min"),
        F.max("_n").alias("max"),
        F.try_divide(exact_sum(F.col("_n") * F.col("_c")), cells_that(numeric)).alias("mean"),
        F.coalesce(F.bool_and(category), F.lit(True)).alias("categorical"),
        # a value per word of the fixed list, so that the aggregation needs no objects
        F.array_compact(F.array(*words)).alias("_words"),
        *[cells_that(test).alias(n) for n, test in (counts or {}).items()],
    )
    share = lambda n: F.coalesce(F.try_divide(F.col(n), F.col("total")), F.lit(0.0))
    return out.withColumns(
        {
            "numeric_ratio": share("numeric_count"),
            "uniqueness": share("unique"),
            "category_values": F.when(F.col("categorical"), F.array_sort("_words")).otherwise(
                F.array().cast("array<string>")
            ),
        }
    ).drop("_words")


def is_numeric_column(profile: DataFrame) -> Column:
    return (F.col("total") > 0) & (F.col("numeric_ratio") > 0.7)


def junk_columns(cells: DataFrame, keys: list[str], header: str = "header") -> DataFrame:
    """Columns whose filled cells are, to more than 95 %, comment marks only."""
    t = trim(F.col("value"))
    counts = cells.where(~F.col(header).isin(SECTION_HEADERS)).groupBy(*keys).agg(
        F.count_if(F.coalesce(t, F.lit("")) != "").alias("filled"),
        F.count_if(t.rlike(r"^[;#/]+$")).alias("marks"),
    )
    return counts.where((F.col("filled") > 0) & (F.col("marks") / F.col("filled") > 0.95)).select(
        *keys, "filled", "marks"
    )


def drop_junk_columns(cells: DataFrame, keys: list[str]) -> DataFrame:
    return cells.join(junk_columns(cells, keys), keys, "left_anti")


def known_section(value: Column) -> Column:
    """True for a section name or one of its synonyms."""
    words = [w.lower() for names in SECTION_NAMES.values() for w in names]
    return F.upper(value).isin(KNOWN_SECTIONS) | F.lower(value).isin(words)


def section_name(value: Column) -> Column:
    """Canonical section for a name or synonym, null when unknown."""
    out = F.when(F.upper(value).isin(KNOWN_SECTIONS), F.upper(value))
    for section, words in SECTION_NAMES.items():
        out = out.when(F.lower(value).isin([w.lower() for w in words]), F.lit(section))
    return out


def discriminator_columns(
    cells: DataFrame, by: list[str], header: str = "header", position: str = "col_no"
) -> DataFrame:
    """First column per file whose few values include at least two section names."""
    upper = F.upper(trim(F.coalesce(F.col("value"), F.lit(""))))
    distinct = (
        cells.withColumn("_v", upper).where(F.col("_v") != "")
        .groupBy(*by, header, position, "_v").agg(F.count(F.lit(1)).alias("_n"))
    )
    columns = distinct.groupBy(*by, header, position).agg(
        F.count(F.lit(1)).alias("values"),
        F.sum("_n").alias("filled"),
        F.count_if(known_section(F.col("_v"))).alias("known"),
    )
    ratio = F.col("values") / F.col("filled")
    fits = columns.where(
        (ratio > 0.2) & (ratio < 0.6) & (F.col("values") > 1) & (F.col("values") < 30)
        & (F.col("known") >= 2)
    )
    picked = fits.groupBy(*by).agg(
        F.min_by(F.struct(header, "values", "known"), position).alias("_p")
    )
    return picked.select(
        *by, F.col(f"_p.{header}").alias(header), F.col("_p.values").alias("values"),
        (F.col("_p.known") / F.col("_p.values")).alias("match_ratio"),
    )
