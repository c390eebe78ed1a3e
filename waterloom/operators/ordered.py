"""Running values over ordered rows, safe for groups of any size.

A window with one huge group (one drawing, one track, or no group at all) runs in a single
task.  ``Sequence`` measures the largest group first.  Groups of a checked size use one plain
window.  Beyond that the rows are range-partitioned by key and order, the slice number is
pinned by a checkpoint, the window runs per slice, and a small table of per-slice summaries
carries the state from slice to slice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waterloom.functions.numbers import SUM_PARTS, from_sum_parts, sum_parts
from waterloom.session import materialize

HOT_ROWS = 1_000_000
_SLICE = "_slice"


def largest_group(df: DataFrame, keys: list[str]) -> int:
    """Rows in the largest group (partial counts are combined before the shuffle)."""
    if not keys:
        return df.count()
    row = df.groupBy(*keys).count().agg(F.max("count")).first()
    return row[0] or 0


class Sequence:
    """Rows of ``df`` in the order of ``order`` inside each group of ``keys``.

    ``order`` must be unique inside a group.  Every method returns a new ``Sequence`` with the
    columns added; ``.df`` is the frame.  Values that do not build on each other belong in one
    ``compute`` call.
    """

    def __init__(
        self, df, keys, order, hot_rows: int = HOT_ROWS, slice_by: str | None = None, _sliced=None
    ):
        self.keys = [keys] if isinstance(keys, str) else list(keys)
        self.order = [order] if isinstance(order, (str, Column)) else list(order)
        self.hot_rows = hot_rows
        if slice_by is not None:
            # the rows already come in ordered, bounded slices (the splits of a text file)
            df, _sliced = df.withColumn(_SLICE, F.col(slice_by)), True
        if _sliced is None:
            biggest = largest_group(df, self.keys)
            _sliced = biggest > hot_rows
            if _sliced:
                total = biggest if not self.keys else df.count()
                slices = max(2, -(-total // hot_rows) * 2)
                df = materialize(
                    df.repartitionByRange(
                        slices, *[F.col(k) for k in self.keys], *self._order_cols()
                    ).withColumn(_SLICE, F.spark_partition_id())
                )
        self.sliced = _sliced
        self._df = df
        self._derived = False

    def _order_cols(self) -> list[Column]:
        return [F.col(o) if isinstance(o, str) else o for o in self.order]

    @property
    def df(self) -> DataFrame:
        return self._df.drop(_SLICE) if self.sliced else self._df

    def compute(
        self, *, sums: dict[str, Column] | None = None, last: dict[str, Column] | None = None,
        last_before: dict[str, Column] | None = None, upcoming: dict[str, Column] | None = None,
        previous: dict[str, Column] | None = None, following: dict[str, Column] | None = None,
    ) -> "Sequence":
        """Add any number of running values in one pass.

        ``sums``: running sum including the row (null counts as zero); of doubles it is exact, so
        it does not depend on how the rows are sliced.  ``last`` and
        ``last_before``: latest non-null value up to the row, or strictly before it.
        ``upcoming``: earliest non-null value from the row on.  ``previous`` and ``following``:
        value of the neighbouring row.
        """
        groups = self.keys + ([_SLICE] if self.sliced else [])
        w = Window.partitionBy(*groups).orderBy(*self._order_cols())
        so_far = w.rowsBetween(Window.unboundedPreceding, 0)
        earlier = w.rowsBetween(Window.unboundedPreceding, -1)
        # looking ahead is looking back in reverse order: a frame that ends at the last row
        # would be evaluated again for every row
        onward = Window.partitionBy(*groups).orderBy(
            *[c.desc() for c in self._order_cols()]
        ).rowsBetween(Window.unboundedPreceding, 0)
        place = F.struct(*self._order_cols())
        # per output: local value, per-slice summary, how it moves along the slices, how the
        # carried value completes the local one
        plan: list[tuple[str, Column, Column, str]] = []
        kinds = dict(self._df.select(*[c.alias(n) for n, c in (sums or {}).items()]).dtypes) \
            if sums else {}
        whole: dict[str, Column] = {}  # sums made of parts, once these are complete
        for n, c in (sums or {}).items():
            if kinds[n] in ("double", "float"):
                names = [f"_{n}_{i}" for i in range(SUM_PARTS)]
                whole[n] = from_sum_parts(*map(F.col, names))
                terms = dict(zip(names, sum_parts(c)))
            else:
                terms = {n: F.coalesce(c, F.lit(0))}
            plan += [(k, F.sum(t).over(so_far), F.sum(t), "sum") for k, t in terms.items()]

        def finished(df: DataFrame) -> DataFrame:
            return df.withColumns(whole).drop(*[f"_{n}_{i}" for n in whole for i in range(SUM_PARTS)]) \
                if whole else df

        for n, c in (last or {}).items():
            latest = F.max_by(c, F.when(c.isNotNull(), place))
            plan.append((n, F.last_value(c, F.lit(True)).over(so_far), latest, "last"))
        for n, c in (last_before or {}).items():
            latest = F.max_by(c, F.when(c.isNotNull(), place))
            plan.append((n, F.last_value(c, F.lit(True)).over(earlier), latest, "last"))
        for n, c in (upcoming or {}).items():
            first = F.min_by(c, F.when(c.isNotNull(), place))
            plan.append((n, F.last_value(c, F.lit(True)).over(onward), first, "upcoming"))
        for n, c in (previous or {}).items():
            plan.append((n, F.lag(c).over(w), F.max_by(c, place), "previous"))
        for n, c in (following or {}).items():
            plan.append((n, F.lead(c).over(w), F.min_by(c, place), "following"))
        if not self.sliced:
            return self._next(finished(self._df.withColumns({n: local for n, local, _, _ in plan})))

        # the rows are read twice, for the summary and for the result, so a chain of passes
        # starts from a written table
        df = materialize(self._df) if self._derived else self._df
        up = Window.partitionBy(*self.keys).orderBy(_SLICE)
        down = Window.partitionBy(*self.keys).orderBy(F.col(_SLICE).desc())
        before, after = (o.rowsBetween(Window.unboundedPreceding, -1) for o in (up, down))
        moves = {
            "sum": lambda c: F.sum(c).over(before),
            "last": lambda c: F.last_value(c, F.lit(True)).over(before),
            "upcoming": lambda c: F.last_value(c, F.lit(True)).over(after),
            "previous": lambda c: F.lag(c).over(up),
            "following": lambda c: F.lag(c).over(down),
        }
        summary = df.groupBy(*groups).agg(*[s.alias(f"_c_{n}") for n, _, s, _ in plan])
        carried = summary.select(
            *groups, *[moves[kind](F.col(f"_c_{n}")).alias(f"_c_{n}") for n, _, _, kind in plan]
        )
        out = df.withColumns({
            **{n: local for n, local, _, _ in plan},
            "_at_start": F.lag(F.lit(True)).over(w).isNull(),
            "_at_end": F.lead(F.lit(True)).over(w).isNull(),
        }).join(carried, groups, "left")
        fill = {}
        for n, _, _, kind in plan:
            mine, theirs = F.col(n), F.col(f"_c_{n}")
            if kind == "sum":
                fill[n] = mine + F.coalesce(theirs, F.lit(0))
            elif kind in ("last", "upcoming"):
                fill[n] = F.coalesce(mine, theirs)
            else:
                edge = F.col("_at_start" if kind == "previous" else "_at_end")
                fill[n] = F.when(edge, theirs).otherwise(mine)
        return self._next(finished(
            out.withColumns(fill).drop("_at_start", "_at_end", *[f"_c_{n}" for n, *_ in plan])
        ))

    def _next(self, df: DataFrame) -> "Sequence":
        out = Sequence(df, self.keys, self.order, self.hot_rows, _sliced=self.sliced)
        out._derived = True
        return out

    def running_sum(self, **sums: Column) -> "Sequence":
        return self.compute(sums=sums)

    def row_number(self, name: str) -> "Sequence":
        """1-based position inside the group."""
        return self.compute(sums={name: F.lit(1).cast("bigint")})

    def last_value(self, **values: Column) -> "Sequence":
        return self.compute(last=values)

    def next_value(self, **values: Column) -> "Sequence":
        return self.compute(upcoming=values)

    def previous(self, **values: Column) -> "Sequence":
        return self.compute(previous=values)

    def following(self, **values: Column) -> "Sequence":
        return self.compute(following=values)


def encounter_ids(
    df: DataFrame, key: list[str], order: list[str], prefix: str, name: str = "id",
    within: list[str] | None = None, hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """One row per distinct key with an identifier numbered by first encounter.

    ``within`` restarts the numbering per group (one model per file).  Returns the key columns,
    the first order and ``name``.
    """
    within = within or []
    firsts = df.groupBy(*within, *key).agg(F.min(F.struct(*order)).alias("_first"))
    extra = [o for o in order if o not in key and o not in within]
    firsts = firsts.select(*within, *key, *[F.col("_first")[o].alias(o) for o in extra])
    numbered = Sequence(firsts, within, order, hot_rows).row_number("_n").df
    return numbered.withColumn(name, F.concat(F.lit(prefix), F.col("_n"))).drop("_n")


def first_to_reach_mode(
    df: DataFrame, keys: list[str], value: str, order: list[str], name: str = "mode",
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Most frequent value per key; of equals, the one whose count got there first.

    The value that reaches the top count first is, among those with the top count, the one
    whose last occurrence comes earliest, so two aggregations suffice and no group is sorted.
    """
    place = F.struct(*order)
    counts = df.groupBy(*keys, value).agg(
        F.count(F.lit(1)).alias("_n"), F.max(place).alias("_last")
    )
    # one pass: largest count, then earliest final occurrence
    best = counts.groupBy(*keys).agg(
        F.min(F.struct((-F.col("_n")).alias("n"), F.col("_last").alias("last"),
                       F.col(value).alias("v"))).alias("_b")
    )
    return best.select(*keys, F.col("_b.v").alias(name))
