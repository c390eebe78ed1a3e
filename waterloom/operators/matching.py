"""One-to-one matching and leader clustering, as rounds of joins.

Both reproduce a sequential greedy loop exactly.  Rounds cut their lineage with a checkpoint.
"""

from __future__ import annotations

import bisect
import heapq
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from waterloom.functions.geometry import distance
from waterloom.operators.graph import components
from waterloom.operators.ordered import Sequence
from waterloom.operators.spatial import (
    CELL_CAP,
    _best_per_probe,
    _boxed,
    _descend,
    _most_crowded,
    distinct_positions,
    with_neighbour_cells,
    with_own_cell,
)
from waterloom.session import materialize

#: Rounds after which neighbourhoods that are still undecided are settled one by one.
ROUNDS = 6
#: Rows, and pairs of a probe and a point in neighbouring cells, of a neighbourhood that one task
#: settles; larger ones go on in rounds.
SETTLED_ROWS, SETTLED_PAIRS = 200_000, 20_000_000
#: Cells along a side of a tile, and the rows (probes, slots in and around it) that a tile may have.
TILE_SIDES, TILE_ROWS = (16, 8, 4, 2, 1), 100_000


def _settle_line(probes: list, points: list, radius: float) -> list:
    """Nearest free number for each probe in turn: the next free one to either side, found through
    links that skip what is taken."""
    places = sorted(points, key=lambda p: (p[1], p[3]))
    at = [p[1] for p in places]
    right, left = list(range(len(at) + 1)), list(range(len(at) + 1))

    def free(links, i):
        while links[i] != i:
            links[i] = links[links[i]]
            i = links[i]
        return i

    out = []
    for number, x, y, _ in probes:
        # of equal numbers the one of lowest order comes first on either side
        i = bisect.bisect_left(at, x)
        up, down = free(right, i), free(left, i) - 1
        if down >= 0:
            first = bisect.bisect_left(at, at[down])
            down = free(right, first)
        best = None
        for j in (up, down):
            if 0 <= j < len(at):
                dx, dy = x - at[j], y - places[j][2]
                d = math.sqrt(dx * dx + dy * dy)
                if d < radius:
                    best = min(best or (d, places[j][3], j), (d, places[j][3], j))
        if best:
            j = best[2]
            right[j], left[j + 1] = j + 1, j
            out.append((number, places[j][0], best[0]))
    return out


def _settle_plane(probes: list, points: list, radius: float) -> list:
    """Nearest free point for each probe in turn, among those in the nine cells around it."""
    cells: dict[tuple, list] = {}
    for p in points:
        cells.setdefault((math.floor(p[1] / radius), math.floor(p[2] / radius)), []).append(p)
    out = []
    for number, x, y, _ in probes:
        cx, cy, best = math.floor(x / radius), math.floor(y / radius), None
        for key in ((cx + i, cy + j) for i in (-1, 0, 1) for j in (-1, 0, 1)):
            for p in cells.get(key, ()):
                dx, dy = x - p[1], y - p[2]
                d = math.sqrt(dx * dx + dy * dy)
                if d < radius and (best is None or (d, p[3]) < best[:2]):
                    best = (d, p[3], p, key)
        if best:
            cells[best[3]].remove(best[2])
            out.append((number, best[2][0], best[0]))
    return out


def _neighbourhoods(probes: DataFrame, points: DataFrame, by: list[str], radius: float) -> DataFrame:
    """Cells of probes and points that chains of neighbouring cells connect: by, _cx, _cy, _part,
    and the rows and pairs of each part."""
    cell = [*by, "_cx", "_cy"]
    held = with_own_cell(points, "_x", "_y", radius).groupBy(*cell).agg(
        F.count(F.lit(1)).alias("_points"))
    asking = materialize(with_own_cell(probes, "_px", "_py", radius).groupBy(*cell).agg(
        F.count(F.lit(1)).alias("_probes")).withColumns({
            "_fx": F.col("_cx"), "_fy": F.col("_cy"),
            "_mx": (F.col("_cx") + 0.5) * radius, "_my": (F.col("_cy") + 0.5) * radius}))
    near = with_neighbour_cells(asking.drop("_cx", "_cy"), "_mx", "_my", radius).join(held, cell)
    names = [F.coalesce(F.col(c).cast("string"), F.lit("\u0001")) for c in by]

    def node(x: str, y: str):
        return F.concat_ws("\u0000", *names, F.col(x).cast("string"), F.col(y).cast("string"))

    near = materialize(near.select(*by, node("_fx", "_fy").alias("src"), node("_cx", "_cy").alias(
        "dst"), "_probes", "_points", (F.col("_probes") * F.col("_points")).alias("_pairs")))
    parts = materialize(components(near, "src", "dst"))
    pairs = near.join(parts.withColumnRenamed("node", "src"), "src").groupBy("component").agg(
        F.sum("_pairs").alias("_pairs"))
    counts = materialize(asking.select(*by, "_cx", "_cy", F.col("_probes").alias("_n")).unionByName(
        held.withColumnRenamed("_points", "_n")).groupBy(*cell).agg(F.sum("_n").alias("_n")))
    placed = counts.withColumn("node", node("_cx", "_cy")).join(parts, "node")
    rows = placed.groupBy("component").agg(F.sum("_n").alias("_rows"))
    return materialize(placed.select(*cell, "component").join(
        rows.join(pairs, "component"), "component").withColumnRenamed("component", "_part"))


def _settled(probes: DataFrame, points: DataFrame, parts: DataFrame, by: list[str], radius: float,
             line: bool) -> DataFrame:
    """Matches (by, _pid, _key, _dist) inside each of the small neighbourhoods ``parts``, every one
    settled by a task in the order of its probes."""
    cell = [*by, "_cx", "_cy"]
    own = parts.select(*cell, "_part")
    number = F.monotonically_increasing_id()
    asking = materialize(with_own_cell(probes, "_px", "_py", radius).join(own, cell).withColumn(
        "_number", number))
    offered = materialize(with_own_cell(points, "_x", "_y", radius).join(own, cell).withColumn(
        "_number", number))
    rank = F.row_number().over(Window.partitionBy("_part").orderBy("_ord")).cast("double")
    rows = asking.select("_part", F.lit(True).alias("probe"), "_number", F.col("_px").alias("x"),
                         F.col("_py").alias("y"), F.col("_turn").alias("rank")).unionByName(
        offered.select("_part", F.lit(False).alias("probe"), "_number", F.col("_x").alias("x"),
                       F.col("_y").alias("y"), rank.alias("rank")))

    def settle(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["rank", "_number"])
        mine = frame["probe"]
        sides = [list(f[["_number", "x", "y", "rank"]].itertuples(index=False, name=None))
                 for f in (frame[mine], frame[~mine])]
        found = (_settle_line if line else _settle_plane)(*sides, radius)
        return pd.DataFrame(found, columns=["_p", "_q", "_dist"])

    pairs = rows.groupBy("_part").applyInPandas(settle, "_p bigint, _q bigint, _dist double")
    pairs = materialize(pairs)
    return asking.select(*by, "_pid", F.col("_number").alias("_p")).join(pairs, "_p").join(
        offered.select("_key", F.col("_number").alias("_q")), "_q").select(
        *by, "_pid", "_key", "_dist")


def _settle_tile(probes: list, slots: pd.DataFrame, holders: list, radius: float) -> tuple:
    """Let probes (turn, id, x, y) ask until each is seated, sent to a slot around the tile, or
    refused by all; returns who holds (id, x, y, turn, slot id, distance) the tile's own slots and
    who has to ask elsewhere (id, x, y, turn, x and y of the slot).

    ``slots`` has sid, x, y, rank, seats, limit and own.  The limits of slots around the tile are
    those of the round before: they only fall, so a slot that refuses by them refuses for good.
    """
    cx, cy = (np.floor(slots[c].to_numpy() / radius) for c in ("x", "y"))
    slots = slots.iloc[np.lexsort((cy, cx))]
    sid, x, y, rank, seats, limit, own = (
        slots[c].to_numpy(copy=True) for c in ("sid", "x", "y", "rank", "seats", "limit", "own"))
    columns: dict[float, tuple] = {}
    cx, cy = np.floor(x / radius), np.floor(y / radius)
    for c in np.unique(cx):
        lo, hi = np.searchsorted(cx, c, "left"), np.searchsorted(cx, c, "right")
        columns[c] = int(lo), cy[lo:hi]
    near: dict[tuple, list] = {}

    def runs(px: float, py: float) -> list:
        """The slots of the nine cells around a place, as three runs."""
        cell = math.floor(px / radius), math.floor(py / radius)
        if cell not in near:
            near[cell] = []
            for c in (cell[0] - 1, cell[0], cell[0] + 1):
                if c in columns:
                    lo, rows = columns[c]
                    a, b = np.searchsorted(rows, cell[1] - 1), np.searchsorted(
                        rows, cell[1] + 1, "right")
                    if a < b:
                        near[cell].append((lo + int(a), lo + int(b)))
        return near[cell]

    at = {s: i for i, s in enumerate(sid.tolist())}
    seated: dict[int, list] = {}
    for pid, px, py, turn, slot, d in holders:
        seated.setdefault(at[slot], []).append((-turn, pid, px, py, d))
    for heap in seated.values():
        heapq.heapify(heap)
    heapq.heapify(probes)
    away = []
    while probes:
        turn, pid, px, py = heapq.heappop(probes)
        best = None
        for lo, hi in runs(px, py):
            some = np.flatnonzero(limit[lo:hi] > turn)
            if some.size:
                some += lo
                dx, dy = px - x[some], py - y[some]
                d = np.sqrt(dx * dx + dy * dy)
                least = d.min()
                if least < radius and (best is None or least <= best[0]):
                    ties = some[d == least]
                    i = int(ties[rank[ties].argmin()])
                    found = (float(least), int(rank[i]), i)
                    best = found if best is None else min(best, found)
        if best is None:
            continue
        d, _, i = best
        if not own[i]:
            away.append((pid, px, py, turn, x[i], y[i]))
            continue
        heap = seated.setdefault(i, [])
        heapq.heappush(heap, (-turn, pid, px, py, d))
        if len(heap) > seats[i]:
            late, *rest, _ = heapq.heappop(heap)
            heapq.heappush(probes, (-late, *rest))
        if len(heap) == seats[i]:
            limit[i] = -heap[0][0]
    held = [(pid, px, py, -late, int(sid[i]), d) for i, heap in seated.items()
            for late, pid, px, py, d in heap]
    return held, away


def _tile_side(asking: DataFrame, slots: DataFrame, by: list[str], radius: float) -> int | None:
    """Cells along a side of the largest tiles that all have few enough rows, if any have."""
    cells = with_own_cell(asking, "_px", "_py", radius).groupBy(*by, "_cx", "_cy").agg(
        F.count(F.lit(1)).alias("_n"), F.lit(0).cast("bigint").alias("_s"))
    cells = materialize(cells.unionByName(
        with_own_cell(slots, "_x", "_y", radius).groupBy(*by, "_cx", "_cy").agg(
            F.lit(0).cast("bigint").alias("_n"), F.count(F.lit(1)).alias("_s"))))
    for side in TILE_SIDES:
        around = ((side + 4) / side) ** 2
        rows = cells.groupBy(*by, *[F.floor(F.col(c) / side).alias(c) for c in ("_cx", "_cy")]).agg(
            (F.sum("_n") + F.sum("_s") * around).alias("_rows")).agg(F.max("_rows")).first()[0]
        if (rows or 0) <= TILE_ROWS:
            return side
    return None


TILE = ("seated boolean, id bigint, px double, py double, turn double, sid bigint, dist double, "
        "ax double, ay double")


def _by_tiles(waiting: DataFrame, slots: DataFrame, held: DataFrame | None, by: list[str],
              radius: float, side: int) -> tuple[DataFrame, int]:
    """Who holds a seat (as ``held``) once all ``waiting`` probes have asked, and the rounds taken.

    The order of questions does not change a stable matching, so a task lets the probes of a tile
    of ``side`` cells ask one after the other, whole chains of them; only a probe whose next choice
    lies in another tile waits for the next round.  A tile knows the slots two cells around it, all
    that a probe which asks it, or one that loses a seat in it, can reach.
    """
    number = F.monotonically_increasing_id()
    groups = materialize(slots.select(*by).distinct().withColumn("_g", number)) if by else None

    def grouped(df: DataFrame) -> DataFrame:
        return df.join(groups, by) if by else df.withColumn("_g", F.lit(0).cast("bigint"))

    ranked = Sequence(slots, by, ["_ord", "_x", "_y", "_slot"]).row_number("_rank").df
    places = materialize(grouped(ranked).withColumn("_sid", number))
    person = [*by, "_pid", "_px", "_py", "_turn"]
    everyone = waiting.select(*person).withColumn("_at", F.lit(None).cast("bigint")).withColumn(
        "_dist", F.lit(None).cast("double"))
    if held is not None:
        own = places.select(*by, "_x", "_y", "_slot", F.col("_sid").alias("_at"))
        everyone = everyone.unionByName(held.join(own, [*by, "_x", "_y", "_slot"]).select(
            *person, "_at", "_dist"))
    usable = F.col("_pid").isNotNull() & F.col("_turn").isNotNull() & ~F.isnan("_turn")
    everyone = materialize(grouped(everyone.where(usable)).withColumn("_id", number))
    state = everyone.select(
        "_g", F.col("_at").isNotNull().alias("seated"), F.col("_id").alias("id"),
        F.col("_px").alias("px"), F.col("_py").alias("py"), F.col("_turn").alias("turn"),
        F.coalesce("_at", F.lit(-1)).alias("sid"), F.coalesce("_dist", F.lit(0.0)).alias("dist"),
        F.col("_px").alias("ax"), F.col("_py").alias("ay"))
    at = places.select(F.col("_sid").alias("sid"), F.col("_x").alias("_hx"), F.col("_y").alias("_hy"))
    state = materialize(state.join(at, "sid", "left").withColumns({
        "ax": F.coalesce("_hx", "ax"), "ay": F.coalesce("_hy", "ay")}).drop("_hx", "_hy"))
    tile, taken = ["_g", "_tx", "_ty"], 0

    def settle(frame: pd.DataFrame) -> pd.DataFrame:
        kind = frame["kind"].to_numpy()
        slots_ = frame[kind == 2].rename(columns={"px": "x", "py": "y", "turn": "limit", "id": "rank"})
        asking = list(frame.loc[kind == 0, ["turn", "id", "px", "py"]].itertuples(
            index=False, name=None))
        holders = list(frame.loc[kind == 1, ["id", "px", "py", "turn", "sid", "dist"]].itertuples(
            index=False, name=None))
        place = dict(zip(slots_["sid"].tolist(), zip(slots_["x"].tolist(), slots_["y"].tolist())))
        held_, away = _settle_tile(asking, slots_, holders, radius)
        g = frame["_g"].iloc[0]
        rows = [(g, True, *h, *place[h[4]]) for h in held_] + [
            (g, False, *a[:4], -1, 0.0, *a[4:]) for a in away]
        return pd.DataFrame(rows, columns=["_g", *[c.split()[0] for c in TILE.split(", ")]])

    while not state.where("NOT seated").isEmpty():
        # every other round the tiles lie half a side further
        move = side // 2 * (taken % 2)
        taken += 1

        def tile_of(c: str, by_cells: int = 0):
            return F.floor((F.floor(F.col(c) / F.lit(float(radius))) + move + by_cells) / side)

        placed = state.withColumns({"_tx": tile_of("ax"), "_ty": tile_of("ay")})
        active = materialize(placed.where("NOT seated").select(*tile).distinct())
        limits = materialize(state.where("seated").groupBy("sid").agg(
            F.count(F.lit(1)).alias("_taken"), F.max("turn").alias("_latest")))
        offered = places.select(
            "_g", F.col("_sid").alias("sid"), "_x", "_y", "_rank", "_seats").join(
            limits, "sid", "left")
        for c, name in (("_x", "_tx"), ("_y", "_ty")):
            offered = offered.withColumn(f"{name}0", tile_of(c)).withColumn(name, F.explode(
                F.array_distinct(F.array(*[tile_of(c, i) for i in range(-2, 3)]))))
        limit = F.when(F.col("_taken") >= F.col("_seats"), F.col("_latest")).otherwise(
            F.lit(float("inf")))
        offered = offered.select(
            *tile, F.lit(2).alias("kind"), F.col("_rank").cast("bigint").alias("id"),
            F.col("_x").alias("px"), F.col("_y").alias("py"), limit.alias("turn"), "sid",
            F.lit(0.0).alias("dist"), F.col("_seats").cast("bigint").alias("seats"),
            ((F.col("_tx") == F.col("_tx0")) & (F.col("_ty") == F.col("_ty0"))).alias("own"))
        people = placed.select(
            *tile, F.col("seated").cast("int").alias("kind"), "id", "px", "py", "turn", "sid",
            "dist", F.lit(0).cast("bigint").alias("seats"), F.lit(False).alias("own"))
        rows = people.unionByName(offered).join(active, tile, "left_semi")
        solved = rows.groupBy(*tile).applyInPandas(settle, f"_g bigint, {TILE}")
        rest = placed.join(active, tile, "left_anti").drop("_tx", "_ty")
        state = materialize(solved.unionByName(rest))
    people = everyone.select(*by, "_pid", "_px", "_py", "_turn", F.col("_id").alias("id"))
    seats = places.select("_x", "_y", "_slot", F.col("_sid").alias("sid"))
    return materialize(state.select("id", "sid", F.col("dist").alias("_dist")).join(
        people, "id").join(seats, "sid").select(*person, "_x", "_y", "_slot", "_dist")), taken


def priority(df: DataFrame, order: list[str], name: str = "priority", by=None) -> DataFrame:
    """Number the rows in match order."""
    return Sequence(df, by or [], order).row_number(name).df


def serial_match(
    probes: DataFrame, points: DataFrame, *, probe_key: str, point_key: str,
    probe_order: str, point_order: str, radius: float, by: list[str] | None = None,
    x: str = "x", y: str = "y", cell_cap: int = CELL_CAP, rounds: int = ROUNDS,
    line: bool = False,
) -> DataFrame:
    """Each probe, in ``probe_order``, takes its nearest free point closer than ``radius``.

    Solved as candidate-side stable matching, which has the same result because every point
    prefers the earlier probe (Gale and Shapley, 1962).  Every round the open probes ask their
    nearest slot that would still take them (free, or held by a later probe); a slot keeps its
    earliest askers and sends the others on.  A refusal is final, so the rounds end, but a chain
    of probes that compete for the same slots takes a round for each.  After ``rounds`` rounds the
    neighbourhoods (cells that chains of neighbours connect) with open probes are therefore
    settled by a task each, in the order of their probes, if they are small enough for that.
    Larger ones are cut into tiles, whose probes ask inside a task until one has to ask in another
    tile; crowded cells and more than ``SETTLED_ROWS`` probes come to that at once.  Only where a
    single cell is too crowded for a task, the rounds go on.  ``line`` says that all places lie on
    one line.

    Points at one position normally form one slot with that many seats, so a crowd of points is
    filled in one round.  That is exact unless a probe is equally far from two positions, one of
    them shared: then the order of the next free seat decides, and every point becomes a slot
    of its own.

    Returns ``by``, the probe key, the point key and ``distance`` for matched probes only.
    """
    by = by or []
    pos = [*by, "_x", "_y"]
    slot = [*pos, "_slot"]
    located = points.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(
        *by, F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y"),
        F.col(point_order).alias("_ord"), F.col(point_key).alias("_key"),
    )
    seats = materialize(Sequence(located, pos, ["_ord"]).row_number("_seat").df)
    shared = located.groupBy(*pos).agg(
        F.count(F.lit(1)).alias("_seats"), F.min("_ord").alias("_ord")
    )
    waiting = probes.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(
        *by, F.col(probe_key).alias("_pid"), F.col(x).cast("double").alias("_px"),
        F.col(y).cast("double").alias("_py"), F.col(probe_order).cast("double").alias("_turn"),
    )
    d = distance(F.col("_px"), F.col("_py"), F.col("_x"), F.col("_y"))
    sparse = _most_crowded(shared, by, radius, "_x", "_y") <= cell_cap

    def in_reach(asking: DataFrame, offered: DataFrame) -> DataFrame:
        pairs = with_neighbour_cells(asking, "_px", "_py", radius).join(
            with_own_cell(offered, "_x", "_y", radius), [*by, "_cx", "_cy"]
        )
        return pairs.withColumn("_d", d).where(F.col("_d") < radius)

    pooled = not seats.where(F.col("_seat") > 1).limit(1).count()
    if not pooled and sparse:
        ties = in_reach(waiting, shared).groupBy(*by, "_pid", "_d").agg(
            F.count(F.lit(1)).alias("_n"), F.max("_seats").alias("_m")
        )
        pooled = ties.where((F.col("_n") > 1) & (F.col("_m") > 1)).isEmpty()
    slots = materialize(
        shared.withColumn("_slot", F.lit(0).cast("bigint"))
        if pooled
        else seats.select(
            *pos, F.lit(1).cast("bigint").alias("_seats"), "_ord", F.col("_seat").alias("_slot")
        )
    )
    endless = F.lit(float("inf"))
    held: DataFrame | None = None
    everyone, done, taken = waiting, None, 0
    settle_at = 0 if not (line or sparse) and waiting.count() > SETTLED_ROWS else rounds
    while True:
        if taken == settle_at and not waiting.isEmpty():
            parts = _neighbourhoods(everyone, located, by, radius)
            open_ = with_own_cell(waiting, "_px", "_py", radius).join(
                parts, [*by, "_cx", "_cy"]).select("_part").distinct()
            small = parts.where((F.col("_rows") <= SETTLED_ROWS) & (
                F.lit(line) | (F.col("_pairs") <= SETTLED_PAIRS)))
            small = materialize(small.join(materialize(open_), "_part", "left_semi"))
            done = materialize(_settled(everyone, located, small, by, radius, line))
            apart = small.select(*by, "_cx", "_cy")

            def outside(df, px, py):
                return materialize(with_own_cell(df, px, py, radius).join(
                    apart, [*by, "_cx", "_cy"], "left_anti").drop("_cx", "_cy"))
            waiting = outside(waiting, "_px", "_py")
            held = None if held is None else outside(held, "_x", "_y")
            side = None if line or waiting.isEmpty() else _tile_side(waiting, slots, by, radius)
            if side:
                held, more = _by_tiles(waiting, slots, held, by, radius, side)
                taken += more
                break
        taken += 1
        if held is None:
            offers = slots.withColumn("_limit", endless)
        else:
            full = held.groupBy(*slot).agg(
                F.count(F.lit(1)).alias("_taken"), F.max("_turn").alias("_latest")
            )
            offers = slots.join(full, slot, "left").withColumn(
                "_limit",
                F.when(F.col("_taken") >= F.col("_seats"), F.col("_latest")).otherwise(endless),
            )
        if not pooled:
            # of the free points at one position only the first can be anyone's choice
            free = offers.where(F.col("_limit") == endless).groupBy(*pos).agg(
                F.min("_slot").alias("_free")
            )
            offers = offers.join(free, pos, "left").where(
                (F.col("_limit") < endless) | (F.col("_slot") == F.col("_free"))
            )
        offers = offers.select(
            *pos, "_ord", "_limit", F.struct("_x", "_y", "_slot").alias("_key")
        )
        takes = F.col("_limit") > F.col("_turn")
        if sparse:
            asked = _best_per_probe(in_reach(waiting, offers).where(takes), by)
        else:
            asked = _descend(
                waiting, _boxed(offers), by, d, radius, probe_cols=("_turn",),
                stats={"_blimit": ("max", "_limit")},
                box_ok=F.col("_blimit") > F.col("_turn"), item_ok=takes,
            )
        asked = materialize(
            waiting.join(asked, [*by, "_pid"]).select(
                *by, "_pid", "_px", "_py", "_turn", F.col("_key._x").alias("_x"),
                F.col("_key._y").alias("_y"), F.col("_key._slot").alias("_slot"), "_dist",
            )
        )
        if asked.isEmpty():
            break
        pool = asked if held is None else held.unionByName(asked)
        ranked = materialize(
            Sequence(pool, slot, ["_turn"]).row_number("_rank").df.join(
                slots.select(*slot, "_seats"), slot
            )
        )
        held = ranked.where(F.col("_rank") <= F.col("_seats")).drop("_rank", "_seats")
        waiting = ranked.where(F.col("_rank") > F.col("_seats")).select(
            *by, "_pid", "_px", "_py", "_turn"
        )
    if held is None:
        held = asked
    seated = Sequence(held, slot, ["_turn"]).row_number("_n").df.withColumn(
        "_seat", F.when(F.col("_slot") == 0, F.col("_n")).otherwise(F.col("_slot"))
    )
    matched = seated.join(seats, [*pos, "_seat"]).select(*by, "_pid", "_key", "_dist")
    if done is not None:
        matched = matched.unionByName(done)
    out = matched.select(
        *by, F.col("_pid").alias(probe_key), F.col("_key").alias(point_key),
        F.col("_dist").alias("distance"),
    )
    out.rounds = taken
    return out


def serial_match_values(
    probes: DataFrame, values: DataFrame, *, probe_key: str, value_key: str, probe_order: str,
    value_order: str, probe_value: str, value: str, by: list[str] | None = None,
) -> DataFrame:
    """``serial_match`` on a line at any distance: nearest number, each used once."""
    span = [
        df.agg(F.min(F.col(c).cast("double")), F.max(F.col(c).cast("double"))).first()
        for df, c in ((probes, probe_value), (values, value))
    ]
    ends = [v for row in span for v in row if v is not None]
    reach = (max(ends) - min(ends)) * 2 + 1 if ends else 1.0
    zero = F.lit(0.0)
    return serial_match(
        probes.withColumns({"_lx": F.col(probe_value).cast("double"), "_ly": zero}),
        values.withColumns({"_lx": F.col(value).cast("double"), "_ly": zero}),
        probe_key=probe_key, point_key=value_key, probe_order=probe_order,
        point_order=value_order, radius=reach, by=by, x="_lx", y="_ly", line=True,
    ).withColumnRenamed("distance", "gap")


def leader_cluster(
    points: DataFrame, *, key: str, order: str, radius: float, by: list[str] | None = None,
    x: str = "x", y: str = "y",
) -> DataFrame:
    """In ``order``, the first free point leads and takes every later free point in ``radius``.

    Leaders are the lexicographically first maximal independent set of the radius graph
    (Blelloch, Fineman and Shun, 2012).  Cells are small enough that all points of a cell are
    neighbours, so a cell holds at most one leader and offers one candidate per round; each
    point meets at most one candidate per cell around it and no pair inside a cell is formed.

    Returns ``by``, the point key and ``leader`` (the leader's key) for every point.
    """
    by = by or []
    side, reach = radius / 1.5, 2
    pos = [*by, "_x", "_y"]
    cell = [*by, "_cx", "_cy"]
    places = materialize(
        with_own_cell(distinct_positions(points, key, order, by, x, y), "_x", "_y", side)
    )
    undecided = places.drop("_key")
    near = distance(F.col("_px"), F.col("_py"), F.col("_x"), F.col("_y")) < radius

    def around(leaders: DataFrame) -> DataFrame:
        """Leaders or candidates, repeated for the cells they can reach."""
        renamed = leaders.select(
            *by, F.col("_x").alias("_px"), F.col("_y").alias("_py"), F.col("_ord").alias("_lord")
        )
        return with_neighbour_cells(renamed, "_px", "_py", side, reach)

    leaders: DataFrame | None = None
    while not undecided.isEmpty():
        first = undecided.groupBy(*cell).agg(F.min(F.struct("_ord", "_x", "_y")).alias("_m"))
        candidates = first.select(*by, F.col("_m._x").alias("_x"), F.col("_m._y").alias("_y"),
                                  F.col("_m._ord").alias("_ord"))
        beaten = (
            around(candidates)
            .join(undecided, cell)
            .where((F.col("_ord") < F.col("_lord")) & near)
            .select(*by, F.col("_px").alias("_x"), F.col("_py").alias("_y"))
            .distinct()
        )
        chosen = materialize(candidates.join(beaten, pos, "left_anti"))
        leaders = chosen if leaders is None else leaders.unionByName(chosen)
        taken = around(chosen).join(undecided, cell).where(near).select(*pos).distinct()
        undecided = materialize(undecided.join(taken, pos, "left_anti"))
    if leaders is None:
        return points.select(*by, key, F.col(key).alias("leader")).where(F.lit(False))
    owner = (
        around(leaders)
        .join(places, cell)
        .where((F.col("_lord") <= F.col("_ord")) & near)
        .groupBy(*pos)
        .agg(F.min(F.struct("_lord", "_px", "_py")).alias("_l"))
    )
    names = places.select(
        *by, F.col("_x").alias("_lx"), F.col("_y").alias("_ly"), F.col("_key").alias("leader")
    )
    named = owner.select(*pos, F.col("_l._px").alias("_lx"), F.col("_l._py").alias("_ly")).join(
        names, [*by, "_lx", "_ly"]
    )
    placed = points.select(
        *by, key, F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y")
    )
    return placed.join(named, pos).select(*by, key, "leader")


__all__ = ["leader_cluster", "priority", "serial_match", "serial_match_values"]
