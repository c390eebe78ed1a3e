"""Spatial and iterative operators against plain sequential loops."""

import math
import random

import pytest
from pyspark.sql import functions as F

from waterloom.functions import crs
from waterloom.operators import graph, matching, ordered, spatial


def points(seed, n, spread, grid=None):
    rnd = random.Random(seed)
    out = []
    for i in range(n):
        x, y = rnd.uniform(0, spread), rnd.uniform(0, spread)
        if grid:
            x, y = round(x / grid) * grid, round(y / grid) * grid
        out.append((i, x, y))
    return out


def frame(spark, rows, key):
    return spark.createDataFrame(rows, f"{key} long, x double, y double").withColumn(
        f"{key}_ord", F.col(key)
    )


def dist(a, b):
    return math.sqrt((a[1] - b[1]) ** 2 + (a[2] - b[2]) ** 2)


def brute_nearest(probes, cands, radius):
    out = {}
    for p in probes:
        best, bd = None, radius if radius is not None else math.inf
        for c in cands:
            if dist(p, c) < bd:
                best, bd = c[0], dist(p, c)
        if best is not None:
            out[p[0]] = best
    return out


@pytest.mark.parametrize("grid", [None, 10.0])
@pytest.mark.parametrize("radius", [7.0, 40.0, None])
@pytest.mark.parametrize("cap", [1, 1000])
def test_nearest(spark, grid, radius, cap):
    if radius is None and cap == 1:
        pytest.skip("same plan")
    probes, cands = points(1, 120, 200, grid), points(2, 200, 200, grid)
    cands += [(1000 + i, 5.0, 5.0) for i in range(150)]
    got = spatial.nearest(
        frame(spark, probes, "p"), frame(spark, cands, "c"), probe_key="p", point_key="c",
        order="c_ord", radius=radius, cell_cap=cap,
    )
    assert {r["p"]: r["c"] for r in got.collect()} == brute_nearest(probes, cands, radius)


def test_nearest_segment(spark):
    rnd = random.Random(3)
    segs = [
        (i, *(rnd.uniform(0, 100) for _ in range(2)), *(rnd.uniform(0, 100) for _ in range(2)))
        for i in range(200)
    ] + [(500, 1.0, 1.0, 1.0, 1.0), (501, -1000.0, 50.0, 1000.0, 50.0)]
    probes = points(4, 80, 120)

    def seg_dist(p, s):
        dx, dy = s[3] - s[1], s[4] - s[2]
        ll = dx * dx + dy * dy
        t = 0 if ll == 0 else max(0, min(1, ((p[1] - s[1]) * dx + (p[2] - s[2]) * dy) / ll))
        return math.hypot(p[1] - s[1] - t * dx, p[2] - s[2] - t * dy)

    df = spark.createDataFrame(segs, "s long, x1 double, y1 double, x2 double, y2 double")
    got = spatial.nearest_segment(
        frame(spark, probes, "p"), df, probe_key="p", segment_key="s", order="s"
    )
    rows = {r["p"]: r for r in got.collect()}
    for p in probes:
        best = min(seg_dist(p, s) for s in segs)
        assert abs(rows[p[0]]["distance"] - best) < 1e-9


@pytest.mark.parametrize("square", [True, False])
def test_first_around(spark, square):
    probes, cands = points(5, 60, 300), points(6, 400, 300)
    got = spatial.first_around(
        frame(spark, probes, "p"), frame(spark, cands, "c"), probe_key="p", point_key="c",
        order="c_ord", half=20.0, square=square,
    )
    want = {}
    for p in probes:
        for c in cands:
            inside = abs(c[1] - p[1]) < 20 and abs(c[2] - p[2]) < 20
            if inside if square else dist(p, c) < 20:
                want[p[0]] = c[0]
                break
    assert {r["p"]: r["c"] for r in got.collect()} == want


@pytest.mark.parametrize("hot", [10, 1_000_000])
def test_nearest_value(spark, hot, monkeypatch):
    monkeypatch.setattr(ordered, "HOT_ROWS", hot)
    monkeypatch.setattr(
        spatial, "Sequence", lambda df, keys, order: ordered.Sequence(df, keys, order, hot)
    )
    rnd = random.Random(7)
    probes = [(i, float(rnd.randint(0, 100))) for i in range(60)]
    values = [(i, float(rnd.randint(0, 100))) for i in range(25)]
    got = spatial.nearest_value(
        spark.createDataFrame(probes, "p long, a double"),
        spark.createDataFrame(values, "c long, b double"),
        probe_key="p", probe_value="a", value_key="c", value="b", order="c",
    )
    want = {p: min(values, key=lambda v: (abs(v[1] - a), v[0]))[0] for p, a in probes}
    assert {r["p"]: r["c"] for r in got.collect()} == want


def brute_serial(probes, cands, radius):
    free, out = list(cands), {}
    for p in probes:
        best, bd = None, radius
        for c in free:
            if dist(p, c) < bd:
                best, bd = c, dist(p, c)
        if best:
            free.remove(best)
            out[p[0]] = best[0]
    return out


@pytest.mark.parametrize("seed,grid,cap", [(11, None, 64), (12, 10.0, 2)])
def test_serial_match(spark, seed, grid, cap):
    probes, cands = points(seed, 24, 50, grid), points(seed + 50, 24, 50, grid)
    got = matching.serial_match(
        frame(spark, probes, "p"), frame(spark, cands, "c"), probe_key="p", point_key="c",
        probe_order="p_ord", point_order="c_ord", radius=25.0, cell_cap=cap,
    )
    assert {r["p"]: r["c"] for r in got.collect()} == brute_serial(probes, cands, 25.0)


def test_serial_match_values(spark):
    probes = [(0, 10.0), (1, 10.0), (2, 11.0), (3, 90.0)]
    values = [(0, 9.0), (1, 12.0), (2, 50.0)]
    got = matching.serial_match_values(
        spark.createDataFrame(probes, "p long, a double"),
        spark.createDataFrame(values, "c long, b double"),
        probe_key="p", value_key="c", probe_order="p", value_order="c", probe_value="a", value="b",
    )
    assert {r["p"]: r["c"] for r in got.collect()} == {0: 0, 1: 1, 2: 2}


def brute_leaders(pts, radius):
    used, out = set(), {}
    for i, p in enumerate(pts):
        if p[0] in used:
            continue
        used.add(p[0])
        out[p[0]] = p[0]
        for q in pts[i + 1 :]:
            if q[0] not in used and dist(p, q) < radius:
                used.add(q[0])
                out[q[0]] = p[0]
    return out


@pytest.mark.parametrize("seed,spread,grid", [(21, 60, None), (22, 40, 2.0), (23, 12, 1.0)])
def test_leader_cluster(spark, seed, spread, grid):
    pts = points(seed, 150, spread, grid)
    got = matching.leader_cluster(frame(spark, pts, "p"), key="p", order="p_ord", radius=5.0)
    assert {r["p"]: r["leader"] for r in got.collect()} == brute_leaders(pts, 5.0)


def test_leader_cluster_is_not_transitive(spark):
    chain = [(0, 0.0, 0.0), (1, 4.0, 0.0), (2, 8.0, 0.0)]
    got = matching.leader_cluster(frame(spark, chain, "p"), key="p", order="p_ord", radius=5.0)
    assert {r["p"]: r["leader"] for r in got.collect()} == {0: 0, 1: 0, 2: 2}


def test_components(spark):
    edges = [(i, i + 1) for i in range(200)] + [(500, 501), (501, 502), (502, 500), (700, 700)]
    labelled = graph.components(spark.createDataFrame(edges, "src long, dst long"))
    rows = {r["node"]: r["component"] for r in labelled.collect()}
    assert len(rows) == 205
    assert {rows[i] for i in range(201)} == {0}
    assert rows[502] == 500 and rows[700] == 700
    top = graph.topology_summary(labelled).first()
    assert (top["components"], top["largest"], top["isolated"]) == (3, 201, 2)


@pytest.mark.parametrize("hot", [7, 1_000_000])
def test_sequence(spark, hot):
    rnd = random.Random(31)
    rows = [(k, i, float(rnd.randint(1, 9)), rnd.choice([None, f"t{i}"]))
            for k in ("a", "b") for i in range(20 if k == "a" else 3)]
    df = spark.createDataFrame(rows, "k string, i long, v double, t string")
    seq = ordered.Sequence(df, "k", "i", hot_rows=hot)
    assert seq.sliced == (hot == 7)
    got = (
        seq.running_sum(run=F.col("v")).row_number("n").previous(prev=F.col("v"))
        .following(nxt=F.col("v")).last_value(last=F.col("t")).next_value(upc=F.col("t")).df
    )
    rows_by_key = {k: [r for r in rows if r[0] == k] for k in ("a", "b")}
    for r in got.collect():
        group = rows_by_key[r["k"]]
        i = r["i"]
        assert r["run"] == sum(g[2] for g in group[: i + 1])
        assert r["n"] == i + 1
        assert r["prev"] == (group[i - 1][2] if i else None)
        assert r["nxt"] == (group[i + 1][2] if i + 1 < len(group) else None)
        assert r["last"] == next((g[3] for g in reversed(group[: i + 1]) if g[3]), None)
        assert r["upc"] == next((g[3] for g in group[i:] if g[3]), None)


def test_mode_first_to_reach(spark):
    rnd = random.Random(5)
    rows = [(k, i, rnd.randint(1, 4)) for k in range(30) for i in range(rnd.randint(1, 12))]
    got = ordered.first_to_reach_mode(
        spark.createDataFrame(rows, "k long, i long, v long"), ["k"], "v", ["i"]
    )
    want = {}
    for k in range(30):
        freq, top = {}, 0
        for _, _, v in (r for r in rows if r[0] == k):
            freq[v] = freq.get(v, 0) + 1
            if freq[v] > top:
                top, want[k] = freq[v], v
    assert {r["k"]: r["mode"] for r in got.collect()} == want


def test_encounter_ids(spark):
    rows = [("b", 0), ("a", 1), ("b", 2), ("c", 3), ("a", 4)]
    got = ordered.encounter_ids(
        spark.createDataFrame(rows, "k string, i long"), ["k"], ["i"], "J", hot_rows=2
    )
    assert {r["k"]: r["id"] for r in got.collect()} == {"b": "J1", "a": "J2", "c": "J3"}


@pytest.mark.parametrize("code", crs.CODES)
def test_projections_in_absolute_terms(spark, code):
    """A projection is fixed by its origin, its scale on one line, and being conformal: all three
    are tested by differences, without any formula of the library."""
    if code in crs.UTM_ZONES:
        a, f, lon0, lat0 = 6378137.0, 1 / 298.257223563, crs.UTM_ZONES[code] * 6 - 183.0, 0.0
        k0, origin = 0.9996, (500000.0, 0.0)
        lats, lons = [0.0, 20.0, 36.5, 45.0, 60.0], [0.0, 0.5, 2.0, -2.9]
    else:
        a, f, lon0, lat0 = 6378249.145, 1 / 293.4663, 2.7, 36.0
        k0, origin = 0.999625544, (500135.0, 300090.0)
        lats, lons = [34.0, 36.0, 37.5], [0.0, 1.0, -4.0]
    h, e2 = 1e-4, f * (2 - f)
    spots = [(lon0 + dx + i * h, lat + j * h, dx, lat, i, j) for lat in lats for dx in lons
             for i, j in ((0, 0), (1, 0), (-1, 0), (0, 1), (0, -1))] + [
        (lon0, lat0, None, None, 9, 9)]
    df = spark.createDataFrame(spots, "lon double, lat double, dx double, at double, i int, j int")
    p = crs.from_lonlat(F.col("lon"), F.col("lat"), code)
    got = {(r.dx, r.at, r.i, r.j): (r.p.x, r.p.y) for r in df.withColumn("p", p).collect()}
    assert got[None, None, 9, 9] == pytest.approx(origin, abs=1e-4)
    for lat in lats:
        s2 = math.sin(math.radians(lat)) ** 2
        nu = a / math.sqrt(1 - e2 * s2)
        rho = a * (1 - e2) / (1 - e2 * s2) ** 1.5
        step = math.radians(2 * h)
        for dx in lons:
            (x1, y1), (x0, y0) = got[dx, lat, 1, 0], got[dx, lat, -1, 0]
            (u1, v1), (u0, v0) = got[dx, lat, 0, 1], got[dx, lat, 0, -1]
            east = complex(x1 - x0, y1 - y0) / (nu * math.cos(math.radians(lat)) * step)
            north = complex(u1 - u0, v1 - v0) / (rho * step)
            assert abs(north - east * 1j) < 1e-6  # a quarter turn apart at the same scale
            on_line = dx == 0.0 if code in crs.UTM_ZONES else lat == lat0
            if on_line:
                assert abs(north) == pytest.approx(k0, abs=1e-7)


def test_published_meridian_arc(spark):
    """Quarter meridian of WGS 84: 10,001,965.729 m."""
    df = spark.createDataFrame([(3.0, 90.0 - 1e-9)], "lon double, lat double")
    y = df.select(crs.from_lonlat(F.col("lon"), F.col("lat"))["y"]).first()[0]
    assert y / 0.9996 == pytest.approx(10001965.729, abs=0.002)


def test_series_are_computed_once_a_position(spark):
    """Each term of the inverse series stands once in the plan, and the result turns back."""
    from waterloom.plans.features import extent, point_features

    df = spark.createDataFrame([("f", 500000.0, 4e6), ("f", 612345.0, 3.9e6), ("f", None, 1.0)],
                               "file string, x double, y double")
    made = point_features(df, "regard", "EPSG:32631")
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert plan.upper().count("COSH(") == plan.upper().count("COS(") - 1 == len(crs._BETA)
    spots = [tuple(r.coordinates[0]) for r in made.collect()]
    assert spots[2][0] is None
    back = spark.createDataFrame(spots, "lon double, lat double").select(
        crs.from_lonlat(F.col("lon"), F.col("lat")).alias("p")).collect()
    for (_, x, y), r in zip([r for r in df.collect()][:2], back):
        assert (r.p.x, r.p.y) == pytest.approx((x, y), abs=1e-6)
    box = extent(made).first()
    assert (box.west, box.north) == (spots[0][0], max(spots[0][1], spots[1][1]))


def test_running_sums_do_not_depend_on_slices(spark):
    rnd = random.Random(21)
    values = [rnd.choice([1, -1]) * rnd.random() * 10.0 ** rnd.randrange(-9, 9) for _ in range(900)]
    values[10] = None
    rows = [(i % 3, i, v) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "g long, n long, v double").repartition(5)

    def run(hot):
        seq = ordered.Sequence(df, "g", "n", hot).running_sum(s=F.col("v"), k=F.lit(1))
        return {r.n: (r.s, r.k) for r in seq.df.collect()}

    one, many = run(10 ** 6), run(50)
    assert one == many  # every bit
    for g in range(3):
        mine = [(n, v) for h, n, v in rows if h == g]
        for i in (0, 1, 150, len(mine) - 1):
            exact = math.fsum(v or 0.0 for _, v in mine[:i + 1])
            assert one[mine[i][0]][0] == pytest.approx(exact, rel=1e-15, abs=1e-22)
    wild = spark.createDataFrame([(0, 0, 1e300), (0, 1, 1.0), (1, 0, float("nan")), (1, 1, 2.0),
                                  (2, 0, float("-inf")), (2, 1, 2.0)], "g long, n long, v double")
    got = {(r.g, r.n): r.s for r in ordered.Sequence(wild, "g", "n").running_sum(s=F.col("v")).df.collect()}
    assert got[0, 1] == 1e300 and math.isnan(got[1, 1]) and got[2, 1] == float("-inf")


def test_lengths_do_not_depend_on_partitions(spark):
    rnd = random.Random(22)
    df = spark.createDataFrame([(i % 4, i, rnd.random() * 1e3, rnd.random()) for i in range(400)],
                               "g long, v_no long, x double, y double")
    from waterloom.operators import polylines

    runs = [{r.g: r.length for r in polylines.lengths(df.repartition(n), ["g"]).collect()}
            for n in (1, 7)]
    assert runs[0] == runs[1]


def test_long_segments_are_searched_by_pieces(spark, monkeypatch):
    """Long flat segments above each other: a probe compares those near it, not all that span it."""
    rng = random.Random(5)
    rows = []
    for i in range(400):
        x, y = rng.uniform(0, 20000), rng.uniform(0, 400)
        rows.append((i, x, y, x + rng.uniform(3000, 5000), y + rng.uniform(-20, 20)))
    rows += [(400, 50.0, 50.0, 50.0, 50.0), (401, *rows[7][1:])]
    probes = [(i, rng.uniform(-500, 25000), rng.uniform(-50, 450)) for i in range(60)]
    compared = []
    best = spatial._best_per_probe

    def counted(found, by):
        compared.append(found.count())
        return best(found, by)
    monkeypatch.setattr(spatial, "_best_per_probe", counted)
    got = spatial.nearest_segment(
        spark.createDataFrame(probes, "p long, x double, y double"),
        spark.createDataFrame(rows, "s long, x1 double, y1 double, x2 double, y2 double"),
        probe_key="p", segment_key="s", order="s").collect()

    def away(px, py, ax, ay, bx, by):
        dx, dy = bx - ax, by - ay
        t = min(1.0, max(0.0, ((px - ax) * dx + (py - ay) * dy) / (dx * dx + dy * dy or 1.0)))
        return math.sqrt((px - ax - t * dx) ** 2 + (py - ay - t * dy) ** 2)
    want = {p: min((round(away(px, py, *r[1:]), 9), r[0]) for r in rows) for p, px, py in probes}
    assert {r.p: (round(r.distance, 9), r.s) for r in got} == want
    assert compared[0] < 40 * len(probes)


@pytest.mark.parametrize("few", [0, 1 << 18])
def test_crowded_segments_are_left_out_by_tiles(spark, monkeypatch, few):
    """Thousands of long flat lines above each other: tiles of probes keep few of them."""
    rng = random.Random(15)
    lines = []
    for i in range(600):  # lines of five corners, so that neighbours are equally near at a corner
        x, y = rng.uniform(0, 15000), rng.uniform(0, 400)
        corners = [(x + 1000 * j, y + rng.uniform(-20, 20)) for j in range(5)]
        lines += [(10 * i + j, *a, *b) for j, (a, b) in enumerate(zip(corners, corners[1:]))]
    lines += [(9000, 50.0, 50.0, 50.0, 50.0), (9001, *lines[7][1:]), (9002, None, None, 1.0, None)]
    rows = [(f, *r) for f in "ab" for r in lines if f == "a" or r[0] % 3 or r[0] > 8999]
    probes = [(f, i, rng.uniform(-500, 20000), rng.uniform(-50, 450))
              for f in "ab" for i in range(60)]
    probes += [("a", 200 + k, lines[k][3], lines[k][4]) for k in range(0, 40, 4)]
    probes += [("a", 3, 100.0, 1e4), ("a", 4, None, 1.0), ("c", 5, 1.0, 1.0), ("b", 70, 1e6, 0.1)]
    for name, value in (("TILE_PROBES", 4), ("FEW_PAIRS", few)):
        monkeypatch.setattr(spatial, name, value, raising=False)
    compared, best = [], spatial._best_per_probe

    def counted(found, by):
        compared.append(found.count())
        return best(found, by)
    monkeypatch.setattr(spatial, "_best_per_probe", counted)
    got = spatial.nearest_segment(
        spark.createDataFrame(probes, "f string, p long, x double, y double"),
        spark.createDataFrame(rows, "f string, s long, x1 double, y1 double, x2 double, y2 double"),
        probe_key="p", segment_key="s", order="s", by=["f"]).collect()

    def away(px, py, ax, ay, bx, by):
        dx, dy = bx - ax, by - ay
        size = dx * dx + dy * dy
        if size == 0:
            return math.sqrt((px - ax) ** 2 + (py - ay) ** 2)
        t = min(1.0, max(0.0, ((px - ax) * dx + (py - ay) * dy) / size))
        ex, ey = px - (ax + t * dx), py - (ay + t * dy)
        return math.sqrt(ex * ex + ey * ey)
    want = {}
    for f, p, px, py in probes:
        if f != "c" and px is not None:
            near = min((away(px, py, *r[2:]), r[1]) for r in rows if r[0] == f and r[2] is not None)
            want[f, p] = min(want.get((f, p), near), near)
    assert {(r.f, r.p): (r.distance, r.s) for r in got} == want
    assert sum(compared) < (40 if few else 200) * len(probes)


def test_crowded_segments_fill_no_disk(spark):
    """What a search of long flat segments shuffles follows the probes and segments."""
    rng = random.Random(16)
    rows = [(i, x, y, x + 4000, y + rng.uniform(-50, 50)) for i, x, y in (
        (i, rng.uniform(0, 15000), rng.uniform(0, 400)) for i in range(3000))]
    probes = [(i, rng.uniform(-500, 20000), rng.uniform(-50, 450)) for i in range(1500)]

    def kept():
        found = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager(
            ).getAllFiles()
        return {found.apply(i).getName(): found.apply(i).length() for i in range(found.size())}
    before = kept()
    spatial.nearest_segment(
        spark.createDataFrame(probes, "p long, x double, y double"),
        spark.createDataFrame(rows, "s long, x1 double, y1 double, x2 double, y2 double"),
        probe_key="p", segment_key="s", order="s").collect()
    size = sum(n for name, n in kept().items() if name not in before)
    assert size < 100 * (len(rows) + len(probes))
