"""Long chains of competing probes: few rounds, and still the result of the sequential loop."""

import random

import pytest
from test_spatial import brute_serial, frame, points

from waterloom.operators import matching


@pytest.mark.parametrize("seed,grid,cap,rounds", [(1, None, 64, 1), (2, 10.0, 2, 1), (3, 10.0, 64, 2)])
def test_neighbourhoods_are_settled_like_the_loop(spark, seed, grid, cap, rounds):
    probes, cands = points(seed, 60, 50, grid), points(seed + 50, 50, 50, grid)
    # a second crowd, far away
    probes += [(100 + p[0], p[1] + 1000, p[2]) for p in points(seed + 9, 20, 30, grid)]
    cands += [(100 + c[0], c[1] + 1000, c[2]) for c in points(seed + 7, 20, 30, grid)]
    got = matching.serial_match(
        frame(spark, probes, "p"), frame(spark, cands, "c"), probe_key="p", point_key="c",
        probe_order="p_ord", point_order="c_ord", radius=25.0, cell_cap=cap, rounds=rounds)
    assert {r["p"]: r["c"] for r in got.collect()} == brute_serial(probes, cands, 25.0)
    assert got.rounds <= rounds + 2


def test_rounds_of_a_chain_are_bounded(spark):
    """Every probe wants the same point first: a chain as long as there are probes."""
    probes = [(i, 0.0, i * 1e-6) for i in range(40)]
    cands = [(i, 1.0 + i * 0.5, 0.0) for i in range(40)]
    got = matching.serial_match(
        frame(spark, probes, "p"), frame(spark, cands, "c"), probe_key="p", point_key="c",
        probe_order="p_ord", point_order="c_ord", radius=25.0)
    assert {r["p"]: r["c"] for r in got.collect()} == brute_serial(probes, cands, 25.0)
    assert got.rounds <= matching.ROUNDS + 2


def test_neighbourhoods_too_large_for_a_task_go_on_in_rounds(spark, monkeypatch):
    monkeypatch.setattr(matching, "SETTLED_PAIRS", 30)
    probes, cands = points(4, 30, 50, None), points(54, 30, 50, None)
    probes += [(100 + i, 5000.0, i * 1e-6) for i in range(4)]
    cands += [(100 + i, 5001.0 + i, 0.0) for i in range(4)]
    got = matching.serial_match(
        frame(spark, probes, "p"), frame(spark, cands, "c"), probe_key="p", point_key="c",
        probe_order="p_ord", point_order="c_ord", radius=25.0, rounds=1)
    assert {r["p"]: r["c"] for r in got.collect()} == brute_serial(probes, cands, 25.0)


def test_values_on_a_line_by_links(spark):
    rnd = random.Random(3)
    probes = [(i, float(rnd.randrange(20)), rnd.randrange(2)) for i in range(70)]
    values = [(i, float(rnd.randrange(20)) + rnd.choice([0, 0.5]), rnd.randrange(2)) for i in range(60)]
    got = matching.serial_match_values(
        spark.createDataFrame(probes, "p long, a double, g int"),
        spark.createDataFrame(values, "c long, b double, g int"), probe_key="p", value_key="c",
        probe_order="p", value_order="c", probe_value="a", value="b", by=["g"])
    want, free = {}, set(values)
    for p, a, g in probes:
        mine = [v for v in free if v[2] == g]
        if mine:
            best = min(mine, key=lambda v: (abs(v[1] - a), v[0]))
            free.remove(best)
            want[p] = best[0]
    assert {r["p"]: r["c"] for r in got.collect()} == want


@pytest.mark.parametrize("seed,grid,side,rounds", [
    (6, 10.0, 2, 1), (7, None, 1, 0)])
def test_crowds_too_large_for_a_task_are_settled_by_tiles(spark, monkeypatch, seed, grid, side, rounds):
    monkeypatch.setattr(matching, "SETTLED_ROWS", 5)
    monkeypatch.setattr(matching, "TILE_SIDES", (side,))
    probes, cands = points(seed, 90, 150, grid), points(seed + 50, 60, 150, grid)
    got = matching.serial_match(
        frame(spark, probes, "p"), frame(spark, cands, "c"), probe_key="p", point_key="c",
        probe_order="p_ord", point_order="c_ord", radius=25.0, cell_cap=2, rounds=rounds)
    assert {r["p"]: r["c"] for r in got.collect()} == brute_serial(probes, cands, 25.0)


def test_a_chain_in_a_large_crowd_takes_few_rounds(spark, monkeypatch):
    monkeypatch.setattr(matching, "SETTLED_ROWS", 5)
    probes = [(i, 0.0, i * 1e-6) for i in range(40)]
    cands = [(i, 1.0 + i * 0.5, 0.0) for i in range(40)]
    got = matching.serial_match(
        frame(spark, probes, "p"), frame(spark, cands, "c"), probe_key="p", point_key="c",
        probe_order="p_ord", point_order="c_ord", radius=25.0)
    assert {r["p"]: r["c"] for r in got.collect()} == brute_serial(probes, cands, 25.0)
    assert got.rounds <= matching.ROUNDS + 3
