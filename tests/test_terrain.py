"""Analytic surfaces and known parameters."""

from __future__ import annotations

import heapq
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from ridgeline.functions.solvers import factor_stencil, minimise, residual, search, search_line, solve_crosses, solve_stencil, solve_stencils
from ridgeline.jobs import catalog, studies
from ridgeline.operators import drainage, models, planform, resample, routing, slope_area, stencil
from ridgeline.session import in_packs, stage
from ridgeline.sources import grids


def grid(spark, f, ny=10, nx=10, holes=()):
    rows = [("t", j, i, None if (j, i) in holes else float(f(j, i))) for j in range(ny) for i in range(nx)]
    return spark.createDataFrame(rows, "tile_id string, j int, i int, z double")


def at(df, column):
    return {(r["j"], r["i"]): r[column] for r in df.collect()}


def test_plane_slopes_and_laplacian(spark):
    plane = grid(spark, lambda j, i: 0.1 * i)
    assert all(v == pytest.approx(0.1) for v in at(stencil.slope_magnitude(plane), "slope").values())
    lap = at(stencil.laplacian(plane, 2.0), "lap")
    assert lap[0, 3] is None and lap[4, 4] == pytest.approx(0.0)


def test_one_sided_slope_next_to_nodata(spark):
    df = grid(spark, lambda j, i: 2.0 * i, 3, 4, holes={(1, 2)}).withColumn("area", F.when(F.col("z").isNotNull(), 1.0))
    s = at(stencil.one_sided_slope(df, 1.0), "slope")
    assert s[1, 1] == pytest.approx(2.0) and s[1, 2] is None


@pytest.mark.parametrize(("f", "angle"), [(lambda j, i: -i, 0.0), (lambda j, i: -i - j, 7 * math.pi / 4), (lambda j, i: j, math.pi / 2), (lambda j, i: -j, 3 * math.pi / 2)])
def test_dinf_angles_of_planes(spark, f, angle):
    d = routing.dinf_direction(grid(spark, f), 1.0).where("j BETWEEN 2 AND 7 AND i BETWEEN 2 AND 7")
    assert all(v == pytest.approx(angle) for v in at(d, "angle").values())


def test_dinf_weights_sum_to_one_and_flats_fall_back(spark):
    z = grid(spark, lambda j, i: 5.0 if 3 <= j < 6 and 3 <= i < 6 else 10.0 - j).withColumn("fd", F.lit(4))
    d = routing.dinf_direction(z, 1.0)
    w = routing.dinf_receivers(d).groupBy("j", "i").agg(F.sum("weight").alias("w"))
    assert all(v == pytest.approx(1.0) for v in at(w, "w").values())
    assert at(d, "facet")[4, 4] == 6


def test_v_valley_is_symmetric(spark):
    z = grid(spark, lambda j, i: 10 * abs(i - 5) + 0.5 * (11 - j), 11, 11)
    a = at(routing.dinf_area(routing.dinf_direction(z, 1.0), 1.0), "area_dinf")
    assert all(a[j, 5 - k] == pytest.approx(a[j, 5 + k], rel=0.1) for j in range(1, 10) for k in range(1, 5))


def test_d8_area_counts_cells_and_refuses_cycles(spark):
    z = grid(spark, lambda j, i: -j, 6, 4)
    a = at(routing.flow(z, 10.0), "area")
    assert a[5, 2] == 600.0 and a[0, 0] == 100.0
    loop = spark.createDataFrame([("t", 0, 0, 0, 1), ("t", 0, 1, 0, 0)], "tile_id string, j int, i int, dn_j int, dn_i int")
    with pytest.raises(ValueError, match="cycle"):
        routing.accumulate(loop, 1.0, max_rounds=4)


def test_channel_elevation_adds_up_along_a_line(spark):
    z = grid(spark, lambda j, i: 100.0 - j, 6, 5)
    z = routing.flow(z, 10.0)
    got = at(routing.channel_elevation(z, 10.0, 1e-4, 1e-5, 0.5), "z_channel")
    want = 95.0
    for j in range(4, 0, -1):
        want += 10.0 * 10.0 / math.sqrt((j + 1) * 100.0)
        assert got[j, 2] == pytest.approx(want)


def test_pits_fill_to_their_rim(spark):
    filled = at(drainage.fill_pits(grid(spark, lambda j, i: 0.0 if (j, i) == (4, 4) else 5.0 + j)), "filled")
    assert filled[4, 4] == 8.0


def test_zoom_sizes_and_holes(spark):
    ones = grid(spark, lambda j, i: 1.0, 20, 20, holes={(j, i) for j in range(5, 10) for i in range(5, 10)})
    out = at(resample.resample(ones, 1.0, 2.0), "z")
    assert len(out) == 100 and out[3, 3] is None and out[0, 0] == 1.0


def test_known_power_laws_come_back(spark):
    a = np.logspace(3, 7, 200)
    pts = spark.createDataFrame([("g", float(x), float(100 * x**-0.45)) for x in a], "k string, a double, s double")
    fit = slope_area.fit_free(pts, ["k"]).first()
    assert fit["theta"] == pytest.approx(0.45) and fit["ks"] == pytest.approx(100.0) and fit["r2"] == pytest.approx(1.0)
    assert slope_area.fit_fixed(pts, ["k"], 0.45).first()["ks"] == pytest.approx(100.0)
    assert slope_area.local_ks(pts, ["k"], 0.45).first()["ks_median"] == pytest.approx(100.0)
    few = slope_area.fit_free(pts.limit(2), ["k"]).first()
    assert few["ks"] is None and few["n_good"] == 2
    assert slope_area.binned(pts.limit(20), ["k"]).count() == 0
    line = slope_area.fit_bins(slope_area.binned(pts, ["k"], min_per_bin=5), ["k"]).first()
    assert line["theta"] == pytest.approx(0.45, abs=1e-6)


def test_nan_and_zero_slopes_are_left_out(spark):
    pts = grids.no_nan(spark.createDataFrame([("g", 1.0, float("nan")), ("g", 2.0, 0.0), ("g", None, 1.0), ("g", 4.0, 0.5)], "k string, a double, s double"))
    assert slope_area.usable(pts).count() == 1


def test_quantiles_are_exact_with_ties_nulls_and_skew(spark):
    rng = np.random.default_rng(5)
    groups = {"even": list(rng.normal(size=4000)), "ties": [1.0] * 3000 + [2.0] * 500 + [7.5], "two": [3.0, 4.0], "one": [9.0], None: list(rng.pareto(1.0, 900))}
    rows = [(k, float(x)) for k, xs in groups.items() for x in xs] + [("even", None), ("nothing", None)]
    probs = (0.0, 0.25, 0.5, 0.9, 1.0)
    df = spark.createDataFrame(rows, "k string, x double")
    got = {r["k"]: (r["q"], r["n"]) for r in slope_area.quantiles(df, ["k"], "x", probs).collect()}
    assert set(got) == set(groups)
    for k, xs in groups.items():
        assert got[k][1] == len(xs) and np.allclose(got[k][0], np.quantile(xs, probs), rtol=1e-12, atol=0)
    whole = {r["k"]: r for r in slope_area.median_iqr(df, ["k"], "x").collect()}
    assert set(whole) == {*groups, "nothing"} and whole["nothing"]["median"] is None and whole["nothing"]["n"] == 0


def test_block_solver_solves():
    rng = np.random.default_rng(1)
    c = rng.random((3, 3, 7, 5))
    c[1, 1] = -12
    b = rng.random((7, 5))
    for cc, bb in ((c, b), (c.transpose(1, 0, 3, 2), b.T)):
        assert np.abs(residual(cc, bb, solve_stencil(cc, bb))[1:-1, 1:-1]).max() < 1e-10


def test_simplex_finds_the_bottom():
    x, v = minimise(lambda p: (p[0] - 1) ** 2 + (p[1] + 2) ** 2, np.array([0.0, 0.0]), np.array([-5.0, -5.0]), np.array([5.0, 5.0]), 200, 1e-6)
    assert v < 1e-6 and x == pytest.approx([1, -2], abs=1e-2)


def test_calibration_recovers_what_made_the_surface(spark):
    base = routing.flow(grid(spark, lambda j, i: 100.0 - 3 * j + 0.01 * ((7 * i + 3 * j) % 5), 12, 9), 10.0)
    run = spark.createDataFrame([("x", "ad", 0.5, 1e-3, 1e-4, 1e-1, 0.0, 1.0)], "scenario string, model string, m double, u double, k double, d double, a_crit double, s_c double")
    made = models.solve_models(base, run, 10.0).select("tile_id", "j", "i", "z")
    cells = made.join(base.select("tile_id", "j", "i", "area", "fd"), ["tile_id", "j", "i"])
    fit = models.calibrate(cells, "ad", {"m": 0.5, "u": 1e-3, "k": 1e-5, "d": 1.0}, {"k": (1e-6, 1e-2), "d": (1e-3, 1e1)}, 10.0, rounds=80).first()
    assert fit["mse"] < 1e-3 * fit["mse_start"] and fit["mse"] < 1e-2


def test_search_converges_far_from_its_start_or_says_not():
    valley = lambda p: (1 - p[0]) ** 2 + 100 * (p[1] - p[0] ** 2) ** 2
    box = np.array([-2.0, -2.0]), np.array([2.0, 2.0])
    x, _, converged = search(valley, np.array([-1.9, 1.9]), *box, 400)
    assert converged and x == pytest.approx([1, 1], abs=1e-2)
    assert not search(valley, np.array([-1.9, 1.9]), *box, 20)[2]
    assert not search(lambda p: np.nan, np.array([0.0, 0.0]), *box, 400)[2]


def test_calibration_recovers_three_parameters_and_marks_a_short_search(spark):
    base = routing.flow(grid(spark, lambda j, i: 100.0 - 3 * j + 0.01 * ((7 * i + 3 * j) % 5), 12, 9), 10.0)
    run = spark.createDataFrame([("x", "threshold", 0.5, 1e-3, 5e-5, 2e-1, 700.0, 1.0)], "scenario string, model string, m double, u double, k double, d double, a_crit double, s_c double")
    made = models.solve_models(base, run, 10.0).select("tile_id", "j", "i", "z")
    cells = made.join(base.select("tile_id", "j", "i", "area", "fd"), ["tile_id", "j", "i"])
    start, bounds = {"m": 0.5, "u": 1e-3, "k": 1e-5, "d": 1.0, "a_crit": 300.0}, {"a_crit": (1e2, 1e4), "d": (1e-3, 1e1), "k": (1e-6, 1e-2)}
    fit = models.calibrate(cells, "threshold", start, bounds, 10.0).first()
    assert fit["status"] == "ok" and fit["mse"] < 1e-6 * fit["mse_start"]
    assert (fit["k"], fit["d"]) == pytest.approx((5e-5, 2e-1), rel=1e-2)
    assert models.calibrate(cells, "threshold", start, bounds, 10.0, rounds=20).first()["status"] == "not converged"


def test_blocks_settle_on_what_one_block_gives(spark):
    """A tile of many blocks, with holes, under each model, is what the direct solution of the whole is."""
    rough = grid(spark, lambda j, i: 100.0 - 3 * j + 0.8 * ((7 * i + 3 * j) % 5), 26, 22, holes={(7, 9), (8, 9), (20, 3)})
    cells = routing.flow(rough, 10.0).cache()
    rows = [(n, n, 0.4, 1e-3, 1e-4, 1e-1, 700.0, 0.8) for n in ("ad", "threshold", "nonlinear")]
    runs = spark.createDataFrame(rows, studies.SCENARIO)
    one, many = ({(r["scenario"], r["j"], r["i"]): (r["z"], r["status"]) for r in models.solve_models(cells, runs, 10.0, block=b).collect()} for b in (128, 12))
    assert one.keys() == many.keys() and len(one) == 3 * 26 * 22
    for k, (z, status) in one.items():
        assert status == many[k][1] == "ok" and (z is None) == (many[k][0] is None) and (z is None or z == pytest.approx(many[k][0], abs=1e-4))


def test_neighbours_across_blocks_and_beside_missing_cells(spark):
    z = grid(spark, lambda j, i: 10 * j * j + i * i, 9, 11)
    whole, cut = ({(r["j"], r["i"]): tuple(r) for r in stencil.eight_neighbours(z, block=b).collect()} for b in (256, 3))
    assert whole == cut and len(cut) == 99
    sparse = z.where("i <> 3")
    lap = at(stencil.laplacian(sparse, 1.0), "lap")
    assert lap[4, 2] is None and lap[4, 4] is None and lap[4, 6] == pytest.approx(22.0)


def test_channel_slopes_by_doubling_are_those_of_a_walk(spark):
    z = grid(spark, lambda j, i: 100.0 - j + 0.3 * ((5 * i + 3 * j) % 7), 15, 12)
    cells = routing.flow(z, 10.0).cache()
    rows = {(r["j"], r["i"]): r for r in cells.collect()}
    step = {code: (dj, di) for code, di, dj in routing.D8}
    for interval in (0.5, 3.0, 1e9):
        want = {}
        for (j, i), r in rows.items():
            at_, run = (j, i), 0.0
            while rows[at_]["fd"] is not None and r["z"] - rows[at_]["z"] < interval:
                dj, di = step[rows[at_]["fd"]]
                at_, run = (at_[0] + dj, at_[1] + di), run + 10.0 * math.hypot(dj, di)
            if run and r["area"] >= 200:
                want[j, i] = pytest.approx((r["z"] - rows[at_]["z"]) / run)
        assert at(routing.channel_slope_by_drop(cells, 10.0, interval, 200.0), "slope") == want


def test_failed_runs_have_a_status(spark):
    cells = grid(spark, lambda j, i: 1.0, 4, 4).withColumn("area", F.lit(1.0)).withColumn("fd", F.lit(4))
    run = spark.createDataFrame([("x", "ad", 0.5, 0.0, 0.0, 0.0, 0.0, 1.0)], "scenario string, model string, m double, u double, k double, d double, a_crit double, s_c double")
    out = models.solve_models(cells, run, 10.0).collect()
    assert len(out) == 16 and {r["status"] for r in out} != {"ok"} and all(r["z"] is None for r in out)


def test_planform_refuses_even_width(spark):
    bad = spark.createDataFrame([("s", 10, 9, 1.0, 1.0, 0.0)], "scenario string, nx int, ny int, dx double, dy double, a_top double")
    with pytest.raises(Exception, match="odd"):
        planform.planform(bad).count()


def test_georeference_falls_back(spark):
    df = spark.createDataFrame([([0.0, 5.0, 0.0, 100.0, 0.0, -5.0], None), (None, 3.0), (None, None)], "gt array<double>, dx double")
    x, y = grids.spacing(F.col("gt"), F.col("dx"))
    assert [tuple(r) for r in df.select(x, y).collect()] == [(5.0, 5.0), (3.0, 3.0), (None, None)]


def test_cells_round_trip_and_export(spark, sf_dir, tmp_path):
    cells = grids.matrix_cells(spark, sf_dir)
    grids.write_cells(cells, str(tmp_path / "cells"))
    back = grids.read_cells(spark, str(tmp_path / "cells"), ["t1"])
    assert back.count() == cells.where("tile_id = 't1'").count()
    grids.write_cells(cells, str(tmp_path / "blocks"), block=16)
    part = grids.read_cells(spark, str(tmp_path / "blocks"), ["t1"], window=(16, 32, 0, 16))
    scan = part._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(j,16)" in scan and "PartitionFilters: [" in scan
    assert sorted((r["j"], r["i"], r["z"]) for r in part.collect()) == sorted((r["j"], r["i"], r["z"]) for r in back.collect() if 16 <= r["j"] < 32 and r["i"] < 16)
    studies.export_runs(grids.run_results(spark, sf_dir).limit(10), str(tmp_path / "csv"))
    assert spark.read.csv(str(tmp_path / "csv"), header=True).count() == 10


def test_parameters(spark):
    p = grids.params(spark).where("region = 'AP' AND tile = 1").first()
    assert p["k0"] == pytest.approx(5.5e-5 / 138.555)


def test_empty_grid(spark):
    empty = grid(spark, lambda j, i: 0.0, 0, 0)
    assert stencil.slope_magnitude(empty).count() == 0 and routing.d8_direction(empty, 1.0).count() == 0 and resample.zoom(empty, 0.5, 0.5).count() == 0


def lowest_ways_out(z):
    """By a heap over the whole tile: how high water has to stand at each cell to leave."""
    out = {}
    near = lambda c: [(c[0] + dj, c[1] + di) for dj in (-1, 0, 1) for di in (-1, 0, 1) if dj or di]
    heap = [(v, c) for c, v in z.items() if any(n not in z for n in near(c))]
    heapq.heapify(heap)
    while heap:
        level, cell = heapq.heappop(heap)
        if cell not in out:
            out[cell] = level
            for n in near(cell):
                if n in z and n not in out:
                    heapq.heappush(heap, (max(level, z[n]), n))
    return out


def rough_grid(spark, ny, nx, steps, seed, holes=0):
    """Levels are few, so there are flats and ties; a border of NULL or missing cells inside at random."""
    rng = np.random.default_rng(seed)
    z = rng.integers(0, steps, (ny, nx)).astype(float)
    gone = {tuple(map(int, rng.integers(1, (ny - 1, nx - 1)))) for _ in range(holes)}
    rows = [("t", j, i, None if (j, i) in gone else float(z[j, i])) for j in range(ny) for i in range(nx) if (j, i) not in gone or (j + i) % 2]
    return spark.createDataFrame(rows, "tile_id string, j int, i int, z double"), {(j, i): float(z[j, i]) for j in range(ny) for i in range(nx) if (j, i) not in gone}


@pytest.mark.parametrize(("steps", "block", "holes"), [(4, 7, 0), (1000, 7, 5), (30, 64, 3), (3, 5, 12), (1, 6, 0)])
def test_filling_by_blocks_is_the_heap_and_every_cell_drains(spark, steps, block, holes):
    cells, z = rough_grid(spark, 23, 31, steps, steps + block, holes)
    want = lowest_ways_out(z)
    filled = drainage.fill_pits(cells, block).cache()
    assert {k: v for k, v in at(filled, "filled").items() if v is not None} == want
    flowing = drainage.filled_flow(filled.select("tile_id", "j", "i", F.col("filled").alias("z")), 1.0, block).where("z IS NOT NULL").collect()
    inner = lambda r: all((r["j"] + dj, r["i"] + di) in z for dj in (-1, 0, 1) for di in (-1, 0, 1))
    assert all(r["fd"] is not None for r in flowing if inner(r))
    assert sum(r["area"] for r in flowing if r["fd"] is None) == len(z)
    step = {code: (dj, di) for code, di, dj in routing.D8}
    for r in flowing:
        if r["fd"] is not None:
            dj, di = step[r["fd"]]
            assert want[r["j"] + dj, r["i"] + di] <= want[r["j"], r["i"]]


def test_flats_drain_to_their_outlet_away_from_higher_ground(spark):
    """A level basin with one way out in the south: flow runs down the middle, not along the walls."""
    z = grid(spark, lambda j, i: 4.0 if (j, i) == (8, 4) else 9.0 if j in (0, 8) or i in (0, 8) else 5.0, 9, 9)
    fd = at(drainage.drain_flats(routing.d8_direction(z, 1.0)), "fd")
    assert fd[7, 4] == 4 and all(fd[j, 1] == 2 for j in range(2, 6))  # south-east from the western wall
    assert all(fd[j, i] is not None for j in range(1, 8) for i in range(1, 8))


def test_raw_pits_keep_no_direction(spark):
    z = grid(spark, lambda j, i: 1.0 if (j, i) in ((4, 4), (4, 5)) else 5.0 + j)
    fd = at(drainage.drain_flats(routing.d8_direction(z, 1.0)), "fd")
    assert fd[4, 4] is None and fd[4, 5] is None


def test_surfaces_without_rows_or_known_cells(spark):
    none = spark.createDataFrame([], "tile_id string, j int, i int, z double")
    assert drainage.fill_pits(none).count() == 0 and drainage.filled_flow(none, 1.0).count() == 0
    blank = grid(spark, lambda j, i: 0.0, 3, 3, holes={(j, i) for j in range(3) for i in range(3)})
    assert set(at(drainage.fill_pits(blank), "filled").values()) == {None}


def test_rounds_of_blocks_do_not_grow_with_the_tile(spark, monkeypatch):
    """Diffusion from zero over 2 x 2 and 4 x 4 blocks against one direct solution."""
    rounds = []
    stage = models.stage
    monkeypatch.setattr(models, "stage", lambda df, name, *more: (rounds.append(name), stage(df, name, *more))[1])
    taken = []
    for n in (24, 48):
        edge = lambda j, i: j in (0, n - 1) or i in (0, n - 1)  # noqa: B023, E731
        spread = [0.0, 0.01, 0.0, 0.01, -0.04, 0.01, 0.0, 0.01, 0.0]
        rows = [("s", "t", j, i, [0.0] * 9, spread, 1e-4, 1e-2, None, edge(j, i), 0.0, False, 0.0, True) for j in range(n) for i in range(n)]
        kinds = "scenario string, tile_id string, j int, i int, flow array<double>, spread array<double>, u double, d double, s_c double, fixed boolean, value double, is_channel boolean, z double, valid boolean"
        rounds.clear()
        solved = models.relax(spark.createDataFrame(rows, kinds), 10.0, block=12, margin=2).collect()
        taken.append(rounds.count("measured"))
        fixed = np.array([[edge(j, i) for i in range(n)] for j in range(n)])
        c = np.zeros((9, n, n)) + 1e-2 * np.array(spread)[:, None, None]
        c[:, fixed], c[4, fixed] = 0.0, 1.0
        exact = solve_stencil(c.reshape(3, 3, n, n), np.where(fixed, 0.0, -1e-4))
        assert {r["status"] for r in solved} == {"ok"}
        assert max(abs(r["z"] - exact[r["j"], r["i"]]) for r in solved) < 1e-6
    assert taken[1] <= 1.5 * taken[0] and taken[1] <= 15


def test_coarse_nodes_share_their_cells(spark):
    """A bilinear surface is interpolated exactly, over a block that starts anywhere."""
    low, n, step = 13, 9, 4
    p = models.hats(low, n, step)
    nodes = (np.arange(p.shape[1]) + low // step - 1) * step
    assert np.allclose(p @ nodes, np.arange(low, low + n)) and np.allclose(p.sum(1), 1)
    assert np.allclose(models.hats(low, n, step, -1) @ nodes, np.arange(low - 1, low + n - 1))


def test_the_sweep_on_unit_cells_equals_a_run_at_each_spacing(spark, sf_dir):
    """Spacing as a key: the same steepness as resampling, filling, routing and solving with the spacing itself."""
    cells = grids.tilted_cells(spark, sf_dir).where("tile_id IN ('t0', 't1')").withColumn("z", F.when((F.col("j") != 20) | (F.col("i") > 3), F.col("z")))
    params = spark.createDataFrame([("t0", "L", 1, 1e-4, 3e-5, 1e-2, 0.4), ("t1", "L", 2, 2e-4, 5e-5, 2e-2, 0.5)], "tile_id string, location string, tile int, u double, k double, d double, theta double")
    targets = [34.0]
    rows = studies.resolution_study(cells, params, 10.0, targets, 3600.0, 10.0, ("d8", "dinf")).collect()
    got = {(r["tile"], r["dx"]): r for r in rows}
    assert len(rows) == len(got) == 2 and {r["status_d8"] for r in rows} == {"ok"}
    for t in targets:
        z = drainage.fill_pits(resample.resample(cells, 10.0, t)).select("tile_id", "j", "i", F.col("filled").alias("z"))
        flowing = studies.routed(z, t, dinf=True, filled=True)
        runs = params.selectExpr("tile_id AS scenario", "'ad' AS model", "theta AS m", "u", "k", "d", "0D AS a_crit", "1D AS s_c", "tile_id")
        surfaces = {"obs": flowing}
        for kind in ("d8", "dinf"):
            solved = models.solve_models(flowing, runs, t, kind).select("tile_id", "j", "i", "z").where("z IS NOT NULL")
            surfaces[kind] = flowing.drop("z").join(solved, ["tile_id", "j", "i"])
        for part, surface in surfaces.items():
            points = studies.channel_points(surface, t, 3600.0, 10.0).where("s > 0").join(params.select("tile_id", "tile", "theta"), "tile_id")
            for r in points.groupBy("tile").agg(F.avg(F.log10("s") + F.col("theta") * F.log10("a")).alias("c"), F.count("*").alias("n")).collect():
                mine = got[r["tile"], t]
                assert (part, mine[f"npts_{part}"]) == (part, r["n"])
                assert mine[f"ks_{part}"] == pytest.approx(10 ** r["c"], rel=1e-6)
                if part != "obs":
                    assert mine[f"ratio_{part}"] == pytest.approx(mine[f"ks_{part}"] / mine["ks_obs"])


def test_a_sweep_over_no_cells_and_odd_spacings(spark):
    none = grid(spark, lambda j, i: -j, 4, 4).where("false")
    targets = spark.createDataFrame([("t", 0, 2.0), ("t", 1, 0.0), ("t", 2, 40.0)], "tile_id string, dx_id int, dx double")
    assert resample.resample_sweep(none, 1.0, targets).count() == 0
    some = resample.resample_sweep(grid(spark, lambda j, i: -j, 4, 4), 1.0, targets).groupBy("dx_id").count().collect()
    assert {r["dx_id"]: r["count"] for r in some} == {0: 4, 2: 1}


def dinf_by_order(cells):
    """Areas as one walk over a whole tile, from high to low, then by rows."""
    rows = {(r["j"], r["i"]): r for r in cells.collect() if r["z"] is not None and r["facet"] is not None}
    area = dict.fromkeys(rows, 1.0)
    out = {}
    for r in routing.dinf_receivers(cells).collect():
        out.setdefault((r["j"], r["i"]), []).append(((r["rcv_j"], r["rcv_i"]), r["weight"]))
    for c in sorted(rows, key=lambda c: (-rows[c]["z"], c)):
        for to, weight in out.get(c, []):
            if to in area:
                area[to] += weight * area[c]
    return area


def test_dinf_area_over_blocks_equals_one_walk(spark):
    """Rough ground with holes, flats whose cells hand on in both directions, and paths along and across blocks' sides."""
    rng = np.random.default_rng(4)
    z = np.round(np.cumsum(rng.random((17, 19)), axis=0) * -2 + 3 * rng.random((17, 19)), 1)
    z[5:9, 4:12] = z[5, 4]
    ground = grid(spark, lambda j, i: z[j, i], 17, 19, holes={(3, 3), (12, 8)})
    cells = stage(routing.dinf_direction(drainage.drain_flats(routing.d8_direction(ground, 1.0)), 1.0), "directed")
    want = dinf_by_order(cells)
    for block in (4, 7, 64):
        got = at(routing.dinf_area(cells, 1.0, block), "area_dinf")
        assert {c for c, v in got.items() if v is not None} == set(want)
        assert all(got[c] == pytest.approx(v) for c, v in want.items())


def test_dinf_area_of_nothing_and_of_nodata(spark):
    none = routing.dinf_direction(grid(spark, lambda j, i: -j, 4, 4, holes={(j, i) for j in range(4) for i in range(4)}), 1.0)
    assert set(at(routing.dinf_area(none, 1.0), "area_dinf").values()) == {None}
    assert routing.dinf_area(none.where("false"), 1.0).count() == 0


def test_a_tile_whose_directions_form_a_cycle_has_a_status_and_the_others_go_on(spark):
    rows = [("bad", 0, 0, 3.0, 1), ("bad", 0, 1, 3.0, 16), ("bad", 0, 2, 4.0, 16), ("bad", 0, 3, 9.0, 64)]
    rows += [("good", 0, i, 9.0 - i, 1) for i in range(4)] + [("odd", 0, 0, 1.0, 3), ("odd", 0, 1, None, 16)]
    out = routing.given_flow(spark.createDataFrame(rows, "tile_id string, j int, i int, z double, fd int"), 2.0)
    got = {(r["tile_id"], r["i"]): (r["area"], r["status"]) for r in out.collect()}
    assert [got["good", i] for i in range(4)] == [(4.0 * (i + 1), "ok") for i in range(4)]
    assert {got["bad", i] for i in range(4)} == {(None, "flow directions form a cycle")}
    assert got["odd", 0] == (4.0, "ok") and got["odd", 1] == (None, "ok")
    slopes = routing.channel_slope_by_drop(out, 2.0, 1.0, 1.0)
    assert {r["tile_id"] for r in slopes.collect()} == {"good"}


def random_flow(spark, ny=37, nx=29, seed=3):
    """Filled, routed cells of a random surface that falls to the south, with a hole, and their pointers in Python."""
    rng = np.random.default_rng(seed)
    z = 500.0 - 1.5 * np.arange(ny)[:, None] + rng.random((ny, nx)) * 4
    cells = stage(drainage.fill_pits(grid(spark, lambda j, i: z[j, i], ny, nx, holes={(20, 11), (9, 9)})).select("tile_id", "j", "i", F.col("filled").alias("z")), "random")
    flowing = stage(drainage.filled_flow(cells, 10.0), "random-flow")
    rows = {(r["j"], r["i"]): r for r in flowing.collect()}
    down = {}
    for (j, i), r in rows.items():
        di, dj = routing.STEP.get(r["fd"], (0, 0)) if r["z"] is not None else (0, 0)
        to = (j + dj, i + di)
        down[j, i] = (to, math.hypot(dj, di)) if (dj or di) and to in rows and rows[to]["z"] is not None else None
    return flowing, rows, down


@pytest.mark.parametrize("block", [4, 7, 64])
def test_areas_paths_and_falls_over_blocks_equal_walks(spark, block):
    flowing, rows, down = random_flow(spark)
    area = dict.fromkeys((c for c, r in rows.items() if r["z"] is not None), 0)
    for c in area:
        while c is not None:
            area[c] += 1
            c = down[c] and down[c][0]
    got = at(routing.accumulate(routing.pointed(flowing.drop("area")), 100.0, block=block), "area")
    assert got == {c: area[c] * 100.0 if c in area else None for c in rows}

    paths = {(r["j"], r["i"]): r for r in routing.channel_paths(flowing, 10.0, 0.5, block).collect()}
    edge = lambda c: c[0] in (0, 36) or c[1] in (0, 28)
    falls = {(r["j"], r["i"]): r["slope"] for r in routing.channel_slope_by_drop(flowing, 10.0, 6.0, 200.0, block).collect()}
    wanted = set()
    for c in area:
        here, unit = c, 0.0
        while not edge(here) and down[here]:
            unit += 10.0 * down[here][1] / math.sqrt(area[here] * 100.0)
            here = down[here][0]
        if edge(here):
            assert paths[c]["path"] == pytest.approx(rows[here]["z"]) and paths[c]["path_unit"] == pytest.approx(unit)
        else:
            assert paths[c]["path"] is None and paths[c]["path_unit"] is None
        here, run = c, 0.0
        while down[here] and rows[here]["z"] > rows[c]["z"] - 6.0:
            run += 10.0 * down[here][1]
            here = down[here][0]
        if area[c] >= 2 and run:
            wanted.add(c)
            assert falls[c] == pytest.approx((rows[c]["z"] - rows[here]["z"]) / run)
    assert set(falls) == wanted


@pytest.mark.parametrize("block", [2, 64])
def test_cycles_are_found_inside_and_across_blocks(spark, block):
    loop = spark.createDataFrame([("t", 0, 1, 0, 2), ("t", 0, 2, 0, 1), ("t", 0, 0, 0, 1), ("s", 0, 0, 0, 1), ("s", 0, 1, None, None)], "tile_id string, j int, i int, dn_j int, dn_i int")
    with pytest.raises(ValueError, match="cycle"):
        routing.accumulate(loop, 1.0, block=block)
    got = {(r["tile_id"], r["i"]): r["area"] for r in routing.accumulate(loop, 1.0, refuse=False, block=block).collect()}
    assert got == {("t", 0): None, ("t", 1): None, ("t", 2): None, ("s", 0): 1.0, ("s", 1): 2.0}


def static_plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_exploded_cells_are_not_broadcast(spark):
    sc = spark.createDataFrame([("s", 1e-4, 1e-5, 0.4, 1e-2, 11, 15, 10.0, 10.0, 500.0)], "scenario string, u double, k double, m double, d double, nx int, ny int, dx double, dy double, a_top double")
    assert "Broadcast" not in static_plan(models.planform_solutions(sc, False))
    cells = stage(grid(spark, lambda j, i: j + i), "cells")
    assert not [x for x in static_plan(resample.resample(cells, 10.0, 20.0)).splitlines() if "BroadcastHashJoin" in x and "cj" in x]
    flowing = stage(routing.flow(cells, 10.0), "flowing")
    assert "Broadcast" not in static_plan(routing.channel_slope_by_drop(flowing, 10.0, 5.0, 100.0))


def test_scenarios_for_tiles_are_not_limited(spark, monkeypatch):
    monkeypatch.setattr(models, "MAX_SCENARIOS", 1)
    z = grid(spark, lambda j, i: 100.0 - j, 6, 5)
    cells = stage(routing.flow(z.unionByName(z.withColumn("tile_id", F.lit("r"))), 10.0), "flowing")
    rows = [(f"{t}{n}", "ad", 0.5, 1e-4, 1e-5, 1e-2 * n, 0.0, 1.0, t) for t in "tr" for n in (1, 2)]
    solved = models.solve_models(cells, spark.createDataFrame(rows, studies.SCENARIO + ", tile_id string"), 10.0)
    assert {(r["scenario"], r["tile_id"]): r["count"] for r in solved.where("status = 'ok'").groupBy("scenario", "tile_id").count().collect()} == {(r[0], r[-1]): 30 for r in rows}
    with pytest.raises(ValueError, match="scenarios"):
        models.solve_models(cells, spark.createDataFrame([r[:-1] for r in rows], studies.SCENARIO), 10.0)


def test_zoom_meets_its_sql_on_a_tile_cut_short(spark, tmp_path):
    from oracle import same_rows

    from ridgeline.jobs.catalog import ORACLE_SQL, QUERIES

    spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").where("vec_id < 57").write.parquet(str(tmp_path / "embeddings.parquet"))
    same_rows(QUERIES["zoom_bilinear"](spark, str(tmp_path)), ORACLE_SQL["zoom_bilinear"], str(tmp_path))


def test_fixed_exponent_fit_equals_two_passes(spark):
    rng = np.random.default_rng(5)
    a, s = 10 ** rng.uniform(2, 6, 200), 10 ** rng.uniform(-3, -1, 200)
    fit = slope_area.fit_fixed(spark.createDataFrame([("g", float(x), float(y)) for x, y in zip(a, s, strict=True)], "grp string, a double, s double"), ["grp"], 0.45).first()
    v, y = np.log10(s) + 0.45 * np.log10(a), np.log10(s)
    assert fit["ks"] == pytest.approx(10 ** v.mean()) and fit["r2"] == pytest.approx(1 - ((v - v.mean()) ** 2).sum() / ((y - y.mean()) ** 2).sum())


def test_dinf_directions_are_found_once_and_followed_without_joins_of_edges(spark):
    cells = routing.dinf_direction(routing.flow(grid(spark, lambda j, i: 50.0 - j + 0.3 * ((5 * i + 3 * j) % 7), 12, 11), 1.0), 1.0)
    plan = static_plan(routing.dinf_area(cells, 1.0))
    assert "Window" not in plan and plan.count("SortMergeJoin") == 1


def test_both_flows_take_one_look_and_one_pass(spark, monkeypatch):
    """Directions and areas of both routings as found one after another, over blocks that exchange what crosses and in one block; an
    advection-diffusion run, which has no channels, is checked without their paths."""
    rng = np.random.default_rng(6)
    z = np.round(np.cumsum(rng.random((15, 13)), axis=0) * -2 + 2 * rng.random((15, 13)), 2)
    ground = stage(grid(spark, lambda j, i: z[j, i], 15, 13, holes={(3, 3), (9, 8)}), "ground")
    apart = stage(routing.dinf_direction(routing.flow(ground, 1.0), 1.0), "apart")
    shares, looks, look = dinf_by_order(apart), [], routing.eight_neighbours
    monkeypatch.setattr(routing, "eight_neighbours", lambda *a, **b: (looks.append(1), look(*a, **b))[1])
    for block in (4, 64):
        both = routing.both_flows(ground, 1.0, block)
        got = {(r["j"], r["i"]): r for r in both.collect()}
        assert len(got) == 15 * 13 and {c for c, r in got.items() if r["area_dinf"] is not None} == set(shares)
        assert all(r["area_dinf"] == pytest.approx(shares[c]) for c, r in got.items() if c in shares)
        for c in ("fd", "area", "facet", "r"):
            assert {k: r[c] for k, r in got.items()} == at(apart, c)
    assert len(looks) == 2
    looks.clear()
    cells = studies.routed(ground, 1.0, dinf=True)
    assert len(looks) == 1 and "Join" not in static_plan(cells)
    monkeypatch.setattr(routing, "dinf_channel_paths", None)
    runs = spark.createDataFrame([("r", "ad", 0.45, 1e-4, 1e-5, 1e-2, 2000.0, 1.27)], studies.SCENARIO)
    rest = catalog.left_over(models.solve_models(cells, runs, 10.0, "dinf"), cells, runs, "dinf").where("NOT is_boundary").select("rest").collect()
    assert len(rest) == 13 * 11 and all(r["rest"] is None or abs(r["rest"]) < 1e-8 for r in rest)


@pytest.mark.parametrize("holes", [(), {(2, 3)}, {(0, 2), (2, 4)}])
def test_outlet_inside_moves_to_the_first_valid_end(spark, holes):
    rows = [("t", j, i, 1.0, 9.0 if (j, i) == (3, 2) else 2.0) for j in range(6) for i in range(5) if (j, i) not in holes] + [("none", 0, 0, None, None)]
    cells = spark.createDataFrame(rows, "tile_id string, j int, i int, z double, area double")
    got = routing.perimeter_outlet(cells)
    assert [tuple(r) for r in got.collect()] == [("t", 5 if (0, 2) in holes else 0, 2)]


def test_dinf_channels_are_those_of_a_plain_queue():
    """Both elevations from one queue, against a walk with each slope by itself."""
    rng = np.random.default_rng(9)
    facet, r, slope = rng.integers(-1, 8, (14, 11)), rng.random((14, 11)) * math.pi / 4, rng.random((14, 11))
    slope[4, 4] = np.inf
    start = np.full((14, 11), np.nan)
    start[-1], start[:, 0], start[7, 6] = rng.random(11), rng.random(14), 2.0

    def walk(s):
        out = {c: v for c, v in np.ndenumerate(start) if np.isfinite(v)}
        queue = list(out)
        for at_ in queue:
            for cell, n in np.ndenumerate(facet):
                if n < 0 or cell in out or not np.isfinite(slope[cell]):
                    continue
                a, b = ((cell[0] + routing.STEP[k][1], cell[1] + routing.STEP[k][0]) for k in routing.FACETS[n][:2])
                if at_ not in (a, b):
                    continue
                if a in out and b in out:
                    out[cell] = out[a] + (s * slope[cell] - (out[a] - out[b]) * math.sin(r[cell])) / math.cos(r[cell])
                else:
                    out[cell] = out[a] + s * slope[cell] if a in out else out[b] + s * slope[cell] * math.sqrt(2)
                queue.append(cell)
        return out

    for got, s in zip(routing.dinf_channels(facet, r, slope, start, 1.0), (0.0, 1.0), strict=True):
        want = walk(s)
        assert {c for c, v in np.ndenumerate(got) if np.isfinite(v)} == set(want) and all(got[c] == pytest.approx(v) for c, v in want.items())


def test_rows_stay_narrow_until_a_tile_is_solved(spark, monkeypatch):
    """What is shuffled for a tile of one block holds no stencils and isn't multiplied by runs; a calibration's neither."""
    staged, stage = {}, models.stage
    monkeypatch.setattr(models, "stage", lambda df, name, *more: staged.setdefault(name, stage(df, name, *more)))
    cells = stage(routing.flow(grid(spark, lambda j, i: 100.0 - 3 * j + 0.01 * ((7 * i + 3 * j) % 5), 12, 9), 10.0), "cells")
    runs = spark.createDataFrame([(f"r{n}", "threshold", 0.5, 1e-3, 5e-5, 0.1 * n, 700.0, 1.0) for n in range(1, 12)], studies.SCENARIO)
    solved = models.solve_models(cells, runs, 10.0)
    assert {r["count"] for r in solved.where("status = 'ok'").groupBy("scenario").count().collect()} == {108} and solved.count() == 11 * 108
    assert staged["prepared"].count() == 108 and not [t for _, t in staged["prepared"].dtypes if "array" in t]
    assert max(r["deal"] for r in staged["tile-runs"].collect()) == 1
    plan = static_plan(models.calibrate(cells, "threshold", {"m": 0.5, "u": 1e-3, "k": 1e-5, "d": 1.0, "a_crit": 300.0}, {"a_crit": (1e2, 1e4)}, 10.0))
    assert "spread" not in plan and "flow#" not in plan


@pytest.mark.parametrize("shape", [(9, 6), (6, 9), (1, 5)])
def test_one_elimination_serves_every_right_side(shape):
    rng = np.random.default_rng(7)
    c = -rng.random((3, 3, *shape))
    c[1, 1] = 10.0
    solve = factor_stencil(c)
    for b in rng.random((3, *shape)):
        assert np.abs(residual(c, b, solve(b))).max() < 1e-12


def test_a_critical_slope_eliminates_once(monkeypatch):
    made, factored = [], models.factored
    monkeypatch.setattr(models, "factored", lambda *a: (made.append(1), factored(*a))[1])
    g = {"valid": np.ones((8, 7), bool), "fd": np.full((8, 7), 4), "z": np.zeros((8, 7))}
    g |= models.stencils(g, 10.0, "d8")
    edge = np.ones((8, 7), bool)
    edge[1:-1, 1:-1] = False
    g |= {"fixed": edge, "value": np.zeros((8, 7)), "u": np.full((8, 7), 1e-4), "d": np.full((8, 7), 1e-2)}
    z, settled = models.solve_block(g | {"flow": None}, 0.8, 10.0)
    assert settled and len(made) == 1 and z[3, 3] > z[1, 1] > 0
    slope = models.side_slope(z, g["valid"], 10.0)
    d = g["d"] / (1 - np.clip(slope / 0.8, -0.99, 0.99) ** 2)
    assert np.abs(residual(d * g["spread"], -g["u"], z)[~edge]).max() < 1e-8


PLANFORM_KINDS = "scenario string, u double, k double, m double, d double, nx int, ny int, dx double, dy double, a_top double"


def planforms(spark):
    return spark.createDataFrame([(f"s{n}", 1e-4, 1e-5 * (1 + n % 3), 0.4, 1e-2, 7 + 2 * (n % 3), 6 + n % 5, 10.0, 8.0, 100.0 * n) for n in range(12)], PLANFORM_KINDS)


@pytest.mark.parametrize("shape", [(5, 9), (9, 5)])
def test_many_systems_are_solved_as_each_by_itself(shape):
    rng = np.random.default_rng(6)
    c, b = rng.random((5, 4, *shape)), rng.random((4, *shape))
    c[2] += 5
    together = solve_crosses(c, b)
    for n in range(4):
        nine = np.zeros((9, *shape))
        nine[[1, 3, 4, 5, 7]] = c[:, n]
        assert np.allclose(together[n], solve_stencil(nine.reshape(3, 3, *shape), b[n]))


@pytest.mark.parametrize("no_flux", [False, True])
def test_planforms_need_no_group_each_and_meet_their_written_equations(spark, no_flux):
    sc = planforms(spark)
    solved = models.planform_solutions(sc, no_flux)
    assert "GroupsInPandas" not in static_plan(solved)
    key = lambda r: (r["scenario"], r["j"], r["i"])
    equations = models.planform_system(sc, no_flux)
    want = {key(r): r["z"] for r in models.relax(equations.drop("area"), 1.0).collect()}
    areas = {key(r): r["area"] for r in equations.select("scenario", "j", "i", "area").collect()}
    got = {key(r): r for r in solved.collect()}
    assert got.keys() == want.keys() and {r["status"] for r in got.values()} == {"ok"}
    assert all(r["z"] == pytest.approx(want[c], abs=1e-9) and r["area"] == areas[c] for c, r in got.items())


def test_a_planform_that_cannot_be_solved_has_a_status_and_those_of_its_shape_go_on(spark):
    sc = planforms(spark).where("scenario IN ('s0', 's1')").withColumn("nx", F.lit(7)).withColumn("ny", F.lit(6))
    sc = sc.withColumns({c: F.when(F.col("scenario") == "s0", 0.0).otherwise(F.col(c)) for c in ("k", "d")})
    rows = models.planform_solutions(sc, False).groupBy("scenario", F.col("status") == "ok").agg(F.count("*"), F.count("z")).collect()
    assert {tuple(r) for r in rows} == {("s0", False, 42, 0), ("s1", True, 42, 42)}


def test_curves_of_many_scenarios_shuffle_and_group_nothing_by_scenario(spark):
    sc = stage(planforms(spark), "scenarios")
    plan = static_plan(studies.peclet_curves(sc))
    assert not [x for x in ("Window", "Join", "Aggregate", "GroupsInPandas") if x in plan]
    assert "Exchange" not in static_plan(studies.peclet_curves(sc, profiles=lambda s: s.withColumns({c: F.transform(F.sequence(F.lit(0), "ny"), lambda j: -1.0 * j) for c in models.PROFILES})))


def test_curves_are_those_of_the_cells_also_for_larger_planforms(spark):
    """Medians, fits and quartiles from the solved cells themselves; with blocks of 8 cells the same profiles come from blocks."""
    sc = planforms(spark)
    got = {r["scenario"]: r for r in studies.peclet_curves(sc, min_points=3).collect()}
    cells = {flag: {(r["scenario"], r["j"], r["i"]): r for r in models.planform_solutions(sc, flag).collect()} for flag in (False, True)}
    for p in sc.collect():
        name, ci, over = p["scenario"], p["nx"] // 2, p["u"] / p["k"]
        rows = range(int(np.floor(0.2 * p["ny"])), int(np.ceil((1 - 0.2) * p["ny"])))
        z = lambda j, i: cells[False][name, j, i]["z"]  # noqa: B023, E731
        lap = [(z(j, ci + 1) - 2 * z(j, ci) + z(j, ci - 1)) / p["dx"] ** 2 + (z(j + 1, ci) - 2 * z(j, ci) + z(j - 1, ci)) / p["dy"] ** 2 for j in rows]
        assert got[name]["ks_curvature"] == pytest.approx(np.median([1 + p["d"] / p["k"] * x / over for x in lap]))
        line = [cells[True][name, j, ci] for j in range(p["ny"])]
        s, a = np.array([(line[j]["z"] - line[j + 1]["z"]) / p["dy"] for j in rows]), np.array([line[j]["area"] for j in rows])
        s, a = s[s > 0], a[s > 0]
        v, y = np.log10(s) + p["m"] * np.log10(a), np.log10(s)
        assert got[name]["n_fit"] == len(s) >= 3 and got[name]["ks_fit"] == pytest.approx(10 ** v.mean() / over)
        assert got[name]["r2_fit"] == pytest.approx(1 - ((v - v.mean()) ** 2).sum() / ((y - y.mean()) ** 2).sum())
        assert [got[name][c] for c in ("ks_q25", "ks_local", "ks_q75")] == pytest.approx(list(np.quantile(s * a ** p["m"], (0.25, 0.5, 0.75)) / over))
    few = sc.where("scenario IN ('s0', 's5')")
    for r in studies.peclet_curves(few, profiles=lambda s: models.planform_profiles(s, block=8)).collect():
        assert [r[c] for c in ("ks_curvature", "ks_fit", "ks_local")] == pytest.approx([got[r["scenario"]][c] for c in ("ks_curvature", "ks_fit", "ks_local")], rel=1e-4)
    flat = studies.peclet_curves(few, profiles=lambda s: s.withColumns({c: F.array_repeat(F.lit(1.0), F.col("ny")) for c in models.PROFILES})).collect()
    assert {(r["n_fit"], r["ks_fit"], r["ks_local"], r["ks_curvature"]) for r in flat} == {(None, None, None, 1.0)}


def test_packs_are_whole_groups_also_across_batches(spark):
    """Groups of 1 to 40 rows in batches of 7: each is seen once and whole, with others if it is small."""
    rows = spark.range(400).selectExpr("id", "cast(cast(sqrt(id * 4) as int) as string) AS tile_id", "cast(id % 2 as int) AS b")
    sizes = lambda part: part.groupby(["tile_id", "b"]).agg(n=("id", "size"), total=("id", "sum")).reset_index().assign(calls=len(part))
    was = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = in_packs(rows, ["tile_id", "b"], sizes, "tile_id string, b int, n int, total long, calls int", least=30).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", was)
    want = {(r[0], r[1]): (r[2], r[3]) for r in rows.groupBy("tile_id", "b").agg(F.count("*"), F.sum("id")).collect()}
    assert len(got) == len(want) and {(r["tile_id"], r["b"]): (r["n"], r["total"]) for r in got} == want
    assert sum(r["calls"] > r["n"] for r in got) > len(got) // 2


def test_small_tiles_share_a_call(spark, monkeypatch):
    """What follows paths, fills and solves tiles of one block gets many of them together, and gives what each alone gives."""
    ground = lambda n: grid(spark, lambda j, i: 50.0 - j + 0.4 * ((5 * i + (3 + n) * j) % 7), 8 + n, 9, holes={(3, n)})
    tiles = [ground(n).withColumn("tile_id", F.lit(f"t{n}")) for n in range(3)]
    every = stage(tiles[0].unionByName(tiles[1]).unionByName(tiles[2]), "ground")
    runs = spark.createDataFrame([("r", "ad", 0.4, 1e-4, 1e-5, 1e-2, 0.0, 1.0), ("s", "ad", 0.5, 1e-4, 2e-5, 1e-2, 0.0, 1.0)], studies.SCENARIO)

    def study(cells):
        filled = stage(drainage.fill_pits(cells).select("tile_id", "j", "i", F.col("filled").alias("z")), "filled")
        flowing = stage(studies.routed(filled, 10.0, True, filled=True), "flowing")
        slopes = routing.channel_slope_by_drop(flowing, 10.0, 2.0, 200.0)
        solved = models.solve_models(flowing, runs, 10.0, "dinf")
        return {("z", *r[:4]): r[4:] for r in solved.select("scenario", "tile_id", "j", "i", "z", "status").collect()} | {(r[0], r[1], r[2]): r[3:] for r in slopes.collect()} | {("a", r["tile_id"], r["j"], r["i"]): (r["area"], r["area_dinf"]) for r in flowing.collect()}

    plans, kept = [], models.stage
    for module in (drainage, routing):
        monkeypatch.setattr(module, "stage", lambda df, name, *a: (plans.append(static_plan(df)) if name in ("flooded", "counted", "walks", "dinf-round") else None, kept(df, name, *a))[1])
    together = study(every)
    assert len(plans) >= 4 and not [p for p in plans if "GroupsInPandas" in p]
    one_by_one = {}
    for tile in tiles:
        one_by_one |= study(stage(tile, "tile"))
    assert together.keys() == one_by_one.keys()
    for key, values in one_by_one.items():
        for a, b in zip(together[key], values, strict=True):
            assert a == b or a == pytest.approx(b, rel=1e-9)


@pytest.mark.parametrize("shape", [(5, 9), (9, 5)])
def test_linear_systems_of_a_shape_are_eliminated_together_and_one_that_fails_is_alone(monkeypatch, shape):
    rng = np.random.default_rng(7)
    c, b = rng.random((3, 3, 4, *shape)), rng.random((4, *shape))
    c[1, 1] += 9
    together = solve_stencils(c, b)
    assert all(np.allclose(together[n], solve_stencil(c[:, :, n], b[n])) for n in range(4))
    systems, calls = [], []
    for n in range(4):
        fixed = np.zeros(shape, bool)
        fixed[0], fixed[-1], fixed[:, 0], fixed[2, 2] = True, True, True, True
        systems.append({"fixed": fixed, "value": rng.random(shape), "u": np.full(shape, 1e-3), "d": np.full(shape, float(n != 2)), "flow": None, "spread": c[:, :, n]})
    monkeypatch.setattr(models, "solve_stencils", lambda c, b: (calls.append(c.shape[2]), solve_stencils(c, b))[1])
    solved = models.solve_linears(systems)
    assert calls == [4] and [status == "ok" for _, status in solved] == [True, True, False, True] and np.isnan(solved[2][0]).all()
    for n in (0, 1, 3):
        assert np.allclose(solved[n][0], models.solve_linear(systems[n], systems[n]["d"]))


def test_spacings_join_squares_not_corners(spark):
    """A grid's cells meet the elevations once, and nothing is grouped by them afterwards."""
    cells = stage(grid(spark, lambda j, i: j + i), "cells")
    plan = static_plan(resample.resample(cells, 10.0, 20.0))
    above = plan[: plan.index("SortMergeJoin")]
    assert "Aggregate" not in above and "Window" not in plan


@pytest.mark.parametrize(
    ("f", "start", "want"),
    [(lambda x: (x - 0.345) ** 2, -3.0, 0.345), (lambda x: abs(x + 7.9), 0.0, -7.9), (lambda x: x, 0.0, -8.0), (lambda x: -x, 0.5, 1.0), (lambda x: (x + 8) ** 2, -8.0, -8.0),
     (lambda x: 1 - math.exp(-((x + 5) ** 2)), -3.0, -5.0), (lambda x: math.nan if x > -2 else (x + 3) ** 2, -2.5, -3.0)],
)
def test_a_line_search_finds_the_bottom_inside_and_at_the_ends_of_its_box(f, start, want):
    met = []
    x, value, converged = search_line(lambda p: (met.append(p[0]), f(p[0]))[1], start, -8.0, 1.0, 400)
    assert converged and x[0] == pytest.approx(want, abs=1e-4) and value == f(x[0])
    assert len(met) < 30 and -8 <= min(met) and max(met) <= 1
    assert not search_line(lambda p: f(p[0]), start, -8.0, 1.0, 3)[2] and not search_line(lambda p: math.nan, start, -8.0, 1.0, 400)[2]


def rough_tile(seed):
    """Prepared cells of a tile that no model fits exactly."""
    rng = np.random.default_rng(seed)
    ny, nx = 9, 8
    edge = np.ones((ny, nx), bool)
    edge[1:-1, 1:-1] = False
    z = 100 - 3.0 * np.indices((ny, nx))[0] + rng.random((ny, nx))
    g = {"z": z, "valid": np.ones((ny, nx), bool), "drive": 100.0 * rng.integers(1, 20, (ny, nx)), "fd": np.full((ny, nx), 4.0), "is_boundary": edge, "edge_outlet": edge & False}
    return g | models.stencils(g, 10.0, "d8")


@pytest.mark.parametrize("bounds", [{"k": (1e-7, 1e-3), "d": (1e-4, 1e1)}, {"k": (1e-5, 1e-4), "d": (1e-2, 3e-2)}, {"d": (1e-4, 1e1), "m": (0.2, 0.8), "k": (1e-7, 1e-3)}])
def test_fitting_by_ratio_is_as_good_as_a_search_over_both_and_eliminates_less(monkeypatch, bounds):
    base = {"m": 0.45, "u": 1e-3, "k": 1e-5, "d": 1e-2, "a_crit": 0.0, "s_c": 1.0}
    g = rough_tile(3)
    loss = lambda p: float(np.mean((models.solve_block(models.posed(g, base | {"model": "ad"} | p), None, 10.0)[0] - g["z"]) ** 2))
    low, high = (np.log10([bounds[n][e] for n in bounds]) for e in (0, 1))
    calls, factored = [], models.factored
    monkeypatch.setattr(models, "factored", lambda *a: (calls.append(1), factored(*a))[1])
    start = np.clip(np.log10([base[n] for n in bounds]), low, high)
    _, want, _ = search(lambda x: loss(dict(zip(bounds, 10.0**x, strict=True))), start, low, high, 400)
    before = len(calls)
    found, value, first, converged = models.search_ratio(g, base, bounds, 400)
    assert converged and first == pytest.approx(loss(dict(zip(bounds, 10.0**start, strict=True))))
    assert value == pytest.approx(loss(found), rel=1e-6) and value <= want * (1 + 1e-4)
    assert all(a * (1 - 1e-9) <= found[n] <= b * (1 + 1e-9) for n, (a, b) in bounds.items())
    assert len(bounds) > 2 or len(calls) - before < 35
    assert bounds != {"k": (1e-7, 1e-3), "d": (1e-4, 1e1)} or before > 60  # a narrow box ends both soon
