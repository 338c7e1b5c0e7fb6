"""Weights, masks and fits of pixels against simulation and numpy."""

from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from stackweave.operators import inversion as I
from stackweave.operators import weights as W

T = [0, 12, 24, 48, 60]
NETWORK = [(0, 1), (1, 2), (2, 3), (3, 4), (0, 2), (1, 3), (2, 4)]


@pytest.mark.parametrize("looks", [1, 5, 20])
@pytest.mark.parametrize("g", [0.0, 0.3, 0.8, 0.97])
def test_phase_variance_by_simulation(g, looks):
    r = np.random.default_rng(1)
    z = lambda: (r.normal(size=(40_000, looks)) + 1j * r.normal(size=(40_000, looks))) / np.sqrt(2)
    a, n = z(), z()
    phase = np.angle((a * np.conj(g * a + np.sqrt(1 - g * g) * n)).sum(1))
    assert W.phase_variance(np.array([g]), looks)[0] == pytest.approx((phase**2).mean(), rel=0.06)


def test_phase_density_sums_to_one():
    phase = (np.arange(4000) + 0.5) / 4000 * 2 * np.pi - np.pi
    for looks in (1, 4, 16, 32):
        p = W.phase_density(np.array([0.001, 0.4, 0.9, 0.99]), looks, phase)
        assert p.sum(1) * 2 * np.pi / 4000 == pytest.approx(1, abs=2e-3)
    g = np.array([0.5, 0.9])
    assert W.phase_variance(g, 33) == pytest.approx(W.phase_variance(g, 32), rel=0.12)  # the bound takes over


def test_weights(spark):
    rows = [(0, i, [1.0, None, 2.0], [c, 0.5, None]) for i, c in enumerate([0.0, 0.0173, 0.5, 0.777, 1.0, 1.2, -0.1])]
    d = spark.createDataFrame(rows, "row long, col long, phase array<double>, coherence array<double>")
    for kind, want in (("var", lambda c: 1 / W.phase_variance(np.array([min(max(c, 0), 1)]), 4)[0]), ("fim", lambda c: (lambda g: 8 * g * g / (1 - g * g))(min(max(c, 1e-3), 0.999))), ("coh", lambda c: min(max(c, 1e-3), 0.999)), ("no", lambda c: 1.0)):
        for r in W.weighted(d, kind, 4).collect():
            assert r["weight"][0] == pytest.approx(want(r["coherence"][0]), rel=0.01) and r["weight"][2] == 0
            assert r["phase"] == [1.0, None, None]
    with pytest.raises(ValueError):
        W.weight_of(F.lit(0.5), "other", 4)


def cells(n, seed=3):
    r = np.random.default_rng(seed)
    phase, coh = r.normal(size=(n, len(NETWORK))), r.uniform(0.05, 0.95, (n, len(NETWORK)))
    phase[r.random(phase.shape) < 0.15] = np.nan
    return [(0, i, [None if np.isnan(v) else float(v) for v in p], [float(v) for v in c]) for i, (p, c) in enumerate(zip(phase, coh))], phase, coh


@pytest.mark.parametrize("kind", ["var", "fim", "no"])
def test_weighted_inversion(spark, kind):
    rows, phase, coh = cells(30)
    d = spark.createDataFrame(rows, "row long, col long, phase array<double>, coherence array<double>")
    got = {(r["col"], r["t"]): r["value"] for r in I.invert_pixels(W.weighted(d, kind, 5), NETWORK, T, weighted=True).collect()}
    design, dt = I.rates_design(len(T), NETWORK, T), np.diff(T)
    for i in range(30):
        w = {"var": lambda c: 1 / W.phase_variance(c, 5), "fim": lambda c: 10 * c * c / (1 - c * c), "no": np.ones_like}[kind](coh[i])
        ok = ~np.isnan(phase[i])
        rate = np.linalg.lstsq(design[ok] * np.sqrt(w[ok])[:, None], phase[i][ok] * np.sqrt(w[ok]), rcond=None)[0]
        assert [got[i, t] for t in T] == pytest.approx(np.concatenate([[0], np.cumsum(rate * dt)]), abs=2e-2 if kind == "var" else 1e-8)


def test_least_absolute_inversion(spark):
    """The sum of absolute residuals is as small as that of the best solution that meets four pairs exactly."""
    r = np.random.default_rng(9)
    phase = r.normal(size=(12, len(NETWORK)))
    d = spark.createDataFrame([(0, i, [float(v) for v in p], [1.0] * 7) for i, p in enumerate(phase)], "row long, col long, phase array<double>, weight array<double>")
    got = {(x["col"], x["t"]): x["value"] for x in I.invert_pixels(d, NETWORK, T, norm="L1", iterations=60).collect()}
    design, dt = I.rates_design(len(T), NETWORK, T), np.diff(T)
    for i, y in enumerate(phase):
        loss = lambda rate: np.abs(design @ rate - y).sum()
        best = min(loss(np.linalg.solve(design[list(k)], y[list(k)])) for k in combinations(range(len(y)), 4) if abs(np.linalg.det(design[list(k)])) > 1e-9)
        own = np.diff([got[i, t] for t in T]) / dt
        assert best - 1e-9 <= loss(own) <= best * 1.01


def test_masks(spark):
    d = spark.createDataFrame([(0, i, [1.0, 2.0, None], [0.1 * i, 0.9, 0.9]) for i in range(6)], "row long, col long, phase array<double>, coherence array<double>")
    water = spark.createDataFrame([(0, i, int(i != 5)) for i in range(6)], "row long, col long, valid int")
    shadow = spark.createDataFrame([(0, i, int(i == 4)) for i in range(5)], "row long, col long, shadow int")
    assert {(r["col"], tuple(r["phase"])) for r in W.masked(d, 0.3, least=1).collect()} == {(i, (1.0 if 0.1 * i >= 0.3 else None, 2.0, None)) for i in range(6)}
    assert {r["col"] for r in W.masked(d, 0.3, water, shadow, 2).collect()} == {3}
    assert W.masked(d.limit(0), 0.3, water, shadow).count() == 0


def test_fits_without_dates(spark):
    r = np.random.default_rng(2)
    t = np.array([0, 6, 12, 18, 30, 42, 48, 60, 90], float)
    y = r.normal(size=(20, len(t)))
    y[r.random(y.shape) < 0.2] = np.nan
    y[3] = np.nan
    d = spark.createDataFrame([(1, i, [None if np.isnan(v) else float(v) for v in row]) for i, row in enumerate(y)], "row long, col long, values array<double>")
    terms = dict(poly=1, periods=[0.2], steps=[20], exps=[(6, 10)], logs=[(12, 5)])
    names, design = I.time_functions(t, **terms)
    got = {(x["col"], x["name"]): x["coefficient"] for x in I.fit_series(d, t, start=6, end=80, exclude=[18, 42], **terms).collect()}
    use = (t >= 6) & (t <= 80) & (t != 18) & (t != 42)
    for i in range(20):
        ok = use & ~np.isnan(y[i])
        if ok.any():
            want = np.linalg.lstsq(design[ok], y[i][ok], rcond=None)[0]
            assert [got[i, n] for n in names] == pytest.approx(want, abs=1e-8)
        else:
            assert all(got[i, n] is None for n in names)


@pytest.mark.parametrize("by_velocity", [False, True])
def test_height_error(spark, by_velocity):
    r = np.random.default_rng(4)
    t = np.array([0, 12, 24, 36, 48, 60, 90, 120], float)
    bperp = r.normal(0, 80, len(t))
    scale, error = r.uniform(1e-6, 2e-6, 10), r.normal(0, 20, 10)
    calm = np.outer(r.normal(size=10), t / 365.25) + np.outer(r.normal(size=10), t >= 40)
    y = calm + np.outer(error * scale, bperp)
    y[:, 3] += 5  # left out of the fit
    rows = [(0, i, [float(v) for v in y[i]], float(scale[i])) for i in range(10)] + [(1, 0, [float(v) for v in y[0]], 0.0), (1, 1, [float(v) for v in y[0]], None)]
    got = {(x["row"], x["col"]): x for x in I.without_height_error(spark.createDataFrame(rows, "row long, col long, values array<double>, scale double"), t, bperp, poly=1, steps=[40], exclude=[36], by_velocity=by_velocity).collect()}
    for i in range(10):
        assert got[0, i]["height_error"] == pytest.approx(error[i], rel=1e-5)
        assert got[0, i]["values"] == pytest.approx(y[i] - error[i] * scale[i] * bperp, abs=1e-7)
    for i in range(2):
        assert got[1, i]["values"] == pytest.approx(y[0]) and (got[1, i]["height_error"] is None or np.isnan(got[1, i]["height_error"]))


def test_nearest_valid(spark):
    r = np.random.default_rng(6)
    cells = {(int(i), int(j)): float(r.random()) for i, j in r.integers(-200, 200, (400, 2))}
    q = spark.createDataFrame([(*k, v) for k, v in cells.items()], "row long, col long, quality double")
    for row, col in [(0.4, 0.2), (-500.0, 3.0), (77.7, -60.1)]:
        want = min((((i - row) ** 2 + (j - col) ** 2, i, j) for (i, j), v in cells.items() if v >= 0.6))
        assert I.nearest_valid(q, row, col, 0.6) == want[1:]
    assert I.nearest_valid(q, 0, 0, 2.0) is None
    with pytest.raises(ValueError):
        I.to_reference_place(q.withColumn("t", F.lit(0)).withColumn("value", F.lit(1.0)), q, {"x0": 0.0, "y0": 0.0, "dx": 1.0, "dy": 1.0}, 0, 0, 2.0)


@pytest.mark.parametrize("given", [{}, {"row": 1, "col": 2}])
def test_reference_leaves_pixels_where_they_are(spark, given):
    """A date's few reference values go to the pixels: no pixel is brought together with all others of its date."""
    ts = spark.range(60).selectExpr("id % 5 AS row", "id DIV 5 % 4 AS col", "id DIV 20 AS t", "CAST(id AS DOUBLE) AS value")
    got = I.to_reference_point(ts, ts.where("t = 0").selectExpr("row", "col", "row + col AS quality"), **given)
    at = (1, 2) if given else (4, 3)
    assert {(r["row"], r["col"], r["t"]): r["value"] for r in got.collect()} == {(i, j, t): float(i - at[0] + 5 * (j - at[1])) for i in range(5) for j in range(4) for t in range(3)}
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as for tables that are too large
    try:
        plan = I.to_reference_point(ts, ts.where("t = 0").selectExpr("row", "col", "row + col AS quality"), **given)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert "SortMergeJoin" not in plan and "hashpartitioning(t" not in plan


def test_pixels_are_summed_after_they_are_spread(spark):
    """No task that reads a file keeps a table of its pixels: the scan's stage ends in an exchange, the sum comes after it."""
    from stackweave.plans import pixels

    from .oracle import FOLDER

    plan = pixels.series(spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" in plan and "Exchange" in plan and "HashAggregate" not in plan.split("Exchange", 1)[1]


def test_height_only_where_correlated(spark):
    r = np.random.default_rng(7)
    h = r.uniform(0, 100, 300)
    rows = [(i, 0, t, float(h[i]), float(0.5 * h[i] + r.normal()) if t == 1 else float(r.normal())) for i in range(300) for t in (1, 2)]
    d = spark.createDataFrame(rows, "row long, col long, t long, h double, value double")
    got = {(x["row"], x["t"]): x["value"] for x in I.without_height(d, "h", least=0.5).collect()}
    want = {(i, t): v for i, _, t, _, v in rows}
    assert all(got[i, 2] == want[i, 2] for i in range(300))
    fit = np.polyfit(h, [want[i, 1] for i in range(300)], 1)
    assert [got[i, 1] for i in range(300)] == pytest.approx([want[i, 1] - np.polyval(fit, h[i]) for i in range(300)], abs=1e-6)
    assert len(got) == 600


@pytest.mark.parametrize("most", [200_000, 3])
def test_closure_ambiguities(spark, monkeypatch, most):
    """Both ways, by place and by joins, against brute force: missing and repeated phases, pixels without a triplet."""
    monkeypatch.setattr(I, "TRIPLETS", most)
    r = np.random.default_rng(9)
    net = [(i, j) for i in range(7) for j in range(i + 1, min(7, i + 4))]
    rows, phase = [], {}
    for p in range(40):
        for i, j in net:
            v = float((j - i) * 0.1 + 2 * np.pi * (r.random() < 0.2) * (p % 3))
            kind = r.random()
            if p == 39 and j - i == 1 or kind < 0.05:
                continue
            rows.append((p, p % 4, i, j, [v, None, float("nan")][0 if kind > 0.15 else 1 + (kind > 0.1)]))
            if kind > 0.15:
                phase[p, i, j] = v
            if kind > 0.95:
                rows.append((p, p % 4, i, j, v + 50.0))
    ifg = spark.createDataFrame(rows, "row long, col long, ref long, sec long, phase double")
    want = {}
    for p in range(40):
        turns = [round((phase[p, i, j] + phase[p, j, k] - phase[p, i, k]) / (2 * np.pi)) for i, j in net for k in range(j + 1, 7) if (p, i, j) in phase and (p, j, k) in phase and (p, i, k) in phase]
        if turns:
            want[p, p % 4] = (len(turns), sum(x != 0 for x in turns))
    got = {(x["row"], x["col"]): (x["n_triplets"], x["n_ambiguous"]) for x in I.closure_ambiguities(ifg, ifg.select("ref", "sec")).collect()}
    assert got == want and 0 < len(want) < 40 and any(b for _, b in want.values())
    assert I.closure_ambiguities(ifg.limit(0), ifg.select("ref", "sec")).count() == I.closure_ambiguities(ifg, ifg.select("ref", "sec").limit(0)).count() == 0
