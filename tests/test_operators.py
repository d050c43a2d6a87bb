"""Operators that SQL cannot express, against plain Python on small fixtures."""

import itertools
import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from strataq.functions.expressions import compile_expression
from strataq.functions.units import expression_dimension, parse_dimension, same_dimension, spell
from strataq.operators import archive, calibration, causal, constraints, dynamics, estimation, fitting, ordered, records, simulation, windows
from strataq.operators import graph as G
from strataq.operators.joins import clock_findings, pareto
from strataq.storage import Store


@pytest.fixture(scope="module")
def net(spark):
    rng = random.Random(3)
    pairs = {tuple(sorted(rng.sample(range(40), 2))) for _ in range(70)}
    pairs |= {(100 + i, 101 + i) for i in range(12)} | set(itertools.combinations(range(200, 206), 2))
    return pairs, spark.createDataFrame(sorted(pairs), "a long, b long")


def near(pairs):
    out = {}
    for a, b in pairs:
        out.setdefault(a, set()).add(b)
        out.setdefault(b, set()).add(a)
    return out


def distances(n, s):
    seen, front = {s: 0}, [s]
    while front:
        front = [y for x in front for y in n[x] if y not in seen and not seen.update({y: seen[x] + 1})]
    return seen


def test_paths_core_and_removal(spark, net):
    pairs, e = net
    n = near(pairs)
    sources = spark.createDataFrame([(0,), (100,), (203,)], "node long")
    got = {(r.source, r.node): r.distance for r in G.path_lengths(e, sources, spark).collect()}
    assert got == {(s, x): d for s in (0, 100, 203) if s in n for x, d in distances(n, s).items() if d}
    live = set(pairs)
    while weak := {x for x, y in near(live).items() if len(y) < 3}:
        live = {p for p in live if not weak & set(p)}
    assert {tuple(r) for r in G.k_core(e, 3, Store(spark, "t")).select("a", "b").collect()} == live
    gone = spark.createDataFrame([(0,), (203,)], "node long")
    assert {tuple(r) for r in G.remove_nodes(e, gone).select("a", "b").collect()} == {p for p in pairs if not {0, 203} & set(p)}


def test_betweenness_and_communities(spark, net):
    pairs, e = net
    n = near(pairs)
    want = Counter()
    for s in n:  # dependencies by counting shortest paths of every pair
        d = distances(n, s)
        ways = {s: 1}
        for x in sorted(d, key=d.get):
            for y in n[x]:
                if d[y] == d[x] + 1:
                    ways[y] = ways.get(y, 0) + ways[x]
        owed = Counter()
        for x in sorted(d, key=lambda z: -d[z]):
            for y in n[x]:
                if d[y] == d[x] + 1:
                    owed[x] += ways[x] / ways[y] * (1 + owed[y])
        for x in d:
            if x != s:
                want[x] += owed[x] / 2
    got = {r.node: r.betweenness for r in G.betweenness(e, spark.createDataFrame([(x,) for x in n], "node long")).collect()}
    assert got == pytest.approx({x: v for x, v in want.items() if v > 0})
    by_levels = {r.node: r.betweenness for r in G.betweenness(e, spark.createDataFrame([(x,) for x in n], "node long"), most_edges=10).collect()}
    assert by_levels == pytest.approx(got)
    label = {x: x for x in n}
    for _ in range(20):
        new = {}
        for x in n:
            votes = Counter([label[y] for y in n[x]] + [label[x]])
            new[x] = min(votes, key=lambda c: (-votes[c], c))
        if new == label:
            break
        label = new
    assert {r.node: r.community for r in G.label_propagation(e, spark).collect()} == label
    x = dict.fromkeys(n, 1.0)
    for _ in range(8):
        x = {v: x[v] + sum(x[y] for y in n[v]) for v in n}
        total = sum(x.values())
        x = {v: k / total for v, k in x.items()}
    assert {r.node: r.x for r in G.eigenvector(e, Store(spark, "t"), rounds=8).collect()} == pytest.approx(x)


def test_components_of_ordered_and_shuffled_paths(spark):
    rng = random.Random(8)
    names = rng.sample(range(10_000, 20_000), 300)
    pairs = [(i, i + 1) for i in range(300)] + list(zip(names, names[1:])) + [(50_000 - i, 50_001 - i) for i in range(80)] + [(7, 7), (None, 3)]
    store = Store(spark, "t")
    got = {r.node: r.label for r in G.components(spark.createDataFrame(pairs, "a long, b long"), store).collect()}
    assert got == {**dict.fromkeys(range(301), 0), **dict.fromkeys(names, min(names)), **dict.fromkeys(range(49_921, 50_002), 49_921)}
    assert store.n < 60


def test_cycles_and_topology(spark):
    edges = [(1, 2), (2, 3), (3, 1), (3, 4), (4, 5), (6, 6), (7, 8), (8, 7), (5, 7)]
    assert {r.node for r in G.on_cycles(spark.createDataFrame(edges, "src long, dst long"), spark).collect()} == {1, 2, 3, 6, 7, 8}
    nodes = spark.createDataFrame([("in", True, False), ("a", False, False), ("b", False, False), ("out", False, True), ("lost", False, False)], "id string, is_entry boolean, is_terminal boolean")
    rows = [("in", "a", 1.0, 1, 1), ("a", "b", 0.5, 40, 2), ("b", "a", 0.5, 1, 1), ("b", "out", 0.7, None, 1), ("lost", "lost", 0.0, None, 1)]
    found = {(r.rule, r.item) for r in G.validate_topology(nodes, spark.createDataFrame(rows, "src string, dst string, probability double, max_traversals int, attempts int"), spark).collect()}
    assert found == {("unreachable", "lost"), ("cannot_end", "lost"), ("unbounded_cycle", "lost"), ("loop_budget", "a"), ("probability_mass", "b"), ("probability_mass", "lost")}


def test_ordered_sums_quantiles_and_lags(spark):
    rng = random.Random(1)
    rows = [(rng.choice("ab"), float(rng.choice([rng.randint(0, 9), rng.random() * 1e6])), i, rng.randint(0, 50_000)) for i in range(900)]
    df = spark.createDataFrame(rows, "g string, v double, i long, t long").repartition(5)
    got = {r.g: r for r in ordered.quantiles(df, "v", {"a": 0.0, "b": 0.37, "c": 1.0}, ["g"]).collect()}
    for g in "ab":
        x = np.array([r[1] for r in rows if r[0] == g])
        assert (got[g].a, got[g].b, got[g].c) == pytest.approx(tuple(np.quantile(x, [0, 0.37, 1])))
    ranks = {r.v: r["rank"] for r in ordered.average_ranks(df, "v").collect()}
    every = sorted(r[1] for r in rows)
    assert all(ranks[v] == (every.index(v) + 1 + len(every) - every[::-1].index(v)) / 2 for v in set(every))
    seen = {r.i: r.p for r in ordered.lagged(df, ["g"], "t", ["i"], {"p": "v"}, bucket=700).collect()}
    for g in "ab":
        s = sorted((r for r in rows if r[0] == g), key=lambda r: (r[3], r[2]))
        assert [seen[r[2]] for r in s] == [None, *[r[1] for r in s[:-1]]]
    assert ordered.quantiles(df.limit(0), "v", {"a": 0.5}, ["g"]).count() == 0


def test_segments_by_exhaustive_search():
    rng = np.random.default_rng(7)
    x = np.concatenate([rng.normal(0, 1, 40), rng.normal(4, 1, 30), rng.normal(4, 3, 30)])

    def cost(a, b):
        return (b - a) * math.log(max(np.var(x[a:b]), 1e-12 * max(1.0, np.var(x))))

    ends = [0, len(x)]
    while len(ends) < 7:
        best = max(((cost(a, b) - cost(a, k) - cost(k, b), -k) for a, b in zip(ends, ends[1:]) for k in range(a + 5, b - 4)), default=(0, 0))
        if best[0] <= 3 * math.log(len(x)):
            break
        ends = sorted([*ends, -best[1]])
    assert windows.segments(x) == ends[1:-1] and len(ends) > 3
    assert windows.segments(np.zeros(3)) == [] and len(windows.segments(rng.normal(0, 1, 400) + np.repeat(np.arange(8) * 9, 50))) == 5


def test_archive_admission_one_by_one(spark):
    rng = random.Random(4)
    rows = [(i, rng.choice("xy"), i, rng.random() > 0.1, float(rng.randint(0, 9)), float(rng.randint(0, 9))) for i in range(120)]
    spec = [("p", 0.0, 9.0, "maximize", 1.0), ("q", 0.0, 9.0, "minimize", 2.0)]
    got = {r.id: (r.outcome, r.kept) for r in archive.admit(spark.createDataFrame(rows, "id long, cell string, added long, feasible boolean, p double, q double"), spec, capacity=10**6).collect()}
    fronts, want = {}, {}
    for i, cell, _, ok, p, q in rows:
        f = fronts.setdefault(cell, [])
        better = lambda a, b: a[1] >= b[1] and a[2] <= b[2] and (a[1] > b[1] or a[2] < b[2])
        me = (i, p, q)
        if not ok:
            want[i] = "infeasible"
        elif any(better(m, me) for m in f):
            want[i] = "dominated_rejected"
        else:
            want[i] = "new_cell" if not f else "dominates_existing" if any(better(me, m) for m in f) else "nondominated_added"
            fronts[cell] = [m for m in f if not better(me, m)] + [me]
    kept = {m[0] for f in fronts.values() for m in f}
    assert got == {i: (o, i in kept) for i, o in want.items()}
    small = archive.admit(spark.createDataFrame(rows, "id long, cell string, added long, feasible boolean, p double, q double"), spec, capacity=2).where("kept").groupBy("cell").count().collect()
    assert all(r["count"] <= 2 for r in small)


def test_recalibration_and_sparse_regression(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=800)
    y = (rng.random(800) < 1 / (1 + np.exp(-(0.4 + 1.7 * x)))).astype(float)
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y)], "x double, y double")
    beta, design = np.zeros(2), np.column_stack([np.ones_like(x), x])
    for _ in range(25):
        p = 1 / (1 + np.exp(-design @ beta))
        w = np.clip(p * (1 - p), 1e-6, None)
        beta = beta + np.linalg.solve(design.T @ (design * w[:, None]) + 1e-6 * np.eye(2), design.T @ (y - p))
    assert calibration.platt(df, "x", "y") == pytest.approx(tuple(beta), abs=1e-6)
    data = spark.createDataFrame([(float(a), float(a * a), float(a**3), float(1.5 * a - 0.5 * a**3)) for a in x], "a double, b double, c double, d double")
    got = estimation.stlsq(data, ["a", "b", "c"], "d")
    assert got["terms"] == ["a", "c"] and got["beta"] == pytest.approx([1.5, 0, -0.5], abs=1e-8) and "b" not in got["equation"]
    fit = estimation.least_squares(data, ["a", "b"], "d")
    want, rss, *_ = np.linalg.lstsq(np.column_stack([np.ones_like(x), x, x * x]), 1.5 * x - 0.5 * x**3, rcond=None)
    assert fit["beta"] == pytest.approx(want) and fit["rss"] == pytest.approx(rss[0])
    twice = data.withColumn("e", F.col("a") * 2)
    assert estimation.identifiability(estimation.least_squares(twice, ["a", "e"], "d"))["verdict"] == "not_identifiable"
    assert estimation.identifiability(fit)["verdict"] == "identifiable"


def test_designs_and_sensitivity(spark):
    d = estimation.morris_design(spark, 3, 20).orderBy("trajectory", "step").collect()
    assert len(d) == 80
    for a, b in zip(d, d[1:]):
        if a.trajectory == b.trajectory:
            moved = [j for j in range(3) if a[f"x{j}"] != b[f"x{j}"]]
            assert moved == [b.changed] and b[f"x{moved[0]}"] - a[f"x{moved[0]}"] == pytest.approx(2 / 3)
    assert all(0 <= r[f"x{j}"] <= 1 for r in d for j in range(3))
    runs = estimation.sobol_design(spark, 3, 6000).withColumn("y", estimation.ishigami(F.col("x0"), F.col("x1"), F.col("x2")))
    got = {r.factor: (r.first_order, r.total) for r in estimation.sobol_indices(runs).collect()}
    for j, want in enumerate([(0.3139, 0.5576), (0.4424, 0.4424), (0.0, 0.2437)]):
        assert got[j] == pytest.approx(want, abs=0.06)


def test_simulations(spark):
    start = spark.createDataFrame([("s", 0, 1.0, 3.0), ("t", 1, 0.0, 2.0)], "scenario string, replicate long, x double, level double")
    out = simulation.integrate(start, ["x"], lambda t, x, r: np.array([0.5 * (r["level"] - x[0])]), 30, 0.1).where("step = 30").collect()
    assert {r.scenario: r.x for r in out} == pytest.approx({"s": 3 - 2 * math.exp(-1.5), "t": 2 - 2 * math.exp(-1.5)}, abs=1e-6)
    rng = random.Random(2)
    t, rows = 0.0, []
    for i in range(60):
        t += rng.expovariate(1)
        rows.append(("q", i, t, rng.expovariate(1.1)))
    got = {r.i: r.wait for r in simulation.single_server(spark.createDataFrame(rows, "k string, i long, at double, service double"), "k", "i", "at", "service").collect()}
    free = 0.0
    for _, i, at, s in rows:
        assert got[i] == pytest.approx(max(0.0, free - at), abs=1e-9)
        free = max(free, at) + s
    edges = [(a, b) for a in range(30) for b in range(30) if a != b and (a * 7 + b * 3) % 11 < 2]
    e, seeds = spark.createDataFrame(edges, "src long, dst long"), spark.createDataFrame([(0,), (1,)], "node long")
    active = {0: 0, 1: 0}
    for k in range(1, 7):
        hits = Counter(b for a, b in edges if a in active)
        active |= {x: k for x, c in hits.items() if c >= 2 and x not in active}
    assert {r.node: r.step for r in simulation.cascade(e, seeds, spark, 6, threshold=2).collect()} == active
    again = [sorted(tuple(r) for r in simulation.cascade(e.repartition(n), seeds, spark, 4, replicates=3, hazard=0.3).collect()) for n in (1, 4)]
    assert again[0] == again[1] and len(again[0]) > 6
    x = {0: 0.5, 1: 0.9}
    pull = simulation.influence(spark.createDataFrame([(0, 0.5, 0.1), (1, 0.9, 0.0)], "node long, x double, drift double"), spark.createDataFrame([(1, 0, 0.5)], "src long, dst long, weight double"), 1, spark, noise=0.0)
    new = {r.node: r.x for r in pull.where("step = 1").collect()}
    assert new == pytest.approx({0: 1 / (1 + math.exp(-4 * (0.5 * (x[1] - 0.5) + 0.1))), 1: 0.5})


def test_projection_reaches_the_constraints(spark):
    rules = [{"id": "b", "kind": "bounds", "columns": ["x", "y", "z"], "lower": 0.0, "upper": 5.0}, {"id": "s", "kind": "symmetry", "pairs": [("x", "y")]}, {"id": "c", "kind": "conservation", "columns": ["x", "y", "z"], "total": 6.0}, {"id": "m", "kind": "stoichiometry", "columns": ["x", "y", "z"], "matrix": [[1.0, 0.0, -1.0]], "totals": [0.0]}]
    rng = random.Random(9)
    df = spark.createDataFrame([(i, *[rng.uniform(-2, 8) for _ in range(3)]) for i in range(20)], "i long, x double, y double, z double")
    out = constraints.project(df, ["x", "y", "z"], rules, passes=200).collect()
    assert all((r.x, r.y, r.z) == pytest.approx((2, 2, 2), abs=1e-5) and r.left < 1e-5 for r in out)
    free = constraints.project(df, ["x", "y", "z"], []).collect()
    assert all(r.moved == 0 for r in free)


def test_units_and_bounds_of_expressions(spark):
    assert parse_dimension("mass/(length*time^2)") == {"mass": 1, "length": -1, "time": -2} and spell({}) == "dimensionless"
    assert same_dimension("mass*length/time^2", "length*mass*time^-2") and not same_dimension("length", "time")
    assert expression_dimension("where(v > w, v * t, x)", {"v": "length/time", "w": "length/time", "t": "time", "x": "length"}) == "length"
    for bad in ("v + t", "exp(v)", "v ** 0.5"):
        with pytest.raises(ValueError):
            expression_dimension(bad, {"v": "length/time", "t": "time"})
    one = spark.createDataFrame([(2.0, -1.0)], "a double, b double")
    names = {"a": F.col("a"), "b": F.col("b")}
    assert one.select(compile_expression("log(a, 2) + a ** 3", names).alias("x")).first().x == pytest.approx(9)
    for bad in ("a ** 65", "b ** 0.5", "(a - 2) ** b", "log(a, 1)", "clip(a, 3, 1)"):
        with pytest.raises(Exception):
            one.select(compile_expression(bad, names).alias("x")).collect()


def test_records_and_clocks(spark):
    scene = '{"frames": [{"time": 1, "agents": [{"id": "p", "x": 1.5, "y": 2}, {"id": "q", "x": 0, "y": 0}]}, {"time": 2, "agents": []}]}'
    rows = records.load_scene(spark.createDataFrame([(7, scene), (8, "not json")], "k long, s string"), "k", "s").collect()
    assert [(r.k, r.time, r.id, r.x) for r in rows] == [(7, 1.0, "p", 1.5), (7, 1.0, "q", 0.0)]
    twice = spark.createDataFrame([(1, "a", 0.0), (1, "a", 1.0)], "f long, a string, x double")
    with pytest.raises(Exception, match="twice"):
        records.scene_frames(twice, "f", "a", ["x"]).collect()
    utc = spark.createDataFrame([(3600 * i, 0) for i in range(9)], "t long, zone int")
    found = {r.finding: r.seconds for r in clock_findings(utc, spark.createDataFrame([(3600 * i - 19800, 19800) for i in range(9)], "t long, zone int")).collect()}
    assert found["suspected_clock_shift"] == -19800.0 and "declared_timezone_mismatch" in found
    assert clock_findings(utc, utc).count() == 0
    points = [(i, float(i % 7), float(i * 3 % 11)) for i in range(60)]
    front = pareto(spark.createDataFrame(points, "i long, x double, y double").repartition(6), ["i"], "x", "y")
    assert {r.i for r in front.collect()} == {i for i, x, y in points if not any(a >= x and b >= y and (a > x or b > y) for _, a, b in points)}


def open_path(edges, x, y, given):
    """Separation by all undirected paths and the rules at their inner nodes."""
    given = set(given)
    under = {n: causal.below(edges, {n}) for e in edges for n in e}

    def walk(path):
        at = path[-1]
        if at == y:
            yield path
            return
        for a, b in edges:
            for here, there in ((a, b), (b, a)):
                if here == at and there not in path:
                    yield from walk([*path, there])

    for path in walk([x]):
        ok = True
        for a, m, b in zip(path, path[1:], path[2:]):
            collider = (a, m) in edges and (b, m) in edges
            ok &= bool(under[m] & given) if collider else m not in given
        if ok:
            return True
    return False


def test_separation_and_adjustment():
    rng = random.Random(6)
    for _ in range(25):
        names = "abcdef"
        edges = [(x, y) for x, y in itertools.combinations(names, 2) if rng.random() < 0.4]
        if not edges:
            continue
        inside = sorted({n for e in edges for n in e})
        for x, y in itertools.combinations(inside, 2):
            z = [n for n in inside if n not in (x, y) and rng.random() < 0.4]
            assert causal.separated(edges, x, y, z) == (not open_path(edges, x, y, z)), (edges, x, y, z)
    assert causal.acyclic([("a", "b"), ("b", "c")]) and not causal.acyclic([("a", "b"), ("b", "a")])
    confounded = [("u", "x"), ("u", "y"), ("x", "y")]
    assert causal.backdoor_sets(confounded, "x", "y", ["u"]) == [("u",)] and causal.identifiable(confounded, "x", "y", []) == ("not_identifiable", [])
    assert causal.identifiable([("u", "x"), ("u", "y"), ("x", "m"), ("m", "y")], "x", "y", ["m"]) == ("frontdoor", ["m"])
    assert causal.identifiable([*confounded, ("z", "x")], "x", "y", ["z"]) == ("requires_stronger_assumptions", ["z"])
    assert ("b", "c", ("a",)) in causal.implications([("a", "b"), ("a", "c")], ["a", "b", "c"])


def test_known_systems(spark):
    x = [0.3]
    for _ in range(900):
        x.append(4 * x[-1] * (1 - x[-1]))
    assert dynamics.rosenstein(np.array(x), horizon=6) == pytest.approx(math.log(2), abs=0.25)
    t = np.arange(700) * 0.1
    wave = np.sin(t) + 0.5 * np.sin(2.1 * t)
    assert abs(dynamics.rosenstein(wave, lag=8, dimension=4, apart=40)) < 0.1
    df = spark.createDataFrame([("w", i, float(v)) for i, v in enumerate(wave)] + [("s", 0, 1.0)], "k string, i long, v double")
    got = {r.series: r for r in dynamics.attractor(df, "k", "i", "v").collect()}
    assert 2 <= got["w"].dimension <= 5 and got["w"].false_share < 0.05 and got["s"].n == 1
    assert dynamics.spectrum_class(np.array([-1 + 2j, -1 - 2j])) == ("focus", True) and dynamics.spectrum_class(np.array([1.0, -1.0])) == ("saddle", False)


def test_bounded_fits_against_known_curves(spark):
    xs = np.linspace(0, 3, 25)
    curve = lambda p: p[0] * F.exp(-p[1] * F.col("x"))
    rows = [("clean", float(x), 5 * math.exp(-0.8 * x), 0.5) for x in xs] + [("held", float(x), 5 * math.exp(-3.0 * x), 1.0) for x in xs] + [("clean", 1.0, None, 1.0), (None, 1.0, 9.0, 1.0)]
    got = fitting.bounded_fits(spark.createDataFrame(rows, "g string, x double, y double, s double"), "g", curve, "y", [1.0, 0.1], [0.0, 0.0], [50.0, 2.0], "s")
    assert set(got) == {"clean", "held"} and all(f["converged"] and f["n"] == 25 for f in got.values())
    assert np.allclose(got["clean"]["theta_hat"], [5, 0.8], atol=1e-5) and got["clean"]["at_bound"] == [False, False]
    basis = np.exp(-2.0 * xs)
    best = (basis * 5 * np.exp(-3.0 * xs)).sum() / (basis**2).sum()
    assert np.allclose(got["held"]["theta_hat"], [best, 2.0], atol=1e-5) and got["held"]["at_bound"] == [False, True]
    stopped = fitting.bounded_fits(spark.createDataFrame(rows, "g string, x double, y double, s double"), "g", curve, "y", [1.0, 0.1], [0.0, 0.0], [50.0, 2.0], "s", rounds=1)
    assert all(f["theta_hat"] is None and not f["converged"] for f in stopped.values())
    assert fitting.bounded_fits(spark.createDataFrame([], "g string, x double, y double"), "g", curve, "y", [1.0, 0.1], [0.0, 0.0], [50.0, 2.0]) == {}
    with pytest.raises(ValueError):
        fitting.bounded_fits(spark.createDataFrame(rows, "g string, x double, y double, s double"), "g", curve, "y", [99.0, 0.1], [0.0, 0.0], [50.0, 2.0])
