"""Known answers and metamorphic checks of the library's own operators."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from strataq.functions.expressions import compile_expression
from strataq.functions.units import convert
from strataq.operators import checks as C
from strataq.operators import graph as G
from strataq.operators import joins as J
from strataq.operators import scoring as S
from strataq.operators import windows as W
from strataq.storage import Store


def row(df):
    (r,) = df.collect()
    return r


def test_finite_and_bounds(spark):
    df = spark.createDataFrame([("a", 0, "1", "9"), ("a", 1, "2", "8"), ("b", 0, "3", "7")], "g string, t int, x string, y string")
    r = row(C.run(df, [C.NumericCheck("f", "finite", ("x", "y"), ("g",), "t")]))
    assert (r.comparison_count, r.group_count, r.passed) == (6, 2, True)
    df = spark.createDataFrame([(-2.0,)] * 7 + [(12.0,)], "x double")
    r = row(C.run(df, [C.NumericCheck("b", "bounds", ("x",), lower=0.0, upper=10.0, tolerance=0.5)]))
    assert (r.violation_count, r.observed_worst_violation, r.worst_excess, r.passed) == (8, 2.0, 1.5, False)
    assert C.examples(df, C.NumericCheck("b", "bounds", ("x",), lower=0.0, upper=10.0, tolerance=0.5), ["x"]).count() == 5


@pytest.mark.parametrize("tolerance,passed", [(0.125, True), (0.0625, False)])
def test_conservation(spark, tolerance, passed):
    df = spark.createDataFrame([(-0.125, 10.125), (1.0, 9.125)], "x double, y double")
    r = row(C.run(df, [C.NumericCheck("s", "sum_conservation", ("x", "y"), reference_value=10.0, tolerance=tolerance)]))
    assert r.passed is passed and r.observed_worst_violation == 0.125


def test_monotonic_compares_with_the_running_extreme(spark):
    df = spark.createDataFrame([(0, 1.0), (1, 0.875), (2, 0.75)], "t int, x double")
    up = C.NumericCheck("m", "monotonic", ("x",), time_column="t", direction="increasing", tolerance=0.125)
    assert row(C.run(df, [up])).observed_worst_violation == 0.25 and not row(C.run(df, [up])).passed
    assert row(C.run(df, [C.NumericCheck("m", "monotonic", ("x",), time_column="t", direction="decreasing", tolerance=0.125)])).passed
    with pytest.raises(ValueError):
        C.require(C.run(df, [up]))


def test_filters_select_or_fail(spark):
    df = spark.createDataFrame([("small", 2.0, 8.0), ("large", 3.0, 17.0)], "k string, x double, y double")
    make = lambda v: C.NumericCheck("s", "sum_conservation", ("x", "y"), row_filters=(("k", v),), reference_value=10.0)
    r = row(C.run(df, [make("small")]))
    assert r.selected_row_count == 1 and r.passed and not row(C.run(df, [make("absent")])).passed
    with pytest.raises(ValueError):
        C.NumericCheck("m", "monotonic", ("x",))


@pytest.mark.parametrize(
    "left,right,expect",
    [
        (["a", "a", "a", "b"], ["a"] * 4, dict(cardinality="many_to_many", output_rows=12, blowup=3.0, max_fanout_product=12, risk="high")),
        (["a", "b", "c", "d"], ["a", "z"], dict(left_unmatched_fraction=0.75, right_unmatched_fraction=0.5, matched_keys=1, reasons="majority_unmatched")),
        (["a", "b"], ["a", "b"], dict(cardinality="one_to_one", risk="low", reasons="")),
        (["Station12", None], ["station12 "], dict(matched_keys=0, near_misses=1, near_shown=["station12 "], risk="blocked", left_blank=1)),
    ],
)
def test_join_risk(spark, left, right, expect):
    l, r = (spark.createDataFrame([(x,) for x in v], "k string") for v in (left, right))
    got = row(J.join_risk(l, r, "k", "k")).asDict()
    assert {k: got[k] for k in expect} == expect


def test_join_risk_type_mismatch(spark):
    got = row(J.join_risk(spark.createDataFrame([(12,)], "k int"), spark.createDataFrame([("12",)], "k string"), "k", "k"))
    assert got.risk == "blocked" and "key_type_mismatch" in got.reasons


def test_entities(spark):
    make = lambda *names: spark.createDataFrame([(f"{i}", n) for i, n in enumerate(names)], "id string, name string")
    left = make("Riverside Weather Station", "Acme, Inc.", "Quite Other")
    right = make("Riverside Weather Station North", "Riverside Weather Station South", "ACME inc", "Nothing Alike")
    got = {r.left_id: r for r in J.align_entities(left, right).collect()}
    assert (got["0"].status, got["1"].status, got["1"].best_id, got["2"].status) == ("ambiguous", "matched", "2", "unmatched")
    twice = J.align_entities(make("Station 12", "Station-12"), make("station 12")).collect()
    assert {r.status for r in twice} == {"ambiguous"}


def test_crps_of_a_point_mass_is_the_absolute_error(spark):
    df = spark.createDataFrame([(1, 3.0, 5.0)] * 4, "o int, x double, y double")
    assert row(S.crps(df, "o", "x", "y")).crps == pytest.approx(2.0)


def test_interpolation_clamps_and_resamples(spark):
    s = spark.createDataFrame([(1, 0.0, 0.0), (1, 10.0, 20.0)], "k int, t double, v double")
    at = spark.createDataFrame([(1, -5.0, 1), (1, 2.5, 2), (1, 10.0, 3), (1, 99.0, 4), (2, 0.0, 5)], "k int, t double, id long")
    assert {r.id: r.y for r in J.interpolate(s, at, ["k"]).collect()} == {1: 0.0, 2: 5.0, 3: 20.0, 4: 20.0, 5: None}


def test_interpolate_in_buckets_equals_plain_search(spark, capsys):
    rng = np.random.default_rng(5)
    points = [(k, float(t), None if i % 9 == 0 else float(v)) for k in ("a", "b", None) for i, (t, v) in enumerate(zip(rng.integers(0, 400, 40) ** 2 / 4, rng.normal(size=40)))]
    points += [("a", None, 7.0), ("c", 5.0, None)]
    spots = [(k, float(t), i) for i, (k, t) in enumerate((k, t) for k in ("a", "b", "c", None) for t in range(-500, 41000, 977))]
    want = {}
    for k, t, i in spots:
        held = sorted((a, v) for x, a, v in points if x == k and a is not None and v is not None)
        p, q = [x for x in held if x[0] <= t], [x for x in held if x[0] > t]
        late = [(a, v) for x, a, v in points if x == k and a is None and v is not None]
        if p and q:
            want[i] = p[-1][1] + (q[0][1] - p[-1][1]) / (q[0][0] - p[-1][0]) * (t - p[-1][0])
        else:
            want[i] = p[-1][1] if p else q[0][1] if q else late[0][1] if late else None
    s, at = spark.createDataFrame(points, "k string, t double, v double"), spark.createDataFrame(spots, "k string, t double, id long")
    for bucket in (None, 100.0, 5000.0):
        out = J.interpolate(s, at, ["k"], bucket)
        assert {r.id: r.y for r in out.collect()} == pytest.approx(want), bucket
        out.explain()
        assert "unboundedfollowing" not in capsys.readouterr().out  # such a frame takes the square of the rows


def test_zero_crossings_do_not_depend_on_the_order_of_rows(spark, tmp_path):
    from strataq.plans import QUERIES, SQL
    from .oracle import assert_same, connect

    rng = np.random.default_rng(11)
    rows = []
    for user in range(300):  # the mean is 0.7, one of the values: the last bits of the sum decide
        x = rng.integers(1, 70, 20) / 100
        for k, v in enumerate(rng.permutation([*x, *(np.round(1.4 - x, 2)), 0.7, 0.7]).tolist()):
            rows.append((len(rows), k, user, v))
    want = tmp_path / "a"
    spark.createDataFrame(rows, "event_id long, k int, user_id long, value double").selectExpr("event_id", "timestamp_seconds(k) AS ts", "user_id", "value").toPandas().to_parquet(f"{tmp_path}/events.parquet", coerce_timestamps="us")
    want.mkdir()
    spark.read.parquet(f"{tmp_path}/events.parquet").orderBy(F.desc("event_id")).write.parquet(f"{want}/events.parquet")
    assert_same(QUERIES["zero_crossings"](spark, str(want)), connect(str(tmp_path)), SQL["zero_crossings"])


def test_mean_shift_and_isotonic():
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(0, 1, 200), rng.normal(3, 1, 200)])
    assert any(abs(c - 200) <= 2 for c in W.segments(x))
    assert W.pava(np.array([0.45, 0.70, 0.30]), np.ones(3)).tolist() == pytest.approx([0.575, 0.575, 0.30])


def test_kendall(spark):
    df = spark.createDataFrame([(1, i, v) for i, v in enumerate([1.0, 3.0, 2.0, 4.0])], "k int, t int, v double")
    assert row(W.kendall(df, "k", "t", "v")).tau == pytest.approx(4 / 6)


def test_star_and_triangle(spark):
    e = spark.createDataFrame([(0, i) for i in range(1, 5)] + [(7, 8), (8, 9), (7, 9)], "a long, b long")
    assert {r.node: r.degree for r in G.degrees(e).collect()}[0] == 4
    c = {r.node: r.clustering for r in G.clustering(e).collect()}
    assert c[0] == 0.0 and c[7] == 1.0 and G.triangles(e).count() == 1
    store = Store(spark, "graph")
    label = {r.node: r.label for r in G.components(e, store).collect()}
    assert {label[i] for i in range(1, 5)} == {0} and label[9] == 7
    x = {r.node: r.x for r in G.eigenvector(e.where("a = 0"), store, rounds=12).collect()}
    assert x[0] / x[1] == pytest.approx(2.0, rel=1e-3)
    assert G.k_core(e, 2, store).count() == 3


def test_long_path_components(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(60)], "a long, b long")
    assert {r.label for r in G.components(e, Store(spark, "path")).collect()} == {0}


def test_cycles(spark):
    e = spark.createDataFrame([(0, 1, 2), (1, 0, -3), (1, 2, 1), (2, 0, 1)], "src long, dst long, weight long")
    assert {(tuple(r.path), r.gain, r.polarity) for r in G.cycles(e, 3).collect()} == {((0, 1), -6, "balancing"), ((0, 1, 2), 2, "reinforcing")}


def test_expressions(spark):
    df = spark.createDataFrame([(3.0, 4.0)], "x double, y double")
    names = {"x": F.col("x"), "y": F.col("y")}
    value = lambda text: row(df.select(compile_expression(text, names).alias("v"))).v
    assert value("sqrt(x ** 2 + y ** 2)") == 5 and value("where(x < y and y < 9, min(x, y, 1), 0)") == 1 and value("-clip(y, 0, 2)") == -2
    assert value("log(y, 2)") == pytest.approx(2) and value("tanh(0 * x)") == 0
    for bad in ("__import__('os')", "x.real", "z + 1", "x if y else 1", "exp(1, 2)"):
        with pytest.raises(ValueError):
            compile_expression(bad, names)
    with pytest.raises(Exception, match="negative"):
        value("sqrt(-x)")


def test_units(spark):
    df = spark.createDataFrame([(212.0, "degF", "degC"), (1.0, "km", "m"), (1.0, "kg", "m"), (5.0, "?", "m")], "v double, u string, t string")
    got = [r.converted for r in convert(df, "v", "u", "t").orderBy("u").collect()]
    assert got[0] is None and got[1] == pytest.approx(100.0) and got[2] is None and got[3] == 1000.0


def test_results_do_not_depend_on_partitions(spark):
    df = spark.createDataFrame([(i % 7, float(i * 37 % 101), float(i % 2)) for i in range(400)], "g int, p double, y double").withColumn("p", F.col("p") / 101)
    a, b = (row(S.grouped_brier(df.repartition(n), "g")).asDict() for n in (1, 9))
    assert all(math.isclose(a[k], b[k]) for k in a)
    assert row(S.rank_auc(df.repartition(5))) == row(S.rank_auc(df.coalesce(1)))
