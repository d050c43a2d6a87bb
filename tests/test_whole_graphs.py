"""Graph queries over all rows of lineitem, against brute force on small fixtures."""

import itertools
import random

import pytest

from strataq import plans


@pytest.fixture(scope="module")
def lines():
    """(order, line number, part, supplier, quantity, discount): orders of one to four lines of all quantities."""
    rnd = random.Random(5)
    rows = [(o, k, rnd.randint(1, 60), rnd.randint(1, 40), float(rnd.randint(1, 50)), rnd.randint(0, 10) / 100) for o in range(60) for k in range(1, rnd.randint(2, 5))]
    return rows + [(1000 + i, k, 500 + i + k, 1, 1.0, 0.0) for i in range(60) for k in (0, 1)]  # a long chain of parts


@pytest.fixture(scope="module")
def folder(spark, lines, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("graphs"))
    names = "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double, l_discount double"
    spark.createDataFrame(lines, names).write.parquet(f"{d}/lineitem.parquet")
    return d


def linked(lines, k):
    """Ordered pairs of different values of field ``k`` that share an order."""
    return {(a[k], b[k]) for a in lines for b in lines if a[0] == b[0] and a[k] != b[k]}


def test_components_of_all_lines(spark, folder, lines):
    pairs = linked(lines, 2)
    label = {a: a for a, _ in pairs}
    while any(label[a] > label[b] for a, b in pairs):
        for a, b in pairs:
            label[a] = min(label[a], label[b])
    got = plans.QUERIES["components"](spark, folder).collect()
    assert sorted((r.node, r.label) for r in got) == sorted(label.items())
    assert len(set(label.values())) > 1 and sum(x == 500 for x in label.values()) == 61


def test_feedback_loops_of_all_lines(spark, folder, lines):
    cents = {}
    for _, _, p, s, _, x in lines:
        if s % 12 != p % 12:
            cents.setdefault((s % 12, p % 12), []).append(round(100 * x) - 5)
    sign = {k: 1 if sum(v) > 0 else -1 for k, v in cents.items()}
    want = []
    for n in (2, 3):
        for path in itertools.permutations(range(12), n):
            steps = list(zip(path, path[1:] + path[:1]))
            if path[0] == min(path) and all(k in sign for k in steps):
                gain = 1
                for k in steps:
                    gain *= sign[k]
                want.append(("-".join(map(str, path)), gain, "balancing" if gain < 0 else "reinforcing"))
    assert want and sorted((r.loop, r.gain, r.polarity) for r in plans.QUERIES["feedback_loops"](spark, folder).collect()) == sorted(want)


def test_part_graph_of_all_lines(spark, folder, lines):
    near = {}
    for x, y in zip(sorted(lines), sorted(lines)[1:]):  # neighbouring lines of one order
        if x[0] == y[0] and x[2] != y[2]:
            near.setdefault(x[2], set()).add(y[2])
            near.setdefault(y[2], set()).add(x[2])
    threes = {(a, b, c) for a in near for b in near[a] for c in near[a] & near[b] if a < b < c}
    run = lambda key: [tuple(r) for r in plans.QUERIES[key](spark, folder).collect()]
    assert sorted(run("triangles")) == sorted(threes) and threes
    degree = {a: len(x) for a, x in near.items()}
    for r in plans.QUERIES["clustering"](spark, folder).collect():
        n, d = sum(r.node in x for x in threes), degree[r.node]
        assert (r.degree, r.triangles) == (d, n) and r.clustering == pytest.approx(2 * n / (d * (d - 1)) if d > 1 else 0, abs=1e-6)
    (r,) = plans.QUERIES["percolation"](spark, folder).collect()
    mean, second = sum(degree.values()) / len(degree), sum(d * d for d in degree.values()) / len(degree)
    assert r.nodes == len(degree) and (r.mean_degree, r.threshold, r.molloy_reed) == pytest.approx((mean, mean / (second - mean), second / mean), abs=1e-5)
    top = sorted(degree.items(), key=lambda x: (-x[1], x[0]))[:10]
    assert sorted(run("topk_degree"), key=lambda r: r[2]) == [(n, d, k) for k, (n, d) in enumerate(top, 1)]
