"""Graphs, neighbours, interpolation and message passing."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidegrid.functions import maths
from tidegrid.operators import features, gnn, graph, layers, order, spatial, strong


def edges_of(spark, pairs, **more):
    return spark.createDataFrame([(u, v, *more.values()) for u, v in pairs] if more else pairs, "u long, v long" + "".join(f", {k} double" for k in more))


def test_parallel_edges(spark):
    df = spark.createDataFrame([(0, 1, 5.0, 0), (0, 1, 0.2, 1), (1, 1, 3.0, 0), (2, 1, None, 0), (2, 1, 1.0, 1)], "u long, v long, length double, key int")
    got = {(r.u, r.v): (r.length, r.key) for r in graph.shortest_parallel(df).collect()}
    assert got == {(0, 1): (1.0, 1), (2, 1): (1.0, 0)}


def test_grid(spark):
    nodes, edges = graph.grid(spark, 10, 4)
    got = {(r.u, r.v) for r in edges.collect()}
    want = {(i, j) for i in range(10) for dr, dc in graph.GRID_STEPS for r, c in [(i // 4 + dr, i % 4 + dc)] if r >= 0 and 0 <= c < 4 and (j := r * 4 + c) < 10}
    assert got == want and nodes.count() == 10
    assert graph.statistics(nodes, edges).first().n_components == 1


def test_components(spark):
    pairs = [(k, k + 1) for k in range(40)] + [(100, 101), (101, 102), (102, 100), (7, 7), (200, 200)]
    got = {r.node: r.component for r in graph.components(edges_of(spark, pairs)).collect()}
    assert got == {k: 0 for k in range(41)} | {100: 100, 101: 100, 102: 100}
    top = graph.largest_component(edges_of(spark, pairs)).collect()
    assert len(top) == 41 and {r.n for r in top} == {41}


def test_strong_connection(spark):
    nodes = spark.range(20).withColumnRenamed("id", "node_id")
    ring = [(k, (k + 1) % 20) for k in range(20)]
    assert graph.strongly_connected(nodes, edges_of(spark, ring))
    assert not graph.strongly_connected(nodes, edges_of(spark, ring[:-1]))


def strong_brute(pairs):
    nodes = {x for p in pairs for x in p}
    reach = {x: {x} for x in nodes}
    grown = True
    while grown:
        grown = False
        for u, v in pairs:
            for x in nodes:
                if u in reach[x] and v not in reach[x]:
                    reach[x].add(v)
                    grown = True
    return {x: min(y for y in reach[x] if x in reach[y]) for x in nodes}


@pytest.mark.parametrize("seed", range(4))
def test_strong_components(spark, seed):
    """Random graphs, with cycles on chains on cycles, mutual edges, loops and repeated edges."""
    rng = np.random.default_rng(seed)
    n = (12, 30, 40, 60)[seed]
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, n, (int(n * (1.1 + 0.3 * seed)), 2))]
    pairs += [(100, 101), (101, 102), (102, 100), (102, 103), (103, 104), (104, 105), (105, 103), (105, 106), (106, 107), (108, 108), (0, 100), (100, 101)]
    got = {r.node: r.component for r in strong.strong_components(edges_of(spark, pairs)).collect()}
    assert got == strong_brute(pairs)


@pytest.mark.parametrize("small", (0, 5, 50_000))
def test_small_weak_components_are_worked_out_in_tasks(spark, monkeypatch, small):
    """Components of few edges in tasks, others in rounds: the same components, and few tables are written where all are small."""
    rounds, written = [], strong.written
    monkeypatch.setattr(strong, "written", lambda df, name: rounds.append(name) or written(df, name))
    monkeypatch.setattr(strong, "SMALL", small)
    monkeypatch.setattr(strong, "BLOCK", 20)
    rng = np.random.default_rng(7)
    pairs = [(100 * k + int(a), 100 * k + int(b)) for k in range(12) for a, b in rng.integers(0, 3 + 2 * k, (2 + 2 * k, 2))]
    got = {r.node: r.component for r in strong.strong_components(edges_of(spark, pairs)).collect()}
    assert got == strong_brute(pairs)
    if small == 50_000:
        assert len(rounds) < 16


def test_strong_components_reads_every_order(spark, sf):
    from tidegrid.plans import catalog

    own = spark.read.parquet(f"{sf}/orders.parquet").select("o_orderkey", "o_custkey").orderBy("o_orderkey").collect()
    pairs = [(a.o_custkey, b.o_custkey) for a, b in zip(own, own[1:]) if a.o_orderkey // 4096 == b.o_orderkey // 4096]
    got = {r.node: r.component for r in catalog.QUERIES["strong_components"](spark, sf).collect()}
    assert set(got) == {x for p in pairs for x in p} and got == strong_brute(sorted(set(pairs)))


def test_large_components_come_from_ranges_and_near_labels(spark, monkeypatch):
    """Dense parts, each with one edge to the next: by ranges of nodes where ids lie together, by labels where they are mixed."""
    rounds, written = [], strong.written
    monkeypatch.setattr(strong, "written", lambda df, name: rounds.append(name) or written(df, name))
    monkeypatch.setattr(strong, "SMALL", 200)
    rng = np.random.default_rng(5)
    pairs = [(20 * k + int(a), 20 * k + int(b)) for k in range(8) for a, b in rng.integers(0, 20, (80, 2)) if a != b]
    pairs += [(20 * k + 3, 20 * k + 24) for k in range(7)] + [(500_000 + k, 500_001 + k) for k in range(5)]
    want = strong_brute(pairs)
    got = {r.node: r.component for r in strong.strong_components(edges_of(spark, pairs)).collect()}
    assert got == want and rounds.count("live") < 4
    mixed = {x: x * 7919 % 10_007 for x in want}
    back = {y: x for x, y in mixed.items()}
    into = {r.node: r.to for r in strong._near(edges_of(spark, [(mixed[u], mixed[v]) for u, v in pairs]).distinct()).collect()}
    assert all(want[back[x]] == want[back[y]] for x, y in into.items())
    assert len(into) > 10


@pytest.mark.parametrize("seed", range(3))
def test_statistics_count_weak_and_strong_components(spark, seed):
    rng = np.random.default_rng(seed)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 40, (15 + 12 * seed, 2))]
    nodes = spark.range(44).withColumnRenamed("id", "node_id")
    row = graph.statistics(nodes, edges_of(spark, pairs)).first()
    alone = 44 - len({x for p in pairs for x in p})
    both = strong_brute(pairs + [(v, u) for u, v in pairs])
    assert (row.n_components, row.n_strong_components) == (len(set(both.values())) + alone, len(set(strong_brute(pairs).values())) + alone)


def test_edges_are_dealt_by_their_number(spark, monkeypatch):
    monkeypatch.setattr(graph, "EDGE_ROWS", 10)
    assert graph.dealt(spark.range(100), 100, "id").rdd.getNumPartitions() == 10
    assert graph.dealt(spark.range(0), 0, "id").count() == 0
    parts, written = {}, graph.written
    monkeypatch.setattr(graph, "written", lambda df, name: parts.setdefault(name, df.rdd.getNumPartitions()) and written(df, name))
    edges = edges_of(spark, [(k, k + 1) for k in range(100)] * 2)
    got = {r.node: r.hop for r in graph.k_hop(spark.createDataFrame([(50,)], "node long"), edges, 3).collect()}
    assert got == {50: 0, 49: 1, 48: 2, 47: 3} and parts["links"] == 20
    assert graph.components(edges, rows=200).agg({"component": "max"}).first()[0] == 0 and parts["wcc"] == 20


def test_long_chains_and_cycles_take_few_rounds(spark, monkeypatch):
    rounds, written = [], strong.written
    monkeypatch.setattr(strong, "written", lambda df, name: rounds.append(name) or written(df, name))
    pairs = [(k, k + 1) for k in range(1, 400)] + [(1000 + k, 1000 + (k + 1) % 300) for k in range(300)] + [(400, 1000)]
    got = {r.node: r.component for r in strong.strong_components(edges_of(spark, pairs)).collect()}
    assert got == {k: k for k in range(1, 401)} | {1000 + k: 1000 for k in range(300)}
    assert len(rounds) < 60


def test_sampled_hops_limit_each_task(spark, monkeypatch):
    plans, written = [], graph.written
    monkeypatch.setattr(graph, "written", lambda df, name: plans.append(df._jdf.queryExecution().executedPlan().toString()) or written(df, name))
    edges = edges_of(spark, [(k, 0) for k in range(1, 500)])
    assert graph.k_hop(spark.createDataFrame([(0,)], "node long"), edges, 1, fanout=(5,)).count() == 6
    limit = plans[-1].split("WindowGroupLimit")
    assert len(limit) == 3 and "Exchange" in limit[1] and "Partial" in limit[2]  # once before the shuffle, once after it


def test_k_hop(spark):
    pairs = [(1, 0), (2, 1), (3, 2), (4, 3), (2, 0)]
    seeds = spark.createDataFrame([(0,)], "node long")
    got = {r.node: r.hop for r in graph.k_hop(seeds, edges_of(spark, pairs), 3).collect()}
    assert got == {0: 0, 1: 1, 2: 1, 3: 2, 4: 3}
    few = graph.k_hop(seeds, edges_of(spark, [(k, 0) for k in range(1, 30)]), 1, fanout=(5,))
    assert few.count() == 6


def test_compose_right_wins(spark):
    a = spark.createDataFrame([(0, 1, 1.0, None), (1, 2, 2.0, 5.0)], "u long, v long, w double, x double")
    b = spark.createDataFrame([(1, 2, 9.0, None), (3, 4, 4.0, 1.0)], "u long, v long, w double, x double")
    assert {(r.u, r.v): (r.w, r.x) for r in graph.compose(a, b).collect()} == {(0, 1): (1.0, None), (1, 2): (9.0, 5.0), (3, 4): (4.0, 1.0)}


def test_relabel(spark):
    df = spark.range(1000).select(F.col("id"), ((F.col("id") * 7919) % 1009).alias("k")).repartition(7)
    got = graph.relabel(df, ["k"]).orderBy("k").collect()
    assert [r.new_id for r in got] == list(range(1000))


def test_waterway_capacity(spark):
    df = spark.createDataFrame([("river",), ("ditch",), ("brook",), (None,)], "k string").select(graph.waterway_capacity(F.col("k")).alias("c"))
    assert [r.c for r in df.collect()] == [1.0, 0.25, 0.1, 0.1]


@pytest.mark.parametrize("size", [None, 0.05, 30.0])
def test_k_nearest_is_exact(spark, size):
    rng = np.random.default_rng(7)
    p = np.concatenate([rng.normal(0, 1, (80, 2)), rng.normal(40, 0.1, (20, 2)), [[1, 1], [1, 1], [1, 1]]])
    df = spark.createDataFrame([(k, float(x), float(y)) for k, (x, y) in enumerate(p)], "id long, x double, y double")
    got = {}
    for r in spatial.k_nearest(df, df, 5, size).collect():
        got.setdefault(r.id, {})[r.rank] = r.other
    for i in range(len(p)):
        d = sorted((math.dist(p[i], p[j]), j) for j in range(len(p)) if j != i)[:5]
        assert [got[i][k + 1] for k in range(5)] == [j for _, j in d]


def test_few_neighbours(spark):
    df = spark.createDataFrame([(0, 0.0, 0.0), (1, 5.0, 5.0)], "id long, x double, y double")
    assert {(r.id, r.other) for r in spatial.k_nearest(df, df, 8, 0.1).collect()} == {(0, 1), (1, 0)}


def test_neighbours_within_a_reach(spark):
    """Others farther than the reach don't count, and the cells stay narrow: points far from a dense table make no pairs with it."""
    rng = np.random.default_rng(3)
    p, q = rng.random((60, 2)) * [1, 50], rng.random((400, 2))
    table = lambda x: spark.createDataFrame([(k, float(a), float(b)) for k, (a, b) in enumerate(x)], "id long, x double, y double")
    for reach in (0.05, 0.7):
        got = {r.id: r.other for r in spatial.k_nearest(table(p), table(q), 1, skip_self=False, within=reach).collect()}
        d = np.sqrt(((p[:, None] - q[None]) ** 2).sum(2))
        assert got == {i: int(d[i].argmin()) for i in range(len(p)) if d[i].min() <= reach}


def test_drains_far_away(spark):
    """2 km and more is a share of 1, also of nodes that the search never leads to; a node without a place counts as 500 m away."""
    rows = [(0, 13.0, 80.0), (1, 13.0, 80.01), (2, 13.0, 80.0179), (3, 13.0, 80.02), (4, 19.0, 80.0), (5, None, 80.0)]
    nodes = spark.createDataFrame(rows, "node_id long, lat double, lon double")
    edges = spark.createDataFrame([(0, 1, 1.0), (3, 4, 0.0)], "u long, v long, edge_type double")
    got = {r.node_id: r.drain_dist for r in features.drain_distance(nodes, edges).collect()}
    metres = lambda d: math.radians(d) * 6_371_000 / 2000
    assert got[0] == 0 and np.allclose([got[k] for k in range(1, 6)], [metres(0.01), metres(0.0179), 1.0, 1.0, 0.25])


def test_idw(spark):
    p = spark.createDataFrame([(0, 0.0, 0.0)], "id long, x double, y double")
    st = spark.createDataFrame([(1.0, 0.0, 0.0), (2.0, 0.0, 10.0)], "s_x double, s_y double, s_value double")
    assert np.isclose(spatial.idw_all(p, st).first()["value"], 2.0)
    gaps = spark.createDataFrame([(0, 0.0, 0.0, None), (1, 1.0, 0.0, 3.0)], "id long, x double, y double, value double")
    assert {r.id: r["value"] for r in spatial.idw_nearest(gaps, "value", 1.0).collect()} == {0: 3.0, 1: 3.0}


def test_interpolation(spark):
    st = spark.createDataFrame([(12.0, 10.0), (14.0, 20.0), (15.0, 0.0)], "lat double, rain double")
    p = spark.createDataFrame([(x,) for x in (13.0, 11.0, 16.0, 12.0, 14.5, 15.0)], "lat double")
    got = [r.rain for r in spatial.interpolate_by(p, st).collect()]
    assert np.allclose(sorted(got), sorted(np.interp([13, 11, 16, 12, 14.5, 15], [12, 14, 15], [10, 20, 0])))


def test_haversine(spark):
    df = spark.range(1).select(maths.haversine(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0)).alias("d"))
    assert np.isclose(df.first().d, 111194.93, atol=0.01)


def test_projection(spark):
    x, y = maths.utm_northing_easting(F.lit(13.0), F.lit(81.0), 81.0)
    r = spark.range(1).select(x.alias("x"), y.alias("y")).first()
    assert np.isclose(r.x, 500000) and np.isclose(r.y, 1437124.8, atol=50)


def test_message_passing(spark):
    nodes = spark.createDataFrame([(0, 1.0), (1, 4.0), (2, -2.0), (3, 9.0)], "node_id long, x double")
    edges = edges_of(spark, [(0, 2), (1, 2), (3, 2), (2, 0)])
    val = lambda df, c: {r.node_id: r[c] for r in df.collect()}
    assert val(gnn.sage(edges, nodes, ["x"], "max"), "max_x") == {0: -2.0, 1: 0.0, 2: 9.0, 3: 0.0}
    assert np.isclose(val(gnn.sage(edges, nodes, ["x"], "mean"), "mean_x")[2], 14 / 3)
    d = {0: 2, 1: 1, 2: 4, 3: 1}
    assert np.isclose(val(gnn.gcn(edges, nodes, ["x"]), "gcn_x")[2], sum(v / math.sqrt(d[u] * 4) for u, v in [(0, 1), (1, 4), (3, 9), (2, -2)]))
    w = np.exp([1000.0, 4000.0, 9000.0] - np.float64(9000))
    assert np.isclose(val(gnn.attention(edges, nodes, "x", F.col("s_x") * 1000), "attended")[2], (w * [1, 4, 9]).sum() / w.sum())


def test_gelu_and_gru():
    x = np.linspace(-4, 4, 81)
    want = [0.5 * v * (1 + math.erf(v / math.sqrt(2))) for v in x]
    assert np.allclose(gnn.gelu(x), want, atol=1e-6)
    rng = np.random.default_rng(0)
    w, u, b, seq = rng.normal(size=(2, 9)), rng.normal(size=(3, 9)), rng.normal(size=9), rng.normal(size=(1, 4, 2))
    h = np.zeros(3)
    for step in seq[0]:
        a, c = step @ w + b, h @ u
        r, z = 1 / (1 + np.exp(-(a[:3] + c[:3]))), 1 / (1 + np.exp(-(a[3:6] + c[3:6])))
        h = (1 - z) * np.tanh(a[6:] + r * c[6:]) + z * h
    assert np.allclose(gnn.gru(seq, w, u, b)[0], h)


def network_brute(static, short, long, edges, w, mixing=False, at=0, rate=0.0):
    """The network for one snapshot, node by node and edge by edge, in plain loops; with a rate, units are dropped in column ``at``."""
    erf = np.vectorize(math.erf)
    act = lambda x: 0.5 * x * (1 + erf(x / math.sqrt(2)))
    sig = lambda x: 1 / (1 + np.exp(-x))
    norm = lambda x, n: (x - x.mean()) / np.sqrt(((x - x.mean()) ** 2).mean() + 1e-5) * w[f"{n}.g"] + w[f"{n}.c"]
    lin = lambda x, n: x @ w[f"{n}.w"] + w[f"{n}.b"]
    key = lambda v: layers.row_keys(np.array([v]), np.array([at]))
    drop = lambda x, v, layer: x * layers.kept(key(v), len(x), layer, rate)[0] if rate else x

    def recur(seq, n):
        h, out = np.zeros(w[f"{n}.u"].shape[0]), []
        for x in seq:
            a, c = np.split(x @ w[f"{n}.w"] + w[f"{n}.b"], 3), np.split(h @ w[f"{n}.u"] + w[f"{n}.d"], 3)
            r, z = sig(a[0] + c[0]), sig(a[1] + c[1])
            h = (1 - z) * np.tanh(a[2] + r * c[2]) + z * h
            out.append(h)
        return out

    h, edges = [], [x for x in edges if max(x[:2]) < len(static)]
    for k in range(len(static)):
        s = act(norm(lin(drop(act(norm(lin(static[k], "static1"), "static1")), k, 1), "static2"), "static2")) + static[k] @ w["skip.w"]
        first = [drop(x, k, 10 + i) for i, x in enumerate(recur(short[k][:, None], "short0"))]
        a, b = recur(first, "short1")[-1], recur(long[k][:, None], "long0")[-1]
        both = np.concatenate([a, b])
        z = np.exp(lin(act(lin(both, "gate1")), "gate2"))
        z /= z.sum()
        g = act(norm(lin(z[0] * a + z[1] * np.concatenate([b, np.zeros(32)]), "mix"), "mix")) if mixing else act(norm(lin(both, "gate"), "gate"))
        h.append(drop(act(norm(lin(np.concatenate([s, drop(g, k, 2)]), "fuse"), "fuse")), k, 3))
    for layer, n in ((4, "gat1"), (5, "gat2")):
        heads, m = w[f"{n}.a"].shape
        new = []
        for v in range(len(h)):
            own = [(u, e) for u, x, e in edges if x == v and u != v]
            own.append((v, np.mean([e for _, e in own], axis=0) if own else np.zeros(4)))
            left = [(h[u] @ w[f"{n}.l"] + w[f"{n}.lb"]).reshape(heads, m) for u, _ in own]
            right = (h[v] @ w[f"{n}.r"] + w[f"{n}.rb"]).reshape(heads, m)
            off = [layers.kept(layers.mixed(key(v) + layers.row_keys(np.array([u]), 0)), heads, 100 + layer, rate)[0] if rate else np.ones(heads) for u, _ in own]
            out = np.zeros(m)
            for q in range(heads):
                score = []
                for (_, e), x in zip(own, left):
                    y = x[q] + right[q] + (e @ w[f"{n}.e"]).reshape(heads, m)[q]
                    score.append(w[f"{n}.a"][q] @ np.where(y >= 0, y, 0.2 * y))
                p = np.exp(np.array(score) - max(score))
                out += sum(c * o[q] * x[q] for c, o, x in zip(p / p.sum(), off, left)) / heads
            new.append(drop(act(norm(out + w[f"{n}.b"] + h[v] @ w[f"{n}.res"], n)), v, layer))
        h = new
    new = []
    for v in range(len(h)):
        own = [h[u] for u, x, _ in edges if x == v and u != v]
        top = np.max(own, axis=0) if own else np.zeros(64)
        new.append(drop(act(norm(top @ w["sage.l"] + w["sage.b"] + h[v] @ w["sage.r"] + h[v], "sage")), v, 6))
    return np.array([sig(lin(drop(act(lin(x, "head1")), v, 7), "head2")) for v, x in enumerate(new)])


def network_inputs(spark, n=14, hours=2):
    rng = np.random.default_rng(5)
    static, short, long = rng.normal(size=(hours, n, 16)), rng.random((hours, n, 6)), rng.random((hours, n, 12))
    edges = [(u, 0, rng.random(4)) for u in range(1, n)] + [(int(u), int(v), rng.random(4)) for u, v in rng.integers(0, n - 1, (20, 2))] + [(99, 3, rng.random(4)), (3, 99, rng.random(4))]
    rows = [(k, t, static[t, k].tolist(), short[t, k].tolist(), long[t, k].tolist()) for t in range(hours) for k in range(n)]
    snap = spark.createDataFrame(rows, "node_id long, t int, static array<double>, short array<double>, long array<double>").repartition(3)
    table = spark.createDataFrame([(u, v, e.tolist()) for u, v, e in edges], "u long, v long, e array<double>")
    return snap, table, (static, short, long, edges)


@pytest.mark.parametrize(("mixing", "hours", "split"), [(False, 8, None), (True, 1, (5, 3)), (False, 2, (4, 2))])
def test_forward_equals_plain_loops(spark, monkeypatch, mixing, hours, split):
    """Loops, a hub, a node without sources, edges to and from unknown nodes; also in small blocks of several parts, by a shuffle."""
    if split:
        monkeypatch.setattr(layers, "TARGETS", split[0])
        monkeypatch.setattr(layers, "SOURCES", split[1])
        monkeypatch.setattr(layers, "BROADCAST_ROWS", 0)
    w = gnn.weights(gnn.SHAPES, 3)
    w |= {k: np.random.default_rng(len(k)).random(x.shape) + 0.5 for k, x in w.items() if k.endswith(".g")}
    snap, edges, (static, short, long, rows) = network_inputs(spark)
    got = {(r.node_id, r.t): [r.p_1, r.p_3, r.p_6, r.p_12] for r in gnn.forward(snap, edges, w, mixing=mixing, hours=hours).collect()}
    assert len(got) == 28
    for t in range(2):
        want = network_brute(static[t], short[t], long[t], rows, w, mixing)
        assert np.allclose([got[k, t] for k in range(14)], want, atol=1e-5)


def test_nodes_without_some_hours(spark):
    """A node counts for the hours that it has: in others it is as if it weren't there."""
    w = gnn.weights(gnn.SHAPES, 3)
    snap, edges, (static, short, long, rows) = network_inputs(spark)
    edges = edges.withColumn("e", F.array_repeat(F.lit(0.5), 4))  # the mean of a target's edges is that of all hours
    got = {(r.node_id, r.t): [r.p_1, r.p_3, r.p_6, r.p_12] for r in gnn.forward(snap.filter("t = 0 OR node_id <> 13"), edges, w).collect()}
    assert len(got) == 27
    rows = [(u, v, np.full(4, 0.5)) for u, v, _ in rows if 13 not in (u, v)]
    want = network_brute(static[1][:13], short[1][:13], long[1][:13], rows, w)
    assert np.allclose([got[k, 1] for k in range(13)], want, atol=1e-5)


@pytest.mark.parametrize("wide", [0, 99])
def test_both_ways_through_the_layers_are_the_same(spark, monkeypatch, wide):
    """Layer by layer, and all layers in one task for a block with its neighbourhood: blocks of three nodes, a hub, and a node that
    lacks an hour; forward, spread and the older network."""
    monkeypatch.setattr(layers, "WIDE", wide)
    monkeypatch.setattr(layers, "BLOCK", 3)
    w = gnn.weights(gnn.SHAPES, 3)
    snap, edges, (static, short, long, rows) = network_inputs(spark)
    near = layers.neighbourhoods(snap.select("node_id").distinct(), edges, 3)
    assert (near is None) == (wide == 0)
    got = {(r.node_id, r.t): [r.p_1, r.p_3, r.p_6, r.p_12] for r in gnn.forward(snap, edges, w).collect()}
    assert len(got) == 28
    for t in range(2):
        assert np.allclose([got[k, t] for k in range(14)], network_brute(static[t], short[t], long[t], rows, w), atol=1e-5)
    found = {(r.node_id, r.t): r for r in gnn.forward_with_spread(snap, edges, w, samples=3).collect()}
    p = np.array([network_brute(static[1], short[1], long[1], rows, w, at=3 + k, rate=0.25) for k in range(3)])
    assert len(found) == 28 and np.allclose([found[k, 1].std_6 for k in range(14)], p[:, :, 2].std(0, ddof=1), atol=1e-5)
    test_nodes_without_some_hours(spark)
    test_older_network_equals_plain_loops(spark)


def test_what_the_layers_write_is_little(spark, tmp_path, monkeypatch):
    """On a map no state of a node and hour is written: only the inputs, a small part of them."""
    names = []
    for m in (layers, gnn):
        monkeypatch.setattr(m, "written", lambda df, name: names.append(name) or graph.written(df, name))
    snap, edges, _ = network_inputs(spark)
    gnn.forward(snap, edges, gnn.weights(gnn.SHAPES)).count()
    gnn.older_forward(snap, edges, gnn.older_weights()).count()
    assert "hours" in names and not {"states", "layer", "parts"} & set(names)


def test_hubs_are_folded_in_parts():
    """The edges of one target in many parts, merged, give what they give together."""
    rng = np.random.default_rng(2)
    w = gnn.weights(gnn.SHAPES, 1)
    x, e, own, node = rng.normal(size=(90, 128)), rng.random((90, 4)), np.array([0]), np.arange(90)
    keys, one = layers.row_keys(node[:1], 0), lambda a, b: (np.arange(a, b), np.zeros(b - a, np.int64), e[a:b])
    for fold, x in ((gnn.Attend(w, "gat1", 4, 0.25), x), (gnn.Largest(w, "sage", 6), x[:, :64])):
        whole = fold.parts(x, own, *one(0, 90), node, keys)
        merged, *rest = [fold.parts(x, own, *one(a, min(90, a + 7)), node, keys) for a in range(0, 90, 7)]
        for p in rest:
            merged = fold.merge(merged, p)
        assert np.allclose(fold.finish(whole, x[:1], keys), fold.finish(merged, x[:1], keys), atol=1e-6)


@pytest.mark.parametrize("rate", (0.0, 0.25))
def test_attention_of_all_edges_equals_its_parts(monkeypatch, rate):
    monkeypatch.setattr(layers, "FEW_EDGES", 7)
    rng = np.random.default_rng(3)
    w = {k: x.astype(np.float32) for k, x in gnn.weights(gnn.SHAPES).items()}
    d = np.sort(np.concatenate([np.arange(12), rng.integers(0, 12, 40)]))
    s, own = rng.integers(0, 30, len(d)), np.arange(5, 17)
    x, e, node = rng.normal(size=(30, 128)).astype(np.float32), rng.normal(size=(len(d), 4)).astype(np.float32), np.arange(100, 130)
    keys = layers.row_keys(node[own], 9)
    for name in ("gat1", "gat2"):
        fold = layers.Attend(w, name, 4, rate)
        want = fold.finish(fold.parts(x, own, s, d, e, node, keys), x[own], keys)
        got = fold.whole(x, own, s, d, e, node, keys)
        assert got.dtype == np.float32 and np.allclose(got, want, atol=1e-5)


def test_dropped_units():
    x, keys = np.ones((400, 128)), layers.row_keys(np.arange(400), 5)
    got = layers.dropped(x, keys, 1, 0.25)
    assert abs((got == 0).mean() - 0.25) < 0.01 and np.allclose(got[got > 0], 4 / 3) and (layers.dropped(x, keys, 1, 0.0) == x).all()
    assert abs(((got == 0) & (layers.dropped(x, keys, 2, 0.25) == 0)).mean() - 1 / 16) < 0.01


def test_spread_equals_plain_loops(spark):
    """Mean and deviation (n - 1) over samples with all dropout places, from the same units."""
    snap, edges, (static, short, long, rows) = network_inputs(spark)
    w = gnn.weights(gnn.SHAPES, 3)
    found = gnn.forward_with_spread(snap.repartition(1), edges, w, samples=4).collect()
    assert len(found) == 28
    for t in range(2):
        p = np.array([network_brute(static[t], short[t], long[t], rows, w, at=t * 4 + k, rate=0.25) for k in range(4)])
        for r in found:
            if r.t == t:
                assert np.allclose([r.mean_1, r.mean_3, r.mean_6, r.mean_12], p[:, r.node_id].mean(0), atol=1e-5)
                assert np.allclose([r.std_1, r.std_3, r.std_6, r.std_12], p[:, r.node_id].std(0, ddof=1), atol=1e-5)


def test_recurrent_baseline(spark):
    snap, _, (static, short, _, _) = network_inputs(spark, hours=1)
    w = gnn.weights(gnn.GRU_SHAPES, 4)
    erf = np.vectorize(math.erf)
    act, sig = (lambda x: 0.5 * x * (1 + erf(x / math.sqrt(2)))), (lambda x: 1 / (1 + np.exp(-x)))
    for r in gnn.gru_baseline(snap, w).collect():
        seq = [x[None] for x in short[0, r.node_id]]
        for n in ("gru0", "gru1"):
            h, out = np.zeros(128), []
            for x in seq:
                a, c = np.split(x @ w[f"{n}.w"] + w[f"{n}.b"], 3), np.split(h @ w[f"{n}.u"] + w[f"{n}.d"], 3)
                z = sig(a[1] + c[1])
                h = (1 - z) * np.tanh(a[2] + sig(a[0] + c[0]) * c[2]) + z * h
                out.append(h)
            seq = out
        s = act(static[0, r.node_id] @ w["enc1.w"] + w["enc1.b"]) @ w["enc2.w"] + w["enc2.b"]
        want = sig(act(np.concatenate([seq[-1], s]) @ w["out1.w"] + w["out1.b"]) @ w["out2.w"] + w["out2.b"])[0]
        assert np.isclose(r.p, want, atol=1e-5)


def test_windows_that_begin_alike_share_their_states():
    rng = np.random.default_rng(6)
    w, x = gnn.weights(gnn.GRU_SHAPES, 4), rng.random((200, 6)) * (rng.random((200, 6)) < 0.2)
    x[:40] = 0
    found, at = gnn.beginnings(x)
    assert [len(first) for first, _ in found] == [len(np.unique(x[:, : k + 1], axis=0)) for k in range(6)] and len(found[0][0]) < 60
    assert np.allclose(gnn.stacked(x, w, ["gru0", "gru1"]), gnn.recurrent(gnn.recurrent(x[:, :, None], w, "gru0", True), w, "gru1"), atol=1e-12)


def test_recurrent_baseline_is_dealt_over_all_partitions(spark):
    """However few the snapshots are, as their windows come from one partition."""
    snap, _, _ = network_inputs(spark, n=60, hours=4)
    found = gnn.gru_baseline(snap.coalesce(1), gnn.weights(gnn.GRU_SHAPES, 4))
    assert found.withColumn("part", F.spark_partition_id()).select("part").distinct().count() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_older_network_equals_plain_loops(spark):
    w = gnn.older_weights(2)
    snap, edges, (static, short, _, rows) = network_inputs(spark, hours=1)
    sig, relu = (lambda x: 1 / (1 + np.exp(-x))), (lambda x: np.maximum(x, 0))
    norm = lambda x, n: (x - w[f"{n}.m"]) / np.sqrt(w[f"{n}.v"] + 1e-5) * w[f"{n}.g"] + w[f"{n}.c"]
    rows = [(u, v) for u, v, _ in rows if max(u, v) < 14 and u != v]
    time = []
    for k in range(14):
        seq = [x[None] for x in short[0, k]]
        for n in ("time0", "time1"):
            h, out = np.zeros(64), []
            for x in seq:
                a, c = np.split(x @ w[f"{n}.w"] + w[f"{n}.b"], 3), np.split(h @ w[f"{n}.u"] + w[f"{n}.d"], 3)
                z = sig(a[1] + c[1])
                h = (1 - z) * np.tanh(a[2] + sig(a[0] + c[0]) * c[2]) + z * h
                out.append(h)
            seq = out
        time.append(seq[-1])
    h = [np.concatenate([static[0, k], time[k]]) for k in range(14)]
    for n in ("mean0", "mean1", "mean2"):
        means = [np.mean([h[u] for u, x in rows if x == v], axis=0) if any(x == v for _, x in rows) else np.zeros(len(h[0])) for v in range(14)]
        h = [relu(norm(means[v] @ w[f"{n}.l"] + w[f"{n}.b"] + h[v] @ w[f"{n}.r"], n)) for v in range(14)]
    found = {r.node_id: r for r in gnn.older_forward(snap, edges, w).collect()}
    assert len(found) == 14
    for k in range(14):
        x = np.concatenate([static[0, k], time[k], h[k]])
        for n in ("fuse0", "fuse1", "fuse2"):
            x = relu(norm(x @ w[f"{n}.w"] + w[f"{n}.b"], n))
        p = sig(relu(x @ w["end1.w"] + w["end1.b"]) @ w["end2.w"] + w["end2.b"])[0]
        r = found[k]
        assert np.allclose(r.temporal, time[k], atol=1e-5) and np.allclose(r.spatial, h[k], atol=1e-4) and np.allclose(r.fused, x, atol=1e-3) and np.isclose(r.p, p, atol=1e-4)


def test_random_forest(spark):
    rows = [(k, float(k % 10), float(k % 7), int(k % 10 > 6)) for k in range(300)]
    df = spark.createDataFrame(rows, "id long, a double, b double, y int")
    got = gnn.random_forest(df.filter("id < 200"), df.filter("id >= 200"), ["a", "b"], "y", trees=10, depth=4)
    assert got.filter((F.col("p") >= 0.5).cast("int") != F.col("y")).count() == 0


def test_random_forest_fits_counts(spark, monkeypatch):
    """What the trees are fitted to has a row for each class and bins, however many rows there are, and hangs on the rows alone."""
    sizes = []
    kept = lambda df, name: (found := graph.written(df, name), sizes.append((name, found.count())))[0]
    monkeypatch.setattr(gnn, "written", kept)
    draw = np.random.default_rng(5)
    a, b = draw.normal(size=800), draw.choice([0.0, 1.0, 2.0], 800, p=[0.9, 0.05, 0.05])
    df = spark.createDataFrame([(k, float(x), float(y), int(x + y + z > 1)) for k, (x, y, z) in enumerate(zip(a, b, draw.normal(size=800)))], "id long, a double, b double, y int")
    many = df.crossJoin(spark.range(10).select(F.col("id").alias("copy")))
    run = lambda train: {r.id: r.p for r in gnn.random_forest(train, df, ["a", "b"], "y", trees=10, depth=4).collect()}
    first = run(many.repartition(1))
    assert sizes and all(n <= 2 * 31 * 3 for _, n in sizes) and len(first) == 800
    assert run(many.repartition(7, "copy")) == pytest.approx(first, abs=1e-9)


def test_random_forest_is_that_of_single_rows(spark):
    """Means of many trees are near those of MLlib's own forest, which draws rows one by one."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    draw = np.random.default_rng(6)
    x = draw.normal(size=(1500, 2))
    y = (x[:, 0] + x[:, 1] ** 2 + draw.normal(size=1500) > 2.5).astype(int)
    df = spark.createDataFrame([(k, float(p), float(q), int(l)) for k, ((p, q), l) in enumerate(zip(x, y))], "id long, a double, b double, y int").coalesce(1).cache()
    got = {r.id: r.p for r in gnn.random_forest(df, df, ["a", "b"], "y", trees=40, depth=4).collect()}
    share = y.mean()
    rows = VectorAssembler(inputCols=["a", "b"], outputCol="_x").transform(df).withColumn("_w", F.when(F.col("y") == 1, 0.5 / share).otherwise(0.5 / (1 - share)))
    model = RandomForestClassifier(featuresCol="_x", labelCol="y", weightCol="_w", numTrees=40, maxDepth=4, seed=1).fit(rows)
    want = {r.id: r.p for r in model.transform(rows).select("id", vector_to_array("probability")[1].alias("p")).collect()}
    gap = np.array([got[k] - want[k] for k in want])
    assert abs(gap.mean()) < 0.02 and np.abs(gap).mean() < 0.05


def test_random_forest_finds_few_rows_of_a_class(spark):
    """Five rows of a class in 4,000 that lie beyond all others' values."""
    df = spark.range(4000).select("id", (F.col("id") * 0.01).alias("a"), F.lit(0.0).alias("b"), (F.col("id") >= 3995).cast("int").alias("y"))
    got = gnn.random_forest(df, df, ["a", "b"], "y", trees=10, depth=4)
    assert got.filter((F.col("p") >= 0.5).cast("int") != F.col("y")).count() == 0


def test_blocks_are_dealt_over_more_parts_the_more_rows_there_are(spark, monkeypatch):
    rows = [(n, t, [0.1 * n] * 16, [0.2 * t] * 6) for n in range(12) for t in range(16)]
    snap = spark.createDataFrame(rows, "node_id long, t int, static array<double>, short array<double>")
    run = lambda: gnn.older_forward(snap, edges_of(spark, [(k, k + 1) for k in range(11)]), gnn.older_weights())
    few = run()
    monkeypatch.setattr(gnn, "BLOCK_ROWS", 2)
    many = run()  # 24 rows of a node and eight hours
    assert few.rdd.getNumPartitions() <= 4 and many.rdd.getNumPartitions() == 12
    by = lambda df: {(r.node_id, r.t): r.p for r in df.collect()}
    assert by(many) == by(few) and len(by(many)) == 192


def test_hubs_and_triggers(spark):
    """A hub with many neighbours: states go from the triggers alone, hop by hop."""
    df = spark.createDataFrame([(v, t, 1.0 if (v, t) == (3, 0) else 0.0) for v in range(500) for t in range(4)], "node_id long, t int, rain double")
    edges = edges_of(spark, [(v, 0) for v in range(1, 500)] + [(0, v) for v in range(1, 500)])
    got = {(r.node_id, r.t): r.p for r in graph.propagate(df, edges, "rain").collect()}
    assert len(got) == 2000 and np.isclose(got[0, 1], 0.9) and np.isclose(got[7, 2], 0.81) and got[7, 1] == 0 and np.isclose(got[0, 3], max(0.9**3, 0.9 * 0.5**0.5))


def test_attributes_of_parallel_edges_are_laid_over(spark):
    rows = [(0, 1, 9.0, 0, "a", "x"), (0, 1, 5.0, 1, None, "y"), (0, 1, 7.0, 2, "c", "z"), (0, 1, 5.0, 3, "d", "w"), (0, 1, 2.0, 4, None, None)]
    df = spark.createDataFrame(rows, "u long, v long, length double, key int, name string, kind string").repartition(3)
    assert [tuple(r) for r in graph.shortest_parallel(df).collect()] == [(0, 1, 2.0, 4, "a", "y")]


def test_a_missing_order_comes_first(spark):
    df = spark.createDataFrame([(0, 1, 5.0, None, "a"), (0, 1, 5.0, 1, "b"), (0, 2, 5.0, None, "c"), (0, 2, 4.0, 1, None)], "u long, v long, length double, key int, x string")
    got = {r.v: (r.length, r.key, r.x) for r in graph.shortest_parallel(df).collect()}
    assert got == {1: (5.0, None, "a"), 2: (4.0, 1, "c")}


def test_exact_quantiles(spark):
    rng = np.random.default_rng(1)
    for v in (rng.normal(size=1001), rng.integers(0, 4, 500) * 1.0, [3.0], [1e-300, 1e300, -1e300, 0.0, 1.7e308, -1.7e308], np.exp(rng.normal(size=300) * 40), [0.0, 5e-324, 1e-323]):
        rows = [(float(x),) for x in v] + [(None,), (float("nan"),), (float("inf"),)]
        got = order.quantiles(spark.createDataFrame(rows, "a double"), "a", [0.0, 0.25, 0.5, 0.95, 1.0])
        with np.errstate(over="ignore"):
            want = [np.sort(v)[int(q * (len(v) - 1))] + (np.sort(v)[min(len(v) - 1, int(q * (len(v) - 1)) + 1)] - np.sort(v)[int(q * (len(v) - 1))]) * (q * (len(v) - 1) % 1) if q * (len(v) - 1) % 1 else np.sort(v)[int(q * (len(v) - 1))] for q in (0.0, 0.25, 0.5, 0.95, 1.0)]
        assert np.allclose(got, want, rtol=1e-12, atol=0)
    assert order.quantiles(spark.createDataFrame([(None,)], "a double"), "a", [0.5]) == [None]


def test_tiles_of_several_bands(spark):
    """Edges of tiles, overlaps band by band, points outside, columns of clashing names."""
    tiles = spark.createDataFrame([(1, 0.0, 4.0, 1.0, 4, 4), (2, 3.0, 4.0, 1.0, 4, 4), (3, -50.0, 0.0, 0.5, 2, 2)], "tile int, x0 double, y0 double, res double, rows int, cols int")
    cells = spark.createDataFrame([(t, r, c, float(100 * t + 10 * r + c), None if t == 1 else float(t)) for t in (1, 2) for r in range(4) for c in range(4)], "tile int, row int, col int, a double, b double")
    cells = cells.withColumn("a", F.when(F.col("a") == 103, -1.0).otherwise(F.col("a")))
    p = spark.createDataFrame([(0, 0.0, 4.0), (1, 3.0, 3.5), (2, 3.5, 2.5), (3, 4.0, 4.0), (4, 7.0, 4.0), (5, 0.0, 0.0), (6, 6.9, 0.1), (7, -49.9, -0.1)], "id int, x double, y double").withColumn("_left", F.lit("k"))
    found = spatial.sample_tiles(p, tiles, cells, ["a", "b"], {"a": -1.0})
    assert {r.id: (r.a, r.b) for r in found.filter("_left = 'k'").collect()} == {0: (100.0, None), 1: (200.0, 2.0), 2: (113.0, 2.0), 3: (201.0, 2.0), 4: (None, None), 5: (None, None), 6: (233.0, 2.0), 7: (None, None)}
    full = spatial.fill_bands(found, {"a": None, "b": 9.0})
    assert {r.id: (r.a, r.b) for r in full.collect() if r.id in (4, 0)} == {4: (200.0, 9.0), 0: (100.0, 9.0)}


def test_repeated_points_and_empty_sides(spark):
    p = spark.createDataFrame([(0.0, 0.0, 13.0, 80.25)] * 3 + [(1.0, 2.0, 13.1, 80.3)], "x double, y double, lat double, lon double")
    st = spark.createDataFrame([(1.0, 0.0, 4.0), (0.0, 2.0, 8.0)], "s_x double, s_y double, s_value double")
    rivers = spark.createDataFrame([(13.0, 80.25)], "r_lat double, r_lon double")
    assert sorted(r["value"] for r in spatial.idw_all(p, st).collect())[:3] == [(4 + 8 / 4) / (1 + 1 / 4)] * 3
    assert sorted(r.river for r in spatial.river_proximity(p, rivers).collect())[1:] == [1.0] * 3
    for found, c, want in ((spatial.idw_all(p, st.limit(0)), "value", None), (spatial.river_proximity(p, rivers.limit(0)), "river", 0.0)):
        assert [r[c] for r in found.collect()] == [want] * 4
    near = lambda t: spatial.nearest_in_table(p, t, lambda s: F.abs(F.col("x") - s["s_x"]))
    assert sorted(r.dist for r in near(st).collect()) == [0.0] * 4 and [r.dist for r in near(st.limit(0)).collect()] == [None] * 4
    with pytest.raises(ValueError, match="too many"):
        spatial.beside(p, spark.range(10), "_x", most=9)


@pytest.mark.parametrize("n", [1, 3, 12_000])
def test_interpolation_over_many_stations(spark, n):
    rng = np.random.default_rng(n)
    x, v = np.sort(rng.random(n)) * 100, rng.random(n)
    q = np.concatenate([rng.random(400) * 120 - 10, x[:5], x[:5]])
    st = spark.createDataFrame(list(zip(x.tolist(), v.tolist())), "lat double, rain double")
    p = spark.createDataFrame([(k, float(a)) for k, a in enumerate(q)], "id long, lat double").repartition(5)
    found = spatial.interpolate_by(p, st)
    assert "NestedLoop" not in found._jdf.queryExecution().executedPlan().toString()
    got = {r.id: r.rain for r in found.collect()}
    assert len(got) == len(q) and np.allclose([got[k] for k in range(len(q))], np.interp(q, x, v))
    assert {r.rain for r in spatial.interpolate_by(p, st.limit(0)).collect()} == {None}


def test_capacity_of_any_case(spark):
    df = spark.createDataFrame([("River",), ("CANAL",)], "k string").select(graph.waterway_capacity(F.col("k")).alias("c"))
    assert [r.c for r in df.collect()] == [1.0, 0.8]
