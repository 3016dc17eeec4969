import pytest

from silkgraph.operators import classify, components, cycles, generate, graph, shortest
from silkgraph.plans.queries import QUERIES
from silkgraph.sources import sinks, transfers
from tests.helpers import SMALL, brute_betweenness, brute_cycles, random_edges

CASE_A = [(1, 2, 100), (2, 3, 300), (3, 1, 100), (3, 4, 100), (4, 1, 20), (4, 5, 61), (5, 1, 20), (2, 1, 50), (5, 6, 0), (6, 1, 10), (7, 1, 5), (4, 4, 9)]
CASE_B = [(10, 20, 1), (10, 30, 1), (20, 40, 1), (30, 40, 1), (40, 50, 2), (5, 10, 7), (20, 50, 3), (50, 60, 1), (50, 70, 0)]
CASE_C = [(1, 2, 1), (1, 2, 1), (2, 3, 1), (1, 4, 1), (4, 3, 1)]


def frame(spark, edges):
    return spark.createDataFrame(edges, "u long, v long, w long")


def paths(df):
    return {tuple(r["path"]) for r in df.collect()}


def test_hand_checked_cycles(spark):
    e = frame(spark, CASE_A)
    assert paths(cycles.cycles(e)) == {(1, 2, 3), (1, 2, 3, 4), (1, 2, 3, 4, 5), (1, 2, 3, 4, 5, 6)}
    assert paths(cycles.cycles(e.where("w > 0"))) == {(1, 2, 3), (1, 2, 3, 4), (1, 2, 3, 4, 5)}
    assert paths(cycles.cycles(e, ratio=True)) == {(1, 2, 3)}


@pytest.mark.parametrize("seed", range(4))
@pytest.mark.parametrize("ratio", [False, True])
def test_cycles_match_depth_first_search(spark, seed, ratio):
    edges = random_edges(seed)
    assert paths(cycles.cycles(frame(spark, edges), ratio=ratio)) == brute_cycles(edges, ratio)


def test_report_is_ordered_and_counted(spark, tmp_path):
    out = tmp_path / "report.txt"
    more = [(u + 10, v + 10, w) for u, v, w in CASE_A] + [(u + 100, v + 100, w) for u, v, w in CASE_A]
    found = cycles.cycles(frame(spark, CASE_A + more)).repartition(7)
    for _ in range(2):  # an existing report is replaced
        sinks.write_cycle_report(found, str(out))
    lines = [tuple(x + d for x in c) for c in ((1, 2, 3), (1, 2, 3, 4), (1, 2, 3, 4, 5), (1, 2, 3, 4, 5, 6)) for d in (0, 10, 100)]
    assert out.read_text().splitlines() == ["12", *[",".join(map(str, c)) for c in lines]]


def test_empty_report(spark, tmp_path):
    sinks.write_cycle_report(cycles.cycles(frame(spark, [])), str(tmp_path / "r"))
    assert (tmp_path / "r").read_text() == "0\n"


def test_empty_graph(spark):
    e = frame(spark, [])
    assert paths(cycles.cycles(e)) == set()
    assert components.weak_components(e).count() == 0
    assert components.strong_components(e).count() == 0
    assert shortest.betweenness(e).count() == 0
    assert graph.vertex_dense_rank(e).count() == 0


CHAINS = [(1, 2, 3), (3, 2, 1), (2, 4, 2), (8, 1, 1), (9, 8, 5), (4, 5, 1), (4, 6, 1), (5, 7, 1), (6, 7, 1), (7, 4, 1), (7, 10, 2), (11, 4, 1), (11, 4, 1), (12, 11, 1)]


@pytest.mark.parametrize("edges", [CASE_B, CASE_C, CHAINS, random_edges(5, 8, 20, 4), random_edges(6, 7, 30, 3)])
def test_betweenness_both_ways(spark, edges):
    want = brute_betweenness(edges)
    e = frame(spark, edges)
    positive = e.where("w > 0")
    assert {r["id"]: round(r["bc"], 6) for r in shortest.betweenness_kernel(positive, fold=False).collect()} == want
    assert {r["id"]: round(r["bc"], 6) for r in shortest.betweenness(e).collect()} == want
    assert {r["id"]: round(r["bc"], 6) for r in shortest.betweenness(e, kernel_edges=0).collect()} == want


def test_ranking_order_and_format(spark):
    top = shortest.top_central(shortest.betweenness(frame(spark, CASE_B))).collect()
    assert [r["id"] for r in top] == [40, 10, 50, 20, 30, 5, 60]
    assert sinks.format_ranking(top)[3] == "20,3.667"


def test_components(spark):
    e = frame(spark, [(1, 2, 1), (2, 3, 1), (3, 1, 1), (3, 4, 1), (5, 6, 1), (6, 5, 1), (8, 8, 1)])
    weak = {r["id"]: r["component"] for r in components.weak_components(e).collect()}
    assert weak == {1: 1, 2: 1, 3: 1, 4: 1, 5: 5, 6: 5, 8: 8}
    strong = {r["id"]: r["scc"] for r in components.strong_components(e).collect()}
    assert strong == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5, 6: 5, 8: 8}
    degrees = {r["scc"]: (r["size"], r["in_deg"], r["out_deg"]) for r in components.condensed_degrees(e).collect()}
    assert degrees == {1: (3, 0, 1), 4: (1, 1, 0), 5: (2, 0, 0), 8: (1, 0, 0)}


@pytest.mark.parametrize("edges", [random_edges(12, 20, 28), [(i + 1, i, 1) for i in range(20)] + [(0, 10, 1)]])
def test_strong_components_against_reachability(spark, edges):
    ids = sorted({x for u, v, _ in edges for x in (u, v)})
    reach = {x: {x} for x in ids}
    for _ in ids:
        for u, v, _ in edges:
            reach[u] |= reach[v]
    want = {x: min(y for y in reach[x] if x in reach[y]) for x in ids}
    assert {r["id"]: r["scc"] for r in components.strong_components(frame(spark, edges)).collect()} == want
    counts = {r["id"]: r["n_reached"] for r in shortest.reachable_counts(frame(spark, edges)).collect()}
    assert counts == {x: len(reach[x]) - 1 for x in ids}


def test_distances_of_long_paths_and_some_sources(spark):
    e = frame(spark, [(i, i + 1, 2) for i in range(20)] + [(0, 5, 3), (5, 0, 1)])
    want = {v: 2 * v if v < 5 else 3 + 2 * (v - 5) for v in range(21)}
    assert {r["v"]: r["dist"] for r in shortest.sssp(e, 0).collect()} == want
    some = shortest.path_counts(e, sources=spark.createDataFrame([(0,), (0,), (18,)], "id long")).collect()
    assert {(r["s"], r["v"]): r["dist"] for r in some} == {(0, v): d for v, d in want.items()} | {(18, 18): 0, (18, 19): 2, (18, 20): 4}


def test_a_hub_with_very_many_transfers(spark):
    edges = [(0, i, 10) for i in range(1, 300)] + [(i, 300 + i % 3, 10) for i in range(1, 300)] + [(300, 0, 10), (301, 0, 1)]
    assert paths(cycles.cycles(frame(spark, edges), ratio=True)) == brute_cycles(edges, True)


def test_contraction_folds_chains(spark):
    e = frame(spark, [(1, 3, 1), (2, 3, 1), (3, 4, 1), (4, 5, 1), (4, 6, 1)])
    assert {r["id"]: r["label"] for r in graph.contracted_sources(e).collect()} == {1: 0, 2: 0, 3: 2}


def test_text_sources(spark, tmp_path):
    t = tmp_path / "t.csv"
    t.write_bytes(b"1,2,3\r\n4294967295,5,6\n7,8,0\n")
    assert sorted(map(tuple, transfers.read_transfers(spark, str(t)).collect())) == [(1, 2, 3), (7, 8, 0), (4294967295, 5, 6)]
    assert transfers.read_transfers(spark, str(t), ("u", "v")).columns == ["u", "v"]
    g = tmp_path / "g.txt"
    g.write_text("4 3 1\n1 2 5\n2 3 6\n1 3 20\n")
    edges, n, source = transfers.read_weighted_graph(spark, str(g))
    dist = shortest.sssp(edges, source)
    assert sinks.distance_line(dist, n).first()["line"] == "0 5 11 2147483647"
    f = tmp_path / "f.csv"
    f.write_text("0.123,-0.456,1\n0.290,0.001,0\n")
    assert transfers.in_id_range(frame(spark, [(1, 2, 3), (1, 50, 3), (50, 1, 3)]), 50).count() == 1
    got = transfers.read_features(spark, str(f)).orderBy("row_id").collect()
    assert [(r["x"], r["label"]) for r in got] == [([0.123, -0.456], 1), ([0.29, 0.001], 0)]


def test_row_numbers_over_files_and_splits(spark, tmp_path):
    for name, n in (("b", 700), ("a", 5), ("c", 0), ("d", 40)):
        (tmp_path / f"{name}.csv").write_text("".join(f"0.{i:03d},0.5,{i % 2}\n" for i in range(n)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        got = transfers.read_features(spark, str(tmp_path)).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    want = [i / 1000 for n in (5, 700, 40) for i in range(n)]
    assert [r["x"][0] for r in sorted(got, key=lambda r: r["row_id"])] == want and sorted(r["row_id"] for r in got) == list(range(745))
    sample = classify.first_rows(transfers.read_features(spark, str(tmp_path)), 8).collect()
    assert sorted(r["x"][0] for r in sample) == sorted(want[:8])
    rows = spark.createDataFrame([(r["row_id"], r["label"]) for r in got], "row_id long, pred int").repartition(5)
    sinks.write_labels(rows, str(tmp_path / "labels.txt"))
    assert (tmp_path / "labels.txt").read_text().split() == [str(i % 2) for n in (5, 700, 40) for i in range(n)]
    assert transfers.numbered_lines(spark, str(tmp_path / "c.csv")).count() == 0


def test_ranking_file(spark, tmp_path):
    sinks.write_ranking(shortest.betweenness(frame(spark, CASE_B)), str(tmp_path / "top.txt"), 4)
    assert (tmp_path / "top.txt").read_text() == "40,5.667\n10,5.000\n50,5.000\n20,3.667\n"
    sinks.write_distances(shortest.sssp(frame(spark, [(1, 2, 5)]), 1), 3, str(tmp_path / "d.txt"))
    assert (tmp_path / "d.txt").read_text() == "0 5 2147483647\n"


def test_generators_repeat(spark):
    for make in (lambda: generate.planted_components(spark, 200, 500), lambda: generate.small_world(spark, 100, 4), lambda: generate.tree_with_cliques(spark, 900, band=20)):
        a, b = sorted(map(tuple, make().collect())), sorted(map(tuple, make().repartition(7).collect()))
        assert a == b and all(u != v for u, v, _ in a) and len({x[:2] for x in a}) == len(a)
    f = generate.labelled_features(spark, 300, 16).collect()
    assert len(f) == 300 and 0.55 < sum(r["label"] for r in f) / 300 < 0.8


def test_generators_are_registered_at_full_size(spark):
    from silkgraph.plans.queries import QUERIES

    ends = lambda name: QUERIES[name](spark, "").selectExpr("count(*)", "max(greatest(u, v))").first()
    for name, edges, vertices in (("gen_planted", 280_000, 28_500), ("gen_small_world", 300_000, 30_000), ("gen_clique", 280_000, 28_000)):
        n, top = ends(name)
        assert 0.98 * edges <= n <= 1.02 * edges and top >= 0.99 * vertices - 1
    rows = QUERIES["gen_features"](spark, "")
    assert rows.count() == 80_000 and len(rows.first()["x"]) == 1000


@pytest.mark.parametrize("edges", [CASE_B, CASE_C, CHAINS, random_edges(5, 8, 20, 4), random_edges(7, 60, 70, 5), [(i, i + 1, 2) for i in range(20)] + [(0, i, 40) for i in range(100, 140)], []])
def test_path_counts_both_ways(spark, edges):
    e = frame(spark, [x for x in edges if x[2] > 0])
    rows = lambda **kw: sorted(map(tuple, shortest.path_counts(e, **kw).collect()))
    assert rows() == rows(kernel_edges=0)
    some = spark.createDataFrame([(0,), (0,), (4,), (999,), (None,)], "id long")
    assert rows(sources=some) == rows(sources=some, kernel_edges=0)


def test_path_counts_of_a_small_graph_write_no_pairs(spark, monkeypatch):
    monkeypatch.setattr(shortest, "all_distances", None)
    assert shortest.path_counts(frame(spark, CASE_C)).count() == 9


def test_all_sources_write_no_pairs(spark, monkeypatch):
    monkeypatch.setattr(shortest, "all_distances", None)
    counts = QUERIES["sp_counts_all"](spark, SMALL).where("s = v")
    assert counts.where("dist = 0 and sigma = 1").count() == graph.vertex_set(transfers.transfers_multi(spark, SMALL).where("u <> v")).count()


@pytest.mark.parametrize("edges", [CASE_A, CASE_B, CHAINS, random_edges(7, 60, 70), [(i, i + 1, 2) for i in range(20)] + [(0, i, 40) for i in range(100, 140)], []])
def test_reachable_counts_write_no_pairs(spark, edges, monkeypatch):
    some = spark.createDataFrame([(0,), (0,), (4,), (999,), (None,)], "id long")
    want = [sorted(((r["id"], r["n_reached"]) for r in shortest.reachable_counts(frame(spark, edges), x, kernel_edges=0).collect()), key=str) for x in (None, some)]
    monkeypatch.setattr(shortest, "all_distances", None)
    assert [sorted(((r["id"], r["n_reached"]) for r in shortest.reachable_counts(frame(spark, edges), x).collect()), key=str) for x in (None, some)] == want


def test_betweenness_runs_only_where_edges_go_out(spark, monkeypatch):
    """A sink has no run unless sources fold into it, and each run takes the sinks in one step."""
    edges = [(0, 1, 2), (1, 0, 2), *((0, i, 3) for i in range(10, 30)), *((1, i, 1) for i in range(20, 40)), (5, 50, 1), (6, 5, 1)]
    e = frame(spark, edges)
    made = []
    monkeypatch.setattr(shortest, "_spread", lambda df: made.append(df.count()) or df)
    assert {r["id"]: round(r["bc"], 6) for r in shortest.betweenness(e).collect()} == brute_betweenness(edges)
    assert made == [3]


@pytest.mark.parametrize("seed", range(4, 7))
@pytest.mark.parametrize("ratio", [False, True])
def test_cycles_by_joins_and_without(spark, seed, ratio, monkeypatch):
    edges = [*random_edges(seed), (-5, 3, 4), (3, -5, 4), (1 << 40, 3, 9), (3, 2, 1 << 33), (2, 1 << 40, 9)]
    want = brute_cycles(edges, ratio)
    assert paths(cycles.cycles(frame(spark, edges), ratio=ratio, kernel_edges=0)) == want
    monkeypatch.setattr(cycles, "_forward", None)  # no half is shuffled or written
    assert paths(cycles.cycles(frame(spark, edges), ratio=ratio)) == want


@pytest.mark.parametrize("edges", [random_edges(7, 12, 60), [(0, i, 10) for i in range(1, 60)] + [(i, 60 + i % 3, 10) for i in range(1, 60)] + [(60, 0, 10), (61, 0, 1), (5, 6, 9), (6, 0, 8), (7, 70, 5), (71, 7, 5)]])
def test_cycle_kernel_in_small_pieces(edges, monkeypatch):
    import numpy as np

    from silkgraph.operators import cycle_kernel as kernel

    best = {}
    for u, v, w in edges:
        if u != v and w > 0:
            best[u, v] = max(w, best.get((u, v), 0))
    g = kernel.Graph(*(np.array(x) for x in zip(*((u, v, w) for (u, v), w in best.items()), strict=True)))
    for piece, held in ((1 << 20, 1 << 21), (3, 2), (1, 1)):
        monkeypatch.setattr(kernel, "PIECE", piece)
        monkeypatch.setattr(kernel, "HELD", held)
        found = [tuple(g.ids[list(c)].tolist()) for n in range(3, 8) for cols in kernel.rooted(g, np.arange(g.n, dtype=np.int32), n, True) for c in zip(*cols, strict=True)]
        assert len(found) == len(set(found)) and set(found) == brute_cycles(edges, True)
    assert set(g.ids.tolist()) <= {u for u, _ in best} & {v for _, v in best}


def test_centrality_and_path_counts_take_rows_of_all_quantities(spark, tmp_path):
    rows = [(1, 2, 8.0, 5.5), (2, 3, 9.0, 4.0), (3, 4, 50.0, 3.9), (4, 4, 1.0, 7.0), (4, 5, 30.0, 0.5)]
    spark.createDataFrame(rows, "l_suppkey long, l_partkey long, l_quantity double, l_extendedprice double").write.parquet(str(tmp_path / "lineitem.parquet"))
    assert [tuple(r) for r in QUERIES["betweenness_top100"](spark, str(tmp_path)).collect()] == [(2, 2.0), (3, 2.0), (1, 0.0), (4, 0.0)]
    counts = {(r["s"], r["v"]): (r["dist"], r["sigma"]) for r in QUERIES["sp_counts"](spark, str(tmp_path)).collect()}
    assert counts == {(1, 1): (0, 1.0), (1, 2): (5, 1.0), (1, 3): (9, 1.0), (1, 4): (12, 1.0), (2, 2): (0, 1.0), (2, 3): (4, 1.0), (2, 4): (7, 1.0), (3, 3): (0, 1.0), (3, 4): (3, 1.0)}


def test_edges_to_sinks_do_not_count_as_edges_of_the_kernel(spark, monkeypatch):
    monkeypatch.setattr(shortest, "betweenness_joins", None)
    edges = [(0, 1, 2), (1, 2, 2), (2, 3, 1), *((i % 3, 100 + i, 1 + i % 4) for i in range(20))]
    assert {r["id"]: round(r["bc"], 6) for r in shortest.betweenness(frame(spark, edges), kernel_edges=3).collect()} == brute_betweenness(edges)


@pytest.mark.parametrize("seed", range(4))
def test_path_kernel_with_and_without_levels_and_layers(seed):
    import random

    import numpy as np

    from silkgraph.operators import path_kernel as kernel

    rnd = random.Random(seed)
    edges = [(rnd.randrange(12), rnd.randrange(40), rnd.randrange(1, 9)) for _ in range(300)] + [(i, i + 8, 3) for i in range(12, 30)]
    if seed % 2:
        edges = [(u, v, w) for u, v, w in edges if u < v]  # no core
    parts = kernel.least_edges(*(np.array(c) for c in zip(*edges, strict=True)))
    ids, least = np.unique(parts[0]), {}
    for u, v, w in edges:
        least[u, v] = min(w, least.get((u, v), w))
    assert {(u, v): w for u, v, w in zip(*(c.tolist() for c in parts[:3]), strict=True)} == least
    inner = np.isin(parts[1], ids)
    u = np.searchsorted(ids, parts[0])
    heads = kernel.Heads(ids, u[inner], np.searchsorted(ids, parts[1][inner]), parts[2][inner], parts[3][inner])
    chunk = kernel.Chunk(u[~inner], parts[1][~inner], parts[2][~inner], parts[3][~inner])
    for s in range(len(ids)):
        want = {int(ids[s]): 0}
        for _ in range(50):
            for (a, b), w in least.items():
                if a in want:
                    want[b] = min(want.get(b, 1 << 30), want[a] + w)
        count = {int(ids[s]): 1}
        for v in sorted((x for x in want if x != ids[s]), key=want.get):
            count[v] = sum(count[a] for a, b, w in edges if b == v and a in want and want[a] + w == want[v])
        run = heads.run(s)
        for few in (True, False):
            chunk.few = lambda _, few=few: few
            mine, its = kernel.common(run.reached, chunk.heads)
            found, dist, paths, _ = chunk.relax(its, run.dist[mine], run.sigma[mine])
            all_ = [*zip(ids[run.reached].tolist(), run.dist.tolist(), run.sigma.tolist(), strict=True), *zip(chunk.targets[found].tolist(), dist.tolist(), paths.tolist(), strict=True)]
            assert sorted(all_) == sorted((v, d, count[v]) for v, d in want.items())
            assert chunk.targets[np.sort(chunk.reached(its))].tolist() == chunk.targets[found].tolist()


def test_reachable_counts_of_many_sinks_write_no_pairs(spark, monkeypatch):
    edges = [(0, 1, 2), (1, 0, 2), (2, 1, 1), *((i % 3, 100 + i, 1) for i in range(20))]
    want = {r["id"]: r["n_reached"] for r in shortest.reachable_counts(frame(spark, edges), kernel_edges=0).collect()}
    monkeypatch.setattr(shortest, "all_distances", None)
    assert {r["id"]: r["n_reached"] for r in shortest.reachable_counts(frame(spark, edges), kernel_edges=3).collect()} == want
    assert want[0] == want[1] == 15 and want[2] == 22 and want[100] == 0


def test_path_counts_of_many_sinks_write_no_pairs(spark, monkeypatch):
    edges = [(0, 1, 2), (1, 0, 2), (2, 1, 1), *((i % 3, 100 + i % 15, 1 + i % 4) for i in range(40))]
    rows = lambda **kw: [tuple(r) for r in shortest.path_counts(frame(spark, edges), **kw).collect()]
    want = sorted(rows(kernel_edges=0))
    monkeypatch.setattr(shortest, "_path_counts_joins", None)
    assert sorted(rows(kernel_edges=5)) == want


def test_rows_to_the_same_vertex_are_side_by_side():
    import numpy as np

    part = lambda s: [np.full(3, s), np.arange(3), np.full(3, 10 * s), np.ones(3)]
    s, v, dist, _ = shortest._together([part(1), part(2)], np.array([7, 5, 6]))
    assert v.tolist() == [7, 7, 5, 5, 6, 6] and s.tolist() == [1, 2] * 3 and dist.tolist() == [10, 20] * 3
