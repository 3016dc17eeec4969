import json
import os
from urllib.parse import urlparse

from silkgraph.functions.ranking import exclusive_sum, global_rank
from silkgraph.operators import classify
from silkgraph.sources import leaderboard, sinks
from silkgraph.streaming import degrees as live


def test_global_rank_and_running_sum(spark):
    df = spark.createDataFrame([(i * 7 % 50, i) for i in range(50)], "k long, x long").repartition(5)
    assert [(r["k"], r["rank"]) for r in global_rank(df, df.k).orderBy("k").collect()] == [(i, i) for i in range(50)]
    want, total = [], 0
    for k, x in sorted((i * 7 % 50, i) for i in range(50)):
        want.append((k, total))
        total += x
    assert [(r["k"], r["offset"]) for r in exclusive_sum(df, "x", df.k).orderBy("k").collect()] == want


def test_quantisation(spark):
    from pyspark.sql import functions as F

    from silkgraph.functions.scalar import quantise

    row = spark.sql("select 0.29D a, -0.456D b, 1.0D c, 0.999D d").select(*[quantise(F.col(x)) for x in "abcd"]).first()
    assert list(row)[1:] == [-450, 0, 990] and row[0] in (280, 290)


def test_classifiers_on_a_clear_case(spark):
    rows = spark.createDataFrame([(i, [0.9, 0.1] if i % 2 else [0.1, 0.9], i % 2) for i in range(40)], "row_id long, x array<double>, label int")
    for f in (classify.centroid_predict, classify.nb_predict, classify.logreg_predict):
        assert classify.accuracy(f(rows, rows), rows).first()["accuracy"] == 1.0
    assert classify.first_rows(rows, 5).count() == 5
    assert classify.non_negative(rows).count() == 40


def test_sequential_fits(spark):
    import random
    from math import exp, sqrt

    rnd = random.Random(8)
    data = [([rnd.random() for _ in range(5)], 0) for _ in range(70)]
    data = [(x, int(x[0] + x[1] > x[2] + 0.5)) for x, _ in data]
    rows = spark.createDataFrame([(i, x, y) for i, (x, y) in enumerate(data)], "row_id long, x array<double>, label int").repartition(3)
    w = [0.25] * 5
    for at in range(0, 70, 8):
        g = [0.0] * 5
        for x, y in data[at : at + 8]:
            miss = 1 / (1 + exp(-sum(a * b for a, b in zip(x, w, strict=True)))) - y
            g = [a + miss * b for a, b in zip(g, x, strict=True)]
        w = [a - 0.05 * b for a, b in zip(w, g, strict=True)]
    got = {r["row_id"]: r for r in classify.sgd_predict(rows, rows, 70, rate=0.05).collect()}
    for i, (x, _) in enumerate(data):
        score = sum(a * b for a, b in zip(x, w, strict=True))
        assert abs(got[i]["score"] - score) < 1e-6 and got[i]["pred"] == (score >= 0)
    mean = [sum(x[j] for x, _ in data[:64]) / 64 for j in range(5)]
    scale = [sqrt(sum((x[j] - mean[j]) ** 2 for x, _ in data[:64]) / 64) for j in range(5)]
    z = lambda x: [*[(a - b) / c for a, b, c in zip(x, mean, scale, strict=True)], 1.0]
    w, g = [0.0] * 6, [0.0] * 6
    for _ in range(2):
        for at in (0, 32):
            parts = [(z(x), 1 / (1 + exp(-sum(a * b for a, b in zip(z(x), w, strict=True)))) - y) for x, y in data[at : at + 32]]
            g = [a + sum(m * x[j] for x, m in parts) / 32 for j, a in enumerate(g)]
            w = [a - 0.4 * b for a, b in zip(w, g, strict=True)]
    got = {r["row_id"]: r for r in classify.zscore_sgd_predict(rows, rows, 64).collect()}
    assert all(abs(got[i]["score"] - sum(a * b for a, b in zip(z(x), w, strict=True))) < 1e-6 for i, (x, _) in enumerate(data))
    assert sum(got[i]["pred"] == y for i, (_, y) in enumerate(data)) >= 60
    assert classify.zscore_sgd_predict(rows.limit(0), rows).count() == 70


def test_shared_folder_must_be_named_on_a_cluster(spark):
    from silkgraph.sources import shared

    assert shared.is_local("local[4]") and shared.is_local("local") and not shared.is_local("local-cluster[2,1,1024]") and not shared.is_local("yarn")
    kept = shared.materialize(spark.range(3), "t")
    assert kept.count() == 3 and kept.kept_at.startswith(shared.shared_base(spark))
    shared.remove(kept)
    assert not os.path.exists(urlparse(kept.kept_at).path)


def test_leaderboard_defaults(spark, tmp_path):
    full = {"score": 3.5, "teamName": "a", "submitTime": "t", "userList": [{"domainName": "x"}, {}]}
    bodies = [(1, json.dumps({"result": {"teamRankingList": {"results": [full, {}]}}})), (2, "not json"), (3, None)]
    got = leaderboard.flatten(spark.createDataFrame(bodies, "division int, body string")).collect()
    assert [tuple(r) for r in got] == [(1, 3.5, "a", ["x", "null"], "t"), (1, -1.0, "null", [], "null")]
    more = spark.createDataFrame([(0, 1.0, 'q "x", y', ["u"], "t")], "division int, score double, team_name string, users array<string>, submit_time string")
    sinks.write_leaderboard(leaderboard.flatten(spark.createDataFrame(bodies, "division int, body string")).unionByName(more), str(tmp_path / "l.csv"))
    assert (tmp_path / "l.csv").read_bytes().decode("utf-8-sig").splitlines() == ["division,score,team_name,users,submit_time", '0,1.0,"q ""x"", y",u,t', "1,3.5,a,x null,t", "1,-1.0,null,,null"]
    assert (tmp_path / "l.csv").read_bytes()[:3] == b"\xef\xbb\xbf"
    (tmp_path / "7").write_text(bodies[0][1] + "\n")
    assert [tuple(r)[:2] for r in leaderboard.read_leaderboard(spark, str(tmp_path / "7")).collect()] == [("7", 3.5), ("7", -1.0)]


def test_streamed_activity_and_degrees(spark, tmp_path):
    spark.sql("select timestamp '2024-01-01 00:10:00' ts, 'a' event_type, 1.5D value union all select timestamp '2024-01-01 00:20:00', 'a', 2.0D").write.parquet(str(tmp_path / "in"))
    q = live.activity(live.stream_table(spark, str(tmp_path / "in"))).writeStream.outputMode("complete").format("memory").queryName("act").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c1")).start()
    q.awaitTermination(60)
    assert [(r["event_type"], r["n"], r["total"]) for r in spark.table("act").collect()] == [("a", 2, 3.5)]
    spark.createDataFrame([(1, 2), (1, 3)], "u long, v long").write.parquet(str(tmp_path / "e"))
    q = live.running_degrees(live.stream_table(spark, str(tmp_path / "e"))).writeStream.outputMode("complete").format("memory").queryName("deg").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c2")).start()
    q.awaitTermination(60)
    assert sorted(map(tuple, spark.table("deg").collect())) == [(1, 2, 0), (2, 0, 1), (3, 0, 1)]
