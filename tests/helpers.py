"""Comparison of a query with its SQL, and small plain-Python references."""

import os
import random

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SMALL = "/root/testdata/sf0.001"


def duck(sf):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        f = f"{sf}/{t}.parquet"
        con.execute(f"create view {t} as select * from '{f if os.path.isfile(f) else f + '/*.parquet'}'")
    return con


def rows(pdf, columns):
    clean = pdf[columns].astype(object).where(pdf[columns].notna(), None)
    return sorted(tuple(str(x) for x in r) for r in clean.itertuples(index=False, name=None))


def assert_same(df, sql, sf):
    got, want = df.toPandas(), duck(sf).execute(sql).fetchdf()
    assert sorted(got.columns) == sorted(want.columns)
    columns = sorted(got.columns)
    assert rows(got, columns) == rows(want, columns)


def random_edges(seed, n=9, m=26, top=30):
    rnd = random.Random(seed)
    return [(rnd.randrange(n), rnd.randrange(n), rnd.randrange(0, top)) for _ in range(m)]


def brute_cycles(edges, ratio):
    best = {}
    for u, v, w in edges:
        if u != v and (w > 0 or not ratio):
            best[u, v] = max(w, best.get((u, v), w))
    out = set()

    def ok(x, y):
        return not ratio or (x <= 5 * y and y <= 3 * x)

    def walk(path, amounts):
        for (u, v), w in best.items():
            if u != path[-1] or amounts and not ok(amounts[-1], w):
                continue
            if v == path[0] and len(path) >= 3 and ok(w, amounts[0]):
                out.add(tuple(path))
            elif v > path[0] and v not in path and len(path) < 7:
                walk([*path, v], [*amounts, w])

    for root in {u for u, _ in best}:
        walk([root], [])
    return out


def brute_betweenness(edges):
    from fractions import Fraction

    edges = [e for e in edges if e[2] > 0]
    nodes = sorted({x for u, v, _ in edges for x in (u, v)})
    far = 10**9
    dist = {(a, b): 0 if a == b else far for a in nodes for b in nodes}
    for u, v, w in edges:
        dist[u, v] = min(dist[u, v], w)
    for k in nodes:
        for a in nodes:
            for b in nodes:
                dist[a, b] = min(dist[a, b], dist[a, k] + dist[k, b])
    count = {}
    for s in nodes:
        for t in sorted((x for x in nodes if dist[s, x] < far), key=lambda x: dist[s, x]):
            count[s, t] = 1 if s == t else sum(count[s, u] for u, v, w in edges if v == t and u != v and dist[s, u] + w == dist[s, t])
    bc = dict.fromkeys(nodes, Fraction(0))
    for s in nodes:
        for t in nodes:
            if s != t and dist[s, t] < far:
                for v in nodes:
                    if v not in (s, t) and dist[s, v] + dist[v, t] == dist[s, t]:
                        bc[v] += Fraction(count[s, v] * count[v, t], count[s, t])
    return {k: round(float(v), 6) for k, v in bc.items()}
