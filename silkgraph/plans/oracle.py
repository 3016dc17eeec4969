"""DuckDB SQL for the queries, made apart from the Spark side."""

from __future__ import annotations

MULTI = "select l_suppkey u, l_partkey v, cast(floor(l_extendedprice) as bigint) w from lineitem where l_quantity <= 8 and floor(l_extendedprice) > 0"
#: The same rows of all quantities.
WHOLE = "select l_suppkey u, l_partkey v, cast(floor(l_extendedprice) as bigint) w from lineitem where floor(l_extendedprice) > 0"
EDGES = "select l_suppkey u, l_partkey v, max(cast(floor(l_extendedprice) as bigint)) w from lineitem where l_quantity <= 8 and l_suppkey <> l_partkey group by 1, 2"
FLOW = """select u, v, max(w) w from (select o_custkey u, lead(o_custkey) over (order by o_orderdate, o_orderkey) v, cast(floor(o_totalprice) as bigint) w from orders) where u <> v group by 1, 2"""


def ends(e: str = "e") -> str:
    return f"select u id from {e} union select v from {e}"


def pruned(edges: str = EDGES, rounds: int = 6, name: str = "p") -> str:
    """CTEs that end in ``name``; enough rounds for the test tables."""
    parts = [f"e0 as ({edges})"]
    parts += [f"e{i + 1} as (select * from e{i} where u in (select v from e{i}) and v in (select u from e{i}))" for i in range(rounds)]
    return ", ".join([*parts, f"{name} as (select * from e{rounds})"])


def _ratio(x: str, y: str) -> str:
    return f"{x} <= 5 * {y} and {y} <= 3 * {x}"


def cycle_select(n: int, ratio: bool, table: str = "p") -> str:
    """All cycles of ``n`` edges as ``len, path``, by a chain of joins."""
    conds = [f"a{n - 1}.v = a0.u"]
    for i in range(1, n):
        conds += [f"a{i}.u = a{i - 1}.v", f"a{i}.u > a0.u"]
        conds += [f"a{i}.u <> a{j}.u" for j in range(1, i)]
    if ratio:
        conds += [_ratio(f"a{i}.w", f"a{(i + 1) % n}.w") for i in range(n)]
    path = ", ".join(f"a{i}.u" for i in range(n))
    return f"select {n} len, [{path}] path from {', '.join(f'{table} a{i}' for i in range(n))} where {' and '.join(conds)}"


def path_text(select: str) -> str:
    return f"select cast(len as integer) len, array_to_string(path, ',') path from ({select})"


def cycles(lengths, ratio: bool, edges: str = EDGES) -> str:
    return f"with {pruned(edges)} " + path_text(" union all ".join(cycle_select(n, ratio) for n in lengths))


FEATURES = "f as (select vec_id id, cast(label >= 5 as integer) y, unnest(range(len(embedding))) d, cast(unnest(embedding) as double) x from embeddings)"


def quantise(x: str, digits: int) -> str:
    step = 10**digits
    return f"cast(sign({x}) as bigint) * (cast(trunc(abs({x}) * {step}) as bigint) % {step}) * {1000 // step}"


def quantised(digits: int, dims: int = 1 << 20) -> str:
    return f"{FEATURES}, q as (select id, y, d, {quantise('x', digits)} x from f where d < {dims})"


MEANS = "m as (select d, cast(trunc(sum(case when y = 0 then x end)) as bigint) // count(case when y = 0 then 1 end) m0, cast(trunc(sum(case when y = 1 then x end)) as bigint) // count(case when y = 1 then 1 end) m1 from q group by d)"
CENTROID = f"with {quantised(2)}, {MEANS}, s as (select q.id, cast(sum((2 * x - (m0 + m1)) * (m0 - m1)) as bigint) score from q join m on m.d = q.d group by q.id)"

_SP = """hop as (select s, s v, 0 k, cast(0 as bigint) d from n union all select h.s, e.v, h.k + 1, min(h.d + e.w) from hop h join e on h.v = e.u where h.k < 16 group by h.s, e.v, h.k),
d as materialized (select s, v, min(d) d from hop group by 1, 2),
dag as materialized (select a.s, e.u, e.v, count(*) m from d a join e on a.v = e.u join d b on b.s = a.s and b.v = e.v and b.d = a.d + e.w group by 1, 2, 3),
sg as (select s, s v, cast(1 as double) c from n union all select f.s, g.v, sum(f.c * g.m) from sg f join dag g on g.s = f.s and g.u = f.v group by 1, 2),
sig as materialized (select s, v, sum(c) c from sg group by 1, 2)"""
BETWEENNESS = f"""with recursive e as ({WHOLE} and l_suppkey <> l_partkey), n as (select u s from e union select v from e), {_SP},
mm as (select g.s, g.u, g.v, g.m * a.c / b.c x from dag g join sig a on a.s = g.s and a.v = g.u join sig b on b.s = g.s and b.v = g.v),
dl as (select s, u v, sum(x) c from mm group by 1, 2 union all select f.s, mm.u, sum(f.c * mm.x) from dl f join mm on mm.s = f.s and mm.v = f.v group by 1, 2)
select n.s id, round(coalesce(b.c, 0), 3) bc from n left join (select v, sum(c) c from dl where s <> v group by 1) b on b.v = n.s order by round(coalesce(b.c, 0), 3) desc, id limit 100"""
#: Sources of the path-count report: the suppliers.
SP_COUNTS = f"""with recursive e as ({WHOLE} and l_suppkey <> l_partkey), n as (select u s from e union select v from e), {_SP}
select d.s, d.v, d.d dist, round(sig.c, 3) sigma from d join sig on sig.s = d.s and sig.v = d.v where d.s in (select u from e)"""
SSSP = f"""with recursive e as ({MULTI}), h as (select cast(1 as bigint) v, 0 k, cast(0 as bigint) d union all select e.v, h.k + 1, min(h.d + e.w) from h join e on e.u = h.v where h.k < 16 group by 1, 2)
select v, min(d) dist from h group by v"""
WEAK = f"""with recursive e as ({EDGES}), b as (select u, v from e union select v, u from e), r as (select u a, u b from b union select r.a, b.v from r join b on b.u = r.b)
select a id, min(b) component from r group by a"""
REACH = f"p0 as (select distinct u, v from p), r as (select u a, v b from p0 union select r.a, p0.v from r join p0 on p0.u = r.b)"
SCC_CORE = f"with recursive {pruned()}, {REACH}, l as (select x.a id, min(x.b) scc from r x join r y on y.a = x.b and y.b = x.a group by x.a), ids as ({ends('e0')}), z as (select ids.id, coalesce(least(l.scc, ids.id), ids.id) scc from ids left join l on l.id = ids.id)"



def contracted(edges: str, rounds: int = 6) -> str:
    """Peeling, round by round, as CTEs; ``h`` heads, ``o`` their out-edges, ``c`` what has been passed on."""
    parts = [f"g0 as materialized ({edges})", "c0 as (select cast(0 as bigint) id, cast(0 as bigint) label where false)"]
    for i in range(rounds):
        parts += [
            f"o{i} as materialized (select u id, count(*) d, max(v) t, coalesce(max(label), 0) label from g{i} left join c{i} on c{i}.id = u where u not in (select v from g{i}) group by u)",
            f"c{i + 1} as materialized (select id, cast(sum(label) as bigint) label from (select id, label from c{i} union all select t, label + 1 from o{i} where d = 1) group by id)",
            f"g{i + 1} as materialized (select * from g{i} where u not in (select id from o{i}))",
        ]
    return f"with {', '.join(parts)} " + " union all ".join(f"select id, label from o{i} where d = 1" for i in range(rounds))


REVERSED = "select l_partkey u, l_suppkey v from lineitem where l_quantity <= 8 and l_suppkey <> l_partkey group by 1, 2"

ORACLES = {
    "transfers_scan": MULTI,
    "transfers_filtered": f"with {pruned(rounds=0)} select u, v, w from p",
    "vertex_set": f"with e as ({EDGES}) {ends()}",
    "degrees": f"with e as ({EDGES}), n as ({ends()}) select id, cast((select count(*) from e where u = id) as bigint) out_deg, cast((select count(*) from e where v = id) as bigint) in_deg from n",
    "twohop_cardinality": f"with e as ({EDGES}) select a.u id, count(*) n_two from e a join e b on a.v = b.u group by a.u",
    "graph_profile": f"with e as ({EDGES}), n as ({ends()}) select count(*) n_edges, max(w) max_w, cast(sum(w) as bigint) sum_w, count(distinct u) n_sources, count(distinct v) n_targets, (select count(*) from n) n_vertices, count(*) <= 10 * (select count(*) from n) sparse from e",
    "vertex_dense_rank": f"with e as ({EDGES}), n as ({ends()}) select id, row_number() over (order by id) - 1 rank from n",
    "csr_offsets": f"with e as ({EDGES}), n as ({ends()}), d as (select n.id, count(e.u) deg from n left join e on e.u = n.id group by n.id) select id, deg, cast(coalesce(sum(deg) over (order by id rows between unbounded preceding and 1 preceding), 0) as bigint) \"offset\" from d",
    "topo_prune": f"with {pruned()} select u, v, w from p",
    "two_hop_paths": f"with {pruned()} select a.u, a.v m, b.v, a.w w1, b.w w2 from p a join p b on a.v = b.u where a.u <> b.v",
    "two_hop_ratio": f"with {pruned()} select a.u, a.v m, b.v, a.w w1, b.w w2 from p a join p b on a.v = b.u where a.u <> b.v and {_ratio('a.w', 'b.w')}",
    "reverse_reach_3": f"with {pruned()}, r1 as (select distinct v root, u id from p where u > v), r2 as (select distinct r1.root, p.u id from r1 join p on p.v = r1.id where p.u > r1.root), r3 as (select distinct r2.root, p.u id from r2 join p on p.v = r2.id where p.u > r2.root) select root, id, min(h) hops from (select *, 1 h from r1 union all select *, 2 from r2 union all select *, 3 from r3) group by 1, 2",
    "ratio_cycles_all": cycles(range(3, 8), True),
    "cycle_counts": f"with {pruned()}, c as ({' union all '.join(f'select {n} len, count(*) n from ({cycle_select(n, False)})' for n in range(3, 8))}) select cast(len as integer) len, n from c union all select 0, cast(sum(n) as bigint) from c",
    "ratio_cycle_counts": f"with {pruned()}, c as ({' union all '.join(f'select {n} len, count(*) n from ({cycle_select(n, True)})' for n in range(3, 8))}) select cast(len as integer) len, n from c union all select 0, cast(sum(n) as bigint) from c",
    "cycle_report": f"with {pruned()}, c as ({' union all '.join(cycle_select(n, True) for n in range(3, 8))}) select cast(row_number() over (order by len, path) as integer) \"row\", array_to_string(path, ',') line from c union all select 0, cast(count(*) as varchar) from c",
    "flow_cycles_len4": cycles([3, 4], True, FLOW),
    "weak_components": WEAK,
    "component_sizes": f"with recursive {WEAK.removeprefix('with recursive ').split('select a id')[0].strip()}, c as (select a id, min(b) component from r group by a), s as (select component, count(*) n_vertices from c group by 1), t as (select component, count(*) n_edges, cast(sum(w) as bigint) sum_w from e join c on c.id = e.u group by 1) select s.component, n_vertices, coalesce(n_edges, 0) n_edges, coalesce(sum_w, 0) sum_w from s left join t on t.component = s.component",
    "scc_labels": f"{SCC_CORE} select id, scc from z",
    "scc_condensed_degree": f"{SCC_CORE}, l2 as (select distinct a.scc a, b.scc b from e0 join z a on a.id = e0.u join z b on b.id = e0.v where a.scc <> b.scc) select scc, count(*) size, cast((select count(*) from l2 where b = scc) as bigint) in_deg, cast((select count(*) from l2 where a = scc) as bigint) out_deg from z group by scc",
    "sssp_from_1": SSSP,
    "sp_counts": SP_COUNTS,
    "betweenness_top100": BETWEENNESS,
    "contracted_sources": contracted(REVERSED),
    "centroids": f"with {quantised(2)}, {MEANS} select cast(d as integer) dim, m0, m1 from m",
    "centroid_predict": f"{CENTROID} select id row_id, score, cast(score < 0 as integer) pred from s",
    "centroid_l1_predict": f"with {quantised(1, 48)}, {MEANS}, s as (select q.id, cast(sum(abs(x - m1) - abs(x - m0)) as bigint) score from q join m on m.d = q.d group by q.id) select id row_id, score, cast(score < 300 as integer) pred from s",
    "linear_quantile_predict": f"with {quantised(1)}, {MEANS}, s as (select q.id, cast(sum(x * (m1 - m0)) as bigint) score from q join m on m.d = q.d group by q.id), c as (select score from (select score, row_number() over (order by score) - 1 k from s) where k = (select cast(floor(0.047 * count(*)) as bigint) from s)) select id row_id, score, cast(score >= (select score from c) as integer) pred from s",
    "signed_sum_predict": f"with {quantised(1)}, c as (select d, cast(sum(case when y = 1 then x else -x end) as bigint) c from q group by d), t as (select d, (select count(*) from c) * c - (select cast(sum(c) as bigint) from c) w from c), s as (select q.id, cast(sum(x * w) as bigint) score from q join t on t.d = q.d group by q.id), k as (select score from (select score, row_number() over (order by score) - 1 k from s) where k = (select cast(floor(0.32 * count(*)) as bigint) from s)) select id row_id, cast(score > (select score from k) as integer) pred from s",
    "nb_predict": f"with {quantised(1)}, q2 as (select id, y, d, greatest(x, 0) x from q), c as (select d, sum(case when y = 1 then x else 0 end) s1, sum(case when y = 0 then x else 0 end) s0 from q2 group by d), w as (select d, ln(s1 + 1) - ln((select sum(s1) from c) + 1) - ln(s0 + 1) + ln((select sum(s0) from c) + 1) w from c), b as (select ln(count(case when label >= 5 then 1 end)) - ln(count(case when label < 5 then 1 end)) b from embeddings), s as (select id, sum(x * w) + (select b from b) score from q2 join w on w.d = q2.d group by id) select id row_id, cast(score > 0 as integer) pred from s",
    "predict_accuracy": f"{CENTROID}, y as (select vec_id id, cast(label >= 5 as integer) y from embeddings) select count(*) n, cast(sum(case when (s.score < 0) = (y.y = 1) then 1 else 0 end) as bigint) n_right, round(cast(sum(case when (s.score < 0) = (y.y = 1) then 1 else 0 end) as double) / count(*), 6) accuracy from s join y on y.id = s.id",
    "confusion": f"{CENTROID}, y as (select vec_id id, cast(label >= 5 as integer) y from embeddings) select y.y label, cast(s.score < 0 as integer) pred, count(*) n from s join y on y.id = s.id group by 1, 2",
    "zscore_stats": f"with {FEATURES} select cast(d as integer) dim, round(avg(x), 6) mean, round(var_samp(x), 6) \"var\" from f group by d",
    "leaderboard_flatten": "select conv_id % 4 division, case when count(*) % 2 = 0 then cast(count(*) as double) else -1.0 end score, 'team-' || conv_id team_name, string_agg(role, ' ' order by turn) users, 'null' submit_time from conversations group by conv_id",
}
for _n in range(3, 8):
    ORACLES[f"cycles_len{_n}"] = cycles([_n], False)
    ORACLES[f"ratio_cycles_len{_n}"] = cycles([_n], True)
for _n in range(5, 8):
    ORACLES[f"flow_cycles_len{_n}"] = cycles([_n], True, FLOW)
ORACLES["flow_plain_cycles"] = cycles(range(3, 6), False, FLOW)
ORACLES["sp_counts_all"] = SP_COUNTS.replace(WHOLE, MULTI).removesuffix(" where d.s in (select u from e)")

RAW = "select l_suppkey u, l_partkey v, greatest(0, cast(floor(l_quantity - 100 * l_discount) as bigint)) w from lineitem where l_quantity <= 8"
_ROUNDED = "x as (select vec_id, [cast(round(cast(v as double) * 100) as bigint) for v in embedding[1:6]] a from embeddings)"
_BITS = "case when a[1] = 0 then 0 else length(bin(abs(a[1]))) end"
ORACLES |= {
    "transfers_in_id_range": f"select * from ({MULTI}) where u < 1000 and v < 1000",
    "transfers_without_zero": f"select u, v, max(w) w from ({RAW}) where w > 0 and u <> v group by u, v",
    "reachable_counts": f"with recursive e as ({EDGES}), n as ({ends()}), r as (select u a, v b from e union select r.a, e.v from r join e on e.u = r.b) select id, count(r.b) n_reached from n left join r on r.a = n.id and r.b <> n.id group by id",
    "centroid_shortcut_predict": f"{CENTROID} select s.id row_id, score, cast(score < 0 or q.x >= 200 as integer) pred from s join q on q.id = s.id and q.d = 0",
    "array_products": f"""with {_ROUNDED} select vec_id row_id, concat_ws(',', a[1] * a[1] + a[2] * a[2] + a[3] * a[3], a[4] * a[1] + a[5] * a[2] + a[6] * a[3]) product,
  concat_ws(',', a[1] * a[3], a[1] * a[4], a[2] * a[3], a[2] * a[4]) "outer", concat_ws(',', a[1], a[4], a[2], a[5], a[3], a[6]) transposed,
  concat_ws(',', a[1] * a[1] + a[2] * a[2] + a[3] * a[3], a[1] * a[4] + a[2] * a[5] + a[3] * a[6], a[1] * a[4] + a[2] * a[5] + a[3] * a[6], a[4] * a[4] + a[5] * a[5] + a[6] * a[6]) squared,
  cast({_BITS} as integer) bits, round(case when a[1] >= 0 then sqrt(a[1]) end, 6) root from x""",
}
