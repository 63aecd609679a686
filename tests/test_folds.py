"""What SQL cannot follow, against plain Python."""

import heapq

import pytest

from rulespark import catalog
from rulespark.operators import graph as G
from rulespark.operators import scores as S
from rulespark.plans.rulebase import edges, nodes

Q = catalog.queries()


@pytest.mark.parametrize("table,p", [((3, 1, 1, 3), 0.4857), ((1, 9, 11, 3), 0.00276), ((10, 0, 0, 10), 1.08e-5), ((5, 5, 5, 5), 1.0), ((0, 0, 0, 0), 1.0)])
def test_fisher(table, p):
    assert S.fisher_exact(*table) == pytest.approx(p, rel=5e-3)


def test_fisher_against_binomials():
    """Every small table, and some of thousands, by the definition."""
    import itertools
    import math

    def plain(a, b, c, d):
        n, row, col = a + b + c + d, a + b, a + c
        ways = [math.comb(row, x) * math.comb(n - row, col - x) for x in range(max(0, col - (n - row)), min(row, col) + 1)]
        seen = math.comb(row, a) * math.comb(n - row, col - a)
        return sum(w for w in ways if w <= seen) / math.comb(n, col)

    for t in [*itertools.product(range(6), repeat=4), (0, 40, 300, 2), (900, 1100, 1000, 1000), (1000, 1000, 1001, 1001), (17, 5003, 40, 4000), (2000, 10, 5, 3000)]:
        assert S.fisher_exact(*t) == pytest.approx(plain(*t), rel=1e-9, abs=1e-300)


def test_fisher_of_large_tables():
    """Work grows with the root of the counts; a table and its mirror images have the same p."""
    import time

    start = time.time()
    got = [S.fisher_exact(*t) for t in ((400_000, 100_000, 79_900, 20_100), (79_900, 20_100, 400_000, 100_000), (100_000, 400_000, 20_100, 79_900))]
    assert got == pytest.approx([got[0]] * 3, rel=1e-8) and 0.4 < got[0] < 0.5
    assert S.fisher_exact(300_000_000, 300_000_000, 300_000_000, 300_000_000) == 1
    assert S.fisher_exact(10**6, 0, 0, 10**6) == 0
    assert time.time() - start < 10


def test_fisher_query(spark):
    rows = Q["fisher_exact"](spark, "/root/testdata/sf0.01").collect()
    assert rows and all(r.p_value == pytest.approx(S.fisher_exact(r.n00, r.n01, r.n10, r.n11), abs=1e-7) for r in rows)


def test_merged_batches(spark, sf):
    rows, kept = spark.read.parquet(f"{sf}/orders.parquet").collect(), set()
    for bucket in range(20):
        ids, names = set(), set()
        for batch in range(4):
            new = [r for r in sorted(rows, key=lambda r: r.o_orderkey) if r.o_custkey % 20 == bucket and r.o_orderkey % 4 == batch and r.o_orderkey % 37 not in ids and r.o_orderkey % 53 not in names]
            ids |= {r.o_orderkey % 37 for r in new}
            names |= {r.o_orderkey % 53 for r in new}
            kept |= {r.o_orderkey for r in new}
    assert {r.pos for r in Q["merged_batches"](spark, sf).collect()} == kept


def test_packed_fragments(spark, sf):
    by = {}
    for r in Q["packed_fragments"](spark, sf).collect():
        by.setdefault((r.run, r.batch), []).append(r)
    for (run, batch), rows in by.items():
        assert len(rows) <= 8 and (len(rows) == 1 or (sum(r.claims for r in rows) <= 12 and sum(r.chars for r in rows) <= 4000))
        if batch:
            before, first = by[run, batch - 1], min(rows, key=lambda r: r.pos)
            assert max(r.pos for r in before) < first.pos
            assert len(before) == 8 or sum(r.claims for r in before) + first.claims > 12 or sum(r.chars for r in before) + first.chars > 4000


def graph_of(spark, sf):
    return sorted({(r.source, r.target) for r in edges(spark, sf).collect() if r.source != r.target}), sorted(r.node for r in nodes(spark, sf).collect())


def test_topological_order(spark, sf):
    pairs, known = graph_of(spark, sf)
    got, of = {}, {}
    for r in Q["topological_order"](spark, sf).collect():
        got.setdefault(r.component, {})[r.node] = r.place
        of[r.node] = r.component
    assert set(known) <= set(of)
    for c, places in got.items():
        mine = [(a, b) for a, b in pairs if of.get(a) == c]
        waits = {x: sum(b == x for _, b in mine) for x in places}
        ready, want = [x for x, n in waits.items() if not n], {}
        heapq.heapify(ready)
        while ready:
            x = heapq.heappop(ready)
            want[x] = len(want)
            for b in [b for a, b in mine if a == x]:
                waits[b] -= 1
                if not waits[b]:
                    heapq.heappush(ready, b)
        assert {x: p for x, p in places.items() if p is not None} == want


def test_dependency_chains(spark, sf):
    pairs, _ = graph_of(spark, sf)
    out = {}
    for a, b in pairs:
        out.setdefault(a, []).append(b)
    found, loops = [], set()

    def walk(path):
        longer = False
        for t in out.get(path[-1], []):
            if t in path:
                loops.add((*path[path.index(t) :], t))
            else:
                longer = True
                walk([*path, t])
        if not longer and len(path) > 1:
            found.append(tuple(path))

    nodes_ = {x for p in pairs for x in p}
    for root in sorted(nodes_ - {b for _, b in pairs}) or sorted(nodes_):
        walk([root])
    text = lambda p: ">".join(map(str, p))
    assert [(r.kind, r.nodes) for r in Q["dependency_chains"](spark, sf).collect()] == [("path", text(p)) for p in found[:5000]] + [("cycle", text(p)) for p in sorted(loops)]


def test_large_graphs_by_joins_give_the_same(spark, sf, monkeypatch):
    n = nodes(spark, sf)
    e = G.clean_edges(edges(spark, sf), n).where("status = 'used'").select("source", "target")
    start = n.where("node % 50 = 7")
    every = lambda: [sorted(map(tuple, x.collect())) for x in (G.components(e, n), G.reach(e, start), G.cycles(e))]
    small = every()
    monkeypatch.setattr(G, "SMALL", 3)
    assert every() == small


def test_a_cycle_has_no_levels(spark):
    e = spark.createDataFrame([(1, 2), (2, 1)], "source long, target long")
    with pytest.raises(ValueError):
        G.longest_levels(e, spark.createDataFrame([(1,), (2,)], "node long"))
