"""Strongly connected components, levels and orders against textbook algorithms."""

import random

import pytest

from tallyframe.plans import graphs, portfolio


def tarjan(edges):
    """Smallest node of its component for every node on a cycle (iterative)."""
    after, nodes = {}, set()
    for a, b in edges:
        after.setdefault(a, []).append(b)
        nodes |= {a, b}
    index, low, stack, on, out, n = {}, {}, [], set(), {}, 0
    for start in sorted(nodes):
        if start in index:
            continue
        work = [(start, iter(after.get(start, ())))]
        index[start] = low[start] = n
        n += 1
        stack.append(start)
        on.add(start)
        while work:
            node, rest = work[-1]
            for x in rest:
                if x not in index:
                    index[x] = low[x] = n
                    n += 1
                    stack.append(x)
                    on.add(x)
                    work.append((x, iter(after.get(x, ()))))
                    break
                if x in on:
                    low[node] = min(low[node], index[x])
            else:
                work.pop()
                if work:
                    low[work[-1][0]] = min(low[work[-1][0]], low[node])
                if low[node] == index[node]:
                    own = []
                    while True:
                        x = stack.pop()
                        on.discard(x)
                        own.append(x)
                        if x == node:
                            break
                    if len(own) > 1 or node in after.get(node, ()):
                        out |= dict.fromkeys(own, min(own))
    return out


def frame(spark, edges):
    return spark.createDataFrame(edges, "src bigint, dst bigint")


@pytest.mark.parametrize("seed", [1, 2])
def test_small_graphs(spark, seed):
    r = random.Random(seed)
    edges = [(r.randrange(40), r.randrange(40)) for _ in range(46)] + [(100, 101), (101, 100), (101, 101), (200, 200), (200, 201)] + [(300 + i, 300 + (i + 1) % 12) for i in range(12)]
    got = {x.node: x.component for x in graphs.components(frame(spark, edges + edges[:5])).collect()}
    assert got == tarjan(edges)


def test_many_edges(spark):
    r = random.Random(3)
    edges = [(r.randrange(60_000), r.randrange(60_000)) for _ in range(100_000)]
    assert {x.node: x.component for x in graphs.components(frame(spark, edges)).collect()} == tarjan(edges)


@pytest.mark.parametrize("seed", [4])
def test_long_rings_and_paths(spark, seed, monkeypatch):
    """Rounds don't grow with the length of a ring or path; more written tables than these would be a round for each node."""
    r, written = random.Random(seed), 0

    def counted(df, label, cut=graphs.cut):
        nonlocal written
        written += 1
        assert written < 400
        return cut(df, label)

    monkeypatch.setattr(graphs, "cut", counted)
    edges = [(i, (i + 1) % 600) for i in range(600)]  # a ring with paths into and out of it, and between it and another
    edges += [(10_000 + i, 10_001 + i) for i in range(300)] + [(10_300, 7), (500, 20_000)] + [(20_000 + i, 20_001 + i) for i in range(300)] + [(20_300, 20_100)]
    edges += [(30_000 + i, 30_000 + r.randrange(400)) for i in range(400)] + [(40_000, 40_001), (40_001, 40_000), (40_002, 40_002), (40_001, 40_002)]
    names = list(range(50_000))
    r.shuffle(names)
    edges = [(names[a], names[b]) for a, b in edges]
    assert {x.node: x.component for x in graphs.components(frame(spark, edges)).collect()} == tarjan(edges)


def test_empty_and_nulls(spark):
    assert graphs.components(frame(spark, [])).collect() == []
    assert graphs.components(frame(spark, [(None, 1), (1, None), (1, 2)])).collect() == []


def test_orders(spark):
    edges = [(1, 2), (2, 3), (1, 3), (4, 5), (5, 4), (5, 6), (7, 7), (8, 1), (3, 99)]
    nodes = spark.createDataFrame([(i,) for i in range(1, 10)], "node bigint")
    up = {x.node: x.level for x in graphs.levels(frame(spark, edges), nodes).collect()}
    assert up == {3: 0, 2: 1, 1: 2, 8: 3, 6: 0, 9: 0, 4: -1, 5: -1, 7: -1}
    order = [x.node for x in graphs.callees_first(frame(spark, edges), nodes).orderBy("position").collect()]
    assert order == [4, 5, 6, 7, 3, 2, 1, 8, 9]  # what cycles lead to first, then from the last peeled to the roots


def test_programs_are_walked_in_batches(spark):
    """What each of many small programs reaches, without a Python group for each."""
    edges = spark.createDataFrame([(f"P{k}", a, b) for k in range(300) for a, b in (("A", "B"), ("B", "C"), ("C", "A"), ("D", "A"))] + [("LONE", "X", "Y")], "program string, src string, dst string")
    seeds = spark.createDataFrame([(f"P{k}", "B" if k % 2 else "D") for k in range(300)] + [("EMPTY", "Z")], "program string, node string")
    got = portfolio.reachable(edges, seeds)
    want = {(f"P{k}", n) for k in range(300) for n in ("ABC" if k % 2 else "ABCD")} | {("EMPTY", "Z")}
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)
    assert "InPandas" not in got._jdf.queryExecution().toString()


def test_perform_cycles_of_one_program(spark):
    """Each program's paragraphs on cycles, in as few jobs for many programs as for one."""
    r = random.Random(5)
    rows, want = [], set()
    for k in range(60):
        edges = [(r.randrange(12), r.randrange(12)) for _ in range(r.randrange(1, 22))]
        rows += [(f"P{k}", f"N{a}", f"N{b}", "PERFORM") for a, b in edges] + [(f"P{k}", f"N{r.randrange(12)}", "N0", "GO TO"), (f"P{k}", None, "N0", "PERFORM")]
        want |= {(f"P{k}", f"N{n}") for n in tarjan(edges)}
    # a long ring of paragraphs, with a tail
    rows += [("RING", f"N{n}", f"N{(n + 1) % 5000}", "PERFORM") for n in range(5000)] + [("RING", "T", "N0", "PERFORM")]
    want |= {("RING", f"N{n}") for n in range(5000)}
    edges = spark.createDataFrame(rows, "program string, src string, dst string, kind string")
    spark.sparkContext.setJobGroup("cycles", "cycles")
    got = [tuple(x) for x in portfolio.perform_cycles(edges).collect()]
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("cycles"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert sorted(got) == sorted(want)
    assert jobs <= 3
