"""Operators that must not make what grows with the square of the input: the same results as the plain way, on small odd graphs."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from rankflow import model
from rankflow.operators import clustering, graph


def shared(spark, seed, tasks=60, blocks=9, most=3, sizes=(1.0, 2.0, 3.0)):
    """Tasks of two ranks, each with up to `most` blocks (one task with all of them), many of equal bytes."""
    rnd = random.Random(seed)
    rows = [(i, rnd.randint(0, 1), 0, True, 1.0, 0.0, 0.0, 0.0) for i in rnd.sample(range(1000), tasks)]
    used = [(r[0], b) for r in rows for b in rnd.sample(range(blocks), rnd.randint(0, most))] + [(rows[0][0], b) for b in range(blocks)]
    none = model.empty_tables(spark)
    return model.Tables(spark.createDataFrame(rows, model.TASK), none.edge, spark.createDataFrame([(b, rnd.choice(sizes), 0) for b in range(blocks)], model.BLOCK), spark.createDataFrame(used, model.TASK_BLOCK), none.rank_info)


def plainly(t, edges):
    """gids by match_pairs over all edges."""
    rank, out = {r.task_id: r["rank"] for r in t.task.collect()}, {}
    rows = [(r.u, r.v, float(r.weight)) for r in edges.collect()]
    for k in set(rank.values()):
        of = clustering.match_pairs([x for x in rank if rank[x] == k], [e for e in rows if rank[e[0]] == k])
        out |= {x: n + k * model.MAX_CLUSTERS for x, n in of.items()}
    return out


@pytest.mark.parametrize("seed, most, sizes", [(1, 2, (1.0, 2.0, 3.0)), (2, 3, (0.0, 1.0)), (3, 8, (0.25, 0.5, 0.75)), (4, 2, (-1.0, 2.0))])
def test_block_matching_is_that_of_all_pairs(spark, seed, most, sizes):
    t = shared(spark, seed, most=most, sizes=sizes)
    got = {r.task_id: r.gid for r in clustering.block_matching(t).collect()}
    assert got == plainly(t, graph.coaccess(t))


def test_block_matching_faults_are_those_of_all_pairs(spark):
    t = shared(spark, 5)
    good = {r.task_id: (r["rank"], r.gid) for r in clustering.block_matching(t).collect()}
    ids = sorted(good)
    for k in (0, 2, 20):
        rnd, bad = random.Random(k), dict(good)
        for _ in range(k):  # two tasks of one rank change places
            x, y = rnd.sample([i for i in ids if good[i][0] == 0], 2)
            bad[x], bad[y] = bad[y], bad[x]
        c = spark.createDataFrame([(r, x, g) for x, (r, g) in bad.items()], "rank int, task_id long, gid long")
        got = tuple(clustering.block_matching_faults(t, c).first())
        assert got == tuple(clustering.matching_faults(t, graph.coaccess(t), c).first())
        assert (got == (60, 0, 0, 0)) == (k == 0)


def test_block_matching_makes_no_pairs(spark):
    """Twenty thousand tasks of one block have 200 million pairs."""
    none = model.empty_tables(spark)
    task = spark.range(20000).select(F.col("id").alias("task_id"), F.lit(0).alias("rank"))
    t = model.Tables(task, none.edge, spark.createDataFrame([(1, 8.0, 0)], model.BLOCK), task.select("task_id", F.lit(1).cast("long").alias("block_id")), none.rank_info)
    c = clustering.block_matching(t)
    assert c.where("gid = floor(task_id / 2)").count() == 20000
    assert tuple(clustering.block_matching_faults(t, c).first()) == (20000, 0, 0, 0)


def linked(spark, seed):
    """Tasks of two ranks with edges of few different volumes."""
    rnd = random.Random(seed)
    rows = [(i, rnd.randint(0, 1), 0, True, 1.0, 0.0, 0.0, 0.0) for i in rnd.sample(range(1000), 60)]
    edges = {(rnd.choice(rows)[0], rnd.choice(rows)[0]): float(rnd.randint(1, 9)) for _ in range(500)}
    none = model.empty_tables(spark)
    return model.Tables(spark.createDataFrame(rows, model.TASK), spark.createDataFrame([(*e, w) for e, w in edges.items()], model.EDGE), none.block, none.task_block, none.rank_info)


def test_matching_keeps_no_edges(spark):
    t = linked(spark, 6)
    assert {r.task_id: r.gid for r in clustering.communication_matching(t).collect()} == plainly(t, graph.undirected(t))
    one = clustering.PairMatching()
    for k in range(20):
        one.feed(pa.RecordBatch.from_pydict({"u": [0] * 1000, "v": list(range(1000 * k + 1, 1000 * k + 1001))}))
    assert one.taken == {0, 1}


def test_potts_over_rows_is_potts_over_edges(spark):
    t = linked(spark, 7)
    rank, got = {r.task_id: r["rank"] for r in t.task.collect()}, {r.task_id: r.gid for r in clustering.potts_clusters(t, 3.0).collect()}
    edges = [(r.u, r.v, r.weight) for r in graph.undirected(t).collect()]
    for k in (0, 1):
        of = clustering.potts([x for x in rank if rank[x] == k], [e for e in edges if rank[e[0]] == k], 3.0)
        assert {x: n + k * model.MAX_CLUSTERS for x, n in of.items()} == {x: g for x, g in got.items() if rank[x] == k}
    assert len(set(got.values())) < len(got)


def test_potts_looks_again_only_where_something_changed():
    """Cliques of five in a ring: all nodes are looked at twice, then none, where each pass went over all."""
    seen = 0

    class Near(np.ndarray):
        def tolist(self):
            nonlocal seen
            seen += 1
            return super().tolist()

    n = 500
    rows = [[y for y in range(x // 5 * 5, x // 5 * 5 + 5) if y != x] + ([(x + 5) % n, (x - 5) % n] if x % 5 == 0 else []) for x in range(n)]
    near = np.array([y for r in rows for y in sorted(r)], dtype=np.int32)
    ptr = np.r_[0, np.cumsum([len(r) for r in rows])]
    of = clustering._moves(ptr, near.view(Near), np.full(len(near), 20.0), [1] * n, list(range(n)), 5.0, 10)
    assert len(set(of.tolist())) == 100 and seen <= 3 * n
