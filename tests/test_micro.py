"""A graph of four tasks on three ranks, with answers worked out by hand."""

import random

import pytest
from pyspark.sql import functions as F

from rankflow import model
from rankflow.config import CMF, BalanceConfig, Criterion, Ordering, WorkModel
from rankflow.operators import clustering, clusters, graph, rebalance, rules, whatif, work
from rankflow.operators.rebalance import decide

M = WorkModel(1.0, 0.5, 0.1, 0.01)


@pytest.fixture(scope="module")
def t(spark):
    task = [(1, 0, 0, True, 10.0, 5.0, 1.0, 2.0), (2, 0, 0, True, 20.0, 7.0, 1.0, 1.0), (3, 0, 0, True, 30.0, 2.0, 2.0, 3.0), (4, 1, 1, True, 6.0, 4.0, 1.0, 1.0)]
    edge = [(1, 2, 5.0), (2, 4, 7.0), (4, 3, 11.0), (3, 1, 2.0)]
    return model.Tables(
        spark.createDataFrame(task, model.TASK),
        spark.createDataFrame(edge, model.EDGE),
        spark.createDataFrame([(100, 50.0, 0), (101, 40.0, 1)], model.BLOCK),
        spark.createDataFrame([(1, 100), (2, 100), (2, 101), (4, 101)], model.TASK_BLOCK),
        spark.createDataFrame([(r, 0.0, None) for r in range(3)], model.RANK_INFO),
    )


def test_work(t):
    got = {r["rank"]: (r.compute, r.recv, r.send, r.intra, r.shared, round(r.work, 6)) for r in work.work_breakdown(t, M).collect()}
    assert got == {0: (60, 11, 7, 7, 40, 66.6), 1: (6, 7, 11, 0, 0, 11.5), 2: (0, 0, 0, 0, 0, 0)}
    assert {r["rank"]: r.usage for r in work.memory_usage(t).collect()} == {0: 104, 1: 46, 2: 0}
    s = work.statistics(work.work_breakdown(t, M), "work").first()
    assert (s.min_v, round(s.max_v, 6), round(s.imbalance, 9)) == (0, 66.6, 1.558258643)


def test_zero_weights_read_no_edges(t):
    plan = work.work_breakdown(t, WorkModel())._jdf.queryExecution().optimizedPlan().toString()
    assert "volume" not in plan and "block_id" not in plan


def given(t, spark):
    return spark.createDataFrame([(0, 1, 0), (0, 2, 0), (0, 3, 1), (1, 4, model.MAX_CLUSTERS)], "rank int, task_id long, gid long")


def test_every_move_delta_is_a_recomputation(t, spark):
    c = given(t, spark)
    for r in whatif.cluster_move_work(t, c, M).collect():
        placed = t.task.join(c.select("task_id", "gid"), "task_id").select("task_id", F.when(F.col("gid") == r.gid, r.dst).otherwise(F.col("rank")).alias("rank"))
        now = {x["rank"]: x.work for x in work.work_breakdown(t.placed(placed), M).collect()}
        assert (r.after_src, r.after_dst) == pytest.approx((now[r.src], now[r.dst]))
    moved = [r for r in whatif.cluster_move_work(t, c, M).collect() if (r.gid, r.dst) == (0, 1)][0]
    assert (round(moved.after_src, 6), round(moved.after_dst, 6)) == (35.5, 43.2)


def test_memory_after_moves(t, spark):
    c = given(t, spark)
    for r in whatif.cluster_move_memory(t, c).collect():
        placed = t.task.join(c.select("task_id", "gid"), "task_id").select("task_id", F.when(F.col("gid") == r.gid, r.dst).otherwise(F.col("rank")).alias("rank"))
        assert r.usage == {x["rank"]: x.usage for x in work.memory_usage(t.placed(placed)).collect()}[r.dst]


@pytest.mark.parametrize("kind, want", [(Ordering.FewestMigrations, [3, 2, 1, 4]), (Ordering.SmallObjects, [2, 1, 3, 4]), (Ordering.LargestObjects, [4, 3, 2, 1]), (Ordering.ElmID, [1, 2, 3, 4])])
def test_orders(spark, t, kind, want):
    loads = [(1, 5.0), (2, 10.0), (3, 20.0), (4, 40.0)]
    one = model.Tables(spark.createDataFrame([(i, 0, 0, True, x, 0.0, 0.0, 0.0) for i, x in loads] + [(5, 1, 1, True, 45.0, 0.0, 0.0, 0.0)], model.TASK), t.edge, t.block, t.task_block, t.rank_info.where("rank < 2"))
    assert [r.task_id for r in rules.object_order(one, kind).orderBy("pos").collect()] == want


def test_decisions(t):
    tasks, load = [(1, 10.0, True), (2, 20.0, True), (3, 30.0, True)], {0: 60.0, 1: 6.0, 2: 0.0}
    assert decide(tasks, 0, load, 22.0, BalanceConfig())[0] == [(1, 1), (2, 1), (3, 2)]
    assert decide(tasks, 0, load, 22.0, BalanceConfig(criterion=Criterion.Grapevine)) == ([(1, 1)], 50.0)
    assert decide([(1, 10.0, False)], 0, load, 22.0, BalanceConfig()) == ([], 60.0)
    assert decide(tasks, 0, {0: 60.0}, 22.0, BalanceConfig()) == ([], 60.0)


@pytest.mark.parametrize("kind", list(CMF))
@pytest.mark.parametrize("beta", [0.0, 0.5])
def test_rebalance_keeps_tasks_and_lowers_the_top(t, kind, beta):
    cfg = BalanceConfig(num_iters=2, n_rounds=2, cmf_type=kind, work=WorkModel(beta=beta), based_on_communication=True)
    b = rebalance.rebalance(t, cfg)
    assert {r.task_id for r in b.assignment.collect()} == {1, 2, 3, 4}
    h = b.history.orderBy("iteration").collect()
    assert h[-1].max_work <= h[0].max_work


def test_graph_hygiene(t, spark):
    assert graph.symmetrize(t).count() == 6
    assert {tuple(r) for r in graph.undirected(t).collect()} == {(1, 2, 5.0), (1, 3, 2.0)}
    assert {tuple(r) for r in graph.coaccess(t).collect()} == {(1, 2, 50.0)}
    assert graph.purge_dangling(t.edge, t.task.where("task_id = 4")).count() == 2
    raw = spark.createDataFrame([(1, 2, 5.0, 1), (1, 2, 9.0, 2)], "from_task long, to_task long, volume double, seq long")
    assert [tuple(r) for r in graph.upsert_edges(raw).collect()] == [(1, 2, 9.0)]


def test_clusters(t, spark):
    c = given(t, spark)
    assert clusters.unclustered(t, c).count() == 0
    assert {r.gid: (r.intra, r.boundary) for r in clusters.boundary_bytes(t, c).collect()} == {0: (5, 9), 1: (0, 13), model.MAX_CLUSTERS: (0, 18)}
    assert clusters.summaries(t, c).count() == 3
    assert clusters.add_cluster(c.where("gid <> 1"), spark.createDataFrame([(0, 3)], "rank int, task_id long")).where("task_id = 3").first().gid == 1
    alone = clusters.add_cluster(c, spark.createDataFrame([(2, 9)], "rank int, task_id long")).where("task_id = 9").first().gid
    assert alone == 2 * model.MAX_CLUSTERS
    for f in (clustering.communication_matching, clustering.block_matching, clustering.potts_clusters):
        assert {r.task_id for r in f(t).collect()} == {1, 2, 3, 4}


def test_potts_joins_a_clique_and_splits_the_rest():
    edges = [(a, b, 10.0) for a in range(4) for b in range(a)] + [(3, 4, 1.0)]
    of = clustering.potts([0, 1, 2, 3, 4, 9], edges, 5.0)
    assert len({of[i] for i in range(4)}) == 1 and len({of[0], of[4], of[9]}) == 3
    assert clustering.potts([], [], 5.0) == {}


def test_potts_moves_follow_the_objective_at_every_level():
    def objective(edges, of, resolution):
        sizes = [list(of.values()).count(c) for c in set(of.values())]
        return sum(w for u, v, w in edges if of[u] == of[v]) - resolution * sum(n * (n - 1) / 2 for n in sizes)

    # eight cliques of five in a ring: counted as one each, they would join for a link of 8
    ring = [(5 * c + a, 5 * c + b, 10.0) for c in range(8) for a in range(5) for b in range(a)] + [(5 * c, (5 * c + 5) % 40 + 1, 8.0) for c in range(8)]
    of = clustering.potts(list(range(40)), ring, 5.0)
    assert {frozenset(x for x in of if of[x] == c) for c in of.values()} == {frozenset(range(5 * c, 5 * c + 5)) for c in range(8)}
    assert objective(ring, clustering.potts(list(range(40)), ring, 5.0, by_tasks=False), 5.0) < objective(ring, of, 5.0) == 400
    rnd = random.Random(3)
    for _ in range(20):
        edges = [(u, v, float(rnd.randint(1, 12))) for u in range(60) for v in range(u) if rnd.random() < 0.2]
        assert objective(edges, clustering.potts(list(range(60)), edges, 5.0), 5.0) >= 0
    # the move of a node of three tasks from a community of five to one of four
    before, after = {**dict.fromkeys(range(5), 0), **dict.fromkeys(range(5, 9), 1)}, {**dict.fromkeys(range(2), 0), **dict.fromkeys(range(2, 9), 1)}
    links = [(2, 0, 4.0), (3, 6, 9.0), (2, 3, 1.0)]
    assert clustering.move_gain(9, 4, 4, 5, 5.0, 3) == objective(links, after, 5.0) - objective(links, before, 5.0)


def test_blocks_without_information_raise(t):
    lacking = model.Tables(t.task, t.edge, t.block.where("block_id <> 101"), t.task_block, t.rank_info)
    with pytest.raises(Exception, match="shared block 101"):
        work.shared_bytes(lacking).collect()


def test_candidates_have_both_sides(t, spark):
    """Rank 0 is above the mean: it gives its clusters to either rank and may receive that of rank 1."""
    c = given(t, spark)
    got = {(r.initiator, r.gid, r.src, r.dst) for r in whatif.candidates(t, c, M).collect()}
    assert got == {(0, 0, 0, 1), (0, 0, 0, 2), (0, 1, 0, 1), (0, 1, 0, 2), (0, model.MAX_CLUSTERS, 1, 0)}
    known = spark.createDataFrame([(0, 0), (0, 2), (1, 0)], "knower int, known int")
    assert {(r.gid, r.dst) for r in whatif.candidates(t, c, M, known).collect()} == {(0, 2), (1, 2)}
    # all traffic and blocks of two ranks come together: receiving is what lowers the top
    near = model.Tables(
        spark.createDataFrame([(1, 0, 0, True, 10.0, 0.0, 0.0, 0.0), (2, 1, 1, True, 1.0, 0.0, 0.0, 0.0)], model.TASK), spark.createDataFrame([(1, 2, 1000.0)], model.EDGE), t.block, t.task_block.limit(0), t.rank_info
    )
    one = whatif.best(whatif.candidates(near, spark.createDataFrame([(0, 1, 0), (1, 2, model.MAX_CLUSTERS)], "rank int, task_id long, gid long"), M)).where("initiator = 0").first()
    assert (one.src, one.dst) == (1, 0) or one.src == 0 and one.improvement > 0


def test_alpha_scales_what_is_compared(t):
    cfg = BalanceConfig(work=WorkModel(rank_alpha=2.0))
    tasks, load = [(1, 10.0, True), (2, 20.0, True), (3, 30.0, True)], {0: 120.0, 1: 12.0, 2: 0.0}
    # 240 and 24 and 0 against a mean of 44: tasks count twice too, and what is left is above the mean by more
    moves, left = decide(tasks, 0, load, 44.0, cfg)
    assert [m[0] for m in moves] == [1, 2, 3] and left == 60.0
    assert decide(tasks, 0, {0: 21.0, 1: 0.0}, 44.0, cfg)[0] == []
    assert rebalance.rebalance(t, BalanceConfig(num_iters=1, n_rounds=1, work=WorkModel(rank_alpha=0.5))).assignment.count() == 4


def test_cluster_ids_differ_between_ranks(spark):
    task = spark.createDataFrame([(i, i % 2, 0, True, 1.0, 0.0, 0.0, 0.0) for i in range(4200)], model.TASK)
    none = model.empty_tables(spark)
    t = model.Tables(task, none.edge, none.block, none.task_block, spark.createDataFrame([(0, 0.0, None), (1, 0.0, None)], model.RANK_INFO))
    c = clustering.communication_matching(t)
    assert c.select("gid").distinct().count() == 4200
    assert c.where(clusters.rank_of(F.col("gid")) != F.col("rank")).count() == 0


def test_matching_faults_are_found(t, spark):
    good = clustering.communication_matching(t)
    assert tuple(clustering.matching_faults(t, graph.undirected(t), good).first()) == (4, 0, 0, 0)
    bad = spark.createDataFrame([(0, 1, 0), (0, 2, 1), (0, 3, 0), (1, 4, 9)], "rank int, task_id long, gid long")
    assert tuple(clustering.matching_faults(t, graph.undirected(t), bad).first()) == (4, 1, 0, 0)
    alone = spark.createDataFrame([(0, 1, 0), (0, 2, 1), (0, 3, 2), (1, 4, 9)], "rank int, task_id long, gid long")
    assert clustering.matching_faults(t, graph.undirected(t), alone).first().outranked > 0
