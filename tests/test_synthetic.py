from rankflow.operators import work
from rankflow.sources import synthetic


def test_every_end_and_block_exists(spark):
    t = synthetic.graph(spark)
    ids = t.task.select("task_id")
    assert t.task.count() == ids.distinct().count() > 8 * 5 * 2
    assert {r.rank for r in t.task.select("rank").distinct().collect()} == set(range(8))
    ends = t.edge.selectExpr("explode(array(from_task, to_task)) AS task_id")
    assert t.edge.count() > 0 and ends.join(ids, "task_id", "left_anti").count() == 0
    assert t.task_block.join(t.block, "block_id", "left_anti").count() == 0
    assert t.task.where("load < 10 or load >= 20 or mem_working not between 1020 and 2048").count() == 0
    assert work.rank_load(t).where("n_tasks = 0").count() == 0


def test_seed_counts(spark):
    a, b = (synthetic.graph(spark, synthetic.Shape(ranks=3, seed=s)).edge for s in (1, 2))
    assert a.exceptAll(b).count() and not a.exceptAll(synthetic.graph(spark, synthetic.Shape(ranks=3, seed=1)).edge).count()
