"""The registered queries over the part graph, each with its SQL oracle where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import CMF, BalanceConfig, Criterion, Ordering, WorkModel
from ..functions import dot
from ..functions.lineage import cut
from ..operators import clustering, clusters, gossip, graph, rebalance, rules, whatif, work
from ..sources import synthetic
from ..sources.part_graph import SQL, line_edges, part_graph
from ..streaming.phases import phase_loads

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
MODEL = WorkModel(rank_alpha=1.0, beta=0.5, gamma=0.1, delta=0.01)
DRAW = BalanceConfig().draw
RESOLUTION = 5.0


def _derived(task: str = "task", x: str = "") -> str:
    """Loads, bytes, blocks and work of ranks, with tasks placed as a table says."""
    return f"""rl{x} AS (SELECT r.rank, CAST(coalesce(sum(load),0) AS BIGINT) AS load, count(task_id) AS n FROM rank_info r LEFT JOIN {task} t ON t.rank=r.rank GROUP BY r.rank),
av{x} AS (SELECT CAST(sum(load) AS DOUBLE)/8 AS a FROM rl{x}),
er{x} AS (SELECT e.*, f.rank AS from_rank, g.rank AS to_rank FROM edge e LEFT JOIN {task} f ON f.task_id=from_task LEFT JOIN {task} g ON g.task_id=to_task),
cm{x} AS (SELECT r.rank, CAST(coalesce(sum(CASE WHEN to_rank=r.rank AND from_rank<>r.rank THEN volume END),0) AS BIGINT) AS recv, CAST(coalesce(sum(CASE WHEN from_rank=r.rank AND to_rank<>r.rank THEN volume END),0) AS BIGINT) AS send,
  CAST(coalesce(sum(CASE WHEN from_rank=r.rank AND to_rank=r.rank THEN volume END),0) AS BIGINT) AS intra FROM rank_info r LEFT JOIN er{x} ON from_rank=r.rank OR to_rank=r.rank GROUP BY r.rank),
ub{x} AS (SELECT DISTINCT t.rank, b.block_id, b.size, b.home_rank FROM task_block tb JOIN {task} t ON t.task_id=tb.task_id JOIN block b ON b.block_id=tb.block_id),
sh{x} AS (SELECT r.rank, CAST(coalesce(sum(CASE WHEN home_rank<>r.rank THEN size END),0) AS BIGINT) AS off_home, CAST(coalesce(sum(size),0) AS BIGINT) AS total FROM rank_info r LEFT JOIN ub{x} u ON u.rank=r.rank GROUP BY r.rank),
wk{x} AS (SELECT rl{x}.rank, load AS compute, recv, send, intra, off_home AS shared, round(CAST(load AS DOUBLE) + CAST(0.5 AS DOUBLE)*greatest(send,recv) + CAST(0.1 AS DOUBLE)*intra + CAST(0.01 AS DOUBLE)*off_home, 4) AS work
  FROM rl{x} JOIN cm{x} ON cm{x}.rank=rl{x}.rank JOIN sh{x} ON sh{x}.rank=rl{x}.rank)"""


_MEMORY = "mu AS (SELECT r.rank, CAST(coalesce(max(mem_working),0) AS BIGINT) AS mw, CAST(coalesce(max(mem_serialized),0) AS BIGINT) AS ms, CAST(max(footprint_bytes)+coalesce(sum(mem_footprint),0)+coalesce(max(mem_working),0)+coalesce(max(mem_serialized),0)+max(total) AS BIGINT) AS u, max(max_memory) AS mm FROM rank_info r JOIN sh ON sh.rank=r.rank LEFT JOIN task t ON t.rank=r.rank GROUP BY r.rank)"
_CLUSTERS = """cl AS (SELECT rank, task_id, CAST(task_id%16+CAST(rank AS BIGINT)*4294967296 AS BIGINT) AS gid FROM task),
ce AS (SELECT f.gid AS fg, f.rank AS fr, g.gid AS tg, g.rank AS tr, sum(volume) AS v, count(*) AS k FROM edge JOIN cl f ON f.task_id=from_task JOIN cl g ON g.task_id=to_task GROUP BY ALL),
co AS (SELECT c.gid, any_value(c.rank) AS rank, sum(load) AS load, count(*) AS n, sum(mem_footprint) AS fp, max(mem_working) AS mw, max(mem_serialized) AS ms FROM cl c JOIN task t ON t.task_id=c.task_id GROUP BY c.gid)"""
_UNDIRECTED = "un AS (SELECT least(from_task,to_task) AS u, greatest(from_task,to_task) AS v, CAST(sum(volume) AS BIGINT) AS weight FROM er WHERE from_rank=to_rank AND from_task<>to_task GROUP BY ALL)"
_MOVES = """mv AS (SELECT c.gid, c.rank AS src, r.rank AS dst FROM co c JOIN rank_info r ON r.rank<>c.rank),
me AS (SELECT gid, src, dst, v, CASE WHEN fg=gid THEN dst ELSE fr END AS a, CASE WHEN tg=gid THEN dst ELSE tr END AS b FROM mv, ce),
mc AS (SELECT gid, src, dst, sum(CASE WHEN a=src AND b<>src THEN v ELSE 0 END) AS ss, sum(CASE WHEN b=src AND a<>src THEN v ELSE 0 END) AS rs, sum(CASE WHEN a=src AND b=src THEN v ELSE 0 END) AS js,
  sum(CASE WHEN a=dst AND b<>dst THEN v ELSE 0 END) AS sd, sum(CASE WHEN b=dst AND a<>dst THEN v ELSE 0 END) AS rd, sum(CASE WHEN a=dst AND b=dst THEN v ELSE 0 END) AS jd FROM me GROUP BY gid, src, dst),
mb AS (SELECT gid, src, dst, sum(CASE WHEN r=src AND home_rank<>r THEN size ELSE 0 END) AS os, sum(CASE WHEN r=dst AND home_rank<>r THEN size ELSE 0 END) AS od, sum(CASE WHEN r=dst THEN size ELSE 0 END) AS ad
  FROM (SELECT DISTINCT m.gid, m.src, m.dst, CASE WHEN c.gid=m.gid THEN m.dst ELSE c.rank END AS r, b.block_id, b.size, b.home_rank FROM mv m JOIN cl c ON c.rank=m.src OR c.rank=m.dst JOIN task_block tb ON tb.task_id=c.task_id JOIN block b ON b.block_id=tb.block_id) q GROUP BY gid, src, dst),
mw AS (SELECT mv.gid, mv.src, mv.dst, a.work AS ws, d.work AS wd,
  round(CAST(a.compute-co.load AS DOUBLE)+CAST(0.5 AS DOUBLE)*greatest(ss,rs)+CAST(0.1 AS DOUBLE)*js+CAST(0.01 AS DOUBLE)*coalesce(os,0),4) AS after_src,
  round(CAST(d.compute+co.load AS DOUBLE)+CAST(0.5 AS DOUBLE)*greatest(sd,rd)+CAST(0.1 AS DOUBLE)*jd+CAST(0.01 AS DOUBLE)*coalesce(od,0),4) AS after_dst
  FROM mv JOIN co ON co.gid=mv.gid JOIN mc ON mc.gid=mv.gid AND mc.dst=mv.dst JOIN mb ON mb.gid=mv.gid AND mb.dst=mv.dst JOIN wk a ON a.rank=mv.src JOIN wk d ON d.rank=mv.dst),
mm AS (SELECT mv.gid, mv.dst, CAST(max(i.footprint_bytes)+sum(mem_footprint)+max(mem_working)+max(mem_serialized)+max(ad) AS BIGINT) AS u, max(i.max_memory) AS lim FROM mv JOIN rank_info i ON i.rank=mv.dst JOIN cl c ON c.gid=mv.gid OR c.rank=mv.dst JOIN task t ON t.task_id=c.task_id JOIN mb ON mb.gid=mv.gid AND mb.dst=mv.dst GROUP BY mv.gid, mv.dst),
ov AS (SELECT rank FROM wk WHERE work > (SELECT avg(work) FROM wk)),
ca AS (SELECT ov.rank AS initiator, mw.gid, src, mw.dst, after_src, after_dst, round(greatest(ws,wd)-greatest(after_src,after_dst),3) AS improvement FROM mw JOIN mm ON mm.gid=mw.gid AND mm.dst=mw.dst JOIN ov ON ov.rank=src OR ov.rank=mw.dst WHERE u<=lim)"""


def _sql(body: str, *more: str) -> str:
    return "WITH " + ",\n".join([SQL, _derived(), *more]) + "\n" + body


def query(name: str, sql: str | None = None, *more: str):
    def add(f):
        QUERIES[name] = lambda spark, sf_dir: f(part_graph(spark, sf_dir))
        if sql:
            ORACLES[name] = _sql(sql, *more)
        return f

    return add


def _long(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.col(n).cast("long") for n in names})


def _r(c, n=4):
    return F.round(F.col(c).cast("double"), n).alias(c)


# ---------------------------------------------------------------- loads, work, memory
query("q01_rank_load", "SELECT rank, load, n AS n_tasks FROM rl")(lambda t: work.rank_load(t))
query("q02_load_stats", "SELECT min(load) AS min_v, max(load) AS max_v, round(max(a),4) AS avg_v, round(max(load)/max(a)-1,6) AS imbalance FROM rl, av")(lambda t: work.statistics(work.rank_load(t), "load").select("min_v", "max_v", _r("avg_v"), _r("imbalance", 6)))
query("q03_comm_breakdown", "SELECT rank, recv, send, intra FROM cm")(lambda t: work.communication(t))
query("q04_shared_off_home", "SELECT rank, off_home, total FROM sh")(lambda t: work.shared_bytes(t))
query("q05_memory_usage", "SELECT rank, mw AS max_working, ms AS max_serialized, u AS usage FROM mu", _MEMORY)(lambda t: _long(work.memory_usage(t), "max_working", "max_serialized", "usage"))
query("q06_rank_work", "SELECT * FROM wk")(lambda t: work.work_breakdown(t, MODEL).withColumn("work", F.round("work", 4)))
query("q07_work_stats", "SELECT min(work) AS min_v, max(work) AS max_v, round(avg(work),3) AS avg_v, round(max(work)/avg(work)-1,6) AS imbalance FROM wk")(
    lambda t: work.statistics(work.work_breakdown(t, MODEL).withColumn("work", F.round("work", 4)), "work").select("min_v", "max_v", _r("avg_v", 3), _r("imbalance", 6))
)


# ---------------------------------------------------------------- graph hygiene
def _upsert(spark, sf_dir):
    return graph.upsert_edges(line_edges(spark.read.parquet(f"{sf_dir}/lineitem.parquet")))


def _first(spark, sf_dir):
    rows = line_edges(spark.read.parquet(f"{sf_dir}/lineitem.parquet")).select(F.col("from_task").alias("task_id"), "to_task", "volume", "seq")
    return graph.first_tasks(rows, ["to_task", "volume"])


QUERIES["q08_edge_upsert"], QUERIES["q09_task_first_wins"] = _upsert, _first
ORACLES["q08_edge_upsert"] = _sql("SELECT from_task, to_task, arg_max(volume, seq) AS volume FROM line_edge GROUP BY ALL")
ORACLES["q09_task_first_wins"] = _sql("SELECT from_task AS task_id, arg_min(to_task, seq) AS to_task, arg_min(volume, seq) AS volume FROM line_edge GROUP BY ALL")
query("q10_symmetrize", "SELECT from_rank AS holder, from_task, to_task, volume FROM er UNION SELECT to_rank, from_task, to_task, volume FROM er")(lambda t: graph.symmetrize(t))
query("q11_resolve_edge_ranks", "SELECT from_task, to_task, volume, from_rank, to_rank FROM er")(lambda t: work.edge_ranks(t))
query("q12_purge_dangling", "SELECT * FROM edge WHERE from_task IN (SELECT task_id FROM task WHERE rank=4) OR to_task IN (SELECT task_id FROM task WHERE rank=4)")(lambda t: graph.purge_dangling(t.edge, t.task.where("rank = 4")))
query("q13_undirected_weights", "SELECT * FROM un", _UNDIRECTED)(lambda t: graph.undirected(t))
query("q14_coaccess_weights", "SELECT a.task_id AS u, b.task_id AS v, CAST(sum(size) AS BIGINT) AS weight FROM task_block a JOIN task_block b ON a.block_id=b.block_id AND a.task_id<b.task_id JOIN task x ON x.task_id=a.task_id JOIN task y ON y.task_id=b.task_id AND x.rank=y.rank JOIN block k ON k.block_id=a.block_id GROUP BY ALL")(lambda t: graph.coaccess(t))
query("q15_homed_blocks", "SELECT home_rank AS rank, block_id FROM block")(lambda t: graph.homed_blocks(t))
query("q16_block_refcounts", "SELECT b.block_id, count(DISTINCT task_id) AS n_tasks FROM block b LEFT JOIN task_block t ON t.block_id=b.block_id GROUP BY b.block_id")(lambda t: graph.block_references(t))
query("q17_unreferenced_blocks", "SELECT block_id FROM block WHERE block_id NOT IN (SELECT block_id FROM task_block tb JOIN task t ON t.task_id=tb.task_id WHERE rank=0)")(lambda t: graph.unreferenced_blocks(t.block, t.task_block.join(t.task.where("rank = 0"), "task_id", "left_semi")))

# ---------------------------------------------------------------- rules
query("q18_underloaded", "SELECT rank, load FROM rl, av WHERE load<a")(lambda t: rules.underloaded(t))
for _c, _ok in ((Criterion.Grapevine, "NOT (u.load+x.load>a)"), (Criterion.ModifiedGrapevine, "x.load<=o.load-u.load")):
    query(f"q19_sufficiently_underloaded_{_c.value.lower()}", f"SELECT x.task_id, count(u.rank) AS n_targets, min(u.rank) AS first_target FROM task x JOIN rl o ON o.rank=x.rank JOIN av ON o.load>a LEFT JOIN rl u ON {_ok} GROUP BY x.task_id")(lambda t, c=_c: rules.sufficiently_underloaded(t, c))
_CAND = "cd AS (SELECT rank, load, a, max(load) OVER () AS m FROM rl, av WHERE load<a), cf AS (SELECT rank, round(sum(w) OVER (ORDER BY rank)/sum(w) OVER (),9) AS cmf FROM (SELECT rank, 1-load/%s AS w FROM cd) q)"


def _target(t):
    return F.lit(work.rank_load(t).agg(F.sum("load") / F.count(F.lit(1))).scalar())


query("q20_cmf_original", "SELECT * FROM cf", _CAND % "a")(lambda t: rules.cumulative_odds(rules.underloaded(t), CMF.Original, _target(t)).select("rank", _r("cmf", 9)))
query("q21_cmf_norm_by_max", "SELECT * FROM cf", (_CAND % "greatest(a,m)").replace("load<a)", "load<a OR rank=4)"))(lambda t: rules.cumulative_odds(rules.loads_and_average(t).where("load < average or rank = 4").select("rank", "load"), CMF.NormByMax, _target(t)).select("rank", _r("cmf", 9)))
query("q22_cmf_exclude_ineligible", "SELECT * FROM cf", (_CAND % "greatest(a,m)").replace("load<a)", "(SELECT max(load) FROM task)<=(SELECT max(load) FROM rl)-load)"))(
    lambda t: rules.cumulative_odds(rules.loads_and_average(t).where(rules.accepts(Criterion.ModifiedGrapevine, F.lit(work.rank_load(t).agg(F.max("load")).scalar()), F.col("load"), F.lit(t.task.agg(F.max("load")).scalar()), F.col("average"))).select("rank", "load"), CMF.NormByMaxExcludeIneligible, _target(t)).select("rank", _r("cmf", 9))
)
query("q23_cmf_sample", f"SELECT min(rank) AS rank FROM cf WHERE cmf>={DRAW}", _CAND % "a")(lambda t: rules.sample(rules.cumulative_odds(rules.underloaded(t), CMF.Original, _target(t)), DRAW))
_OVER = "tt AS (SELECT t.task_id, t.rank, t.load, o.load AS rload, o.load-a AS excess FROM task t JOIN rl o ON o.rank=t.rank JOIN av ON o.load>a)"
_TWO = "SELECT rank, task_id, CAST(row_number() OVER (PARTITION BY rank ORDER BY CASE WHEN load<=cut THEN 0 ELSE 1 END, CASE WHEN load<=cut THEN -load ELSE load END, task_id) AS BIGINT) AS pos FROM "
for _o, _q in (
    (Ordering.ElmID, "SELECT rank, task_id, CAST(row_number() OVER (PARTITION BY rank ORDER BY task_id) AS BIGINT) AS pos FROM tt"),
    (Ordering.LargestObjects, "SELECT rank, task_id, CAST(row_number() OVER (PARTITION BY rank ORDER BY load DESC, task_id) AS BIGINT) AS pos FROM tt"),
    (Ordering.FewestMigrations, _TWO + "(SELECT *, coalesce(min(CASE WHEN load>=excess AND load<rload THEN load END) OVER (PARTITION BY rank), rload) AS cut FROM tt) p"),
    (Ordering.SmallObjects, _TWO + "(SELECT *, coalesce(min(CASE WHEN cum>=excess THEN load END) OVER (PARTITION BY rank), rload) AS cut FROM (SELECT *, sum(load) OVER (PARTITION BY rank ORDER BY load, task_id DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum FROM tt) z) p"),
):
    query(f"q24_order_{_o.value.lower()}", _q, _OVER)(lambda t, o=_o: rules.object_order(t, o))

# ---------------------------------------------------------------- gossip
_X = "((CAST(s.rank AS BIGINT)+3)*(d.rank+5)*104729+d.rank*7919+{k}*1299709+29*15485863)"
_HASH = f"({_X}%1000003)*({_X}%999983)%1000033"
_G1 = f"g1 AS (SELECT src, dst FROM (SELECT s.rank AS src, d.rank AS dst, row_number() OVER (PARTITION BY s.rank ORDER BY {_HASH.format(k=1)}, d.rank) AS p FROM rank_info s JOIN rank_info d ON s.rank<>d.rank) x WHERE p<=2)"
_G2 = f"g2 AS (SELECT src, dst FROM (SELECT s.rank AS src, d.rank AS dst, row_number() OVER (PARTITION BY s.rank ORDER BY {_HASH.format(k=2)}, d.rank) AS p FROM rank_info s JOIN rank_info d ON s.rank<>d.rank AND NOT EXISTS (SELECT 1 FROM g1 WHERE g1.src=s.rank AND g1.dst=d.rank)) x WHERE p<=2)"
_K1 = "k1 AS (SELECT rank AS knower, rank AS known FROM rank_info UNION SELECT dst, src FROM g1)"
query("q25_gossip_round", "SELECT * FROM g1", _G1)(lambda t: gossip.round_targets(t.rank_info.select("rank"), 1, 2, 29))
query("q25_gossip_closure", "SELECT * FROM k1 UNION SELECT dst, known FROM g2 JOIN k1 ON knower=src", _G1, _G2, _K1)(lambda t: gossip.knowledge(t.rank_info.select("rank"), 2, 2, 29))


# ---------------------------------------------------------------- clusters
def cquery(name, sql, *more):
    return lambda f: query(name, sql, _CLUSTERS, *more)(lambda t: f(t, clusters.given_clusters(t).withColumn("gid", F.col("gid").cast("long"))))


cquery("q26_cluster_gid_codec", "SELECT DISTINCT gid, CAST(gid%4294967296 AS BIGINT) AS local_id, rank FROM cl")(lambda t, c: c.select("gid", clusters.local_id(F.col("gid")).alias("local_id"), clusters.rank_of(F.col("gid")).alias("rank")).distinct())
cquery("q27_cluster_load", "SELECT gid, CAST(load AS BIGINT) AS load, n AS n_tasks FROM co")(lambda t, c: clusters.loads(t, c))
cquery("q28_cluster_intra_bytes", "SELECT co.gid, CAST(coalesce(sum(v),0) AS BIGINT) AS intra FROM co LEFT JOIN ce ON fg=co.gid AND tg=co.gid GROUP BY co.gid")(lambda t, c: clusters.intra_bytes(t, c))
cquery("q29_cluster_inter_edges", "SELECT fg AS from_gid, tg AS to_gid, CAST(v AS BIGINT) AS volume, CAST(k AS BIGINT) AS n_edges FROM ce WHERE fg<>tg")(lambda t, c: clusters.inter_edges(t, c))
cquery("q30_cluster_memory", "SELECT a.gid, CAST(any_value(a.fp) AS BIGINT) AS footprint, any_value(a.mw) AS max_working, any_value(a.ms) AS max_serialized, coalesce(max(b.mw),0) AS outside_working, coalesce(max(b.ms),0) AS outside_serialized FROM co a LEFT JOIN co b ON b.rank=a.rank AND b.gid<>a.gid GROUP BY a.gid")(lambda t, c: clusters.memory(t, c))
cquery("q31_cluster_blocks", "SELECT DISTINCT gid, b.block_id, size FROM cl JOIN task_block tb ON tb.task_id=cl.task_id JOIN block b ON b.block_id=tb.block_id")(lambda t, c: clusters.blocks(t, c))
cquery("q32_boundary_bytes", "SELECT gid, CAST(sum(CASE WHEN fg=tg THEN v ELSE 0 END) AS BIGINT) AS intra, CAST(sum(CASE WHEN fg<>tg THEN v ELSE 0 END) AS BIGINT) AS boundary FROM co JOIN ce ON gid=fg OR gid=tg GROUP BY gid")(lambda t, c: clusters.boundary_bytes(t, c))
cquery("q33_unique_clusters", "SELECT CAST(sum(n) AS BIGINT) AS n_clusters, max(n) AS most FROM (SELECT rank, count(*) AS n FROM co GROUP BY rank) x")(lambda t, c: clusters.counts(c))
query("q34_whatif_task_delta", "SELECT * FROM wk2", "task2 AS (SELECT * REPLACE (CASE WHEN task_id%7=0 THEN CAST((rank+1)%8 AS INT) ELSE rank END AS rank) FROM task)", _derived("task2", "2"))(
    lambda t: whatif.after_task_moves(t, t.task.where("task_id % 7 = 0").select("task_id", ((F.col("rank") + 1) % 8).cast("int").alias("rank")), MODEL).withColumn("work", F.round("work", 4))
)
cquery("q35_whatif_cluster_delta", "SELECT gid, src, dst, after_src, after_dst FROM mw", _MOVES)(lambda t, c: whatif.cluster_move_work(t, c, MODEL).select("gid", "src", "dst", _r("after_src"), _r("after_dst")))
cquery("q36_memory_fit_delta", "SELECT gid, dst, u AS usage, u<=lim AS fits FROM mm", _MOVES)(lambda t, c: _long(whatif.cluster_move_memory(t, c), "usage"))
cquery("q37_swap_candidates", "SELECT * FROM ca", _MOVES)(lambda t, c: whatif.candidates(t, c, MODEL).select("initiator", "gid", "src", "dst", _r("after_src"), _r("after_dst"), _r("improvement", 3)))
_TOP = "SELECT initiator, gid, src, dst, improvement, pos FROM (SELECT *, CAST(row_number() OVER (PARTITION BY initiator ORDER BY improvement DESC, CASE WHEN initiator=src THEN after_src ELSE after_dst END, CASE WHEN initiator=src THEN after_dst ELSE after_src END, dst, src, gid) AS BIGINT) AS pos FROM ca) x WHERE pos<="
for _n, _k in (("q38_best_swap", 1), ("q39_top5_candidates", 5)):
    cquery(_n, _TOP + str(_k), _MOVES)(lambda t, c, k=_k: _long(whatif.best(whatif.candidates(t, c, MODEL), k).select("initiator", "gid", "src", "dst", _r("improvement", 3), "pos"), "pos"))
cquery("q40_cpm_move_gain", "SELECT task_id, gid, CAST(w-5.0*(n-CASE WHEN gid=own THEN 1 ELSE 0 END) AS DOUBLE) AS gain FROM (SELECT l.task_id, c.gid, o.gid AS own, sum(weight) AS w FROM (SELECT u AS task_id, v AS other, weight FROM un UNION ALL SELECT v, u, weight FROM un) l JOIN cl c ON c.task_id=other JOIN cl o ON o.task_id=l.task_id GROUP BY ALL) x JOIN (SELECT gid AS g2, n FROM co) y ON g2=gid", _UNDIRECTED)(lambda t, c: clustering.singleton_gains(t, c, RESOLUTION))
cquery("q41_cpm_objective", "SELECT rank, CAST(sum(coalesce(w,0)-5.0*n*(n-1)/2) AS DOUBLE) AS objective FROM co LEFT JOIN (SELECT f.gid AS g2, sum(weight) AS w FROM un JOIN cl f ON f.task_id=u JOIN cl g ON g.task_id=v AND f.gid=g.gid GROUP BY f.gid) x ON g2=gid GROUP BY rank", _UNDIRECTED)(lambda t, c: clustering.potts_objective(t, c, RESOLUTION))
cquery("q42_all_clustered", "SELECT task_id FROM task WHERE task_id NOT IN (SELECT task_id FROM cl)")(lambda t, c: clusters.unclustered(t, c))
cquery(
    "q43_dot_nodes_edges",
    """SELECT rank, 1 AS section, task_id AS ord, '  t'||task_id||' [label="t'||task_id||'\\nL='||printf('%.1f',CAST(load AS DOUBLE))||'"];' AS line FROM task
UNION ALL SELECT f.rank, 2, from_task, '  t'||from_task||' -> t'||to_task||' [label="'||volume||'"'||CASE WHEN f.rank<>g.rank THEN ' color=red' WHEN f.gid<>g.gid THEN ' color=orange' ELSE '' END||'];' FROM edge JOIN cl f ON f.task_id=from_task JOIN cl g ON g.task_id=to_task""",
)(lambda t, c: dot.lines(t, c))

# ---------------------------------------------------------------- sequential kernels: rows, and checks whose answer is known
query("q44_comm_matching")(lambda t: clustering.communication_matching(t))
query("q45_block_matching")(lambda t: clustering.block_matching(t))
query("q46_cpm_clusters")(lambda t: clustering.potts_clusters(t, RESOLUTION))
for _n, _f, _e in (("q44_comm_matching", clustering.communication_matching, lambda t, c: clustering.matching_faults(t, graph.undirected(t), c)), ("q45_block_matching", clustering.block_matching, clustering.block_matching_faults)):
    # only the greedy matching has no edge that outranks its ends' pairs, no pair without an edge, no id in two ranks and none of three tasks
    query(_n + "_check", "SELECT count(*) AS n_tasks, CAST(0 AS BIGINT) AS outranked, CAST(0 AS BIGINT) AS unlinked, CAST(0 AS BIGINT) AS odd FROM task")(lambda t, f=_f, e=_e: e(t, cut(f(t))))
query("q46_cpm_clusters_check", "SELECT rank, count(*) AS n_tasks, CAST(0 AS BIGINT) AS shared_ids, true AS gains FROM task GROUP BY rank")(lambda t: clustering.potts_faults(t, cut(clustering.potts_clusters(t, RESOLUTION)), RESOLUTION))

_BY_TASK = BalanceConfig(num_iters=2, n_rounds=2, obj_ordering=Ordering.FewestMigrations)
_BY_CLUSTER = BalanceConfig(num_iters=2, n_rounds=2, based_on_shared_blocks=True, work=MODEL)
_TRIALS = BalanceConfig(num_trials=2, num_iters=1, n_rounds=2, deterministic=False)
query("q47_task_transfer")(lambda t: rebalance.rebalance(t, _BY_TASK).assignment)
query("q48_cluster_transfer")(lambda t: rebalance.rebalance(t, _BY_CLUSTER).assignment)
query("q49_best_trial")(lambda t: rebalance.rebalance(t, _TRIALS).history)
for _n, _cfg in (("q47_task_transfer_check", _BY_TASK), ("q48_cluster_transfer_check", _BY_CLUSTER)):
    query(_n, "SELECT CAST(0 AS BIGINT) AS tasks_lost, CAST(0 AS BIGINT) AS tasks_added, CAST(0 AS BIGINT) AS load_change, true AS max_not_raised")(lambda t, c=_cfg: rebalance.verification(t, rebalance.rebalance(t, c)))


def _phases(spark, sf_dir):
    return phase_loads(spark.read.parquet(f"{sf_dir}/events.parquet")).select(F.date_format("phase_start", "yyyy-MM-dd").alias("phase"), "rank", "load", "n")


QUERIES["q50_phase_stats"] = _phases
ORACLES["q50_phase_stats"] = "SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS phase, CAST(user_id%8 AS INT) AS rank, CAST(sum(CAST(round(value*100) AS BIGINT)) AS BIGINT) AS load, count(*) AS n FROM events GROUP BY ALL"


# ---------------------------------------------------------------- overlapping shards, made graphs
def _shards(t):
    """Shard s holds the tasks of ranks s and s - 1, the edges of its rank, and half of each rank's footprint and memory entries."""
    task = t.task.select("task_id", "rank", "load", F.explode(F.array("rank", F.col("rank") + 1)).alias("shard")).withColumn("load", F.col("load") + F.col("shard"))
    edge = graph.symmetrize(t).select("from_task", "to_task", (F.col("volume") + F.col("holder")).alias("volume"), F.col("holder").alias("shard"))
    info = t.rank_info.select((F.col("rank") % 4).cast("int").alias("rank"), "footprint_bytes", (F.col("max_memory") + F.col("rank")).alias("max_memory"), F.col("rank").alias("shard"))
    return graph.merge_shards(task, edge, info)


query("q51_merge_tasks", "SELECT task_id, rank, CAST(load+rank AS BIGINT) AS load FROM task")(lambda t: _long(_shards(t)[0], "load"))
query("q51_merge_edges", "SELECT from_task, to_task, CAST(volume+greatest(from_rank,to_rank) AS BIGINT) AS volume FROM er")(lambda t: _shards(t)[1])
query("q51_merge_ranks", "SELECT CAST(rank%4 AS INT) AS rank, CAST(sum(footprint_bytes) AS BIGINT) AS footprint_bytes, max(max_memory+rank) AS max_memory FROM rank_info GROUP BY ALL")(lambda t: _shards(t)[2])

QUERIES["q52_synthetic_tasks"] = lambda spark, sf_dir: synthetic.tasks(spark).select("task_id", "block_id", "rank", _r("load", 6), "mem_working")
QUERIES["q52_synthetic_blocks"] = lambda spark, sf_dir: synthetic.blocks(spark)
QUERIES["q52_synthetic_edges"] = lambda spark, sf_dir: synthetic.graph(spark).edge
for _n, _q in (("tasks", "SELECT task_id, block_id, rank, round(load,6) AS load, mem_working FROM st"), ("blocks", "SELECT * FROM sb"), ("edges", "SELECT * FROM se")):
    ORACLES[f"q52_synthetic_{_n}"] = f"WITH {synthetic.oracle()}\n{_q}"
