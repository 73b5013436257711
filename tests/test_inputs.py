import json

import pyarrow as pa
import pytest

from rankflow.config import Algorithm, ConfigError, Criterion, Ordering, balance_config, run_spec
from rankflow.sources.json_shard import IngestError, documents, read_phase

YAML = """
from_data: {data_folder: /data, phase_id: 3}
algorithm: TemperedLB
configuration:
  num_trials: 4
  fanout: 3
  unknown_key: 1
  transfer_decisions: {criterion: Grapevine, obj_ordering: SmallObjects}
  work_model: {parameters: {beta: 1, delta: 0.5}, memory_info: {has_mem_info: false}}
  clustering: {based_on_communication: true}
"""


def test_complete():
    s = run_spec(YAML, 16)
    assert (s.data_folder, s.phase_id, s.algorithm) == ("/data", 3, Algorithm.TemperedLB)
    c = s.config
    assert (c.num_trials, c.num_iters, c.fanout, c.n_rounds, c.criterion, c.obj_ordering) == (4, 10, 3, 2, Criterion.Grapevine, Ordering.SmallObjects)
    assert c.work.by_clusters and c.work.beta == 1.0 and not c.work.memory.on("has_shared_block_mem_info") and c.based_on_communication


def test_defaults():
    assert balance_config({}, 1).n_rounds == 0 and balance_config({}, 1024).n_rounds == 4


@pytest.mark.parametrize("bad", ["configuration: {num_iters: many}", "configuration: {transfer_decisions: {criterion: Other}}", "configuration: {work_model: {parameters: {beta: x}}}"])
def test_bad_values(bad):
    import yaml

    with pytest.raises(ConfigError):
        balance_config(yaml.safe_load(bad), 4)


@pytest.mark.parametrize("bad", ["a: [", "algorithm: None", "from_data: {data_folder: x, phase_id: 1}", "from_data: {data_folder: x, phase_id: 1}\nalgorithm: Other"])
def test_bad_documents(bad):
    with pytest.raises(ConfigError):
        run_spec(bad, 4)


def shard(rank):
    e = lambda i: {"type": "object", "migratable": True, "id": i, "home": rank}
    return {"phases": [{"id": 0, "tasks": [{"entity": e(10 * rank + i), "node": rank, "resource": "cpu", "time": 1.5 + i} for i in range(2)], "communications": [{"type": "SendRecv", "messages": 1, "bytes": 4.0, "from": e(10 * rank), "to": e(10 * rank + 1)}]}]}


def test_plain_and_brotli_agree(spark, tmp_path):
    for sub, packed in (("a", False), ("b", True)):
        (tmp_path / sub).mkdir()
        for r in range(2):
            body = json.dumps(shard(r)).encode()
            if packed:
                sink = pa.BufferOutputStream()
                with pa.CompressedOutputStream(sink, "brotli") as s:
                    s.write(body)
                body = sink.getvalue().to_pybytes()
            (tmp_path / sub / f"data.{r}.json{'.br' if packed else ''}").write_bytes(body)
    a, b = (read_phase(documents(spark, str(tmp_path / s)), 0) for s in "ab")
    for x, y in ((a.task, b.task), (a.edge, b.edge)):
        assert sorted(map(tuple, x.collect())) == sorted(map(tuple, y.collect()))
    assert a.task.count() == 4 and a.edge.count() == 2
    with pytest.raises(IngestError):
        read_phase(documents(spark, str(tmp_path / "a")), 7)


def test_missing_key(spark):
    d = shard(0)
    del d["phases"][0]["tasks"][0]["time"]
    df = spark.createDataFrame([(0, json.dumps(d))], "shard int, body string")
    with pytest.raises(Exception, match="time is missing"):
        read_phase(df, 0).task.collect()
