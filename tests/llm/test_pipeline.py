"""The pipeline's stages by hand on a small table, and the registry."""

import collections
import random
import re

import pytest

import __spark_entry__
import corpus_pipeline
from rankflow.llm import mixing


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rnd = random.Random(1)
    stock = {"en": ["the", "thing", "and", "other", "with"], "fr": ["eaux", "les", "dans", "être"]}
    rows = [(i, " ".join(rnd.choice(stock[lang]) + rnd.choice("abcdefg") for _ in range(60)), lang, f"s{i % 3}") for i, lang in ((i, ("en", "fr")[i % 2]) for i in range(120))]
    rows += [(200 + i, rows[i][1], rows[i][2], rows[i][3]) for i in range(10)] + [(300, None, None, None), (301, "", "en", "s0"), (302, "12 34", "en", "s0")]
    rows += [(400, "new words " * 3 + rows[5][1][:150], "en", "s1")]
    at = tmp_path_factory.mktemp("sf")
    spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{at}/documents.parquet")
    return str(at)


def test_stages(spark, folder):
    docs, seen = spark.read.parquet(f"{folder}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert tuple(docs.columns) == corpus_pipeline.COLUMNS
        seen.append({r.doc_id for r in docs.select("doc_id").collect()})
    assert not seen[0] & {300, 301, 302} and set(range(120)) <= seen[0]
    assert not seen[1] & set(range(200, 210)) and set(range(120)) <= seen[1]
    assert seen[2] == seen[1]
    assert seen[4] == seen[3] <= seen[2]


def test_near_copies_go_by_row(spark, folder):
    """Ids that repeat or lack, equal rows: one row of each class stays, no text without a copy goes."""
    a, z = " ".join(f"a{i}" for i in range(60)), " ".join(f"z{i}" for i in range(60))
    texts = [(1, a), (5, a), (5, z), (None, z + " more"), (None, "quite another text of its own"), (7, "quite another text of its own"), (8, ""), (9, None), (10, "one"), (10, "one")]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in texts], "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted((str(r.doc_id), str(r.text)) for r in corpus_pipeline.join_near_copies(spark, docs, folder).collect())
    assert got == sorted([("1", a), ("5", z), ("7", "quite another text of its own"), ("8", ""), ("9", "None"), ("10", "one")])
    assert corpus_pipeline.join_near_copies(spark, docs.limit(0), folder).count() == 0


def test_mix_of_long_documents_meets_its_targets(spark, folder):
    rnd = random.Random(2)
    rows = [(i if i % 50 else None, f"t{i} " * rnd.choice([1, 150, 640, 900]), "en", f"s{i % 5}") for i in range(400)]
    rows += [(1000, "copy " * 300, "en", "s1")] * 3 + [(1001, "", "en", "s1"), (1002, "no source " * 99, "en", None)]
    docs = spark.createDataFrame([(*r, len(r[1])) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    size, words = {}, {}
    for _, t, _, s in rows:
        size[s] = size.get(s, 0) + len(t.split())
    for r in corpus_pipeline.mix_sources(spark, docs, folder).collect():
        words[r.source] = words.get(r.source, 0) + len(r.text.split())
    order = sorted(size, key=lambda s: (s is None, s or ""))
    for s, target in zip(order, corpus_pipeline.mixing.targets([size[s] for s in order])):
        assert abs(words.get(s, 0) - target) <= 450


def test_mix_is_by_blocks(spark, folder):
    """Each slot's block, cut out of its source's stream by hand; rows that lack an id, are equal, or differ in where a null stands."""
    rnd = random.Random(4)
    blank = lambda: rnd.choice([" ", "  ", "\n", "\t ", "\x0b", " \r\n"])
    text = lambda n: rnd.choice(["", blank()]) + "".join(rnd.choice(["w", "été", "\U0001f600x", "a\x1cb", "\xa0"]) + str(rnd.randint(0, 99)) + blank() for _ in range(n)) + rnd.choice(["end", "", "\n\n"])
    rows = [(i if i % 9 else None, text(rnd.choice([0, 1, 5, 64, 300])), rnd.choice(["en", None]), rnd.choice(["a", "a", "b", "c", None])) for i in range(150)]
    rows += [(500, "same row " * 50, "en", "a")] * 4 + [(501, "x y " * 70, "a", None), (501, "x y " * 70, None, "a"), (502, None, "en", "a"), (503, " \n ", "en", "b")]
    docs = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = mixing.mixed(docs).collect()
    own = {(r["__row"].a, r["__row"].b): r for r in mixing.keyed(docs).collect()}
    assert len(own) == len(set(rows))
    mix, want, blocks = mixing.Mixture(mixing.keyed(docs), "__row"), {}, collections.defaultdict(list)
    for d in mix.docs.where("size > 0").collect():
        r, of = own[d.doc_id.a, d.doc_id.b], collections.defaultdict(str)
        assert d["size"] == len(re.findall(r"[^\x20\x09-\x0D]+", r.text))
        for i, w in enumerate(re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+(?:[\x20\x09-\x0D]+\Z)?", r.text)):
            of[(d.start + i) // mixing.BLOCK] += w
        assert "".join(of.values()) == r.text
        for b, t in of.items():
            blocks[d.sid, b].append((max(d.start, b * mixing.BLOCK), (r.doc_id, t, r.lang, r.source)))
    want = [(s.shard, s.slot, at, *row) for s in sorted(mix.slots.collect(), key=lambda s: s.slot) for at, row in sorted(blocks[s.sid, s.block], key=lambda x: x[0])]
    assert sorted((r[:7] for r in got), key=lambda r: r[:3]) == want and len(want) > 300
    # a shard's rows are together and in order
    assert [(r.slot, r["at"]) for shard in dict.fromkeys(r.shard for r in got) for r in got if r.shard == shard] == [(r.slot, r["at"]) for r in got]
    assert all(a.slot <= b.slot for a, b in zip(got, got[1:]) if a.shard == b.shard)
    stage = corpus_pipeline.mix_sources(spark, docs, folder)
    assert stage.dtypes == docs.dtypes
    assert collections.Counter(map(tuple, stage.collect())) == collections.Counter((*r[3:], len(r[4])) for r in want)
    assert corpus_pipeline.mix_sources(spark, docs.limit(0), folder).count() == 0


def test_run_on_nothing(spark, folder, tmp_path):
    spark.read.parquet(f"{folder}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_registered():
    names = set(__spark_entry__.queries())
    assert "pipeline" in names and {n.split("_")[0] for n in names} >= {f"op{i}" for i in range(1, 11)}
