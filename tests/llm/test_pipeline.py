"""Every stage against what its input should give, and the whole run."""

import os
from types import SimpleNamespace

import pytest

import __spark_entry__
import corpus_pipeline
from tessera.llm import decontaminate as dc
from tessera.llm._common import shared_folder

from .conftest import PRIVATE
from .test_near import plain_components, plain_print

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    held = [docs]
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp(name) / "out")
        stage(spark, held[-1], SF).write.parquet(path)
        held.append(spark.read.parquet(path))
    return held


def test_names_and_columns(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_dedup", "decontamination", "mixing", "sharding"]
    assert all(df.columns == COLUMNS for df in stages[:-1])
    assert {"shard", "slot", *COLUMNS} <= set(stages[-1].columns)


def test_near_stage(stages):
    before = {r["doc_id"]: r["text"] for r in stages[1].collect()}
    want = plain_components({k: plain_print(t) for k, t in before.items()})
    assert sorted(r["doc_id"] for r in stages[2].collect()) == sorted(set(want.values()))


def test_decontamination_stage(spark, stages):
    items = [dc.words_of(r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    clean = {r["doc_id"] for r in stages[2].collect() if not any(dc.best_end(i, dc.words_of(r["text"]))[0] <= dc.allowed(len(i)) for i in items)}
    kept = {r["doc_id"] for r in stages[3].collect()}
    assert clean <= kept and len(kept - clean) <= 0.02 * max(1, stages[2].count() - len(clean))


def test_mixing_and_sharding_stages(stages):
    texts = {r["doc_id"]: r["text"] for r in stages[3].collect()}
    mixed = [(r["doc_id"], r["text"]) for r in stages[4].collect()]
    assert all(texts[d] == t for d, t in mixed)
    assert max(sum(d == k for d, _ in mixed) for k in texts) <= 3
    out = stages[5].collect()
    assert sorted((r["doc_id"], r["text"]) for r in out) == sorted(mixed)
    assert sorted(r["position"] for r in out) == list(range(len(out)))


def test_run_equals_the_stages(spark, stages):
    got = sorted(r["doc_id"] for r in corpus_pipeline.run(spark, SF).collect())
    assert got == sorted(r["doc_id"] for r in stages[-1].collect())
    assert "pipeline" in __spark_entry__.queries() and "pipeline" not in __spark_entry__.oracle_sql()


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_odd_and_empty_input(spark, odd, none, name, stage):
    out = stage(spark, odd, SF)
    assert set(odd.columns) - {"position", "shard", "slot", "size", "target", "copies"} <= set(out.columns)
    out.collect()
    assert stage(spark, none, SF).count() == 0


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_every_input_column_passes_through(spark, odd, name, stage):
    """Also those with names that an operator uses on the way."""
    out = stage(spark, odd, SF)
    kept = [c for c in odd.columns if name != "sharding" or c not in ("position", "shard", "slot")]
    assert [c for c in out.columns if c in kept] == kept and (name == "sharding" or out.columns == odd.columns)
    rows = out.collect()
    assert rows and all(r[c] == 7 for r in rows for c in PRIVATE)


def test_tables_of_earlier_stages_are_gone(spark):
    folder = shared_folder(spark).removeprefix("file:")
    before = set(os.listdir(folder))
    assert corpus_pipeline.run(spark, SF).count() > 0
    left = {x.split("-")[0] + "-" + x.split("-")[1] for x in set(os.listdir(folder)) - before}
    assert {x for x in left if x.startswith("pipeline")} == {"pipeline-mixing"} and not any(x.startswith("scratch") for x in left)


def test_a_cluster_needs_a_shared_folder():
    held = SimpleNamespace(isDefined=lambda: False)
    context = SimpleNamespace(_jsc=SimpleNamespace(sc=lambda: SimpleNamespace(getCheckpointDir=lambda: held)), getConf=lambda: {}, master="spark://somewhere:7077")
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_folder(SimpleNamespace(sparkContext=context))
