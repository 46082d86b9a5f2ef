"""The pipeline stage by stage, and without the subpackage."""

import subprocess
import sys
from pathlib import Path

import pytest

import corpus_pipeline
from corpusloom.llm import registry

SF = "/root/testdata/sf0.001"
ROOT = Path(__file__).resolve().parents[2]


@pytest.mark.skipif(not Path(SF).exists(), reason="the supplied tables are not here")
def test_stages_hand_on_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    sizes = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name
        assert out.join(docs, "doc_id", "left_anti").count() == 0
        docs = out
        sizes.append(docs.count())
    assert sizes == sorted(sizes, reverse=True) and sizes[0] > sizes[-1] > 0.5 * sizes[0]
    packed = corpus_pipeline.run(spark, SF)
    assert packed.select("doc_id").distinct().count() == sizes[-1]


@pytest.mark.skipif(not Path(SF).exists(), reason="the supplied tables are not here")
def test_stages_on_messy_and_empty_tables(spark, messy, no_docs):
    for docs in (messy, no_docs):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, SF)
            assert out.columns == docs.columns, name
            assert out.drop("m").exceptAll(docs.drop("m")).count() == 0, name  # maps have no equality
            docs = out
        packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
        assert (packed.count() > 0) == (docs.count() > 0)
        assert sorted(r["n"] for r in packed.filter("piece = 0").groupBy("doc_id").count().withColumnRenamed("count", "n").collect()) == sorted(r["n"] for r in docs.groupBy("doc_id").count().withColumnRenamed("count", "n").collect())


def test_registry_names():
    assert {int(n[2:].split("_")[0]) for n in registry.queries()} == {*range(1, 14)}


def test_the_rest_works_without_the_subpackage(tmp_path):
    import shutil

    for p in ("corpusloom", "__spark_entry__.py"):
        (shutil.copytree if (ROOT / p).is_dir() else shutil.copy)(ROOT / p, tmp_path / p)
    shutil.rmtree(tmp_path / "corpusloom" / "llm")
    code = "import __spark_entry__ as e; q = e.queries(); assert 'search_notes' in q and 'pipeline' not in q and not any(n.startswith('op') for n in q); e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, timeout=120)
