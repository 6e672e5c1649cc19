"""The pipeline's stages on a planted corpus, and every registered opN query on a small folder."""

import random

import pytest

pytest.importorskip("public_tokenizers")

import corpus_pipeline  # noqa: E402
from codelode.llm import queries  # noqa: E402

from .conftest import prose  # noqa: E402


@pytest.fixture(scope="module")
def corpus(spark, make_docs, tmp_path_factory):
    rng = random.Random(12)
    item = prose(rng, 30)
    base = prose(rng, 120)
    near = base.split()
    near[50] = "zzz"
    texts = [prose(rng, rng.randrange(20, 200)) for _ in range(40)] + [base, base, " ".join(near), f"{prose(rng, 30)} {item} {prose(rng, 10)}", "12345 6789 !!", None, "", f"{prose(rng, 20)} password=b7db7aa4a5fcc78305 end"]
    folder = tmp_path_factory.mktemp("sf")
    make_docs(texts).write.parquet(str(folder / "documents.parquet"))
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(str(folder / "benchmark.parquet"))
    return str(folder), texts


def test_stages(spark, corpus):
    folder, texts = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns
        docs = spark.createDataFrame(out.collect(), out.schema)
        kept[name] = {r.doc_id for r in docs.collect()}
    everyone = set(range(len(texts)))
    assert kept["language_id"] == everyone - {44, 45, 46}
    assert kept["ngram_jaccard_join"] == kept["language_id"] - {41, 42}
    assert kept["decontamination"] == kept["ngram_jaccard_join"] - {43}
    assert kept["secret_scan"] == kept["decontamination"]
    assert "password=[SECRET]" in next(r.text for r in docs.collect() if r.doc_id == 47)


def test_run(spark, corpus):
    folder, _ = corpus
    rows = corpus_pipeline.run(spark, folder)
    assert {"doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"} == set(rows.columns)
    assert rows.select("doc_id").distinct().count() == 42


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query_runs(spark, sf_dir, name):
    rows = queries.QUERIES[name](spark, sf_dir).count()
    assert rows > 0 or name in ("op5_secret_scan", "op10_decontamination")  # the smallest folder may hold none
