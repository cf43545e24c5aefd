"""Extra columns with the names that operators use, empty tables, and very long tokens."""

import random

import numpy as np
import pytest

import corpus_pipeline
from offerlake.llm import queries
from offerlake.llm.string_kernel import Landmarks
from offerlake.llm import string_kernel

SF = "/root/testdata/sf0.001"
NAMES = (
    "_spans _items _n_words _id _mark _lines _one id mark label size line lines key v component a b fp first_id "
    "spans items words tokens ids decoded kept score held_out n_words count word tree pos way item hash block "
    "output form restored output_sha256 lang_pred pieces place group piece anchor window run start end"
).split()


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """The given tables with more columns, and the same without rows."""
    top = tmp_path_factory.mktemp("columns")
    for name in ("documents", "labels", "benchmark", "embeddings"):
        rows = spark.read.parquet(f"{SF}/{name}.parquet").limit(60)
        for k, extra in enumerate(n for n in NAMES if n not in rows.columns):
            rows = rows.selectExpr("*", f"{k} AS `{extra}`")
        rows.write.parquet(f"{top}/wide/{name}.parquet")
        rows.limit(0).write.parquet(f"{top}/none/{name}.parquet")
    return str(top)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_queries_over_clashing_names_and_no_rows(spark, tables, name):
    own = "embeddings" if "embedding" in name else "documents"
    expected = spark.read.parquet(f"{tables}/wide/{own}.parquet").count()
    assert queries.QUERIES[name](spark, f"{tables}/wide").count() == expected
    assert queries.QUERIES[name](spark, f"{tables}/none").count() == 0


def test_pipeline_over_clashing_names_and_no_rows(spark, tables):
    """Every stage but the last keeps all columns."""
    docs = spark.read.parquet(f"{tables}/wide/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, f"{tables}/wide")
        assert sorted(kept.columns) == sorted(docs.columns) and 0 < kept.count() <= docs.count()
    assert 0 < corpus_pipeline.run(spark, f"{tables}/wide").count() <= 60
    assert corpus_pipeline.run(spark, f"{tables}/none").count() == 0


def test_likeness_of_words_of_any_length(monkeypatch):
    rnd = random.Random(4)
    marks = Landmarks(["".join(rnd.choices("abcdefgh", k=6)) for _ in range(20)])
    words = ["".join(rnd.choices("abcdefgh", k=rnd.choice([3, 5, 8, 300]))) for _ in range(300)]
    whole = marks.likeness(words)
    monkeypatch.setattr(string_kernel, "LETTERS", 50)
    monkeypatch.setattr(string_kernel, "WEIGHED", 3)
    pieces = marks.likeness(words)
    assert whole.keys() == pieces.keys() and len(whole) > 10
    assert all(np.allclose(whole[k], pieces[k], atol=1e-5) for k in whole)
