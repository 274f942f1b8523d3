"""What travels with the scorers decides no score."""

import os

import pytest
from pyspark.sql import functions as F

pytest.importorskip("inkspan.llm")
from inkspan.llm import lm  # noqa: E402

DIR = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")
def test_capacity_only_moves_the_look_up(spark, monkeypatch):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    docs = docs.unionByName(docs.where("doc_id < 3"))
    scored = lambda: {r.doc_id: r for r in lm.score(docs, ~lm.held_out(F.col("doc_id"), 7, 2)).collect()}
    whole = scored()
    monkeypatch.setattr(lm, "MAX_STATES", 40)
    monkeypatch.setattr(lm.tree, "__defaults__", (lm.LEAST, lm.GAIN, 40))
    monkeypatch.setattr(lm, "LEXICON", 50)
    few = scored()
    assert whole.keys() == few.keys()
    for i, r in few.items():
        assert (r.n_tokens, r.n_known) == (whole[i].n_tokens, whole[i].n_known)
        assert (r.base_score, r.score) == pytest.approx((whole[i].base_score, whole[i].score))


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")
def test_bound_on_rows_only_moves_the_look_up(spark, monkeypatch):
    docs = spark.read.parquet(f"{DIR}/documents.parquet").where("doc_id < 60")
    grams = lm.counts(docs).where(F.col("kind") == lm.GRAM).select("code", "n")
    scored = lambda: {r.doc_id: r.score for r in lm.score(docs, F.lit(True)).collect()}
    whole, travel = scored(), sum(len(m["code"]) for m in lm.tree(grams))
    bound = max(travel // 3, 256)
    monkeypatch.setattr(lm, "MAX_ROWS", bound)
    assert sum(len(m["code"]) for m in lm.tree(grams)) <= bound < travel
    few = scored()
    assert few.keys() == whole.keys()
    assert all(few[i] == pytest.approx(whole[i]) for i in whole)


def test_repeated_rows_give_a_row_each(spark):
    rows = [(1, "a b a"), (1, "a b a"), (1, "a c"), (None, "a"), (None, "a"), (2, None), (2, None)]
    got = lm.score(spark.createDataFrame(rows, "doc_id long, text string"), F.lit(True)).collect()
    assert sorted((str(r.doc_id), r.n_tokens) for r in got) == [("1", 3), ("1", 4), ("1", 4), ("2", 1), ("2", 1), ("None", 2), ("None", 2)]
    assert len({r.score for r in got if r.n_tokens == 4}) == 1
