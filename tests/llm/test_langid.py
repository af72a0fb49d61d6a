import numpy as np
import pytest
from pyspark.sql import functions as F

from covspark.llm import langid
from covspark.llm.common import bucket4

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def test_held_out_accuracy(spark, documents):
    model = langid.fit(documents.where(bucket4(F.col("doc_id")) != 2))
    assert model.langs == ["de", "en", "es", "fr"]
    held = langid.predict(documents.where(bucket4(F.col("doc_id")) == 2), model)
    right, n, score = held.agg(
        F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.count("*"), F.avg("score")
    ).first()
    assert n > 200 and right > 0.97
    assert abs(score - right) < 0.05  # calibrated
    odd = [None, "", " 12 %", "日本", "The " * 30000, "der die das und nicht"]
    df = spark.createDataFrame([(t, "x") for t in odd], "text string, score string")
    got = {r.text: r for r in langid.predict(df, model).collect()}
    assert [got[t].lang_pred == "und" for t in odd] == [True, True, True, False, False, False]
    assert all(0 <= r.score <= 1 for r in got.values()) and got[None].score == 0.0


def test_without_labels(spark):
    df = spark.createDataFrame([("a b", None), ("1", None), (None, None)], "text string, lang string")
    model = langid.fit(df)
    assert model.langs == [] and {r.lang_pred for r in langid.predict(df, model).collect()} == {"und"}
    assert [r.text for r in langid.keep(df).collect()] == ["a b"]
    assert langid.keep(df.limit(0)).count() == 0


def test_counts_are_those_of_the_ngrams():
    s = langid.Settings()
    tf, has = langid.counts(["Ab, c1É", None, "42"], s)
    assert has.tolist() == [True, False, False] and tf[1:].sum() == 0
    plain = " ab c é "
    assert tf[0].sum() == sum(len(plain) - n + 1 for n in s.orders)


def test_weights_are_sparse(spark, documents):
    model = langid.fit(documents, settings=langid.Settings(per_lang=60, l1=0.1))
    assert (np.asarray(model.weights) == 0).mean() > 0.3
