"""What is learned does not depend on bounds that an input's size may pass."""

import numpy as np
import pyarrow as pa

from pyspark.sql import functions as F

from matchloom.llm import langid, quality


def test_order_stays_however_many_runs(spark, monkeypatch):
    monkeypatch.setattr(langid, "MAX_RUNS", 5, raising=False)
    rows = [(1, "the and of with not", "en"), (2, "der die das und nicht", "de")]
    model = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert model.order == langid.ORDER == 4
    whole = {lang: np.unique(np.concatenate(list(langid._grams(langid.as_bytes(pa.array([t])), 4))), return_counts=True) for _, t, lang in rows}
    texts = langid.as_bytes(pa.array(["the und", "quite unseen"]))
    assert (langid.code_lengths(model, *texts) == langid.code_lengths(langid.build(whole, 4), *texts)).all()


def test_threshold_is_of_all_labelled_rows(spark, monkeypatch):
    monkeypatch.setattr(quality, "LABELLED", 10, raising=False)
    rng = np.random.default_rng(3)
    texts = [" ".join(rng.choice([f"word{k}" for k in range(90)] + ["###", "A!!"] * int(rng.integers(0, 30)), 40)) for _ in range(300)]
    bad = np.array([t.count("#") > 15 or i % 29 == 0 for i, t in enumerate(texts)])
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    rules = quality.fit(docs, spark.createDataFrame([(i, int(not b)) for i, b in enumerate(bad)], "doc_id long, quality int"))
    base, x = quality.statistics(pa.array(texts))
    passed = quality._passes(base)
    want = quality.calibrate(quality.score(rules.forest, x[passed]), bad[passed])
    assert 0 < want < 1 and rules.threshold == want


def test_threshold_as_on_the_driver(spark, monkeypatch):
    rng = np.random.default_rng(8)
    for bands in (1, 7, 1 << 16):
        monkeypatch.setattr(quality, "BANDS", bands)
        scores, share = np.round(rng.random(200), 2), rng.random()
        bad = rng.random(200) < np.where(scores > share, 0.95, 0.1)
        df = spark.createDataFrame([(float(s), bool(b)) for s, b in zip(scores, bad, strict=True)], "anomaly double, bad boolean")
        assert quality.threshold(df) == quality.calibrate(scores, bad)
    assert quality.threshold(df.where("not bad")) == quality.threshold(df.limit(0)) == quality.threshold(df.select("anomaly", F.col("anomaly").isNull().alias("bad"))) == float("inf")
