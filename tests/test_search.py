"""The tiled search against all pairs."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from matchloom.functions.text import char_grams
from matchloom.operators import blocking
from matchloom.plans import registry

SF = "/root/testdata/sf0.001"
PARTS = [a + b for a in ("ka", "lo", "mi", "nu") for b in ("ban", "cor", "dil", "fes", "g")]


def made_up(n, extra=()):
    draw, rows = random.Random(5), []
    for i in range(n):
        text = " ".join(draw.choices(PARTS, k=draw.choice((1, 2, 5)))) if i % 5 else "kaban locor"  # every fifth one is a copy
        rows.append((f"S{i % 3 + 1}-{i}", draw.choice(("US", "France", None)), draw.choice(("x", "y", blocking.NONE)), draw.choice((text, None)) if i % 11 == 0 else text))
    return [*rows, *extra]


def both_ways(spark, rows, k, by="s1", **how):
    texts = spark.createDataFrame(rows, "id string, country string, bucket string, text string").cache()
    s1 = F.col("id").startswith("S1-")
    posted = blocking.postings(texts, **how)
    plain = blocking.forward if by == "s1" else blocking.reverse
    tiled = blocking.search_forward if by == "s1" else blocking.search_reverse
    want, got = plain(posted.where(s1), posted.where(~s1), k), tiled(texts, s1, ~s1, k, **how)
    assert want.columns == got.columns and want.dtypes == got.dtypes
    want, got = sorted(map(tuple, want.collect())), sorted(map(tuple, got.collect()))
    assert want
    return want, got


@pytest.mark.parametrize(("by", "k"), [("s1", 1), ("s1", 5), ("s1", 500), ("cand", 3)])
def test_tiles_find_what_all_pairs_do(spark, monkeypatch, by, k):
    monkeypatch.setattr(blocking, "ASK_TILE", 7)
    monkeypatch.setattr(blocking, "OTHER_TILE", 11)
    want, got = both_ways(spark, made_up(150), k, by, max_df=0.6)
    assert want == got


def test_ids_that_repeat(spark):
    """In one bucket their grams are counted together; in several, each pair's scores are added up."""
    again = [("S1-0", "US", "x", "kaban locor"), ("S1-0", "US", "x", "midil"), ("S1-0", "US", blocking.NONE, "nufes midil"), ("S2-1", "US", "x", "kaban"), ("S2-1", "US", blocking.NONE, "locor"), ("S2-1", "France", "y", "locor mig"), (None, "US", "x", "kaban locor")]
    for by, k in (("s1", 4), ("cand", 2)):
        want, got = both_ways(spark, made_up(60, again), k, by, max_df=0.9)
        assert want == got
    assert both_ways(spark, made_up(60, again[:2]), 4, max_df=0.9)[0]


def test_no_side(spark):
    texts = spark.createDataFrame(made_up(12), "id string, country string, bucket string, text string")
    assert blocking.search(texts, F.col("id") == "none", F.lit(True), 3).isEmpty()
    assert blocking.search(texts, F.lit(True), F.col("id") == "none", 3).isEmpty()
    assert blocking.search(texts.limit(0), F.lit(True), F.lit(True), 3).isEmpty()


def test_grams_as_in_spark(spark):
    texts = ["kaban  locor", "", " a\tbc\n", "é ü mañana", "\U0001d11ex \x1c y", "a"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    for low, high in ((3, 4), (2, 3)):
        assert sorted(sorted(r[0]) for r in rows.select(char_grams(F.col("t"), low, high)).collect()) == sorted(sorted(blocking.grams_of(t, low, high)) for t in texts)


def test_batches_of_a_tile(monkeypatch):
    """However little is held at a time, the same rows."""
    draw = random.Random(2)
    side = lambda other, n: [("x" if i % 3 else blocking.NONE, " ".join(draw.choices(PARTS, k=3)), [f"{other}{i}"], other) for i in range(n)]
    texts = pd.DataFrame(side(False, 30) + side(True, 40), columns=["bucket", "text", "ids", "other"])
    grams = sorted({g for t in texts["text"] for g in blocking.grams_of(t, 3, 4)})
    idf = pd.DataFrame({"gram": grams, "idf": np.linspace(1, 3, len(grams))})
    want = blocking._search_tile(4, (3, 4))(texts, idf)
    monkeypatch.setattr(blocking, "PRODUCTS", 50)
    monkeypatch.setattr(blocking, "CELLS", 100)
    got = blocking._search_tile(4, (3, 4))(texts, idf)
    pd.testing.assert_frame_equal(want, got)
    assert len(want) > 60


@pytest.mark.parametrize("name", ["name_search", "reverse_search", "eda_hard_negatives", "skeleton_search", "search_piece", "match_lists_whole"])
def test_searches_make_no_row_of_every_pair(spark, monkeypatch, name):
    """With rows of all pairs that share a gram the disk fills: some 5 thousand million on 250,000 documents."""

    def never(*_):
        raise AssertionError("all pairs")

    monkeypatch.setattr(blocking, "scores", never)
    assert registry.queries()[name](spark, SF).columns
