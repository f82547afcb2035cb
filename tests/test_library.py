"""Cleaning, keys, reports and checks of result files against plain Python."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from matchloom.functions import rules, text
from matchloom.operators import blocking, candidates, eda, models, normalise, reports, selection
from matchloom.sources import files, lists


def test_apostrophes_part_words_in_addresses_only(spark):
    raw = [("Nash's L.L.C. & Co", "nashs llc and co", "nash s l l c and co"), ("Val d'Oise", "val doise", "val d oise"), ("l`Eglise no.330", "leglise no330", "l eglise no 330"), ("", "", ""), ("--", "", "")]
    df = spark.createDataFrame(raw, "raw string, name string, addr string")
    for r in df.select("*", text.clean(F.col("raw"), True).alias("n"), text.clean(F.col("raw"), False).alias("a")).collect():
        assert (r["n"], r["a"]) == (r["name"], r["addr"])
        assert (text.clean_text(r["raw"], True), text.clean_text(r["raw"])) == (r["name"], r["addr"])


def test_departements_with_apostrophes(spark):
    rows = [("S1-1", "Boulangerie", "12 Rue de l'Eglise, Pontoise, Val d'Oise", "France"), ("S1-2", "Garage", "3 Place, Dijon, Côte-d'Or", "France"), ("S1-3", None, None, None)]
    df = spark.createDataFrame(rows, "entity_id string, business_name string, business_address string, country string")
    got = {r["entity_id"]: r for r in normalise.normalise_records(df).collect()}
    assert got["S1-1"]["addr_norm"] == "12 rue de l eglise, pontoise, val d oise"
    assert (got["S1-1"]["city"], got["S1-1"]["dept"], got["S1-2"]["city"], got["S1-2"]["dept"]) == ("pontoise", "val d oise", "dijon", "cote d or")
    assert got["S1-3"]["addr_norm"] == "" and got["S1-3"]["city"] is None


def test_transliteration_by_folding_equals_the_plain_one(spark):
    draw = random.Random(3)
    pools = ["abc XYZ 019 &'", "éàüñçøłßæœþı’–—ÅŽǅẞ", "½²…ﬁ́̈", "日本語कमरा"]
    texts = [None, "", *["".join(draw.choices(draw.choice(pools) + draw.choice(pools), k=draw.randint(0, 20))) for _ in range(400)]]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    for r in df.select("i", "t", text.transliterate(F.col("t")).alias("x"), text.plain_ascii(F.col("t")).alias("p")).collect():
        assert r["x"] == text.to_ascii(r["t"]), r["t"]
        assert r["p"] == text.clean_text(r["t"])


def test_legal_tables_by_country():
    assert rules.LEGAL["us"].items() >= rules.LEGAL_GENERAL.items() and "gmbh" not in rules.LEGAL["india"]
    assert rules.LEGAL[""].items() >= rules.LEGAL_INTERNATIONAL.items() and "sarl" in rules.LEADING[""] and "sarl" not in rules.LEADING["us"]


def test_grid_of_rules_and_pruned_lists(spark):
    grid = candidates.settings()
    assert len(grid) == len(set(grid)) == 496 and Counter(x.family for x in grid) == {"fixed": 79, "reverse": 33, "adaptive": 384}
    draw = random.Random(1)
    pairs = [(f"S1-{i}", f"S2-{j}", draw.choice([0.001, 0.004, 0.05, 0.3, 0.3, 0.9])) for i in range(12) for j in range(draw.randint(0, 25))]
    truth = [(s, c) for s, c, p in pairs if draw.random() < p] + [("S1-0", "S3-9")]
    df, t = spark.createDataFrame(pairs, "s1 string, cand string, p double"), spark.createDataFrame(truth, "s1 string, cand string")
    s1s = spark.createDataFrame([(f"S1-{i}",) for i in range(12)], "s1 string")
    got = {(r["tau"], r["cap"]): (r["n"], r["hits"], r["avg_size"], r["recall"]) for r in candidates.pruned_stats(df, t, s1s).collect()}
    assert len(got) == 54
    for tau, cap in got:
        chosen = candidates.prune(df, "p", tau, cap or 10**6).select("s1", "cand").collect()
        hits = sum((r["s1"], r["cand"]) in set(truth) for r in chosen)
        assert got[tau, cap] == (len(chosen), hits, pytest.approx(len(chosen) / 12), pytest.approx(hits / len(set(truth))))


def test_lists_swapped_appended_and_kept_first(spark):
    pairs = lambda rows: spark.createDataFrame(rows, "s1 string, cand string, score double")
    old, new = pairs([("a", "x", 0.5), ("a", "y", 0.4), ("b", "x", 0.9)]), pairs([("a", "z", 0.1), ("b", "q", 0.2), ("c", "z", 0.3)])
    ids = spark.createDataFrame([("a",), ("a",), ("c",)], "s1 string")
    assert sorted(map(tuple, candidates.swap_lists(old, new, ids).collect())) == [("a", "z", 0.1), ("b", "x", 0.9), ("c", "z", 0.3)]
    got = candidates.append_new(old, pairs([("a", "x", 0.7), ("a", "w", 0.7), ("d", "x", 0.1)])).collect()
    assert sorted((r["s1"], r["cand"], r["score"], r["best"]) for r in got) == [("a", "w", 0.7, 0.5), ("a", "x", 0.5, 0.5), ("a", "y", 0.4, 0.5), ("b", "x", 0.9, 0.9), ("d", "x", 0.1, None)]
    assert sorted(map(tuple, candidates.keep_first(old, ["cand"], F.desc("score"), F.col("s1")).collect())) == [("a", "y", 0.4), ("b", "x", 0.9)]
    assert selection.set_differences(old.select("s1"), new.select("s1")).first() == (0, 1)


def test_slices_are_whole_and_about_equal(spark):
    got = models.slices(spark.range(7000).withColumn("id", F.concat(F.lit("k"), F.col("id") % 3500)), "id", 7).collect()
    assert len({(r["id"], r["slice"]) for r in got}) == 3500 and set(Counter(r["slice"] for r in got)) == set(range(7))
    assert all(abs(n - 1000) < 150 for n in Counter(r["slice"] for r in got).values())


def test_raw_lines_of_result_files(spark, tmp_path):
    good = "source1_entity_id\tmatched_entity_ids\nS1-1\tS2-1,S3-2\n\nS1-2\t\n"
    bad = 'S1-3\tS2-1\tx\nS1-4 S2-1\nS1-5\t"S2-1"\n S1-6\tS2-1\nS1-7\tS2-1, S2-2\n'
    (tmp_path / "a.tsv").write_text(good)
    (tmp_path / "b.tsv").write_text(bad)
    got = {r["finding"]: r["n"] for r in lists.validate_lines(lists.raw_lines(spark, str(tmp_path))).collect()}
    assert got == {"header": 1, "columns": 2, "quoted": 1, "blanks": 2}
    assert {r["n"] for r in lists.validate_lines(lists.raw_lines(spark, str(tmp_path / "a.tsv"))).collect()} == {0}


def test_parts_become_one_table(spark, tmp_path):
    parts = [str(tmp_path / f"p{k}") for k in range(3)]
    for k, p in enumerate(parts):
        df = spark.range(k * 10, k * 10 + 10)
        (df.withColumn("more", F.lit(k)) if k else df).write.parquet(p)
    out = files.concat_parts(spark, parts, str(tmp_path / "all"))
    assert sorted((r["id"], r["more"]) for r in out.collect()) == [(i, i // 10 or None) for i in range(30)]
    assert not any((tmp_path / f"p{k}").exists() for k in range(3))


def test_keys_of_raw_records(spark):
    recs = [
        (1, "us", "S1", "Blue Café Inc", "1 Main St, Springfield, Ohio"), (2, "us", "S1", "Blue Bar", "75001 Elm 44444 123456, Springfield, Ohio"), (3, "us", "S2", "Red Bar", "Ohio, Dayton 9"),
        (4, "us", "S2", None, None), (5, "fr", "S1", "", ",,"), (6, "us", "S1", "Blue Bar", "Springfield"),
    ]
    df = spark.createDataFrame(recs, "id long, country string, src string, name string, addr string")
    assert {(r["country"], r["c"]) for r in eda.regions(df).collect()} == {("us", "ohio")}
    got = {r["id"]: tuple(r)[1:] for r in eda.add_keys(df).collect()}
    assert got[1] == ("springfield", None, "blue", "cafe") and got[2] == ("springfield", "123456", "blue", "bar")
    assert got[3][0] is None and got[4] == got[5] == (None, None, None, None)
    pairs = spark.createDataFrame([(1, 2), (1, 3), (2, 6)], "s1 long, cand long")
    agree = {r["key"]: (r["pairs"], r["same"], r["missing"]) for r in eda.key_agreement(pairs, eda.add_keys(df)).collect()}
    assert agree == {"city_key": (3, 2, 1), "postcode": (3, 0, 3), "first_tok": (3, 2, 0), "rare_tok": (3, 1, 0), "none": (3, 1, 0)}
    assert [tuple(r) for r in eda.frequent_names(df).collect()] == [("us", "blue bar", 2, 2)]


def test_reports(spark):
    scored = spark.createDataFrame([("S1-1", "S2-1", 1.0), ("S1-1", "S3-2", 0.55), ("S1-2", "S2-3", 0.95), ("S1-2", "S2-4", 0.2)], "s1 string, cand string, p double")
    truth = spark.createDataFrame([("S1-1", "S2-1"), ("S1-1", "S3-2"), ("S1-2", "S2-4"), ("S1-2", "S2-9")], "s1 string, cand string")
    chosen = scored.where("p >= 0.9")
    recs = [("S1-1", "us", "a", "x y"), ("S1-2", "us", None, "z"), ("S2-1", "us", "a", "x y"), ("S3-2", "us", "b", "x w"), ("S2-3", "us", "b", "z"), ("S2-4", "us", "b", "q"), ("S2-9", "us", "c", "z")]
    records = spark.createDataFrame(recs, "entity_id string, country string, state string, core_name string")
    assert sorted(map(tuple, reports.calibration(scored, truth).collect())) == [(2, 1, 0.2, 1.0), (5, 1, 0.55, 1.0), (9, 2, 0.975, 0.5)]
    assert {tuple(r) for r in reports.error_bands(scored, chosen, truth).collect()} == {("wrong", "high", 1), ("missed", "mid", 1), ("missed", "low", 1), ("missed", "none", 1)}
    assert {tuple(r) for r in reports.error_groups(scored, chosen, truth, records).collect()} == {("us", "wrong", True, None, 1), ("us", "missed", False, False, 1), ("us", "missed", False, None, 1), ("us", "missed", True, None, 1)}
    assert {tuple(r) for r in reports.group_recall(scored, truth, records).collect()} == {("us", "all", 4, 3), ("us", "stateless", 2, 1), ("us", "moved", 1, 1), ("us", "third", 1, 1)}
    methods = spark.createDataFrame([("m", "S1-1", "S2-1"), ("n", "S1-1", "S3-2"), ("n", "S1-2", "S2-9")], "method string, s1 string, cand string")
    assert {tuple(r) for r in reports.stress_methods(methods, truth, records).collect()} == {("m", "equal", 2, 1), ("m", "word", 1, 0), ("m", "none", 1, 0), ("n", "equal", 2, 1), ("n", "word", 1, 1), ("n", "none", 1, 0)}


def test_dense_topk_equals_brute_force_over_tiles_ties_and_faulty_vectors(spark, monkeypatch):
    monkeypatch.setattr(blocking, "QUERY_TILE", 7)
    monkeypatch.setattr(blocking, "POOL_TILE", 25)
    rows = [(i, [float((i * 7 + j * j) % 5 - 2) for j in range(4)]) for i in range(120)]  # many equal directions
    rows += [(200, [1.0, 2.0]), (201, [2.0, 4.0]), (202, [-1.0, 1.0]), (300, None), (301, []), (302, [0.0] * 4), (303, [1.0, None, 0.0, 0.0]), (304, [float("nan"), 1.0, 0.0, 0.0]), (None, [1.0] * 4)]
    df = spark.createDataFrame(rows, "id long, embedding array<float>")
    got = {(r["s1"], r["rank"]): (r["cand"], r["score"]) for r in blocking.dense_topk(df.where("id % 5 = 0 OR id IS NULL"), df, 6).collect()}
    good = {i: v for i, v in rows if i is not None and v and all(x is not None and x == x for x in v) and any(v)}

    def cosine(a, b):
        return round(sum(x * y for x, y in zip(a, b)) / (sum(x * x for x in a) ** 0.5 * sum(x * x for x in b) ** 0.5), 6)

    want = {}
    for s in (i for i in good if i % 5 == 0):
        near = sorted((-cosine(good[s], good[c]), c) for c in good if c != s and len(good[c]) == len(good[s]))[:6]
        want |= {(s, r): (c, -x) for r, (x, c) in enumerate(near, 1)}
    assert got.keys() == want.keys()
    assert all(got[key][0] == c and abs(got[key][1] - x) < 1.5e-6 for key, (c, x) in want.items())
    assert blocking.dense_topk(df.where("id < 0"), df, 6).count() == 0
    assert blocking.dense_topk(df, df.where("id < 0"), 6).count() == 0
