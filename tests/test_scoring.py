"""Scoring, selection protocols, reports and files on small tables, against plain Python."""

import math
import random
import statistics

import pytest
from pyspark.sql import functions as F

from matchloom.functions import similarity
from matchloom.operators import blocking, candidates, effectiveness, models, normalise, pair_extra, selection
from matchloom.plans import matching, registry
from matchloom.sources import files, lists

PREPARED = "entity_id string, country string, state string, core_name string, nolegal string, legal string, addr_norm string, numbers array<string>"


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_extra_features_equal_plain_python(spark):
    draw = random.Random(3)
    words = ["willow", "cafe", "services", "north", "zorbex", "group", "mill"]
    texts = ["", None, "12 elm street, austin", "elm street 12, austin", "9 oak road"]
    recs = []
    for i in range(30):
        name = " ".join(draw.sample(words, draw.randint(1, 3)))
        recs.append((f"S{i % 2 + 1}-{i}", "US", draw.choice(["tx", None]), name, name, draw.choice(["llc", "inc", "", None]), draw.choice(texts), draw.choice([["12"], ["9"], [], None])))
    pairs = [(a[0], b[0]) for a in recs if a[0].startswith("S1") for b in recs if b[0].startswith("S2")]
    got = pair_extra.extra_features(spark.createDataFrame(pairs, "s1 string, cand string"), spark.createDataFrame(recs, PREPARED)).collect()
    assert len(got) == len(pairs)
    by, df = {r[0]: r for r in recs}, {}
    for r in recs:
        for w in set(r[3].split()):
            df[w] = df.get(w, 0) + 1
    idf = {w: math.log(len(recs) / n) for w, n in df.items()}
    for r in got:
        a, b = by[r["s1"]], by[r["cand"]]
        diff = set(a[4].split()) ^ set(b[4].split())
        other = [w for w in diff if w not in pair_extra.DESCRIPTORS]
        near = similarity.token_sort(a[4], b[4])
        x, y = a[6] or "", b[6] or ""
        same_addr = bool(x and y) and similarity.token_sort(x, y) >= 0.95
        same_num = bool(a[7] and b[7]) and a[7][0] == b[7][0]
        n_name = sum((r2[2] or "", r2[3]) == (a[2] or "", a[3]) for r2 in recs)
        n_addr = sum(r2[6] == x for r2 in recs) if x else 0
        legal = bool(a[5] and b[5]) and a[5] != b[5]
        want = {
            "b1_n_diff": len(diff), "b1_n_other_diff": len(other), "b1_n_desc_diff": len(diff) - len(other), "b1_idf_diff": sum(idf[w] for w in other), "b1_idf_diff_max": max([idf[w] for w in other], default=0.0),
            "b2_legal_diff": legal, "b2_legal_diff_addr_same": legal and same_addr, "b3_addr_empty_one": not (x and y), "b3_name_near": near >= 0.95, "b3_empty_near": not (x and y) and near >= 0.95,
            "b3_name_freq_state": math.log1p(n_name), "b3_empty_near_rare": not (x and y) and near >= 0.95 and n_name <= 3, "b4_same_addr": same_addr, "b4_same_num": same_num,
            "b4_trade": same_addr and same_num and near < 0.5, "b4_addr_freq": math.log1p(n_addr), "b4_trade_rare_addr": same_addr and same_num and near < 0.5 and n_addr <= 5,
        }
        for k, v in want.items():
            assert r[k] == pytest.approx(float(v)), (k, a, b)
        assert (r["b2_addr_sort"] is None) == (not (x and y))


def test_set_and_rival_features(spark):
    draw = random.Random(5)
    names = ["willow llc", "willow", "zorbex mill", ""]
    recs = [(f"S2-{i}", draw.choice(names), draw.choice(["12 elm", "9 oak", None]), draw.choice([["12"], ["9"], None])) for i in range(12)]
    scored = [(f"S1-{q}", f"S2-{i}", draw.choice([0.1, 0.55, 0.85, 0.95])) for q in range(5) for i in draw.sample(range(12), 6)]
    df = spark.createDataFrame(scored, "s1 string, cand string, s_p1 double")
    by = {r[0]: r for r in recs}
    got = {(r["s1"], r["cand"]): r for r in pair_extra.set_features(df, spark.createDataFrame(recs, "entity_id string, full_name string, addr_norm string, numbers array<string>")).collect()}
    rivals = {(r["s1"], r["cand"]): r for r in pair_extra.rival_features(df).collect()}
    assert len(got) == len(rivals) == len(scored)
    sim = lambda x, y: similarity.token_set(x, y) if x and y else 0.0
    for s1, cand, p in scored:
        mine = [x for x in scored if x[0] == s1]
        r, a = got[s1, cand], by[cand]
        sure = [by[c] for _, c, q in mine if q > 0.8 and c != cand]
        assert r["s_rank"] == sorted(mine, key=lambda x: (-x[2], x[1])).index((s1, cand, p)) + 1
        assert r["s_gap"] == max(x[2] for x in mine) - p and r["s_n05"] == sum(x[2] > 0.5 for x in mine) and r["s_n09"] == sum(x[2] > 0.9 for x in mine)
        assert r["s_sim_name"] == (max(sim(a[1], o[1]) for o in sure) if sure else None)
        assert r["s_sim_addr"] == (max(sim(a[2], o[2]) for o in sure) if sure else None)
        assert r["s_num_eq"] == (max(float(bool(a[3] and o[3]) and a[3][0] == o[3][0]) for o in sure) if sure else None)
        others = [q for o, c, q in scored if c == cand and o != s1]
        x = rivals[s1, cand]
        assert (x["x_p_other"], x["x_n_other05"]) == (max(others, default=0.0), sum(q > 0.5 for q in others)) and x["x_lead"] == p - max(others, default=0.0)


def test_grid_equals_one_rule_at_a_time(spark):
    draw = random.Random(11)
    hits = []
    for q in range(6):
        for rank, c in enumerate(draw.sample(range(20), 8), 1):
            for m in blocking.METHODS:
                if draw.random() < 0.6:
                    hits.append(("state", f"S1-{q}", f"S2-{c}", m, round(1 - rank / 10 + draw.random() / 20, 3), rank, 0.95 if m == "reverse" else None))
    df = spark.createDataFrame(hits, "scope string, s1 string, cand string, method string, score double, rank long, best double")
    wide = candidates.add_best(blocking.to_wide(df)).cache()
    truth = spark.createDataFrame([(f"S1-{q}", f"S2-{c}") for q in range(6) for c in range(3)], "s1 string, cand string")
    s1s = spark.createDataFrame([(f"S1-{q}",) for q in range(7)], "s1 string")
    grid = candidates.settings()
    assert len(grid) == 496 and len({x.name() for x in grid}) == 496
    some = draw.sample(grid, 4) + [grid[-1]]
    got = {r["config"]: r for r in candidates.grid_stats(wide, truth, s1s, grid).collect()}
    assert len(got) == 496
    for x in some:
        chosen = candidates.select_cap(wide, candidates.rule(**x.bars()), x.cap or 1000)
        n, hit = chosen.count(), chosen.join(truth, ["s1", "cand"], "left_semi").count()
        assert (got[x.name()]["n"], got[x.name()]["hits"]) == (n, hit)
        assert got[x.name()]["avg_size"] == pytest.approx(n / 7) and got[x.name()]["recall"] == pytest.approx(hit / 18)


def test_wide_lists_are_as_deep_as_the_rules_ask(spark, tmp_path):
    words = ["zorbex", "willow", "kumquat", "finch", "harbour", "plinth"]
    rows = [(i, f"{words[i // 90]} shop rare{i // 18}\n".ljust(60) + f"{i % 90} elm street, {words[i // 90]}ville", "en", "web", 100) for i in range(540)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    wide = matching._wide(spark, str(tmp_path))
    deepest = wide.agg(*[F.max(f"rank_{m}").alias(m) for m in blocking.METHODS]).first().asDict()
    assert (deepest["name"], deepest["name_city"], deepest["name_addr"], deepest["reverse"]) == (50, 50, 50, 5)
    assert deepest["rare"] == 12  # all that a token of 18 records leads to
    sizes = {k: wide.where(candidates.rule(fwd_k=k)).count() for k in (5, 10, 20, 50)}
    assert sizes[5] < sizes[10] < sizes[20] < sizes[50]


def test_normalised_records_read_whole_texts(spark, tmp_path):
    name, far = "zorbex " * 20 + "end", "elm road, " * 40 + "last 4711"
    rows = [(1, f"{name}\n{far}", "en"), (2, name, "en"), (3, None, "en")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["entity_id"]: r for r in matching.normalised_records(spark, str(tmp_path)).collect()}
    assert got["S2-1"]["core_name"] == name and got["S3-2"]["core_name"] == name
    assert got["S2-1"]["numbers"] == ["4711"] and got["S2-1"]["addr_norm"].endswith("last 4711") and got["S2-1"]["addr_norm"].count(",") == 40
    assert got["S3-2"]["business_address"] == "" and got["S1-3"]["business_address"] is None


def test_whole_texts_are_transliterated(spark, tmp_path):
    spark.createDataFrame([(1, "plain\nCafé\nœuvre Straße"), (2, "é\r\n\nплан"), (3, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = dict(map(tuple, registry.queries()["transliterated_text"](spark, str(tmp_path)).collect()))
    assert got == {1: "plain\nCafe\noeuvre Strasse", 2: "e\r\n\npeelaen", 3: ""}


def test_protocols(spark):
    scored = spark.createDataFrame([(f"S1-{i}", f"S2-{i}", 0.3 + 0.05 * (i % 10)) for i in range(40)], "s1 string, cand string, p double")
    truth = scored.where("p >= 0.5").select("s1", "cand")
    best = selection.tune_and_report(scored, truth, scored.select("s1"), [0.3, 0.47, 0.7], [0.0]).collect()
    assert [(r["tau"], r["f05_tune"], r["f05_report"]) for r in best] == [(0.47, 1.0, 1.0)]
    taus = spark.createDataFrame([("US",), ("Chad",), (None,)], "country string").select("country", selection.unseen_tau(0.85, 0.1, ["US"]).alias("t"))
    assert {r["country"]: r["t"] for r in taus.collect()} == {"US": 0.85, "Chad": 0.9, None: 0.9}
    assert selection.robust_choice({"A": 0.97, "B": 0.968, "C": 0.9}) == "B" and selection.robust_choice({"D": 0.9}) == "D"
    old = {"overall": 0.9, "US": 0.9, "precision": 0.99}
    assert selection.keeps({"overall": 0.91, "US": 0.91, "precision": 0.986}, old)
    assert not selection.keeps({"overall": 0.91, "US": 0.89, "precision": 0.99}, old) and not selection.keeps({"overall": 0.91, "US": 0.91, "precision": 0.98}, old)
    assert models.unseen_shift([{"tau_source": 0.5, "tau_target": 0.6, "at_source": 0.8, "at_target": 0.9, "pseudo": 0.7}] * 2) == (pytest.approx(0.1), False)
    assert models.unseen_shift([{"tau_source": 0.5, "tau_target": x, "at_source": 0.8, "at_target": 0.9, "pseudo": 0.9} for x in (0.4, 0.6)]) == (0.0, True)


def test_samples_and_sieve(spark):
    df = spark.createDataFrame([("a", f"c{i}", s, int(i < 2)) for i, s in enumerate((0.39, 0.3, 0.3, 0.3, 0.1, 0.05))] + [("b", "d", 0.01, 0)], "s1 string, cand string, p double, y int")
    assert rows(candidates.sieve(df, "p"), "cand") == [("c0",), ("c1",), ("c2",), ("c3",), ("d",)]
    assert candidates.training_sample(df, "y", 100).count() == 7
    assert rows(candidates.training_sample(df, "y", 2), "cand") == [("c0",), ("c1",)]
    assert candidates.training_sample(df.where("1 = 0"), "y", 2).isEmpty()
    both = spark.createDataFrame([("a", "x", 0.95, 0.99), ("a", "y", 0.95, 0.5), ("a", "z", 0.01, 0.01), ("b", "z", 0.02, 0.02), ("c", "z", 0.03, 0.0)], "s1 string, cand string, ce double, tree double")
    got = models.agreed_labels(both, "ce", "tree", per_positive=2)
    assert got.where("label = 1").count() == 1 and got.where("label = 0").count() == 2


def test_blends_and_models(spark):
    draw = random.Random(2)
    data = [(f"S1-{i}", f"S2-{i}", round(draw.random(), 1), draw.random()) for i in range(60)]
    df = spark.createDataFrame(data, "s1 string, cand string, a double, b double")

    def rank(x, xs):
        return sum(y < x for y in xs) + (sum(y == x for y in xs) + 1) / 2

    want = {d[1]: (rank(d[2], [x[2] for x in data]) + rank(d[3], [x[3] for x in data])) / 120 for d in data}
    got = {r["cand"]: r["p"] for r in models.blend(df, "a", "b", "rank").collect()}
    assert got == {k: pytest.approx(v) for k, v in want.items()}
    labelled = df.withColumn("y", (F.col("b") > 0.5).cast("int")).cache()
    model = models.train(labelled.withColumn("stop", F.col("a") > 0.7), ["a", "b"], "y", rounds=3, depth=2, held_out="stop")
    gain = models.importance(model, ["a", "b"])
    assert list(gain)[0] == "b" and sum(gain.values()) == pytest.approx(1)
    mean = models.seed_mean(labelled, df, ["a", "b"], "y", [1, 2], rounds=2, depth=2)
    assert mean.columns == [*df.columns, "p"] and mean.where("p < 0 or p > 1").isEmpty()
    assert models.search(lambda p: p.get("depth", 0), 5, seed=1)[0][0] >= 4
    texts = spark.createDataFrame([("willow cafe", "willow cafe llc", 1), ("zorbex mill", "mill zorbex", 1), ("oak bank", "elm school", 0), ("red shop", "blue unit", 0), (None, "x", 0)] * 4, "text_1 string, text_2 string, y int")
    out = models.TextScorer(size=4096).fit(texts, "y").score(texts)
    assert out.where("y = 1").agg(F.min("p_ce")).first()[0] > out.where("y = 0").agg(F.max("p_ce")).first()[0]


def test_hardest_and_auc(spark):
    q = spark.createDataFrame([("S1-1", "US", "willow cafe"), ("S1-2", "US", "zorbex mill")], "id string, country string, text string")
    pool = spark.createDataFrame([("S2-1", "US", "willow cafe"), ("S2-2", "US", "willow caffe"), ("S2-3", "US", "zorbex mills"), ("S2-4", "US", "oak bank willow"), ("S2-5", "France", "willow cafe")], "id string, country string, text string")
    truth = spark.createDataFrame([("S1-1", "S2-1")], "s1 string, cand string")
    assert rows(effectiveness.hardest(q, pool, truth, max_df=1.0), "s1", "cand") == [("S1-1", "S2-2"), ("S1-2", "S2-3")]
    draw = random.Random(9)
    data = [("US", float(draw.randint(0, 5)), draw.random() < 0.4) for _ in range(80)]
    won = [(x > y) + 0.5 * (x == y) for _, x, p in data if p for _, y, n in data if not n]
    got = effectiveness.auc(spark.createDataFrame(data, "country string, s double, y boolean"), ["country"], "s", "y").first()["auc"]
    assert got == pytest.approx(sum(won) / len(won))


def names_of(n, seed):
    draw = random.Random(seed)
    return [" ".join("".join(draw.choices("abcdefghijklmnopqrstuvwxyz", k=6)) for _ in range(2)) for _ in range(n)]


def test_similarities_are_those_of_all_queries(spark):
    """More queries of a country than were once drawn: each one has its true pair and its hardest other in the counts, shares and medians."""
    n, names = 2300, names_of(2300, 4)
    q = spark.createDataFrame([(f"S1-{i}", "US", x) for i, x in enumerate(names)], "id string, country string, text string")
    true = [(f"S2-{i}", "US", x) for i, x in enumerate(names)]
    # Even queries' hardest other has the words the other way round, odd ones' has one more letter in front of the first word.
    other = [(f"S3-{i}", "US", f"x{x}" if i % 2 else " ".join(reversed(x.split()))) for i, x in enumerate(names)]
    truth = spark.createDataFrame([(f"S1-{i}", f"S2-{i}") for i in range(n)], "s1 string, cand string")
    got = effectiveness.compare(q, spark.createDataFrame(true + other, q.schema), truth, max_df=0.2).cache()
    assert rows(got.where("not is_true"), "s1", "cand") == sorted((f"S1-{i}", f"S3-{i}") for i in range(n))
    tsr = [100 * similarity.token_set(x, y[2]) for x, y in zip(names, other, strict=True)]
    assert [x == 100 for x in tsr] == [i % 2 == 0 for i in range(n)]
    by_kind = {r["is_true"]: r for r in effectiveness.summary(got).collect()}
    assert {k: (r["pairs"], r["tsr_median"]) for k, r in by_kind.items()} == {True: (n, 100.0), False: (n, pytest.approx(statistics.median(tsr)))}
    grams = lambda t: {t[i : i + 3] for i in range(len(t) - 2)}
    jac = [100 * len(grams(x) & grams(y[2])) / len(grams(x) | grams(y[2])) for x, y in zip(names, other, strict=True)]
    assert by_kind[False]["jac3_median"] == pytest.approx(statistics.median(jac))
    assert by_kind[False]["jac3_below_70"] == pytest.approx(sum(x < 70 for x in jac) / n)


def test_hardest_of_queries_with_many_true_ones(spark):
    """True ones that fill the list of candidates do not leave a query without its hardest other."""
    sizes = {f"S1-{i}": k for i, k in enumerate((0, 1, 8, 9, 24, 25, 40, 140))}
    names = dict(zip(sizes, names_of(len(sizes), 6), strict=True))
    q = spark.createDataFrame([(i, "US", x) for i, x in names.items()], "id string, country string, text string")
    truth = [(i, f"S2-{i[3:]}-{j}") for i, k in sizes.items() for j in range(k)]
    pool = [(c, "US", names[i]) for i, c in truth] + [(f"S3-{i[3:]}", "US", f"{x}y") for i, x in names.items()]
    got = effectiveness.hardest(q, spark.createDataFrame(pool, q.schema), spark.createDataFrame(truth, "s1 string, cand string"), max_df=1.0)
    assert rows(got, "s1", "cand") == sorted((i, f"S3-{i[3:]}") for i in names)


def test_auc_query_counts_all_queries(spark, tmp_path):
    """2,300 queries of a country: half of them have an equally similar other, so the true pair wins three times of four, exactly."""
    names, docs = names_of(2300, 8), []
    odd = names_of(2300, 9)
    for i, (x, y) in enumerate(zip(names, odd, strict=True)):
        other = y if i % 2 else " ".join(reversed(x.split()))
        docs += [(3 * i, f"{x}\n{'a' * 80}"), (3 * i + 1, f"{x}\n{'a' * 80}"), (3 * i + 2, f"{other}\n{'b' * 80}")]
    df = spark.createDataFrame([(i, t, "en", "web", len(t)) for i, t in docs], "doc_id long, text string, lang string, source string, n_chars long")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    got = registry.queries()["effectiveness_auc"](spark, str(tmp_path)).collect()
    assert [tuple(r) for r in got] == [("US", 0.75, 1.0)]


def test_token_set_equals_its_three_ratios():
    draw = random.Random(1)
    words = ["a", "ab", "aba", "bab", "é", *names_of(4, 2)]
    for _ in range(2000):
        a, b = (" ".join(draw.choices(words, k=draw.randint(0, 6))) for _ in range(2))
        x, y = set(a.split()), set(b.split())
        both, left, right = (" ".join(sorted(z)) for z in (x & y, x - y, y - x))
        one, two = f"{both} {left}".strip(), f"{both} {right}".strip()
        want = 1.0 if both and not (left and right) else max(similarity.ratio(*z) if both or z == (one, two) else 0.0 for z in ((one, two), (both, one), (both, two)))
        assert similarity.token_set(a, b) == want


def test_state_aliases_are_learned_and_checked(spark):
    pairs = [(f"p{i}", "India", f"{i} Main Road, {('Hyderabad', 'Warangal', 'Nizamabad')[i % 3]}, Telangana", f"{i} Main Road, {('Hyderabad', 'Warangal', 'Nizamabad')[i % 3]}, Telmgan") for i in range(60)]
    pairs += [(f"b{i}", "India", f"{i} Main Road, Mumbai, Maharashtra", f"{i} Main Road, Bombay, Maharashtra") for i in range(60)]
    df = spark.createDataFrame(pairs, "pair_id string, country string, addr_1 string, addr_2 string")
    aliases = normalise.learn_state_aliases(df)
    assert rows(aliases, "c", "state") == [("telmgan", "telangana")]
    assert rows(normalise.alias_diagnostics(df, aliases), "alias", "state", "pairs", "purity") == [("telmgan", "telangana", 60, 1.0)]


def test_files(spark, tmp_path):
    df = spark.createDataFrame([("S1-1", 'say "x"\tor y', None), ("S1-2", "", "é")], "id string, a string, b string")
    lists.write_tsv(df, f"{tmp_path}/t")
    assert rows(lists.read_tsv(spark, f"{tmp_path}/t", df.columns), "id", "a", "b") == [("S1-1", 'say "x"\tor y', ""), ("S1-2", "", "é")]
    made = []
    make = lambda: made.append(1) or df
    assert not files.done(spark, f"{tmp_path}/once")
    assert [files.once(spark, f"{tmp_path}/once", make).count() for _ in range(2)] == [2, 2] and made == [1]
    files.write_json(spark, {"b": 1, "a": [2.5, None]}, f"{tmp_path}/j")
    assert files.read_json(spark, f"{tmp_path}/j") == {"b": 1, "a": [2.5, None]}
    for folder in ("one", "two"):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "config.json").write_text("{}")
    assert files.find(spark, str(tmp_path), "config.json", not_parent="one").endswith("two/config.json")
    assert files.find(spark, str(tmp_path), "config.json").endswith("one/config.json")
    with pytest.raises(FileNotFoundError):
        files.find(spark, str(tmp_path), "config.json", parent="three")
    assert files.schema(spark, f"{tmp_path}/once") == {"id": "string", "a": "string", "b": "string"}
    assert files.markdown(spark.createDataFrame([("a|b", 0.5, None)], "x string, y double, z int")) == "|x|y|z|\n|-|-|-|\n|a\\|b|0.5000||\n"
    scored = spark.createDataFrame([("S1-1", "S2-1", 0.9), ("S1-1", "S2-2", 0.4)], "s1 string, cand string, p double")
    s1s = spark.createDataFrame([("S1-1",), ("S1-2",)], "s1 string")
    lists.write_results(scored.where("p > 0.5"), scored, s1s, f"{tmp_path}/out", "p")
    assert rows(lists.read_tsv(spark, f"{tmp_path}/out/candidates", list(lists.CANDIDATES)), *lists.CANDIDATES) == [("S1-1", "S2-1,S2-2"), ("S1-2", "")]
    with pytest.raises(ValueError):
        lists.write_results(scored, scored.where("p > 0.5"), s1s, f"{tmp_path}/no", "p")
