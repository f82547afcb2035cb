"""Searches over whole documents against plain Python."""

import math
import random
import re
from collections import Counter, defaultdict

import pytest

from matchloom.plans import registry

COUNTRY = {"en": "US", "fr": "France", "de": "Germany", "es": "Spain"}
WORDS = [a + b for a in ("ka", "lo", "mi", "nu", "pe", "ri") for b in ("ban", "cor", "dil", "fes", "gum", "hax")]


@pytest.fixture(scope="module")
def docs(spark, tmp_path_factory):
    draw, rows = random.Random(3), []
    for i in range(120):
        words = draw.choices(WORDS, k=draw.choice((1, 3, 25)))  # 25 words: far more than 60 characters
        if i % 4 == 1:
            words = rows[-1][1].split("\n")[0].split() if rows[-1][1] else words
            words = words[:-1] + [draw.choice(WORDS)]  # differs in its last word only
        rows.append((i, draw.choice((" ", "  - ")).join(words) + draw.choice(("", "\nsecond line ban")), draw.choice(("en", "fr")), f"src{i % 2}"))
    rows += [(120, None, "en", "src0"), (121, "", "fr", None), (122, "kaban locor", None, "src0"), (123, "... \nkaban", "en", "src1"), (124, rows[0][1], rows[0][2], rows[0][3])]
    sf = tmp_path_factory.mktemp("whole")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(str(sf / "documents.parquet"))
    return str(sf), rows


def plain(rows):
    """{id: (country, bucket, words)}"""
    out = {}
    for i, text, lang, source in rows:
        name = re.sub("[^a-z0-9]+", " ", (text or "").split("\n")[0].lower()).strip()
        out[f"S{i % 3 + 1}-{i}"] = (COUNTRY.get(lang), source if i % 10 and source else None, name.split())
    return out


def cosines(records):
    n, tf, df = Counter(c for c, _, _ in records.values()), {}, Counter()
    for key, (country, _, words) in records.items():
        padded = [f" {w} " for w in words]
        tf[key] = Counter(p[i : i + k] for p in padded for k in (3, 4) for i in range(len(p) - k + 1))
        df.update((country, g) for g in tf[key])
    weights = {}
    for key, (country, _, _) in records.items():
        x = {g: (1 + math.log(t)) * (math.log((1 + n[country]) / (1 + df[country, g])) + 1) for g, t in tf[key].items() if country and 2 <= df[country, g] <= 0.2 * n[country]}
        norm = math.sqrt(sum(v * v for v in x.values()))
        weights[key] = {g: v / norm for g, v in x.items()}
    out = {}
    for a, (country, bucket, _) in records.items():
        for b, (other, place, _) in records.items():
            if a.startswith("S1-") and not b.startswith("S1-") and country and country == other and (bucket == place or bucket is None or place is None):
                if (s := sum(v * weights[b].get(g, 0) for g, v in weights[a].items())) >= 5e-7:
                    out[a, b] = round(s, 6)
    return out


def top(pairs, by, k):
    """{(s1, cand): rank}; ties by the other id."""
    groups = defaultdict(list)
    for pair, score in pairs.items():
        groups[pair[by]].append((-score, pair[1 - by], pair))
    return {pair: r for g in groups.values() for r, (_, _, pair) in enumerate(sorted(g)[:k], 1)}


def test_searches_by_whole_names_equal_brute_force(spark, docs):
    sf, rows = docs
    pairs = cosines(plain(rows))
    assert any(len(" ".join(r[2])) > 60 for r in plain(rows).values())
    for name, by, k in (("name_search_whole", 0, 5), ("reverse_search_whole", 1, 3)):
        got = {(r["s1"], r["cand"]): (r["rank"], r["score"]) for r in registry.queries()[name](spark, sf).collect()}
        want = top(pairs, by, k)
        assert {p: r for p, (r, _) in got.items()} == want, name
        assert all(abs(s - pairs[p]) < 2e-6 for p, (_, s) in got.items())


def test_rare_words_of_whole_names_equal_brute_force(spark, docs):
    sf, rows = docs
    records = plain(rows)
    df = Counter((c, w) for c, _, words in records.values() for w in set(words))
    rare = {k: {w for w in words if c and df[c, w] <= 20 and len(w) >= 3} for k, (c, _, words) in records.items()}
    pairs = {(a, b): n for a in rare for b in rare if a[:2] == "S1" != b[:2] and records[a][0] == records[b][0] and (n := len(rare[a] & rare[b]))}
    got = {(r["s1"], r["cand"]): r["rank"] for r in registry.queries()["rare_token_search_whole"](spark, sf).collect()}
    assert got == top(pairs, 0, 10)


def test_lists_of_whole_names_equal_brute_force(spark, docs):
    sf, rows = docs
    pairs = cosines(plain(rows))
    found = {p: pairs[p] for p in top(pairs, 0, 5) if pairs[p] >= 0.5}
    owned = {p: found[p] for p in top(found, 1, 1)}
    want = {k: "" for k in plain(rows) if k.startswith("S1-")}
    for s1 in want:
        own = sorted((-s, c) for (a, c), s in owned.items() if a == s1)
        want[s1] = ",".join(c for s, c in own if -s >= -own[0][0] - 0.3)
    assert {r["s1"]: r["ids"] for r in registry.queries()["match_lists_whole"](spark, sf).collect()} == want
