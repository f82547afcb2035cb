"""Corpus operators against brute force, on rows with nulls, empty and long texts, ties, repeats, clashing columns and none at all."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from matchloom.llm import langid, line_dedup, lm_score, media, mixing, near_dup, packing, quality, sharding, warc
from matchloom.llm.queries import tokenizer_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, body string, n long, bucket int"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def rows():
    rng = np.random.default_rng(3)
    words = [f"w{i}é" if i % 5 == 0 else f"Word{i}" for i in range(300)]
    base = [" ".join(rng.choice(words, 60)) for _ in range(12)]
    texts = [None, "", " \t\n", "one", "a b c", *base, *base[:4], base[0].upper().lower()]
    for b in base[:6]:  # near copies
        w = b.split()
        w[5] = "changed"
        texts += [" ".join(w), "Shared line\n" + b, " ".join(w[:20]) + "\nshared LINE \n" + " ".join(w[20:])]
    texts += ["shared line\n" + x for x in rng.choice(words, 8)] + [" ".join(rng.choice(words, 5000)), "same same " * 50, "日本語 текст"]
    out = [(i if i != 3 else None, t, None if i % 9 == 0 else "en", f"src{i % 4}" if i % 6 else None, 0, 1, "x", 2, 3) for i, t in enumerate(texts)]
    return [*out, out[7], out[7]]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_empty_tables(spark, empty):
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert mixing.mix(empty).count() == 0
    assert sharding.place(empty, sharding.topology(8)).count() == 0
    assert line_dedup.dedup_lines(empty).count() == 0
    assert near_dup.link(empty).count() == 0
    assert packing.pack(empty, tokenizer_path()).count() == 0
    assert quality.assess(empty, quality.fit(empty, labels)).count() == 0
    assert langid.predict(empty, langid.train(empty)).count() == 0
    assert media.stored_features(empty).count() == 0
    assert lm_score.score(empty).count() == 0
    assert warc.round_trip(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_mix(docs):
    got = mixing.mix(docs).collect()
    sizes = Counter((r[3], len(WORD.findall(r[1] or ""))) for r in rows())
    assert Counter((r["source"], r["size"]) for r in got) == sizes
    total = sum(s * k for (_, s), k in sizes.items())
    by = {}
    for r in got:
        assert 0 <= r["taken"] <= 3 * r["size"]
        by.setdefault(r["source"], [r["target"], 0])[1] += r["taken"]
    assert all(abs(t - n) <= 1 for t, n in by.values()) and abs(sum(t for t, _ in by.values()) - total) < 1e-6
    assert sorted(map(str, mixing.mix(docs).collect())) == sorted(map(str, got))


def test_schedule_inverse(spark):
    for knots in mixing.SHAPES:
        got = spark.range(0, 101).select((mixing.F.col("id") / 100).alias("s")).select("s", mixing.inverse(knots, mixing.F.col("s")).alias("t")).collect()
        assert all(abs(mixing.integral(knots, r["t"]) - r["s"]) < 1e-9 for r in got)


def test_sharding(docs):
    got = sharding.place(docs, sharding.topology(8), sharding.topology(9)).collect()
    assert sorted((r["size"], r["text_crc32"]) for r in got) == sorted((len((x[1] or "").encode()) + 1, zlib.crc32((x[1] or "").encode())) for x in rows())
    for s in {r["shard"] for r in got}:
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(sum(r["shard"] == s for r in got)))
    assert all(r["grown_shard"] in (r["shard"], 8) for r in got)


def test_line_dedup(docs):
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(LOWER)
    often = Counter(k for r in rows() for k in {key(x) for x in (r[1] or "").split("\n")} if k)
    want = Counter()
    for r in rows():
        lines = (r[1] or "").split("\n")
        stay = [x for x in lines if often[key(x)] < 10]
        want[r[0], len(lines), len(lines) - len(stay), "\n".join(stay)] += 1
    assert any(k[2] for k in want)
    got = line_dedup.dedup_lines(docs).collect()
    assert Counter((r["doc_id"], r["n_lines"], r["n_dropped"], r["kept"] or "") for r in got) == want
    assert set(docs.columns) - {"text"} <= set(got[0].asDict())


def test_line_dedup_with_clashing_names(docs):
    clash = docs.withColumnRenamed("body", "kept").withColumnRenamed("size", "n_lines").withColumnRenamed("bucket", "gone")
    out = line_dedup.dedup_lines(clash)
    assert out.columns == [c for c in clash.columns if c != "text"] + ["kept_", "n_lines_", "n_dropped"]
    assert Counter(r["n_lines_"] for r in out.collect()) == Counter(len((r[1] or "").split("\n")) for r in rows())
    whole = line_dedup.without_common_lines(clash)
    assert whole.columns == clash.columns
    assert Counter(r["n_chars"] for r in whole.collect()) == Counter(None if r["text"] is None else len(r["text"]) for r in whole.collect())


def near_brute(data):
    sets = []
    for r in data:
        w = WORD.findall((r[1] or "").translate(LOWER))
        sets.append(frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else []))
    comp = list(range(len(data)))

    def root(i):
        while comp[i] != i:
            i = comp[i]
        return i

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= 75 * len(a | b) and root(i) != root(j):
                comp[root(i)] = root(j)
    least = {}
    for i, r in enumerate(data):
        if r[0] is not None:
            least[root(i)] = min(r[0], least.get(root(i), r[0]))
    return Counter((r[0], len(s), least.get(root(i))) for i, (r, s) in enumerate(zip(data, sets, strict=True)))


def test_near_duplicates(docs):
    want = near_brute(rows())
    got = near_dup.link(docs).collect()
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == want
    kept = near_dup.representatives(docs).collect()
    full = {k[2] for k in want if k[1]}
    assert sorted(map(str, (r["doc_id"] for r in kept if WORD.search(r["text"] or "")))) == sorted(map(str, full))


def test_near_duplicates_by_a_common_passage_only(spark):
    """200 texts share a passage, and each is as similar as need be to the text that is the passage alone: all their common signatures are in groups of about 100 sets. Of 4000 such texts, one that has the fewest of them is taken."""
    rng = np.random.default_rng(1)
    passage = [f"s{i}" for i in range(199)]
    texts = [" ".join([*passage, *[f"x{k}" for k in rng.integers(0, 1 << 40, 65)]]) for _ in range(4000)]
    text, g = near_dup.sets_of(pa.array([*texts, " ".join(passage)]))
    t, s = near_dup.signatures(text, g, np.bincount(text))
    shared = np.bincount(t[np.isin(s, s[t == 4000])], minlength=4001)[:4000]
    data = [*texts[:199], texts[int(np.argmin(shared))], " ".join(passage)]
    got = near_dup.link(spark.createDataFrame(list(enumerate(data)), "doc_id long, text string")).collect()
    assert {r["component_id"] for r in got} == {0}


def test_similar_sets_share_a_signature():
    """Bands up to FULL_BAND are exact: pairs of the least similarity, of all sizes, whatever the elements."""
    rng = np.random.default_rng(0)
    for size in range(1, near_dup.FULL_BAND + 1):
        for other in {size, -(-3 * size // 4), size * 4 // 3, int(rng.integers(-(-3 * size // 4), size * 4 // 3 + 1))}:
            need = -(-3 * (size + other) // 7)
            if need > min(size, other):
                continue
            a = rng.integers(0, 1 << 63, size, dtype=np.uint64)
            b = np.concatenate([a[:need], rng.integers(0, 1 << 63, other - need, dtype=np.uint64)])
            text, sig = near_dup.signatures(np.repeat([0, 1], [size, other]), np.concatenate([a, b]), np.array([size, other]))
            assert set(sig[text == 0].tolist()) & set(sig[text == 1].tolist()), (size, other)


@pytest.mark.parametrize("tile", [16, 2048])
def test_near_duplicates_in_large_groups(spark, monkeypatch, tile):
    """150 texts of 100 to 300 shingles around one passage, near the least similarity to each other, in tiles of few rows and in one."""
    monkeypatch.setattr(near_dup, "TILE", tile)
    rng = np.random.default_rng(2)
    passage = [f"s{i}" for i in range(220)]
    data = [(i, " ".join([*passage[: int(rng.integers(90, 220))], *[f"x{i}-{k}" for k in range(int(rng.integers(0, 60)))]])) for i in range(150)]
    got = near_dup.link(spark.createDataFrame(data, "doc_id long, text string")).collect()
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == near_brute(data)


def test_near_duplicates_by_string_ids(spark):
    data = [("b", "one two three four five six"), ("a", "one two three four five six"), ("c", "other"), (None, "other")]
    got = near_dup.link(spark.createDataFrame(data, "doc_id string, text string")).collect()
    assert Counter((r["doc_id"], r["component_id"]) for r in got) == Counter([("b", "a"), ("a", "a"), ("c", "c"), (None, "c")])


def test_packing(spark, docs):
    """Every id of every document, by the tokenizers library as it is, special strings included; full sequences; cost-balanced placement."""
    from tokenizers import Tokenizer

    special = [(900, "a<|endoftext|>b"), (901, "<|endoftext|><|endoftext|> \n<|endoftext"), (902, "x" * 3000 + "<|endoftext|>" + " y" * 5000)]
    t = Tokenizer.from_file(tokenizer_path())
    data = [*[(r[0], r[1]) for r in rows()], *special]
    df = docs.select("doc_id", "text").unionByName(spark.createDataFrame(special, "doc_id long, text string"))
    got = packing.pack(df, tokenizer_path()).collect()
    ids = [(i, np.array([*t.encode(x or "", add_special_tokens=False).ids, 0], "<u4")) for i, x in data]
    crc = lambda x, a, n: zlib.crc32(x[a : a + n].tobytes())
    # Documents with equal ids and lengths are told apart by their crcs: each piece must fit one of them, and pieces must cover all.
    covered = Counter()
    for r in got:
        fits = [k for k, (i, x) in enumerate(ids) if i == r["doc_id"] and len(x) == r["doc_tokens"] and crc(x, r["start"], r["length"]) == r["ids_crc32"]]
        assert fits
        covered[str(r["doc_id"]), r["doc_tokens"]] += r["length"]
    want = Counter()
    for i, x in ids:
        want[str(i), len(x)] += len(x)
    assert covered == want
    by = {}
    for r in got:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for pieces in by.values():
        at = 0
        for offset, n in sorted(pieces):
            assert offset == at
            at += n
        assert at == 1024 or at & (at - 1) == 0


def test_placement_by_cost():
    """Plain Python: descending documents, each to the sequence of least cost with room; what fits nowhere is cut over those of least cost."""
    rng = np.random.default_rng(5)
    for _ in range(20):
        rests = rng.integers(0, 64, int(rng.integers(1, 60)))
        total, length = int(rests.sum()), 64
        room = [length] * (total // length) + [1 << k for k in reversed(range(7)) if total % length >> k & 1]
        cost, used, want, late = [0.0] * len(room), [0] * len(room), [], []

        def put(d, a, n, s):
            want.append((d, a, n, s, used[s]))
            used[s] += n
            cost[s] += packing.LINEAR * n + packing.QUADRATIC * n * n

        for d in sorted(range(len(rests)), key=lambda d: -rests[d]):
            n = int(rests[d])
            fit = [s for s in range(len(room)) if room[s] - used[s] >= n]
            if n and fit:
                put(d, 0, n, min(fit, key=lambda s: (cost[s], s)))
            elif n:
                late.append(d)
        for d in late:
            a, n = 0, int(rests[d])
            while n:
                s = min((s for s in range(len(room)) if used[s] < room[s]), key=lambda s: (cost[s], s))
                m = min(n, room[s] - used[s])
                put(d, a, m, s)
                a, n = a + m, n - m
        assert packing.place(rests, length) == want


def test_warc(spark):
    big = "x" * 999 + "é"
    data = [(1, "http://a/", big), (2, None, big), (3, "http://a b/", "small"), (4, "u", "small"), (None, "n", big), (5, "u", None), (2, "again", big)]
    got = warc.round_trip(spark.createDataFrame(data, "page_id long, url string, html string")).collect()
    want = Counter()
    for page, _, html in data:
        raw = (html or "").encode()
        revisit = html == big and page != 2
        want[page, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if revisit else "response", 2 if revisit else None] += 1
    assert Counter(map(tuple, got)) == want


def test_warc_files(spark, tmp_path):
    """Very long pages, extra and clashing columns, many copies; every record parsed from its archive by offset and length alone, payloads whole."""
    long_page = "<p>é" * 400_000
    data = [(i, f"http://h/{i % 3}", [long_page, "y" * 2000, "z"][i % 3], "f", 1, b"d") for i in range(60)]
    pages = spark.createDataFrame(data, "page_id long, url string, html string, file string, offset int, digest binary").repartition(5)
    root = str(tmp_path / "warc")
    index = warc.write(pages, f"file://{root}")
    rows_of = index.collect()
    assert len(rows_of) == 60 and {r["page_id"] for r in rows_of} == set(range(60))
    for r in rows_of:
        with open(f"{root}/archives/{r['file']}", "rb") as f:
            f.seek(r["offset"])
            one = warc.parse(warc.zlib.decompress(f.read(r["length"]), 31))
        body = data[r["page_id"]][2]
        assert one["page_id"] == r["page_id"] and one["payload_bytes"] == len(body.encode()) and one["payload_digest"] == hashlib.sha1(body.encode()).hexdigest() == r["digest"]
        keeper = max(i for i in range(60) if i % 3 == r["page_id"] % 3)
        if r["page_id"] % 3 == 2 or r["page_id"] == keeper:
            assert one["record_type"] == "response" and one["html"] == body
        else:
            assert (one["record_type"], one["refers_to"]) == ("revisit", keeper)
    few = warc.read(index.where("page_id < 7"), f"file://{root}").collect()
    assert {r["page_id"] for r in few} == set(range(7))
    assert warc.filesystem(f"file://{root}")[1] == root and warc.SCHEMES["s3a"] == "s3://"


def test_sharding_against_a_plain_tree(spark):
    """The tree in plain Python, with changed weights: rows move only into or out of subtrees whose weights change, and shares follow weights."""
    def unit(name, key):
        bits = int(hashlib.md5(f"{name}:{key}".encode()).hexdigest()[:12], 16)
        return -np.log((bits + 0.5) / (1 << 48))

    def plain(key, leaves):
        live = [x for x in leaves if x.weight > 0]
        for level in ("region", "rack", "shard"):
            weights = Counter()
            for x in live:
                weights[getattr(x, level)] += x.weight
            best = min(weights, key=lambda k: unit(f"{level}{k}", key) / weights[k]) if len(weights) > 1 else next(iter(weights))
            live = [x for x in live if getattr(x, level) == best]
        return live[0].shard

    even = sharding.topology(8)
    heavy = [x._replace(weight=4.0) if x.shard == 5 else x for x in even]  # region 1, rack 2
    none = [x._replace(weight=0.0) if x.shard == 2 else x for x in even]
    ids = [*range(4000), None]
    df = spark.createDataFrame([(i, "t") for i in ids], "doc_id long, text string")
    got = {}
    for name, leaves in (("even", even), ("heavy", heavy), ("none", none)):
        got[name] = {r["doc_id"]: r["shard"] for r in sharding.place(df, leaves).collect()}
        assert got[name] == {i: plain("" if i is None else str(i), leaves) for i in ids}
    for i in ids:
        a, b = got["even"][i], got["heavy"][i]
        # Rows leave a subtree only for one whose weight rose: region 1, in it rack 2, in it shard 5.
        assert a == b or (a // 4 == 0 and b // 4 == 1) or (a // 2 == 3 and b // 2 == 2) or (a == 4 and b == 5)
        assert got["none"][i] != 2 and (a == got["none"][i] or a // 4 == 0)
    share = Counter(got["heavy"].values())
    assert abs(share[5] / 4000 - 4 / 11) < 0.08


def test_media(docs):
    got = media.stored_features(docs).collect()
    want = Counter()
    for r in rows():
        raw = (r[1] or "").encode()
        body = raw + b"\0" * (max(64, -(-len(raw) // 64) * 64) - len(raw))
        want[r[0], len(raw), len(body), hashlib.sha256(body).hexdigest(), zlib.crc32(body[-64:])] += 1
    assert Counter(tuple(r)[:5] for r in got) == want
    one = media.encode(bytes(range(256)) * 3)
    slow, fast = media.read(one, fast=False), media.read(one)
    assert all((a == b).all() for a, b in zip(slow.coefficients, fast.coefficients, strict=True))


def test_quality(docs):
    got = Counter((r["doc_id"], r["n_words"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) for r in quality.assess(docs, quality.Rules(None, float("inf"))).collect())
    want = Counter()
    for r in rows():
        w = WORD.findall(r[1] or "")
        windows = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
        cover = {k for i in range(len(w) - 7) if windows[tuple(w[i : i + 8])] > 1 for k in range(i, i + 8)}
        seen, dups = set(), 0
        for x in (r[1] or "").split("\n"):
            if WORD.search(x):
                dups += x in seen
                seen.add(x)
        want[r[0], len(w), dups, len(cover), len(w) < 20 or 100 * len(cover) > 30 * len(w)] += 1
    assert got == want


def plain_rgb(image):
    """Independent decoding: each sample as the double sum of cosines, nearest chroma, colour conversion, pixel by pixel."""
    zigzag = []
    for d in range(15):
        cells = [(r, d - r) for r in range(8) if 0 <= d - r < 8]
        zigzag += cells if d % 2 else cells[::-1]
    c = lambda u: np.sqrt(0.5) if u == 0 else 1.0
    x = np.arange(8)
    planes = []
    for blocks in image.coefficients:
        rows, cols = blocks.shape[:2]
        plane = np.zeros((rows * 8, cols * 8))
        for r in range(rows):
            for k in range(cols):
                cell = np.zeros((8, 8))
                for (v, u), value in zip(zigzag, blocks[r, k], strict=True):
                    cell += value * c(u) * c(v) / 4 * np.cos((2 * x[:, None] + 1) * v * np.pi / 16) * np.cos((2 * x[None, :] + 1) * u * np.pi / 16)
                plane[8 * r : 8 * r + 8, 8 * k : 8 * k + 8] = np.clip(np.round(cell + 128), 0, 255)
        planes.append(plane)
    out = np.zeros((image.height, image.width, 3))
    for i in range(image.height):
        for j in range(image.width):
            y, cb, cr = planes[0][i, j], planes[1][i // 2, j // 2] - 128, planes[2][i // 2, j // 2] - 128
            out[i, j] = np.clip([y + 1.402 * cr, y - 0.344136 * cb - 0.714136 * cr, y + 1.772 * cb], 0, 255)
    return out


def test_media_tensors(spark):
    """Stored tensors of odd sizes, nulls, repeats and a long text against the independent decoder; the feature against the tensor."""
    rng = np.random.default_rng(8)
    texts = [None, "", "a", "é" * 40, "x" * 64, "".join(map(chr, rng.integers(32, 500, 900))), "a", "word " * 30_000]
    df = spark.createDataFrame([(i, t, b"x", 1) for i, t in enumerate(texts)], "doc_id long, text string, rgb binary, height int")
    got = {r["doc_id"]: r for r in media.stored_features(df).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        r, one = got[i], media.encode((t or "").encode())
        pixels = np.frombuffer(r["rgb"], np.uint8).reshape(r["height"], r["width"], 3)
        assert r["feature"] == f"{r['height']}x{r['width']}:" + ",".join(f"{v:.2f}" for v in pixels.reshape(-1, 3).mean(axis=0))
        assert r["media_sha256"] == hashlib.sha256(one).hexdigest() and r["media_bytes"] == len(one)
        if len(one) < 5000:
            assert np.abs(plain_rgb(media.read(one, fast=False)) - pixels).max() <= 1.01
    assert got[2]["rgb"] == got[6]["rgb"]


def plain_path(x, tree, forest):
    node = 0
    while forest.feature[tree][node] >= 0:
        node = forest.left[tree][node] + int(x[forest.feature[tree][node]] >= forest.value[tree][node])
    return float(forest.depth[tree][node])


def test_forest_and_threshold():
    """Path lengths, scores and the threshold against plain Python, row by row and cut by cut."""
    rng = np.random.default_rng(4)
    x = np.round(rng.normal(size=(300, 7)), 1).astype(np.float32)
    x[:10] += 6
    forest = quality.grow(x, trees=20, rows=64)
    got = quality.score(forest, x)
    c = 2 * (np.log(63) + 0.5772156649) - 2 * 63 / 64
    for i in range(0, 300, 7):
        mean = sum(plain_path(x[i], t, forest) for t in range(20)) / 20
        assert abs(got[i] - 2 ** (-mean / c)) < 1e-6
    # A tree's leaves hold its own rows: their depths are path lengths plus the mean path of those that share a leaf.
    for t in range(20):
        rows_of = [x[(t * 64 + k) % 300] for k in range(64)]
        leaves = Counter()
        for r in rows_of:
            node, depth = 0, 0
            while forest.feature[t][node] >= 0:
                node = forest.left[t][node] + int(r[forest.feature[t][node]] >= forest.value[t][node])
                depth += 1
            leaves[node, depth] += 1
        for (node, depth), n in leaves.items():
            extra = 0 if n == 1 else 1 if n == 2 else 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n
            assert depth <= 6 and abs(forest.depth[t][node] - depth - extra) < 1e-5
    assert np.median(got[:10]) > np.quantile(got[10:], 0.9)
    bad = np.zeros(300, bool)
    bad[:10] = True
    bad[50] = True
    cost = lambda cut: 4 * sum(s >= cut and not b for s, b in zip(got, bad, strict=True)) + sum(s < cut and b for s, b in zip(got, bad, strict=True))
    cut = quality.calibrate(got, bad)
    assert cost(cut) == min(cost(v) for v in [*got, np.inf])
    assert quality.calibrate(got, np.zeros(300, bool)) == float("inf")


def test_quality_verdicts(spark):
    """kept is what the forest and the threshold say of each text, on ties, nulls and repeats; reruns in another order fit the same rules."""
    rng = np.random.default_rng(6)
    good = [" ".join(rng.choice([f"word{i}" for i in range(200)], int(rng.integers(30, 80)))) for _ in range(300)]
    marks = ["#" * 4, "|", "A!!", "$$", "LOUD", "?!?!", "zzzzzzzzzzzzzzzzzzzz"]
    junk = [" ".join(marks[k] for k in rng.integers(0, int(rng.integers(2, 8)), int(rng.integers(30, 90)))) + f" {i}" for i in range(12)]
    data = [(i, t) for i, t in enumerate(good + junk)] + [(500, None), (501, ""), (None, good[0]), (0, good[0]), (0, good[0]), (300, junk[0])]
    labels = [(i, int(i < 300)) for i in range(0, 312, 2)] + [(0, 1), (0, 1), (None, 0), (302, None)]
    df = spark.createDataFrame(data, "doc_id long, text string")
    lab = spark.createDataFrame(labels, "doc_id long, quality int")
    rules = quality.fit(df.repartition(3), lab)
    again = quality.fit(df.orderBy("text").repartition(5), lab.orderBy("quality"))
    assert rules.threshold == again.threshold and all((a == b).all() for a, b in zip(rules.forest[:4], again.forest[:4], strict=True))
    got = quality.assess(df, rules).collect()
    assert len(got) == len(data)
    by_text = dict(zip([t for _, t in data], [None] * len(data), strict=True))
    for t in by_text:
        base, x = quality.statistics(pa.array([t], pa.string()))
        c = 2 * (np.log(rules.forest.rows - 1) + 0.5772156649) - 2 * (rules.forest.rows - 1) / rules.forest.rows
        mean = sum(plain_path(x[0], k, rules.forest) for k in range(quality.TREES)) / quality.TREES
        by_text[t] = 2 ** (-mean / c)
    texts = {i: t for i, t in data}
    for r in got:
        s = by_text[texts[r["doc_id"]]]
        assert abs(r["anomaly"] - s) < 1e-6
        assert r["kept"] == (not r["base_failed"] and r["anomaly"] < rules.threshold)
    kept = {r["doc_id"] for r in got if r["kept"]}
    assert len(kept & set(range(300))) > 285 and len(kept & set(range(300, 312))) < 4 and not kept & {500, 501}
    assert Counter(map(str, quality.keep(df, rules).collect())) == Counter(str(r) for r in df.collect() if any(g["doc_id"] == r["doc_id"] and g["kept"] for g in got))


class PlainPPM:
    """One language's context tree in plain Python."""

    def __init__(self, texts, order):
        self.order, self.tree = order, {}
        for t in texts:
            b = b" " * order + t.encode()
            for i in range(order, len(b)):
                for k in range(order + 1):
                    self.tree.setdefault(b[i - k : i], Counter())[b[i]] += 1

    def bits(self, text):
        b, total = b" " * self.order + text.encode(), 0.0
        for i in range(self.order, len(b)):
            for k in range(self.order, -1, -1):
                seen = self.tree.get(b[i - k : i])
                if not seen:
                    continue
                n = sum(seen.values()) + len(seen)
                if seen[b[i]]:
                    total -= np.log2(seen[b[i]] / n)
                    break
                total -= np.log2(len(seen) / n)
            else:
                total += 8
        return total


def test_code_lengths(spark, monkeypatch):
    """Exact code lengths of trained and unseen texts under each language's tree, over pieces of any length."""
    monkeypatch.setattr(langid, "LOOKUP", 37)
    train = {"de": ["der die das und nicht", "daß über\nStraße", "", "a"], "en": ["the and of with not", "thé the the", "zz"], "ja": ["日本語の文"]}
    data = [(i, t, lang) for i, (lang, t) in enumerate((lang, t) for lang, ts in train.items() for t in ts)]
    model = langid.train(spark.createDataFrame(data, "doc_id long, text string, lang string"))
    assert model.languages == sorted(train) and model.order == 4
    texts = [*[t for _, t, _ in data], "quite unseen 123 \x00 \u00ff words", "dér", "日本 the der", "x" * 300, " "]
    packed = langid.as_bytes(pa.array(texts))
    got = langid.code_lengths(model, *packed)
    for i, lang in enumerate(model.languages):
        plain = PlainPPM(train[lang], 4)
        for j, t in enumerate(texts):
            assert abs(got[j, i] - plain.bits(t)) < 1e-3, (lang, t)


def test_langid(spark):
    """Accuracy on documents that were not trained on, and rows of all kinds."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = langid.is_held_out(docs["doc_id"])
    model = langid.train(docs.where(~held))
    lang = docs.where(held & docs["lang"].isNotNull()).select("doc_id", "lang").collect()
    got = {r["doc_id"]: r["lang_pred"] for r in langid.predict(docs.where(held), model).collect()}
    known = [(r["lang"], got[r["doc_id"]]) for r in lang if got[r["doc_id"]] != "und"]
    assert len(known) > 100 and sum(a == b for a, b in known) / len(known) > 0.97
    odd = [(1, None), (2, ""), (3, "123 456 !?"), (None, "the and of"), (4, "the and of"), (4, "the and of"), (5, "the of and " * 200_000)]
    got = langid.predict(spark.createDataFrame([(*x, "z", 1) for x in odd], "doc_id long, text string, lang_pred string, score int"), model).collect()
    assert Counter(r["doc_id"] for r in got) == Counter(i for i, _ in odd)
    by = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in got}
    assert by[1] == by[2] == by[3] == ("und", 0.0) and by[4] == by[None] and by[5][1] == 1.0
    ties = spark.createDataFrame([(1, "aaa", "x"), (2, "aaa", "w"), (3, "aaa", "y")], "doc_id long, text string, lang string")
    assert {(r["lang_pred"], round(r["score"], 6)) for r in langid.predict(ties, langid.train(ties)).collect()} == {("w", round(1 / 3, 6))}


def plain_backoff(data, order, least):
    """Counts and scores of all n-grams in plain Python."""
    toks = [(i, WORD.findall(t or "")) for i, t in data]
    counts = [Counter(tuple(w[k : k + n]) for _, w in toks for k in range(len(w) - n + 1)) for n in range(1, order + 1)]
    total = sum(counts[0].values())
    out = []
    for i, w in toks:
        s = 0.0
        for k in range(len(w)):
            longest = min(k + 1, order)
            for n in range(longest, 0, -1):
                c = counts[n - 1][tuple(w[k - n + 1 : k + 1])]
                if c >= (least if n > 1 else 1):
                    s += np.log(c) - np.log(counts[n - 2][tuple(w[k - n + 1 : k])] if n > 1 else total) + (longest - n) * np.log(0.4)
                    break
        out.append((str(i), len(w), round(float(s), 6) + 0.0))
    return sorted(out)


@pytest.mark.parametrize(("order", "least", "block"), [(3, 2, 1 << 22), (3, 2, 300), (4, 1, 2000), (1, 1, 300)])
def test_lm_score(spark, docs, monkeypatch, order, least, block):
    monkeypatch.setattr(lm_score, "BLOCK", block)
    got = [(str(r["doc_id"]), r["n_words"], round(r["log_score"], 6) + 0.0) for r in lm_score.score(docs.withColumnRenamed("bucket", "block"), order=order, min_count=least).collect()]
    assert sorted(got) == plain_backoff([(r[0], r[1]) for r in rows()], order, least)
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("blocks_")]


def test_pipeline(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = corpus_pipeline.store.written(stage(spark, docs, sf), name)
        assert out.columns == docs.columns
        docs = out
    assert corpus_pipeline.STAGES[-1][1](spark, docs, sf).count() > 0


def test_pipeline_against_plain_stages(spark, docs, tmp_path):
    """Each stage on nulls, repeats, ties, long texts and clashing columns, against a plain version on what the stage before kept; then run() as a whole."""
    import corpus_pipeline

    sf = str(tmp_path)
    docs.write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([(5, 1), (6, 1), (None, 0)], "doc_id long, quality int").write.parquet(f"{sf}/labels.parquet")
    stages = dict(corpus_pipeline.STAGES)
    now = spark.read.parquet(f"{sf}/documents.parquet")

    def step(name):
        nonlocal now
        before = [tuple(r) for r in now.collect()]
        now = corpus_pipeline.store.written(stages[name](spark, now, sf), name)
        assert now.columns == docs.columns
        return before, [tuple(r) for r in now.collect()]

    before, after = step("quality_rules")  # no bad labels: the base rules alone

    def passes(text):
        w = WORD.findall(text or "")
        windows = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
        cover = {k for i in range(len(w) - 7) if windows[tuple(w[i : i + 8])] > 1 for k in range(i, i + 8)}
        return len(w) >= 20 and 100 * len(cover) <= 30 * len(w)

    assert Counter(map(str, after)) == Counter(str(r) for r in before if passes(r[1]))
    before, after = step("line_dedup")
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(LOWER)
    often = Counter(k for r in before for k in {key(x) for x in (r[1] or "").split("\n")} if k)
    text = lambda r: "\n".join(x for x in r[1].split("\n") if often[key(x)] < 10)
    assert Counter(map(str, after)) == Counter(str((r[0], t := text(r), r[2], r[3], len(t), *r[5:])) for r in before)
    before, after = step("near_duplicates")
    groups = Counter(k[2] for k in near_brute(before).elements() if k[1])
    assert sorted(str(r[0]) for r in after) == sorted(map(str, groups)) and {str(r) for r in after} <= {str(r) for r in before}
    before, after = step("source_mix")
    times = Counter(map(str, after))
    assert set(times) <= {str(r) for r in before} and max(times.values()) <= 3
    sizes, words = Counter(), Counter()
    for rows_of, to in ((before, sizes), (after, words)):
        for r in rows_of:
            to[r[3]] += len(WORD.findall(r[1]))
    targets = {r["source"]: r["target"] for r in mixing.mix(spark.createDataFrame(before, docs.schema)).collect()}
    longest = max(len(WORD.findall(r[1])) for r in before)
    assert all(abs(words[x] - targets[x]) <= longest for x in sizes)
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    packed = stages["packing"](spark, now, sf).collect()
    want = Counter(str(r[0]) for r in after for _ in range(len(t.encode(r[1], add_special_tokens=False).ids) + 1))
    got = Counter()
    for r in packed:
        got[str(r["doc_id"])] += r["length"]
    assert got == want
    whole = Counter((str(r["doc_id"]), r["start"] == 0, r["doc_tokens"]) for r in corpus_pipeline.run(spark, sf).collect() if r["start"] == 0)
    assert whole == Counter((str(r["doc_id"]), True, r["doc_tokens"]) for r in packed if r["start"] == 0)


def test_pipeline_on_an_empty_table(spark, empty, tmp_path):
    import corpus_pipeline

    empty.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
