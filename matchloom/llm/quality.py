"""Quality rules with an isolation forest on rule statistics.

The rule statistics of a document are shares and means of its text. A forest of random splits is grown on the statistics
of documents that pass the base rules: each tree on rows of its own, about TREES * ROWS in all, drawn by a hash from the whole
corpus. A document's mean path length in the forest gives its anomaly score. The score from which on a document
is rejected is calibrated on all labelled documents. One scan fetches the trees' rows, a second one the scores of all
documents, which are counted by score, and a third one judges all documents in place. Repeated rows count once in both.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from matchloom.llm.store import cut, small_batches
from matchloom.llm.words import SPACE, as_bytes, mix64, ngrams, per_text, slices, words

#: Trees, and rows that each is grown on.
TREES, ROWS = 200, 256
#: Bands of scores, whose sums are put in order at once; those of a band are put in order for themselves.
BANDS = 1 << 16
#: Rejecting a good labelled row costs as much as keeping so many bad ones.
KEEP_WEIGHT = 4.0
#: Base rules: least words, and the largest share of words in repeated windows.
MIN_WORDS, MAX_REPEAT = 20, 0.30
WINDOW = 8

SYMBOL = np.zeros(256, np.uint8)
SYMBOL[[ord(c) for c in "#*$%&|<>"]] = 1
IN_WORD = np.zeros(256, np.uint8)  # first bytes of characters that aren't white space
IN_WORD[[b for b in range(256) if not SPACE[b] and b & 0xC0 != 0x80]] = 1
UPPER, LETTER, SHOUT, BAR = (np.zeros(256, np.uint8) for _ in range(4))
UPPER[65:91] = 1
LETTER[65:91] = LETTER[97:123] = 1
LETTER[0xC0:] = 1
SHOUT[[ord(c) for c in "!?"]] = 1
BAR[[ord("|")]] = 1

BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
FEATURES = ["symbols", "repeats", "upper", "shouts", "bars", "word_length", "stutter"]


def statistics(column: pa.Array) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """Base counts of each text of a string column, and its rule statistics as a float32 matrix."""
    texts = as_bytes(column)
    data, offsets = texts
    w = words(texts)
    n = len(offsets) - 1
    n_words = np.bincount(w.text, minlength=n).astype(np.int64)
    first, text, g = ngrams(w, WINDOW)
    n_repeat = np.zeros(n, np.int64)
    if len(g):
        _, at, times = np.unique(mix64(g ^ mix64(text.astype(np.uint64))), return_inverse=True, return_counts=True)
        again = first[times[at] > 1]
        if len(again):
            cover = np.zeros(len(w.text) + WINDOW + 1, np.int32)
            np.add.at(cover, again, 1)
            np.add.at(cover, again + WINDOW, -1)
            n_repeat = np.bincount(w.text[np.cumsum(cover)[: len(w.text)] > 0], minlength=n).astype(np.int64)
    same = (w.hashes[1:] == w.hashes[:-1]) & (w.text[1:] == w.text[:-1])
    stutter = np.bincount(w.text[1:][same], minlength=n)
    n_dup = np.zeros(n, np.int64)
    for i in np.flatnonzero(n_words).tolist():
        lines = [x for x in data[offsets[i] : offsets[i + 1]].tobytes().split(b"\n") if x.strip(b" \t\n\x0b\x0c\r")]
        n_dup[i] = len(lines) - len(set(lines)) if len(lines) > 1 else 0
    count = lambda table: per_text(table[data], offsets)
    chars, symbols = count(IN_WORD), count(SYMBOL)
    base = dict(zip(BASE, (n_words, chars, symbols, n_dup, n_repeat), strict=True))
    per = lambda a, b: (a / np.maximum(b, 1)).astype(np.float32)
    features = [per(symbols, n_words), per(n_repeat, n_words), per(count(UPPER), count(LETTER)), per(count(SHOUT), n_words), per(count(BAR), n_words), per(chars, n_words), per(stutter, n_words)]
    return base, np.stack(features, axis=1)


class Forest(NamedTuple):
    """Trees as flat arrays, one row a tree: feature (-1: leaf), split value, left child, depth to go on from a leaf."""

    feature: np.ndarray
    value: np.ndarray
    left: np.ndarray
    depth: np.ndarray
    rows: int


def _average_path(n: float) -> float:
    """Mean path length of an unsuccessful search among n rows."""
    if n <= 1:
        return 0.0
    return 2.0 * (np.log(n - 1) + 0.5772156649) - 2.0 * (n - 1) / n if n > 2 else 1.0


def grow(sample: np.ndarray, trees: int = TREES, rows: int = ROWS, seed: int = 7) -> Forest:
    """An isolation forest: random features and split values until rows are alone or the depth is log2(rows). Trees take turns at the rows, which are in random order; each starts over where they run out."""
    rng = np.random.default_rng(seed)
    rows = min(rows, len(sample))
    limit = int(np.ceil(np.log2(max(rows, 2))))
    size = 2 ** (limit + 1) - 1
    feature, value = np.full((trees, size), -1, np.int16), np.zeros((trees, size), np.float32)
    left, depth = np.zeros((trees, size), np.int32), np.zeros((trees, size), np.float32)
    for t in range(trees):
        stack, free = [(0, (t * rows + np.arange(rows)) % len(sample), 0)], 1
        while stack:
            node, at, d = stack.pop()
            x = sample[at]
            lo, hi = x.min(axis=0), x.max(axis=0)
            can = np.flatnonzero(hi > lo)
            if d >= limit or len(at) <= 1 or not len(can):
                depth[t, node] = d + _average_path(len(at))
                continue
            f = int(rng.choice(can))
            v = np.float32(rng.uniform(lo[f], hi[f]))
            below = x[:, f] < v
            if not below.any() or below.all():
                v = np.float32(hi[f])
                below = x[:, f] < v
            feature[t, node], value[t, node], left[t, node] = f, v, free
            stack += [(free, at[below], d + 1), (free + 1, at[~below], d + 1)]
            free += 2
    return Forest(feature, value, left, depth, rows)


def score(forest: Forest, x: np.ndarray) -> np.ndarray:
    """Anomaly scores in (0, 1): 2 to the power of minus the mean path length over that of a random row."""
    total = np.zeros(len(x))
    at = np.arange(len(x))
    for feature, value, left, depth in zip(*forest[:4], strict=True):
        node = np.zeros(len(x), np.int32)
        while True:
            f = feature[node]
            inner = f >= 0
            if not inner.any():
                break
            right = x[at, np.maximum(f, 0)] >= value[node]
            node = np.where(inner, left[node] + right, node)
        total += depth[node]
    return 2.0 ** (-(total / len(forest.feature)) / max(_average_path(forest.rows), 1e-9))


def calibrate(scores: np.ndarray, bad: np.ndarray, keep_weight: float = KEEP_WEIGHT) -> float:
    """The score from which on rows are rejected: least cost over the labelled rows, a rejected good row counting keep_weight. No bad rows: nothing is rejected."""
    if not bad.any():
        return float("inf")
    order = np.argsort(-scores, kind="stable")
    s, b = scores[order], bad[order]
    gain = np.cumsum(np.where(b, 1.0, -keep_weight))
    last = np.append(s[1:] != s[:-1], True)  # equal scores go together
    k = int(np.argmax(np.where(last, gain, -np.inf)))
    if gain[k] <= 0:
        return float("inf")
    return float((s[k] + s[k + 1]) / 2 if k + 1 < len(s) else s[k])


def threshold(labelled: DataFrame, keep_weight: float = KEEP_WEIGHT) -> float:
    """calibrate() of any number of rows (anomaly, bad): gains are summed by score, bands of scores put in order at once and the scores of a band for themselves."""
    gain = F.sum(F.when(F.col("bad"), 1.0).otherwise(-keep_weight)).alias("gain")
    by_score = cut(labelled.groupBy("anomaly").agg(gain, F.max("bad").alias("bad")).withColumn("band", F.floor(F.col("anomaly") * BANDS)))
    if by_score.where("bad").isEmpty():
        return float("inf")
    bands = by_score.groupBy("band").agg(F.sum("gain").alias("in_band"))  # BANDS + 1 rows at most
    above = bands.select("band", (F.sum("in_band").over(Window.orderBy(F.desc("band"))) - F.col("in_band")).alias("above"))
    total = F.col("above") + F.sum("gain").over(Window.partitionBy("band").orderBy(F.desc("anomaly")))
    best = by_score.join(above, "band").select(total.alias("gain"), "anomaly").agg(F.max(F.struct("gain", "anomaly")).alias("b")).first()["b"]
    if best["gain"] <= 0:
        return float("inf")
    below = by_score.where(F.col("anomaly") < best["anomaly"]).agg(F.max("anomaly")).first()[0]
    return float(best["anomaly"] if below is None else (best["anomaly"] + below) / 2)


def _passes(base: dict[str, np.ndarray]) -> np.ndarray:
    """Whether each text passes the base rules."""
    return (base["n_words"] >= MIN_WORDS) & (100 * base["n_repeat_words"] <= round(100 * MAX_REPEAT) * base["n_words"])


class Rules(NamedTuple):
    """A forest and the anomaly score from which on documents are rejected. Without a forest the base rules decide alone."""

    forest: Forest | None
    threshold: float

    def judge(self, column: pa.Array) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
        """(base counts, base_failed, anomaly, kept) of each text."""
        base, x = statistics(column)
        failed = ~_passes(base)
        anomaly = score(self.forest, x) if self.forest else np.zeros(len(x))
        return base, failed, anomaly, ~failed & (anomaly < self.threshold)


def _sampled(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (body, order) to statistics of those that pass the base rules."""
    for rb in it:
        for lo, hi in slices(rb.column(0)):
            part = rb.slice(lo, hi - lo)
            base, x = statistics(part.column(0))
            out = pa.RecordBatch.from_arrays([part.column(1), *[pa.array(x[:, i]) for i in range(len(FEATURES))]], ["o", *FEATURES])
            yield out.filter(pa.array(_passes(base)))


def _scored(forest: Forest):
    """Rows (body, key, order) to (key, order, anomaly) of those that pass the base rules."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in it:
            for lo, hi in slices(rb.column(0)):
                part = rb.slice(lo, hi - lo)
                base, x = statistics(part.column(0))
                passed = _passes(base)
                kept = part.filter(pa.array(passed))
                yield pa.RecordBatch.from_arrays([kept.column(1), kept.column(2), pa.array(score(forest, x[passed]))], ["key", "o", "anomaly"])

    return run


def _share(n: int, limit: int) -> int:
    """Of 2 to the power of 40 hash values, those that draw about `limit` of n rows."""
    return int((1 << 40) * min(1.0, limit / max(n, 1)))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Rules:
    """Grow the forest and calibrate the threshold. labels has (id, quality), quality 0 for bad rows; null ids and qualities are ignored, and a document with several labels counts once for each that differs. The same tables give the same rules, in whatever order their rows come."""
    small_batches(docs.sparkSession)
    wide = 1 << 40
    known = labels.select(F.col(id_col).alias("key"), F.col("quality").cast("int").alias("quality")).where("quality is not null and key is not null").distinct()
    order = F.xxhash64(F.col(f"`{id_col}`"), F.col(f"`{text_col}`"))
    rows = docs.select(F.col(f"`{text_col}`").alias("body"), F.col(f"`{id_col}`").alias("key"), order.alias("o"))
    sampled = rows.where(F.pmod(F.col("o"), F.lit(wide)) < _share(docs.count(), TREES * ROWS)).select("body", "o")
    schema = "o long, " + ", ".join(f"{c} float" for c in FEATURES)
    got = sampled.mapInArrow(_sampled, schema).dropDuplicates(["o"]).toPandas().sort_values(["o", *FEATURES], kind="stable")
    some = got[FEATURES].to_numpy(np.float32)
    if len(some) < 2:
        return Rules(None, float("inf"))
    forest = grow(some)
    # Texts stay where they are: scores of all documents meet the labels.
    kind = docs.schema[id_col].dataType.simpleString()
    scored = rows.where("key is not null").mapInArrow(_scored(forest), f"key {kind}, o long, anomaly double")
    return Rules(forest, threshold(scored.join(known, "key").dropDuplicates(["o", "quality"]).select("anomaly", (F.col("quality") == 0).alias("bad"))))


def _assess(rules: Rules):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in it:
            for lo, hi in slices(rb.column(1)):
                part = rb.slice(lo, hi - lo)
                base, failed, anomaly, kept = rules.judge(part.column(1))
                yield pa.RecordBatch.from_arrays([part.column(0), *[pa.array(base[c]) for c in BASE], pa.array(failed), pa.array(anomaly), pa.array(kept)], ["doc_id", *BASE, "base_failed", "anomaly", "kept"])

    return run


def assess(docs: DataFrame, rules: Rules, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: id, the base counts, base_failed, anomaly (0 to 1) and kept.

    A document is kept if it passes the base rules and its anomaly score is below the threshold. A null or empty text has
    no words and fails the base rules. Without bad labels the base rules decide alone. Whole texts are judged, by
    themselves: repeated rows alike, null ids like any other. An empty table gives no rows.
    """
    small_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("body"))
    return rows.mapInArrow(_assess(rules), f"doc_id {kind}, " + ", ".join(f"{c} long" for c in BASE) + ", base_failed boolean, anomaly double, kept boolean")


def _keep(rules: Rules, at: int):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in it:
            for lo, hi in slices(rb.column(at)):
                part = rb.slice(lo, hi - lo)
                yield part.filter(pa.array(rules.judge(part.column(at))[3]))

    return run


def keep(docs: DataFrame, rules: Rules, text_col: str = "text") -> DataFrame:
    """The rows that assess() keeps, as they are, with all their columns."""
    small_batches(docs.sparkSession)
    plain = docs.toDF(*[f"x{i}" for i in range(len(docs.columns))])
    return plain.mapInArrow(_keep(rules, docs.columns.index(text_col)), plain.schema).toDF(*docs.columns)
