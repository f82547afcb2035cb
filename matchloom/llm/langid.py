"""Language identification by prediction by partial matching (PPM).

Each language has a tree of byte contexts of variable order (0 to ORDER bytes) with the counts of the bytes that followed.
A byte's probability under a context is its count over the context's total and escapes (method C: as many escapes
as distinct followers); a byte that the context never saw costs an escape and is coded in the next shorter context,
without exclusions, and at last uniformly over all byte values. A context that a tree never saw costs nothing: coding
starts at the longest one that it has. The statistics are frozen after training, so each (context, byte) has one code
length, and a text's code length is the exact sum over its bytes. The language with the shortest code length wins.

For scoring, the trees of all languages are laid out as one hash table an order: from a run of context and byte that some tree has
to its code lengths under all of them, escapes included, and from a context to its escapes. Runs that no tree has take the
context's escapes and go on in the next shorter order. Texts are looked up over whole Arrow batches.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import regex
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchloom.llm.store import cut, small_batches
from matchloom.llm.words import as_bytes, slices

#: Longest context in bytes: up to 7 (a run of context and byte is one 64-bit integer).
ORDER = 4
#: Labelled documents that a language's tree is built on, at most (about: they are drawn by hash).
TRAIN_DOCS = 1500
#: Languages of a model at most; their sizes are broadcast, so texts stay where they are.
MAX_LANGUAGES = 10_000
#: Bytes that the flat trees may have in all when they are sent to the executors.
MAX_MODEL = 1 << 30
#: Bytes of text whose code lengths are looked up at a time; the working arrays take some 100 times as much with four languages.
LOOKUP = 1 << 18
UNKNOWN = "und"
LETTER = regex.compile(r"\p{L}")


class Table:
    """An open hash table from 64-bit keys to rows of values, looked up for whole arrays."""

    EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)  # no run of up to 8 bytes of UTF-8 has this value

    def __init__(self, keys: np.ndarray, values: np.ndarray) -> None:
        self.values = values
        self.shift = np.uint64(64 - max(4, int(2 * len(keys)).bit_length()))
        size = 1 << (64 - int(self.shift))
        self.mask = np.int64(size - 1)
        self.keys, self.row = np.full(size, self.EMPTY), np.zeros(size, np.int32)
        todo, slot = np.arange(len(keys)), self._slot(keys)
        while len(todo):
            free = self.keys[slot] == self.EMPTY
            self.row[slot[free]] = todo[free]  # of several keys for a slot the last one stays
            won = free & (self.row[slot] == todo)
            self.keys[slot[won]] = keys[todo[won]]
            todo, slot = todo[~won], (slot[~won] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((keys ^ keys >> np.uint64(29)) * np.uint64(0x9E3779B97F4A7C15) >> self.shift).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Row of each key, -1 where it has none."""
        out = np.full(len(keys), -1, np.int32)
        slot, todo = self._slot(keys), None
        while True:
            there = self.keys[slot]
            hit = there == (keys if todo is None else keys[todo])
            if todo is None:
                out[hit] = self.row[slot[hit]]
                todo = np.flatnonzero(~hit & (there != self.EMPTY))
                slot = slot[todo]
            else:
                out[todo[hit]] = self.row[slot[hit]]
                more = ~hit & (there != self.EMPTY)
                todo, slot = todo[more], slot[more]
            if not len(todo):
                return out
            slot = (slot + 1) & self.mask

    def nbytes(self) -> int:
        return self.keys.nbytes + self.row.nbytes + self.values.nbytes


class Model(NamedTuple):
    """languages; for each order 0 to `order` the code lengths of its runs in bits, and the escapes of its contexts, by language."""

    languages: list[str]
    runs: list[Table]
    contexts: list[Table]
    order: int


def _grams(texts, order: int) -> Iterator[np.ndarray]:
    """Runs of order + 1 bytes of each text, each text preceded by `order` spaces, as integers."""
    data, offsets = texts
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        if a == b:
            continue
        x = np.concatenate([np.full(order, 32, np.uint8), data[a:b]]).astype(np.uint64)
        g = np.zeros(b - a, np.uint64)
        for j in range(order + 1):
            g = g << np.uint64(8) | x[j : j + b - a]
        yield g


def _count(order: int):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in it:
            langs = np.array(rb.column(0).to_pylist(), dtype=object)
            for lang in dict.fromkeys(langs.tolist()):
                some = rb.column(1).take(pa.array(np.flatnonzero(langs == lang)))
                for lo, hi in slices(some):
                    found = list(_grams(as_bytes(some.slice(lo, hi - lo)), order))
                    if found:
                        g, n = np.unique(np.concatenate(found), return_counts=True)
                        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(g), pa.string()), pa.array(g.astype(np.int64)), pa.array(n.astype(np.int64))], ["lang", "gram", "n"])

    return run


def _shorter(g: np.ndarray, n: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Counts of the last `size` bytes of runs."""
    keys, at = np.unique(g & np.uint64((1 << 8 * size) - 1), return_inverse=True)
    return keys, np.bincount(at, weights=n, minlength=len(keys))


def build(counts: dict[str, tuple[np.ndarray, np.ndarray]], order: int = ORDER) -> Model:
    """A model from each language's (distinct runs of order + 1 bytes, counts)."""
    languages = sorted(counts)
    runs, contexts = [], []
    below: tuple[np.ndarray, np.ndarray] | None = None  # runs of the next shorter order, in order, and their code lengths
    for k in range(order + 1):
        mine = [_shorter(counts[x][0].astype(np.uint64), counts[x][1], k + 1) for x in languages]
        keys = np.unique(np.concatenate([x[0] for x in mine]))
        if below is None:
            cost = np.full((len(keys), len(languages)), 8.0)  # order -1: all byte values alike
        else:
            cost = below[1][np.searchsorted(below[0], keys & np.uint64((1 << 8 * k) - 1))].copy()
        above, at = np.unique(keys >> np.uint64(8), return_inverse=True)
        escapes = np.zeros((len(above), len(languages)))
        for i, (g, n) in enumerate(mine):
            ctx = np.searchsorted(above, g >> np.uint64(8))
            total = np.bincount(ctx, weights=n, minlength=len(above))
            kinds = np.bincount(ctx, minlength=len(above))
            with np.errstate(divide="ignore", invalid="ignore"):
                escapes[:, i] = np.where(total > 0, -np.log2(kinds / (total + kinds)), 0.0)
                hit = -np.log2(n / (total + kinds)[ctx])
            cost[:, i] += escapes[at, i]
            cost[np.searchsorted(keys, g), i] = hit
        runs.append(Table(keys, cost.astype(np.float32)))
        contexts.append(Table(above, escapes.astype(np.float32)))
        below = keys, cost
    return Model(languages, runs, contexts, order)


def lookup(model: Model, g: np.ndarray) -> np.ndarray:
    """Code lengths in bits of the last byte of each run of order + 1 bytes after the others, by language."""
    bits = np.zeros((len(g), len(model.languages)), np.float32)
    todo = None
    for k in range(model.order, -1, -1):
        x = (g if todo is None else g[todo]) & np.uint64((1 << 8 * (k + 1)) - 1)
        row = model.runs[k].find(x)
        hit = row >= 0
        if todo is None:
            bits[hit] = model.runs[k].values[row[hit]]
            todo = np.flatnonzero(~hit)
        else:
            bits[todo[hit]] += model.runs[k].values[row[hit]]
            todo = todo[~hit]
        if not len(todo):
            return bits
        row = model.contexts[k].find(x[~hit] >> np.uint64(8))
        known = row >= 0
        bits[todo[known]] += model.contexts[k].values[row[known]]
    bits[todo] += 8.0
    return bits


def code_lengths(model: Model, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Bits of each text under each language. Spaces stand before a text's first byte."""
    n, order = len(offsets) - 1, model.order
    out = np.zeros((n, len(model.languages)))
    heads = offsets[:-1][offsets[:-1] < offsets[1:]]
    for lo in range(0, len(data), LOOKUP):
        hi = min(lo + LOOKUP, len(data))
        near = heads[np.searchsorted(heads, lo - order) : np.searchsorted(heads, hi)]
        g = np.zeros(hi - lo, np.uint64)
        for j in range(order, -1, -1):  # the byte j places back
            x = np.full(hi - lo, 32, np.uint8)
            if hi > j:
                skip = max(j - lo, 0)
                x[skip:] = data[lo + skip - j : hi - j]
            for k in range(j):
                p = near + k - lo
                x[p[(p >= 0) & (p < hi - lo)]] = 32
            g = g << np.uint64(8) | x
        bits = lookup(model, g)
        firsts = np.searchsorted(offsets, lo, side="right") - 1
        lasts = np.searchsorted(offsets, hi, side="left")
        edges = np.clip(offsets[firsts:lasts], lo, hi) - lo
        full = np.append(edges[1:], hi - lo) > edges
        out[np.arange(firsts, lasts)[full]] += np.add.reduceat(bits, edges[full], axis=0, dtype=np.float64)
    return out


def _predict(sent: Broadcast | None):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value if sent else None
        for rb in it:
            lang, sure = [], []
            column = rb.column(1)
            for lo, hi in slices(column):
                part = column.slice(lo, hi - lo)
                if model is None:
                    lang += [UNKNOWN] * (hi - lo)
                    sure += [0.0] * (hi - lo)
                    continue
                bits = code_lengths(model, *as_bytes(part))
                best = bits.argmin(axis=1)
                with np.errstate(under="ignore"):
                    odds = np.exp2(np.maximum(bits.min(axis=1, keepdims=True) - bits, -1000)).sum(axis=1)
                for text, b, o in zip(part.to_pylist(), best.tolist(), odds.tolist(), strict=True):
                    known = text is not None and LETTER.search(text) is not None
                    lang.append(model.languages[b] if known else UNKNOWN)
                    sure.append(1.0 / o if known else 0.0)
            yield pa.RecordBatch.from_arrays([rb.column(0), pa.array(lang, pa.string()), pa.array(sure, pa.float64())], ["doc_id", "lang_pred", "score"])

    return run


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", key_col: str = "doc_id", order: int = ORDER, train_docs: int = TRAIN_DOCS) -> Model | None:
    """A model of the languages of the labelled documents; None without any.

    Of each language about train_docs documents are drawn, by a hash of their ids, and read whole. The driver gets
    one count for each language and run of order + 1 bytes in them. The order is what the caller says, however many these are.
    """
    labelled = docs.where(F.col(lang_col).isNotNull()).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("body"), F.col(key_col).alias("key"))
    sizes = cut(labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n")))  # one row a language
    if (n := sizes.count()) > MAX_LANGUAGES:
        raise ValueError(f"{n} languages: a tree for each of more than {MAX_LANGUAGES} does not fit a model")
    share = F.least(F.lit(1.0), F.lit(float(train_docs)) / F.col("n"))
    drawn = labelled.join(F.broadcast(sizes), "lang").where(F.pmod(F.xxhash64("key"), F.lit(1 << 40)) < F.lit(1 << 40) * share).select("lang", "body")
    found = drawn.mapInArrow(_count(order), "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toArrow()
    langs = found.column("lang").to_numpy(zero_copy_only=False)
    counts = {}
    for lang in sorted(set(langs.tolist())):
        some = langs == lang
        counts[lang] = found.column("gram").to_numpy()[some], found.column("n").to_numpy()[some].astype(np.float64)
    return build(counts, order) if counts else None


def predict(docs: DataFrame, model: Model | None, key_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score), one row a document.

    score: the posterior of the language, from code lengths and equal priors. A null text, or one without a letter, is
    `und` with score 0, as is every text without a model. Ties go to the first language by name. Repeated rows are
    predicted alike, null ids are kept, an empty table gives no rows.
    """
    small_batches(docs.sparkSession)
    sent = None
    if model is not None:
        if (size := sum(t.nbytes() for t in [*model.runs, *model.contexts])) > MAX_MODEL:
            raise ValueError(f"the trees take {size} bytes: train on fewer documents or with a lower order")
        sent = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema[key_col].dataType.simpleString()
    rows = docs.select(F.col(f"`{key_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("body"))
    return rows.mapInArrow(_predict(sent), f"doc_id {kind}, lang_pred string, score double")


def is_held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id as text leaves 1 modulo 3; a null id counts as empty text."""
    return F.crc32(F.encode(F.coalesce(doc_id.cast("string"), F.lit("")), "UTF-8")) % 3 == 1
