"""Stupid-backoff scores of an n-gram model of the corpus, computed by joins of hash-partitioned count tables.

Documents are grouped into blocks of some megabytes. A block explodes its texts into n-grams and combines equal ones: for each of the
hash partitions of the count tables it has one row with the sorted hashes of its distinct n-grams and how often it has each.
Brought together by hash partition, these rows are the count table: equal hashes are added up over all blocks. The
counts go back in rows of the same shape, joined to the blocks by block number, where each document's n-grams
are summed up. So each n-gram crosses the network once for each block that has it, however frequent it is.

Within a partition a hash is sent as its upper 48 bits: sorted, as differences, byte by byte, compressed. Two different n-grams
of a partition of about a million fall together with a probability of 1e-9 for each n-gram.

The score of a word is its n-gram's count over its context's count if the n-gram's count is MIN_COUNT at least, else
DISCOUNT times the score with a context shorter by one word; a single word's is its count over the number of all words.
MIN_COUNT is 2 since the documents that are scored are those that are counted: an n-gram that only the document itself has, once, would
have count 1 after a context of count 1, and unlike any other text it would score best.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchloom.llm.store import cut, drop, scratch, small_batches
from matchloom.llm.words import U, Words, as_bytes, ngrams, words

#: Words of the longest n-gram.
ORDER = 3
DISCOUNT = 0.4
#: Least count of an n-gram of two words or more.
MIN_COUNT = 2
#: Bytes of text of a block; hash partitions a block of text; hash partitions a task.
BLOCK, SPREAD, PER_TASK = 4 << 20, 2, 8
#: Most buckets of Spark's tables, and most tasks of a shuffle here.
MOST = 100_000
LOW48 = U((1 << 48) - 1)


def _planes(values: np.ndarray, width: int) -> bytes:
    """The low `width` bytes of integers, all first bytes before all second ones, compressed."""
    return pa.compress(np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes(), codec="zstd", asbytes=True)


def _values(packed: bytes, n: int, width: int) -> np.ndarray:
    """What _planes() packed: n integers."""
    out = np.zeros((n, 8), np.uint8)
    out[:, :width] = np.frombuffer(pa.decompress(packed, decompressed_size=n * width, codec="zstd", asbytes=True), np.uint8).reshape(width, n).T
    return out.view("<u8").reshape(-1)


def _blocks(limit: int):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held = TaskContext.get().partitionId() << 32, 0
        for rb in it:
            texts = as_bytes(rb.column(1))
            sizes = np.diff(texts.offsets)
            numbers = np.empty(len(sizes), np.int64)
            for i, n in enumerate(sizes.tolist()):
                if held and held + n > limit:
                    block, held = block + 1, 0
                held += n
                numbers[i] = block
            total = np.bincount(words(texts).text, minlength=len(sizes)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(numbers), pa.array(total), *rb.columns], ["block", "words", "doc_id", "body"])

    return run


def _grams(w: Words, order: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For each length: distinct hashes in order, how often each, and for each n-gram its last word and its place among the distinct ones."""
    out = []
    for n in range(1, order + 1):
        first, _, g = ngrams(w, n)
        distinct, at, times = np.unique(g, return_inverse=True, return_counts=True)
        out.append((distinct, times, first + n - 1, at))
    return out


def _by_part(distinct: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of sorted hashes by partition, and where each partition begins in it."""
    part = (distinct % U(parts)).astype(np.int64)
    turn = np.argsort(part, kind="stable")
    return turn, np.searchsorted(part[turn], np.arange(parts + 1))


def _ask(order: int, parts: int):
    """A block's rows (part, block, sizes, hashes, times): its n-grams of each length in a partition, one length after the other."""

    def run(table: pa.Table) -> pa.Table:
        block = table.column("block")[0].as_py()
        found = [(d, t, *_by_part(d, parts)) for d, t, _, _ in _grams(words(as_bytes(table.column("body"))), order)]
        sizes = np.stack([np.diff(edges) for _, _, _, edges in found], axis=1).astype("<i4")
        some = np.flatnonzero(sizes.sum(axis=1))
        hashes, times = [], []
        for p in some.tolist():
            at = [turn[edges[p] : edges[p + 1]] for _, _, turn, edges in found]
            h = np.concatenate([d[i] >> U(16) for (d, *_), i in zip(found, at, strict=True)])
            hashes.append(_planes(np.diff(h, prepend=U(0)) & LOW48, 6))
            times.append(_planes(np.concatenate([t[i] for (_, t, *_), i in zip(found, at, strict=True)]), 8))
        return pa.table([pa.array(some, pa.int64()), pa.array(np.full(len(some), block), pa.int64()), pa.array([sizes[p].tobytes() for p in some.tolist()], pa.binary()), pa.array(hashes, pa.binary()), pa.array(times, pa.binary())], names=["part", "block", "sizes", "hashes", "times"])

    return run


def _added_up(rows: list[tuple[int, bytes, bytes, bytes]], min_count: int) -> list[bytes]:
    """The counts over all blocks of the n-grams of each (block, sizes, hashes, times) row of a partition: for each row as packed integers."""
    sizes = [np.frombuffer(r[1], "<i4") for r in rows]
    hashes = [np.cumsum(_values(r[2], int(z.sum()), 6), dtype=U) & LOW48 for r, z in zip(rows, sizes, strict=True)]
    times = [_values(r[3], int(z.sum()), 8).astype(np.int64) for r, z in zip(rows, sizes, strict=True)]
    counts = [np.zeros(len(h), np.int64) for h in hashes]
    ends = [np.concatenate([[0], np.cumsum(z)]) for z in sizes]
    for n in range(len(sizes[0])):
        mine = [slice(e[n], e[n + 1]) for e in ends]
        distinct, at = np.unique(np.concatenate([h[s] for h, s in zip(hashes, mine, strict=True)]), return_inverse=True)
        total = np.zeros(len(distinct), np.int64)
        np.add.at(total, at, np.concatenate([t[s] for t, s in zip(times, mine, strict=True)]))
        if n:
            total[total < min_count] = 0
        lo = 0
        for c, s in zip(counts, mine, strict=True):
            c[s] = total[at[lo : lo + s.stop - s.start]]
            lo += s.stop - s.start
    return [_planes(c, 8) for c in counts]


def _count(min_count: int):
    """Rows of _ask() sorted by partition, to (block, part, counts) rows. Holds one partition at a time."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, bytes, bytes, bytes]] = []
        current = None

        def answers() -> pa.RecordBatch:
            packed = _added_up(held, min_count)
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in held], pa.int64()), pa.array([current] * len(held), pa.int64()), pa.array(packed, pa.binary())], ["block", "part", "counts"])

        for rb in it:
            for part, *row in zip(*[c.to_pylist() for c in rb.columns], strict=True):
                if part != current:
                    if held:
                        yield answers()
                    current, held = part, []
                held.append(tuple(row))
        if held:
            yield answers()

    return run


def _score(order: int, parts: int, total: int, discount: float, kind: pa.DataType):
    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        texts = as_bytes(docs.column("body"))
        w = words(texts)
        n_docs, n_words = len(texts.offsets) - 1, len(w.hashes)
        grams = _grams(w, order)
        dealt = [_by_part(d, parts) for d, *_ in grams]
        counts = [np.zeros(len(d), np.int64) for d, *_ in grams]
        for p, packed in zip(answers.column("part").to_pylist(), answers.column("counts").to_pylist(), strict=True):
            at = [turn[edges[p] : edges[p + 1]] for turn, edges in dealt]
            given = _values(packed, sum(map(len, at)), 8).astype(np.int64)
            for c, i in zip(counts, at, strict=True):
                c[i], given = given[: len(i)], given[len(i) :]
        by_word = []  # count of the n-gram that ends at each word; 0 where there is none
        for c, (_, _, last, at) in zip(counts, grams, strict=True):
            here = np.zeros(n_words, np.int64)
            here[last] = c[at]
            by_word.append(here)
        per_doc = np.bincount(w.text, minlength=n_docs)
        place = np.arange(n_words) - np.repeat(np.cumsum(per_doc) - per_doc, per_doc)
        logs = np.zeros(n_words)
        todo = np.ones(n_words, bool)
        longest = np.minimum(place + 1, order)  # n-grams don't reach back over a text's first word
        for n in range(order, 0, -1):
            at = np.flatnonzero(todo & (longest >= n) & (by_word[n - 1] > 0))
            below = by_word[n - 2][at - 1] if n > 1 else np.full(len(at), total)
            logs[at] = np.log(by_word[n - 1][at]) - np.log(below) + (longest[at] - n) * np.log(discount)
            todo[at] = False
        sums = np.bincount(w.text, weights=logs, minlength=n_docs).astype(np.float64)  # integers where there are no words
        mean = np.divide(sums, per_doc, out=np.full(n_docs, np.nan), where=per_doc > 0)
        ids = docs.column("doc_id").combine_chunks()
        return pa.table([ids, pa.array(per_doc.astype(np.int64)), pa.array(sums), pa.array(mean, from_pandas=True)], names=["doc_id", "n_words", "log_score", "per_word"])

    return run


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER, discount: float = DISCOUNT, min_count: int = MIN_COUNT) -> DataFrame:
    """(id, n_words, log_score, per_word), one row a document.

    The model counts all n-grams of up to `order` words of all documents. log_score is the sum of the logarithms of its
    words' scores, per_word their mean. Words are runs of bytes outside ASCII white space. A null text, or one without
    words, has no words, log_score 0 and a null per_word. Repeated rows are counted and scored each, null ids are kept.
    A very long text is a block of its own. An empty table gives no rows.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    spark, kind = docs.sparkSession, docs.schema[id_col].dataType
    small_batches(spark)
    plain = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("body"))
    # Blocks are written once, so that asking and scoring see the same ones; bucketed, so that neither shuffles a text.
    # About a block a bucket, and PER_TASK partitions a task: tasks stay the same size however large the corpus is.
    path, name = scratch(spark, "blocks"), f"blocks_{uuid.uuid4().hex}"
    least = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    size = plain.agg(F.sum(F.octet_length("body"))).first()[0] or 0
    found = plain.mapInArrow(_blocks(BLOCK), f"block long, words long, doc_id {kind.simpleString()}, body string")
    found.write.format("parquet").option("path", path).option("compression", "zstd").bucketBy(min(MOST, max(least, size // BLOCK)), "block").saveAsTable(name)
    blocks = spark.read.table(name)
    row = blocks.agg(F.sum("words").alias("total"), F.count_distinct("block").alias("blocks")).first()
    total, parts = row["total"] or 0, max(1, (row["blocks"] or 0) * SPREAD)
    asked = blocks.select("block", "body").groupBy("block").applyInArrow(_ask(order, parts), "part long, block long, sizes binary, hashes binary, times binary")
    asked = asked.repartitionById(min(MOST, max(least, parts // PER_TASK)), F.pmod("part", F.lit(MOST)).cast("int")).sortWithinPartitions("part")
    answers = asked.mapInArrow(_count(min_count), "block long, part long, counts binary")
    schema = f"doc_id {kind.simpleString()}, n_words long, log_score double, per_word double"
    out = cut(blocks.select("block", "doc_id", "body").groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_score(order, parts, total, discount, to_arrow_type(kind)), schema))
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    drop(spark, path)
    return out
