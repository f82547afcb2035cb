"""Line de-duplication with levelled sorted runs of line hashes.

A store of runs holds, for each line key (128-bit hash), in how many documents it was found. Documents come in batches.
A batch's keys are merge-anti-joined with the runs: keys that some run already has as frequent need no more
counting and are left out; what remains is added as a new sorted run of level 0. When a level holds FANOUT runs
they are merged into one run of the next level, which adds up the counts. Runs are bucketed and sorted by the
hash with one number of buckets, so the anti-joins and merges of runs need no shuffle. At the end the runs are
merged once more, and keys with enough documents are the frequent ones: exactly, since a key is only ever left out
of a run after another run has it as frequent.

Lines are dropped in a second pass: each distinct text's keys are semi-joined with the frequent keys, what is left
is gathered by text, and texts are joined with the keys that they lose. Copies of a text meet its keys in SALTS tasks, and
adaptive execution splits those further where they are large. Runs and keys are removed when they are no longer read.
"""

from __future__ import annotations

import hashlib
import uuid
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchloom.llm.store import cut, drop, scratch, small_batches

#: Documents that must hold a line for it to go.
MIN_DOCS = 10
#: Batches that documents come in.
BATCHES = 3
#: Runs of a level that are merged into one of the next.
FANOUT = 2
#: Tasks that the copies of a text are dealt over.
SALTS = 8

STRIP = b" \t\n\x0b\x0c\r"
KEY = ["hi", "lo"]
TEXT_KEY = ["t1", "t2"]


def line_key(line: bytes) -> bytes:
    """The line stripped of ASCII white space, with A-Z lower-cased."""
    return line.strip(STRIP).lower()  # bytes.lower() changes A-Z only


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _hash(key: bytes) -> tuple[int, int]:
    h = xxhash.xxh3_128_intdigest(key)
    return _signed(h >> 64), _signed(h & ((1 << 64) - 1))


def _keys(min_chars: int, batches: int):
    """Rows (batch, t1, t2, hi, lo, copies): the distinct keys of each distinct text of an Arrow batch."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batch = TaskContext.get().partitionId() % batches
        for rb in it:
            t1, t2, text = (rb.column(i).to_pylist() for i in range(3))
            copies = Counter(zip(t1, t2, strict=True))
            out: list[list[int]] = [[], [], [], [], []]
            for a, b, body in zip(t1, t2, text, strict=True):
                n = copies.pop((a, b), 0)
                if not n or not body:
                    continue
                for key in {line_key(x) for x in body.encode().split(b"\n")}:
                    if len(key) >= min_chars and len(key.decode()) >= min_chars:
                        hi, lo = _hash(key)
                        for column, v in zip(out, (a, b, hi, lo, n), strict=True):
                            column.append(v)
            yield pa.RecordBatch.from_arrays([pa.array([batch] * len(out[0]), pa.int32()), *[pa.array(x, pa.int64()) for x in out]], ["batch", "t1", "t2", "hi", "lo", "copies"])

    return run


class Runs:
    """Levelled sorted runs of (hi, lo, n) in the shared folder."""

    def __init__(self, spark: SparkSession, buckets: int | None = None, min_docs: int = MIN_DOCS, fanout: int = FANOUT) -> None:
        self.spark, self.min_docs, self.fanout = spark, min_docs, fanout
        self.buckets = buckets or max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
        self.levels: list[list[str]] = []
        self.root = scratch(spark, "runs")

    def save(self, df: DataFrame) -> str:
        """A bucketed, sorted table of df at a path of its own."""
        name = f"run_{uuid.uuid4().hex}"
        df.write.format("parquet").option("path", f"{self.root}/{name}").bucketBy(self.buckets, *KEY).sortBy(*KEY).saveAsTable(name)
        return name

    def forget(self, name: str) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        drop(self.spark, f"{self.root}/{name}")

    def add(self, batch: DataFrame) -> None:
        """Merge-anti-join a batch of (hi, lo, n), one row a key and bucketed alike, with the runs and add what remains."""
        for level in self.levels:
            for name in level:
                frequent = self.spark.table(name).where(F.col("n") >= self.min_docs).select(*KEY)
                batch = batch.join(frequent.hint("merge"), KEY, "left_anti")
        self._push(0, self.save(batch))

    def _push(self, level: int, name: str) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(name)
        if len(self.levels[level]) >= self.fanout:
            names, self.levels[level] = self.levels[level], []
            merged = self.save(self.merge(names))
            for x in names:
                self.forget(x)
            self._push(level + 1, merged)

    def merge(self, names: list[str]) -> DataFrame:
        """Counts of several runs added up, by merge joins."""
        out = self.spark.table(names[0])
        for x in names[1:]:
            other = self.spark.table(x).withColumnRenamed("n", "m")
            out = out.join(other.hint("merge"), KEY, "full").select(*KEY, (F.coalesce("n", F.lit(0)) + F.coalesce("m", F.lit(0))).cast("long").alias("n"))
        return out

    def clear(self) -> None:
        """Remove all runs."""
        for level in self.levels:
            for name in level:
                self.forget(name)
        self.levels = []
        drop(self.spark, self.root)

    def frequent(self) -> DataFrame:
        """Keys in enough documents."""
        names = [x for level in self.levels for x in level]
        return self.merge(names).where(F.col("n") >= self.min_docs).select(*KEY)


def _cut(n_extra: int):
    """Drop the lines whose keys are in the last column; adds kept text, number of lines and of dropped lines."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in it:
            texts, keys = rb.column(n_extra).to_pylist(), rb.column(n_extra + 1).to_pylist()
            kept, lines, dropped = [], [], []
            for body, gone in zip(texts, keys, strict=True):
                parts = (body or "").split("\n")
                if gone:
                    lost = {(x["hi"], x["lo"]) for x in gone}
                    stay = [x for x in parts if _hash(line_key(x.encode())) not in lost]
                    kept.append("\n".join(stay))
                else:
                    stay = parts
                    kept.append(body)
                lines.append(len(parts))
                dropped.append(len(parts) - len(stay))
            columns = [rb.column(i) for i in range(n_extra)]
            names = [rb.schema.names[i] for i in range(n_extra)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(kept, pa.string()), pa.array(lines, pa.int64()), pa.array(dropped, pa.int64())], [*names, "kept", "n_lines", "n_dropped"])

    return run


def _without(docs: DataFrame, text_col: str, min_docs: int, min_chars: int, batches: int, buckets: int | None) -> DataFrame:
    """Columns x0, x1 ... (all of docs but the text, by place), kept, n_lines, n_dropped."""
    spark = docs.sparkSession
    small_batches(spark)
    at = docs.columns.index(text_col)
    renamed = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    others = [i for i in range(len(docs.columns)) if i != at]
    plain = renamed.select(*[F.col(f"c{i}").alias(f"x{k}") for k, i in enumerate(others)], F.col(f"c{at}").alias("body"))
    body, row = F.col("body"), F.monotonically_increasing_id()
    # Texts without a line that could go need not meet: they are dealt out by their place.
    blank = F.coalesce(F.trim(body) == "", F.lit(True))
    keyed = plain.withColumns({"t1": F.when(blank, F.xxhash64(F.lit(3), row)).otherwise(F.xxhash64(body)), "t2": F.xxhash64(F.lit(7), body), "salt": F.pmod(row, F.lit(SALTS)).cast("int")})
    pairs_at = scratch(spark, "line-keys")
    found = keyed.select("t1", "t2", "body").mapInArrow(_keys(min_chars, batches), "batch int, t1 long, t2 long, hi long, lo long, copies long")
    found.write.option("compression", "zstd").parquet(pairs_at)
    pairs = spark.read.schema(found.schema).parquet(pairs_at)

    runs = Runs(spark, buckets, min_docs)
    counts = pairs.groupBy("batch", *KEY).agg(F.sum("copies").alias("n"))
    # The checkpoint keeps the partitioning, which is that of the runs' buckets.
    counts = cut(counts.repartition(runs.buckets, *KEY).sortWithinPartitions(*KEY))
    for b in range(batches):
        runs.add(counts.where(F.col("batch") == b).select(*KEY, "n"))

    lost = pairs.select(*TEXT_KEY, *KEY).join(runs.frequent(), KEY, "left_semi")
    lost = cut(lost.groupBy(*TEXT_KEY).agg(F.collect_set(F.struct(*KEY)).alias("gone")))
    runs.clear()
    drop(spark, pairs_at)
    # Copies of a text are dealt over SALTS tasks; what it loses is sent to each.
    salted = lost.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    joined = keyed.join(salted, [*TEXT_KEY, "salt"], "left").select(*[f"x{k}" for k in range(len(others))], "body", "gone")
    kinds = ", ".join(f"x{k} {docs.schema.fields[i].dataType.simpleString()}" for k, i in enumerate(others))
    return joined.mapInArrow(_cut(len(others)), f"{kinds + ', ' if kinds else ''}kept string, n_lines long, n_dropped long")


def dedup_lines(docs: DataFrame, text_col: str = "text", min_docs: int = MIN_DOCS, min_chars: int = 1, batches: int = BATCHES, buckets: int | None = None) -> DataFrame:
    """The documents with `kept`, `n_lines` and `n_dropped` in place of the text column; other columns stay.

    A line's key is the line without ASCII white space at its ends and with A-Z lower-cased. Keys of at least min_chars
    code points found in at least min_docs documents lose all their lines in all documents; other lines stay as they
    are, joined by a line feed. Each row is a document: repeated rows count each, whatever their ids. A null
    text has one empty line, loses nothing and stays null; an empty text likewise stays empty. Blank lines have empty keys
    and stay (with min_chars of 1 or more). A text that loses all its lines becomes empty, and stays as a row. An empty
    table gives no rows. Columns may be null or have any names; where the table has a column of one of the three names
    already, that stays and the new one gets underscores at its end until it differs.
    """
    names = [c for c in docs.columns if c != text_col]
    for new in ("kept", "n_lines", "n_dropped"):
        while new in names:
            new += "_"
        names.append(new)
    return _without(docs, text_col, min_docs, min_chars, batches, buckets).toDF(*names)


def without_common_lines(docs: DataFrame, text_col: str = "text", chars_col: str | None = "n_chars") -> DataFrame:
    """The documents, columns and all, with the lines that dedup_lines() drops taken out of their texts. chars_col, where the table has it, follows the text."""
    columns = docs.columns
    out = _without(docs, text_col, MIN_DOCS, 1, BATCHES, None)
    places = [c for c in columns if c != text_col]

    def column(c: str):
        if c == text_col:
            return F.col("kept").alias(c)
        if c == chars_col:
            return F.char_length("kept").cast(docs.schema[c].dataType).alias(c)
        return F.col(f"x{places.index(c)}").alias(c)

    return out.select(*[column(c) for c in columns])


def sha256_hex(text: str | None) -> str:
    """Digest of a kept text; null counts as empty."""
    return hashlib.sha256((text or "").encode()).hexdigest()
