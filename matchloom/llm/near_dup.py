"""N-gram Jaccard join with PartEnum signatures, and its connected components.

A document's set holds the hashes of its word shingles. Two sets of a and b elements with a Jaccard similarity of J or more
differ in at most (1 - J) / (1 + J) * (a + b) elements. Sets are dealt into size bands up to R, 2R, 4R ...; a set
signs for its own band, and for the next one if a similar set may be that large. A band divides the domain of elements
by a hash, the same for all its sets, into partitions of SECOND parts each. For each partition all subsets of
SECOND - LOST parts are enumerated: a signature is one subset with the elements that the set has in it. Sets
that differ in at most LOST parts of a partition share one of its signatures.

 * Bands of up to FULL_BAND elements are exact. They have more partitions than differences / (LOST + 1), so similar sets
   always share a signature. A set signs its partitions in order until those could not all be spoilt by as many
   differences as it may have: a partition with elements in two parts or more takes two differences to lose all its
   nonempty signatures, one with elements in one part takes one. Of two similar sets the one that stops first has, among
   the partitions that both sign, one that is not spoilt. A set that runs out of partitions also signs empty subsets.
 * Larger bands sign the first m partitions, m growing with the set's size within its band so that a pair of
   exactly the least similarity shares no signature with a probability of MISS at most (1e-12; less for more similar ones).

Equal sets are one class with one signing member. Candidates are first held against each other by sketches (the VALUES
least 16-bit hashes of a set, which is all of them for most sets), which turn away a similar pair with a probability of
about TURN at most, and then verified on whole texts, by exact intersection and union. First each signature's sets are
compared with the least of them, which is linear in the number of signatures whatever the size of a group; verified links
are contracted to components. Then only signatures whose sets still lie in several components are looked at: all pairs of
different components, in groups of any size, once where several signatures have the same sets. A group is cut into tiles, and each pair of tiles is a task's work of
its own, so a passage that many documents share costs the square of its sets but never more memory than two tiles.
Comparing sketches multiplies blocks of bounded height and width in place; only promising pairs leave a task.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchloom.llm.store import cut, drop, scratch, small_batches, written_at
from matchloom.llm.words import U, as_bytes, mix64, shingles, slices, words

#: Words of a shingle; least similarity as a fraction.
WIDTH = 5
SIMILAR = (3, 4)
#: The smallest band, and the largest in which similar sets always share a signature.
BAND, FULL_BAND = 4, 256
#: Parts of a partition, and how many of them may differ where a signature is shared.
SECOND, LOST = 3, 1
#: Probability that a pair of the least similarity shares no signature of a larger band.
MISS = 1e-12
#: Values of a sketch, and the probability that sketches turn away a pair of the least similarity.
VALUES = 256
TURN = 1e-9
#: Rows of a tile of a group; rows and values of a block of sketches that are multiplied at a time.
TILE, BLOCK, COLUMNS = 2048, 512, 8192
#: Followers that are verified with one copy of a leader's text.
CHUNK = 256


def bands(sizes: np.ndarray) -> np.ndarray:
    """The upper bound of each size's band."""
    return BAND << np.maximum(0, np.ceil(np.log2(np.maximum(sizes, 1) / BAND))).astype(np.int64)


def partitions(band: np.ndarray) -> np.ndarray:
    """Partitions of the domain in a band."""
    p, q = SIMILAR
    most = 2 * band * (q - p) // (q + p)
    return np.where(band <= FULL_BAND, most // (LOST + 1) + 1, 2 * band // 9)


def enumerated(sizes: np.ndarray, band: np.ndarray) -> np.ndarray:
    """How many partitions a set signs at most in a band."""
    j, n = SIMILAR[0] / SIMILAR[1], partitions(band)

    def agree(union: np.ndarray) -> np.ndarray:
        """Probability that a partition has two parts without a difference, and not both empty."""
        x = union / (SECOND * n)
        none = np.exp(-x)
        same = np.exp(-(1 - j) * x)
        return same**3 - none**3 + 3 * (1 - same) * (same**2 - none**2)

    least = np.minimum(agree(sizes), agree(sizes / j))
    m = np.ceil(math.log(MISS) / np.log1p(-np.clip(least, 1e-9, 1 - 1e-9))).astype(np.int64)
    return np.where(band <= FULL_BAND, n, np.minimum(m, n))


def differences(sizes: np.ndarray, band: np.ndarray) -> np.ndarray:
    """Most elements in which a set and a similar one in the band differ."""
    p, q = SIMILAR
    return (q - p) * (sizes + np.minimum(sizes * q // p, band)) // (q + p)


def sets_of(column: pa.Array, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """(text, element) of the distinct shingles of each text, sorted."""
    text, g = shingles(words(as_bytes(column), lower=True), width)
    if not len(g):
        return text, g
    edges = np.concatenate([[0], np.flatnonzero(text[1:] != text[:-1]) + 1, [len(g)]]).tolist()
    for lo, hi in zip(edges[:-1], edges[1:], strict=True):
        g[lo:hi].sort()
    keep = np.ones(len(g), bool)
    keep[1:] = (g[1:] != g[:-1]) | (text[1:] != text[:-1])
    return text[keep], g[keep]


def keys_of(text: np.ndarray, g: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Size and 128-bit key of each text's set."""
    sizes = np.bincount(text, minlength=n)
    k = [np.zeros(n, U), np.zeros(n, U)]
    if len(g):
        full = np.flatnonzero(sizes)
        at = np.concatenate([[0], np.cumsum(sizes[full])[:-1]])
        with np.errstate(over="ignore"):
            for i, salt in enumerate((U(0x51ED27), U(0xA0761D6478BD642F))):
                k[i][full] = np.add.reduceat(mix64(g ^ salt), at)
    return sizes, k[0], k[1]


def signatures(text: np.ndarray, g: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, signature) of all sets, grouped by text."""
    own = bands(sizes)
    p, q = SIMILAR
    texts, sigs = [], []
    content = mix64(g ^ U(0x1B873593))
    for band, members in ((own, sizes > 0), (2 * own, sizes * q > own * p)):
        m = np.where(members, enumerated(sizes, band), 0)
        start = np.cumsum(m) - m  # the first partition of each text among those of all texts
        cells = (SECOND * partitions(band)).astype(U)
        cell = (mix64(g ^ mix64(band.astype(U))[text]) % cells[text]).astype(np.int64)
        some = cell < SECOND * m[text]
        parts = np.zeros(SECOND * int(m.sum()), U)
        np.add.at(parts, SECOND * start[text[some]] + cell[some], content[some])
        parts = parts.reshape(-1, SECOND)
        owner = np.repeat(np.arange(len(sizes)), m)
        number = np.arange(len(owner)) - start[owner]
        # Differences that a partition takes to lose all its nonempty signatures.
        spoil = np.minimum((parts != 0).sum(axis=1), LOST + 1)
        before = np.cumsum(spoil) - spoil
        before -= before[start[owner]]
        most = np.where(band <= FULL_BAND, differences(sizes, band), 1 << 40)
        short = (band <= FULL_BAND) & (np.bincount(owner, weights=spoil, minlength=len(sizes)) <= most)
        signed = np.flatnonzero(before <= most[owner])
        for k, (a, b) in enumerate(((0, 1), (0, 2), (1, 2))):
            x, y, t = parts[signed, a], parts[signed, b], owner[signed]
            use = (x != 0) | (y != 0) | short[t]
            x, y, t, i = x[use], y[use], t[use], number[signed][use]
            tag = mix64(band[t].astype(U) << U(32) | (SECOND * i + k).astype(U))
            with np.errstate(over="ignore"):
                texts.append(t)
                sigs.append(mix64((x + mix64(y ^ U(0xE3779))) ^ tag))
    t, s = np.concatenate(texts), np.concatenate(sigs)
    order = np.argsort(t, kind="stable")
    return t[order], s[order]


def sketches(text: np.ndarray, g: np.ndarray, n: int) -> list[bytes]:
    """The least VALUES distinct 16-bit hashes of each set, in order."""
    values = (mix64(g ^ U(0xC2B2AE35)) >> U(48)).astype("<u2")
    edges = np.searchsorted(text, np.arange(n + 1)).tolist()
    return [np.unique(values[a:b])[:VALUES].tobytes() for a, b in zip(edges[:-1], edges[1:], strict=True)]


def _least_share(seen: np.ndarray, sizes: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """The least share of common values, of those seen in a pair, to go on with. sizes: elements of both sets together.

    Where both sketches are whole sets, only hashes that fall together can lower the share: ten of them are allowed for.
    Else the values seen are a sample without replacement of the union; the allowance is Serfling's bound.
    """
    j = SIMILAR[0] / SIMILAR[1]
    seen = np.maximum(seen, 1)
    rest = np.clip(1 - (seen - 1) / np.maximum(sizes / (1 + j), 1), 0, 1)
    return j - 10 * (1 - j) / seen - np.where(whole, 0.0, np.sqrt(-math.log(TURN) * rest / (2 * seen)))


def _promising(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (a, b, elements of both, sketch of a, sketch of b): the pairs that may be similar."""
    for rb in it:
        if not rb.num_rows:
            continue
        seen, common, whole = (np.zeros(rb.num_rows, np.int64) for _ in range(3))
        for i, (x, y) in enumerate(zip(rb.column(3).to_pylist(), rb.column(4).to_pylist(), strict=True)):
            a, b = np.frombuffer(x, "<u2"), np.frombuffer(y, "<u2")
            top = min(int(v[-1]) if len(v) == VALUES else 1 << 16 for v in (a, b))
            whole[i] = top == 1 << 16
            a, b = a[: np.searchsorted(a, top, "right")], b[: np.searchsorted(b, top, "right")]
            common[i] = len(np.intersect1d(a, b, assume_unique=True))
            seen[i] = len(a) + len(b) - common[i]
        keep = common >= seen * _least_share(seen, rb.column(2).to_numpy(), whole > 0)
        yield rb.select([0, 1]).filter(pa.array(keep))


def promising_in_group(n: np.ndarray, comp: np.ndarray, sketch: list[bytes], side: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows of a group that belong to different components, have similar sizes and may be similar. side: only pairs of rows with different values; rows are in its order."""
    p, q = SIMILAR
    rows = [np.frombuffer(x, "<u2") for x in sketch]
    top = np.array([int(v[-1]) if len(v) == VALUES else 1 << 16 for v in rows])
    flat, owner = np.concatenate(rows), np.repeat(np.arange(len(rows)), [len(v) for v in rows])
    times = np.bincount(flat, minlength=1 << 16)
    column = np.cumsum(times > 1) - 1
    width = int(column[-1]) + 1
    some = times[flat] > 1
    at, owner = column[flat[some]], owner[some]
    edges = np.searchsorted(owner, np.arange(len(rows) + 1))

    def entries(lo: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows of a block, and its (column, row) entries in order of the columns."""
        i = np.arange(lo, min(lo + BLOCK, len(rows)))
        mine = slice(edges[lo], edges[i[-1] + 1])
        order = np.argsort(at[mine], kind="stable")
        return i, at[mine][order], owner[mine][order] - lo

    def dense(block: tuple[np.ndarray, np.ndarray, np.ndarray], lo: int) -> np.ndarray:
        i, c, r = block
        a, b = np.searchsorted(c, (lo, lo + COLUMNS))
        has = np.zeros((len(i), min(COLUMNS, width - lo)), np.float32)
        has[r[a:b], c[a:b] - lo] = 1
        return has

    for lo in range(0, len(rows), BLOCK):
        here = entries(lo)
        i = here[0]
        for over in range(lo, len(rows), BLOCK):
            there = here if over == lo else entries(over)
            j = there[0]
            hit = (j[None, :] > i[:, None]) & (comp[i][:, None] != comp[j][None, :])
            if side is not None:
                hit &= side[i][:, None] != side[j][None, :]
            hit &= np.minimum(n[i][:, None], n[j][None, :]) * q >= np.maximum(n[i][:, None], n[j][None, :]) * p
            if not hit.any():
                continue
            common = np.zeros((len(i), len(j)), np.float32)
            for c in range(0, width, COLUMNS):
                common += dense(here, c) @ dense(there, c).T
            mine = np.stack([np.searchsorted(rows[k], top[j], "right") for k in i])
            theirs = np.stack([np.searchsorted(rows[k], top[i], "right") for k in j], axis=1)
            seen = mine + theirs - common
            whole = np.minimum(top[i][:, None], top[j][None, :]) == 1 << 16
            hit &= common >= seen * _least_share(seen, n[i][:, None] + n[j][None, :], whole)
            a, b = np.nonzero(hit)
            if len(a):
                yield i[a], j[b]


def _sign(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rb in it:
        for lo, hi in slices(rb.column(1)):
            part = rb.slice(lo, hi - lo)
            n = hi - lo
            text, g = sets_of(part.column(1))
            sizes, k1, k2 = keys_of(text, g, n)
            t, s = signatures(text, g, sizes)
            ends = np.concatenate([[0], np.cumsum(np.bincount(t, minlength=n))]).astype(np.int32)
            signs = pa.ListArray.from_arrays(pa.array(ends), pa.array(s.view(np.int64)))
            sketch = pa.array(sketches(text, g, n), pa.binary())
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sizes.astype(np.int64)), pa.array(k1.view(np.int64)), pa.array(k2.view(np.int64)), signs, sketch], ["doc_id", "n", "k1", "k2", "signs", "sketch"])


def _groups(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (sig, cid): those of signatures with two rows or more, each with its least row. Holds one row between batches."""
    pending: tuple[int, int, int] | None = None  # a first row whose group may go on
    leader: tuple[int, int, int] | None = None  # of the group that the last batch ended in, already returned
    for rb in it:
        if not rb.num_rows:
            continue
        sig, cid, n = (rb.column(i).to_numpy() for i in range(3))
        held = pending or leader
        if held is not None:
            sig, cid, n = (np.concatenate([[h], x]) for h, x in zip(held, (sig, cid, n), strict=True))
        new = np.append(True, sig[1:] != sig[:-1])
        first = np.flatnonzero(new)[np.cumsum(new) - 1]
        more = ~new | np.append(~new[1:], False)
        if held is not None and pending is None:
            more[0] = False  # it was returned before
        out = np.flatnonzero(more)
        f = first[out]
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (sig[out], cid[out], n[out], cid[f], n[f])], ["sig", "cid", "n", "least", "least_n"])
        last = first[-1]
        row = (int(sig[last]), int(cid[last]), int(n[last]))
        alone = last == len(sig) - 1 and not (last == 0 and held is not None and pending is None)
        pending, leader = (row, None) if alone else (None, row)


def _similar_sizes(a: str, b: str):
    p, q = SIMILAR
    return (F.least(a, b) * q) >= (F.greatest(a, b) * p)


def _cross(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (sig, one, other, tile): the promising pairs of two tiles of a signature, or within one. A pair leaves only the least signature that its sets share (`sigs` has those of a set's rows, in order)."""
    held: pa.Table | None = None

    def first_shared(at: int, a: list[int], b: frozenset[int]) -> bool:
        return next(x for x in a if x in b) == at

    def starts_of(rows: pa.Table) -> np.ndarray:
        sig, one, other = (rows.column(x).to_numpy() for x in ("sig", "one", "other"))
        return np.flatnonzero(np.append(True, (sig[1:] != sig[:-1]) | (one[1:] != one[:-1]) | (other[1:] != other[:-1])))

    def pairs(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        sig, one, other, tile, cid, n, comp = (rows.column(x).to_numpy() for x in ("sig", "one", "other", "tile", "cid", "n", "comp"))
        sketch, own = rows.column("sketch").to_pylist(), rows.column("sigs")
        starts = starts_of(rows)
        out: tuple[list[int], list[int]] = ([], [])
        for lo, hi in zip(starts.tolist(), [*starts[1:].tolist(), len(sig)], strict=True):
            if hi - lo < 2:
                continue
            lists: dict[int, list[int]] = {}
            sets: dict[int, frozenset[int]] = {}
            side = tile[lo:hi] if one[lo] != other[lo] else None
            for i, j in promising_in_group(n[lo:hi], comp[lo:hi], sketch[lo:hi], side):
                for x, y in zip(i.tolist(), j.tolist(), strict=True):
                    for z in (x, y):
                        if z not in lists:
                            lists[z] = own[lo + z].as_py()
                            sets[z] = frozenset(lists[z])
                    if first_shared(int(sig[lo]), lists[x], sets[y]):
                        out[0].append(int(cid[lo + x]))
                        out[1].append(int(cid[lo + y]))
        if out[0]:
            a, b = np.minimum(*out), np.maximum(*out)
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    for rb in it:
        rows = pa.Table.from_batches([rb])
        if held is not None:
            rows = pa.concat_tables([held, rows])
        if not rows.num_rows:
            continue
        last = int(starts_of(rows)[-1])
        held = rows.slice(last)
        if last:
            yield from pairs(rows.slice(0, last))
    if held is not None and held.num_rows:
        yield from pairs(held)


def _tiled(rest: DataFrame) -> DataFrame:
    """Rows of signatures as often as they have tiles: with each tile of their signature, and with their own."""
    rows = rest.withColumn("tile", F.pmod(F.xxhash64("cid"), F.col("tiles")).cast("int"))
    rows = rows.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    return rows.select("sig", F.least("tile", "with").alias("one"), F.greatest("tile", "with").alias("other"), "tile", "cid", "n", "comp")


def _verify(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (a, chunk, b, body) with a leader's own row (b is null) before its followers: the pairs that are similar."""
    p, q = SIMILAR
    current, mine = None, np.zeros(0, U)
    for rb in it:
        for lo, hi in slices(rb.column(3)):
            part = rb.slice(lo, hi - lo)
            text, g = sets_of(part.column(3))
            ends = np.searchsorted(text, np.arange(hi - lo + 1))
            a, b = part.column(0).to_pylist(), part.column(2).to_pylist()
            out: tuple[list[int], list[int]] = ([], [])
            for i in range(hi - lo):
                own = g[ends[i] : ends[i + 1]]
                if b[i] is None:
                    current, mine = a[i], own
                    continue
                if current != a[i]:
                    raise ValueError("a leader's text is missing")
                if not len(mine) or not len(own):
                    continue
                at = np.searchsorted(mine, own)
                at[at == len(mine)] = 0
                same = int((mine[at] == own).sum())
                if q * same >= p * (len(mine) + len(own) - same):
                    out[0].append(a[i])
                    out[1].append(b[i])
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], ["a", "b"])


def _merge(df: DataFrame) -> DataFrame:
    """Sort-merge joins throughout: many small broadcasts would fill the driver."""
    return df.hint("merge")


def verified(pairs: DataFrame, bodies: DataFrame) -> DataFrame:
    """The pairs (a, b) whose texts' sets are similar. A leader with many followers is sent to several tasks."""
    chunks = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / CHUNK).alias("k"))
    dealt = cut(pairs.join(_merge(chunks), "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("k")).alias("chunk")))
    followers = dealt.join(_merge(bodies.withColumnRenamed("cid", "b")), "b").select("a", "chunk", "b", "body")
    leaders = dealt.select("a", "chunk").distinct().join(_merge(bodies.withColumnRenamed("cid", "a")), "a").select("a", "chunk", F.lit(None).cast("long").alias("b"), "body")
    parts = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = leaders.unionByName(followers).repartition(parts, "a", "chunk").sortWithinPartitions("a", "chunk", F.col("b").asc_nulls_first())
    return rows.mapInArrow(_verify, "a long, b long").distinct()


def _renamed(rows: DataFrame, column: str, step: DataFrame) -> DataFrame:
    """Rows with the column's nodes replaced by those that a step (u, up) names."""
    others = [c for c in rows.columns if c != column]
    found = rows.join(_merge(step.toDF("from", "to")), F.col(column) == F.col("from"), "left")
    return found.select(*others, F.coalesce("to", column).alias(column))


def components(edges: DataFrame) -> DataFrame:
    """(cid, comp): the least node that each node of the edges (a, b) reaches. Each round points every node at its least neighbour, goes up four times as far, and contracts the edges; all of it stays in tables."""
    steps: list[DataFrame] = []
    while True:
        both = edges.select("a", "b").union(edges.select("b", "a")).toDF("u", "v")
        step = cut(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("up")))
        twice = _renamed(step, "up", step).select("u", "up")
        steps.append(cut(_renamed(twice, "up", twice).select("u", "up")))
        edges = _renamed(_renamed(edges, "a", steps[-1]), "b", steps[-1]).where("a <> b")
        edges = cut(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
        if edges.isEmpty():
            break
    nodes = steps[0].toDF("cid", "comp")
    for step in steps[1:]:
        nodes = _renamed(nodes, "comp", step)
    return cut(nodes.select("cid", "comp"))


def _linked(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, n_shingles, k1, k2, component_id): link() with the keys of the sets. Tables go as soon as nothing reads them."""
    spark, root = docs.sparkSession, scratch(docs.sparkSession, "near-dup")
    small_batches(spark)
    written = lambda df, name: written_at(df, f"{root}/{name}")
    gone = lambda name: drop(spark, f"{root}/{name}")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    kind = docs.schema[id_col].dataType.simpleString()
    plain = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("body"))
    signed = written(plain.mapInArrow(_sign, f"doc_id {kind}, n long, k1 long, k2 long, signs array<long>, sketch binary"), "signs")
    keys = written(signed.select("doc_id", "n", "k1", "k2"), "keys")
    classes = signed.where("n > 0").groupBy("k1", "k2").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("signs").alias("signs"), F.first("sketch").alias("sketch"))
    classes = written(classes.withColumn("cid", F.monotonically_increasing_id()), "classes")
    gone("signs")
    known = written(classes.drop("signs"), "known")
    rows = classes.select(F.explode("signs").alias("sig"), "cid", "n").repartition(parts, "sig").sortWithinPartitions("sig", "cid")
    groups = written(rows.mapInArrow(_groups, "sig long, cid long, n long, least long, least_n long"), "groups")
    gone("classes")

    star = groups.where((F.col("cid") != F.col("least")) & _similar_sizes("n", "least_n"))
    star = star.select(F.col("least").alias("a"), F.col("cid").alias("b"), (F.col("n") + F.col("least_n")).alias("n")).distinct()
    sketch_of = known.select("cid", "sketch")
    star = star.join(_merge(sketch_of.toDF("a", "x")), "a").join(_merge(sketch_of.toDF("b", "y")), "b").select("a", "b", "n", "x", "y")
    star = cut(star.mapInArrow(_promising, "a long, b long"))
    # Texts of the sets that have any candidate: classes are found in the documents by their least id and their key.
    asked = groups.select("cid").distinct().join(_merge(known.select("cid", "rep", "k1", "k2")), "cid")
    found = plain.join(_merge(asked), plain["doc_id"].eqNullSafe(asked["rep"])).select("cid", "k1", "k2", "body")
    bodies = written(found.mapInArrow(_own, "cid long, body string"), "bodies")
    labels = components(cut(verified(star, bodies)))

    labelled = groups.join(_merge(labels), "cid", "left").select("sig", "cid", "n", F.coalesce("comp", "cid").alias("comp"))
    # Signatures of a common passage mostly have the same sets: of those that do, one is looked at.
    members = [F.sum(F.xxhash64(F.lit(i), "cid").cast("decimal(38,0)")).alias(f"h{i}") for i in range(2)]
    mixed = labelled.groupBy("sig").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count(F.lit(1)).alias("sets"), *members).where("lo <> hi")
    mixed = cut(mixed.groupBy("sets", "h0", "h1").agg(F.min("sig").alias("sig"), F.first("sets").alias("k")).select("sig", F.ceil(F.col("k") / TILE).cast("int").alias("tiles")))
    if not mixed.isEmpty():
        rest = cut(labelled.join(_merge(mixed), "sig").select("sig", "cid", "n", "comp", "tiles"))
        lists = rest.groupBy("cid").agg(F.sort_array(F.collect_list("sig")).alias("sigs"))  # as many as a set signs, at most
        tiled = _tiled(rest).join(_merge(sketch_of.join(_merge(lists), "cid")), "cid").select("sig", "one", "other", "tile", "cid", "n", "comp", "sketch", "sigs")
        tiled = tiled.repartition(parts, "sig", "one", "other").sortWithinPartitions("sig", "one", "other", "tile", "cid")
        more = tiled.mapInArrow(_cross, "a long, b long").distinct()
        more = cut(verified(cut(more.join(_merge(star), ["a", "b"], "left_anti")), bodies))
        if not more.isEmpty():
            # New links join components: they are contracted between the components' labels.
            between = _renamed(_renamed(more, "a", labels), "b", labels).where("a <> b").select("a", "b")
            further = components(cut(between)).toDF("u", "up")
            everyone = known.select("cid").join(_merge(labels), "cid", "left").select("cid", F.coalesce("comp", "cid").alias("comp"))
            labels = cut(_renamed(everyone, "comp", further).select("cid", "comp"))

    named = known.select("cid", "k1", "k2", "rep").join(_merge(labels), "cid", "left").withColumn("comp", F.coalesce("comp", "cid"))
    least = named.groupBy("comp").agg(F.min("rep").alias("component_id"))
    named = named.join(_merge(least), "comp").select("k1", "k2", "component_id")
    full = keys.where("n > 0").join(_merge(named), ["k1", "k2"]).select("doc_id", F.col("n").alias("n_shingles"), "k1", "k2", "component_id")
    empty = keys.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), "k1", "k2", F.col("doc_id").alias("component_id"))
    out = cut(full.unionByName(empty))
    drop(spark, root)
    return out


def link(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, component_id), one row a document.

    Words are runs of bytes outside ASCII white space, with A-Z lower-cased. A set has the distinct shingles of WIDTH words;
    with fewer words, the whole sequence as one; a null text, or one without words, has an empty set, is linked
    with nothing, and is a component of its own id. Documents with equal sets are linked. component_id is the
    least id of the component, in the order of the ids' type, which may be any that has one; null ids are least only where there is no other. Repeated rows get a row each, whatever their
    ids. Very long texts are compared whole. An empty table gives no rows.
    """
    return _linked(docs, id_col, text_col).select("doc_id", "n_shingles", "component_id")


def _keyed(at: int):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in it:
            for lo, hi in slices(rb.column(at)):
                part = rb.slice(lo, hi - lo)
                n, k1, k2 = keys_of(*sets_of(part.column(at)), hi - lo)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(n.astype(np.int64)), pa.array(k1.view(np.int64)), pa.array(k2.view(np.int64))], [*part.schema.names, "n", "k1", "k2"])

    return run


def representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each component, with all its columns: the one with the least id.

    Documents without words are linked with nothing and all stay. Of rows that repeat the least id within a component one stays.
    """
    chosen = _linked(docs, id_col, text_col).where(F.col("n_shingles") > 0).where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    # An id may be the least of several components, each with texts of its own, so keys decide with it.
    chosen = chosen.select("doc_id", "k1", "k2").distinct()
    columns = docs.columns
    plain = docs.toDF(*[f"x{i}" for i in range(len(columns))])
    schema = ", ".join(f"x{i} {f.dataType.simpleString()}" for i, f in enumerate(docs.schema.fields)) + ", n long, k1 long, k2 long"
    keyed = plain.mapInArrow(_keyed(columns.index(text_col)), schema)
    the_id = F.col(f"x{columns.index(id_col)}")
    full = keyed.where("n > 0").join(_merge(chosen), the_id.eqNullSafe(chosen["doc_id"]) & (keyed["k1"] == chosen["k1"]) & (keyed["k2"] == chosen["k2"]), "left_semi")
    kept = full.dropDuplicates([f"x{columns.index(id_col)}", "k1", "k2"]).unionByName(keyed.where("n = 0"))
    return kept.drop("n", "k1", "k2").toDF(*columns)


def _own(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (cid, k1, k2, body) whose text has the class's key: an id may belong to several texts."""
    for rb in it:
        for lo, hi in slices(rb.column(3)):
            part = rb.slice(lo, hi - lo)
            text, g = sets_of(part.column(3))
            _, k1, k2 = keys_of(text, g, hi - lo)
            same = (part.column(1).to_numpy() == k1.view(np.int64)) & (part.column(2).to_numpy() == k2.view(np.int64))
            part = part.filter(pa.array(same))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(3)], ["cid", "body"])
