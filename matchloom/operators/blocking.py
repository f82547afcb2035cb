"""Candidate search: TF-IDF top-k within (country, state) buckets in both directions, and an index of rare tokens.

search() deals tiles of texts to tasks: each holds an inverted index of one tile, goes through the texts of another, and only
the k best of a text leave it, so that disk holds texts, not pairs. Texts that are equal are looked up once. scores() is the
plain form over postings (id, bucket keys, gram, weight), an equi-join and a sum; it makes a row of every pair that shares a
gram and serves ids that stand in several buckets. Grams in more than MAX_DF of the texts are dropped in both.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from matchloom.functions.text import char_grams, tokens
from matchloom.session import written

#: n-gram range, least document frequency, largest share of documents.
GRAMS, MIN_DF, MAX_DF = (3, 4), 2, 0.02
#: A key stands for a state if it has so many records and so large a share in it.
STATE_TOTAL, STATE_SHARE = 20, 0.9
RARE_DF, RARE_LEN = 20, 3
NONE = "~none"


def state_maps(records: DataFrame, key: str, total: int = STATE_TOTAL, share: float = STATE_SHARE) -> DataFrame:
    """(country, key, map_state, total): the majority state of each city or departement, and its records with a state; ties go to the first state by name."""
    counts = records.where(F.col(key).isNotNull() & F.col("state").isNotNull()).groupBy("country", key, "state").agg(F.count(F.lit(1)).alias("n"))
    best = counts.groupBy("country", key).agg(F.sum("n").alias("total"), F.min(F.struct((-F.col("n")).alias("n"), "state")).alias("best"))
    return best.where((F.col("total") >= total) & (-F.col("best.n") >= share * F.col("total"))).select("country", key, F.col("best.state").alias("map_state"), "total")


def fill_states(records: DataFrame, total: int = STATE_TOTAL, share: float = STATE_SHARE) -> DataFrame:
    """Missing states from the city, then from the departement; state_src says from where."""
    city, dept = state_maps(records, "city", total, share).drop("total").withColumnRenamed("map_state", "_c"), state_maps(records, "dept", total, share).drop("total").withColumnRenamed("map_state", "_d")
    out = records.join(city, ["country", "city"], "left").join(dept, ["country", "dept"], "left")
    src = F.when(F.col("state").isNotNull(), "own").when(F.col("_c").isNotNull(), "city").when(F.col("_d").isNotNull(), "dept").otherwise("none")
    return out.withColumn("state_src", src).withColumn("state", F.coalesce("state", "_c", "_d")).drop("_c", "_d")


def postings(texts: DataFrame, grams: tuple[int, int] = GRAMS, min_df: int = MIN_DF, max_df: float = MAX_DF) -> DataFrame:
    """(id, country, bucket, gram, w) of (id, country, bucket, text): sublinear counts times smoothed idf, of length 1 a text. Frequencies are those of the country."""
    tf = texts.select("id", "country", "bucket", F.explode(char_grams(F.col("text"), *grams)).alias("gram")).groupBy("id", "country", "bucket", "gram").agg(F.count(F.lit(1)).alias("tf"))
    total = texts.groupBy("country").agg(F.count(F.lit(1)).alias("n"))
    df = tf.groupBy("country", "gram").agg(F.count(F.lit(1)).alias("df")).join(total, "country").where((F.col("df") >= min_df) & (F.col("df") <= max_df * F.col("n")))
    raw = tf.join(df, ["country", "gram"]).withColumn("x", (1 + F.log("tf")) * (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1))
    norm = F.sqrt(F.sum(F.col("x") * F.col("x")).over(Window.partitionBy("id")))  # as many rows as a text has grams
    return raw.select("id", "country", "bucket", "gram", (F.col("x") / norm).alias("w"))


def index(texts: DataFrame, grams: tuple[int, int] = GRAMS, min_df: int = MIN_DF, max_df: float = MAX_DF) -> DataFrame:
    """Postings written once: a search reads them six times, and several searches may share them."""
    return written(postings(texts, grams, min_df, max_df), "postings")


def scores(queries: DataFrame, pool: DataFrame) -> DataFrame:
    """(s1, cand, score) of postings: cosine of pairs in the same bucket, or of which one has none. Three equi-joins instead of one with OR."""
    q = queries.select(F.col("id").alias("s1"), "country", F.col("bucket").alias("qb"), "gram", F.col("w").alias("wq"))
    p = pool.select(F.col("id").alias("cand"), "country", F.col("bucket").alias("pb"), "gram", F.col("w").alias("wp"))
    own = q.join(p, (q["country"] == p["country"]) & (q["gram"] == p["gram"]) & (q["qb"] == p["pb"]))
    open_pool = q.where(F.col("qb") != NONE).join(p.where(F.col("pb") == NONE), ["country", "gram"])
    open_query = q.where(F.col("qb") == NONE).join(p.where(F.col("pb") != NONE), ["country", "gram"])
    pairs = [x.select("s1", "cand", (F.col("wq") * F.col("wp")).alias("x")) for x in (own, open_pool, open_query)]
    return pairs[0].unionByName(pairs[1]).unionByName(pairs[2]).groupBy("s1", "cand").agg(F.round(F.sum("x"), 6).alias("score")).where("score > 0")


def ranked(pairs: DataFrame, by: str, k: int, other: str, score: Column | None = None) -> DataFrame:
    """The k best of each `by`, ranked from 1; ties by the other id."""
    order = Window.partitionBy(by).orderBy(F.desc("score"), other)
    return pairs.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= k)


def forward(queries: DataFrame, pool: DataFrame, k: int) -> DataFrame:
    """(s1, cand, score, rank) of postings: the k best candidates of each query, by way of all pairs. search_forward() makes none."""
    return ranked(scores(queries, pool), "s1", k, "cand")


def reverse(queries: DataFrame, pool: DataFrame, m: int, keep: DataFrame | None = None) -> DataFrame:
    """(s1, cand, score, rank, best): the m best queries of each candidate; best is its top score over all queries. `keep` (s1) filters after the competition."""
    out = scores(queries, pool).withColumn("best", F.max("score").over(Window.partitionBy("cand")))
    out = ranked(out, "cand", m, "s1")
    return out.join(keep, "s1", "left_semi") if keep is not None else out


#: Texts of a tile of the asking side and of the other one, and characters that stand for a text's share of it: a task holds both tiles and the index of one.
ASK_TILE, OTHER_TILE, TILE_TEXT = 8192, 16384, 64
#: Products, and cells of the table of scores, that are held at a time.
PRODUCTS, CELLS = 1 << 20, 1 << 20
_BLANK = re.compile(r"[ \t\n\x0b\f\r]+")


def grams_of(text: str, low: int, high: int) -> list[str]:
    """What char_grams() makes of a text."""
    out = []
    for word in _BLANK.split(text):
        if word:
            padded = f" {word} "
            out += [padded] if len(padded) < low else []
            for n in range(low, high + 1):
                out += [padded[i : i + n] for i in range(len(padded) - n + 1)]
    return out


def _frequencies(low: int, high: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in it:
            found: dict[tuple[str, str], int] = {}
            for country, text, n in zip(rows["country"], rows["text"], rows["n"], strict=True):
                for gram in set(grams_of(text, low, high)):
                    found[country, gram] = found.get((country, gram), 0) + n
            yield pd.DataFrame([(c, g, n) for (c, g), n in found.items()], columns=["country", "gram", "df"])

    return run


def _vectors(texts: pd.Series, idf: dict[str, int], weight: np.ndarray, grams: tuple[int, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ends, gram, w): the weighted grams of each text, one after the other."""
    ends, gram, tf = [0], [], []
    for text in texts:
        mine: dict[int, int] = {}
        for g in grams_of(text, *grams):
            if (i := idf.get(g)) is not None:
                mine[i] = mine.get(i, 0) + 1
        gram += mine.keys()
        tf += mine.values()
        ends.append(len(gram))
    at = np.array(gram, np.int64)
    x = (1 + np.log(np.array(tf, np.float64))) * weight[at]
    size = np.diff(ends)
    row = np.repeat(np.arange(len(size)), size)
    return np.array(ends, np.int64), at, x / np.sqrt(np.bincount(row, x * x, len(size)))[row]


def _spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """All places of runs that start and are as long as given."""
    return np.arange(sizes.sum()) + np.repeat(starts - (np.cumsum(sizes) - sizes), sizes)


def _search_tile(k: int, grams: tuple[int, int]) -> Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]:
    def best(texts: pd.DataFrame, idf: pd.DataFrame) -> pd.DataFrame:
        there = texts["other"].to_numpy(bool)
        ask, other = texts[~there], texts[there]
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        if not (ask.empty or other.empty or idf.empty):
            number = {g: i for i, g in enumerate(idf["gram"])}
            weight, v = idf["idf"].to_numpy(np.float64), len(idf)
            a_ends, a_gram, a_w = _vectors(ask["text"], number, weight, grams)
            o_ends, o_gram, o_w = _vectors(other["text"], number, weight, grams)
            names = np.array([x[0] for x in ask["ids"]], object)
            held = [x for ids in other["ids"] for x in ids]
            n_ids = np.array([len(x) for x in other["ids"]], np.int64)
            first_id, place = np.cumsum(n_ids) - n_ids, np.empty(len(held), np.int64)
            place[sorted(range(len(held)), key=held.__getitem__)] = np.arange(len(held))
            flat = np.array(held, object)
            a_bucket, o_bucket = ask["bucket"].to_numpy(object), other["bucket"].to_numpy(object)
            for bucket in dict.fromkeys(a_bucket):
                mine = np.flatnonzero(a_bucket == bucket)
                pool = np.arange(len(other)) if bucket == NONE else np.flatnonzero((o_bucket == bucket) | (o_bucket == NONE))
                if not len(pool):
                    continue
                # The inverted index: for each gram, the texts that have it.
                sizes = o_ends[pool + 1] - o_ends[pool]
                at = _spread(o_ends[pool], sizes)
                order = np.argsort(o_gram[at], kind="stable")
                index_w, index_at = o_w[at][order], np.repeat(np.arange(len(pool)), sizes)[order]
                starts = np.concatenate([[0], np.cumsum(np.bincount(o_gram[at], minlength=v))])
                lists = starts[a_gram + 1] - starts[a_gram]
                cost = np.concatenate([[0], np.cumsum(lists)])
                cost = cost[a_ends[mine + 1]] - cost[a_ends[mine]]
                lo = 0
                while lo < len(mine):
                    most = max(1, CELLS // len(pool))
                    hi = lo + max(1, int(np.searchsorted(np.cumsum(cost[lo : lo + most]), PRODUCTS, side="right")))
                    some, lo = mine[lo:hi], hi
                    sizes = a_ends[some + 1] - a_ends[some]
                    p = _spread(a_ends[some], sizes)
                    n = lists[p]
                    q = _spread(starts[a_gram[p]], n)
                    cell = np.repeat(np.repeat(np.arange(len(some)) * len(pool), sizes), n) + index_at[q]
                    exact = np.bincount(cell, np.repeat(a_w[p], n) * index_w[q], len(some) * len(pool)).reshape(len(some), len(pool))
                    # Rounding keeps the order, so only what comes near the bar is rounded.
                    rounded = lambda x: np.floor(x * 1e6 + 0.5) / 1e6
                    bar = rounded(np.partition(exact, -k, axis=1)[:, -k]) if k < len(pool) else np.zeros(len(some))
                    rows, cols = np.nonzero(exact >= np.maximum(bar - 1e-6, 1e-7)[:, None])
                    score = rounded(exact[rows, cols])
                    fits = (score >= bar[rows]) & (score > 0)
                    rows, cols, score = rows[fits], cols[fits], score[fits]
                    n = n_ids[pool[cols]]
                    ids, rows, value = _spread(first_id[pool[cols]], n), np.repeat(rows, n), np.repeat(score, n)
                    order = np.lexsort((place[ids], -value, rows))
                    rows, ids, value = rows[order], ids[order], value[order]
                    keep = np.arange(len(rows)) - np.searchsorted(rows, rows) < k
                    found.append((names[some[rows[keep]]], flat[ids[keep]], value[keep]))
        if not found:
            return pd.DataFrame({"name": texts["text"][:0], "id": texts["text"][:0], "score": np.empty(0)})
        return pd.DataFrame(dict(zip(("name", "id", "score"), map(np.concatenate, zip(*found, strict=True)), strict=True)))

    return best


def search(texts: DataFrame, ask: Column, other: Column, k: int, grams: tuple[int, int] = GRAMS, min_df: int = MIN_DF, max_df: float = MAX_DF, other_tile: int | None = None) -> DataFrame:
    """(ask, other, score, rank, best) of (id, country, bucket, text): the k most similar texts of `other` for each of `ask`, exactly.

    Scores are those of scores(), frequencies those of all texts; ties go by the other id; best is the score of rank 1. Equal
    texts of a bucket ask once, and of those that answer the k first ids do. What crosses the network are texts, once for each tile
    of the other side; the rows that are written are those of the answer, by distinct texts.
    """
    spark = texts.sparkSession
    kind = texts.schema["id"].dataType.simpleString()
    known = texts.select("id", "country", "bucket", "text", ask.alias("ask"), other.alias("other"))
    total = known.groupBy("country").agg(F.count(F.lit(1)).alias("n"))
    # An id that comes with several texts in a bucket has the grams of all.
    joined = F.concat_ws(" ", F.array_sort(F.collect_list("text"))).alias("text")
    rows = written(known.where("country is not null").groupBy("id", "country", "bucket").agg(joined, F.max("ask").alias("ask"), F.max("other").alias("other")), "texts")
    distinct = rows.groupBy("country", "text").agg(F.count(F.lit(1)).alias("n"))
    df = distinct.mapInPandas(_frequencies(*grams), "country string, gram string, df long").groupBy("country", "gram").agg(F.sum("df").alias("df"))
    df = df.join(total, "country").where((F.col("df") >= min_df) & (F.col("df") <= max_df * F.col("n")))
    idf = written(df.select("country", "gram", (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1).alias("idf")), "idf")
    rows = rows.where("id is not null")  # texts without an id count, and are not found
    several = rows.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("id")
    plain = several.isEmpty()
    one = rows if plain else rows.join(several, "id", "left_anti")
    same = ["country", "bucket", "text"]
    asks = one.where("ask and bucket is not null").groupBy(*same).agg(F.array(F.min("id")).alias("ids"))
    first = Window.partitionBy(*same).orderBy("id")
    others = one.where("other and bucket is not null").withColumn("_r", F.row_number().over(first)).where(F.col("_r") <= k).groupBy(*same).agg(F.array_sort(F.collect_list("id")).alias("ids"))
    dealt = written(asks.withColumn("other", F.lit(False)).unionByName(others.withColumn("other", F.lit(True))), "distinct")
    tiles = lambda side, size: F.ceil(F.greatest(F.count_if(side), F.sum(F.when(side, F.length("text"))) / TILE_TEXT, F.lit(1)) / size).cast("int")
    sizes = written(dealt.groupBy("country").agg(tiles(~F.col("other"), ASK_TILE).alias("a"), tiles(F.col("other"), other_tile or OTHER_TILE).alias("o")), "tiles")  # one row a country
    groups = sizes.agg(F.sum(F.col("a") * F.col("o"))).first()[0] or 1
    every, mine = lambda n: F.sequence(F.lit(0), F.col(n) - 1), lambda n: F.array(F.pmod(F.xxhash64("bucket", "text"), F.col(n)).cast("int"))
    side = lambda a, o: [F.explode(a).alias("at"), o.alias("_o")]
    cells = lambda df, cols, a, o: df.select(*cols, *side(a, o)).select(*cols, "at", F.explode("_o").alias("ot"))
    placed = dealt.join(F.broadcast(sizes), "country")
    placed = cells(placed, [*same, "ids", "other"], F.when(F.col("other"), every("a")).otherwise(mine("a")), F.when(F.col("other"), mine("o")).otherwise(every("o")))
    tables = cells(idf.join(F.broadcast(sizes), "country"), ["country", "gram", "idf"], every("a"), every("o"))
    keys = ["country", "at", "ot"]
    parts = max(1, min(2 * int(groups), 10_000))
    # As many partitions as it takes for tiles to have one of their own mostly: their work is far above what their bytes say.
    dealt_out = lambda df: df.repartition(parts, *keys).groupBy(*keys)
    near = dealt_out(placed).cogroup(dealt_out(tables)).applyInPandas(_search_tile(k, grams), f"name {kind}, id {kind}, score double")
    near = ranked(near, "name", k, "id").withColumn("best", F.max("score").over(Window.partitionBy("name")))
    near = written(near.select("name", F.col("id").alias("answer"), "score", "rank", "best"), "near")
    out = near.join(dealt.where("not other").select(*same, F.col("ids")[0].alias("name")), "name").join(one.where("ask").select("id", *same), same).select(F.col("id").alias("ask"), F.col("answer").alias("other"), "score", "rank", "best")
    if plain:
        return out
    posted = index(texts, grams, min_df, max_df)
    of = lambda flag, how: posted.join(rows.where(flag).select("id"), "id", "left_semi").join(several, "id", how)
    pairs = scores(of("ask", "left_semi"), posted.join(rows.where("other").select("id"), "id", "left_semi")).unionByName(scores(of("ask", "left_anti"), of("other", "left_semi")))
    pairs = out.select("ask", "other", "score").unionByName(pairs.toDF("ask", "other", "score"))
    return ranked(pairs, "ask", k, "other").withColumn("best", F.max("score").over(Window.partitionBy("ask")))


def search_forward(texts: DataFrame, query: Column, pool: Column, k: int, **how) -> DataFrame:
    """(s1, cand, score, rank): the k best candidates of each query. See search()."""
    return search(texts, query, pool, k, **how).select(F.col("ask").alias("s1"), F.col("other").alias("cand"), "score", "rank")


def search_reverse(texts: DataFrame, query: Column, pool: Column, m: int, **how) -> DataFrame:
    """(s1, cand, score, best, rank): the m best queries of each candidate; best is its top score over all queries. See search()."""
    return search(texts, pool, query, m, **how).select(F.col("other").alias("s1"), F.col("ask").alias("cand"), "score", "best", "rank")


def rare_tokens(queries: DataFrame, pool: DataFrame, frequency: DataFrame, k: int, max_df: int = RARE_DF) -> DataFrame:
    """(s1, cand, score, rank) of (id, country, text): candidates that share rare tokens, by how many."""
    rare = frequency.where((F.col("df") <= max_df) & (F.length("t") >= RARE_LEN)).select("country", "t")
    each = lambda df, name: df.select(F.col("id").alias(name), "country", F.explode(tokens(F.col("text"))).alias("t")).join(rare, ["country", "t"])
    shared = each(queries, "s1").join(each(pool, "cand"), ["country", "t"]).groupBy("s1", "cand").agg(F.count(F.lit(1)).cast("double").alias("score"))
    return ranked(shared, "s1", k, "cand")


def token_frequency(texts: DataFrame) -> DataFrame:
    """(country, t, df) of (id, country, text)."""
    return texts.select("country", F.explode(tokens(F.col("text"))).alias("t")).groupBy("country", "t").agg(F.count(F.lit(1)).alias("df"))


METHODS = ("name", "name_city", "name_addr", "reverse", "rare")


def to_wide(hits: DataFrame) -> DataFrame:
    """One row a pair of (scope, s1, cand, method, score, rank, best): rank and score of each method."""
    pick = lambda m, c: F.when(F.col("method") == m, F.col(c))
    cells = [x for m in METHODS for x in (F.min(pick(m, "rank")).alias(f"rank_{m}"), F.min(pick(m, "score")).alias(f"score_{m}"))]
    return hits.groupBy("scope", "s1", "cand").agg(*cells, F.max(pick("reverse", "best")).alias("best_reverse"))


#: Rows of a tile of vectors: a task holds one tile of queries, one of the pool and their scores (32 MB).
QUERY_TILE, POOL_TILE = 1024, 4096


def _tile_topk(k: int) -> Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]:
    def best(q: pd.DataFrame, p: pd.DataFrame) -> pd.DataFrame:
        out = pd.DataFrame({"s1": q["id"].to_numpy()[:0], "cand": p["id"].to_numpy()[:0], "score": np.empty(0)})
        if q.empty or p.empty:
            return out
        found, p = [out], p.sort_values("id", kind="stable")
        unit = lambda df: (v := np.stack(df["vector"].to_numpy()).astype(np.float64)) / np.sqrt((v * v).sum(axis=1, keepdims=True))
        ids, vectors = p["id"].to_numpy(), unit(p).T
        for at in range(0, len(q), QUERY_TILE):
            own = q["id"].to_numpy()[at : at + QUERY_TILE]
            for low in range(0, len(p), POOL_TILE):
                cands = ids[low : low + POOL_TILE]
                exact = unit(q.iloc[at : at + QUERY_TILE]) @ vectors[:, low : low + POOL_TILE]
                score = np.copysign(np.floor(np.abs(exact) * 1e6 + 0.5) / 1e6, exact) + 0.0
                score[own[:, None] == cands[None, :]] = -np.inf
                bar = np.partition(score, -k, axis=1)[:, -k] if k < len(cands) else np.full(len(own), -np.inf)
                rows, cols = np.nonzero((score >= bar[:, None]) & (score > -np.inf))
                order = np.lexsort((cols, -score[rows, cols], rows))  # columns go by id, so ties do
                rows, cols = rows[order], cols[order]
                place = np.arange(len(rows)) - np.searchsorted(rows, rows)
                rows, cols = rows[place < k], cols[place < k]
                found.append(pd.DataFrame({"s1": own[rows], "cand": cands[cols], "score": score[rows, cols]}))
        return pd.concat(found, ignore_index=True)

    return best


def dense_topk(queries: DataFrame, pool: DataFrame, k: int) -> DataFrame:
    """(s1, cand, score, rank) of (id, embedding): cosine top-k of a stated query set against all rows; ties by the other id.

    Tiles of queries meet tiles of the pool as matrix products, and only the k best of a tile leave its task: rows are queries
    x tiles x k, not queries x pool. Tiles are dealt by a hash of the id, and their number grows with the tables. Vectors are
    compared with those of their own length; missing ones, and those of length 0 or with a missing or infinite part, have no
    candidates and are none.
    """
    whole = F.forall("embedding", lambda x: x.isNotNull() & (F.abs(x.cast("double")) < float("inf"))) & F.exists("embedding", lambda x: x != 0)

    def dealt(df: DataFrame, size: int, name: str) -> tuple[DataFrame, int]:
        tiles = -(-max(df.count(), 1) // size)
        return df.where(F.col("id").isNotNull() & whole).select("id", F.col("embedding").alias("vector"), F.size("embedding").alias("dim"), F.pmod(F.xxhash64("id"), F.lit(tiles)).cast("int").alias(name)), tiles

    (q, q_tiles), (p, p_tiles) = dealt(queries, QUERY_TILE, "qt"), dealt(pool, POOL_TILE, "pt")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    q, p = q.withColumn("pt", every(p_tiles)), p.withColumn("qt", every(q_tiles))
    kind = lambda df: df.schema["id"].dataType.simpleString()
    keys = ("dim", "qt", "pt")
    best = q.groupBy(*keys).cogroup(p.groupBy(*keys)).applyInPandas(_tile_topk(k), f"s1 {kind(q)}, cand {kind(p)}, score double")
    return ranked(best, "s1", k, "cand")
