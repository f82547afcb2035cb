"""The corpus operators as queries over the driver's tables, with DuckDB twins where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchloom.llm import langid, line_dedup, lm_score, media, mixing, near_dup, packing, quality, sharding, warc


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.in_training_order(mixing.mix(_documents(spark, sf_dir)))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", F.round("first_position", 9).alias("first_position"))


OP1_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
per AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
ranked AS (SELECT *, row_number() OVER (ORDER BY source COLLATE "binary" NULLS LAST) - 1 AS rank FROM per),
weighed AS (SELECT *, [5, 2, 1][(rank % 3 + 1)::INT]::BIGINT AS weight, source_size * 3 AS lim FROM ranked),
levels AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(lim) OVER w, 0))::DOUBLE / (sum(weight) OVER () - coalesce(sum(weight) OVER w, 0))::DOUBLE AS lev
  FROM weighed WINDOW w AS (ORDER BY lim::DOUBLE / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
water AS (SELECT arg_min(lev, lim::DOUBLE / weight * 1e6 + rank) AS level FROM levels WHERE lim::DOUBLE / weight > lev),
targets AS (
  SELECT source, rank, source_size, CASE WHEN lim::DOUBLE / weight <= lev THEN lim::DOUBLE ELSE level * weight END AS target
  FROM levels LEFT JOIN water ON true),
placed AS (
  SELECT s.doc_id, s.size, t.source_size, t.target, round(t.target)::BIGINT AS goal, t.rank % 3 AS shape,
    (coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY md5(coalesce(s.doc_id::VARCHAR, '')), s.doc_id, s.size
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS first
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source),
drawn AS (
  SELECT *, greatest(least(goal - first, size), 0) AS w0, greatest(least(goal - source_size - first, size), 0) AS w1,
    greatest(least(goal - 2 * source_size - first, size), 0) AS w2 FROM placed),
shared AS (SELECT *, least((first + w0 / 2.0::DOUBLE) / greatest(goal, 1), 1.0::DOUBLE) AS p FROM drawn)
SELECT doc_id, size, source_size, target, (w0 + w1 + w2)::BIGINT AS taken,
  CASE WHEN w0 = 0 THEN NULL ELSE round(CASE shape WHEN 0 THEN p
    WHEN 1 THEN least(p * 2 / (sqrt(0.25::DOUBLE + 2 * p) + 0.5), 1.0)
    ELSE least(p * 2 / (sqrt(greatest(2.25::DOUBLE - 2 * p, 0)) + 1.5), 1.0) END, 9) END AS first_position
FROM shared
"""


def op2_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = lm_score.score(_documents(spark, sf_dir))
    return scored.select("doc_id", "n_words", *[(F.round(c, 6) + F.lit(0.0)).alias(c) for c in ("log_score", "per_word")])


OP2_SQL = r"""
WITH texts AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
place AS (SELECT r, unnest(w) AS c, generate_subscripts(w, 1) AS i FROM texts),
grams AS (SELECT r, i, c, lag(c, 1) OVER o AS b, lag(c, 2) OVER o AS a FROM place WINDOW o AS (PARTITION BY r ORDER BY i)),
one AS (SELECT c, count(*) AS n FROM grams GROUP BY c),
two AS (SELECT b, c, count(*) AS n FROM grams WHERE b IS NOT NULL GROUP BY b, c),
three AS (SELECT a, b, c, count(*) AS n FROM grams WHERE a IS NOT NULL GROUP BY a, b, c),
every AS (SELECT count(*) AS n FROM place),
logs AS (
  SELECT g.r, CASE
    WHEN three.n >= 2 THEN ln(three.n) - ln(before.n)
    WHEN two.n >= 2 THEN ln(two.n) - ln(prev.n) + CASE WHEN g.a IS NOT NULL THEN ln(0.4) ELSE 0 END
    ELSE ln(one.n) - ln(every.n) + CASE WHEN g.a IS NOT NULL THEN 2 WHEN g.b IS NOT NULL THEN 1 ELSE 0 END * ln(0.4) END AS s
  FROM grams g CROSS JOIN every JOIN one ON one.c = g.c
  LEFT JOIN one prev ON prev.c = g.b
  LEFT JOIN two ON two.b = g.b AND two.c = g.c
  LEFT JOIN two before ON before.b = g.a AND before.c = g.b
  LEFT JOIN three ON three.a = g.a AND three.b = g.b AND three.c = g.c),
sums AS (SELECT r, sum(s::DOUBLE) AS s FROM logs GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, round(coalesce(s, 0.0::DOUBLE), 6) + 0.0::DOUBLE AS log_score, round(s / len(w), 6) + 0.0::DOUBLE AS per_word
FROM texts LEFT JOIN sums USING (r)
"""


def op3_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.stored_features(_documents(spark, sf_dir))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    return quality.assess(docs, quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def op5_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.place(_documents(spark, sf_dir), sharding.topology(8), sharding.topology(9))


def _draws(nodes: list[tuple[str, float]]) -> str:
    """DuckDB: the number, from 0 on, of the (name, weight) node with the least draw for `key`."""
    draws = ", ".join(f"-ln((CAST(concat('0x', substring(md5(concat('{name}:', key)), 1, 12)) AS BIGINT) + 0.5::DOUBLE) / {float(1 << 48)!r}::DOUBLE) / {weight!r}::DOUBLE" for name, weight in nodes)
    return f"list_position([{draws}], list_min([{draws}])) - 1"


def _tree_sql(leaves: list[sharding.Leaf]) -> str:
    """DuckDB: shard of `key`, region by rack by shard."""

    def choose(level: str, under: list[sharding.Leaf]) -> str:
        if level == "done":
            return str(under[0].shard)
        groups = {k: [x for x in under if getattr(x, level) == k] for k in sorted({getattr(x, level) for x in under})}
        below = {"region": "rack", "rack": "shard", "shard": "done"}[level]
        if len(groups) == 1:
            return choose(below, under)
        cases = " ".join(f"WHEN {i} THEN {choose(below, g)}" for i, g in enumerate(groups.values()))
        return f"CASE {_draws([(f'{level}{k}', sum(x.weight for x in g)) for k, g in groups.items()])} {cases} END"

    return choose("region", [x for x in leaves if x.weight > 0])


# The table of the CRC's bytes follows from its polynomial; a text's CRC is folded over its bytes.
OP5_SQL = f"""
WITH crc AS (SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce(list_concat([i::BIGINT], range(8)), lambda c, _: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) r(i))),
rows AS (SELECT row_number() OVER () AS r, doc_id, coalesce(doc_id::VARCHAR, '') AS key, octet_length(encode(coalesce(text, '')))::BIGINT AS n, hex(encode(coalesce(text, ''))) AS h FROM documents),
sums AS (SELECT r, xor(list_reduce(list_concat([4294967295], list_transform(regexp_extract_all(h, '..'), lambda x: CAST(concat('0x', x) AS BIGINT))), lambda c, b: xor(c >> 8, t[xor(c, b) % 256 + 1])), 4294967295) AS text_crc32 FROM rows, crc),
placed AS (SELECT doc_id, n + 1 AS size, text_crc32, key, ({_tree_sql(sharding.topology(8))})::INT AS shard, ({_tree_sql(sharding.topology(9))})::INT AS grown_shard FROM rows JOIN sums USING (r))
SELECT doc_id, size, text_crc32, 'key' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY substring(md5(key), 1, 3), doc_id NULLS FIRST, text_crc32, size) - 1 AS slot, grown_shard FROM placed
"""


def op6_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    held_out = langid.is_held_out(F.col("doc_id"))
    model = langid.train(docs.where(~held_out))
    return langid.predict(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.dedup_lines(_documents(spark, sf_dir).select("doc_id", "text"))
    digest = F.sha2(F.encode(F.coalesce("kept", F.lit("")), "UTF-8"), 256)
    return kept.select("doc_id", "n_lines", "n_dropped", digest.alias("kept_sha256"))


OP7_SQL = r"""
WITH lines AS (
  SELECT rowid AS r, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
    generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i
  FROM (SELECT row_number() OVER () AS rowid, text FROM documents)),
keyed AS (
  SELECT r, i, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines),
often AS (SELECT key FROM keyed WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT r) >= 10),
marked AS (SELECT k.*, o.key IS NOT NULL AS gone FROM keyed k LEFT JOIN often o ON k.key = o.key),
per AS (
  SELECT r, count(*)::BIGINT AS n_lines, count(*) FILTER (WHERE gone)::BIGINT AS n_dropped,
    sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
  FROM marked GROUP BY r)
SELECT d.doc_id, n_lines, n_dropped, kept_sha256
FROM per JOIN (SELECT row_number() OVER () AS rowid, doc_id FROM documents) d ON d.rowid = per.r
"""


def op8_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.link(_documents(spark, sf_dir))


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    """Where the public tokenizer's file is."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op9_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_documents(spark, sf_dir), tokenizer_path())


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(spark.read.parquet(f"{sf_dir}/pages.parquet"))


OP10_SQL = r"""
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
g AS (SELECT payload_digest, max(page_id) AS keeper FROM p WHERE payload_bytes >= 1000 GROUP BY payload_digest)
SELECT p.page_id, p.payload_bytes, p.payload_digest,
  CASE WHEN keeper IS NOT NULL AND p.page_id IS DISTINCT FROM keeper THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN keeper IS NOT NULL AND p.page_id IS DISTINCT FROM keeper THEN keeper END AS refers_to
FROM p LEFT JOIN g USING (payload_digest)
"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mix": op1_mix,
    "op2_lm_score": op2_lm_score,
    "op3_media": op3_media,
    "op4_quality": op4_quality,
    "op5_shard": op5_shard,
    "op6_langid": op6_langid,
    "op7_line_dedup": op7_line_dedup,
    "op8_near_dup": op8_near_dup,
    "op9_pack": op9_pack,
    "op10_warc": op10_warc,
}
ORACLES: dict[str, str] = {"op1_mix": OP1_SQL, "op2_lm_score": OP2_SQL, "op5_shard": OP5_SQL, "op7_line_dedup": OP7_SQL, "op10_warc": OP10_SQL}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
