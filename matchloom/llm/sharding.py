"""Sharding by a hierarchical weighted hash tree.

Leaves are shards with a weight; inner nodes are racks and regions, whose weight is the sum of their leaves. A row
descends from the root: at each node every child draws -ln(u) / weight, u being a hash of the row's key and the
child's name, and the least draw wins. A child's draw depends on nothing but its own name and weight, so
a change of weights moves rows only into or out of subtrees whose weights change. Shards beyond the
first eight open a region of their own: the regions that were there keep their weights, and one more shard takes
rows only into itself.

All of it is DataFrame expressions: no Python code runs on rows, and only ids and sizes are shuffled.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from matchloom.llm.store import cut

#: Buckets of a shard's slot order; one is the most that a task must order by itself.
BUCKETS = 4096


class Leaf(NamedTuple):
    region: int
    rack: int
    shard: int
    weight: float = 1.0


def topology(shards: int, base: int = 8) -> list[Leaf]:
    """Two racks of two shards a region for the first `base` shards, then a region for each further one."""
    return [Leaf(s // 4, s // 2, s) if s < base else Leaf(base // 4 + s - base, base // 2 + s - base, s) for s in range(shards)]


def draw(key: Column, node: str, weight: float) -> Column:
    """The child's draw for a key: 48 bits of md5 to (0, 1), then an exponential variate of rate weight."""
    bits = F.conv(F.substring(F.md5(F.concat(F.lit(f"{node}:"), key)), 1, 12), 16, 10).cast("double")
    return -F.log((bits + 0.5) / float(1 << 48)) / F.lit(float(weight))


def _least(key: Column, children: Sequence[tuple[str, float, Column]]) -> Column:
    """The value of the child with the least draw; a single child needs none."""
    if len(children) == 1:
        return children[0][2]
    draws = [F.struct(draw(key, name, w).alias("d"), F.lit(i).alias("i")) for i, (name, w, _) in enumerate(children)]
    chosen, out = F.least(*draws)["i"], children[-1][2]
    for i in range(len(children) - 1):
        out = F.when(chosen == i, children[i][2]).otherwise(out)
    return out


def descend(key: Column, leaves: Sequence[Leaf]) -> Column:
    """Shard of a string key: region, then rack, then shard. Leaves of weight 0 get no rows."""
    tree: dict[int, dict[int, list[Leaf]]] = defaultdict(lambda: defaultdict(list))
    for leaf in leaves:
        if leaf.weight > 0:
            tree[leaf.region][leaf.rack].append(leaf)
    if not tree:
        raise ValueError("no shard has a positive weight")
    regions = []
    for region, racks in sorted(tree.items()):
        rows = []
        for rack, shards in sorted(racks.items()):
            shard = _least(key, [(f"shard{x.shard}", x.weight, F.lit(x.shard)) for x in shards])
            rows.append((f"rack{rack}", sum(x.weight for x in shards), shard))
        regions.append((f"region{region}", sum(w for _, w, _ in rows), _least(key, rows)))
    return _least(key, regions)


def place(docs: DataFrame, leaves: Sequence[Leaf], grown: Sequence[Leaf] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, size, text_crc32, law, shard, slot, grown_shard), one row a document.

    size: UTF-8 bytes of the text plus 1; a null text counts as empty. The shard depends on the id and the tree
    alone: copies of a text go where their own ids go, so a large group of copies spreads over all shards. A null id
    is the key of an empty string. Repeated rows share their shard and get slots of their own; ties of the slot order
    differ in nothing that is returned. slot: gapless from 0 within the shard, from counts of 4096 hash buckets
    and a row number within each, so no task orders a whole shard. An empty table gives no rows.
    """
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    body = F.encode(F.coalesce(F.col("body"), F.lit("")), "UTF-8")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("body")).select(
        "doc_id",
        (F.octet_length(body) + 1).cast("long").alias("size"),
        F.crc32(body).alias("text_crc32"),
        descend(key, leaves).cast("int").alias("shard"),
        (descend(key, grown) if grown else F.lit(None)).cast("int").alias("grown_shard"),
        F.conv(F.substring(F.md5(key), 1, 3), 16, 10).cast("int").alias("bucket"),
    )
    rows = cut(rows)
    counts = rows.groupBy("shard", "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    inside = Window.partitionBy("shard", "bucket").orderBy("doc_id", "text_crc32", "size")
    numbered = rows.withColumn("at", F.row_number().over(inside) - 1)
    return numbered.join(starts, ["shard", "bucket"]).select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("start") + F.col("at")).cast("long").alias("slot"), "grown_shard")
