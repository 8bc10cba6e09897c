"""Sharding by a hierarchical weighted hash tree (operator 9).

A tree of regions, racks and shards. A row descends from the root: at each level
every child draws ``-ln(u) / weight``, with ``u`` hashed from the key and the
child's path and the weight of all shards below it, and the smallest draw wins. A
child is thus chosen in proportion to its weight, and a changed weight moves rows
only where it changes draws: two shards that exchange weight inside a rack leave all
other racks and regions as they were, and a subtree that gains takes rows only
from its siblings, by way of its ancestors where these gain too.

``grown`` adds a shard as a child of the root. No other draw changes by that, so it
takes rows only into itself.

Results for odd input: a null text has size 1 and checksum 0; rows with a null
key are drawn as the empty key and share one shard; repeated rows land together in slots of their own;
texts of any length and other columns don't matter; existing columns of the trees' names
are replaced; no rows give no rows. Ties of draws go to the first child.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import hex_draw, rank_within, read

#: A tree is a shard's number or a dict from names to trees.
Tree = "int | dict"


def default_tree(shards: int, per_rack: int = 2, racks: int = 2) -> dict:
    """Shards in order, ``per_rack`` to a rack and ``racks`` racks to a region."""
    tree: dict = {}
    for s in range(shards):
        rack = s // per_rack
        tree.setdefault(f"region{rack // racks}", {}).setdefault(f"rack{rack}", {})[f"shard{s}"] = s
    return tree


def grown(tree: dict, shard: int) -> dict:
    """The tree with one more shard, in a region of its own."""
    return {**tree, f"region of shard{shard}": shard}


def leaves(tree) -> list[int]:
    return [tree] if isinstance(tree, int) else [x for t in tree.values() for x in leaves(t)]


def draw(key: str, path: str, weight: float) -> Column:
    """The draw of the node at ``path``."""
    unit = (hex_draw(path, F.col(key)) + F.lit(0.5)) * F.lit(2.0**-52)
    return -F.log(unit) / F.lit(float(weight))


def descend(tree, key: str, weights: dict[int, float], path: str = "") -> Column:
    """The shard reached from the root."""
    if isinstance(tree, int):
        return F.lit(tree)
    below = {f"{path}/{name}": t for name, t in tree.items()}
    heavy = {p: sum(weights.get(x, 1.0) for x in leaves(t)) for p, t in below.items()}
    open_ = [p for p in below if heavy[p] > 0]
    if not open_:
        raise ValueError(f"nothing below {path or '/'} has weight")
    ways = [descend(below[p], key, weights, p) for p in open_]
    if len(ways) == 1:
        return ways[0]
    least = F.array_min(F.array(*[F.struct(draw(key, p, heavy[p]).alias("d"), F.lit(i).alias("i")) for i, p in enumerate(open_)]))
    return F.element_at(F.transform(F.array(least["i"]), lambda c: _choose(c, ways)), 1)


def _choose(c: Column, ways: list[Column]) -> Column:
    out = ways[-1]
    for i in range(len(ways) - 2, -1, -1):
        out = F.when(c == i, ways[i]).otherwise(out)
    return out


def assign(df: DataFrame, trees: dict[str, dict], key: str = "doc_id", weights: dict[int, float] | None = None) -> DataFrame:
    """Add one shard column for each named tree."""
    return df.withColumns({name: descend(t, key, weights or {}).cast("int") for name, t in trees.items()})


def op9_sharding(spark: SparkSession, sf_dir: str, shards: int = 8) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    tree = default_tree(shards)
    placed = assign(rows, {"shard": tree, "grown_shard": grown(tree, shards)})
    placed = rank_within(placed, "shard", ["doc_id", "size", "text_crc32"], "slot")
    return placed.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")
