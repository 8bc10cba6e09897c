"""Near-duplicate vectors by int8 tile products (operator 10).

Vectors of one label are dealt into blocks, and every pair of blocks is one
task's tile. A unit vector x is stored as s*q with int8 codes q and error e, whose
norm is kept: |x.y - sx*sy*(qx.qy)| <= |sx qx||ey| + |ex||sy qy| + |ex||ey|.
Products of codes are exact in float32 (below 2^24 up to 1,040 dimensions; longer
vectors are multiplied in float64), so a pair whose upper bound is below the
threshold can't be linked. All others are recomputed in double precision.

Equal vectors of a label are folded first: their copies count as links and as
members, without being paired. A tile gives back, for each vector, how many it
is linked to and one edge of a spanning forest, so results grow with the rows
and not with the links.

Results for odd input: vectors that are null, empty, zero or hold a null or
non-finite component, and vectors with a null label, link with nothing; vectors
of different lengths don't link; repeated ids each give a row; a row with a null id
keeps null as its component, unless a vector with an id is in reach. Vectors may have any
length; other columns are left behind; no rows give no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, read
from .graph import smallest

BLOCK, PART = 4096, 1024
EXACT_DIMENSIONS = 1040


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Codes, scales, norms of s*q and of the error, of unit rows."""
    scale = np.abs(x).max(1) / 127
    codes = np.rint(x / scale[:, None]).astype(np.int8)
    back = codes * scale[:, None]
    grown = 1 + 1e-9  # above what rounding in these norms can lose
    return codes, scale, np.linalg.norm(back, axis=1) * grown, np.linalg.norm(x - back, axis=1) * grown + 1e-12


def tile_links(x: np.ndarray, y: np.ndarray, threshold: float, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of rows of x and y with cosine >= threshold; i < j only, if both are the same block."""
    nx, ny = np.linalg.norm(x, axis=1), np.linalg.norm(y, axis=1)
    ux, uy = x / nx[:, None], y / ny[:, None]
    qx, sx, ax, bx = quantise(ux)
    qy, sy, ay, by = (qx, sx, ax, bx) if same else quantise(uy)
    kind = np.float32 if x.shape[1] <= EXACT_DIMENSIONS else np.float64
    left, right = [], []
    for i in range(0, len(x), PART):
        wide = qx[i : i + PART].astype(kind)
        for j in range(i if same else 0, len(y), PART):
            dots = (wide @ qy[j : j + PART].T.astype(kind)).astype(np.float32)
            dots *= (sx[i : i + PART, None] * sy[None, j : j + PART]).astype(np.float32)
            a, b, c, d = ax[i : i + PART], bx[i : i + PART], ay[j : j + PART], by[j : j + PART]
            slack = 1e-5 + (b.max() * (c + d))[None, :] + (a[:, None] * d[None, :])
            p, q = np.nonzero(dots >= (threshold - slack).astype(np.float32))
            p, q = p + i, q + j
            if same:
                p, q = p[p < q], q[p < q]
            for k in range(0, len(p), 65_536):
                r, s = p[k : k + 65_536], q[k : k + 65_536]
                cos = np.einsum("ij,ij->i", x[r], y[s]) / (nx[r] * ny[s])
                ok = cos >= threshold
                left.append(r[ok])
                right.append(s[ok])
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *left]), np.concatenate([none, *right])


def forest(n: int, p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """The smallest index reachable from each of n nodes."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[p], root[q])
        new = root.copy()
        np.minimum.at(new, p, low)
        np.minimum.at(new, q, low)
        np.minimum.at(new, root[p], low)
        np.minimum.at(new, root[q], low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _tiles(threshold: float):
    def run(batches):
        for b in batches:
            for same, ids, copies, flat, size in zip(*(c.to_pylist() if k in (0, 4) else [c.slice(i, 1).flatten() for i in range(len(c))] for k, c in enumerate(b.columns))):
                # ids etc. hold the first block's rows, then the second's; same is the first block's length
                ids, copies = ids.to_numpy(zero_copy_only=False), copies.to_numpy(zero_copy_only=False)
                v = flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(ids), size)
                if same == len(ids):
                    p, q = tile_links(v, v, threshold, True)
                else:
                    p, q = tile_links(v[:same], v[same:], threshold, False)
                    q = q + same
                by_id = np.argsort(ids, kind="stable")
                place = np.empty(len(ids), np.int64)
                place[by_id] = np.arange(len(ids))
                root = forest(len(ids), place[p], place[q])
                links = np.bincount(p, copies[q], len(ids)) + np.bincount(q, copies[p], len(ids))
                hit = np.nonzero(links)[0]
                yield pa.RecordBatch.from_arrays([pa.array(ids[hit], pa.int64()), pa.array(links[hit].astype(np.int64)), pa.array(ids[by_id[root[place[hit]]]], pa.int64())], ["node", "links", "near"])

    return run


def near_vectors(rows: DataFrame, threshold: float = 0.98, key: str = "vec_id", vector: str = "embedding", label: str = "label", block: int = BLOCK) -> DataFrame:
    """One row per row: vec_id, n_links, component_id, kept."""
    v = F.col("v")
    kind = "array<float>" if rows.schema[vector].dataType.simpleString() == "array<float>" else "array<double>"
    rows = rows.select(F.col(key).alias("vec_id"), F.col(vector).cast(kind).alias("v"), F.col(label).alias("label"))
    sound = F.col("label").isNotNull() & v.isNotNull() & F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False)) & F.coalesce(F.exists(v, lambda x: x != 0), F.lit(False))
    rows = rows.withColumn("k", F.when(sound, F.struct(F.xxhash64(F.lit("a"), v, "label").alias("k1"), F.xxhash64(F.lit("b"), v, "label").alias("k2"))))
    reps = rows.where("k is not null").groupBy("k").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"), F.first("label").alias("label"), F.first(v).alias("v"))
    reps = cut(reps.withColumns({"size": F.size("v"), "node": F.monotonically_increasing_id()}))
    groups = reps.groupBy("label", "size").agg(F.ceil(F.count("*") / block).alias("blocks"))
    dealt = reps.join(groups, ["label", "size"]).withColumn("at", F.pmod(F.xxhash64("node"), F.col("blocks")))
    packed = dealt.groupBy("label", "size", "blocks", "at").agg(F.collect_list(F.struct("node", "copies", F.col("v").alias("vec"))).alias("part"))
    pairs = packed.withColumn("to", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    pairs = pairs.select("label", "size", F.least("at", "to").alias("i"), F.greatest("at", "to").alias("j"), "at", "part")
    tiles = pairs.groupBy("label", "size", "i", "j").agg(F.array_sort(F.collect_list(F.struct("at", "part"))).alias("both"))
    both = F.flatten(F.transform("both", lambda b: b["part"]))
    tiles = tiles.select(F.size(F.col("both")[0]["part"]).alias("same"), both.alias("all"), "size")
    flat = tiles.select("same", F.transform("all", lambda r: r["node"]).alias("ids"), F.transform("all", lambda r: r["copies"]).alias("copies"), F.flatten(F.transform("all", lambda r: r["vec"])).alias("flat"), "size")
    found = cut(flat.mapInArrow(_tiles(threshold), "node long, links long, near long"))
    counts = found.groupBy("node").agg(F.sum("links").alias("links"))
    ids = smallest(found.select(F.col("node").alias("a"), F.col("near").alias("b")), reps.select("node", F.col("rep").alias("id")))
    known = reps.select("k", "node", "rep", "copies").join(counts, "node", "left").join(ids, "node", "left")
    known = known.select("k", "copies", "links", F.coalesce("component_id", "rep").alias("component_id"))
    out = rows.select("vec_id", "k").join(known, "k", "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce(F.coalesce("links", F.lit(0)) + F.col("copies") - 1, F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), component.eqNullSafe(F.col("vec_id")).alias("kept"))


def op10_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(read(spark, sf_dir, "embeddings"))
