"""MinHash near-duplicates by an LSH forest (operator 8).

1. Texts become sets of word shingles, hashed one by one; equal sets fold into one node.
2. A node's signature has ``TREES * DEPTH`` minima. The forest is ``TREES`` sorted
   orders of the nodes: order t reads the signature from minimum ``t * DEPTH`` on,
   wrapping round, so nodes with long common prefixes stand next to each other.
   Nodes whose prefixes agree on ``DEPTH`` minima are a region of that order. A pair
   of similarity 0.8 shares no region in any order with probability 3e-6.
3. Orders are cut into even parts wherever they are long, also inside a region.
   Candidates are neighbours with the longest common prefix, and each node with a hub
   of its region: the node nearest to the column-wise consensus takes the nodes close to
   it, and what is left is looked through at the next depth of the prefix, until a
   region has at most ``LEAF`` nodes. A region that spans parts has one hub for all of
   them, the best that its parts name.
4. Candidates are confirmed on the full sets and joined to components.
5. What depth has parted is found again: regions that still hold several components
   take all their close pairs across components, without a cap, as tiles of at most
   ``TILE`` by ``TILE`` nodes. Only nodes outside a region's largest component go to more than
   one tile. The nodes of such pairs bring their full sets to the tile, so rows grow
   with the nodes, and not with the pairs.

"Close" is five standard deviations below the threshold in the bytes of the minima,
so that the estimate loses a true pair of a region with probability below 1e-6.

Words are runs of bytes other than space and \\t to \\r; A-Z are lower-cased. A word's
hash is keyed BLAKE2b; a shingle mixes those of its words in turn.
Results for odd input: null, empty and white texts have an empty set and link
with nothing; a text of fewer words than a shingle is one shingle; repeated rows
are copies of each other; rows may share a key or have none, and are told apart by
their sets; a row with a null key keeps null as its component, unless a row with a key
is in reach. Texts of any length are hashed whole; ties go to the smaller key.
"""

from __future__ import annotations

import hashlib
import math
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, hold, map_rows, read
from .graph import components, smallest

TREES, DEPTH = 24, 4
COLUMNS = TREES * DEPTH
#: Nodes that a region is looked through with at once; a larger one is deepened.
LEAF = 64
#: Nodes on each side of a tile, and rows of an order that a task holds at a time.
TILE, CHUNK = 256, 200_000
#: Ids of candidates that may be broadcast (16 bytes each); beyond it the texts are shuffled to them.
SMALL = 1_000_000
#: Words whose hashes a worker remembers.
WORDS = 300_000

_U = np.uint64
_POWER = 0x9E3779B97F4A7C15
_INVERSE = pow(_POWER, -1, 1 << 64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(33))) * _U(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> _U(33))) * _U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> _U(33))


def _draws(n: int, seed: int) -> np.ndarray:
    return _mix(np.arange(1, n + 1, dtype=_U) * _U(_POWER) + _U(seed))


_PLACE = _draws(64, 2) | _U(1)
_FACTOR = _draws(COLUMNS, 3) | _U(1)


class Words(dict):
    """64-bit keyed hashes of words, remembered up to a bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORDS:
            self.clear()
        h = int.from_bytes(hashlib.blake2b(word, digest_size=8, key=b"shingles").digest(), "little")
        if len(word) <= 64:
            self[word] = h
        return h


_WORDS = Words()


def shingle_hashes(texts: list[str | None], words: int) -> list[np.ndarray]:
    """The sorted distinct 64-bit shingle hashes of each text."""
    hold(__name__, _WORDS.clear)
    data = [(t or "").encode().lower().split() for t in texts]
    ends = np.cumsum([len(d) for d in data]) if data else np.zeros(0, np.int64)
    out = [np.zeros(0, _U)] * len(texts)
    if not len(ends) or not ends[-1]:
        return out
    word = np.fromiter(map(_WORDS.__getitem__, chain.from_iterable(data)), _U, int(ends[-1]))
    with np.errstate(over="ignore"):
        n = max(0, len(word) - words + 1)
        grams = word[:n].copy()
        for k in range(1, words):
            grams = _mix(grams * _PLACE[k]) + word[k : k + n]
        grams = _mix(grams)
        for i, (end, d) in enumerate(zip(ends.tolist(), data)):
            if len(d) >= words:
                out[i] = np.unique(grams[end - len(d) : end - words + 1])
            elif d:
                whole = _U(len(d))
                for h in word[end - len(d) : end]:
                    whole = _mix(np.atleast_1d(whole * _PLACE[40])) + h
                out[i] = _mix(whole ^ _PLACE[41])
    return out


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """Minima of each non-empty set, as rows."""
    flat, starts = np.concatenate(sets), np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]])
    out = np.empty((len(sets), COLUMNS), _U)
    size = 32_768
    step = max(1, len(flat) // size)
    with np.errstate(over="ignore"):
        # blocks of rows that stay in cache
        cuts = np.unique(np.searchsorted(starts, np.linspace(0, len(flat), step + 1)[:-1], side="right") - 1)
        for a, b in zip(cuts, [*cuts[1:], len(sets)]):
            part = flat[starts[a] : starts[b] if b < len(sets) else len(flat)]
            at = starts[a:b] - starts[a]
            for k in range(COLUMNS):
                out[a:b, k] = np.minimum.reduceat(part * _FACTOR[k], at)
    return out


def _batched(texts: list, size: int = 4_000_000):
    at = 0
    while at < len(texts):
        end, n = at, 0
        while end < len(texts) and (n < size or end == at):
            n += len(texts[end] or "")
            end += 1
        yield at, end
        at = end


def _digest(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def _sketch(words: int):
    def make():
        def run(columns):
            ids, marks, texts = columns
            n, digest, keys, sketch = [], [], [], []
            for a, z in _batched(texts):
                sets = shingle_hashes(texts[a:z], words)
                full = [i for i, s in enumerate(sets) if len(s)]
                sig = signatures([sets[i] for i in full]) if full else np.zeros((0, COLUMNS), _U)
                with np.errstate(over="ignore"):
                    # Top bits order the minima; the middle ones are as good as random.
                    key = _mix((_mix(sig).reshape(-1, TREES, DEPTH) * _PLACE[:DEPTH]).sum(2, dtype=_U)).view(np.int64)
                    byte = (_mix(sig) >> _U(20)).astype(np.uint8)
                at = {i: k for k, i in enumerate(full)}
                for i, s in enumerate(sets):
                    n.append(len(s))
                    k = at.get(i)
                    digest.append(None if k is None else _digest(s))
                    keys.append(None if k is None else key[k])
                    sketch.append(None if k is None else byte[k].tobytes())
            return [ids, marks, n, digest, keys, sketch]

        return run

    return make


def _sets(words: int):
    """Sets of the nodes' texts; a text that only shares key and mark with the node's has another digest."""

    def make():
        def run(columns):
            nodes, out = [], []
            for a, z in _batched(columns[2]):
                for node, want, s in zip(columns[0][a:z], columns[1][a:z], shingle_hashes(columns[2][a:z], words)):
                    if _digest(s) == want:
                        nodes.append(node)
                        out.append(s.view(np.int64))
            return [nodes, out]

        return run

    return make


def hub(label: np.ndarray) -> tuple[int, int]:
    """The row nearest to the column-wise consensus (the first of equals), and in how many columns it agrees."""
    width = label.shape[1]
    counts = np.bincount((label + np.arange(width) * 256).ravel(), minlength=256 * width).reshape(-1, 256)
    score = (label == counts.argmax(1)).sum(1)
    return int(score.argmax()), int(score.max())


def candidates(label: np.ndarray, least: int, rest: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Places of candidate pairs among a region's rows, whose labels are sorted and share ``DEPTH`` minima.

    A hub takes what is close to it. Where hubs take little, the rest is parted by the next minimum of
    the label. Neighbours of different hubs are candidates too.
    """
    none = np.zeros(0, np.int64)
    left, right, mine = [none], [none], np.full(len(label), -1)
    stack = [(np.arange(len(label)) if rest is None else rest, DEPTH)]
    while stack:
        rest, depth = stack.pop()
        while len(rest) > 1:
            s = label[rest]
            h = hub(s)[0] if len(rest) > 2 else 0
            close = (s == s[h]).sum(1) >= least
            close[h] = False
            members = rest[close]
            left.append(np.full(len(members), rest[h]))
            right.append(members)
            mine[members] = mine[rest[h]] = rest[h]
            close[h] = True
            little = len(rest) > LEAF and 8 * len(members) < len(rest) and depth < label.shape[1]
            rest = rest[~close]
            if little:
                parts = np.split(rest, np.nonzero(np.diff(label[rest, depth]))[0] + 1)
                stack += [(p, depth + 1) for p in parts if len(p) > 1]
                break
    near = np.nonzero(((label[1:] == label[:-1]).sum(1) >= least) & ((mine[1:] != mine[:-1]) | (mine[1:] < 0)))[0]
    return np.concatenate([*left, near]), np.concatenate([*right, near + 1])


def _fixed(column: pa.Array, width: int = COLUMNS) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, width)


def _regions(batches):
    """Of each chunk of a sorted part: tree, key, node and label, and where its regions begin and end."""
    held, count = [], 0

    def made(held):
        tree, key, node = (np.concatenate([b.column(i).to_numpy() for b in held]) for i in range(3))
        label = np.concatenate([_fixed(b.column(3)) for b in held])
        new = np.nonzero((np.diff(tree) != 0) | (np.diff(key) != 0))[0] + 1
        return tree, key, node, label, np.concatenate([[0], new]), np.concatenate([new, [len(tree)]])

    for b in batches:
        if b.num_rows:
            held.append(b)
            count += b.num_rows
        if count >= CHUNK:
            yield made(held)
            held, count = [], 0
    if held:
        yield made(held)


def _named(batches):
    """The hubs of a chunk's first and last region, which may go on in other chunks."""
    hold(__name__)
    for tree, key, node, label, first, end in _regions(batches):
        at = sorted({0, len(first) - 1})
        best = [hub(label[first[i] : end[i]]) for i in at]
        h = [int(first[i]) + b[0] for i, b in zip(at, best)]
        yield pa.RecordBatch.from_arrays([pa.array(tree[h]), pa.array(key[h]), pa.array([b[1] for b in best], pa.int32()), pa.array(node[h]), pa.array([label[i].tobytes() for i in h], pa.binary())], ["tree", "key", "score", "node", "label"])


def _stars(least: int, hubs: dict[tuple[int, int], tuple[int, bytes]]):
    """Candidate pairs of nodes; ``hubs`` has those of regions that span chunks."""

    def run(batches):
        hold(__name__)
        for tree, key, node, label, first, end in _regions(batches):
            size = end - first
            two = first[size == 2]
            two = two[(label[two] == label[two + 1]).sum(1) >= least]
            left, right = [node[two]], [node[two + 1]]
            for i in np.nonzero((size > 2) | np.isin(np.arange(len(size)), [0, len(size) - 1]))[0]:
                a, z = int(first[i]), int(end[i])
                rest, known = None, hubs.get((int(tree[a]), int(key[a])))
                if known is None and z - a < 3:
                    continue
                if known is not None:
                    close = (label[a:z] == np.frombuffer(known[1], np.uint8)).sum(1) >= least
                    members = node[a:z][close]
                    left.append(np.full(len(members), known[0]))
                    right.append(members)
                    rest = np.nonzero(~close)[0]
                p, q = candidates(label[a:z], least, rest) if rest is None else tuple(rest[x] for x in candidates(label[a:z][rest], least))
                left.append(node[a + p])
                right.append(node[a + q])
            p, q = np.concatenate(left), np.concatenate(right)
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(p, q)), pa.array(np.maximum(p, q))], ["a", "b"])

    return run


def shared_counts(sets: list[np.ndarray], p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of the pairs' sets."""
    if len(p) <= 16 * len(sets):
        return np.array([len(np.intersect1d(sets[i], sets[j], assume_unique=True)) for i, j in zip(p, q)], np.int64)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    names, column, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    often = counts[column] > 1  # what one document has alone is in no intersection
    owner, column = owner[often], np.unique(column[often], return_inverse=True)[1]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    rows, at = np.unique(p, return_inverse=True)
    shared = np.zeros((len(rows), len(sets)), np.float32)
    for c in range(0, int(column.max(initial=-1)) + 1, 4096):
        a, z = np.searchsorted(column, [c, c + 4096])
        part = np.zeros((len(sets), 4096), np.float32)
        part[owner[a:z], column[a:z] - c] = 1
        shared += part[rows] @ part.T
    return shared[at, q].astype(np.int64)


def across(tree: int, node, comp, minor, home, keys, label, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of a tile's close pairs of different components, first met in this tree.

    A row outside the largest component seeks (``home`` false) among the rows at home in the tile; two such
    rows seek each other in two tiles, and the pair counts in one.
    """
    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    at = np.nonzero(home)[0]
    for i in np.nonzero(~home)[0]:
        some = at[(comp[at] != comp[i]) & (~minor[at] | (node[at] > node[i]))]
        some = some[(label[some] == label[i]).sum(1) >= least]
        some = some[(keys[some] == keys[i]).argmax(1) == tree]
        left.append(np.full(len(some), i))
        right.append(some)
    return np.concatenate(left), np.concatenate(right)


PLACE = ("tree", "key", "block", "chunk")


def _tiles(emit, names: list[str]):
    """Run ``emit(place, rows)`` over the rows of each tile, sorted by ``PLACE``; it returns arrays or None."""

    def run(batches):
        hold(__name__)
        last, group, out = None, [], []

        def flush():
            if len(group) > 1 and (made := emit(last, group)) is not None:
                out.append(made)

        for b in batches:
            columns = [c.to_pylist() for c in b.columns[:9]]
            lists = [(c.values.to_numpy(), c.offsets.to_numpy()) for c in b.columns[9:]]
            for i, row in enumerate(zip(*columns)):
                if row[:4] != last:
                    flush()
                    last, group = row[:4], []
                group.append((*row[4:], *[v[o[i] : o[i + 1]] for v, o in lists]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], names)
                out.clear()
        flush()
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], names)

    return run


def _met(place, group, least: int):
    node, comp = (np.array([g[i] for g in group], np.int64) for i in (0, 1))
    minor, home = (np.array([g[i] for g in group], bool) for i in (2, 3))
    label = np.frombuffer(b"".join([g[4] for g in group]), np.uint8).reshape(len(group), -1)
    p, q = across(place[0], node, comp, minor, home, np.array([g[5] for g in group]), label, least)
    return node, home, p, q


def _unsettled(least: int):
    """The rows of a tile that have a pair to confirm there."""

    def emit(place, group):
        node, home, p, q = _met(place, group, least)
        some = np.unique(np.concatenate([p, q]))
        return (*[np.full(len(some), x) for x in place], node[some], home[some]) if len(some) else None

    return _tiles(emit, [*PLACE, "node", "home"])


def _settle(least: int, percent: int):
    """Confirm a tile's pairs on the full sets; its links, as a spanning forest."""
    from .embed import forest

    def emit(place, group):
        node, _, p, q = _met(place, group, least)
        sets = [g[6] for g in group]
        size = np.array([len(s) for s in sets])
        both = shared_counts(sets, p, q)
        ok = both * 100 >= (size[p] + size[q] - both) * percent
        root = forest(len(group), p[ok], q[ok])
        tied = root != np.arange(len(node))
        return (node[root[tied]], node[tied]) if tied.any() else None

    return _tiles(emit, ["a", "b"])


def _spread(rows: DataFrame) -> DataFrame:
    """A row for each order of each node."""
    return rows.select(F.posexplode("keys").alias("tree", "key"), "node").withColumn("tree", F.col("tree").cast("long"))


def _full_sets(docs: DataFrame, nodes: DataFrame, words: int) -> DataFrame:
    """(node, hashes) of the nodes (node, doc_id, mark, digest)."""
    n = nodes.withColumnsRenamed({"doc_id": "__id", "mark": "__mark"})
    n = F.broadcast(n) if n.count() <= SMALL else n
    texts = docs.join(n, docs["doc_id"].eqNullSafe(n["__id"]) & (docs["mark"] == n["__mark"])).select("node", "digest", "text")
    return map_rows(texts, _sets(words), "node long, hashes array<long>").dropDuplicates(["node"])


def _confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose full sets are similar enough."""
    one = sets.select(F.col("node").alias("a"), F.col("hashes").alias("x"))
    two = sets.select(F.col("node").alias("b"), F.col("hashes").alias("y"))
    both = pairs.join(one, "a").join(two, "b")
    shared = F.size(F.array_intersect("x", "y"))
    return both.where(shared * 100 >= (F.size("x") + F.size("y") - shared) * percent).select("a", "b")


def _candidate_pairs(members: DataFrame, rows: DataFrame, least: int) -> DataFrame:
    """Pairs (a, b) of nodes from the sorted orders of ``members`` (tree, key, node), with the sketches of ``rows``."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["tree", "key", "label", "node"]
    turned = F.expr(f"concat(substring(sketch, cast(tree as int) * {DEPTH} + 1), substring(sketch, 1, cast(tree as int) * {DEPTH}))")
    placed = members.join(rows.select("node", "sketch"), "node").select("tree", "key", "node", turned.alias("label"))
    placed = cut(placed.repartitionByRange(n, *order).sortWithinPartitions(*order))
    named = placed.mapInArrow(_named, "tree long, key long, score int, node long, label binary").groupBy("tree", "key")
    named = named.agg(F.count("*").alias("parts"), F.max_by(F.struct("node", "label"), F.struct("score", -F.col("node"))).alias("hub"))
    spanning = named.where("parts > 1").select("tree", "key", "hub.node", "hub.label").collect()  # at most one for each part of an order
    hubs = {(r[0], r[1]): (r[2], bytes(r[3])) for r in spanning}
    return placed.mapInArrow(_stars(least, hubs), "a long, b long").where("a <> b").distinct()


def _rest(docs: DataFrame, reps: DataFrame, members: DataFrame, rows: DataFrame, links: DataFrame, words: int, least: int, percent: int) -> DataFrame:
    """Links (a, b) across the components of ``links`` inside regions that hold several."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    comps = components(links)
    rows = cut(rows.join(comps, "node", "left").select("node", "keys", "sketch", F.coalesce("component", "node").alias("comp")))
    members = members.join(rows.select("node", "comp"), "node")
    sizes = members.groupBy("tree", "key", "comp").agg(F.count("*").alias("n"))
    regions = sizes.groupBy("tree", "key").agg(F.count("*").alias("comps"), F.sum("n").alias("n"), F.max("n").alias("most"), F.max_by("comp", F.struct("n", -F.col("comp"))).alias("main"))
    open_ = cut(regions.where("comps > 1").select("tree", "key", "main", F.ceil(F.col("n") / TILE).alias("blocks"), F.ceil((F.col("n") - F.col("most")) / TILE).alias("chunks")))
    at = members.join(open_, ["tree", "key"])
    mine = lambda seed, parts: F.pmod(F.xxhash64(F.lit(seed), "node"), F.col(parts))
    count = lambda parts: F.sequence(F.lit(0).cast("long"), F.col(parts) - 1)
    home = F.transform(count("chunks"), lambda c: F.struct(mine("block", "blocks").alias("block"), c.alias("chunk"), F.lit(True).alias("home")))
    seek = F.transform(count("blocks"), lambda b: F.struct(b.alias("block"), mine("chunk", "chunks").alias("chunk"), F.lit(False).alias("home")))
    minor = F.col("comp") != F.col("main")
    at = at.select("tree", "key", "node", "comp", minor.alias("minor"), F.explode(F.when(minor, F.concat(home, seek)).otherwise(home)).alias("p"))
    at = cut(at.select("tree", "key", "p.*", "node", "comp", "minor"))

    def dealt(tiles: DataFrame, *more: str) -> DataFrame:
        return tiles.repartition(n, *PLACE).sortWithinPartitions(*PLACE, "node").select(*PLACE, "node", "comp", "minor", "home", "sketch", "keys", *more)

    whole = at.join(rows.select("node", "sketch", "keys"), "node")
    met = dealt(whole).mapInArrow(_unsettled(least), "tree long, key long, block long, chunk long, node long, home boolean")
    met = cut(met.join(at, [*PLACE, "node", "home"]))
    nodes = met.select("node").distinct().join(reps.select("node", "doc_id", "mark", "digest"), "node")
    sets = cut(_full_sets(docs, nodes, words))
    return dealt(met.join(rows.select("node", "sketch", "keys"), "node").join(sets, "node"), "hashes").mapInArrow(_settle(least, percent), "a long, b long")


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id, kept. Keys must be whole numbers."""
    t = percent / 100
    least = math.ceil(COLUMNS * (t - 5 * math.sqrt(t * (1 - t) / COLUMNS)))
    docs = docs.select(F.col(key).cast("long").alias("doc_id"), F.xxhash64(F.col(text)).alias("mark"), F.col(text).alias("text"))
    seen = cut(map_rows(docs, _sketch(words), "doc_id long, mark long, n_shingles long, digest binary, keys array<long>, sketch binary"))
    first = F.struct(F.col("doc_id").isNull(), "doc_id", "mark")
    reps = seen.where("digest is not null").groupBy("digest").agg(F.min_by(F.struct("keys", "sketch"), first).alias("s"), F.min(first).alias("f"))
    reps = cut(reps.select(F.monotonically_increasing_id().alias("node"), "digest", "f.doc_id", "f.mark", "s.keys", "s.sketch"))
    spread = _spread(reps)
    shared = spread.groupBy("tree", "key").count().where("count > 1").select("tree", "key")
    members = cut(spread.join(shared, ["tree", "key"]).select("tree", "key", "node"))
    rows = cut(reps.join(members.select("node").distinct(), "node").select("node", "keys", "sketch"))
    pairs = cut(_candidate_pairs(members, rows, least))
    nodes = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    sets = cut(_full_sets(docs, nodes.join(reps.select("node", "doc_id", "mark", "digest"), "node"), words))
    links = cut(_confirm(pairs, sets, percent))
    links = links.union(_rest(docs, reps, members, rows, links, words, least, percent))
    found = smallest(links, reps.select("node", F.col("doc_id").alias("id")))
    named = reps.join(found, "node", "left").select("digest", F.coalesce("component_id", "doc_id").alias("component_id"))
    out = seen.select("doc_id", "n_shingles", "digest").join(named, "digest", "left")
    component = F.coalesce("component_id", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), component.eqNullSafe(F.col("doc_id")).alias("kept"))


def op8_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"), words=4)
