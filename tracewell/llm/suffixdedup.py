"""Repeated passages by a column-wise suffix order (operator 6).

A byte goes if a 200-byte string over it also starts elsewhere in the corpus.

1. Each 200-byte window picks its smallest 100-byte gram by hash (the leftmost of
   equals). Equal windows pick equal grams at equal places, so windows can only
   meet inside the group of one gram. Grams that occur once drop out. Windows next
   to each other that pick the same gram form a segment of at most 101 windows.
2. Equal segments of a group fold, keeping how many there were. A group with one
   content that was there at least twice is repeated throughout.
3. The other groups go through the multi-document transform: in round j the symbol
   at distance j from the end of every segment enters the Burrows-Wheeler string,
   and with it the suffix of length j enters the order and its common prefixes with
   both neighbours are derived from those of the round before. The gram that all
   segments of a group share counts as one symbol, so 200 bytes are 101 symbols.
   Suffixes that share 101 symbols, in one group, are repeated windows.
   Groups of more than ``GROUP`` contents are first cut into pieces and dealt by
   the text around the gram, and at the edges of passages, where pieces still
   share all that, their windows are counted one by one.
4. Repeated windows go back to the documents that hold their segments.

The string, the order and the common prefixes are rewritten front to back in each
round; a batch of whole groups holds about ``BATCH`` symbols, so they stay in
memory instead of in files. Texts are worked through in blocks of ``SPAN`` windows.

Results for odd input: null and empty texts and texts under 200 bytes lose
nothing; repeated rows are copies of each other, and each loses its passages;
rows with null keys are told apart by their texts.
"""

from __future__ import annotations

import hashlib
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, hold, map_rows, read, shared_folder
from .minhash import _INVERSE, _POWER, _draws, _mix

LENGTH, GRAM = 200, 100
WINDOW = LENGTH - GRAM + 1
SPAN, BATCH = 1 << 19, 3_000_000
#: List elements and single numbers that may be broadcast, by their counted number; beyond it both sides are shuffled.
SMALL, SMALL_IDS = 500_000, 2_000_000
ANCHOR = 0xFF  # no byte of UTF-8
#: Contents of a group that one task transforms; larger groups are dealt by the text around the gram, ``PIECE`` windows at a time.
GROUP, PIECE = 1024, 16

_U = np.uint64
_VALUE = _draws(256, 11)
_TABLES: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _TABLES or len(_TABLES[0]) < n + 1:
        size = max(n + 1, 1 << 16)
        made = []
        for base in (_POWER, _INVERSE):
            p = np.full(size, base, _U)
            p[0] = 1
            with np.errstate(over="ignore"):
                np.multiply.accumulate(p, out=p)
            made.append(p)
        _TABLES[:] = made
    return _TABLES[0], _TABLES[1]


def segments(data: bytes):
    """Arrays (start, windows, anchor, gram, content) of a text's segments."""
    for base in range(0, max(0, len(data) - LENGTH + 1), SPAN):
        raw = np.frombuffer(data[base : base + SPAN + LENGTH - 1], np.uint8)
        n = len(raw)
        power, back = _powers(n)
        with np.errstate(over="ignore"):
            sums = np.zeros(n + 1, _U)
            np.cumsum(_VALUE[raw] * power[:n], dtype=_U, out=sums[1:])
            grams = _mix((sums[GRAM:] - sums[:-GRAM]) * back[: n - GRAM + 1])
            low = (grams & ~_U((1 << 20) - 1)) | np.arange(len(grams), dtype=_U)
            best, size = low, 1
            while size * 2 <= WINDOW:
                best = np.minimum(best[: len(best) - size], best[size:])
                size *= 2
            count = n - LENGTH + 1
            best = np.minimum(best[:count], best[WINDOW - size : WINDOW - size + count])
            at = (best & _U((1 << 20) - 1)).astype(np.int64)
            first = np.concatenate([[0], np.nonzero(np.diff(at))[0] + 1])
            end = np.concatenate([first[1:], [count]])
            anchor = at[first]
            content = _mix((sums[end + LENGTH - 1] - sums[first]) * back[first] + _mix(((end - first) * 1024 + anchor - first).astype(_U)))
        yield base + first, end - first, base + anchor, grams[anchor].view(np.int64), content.view(np.int64)


def _grams(batches):
    hold(__name__)
    for b in batches:
        found = [s[3] for t in b.column(0).to_pylist() if t for s in segments(t.encode())]
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found))], ["gram"])


def _runs(batches):
    hold(__name__)
    for b in batches:
        ids, marks, texts = b.column(0), b.column(1), b.column(2).to_pylist()
        row, parts = [], []
        for i, t in enumerate(texts):
            for s in segments(t.encode()) if t else ():
                row.append(np.full(len(s[0]), i))
                parts.append(s)
        if parts:
            take = pa.array(np.concatenate(row))
            cols = [pa.array(np.concatenate(c)) for c in zip(*parts)]
            cols = [cols[0], cols[1].cast(pa.int32()), pa.array(np.concatenate([p[2] - p[0] for p in parts])).cast(pa.int32()), cols[3], cols[4]]
            yield pa.RecordBatch.from_arrays([ids.take(take), marks.take(take), *cols], ["doc_id", "mark", "start", "n", "anchor", "gram", "content"])


class Order:
    """The order of all suffixes so far: for each the symbol before it (0: none yet), the
    common prefix with the one above, and its name (segment * 256 + length)."""

    STEP = 32

    def __init__(self, count: int):
        self.before = np.zeros(count, np.uint8)
        self.common = np.zeros(count, np.uint8)
        self.name = np.arange(count, dtype=np.int32) << 8
        self.count = count
        self.held = np.zeros(256, np.int64)

    def _tables(self):
        at = np.arange(0, len(self.common), self.STEP)
        level = [np.minimum.reduceat(self.common, at)]
        while len(level[-1]) > 1 << (len(level) - 1):
            step = 1 << (len(level) - 1)
            level.append(np.minimum(level[-1][:-step], level[-1][step:]))
        return level

    def _least(self, a: np.ndarray, b: np.ndarray, level) -> np.ndarray:
        """Smallest common prefix in [a, b], elementwise."""
        steps, c = np.arange(self.STEP), self.common
        out = c[np.minimum(a[:, None] + steps, b[:, None])].min(1)
        far = np.nonzero(b - a >= self.STEP)[0]
        if len(far):
            fa, fb = a[far], b[far]
            out[far] = np.minimum(out[far], c[np.maximum(fb[:, None] - steps, fa[:, None])].min(1))
            p, q = fa // self.STEP + 1, fb // self.STEP - 1
            deep = np.nonzero(q >= p)[0]
            if len(deep):
                p, q = p[deep], q[deep]
                k = np.log2(q - p + 1).astype(np.int64)
                low = np.empty(len(p), np.uint8)
                for depth in np.unique(k):
                    m = k == depth
                    low[m] = np.minimum(level[depth][p[m]], level[depth][q[m] - (1 << depth) + 1])
                out[far[deep]] = np.minimum(out[far[deep]], low)
        return out

    def insert(self, places: np.ndarray, symbols: np.ndarray, length: int, owners: np.ndarray) -> np.ndarray:
        """Put ``symbols`` before the suffixes at ``places``; the new suffixes' places."""
        self.before[places] = symbols
        order = np.argsort(self.before, kind="stable")
        self.held += np.bincount(symbols, minlength=256)
        self.held[0] = len(self.before) - self.held[1:].sum()
        bounds = np.concatenate([[0], np.cumsum(self.held)])
        by = np.argsort(symbols, kind="stable")
        t = np.empty(len(places), np.int64)
        cuts = np.searchsorted(symbols[by], np.arange(257))
        for c in np.nonzero(np.diff(cuts))[0]:
            mine = by[cuts[c] : cuts[c + 1]]
            t[mine] = bounds[c] + np.searchsorted(order[bounds[c] : bounds[c + 1]], places[mine])
        level = self._tables()
        lo, hi = bounds[symbols], bounds[symbols.astype(np.int64) + 1]
        above, below = np.zeros(len(t), np.uint8), np.zeros(len(t), np.uint8)
        m = t > lo
        above[m] = 1 + self._least(order[t[m] - 1] + 1, places[m], level)
        m = t + 1 < hi
        below[m] = 1 + self._least(places[m] + 1, order[t[m] + 1], level)
        new = self.count + t - bounds[1]
        size = len(self.before) + len(new)
        old = np.ones(size, bool)
        old[new] = False
        for field, values in (("before", 0), ("common", above), ("name", owners << 8 | length)):
            array = np.empty(size, getattr(self, field).dtype)
            array[old] = getattr(self, field)
            array[new] = values
            setattr(self, field, array)
        m = t + 1 < hi
        self.common[new[m] + 1] = below[m]
        return new


def repeated(parts: list[bytes], group: np.ndarray, copies: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """(part, first symbol) of each window of the parts that occurs more than once in its group."""
    length = np.array([len(p) for p in parts])
    rank = np.argsort(-length, kind="stable")
    text, end = np.frombuffer(b"".join(parts), np.uint8), np.cumsum(length)
    active = np.searchsorted(-length[rank], -np.arange(1, int(length.max()) + 1), side="right")
    order, places = Order(len(parts)), np.arange(len(parts))  # of the parts in the order of rank
    for j, n in enumerate(active.tolist(), 1):
        owners = rank[:n]
        places = order.insert(places[:n], text[end[owners] - j], j, owners)
    part, size = order.name >> 8, order.name & 255
    run = np.cumsum(order.common < window)
    whole = np.nonzero(size >= window)[0]
    part, size, run = part[whole], size[whole], run[whole]
    by = np.lexsort((group[part], run))
    part, size, run = part[by], size[by], run[by]
    new = np.concatenate([[True], (np.diff(run) != 0) | (np.diff(group[part]) != 0)]) if len(run) else np.zeros(0, bool)
    which = np.cumsum(new) - 1
    many = np.bincount(which, copies[part])[which] > 1.5 if len(which) else new
    return part[many], length[part[many]] - size[many]


def spans(at: np.ndarray) -> list[dict]:
    """Byte runs covered by windows at sorted positions."""
    gap = np.nonzero(np.diff(at) > LENGTH)[0]
    first, last = np.concatenate([at[:1], at[gap + 1]]), np.concatenate([at[gap], at[-1:]])
    return [{"a": int(a), "b": int(b) + LENGTH} for a, b in zip(first, last)]


SPANS = "array<struct<a:int,b:int>>"


def _transform(batches):
    """Over (gram, content, copies, part) sorted by gram: spans of each content."""
    kind = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))
    rows, size = [], 0

    def work(rows):
        if not rows:
            return None
        grams = np.array([r[0] for r in rows])
        part, at = repeated([r[3] for r in rows], np.unique(grams, return_inverse=True)[1], np.array([r[2] for r in rows]))
        by = np.lexsort((at, part))
        part, at = part[by], at[by]
        which, first = np.unique(part, return_index=True)
        found = [spans(x) for x in np.split(at, first[1:])] if len(which) else []
        return pa.RecordBatch.from_arrays([pa.array([rows[i][0] for i in which], pa.int64()), pa.array([rows[i][1] for i in which], pa.int64()), pa.array(found, kind)], ["gram", "content", "spans"])

    last = None
    for b in batches:
        for row in zip(*(c.to_pylist() for c in b.columns)):
            if last is not None and row[:2] == last[:2]:
                continue  # the content of a repeated row, fetched again
            if size > BATCH and row[0] != last[0]:
                yield work(rows)
                rows, size = [], 0
            rows.append(row)
            size += len(row[3])
            last = row
    if rows:
        yield work(rows)


def _fetch(columns):
    wanted, texts = columns
    gram, content, copies, part = [], [], [], []
    for want, text in zip(wanted, texts):
        data = text.encode()
        for w in want:
            a, z, g = w["start"], w["start"] + w["n"] + LENGTH - 1, w["start"] + w["anchor"]
            gram.append(w["gram"])
            content.append(w["content"])
            copies.append(w["copies"])
            part.append(data[a:g] + bytes([ANCHOR]) + data[g + GRAM : z])
    return [gram, content, copies, part]


def _key(*parts: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(b"".join(parts), digest_size=8).digest(), "little", signed=True)


def _pieces(columns):
    """Segments of large groups in pieces of windows that lie alike to the gram.

    What all windows of a piece share, around the gram, becomes part of the group:
    windows that differ there can't be equal.
    """
    out = [[] for _ in range(7)]
    for gram, content, copies, part in zip(*_fetch(columns)):
        anchor, n = part.index(ANCHOR), len(part) - WINDOW + 1
        for k in range((anchor - n + 1) // PIECE, anchor // PIECE + 1):
            last = anchor - PIECE * k
            a, z = max(0, last - PIECE + 1), min(n - 1, last)
            if a <= z:
                piece, core = part[a : z + WINDOW], part[last : last + WINDOW - PIECE + 1]
                row = (_key(gram.to_bytes(8, "little", signed=True), bytes([k]), core), _key(piece), copies, piece, gram, content, a)
                for column, value in zip(out, row):
                    column.append(value)
    return out


def _singles(columns):
    """A row for each window of a piece: group, item, place, copies and 128 bits of its hash.

    The gram is one symbol in a piece, so the group, which depends on it, is hashed too.
    """
    out = [[] for _ in range(6)]
    for group, item, copies, piece in zip(*columns):
        g = group.to_bytes(8, "little", signed=True)
        for i in range(len(piece) - WINDOW + 1):
            w = piece[i : i + WINDOW]
            for column, value in zip(out, (group, item, i, copies, _key(b"1", g, w), _key(b"2", g, w))):
                column.append(value)
    return out


def _large_groups(parts: DataFrame) -> DataFrame:
    """(gram, content, spans) of the segments that ``_pieces`` cut; the same work, on smaller groups.

    Equal pieces fold. Groups of pieces that are still large are those cut by the
    edge of a passage; their windows are counted one by one.
    """
    parts = cut(parts.dropDuplicates(["gram", "content", "at"]))  # repeated rows are fetched as often as they stand there
    folded = parts.groupBy("group", "item").agg(F.sum("copies").alias("copies"), F.first("part").alias("part"))
    folded = cut(folded.join(folded.groupBy("group").agg(F.count("*").alias("size")), "group"))
    windows = F.octet_length("part") - (WINDOW - 1)
    alone = folded.where("size = 1 and copies > 1").select("group", "item", F.array(F.struct(F.lit(0).alias("a"), (windows + LENGTH - 1).cast("int").alias("b"))).cast(SPANS).alias("spans"))
    n = int(parts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    some = folded.where((F.col("size") > 1) & (F.col("size") <= GROUP)).select("group", "item", "copies", "part")
    some = some.repartition(n, "group").sortWithinPartitions("group", "item").mapInArrow(_transform, f"gram long, content long, spans {SPANS}").toDF("group", "item", "spans")
    single = cut(map_rows(folded.where(F.col("size") > GROUP).select("group", "item", "copies", "part"), lambda: _singles, "group long, item long, at int, copies long, one long, two long"))
    many = single.groupBy("one", "two").agg(F.sum("copies").alias("c")).where("c > 1").select("one", "two")
    found = single.join(many, ["one", "two"], "left_semi").groupBy("group", "item").agg(F.transform(F.array_sort(F.collect_list("at")), lambda i: F.struct(i.alias("a"), (i + LENGTH).alias("b"))).cast(SPANS).alias("spans"))
    told = alone.unionByName(some).unionByName(found)
    moved = F.transform("spans", lambda s: F.struct((s["a"] + F.col("at")).alias("a"), (s["b"] + F.col("at")).alias("b")))
    return parts.select("group", "item", "gram", "content", "at").join(told, ["group", "item"]).select("gram", "content", moved.cast(SPANS).alias("spans"))


def _merge(batches):
    """Runs (start, spans) of each document to the flat list of their union's bounds."""
    for batch in batches:
        runs = batch.column(2)
        spans_ = runs.values.field("spans")
        size = np.diff(spans_.offsets.to_numpy())
        doc = np.repeat(np.repeat(np.arange(len(runs)), np.diff(runs.offsets.to_numpy())), size)
        at = np.repeat(runs.values.field("start").to_numpy(), size) + (doc << 40)
        first = spans_.offsets[0].as_py() if len(spans_) else 0
        a, b = (at + spans_.values.field(k).to_numpy()[first : first + len(at)] for k in ("a", "b"))
        order = np.argsort(a, kind="stable")
        a, b = a[order], np.maximum.accumulate(b[order])
        new = np.nonzero(np.concatenate([[True], a[1:] > b[:-1]]))[0] if len(a) else np.zeros(0, np.int64)
        ends = np.concatenate([new[1:], [len(a)]]) - 1 if len(new) else new
        flat = np.stack([a[new], b[ends]], 1)
        count = np.bincount(flat[:, 0] >> 40, minlength=len(runs))
        bounds = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(2 * count)]), pa.int32()), pa.array((flat & ((1 << 40) - 1)).ravel(), pa.int64()))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), bounds], ["doc_id", "mark", "runs"])


def _cut_out(columns):
    ids, texts, found = columns
    out = [[], [], [], []]
    for text, flat in zip(texts, found):
        data = (text or "").encode()
        kept, removed, count, at = hashlib.sha256(), 0, 0, 0
        for a, b in zip((flat or ())[::2], (flat or ())[1::2]):
            kept.update(data[at:a])
            removed, count, at = removed + b - a, count + 1, b
        kept.update(data[at:])
        for column, value in zip(out, (len(data), removed, count, kept.hexdigest())):
            column.append(value)
    return [ids, *out]


def _joined(docs: DataFrame, other: DataFrame, how: str, most: int = 0) -> DataFrame:
    """Join on the row's identity; the other side has a row with a list for each document,
    and is broadcast if the lists have at most ``most`` elements in all."""
    other = other.withColumnsRenamed({"doc_id": "__id", "mark": "__mark"})
    small = most > 0 and (other.agg(F.sum(F.size(other.columns[-1]))).first()[0] or 0) <= most
    return docs.join(F.broadcast(other) if small else other, docs["doc_id"].eqNullSafe(other["__id"]) & docs["mark"].eqNullSafe(other["__mark"]), how)


def repeats(docs: DataFrame, key: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """The documents (doc_id, mark, text) and, for each that loses something, the flat list of its runs' bounds."""
    spark = docs.sparkSession
    kind = docs.schema[key].dataType.simpleString()
    docs = docs.select(F.col(key).alias("doc_id"), F.xxhash64(F.col(text)).alias("mark"), F.col(text).alias("text"))
    grams = docs.select("text").mapInArrow(_grams, "gram long").groupBy("gram").count().where("count > 1").select("gram")
    grams = cut(grams)
    small = grams.count() <= SMALL_IDS
    runs = docs.mapInArrow(_runs, f"doc_id {kind}, mark long, start long, n int, anchor int, gram long, content long")
    runs = runs.join(F.broadcast(grams) if small else grams, "gram", "left_semi")
    folder = f"{shared_folder(spark)}/repeats-{uuid.uuid4().hex}"
    runs.write.parquet(folder)
    runs = spark.read.parquet(folder)
    place = F.struct("doc_id", "mark", "start", "n", "anchor")
    folded = runs.groupBy("gram", "content").agg(F.count("*").alias("copies"), F.min(place).alias("one"))
    folded = cut(folded.select("gram", "content", "copies", "one.*"))
    several = cut(folded.groupBy("gram").agg(F.count("*").alias("size")).where("size > 1"))
    open_ = folded.join(several, "gram")
    whole = folded.where("copies > 1").join(several, "gram", "left_anti")
    whole = whole.select("gram", "content", F.array(F.struct(F.lit(0).alias("a"), (F.col("n") + LENGTH - 1).cast("int").alias("b"))).cast(SPANS).alias("spans"))
    item = F.struct("gram", "content", "copies", "start", "n", "anchor")
    listed = lambda large: F.collect_list(F.when((F.col("size") > GROUP) == F.lit(large), item))
    want = cut(open_.groupBy("doc_id", "mark").agg(listed(False).alias("want"), listed(True).alias("large")))
    texts = lambda c: _joined(docs, want.where(F.size(c) > 0).select("doc_id", "mark", c), "inner", SMALL if c == "large" else 0).select(c, "text")
    parts = map_rows(texts("want"), lambda: _fetch, "gram long, content long, copies long, part binary")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    told = parts.repartition(n, "gram").sortWithinPartitions("gram", "content").mapInArrow(_transform, f"gram long, content long, spans {SPANS}")
    told = told.union(whole)
    if not several.where(F.col("size") > GROUP).isEmpty():
        pieces = map_rows(texts("large"), lambda: _pieces, "group long, item long, copies long, part binary, gram long, content long, at int")
        told = told.union(_large_groups(pieces))
    told = cut(told)
    hits = runs.join(told, ["gram", "content"]).groupBy("doc_id", "mark").agg(F.collect_list(F.struct("start", "spans")).alias("runs"))
    return docs, cut(hits.mapInArrow(_merge, f"doc_id {kind}, mark long, runs array<long>"))


def op6_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, hits = repeats(read(spark, sf_dir, "documents").select("doc_id", "text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    both = _joined(docs, hits, "left", SMALL).select("doc_id", "text", "runs")
    return map_rows(both, lambda: _cut_out, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
