"""Media, repeats, mixing, near duplicates, sharding, vectors and the pipeline."""

import collections
import hashlib
import math
import random
import re
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracewell.llm import common, embed, graph, media, minhash, mixing, sharding, suffixdedup

SF = "/root/testdata/sf0.001"


# ---- media


def test_tables_are_g711():
    assert media.MULAW_TABLE[[0x00, 0x80, 0x7F, 0xFF, 0xEF]].tolist() == [-32124, 32124, 0, 0, 132]
    assert media.ALAW_TABLE[[0x55, 0xD5, 0x2A, 0xAA]].tolist() == [-8, 8, -32256, 32256]
    assert len(set(media.ALAW_TABLE.tolist())) == 256


def test_adpcm_against_a_scalar_decoder():
    data = np.random.default_rng(1).integers(0, 256, 3 * 64 + 10).astype(np.uint8).tobytes()
    steps, want = media.ima_steps().tolist(), []
    for b in range(3):
        block = data[b * 64 : b * 64 + 64]
        value, index = int.from_bytes(block[:2], "little", signed=True), min(block[2], 88)
        want.append(value)
        for byte in block[4:]:
            for n in (byte & 15, byte >> 4):
                s = steps[index]
                diff = (s >> 3) + (s if n & 4 else 0) + (s >> 1 if n & 2 else 0) + (s >> 2 if n & 1 else 0)
                value = max(-32768, min(32767, value - diff if n & 8 else value + diff))
                index = max(0, min(88, index + int(media.MOVES[n])))
                want.append(value)
    assert media.ima_decode(data, 64).tolist() == want
    pcm, rate = media.samples(media.wave(data[:192], media.IMA, 8000, 64, 4))
    assert pcm.tolist() == want and rate == 8000


def test_waves_and_resampling():
    pcm = np.array([0, 100, -100], np.int16)
    assert media.samples(media.wave(pcm.tobytes(), media.PCM, 8000, 2, 16))[0].tolist() == pcm.tolist()
    assert media.resample(pcm, 8000, 16000).tolist() == [0, 50, 100, 0, -100, -100] and media.resample(pcm, 8000, 8000) is pcm
    assert len(media.resample(np.zeros(80, np.int16), 8000, 11025)) == 110
    with pytest.raises(ValueError):
        media.parse(b"no file")
    with pytest.raises(ValueError):
        media.parse(media.wave(b"")[:30])


def test_media_query(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").toPandas()
    got = media.op5_media(spark, SF).toPandas().set_index("doc_id")
    for i, t in zip(docs.doc_id, docs.text):
        p = t.encode()
        p += b" " * (-len(p) % 192 or (0 if p else 192))
        r = got.loc[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(t.encode()), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:]))
    assert media.digest_row(None)[:2] == (0, 192) and media.digest_row("")[2] == media.digest_row(None)[2]
    both = media.media_column(spark.createDataFrame([(1, "x", b"m"), (2, None, None)], "doc_id long, text string, media binary")).collect()
    assert media.samples(bytes(both[0]["pcm"]))[1] == 16000


def test_short_blocks_and_channels():
    data = np.random.default_rng(2).integers(0, 256, 2 * 64 + 10).astype(np.uint8).tobytes()
    pcm, _ = media.samples(media.wave(data, media.IMA, 8000, 64, 4))
    assert pcm.tolist() == media.ima_decode(data, 64).tolist() + media.ima_decode(data[128:], 10).tolist() and len(pcm) == 2 * 121 + 13
    with pytest.raises(ValueError):
        media.samples(media.wave(data[:130], media.IMA, 8000, 64, 4))
    two = bytearray(media.wave(b"abcd", media.PCM, 8000, 4, 16))
    two[22] = 2
    with pytest.raises(ValueError):
        media.samples(bytes(two))


def test_media_query_reads_the_stored_columns(spark, monkeypatch):
    made, plain = [], media.media_column
    monkeypatch.setattr(media, "media_column", lambda *a, **k: made.append(plain(*a, **k)) or made[0])
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    got = {x.doc_id: tuple(x)[1:] for x in media.op5_media(spark, SF).collect()}
    assert made and got == {i: media.digest_row(t) for i, t in docs}


# ---- repeats


def plain_repeats(texts, n=200):
    data = [(t or "").encode() for t in texts]
    seen = collections.Counter(d[i : i + n] for d in data for i in range(len(d) - n + 1))
    out = []
    for d in data:
        gone = np.zeros(len(d), bool)
        for i in range(len(d) - n + 1):
            if seen[d[i : i + n]] > 1:
                gone[i : i + n] = True
        runs = int((np.diff(np.concatenate([[0], gone.astype(np.int8)])) == 1).sum())
        out.append((len(d), int(gone.sum()), runs, hashlib.sha256(bytes(np.frombuffer(d, np.uint8)[~gone])).hexdigest()))
    return out


def run_repeats(spark, tmp_path, texts, ids=None):
    folder = f"{tmp_path}/{random.random()}"
    rows = [(i, t) for i, t in zip(ids or range(len(texts)), texts)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(f"{folder}/documents.parquet")
    return suffixdedup.op6_repeats(spark, folder).collect()


@pytest.mark.parametrize("group", [1024, 2])
def test_repeats_against_counting(spark, tmp_path, monkeypatch, group):
    """Also with the way for large groups."""
    monkeypatch.setattr(suffixdedup, "GROUP", group)
    r = random.Random(8)
    word = lambda: "".join(r.choice("abcdéß ") for _ in range(r.randrange(2, 9)))
    passage = [" ".join(word() for _ in range(60)) for _ in range(4)]
    noise = lambda n: " ".join(word() for _ in range(n))
    texts = [None, "", "a" * 199, "a" * 200, "a" * 201, "ab" * 300, "é" * 150, passage[0], passage[0], passage[1][:250], passage[1][:230] + "x"]
    texts += [noise(r.randrange(30)) + r.choice(passage)[r.randrange(80) :][: r.randrange(150, 400)] + noise(r.randrange(30)) for _ in range(60)]
    texts += [noise(20) + passage[2] + noise(20) + passage[2]]
    got = {x["doc_id"]: tuple(x)[1:] for x in run_repeats(spark, tmp_path, texts)}
    assert [got[i] for i in range(len(texts))] == plain_repeats(texts)


def test_repeats_of_repeated_rows(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(suffixdedup, "GROUP", 1)
    p = "".join(chr(97 + i * 7 % 26) + str(i) for i in range(150))
    texts = [p[:260], p[:260], "0" + p[30:270], "1" + p[60:260] + "z"]
    got = run_repeats(spark, tmp_path, texts, [1, 1, 2, 3])
    assert sorted(tuple(x)[1:] for x in got) == sorted(plain_repeats(texts))


def test_repeats_of_variants_that_differ_in_the_gram(spark, tmp_path, monkeypatch):
    """Windows of large groups that are equal around their grams, and only there, are no repeats."""
    monkeypatch.setattr(suffixdedup, "GROUP", 2)
    r = random.Random(14)
    letters = lambda n: "".join(r.choice("abcdefghijklmnop") for _ in range(n))
    edges, head, tail = ["xyz", "yzx", "zxy", "xzw"], letters(40), letters(100)
    picked = lambda t: [s[2].tolist() for s in suffixdedup.segments(t.encode())] == [[43]]
    variants = []
    while len(variants) < 2:
        t = head + letters(100) + tail
        variants += [t] if all(picked(e + t) for e in edges) else []
    texts = [e + t for t in variants for e in edges]
    got = {x["doc_id"]: tuple(x)[1:] for x in run_repeats(spark, tmp_path, texts)}
    assert [got[i] for i in range(len(texts))] == plain_repeats(texts)
    assert {got[i][1] for i in got} == {240}


def test_repeats_without_keys(spark, tmp_path):
    p = "".join(chr(97 + i * 7 % 26) + str(i) for i in range(150))
    got = run_repeats(spark, tmp_path, [p, p, "other", None], [None, None, None, None])
    assert sorted(x["n_removed"] for x in got) == [0, 0, len(p), len(p)]
    assert run_repeats(spark, tmp_path, []) == []


def test_transform_orders_like_sorting():
    r = random.Random(9)
    parts = [bytes(r.choice(b"ab") for _ in range(r.randrange(3, 12))) for _ in range(40)]
    part, at = suffixdedup.repeated(parts, np.zeros(40, np.int64), np.ones(40, np.int64), 4)
    seen = collections.Counter(p[i : i + 4] for p in parts for i in range(len(p) - 3))
    assert set(zip(part.tolist(), at.tolist())) == {(k, i) for k, p in enumerate(parts) for i in range(len(p) - 3) if seen[p[i : i + 4]] > 1}


# ---- mixing


def test_targets(spark):
    def goals(rows):
        return {r["source"]: r["target"] for r in mixing.targets(spark.createDataFrame(rows, "source string, source_size long, weight double")).collect()}

    assert goals([("a", 100, 1.0), ("b", 100, 3.0)]) == {"a": 50.0, "b": 150.0}
    assert goals([("a", 10, 9.0), ("b", 90, 1.0), ("z", 0, 5.0)]) == {"a": 30.0, "b": 70.0, "z": 0.0} and goals([]) == {}
    assert goals([("a", 1, 50.0), ("b", 10, 40.0), ("c", 1000, 1.0), (None, 0, 1.0)]) == {"a": 3.0, "b": 30.0, "c": 978.0, None: 0.0}
    got = mixing.cycle_weights(spark.createDataFrame([(x,) for x in ("b", None, "a", "B", "é")], "source string")).collect()
    assert {r["source"]: r["weight"] for r in got} == {"B": 1, "a": 2, "b": 3, "é": 1, None: 2}


def test_mixing_query(spark):
    got = mixing.op7_mixing(spark, SF)
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "source", "text").toPandas()
    x = got.toPandas().merge(docs, on="doc_id")
    assert (x["size"] == [len(re.findall(r"[^\x20\x09-\x0D]+", t)) for t in x.text]).all()
    assert abs(x.groupby("source").target.first().sum() - x["size"].sum()) < 1e-6 * x["size"].sum()
    sums = x.groupby("source").agg(size=("size", "sum"), said=("source_size", "first"), target=("target", "first"), taken=("taken", "sum"), most=("size", "max"))
    assert (sums["size"] == sums.said).all() and (sums.target <= 3 * sums["size"] + 1e-6).all() and ((sums.taken - sums.target).abs() <= sums.most + 1).all()
    assert (x.taken <= 3 * x["size"]).all()
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, mixing.op7_mixing(spark, SF).collect()))
    want = {}
    for source, g in x.groupby("source", dropna=False):
        name = "" if source != source or source is None else source
        draw = lambda *parts, n=13: int(hashlib.md5("".join(f"{p}|" for p in ("7", *parts)).encode()).hexdigest()[:n], 16)
        rate, at = g.target.iloc[0] / g.source_size.iloc[0], draw("offset", name) * 2.0**-52
        for size, _, i in sorted((s, draw(i, n=15), i) for s, i in zip(g["size"], g.doc_id)):  # one prefix sum, in order
            want[i], at = (math.floor(at + rate) - math.floor(at)) * size, at + rate
    assert sum(want[i] != t for i, t in zip(x.doc_id, x.taken)) <= 2  # a boundary may fall into a sum's rounding


def test_mixing_odd_rows(spark):
    rows = [(1, None, "a b"), (1, None, "a b"), (None, "s", None), (2, "s", ""), (3, "t", "x " * 50_000)]
    got = mixing.mix(spark.createDataFrame([(*r, 5) for r in rows], "doc_id long, source string, text string, nth int"))
    assert got.count() == 5 and got.where("source = 's'").agg(F.sum("copies")).first()[0] == 0
    assert mixing.mix(spark.createDataFrame([], "doc_id long, source string, text string")).count() == 0


# ---- near duplicates


def word_sets(texts, n):
    low = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
    out = []
    for t in texts:
        w = re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().translate(low))
        out.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set())
    return out


def plain_components(n, linked):
    root = list(range(n))
    while True:
        new = [min([root[i], *(root[j] for j in range(n) if linked(i, j))]) for i in range(n)]
        if new == root:
            return root
        root = new


@pytest.mark.parametrize("words", [4, 5])
def test_near_duplicates_against_all_pairs(spark, words):
    r = random.Random(words)
    pool = ["".join(r.choice("abcdefgh") for _ in range(5)) for _ in range(3000)]
    texts = [None, "", " \t", "One", "one", "one two", "two one", "Ä b", "ä b"]
    for _ in range(12):
        base = [r.choice(pool) for _ in range(r.randrange(5, 200))]
        texts.append(" ".join(base))
        for _ in range(r.randrange(8)):
            near = list(base)
            for _ in range(r.randrange(1, 1 + max(1, len(base) // 18))):
                near[r.randrange(len(near))] = r.choice(pool)
            texts.append(" ".join(near).upper() if r.random() < 0.2 else "\n ".join(near))
    sets = word_sets(texts, words)
    linked = lambda i, j: i != j and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])
    want = plain_components(len(texts), linked)
    docs = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)], "doc_id long, text string, component_id int")
    got = {x["doc_id"]: x for x in minhash.near_duplicates(docs, words).collect()}
    assert [got[i]["n_shingles"] for i in range(len(texts))] == [len(s) for s in sets]
    assert [got[i]["component_id"] for i in range(len(texts))] == want
    assert [got[i]["kept"] for i in range(len(texts))] == [i == c for i, c in enumerate(want)]


def test_a_large_group_around_a_hub(spark):
    """Copies that are near the hub and not each other, with outliers between, make one component."""
    r = random.Random(11)
    base = [f"w{r.randrange(10**6)}" for _ in range(100)]
    texts = [" ".join(base)]
    for k in range(300):
        near = list(base)
        for i in r.sample(range(100), 2 if k % 4 else 6):
            near[i] = f"x{r.randrange(10**6)}"
        texts.append(" ".join(near))
    sets = word_sets(texts, 5)
    want = plain_components(len(texts), lambda i, j: i != j and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]))
    got = {x["doc_id"]: x["component_id"] for x in minhash.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert [got[i] for i in range(len(texts))] == want and len(set(want)) > 10


def test_near_duplicates_odd_rows(spark):
    """No rows; copies; rows that share an id, or have none; very long texts; a pair that a polynomial hash takes for one."""
    assert minhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    same = minhash.near_duplicates(spark.createDataFrame([(7, "a b c d e"), (7, "a b c d e"), (None, "q")], "doc_id long, text string")).collect()
    assert sorted((x["doc_id"] or 0, x["kept"]) for x in same) == [(0, True), (7, True), (7, True)]
    r = random.Random(21)
    base = [f"w{r.randrange(10**6)}" for _ in range(100)]
    long = " ".join(f"v{r.randrange(10**6)}" for _ in range(60_000))
    near = lambda i: " ".join([*base[:i], "other", *base[i + 1 :]])
    rows = [(5, " ".join(base)), (None, near(0)), (3, near(99)), (3, "something else than that"), (9, long), (None, long + " more"), (8, "x " + long), (None, "alone by itself it is"), (11, near(0).upper())]
    got = minhash.near_duplicates(spark.createDataFrame([(*x, b"z", 1) for x in rows], "doc_id long, text string, digest binary, node int")).collect()
    assert sorted((x["doc_id"] or 0, x["component_id"] or 0, x["kept"]) for x in got) == [(0, 0, True), (0, 3, False), (0, 8, False), (3, 3, True), (3, 3, True), (5, 3, False), (8, 8, True), (9, 8, False), (11, 3, False)]
    thue = "".join("ab"[bin(i).count("1") % 2] for i in range(1024))
    two = [(1, f"one {thue} two three"), (2, f"one {thue.translate(str.maketrans('ab', 'ba'))} two three")]
    assert {x["component_id"] for x in minhash.near_duplicates(spark.createDataFrame(two, "doc_id long, text string"), 4).collect()} == {1, 2}


def test_regions_over_parts_and_tiles(spark, monkeypatch):
    """Small leaves, tiles and chunks, and broken hubs, change no result."""
    r = random.Random(22)
    base = [f"w{r.randrange(10**6)}" for _ in range(80)]
    texts = [" ".join(base)]
    for k in range(250):
        near = list(base)
        for i in r.sample(range(80), 1 + k % 5):
            near[i] = f"x{r.randrange(10**6)}"
        texts.append(" ".join(near))
    sets = word_sets(texts, 5)
    want = plain_components(len(texts), lambda i, j: i != j and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    find = lambda: [x["component_id"] for x in sorted(minhash.near_duplicates(docs).collect(), key=lambda x: x["doc_id"])]
    monkeypatch.setattr(minhash, "TILE", 16)
    monkeypatch.setattr(minhash, "SMALL", 0)
    assert find() == want and len(set(want)) > 1
    monkeypatch.setattr(minhash, "_candidate_pairs", lambda members, rows, least: rows.select(F.col("node").alias("a"), F.col("node").alias("b")).limit(0))
    assert find() == want  # the tiles alone find all links


def test_orders_are_looked_through(monkeypatch):
    """Neighbours and hubs at the depth that a region needs, also where it spans chunks."""
    rng = np.random.default_rng(4)
    base = rng.integers(0, 256, 96).astype(np.uint8)
    label = np.where(rng.random((300, 96)) < 0.1, rng.integers(0, 256, (300, 96)), base).astype(np.uint8)
    label[:, :4] = base[:4]
    label[150:, 4:] = rng.integers(0, 256, (150, 92))  # and rows that are near nothing
    label = label[np.lexsort(label.T[::-1])]
    p, q = minhash.candidates(label, 57)
    assert ((label[p] == label[q]).sum(1) >= 57).all() and len(set(embed.forest(300, p, q).tolist())) <= 155
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array(np.zeros(300, np.int64)), pa.array(np.full(300, 9)), pa.array(np.arange(300)), pa.array([x.tobytes() for x in label], pa.binary())], ["tree", "key", "node", "label"])
    monkeypatch.setattr(minhash, "CHUNK", 100)
    batches = [batch.slice(i, 50) for i in range(0, 300, 50)]
    named = [b for b in minhash._named(iter(batches))]
    best = max((b.column(2)[0].as_py(), b.column(3)[0].as_py(), b.column(4)[0].as_py()) for b in named)
    assert len(named) == 3
    pairs = [b.to_pylist() for b in minhash._stars(57, {(0, 9): best[1:]})(iter(batches))]
    found = [(x["a"], x["b"]) for b in pairs for x in b if x["a"] != x["b"]]
    assert len(set(embed.forest(300, np.array([a for a, _ in found]), np.array([b for _, b in found])).tolist())) <= 155


def test_shared_counts():
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 60, 40)) for _ in range(30)]
    p, q = map(np.array, zip(*[(i, j) for i in range(30) for j in range(i)] * 2))
    assert minhash.shared_counts(sets, p, q).tolist() == [len(np.intersect1d(sets[i], sets[j])) for i, j in zip(p, q)]


def test_components(spark):
    r = random.Random(12)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(400, 460)]
    pairs = {*edges, *((b, a) for a, b in edges)}
    want = plain_components(461, lambda i, j: (i, j) in pairs)
    got = {x["node"]: x["component"] for x in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {n: want[n] for n in {x for a, b in edges if a != b for x in (a, b)}}
    assert graph.components(spark.createDataFrame([(1, 1), (None, 2)], "a long, b long")).count() == 0


# ---- sharding


def test_shards_grow_into_the_new_one_only(spark):
    got = sharding.op9_sharding(spark, SF).toPandas()
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").toPandas().set_index("doc_id").text
    assert (got["size"] == [len(docs[i].encode()) + 1 for i in got.doc_id]).all() and (got.text_crc32 == [zlib.crc32(docs[i].encode()) for i in got.doc_id]).all()
    moved = got[got.shard != got.grown_shard]
    assert set(moved.grown_shard) == {8} and 0 < len(moved) < 0.25 * len(got)
    for _, g in got.groupby("shard"):
        assert sorted(g.slot) == list(range(len(g)))


def plain_shard(tree, key, weights, path=""):
    while not isinstance(tree, int):
        def draw(name, path=path, tree=tree):
            p = f"{path}/{name}"
            unit = (int(hashlib.md5(f"{p}|{key}|".encode()).hexdigest()[:13], 16) + 0.5) * 2.0**-52
            return -math.log(unit) / sum(weights.get(x, 1.0) for x in sharding.leaves(tree[name]))

        name = min((n for n in tree if sum(weights.get(x, 1.0) for x in sharding.leaves(tree[n]))), key=draw)
        tree, path = tree[name], f"{path}/{name}"
    return tree


@pytest.mark.parametrize("weights", [{}, {3: 2.0}, {0: 1.5, 1: 0.5}, {2: 0.0, 3: 0.0}])
def test_shards_against_a_plain_descent(spark, weights):
    tree = sharding.grown(sharding.default_tree(8), 8)
    got = sharding.assign(spark.range(800).withColumnRenamed("id", "doc_id"), {"s": tree}, weights=weights).collect()
    assert [r["s"] for r in got] == [plain_shard(tree, r["doc_id"], weights) for r in got]


def test_weights_confine_movement(spark):
    """Shards that exchange weight inside a rack move rows there only; one that gains takes rows by way of its ancestors."""
    df = spark.range(4000).withColumnRenamed("id", "doc_id")
    tree = sharding.default_tree(8)
    before = sharding.assign(df, {"s": tree})
    moved = lambda w: {(r["s"], r["t"]) for r in before.join(sharding.assign(df, {"t": tree}, weights=w), "doc_id").where("s <> t").select("s", "t").distinct().collect()}
    assert moved({0: 1.5, 1: 0.5}) == {(1, 0)}
    to = moved({3: 2.0})
    assert {t for s, t in to if s > 3} <= {0, 1, 2, 3} and {t for s, t in to if s in (0, 1)} <= {2, 3} and {t for s, t in to if s == 2} == {3} and not [s for s, _ in to if s == 3]
    counts = {r["s"]: r["count"] for r in sharding.assign(df, {"s": tree}, weights={3: 2.0}).groupBy("s").count().collect()}
    assert abs(counts[3] - 4000 * 2 / 9) < 150 and all(abs(n - 4000 / 9) < 120 for s, n in counts.items() if s != 3)


def test_sharding_odd_rows(spark, tmp_path):
    rows = [(1, None), (1, None), (None, "a"), (None, "é"), (2, "long " * 100_000)]
    spark.createDataFrame([(*r, 7, 8) for r in rows], "doc_id long, text string, shard int, slot int").write.parquet(f"{tmp_path}/a/documents.parquet")
    got = sharding.op9_sharding(spark, f"{tmp_path}/a").collect()
    assert len(got) == 5 and sorted(r["size"] for r in got) == [1, 1, 2, 3, 500_001] and len({(r["shard"], r["slot"]) for r in got}) == 5
    assert len({r["shard"] for r in got if r["doc_id"] is None}) == 1
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/b/documents.parquet")
    assert sharding.op9_sharding(spark, f"{tmp_path}/b").count() == 0


# ---- vectors


def test_vectors_against_all_pairs(spark):
    rng = np.random.default_rng(5)
    rows, label = [], 0
    for i in range(240):
        base = rng.normal(size=16) if i % 6 == 0 else base  # noqa: F821
        v = base + rng.normal(size=16) * rng.choice([0.0, 0.1, 0.2, 0.5])
        rows.append((i, [float(x) for x in v.astype(np.float32)], int(i % 3 == 0) if i % 50 else None))
    rows += [(240, None, 1), (241, [0.0] * 16, 1), (242, [float("nan")] + [1.0] * 15, 1), (243, [None] + [1.0] * 15, 1), (244, [float("inf")] * 16, 1), (245, [], 1), (246, [1.0, 2.0], 1), (247, [2.0, 4.0], 1)]
    del label
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<float>, label int, links int")
    got = {x["vec_id"]: x for x in embed.near_vectors(df, block=32).collect()}

    def unit(v):
        ok = v and all(x is not None and np.isfinite(x) for x in v) and any(v)
        return np.array(v) / np.linalg.norm(v) if ok else None

    u = [unit(r[1]) for r in rows]
    near = lambda i, j: i != j and u[i] is not None and u[j] is not None and len(u[i]) == len(u[j]) and rows[i][2] is not None and rows[i][2] == rows[j][2] and float(u[i] @ u[j]) >= 0.98
    n = len(rows)
    assert [got[i]["n_links"] for i in range(n)] == [sum(near(i, j) for j in range(n)) for i in range(n)]
    assert [got[i]["component_id"] for i in range(n)] == plain_components(n, near)
    assert embed.near_vectors(df.limit(0)).count() == 0


def test_vectors_without_ids_and_of_many_dimensions(spark):
    rng = np.random.default_rng(7)
    wide = [rng.normal(size=1500).tolist() for _ in range(3)]
    rows = [(None, [1.0, 0.0], 1), (None, [1.0, 0.0], 1), (2**60 + 1, [1.0, 0.01], 1), (None, [0.0, 1.0], 1), (None, None, 1), (4, [0.0, 1.0], None), (4, wide[0], 2), (5, [2 * x for x in wide[0]], 2), (6, wide[1], 2), (6, wide[1], 2)]
    got = embed.near_vectors(spark.createDataFrame([(*r, "n") for r in rows], "vec_id long, embedding array<double>, label int, node string")).collect()
    big = 2**60 + 1
    assert sorted((x["vec_id"] or 0, x["n_links"], x["component_id"] or 0, x["kept"]) for x in got) == [(0, 0, 0, True), (0, 0, 0, True), (0, 2, big, False), (0, 2, big, False), (4, 0, 4, True), (4, 1, 4, True), (5, 1, 4, False), (6, 1, 6, True), (6, 1, 6, True), (big, 2, big, True)]


def test_quantisation_bound_holds():
    rng = np.random.default_rng(6)
    x = rng.normal(size=(300, 64)) * rng.choice([0.01, 1, 5], (300, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    q, s, a, b = embed.quantise(x)
    approx = (q.astype(float) @ q.T.astype(float)) * s[:, None] * s[None, :]
    assert (np.abs(approx - x @ x.T) <= a[:, None] * b[None, :] + b[:, None] * a[None, :] + b[:, None] * b[None, :]).all()


# ---- pipeline


def test_pipeline(spark, tmp_path):
    import corpus_pipeline as cp

    r = random.Random(13)
    words = ["".join(r.choice("abcdefghij") for _ in range(4)) for _ in range(500)]
    text = lambda n=60: " ".join(r.choice(words) for _ in range(n))
    twin = text()
    rows = [(i, text(), "en", f"s{i % 3}", 0) for i in range(40)] + [(100, twin, "en", "s0", 0), (101, twin + " extra", None, "s1", 0), (102, None, "en", "s1", 0), (103, "123 456", "en", "s2", 0), (104, text() + " call +1 (578) 555-6437", "en", "s2", 0), (5, rows_five := text(), "en", "s2", 0), (None, text(), "en", None, 0)]
    del rows_five
    spark.createDataFrame([(*x, "extra") for x in rows], "doc_id long, text string, lang string, source string, n_chars long, copies string").write.parquet(f"{tmp_path}/documents.parquet")
    docs, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for k, (name, stage) in enumerate(cp.STAGES):
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        kept.append(docs.toPandas())
        if k < 4:
            assert docs.columns == list(cp.COLUMNS), name
    ids = [set(x.doc_id.dropna().astype(int)) for x in kept]
    assert ids[0] == {*range(40), 100, 101, 104} and ids[1] == ids[0] - {101} and len(kept[1]) == len(ids[1]) + 2  # two texts under id 5, and one without id
    assert not kept[2].text.str.contains("555-6437", regex=False).any() and len(kept[2]) == len(kept[1])
    assert ids[3] <= ids[2] and len(kept[4]) == len(kept[3]) and (kept[4].n_tokens > 0).all()
    assert cp.run(spark, str(tmp_path)).count() == len(kept[4])


def test_pipeline_keeps_rows_that_share_an_id(spark, tmp_path):
    """Different texts under one id, or under none, are all kept; only near copies go."""
    import corpus_pipeline as cp

    r = random.Random(15)
    words = ["".join(r.choice("abcdefghij") for _ in range(4)) for _ in range(500)]
    text = lambda: " ".join(r.choice(words) for _ in range(60))
    twin, alone = text(), [text() for _ in range(12)]
    rows = [(i // 2, t) for i, t in enumerate(alone[:6])] + [(None, t) for t in alone[6:]]
    rows += [(9, twin), (10, twin + " extra"), (10, other := text()), (None, twin), (None, alone[6])]
    docs = spark.createDataFrame([(i, t, "en", f"s{k % 2}", len(t)) for k, (i, t) in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long")
    kept = cp.near_duplicates(spark, docs, "")
    want = [*rows[:12], (9, twin), (10, other)]
    key = lambda x: (x[0] is None, x[0] or 0, x[1])
    assert sorted(((x.doc_id, x.text) for x in kept.collect()), key=key) == sorted(want, key=key)
    taken = mixing.mix(cp.identified(kept), key="row_id").agg(F.sum("copies")).first()[0]
    mixed = collections.Counter((x.doc_id, x.text) for x in cp.mix(spark, kept, "").collect())
    assert set(mixed) <= set(want) and mixed.total() == taken and max(mixed.values()) <= 3


def test_pipeline_predicts_missing_languages(spark):
    """And keeps texts with letters where nothing is labelled."""
    import corpus_pipeline as cp

    one, two = "the cat sat on the mat with that hat", "der hund und die katze sind nicht im haus"
    rows = [(i, (one, two)[i % 2] * 3, ("en", "de")[i % 2]) for i in range(20)] + [(20, one, None), (21, two, None), (22, two, "en"), (23, "12 34", None), (24, None, None)]
    make = lambda rows: spark.createDataFrame([(*x, "s", 1) for x in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = {x.doc_id: x.lang for x in cp.language(spark, make(rows), "").collect()}
    assert got == {i: x for i, _, x in rows[:20]} | {20: "en", 21: "de", 22: "en"}
    got = cp.language(spark, make([(i, t, None) for i, t, _ in rows]), "").collect()
    assert sorted((x.doc_id, x.lang) for x in got) == [(i, None) for i in range(23)]


def test_cut_frees_its_shuffle_files(spark):
    """What led to a checkpoint leaves the disk, though the frame that it was made from is still held."""
    disk = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    there = lambda: set(re.findall(r"shuffle_(\d+)_", disk.getAllBlocks().mkString(" ")))
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before, setting = there(), spark.conf.get(name)
    counts = spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count()
    got = common.cut(counts.repartitionByRange(3, "k").sortWithinPartitions("k"))
    end = time.time() + 20
    while there() - before and time.time() < end:  # executors drop them a little later
        time.sleep(0.1)
    assert not there() - before
    want = [(k, 143 if k < 6 else 142) for k in range(7)]
    assert [tuple(x) for x in got.collect()] == want == sorted(map(tuple, counts.collect())) == sorted(map(tuple, counts.collect()))
    assert spark.conf.get(name) == setting
