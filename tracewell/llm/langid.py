"""Language identification by cross-parsing entropy (operator 1).

For each language a suffix automaton is built over a bounded sample of labelled
text. A text is parsed greedily into the longest phrases that occur in the
sample; a character that never occurs is a phrase of its own. Fewer phrases
mean a closer language: the language with the smallest
``phrases * log2(sample length) / text length`` wins, ties by name.

Many parses run in lockstep: texts are cut into segments of ``SEGMENT``
characters, and one numpy step moves all segments of a batch through all automata
by one character. A segment first begins at the root; it is parsed again from where the
one before ends, until no beginning changes, so phrases go on over cuts. No text is
shortened.

Bounds (parameters of ``fit``): about ``rows_per_lang`` labelled rows for each
language, chosen by a hash of the key, and ``chars_per_lang`` characters of them. All letters
of the samples and any number of languages are told apart: beyond 253 letters, or
beyond the offsets of one dense table, the model looks its edges up in a sorted list.

Results for odd input: a null text or one without a letter gets ``und`` and
score 0; with no labelled rows at all every text gets ``und``; rows with a null
key are predicted and never learned from; repeated rows give repeated results; languages that cost
the same tie by name; texts of any length are parsed whole.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import hold, map_rows, read

SEGMENT = 4096
UNKNOWN = "und"
#: Classes of characters: padding, the gap between words, a letter that no sample has, then letters.
PAD, GAP, OTHER, FIRST = 0, 1, 2, 3


def automaton(seq: list[int]) -> list[dict[int, int]]:
    """Transitions of the suffix automaton of ``seq``; state 0 is the root."""
    nxt, link, length, last = [{}], [-1], [0], 0
    for c in seq:
        cur = len(nxt)
        nxt.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p >= 0 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p >= 0:
            q = nxt[p][c]
            if length[q] == length[p] + 1:
                link[cur] = q
            else:
                copy = len(nxt)
                nxt.append(dict(nxt[q]))
                link.append(link[q])
                length.append(length[p] + 1)
                while p >= 0 and nxt[p].get(c) == q:
                    nxt[p][c] = copy
                    p = link[p]
                link[q] = link[cur] = copy
        last = cur
    return nxt


_LETTER: list[np.ndarray] = []


def letters() -> np.ndarray:
    if not _LETTER:
        _LETTER.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return _LETTER[0]


class Model:
    """Automata of all languages in one table of ``state * width + class``.

    An entry holds the next offset and, above ``bits``, the phrases that end with this step.
    The table is dense where the offsets fit ``BITS`` bits and the classes a byte; otherwise only
    the edges are held, sorted by offset (``edges`` and ``table``), with ``WIDE`` bits.
    """

    BITS, WIDE = 28, 48

    def __init__(self, samples: dict[str, str]):
        self.langs = sorted(samples)
        lowered = {k: samples[k].lower() for k in self.langs}
        seen = Counter(c for t in lowered.values() for c in t if c.isalpha())
        alphabet = [c for c, _ in sorted(seen.items(), key=lambda x: (-x[1], x[0]))]
        self.width = max(8, 1 << (len(alphabet) + FIRST - 1).bit_length())
        most = self.width * sum(2 * len(t) + 2 for t in lowered.values())  # an automaton has less than two states a symbol
        self.dense = self.width <= 256 and most <= 1 << self.BITS
        self.bits, kind = (self.BITS, np.int32) if self.dense else (self.WIDE, np.int64)
        self.cls = np.full(0x110000, OTHER, np.uint8 if self.width <= 256 else np.uint32)
        self.cls[~letters()] = GAP
        for i, c in enumerate(alphabet):
            self.cls[ord(c)] = FIRST + i
        places, tables, self.roots, self.logs, base = [], [], [], [], 0
        for lang in self.langs:
            seq = [GAP, *self.classes(lowered[lang]).tolist()]
            nxt = automaton(seq)
            if self.dense:
                first = nxt[0]
                root = np.array([base + first[c] * self.width if c in first else base + (1 << self.bits) for c in range(self.width)], kind)
                table = np.repeat(root[None] + kind(1 << self.bits), len(nxt), 0)  # a missing letter ends a phrase and begins at the root
                table[0] = root
                for s, edges in enumerate(nxt):
                    for c, to in edges.items():
                        table[s, c] = base + to * self.width
                table[:, PAD] = base + np.arange(len(nxt)) * self.width
                tables.append(table.ravel())
            else:
                edges = np.array([(s * self.width + c, to * self.width) for s, out in enumerate(nxt) for c, to in sorted(out.items())], np.int64) + base
                places.append(edges[:, 0].copy())
                tables.append(edges[:, 1].copy())
            self.roots.append(base)
            self.logs.append(math.log2(max(2, len(seq))))
            base += len(nxt) * self.width
            del nxt
        self.table = np.concatenate(tables) if tables else np.zeros(0, kind)
        self.edges = np.concatenate(places) if places else None

    def _follow(self, state: np.ndarray, symbols: np.ndarray) -> np.ndarray:
        """Entries of the states (rows by language) for the symbols."""
        if self.dense:
            return self.table.take(state + symbols)
        one, roots = 1 << self.bits, np.array(self.roots, np.int64)[:, None]

        def found(at):
            i = np.minimum(np.searchsorted(self.edges, at), len(self.edges) - 1)
            return self.edges[i] == at, self.table[i]

        (hit, to), (known, anew) = found(state + symbols), found(roots + symbols)
        return np.where(hit, to, np.where(known, anew, roots + one) + one * (state != roots))

    def classes(self, lowered: str) -> np.ndarray:
        """Classes of a text: each run of other characters is one gap."""
        codes = self.cls[np.frombuffer(lowered.encode("utf-32-le", "replace"), np.uint32)]
        gap = codes == GAP
        gap[1:] &= gap[:-1]
        return codes[~gap]

    def _run(self, lanes: np.ndarray, filled: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """States (languages by lanes) after the lanes' symbols, and how many phrases ended on the way."""
        order = np.argsort(-filled, kind="stable")
        turned, filled, state = np.ascontiguousarray(lanes[order].T), filled[order], state[:, order]
        ended = np.zeros(state.shape, np.int32)
        mask = self.table.dtype.type((1 << self.bits) - 1)
        active = np.searchsorted(-filled, -np.arange(int(filled.max(initial=0))), side="left")  # lanes longer than the step
        for step, n in enumerate(active.tolist()):
            v = self._follow(state[:, :n], turned[step, :n].astype(self.table.dtype, copy=False))
            state[:, :n] = v & mask
            ended[:, :n] += v >> self.bits
        back = np.empty_like(order)
        back[order] = np.arange(len(order))
        return state[:, back], ended[:, back]

    def phrases(self, texts: list[np.ndarray]) -> np.ndarray:
        """Phrases of each text (rows) in each language (columns)."""
        counts = np.zeros((len(texts), len(self.langs)), np.int64)
        size = np.array([-(-len(t) // SEGMENT) for t in texts], np.int64)
        owner = np.repeat(np.arange(len(texts)), size)
        if not len(owner):
            return counts
        lanes = np.zeros((len(owner), SEGMENT), self.cls.dtype)
        filled = np.full(len(owner), SEGMENT)
        for t, at, n in zip(texts, np.cumsum(size) - size, size):
            lanes[at : at + n].reshape(-1)[: len(t)] = t
            if n:
                filled[at + n - 1] = len(t) - (n - 1) * SEGMENT
        later = np.concatenate([[False], owner[1:] == owner[:-1]])
        roots = np.array(self.roots, self.table.dtype)[:, None]
        start = np.repeat(roots, len(owner), 1)
        end, ended = self._run(lanes, filled, start)
        while True:
            want = np.where(later, np.roll(end, 1, 1), roots)
            again = np.nonzero((want != start).any(0))[0]
            if not len(again):
                break
            start[:, again] = want[:, again]
            end[:, again], ended[:, again] = self._run(lanes[again], filled[again], want[:, again])
        last = np.concatenate([~later[1:], [True]])
        ended += (end != roots) & last
        for i in range(len(self.langs)):
            counts[:, i] = np.bincount(owner, ended[i], len(texts))
        return counts

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        seqs = [np.zeros(0, np.uint8) if t is None else self.classes(t.lower()) for t in texts]
        seqs = [s if len(s) and (s > GAP).any() else s[:0] for s in seqs]
        langs, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
        if not self.langs:
            return langs, scores
        counts = self.phrases(seqs)
        cost = counts * np.array(self.logs) / np.maximum(1, [len(s) for s in seqs])[:, None]
        best = cost.argmin(1)
        for i, s in enumerate(seqs):
            if len(s):
                langs[i] = self.langs[best[i]]
                rest = np.delete(cost[i], best[i])
                scores[i] = 1.0 if not len(rest) else float(rest.min() / (rest.min() + cost[i, best[i]]))
        return langs, scores


_MODELS: dict[tuple, Model] = {}


def model(samples: tuple[tuple[str, str], ...]) -> Model:
    """One model per worker process; only the last is kept."""
    if samples not in _MODELS:
        _MODELS.clear()
        hold(__name__, _MODELS.clear)
        _MODELS[samples] = Model(dict(samples))
    return _MODELS[samples]


def fit(docs: DataFrame, learn: F.Column, rows_per_lang: int = 200, chars_per_lang: int = 40_000, text: str = "text", lang: str = "lang", key: str = "doc_id") -> tuple[tuple[str, str], ...]:
    """Samples of each language. About ``rows_per_lang`` rows with the lowest hash
    of the key come to the driver, each with at most ``chars_per_lang // 20`` characters."""
    rows = docs.where(learn & F.col(lang).isNotNull() & F.col(text).isNotNull())
    sizes = {r[0]: r[1] for r in rows.groupBy(F.col(lang)).count().collect()}
    if not sizes:
        return ()
    share = F.lit(0.0)
    for k, n in sizes.items():
        share = F.when(F.col(lang) == k, min(1.0, rows_per_lang / n)).otherwise(share)
    mix = F.xxhash64(F.lit("langid"), F.col(key))
    drawn = rows.where(F.pmod(mix, F.lit(1 << 30)) < share * float(1 << 30))
    got = drawn.select(F.col(lang), mix, F.substring(F.col(text), 1, chars_per_lang // 20)).collect()
    samples: dict[str, list[str]] = {k: [] for k in sizes}
    for k, _, t in sorted(got, key=lambda r: (r[0], r[1], r[2])):
        samples[k].append(t)
    return tuple((k, "\n".join(v)[:chars_per_lang]) for k, v in sorted(samples.items()) if v)


def identify(docs: DataFrame, samples: tuple[tuple[str, str], ...], text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """One row per row of ``docs``: the kept columns (the text may be one of them), lang_pred, score."""

    def make():
        m = model(samples)

        def run(columns):
            langs, scores = [], []
            texts, at = columns[-1], 0
            while at < len(texts):  # about 4 MB of text in lockstep
                end, size = at, 0
                while end < len(texts) and (size < 4_000_000 or end == at):
                    size += len(texts[end] or "")
                    end += 1
                a, b = m.predict(texts[at:end])
                langs += a
                scores += b
                at = end
            return [*columns[:-1], langs, scores]

        return run

    kinds = {f.name: f.dataType.simpleString() for f in docs.schema}
    return map_rows(docs.select(*keep, F.col(text).alias("__text")), make, "".join(f"`{k}` {kinds[k]}, " for k in keep) + "lang_pred string, score double")


def held_out(key: str = "doc_id") -> F.Column:
    return F.coalesce(F.crc32(F.col(key).cast("string")) % 4 == 2, F.lit(False))


def op1_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    samples = fit(docs, ~held_out() & F.col("doc_id").isNotNull())
    return identify(docs.select("doc_id", "text"), samples).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
