"""Byte-level BPE encoding and decoding (operator 2).

Encoding. A token sequence is the BPE encoding of its bytes exactly when each
neighbouring pair of tokens is the encoding of its own bytes: merges inside a
token never look past its ends, so only a merge across one boundary can break
a sequence, and that merge shows in the pair alone. The set of encodings is thus
a 2-testable language over tokens, which a nondeterministic transducer reads
with (tokens still undecided, place in the token trie). ``Transducer``
determinises it lazily: a state is the set of live hypotheses (those that some
token may still complete), a transition is built when first taken, and tokens leave as soon as all hypotheses agree on
them, which is after at most one longest token of lookahead. Building a transition
costs more than the few merges of a short piece, and most are seldom taken: a short piece
that misses one is merged plainly, until it was missed often. States and piece
memo are bounded: beyond their limits they are dropped and built anew.

Decoding. ``StreamDecoder`` takes ids in any chunks and emits text as soon as
code points are complete, with an incremental UTF-8 state machine.

Results for odd input: null text encodes as empty (no ids, the digest of
nothing); an id outside the vocabulary raises KeyError.
"""

from __future__ import annotations

import base64
import gc
import hashlib
from array import array
from collections.abc import Iterable
from itertools import chain

import regex
from pyspark.sql import DataFrame, SparkSession

from .common import hold, map_rows, read

#: Unicode White_Space, which the pattern's \s means.
WHITE = r"\t-\r\x20\x85\xa0  -     　"
#: Nodes of the trie with fewer tokens below are looked through for ones that may follow.
FEW = 250
#: Most states of a transducer (and five times its remembered pairs of tokens), and most pieces in half of its memo. About 300 and 180 bytes each.
LIMITS = (400_000, 200_000)
#: Bytes up to which a piece may be merged plainly, which takes time in the square of them.
SHORT = 32
#: Misses of a transition by short pieces before it is built.
MISSES = 16


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f) if a}


NEVER = 1 << 60


def merge(ranks: dict[bytes, int], data: bytes, to: int = 1) -> list[bytes]:
    """Plain merging of a short string down to ``to`` parts: lowest rank first, leftmost on ties."""
    parts = [data[i : i + 1] for i in range(len(data))]
    while len(parts) > to:
        rank, i = min((ranks.get(parts[i] + parts[i + 1], NEVER), i) for i in range(len(parts) - 1))
        if rank == NEVER:
            break
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return parts


class Transducer:
    """Bytes of one piece in, token ids out."""

    def __init__(self, ranks: dict[bytes, int], states: int = LIMITS[0]):
        self.ranks, self.limit = ranks, states
        self.bytes_of = {i: t for t, i in ranks.items()}
        self.single = [ranks.get(bytes([b])) for b in range(256)]
        self.child: list[dict[int, int]] = [{}]
        self.token: list[int] = [-1]
        self.right: dict[int, list[tuple[bytes, int]]] = {}
        self.left: dict[int, list[tuple[bytes, int]]] = {}
        self.cut: dict[bytes, int] = {}  # where the last merge of a token joined its halves
        self.ordered = True
        for t, i in ranks.items():
            halves = [t] if len(t) == 1 else merge(ranks, t, 2)
            if len(halves) == 2:
                self.cut[t] = len(halves[0])
                self.ordered &= max(map(ranks.__getitem__, halves)) < i
            if len(halves) < 3:  # others appear only as whole pieces
                at = 0
                for b in t:
                    nxt = self.child[at].get(b)
                    if nxt is None:
                        nxt = self.child[at][b] = len(self.child)
                        self.child.append({})
                        self.token.append(-1)
                    at = nxt
                self.token[at] = i
        self.pairs: dict[tuple[int, int], bool] = {}
        self.alive: dict[tuple[int, int], bool] = {}
        self.below = self._few_below()
        self.reset()

    def _few_below(self) -> list[list[int] | None]:
        """The tokens strictly below each trie node; None where they are many."""
        none: list[int] = []
        leaf: dict[int, int] = {}
        below: list[list[int] | None] = [None] * len(self.child)
        for node in range(len(self.child) - 1, -1, -1):  # children have higher numbers
            if not self.child[node]:
                self.child[node], below[node] = leaf, none  # most nodes are leaves and share these
                continue
            found: list[int] | None = []
            for to in self.child[node].values():
                if found is not None and below[to] is not None and len(found) + len(below[to]) < FEW:
                    found += below[to] + ([self.token[to]] if self.token[to] >= 0 else [])
                else:
                    found = None
            below[node] = found
        return below

    def may_go_on(self, before: int, node: int) -> bool:
        """Whether a token below the node may follow; yes, where looking would take long."""
        if before < 0 or self.below[node] is None:
            return True
        known = self.alive.get((before, node))
        if known is None:
            if len(self.alive) >= self.limit // 5:
                self.alive.clear()
            known = self.alive[before, node] = any(self._fits(before, t) for t in self.below[node])
        return known

    def reset(self) -> None:
        """Begin with the start state alone. A state is packed into bytes, and all transitions stand in one table."""
        start = self._pack(-1, ((), ()), [])
        self.key: list[bytes] = [start]
        self.number: dict[bytes, int] = {start: 0}
        self.go: dict[int, int] = {}  # state * 256 + byte to the next state and, above 32 bits, the number of what leaves
        self.outs: list[tuple[int, ...]] = [()]
        self.out_number: dict[tuple[int, ...], int] = {(): 0}
        self.missed: dict[int, int] = {}  # how often transitions were missed that aren't built

    @staticmethod
    def _pack(last: int, done: tuple, live: list) -> bytes:
        """The last token that left, what the whole prefix would end with, and the hypotheses (undecided tokens, node)."""
        ints = [last, len(done[0]), *done[0]]
        for pending, node in live:
            ints += (node, len(pending), *pending)
        return array("i", ints).tobytes()

    def _live(self, state: int) -> tuple[int, list]:
        ints = memoryview(self.key[state]).cast("i").tolist()
        live, at = [], 2 + ints[1]
        done = (tuple(ints[2:at]), 0)
        while at < len(ints):
            end = at + 2 + ints[at + 1]
            live.append((tuple(ints[at + 2 : end]), ints[at]))
            at = end
        return ints[0], [*live, done]

    def fits(self, a: int, b: int) -> bool:
        known = self.pairs.get((a, b))
        if known is None:
            if len(self.pairs) >= self.limit // 5:
                self.pairs.clear()
            known = self.pairs[a, b] = self._fits(a, b)
        return known

    def _spine(self, token: int, side: int) -> list[tuple[bytes, int]]:
        """The parts that stand at this end of the token while it is merged, the last one first, each with the rank at which it goes."""
        ends, at, goes = [], self.bytes_of[token], NEVER
        while True:
            ends.append((at, goes))
            if len(at) == 1:
                return ends
            goes, at = self.ranks[at], at[self.cut[at] :] if side else at[: self.cut[at]]

    def _fits(self, a: int, b: int) -> bool:
        """Whether no merge crosses the boundary: of the two ends standing there at any time, none may merge before both are gone."""
        if not self.ordered:
            x, y = self.bytes_of[a], self.bytes_of[b]
            return merge(self.ranks, x + y) == [x, y]
        xs = self.right.get(a) or self.right.setdefault(a, self._spine(a, 1))
        ys = self.left.get(b) or self.left.setdefault(b, self._spine(b, 0))
        i, j, ranks = len(xs) - 1, len(ys) - 1, self.ranks
        while True:
            (x, x_goes), (y, y_goes) = xs[i], ys[j]
            rank = ranks.get(x + y, NEVER)
            if rank < x_goes and rank <= y_goes and rank != NEVER:  # on equal ranks the left merge comes first
                return False
            if x_goes == y_goes == NEVER:
                return True
            if x_goes <= y_goes:
                i -= 1
            else:
                j -= 1

    def expand(self, state: int, byte: int) -> int:
        last, live = self._live(state)
        nxt, child, done = [], self.child, None
        for pending, node in live:
            to = child[node].get(byte)
            if to is None:
                continue
            before = pending[-1] if pending else last
            if child[to] and self.may_go_on(before, to):
                nxt.append((pending, to))
            t = self.token[to]
            if t >= 0 and done is None:  # the prefix has one encoding
                if before < 0 or self.fits(before, t):
                    done = (*pending, t)
        shared, width = 0, min([len(done), *[len(p) for p, _ in nxt]])
        while shared < width and all(p[shared] == done[shared] for p, _ in nxt):
            shared += 1
        out = done[:shared]
        key = self._pack(out[-1] if shared else last, (done[shared:], 0), [(p[shared:], n) for p, n in nxt] if shared else nxt)
        number = self.number.get(key)
        if number is None:
            number = self.number[key] = len(self.key)
            self.key.append(key)
        which = self.out_number.get(out)
        if which is None:
            which = self.out_number[out] = len(self.outs)
            self.outs.append(out)
        made = self.go[state << 8 | byte] = which << 32 | number
        return made

    def merged(self, piece: bytes) -> tuple[int, ...]:
        """The encoding by merges: ids, the ends of their bytes and the ranks of neighbours stand in lists that shrink together."""
        rank, ids, ends = self.ranks.get, list(map(self.single.__getitem__, piece)), list(range(len(piece) + 1))
        goes = [rank(piece[i : i + 2], NEVER) for i in range(len(piece) - 1)]
        while goes:
            least = min(goes)
            if least == NEVER:
                break
            i = goes.index(least)
            ids[i] = least
            del ids[i + 1], ends[i + 1], goes[i]
            if i < len(goes):
                goes[i] = rank(piece[ends[i] : ends[i + 2]], NEVER)
            if i:
                goes[i - 1] = rank(piece[ends[i - 1] : ends[i + 1]], NEVER)
        return tuple(ids)

    def encode(self, piece: bytes) -> tuple[int, ...]:
        if len(self.key) > self.limit:
            self.reset()
        go, outs, state, out = self.go.get, self.outs, 0, []
        for byte in piece:
            made = go(state << 8 | byte)
            if made is None:
                step = state << 8 | byte
                misses = self.missed.pop(step, 0) + 1
                if misses < MISSES and len(piece) <= SHORT:
                    if len(self.missed) >= self.limit // 4:
                        self.missed.clear()
                    self.missed[step] = misses
                    return self.merged(piece)
                made = self.expand(state, byte)
            state = made & 0xFFFFFFFF
            if made > 0xFFFFFFFF:
                out += outs[made >> 32]
        ints = memoryview(self.key[state]).cast("i")
        out += ints[2 : 2 + ints[1]].tolist()
        return tuple(out)


class Pieces(dict):
    """Memo from pieces to ids in two generations: when the young one is full it becomes the old one, and what is used again moves back."""

    def __init__(self, fst: Transducer, limit: int):
        super().__init__()
        self.fst, self.old, self.limit = fst, {}, limit

    def __missing__(self, piece: str) -> tuple[int, ...]:
        ids = self.old.get(piece)
        if ids is None:
            data = piece.encode()
            whole = self.fst.ranks.get(data)
            ids = self.fst.encode(data) if whole is None else (whole,)
        if len(piece) <= 64:
            if len(self) >= self.limit:
                self.old = dict(self)
                self.clear()
            self[piece] = ids
        return ids


class Codec:
    def __init__(self, ranks: dict[bytes, int], pattern: str, limits: tuple[int, int] = LIMITS):
        self.split = regex.compile(pattern.replace(r"[^\s", f"[^{WHITE}").replace(r"\S", f"[^{WHITE}]").replace(r"\s", f"[{WHITE}]"))
        self.fst = Transducer(ranks, limits[0])
        self.pieces = Pieces(self.fst, limits[1])
        self.decimal = {i: str(i) for i in ranks.values()}
        #: Steps of the decoder: from an unfinished sequence, by a token, to text and what is unfinished then;
        #: and the texts of tokens that begin and end between code points.
        self.steps: dict[tuple[bytes, int], tuple[str, bytes]] = {}
        self.plain: dict[int, str] = {}

    def encode(self, text: str) -> list[int]:
        return list(chain.from_iterable(map(self.pieces.__getitem__, self.split.findall(text))))

    def decode_bytes(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.fst.bytes_of.__getitem__, ids))


#: Length of a sequence by its lead byte's class; below 0x80 is complete, 0 can't lead.
def _need(lead: int) -> int:
    return 1 if lead < 0x80 else 2 if 0xC2 <= lead < 0xE0 else 3 if 0xE0 <= lead < 0xF0 else 4 if 0xF0 <= lead < 0xF5 else 0


def _goes_on(seq: bytes, byte: int) -> bool:
    """May ``byte`` follow the begun sequence ``seq``?"""
    if len(seq) == 1:
        low, high = {0xE0: (0xA0, 0xBF), 0xED: (0x80, 0x9F), 0xF0: (0x90, 0xBF), 0xF4: (0x80, 0x8F)}.get(seq[0], (0x80, 0xBF))
        return low <= byte <= high
    return 0x80 <= byte <= 0xBF


def walk(begun: bytes, data: bytes) -> tuple[str, bytes]:
    """Run the UTF-8 machine over ``data`` from the state ``begun``, a sequence of at most three bytes that may go on:
    the text that is complete, and the next state. What can't go on is one replacement character."""
    out = []
    for byte in data:
        if begun and not _goes_on(begun, byte):
            out.append("\ufffd")
            begun = b""
        if not begun and not _need(byte):
            out.append("\ufffd")
            continue
        begun += bytes([byte])
        if len(begun) == _need(begun[0]):
            out.append(begun.decode())
            begun = b""
    return "".join(out), begun


#: Tokens that are looked up at once.
RUN = 256


class StreamDecoder:
    """Incremental UTF-8 over tokens: a step of the machine is a whole token, worked out once for each state it meets."""

    def __init__(self, codec: Codec):
        self.codec, self.begun = codec, b""

    def feed(self, ids: Iterable[int]) -> str:
        ids, out, c = list(ids), [], self.codec
        for at in range(0, len(ids), RUN):
            some = ids[at : at + RUN]
            run = [None] if self.begun else list(map(c.plain.get, some))
            if None in run:
                run, begun = [], self.begun
                for i in some:
                    key = (begun, i)
                    made = c.steps.get(key)
                    if made is None:
                        made = c.steps[key] = walk(begun, c.fst.bytes_of[i])
                        if not begun and not made[1]:
                            c.plain[i] = made[0]
                    run.append(made[0])
                    begun = made[1]
                self.begun = begun
            out += run
        return "".join(out)

    def finish(self) -> str:
        rest, self.begun = "\ufffd" if self.begun else "", b""
        return rest


_CODECS: dict[tuple, Codec] = {}


def codec(path: str, pattern: str, limits: tuple[int, int] = LIMITS) -> Codec:
    """One codec per worker process; only the last is kept."""
    if (path, pattern, limits) not in _CODECS:
        _CODECS.clear()
        hold(__name__, _CODECS.clear)
        _CODECS[path, pattern, limits] = Codec(load_ranks(path), pattern, limits)
    return _CODECS[path, pattern, limits]


CHUNK = 65_536


def round_trip(c: Codec, text: str | None) -> tuple[list[int], str, str]:
    """ids, the digest of their decimals, and the digest of what streaming decode gives back."""
    ids = c.encode(text or "")
    digest, stream = hashlib.sha256(), StreamDecoder(c)
    for i in range(0, len(ids), CHUNK):
        digest.update(stream.feed(ids[i : i + CHUNK]).encode())
    digest.update(stream.finish().encode())
    return ids, hashlib.sha256(",".join(map(c.decimal.__getitem__, ids)).encode()).hexdigest(), digest.hexdigest()


def encode(docs: DataFrame, path: str, pattern: str, text: str = "text", key: str = "doc_id", with_ids: bool = True, limits: tuple[int, int] = LIMITS) -> DataFrame:
    """One row per row of ``docs``: key, ids (if asked), n_tokens, ids_sha256, decoded_sha256."""

    def make():
        c = codec(path, pattern, limits)

        def run(columns):
            keys, texts = columns
            gc.disable()  # the tables hold no cycles, and walking them costs more than encoding
            try:
                out = [round_trip(c, t) for t in texts]
            finally:
                gc.enable()
            ids = [[i for i, _, _ in out]] if with_ids else []
            return [keys, *ids, [len(i) for i, _, _ in out], [s for _, s, _ in out], [d for _, _, d in out]]

        return run

    kind = docs.schema[key].dataType.simpleString()
    return map_rows(docs.select(key, text), make, f"{key} {kind}, " + "ids array<int>, " * with_ids + "n_tokens long, ids_sha256 string, decoded_sha256 string")


def decode(rows: DataFrame, path: str, pattern: str, ids: str = "ids", key: str = "doc_id") -> DataFrame:
    """One row per row: key and the text of its ids (null ids: null text), by the streaming decoder."""

    def make():
        c = codec(path, pattern)

        def run(columns):
            texts = []
            for seq in columns[1]:
                stream = StreamDecoder(c)
                texts.append(None if seq is None else "".join(stream.feed(seq[i : i + CHUNK]) for i in range(0, len(seq), CHUNK)) + stream.finish())
            return [columns[0], texts]

        return run

    kind = rows.schema[key].dataType.simpleString()
    return map_rows(rows.select(key, ids), make, f"{key} {kind}, text string")


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, with_ids=False)
