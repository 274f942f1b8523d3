"""Piece encoding and decoding with exact N-best segmentations.

The pieces and scores of a public vocabulary file span a lattice over a text: an
edge for each piece that matches, and, where no piece covers a character, one edge
that stands for its UTF-8 bytes (byte pieces).  A segmentation is a path; its score
is the sum of its pieces' scores.

A forward Viterbi pass gives the best score up to every place.  These scores are
exact heuristics for a backward A* search from the end of the lattice, which
therefore yields the N best paths one after the other without visiting others.

No piece of such a vocabulary has a space sign after another character, so the
lattice of a text is a chain of the lattices of its chunks (spaces and what follows
up to the next space).  The forward pass runs for all new chunks of a slab of texts at
once, and also gives the score gap to each chunk's second-best path; a worker keeps the
results of up to CHUNKS chunks from slab to slab and from task to task, and drops them when no task has used them
for REST seconds, so that later queries have the room.  The N best paths of a text can leave the best one only in the
N - 1 chunks of the smallest gaps; A* runs on these and their lists are merged.  The
choices that a sum is made of are kept, and give each segmentation's ids.

Encoding is reversible: spaces become the space sign, a text's own space signs are
written as bytes, and a leading space sign is added to each text that is not empty.

Defined results: null and empty texts have no pieces and one empty segmentation;
equal scores keep the order in which the search meets them, which depends on the
text alone; repeated rows give repeated result rows; further columns stay, but for
those named like the results, which are replaced.
"""

from __future__ import annotations

import heapq
import itertools
import re
import threading
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import Words, parts, table, utf8

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
N_BEST = 4
#: Chunks of more characters are passed one by one.
LONG = 48
#: Characters handled at once.
SLAB = 1 << 18
#: Chunks that an encoder keeps at most between slabs, and chunks whose N best paths it keeps.
CHUNKS, PATHS = 1 << 18, 1 << 15
#: Seconds without a task after which a worker drops its encoder.
REST = 3.0
#: Characters whose lattices are held at once, unless one chunk has more.
RUN = 1 << 17
SIGN = 0x2581
_OWN_SIGN = 0x110000
_HASH = np.uint64(0x9E3779B97F4A7C15)
_SPACED = re.compile(" +[^ ]*")
_coders: dict = {}
_timers: list[threading.Timer] = []


class Vocabulary:
    """Pieces and scores as a trie in one hash table (state and character to state)."""

    def __init__(self, pieces: list[str], scores: list[float], byte_ids: list[int], usable: list[bool]) -> None:
        self.scores = np.array(scores, np.float64)
        self.byte_ids = np.array(byte_ids, np.int32)
        nodes: dict[tuple[int, int], int] = {}
        ends, self.longest = {}, 1
        for k, piece in enumerate(pieces):
            if not usable[k]:
                continue
            if chr(SIGN) in piece.lstrip(chr(SIGN)):
                raise ValueError(f"piece {piece!r} has a space sign inside")
            state = 0
            for c in piece:
                state = nodes.setdefault((state, ord(c)), len(nodes) + 1)
            ends[state] = k
            self.longest = max(self.longest, len(piece))
        self.piece_of = np.full(len(nodes) + 1, -1, np.int32)
        self.piece_of[list(ends)] = list(ends.values())
        size = 1 << max(4, (4 * len(nodes)).bit_length())
        self.shift = np.uint64(64 - (size.bit_length() - 1))
        self.keys, self.next = np.full(size, -1, np.int64), np.zeros(size, np.int32)
        for (state, c), to in nodes.items():
            key = (state << 21) | c
            at = (key * int(_HASH) % (1 << 64)) >> int(self.shift)
            while self.keys[at] >= 0:
                at = (at + 1) & (size - 1)
            self.keys[at], self.next[at] = key, to
        self.fallback = float(min((s for s, u in zip(scores, usable, strict=True) if u), default=0.0)) - 10.0
        decoded = [p.replace(chr(SIGN), " ").encode() if u else b"" for p, u in zip(pieces, usable, strict=True)]
        for b, k in enumerate(byte_ids):
            decoded[k] = bytes([b])
        self.text = np.frombuffer(b"".join(decoded), np.uint8)
        self.size = np.array(list(map(len, decoded)), np.int32)
        self.start = np.cumsum(self.size, dtype=np.int32) - self.size

    def step(self, state: np.ndarray, char: np.ndarray) -> np.ndarray:
        """The state after each character, 0 where the trie ends."""
        key = (state.astype(np.int64) << 21) | char
        at = ((key.astype(np.uint64) * _HASH) >> self.shift).astype(np.int64)
        found = self.keys[at]
        out = np.where(found == key, self.next[at], 0)
        open_ = np.nonzero((found != key) & (found >= 0))[0]
        while len(open_):
            at[open_] = (at[open_] + 1) & (len(self.keys) - 1)
            found = self.keys[at[open_]]
            hit = found == key[open_]
            out[open_[hit]] = self.next[at[open_[hit]]]
            open_ = open_[~hit & (found >= 0)]
        return out


def load(path: str = MODEL) -> Vocabulary:
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    n = sp.get_piece_size()
    pieces = [sp.id_to_piece(i) for i in range(n)]
    usable = [not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)) for i in range(n)]
    return Vocabulary(pieces, [sp.get_score(i) for i in range(n)], [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)], usable)


class Lattices:
    """The lattices of several chunks, laid end to end: chars[base[k]:base[k + 1]] is chunk k."""

    def __init__(self, v: Vocabulary, chars: np.ndarray, base: np.ndarray) -> None:
        self.v, self.chars, self.base = v, chars, base
        n, longest = len(chars), v.longest
        end = np.repeat(base[1:], np.diff(base))
        self.piece = np.full((longest, n), -1, np.int32)
        at, state = np.arange(n), np.zeros(n, np.int32)
        edges = []
        for size in range(longest):
            state = v.step(state, chars[at + size])
            keep = state > 0
            at, state = at[keep], state[keep]
            p = v.piece_of[state]
            own = np.nonzero(p >= 0)[0]
            self.piece[size, at[own]] = p[own]
            edges.append((at[own], v.scores[p[own]]))
            keep = at + size + 1 < end[at]
            at, state = at[keep], state[keep]
            if not len(at):
                break
        bare = np.nonzero(self.piece[0] < 0)[0]
        edges.insert(1, (bare, np.full(len(bare), v.fallback)))
        size = np.repeat(np.array([1, 1, *range(2, len(edges))], np.int32), [len(x) for x, _ in edges])
        self._forward(*map(np.concatenate, zip(*edges, strict=True)), size)

    def _score(self, size: int, at: int) -> float:
        """Score of the edge of so many characters, -inf if there is none."""
        p = self.piece[size - 1, at]
        return float(self.v.scores[p]) if p >= 0 else self.v.fallback if size == 1 else -np.inf

    def _forward(self, start: np.ndarray, score: np.ndarray, size: np.ndarray) -> None:
        """Best and second-best score up to each place (place base[k] + j + k: after j characters of chunk k), from the edges."""
        sizes = np.diff(self.base)
        chunk = np.repeat(np.arange(len(sizes)), sizes)
        self.best = np.full(len(self.chars) + len(sizes), -np.inf)
        second = np.full(len(self.best), -np.inf)
        self.back = np.zeros(len(self.best), np.int16)
        self.best[self.base[:-1] + np.arange(len(sizes))] = 0.0
        for k in np.nonzero(sizes > LONG)[0].tolist():
            self._forward_one(k, second)
        k = chunk[start]
        after = start - self.base[k] + size
        place = start + k
        short = sizes[k] <= LONG
        if not short.all():
            start, score, size, after, place = start[short], score[short], size[short], after[short], place[short]
        # by end, then by size; edges of one end and one size lead to different places
        turn = after * (self.v.longest + 1) + size
        most = (LONG + 1) * (self.v.longest + 1)
        order = np.argsort(turn.astype(np.uint16) if most < 1 << 16 else turn, kind="stable")
        turn, score, place, size = turn[order], score[order], place[order], size[order]
        to = place + size
        cuts = np.concatenate([[0], np.nonzero(np.diff(turn))[0] + 1, [len(turn)]]).tolist()
        for lo, hi in zip(cuts, cuts[1:], strict=False):
            if lo == hi:
                continue
            p, q, e = place[lo:hi], to[lo:hi], score[lo:hi]
            x, y, first = self.best[p] + e, second[p] + e, self.best[q]
            second[q] = np.maximum(np.maximum(np.minimum(first, x), second[q]), y)
            self.best[q] = np.maximum(first, x)
            self.back[q[x > first]] = size[lo]
        last = self.base[1:] + np.arange(len(sizes))
        self.score = self.best[last]
        self.gap = self.score - second[last]

    def _forward_one(self, k: int, second: np.ndarray) -> None:
        """The forward pass of one long chunk, place by place."""
        lo, hi = int(self.base[k]), int(self.base[k + 1])
        n = hi - lo
        starts: list[list] = [[] for _ in range(n + 1)]
        known = self.piece[:, lo:hi] >= 0
        known[0] = True
        for size, i in zip(*(x.tolist() for x in np.nonzero(known)), strict=True):
            starts[i + size + 1].append((size + 1, self._score(size + 1, lo + i)))
        a, b, back = [0.0] * (n + 1), [-np.inf] * (n + 1), [0] * (n + 1)
        for j in range(1, n + 1):
            first = other = -np.inf
            for size, e in starts[j]:
                x, y = a[j - size] + e, b[j - size] + e
                if x > first:
                    first, other, back[j] = x, max(first, other), size
                else:
                    other = max(other, x)
                other = max(other, y)
            a[j], b[j] = first, other
        own = slice(lo + k, hi + k + 1)
        self.best[own], second[own], self.back[own] = a, b, back

    def best_ids(self) -> tuple[np.ndarray, np.ndarray]:
        """Piece ids of the best path of every chunk, end to end, and where each chunk's begin."""
        k = np.arange(len(self.base) - 1)
        at = np.diff(self.base)
        chunk, place, ids = [], [], []
        while True:
            live = at > 0
            if not live.any():
                break
            k, at = k[live], at[live]
            size = self.back[self.base[k] + k + at].astype(np.int64)
            start = self.base[k] + at - size
            p = self.piece[size - 1, start]
            chunk.append(k)
            place.append(at - size)
            ids.append(np.where(p >= 0, p, -1 - self.chars[start]))
            at = at - size
        if not ids:
            return np.zeros(0, np.int32), np.zeros(1, np.int64)
        chunk, place, ids = np.concatenate(chunk), np.concatenate(place), np.concatenate(ids)
        order = np.lexsort((place, chunk))
        return self._with_bytes(chunk[order], ids[order])

    def _with_bytes(self, chunk: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = np.ones(len(ids), np.int64)
        odd = np.nonzero(ids < 0)[0]
        own = [char_bytes(int(-1 - ids[i])) for i in odd]
        n[odd] = list(map(len, own))
        out = np.repeat(ids, n).astype(np.int32)
        at = np.cumsum(n) - n
        if len(odd):
            out[np.repeat(at[odd] - np.concatenate([[0], np.cumsum(n[odd])[:-1]]), n[odd]) + np.arange(n[odd].sum())] = self.v.byte_ids[np.frombuffer(b"".join(own), np.uint8)]
        per = np.bincount(chunk, weights=n, minlength=len(self.base) - 1).astype(np.int64)
        return out, np.concatenate([[0], np.cumsum(per)])

    def n_best(self, k: int, n: int) -> list[tuple[float, list[int]]]:
        """The n best paths of chunk k by backward A*: (score, ids), best first."""
        base, size = int(self.base[k]), int(self.base[k + 1] - self.base[k])
        agenda, out, count = [(-self.best[base + k + size], 0, size, 0.0, None)], [], 1
        while agenda and len(out) < n:
            f, _, at, g, path = heapq.heappop(agenda)
            if at == 0:
                ids = []
                while path is not None:
                    (piece, char), path = path
                    ids += [piece] if piece >= 0 else [int(self.v.byte_ids[b]) for b in char_bytes(char)]
                out.append((-f, ids))
                continue
            for step in range(1, min(self.v.longest, at) + 1):
                e = self._score(step, base + at - step)
                if e > -np.inf:
                    node = (int(self.piece[step - 1, base + at - step]), int(self.chars[base + at - step]))
                    heapq.heappush(agenda, (-(g + e + self.best[base + k + at - step]), count, at - step, g + e, (node, path)))
                    count += 1
        return out


def char_bytes(c: int) -> bytes:
    return chr(SIGN if c == _OWN_SIGN else c).encode()


def merged(total: float, lists: list[list[float]], n: int) -> list[tuple[float, tuple[int, ...]]]:
    """The n best sums of one entry from each list, given the sum of all firsts, and the entries taken."""
    sums: list = [(total, ())]
    for scores in lists:
        sums = sorted(((s + x - scores[0], (*c, i)) for s, c in sums for i, x in enumerate(scores)), key=lambda y: -y[0])[:n]
    return sums


class Encoder:
    """Segmentations through a bounded table of chunks, which lasts from text to text."""

    def __init__(self, v: Vocabulary, n_best: int = N_BEST) -> None:
        self.v, self.n_best = v, n_best
        self._clear()

    def _clear(self) -> None:
        # chunk i: its number by what follows its first space, ids[ends[i]:ends[i + 1]] of its best path, score and gap
        self.known, self.ids, self.ends = Words(), np.zeros(0, np.int32), np.zeros(1, np.int64)
        self.score, self.gap = np.zeros(0), np.zeros(0)
        self.paths: dict[int, tuple[list[float], list[np.ndarray]]] = {}

    def _learn(self) -> None:
        new = self.known.new
        if not new:
            return
        ids, ends, score, gap = self._best(*_laid(new))
        self.ids, self.ends = np.concatenate([self.ids, ids]), np.concatenate([self.ends, ends[1:] + self.ends[-1]])
        self.score, self.gap = np.concatenate([self.score, score]), np.concatenate([self.gap, gap])
        new.clear()

    def encode(self, texts: list[str]):
        """Per text: (ids of the best segmentation, scores of the N best)."""
        for ids, scores in self.segmentations(texts):
            yield ids[0], scores

    def segmentations(self, texts: list[str]):
        """Per text: (ids of each of the N best segmentations, their scores), best first."""
        if len(self.known) > CHUNKS:
            self._clear()
        elif len(self.paths) > PATHS:
            self.paths.clear()
        words = list(map(_chunks, texts))
        chunks = np.cumsum([0, *map(len, words)])
        which = np.fromiter(map(self.known.__getitem__, itertools.chain.from_iterable(words)), np.int64, int(chunks[-1]))
        self._learn()
        n_ids = self.ends[which + 1] - self.ends[which]
        to = np.concatenate([[0], np.cumsum(n_ids)])
        flat = self.ids[np.repeat(self.ends[which] - to[:-1], n_ids) + np.arange(to[-1])]
        score, every_gap = self.score[which], self.gap[which]
        nears = []
        for d in range(len(texts)):
            lo, hi = chunks[d], chunks[d + 1]
            gaps = every_gap[lo:hi]
            k = min(self.n_best - 1, len(gaps))
            near = np.argpartition(gaps, k - 1)[:k] if 0 < k < len(gaps) else np.arange(len(gaps))
            nears.append(np.sort(near[np.isfinite(gaps[near])]) + lo)
        at = np.concatenate(nears) if nears else np.zeros(0, np.int64)
        self._alternatives([(n, d, c) for n, d, c in zip(which[at].tolist(), np.searchsorted(chunks, at, "right").tolist(), at.tolist(), strict=True) if n not in self.paths], words, chunks)
        for d, near in enumerate(nears):
            lo, hi = chunks[d], chunks[d + 1]
            lists = [self.paths[w] for w in which[near].tolist()]
            best = merged(float(score[lo:hi].sum()), [s for s, _ in lists], self.n_best)
            made = []
            for _, choice in best:
                runs, at = [], to[lo]
                for c, i, (_, paths) in zip(near.tolist(), choice, lists, strict=True):
                    if i:
                        runs += [flat[at : to[c]], paths[i]]
                        at = to[c + 1]
                made.append(np.concatenate([*runs, flat[at : to[hi]]]) if runs else flat[to[lo] : to[hi]])
            yield made, [s for s, _ in best]

    def _best(self, chars: np.ndarray, base: np.ndarray):
        """Best ids of all chunks end to end and where each one's begin, scores, and gaps to the second best; lattices of RUN characters at a time."""
        ids, at, score, gap = [], [np.zeros(1, np.int64)], [], []
        for lo, hi in _cuts(base):
            lattices = Lattices(self.v, chars[base[lo] : base[hi]], base[lo : hi + 1] - base[lo])
            own, ends = lattices.best_ids()
            ids.append(own)
            at.append(ends[1:] + at[-1][-1])
            score.append(lattices.score)
            gap.append(lattices.gap)
        return tuple(map(np.concatenate, (ids, at, score, gap)))

    def _alternatives(self, wanted: list[tuple[int, int, int]], words: list[list[str]], chunks: np.ndarray) -> None:
        """Keeps scores and ids of the N best paths of the wanted chunks (number, text from 1, place); their lattices are made again, a few at a time."""
        wanted = list({n: (n, words[d - 1][c - int(chunks[d - 1])]) for n, d, c in wanted}.values())
        if not wanted:
            return
        chars, at = _laid([w for _, w in wanted])
        for lo, hi in _cuts(at):
            lattices = Lattices(self.v, chars[at[lo] : at[hi]], at[lo : hi + 1] - at[lo])
            for k, (n, _) in enumerate(wanted[lo:hi]):
                found = lattices.n_best(k, self.n_best)
                own = self.ids[self.ends[n] : self.ends[n + 1]].copy()
                # among equal scores the best path is the forward pass's one
                others = [np.array(x, np.int32) for _, x in found if x != own.tolist()]
                self.paths[n] = [s for s, _ in found], [own, *others][: len(found)]

    def restored(self, many: list[np.ndarray]) -> list[bytes]:
        """What each of several segmentations stands for, decoded in one go."""
        size = self.v.size[np.concatenate(many)] if many else np.zeros(0, np.int64)
        ends = np.concatenate([[0], np.cumsum(size, dtype=np.int64)])[np.cumsum([0, *map(len, many)])].tolist()
        # the first byte is the space that decode() leaves out
        out = b" " + self.decode(np.concatenate(many)) if many else b""
        return [out[a + 1 : b] for a, b in itertools.pairwise(ends)]

    def decode(self, ids: np.ndarray) -> bytes:
        v = self.v
        size = v.size[ids]
        end = np.cumsum(size, dtype=np.int64)
        n = int(end[-1]) if len(end) else 0
        kind = np.int32 if n < 1 << 31 else np.int64
        out = v.text[np.repeat((v.start[ids] - (end - size)).astype(kind), size) + np.arange(n, dtype=kind)].tobytes()
        return out[1:] if len(ids) else out


def _chunks(text: str) -> list[str]:
    """Spaces and what follows up to the next space, each without its first space; a text begins with one."""
    if "  " in text or text[:1] == " ":
        return [x[1:] for x in _SPACED.findall(" " + text)]
    return text.split(" ") if text else []


def _laid(chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Characters of chunks end to end, a space first in each, and where each one's begin."""
    c = np.frombuffer(" ".join(["", *chunks]).encode("utf-32-le"), np.uint32).astype(np.int64)
    c[c == SIGN] = _OWN_SIGN
    c[c == 32] = SIGN
    return c, np.cumsum([0, *(len(x) + 1 for x in chunks)])


def _coder(name: str, v: Vocabulary, n_best: int) -> Encoder:
    """One per worker process and query, which keeps its chunks from task to task."""
    while _timers:
        _timers.pop().cancel()
    coder = _coders.get(name) or Encoder(v, n_best)
    _coders.clear()
    _coders[name] = coder
    return coder


def _rest() -> None:
    """Drops the worker's encoder after REST seconds, unless a task takes it up before."""
    timer = threading.Timer(REST, _coders.clear)
    timer.daemon = True
    _timers.append(timer)
    timer.start()


def _cuts(base: np.ndarray):
    """Runs of chunks of about RUN characters together."""
    lo = 0
    while lo < len(base) - 1:
        hi = max(int(np.searchsorted(base, base[lo] + RUN, "right")) - 1, lo + 1)
        yield lo, hi
        lo = hi


def _slabs(texts: list[str]):
    at = 0
    while at < len(texts):
        to, size = at, 0
        while to < len(texts) and (to == at or size + len(texts[to]) < SLAB):
            size += len(texts[to])
            to += 1
        yield at, to
        at = to


def _lists(arrays: list[np.ndarray]) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum(list(map(len, arrays)))]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(arrays).astype(np.int32)))


def encode(documents: DataFrame, model: str = MODEL, n_best: int = N_BEST) -> DataFrame:
    """All columns of documents and ids (best segmentation), n_best_scores, n_best (score and ids of each), round_trip (of all)."""
    v = load(model)  # read on the driver; some megabytes, fixed by the vocabulary
    documents = documents.drop("ids", "n_best_scores", "n_best", "round_trip")
    path = T.StructType().add("score", T.DoubleType()).add("ids", T.ArrayType(T.IntegerType()))
    made = T.StructType().add("ids", T.ArrayType(T.IntegerType())).add("n_best_scores", T.ArrayType(T.DoubleType())).add("n_best", T.ArrayType(path)).add("round_trip", T.BooleanType())
    schema = T.StructType([*documents.schema.fields, *made.fields])
    text_at = documents.columns.index("text")

    name = uuid.uuid4().hex

    def run(batches):
        coder = _coder(name, v, n_best)
        try:
            for b in parts(batches):
                raw = utf8(b.column(text_at))
                texts = [x.decode() for x in raw]
                for at, to in _slabs(texts):
                    ids, scores = zip(*coder.segmentations(texts[at:to]), strict=True)
                    back = iter(coder.restored([x for xs in ids for x in xs]))
                    same = [all([next(back) == t for _ in xs]) for xs, t in zip(ids, raw[at:to], strict=True)]
                    best, every = _lists([xs[0] for xs in ids]), _lists([x for xs in ids for x in xs])
                    scores = pa.array(scores, pa.list_(pa.float64()))
                    listed = pa.ListArray.from_arrays(scores.offsets, pa.StructArray.from_arrays([scores.values, every], names=["score", "ids"]))
                    yield pa.RecordBatch.from_arrays([*b.slice(at, to - at).columns, best, scores, listed, pa.array(same)], names=schema.names)
        finally:
            _rest()

    return documents.mapInArrow(run, schema)


def decode(encoded: DataFrame, model: str = MODEL) -> DataFrame:
    """All columns of encoded and `decoded`, the text that its ids stand for."""
    v, encoded = load(model), encoded.drop("decoded")
    schema = T.StructType([*encoded.schema.fields, T.StructField("decoded", T.StringType())])
    ids_at = encoded.columns.index("ids")

    def run(batches):
        coder = Encoder(v)
        for b in parts(batches):
            texts = [coder.decode(np.array(x or [], np.int64)).decode() for x in b.column(ids_at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.string())], names=schema.names)

    return encoded.mapInArrow(run, schema)


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = encode(table(spark, sf_dir, "documents").select("doc_id", "text"))
    ids = F.sha2(F.concat_ws(",", F.transform("ids", lambda x: x.cast("string"))), 256)
    # every segmentation's ids are digested; as text that would cost more than the search
    every = F.transform("n_best", lambda x: F.xxhash64(x["ids"]))
    return made.select("doc_id", F.size("ids").cast("long").alias("n_pieces"), ids.alias("ids_sha256"), F.get("n_best_scores", F.lit(0)).alias("score"), "n_best_scores", every.alias("n_best_xxhash64"), "round_trip")
