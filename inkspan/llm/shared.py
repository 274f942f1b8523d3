"""What the operators share: the shared folder, lineage cuts and byte-level words."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

#: Bytes of text that a Python worker turns into arrays at once.
SLAB = 1 << 19

#: Rolling hashes are polynomials modulo this prime, at fixed random bases, one per lane.
_PRIME = (1 << 61) - 1
_BASES = (0x1B7C4A35D29E6F83, 0x0A5D3E91C7F2486B)
#: Bytes that a Rolling covers at most.
SPAN = (1 << 20) + 8192
#: Places within a word that the table of mixed bytes covers.
_PLACES = 48
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}
_mixed: dict[int, np.ndarray] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the session names it.

    Only where the cluster names none (local tests) a temporary one is made.
    """
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if named:
        return named
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    made = "file://" + tempfile.mkdtemp(prefix="inkspan-")
    spark.sparkContext.setCheckpointDir(made)
    return made


def cut(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and go on from there, so lost executors cost no recomputation."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def saved(df: DataFrame, kind: str) -> DataFrame:
    """df as a compressed table in the shared folder: smaller than a checkpoint, and read by columns."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{kind}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class Words(dict):
    """Numbers words in order of appearance and remembers which are new."""

    def __init__(self) -> None:
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        n = self[word] = len(self)
        self.new.append(word)
        return n


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser that spreads all 64 bits (splitmix64)."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _reduced(x: np.ndarray) -> np.ndarray:
    x = (x & np.uint64(_PRIME)) + (x >> np.uint64(61))
    return np.where(x >= np.uint64(_PRIME), x - np.uint64(_PRIME), x)


def _times(a: np.ndarray, b) -> np.ndarray:
    """Products modulo the prime, from 31-bit halves."""
    half, low = np.uint64(31), np.uint64((1 << 31) - 1)
    ah, al, bh, bl = a >> half, a & low, b >> half, b & low
    middle = ah * bl + al * bh
    top, rest = middle >> np.uint64(30), middle & np.uint64((1 << 30) - 1)
    return _reduced(((ah * bh) << np.uint64(1)) + top + (rest << half) + al * bl)


def _powers_of(lane: int) -> tuple[np.ndarray, np.ndarray]:
    """High and low halves of the base's powers 0 to SPAN."""
    if lane not in _powers:
        p, base = np.ones(1, np.uint64), _BASES[lane]
        while len(p) <= SPAN:
            p = np.concatenate([p, _times(p, np.uint64(pow(base, len(p), _PRIME)))])
        p = p[: SPAN + 1]
        _powers[lane] = (p >> np.uint64(31)).astype(np.uint32), (p & np.uint64((1 << 31) - 1)).astype(np.uint32)
    return _powers[lane]


class Rolling:
    """Hashes of any substring of at most SPAN bytes in O(1), from prefix sums of b[i] * B^i modulo a 61-bit prime."""

    def __init__(self, data: np.ndarray, lane: int = 0) -> None:
        n = len(data)
        if n > SPAN:
            raise ValueError(f"{n} bytes are more than {SPAN}")
        self.high_powers, self.low_powers = _powers_of(lane)
        own = data.astype(np.uint64) + np.uint64(1)
        self.high, self.low = np.zeros(n + 1, np.uint64), np.zeros(n + 1, np.uint64)
        np.cumsum(own * self.high_powers[:n], out=self.high[1:])
        np.cumsum(own * self.low_powers[:n], out=self.low[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        high, low = _reduced(self.high[end] - self.high[start]), _reduced(self.low[end] - self.low[start])
        h = _reduced(_times(high, np.uint64(1 << 31)) + low)
        # the same exponent for equal strings, wherever they begin
        up = (self.high_powers[SPAN - start].astype(np.uint64) << np.uint64(31)) | self.low_powers[SPAN - start]
        return mix(_times(h, up) + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def _mixed_bytes(lane: int) -> np.ndarray:
    if lane not in _mixed:
        _mixed[lane] = mix((np.arange(_PLACES * 256, dtype=np.uint64) + np.uint64(1)) * _GOLDEN + mix(np.array([lane + 1], np.uint64) * _GOLDEN))
    return _mixed[lane]


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, lane: int = 0) -> np.ndarray:
    """64-bit hashes of words, which lie one after the other: sums of what each pair of a symbol and its place is mixed into.

    Lanes give independent values.  data holds bytes, or characters below 2^21.
    """
    if not len(start):
        return np.zeros(0, np.uint64)
    n = int(end[-1])
    own = data[:n]
    bounds = np.concatenate([[0], start, [n]])
    place = np.arange(n) - np.repeat(bounds[:-1], np.diff(bounds))
    table = _mixed_bytes(lane)
    if own.dtype == np.uint8:
        x = table[np.minimum(place, _PLACES - 1) * 256 + own]
        far = np.nonzero(place >= _PLACES)[0]
    else:
        x, far = np.empty(n, np.uint64), np.arange(n)
    if len(far):
        x[far] = mix((place[far].astype(np.uint64) << np.uint64(21) | own[far].astype(np.uint64)) * _GOLDEN + table[0])
    # sums by differences of running sums, modulo 2^64
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(x, out=total[1:])
    return mix(total[end] - total[start] + (end - start).astype(np.uint64) * _GOLDEN)


def exact_codes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Small numbers of words, equal for equal words only: words of one hash are compared symbol by symbol."""
    codes, values = pd.factorize(word_hashes(data, start, end))
    first = np.zeros(len(values), np.int64)
    first[codes[::-1]] = np.arange(len(codes))[::-1]
    size, twin = end - start, first[codes]
    if (size == size[twin]).all():
        off = np.cumsum(size) - size
        at = np.arange(int(size.sum()))
        if (data[np.repeat(start - off, size) + at] == data[np.repeat(start[twin] - off, size) + at]).all():
            return codes
    seen: dict[bytes, int] = {}
    return np.array([seen.setdefault(data[s:e].tobytes(), len(seen)) for s, e in zip(start.tolist(), end.tolist(), strict=True)], np.int64)


def lowered(data: np.ndarray) -> np.ndarray:
    """A-Z to a-z; bytes of other characters stay."""
    return np.where((data >= 65) & (data <= 90), data | 32, data)


def slabs(texts: list[bytes], limit: int = SLAB):
    """Runs of texts of about `limit` bytes: (first, last, bytes of the texts, each followed by a line feed, starts)."""
    i = 0
    while i < len(texts):
        j, size = i, 0
        while j < len(texts) and (j == i or size + len(texts[j]) < limit):
            size += len(texts[j]) + 1
            j += 1
        data = np.frombuffer(b"\n".join(texts[i:j]) + b"\n", np.uint8)
        starts = np.zeros(j - i + 1, np.int64)
        np.cumsum([len(x) + 1 for x in texts[i:j]], out=starts[1:])
        yield i, j, data, starts
        i = j


def word_spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of bytes other than space and 0x09-0x0D."""
    inside = np.ones(len(data) + 2, np.int8)
    inside[0] = inside[-1] = 0
    inside[1:-1][(data == 32) | ((data >= 9) & (data <= 13))] = 0
    edge = np.diff(inside)
    return np.nonzero(edge == 1)[0], np.nonzero(edge == -1)[0]


def parts(batches, rows: int = 500):
    """Arrow batches in slices of so many rows, so that a worker holds few texts as Python objects at once."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def utf8(column) -> list[bytes]:
    """The UTF-8 bytes of an Arrow string column; null gives none."""
    import pyarrow as pa

    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]
