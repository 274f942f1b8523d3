"""Product codes of vectors by Yinyang Lloyd rounds in integers.

Components become floor(scale * x); vectors are cut into equal consecutive parts, each with a
codebook of its own.  A codebook begins as the parts of the smallest vec_ids.  A
round assigns every part to its nearest entry (squared Euclidean distance, ties to the
lower index) and puts the floor of the mean in the place of each entry that has parts.

The entries of a codebook are clustered once into groups of about GROUP.  With each
part a row keeps its entry and, per group, a lower bound of the distance to the
group's other entries: an integer, rounded down.  After a round a bound falls by the largest
drift in its group, rounded up.  The distance to the own entry is computed, exactly; a group
is scanned only if its bound does not exceed that distance, so all ties are scanned, and what
is scanned is compared as integers by (distance, index).

A round is one pass of Spark tasks over the table of rows: each writes its rows with new
entries and bounds, and one row per entry with the sums of its own parts, to the shared
folder.  The driver sees the total of each entry, entries x dimensions numbers in all.  The
table of a round is removed when that of the next is written.

Defined results: rows whose vector is null or holds null or non-finite components go;
rows without vec_id come last in the order of ids; rows of one vec_id are ordered by
their vectors; repeated rows give a row each; vectors shorter than the longest, or whose length is
no multiple of the number of parts, count as padded with zeros; components and
errors beyond 64 bits saturate; fewer rows than entries give fewer entries; other
columns are not carried; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import math
import uuid
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .shared import shared_dir, table

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Entries per group of a codebook, about.
GROUP = 16
#: Rows that a task works on at once.
ROWS = 8192
_EXACT = float(1 << 53)
_FAR = (1 << 31) - 1
_MOST = (1 << 63) - 1


def _root(d: np.ndarray) -> np.ndarray:
    """Integer square roots, rounded down, of integers below 2^53 held in doubles."""
    s = np.floor(np.sqrt(d))
    return s - (s * s > d)


def _groups(entries: np.ndarray) -> np.ndarray:
    """Group numbers of entries: a few Lloyd steps over the codebook itself."""
    k = max(len(entries) // GROUP, 1)
    at = entries[np.linspace(0, len(entries) - 1, k).astype(int)]
    for _ in range(5):
        d = ((entries[:, None, :] - at[None]) ** 2).sum(2)
        own = d.argmin(1)
        at = np.stack([entries[own == g].mean(0) if (own == g).any() else at[g] for g in range(k)])
    return np.unique(own, return_inverse=True)[1]


class Codebook:
    """Entries of one part in exact integers, and their groups."""

    def __init__(self, entries: list[list[int]], groups: np.ndarray | None = None, before: Codebook | None = None) -> None:
        self.entries = entries
        self.values = np.array(entries, np.float64).reshape(len(entries), -1)
        self.largest = max((abs(v) for e in entries for v in e), default=0)
        self.groups = _groups(self.values) if groups is None else groups
        self.members = [np.flatnonzero(self.groups == g) for g in range(int(self.groups.max(initial=-1)) + 1)]
        self.square = (self.values**2).sum(1)
        #: how far a group's entries have moved at most, rounded up
        self.drift = [0] * len(self.members)
        if before:
            moved = [math.isqrt(sum((a - b) ** 2 for a, b in zip(x, y, strict=True))) + 1 if x != y else 0 for x, y in zip(entries, before.entries, strict=True)]
            self.drift = [min(max(moved[i] for i in m.tolist()), _FAR) for m in self.members]


def _plain(x: list[list[int]], book: Codebook) -> tuple[list[int], list[int]]:
    """Nearest entries in Python integers, for components too large for doubles."""
    own, error = [], []
    for v in x:
        d, e = min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), i) for i, c in enumerate(book.entries))
        own.append(e)
        error.append(min(d, _MOST))
    return own, error


def _first(x: np.ndarray, square: np.ndarray, book: Codebook) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Every entry scanned: nearest entries, squared distances, bounds per group."""
    d = square[:, None] - 2 * (x @ book.values.T) + book.square
    own, row = d.argmin(1), np.arange(len(x))
    best = d[row, own]
    d[row, own] = np.inf
    low = np.stack([d[:, m].min(1) for m in book.members], 1)
    return own, best, np.where(np.isinf(low), _FAR, np.minimum(_root(np.where(np.isinf(low), 0, low)), _FAR))


def _again(x: np.ndarray, square: np.ndarray, book: Codebook, was: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """As _first, from last round's entries and bounds; also how many distances were computed."""
    at = book.values[was]
    distance = square - 2 * np.einsum("ij,ij->i", x, at) + book.square[was]
    low = np.maximum(low - np.array(book.drift), 0)
    own, best, done = was.copy(), distance.copy(), len(x)
    least, second, arg = (np.full(low.shape, np.inf) for _ in range(3))
    for g, m in enumerate(book.members):
        # a bound above the rounded-down root is above the root itself, so nothing in the group comes as near
        rows = np.flatnonzero(low[:, g] <= _root(best))
        if not len(rows):
            continue
        d = square[rows, None] - 2 * (x[rows] @ book.values[m].T) + book.square[m]
        done += d.size
        first = d.argmin(1)
        near = d[np.arange(len(rows)), first]
        least[rows, g], arg[rows, g] = near, m[first]
        d[np.arange(len(rows)), first] = np.inf
        second[rows, g] = d.min(1)
        better = (near < best[rows]) | (near == best[rows]) & (m[first] < own[rows])
        own[rows[better]], best[rows[better]] = m[first[better]], near[better]
    scanned = np.isfinite(least)
    rest = np.where(arg == own[:, None], second, least)
    low = np.where(scanned, np.where(np.isinf(rest), _FAR, np.minimum(_root(np.where(np.isinf(rest), 0, rest)), _FAR)), low)
    left = np.flatnonzero(own != was)
    group = book.groups[was[left]]
    fresh = scanned[left, group]
    low[left[~fresh], group[~fresh]] = np.minimum(low[left[~fresh], group[~fresh]], _root(distance[left[~fresh]]))
    return own, best, low, done


def _assigned(x: np.ndarray, book: Codebook, was: np.ndarray | None, low: np.ndarray | None):
    """Entries, errors (64 bits), bounds and computed distances of the parts x (64-bit integers)."""
    n, groups = len(x), len(book.members)
    own, error, bounds, done = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros((n, groups), np.int64), 0
    size = np.maximum(np.abs(x.astype(np.float64)).max(1, initial=0), book.largest)
    exact = size * size * 4 * max(x.shape[1], 1) < _EXACT
    if exact.any():
        v = x[exact].astype(np.float64)
        square = (v**2).sum(1)
        if was is None:
            own[exact], error[exact], bounds[exact] = _first(v, square, book)
            done = len(v) * len(book.entries)
        else:
            own[exact], error[exact], bounds[exact], done = _again(v, square, book, was[exact], low[exact])
    if not exact.all():
        # bounds stay 0, which proves nothing
        own[~exact], error[~exact] = _plain(x[~exact].tolist(), book)
        done += int((~exact).sum()) * len(book.entries)
    return own, error, bounds, done


def _round(books: list[Codebook], last: bool):
    """Task of a pass: rows with new entries and bounds (or, in the last one, errors), then the sums of each entry."""
    groups = [len(b.members) for b in books]
    ends = np.cumsum([0, *groups])

    def run(batches: Iterator[pa.RecordBatch]):
        total = [[None] * len(b.entries) for b in books]
        count = [np.zeros(len(b.entries), np.int64) for b in books]
        done = 0
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                b = batch.slice(at, ROWS)
                x = b.column("v").flatten().to_numpy().reshape(b.num_rows, -1)
                width = x.shape[1] // len(books)
                begun = b.column("own").null_count == 0
                was = np.stack([np.frombuffer(r, np.uint16) for r in b.column("own").to_pylist()]).astype(np.int64) if begun else None
                low = np.stack([np.frombuffer(r, np.int32) for r in b.column("low").to_pylist()]).astype(np.int64) if begun else None
                own, lows, error = [], [], np.zeros(b.num_rows, np.int64)
                for p, book in enumerate(books):
                    part = x[:, p * width : (p + 1) * width]
                    near, e, bound, n = _assigned(part, book, was[:, p] if begun else None, low[:, ends[p] : ends[p + 1]] if begun else None)
                    own.append(near)
                    lows.append(bound)
                    error = np.where(error > _MOST - e, _MOST, error + np.minimum(e, _MOST - error))
                    done += n
                    if not last:
                        _add(total[p], count[p], part, near)
                own = np.stack(own, 1).astype(np.uint16)
                lows = np.concatenate(lows, 1).astype(np.int32)
                rows = [b.column("vec_id"), b.column("label"), b.column("v"), pa.array([r.tobytes() for r in own], pa.binary()), pa.array([r.tobytes() for r in lows], pa.binary()), pa.array(error)]
                nothing = [pa.nulls(b.num_rows, k) for k in (pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.decimal128(38, 0)))]
                yield pa.RecordBatch.from_arrays([*rows, *nothing], names=_NAMES)
        if last:
            return
        sums = [(p, e, int(count[p][e]), s) for p in range(len(books)) for e, s in enumerate(total[p]) if s is not None] + [(-1, 0, done, [])]
        part, entry, n, sums = zip(*sums, strict=True)
        listed = pa.array([list(map(Decimal, s)) for s in sums], pa.list_(pa.decimal128(38, 0)))
        kinds = [types["vec_id"], types["label"], pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.int64()]
        yield pa.RecordBatch.from_arrays([*(pa.nulls(len(n), k) for k in kinds), pa.array(part, pa.int32()), pa.array(entry, pa.int32()), pa.array(n, pa.int64()), listed], names=_NAMES)

    types: dict[str, pa.DataType] = {}
    return run, types


_NAMES = ["vec_id", "label", "v", "own", "low", "error", "part", "entry", "n", "sums"]


def _add(total: list, count: np.ndarray, x: np.ndarray, near: np.ndarray) -> None:
    """Adds rows to the exact sums of their entries."""
    most = int(np.abs(x.astype(np.float64)).max(initial=0))
    order = np.argsort(near, kind="stable")
    entries, first, size = np.unique(near[order], return_index=True, return_counts=True)
    ordered = x[order]
    if most * len(x) >= 1 << 62:
        ordered = ordered.astype(object)
    sums = np.add.reduceat(ordered, first, axis=0) if len(first) else ordered
    for e, n, s in zip(entries.tolist(), size.tolist(), sums.tolist(), strict=True):
        count[e] += n
        total[e] = s if total[e] is None else [a + b for a, b in zip(total[e], s, strict=True)]


def _removed(spark: SparkSession, path: str | None) -> None:
    if path:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def quantised(vectors: DataFrame, parts: int, scale: int) -> DataFrame:
    """vec_id, label and v, the integer components padded to one length, of the rows that take part."""
    number = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    good = vectors.where(F.col("embedding").isNotNull() & F.forall("embedding", number))
    longest = good.agg(F.max(F.size("embedding"))).first()[0] or 0
    width = -(-max(longest, 1) // parts) * parts
    v = F.transform("embedding", lambda x: F.floor(x.cast("double") * scale).cast("long"))
    v = F.concat(v, F.array_repeat(F.lit(0).cast("long"), F.lit(width) - F.size("embedding")))
    return good.select("vec_id", "label", v.alias("v"))


def compress(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> tuple[DataFrame, list[list[list[int]]], list[int]]:
    """vec_id, label, codes (0-based entries in part order), error of each vector; the codebooks; distances computed per round."""
    spark = vectors.sparkSession
    rows = quantised(vectors, parts, scale)
    begin = [r["v"] for r in rows.orderBy(F.asc_nulls_last("vec_id"), "v").limit(entries).collect()]
    width = len(begin[0]) // parts if begin else 0
    books = [Codebook([v[p * width : (p + 1) * width] for v in begin]) for p in range(parts)] if begin else []
    kinds = {c: rows.schema[c].dataType for c in ("vec_id", "label")}
    schema = f"vec_id {kinds['vec_id'].simpleString()}, label {kinds['label'].simpleString()}, v array<long>, own binary, low binary, error long, part int, entry int, n long, sums array<decimal(38,0)>"
    rows = rows.withColumns({"own": F.lit(None).cast("binary"), "low": F.lit(None).cast("binary")})
    folder, before, work = shared_dir(spark), None, []
    for k in range(rounds + 1 if begin else 0):
        run, types = _round(books, k == rounds)
        types |= {c: to_arrow_type(t) for c, t in kinds.items()}
        path = f"{folder}/codes-{uuid.uuid4().hex}"
        made = rows.mapInArrow(run, schema)
        if k == rounds:
            made = made.select("vec_id", "label", "own", "error")
        made.write.option("compression", "zstd").parquet(path)
        _removed(spark, before)
        before, written = path, spark.read.schema(made.schema).parquet(path)
        if k == rounds:
            rows = written
            break
        rows = written.where("n is null").select("vec_id", "label", "v", "own", "low")
        sums = written.where("n is not null").select("part", "entry", "n", "sums")
        work.append(sums.where("part < 0").agg(F.sum("n")).first()[0])
        at = sums.select("part", "entry", "n", F.posexplode("sums").alias("pos", "s")).groupBy("part", "entry", "pos").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
        new = [[list(e) for e in b.entries] for b in books]
        for r in at.collect():  # entries x dimensions
            new[r["part"]][r["entry"]][r["pos"]] = int(r["s"]) // r["n"]
        books = [Codebook(e, b.groups, b) for e, b in zip(new, books, strict=True)]
    # two bytes an entry, the low one first
    byte = lambda i: F.conv(F.hex(F.substring("own", i, 1)), 16, 10).cast("int")
    codes = F.array(*(byte(2 * p + 1) + 256 * byte(2 * p + 2) for p in range(parts)))
    return (rows if begin else rows.withColumn("error", F.lit(0).cast("long"))).select("vec_id", "label", codes.alias("codes"), "error"), [b.entries for b in books], work


def decode(codes, books: list[list[list[int]]], scale: int = SCALE):
    """Column of approximate vectors: the middles of the cells that the entries' integers stand for."""
    tables = [F.array(*(F.array(*(F.lit((v + 0.5) / scale) for v in e)) for e in b)) for b in books]
    return F.concat(*(F.get(t, F.get(codes, F.lit(p))) for p, t in enumerate(tables)))


def label_errors(coded: DataFrame) -> DataFrame:
    """coded with label_error, the sum of errors over equal labels (nulls together).

    The labels of more than 1 / 256 of the rows each, under 256 of them, are
    joined by broadcast; the others by a shuffle in which none is hot.
    """
    per = coded.groupBy("label").agg(F.sum(F.col("error").cast("decimal(38,0)")).alias("s"), F.count("*").alias("c"))
    per = per.select(F.col("label").alias("key"), F.least("s", F.lit(_MOST)).cast("long").alias("label_error"), "c")
    most = coded.count() / 256
    hot, cold = F.broadcast(per.where(F.col("c") > most).drop("c")), per.where(F.col("c") <= most).drop("c")
    same = coded["label"].eqNullSafe(F.col("key"))
    rest = coded.join(hot, same, "left_anti").join(cold, same)
    return coded.join(hot, same).unionByName(rest).drop("key")


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books, _ = compress(table(spark, sf_dir, "embeddings"))
    digest = hashlib.sha256(",".join(str(v) for b in books for e in b for v in e).encode()).hexdigest()
    code = F.lower(F.concat_ws("", F.transform("codes", lambda c: F.lpad(F.hex(c), 2, "0"))))
    return label_errors(coded.select("vec_id", "label", code.alias("code"), "error")).select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def _sql() -> str:
    """The rounds written out, each a nearest entry by (distance, index) and a floor of means."""
    near = "SELECT pt.r, pt.p, pt.c, min((pt.q - 2 * cast(list_inner_product(pt.c, b.c) AS hugeint) + cast(list_inner_product(b.c, b.c) AS hugeint)) * 256 + b.e) AS k FROM pt JOIN b{0} b ON b.p = pt.p GROUP BY pt.r, pt.p, pt.c"
    steps = []
    for k in range(ROUNDS + 1):
        steps.append(f"a{k} AS MATERIALIZED ({near.format(k)})")
        if k < ROUNDS:
            steps.append(
                f"m{k} AS (SELECT p, e, list(floor_mean ORDER BY i) AS c FROM (SELECT p, cast(k % 256 AS int) AS e, i, cast((sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) // count(*) AS double) AS floor_mean"
                f" FROM (SELECT p, k, unnest(range(len(c))) AS i, cast(unnest(c) AS bigint) AS x FROM a{k}) GROUP BY p, e, i) GROUP BY p, e)"
            )
            steps.append(f"b{k + 1} AS MATERIALIZED (SELECT b.p, b.e, coalesce(m.c, b.c) AS c FROM b{k} b LEFT JOIN m{k} m ON m.p = b.p AND m.e = b.e)")
    return f"""
WITH v AS (SELECT vec_id, label, list_transform(embedding, lambda x: floor({SCALE} * cast(x AS double))) AS v FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
n AS (SELECT *, row_number() OVER (ORDER BY vec_id NULLS LAST, v) AS r, len(v) // {PARTS} AS w FROM v),
pt AS MATERIALIZED (SELECT r, p, c, cast(list_inner_product(c, c) AS hugeint) AS q FROM (SELECT r, p, v[p * w + 1:p * w + w] AS c FROM n, range({PARTS}) t(p))),
b0 AS MATERIALIZED (SELECT p, cast(r - 1 AS int) AS e, c FROM pt WHERE r <= {ENTRIES}),
{", ".join(steps)},
d AS (SELECT r, string_agg(printf('%02x', cast(k % 256 AS int)), '' ORDER BY p) AS code, cast(sum(k // 256) AS bigint) AS error FROM a{ROUNDS} GROUP BY r),
s AS (SELECT sha256(string_agg(array_to_string(list_transform(c, lambda x: cast(cast(x AS bigint) AS varchar)), ','), ',' ORDER BY p, e)) AS h FROM b{ROUNDS})
SELECT n.vec_id, d.code, d.error, cast(sum(d.error) OVER (PARTITION BY n.label) AS bigint) AS label_error, s.h AS codebooks_sha256
FROM n JOIN d USING (r), s
"""


OP11_SQL = _sql()
