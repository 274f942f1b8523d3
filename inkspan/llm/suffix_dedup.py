"""Suffix-array deduplication of repeated strings by prefix-free parsing.

Every byte is removed that lies in a string of LENGTH bytes which also starts
anywhere else in the corpus, judged on the input.

1. Parse.  A rolling hash over WIDTH bytes triggers where it is the least within
   REACH bytes on both sides.  Whether a place triggers depends only on the bytes
   around it, so equal strings trigger alike.  Every LENGTH-byte window belongs to
   its first trigger; the union of a trigger's windows is its phrase, which overlaps
   the next ones.  A row (key: hash of the KEY bytes after the trigger, phrase hash,
   place) is all that is shuffled of a phrase.
2. Dictionary and parse.  Keys that occur once cannot be in a repeated window and
   go.  A phrase that occurs twice or more repeats as a whole, which settles all its
   windows; thousands of copies are one dictionary entry with a count.
3. Suffix arrays.  Entries that occur once, and those they share a key with, are
   fetched.  Their right parts (the corpus from the trigger on) and their reversed
   left parts are sorted, each with the lengths of prefixes that neighbours share.
   For a window that begins `a` bytes before its trigger, cutting the left order
   where less than `a` bytes are shared and the right order where less than
   LENGTH - a are shared gives the classes of equal windows.
4. Windows without a usable trigger (long runs of one pattern) are phrases of their
   own.  Entries of keys with more than HOT different ones are cut into runs of windows
   under longer keys, whose groups are solved like the others.  Runs whose longer key has
   more than HOT of them are split into windows, counted by their fingerprints with
   partial aggregation, so no task gathers a hot key.

The suffix array of the parse, and with it the order of the whole corpus, is not built:
phrases overlap so far that every window lies inside one, so no match needs what follows
in the parse, and only entries that share a key have to be ordered among each other.

Fingerprints have 128 bits, from two independent rolling hashes modulo a prime; entries
that share only a key are compared byte by byte.

Defined results: null and empty texts have no bytes; texts under LENGTH bytes keep
all; equal texts repeat each other, also when a whole row is repeated; rows are
told apart by the hash of doc_id and text; further columns stay out of the result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import SLAB, Rolling, cut, mix, parts, saved, table

LENGTH = 200
WIDTH = 8
REACH = 28
KEY = 48
BLOCK = 1 << 20
HOT = 2000
#: Windows of a hot key's entries that stay together when its key is made longer.
STEP = 16
FILTER = 1 << 20
_FAR = LENGTH - KEY


def triggers(data: np.ndarray) -> np.ndarray:
    """Places whose rolling hash is the least among REACH neighbours on both sides."""
    n = len(data) - WIDTH + 1
    span = 2 * REACH + 1
    if n < span:
        return np.zeros(0, np.int64)
    h = np.ndarray((n,), "<u8", np.ascontiguousarray(data), 0, (1,)) * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    least, k = h, 1
    while k * 2 <= span:
        least = np.minimum(least[:-k], least[k:])
        k *= 2
    if span > k:
        least = np.minimum(least[: len(least) - (span - k)], least[span - k :])
    return np.nonzero(h[REACH : n - REACH] == least)[0] + REACH


def pack(start: np.ndarray, n: np.ndarray, a: np.ndarray) -> np.ndarray:
    """Start of the first window, number of windows, bytes from the first window to the trigger (-1: none)."""
    return (start.astype(np.int64) << 32) | (n.astype(np.int64) << 8) | (a.astype(np.int64) + 1)


def located(part: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a piece of a text: triggers that windows belong to, their first and last windows, and windows that belong to none."""
    last = len(part) - LENGTH
    t = triggers(part)
    before = np.concatenate([[REACH - 1], t[:-1]]) if len(t) else t
    lo = np.maximum(np.maximum(before - REACH + 1, t - _FAR), 0)
    hi = np.minimum(t - REACH, last)
    ok = lo <= hi
    a, b = lo[ok], hi[ok]
    step = np.zeros(last + 2, np.int32)
    np.add.at(step, a, 1)
    np.add.at(step, b + 1, -1)
    return t[ok], a, b, np.nonzero(np.cumsum(step)[:-1] == 0)[0]


def pieces_of(text: np.ndarray):
    """(place in the text, bytes) of pieces that hold each window once."""
    for at in range(0, len(text) - LENGTH + 1, BLOCK):
        yield at, text[at : at + BLOCK + LENGTH - 1]


def phrases(pieces: list[tuple[int, int, np.ndarray]]) -> tuple[np.ndarray, ...]:
    """(key, fingerprint in two halves, doc, packed place) of the phrases of pieces (doc, place, bytes), hashed in one go."""
    found = [located(part) for _, _, part in pieces]
    size = np.array([len(part) for _, _, part in pieces], np.int64)
    off = np.cumsum(size) - size
    data = np.concatenate([part for _, _, part in pieces])
    one, two = Rolling(data), Rolling(data, 1)
    docs, places = np.array([d for d, _, _ in pieces], np.int64), np.array([p for _, p, _ in pieces], np.int64)

    def spread(k: int) -> tuple[np.ndarray, np.ndarray]:
        own = np.repeat(np.arange(len(pieces)), [len(f[k]) for f in found])
        return own, np.concatenate([f[k] for f in found]) + off[own]

    own, t = spread(0)
    (_, a), (_, b) = spread(1), spread(2)
    shape = mix(((t - a) * 256 + (b - a)).astype(np.uint64))
    out = [(one.of(t, t + KEY), one.of(a, b + LENGTH) ^ shape, two.of(a, b + LENGTH) ^ shape, docs[own], pack(a - off[own] + places[own], b - a + 1, t - a))]
    own, i = spread(3)
    if len(i):
        h, h2 = one.of(i, i + LENGTH), two.of(i, i + LENGTH)
        # equal windows one after the other are one entry
        first = np.nonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (h2[1:] != h2[:-1]) | (np.diff(i) != 1)]))[0]
        runs = np.diff(np.concatenate([first, [len(i)]]))
        o = own[first]
        out.append((mix(h[first] + np.uint64(1)), h[first], h2[first], docs[o], pack(i[first] - off[o] + places[o], runs, np.full(len(first), -1))))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _parse(docs: DataFrame) -> DataFrame:
    def rows(pieces):
        k, u, v, d, p = phrases(pieces)
        for at in range(0, len(k), 50_000):
            s = slice(at, at + 50_000)
            yield pa.RecordBatch.from_arrays([pa.array(k[s].astype(np.int64)), pa.array(u[s].astype(np.int64)), pa.array(v[s].astype(np.int64)), pa.array(d[s]), pa.array(p[s])], names=["k", "u", "v", "doc", "place"])

    def run(batches):
        for b in batches:
            ids, texts = b.column(0).to_numpy(), b.column(1)
            held, size = [], 0
            for i in range(b.num_rows):
                text = texts[i].as_py()
                if text is None:
                    continue
                for at, part in pieces_of(np.frombuffer(text, np.uint8)):
                    if held and size + len(part) > SLAB:
                        yield from rows(held)
                        held, size = [], 0
                    held.append((int(ids[i]), at, part))
                    size += len(part)
            if held:
                yield from rows(held)

    return docs.select("doc", "bytes").mapInArrow(run, "k long, u long, v long, doc long, place long")


def _entries(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """The bytes of the wanted dictionary entries: wanted has doc, place, c, nu."""
    per_doc = wanted.groupBy("doc").agg(F.collect_list(F.struct("place", "c", "nu")).alias("want"))
    both = _only(docs, wanted).join(per_doc, "doc").select("doc", "bytes", "want.place", "want.c", "want.nu")

    def run(batches):
        for b in parts(batches):
            docs_, texts = b.column(0).to_pylist(), b.column(1)
            for i, d in enumerate(docs_):
                text = texts[i].as_py()
                place = np.array(b.column(2)[i].as_py(), np.int64)
                start, n = place >> 32, (place >> 8) & 0xFFFFFF
                found = [text[s : s + m + LENGTH - 1] for s, m in zip(start.tolist(), n.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array([d] * len(found), pa.int64()), pa.array(place), b.column(3)[i].values, b.column(4)[i].values, pa.array(found, pa.binary())], names=["doc", "place", "c", "nu", "bytes"])

    return both.mapInArrow(run, "doc long, place long, c long, nu long, bytes binary")


def _only(docs: DataFrame, wanted: DataFrame, kind: str = "left_semi", key: str = "doc") -> DataFrame:
    """The documents that can be among wanted, by a filter of at most FILTER places."""
    at = lambda c: F.pmod(F.xxhash64(c), F.lit(FILTER))
    return docs.withColumn("__at", at(key)).join(F.broadcast(wanted.select(at(key).alias("__at")).distinct()), "__at", kind).drop("__at")


def suffix_order(parts: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    """(rank of each part, bytes shared by each part with the one before it in order)."""
    order = np.array(sorted(range(len(parts)), key=parts.__getitem__), np.int64)
    rank = np.empty(len(parts), np.int64)
    rank[order] = np.arange(len(parts))
    shared = np.zeros(len(parts), np.int64)
    for at in range(0, len(parts), 20_000):  # a bounded matrix at a time
        some = [parts[i] for i in order[max(at - 1, 0) : at + 20_000]]
        m = np.frombuffer(b"".join(x.ljust(width, b"\0") for x in some), np.uint8).reshape(-1, width)
        size = np.array([len(x) for x in some])
        differ = m[1:] != m[:-1]
        lcp = np.where(differ.any(axis=1), differ.argmax(axis=1), width)
        shared[max(at, 1) : max(at, 1) + len(lcp)] = np.minimum(lcp, np.minimum(size[1:], size[:-1]))
    return rank, shared


def repeated_windows(entries: list[bytes], a: np.ndarray, n: np.ndarray, count: np.ndarray) -> list[np.ndarray]:
    """For each entry, which of its n windows also start elsewhere among all entries.

    Entry i begins a[i] bytes before its trigger and occurs count[i] times.
    """
    left = [e[:k][::-1] for e, k in zip(entries, a.tolist(), strict=True)]
    right = [e[k:] for e, k in zip(entries, a.tolist(), strict=True)]
    l_rank, l_shared = suffix_order(left, _FAR)
    r_rank, r_shared = suffix_order(right, LENGTH)
    out = [np.zeros(k, bool) for k in n.tolist()]
    for back in range(int((a - n + 1).min()), int(a.max()) + 1):
        live = np.nonzero((back <= a) & (back > a - n))[0]
        if not len(live):
            continue
        l_class = np.cumsum(l_shared < back)[l_rank[live]]
        r_class = np.cumsum(r_shared < LENGTH - back)[r_rank[live]]
        _, which = np.unique(l_class * (len(entries) + 1) + r_class, return_inverse=True)
        twice = np.bincount(which, weights=count[live])[which] >= 2
        for i in live[twice].tolist():
            out[i][a[i] - back] = True
    return out


def _runs(doc: int, start: int, flags: np.ndarray) -> list[tuple[int, int, int]]:
    edge = np.diff(np.concatenate([[0], flags.astype(np.int8), [0]]))
    return [(doc, start + i, j - i) for i, j in zip(np.nonzero(edge == 1)[0].tolist(), np.nonzero(edge == -1)[0].tolist(), strict=True)]


def _solve(pdf: pd.DataFrame) -> pd.DataFrame:
    place = pdf["place"].to_numpy()
    start, n, a = place >> 32, (place >> 8) & 0xFFFFFF, (place & 0xFF) - 1
    out = []
    flags = repeated_windows(list(pdf["bytes"]), a, n, pdf["c"].to_numpy())
    for d, s, c, f in zip(pdf["doc"].tolist(), start.tolist(), pdf["c"].tolist(), flags, strict=True):
        if c == 1 and f.any():
            out += _runs(d, s, f)
    return pd.DataFrame(out, columns=["doc", "start", "n"]).astype("int64")


def _longer(batches):
    """Entries with a hot key, cut into runs of at most STEP windows, under longer keys.

    A run holds the windows whose first byte lies q * STEP to q * STEP + STEP - 1 bytes before the trigger.
    All windows of such a place share LENGTH - STEP + 1 bytes, so equal windows have one key.
    """
    for b in parts(batches):
        rows = []
        for d, place, c, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(4).to_pylist(), strict=True):
            start, n, a = place >> 32, (place >> 8) & 0xFFFFFF, (place & 0xFF) - 1
            one = Rolling(np.frombuffer(text, np.uint8))
            for q in range(max(a - n + 1, 0) // STEP, a // STEP + 1):
                lo, hi = max(a - q * STEP - STEP + 1, 0), min(a - q * STEP, n - 1)
                core = np.array([a - q * STEP])
                key = int(mix(one.of(core, core + LENGTH - STEP + 1) + np.uint64(q))[0].astype(np.int64))
                rows.append((key, d, ((start + lo) << 32) | ((hi - lo + 1) << 8) | (a - lo + 1), c, text[lo : hi + LENGTH]))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*rows, strict=True), (pa.int64(),) * 4 + (pa.binary(),), strict=True)], names=["k", "doc", "place", "c", "bytes"])


def _windows(batches):
    """Each window of entries with a hot key: its fingerprint, place and count."""
    for b in parts(batches):
        for d, place, c, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(4).to_pylist(), strict=True):
            i = np.arange((place >> 8) & 0xFFFFFF)
            own = np.frombuffer(text, np.uint8)
            h, h2 = (pa.array(Rolling(own, lane).of(i, i + LENGTH).astype(np.int64)) for lane in (0, 1))
            yield pa.RecordBatch.from_arrays([h, h2, pa.array(np.full(len(i), d)), pa.array(i + (place >> 32)), pa.array(np.full(len(i), c))], names=["h", "h2", "doc", "start", "c"])


def repeated(docs: DataFrame) -> DataFrame:
    """(doc, start, n): n windows from start on that also start elsewhere; docs has doc, bytes."""
    weight = F.when(F.col("place").bitwiseAND(255) == 0, F.shiftright("place", 8).bitwiseAND(0xFFFFFF)).otherwise(1)
    rows = _parse(docs)
    # counts are cut from the joins that use them, so that these may split a hot key's rows over tasks
    keys = cut(rows.select("k", weight.alias("w")).groupBy("k").agg(F.sum("w").alias("w")).where("w > 1").select("k"))
    parse = saved(rows.join(keys, "k"), "suffix")
    entries = cut(parse.groupBy("k", "u", "v").agg(F.sum(weight).alias("c"), F.min(F.struct("doc", "place")).alias("first")))
    whole = parse.join(entries.where("c > 1").select("k", "u", "v"), ["k", "u", "v"]).select("doc", F.shiftright("place", 32).alias("start"), F.shiftright("place", 8).bitwiseAND(0xFFFFFF).alias("n"))
    open_ = entries.groupBy("k").agg(F.count("*").alias("nu"), F.min("c").alias("least")).where("nu > 1 AND least = 1").select("k", "nu")
    wanted = saved(entries.join(open_, "k").select("first.doc", "first.place", "c", "nu", "k"), "suffix")
    total = wanted.count()
    fetched = saved(_entries(docs, wanted), "suffix")
    # the key is read again from the bytes after the trigger
    key = F.xxhash64(F.substring("bytes", F.col("place").bitwiseAND(255).cast("int"), KEY))

    def solved(few: DataFrame, key: Column, n: int) -> DataFrame:
        return few.withColumn("pack", F.pmod(key, F.lit(max(1, n // 10_000)))).groupBy("pack").applyInPandas(_solve, "doc long, start long, n long")

    out = whole.unionByName(solved(fetched.where(F.col("nu") <= HOT), key, total))
    if wanted.where(F.col("nu") > HOT).limit(1).count():
        # longer keys part the entries of a hot one; only those that share these, too, are split into windows
        runs = saved(fetched.where(F.col("nu") > HOT).mapInArrow(_longer, "k long, doc long, place long, c long, bytes binary"), "suffix")
        groups = cut(runs.groupBy("k").agg(F.count("*").alias("nu"), F.min("c").alias("least")).where("nu > 1 AND least = 1").select("k", "nu"))
        shared = runs.join(groups, "k")
        n = groups.where(F.col("nu") <= HOT).agg(F.sum("nu")).first()[0] or 0
        out = out.unionByName(solved(shared.where(F.col("nu") <= HOT), F.col("k"), n))
        if groups.where(F.col("nu") > HOT).limit(1).count():
            most = shared.where(F.col("nu") > HOT).select("doc", "place", "c", "nu", "bytes")
            hot = most.mapInArrow(_windows, "h long, h2 long, doc long, start long, c long")
            twice = hot.groupBy("h", "h2").agg(F.sum("c").alias("w")).where("w > 1").select("h", "h2")
            out = out.unionByName(hot.where("c = 1").join(twice, ["h", "h2"]).select("doc", "start", F.lit(1).cast("long").alias("n")))
    return out


def _covered(start: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal removed runs."""
    order = np.argsort(start, kind="stable")
    s, e = start[order], np.maximum.accumulate((start + n + LENGTH - 1)[order])
    new = np.concatenate([[True], s[1:] > e[:-1]]) if len(s) else np.zeros(0, bool)
    first = np.nonzero(new)[0]
    return s[first], e[np.concatenate([first[1:] - 1, [len(s) - 1]])] if len(s) else e


def removed_spans(documents: DataFrame) -> DataFrame:
    """All rows of documents with `__bytes` and the sorted removed spans `__from`, `__to` (empty arrays: none)."""
    keyed = documents.withColumn("__doc", F.xxhash64("doc_id", "text"))
    docs = keyed.select(F.col("__doc").alias("doc"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("bytes")).where(F.length("bytes") >= LENGTH)
    found = repeated(docs).groupBy("doc").agg(F.collect_list("start").alias("start"), F.collect_list("n").alias("n"))

    def run(batches):
        for b in batches:
            lo, hi = [], []
            for s, n in zip(b.column(1), b.column(2), strict=True):
                x, y = _covered(np.array(s.as_py(), np.int64), np.array(n.as_py(), np.int64))
                lo.append(x)
                hi.append(y)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(lo, pa.list_(pa.int64())), pa.array(hi, pa.list_(pa.int64()))], names=["doc", "lo", "hi"])

    spans = saved(found.mapInArrow(run, "doc long, lo array<long>, hi array<long>"), "suffix").toDF("__doc", "__lo", "__hi")
    none = F.expr("cast(array() as array<long>)")
    clean = _only(keyed, spans, "left_anti", "__doc").withColumns({"__from": none, "__to": none})
    hit = _only(keyed, spans, "left_semi", "__doc").join(spans, "__doc", "left").withColumns({"__from": F.coalesce("__lo", none), "__to": F.coalesce("__hi", none)}).drop("__lo", "__hi")
    return clean.unionByName(hit).drop("__doc")


def kept_bytes(text: bytes, lo: list[int], hi: list[int]) -> bytes:
    out, at = [], 0
    for x, y in zip(lo, hi, strict=True):
        out.append(text[at:x])
        at = y
    return b"".join([*out, text[at:]])


def report(documents: DataFrame) -> DataFrame:
    spans = removed_spans(documents.select("doc_id", "text"))

    def run(batches):
        for b in parts(batches):
            texts = [x or b"" for x in b.column(1).cast(pa.binary()).to_pylist()]
            lo, hi = b.column(2).to_pylist(), b.column(3).to_pylist()
            kept = [hashlib.sha256(kept_bytes(*x)).hexdigest() for x in zip(texts, lo, hi, strict=True)]
            gone = [sum(y) - sum(x) for x, y in zip(lo, hi, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(list(map(len, texts)), pa.int64()), pa.array(gone, pa.int64()), pa.array(list(map(len, lo)), pa.int64()), pa.array(kept)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    kind = documents.schema["doc_id"].dataType.simpleString()
    return spans.select("doc_id", "text", "__from", "__to").mapInArrow(run, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def _kept_text(text: str | None, lo: list[int], hi: list[int]) -> str | None:
    if text is None or not lo:
        return text
    b = text.encode()
    inside = lambda i: i < len(b) and b[i] & 0xC0 == 0x80
    for ends in (lo, hi):
        for i in range(len(ends)):
            while inside(ends[i]):
                ends[i] += 1
    return kept_bytes(b, lo, hi).decode()


def remove_repeats(documents: DataFrame) -> DataFrame:
    """The documents without their repeated strings; a character goes only if all its bytes do."""
    spans = removed_spans(documents)

    @F.arrow_udf("string")
    def kept(text: pa.Array, lo: pa.Array, hi: pa.Array) -> pa.Array:
        # a few rows at a time, so that a worker holds few texts as Python objects at once
        made = [pa.array(map(_kept_text, *(x.slice(at, 500).to_pylist() for x in (text, lo, hi))), pa.string()) for at in range(0, len(text), 500)]
        return pa.concat_arrays(made) if made else pa.array([], pa.string())

    text = F.when(F.size("__from") > 0, kept("text", "__from", "__to")).otherwise(F.col("text"))
    return spans.withColumn("text", text).select(*documents.columns)


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(table(spark, sf_dir, "documents"))
