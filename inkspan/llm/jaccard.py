"""N-gram Jaccard join: exact links between documents' shingle sets, by signature trees.

A document's set holds 64-bit hashes of its distinct word shingles.  Documents with
equal sets form a class, represented by one of them.

1. Routing.  If two sets link, the prefixes of both (the 15 % that come first in one
   fixed order of all shingles) share a shingle.  The order puts shingles that a
   bounded sample of documents shows as common last; it affects only speed.  Only
   shingles in the prefixes of two or more different sets form a bucket.
2. Stars.  Sets that share many prefix shingles with the smallest set of a bucket
   are compared with it, which joins large groups of near copies with a number of
   comparisons that is linear in their size.
3. Signature trees.  What is left are pairs of sets, not yet joined, that meet in a
   bucket.  Buckets with the same smallest set form one group, so that near copies,
   which share many shingles, meet once and not in each of them.  A group is a tree
   over its members, ordered by size and least shingle: nodes hold the OR (and the AND)
   of their members' token bitmaps and the range of set sizes.  Two trees are traversed
   together, and a pair of nodes is dropped when the largest overlap that bitmaps and
   sizes allow cannot reach the threshold.  A first traversal looks at bitmaps of an
   eighth of the shingles, a second at bitmaps of all, and each leaves only members that
   may link.  The third gets their whole sets,
   counts overlaps where two lowest nodes meet and joins what links, so it returns only
   links that join two components: fewer than there are members.
   Groups of more than a block's weight are cut into blocks.  Each block is solved by
   itself first; after that, only blocks in which several components are left meet.
4. Components come from alternating stars over the links.

Every link is compared word by word on the whole texts, stars before they are used and
joining links at the end; a link that hashes alone had made (and two sets of one hash)
would start the join again with other hashes.  No step lists all pairs of a group, and
no step has a cap.

Defined results: null texts and texts without words have no shingles and link with
nothing (component_id is their own doc_id); texts of fewer words than a shingle are
one shingle; ties and repeated rows link; a repeated row gives a repeated result row,
and rows of one doc_id and different texts one each; null doc_ids link like others and
are no component_id unless the component has no other; further columns are ignored.
"""

from __future__ import annotations

import itertools

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import components
from .shared import cut, exact_codes, lowered, mix, parts, saved, slabs, table, utf8, word_hashes, word_spans

SHINGLE = 4
PERCENT = 85
#: Documents looked at for common shingles, and how many of these are put last in the order.
SAMPLE = 4096
COMMON = 200_000
#: Shingles, with an allowance for each member, that a block of a large group holds: of bitmaps, and of whole sets.
BITMAPS, WHOLE = 1 << 22, 1 << 20
PER_MEMBER = 256
#: Members of a lowest node, and children of the others.
LOWEST, FANOUT = 64, 8
#: Elements of two lowest nodes whose overlaps are counted at once; larger sets meet one by one.
TOGETHER = 1 << 17
#: Places in the fixed-size filter that keeps texts out of the verifying join.
FILTER = 1 << 19


def shingle_sets(texts: list[bytes], size: int = SHINGLE, lane: int = 0):
    """The sorted distinct shingle hashes of each text."""
    for i, j, data, starts in slabs(texts):
        low = lowered(data)
        a, b = word_spans(low)
        h = word_hashes(low, a, b, lane)
        first = np.searchsorted(a, starts)
        grams = h[: len(h) - size + 1].copy() if len(h) >= size else h[:0]
        for k in range(1, size):
            grams = mix(grams + np.uint64(0x9E3779B97F4A7C15)) ^ h[k : k + len(grams)]
        grams = mix(grams)
        for d in range(j - i):
            lo, hi = first[d], first[d + 1]
            if hi - lo >= size:
                yield np.unique(grams[lo : hi - size + 1])
            elif hi > lo:
                own = np.uint64(hi - lo)
                for x in h[lo:hi]:
                    own = mix(np.array([own], np.uint64) + x)[0]
                yield np.array([own], np.uint64)
            else:
                yield h[:0]


def set_key(s: np.ndarray) -> int:
    return int(mix(np.array([np.sum(mix(s), dtype=np.uint64) + np.uint64(len(s))]))[0].astype(np.int64))


def prefix_length(n: int, percent: int) -> int:
    return n - (percent * n + 99) // 100 + 1


def _tokens(texts: DataFrame, size: int, percent: int, lane: int, common: np.ndarray) -> DataFrame:
    """(token, sid, n): the prefix of each set."""

    def run(batches):
        for b in parts(batches):
            out, keys, ns = [], [], []
            for s in shingle_sets(utf8(b.column(0)), size, lane):
                n = len(s)
                if n:
                    p, key = prefix_length(n, percent), set_key(s)
                    if len(common):
                        at = np.minimum(np.searchsorted(common, s), len(common) - 1)
                        is_common = common[at] == s
                        s = np.concatenate([s[~is_common], s[is_common]]) if is_common.any() else s
                    out.append(s[:p])
                    keys.append(key)
                    ns.append(n)
            if out:
                sizes = [len(x) for x in out]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out).astype(np.int64)), pa.array(np.repeat(np.array(keys, np.int64), sizes)), pa.array(np.repeat(np.array(ns, np.int32), sizes))], names=["token", "sid", "n"])

    return texts.select("text").mapInArrow(run, "token long, sid long, n int")


def bitmap(s: np.ndarray, n: int) -> bytes:
    """One bit per shingle by its low bits, in 2^k bits of at least eight for each of n."""
    width = max(64, 1 << int(8 * n - 1).bit_length())
    bits = np.zeros(width, np.uint8)
    bits[(s & np.uint64(width - 1)).astype(np.int64)] = 1
    return np.packbits(bits, bitorder="little").tobytes()


def _sets(texts: DataFrame, size: int, lane: int) -> DataFrame:
    """texts (doc_id, th, text) as (doc_id, th, sid, twin, n, low, bits): two keys of each set, null for empty ones; bits are of an eighth of the shingles."""

    def run(batches):
        for b in parts(batches):
            raw = utf8(b.column(2))
            sets = list(shingle_sets(raw, size, lane))
            keys = [set_key(s) if len(s) else None for s in sets]
            twins = [set_key(s) if len(s) else None for s in shingle_sets(raw, size, lane + 1)]
            low = [int(s[0].astype(np.int64)) if len(s) else 0 for s in sets]
            bits = [bitmap(s[: np.searchsorted(s, np.uint64(1 << 61))], max(8, len(s) // 8)) for s in sets]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(keys, pa.int64()), pa.array(twins, pa.int64()), pa.array(list(map(len, sets)), pa.int32()), pa.array(low, pa.int64()), pa.array(bits, pa.binary())],
                names=["doc_id", "th", "sid", "twin", "n", "low", "bits"],
            )

    kind = texts.schema["doc_id"].dataType.simpleString()
    return texts.mapInArrow(run, f"doc_id {kind}, th long, sid long, twin long, n int, low long, bits binary")


def _common(texts: DataFrame, size: int, lane: int, rows: int) -> np.ndarray:
    """Shingles that at least two documents of the sample hold: at most COMMON, sorted."""
    sample = texts.where(F.pmod(F.xxhash64("th"), F.lit(max(1, rows // SAMPLE))) == 0)

    def run(batches):
        for b in parts(batches):
            for s in shingle_sets(utf8(b.column(0)), size, lane):
                yield pa.RecordBatch.from_arrays([pa.array(s.astype(np.int64)), pa.array(np.full(len(s), set_key(s), np.int64))], names=["token", "sid"])

    seen = sample.select("text").mapInArrow(run, "token long, sid long")
    # among copies a shingle says nothing: sets count once
    often = seen.distinct().groupBy("token").count().where("count > 1").orderBy(F.desc("count"), "token").limit(COMMON)
    return np.sort(often.select("token").toArrow().column(0).to_numpy().astype(np.uint64))


def _per_set(texts: DataFrame, size: int, lane: int, whole: bool) -> DataFrame:
    """(sid, bits): the bitmap of all shingles of each set, or all its shingle hashes, 8 bytes each."""

    def run(batches):
        for b in parts(batches):
            sets = [s for s in shingle_sets(utf8(b.column(0)), size, lane) if len(s)]
            yield pa.RecordBatch.from_arrays([pa.array([set_key(s) for s in sets], pa.int64()), pa.array([s.tobytes() if whole else bitmap(s, len(s)) for s in sets], pa.binary())], names=["sid", "bits"])

    return texts.select("text").mapInArrow(run, "sid long, bits binary").dropDuplicates(["sid"])


def fold(bits: np.ndarray, width: int) -> np.ndarray:
    """Bitmaps (last axis) as ones of fewer bytes: halves are OR-combined, as a shingle's place is its hash modulo the width."""
    while bits.shape[-1] > width:
        half = bits.shape[-1] // 2
        bits = bits[..., :half] | bits[..., half:]
    return bits


class Node:
    """A node of a signature tree: OR and AND of its bitmaps, range of sizes, and either members or children.

    Folding an AND gives bits that every member's folded bitmap has, so bounds stay sound.
    """

    def __init__(self, children=(), ids=None, sizes=None, comps=None, bits=None, sets=None):
        self.children, self.ids, self.sizes, self.comps, self.bits, self.sets = children, ids, sizes, comps, bits, sets
        if children:
            w = min(len(c.any) for c in children)
            self.any = np.bitwise_or.reduce([fold(c.any, w) for c in children])
            self.all = np.bitwise_and.reduce([fold(c.all, w) for c in children])
            self.lo, self.hi = min(c.lo for c in children), max(c.hi for c in children)
            own = {c.comp for c in children}
        else:
            self.any, self.all = np.bitwise_or.reduce(bits), np.bitwise_and.reduce(bits)
            self.lo, self.hi = int(sizes.min()), int(sizes.max())
            own = set(comps.tolist())
            self.found = np.zeros(len(ids), bool)
        self.comp = own.pop() if len(own) == 1 else None


def tree(members: list[tuple], percent: int = PERCENT) -> Node:
    """members: (id, n, comp, low, bits, set or None); near copies come to lie side by side."""
    scale = np.log(100 / percent)
    members, level = sorted(members, key=lambda m: (len(m[4]), int(np.log(m[1]) / scale), m[3], m[1], m[0])), []
    # a lowest node holds bitmaps of one width: folded to the width of a small set, those of large ones would be full and rule out nothing
    for _, same in itertools.groupby(members, key=lambda m: len(m[4])):
        same = list(same)
        for i in range(0, len(same), LOWEST):
            part = same[i : i + LOWEST]
            level.append(Node((), *(np.array([m[k] for m in part], np.int64) for k in (0, 1, 2)), np.stack([m[4] for m in part]), [m[5] for m in part]))
    while len(level) > 1:
        level = [Node(level[i : i + FANOUT]) if len(level[i : i + FANOUT]) > 1 else level[i] for i in range(0, len(level), FANOUT)]
    return level[0]


def may_link(x: Node, y: Node, percent: int) -> bool:
    """Whether some pair of members can reach the threshold, by sizes and the largest possible overlap."""
    if x.comp is not None and x.comp == y.comp:
        return False
    if 100 * x.hi < percent * y.lo or 100 * y.hi < percent * x.lo:
        return False
    w = min(len(x.any), len(y.any))
    most_x = x.hi - int(np.bitwise_count(fold(x.all, w) & ~fold(y.any, w)).sum())
    most_y = y.hi - int(np.bitwise_count(fold(y.all, w) & ~fold(x.any, w)).sum())
    return 100 * min(most_x, most_y) >= percent * max(x.lo, y.lo)


def candidates(x: Node, y: Node, percent: int) -> np.ndarray:
    """Which pairs of members of two lowest nodes can reach the threshold, by the same bounds."""
    w = min(x.bits.shape[1], y.bits.shape[1])
    a, b = fold(x.bits, w), fold(y.bits, w)
    both = np.stack([np.bitwise_count(row & b).sum(1, dtype=np.int64) for row in a])
    most_a = x.sizes[:, None] - (np.bitwise_count(a).sum(1, dtype=np.int64)[:, None] - both)
    most_b = y.sizes[None] - (np.bitwise_count(b).sum(1, dtype=np.int64)[None] - both)
    most = np.minimum(most_a, most_b)
    return 100 * most >= percent * (x.sizes[:, None] + y.sizes[None] - most)


def traverse(x: Node, y: Node, percent: int, meet) -> None:
    """Calls meet with each pair of lowest nodes that the bounds leave."""
    stack = [(x, y)]
    while stack:
        x, y = stack.pop()
        if x is y and x.children:
            if x.comp is None:
                stack += [(a, b) for i, a in enumerate(x.children) for b in x.children[i:]]
        elif not may_link(x, y, percent):
            continue
        elif not x.children and not y.children:
            meet(x, y)
        elif y.children and (not x.children or y.hi - y.lo >= x.hi - x.lo):
            stack += [(x, c) for c in y.children]
        else:
            stack += [(c, y) for c in x.children]


def members_that_may_link(x: Node, y: Node, percent: int) -> set:
    """Ids of members in a pair, of different components, that the bounds leave."""
    out: set = set()

    def meet(a: Node, b: Node) -> None:
        if a.found.all() and b.found.all():
            return
        ok = candidates(a, b, percent) & (a.comps[:, None] != b.comps[None])
        a.found |= ok.any(1)
        b.found |= ok.any(0)
        out.update(a.ids[a.found].tolist(), b.ids[b.found].tolist())

    traverse(x, y, percent, meet)
    return out


def overlaps(xs: list[np.ndarray], ys: list[np.ndarray]) -> np.ndarray:
    """Numbers of shingles that each of xs shares with each of ys."""
    sets = [*xs, *ys]
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, column, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = often > 1
    keep = shared[column]
    m = np.zeros((len(sets), int(shared.sum())), np.float32)
    m[row[keep], (np.cumsum(shared) - 1)[column[keep]]] = 1
    return (m[: len(xs)] @ m[len(xs) :].T).astype(np.int64)


def joining_links(x: Node, y: Node, percent: int) -> list[tuple[int, int]]:
    """Links that each join two components: all that the components of the members need."""
    parent: dict[int, int] = {}
    out: list[tuple[int, int]] = []

    def root(c: int) -> int:
        while c in parent:
            if parent[c] in parent:
                parent[c] = parent[parent[c]]
            c = parent[c]
        return c

    def meet(a: Node, b: Node) -> None:
        ra, rb = (np.array([root(c) for c in n.comps.tolist()], np.int64) for n in (a, b))
        ok = candidates(a, b, percent) & (ra[:, None] != rb[None])
        if not ok.any():
            return
        rows, columns = np.nonzero(ok.any(1))[0], np.nonzero(ok.any(0))[0]
        size = int(a.sizes[rows].sum() + b.sizes[columns].sum())
        counted = None
        if ok.sum() > 16 and size <= TOGETHER:
            counted = np.zeros(ok.shape, np.int64)
            counted[np.ix_(rows, columns)] = overlaps([a.sets[i] for i in rows], [b.sets[j] for j in columns])
            ok &= 100 * counted >= percent * (a.sizes[:, None] + b.sizes[None] - counted)
        for i, j in zip(*(k.tolist() for k in np.nonzero(ok)), strict=True):
            p, q = root(int(a.comps[i])), root(int(b.comps[j]))
            if p == q:
                continue
            if counted is None:
                both = len(np.intersect1d(a.sets[i], b.sets[j], assume_unique=True))
                if 100 * both < percent * (a.sizes[i] + b.sizes[j] - both):
                    continue
            parent[max(p, q)] = min(p, q)
            out.append((int(a.ids[i]), int(b.ids[j])))

    traverse(x, y, percent, meet)
    return out


def _solve(percent: int, whole: bool):
    """Traverses the tree of each group: links (a, b), or (center, sid) of members that are in a pair."""

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        found: list = []
        if whole:
            sets = [np.frombuffer(x, np.uint64) for x in pdf["bits"]]
            maps = [np.frombuffer(bitmap(s, len(s)), np.uint8) for s in sets]
        else:
            sets, maps = [None] * len(pdf), [np.frombuffer(x, np.uint8) for x in pdf["bits"]]
        rows = list(zip(pdf["sid"], pdf["n"], pdf["comp"], pdf["low"], maps, sets, strict=True))
        side, center = pdf["side"].to_numpy(), pdf["center"].to_numpy()
        order = np.argsort(center, kind="stable")
        for part in np.split(order, np.nonzero(np.diff(center[order]))[0] + 1):
            left = [rows[i] for i in part if side[i] <= 0]
            right = [rows[i] for i in part if side[i] == 1]
            if not left:
                continue
            x = tree(left, percent)
            y = tree(right, percent) if right else x
            found += joining_links(x, y, percent) if whole else [(center[part[0]], r) for r in members_that_may_link(x, y, percent)]
        return pd.DataFrame(found, columns=["a", "b"]).astype("int64")

    return solve


def _jobs(members: DataFrame, percent: int, weight: int, across: bool | None = None) -> DataFrame:
    """The members (center, sid, n, low, comp, m: weight of the group) of each tree or pair of trees: pack, x, y, side.

    across: only pairs of different blocks (True) or only blocks by themselves (False).
    """
    zero = F.lit(0).cast("long")
    names = ["center", "sid", "n", "low", "comp"]
    few = members.where(F.col("m") <= weight)
    packs = max(1, (few.agg(F.sum(F.col("n") + PER_MEMBER)).first()[0] or 0) // weight)
    few = few.select(*names, F.pmod(F.xxhash64("center"), F.lit(packs)).alias("pack"), zero.alias("x"), zero.alias("y"), F.lit(0).alias("side"))
    # larger groups: blocks by size class, so that only a block and its neighbours can link
    many = members.where(F.col("m") > weight).withColumn("k", F.floor(F.log("n") / F.log(F.lit(100.0 / percent))).cast("int"))
    part = cut(many.groupBy("center", "k").agg(F.ceil(F.sum(F.col("n") + PER_MEMBER) / weight).cast("int").alias("parts")))
    many = many.join(part, ["center", "k"]).withColumn("p", F.pmod(F.xxhash64("sid"), F.col("parts")).cast("int"))
    me = F.struct("k", "p")
    if across is False:
        alone = many.select(*names, F.xxhash64("center").alias("pack"), F.xxhash64(me).alias("x"), F.xxhash64(me).alias("y"), F.lit(-1).alias("side"))
        return few.unionByName(alone)
    near = part.select("center", F.col("k").alias("k2"), F.col("parts").alias("parts2"))
    pairs_of = many.join(near, "center").where(F.abs(F.col("k2") - F.col("k")) <= 2).withColumn("p2", F.explode(F.sequence(F.lit(0), F.col("parts2") - 1)))
    other = F.struct(F.col("k2").alias("k"), F.col("p2").alias("p"))
    side = F.when(me == other, -1).when(me < other, 0).otherwise(1)
    blocks = pairs_of.select(*names, F.xxhash64("center").alias("pack"), F.xxhash64(F.least(me, other)).alias("x"), F.xxhash64(F.greatest(me, other)).alias("y"), side.alias("side"))
    return blocks.where("side >= 0") if across else few.unionByName(blocks)


def _open(members: DataFrame) -> DataFrame:
    """Members of groups in which different components meet, with the group's weight m."""
    # members are counted and read again: they are made once
    members = cut(members)
    groups = members.groupBy("center").agg(F.sum(F.col("n") + PER_MEMBER).alias("m"), F.min("comp").alias("c0"), F.max("comp").alias("c1")).where("c0 <> c1").select("center", "m")
    # cut from the join, so that it may split a hot center's rows over tasks
    return cut(members.drop("m").join(cut(groups), "center"))


def _place(*names: str):
    return F.pmod(F.xxhash64(*names), F.lit(FILTER))


def _only(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """The rows whose (doc_id, th) can be among those wanted, by a filter of at most FILTER places, whatever the number wanted."""
    places = wanted.select(_place("doc_id", "th").alias("__at")).distinct()
    return rows.withColumn("__at", _place("doc_id", "th")).join(F.broadcast(places), "__at", "left_semi").drop("__at")


def _pairs(batches, limit: int = 1 << 19):
    """Pairs (a, b, text of a, text of b), some at a time, as (batch, texts)."""
    for b in parts(batches):
        x, y, at = utf8(b.column(2)), utf8(b.column(3)), 0
        while at < b.num_rows:
            to, size = at, 0
            while to < b.num_rows and (to == at or size + len(x[to]) + len(y[to]) < limit):
                size += len(x[to]) + len(y[to])
                to += 1
            yield b.slice(at, to - at), x[at:to], y[at:to]
            at = to


def linked(xs: list[bytes], ys: list[bytes], size: int, percent: int) -> list[bool]:
    """Whether each pair of texts links, by their words themselves."""
    texts = [t for pair in zip(xs, ys, strict=True) for t in pair]
    data = lowered(np.frombuffer(b"\n".join(texts) + b"\n", np.uint8))
    starts = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
    a, b = word_spans(data)
    codes = exact_codes(data, a, b).astype(np.int64)
    first = np.searchsorted(a, starts)
    grams = codes
    for k in range(1, size):
        grams = pd.factorize(grams[: max(len(codes) - k, 0)] * (codes.max(initial=0) + 1) + codes[k:])[0].astype(np.int64)
    words = codes.tolist()

    def shingles(d: int):
        lo, hi = first[d], first[d + 1]
        return np.unique(grams[lo : hi - size + 1]) if hi - lo >= size else tuple(words[lo:hi])

    out = []
    for d in range(0, len(texts), 2):
        x, y = shingles(d), shingles(d + 1)
        if isinstance(x, tuple) or isinstance(y, tuple):
            out.append(type(x) is type(y) and x == y and len(x) > 0)
        else:
            both = len(np.intersect1d(x, y, assume_unique=True))
            out.append(both > 0 and 100 * both >= percent * (len(x) + len(y) - both))
    return out


def _verified(texts: DataFrame, pairs: DataFrame, classes: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs (a, b) of sids, each once, whose documents link."""
    rep = classes.select("sid", "rep.doc_id", "rep.th")
    ends = pairs.join(rep.select(F.col("sid").alias("a"), F.col("doc_id").alias("doc_a"), F.col("th").alias("th_a")), "a").join(rep.select(F.col("sid").alias("b"), F.col("doc_id").alias("doc_b"), F.col("th").alias("th_b")), "b")
    ends = cut(ends)
    some = _only(texts, ends.select(F.col("doc_a").alias("doc_id"), F.col("th_a").alias("th")).union(ends.select("doc_b", "th_b")))
    for k in "ab":
        own = some.toDF(f"own_{k}", f"key_{k}", f"text_{k}")
        ends = ends.join(own, (F.col(f"th_{k}") == F.col(f"key_{k}")) & F.col(f"doc_{k}").eqNullSafe(F.col(f"own_{k}")))

    def run(batches):
        for b, x, y in _pairs(batches):
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["a", "b"]).filter(pa.array(linked(x, y, size, percent), pa.bool_()))

    return ends.select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long").distinct()


def _once(documents: DataFrame) -> DataFrame:
    return documents.select("doc_id", F.xxhash64("text").alias("th"), "text")


def _routes(texts: DataFrame, size: int, percent: int, lane: int, rows: int) -> DataFrame:
    """(center, sid, shared, n): who meets in the buckets of which smallest set, and in how many."""
    tokens = saved(_tokens(texts, size, percent, lane, _common(texts, size, lane, rows)), "tokens")
    # cut from the join that follows, so that it may split a hot shingle's rows over tasks
    buckets = cut(tokens.groupBy("token").agg(F.min("sid").alias("center"), F.max("sid").alias("last")).where("center <> last").select("token", "center"))
    # all buckets with one smallest set are one group: whoever meets in a bucket meets there
    return cut(tokens.join(buckets, "token").groupBy("center", "sid").agg(F.count("*").alias("shared"), F.max("n").alias("n")))


def _stars(met: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Pairs (a: a center, b) worth a comparison: only a way to join near copies early, so weak candidates can wait."""
    strong = met.where((F.col("sid") != F.col("center")) & (F.col("shared") * 100 >= (100 - percent) * F.col("n") * 0.25))
    fit = strong.join(classes.select(F.col("sid").alias("center"), F.col("n").alias("center_n")), "center").where(100 * F.least("n", "center_n") >= percent * F.greatest("n", "center_n"))
    # a set needs few comparisons to be joined: its three best centers
    best = fit.groupBy("sid").agg(F.slice(F.sort_array(F.collect_list(F.struct("shared", F.col("center").alias("a"))), False), 1, 3).alias("c"))
    return best.select(F.explode("c.a").alias("a"), F.col("sid").alias("b"))


def _named(classes: DataFrame, known: DataFrame) -> DataFrame:
    """(sid, n, low, comp): the component of each set by the components (id, component) so far."""
    return classes.join(known.withColumnRenamed("id", "sid"), "sid", "left").select("sid", "n", "low", F.coalesce("component", "sid").alias("comp"))


def _found(documents: DataFrame, size: int, percent: int, lane: int = 0) -> tuple[DataFrame, DataFrame]:
    """(base: a row per document with sid and n; placed: sid, component (a sid), rep) of all documents."""
    texts = _once(documents)
    base = cut(_sets(texts, size, lane))
    first = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th")
    per_set = base.where(F.col("sid").isNotNull()).groupBy("sid")
    classes = cut(per_set.agg(F.min(first).alias("rep"), F.max("n").alias("n"), F.min("low").alias("low"), F.first("bits").alias("bits"), (F.min("twin") != F.max("twin")).alias("mixed")))
    facts = classes.agg(F.count("*").alias("n"), F.count_if("mixed").alias("mixed")).first()
    if facts["mixed"]:  # two sets of one key: other hashes
        return _found(documents, size, percent, lane + 2)
    met = _routes(texts, size, percent, lane, facts["n"])
    star = components(_verified(texts, _stars(met, classes, percent), classes, size, percent).toDF("u", "v"))

    # trees over the groups in which different components meet
    members = _open(met.select("center", "sid").join(_named(classes, star), "sid"))
    # first by an eighth of the shingles, which parts sets that share little, then by all; whole sets only of what is left
    def own(members: DataFrame, whole: bool) -> DataFrame:
        wanted = members.select("sid").distinct().join(classes.select("sid", "rep.doc_id", "rep.th"), "sid")
        return _per_set(_only(texts, wanted), size, lane, whole)

    def narrowed(members: DataFrame, bits: DataFrame) -> DataFrame:
        some = _jobs(members, percent, BITMAPS).join(bits, "sid").groupBy("pack", "x", "y").applyInPandas(_solve(percent, False), "a long, b long")
        return _open(members.join(some.toDF("center", "sid").distinct(), ["center", "sid"], "left_semi"))

    def solved(left: DataFrame, across: bool) -> DataFrame:
        jobs = _jobs(left, percent, WHOLE, across).join(own(left, True), "sid")
        return cut(jobs.groupBy("pack", "x", "y").applyInPandas(_solve(percent, True), "a long, b long").distinct())

    left = narrowed(members, classes.select("sid", "bits"))
    left = narrowed(left, own(left, False))
    more = solved(left, False)
    big = left.where(F.col("m") > WHOLE)
    if not big.isEmpty():
        known = components(star.union(more).toDF("u", "v"))
        again = big.drop("comp", "m").join(known.withColumnRenamed("id", "sid"), "sid", "left").withColumn("comp", F.coalesce("component", "sid")).drop("component")
        more = more.unionByName(solved(_open(again), True)).distinct()
    sure = cut(_verified(texts, more, classes, size, percent))
    if sure.count() != more.count():  # equal hashes of different words: other hashes
        return _found(documents, size, percent, lane + 2)
    comps = components(star.union(sure).toDF("u", "v"))
    return base, classes.select("sid", "rep").join(comps.withColumnRenamed("id", "sid"), "sid", "left").withColumn("component", F.coalesce("component", "sid"))


def jaccard_join(documents: DataFrame, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id."""
    base, placed = _found(documents, size, percent)
    least = placed.groupBy("component").agg(F.min("rep").alias("first"))
    of_set = cut(placed.join(cut(least), "component").select("sid", F.col("first.doc_id").alias("least")))
    rows = base.select("doc_id", "sid", "n").join(of_set, "sid", "left")
    own = F.when(F.col("sid").isNull(), F.col("doc_id")).otherwise(F.col("least"))
    return rows.select("doc_id", F.col("n").cast("long").alias("n_shingles"), own.alias("component_id"))


def keep_one(documents: DataFrame, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """One row of each component stays, of the smallest doc_id (null ones last); all columns are kept.

    Of a repeated row one copy stays.  Texts without words link with nothing and stay in every copy.
    """
    base, placed = _found(documents, size, percent)
    first = placed.groupBy("component").agg(F.min("rep").alias("x")).select(F.col("x.doc_id").alias("__id"), F.col("x.th").alias("__th"))
    often = base.where("n > 0").groupBy("doc_id", "th").count().where("count > 1").select(F.col("doc_id").alias("__often"), F.col("th").alias("__key"))
    first = first.join(often, F.col("__id").eqNullSafe(F.col("__often")) & (F.col("__th") == F.col("__key")), "left").withColumn("__again", F.col("__key").isNotNull())
    # texts without words stay, in every copy
    blank = base.where("n = 0").select(F.col("doc_id").alias("__id"), F.col("th").alias("__th")).distinct().withColumn("__again", F.lit(False))
    kept = cut(first.select("__id", "__th", "__again").unionByName(blank))
    keyed = documents.withColumn("__own", F.xxhash64("text"))
    here = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__own") == F.col("__th"))
    once = keyed.join(kept.where("NOT __again").select("__id", "__th"), here, "left_semi")
    again = kept.where("__again").select("__id", "__th")
    if not again.isEmpty():
        near = keyed.withColumn("__at", _place("doc_id", "__own")).join(F.broadcast(again.select(_place("__id", "__th").alias("__at")).distinct()), "__at", "left_semi").drop("__at")
        once = once.unionByName(near.join(again, here, "left_semi").dropDuplicates(["doc_id", "__own"]))
    return once.select(*documents.columns)


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(table(spark, sf_dir, "documents"))


OP9_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
g AS (SELECT DISTINCT doc_id, CASE WHEN len(ws) < 4 THEN array_to_string(ws, ' ') ELSE array_to_string(ws[i:i + 3], ' ') END AS gram
      FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 1) + 1)) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
i AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM g a JOIN g b ON a.gram = b.gram AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM i JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 85 * (x.n + y.n - i)),
c AS (SELECT doc_id AS id, doc_id AS other FROM documents UNION SELECT c.id, e.b FROM c JOIN e ON e.a = c.other)
SELECT d.doc_id, cast(coalesce(n.n, 0) AS bigint) AS n_shingles, m.component_id AS component_id
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN (SELECT id, min(other) AS component_id FROM c GROUP BY id) m ON m.id = d.doc_id
"""
