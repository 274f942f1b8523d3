r"""Language-model scoring by a probabilistic suffix tree.

A text is its tokens (A-Z lower-cased words between white space, each ended by a
space) and one end, a byte string from which the tokens can be read back.

Counting.  One pass counts every (DEPTH + 1)-gram of bytes and every word of all
training texts, combined in each task before the shuffle; shorter contexts follow
by summing.  Nothing is sampled.

Tree.  A context of up to DEPTH bytes is retained if it occurs LEAST times and its
next-byte distribution diverges from that of the context one byte shorter: occurrences
times Kullback-Leibler divergence of at least GAIN nats; its suffixes stay with it.
Distributions are smoothed towards the shorter context in proportion to the number
of different next bytes seen (Witten and Bell).  The MAX_STATES contexts of the largest
gain travel with the scorers; the others stay in a table.  While these and their suffixes
have more than MAX_ROWS next bytes, half as many travel: that bounds what the driver collects.

Scoring beyond what travels.  A travelling context knows whether the table holds longer
ones.  Tokens with such a byte leave the scorer with their byte codes; distinct codes
meet the table in a shuffled join, and go on from the travelling tree's probability by
the same smoothing.  So MAX_STATES decides where a context is looked up, and no result
depends on it.

Scoring.  Each byte is predicted from the longest retained suffix of what stands
before it.  Token probabilities are mixed half and half with the shares of all
training tokens, so that the sum over all texts stays 1.

Both scores need the count of every token: counts of the LEXICON most frequent words
travel with the model, all others are joined by word hash (64 bits).  LEXICON decides
where a count is looked up and not what it is: no result depends on it.

Defined results: null texts are empty (one token, the end); a null doc_id counts as
training; repeated rows give a row each, and each counts in training; without training texts all counts are 0; further columns are
ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import cut, lowered, mix, parts, table, utf8, word_hashes

DEPTH = 5
LEAST = 8
GAIN = 12.0
MAX_STATES = 200_000
MAX_ROWS = 12_000_000
LEXICON = 100_000
MIX = 0.5
SLAB = 1 << 19
GRAM, WORD, KNOWN = 0, 1, 4


def held_out(doc_id: Column, mod: int, rest: int) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % mod == rest, F.lit(False))


class Tokens:
    """The byte strings of several texts in one array, with DEPTH zero bytes before each."""

    def __init__(self, texts: list[bytes]) -> None:
        pad = b"\0" * DEPTH
        raw = np.frombuffer(b"".join(pad + t + b" \n" for t in texts), np.uint8)
        sizes = np.array([len(t) + DEPTH + 2 for t in texts], np.int64)
        ends = np.cumsum(sizes) - 1
        padding = np.zeros(len(raw), bool)
        padding[((ends - sizes + 1)[:, None] + np.arange(DEPTH)).ravel()] = True
        word = ~((raw == 32) | ((raw >= 9) & (raw <= 13))) & ~padding
        final = np.zeros(len(raw), bool)
        final[ends] = True
        after = np.zeros(len(raw), bool)
        after[1:] = word[:-1] & ~word[1:]
        keep = word | padding | final | after
        self.data = np.where(word, lowered(raw), np.where(padding, 0, np.where(final, 10, 32)))[keep].astype(np.uint8)
        self.symbol = ~padding[keep]
        self.last = np.nonzero(final[keep])[0]
        self.spaces = np.nonzero(after[keep] & ~final[keep])[0]

    def codes(self) -> np.ndarray:
        """Of each symbol: the DEPTH bytes before it and itself."""
        n = len(self.data) - DEPTH
        c = np.zeros(max(n, 0), np.uint64)
        for k in range(DEPTH + 1):
            c = (c << np.uint64(8)) | self.data[k : n + k]
        return c[self.symbol[DEPTH:]]

    def words(self) -> tuple[np.ndarray, np.ndarray]:
        """Hash of each word and the text it stands in."""
        if not len(self.spaces):
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        text = np.searchsorted(self.last, self.spaces)
        first = np.concatenate([[DEPTH], self.last[:-1] + 1 + DEPTH])
        start = np.empty(len(self.spaces), np.int64)
        start[0] = first[text[0]]
        new = np.diff(text) > 0
        start[1:] = np.where(new, first[text[1:]], self.spaces[:-1] + 1)
        return word_hashes(self.data, start, self.spaces), text


def _slabs(texts: list[bytes]):
    at = 0
    while at < len(texts):
        to, size = at, 0
        while to < len(texts) and (to == at or size + len(texts[to]) < SLAB):
            size += len(texts[to])
            to += 1
        yield at, to
        at = to


def _counted(x: np.ndarray, weight: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    which, values = pd.factorize(x)
    return values, np.bincount(which, weights=weight, minlength=len(values)).astype(np.int64)


def counts(training: DataFrame) -> DataFrame:
    """(kind, code, n) of all byte grams and words, and the number of texts as word code 0 of kind 2."""

    def run(batches):
        held: dict[int, list] = {GRAM: [], WORD: []}
        texts_seen = 0

        def flush(kind):
            if held[kind]:
                code, n = _counted(np.concatenate([x for x, _ in held[kind]]), np.concatenate([y for _, y in held[kind]]))
                held[kind] = [(code, n)]

        def rows(kind):
            flush(kind)
            for code, n in held[kind]:
                for at in range(0, len(code), 100_000):
                    c = code[at : at + 100_000].astype(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(c), kind, np.int32)), pa.array(c), pa.array(n[at : at + 100_000])], names=["kind", "code", "n"])
            held[kind] = []

        for b in parts(batches):
            texts = utf8(b.column(0))
            texts_seen += len(texts)
            for at, to in _slabs(texts):
                t = Tokens(texts[at:to])
                held[GRAM].append(_counted(t.codes()))
                held[WORD].append(_counted(t.words()[0]))
                for kind in held:
                    if sum(len(x) for x, _ in held[kind]) > 1_000_000:
                        flush(kind)
                        if len(held[kind][0][0]) > 700_000:
                            yield from rows(kind)
        yield from rows(GRAM)
        yield from rows(WORD)
        yield pa.RecordBatch.from_arrays([pa.array([2], pa.int32()), pa.array([0], pa.int64()), pa.array([texts_seen], pa.int64())], names=["kind", "code", "n"])

    partial = training.select("text").mapInArrow(run, "kind int, code long, n long")
    return partial.groupBy("kind", "code").agg(F.sum("n").alias("n"))


def _mask(d) -> Column:
    """Keeps the last d + 1 bytes of a gram."""
    return F.expr(f"shiftleft(1L, 8 * ({d} + 1)) - 1")


def tree(grams: DataFrame, least: int = LEAST, gain: float = GAIN, max_states: int = MAX_STATES) -> list[dict]:
    """The travelling contexts, by length: sorted codes of (context, next byte) with n, and sorted contexts."""
    return split(grams, least, gain, max_states)[0]


def _closed(kept: DataFrame) -> DataFrame:
    """Contexts, their suffixes and the empty one."""
    closed = kept.select(F.explode(F.sequence(F.lit(0), F.col("d"))).alias("d"), "ctx").select("d", F.when(F.col("d") == 0, 0).otherwise(F.col("ctx").bitwiseAND(_mask("d - 1"))).alias("ctx"))
    return closed.unionByName(kept.sparkSession.range(1).select(F.lit(0).alias("d"), F.lit(0).cast("long").alias("ctx"))).distinct()


def split(grams: DataFrame, least: int, gain: float, max_states: int) -> tuple[list[dict], DataFrame | None]:
    """The travelling tree, and a table of all other retained contexts (d, ctx, total, s, n) if there are any."""
    every = grams.select(F.explode(F.sequence(F.lit(0), F.lit(DEPTH))).alias("d"), "code", "n").select("d", F.col("code").bitwiseAND(_mask("d")).alias("code"), "n")
    every = every.groupBy("d", "code").agg(F.sum("n").alias("n"))
    # one row per context, with its next bytes (256 at most) as arrays
    own = every.groupBy("d", F.shiftright("code", 8).alias("ctx")).agg(F.sum("n").alias("total"), F.collect_list(F.struct(F.col("code").bitwiseAND(255).cast("short").alias("s"), "n")).alias("next"))
    ctx = cut(own.select("d", "ctx", "total", F.transform("next", lambda x: x["s"]).alias("s"), F.transform("next", lambda x: x["n"]).alias("n")))
    often = ctx.where((F.col("total") >= least) & (F.col("d") > 0)).withColumn("tail", F.when(F.col("d") > 1, F.col("ctx").bitwiseAND(_mask("d - 2"))).otherwise(0))
    shorter = ctx.where(F.col("total") >= least).select((F.col("d") + 1).alias("d"), F.col("ctx").alias("tail"), F.col("total").alias("total1"), F.map_from_arrays("s", "n").alias("next1"))
    met = often.join(shorter, ["d", "tail"])
    terms = F.zip_with("s", "n", lambda s, n: n * F.log((n / F.col("total")) / (F.element_at("next1", s) / F.col("total1"))))
    diverged = met.select("d", "ctx", F.aggregate(terms, F.lit(0.0), lambda x, y: x + y).alias("gain"))
    kept = cut(diverged.where(F.col("gain") >= gain))
    n_kept = kept.count()
    max_states = min(max_states, n_kept)
    while True:
        hot = cut(_closed(kept.orderBy(F.desc("gain"), "d", "ctx").limit(max_states)))
        states = cut(ctx.join(hot, ["d", "ctx"]))
        if max_states == 0 or (states.agg(F.sum(F.size("s"))).first()[0] or 0) <= MAX_ROWS:
            break
        max_states //= 2
    cold = None
    if n_kept > max_states:
        others = cut(_closed(kept).join(hot, ["d", "ctx"], "left_anti"))
        cold = cut(ctx.join(others, ["d", "ctx"]))
        shorter = others.select((F.col("d") - 1).alias("d"), F.when(F.col("d") > 1, F.col("ctx").bitwiseAND(_mask("d - 2"))).otherwise(0).alias("ctx"), F.lit(True).alias("open"))
        states = states.join(shorter.distinct(), ["d", "ctx"], "left").withColumn("open", F.coalesce("open", F.lit(False)))
    else:
        states = states.withColumn("open", F.lit(False))
    # MAX_ROWS rows at most, and no more heads than rows
    code = F.shiftleft("ctx", 8).bitwiseOR(F.col("x.s").cast("long"))
    rows = states.select("d", "ctx", F.explode(F.arrays_zip("s", "n")).alias("x")).select(F.col("d").cast("byte").alias("d"), code.alias("code"), F.col("x.n").cast("double").alias("n"))
    heads = states.select(F.col("d").cast("byte").alias("d"), "ctx", F.col("total").cast("double").alias("total"), F.size("s").cast("double").alias("kinds"), "open")
    rows, heads = rows.toArrow(), heads.toArrow()
    column = lambda t, d, names: [x.to_numpy() for x in t.filter(pc.equal(t["d"], d)).select(names).columns]
    out, before = [], None
    for d in range(DEPTH + 1):
        code, n = column(rows, d, ["code", "n"])
        order = np.argsort(code)
        code, n = code[order].astype(np.uint64), n[order]
        c, total, kinds, more = column(heads, d, ["ctx", "total", "kinds", "open"])
        order = np.argsort(c)
        c, total, kinds, more = c[order].astype(np.uint64), total[order], kinds[order], more[order].astype(bool)
        own = np.searchsorted(c, code >> np.uint64(8))
        if before is None:
            p = np.full(len(code), 1 / 256.0)
        else:
            p = before["p"][np.searchsorted(before["code"], code & np.uint64((1 << (8 * d)) - 1))] if len(code) else np.zeros(0)
        before = {"code": code, "p": (n + kinds[own] * p) / (total + kinds)[own], "ctx": c, "rest": kinds / (total + kinds), "open": more}
        out.append(before)
    return out, cold


def predict(model: list[dict], codes: np.ndarray) -> np.ndarray:
    """Probability of the last byte of each code after the longest retained suffix of the bytes before it."""
    p, done, rest = np.zeros(len(codes)), np.zeros(len(codes), bool), np.ones(len(codes))
    for d in range(DEPTH, -1, -1):
        m = model[d]
        if not len(m["code"]):
            continue
        left = np.nonzero(~done)[0]
        if not len(left):
            break
        c = codes[left] & np.uint64((1 << (8 * (d + 1))) - 1)
        i = np.minimum(np.searchsorted(m["code"], c), len(m["code"]) - 1)
        hit = m["code"][i] == c
        p[left[hit]] = rest[left[hit]] * m["p"][i[hit]]
        done[left[hit]] = True
        miss, cm = left[~hit], c[~hit] >> np.uint64(8)
        j = np.minimum(np.searchsorted(m["ctx"], cm), len(m["ctx"]) - 1)
        rest[miss] *= np.where(m["ctx"][j] == cm, m["rest"][j], 1.0)
    return np.where(done, p, rest / 256.0)


def undecided(model: list[dict], codes: np.ndarray) -> np.ndarray:
    """Whether the table may hold a longer context of the code than the travelling tree."""
    out = np.zeros(len(codes), bool)
    for d, m in enumerate(model):
        if len(m["ctx"]):
            c = (codes >> np.uint64(8)) & np.uint64((1 << (8 * d)) - 1)
            i = np.minimum(np.searchsorted(m["ctx"], c), len(m["ctx"]) - 1)
            out = np.where(m["ctx"][i] == c, m["open"][i], out)
    return out


def _settled(rows: DataFrame, cold: DataFrame) -> DataFrame:
    """The scorer's rows with the probabilities of undecided codes added to their tokens."""
    pending = rows.where(F.col("codes").isNotNull())
    types = pending.select("type", F.arrays_zip("codes", "ps").alias("x")).dropDuplicates(["type"])
    each = cut(types.select("type", F.explode("x").alias("x")).select("type", F.col("x.codes").alias("code"), F.col("x.ps").alias("p")))
    codes = each.groupBy("code").agg(F.max("p").alias("p"))
    levels = codes.withColumn("d", F.explode(F.sequence(F.lit(1), F.lit(DEPTH)))).withColumn("ctx", F.shiftright("code", 8).bitwiseAND(_mask("d - 1")))
    seen = F.coalesce(F.try_element_at(F.map_from_arrays("s", "n"), F.col("code").bitwiseAND(255).cast("short")), F.lit(0)).cast("double")
    met = levels.join(cold, ["d", "ctx"]).select("code", "p", F.struct("d", seen.alias("n"), F.size("s").cast("double").alias("kinds"), F.col("total").cast("double").alias("total")).alias("x"))
    longer = met.groupBy("code").agg(F.max("p").alias("p"), F.sort_array(F.collect_list("x")).alias("x"))
    q = longer.select("code", F.aggregate("x", F.col("p"), lambda v, y: (y["n"] + y["kinds"] * v) / (y["total"] + y["kinds"])).alias("q"))
    logs = each.join(q, "code", "left").groupBy("type").agg(F.sum(F.log10(F.coalesce("q", "p"))).alias("more"))
    done = pending.join(logs, "type").withColumn("score", F.col("score") + F.col("more"))
    return rows.where(F.col("codes").isNull()).unionByName(done.select(*rows.columns))


def _scorer(model: list[dict], lexicon: tuple[np.ndarray, np.ndarray], ends: int, mass: int):
    """Per text a row with the sums over its end and the words of the lexicon, and rows of its other words (kind WORD).

    The score of such a row is the tree's log10 probability of the word where it stands; n counts equal ones.
    Tokens with undecided bytes are rows with those bytes' codes and probabilities so far; words of the lexicon
    and ends among them are of kind KNOWN, with their count as `known`.
    """
    words, c = lexicon
    more = any(m["open"].any() for m in model)

    def run(batches):
        for b in parts(batches):
            texts = utf8(b.column(2))
            for at, to in _slabs(texts):
                t = Tokens(texts[at:to])
                which, values = pd.factorize(t.codes())
                p = predict(model, values)
                wait = undecided(model, values) if more else np.zeros(len(values), bool)
                log_p = np.where(wait, 0.0, np.log10(p))[which]
                place = np.cumsum(t.symbol) - 1
                stops = np.sort(np.concatenate([t.spaces, t.last]))
                first = np.concatenate([[0], place[stops[:-1]] + 1])
                token = np.add.reduceat(log_p, first)
                n_wait = np.add.reduceat(wait[which].astype(np.int64), first)
                is_end = t.data[stops] == 10
                h, text = t.words()
                i = np.minimum(np.searchsorted(words, h), max(len(words) - 1, 0))
                known = words[i] == h if len(words) else np.zeros(len(h), bool)
                cw = np.where(known, c[i], 0) if len(words) else np.zeros(len(h), np.int64)
                own = np.empty(len(stops))
                own[~is_end], own[is_end] = cw / mass, ends / mass
                score = np.log10(MIX * own + (1 - MIX) * 10.0**token)
                # below the smallest double only the tree's own share counts
                score = np.where(np.isfinite(score), score, np.log10(1 - MIX) + token)
                doc = np.searchsorted(t.last, stops)
                here = np.ones(len(stops), bool)
                here[~is_end] = known
                here &= n_wait == 0
                n = to - at
                summary = {
                    "n": np.bincount(doc, minlength=n).astype(np.int64),
                    "known": np.bincount(text[known], minlength=n).astype(np.int64) + int(ends > 0),
                    "logs": np.bincount(text, weights=np.log10(cw + 1.0) * known, minlength=n) + np.log10(ends + 1.0),
                    "score": np.bincount(doc, weights=score * here, minlength=n),
                }
                ids, keys = b.column(0).slice(at, n), b.column(1).slice(at, n)
                yield pa.RecordBatch.from_arrays(
                    [ids, keys, pa.array(np.zeros(n, np.int32)), keys, pa.array(summary["n"]), pa.array(summary["known"]), pa.array(summary["logs"]), pa.array(summary["score"]), *blank(n)], names=names
                )
                other = ~known & (n_wait[~is_end] == 0)
                rare = pd.DataFrame({"text": text[other], "h": h[other], "p": token[~is_end][other]}).groupby(["text", "h", "p"], sort=False).size().reset_index(name="n")
                row = pa.array(rare["text"].to_numpy())
                zero = np.zeros(len(rare))
                yield pa.RecordBatch.from_arrays(
                    [pa.nulls(len(rare), ids.type), keys.take(row), pa.array(np.ones(len(rare), np.int32)), pa.array(rare["h"].to_numpy(np.uint64).astype(np.int64)), pa.array(rare["n"].to_numpy(np.int64)), pa.array(np.zeros(len(rare), np.int64)), pa.array(zero), pa.array(rare["p"].to_numpy(float)), *blank(len(rare))],
                    names=names,
                )
                at_wait = np.nonzero(n_wait)[0]
                if not len(at_wait):
                    continue
                # a token and the bytes before it decide its codes
                begin = np.nonzero(t.symbol)[0][first]
                kind_of = mix(word_hashes(t.data, begin, stops + 1) ^ mix(values[which[first]] >> np.uint64(8)))[at_wait].astype(np.int64)
                word_h, count_, listed = np.zeros(len(stops), np.int64), np.full(len(stops), ends, np.int64), np.ones(len(stops), bool)
                word_h[~is_end], count_[~is_end], listed[~is_end] = h.astype(np.int64), cw, known
                w = pd.DataFrame({"text": doc[at_wait], "type": kind_of, "token": at_wait})
                n_equal = w.groupby(["text", "type"], sort=False)["token"].transform("size").to_numpy()
                one = ~w.duplicated(["text", "type"]).to_numpy()
                tok, n_equal, kind_of = at_wait[one], n_equal[one], kind_of[one]
                sym = np.nonzero(wait[which])[0]
                to_sym = np.concatenate([[0], np.cumsum(n_wait)])
                size = n_wait[tok]
                offsets = np.concatenate([[0], np.cumsum(size)])
                sym = which[sym[np.repeat(to_sym[tok] - offsets[:-1], size) + np.arange(offsets[-1])]]
                lists = [pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(x)) for x in (values[sym].astype(np.int64), p[sym])]
                own_kind = np.where(listed[tok], KNOWN, WORD).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [pa.nulls(len(tok), ids.type), keys.take(pa.array(doc[tok])), pa.array(own_kind), pa.array(np.where(listed[tok], kind_of, word_h[tok])), pa.array(n_equal.astype(np.int64)), pa.array(np.where(listed[tok], count_[tok], 0)), pa.array(np.zeros(len(tok))), pa.array(token[tok]), pa.array(kind_of), *lists],
                    names=names,
                )

    blank = lambda n: [pa.nulls(n, pa.int64()), pa.nulls(n, pa.list_(pa.int64())), pa.nulls(n, pa.list_(pa.float64()))]
    names = ["doc_id", "key", "kind", "h", "n", "known", "logs", "score", "type", "codes", "ps"]
    return run


def score(documents: DataFrame, training: Column) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score; training: a boolean column."""
    spark = documents.sparkSession
    counted = cut(counts(documents.where(training)))
    words = counted.where(F.col("kind") == WORD).select(F.lit(1).alias("kind"), F.col("code").alias("h"), F.col("n").alias("c"))
    facts = counted.agg(F.coalesce(F.sum(F.when(F.col("kind") == WORD, F.col("n"))), F.lit(0)).alias("words"), F.count_if(F.col("kind") == WORD).alias("kinds"), F.coalesce(F.sum(F.when(F.col("kind") == 2, F.col("n"))), F.lit(0)).alias("texts")).first()
    total, kinds = facts["words"] + facts["texts"], facts["kinds"] + (facts["texts"] > 0)
    model, cold = split(counted.where(F.col("kind") == GRAM).select("code", "n"), LEAST, GAIN, MAX_STATES)
    top = words.orderBy(F.desc("c"), "h").limit(LEXICON).toPandas()
    h = top["h"].to_numpy(np.int64).astype(np.uint64)
    order = np.argsort(h)
    mass = max(total, 1)
    run = _scorer(model, (h[order], top["c"].to_numpy(np.int64)[order]), facts["texts"], mass)
    kind = documents.schema["doc_id"].dataType.simpleString()
    rows = documents.select("doc_id", F.xxhash64("doc_id", "text").alias("key"), "text").mapInArrow(run, f"doc_id {kind}, key long, kind int, h long, n long, known long, logs double, score double, type long, codes array<long>, ps array<double>")
    if cold is not None:
        rows = _settled(cut(rows), cold)
    met = rows.join(words, ["kind", "h"], "left")
    is_doc, is_known = F.col("kind") == 0, F.col("kind") == KNOWN  # of the latter the text's row has n_known and logs
    c = F.when(is_known, F.col("known")).otherwise(F.coalesce("c", F.lit(0)))
    mixed = F.lit(MIX) * c / F.lit(float(mass)) + F.lit(1 - MIX) * F.pow(F.lit(10.0), "score")
    # below the smallest double only the tree's own share counts
    own = F.when(mixed > 0, F.log10(mixed)).otherwise(F.lit(float(np.log10(1 - MIX))) + F.col("score"))
    sums = met.groupBy("key").agg(
        F.count_if(is_doc).alias("copies"), F.sum(F.when(is_doc, F.col("n")).otherwise(0)).alias("n"),
        F.sum(F.when(is_doc, F.col("known")).otherwise(F.when(~is_known & (c > 0), F.col("n")).otherwise(0))).alias("known"),
        F.sum(F.when(is_doc, F.col("logs")).when(is_known, 0.0).otherwise(F.col("n") * F.log10(c + 1.0))).alias("logs"), F.sum(F.when(is_doc, F.col("score")).otherwise(F.col("n") * own)).alias("score"),
    )
    whole = lambda c: (F.col(c) / F.col("copies")).cast("long")
    base = F.col("logs") / F.col("copies") - whole("n") * F.log10(F.lit(float(total + kinds + 1)))
    scores = sums.select("key", whole("n").alias("n_tokens"), whole("known").alias("n_known"), F.lit(int(total)).cast("long").alias("train_tokens"), base.alias("base_score"), (F.col("score") / F.col("copies")).alias("score"))
    # written, so that AQE may split the rows of a document that is repeated very often
    keyed = documents.select("doc_id", F.xxhash64("doc_id", "text").alias("key"))
    return keyed.join(cut(scores), "key").drop("key")


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = held_out(F.col("doc_id"), 7, 2)
    scored = score(table(spark, sf_dir, "documents"), ~out)
    return scored.select("doc_id", out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
