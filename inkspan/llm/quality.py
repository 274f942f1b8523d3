"""Quality classifier: random-indexing word vectors, pooled per document, and a small network.

Random indexing.  Every word has a sparse ternary index vector that its hash alone
decides.  A word's context vector is the sum of the index vectors of the words
around it in the training sample; it is kept for the VOCABULARY most frequent words
of the sample, and other words use their index vector.  A document is pooled into the
mean and the spread of its words' vectors, the mean of their index vectors and of the
products of neighbouring index vectors, and a few logarithmic counts.

Network.  Two layers in numpy (tanh, then logistic), trained with Adam on the sample,
with its output temperature fitted on a part of the sample left out of training, so
that scores are calibrated probabilities.

The training sample is bounded: at most SAMPLE labelled documents per class, those of the
lowest hash of doc_id, and of these as many, in this order, as have SAMPLE_BYTES together.
One task fits on it, and only the model (VOCABULARY vectors of DIMS numbers, pickled) passes
through the driver.  Scoring reads every whole text once, in tasks.

Defined results: null texts are empty; a document without words gets the network's
score of the zero vector; without labels of both classes every score is the share of
label 1 (1 if there are none); conflicting labels of one doc_id all count; a null
doc_id is never held out and takes no label; rows may repeat; a column `score` is
replaced, other columns stay.
"""

from __future__ import annotations

import pickle

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import slabs, table, utf8, word_hashes, word_spans

DIMS = 64
NONZERO = 4
REACH = 2
SAMPLE = 2500
SAMPLE_BYTES = 64 << 20
#: A sampled text has at most this share of its class's bytes (half of SAMPLE_BYTES).
SHARE = 16
VOCABULARY = 50_000
HIDDEN = 32
THRESHOLD = 0.7


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def index_vectors(words: np.ndarray) -> np.ndarray:
    """NONZERO entries of +-1 per word, placed by its hash."""
    out, x, rows = np.zeros((len(words), DIMS), np.float32), words.copy(), np.arange(len(words))
    for _ in range(NONZERO):
        x = x * np.uint64(6364136223846793005) + np.uint64(1442695040888963407)
        np.add.at(out, (rows, ((x >> np.uint64(33)) % np.uint64(DIMS)).astype(np.int64)), np.where(x >> np.uint64(63), 1, -1))
    return out


def hashed_words(texts: list[bytes]):
    """Per slab: word hashes, and where each text's begin."""
    for i, j, data, starts in slabs(texts):
        a, b = word_spans(data)
        yield i, j, word_hashes(data, a, b), np.searchsorted(a, starts)


class Vectors:
    """Context vectors of the sample's frequent words."""

    def __init__(self, texts: list[bytes]) -> None:
        parts = list(hashed_words(texts))
        every = np.concatenate([h for _, _, h, _ in parts]) if parts else np.zeros(0, np.uint64)
        words, n = np.unique(every, return_counts=True)
        keep = np.sort(np.lexsort((words, -n))[:VOCABULARY])
        self.words = words[keep]
        index = index_vectors(words)
        sums = np.zeros((len(self.words), DIMS), np.float32)
        place = np.full(len(words), -1)
        place[keep] = np.arange(len(keep))
        for _, _, h, at in parts:
            which = np.searchsorted(words, h)
            for d in range(len(at) - 1):
                w = which[at[d] : at[d + 1]]
                for step in range(1, REACH + 1):
                    left, right = w[:-step], w[step:]
                    for own, other in ((left, right), (right, left)):
                        p = place[own]
                        np.add.at(sums, p[p >= 0], index[other[p >= 0]])
        self.context = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-6)

    def pooled(self, texts: list[bytes]) -> np.ndarray:
        out = []
        for i, j, h, at in hashed_words(texts):
            code, distinct = pd.factorize(h)
            index = index_vectors(distinct)
            unit = index / np.maximum(np.linalg.norm(index, axis=1, keepdims=True), 1e-6)
            if len(self.words):
                k = np.minimum(np.searchsorted(self.words, distinct), len(self.words) - 1)
                unit = np.where((self.words[k] == distinct)[:, None], self.context[k], unit)
            for d in range(j - i):
                w = code[at[d] : at[d + 1]]
                if not len(w):
                    out.append(np.zeros(4 * DIMS + 3, np.float32))
                    continue
                u, n = np.unique(w, return_counts=True)
                share = (n / len(w)).astype(np.float32)
                mean = share @ unit[u]
                spread = np.sqrt(np.maximum(share @ unit[u] ** 2 - mean**2, 0))
                # a bounded number of words at a time
                near = sum((index[w[s : s + 4096]] * index[w[s + 1 : s + 4097]]).sum(0) if s + 4097 <= len(w) else (index[w[s:-1]] * index[w[s + 1 :]]).sum(0) for s in range(0, len(w) - 1, 4096)) / max(len(w) - 1, 1)
                out.append(np.concatenate([mean, spread, share @ index[u], near * np.ones(DIMS), [np.log1p(len(w)) / 4, len(u) / len(w), share.max()]]).astype(np.float32))
        return np.array(out, np.float32).reshape(len(texts), 4 * DIMS + 3)


class Network:
    """tanh layer and logistic output, with a fitted temperature."""

    def __init__(self, x: np.ndarray, y: np.ndarray, seed: int = 7) -> None:
        rng = np.random.default_rng(seed)
        self.mean, self.scale = x.mean(0), x.std(0) + 1e-4
        z = self._standard(x)
        order = rng.permutation(len(z))
        held, fit = order[: len(z) // 6], order[len(z) // 6 :]
        self.p = [rng.normal(0, z.shape[1] ** -0.5, (z.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(1)]
        self.temperature = 1.0
        m, v, t, rate = [np.zeros_like(p) for p in self.p], [np.zeros_like(p) for p in self.p], 0, 0.01
        for _ in range(40):
            rng.shuffle(fit)
            for k in range(0, len(fit), 128):
                b = fit[k : k + 128]
                h = np.tanh(z[b] @ self.p[0] + self.p[1])
                g = (1 / (1 + np.exp(-(h @ self.p[2] + self.p[3]))) - y[b]) / len(b)
                back = np.outer(g, self.p[2]) * (1 - h * h)
                grads = [z[b].T @ back + 1e-4 * self.p[0], back.sum(0), h.T @ g + 1e-4 * self.p[2], np.array([g.sum()])]
                t += 1
                for i, d in enumerate(grads):
                    m[i] = 0.9 * m[i] + 0.1 * d
                    v[i] = 0.999 * v[i] + 0.001 * d * d
                    self.p[i] = self.p[i] - rate * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)
            rate *= 0.93
        if len(held) >= 20:
            logit, own = self._logit(z[held]), y[held]
            loss = lambda s: float(np.mean(np.logaddexp(0, logit / s) - own * logit / s))
            self.temperature = float(min(np.geomspace(0.5, 8, 60), key=loss))

    def _standard(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -6, 6).astype(np.float64)

    def _logit(self, z: np.ndarray) -> np.ndarray:
        return np.tanh(z @ self.p[0] + self.p[1]) @ self.p[2] + self.p[3]

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self._logit(self._standard(x)) / self.temperature))


class Constant:
    def __init__(self, share: float) -> None:
        self.share = share

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.full(len(x), self.share)


def fitted(rows: pd.DataFrame, counts: dict[int, int]):
    """(vectors, network) from rows (doc_id, text, y); counts: labels of each class."""
    rows = rows.sort_values(["doc_id", "text", "y"]).drop_duplicates()
    texts, y = [t.encode() for t in rows["text"]], rows["y"].to_numpy(float)
    vectors = Vectors(texts)
    total = sum(counts.values())
    if len(set(y.tolist())) < 2:
        return vectors, Constant(counts.get(1, 0) / total if total else 1.0)
    network = Network(vectors.pooled(texts), y)
    # the sample holds as many of each class as it can: shift the output to the classes' shares among all labels
    prior = np.log(counts[1] / counts[0]) - np.log(y.sum() / (len(y) - y.sum()))
    network.p[3] = network.p[3] + prior * network.temperature
    return vectors, network


def fit(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE, sample_bytes: int = SAMPLE_BYTES) -> bytes:
    """The pickled (vectors, network) from at most `sample` labelled documents of each class that are not held out.

    A text of over 1 / SHARE of its class's bytes is not learned from, so no text takes the room of those after it.
    """
    own = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & ~held_out(F.col("doc_id"))).select("doc_id", F.when(F.col("quality") > 0, 1).otherwise(0).alias("y"))
    few = None
    for y in (0, 1):
        part = own.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
        few = part if few is None else few.unionByName(part)
    counts = {r["y"]: r["count"] for r in own.groupBy("y").count().collect()}
    text = F.coalesce("text", F.lit(""))
    rows = documents.select("doc_id", text.alias("text"), F.xxhash64("doc_id").alias("at")).where(F.octet_length("text") <= sample_bytes // 2 // SHARE).join(F.broadcast(few), "doc_id").dropDuplicates(["doc_id", "text", "y"])
    before = Window.partitionBy("y").orderBy("at", "doc_id", F.xxhash64("text")).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("bytes", F.sum(F.octet_length("text")).over(before)).where(F.col("bytes") <= sample_bytes // 2).select("doc_id", "text", "y")

    def run(batches):
        held = list(batches)
        yield pd.DataFrame({"model": [pickle.dumps(fitted(pd.concat(held), counts))] if held else []})

    # a bounded sample, so one task holds it
    made = rows.coalesce(1).mapInPandas(run, "model binary").collect()
    return bytes(made[0]["model"]) if made else pickle.dumps(fitted(pd.DataFrame({"doc_id": [], "text": [], "y": []}), counts))


def score(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """All columns of documents and `score`, the probability that the label is 1."""
    model = fit(documents, labels, sample)
    documents = documents.drop("score")
    schema = T.StructType([*documents.schema.fields, T.StructField("score", T.DoubleType())])
    text_at = documents.columns.index("text")

    def run(batches):
        vectors, network = pickle.loads(model)
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                s = network.score(vectors.pooled(utf8(part.column(text_at)))) if part.num_rows else np.zeros(0)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(s, pa.float64())], names=schema.names)

    return documents.mapInArrow(run, schema)


def keep_good(documents: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents of at least the threshold's score, all columns kept."""
    kept = documents.withColumnRenamed("score", "__score") if "score" in documents.columns else documents
    return score(kept, labels).where(F.col("score") >= threshold).drop("score").toDF(*documents.columns)


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score(docs, table(spark, sf_dir, "labels"))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
