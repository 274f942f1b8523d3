"""Token ids in ORC files that can be read by stripes, by document and by position.

Documents are range-partitioned and sorted by doc_id, encoded in that order, and written as
one ORC file per partition by Spark's writer: integer run-length encoding, stripes of
STRIPE_BYTES, a row index every STRIDE rows, Bloom filters on doc_id.  Each row holds
doc_id, n_tokens, `at` (ids before it within its file) and its ids.  A manifest beside the
files holds one row per file: how many ids come before it, its ids and its range of doc_ids.

`read` gives back all documents with their place in the whole; Spark splits the files into
stripes.  `lookup` asks for documents (row indexes and Bloom filters leave out what cannot
hold them), `between` for a range of token positions (the manifest names the files).

Encoding works on words: a text may be cut before a space that has no white space on
either side, since no token of the pre-tokenizer spans such a place.  So a worker keeps
the ids of up to WORDS different words and only encodes new ones (when they are too many, those
that came more than once stay), and a text of any length is encoded in runs of about RUN characters.

Defined results: a null text is empty, so it has the end id only; rows are in order of
doc_id, nulls first, rows of one doc_id by the hash of their text; repeated rows give a row each;
other columns of the input are not written; an empty table gives no rows.
"""

from __future__ import annotations

import functools
import itertools
import os
import re
import uuid
import zlib
from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import parts, shared_dir, table

MODEL = "/opt/tokenizers/byte_bpe_50k.json"
END = 2
STRIPE_BYTES = 16 << 20
STRIDE = 1000
#: Words that a worker keeps at most, and characters that are encoded at once.
WORDS = 3 << 18
RUN = 1 << 20
#: Files whose manifest is broadcast at most (some 60 bytes each); beyond, it is joined by a shuffle.
FILES = 100_000
_CUT = re.compile(r"(?<!\s) (?!\s)")
_UNEVEN = re.compile(r"\s | \s")
#: Other white space than the space, as far as ASCII goes.
_OTHER = "\t\n\v\f\r\x1c\x1d\x1e\x1f"

#: Other white space, by code point.
_WIDE = [*map(chr, (0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000))]


class Encoder:
    """Ids of texts by a tokenizer file, through a bounded table of words."""

    def __init__(self, model: str = MODEL) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(model)
        self.tokenizer.model._resize_cache(0)  # words come once
        vocabulary = self.tokenizer.get_vocab()
        self.spaced = np.zeros(max(vocabulary.values()) + 1, bool)
        # byte-level vocabularies write a space as U+0120
        self.spaced[[i for x, i in vocabulary.items() if x[0] == "\u0120"]] = True
        self.known: dict[str, int] = defaultdict(itertools.count().__next__)
        self.flat, self.ends, self.often = np.zeros(1 << 16, np.int32), np.zeros(1 << 14, np.int64), np.zeros(0, np.int64)
        self.learnt = 0

    def _forget(self) -> None:
        """Keeps the words that came more than once, half as many as there may be at most; a count halves each time."""
        kept = np.flatnonzero(self.often > 1)
        if len(kept) > WORDS // 2:
            kept = np.sort(kept[np.argsort(-self.often[kept], kind="stable")[: WORDS // 2]])
        words = list(self.known)
        self.known.clear()  # before the next one is built
        self.known = defaultdict(itertools.count(len(kept)).__next__, zip(map(words.__getitem__, kept.tolist()), range(len(kept)), strict=True))
        size = self.ends[kept + 1] - self.ends[kept]
        end = np.concatenate([[0], np.cumsum(size)])
        self.flat = self.flat[np.repeat(self.ends[kept] - end[:-1], size) + np.arange(int(end[-1]))]
        self.ends, self.often, self.learnt = end, self.often[kept] // 2, len(kept)

    def _learn(self) -> None:
        """Appends the ids of new words to `flat`, where word i ends at ends[i + 1]."""
        # a dict is in order of insertion, so new words come last
        new = list(itertools.islice(reversed(self.known), len(self.known) - self.learnt))[::-1]
        at, used = self.learnt, int(self.ends[self.learnt])
        while at < len(new) + self.learnt:
            i = at - self.learnt
            to = i
            while to < len(new) and " " not in new[to]:
                to += 1
            if to > i:
                ids, sizes = self._together(new[i:to])
            else:
                # a word that opens a text is kept with a space before it, any other one had a space
                word = new[i][1:] if new[i][0] == " " else " " + new[i]
                ids = np.array(self.tokenizer.encode(word, add_special_tokens=False).ids, np.int32)
                sizes = np.array([len(ids)])
            end = used + len(ids)
            if end > len(self.flat):
                self.flat = np.resize(self.flat, 2 * end)
            if at + len(sizes) >= len(self.ends):
                self.ends = np.resize(self.ends, 2 * (at + len(sizes)))
            self.flat[used:end] = ids
            self.ends[at + 1 : at + 1 + len(sizes)] = used + np.cumsum(sizes)
            at, used = at + len(sizes), end
        self.learnt = at

    def _together(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words without spaces and how many each has, encoded as one text: a token with a space in front begins a word."""
        [made] = self.tokenizer.encode_batch_fast([" " + " ".join(words)], add_special_tokens=False)
        ids = np.array(made.ids, np.int32)
        at = np.flatnonzero(self.spaced[ids])
        assert len(at) == len(words)
        return ids, np.diff(at, append=len(ids))

    def _words(self, text: str) -> list[str]:
        # looking for one character is far quicker than for two
        uneven = "  " in text or any(x in text and (x + " " in text or " " + x in text) for x in _OTHER) or any(x in text for x in _WIDE) and _UNEVEN.search(text)
        words = _CUT.split(text) if uneven else text.split(" ")
        words[0] = " " + words[0]
        return words

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text, together within bounded memory if the texts are."""
        words = list(map(self._words, texts))
        counts = np.cumsum([0, *map(len, words)])
        codes = np.fromiter(map(self.known.__getitem__, itertools.chain.from_iterable(words)), np.int64, int(counts[-1]))
        del words
        self._learn()
        often = np.bincount(codes, minlength=self.learnt)
        often[: len(self.often)] += self.often
        self.often = often
        size = self.ends[codes + 1] - self.ends[codes]
        end = np.cumsum(size)
        at = np.concatenate([[0], end])[counts]
        ids = self.flat[np.repeat(self.ends[codes] - (end - size), size) + np.arange(int(at[-1]))]
        if len(self.known) > WORDS:
            self._forget()
        return [ids[a:b] for a, b in itertools.pairwise(at.tolist())]

    def encode_long(self, text: str) -> np.ndarray:
        """Ids of one text, in runs of about RUN characters; a later run begins with its space."""
        made, at = [], 0
        while at < len(text):
            found = _CUT.search(text, at + RUN) if len(text) - at > RUN else None
            to = found.start() if found else len(text)
            run = text[at:to]
            # a run after the first one begins with a space, so its first word is encoded with it
            made += self.encode([run])
            at = to
        return np.concatenate(made) if made else np.zeros(0, np.int32)


@functools.lru_cache(maxsize=1)
def _encoder(model: str) -> Encoder:
    """One per worker process, which keeps its words from task to task."""
    return Encoder(model)


def _runs(texts: list[str]) -> Iterator[tuple[int, int]]:
    at = 0
    while at < len(texts):
        to, size = at, 0
        while to < len(texts) and (to == at or size + len(texts[to]) < RUN):
            size += len(texts[to])
            to += 1
        yield at, to
        at = to


def encoded(documents: DataFrame, model: str = MODEL, end: int = END) -> DataFrame:
    """doc_id, n_tokens, at (ids before the row within its partition), ids; rows stay in their order."""

    def run(batches: Iterator[pa.RecordBatch]):
        coder, at = _encoder(model), 0
        tail = np.array([end], np.int32)
        for b in parts(batches):
            texts = [x or "" for x in b.column(1).to_pylist()]
            for lo, hi in _runs(texts):
                few = hi - lo == 1
                made = [coder.encode_long(texts[lo])] if few else coder.encode(texts[lo:hi])
                n = np.fromiter((len(x) + 1 for x in made), np.int64, hi - lo)
                offsets = np.concatenate([[0], np.cumsum(n)])
                ids = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(np.concatenate([y for x in made for y in (x, tail)])))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), pa.array(n), pa.array(at + offsets[:-1]), ids], names=["doc_id", "n_tokens", "at", "ids"])
                at += int(offsets[-1])

    kind = documents.schema["doc_id"].dataType.simpleString()
    return documents.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_tokens long, at long, ids array<int>")


def write(documents: DataFrame, folder: str | None = None, model: str = MODEL, end: int = END) -> str:
    """Writes all documents' ids below folder and returns it."""
    folder = folder or f"{shared_dir(documents.sparkSession)}/ids-{uuid.uuid4().hex}"
    rows = documents.select("doc_id", "text")
    # an id that many rows share is divided by the texts' hashes, equal rows by their numbers
    keys = [F.asc_nulls_first("doc_id"), F.xxhash64("text"), F.monotonically_increasing_id()]
    ordered = rows.repartitionByRange(*keys).sortWithinPartitions(F.asc_nulls_first("doc_id"), F.xxhash64("text"))
    made = encoded(ordered, model, end)
    options = {"orc.stripe.size": STRIPE_BYTES, "orc.row.index.stride": STRIDE, "orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": 0.01, "compression": "zstd"}
    made.write.options(**options).orc(f"{folder}/ids")
    files = _files(documents.sparkSession, folder).groupBy("file").agg(F.sum("n_tokens").alias("tokens"), F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id"))
    # one row per file; their names follow the order of the partitions
    files.withColumn("before", F.sum("tokens").over(Window.orderBy("file")) - F.col("tokens")).write.parquet(f"{folder}/manifest")
    return folder


def _files(spark: SparkSession, folder: str, names: Iterable[str] | None = None) -> DataFrame:
    paths = [f"{folder}/ids"] if names is None else [f"{folder}/ids/{x}" for x in names]
    if not paths:
        return spark.read.orc(f"{folder}/ids").where("false").withColumn("file", F.lit(""))
    return spark.read.orc(paths).withColumn("file", F.col("_metadata.file_name"))


def _placed(rows: DataFrame, folder: str) -> DataFrame:
    """rows of files with start, the ids before the row in all files."""
    manifest = rows.sparkSession.read.parquet(f"{folder}/manifest").select("file", "before")
    if manifest.limit(FILES + 1).count() <= FILES:
        manifest = F.broadcast(manifest)
    return rows.join(manifest, "file").withColumn("start", F.col("before") + F.col("at")).drop("before", "at", "file")


def read(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, n_tokens, ids, start of every document."""
    return _placed(_files(spark, folder), folder)


def lookup(spark: SparkSession, folder: str, doc_ids: list[int]) -> DataFrame:
    """The documents of these ids: stripes and rows whose index or Bloom filter cannot hold them are not read."""
    return _placed(_files(spark, folder).where(F.col("doc_id").isin(list(doc_ids))), folder)


def between(spark: SparkSession, folder: str, low: int, high: int) -> DataFrame:
    """The documents with ids at positions low to high - 1 of the whole; other files are not opened."""
    manifest = spark.read.parquet(f"{folder}/manifest").where((F.col("before") < high) & (F.col("before") + F.col("tokens") > low))
    names = [r["file"] for r in manifest.select("file").collect()]
    return _placed(_files(spark, folder, names), folder).where((F.col("start") < high) & (F.col("start") + F.col("n_tokens") > low))


def checksums(rows: DataFrame) -> DataFrame:
    """rows with ids_crc32, the CRC-32 of the ids as little-endian unsigned 32-bit integers, in place of ids."""
    others = [c for c in rows.columns if c not in ("ids", "ids_crc32")]

    def run(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            lists = b.column(len(others))
            ends = np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))])
            flat = lists.flatten().to_numpy().astype("<u4")
            made = [zlib.crc32(flat[x:y]) for x, y in itertools.pairwise(ends.tolist())]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(made, pa.int64())], names=[*others, "ids_crc32"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.select(*others).schema.fields)
    return rows.select(*others, "ids").mapInArrow(run, f"{kinds}, ids_crc32 long")


def op12_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = write(table(spark, sf_dir, "documents"))
    return checksums(read(spark, folder)).select("doc_id", "start", "n_tokens", "ids_crc32")
