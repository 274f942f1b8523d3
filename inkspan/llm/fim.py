"""Fill-in-the-middle: each text is cut into prefix, middle and suffix and put together in another order.

Counting goes over the UTF-8 bytes in blocks of BLOCK and notes a checkpoint every EVERY
units: byte and code-point offset of that unit.  A cut is found by a binary search of the
checkpoints and a rescan of at most EVERY units from there, so no text is ever decoded or
held as one entry per character.  A unit is a code point, or a word (a run of
bytes other than ASCII white space, with the white space after it).

The draw depends on seed and doc_id alone: h1 to h4 are the first four groups of 8 hex
digits of the SHA-256 of "seed:doc_id".  Of n units the prefix takes the smaller of
h1 % (n + 1) and h2 % (n + 1), the middle ends at the larger.  A text stays plain if it is
empty or holds a mark, or if h3 % 100 reaches `rate`; the others are spm if h4 % 100 is
below `spm`, else psm.

    psm  <P>prefix<S>suffix<M>middle        spm  <S>suffix<P>prefix<M>middle

Marks hold neither a proper prefix of a mark at their end nor another mark, which is
checked, so the text can be rebuilt from output and form (`restore`).

Defined results: a null text is an empty one; a null doc_id is drawn as an empty string;
repeated rows give a row each, with equal results; columns that share a name with
a new one are replaced; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import parts, table, utf8

#: Prefix, suffix and middle marks.
MARKS = ("<P>", "<S>", "<M>")
#: Units between checkpoints, and bytes that are counted at once.
EVERY = 4096
BLOCK = 1 << 16
#: Bytes of output that a task hands on at once.
OUT_BYTES = 8 << 20
_SPACE = np.isin(np.arange(256), [32, *range(9, 14)])


class Checkpoints:
    """Sparse index of a text: byte and code-point offset of every EVERY-th unit."""

    def __init__(self, data: np.ndarray, unit: str = "char", every: int = EVERY, block: int = BLOCK) -> None:
        self.data, self.unit, self.block, self.opening = data, unit, block, 0
        if unit == "word":  # white space that opens a text belongs to its first unit
            while self.opening < len(data) and _SPACE[data[self.opening]]:
                rest = ~_SPACE[data[self.opening : self.opening + block]]
                self.opening += int(np.argmax(rest)) if rest.any() else len(rest)
        self.units = self.chars = 0
        unit_at, byte_at, char_at = [], [], []
        for lo in range(0, len(data), block):
            begins, lead = self._begins(lo, lo + block), (data[lo : lo + block] & 0xC0) != 0x80
            take = np.arange(-self.units % every, len(begins), every)
            if len(take):
                before = np.cumsum(lead) - lead
                unit_at.append(self.units + take)
                byte_at.append(lo + begins[take])
                char_at.append(self.chars + before[begins[take]])
            self.units += len(begins)
            self.chars += int(np.count_nonzero(lead))
        self.unit_at, self.byte_at, self.char_at = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (unit_at, byte_at, char_at))

    def _begins(self, lo: int, hi: int) -> np.ndarray:
        """Where in the bytes lo to hi units begin, counted from lo; the first byte of a text begins one."""
        if self.unit == "char":
            return np.flatnonzero((self.data[lo:hi] & 0xC0) != 0x80)
        space = _SPACE[self.data[max(lo - 1, 0) : hi]]
        begins = np.flatnonzero(~space[1:] & space[:-1]) + (lo == 0)
        if self.opening:
            begins = begins[begins + lo != self.opening]
        return begins if lo else np.concatenate([[0], begins])

    def cut(self, unit: int) -> tuple[int, int]:
        """Byte and code-point offset at which a unit begins; the text's end beyond the last."""
        if unit >= self.units:
            return len(self.data), self.chars
        k = int(np.searchsorted(self.unit_at, unit, "right")) - 1
        at, char = int(self.byte_at[k]), int(self.char_at[k])
        left = unit - int(self.unit_at[k])
        if not left:
            return at, char
        to = int(self.byte_at[k + 1]) if k + 1 < len(self.byte_at) else len(self.data)
        lo = at + 1
        while True:
            hi = min(lo + self.block, to)
            begins = self._begins(lo, hi)
            if len(begins) >= left:
                end = lo + int(begins[left - 1])
                return end, char + int(np.count_nonzero((self.data[at:end] & 0xC0) != 0x80))
            left -= len(begins)
            char += int(np.count_nonzero((self.data[at:hi] & 0xC0) != 0x80))
            at = lo = hi


def _checked(marks: tuple[str, str, str]) -> tuple[bytes, bytes, bytes]:
    raw = tuple(m.encode() for m in marks)
    for a in raw:
        for b in raw:
            if a is not b and a in b or any(a.endswith(b[:i]) for i in range(1, min(len(a), len(b) + (a is not b)))):
                raise ValueError("marks must not overlap one another")
    return raw


def draw(seed: int, doc_id) -> list[int]:
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(digest[i : i + 8], 16) for i in range(0, 32, 8)]


def transform(documents: DataFrame, seed: int = 1, rate: int = 90, spm: int = 20, unit: str = "char", marks: tuple[str, str, str] = MARKS) -> DataFrame:
    """All columns of documents and n (units), form, prefix_chars, middle_chars (null if plain), output."""
    p, s, m = raw_marks = _checked(marks)
    if unit not in ("char", "word"):
        raise ValueError("a unit is a char or a word")
    documents = documents.drop("n", "form", "prefix_chars", "middle_chars", "output")
    made = T.StructType().add("n", T.LongType()).add("form", T.StringType()).add("prefix_chars", T.LongType()).add("middle_chars", T.LongType()).add("output", T.StringType())
    schema = T.StructType([*documents.schema.fields, *made.fields])
    id_at, text_at = documents.columns.index("doc_id"), documents.columns.index("text")

    def one(doc_id, text: bytes) -> tuple:
        index = Checkpoints(np.frombuffer(text, np.uint8), unit)
        n, (h1, h2, h3, h4) = index.units, draw(seed, doc_id)
        if not text or any(x in text for x in raw_marks) or h3 % 100 >= rate:
            return n, "plain", None, None, text
        (a, a_chars), (b, b_chars) = (index.cut(x) for x in sorted((h1 % (n + 1), h2 % (n + 1))))
        view = memoryview(text)
        if h4 % 100 < spm:
            return n, "spm", a_chars, b_chars - a_chars, b"".join((s, view[b:], p, view[:a], m, view[a:b]))
        return n, "psm", a_chars, b_chars - a_chars, b"".join((p, view[:a], s, view[b:], m, view[a:b]))

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in parts(batches):
            at, rows, size = 0, [], 0

            def made(to: int) -> pa.RecordBatch:
                n, form, prefix, middle, output = zip(*rows, strict=True)
                new = [pa.array(n, pa.int64()), pa.array(form, pa.string()), pa.array(prefix, pa.int64()), pa.array(middle, pa.int64()), pa.array(output, pa.binary()).cast(pa.string())]
                return pa.RecordBatch.from_arrays([*batch.slice(at, to - at).columns, *new], names=schema.names)  # noqa: B023

            for i, (doc_id, text) in enumerate(zip(batch.column(id_at).to_pylist(), utf8(batch.column(text_at)), strict=True)):
                rows.append(one(doc_id, text))
                size += len(text)
                if size > OUT_BYTES:
                    yield made(i + 1)
                    at, rows, size = i + 1, [], 0
            if rows:
                yield made(batch.num_rows)

    return documents.mapInArrow(run, schema)


def restore(output: Column, form: Column, marks: tuple[str, str, str] = MARKS) -> Column:
    """The text that an output of this form was made from."""
    p, s, m = marks
    middle = F.substring_index(output, m, -1)
    front = F.substring_index(output, m, 1)
    psm = F.concat(F.substring_index(F.substring_index(front, p, -1), s, 1), middle, F.substring_index(front, s, -1))
    spm = F.concat(F.substring_index(front, p, -1), middle, F.substring_index(F.substring_index(front, s, -1), p, 1))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = transform(table(spark, sf_dir, "documents").select("doc_id", "text"))
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"), digest(restore(F.col("output"), F.col("form"))).alias("restored_sha256"))


OP13_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(cast(doc_id AS varchar), '')) AS h FROM documents),
g AS (SELECT doc_id, t, cast(length(t) AS bigint) AS n, cast('0x' || h[1:8] AS bigint) AS h1, cast('0x' || h[9:16] AS bigint) AS h2,
             cast('0x' || h[17:24] AS bigint) AS h3, cast('0x' || h[25:32] AS bigint) AS h4 FROM d),
c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
             CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain'
                  WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM g),
o AS (SELECT *, substr(t, 1, a) AS p, substr(t, a + 1, b - a) AS m, substr(t, b + 1) AS s FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM o
"""
