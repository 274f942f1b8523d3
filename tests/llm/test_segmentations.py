"""Each of the N best segmentations has its own ids, score and round trip."""

import os
import random
import time

import pytest
from pyspark.sql import functions as F

pytest.importorskip("inkspan.llm")
from inkspan.llm import pieces  # noqa: E402

needs_vocabulary = pytest.mark.skipif(not os.path.exists(pieces.MODEL), reason="no vocabulary file")


@needs_vocabulary
def test_every_segmentation_has_its_own_ids(spark):
    v = pieces.load()
    coder, rng = pieces.Encoder(v), random.Random(6)
    texts = ["".join(rng.choice(["the", "n", " ", "in", "ü", "執", "  ", "a", "\n", "x", "ing "]) for _ in range(rng.randrange(14))) for _ in range(80)]
    rows = {r.doc_id: r for r in pieces.encode(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert max(len(r.n_best) for r in rows.values()) == 4
    for i, text in enumerate(texts):
        r = rows[i]
        assert len({tuple(x.ids) for x in r.n_best}) == len(r.n_best) and r.n_best[0].ids == r.ids and r.round_trip
        for x in r.n_best:
            ids = pieces.np.array(x.ids, int)
            assert coder.decode(ids) == text.encode()
            # a character of bytes costs the fallback once
            is_byte = pieces.np.isin(ids, v.byte_ids)
            n_chars = sum(b & 0xC0 != 0x80 for b in pieces.np.searchsorted(pieces.np.sort(v.byte_ids), ids[is_byte]).tolist())
            assert x.score == pytest.approx(float(v.scores[ids[~is_byte]].sum()) + n_chars * v.fallback)


@needs_vocabulary
def test_chunks_are_passed_once(monkeypatch):
    v, made = pieces.load(), []

    class Counted(pieces.Lattices):
        def __init__(self, *args):
            made.append(1)
            super().__init__(*args)

    monkeypatch.setattr(pieces, "Lattices", Counted)
    texts = ["the inner of the inner", "", " ", "  two  spaces ", "ü執 the ▁ the", "a\nb the", "inner"]
    coder = pieces.Encoder(v)
    told = lambda found: [([x.tolist() for x in ids], scores) for ids, scores in found]
    first, n = told(coder.segmentations(texts)), len(made)
    assert told(coder.segmentations(texts[::-1])) == first[::-1] and len(made) == n
    assert [coder.restored([v.byte_ids[:0], *(pieces.np.array(x, int) for x in ids)])[1:] for ids, _ in first] == [[t.encode()] * len(ids) for t, (ids, _) in zip(texts, first, strict=True)]
    # a full table is emptied, and results stay
    monkeypatch.setattr(pieces, "CHUNKS", 0)
    assert told(coder.segmentations(texts)) == first and len(made) > n


@needs_vocabulary
def test_workers_drop_their_chunks_after_a_query(spark):
    docs = spark.range(200).select(F.col("id").alias("doc_id"), F.concat(F.lit("the inner "), F.hex("id")).alias("text"))
    pieces.encode(docs.repartition(4)).write.format("noop").mode("overwrite").save()
    time.sleep(pieces.REST + 2)

    def held(batches):
        for b in batches:
            yield pieces.pa.RecordBatch.from_arrays([pieces.pa.array([len(c.known) for c in pieces._coders.values()], pieces.pa.int64())], names=["n"])

    # the same workers, which Spark keeps for later queries
    assert spark.range(0, 400, 1, 4).mapInArrow(held, "n long").collect() == []
