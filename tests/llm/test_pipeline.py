"""The pipeline against brute force, with repeated rows and null ids."""

import itertools
import os
import random
import re
from collections import Counter

import pytest

pytest.importorskip("inkspan.llm")
import corpus_pipeline  # noqa: E402
from inkspan.llm import jaccard, pieces  # noqa: E402

needs_vocabulary = pytest.mark.skipif(not os.path.exists(pieces.MODEL), reason="no vocabulary file")


def in_words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").lower())


def kept_one(rows, size=5, percent=80):
    """Brute force: of each component the row of the smallest doc_id (null last); texts without words all stay."""
    sets = {}
    for i, t in rows:
        ws = in_words(t)
        if ws:
            sets[i, t] = {tuple(ws[k : k + size]) for k in range(max(len(ws) - size + 1, 1))}
    group = {k: {k} for k in sets}
    for a, b in itertools.combinations(sets, 2):
        n = len(sets[a] & sets[b])
        if n and 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n) and group[a] is not group[b]:
            group[a] |= group[b]
            for k in group[b]:
                group[k] = group[a]
    components = {id(g): g for g in group.values()}.values()
    return [r for r in rows if not in_words(r[1])] + [min(g, key=lambda k: (k[0] is None, k[0])) for g in components]


def without_repeats(rows, length=200):
    seen = Counter(t[j : j + length] for _, t in rows if t for j in range(len(t) - length + 1))
    out = []
    for i, t in rows:
        gone = {k for j in range(len(t or "") - length + 1) if seen[t[j : j + length]] > 1 for k in range(j, j + length)}
        out.append((i, t if t is None else "".join(c for k, c in enumerate(t) if k not in gone)))
    return out


def repeated_rows():
    rng = random.Random(8)
    text = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    long, other, near, passage = text(60), text(60), text(60), text(40)
    rows = [(1, long), (1, long), (1, long), (2, long), (None, other), (None, other), (None, ""), (None, None), (4, ""), (None, "a lone short one")]
    rows += [(None, near), (9, near + " more"), (None, near + " other"), (11, text(5) + " " + passage + " " + text(50)), (12, text(50) + " " + passage), (13, "too short"), (13, "another text of this id")]
    return rows, text(12)


def by_text(rows):
    return sorted(rows, key=repr)


def test_one_row_of_each_component_stays(spark):
    rows, _ = repeated_rows()
    got = [tuple(r) for r in jaccard.keep_one(spark.createDataFrame(rows, "doc_id long, text string"), 5, 80).collect()]
    assert by_text(got) == by_text(kept_one(rows))


@needs_vocabulary
def test_pipeline_against_brute_force(spark, tmp_path):
    rows, item = repeated_rows()
    rows += [(20, "before it " + item + " after it")]
    write = lambda name, data, schema: spark.createDataFrame(data, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    write("documents", rows, "doc_id long, text string")
    write("labels", [], "doc_id long, quality int, toxic int")  # without labels every document passes
    write("benchmark", [(1, item)], "item_id long, text string")
    windows = lambda t: {tuple(in_words(t)[k : k + 10]) for k in range(len(in_words(t)) - 9)}
    want = [(i, t) for i, t in without_repeats(kept_one(rows)) if not windows(t) & windows(item)]
    made = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert by_text((r.doc_id, r.text) for r in made) == by_text(want)
    coder = pieces.Encoder(pieces.load())
    for r in made:
        assert r.round_trip and [x.score for x in r.n_best] == r.n_best_scores and r.n_best[0].ids == r.ids
        assert {coder.decode(pieces.np.array(x.ids, int)).decode() for x in r.n_best} == {r.text or ""}


def test_stages_send_texts_in_small_batches(spark):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    was, docs = spark.conf.get(key), spark.sql("SELECT id AS doc_id, 'short' AS text FROM range(0, 9000, 1, 1)")

    def sizes(batches):
        for b in batches:
            yield pieces.pa.RecordBatch.from_arrays([pieces.pa.array([b.num_rows])], names=["n"])

    try:
        assert corpus_pipeline.repeats_stage(spark, docs, "").count() == 9000
        assert [r.n for r in docs.mapInArrow(sizes, "n long").collect()] == [1024] * 8 + [808]
        spark.conf.set(key, 100)
        corpus_pipeline.repeats_stage(spark, docs, "")
        assert spark.conf.get(key) == "100"
    finally:
        spark.conf.set(key, was)
