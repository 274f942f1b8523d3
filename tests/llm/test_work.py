"""Work that must be done once only."""

import random

import numpy as np
import pytest

pytest.importorskip("inkspan.llm")
from inkspan.llm import components, jaccard, suffix_dedup, token_files  # noqa: E402


def test_members_of_open_groups_are_made_once(spark):
    made = spark.sparkContext.accumulator(0)

    def run(batches):
        for b in batches:
            made.add(b.num_rows)
            yield b

    rows = spark.createDataFrame([(c, s, 5, 0, s) for c in range(3) for s in range(10 * c, 10 * c + 4)], "center long, sid long, n int, low long, comp long")
    left = jaccard._open(rows.mapInArrow(run, rows.schema))
    assert left.count() == 12 and made.value == 12


def test_a_small_set_beside_large_ones_does_not_blind_their_bitmaps():
    rng = np.random.default_rng(5)
    sets = [np.unique(rng.integers(0, 2**63, n, dtype=np.uint64)) for n in (10, 2000, 2100)]
    t = jaccard.tree([(i, len(s), i, int(s[0]), np.frombuffer(jaccard.bitmap(s, len(s)), np.uint8), s) for i, s in enumerate(sets)])
    assert jaccard.members_that_may_link(t, t, 85) == set()
    near = [np.sort(np.concatenate([s[:-9], rng.integers(0, 2**63, 9, dtype=np.uint64)])) for s in sets[1:]]
    t = jaccard.tree([(i, len(s), i, int(s[0]), np.frombuffer(jaccard.bitmap(s, len(s)), np.uint8), s) for i, s in enumerate(sets + near)])
    assert jaccard.members_that_may_link(t, t, 85) == {1, 2, 3, 4} and {tuple(sorted(x)) for x in jaccard.joining_links(t, t, 85)} == {(1, 3), (2, 4)}


def test_stars_are_settled_without_a_round(spark, monkeypatch):
    made, own = [], components._least
    monkeypatch.setattr(components, "_least", lambda *x: made.append(1) or own(*x))
    star = spark.createDataFrame([(1, 5), (6, 1), (9, 8)], "u long, v long")
    assert {tuple(r) for r in components.components(star).collect()} == {(1, 1), (5, 1), (6, 1), (8, 8), (9, 8)} and not made
    chain = spark.createDataFrame([(i, i + 1) for i in range(40)], "u long, v long")
    assert {tuple(r) for r in components.components(chain).collect()} == {(i, 0) for i in range(41)} and made


def test_words_that_come_again_stay_when_a_worker_has_too_many(monkeypatch):
    monkeypatch.setattr(token_files, "WORDS", 300)
    coder, made = token_files.Encoder(), []
    own = coder._together
    monkeypatch.setattr(coder, "_together", lambda words: made.extend(words) or own(words))
    texts = [" ".join(f"once{i}x{k} common{k % 20}" for k in range(100)) for i in range(30)]
    got = [coder.encode([x])[0].tolist() for x in texts]
    assert got == [coder.tokenizer.encode(x, add_special_tokens=False).ids for x in texts]
    # 3,000 words that come once, and 20 that always come: encoded a single time each
    assert len([x for x in made if x.startswith("common")]) == 20 and len(coder.known) <= 300


def test_entries_that_share_only_a_short_key_are_not_split_into_windows(spark, monkeypatch):
    rng = random.Random(3)
    text = lambda n: "".join(rng.choices("abcdefghij klmnop", k=n))
    phrase, twin = text(130), text(150)
    rows = [(i, text(300) + phrase + text(300)) for i in range(40)] + [(i, text(300) + twin + phrase + twin + text(300)) for i in (40, 41)]

    def never(batches):
        raise AssertionError("split into windows")

    monkeypatch.setattr(suffix_dedup, "HOT", 5)
    monkeypatch.setattr(suffix_dedup, "_windows", never)
    got = {r["doc_id"]: r["n_removed"] for r in suffix_dedup.report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(got) == 42
    for i, t in rows:
        others = [x for j, x in rows if j != i]
        gone = {k for s in range(len(t) - 199) if any(t[s : s + 200] in x for x in others) for k in range(s, s + 200)}
        assert got[i] == len(gone) and (len(gone) >= 430) == (i >= 40)
