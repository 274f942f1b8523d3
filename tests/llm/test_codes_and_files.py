"""Operators 11 to 13: brute force, round trips and edge cases."""

import hashlib
import random
import zlib
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("inkspan.llm")
from inkspan.llm import codes, fim, token_files  # noqa: E402

CLASH = ("n", "form", "output", "at", "ids", "start", "file", "before", "v", "own", "low", "error", "part", "entry", "sums", "key", "label_error")


def nearest(v, book):
    return min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), i) for i, c in enumerate(book))


def lloyd(rows, parts, entries, rounds):
    """rows: integer vectors, in order of ids."""
    w = len(rows[0]) // parts
    cut = [[r[p * w : (p + 1) * w] for r in rows] for p in range(parts)]
    books = [[list(v) for v in x[:entries]] for x in cut]
    for _ in range(rounds):
        for p in range(parts):
            near = [nearest(v, books[p])[1] for v in cut[p]]
            for e in range(len(books[p])):
                own = [v for v, k in zip(cut[p], near, strict=True) if k == e]
                if own:
                    books[p][e] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    found = [[nearest(cut[p][i], books[p]) for p in range(parts)] for i in range(len(rows))]
    return books, [([e for _, e in f], sum(d for d, _ in f)) for f in found]


@pytest.mark.parametrize("spread", [2, 40, 1 << 45])
def test_codes_against_plain_lloyd(spark, spread, monkeypatch):
    monkeypatch.setattr(codes, "GROUP", 4)
    monkeypatch.setattr(codes, "ROWS", 37)
    draw = random.Random(spread)
    # few different values make ties, far ones need more than doubles hold
    rows = [[draw.randint(-spread, spread) / 8 for _ in range(8)] for _ in range(150)]
    rows += rows[:20]
    df = spark.createDataFrame([(i, r, i % 3) for i, r in enumerate(rows)], "vec_id long, embedding array<double>, label int").repartition(3)
    made, books, work = codes.compress(df, parts=2, entries=24, rounds=4, scale=4)
    want, codes_of = lloyd([[int(np.floor(4 * x)) for x in r] for r in rows], 2, 24, 4)
    assert books == want
    got = {r.vec_id: (r.codes, r.error) for r in made.collect()}
    assert got == {i: (c, min(e, (1 << 63) - 1)) for i, (c, e) in enumerate(codes_of)}
    assert len(work) == 4 and (spread != 40 or work[3] < work[0])


def test_codes_skip_groups(spark):
    """On clustered vectors, with the shipped sizes, later rounds compute a part of the distances."""
    draw = np.random.default_rng(3)
    at = draw.normal(size=(40, 16))
    rows = [(i, (at[i % 40] + 0.02 * draw.normal(size=16)).tolist(), None) for i in range(3000)]
    _, _, work = codes.compress(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"))
    assert work[0] == 3000 * 4 * 256 and work[3] < 0.5 * work[0]


def test_codes_edge_cases(spark):
    nan = float("nan")
    rows = [(5, [1.0, 2.0], "a"), (5, [1.0, 2.0], "a"), (None, [0.5], None), (3, None, "a"), (4, [nan], "a"), (6, [None, 1.0], "a"), (7, [float("inf")], None), (8, [], None), (1, [1e300, -1e300, 0.0], "b")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string").withColumns({c: F.lit(5) for c in CLASH})
    made, books, _ = codes.compress(df)
    got = sorted(((r.vec_id, r.codes, r.error) for r in made.collect()), key=str)
    assert [x[0] for x in got] == [1, 5, 5, 8, None] and got[1] == got[2] and books[0][0] == [(1 << 63) - 1]
    assert all(r.label_error is not None for r in codes.label_errors(made).collect()) and codes.label_errors(made).count() == 5
    assert codes.compress(df.limit(0))[0].count() == 0
    middle = made.where("vec_id = 5").select(codes.decode(F.col("codes"), books).alias("v")).first().v
    assert len(middle) == 4 and abs(middle[0] - 1) < 0.01


def ids_of(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(token_files.MODEL)
    return [[*t.encode(x or "", add_special_tokens=False).ids, token_files.END] for x in texts]


def test_encoder_cuts_only_where_tokens_end(monkeypatch):
    coder, draw = token_files.Encoder(), random.Random(1)
    some = ["a", "b", " ", "  ", "\n", " ", "'s", " ", "1", "é", " ", "　", "\x85", "<|endoftext|>", "!", "执", "\t", " the", "\x1d"]
    texts = ["".join(draw.choices(some, k=draw.randint(0, 60))) for _ in range(2000)]
    want = [x[:-1] for x in ids_of(texts)]
    assert [x.tolist() for x in coder.encode(texts)] == want
    monkeypatch.setattr(token_files, "RUN", 20)
    monkeypatch.setattr(token_files, "WORDS", 50)
    assert [coder.encode_long(x).tolist() for x in texts] == want


def test_token_files(spark, monkeypatch):
    monkeypatch.setattr(token_files, "RUN", 5000)
    long = " ".join(f"word{i}" for i in range(20_000))
    rows = [(9, "nine  9"), (2, None), (7, ""), (5, long), (None, "no id"), (2, "two  two"), (4, "again"), (4, "again"), (-3, "<|endoftext|> x")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(5) for c in CLASH}).repartition(4)
    folder = token_files.write(df)
    got = token_files.read(spark, folder).orderBy("start").collect()
    assert [r.doc_id for r in got] == [None, -3, 2, 2, 4, 4, 5, 7, 9]
    assert sorted(map(str, (r.ids for r in got))) == sorted(map(str, ids_of([x for _, x in rows])))
    at = 0
    for r in got:
        assert (r.start, r.n_tokens) == (at, len(r.ids))
        at += len(r.ids)
    assert [r.doc_id for r in token_files.between(spark, folder, got[4].start, got[5].start + 1).orderBy("start").collect()] == [4, 4]
    assert {r.doc_id for r in token_files.lookup(spark, folder, [5, 9, 100]).collect()} == {5, 9}
    sums = {r.doc_id: r.ids_crc32 for r in token_files.checksums(token_files.read(spark, folder)).collect()}
    assert sums[9] == zlib.crc32(np.array(ids_of(["nine  9"])[0], "<u4").tobytes()) and sums[5] == zlib.crc32(np.array(ids_of([long])[0], "<u4").tobytes())
    assert token_files.read(spark, token_files.write(df.limit(0))).count() == 0


def test_token_files_have_stripes_indexes_and_filters(spark, monkeypatch):
    from pyarrow import orc

    monkeypatch.setattr(token_files, "STRIPE_BYTES", 1 << 16)
    df = spark.range(60_000).select((F.col("id") * 2).alias("doc_id"), F.concat_ws(" ", "id", F.sha2(F.col("id").cast("string"), 256)).alias("text"))
    folder = token_files.write(df)
    files = sorted(Path(folder.removeprefix("file://"), "ids").glob("*.orc"))
    assert sum(orc.ORCFile(str(f)).nstripes for f in files) > len(files)
    last = -1
    for f in files:  # ascending over the files too
        ids = orc.ORCFile(str(f)).read(columns=["doc_id"]).column(0).to_numpy()
        assert ids[0] > last and (np.diff(ids) > 0).all()
        last = ids[-1]

    def scanned(frame):
        frame.collect()
        plan = frame._jdf.queryExecution().executedPlan().toString()
        assert "PushedFilters" in plan
        return int(re_rows(frame))

    def re_rows(frame):
        node = frame._jdf.queryExecution().executedPlan()
        for leaf in (x.executedPlan() if "Adaptive" in x.nodeName() else x for x in [node]):
            leaves = leaf.collectLeaves()
            return sum(leaves.apply(i).metrics().apply("numOutputRows").value() for i in range(leaves.size()))

    rows = token_files._files(spark, folder).select("doc_id")
    assert scanned(rows.where(F.col("doc_id") == 40_000)) <= 4 * token_files.STRIDE
    assert scanned(rows.where(F.col("doc_id") == 40_001)) <= token_files.STRIDE  # within the range of a row group, but its filter says no


def plain_fim(doc_id, text, seed=1, rate=90, spm=20):
    text = text or ""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    n = len(text)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not text or any(m in text for m in fim.MARKS) or h[2] % 100 >= rate:
        return n, "plain", None, None, text
    p, m, s = text[:a], text[a:b], text[b:]
    return (n, "spm", a, b - a, f"<S>{s}<P>{p}<M>{m}") if h[3] % 100 < spm else (n, "psm", a, b - a, f"<P>{p}<S>{s}<M>{m}")


def test_fim_against_plain_strings(spark, monkeypatch):
    monkeypatch.setattr(fim, "EVERY", 7)
    monkeypatch.setattr(fim, "BLOCK", 11)
    monkeypatch.setattr(fim, "OUT_BYTES", 100)
    draw = random.Random(5)
    rows = [(i, "".join(draw.choices("ab é执\U0001f600<PSM>\n\0", k=draw.randint(0, 90)))) for i in range(300)]
    rows += [(300, None), (301, ""), (None, "no id at all"), (302, "x<P>y"), (303, "<"), (7, "seven"), (7, "seven"), (304, "é执 " * 50_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(5) for c in CLASH})
    made = fim.transform(df).withColumn("restored", fim.restore(F.col("output"), F.col("form")))
    got = [(r.doc_id, r.text, (r.n, r.form, r.prefix_chars, r.middle_chars, r.output), r.restored) for r in made.collect()]
    assert sorted(map(repr, got)) == sorted(repr((i, t, plain_fim(i, t), t or "")) for i, t in rows)
    assert {g[2][1] for g in got} == {"plain", "psm", "spm"}
    assert fim.transform(df.limit(0)).count() == 0 and set(made.columns) >= set(df.columns)


def test_fim_cuts_between_words():
    draw = random.Random(8)
    for _ in range(400):
        text = "".join(draw.choices(["a", "éé", " ", "\n\n", "bcd", "执"], k=draw.randint(0, 40)))
        index = fim.Checkpoints(np.frombuffer(text.encode(), np.uint8), "word", every=3, block=5)
        at = [i for i in range(len(text)) if i == 0 or text[i] not in " \n" and text[i - 1] in " \n" and text[:i].strip(" \n")]
        assert index.units == len(at)
        for k, i in enumerate([*at, len(text)]):
            assert index.cut(k) == (len(text[:i].encode()), i)


def test_fim_marks_must_not_overlap():
    for marks in (("<P>", "<P>", "<M>"), ("aa", "b", "c"), ("ab", "bc", "d"), ("a", "xay", "c"), ("", "b", "c")):
        with pytest.raises(ValueError):
            fim._checked(marks)
    assert fim._checked(("<|fim_prefix|>", "<|fim_suffix|>", "<|fim_middle|>"))
