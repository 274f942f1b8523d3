"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns for every operator."""

import hashlib

import pytest
from pyspark.sql import functions as F

pytest.importorskip("inkspan.llm")
from inkspan.llm import chat, decontaminate, jaccard, knn, lm, pieces, quality, sharding, suffix_dedup, warc  # noqa: E402

LONG = " ".join(f"word{i}" for i in range(30_000))
ROWS = [
    (1, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"), (2, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"),
    (3, None), (4, ""), (5, " \t\n"), (6, LONG), (7, "x"), (7, "x"), (None, "no id at all"), (8, "▁é执 \U0001f600 <|im_end|>"),
]


@pytest.fixture(scope="module")
def docs(spark):
    clash = {c: F.lit(5) for c in ("doc", "key", "n", "sid", "token", "at", "place", "h", "ids", "score", "group", "kind", "words", "label", "bits", "lo", "hi", "items")}
    return spark.createDataFrame(ROWS, "doc_id long, text string").withColumns(clash)


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (4, 0, 0), (6, 1, 0), (None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")


def bench(spark, rows):
    return spark.createDataFrame(rows, "item_id long, text string")


def test_decontaminate(spark, docs, none):
    items = bench(spark, [(10, "BETA gamma DELTA"), (9, None), (8, "..."), (7, "word1 word2 word3 word4 word5 word6 word7 word8 word9 word10 word11"), (6, "beta gamma delta")])
    got = {(r.doc_id, r.n_words): r for r in decontaminate.report(docs, items).collect()}
    r = got[1, 12]
    assert (r.n_hit, r.n_items, r.contaminated) == (3, 2, True) and r.items_sha256 == hashlib.sha256(b"10,6").hexdigest()
    assert got[6, 30_000].n_hit == 11 and got[3, 0].n_hit == got[4, 0].n_hit == 0 and not got[8, 4].contaminated
    assert len(got) == 9
    assert sorted(str(r.doc_id) for r in decontaminate.remove_documents(docs, items).collect()) == sorted(["3", "4", "5", "7", "7", "8", "None"])
    cut = {r.doc_id: r.text for r in decontaminate.remove_spans(docs, items).collect()}
    assert cut[1] == "alpha epsilon zeta eta theta iota kappa lambda mu" and cut[3] is None
    assert decontaminate.report(none, items).count() == 0 and decontaminate.report(docs, items.limit(0)).where("contaminated").count() == 0


def test_decontaminate_with_a_full_table_of_bits(spark, docs, monkeypatch):
    items = bench(spark, [(10, "BETA gamma DELTA"), (7, "word1 word2 word3 word4 word5 word6 word7 word8 word9 word10 word11")])
    want = sorted(map(str, decontaminate.report(docs, items).collect()))
    monkeypatch.setattr(decontaminate, "LEAST_BITS", 7)
    monkeypatch.setattr(decontaminate, "BITS", 7)
    assert sorted(map(str, decontaminate.report(docs, items).collect())) == want


def test_suffix_dedup(docs, none):
    got = {r.doc_id: r for r in suffix_dedup.report(docs).collect()}
    assert got[3].n_bytes == 0 and got[6].n_removed == 0 and got[1].n_removed == 0
    assert suffix_dedup.report(none).count() == 0
    assert suffix_dedup.remove_repeats(docs).columns == docs.columns


def test_jaccard(docs, none):
    got = [(r.doc_id, r.n_shingles, r.component_id) for r in jaccard.jaccard_join(docs).collect()]
    assert (2, 9, 1) in got and (3, 0, 3) in got and (5, 0, 5) in got and got.count((7, 1, 7)) == 2 and (6, 29_997, 6) in got
    assert jaccard.jaccard_join(none).count() == 0
    kept = jaccard.keep_one(docs, 5, 80)
    assert kept.columns == docs.columns and sorted(str(r.doc_id) for r in kept.collect()).count("2") == 0


def test_knn(spark):
    rows = [(0, [1.0, 0.0]), (50, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.5]), (3, None), (4, [float("nan"), 1.0]), (5, [float("inf"), 1.0]), (6, [None, 1.0]), (None, [1.0, 1.0]), (7, []), (1, [1.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({"rank": F.lit(1), "score": F.lit(1), "cell": F.lit(1)})
    got = [tuple(r) for r in knn.knn_join(df, F.col("vec_id") % 50 == 0, 3).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 1, 65536), (0, 2, 50, 65536), (0, 3, 2, 32768), (50, 1, 0, 65536), (50, 2, 1, 65536), (50, 3, 2, 32768)]
    assert knn.knn_join(df.limit(0), F.col("vec_id") % 50 == 0, 3).count() == 0
    big = spark.createDataFrame([(0, [1e30, 1.0]), (1, [1e30, 1.0])], "vec_id long, embedding array<double>")
    assert knn.knn_join(big, F.col("vec_id") == 0, 3).count() == 1


def test_quality(docs, none, labels):
    got = {r.doc_id: r.score for r in quality.score(docs, labels).collect()}
    assert len(got) == 9 and all(0 <= s <= 1 for s in got.values())
    assert quality.score(none, labels).count() == 0
    assert {r.score for r in quality.score(docs, labels.limit(0)).collect()} == {1.0}
    assert quality.keep_good(docs, labels.limit(0)).columns == docs.columns


def test_sharding(docs, none):
    rows = sharding.shard(docs, 3).collect()
    assert len(rows) == len(ROWS) and {r.size for r in rows if r.doc_id in (3, 4)} == {1}
    assert len({r.shard for r in rows if r.doc_id in (1, 2)}) == 1
    for k in range(3):
        own = sorted(r.slot for r in rows if r.shard == k)
        assert own == list(range(len(own)))
    assert sharding.shard(none, 3).count() == 0


def test_lm(docs, none):
    got = {r.doc_id: r for r in lm.score(docs, F.lit(True)).collect()}
    assert got[3].n_tokens == 1 and got[3].n_known == 1 and got[6].n_tokens == 30_001 and all(r.score < 0 for r in got.values())
    assert lm.score(none, F.lit(True)).count() == 0
    untrained = {r.doc_id: r for r in lm.score(docs, F.lit(False)).collect()}
    assert untrained[1].base_score == 0 and untrained[1].n_known == 0 and untrained[1].train_tokens == 0


def test_chat(spark):
    rows = [(1, 2, "assistant", "b"), (1, 1, "user", None), (1, 2, "assistant", "a"), (1, None, None, "sys"), (2, 0, "as\nsist<|x", "<|im_end|>\\<\\|im_sep|>\n"), (None, 0, "user", ""), (3, 0, "assistant", "")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({"ts": F.lit(1), "m": F.lit(2), "formatted": F.lit(3)})
    made = chat.format_chats(df)
    got = {r.conv_id: r for r in made.select("conv_id", "formatted", chat.read_turns(F.col("formatted")).alias("t"), chat.read_loss(F.col("formatted"), F.col("loss")).alias("l")).collect()}
    assert [tuple(t) for t in got[1].t] == [("", "sys"), ("user", ""), ("assistant", "a"), ("assistant", "b")] and got[1].l == ["a", "b"]
    assert got[1].formatted.count(chat.START) == 3
    assert [tuple(t) for t in got[2].t] == [("as\nsist<|x", "<|im_end|>\\<\\|im_sep|>\n")] and got[2].formatted.count(chat.END) == 1
    assert got[3].l == [""] and got[None].l == []
    assert chat.digest(chat.format_chats(df.limit(0))).count() == 0


def test_warc(spark, tmp_path):
    rows = [(1, "http://b.example.com/x", "same"), (2, "http://a.example.com/", "same"), (3, None, None), (4, "http://a.example.com/#f", ""), (5, "http://a.example.com/", "Ünï"), (5, "http://a.example.com/", "Ünï"), (None, "u\r\nv", "same")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"key": F.lit(1), "sha": F.lit(1), "file": F.lit("f")})
    folder, parts = warc.archive(df, "file://" + str(tmp_path / "w"))
    every = df.select(warc.url_key(F.col("url")).alias("key"), F.coalesce("page_id", F.lit(warc.NO_ID)).alias("pid"))
    got = sorted(((r.page_id, r.record_type, r.refers_to, r.payload_bytes) for r in warc.read_records(warc.lookup(every, folder, parts), folder).collect()), key=str)
    assert got == sorted([(1, "revisit", 2, 4), (2, "response", None, 4), (3, "revisit", 4, 0), (4, "response", None, 0), (5, "response", None, 5), (5, "response", None, 5), (None, "revisit", 2, 4)], key=str)
    one = spark.createDataFrame([("com,example,a)/", None), ("nowhere)", None)], "key string, pid long")
    assert sorted(r.pid for r in warc.lookup(one, folder, parts).collect()) == [2, 4, 5, 5]
    folder, parts = warc.archive(df.limit(0), "file://" + str(tmp_path / "e"))
    assert parts == [] and warc.lookup(every, folder, parts).count() == 0


def test_pieces(docs, none):
    made = pieces.encode(docs)
    assert made.where("not round_trip").count() == 0 and made.columns[:2] == ["doc_id", "text"]
    got = {r.doc_id: r for r in pieces.decode(made).collect()}
    assert got[3].ids == [] and got[3].n_best_scores == [0.0] and got[3].decoded == "" and got[8].decoded == ROWS[-1][1] and got[6].decoded == LONG
    assert pieces.encode(none).count() == 0
