"""Order of ties, very long conversations and texts, repeated rows."""

import hashlib
import time

import pytest
from pyspark.sql import functions as F

pytest.importorskip("inkspan.llm")
from inkspan.llm import chat, decontaminate, pieces, quality  # noqa: E402


def test_chat_orders_ties_by_the_texts_as_given(spark):
    df = spark.createDataFrame([(1, 0, "user", "<|x"), (1, 0, "user", "<ax"), (1, 1, "a\nb", "1"), (1, 1, "a b", "2"), (1, 1, "a<|", "3"), (1, 1, "a<a", "4")], "conv_id long, turn long, role string, text string")
    turns = [tuple(t) for t in chat.format_chats(df).select(chat.read_turns(F.col("formatted")).alias("t")).first().t]
    assert turns == [("user", "<ax"), ("user", "<|x"), ("a\nb", "1"), ("a b", "2"), ("a<a", "4"), ("a<|", "3")]


@pytest.mark.parametrize("same", [True, False])
def test_chat_with_a_very_long_conversation(spark, same):
    n = 20_000
    rows = [(7, i, "assistant" if same or i % 2 else "user", f"{i} say <| {'é' * (i % 5)}") for i in range(n)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    began = time.time()
    r = chat.digest(chat.format_chats(df)).first()
    assert time.time() - began < 30
    own = [t for _, _, role, t in rows if role == "assistant"]
    assert (r.n_turns, r.loss_chars) == (n, sum(map(len, own)))
    assert r.loss_sha256 == hashlib.sha256("".join(own).encode()).hexdigest()
    assert r.turns_sha256 == hashlib.sha256("".join(f"{role}\n{t}\n" for _, _, role, t in rows).encode()).hexdigest()


def test_decontaminate_gives_repeated_rows_a_row_each(spark):
    docs = spark.createDataFrame([(1, "a b c d"), (1, "a b c d"), (2, "x"), (2, "x"), (None, None), (None, None)], "doc_id long, text string")
    items = spark.createDataFrame([(5, "b c")], "item_id long, text string")
    assert sorted(((r.doc_id, r.n_hit) for r in decontaminate.report(docs, items).collect()), key=str) == [(1, 2), (1, 2), (2, 0), (2, 0), (None, 0), (None, 0)]
    assert decontaminate.report(docs, items.limit(0)).count() == 6 and decontaminate.remove_documents(docs, items).count() == 4
    assert sorted(str(r.text) for r in decontaminate.remove_spans(docs, items).collect()) == ["None", "None", "a d", "a d", "x", "x"]


def test_quality_learns_beside_one_very_long_text(spark, monkeypatch):
    rows = [(i, ("good words here and there " if i % 2 else "zzz spam junk zzz ") * 3) for i in range(300)]
    labels = spark.createDataFrame([(i, i % 2) for i, _ in rows] + [(i, 1) for i in range(300, 340)] + [(i, 0) for i in range(340, 380)], "doc_id long, quality int")
    docs = spark.createDataFrame([*rows, *((i, "long text " * 4000) for i in range(300, 380))], "doc_id long, text string")
    monkeypatch.setattr(quality.fit, "__defaults__", (quality.SAMPLE, 60_000))
    got = {r.doc_id: r.score for r in quality.score(docs, labels).collect()}
    assert min(got[i] for i in range(1, 300, 2)) > max(got[i] for i in range(0, 300, 2))


def test_lattices_in_runs(spark, monkeypatch):
    v = pieces.load()
    text = " ".join(f"wörd{i * i} of {'ab' * (i % 40)} 执行" for i in range(400))
    whole = list(pieces.Encoder(v).segmentations([text, "", "one", text[:50]]))
    monkeypatch.setattr(pieces, "RUN", 60)
    cut = list(pieces.Encoder(v).segmentations([text, "", "one", text[:50]]))
    assert [(s, [x.tolist() for x in ids]) for ids, s in whole] == [(s, [x.tolist() for x in ids]) for ids, s in cut]
