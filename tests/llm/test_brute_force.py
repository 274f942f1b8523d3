"""Results against brute force, exact round trips and held-out accuracy."""

import hashlib
import itertools
import math
import os
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("inkspan.llm")
from inkspan.llm import entries, jaccard, knn, lm, pieces, quality, sharding, suffix_dedup, warc  # noqa: E402

DIR = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")


@needs_tables
@pytest.mark.parametrize("name", sorted(entries.oracle_sql()))
def test_against_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in ("documents", "benchmark", "pages", "embeddings", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    df = entries.queries()[name](spark, DIR)
    r = con.execute(entries.oracle_sql()[name])
    names = [x[0] for x in r.description]
    want = sorted((tuple(row[names.index(c)] for c in df.columns) for row in r.fetchall()), key=repr)
    assert sorted((tuple(row) for row in df.collect()), key=repr) == want


def words(rng, n, size=400):
    return [f"w{rng.randrange(size)}" for _ in range(n)]


def edited(rng, ws, share):
    return [w if rng.random() > share else f"e{rng.randrange(10**6)}" for w in ws]


def corpus(seed):
    """Near copies at every distance around the threshold, a common passage, short texts and copies."""
    rng = random.Random(seed)
    common = words(rng, 60)
    out = []
    for _ in range(12):
        base = words(rng, rng.choice([20, 60, 150]))
        out.append(base)
        out += [edited(rng, base, rng.choice([0.0, 0.01, 0.02, 0.04, 0.08])) for _ in range(rng.randrange(8))]
    out += [words(rng, 40) + common + words(rng, 40) for _ in range(15)] + [["a"], ["a"], ["a", "b"], [], ["A", "B"]]
    rng.shuffle(out)
    return [(i, " ".join(w)) for i, w in enumerate(out)]


def shingles(text, size):
    ws = re.findall(r"[^\x20\x09-\x0D]+", text.translate({c: c + 32 for c in range(65, 91)}))
    return {tuple(ws[i : i + size]) for i in range(max(len(ws) - size + 1, 1))} if ws else set()


@pytest.mark.parametrize(("seed", "size", "percent", "block"), [(1, 4, 85, 1 << 20), (2, 4, 85, 900), (3, 5, 80, 2000)])
def test_jaccard_join(spark, monkeypatch, seed, size, percent, block):
    monkeypatch.setattr(jaccard, "BITMAPS", block)
    monkeypatch.setattr(jaccard, "WHOLE", block)
    monkeypatch.setattr(jaccard, "LOWEST", 4)
    rows = corpus(seed)
    sets = {i: shingles(t, size) for i, t in rows}
    parent = {i: i for i in sets}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in itertools.combinations(sets, 2):
        i = len(sets[a] & sets[b])
        if i and 100 * i >= percent * (len(sets[a]) + len(sets[b]) - i):
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string"), size, percent).collect()}
    assert got == {i: (len(sets[i]), find(i)) for i in sets}


def test_trees_lose_no_pair():
    rng = np.random.default_rng(5)
    members = []
    for k in range(60):
        s = np.unique(rng.integers(0, 2**63, rng.integers(20, 60)).astype(np.uint64)) if k % 3 == 0 else np.unique(np.concatenate([members[-1][4][2:], rng.integers(0, 2**63, 2).astype(np.uint64)]))
        members.append((k, len(s), k, int(s[0].astype(np.int64)), np.frombuffer(jaccard.bitmap(s, len(s)), np.uint8), s))
    group = {k: {k} for k in range(60)}
    t = jaccard.tree(members)
    single = jaccard.members_that_may_link(t, t, 85)
    for a, b in itertools.combinations(members, 2):
        i = len(np.intersect1d(a[5], b[5]))
        if 100 * i >= 85 * (a[1] + b[1] - i):
            assert {a[0], b[0]} <= single
            if group[a[0]] is not group[b[0]]:
                group[a[0]] |= group[b[0]]
                for k in group[b[0]]:
                    group[k] = group[a[0]]
    links = jaccard.joining_links(jaccard.tree(members), jaccard.tree(members), 85)
    components = {id(g) for g in group.values()}
    assert len(links) == 60 - len(components) and all(group[a] is group[b] for a, b in links)


def thue_morse(n):
    return "".join("ab"[bin(i).count("1") & 1] for i in range(n))


@pytest.mark.parametrize("n", [1024, 2048])
def test_words_that_collide_modulo_a_power_of_two(spark, n):
    word = thue_morse(n)
    rows = [(1, word), (2, word.translate({97: 98, 98: 97})), (3, word)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in jaccard.jaccard_join(docs).collect()} == {1: 1, 2: 2, 3: 1}
    assert jaccard.linked([rows[0][1].encode()], [rows[1][1].encode()], 4, 85) == [False]
    known = {r.doc_id: r.n_known for r in lm.score(docs, F.col("doc_id") == 1).collect()}
    assert known == {1: 2, 2: 1, 3: 2}
    if os.path.exists(pieces.MODEL):
        assert {r.round_trip for r in pieces.encode(docs).collect()} == {True}


def test_one_large_group_of_near_copies(spark):
    """3,000 copies with edits on both sides of the threshold."""
    rng = random.Random(12)
    base = [f"b{i}" for i in range(60)]
    rows = [(i, " ".join(edited(rng, base, rng.choice([0.01, 0.03, 0.06])))) for i in range(3000)]
    sets = [shingles(t, 4) for _, t in rows]
    number, ids = {}, []
    for s in sets:
        ids.append([number.setdefault(x, len(number)) for x in s])
    m = np.zeros((3000, len(number)), np.float32)
    for i, own in enumerate(ids):
        m[i, own] = 1
    both, size, group = m @ m.T, m.sum(1), np.arange(3000)
    links = 100 * both >= 85 * (size[:, None] + size[None] - both)
    while True:
        now = np.where(links, group[None], 3000).min(1)
        if (now == group).all():
            break
        group = now
    got = {r.doc_id: r.component_id for r in jaccard.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == dict(enumerate(group.tolist()))


def removed(rows, length=200):
    seen = Counter(t[j : j + length] for _, t in rows for j in range(len(t) - length + 1))
    out = {}
    for i, t in rows:
        gone = bytearray(len(t))
        for j in range(len(t) - length + 1):
            if seen[t[j : j + length]] > 1:
                gone[j : j + length] = b"\1" * length
        spans = sum(1 for k in range(len(t)) if gone[k] and not (k and gone[k - 1]))
        out[i] = (len(t), sum(gone), spans, hashlib.sha256(bytes(c for c, g in zip(t, gone, strict=True) if not g)).hexdigest())
    return out


@pytest.mark.parametrize("hot", [2000, 1])
def test_suffix_dedup(spark, monkeypatch, hot):
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    monkeypatch.setattr(suffix_dedup, "BLOCK", 3000)
    rng = random.Random(11)
    text = lambda n: "".join(rng.choice("abcdé ") for _ in range(n))
    passage, other = text(500), text(230)
    rows = [text(rng.randrange(600)) + passage + text(rng.randrange(600)) for _ in range(6)]
    rows += [text(50) + other[i : i + 205] + text(300) for i in range(0, 25, 5)]
    rows += [passage[:199], passage[100:299] + "#", "a" * 1000, "ab" * 700, "ab" * 100 + "Z" + "ab" * 99, text(9000), "x" * 199, "y" * 200, text(3500) * 2, "", rows[0]]
    docs = list(enumerate(rows))
    got = {r[0]: tuple(r[1:]) for r in suffix_dedup.report(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == removed([(i, t.encode()) for i, t in docs])


def test_repeats_go_by_whole_characters(spark):
    passage = "é" * 150
    df = spark.createDataFrame([(1, "a" + passage), (2, "bé" + passage)], "doc_id long, text string")
    assert {r.doc_id: r.text for r in suffix_dedup.remove_repeats(df).collect()} == {1: "a", 2: "b"}


def test_knn_with_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(knn, "BLOCK", 40)
    monkeypatch.setattr(knn, "QUERIES", 5)
    rng = np.random.default_rng(2)
    centers = rng.normal(size=(5, 8)) * 3
    x = np.vstack([centers[rng.integers(0, 5, 300)] + rng.normal(size=(300, 8)) * 0.1, np.repeat(centers[:1], 200, axis=0)]).astype(np.float32)
    q = np.floor(256 * x.astype(float)).astype(int)
    want = set()
    for i in range(0, 500, 50):
        s = q @ q[i]
        order = sorted((j for j in range(500) if j != i), key=lambda j: (-s[j], j))[:5]
        want |= {(i, r + 1, j, int(s[j])) for r, j in enumerate(order)}
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    assert {tuple(r) for r in knn.knn_join(df, F.col("vec_id") % 50 == 0, 5, 8).collect()} == want


def test_voronoi_bounds_hold_and_prune(spark):
    """Bounds are never below a score of the cell, and clustered vectors need few cells."""
    rng = np.random.default_rng(3)
    centers = rng.normal(size=(30, 16)) * 300
    x = np.floor(centers[rng.integers(0, 30, 900)] + rng.normal(size=(900, 16)) * 20)
    pivots = np.unique(x[:60], axis=0)
    import pandas as pd

    [placed] = knn.place(pivots)([pd.DataFrame({"vec_id": range(900), "v": list(x), "asks": True})])
    g = placed.groupby("cell")
    rows = [{"cell": c, "rows": len(m), "low": m["along"].min(), "high": m["along"].max(), "across": m["across"].max()} for c, m in g]
    cells = knn.Cells(pivots, rows, 40)
    bound = cells.bounds(x)
    scores = x @ x.T
    for i, (_, m) in enumerate(g):
        assert (scores[:, m.index].max(1) <= bound[:, i]).all()
    np.fill_diagonal(scores, -np.inf)
    fifth = np.sort(scores, 1)[:, -5]
    reached = [len(cells.blocks_of(np.nonzero(bound[q] >= fifth[q])[0])) for q in range(900)]
    assert np.mean(reached) < 0.3 * cells.n_blocks


@needs_tables
def test_knn_solves_fewer_pairs_than_all(spark, monkeypatch):
    """On embeddings, whose vectors point everywhere, the bounds still leave out some blocks."""
    monkeypatch.setattr(knn, "BLOCK", 1)
    monkeypatch.setattr(knn, "FIRST", 40)
    seen, joined = [], knn._joined

    def counted(asked, *rest):
        seen.append(asked.selectExpr("sum(size(blocks)) AS n").first()["n"])
        return joined(asked, *rest)

    monkeypatch.setattr(knn, "_joined", counted)
    df = spark.read.parquet(f"{DIR}/embeddings.parquet")
    n = df.count()
    knn.knn_join(df, F.col("vec_id") % 50 == 0, 5, n).collect()
    assert sum(seen) < n * df.where("vec_id % 50 = 0").count()


def solved_pairs(monkeypatch):
    """Counts the pairs of query and candidate that the join multiplies, step by step."""
    seen, joined = [], knn._joined

    def counted(asked, queries, data, *rest):
        x = asked.select("vec_id", F.explode(F.flatten("cells")).alias("cell")).distinct()
        seen.append(x.join(data.groupBy("cell").count(), "cell").agg(F.coalesce(F.sum("count"), F.lit(0)).alias("n")).first()["n"])
        return joined(asked, queries, data, *rest)

    monkeypatch.setattr(knn, "_joined", counted)
    return seen


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.1"), reason="no test tables")
def test_knn_as_shipped(spark, monkeypatch):
    """With the shipped constants all of sf0.1 lies in one block; no pair is solved twice.

    Its vectors have no clusters, so the bounds leave out none of its cells; the next test has clusters.
    """
    seen = solved_pairs(monkeypatch)
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in knn.knn_join(df, F.col("vec_id") % 50 == 0, 5).collect()}
    rows = df.orderBy("vec_id").collect()
    q = np.floor(256 * np.array([r.embedding for r in rows], float)).astype(int)
    ids = [r.vec_id for r in rows]
    for i in [i for i, x in enumerate(ids) if x % 50 == 0]:
        s = q @ q[i]
        order = sorted((j for j in range(len(ids)) if j != i), key=lambda j: (-s[j], ids[j]))[:5]
        assert [got[ids[i], n + 1] for n in range(5)] == [(ids[j], int(s[j])) for j in order]
    n, asking = len(ids), sum(x % 50 == 0 for x in ids)
    assert len(seen) == 2 and 0 < seen[0] < seen[1] and sum(seen) <= n * asking


def test_knn_solves_few_pairs_of_clusters(spark, monkeypatch):
    """Clustered vectors, shipped constants: one block, and most of its cells are not multiplied."""
    seen = solved_pairs(monkeypatch)
    rng = np.random.default_rng(5)
    centers = rng.normal(size=(40, 16)) * 5
    x = (centers[rng.integers(0, 40, 3000)] + rng.normal(size=(3000, 16)) * 0.2).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in knn.knn_join(df, F.col("vec_id") % 50 == 0, 5).collect()}
    q = np.floor(256 * x.astype(float)).astype(int)
    for i in range(0, 3000, 50):
        s = q @ q[i]
        order = sorted((j for j in range(3000) if j != i), key=lambda j: (-s[j], j))[:5]
        assert [got[i, n + 1] for n in range(5)] == [(j, int(s[j])) for j in order]
    assert sum(seen) < 0.3 * 3000 * 60


@needs_tables
def test_lm_base_and_gain(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    held = lambda i: zlib.crc32(str(i).encode()) % 7 == 2
    tokens = {r.doc_id: re.findall(r"[^\x20\x09-\x0D]+", (r.text or "").translate({c: c + 32 for c in range(65, 91)})) + ["\n"] for r in docs.collect()}
    c = Counter(itertools.chain.from_iterable(w for i, w in tokens.items() if not held(i)))
    n, v = sum(c.values()), len(c)
    got = {r.doc_id: r for r in lm.score(docs, ~lm.held_out(F.col("doc_id"), 7, 2)).collect()}
    for i, w in tokens.items():
        r = got[i]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(w), sum(t in c for t in w), n)
        assert r.base_score == pytest.approx(sum(math.log10((c[t] + 1) / (n + v + 1)) for t in w))
    seen = [r for i, r in got.items() if not held(i)]
    assert sum(r.score for r in seen) > sum(r.base_score for r in seen)


@needs_tables
def test_lm_lexicon_only_moves_the_look_up(spark, monkeypatch):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    docs = docs.unionByName(docs.where("doc_id < 3"))
    scored = lambda: {r.doc_id: r for r in lm.score(docs, ~lm.held_out(F.col("doc_id"), 7, 2)).collect()}
    whole = scored()
    monkeypatch.setattr(lm, "LEXICON", 5)
    few = scored()
    assert whole.keys() == few.keys()
    for i, r in few.items():
        assert (r.n_tokens, r.n_known) == (whole[i].n_tokens, whole[i].n_known)
        assert (r.base_score, r.score) == pytest.approx((whole[i].base_score, whole[i].score))


def test_lm_probabilities_sum_to_one(spark):
    df = spark.createDataFrame([(i, "the cat sat on the mat and the dog ran") for i in range(20)], "doc_id long, text string")
    model = lm.tree(lm.counts(df).where(F.col("kind") == lm.GRAM).select("code", "n"), least=1, gain=0.0)
    for context in (b"\0\0\0\0\0", b"e cat", b"zzzzz", b"t the"):
        head = int.from_bytes(context, "big") << 8
        p = lm.predict(model, np.array([head | b for b in range(256)], np.uint64))
        assert p.sum() == pytest.approx(1.0)


def brute_paths(v, ids, text, n):
    s = "▁" + text.replace(" ", "▁") if text else ""
    best = [[] for _ in range(len(s) + 1)]
    best[len(s)] = [0.0]
    for i in range(len(s) - 1, -1, -1):
        for k in range(1, min(v.longest, len(s) - i) + 1):
            p = s[i : i + k]
            score = float(v.scores[ids[p]]) if p in ids else v.fallback if k == 1 else None
            if score is not None:
                best[i] += [score + x for x in best[i + k]]
    return sorted(best[0], reverse=True)[:n]


@pytest.fixture(scope="module")
def vocabulary():
    if not os.path.exists(pieces.MODEL):
        pytest.skip("no vocabulary file")
    return pieces.load()


def test_n_best_against_all_paths(vocabulary):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    ids = {sp.id_to_piece(i): i for i in range(sp.get_piece_size()) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i))}
    coder, rng = pieces.Encoder(vocabulary), random.Random(4)
    texts = ["".join(rng.choice(["th", "e", " ", "in", "ü", "執", "  ", "a", "\n", "x", "ing"]) for _ in range(rng.randrange(8))) for _ in range(60)]
    for text, (own, scores) in zip(texts, coder.encode(texts), strict=True):
        assert coder.decode(own) == text.encode()
        assert scores == pytest.approx(brute_paths(vocabulary, ids, text, 4))
    [(own, _)] = coder.encode(["The cat"])
    assert float(vocabulary.scores[own].sum()) == pytest.approx(next(coder.encode(["The cat"]))[1][0])


def test_long_chunks_take_the_same_paths(vocabulary, monkeypatch):
    coder = pieces.Encoder(vocabulary)
    text = ["internationalisation" * 4 + " and then some"]
    want = [(x.tolist(), s) for x, s in coder.encode(text)]
    monkeypatch.setattr(pieces, "LONG", 3)
    assert [(x.tolist(), s) for x, s in coder.encode(text)] == want


def test_quality_held_out(spark):
    rng = random.Random(3)
    clean = lambda: " ".join(rng.choice(["the", "of", "and", "river", "house", "small", "walk", "green"]) + ("." if rng.random() < 0.1 else "") for _ in range(rng.randrange(20, 80)))
    junk = lambda: " ".join(rng.choice(["buy!!", "###", "now!!", "$$$", "click"]) for _ in range(rng.randrange(20, 80)))
    rows = [(i, clean() if i % 4 else junk()) for i in range(800)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 > 0)) for i, _ in rows], "doc_id long, quality int")
    got = quality.score(docs, labels).where(quality.held_out(F.col("doc_id"))).collect()
    assert len(got) > 100 and sum((r.score >= 0.7) == (r.doc_id % 4 > 0) for r in got) / len(got) > 0.97


def test_sharding_is_balanced(spark):
    rng = random.Random(9)
    rows = [(i, "w " * int(rng.paretovariate(1.2) * 5)) for i in range(3000)] + [(5000 + i, "a big group of copies") for i in range(900)]
    out = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string"), 8).collect()
    size = Counter()
    for r in out:
        size[r.shard] += r.size
    assert len(out) == len(rows) and max(size.values()) < 1.02 * sum(size.values()) / 8
    assert len({r.shard for r in out if r.doc_id >= 5000}) > 1  # the group is larger than a shard
    assert all(sorted(r.slot for r in out if r.shard == k) == list(range(sum(r.shard == k for r in out))) for k in range(8))


@needs_tables
def test_sharding_against_a_plain_version(spark):
    """Sizes, checksums, whole groups and each group's shard by the same greedy rule over the same items."""
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{DIR}/documents.parquet").collect()}
    got = {r.doc_id: r for r in sharding.op6_sharding(spark, DIR).collect()}
    assert got.keys() == docs.keys()
    shards: dict[str, set] = {}
    for i, t in docs.items():
        assert (got[i].size, got[i].text_crc32, got[i].law) == (len(t.encode()) + 1, zlib.crc32(t.encode()), "bytes")
        shards.setdefault(t, set()).add(got[i].shard)
    used, total = Counter(), sum(r.size for r in got.values())
    for r in got.values():
        used[r.shard] += r.size
    largest = max(sum(got[i].size for i in docs if docs[i] == t) for t in shards)
    assert all(len(s) == 1 for s in shards.values()) and max(used.values()) <= total / 8 + largest / 2
    assert max(used.values()) / (total / 8) < 1.03


def test_each_item_goes_where_the_dot_product_is_highest():
    rng = np.random.default_rng(1)
    sizes = rng.pareto(1.5, (200, 3))
    sizes /= sizes.sum(0)
    placed = sharding.pack_items(sizes, 5)
    left = [[0.2] * 3 for _ in range(5)]
    for i in sorted(range(200), key=lambda i: (-max(sizes[i]), i)):
        worth = [sum(w * r * s for w, r, s in zip(sharding.WEIGHTS, left[k], sizes[i], strict=True)) for k in range(5)]
        room = [k for k in range(5) if all(r + 1e-12 >= s for r, s in zip(left[k], sizes[i], strict=True))] or range(5)
        assert worth[placed[i]] == pytest.approx(max(worth[k] for k in room))
        left[placed[i]] = [r - s for r, s in zip(left[placed[i]], sizes[i], strict=True)]


def test_warc_blocks_and_records(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(warc, "BLOCK", 7)
    rows = [(i, f"https://h{i % 5}.example.org/p/{i % 40}", f"payload {i % 30}") for i in range(200)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    folder, parts = warc.archive(df, "file://" + str(tmp_path / "w"))
    keys = df.select(warc.url_key(F.col("url")).alias("key"), F.lit(None).cast("long").alias("pid"))
    got = {r.page_id: r for r in warc.read_records(warc.lookup(keys, folder, parts), folder).collect()}
    assert sorted(got) == list(range(200))
    for i, url, html in rows:
        top = max(j for j in range(200) if j % 30 == i % 30)
        assert got[i].url == url and got[i].refers_to == (None if i == top else top) and got[i].payload_bytes == len(html)
        assert got[top].payload == html.encode() and got[i].payload_digest == got[top].payload_digest
