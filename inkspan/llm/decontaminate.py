"""Benchmark decontamination with Spark expressions only.

The normalised windows of all benchmark items form a hash set.  Every document is cut
into words once and each word is hashed once.  A window's fingerprint combines the
hashes of three of its words; fingerprints are looked up inside the row, in a table of
bits that the benchmark's windows set, so only the few windows that may hit leave the
row, with their words.  These are joined with the windows' words to verify them, and
counted per document.

The table of bits has a fixed size for a benchmark of any size (2^BITS at most, 2 MB):
beyond some millions of windows it lets more through, and results stay the same.  The
join's small side is broadcast by Spark's own size check.

Defined results: null and empty texts have no words and no hits; an item without
words is never found; every row is a document of its own, so repeated rows give a
row each; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import cut, table

WINDOW = 10
#: The table of bits has at least 16 for each window, between these powers of two.
LEAST_BITS, BITS = 12, 24
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The same words before A-Z are lower-cased, each with what follows it up to the next.
PIECE = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), F.lit(WORD), F.lit(0))


def benchmark_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """(len, gram, h, items): each distinct window with the items that hold it."""
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), words(F.col("text")).alias("ws")).where(F.size("ws") > 0)
    starts = items.select("item", "ws", F.least(F.size("ws"), F.lit(window)).alias("len"), F.explode(F.expr(f"sequence(1, greatest(size(ws) - {window} + 1, 1))")).alias("i"))
    grams = starts.select("item", "len", F.slice("ws", F.col("i"), F.col("len")).alias("gram"))
    return grams.groupBy("len", "gram").agg(F.collect_set("item").alias("items")).withColumn("h", F.xxhash64("gram"))


def _place(hs: str, i: str, n: int, bits: int) -> tuple[str, str]:
    """SQL: long and bit in it of the window of n words from place i (from 1), by the hashes of three of its words."""
    first, middle, last = (f"{hs}[{i} + {k - 1}]" for k in (0, n // 2, n - 1))
    return f"shiftrightunsigned({first} ^ shiftleft({middle}, 1), {70 - bits})", f"cast(({first} ^ {last}) & 63 AS int)"


def _table(grams: DataFrame, bits: int) -> DataFrame:
    """One row: the bits, 64 in a long."""
    own = None
    for r in grams.select("len").distinct().collect():
        n = r["len"]
        word, bit = _place("hs", "1", n, bits)
        part = grams.where(F.col("len") == n).withColumn("hs", F.transform("gram", lambda w: F.xxhash64(w))).selectExpr(f"{word} AS word", f"{bit} AS bit")
        own = part if own is None else own.unionByName(part)
    words_ = own.groupBy("word").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("bits"))
    every = grams.sparkSession.range(1 << (bits - 6)).withColumnRenamed("id", "word").join(words_, "word", "left")
    # at most 2^(BITS - 6) numbers
    listed = every.agg(F.sort_array(F.collect_list(F.struct("word", F.coalesce("bits", F.lit(0)).alias("bits")))).alias("x"))
    return listed.select(F.transform("x", lambda y: y["bits"]).alias("bits"))


def find(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """One row per document: doc_id, text_key, n_words, spans (start, len in words from 1), items (sorted)."""
    grams = cut(benchmark_windows(benchmark, window))
    facts = grams.agg(F.count("*").alias("n"), F.collect_set("len").alias("lens")).first()
    cut_up = documents.select("doc_id", F.xxhash64("text").alias("text_key"), F.monotonically_increasing_id().alias("row"), words(F.col("text")).alias("ws"))
    if not facts["n"]:
        none = "cast(array() as array<struct<start:int,len:int>>)"
        return cut_up.select("doc_id", "text_key", F.size("ws").cast("long").alias("n_words"), F.expr(none).alias("spans"), F.expr("cast(array() as array<string>)").alias("items"))
    bits = min(BITS, max(LEAST_BITS, (16 * facts["n"]).bit_length()))
    table_ = _table(grams, bits).first()["bits"]
    spark = documents.sparkSession
    known = spark.createDataFrame([(table_,)], "bits array<long>").scalar()
    counted = cut_up.select("doc_id", "text_key", "row", "ws", F.size("ws").alias("n_words"), F.transform("ws", lambda w: F.xxhash64(w)).alias("hs"), known.alias("known"))
    parts = []
    for n in sorted(facts["lens"]):
        word, bit = _place("hs", "i", n, bits)
        starts = f"filter(CASE WHEN n_words >= {n} THEN sequence(1, n_words - {n} + 1) ELSE cast(array() AS array<int>) END, i -> (shiftrightunsigned(known[{word}], {bit}) & 1L) = 1L)"
        parts.append(f"transform({starts}, i -> named_struct('start', i, 'len', {n}, 'gram', slice(ws, i, {n})))")
    windows = counted.select("doc_id", "text_key", "row", "n_words", F.explode_outer(F.expr(f"concat({', '.join(parts)})")).alias("w"))
    windows = windows.select("doc_id", "text_key", "row", "n_words", "w.start", "w.len", "w.gram", F.xxhash64("w.gram").alias("h"))
    hits = windows.join(grams.select("h", "gram", "items"), ["h", "gram"], "left")
    found = hits.groupBy("doc_id", "text_key", "row").agg(
        F.max("n_words").cast("long").alias("n_words"),
        F.collect_set(F.when(F.col("items").isNotNull(), F.struct("start", "len"))).alias("spans"),
        F.collect_set("items").alias("items"),
    )
    return found.drop("row").withColumn("items", F.array_sort(F.array_distinct(F.flatten("items")))).withColumn("spans", F.array_sort("spans"))


def covered(spans: str = "spans") -> Column:
    """Number of words inside any of the sorted spans."""
    return F.expr(
        f"aggregate({spans}, named_struct('n', 0L, 'to', 0), (a, s) -> named_struct("
        "'n', a.n + greatest(0, s.start + s.len - greatest(s.start, a.to)), 'to', greatest(a.to, s.start + s.len)), a -> a.n)"
    )


def report(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    found = find(documents, benchmark, window)
    return found.select(
        "doc_id", "n_words", covered().alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"),
    )


def remove_documents(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The documents without any hit, all columns kept."""
    bad = find(documents, benchmark, window).where(F.size("spans") > 0).select(F.col("doc_id").alias("__id"), F.col("text_key").alias("__key"))
    return documents.join(bad, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.xxhash64("text") == F.col("__key")), "left_anti")


def remove_spans(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """All documents; hit words go, each with what stood between it and the next word."""
    bad = find(documents, benchmark, window).where(F.size("spans") > 0).select(F.col("doc_id").alias("__id"), F.col("text_key").alias("__key"), F.col("spans").alias("__spans")).dropDuplicates(["__id", "__key"])
    joined = documents.join(bad, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.xxhash64("text") == F.col("__key")), "left")
    kept = F.expr("filter(__pieces, (p, i) -> NOT exists(__spans, s -> i + 1 >= s.start AND i + 1 < s.start + s.len))")
    lead = F.regexp_extract("text", r"^[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*", 0)
    cleaned = joined.withColumn("__pieces", F.when(F.col("__spans").isNotNull(), F.regexp_extract_all("text", F.lit(PIECE), F.lit(0))))
    text = F.when(F.col("__spans").isNull(), F.col("text")).otherwise(F.concat(lead, F.array_join(kept, "")))
    return cleaned.withColumn("text", text).select(*documents.columns)


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_SQL_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
OP1_SQL = f"""
WITH items AS (SELECT item_id, {_SQL_WORDS} AS ws FROM benchmark),
grams AS (SELECT DISTINCT item_id, ws[i:i + least(len(ws), {WINDOW}) - 1] AS gram
          FROM (SELECT item_id, ws, unnest(range(1, greatest(len(ws) - {WINDOW} + 1, 1) + 1)) AS i FROM items WHERE len(ws) > 0)),
lens AS (SELECT DISTINCT len(gram) AS n FROM grams),
docs AS (SELECT doc_id, {_SQL_WORDS} AS ws FROM documents),
wins AS (SELECT doc_id, i, n, ws[i:i + n - 1] AS gram
         FROM (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM docs, lens WHERE len(ws) >= n)),
hits AS (SELECT w.doc_id, w.i, w.n, g.item_id FROM wins w JOIN grams g ON w.gram = g.gram),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT doc_id, i, n FROM hits)) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
        FROM (SELECT DISTINCT doc_id, cast(item_id AS varchar) AS item FROM hits) GROUP BY doc_id)
SELECT d.doc_id, cast(len(d.ws) AS bigint) AS n_words, cast(coalesce(p.n_hit, 0) AS bigint) AS n_hit,
       cast(coalesce(t.n_items, 0) AS bigint) AS n_items, sha256(coalesce(t.items, '')) AS items_sha256,
       coalesce(p.n_hit, 0) > 0 AS contaminated
FROM docs d LEFT JOIN pos p USING (doc_id) LEFT JOIN its t USING (doc_id)
"""
