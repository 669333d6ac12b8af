"""Benchmark decontamination: a prefix-filtered set join of benchmark windows with documents, in SQL functions alone.

A window is `size` consecutive words of an item, or a whole item of fewer words. Its record in the join is the set of its
shingles of SHINGLE consecutive words (of all its words if it has fewer). Containment of the whole window is asked for, so
any one of its shingles is a sufficient prefix, and the rarest one over all documents is taken. A document that holds
this shingle at position p is a candidate for the window's start at p minus the shingle's place in the window, if the
window then lies within the document; the words around p decide exactly.

Documents are scanned twice, and their words never go through a shuffle. The first scan counts the benchmark's shingles, which
gives the rarest of each window; only counts leave a task. The second one joins positions with these prefixes and checks the
words around them in place. Shingles that measure too much to be broadcast meet after a shuffle, but only of positions that a bitmap of
them lets through, each with the words around it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nameweave.llm.columns import ascii_lower, in_bitmap, text_key, without
from nameweave.scratch import BROADCAST_BYTES, Table, size_of, small, written

SIZE, SHINGLE = 10, 3
#: What parts words, once A-Z are lower-cased.
BETWEEN = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"


def words(text: Column) -> Column:
    """The words of a text, empty for null."""
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), BETWEEN), "")


def _shingle(w: Column, at: Column, n: int) -> Column:
    """The hash of the n words from a 0-based place; past the end, of fewer."""
    return F.xxhash64(F.lit(n), *(F.get(w, at + i) for i in range(n)))


def windows(benchmark: DataFrame, size: int = SIZE) -> DataFrame:
    """(item_id, words) of every window of every item that has words."""
    w = benchmark.select("item_id", words(F.col("text")).alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(0), F.greatest(F.size("w") - size, F.lit(0)))
    return w.select("item_id", "w", F.explode(starts).alias("s")).select("item_id", F.slice("w", F.col("s") + 1, size).alias("words"))


def _shingles(distinct: DataFrame) -> DataFrame:
    """(words, n, place, shingle): all shingles of each distinct window; n is their length."""
    n = F.least(F.size("words"), F.lit(SHINGLE))
    placed = distinct.select("words", n.alias("n"), F.explode(F.sequence(F.lit(0), F.size("words") - n)).alias("place"))
    made = F.when(F.col("n") == 1, _shingle(F.col("words"), F.col("place"), 1)).when(F.col("n") == 2, _shingle(F.col("words"), F.col("place"), 2))
    return placed.withColumn("shingle", made.otherwise(_shingle(F.col("words"), F.col("place"), SHINGLE)))


def _positions(docs: DataFrame, lengths: list[int]) -> DataFrame:
    """(doc_id, text_key, w, at, shingle): every shingle of every document with its place, for each length of shingles."""
    w = docs.select("doc_id", text_key().alias("text_key"), words(F.col("text")).alias("w")).where(F.size("w") > 0)
    at = w.select("*", F.explode(F.sequence(F.lit(0), F.size("w") - 1)).alias("at"))
    if len(lengths) == 1:
        return at.select("*", _shingle(F.col("w"), F.col("at"), lengths[0]).alias("shingle"))
    return at.select("*", F.explode(F.array(*(_shingle(F.col("w"), F.col("at"), n) for n in lengths))).alias("shingle"))


def _counted(positions: DataFrame, keys: DataFrame, most: int) -> DataFrame:
    """(shingle, f): how often each of keys (column shingle) stands in the documents."""
    few = size_of(keys) <= most
    at = positions.select("shingle")
    at = at.join(F.broadcast(keys), "shingle", "left_semi") if few else at.where(in_bitmap(keys, "shingle"))
    f = at.groupBy("shingle").agg(F.count("*").alias("f"))
    return f if few else f.join(keys, "shingle", "left_semi")


def _occurrences(positions: DataFrame, prefix: DataFrame, size: int, most: int) -> DataFrame:
    """(doc_id, text_key, start, words) of the windows of prefix (shingle, words, place) that stand in the documents."""
    p = prefix.select(F.col("shingle").alias("s"), "words", "place")
    start = F.col("at") - F.col("place")
    if size_of(prefix) <= most:
        inside = (start >= 0) & (start + F.size("words") <= F.size("w"))
        met = positions.join(F.broadcast(p), (F.col("shingle") == F.col("s")) & inside)
        found = met.where(F.slice("w", F.greatest(start, F.lit(0)) + 1, F.size("words")) == F.col("words"))
    else:  # around holds the words from size - 1 places before to size + SHINGLE places after the position
        begin = F.greatest(F.col("at") - (size - 1), F.lit(0))
        some = positions.where(in_bitmap(prefix, "shingle")).select("doc_id", "text_key", "at", "shingle", begin.alias("begin"), F.slice("w", begin + 1, F.col("at") - begin + size + SHINGLE).alias("around"))
        inner = start - F.col("begin")
        met = some.join(p, (F.col("shingle") == F.col("s")) & (start >= 0) & (inner + F.size("words") <= F.size("around")))
        found = met.where(F.slice("around", F.greatest(inner, F.lit(0)) + 1, F.size("words")) == F.col("words"))
    return found.select("doc_id", "text_key", start.alias("start"), "words").distinct()


def hits(docs: DataFrame, benchmark: DataFrame, size: int = SIZE, most: int | None = None) -> DataFrame:
    """(doc_id, text_key, start, words) of every occurrence of a window. Up to `most` bytes of shingles are broadcast."""
    most = BROADCAST_BYTES if most is None else most
    made = Table(windows(benchmark, size).select("words").distinct(), "windows")
    n = made.count()
    shingles = Table(_shingles(made.df), "window_shingles", rows=n * size).df
    keys = Table(shingles.select("shingle").distinct(), "benchmark_shingles", rows=n * size).df
    lengths = sorted(r.n for r in shingles.select("n").distinct().collect()) or [SHINGLE]  # at most SHINGLE rows
    positions = _positions(docs, lengths)
    counts = Table(_counted(positions, keys, most), "shingle_counts", rows=n * size).df
    # a window of which any shingle stands nowhere stands nowhere itself, so the least count is 0 or the prefix's
    prefix = shingles.join(small(counts), "shingle", "left")
    rarest = Window.partitionBy("words").orderBy(F.coalesce("f", F.lit(0)), "place")
    prefix = prefix.select("shingle", "words", "place", "f", F.row_number().over(rarest).alias("r")).where("r = 1 and f > 0")
    prefix = Table(prefix.select("shingle", "words", "place"), "prefixes", rows=n).df
    made.drop()
    return _occurrences(positions, prefix, size, most)


def contamination(docs: DataFrame, benchmark: DataFrame, size: int = SIZE) -> DataFrame:
    """One row for each row of docs: doc_id, n_words, n_hit, n_items, items_sha256, contaminated.

    A word is hit if it stands inside any occurrence of a window. Null and empty texts have no words, long ones are taken whole. Rows that repeat
    doc_id and text get equal rows; rows that share a doc_id or have none are apart by their texts. Null item_ids count as no item, though
    their windows hit. Empty tables give no rows and no hits; other columns aren't read.
    """
    found = written(hits(docs, benchmark, size).withColumn("length", F.size("words")), "window_hits")
    rows = docs.select("doc_id", text_key().alias("text_key"), F.size(words(F.col("text"))).alias("n_words"))
    key = ["doc_id", "text_key"]
    # words hit: with occurrences in order of their starts, each adds what lies past the furthest end before it
    furthest = F.max(F.col("start") + F.col("length")).over(Window.partitionBy(*key).orderBy("start", "length").rowsBetween(Window.unboundedPreceding, -1))
    new = F.col("start") + F.col("length") - F.greatest("start", F.coalesce(furthest, F.lit(0)))
    n_hit = found.select(*key, F.greatest(new, F.lit(0)).alias("new")).groupBy(*key).agg(F.sum("new").cast("long").alias("n_hit"))
    of = windows(benchmark, size).select("item_id", F.col("words").alias("__w")).distinct()
    items = found.select(*key, "words").distinct().join(of, F.col("words") == F.col("__w")).select(*key, F.col("item_id").cast("string").alias("i")).distinct()
    items = items.groupBy(*key).agg(F.array_sort(F.collect_list("i")).alias("items"))
    out = n_hit.join(items, [n_hit[k].eqNullSafe(items[k]) for k in key], "left").select(*(n_hit[k].alias(f"__{k}") for k in key), "n_hit", "items")
    out = rows.join(out, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in key], "left")
    items = F.coalesce("items", F.array().cast("array<string>"))
    return out.select(
        "doc_id",
        F.col("n_words").cast("long").alias("n_words"),
        F.coalesce("n_hit", F.lit(0)).alias("n_hit"),
        F.size(items).cast("long").alias("n_items"),
        F.sha2(F.array_join(items, ","), 256).alias("items_sha256"),
        (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
    )


def decontaminated(docs: DataFrame, benchmark: DataFrame, size: int = SIZE) -> DataFrame:
    """docs without the rows whose text holds a window; all columns stay as they are, whatever their names.

    Null and empty texts hold none and stay, long ones are searched whole. Equal texts share one fate; rows of one doc_id, or without one, are
    apart by their texts. Items without words have no window. An empty table on either side takes nothing away.
    """
    return without(docs, written(hits(docs, benchmark, size).select("doc_id", "text_key").distinct(), "contaminated"))


_WORDS = rf"list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{BETWEEN}'), lambda x: x <> '')"
ORACLE = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents), b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, g FROM (SELECT item_id, unnest(list_transform(range(1, greatest(len(w) - {SIZE}, 0) + 2), lambda i: w[i:i + {SIZE - 1}])) AS g FROM b WHERE len(w) > 0)),
grams AS (SELECT DISTINCT g, len(g) AS n FROM win),
runs AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM d, (SELECT DISTINCT n FROM grams)),
hit AS (SELECT doc_id, p, grams.n, grams.g FROM runs JOIN grams ON grams.n = runs.n AND grams.g = w[p:p + runs.n - 1]),
covered AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM hit) GROUP BY 1),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM hit JOIN win USING (g)) GROUP BY 1)
SELECT d.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN items USING (doc_id)
"""
