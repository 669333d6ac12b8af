"""Mixing sources to target weights by weighted fair queueing.

Each source's documents are shuffled by a hash. A document finishes at the virtual time (source words so far, its own
included) / (target words of the source); when it comes up again in a later round, all words of the source and round are
added. Over the whole mix, copies are taken in order of virtual time until the budget is used up.

Running sums never need one task for a source: a source's documents fall into buckets by the leading bits of their hash,
bucket sums are added up first, and only within a bucket does a window run. The global order is by virtual time in steps of 2 ** -40, then by the
shuffle's hash, so copies that finish at the same time, as the last ones of all sources at their limit do, come in an order that can be cut too. It is cut
digit by digit: words are summed by ranges of time, all ranges before the one in which the budget ends are taken whole, and that one is
looked at by the next digit of time and hash, until about SORTED copies are left to be sorted. As times rise within a source, what the mix takes of it is a run of its shuffled documents from the first on, round after
round. So one row for each source, with the last document taken, says what becomes of any document, and texts never move.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nameweave.llm.columns import fresh, ordinal, own, repeated, text_key
from nameweave.operators.numbering import numbered
from nameweave.scratch import Table, small

WEIGHTS, SHARE, ROUNDS, SEED = (3, 1, 2), 1.5, 2, 17
#: Rows of a bucket that a window is meant to sort, until there are BUCKETS of them for a source and 3 * BUCKETS ranges of time.
BUCKET_ROWS, BUCKETS = 1024, 1 << 16
#: Copies around the budget's end that one task sorts.
SORTED = 10_000


def words(text: Column) -> Column:
    """The number of runs of characters other than white space \\x20 and \\x09-\\x0D; 0 for null."""
    return F.coalesce(F.size(F.array_remove(F.split(text, "[\\x20\\x09-\\x0D]+"), "")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, rounds: int = ROUNDS) -> DataFrame:
    """(source, source_size, target) from (source, source_size): share of all words by weight, none over rounds times its source.

    Weights go round over the sources by code point, null last. The level is what a source of weight 1 gets. Those whose limit
    is below their share stand at the limit, and what is left gives the others a new, higher level, until none is above. Each turn
    counts the open sources of each weight; nothing but these few numbers comes to the driver.
    """
    s = sizes.select("source", "source_size", F.col("source").isNull().alias("last"), F.col("source").cast("string").alias("name"))
    s = numbered(s, ["last", "name"], "place").select("source", "source_size", F.pmod("place", F.lit(len(weights))).cast("int").alias("k"))
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), F.col("k") + 1)
    s = Table(s.select("source", "source_size", "k", weight.alias("w"), (F.col("source_size") * rounds).alias("most")), "source_weights").df
    budget = (s.agg(F.sum("source_size").alias("n")).head()["n"] or 0) * share
    level = None
    while True:
        open_ = F.lit(True) if level is None else F.col("most") > F.lit(level) * F.col("w")
        by_weight = s.groupBy("k").agg(F.sum(open_.cast("long")).alias("n"), F.sum(F.when(~open_, F.col("most"))).alias("full")).orderBy("k").collect()  # at most len(weights) rows
        weight_left = sum(r["n"] * float(weights[r["k"]]) for r in by_weight)
        new = (budget - sum(r["full"] or 0 for r in by_weight)) / weight_left if weight_left else float("inf")
        if level is not None and not new > level:
            break
        level = new
        if level == float("inf"):
            break
    return s.select("source", "source_size", F.least(F.col("most").cast("double"), F.lit(level) * F.col("w")).alias("target"))


def _source_key(df: DataFrame) -> Column:
    """The source without nulls."""
    return F.coalesce(F.concat(F.lit("1"), F.col("source").cast("string")), F.lit(""))


def _place(df: DataFrame, seed: int) -> list[Column]:
    """A document's place in its source's shuffle: a hash, and what sets equal hashes apart."""
    return [F.xxhash64(F.lit(seed), F.col("doc"), F.col("key")).alias("h"), F.col("doc"), F.col("key")]


def _with_times(entries: DataFrame, aim: DataFrame, buckets: int) -> DataFrame:
    """entries (s, h, doc, key, cost) with the time at which each finishes in its first round, and the time of a whole round."""
    entries = entries.withColumn("bucket", F.floor((F.col("h") / F.lit(2.0**64) + 0.5) * buckets).cast("long"))
    sums = entries.groupBy("s", "bucket").agg(F.sum("cost").alias("sum"))
    earlier = Window.partitionBy("s").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = Table(sums.select("s", "bucket", F.coalesce(F.sum("sum").over(earlier), F.lit(0)).alias("before")), "bucket_offsets").df
    within = Window.partitionBy("s", "bucket").orderBy("h", "doc", "key").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ran = entries.withColumn("run", F.sum("cost").over(within)).join(small(offsets), ["s", "bucket"]).join(small(aim), "s")
    ran = ran.where("target > 0")
    return ran.select("s", "h", "doc", "key", "cost", ((F.col("before") + F.col("run")) / F.col("target")).alias("time"), (F.col("source_size") / F.col("target")).alias("whole"))


def _digits(c: Column) -> list[Column]:
    """A long as four digits of 16 bits, the first of them signed, in whose order it stands."""
    return [F.shiftright(c, 48), *(F.shiftright(c, k).bitwiseAND(F.lit((1 << 16) - 1)) for k in (32, 16, 0))]


def _cut(rows: DataFrame, digit: Column, before: int, budget: float):
    """The digit at which the sum of cost, in its order and added to `before`, goes beyond the budget: with the sum before it and its number of rows."""
    upto = Window.orderBy("digit").rowsBetween(Window.unboundedPreceding, Window.currentRow)  # over at most 3 * BUCKETS rows
    sums = rows.groupBy(digit.alias("digit")).agg(F.sum("cost").alias("sum"), F.count("*").alias("n"))
    filled = sums.select("digit", "n", "sum", (F.sum("sum").over(upto) + F.lit(before)).alias("upto"))
    return filled.where(F.col("upto") > F.lit(budget)).orderBy("digit").select("digit", "n", (F.col("upto") - F.col("sum")).alias("before")).head()


def _aim(docs: DataFrame, weights: tuple[int, ...], share: float, rounds: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """(entries, aim): entries has one row for equal rows of docs; aim has s, source_size, target and the last copy taken of each source."""
    rows = docs.select("source", _source_key(docs).alias("s"), ordinal(docs).alias("doc"), text_key().alias("key"), words(F.col("text")).alias("size"))
    rows = rows.groupBy("source", "s", "doc", "key", "size").agg(F.count("*").alias("n"))
    entries = Table(rows.select("*", _place(rows, seed)[0], (F.col("size") * F.col("n")).alias("cost")), "mix_entries").df
    sizes = entries.groupBy("source").agg(F.sum("cost").alias("source_size"))
    aim = targets(Table(sizes, "source_sizes").df, weights, share, rounds)
    aim = Table(aim.select(_source_key(aim).alias("s"), "source_size", "target"), "mix_targets").df
    buckets = min(BUCKETS, max(1, entries.count() // BUCKET_ROWS))
    timed = _with_times(entries.where("cost > 0").select("s", "h", "doc", "key", "cost"), aim, buckets)
    copies = timed.select("*", F.explode(F.sequence(F.lit(0), F.lit(rounds - 1))).alias("round")).withColumn("time", F.col("time") + F.col("round") * F.col("whole")).drop("whole")
    # ranges of equal width up to time 2, and as many for all that is later
    t = F.col("time")
    copies = copies.withColumn("range", F.floor(F.when(t <= 2, t).otherwise(3 - 1 / (t - 1)) * buckets).cast("long")).withColumn("q", F.floor(F.least(t, F.lit(float(1 << 20))) * float(1 << 40)).cast("long"))
    copies = Table(copies, "mix_times").df
    budget = aim.agg(F.sum("target").alias("t")).head()["t"] or 0.0
    at = F.struct("round", "h", "doc", "key").alias("at")
    taken, here, before, n = None, copies, 0, None
    for digit in (F.col("range"), *_digits(F.col("q")), *_digits(F.col("h"))):
        if n is not None and n <= SORTED:
            break
        cut = _cut(here, digit, before, budget)
        if cut is None:  # only at the first digit: the budget takes all
            taken, here = copies.select("s", at), None
            break
        less = here.where(digit < F.lit(cut["digit"])).select("s", at)
        taken = less if taken is None else taken.union(less)
        here, before, n = here.where(digit == F.lit(cut["digit"])), cut["before"], cut["n"]
    if here is not None:
        in_order = Window.orderBy("q", "h", "s", "doc", "key", "round").rowsBetween(Window.unboundedPreceding, Window.currentRow)  # over SORTED rows or so
        ends = here.withColumn("sum", F.sum("cost").over(in_order) + F.lit(before))
        taken = taken.union(ends.where(F.col("sum") <= F.lit(budget)).select("s", at))
    last = taken.groupBy("s").agg(F.max("at").alias("at")).select("s", *(F.col(f"at.{c}").alias(f"last_{c}") for c in ("round", "h", "doc", "key")))
    return entries, Table(aim.join(last, "s", "left"), "mix_ends").df


def _copies(size: Column, here: list[Column], last: list[Column]) -> Column:
    """How often the mix takes a document: once for each round before the one in which its source's last copy is, and in that one if it isn't behind that copy."""
    round_, h, doc, key = last
    before = F.struct(*(c.alias(f"c{i}") for i, c in enumerate(here))) <= F.struct(h.alias("c0"), doc.alias("c1"), key.alias("c2"))
    return F.when((size > 0) & round_.isNotNull(), round_ + before.cast("int")).otherwise(F.lit(0))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, rounds: int = ROUNDS, seed: int = SEED) -> DataFrame:
    """One row for each different (source, doc_id, text): source, doc (ordinal of doc_id), key (hash of the text), size, n (equal rows), source_size, target, copies (times that the mix takes it).

    The order depends on seed, doc_id and text alone, so reruns agree. Null sources are one source, null texts have size 0.
    Documents without words cost nothing and have no virtual time of their own: they are taken 0 times. Equal rows are taken
    together. An empty table gives no rows.
    """
    entries, aim = _aim(docs, weights, share, rounds, seed)
    last = [F.col(f"last_{c}") for c in ("round", "h", "doc", "key")]
    here = [F.col(c) for c in ("h", "doc", "key")]
    return entries.join(small(aim), "s").select("source", "doc", "key", "size", "n", "source_size", "target", _copies(F.col("size"), here, last).alias("copies"))


def _decided(docs: DataFrame, weights: tuple[int, ...], share: float, rounds: int, seed: int) -> tuple[DataFrame, dict[str, str]]:
    """docs with size, source_size, target and copies under new names, and these names."""
    _, aim = _aim(docs, weights, share, rounds, seed)
    names = dict(zip(("s", "size", "source_size", "target", "copies", "round", "h", "doc", "key"), fresh(docs, "source_key", "size", "source_size", "target", "copies", "round", "h", "doc", "key"), strict=True))
    aim = aim.select(F.col("s").alias(names["s"]), F.col("source_size").alias(names["source_size"]), F.col("target").alias(names["target"]), *(F.col(f"last_{c}").alias(names[c]) for c in ("round", "h", "doc", "key")))
    rows = docs.select(*own(docs), _source_key(docs).alias(names["s"]), words(F.col("text")).alias(names["size"])).join(small(aim), names["s"])
    doc, key = ordinal(docs), text_key()
    copies = _copies(F.col(names["size"]), [F.xxhash64(F.lit(seed), doc, key), doc, key], [F.col(names[c]) for c in ("round", "h", "doc", "key")])
    return rows.withColumn(names["copies"], copies), names


def mixed_sizes(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, rounds: int = ROUNDS, seed: int = SEED) -> DataFrame:
    """One row for each row of docs: doc_id, size, source_size, target, taken (words that the mix takes, repeats counted).

    Null, empty and blank texts have size 0 and are never taken, long ones count whole. Equal rows have equal numbers, copies that end
    together are ordered by hash. A null source is a source of its own, an empty table gives no rows, other columns aren't read.
    """
    rows, c = _decided(docs.select("doc_id", "source", "text"), weights, share, rounds, seed)
    return rows.select("doc_id", F.col(c["size"]).alias("size"), F.col(c["source_size"]).alias("source_size"), F.col(c["target"]).alias("target"), (F.col(c["size"]) * F.col(c["copies"])).cast("long").alias("taken"))


def mixed(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, rounds: int = ROUNDS, seed: int = SEED) -> DataFrame:
    """docs as the mix takes them: a row that it takes twice is there twice, a row that it leaves out is gone.

    All columns stay as they are, whatever their names. Rows without words (null, empty, blank) cost nothing and are left out; long texts count all
    their words; equal rows are taken together; a null source is a source. An empty table stays empty.
    """
    rows, c = _decided(docs, weights, share, rounds, seed)
    return repeated(rows.select(*own(docs), c["copies"]), c["copies"]).select(*own(docs))
