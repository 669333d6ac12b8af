"""Column helpers shared by the operators of this subpackage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nameweave.scratch import BROADCAST_BYTES, Table, shuffled, size_of

#: A-Z and a-z as text, for lower-casing these letters alone.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Bytes of an Arrow batch that goes to a Python worker; a longer row is a batch of its own.
BATCH_BYTES = 16 << 20
#: Words of a bitmap, of 64 bits each, at least and at most; between them it has 16 bits for each key.
LEAST_WORDS, MOST_WORDS = 1 << 12, 1 << 20


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z and no other letter. lower() does that on pure ASCII and is much faster there."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def text_key(text: Column | str = "text") -> Column:
    """A hash of the text, null as empty. (doc_id, text_key) is a document's identity, so rows without or with a shared doc_id stay apart."""
    return F.xxhash64(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names like those given that no column of df has."""
    taken = {c.lower() for c in df.columns}
    out = []
    for n in names:
        k = 0
        while (name := f"__{n}{k or ''}").lower() in taken:
            k += 1
        taken.add(name.lower())
        out.append(name)
    return out


def own(df: DataFrame) -> list[Column]:
    """All columns of df, whatever their names hold."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns]


def ordinal(docs: DataFrame) -> Column:
    """The doc_id without nulls, in its order and with nulls first: a long for whole numbers, else a string."""
    kind = docs.schema["doc_id"].dataType
    if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.NullType)):
        return F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)))
    return F.coalesce(F.concat(F.lit("1"), F.col("doc_id").cast("string")), F.lit(""))


def in_bitmap(keys: DataFrame, *columns: str) -> Column:
    """Whether a row may have its columns among the rows of keys (same names): never false if it has.

    The keys set bits of a map whose size goes with their number, up to MOST_WORDS words (8 MB); with more keys than that is for it lets
    more rows through. It comes to the executors with the plan.
    """
    size = min(MOST_WORDS, max(LEAST_WORDS, 1 << max(0, keys.count() // 4 - 1).bit_length()))
    h = F.xxhash64(*columns)
    word = lambda x: F.shiftrightunsigned(x, 6).bitwiseAND(F.lit(size - 1))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("h").bitwiseAND(F.lit(63)).cast("int"))
    words = keys.select(h.alias("h")).groupBy(word(F.col("h")).alias("w")).agg(F.bit_or(bit).alias("b"))
    every = keys.sparkSession.range(size).join(words, F.col("id") == F.col("w"), "left").select("id", F.coalesce("b", F.lit(0)).alias("b"))
    table = every.agg(F.array_sort(F.collect_list(F.struct("id", "b"))).alias("a")).select(F.col("a.b").alias("a")).scalar()
    return F.call_function("shiftright", F.get(table, word(h).cast("int")), h.bitwiseAND(F.lit(63)).cast("int")).bitwiseAND(F.lit(1)) == 1


def among(rows: DataFrame, keys: DataFrame, columns: list[str], keep: bool, most: int | None = None) -> DataFrame:
    """The rows whose columns are, or with keep false aren't, among keys (same column names, no nulls in them).

    Up to `most` bytes keys are broadcast. Beyond that only rows that a bitmap of the keys lets through are shuffled.
    """
    how = "left_semi" if keep else "left_anti"
    if size_of(keys) <= (BROADCAST_BYTES if most is None else most):
        return rows.join(F.broadcast(keys), columns, how)
    flag = in_bitmap(keys, *columns)
    found = rows.where(flag).join(shuffled(keys), columns, how)
    return found if keep else found.unionByName(rows.where(~flag))


def without(docs: DataFrame, gone: DataFrame, most: int | None = None) -> DataFrame:
    """The rows of docs whose (doc_id, text_key) isn't in gone, which has these two columns. Nulls in doc_id are equal."""
    o, k = fresh(docs, "drop_id", "drop_key")
    gone = gone.select(ordinal(gone).alias(o), F.col("text_key").alias(k)).distinct()
    rows = docs.select("*", ordinal(docs).alias(o), text_key().alias(k))
    return among(rows, Table(gone, "gone").df, [o, k], False, most).select(*own(docs))


def one_each(docs: DataFrame, repeated: DataFrame) -> DataFrame:
    """docs with one row for each (doc_id, text_key) in repeated, which names those of which docs holds several equal ones."""
    if repeated.isEmpty():
        return docs
    o, k = fresh(docs, "same_id", "same_key")
    same = Table(repeated.select(ordinal(repeated).alias(o), F.col("text_key").alias(k)).distinct(), "repeated").df
    rows = docs.select("*", ordinal(docs).alias(o), text_key().alias(k))
    several = among(rows, same, [o, k], True).dropDuplicates([o, k])
    return among(rows, same, [o, k], False).unionByName(several).select(*own(docs))


def in_batches(docs: DataFrame) -> DataFrame:
    """docs, whose session bounds the bytes of the batches that Python workers get, if it doesn't do so by itself.

    By rows alone, 10,000 of them, a few hundred MB of long texts, their copies in Python and the results would be in memory at once. The
    bound changes no result.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    spark = docs.sparkSession
    if spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(name)) > BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))
    return docs


def repeated(rows: DataFrame, times: str, most: int = 4096) -> DataFrame:
    """Each of the rows as often as its column `times` says, in runs of at most `most`, so no array grows with the number. The column goes."""
    run, each = fresh(rows, "run", "each")
    rows_of = [c for c, k in zip(own(rows), rows.columns, strict=True) if k != times]
    n = F.col(times).cast("long")
    runs = rows.where(n > 0).select(*rows_of, n.alias(times), F.explode(F.sequence(F.lit(0).cast("long"), F.floor((n - 1) / most))).alias(run))
    last = F.least(F.lit(most).cast("long"), F.col(times) - F.col(run) * most)
    return runs.select(*rows_of, F.explode(F.sequence(F.lit(1).cast("long"), last)).alias(each)).drop(each)
