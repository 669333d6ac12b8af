"""Near copies: documents whose sets of five-word shingles have a Jaccard similarity of at least SIMILARITY, and chains of these.

op4's contract (three words, two bits) finds little beyond equal texts. Here min-hash bands give candidates, and a pair
counts by the exact similarity of the two sets, taken from the texts themselves. A pair at similarity s shares a band
with probability 1 - (1 - s ** ROWS) ** BANDS: 99.98 % at 0.8, more above.

Members of a band's bucket meet a leader first, twice with another one. After that only members of different components
are compared, in the first bucket that two of them share. Before the texts are, a bitmap of the parity of hashed shingles
has to allow it: the sets differ in at least as many shingles as the bitmaps in bits. So no similar pair that shares a band
is left out, and a large group of copies at all distances costs few pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nameweave.llm.columns import in_batches, one_each, text_key, without
from nameweave.operators.components import connected_components
from nameweave.scratch import shuffled, written

WORDS, SIMILARITY, BANDS, ROWS, LEADERS, BITS, SEED = 5, (4, 5), 16, 4, 2, 256, 42


def shingles(text: str | None, words: int = WORDS) -> set[bytes]:
    """The shingles of a text, split and lower-cased as fingerprints do; all words as one if there are fewer; none without words."""
    w = (text or "").encode("utf-8", "surrogatepass").lower().split()
    return {b" ".join(w[i : i + words]) for i in range(max(1, len(w) - words + 1))} if w else set()


def similar(a: set[bytes], b: set[bytes]) -> bool:
    """Whether the Jaccard similarity is at least SIMILARITY, in whole numbers."""
    n, d = SIMILARITY
    if not a or not b or min(len(a), len(b)) * d < max(len(a), len(b)) * n:
        return False
    both = len(a & b)
    return both * d >= (len(a) + len(b) - both) * n


def signature(text: str | None) -> tuple[list[int], int, list[int]]:
    """(a signed hash for each band, number of shingles, parity bitmap as signed words); no hashes without words."""
    from xxhash import xxh64_intdigest as h

    rng = np.random.default_rng(SEED)
    flips, factors = (rng.integers(0, 1 << 64, BANDS * ROWS, np.uint64) for _ in range(2))
    factors |= np.uint64(1)
    found = shingles(text)
    hashes = np.fromiter((h(s, SEED) for s in found), np.uint64, len(found))
    parity = np.bincount((hashes & np.uint64(BITS - 1)).astype(np.int64), minlength=BITS) & 1
    bits = np.packbits(parity.astype(np.uint8)).view(np.int64).tolist()
    if not found:
        return [], 0, bits
    least = np.full(BANDS * ROWS, (1 << 64) - 1, np.uint64)
    for i in range(0, len(hashes), 1024):
        np.minimum(least, ((hashes[i : i + 1024, None] ^ flips) * factors).min(axis=0), out=least)
    digests = [h(least[i * ROWS : (i + 1) * ROWS].tobytes(), i) for i in range(BANDS)]
    return np.array(digests, np.uint64).view(np.int64).tolist(), len(found), bits


def _signature(text: Column) -> Column:
    kind = pa.struct([("bands", pa.list_(pa.int64())), ("size", pa.int64()), ("bits", pa.list_(pa.int64()))])

    @F.arrow_udf("struct<bands:array<bigint>,size:bigint,bits:array<bigint>>")
    def f(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for b in batches:
            yield pa.array([dict(zip(("bands", "size", "bits"), signature(x), strict=True)) for x in b.to_pylist()], kind)

    return f(text)


def _allowed(x: Column, y: Column) -> Column:
    """Whether the bitmaps of two signatures leave room for SIMILARITY: at n/d the sets differ in (d - n) / (d + n) of their sizes at most."""
    n, d = SIMILARITY
    apart = sum((F.bit_count(x["bits"][i].bitwiseXOR(y["bits"][i])) for i in range(BITS // 64)), F.lit(0))
    return apart * (d + n) <= (x["size"] + y["size"]) * (d - n)


def _similar(a: str, b: str) -> Column:
    @F.arrow_udf("boolean")
    def f(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        last: tuple[str | None, set[bytes]] = (None, set())
        for xs, ys in batches:
            out = []
            for x, y in zip(xs.to_pylist(), ys.to_pylist(), strict=True):
                if x != last[0]:
                    last = (x, shingles(x))
                out.append(similar(last[1], shingles(y)))
            yield pa.array(out, pa.bool_())

    return f(a, b)


def _verified(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """Those of pairs (x, y, root_x, root_y; x and y are text keys) whose texts are similar, as links a, b of roots."""
    pairs = written(pairs, "near_candidates")
    keys = pairs.select(F.explode(F.array("x", "y")).alias("k")).distinct()
    texts = docs.select(text_key().alias("k"), "text").join(keys, "k", "left_semi").groupBy("k").agg(F.min("text").alias("t"))
    texts = written(texts, "near_candidate_texts")
    side = lambda end: shuffled(texts.select(F.col("k").alias(end), F.col("t").alias(f"t{end}")))
    both = pairs.join(side("x"), "x").join(side("y"), "y")
    return written(both.where(_similar("tx", "ty")).select(F.col("root_x").alias("a"), F.col("root_y").alias("b")).distinct(), "near_links")


def _ordered(x: Column, y: Column, root_x: Column, root_y: Column) -> list[Column]:
    """x, y, root_x, root_y with x < y, so that a pair that meets in several bands is one."""
    first = F.when(x < y, F.struct(x.alias("k"), root_x.alias("r"))).otherwise(F.struct(y.alias("k"), root_y.alias("r")))
    other = F.when(x < y, F.struct(y.alias("k"), root_y.alias("r"))).otherwise(F.struct(x.alias("k"), root_x.alias("r")))
    return [first["k"].alias("x"), other["k"].alias("y"), first["r"].alias("root_x"), other["r"].alias("root_y")]


def _with_leader(members: DataFrame, turn: int) -> DataFrame:
    """Each member of a bucket of several components with its leader, unless they are of one component."""
    order = F.struct(F.xxhash64(F.lit(turn), "key").alias("o"), "key", "root", "sig")
    led = members.groupBy("band").agg(F.min(order).alias("leader"), F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high")
    rows = members.join(led.select("band", "leader"), "band").where((F.col("root") != F.col("leader")["root"]) & _allowed(F.col("sig"), F.col("leader")["sig"]))
    return rows.select(*_ordered(F.col("key"), F.col("leader")["key"], F.col("root"), F.col("leader")["root"])).distinct()


def _the_rest(members: DataFrame) -> DataFrame:
    """All pairs of a bucket that are of different components: those outside its largest component with all others."""
    sizes = members.groupBy("band", "root").agg(F.count("*").alias("n"))
    main = sizes.groupBy("band").agg(F.max(F.struct("n", "root"))["root"].alias("main"), F.count("*").alias("roots")).where("roots > 1")
    outside = members.join(main, "band").where("root <> main").select("band", F.col("key").alias("o_key"), F.col("root").alias("o_root"), F.col("sig").alias("o_sig"))
    before = F.arrays_overlap(F.slice(F.col("sig.bands"), F.lit(1), F.col("at")), F.slice(F.col("o_sig.bands"), F.lit(1), F.col("at")))
    rows = outside.join(members, "band").where((F.col("root") != F.col("o_root")) & _allowed(F.col("sig"), F.col("o_sig")) & ~before)
    return rows.select(*_ordered(F.col("key"), F.col("o_key"), F.col("root"), F.col("o_root"))).distinct()


def near_copies(docs: DataFrame) -> DataFrame:
    """One row for each row of docs: doc_id, text_key, component_id (the smallest doc_id of its component, null if it has none), stays (whether it is the one of its component to keep).

    Null and empty texts are copies of each other; texts without words are near no other.
    """
    base = written(in_batches(docs).select("doc_id", text_key().alias("key"), _signature(F.col("text")).alias("sig")), "near_base")
    n = base.count()
    texts = written(base.groupBy("key").agg(F.first("sig").alias("sig")), "near_texts", rows=n)
    roots = texts.select("key", F.col("key").alias("root"))
    bands = texts.select("key", "sig", F.posexplode("sig.bands").alias("at", "band"))
    crowded = written(shuffled(bands).join(bands.groupBy("band").agg(F.count("*").alias("n")).where("n > 1").select("band"), "band"), "near_bands")
    for turn in range(LEADERS + 1):
        members = crowded.join(roots, "key")
        found = _verified(docs, _with_leader(members, turn) if turn < LEADERS else _the_rest(members))
        if found.isEmpty():
            continue
        merged = connected_components(found, "a", "b", n).select(F.col("node").alias("root"), "component")
        roots = written(roots.join(merged, "root", "left").select("key", F.coalesce("component", "root").alias("root")), "near_roots", rows=n)
    of = base.select("doc_id", "key").join(roots, "key")
    first = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", F.col("key").alias("text_key"))
    smallest = of.groupBy("root").agg(F.min(first).alias("keeper"))
    return of.join(smallest, "root").select("doc_id", F.col("key").alias("text_key"), F.col("keeper.doc_id").alias("component_id"), first.eqNullSafe(F.col("keeper")).alias("stays"))


def without_near_copies(docs: DataFrame) -> DataFrame:
    """docs with one row of each component: the one with the smallest doc_id, null last, and of these the smallest hash of the text.

    All columns stay as they are, whatever their names. Null and empty texts are copies of each other, texts without words are near no
    other, long ones count as a whole. Of rows equal in doc_id and text one stays. An empty table stays empty.
    """
    found = near_copies(docs).groupBy("doc_id", "text_key").agg(F.max("stays").alias("stays"), F.count("*").alias("n"))
    found = written(found.where("not stays or n > 1"), "near_copies")
    return one_each(without(docs, found.where("not stays")), found.where("stays"))
