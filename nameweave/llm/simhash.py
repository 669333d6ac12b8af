"""SimHash near-dedup by anchor-point covering.

A fingerprint's 64 bits are cut into blocks of 23, 23, 7, 7 and 4. The anchors are the product of perfect codes on the first four
blocks, the binary Golay code of length 23 (covering radius 3) twice and the Hamming code of length 7 (covering radius 1) twice,
and the zero word alone on the last, whose covering radius is 4. Every fingerprint has a home: the nearest anchor, block by
block. It lies within the block radii. If two fingerprints differ in at most t bits, the second one lies within those radii
plus t of the first one's home, with the t spread over the blocks. So each fingerprint is replicated to every anchor whose
distances exceed the block radii by at most t in all, and each anchor compares its own fingerprints with its replicas. No pair
is lost, and each pair of distinct fingerprints is found once.

With t = 2 there are 2^32 anchors and about 126 replicas of a fingerprint.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nameweave.llm.columns import in_batches, one_each, text_key, without
from nameweave.operators.components import connected_components
from nameweave.scratch import Table, shuffled

WORDS, SEED, THRESHOLD = 3, 42, 2
#: Of each block with a code: its bits, the covering radius, and the generator polynomial (x^11+x^10+x^6+x^5+x^4+x^2+1, x^3+x+1).
GOLAY, HAMMING = (23, 3, 0b110001110101), (7, 1, 0b1011)
BLOCKS = (GOLAY, GOLAY, HAMMING, HAMMING)
#: Fingerprints whose replicas are made in one task.
TASK = 20_000


def fingerprint(text: str | None, words: int = WORDS, seed: int = SEED) -> int:
    """The unsigned fingerprint: bit k is 1 if it is 1 in more than half of the shingles' hashes; 0 without words."""
    from xxhash import xxh64_intdigest as h

    w = (text or "").encode("utf-8", "surrogatepass").lower().split()  # of bytes: A-Z alone, and \x20\x09-\x0D
    if not w:
        return 0
    n = max(1, len(w) - words + 1)
    ones = np.zeros(64, np.int64)
    for i in range(0, n, 1 << 16):  # the text's words are held, but only so many hashes
        part = w[i : i + (1 << 16) + words - 1]
        if words == 3 and len(part) >= 3:
            hashes = [h(b"%b %b %b" % s, seed) for s in zip(part, part[1:], part[2:], strict=False)]
        else:
            hashes = [h(b" ".join(part[k : k + words]), seed) for k in range(max(1, len(part) - words + 1))]
        block = np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(block, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(text: Column, words: int = WORDS) -> Column:
    """The fingerprint of a text as a bigint with the same 64 bits."""

    @F.arrow_udf("bigint")
    def f(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for b in batches:
            yield pa.array(np.array([fingerprint(x, words) for x in b.to_pylist()], np.uint64).view(np.int64), pa.int64())

    return f(text)


def syndromes(words: np.ndarray, code: tuple[int, int, int] = GOLAY) -> np.ndarray:
    """The remainder of each word, as a polynomial, by the code's generator; words differ by a codeword if it is the same."""
    bits, _, generator = code
    checks = generator.bit_length() - 1
    r = words.astype(np.int64).copy()
    for bit in range(bits - 1, checks - 1, -1):
        r ^= ((r >> bit) & 1) * (generator << (bit - checks))
    return r


@cache
def error_patterns(threshold: int, code: tuple[int, int, int] = GOLAY) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each excess 0, 1, .. threshold: a table of the error patterns that exceed the radius by it, by syndrome, as (offsets, patterns).

    A codeword at distance d of a word is the word plus a pattern of weight d with the word's syndrome. Excess 0 takes
    weights up to the radius, of which a perfect code has exactly one pattern for each syndrome.
    """
    bits, radius, generator = code
    out = []
    for excess in range(threshold + 1):
        weights = range(radius + 1) if excess == 0 else [radius + excess]
        p = np.array([sum(1 << i for i in c) for w in weights for c in combinations(range(bits), w)], np.int64)
        s = syndromes(p, code)
        order = np.lexsort((p, s))
        out.append((np.searchsorted(s[order], np.arange((1 << (generator.bit_length() - 1)) + 1)), p[order]))
    return out


def _spread(rows: np.ndarray, words: np.ndarray, excess: int, threshold: int, code: tuple[int, int, int]) -> tuple[np.ndarray, np.ndarray]:
    """(places in rows, codewords): for each of the words, by row, all codewords at that excess."""
    offsets, patterns = error_patterns(threshold, code)[excess]
    w = words[rows]
    s = syndromes(words, code)[rows]
    n = offsets[s + 1] - offsets[s]
    ends = np.cumsum(n)
    at = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - n, n) + np.repeat(offsets[s], n)
    return np.repeat(np.arange(len(rows)), n), np.repeat(w, n) ^ patterns[at]


def anchors(fp: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, anchor) of every anchor within the covering radii plus threshold of each fingerprint; threshold 0 gives homes."""
    u = fp.view(np.uint64)
    found = {0: (np.arange(len(fp)), np.zeros(len(fp), np.int64))}  # by excess so far
    low = 0
    for code in BLOCKS:
        bits = code[0]
        words = ((u >> np.uint64(low)) & np.uint64((1 << bits) - 1)).astype(np.int64)
        low += bits
        wider: dict[int, list] = {}
        for used, (rows, anchor) in found.items():
            for e in range(threshold + 1 - used):
                at, c = _spread(rows, words, e, threshold, code)
                wider.setdefault(used + e, []).append((rows[at], anchor[at] << bits | c))
        found = {e: (np.concatenate([r for r, _ in parts]), np.concatenate([a for _, a in parts])) for e, parts in wider.items()}
    return np.concatenate([r for r, _ in found.values()]), np.concatenate([a for _, a in found.values()])


def _at_anchors(fps: DataFrame, threshold: int, name: str) -> DataFrame:
    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = b.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            for i in range(0, len(fp), 2048):
                part = fp[i : i + 2048]
                rows, a = anchors(part, threshold)
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(part[rows])], names=["anchor", name])

    return fps.select("fp").mapInArrow(f, f"anchor long, {name} long")


def links(fps: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """(a, b), a < b, of all distinct fingerprints of fps (column fp, no repeats) that differ in at most threshold bits."""
    homes, replicas = _at_anchors(fps, 0, "a"), _at_anchors(fps, threshold, "b")
    near = (F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= threshold)
    # Spark takes replicas for as many as there are fingerprints
    return shuffled(homes).join(shuffled(replicas), "anchor").where(near).select("a", "b")


def _grouped(docs: DataFrame, words: int, threshold: int) -> tuple[DataFrame, DataFrame]:
    """(base, of): base has doc_id, text_key, fp for each row of docs; of has component_id and keeper for each fp.

    keeper is the smallest (doc_id, text_key) of the component, with null doc_ids last.
    """
    base = Table(in_batches(docs).select("doc_id", text_key().alias("text_key"), fingerprints(F.col("text"), words).alias("fp")), "fingerprints").df
    first = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")
    n = base.count()
    distinct = Table(base.groupBy("fp").agg(F.min(first).alias("keeper")), "distinct_fingerprints", rows=n).df
    tasks = max(1, -(-n // TASK))  # of few bytes each, so files alone would put too many into one task
    component = connected_components(links(distinct.select("fp").repartition(tasks, "fp"), threshold), "a", "b", n).select(F.col("node").alias("fp"), "component")
    rooted = distinct.join(component, "fp", "left").select("fp", "keeper", F.coalesce("component", "fp").alias("root"))
    smallest = rooted.groupBy("root").agg(F.min("keeper").alias("keeper"))
    return base, rooted.select("fp", "root").join(smallest, "root").select("fp", F.col("keeper.doc_id").alias("component_id"), "keeper")


def near_duplicates(docs: DataFrame, words: int = WORDS, threshold: int = THRESHOLD) -> DataFrame:
    """One row for each row of docs: doc_id, fingerprint, component_id.

    Equal fingerprints meet as one before any comparison, so copies cost no pairs. Null, empty and blank texts have fingerprint
    0 and are linked like any other; texts of any length count as a whole. component_id ignores null doc_ids and is null where
    a component has no other. Repeated rows get equal rows; an empty table gives none; other columns aren't read.
    """
    base, of = _grouped(docs, words, threshold)
    return base.join(of, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def without_near_duplicates(docs: DataFrame, words: int = WORDS, threshold: int = THRESHOLD) -> DataFrame:
    """docs with one row of each component: the one with the smallest doc_id, null last, and of these the smallest hash of the text.

    All columns stay as they are, whatever their names. Null, empty and blank texts have fingerprint 0 and are one component; long texts
    count as a whole. Of rows equal in doc_id and text one stays, rows of one doc_id or none and different texts are apart. An empty table stays empty.
    """
    base, of = _grouped(docs, words, threshold)
    rows = base.join(of, "fp").select("doc_id", "text_key", F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key").eqNullSafe(F.col("keeper")).alias("stays"))
    found = Table(rows.groupBy("doc_id", "text_key").agg(F.max("stays").alias("stays"), F.count("*").alias("n")).where("not stays or n > 1"), "near_duplicates").df
    return one_each(without(docs, found.where("not stays")), found.where("stays"))
