"""Periodic runs of words, found by harmonic grid probing.

A run is a stretch of consecutive words with smallest period p (words p apart are equal) and of length >= max(SHORTEST, TIMES * p) that no neighbouring
word extends. The grid of a period p has a point at every p-th word, and a run that long holds TIMES grid points in a row, whose words
are equal. So for each p only the words at jp and (j+1)p are compared; p goes up to 1 / TIMES of a text, which makes n log n compares in all.
Points where TIMES - 1 such tests in a row succeed survive. From a survivor the run is extended to either side by
comparing chunks of the word array with itself p words on, in chunks that double.

Periods go upwards, and a found run marks its words with its end. A survivor whose TIMES grid points lie within one found run is skipped: by
Fine and Wilf's theorem such a stretch has period p only if the run's own period divides p, and then it is that run again.

Texts are probed together: the word numbers of all texts of an Arrow batch stand in one array, longest first, with a number of
its own between two texts, which no stretch with a period can hold. For a period only the texts that are long enough are looked at.
"""

from __future__ import annotations

import hashlib
import zlib
from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nameweave.llm.columns import in_batches

#: A run has at least SHORTEST words and TIMES periods.
SHORTEST, TIMES = 6, 4
#: Words compared at first when a run is extended, and words looked at together to thin out survivors.
CHUNK, LOOK = 64, 8

_DIGEST = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def rewritten(ids: np.ndarray, doc_id: int | None) -> np.ndarray:
    """The words of one document in ten, by a hash of its id, with a periodic tail. Without an id they stay."""
    n = len(ids)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 or not n:
        return ids
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return np.concatenate([ids[:a], np.resize(ids[a : a + p], n - a)])


def _agreeing(one: np.ndarray, two: np.ndarray) -> int:
    """How many of the first elements are equal, compared chunk by chunk."""
    at, size = 0, CHUNK
    while at < len(one):
        other = np.flatnonzero(one[at : at + size] != two[at : at + size])
        if len(other):
            return at + int(other[0])
        at += size
        size *= 2
    return len(one)


def runs_of(texts: list[np.ndarray]) -> list[list[tuple[int, int, int]]]:
    """(start, length, period) of all runs of each text, by start, then period. Texts are arrays of numbers from 0 on."""
    order = sorted(range(len(texts)), key=lambda i: -len(texts[i]))
    lengths = np.array([len(texts[i]) for i in order], dtype=np.int64)
    begins = np.concatenate([[0], np.cumsum(lengths + 1)])
    words = np.empty(begins[-1], dtype=np.int64)
    for k, i in enumerate(order):
        words[begins[k] : begins[k] + lengths[k]] = texts[i]
        words[begins[k] + lengths[k]] = -1 - k
    covered = np.zeros(len(words), dtype=np.int64)  # the furthest end of the runs found at each word
    found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    # the number of texts, longest first, that can hold a run of period p
    for p in range(1, int(lengths[0]) // TIMES + 1 if len(lengths) else 0):
        several = int(np.searchsorted(-lengths, -max(SHORTEST, TIMES * p), side="right"))
        part = words[: begins[several]]
        grid = part[::p]
        same = grid[1:] == grid[:-1]
        tests = len(same) - TIMES + 2
        if tests <= 0:
            continue
        good = same[:tests].copy()
        for k in range(1, TIMES - 1):
            good &= same[k : k + tests]
        at = np.flatnonzero(good) * p
        at = at[covered[at] <= at + (TIMES - 1) * p]
        if not len(at):
            continue
        # words p apart are equal for 2p words on from the run's first grid point
        for i in range(1, min(2 * p, LOOK) + 1):
            at = at[part[at + i] == part[at + i + p]]
        for g in map(int, at):
            if covered[g] > g + (TIMES - 1) * p:
                continue
            right = g + _agreeing(part[g : len(part) - p], part[g + p :])
            if right <= g + 2 * p:
                continue
            left = g - _agreeing(part[:g][::-1], part[p : g + p][::-1])
            if right + p - left >= max(SHORTEST, TIMES * p):
                end = right + p
                np.maximum(covered[left:end], end, out=covered[left:end])
                k = int(np.searchsorted(begins, left, side="right")) - 1
                found[order[k]].append((left - int(begins[k]), end - left, p))
    return [sorted(x, key=lambda r: (r[0], r[2])) for x in found]


def collapsed(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Which of n words are kept: all but those of a run after its first period."""
    keep = np.ones(n, dtype=bool)
    for start, length, period in runs:
        keep[start + period : start + length] = False
    return keep


def _batch(doc_ids: list, texts: list[bytes], rewrite: bool) -> Iterator[tuple[list[bytes], np.ndarray, list[tuple[int, int, int]]]]:
    """(the batch's words by number, the document's words, its runs) for each document."""
    number: dict[bytes, int] = defaultdict(count().__next__)
    ids = []
    for i, t in zip(doc_ids, texts, strict=True):
        words = t.split()  # of bytes: at \x20 and \x09-\x0D, and at nothing else
        x = np.fromiter(map(number.__getitem__, words), dtype=np.int64, count=len(words))
        ids.append(rewritten(x, i) if rewrite else x)
    known = list(number)
    for x, runs in zip(ids, runs_of(ids), strict=True):
        yield known, x, runs


def _columns(batch: pa.RecordBatch) -> tuple[list, list[bytes]]:
    return batch.column(0).to_pylist(), [b or b"" for b in batch.column(1).to_pylist()]


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        doc_ids, texts = _columns(batch)
        for i, (known, x, runs) in zip(doc_ids, _batch(doc_ids, texts, True), strict=True):
            best = runs[0] if runs else None
            for r in runs[1:]:
                if (r[1] * best[2], -r[0], -r[2]) > (best[1] * r[2], -best[0], -best[2]):
                    best = r
            kept = b" ".join(known[w] for w in x[collapsed(len(x), runs)])
            listed = "".join("%d,%d,%d\n" % r for r in runs).encode()
            start, length, period = best or (None, None, None)
            out.append((i, len(runs), start, length, period, best and 1000 * length // period, hashlib.sha256(listed).hexdigest(), hashlib.sha256(kept).hexdigest()))
        names = [f.split()[0] for f in _DIGEST.split(", ")]
        kinds = [pa.string() if f.endswith("string") else pa.int64() for f in _DIGEST.split(", ")]
        yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)] if out else [pa.array([], k) for k in kinds], names=names)


def _found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    run = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
    for batch in batches:
        doc_ids, texts = _columns(batch)
        runs, kept = [], []
        for known, x, r in _batch(doc_ids, texts, False):
            runs.append([{"start": s, "length": n, "period": p} for s, n, p in r])
            kept.append(b" ".join(known[w] for w in x[collapsed(len(x), r)]).decode())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(runs, pa.list_(run)), pa.array(kept, pa.string())], names=["doc_id", "runs", "collapsed"])


def _read(docs: DataFrame) -> DataFrame:
    return in_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))


def run_lengths(docs: DataFrame) -> DataFrame:
    """One row for each row of docs: doc_id, runs (array of start, length, period) and collapsed, the text's words without the repeats of its runs, joined by spaces.

    Null and empty texts have no words and no runs, an empty table gives no rows, rows alike get rows alike, other columns aren't read.
    A text of any length is probed whole, in one task.
    """
    return _read(docs).mapInArrow(_found, "doc_id long, runs array<struct<start:long,length:long,period:long>>, collapsed string")


def periodic_runs(docs: DataFrame) -> DataFrame:
    """One row for each row of docs, one in ten of which is first given a periodic tail (`rewritten`): doc_id, n_runs, the run with the most
    repetitions (start, length, period, exponent_milli; ties: first start, then smallest period; nulls without runs), runs_sha256, collapsed_sha256.

    Null and empty texts have no words; a null doc_id leaves the words as they are. Repeated rows get equal rows, an empty table gives
    none, other columns aren't read, and a text of any length is taken whole.
    """
    return _read(docs).mapInArrow(_digests, _DIGEST)
