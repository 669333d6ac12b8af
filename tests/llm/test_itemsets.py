import hashlib
import random
from itertools import combinations

import pytest

from nameweave.llm import itemsets
from tests.llm.conftest import collected

LINES = "sale_id long, line_no int, item_id long, flag string"


def closed(lines, least, share, percent):
    """All closed itemsets by going through all subsets of all baskets."""
    baskets = {}
    for sale, _, item, _ in lines:
        if sale is not None and item is not None:
            baskets.setdefault(sale, set()).add(item)
    n = len(baskets)
    support = {}
    for b in baskets.values():
        for k in range(1, len(b) + 1):
            for s in combinations(sorted(b), k):
                support[s] = support.get(s, 0) + 1
    frequent = {s: c for s, c in support.items() if c >= least and c * share >= n}
    items = {i for s in frequent for i in s}
    out = []
    for s, c in frequent.items():
        if any(support.get(tuple(sorted({*s, i})), 0) == c for i in items - {*s}):
            continue
        rules = []
        for i in s if len(s) > 1 else ():
            a, alone = support[tuple(x for x in s if x != i)], support[(i,)]
            if 100 * c >= percent * a and c * n > a * alone:
                rules.append((i, a, alone))
        best = min(((a, i) for i, a, _ in rules), default=(None, None))[1]
        digest = hashlib.sha256(";".join(f"{i}:{a}:{x}" for i, a, x in rules).encode()).hexdigest()
        out.append((",".join(map(str, s)), len(s), c, len(rules), best, digest))
    return sorted(map(repr, out))


def dense(seed, sales=60, items=7):
    r = random.Random(seed)
    rows = []
    for s in range(sales):
        kind = r.randrange(3)  # baskets of a kind share items, so closures are larger than what was asked for
        for i in range(items):
            if r.random() < (0.8 if i % 3 == kind else 0.25) or i == 4 and s % 2:
                rows += [(s, 1, 100 - i, "N")] * r.choice([1, 1, 2])
    return rows


@pytest.mark.parametrize("cells", [itemsets.CELLS, 150])
@pytest.mark.parametrize("seed", [1, 2])
def test_dense_baskets_by_all_subsets(spark, seed, cells):
    rows = dense(seed)
    df = spark.createDataFrame(rows, LINES).repartition(3)
    got = itemsets.closed_itemsets(df, least=3, share=30, percent=60, cells=cells)
    assert sorted(repr(tuple(r)) for r in got.collect()) == closed(rows, 3, 30, 60)


def test_an_item_in_all_baskets_and_items_always_together(spark):
    rows = [(s, 1, i, None) for s in range(20) for i in (7, *((1, 2) if s % 2 else (3,)))]
    got = itemsets.closed_itemsets(spark.createDataFrame(rows, LINES), cells=5)
    assert sorted(repr(tuple(r)) for r in got.collect()) == closed(rows, 8, 5000, 10)
    assert {r.items for r in got.collect()} == {"7", "1,2,7", "3,7"}


def test_nulls_repeats_clashing_columns_and_a_hot_basket(spark):
    rows = [(None, 1, 5, None), (3, None, None, "x"), (None, None, None, None)] + [(s, 1, i, "N") for s in range(12) for i in (5, 6)] * 2
    rows += [(99, 1, i, "R") for i in range(4000)]  # one basket with all items
    df = spark.createDataFrame(rows, LINES)
    names = ["items", "rank", "weight", "support", "n", "path", "cells", "s", "c", "a"]
    clashing = df.selectExpr("*", *(f"{i} as {c}" for i, c in enumerate(names)))
    want = [("5,6", 2, 13)]
    assert [tuple(r)[:3] for r in itemsets.closed_itemsets(df).collect()] == want
    assert collected(itemsets.closed_itemsets(clashing)) == collected(itemsets.closed_itemsets(df))


def test_no_rows_and_no_frequent_item(spark):
    assert itemsets.closed_itemsets(spark.createDataFrame([], LINES)).collect() == []
    assert itemsets.closed_itemsets(spark.createDataFrame([(1, 1, 1, None)], LINES)).collect() == []


def test_inherited_failures_avoid_closures(monkeypatch):
    """The walk without inherited failures makes more closures and finds the same."""
    import pyarrow as pa

    baskets = {}
    for s, _, i, _ in dense(3, 200, 12):
        baskets.setdefault(s, set()).add(i)
    rows = pa.table({"items": pa.array([sorted(b) for b in baskets.values()], pa.list_(pa.int32())), "weight": pa.array([1] * len(baskets), pa.int64())})
    made = []

    class Counting(itemsets._Baskets):
        def within(self, rows):
            made.append(len(rows))
            return super().within(rows)

    class Forgetful(dict):
        def __setitem__(self, k, v):
            pass

    def walked():
        made.clear()
        own = ((y, rows.filter(pa.array([y in b for b in baskets.values()]))) for y in range(89, 101))
        return [(y, sorted(itemsets._concepts(Counting(x, 4), [y], [], {}, 4))) for y, x in own], len(made)

    inheriting, fewer = walked()
    monkeypatch.setattr(itemsets, "dict", Forgetful, raising=False)
    forgetting, more = walked()
    assert inheriting == forgetting
    assert fewer < more
