"""Closed frequent itemsets of baskets and their rules: close-by-one over the iceberg lattice, in a breadth and a depth phase.

A concept is a set of baskets together with all items that these share, so its items are a closed itemset. Close-by-one makes each
concept once: items have an order (rarest first), a concept grows by one item that comes after the one it was made with, and the
closure of the result is kept only if it holds no earlier item that the grown concept lacks (the canonicity test). A failed test at
item j leaves the closure that it found. Concepts further down inherit it: where it still holds an item before j that they lack, their
own test at j must fail too, so that closure isn't made. Only concepts of `least` baskets or more are followed (the iceberg).

Breadth phase, by joins and grouped counts: a seed is a path of items and the baskets that hold all of them. Seeds whose baskets hold more than
`cells` items in all are closed and tested by counts, and their children are the next level's seeds. The others are small enough
for one task. Depth phase: the baskets of each small seed come together by its path, and its whole subtree is walked there.

Rules need the support of each itemset less one item. Items outside the seed's path are counted where the itemset is found, over the seed's
baskets. The rest, one for most itemsets, are asked of the baskets of the rarest item that is left, dealt into chunks of about `cells`
items, and the chunks' counts are added up.

Equal baskets are one row with a weight. Only items of at least `least` lines take part. There are at most lines / least of them, that
is SHARE times the lines of a mean basket, so neither a basket's row nor the table of items grows with the input.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nameweave.operators.numbering import numbered
from nameweave.scratch import Table, small

#: A frequent itemset is in LEAST baskets at least, and in one of SHARE.
LEAST, SHARE = 8, 5000
#: A rule holds for at least so many percent of the baskets on its left side.
PERCENT = 10
#: Items in the baskets of a seed or chunk, which one task has in memory.
CELLS = 4_000_000

_FOUND = "items array<int>, support long, c int, a long"
_FOUND_ARROW = pa.schema([("items", pa.list_(pa.int32())), ("support", pa.int64()), ("c", pa.int32()), ("a", pa.int64())])
_ASKED = "left array<int>, a long"
_ASKED_ARROW = pa.schema([("left", pa.list_(pa.int32())), ("a", pa.int64())])


class _Baskets:
    """Weighted baskets of one task, by row and by item; items in less than `least` of them are left out."""

    def __init__(self, rows: pa.Table, least: int):
        lists = rows.column("items").combine_chunks()
        self.weight = rows.column("weight").to_numpy().astype(np.float64)
        self.total = int(self.weight.sum())
        lengths = np.diff(lists.offsets.to_numpy())
        row = np.repeat(np.arange(len(lengths)), lengths)
        self.ids, at = np.unique(lists.flatten().to_numpy(), return_inverse=True)
        keep = np.bincount(at, self.weight[row], len(self.ids)) >= least
        new = np.cumsum(keep) - 1
        some = keep[at]
        self.ids, self.item, row = self.ids[keep], new[at[some]], row[some]
        self.length = np.bincount(row, minlength=len(lengths))
        self.begin = np.cumsum(self.length) - self.length
        self.rows, self.starts = self._by_item(self.item, row)
        self.support = np.bincount(self.item, self.weight[row], len(self.ids))

    def _by_item(self, item: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return row[np.argsort(item, kind="stable")], np.concatenate([[0], np.cumsum(np.bincount(item, minlength=len(self.ids)))])

    def rows_with(self, i: int) -> np.ndarray:
        return self.rows[self.starts[i] : self.starts[i + 1]]

    def within(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The items of these rows, and the row of each."""
        n = self.length[rows]
        at = np.arange(n.sum()) + np.repeat(self.begin[rows] - (np.cumsum(n) - n), n)
        return self.item[at], np.repeat(rows, n)

    def counts(self, item: np.ndarray, row: np.ndarray) -> np.ndarray:
        return np.bincount(item, self.weight[row], len(self.ids))


def _mask(items: Iterator[int]) -> int:
    out = 0
    for i in items:
        out |= 1 << int(i)
    return out


def _members(mask: int) -> list[int]:
    out = []
    while mask:
        low = mask & -mask
        out.append(low.bit_length() - 1)
        mask ^= low
    return out


def _concepts(b: _Baskets, path: list[int], intent: list[int], failed: dict[int, list[int]], least: int) -> Iterator[tuple[int, int]]:
    """(items as a mask over b.ids, support) of the seed's concept, if it is canonical, and of all concepts below it."""
    place = {int(x): i for i, x in enumerate(b.ids)}
    every = np.arange(len(b.length))
    closure = np.flatnonzero(b.support == b.total)
    known = {*intent, path[-1]}
    if any(b.ids[i] < path[-1] and int(b.ids[i]) not in known for i in closure):
        return
    # items of a failed closure that aren't frequent here can't matter: then neither is the item it failed at
    inherited = {place[j]: _mask(place[x] for x in d if x in place) for j, d in failed.items() if j in place}
    yield _mask(closure), b.total
    stack = [(every, _mask(closure), place[path[-1]] + 1, inherited)]
    while stack:
        rows, concept, start, failures = stack.pop()
        item, row = b.within(rows)
        count = b.counts(item, row)
        after = np.flatnonzero(count[start:] >= least) + start
        if not len(after):
            continue
        by, starts = b._by_item(item, row)
        below, mine = [], dict(failures)
        for j in map(int, after):
            if concept >> j & 1:
                continue
            before = (1 << j) - 1
            if failures.get(j, 0) & before & ~concept:
                continue
            grown = by[starts[j] : starts[j + 1]]
            closed = _mask(np.flatnonzero(b.counts(*b.within(grown)) == count[j]))
            if (closed ^ concept) & before:
                mine[j] = closed
            else:
                yield closed, int(count[j])
                below.append((grown, closed, j + 1))
        stack += [(*x, mine) for x in below]


def _less_one(b: _Baskets, items: list[int]) -> list[int]:
    """For each of the items, the baskets that hold all the others."""
    if len(items) == 1:
        return [b.total]
    if len(items) == 2:
        return [int(b.support[items[1]]), int(b.support[items[0]])]
    lists = [b.rows_with(i) for i in items]
    rows = np.concatenate(lists)
    held = np.bincount(rows)
    places = np.bincount(rows, np.repeat(np.arange(len(items)), [len(x) for x in lists]))
    all_of = b.weight[np.flatnonzero(held == len(items))].sum()
    but_one = np.flatnonzero(held == len(items) - 1)
    missing = (len(items) * (len(items) - 1) // 2 - places[but_one]).astype(int)
    return [int(x + all_of) for x in np.bincount(missing, b.weight[but_one], len(items))]


def _walk(seed: pa.Table, rows: pa.Table, least: int) -> pa.Table:
    """The itemsets of one seed's subtree: a row for each of their items c, with the support a of the others, or null if other baskets are needed for it."""
    sets, supports, one, others = [], [], [], []
    if seed.num_rows and rows.num_rows:
        path, intent, failed = (seed.column(c)[0].as_py() for c in ("path", "intent", "failed"))
        b = _Baskets(rows, least)
        if b.total >= least:
            for mask, support in _concepts(b, path, intent, {f["j"]: f["d"] for f in failed}, least):
                at = _members(mask)
                items = [int(b.ids[i]) for i in at]
                free = [i for i in at if int(b.ids[i]) not in path]
                known = dict(zip(free, _less_one(b, free), strict=True)) if free else {}
                for i, c in zip(at, items, strict=True):
                    sets.append(items)
                    supports.append(support)
                    one.append(c)
                    others.append(known.get(i))
    return pa.Table.from_arrays([pa.array(x, f.type) for x, f in zip((sets, supports, one, others), _FOUND_ARROW, strict=True)], schema=_FOUND_ARROW)


def _answers(asked: pa.Table, rows: pa.Table) -> pa.Table:
    """How many of the rows' baskets hold all of each `left`."""
    lefts, n = asked.column("left").to_pylist(), []
    b = _Baskets(rows, 1) if lefts and rows.num_rows else None
    place = {int(x): i for i, x in enumerate(b.ids)} if b else {}
    for left in lefts:
        lists = sorted((b.rows_with(place[x]) for x in left), key=len) if b and all(x in place for x in left) else [np.array([], int)]
        both = lists[0]
        for other in lists[1:]:
            both = both if len(other) == len(b.length) else np.intersect1d(both, other, assume_unique=True)
        n.append(int(b.weight[both].sum()) if b else 0)
    return pa.Table.from_arrays([pa.array(lefts, pa.list_(pa.int32())), pa.array(n, pa.int64())], schema=_ASKED_ARROW)


def _cells(items: str = "items") -> Column:
    return F.sum(F.size(items) + 1)


def _walked(seeds: DataFrame, rows: DataFrame, least: int) -> DataFrame:
    walk = lambda seed, own: _walk(seed, own, least)
    return seeds.select("path", "intent", "failed").groupBy("path").cogroup(rows.select("path", "items", "weight").groupBy("path")).applyInArrow(walk, _FOUND)


def _level(seeds: DataFrame, rows: DataFrame, least: int) -> tuple[DataFrame, Table, Table]:
    """The concepts of large seeds (as _walk gives them, each a null), and the next level: seeds with path, intent, failed and cells, and their rows."""
    total = rows.groupBy("path").agg(F.sum("weight").alias("total"))
    count = rows.select("path", F.explode("items").alias("i"), "weight").groupBy("path", "i").agg(F.sum("weight").alias("n")).where(F.col("n") >= least)
    held = count.join(total, "path").groupBy("path").agg(
        F.first("total").alias("total"),
        F.sort_array(F.collect_list(F.when(F.col("n") == F.col("total"), F.col("i")))).alias("closure"),
        F.collect_list("i").alias("frequent"),
    )
    y = F.element_at("path", -1)
    before = lambda items, j: F.filter(items, lambda i: i < j)
    tested = seeds.select("path", "intent", "failed").join(held, "path")
    tested = tested.withColumn("canonical", F.size(F.array_except(before("closure", y), "intent")) == 0)
    tested = Table(tested, "tested_seeds")
    parent = F.slice("path", 1, F.size("path") - 1)
    fails = tested.df.where("not canonical").groupBy(parent.alias("parent")).agg(F.collect_list(F.struct(y.alias("j"), F.col("closure").alias("d"))).alias("met"))
    good = tested.df.where("canonical").select("*", parent.alias("parent")).join(fails, "parent", "left")
    failed = F.when(F.col("met").isNull(), F.col("failed")).otherwise(F.concat("failed", "met"))
    good = good.select("path", "total", "closure", "frequent", failed.alias("failed"))
    grown = good.select("path", "closure", "failed", F.explode(F.array_except("frequent", "closure")).alias("j")).where(F.col("j") > y)
    # where an inherited closure holds an item before j that the concept lacks, the test at j would fail
    j = F.col("j")
    hopeless = F.exists("failed", lambda f: (f["j"] == j) & (F.size(F.array_except(F.filter(f["d"], lambda i: i < j), F.col("closure"))) > 0))
    grown = grown.where(~hopeless).select("path", "j", F.col("closure").alias("intent"), F.filter("failed", lambda f: f["j"] > j).alias("failed"))
    children = Table(grown, "grown_seeds").df
    each = rows.select("path", F.explode("items").alias("j"), "items", "weight").join(small(children.select("path", "j")), ["path", "j"])
    below = Table(each.select(F.concat("path", F.array("j")).alias("path"), "items", "weight"), "seed_baskets")
    seeds = children.select(F.concat("path", F.array("j")).alias("path"), "intent", "failed")
    seeds = Table(seeds.join(below.df.groupBy("path").agg(_cells().alias("cells")), "path"), "seeds")
    found = good.select(F.col("closure").alias("items"), F.col("total").alias("support"), F.explode("closure").alias("c"), F.lit(None).cast("long").alias("a"))
    return found, seeds, below


def _found(baskets: DataFrame, items: DataFrame, least: int, cells: int) -> Table:
    """All closed itemsets, as _walk gives them."""
    none = F.array().cast("array<struct<j:int,d:array<int>>>")
    seeds = items.select(F.array("rank").alias("path"), F.array().cast("array<int>").alias("intent"), none.alias("failed"), "cells")
    rows = baskets.select(F.explode("items").alias("i"), "items", "weight").select(F.array("i").alias("path"), "items", "weight")
    parts = []
    while True:
        large = Table(seeds.where(F.col("cells") > cells), "large_seeds")
        if not large.count():
            parts.append(_walked(seeds, rows, least))
            break
        paths = small(large.df.select("path"))
        parts.append(_walked(seeds.where(F.col("cells") <= cells), rows.join(paths, "path", "left_anti"), least))
        found, seeds, rows = _level(large.df, rows.join(paths, "path", "left_semi"), least)
        parts.append(found)
        seeds, rows = seeds.df, rows.df
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return Table(out, "closed_itemsets")


def _others(baskets: DataFrame, items: DataFrame, asked: DataFrame, cells: int) -> DataFrame:
    """(left, a): the support of each `left` of two items or more."""
    first = F.element_at("left", 1)
    chunks = items.select(F.col("rank").alias("r"), F.ceil(F.col("cells") / cells).cast("int").alias("chunks"))
    asked = asked.select("left", first.alias("r")).join(small(chunks), "r").select("left", "r", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"))
    of = small(asked.select("r").distinct().join(small(chunks), "r"))
    rows = baskets.where(F.size("items") > 1).select(F.explode("items").alias("r"), "items", "weight").join(of, "r")
    rows = rows.select("r", F.pmod(F.xxhash64("items"), F.col("chunks")).cast("int").alias("chunk"), "items", "weight")
    return asked.groupBy("r", "chunk").cogroup(rows.groupBy("r", "chunk")).applyInArrow(lambda q, own: _answers(q.select(["left"]), own.select(["items", "weight"])), _ASKED).groupBy("left").agg(F.sum("a").alias("a"))


def closed_itemsets(lines: DataFrame, least: int = LEAST, share: int = SHARE, percent: int = PERCENT, cells: int = CELLS) -> DataFrame:
    """One row for each non-empty closed itemset in at least `least` baskets and one of `share`: items, n_items, support, n_rules, best_item, rules_sha256.

    A basket is the set of item_ids of a sale_id; rows without either are left out, repeated ones count once, and other columns aren't read. A
    rule takes one item c from an itemset of two or more: at least `percent` of the baskets with the rest (a of them) have c, and more than
    by chance. best_item is the rule's item with the smallest a, then the smallest c. Empty tables give no rows. item_ids are whole numbers.
    """
    pairs = lines.select("sale_id", F.col("item_id").cast("long").alias("item_id")).where("sale_id is not null and item_id is not null")
    n = pairs.select("sale_id").distinct().count()
    least = max(least, -(-n // share))
    often = pairs.groupBy("item_id").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    order = Table(numbered(Table(often, "frequent_lines").df, ["n", "item_id"], "rank").select(F.col("rank").cast("int").alias("rank"), "item_id"), "item_order").df
    some = pairs.join(small(order), "item_id").groupBy("sale_id").agg(F.sort_array(F.collect_set("rank")).alias("items"))
    baskets = Table(some.groupBy("items").agg(F.count("*").alias("weight")), "baskets").df
    each = baskets.select(F.explode("items").alias("rank"), F.size("items").alias("k"), "weight")
    items = each.groupBy("rank").agg(F.sum("weight").alias("s"), F.sum(F.col("k") + 1).alias("cells")).where(F.col("s") >= least)
    items = Table(items.join(small(order), "rank"), "frequent_items").df

    found = _found(baskets, items, least, cells).df
    left = F.array_remove("items", F.col("c"))
    open_ = (F.col("a").isNull()) & (F.size("items") > 1)
    asked = Table(found.where(open_ & (F.size("items") > 2)).select(left.alias("left")).distinct(), "asked").df
    told = _others(baskets, items, asked, cells).unionByName(items.select(F.array("rank").alias("left"), F.col("s").alias("a")))
    rows = found.where(~open_).unionByName(found.where(open_).select("items", "support", "c", left.alias("left")).join(told, "left").select("items", "support", "c", "a"))
    rows = rows.join(small(items.select(F.col("rank").alias("c"), "item_id", "s")), "c")
    holds = (F.size("items") > 1) & (F.col("support") * 100 >= F.col("a") * percent) & (F.col("support") * n > F.col("a") * F.col("s"))
    rule = F.when(holds, F.struct("item_id", "a", "s"))
    sets = rows.groupBy("items", "support").agg(
        F.sort_array(F.collect_list("item_id")).alias("ids"),
        F.sort_array(F.collect_list(rule)).alias("rules"),
        F.min(F.when(holds, F.struct("a", "item_id"))).alias("best"),
    )
    text = lambda r: F.concat_ws(":", *(r[c].cast("string") for c in ("item_id", "a", "s")))
    return sets.select(
        F.array_join(F.col("ids").cast("array<string>"), ",").alias("items"),
        F.size("ids").cast("long").alias("n_items"),
        "support",
        F.size("rules").cast("long").alias("n_rules"),
        F.col("best.item_id").alias("best_item"),
        F.sha2(F.array_join(F.transform("rules", text), ";"), 256).alias("rules_sha256"),
    )


ORACLE = f"""
WITH RECURSIVE pairs AS (SELECT DISTINCT sale_id, CAST(item_id AS BIGINT) AS item FROM sale_lines WHERE sale_id IS NOT NULL AND item_id IS NOT NULL),
of AS (SELECT count(DISTINCT sale_id) AS b, greatest({LEAST}, (count(DISTINCT sale_id) + {SHARE - 1}) // {SHARE}) AS least FROM pairs),
k AS (SELECT sale_id, item FROM pairs WHERE item IN (SELECT item FROM pairs GROUP BY item HAVING count(*) >= (SELECT least FROM of))),
f AS (
  SELECT [item] AS items, item AS last, sale_id FROM k
  UNION ALL
  SELECT items, last, sale_id FROM (SELECT list_append(f.items, k.item) AS items, k.item AS last, f.sale_id FROM f JOIN k ON k.sale_id = f.sale_id AND k.item > f.last)
  QUALIFY count(*) OVER (PARTITION BY items) >= (SELECT least FROM of)),
s AS (SELECT items, count(*) AS support FROM f GROUP BY items),
less AS (SELECT u.items, u.support, u.c, s.support AS a FROM (SELECT items, support, unnest(items) AS c FROM s WHERE len(items) > 1) u JOIN s ON s.items = list_filter(u.items, lambda x: x <> u.c)),
open_sets AS (SELECT DISTINCT list_filter(items, lambda x: x <> c) AS items FROM less WHERE a = support),
rules AS (SELECT less.items, c, a, one.support AS s FROM less JOIN s one ON one.items = [c], of WHERE 100 * less.support >= {PERCENT} * a AND less.support * b > a * one.support),
told AS (SELECT items, count(*) AS n, arg_min(c, (a, c)) AS best, string_agg(concat(c, ':', a, ':', s), ';' ORDER BY c) AS r FROM rules GROUP BY items)
SELECT array_to_string(s.items, ',') AS items, len(s.items) AS n_items, s.support, coalesce(n, 0) AS n_rules, best AS best_item, sha256(coalesce(r, '')) AS rules_sha256
FROM s LEFT JOIN told ON told.items = s.items WHERE s.items NOT IN (SELECT items FROM open_sets)
"""
