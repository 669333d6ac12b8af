"""Line dedup as an exact set-similarity join, in SQL functions alone.

A line's set is its distinct words (runs of characters other than \\x20 and \\x09-\\x0D). A line is removed if an earlier
line, by doc_id and line number over all documents, has a set of Jaccard similarity `least` or more, be that line itself
removed or not. Lines without words are never removed.

Equal sets: only the first line of each set can stay, and only these first lines go into the join.
Similar sets: words are ordered by rarity, after counts over all documents in a table of BUCKETS hashed counts, whose size
doesn't depend on the data; ties go by hash. Sets of similarity t share one of their n - ceil(t * n) + 1 rarest words each
(prefix filter); m >= t * n for the smaller size m (length filter); what can still be shared after the places of
the common word must suffice (positional filter); and the words' parity bitmaps differ in no more bits than the sets differ
in words. Pairs that pass are verified on the words themselves.

Of a large group of variants of one line nearly all are similar to its first line. So the join runs twice. First each
line meets only the first line that shares one of its leaders, the smallest and the largest of its words' hashes. That
costs a line two pairs at most, and as min-hashes they are shared by similar lines more often than not. Then the lines that are still there meet all earlier ones.

A document is known by (doc_id, text hash), so rows without a doc_id, or with one that others have too, are documents of their
own, in the order of their hashes; rows equal in both are one document and get the same decisions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nameweave.llm.columns import among, fresh, ordinal, own, text_key
from nameweave.scratch import Table, small

LEAST, BUCKETS, SIDE = 0.8, 1 << 18, 8
#: White space besides space and line end.
WHITE = "\t\x0b\x0c\r"
#: Counts up to which rarity tells words apart.
_MOST = (1 << 22) - 1
#: Lines whose decisions are the bits of one number.
RUN = 16
#: A document, and a line of it.
DOC, LINE = ["doc", "key"], ["doc", "key", "line"]


def _plain(text: Column) -> Column:
    """The text with spaces for all white space but line ends. Most texts hold no other, and splitting at one character is much faster."""
    other = F.lit(False)
    for c in WHITE:
        other = other | F.contains(text, F.lit(c))
    return F.when(other, F.regexp_replace(text, f"[{WHITE}]", " ")).otherwise(text)


def _words(line: Column) -> Column:
    """The distinct words of a plain line."""
    return F.array_distinct(F.array_remove(F.split(line, " "), ""))


def lines(docs: DataFrame) -> DataFrame:
    """(doc, key, line, l): every line that has a word; lines end at \\n and count from 0."""
    # the key in a step of its own: next to a generator it would be made anew for each line
    keyed = docs.select(ordinal(docs).alias("doc"), text_key().alias("key"), "text")
    return keyed.select(*DOC, F.posexplode(F.split(_plain(F.col("text")), "\n")).alias("line", "l")).where(F.ltrim("l") != "")


def counts(docs: DataFrame) -> DataFrame:
    """One row with one array of longs: how many words of all texts fall into each bucket, in the upper bits that a key has for it."""
    bucket = F.xxhash64("w").bitwiseAND(F.lit(BUCKETS - 1))
    words = docs.select(F.explode(F.split(F.replace(_plain(F.col("text")), F.lit("\n"), F.lit(" ")), " ")).alias("w")).where("w <> ''").select(bucket.alias("b"))
    # SIDE buckets side by side in one group: so few groups stay in the aggregate's fast map, and fewer rows are shuffled
    side = [f"n{i}" for i in range(SIDE)]
    n = words.groupBy(F.shiftright("b", SIDE.bit_length() - 1).alias("g")).agg(*(F.count_if(F.col("b").bitwiseAND(F.lit(SIDE - 1)) == i).alias(c) for i, c in enumerate(side)))
    every = docs.sparkSession.range(BUCKETS // SIDE).join(n, F.col("id") == F.col("g"), "left")
    upper = F.array(*(F.shiftleft(F.least(F.coalesce(c, F.lit(0)), F.lit(_MOST)), 40) for c in side))
    groups = F.array_sort(F.collect_list(F.struct("id", upper.alias("n"))))
    return every.agg(groups.alias("groups")).select(F.flatten(F.col("groups.n")).alias("counts"))


def _need(n: Column | int, m: Column, least: float) -> Column:
    """Words that sets of n and m words must share."""
    return F.ceil((n + m) * (least / (1 + least)) - 1e-9)


def _similar_sizes(n: Column, m: Column, share: Column, least: float) -> Column:
    """Whether sets of n and m words, of which `share` can be common, can be similar."""
    return (F.least(n, m) >= F.greatest(n, m) * least - 1e-9) & (share >= (n + m) * (least / (1 + least)) - 1e-9)


def _similar_bits(x: dict[str, Column], y: dict[str, Column], least: float) -> Column:
    """Whether the parity maps differ in no more bits than similar sets can differ in words. Lines of up to 64 words have one map, which is the other lines' two maps folded into one."""
    one, two = x["bits"].bitwiseXOR(y["bits"]), x["bits2"].bitwiseXOR(y["bits2"])
    bits = F.when((x["n"] > 64) & (y["n"] > 64), F.bit_count(one) + F.bit_count(two)).otherwise(F.bit_count(one.bitwiseXOR(two)))
    return bits <= x["n"] + y["n"] - 2 * _need(x["n"], y["n"], least)


def _earlier(x: list[Column], y: list[Column]) -> Column:
    """Whether x comes before y, by the first column in which they differ."""
    less = x[0] < y[0]
    return less | ((x[0] == y[0]) & _earlier(x[1:], y[1:])) if len(x) > 1 else less


def _bits(hashes: str, half: int | None) -> Column:
    """The parity map of hashes, of all or of those that are negative (half 1) or not (half 0)."""
    bit = lambda h: F.call_function("shiftleft", F.lit(1).cast("long"), h.bitwiseAND(F.lit(63)).cast("int"))
    chosen = F.col(hashes) if half is None else F.filter(hashes, lambda h: h < 0 if half else h >= 0)
    return F.aggregate(chosen, F.lit(0).cast("long"), lambda acc, h: acc.bitwiseXOR(bit(h)))


def first_lines(docs: DataFrame, least: float) -> DataFrame:
    """(doc, key, line, n, bits, bits2, leaders, prefix) of the first line of each set.

    prefix has the keys of its rarest words, rarest first, and leaders the smallest and largest hashes of its words.
    """
    # As a column of its own, as functions of array elements take no subquery. Nothing else is new in that step, so the optimizer
    # puts it into the function all the same; else each row would get a copy of the table.
    table = counts(docs).scalar().alias("counts")
    hashes = F.sort_array(F.array_distinct(F.array_remove(F.transform(F.split("l", " "), lambda w: F.xxhash64(w)), F.xxhash64(F.lit("")))))
    # what a generator gives is there once, whereas projections are merged and would repeat it for each use; the hashes
    # themselves are made in the step before it, in generated code
    hashed = lines(docs).select(*LINE, hashes.alias("h")).select(*LINE, F.explode(F.array("h")).alias("h"))
    bucket = lambda h: h.bitwiseAND(F.lit(BUCKETS - 1)).cast("int")
    key = lambda h: F.get(F.col("counts"), bucket(h)).bitwiseOR(F.shiftrightunsigned(h, 24))
    n = F.size("h")
    leaders = F.array(F.get("h", F.lit(0)), F.element_at("h", -1))
    length = (n - F.ceil(n * least - 1e-9) + 1).cast("int")
    entry = F.struct(
        *LINE,
        n.alias("n"),
        F.when(n > 64, _bits("h", 0)).otherwise(_bits("h", None)).alias("bits"),
        F.when(n > 64, _bits("h", 1)).otherwise(F.lit(0).cast("long")).alias("bits2"),
        leaders.alias("leaders"),
        F.slice(F.sort_array(F.transform("h", key)), 1, length).alias("prefix"),
    )
    keyed = hashed.select(*LINE, "h", table).select(F.xxhash64("h").alias("set1"), F.xxhash64(F.lit(1), "h").alias("set2"), entry.alias("e"))
    return keyed.groupBy("set1", "set2").agg(F.min("e").alias("e")).select("e.*")


def _led(some: DataFrame, least: float) -> DataFrame:
    """Pairs of each line with a first line that shares one of its leaders, if they can be similar.

    Leaders are counted before anything is sorted by them, so one that a third of all lines share meets as one row for each
    task, and only lines with a shared leader go on.
    """
    met = some.select(F.explode(F.array_distinct("leaders")).alias("leader"), *LINE, "n", "bits", "bits2")
    shared = met.groupBy("leader").agg(F.min("doc").alias("doc0"), F.count("*").alias("c")).where("c > 1").select("leader", "doc0")
    shared = Table(shared, "shared_leaders")
    whole = F.struct(*LINE, "n", "bits", "bits2")
    heads = met.join(small(shared.df), "leader").where("doc = doc0").groupBy("leader").agg(F.min(whole).alias("x"))
    heads = Table(heads, "leading_lines")
    shared.drop()
    y = met.select("leader", whole.alias("y")).join(small(heads.df), "leader")
    x, y_ = ({c: F.col(f"{s}.{c}") for c in (*LINE, "n", "bits", "bits2")} for s in "xy")
    can = _similar_sizes(x["n"], y_["n"], F.least(x["n"], y_["n"]), least) & _earlier([x[c] for c in LINE], [y_[c] for c in LINE]) & _similar_bits(x, y_, least)
    pairs = y.where(can)
    return pairs.select(*(y_[c].alias(c) for c in LINE), *(x[c].alias(f"{c}0") for c in LINE)).distinct()


def _met(some: DataFrame, gone: DataFrame, least: float) -> DataFrame:
    """Pairs of each line that isn't gone yet with all earlier lines under one of its prefix words, if they can be similar.

    Rows are kept narrow: at is the line's number times 2, plus 1 if it is gone, and place has the number of words and the word's place.
    Both sides are one and the same exchange, which they are as long as no condition is on one side alone.
    """
    still = some.join(small(gone.select(*LINE, F.lit(1).alias("led"))), LINE, "left")
    at = F.col("line").cast("long") * 2 + F.coalesce("led", F.lit(0))
    entries = still.select(*DOC, at.alias("at"), "n", "bits", "bits2", F.posexplode("prefix").alias("i", "token"))
    place = F.shiftleft(F.col("n").cast("long"), 32).bitwiseOR(F.col("i").cast("long"))
    # a word that stands once in all texts has no other line to meet; the upper bits of its key are how often it stands
    entries = entries.where(F.shiftright("token", 40) > 1).select("token", *DOC, "at", place.alias("place"), "bits", "bits2")

    def side(s: str) -> dict[str, Column]:
        c = {k: F.col(f"{s}.{k}") for k in entries.columns}
        return c | {"n": F.shiftright(c["place"], 32), "i": c["place"].bitwiseAND(F.lit((1 << 32) - 1))}

    x, y = side("x"), side("y")
    share = F.least(x["n"] - x["i"], y["n"] - y["i"])  # the common word and those after it; i counts from 0
    place_of = lambda c: [c["doc"], c["key"], F.shiftright(c["at"], 1)]
    alive = (y["at"] % 2) * 2 <= x["at"] % 2  # y isn't gone
    # the cheapest and most telling conditions come first
    can = (x["doc"] <= y["doc"]) & _similar_sizes(x["n"], y["n"], share, least) & alive & _earlier(place_of(x), place_of(y)) & _similar_bits(x, y, least)
    pairs = entries.alias("x").join(entries.alias("y"), (x["token"] == y["token"]) & can)
    line = lambda c: F.shiftright(c["at"], 1).cast("int")
    return pairs.select(y["doc"], y["key"], line(y).alias("line"), x["doc"].alias("doc0"), x["key"].alias("key0"), line(x).alias("line0")).distinct()


def _verified(docs: DataFrame, pairs: DataFrame, least: float) -> Table:
    """(doc, key, line) of the later lines of those pairs (with the earlier line in doc0, key0, line0) whose sets are similar, from their words."""
    pairs = Table(pairs, "line_pairs")
    first = pairs.df.select(*(F.col(f"{c}0").alias(c) for c in LINE))
    wanted = Table(pairs.df.select(*LINE).union(first).distinct(), "wanted_lines")
    texts = docs.select(ordinal(docs).alias("doc"), "text")
    texts = among(texts, Table(wanted.df.select("doc").distinct(), "wanted_docs").df, ["doc"], True)
    each = texts.select("doc", text_key().alias("key"), "text").select(*DOC, F.posexplode(F.split(_plain(F.col("text")), "\n")).alias("line", "l"))
    words = Table(among(each, wanted.df, LINE, True).select(*LINE, _words(F.col("l")).alias("w")).dropDuplicates(LINE), "wanted_words")
    wanted.drop()
    both = pairs.df.join(words.df, LINE).join(words.df.select(*(F.col(c).alias(f"{c}0") for c in LINE), F.col("w").alias("w0")), [f"{c}0" for c in LINE])
    out = Table(both.where(F.size(F.array_intersect("w", "w0")) >= _need(F.size("w"), F.size("w0"), least)).select(*LINE).distinct(), "similar_lines")
    pairs.drop()
    words.drop()
    return out


def kept_lines(docs: DataFrame, least: float = LEAST) -> DataFrame:
    """(doc, key, line) of all lines with words that stay."""
    first = Table(first_lines(docs, least), "first_lines").df
    # sets of so few words that one word less is too many have no similar set but themselves
    some = first.where(F.col("n") >= F.ceil(F.lit(least / (1 - least) - 1e-9)))
    gone = _verified(docs, _led(some, least), least).df
    gone = gone.union(_verified(docs, _met(some, gone, least), least).df)
    return first.select(*LINE).join(small(gone), LINE, "left_anti")


def _stays(docs: DataFrame, least: float) -> DataFrame:
    """(doc, key, stays): the numbers of the lines with words that stay, for documents that have any.

    RUN lines in a row become the bits of one number first, which takes no list for each line.
    """
    at = F.col("line").bitwiseAND(F.lit(RUN - 1))
    run = F.shiftright("line", RUN.bit_length() - 1)
    runs = kept_lines(docs, least).repartition(*DOC).groupBy(*DOC, run.alias("run")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1), at)).alias("bits"))
    every = F.sequence(F.lit(0), F.lit(RUN - 1))
    of = lambda r: F.transform(F.filter(every, lambda i: F.call_function("shiftright", r["bits"], i).bitwiseAND(F.lit(1)) == 1), lambda i: i + r["run"] * RUN)
    return runs.groupBy(*DOC).agg(F.collect_list(F.struct("run", "bits")).alias("runs")).select(*DOC, F.flatten(F.transform("runs", of)).alias("stays"))


def line_decisions(docs: DataFrame, least: float = LEAST) -> DataFrame:
    """One row for each row of docs: doc_id, n_lines, n_removed, kept (numbers of the lines that stay, blank ones too, comma-joined).

    Null texts have no lines; an empty text has a blank one; texts of any length are taken whole. Rows equal in doc_id and text
    get equal rows, rows with the same doc_id or none and different texts are documents of their own. An empty table gives none; other columns aren't read.
    """
    stays = _stays(docs, least)
    none = F.array().cast("array<int>")
    rows = docs.select("doc_id", ordinal(docs).alias("doc"), text_key().alias("key"), _plain(F.col("text")).alias("text"))
    # most documents have no blank line, and aren't split
    some = F.contains(F.concat(F.lit("\n"), F.replace("text", F.lit(" ")), F.lit("\n")), F.lit("\n\n"))
    blank = F.when(some, F.filter(F.transform(F.split("text", "\n"), lambda l, i: F.when(F.ltrim(l) == "", i)), lambda i: i.isNotNull()))
    n = F.octet_length("text") - F.octet_length(F.replace("text", F.lit("\n"))) + 1
    rows = rows.select("doc_id", *DOC, F.coalesce(n, F.lit(0)).cast("long").alias("n_lines"), blank.alias("blank"))
    keep = F.sort_array(F.concat(F.coalesce("blank", none), F.coalesce("stays", none)))
    rows = rows.join(stays, DOC, "left").select("doc_id", "n_lines", F.when(F.col("n_lines") > 0, keep).otherwise(none).alias("keep"))
    return rows.select("doc_id", "n_lines", (F.col("n_lines") - F.size("keep")).alias("n_removed"), F.array_join(F.col("keep").cast("array<string>"), ",").alias("kept"))


def deduplicated(docs: DataFrame, least: float = LEAST) -> DataFrame:
    """docs with the removed lines cut out of their texts; other columns as they are. Null texts stay null."""
    doc, key, held = fresh(docs, "doc", "key", "stays")
    stays = _stays(docs, least).withColumnsRenamed({"doc": doc, "key": key, "stays": held})
    rows = docs.select(*own(docs), ordinal(docs).alias(doc), text_key().alias(key)).join(stays, [doc, key], "left")
    blank = lambda l: F.regexp_replace(l, f"[ {WHITE}]", "") == ""
    lines_of = F.split("text", "\n")
    stay = F.coalesce(F.col(held), F.array().cast("array<int>"))
    numbers = F.sort_array(F.array_union(F.filter(F.transform(lines_of, lambda l, i: F.when(blank(l), i)), lambda i: i.isNotNull()), stay))
    text = F.array_join(F.transform(numbers, lambda i: F.get(lines_of, i)), "\n")
    return rows.withColumn("text", F.when(F.col("text").isNotNull(), text)).select(*own(docs))


ORACLE = r"""
WITH l AS (
  SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line, unnest(string_split(text, chr(10))) AS t FROM documents WHERE text IS NOT NULL),
w AS (SELECT doc_id, line, list_sort(list_distinct(list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> ''))) AS words FROM l),
sets AS (SELECT words, min((doc_id, line)) AS pos, row_number() OVER () AS s, len(words) AS n FROM w WHERE len(words) > 0 GROUP BY words),
tok AS (SELECT s, n, pos, unnest(words) AS t FROM sets WHERE n > 3),
pairs AS (
  SELECT y.s, x.s AS s0, any_value(x.n + y.n) AS nm, count(*) AS c FROM tok x JOIN tok y ON x.t = y.t AND x.pos < y.pos AND x.n >= 0.8 * y.n - 1e-9 AND y.n >= 0.8 * x.n - 1e-9 GROUP BY y.s, x.s),
gone AS (SELECT DISTINCT s FROM pairs WHERE c >= 0.8 * (nm - c) - 1e-9),
stay AS (SELECT pos FROM sets WHERE s NOT IN (SELECT s FROM gone)),
of AS (SELECT w.doc_id, w.line, len(w.words) = 0 OR stay.pos IS NOT NULL AS keep FROM w LEFT JOIN stay ON stay.pos = (w.doc_id, w.line))
SELECT d.doc_id, coalesce(n, 0) AS n_lines, coalesce(gone, 0) AS n_removed, coalesce(kept, '') AS kept FROM documents d LEFT JOIN (
  SELECT doc_id, count(*) AS n, count(*) FILTER (NOT keep) AS gone, string_agg(CAST(line AS VARCHAR), ',' ORDER BY line) FILTER (keep) AS kept FROM of GROUP BY doc_id) o ON o.doc_id = d.doc_id
"""
