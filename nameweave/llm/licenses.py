"""License scans: an exact set-similarity join of text blocks with license templates.

A template is the set of the n distinct words of a short text of m words. A block is a stretch of m words that begins with a word of the
template (fewer at a text's end). A block meets the template if at least need = ceil(least * n) of the n words are in it. Templates are few, a
stated list that is part of the code or of the call; the texts they are joined with are all documents.

One scan of the texts gives, for each document, its number of words and the places of words that stand in any template, in
parts of PART places; texts aren't read again. The rest are joins on this table. Template words are ordered by how often they stand in all documents, rarest first.
Prefix filter: a block that meets a template holds one of its n - need + 1 rarest words, so only those are joined. Length
filter: the document has at least `need` words. Positional filter: a place of the word that is i-th in the order stands for blocks that hold no rarer
one, so among the words less than m places away there must be at least `need` different ones from the i-th on. What is left is verified: for
each block around the place, the words from the i-th on are counted, and the largest count over its places is exact.

A phrase is a template of which all words must be there in their order; it is found by the same join, and then compared word by word.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nameweave.llm.columns import in_batches, ordinal, text_key
from nameweave.scratch import Table, small


class Template(NamedTuple):
    label: str
    text: str
    least: float = 0.8
    phrase: bool = False


# The phrases, and the opening words of licenses and the notices that name them.
PHRASES = (
    Template("mit", "mit license", 1.0, True),
    Template("apache", "apache license", 1.0, True),
    Template("gpl", "general public license", 1.0, True),
)
NOTICES = (
    Template("apache-2.0-notice", "Licensed under the Apache License, Version 2.0"),
    Template("apache-2.0-text", "you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    Template("bsd-text", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    Template("cc-by-nc-4.0-notice", "Licensed under CC BY-NC 4.0"),
    Template("gpl-3.0-notice", "licensed under the GNU General Public License, version 3"),
    Template("gpl-text", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    Template("mit-notice", "Released under the MIT License"),
    Template("mit-text", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction"),
)
TEMPLATES = PHRASES + NOTICES

#: A-Z lower-cased, and a space for every ASCII character but letters and digits; other characters are parts of words.
_PLAIN = bytes(i + 32 if 65 <= i <= 90 else i if i >= 128 or 48 <= i <= 57 or 97 <= i <= 122 else 32 for i in range(256))
_PLACED = "doc {doc}, key long, part int, n_words long, own_from int, own_to int, hits array<struct<at:int,t:int>>"
#: Hits of a text that make a row.
PART = 128


def words_of(text: str) -> list[bytes]:
    return text.encode().translate(_PLAIN).split()


def placed(docs: DataFrame, vocabulary: Sequence[bytes], span: int) -> DataFrame:
    """(doc, key, part, n_words, own_from, own_to, hits): hits are the places of the vocabulary's words in each row of docs, with their numbers.

    A row of docs gives a row for each PART hits, and part 0 in any case. Those from own_from to own_to are the part's own;
    before and after them stand those of the neighbours that are less than `span` hits away, so a part is looked at by itself, and no row is long.
    """
    number = {w: i for i, w in enumerate(vocabulary)}

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, offsets, at, which = [], [0], [], []
            for d, text in enumerate(batch.column(2)):
                words = (text.as_py() or b"").translate(_PLAIN).split()
                mine = [i for i, w in enumerate(words) if w in number]
                for part, begin in enumerate(range(0, max(1, len(mine)), PART)):
                    first, end = max(0, begin - span + 1), min(len(mine), begin + PART)
                    some = mine[first : end + span - 1]
                    rows.append((d, part, len(words), begin - first, end - first))
                    at += some
                    which += [number[words[i]] for i in some]
                    offsets.append(len(at))
            d, *rest = (list(c) for c in zip(*rows, strict=True)) if rows else ([],) * 5
            pairs = pa.StructArray.from_arrays([pa.array(at, pa.int32()), pa.array(which, pa.int32())], names=["at", "t"])
            hits = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pairs)
            part, n, own_from, own_to = (pa.array(c, k) for c, k in zip(rest, (pa.int32(), pa.int64(), pa.int32(), pa.int32()), strict=True))
            of = pa.array(d, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(of), batch.column(1).take(of), part, n, own_from, own_to, hits], names=["doc", "key", "part", "n_words", "own_from", "own_to", "hits"])

    rows = in_batches(docs).select(ordinal(docs).alias("doc"), text_key().alias("key"), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(scan, _PLACED.format(doc=rows.schema["doc"].dataType.simpleString()))


def _own(hits: Column) -> Column:
    return F.slice(hits, F.col("own_from") + 1, F.col("own_to") - F.col("own_from"))


def _ordered(rows: DataFrame, templates: Sequence[Template], number: dict[bytes, int]) -> tuple[DataFrame, list[int]]:
    """(template, m, n, need, phrase, sequence, order): each template's words as numbers, as they stand and by their rarity in rows; and all words of prefixes.

    The counts that come to the driver are one for each word of the templates at most.
    """
    f = {r.t: r.f for r in rows.select(F.explode(_own(F.col("hits"))["t"]).alias("t")).groupBy("t").agg(F.count("*").alias("f")).collect()}
    made, rare = [], set()
    for k, t in enumerate(templates):
        sequence = [number[w] for w in words_of(t.text)]
        order = sorted({*sequence}, key=lambda x: (f.get(x, 0), x))
        need = max(1, math.ceil(t.least * len(order) - 1e-9))
        made.append((k, len(sequence), len(order), need, t.phrase, sequence, order))
        rare.update(order[: len(order) - need + 1])
    schema = "template int, m int, n int, need int, phrase boolean, sequence array<int>, order array<int>"
    return rows.sparkSession.createDataFrame(made, schema), sorted(rare)


def _blocks(rows: DataFrame, ordered: DataFrame, rare: list[int]) -> DataFrame:
    """(doc, key, template, start, shared): the blocks of rows (as placed gives them) that meet a template."""
    prefix = ordered.select("*", F.posexplode(F.slice("order", 1, F.col("n") - F.col("need") + 1)).alias("place", "t"))
    prefix = prefix.select("t", "template", "m", "n", "need", "phrase", "sequence", F.slice("order", F.col("place") + 1, F.col("n")).alias("later"))
    # only the places of prefix words become rows, each with its part's hits
    own = F.transform(_own(F.col("hits")), lambda x, i: F.struct((i + F.col("own_from")).alias("k"), x.alias("hit")))
    some = F.filter(own, lambda x: F.array_contains(F.lit(rare or [-1]), x["hit"]["t"]))
    each = rows.select("doc", "key", "n_words", "hits", F.explode(some).alias("own")).select("doc", "key", "n_words", "hits", "own.k", "own.hit")
    met = each.withColumn("t", F.col("hit.t")).join(small(prefix), "t").where(F.col("n_words") >= F.col("need"))
    # places rise, so hits less than m places away are less than m elements away
    first = F.greatest(F.col("k") - F.col("m") + 1, F.lit(0))
    near = F.filter(F.slice("hits", first + 1, F.col("k") - first + F.col("m")), lambda x: (F.abs(x["at"] - F.col("hit.at")) < F.col("m")) & F.array_contains("sequence", x["t"]))
    met = met.select("doc", "key", "template", "m", "need", "phrase", "sequence", "later", F.col("hit.at").alias("at"), near.alias("near"))
    met = met.where(F.size(F.array_intersect(F.col("near.t"), F.col("later"))) >= F.col("need"))
    starts = met.select("*", F.explode("near.at").alias("start")).where((F.col("start") <= F.col("at")) & (F.col("start") + F.col("m") > F.col("at")))
    within = F.filter("near", lambda x: (x["at"] >= F.col("start")) & (x["at"] < F.col("start") + F.col("m")))
    blocks = starts.select("doc", "key", "template", "need", "phrase", "sequence", "start", "later", within.alias("block"))
    shared = F.size(F.array_intersect(F.col("block.t"), F.col("later")))
    blocks = blocks.where(~F.col("phrase") | (F.col("block.t") == F.col("sequence"))).withColumn("shared", shared).where(F.col("shared") >= F.col("need"))
    return blocks.groupBy("doc", "key", "template", "start").agg(F.max("shared").alias("shared"))


def _scanned(docs: DataFrame, templates: Sequence[Template]) -> tuple[DataFrame, DataFrame]:
    """The rows of docs as placed, and (doc, key, template, start, length, score) of all blocks that meet a template."""
    vocabulary = sorted({w for t in templates for w in words_of(t.text)})
    number = {w: i for i, w in enumerate(vocabulary)}
    span = max((len(words_of(t.text)) for t in templates), default=1)
    rows = Table(placed(docs, vocabulary, span), "placed_words").df
    ordered, rare = _ordered(rows, templates, number)
    found = _blocks(rows, ordered, rare).join(small(ordered.select("template", "n", "m", "phrase")), "template")
    return rows, found.select("doc", "key", "template", "phrase", F.col("start").cast("long").alias("start"), F.col("m").alias("length"), (F.col("shared") / F.col("n")).alias("score"))


def license_blocks(docs: DataFrame, templates: Sequence[Template] = TEMPLATES) -> DataFrame:
    """(doc_id, text_key, label, start, length, score) of every block of every document that meets a template; rows equal in doc_id and text count once."""
    _, found = _scanned(docs, templates)
    labels = docs.sparkSession.createDataFrame([(k, t.label) for k, t in enumerate(templates)], "template int, label string")
    ids = docs.select("doc_id", ordinal(docs).alias("doc"), text_key().alias("key")).distinct()
    return found.join(small(labels), "template").join(ids, ["doc", "key"]).select("doc_id", F.col("key").alias("text_key"), "label", "start", "length", "score")


def license_labels(docs: DataFrame, templates: Sequence[Template] = TEMPLATES) -> DataFrame:
    """One row for each row of docs: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, n_blocks.

    Base are the phrases among the templates: n_base counts all their places, first_word and last_word are the smallest and largest, null
    without any. labels has those of all templates met, score the largest share of a template's words in a block (0.0 without blocks), n_blocks
    the number of blocks. Null and empty texts have no words, long ones are scanned whole. Rows that repeat doc_id and text get equal rows, rows that
    share a doc_id or have none are apart by their texts. An empty table gives no rows; other columns aren't read.
    """
    rows, found = _scanned(docs, templates)
    labels = docs.sparkSession.createDataFrame([(k, t.label) for k, t in enumerate(templates)], "template int, label string")
    base = lambda c: F.when(F.col("phrase"), F.col(c))
    listed = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    told = found.join(small(labels), "template").groupBy("doc", "key").agg(
        F.count(base("start")).alias("n_base"), F.min(base("start")).alias("first_word"), F.max(base("start")).alias("last_word"),
        listed(base("label")).alias("base_labels"), listed(F.col("label")).alias("labels"), F.max("score").alias("score"), F.count("*").alias("n_blocks"),
    )
    told = Table(told, "license_labels").df
    own = rows.where("part = 0").select("doc", "key", "n_words").join(small(told), ["doc", "key"], "left")
    # ordinal() puts the least long, or nothing, in place of a null doc_id
    kind = docs.schema["doc_id"].dataType
    doc_id = F.when(F.col("doc") != "", F.substring("doc", 2, 1 << 30)) if rows.schema["doc"].dataType.typeName() == "string" else F.when(F.col("doc") != -(1 << 63), F.col("doc"))
    zero = F.lit(0).cast("long")
    return own.select(
        doc_id.cast(kind).alias("doc_id"), "n_words", F.coalesce("n_base", zero).alias("n_base"), "first_word", "last_word",
        F.coalesce("base_labels", F.lit("")).alias("base_labels"), F.coalesce("labels", F.lit("")).alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"), F.coalesce("n_blocks", zero).alias("n_blocks"),
    )


_ROWS = ", ".join(f"({k}, '{t.label}', {len(words_of(t.text))}, {len(set(words_of(t.text)))}, {max(1, math.ceil(t.least * len(set(words_of(t.text))) - 1e-9))}, {t.phrase}, '{b' '.join(words_of(t.text)).decode()}')" for k, t in enumerate(TEMPLATES))
ORACLE = rf"""
WITH t AS (SELECT * FROM (VALUES {_ROWS}) v(k, label, m, n, need, phrase, seq)),
d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
q AS (SELECT doc_id, generate_subscripts(w, 1) - 1 AS i, unnest(w) AS word FROM d),
tok AS (SELECT DISTINCT k, m, unnest(string_split(seq, ' ')) AS word FROM t),
hits AS (SELECT doc_id, k, m, i, q.word FROM q JOIN tok ON tok.word = q.word),
blocks AS (SELECT a.doc_id, a.k, a.i AS start, count(DISTINCT b.word) AS shared, string_agg(b.word, ' ' ORDER BY b.i) AS own FROM hits a JOIN hits b ON b.doc_id = a.doc_id AND b.k = a.k AND b.i >= a.i AND b.i < a.i + a.m GROUP BY ALL),
f AS (SELECT doc_id, label, start, phrase, shared / n AS score FROM blocks JOIN t USING (k) WHERE shared >= need AND (NOT phrase OR own = seq)),
g AS (
  SELECT doc_id, count(*) FILTER (phrase) AS n_base, min(start) FILTER (phrase) AS first_word, max(start) FILTER (phrase) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) FILTER (phrase) AS base_labels,
    string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(score) AS score, count(*) AS n_blocks FROM f GROUP BY doc_id)
SELECT d.doc_id, len(w) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0) AS score, coalesce(n_blocks, 0) AS n_blocks
FROM d LEFT JOIN g ON g.doc_id = d.doc_id
"""
