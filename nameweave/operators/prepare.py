"""Preparing record tables: provenance, name-part columns, language filter, and phonetic or transliterated variants."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nameweave.functions import text, translit
from nameweave.operators.numbering import numbered
from nameweave.sources import writers

# Columns that aren't used to compare records.
EXCLUDED = ("", "start", "id", "geo_id", "geowkt", "geo_source", "title_source", "description", "lat", "lon")
#: Name parts that a table can get columns for.
MOST_KEYS = 1000


def union_sources(sources: Sequence[DataFrame]) -> DataFrame:
    """All rows with data_source, the ordinal of the source; columns that one lacks are null there."""
    numbered = [df.withColumn("data_source", F.lit(i)) for i, df in enumerate(sources)]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), numbered)


def rejected(records: DataFrame) -> DataFrame:
    """Rows whose name_parts are no JSON object, repaired or not."""
    return records.where(text.parts(text.readable_json(F.col("name_parts"))).isNull())


def accepted(records: DataFrame) -> DataFrame:
    """The other rows, with name_parts repaired where that was needed."""
    return records.withColumn("name_parts", text.readable_json(F.col("name_parts"))).where(text.parts(F.col("name_parts")).isNotNull())


def part_keys(records: DataFrame) -> DataFrame:
    """(key): all distinct name-part keys."""
    return records.select(F.explode(F.map_keys(text.parts(F.col("name_parts")))).alias("key")).distinct()


def with_part_columns(records: DataFrame, keys: Sequence[str] | None = None) -> DataFrame:
    """One column for each name-part key, null where a record lacks it. Without keys they are read from the data first, MOST_KEYS at most."""
    if keys is None:
        keys = sorted(r.key for r in part_keys(records).limit(MOST_KEYS + 1).collect())
        if len(keys) > MOST_KEYS:
            raise ValueError(f"more than {MOST_KEYS} different name parts")
    m = text.parts(F.col("name_parts"))
    return records.select("*", *(m[k].alias(k) for k in keys if k not in records.columns))


def prepared(sources: Sequence[DataFrame], excluded: Sequence[str] = EXCLUDED, dates: Sequence[str] = ("birth_date", "death_date")) -> DataFrame:
    """Sources united, unreadable name parts rejected, part columns added, dates slashed, all compared columns cleaned, other columns dropped."""
    rows = with_part_columns(accepted(union_sources(sources)))
    kept = [c for c in rows.columns if c not in (*excluded, "data_source", "name_parts")]
    cleaned = [text.clean(text.slashed_date(F.col(c)) if c in dates else F.col(c)).alias(c) for c in kept]
    return rows.select("data_source", *cleaned)


def of_language(records: DataFrame, lang: str, order: Sequence[str] = ()) -> DataFrame:
    """Records of a language, the first one of each id, with title@lang (yid for yi) and without lang.

    The first is that by the columns in order, or without any the one that was read first.
    """
    records = records.withColumn("__at", F.monotonically_increasing_id())
    first = Window.partitionBy("id").orderBy(*order, "__at")
    suffix = F.when(F.col("lang") == "yi", F.lit("@yid")).otherwise(F.concat(F.lit("@"), F.col("lang")))
    rows = records.where(F.col("lang") == lang).withColumn("__r", F.row_number().over(first)).where("__r = 1").drop("__r", "__at")
    return rows.withColumn("title", F.concat("title", suffix)).drop("lang")


def born_in(records: DataFrame, years: Sequence[str] = ("1725", "1726", "1728"), column: str = "birth") -> DataFrame:
    """Records whose date begins with one of the years, numbered anew by rec_id; the old number stays as index."""
    starts = reduce(lambda a, b: a | b, (F.col(column).startswith(y) for y in years))
    return numbered(records.where(starts).withColumnRenamed("rec_id", "index"), ["index"], "rec_id")


def transliterated(records: DataFrame) -> DataFrame:
    """Title and name_parts in Latin letters, id without temp_."""
    return records.withColumns({"id": F.replace("id", F.lit("temp_"), F.lit("")), "title": translit.transliterate(F.col("title")), "name_parts": translit.transliterate_parts(F.col("name_parts"))})


def transliterated_by(records: DataFrame, word: Callable[[Column], Column]) -> DataFrame:
    """Title and part values through any column function; unreadable name parts become null in their own row."""
    return records.withColumns({"title": word(F.col("title")), "name_parts": F.to_json(F.transform_values(text.parts(F.col("name_parts")), lambda _, v: word(v)))})


def phonetic_words(records: DataFrame, word: Callable[[Column], Column], lang: str = "yid", columns: Sequence[str] = ("id", "title", "lang", "phoneme", "personAltLabel", "personDescription", "birth", "death", "age")) -> DataFrame:
    """lang, and phoneme made word by word of the title before its @; of the listed columns those that exist."""
    words = F.split(F.btrim(F.element_at(F.split("title", "@"), 1)), r"\s+")
    rows = records.withColumns({"lang": F.lit(lang), "phoneme": F.array_join(F.transform(words, word), " ")})
    return rows.select(*(c for c in columns if c in rows.columns))


def through_service(records: DataFrame, send: Callable[[pd.DataFrame], pd.DataFrame | None], sent: Sequence[str], schema: str, batch: int = 1000, tries: int = 3) -> DataFrame:
    """records with what a service returns for them, joined by id.

    send gets the columns `sent` of at most batch rows and returns rows with an id. It may raise OverflowError for a request
    that is too large, which is halved; after `tries` other failures its rows have no result. Records without id are left out.
    """
    if "title" not in records.columns:
        raise ValueError("title is missing")
    known = records.where("id is not null")

    def ask(df: pd.DataFrame) -> Iterator[pd.DataFrame]:
        for _ in range(tries):
            try:
                if (got := send(df)) is not None:
                    yield got
                    return
            except OverflowError:
                if len(df) > 1:
                    yield from ask(df.iloc[: len(df) // 2])
                    yield from ask(df.iloc[len(df) // 2 :])
                return
            except OSError:
                continue

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            for i in range(0, len(df), batch):
                yield from ask(df.iloc[i : i + batch])

    results = known.select("id", *(c for c in sent if c != "id")).mapInPandas(run, schema)
    rest = [c for c in known.columns if c == "id" or c not in results.columns]
    return results.join(known.select(*rest), "id", "left")


def phonetic_table(records: DataFrame, name: str, path: str, word: Callable[[Column], Column], send: Callable[[pd.DataFrame], pd.DataFrame | None], sent: Sequence[str], schema: str, by_word: Sequence[str] = ("wikiData_yid",)) -> DataFrame:
    """Writes the phonetic form of a source as CSV: word by word for sources named in by_word, else by the service."""
    made = phonetic_words(records, word) if name in by_word else through_service(records, send, sent, schema)
    writers.delimited(made, path)
    return made
