"""Rule-based transliteration of Yiddish to Latin letters as one regular expression and one map."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Letters with marks first, then groups of letters, then single letters; what is in none of them is dropped.
MARKED_LETTERS = {
    "אַ": "a", "אָ": "o", "בֿ": "v", "בּ": "v", "וּ": "u",
    "כּ": "k", "פּ": "p", "פֿ": "f", "שׂ": "s", "תּ": "t",
}
GROUPS = {
    "וו": "v", "דזש": "dzh", "זש": "zh", "טש": "tsh",
    "וי": "oy", "יי": "ey", "ײַ": "ay",
}
LETTERS = {
    "א": "", "ב": "b", "ג": "g", "ד": "d", "ה": "h", "ו": "u", "ז": "z", "ח": "kh",
    "ט": "t", "י": "y", "כ": "kh", "ך": "kh", "ל": "i", "מ": "m", "ם": "m", "נ": "n",
    "ן": "n", "ס": "s", "ע": "e", "ף": "f", "צ": "ts", "ץ": "ts", "ק": "k", "ר": "r",
    "ש": "sh", "ת": "s", "פ": "", " ": " ", "(": "(", ")": ")", "-": "-", '"': '"', "{": "{", "}": "}", "ײ": "",
}
RULES = MARKED_LETTERS | GROUPS | LETTERS


def _pattern() -> str:
    quoted = ["\\" + k if k in '(){}-"' else k for k in RULES]
    return f"({'|'.join(quoted)})"


def transliterate(text: Column) -> Column:
    """The text letter by letter in Latin; null stays null."""
    table = F.create_map(*(F.lit(x) for kv in RULES.items() for x in kv))
    return F.array_join(F.transform(F.regexp_extract_all(text, F.lit(_pattern()), F.lit(1)), lambda t: F.element_at(table, t)), "")


def transliterate_parts(name_parts: Column) -> Column:
    """A JSON object text of name parts with its values transliterated and its keys as they are, without parsing it.

    Segments are parted by ', ' and pieces of a segment by ': '; odd pieces are transliterated. The first piece of a segment
    is followed by ': ', each later one by ', ' unless the segment is the last one.
    """
    segments = F.split(name_parts, ", ")
    last = F.size(segments) - 1

    def segment(s: Column, i: Column) -> Column:
        piece = lambda p, j: F.concat(F.when(j % 2 == 1, transliterate(p)).otherwise(p), F.when(j == 0, F.lit(": ")).when(i < last, F.lit(", ")).otherwise(F.lit("")))
        return F.array_join(F.transform(F.split(s, ": "), piece), "")

    return F.array_join(F.transform(segments, segment), "")


def transliterate_map(m: Column) -> Column:
    """A map of name parts with its values transliterated."""
    return F.transform_values(m, lambda _, v: transliterate(v))
