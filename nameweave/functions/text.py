"""Columns that clean and reshape titles and name parts."""

from __future__ import annotations

import unicodedata
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F



def _folding() -> dict[str, str]:
    """Latin letters up to U+024F with marks, and the ASCII letters that are left when Unicode takes them apart."""
    apart = {c: [x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x)] for c in map(chr, range(0xC0, 0x250))}
    return {c: x[0] for c, x in apart.items() if len(x) == 1 and x[0].isascii() and x[0].isalpha()}


#: Latin letters with marks and the ASCII letters that they fold to, position by position; then those that fold to two.
_FOLDING = _folding() | {"ø": "o", "Ø": "O", "ł": "l", "Ł": "L", "đ": "d", "Đ": "D"}
MARKED, PLAIN = "".join(_FOLDING), "".join(_FOLDING.values())
TWO_LETTERS = {"ß": "ss", "æ": "ae", "Æ": "AE", "œ": "oe", "Œ": "OE"}

# Letters of other scripts by the names that Unicode gives them, and what they fold to.
LETTER_NAMES = {
    "HEBREW": "alef: bet:b gimel:g dalet:d he:h vav:v zayin:z het:kh tet:t yod:y kaf:k lamed:l mem:m nun:n samekh:s ayin:` pe:p tsadi:ts qof:q resh:r shin:sh tav:t ligature-yiddish-double-vav:vv ligature-yiddish-vav-yod:vy ligature-yiddish-double-yod:yy",
    "ARABIC": "alef:a beh:b teh:t theh:th jeem:j hah:h khah:kh dal:d thal:dh reh:r zain:z seen:s sheen:sh sad:s dad:d tah:t zah:z ain:` ghain:gh feh:f qaf:q kaf:k lam:l meem:m noon:n heh:h waw:w yeh:y peh:p tcheh:ch jeh:zh gaf:g keheh:k hamza:'",
    "CYRILLIC": "a:a be:b ve:v ghe:g de:d ie:e zhe:zh ze:z i:i ka:k el:l em:m en:n o:o pe:p er:r es:s te:t u:u ef:f ha:kh tse:ts che:ch sha:sh shcha:shch hard-sign:' yeru:y soft-sign:' e:e yu:iu ya:ia",
    "GREEK": "alpha:a beta:b gamma:g delta:d epsilon:e zeta:z eta:e theta:th iota:i kappa:k lamda:l mu:m nu:n xi:x omicron:o pi:p rho:r sigma:s tau:t upsilon:u phi:ph chi:kh psi:ps omega:o",
}
#: Blocks of these scripts, as a pattern.
OTHER_SCRIPTS = "[\u0370-\u052F\u0590-\u06FF\u1F00-\u1FFF\uFB1D-\uFDFF\uFE70-\uFEFF]"


def _other_letters() -> dict[str, str]:
    """Each letter of these scripts, what is left when Unicode takes off its marks, and its name's value; points and marks fold to nothing."""
    values = {script: dict(x.split(":") for x in names.split()) for script, names in LETTER_NAMES.items()}
    out = {}
    for c in map(chr, [*range(0x370, 0x530), *range(0x590, 0x700), *range(0x1F00, 0x2000), *range(0xFB1D, 0xFE00), *range(0xFE70, 0xFF00)]):
        text = ""
        for x in unicodedata.normalize("NFKD", c):
            script, _, rest = unicodedata.name(x, "").partition(" ")
            name = rest.replace("CAPITAL ", "").replace("SMALL ", "").replace("FINAL ", "").removeprefix("LETTER ").lower().replace(" ", "-")
            if unicodedata.combining(x):
                continue
            if script not in values or (value := values[script].get(name)) is None:
                break
            text += value.capitalize() if x.isupper() else value
        else:
            if unicodedata.category(c)[0] in "LM":
                out[c] = text
    return out


OTHER_LETTERS = _other_letters()

PARTS = "map<string,string>"


def _folded_scripts(value: Column) -> Column:
    """Letters of OTHER_LETTERS by their values: those of two or more first become a character each that no text has, then all single ones in one pass."""
    long = sorted({v for v in OTHER_LETTERS.values() if len(v) > 1})
    stand_in = {v: chr(0xF8FF - i) for i, v in enumerate(long)}  # private use
    one = {c: stand_in.get(v, v) for c, v in OTHER_LETTERS.items() if v}
    gone = [c for c, v in OTHER_LETTERS.items() if not v]
    folded = F.translate(value, "".join([*one, *gone]), "".join(one.values()))
    return reduce(lambda x, v: F.replace(x, F.lit(stand_in[v]), F.lit(v)), long, folded)


def clean(value: Column) -> Column:
    """ASCII-folded, spaces and line ends made single spaces, stripped of white space and quotes, lower-cased; null if nothing is left."""
    raw = value.cast("string")
    two = reduce(lambda x, kv: F.replace(x, F.lit(kv[0]), F.lit(kv[1])), TWO_LETTERS.items(), F.translate(raw, MARKED, PLAIN))
    latin = F.octet_length(raw) == F.char_length(raw)  # pure ASCII needs no folding, and most other texts none of other scripts
    c = F.when(latin, raw).when(F.regexp_like(raw, F.lit(OTHER_SCRIPTS)), _folded_scripts(two)).otherwise(two)
    c = F.regexp_replace(c, "  +", " ")
    c = F.replace(c, F.lit("\n"), F.lit(" "))
    strip = lambda x: F.btrim(x, F.lit(" \t\n\x0b\f\r"))
    c = F.btrim(F.btrim(strip(c), F.lit('"')), F.lit("'"))
    return F.nullif(strip(F.lower(c)), F.lit(""))


def slashed_date(value: Column) -> Column:
    """A date string with slashes for hyphens."""
    return F.replace(value, F.lit("-"), F.lit("/"))


def parts(name_parts: Column) -> Column:
    """The map of name parts of a JSON object; null if it isn't one."""
    return F.from_json(name_parts, PARTS)


def repaired_json(name_parts: Column) -> Column:
    """A JSON object whose quotes were doubled twice on the way through CSV, with single ones; empty strings stay."""
    # fixed values: the three steps of the repair
    c = F.replace(name_parts, F.lit('""""'), F.lit('""#""'))
    c = F.replace(c, F.lit('""'), F.lit('"'))
    return F.replace(c, F.lit('"#"'), F.lit('""'))


def readable_json(name_parts: Column) -> Column:
    """name_parts as they are if they can be read, else repaired."""
    return F.when(parts(name_parts).isNotNull(), name_parts).otherwise(repaired_json(name_parts))


def parts_from_title(title: Column) -> Column:
    """A map name_part_i -> token of a title before its @, split at single spaces, empty tokens included."""
    tokens = F.split(F.element_at(F.split(title, "@"), 1), " ")
    keys = F.transform(tokens, lambda _, i: F.concat(F.lit("name_part_"), i.cast("string")))
    return F.map_from_arrays(keys, tokens)


def phonetic_parts(columns: dict[str, Column]) -> Column:
    """A JSON object of the columns named *_phoneme that aren't null."""
    chosen = [x for k, c in columns.items() if k.endswith("_phoneme") for x in (F.lit(k), c)]
    if not chosen:
        return F.lit("{}")
    return F.to_json(F.map_filter(F.create_map(*chosen), lambda _, v: v.isNotNull()))


def without_middle(name: Column) -> Column:
    """The name without the first parenthesis inside it, up to the next one; if there is none inside, without the brackets alone."""
    inside = r"(?s)^([^(]+)\([^()]*\)[^()]([^()]*).*$"
    return F.when(name.rlike(inside), F.regexp_replace(name, inside, "$1$2")).otherwise(F.translate(name, "()", ""))


def parts_text(m: Column, separator: str = ";") -> Column:
    """'key: value' of each part, joined."""
    return F.array_join(F.transform(F.map_entries(m), lambda e: F.concat(e["key"], F.lit(": "), e["value"])), separator)


def parts_braced(m: Column) -> Column:
    """'{key: value, ...}'; of an empty map only the closing brace."""
    return F.when(F.size(m) == 0, F.lit("}")).otherwise(F.concat(F.lit("{"), parts_text(m, ", "), F.lit("}")))


def parts_name(m: Column) -> Column:
    """The values, joined by spaces."""
    return F.array_join(F.map_values(m), " ")


def column_parts_text(columns: dict[str, Column], separator: str = ";") -> Column:
    """'label: value' of each column that isn't null; the label is its name without name_part_ before and _phoneme after it."""
    labelled = [F.concat(F.lit(k.removeprefix("name_part_").removesuffix("_phoneme") + ": "), c) for k, c in columns.items()]
    return F.concat_ws(separator, *labelled)


def comparison_prompt(left: Column, right: Column, pattern: int = 0, left_name: str = "first", right_name: str = "second") -> Column:
    """The user prompt for a pair of maps of name parts: 0 asks a question, 1 gives both maps, 2 both names."""
    if pattern == 0:
        head = f"Do these two names refer to the same person?\nName from the {left_name} dataset: "
        return F.concat(F.lit(head), parts_braced(left), F.lit(f"\nName from the {right_name} dataset: "), parts_braced(right))
    if pattern == 1:
        return F.concat(parts_braced(left), F.lit(" "), parts_braced(right))
    if pattern == 2:
        return F.concat(F.lit("First name: "), parts_name(left), F.lit(" Second name: "), parts_name(right))
    raise ValueError(f"no pattern {pattern}")


def utf8_length(c: Column) -> Column:
    return F.octet_length(c)


def response_text(line: Column) -> Column:
    """The message content of a response line."""
    return F.get_json_object(line, "$.response.body.choices[0].message.content")
