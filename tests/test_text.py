import json

from pyspark.sql import functions as F

from nameweave.functions import text, translit


def one(spark, column, **values):
    schema = ", ".join(f"{k} string" for k in values)
    return spark.createDataFrame([tuple(values.values())], schema).select(column.alias("x")).first().x


def test_clean(spark):
    for value, want in [('  "Ébène"\n x ', 'ebene"  x'), ("''", None), ("", None), (None, None), ("a   b", "a b"), ("\t'A'\t", "a")]:
        assert one(spark, text.clean(F.col("c")), c=value) == want


# Words of other scripts and what they fold to.
WORDS = {
    "שלום": "shlvm", "ירושלים": "yrvshlym", "שָׁלוֹם": "shlvm", "אבּא Abba": "b abba", "פּעטער": "p`t`r", "װאַרשע": "vvrsh`",
    "محمد": "mhmd", "خالد": "khald", "بَيت": "byt", "ﻣﺤﻤﺪ": "mhmd",
    "Достоевский": "dostoevskii", "Щукин": "shchukin", "Ёлка": "elka", "Чайковский, П. И.": "chaikovskii, p. i.",
    "Ελλάδα": "ellada", "Ψυχή": "psukhe", "ΘΕΟΣ": "theos",
    "Łódź שלום": "lodz shlvm", "日本": "日本",
}


def test_clean_folds_other_scripts(spark):
    df = spark.createDataFrame(list(WORDS.items()), "word string, want string")
    got = {r.word: r.x for r in df.select("word", text.clean(F.col("word")).alias("x")).collect()}
    assert got == WORDS
    assert len(text.OTHER_LETTERS) > 800 and all(v.isascii() for v in text.OTHER_LETTERS.values())


def test_parts(spark):
    assert one(spark, text.parts(F.col("c")), c='{"a": "x", "b": ""}') == {"a": "x", "b": ""}
    assert one(spark, text.parts(F.col("c")), c="{}") == {}
    assert one(spark, text.parts(F.col("c")), c='{"a": ') is None
    assert one(spark, text.parts(F.col("c")), c=None) is None
    assert json.loads(one(spark, text.repaired_json(F.col("c")), c='{""a"": """"}')) == {"a": ""}


def test_parts_from_title_keeps_empty_tokens(spark):
    assert one(spark, text.parts_from_title(F.col("c")), c="a  b@yid") == {"name_part_0": "a", "name_part_1": "", "name_part_2": "b"}


def test_without_middle(spark):
    cases = {"Ann (Mary) Lee": "Ann Lee", "(Ann) Lee": "Ann Lee", "Ann Lee": "Ann Lee", "Ann (x) Lee (y) Z": "Ann Lee ", "Ann (x)": "Ann x"}
    for name, want in cases.items():
        assert one(spark, text.without_middle(F.col("c")), c=name) == want


def test_joined_parts(spark):
    m = text.parts(F.col("c"))
    assert one(spark, text.parts_braced(m), c='{"a": "x", "b": "y"}') == "{a: x, b: y}"
    assert one(spark, text.parts_braced(m), c="{}") == "}"
    assert one(spark, text.parts_text(m), c='{"a": "x", "b": "y"}') == "a: x;b: y"
    assert one(spark, text.comparison_prompt(m, m, 2), c='{"a": "x", "b": "y"}') == "First name: x y Second name: x y"
    c = text.column_parts_text({"name_part_0_phoneme": F.col("a"), "name_part_1": F.col("b")})
    assert one(spark, c, a=None, b="q") == "1: q"
    p = text.phonetic_parts({"x_phoneme": F.col("a"), "y_phoneme": F.col("b"), "z": F.col("b")})
    assert one(spark, p, a=None, b="q") == '{"y_phoneme":"q"}'


def test_transliteration(spark):
    for value, want in [
        ("פעני וואַדיאַ עפּשטיין", "eny vadya epshteyn"),
        ("ענדען (?)", "enden ()"),
        ("אַּבבּדול", "abvdui"),
        ("abc", ""),
        ("", ""),
    ]:
        assert one(spark, translit.transliterate(F.col("c")), c=value) == want
    letters = {**translit.MARKED_LETTERS, **translit.GROUPS, **translit.LETTERS}
    rows = spark.createDataFrame(list(letters.items()), "a string, b string")
    assert rows.where(translit.transliterate(F.col("a")) != F.col("b")).count() == 0


def test_transliterated_parts(spark):
    got = one(spark, translit.transliterate_parts(F.col("c")), c='{"surname": "עפּשטיין", "given-name": "פעני"}')
    assert got == '{"surname": "epshteyn", "given-name": "eny"}'
