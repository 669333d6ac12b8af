"""Transliterated titles and name parts against known results."""

from pyspark.sql import functions as F

from nameweave.functions import translit

# Titles, and JSON texts of name parts, with their Latin forms.
# fmt: off
TITLES = [
    ('וויליאַם עדלין', 'vyiyam ediyn'),
    ('זיגמונד עהרליך', 'zygmund ehriykh'),
    ('מענדל עלקין', 'mendi eikyn'),
    ('ענדען (?)', 'enden ()'),
    ('אַלטער עפּשטיין', 'aiter epshteyn'),
    ('זשעניע עפּשטיין', 'zhenye epshteyn'),
    ('פעני וואַדיאַ עפּשטיין', 'eny vadya epshteyn'),
    ('טאַניאַ פּאָלאַנד', 'tanya poiand'),
    ('ריטאַ פּאָלאַנסקי', 'ryta poiansky'),
    ('שימען פּאָסיאַס', 'shymen posyas'),
    ('מישאַ פּאַשקאָווסקי', 'mysha pashkovsky'),
    ('סאַול פּויזנער', 'saui poyzner'),
    ('אליהו פּילניק', 'iyhu pyinyk'),
    ('מאלי פּיקאָן', 'miy pykon'),
    ('מאַקס פּערלמאַן', 'maks periman'),
    ('היימי פּריזאַנט', 'heymy pryzant'),
    ('מיכאל פּרייס', 'mykhi preys'),
    ('פויסטילניק', 'oystyinyk'),
    ('פידעלמאַן', 'ydeiman'),
    ('זיגמונד פיינמאַן', 'zygmund eynman'),
    ('לילי פיינמאַן', 'iyiy eynman'),
    ('יוסף פישמאַן', 'yusf yshman'),
    ('סילוויאַ פישמאַן', 'syivya yshman'),
    ('לאה פלוים', 'ih ioym'),
    ('הערי פעלד', 'hery eid'),
    ('אַדאָלף פעניגשטיין', 'adoif enygshteyn'),
    ('לאַזאַר פריד', 'iazar ryd'),
    ('יצחק פרידמאַן', 'ytskhk rydman'),
    ('מיכל פרידמאַן', 'mykhi rydman'),
    ('בעלאַ פרענק', 'beia renk'),
    ('לאה צימלין', 'ih tsymiyn'),
    ('פאַניאַ ציפּקינא', 'anya tsypkyn'),
    ('מאטל קאן', 'mti kn'),
    ('אַניע קאַפּוסטין', 'anye kapustyn'),
    ('זעלדע קאַפּלאַן', 'zeide kapian'),
    ('קאַץ', 'kats'),
    ('בן-ציון קאַץ', 'bn-tsyun kats'),
    ('סאָניאַ קוסטין', 'sonya kustyn'),
    ('בן-ציון קיט', 'bn-tsyun kyt'),
    ('נעלי קעסמאַן', 'neiy kesman'),
    ('נאַדיע ראדין', 'nadye rdyn'),
    ('שאול ראַסקין', 'shui raskyn'),
    ('מישאַ ראַפּעל', 'mysha rapei'),
    ('צבי-הירש רובינשטיין', 'tsby-hyrsh rubynshteyn'),
    ('רייכמאַן', 'reykhman'),
    ('רינסלער', 'rynsier'),
    ('לייבּ שאוס', 'ieyv shus'),
    ('גיטל שטיין', 'gyti shteyn'),
    ('סאַמי שטערבאַך', 'samy shterbakh'),
    ('מאַקס שטרענג', 'maks shtreng'),
    ('יאַקאָב שעכטמאַן', 'yakob shekhtman'),
]
PARTS = [
    ('{"primary-name": "עדלין", "given-name": "וויליאַם"}', '{"primary-name": "ediyn", "given-name": "vyiyam"}'),
    ('{"given-name": "זיגמונד", "surname": "אהרליך"}', '{"given-name": "zygmund", "surname": "hriykh"}'),
    ('{"given-name": "מענדל", "surname": "עלקין"}', '{"given-name": "mendi", "surname": "eikyn"}'),
    ('{"primary-name": "ענדען"}', '{"primary-name": "enden"}'),
    ('{"primary-name": "אַלטער עפּשטיין", "given-name": "אַלטער", "surname": "עפּשטיין"}', '{"primary-name": "aiter epshteyn", "given-name": "aiter", "surname": "epshteyn"}'),
    ('{"given-name": "זשעניע", "surname": "עפּשטיין"}', '{"given-name": "zhenye", "surname": "epshteyn"}'),
    ('{"given-name": "פעני", "surname": "עפשטיין"}', '{"given-name": "eny", "surname": "eshteyn"}'),
    ('{"given-name": "טאַניאַ", "surname": "פּאָלאַנד"}', '{"given-name": "tanya", "surname": "poiand"}'),
    ('{"given-name": "ריטאַ", "surname": "פּאָלאַנסקי"}', '{"given-name": "ryta", "surname": "poiansky"}'),
    ('{"given-name": "שימען", "surname": "פּאָסיאַס"}', '{"given-name": "shymen", "surname": "posyas"}'),
    ('{"primary-name": "פּאַשקאָווסקי", "given-name": "מישאַ", "surname": "פּאַשקאָווסקי"}', '{"primary-name": "pashkovsky", "given-name": "mysha", "surname": "pashkovsky"}'),
    ('{"given-name": "סאַול", "surname": "פּויזנער"}', '{"given-name": "saui", "surname": "poyzner"}'),
    ('{"given-name": "אליהו", "surname": "פּילניק"}', '{"given-name": "iyhu", "surname": "pyinyk"}'),
    ('{"primary-name": "מאלי פּיקאָן", "given-name": "מאלי", "surname": "פיקאָן"}', '{"primary-name": "miy pykon", "given-name": "miy", "surname": "ykon"}'),
    ('{"given-name": "מאַקס", "surname": "פּערלמאַן"}', '{"given-name": "maks", "surname": "periman"}'),
    ('{"primary-name": "היימי פּריזאַנט", "given-name": "היימי", "surname": "פּריזאַנט"}', '{"primary-name": "heymy pryzant", "given-name": "heymy", "surname": "pryzant"}'),
    ('{"given-name": "מיכאל", "surname": "פּרייס"}', '{"given-name": "mykhi", "surname": "preys"}'),
    ('{"surname": "פויסטילניק"}', '{"surname": "oystyinyk"}'),
    ('{"surname": "פידעלמאַן"}', '{"surname": "ydeiman"}'),
    ('{"given-name": "זיגמונד", "surname": "פיינמאַן"}', '{"given-name": "zygmund", "surname": "eynman"}'),
    ('{"given-name": "לילי", "surname": "פיינמאַן"}', '{"given-name": "iyiy", "surname": "eynman"}'),
    ('{"given-name": "יוסף", "surname": "פישמאַן"}', '{"given-name": "yusf", "surname": "yshman"}'),
    ('{"primary-name": "סילוויאַ פישמאַן", "given-name": "סילוויאַ", "surname": "פישמאַן"}', '{"primary-name": "syivya yshman", "given-name": "syivya", "surname": "yshman"}'),
    ('{"given-name": "לאה", "surname": "פלוים"}', '{"given-name": "ih", "surname": "ioym"}'),
    ('{"primary-name": "הערי פעלד", "given-name": "הערי", "surname": "פעלד"}', '{"primary-name": "hery eid", "given-name": "hery", "surname": "eid"}'),
    ('{"given-name": "אַדאָלף", "surname": "פעניגשטיין"}', '{"given-name": "adoif", "surname": "enygshteyn"}'),
    ('{"given-name": "לאַזאַר", "surname": "פריד"}', '{"given-name": "iazar", "surname": "ryd"}'),
    ('{"given-name": "יצחק", "surname": "פרידמאַן"}', '{"given-name": "ytskhk", "surname": "rydman"}'),
    ('{"given-name": "מיכל", "surname": "פרידמאַן"}', '{"given-name": "mykhi", "surname": "rydman"}'),
    ('{"primary-name": "בעלאַ פרענק", "given-name": "בעלאַ", "surname": "פרענק"}', '{"primary-name": "beia renk", "given-name": "beia", "surname": "renk"}'),
    ('{"given-name": "לאה", "surname": "צימלין"}', '{"given-name": "ih", "surname": "tsymiyn"}'),
    ('{"given-name": "פאַניאַ", "surname": "ציפּקינא"}', '{"given-name": "anya", "surname": "tsypkyn"}'),
    ('{"primary-name": "מאטל קאן", "given-name": "מאטל", "surname": "קאן"}', '{"primary-name": "mti kn", "given-name": "mti", "surname": "kn"}'),
    ('{"given-name": "אַניע", "surname": "קאַפּוסטין"}', '{"given-name": "anye", "surname": "kapustyn"}'),
    ('{"given-name": "זעלדע", "surname": "קאַפּלאַן"}', '{"given-name": "zeide", "surname": "kapian"}'),
    ('{"primary-name": "קאַץ"}', '{"primary-name": "kats"}'),
    ('{"given-name": "בן-ציון", "surname": "קאַץ"}', '{"given-name": "bn-tsyun", "surname": "kats"}'),
    ('{"given-name": "סאָניאַ", "surname": "קוסטין"}', '{"given-name": "sonya", "surname": "kustyn"}'),
    ('{"given-name": "ציון", "surname": "קיט", "patronymic": "בן"}', '{"given-name": "tsyun", "surname": "kyt", "patronymic": "bn"}'),
    ('{"primary-name": "נעלי קעסמאַן", "surname": "קעסמאַן"}', '{"primary-name": "neiy kesman", "surname": "kesman"}'),
    ('{"given-name": "נאַדיע", "surname": "ראדין"}', '{"given-name": "nadye", "surname": "rdyn"}'),
    ('{"given-name": "שאול", "surname": "ראַסקין"}', '{"given-name": "shui", "surname": "raskyn"}'),
    ('{"primary-name": "מישאַ ראַפּעל", "given-name": "מישאַ", "surname": "ראַפּעל"}', '{"primary-name": "mysha rapei", "given-name": "mysha", "surname": "rapei"}'),
    ('{"primary-name": "צבי-הירש", "surname": "רובינשטיין"}', '{"primary-name": "tsby-hyrsh", "surname": "rubynshteyn"}'),
    ('{"surname": "רייכמאַן"}', '{"surname": "reykhman"}'),
    ('{"primary-name": "רינסלער"}', '{"primary-name": "rynsier"}'),
    ('{"primary-name": "שאוס", "given-name": "לייבּ", "surname": "שאוס"}', '{"primary-name": "shus", "given-name": "ieyv", "surname": "shus"}'),
    ('{"given-name": "גיטל", "surname": "שטיין"}', '{"given-name": "gyti", "surname": "shteyn"}'),
    ('{"given-name": "סאַמי", "surname": "שטערבאַך"}', '{"given-name": "samy", "surname": "shterbakh"}'),
    ('{"given-name": "מאַקס", "surname": "שטרענג"}', '{"given-name": "maks", "surname": "shtreng"}'),
    ('{"given-name": "יאַקאָב", "surname": "שעכטמאַן"}', '{"given-name": "yakob", "surname": "shekhtman"}'),
]
# fmt: on


def test_titles(spark):
    rows = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(TITLES)], "i int, a string, want string")
    assert [(r.i, r.got) for r in rows.select("i", "want", translit.transliterate(F.col("a")).alias("got")).where("got <> want").collect()] == []


def test_name_parts(spark):
    rows = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(PARTS)], "i int, a string, want string")
    assert [(r.i, r.got) for r in rows.select("i", "want", translit.transliterate_parts(F.col("a")).alias("got")).where("got <> want").collect()] == []
