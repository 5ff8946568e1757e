"""Place candidates, inflected forms and lookups against rows written by hand."""

import pytest
from pyspark.sql import functions as F

from tindra.functions import text
from tindra.operators import geocoding


def test_candidates(spark):
    rows = [
        (1, "Draugurinn á Bakka", "Hann bjó í Reykjavík, og fór til Akureyrar."),
        (2, "Sögn", "Séra Jón var prestur á Stað. Hún gekk undir Esju og kom á Hól."),
        (3, "frá Hlíð og frá hlíð", "Við Hlíð. í HLÍÐ"),
        (4, None, None),
        (5, "", "á þingi í dag, frá Íslandi!"),
    ]
    got = geocoding.candidates(spark.createDataFrame(rows, "id int, title string, body string"), "id", F.col("title"), F.col("body"))
    by = {}
    for r in sorted(got.collect(), key=lambda r: (r.id, r.pos)):
        by.setdefault(r.id, []).append((r.name, r.found_in))
    assert by[1] == [("Bakka", "title"), ("Reykjavík", "text"), ("Akureyrar", "text"), ("Akurey", "text")]  # a suffix may end inside a word
    assert by[2] == [("Stað", "text"), ("Esju", "text")]  # three letters are too few
    assert by[3] == [("Hlíð", "title")]
    assert by[5] == [("Íslandi", "text")] and 4 not in by


FORMS = [
    ("Skagafirði", "Skagafjörður", "ending"),
    ("Svarfaðardal", "Svarfaðardalur", "ending"),
    ("Þingvöllum", "Þingvellir", "ending"),
    ("Hólum", "Hólar", "ending"),
    ("Egilsstöðum", "Egilsstaðir", "ending"),
    ("Breiðabæ", "Breiðabær", "ending"),
    ("Borgarness", "Borgarnes", "ending"),
    ("öræfum", "Öræfi", "irregular"),
    ("Hekla", "Hekla", "direct"),
    ("Kirkjub", "Kirkjubæjarklaustur", "partial"),
    ("Nowhere", None, None),
]


@pytest.mark.parametrize("order", [1, -1])
def test_lookup(spark, order):
    places = sorted({p for _, p, _ in FORMS if p})[::order]
    table = spark.createDataFrame([(k, p, 64.0 + k, -20.0) for k, p in enumerate(places)], "id long, place string, lat double, lon double")
    names = spark.createDataFrame([(f,) for f, _, _ in FORMS] + [(None,), ("Hekla",)], "name string")
    got = {r.name: (r.place, r.tier) for r in geocoding.lookup(names, table).collect()}
    assert got == {f: (p, tier) for f, p, tier in FORMS if p}


def test_six_places_that_begin_so_are_too_many(spark):
    table = lambda n: spark.createDataFrame([(k, f"Hvammur{k}", 65.0, -20.0) for k in range(n)], "id long, place string, lat double, lon double")
    names = spark.createDataFrame([("Hvamm",)], "name string")
    assert [r.place for r in geocoding.lookup(names, table(5)).collect()] == ["Hvammur0"]
    assert geocoding.lookup(names, table(6)).count() == 0


MARKED = [
    ("[[Reykjavík|the capital]] lies in [[Iceland]].", "the capital lies in Iceland."),
    ("'''Bold''' and ''slanted'' words stand here.", "Bold and slanted words stand here."),
    ("Before the note<ref>a source, 1900</ref> and after it.", "Before the note and after it."),
    ("{{Infobox|name=x}}A mountain in the north of it.", "A mountain in the north of it."),
    ("Too short\n\nThis paragraph is long enough to be kept.", "This paragraph is long enough to be kept."),
]


def test_markup_by_hand(spark):
    rows = spark.createDataFrame([(k, a) for k, (a, _) in enumerate(MARKED)], "k int, t string")
    got = [r.p for r in rows.orderBy("k").select(text.plain_markup(F.col("t")).alias("p")).collect()]
    assert got == [b for _, b in MARKED]
