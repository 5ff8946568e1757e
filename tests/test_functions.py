"""Scalar rules against values worked out by hand."""

import random
import struct

import pytest
from pyspark.sql import functions as F

from tindra.functions import geo, geometry, html, similarity, speech, text
from tindra.plans import samples


def column(spark, values, make):
    """The values of a column expression over a one-column table, in order."""
    df = spark.createDataFrame(list(enumerate(values)), "i int, x string")
    return [r[0] for r in df.select("i", make(F.col("x")).alias("y")).orderBy("i").select("y").collect()]


GPS = [None, "", "NOLOC", "noloc", "64.1", "64.1,-21.9", "64.1, -21.9", "1,2,3", "x,y", "nan,1", "80,0", "1.0d,2", "64.1,-21.9,5"]


def test_gps(spark):
    assert column(spark, GPS, geo.has_location) == [False, False, False, False, False, True, True, True, True, True, True, True, True]
    lenient = column(spark, GPS, lambda c: F.struct(*(p.alias(n) for p, n in zip(geo.lenient_point(c), ("lat", "lon")))))
    assert [tuple(r) for r in lenient] == [(None, None)] * 5 + [(64.1, -21.9)] * 2 + [(1.0, 2.0), (None, None), (None, None), (80.0, 0.0), (None, None), (64.1, -21.9)]
    strict = column(spark, GPS, lambda c: geo.strict_point(c)[0])
    assert strict == [None] * 5 + [64.1, 64.1] + [None] * 6


def test_elevation(spark):
    values = [None, "1682", "1682 m", "12,5", "2.5", "1.234,5", "abc", "-3,5"]
    assert column(spark, values, text.elevation) == [None, 1682, 1682, 12, 2, 1, None, -4]


def test_titles(spark):
    assert column(spark, ["Glymur, foss", "- x", "A–B", None], text.place_name) == ["glymur", "- x", "a", ""]
    assert column(spark, ["*Djákninn á Myrká,-þjóðsaga", "A.B (c)!"], text.legend_title) == ["djákninn á myrká", "a b c"]
    assert column(spark, ["Geysir,-þjóðsaga", "Gos, 1783", " X "], text.catalogue_name) == ["geysir", "gos", "x"]
    assert column(spark, ["1783 eldgos", "365 x", "0365 x", "1908–1912 ár", "x"], text.year_last) == ["Eldgos, 1783", "365 x", "0365 x", "Ár, 1908–1912", "x"]


def test_folding_is_ascii_only(spark):
    assert column(spark, ["þjóð", "50x off", "A_b"], lambda c: text.matches_like(c, "", "þ", "%")) == [True, False, False]
    assert column(spark, ["Þjóð"], lambda c: text.matches_like(c, "", "þ", "%")) == [False]
    assert column(spark, ["50x off", "50_ off"], lambda c: text.matches_like(c, "%", "50_ off", "%")) == [True, True]


def test_markup(spark):
    got = column(spark, ["{{a {{b}}}}[[File:x.png|y]]A [[Place|place]] that is long enough.\n\nshort\n\n== Head ==\n<ref>z</ref>'''Bold''' text of some more length.", None], text.plain_markup)
    assert got == ["A place that is long enough.\n\nBold text of some more length.", ""]


def test_captions(spark):
    pair = column(spark, ["A --- b --- c", "First\nrest\nmore", "one"], lambda c: F.struct(*(x.alias(n) for x, n in zip(text.caption_and_text(c, "---"), "ct"))))
    assert [tuple(r) for r in pair] == [("A", "b --- c"), ("First", "rest\nmore"), ("one", "")]
    assert column(spark, ['"x"', "'y'", "\"z'", '"'], text.unquoted) == ["x", "y", "\"z'", '"']
    assert text.voice_tag("en-US-AndrewNeural") == "andrew" and text.voice_tag("is_IS-salka-medium") == "salka"


def test_ratio(spark):
    df = spark.createDataFrame([("tide", "diet"), ("diet", "tide"), ("", "x"), (None, "x"), ("Á B", " á b ")], "a string, b string")
    got = [r[0] for r in df.select(similarity.ratio(similarity.cleaned(F.col("a")), similarity.cleaned(F.col("b")))).collect()]
    assert got == [0.25, 0.5, 0.0, 0.0, 1.0]
    match = spark.createDataFrame([("glymur", "glymur hvalfirði"), ("b a", "a b"), ("", "x")], "a string, b string")
    assert [r[0] for r in match.select(similarity.name_match(F.col("a"), F.col("b"))).collect()] == [1.0, 1.0, 0.0]


def test_ratio_bounds_hold():
    rng = random.Random(1)
    for _ in range(300):
        a, b = ("".join(rng.choices("abc d", k=rng.randint(1, 12))) for _ in "ab")
        full = similarity.gestalt(a, b)
        assert similarity.gestalt_from(a, b, 0.7) == (full if full >= 0.7 else 0.0) or full < 0.7


@pytest.mark.parametrize(
    "given, said",
    [
        (speech.year(1908), "nítján hundruð og átta"),
        (speech.year(2002), "tvö þúsund og tvö"),
        (speech.year(1000), "eitt þúsund"),
        (speech.year(2100), "tuttugu og eitt hundruð"),
        (speech.cardinal(0), "núll"),
        (speech.cardinal(1682, "m", "gen"), "eitt þúsund sex hundruð áttatíu og tveggja"),
        (speech.cardinal(101), "hundrað og eitt"),
        (speech.cardinal(3, "f"), "þrjár"),
        (speech.day(31), "þrítugasta og fyrsta"),
        (speech.day(24), "tuttugasta og fjórða"),
        (speech.day(32), None),
        (speech.century(2, True), "annarri"),
        (speech.century(21, True), "tuttugustu og fyrstu"),
        (speech.say("á 18. öld", "text"), "á átjándu öld"),
        (speech.say("18. öld", "text"), "átjánda öld"),
        (speech.say("í lok 18. aldar", "text"), "í lok átjándu aldar"),
        (speech.say("17.–18. öld", "text"), "sautjánda til átjánda öld"),
        (speech.say("Stofnað, 1982", "cloud"), "Stofnað, nítján hundruð áttatíu og tvö"),
        (speech.say("1850 íbúar", "cloud"), "1850 íbúar"),
        (speech.say("1682 metra hátt", "numbers"), "eitt þúsund sex hundruð áttatíu og tveggja metra hátt"),
        (speech.say("MH og NATO, III", "text"), "emm há og NATO, III"),
        (speech.say("99.13.1999", "text"), "99.13.1999"),
    ],
)
def test_speech(given, said):
    assert given == said


def test_english_speech(spark):
    assert column(spark, ["Þingvellir & Öræfi<br>ð (1, 2)", None], text.english_speech) == ["Thingvellir and Oraefi\n\nd ", ""]


def test_coordinates_round_from_their_exact_value(spark):
    rng = random.Random(3)
    values = [rng.uniform(-180, 180) for _ in range(300)] + [round(rng.uniform(-180, 180), 7) for _ in range(600)] + [rng.choice([-1, 1]) * (k + 0.5) / 2**7 for k in range(200)]
    values += [0.0, -0.0, 1e-7, -1e-7, 1e-6, 5e-7, 1.5e-6, 2.5e-6, 9.9e-5, 1e-5, 0.0001, 1e-4 - 1e-7, 0.0078125, 63.0, 64.1, -21.9, 179.9999995, 99.9999999, 5e-324, 0.001, 123.4567895]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double")
    got = {r.i: r for r in df.select("i", geo.fixed(F.col("v"), 6).alias("six"), geo.fixed(F.col("v"), 7).alias("seven"), geo.shortest(F.col("v")).alias("short")).collect()}
    for i, v in enumerate(values):
        assert (got[i].six, got[i].seven, got[i].short) == (f"{v:.6f}", f"{v:.7f}", str(round(v, 6))), v
    odd = spark.createDataFrame([(None,), (float("nan"),)], "v double").select(geo.fixed(F.col("v"), 6).alias("x"), geo.shortest(F.col("v")).alias("y"))
    assert [tuple(r) for r in odd.collect()] == [(None, None)] * 2


def test_peaks(spark):
    from tindra.operators import ingest

    rows = [(64.123456789, -21.5, {"name": "B", "ele": "1.234,5 m"}), (64.0, -20.0, {"name": "A", "ele": "900"}), (64.0, -20.0, {"name": "C", "ele": "900"}), (None, 1.0, {"name": "x", "ele": "5"}), (1.0, 1.0, {"ele": "5"}), (1.0, 1.0, {"name": "", "ele": "5"}), (1.0, 1.0, {"name": "y", "ele": "high"}), (1.0, 1.0, None)]
    got = [tuple(r) for r in ingest.peaks(spark.createDataFrame(rows, "lat double, lon double, tags map<string, string>")).collect()]
    assert got == [("64.0, -20.0", "A", 900), ("64.0, -20.0", "C", 900), ("64.123457, -21.5", "B", 1)]


def standing(wkb, at=0):
    """The rule in plain Python, one number after the other."""
    order = "<" if wkb[at] == 1 else ">"
    kind = struct.unpack_from(order + "I", wkb, at + 1)[0] % 1000
    read = lambda place: struct.unpack_from(order + "dd", wkb, place)
    if kind == 1:
        return read(at + 5)
    count = struct.unpack_from(order + "I", wkb, at + 5)[0]
    if kind in (4, 5, 6) and count:
        return standing(wkb, at + 9)
    if kind == 2 and count:
        return read(at + 9 + 16 * (count // 2))
    if kind == 3 and count and (n := struct.unpack_from(order + "I", wkb, at + 9)[0]):
        xs, ys = 0.0, 0.0
        for k in range(n):
            x, y = read(at + 13 + 16 * k)
            xs, ys = xs + x, ys + y
        return xs / n, ys / n
    return None


def test_geometry(spark):
    rng = random.Random(5)
    blobs = [samples.blob(k, rng.uniform(-180, 180), rng.uniform(-90, 90)) for k in range(130)]
    blobs += [samples.blob(0, x, -x) for x in (0.0, -0.0, 5e-324, 1e-310, 2.2250738585072014e-308, 1.7976931348623157e308, 1 / 3, float("inf"), float("-inf"), float("nan"))]
    blobs += [b[:n] for b in blobs[:14] for n in (len(b) - 1, len(b) // 2, 9, 13)] + [None, b"", b"GP", b"GP\0\0\0\0\0\0\x01\x09\0\0\0" + bytes(20)]
    ring = [(rng.uniform(-30, -10), rng.uniform(60, 70)) for _ in range(3000)]
    blobs.append(b"GP\0\0" + bytes(4) + b"\x00" + struct.pack(">III", 3, 1, len(ring)) + struct.pack(f">{2 * len(ring)}d", *(c for p in ring for c in p)))
    df = spark.createDataFrame([(i, bytearray(b) if b is not None else None) for i, b in enumerate(blobs)], "i int, g binary")
    got = {r.i: r.p and (r.p.lon, r.p.lat) for r in df.select("i", geometry.point("g").alias("p")).collect()}
    found = 0
    for i, b in enumerate(blobs):
        want = None
        if b and len(b) >= 8 and b[:2] == b"GP":
            try:
                want = standing(b[8 + {0: 0, 1: 32, 2: 48, 3: 48, 4: 64}.get(b[3] >> 1 & 7, 0) :])
            except (struct.error, IndexError):
                want = None
        same = lambda x, y: x == y or (x != x and y != y)
        assert (want is None) == (got[i] is None) and (want is None or all(map(same, want, got[i]))), (i, want, got[i])
        found += want is not None
    assert found > 90


@pytest.mark.parametrize("wanted, text", [(".b", "two"), ("div.b", "two"), ("p", "one"), ("#x", "three"), ("div#x.a.b", "three"), ("section", "in it"), (".none", ""), ("span.b", "")])
def test_selectors(wanted, text):
    page = "<p class='a'>one</p><div class='a b'>two</div><div id=x class='b c a'>three</div><section>in <b>it</b></section>"
    assert html.read_page(page, wanted)["main"] == text


def test_selectors_that_are_not_simple():
    for wanted in ("", "a b", "div > p", "a[href]"):
        with pytest.raises(ValueError):
            html.selector(wanted)


def test_page():
    page = html.read_page("<title> T </title><nav><a href='/a'>x</a></nav><h2><a href='/i'>Item</a> one</h2><div class='c main'>Hello <b>big</b>\n world<script>var t='</p>';</script></div><blockquote>first</blockquote><blockquote>A line\nwraps<p>New<br>para</blockquote><h6>(Jón)</h6>", ".main")
    assert page["title"] == "T" and page["links"] == ["/a", "/i"] and page["main"] == "Hello big world"
    assert page["headings"][0] == {"level": 2, "text": "Itemone", "href": "/i"}
    assert page["story"] == "A line wraps\n\nNew\n\npara" and page["source"] == "Jón"
    assert html.read_page(None, "main")["title"] == "" and html.read_page("(x Maurer y)", "m")["source"] == "x Maurer y"


def test_language_and_engine_choose_the_passes(spark):
    df = spark.createDataFrame([(1, "is", "Árið 1908, 1982 & 5 km"), (2, "en", "Þing & 1908"), (3, None, "5 km")], "id int, lang string, x string")
    said = lambda engine: [r.y for r in df.select("id", speech.prepared(F.col("x"), F.col("lang"), engine).alias("y")).orderBy("id").collect()]
    assert said("local") == ["Árið nítján hundruð og átta, nítján hundruð áttatíu og tvö og fimm kílómetrar", "Thing and 1908", "fimm kílómetrar"]
    assert said("cloud") == ["Árið nítján hundruð og átta, nítján hundruð áttatíu og tvö og 5 kílómetrar", "Thing and 1908", "5 kílómetrar"]


@pytest.mark.parametrize("text, said", [("24.–3. öld", "24.–3. öld"), ("99.13.1999 8. júní", "99.13.1999 áttunda júní"), ("1 " + "7" * 5000, "1 " + "7" * 5000), ("0999-1908-1912", "0999 til 1908 til 1912")])
def test_forms_that_cannot_be_said_stay(text, said):
    assert speech.say(text, "text") == said
    assert isinstance(speech.say(text, "local"), str)


def test_references_without_a_semicolon_stay_where_closed_ones_are_asked_for():
    from tindra.functions import html

    page = "<title>a &amp</title><article>b &amp; c &amp<p>d &copy; e&copy</article>"
    got, plain = html.read_page(page, "article", closed=True), html.read_page(page, "article")
    assert (got["title"], got["main"]) == ("a &amp", "b & c &amp d © e&copy")
    assert (plain["title"], plain["main"]) == ("a &", "b & c & d © e©")


def test_lists_of_names_are_scored_as_pairs():
    import random

    import numpy as np

    from tindra.functions import similarity

    def lcs(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            new = [0]
            for k, y in enumerate(b):
                new.append(row[k] + 1 if x == y else max(row[k + 1], new[k]))
            row = new
        return row[-1]

    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcþ") for _ in range(rng.randint(1, 5)))
    first = [*dict.fromkeys([" ".join(word() for _ in range(rng.randint(1, 12))) for _ in range(40)] + ["ab" * 45, "a" * 64, "b" * 65])]
    second = [*dict.fromkeys([x[::-1] for x in first[:10]] + [x + " x" for x in first[10:20]] + first[20:25] + first[-3:] + ["a", "þ a b"])]
    bound = similarity.common_sequence_bounds(first, second)
    for i, a in enumerate(first):
        for j, b in enumerate(second):
            assert bound[i, j] == lcs(a, b) if len(a) <= similarity.BITS else lcs(a, b) <= bound[i, j] <= len(b)
    assert np.array_equal(similarity.ratios(first, second, 0.65), [[similarity.gestalt_from(a, b, 0.65) for b in second] for a in first])
    assert similarity.common_sequence_bounds(["a"], []).shape == (1, 0)

    def match(a, b):
        x, y = a.split(), b.split()
        n = min(len(x), len(y))
        return 1.0 if x[:n] == y[:n] else max(similarity.gestalt_from(a, b, 0.7), len(set(x) & set(y)) / len(set(x) | set(y)))

    i, j, score = similarity.matched(first, second, [x.split() for x in first], [x.split() for x in second], 0.7)
    assert {(p, q): s for p, q, s in zip(i.tolist(), j.tolist(), score.tolist())} == {(p, q): match(a, b) for p, a in enumerate(first) for q, b in enumerate(second) if match(a, b) >= 0.7}


def test_signatures_lose_no_pair(spark):
    import random

    from pyspark.sql import functions as F

    from tindra.functions import similarity

    rng = random.Random(3)
    rows = []
    for _ in range(300):
        a = "".join(rng.choice("abcdeþ ö") for _ in range(rng.randint(10, 50)))
        b = "".join(x + rng.choice(["", "", "", "", "", "e"]) for x in a if rng.random() > 0.06)
        rows += [(a, b), (a, rows[0][0] if rows else a)]
    df = spark.createDataFrame(rows, "a string, b string").withColumns({"_sa": similarity.signature(F.col("a")), "_sb": similarity.signature(F.col("b"))})
    may = {(r.a, r.b) for r in df.where(similarity.may_reach(F.col("a"), F.col("b"), "_sa", "_sb", 0.9)).collect()}
    alike = {(a, b) for a, b in rows if similarity.gestalt(a, b) >= 0.9}
    assert 50 < len(alike) and alike <= may and len(may) < len(rows) * 0.7


def test_spoken_forms_are_what_each_engine_says(spark):
    from pyspark.sql import functions as F

    from tindra.functions import speech

    texts = ["Árið 1941 voru 3 hestar.", "10.6.1941 kl. 15", "NATO og 18. öld", "", None, "frá 1908-1912"]
    engines = ("local", "cloud", "numbers")
    got = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "id int, t string").select("id", speech.spoken_forms(F.col("t"), *engines).alias("s")).orderBy("id").collect()
    assert [tuple(r.s[e] for e in engines) for r in got] == [tuple(None if t is None else speech.say(t, e) for e in engines) for t in texts]
