"""Plans against plain loops on random inputs."""

import math
import random
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from tindra.functions import similarity, text
from tindra.operators import catalogue, changes, greedy, ingest, joins, matching, order, summaries


def metres(a, b, c, d):
    p, q = math.radians(a), math.radians(c)
    x = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(d - b) / 2) ** 2
    return 2 * 6371000 * math.atan2(math.sqrt(x), math.sqrt(1 - x))


@pytest.mark.parametrize("south, north", [(63, 64), (-1, 1), (84, 90)])
def test_radius_join_is_the_nested_loop(spark, south, north):
    rng = random.Random(south)
    pts = [(i, rng.uniform(south, north), rng.choice([rng.uniform(-180, -179), rng.uniform(179, 180), rng.uniform(-180, 180)])) for i in range(150)]
    pts += [(200, None, 1.0), (201, float("nan"), 1.0)]
    a, b = spark.createDataFrame(pts, "a long, alat double, alon double"), spark.createDataFrame(pts, "b long, blat double, blon double")
    got = {(r.a, r.b) for r in joins.radius_join(a, b, 40_000, ("alat", "alon"), ("blat", "blon")).collect()}
    good = [p for p in pts if p[0] < 200]
    assert got == {(p[0], q[0]) for p in good for q in good if metres(*p[1:], *q[1:]) < 40_000}


def test_radius_pairs_of_crowded_points_are_the_nested_loop(spark, monkeypatch):
    monkeypatch.setattr(joins, "BLOCK", 8)
    rng = random.Random(11)
    spots = [(rng.uniform(64, 64.2), rng.choice([179.99, -179.99, 20.0])) for _ in range(6)]
    pts = [(i, *rng.choice(spots)) for i in range(150)] + [(200, None, 1.0), (201, float("nan"), 1.0)]
    measured = []
    monkeypatch.setattr(joins.geo, "haversine", lambda *c, f=joins.geo.haversine: measured.append(c) or f(*c))
    pairs = joins.radius_pairs(spark.createDataFrame(pts, "id long, lat double, lon double"), 9_000)
    assert len(measured) == 1 and "alat" in str(measured[0][0])
    got = sorted((r.a, r.b, round(r.distance_m, 6)) for r in pairs.collect())
    good = [p for p in pts if p[0] < 200]
    assert got == sorted((p[0], q[0], round(metres(*p[1:], *q[1:]), 6)) for p in good for q in good if p[0] < q[0] and metres(*p[1:], *q[1:]) < 9_000) and len(got) > 1000


def test_contains_join(spark):
    rng = random.Random(3)
    words = ["", *("".join(rng.choices("ab", k=rng.randint(1, 7))) for _ in range(40))]
    a = spark.createDataFrame(list(enumerate(words)), "i int, x string")
    b = spark.createDataFrame(list(enumerate(words)), "j int, y string")
    got = sorted((r.i, r.j) for r in joins.contains_join(a, b, "x", "y").collect())
    assert got == sorted((i, j) for i, x in enumerate(words) for j, y in enumerate(words) if x in y)


@pytest.mark.parametrize("local", [0, 15, 200_000])
def test_greedy_is_the_sequential_loop(spark, monkeypatch, local):
    monkeypatch.setattr(greedy, "LOCAL_EDGES", local)
    rng = random.Random(5)
    for _ in range(3):
        n = 40
        edges = {(i, rng.randrange(i)) for i in range(1, n) for _ in range(rng.randint(0, 3))}
        seeds = {i for i in range(n) if rng.random() < 0.1}
        kept = {}
        for i in range(n):
            kept[i] = i not in seeds and not any(kept[j] for k, j in edges if k == i)
        e = spark.createDataFrame(sorted(edges), "node long, earlier long")
        nodes = spark.range(n).withColumnRenamed("id", "node")
        got = {r.node: r.accepted for r in greedy.accept(nodes, e, spark.createDataFrame([(s,) for s in seeds], "node long")).collect()}
        assert got == kept


def test_long_chains_take_few_rounds(spark):
    n = 3000
    e = spark.createDataFrame([(k, k - 1) for k in range(1, n)], "node long, earlier long")
    got = {r.node: r.accepted for r in greedy.accept(spark.range(n).withColumnRenamed("id", "node"), e).collect()}
    assert got == {k: k % 2 == 0 for k in range(n)}


def test_order_need_not_be_that_of_the_numbers():
    import pandas as pd

    edges = pd.DataFrame({"node": [1, 2, 3, 3], "earlier": [2, 5, 1, 9], "fate": [None, None, None, True]})
    got = dict(next(greedy._in_order(iter([edges]))).itertuples(index=False))
    assert got == {1: False, 2: True, 3: False}


def test_chain_keeps_the_far_end(spark):
    e = spark.createDataFrame([(1, 0), (2, 1)], "node long, earlier long")
    got = {r.node: r.accepted for r in greedy.accept(spark.range(3).withColumnRenamed("id", "node"), e).collect()}
    assert got == {0: True, 1: False, 2: True}


def loop_nearby(rows, lat, lon):
    out, last = [], ("", "")
    for r in sorted(rows, key=lambda r: (r[1] is not None, r[1] or "", r[0])):
        gps = (r[2] or "").replace(" ", "")
        if not gps or gps.upper() == "NOLOC" or "," not in gps or (r[1] or "")[:1] in ("*", "+") and r[1]:
            continue
        if (r[1] or "", gps) == last or "src9" in (r[3] or ""):
            continue
        try:
            p = float(gps.split(",")[0]), float(gps.split(",")[1])
        except ValueError:
            continue
        d = metres(*p, lat, lon)
        if d < 4000:
            out.append((r[1] or "", math.floor(d)))
        last = (r[1] or "", gps)
    return sorted(out, key=lambda x: x[1])[:10]


def test_nearby_is_the_loop(spark):
    rng = random.Random(7)
    places = ["64.1,-21.9", "64.1, -21.9", "64.11,-21.91", "66,-15", "NOLOC", "", None, "x,y", "1,2,3", "64.1"]
    for k in range(4):
        rows = [(i, rng.choice(["A", "B", "*C", "+D", "", None, "E"]), rng.choice(places), rng.choice([None, "src1", "src9;x"])) for i in range(60)]
        got = catalogue.nearby(spark.createDataFrame(rows, "id long, name string, gps string, tag string"), 64.1, -21.9)
        assert [(r.key, r.value) for r in got.collect()] == loop_nearby(rows, 64.1, -21.9)


def test_fuzzy_candidates_are_the_loop(spark):
    rng = random.Random(9)
    make = lambda n, s: [(i + s, "".join(rng.choices("abc", k=5)), rng.choice([None, "", "abca"]), f"64.{rng.randint(100, 115)},-21.9") for i in range(n)]
    left, right = make(25, 0), make(25, 100)
    cols = "id long, name string, name_eng string, gps string"
    got = {(r.in_id, r.db_id, round(r.score, 9)) for r in matching.fuzzy_candidates(spark.createDataFrame(left, cols), spark.createDataFrame(right, cols)).collect()}
    ratio = lambda a, b: SequenceMatcher(None, a, b).ratio() if a and b else 0.0
    want = set()
    for a in left:
        for b in right:
            pa, pb = (tuple(map(float, x[3].split(","))) for x in (a, b))
            best = max(ratio(x, y) for x in a[1:3] for y in b[1:3])
            if metres(*pa, *pb) < 1000 and best >= 0.65:
                want.add((a[0], b[0], round(best, 9)))
    assert got == want


def test_tiers(spark):
    cols = "id long, name string, name_eng string, gps string"
    known = spark.createDataFrame([(1, "Glymur", None, "64.1,-21.9"), (2, "Reykholt", "Smoke hill", "64.2,-21.9"), (3, "Glymur", None, "64.1,-21.9"), (4, "Elsewhere", None, "1,2")], cols)
    new = spark.createDataFrame([(10, "Glymur, foss", None, "64.11,-21.9"), (11, "Reykholt", None, None), (12, "Glimur", None, "64.101,-21.9"), (13, "Glimur", None, "64.15,-21.9"), (14, "", None, None), (15, "Smoke hill", None, "NOLOC")], cols)
    got = {r.in_id: (r.db_id, r.metres) for r in matching.tiered_best(new, known).collect()}
    assert set(got) == {10, 11, 12, 15} and got[10][0] == 1 and got[11] == (2, None) and got[12][0] == 1 and got[15] == (2, None)


def test_contains_join_is_the_loop(spark):
    rng = random.Random(8)
    some = lambda n: {"".join(rng.choices("aab ", k=rng.randint(0, 12))) for _ in range(n)}
    small, large = some(60) | {""}, some(80) | {"b" * 30}
    pairs = joins.contains_join(spark.createDataFrame([(x,) for x in [*small, None]], "s string"), spark.createDataFrame([(x,) for x in [*large, None]], "l string"), "s", "l")
    assert sorted((r.s, r.l) for r in pairs.collect()) == sorted((s, x) for s in small for x in large if s in x)
    none = spark.createDataFrame([], "s string")
    assert joins.contains_join(none, none.withColumnRenamed("s", "l"), "s", "l").count() == 0


def test_fuzzy_slug_is_the_loop(spark):
    rng = random.Random(9)
    known = list({"-".join("".join(rng.choices("abcd", k=rng.randint(2, 6))) for _ in range(rng.randint(1, 4))) for _ in range(80)})
    slugs = [k.replace("a", "b", 1) for k in known[:30]] + known[30:40] + [k + "-x" for k in known[40:60]] + ["zzzz", ""]
    got = joins.fuzzy_slug(spark.createDataFrame([(x,) for x in slugs], "slug string"), "slug", spark.createDataFrame([(x,) for x in known], "known string"), "known")

    def loop(slug):
        parts = slug.split("-")
        for i in range(len(parts), 0, -1):
            if "-".join(parts[:i]) in known:
                return "-".join(parts[:i]), "exact" if i == len(parts) else "prefix"
        best = max((SequenceMatcher(None, k, slug).ratio(), k) for k in known)
        return (best[1], "fuzzy") if best[0] >= 0.85 else (None, None)

    rows = {r.slug: (r.matched, r.tier) for r in got.collect()}
    assert rows == {x: loop(x) for x in slugs} and {"exact", "prefix", "fuzzy", None} == {v[1] for v in rows.values()}


@pytest.mark.parametrize("hot", [0, 700])
def test_batches_and_successes_over_many_tasks(spark, hot):
    rng = random.Random(10)
    rows = [(k, rng.choice("abc") if k >= hot else "a", rng.random() < 0.1) for k in range(900)] + [(900, None, True), (901, None, None)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "id long, lang string, good boolean").repartition(4)
    seen, won, batch, visited = {}, {}, {}, set()
    for k, lang, good in sorted(rows):
        batch[k] = seen.get(lang, 0) // 20
        seen[lang] = seen.get(lang, 0) + 1
        if won.get(lang, 0) < 5:
            visited.add(k)
        won[lang] = won.get(lang, 0) + bool(good)
    assert {r.id: r.batch for r in order.batches(df, ["lang"], [F.asc("id")]).collect()} == batch
    assert {r.id for r in order.first_successes(df, F.col("good"), [F.asc("id")], 5, ["lang"]).collect()} == visited


def _names(rng, n):
    word = lambda: "".join(rng.choices("abcdeö", k=rng.randint(1, 7)))
    base = [" ".join(word() for _ in range(rng.choice([1, 1, 2, 3, 5, 10, 14, 30]))) for _ in range(n // 3)]
    out = []
    for _ in range(n):
        x = list(rng.choice(base))
        for _ in range(rng.choice([0, 1, 1, 2, 3, 6])):
            k = rng.randrange(len(x) + 1)
            x[k : k + rng.randint(0, 1)] = rng.choice(["a", "b", " ", ""])
        out.append("".join(x))
    return [x for x in out if x.strip()]


def _name_match(a, b):
    x, y = a.split(), b.split()
    n = min(len(x), len(y))
    if not a or not b:
        return 0.0
    return 1.0 if n and x[:n] == y[:n] else max(similarity.gestalt(a, b), len({*x} & {*y}) / len({*x} | {*y}))


@pytest.mark.parametrize("least", [0.85, 0.9, 0.95])
def test_alike_pairs_lose_none(spark, least):
    rng = random.Random(int(100 * least))
    a, b = ({*_names(rng, 160)} for _ in range(2))
    a, b = a | set(list(b)[:40]), b | {"x" * 120, "x" * 118 + "yy"}
    a |= {"x" * 119, ""}
    got = {(r.a, r.b) for r in joins.alike_pairs(spark.createDataFrame([(x,) for x in a], "a string"), spark.createDataFrame([(x,) for x in b], "b string"), least).collect()}
    want = {(x, y) for x in a for y in b if _name_match(x, y) >= least}
    assert want <= got and len(want) > 30


def test_tiered_best_is_the_loop(spark):
    rng = random.Random(3)
    place = lambda: rng.choice([None, "NOLOC", *[f"64.{rng.randint(0, 399):03d},-21.{rng.randint(0, 999):03d}"] * 6])
    db = [(k, n, rng.choice([None, "", n[::-1]]), place()) for k, n in enumerate(_names(rng, 150))]
    new = [(1000 + k, n, None, place()) for k, n in enumerate([*_names(rng, 60), *(n + rng.choice(["", " x"]) for _, n, _, _ in db[:90])])]
    cols = "id long, name string, name_eng string, gps string"
    frames = [spark.createDataFrame(rows, cols) for rows in (new, db)]
    norm = [{r.id: (r.n, r.e) for r in f.select("id", text.place_name(F.col("name")).alias("n"), text.place_name(F.col("name_eng")).alias("e")).collect()} for f in frames]
    point = lambda g: tuple(map(float, g.split(","))) if g and "," in g else None

    want = {}
    for i, _, _, g in new:
        best = None
        for j, _, _, h in db:
            score = max(_name_match(norm[0][i][0], x or "") for x in norm[1][j])
            p, q = point(g), point(h)
            if not norm[0][i][0] or q is None:  # the catalogue's rows without a point take no part
                continue
            d = None if p is None else metres(*p, *q)
            if score >= 0.9 if d is None else (d <= 2000 and score >= 0.7) or (d <= 25_000 and score >= 0.95):
                best = max(best or (0, 0, 0), (score, -j, d if d is None else int(d)), key=lambda x: x[:2])
        if best:
            want[i] = (-best[1], best[2], round(best[0], 9))
    got = {r.in_id: (r.db_id, r.metres, round(r.score, 9)) for r in matching.tiered_best(*frames).collect()}
    assert len(want) > 60 and sum(x[1] is None for x in want.values()) > 10
    assert got == want


@pytest.mark.parametrize("first", [1, 32])
def test_full_matches_are_the_loop(spark, monkeypatch, first):
    monkeypatch.setattr(joins, "FIRST", first)
    rng = random.Random(13)
    name = lambda: " ".join(rng.choices("abcdefg", k=rng.randint(1, 4)))
    spot = lambda: rng.choice([(64 + rng.randint(0, 9) / 10, -21 - rng.randint(0, 9) / 10) for _ in range(3)])
    left = sorted({(name(), *rng.choice([spot(), spot(), (None, None)])) for _ in range(120)}, key=str)
    right = [(name(), *spot(), k) for k in rng.sample(range(1000), 150)]
    placed, alone = joins.full_matches(spark.createDataFrame(left, "a string, lat double, lon double"), spark.createDataFrame(right, "b string, blat double, blon double, id long"), 25_000)
    want = {}
    for a, *p in left:
        for b, *q, k in right:
            d = metres(*p, *q) if p[0] is not None else None
            if _name_match(a, b) == 1 and (d is None or d <= 25_000):
                want[(a, *p)] = min(want.get((a, *p), (k, d)), (k, d), key=lambda x: x[0])
    got = {(r.a, r.lat, r.lon): (r.id, r.distance_m) for r in placed.collect()} | {(r.a, None, None): (r.id, None) for r in alone.collect()}
    assert got.keys() == want.keys() and {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in want.items()}
    assert all(got[k][1] == pytest.approx(want[k][1], abs=1e-3) for k in want if k[1] is not None) and len(want) < len(left)


def test_tiers_pair_only_names_without_a_full_match(spark, monkeypatch):
    cols = "id long, name string, name_eng string, gps string"
    known = spark.createDataFrame([(k, f"name{k} of place", None, f"64.1{k:02d},-21.9") for k in range(40)], cols)
    new = spark.createDataFrame([(100 + k, f"name{k} of place x", None, f"64.1{k:02d},-21.9" if k % 2 else None) for k in range(40)] + [(200, "nameo of place", None, "64.1,-21.9")], cols)
    asked, listed = [], []
    monkeypatch.setattr(matching, "alike_pairs", lambda a, b, *c, f=matching.alike_pairs, **d: asked.extend(r.a for r in a.collect()) or f(a, b, *c, **d))
    monkeypatch.setattr(matching, "near_lists", lambda a, *b, f=matching.near_lists, **c: listed.extend(r.row.name for r in a.collect()) or f(a, *b, **c))
    got = {r.in_id: (r.db_id, r.score) for r in matching.tiered_best(new, known).collect()}
    assert {100 + k: (k, 1.0) for k in range(40)}.items() <= got.items() and set(asked) == set(listed) == {"nameo of place"}


def test_greedy_titles(spark):
    rows = [(1, "long title one", True), (2, "long title one more", True), (3, "title one", True), (4, "other", True), (5, "other", False), (6, "other", True), (7, "a b c d", True), (8, "a b c e", True)]
    got = {r.node: r.accepted for r in matching.greedy_titles(spark.createDataFrame(rows, "id long, title string, located boolean"), spark.createDataFrame([(0, "seed")], "id long, title string")).collect()}
    assert got == {1: True, 2: False, 3: True, 4: True, 6: False, 7: True, 8: False}


def title_loop(rows, seeds):
    """Titles in order of id against all that are in the set."""
    inside, out = list(seeds), {}
    for i, t, located in sorted(rows):
        if not located:
            continue
        lead = t.split()[:3]
        hit = any(t == x or (len(t) > 10 and (t in x or x in t)) or (len(lead) >= 2 and x.split()[:3] == lead) for x in inside)
        out[i] = not hit
        if not hit:
            inside.append(t)
    return out


@pytest.mark.parametrize("local", [0, 40, 200_000])
def test_greedy_titles_are_the_loop(spark, monkeypatch, local):
    monkeypatch.setattr(greedy, "LOCAL_EDGES", local)
    rng = random.Random(local)
    title = lambda: " ".join(rng.choice(["saga", "of", "king", "troll", "the", "sea"]) for _ in range(rng.choice([1, 2, 3, 4, 5])))
    rows = [(i, title(), rng.random() < 0.9) for i in range(300)]
    seeds = [title() for _ in range(4)]
    got = matching.greedy_titles(spark.createDataFrame(rows, "id long, title string, located boolean"), spark.createDataFrame([(k, t) for k, t in enumerate(seeds)], "id long, title string"))
    assert {r.node: r.accepted for r in got.collect()} == title_loop(rows, seeds)


def test_a_hundred_thousand_equal_titles_are_linear(spark):
    titled = lambda t: spark.range(100_000).select("id", t.alias("title"), F.lit(True).alias("located"))
    for title in (F.lit("just the one title"), F.concat(F.lit("one and two "), F.col("id") % 50_000 + 100_000)):
        rows = titled(title)
        got = matching.greedy_titles(rows, rows.limit(0).select("id", "title"))
        assert [r.node for r in got.where("accepted").collect()] == [0] and got.count() == 100_000


@pytest.mark.parametrize("local, strict", [(0, False), (30, True), (200_000, False)])
def test_greedy_places_are_the_loop(spark, monkeypatch, local, strict):
    monkeypatch.setattr(greedy, "LOCAL_EDGES", local)
    rng = random.Random(local + 1)
    place = lambda: f"{rng.choice([64.1, 0, 89.998, -64.1]) + rng.random() / 400:.6f},{rng.choice([-21.9, 179.9995]) + rng.random() / 1000:.6f}"
    spots = [place() for _ in range(120)]
    make = lambda i: (i, rng.choice([None, "", "A", "b", f"n{i}"]), rng.choice([None, "", "x", f"e{i}"]), rng.choice([*spots, "", None]))
    rows, known = [make(i) for i in range(260)], [make(1000 + i) for i in range(25)]
    tidy = lambda r: ((r[1] or "").strip().lower(), (r[2] or "").strip().lower(), *map(float, r[3].split(",")))
    inside, want = [tidy(r) for r in known if r[3]], {}
    for r in rows:
        if r[3]:
            n, e, lat, lon = tidy(r)
            hit = any((n == m or (e == f and (e or not strict))) and metres(lat, lon, p, q) < 100 for m, f, p, q in inside)
            want[r[0]] = not hit
            if not hit:
                inside.append((n, e, lat, lon))
    cols = "id long, name string, name_eng string, gps string"
    got = matching.greedy_same_place(spark.createDataFrame(rows, cols), spark.createDataFrame(known, cols), strict=strict)
    assert {r.node: r.accepted for r in got.collect()} == want


def test_a_crowd_at_one_place_is_linear(spark):
    """Thirty thousand rows without an English name within a few metres: no pairs."""
    rows = spark.range(30_000).select("id", F.concat(F.lit("n"), "id").alias("name"), F.lit("").alias("name_eng"), F.format_string("%.7f,%.7f", 64 + F.rand(1) / 5000, -21 + F.rand(2) / 3000).alias("gps"))
    got = matching.greedy_same_place(rows, rows.limit(0))
    assert [r.node for r in got.where("accepted").collect()] == [0] and got.count() == 30_000


def test_two_empty_english_names_are_equal(spark):
    cols = "id long, name string, name_eng string, gps string"
    rows = spark.createDataFrame([(1, "A", "", "64.1,-21.9"), (2, "B", None, "64.1,-21.9"), (3, "C", "c", "64.1,-21.9")], cols)
    none = rows.limit(0)
    fates = lambda strict: {r.node: r.accepted for r in matching.greedy_same_place(rows, none, strict=strict).collect()}
    assert fates(False) == {1: True, 2: False, 3: True} and fates(True) == {1: True, 2: True, 3: True}


@pytest.mark.parametrize("by", [["a"], ["a", "b"], ["a", "b", "c"]])
def test_totals_are_the_loops(spark, by):
    rng = random.Random(1)
    rows = [(rng.choice(["x", "y", None]), rng.choice(["p", None]), rng.randrange(4), rng.randrange(100)) for _ in range(300)]
    got = sorted((tuple(r) for r in summaries.totals_by(spark.createDataFrame(rows, "a string, b string, c int, v long"), by, n=F.lit(1), v=F.col("v")).collect()), key=str)
    want = {("all", None): [len(rows), sum(r[3] for r in rows)]}
    for r in rows:
        for c in by:
            k = r["abc".index(c)]
            total = want.setdefault((c, None if k is None else str(k)), [0, 0])
            total[0], total[1] = total[0] + 1, total[1] + r[3]
    assert got == sorted(((*k, *v) for k, v in want.items()), key=str)


def test_sketches_merge_over_loads(spark):
    loads = [spark.range(k * 4000, k * 4000 + 8000).select((F.col("id") % 2).alias("half"), F.when(F.col("id") % 11 > 0, F.col("id")).alias("v")) for k in range(4)]
    kept = [summaries.distinct_sketches(df, ["half"], "v", f"load {k}") for k, df in enumerate(loads)]
    every = kept[0].unionByName(kept[1]).unionByName(kept[2]).unionByName(kept[3])
    got = {r.half: r.distinct_values for r in summaries.distinct_of(every, ["half"]).collect()}
    for half in (0, 1):
        exact = sum(1 for i in range(20_000) if i % 2 == half and i % 11 > 0)
        assert abs(got[half] - exact) < 0.06 * exact
    assert every.where(F.length("sketch") > 10_000).count() == 0


def test_calls_stop_at_the_first_yes(spark):
    """As many calls as a loop makes that stops; a failed call is no yes."""
    rng = random.Random(6)
    rows = [(k, r, rng.choice(["yes", "no", "no", "fails"])) for k in range(40) for r in range(1, rng.randint(2, 7))]
    calls = spark.sparkContext.accumulator(0)

    def ask(df):
        def run(batches):
            for batch in batches:
                calls.add(len(batch))
                yield batch.assign(yes=[None if v == "fails" else v == "yes" for v in batch["verdict"]])

        return df.mapInPandas(run, "key long, rank long, verdict string, yes boolean")

    got = {r.key: (r.confirmed, r.looked_at) for r in matching.confirm_in_rounds(spark.createDataFrame(rows, "key long, rank long, verdict string"), "key", "rank", ask).collect()}
    want, made = {}, 0
    for k in {r[0] for r in rows}:
        mine = sorted(r[1:] for r in rows if r[0] == k)
        first = next((r for r, v in mine if v == "yes"), None)
        want[k] = (first, first or len(mine))
        made += want[k][1]
    assert got == want and calls.value == made
    assert matching.confirm_in_rounds(spark.createDataFrame([], "key long, rank long, verdict string"), "key", "rank", ask).count() == 0


def test_upsert_numbers_new_rows(spark):
    old = spark.createDataFrame([(1, "a", "s"), (2, "b", "t")], "id long, name string, source string")
    new = spark.createDataFrame([(2, "B"), (None, "c")], "id long, name string")
    got = sorted(((r.id, r.name, r.source) for r in changes.upsert(old, new, kept=("source",)).collect()), key=lambda r: r[1])
    assert got[0] == (2, "B", "t") and got[1] == (1, "a", "s") and got[2][0] > 2 and got[2][1:] == ("c", None)


def test_filters_reach_the_scan(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    plan = docs.where(catalogue.not_tag(F.col("source"), "src7")).select("doc_id")._jdf.queryExecution().executedPlan().toString()
    assert "Or(IsNull(source),Not(EqualTo(source,src7)))" in plan and "text" not in plan.split("ReadSchema")[1]


def test_features_keep_every_meaning(spark):
    n = 2500
    point = F.lit(bytes.fromhex("4750000100000000" + "0101000000" + "00000000000035c0" + "0000000000005040"))  # -21 64
    rows = spark.range(n).select(F.concat(F.lit("Name "), F.col("id")).alias("ornefni"), F.lit(None).cast("string").alias("tvinefni"), F.concat(F.lit("type"), F.col("id")).alias("nafnberi"), F.lit("A note.").alias("ornefnalysing"), F.lit(None).cast("string").alias("tilvist"), F.lit("s").alias("heimild"), point.alias("geom"))
    meanings = spark.range(n).select(F.concat(F.lit("type"), F.col("id")).alias("nafnberi"), F.concat(F.lit("Meaning "), F.col("id"), F.lit(".")).alias("meaning"))
    got = ingest.feature_rows([rows], meanings).select("name", "story").collect()
    assert len(got) == n and all(f"meaning {r.name.split()[1]}." in r.story for r in got)


def test_a_large_dictionary_of_features_is_whole(spark):
    from tindra.plans import samples

    layer = spark.range(1500).select(F.concat(F.lit("Name "), F.col("id").cast("string")).alias("ornefni"), F.lit("").alias("tvinefni"), F.concat(F.lit("kind"), F.col("id").cast("string")).alias("nafnberi"), F.lit("A note.").alias("ornefnalysing"), F.lit(None).cast("string").alias("tilvist"), F.lit("s").alias("heimild"), F.lit(bytearray(samples.blob(0))).alias("geom"))
    meanings = spark.range(1500).select(F.concat(F.lit("kind"), F.col("id").cast("string")).alias("nafnberi"), F.concat(F.lit("Meaning "), F.col("id").cast("string")).alias("meaning"))
    rows = ingest.feature_rows([layer], meanings)
    assert rows.where(F.col("story").contains("meaning ")).count() == 1500


def test_static_duplicates_meet_points_not_rows(spark):
    from pyspark.sql import functions as F

    # one place with many rows on both sides: pairs of rows would be 400 million
    many = spark.range(20_000)
    known = many.select(F.concat(F.lit("staður"), F.col("id").cast("string")).alias("name"), F.lit("64.1, -21.5").alias("gps"))
    known = known.unionByName(spark.createDataFrame([("gamli bær", "64.1,-21.501"), ("Hóll innri", "64.1,-21.5"), ("", "65.0,-20.0"), (None, "x")], "name string, gps string"))
    one = [(-1, "Gamli bærinn", 64.1, -21.5), (-2, "óll inn", 64.1, -21.5), (-3, "Hóll ytri", 64.1, -21.5), (-4, "Hóll ytri", 64.103, -21.5), (-5, "hvað sem er", 65.0, -20.0), (-6, "gamli bær", None, None), (-7, "annað", 64.1, -21.5), (-8, None, 64.1, -21.5), (-9, "", 64.1, -21.5), (-10, "óll inn", 64.2, -21.5)]
    new = many.select("id", F.concat(F.lit("bær"), F.col("id").cast("string")).alias("title"), F.lit(64.1).alias("lat"), F.lit(-21.5).alias("lon"))
    got = sorted(r.id for r in matching.static_duplicates(new.unionByName(spark.createDataFrame(one, "id long, title string, lat double, lon double")), known).collect())
    assert got == [-9, -6, -5, -3, -2, -1]


def test_texts_are_dealt_before_they_get_their_pieces(spark):
    texts = spark.range(400).select("id", F.concat(F.lit("the title "), F.col("id")).alias("t")).coalesce(1)
    small = texts.where("id < 40").select(F.col("t").alias("s"))
    found = joins.contains_join(small, texts, "s", "t")
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert all("Repartition" in part for part in plan.split("Generate explode")[1:])
    assert found.count() == sum(f"the title {a}" in f"the title {b}" for a in range(40) for b in range(400))
