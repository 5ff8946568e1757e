"""Inputs that the synthetic tables lack, made from them by rule: headings, places, inflected names,
tales, geometry blobs, sentences, and a lattice."""

from __future__ import annotations

import struct

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tindra.functions import geo, text
from tindra.operators import headings as headings_ops
from tindra.plans.catalog import POINTS, _sql, points, table

# Ten headings a page: level, text and link follow from page and place.
HEADINGS = """
SELECT page_id, pos, CASE WHEN k % 5 = 0 THEN 1 WHEN k % 5 = 1 THEN 2 ELSE 3 END AS level,
  CASE WHEN k % 13 = 0 THEN 'Menu ' || cast(pos AS string) WHEN k % 17 = 0 THEN 'Chrome' WHEN k % 19 = 0 THEN '' ELSE 'H' || cast(k AS string) END AS text,
  CASE WHEN k % 5 > 1 AND k % 7 > 0 THEN 'https://is.site.example/item-' || cast(k AS string) || '/' WHEN k % 11 = 1 THEN 'https://is.site.example/item-' || cast(k AS string) WHEN k % 11 = 2 THEN 'https://is.site.example/listing-' || cast(k AS string) WHEN k % 11 = 3 THEN 'https://other.example/a/b' END AS href
FROM (SELECT page_id, cast(i AS bigint) AS pos, page_id * 31 + i * 7 AS k FROM pages, (VALUES (0), (1), (2), (3), (4), (5), (6), (7), (8), (9)) v(i)) x
"""
ITEM_SQL = "coalesce(regexp_matches(href, '^https://is\\.site\\.example/item-[^/]+/?$'), false)"


def headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sql(spark, sf_dir, HEADINGS, "pages")


def is_item(df: DataFrame) -> Column:
    return headings_ops.single_part_link(F.col("href"), "is.site.example", "listing-")


def grid(spark: SparkSession, south: float, north: float, west: float, east: float, step_km: float) -> DataFrame:
    """Points ``step_km`` apart; a row's spacing in longitude follows its latitude."""
    step = geo.degrees_lat(step_km)
    rows = spark.range(int((north - south) / step) + 1).select(F.col("id").alias("i"), (F.lit(south) + F.col("id") * step).alias("lat")).where(F.col("lat") <= north)
    wide = geo.degrees_lon(step_km, F.col("lat"))
    return rows.withColumn("_w", wide).withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((east - west) / F.col("_w") + 1)))).withColumn("lon", F.lit(west) + F.col("j") * F.col("_w")).where(F.col("lon") <= east).drop("_w")


# A small gazetteer of made-up places, and inflected forms of some.
PLACES = ("Breiðfjörður", "Kaldidalur", "Þingvellir", "Hólar", "Egilsstaðir", "Garðabær", "Snæfell", "Langanes", "Öræfi", "Höfði", "Síða", "Jökull", "Reykholt", "Hvammur", "Vík", "Landmannalaugar")
FORMS = ("Breiðfirði", "Breiðfjarðar", "Kaldadal", "Kaldidalinn", "Kaldidals", "Þingvöllum", "Hólum", "Egilsstöðum", "Garðabæ", "Snæfelli", "Langanesjum", "Öræfum", "Höfða", "Síðu", "Jökli", "Reykholti", "Hvammi", "Landmanna", "Vík", "Ekkert", "Hólar")
_PLACES = ", ".join(f"({i}, '{p}', {63.5 + i / 10}, {-20 - i / 10})" for i, p in enumerate(PLACES))
_FORMS = ", ".join(f"('{f}')" for f in FORMS)


def _rows(spark: SparkSession, values: str, names: str) -> DataFrame:
    return spark.sql(f"SELECT * FROM VALUES {values} AS t({names})")


def gazetteer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The places, and two names from nations for each."""
    fixed = _rows(spark, _PLACES, "id, place, lat, lon").select(F.col("id").cast("long"), "place", F.col("lat").cast("double"), F.col("lon").cast("double"))
    nations = table(spark, sf_dir, "nation").select((F.col("n_nationkey") + 100).cast("long").alias("id"), text.cap_first(F.lower("n_name")).alias("place"), F.lit(64.0).alias("lat"), F.lit(-21.0).alias("lon"))
    return fixed.unionByName(nations)


def inflected(spark: SparkSession, sf_dir: str) -> DataFrame:
    forms = _rows(spark, _FORMS, "name")
    nations = table(spark, sf_dir, "nation").select(F.concat(text.cap_first(F.lower("n_name")), F.lit("s")).alias("name"))
    return forms.unionByName(nations)


def gazetteer_sql(names: str, before: str = "") -> str:
    """The lookup as SQL for the names of a statement: rules as a table, and the partial tier; a common
    table ``found`` of name, place_id and tier, after the common tables ``before``."""
    from tindra.operators.geocoding import ENDINGS, IRREGULAR

    rules = ", ".join(f"({i}, '{e}', '{n}')" for i, (e, n) in enumerate(ENDINGS))
    irregular = ", ".join(f"('{k}', '{v}')" for k, v in IRREGULAR.items())
    return f"""WITH {before} g AS (SELECT * FROM (VALUES {_PLACES}) t(id, place, lat, lon) UNION ALL SELECT n_nationkey + 100, {CAPITAL}, 64.0, -21.0 FROM nation),
      f AS (SELECT DISTINCT name FROM ({names}) u),
      r AS (SELECT * FROM (VALUES {rules}) t(i, e, n)),
      tried AS (SELECT name, 0 AS rule, name AS form FROM f UNION ALL SELECT name, 1, v FROM f JOIN (VALUES {irregular}) t(k, v) ON lower(name) = k
        UNION ALL SELECT name, 2 + 2 * i, left(name, length(name) - length(e)) || n FROM f JOIN r ON ends_with(lower(name), e) AND length(name) > length(e)
        UNION ALL SELECT name, 3 + 2 * i, left(s, length(s) - 1) FROM (SELECT name, i, left(name, length(name) - length(e)) || n AS s FROM f JOIN r ON ends_with(lower(name), e) AND length(name) > length(e)) q WHERE ends_with(s, 's') AND length(s) > 4),
      hit AS (SELECT name, rule, id, row_number() OVER (PARTITION BY name ORDER BY rule, id) AS k FROM tried JOIN g ON g.place = form),
      part AS (SELECT f.name, g.id, row_number() OVER (PARTITION BY f.name ORDER BY g.id) AS k, count(*) OVER (PARTITION BY f.name) AS n FROM f JOIN g ON starts_with(lower(g.place), lower(f.name)) WHERE f.name NOT IN (SELECT name FROM hit)),
      found AS (SELECT name, cast(id AS bigint) AS place_id, CASE WHEN rule = 0 THEN 'direct' WHEN rule = 1 THEN 'irregular' ELSE 'ending' END AS tier FROM hit WHERE k = 1
        UNION ALL SELECT name, cast(id AS bigint), 'partial' FROM part WHERE k = 1 AND n <= 5)"""


CAPITAL = "upper(left(lower(n_name), 1)) || substr(lower(n_name), 2)"
GAZETTEER_SQL = f"{gazetteer_sql(f'SELECT * FROM (VALUES {_FORMS}) t(name) UNION ALL SELECT {CAPITAL} || {chr(39)}s{chr(39)} FROM nation')} SELECT * FROM found"


def tales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Short texts that name places, one per benchmark item."""
    n = F.col("item_id")
    forms = F.array(*(F.lit(f) for f in FORMS))
    form = lambda k: F.element_at(forms, (F.pmod(n * 7 + k, F.lit(len(FORMS))) + 1).cast("int"))
    title = F.when(n % 3 == 0, F.concat(F.lit("Sagan frá "), form(0))).when(n % 3 == 1, form(1)).otherwise(F.lit("Saga"))
    body = F.concat(F.lit("Einu sinni bjó bóndi á "), form(2), F.lit(", og fór hann til "), form(3), F.lit(". Þar var prestur í "), form(4), F.lit(" og herra frá Húsfrey. "), form(2), F.lit(" er stór. "), F.col("text"))
    return table(spark, sf_dir, "benchmark").select(n.alias("id"), title.alias("title"), body.alias("body"))


def _tales_sql() -> str:
    forms = "[" + ", ".join(f"'{f}'" for f in FORMS) + "]"
    form = lambda k: f"{forms}[cast((item_id * 7 + {k}) % {len(FORMS)} + 1 AS bigint)]"
    return f"""SELECT item_id AS id, CASE item_id % 3 WHEN 0 THEN 'Sagan frá ' || {form(0)} WHEN 1 THEN {form(1)} ELSE 'Saga' END AS title,
      'Einu sinni bjó bóndi á ' || {form(2)} || ', og fór hann til ' || {form(3)} || '. Þar var prestur í ' || {form(4)} || ' og herra frá Húsfrey. ' || {form(2)} || ' er stór. ' || coalesce(text, '') AS body FROM benchmark"""


def _candidates_sql() -> str:
    """Common tables up to ``cand`` (id, pos, name, found_in) of the tales."""
    from tindra.operators.geocoding import AFTER_PREPOSITION, AFTER_ROLE, BY_SUFFIX, LEAST_CHARS, NOT_PLACES, TEXT_CHARS

    bare = lambda p: p.replace("(?U)", "").replace("'", "''")
    head = f"left(body, {TEXT_CHARS})"
    passes = [("title", AFTER_PREPOSITION, "title"), ("title", BY_SUFFIX, "title"), (head, AFTER_PREPOSITION, "text"), (head, AFTER_ROLE, "text"), (head, BY_SUFFIX, "text")]
    lists = " || ".join(f"list_transform(regexp_extract_all({c}, '{bare(p)}', 1), lambda x: {{'name': x, 'found_in': '{w}'}})" for c, p, w in passes)
    not_places = ", ".join(f"'{x}'" for x in NOT_PLACES)
    return f"""tale AS ({_tales_sql()}), raw AS (SELECT id, unnest(l) AS c, generate_subscripts(l, 1) - 1 AS pos FROM (SELECT id, {lists} AS l FROM tale) x),
      named AS (SELECT id, pos, regexp_replace(trim(c.name), '[.,;:!?]+$', '') AS name, c.found_in AS found_in FROM raw),
      cand AS (SELECT id, cast(pos AS bigint) AS pos, name, found_in FROM named WHERE length(name) >= {LEAST_CHARS} AND lower(name) NOT IN ({not_places}) QUALIFY row_number() OVER (PARTITION BY id, lower(name) ORDER BY pos) = 1)"""


PLACE_CANDIDATES_SQL = f"WITH {_candidates_sql()} SELECT * FROM cand"
GEOCODED_SQL = f"""{gazetteer_sql('SELECT name FROM cand', _candidates_sql() + ',')}
    SELECT id, place, found_in, CASE WHEN found_in = 'title' THEN 'title_match' ELSE 'text_match' END AS confidence FROM (
      SELECT c.id, p.place, c.found_in, row_number() OVER (PARTITION BY c.id ORDER BY CASE WHEN c.found_in = 'title' THEN 0 ELSE 1 END, c.pos) AS r
      FROM cand c JOIN found USING (name) JOIN g p ON p.id = found.place_id WHERE p.lat BETWEEN 63 AND 67 AND p.lon BETWEEN -25 AND -13) z WHERE r = 1"""


def blob(kind: int, x: float | None = None, y: float | None = None) -> bytes:
    """A geometry blob of every form in turn: byte orders, envelopes, shapes, and two bad ones."""
    little = kind % 2 == 0
    o, flag = ("<", 1) if little else (">", 0)
    envelope = kind % 5
    head = b"GP\x00" + bytes([envelope << 1 | flag]) + struct.pack("<I", 4326) + bytes((0, 32, 48, 48, 64)[envelope])
    x, y = (-20.0 - kind / 10, 64.0 + kind / 10) if x is None else (x, y)
    whole = lambda t: bytes([flag]) + struct.pack(o + "I", t)
    pairs = lambda pts: struct.pack(f"{o}{2 * len(pts)}d", *(c for p in pts for c in p))
    pt = whole(1) + pairs([(x, y)])
    line_pts = [(x + i, y + i / 2) for i in range(3 + kind % 2)]
    line = whole(1002) + struct.pack(o + "I", len(line_pts)) + pairs(line_pts)
    ring = [(x, y), (x + 2, y), (x + 2, y + 2), (x, y)]
    poly = whole(3) + struct.pack(o + "II", 1, len(ring)) + pairs(ring)
    shapes = [pt, line, poly, whole(4) + struct.pack(o + "I", 2) + pt + pt, whole(5) + struct.pack(o + "I", 1) + line, whole(6) + struct.pack(o + "I", 1) + poly, whole(2) + struct.pack(o + "I", 0)]
    if kind % 9 == 7:
        return b"XX" + head[2:] + pt
    if kind % 9 == 8:
        return head[:6]
    return head + shapes[kind % len(shapes)]


def blobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A blob per point of the catalogue's second table, of the form that its id names."""
    made = F.pandas_udf(lambda i, x, y: pd.Series([blob(k, a, b) for k, a, b in zip(i, x, y)]), "binary")
    return points(spark, sf_dir).select("id", made("id", "lon", "lat").alias("geom"))


# What the blobs stand for, by the rule that makes them: kinds 7 and 8 of nine are bad, then seven shapes.
POINTS_SQL = f"""SELECT id, CASE WHEN k % 9 >= 7 OR k % 7 = 6 THEN NULL WHEN k % 7 = 1 THEN x + half WHEN k % 7 = 4 THEN x + half WHEN k % 7 IN (2, 5) THEN (x + (x + 2) + (x + 2) + x) / 4 ELSE x END AS lon,
      CASE WHEN k % 9 >= 7 OR k % 7 = 6 THEN NULL WHEN k % 7 = 1 THEN y + half / 2.0::double WHEN k % 7 = 4 THEN y + half / 2.0::double WHEN k % 7 IN (2, 5) THEN (y + y + (y + 2) + y) / 4 ELSE y END AS lat
    FROM (SELECT id, id AS k, lon AS x, lat AS y, (3 + id % 2) // 2 AS half FROM ({POINTS.replace('1000.0D', '1000.0::double')}) pts) b"""
SENTENCES = ("Fjallið er {n} m hátt.", "Stofnað, {n}", "Árið {n} komu {k} menn.", "Á {k}. öld og um miðja {k}. öld.", "Þann {k}. júní {n} kl. 12", "{k}.06.{n} - 25% MH NATO II", "5-7 km og {n} krónur í {k} daga", "{n}-{n} t.d. í NA átt & víðar (1,2,3)")


def sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences with numbers, one per part."""
    k, n = (F.col("p_partkey") % 31 + 1).cast("string"), (F.col("p_partkey") * 37 % 2200).cast("string")
    forms = F.array(*(F.lit(s) for s in SENTENCES))
    picked = F.element_at(forms, (F.col("p_partkey") % len(SENTENCES) + 1).cast("int"))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.replace(F.replace(picked, F.lit("{n}"), n), F.lit("{k}"), k).alias("text"))


def _speech_sql() -> str:
    """What is said of each sentence, form by form, over tables of number words."""
    from tindra.functions import speech

    words = lambda values: "[" + ", ".join(f"'{v}'" for v in values) + "]"
    forms = {"n": ("nom", "n"), "m": ("nom", "m"), "f": ("nom", "f"), "g": ("gen", "m")}
    alone = {value: word for value, word, _ in speech.SCALE}
    units = " ".join(f"WHEN '{k}' THEN {words(['', *speech.FORMS[case][gender], *(alone[v] for v in range(5, 20))])}" for k, (case, gender) in forms.items())
    tens = words([alone[v] for v in range(20, 100, 10)])
    linked = "CASE WHEN len(p) = 1 THEN p[1] ELSE array_to_string(p[1:len(p) - 1], ' ') || CASE WHEN contains(' ' || p[len(p)] || ' ', ' og ') THEN ' ' ELSE ' og ' END || p[len(p)] END"
    days = [speech.DAYS[k] for k in range(20)]
    weak = ["annarri" if k == 2 else "tuttugustu" if k == 20 else w[:-1] + "u" for k, w in enumerate(speech.CENTURIES, 1)]
    c = lambda form, x="n": f"(SELECT w FROM c WHERE c.form = '{form}' AND c.x = s.{x})"
    year = "(SELECT w FROM y WHERE y.x = s.n)"
    dated, big = "s.n BETWEEN 1000 AND 2099", "s.n >= 100"
    day = f"CASE WHEN k <= 20 THEN {words(days)}[k] WHEN k < 30 THEN 'tuttugasta og ' || {words(days)}[k - 20] WHEN k = 30 THEN 'þrítugasta' ELSE 'þrítugasta og fyrsta' END"
    century = f"CASE WHEN k <= 20 THEN {words(weak)}[k] || ' öld' WHEN k = 21 THEN 'tuttugustu og fyrstu öld' ELSE {{}} || '. öld' END"
    tail = " prósent emm há NATO II'"

    def said(local: bool) -> str:
        num = lambda form, x="n": c(form, x) if local else f"cast(s.{x} AS varchar)"
        some = f"CASE WHEN {dated} THEN {year} ELSE {num('n')} END"
        of_year = f"CASE WHEN {dated}{f' OR {big}' if local else ''} THEN {year} ELSE {num('n')} END"
        era = century.format(num("n", "k"))
        quarter = "tuttugu og fimm" if local else "25"
        return f"""CASE s.t WHEN 0 THEN 'Fjallið er ' || {num('g')} || ' metrar hátt.' WHEN 1 THEN 'Stofnað, ' || {some}
          WHEN 2 THEN 'Árið ' || {of_year} || ' komu ' || {num('n', 'k')} || ' menn.' WHEN 3 THEN 'Á ' || {era} || ' og um miðja ' || {era} || '.'
          WHEN 4 THEN 'Þann ' || {day} || ' júní ' || {some} || ' kl. {'tólf' if local else '12'}'
          WHEN 5 THEN CASE WHEN s.n < 10 THEN {num('n', 'k')} || '.{'sex' if local else '06'}.' || {num('n')} || ' til {quarter}{tail} WHEN {dated} THEN {day} || ' júní ' || {year} || ' - {quarter}{tail} ELSE {day} || ' júní ' || {num('n')} || ' til {quarter}{tail} END
          WHEN 6 THEN '{'fimm til sjö' if local else '5 til 7'} kílómetrar og ' || {num('f')} || ' krónur í ' || {num('m', 'k')} || ' daga'
          ELSE {some} || ' til ' || {some} || ' til dæmis í norðaustur átt og víðar ' END"""

    return f"""WITH b AS (SELECT form, x, CASE WHEN x = 0 THEN 'núll' WHEN x < 20 THEN u[x + 1] WHEN x % 10 = 0 THEN d[x // 10 - 1] ELSE d[x // 10 - 1] || ' og ' || u[x % 10 + 1] END AS w
        FROM (SELECT form, x, CASE form {units} END AS u, {tens} AS d FROM (VALUES ('n'), ('m'), ('f'), ('g')) v(form), range(100) r(x)) q),
      c AS (SELECT form, x, {linked} AS w FROM (SELECT r.form, h.x, list_filter([CASE WHEN h.x >= 1000 THEN t.w || ' þúsund' END, CASE WHEN h.x // 100 % 10 = 1 THEN 'hundrað' WHEN h.x // 100 % 10 > 1 THEN e.w || ' hundruð' END, CASE WHEN h.x % 100 > 0 OR h.x = 0 THEN r.w END], lambda z: z IS NOT NULL) AS p
        FROM range(2200) h(x) JOIN b t ON t.form = 'n' AND t.x = h.x // 1000 JOIN b e ON e.form = 'n' AND e.x = h.x // 100 % 10 JOIN b r ON r.x = h.x % 100) q),
      y AS (SELECT x, CASE WHEN x < 1100 THEN (SELECT w FROM c WHERE c.form = 'n' AND c.x = q.x) ELSE {linked} END AS w FROM (SELECT h.x, list_filter([CASE WHEN h.x // 100 = 20 THEN 'tvö þúsund' ELSE e.w || ' hundruð' END, CASE WHEN h.x % 100 > 0 THEN r.w END], lambda z: z IS NOT NULL) AS p
        FROM range(100, 2200) h(x) JOIN b e ON e.form = 'n' AND e.x = h.x // 100 JOIN b r ON r.form = 'n' AND r.x = h.x % 100) q),
      s AS (SELECT p_partkey AS id, p_partkey % 8 AS t, p_partkey % 31 + 1 AS k, p_partkey * 37 % 2200 AS n FROM part)
    SELECT id, {said(True)} AS local, {said(False)} AS cloud FROM s"""


SPEECH_SQL = _speech_sql()
COLOURS = [("STEEL", "grey"), ("BRASS", "yellow"), ("COPPER", "red")]


def small_rules(part: DataFrame) -> DataFrame:
    """The short text rules, one column each."""
    kind, name, key = F.col("p_type"), F.col("p_name"), F.col("p_partkey")
    quoted = F.when(key % 3 == 0, F.concat(F.lit('"'), name, F.lit('"'))).when(key % 3 == 1, F.concat(F.lit("'"), name, F.lit('"'))).otherwise(name)
    reply = F.when(key % 2 == 0, F.concat(name, F.lit(" --- "), kind)).otherwise(F.concat(name, F.lit("\n"), kind))
    caption, body = text.caption_and_text(reply, "---")
    return part.select(
        "p_partkey", text.tag_colour(kind, COLOURS, "blue").alias("colour"), text.radius_label((key * 137 % 4000).cast("long")).alias("label"), text.html_escaped(F.concat(F.lit("<a href='x'>&"), name, F.lit('"'))).alias("escaped"),
        text.unquoted(quoted).alias("bare"), caption.alias("caption"), body.alias("body"), F.replace(F.concat(name, F.lit(",-"), kind), F.lit(",-"), F.lit(", ")).alias("legacy"), text.strip_marks(F.concat(F.lit("Þórður á "), name)).alias("unmarked"),
        text.feature_story(text.cap_first(name), F.when(key % 2 == 0, F.lit("Hóll")), F.lit("hóll"), F.lit("Note."), F.when(key % 5 == 0, F.lit("Er ekki til")), F.when(key % 3 == 0, F.lit("Lítil hæð."))).alias("story"),
        text.article_url(F.when(key % 2 == 0, "is").otherwise("de"), name).alias("article"), F.size(F.split(F.concat(F.lit("a\n\nb "), name, F.lit("\n \n\nc")), "\n\\s*\n+", -1)).cast("long").alias("paragraphs"), F.array_join(F.split(F.lit("x;y;z"), ";", -1), "; ").alias("tags"),
    )


SMALL_RULES_SQL = """WITH q AS (SELECT *, CASE WHEN p_partkey % 3 = 0 THEN '"' || p_name || '"' WHEN p_partkey % 3 = 1 THEN '''' || p_name || '"' ELSE p_name END AS qn FROM part)
SELECT p_partkey, CASE WHEN contains(p_type, 'STEEL') THEN 'grey' WHEN contains(p_type, 'BRASS') THEN 'yellow' WHEN contains(p_type, 'COPPER') THEN 'red' ELSE 'blue' END AS colour,
  CASE WHEN p_partkey * 137 % 4000 >= 1000 THEN cast(cast(floor((p_partkey * 137 % 4000) / 1000.0 + 0.5) AS bigint) AS varchar) || ' km' ELSE cast(p_partkey * 137 % 4000 AS varchar) || ' m' END AS label,
  '&lt;a href=&#39;x&#39;&gt;&amp;' || p_name || '&quot;' AS escaped, CASE WHEN p_partkey % 3 = 0 THEN trim(qn, '"') ELSE qn END AS bare, p_name AS caption, p_type AS body, p_name || ', ' || p_type AS legacy, 'Þorður a ' || p_name AS unmarked,
  upper(left(p_name, 1)) || substr(p_name, 2) || CASE WHEN p_partkey % 2 = 0 THEN ' (Hóll)' ELSE '' END || ' er hóll' || CASE WHEN p_partkey % 5 = 0 THEN ' sem er ekki lengur til.  ' ELSE '.  ' END || CASE WHEN p_partkey % 3 = 0 THEN chr(10) || chr(10) || 'Hóll er lítil hæð.' ELSE '' END || chr(10) || chr(10) || 'Note.' AS story,
  'https://' || CASE WHEN p_partkey % 2 = 0 THEN 'is' ELSE 'en' END || '.wikipedia.org/wiki/' || replace(p_name, ' ', '_') AS article, cast(3 AS bigint) AS paragraphs, 'x; y; z' AS tags FROM q"""
