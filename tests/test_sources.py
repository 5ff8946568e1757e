import json
import zipfile
import zlib
from io import BytesIO

import pytest
from pyspark.sql import functions as F

from tindra.sources import archives, documents, services

ROWS = [{"Name": "a", "Story": "x"}, {"Name": "b", "Story": None}]


def test_json_forms(spark, tmp_path):
    (tmp_path / "items.json").write_text(json.dumps({"items": ROWS}))
    (tmp_path / "array.json").write_text(json.dumps(ROWS))
    (tmp_path / "fenced.json").write_text("```json\n" + json.dumps(ROWS) + "\n```\n")
    want = [("a", "x"), ("b", None)]
    schema = "Name string, Story string"
    for read, name in ((documents.items_document, "items"), (documents.array_document, "array"), (documents.fenced_array, "fenced")):
        assert sorted(tuple(r) for r in read(spark, str(tmp_path / f"{name}.json"), schema).collect()) == want
    both = documents.tagged_union([(spark.createDataFrame([("a",)], "n string"), {"file": "1"}), (spark.createDataFrame([("b",)], "n string"), {"file": "2"})])
    assert sorted(tuple(r) for r in both.collect()) == [("a", "1"), ("b", "2")]
    filled = documents.with_defaults(spark.createDataFrame([(None,), ("",)], "tag string"), {"tag": "Saga", "ref": "r"})
    assert sorted(tuple(r) for r in filled.collect()) == [("", "r"), ("Saga", "r")]


def test_export_archive(spark):
    items = spark.createDataFrame([(2, "þ"), (1, "a")], "id long, name string")
    with zipfile.ZipFile(BytesIO(documents.export_archive(dict(zip(documents.export_names("ENG"), (items, items.limit(0))))))) as z:
        assert json.loads(z.read("travel_eng.json")) == [{"id": 1, "name": "a"}, {"id": 2, "name": "þ"}]
        assert json.loads(z.read("areas_eng.json")) == []


def test_settings(tmp_path):
    (tmp_path / "env").write_text("# c\n\nA='x=y'\nB=2\nbad\n")
    assert documents.settings(str(tmp_path / "env"), {"B": "3"}) == {"A": "x=y", "B": "3"}


def fetch_page(page):
    if page == 5:
        raise OSError("gone")
    return [(page, f"t{page}")] if page < 4 else []


def test_pages(spark):
    services.register(spark)
    got = spark.read.format("tindra_pages").options(schema="id int, title string", fetch="tests.test_sources:fetch_page", pages=9, pagesPerTask=9).load()
    assert sorted(r.id for r in got.collect()) == [1, 2, 3]


def test_batches_and_points(spark):
    ids = spark.range(45)
    got = services.in_batches(ids, "id", "id", lambda batch: {k: f"c{k}" for k in batch if k % 2} if len(batch) <= 20 else {})
    assert {r.id: r.content for r in got.collect()} == {k: f"c{k}" if k % 2 else "" for k in range(45)}
    points = spark.createDataFrame([(1.0, 2.0), (3.0, 4.0)], "lat double, lon double")
    hits = services.per_point(points, lambda lat, lon: [(int(lat),), (int(lon),)] if lat < 2 else 1 / 0, "page long")
    assert sorted((r.hit, r.page) for r in hits.collect()) == [(0, 1), (1, 2)]


@pytest.mark.parametrize("wave, most", [(1, 99), (4, 99), (16, 99), (16, 2)])
def test_pages_end_for_all_tasks(spark, wave, most):
    """Page 6 is empty though later ones are not."""
    calls = spark.sparkContext.accumulator(0)

    def fetch(page):
        calls.add(1)
        return [(page * 10 + k, "x") for k in range(3)] if page not in (6, 9) else []

    rows, end = services.pages(spark, fetch, "id long, title string", wave=wave, most=most)
    last = min(5, most)
    assert sorted(r.id for r in rows.collect()) == [p * 10 + k for p in range(1, last + 1) for k in range(3)]
    assert end == last + 1 and calls.value <= min(6 + wave - 1, most)
    more, end = services.pages(spark, fetch, "id long, title string", first=7, wave=wave)
    assert {r.page for r in more.collect()} == {7, 8} and end == 9
    failing = services.pages(spark, fetch_page, "id long, title string", first=5)
    assert failing[0].count() == 0 and failing[1] == 5


def test_batches_follow_the_whole_order(spark):
    seen = spark.range(95).repartition(6).select(((F.col("id") * 37) % 95).alias("id"))
    got = {r.id: r.content for r in services.in_batches(seen, "id", "id", lambda batch: {k: f"{batch[0]}-{batch[-1]}" for k in batch}).collect()}
    assert got == {k: f"{k // 20 * 20}-{min(94, k // 20 * 20 + 19)}" for k in range(95)}


def test_external_stage(spark):
    df = spark.createDataFrame([("a", "A"), ("b", "b")], "x string, y string")
    got = services.external_stage(df, ["x", "y"], lambda a, b: "SAME" if a == b.lower() else "DIFFERENT")
    assert [r.result for r in got.collect()] == ["SAME", "SAME"]
    audio = services.rendered(df.select(F.lit(1).alias("id"), F.col("x").alias("text")), lambda k, t: t.encode())
    assert sorted(r.data for r in audio.collect()) == [b"a", b"b"]


@pytest.mark.parametrize("rows", [0, 1, 7, 20_000])
def test_written_archive(spark, tmp_path, rows):
    """Many tasks' blocks, read by the standard library."""
    df = spark.range(rows).repartition(7).withColumn("name", F.when(F.col("id") % 5 > 0, F.concat(F.lit("Þ \" \n"), F.repeat(F.lit("x y"), (F.col("id") % 9).cast("int")))))
    small = spark.createDataFrame([(2, "b"), (None, "n"), (1, "a")], "id long, caption string")
    path = str(tmp_path / "out.zip")
    archives.write_archive({"travel.json": df, "areas.json": small, "ü.json": small.limit(0)}, path)
    with zipfile.ZipFile(path) as z:
        assert z.testzip() is None and z.namelist() == ["travel.json", "areas.json", "ü.json"]
        got = json.loads(z.read("travel.json"))
        assert got == [{"id": k, "name": 'Þ " \n' + "x y" * (k % 9) if k % 5 else None} for k in range(rows)]
        assert json.loads(z.read("areas.json")) == [{"id": None, "caption": "n"}, {"id": 1, "caption": "a"}, {"id": 2, "caption": "b"}]
        assert json.loads(z.read("ü.json")) == []


def test_joined_checksums():
    for a, b in ((b"", b""), (b"a", b""), (b"", b"b"), (b"hello ", b"world" * 1000)):
        assert archives.joined_crc(zlib.crc32(a), zlib.crc32(b), len(b)) == zlib.crc32(a + b)


def test_sqlite(spark, tmp_path):
    import sqlite3

    from tindra.sources.sqlite import sqlite_table

    path = str(tmp_path / "a.gpkg")
    with sqlite3.connect(path) as db:
        db.execute("CREATE TABLE t (name TEXT, geom BLOB, n INTEGER)")
        db.executemany("INSERT INTO t VALUES (?, ?, ?)", [(f"n{i}", bytes([i]), i) for i in range(20)])
    got = sqlite_table(spark, path, "t", "name string, geom binary", where="n >= 5", parts=4)
    assert sorted((r.name, bytes(r.geom)) for r in got.collect()) == sorted((f"n{i}", bytes([i])) for i in range(5, 20))
    assert got.rdd.getNumPartitions() == 4


def test_article_of_english_wins(spark):
    from tindra.operators import ingest

    long = "x" * 120
    rows = [(1, "B", 64.1, -21.0, "is", long), (2, "A", 64.1001, -21.0, "en", long), (3, "Near", 64.5, -21.0, "en", long), (4, "C", 65.0, -21.0, "is", "short"), (5, "Known", 66.0, -20.0, "is", long)]
    articles = spark.createDataFrame(rows, "pageid long, title string, lat double, lon double, lang string, extract string")
    known = spark.createDataFrame([("Known,-þjóðsaga", None), ("Near the hill", "64.501,-21.0")], "name string, gps string")
    got = {r.id: (r.name, r.story_eng, r.char_count) for r in ingest.new_articles(articles, known).collect()}
    assert got == {"en_2": ("A", long, 120)}
    text = spark.createDataFrame([(1.0005, 2.5)], "a double, b double")
    assert text.select(ingest.formatted_gps(F.col("a"), F.col("b"), 3)).first()[0] == "1.000, 2.500"
    assert spark.sql("SELECT '2024-01-02 03:04:05' AS t UNION ALL SELECT '2024-01-02T03:04:05.123456' UNION ALL SELECT 'x'").select(ingest.last_changed(F.col("t")).isNotNull().alias("k")).where("k").count() == 2


def test_jdbc_table_in_ranges(spark):
    url = "jdbc:derby:memory:tindra;create=true"
    driver = "org.apache.derby.iapi.jdbc.AutoloadedDriver"
    spark.range(50).selectExpr("id AS key", "concat('n', id) AS name").write.jdbc(url, "things", "overwrite", {"driver": driver})
    got = documents.jdbc_table(spark, url, "things", "key", 0, 50, 4, driver=driver)
    assert got.rdd.getNumPartitions() == 4 and sorted((r.KEY if "KEY" in got.columns else r.key) for r in got.collect()) == list(range(50))
