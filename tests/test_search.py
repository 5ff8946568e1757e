"""The substring index against searches of all items."""

import random

import pytest
from pyspark.sql import functions as F

from tindra.operators import catalogue, search


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    rng = random.Random(2)
    words = ["Troll", "saga", "of", "þoka", "ÞÓR", "hill-man", "a_b", "50%", "x\\y", "ab", "naïve", "zz\nzz", "king"]
    rows = [(i, rng.choice([None, "", " ".join(rng.choices(words, k=3))]), rng.choice([None, "", " ".join(rng.choices(words, k=30))]), rng.choice([None, "t", "src7"])) for i in range(3000)]
    rows += [(5000, "the rare Xylograph", None, None), (5001, None, "x" * 20_000 + "needle" + "y" * 20_000, "t"), (5002, "xylOGRAPH again", "", "src7")]
    df = spark.createDataFrame(rows, "id long, name string, story string, tag string")
    path = str(tmp_path_factory.mktemp("index"))
    search.store(df, path, files=5)
    return df, path


@pytest.mark.parametrize("wanted", ["", "t", "%", "_", "ab", "tr", "xylograph", "needle", "troll saga", "ylo%aph", "a_b", "hill_man", "%%", "þoka", "þór", "ÞÓR", "50%", "zz\nzz", "no such thing", " king ", "k_n_g", "naïve of"])
def test_found_as_without_an_index(spark, stored, wanted):
    df, path = stored
    got = sorted(r.id for r in search.search(spark, path, wanted).collect())
    assert got == sorted(r.id for r in catalogue.search(df, wanted).collect())


def test_few_blocks_are_read(spark, stored):
    _, path = stored
    assert search.candidates(spark, path, "needle").count() == 1
    assert search.candidates(spark, path, "xylograph").count() <= 2
    assert search.candidates(spark, path, "no such thing").count() == 0
    assert search.candidates(spark, path, "ab") is None and search.candidates(spark, path, "a_b%cd") is None
    plan = search.search(spark, path, "needle")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(block," in plan or "In(block," in plan
    posts = spark.read.parquet(f"{path}/postings")
    assert posts.where(F.size("blocks") > search.CHUNK).count() == 0 and posts.groupBy("gram", "chunk").count().where("count > 1").count() == 0


def test_many_blocks_are_joined(spark, stored, monkeypatch):
    df, path = stored
    monkeypatch.setattr(search, "PUSHED", 3)
    got = sorted(r.id for r in search.search(spark, path, "saga of").collect())
    assert got == sorted(r.id for r in catalogue.search(df, "saga of").collect()) and len(got) > 100


def test_empty_table(spark, stored, tmp_path):
    search.store(stored[0].limit(0), str(tmp_path / "none"))
    assert search.search(spark, str(tmp_path / "none"), "needle").count() == 0


@pytest.mark.parametrize("together, held", [(1 << 21, 1 << 22), (50, 100)])
def test_postings_are_the_pieces_of_the_blocks(spark, stored, monkeypatch, together, held):
    monkeypatch.setattr(search, "TOGETHER", together)
    monkeypatch.setattr(search, "HELD", held)
    rows = [(r.block, t) for r in spark.read.parquet(f"{stored[1]}/items").collect() for t in (r._folded_name, r._folded_story)]
    wide = "".join(map(chr, range(0x20000, 0x20000 + 3000)))
    rows += [(7, wide), (7, "ab"), (8, wide[::-1])]
    want = {(t[i : i + 3], b) for b, t in rows for i in range(len(t) - 2)}
    batch = search.pa.RecordBatch.from_pydict({"block": [b for b, _ in rows], search.FOLDED[0]: [t for _, t in rows], search.FOLDED[1]: [None] * len(rows)})
    got = [(g, b) for part in search._cut(iter([batch])) for g, c, bs in zip(*(part.column(k).to_pylist() for k in range(3))) for b in bs if b // search.CHUNK == c]
    assert set(got) == want
    if together < 1000:
        assert len(got) >= len(want)
    else:
        assert len(got) == len(want)


def test_too_many_letters_for_one_number():
    texts, blocks = [chr(0x4E00 + k) + "ab" + chr(0x20000 + k) for k in range(400)], list(range(400))
    whole = sorted(zip(*(x.tolist() for x in search._pieces_of(texts, blocks))))
    assert len(whole) == 800 and len(set(whole)) == 800


def test_stored_texts_are_folded_once(spark, stored):
    plan = search.search(spark, stored[1], "saga of")._jdf.queryExecution().optimizedPlan().toString()
    assert "translate(" not in plan and "_folded_story" in plan
    assert search.search(spark, stored[1], "saga of").columns == stored[0].columns
