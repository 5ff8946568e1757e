"""The pipeline's stages, one after the other, against what each promises."""

import itertools
import random
import zlib

import numpy as np
import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from tindra.llm import decontamination, near_copies, secret_scan, shared, tokens, toxicity  # noqa: E402

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


def test_stages(spark, sf_dir):
    docs = first = shared.table(spark, sf_dir, "documents")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = shared.settle(stage(spark, docs, sf_dir), f"test-{name}")
        assert after.columns == first.columns
        before, kept = {r.doc_id: r.text for r in docs.collect()}, {r.doc_id: r.text for r in after.collect()}
        assert set(kept) <= set(before) and kept
        if name != "secret_scan":
            assert all(before[k] == v for k, v in kept.items())
        if name == "ngram_join":
            assert near_copies.near_copies(after).where("n_links > 0 AND NOT kept").count() == 0
            assert set(kept) == {r.doc_id for r in near_copies.near_copies(docs).where("kept").collect()}
        if name == "decontamination":
            assert decontamination.find_leaks(after, shared.table(spark, sf_dir, "benchmark")).count() == 0
        if name == "secret_scan":
            assert set(kept) == set(before) and secret_scan.scan(after).where("exists(findings, f -> f.secret)").count() == 0
        docs = after
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir)
    assert {r.doc_id for r in pieces.select("doc_id").distinct().collect()} == set(kept)
    assert corpus_pipeline.run(spark, sf_dir).count() == pieces.count()


def test_odd_rows_pass_all_stages(spark, sf_dir):
    docs = spark.createDataFrame([(None, None, "en", "s", 0), (1, "", None, None, None), (2, "a b c d e f g", "en", "s", 13), (3, "a b c d e f g", "en", "s", 13), (4, "x " * 50_000, "de", "s", 1)], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = shared.settle(stage(spark, docs, sf_dir), "test-odd")
    assert {r.doc_id for r in docs.collect()} >= {None, 2}
    assert corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).count() > 0


def plain_score(model, text):
    """The classifier's score, word by word."""
    import pyarrow as pa

    hashed = toxicity.hashed(pa.array([text], pa.string()))
    word, prefix = hashed.slots()
    x, top, col = model.word[word] + model.prefix[prefix], [], 0
    for w, width in enumerate(toxicity.WIDTHS):
        for f in range(toxicity.FILTERS):
            at = [sum(float(x[i + k] @ model.filters[:, (col + k) * toxicity.FILTERS + f]) for k in range(width) if i + k < len(x)) + float(model.bias[w, f]) for i in range(len(x))]
            top.append(max([0.0, *at]))
        col += width
    z = float(np.dot(top, model.out)) + model.base + float(model.shift[hashed.lang[0]])
    return 1 / (1 + np.exp(-z))


def test_run_is_the_plain_version(spark, tmp_path):
    rng = random.Random(21)
    word = lambda: "".join(rng.choices("abcdefghij", k=rng.randint(3, 8)))
    texts, labels = {}, []
    for k in range(420):
        words = [word() for _ in range(rng.randint(20, 50))]
        toxic = rng.random() < 0.3
        if toxic:
            words[rng.randrange(len(words))] = "grublx"
        texts[k] = " ".join(words)
        if rng.random() < 0.9:
            labels.append((k, int(toxic), 1))
    items = [(k, " ".join(word() for _ in range(25)) + ". " + " ".join(word() for _ in range(9)) + ".") for k in range(5)]
    for k in range(420, 440):  # copies, near and exact
        words = texts[k - 420].split()
        words[k % len(words)] = word() if k % 2 else words[k % len(words)]
        texts[k] = " ".join(words)
    for k in range(440, 450):
        texts[k] = " ".join(word() for _ in range(30)) + " " + items[k % 5][1] + " " + " ".join(word() for _ in range(30))
    for k in range(450, 460):
        texts[k] = " ".join(word() for _ in range(30)) + " AKIA" + "".join(rng.choices("ABCDEFGH23456789", k=16)) + " end"
    texts[460], texts[461] = "", None
    sf_dir = str(tmp_path)
    spark.createDataFrame([(k, x, "en", "s", len(x or "")) for k, x in texts.items()], DOCUMENTS).repartition(3).write.parquet(f"{sf_dir}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, toxic int, quality int").write.parquet(f"{sf_dir}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{sf_dir}/benchmark.parquet")

    model = toxicity.train(shared.table(spark, sf_dir, "documents"), shared.table(spark, sf_dir, "labels"), "toxic", ~shared.held_out("doc_id", 4, 2))
    kept = {k: x for k, x in texts.items() if plain_score(model, x) < toxicity.CUT}
    assert 90 < sum("grublx" in (x or "").split() for x in texts.values()) and not any("grublx" in (x or "").split() for x in kept.values())
    grams = {k: {tuple(x.split()[i : i + 5]) for i in range(max(1, len(x.split()) - 4))} for k, x in kept.items() if x}
    first = {k: k for k in kept}
    for a, b in itertools.combinations(sorted(grams), 2):
        if len(grams[a] & grams[b]) * 10 >= 8 * len(grams[a] | grams[b]):
            first = {k: first[a] if v == first[b] else v for k, v in first.items()}
    kept = {k: x for k, x in kept.items() if first[k] == k}
    kept = {k: x for k, x in kept.items() if not any(item in (x or "") for _, item in items)}
    kept = {k: " ".join("[AWS_KEY]" if w.startswith("AKIA") else w for w in x.split()) if "AKIA" in (x or "") else x for k, x in kept.items()}
    tok = tokens.tokenizer(tokens.default_vocabulary()).tok
    ids = {k: [*tok.encode(x or "", add_special_tokens=False).ids, tokens.END_ID] for k, x in kept.items()}

    pieces = corpus_pipeline.run(spark, sf_dir).collect()
    assert {p.doc_id for p in pieces} == set(ids) and len(kept) < 350
    for k, want in ids.items():
        own = sorted((p.start, p.length, p.ids_crc32, p.doc_tokens) for p in pieces if p.doc_id == k)
        assert [s for s, *_ in own] == np.cumsum([0, *(n for _, n, *_ in own)])[:-1].tolist() and sum(n for _, n, *_ in own) == len(want)
        assert all(c == zlib.crc32(np.array(want[s : s + n], "<u4").tobytes()) and d == len(want) for s, n, c, d in own)


def test_empty_tables_pass(spark, tmp_path):
    for name, schema in (("documents", DOCUMENTS), ("labels", "doc_id long, toxic int, quality int"), ("benchmark", "item_id long, text string")):
        spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
