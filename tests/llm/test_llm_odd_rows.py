"""Brute-force search of benchmark items, and odd rows of the training-data operators."""

import hashlib
import random
import shutil
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tessera.llm import decontaminate, language, media, mixing, toxicity


def nearest_stretch(item, text):
    """The least edit distance of an item to any stretch of a text."""
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        new = [i]
        for j, t in enumerate(text, 1):
            new.append(min(row[j - 1] + (c != t), row[j] + 1, new[j - 1] + 1))
        row = new
    return min(row)


def test_items_against_edit_distances_to_every_stretch(spark):
    rng, items, docs = random.Random(12), [], []
    letters = lambda n: "".join(rng.choice("abcd ") for _ in range(n))
    for k in range(25):
        items.append((k, decontaminate.fold(letters(rng.randrange(14, 90)))))
    for k in range(60):
        t = list(rng.choice(items)[1] if k % 4 else letters(60))
        for _ in range(rng.randrange(0, 9)):
            at = rng.randrange(len(t))
            t[at : at + rng.randrange(2)] = rng.choice(["", "a", "b", "zz"])
        docs.append((k, letters(rng.randrange(40)) + "".join(t) + letters(rng.randrange(40))))
    found = decontaminate.find_items(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    got = {(r.doc_id, r.item_id): r.distance for r in found.collect()}
    want = {}
    for k, text in docs:
        for i, item in items:
            d = nearest_stretch(item, decontaminate.fold(text))
            if len(item) > 12 and d <= int(0.08 * len(item)):
                want[k, i] = d
    assert len(want) > 20 and len({d for d in want.values()}) > 2
    assert got == want


KIND = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Tables beside the documents of a pipeline run."""
    d = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame([(1, 1, 0), (2, 0, 1), (None, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, "what is the capital of the country?"), (None, None)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d


@pytest.mark.parametrize("rows", [[], [(None,) * 5] * 3, [(1, None, None, None, None), (None, "", "en", "s", 0), (2, " ", "en", None, 1)]])
def test_pipeline_of_odd_tables(spark, folder, rows):
    docs = spark.createDataFrame(rows, KIND)
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder)
        if name != "mixing":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
    assert docs.count() <= len(rows)


def test_two_runs_leave_each_other_alone(spark, folder, tmp_path):
    d = str(tmp_path / "t")
    shutil.copytree(folder, d)
    spark.createDataFrame([(i, f"text of document number {i} and so on", "en", f"s{i % 3}", 30) for i in range(30)], KIND).write.parquet(f"{d}/documents.parquet")
    with ThreadPoolExecutor(2) as pool:
        counts = list(pool.map(lambda _: corpus_pipeline.run(spark, d).count(), range(2)))
    assert counts == [counts[0]] * 2 and counts[0] > 0


def test_mixing_null_and_repeated_keys(spark):
    rows = [(None, "a b c", "s"), (None, None, None), (4, "a b c d e f", "s"), (4, "a b c d e f", "s"), (5, "x " * 500, "t"), (6, "", "t")]
    out = mixing.mix_sources(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert len(out) == len(rows) and all(0 <= r.taken <= 2 * r.size for r in out) and sum(r.size for r in out) == 515


def test_toxicity_ties_repeats_and_long_texts(spark):
    kind = "doc_id long, text string, toxicity string"
    texts = [f"word{i % 7} and other{i % 5} things of day {i}" for i in range(60)]
    rows = [(i, t + (" vile scoundrel" if i % 3 == 0 else ""), "mine") for i, t in enumerate(texts)]
    long = "calm words here " * 60_000
    rows += [rows[0], rows[0], (100, long + "vile scoundrel " * 40, "x"), (101, long, "x"), (None, "vile scoundrel", "x"), (102, None, "x"), (103, "", "x")]
    docs = spark.createDataFrame(rows, kind)
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(60)] + [(0, 1), (0, 1), (None, 1), (1, None)], "doc_id long, toxic int")
    out = toxicity.score_toxicity(docs, toxicity.train_toxicity(docs, labels, train=F.lit(True))).select("doc_id", "toxicity.score").collect()
    by = {}
    for r in out:
        by.setdefault(r.doc_id, set()).add(r.score)
    assert len(out) == len(rows) and all(len(v) == 1 and 0 <= min(v) <= 1 for k, v in by.items() if k is not None)
    assert by[102] == by[103] and min(by[100]) > max(by[101])
    assert toxicity.score_toxicity(docs, toxicity.train_toxicity(docs, labels.limit(0))).select("toxicity.score").distinct().count() == 1


def test_resolved_media_beside_columns_of_its_names(spark):
    body = b"payload" + bytes(57)
    items = spark.createDataFrame([(1, "own", "text", None), (2, "own", "x", "sha256:" + hashlib.sha256(body).hexdigest())], "id int, feature string, digest string, ref string")
    found = media.read_media(media.store_media(spark.createDataFrame([(bytearray(body),), (bytearray(body),)], "payload binary")))
    rows = {r.id: r for r in media.resolve_media(items, found).collect()}
    assert (rows[2].feature, rows[2].digest, rows[2].payload_bytes) == ("own", "x", 64) and rows[2].feature_.startswith("wav8k1;n=64")
    assert rows[1].feature_ is None and rows[1].digest == "text"


def test_very_long_payload_round_trip(spark):
    text = "long é " * 200_000
    d = spark.createDataFrame([(text,)], "text string").select(media.payload_column("text").alias("payload"))
    r = media.read_media(media.store_media(d)).first()
    n, b = media.padded(text)
    assert r.payload_bytes == len(b) and r.payload_sha256 == hashlib.sha256(b).hexdigest() and n == len(text.encode())


def test_language_of_texts_that_fit_all_alike(spark):
    rows = [(i, "same words in both", "aa" if i % 2 else "bb") for i in range(40)] + [(100, "12345 6789", None), (101, None, None), (102, "same words in both", None), (102, "same words in both", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    dicts = language.train_languages(docs, train=F.lit(True))
    out = language.identify(docs, dicts, out="found").select("doc_id", "found.*").collect()
    assert set(dicts) == {"aa", "bb"} and len(out) == len(rows)
    same = {(r.lang, r.score) for r in out if r.doc_id not in (100, 101)}  # equal totals: one answer, the same for all
    assert len(same) == 1 and {r.lang for r in out if r.doc_id in (100, 101)} == {"und"}
