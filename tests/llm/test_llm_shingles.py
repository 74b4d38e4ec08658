"""The near-duplicate stage of the pipeline against all pairs of shingle sets."""

from itertools import combinations
from pathlib import Path

import numpy as np
import pytest

import corpus_pipeline
from tessera.llm import shingles, simhash

SF = "/root/testdata/sf0.001"


def brute_shingles(text):
    ws = (text or "").encode().lower().split()
    return {tuple(ws[i : i + 5]) for i in range(max(1, len(ws) - 4))} if ws else set()


def brute_kept(rows):
    """The least key of each component over distinct texts, null keys last."""
    texts = sorted({t or "" for _, t in rows})
    sets, comp = {t: brute_shingles(t) for t in texts}, {t: t for t in texts}
    links = [(a, b) for a, b in combinations(texts, 2) if sets[a] == sets[b] or 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]
    while changed := [(a, b) for a, b in links if comp[a] != comp[b]]:
        for a, b in changed:
            comp[a] = comp[b] = min(comp[a], comp[b])
    best = {}
    for k, t in rows:
        c = comp[t or ""]
        best[c] = min(best.get(c, (True, 0)), (k is None, k or 0))
    return sorted(best.values()), len(links)


def kept(docs):
    return sorted((r.doc_id is None, r.doc_id or 0) for r in corpus_pipeline.drop_near_duplicates(docs.sparkSession, docs, SF).collect())


def test_near_duplicates_against_all_pairs(spark):
    rng, texts = np.random.default_rng(7), []
    for b in range(12):
        base = [f"b{b}x{i}" for i in range(int(rng.integers(8, 120)))]
        texts.append(" ".join(base))
        for _ in range(6):  # runs of changed words put similarities on both sides of 0.8
            ws, at = list(base), int(rng.integers(0, len(base)))
            ws[at : at + int(rng.integers(0, 1 + len(base) // 8))] = ["new"] * int(rng.integers(0, 3))
            texts.append(" ".join(ws))
    passage = [f"p{i}" for i in range(30)]
    texts += [" ".join(passage + [f"own{j}x{i}" for i in range(int(rng.integers(1, 25)))]) for j in range(20)]
    group = [f"g{i}" for i in range(150)]
    texts += [" ".join("z" if i == j * 5 else w for i, w in enumerate(group)) for j in range(30)]
    texts += [None, "", " \t", "one two", "ONE two", "one two three"]
    rows = [(int(k), t) for k, t in zip(rng.permutation(len(texts)), texts, strict=True)]
    want, n_links = brute_kept(rows)
    assert n_links > 100
    assert kept(spark.createDataFrame(rows, "doc_id long, text string")) == want


def test_exactly_four_fifths_links(spark):
    a, b = " ".join(f"w{i}" for i in range(12)), " ".join(f"w{i}" for i in range(14))  # 8 of 10 shingles
    c = " ".join(f"w{i}" for i in range(15))  # 10 of 11 with b
    d = " ".join(f"v{i}" for i in range(12)), " ".join(f"v{i}" for i in range(15))  # 8 of 11
    rows = [(1, a), (2, b), (3, c), (4, d[0]), (5, d[1])]
    assert kept(spark.createDataFrame(rows, "doc_id long, text string")) == [(False, 1), (False, 4), (False, 5)]


def test_rows_of_a_group_that_share_a_key(spark):
    base = " ".join(f"w{i}" for i in range(100))
    near = [base.replace(f"w{i} ", "other ") for i in (50, 70)]
    for k in (3, None):
        assert kept(spark.createDataFrame([(k, base), (k, near[0]), (k, near[1]), (k, base)], "doc_id long, text string")) == [(k is None, k or 0)]


@pytest.mark.skipif(not Path(SF).exists(), reason="tables are not there")
def test_near_duplicates_of_the_smallest_tables(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    assert kept(docs) == brute_kept([(r.doc_id, r.text) for r in docs.collect()])[0]


def test_no_documents(spark):
    assert shingles.keep_first(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_fingerprints_within_three_bits_link_whatever_their_sets(spark):
    # changed words far apart: the sets of five-word shingles are less alike than 0.8, while few bits of three-word shingles differ
    texts = [" ".join("other" if i and at % 19 == i and at < 400 else f"w{at % 7}x{at // 40}" for at in range(600)) for i in range(8)]
    prints = [simhash.fingerprint(t, 3) for t in texts]
    sets = [brute_shingles(t) for t in texts]
    links = [(i, j) for i, j in combinations(range(8), 2) if bin(prints[i] ^ prints[j]).count("1") <= 3]
    assert links and all(5 * len(sets[i] & sets[j]) < 4 * len(sets[i] | sets[j]) for i, j in combinations(range(8), 2))
    comp = list(range(8))
    while changed := [(i, j) for i, j in links if comp[i] != comp[j]]:
        for i, j in changed:
            comp[i] = comp[j] = min(comp[i], comp[j])
    assert kept(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")) == [(False, c) for c in sorted(set(comp))]
