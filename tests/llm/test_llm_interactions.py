"""The filter interaction audit against filters applied one after another."""

import re
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import interactions

DOCS, LABELS = "doc_id long, text string, source string", "doc_id long, quality int, toxic int"


def failures(text):
    ws = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
    return [len(ws) < 50, 100 * len(set(ws)) < 65 * len(ws), 100 * len(re.findall("[A-Z]", text)) > 5 * len(text), bool(re.search(r"[#$%&*|]", text))]


def brute(rows, labels):
    docs = []
    for i, text, source in rows:
        t = text or ""
        e = i is not None and any(j is not None and j < i and (u or "") == t for j, u, _ in rows)
        docs.append((source or "", {f for f, x in zip("ABCDE", [*failures(t), e], strict=True) if x}, any(i is not None and j == i and q == 1 for j, q, _ in labels), any(i is not None and j == i and x == 1 for j, _, x in labels)))
    out, shapley = {}, {}
    for part in {d[0] for d in docs}:
        mine = [d for d in docs if d[0] == part]
        for order in map("".join, permutations("ABCDE")):
            left = mine
            for step, f in enumerate(order, 1):
                gone, before = [d for d in left if f in d[1]], set(order[: step - 1])
                left = [d for d in left if f not in d[1]]
                shapley[part, f] = shapley.get((part, f), 0) + len(gone)
                out[part, order, step] = (len(left), len(gone), sum(f in d[1] and bool(before & d[1]) for d in mine), sum(d[1] == {f} for d in mine), sum(d[2] for d in gone), sum(d[3] for d in gone))
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def audited(df):
    return {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in df.collect()}


def test_orders_against_filters_in_a_row(spark):
    rng, rows = np.random.default_rng(3), []
    for i in range(60):
        n = int(rng.integers(0, 120))
        text = " ".join(("W" if rng.random() < 0.3 else "w") + str(int(rng.integers(0, 30 if i % 3 else 500))) for _ in range(n)) + ("|" if rng.random() < 0.3 else "")
        rows.append((i, text, [None, "", "a", "b"][i % 4]))
    rows += [(100 + i, rows[i % 5][1], "a") for i in range(15)] + [(None, rows[0][1], "a"), (None, None, None), (7, None, "b"), (7, "", "b"), (7, "", "b"), (3, rows[3][1], "b"), (200, "word\x0b\x0c\r\n\tword " * 40_000, "b")]
    labels = [(i, int(rng.integers(0, 2)), int(rng.integers(0, 2))) for i in range(0, 110, 2)] + [(4, 1, None), (4, None, 1), (None, 1, 1)]
    docs = spark.createDataFrame(rows, DOCS).selectExpr("*", "1 as part", "'x' as mask", "2 as all", "'d' as digest")
    got = audited(interactions.audit_texts(docs, spark.createDataFrame(labels, LABELS)))
    assert got == brute(rows, labels)
    assert set(k[0] for k in got) == {"", "a", "b"} and len(got) == 3 * 600


def test_no_documents(spark):
    assert interactions.audit_texts(spark.createDataFrame([], DOCS), spark.createDataFrame([], LABELS)).count() == 0


def test_no_labels(spark):
    got = audited(interactions.audit_texts(spark.createDataFrame([(1, "a", "s"), (2, "a", "s")], DOCS), spark.createDataFrame([], LABELS)))
    assert got["s", "EABCD", 1] == (1, 1, 0, 0, 0, 0, 60) and got["s", "AEBCD", 2] == (0, 0, 1, 0, 0, 0, 60)


def test_own_filters_and_labels(spark):
    docs = spark.createDataFrame([(i, i % 3 == 0) for i in range(30)] + [(None, None)], "v int, good boolean")
    got = interactions.audit_filters(docs, {"x": F.col("v") % 2 == 0, "y": F.col("v") >= 20}, part=F.lit("p"), labels={"good": F.col("good")})
    assert {(r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.shapley) for r in got.collect()} == {
        ("xy", 1): (16, 15, 0, 10, 5, 25), ("xy", 2): (11, 5, 5, 5, 2, 15), ("yx", 1): (21, 10, 0, 5, 3, 15), ("yx", 2): (11, 10, 5, 10, 4, 25)}
    with pytest.raises(ValueError):
        interactions.audit_masks(docs, "aa")
