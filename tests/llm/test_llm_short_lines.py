"""Lines of few words in the pipeline's line dedup, against all pairs."""

from pyspark.sql import functions as F

import corpus_pipeline
from tessera.llm import linededup

TEXTS = [
    (1, "Les.\none two three four five\n\nhttp://a.b/c?d=e\n你好世界你好世界\n \nonly four words here"), (2, "les.\none two three four\nThree  two ONE\nonly four words\n\nhttp://a.b/c?d=e"),
    (3, "你好世界你好世界\none two three\nLes.\nless.\nonly four words here\n \nfour"), (4, None), (5, ""), (6, "\n\n"),
]


def test_lines_of_few_words_against_all_pairs(spark):
    docs = spark.createDataFrame(TEXTS, "doc_id long, text string").selectExpr("*", "cast(char_length(text) as long) as n_chars")
    got = {r.doc_id: r.text for r in corpus_pipeline.drop_repeated_lines(spark, docs, "").collect()}
    lines = [(k, p, frozenset(x.lower().split())) for k, t in TEXTS if t is not None for p, x in enumerate(t.split("\n"))]
    for k, t in TEXTS:
        stay = lambda p, s: not s or not any((a, b) < (k, p) and u and 5 * len(s & u) >= 4 * len(s | u) for a, b, u in lines)
        want = None if t is None else "\n".join(x for p, x in enumerate(t.split("\n")) if stay(p, frozenset(x.lower().split())))
        assert got[k] == want


def test_words_of_one_hash_are_different_words(spark):
    """word70213 and word251767 share their 32-bit hash, as do their neighbours in longer lines."""
    assert spark.range(1).select(F.hash(F.lit("word70213")) == F.hash(F.lit("word251767"))).first()[0]
    one, two = "word70213", "word251767"
    rows = [(1, one), (2, two), (3, f"a b c d {one}"), (4, f"a b c d {two}"), (5, f"a b c d e f g {one} {two}"), (6, f"a b c d e {one} {two} h i"), (7, f"{two} {one} a b c d e f g x")]
    out = linededup.remove_repeated_lines(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r.doc_id: r.text for r in out.collect()} == {**dict(rows), 7: ""}


def test_removed_lines_beside_a_column_of_that_name(spark):
    df = spark.createDataFrame([(1, "a b\na b", "mine"), (2, " ".join(f"w{i}" for i in range(200_000)), None)], "doc_id long, text string, removed string")
    assert [tuple(r) for r in linededup.with_removed(df).select("doc_id", "removed", "removed_").orderBy("doc_id").collect()] == [(1, "mine", [1]), (2, None, None)]


def test_sets_of_very_many_words(spark):
    """Sizes of 65,535 words and more do not fit beside the parity."""
    words = [f"w{i}" for i in range(70_000)]
    rows = [(1, " ".join(words)), (2, " ".join(words[7_000:] + ["x"])), (3, " ".join(words[:55_000])), (4, " ".join(words[:65_535])), (5, " ".join(words[30_000:])), (6, "w1 w2")]
    out = linededup.remove_repeated_lines(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r.doc_id for r in out.collect() if r.text == ""} == {2, 4}


def test_parities_differ_in_no_more_bits_than_sets_in_words(spark):
    sets = spark.range(2000).select(F.col("id"), F.transform(F.sequence(F.lit(1), F.col("id") % 90 + 10), lambda i: F.hash(i, F.col("id") % 7)).alias("w"), F.transform(F.sequence(F.lit(1), F.col("id") % 60 + 20), lambda i: F.hash(i, F.col("id") % 7)).alias("v"))
    b = sets.select((F.size("w") + F.size("v") - 2 * F.size(F.array_intersect("w", "v"))).alias("n"), linededup.differing(linededup.parity(F.col("w")), linededup.parity(F.col("v"))).alias("bits"), linededup.parity(F.col("w"))["y"].bitwiseAND(F.lit(linededup.MANY)).alias("free"))
    assert b.where("bits > n or bits % 2 <> n % 2 or free <> 0").count() == 0 and b.where("bits > 20").count() > 100


def test_heads_read_no_words_and_ranks_are_not_null(spark):
    """What op10_line_dedup spends its time on: arrays of words read again, numbers sorted as objects."""
    classes = linededup.Classes(linededup.lines_of(spark.createDataFrame([(1, "a b c\na b d")], "doc_id long, text string"), "doc_id", "text", 1), 1)
    try:
        assert "w:array" not in linededup.head_pairs(classes.rows)._jdf.queryExecution().executedPlan().toString()
        ranks = classes.rows.select(linededup.rarest(F.col("w"), F.array(F.lit(1).cast("long")), F.lit(1)).alias("r"))
        assert not ranks.schema["r"].dataType.containsNull
    finally:
        classes.drop()


def test_packed_parities_of_narrow_and_wide_sets(spark):
    """Sets of up to NARROW words have no y; no comparison may count more bits than words that differ."""
    sets = spark.range(2000).select(*[F.transform(F.sequence(F.lit(1), F.col("id") % k + 40), lambda i: F.hash(i, F.col("id") % 3)).alias(c) for k, c in ((90, "w"), (70, "v"))])
    n, m = F.size("w"), F.size("v")
    zero = F.lit(0).cast("long")
    side = lambda c, s: linededup.packed((lambda p: {"x": p["x"], "y": F.when(s > linededup.NARROW, p["y"]).otherwise(zero)})(linededup.parity(F.col(c))), s, F.lit(1))
    bits = linededup.apart(*side("w", n), *side("v", m))
    found = sets.select((n + m - 2 * F.size(F.array_intersect("w", "v"))).alias("differ"), bits.alias("bits"), n.alias("n"), linededup.size_of(side("w", n)[1]).alias("packed"))
    assert found.where("bits > differ or n <> packed").count() == 0 and found.where("bits > 20").count() > 50


def test_heads_and_lines_are_not_sorted(spark):
    """Heads are aggregated by hash, and lines stream past narrow pairs; where pairs hold lines, the join can spill."""
    classes = linededup.Classes(linededup.lines_of(spark.createDataFrame([(1, "a b c\na b d")], "doc_id long, text string"), "doc_id", "text", 1), 1)
    try:
        plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
        assert "SortAggregate" not in plan(linededup.head_pairs(classes.rows))
        joins = plan(classes.verified(classes.rows.select(F.col("c").alias("a"), F.col("c").alias("b"))))
        assert joins.count("ShuffledHashJoin") == joins.count("SortMergeJoin") > 0
    finally:
        classes.drop()
