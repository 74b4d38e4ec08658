"""Benchmark items of a few characters, and items without an id."""

from tessera.llm import decontaminate


def test_short_items_and_null_ids(spark):
    texts = [(1, "What is  the Capital?"), (2, "concatenate, then a cat."), (3, "concatenate"), (4, "他问你叫什么名字吗"), (5, "see the null item number one"), (6, "and number two of null"), (7, "a dog")]
    items = [(1, "what is the capital?"), (2, "cat"), (3, "什么名字"), (None, "the null item number one"), (None, "number two"), (4, " "), (5, None)]
    docs, bench = spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = sorted((tuple(r) for r in decontaminate.find_items(docs, bench).collect()), key=lambda r: r[0])
    assert got == [(1, 1, 0, 0, 20), (2, 2, 0, 20, 23), (4, 3, 0, 4, 8), (5, None, 0, 4, 28), (6, None, 0, 4, 14)]
    assert sorted(r.doc_id for r in decontaminate.decontaminate(docs, bench).collect()) == [3, 7]


def test_ids_may_be_strings_and_documents_empty(spark):
    docs = spark.createDataFrame([(1, "say what is two plus two?"), (2, None), (2, "")], "doc_id long, text string")
    bench = spark.createDataFrame([("HumanEval/1", "what is two plus two?"), (None, "never there")], "item_id string, text string")
    assert [tuple(r)[:3] for r in decontaminate.find_items(docs, bench).collect()] == [(1, "HumanEval/1", 0)]
    assert decontaminate.decontaminate(docs, bench).count() == 2
    assert decontaminate.find_items(docs.limit(0), bench).count() == decontaminate.find_items(docs, bench.limit(0)).count() == 0
