"""op3, op4, op7, op8, op10 and the pipeline against brute force and their SQL."""

import math
from collections import Counter
from itertools import combinations
from pathlib import Path

import duckdb
import numpy as np
import pytest
import xxhash

import corpus_pipeline
from tessera.llm import decontaminate, eliasfano, linededup, lm, mixing, quotes, registry, simhash

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, _id string, _th string, fp string, open int"


def table(spark, tmp_path, texts, sources=None):
    d, sources = str(tmp_path / "in"), sources or [None] * len(texts)
    rows = [(k, t, None, s, None, "x", "y", "z", 1) for (k, t), s in zip(texts, sources, strict=True)]
    spark.createDataFrame(rows, DOCS).write.parquet(f"{d}/documents.parquet")
    return d


BASE = " ".join(f"w{i}" for i in range(200))
ODD = [
    (1, None), (2, ""), (3, " \t"), (4, BASE), (5, BASE), (6, BASE.replace("w50", "other")), (7, BASE.upper()), (8, "two words"), (8, "two words"),
    (None, "null key text here"), (10, "a " * 30_000), (11, " ".join(f"v{i}" for i in range(90))),
]


def brute_fingerprint(text):
    ws = (text or "").encode().translate(bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")).split()
    if not ws:
        return 0
    hs = [xxhash.xxh64_intdigest(b" ".join(ws[i : i + 3]), 42) for i in range(max(1, len(ws) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def test_simhash_against_all_pairs(spark, tmp_path):
    d = table(spark, tmp_path, ODD)
    rows = simhash.op3_simhash(spark, d).collect()
    fps = {k: brute_fingerprint(t) for k, t in ODD}
    comp = {k: k for k in fps if k is not None}
    for _ in comp:
        for a, b in combinations(comp, 2):
            if bin(fps[a] ^ fps[b]).count("1") <= 3:
                comp[a] = comp[b] = min(comp[a], comp[b])
    assert len(rows) == len(ODD)
    for r in rows:
        assert r.fingerprint == f"{fps[r.doc_id]:016x}" and r.component_id == comp.get(r.doc_id)


def test_links_lose_none(spark):
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 63, 60, dtype=np.int64)
    fps = sorted({int(x) for b in base for x in (b, *(b ^ (1 << int(i)) ^ (1 << int(j)) ^ (1 << int(k)) for i, j, k in rng.integers(0, 62, (4, 3))))})
    got = simhash.link_fingerprints(spark.createDataFrame([(x,) for x in fps], "fp long")).collect()
    assert sorted((r.a, r.b) for r in got) == [(a, b) for a, b in combinations(fps, 2) if bin(a ^ b).count("1") <= 3]


def test_dense_groups_join_by_few_pairs(spark):
    near = [5 ^ (1 << i) ^ (1 << j) for i in range(40) for j in range(i, 40)]  # any two differ in at most 4 bits
    chain = [1 << 60, (1 << 60) | 7, (1 << 60) | 63, (1 << 60) | 511]  # each 3 bits from the next
    fps = sorted({*near, *chain})
    got = {r.node: r.component for r in simhash.fingerprint_components(spark.createDataFrame([(x,) for x in fps], "fp long")).collect()}
    comp = {x: x for x in fps}
    links = [(a, b) for a, b in combinations(fps, 2) if bin(a ^ b).count("1") <= 3]
    while any(comp[a] != comp[b] for a, b in links):
        for a, b in links:
            comp[a] = comp[b] = min(comp[a], comp[b])
    assert {x: got.get(x, x) for x in fps} == comp


def test_keep_first_leaves_one_of_each_group(spark, tmp_path):
    docs = spark.read.parquet(f"{table(spark, tmp_path, ODD)}/documents.parquet")
    out = simhash.keep_first(docs)
    assert out.columns == docs.columns and {r[5:8] for r in out.collect()} == {("x", "y", "z")}
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in out.collect()) == [(False, 1), (False, 4), (False, 8), (False, 10), (False, 11), (True, 0)]


def test_elias_fano_finds_and_gets():
    rng = np.random.default_rng(1)
    for n, top in ((0, 1), (1, 1), (500, 40), (3000, 1 << 40)):
        v = np.unique(rng.integers(0, top, n)).astype(np.uint64)
        ef = eliasfano.EliasFano.build(v)
        assert (ef.get(np.arange(len(v))) == v).all()
        if len(v):
            ask = np.concatenate([v, v + np.uint64(1)])
            at = ef.find(ask, np.zeros(len(ask), np.int64), np.full(len(ask), len(v)))
            assert at.tolist() == [int(np.searchsorted(v, x)) if x in set(v.tolist()) else -1 for x in ask]


def test_lm_scores_against_plain_counts(spark, tmp_path):
    texts = [*ODD, *((20 + i, f"the cat number {i % 7} sat on THE mat") for i in range(40))]
    rows = {r.doc_id: r for r in lm.op4_lm_scores(spark, table(spark, tmp_path, texts)).collect()}
    import zlib

    held = lambda k: k is not None and zlib.crc32(str(k).encode()) % 5 == 1
    split = lambda t: [*(t or "").encode().lower().split(), b"\n"]
    uni, bi, ctx = Counter(), Counter(), Counter()
    for k, t in texts:
        if k is not None and not held(k):
            ts = split(t)
            uni.update(ts)
            bi.update(zip([b"\n", *ts], ts))
            ctx.update([b"\n", *ts[:-1]])
    n, v = sum(uni.values()), len(uni)
    p1 = lambda w: (uni[w] + 0.5) / (n + 0.5 * (v + 1))
    succ = Counter(c for c, _ in bi)
    back = lambda c: 0.75 * succ[c] / uni[c] if uni[c] else 1.0
    assert sum((bi[b"the", w] - 0.75) / uni[b"the"] if (b"the", w) in bi else 0 for w in uni) + back(b"the") == pytest.approx(1)
    for k, t in texts:
        r, ts = rows[k], split(t)
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held(k), len(ts), sum(uni[w] > 0 for w in ts), n)
        assert r.base_score == pytest.approx(sum(math.log10(p1(w)) for w in ts), rel=1e-9)
        want = sum(math.log10((bi[c, w] - 0.75) / uni[c] * ((c, w) in bi) + back(c) * p1(w) if uni[c] else p1(w)) for c, w in zip([b"\n", *ts], ts))
        assert r.score == pytest.approx(want, rel=1e-3)


def test_lm_keys_may_be_strings(spark):
    rows = [(f"d/{i}", f"word{i % 5} and word{i % 3} again") for i in range(60)] + [(None, "a null key"), ("d/1", None)]
    docs = spark.createDataFrame(rows, "doc_id string, text string")
    out = lm.score_documents(docs)
    assert sorted(r.doc_id or "" for r in out.collect()) == sorted(k or "" for k, _ in rows) and out.schema["doc_id"].dataType.simpleString() == "string"


def test_myers_against_dynamic_programming():
    rng = np.random.default_rng(3)
    for _ in range(60):
        item, text = ("".join(rng.choice(list("abc"), k)) for k in (rng.integers(1, 12), rng.integers(0, 40)))
        row = [0] * (len(text) + 1)
        for i, a in enumerate(item, 1):
            new = [i]
            for j, b in enumerate(text, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (a != b)))
            row = new
        assert decontaminate.myers(decontaminate.char_masks(item), len(item), text)[0] == min(row)


def test_decontamination_finds_edited_items(spark, tmp_path):
    item = "the quick brown fox jumps over the lazy dog near the old river bank"
    edited = item.replace("quick", "quik").replace("lazy", "lazzy")
    far = item.replace("quick brown fox", "slow white cow")
    texts = [(1, f"before {item.upper()}  after"), (2, f"x {edited} y"), (3, far), (4, None), (5, ""), (6, "z " * 50_000 + item), (2, f"x {edited} y")]
    docs = spark.read.parquet(f"{table(spark, tmp_path, texts)}/documents.parquet")
    items = spark.createDataFrame([(7, item, 1), (8, item, 1), (9, "short", 1), (10, None, 1)], "item_id long, text string, doc_id int")
    got = sorted((r.doc_id, r.item_id, r.distance) for r in decontaminate.find_items(docs, items).collect())
    assert got == [(1, 7, 0), (1, 8, 0), (2, 7, 2), (2, 7, 2), (2, 8, 2), (2, 8, 2), (6, 7, 0), (6, 8, 0)]
    assert sorted(r.doc_id for r in decontaminate.decontaminate(docs, items).collect()) == [3, 4, 5]
    assert decontaminate.decontaminate(docs, items.limit(0)).count() == len(texts)


def plain(v):
    return round(v, 6) if isinstance(v, float) else v


def check_sql(spark, d, name, **tables):
    con = duckdb.connect()
    for t in ("documents", "conversations", "labels", "embeddings"):
        if (Path(d) / f"{t}.parquet").exists():
            path = Path(d) / f"{t}.parquet"
            con.execute(f"create view {t} as select * from '{path if path.is_file() else f'{path}/*.parquet'}'")
    df = registry.QUERIES[name](spark, d)
    cur = con.execute(registry.SQL[name])
    cols = [c[0] for c in cur.description]
    assert sorted(cols) == sorted(df.columns)
    want = sorted((tuple(plain(r[cols.index(c)]) for c in df.columns) for r in cur.fetchall()), key=repr)
    assert sorted((tuple(map(plain, r)) for r in df.collect()), key=repr) == want


@pytest.mark.skipif(not Path(SF).exists(), reason="tables are not there")
@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_sql(spark, name):
    check_sql(spark, SF, name)


def test_mixing_odd_rows(spark, tmp_path):
    rows = [(k, t) for k, t in ODD if k is not None]
    d = table(spark, tmp_path, rows, ["b", None, "a", "a", "b", "c", None, "a", "a", "z", "b"])
    check_sql(spark, d, "op7_mix_sources")
    out = mixing.op7_mix_sources(spark, d).collect()
    assert len(out) == len(rows) and all(r.taken <= 2 * r.size for r in out)
    assert mixing.mix_sources(spark.createDataFrame([], DOCS)).count() == 0


def test_schedule_is_even_at_every_length(spark):
    sources = spark.createDataFrame([(1, 5000), (2, 1500), (3, 70), (4, 3431)], "idx long, quota long")
    total, rows, upto = 10_001, [], 0
    for r in sources.orderBy("idx").collect():
        rows.append((r.idx, r.quota, int(upto / total * 2.0**48), int((upto + r.quota) / total * 2.0**48)))
        upto += r.quota
    slots = sorted(mixing.schedule(spark, spark.createDataFrame(rows, "idx long, quota long, lo long, hi long"), 4).collect())
    got = Counter()
    for n, r in enumerate(slots, 1):
        assert r.rank == got[r.idx]  # blocks of a source in their order
        got[r.idx] += 1
        assert all(abs(got[i] - n * q / total) <= 1 + math.log2(n + 1) for i, q, _, _ in rows)
    assert {i: -(-q // 4) for i, q, _, _ in rows} == got


def test_line_dedup_against_all_pairs(spark, tmp_path):
    line = lambda *ws: " ".join(ws)
    w = [f"t{i}" for i in range(40)]
    texts = [
        (1, line(*w) + "\nshort one\n" + line(*w[:20])), (2, line(*w[:39], "new") + "\nshort one"), (3, line(*w).upper() + "\r\n" + line(*w[:19], "zz")), (4, line(*w[:30]) + "\nother"),
        (5, None), (6, ""), (7, line("only", "four", "words", "here")), (8, line("only", "four", "words", "here")), (9, line(*w[::-1])), (10, "\t".join(w[:10])), (11, line(*w[:10])),
    ]
    d = table(spark, tmp_path, texts)
    rows = {r.doc_id: r for r in linededup.op10_line_dedup(spark, d).collect()}
    lines = [(k, p, frozenset(x.lower().split())) for k, t in texts if t is not None for p, x in enumerate(t.split("\n"))]
    for k, t in texts:
        gone = [p for kk, p, s in lines if kk == k and s and any((a, b) < (k, p) and u and 5 * len(s & u) >= 4 * len(s | u) for a, b, u in lines)]
        assert rows[k].removed == ",".join(map(str, gone)) and rows[k].n_lines == (0 if t is None else t.count("\n") + 1)
    docs = spark.read.parquet(f"{d}/documents.parquet")
    out = linededup.remove_repeated_lines(docs)
    assert out.columns == docs.columns and [r[5:8] for r in out.collect()] == [("x", "y", "z")] * len(texts)
    assert linededup.remove_repeated_lines(docs.limit(0)).count() == 0


def test_empty_tables(spark, tmp_path):
    d = table(spark, tmp_path, [])
    for f in (simhash.op3_simhash, lm.op4_lm_scores, mixing.op7_mix_sources, linededup.op10_line_dedup):
        assert f(spark, d).count() == 0
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert quotes.link_quotes(none).count() == 0


@pytest.mark.skipif(not Path(SF).exists(), reason="tables are not there")
def test_pipeline_stages_take_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns and 0 < out.count() <= docs.count()
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "near_duplicates", "decontamination", "mixing"]
    mix = corpus_pipeline.run(spark, SF).collect()
    kept = {r.doc_id for r in mix}
    assert kept and kept <= {r.doc_id for r in docs.select("doc_id").collect()} and sum(r.taken for r in mix) > 0
