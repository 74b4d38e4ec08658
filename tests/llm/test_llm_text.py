"""op1, op2, op5, op6 and op9 against brute force, round trips and held-out accuracy."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter
from pathlib import Path

import pytest

from tessera.llm import language, media, quotes, tokens, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long, fp string"
TEXTS = ["", None, "one word", "x" * 64, "zwölf Boxkämpfer jagen Viktor", "a\nb\n\nc", "long words here " * 5000, "one word"]


def documents(spark, tmp_path, rows):
    d = str(tmp_path / "in")
    spark.createDataFrame(rows, DOCS).write.parquet(f"{d}/documents.parquet")
    return d


@pytest.fixture
def odd(spark, tmp_path):
    return documents(spark, tmp_path, [(i if i != 4 else None, t, None, None, None, "clash") for i, t in enumerate(TEXTS)])


@pytest.fixture
def empty(spark, tmp_path):
    d = documents(spark, tmp_path / "empty", [])
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return d


def test_media_round_trip(spark, odd, empty):
    got = {r.payload_sha256: r for r in media.op1_interleaved_media(spark, odd).collect()}
    rows = media.op1_interleaved_media(spark, odd).collect()
    assert len(rows) == len(TEXTS)
    for t in TEXTS:
        n, payload = media.padded(t)
        r = got[hashlib.sha256(payload).hexdigest()]
        assert (r.n_bytes, r.payload_bytes, r.tail_crc32) == (n, len(payload), zlib.crc32(payload[-64:]))
        stored = media.encode_wav(payload)
        assert media.decode_wav(stored) == payload and r.media_bytes == len(stored) and r.media_sha256 == hashlib.sha256(stored).hexdigest()
    assert media.op1_interleaved_media(spark, empty).count() == 0


def test_interleaving_keeps_order_and_captions():
    html = "<p>one</p><figure><img src=a alt=x><figcaption>cap</figcaption></figure><script>no</script>two<img src=b alt=y><p>three"
    assert media.interleave(html) == [(0, "text", "one", None, None), (1, "media", None, "a", "cap"), (2, "text", "two", None, None), (3, "media", None, "b", "y"), (4, "text", "three", None, None)]
    assert media.interleave(None) == media.interleave("") == []


def test_references_resolve_in_place(spark):
    import wave

    payloads = [b"one" + bytes(61), b"two" + bytes(61)]
    names = [f"sha256:{hashlib.sha256(p).hexdigest()}" for p in payloads]
    html = [
        f"<p>a<figure><img src='{names[0]}' alt=x><figcaption>first</figcaption></figure>b<img src='{names[1]}' alt='second'><img src='{names[0]}'><img src=http://far alt=y></p>c",
        None, "", "<<p <img src='x' <figure><figcaption>open", "<template><img src=z></template><figure><figcaption>alone</figcaption></figure>",
    ]
    pages = spark.createDataFrame([(i, h, "clash", 7) for i, h in enumerate(html)], "page_id long, html string, items string, digest int")
    stored = media.read_media(media.store_media(spark.createDataFrame([(p,) for p in [*payloads, payloads[0]]], "payload binary")))
    items = media.parse_interleaved(pages).selectExpr("page_id", "inline(items)")
    rows = sorted(media.resolve_media(items, stored).where("page_id = 0").select("position", "kind", "text", "ref", "caption", "payload_sha256").collect())
    far = ("http://far", "y", None)
    refs = [(names[0], "first", names[0][7:]), (names[1], "second", names[1][7:]), (names[0], None, names[0][7:]), far]
    assert [tuple(r) for r in rows] == [(0, "text", "a", None, None, None), (1, "media", None, *refs[0]), (2, "text", "b", None, None, None), *((3 + i, "media", None, *x) for i, x in enumerate(refs[1:])), (6, "text", "c", None, None, None)]
    assert {(r.page_id, r.text) for r in items.where("page_id in (1, 2, 4)").collect()} == {(4, "alone")}
    with wave.open(__import__("io").BytesIO(media.encode_wav(payloads[0]))) as w:
        x = list(w.readframes(64))
    got = stored.where(f"payload_sha256 = '{names[0][7:]}'").first()
    signs = [v < 128 for v in x]
    assert got.feature == f"wav8k1;n=64;sum={sum(x)};energy={sum((v - 128) ** 2 for v in x)};peak={max(abs(v - 128) for v in x)};crossings={sum(a != b for a, b in zip(signs, signs[1:]))}"


def brute_replies(rows):
    """For each (conv, turn) the turn it replies to, by the rules in the module's text."""
    norm = lambda x: re.sub(r"\s+", " ", x.lower()).strip()
    level = lambda x: re.match(r"(?:[ \t]*>)*", x)[0].count(">")
    body = lambda x: re.sub(r"^(?:[ \t]*>)+", "", x)
    facts, asks = set(), []
    for c, t, text in rows:
        lines = text.split("\n")
        own = "\n".join(x for i, x in enumerate(lines) if not level(x) and not (re.fullmatch(r"(?i)[ \t]*\S.{0,200} wrote:[ \t]*", x) and i + 1 < len(lines) and level(lines[i + 1])))
        facts |= {(c, norm(u), t) for u in [own, *re.split(r"\n\s*\n", own), *own.split("\n")] if norm(u)}
        quoted = [(level(x), body(x)) for x in lines]
        runs = [[y for _, y in g] for k, g in itertools.groupby(quoted, key=lambda x: x[0]) if k]
        asks += [(c, t, norm(u)) for u in ["\n".join(r) for r in runs] + [y for k, y in quoted if k] if norm(u)]
    weight = Counter()
    for c, t, u in asks:
        if earlier := [f for k, v, f in facts if (k, v) == (c, u) and f < t]:
            weight[c, t, max(earlier)] += len(u)
    out = {}
    for (c, t, f), n in weight.items():
        out[c, t] = max(out.get((c, t), (0, 0)), (n, f))
    return {k: v[1] for k, v in out.items()}


def test_quotes_against_brute_force(spark):
    rng = random.Random(11)
    parts, rows = ["Yes", "no way", "some  Longer line", "see you", "why?"], []
    for c in range(12):
        for t in range(rng.randrange(1, 9)):
            lines = [rng.choice(["", "", "> ", ">> ", " >"]) + rng.choice(parts) for _ in range(rng.randrange(1, 6))]
            rows.append((c, t, "\n".join(lines if rng.random() < 0.7 else ["Ann wrote:", *lines])))
    rows.append((99, 0, "a long line " * 20_000))
    rows.append((99, 1, "> " + "a long line " * 20_000 + "\nright"))
    want = brute_replies(rows)
    docs = spark.createDataFrame([(*r, 1, 2, "x") for r in rows], "conv_id long, turn long, text string, depth int, reply_to int, quote_level string")
    got = {(r.conv_id, r.turn): r.reply_to for r in quotes.link_quotes(docs).collect() if r.reply_to is not None}
    assert got == want and len(want) > 10


def test_quotes_link_to_the_latest_earlier_message(spark):
    rows = [
        ("c", 0, "u", "Hello there\n\nsecond paragraph", 1), ("c", 1, "a", "> hello   THERE\nfine", 1), ("c", 2, "u", "Ann wrote:\n>> Hello there\n> fine\nthanks", 1),
        ("c", 3, "u", "> nobody said this\nok", 1), ("d", 5, "u", "> fine\nother conversation", 1), ("c", None, "u", "> fine", 1), (None, 0, "u", None, 1), ("c", 1, "a", "> hello   THERE\nfine", 1),
    ]
    out = quotes.link_quotes(spark.createDataFrame(rows, "conv_id string, turn long, role string, text string, root_turn_x int")).collect()
    by = {(r.conv_id, r.turn): r for r in out}
    assert len(out) == len(rows)
    assert by["c", 1].reply_to == 0 and by["c", 1].text == "fine" and by["c", 2].text == "thanks"
    assert by["c", 2].reply_to == 0 and by["c", 2].quote_level == 2 and by["c", 2].depth == 1  # 11 characters of turn 0, 4 of turn 1
    assert by["c", 3].reply_to is None and by["d", 5].reply_to is None and by["c", None].reply_to is None
    assert by[None, 0].text is None and by[None, 0].quoted_lines == 0


def test_languages_held_out(spark, empty):
    sf = "/root/testdata/sf0.01"
    if Path(sf).exists():
        docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang")
        rows = language.op5_language_id(spark, sf).join(docs, "doc_id").where("held_out and lang is not null and lang_pred <> 'und'").collect()
        assert sum(r.lang == r.lang_pred for r in rows) > 0.9 * len(rows) and all(0 <= r.score <= 1 for r in rows)
    assert language.op5_language_id(spark, empty).count() == 0


def test_language_of_repeated_rows_and_clashing_names(spark):
    texts = {"en": "the cat and the dog of the house", "xx": "zqo vrr klo zqo mmp"}
    rows = [(i, t, k, "clash") for i in range(60) for k, t in texts.items()] + [(7, texts["en"], "en", "clash")] * 50 + [(None, "zqo vrr", None, "x"), (3, "123 !", "en", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, language string")
    out = language.identify(docs, language.train_languages(docs, per_lang=20)).collect()
    assert len(out) == len(rows) and all(r.language.lang == (r.lang if r.text in texts.values() else "xx" if "zqo" in r.text else "und") for r in out)
    with pytest.raises(ValueError):
        language.train_languages(docs, max_langs=1)


def test_language_of_odd_texts(spark, odd):
    rows = language.op5_language_id(spark, odd).collect()
    assert len(rows) == len(TEXTS) and {r.lang_pred for r in rows} == {"und"}  # nothing to learn from


def test_tokens_equal_the_library(spark, odd, empty):
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = public.path("byte_bpe_50k.json")
    lib, counter = Tokenizer.from_file(path), tokens.TokenCounter(path)
    count = lambda t: len(lib.encode(t, add_special_tokens=False).ids)
    for t in ["it's we'll  two  spaces\n\n tab\t x", "日本語 text <|endoftext|> end", "12345 a1b2 !!! ...", "naïve café — “quotes”", " " * 50, "\n"]:
        assert counter.count(t) == count(t)
    for text in ["The quick-brown fox's 1234 jumps;  over\n\nlazy dogs'll don't unbelievably", "日本語の文章 и кириллица\u00a0\u00a0x  \u2003 end\x1c\x1c y", "ab!! <|endoftext|> 's<|endoftext|>\n\n x", "<|endoftext|><|endo", "\n" * 30, "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaab" * 3]:
        table, wanted = tokens.PrefixTable(counter, text), [count(text[:i]) for i in range(len(text) + 1)]
        assert [table.count(i) for i in range(len(text) + 1)] == wanted and table.total == wanted[-1]
        for budget in range(table.total + 2):
            best = max(i for i in range(len(text) + 1) if wanted[i] <= budget)
            assert table.longest(budget) == best == tokens.PrefixTable(counter, text, budget).longest(budget)
    rows = tokens.op6_token_counts(spark, odd).collect()
    want = sorted((len((t or "").encode()), count(t or ""), count(t or "") > 1024) for t in TEXTS)
    assert sorted((r.n_bytes, r.n_tokens, r.over_limit) for r in rows) == want
    assert tokens.op6_token_counts(spark, empty).count() == 0


def test_cut_bytes_are_the_longest_prefix_within_the_limit(spark):
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = public.path("byte_bpe_50k.json")
    count = lambda t, lib=Tokenizer.from_file(path): len(lib.encode(t, add_special_tokens=False).ids)
    texts = ["naïve words — " * 20, "日本語の文章です。" * 9, "x <|endoftext|> y " * 8, "short", None, "аб вг " * 40]
    docs = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, tokens string")
    for r in tokens.token_counts(docs, path=path, limit=16).select("text", "tokens.*").collect():
        t = r.text or ""
        best = max(i for i in range(len(t) + 1) if count(t[:i]) <= 16)
        assert (r.n_tokens, r.over_limit, r.cut_bytes) == (count(t), count(t) > 16, len(t[:best].encode()))
    with pytest.raises(ValueError):
        tokens.TokenCounter(public.path("word_bpe_49k.json"))


def test_toxicity_learns_planted_words(spark, empty):
    ok = [f"plain words about weather number {i} and gardens {i * 7}" for i in range(120)]
    bad = [f"plain words grubbeldinger about zornvatkin and snarlbex {i} plokknurr vrekkelstein" for i in range(60)]
    docs = spark.createDataFrame([(i, t, "clash") for i, t in enumerate([*ok, *bad])] + [(None, "", ""), (999, None, "")], "doc_id long, text string, toxicity string")
    labels = spark.createDataFrame([(i, int(i >= 120)) for i in range(180)] + [(3, None), (None, 1)], "doc_id long, toxic int")
    model = toxicity.train_toxicity(docs, labels)
    rows = toxicity.score_toxicity(docs, model, out="t").where("doc_id < 180 and crc32(cast(cast(doc_id as string) as binary)) % 3 = 1").collect()
    assert rows and all((r.t.score >= 0.7) == (r.doc_id >= 120) for r in rows)
    assert toxicity.score_toxicity(docs, model, out="t").where("t.score between 0 and 1").count() == 182
    assert toxicity.op9_toxicity(spark, empty).count() == 0
