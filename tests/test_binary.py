"""Segments, boxes and CBOR against encoders."""

import random
import struct

from pyspark.sql import functions as F

from tessera.functions import binary


def cbor(x, rng=None, loose=False):
    """An item in CBOR; loose: now and then in longer heads, of unknown length or tagged."""
    rng = rng or random.Random(0)

    def start(kind, n):
        w = [k for k, bits in ((0, 0), (24, 8), (25, 16), (26, 32), (27, 64)) if (n < 24 if k == 0 else n < 1 << bits)]
        k = rng.choice(w) if loose else w[0]
        return bytes([kind << 5 | (n if k == 0 else k)]) + (n.to_bytes(binary.WIDTHS[k], "big") if k else b"")

    if isinstance(x, bool) or x is None:
        return {True: b"\xf5", False: b"\xf4", None: b"\xf6"}[x]
    if isinstance(x, int):
        return start(0, x) if x >= 0 else start(1, -1 - x)
    if isinstance(x, float):
        return b"\xfb" + struct.pack(">d", x)
    tag = start(6, rng.randrange(1000)) if loose and rng.random() < 0.1 else b""
    if isinstance(x, (str, bytes)):
        kind, body = (3, x.encode()) if isinstance(x, str) else (2, x)
        if loose and rng.random() < 0.2 and body.isascii():
            at = rng.randrange(len(body) + 1)
            return tag + bytes([kind << 5 | 31]) + b"".join(start(kind, len(p)) + p for p in (body[:at], body[at:])) + b"\xff"
        return tag + start(kind, len(body)) + body
    kind, n = (5, len(x)) if isinstance(x, dict) else (4, len(x))
    body = b"".join(cbor(y, rng, loose) for y in ([z for kv in x.items() for z in kv] if isinstance(x, dict) else x))
    if loose and rng.random() < 0.3:
        return tag + bytes([kind << 5 | 31]) + body + b"\xff"
    return tag + start(kind, n) + body


def box(kind, body, long=False):
    return (b"\0\0\0\1" + kind + (16 + len(body)).to_bytes(8, "big") if long else (8 + len(body)).to_bytes(4, "big") + kind) + body


def some(rng, depth=0):
    kind = rng.randrange(8 if depth < 4 else 6)
    word = lambda: "".join(rng.choice("ab é·\n") for _ in range(rng.choice([0, 3, 30, 300])))
    if kind < 6:
        return [word(), rng.randrange(-(10**10), 10**18), rng.random(), rng.choice([True, None]), rng.randbytes(rng.randrange(40)), word()][kind]
    return [some(rng, depth + 1) for _ in range(rng.randrange(30))] if kind == 6 else {f"k{i}": some(rng, depth + 1) for i in range(rng.randrange(30))}


def pairs(x):
    """Pairs of texts in the order in which their values end."""
    for k, v in x.items() if isinstance(x, dict) else ((None, v) for v in x) if isinstance(x, list) else ():
        yield from pairs(v)
        if isinstance(k, str) and isinstance(v, str):
            yield k, v


def test_random_items_are_walked_whole():
    rng = random.Random(5)
    for _ in range(300):
        x, got, want = some(rng), [], []
        b = cbor(x, rng, loose=True)
        want = list(pairs(x))
        value, end = binary.walk_cbor(b, 0, lambda k, v, got=got: got.append((k, v)))
        assert end == len(b) and got == want
        assert not isinstance(x, (str, bytes)) or value == x
        cut = b[: rng.randrange(len(b))]
        part = []
        try:
            binary.walk_cbor(cut, 0, lambda k, v, part=part: part.append((k, v)))
        except (ValueError, IndexError) as e:
            assert isinstance(e, ValueError)
        assert part == want[: len(part)]


def credential(x, long=False):
    inner = box(b"jumb", box(b"jumd", b"cbor\0\x11label\0") + box(b"cbor", cbor(x)))
    return box(b"jumb", box(b"jumd", b"c2pa\0\x11c2pa\0") + box(b"jumb", box(b"jumd", b"c2ma") + inner), long)


CLAIM = {"title": "a", "actions": [{"action": 5, "x": "y"}, {"action": "c2pa.created", "softwareAgent": "Agent\nof lines", "n": [1, {"deep": "d"}]}], "claim_generator": "make/1 " + "z" * 70_000, "digitalSourceType": "http://cv/trainedAlgorithmicMedia"}
WANT = {"action": "c2pa.created", "softwareAgent": "Agent\nof lines", "claim_generator": CLAIM["claim_generator"], "digitalSourceType": CLAIM["digitalSourceType"]}


def test_claims_from_each_container():
    store = credential(CLAIM)
    png = b"\x89PNG\r\n\x1a\n" + b"".join(struct.pack(">I", len(b)) + n + b + b"\0\0\0\0" for n, b in ((b"IHDR", b"\0" * 13), (b"caBX", store), (b"IEND", b"")))
    cut = [store[i : i + 60_000] for i in range(0, len(store), 60_000)]
    app11 = b"".join(b"\xff\xeb" + struct.pack(">H", len(p) + 10 + (8 if i else 0)) + b"JP\0\1" + struct.pack(">I", i + 1) + (store[:8] if i else b"") + p for i, p in enumerate(cut))
    webp_body = b"WEBPC2PA" + struct.pack("<I", len(store)) + store + b"\0" * (len(store) % 2)
    files = [store, b"junk" + store, credential(CLAIM, long=True), png, b"\xff\xd8\xff\xff\xe1\x00\x04ab" + app11 + b"\xff\xda..\xff\xd9", b"RIFF" + struct.pack("<I", len(webp_body)) + webp_body]
    for f in files:
        assert binary.claims_of(f) == WANT
    assert binary.claims_of(None) is binary.claims_of(b"") is None and binary.claims_of(b"\xff\xd8") == {}


def test_a_key_whose_value_is_no_text_has_none():
    b = cbor({"action": 5, "x": "y"})
    assert binary.value_after(b, "action") is None and binary.value_after(b, "x") == "y" and binary.claims_of(b) == {}
    assert binary.value_after(b"action\x05action" + cbor("found"), "action") == "found"
    assert binary.value_after(b"action\x62\xff\xfe" + b"action" + cbor("late"), "action") == "late"
    loose = cbor("claim_generator") + cbor("OpenAI/ChatGPT") + cbor("action") + cbor("c2pa.created")
    assert binary.claims_of(b"c2pa_manifest\0\0jumb\0\0jumd\0\0c2ma" + loose) == {"claim_generator": "OpenAI/ChatGPT", "action": "c2pa.created"}


def test_strings_of_all_lengths_and_blanks():
    long = "é" * 700
    assert binary.cbor_strings(cbor("a\nb") + b"\xf6" + cbor(long) + b"\x7a\0\0\0\x02hi" + cbor("z" * 1501)[:3]) == ["a\nb", long, "hi"]
    assert binary.cbor_strings(cbor("bad\0") + cbor("good")) == ["good"]
    assert binary.cbor_strings(b"\x62\xff\xfe\x61a") == ["a"] and binary.cbor_strings(b"") == [] and binary.cbor_strings(b"\x7b") == []


def test_jpeg_fill_restarts_and_repeats():
    seg = lambda m, body: b"\xff" + bytes([m]) + struct.pack(">H", len(body) + 2) + body
    b = b"\xff\xd8" + seg(0xE2, b"x") + b"\xff\xff\xff\xe1\0\x03y" + b"\xff\xd3" + seg(0xE1, b"z") + b"noise" + seg(0xE0, b"") + seg(0xDB, b"q") + b"\xff\xda\xff\xe9\0\x02\xff\xd9tail"
    assert binary.container_of(b) == {"kind": "jpeg", "chunks": ["APP0", "APP1", "APP2"], "trailing_bytes": 4}
    assert binary.container_of(b"\xff\xd8\xff\xe1\xff\xff")["chunks"] == []


def test_claims_as_a_column(spark):
    df = spark.createDataFrame([(1, bytearray(credential(CLAIM))), (2, None), (3, bytearray(b"nothing"))], "id int, b binary")
    got = {r.id: r.c for r in df.select("id", binary.claims(F.col("b")).alias("c")).collect()}
    assert got == {1: WANT, 2: None, 3: {}}
