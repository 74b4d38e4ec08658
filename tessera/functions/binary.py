"""Container bytes: chunks of PNG, JPEG and WebP files, credential boxes and their CBOR, as Arrow functions over binary columns.

Each reads one file's bytes by the format's public layout; Spark spreads the files.
"""

import struct
from typing import Iterator

import pyarrow as pa
from pyspark.sql import functions as F


def png_chunks(b: bytes) -> tuple[list[str], int]:
    names, at = [], 8
    while at + 12 <= len(b):
        (n,) = struct.unpack_from(">I", b, at)
        name = b[at + 4 : at + 8].decode("latin-1")
        if at + 12 + n > len(b):
            break
        names.append(name)
        at += 12 + n
        if name == "IEND":
            return names, len(b) - at
    return names, 0


def jpeg_segments(b: bytes) -> Iterator[tuple[int, bytes]]:
    """Marker and body of the segments before the scan. Bytes that begin no marker are passed over, and fill bytes too."""
    at = 2
    while (at := b.find(b"\xff", at)) >= 0:
        while b[at : at + 1] == b"\xff":
            at += 1
        if at >= len(b) or b[at] == 0xDA:
            return
        m, at = b[at], at + 1
        if 0xD0 <= m <= 0xD9:  # restarts, start and end have no length
            continue
        n = int.from_bytes(b[at : at + 2], "big")
        if n < 2 or at + n > len(b):
            return
        yield m, b[at + 2 : at + n]
        at += n


def jpeg_markers(b: bytes) -> tuple[list[str], int]:
    end = b.rfind(b"\xff\xd9")
    return sorted({f"APP{m - 0xE0}" for m, _ in jpeg_segments(b) if 0xE0 <= m <= 0xEF}), len(b) - end - 2 if end >= 0 else 0


def webp_chunks(b: bytes) -> tuple[list[str], int]:
    names, at, stop = [], 12, min(len(b), 8 + struct.unpack_from("<I", b, 4)[0])
    while at + 8 <= stop:
        names.append(b[at : at + 4].decode("latin-1"))
        n = struct.unpack_from("<I", b, at + 4)[0]
        at += 8 + n + n % 2
    return names, max(0, len(b) - stop)


def container_of(b: bytes | None) -> dict:
    """kind, chunks and bytes after the end; the first format whose signature fits."""
    kind, (chunks, tail) = "unknown", ([], 0)
    if b and b[:8] == b"\x89PNG\r\n\x1a\n":
        kind, (chunks, tail) = "png", png_chunks(b)
    elif b and b[:2] == b"\xff\xd8":
        kind, (chunks, tail) = "jpeg", jpeg_markers(b)
    elif b and len(b) >= 12 and b[:4] == b"RIFF" and b[8:12] == b"WEBP":
        kind, (chunks, tail) = "webp", webp_chunks(b)
    return {"kind": kind, "chunks": chunks, "trailing_bytes": tail}


def image_size(b: bytes | None) -> tuple[str, int, int] | None:
    """Kind, width and height by a file's first bytes (PNG, JPEG, GIF, WebP); None where they say none."""
    if not b:
        return None
    if b[:8] == b"\x89PNG\r\n\x1a\n" and b[12:16] == b"IHDR" and len(b) >= 24:
        return ("png", *struct.unpack(">II", b[16:24]))
    if b[:6] in (b"GIF87a", b"GIF89a") and len(b) >= 10:
        return ("gif", *struct.unpack("<HH", b[6:10]))
    if b[:2] == b"\xff\xd8":
        frames = (body for m, body in jpeg_segments(b) if 0xC0 <= m <= 0xCF and m not in (0xC4, 0xC8, 0xCC) and len(body) >= 5)
        body = next(frames, None)
        return body and ("jpeg", int.from_bytes(body[3:5], "big"), int.from_bytes(body[1:3], "big"))
    if b[:4] == b"RIFF" and b[8:12] == b"WEBP" and len(b) >= 30:
        at = lambda i, n: int.from_bytes(b[i : i + n], "little")
        if b[12:16] == b"VP8X":
            return "webp", at(24, 3) + 1, at(27, 3) + 1
        if b[12:16] == b"VP8L" and b[20] == 0x2F:
            return "webp", (at(21, 4) & 0x3FFF) + 1, (at(21, 4) >> 14 & 0x3FFF) + 1
        if b[12:16] == b"VP8 " and b[23:26] == b"\x9d\x01\x2a":
            return "webp", at(26, 2) & 0x3FFF, at(28, 2) & 0x3FFF
    return None


WIDTHS = {24: 1, 25: 2, 26: 4, 27: 8}


def head(b: bytes, at: int) -> tuple[int, int | None, int]:
    """Major type, argument (None: of unknown length) and the place after it, of the CBOR item at a place."""
    if at >= len(b):
        raise ValueError("CBOR ends early")
    kind, low = b[at] >> 5, b[at] & 31
    if low < 24 or low == 31:
        return kind, low if low < 24 else None, at + 1
    if low not in WIDTHS or at + 1 + WIDTHS[low] > len(b):
        raise ValueError("no CBOR head")
    return kind, int.from_bytes(b[at + 1 : at + 1 + WIDTHS[low]], "big"), at + 1 + WIDTHS[low]


def text_at(b: bytes, at: int, most: int) -> tuple[bytes | None, int]:
    """The bytes of a text string of 1 to `most` bytes whose head is at a place, and the place after it; without one, the
    place after the head."""
    low = b[at] & 31
    if b[at] >> 5 != 3:
        return None, at
    try:
        _, n, after = head(b, at)
    except ValueError:
        return None, at + 1
    if low == 27 or n is None:
        return None, at + 1
    return (b[after : after + n], after + n) if 0 < n <= most and after + n <= len(b) else (None, after)


def cbor_strings(b: bytes | None, most: int = 1500) -> list[str]:
    """Text strings anywhere in the bytes that decode as UTF-8 of printable characters and blanks. What follows a head that
    opens no string is passed over with its first byte; so is a string that does not decode, whole."""
    out, at = [], 0
    while b and at < len(b):
        found, at = text_at(b, at, most)
        if found is None:
            at += 1
            continue
        text = found.decode("utf-8", "replace")
        if "\ufffd" not in text and all(c.isprintable() or c.isspace() for c in text):
            out.append(text)
    return out


def value_after(b: bytes, key: str, most: int = 1500) -> str | None:
    """The text string that stands right behind the bytes of a key, of the first place that has one."""
    name = key.encode()
    at = b.find(name)
    while at >= 0:
        after = at + len(name)
        found = text_at(b, after, most)[0] if after < len(b) else None
        if found is not None:
            try:
                return found.decode("utf-8")
            except UnicodeDecodeError:
                pass
        at = b.find(name, at + 1)
    return None


def walk_cbor(b: bytes, at: int, put, depth: int = 0):
    """The item at a place and the place after it; put(key, text) is told every text key of a map whose value is a text.
    Maps and arrays come back as None, since only their pairs matter."""
    if depth > 64:
        raise ValueError("CBOR too deep")
    kind, n, at = head(b, at)
    if kind in (2, 3):
        if n is None:
            parts = []
            while b[at : at + 1] != b"\xff":
                part, at = walk_cbor(b, at, put, depth + 1)
                parts.append(part if isinstance(part, bytes) else (part or "").encode())
            body, at = b"".join(parts), at + 1
        else:
            if at + n > len(b):
                raise ValueError("CBOR ends early")
            body, at = b[at : at + n], at + n
        return (body.decode("utf-8", "replace") if kind == 3 else body), at
    if kind in (4, 5):
        left = n
        while left is None or left > 0:
            if left is None and b[at : at + 1] == b"\xff":
                at += 1
                break
            key, at = walk_cbor(b, at, put, depth + 1)
            if kind == 5:
                value, at = walk_cbor(b, at, put, depth + 1)
                if isinstance(key, str) and isinstance(value, str):
                    put(key, value)
            left = left if left is None else left - 1
        return None, at
    if kind == 6:
        return walk_cbor(b, at, put, depth + 1)
    return None, at  # numbers, simple values and floats, whose bytes the head has read


def boxes(b: bytes, start: int = 0, stop: int | None = None) -> Iterator[tuple[bytes, int, int]]:
    """Type, begin and end of the contents of the boxes in a stretch; a box that overruns it ends the walk."""
    stop = len(b) if stop is None else stop
    while start + 8 <= stop:
        n, kind, body = int.from_bytes(b[start : start + 4], "big"), b[start + 4 : start + 8], start + 8
        if n == 1:
            n, body = int.from_bytes(b[start + 8 : start + 16], "big"), start + 16
        end = stop if n == 0 else start + n
        if end > stop or end < body:
            return
        yield kind, body, end
        start = end


def manifest_store(b: bytes) -> bytes:
    """The bytes that may hold credential boxes: a PNG's or WebP's own chunk, a JPEG's APP11 segments put together, else
    from the first superbox on."""
    if b[:8] == b"\x89PNG\r\n\x1a\n" or b[:2] == b"\xff\xd8" or (b[:4] == b"RIFF" and b[8:12] == b"WEBP"):
        parts: dict[tuple[int, int], bytes] = {}
        if b[:2] == b"\xff\xd8":
            for m, body in jpeg_segments(b):
                if m == 0xEB and body[:2] == b"JP":
                    key = (int.from_bytes(body[2:4], "big"), int.from_bytes(body[4:8], "big"))
                    parts[key] = body[8:] if key[1] <= 1 else body[16:]  # each later part repeats the box's head
        elif b[:4] == b"RIFF":
            at = 12
            while at + 8 <= len(b):
                n = int.from_bytes(b[at + 4 : at + 8], "little")
                if b[at : at + 4] == b"C2PA":
                    parts[0, at] = b[at + 8 : at + 8 + n]
                at += 8 + n + n % 2
        else:
            at = 8
            while at + 12 <= len(b):
                n = int.from_bytes(b[at : at + 4], "big")
                if b[at + 4 : at + 8] == b"caBX":
                    parts[0, at] = b[at + 8 : at + 8 + n]
                at += 12 + n
        if parts:
            return b"".join(parts[k] for k in sorted(parts))
    at = b.find(b"jumb")
    return b[at - 4 :] if at >= 4 else b""


def box_pairs(b: bytes) -> dict[str, str]:
    """Text keys with text values of all maps in the CBOR boxes of a file's credentials, the first value of each key."""
    store, out = manifest_store(b), {}

    def into(start: int, stop: int, depth: int) -> None:
        for kind, body, end in boxes(store, start, stop):
            if kind == b"jumb" and depth < 32:
                into(body, end, depth + 1)
            elif kind == b"cbor":
                try:
                    walk_cbor(store[body:end], 0, out.setdefault)
                except ValueError:
                    pass  # what was read before the damage counts

    into(0, len(store), 0)
    return out


#: Keys that a credential's claims stand under, in order.
CLAIM_KEYS = ("claim_generator", "claimGenerator", "softwareAgent", "software_agent", "action", "c2pa.action", "digitalSourceType", "digital_source_type")


def claims_of(b: bytes | None) -> dict[str, str] | None:
    """Claims by key: from the maps of CBOR boxes, else a text that stands right behind the key. None without bytes."""
    if not b:
        return None
    found = box_pairs(b)
    pairs = {k: found.get(k) or value_after(b, k) for k in CLAIM_KEYS}
    return {k: v for k, v in pairs.items() if v}


def _container(it: Iterator[pa.Array]) -> Iterator[pa.Array]:
    kind = pa.struct([("kind", pa.string()), ("chunks", pa.list_(pa.string())), ("trailing_bytes", pa.int32())])
    for a in it:
        yield pa.array([container_of(x.as_py()) for x in a], kind)


def _cbor(it: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for a in it:
        yield pa.array([cbor_strings(x.as_py()) for x in a], pa.list_(pa.string()))


def container(content):
    return F.arrow_udf(_container, "kind string, chunks array<string>, trailing_bytes int")(content)


def cbor_text(content):
    return F.arrow_udf(_cbor, "array<string>")(content)


def _image(it: Iterator[pa.Array]) -> Iterator[pa.Array]:
    kind = pa.struct([("format", pa.string()), ("width", pa.int32()), ("height", pa.int32())])
    for a in it:
        sizes = [image_size(x.as_py()) for x in a]
        yield pa.array([None if s is None else {"format": s[0], "width": s[1], "height": s[2]} for s in sizes], kind)


def image_header(content):
    """A struct format, width and height of an image's bytes, null where its header can't be read."""
    return F.arrow_udf(_image, "format string, width int, height int")(content)


def _claims(it: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for a in it:
        rows = [claims_of(x.as_py()) for x in a]
        yield pa.array([None if r is None else list(r.items()) for r in rows], pa.map_(pa.string(), pa.string()))


def claims(content):
    """A map of the claims in a file's bytes, null without bytes."""
    return F.arrow_udf(_claims, "map<string,string>")(content)


def cbor_value(content, key: str):
    """The text string that stands right behind a key's bytes."""

    def run(it: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for a in it:
            yield pa.array([value_after(x.as_py(), key) if x.is_valid else None for x in a], pa.string())

    return F.arrow_udf(run, "string")(content)
