"""Pages are parsed in bounded cuts."""

import tracemalloc

import pyarrow as pa

from tessera.llm import media


def test_pages_are_parsed_in_cuts_with_the_same_items():
    pages = [f"<p>a{i}</p><img src='r{i}' alt='c'>" * (i % 5) if i % 7 else None for i in range(200)] + ["<p>" + "x" * 5000 + "</p>", ""]
    want = [media.interleave(p) for p in pages]
    for most in (1, 300, 1 << 20):
        got = media.sequences(pa.array(pages, pa.string()), most).to_pylist()
        assert [[tuple(x[k] for k in ("position", "kind", "text", "ref", "caption")) for x in page] for page in got] == want
    assert media.sequences(pa.array([], pa.string())).to_pylist() == [] and media.sequences(pa.array([None], pa.string())).to_pylist() == [[]]
    held, parse = [], media.interleave
    media.interleave = lambda html: held.append(tracemalloc.get_traced_memory()[0]) or parse(html)
    try:
        tracemalloc.start()
        media.sequences(pa.array(["<p>word</p><img src='r'>" * 400] * 600))
    finally:
        tracemalloc.stop()
        media.interleave = parse
    assert max(held) < 40_000_000
