"""Language-model scoring with sharded Elias-Fano bigram tries.

Tokens are the words of a text, A-Z lower-cased, and one end token, which is also the context of the first word.
P(w | c) = (n(c, w) - DISCOUNT) / n(c) + b(c) P1(w), with P1 the base's unigram and b(c) = DISCOUNT t(c) / n(c), where c has
t(c) distinct successors: interpolated absolute discounting, which sums to 1. The trie holds the discounted probabilities,
quantised; t(c) is the distance of its pointers.

Documents are packed into blocks of about `block_tokens` tokens; what is shuffled are compressed arrays, one row for
each block and shard, never single words:
1. blocks: token ids local to the block, the block's distinct words as 64-bit hashes with their training counts.
2. vocabulary shards (by hash) add counts up and answer each block with its words' counts and ranks.
3. blocks send their distinct pairs of trained words to pair shards (by context; by context and word where a context
   has more than 1/HOT of all tokens), which build a memory-mapped trie of quantised probabilities from the training
   counts and look all pairs up in it by context-relative successor search. Successors of the split contexts, at most
   HOT, are added up over the shards.
4. blocks put counts and codes together and score their documents.
The number of shards is spark.sql.shuffle.partitions; a shard's share shrinks as that grows with the input.

Defined cases: a null or empty text is an end token alone; a null key is scored, neither held out nor learned from;
repeated rows are learned and scored each; without training rows N and V are 0 and every token has the base's 0.5 / 0.5;
an empty table gives an empty result. Keys are integers or strings. Words are told apart by 64-bit hashes: two words of one
hash would count as one. Extra columns are ignored.
"""

import json
import tempfile

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .eliasfano import BigramTrie, probabilities
from .shared import crc_mod, materialise, read, slices, words

END = b"\n"  #: no word holds a line feed
DISCOUNT, HOT = 0.75, 2000
ROWS = pa.schema([("block", pa.string()), ("kind", pa.string()), ("shard", pa.int64()), ("data", pa.binary())])
ROW = "block string, kind string, shard long, data binary"
SCORES = pa.schema([("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])


def pack(**arrays: np.ndarray) -> bytes:
    """Arrays in one compressed value; bytes of the same significance lie together, which compresses better."""
    head = json.dumps({k: [v.dtype.str, len(v)] for k, v in arrays.items()}).encode()
    body = b"".join(np.ascontiguousarray(v).view(np.uint8).reshape(-1, v.dtype.itemsize).T.tobytes() for v in arrays.values())
    return zstandard.ZstdCompressor(level=1).compress(len(head).to_bytes(4, "little") + head + body)


def unpack(data: bytes) -> dict[str, np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(data)
    n = int.from_bytes(raw[:4], "little")
    out, at = {}, 4 + n
    for k, (kind, size) in json.loads(raw[4:at]).items():
        width = np.dtype(kind).itemsize
        out[k] = np.frombuffer(raw, np.uint8, size * width, at).reshape(width, size).T.copy().view(kind).reshape(-1)
        at += size * width
    return out


def table(rows: list[tuple]) -> pa.Table:
    return pa.table([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True) if rows else [()] * 4, ROWS, strict=True)], schema=ROWS)


def small(a: np.ndarray) -> np.ndarray:
    return a.astype(np.uint32) if not len(a) or int(a.max()) < 1 << 32 else a.astype(np.uint64)


class Block:
    """Documents gathered until they are enough for a block."""

    def __init__(self):
        self.ids: dict[bytes, int] = {END: 0}
        self.parts, self.docs, self.tokens = [], [], 0

    def add(self, doc_id, held, trained, text) -> None:
        ids, ws = self.ids, words(text)
        for w in ws:
            if w not in ids:
                ids[w] = len(ids)
        a = np.fromiter(map(ids.__getitem__, ws), np.uint32, len(ws))
        self.parts.append(np.append(a, np.uint32(0)))
        self.docs.append((doc_id, held, trained, len(ws) + 1))
        self.tokens += len(ws) + 1

    def rows(self, name: str, shards: int) -> list[tuple]:
        """The block's documents, and its distinct words by shard: ids are renumbered in the order of (shard, hash)."""
        hashes = np.fromiter((xxhash.xxh64_intdigest(w) for w in self.ids), np.uint64, len(self.ids))
        shard = (hashes % np.uint64(shards)).astype(np.int64)
        order = np.lexsort((hashes, shard))
        rank = np.empty(len(order), np.uint32)
        rank[order] = np.arange(len(order), dtype=np.uint32)
        tokens = rank[np.concatenate(self.parts)]
        doc_id, held, trained, n = zip(*self.docs, strict=True)
        held, trained, n = map(np.array, (held, trained, n))
        learned = np.bincount(tokens[np.repeat(trained, n)], minlength=len(order))
        sizes = np.bincount(shard, minlength=shards)
        out = [(name, "docs", -1, pack(doc_id=np.frombuffer(json.dumps(doc_id).encode(), np.uint8), held=held, trained=trained, n=n.astype(np.int64), tokens=tokens, sizes=sizes, end=np.array([rank[0]])))]
        ends = np.cumsum(sizes)
        for s in np.flatnonzero(sizes):
            a, b = ends[s] - sizes[s], ends[s]
            out.append((name, "words", int(s), pack(h=hashes[order[a:b]], n=small(learned[a:b]))))
        return out


def make_blocks(docs: DataFrame, shards: int, block_tokens: int) -> DataFrame:
    """docs has doc_id, held, trained, text."""

    def run(batches):
        name, block, k = TaskContext.get().partitionId(), Block(), 0
        for whole in batches:
            for b in slices(whole, "text"):
                for row in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                    block.add(*row)
                    if block.tokens >= block_tokens:
                        yield from table(block.rows(f"{name}-{k}", shards)).to_batches()
                        block, k = Block(), k + 1
        if block.docs:
            yield from table(block.rows(f"{name}-{k}", shards)).to_batches()

    return docs.mapInArrow(run, ROW)


def vocabulary(sent: pa.Table) -> pa.Table:
    """One shard: for each block its words' counts over all blocks and ranks among the shard's trained words, from 1 on; a last row has the
    totals."""
    got = [(b, unpack(d)) for b, d in zip(sent["block"].to_pylist(), sent["data"].to_pylist(), strict=True)]
    shard = sent["shard"][0].as_py()
    every = np.unique(np.concatenate([x["h"] for _, x in got]))
    total = np.zeros(len(every), np.int64)
    places = [np.searchsorted(every, x["h"]) for _, x in got]
    for p, (_, x) in zip(places, got, strict=True):
        total[p] += x["n"].astype(np.int64)
    rank = np.where(total > 0, np.cumsum(total > 0), 0)
    rows = [(b, "counts", shard, pack(n=small(total[p]), rank=small(rank[p]))) for p, (b, _) in zip(places, got, strict=True)]
    known = total[total > 0]
    return table([*rows, ("", "total", shard, pack(t=np.array([total.sum(), len(known)])))])


class Read:
    """A block put together from its rows: counts and, from `offset` of the shards on, ids of its words."""

    def __init__(self, rows: pa.Table, offset: np.ndarray):
        kinds, shards, data = (rows[x].to_pylist() for x in ("kind", "shard", "data"))
        self.__dict__ |= unpack(data[kinds.index("docs")])
        ends = np.cumsum(self.sizes)
        self.count, self.id = np.zeros(int(ends[-1]), np.int64), np.zeros(int(ends[-1]), np.uint64)
        for k, s, d in zip(kinds, shards, data, strict=True):
            if k == "counts":
                x, cut = unpack(d), slice(ends[s] - self.sizes[s], ends[s])
                self.count[cut] = x["n"]
                self.id[cut] = x["rank"].astype(np.uint64) + np.uint64(offset[s])
        self.answers = {s: unpack(d) for k, s, d in zip(kinds, shards, data, strict=True) if k == "codes"}

    def pairs(self, total: int, shards: int, inverse: bool):
        """Distinct pairs of trained words in the order (shard, context id, word id): local ids, shard and training count.

        A trained context that has no trained word after it here is there with the end token, for its successors. With
        inverse also each token's pair, -1 for those with an unknown word.
        """
        before = np.concatenate([self.end, self.tokens[:-1]])
        sure = (self.count[before] > 0) & (self.count[self.tokens] > 0)
        width = np.uint64(len(self.count))
        key = before.astype(np.uint64) * width + self.tokens
        trained = np.repeat(self.trained, self.n)[sure]
        uniq, back = np.unique(key[sure], return_inverse=True)
        n = np.bincount(back, weights=trained, minlength=len(uniq)).astype(np.int64)
        alone = np.setdiff1d(before[self.count[before] > 0], (uniq // width).astype(before.dtype))
        uniq, n = np.concatenate([uniq, alone.astype(np.uint64) * width + np.uint64(self.end[0])]), np.append(n, np.zeros(len(alone), np.int64))
        c, w = (uniq // width).astype(np.int64), (uniq % width).astype(np.int64)
        mix = self.id[c] * np.uint64(0x9E3779B97F4A7C15)
        hot = self.count[c] * HOT > total
        mix = np.where(hot, (mix ^ self.id[w]) * np.uint64(0xBF58476D1CE4E5B9), mix)
        shard = ((mix >> np.uint64(33)) % np.uint64(shards)).astype(np.int64)
        order = np.lexsort((self.id[w], self.id[c], shard))
        out = c[order], w[order], shard[order], n[order]
        if not inverse:
            return out
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        each = np.full(len(self.tokens), -1, np.int64)
        each[sure] = place[back]
        return (*out, each)


def starts_of(*columns: np.ndarray) -> np.ndarray:
    """Where runs of equal rows start."""
    if not len(columns[0]):
        return np.array([], np.int64)
    return np.flatnonzero(np.concatenate([[True], np.logical_or.reduce([x[1:] != x[:-1] for x in columns])]))


def ask_pairs(total: int, shards: int, offset: np.ndarray):
    def run(rows: pa.Table) -> pa.Table:
        b, name = Read(rows, offset), rows["block"][0].as_py()
        c, w, shard, n = b.pairs(total, shards, False)
        out, cuts = [], np.flatnonzero(np.diff(shard, prepend=-1, append=-1))
        for i, j in zip(cuts, cuts[1:], strict=False):
            ids = b.id[c[i:j]]
            heads = starts_of(ids)
            out.append((name, "pairs", int(shard[i]), pack(ctx=small(np.diff(ids[heads], prepend=np.uint64(0))), of=small(b.count[c[i:j][heads]]), run=small(np.diff(np.append(heads, j - i))), word=small(b.id[w[i:j]]), n=small(n[i:j]))))
        return table(out)

    return run


def answer_pairs(total: int):
    def run(sent: pa.Table) -> pa.Table:
        """One shard: build the trie of the trained pairs and give each block the codes of its pairs and the numbers of
        successors of its contexts; a last row has those of the split contexts."""
        shard, got = sent["shard"][0].as_py(), []
        for b, d in zip(sent["block"].to_pylist(), sent["data"].to_pylist(), strict=True):
            x = unpack(d)
            heads = np.cumsum(x["ctx"].astype(np.uint64))
            got.append((b, np.repeat(heads, x["run"]), np.repeat(x["of"], x["run"]), x["word"].astype(np.uint64), x["n"], heads))
        ctx, of, word, n = (np.concatenate([x[i][x[4] > 0] for x in got]) for i in (1, 2, 3, 4))
        order = np.lexsort((word, ctx))
        ctx, of, word, n = ctx[order], of[order], word[order], n[order].astype(np.int64)
        heads = starts_of(ctx, word)
        n = np.add.reduceat(n, heads) if len(heads) else n
        ctx, of, word = ctx[heads], of[heads].astype(np.float64), word[heads]
        del order
        hot = np.unique(ctx[of * HOT > total])
        with tempfile.TemporaryDirectory() as folder:  # of this task alone
            BigramTrie.build(ctx, word, np.log10((n - DISCOUNT) / of) if len(of) else of).save(folder)
            trie = BigramTrie.load(folder)
            rows = [(b, "codes", shard, pack(codes=trie.codes_of(c, w), t=small(trie.successors_of(h)))) for b, c, _, w, _, h in got]
            rows.append(("", "hot", shard, pack(ctx=hot, t=trie.successors_of(hot))))
        return table(rows)

    return run


def score_blocks(total: int, distinct: int, shards: int, offset: np.ndarray, hot: np.ndarray, hot_t: np.ndarray, kind: pa.DataType):
    def run(rows: pa.Table) -> pa.Table:
        b = Read(rows, offset)
        c, _, shard, _, pair = b.pairs(total, shards, True)
        answers = [b.answers[s] for s in np.unique(shard)]
        codes = np.concatenate([x["codes"] for x in answers]) if answers else np.zeros(1, np.uint16)
        t = np.zeros(len(b.count))  # distinct successors of each word
        if answers:
            t[c[starts_of(shard, c)]] = np.concatenate([x["t"] for x in answers])
        if len(hot):
            at = np.minimum(np.searchsorted(hot, b.id), len(hot) - 1)
            t = np.where((hot[at] == b.id) & (b.count > 0), hot_t[at], t)
        p1 = (b.count + 0.5) / (total + 0.5 * (distinct + 1))
        before = np.concatenate([b.end, b.tokens[:-1]])
        level = np.where(b.count > 0, DISCOUNT * t / np.maximum(b.count, 1), 1.0)
        seen = np.where(pair >= 0, probabilities(codes)[pair], 0.0)
        p = seen + level[before] * p1[b.tokens]
        starts = np.concatenate([[0], np.cumsum(b.n)[:-1]])
        add = lambda x: np.add.reduceat(x, starts)
        base, score, known = add(np.log10(p1)[b.tokens]), add(np.log10(p)), add((b.count[b.tokens] > 0).astype(np.int64))
        scores = pa.table([pa.array(b.held), pa.array(b.n), pa.array(known), pa.array(np.full(len(b.n), total)), pa.array(base), pa.array(score)], schema=SCORES)
        return scores.add_column(0, "doc_id", pa.array(json.loads(b.doc_id.tobytes()), kind))

    return run


def score_documents(docs: DataFrame, *, key="doc_id", text="text", held=None, block_tokens: int = 1_500_000) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score; `held` is a condition for rows not to learn from."""
    spark = docs.sparkSession
    shards = int(spark.conf.get("spark.sql.shuffle.partitions"))
    out = F.coalesce(crc_mod(key, 5) == 1 if held is None else held, F.lit(False))
    named = F.col(key) if isinstance(docs.schema[key].dataType, StringType) else F.col(key).cast("long")
    kind, sql_kind = (pa.string(), "string") if isinstance(docs.schema[key].dataType, StringType) else (pa.int64(), "long")
    rows = docs.select(named.alias("doc_id"), out.alias("held"), (F.col(key).isNotNull() & ~out).alias("trained"), F.col(text).alias("text"))
    blocks = materialise(make_blocks(rows, shards, block_tokens))
    counts = materialise(blocks.where("kind = 'words'").groupBy("shard").applyInArrow(vocabulary, ROW))
    offset, total, distinct = np.zeros(shards, np.int64), 0, 0
    for r in counts.where("kind = 'total'").orderBy("shard").collect():  # a row for each shard
        n, v = map(int, unpack(bytes(r.data))["t"])
        offset[r.shard + 1 :] += v
        total, distinct = total + n, distinct + v
    texts = blocks.where("kind = 'docs'").union(counts.where("kind = 'counts'"))
    asked = texts.groupBy("block").applyInArrow(ask_pairs(total, shards, offset), ROW)
    codes = materialise(asked.groupBy("shard").applyInArrow(answer_pairs(total), ROW))
    successors: dict[int, int] = {}
    for r in codes.where("kind = 'hot'").toLocalIterator():  # a row for each shard, of at most HOT numbers
        x = unpack(bytes(r.data))
        for c, t in zip(x["ctx"].tolist(), x["t"].tolist(), strict=True):
            successors[c] = successors.get(c, 0) + t
    hot = np.array(sorted(successors), np.uint64)
    every = texts.union(codes.where("kind = 'codes'"))
    scored = score_blocks(total, distinct, shards, offset, hot, np.array([successors[c] for c in hot.tolist()]), kind)
    return every.groupBy("block").applyInArrow(scored, f"doc_id {sql_kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def op4_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(read(spark, sf_dir, "documents").select("doc_id", "text"))
