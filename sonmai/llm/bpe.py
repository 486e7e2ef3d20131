"""Encoding of the whole corpus with a public byte-level BPE vocabulary.

Method: the distinct words of the corpus are encoded by Spark higher-order functions: a fold over the bytes of a word joins,
again and again, the neighbours of the lowest rank, looked up in a literal rank map. The map is an array of small maps,
chosen by a checksum of the key, as a lookup in one large map literal would scan it. Documents are cut into words once, in
blocks of bounded size with a dictionary each, and put together from the ids of their block's dictionary. Decoding
concatenates the binary pieces of the ids.

Words longer than LONG bytes, of which the fold's cost is the square, are encoded by the same merges with a heap.

Scale: blocks are bounded in characters and local to the task that reads the documents, which holds no more than one of
them. What is shuffled are blocks as places in their dictionaries, and the distinct words of each block. No dictionary of the
corpus is broadcast or collected: a block gets the words it has.

Defined results: NULL and empty texts have no ids (an empty list). Text that looks like a special token is ordinary text.
Repeated rows are encoded alike. Extra columns are dropped.
"""

from __future__ import annotations

import base64
import heapq
import json
import re
import zlib

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: How the vocabulary's texts are cut into words (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
LONG = 64
BUCKETS = 16_384
BLOCK_CHARS, BLOCK_ROWS = 4_000_000, 50_000  # of a block, at most; a longer text is at the end of one
WORDS_A_TASK = 5_000

_EXACT = regex.compile(PATTERN)
#: The same cut for pieces of characters whose classes both engines know alike; anything else is cut by the exact pattern.
_PLAIN = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
_KNOWN = re.compile("[\t\n\r\\x20-\\x7e¡-±´-¸º»¿-ɏḀ-ỿ–—‘’“”…]*")


def read_ranks(path: str = VOCABULARY) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def words_of(piece: str) -> list[str]:
    return _PLAIN.findall(piece) if _KNOWN.fullmatch(piece) else _EXACT.findall(piece)


def pieces(text: str) -> list[str]:
    """A text cut at single blanks between other characters, where words never run over; each piece but the first keeps its blank."""
    if "  " in text or " \n" in text or "\n " in text or text[:1].isspace() or text[-1:].isspace() or not text.isprintable() and _WHITE.search(text):
        return [text]
    first, *rest = text.split(" ")
    return [first, *[" " + p for p in rest]]


_WHITE = re.compile(r"\s\s|[^\S\n ]")


def heap_merges(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of one word by the same merges, in time n log n."""
    n = len(word)
    part = [word[i : i + 1] for i in range(n)]
    nxt, prv = [*range(1, n), -1], [-1, *range(n - 1)]
    alive = [True] * n
    heap = [(ranks[p], i, p) for i in range(n - 1) if (p := part[i] + part[i + 1]) in ranks]
    heapq.heapify(heap)
    while heap:
        _, i, p = heapq.heappop(heap)
        j = nxt[i] if alive[i] else -1
        if j < 0 or part[i] + part[j] != p:
            continue
        part[i], alive[j], nxt[i] = p, False, nxt[j]
        if nxt[i] >= 0:
            prv[nxt[i]] = i
        for a in (prv[i], i):
            b = nxt[a] if a >= 0 else -1
            if b >= 0 and (q := part[a] + part[b]) in ranks:
                heapq.heappush(heap, (ranks[q], a, q))
    return [ranks[part[i]] for i in range(n) if alive[i]]


def rank_literal(ranks: dict[bytes, int]) -> Column:
    """The ranks as one literal: an array of maps by the checksum of the key, whose characters are its bytes."""
    maps: list[dict[str, int]] = [{} for _ in range(BUCKETS)]
    for b, r in ranks.items():
        k = b.decode("latin-1")
        maps[zlib.crc32(k.encode()) % BUCKETS][k] = r
    return F.from_json(F.lit(json.dumps(maps)), "array<map<string,int>>")


def rank_of(table: Column, key: Column) -> Column:
    return F.element_at(F.element_at(table, (F.crc32(key) % BUCKETS + 1).cast("int")), key)


def fold_merges(word: Column, table: Column) -> Column:
    """The ids of a word: a fold that joins the neighbours of the lowest rank, the leftmost first, as often as there are bytes."""
    chars = F.decode(F.encode(word, "UTF-8"), "ISO-8859-1")
    start = F.filter(F.split(chars, ""), lambda c: F.length(c) > 0)

    def step(parts: Column) -> Column:
        n = F.size(parts)
        ranked = F.transform(F.sequence(F.lit(1), n - 1), lambda i: rank_of(table, F.concat(F.element_at(parts, i), F.element_at(parts, i + 1))))

        def join(best: Column) -> Column:
            at = F.array_position(best["r"], best["m"]).cast("int")
            return F.concat(F.slice(parts, F.lit(1), at - 1), F.array(F.concat(F.element_at(parts, at), F.element_at(parts, at + 1))), F.slice(parts, at + 2, F.greatest(n - at - 1, F.lit(0))))

        # one lambda over one struct, so that the ranks are computed once
        best = F.array(F.struct(ranked.alias("r")))
        with_min = F.transform(best, lambda b: F.struct(b["r"].alias("r"), F.array_min(b["r"]).alias("m")))
        return F.when(n < 2, parts).otherwise(F.element_at(F.transform(with_min, lambda b: F.when(b["m"].isNull(), parts).otherwise(join(b))), 1))

    # the fold stops changing once nothing can be joined; a flag spares the rest
    zero = F.struct(start.alias("p"), F.lit(False).alias("done"))

    def once(acc: Column, _: Column) -> Column:
        moved = F.transform(F.array(step(acc["p"])), lambda q: F.struct(q.alias("p"), (F.size(q) == F.size(acc["p"])).alias("done")))
        return F.when(acc["done"], acc).otherwise(F.element_at(moved, 1))

    merged = F.aggregate(F.sequence(F.lit(1), F.greatest(F.size(start) - 1, F.lit(1))), zero, once, lambda acc: acc["p"])
    return F.transform(merged, lambda p: rank_of(table, p))


def encode_words(words: DataFrame, ranks: dict[bytes, int]) -> DataFrame:
    """(word) distinct. Adds ids."""
    table = rank_literal(ranks)
    short = words.where(F.octet_length("word") <= LONG).select("word", fold_merges(F.col("word"), table).alias("ids"))
    shared = words.sparkSession.sparkContext.broadcast(ranks)

    @F.pandas_udf("array<int>")
    def by_heap(s):
        return s.map(lambda w: heap_merges(w.encode(), shared.value))

    return short.unionByName(words.where(F.octet_length("word") > LONG).select("word", by_heap("word").alias("ids")))


def packed(docs: DataFrame, key: str, text: str, block_bytes: int) -> DataFrame:
    """The documents in blocks, written: (block, k, n, at, words): their keys, the number of words of each, NULL for none to encode,
    each word's place in the block's dictionary, and the dictionary. Blocks are local to the task that reads the documents."""
    kind = docs.schema[key].dataType.simpleString()

    def pack(batches):
        part, made, schema = TaskContext.get().partitionId(), 0, None

        class Places(dict):  # of the words of a piece
            def __missing__(self, piece):
                p = np.array([number.setdefault(w, len(number)) for w in words_of(piece)], np.int32).tobytes()
                if len(piece) < 100:
                    self[piece] = p
                return p

        number: dict[str, int] = {}
        places = Places()
        keys, counts, at, size = [], [], [], 0

        def out():
            nonlocal made
            made += 1
            k = pa.concat_arrays(keys)
            row = [pa.array([part << 32 | made], pa.int64()), pa.ListArray.from_arrays(pa.array([0, len(k)], pa.int32()), k), pa.array([np.array(counts, np.int32).tobytes()], pa.binary())]
            return pa.RecordBatch.from_arrays([*row, pa.array([b"".join(at)], pa.binary()), pa.array([list(number)], pa.list_(pa.string()))], ["block", "k", "n", "at", "words"])

        for whole in batches:
            for lo in range(0, whole.num_rows, 500):
                batch = whole.slice(lo, 500)
                keys.append(batch.column(0))
                for t in batch.column(1).to_pylist():
                    got = b"".join(map(places.__getitem__, pieces(t))) if t else b""
                    at.append(got)
                    counts.append(len(got) // 4)
                    size += len(t) if t else 0
                if size > block_bytes or sum(map(len, keys)) >= BLOCK_ROWS:
                    yield out()
                    number.clear()
                    places.clear()
                    keys, counts, at, size = [], [], [], 0
        if keys:
            yield out()

    return written(docs.select(key, text).mapInArrow(pack, f"block long, k array<{kind}>, n binary, at binary, words array<string>"), "packed")


def encode(docs: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """(key, ids) of every row."""
    ranks = read_ranks(vocabulary)
    kind = docs.schema[key].dataType.simpleString()
    blocks = packed(docs, key, text, BLOCK_CHARS)
    held = blocks.select(F.col("block").alias("of"), F.posexplode("words").alias("i", "word"))
    words = written(held.select("word").distinct(), "words")
    # the fold takes long for its bytes, so words are spread by their number
    parts = max(1, -(-words.count() // WORDS_A_TASK))
    coded = written(encode_words(words.repartition(parts), ranks), "coded")
    dictionary = held.join(coded, "word").select("of", "i", "ids")

    def put_together(block: pa.Table, dic: pa.Table) -> pa.Table:
        ids = dic.column("ids").combine_chunks()
        flat = ids.flatten().to_numpy(zero_copy_only=False).astype(np.int32)
        begin, size = np.zeros(dic.num_rows, np.int64), np.zeros(dic.num_rows, np.int64)
        n = ids.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        word = dic.column("i").to_numpy()
        begin[word], size[word] = np.cumsum(n) - n, n
        out_k, out_o, out_ids, total = [], [np.zeros(1, np.int64)], [], 0
        for r in range(block.num_rows):
            counts = np.frombuffer(block.column("n")[r].as_py(), np.int32).astype(np.int64)
            at = np.frombuffer(block.column("at")[r].as_py(), np.int32)
            m = size[at]
            first = np.cumsum(m) - m
            out_ids.append(flat[np.repeat(begin[at] - first, m) + np.arange(int(m.sum()))] if len(at) else np.empty(0, np.int32))
            ends = np.r_[0, np.cumsum(m)][np.cumsum(counts)]
            out_o.append(ends + total)
            total += len(out_ids[-1])
            out_k.append(block.column("k")[r].values)
        k = pa.concat_arrays(out_k) if out_k else pa.array([], block.schema.field("k").type.value_type)
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate(out_o).astype(np.int32)), pa.array(np.concatenate(out_ids) if out_ids else np.empty(0, np.int32)))
        return pa.table({"k": k, "ids": lists})

    both = blocks.select("block", "k", "n", "at").groupBy("block").cogroup(dictionary.groupBy("of")).applyInArrow(put_together, f"k {kind}, ids array<int>")
    return both.select(F.col("k").alias(key), "ids")


def decode(encoded: DataFrame, ids: str = "ids", vocabulary: str = VOCABULARY) -> DataFrame:
    """Adds decoded: the concatenated binary pieces of the ids as text; unknown ids decode to nothing."""
    ranks = read_ranks(vocabulary)
    hexes = [""] * (max(ranks.values()) + 1)
    for b, r in ranks.items():
        hexes[r] = b.hex()
    table = F.from_json(F.lit(json.dumps(hexes)), "array<string>")
    known = F.filter(F.col(ids), lambda i: (i >= 0) & (i < len(hexes)))
    return encoded.withColumn("decoded", F.decode(F.unhex(F.array_join(F.transform(known, lambda i: F.element_at(table, i + 1)), "")), "UTF-8"))
