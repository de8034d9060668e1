"""Byte-level BPE encoding and decoding through a global shuffle of distinct words (operator 10).

1. *Explode.* Every whole text is split by the tokenizer's pattern. Documents are gathered into
   chunks of about ``CHUNK_CHARS``; each chunk has a table of its distinct pre-tokens, and each
   document its pre-tokens' places in that table, in order of position (packed and compressed).
2. *Encode.* The chunks' distinct pre-tokens are dealt by hash into word buckets, so equal
   pre-tokens of all chunks meet and each is merged by rank once.
3. *Join back.* A bucket answers every chunk with the ids of the pre-tokens it sent, in its order.
4. *Reassemble.* Places, tables and ids meet again by chunk, sorted so that a chunk's ids come first
   and its documents follow block by block; a document's ids are those of its pre-tokens by position.
   Decoding takes ids alone and joins the table of token bytes.

Nothing grows with the corpus in one task: a chunk is bounded by its characters (a longer document
ends its chunk), a task that reassembles holds the ids of one chunk's distinct pre-tokens and one
block, a bucket is bounded by the number of buckets, which follows the shuffle partitions.
A frequent word costs one entry per chunk. The rank table is bounded by ``MAX_VOCAB`` entries.

Null text encodes as the empty text, with no ids. Repeated rows and ids are encoded each; columns of
the input named in ``carry`` pass through. An empty table gives no rows.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from eventide.llm.common import partitions, read
from eventide.llm.packed import Places, from_planes, gather, pack, pack_places, planes, unpack, unpack_places
from eventide.session import cut_lineage

CHUNK_CHARS = 32_000_000
#: documents of about so many characters are given their ids at once
BLOCK_CHARS = 1_000_000
MAX_VOCAB = 1 << 20
#: pieces of up to so many bytes are merged by plain scanning, longer ones with a heap
SCAN_BYTES = 64
#: bytes of ids decoded into one Arrow batch (a longer document is one of its own)
DECODED_BYTES = 1 << 21


def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes -> rank from lines of ``base64 rank``; the file is a parameter of the job."""
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    if len(ranks) > MAX_VOCAB:
        raise ValueError(f"more than {MAX_VOCAB} tokens")
    return ranks


def _merge_scan(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    parts = [word[i:i + 1] for i in range(len(word))]
    while len(parts) > 1:
        best, at = None, -1
        for i in range(len(parts) - 1):
            r = ranks.get(parts[i] + parts[i + 1])
            if r is not None and (best is None or r < best):
                best, at = r, i
        if best is None:
            break
        parts[at:at + 2] = [parts[at] + parts[at + 1]]
    return [ranks[p] for p in parts]


def _merge_heap(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same merges in O(n log n): spans in a linked list, candidate pairs in a heap."""
    n = len(word)
    end = list(range(1, n + 1))
    before = list(range(-1, n - 1))
    alive = [True] * n
    heap = []

    def offer(i: int) -> None:
        j = end[i]
        if j < n:
            r = ranks.get(word[i:end[j]])
            if r is not None:
                heapq.heappush(heap, (r, i, end[j]))

    for i in range(n - 1):
        offer(i)
    while heap:
        _, i, stop = heapq.heappop(heap)
        if not alive[i] or end[i] >= n or end[end[i]] != stop:
            continue
        alive[end[i]] = False
        end[i] = stop
        if stop < n:
            before[stop] = i
        offer(i)
        if before[i] >= 0:
            offer(before[i])
    out, i = [], 0
    while i < n:
        out.append(ranks[word[i:end[i]]])
        i = end[i]
    return out


def encode_word(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Merge the adjacent pair of lowest rank, leftmost first, until no pair is a token."""
    whole = ranks.get(word)
    if whole is not None:
        return [whole]
    return _merge_scan(word, ranks) if len(word) <= SCAN_BYTES else _merge_heap(word, ranks)


def _bucket(word: bytes, n: int) -> int:
    return int.from_bytes(hashlib.blake2b(word, digest_size=4).digest(), "little") % n


def _split(docs: DataFrame, carry: list[str], pattern: str, chunk_chars: int, n_buckets: int) -> DataFrame:
    """Rows of a chunk, told apart by ``part`` and ``number``:

    * part -2: the chunk's distinct pre-tokens of one word bucket, in place order;
    * part -1: the word bucket of each place;
    * part k, number -1: the places of the pre-tokens of block k, in order of document and position;
    * part k, number i: the i-th document of block k, how many pre-tokens it has, ``carry``.

    Blocks hold about ``BLOCK_CHARS`` of whole documents. Places go by falling frequency in the chunk.
    """
    given = docs.select(*carry).schema
    fixed = ["chunk", "part", "number", "n", "bucket", "body"]
    schema = "chunk string, part int, number int, n int, bucket int, body binary" + "".join(
        f", `_c{i}` {f.dataType.simpleString()}" for i, f in enumerate(given))
    names = [*fixed, *[f"_c{i}" for i in range(len(carry))]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = regex.compile(pattern).findall
        task = TaskContext.get().partitionId()
        chunk, seen, chars = 0, Places(), 0
        blocks: list[list[np.ndarray]] = [[]]  # places of the documents of each block
        block_chars, told, types = 0, 0, []

        def documents(b: pa.RecordBatch, a: int) -> pa.RecordBatch:
            size = [len(h) for h in blocks[-1][told:]]
            k = len(size)
            return pa.RecordBatch.from_arrays(
                [pa.array([f"{task}-{chunk}"] * k, pa.string()), pa.array([len(blocks) - 1] * k, pa.int32()),
                 pa.array(range(told, told + k), pa.int32()), pa.array(size, pa.int32()), pa.nulls(k, pa.int32()),
                 pa.nulls(k, pa.binary()), *b.slice(a, k).columns[:len(carry)]], names=names)

        def lists() -> Iterator[pa.RecordBatch]:
            words = [w.encode("utf-8", "surrogatepass") for w in seen]
            count = np.zeros(len(words), np.int64)
            for block in blocks:
                count += np.bincount(np.concatenate([*block, np.zeros(0, np.uint32)]), minlength=len(words))
            often = np.argsort(-count, kind="stable")
            rank = np.empty(len(words), np.uint32)
            rank[often] = np.arange(len(words), dtype=np.uint32)
            bucket_of = np.fromiter((_bucket(words[i], n_buckets) for i in often), np.uint32, len(words))
            by_bucket: dict[int, list[bytes]] = {}
            for i, k in zip(often.tolist(), bucket_of.tolist()):
                by_bucket.setdefault(k, []).append(words[i])
            rows = [(-1, None, None, pack([planes(bucket_of)])),
                    *((-2, None, k, pack(w)) for k, w in by_bucket.items())]
            rows += [(i, -1, None, pack_places(rank[np.concatenate(block)]))
                     for i, block in enumerate(blocks) if block]
            part, number, bucket, body = zip(*rows)
            k = len(rows)
            yield pa.RecordBatch.from_arrays(
                [pa.array([f"{task}-{chunk}"] * k), pa.array(part, pa.int32()), pa.array(number, pa.int32()),
                 pa.nulls(k, pa.int32()), pa.array(bucket, pa.int32()), pa.array(body, pa.binary()),
                 *(pa.nulls(k, t) for t in types)], names=names)

        for b in batches:
            types = [c.type for c in b.columns[:len(carry)]]
            a = 0
            for r, t in enumerate(b.column(len(carry))):
                text = t.as_py() or ""
                got = find(text)
                blocks[-1].append(np.fromiter(map(seen.__getitem__, got), np.uint32, len(got)))
                chars, block_chars = chars + len(text), block_chars + len(text)
                if block_chars >= BLOCK_CHARS or chars >= chunk_chars:
                    yield documents(b, a)
                    blocks.append([])
                    block_chars, told, a = 0, 0, r + 1
                if chars >= chunk_chars:
                    yield from lists()
                    chunk, seen, chars, blocks = chunk + 1, Places(), 0, [[]]
            if len(blocks[-1]) > told:
                yield documents(b, a)
                told = len(blocks[-1])
        if blocks[0]:
            yield from lists()

    return docs.select(*carry, "text").mapInArrow(run, schema)


def _encode_buckets(words: DataFrame, ranks) -> DataFrame:  # noqa: ANN001 - a broadcast of ranks
    """(chunk, bucket, body) per word list: the ids of its words, in its order."""

    def run(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        table = ranks.value
        known: dict[bytes, list[int]] = {}
        out = []
        for raw in group["body"]:
            bounds, content = unpack(raw)
            data = content.tobytes()
            ids: list[int] = []
            sizes = []
            for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
                w = data[a:b]
                got = known.get(w)
                if got is None:
                    got = known[w] = encode_word(w, table)
                ids += got
                sizes.append(len(got))
            out.append(pack([planes(np.array(sizes, np.uint32)), planes(np.array(ids, np.uint32))]))
        return pd.DataFrame({"chunk": group["chunk"], "bucket": group["bucket"], "body": out})

    return words.groupBy("bucket").applyInPandas(run, "chunk string, bucket int, body binary")


def _chunk_table(answers: list[tuple[int, bytes]], bucket_of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bounds, ids) of a chunk's words by place, from the answers (bucket, body)."""
    sizes, ids = [np.zeros(0, np.uint32)], [np.zeros(0, np.uint32)]
    for _, raw in sorted(answers):
        bounds, content = unpack(raw)
        sizes.append(from_planes(content[:bounds[1]]))
        ids.append(from_planes(content[bounds[1]:]))
    starts = np.concatenate([[0], np.cumsum(np.concatenate(sizes), dtype=np.int64)])
    # answers in order of bucket hold the places in order of (bucket, place)
    at = np.empty(len(bucket_of), np.int64)
    at[np.argsort(bucket_of, kind="stable")] = np.arange(len(bucket_of))
    return gather(starts, np.concatenate(ids), at)


def _decimal_table(n: int) -> tuple[np.ndarray, np.ndarray]:
    parts = [b"%d," % i for i in range(n)]
    return (np.concatenate([[0], np.cumsum([len(p) for p in parts])]),
            np.frombuffer(b"".join(parts), np.uint8))


def _byte_table(ranks: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
    """Bounds and content of the token bytes by id; ids without a token are empty."""
    n = max(ranks.values()) + 1
    parts = [b""] * n
    for token, r in ranks.items():
        parts[r] = token
    return (np.concatenate([[0], np.cumsum([len(p) for p in parts])]),
            np.frombuffer(b"".join(parts), np.uint8))


class Decoder:
    """Joins ids with the table of token bytes."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.bounds, self.content = _byte_table(ranks)

    def __call__(self, ids: np.ndarray) -> bytes:
        return gather(self.bounds, self.content, ids.astype(np.int64))[1].tobytes()


def encode(docs: DataFrame, carry: list[str], ranks: dict[bytes, int], pattern: str,
           chunk_chars: int = CHUNK_CHARS, n_buckets: int | None = None) -> DataFrame:
    """``carry`` columns plus ``ids`` (packed little-endian uint32) for each row of ``docs``."""
    return _reassembled(docs, carry, ranks, pattern, chunk_chars, n_buckets)


def decode(encoded: DataFrame, ranks: dict[bytes, int], carry: list[str], spell: bool = False) -> DataFrame:
    """``carry`` plus ``decoded`` (bytes) from packed ``ids``; ``spell`` adds ``spelled``, the ids as
    decimal numbers with commas between."""
    shared = encoded.sparkSession.sparkContext.broadcast(ranks)
    added = ["decoded", "spelled"] if spell else ["decoded"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(shared.value)
        bounds, content = _decimal_table(len(decoder.bounds) - 1)
        for whole in batches:
            size = np.cumsum([len(x.as_buffer()) + 64 for x in whole.column(len(carry))])
            edges = np.flatnonzero(np.diff(size // DECODED_BYTES, prepend=-1)).tolist() + [whole.num_rows]
            for i, j in zip(edges[:-1], edges[1:]):
                b = whole.slice(i, j - i)
                ids = [np.frombuffer(x.as_buffer(), np.uint32) for x in b.column(len(carry))]
                out = [pa.array([decoder(x) for x in ids], pa.binary())]
                if spell:
                    out.append(pa.array([gather(bounds, content, x.astype(np.int64))[1].tobytes()[:-1] for x in ids],
                                        pa.binary()))
                yield pa.RecordBatch.from_arrays([*b.columns[:len(carry)], *out], names=[*carry, *added])

    schema = encoded.select(*carry).schema
    for c in added:
        schema = schema.add(c, "binary")
    return encoded.select(*carry, "ids").mapInArrow(run, schema)


def _reassembled(docs: DataFrame, carry: list[str], ranks: dict[bytes, int], pattern: str,
                 chunk_chars: int, n_buckets: int | None) -> DataFrame:
    spark = docs.sparkSession
    n_buckets = n_buckets or partitions(spark)
    shared = spark.sparkContext.broadcast(ranks)
    rows = cut_lineage(_split(docs, carry, pattern, chunk_chars, n_buckets), "bpe-split")
    answers = _encode_buckets(rows.where("part = -2").select("bucket", "chunk", "body"), shared)
    # each chunk's answers, then the bucket of each place, then its blocks, each followed by its documents
    stream = (rows.where("part > -2").unionByName(answers.withColumn("part", F.lit(-2)), allowMissingColumns=True)
              .repartition("chunk").sortWithinPartitions("chunk", "part", "bucket", "number"))
    given = docs.select(*carry).schema
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in given] + ["ids binary"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        answers: list[tuple[int, bytes]] = []
        bounds = table = places = None
        at = 0  # pre-tokens of the block given out so far
        for b in batches:
            part, number = (b.column(i).fill_null(-1).to_numpy() for i in (1, 2))
            n = b.column(3).fill_null(0).to_numpy().astype(np.int64)
            i = 0
            while i < b.num_rows:
                if number[i] < 0:
                    body = b.column(5)[i].as_buffer()
                    if part[i] == -2:
                        answers.append((b.column(4)[i].as_py(), body.to_pybytes()))
                    elif part[i] == -1:
                        found, data = unpack(body)
                        bounds, table = _chunk_table(answers, from_planes(data[found[0]:found[1]]))
                        answers = []
                    else:
                        places, at = unpack_places(body), 0
                    i += 1
                    continue
                j = i + int(np.argmax(np.append(number[i:] < 0, True)))
                ends = np.concatenate([[0], np.cumsum(n[i:j])])
                found, ids = gather(bounds, table, places[at:at + ends[-1]])
                offsets = (4 * found[ends]).astype(np.int64)
                out = pa.Array.from_buffers(pa.large_binary(), j - i, [
                    None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(ids.astype("<u4").tobytes())])
                yield pa.RecordBatch.from_arrays([*b.slice(i, j - i).columns[6:], out.cast(pa.binary())],
                                                 names=[*carry, "ids"])
                at += int(ends[-1])
                i = j

    return stream.mapInArrow(run, schema)


def digests() -> list[Column]:
    """Digest columns of ``decode(spell=True)``."""
    return [F.sha2("spelled", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")]


def production() -> tuple[dict[bytes, int], str]:
    import public_tokenizers

    return load_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")), public_tokenizers.PATTERN


def bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query op10: every document encoded and decoded."""
    ranks, pattern = production()
    n_tokens = F.floor(F.octet_length("ids") / 4).alias("n_tokens")
    encoded = encode(read(spark, sf_dir, "documents").select("doc_id", "text"), ["doc_id"], ranks, pattern)
    back = decode(encoded.select("doc_id", n_tokens, "ids"), ranks, ["doc_id", "n_tokens"], spell=True)
    return back.select("doc_id", "n_tokens", *digests())


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Last pipeline stage: doc_id, lang, source, the packed ids, and digests of ids and decoded text."""
    carry = ["doc_id", "lang", "source"]
    ranks, pattern = production()
    n_tokens = F.floor(F.octet_length("ids") / 4).alias("n_tokens")
    # stored, so that the workers that reassemble and those that decode need no memory at the same time
    encoded = cut_lineage(encode(docs.select(*carry, "text"), carry, ranks, pattern), "bpe-ids")
    back = decode(encoded, ranks, [*carry, "ids"], spell=True)
    return back.select(*carry, "ids", n_tokens, *digests())
