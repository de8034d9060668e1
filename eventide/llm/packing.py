"""Token-id output in packed rows by best-fit decreasing (operator 8).

Documents become token ids; a document longer than a row is split, losslessly, into full rows and a
rest. Within a *shard*, pieces go in decreasing size into the row with the least room that still
fits; that row is found by a segment tree over remaining capacities. A task packs the documents
of its input split in shards of about ``SHARD_TOKENS``, so nothing is shuffled, a task's memory does
not depend on the corpus, and a lost task packs the same split again. Every row of the packed
matrix carries its ids (little-endian uint32, padded), the cumulative lengths of its segments,
positions that restart at 0 with each segment, and for each segment its document and offset, from
which ``unpack`` restores the texts.

A document without tokens (null or empty text) has no segment. Repeated rows and ids, and null ids,
are packed like any other; a segment names its document's ``doc_id`` and ``copy``, a number that is
unique in its shard. An empty table gives no rows. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventide.llm.common import read

ROW_TOKENS = 2048
SHARD_TOKENS = 1 << 21
PAD = 50_256
SCHEMA = ("shard string, row int, ids binary, n_tokens int, cu_seqlens array<int>, positions binary, "
          "doc_ids array<long>, copies array<int>, offsets array<long>")


class CapacityTree:
    """Rows by remaining capacity; finds the least capacity of at least a size in O(log capacity)."""

    def __init__(self, capacity: int) -> None:
        self.leaves = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.rows: list[list[int]] = [[] for _ in range(capacity + 1)]

    def _add(self, capacity: int, by: int) -> None:
        i = capacity + self.leaves
        while i:
            self.count[i] += by
            i >>= 1

    def put(self, capacity: int, row: int) -> None:
        self.rows[capacity].append(row)
        self._add(capacity, 1)

    def take(self, size: int) -> tuple[int, int] | None:
        """(capacity, row) of the fullest row with room for ``size``, removed from the tree."""
        i = size + self.leaves
        if not self.count[i]:
            while i > 1 and (i & 1 or not self.count[i + 1]):
                i >>= 1
            if i <= 1:
                return None
            i += 1
            while i < self.leaves:
                i = 2 * i if self.count[2 * i] else 2 * i + 1
        capacity = i - self.leaves
        self._add(capacity, -1)
        return capacity, self.rows[capacity].pop()


def best_fit_decreasing(sizes: list[int], capacity: int) -> list[list[int]]:
    """Rows of piece numbers; pieces of equal size go in input order."""
    tree, rows = CapacityTree(capacity), []
    for k in sorted(range(len(sizes)), key=lambda k: (-sizes[k], k)):
        found = tree.take(sizes[k])
        room, row = found if found else (capacity, len(rows))
        if not found:
            rows.append([])
        rows[row].append(k)
        if room > sizes[k]:
            tree.put(room - sizes[k], row)
    return rows


def _shard_rows(docs: list[tuple[int | None, np.ndarray]], shard: str, capacity: int, pad: int) -> pa.RecordBatch:
    pieces = [(d, a) for d, (_, ids) in enumerate(docs) for a in range(0, len(ids), capacity)]
    sizes = [min(capacity, len(docs[d][1]) - a) for d, a in pieces]
    out: list[list] = [[] for _ in range(9)]
    for r, row in enumerate(best_fit_decreasing(sizes, capacity)):
        cu = np.concatenate([[0], np.cumsum([sizes[k] for k in row])])
        ids = np.full(capacity, pad, np.uint32)
        positions = np.zeros(capacity, np.uint32)
        for s, k in zip(cu.tolist(), row):
            d, a = pieces[k]
            ids[s:s + sizes[k]] = docs[d][1][a:a + sizes[k]]
            positions[s:s + sizes[k]] = np.arange(sizes[k])
        values = (shard, r, ids.tobytes(), int(cu[-1]), cu.tolist(), positions.tobytes(),
                  [docs[pieces[k][0]][0] for k in row], [pieces[k][0] for k in row], [pieces[k][1] for k in row])
        for o, v in zip(out, values):
            o.append(v)
    types = [pa.string(), pa.int32(), pa.binary(), pa.int32(), pa.list_(pa.int32()), pa.binary(),
             pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int64())]
    names = [f.split()[0] for f in SCHEMA.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(o, t) for o, t in zip(out, types)], names=names)


def pack(docs: DataFrame, tokenizer: Callable[[], Callable[[str], list[int]]], capacity: int = ROW_TOKENS,
         shard_tokens: int = SHARD_TOKENS, pad: int = PAD) -> DataFrame:
    """The packed rows (SCHEMA) of ``docs(doc_id, text)``; ``tokenizer()`` is called once per task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokenizer()
        task, number = TaskContext.get().partitionId(), 0
        held, total = [], 0
        for b in batches:
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1)):
                ids = np.array(encode(text.as_py() or ""), np.uint32)
                held.append((doc_id, ids))
                total += len(ids)
                if total >= shard_tokens:
                    yield _shard_rows(held, f"{task}-{number}", capacity, pad)
                    held, total, number = [], 0, number + 1
        if total:
            yield _shard_rows(held, f"{task}-{number}", capacity, pad)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, SCHEMA)


def write_packed(packed: DataFrame, path: str) -> None:
    """Store packed rows, one folder per table, readable as matrices of ``ids`` by row."""
    packed.write.parquet(path)


def unpack(packed: DataFrame) -> DataFrame:
    """(doc_id, shard, copy, ids): the token ids of every document, its pieces joined by offset."""
    pieces = packed.select("shard", "ids", "cu_seqlens", F.posexplode("copies").alias("k", "copy"),
                           "doc_ids", "offsets")
    start = F.get("cu_seqlens", F.col("k"))
    piece = F.substring("ids", 4 * start + 1, 4 * (F.get("cu_seqlens", F.col("k") + 1) - start))
    parts = pieces.select("shard", "copy", F.get("doc_ids", F.col("k")).alias("doc_id"),
                          F.struct(F.get("offsets", F.col("k")).alias("offset"), piece.alias("ids")).alias("p"))
    whole = parts.groupBy("shard", "copy").agg(
        F.first("doc_id").alias("doc_id"), F.sort_array(F.collect_list("p")).alias("ps"))
    joined = F.aggregate("ps", F.lit(b""), lambda acc, p: F.concat(acc, p["ids"]))
    return whole.select("doc_id", "shard", "copy", joined.alias("ids"))


def production_tokenizer() -> Callable[[str], list[int]]:
    import public_tokenizers
    import tiktoken

    from eventide.llm.bpe_codec import load_ranks

    ranks = load_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    enc = tiktoken.Encoding("byte_bpe_multi_50k", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks,
                            special_tokens={})
    return enc.encode_ordinary


def packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query op8: every packed row of all documents, ids and positions as digests."""
    packed = pack(read(spark, sf_dir, "documents"), production_tokenizer)
    return packed.select("shard", "row", "n_tokens", F.size("copies").alias("n_segments"), "cu_seqlens", "doc_ids",
                         "offsets", F.sha2("ids", 256).alias("ids_sha256"),
                         F.sha2("positions", 256).alias("positions_sha256"))
