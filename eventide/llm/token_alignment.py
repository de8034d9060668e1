"""Alignment of two tokenizers' tokens over whole texts (operator 11).

Tokenizer A is a byte-level file of the tokenizers library and reads a space before each text;
tokenizer B is a sentencepiece model that adds this space itself. Both then cover the same bytes.

1. *Segments.* Texts are cut where neither tokenizer can join tokens (see ``vocabulary_files``);
   documents are gathered into chunks, and each distinct segment of a chunk is encoded once; a worker
   process keeps the tokens of up to ``KNOWN`` short ones for its later chunks and tasks. Tokens of
   both end at every segment's end, so groups and links of a text are those of its segments.
2. *Spans.* The character offsets of A and the byte spans of B's proto are coarse cuts. Tokens of A
   that share a character (parts of a multibyte one) and runs of B's byte-fallback tokens are placed
   within their common span by the lengths of their decoded bytes. A segment whose decoded bytes
   differ from its own is invalid and makes its document one without tokens; where spans and
   decoded lengths of a valid segment should disagree, the decoded lengths hold.
3. *Links.* Between two neighbouring ends, of A or B, lies exactly one overlap of a token of A and a
   token of B: the ends' union gives all links, their intersection the groups.
4. *Counts.* Each chunk sends its distinct id pairs with their links in valid documents; the sums
   are made by pair, the highest of each B id by that id, and both are joined back to the chunks.
5. *Reassembly.* Sorted by chunk, the counts come first and the documents follow block by block.

A task holds one chunk's distinct segments (a longer document ends its chunk) and pairs; a frequent
pair is one row per chunk. The highest counts are one row per id of B's vocabulary, broadcast under
``MAX_IDS``; a larger vocabulary is joined by id.

Null and empty texts, and texts that either tokenizer does not give back byte by byte, have zeros
and the empty string. Repeated rows are aligned each; only columns named in ``carry`` are read beside
``text``, so clashing names of others do not matter. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import repeat
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventide.llm.common import read
from eventide.llm.packed import Places, from_planes, gather, pack, pack_places, planes, unpack, unpack_places
from eventide.llm.vocabulary_files import ByteLevel, Pieces, TokenizerFile, runs, segments_unspaced
from eventide.session import cut_lineage

MAX_IDS = 1 << 20
#: short segments whose tokens a worker process keeps from one chunk to the next
KNOWN, SHORT = 300_000, 64


class Sizes(NamedTuple):
    """How much a task holds at once."""

    chunk_chars: int = 24_000_000
    block_chars: int = 1_000_000
    slice_chars: int = 100_000  # distinct segments encoded at once
    slice_segments: int = 20_000  # segments whose links are made at once


MEASURES = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]


# ---- spans ------------------------------------------------------------------------------------

def _refined(begin: np.ndarray, end: np.ndarray, size: np.ndarray, goes_on: np.ndarray) -> np.ndarray:
    """Ends of tokens; runs (``goes_on``: token i belongs to the run of i - 1) are placed by ``size``."""
    if not len(end):
        return end
    first = np.flatnonzero(~goes_on)
    run = np.cumsum(~goes_on) - 1
    behind = np.cumsum(size)
    inner = begin[first][run] + behind - (behind - size)[first][run]
    several = np.diff(np.append(first, len(end)))[run] > 1
    return np.where(several, inner, end)


def _same_bytes(bounds: np.ndarray, data: np.ndarray, token_bounds: np.ndarray, content: np.ndarray,
                ids: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Per segment: do the joined bytes of its tokens equal its own?"""
    at, joined = gather(token_bounds, content, ids)
    own = at[np.concatenate([[0], np.cumsum(n)])]
    good = np.diff(own) == np.diff(bounds)
    keep = np.flatnonzero(good)
    ends, left = gather(bounds, data, keep)
    right = gather(own, joined, keep)[1]
    wrong = np.searchsorted(ends, np.flatnonzero(left != right), "right") - 1
    good[keep[wrong]] = False
    return good


class Aligner:
    """Both tokenizers opened in a task, with the bytes of their ids."""

    def __init__(self, a: ByteLevel, b: Pieces) -> None:
        self.a, self.b = a, b
        self.cuts = a.cuts and b.cuts
        self.bytes_a, self.bytes_b = a.token_bytes(), b.token_bytes()
        self.size_a, self.size_b = np.diff(self.bytes_a[0]), np.diff(self.bytes_b[0])
        self.byte_piece = b.is_byte()
        self.known: dict[str, int] = {}
        self.kept = Tokens.none()

    def encoded(self, parts: list[str]) -> Encoded:
        """Ids of segments, each beginning with the space; token ends are checked on the way.

        Segments are encoded in runs: a cut between two of them is as safe as it was in their texts.
        """
        raw = [p.encode() for p in parts]
        bounds = np.concatenate([[0], np.cumsum([len(r) for r in raw], dtype=np.int64)])
        data = np.frombuffer(b"".join(raw), np.uint8)
        edges = runs(parts, self.cuts)
        texts = ["".join(parts[i:j]) for i, j in zip(edges[:-1], edges[1:])]
        # A: characters of the run
        n, ids_a, chars = self.a.spans(texts)
        run = np.repeat(np.arange(len(texts)), n)
        byte_of = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))
        base = np.concatenate([[0], np.cumsum([len(t) for t in texts], dtype=np.int64)])[run]
        begin, end = byte_of[base + chars[:, 0]], byte_of[base + chars[:, 1]]
        shares = np.zeros(len(run), bool)
        shares[1:] = (begin[1:] < end[:-1]) & (run[1:] == run[:-1])
        ends_a = _refined(begin, end, self.size_a[ids_a], shares)
        # B: bytes of the run after its space, which the model adds
        n, ids_b, spans = self.b.spans([t[1:] for t in texts])
        run = np.repeat(np.arange(len(texts)), n)
        base = bounds[edges[:-1]][run] + 1
        begin, end = base + spans[:, 0], base + spans[:, 1]
        is_byte = self.byte_piece[ids_b]
        falls = np.zeros(len(run), bool)
        falls[1:] = is_byte[1:] & is_byte[:-1] & (run[1:] == run[:-1])
        ends_b = _refined(begin, end, self.size_b[ids_b], falls)
        # no token reaches over a cut, so its end tells its segment
        seg_a, seg_b = (np.searchsorted(bounds[1:], e) for e in (ends_a, ends_b))
        n_a, n_b = (np.bincount(s, minlength=len(parts)) for s in (seg_a, seg_b))
        valid = (_same_bytes(bounds, data, *self.bytes_a, ids_a, n_a)
                 & _same_bytes(bounds, data, *self.bytes_b, ids_b, n_b))
        return Encoded(np.diff(bounds), valid, n_a, n_b, ids_a, ids_b,
                       self._checked(bounds, valid, seg_a, ends_a, self.size_a[ids_a]),
                       self._checked(bounds, valid, seg_b, ends_b, self.size_b[ids_b]))

    @staticmethod
    def _checked(bounds: np.ndarray, valid: np.ndarray, seg: np.ndarray, ends: np.ndarray,
                 size: np.ndarray) -> np.ndarray:
        """Ends by decoded lengths in valid segments where the spans do not agree with them."""
        exact = decoded_ends(bounds, seg, size)
        off = np.zeros(len(valid), bool)
        off[seg[ends != exact]] = True
        return np.where((off & valid)[seg], exact, ends)

    def decoded(self, length: np.ndarray, valid: np.ndarray, n_a: np.ndarray, n_b: np.ndarray,
                ids_a: np.ndarray, ids_b: np.ndarray) -> Encoded:
        """``Encoded`` again from stored ids: its ends equal the decoded lengths, as has been checked."""
        bounds = np.concatenate([[0], np.cumsum(length)])
        seg_a, seg_b = (np.repeat(np.arange(len(n)), n) for n in (n_a, n_b))
        return Encoded(length, valid, n_a, n_b, ids_a, ids_b, decoded_ends(bounds, seg_a, self.size_a[ids_a]),
                       decoded_ends(bounds, seg_b, self.size_b[ids_b]))


@lru_cache(maxsize=1)
def opened(a: TokenizerFile, b: TokenizerFile) -> Aligner:
    """The tools of a worker process, which runs many tasks."""
    return Aligner(a.open(), b.open())


def decoded_ends(bounds: np.ndarray, seg: np.ndarray, size: np.ndarray) -> np.ndarray:
    behind = np.cumsum(size)
    first = np.searchsorted(seg, np.arange(len(bounds) - 1))
    before = np.concatenate([[0], behind])[first]
    return bounds[:-1][seg] + behind - before[seg]


@dataclass
class Encoded:
    """Tokens of consecutive segments; ends are byte positions over all of them."""

    length: np.ndarray
    valid: np.ndarray
    n_a: np.ndarray
    n_b: np.ndarray
    ids_a: np.ndarray
    ids_b: np.ndarray
    ends_a: np.ndarray
    ends_b: np.ndarray

    def aligned(self) -> Aligned:
        """Links and groups of the valid segments.

        Ends are positions in a slice of few bytes, so counts by position stand in for sorting.
        """
        k, borders = len(self.valid), np.cumsum(self.length)
        size = int(borders[-1]) + 1 if k else 1
        use_a, use_b = np.repeat(self.valid, self.n_a), np.repeat(self.valid, self.n_b)
        ids_a, ids_b = self.ids_a[use_a], self.ids_b[use_b]
        ends_a, ends_b = self.ends_a[use_a], self.ends_b[use_b]
        at_a, at_b, at_border = (np.bincount(x, minlength=size) for x in (ends_a, ends_b, borders))
        before_a, before_b, before_border = (np.cumsum(x) - x for x in (at_a, at_b, at_border))
        union = np.flatnonzero(at_a + at_b)
        common = np.flatnonzero((at_a > 0) & (at_b > 0))
        pair = ids_a[before_a[union]] << 32 | ids_b[before_b[union]]
        groups = np.bincount(before_border[common], minlength=k)
        return Aligned(before_border[union], pair, groups, np.where(self.valid, self.n_a + self.n_b, 0),
                       ids_a, ids_b, (before_a + at_a)[common], (before_b + at_b)[common])


@dataclass
class Aligned:
    link_seg: np.ndarray  # segment of each link, rising
    pair: np.ndarray  # A id << 32 | B id
    groups: np.ndarray  # per segment
    tokens: np.ndarray  # per segment, how many ids
    ids_a: np.ndarray
    ids_b: np.ndarray
    upto_a: np.ndarray  # per group, how many A ids it and those before it have
    upto_b: np.ndarray

    def spelled(self) -> tuple[np.ndarray, np.ndarray]:
        """Ids in order of (segment, group, side), and what follows each of them: , | or ;"""
        own_a, own_b = (np.diff(x, prepend=0) for x in (self.upto_a, self.upto_b))
        place_a = np.arange(len(self.ids_a)) + np.repeat(self.upto_b - own_b, own_a)
        place_b = np.arange(len(self.ids_b)) + np.repeat(self.upto_a, own_b)
        ids = np.empty(len(place_a) + len(place_b), np.int64)
        ids[place_a], ids[place_b] = self.ids_a, self.ids_b
        sign = np.full(len(ids), ord(","), np.uint8)
        sign[place_a[self.upto_a - 1]] = ord("|")
        sign[place_b[self.upto_b - 1]] = ord(";")
        return ids, sign


class Tokens(NamedTuple):
    """The tokens of a chunk's distinct segments, as they are stored."""

    length: np.ndarray
    valid: np.ndarray
    n_a: np.ndarray
    n_b: np.ndarray
    ids_a: np.ndarray
    ids_b: np.ndarray

    @classmethod
    def none(cls) -> Tokens:
        return cls(np.zeros(0, np.uint32), np.zeros(0, bool), *[np.zeros(0, np.uint32)] * 4)

    @classmethod
    def of(cls, e: Encoded) -> Tokens:
        return cls(e.length.astype(np.uint32), e.valid, *(
            x.astype(np.uint32) for x in (e.n_a, e.n_b, e.ids_a, e.ids_b)))

    def and_then(self, *others: Tokens) -> Tokens:
        return Tokens(*map(np.concatenate, zip(self, *others)))

    def filled(self, place: np.ndarray, new: Tokens) -> Tokens:
        """The segments at ``place``; where it is negative, those of ``new`` in their order."""
        own = place >= 0
        known = self.taken(place[own])
        length, valid, n_a, n_b = (_mixed(own, x, y) for x, y in zip(known[:4], new[:4]))
        return Tokens(length, valid, n_a, n_b, _mixed(np.repeat(own, n_a), known.ids_a, new.ids_a),
                      _mixed(np.repeat(own, n_b), known.ids_b, new.ids_b))

    def taken(self, places: np.ndarray) -> Tokens:
        """The segments at ``places``, in their order."""
        at_a, at_b = (np.concatenate([[0], np.cumsum(n, dtype=np.int64)]) for n in (self.n_a, self.n_b))
        return Tokens(self.length[places], self.valid[places], self.n_a[places], self.n_b[places],
                      gather(at_a, self.ids_a, places)[1], gather(at_b, self.ids_b, places)[1])

    def packed(self) -> bytes:
        return pack([planes(x) for x in self])

    @classmethod
    def unpacked(cls, raw: pa.Buffer) -> Tokens:
        bounds, data = unpack(raw)
        length, valid, *rest = (from_planes(data[x:y]) for x, y in zip(bounds[:-1], bounds[1:]))
        return cls(length, valid.astype(bool), *rest)

    def slices(self, tools: Aligner, step: int) -> Iterator[tuple[int, int, Aligned]]:
        """(first segment, next one, their links and groups), ``step`` segments at a time."""
        at_a, at_b = (np.concatenate([[0], np.cumsum(n, dtype=np.int64)]) for n in (self.n_a, self.n_b))
        for i in range(0, len(self.valid), step):
            j = min(i + step, len(self.valid))
            yield i, j, tools.decoded(
                self.length[i:j].astype(np.int64), self.valid[i:j],
                self.n_a[i:j].astype(np.int64), self.n_b[i:j].astype(np.int64),
                self.ids_a[at_a[i]:at_a[j]].astype(np.int64), self.ids_b[at_b[i]:at_b[j]].astype(np.int64)).aligned()


def _mixed(where: np.ndarray, yes: np.ndarray, no: np.ndarray) -> np.ndarray:
    out = np.empty(len(where), no.dtype)
    out[where], out[~where] = yes, no
    return out


def _stored(tools: Aligner, texts: list[str], slice_chars: int) -> Tokens:
    """Tokens of distinct segments (without the space each begins with); only those not known are encoded."""
    place = np.fromiter(map(tools.known.get, texts, repeat(-1)), np.int64, len(texts))
    fresh = np.flatnonzero(place < 0)
    rest = [texts[i] for i in fresh.tolist()]
    new = Tokens.none().and_then(*(Tokens.of(tools.encoded(part)) for part in _slices(rest, slice_chars)))
    out = new if len(rest) == len(texts) else tools.kept.filled(place, new)
    if len(tools.known) == KNOWN and 10 * len(rest) > 9 * len(texts):  # other texts than before
        tools.known, tools.kept = {}, Tokens.none()
    if room := KNOWN - len(tools.known):
        short = [i for i, t in enumerate(rest) if len(t) <= SHORT][:room]
        tools.known.update(zip((rest[i] for i in short), range(len(tools.known), KNOWN)))
        tools.kept = tools.kept.and_then(new.taken(np.array(short, np.int64)))
    return out


def _slices(texts: list[str], chars: int) -> Iterator[list[str]]:
    """Segments with their space, about ``chars`` at a time."""
    behind, i = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1), 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(behind, (behind[i - 1] if i else 0) + chars, "right")))
        yield [f" {t}" for t in texts[i:j]]
        i = j


def _coded(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct values as first seen, place of each value among them)."""
    coded = pa.array(values, pa.int64()).dictionary_encode()
    return coded.dictionary.to_numpy(), coded.indices.to_numpy()


def _spelled(ids: np.ndarray, sign: np.ndarray, tokens: np.ndarray, table: tuple[np.ndarray, np.ndarray]
             ) -> tuple[np.ndarray, np.ndarray]:
    """(bounds, content) of the groups of each segment as text, each group with its closing ``;``."""
    at, content = gather(*table, ids)
    content = content.copy()
    content[at[1:] - 1] = sign
    return at[np.concatenate([[0], np.cumsum(tokens)])], content


def _decimals(n: int) -> tuple[np.ndarray, np.ndarray]:
    parts = [b"%d," % i for i in range(n)]
    return np.concatenate([[0], np.cumsum([len(p) for p in parts])]), np.frombuffer(b"".join(parts), np.uint8)


# ---- first pass: chunks -----------------------------------------------------------------------

def _split(docs: DataFrame, carry: list[str], files, sizes: Sizes) -> DataFrame:  # noqa: ANN001 - a broadcast
    """Rows of a chunk, told apart by ``part`` and ``number``:

    * part -2, number k: the k-th distinct pair of the chunk and its links in valid documents;
    * part -1: the chunk's segments: their lengths, validity and ids;
    * part i, number -1: the places of the segments of block i, in order of document and position;
    * part i, number j: the j-th document of block i, how many segments it has, ``carry``.
    """
    given = docs.select(*carry).schema
    schema = "chunk string, part int, number int, n int, pair long, links long, body binary" + "".join(
        f", `_c{i}` {f.dataType.simpleString()}" for i, f in enumerate(given))
    names = ["chunk", "part", "number", "n", "pair", "links", "body", *[f"_c{i}" for i in range(len(carry))]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tools = opened(*files.value)
        task = TaskContext.get().partitionId()
        chunk, seen, chars, block_chars, told = 0, Places(), 0, 0, 0
        blocks: list[list[np.ndarray]] = [[]]
        types: list[pa.DataType] = []

        def rows(part, number, n, pair, links, body) -> pa.RecordBatch:  # noqa: ANN001 - columns of lists
            k = len(part)
            return pa.RecordBatch.from_arrays(
                [pa.array([f"{task}-{chunk}"] * k, pa.string()), pa.array(part, pa.int32()),
                 pa.array(number, pa.int32()), pa.array(n, pa.int32()), pa.array(pair, pa.int64()),
                 pa.array(links, pa.int64()), pa.array(body, pa.binary()), *(pa.nulls(k, t) for t in types)],
                names=names)

        def documents(b: pa.RecordBatch, a: int) -> pa.RecordBatch:
            size = [len(h) for h in blocks[-1][told:]]
            k, none = len(size), [None] * len(size)
            plain = rows([len(blocks) - 1] * k, range(told, told + k), size, none, none, none)
            return pa.RecordBatch.from_arrays([*plain.columns[:7], *b.slice(a, k).columns[:len(carry)]], names=names)

        def lists() -> Iterator[pa.RecordBatch]:
            tokens = _stored(tools, list(seen), sizes.slice_chars)
            uses = np.zeros(len(seen), np.int64)
            for block in blocks:
                good = [doc for doc in block if tokens.valid[doc].all()]
                if good:
                    uses += np.bincount(np.concatenate(good), minlength=len(uses))
            pairs, links = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for i, _, part in tokens.slices(tools, sizes.slice_segments):
                distinct, which = _coded(part.pair)
                pairs.append(distinct)
                links.append(np.bincount(which, uses[part.link_seg + i], len(distinct)).astype(np.int64))
            distinct, which = np.unique(np.concatenate(pairs), return_inverse=True)
            total = np.bincount(which, np.concatenate(links), len(distinct)).astype(np.int64)
            k, none = len(distinct), [None] * len(distinct)
            yield rows(np.full(k, -2), np.arange(k), none, distinct, total, none)
            filled = [i for i, block in enumerate(blocks) if block]
            bodies = [tokens.packed(), *(pack_places(np.concatenate(blocks[i])) for i in filled)]
            k, none = len(bodies), [None] * len(bodies)
            yield rows([-1, *filled], [-1] * k, none, none, none, bodies)

        for b in batches:
            types = [c.type for c in b.columns[:len(carry)]]
            a = 0
            for r, t in enumerate(b.column(len(carry))):
                text = t.as_py() or ""
                got = segments_unspaced(text, tools.cuts) if text else []
                blocks[-1].append(np.fromiter(map(seen.__getitem__, got), np.uint32, len(got)))
                chars, block_chars = chars + len(text), block_chars + len(text)
                if block_chars >= sizes.block_chars or chars >= sizes.chunk_chars:
                    yield documents(b, a)
                    blocks.append([])
                    block_chars, told, a = 0, 0, r + 1
                if chars >= sizes.chunk_chars:
                    yield from lists()
                    chunk, seen, chars, blocks = chunk + 1, Places(), 0, [[]]
            if len(blocks[-1]) > told:
                yield documents(b, a)
                told = len(blocks[-1])
        if blocks[0]:
            yield from lists()

    return docs.select(*carry, "text").mapInArrow(run, schema)


# ---- counts and second pass -------------------------------------------------------------------

def pair_counts(rows: DataFrame) -> DataFrame:
    """(pair, count, best): links of each id pair over all chunks; ``best`` marks the highest of its B id."""
    total = cut_lineage(rows.where("part = -2").groupBy("pair").agg(F.sum("links").alias("count")), "align-pairs")
    own = F.col("pair").bitwiseAND(F.lit((1 << 32) - 1))
    top = cut_lineage(total.groupBy(own.alias("b")).agg(F.max("count").alias("top")), "align-tops")
    if top.count() <= MAX_IDS:
        top = F.broadcast(top)
    return total.withColumn("b", own).join(top, "b").select("pair", "count", (F.col("count") == F.col("top")).alias("best"))


def align(docs: DataFrame, carry: list[str], a: TokenizerFile, b: TokenizerFile,
          sizes: Sizes = Sizes()) -> DataFrame:
    """``carry`` columns, the six measures and ``groups`` (``a1,a2|b1;...`` as bytes) of each row."""
    files = docs.sparkSession.sparkContext.broadcast((a, b))
    rows = cut_lineage(_split(docs, carry, files, sizes), "align-split")
    counted = rows.where("part = -2").select("chunk", "part", "number", "pair").join(pair_counts(rows), "pair")
    answers = counted.select("chunk", "part", "number", "pair", "count", "best")
    stream = (rows.where("part > -2").drop("pair", "links").unionByName(answers, allowMissingColumns=True)
              .repartition("chunk").sortWithinPartitions("chunk", "part", "number"))
    given = docs.select(*carry).schema
    columns = [f"_c{i}" for i in range(len(carry))]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in given]
                       + [f"{m} long" for m in MEASURES] + ["groups binary"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tools = opened(*files.value)
        decimals = _decimals(max(len(tools.size_a), len(tools.size_b)))
        known: list[pa.RecordBatch] = []
        valid = values = spelled = places = None
        at = 0
        for batch in batches:
            part, number = batch.column(1).to_numpy(), batch.column(2).to_numpy()
            n = batch.column(3).fill_null(0).to_numpy().astype(np.int64)
            i = 0
            while i < batch.num_rows:
                if part[i] == -2:  # the counts of the chunk's pairs, in their order
                    j = i + int(np.argmax(np.append(part[i:] != -2, True)))
                    known.append(batch.slice(i, j - i).select(["pair", "count", "best"]))
                    i = j
                elif part[i] == -1:
                    valid, values, spelled = _chunk(tools, batch.column(4)[i].as_buffer(), known, decimals,
                                                    sizes.slice_segments)
                    known, i = [], i + 1
                elif number[i] < 0:
                    places, at, i = unpack_places(batch.column(4)[i].as_buffer()), 0, i + 1
                else:
                    j = i + int(np.argmax(np.append((number[i:] < 0) | (part[i:] < 0), True)))
                    ends = np.concatenate([[0], np.cumsum(n[i:j])])
                    own = places[at:at + ends[-1]]
                    ok = np.diff(np.concatenate([[0], np.cumsum(~valid[own])])[ends]) == 0
                    sums = [np.where(ok, np.diff(np.concatenate([[0], np.cumsum(v[own])])[ends]), 0) for v in values]
                    found, text = gather(*spelled, own)
                    text = [text[found[x]:max(found[x], found[y] - 1)].tobytes() if good else b""
                            for x, y, good in zip(ends[:-1], ends[1:], ok)]
                    yield pa.RecordBatch.from_arrays(
                        [*batch.slice(i, j - i).select(columns).columns, *(pa.array(s, pa.int64()) for s in sums),
                         pa.array(text, pa.binary())], names=[*carry, *MEASURES, "groups"])
                    at += int(ends[-1])
                    i = j

    ordered = stream.select("chunk", "part", "number", "n", "body", "pair", "count", "best", *columns)
    return ordered.mapInArrow(run, schema)


def _chunk(tools: Aligner, body: pa.Buffer, known: list[pa.RecordBatch],
           decimals: tuple[np.ndarray, np.ndarray], step: int
           ) -> tuple[np.ndarray, list[np.ndarray], tuple[np.ndarray, np.ndarray]]:
    """Per segment of a chunk: validity, the six measures, the groups as text."""
    tokens = Tokens.unpacked(body)
    pair, count, best = (np.concatenate([np.zeros(0, np.int64), *(
        k.column(c).to_numpy(zero_copy_only=False) for k in known)]).astype(np.int64) for c in range(3))
    values: list[list[np.ndarray]] = [[np.zeros(0, np.int64)] for _ in range(4)]
    size, content = [np.zeros(0, np.int64)], [np.zeros(0, np.uint8)]
    for i, j, links in tokens.slices(tools, step):
        distinct, which = _coded(links.pair)
        which = np.searchsorted(pair, distinct)[which]
        first = np.searchsorted(links.link_seg, np.arange(j - i + 1))
        sums = [np.diff(np.concatenate([[0], np.cumsum(x[which])])[first]) for x in (best, count)]
        for to, x in zip(values, [links.groups, np.diff(first), *sums]):
            to.append(x)
        ends, text = _spelled(*links.spelled(), links.tokens, decimals)
        size.append(np.diff(ends))
        content.append(text)
    return (tokens.valid, [tokens.n_a.astype(np.int64), tokens.n_b.astype(np.int64), *map(np.concatenate, values)],
            (np.concatenate([[0], np.cumsum(np.concatenate(size))]), np.concatenate(content)))


def token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query op11: every document aligned between the byte-level and the sentencepiece file."""
    import public_tokenizers

    a = TokenizerFile.read(public_tokenizers.path("byte_bpe_50k.json"), plain=True)
    b = TokenizerFile.read(public_tokenizers.path("piece_bpe_32k.model"))
    out = align(read(spark, sf_dir, "documents"), ["doc_id"], a, b)
    digest = F.when(F.col("n_a") > 0, F.sha2("groups", 256)).otherwise("")
    return out.select("doc_id", *MEASURES, digest.alias("groups_sha256"))
