"""Document scores by masked pseudo-likelihood (operator 6).

A small bidirectional network predicts every token from ``SIDE`` tokens on either side: the
neighbours' embeddings (one table per relative place) are added, pass through tanh and a two-step
softmax (token class, then token in its class). Words beyond the ``FREQUENT`` most frequent share
hashed tokens; a third factor is the probability of the word among those of its token. A document's
score is the sum of the log probabilities of its words, each masked in turn.

Everything is learned from the whole corpus. All words are counted (partial counts per task, then a
shuffle by word) into a stored table, which grows with the corpus: the third factor of a word seen n
times is n / (N + 1), N being the occurrences of all words of its token; the rest, 1 / (N + 1), is
that of a word never counted. Chunks of about ``CHUNK_WORDS`` such words ask the table for each
distinct word once, in a join by word, and the answers meet the chunk's documents again. Training is data-parallel: each task runs Adagrad over its documents from common starting
weights, and the tasks' weights, weighted by tokens, are averaged block by block in a second
shuffle. Weights have a fixed size, so only they, the frequent words and N are broadcast.

Null or empty text: no tokens, score 0, mean null. Repeated rows are scored each. A corpus without
words gives every document score 0; an empty table gives no rows. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventide.llm import textbytes as tb
from eventide.llm.common import read
from eventide.session import cut_lineage

CLASSES = 32
TOKENS = CLASSES * CLASSES
EDGE = TOKENS - 1  # stands outside the document; never predicted
FREQUENT = 895
HASHED = TOKENS - 1 - FREQUENT
WIDTH = 16
SIDE = 2
BATCH = 1 << 14
RATE = 0.15
EPOCHS = 1
#: shuffle granularity of the averaging
BLOCK = 1 << 13
#: distinct words that a task counts before it passes its counts on
COUNTED = 1 << 20
#: words with a shared token in one chunk of documents (a longer document is a chunk of its own)
CHUNK_WORDS = 1 << 22

_PLACES = [k for k in range(-SIDE, SIDE + 1) if k]


class Network:
    """Weights as one float32 vector with named views."""

    def __init__(self, vector: np.ndarray | None = None) -> None:
        shapes = {"embed": (len(_PLACES) * TOKENS, WIDTH), "to_class": (WIDTH + 1, CLASSES),
                  "to_token": (CLASSES, WIDTH + 1, CLASSES)}
        sizes = {k: int(np.prod(s)) for k, s in shapes.items()}
        if vector is None:
            vector = np.random.default_rng(6).normal(0, 0.1, sum(sizes.values())).astype(np.float32)
        self.vector = vector
        at = 0
        for k, s in shapes.items():
            setattr(self, k, vector[at:at + sizes[k]].reshape(s))
            at += sizes[k]

    def hidden(self, context: np.ndarray) -> np.ndarray:
        """tanh of the summed embeddings, with a constant last column; ``context`` is n x places."""
        x = self.embed[context[:, 0]]
        for k in range(1, context.shape[1]):
            x = x + self.embed[context[:, k]]
        return np.concatenate([np.tanh(x), np.ones((len(x), 1), np.float32)], axis=1)


def _log_softmax(z: np.ndarray) -> np.ndarray:
    z = z - z.max(axis=1, keepdims=True)
    return z - np.log(np.exp(z).sum(axis=1, keepdims=True))


def log_probs(net: Network, context: np.ndarray, target: np.ndarray) -> np.ndarray:
    """log p(token | both sides) for a batch."""
    h = net.hidden(context)
    cls, member = target // CLASSES, target % CLASSES
    out = _log_softmax(h @ net.to_class)[np.arange(len(target)), cls]
    order = np.argsort(cls, kind="stable")
    at = np.searchsorted(cls[order], np.arange(CLASSES + 1))
    for c in range(CLASSES):
        rows = order[at[c]:at[c + 1]]
        if len(rows):
            out[rows] += _log_softmax(h[rows] @ net.to_token[c])[np.arange(len(rows)), member[rows]]
    return out


def train_step(net: Network, grown: Network, context: np.ndarray, target: np.ndarray) -> None:
    """One Adagrad step on the mean negative log probability; ``grown`` holds squared gradients."""
    n = len(target)
    h = net.hidden(context)
    cls, member = target // CLASSES, target % CLASSES
    g = np.exp(_log_softmax(h @ net.to_class))
    g[np.arange(n), cls] -= 1
    back = g @ net.to_class.T
    grads = {"to_class": h.T @ g / n, "to_token": np.zeros_like(net.to_token)}
    order = np.argsort(cls, kind="stable")
    at = np.searchsorted(cls[order], np.arange(CLASSES + 1))
    for c in range(CLASSES):
        rows = order[at[c]:at[c + 1]]
        if not len(rows):
            continue
        g = np.exp(_log_softmax(h[rows] @ net.to_token[c]))
        g[np.arange(len(rows)), member[rows]] -= 1
        back[rows] += g @ net.to_token[c].T
        grads["to_token"][c] = h[rows].T @ g / n
    back = back[:, :WIDTH] * (1 - h[:, :WIDTH] ** 2) / n
    flat, width = context.T.ravel(), len(_PLACES)
    total = np.empty_like(net.embed)
    for d in range(WIDTH):
        total[:, d] = np.bincount(flat, np.tile(back[:, d], width), minlength=len(total))
    grads["embed"] = total
    for k, g in grads.items():
        square = getattr(grown, k)
        square += (g * n) ** 2 / n
        getattr(net, k)[...] -= RATE * g * np.sqrt(n) / np.sqrt(square + 1e-6)


def token_ids(hashes: np.ndarray, vocabulary: np.ndarray) -> np.ndarray:
    """Token of each word hash; ``vocabulary`` is sorted and holds at most FREQUENT hashes."""
    out = FREQUENT + (hashes >> np.uint64(32)).astype(np.int64) % HASHED
    if len(vocabulary):
        at = np.minimum(np.searchsorted(vocabulary, hashes), len(vocabulary) - 1)
        out = np.where(vocabulary[at] == hashes, at, out)
    return out


def contexts(ids: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """n x places rows of the embedding tables; neighbours outside the document are EDGE."""
    n = len(ids)
    out = np.empty((n, len(_PLACES)), np.int64)
    for p, k in enumerate(_PLACES):
        col = np.full(n, EDGE, np.int64)
        a, b = max(0, -k), min(n, n - k)
        if b > a:
            same = doc[a:b] == doc[a + k:b + k]
            col[a:b] = np.where(same, ids[a + k:b + k], EDGE)
        out[:, p] = col + p * TOKENS
    return out


def word_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """(word, n): occurrences of every word, by hash, over whole texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
            word, which = np.unique(np.concatenate([p for p, _ in parts]), return_inverse=True)
            return word, np.bincount(which, np.concatenate([c for _, c in parts])).astype(np.int64)

        def rows(word: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(word.view(np.int64)), pa.array(n)], names=["word", "n"])

        held: list[tuple[np.ndarray, np.ndarray]] = []
        for b in batches:
            for s in tb.slices(b.column(0)):
                held.append(np.unique(tb.words(s, fold_case=True).hash, return_counts=True))
                if sum(len(p) for p, _ in held) > COUNTED:
                    held = [merged(held)]
                    if len(held[0][0]) > COUNTED // 2:
                        yield rows(*held.pop())
        if held:
            yield rows(*merged(held))

    return docs.select(text).mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


def vocabulary(docs: DataFrame, counts: DataFrame | None = None) -> np.ndarray:
    """Sorted hashes of the FREQUENT most frequent words (ties by hash)."""
    counts = word_counts(docs) if counts is None else counts
    top = counts.orderBy(F.desc("n"), "word").limit(FREQUENT).collect()
    return np.sort(np.array([r["word"] for r in top], np.int64).view(np.uint64))


def token_totals(counts: DataFrame, words: np.ndarray) -> np.ndarray:
    """Occurrences of all words of each token."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(TOKENS, np.int64)
        for b in batches:
            ids = token_ids(b.column(0).to_numpy().view(np.uint64), words)
            np.add.at(total, ids, b.column(1).to_numpy())
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(TOKENS)), pa.array(total)], names=["token", "n"])

    got = counts.select("word", "n").mapInArrow(run, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
    out = np.zeros(TOKENS, np.int64)
    for r in got.collect():  # TOKENS rows
        out[r["token"]] = r["n"]
    return out


def _add_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Running sums over rows sorted by block."""
    block, total, weight = None, None, 0.0

    def row() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array([block], pa.int32()), pa.array([total.tobytes()], pa.binary()), pa.array([weight], pa.float64())],
            names=["block", "total", "weight"])

    for b in batches:
        for k, x, w in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist()):
            v = np.frombuffer(x.as_buffer(), np.float64)
            if k == block:
                total, weight = total + v, weight + w
                continue
            if block is not None:
                yield row()
            block, total, weight = k, v, w
    if block is not None:
        yield row()


def train(docs: DataFrame, words: np.ndarray, epochs: int = EPOCHS, batch: int = BATCH) -> np.ndarray:
    """Weights after ``epochs`` rounds of local training and averaging over all documents."""
    sc = docs.sparkSession.sparkContext
    vector = Network().vector
    for _ in range(epochs):
        shared = sc.broadcast((vector, words))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:  # noqa: ANN001
            start, known = shared.value
            net, grown = Network(start.copy()), Network(np.zeros_like(start))
            seen = 0
            rng = np.random.default_rng(5)
            for b in batches:
                for s in tb.slices(b.column(0)):
                    w = tb.words(s, fold_case=True)
                    ids = token_ids(w.hash, known)
                    around = contexts(ids, w.doc)
                    order = rng.permutation(len(ids))
                    for i in range(0, len(ids), batch):
                        rows = order[i:i + batch]
                        train_step(net, grown, around[rows], ids[rows])
                    seen += len(ids)
            if seen:
                v = net.vector.astype(np.float64) * seen
                blocks = [v[i:i + BLOCK].tobytes() for i in range(0, len(v), BLOCK)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(range(len(blocks)), pa.int32()), pa.array(blocks, pa.binary()),
                     pa.array([float(seen)] * len(blocks))], names=["block", "total", "weight"])

        schema = "block int, total binary, weight double"
        parts = docs.select("text").mapInArrow(run, schema)
        summed = parts.repartition("block").sortWithinPartitions("block").mapInArrow(_add_blocks, schema)
        got = cut_lineage(summed, "lm-weights").orderBy("block").collect()  # one weight vector
        if not got:
            break
        vector = np.concatenate([np.frombuffer(r["total"], np.float64) / r["weight"] for r in got]).astype(np.float32)
    return vector


def score(docs: DataFrame, words: np.ndarray, vector: np.ndarray, carry: list[str],
          counts: DataFrame | None = None, chunk_words: int = CHUNK_WORDS) -> DataFrame:
    """``carry`` plus n_tokens, score (sum of log probabilities) and mean.

    ``counts(word, n)`` is a stored table of word counts, those of ``docs`` by default.
    """
    counts = cut_lineage(word_counts(docs), "lm-counts") if counts is None else counts
    totals = np.log(token_totals(counts, words) + 1.0)
    totals[:FREQUENT] = 0  # tokens of one word
    shared = docs.sparkSession.sparkContext.broadcast((vector, words, totals))
    own = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*carry).schema]
    added = ["_chunk", "_tokens", "_base", "_rare", "_words"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, known, totals = shared.value
        net = Network(weights)
        chunk = TaskContext.get().partitionId() << 32
        held: list[tuple] = []

        def flushed() -> Iterator[pa.RecordBatch]:
            word, place = np.unique(np.concatenate([h[3] for h in held]), return_inverse=True)
            place, at = place.astype("<u4"), 0
            for cols, n, base, rare, sizes in held:
                ends = at + np.cumsum(sizes)
                packed = [place[i:j].tobytes() for i, j in zip(ends - sizes, ends)]
                at += len(rare)
                yield pa.RecordBatch.from_arrays(
                    [*cols, pa.array([chunk] * len(n), pa.int64()), pa.array(n, pa.int64()), pa.array(base),
                     pa.array(packed, pa.binary()), pa.nulls(len(n), pa.list_(pa.int64()))], names=[*carry, *added])
            yield pa.RecordBatch.from_arrays(
                [*(pa.nulls(1, c.type) for c in held[0][0]), pa.array([chunk]), pa.nulls(1, pa.int64()),
                 pa.nulls(1, pa.float64()), pa.nulls(1, pa.binary()),
                 pa.array([word.view(np.int64)], pa.list_(pa.int64()))], names=[*carry, *added])

        for b in batches:
            for s in tb.slices(b.column(len(carry))):
                w = tb.words(s, fold_case=True)
                ids = token_ids(w.hash, known)
                around = contexts(ids, w.doc)
                logs = [log_probs(net, around[i:i + BATCH], ids[i:i + BATCH]) for i in range(0, len(ids), BATCH)]
                each = np.concatenate(logs).astype(np.float64) - totals[ids] if logs else np.zeros(0)
                base = np.bincount(w.doc, each, minlength=s.n_docs) if len(ids) else np.zeros(s.n_docs)
                far = ids >= FREQUENT
                held.append(([c.slice(s.first, s.n_docs) for c in b.columns[:len(carry)]], np.diff(w.first), base,
                             w.hash[far], np.bincount(w.doc[far], minlength=s.n_docs)))
                if sum(len(h[3]) for h in held) >= chunk_words:
                    yield from flushed()
                    chunk, held = chunk + 1, []
        if held:
            yield from flushed()

    rows = cut_lineage(docs.select(*carry, "text").mapInArrow(
        run, ", ".join([*own, "_chunk bigint, _tokens bigint, _base double, _rare binary, _words array<bigint>"])), "lm-rows")
    asked = rows.where("_words is not null").select(F.col("_chunk").alias("chunk"), F.posexplode("_words").alias("place", "word"))
    # the logarithm of a count of 1 adds nothing
    told = asked.join(counts.where("n > 1"), "word").select("chunk", "place", "n")

    def add(left: pa.Table, right: pa.Table) -> pa.Table:
        parts = [np.frombuffer(x, "<u4") for x in left.column("_rare").to_pylist()]
        place = right.column("place").to_numpy()
        size = max([int(p.max()) + 1 for p in parts if len(p)] + [int(place.max()) + 1 if len(place) else 0])
        logs = np.zeros(size)
        logs[place] = np.log(right.column("n").to_numpy())
        count = left.column("_tokens").to_numpy()
        sums = left.column("_base").to_numpy() + np.array([logs[p].sum() for p in parts])
        out = left.select(carry).append_column("n_tokens", pa.array(count, pa.int64()))
        return (out.append_column("score", pa.array(sums, pa.float64()))
                .append_column("mean", pa.array(sums / np.maximum(count, 1), pa.float64(), mask=count == 0)))

    texts = rows.where("_words is null").drop("_words")
    return texts.groupBy("_chunk").cogroup(told.groupBy("chunk")).applyInArrow(
        add, ", ".join([*own, "n_tokens bigint, score double, mean double"]))


def pseudo_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query op6: the pseudo log-likelihood of every document."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    counts = cut_lineage(word_counts(docs), "lm-counts")
    words = vocabulary(docs, counts)
    return score(docs, words, train(docs, words), ["doc_id"], counts)
