"""MinHash near-duplicate removal with tensored banding (operator 1).

A text's set holds its distinct word shingles. Texts link when 100 * intersection >=
``similarity`` * union on the full sets; a group is a connected component of links.

* Two small collections of ``HALVES`` half keys each (a half key joins ``ROWS`` minhashes) are
  computed per set. A table (i, j) is keyed by half i of the first and half j of the second
  collection, so ``4 * HALVES`` minhashes serve ``HALVES ** 2`` tables of ``2 * ROWS`` rows. A pair
  of similarity s meets in some table unless it shares no half key of one collection:
  2 * (1 - s^2)^8, at most 0.06 % of the links at s = 0.8 and less above.
* Equal sets are one class (128-bit digest of the full set), which is all that later steps carry.
* Half keys held by one class cannot meet anything; only classes with a shared half key in either
  collection enter the tables. They are counted with partial aggregation, then joined.
* In a bucket every class is compared with one pivot: the class whose half keys are the most
  common, that is the likely original of a copied text. This is linear in the bucket.
* Buckets whose other members still lie in several components are completed: those outside the
  pivot's component are compared with all members, in blocks of ``BLOCK`` sets, by sparse counting
  of common shingles. Blocks emit one link per merge, never pairs. So no link between two classes
  that share a bucket is lost, and no bucket has a cap.

Similarities are always computed on full sets, never estimated.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from eventide.llm import textbytes as tb
from eventide.llm.common import read
from eventide.llm.components import components
from eventide.session import cut_lineage

HALVES = 8
ROWS = 2
BLOCK = 256
SIMILARITY = 80
#: sets of one batch of the comparison, in shingles
PAIR_SHINGLES = 1 << 20

_SALT = np.random.default_rng(1).integers(1, 2**63, 2 * HALVES * ROWS, dtype=np.uint64)
_ODD = np.random.default_rng(2).integers(1, 2**63, 2 * HALVES * ROWS, dtype=np.uint64) | np.uint64(1)


def shingle_sets(s: tb.Slice, width: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each document of a slice."""
    w = tb.words(s, fold_case=True)
    runs = tb.windows(w.hash, width)
    for i in range(s.n_docs):
        a, b = int(w.first[i]), int(w.first[i + 1])
        if b - a >= width:
            yield np.unique(runs[a:b - width + 1])
        elif b > a:
            yield tb.windows(w.hash[a:b], b - a, base=0xA0761D6478BD642F + 2 * (b - a))
        else:
            yield np.zeros(0, np.uint64)


def half_keys(u: np.ndarray) -> np.ndarray:
    """2 * HALVES half keys (int64) of a set; the collection and place are part of the key."""
    low = np.full(len(_ODD), np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(u), 1 << 14):
        part = u[i:i + (1 << 14), None]
        low = np.minimum(low, ((part ^ _SALT) * _ODD).min(axis=0))
    place = np.arange(1, 2 * HALVES + 1, dtype=np.uint64)
    key = place
    for r in range(ROWS):
        key = tb.mix(key ^ low[r::ROWS]) + place
    return tb.mix(key).view(np.int64)


def digest(u: np.ndarray) -> bytes:
    return hashlib.blake2b(u.tobytes(), digest_size=16).digest()


def row_key(doc_id: Column, text: Column) -> Column:
    """Key by which a row's text is fetched again; rows without an id go by their text."""
    return F.coalesce(doc_id.cast("long"), F.xxhash64(text))


def signatures(docs: DataFrame, width: int, carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, row, n_shingles, cls, halves, carry) per row; cls and halves are null for the empty set."""
    kept = ", ".join(["", *(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*carry).schema)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = (u for s in tb.slices(b.column(2)) for u in shingle_sets(s, width))
            sig = [(len(u), digest(u), half_keys(u)) if len(u) else (0, None, None) for u in sets]
            n, cls, halves = zip(*sig) if sig else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(n, pa.int64()), pa.array(cls, pa.binary()),
                 pa.array(halves, pa.list_(pa.int64())), *b.columns[3:]],
                names=["doc_id", "row", "n_shingles", "cls", "halves", *carry])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       row_key(F.col("doc_id"), F.col("text")).alias("row"), "text", *carry).mapInArrow(
        run, "doc_id long, row long, n_shingles long, cls binary, halves array<long>" + kept)


def full_sets(docs: DataFrame, rows: DataFrame, width: int) -> DataFrame:
    """(cls, shingles): full sets, as packed sorted hashes, of the rows named by ``rows(row)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in tb.slices(b.column(0)):
                sets = [u for u in shingle_sets(s, width) if len(u)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([digest(u) for u in sets], pa.binary()),
                     pa.array([u.tobytes() for u in sets], pa.binary())], names=["cls", "shingles"])

    texts = docs.select(row_key(F.col("doc_id"), F.col("text")).alias("row"), "text")
    found = texts.join(rows, "row", "left_semi").select("text")
    return found.mapInArrow(run, "cls binary, shingles binary")


def _table_members(classes: DataFrame) -> DataFrame:
    """(table, cls, support, n_shingles): the tensored tables' rows that can meet another class."""
    halves = classes.select("cls", F.posexplode("halves").alias("place", "half"))
    shared = halves.groupBy("half").agg(F.count("*").alias("n")).where("n > 1")
    hit = halves.join(shared, "half")
    by_class = hit.groupBy("cls").agg(
        F.sum("n").alias("support"),
        F.collect_list(F.when(F.col("place") < HALVES, F.col("half"))).alias("a"),
        F.collect_list(F.when(F.col("place") >= HALVES, F.col("half"))).alias("b"))
    return (by_class.select("cls", "support", F.explode("a").alias("a"), "b")
            .select("cls", "support", "a", F.explode("b").alias("b"))
            .select(F.xxhash64("a", "b").alias("table"), "cls", "support"))


def _confirm(pairs: DataFrame, sets: DataFrame, similarity: int) -> DataFrame:
    """The rows of ``pairs(u, v)`` that link on their full sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = []
            for x, y in zip(b.column(2), b.column(3)):
                p, q = (np.frombuffer(z.as_buffer(), np.uint64) for z in (x, y))
                k = len(np.intersect1d(p, q, assume_unique=True))
                ok.append(100 * k >= similarity * (len(p) + len(q) - k))
            yield b.select([0, 1]).filter(pa.array(ok, pa.bool_()))

    left = sets.select(F.col("cls").alias("u"), F.col("shingles").alias("x"))
    right = sets.select(F.col("cls").alias("v"), F.col("shingles").alias("y"))
    return (pairs.join(right, "v").join(left, "u").select("u", "v", "x", "y")
            .mapInArrow(run, "u binary, v binary"))


def block_links(sets: list[np.ndarray], left: np.ndarray, comp: np.ndarray, similarity: int) -> list[tuple[int, int]]:
    """Links between ``left`` members and the others that join different components, one per merge.

    Common shingles are counted through the shingles held by two members or more; columns are
    processed in chunks, so memory is bounded by the block, not by the vocabulary of its texts.
    """
    n = len(sets)
    size = np.array([len(s) for s in sets], np.int64)
    value = np.concatenate(sets) if n else np.zeros(0, np.uint64)
    owner = np.repeat(np.arange(n), size)
    _, column, times = np.unique(value, return_inverse=True, return_counts=True)
    shared = times > 1
    number = np.cumsum(shared) - 1
    keep = shared[column]
    owner, column = owner[keep], number[column[keep]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    rows = np.flatnonzero(left)
    common = np.zeros((len(rows), n), np.float32)
    step = 2048
    for c in range(0, int(column[-1]) + 1 if len(column) else 0, step):
        a, b = np.searchsorted(column, [c, c + step])
        has = np.zeros((n, step), np.float32)
        has[owner[a:b], column[a:b] - c] = 1
        common += has[rows] @ has.T
    union = size[rows][:, None] + size[None, :] - common
    ok = 100.0 * common >= float(similarity) * union
    root = {int(c): int(c) for c in np.unique(comp)}

    def find(c: int) -> int:
        while root[c] != c:
            root[c] = root[root[c]]
            c = root[c]
        return c

    out = []
    for i, j in zip(*np.nonzero(ok)):
        p, q = find(int(comp[rows[i]])), find(int(comp[j]))
        if p != q:
            root[max(p, q)] = min(p, q)
            out.append((int(rows[i]), int(j)))
    return out


def _complete(members: DataFrame, sets: DataFrame, similarity: int, block: int) -> DataFrame:
    """Links (u, v) inside buckets that a comparison with their pivots has left in pieces.

    ``members(pivot, cls, comp, stray)``: the members of the open buckets of each pivot; a stray
    lies outside the pivot's component. Strays are dealt to left blocks, all members to right blocks.
    """
    sizes = members.groupBy("pivot").agg(
        F.ceil(F.sum(F.col("stray").cast("int")) / block).cast("int").alias("n_left"),
        F.ceil(F.count("*") / block).cast("int").alias("n_right"))
    m = members.join(sizes, "pivot")
    own = F.xxhash64("cls")
    right = m.select("pivot", F.explode(F.sequence(F.lit(0), F.col("n_left") - 1)).alias("i"),
                     F.pmod(own, F.col("n_right").cast("long")).cast("int").alias("j"),
                     "cls", "comp", F.lit(False).alias("is_left"))
    left = m.where("stray").select(
        "pivot", F.pmod(own, F.col("n_left").cast("long")).cast("int").alias("i"),
        F.explode(F.sequence(F.lit(0), F.col("n_right") - 1)).alias("j"),
        "cls", "comp", F.lit(True).alias("is_left"))
    dealt = left.unionAll(right).join(sets, "cls")

    def run(group: pd.DataFrame) -> pd.DataFrame:
        # a stray dealt to both sides stands on the left only
        g = group.sort_values("is_left", ascending=False).drop_duplicates("cls")
        g = g.sort_values("cls")
        cls = g["cls"].to_numpy()
        comp = pd.factorize(g["comp"])[0]
        found = block_links([np.frombuffer(x, np.uint64) for x in g["shingles"]],
                            g["is_left"].to_numpy(), comp, similarity)
        return pd.DataFrame({"u": [cls[i] for i, _ in found], "v": [cls[j] for _, j in found]},
                            columns=["u", "v"], dtype=object)

    return dealt.groupBy("pivot", "i", "j").applyInPandas(run, "u binary, v binary")


def near_groups(docs: DataFrame, width: int = 5, similarity: int = SIMILARITY,
                block: int = BLOCK, locator: tuple[str, ...] = ()) -> DataFrame:
    """One row per row of ``docs(doc_id, text)``: doc_id, n_shingles, component_id, kept, class_size.

    With ``locator`` columns, which name a row, also these and first_row: true for the row of the
    group that is the first by doc_id (nulls last), then locator, for the rows that repeat its id
    and its set, and for rows without a shingle.

    * A-Z reads as a-z; words are runs outside ``[\\x20\\x09-\\x0D]``; a text of fewer than ``width``
      words is one shingle, its whole sequence; null, empty and blank texts have no shingle, link
      with nothing and are kept under their own id.
    * component_id is the smallest doc_id of the group (null ids are ignored; null if all are).
      kept is true where doc_id equals it, nulls being equal: rows that repeat the smallest id are
      all kept, and a group without any id keeps all its rows.
    * An empty table gives no rows. Other columns are not read.
    """
    sig = cut_lineage(signatures(docs, width, locator), "near-signatures")
    # equal sets have equal halves, so any of them serves
    classes = (sig.where("cls is not null").groupBy("cls")
               .agg(F.min("row").alias("row"), F.first("halves").alias("halves"),
                    F.first("n_shingles").alias("n")))
    tables = cut_lineage(_table_members(classes), "near-tables")
    pivots = tables.groupBy("table").agg(
        F.max(F.struct("support", "cls")).alias("top"), F.count("*").alias("n")).where("n > 1")
    members = cut_lineage(
        tables.join(pivots.select("table", F.col("top.cls").alias("pivot")), "table")
        .where("cls <> pivot").select("table", "pivot", "cls"), "near-members")
    pairs = cut_lineage(members.select(F.col("pivot").alias("u"), F.col("cls").alias("v")).distinct(),
                        "near-pairs")
    named = pairs.select(F.col("u").alias("cls")).unionAll(pairs.select(F.col("v").alias("cls"))).distinct()
    rows = sig.where("cls is not null").groupBy("cls").agg(F.min("row").alias("row")).join(named, "cls")
    sets = cut_lineage(full_sets(docs, rows.select("row").distinct(), width)
                       .dropDuplicates(["cls"]), "near-sets")
    links = cut_lineage(_confirm(pairs, sets, similarity), "near-links")
    found = cut_lineage(components(links), "near-components")

    def comp_of(df: DataFrame, cls: str, name: str) -> DataFrame:
        c = found.select(F.col("node").alias("_node"), F.col("root").alias("_root"))
        return (df.join(c, F.col(cls) == F.col("_node"), "left")
                .withColumn(name, F.coalesce("_root", cls)).drop("_node", "_root"))

    with_comp = comp_of(members, "cls", "comp")
    torn = (with_comp.groupBy("table").agg(F.min("comp").alias("x"), F.max("comp").alias("y"))
            .where("x <> y").select("table"))
    open_members = with_comp.join(torn, "table", "left_semi").select("pivot", "cls", "comp").distinct()
    open_members = cut_lineage(
        comp_of(open_members, "pivot", "main").withColumn("stray", F.col("comp") != F.col("main"))
        .drop("main"), "near-open")
    more = cut_lineage(_complete(open_members, sets, similarity, block), "near-more")
    final = components(links.unionAll(more))
    final = final.select(F.col("node").alias("_node"), F.col("root").alias("_root"))
    place = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", *locator)
    firsts = [F.min(place).alias("first")] if locator else []
    by_class = sig.groupBy("cls").agg(F.min("doc_id").alias("low"), F.count("*").alias("class_size"), *firsts)
    named = (by_class.where("cls is not null").join(final, F.col("cls") == F.col("_node"), "left")
             .select("cls", "low", "class_size", F.coalesce("_root", "cls").alias("root"),
                     *(["first"] if locator else [])))
    named = cut_lineage(named, "near-classes")
    lowest = named.groupBy("root").agg(F.min("low").alias("component_id"),
                                       *([F.min(F.struct("first", "cls")).alias("_first")] if locator else []))
    ids = named.join(lowest, "root").select(F.col("cls").alias("_cls"), "component_id", "class_size",
                                            *(["_first"] if locator else []))
    added = []
    if locator:
        repeat = (F.col("doc_id") == F.col("_first.first.doc_id")) & (F.col("cls") == F.col("_first.cls"))
        chosen = F.col("cls").isNull() | place.eqNullSafe(F.col("_first.first")) | F.coalesce(repeat, F.lit(False))
        added = [*locator, chosen.alias("first_row")]
    return (sig.join(ids, F.col("cls") == F.col("_cls"), "left")
            .withColumn("component_id", F.when(F.col("cls").isNull(), F.col("doc_id"))
                        .otherwise(F.col("component_id")))
            .select("doc_id", "n_shingles", "component_id",
                    F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"),
                    F.coalesce("class_size", F.lit(1)).alias("class_size"), *added))


def minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query op1: near-duplicate groups of all documents on 4-word shingles."""
    return near_groups(read(spark, sf_dir, "documents"), width=4)


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the first row of each group (5 words, 0.8) and its repeats; rows go by place, not by id."""
    place = [F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row")]
    try:
        there = docs.select(*docs.columns, *place)
    except AnalysisException:  # not read from files
        there = cut_lineage(docs, "near-input").select(*docs.columns, *place)
    gone = near_groups(there, locator=("_file", "_row")).where("not first_row").select(
        F.col("_file").alias("file"), F.col("_row").alias("row"))
    return (there.join(gone, (F.col("_file") == F.col("file")) & (F.col("_row") == F.col("row")), "left_anti")
            .select(*docs.columns))
