r"""Chat formatting by quotation linking (operator 3), JVM-side only.

Messages may quote others, mail style: a line's level is the number of ``>`` in its prefix. Runs of
lines of one level are passages; blank lines and attribution lines (``... wrote:`` before a deeper
level) belong to none. A passage is normalised (white space runs to one space, A-Z lower-cased) and
hashed. Passages of level 0 are a message's own words. A quoted passage is linked to the first
message of its conversation that has the passage among its own, if that message comes earlier;
else to the first message of all conversations that has it (a forward). A message answers the
origin of its last linked passage of the lowest quoted level, within its conversation. Replies form
trees; root and depth are found by pointer doubling, so ordering by (conv_id, root_turn, depth,
turn) puts every message after the one that it answers. The texts returned have no quotes.

No conversation, passage or reply tree is gathered in one task: originals are minima per
(conversation, hash) and per hash, aggregated before the shuffle, and every join finds at most one
row. A message's lines stay in its own row.

A message is (conv_id, turn). Rows that repeat it share its place in the tree (the earliest parent).
Null conv_id: no conversation, so neither parent nor children, but forwards are found. Null turn:
no order, so it neither answers nor is answered. Null or empty text: no passages, content is empty.
A message that quotes nothing known is a root. An empty table gives no rows; other columns are
not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from eventide.llm.common import SPACE, read
from eventide.session import cut_lineage

#: one character class up to the last ``>`` of the prefix: no repeated group, which would recurse per sign
PREFIX = r"^([ \t>]*>)?[ \t]?"
ATTRIBUTION = r"(?i)^\s*on .* wrote:\s*$"


def _level(line: Column) -> Column:
    return F.length(F.regexp_replace(F.regexp_extract(line, PREFIX, 1), r"[ \t]", ""))


def normalised(passage: Column) -> Column:
    spaced = F.trim(F.regexp_replace(passage, SPACE + "+", " "))
    return F.translate(spaced, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _barrier(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns behind a Generate, so that later lambdas read them instead of repeating them."""
    packed = F.explode(F.array(F.struct(*[c.alias(k) for k, c in columns.items()]))).alias("_b")
    return df.select("*", packed).select(*df.columns, *[F.col(f"_b.{k}").alias(k) for k in columns])


def parsed(messages: DataFrame) -> DataFrame:
    """conv_id, turn, role, content and quotes (array of level, place, hash), own (array of hashes)."""
    m = messages.select("conv_id", "turn", "role",
                        F.split(F.coalesce(F.col("text"), F.lit("")), "\r?\n").alias("raw"))
    m = _barrier(m, lines=F.transform("raw", lambda x: F.struct(
        _level(x).alias("level"), F.regexp_replace(x, PREFIX, "").alias("body")))).drop("raw")
    said = F.filter("lines", lambda x: F.length(F.trim(F.regexp_replace(x["body"], SPACE + "+", " "))) > 0)
    m = _barrier(m, said=said).drop("lines")
    last = F.size("said") - 1
    kept = F.filter("said", lambda x, i: ~(x["body"].rlike(ATTRIBUTION) & (i < last)
                                           & (F.get(F.col("said.level"), i + 1) > x["level"])))
    m = _barrier(m, kept=kept).drop("said")
    starts = F.filter(F.sequence(F.lit(0), F.size("kept")),
                      lambda i: (i == 0) | (i == F.size("kept"))
                      | (F.get("kept", i)["level"] != F.get("kept", i - 1)["level"]))
    m = _barrier(m, starts=F.when(F.size("kept") > 0, starts).otherwise(F.array(F.lit(0))))
    runs = F.transform(F.slice("starts", F.lit(1), F.greatest(F.size("starts") - 1, F.lit(0))), lambda a, k: F.struct(
        F.get("kept", a)["level"].alias("level"), k.alias("place"),
        F.array_join(F.slice("kept", a + 1, F.get("starts", k + 1) - a)["body"], "\n").alias("body")))
    m = _barrier(m, runs=runs).drop("kept", "starts")
    own = F.filter("runs", lambda r: r["level"] == 0)
    return m.select(
        "conv_id", "turn", "role",
        F.array_join(F.transform(own, lambda r: r["body"]), "\n").alias("content"),
        F.transform(own, lambda r: F.sha2(normalised(r["body"]), 256)).alias("own"),
        F.transform(F.filter("runs", lambda r: r["level"] > 0), lambda r: F.struct(
            r["level"].alias("level"), r["place"].alias("place"),
            F.sha2(normalised(r["body"]), 256).alias("hash"))).alias("quotes"))


def linked(messages: DataFrame) -> DataFrame:
    """One row per quoted passage of ``parsed`` messages: conv_id, turn, level, place, hash and its
    origin (origin_conv, origin_turn, in_conversation); nulls where there is none."""
    said = messages.where("turn is not null").select("conv_id", "turn", F.explode("own").alias("hash"))
    here = (said.where("conv_id is not null").groupBy(F.col("conv_id").alias("c"), F.col("hash").alias("h"))
            .agg(F.min("turn").alias("here")))
    first = said.groupBy(F.col("hash").alias("g")).agg(F.min(F.struct("conv_id", "turn")).alias("first"))
    # stored, so that the joins read plain tables and Spark can split a passage that many quote
    here, first = cut_lineage(here, "own-passages"), cut_lineage(first, "first-passages")
    q = messages.select("conv_id", "turn", F.explode("quotes").alias("q")).select("conv_id", "turn", "q.*")
    j = q.join(here, (F.col("conv_id") == F.col("c")) & (F.col("hash") == F.col("h")), "left")
    j = j.join(first, F.col("hash") == F.col("g"), "left")
    inside = F.coalesce(F.col("here") < F.col("turn"), F.lit(False))
    itself = F.col("first.conv_id").eqNullSafe(F.col("conv_id")) & F.col("first").isNotNull()
    return j.select(
        "conv_id", "turn", "level", "place", "hash", inside.alias("in_conversation"),
        F.when(inside, F.col("conv_id")).when(~itself, F.col("first.conv_id")).alias("origin_conv"),
        F.when(inside, F.col("here")).when(~itself, F.col("first.turn")).alias("origin_turn"))


def reply_trees(parents: DataFrame) -> DataFrame:
    """(conv_id, turn, root_turn, depth) from ``parents(conv_id, turn, parent_turn)``.

    A parent has a smaller turn. Each round replaces every pointer by the pointer of the message it
    points to, so the longest chain halves; messages that have met their root leave the rounds.
    """
    t = parents.groupBy("conv_id", "turn").agg(F.min("parent_turn").alias("up"))
    t = cut_lineage(t.select("conv_id", "turn", "up", F.when(F.col("up").isNotNull(), 1).otherwise(0).alias("depth"),
                             F.coalesce("up", "turn").alias("root_turn")), "reply-trees")
    found = t.where("up is null")
    while True:
        climbing = t.where("up is not null")
        if not climbing.limit(1).count():
            return found.select("conv_id", "turn", "root_turn", "depth")
        to = found.unionAll(climbing).select(
            F.col("conv_id").alias("c"), F.col("turn").alias("p"), F.col("up").alias("up2"),
            F.col("depth").alias("d2"), F.col("root_turn").alias("r2"))
        t = climbing.join(to, (F.col("conv_id") == F.col("c")) & (F.col("up") == F.col("p"))).select(
            "conv_id", "turn", F.col("up2").alias("up"), (F.col("depth") + F.col("d2")).alias("depth"),
            F.col("r2").alias("root_turn"))
        t = cut_lineage(t, "reply-trees")
        found = found.unionAll(t.where("up is null"))


def conversations(messages: DataFrame) -> DataFrame:
    """One row per row of ``messages(conv_id, turn, role, text)``: its own words and its place.

    conv_id, turn, role, content, n_quotes, n_linked, parent_turn, root_turn, depth, chat.
    """
    p = cut_lineage(parsed(messages), "parsed")
    links = linked(p)
    # the last linked passage of the lowest level
    best = F.max(F.when(F.col("in_conversation"), F.struct(-F.col("level"), "place", "origin_turn")))
    per = links.groupBy("conv_id", "turn").agg(
        F.sum(F.col("origin_turn").isNotNull().cast("int")).alias("n_linked"),
        best["origin_turn"].alias("parent_turn"))
    per = cut_lineage(per.select(F.col("conv_id").alias("_c"), F.col("turn").alias("_t"), "n_linked", "parent_turn"),
                      "parents")
    known = (p.select("conv_id", "turn").where("conv_id is not null and turn is not null")
             .withColumn("parent_turn", F.lit(None).cast(p.schema["turn"].dataType))
             .unionByName(per.where("parent_turn is not null")
                          .select(F.col("_c").alias("conv_id"), F.col("_t").alias("turn"), "parent_turn")))
    trees = reply_trees(known).select(F.col("conv_id").alias("_c2"), F.col("turn").alias("_t2"), "root_turn", "depth")
    out = p.join(per, F.col("conv_id").eqNullSafe(F.col("_c")) & F.col("turn").eqNullSafe(F.col("_t")), "left")
    out = out.join(trees, (F.col("conv_id") == F.col("_c2")) & (F.col("turn") == F.col("_t2")), "left")
    return out.select(
        "conv_id", "turn", "role", "content", F.size("quotes").alias("n_quotes"),
        F.coalesce("n_linked", F.lit(0)).cast("long").alias("n_linked"), "parent_turn",
        F.coalesce("root_turn", "turn").alias("root_turn"), F.coalesce("depth", F.lit(0)).alias("depth"),
        F.concat(F.lit("<|"), F.coalesce("role", F.lit("")), F.lit("|>\n"), "content").alias("chat"))


def as_mail(messages: DataFrame) -> DataFrame:
    """``messages`` as replies that quote the two turns before, nested, above their own text.

    The table of conversations has no quotes; this gives the operator mail derived from it.
    """
    body = messages.where("text is not null").groupBy("conv_id", "turn").agg(F.min("text").alias("text"))

    def earlier(by: int, name: str, prefix: str) -> DataFrame:
        return body.select(F.col("conv_id").alias(f"{name}_c"), (F.col("turn") + by).alias(f"{name}_t"),
                           F.regexp_replace("text", "(?m)^", prefix).alias(name))

    m = messages
    for by, name, prefix in ((1, "q1", "> "), (2, "q2", "> > ")):
        e = earlier(by, name, prefix)
        m = m.join(e, (F.col("conv_id") == F.col(f"{name}_c")) & (F.col("turn") == F.col(f"{name}_t")), "left")
    return m.select("conv_id", "turn", "role", F.concat_ws("\n", "q2", "q1", "text").alias("text"))


def quotation_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query op3: every message of the conversations, sent as mail, linked and freed of quotes."""
    mail = as_mail(read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"))
    return conversations(mail).select(
        "conv_id", "turn", "role", "n_quotes", "n_linked", "parent_turn", "root_turn", "depth",
        F.sha2("content", 256).alias("content_sha256"))


#: what the mail must come back to, from the conversations themselves
QUOTATION_SQL = r"""
WITH RECURSIVE m AS (SELECT conv_id, turn, role, coalesce(text, '') AS text,
    translate(trim(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')),
              'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm FROM conversations),
o AS (SELECT conv_id, norm, min(turn) AS first FROM m WHERE norm <> '' GROUP BY 1, 2),
q AS (SELECT m.conv_id, m.turn, m.role, m.text, (a.norm <> '')::INT AS n1, (b.norm <> '')::INT AS n2, o.first AS parent
      FROM m LEFT JOIN m a ON a.conv_id = m.conv_id AND a.turn = m.turn - 1
      LEFT JOIN m b ON b.conv_id = m.conv_id AND b.turn = m.turn - 2
      LEFT JOIN o ON o.conv_id = a.conv_id AND o.norm = a.norm),
r AS (SELECT conv_id, turn, turn AS root, 0 AS depth FROM q WHERE parent IS NULL
      UNION ALL SELECT q.conv_id, q.turn, r.root, r.depth + 1 FROM q JOIN r ON r.conv_id = q.conv_id AND r.turn = q.parent)
SELECT q.conv_id, q.turn, q.role, coalesce(n1, 0) + coalesce(n2, 0) AS n_quotes,
       (coalesce(n1, 0) + coalesce(n2, 0))::BIGINT AS n_linked, q.parent AS parent_turn, r.root AS root_turn, r.depth,
       sha256(array_to_string([x FOR x IN string_split(q.text, chr(10)) IF trim(x) <> ''], chr(10))) AS content_sha256
FROM q JOIN r ON r.conv_id = q.conv_id AND r.turn = q.turn
"""
