"""Cases in which an operator once did less than its whole job."""

from __future__ import annotations

import hashlib
import math
from collections import defaultdict

import numpy as np

from eventide.llm import bpe_codec, minhash_dedup, pseudo_likelihood
from eventide.llm import textbytes as tb

DOCS = "doc_id long, text string, lang string, source string, n_chars long, label string, size string"


# ---- 6 ----------------------------------------------------------------------------------------


def test_words_that_share_a_token_have_their_own_probability(spark):
    import pyarrow as pa

    rare = [f"rare{i}" for i in range(600)]
    often = " ".join(f"often{i}" for i in range(pseudo_likelihood.FREQUENT))
    rows = [(i, often) for i in range(9)]
    rows += [(100 + i, w) for i, w in enumerate(rare)]
    rows += [(None, " ".join(w for i, w in enumerate(rare) if i % 4 >= k)) for k in (1, 2, 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    n = {w: 1 + i % 4 for i, w in enumerate(rare)}
    words = pseudo_likelihood.vocabulary(docs)
    hashed = tb.words(next(tb.slices(pa.array([" ".join(rare)]))), fold_case=True).hash
    token = dict(zip(rare, pseudo_likelihood.token_ids(hashed, words).tolist()))
    assert min(token.values()) >= pseudo_likelihood.FREQUENT
    alike = defaultdict(list)
    for w in rare:
        alike[token[w]].append(w)
    vector = pseudo_likelihood.Network().vector
    edge = np.array([[p * pseudo_likelihood.TOKENS + pseudo_likelihood.EDGE for p in range(len(pseudo_likelihood._PLACES))]])
    for chunk_words in (1, 1 << 22):
        out = pseudo_likelihood.score(docs, words, vector, ["doc_id"], chunk_words=chunk_words).collect()
        assert len(out) == len(rows)
        got = {r["doc_id"]: r["score"] for r in out}
        for i, w in enumerate(rare):
            total = sum(n[x] for x in alike[token[w]])
            net = pseudo_likelihood.log_probs(pseudo_likelihood.Network(vector), edge, np.array([token[w]]))[0]
            assert abs(got[100 + i] - (net + math.log(n[w] / (total + 1)))) < 1e-4
    assert any(len({n[w] for w in ws}) > 1 for ws in alike.values())


# ---- 1 ----------------------------------------------------------------------------------------


def test_near_stage_goes_by_row_not_by_id(spark, tmp_path):
    def text(seed, changed=None):
        return " ".join(f"w{seed}x{i}" if i != changed else "other" for i in range(120))

    rows = [(3, text("a")), (None, text("a", 119)),  # a null id near a numbered document
            (None, text("b")),  # clean and unique, without id
            (5, text("c")), (9, text("c", 119)), (5, text("a", 0)),  # 5 twice, once near 3
            (None, text("d")), (None, text("d", 119)),  # near copies without ids
            (7, ""), (7, ""), (5, text("c", 3))]
    path = str(tmp_path / "docs")
    spark.createDataFrame([(*r, "en", "s", 1, None, None) for r in rows], DOCS).coalesce(1).write.parquet(path)
    got = minhash_dedup.stage(spark, spark.read.parquet(path), "").collect()
    assert sorted(((r["doc_id"], r["text"]) for r in got), key=repr) == sorted(
        [rows[0], rows[2], rows[3], rows[6], rows[8], rows[9]], key=repr)


# ---- 10 ---------------------------------------------------------------------------------------


def test_last_stage_returns_the_ids(spark):
    rows = [(1, "One two three, four"), (2, None), (None, "\u6f22\u5b57 \u00f1and\u00fa  x")]
    docs = spark.createDataFrame([(*r, "en", "s", 1, None, None) for r in rows], DOCS)
    ranks, _ = bpe_codec.production()
    token = {r: t for t, r in ranks.items()}
    out = {r["doc_id"]: r for r in bpe_codec.stage(spark, docs, "").collect()}
    for doc_id, text in rows:
        r = out[doc_id]
        ids = np.frombuffer(bytes(r["ids"]), "<u4").tolist()
        decoded = b"".join(token[i] for i in ids)
        assert decoded.decode() == (text or "") and len(ids) == r["n_tokens"]
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(decoded).hexdigest()
