"""Operators against brute force on small tables, and their edge cases."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from eventide.llm import (bpe_codec, components, exact_dedup, host_reputation, language_id, minhash_dedup, packing,
                          pseudo_likelihood, quality_rules, quotation_linking, source_mix)
from eventide.llm import textbytes as tb

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, label string, size string"
LONG = " ".join(f"word{i % 977}" for i in range(30_000))
ODD = [
    (1, None, None, None, 0, "x", "y"),
    (2, "", "en", None, 0, "x", "y"),
    (3, " \t\n ", None, "s", 3, None, None),
    (4, "One two\tthree", "en", "s", 1, None, None),
    (4, "One two\tthree", "en", "s", 1, None, None),
    (None, "no id here but some words", "de", "s", 1, None, None),
    (5, LONG, "en", "t", len(LONG), None, None),
    (6, LONG.replace("word5 ", "other "), "en", "t", 1, None, None),
    (7, LONG + "  ", "en", "t", 1, None, None),
    (8, "漢字 ñandú Größe ½ \U0001F600", "de", "t", 1, None, None),
    (9, "x" * 5000, "en", "t", 1, None, None),
    (10, "12345 !!! 678", "fr", None, 1, None, None),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture
def odd_file(spark, tmp_path):
    def make(rows=ODD):
        p = str(tmp_path / f"docs-{len(rows)}")
        spark.createDataFrame(rows, DOCS).repartition(3).write.parquet(p)
        return spark.read.parquet(p)
    return make


def rows_of(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=repr)


# ---- words ------------------------------------------------------------------------------------

def test_words_match_the_pattern_and_do_not_cross_documents():
    texts = ["a b", "c", None, "", "\x0bd\x0c e\r\n", "ünï cödé\u00a0x"]
    got = []
    for s in tb.slices(pa.array(texts), limit=4):
        w = tb.words(s)
        got += [[s.data[a:b].tobytes().decode() for a, b in zip(w.start[i:j], w.end[i:j])]
                for i, j in zip(w.first[:-1], w.first[1:])]
    assert got == [WORD.findall(t or "") for t in texts]


def test_equal_words_have_equal_hashes_anywhere():
    (s,) = tb.slices(pa.array(["alpha Beta alpha", "beta ALPHA " + "z" * 3000 + " alpha"]))
    w = tb.words(s, fold_case=True)
    a, b = w.hash[0], w.hash[1]
    assert list(w.hash == a) == [True, False, True, False, True, False, True] and w.hash[3] == b


# ---- 2 ----------------------------------------------------------------------------------------

def base_features(text):
    t = text or ""
    w = WORD.findall(t)
    runs = [tuple(w[i:i + 8]) for i in range(len(w) - 7)]
    often, cover = Counter(runs), set()
    for i, r in enumerate(runs):
        if often[r] > 1:
            cover.update(range(i, i + 8))
    lines = [x for x in t.split("\n") if WORD.search(x)]
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines), len(lines) - len(set(lines)),
            len(cover), sum(a == b for a, b in zip(w, w[1:])))


def test_quality_features_match_brute_force(spark, odd):
    repeats = [(100, "a b c d e f g h i " * 3 + "\nx\n x\nx\n\n#*", "en", "s", 1, None, None)]
    docs = odd.unionByName(spark.createDataFrame(repeats, DOCS))
    got = rows_of(quality_rules.with_features(docs, keep=["doc_id", "text"]),
                  "doc_id", "text", *quality_rules.FEATURES)
    assert got == sorted([(r[0], r[1], *base_features(r[1])) for r in ODD + repeats], key=repr)


def test_fences_follow_the_group_and_leave_clean_texts(spark, none):
    def text(i, mark):
        return " ".join(f"w{i}x{k}{mark if k % 2 else ''}" for k in range(40))

    clean = [(i, text(i, ""), "en", "a", 1, None, None) for i in range(150)]
    marked = [(1000 + i, text(i, "###"), "en", "a", 1, None, None) for i in range(10)]
    code = [(2000 + i, text(i, "#" * (1 + i % 3)), "de", None, 1, None, None) for i in range(150)]
    docs = spark.createDataFrame(clean + marked + code, DOCS)
    feats = quality_rules.with_features(docs, keep=["doc_id", "lang", "source"])
    got = {r["doc_id"]: r for r in quality_rules.judged(feats).collect()}
    assert len(got) == 310
    assert all(got[i]["kept"] for i in range(150))
    assert all(got[1000 + i]["reason"] == "symbols" for i in range(10))
    assert all(got[2000 + i]["kept"] for i in range(150))  # symbols are usual in this group
    assert quality_rules.stage(spark, none, "").columns == none.columns
    assert rows_of(quality_rules.stage(spark, docs, ""), "doc_id") == rows_of(
        docs.where("doc_id < 1000 or doc_id >= 2000"), "doc_id")


def test_fences_are_as_tight_as_their_group(spark):
    """What one group rejects is usual in another; no fixed value takes part."""
    def text(i, size, echoes=0):
        words = [f"{(i * 37 + k * 11) % 9973:05d}"[:5].ljust(size + (i + k) % 2, "x") for k in range(60)]
        for k in range(echoes):
            words[2 * k + 1] = words[2 * k]
        return " ".join(words)

    def rows(first, n, lang, size, echoes=0):
        return [(first + i, text(i, size, echoes), lang, "s", 1, None, None) for i in range(n)]

    short, long = rows(0, 150, "en", 5), rows(1000, 150, "de", 9, echoes=6)
    odd_ones = rows(2000, 5, "en", 9) + rows(3000, 5, "en", 5, echoes=6) + rows(4000, 5, "de", 5, echoes=6)
    feats = quality_rules.with_features(spark.createDataFrame(short + long + odd_ones, DOCS),
                                        keep=["doc_id", "lang", "source"])
    got = {r["doc_id"]: r["reason"] for r in quality_rules.judged(feats).collect()}
    assert {got[d] for d in (*range(150), *range(1000, 1150))} == {None}
    assert {got[2000 + i] for i in range(5)} == {"word_length"} == {got[4000 + i] for i in range(5)}
    assert {got[3000 + i] for i in range(5)} == {"echoes"}


def test_sketches_merge_and_bound_the_quantile(spark):
    rows = [("en", "a" if i % 3 else "b", 1000, 4000 + 7 * i, 0, 1, 0, 0, 0) for i in range(300)]
    feats = spark.createDataFrame(rows, "lang string, source string, n_words long, word_chars long, n_symbols long, "
                                        "n_lines long, n_dup_lines long, n_repeat_words long, n_echoes long")
    q = quality_rules.quantiles(quality_rules.sketch(feats), []).where("measure = 'word_length'").first()
    exact = sorted(4000 + 7 * i for i in range(300))
    assert q["n"] == 300
    for p, v in ((0.25, exact[74]), (0.75, exact[224])):
        assert v / quality_rules.GAMMA <= q[f"q{int(p * 100)}"] <= v * quality_rules.GAMMA


# ---- 1 ----------------------------------------------------------------------------------------

def brute_groups(rows, width):
    def shingles(t):
        w = [x.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
             for x in WORD.findall(t or "")]
        return {tuple(w[i:i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())

    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            k = len(sets[i] & sets[j])
            if k and 100 * k >= 80 * (len(sets[i]) + len(sets[j]) - k):
                root[find(i)] = find(j)
    low = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        low[find(i)].append(d)
    return sorted([(rows[i][0], len(sets[i]),
                    min((d for d in low[find(i)] if d is not None), default=None) if sets[i] else rows[i][0])
                   for i in range(len(rows))], key=repr)


def near_rows():
    rng = np.random.default_rng(3)
    rows, n = [], 0
    for g in range(12):
        base = [f"g{g}w{k}" for k in range(100 + 20 * g)]
        for _ in range(12):
            w = list(base)
            for k in rng.choice(len(w), rng.integers(0, 8), replace=False):
                w[k] = f"n{n}e{k}"
            rows.append((n, " ".join(w).upper() if n % 5 == 0 else " ".join(w)))
            n += 1
    return rows


@pytest.mark.parametrize("block", [4, 256])
def test_near_groups_match_brute_force(spark, block):
    rows = near_rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = rows_of(minhash_dedup.near_groups(docs, width=4, block=block), "doc_id", "n_shingles", "component_id")
    assert got == brute_groups(rows, 4)


def test_near_groups_edge_cases(spark, odd, none):
    out = minhash_dedup.near_groups(odd, width=4)
    assert rows_of(out, "doc_id", "n_shingles", "component_id") == brute_groups([r[:2] for r in ODD], 4)
    kept = {r["doc_id"]: r["kept"] for r in out.collect()}
    assert kept[1] and kept[2] and kept[3] and kept[4] and kept[5] and not kept[6] and not kept[7]
    assert minhash_dedup.near_groups(none).count() == 0
    assert rows_of(minhash_dedup.stage(spark, odd, ""), "doc_id") == sorted(
        [(r[0],) for r in ODD if r[0] not in (6, 7)], key=repr)


def test_block_links_are_exact_and_spanning():
    rng = np.random.default_rng(4)
    sets = [np.unique(rng.integers(0, 60, 50).astype(np.uint64)) for _ in range(40)]
    found = minhash_dedup.block_links(sets, np.ones(40, bool), np.arange(40), 60)
    root = list(range(40))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in found:
        k = len(np.intersect1d(sets[i], sets[j]))
        assert 100 * k >= 60 * (len(sets[i]) + len(sets[j]) - k) and find(i) != find(j)
        root[find(i)] = find(j)
    for i in range(40):
        for j in range(i):
            k = len(np.intersect1d(sets[i], sets[j]))
            assert find(i) == find(j) or 100 * k < 60 * (len(sets[i]) + len(sets[j]) - k)


def test_components_of_chains_and_hubs(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7), (201, 200), (200, 201)]
    got = dict(rows_of(components.components(spark.createDataFrame(edges, "u long, v long")), "node", "root"))
    want = {i: 0 for i in range(41)} | {100 + i: 100 for i in range(30)} | {200: 200, 201: 200}
    assert got == want
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0


# ---- 4 ----------------------------------------------------------------------------------------

def brute_exact(rows):
    norm = [re.sub(r"[\x20\x09-\x0D]+", " ", r[1] or "") for r in rows]
    groups = defaultdict(list)
    for r, n in zip(rows, norm):
        groups[n].append(r[0])
    out = []
    for r, n in zip(rows, norm):
        keep = min((d for d in groups[n] if d is not None), default=None)
        out.append((r[0], keep, len(groups[n]), r[0] == keep, hashlib.sha256(n.encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("poor", [False, True])
def test_exact_groups_do_not_rest_on_the_digest(spark, odd_file, poor):
    rows = ODD + [(20 + i, f"text {i % 7}", "en", "s", 1, None, None) for i in range(60)]
    docs = odd_file(rows)
    digest = F.substring(exact_dedup.sha256(exact_dedup.normalised(F.col("text"))), 1, 1) if poor else None
    out = exact_dedup.exact_groups(docs, digest=digest)
    assert rows_of(out, "doc_id", "keep_id", "group_size", "kept", "text_sha256") == brute_exact(rows)
    assert out.where("first_row").count() == len({r[4] for r in brute_exact(rows)})


def test_exact_stage_and_empty_table(spark, odd_file):
    out = exact_dedup.stage(spark, odd_file(), "")
    assert out.columns == [f.split()[0] for f in DOCS.split(", ")]
    assert sorted(r["doc_id"] for r in out.collect() if r["doc_id"]) == [1, 3, 4, 5, 6, 7, 8, 9, 10]
    assert exact_dedup.exact_groups(odd_file([])).count() == 0


def test_state_survives_a_restart_and_never_expires(spark, tmp_path):
    a, s = str(tmp_path / "arrivals"), str(tmp_path / "state")
    for first in (10, 3):
        spark.createDataFrame([("d", first, "f", 0), (f"e{first}", first, "f", 1)], exact_dedup.ARRIVAL).write.mode(
            "append").parquet(a)
        exact_dedup.remember(spark, a, s)
    assert rows_of(exact_dedup.known(spark, s), "digest", "first.doc_id", "copies") == [
        ("d", 3, 2), ("e10", 10, 1), ("e3", 3, 1)]


# ---- 5 ----------------------------------------------------------------------------------------

def brute_targets(sizes):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    total, fixed = sum(sizes.values()), {}
    while True:
        free = [s for s in order if s not in fixed]
        if not free:
            return fixed
        level = (total - sum(fixed.values())) / sum(w[s] for s in free)
        over = [s for s in free if w[s] * level > 3 * sizes[s]]
        if not over:
            return fixed | {s: w[s] * level for s in free}
        fixed |= {s: 3 * sizes[s] for s in over}


def mix_rows():
    rng = np.random.default_rng(8)
    n = {"a": 4, "b": 700, "c": 90, None: 150, "é": 60}
    return [(i, s, int(rng.integers(0, 50)), float(rng.choice([0.25, 0.5, 1.0])))
            for i, s in enumerate(s for s, k in n.items() for _ in range(k))]


@pytest.mark.parametrize("per_range", [16, 4096])
def test_mix_matches_brute_force(spark, per_range):
    rows = mix_rows()
    docs = spark.createDataFrame(rows, "doc_id long, source string, size long, weight double").repartition(4)
    got = {r["doc_id"]: r for r in source_mix.mix(docs, rows_per_range=per_range).collect()}
    sizes = defaultdict(int)
    for _, s, n, _ in rows:
        sizes[s] += n
    target = brute_targets(dict(sizes))
    assert len(got) == len(rows)
    for s, size in sizes.items():
        own = [r for r in rows if r[1] == s]
        epochs = int(target[s] // size)
        rest, upto, want = target[s] - epochs * size, 0, {}

        def key(r):
            u = (int(hashlib.md5(f"mix:{r[0]}".encode()).hexdigest()[:12], 16) + 0.5) / 2**48
            return (-np.log(u) / r[3], r[0])

        for r in sorted(own, key=key):
            upto += r[2]
            want[r[0]] = r[2] * (epochs + (r[2] > 0 and epochs < 3 and upto - r[2] / 2 <= rest))
        assert {r[0]: got[r[0]]["taken"] for r in own} == want
        assert all(abs(got[r[0]]["target"] - target[s]) < 1e-6 and got[r[0]]["source_size"] == size for r in own)
        assert abs(sum(want.values()) - target[s]) <= max(r[2] for r in own) / 2 + 1e-6


def test_mix_edge_cases(spark, odd, none):
    labels = spark.createDataFrame([(5, None, None), (5, 1, 0), (6, 0, 0), (None, 1, 1)],
                                   "doc_id long, quality int, toxic int")
    d = source_mix.sized(odd, labels, ["doc_id", "source"])
    weight = {r["doc_id"]: r["weight"] for r in d.collect()}
    assert (weight[5], weight[6], weight[7]) == (1.0, 0.25, 0.5)
    got = source_mix.mix(d).collect()
    assert len(got) == len(ODD) and all(0 <= r["taken"] <= 3 * r["size"] for r in got)
    assert source_mix.mix(source_mix.sized(none, labels, ["doc_id", "source"])).count() == 0
    blank = spark.createDataFrame([(1, "a", 0, 1.0)], "doc_id long, source string, size long, weight double")
    assert source_mix.mix(blank).first()["taken"] == 0


# ---- 7 ----------------------------------------------------------------------------------------

def test_hosts_paths_and_rules(spark):
    urls = [("http://A.Example.NET/en/1?x#y", "a.example.net", "/en/1", "example.net/en/", "allow"),
            ("https://example.net", "example.net", "", None, "allow"),
            ("https://b.net/en", "b.net", "/en", "net/", "block"),
            ("x://notexample.com/de/", "notexample.com", "/de/", None, "allow"),
            ("x://example.com/de/q", "example.com", "/de/q", "example.com/de/", "block"),
            ("x://h.org?fr", "h.org", "", None, "allow"),
            ("x://org/fr/", "org", "/fr/", "org/fr/", "allow"),
            ("://1.2.3.4:80/", "1.2.3.4:80", "/", None, "allow"),
            ("no scheme", "", "", None, "allow"), (None, "", "", None, "allow")]
    pages = spark.createDataFrame([(i, u[0]) for i, u in enumerate(urls)], "page_id long, url string")
    empty = spark.createDataFrame([], "host string, bad int")
    got = {r["page_id"]: tuple(r) for r in host_reputation.judged(pages, empty).select(
        "page_id", "host", "path", "rule", "verdict").collect()}
    assert got == {i: (i, *u[1:]) for i, u in enumerate(urls)}
    assert host_reputation.judged(pages.where("false"), empty).count() == 0


def test_domains(spark):
    hosts = {"a.b.co.uk": ("b.co.uk", "co.uk"), "co.uk": ("co.uk", "co.uk"), "x.example.com": ("example.com", "com"),
             "com": ("com", "com"), "": ("", ""), "10.0.0.1": ("10.0.0.1", "10.0.0.1"), "w.b.": ("b.", "")}
    df = spark.createDataFrame([(h,) for h in hosts], "h string")
    assert {r["h"]: (r["d"], r["s"]) for r in df.select(
        "h", host_reputation.domain(F.col("h")).alias("d"), host_reputation.suffix(F.col("h")).alias("s")).collect()} == hosts


def test_reputation_shrinks_and_needs_evidence(spark):
    rows = ([("bad.one.com", 60, 58)] + [(f"h{i}.two.com", 40, 2) for i in range(20)]
            + [("new.two.com", 0, 0), ("once.two.com", 1, 1), ("q.three.org", 30, 2)])
    got = {r["host"]: r for r in host_reputation.reputation(
        spark.createDataFrame(rows, "host string, n int, bad int")).collect()}
    assert got["bad.one.com"]["bound"] > 0.5
    assert got["once.two.com"]["bound"] < 0.5 and got["new.two.com"]["rate"] < got["once.two.com"]["rate"]
    assert all(r["bound"] < r["rate"] < 1 for r in got.values())


# ---- 9 ----------------------------------------------------------------------------------------

def test_language_learns_and_handles_odd_texts(spark, odd, none):
    rows = [(i, " ".join(f"{a}{k * 7 % 13}" for k in range(i % 9 + 3)), lang, "s", 1, None, None)
            for i in range(80) for lang, a in (("xx", "ghar"), ("yy", "łodü"))]
    docs = spark.createDataFrame(rows, DOCS)
    model = language_id.fit(docs.where(~language_id.held_out(F.col("doc_id"))))
    assert model[0] == ["xx", "yy"]
    got = language_id.predict(docs, model, ["doc_id", "lang"]).collect()
    assert all(r["lang"] == r["lang_pred"] and 0.5 < r["score"] <= 1 for r in got)
    out = {r["doc_id"]: r["lang_pred"] for r in language_id.predict(odd, model, ["doc_id"]).collect()}
    assert out[1] == out[2] == out[3] == out[10] == "und" and out[4] in model[0]
    assert language_id.predict(none, model, ["doc_id"]).count() == 0
    nothing = language_id.fit(none)
    assert {r["lang_pred"] for r in language_id.predict(odd, nothing, ["doc_id"]).collect()} == {"und"}
    held = {r["doc_id"]: r["h"] for r in docs.select("doc_id", language_id.held_out(F.col("doc_id")).alias("h")).collect()}
    assert all(h == (zlib.crc32(str(i).encode()) % 4 == 2) for i, h in held.items())


def test_language_counts_add_up_over_tasks(spark):
    docs = spark.createDataFrame([("a", f"text {i}") for i in range(50)] + [("b", "other")], "lang string, text string")
    got = {r["lang"]: np.frombuffer(r["counts"], np.int64)
           for r in language_id.language_counts(docs.repartition(7)).collect()}
    want = sum(language_id.gram_counts(f"text {i}") for i in range(50))
    assert set(got) == {"a", "b"} and (got["a"] == want).all()


# ---- 10 and 8 ---------------------------------------------------------------------------------

@pytest.fixture(scope="module")
def tiktoken_encode():
    return packing.production_tokenizer()


@pytest.mark.parametrize("chunk_chars", [50, 1 << 25])
def test_bpe_matches_tiktoken_and_decodes(spark, odd, none, tiktoken_encode, chunk_chars):
    ranks, pattern = bpe_codec.production()
    out = bpe_codec.encode(odd.repartition(2), ["doc_id", "text", "label"], ranks, pattern, chunk_chars, n_buckets=5)
    got = out.collect()
    assert len(got) == len(ODD)
    for r in got:
        assert np.frombuffer(r["ids"], np.uint32).tolist() == tiktoken_encode(r["text"] or "")
    back = bpe_codec.decode(out, ranks, ["text"]).collect()
    assert all(bytes(r["decoded"]) == (r["text"] or "").encode() for r in back)
    assert bpe_codec.encode(none, ["doc_id"], ranks, pattern).count() == 0


def test_merges_by_heap_equal_merges_by_scan():
    ranks, _ = bpe_codec.production()
    rng = np.random.default_rng(2)
    for _ in range(300):
        w = "".join(rng.choice(list("abeténñ α漢.- theing"), rng.integers(1, 120))).encode()
        assert bpe_codec._merge_heap(w, ranks) == bpe_codec._merge_scan(w, ranks)


def test_packing_is_lossless_and_rows_are_consistent(spark, odd, none, tiktoken_encode):
    packed = packing.pack(odd.coalesce(1), packing.production_tokenizer, capacity=64, shard_tokens=5000)
    for r in packed.collect():
        ids, pos = np.frombuffer(r["ids"], np.uint32), np.frombuffer(r["positions"], np.uint32)
        cu = r["cu_seqlens"]
        assert len(ids) == 64 and cu[0] == 0 and cu[-1] == r["n_tokens"] <= 64 and (ids[cu[-1]:] == packing.PAD).all()
        assert all((pos[a:b] == np.arange(b - a)).all() for a, b in zip(cu, cu[1:]))
    got = Counter((r["doc_id"], r["ids"] and np.frombuffer(r["ids"], np.uint32).tobytes())
                  for r in packing.unpack(packed).collect())
    want = Counter((r[0], np.array(tiktoken_encode(r[1]), np.uint32).tobytes()) for r in ODD if r[1])
    assert got == want
    assert packing.pack(none, packing.production_tokenizer).count() == 0


def test_best_fit_decreasing_matches_a_plain_search():
    rng = np.random.default_rng(9)
    for cap in (1, 7, 64, 100):
        sizes = rng.integers(1, cap + 1, 200).tolist()
        room, rows = [], []
        for k in sorted(range(len(sizes)), key=lambda k: (-sizes[k], k)):
            fit = [r for r in range(len(room)) if room[r] >= sizes[k]]
            if fit:
                least = min(room[r] for r in fit)
                r = [r for r in fit if room[r] == least][-1]
            else:
                r = len(room)
                room.append(cap)
                rows.append([])
            room[r] -= sizes[k]
            rows[r].append(sizes[k])
        got = packing.best_fit_decreasing(sizes, cap)
        assert sorted(sum(got, [])) == list(range(200)) and len(got) == len(rows)
        assert sorted(sum(sizes[k] for k in r) for r in got) == sorted(map(sum, rows))


# ---- 6 ----------------------------------------------------------------------------------------

def test_gradients_lower_the_loss_and_probabilities_sum_to_one():
    rng = np.random.default_rng(1)
    net = pseudo_likelihood.Network()
    around = rng.integers(0, pseudo_likelihood.TOKENS, (5, len(pseudo_likelihood._PLACES)))
    every = np.arange(pseudo_likelihood.TOKENS)
    for c in around:
        p = np.exp(pseudo_likelihood.log_probs(net, np.tile(c, (len(every), 1)), every))
        assert abs(p.sum() - 1) < 1e-3


def test_scores_use_both_sides_and_beat_the_untrained_network(spark, odd, none):
    rows = [(i, " ".join(["alpha beta gamma delta epsilon zeta"] * 20), "en", "s", 1, None, None) for i in range(40)]
    docs = spark.createDataFrame(rows, DOCS).unionByName(odd)
    words = pseudo_likelihood.vocabulary(docs)
    weights = pseudo_likelihood.train(docs.where("doc_id < 4"), words, epochs=2)
    assert np.isfinite(weights).all()
    weights = pseudo_likelihood.train(docs.where("text like 'alpha%'").repartition(2), words, epochs=3, batch=128)
    got, first = ({r["doc_id"]: r for r in pseudo_likelihood.score(docs, words, w, ["doc_id", "text"]).collect()}
                  for w in (weights, pseudo_likelihood.Network().vector))
    assert got[0]["n_tokens"] == len(WORD.findall(rows[0][1])) and got[0]["mean"] > first[0]["mean"] + 1
    assert pseudo_likelihood.score(none, words, weights, ["doc_id"]).count() == 0
    assert len(pseudo_likelihood.vocabulary(none)) == 0
    blank = pseudo_likelihood.score(odd.where("doc_id <= 2"), words, weights, ["doc_id"]).collect()
    assert all(r["n_tokens"] == 0 and r["score"] == 0 and r["mean"] is None for r in blank)


# ---- 3 ----------------------------------------------------------------------------------------

MAIL = [
    (1, 0, "a", "Hello all\nsecond line"),
    (1, 1, "b", "On Monday a wrote:\n> hello  ALL\n> second line\n\nFine, thanks"),
    (1, 2, "c", "> > Hello all second line\n>\n>> Hello all\n>> second line\n> fine, thanks\nGood > bad\n"),
    (1, 3, "a", "> Never said\nHm"),
    (1, 4, "a", None),
    (1, 5, "b", ""),
    (1, 1, "b", "> hm\nagain"),
    (2, 0, "x", "> Fine, thanks\nforward"),
    (2, None, "x", "> forward\nlost"),
    (None, 0, "x", "> forward\nstray"),
    (None, 0, "x", "stray too"),
]


def test_very_deep_quotes_and_long_attributions(spark):
    deep, name = ">" * 200_000, "Someone " * 60
    rows = [(1, 0, "user", "First words"), (1, 1, "assistant", f"on Monday {name} wrote:\n> First words\nAn answer"),
            (1, 2, "user", f"{deep} far\n> > >>x\n \t> > First words\nOwn")]
    m = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r["turn"]: r for r in quotation_linking.parsed(m).collect()}
    assert [q["level"] for q in got[2]["quotes"]] == [200_000, 4, 2] and got[2]["content"] == "Own"
    assert got[1]["content"] == "An answer" and [q["level"] for q in got[1]["quotes"]] == [1]
    assert got[1]["quotes"][0]["hash"] == got[2]["quotes"][2]["hash"] == got[0]["own"][0]


def test_quotes_are_linked_and_removed(spark):
    m = spark.createDataFrame([(*r, "extra") for r in MAIL], "conv_id long, turn long, role string, text string, n_quotes string")
    got = {(r["conv_id"], r["turn"], r["content"]): r for r in quotation_linking.conversations(m).collect()}
    assert len(got) == len(MAIL)
    one = got[1, 1, "Fine, thanks"]
    assert (one["n_quotes"], one["n_linked"], one["parent_turn"], one["depth"]) == (1, 1, 0, 1)
    two = got[1, 2, "Good > bad"]
    assert (two["n_quotes"], two["n_linked"], two["parent_turn"], two["root_turn"], two["depth"]) == (2, 1, 1, 0, 2)
    three = got[1, 3, "Hm"]
    assert (three["n_linked"], three["parent_turn"], three["depth"]) == (0, None, 0)
    again = got[1, 1, "again"]  # quotes a later message: no parent, but shares the turn's place
    assert again["n_quotes"] == 1
    forward = got[2, 0, "forward"]
    assert (forward["n_linked"], forward["parent_turn"], forward["depth"]) == (1, None, 0)
    assert got[2, None, "lost"]["parent_turn"] is None and got[None, 0, "stray"] is not None
    assert got[1, 4, ""]["n_quotes"] == 0 and got[1, 0, "Hello all\nsecond line"]["chat"].startswith("<|a|>\n")
    assert quotation_linking.conversations(m.where("false")).count() == 0


def test_reply_trees_of_a_long_chain(spark):
    rows = [(1, t, t - 1 if t else None) for t in range(70)] + [(2, 0, None), (2, 5, 0)]
    got = rows_of(quotation_linking.reply_trees(spark.createDataFrame(rows, "conv_id long, turn long, parent_turn long")),
                  "conv_id", "turn", "root_turn", "depth")
    assert got == sorted([(1, t, 0, t) for t in range(70)] + [(2, 0, 0, 0), (2, 5, 0, 1)], key=repr)
