"""Operators 11 and 13 against the libraries themselves, token by token."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest

from eventide.llm import token_alignment, token_counts
from eventide.llm.vocabulary_files import TokenizerFile, runs, segments, segments_unspaced

DOCS = "doc_id long, text string, lang string, n_tokens string, chunk string, part int, row string, digest string"
A_PATH, B_PATH = (public_tokenizers.path(f) for f in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
SIGNS = [*"ab \n\t'sé漢\U0001F600▁.! ​\x00 1  Ωx\x1f\x85", "<|endoftext|>", "<s>", " the", " foo"]
ODD = [None, "", " ", "  ", "\n", "x", " x ", "a▁b", "▁", "漢字 ñandú Größe ½ \U0001F600", "<|endoftext|> <s> end",
       "tab\there\r\nnext  line ", "é   nbsp", "\x00\x01 zero", "one two", "one two", "x" * 5000,
       " ".join(f"word{i % 977}" for i in range(20_000)), "no-break wide space"]


@pytest.fixture(scope="module")
def tools():
    tools = (TokenizerFile.read(A_PATH, plain=True).open(), TokenizerFile.read(B_PATH).open(),
             TokenizerFile.read(A_PATH).open())
    for t in tools:
        t.table = t.token_bytes()
    return tools


@pytest.fixture(scope="module")
def odd(spark):
    rng = random.Random(2)
    texts = ODD + ["".join(rng.choice(SIGNS) for _ in range(rng.randrange(40))) for _ in range(300)]
    rows = [(i if i else None, t, "en", "x", "y", 1, None, "z") for i, t in enumerate(texts)]
    return spark.createDataFrame([*rows, rows[14]], DOCS).repartition(3)


def bytes_of(table, ids):
    bounds, content = table
    return [content[bounds[i]:bounds[i + 1]].tobytes() for i in ids]


def walked(text, a, b):
    """(A ids, B ids, groups, links) by walking along both token lists, None where bytes differ."""
    if not text:
        return None
    ids_a, ids_b = a.tok.encode(" " + text, add_special_tokens=False).ids, b.sp.encode(text)
    parts = bytes_of(a.table, ids_a), bytes_of(b.table, ids_b)
    if any(b"".join(p) != (" " + text).encode() for p in parts):
        return None
    end_a, end_b = (np.cumsum([len(x) for x in p]).tolist() for p in parts)
    i = j = 0
    links, groups, new = [], [([], [])], [True, True]
    while i < len(ids_a):
        links.append((ids_a[i], ids_b[j]))
        for side, (fresh, ids, at) in enumerate(zip(new, (ids_a, ids_b), (i, j))):
            if fresh:
                groups[-1][side].append(ids[at])
        new = [end_a[i] <= end_b[j], end_b[j] <= end_a[i]]
        if all(new):
            groups.append(([], []))
        i, j = i + new[0], j + new[1]
    return ids_a, ids_b, groups[:-1], links


def spelled(groups):
    return ";".join(",".join(map(str, p)) + "|" + ",".join(map(str, q)) for p, q in groups)


@pytest.mark.parametrize("chunk_chars,block_chars,slice_segments", [(8_000_000, 1_000_000, 50_000), (300, 90, 7)])
def test_alignment_equals_a_walk_over_the_tokens(spark, odd, tools, chunk_chars, block_chars, slice_segments):
    a, b, _ = tools
    sizes = token_alignment.Sizes(chunk_chars, block_chars, 200, slice_segments)
    out = token_alignment.align(odd, ["text", "lang", "chunk", "part", "n_tokens"], TokenizerFile.read(A_PATH, plain=True),
                                TokenizerFile.read(B_PATH), sizes).collect()
    texts = [r.text for r in odd.select("text").collect()]
    each = {t: walked(t, a, b) for t in set(texts)}
    assert sum(v is None for v in each.values()) > 20
    count = Counter()
    for t in texts:
        count.update(each[t][3] if each[t] else [])
    top = Counter()
    for (_, y), n in count.items():
        top[y] = max(top[y], n)
    assert Counter(r.text for r in out) == Counter(texts)
    for r in out:
        assert (r.lang, r.chunk, r.part, r.n_tokens) == ("en", "y", 1, "x")
        have = (*(r[m] for m in token_alignment.MEASURES), bytes(r.groups).decode())
        if each[r.text] is None:
            assert have == (0, 0, 0, 0, 0, 0, "")
            continue
        ids_a, ids_b, groups, links = each[r.text]
        assert have == (len(ids_a), len(ids_b), len(groups), len(links), sum(count[x] == top[x[1]] for x in links),
                        sum(count[x] for x in links), spelled(groups))


def test_spans_place_parts_of_characters_and_byte_tokens(tools):
    a, b, _ = tools
    tool = token_alignment.Aligner(a, b)
    e = tool.encoded([" 漢\U0001F600é", " a▁b", " ⁣x"])
    assert e.valid.tolist() == [True, False, True]
    exact = token_alignment.decoded_ends(np.concatenate([[0], np.cumsum(e.length)]),
                                         np.repeat(np.arange(3), e.n_a), tool.size_a[e.ids_a])
    assert e.ends_a.tolist() == exact.tolist()
    # several tokens share one character, several byte tokens one span
    assert e.n_a[0] > 4 and tool.byte_piece[e.ids_b].sum() >= 3


def test_coarse_spans_agree_with_the_bytes(tools):
    """The refined spans need no correction by decoded lengths in valid segments."""
    a, b, _ = tools
    tool, rng, fixed = token_alignment.Aligner(a, b), random.Random(4), []
    own = token_alignment.Aligner._checked

    def watch(bounds, valid, seg, ends, size):
        good = valid[seg]
        fixed.append(int((own(bounds, valid, seg, ends, size)[good] != ends[good]).sum()))
        return own(bounds, valid, seg, ends, size)

    tool._checked = watch
    tool.encoded([" " + "".join(rng.choice(SIGNS) for _ in range(rng.randrange(1, 25))) for _ in range(4000)])
    assert sum(fixed) == 0


def test_segments_join_to_the_text(tools):
    rng = random.Random(9)
    for _ in range(500):
        t = " " + "".join(rng.choice(SIGNS) for _ in range(rng.randrange(30)))
        assert "".join(segments(t, True)) == t and segments(t, False) == [t]
    assert all(t.cuts for t in tools)
    assert not TokenizerFile.read(public_tokenizers.path("word_bpe_49k.json")).open().cuts


def test_segments_without_their_space(tools):
    rng = random.Random(10)
    for t in [t or "" for t in ODD] + ["".join(rng.choice(SIGNS) for _ in range(rng.randrange(30))) for _ in range(500)]:
        for cuts in (True, False):
            assert [f" {s}" for s in segments_unspaced(t, cuts)] == segments(f" {t}", cuts)
    # a segment that does not end with a visible character ends its run
    assert runs([" a", " b\n", " c", " d▁", "", " e"], True) == [0, 2, 4, 5, 6]
    assert runs([" a", " b"], False) == [0, 1, 2] and runs([], True) == runs([], False) == [0]


def test_links_and_groups_are_made_without_sorting(tools, monkeypatch):
    """Ends are positions in a slice of few bytes, so counts by position do."""
    a, b, _ = tools
    tool, rng = token_alignment.Aligner(a, b), random.Random(6)
    parts = [" " + "".join(rng.choice(SIGNS) for _ in range(rng.randrange(1, 25))) for _ in range(400)]
    encoded = tool.encoded(parts)

    def sorts(*_, **__):
        raise AssertionError("sorted")

    for name in ("union1d", "intersect1d", "lexsort", "unique", "argsort", "sort"):
        monkeypatch.setattr(token_alignment.np, name, sorts)
    got = encoded.aligned()
    ids, sign = got.spelled()
    monkeypatch.undo()
    assert 0 < encoded.valid.sum() < len(parts)
    ends = np.cumsum(got.tokens)
    for k, part in enumerate(parts):
        own = slice(ends[k] - got.tokens[k], ends[k])
        text = "".join(f"{i}{chr(x)}" for i, x in zip(ids[own], sign[own]))
        links = [(p >> 32, p & (1 << 32) - 1) for p in got.pair[got.link_seg == k].tolist()]
        want = walked(part[1:], a, b) if encoded.valid[k] else None
        assert (want is not None) == encoded.valid[k]
        assert (got.groups[k], links, text[:-1]) == ((len(want[2]), want[3], spelled(want[2])) if want else (0, [], ""))


def test_known_segments_are_not_encoded_again(tools, monkeypatch):
    a, b, _ = tools
    tool, plain, rng, asked = token_alignment.Aligner(a, b), token_alignment.Aligner(a, b), random.Random(8), []
    own = tool.encoded
    tool.encoded = lambda parts: asked.extend(parts) or own(parts)
    monkeypatch.setattr(token_alignment, "KNOWN", 50)
    monkeypatch.setattr(token_alignment, "SHORT", 12)
    words = list(dict.fromkeys("".join(rng.choice(SIGNS[:18]) for _ in range(rng.randrange(9))) for _ in range(300)))

    def stored(texts):
        asked.clear()
        plain.known, plain.kept = {}, token_alignment.Tokens.none()
        got, want = (token_alignment._stored(t, texts, 40) for t in (tool, plain))
        assert all(x.dtype == y.dtype and x.tolist() == y.tolist() for x, y in zip(got, want, strict=True))
        assert len(tool.known) == len(tool.kept.valid) <= 50
        return [p[1:] for p in asked]

    long = "x" * 13
    assert stored([*words[:30], long]) == [*words[:30], long]
    assert stored([long, *words[40:20:-1]]) == [long, *words[40:29:-1]]
    assert stored(words[:41]) == [] and stored([]) == []
    # full: what came first stays, until hardly any is met again
    assert len(stored(words[:80])) == 39 and stored(words[:60]) == words[50:60]
    assert stored(words[100:150]) == words[100:150] and stored(words[100:150]) == []
    files = TokenizerFile.read(A_PATH, plain=True), TokenizerFile.read(B_PATH)
    assert token_alignment.opened(*files) is token_alignment.opened(*files)


def test_alignment_of_nothing(spark, odd):
    files = TokenizerFile.read(A_PATH, plain=True), TokenizerFile.read(B_PATH)
    assert token_alignment.align(odd.limit(0), ["doc_id"], *files).count() == 0
    blank = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    assert [tuple(r)[1:] for r in token_alignment.align(blank, ["doc_id"], *files).collect()] == 2 * [
        (0, 0, 0, 0, 0, 0, bytearray(b""))]


# ---- 13 ---------------------------------------------------------------------------------------

@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "piece_bpe_32k.model", "word_bpe_49k.json"])
def test_counts_are_the_librarys(spark, odd, tmp_path, name):
    file = TokenizerFile.read(public_tokenizers.path(name))
    tool = file.open()
    got = token_counts.counted(odd, file, f"{tmp_path}/cache", limit=30)
    assert got.columns == ["doc_id", "lang", "chunk", "part", "row", "digest", "n_bytes", "n_tokens", "over_limit"]
    rows = {r.doc_id: r for r in odd.collect()}
    out = got.collect()
    assert Counter(r.doc_id for r in out) == Counter(r.doc_id for r in odd.select("doc_id").collect())
    for r in out:
        text = rows[r.doc_id].text or ""
        n = len(tool.tok.encode(text, add_special_tokens=False).ids if name.endswith("json") else tool.sp.encode(text))
        assert (r.n_bytes, r.n_tokens, r.over_limit, r.digest, r.row) == (len(text.encode()), n, n > 30, "z", None)


def test_only_distinct_misses_are_encoded(spark, odd, tmp_path):
    file, cache = TokenizerFile.read(A_PATH), f"{tmp_path}/cache"
    texts = {r.text or "" for r in odd.select("text").collect()}
    first = token_counts.add_misses(odd, file, cache)
    assert first == len(texts) and token_counts.add_misses(odd, file, cache) == 0
    more = odd.select("doc_id", "text").unionByName(spark.createDataFrame(
        [(900, "new one"), (901, "new one"), (902, "another")], "doc_id long, text string"))
    before = spark.read.parquet(cache).count()
    out = token_counts.counted(more, file, cache)
    assert spark.read.parquet(cache).count() == before + 2 and out.count() == more.count()
    # counts come from the cache, whatever made them
    spoilt = spark.createDataFrame([(file.digest, hashlib.sha256(b"stored").digest(), 4321)], token_counts.CACHE)
    spoilt.write.mode("append").partitionBy("tokenizer").parquet(cache)
    one = spark.createDataFrame([(1, "stored")], "doc_id long, text string")
    assert token_counts.counted(one, file, cache).first().n_tokens == 4321
    # another version of the tokenizer does not see them
    plain = TokenizerFile.read(A_PATH, plain=True)
    assert plain.digest != file.digest and token_counts.counted(one, plain, cache).first().n_tokens == 2


def test_many_misses_take_the_other_way(spark, odd, tmp_path, monkeypatch):
    file = TokenizerFile.read(A_PATH)
    few = token_counts.counted(odd, file, f"{tmp_path}/a").collect()
    monkeypatch.setattr(token_counts, "FEW", 10)
    many = token_counts.counted(odd, file, f"{tmp_path}/b")
    assert sorted(map(str, many.collect())) == sorted(map(str, few))
    assert spark.read.parquet(f"{tmp_path}/b").count() == spark.read.parquet(f"{tmp_path}/a").count()


def test_counts_of_an_empty_table(spark, odd, tmp_path):
    out = token_counts.counted(odd.limit(0), TokenizerFile.read(A_PATH), f"{tmp_path}/cache")
    assert out.count() == 0
