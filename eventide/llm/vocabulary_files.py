"""Public tokenizer files as objects that tasks can open, and safe places to cut texts.

``.json`` files are opened by the tokenizers library, ``.model`` files by sentencepiece. The driver
reads a file once (a parameter, at most ``MAX_FILE`` bytes) and tasks get its bytes, so executors
need no path.

``segments`` cuts a text before spaces that follow a visible character. Where a file's own settings
show that no token can reach over such a place (``cuts``), the tokens of a text are those of its
segments one after another; elsewhere a text is one segment. Equal segments then need one encoding.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from dataclasses import dataclass
from functools import cached_property
from importlib.metadata import version
from itertools import chain
from operator import attrgetter

import numpy as np

MAX_FILE = 64 << 20
#: before a space that is not the last character, after one that is neither white space nor a control
#: sign nor the mark U+2581
_CUT = re.compile("(?<=[^\\s\\x00-\\x20\\x7f-\\xa0▁])(?= .)", re.DOTALL)
#: the same place in a text that a space goes before; the space itself is left out
_GAP = re.compile(" (?<=[^\\s\\x00-\\x20\\x7f-\\xa0▁] )(?=.)", re.DOTALL)
_VISIBLE = re.compile("[^\\s\\x00-\\x20\\x7f-\\xa0▁]\\Z")
MARK = "▁"
RUN_CHARS = 4_000
_PIECE = attrgetter("id", "begin", "end")
#: the printable stand-ins of bytes in byte-level vocabularies: printable Latin-1 stands for itself,
#: the other bytes, in order, for the characters from U+0100 (fixed by the format)
_PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]


def segments(text: str, cuts: bool) -> list[str]:
    return _CUT.split(text) if cuts else [text]


def segments_unspaced(text: str, cuts: bool) -> list[str]:
    """``segments`` of a space and ``text``, each without the space that it begins with."""
    return _GAP.split(text) if cuts else [text]


def runs(parts: list[str], cuts: bool) -> list[int]:
    """Edges of runs of segments that may be encoded as one text: each but the last of a run ends with a
    visible character, as before any cut."""
    if not cuts:
        return list(range(len(parts) + 1))
    visible = {c for c in {p[-1:] for p in parts} if _VISIBLE.match(c)}
    edges, size = [0], 0
    for i, p in enumerate(parts):
        size += len(p)
        if size >= RUN_CHARS or p[-1:] not in visible:
            edges.append(i + 1)
            size = 0
    return edges if edges[-1] == len(parts) else [*edges, len(parts)]


def byte_characters() -> dict[str, int]:
    rest = [b for b in range(256) if b not in set(_PRINTABLE)]
    return {chr(b): b for b in _PRINTABLE} | {chr(256 + i): b for i, b in enumerate(rest)}


def _packed(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    bounds = np.concatenate([[0], np.cumsum([len(p) for p in parts], dtype=np.int64)])
    return bounds, np.frombuffer(b"".join(parts), np.uint8)


@dataclass(frozen=True)
class TokenizerFile:
    """The bytes of a tokenizer file. ``plain`` reads the strings of special tokens as plain text."""

    kind: str  # json or model
    content: bytes
    plain: bool = False

    @classmethod
    def read(cls, path: str, plain: bool = False) -> TokenizerFile:
        with open(path, "rb") as f:
            content = f.read(MAX_FILE + 1)
        if len(content) > MAX_FILE:
            raise ValueError(f"{path} has more than {MAX_FILE} bytes")
        kind = path.rsplit(".", 1)[-1]
        if kind not in ("json", "model"):
            raise ValueError(f"{path} is neither a .json nor a .model file")
        return cls(kind, content, plain)

    @cached_property
    def digest(self) -> str:
        """Names everything that decides the tokens: library and its version, mode, file."""
        library = "tokenizers" if self.kind == "json" else "sentencepiece"
        head = f"{library} {version(library)} {'plain' if self.plain else 'special'} "
        return hashlib.sha256(head.encode() + self.content).hexdigest()

    def open(self) -> ByteLevel | Pieces:
        return ByteLevel(self) if self.kind == "json" else Pieces(self)


class ByteLevel:
    """A tokenizer of the tokenizers library, without truncation, padding or added special tokens."""

    def __init__(self, file: TokenizerFile) -> None:
        # a task has one core; a thread pool would only hold memory of its own per thread
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_str(file.content.decode())
        self.tok.no_truncation()
        self.tok.no_padding()
        self.tok.encode_special_tokens = file.plain
        given = json.loads(file.content)
        split = given.get("pre_tokenizer") or {}
        added = given.get("added_tokens") or []
        # the split at white space of the byte-level rule, with nothing that could reach over it
        self.cuts = (given.get("normalizer") is None and given.get("post_processor") is None
                     and split.get("type") == "ByteLevel" and split.get("use_regex", True)
                     and not split.get("add_prefix_space", True)
                     and given["model"].get("type") == "BPE"
                     and all(not a["lstrip"] and not a["rstrip"] and not a["single_word"]
                             and " " not in a["content"] for a in added))

    def parts(self, text: str) -> list[str]:
        """Segments whose own tokens, one after another, are those of the text."""
        return segments(text, self.cuts)

    def counts(self, texts: list[str]) -> np.ndarray:
        got = self.tok.encode_batch_fast(texts, add_special_tokens=False)
        return np.fromiter((len(e.ids) for e in got), np.int64, len(texts))

    def token_bytes(self) -> tuple[np.ndarray, np.ndarray]:
        """(bounds, content): the bytes of each id, byte-level decoded."""
        table = byte_characters()
        parts = [b""] * self.tok.get_vocab_size()
        for token, i in self.tok.get_vocab().items():
            parts[i] = (bytes(table[c] for c in token) if all(c in table for c in token) else token.encode())
        return _packed(parts)

    def spans(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(tokens per text, ids, offsets): offsets are (begin, end) in characters of the own text."""
        got = self.tok.encode_batch(texts, add_special_tokens=False)
        ids = [e.ids for e in got]
        offsets = chain.from_iterable(chain.from_iterable(e.offsets for e in got))
        return (np.fromiter(map(len, ids), np.int64, len(ids)), np.fromiter(chain.from_iterable(ids), np.int64),
                np.fromiter(offsets, np.int64).reshape(-1, 2))


class Pieces:
    """A sentencepiece model; its text is the given one after the space that the model adds."""

    def __init__(self, file: TokenizerFile) -> None:
        from sentencepiece import SentencePieceProcessor, sentencepiece_model_pb2

        self.sp = SentencePieceProcessor(model_proto=file.content)
        model = sentencepiece_model_pb2.ModelProto()
        model.ParseFromString(file.content)
        rule = model.normalizer_spec
        self.pieces = [self.sp.id_to_piece(i) for i in range(self.sp.get_piece_size())]
        # texts pass unchanged, and no piece goes on beyond a space after another character
        self.cuts = (rule.name == "identity" and not rule.precompiled_charsmap and rule.add_dummy_prefix
                     and rule.escape_whitespaces and not rule.remove_extra_whitespaces
                     and not model.trainer_spec.treat_whitespace_as_suffix
                     and not any(MARK in p.lstrip(MARK) for p in self.pieces)
                     and model.trainer_spec.model_type == model.trainer_spec.BPE)

    def parts(self, text: str) -> list[str]:
        """Segments whose own tokens, one after another, are those of the text; each gets its space anew."""
        return [s[1:] for s in segments(f" {text}", True)] if self.cuts else [text]

    def counts(self, texts: list[str]) -> np.ndarray:
        return np.fromiter(map(len, self.sp.encode(texts, num_threads=1)), np.int64, len(texts))

    def token_bytes(self) -> tuple[np.ndarray, np.ndarray]:
        """(bounds, content): the bytes of each id; ``<0xHH>`` is a byte, U+2581 a space."""
        return _packed([bytes([int(p[3:5], 16)]) if self.sp.is_byte(i) else p.replace(MARK, " ").encode()
                        for i, p in enumerate(self.pieces)])

    def is_byte(self) -> np.ndarray:
        return np.array([self.sp.is_byte(i) for i in range(len(self.pieces))])

    def spans(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(tokens per text, ids, offsets): offsets are (begin, end) in bytes of the own text."""
        pieces = [p.pieces for p in self.sp.encode(texts, return_type="proto", num_threads=1)]
        n = np.fromiter(map(len, pieces), np.int64, len(pieces))
        flat = chain.from_iterable(map(_PIECE, chain.from_iterable(pieces)))
        of = np.fromiter(flat, np.int64, 3 * int(n.sum())).reshape(-1, 3)
        return n, of[:, 0], of[:, 1:]
