"""Texts cut into short stretches that a byte-level and a piece tokenizer encode alone as they do inside the text.

A stretch begins at a space behind a character that isn't white space, at punctuation or a line's end behind a Latin letter,
and at a letter behind a single line's end. The byte-level pattern ends a token at each of these places and looks only
forward; no piece of the other vocabulary spans one (PieceWords makes sure of that). So a text's ids are its stretches' ids
in a row, Arrow numbers the different stretches and each is encoded once. Tests hold this against whole texts.
"""

from __future__ import annotations

import os
from itertools import compress
from string import punctuation

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .tokens import _gather, _pool

BYTE_VOCABULARY, PIECE_VOCABULARY = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Stretches of one generation that a worker remembers; two generations are kept, so common ones outlive rare ones.
REMEMBERED = 200_000
#: A space, if any, and letters that both tokenizers take for letters.
LETTERS = "^ [A-Za-zÀ-ÖØ-öø-ÿ]+$"
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_BREAK = np.zeros(256, bool)
_BREAK[[10, *map(ord, punctuation)]] = True
_BLANK = np.zeros(256, bool)
_BLANK[[*range(9, 14), *range(28, 33)]] = True
_encoders: dict = {}


def vocabulary_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def encoder(kind: type, path: str, remembered: int = REMEMBERED):
    """One encoder for each kind, file and Python worker, kept between tasks."""
    if (kind, path, remembered) not in _encoders:
        _encoders[kind, path, remembered] = kind(path, remembered)
    return _encoders[kind, path, remembered]


def _blank_before(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether the character before each place is, or may be, white space; where bytes could be the end of a wide one they count as such."""
    a, b, c = (data[np.maximum(at - k, 0)] for k in (1, 2, 3))
    wide = (c >= 0xE1) & (c <= 0xE3) & ((b == 0x80) | (b == 0x81) | (b == 0x9A) | (b == 0xA0))
    return _BLANK[a] | ((b == 0xC2) & ((a == 0x85) | (a == 0xA0))) | wide


def _latin_before(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    a, b = data[np.maximum(at - 1, 0)], data[np.maximum(at - 2, 0)]
    return _LETTER[a] | ((b == 0xC3) & (a >= 0x80) & (a != 0x97) & (a != 0xB7))


def starts(data: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Where stretches begin in the bytes of texts laid end to end; first: where each text that isn't empty begins."""
    space = np.flatnonzero(data == 32)
    space = space[~_blank_before(data, space)]
    mark = np.flatnonzero(_BREAK[data])
    mark = mark[_latin_before(data, mark)]
    line = np.flatnonzero(data[:-1] == 10) + 1
    line = line[_LETTER[data[line]] & ~_blank_before(data, line - 1) & (line > 1)]
    found = np.zeros(len(data) + 1, bool)
    for at in (space, mark, line):
        found[at] = True
    # A text's second byte is no start by what another text's end holds: the rules look back up to three bytes.
    for k in (1, 2):
        near = first + k
        near = near[near < len(data)]
        doubtful = near[found[near]]
        own = np.searchsorted(first, doubtful, side="right") - 1
        found[doubtful[_outside(data, doubtful, first[own])]] = False
    found[first] = True
    return np.flatnonzero(found[:-1])


def _outside(data: np.ndarray, at: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Starts so near their text's beginning that the rule, asked within the text alone, would say no."""
    a = data[at - 1]
    space = (data[at] == 32) & ~_BLANK[a] & (a < 0x80)
    mark = _BREAK[data[at]] & (_LETTER[a] | ((at - text >= 2) & (data[np.maximum(at - 2, 0)] == 0xC3)))
    line = (a == 10) & _LETTER[data[at]] & (at - text >= 2) & ~_BLANK[data[np.maximum(at - 2, 0)]]
    return ~(space | mark | line)


def cut(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All stretches of an Arrow column of texts in a row, as binary, and how many each text has (null and empty: none)."""
    texts = pc.fill_null(texts, "")
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pa.concat_arrays([texts.cast(pa.large_string()), pa.array([], pa.large_string())])  # offsets from 0
    ends = np.frombuffer(texts.buffers()[1], np.int64)[: len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
    ends = ends - ends[0]
    filled = np.flatnonzero(np.diff(ends))
    if not len(data):
        return pa.array([], pa.binary()), np.zeros(len(texts), np.int64)
    at = starts(data, ends[:-1][filled])
    offsets = np.append(at, len(data)).astype(np.int32)
    words = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])
    return words, np.diff(np.searchsorted(at, ends))


class _Words:
    """Ids of different stretches by a tokenizer, remembered for two generations."""

    size: int
    #: Length of each id's bytes, and which ids begin with a space.
    lengths: np.ndarray
    spaced: np.ndarray

    def __init__(self, remembered: int = REMEMBERED):
        self.remembered = remembered
        self.words: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}

    def known(self, words: list[bytes]) -> list[bytes]:
        """The ids of different stretches as little-endian unsigned 32-bit integers. A full generation becomes the older one."""
        unknown = [w for w in words if w not in self.words]
        if unknown:
            if len(self.words) > self.remembered:
                self.words, self.older, unknown = {}, self.words, words
            again = [w for w in unknown if w in self.older]
            self.words.update(zip(again, map(self.older.__getitem__, again)))
            self._learn([w for w in unknown if w not in self.words])
        return list(map(self.words.__getitem__, words))

    def _learn(self, words: list[bytes]) -> None:
        fine = pc.match_substring_regex(pa.array(words, pa.binary()).cast(pa.string()), LETTERS).to_pylist()
        self._singly([w for w, f in zip(words, fine) if not f])
        letters = list(compress(words, fine))
        for at in range(0, len(letters), 512):
            part = letters[at : at + 512]
            ids = self._row(b"".join(part))
            begins = np.flatnonzero(self.spaced[ids])
            if len(begins) == len(part):
                raw = ids.astype("<u4").tobytes()
                self.words.update(zip(part, (raw[4 * a : 4 * b] for a, b in zip(begins.tolist(), [*begins[1:].tolist(), len(ids)]))))
            else:
                self._singly(part)

    def _row(self, words: bytes) -> np.ndarray:
        raise NotImplementedError

    def _singly(self, words: list[bytes]) -> None:
        raise NotImplementedError

    def column(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.DictionaryArray, np.ndarray]:
        """Ids of all texts in a row, how many each text has, how many each stretch has, the numbered stretches, and how many of these each text has."""
        words, n_words = cut(texts)
        numbered = words.dictionary_encode()
        ids, size = _pool(self.known(numbered.dictionary.to_pylist()))
        ids, size = _gather(ids, size, numbered.indices.to_numpy())
        upto = np.concatenate([[0], np.cumsum(size, dtype=np.int64)])[np.cumsum(n_words)]
        return ids, np.diff(upto, prepend=0), size, numbered, n_words


class ByteWords(_Words):
    """The byte-level tokenizer; strings of special tokens are plain text."""

    def __init__(self, path: str, remembered: int = REMEMBERED):
        super().__init__(remembered)
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        # Spaces before letters need no pattern.
        self.of_letters = Tokenizer.from_file(path)
        self.of_letters.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split(" ", "merged_with_next"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        # The vocabulary writes each byte as one character, so a token has as many bytes as characters; a space is Ġ.
        names = sorted((i, t) for t, i in self.tokenizer.get_vocab(with_added_tokens=False).items())
        self.size = names[-1][0] + 1
        self.lengths, self.spaced = np.zeros(self.size, np.int64), np.zeros(self.size, bool)
        for i, t in names:
            self.lengths[i], self.spaced[i] = len(t), t.startswith("Ġ")

    def _row(self, words: bytes) -> np.ndarray:
        return np.array(self.of_letters.encode_batch_fast([words.decode()], add_special_tokens=False)[0].ids, np.uint32)

    def _singly(self, words: list[bytes]) -> None:
        found = self.tokenizer.encode_batch_fast([w.decode() for w in words], add_special_tokens=False)
        self.words.update(zip(words, (np.array(e.ids, "<u4").tobytes() for e in found)))


class PieceWords(_Words):
    """The piece tokenizer, which writes a space as U+2581 and puts one before a text.

    A stretch whose pieces don't give its bytes has no ids but one that no piece has: `size`.
    """

    def __init__(self, path: str, remembered: int = REMEMBERED):
        super().__init__(remembered)
        import sentencepiece

        self.pieces = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = self.pieces.get_piece_size()
        names = [self.pieces.id_to_piece(i) for i in range(self.size)]
        plain = [not (self.pieces.is_byte(i) or self.pieces.is_control(i) or self.pieces.is_unknown(i)) for i in range(self.size)]
        self.bytes = [(t.replace("▁", " ").encode() if p else bytes([int(t[3:5], 16)]) if self.pieces.is_byte(i) else b"") for i, (t, p) in enumerate(zip(names, plain))]
        self.bytes.append(b"")
        self.lengths = np.array([len(b) for b in self.bytes])
        self.spaced = np.array([b[:1] == b" " for b in self.bytes])
        for t in compress(names, plain):
            if "▁" in t.lstrip("▁") or "\n" in t or any(a.isalpha() and b in punctuation for a, b in zip(t, t[1:])):
                raise ValueError(f"texts can't be cut for a vocabulary with the piece {t!r}")

    def _row(self, words: bytes) -> np.ndarray:
        return np.array(self.pieces.encode(words[1:].decode(), num_threads=1), np.uint32)

    def _singly(self, words: list[bytes]) -> None:
        # A stretch without a space goes behind a line's end, which is two pieces: the space put before a text, and a byte.
        led = [w[:1] != b" " for w in words]
        for w, l, ids in zip(words, led, self.pieces.encode([f"\n{w.decode()}" if l else w[1:].decode() for w, l in zip(words, led)], num_threads=1)):
            ids = ids[2:] if l else ids if len(w) > 1 else [self.pieces.piece_to_id("▁")]
            if b"".join(map(self.bytes.__getitem__, ids)) != w:
                ids = [self.size]
            self.words[w] = np.array(ids, "<u4").tobytes()
