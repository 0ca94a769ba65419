"""Token ids of whole texts, by a public tokenizer file."""

from __future__ import annotations

import os
from collections.abc import Iterator
from itertools import compress
from string import punctuation

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: The vocabulary file of the queries; operators take another path as a parameter.
VOCABULARY = "word_bpe_49k.json"
#: Every document ends with this id.
END_ID = 1
#: Words of these letters are cut from the punctuation behind them, lower-cased and learnt together: each letter has
#: one lower-case form of as many bytes.
PLAIN, LOWER = "^[A-Za-zÀ-ÖØ-öø-ÿ]+$", "^[a-zß-öø-ÿ]+$"
#: Words of one generation that a worker remembers; two generations are kept, so common words outlive rare ones.
REMEMBERED = 250_000
_encoders: dict[str, WordEncoder] = {}


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def encoder(path: str) -> WordEncoder:
    """One encoder for each file and Python worker, kept between tasks."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def _cut(words: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Stems, and the bytes behind them as little-endian integers; words that aren't plain are their own stems.

    Only up to seven bytes are cut off; before more, the whole word is its stem.
    """
    bare = pc.utf8_rtrim(words, characters=punctuation)
    length = pc.binary_length(words).to_numpy() - pc.binary_length(bare).to_numpy()
    plain = pc.and_(pc.match_substring_regex(bare, PLAIN), pa.array(length < 8))
    length = np.where(plain.to_numpy(zero_copy_only=False), length, 0)
    raw = np.frombuffer(words.buffers()[2] or b"", np.uint8)
    end = np.frombuffer(words.buffers()[1] or b"", np.int32)[words.offset + 1 : words.offset + 1 + len(words)]
    tails = np.zeros(len(words), np.uint64)
    for k in range(int(length.max(initial=0))):
        at = np.flatnonzero(length > k)
        tails[at] |= raw[end[at] - length[at] + k].astype(np.uint64) << np.uint64(8 * k)
    return pc.if_else(plain, pc.utf8_lower(bare), words), tails


def _pool(raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All ids in a row and how many each entry has."""
    return np.frombuffer(b"".join(raw), "<u4"), np.fromiter(map(len, raw), np.int32, len(raw)) // 4


def _gather(ids: np.ndarray, size: np.ndarray, index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids of entries in the order of index, and how many each has; size: of the entries that ids hold in a row."""
    n = size[index]
    ends = np.cumsum(n, dtype=np.int64)
    place = np.int32 if max(len(ids), int(ends[-1]) if len(ends) else 0) < 1 << 31 else np.int64
    shift = ((np.cumsum(size, dtype=np.int64) - size)[index] - ends + n).astype(place)
    return ids[np.repeat(shift, n) + np.arange(ends[-1] if len(ends) else 0, dtype=place)], n


class WordEncoder:
    """Encodes texts word by word with a tokenizer that drops white space, and remembers the words' ids.

    The tokenizer first cuts at white space, so a text's ids are its words' ids in a row; likewise a word of
    letters and the punctuation after it are cut apart and letters are lower-cased. Tests hold this against
    encoding whole texts.
    """

    def __init__(self, path: str, remembered: int = REMEMBERED):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        # Lower-case letters between spaces need no normalizing and no pattern. The model is the same, held once.
        self.of_letters = Tokenizer(self.tokenizer.model)
        self.of_letters.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.ends = np.zeros(self.size, bool)
        for token, i in self.tokenizer.get_vocab().items():
            self.ends[i] = token.endswith("</w>")
        self.remembered = remembered
        self.words: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}

    def encode(self, text: bytes | None) -> bytes:
        """The text's ids as little-endian unsigned 32-bit integers; none for null or empty."""
        return next(self.encode_all([text]))

    def encode_all(self, texts: list[bytes | None]) -> Iterator[bytes]:
        """encode() of many texts."""
        ids, n = self.encode_column(pa.array(texts, pa.binary()).cast(pa.string()))
        ends = np.cumsum(n)
        for a, b in zip((ends - n).tolist(), ends.tolist()):
            yield ids[a:b].tobytes()

    def encode_column(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts of an Arrow column in a row, and how many each text has.

        Arrow numbers the different words and cuts them into stem and tail, so Python sees each stem of the column once.
        """
        words = pc.ascii_split_whitespace(texts)
        n_words = pc.fill_null(pc.list_value_length(words), 0).to_numpy(zero_copy_only=False)
        numbered = words.flatten().dictionary_encode()
        stems, tails = _cut(numbered.dictionary)
        stems = stems.dictionary_encode()
        tail, tail_of = np.unique(tails, return_inverse=True)
        known = self._known(stems.dictionary.cast(pa.binary()).to_pylist())
        ids, size = _pool([*known, *self._known([int(t).to_bytes(8, "little").rstrip(b"\0") for t in tail])])
        parts = np.stack([stems.indices.to_numpy(), tail_of.astype(np.int32) + np.int32(len(known))], axis=1).ravel()
        ids, part_size = _gather(ids, size, parts)
        ids, size = _gather(ids, part_size.reshape(-1, 2).sum(axis=1, dtype=np.int32), numbered.indices.to_numpy())
        upto = np.concatenate([[0], np.cumsum(size, dtype=np.int64)])[np.cumsum(n_words)]
        return ids, np.diff(upto, prepend=0)

    def _known(self, words: list[bytes]) -> list[bytes]:
        """The ids of different words. A full generation becomes the older one, and then all these words are added."""
        unknown = [w for w in words if w not in self.words]
        if unknown:
            if len(self.words) > self.remembered:
                self.words, self.older, unknown = {}, self.words, words
            again = [w for w in unknown if w in self.older]
            self.words.update(zip(again, map(self.older.__getitem__, again)))
            self._learn([w for w in unknown if w not in self.words])
        return list(map(self.words.__getitem__, words))

    def _learn(self, words: list[bytes]) -> None:
        fine = pc.match_substring_regex(pa.array(words, pa.binary()).cast(pa.string()), LOWER).to_pylist()
        self._learn_singly([w for w, f in zip(words, fine) if not f])
        self._learn_letters(list(compress(words, fine)))

    def _learn_letters(self, stems: list[bytes]) -> None:
        """Words of letters alone: encoded in one go and cut where a token ends a word."""
        for at in range(0, len(stems), 256):
            part = stems[at : at + 256]
            ids = np.array(self.of_letters.encode_batch_fast([b" ".join(part).decode()], add_special_tokens=False)[0].ids, np.uint32)
            ends = np.flatnonzero(self.ends[ids]) + 1
            if len(ends) == len(part):
                raw = ids.astype("<u4").tobytes()
                self.words.update(zip(part, (raw[4 * a : 4 * b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist()))))
            else:
                self._learn_singly(part)

    def _learn_singly(self, words: list[bytes]) -> None:
        found = self.tokenizer.encode_batch_fast([w.decode() for w in words], add_special_tokens=False)
        self.words.update(zip(words, (np.array(e.ids, "<u4").tobytes() for e in found)))
