"""Token ids of whole texts, put together from remembered ids of their chunks.

A text is cut before every single space that stands between two characters that are not
white space. Both kinds of vocabulary used here put a token boundary there: the byte-level
pattern begins a new match at such a space, and no piece of the other vocabulary holds a
space mark after another character. So a chunk (mostly one word) has the same ids in every
text and is encoded once while it is remembered; a text of any length goes chunk by chunk.
Strings of special tokens inside a text are ordinary text.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Callable, Iterator

import numpy as np

_CACHED, _CACHED_CHARS = 400_000, 64
_NEAR_SPACE = re.compile(r"\s\x20|\x20\s")
_CUT = re.compile(r"(?<=\S)\x20(?=\S)")


def chunks(text: str) -> list[str]:
    """The text without the spaces it is cut at."""
    if _NEAR_SPACE.search(text) or text.startswith(" ") or text.endswith(" "):
        return _CUT.split(text)
    return text.split(" ")


class ChunkIds:
    """Packed little-endian 32-bit ids of chunks, remembered in two generations: what is used again stays."""

    def __init__(self, encode_many: Callable[[list[str]], list[bytes]]):
        self.encode_many, self.young, self.old = encode_many, {}, {}

    def join(self, words: list[str]) -> bytes:
        """The ids of all words, end to end."""
        found = list(map(self.young.get, words))
        if None in found:
            missing = list({w for w, f in zip(words, found) if f is None})
            fresh = {w: f for w in missing if (f := self.old.get(w)) is not None}
            unknown = [w for w in missing if w not in fresh]
            for k in range(0, len(unknown), 1000):
                fresh.update(zip(unknown[k:k + 1000], self.encode_many(unknown[k:k + 1000])))
            found = [fresh[w] if f is None else f for w, f in zip(words, found)]
            if len(self.young) > _CACHED:
                self.young, self.old = {}, self.young
            if max(map(len, missing)) > _CACHED_CHARS:
                fresh = {w: f for w, f in fresh.items() if len(w) <= _CACHED_CHARS}
            self.young.update(fresh)
        return b"".join(found)


def byte_characters() -> list[str]:
    """The character a byte-level vocabulary writes for each byte: printable ones for themselves, the rest from 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(rest)) for b in range(256)]


class ByteLevelIds:
    """Ids by a byte-level vocabulary file of the tokenizers library.

    Its merges are run by tiktoken, which takes the vocabulary as ranks (the order of its ids) and
    is faster on many short chunks; very long chunks go to the library itself. Both give the same ids.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.lengths = np.array(list(map(len, self.token_bytes())), np.int64)
        ranks = {token: i for i, token in enumerate(self.token_bytes()) if token}
        self.encoding = tiktoken.Encoding("byte_level", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.spaced, self.bare = ChunkIds(self._many), ChunkIds(lambda words: [self._whole(w) for w in words])

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _many(self, words: list[str]) -> list[bytes]:
        """The ids of words with a space before each: encoded end to end and parted where the bytes of a word end."""
        if max(map(len, words)) > _CACHED_CHARS:
            long = {w for w in words if len(w) > _CACHED_CHARS}
            rest = [w for w in words if w not in long]
            known = dict(zip(rest, self._many(rest) if rest else ()))
            return [self._whole(" " + w) if w in long else known[w] for w in words]
        ids = np.array(self.encoding.encode_ordinary(" " + " ".join(words)), "<u4")
        word_ends = np.cumsum(np.fromiter((1 + len(w.encode()) for w in words), np.int64, len(words)))
        cuts = (4 * (np.searchsorted(np.cumsum(self.lengths[ids]), word_ends) + 1)).tolist()
        packed = ids.tobytes()
        return [packed[a:b] for a, b in zip([0, *cuts], cuts)]

    def ids(self, text: str, space: bool = False, words: list[str] | None = None) -> bytes:
        """Packed ids of the text, with ``space`` of a space and the text; ``words`` are its chunks, where they are known."""
        if not text and not space:
            return b""
        words = words or chunks(text)
        return self.spaced.join(words) if space else self.bare.join(words[:1]) + self.spaced.join(words[1:])

    def token_bytes(self) -> list[bytes]:
        """The bytes of every token id (none for special tokens)."""
        byte = {c: b for b, c in enumerate(byte_characters())}
        out = [b""] * self.tokenizer.get_vocab_size(with_added_tokens=True)
        for token, i in self.tokenizer.get_vocab(with_added_tokens=False).items():
            out[i] = bytes(map(byte.__getitem__, token)) if set(token) <= byte.keys() else b""
        return out


class PieceIds:
    """Ids by a sentencepiece model, which adds the space before a text itself."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.spaced = ChunkIds(lambda words: [array("I", x).tobytes() for x in self.model.encode(words, num_threads=1)])

    def ids(self, text: str, words: list[str] | None = None) -> bytes:
        if "▁" in text:  # the model's own mark of a space
            return np.array(self.model.encode(text), "<u4").tobytes()
        return self.spaced.join(words or chunks(text)) if text else b""

    def token_bytes(self) -> list[bytes]:
        model = self.model
        return [bytes([int(model.id_to_piece(i)[3:5], 16)]) if model.is_byte(i) else model.id_to_piece(i).replace("▁", " ").encode() for i in range(model.get_piece_size())]


_open: dict[tuple[type, str], object] = {}


def opened(kind: type, path: str):
    """One vocabulary of each file in a Python process."""
    if (kind, path) not in _open:
        _open[kind, path] = kind(path)
    return _open[kind, path]


def spread(values: np.ndarray, sizes: np.ndarray, which: np.ndarray) -> np.ndarray:
    """The entries ``which``, end to end, of a table whose entries lie end to end in ``values``."""
    take = sizes[which]
    shift = (np.cumsum(sizes) - sizes)[which] - (np.cumsum(take) - take)
    return values[np.repeat(shift, take) + np.arange(int(take.sum()))]


def parts(text: str, max_chars: int) -> Iterator[str]:
    """A text in parts of about ``max_chars``, cut at chunk spaces (which are left out between parts)."""
    at = 0
    while len(text) - at > max_chars:
        cut = _CUT.search(text, at + max_chars)
        if cut is None:
            break
        yield text[at:cut.start()]
        at = cut.end()
    yield text[at:]
