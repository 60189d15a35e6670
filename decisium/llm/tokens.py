"""Token ids as bytes, for texts that share most of their words.

``WordPieces`` gives exactly the ids of the ``word_bpe_49k`` tokenizer but asks
the BPE model only once for each word: a text is split at ASCII white space, and
a word's ids are kept as little-endian bytes ready to be joined. The tokenizer
drops white space and merges never cross it, so a text's ids are the ids of its
words in order.
"""

from __future__ import annotations

import os
from array import array

import regex

#: Words that one worker remembers; beyond it the memory is started afresh.
REMEMBERED_WORDS = 700_000

#: Words of these characters alone are lower-cased and composed one by one; others go to the tokenizer.
_PLAIN = regex.compile(rb"[\x21-\x7e]+|(?:[\x21-\x7e]|\xc3[\x80-\xbf])+")
_PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")


def _byte_letters() -> dict[int, str]:
    """The visible character that stands for each byte in byte-level vocabularies."""
    kept = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(kept)]
    return {b: chr(b) for b in kept} | {b: chr(256 + i) for i, b in enumerate(rest)}


class WordPieces:
    """``ids(text)`` as bytes; ``typecode`` is ``I`` (32 bits) or ``H`` (16 bits)."""

    def __init__(self, path: str, typecode: str = "I", specials_are_text: bool = False):
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = specials_are_text
        self.model = self.tokenizer.model
        self.typecode = typecode
        self.letters = str.maketrans({chr(b): c for b, c in _byte_letters().items()})
        self.words: dict[bytes, bytes] = {}
        self.pieces: dict[str, bytes] = {}

    def _pack(self, ids: list[int]) -> bytes:
        return array(self.typecode, ids).tobytes()

    def _piece(self, piece: str) -> bytes:
        found = self.pieces.get(piece)
        if found is None:
            spelt = piece.encode().decode("latin-1").translate(self.letters)
            found = self.pieces[piece] = self._pack([t.id for t in self.model.tokenize(spelt)])
        return found

    def _word(self, word: bytes) -> bytes:
        if b"<|" in word or not _PLAIN.fullmatch(word):
            return self._pack(self.tokenizer.encode(word.decode("utf-8", "replace"), add_special_tokens=False).ids)
        low = word.decode().lower()
        if low.isalpha():
            return self._piece(low)
        core = low.rstrip(".,!|%&$#*")
        if core.isalpha():
            return self._piece(core) + self._piece(low[len(core) :])
        return b"".join(map(self._piece, _PIECES.findall(low)))

    def ids(self, text: bytes) -> bytes:
        split = text.split()
        words = self.words
        try:
            return b"".join(map(words.__getitem__, split))
        except KeyError:
            pass
        if len(words) > REMEMBERED_WORDS:
            words.clear()
            self.pieces.clear()
        for word in split:
            if word not in words:
                words[word] = self._word(word)
        return b"".join(map(words.__getitem__, split))


_loaded: dict[tuple, WordPieces] = {}


def word_pieces(path: str, typecode: str = "I", specials_are_text: bool = False) -> WordPieces:
    """One ``WordPieces`` for all tasks of a worker process."""
    key = (path, typecode, specials_are_text)
    if key not in _loaded:
        _loaded[key] = WordPieces(path, typecode, specials_are_text)
    return _loaded[key]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def text_bytes(column):
    """The texts of an Arrow column as bytes; null is the empty text."""
    import pyarrow as pa

    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [v or b"" for v in column.cast(kind).to_pylist()]
