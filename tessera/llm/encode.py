"""Token ids of whole texts, chunk by chunk with a bounded cache, exactly as the tokenizers library gives them."""

from __future__ import annotations

import json
from collections.abc import Callable

import regex
from tokenizers import Tokenizer

#: Tokenizers of this kind lower-case, drop white space, and split as follows (fixed values of word_bpe_49k.json).
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def byte_letters() -> dict[int, str]:
    """The printable letter for each byte in byte-level vocabularies: itself if printable, else the next from U+0100."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Kept(dict):
    """A dictionary that makes what it lacks."""

    def __init__(self, make: Callable):
        super().__init__()
        self.make = make

    def __missing__(self, key):
        value = self[key] = self.make(key)
        return value


class WordEncoder:
    """Encodes UTF-8 texts with a tokenizer that drops white space, so that ids of a text are those of its chunks in a row.

    Chunks are what ASCII white space parts. No match of the pattern, no special token and no composed character
    reaches over it, hence the parts are independent. Each chunk is encoded once and kept; the cache is emptied at
    `most` chunks. Plain Latin-1 chunks are split here and their pieces passed to the library's BPE model directly,
    which are kept up to `most_pieces`; all others go through its whole chain.
    """

    def __init__(self, path: str, most: int = 500_000, most_pieces: int = 200_000):
        self.tokenizer = Tokenizer.from_file(path)
        kinds = [x["pattern"]["Regex"] for x in json.loads(self.tokenizer.to_str())["pre_tokenizer"]["pretokenizers"] if x["type"] == "Split"]
        if kinds != [WORD_PATTERN]:
            raise ValueError("this tokenizer keeps white space or splits in another way")
        self.model, self.most, self.cache = self.tokenizer.model, most, Kept(self.chunk)
        self.most_pieces, self.pieces = most_pieces, Kept(self.piece)
        self.letters, self.pattern = byte_letters(), regex.compile(WORD_PATTERN)
        self.odd = regex.compile(r"[^\x00-\xff]|[\x1c-\x1f\x85\xa0]|<\|")
        size = self.tokenizer.get_vocab_size()
        self.numbers = [i.to_bytes(4, "little") for i in range(size)]

    def piece(self, piece: str) -> bytes:
        """Ids of one match of the pattern, as little-endian unsigned 32-bit numbers."""
        if not (piece.isascii() and piece.isprintable()):
            piece = piece.encode().decode("latin-1").translate(self.letters)
        return b"".join([self.numbers[t.id] for t in self.model.tokenize(piece)])

    def chunk(self, chunk: bytes) -> bytes:
        """Ids of one chunk as little-endian unsigned 32-bit numbers."""
        text = chunk.decode("utf-8", "replace")
        if text.isascii() and text.isalpha():
            return self.pieces[text.lower()]
        if self.odd.search(text):
            return b"".join([self.numbers[i] for i in self.tokenizer.encode(text, add_special_tokens=False).ids])
        return b"".join([self.pieces[x] for x in self.pattern.findall(text.lower())])

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit numbers."""
        if len(self.cache) > self.most:
            self.cache.clear()
        if len(self.pieces) > self.most_pieces:
            self.pieces.clear()
        look = self.cache.__getitem__
        return [b"".join(map(look, x.split())) for x in texts]


_ENCODERS: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """The encoder of this process; Python workers are used again, and so is its cache."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]
