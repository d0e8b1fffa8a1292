"""Token ids of a lower-casing word-level BPE vocabulary, by the ``tokenizers`` library's model.

The library's normalizer and splitter are followed step by step, so that each distinct
word is handed to the library's model once and remembered.
"""

from __future__ import annotations

import unicodedata

import regex

from panelith.llm.bpe import LETTERS, NUMBERS, SPACES, Remembered, byte_characters, splitter
from panelith.llm.common import CACHES

#: The splitting pattern of the vocabulary file, a fixed value.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
NARROW = f"[{LETTERS}]+|[{NUMBERS}]|'(?:s|t|re|ve|m|ll|d)|[^{SPACES}{LETTERS}{NUMBERS}]+"


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WordTokens:
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        self.tokenizer, self.model = tokenizer, tokenizer.model
        self.added = {t.content: i for i, t in tokenizer.get_added_tokens_decoder().items()}
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        self.words = splitter(PATTERN, NARROW)
        self.characters = byte_characters()
        self.word = Remembered(self.model_ids, 64).__getitem__
        self.assigned: set[str] = set()

    def model_ids(self, word: str) -> bytes:
        """The ids of one word as little-endian unsigned 32-bit values."""
        mapped = "".join(map(self.characters.__getitem__, word.encode()))
        return b"".join(t.id.to_bytes(4, "little") for t in self.model.tokenize(mapped))

    def unsure(self, text: str) -> bool:
        """Whether a character may be newer than one of the Unicode tables in use, which then split differently."""
        new = set(text) - self.assigned
        found = {c for c in new if unicodedata.category(c) == "Cn"}
        self.assigned |= new - found
        return bool(found)

    def part(self, text: str) -> bytes:
        if not text.isascii():
            if self.unsure(text):
                return b"".join(i.to_bytes(4, "little") for i in self.tokenizer.encode(text, add_special_tokens=False).ids)
            # One character at a time: lower() alone would turn a final capital sigma into another letter.
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        return b"".join(map(self.word, self.words(text.lower())))

    def encode(self, text: str) -> bytes:
        """All ids of a text, four bytes each."""
        if self.cut is None or not any(token in text for token in self.added):
            return self.part(text)
        parts = self.cut.split(text)
        return b"".join(self.added[x].to_bytes(4, "little") if i % 2 else self.part(x) for i, x in enumerate(parts))


_held: dict[str, WordTokens] = {}
CACHES.append(_held)


def codec(path: str) -> WordTokens:
    if path not in _held:
        _held[path] = WordTokens(path)
    return _held[path]
