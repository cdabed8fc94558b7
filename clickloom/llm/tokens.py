"""Token ids of whole texts with the public tokenizers, fast by encoding each distinct chunk once.

A text is cut only where the tokenizer cuts too: between a character that is
no white space and a following space or line end.  Texts with any other white
space, or with the string of an added token, are encoded in one piece, so ids
always equal those of the whole text.
"""

from __future__ import annotations

import os
import re
from array import array

import numpy as np

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Chunks of one generation in a worker's memory (two are kept), and the longest chunk worth keeping.
CACHED_CHUNKS = 600_000
CACHED_LENGTH = 64

# White space other than the space and the line end, in full
_odd_space = re.compile("[\t\x0b\x0c\r\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
_with_space = re.compile(r"[ \n]*[^ \n]+|[ \n]+")
_without_space = re.compile(r"[^ \n]+")
# The two vocabularies' own patterns, written out for texts of Latin-1 characters
_letter, _digit = "A-Za-z\u00aa\u00b5\u00ba\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff", "0-9\u00b2\u00b3\u00b9\u00bc\u00bd\u00be"
_ends = "'s|'t|'re|'ve|'m|'ll|'d"
_latin_with_space = re.compile(f" ?[{_letter}]+|{_ends}| ?[{_digit}]+| ?[^ \\n{_letter}{_digit}]+|[ \\n]+(?![^ \\n])|[ \\n]+")
_latin_without_space = re.compile(f"[{_letter}]+|{_ends}|[{_digit}]|[^ \\n{_letter}{_digit}]+")
_not_latin = re.compile("[^\x00-\xff]")
_special = re.compile("[\t\x0b\x0c\r\x1c-\x1f\x85\xa0\u0100-\U0010ffff]")  # odd spaces and what is not Latin, found in one search
_open: dict[str, "Encoder"] = {}


def _byte_letters() -> dict[int, str]:
    """The character by which byte-level vocabularies write each byte: itself where it prints, else one from 256 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class Encoder(dict):
    """Ids of texts as little-endian unsigned 32-bit bytes; as a dict, those of the chunks met lately.

    A full dict becomes the older generation, from which chunks met again return
    without being encoded again.
    """

    def __init__(self, file: str):
        from tokenizers import Tokenizer

        path = file
        if not os.path.isabs(file):
            import public_tokenizers

            path = public_tokenizers.path(file)
        self.tokenizer = Tokenizer.from_file(path)
        # strings that the tokenizer takes out of a text before its pattern; in any case, as a normalizer may change it
        added = [re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.added = re.compile("|".join(added) or r"(?!)", re.I)
        self.model = self.tokenizer.model
        # byte-level vocabularies keep the white space, word vocabularies drop it
        self.byte_level = bool(self.tokenizer.encode(" ", add_special_tokens=False).ids)
        self.pattern = _latin_with_space if self.byte_level else _latin_without_space
        self.letters = _byte_letters()
        self.bytes = [self.letters[b] for b in range(256)]
        self.older: dict[str, bytes] = {}

    def _whole(self, text: str) -> bytes:
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _piece(self, chunk: str) -> bytes:
        """A chunk that the vocabulary's pattern leaves whole goes straight to the merges of the model."""
        rest = chunk[1:] if self.byte_level and chunk[0] == " " else chunk
        if rest.isalpha() and (rest.isascii() or max(rest) <= "\xff"):  # the most frequent kind needs no pattern
            if rest.isascii():  # letters that stand for themselves
                return self._merged((rest if rest is chunk else self.letters[0x20] + rest) if self.byte_level else rest.lower())
            chunk = chunk if self.byte_level else chunk.lower()
            return self._merged("".join([self.bytes[b] for b in chunk.encode()]))
        if _not_latin.search(chunk):
            return self._whole(chunk)
        if not self.byte_level:
            chunk = chunk.lower()
        if not self.pattern.fullmatch(chunk):
            return self._whole(chunk)
        if chunk.isascii() and chunk.isprintable():
            chunk = chunk.replace(" ", self.letters[0x20])
        else:
            chunk = chunk.encode().decode("latin-1").translate(self.letters)
        return self._merged(chunk)

    def _merged(self, letters: str) -> bytes:
        return array("I", [t.id for t in self.model.tokenize(letters)]).tobytes()

    def __missing__(self, chunk: str) -> bytes:
        ids = self.older.get(chunk)
        if ids is None:
            ids = self._piece(chunk)
        if len(chunk) <= CACHED_LENGTH:
            if len(self) >= CACHED_CHUNKS:
                self.older = dict(self)
                self.clear()
            self[chunk] = ids
        return ids

    def __call__(self, text: str) -> bytes:
        special = _special.search(text)
        if special and _odd_space.search(text) or self.added.search(text):
            return self._whole(text)
        if special and _not_latin.search(text):
            chunks = (_with_space if self.byte_level else _without_space).findall(text)
        else:
            chunks = self.pattern.findall(text if self.byte_level else text.lower())
        return b"".join(map(self.__getitem__, chunks))


def encoder(file: str) -> Encoder:
    """One encoder per worker and vocabulary file."""
    if file not in _open:
        _open[file] = Encoder(file)
    return _open[file]
