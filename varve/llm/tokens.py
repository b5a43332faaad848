"""Token ids of whole texts by a public tokenizer file, with the ids of words remembered."""

from __future__ import annotations

import functools
import json
import re
import struct

import numpy as np

#: Pieces of text and words that a worker remembers before it forgets them all.
PIECES, WORDS = 1 << 18, 1 << 19
#: Marks that end words, and that the tokenizer cuts off from letters.
MARKS = ".,!?;:"
#: Words that lower-casing and Unicode's composition leave letter by letter.
PLAIN = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]+")


def _byte_letters() -> dict[int, str]:
    """How byte-level tokenizers write the letters of PLAIN: each byte as the letter of that number, if it is printable there, else as one from 256 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    letter = {b: chr(b) for b in shown} | {b: chr(256 + n) for n, b in enumerate(hidden)}
    return {c: "".join(letter[b] for b in chr(c).encode()) for c in range(0xC0, 0x100)}


BYTE_LETTERS = _byte_letters()


def default_path() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("word_bpe_49k.json"))


class _Remembered(dict):
    """Ids by piece of text; what is missing is made and kept."""

    def __init__(self, make, most: int) -> None:
        super().__init__()
        self.make, self.most = make, most

    def __missing__(self, piece: str) -> bytes:
        found = self.make(piece)
        if len(piece) <= 64:
            if len(self) >= self.most:
                self.clear()
            self[piece] = found
        return found


class WordTokenizer:
    """Ids as little-endian unsigned 32-bit bytes.

    For tokenizers that lower-case, drop white space and never look beyond it, so that a text's ids are those of its
    pieces between spaces and line feeds, one after another; and that cut runs of letters off from other marks, so
    that a word and the marks after it can be taken one by one.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.vocabulary = self.model.get_vocab_size()
        spec = json.loads(self.model.to_str())
        # a word of plain letters can go to the model at once if the steps before only lower-case, split and spell bytes
        self.direct = '"Lowercase"' in json.dumps(spec["normalizer"]) and '"ByteLevel"' in json.dumps(spec["pre_tokenizer"]) and not spec["post_processor"]
        self.words_model = self.model.model
        self.words = _Remembered(self._encoded, WORDS)
        self.pieces = _Remembered(self._made, PIECES)

    def _encoded(self, piece: str) -> bytes:
        if self.direct and PLAIN.fullmatch(piece):
            ids = [t.id for t in self.words_model.tokenize(piece.lower().translate(BYTE_LETTERS))]
            return struct.pack(f"<{len(ids)}I", *ids)
        return np.array(self.model.encode(piece, add_special_tokens=False).ids, "<u4").tobytes() if piece else b""

    def _made(self, piece: str) -> bytes:
        word = piece.rstrip(MARKS)
        if word == piece:
            return self.words[piece.lower() if PLAIN.fullmatch(piece) else piece]
        if PLAIN.fullmatch(word):  # other letters may end in a combining mark once they are lower-cased or composed, which goes with MARKS
            return self.words[word.lower()] + self.words[piece[len(word) :]]
        return self._encoded(piece)

    def __call__(self, text: str | None) -> bytes:
        return b"".join(map(self.pieces.__getitem__, (text or "").replace("\n", " ").split(" ")))


@functools.cache
def tokenizer(path: str) -> WordTokenizer:
    """A worker's tokenizer, with what it remembers from one task to the next."""
    return WordTokenizer(path)
