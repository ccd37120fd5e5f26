"""Token ids of whole texts by the tokenizers library, with the pieces between spaces remembered.

The byte-level tokenizer never joins what stands before a space that is followed by another sign with what follows it.
So a text may be cut there, each distinct piece encoded once, and the ids of the text put together from its pieces. A
new piece of letters and ASCII signs is split by the vocabulary's published pattern, and parts that are new too go
straight to the library's merge model, which spares its per-text overhead; any other new piece takes the library's whole
path. So does a text that holds an added token of the vocabulary, such as the end sign, in plain signs: the library reads
it as that token wherever it stands.
"""

from __future__ import annotations

import re

import public_tokenizers
import regex
from tokenizers import Tokenizer

VOCABULARY = "byte_bpe_50k.json"
#: Pieces that a worker remembers; beyond it, those of the last round are kept once more. Longer pieces are not remembered.
MOST_PIECES = 300_000
LONGEST_PIECE = 48
#: The sign that stands for a space.
SPACE = chr(256 + 32)

_plain = re.compile(r"(?= \S)")
_odd = re.compile(r" (?:\s|$)")
_known_signs = re.compile(r"(?:[\t-\r\x20-\x7e]|[^\W\d_])*")
_pattern = regex.compile(public_tokenizers.PATTERN)
_encoders: dict[tuple[str, int | None], "Encoder"] = {}


def byte_signs() -> dict[int, str]:
    """The printable sign that stands for each byte in byte-level vocabularies: itself if printable, else from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


class Encoder:
    def __init__(self, vocabulary: str, most: int | None = None) -> None:
        self.most = most
        self.whole = Tokenizer.from_file(public_tokenizers.path(vocabulary))
        self.merges = self.whole.model
        self.added = re.compile("|".join(re.escape(t.content) for t in self.whole.get_added_tokens_decoder().values()) or r"(?!)")
        self.signs = byte_signs()
        self.coded = [i.to_bytes(4, "little") for i in range(self.whole.get_vocab_size())]
        #: Ids of pieces that follow a space, by the piece without it; and of those used before the last emptying.
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        #: Ids of parts that follow no space, or are no words.
        self.parts: dict[str, bytes] = {}

    def _library(self, text: str) -> bytes:
        return b"".join([self.coded[i] for i in self.whole.encode(text, add_special_tokens=False).ids])

    def _merged(self, part: str) -> bytes:
        """Ids of a part that the pattern doesn't split."""
        coded = self.coded
        return b"".join([coded[t.id] for t in self.merges.tokenize(part.encode().decode("latin-1").translate(self.signs))])

    def _word(self, word: str) -> bytes:
        """Ids of a word of letters after a space."""
        ids = self.known.get(word)
        if ids is None:
            ids = self.older.get(word)
            if ids is None:
                if word.isascii():  # letters stand for themselves
                    coded = self.coded
                    ids = b"".join([coded[t.id] for t in self.merges.tokenize(SPACE + word)])
                else:
                    ids = self._merged(" " + word)
            if len(word) <= LONGEST_PIECE:
                self.known[word] = ids
        return ids

    def _part(self, part: str) -> bytes:
        if part[0] == " " and part[1:].isalpha():
            return self._word(part[1:])
        ids = self.parts.get(part)
        if ids is None:
            ids = self._merged(part)
            if len(part) <= LONGEST_PIECE:
                if len(self.parts) > MOST_PIECES // 4:
                    self.parts.clear()
                self.parts[part] = ids
        return ids

    def _ids(self, piece: str) -> bytes:
        if _known_signs.fullmatch(piece):
            return b"".join([self._part(x) for x in _pattern.findall(piece)])
        return self._library(piece)

    def _after_space(self, piece: str) -> bytes:
        """Ids of a new piece after a space."""
        if piece.isalpha():
            return self._word(piece)
        if piece[-1:] in (",", ".") and piece[:-1].isalpha():  # the pattern splits letters from such a sign
            again = piece[:-1] in self.known
            ids = self._word(piece[:-1]) + self._part(piece[-1])
        else:
            again = "\n" not in piece  # two words are rarely neighbours again
            ids = self._ids(" " + piece)
        if again and len(piece) <= LONGEST_PIECE:
            self.known[piece] = ids
        return ids

    def encode(self, text: str) -> bytes:
        """The ids of a text as little-endian unsigned 32-bit integers."""
        if len(self.known) > (self.most or MOST_PIECES):
            self.older, self.known = self.known, {}
        if self.added.search(text):
            return self._library(text)
        if _odd.search(text):
            first, *rest = _plain.split(text)
            rest = [x[1:] for x in rest]
        else:
            first, *rest = text.split(" ")
        out = list(map(self.known.get, rest))
        if None in out:
            known, older = self.known, self.older
            for i, ids in enumerate(out):
                if ids is None:
                    piece = rest[i]
                    ids = older.get(piece)
                    if ids is None:
                        ids = self._after_space(piece)
                    else:
                        known[piece] = ids
                    out[i] = ids
        return self._ids(first) + b"".join(out) if first else b"".join(out)


def encoder(vocabulary: str = VOCABULARY, most: int | None = None) -> Encoder:
    """One for each worker process. most: pieces that it remembers, about 200 bytes each, twice."""
    if (vocabulary, most) not in _encoders:
        _encoders[vocabulary, most] = Encoder(vocabulary, most)
    return _encoders[vocabulary, most]
