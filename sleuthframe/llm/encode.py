"""Token ids of whole texts, with one library call per distinct piece of text between blanks.

Both tokenizers split a text at white space before they merge bytes, and no merge crosses that border. So the ids of a
text are the ids of its pieces, one after the other, and a worker keeps the ids of pieces that it has met. A text that
holds the string of a special token goes to the library as a whole, since such strings are cut out first.

Most new pieces are plain words. The byte-level tokenizer never splits these before it merges, so they go straight to its
model, which takes a third of the time of a whole call. The other tokenizer lower-cases them first and splits them at
digits and signs; that is done here for pieces of plain characters, which then go to its model too.
"""

from __future__ import annotations

import os
import re
from array import array
from functools import lru_cache

# Spark runs a worker per core; the library's own threads would only compete with it.
os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

# White space of Unicode, as the tokenizers' patterns see it.
BLANK = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"

# Pieces by kind of tokenizer: the byte-level one keeps a single blank before a word, the other drops white space. A comma
# or full stop after a plain letter or digit starts a piece of its own, since both tokenizers split there too.
SOLID = rf"(?:[^{BLANK},.]+(?:(?<![A-Za-z0-9])[^{BLANK}]+)?|[,.][^{BLANK}]*)"
PIECES = {
    "byte_bpe_50k.json": re.compile(rf" ?{SOLID}|[{BLANK}]+(?![^{BLANK}])|[{BLANK}]+"),
    "word_bpe_49k.json": re.compile(SOLID),
}

# Words that the byte-level tokenizer's pattern matches as one: letters of the Latin blocks, with a blank before them or not.
WORDS = {"byte_bpe_50k.json": re.compile("[ ]?[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]+")}

# Pieces that the other tokenizer's normalizer only lower-cases: ASCII signs and Latin letters whose lower case is one of
# them. Without "<", with which its special tokens begin.
PLAIN = {"word_bpe_49k.json": re.compile("[!-;=-~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u017f]+")}
# What it merges apart in such a piece, in lower case.
PARTS = re.compile("'(?:[stmd]|re|ve|ll)|[a-z\u00df-\u00f6\u00f8-\u017f]+|[0-9]|[^a-z0-9\u00df-\u00f6\u00f8-\u017f]+")

# Pieces that a worker remembers before it starts anew: bounds its memory, never the result.
REMEMBERED = 700_000


def byte_letters() -> list[str]:
    """The letter by which a byte-level vocabulary writes each byte: printable ones as they are, the rest from U+0100 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(x) if x in shown else chr(next(rest)) for x in range(256)]


class Known(dict):
    """Ids of each piece met so far, as little-endian unsigned 32-bit integers."""

    def __init__(self, encoder: Encoder):
        super().__init__()
        self.encoder = encoder

    def __missing__(self, piece: str) -> bytes:
        found = self.encoder.plain_tokens(piece)
        if found is None:
            ids = self.encoder.tokenizer.encode(piece, add_special_tokens=False).ids
        else:
            ids = [t.id for t in found]
        ids = array("I", ids).tobytes()
        if len(self) >= REMEMBERED:
            self.clear()
        self[piece] = ids
        return ids


class Encoder:
    """Ids of texts by one tokenizer file; ``pieces`` None sends every text to the library as a whole.

    ``words`` are pieces that the tokenizer's model may get as they are, byte by byte, ``plain`` those that it may get in lower
    case and by their parts.
    """

    def __init__(
        self, path: str, pieces: re.Pattern | None, words: re.Pattern | None = None, plain: re.Pattern | None = None
    ):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.pieces = pieces
        self.words = words
        self.plain = plain
        self.letters = dict(enumerate(byte_letters()))
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.known = Known(self)

    def word_tokens(self, piece: str) -> list | None:
        """Tokens of a plain word, whose values have a letter per byte; None for any other piece."""
        if self.words is None or not self.words.fullmatch(piece):
            return None
        return self.model.tokenize(piece.encode().decode("latin-1").translate(self.letters))

    def plain_tokens(self, piece: str) -> list | None:
        """Tokens of a plain word or piece, whose values need not have a letter per byte; None for any other piece."""
        if self.plain is None or not self.plain.fullmatch(piece):
            return self.word_tokens(piece)
        lower = piece.lower()
        parts = [lower] if lower.isalpha() else PARTS.findall(lower)
        if not lower.isascii():
            parts = [p.encode().decode("latin-1").translate(self.letters) for p in parts]
        return self.model.tokenize(parts[0]) if len(parts) == 1 else [t for p in parts for t in self.model.tokenize(p)]

    def cut(self, text: str) -> list[str]:
        """The pieces of a text; the text itself where it holds the string of a special token."""
        if self.pieces is None or any(s in text for s in self.special):
            return [text]
        return self.pieces.findall(text)

    def encode(self, text: str | None) -> bytes:
        """Ids of a whole text as little-endian unsigned 32-bit integers; null is empty."""
        return b"".join(map(self.known.__getitem__, self.cut(text or "")))


@lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    """The encoder of this worker for a tokenizer file."""
    name = path.rpartition("/")[2]
    return Encoder(path, PIECES.get(name), WORDS.get(name), PLAIN.get(name))


def public(name: str) -> str:
    """Place of a public vocabulary file on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)
