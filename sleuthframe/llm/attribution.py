"""Token counts of sections, from one encoding of the whole document.

A document is encoded once, and each token has a span of characters. Sections (or fields laid out in a text) are spans
too. Tokens and sections meet in an interval join inside the document: both are sorted, and each section finds its first
and last token by binary search. A token that crosses a border is allocated by a rule:

``start``     to the section that holds its first character;
``most``      to the section that holds most of its characters, the earlier one in a tie;
``share``     in parts, by its characters in each section.

``n_tokens`` counts by the chosen one of the first two rules, so the numbers of a document's sections add up to its tokens
where the sections cover it; ``token_share`` always counts in parts; ``n_crossing`` tells how many tokens reach over the
section's borders. Tokens without characters of their own in a section (several tokens can spell one character) count
where this character is.

Defined cases: null and empty texts have one empty section without tokens; repeated rows are documents of their own; null
ids stay null; an empty table gives an empty result; other columns aren't read.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sleuthframe.llm.encode import Encoder, encoder, public

RULE = "start"

# Characters of documents that are counted together: bounds a worker's memory, never the result.
TOGETHER = 500_000


class Spans(dict):
    """First and last character (exclusive) of each token of the pieces met so far, in turn, relative to the piece."""

    LIMIT = 400_000

    def __init__(self, known: Encoder):
        super().__init__()
        self.known = known

    def __missing__(self, piece: str) -> bytes:
        tokens = self.known.word_tokens(piece)
        if tokens is None:
            found = [x for span in self.known.tokenizer.encode(piece, add_special_tokens=False).offsets for x in span]
        else:
            # The character of each byte; a token that has a part of a character has it whole.
            home = None if piece.isascii() else [i for i, c in enumerate(piece) for _ in c.encode()]
            found, at = [], 0
            for token in tokens:
                begin, at = at, at + len(token.value)
                found += (begin, at) if home is None else (home[begin], home[at - 1] + 1)
        value = array("i", found).tobytes()
        if len(self) >= self.LIMIT:
            self.clear()
        self[piece] = value
        return value

    def of(self, texts: list[str], places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Spans of all tokens of whole texts, in characters; ``places`` are the numbers of the texts' first characters."""
        begins, found = [], []
        for text, place in zip(texts, places.tolist(), strict=True):
            pieces = self.known.cut(text)
            if not pieces:
                continue
            found.extend(map(self.__getitem__, pieces))
            size = np.fromiter(map(len, pieces), "int64", len(pieces))
            if size.sum() == len(text):
                begins.append(np.cumsum(size) - size + place)
            else:  # the tokenizer drops what lies between its pieces
                begins.append(np.array([m.start() for m in self.known.pieces.finditer(text)]) + place)
        if not found:
            return np.empty(0, "int64"), np.empty(0, "int64")
        shift = np.repeat(np.concatenate(begins), np.fromiter(map(len, found), "int64", len(found)) // 8)
        spans = np.frombuffer(b"".join(found), "<i4").reshape(-1, 2) + shift[:, None]
        return np.ascontiguousarray(spans[:, 0]), np.ascontiguousarray(spans[:, 1])


def lines(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Sections by line; a line holds the line feed that ends it."""
    ends = np.flatnonzero(np.frombuffer(text.encode("utf-32-le"), "<u4") == 10) + 1
    if not len(ends) or ends[-1] < len(text):
        ends = np.append(ends, len(text))
    return np.concatenate([[0], ends[:-1]]), ends


def allocate(
    first: np.ndarray, last: np.ndarray, begin: np.ndarray, end: np.ndarray, rule: str = RULE
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tokens by rule, tokens in parts, and crossing tokens of each section.

    ``first``/``last`` are spans of tokens in order, ``begin``/``end`` of sections, sorted and without overlap.
    """
    number = len(begin)
    whole, crossing = np.zeros(number, "int64"), np.zeros(number, "int64")
    parts = np.zeros(number)
    if not len(first) or not number:
        return whole, parts, crossing
    # Sections that a token touches: from the first that ends behind its start to the last that begins before its end.
    low = np.searchsorted(end, first, "right")
    high = np.searchsorted(begin, np.maximum(last, first + 1), "left") - 1
    inside = low == high
    home = low[inside]
    whole += np.bincount(home, minlength=number)[:number]
    size = np.maximum(last - first, 1)
    own = np.minimum(last, end[np.minimum(low, number - 1)]) - np.maximum(first, begin[np.minimum(low, number - 1)])
    full = inside & (own >= last - first)
    parts += np.bincount(low[full], minlength=number)[:number]
    for t in np.flatnonzero(~full & (low <= high)):
        touched = range(low[t], high[t] + 1)
        shares = [max(0, min(last[t], end[s]) - max(first[t], begin[s])) for s in touched]
        for s, x in zip(touched, shares, strict=True):
            parts[s] += x / size[t]
            crossing[s] += 1
        if not inside[t]:
            if rule == "most":
                whole[low[t] + int(np.argmax(shares))] += 1
            elif begin[low[t]] <= first[t]:
                whole[low[t]] += 1
    if rule == "start":
        # A token that starts before its section's first character belongs to no section.
        outside = inside & (first < begin[np.minimum(low, number - 1)])
        whole -= np.bincount(low[outside], minlength=number)[:number]
    return whole, parts, crossing


def token_counts(
    docs: DataFrame,
    path: str | None = None,
    rule: str = RULE,
    sections=lines,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """(id, section, start, end, n_tokens, token_share, n_crossing): one row per section of each whole text.

    ``sections(text)`` gives the starts and ends of a text's sections in characters, sorted and without overlap.
    """
    if rule not in ("start", "most"):
        raise ValueError(f"unknown rule {rule}")
    path = path or public("byte_bpe_50k.json")

    def counted(spans: Spans, keys: list, texts: list[str]) -> pd.DataFrame:
        """Rows of some documents, laid out one behind the other. Two numbers stay free between them, so that no token
        touches a section of another document."""
        size = np.fromiter(map(len, texts), "int64", len(texts)) + 2
        places = np.cumsum(size) - size
        found = [sections(text) for text in texts]
        number = np.fromiter((len(b) for b, _ in found), "int64", len(found))
        shift = np.repeat(places, number)
        begin, end = (np.concatenate([np.asarray(x[i], "int64") for x in found]) for i in (0, 1))
        whole, parts, crossing = allocate(*spans.of(texts, places), begin + shift, end + shift, rule)
        return pd.DataFrame(
            {
                "id": np.repeat(np.array(keys, object), number),
                "section": np.arange(len(begin)) - np.repeat(np.cumsum(number) - number, number),
                "start": begin,
                "end": end,
                "n_tokens": whole,
                "token_share": parts,
                "n_crossing": crossing,
            }
        )

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        spans = Spans(encoder(path))
        for frame in frames:
            keys, texts, size = [], [], 0
            for key, text in zip(frame["id"], frame["text"], strict=True):
                keys.append(key)
                texts.append(text or "")
                size += len(texts[-1])
                if size >= TOGETHER:
                    yield counted(spans, keys, texts)
                    keys, texts, size = [], [], 0
            if keys:
                yield counted(spans, keys, texts)

    texts = docs.select(F.col(f"`{id_col}`").cast("string").alias("id"), F.col(f"`{text_col}`").alias("text"))
    found = texts.mapInPandas(
        run, "id string, section long, start long, end long, n_tokens long, token_share double, n_crossing long"
    )
    kind = docs.schema[id_col].dataType
    return found.select(F.col("id").cast(kind).alias(id_col), *found.columns[1:])
