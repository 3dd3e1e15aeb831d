"""Best-fit decreasing packing of token sequences.

Only the length of a piece decides where best-fit decreasing puts it, and a piece has 1 to ``capacity`` tokens. So the
pieces reduce to a histogram of at most ``capacity`` rows, whatever their number. The fit runs over this histogram:
lengths fall, a segment tree over remaining capacities finds the tightest open bin, and equal bins that receive equal
pieces move as one run. The result equals the fit piece by piece. The runs, bound by the capacity alone, are then
matched with the pieces by their place in the global order of lengths, which Spark finds by a range sort.

Defined cases: null and empty texts have the end id only; repeated rows and equal ids are packed one by one; an empty
table gives an empty result. Columns other than the id and the text are not carried.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sleuthframe.llm.encode import encoder, public
from sleuthframe.llm.tables import numbered, stored

CAPACITY = 2048


class TightestFit:
    """Segment tree over remaining capacities; a leaf counts the open bins that have exactly so much room."""

    def __init__(self, capacity: int):
        self.width = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.width)

    def add(self, room: int, bins: int) -> None:
        node = self.width + room
        while node:
            self.count[node] += bins
            node >>= 1

    def tightest(self, needed: int) -> int | None:
        """The least remaining capacity of at least ``needed`` that an open bin has."""
        node = self.width + needed
        if self.count[node]:
            return needed
        while node > 1 and (node & 1 or not self.count[node + 1]):
            node >>= 1
        if node <= 1:
            return None
        node += 1
        while node < self.width:
            node *= 2
            node += not self.count[node]
        return node - self.width


@dataclass
class Run:
    """``items`` pieces of one length, ``each`` to a bin, from bin ``bin`` on, the first at ``offset`` in its bin."""

    length: int
    items: int
    each: int
    bin: int
    offset: int


def best_fit_decreasing(histogram: dict[int, int], capacity: int) -> list[Run]:
    """Runs in the order of falling length; pieces of one length are taken in their order."""
    tree, runs, bins = TightestFit(capacity), [], 0
    open_bins: dict[int, list[tuple[int, int]]] = {}  # room -> (first bin, number of bins)

    def keep(room: int, first: int, number: int) -> None:
        if room and number:
            open_bins.setdefault(room, []).append((first, number))
            tree.add(room, number)

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            room = tree.tightest(length)
            if room is None:
                each = capacity // length
                first, number = bins, -(-left // each)
                bins += number
                room = capacity
            else:
                each = room // length
                first, number = open_bins[room].pop()
                tree.add(room, -number)
                used = min(number, -(-left // each))
                keep(room, first + used, number - used)
                number = used
            items = min(left, each * number)
            runs.append(Run(length, items, each, first, capacity - room))
            left -= items
            full, rest = divmod(items, each)
            keep(room - each * length, first, full)
            if rest:
                keep(room - rest * length, first + full, 1)
    return runs


def pieces(docs: DataFrame, path: str, end_id: int, capacity: int, id_col: str, text_col: str) -> DataFrame:
    """One row per piece of at most ``capacity`` ids; every text is encoded whole and closed by the end id."""
    closing = np.asarray([end_id], "<u4").tobytes()
    step = 4 * capacity

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = encoder(path)
        for frame in frames:
            out = []
            for key, text in zip(frame["id"], frame["text"], strict=True):
                raw = known.encode(text) + closing
                for at in range(0, len(raw), step):
                    part = raw[at : at + step]
                    out.append((key, at // step, at // 4, len(part) // 4, zlib.crc32(part)))
            yield pd.DataFrame(out, columns=["id", "piece", "start", "length", "ids_crc32"])

    # Ids travel as text: pandas would turn whole numbers beside a null into floats.
    taken = docs.select(F.col(f"`{id_col}`").cast("string").alias("id"), F.col(f"`{text_col}`").alias("text"))
    return taken.mapInPandas(cut, "id string, piece int, start long, length long, ids_crc32 long")


def pack(
    docs: DataFrame,
    path: str | None = None,
    end_id: int = 0,
    capacity: int = CAPACITY,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Pieces with the sequence and the offset that best-fit decreasing gives them."""
    spark = docs.sparkSession
    # Written first: the range sort reads its input twice, and the texts are to be encoded once.
    cut = stored(pieces(docs, path or public("word_bpe_49k.json"), end_id, capacity, id_col, text_col), "pieces")
    # The order is by falling length; what follows only makes reruns agree.
    placed = numbered(cut, [F.desc("length"), F.col("id"), F.col("piece"), F.col("ids_crc32")])
    histogram = {r["length"]: r["n"] for r in placed.groupBy("length").agg(F.count("*").alias("n")).collect()}
    runs = best_fit_decreasing(histogram, capacity)
    # At most a few runs per length and bin content: bound by the capacity, not by the table.
    table = np.array([(r.items, r.length, r.each, r.bin, r.offset) for r in runs], "int64").reshape(-1, 5)
    shared = spark.sparkContext.broadcast((np.cumsum(table[:, 0]) - table[:, 0], table))

    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        starts, table = shared.value
        for frame in frames:
            if len(frame):
                pos = frame.pop("_pos").to_numpy()
                at = np.searchsorted(starts, pos, "right") - 1
                items, length, each, first, offset = table[at].T
                rank = pos - starts[at]
                yield frame.assign(sequence_id=first + rank // each, offset=offset + rank % each * length)

    kind = docs.schema[id_col].dataType
    fields = ["piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    if not runs:
        empty = cut.withColumns({"sequence_id": F.lit(0).cast("long"), "offset": F.lit(0).cast("long")})
        return empty.select(F.col("id").cast(kind).alias(id_col), *fields)
    found = placed.mapInPandas(
        place,
        "id string, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long",
    )
    return found.select(F.col("id").cast(kind).alias(id_col), *fields)
