"""Language-model scores by a weighted backoff automaton.

The model is a smoothed trigram model over an open vocabulary. Unigrams are smoothed by adding a half, with one class for all
unknown words. A longer history h shares its mass between what followed it in training and the history without its first
word: p(w|h) = (c(hw) + k p(w|h')) / (c(h) + k). As an automaton: states are the histories of two, one and no words that the
training texts have; a state has an arc for each word that followed, and a failure arc to the state without its first word,
which costs log10 k / (c(h) + k). A text is read once from left to right: while the state has no arc for a token, its failure
arc is taken and paid; then the arc's log-probability is added, and the longest history that is a state is the next one.

The automaton grows with the corpus, so no task holds it. Documents form blocks of bounded rows and bytes. A block needs the
weights of its own n-grams only: it sends their hashes, sorted, with its own training counts, cut into slices of the range of
all hashes; a slice is summed over all blocks, and the totals go back in the order in which the hashes were sent, without them.
So an n-gram moves once from each block that has it, however frequent it is, and no key is hotter than the blocks are many.
N-grams, words included, are told apart by ``BITS`` bits of their hash: of a thousand million n-grams about a hundred share one.

Defined cases: null, empty and blank texts consist of the end token; a null id is trained on or held out like an empty
one; repeated rows count each; texts may be of any length, one above the bound being a block of its own; without training
rows every token has the same probability; an empty table gives an empty result; other columns travel inside ``_doc``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sleuthframe.llm.neardup import MIX, WordHashes, mixed
from sleuthframe.llm.tables import WORD, keyed, settle

# Weight of the shorter history, in tokens, for histories of one and of two words.
WEIGHT_ONE = 50.0
WEIGHT_TWO = 10.0
# Bounds of a block; a text with more bytes is a block of its own, and the last text of a block may exceed the bound once.
BLOCK_DOCS = 2048
BLOCK_BYTES = 8 << 20
# Bits of an n-gram's hash; each bit less saves an eighth of a byte per n-gram and block on the way.
BITS = 52
SLICE_BYTES = 4 << 20
LEAST_SLICES = 64

# The end of a text is a token of its own, and so is its start, as a history. Both are outside the values of the word hash.
END = 0
START = 1


class Reader:
    """Token hashes of texts; A-Z are lower-cased and the end token follows."""

    def __init__(self):
        self.word = re.compile(WORD)
        self.hashes = WordHashes()

    def tokens(self, text: str | None) -> np.ndarray:
        words = self.word.findall(text or "")
        out = np.empty(len(words) + 1, "uint64")
        out[:-1] = np.fromiter(map(self.hashes.__getitem__, words), "uint64", len(words))
        out[out <= START] = START + 1
        out[-1] = END
        return out


def pack(numbers: np.ndarray) -> bytes:
    """Whole numbers in as few bytes as the largest needs, compressed, equal bytes of all numbers side by side."""
    width = max(1, (int(numbers.max()).bit_length() + 7) // 8) if len(numbers) else 1
    planes = numbers.astype("<u8").view("uint8").reshape(-1, 8)[:, :width]
    return bytes([width]) + zstandard.compress(np.ascontiguousarray(planes.T).tobytes(), 1)


def unpack(raw: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(raw[1:]), "uint8").reshape(raw[0], -1)
    out = np.zeros((planes.shape[1], 8), "uint8")
    out[:, : raw[0]] = planes.T
    return out.view("<u8").ravel()


def joined_hash(one: np.ndarray, two: np.ndarray, order: int) -> np.ndarray:
    return mixed((one + np.uint64(order)) * MIX + mixed(two + np.uint64(order)))


class Grams:
    """The n-grams of some texts: hashes in order, and for each token the places of its unigram, bigram and trigram.

    The lowest bit of a hash tells single words from longer n-grams.
    """

    def __init__(self, texts: list[np.ndarray]):
        self.sizes = np.array([len(t) for t in texts])
        self.first = np.cumsum(self.sizes) - self.sizes
        word = np.concatenate(texts)
        before = np.append(np.uint64(START), word[:-1])
        before[self.first] = START
        two = joined_hash(before, word, 2)
        # The history of two words is the bigram that ends before the token; at the start of a text there is none yet.
        history = np.append(np.uint64(START), two[:-1])
        history[self.first] = START
        three = joined_hash(history, word, 3)
        every = np.concatenate([mixed(word), two, three]) >> np.uint64(64 - BITS) << np.uint64(1)
        every[: len(word)] |= np.uint64(1)
        self.hashes, places = np.unique(every, return_inverse=True)
        self.one, self.two, self.three = places.reshape(3, -1)

    def counts(self, train: list[bool]) -> np.ndarray:
        """Number of each n-gram in training texts."""
        learnt = np.repeat(np.array(train, bool), self.sizes)
        places = np.concatenate([self.one[learnt], self.two[learnt], self.three[learnt]])
        return np.bincount(places, minlength=len(self.hashes)).astype("uint64")

    def traverse(self, total: np.ndarray, n: int, v: int, texts: int, weights: tuple[float, float]) -> tuple[np.ndarray, np.ndarray]:
        """(log10 by unigrams alone, log10 by the automaton) of each token, all texts being read side by side.

        ``total`` has the training counts of the n-grams, ``n`` of all tokens, ``v`` of distinct words, ``texts`` of texts.
        """
        total = total.astype("float64")
        start = np.zeros(len(self.one), bool)
        start[self.first] = True
        # Counts of the two histories before each token: the states that a reading may be in.
        held_one = np.where(start, texts, np.append(0.0, total[self.one][:-1]))
        held_two = np.where(start, texts, np.append(0.0, total[self.two][:-1]))
        root = (total[self.one] + 0.5) / (n + 0.5 * (v + 1))
        chance = root
        for held, arc, weight in ((held_one, total[self.two], weights[0]), (held_two, total[self.three], weights[1])):
            # A history that is no state costs nothing; without an arc only the failure arc is left, and paid.
            failure = weight / (held + weight)
            chance = np.where(arc > 0, arc / (held + weight), 0.0) + failure * chance
        return np.log10(root), np.log10(chance)


def in_blocks(rows: DataFrame) -> DataFrame:
    """Add ``block``: neighbouring rows of a file, at most BLOCK_DOCS and less than 2 * BLOCK_BYTES together."""
    rows = rows.withColumn("_group", F.expr(f"_row div {BLOCK_DOCS}"))
    sizes = rows.select("_file", "_group", "_row", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("size"))
    heavy = sizes.groupBy("_file", "_group").agg(F.sum("size").alias("size")).where(f"size > {BLOCK_BYTES}")
    heavy = settle(heavy.select("_file", "_group"))
    if heavy.isEmpty():
        return rows.withColumn("block", F.xxhash64("_file", "_group")).drop("_group")
    ordered = Window.partitionBy("_file", "_group").orderBy("_row")
    before = F.coalesce(F.sum("size").over(ordered.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    alone = F.when(F.col("size") > BLOCK_BYTES, F.col("_row"))
    # A heavy group has more than BLOCK_BYTES of text and becomes one row; Spark chooses the joins.
    found = sizes.join(heavy, ["_file", "_group"])
    found = found.withColumn("piece", F.struct(F.floor(before / BLOCK_BYTES).alias("at"), alone.alias("alone")))
    found = found.withColumn("new", ~F.col("piece").eqNullSafe(F.lag("piece").over(ordered)))
    cuts = found.where("new").groupBy("_file", "_group").agg(F.collect_list("_row").alias("_cuts"))
    cut = rows.join(settle(cuts), ["_file", "_group"], "left")
    piece = F.size(F.filter(F.coalesce("_cuts", F.array().cast("array<long>")), lambda at: at <= F.col("_row")))
    return cut.withColumn("block", F.xxhash64("_file", "_group", piece)).drop("_group", "_cuts")


def _sent(rows: DataFrame, slices: int) -> DataFrame:
    """(slice, block, first, last, hashes, own): the n-grams of each block with their counts in its training documents.

    Rows are read in the order of their files; a block that lies in two tasks is sent in two parts, told apart by their rows.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader = Reader()
        texts: list[np.ndarray] = []
        learnt: list[bool] = []
        at, span = None, (0, 0)

        def send() -> pd.DataFrame:
            grams = Grams(texts)
            own = grams.counts(learnt)
            cuts = np.searchsorted(grams.hashes, _borders(slices))
            out = []
            for i, (low, high) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
                part = grams.hashes[low:high]
                if len(part):
                    steps = np.diff(part, prepend=np.uint64(0))
                    out.append((i, at, *span, pack(steps), pack(own[low:high])))
            return pd.DataFrame(out, columns=["slice", "block", "first", "last", "hashes", "own"])

        for frame in frames:
            for block, row, text, train in zip(frame["block"], frame["_row"], frame["text"], frame["train"], strict=True):
                if texts and block != at:
                    yield send()
                    texts, learnt = [], []
                if not texts:
                    at, span = block, (row, row)
                span = (span[0], row)
                texts.append(reader.tokens(text))
                learnt.append(bool(train))
        if texts:
            yield send()

    return rows.select("block", "_row", "text", "train").mapInPandas(
        run, "slice int, block long, first long, last long, hashes binary, own binary"
    )


def _borders(slices: int) -> np.ndarray:
    """Bounds of the slices of all hashes."""
    return np.array([(i << BITS + 1) // slices for i in range(slices)] + [1 << BITS + 1], "uint64")


def _summed(sent: DataFrame) -> DataFrame:
    """(block, first, last, slice, totals, n, v): training counts over all blocks, in the order in which hashes were sent.

    ``n`` and ``v`` are the number of tokens and of distinct words of the slice, on one of its rows.
    """

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        parts = [np.cumsum(unpack(raw)) for raw in frame["hashes"]]
        hashes, places = np.unique(np.concatenate(parts), return_inverse=True)
        own = np.concatenate([unpack(raw) for raw in frame["own"]])
        total = np.bincount(places, own.astype("float64"), len(hashes)).astype("uint64")
        words = total[(hashes & np.uint64(1)) == 1]
        cuts = np.cumsum([0] + [len(p) for p in parts])
        out = frame[["block", "first", "last", "slice"]].copy()
        out["totals"] = [pack(total[places[a:b]]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        out["n"], out["v"] = 0, 0
        out.iloc[0, out.columns.get_loc("n")] = int(words.sum())
        out.iloc[0, out.columns.get_loc("v")] = int((words > 0).sum())
        return out

    schema = "block long, first long, last long, slice int, totals binary, n long, v long"
    return settle(sent.groupBy("slice").applyInPandas(run, schema))


def score_rows(rows: DataFrame, weights: tuple[float, float] = (WEIGHT_ONE, WEIGHT_TWO)) -> DataFrame:
    """Scores of ``rows(_file, _row, id, text, train)`` by a model of the rows where ``train`` is true.

    Adds n_tokens, n_known, train_tokens, base_score (unigrams alone) and score (the automaton), as log10.
    """
    rows = in_blocks(rows.withColumn("id", F.col("id").cast("string")))
    # The more text, the more slices: a slice has the n-grams of about SLICE_BYTES of it, whatever the size of the table.
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    totals = _summed(_sent(rows, max(LEAST_SLICES, size // SLICE_BYTES)))
    sums = totals.agg(F.sum("n").alias("n"), F.sum("v").alias("v")).first()
    n, v = sums["n"] or 0, sums["v"] or 0
    # Each training text has one end.
    learnt = rows.where("train").count()

    def score_block(key, docs: pd.DataFrame, part: pd.DataFrame) -> pd.DataFrame:
        reader = Reader()
        docs = docs.sort_values("_row", ignore_index=True)
        out = []
        for (first, last), mine in part.groupby(["first", "last"]):
            here = docs[docs["_row"].between(first, last)]
            grams = Grams([reader.tokens(text) for text in here["text"]])
            total = np.concatenate([unpack(raw) for raw in mine.sort_values("slice")["totals"]])
            base, chance = grams.traverse(total, n, v, learnt, weights)
            more = {
                "n_tokens": grams.sizes,
                "n_known": np.add.reduceat((total[grams.one] > 0).astype("int64"), grams.first),
                "base_score": np.add.reduceat(base, grams.first),
                "score": np.add.reduceat(chance, grams.first),
            }
            out.append(here[["_file", "_row", "id", "train"]].assign(**more))
        return pd.concat(out)

    docs = rows.select("block", "_file", "_row", "id", "text", "train")
    scored = (
        docs.groupBy("block")
        .cogroup(totals.select("block", "first", "last", "slice", "totals").groupBy("block"))
        .applyInPandas(
            score_block,
            "_file long, _row long, id string, train boolean, n_tokens long, n_known long, base_score double, score double",
        )
    )
    return scored.withColumn("train_tokens", F.lit(n).cast("long"))


def held_out(key: Column, folds: int = 5, fold: int = 1) -> Column:
    """Whether a document is left out of training: by the checksum of its id as text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % folds == fold


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """(_file, _row, id, train, n_tokens, n_known, train_tokens, base_score, score) of each document."""
    rows = keyed(docs).select(
        "_file",
        "_row",
        F.col(f"_doc.`{id_col}`").alias("id"),
        F.col(f"_doc.`{text_col}`").alias("text"),
        (~held_out(F.col(f"_doc.`{id_col}`"))).alias("train"),
    )
    return score_rows(rows, **options)


