"""Near-duplicate groups by min-max hashing.

Each permutation of the shingle hashes is evaluated once and gives two values of a signature, its minimum and its
maximum. Both agree between two sets with a probability equal to their Jaccard similarity. Signatures are cut into bands;
equal bands make a bucket. What a bucket proposes is confirmed on the full sets.

Documents with equal sets are one node, however many there are, so copies never meet in a bucket. Inside a bucket only
links between different components matter. First each bucket's centre is compared with its members: confirmed links make
components, and pairs that are loosely alike by their signatures make families. A pair of a bucket that is still open is
then either of two families: such buckets are compared by signatures inside tasks, block by block, and only pairs that may reach
the similarity come out; or of one family but two components. Families are cut into blocks of bounded bytes in the order of
their components, and pairs of blocks that hold more than one component are compared inside tasks, signatures first and
full sets where these leave it open. Only links that merge components come out, so no list of pairs grows with the square of
a group. No pair that a bucket proposes goes unseen unless its two nodes are linked already.

Bounds of loss: at similarity 0.8, 32 bands of 5 values miss a pair with probability 3e-6; the estimate by the whole
signature, which spares the full sets of hopeless pairs, misses one in 1e-8. Sets are compared by 64-bit shingle hashes.

Defined cases: a document without words (null, empty, blanks) has no shingles and is a group of its own; a document with
fewer words than a shingle has its whole sequence as its one shingle; repeated rows are copies; null ids are never the
smallest unless a group has no other; an empty table gives an empty result; other columns travel inside ``_doc``.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sleuthframe.llm.binary_codes import in_blocks, pairs_in, runs
from sleuthframe.llm.contraction import components
from sleuthframe.llm.tables import WORD, keyed, numbered, settle

SHINGLE = 5
PERCENT = 80
PERMUTATIONS = 80
BAND_VALUES = 5
SEED = 71
# Values that must agree before full sets are fetched: six standard deviations below the threshold.
DEVIATIONS = 6
# Share of agreeing values from which two nodes are one family. Any value gives the same groups; it steers the work.
LOOSE = 0.45
# A block of a family holds this many shingles, every node counting for LEAST_WEIGHT at least; a task compares two blocks.
BLOCK = 1 << 20
LEAST_WEIGHT = 1 << 12

MIX = np.uint64(0x9E3779B97F4A7C15)
TO_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
REMEMBERED = 250_000


class WordHashes(dict):
    """64-bit hash of each word met so far, A-Z lower-cased."""

    def __missing__(self, word: str) -> int:
        value = xxhash.xxh3_64_intdigest(word.translate(TO_LOWER).encode())
        if len(self) >= REMEMBERED:
            self.clear()
        self[word] = value
        return value


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * MIX
    return x ^ (x >> np.uint64(29))


class Sketcher:
    """Shingle sets and min-max signatures."""

    def __init__(self, shingle: int = SHINGLE, permutations: int = PERMUTATIONS, seed: int = SEED):
        draw = np.random.default_rng(seed)
        self.shingle = shingle
        self.flips = draw.integers(0, 1 << 63, permutations, dtype="uint64")
        self.factors = draw.integers(0, 1 << 63, permutations, dtype="uint64") * np.uint64(2) + np.uint64(1)
        self.word = re.compile(WORD)
        self.hashes = WordHashes()

    def shingles(self, text: str | None) -> np.ndarray:
        """Sorted distinct shingle hashes of a whole text."""
        words = self.word.findall(text or "")
        if not words:
            return np.empty(0, "uint64")
        w = np.fromiter(map(self.hashes.__getitem__, words), "uint64", len(words))
        size = min(self.shingle, len(w))
        out = np.full(len(w) - size + 1, size, "uint64")
        for i in range(size):
            out = mixed(out * MIX + w[i : len(w) - size + 1 + i])
        return np.unique(out)

    def signature(self, shingles: np.ndarray) -> np.ndarray:
        """All minima, then all maxima."""
        low = np.full(len(self.flips), np.iinfo("uint64").max, "uint64")
        high = np.zeros(len(self.flips), "uint64")
        for at in range(0, len(shingles), 2048):
            block = (shingles[None, at : at + 2048] ^ self.flips[:, None]) * self.factors[:, None]
            np.minimum(low, block.min(axis=1), out=low)
            np.maximum(high, block.max(axis=1), out=high)
        return np.concatenate([low, high])


def bands(signature: np.ndarray, values: int = BAND_VALUES) -> np.ndarray:
    """One hash per band; the band's number goes in, so bands never share buckets."""
    number = len(signature) // values
    out = np.arange(1, number + 1, dtype="uint64") * MIX
    for column in signature[: number * values].reshape(number, values).T:
        out = mixed(out + column)
    return out.view("int64")


def sketch(rows: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """Sketches of ``rows(_file, _row, id, text)``: set size, digest of the set, band hashes, one byte per value."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        maker = Sketcher(shingle)
        for frame in frames:
            out = []
            for text in frame.pop("text"):
                found = maker.shingles(text)
                if not len(found):
                    out.append((0, None, None, None))
                    continue
                values = maker.signature(found)
                digest = hashlib.blake2b(found.tobytes(), digest_size=16).digest()
                short = (mixed(values) >> np.uint64(56)).astype("uint8").tobytes()
                out.append((len(found), digest, bands(values), short))
            more = pd.DataFrame(out, columns=["n_shingles", "digest", "bands", "short"], index=frame.index)
            yield pd.concat([frame, more], axis=1)

    # Ids travel as text: pandas would turn whole numbers beside a null into floats.
    return rows.select("_file", "_row", F.col("id").cast("string"), "text").mapInPandas(
        run, "_file long, _row long, id string, n_shingles long, digest binary, bands array<long>, short binary"
    )


def full_sets(rows: DataFrame, wanted: DataFrame, shingle: int) -> DataFrame:
    """(node, grams): the sorted shingle hashes of the nodes in ``wanted(node, _file, _row)``."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        maker = Sketcher(shingle)
        for frame in frames:
            yield pd.DataFrame({"node": frame["node"], "grams": [maker.shingles(t).tobytes() for t in frame["text"]]})

    both = rows.select("_file", "_row", "text").join(wanted, ["_file", "_row"])
    return both.select("node", "text").mapInPandas(run, "node long, grams binary")


def least_agreement(percent: int) -> float:
    """Values that must agree before full sets are compared."""
    values, share = 2 * PERMUTATIONS, percent / 100
    return values * share - DEVIATIONS * (values * share * (1 - share)) ** 0.5


def beside(pairs: DataFrame, table: DataFrame, column: str) -> DataFrame:
    """Both nodes' values; a centre of many pairs is split by the adaptive skew join, both inputs being written."""
    one = table.select(F.col("node").alias("b"), F.col(column).alias("y"))
    two = table.select(F.col("node").alias("a"), F.col(column).alias("x"))
    return pairs.join(one, "b").join(two, "a").select("a", "b", "x", "y")


def agreement(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(a, b, same): number of agreeing signature values of each pair that can matter."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if len(frame):
                x = np.frombuffer(b"".join(frame["x"]), "uint8").reshape(len(frame), -1)
                y = np.frombuffer(b"".join(frame["y"]), "uint8").reshape(len(frame), -1)
                same = (x == y).sum(axis=1)
                yield frame.assign(same=same).loc[same >= LOOSE * x.shape[1], ["a", "b", "same"]]

    return settle(beside(pairs, nodes, "short").mapInPandas(run, "a long, b long, same long"))


def confirm(pairs: DataFrame, grams: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets reach the similarity."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            good = []
            for x, y in zip(frame["x"], frame["y"], strict=True):
                x, y = np.frombuffer(x, "uint64"), np.frombuffer(y, "uint64")
                both = len(np.intersect1d(x, y, assume_unique=True))
                good.append(100 * both >= percent * (len(x) + len(y) - both))
            yield frame.loc[np.array(good, bool), ["a", "b"]]

    return settle(beside(pairs, grams, "grams").mapInPandas(run, "a long, b long"))


def merging_links(left: pd.DataFrame, right: pd.DataFrame, percent: int) -> list[tuple[int, int]]:
    """Links between nodes of different parts of two blocks, as many as it takes to merge what is linked."""
    least = least_agreement(percent)
    x = np.frombuffer(b"".join(left["short"]), "uint8").reshape(len(left), -1)
    y = np.frombuffer(b"".join(right["short"]), "uint8").reshape(len(right), -1)
    same = np.zeros((len(x), len(y)), "uint16")
    for value in range(x.shape[1]):
        same += x[:, value, None] == y[None, :, value]
    n, m = left["n"].to_numpy(), right["n"].to_numpy()
    alike = 100 * np.minimum(n[:, None], m[None, :]) >= percent * np.maximum(n[:, None], m[None, :])
    parent: dict[int, int] = {}

    def find(part: int) -> int:
        while parent.setdefault(part, part) != part:
            parent[part] = part = parent[parent[part]]
        return part

    sets = [np.frombuffer(g, "uint64") for g in right["grams"]]
    parts, found = right["part"].to_numpy(), []
    for i, (a, own, raw) in enumerate(zip(left["node"], left["part"], left["grams"], strict=True)):
        mine = np.frombuffer(raw, "uint64")
        roots = {p: find(p) for p in np.unique(parts).tolist()}
        open_ = (same[i] >= least) & alike[i] & np.array([roots[p] != find(own) for p in parts.tolist()])
        at = np.flatnonzero(open_)
        if not len(at):
            continue
        # All candidates of a node at once: their shingles are looked up in the node's sorted set.
        every = np.concatenate([sets[j] for j in at])
        starts = np.cumsum([0] + [len(sets[j]) for j in at[:-1]])
        hit = mine[np.minimum(np.searchsorted(mine, every), len(mine) - 1)] == every
        both = np.add.reduceat(hit, starts, dtype="int64")
        for j in at[100 * both >= percent * (len(mine) + m[at] - both)]:
            one, two = find(own), find(int(parts[j]))
            if one != two:
                parent[max(one, two)] = min(one, two)
                found.append((int(a), int(right["node"].iloc[j])))
    return found


def family_links(family: DataFrame, nodes: DataFrame, grams: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between the parts of each family of ``family(node, family, part)``."""
    weighed = family.join(nodes.select("node", "n"), "node").withColumn("weight", F.greatest("n", F.lit(LEAST_WEIGHT)))
    placed = settle(numbered(weighed, [F.col("family"), F.col("part"), F.col("node")], {"before": "weight"}))
    base = settle(placed.groupBy("family").agg(F.min("before").alias("base")))
    blocks = settle(
        placed.join(base, "family").select(
            "node", "family", "part", F.expr(f"(before - base) div {BLOCK}").cast("long").alias("block")
        )
    )
    spans = settle(blocks.groupBy("family", "block").agg(F.min("part").alias("low"), F.max("part").alias("high")))
    other = spans.select("family", F.col("block").alias("block2"), F.col("low").alias("low2"), F.col("high").alias("high2"))
    # Parts are in order, so two blocks that lie wholly in one part have nothing left to find.
    work = spans.join(other, "family").where(
        (F.col("block") <= F.col("block2")) & ((F.col("low") != F.col("high2")) | (F.col("low2") != F.col("high")))
    )
    sides = work.select(
        "family",
        F.struct("block", "block2").alias("pair"),
        F.explode(F.when(F.col("block") == F.col("block2"), F.array("block")).otherwise(F.array("block", "block2"))).alias(
            "block"
        ),
    )
    rows = (
        blocks.join(settle(sides), ["family", "block"])
        .join(nodes.select("node", "n", "short"), "node")
        .join(grams, "node")
        .select("family", "pair.block", "pair.block2", (F.col("block") == F.col("pair.block")).alias("left"), "node", "part", "n", "short", "grams")
    )

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        one, two = group[group["left"]], group[~group["left"]]
        if not len(two):
            two = one
        return pd.DataFrame(merging_links(one, two, percent), columns=["a", "b"])

    return settle(rows.groupBy("family", "block", "block2").applyInPandas(compare, "a long, b long"))


def chance_pairs(spread: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Distinct (a, b) of different families that share a bucket of ``spread(bucket, node, n, family)`` and whose signatures
    leave the similarity open. A bucket is compared block by block, as for binary codes."""
    least = least_agreement(percent)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in runs(frames):
            if not len(frame):
                continue
            short = np.frombuffer(b"".join(frame["short"]), "uint8").reshape(len(frame), -1)
            n, family, node = (frame[c].to_numpy() for c in ("n", "family", "node"))
            found = set()
            for a, b in pairs_in(frame):
                open_ = (family[a] != family[b]) & (100 * np.minimum(n[a], n[b]) >= percent * np.maximum(n[a], n[b]))
                a, b = a[open_], b[open_]
                good = (short[a] == short[b]).sum(axis=1) >= least
                found.update(zip(np.minimum(node[a], node[b])[good].tolist(), np.maximum(node[a], node[b])[good].tolist(), strict=True))
            yield pd.DataFrame(sorted(found), columns=["a", "b"])

    blocks = in_blocks(spread).join(nodes.select("node", "short"), "node")
    dealt = blocks.repartition("bucket", "lo", "hi").sortWithinPartitions("bucket", "lo", "hi")
    return settle(dealt.mapInPandas(run, "a long, b long").distinct())


def labelled(members: DataFrame, links: DataFrame, name: str) -> DataFrame:
    """Add the component of each node by the links, the node itself where it has none."""
    return members.join(components(links, name), "node", "left").withColumn(name, F.coalesce(name, "node"))


def links(members: DataFrame, nodes: DataFrame, rows: DataFrame, shingle: int, percent: int) -> DataFrame:
    """Confirmed links (a, b) that connect what is linked; ``members(bucket, node, n)`` are the shared buckets."""
    least = least_agreement(percent)
    alike = F.least("n", "m") * 100 >= F.greatest("n", "m") * percent
    centre = F.min(F.struct(F.xxhash64("node").alias("h"), "node", "n")).alias("c")
    centres = settle(members.groupBy("bucket").agg(centre).select("bucket", F.col("c.node").alias("a"), F.col("c.n").alias("m")))
    star = members.join(centres, "bucket").where((F.col("node") != F.col("a")) & alike)
    # A pair that several buckets propose is compared once.
    near = agreement(settle(star.select("a", F.col("node").alias("b")).distinct()), nodes)
    wanted = members.select("node").distinct().join(nodes.select("node", "first"), "node")
    grams = settle(full_sets(rows, wanted.select("node", "first._file", "first._row"), shingle))
    found = confirm(near.where(F.col("same") >= least).select("a", "b"), grams, percent)
    single = settle(members.select("node").distinct())
    # Parts and families in one loop: each node stands for itself twice, as 2 * node and 2 * node + 1.
    twice = found.select(F.expr("2 * a").alias("a"), F.expr("2 * b").alias("b")).unionByName(
        near.select(F.expr("2 * a + 1").alias("a"), F.expr("2 * b + 1").alias("b"))
    )
    both = components(twice, "label")
    of = lambda bit, name: both.where(F.col("node") % 2 == bit).select(F.expr("node div 2").alias("node"), F.expr("label div 2").alias(name))
    named = single.join(of(0, "part"), "node", "left").join(of(1, "family"), "node", "left")
    named = settle(named.select("node", F.coalesce("part", "node").alias("part"), F.coalesce("family", "node").alias("family")))
    # Chance meetings: one bucket, two families. They are compared inside tasks, so only likely pairs are written.
    spread = members.join(named.select("node", "family"), "node")
    mixed_buckets = spread.groupBy("bucket").agg(F.min("family").alias("f1"), F.max("family").alias("f2")).where("f1 <> f2")
    spread = spread.join(mixed_buckets.select("bucket"), "bucket").select("bucket", "node", "n", "family")
    across = confirm(chance_pairs(spread, nodes, percent), grams, percent)
    several = named.groupBy("family").agg(F.min("part").alias("p1"), F.max("part").alias("p2")).where("p1 <> p2")
    inside = family_links(named.join(settle(several.select("family")), "family").select("node", "family", "part"), nodes, grams, percent)
    return settle(found.unionByName(across).unionByName(inside))


def groups(rows: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """(_file, _row, id, n_shingles, component_id, kept) of ``rows(_file, _row, id, text)``.

    ``component_id`` is the smallest id of the group; ``kept`` marks one row of each group, which has this id.
    """
    kind = rows.schema["id"].dataType
    made = settle(sketch(rows, shingle).withColumn("id", F.col("id").cast(kind)))
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "_file", "_row")).alias("first")
    sets = made.where("digest is not null").groupBy("digest").agg(
        first, F.first("n_shingles").alias("n"), F.first("bands").alias("bands"), F.first("short").alias("short")
    )
    nodes = settle(sets.withColumn("node", F.monotonically_increasing_id()))
    entries = nodes.select("node", "n", F.explode("bands").alias("bucket"))
    shared = settle(entries.groupBy("bucket").agg(F.count("*").alias("k")).where("k > 1").select("bucket"))
    members = settle(entries.join(shared, "bucket"))
    named = labelled(nodes.select("node", "digest", "first"), links(members, nodes, rows, shingle, percent), "component")
    smallest = named.groupBy("component").agg(F.min("first").alias("least"))
    # The label of a set belongs to all rows with its digest; copies of one text may be a third of them.
    of_set = settle(named.join(smallest, "component").select("digest", "least"))
    both = made.select("_file", "_row", "id", "n_shingles", "digest").join(of_set, "digest", "left")
    own = F.col("least").isNull()
    stays = (F.col("least._file") == F.col("_file")) & (F.col("least._row") == F.col("_row"))
    return both.select(
        "_file",
        "_row",
        "id",
        "n_shingles",
        F.when(own, F.col("id")).otherwise(F.col("least.id")).alias("component_id"),
        F.when(own, F.lit(True)).otherwise(stays).alias("kept"),
    )


def text_rows(rows: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(_file, _row, id, text) of keyed rows."""
    return rows.select(
        "_file", "_row", F.col(f"_doc.`{id_col}`").alias("id"), F.col(f"_doc.`{text_col}`").alias("text")
    )


def keep_one(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """One document of each group of near copies, with all its columns."""
    rows = keyed(docs)
    kept = groups(text_rows(rows), shingle, percent).where("kept").select("_file", "_row")
    return rows.join(settle(kept), ["_file", "_row"], "left_semi").select("_doc.*")
