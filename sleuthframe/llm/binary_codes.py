"""Near-duplicate embeddings by iterative quantisation and multi-index Hamming tables.

Unit vectors are centred and turned into principal axes; iterative quantisation learns rotations after which the signs of
the coordinates, one bit each, lose least. Several rotations, each from its own random start, make a long code. The code is
cut into substrings, one per table, and vectors with an equal substring meet in a bucket: every pair whose codes differ in
fewer bits than there are tables meets for certain, and most others do. Number and length of the substrings follow from the
number of vectors and from codes of simulated pairs exactly at the threshold, of which no more than ``MISSED`` may stay apart.

Inside a bucket a 64-bit piece of the code is compared first; only vectors that are near some other by it are fetched. Then
pairs are reranked with the original vectors in double precision. A pair counts in the first table in which it meets, so
links are counted once. Equal vectors are one node. A bucket of more than ``BLOCK`` nodes is dealt into blocks by hash,
and pairs of blocks are tasks of their own, so a group of near copies may hold any share of the rows; only counts and the
links that connect a block leave a task, at most one row per node, never the pairs.

Cost: a group of g different vectors that are all near copies of each other takes g^2 / 2 comparisons in each table, inside
tasks, since the number of links of each of them is asked for.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components have no links; vectors of different
lengths are never linked; repeated rows are linked with each other; a null id is never the smallest unless a group has no
other; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sleuthframe.llm.contraction import components
from sleuthframe.llm.tables import keyed, settle
from sleuthframe.llm.whitening import usable

COSINE = 0.95
# Vectors that rotations are learnt from, and simulated pairs; bounds of the fit, never of the search.
FIT_ROWS = 4096
PAIRS = 1000
ITERATIONS = 20
MISSED = 0.005
DEVIATIONS = 6
# Length of the centre at most. Unit vectors then stay at least 1 - FARTHEST away from it, so that pairs at the threshold
# agree in most bits even where all vectors point one way.
FARTHEST = 0.3
BLOCK = 512
# Rows that a task looks through at once, besides those of the bucket it is in.
GATHERED = 20_000
SEED = 5


class Coder(NamedTuple):
    """Centre, one matrix from centred unit vectors to code bits, and the layout of the tables."""

    width: int
    centre: np.ndarray
    turn: np.ndarray
    bits: int
    tables: int
    near: int

    def unit(self, vectors: np.ndarray) -> np.ndarray:
        return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)

    def code(self, units: np.ndarray) -> np.ndarray:
        return (units - self.centre) @ self.turn >= 0

    def substrings(self, code: np.ndarray) -> np.ndarray:
        """One number per row and table."""
        cut = code[:, : self.bits * self.tables].reshape(len(code), self.tables, self.bits)
        return cut @ (np.int64(1) << np.arange(self.bits, dtype="int64"))

    def sketch(self, code: np.ndarray) -> np.ndarray:
        """The first 64 bits."""
        return np.packbits(code[:, :64], axis=1).view("int64").ravel()


def learn_rotation(projected: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Rotation for which the signs of the rotated rows are nearest to the rows."""
    rotation = start
    for _ in range(ITERATIONS):
        signs = np.where(projected @ rotation >= 0, 1.0, -1.0)
        left, _, right = np.linalg.svd(projected.T @ signs)
        rotation = left @ right
    return rotation


def fit_coder(sample: np.ndarray, n: int, cosine: float = COSINE, seed: int = SEED) -> Coder:
    """A coder for ``n`` vectors from a sample of unit vectors."""
    draw = np.random.default_rng(seed)
    width = sample.shape[1]
    centre = sample.mean(axis=0)
    centre *= min(1.0, FARTHEST / max(float(np.linalg.norm(centre)), FARTHEST))
    axes = np.linalg.svd(sample - centre, full_matrices=False)[2] if len(sample) >= width else np.eye(width)
    # Pairs exactly at the threshold, in random directions.
    one = sample[draw.integers(0, len(sample), PAIRS)]
    aside = draw.standard_normal(one.shape)
    aside -= (aside * one).sum(axis=1, keepdims=True) * one
    aside /= np.maximum(np.linalg.norm(aside, axis=1, keepdims=True), 1e-300)
    two = cosine * one + math.sqrt(1 - cosine * cosine) * aside
    bits = min(max(8, math.ceil(math.log2(n + 1)) + 2), 60)
    turns: list[np.ndarray] = []
    agree = np.zeros(PAIRS)

    def more() -> np.ndarray:
        start = np.linalg.qr(draw.standard_normal((width, width)))[0]
        return axes.T @ learn_rotation((sample - centre) @ axes.T, start)

    def agreement(turn: np.ndarray) -> np.ndarray:
        return (((one - centre) @ turn >= 0) == ((two - centre) @ turn >= 0)).sum(axis=1)

    while len(turns) * width < 64:
        turns.append(more())
        agree += agreement(turns[-1])
    tables = 1
    while True:
        meet = (agree / (len(turns) * width)) ** bits
        tables = 1
        while np.mean((1 - meet) ** tables) > MISSED:
            tables += max(1, tables // 16)
        if tables * bits <= len(turns) * width:
            break
        turns.append(more())
        agree += agreement(turns[-1])
    share = 1 - float(np.mean(agree)) / (len(turns) * width)
    near = math.ceil(64 * share + DEVIATIONS * math.sqrt(64 * share * (1 - share)))
    return Coder(width, centre, np.hstack(turns), bits, tables, near)


def _vectors(column: pd.Series, width: int) -> np.ndarray:
    """Rows of equal width; shorter vectors end in zeros."""
    out = np.zeros((len(column), width))
    for i, v in enumerate(column):
        out[i, : len(v)] = v
    return out


def vector_nodes(rows: DataFrame) -> DataFrame:
    """(node, h1, h2, v, k, least): each distinct usable vector of ``rows(id, v, h1, h2)``, its copies and smallest id."""
    least = F.min(F.struct(F.col("id").isNull().alias("none"), "id")).alias("least")
    distinct = rows.where("h1 is not null").groupBy("h1", "h2").agg(F.first("v").alias("v"), F.count("*").alias("k"), least)
    return settle(distinct.withColumn("node", F.monotonically_increasing_id()))


def entries(nodes: DataFrame, coder: Coder) -> DataFrame:
    """(bucket, tab, node, sketch): one row per vector and table."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if not len(frame):
                continue
            code = coder.code(coder.unit(_vectors(frame["v"], coder.width)))
            yield pd.DataFrame(
                {"node": frame["node"], "d": frame["v"].map(len), "sketch": coder.sketch(code), "subs": list(coder.substrings(code))}
            )

    coded = nodes.select("node", "v").mapInPandas(run, "node long, d int, sketch long, subs array<long>")
    parts = coded.select("node", "d", "sketch", F.posexplode("subs").alias("tab", "sub"))
    return parts.select(F.xxhash64("d", "tab", "sub").alias("bucket"), "tab", "node", "sketch")


def in_blocks(rows: DataFrame) -> DataFrame:
    """Rows of buckets that hold several nodes, once for each pair of blocks that they are compared in."""
    sizes = settle(rows.groupBy("bucket").agg(F.count("*").alias("_n")).where("_n > 1"))
    blocks = F.expr(f"cast((_n + {BLOCK - 1}) div {BLOCK} as int)")
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    # One row per bucket joins the entries, so the adaptive join splits a hot bucket.
    dealt = rows.join(sizes, "bucket").withColumn("blocks", blocks).withColumn("own", own)
    with_other = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return with_other.select(
        F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), (F.col("own") < F.col("other")).alias("low"),
        *rows.columns,
    )


def runs(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Frames that hold whole groups of (bucket, lo, hi); rows come in their order."""
    parts: list[pd.DataFrame] = []
    size = 0
    for frame in frames:
        parts.append(frame)
        size += len(frame)
        if size < GATHERED:
            continue
        whole = pd.concat(parts, ignore_index=True)
        key = whole[["bucket", "lo", "hi"]].to_numpy()
        same = (key == key[-1]).all(axis=1)
        first = int(np.flatnonzero(~same)[-1]) + 1 if not same.all() else 0
        if first:
            yield whole.iloc[:first]
        parts = [whole.iloc[first:]]
        size = len(parts[0]) if first else 0
    if parts:
        yield pd.concat(parts, ignore_index=True)


def pairs_in(frame: pd.DataFrame) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (a, b) of the pairs to compare: of one group, in different blocks unless the group is one block."""
    key = frame[["bucket", "lo", "hi"]].to_numpy()
    new = np.append(True, (key[1:] != key[:-1]).any(axis=1))
    starts = np.flatnonzero(new)
    end = np.repeat(np.append(starts[1:], len(key)), np.diff(np.append(starts, len(key))))
    low, split = frame["low"].to_numpy(), (frame["lo"] != frame["hi"]).to_numpy()
    at = np.arange(len(key))
    step = 1
    while len(at):
        at = at[at + step < end[at]]
        good = at[~split[at] | (low[at] != low[at + step])]
        if len(good):
            yield good, good + step
        step += 1


def likely(blocks: DataFrame, coder: Coder) -> DataFrame:
    """The rows of ``blocks`` that are near another by their sketches."""
    near = coder.near

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in runs(frames):
            sketch, alive = frame["sketch"].to_numpy(), np.zeros(len(frame), bool)
            for a, b in pairs_in(frame):
                good = np.bitwise_count((sketch[a] ^ sketch[b]).view("uint64")) <= near
                alive[a[good]] = alive[b[good]] = True
            yield frame.loc[alive, ["bucket", "lo", "hi", "low", "tab", "node"]]

    dealt = blocks.repartition("bucket", "lo", "hi").sortWithinPartitions("bucket", "lo", "hi")
    return settle(dealt.mapInPandas(run, "bucket long, lo int, hi int, low boolean, tab int, node long"))


def _roots(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Smallest place of the component of each of ``n`` places."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def linked(found: DataFrame, nodes: DataFrame, coder: Coder, cosine: float = COSINE) -> DataFrame:
    """(node, root, links): links counted by this group, and a node of the group that the node is connected with."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in runs(frames):
            if not len(frame):
                continue
            node, places = np.unique(frame["node"].to_numpy(), return_inverse=True)
            first = np.unique(places, return_index=True)[1]
            unit = coder.unit(_vectors(frame["v"].iloc[first], coder.width))
            subs = coder.substrings(coder.code(unit))
            copies, tab = frame["k"].to_numpy(), frame["tab"].to_numpy()
            links = np.zeros(len(frame), "int64")
            one, two = [], []
            for a, b in pairs_in(frame):
                x, y = places[a], places[b]
                # Only the first table in which the pair meets.
                mine = (subs[x] == subs[y]).argmax(axis=1) == tab[a]
                a, b, x, y = a[mine], b[mine], x[mine], y[mine]
                good = np.einsum("ij,ij->i", unit[x], unit[y]) >= cosine
                a, b = a[good], b[good]
                links[a] += copies[b]
                links[b] += copies[a]
                one.append(a)
                two.append(b)
            root = _roots(np.concatenate(one), np.concatenate(two), len(frame)) if one else np.arange(len(frame))
            out = pd.DataFrame({"node": node[places], "root": node[places[root]], "links": links})
            yield out[links > 0]

    both = found.join(nodes.select("node", "v", "k"), "node")
    dealt = both.repartition("bucket", "lo", "hi").sortWithinPartitions("bucket", "lo", "hi")
    return settle(dealt.mapInPandas(run, "node long, root long, links long"))


def sample_units(nodes: DataFrame, rows: int, width: int) -> np.ndarray:
    """Unit vectors of the ``rows`` nodes with the smallest hashes."""
    chosen = nodes.orderBy("h2", "h1").limit(rows).select("v").toPandas()
    vectors = _vectors(chosen["v"], width)
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def near_copies(
    vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", cosine: float = COSINE, fit_rows: int = FIT_ROWS
) -> DataFrame:
    """(id, n_links, component_id, kept) of every row."""
    v = F.col(f"_doc.`{vec_col}`")
    is_zero = F.forall(v, lambda c: c == 0)
    good = usable(v) & (F.size(v) > 0) & ~F.coalesce(is_zero, F.lit(True))
    rows = keyed(vectors).select(
        F.col(f"_doc.`{id_col}`").alias("id"),
        F.when(good, v).alias("v"),
        F.when(good, F.xxhash64(v, F.lit("one"))).alias("h1"),
        F.when(good, F.xxhash64(F.lit("two"), v)).alias("h2"),
    )
    nodes = vector_nodes(rows)
    size = nodes.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("width")).first()
    if not size["n"]:
        return rows.select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.lit(True).alias("kept"))
    coder = fit_coder(sample_units(nodes, fit_rows, size["width"]), size["n"], cosine)
    found = linked(likely(in_blocks(entries(nodes, coder)), coder), nodes, coder, cosine)
    counted = found.groupBy("node").agg(F.sum("links").alias("links"))
    edges = found.where("node <> root").select(F.col("root").alias("a"), F.col("node").alias("b")).distinct()
    named = nodes.select("node", "h1", "h2", "k", "least").join(components(edges, "component"), "node", "left")
    named = settle(named.withColumn("component", F.coalesce("component", "node")))
    smallest = named.groupBy("component").agg(F.min("least").alias("smallest"))
    of_vector = settle(
        named.join(smallest, "component")
        .join(counted, "node", "left")
        .select("h1", "h2", (F.coalesce("links", F.lit(0)) + F.col("k") - 1).alias("n_links"), "smallest")
    )
    both = rows.select("id", "h1", "h2").join(of_vector, ["h1", "h2"], "left")
    alone = F.col("n_links").isNull()
    return both.select(
        "id",
        F.coalesce("n_links", F.lit(0)).alias("n_links"),
        F.when(alone, F.col("id")).otherwise(F.col("smallest.id")).alias("component_id"),
        F.when(alone, F.lit(True)).otherwise(F.col("id").eqNullSafe(F.col("smallest.id"))).alias("kept"),
    )
