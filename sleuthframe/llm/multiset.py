"""Homomorphic multiset hash of a text's paragraphs.

Every paragraph (a line) is hashed to a wide vector, and the vectors are summed lane by lane modulo powers of two. So the
fingerprint depends on the multiset of paragraphs, not on their order; equal multisets have equal fingerprints; and a
paragraph is put in or taken out by adding or subtracting its vector, without the rest of the text.

Lanes: the number of sentences; EQUAL lanes modulo 2^62, hashed from the whole paragraph, which tell multisets apart; and
64 lanes modulo 2^32, two to a long, which count by sentence of the paragraph one bit each of the sentence's hash. As signs,
these bits project the bag of sentences on 64 random directions, so two fingerprints also tell how alike the texts are.

Only DataFrame functions are used. Defined cases: null text is empty; the empty text has the zero vector (it has one empty
line, which counts nothing); repeated rows are documents of their own; null ids come first; an empty table gives an empty
result; other columns travel inside ``_doc``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sleuthframe.llm.tables import keyed, numbered, settle

EQUAL = 8
PAIRS = 32
LANES = 1 + EQUAL + PAIRS
PAIR_BITS = (1 << 32) | 1
LOW = (1 << 32) - 1
WIDE = (1 << 62) - 1


def lanes_of_hashes(paragraphs: Column, sentences: Column) -> Column:
    """Array of lanes from arrays of 64-bit paragraph and sentence hashes."""
    zero = F.lit(0).cast("long")

    def equal(i: int) -> Column:
        lane = lambda h: F.xxhash64(h, F.lit(i)).bitwiseAND(F.lit(WIDE))
        return F.aggregate(paragraphs, zero, lambda acc, h: (acc + lane(h)).bitwiseAND(F.lit(WIDE)))

    def pair(i: int) -> Column:
        bits = lambda h: F.shiftrightunsigned(h, i).bitwiseAND(F.lit(PAIR_BITS))
        return F.aggregate(sentences, zero, lambda acc, h: acc + bits(h))

    return F.array(
        F.size(sentences).cast("long"), *[equal(i) for i in range(EQUAL)], *[pair(i) for i in range(PAIRS)]
    )


def with_fingerprint(df: DataFrame, text: Column, name: str) -> DataFrame:
    """Add the lanes of a text as an array of longs."""
    lines = F.filter(F.split(text, "\n"), lambda p: p != "")
    spoken = F.filter(F.split(text, r"\n|(?<=[.!?]) "), lambda s: s != "")
    hashed = df.withColumns(
        {
            f"{name}_p": F.transform(lines, lambda p: F.xxhash64(p, F.lit("paragraph"))),
            f"{name}_s": F.transform(spoken, lambda s: F.xxhash64(s, F.lit("sentence"))),
        }
    )
    lanes = lanes_of_hashes(F.col(f"{name}_p"), F.col(f"{name}_s"))
    return hashed.withColumn(name, lanes).drop(f"{name}_p", f"{name}_s")


def combine(one: Column, two: Column, sign: int = 1) -> Column:
    """Lanes of the union of two multisets, or with ``sign`` -1 of the first without the second.

    The halves of a pair lane are added apart, each modulo 2^32.
    """

    def half(x: Column, y: Column, shift: int) -> Column:
        a, b = F.shiftrightunsigned(x, shift).bitwiseAND(F.lit(LOW)), F.shiftrightunsigned(y, shift).bitwiseAND(F.lit(LOW))
        return F.shiftleft((a + b * sign).bitwiseAND(F.lit(LOW)), shift)

    whole = F.zip_with(one, two, lambda x, y: (x + y * sign).bitwiseAND(F.lit(WIDE)))
    halves = F.zip_with(one, two, lambda x, y: half(x, y, 32).bitwiseOR(half(x, y, 0)))
    return F.concat(F.slice(whole, 1, 1 + EQUAL), F.slice(halves, 2 + EQUAL, PAIRS))


def as_text(lanes: Column) -> Column:
    """Fingerprint as text: 16 hexadecimal digits per lane."""
    return F.array_join(F.transform(lanes, lambda x: F.lpad(F.lower(F.hex(x)), 16, "0")), "")


def signs(lanes: Column) -> Column:
    """The 64 projections: sentences whose bit is 0 minus sentences whose bit is 1."""
    n = F.element_at(lanes, 1)
    pairs = F.slice(lanes, 2 + EQUAL, PAIRS)
    low = F.transform(pairs, lambda x: n - x.bitwiseAND(F.lit(LOW)) * 2)
    high = F.transform(pairs, lambda x: n - F.shiftrightunsigned(x, 32) * 2)
    return F.concat(low, high)


def likeness(one: Column, two: Column, one_signs: Column, two_signs: Column) -> Column:
    """0 to 1: 1 for equal fingerprints, about 0 for texts without a sentence in common.

    Estimates 1 - |A - B|^2 / (|A|^2 + |B|^2) of the two bags of sentences.
    """
    square = lambda a: F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x * x)
    apart = square(F.zip_with(one_signs, two_signs, lambda x, y: (x - y).cast("double")))
    total = square(one_signs) + square(two_signs)
    near = F.when(total > 0, F.lit(1.0) - apart / total).otherwise(F.lit(0.0))
    return F.when(one == two, F.lit(1.0)).otherwise(F.least(F.greatest(near, F.lit(0.0)), F.lit(1.0)))


def neighbours(rows: DataFrame) -> DataFrame:
    """For ``rows(_file, _row, id, n_chars, h)``: the key of the document before, and how much of this one it takes.

    Documents stand in ascending order of ids; the first follows the last.
    """
    placed = settle(numbered(rows, [F.asc_nulls_first("id"), F.col("h"), F.col("_file"), F.col("_row")]))
    n = placed.count()
    before = placed.select(
        F.expr(f"(_pos + 1) % {max(n, 1)}").alias("_pos"),
        F.col("_file").alias("to_file"),
        F.col("_row").alias("to_row"),
        F.col("id").alias("to_id"),
        F.expr("n_chars div 2").alias("need"),
    )
    return settle(placed.select("_pos", "_file", "_row").join(before, "_pos").drop("_pos"))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(_file, _row, id, text, lanes) of every document."""
    rows = keyed(docs).select(
        "_file",
        "_row",
        F.col(f"_doc.`{id_col}`").alias("id"),
        F.coalesce(F.col(f"_doc.`{text_col}`"), F.lit("")).alias("text"),
    )
    return with_fingerprint(rows, F.col("text"), "lanes")


def edited(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each document, its edited text, and both fingerprints compared with each other and with the next document's.

    In the edited text the last half of the code points (rounded down) gives way to as many of the next document's first.
    The texts are dealt out once by key; only the heads that a neighbour takes move a second time.
    """
    rows = keyed(docs).select(
        "_file",
        "_row",
        F.col(f"_doc.`{id_col}`").alias("id"),
        F.coalesce(F.col(f"_doc.`{text_col}`"), F.lit("")).alias("text"),
    )
    keys = rows.select("_file", "_row", "id", F.length("text").cast("long").alias("n_chars"), F.xxhash64("text").alias("h"))
    # Both joins read the same columns of the texts, so that Spark deals them out once.
    texts = rows.select("_file", "_row", "text")
    heads = with_fingerprint(texts.join(neighbours(keys), ["_file", "_row"]), F.col("text"), "next_lanes").select(
        F.col("to_file").alias("_file"),
        F.col("to_row").alias("_row"),
        F.col("to_id").alias("id"),
        F.expr("substring(text, 1, cast(need as int))").alias("head"),
        "next_lanes",
    )
    both = texts.join(heads, ["_file", "_row"])
    both = with_fingerprint(both, F.col("text"), "lanes").withColumn("n_chars", F.length("text").cast("long"))
    changed = F.concat(F.expr("substring(text, 1, cast(n_chars - n_chars div 2 as int))"), F.col("head"))
    both = with_fingerprint(both.withColumn("edited", changed), F.col("edited"), "edited_lanes")
    for name in ("lanes", "next_lanes", "edited_lanes"):
        both = both.withColumn(f"{name}_signs", signs(F.col(name)))
    return both
