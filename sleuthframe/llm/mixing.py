"""Time-varying curriculum: sources mixed to target weights, each training position found from cumulative token demand.

Sources share a token budget by weight; none gets more than ``repeat`` times its size, and what it can't take is shared
again. A source's weight follows a schedule over the training run. Its integral, scaled to the target, is the source's
cumulative demand. Documents of a source are shuffled by a seeded hash and pass by, again and again, until the target is
met; the one at the border is taken in part. The middle of what is taken of a document, put through the inverse of the
cumulative demand, is its training position, and rows are range-sorted by it.

Defined cases: a null source is the last source; null and empty texts and texts of blanks have no words, so the mix takes
nothing of them; repeated rows are documents of their own; a source without words has target 0; an empty table gives an
empty result; other columns travel inside ``_doc`` and can't clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sleuthframe.llm.tables import BLANKS, WORD, keyed, numbered, settle, word_count

WEIGHTS = (5.0, 2.0, 1.0)
BUDGET = 1.5
REPEAT = 2
SEED = 29

# Weights at equal steps of the run, linear in between, by rank of the source: level, rising, falling.
SCHEDULES = ((1.0, 1.0), (0.5, 0.75, 1.75), (1.5, 1.0, 0.5))


def targets(
    sources: DataFrame, weights: tuple[float, ...] = WEIGHTS, budget: float = BUDGET, repeat: float = REPEAT
) -> DataFrame:
    """Add weight and target to ``sources(source, source_size)``, which has one row per source.

    Every round shares what the capped sources leave among the others by weight, until none is above its cap. The share
    per unit of weight only rises, so a source that is capped stays so. A round is one sum over the sources.
    """
    ranked = numbered(sources, [F.asc_nulls_last("source")], {"_base": "source_size"}, "_rank")
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("_rank") % len(weights) + 1).cast("int"))
    ranked = settle(ranked.withColumn("weight", weight).withColumn("_cap", F.col("source_size") * F.lit(float(repeat))))
    total = budget * float(ranked.agg(F.sum("source_size")).first()[0] or 0)
    unit = 0.0
    while True:
        capped = F.col("weight") * F.lit(unit) >= F.col("_cap")
        row = ranked.agg(
            F.sum(F.when(capped, F.col("_cap"))).alias("full"), F.sum(F.when(~capped, F.col("weight"))).alias("open")
        ).first()
        if not row["open"]:
            unit = float("inf")
            break
        share = (total - (row["full"] or 0.0)) / row["open"]
        if share <= unit:
            break
        unit = share
    return ranked.withColumn("target", F.least(F.col("_cap"), F.col("weight") * F.lit(unit))).drop("_cap")


def _inverse(area: Column, knots: tuple[float, ...]) -> Column:
    """The time in 0..1 at which the integral of the piecewise linear weights reaches ``area`` of the whole integral."""
    step = 1.0 / (len(knots) - 1)
    parts = [(a + b) / 2 * step for a, b in zip(knots, knots[1:], strict=False)]
    wanted = area * F.lit(sum(parts))
    out, done = None, 0.0
    for i, (a, b, part) in enumerate(zip(knots, knots[1:], parts, strict=False)):
        rest = F.greatest(wanted - F.lit(done), F.lit(0.0))
        # a s + (b - a) s^2 / (2 step) = rest, solved without cancellation.
        root = F.sqrt(F.greatest(F.lit(a * a) + rest * F.lit(2 * (b - a) / step), F.lit(0.0)))
        inside = F.least(rest * 2.0 / (F.lit(a) + root), F.lit(step)) + F.lit(i * step)
        done += part
        out = F.when(wanted <= F.lit(done), inside) if out is None else out.when(wanted <= F.lit(done), inside)
    return out.otherwise(F.lit(1.0))


def curriculum(
    keys: DataFrame,
    weights: tuple[float, ...] = WEIGHTS,
    budget: float = BUDGET,
    repeat: float = REPEAT,
    schedules: tuple[tuple[float, ...], ...] = SCHEDULES,
    seed: int = SEED,
) -> DataFrame:
    """Passes of each row of ``keys(_file, _row, id, source, size)``: one row per document and pass of its source.

    The result has source_size, target, pass, taken (words of this pass, 0 where the target is met before) and position,
    the training position in 0..1, null where nothing is taken.
    """
    # Settled first, so that the words of the texts are counted once.
    ranked = settle(
        keys.select("_file", "_row", "id", "source", "size").withColumns(
            {"_first": F.xxhash64("id", F.lit(seed)), "_mix": F.xxhash64("_file", "_row")}
        )
    )
    sources = settle(ranked.groupBy("source").agg(F.sum("size").cast("long").alias("source_size")))
    # targets() gives each source the sizes of all sources before it, which turn running totals of the table into
    # running totals of the source.
    plan = settle(targets(sources, weights, budget, repeat))
    order = [F.asc_nulls_last("source"), F.col("_first"), F.col("_mix")]
    passing = settle(numbered(ranked, order, {"_run": "size"}).drop("_pos"))
    both = passing.alias("r").join(plan.alias("s"), F.col("r.source").eqNullSafe(F.col("s.source")))
    rounds = F.greatest(F.ceil(F.col("target") / F.col("source_size")).cast("int"), F.lit(1))
    times = F.sequence(F.lit(0), F.coalesce(rounds, F.lit(1)) - 1)
    start = F.col("pass") * F.col("source_size") + F.col("_run") - F.col("_base")
    left = F.round("target").cast("long") - start
    placed = both.select(
        "_file", "_row", "id", "r.source", "size", "source_size", "target", "_rank", "_run", "_base",
        F.explode(times).alias("pass"),
    ).select(
        "_file", "_row", "id", "source", "size", "source_size", "target", "_rank", "pass", start.alias("_start"),
        F.greatest(F.least(left, F.col("size")), F.lit(0)).cast("long").alias("taken"),
    )
    met = F.least((F.col("_start") + F.col("taken") / 2.0) / F.col("target"), F.lit(1.0))
    position = None
    for i, knots in enumerate(schedules):
        mine = F.col("_rank") % len(schedules) == i
        position = F.when(mine, _inverse(met, knots)) if position is None else position.when(mine, _inverse(met, knots))
    return placed.select(
        "_file", "_row", "id", "source", "size", "source_size", "target", "pass", "taken",
        F.when(F.col("taken") > 0, position).alias("position"),
    )


def in_training_order(rows: DataFrame) -> DataFrame:
    """Rows of a curriculum dealt out by ranges of the training position and sorted by it."""
    order = [F.col("position"), F.xxhash64("id", "pass"), F.col("_file"), F.col("_row")]
    return rows.repartitionByRange(*order).sortWithinPartitions(*order)


def document_keys(rows: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The narrow rows that the curriculum works on."""
    return rows.select(
        "_file",
        "_row",
        F.col(f"_doc.`{id_col}`").alias("id"),
        F.col("_doc.source").alias("source"),
        word_count(F.col(f"_doc.`{text_col}`")).alias("size"),
    )


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """(_doc, taken, pass, position): whole rows in training order, repeated as often as the mix takes them.

    ``_doc`` has the columns of ``docs``. Where a pass takes only the first words of a document, its text ends there.
    """
    rows = keyed(docs)
    passes = settle(curriculum(document_keys(rows, id_col, text_col), **options).where("taken > 0"))
    narrow = passes.select("_file", "_row", "id", "size", "pass", "taken", "position")
    both = rows.join(narrow, ["_file", "_row"])
    text = F.col(f"_doc.`{text_col}`")
    # The text up to the end of its last taken word; only the one document at a source's border needs it.
    first_words = F.concat(F.lit(rf"^(?:{BLANKS}*+{WORD}+){{"), F.col("taken").cast("string"), F.lit("}+"))
    head = F.regexp_substr(text, first_words)
    cut = F.when(F.col("taken") < F.col("size"), head).otherwise(text)
    return in_training_order(both.withColumn("_doc", F.col("_doc").withField(f"`{text_col}`", cut))).select(
        "_doc", "taken", "pass", "position"
    )
