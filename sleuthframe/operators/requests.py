"""Investigation requests as a table: parsing, validation and retrieval of many requests in one job.

Columns of a request: ``case_id, question, intent, sources, event_types, keywords, user, device, file_path,
severity, start_time, end_time, hour_start, hour_end, max_rows, with_correlation, with_behavior, with_integrity``.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sleuthframe.functions import tagging as tag
from sleuthframe.functions.columns import strip, text
from sleuthframe.operators.retrieve import DEFAULT_LIMIT, contains
from sleuthframe.session import cut_lineage
from sleuthframe.vocabulary import KNOWN_SEVERITIES

LIST = "array<string>"


def parse_questions(questions: DataFrame, default_limit: int = DEFAULT_LIMIT) -> DataFrame:
    """``case_id, question`` to request columns."""
    q, low = F.coalesce("question", F.lit("")), F.col("low")
    lowered = tag.with_lower(questions.select("case_id", "question"), "question")
    return lowered.withColumn("_hours", tag.hour_window(low)).select(
        "case_id",
        q.alias("question"),
        tag.intent(low).alias("intent"),
        tag.source_labels(low).alias("sources"),
        tag.event_type_labels(low).alias("event_types"),
        tag.keyword_tokens(q).alias("keywords"),
        tag.user_token(q).alias("user"),
        tag.device_token(q).alias("device"),
        tag.path_token(q).alias("file_path"),
        tag.severity_label(low).alias("severity"),
        F.lit(None).cast("timestamp_ntz").alias("start_time"),
        F.lit(None).cast("timestamp_ntz").alias("end_time"),
        F.col("_hours.start").alias("hour_start"),
        F.col("_hours.end").alias("hour_end"),
        F.lit(default_limit).alias("max_rows"),
        tag.wants_correlation(low).alias("with_correlation"),
        tag.wants_behavior(low).alias("with_behavior"),
        tag.wants_integrity(low).alias("with_integrity"),
    )


def validate_requests(requests: DataFrame, ceiling: int | None = None) -> DataFrame:
    """Clean the filters; add ``error`` (null when usable) and ``warning`` (null when nothing was changed).

    A caller may name a ``ceiling`` for the limits; without one every request gets as many rows as it asks for.
    """
    severity = F.upper(strip("severity"))
    one_bound = F.col("hour_start").isNull() != F.col("hour_end").isNull()
    outside = ~F.coalesce(F.col("hour_start").between(0, 23), F.lit(True)) | ~F.coalesce(
        F.col("hour_end").between(0, 23), F.lit(True)
    )
    error = (
        F.when(~severity.isin(KNOWN_SEVERITIES), "unsupported severity filter")
        .when(outside, "hours must be between 0 and 23")
        .when(one_bound, "hour_start and hour_end must be provided together")
        .when(F.col("hour_start") > F.col("hour_end"), "hour_start must not be after hour_end")
        .when(F.col("start_time") > F.col("end_time"), "start_time must not be after end_time")
        .when(F.col("max_rows").isNull() | (F.col("max_rows") <= 0), "limit must be a positive integer")
    )
    known_intent = F.col("intent").isin("search", "timeline", "correlation", "behavior", "explain")
    blank_to_null = {c: F.nullif(strip(c), F.lit("")) for c in ("user", "device", "file_path")}
    lists = {c: F.array_distinct(F.coalesce(c, F.array().cast(LIST))) for c in ("sources", "event_types", "keywords")}
    warning, limit = F.lit(None).cast("string"), F.col("max_rows")
    if ceiling is not None:
        said = F.concat(F.lit("requested limit "), limit.cast("string"), F.lit(f" capped at {ceiling}"))
        warning, limit = F.when(limit > ceiling, said), F.least(limit, F.lit(ceiling))
    checked = requests.withColumns({"error": error, "warning": warning})
    return checked.withColumns(
        {
            **blank_to_null,
            **lists,
            "severity": severity,
            "intent": F.when(known_intent, F.col("intent")).otherwise("search"),
            "max_rows": limit,
        }
    )


OVERRIDES = [
    "intent", "sources", "event_types", "keywords", "user", "device", "file_path", "severity", "start_time", "end_time",
    "hour_start", "hour_end", "max_rows", "with_correlation", "with_behavior", "with_integrity",
]


def with_overrides(requests: DataFrame, overrides: DataFrame) -> DataFrame:
    """Requests with the caller's own values: ``overrides`` has ``case_id`` and any of the request columns.

    What a caller names for a case wins over what the question said; null means not named. One row per case.
    """
    named = [c for c in OVERRIDES if c in overrides.columns]
    given = overrides.select("case_id", F.struct(*named).alias("_given"))
    both = requests.join(given, "case_id", "left")
    return both.withColumns({c: F.coalesce(F.col("_given")[c], F.col(c)) for c in named}).drop("_given")


# -- many requests at once -----------------------------------------------------------------------------------

FILTERS = [
    "sources", "event_types", "keywords", "user", "device", "file_path", "severity", "start_time", "end_time",
    "hour_start", "hour_end",
]
# Filters that an event meets by equality, as bits of a pattern.
EXACT = {"device": 1, "user": 2, "severity": 4, "sources": 8, "event_types": 16}
EVENT_SIDE = {"sources": "source", "event_types": "event_type"}
GRAM = 3
# Slots of a table of marks: the events side of a join is thinned out with a quarter of a megabyte, whatever the number of keys.
MARKS = 1 << 18
MARK_ROW = 1 << 15


def _grams(t: Column) -> Column:
    """Distinct pieces of three characters of a text, in lower case."""
    return F.array_distinct(F.regexp_extract_all(F.lower(t), F.lit(f"(?s)(?=({'.' * GRAM}))"), F.lit(1)))


def _slot(key: Column) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(MARKS))


def _marked(keys: DataFrame, c: str) -> Column:
    """Whether the slot of column ``c`` is one that some key falls into: true for every key, and for few other values.

    At most ``MARKS / MARK_ROW`` rows of 4 KB reach the driver.
    """
    slots = keys.select(_slot(F.col(c)).alias("s"))
    rows = slots.groupBy(F.floor(F.col("s") / F.lit(MARK_ROW)).alias("row")).agg(F.bitmap_construct_agg(F.col("s") % MARK_ROW).alias("bits"))
    table = np.zeros(MARKS, dtype=np.uint8)
    for r in rows.collect():
        table[r["row"] * MARK_ROW : (r["row"] + 1) * MARK_ROW] = np.unpackbits(np.frombuffer(r["bits"], dtype=np.uint8), bitorder="little")
    return F.substr(F.lit(table.tobytes()), (_slot(F.col(c)) + 1).cast("int"), F.lit(1)) == F.lit(b"\x01")


def _searched(row: Column | None = None) -> Column:
    """All texts of an event that needles are looked for in; a needle never spans two."""
    get = (lambda c: row[c]) if row is not None else F.col
    return F.concat_ws("\x01", *[F.coalesce(get(c), F.lit("")) for c in ("description", "file_path", "metadata")])


def _matches(r: Column) -> Column:
    """Whether an event meets all filters of a request."""

    def unless_absent(name: str, test: Column) -> Column:
        return r[name].isNull() | test

    listed = lambda name, c: (F.size(r[name]) == 0) | F.array_contains(r[name], F.col(c))
    words = F.forall(
        r["keywords"],
        lambda w: contains(text("description"), w) | contains(text("file_path"), w) | contains(text("metadata"), w),
    )
    return (
        listed("sources", "source")
        & listed("event_types", "event_type")
        & unless_absent("severity", F.col("severity") == r["severity"])
        & unless_absent("user", F.col("user") == r["user"])
        & unless_absent("device", F.col("device") == r["device"])
        & unless_absent("start_time", F.col("ts") >= r["start_time"])
        & unless_absent("end_time", F.col("ts") <= r["end_time"])
        & unless_absent("hour_start", F.hour("ts").between(r["hour_start"], r["hour_end"]))
        & unless_absent("file_path", contains(text("file_path"), r["file_path"]))
        & words
    )


def _request_classes(usable: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Requests with the same filters are one class: (class, r, wanted, pattern, needle) and (class, case_id, max_rows)."""
    lists = {c: F.array_sort(c) for c in ("sources", "event_types", "keywords")}
    alike = usable.withColumns(lists).select("case_id", "max_rows", F.struct(*FILTERS).alias("r"))
    alike = alike.withColumn("class", F.sha2(F.to_json("r", {"ignoreNullFields": "false"}), 256))
    classes = alike.groupBy("class").agg(F.first("r").alias("r"), F.max("max_rows").alias("wanted"))
    given = lambda c: (F.size(F.col("r")[c]) > 0) if c in EVENT_SIDE else F.col("r")[c].isNotNull()
    pattern = sum((F.when(given(c), bit).otherwise(0) for c, bit in EXACT.items()), F.lit(0))
    needles = F.concat(F.col("r.keywords"), F.array_compact(F.array(F.col("r.file_path"))))
    # The longest text that an event must contain.
    longest = F.array_max(F.transform(needles, lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))
    needle = F.when(longest["n"] >= GRAM, longest["w"])
    return classes.withColumns({"pattern": pattern, "needle": needle}), alike.select("class", "case_id", "max_rows")


def _exact_key(pattern: int, value) -> Column:
    parts = [value(c).cast("string") for c, bit in EXACT.items() if pattern & bit]
    return F.concat_ws("\x1f", F.lit(str(pattern)), *parts)


def _postings(classes: DataFrame, patterns: list[int]) -> DataFrame | None:
    """Classes under the values of all their exact filters together; lists give one posting per value."""
    posted = None
    for pattern in patterns:
        mine = classes.where(F.col("pattern") == pattern)
        value = {c: F.col("r")[c] for c in EXACT}
        for c in EVENT_SIDE:
            if pattern & EXACT[c]:
                mine = mine.withColumn(f"_{c}", F.explode(F.array_distinct(F.col("r")[c])))
                value[c] = F.col(f"_{c}")
        part = mine.select("class", "r", "wanted", "_gram", _exact_key(pattern, value.get).alias("_key"))
        posted = part if posted is None else posted.unionByName(part)
    return posted


def _event_keys(patterns: list[int]) -> Column:
    return F.array(*[_exact_key(p, lambda c: F.coalesce(F.col(EVENT_SIDE.get(c, c)), F.lit(""))) for p in patterns])


def _rarest_pieces(events: DataFrame, texts: DataFrame) -> DataFrame:
    """``texts(class, needle, ...)`` with ``_gram``, of the needle's pieces the one that the fewest events have.

    A text with a piece that no event has can't be found and is left out.
    """
    pieces = cut_lineage(texts.select("class", F.explode(_grams(F.col("needle"))).alias("_gram")))
    held = events.select(F.explode(_grams(_searched())).alias("_gram")).where(_marked(pieces, "_gram"))
    common = held.groupBy("_gram").agg(F.count("*").alias("k"))
    rated = pieces.join(common, "_gram", "left").groupBy("class").agg(F.min(F.struct(F.coalesce("k", F.lit(0)).alias("k"), "_gram")).alias("x"))
    return rated.where("x.k > 0").select("class", F.col("x._gram").alias("_gram")).join(texts, "class")


def _meetings(events: DataFrame, classes: DataFrame, plain: list[int], texted: list[int]) -> tuple[DataFrame, DataFrame]:
    """Events under the keys they share with some class, and the classes under theirs: (event columns, _key), (class, r, wanted, _key).

    Events are thinned out by marks before they move, so an event that meets no class is not shuffled.
    """
    posted, keyed = None, None
    if plain:
        mine = classes.where("needle IS NULL").withColumn("_gram", F.lit(""))
        posted = cut_lineage(_postings(mine, plain).drop("_gram"))
        keyed = events.withColumn("_key", F.explode(_event_keys(plain))).where(_marked(posted, "_key"))
    if texted:
        chosen = cut_lineage(_rarest_pieces(events, classes.where("needle IS NOT NULL")))
        both = _postings(chosen, texted).withColumn("_key", F.concat_ws("\x1e", "_key", "_gram"))
        both = cut_lineage(both.drop("_gram"))
        held = events.withColumn("_gram", F.explode(_grams(_searched()))).where(_marked(chosen, "_gram"))
        held = held.withColumn("_key", F.explode(_event_keys(texted))).withColumn("_key", F.concat_ws("\x1e", "_key", "_gram"))
        held = held.where(_marked(both, "_key")).drop("_gram")
        posted = both if posted is None else posted.unionByName(both)
        keyed = held if keyed is None else keyed.unionByName(held)
    return keyed, posted


def batch_retrieve(events: DataFrame, requests: DataFrame) -> DataFrame:
    """Oldest matching events per request, up to the request's own limit, as (case_id, row_no, event columns).

    Requests with the same filters are answered once. Every class of requests is posted under one key, and events meet
    it by an equi-join: the values of all its exact filters together (lists give one posting per value) and, where it names
    a text to be found, the three characters of this text that the fewest events have. Other
    filters are tested on the pairs that meet. Each task sorts its own hits of a class and passes on no more than the largest
    limit asked for, so a class that most events match moves tasks times limit rows.
    """
    # Written once: reading the filters out of questions is costly, and a filter on ``error`` would do it again.
    checked = cut_lineage(validate_requests(requests).select("case_id", "max_rows", "error", *FILTERS))
    usable = checked.where("error IS NULL")
    classes, cases = _request_classes(usable)
    classes = cut_lineage(classes)
    # At most 32 patterns, whatever the requests.
    of = lambda cond: F.sort_array(F.collect_set(F.when(cond, F.col("pattern"))))
    head = classes.agg(
        of(F.col("needle").isNull()).alias("plain"), of(F.col("needle").isNotNull()).alias("texted"), F.max("wanted").alias("most")
    ).first()
    keyed, posted = _meetings(events, classes, head["plain"], head["texted"])
    if keyed is None:
        return events.limit(0).select(F.lit(None).cast(usable.schema["case_id"].dataType).alias("case_id"), F.lit(0).alias("row_no"), *events.columns)
    hits = keyed.join(posted, "_key").drop("_key").where(_matches(F.col("r")))
    order = W.partitionBy("class").orderBy("ts", "id")
    ranked = hits.drop("r").withColumn("row_no", F.row_number().over(order)).where(F.col("row_no") <= F.lit(head["most"] or 0))
    ranked = ranked.where("row_no <= wanted").drop("wanted")
    out = ranked.join(cases, "class").where("row_no <= max_rows")
    return out.select("case_id", "row_no", *events.columns)
