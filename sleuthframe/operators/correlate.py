"""Correlation of events into candidate incidents.

Two events are linked when they lie within the window, do not name different devices, and share a device, a
user, a file path or directory, or have related categories. An incident is a connected component of links.

Pairs are never listed. Time is cut into cells as wide as the window. Two events of one cell are always within
the window and events two cells apart never are, so for any shared key

* all events of one (key, cell) are linked with each other, and
* neighbouring cells are linked exactly when ``min(later) - max(earlier) <= window``.

A (key, cell) therefore reduces to counts, minima and maxima before the first shuffle, and what is ordered by
window functions afterwards is one row per cell: its number grows with the covered time, not with the events.

The events are read once, into groups of rows that are alike in all that links compare (``compact``). The groups are
written, and incidents, reasons and signals come from them alone; only the listing of members reads the events again.

The id of an incident is a hash of the set of its rows that can be merged: the number of rows and, in four lanes, the sums of
numbers taken from the SHA-256 of each row's key. Groups carry their lanes, so no task ever sees the rows of an incident.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sleuthframe.functions.columns import (
    category,
    from_micros,
    micros,
    norm_path,
    parent_dir,
    related_reason,
    severity_rank,
    text,
)
from sleuthframe.operators.components import connected_components
from sleuthframe.session import cut_lineage, stored
from sleuthframe.vocabulary import CATEGORIES, INTEGRITY_LABELS

LINKED_CATEGORIES = [c for c in CATEGORIES if c != "other"]
# Ordered (a, b): a row of ``a`` without a device links to any row of ``b``.
DIRECTED = [(a, b) for a in LINKED_CATEGORIES for b in LINKED_CATEGORIES if related_reason(a, b)]
CLIQUE_CATEGORIES = [c for c in LINKED_CATEGORIES if related_reason(c, c)]

# Ids of one incident that are listed in one row. The incident id doesn't depend on it.
IDS_PER_PART = 100_000
# Lanes of the set hash, and hexadecimal digits of a row's SHA-256 that go into each.
LANES = ["d0", "d1", "d2", "d3"]
LANE_DIGITS = 15


@dataclass
class Correlation:
    """Lazy result tables, all keyed by ``incident_id`` (and the ``by`` columns).

    ``fingerprint`` is the whole digest of which ``incident_id`` shows 48 bits. ``groups`` are the compacted rows with the
    component they belong to.
    """

    incidents: DataFrame
    members: DataFrame | None
    reasons: DataFrame
    parts: DataFrame | None
    groups: DataFrame


def features(events: DataFrame, by: list[str] | None = None, label: Column | None = None) -> DataFrame:
    """Correlatable rows with the derived columns that the links compare."""
    path = text("file_path")
    base = events.where(F.col("ts").isNotNull() & (text("source") != "") & (text("event_type") != ""))
    base = base.select(
        *(by or []),
        "id",
        row_key(events.columns).alias("key"),
        micros(F.col("ts")).alias("us"),
        "source",
        "event_type",
        category(F.col("source"), F.col("event_type")).alias("cat"),
        severity_rank(text("severity")).alias("rank"),
        text("user").alias("user"),
        text("device").alias("device"),
        path.alias("path"),
        (label if label is not None else F.lit(None).cast("string")).alias("label"),
    )
    return _with_paths(base)


def _with_paths(rows: DataFrame) -> DataFrame:
    rows = rows.withColumn("npath", F.when(F.col("path") != "", norm_path(F.col("path"))))
    rows = rows.withColumn("dir", parent_dir(F.col("npath")))
    return rows.withColumn(
        "fkey",
        F.when(F.col("dir") != "", F.concat(F.lit("d:"), "dir")).otherwise(F.concat(F.lit("p:"), "npath")),
    )


ROW_TEXT = ["source", "event_type", "description", "severity", "user", "device", "file_path", "metadata"]


def row_key(columns: list[str]) -> Column:
    """Key of a row: its id, or without one a digest of its time and texts, so that rows without ids stay apart."""
    parts = [micros(F.col("ts")).cast("string"), *[F.coalesce(text(c), F.lit("")) for c in ROW_TEXT if c in columns]]
    return F.coalesce(F.col("id").cast("string"), F.concat(F.lit("row:"), F.sha2(F.concat_ws("\x1f", *parts), 256)))


def _lane(i: int) -> Column:
    digits = F.substring(F.sha2(F.col("key"), 256), 1 + i * LANE_DIGITS, LANE_DIGITS)
    return F.conv(digits, 16, 10).cast("decimal(38,0)")


def set_hash() -> Column:
    """Digest of a set of rows from their number and the sums of their lanes."""
    return F.sha2(F.concat_ws(":", F.col("n").cast("string"), *[F.col(x).cast("string") for x in LANES]), 256)


ALIKE = ["cell", "device", "user", "path", "source", "event_type", "label", "tk"]


def compact(rows: DataFrame, by: list[str]) -> DataFrame:
    """Rows alike in what links compare, as one: counts, first and last moment, worst severity and lanes.

    ``rows`` have their cell. ``tk`` keeps rows apart that only a related category can link. Compacting compacted rows with
    others gives the groups of all of them, see ``recompact``.
    """
    return _with_group_key(rows).groupBy(*by, *ALIKE).agg(
        F.count("*").alias("n"),
        F.min("us").alias("lo"),
        F.max("us").alias("hi"),
        F.min(_moment()).alias("first"),
        F.max(_moment()).alias("last"),
        F.max("rank").alias("rank"),
        *[F.sum(_lane(i)).cast("decimal(38,0)").alias(x) for i, x in enumerate(LANES)],
    )


def _with_group_key(rows: DataFrame) -> DataFrame:
    """Add ``tk``: empty, or the row's own key where only a related category can link it."""
    sticky = (
        (F.col("device") != "") | (F.col("user") != "") | F.col("fkey").isNotNull() | F.col("cat").isin(CLIQUE_CATEGORIES)
    )
    return rows.withColumn("tk", F.when(sticky, "").otherwise(F.concat_ws(":", F.col("us").cast("string"), F.col("key"))))


def recompact(groups: DataFrame, by: list[str]) -> DataFrame:
    """Groups of the same key as one."""
    return groups.groupBy(*by, *ALIKE).agg(
        F.sum("n").alias("n"),
        F.min("lo").alias("lo"),
        F.max("hi").alias("hi"),
        F.min("first").alias("first"),
        F.max("last").alias("last"),
        F.max("rank").alias("rank"),
        *[F.sum(x).cast("decimal(38,0)").alias(x) for x in LANES],
    )


def described(groups: DataFrame) -> DataFrame:
    """Groups with the columns that follow from their key."""
    typed = groups.withColumn("cat", category(F.col("source"), F.col("event_type")))
    return _with_paths(typed).withColumn("fk", text("fkey"))


def _node(kind: str, *cols) -> Column:
    """Fixed-width node name of a key; JSON keeps the parts apart."""
    return F.md5(F.to_json(F.struct(F.lit(kind).alias("_k"), *cols)))


LABEL_COUNTS = [f"n_{x.lower()}" for x in INTEGRITY_LABELS]
NAMES = ["sources", "event_types", "cats"]
PROFILE = ["n", "t0", "t1", *NAMES, "top_rank", "defender_rank", "windows_rank", *LABEL_COUNTS, *LANES]


def _profiles(rows: DataFrame, keys: list[str], per_category: bool = False) -> DataFrame:
    """What an incident needs from its members, per key.

    The first step counts per (key, source, event type) with fixed-width buffers, which is a plain hash aggregate on
    the map side; the sets of names are collected from those few rows only.
    """
    grain = rows.groupBy(*keys, "source", "event_type", "kind").agg(
        F.sum("n").alias("n"),
        F.min("lo").alias("t0"),
        F.max("hi").alias("t1"),
        F.max("rank").alias("top_rank"),
        *[F.sum(F.when(F.col("label") == x, F.col("n")).otherwise(0)).alias(f"n_{x.lower()}") for x in INTEGRITY_LABELS],
        *[F.sum(x).cast("decimal(38,0)").alias(x) for x in LANES],
    )
    is_a = lambda c: F.col("kind") == c
    extra = []
    if per_category:
        for c in LINKED_CATEGORIES:
            extra += [
                F.sum(F.when(is_a(c), F.col("n")).otherwise(0)).alias(f"k_{c}"),
                F.min(F.when(is_a(c), F.col("t0"))).alias(f"lo_{c}"),
                F.max(F.when(is_a(c), F.col("t1"))).alias(f"hi_{c}"),
            ]
    return grain.groupBy(*keys).agg(
        F.sum("n").alias("n"),
        F.min("t0").alias("t0"),
        F.max("t1").alias("t1"),
        F.array_sort(F.collect_set("source")).alias("sources"),
        F.array_sort(F.collect_set("event_type")).alias("event_types"),
        F.array_sort(F.collect_set("kind")).alias("cats"),
        F.max("top_rank").alias("top_rank"),
        F.max(F.when(is_a("defender"), F.col("top_rank"))).alias("defender_rank"),
        F.max(F.when(is_a("windows"), F.col("top_rank"))).alias("windows_rank"),
        *[F.sum(c).alias(c) for c in LABEL_COUNTS],
        *[F.sum(x).cast("decimal(38,0)").alias(x) for x in LANES],
        *extra,
    )


def _moment() -> Column:
    """(us, id) as one number, so that its minimum and maximum fit a fixed-width buffer; ids are not negative. Rows without
    an id are ordered by their key."""
    return F.expr("cast(us as decimal(18,0)) * 10000000000000000000BD + cast(coalesce(id, xxhash64(key) & 9223372036854775807) as decimal(19,0))")


def _merge_profile() -> list[Column]:
    return [
        F.sum("n").alias("n"),
        F.min("t0").alias("t0"),
        F.max("t1").alias("t1"),
        *[F.max(c).alias(c) for c in ("top_rank", "defender_rank", "windows_rank")],
        *[F.sum(c).alias(c) for c in LABEL_COUNTS],
        *[F.sum(x).cast("decimal(38,0)").alias(x) for x in LANES],
    ]


def _merged_names(parts: DataFrame, by: list[str]) -> DataFrame:
    """(by, comp, sources, event_types, cats): the distinct names of each component, made distinct before the shuffle."""

    def tagged(name: str) -> Column:
        return F.transform(name, lambda x: F.struct(F.lit(name).alias("of"), x.alias("name")))

    each = parts.select(*by, "comp", F.explode(F.concat(*map(tagged, NAMES))).alias("x")).select(*by, "comp", "x.of", "x.name").distinct()
    return each.groupBy(*by, "comp").agg(
        *[F.array_sort(F.collect_list(F.when(F.col("of") == name, F.col("name")))).alias(name) for name in NAMES]
    )


def priority(cats: Column, defender_rank: Column, windows_rank: Column, top_rank: Column) -> Column:
    """Documented rules, first match wins; then a floor for a CRITICAL member."""
    defender, file, usb = (F.array_contains(cats, c) for c in ("defender", "file", "usb"))
    first = (
        F.when(defender & file, F.when(defender_rank >= 2, "CRITICAL").otherwise("HIGH"))
        .when(defender, "HIGH")
        .when(usb & file, "MEDIUM")
        .when(F.coalesce(windows_rank, F.lit(0)) >= 1, "MEDIUM")
        .otherwise("LOW")
    )
    return F.when((top_rank >= 3) & first.isin("LOW", "MEDIUM"), "HIGH").otherwise(first)


def device_sessions(events: DataFrame, window_seconds: float = 300, by: list[str] | None = None) -> DataFrame:
    """Runs of one device whose inner gaps are at most the window."""
    w_us = _window_us(window_seconds)
    rows = _with_cell(features(events, by), w_us).where("device <> ''")
    cells = rows.groupBy(*(by or []), "device", "cell").agg(
        F.count("*").alias("n"), F.min("us").alias("t0"), F.max("us").alias("t1")
    )
    cells = _sessions(cells, by or [], w_us)
    return (
        cells.groupBy(*(by or []), "device", "session")
        .agg(F.sum("n").alias("n_events"), F.min("t0").alias("t0"), F.max("t1").alias("t1"))
        .select(
            *(by or []),
            "device",
            from_micros(F.col("t0")).alias("start_time"),
            from_micros(F.col("t1")).alias("end_time"),
            "n_events",
        )
    )


def _window_us(window_seconds: float) -> int:
    if window_seconds < 0:
        raise ValueError("window_seconds must be non-negative")
    return int(round(window_seconds * 1_000_000))


def _with_cell(rows: DataFrame, w_us: int) -> DataFrame:
    width = max(w_us, 1)
    return rows.withColumn("cell", F.expr(f"(us - pmod(us, {width}L)) div {width}L"))


def _sessions(cells: DataFrame, by: list[str], w_us: int) -> DataFrame:
    """Number the runs of cells per device; ``session`` is the first cell of the run."""
    order = W.partitionBy(*by, "device").orderBy("cell")
    starts = cells.withColumn("_gap", F.col("t0") - F.lag("t1").over(order)).withColumn(
        "_start", F.when(F.col("_gap").isNull() | (F.col("_gap") > w_us), F.col("cell"))
    )
    return starts.withColumn("session", F.last("_start", ignorenulls=True).over(order)).drop("_gap", "_start")


def _reason_rows(rows: DataFrame, by: list[str], signal: str, reason: Column, *anchor) -> DataFrame:
    return rows.select(*by, *anchor, F.lit(signal).alias("signal"), reason.alias("reason"))


# -- links inside one device ---------------------------------------------------------------------------------


def _device_reasons(rows: DataFrame, cells: DataFrame, by: list[str], w_us: int) -> DataFrame:
    """(by, device, cell, signal, reason): evidence of links between rows of the same device."""
    at = [*by, "device", "cell"]

    def ordered(*keys):
        return W.partitionBy(*by, "device", *keys).orderBy("cell")

    def close(earlier_hi: Column, later_lo: Column) -> Column:
        return F.coalesce(later_lo - earlier_hi <= w_us, F.lit(False))

    users = rows.where("user <> ''").groupBy(*at, "user").agg(
        F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi")
    )
    users = users.withColumn("hit", (F.col("n") >= 2) | close(F.lag("hi").over(ordered("user")), F.col("lo"))).where("hit")
    out = [_reason_rows(users, by, "user", F.concat(F.lit("same user: "), "user"), "device", "cell")]

    # Same path: the earlier row of a pair gives its own spelling.
    spelled = rows.where("npath IS NOT NULL").groupBy(*at, "dir", "npath", "path").agg(
        F.sum("n").alias("n"),
        F.min("lo").alias("lo"),
        F.max("hi").alias("hi"),
        F.max("last").alias("last"),
    )
    paths = spelled.groupBy(*at, "dir", "npath").agg(
        F.min("lo").alias("lo"),
        F.max("hi").alias("hi"),
        F.max("last").alias("all_last"),
    )
    ends = paths.withColumn("next_close", close(F.col("hi"), F.lead("lo").over(ordered("npath"))))
    said = spelled.drop("lo", "hi", "dir").join(ends.drop("lo", "hi", "dir"), [*at, "npath"]).where(
        (F.col("n") >= 2) | (F.col("last") < F.col("all_last")) | F.col("next_close")
    )
    out.append(_reason_rows(said, by, "file", F.concat(F.lit("same file path: "), "path"), "device", "cell"))

    # Same directory, other path: two paths in a cell, or one path here and another one in the close next cell.
    dirs = (
        paths.where("dir <> ''")
        .groupBy(*at, "dir")
        .agg(
            F.min("npath").alias("p0"),
            F.max("npath").alias("p1"),
            F.min("lo").alias("lo"),
            F.max("hi").alias("hi"),
        )
    )
    prev = ordered("dir")
    crossing = close(F.lag("hi").over(prev), F.col("lo")) & (
        (F.lag("p0").over(prev) != F.col("p1")) | (F.lag("p1").over(prev) != F.col("p0"))
    )
    dirs = dirs.withColumn("hit", (F.col("p0") != F.col("p1")) | crossing).where("hit")
    out.append(
        _reason_rows(
            dirs, by, "file", F.concat(F.lit("related file path (same directory): "), "dir"), "device", "cell"
        )
    )

    # Categories: three numbers per category and cell, compared with the cell before.
    before = ordered()
    found = []
    for i, a in enumerate(LINKED_CATEGORIES):
        for b in LINKED_CATEGORIES[i:]:
            said = related_reason(a, b)
            if not said:
                continue
            if a == b:
                here = F.col(f"k_{a}") >= 2
                cross = close(F.lag(f"hi_{a}").over(before), F.col(f"lo_{a}"))
            else:
                here = (F.col(f"k_{a}") > 0) & (F.col(f"k_{b}") > 0)
                cross = close(F.lag(f"hi_{a}").over(before), F.col(f"lo_{b}")) | close(
                    F.lag(f"hi_{b}").over(before), F.col(f"lo_{a}")
                )
            found.append(F.when(here | cross, F.lit(said)))
    typed = cells.withColumn("_r", F.array_compact(F.array(*found))).select(*at, F.explode("_r").alias("r"))
    out.append(_reason_rows(typed, by, "type_relationship", F.col("r"), "device", "cell"))

    merged = out[0]
    for part in out[1:]:
        merged = merged.unionByName(part)
    return merged


# -- links through rows that name no device ------------------------------------------------------------------


def _keyed(rows: DataFrame, by: list[str]) -> DataFrame:
    """One row per user key and per file key of a row."""
    keys = F.array_compact(
        F.array(
            F.when(F.col("user") != "", F.struct(F.lit("user").alias("kind"), F.col("user").alias("key"))),
            F.when(F.col("fkey").isNotNull(), F.struct(F.lit("file").alias("kind"), F.col("fkey").alias("key"))),
        )
    )
    return rows.select(*by, "cell", "device", "n", "lo", "hi", F.explode(keys).alias("k")).select(
        *by, "cell", "device", "n", "lo", "hi", "k.kind", "k.key"
    )


def _hub(by: list[str]) -> Column:
    """A hub stands for the device-less rows that share a key in one cell; they are all linked."""
    return _node("hub", *by, F.col("kind"), F.col("key"), F.col("hub_cell"))


def _bridge(rows: DataFrame, by: list[str], w_us: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Edges, reasons and groups that come from rows without a device.

    Nodes are device sessions (named by their (device, cell) rows until the caller resolves them) and hubs.
    Returns ``edges(by, device, cell, src, dst)`` (``src`` null where the left end is the session of the cell),
    ``reasons(by, node, signal, reason)`` and ``groups(by, cell, user, fk, cat, tk, node, profile...)``.
    """
    loose = rows.where("device = ''")

    # Hubs of shared users and files. Only keys that some device-less row carries can bridge.
    keyed = _keyed(rows, by).groupBy(*by, "kind", "key", "cell", "device").agg(
        F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi")
    )
    hubs = keyed.where("device = ''").select(
        *by,
        "kind",
        "key",
        F.explode(F.array(F.col("cell") - 1, F.col("cell"), F.col("cell") + 1)).alias("near_cell"),
        F.col("cell").alias("hub_cell"),
        F.col("lo").alias("hub_lo"),
        F.col("hi").alias("hub_hi"),
    )
    near = (
        keyed.join(hubs.withColumnRenamed("near_cell", "cell"), [*by, "kind", "key", "cell"])
        .where((F.col("lo") - F.col("hub_hi") <= w_us) & (F.col("hub_lo") - F.col("hi") <= w_us))
        .withColumn("hub", _hub(by))
    )
    own = F.md5(
        F.to_json(F.struct(F.lit("hub").alias("_k"), *by, F.col("kind"), F.col("key"), F.col("cell").alias("hub_cell")))
    )
    touching = near.where((F.col("device") != "") | (F.col("cell") != F.col("hub_cell")) | (F.col("n") >= 2))
    touching = stored(touching.select(*by, "device", "cell", "kind", "key", "hub", own.alias("own")))
    edges = touching.select(
        *by, "device", "cell", F.when(F.col("device") == "", F.col("own")).alias("src"), F.col("hub").alias("dst")
    )
    reasons = [
        touching.where("kind = 'user'").select(
            *by, F.col("hub").alias("node"), F.lit("user").alias("signal"), F.concat(F.lit("same user: "), "key").alias("reason")
        ),
        *_loose_path_reasons(rows, by, w_us),
        *_loose_dir_reasons(rows, by, w_us),
    ]

    # Category relations: rules are one row per (cell, category), however many events there are.
    rules, type_reasons = _category_rules(rows, by, w_us)
    reasons.append(type_reasons)
    seen = rows.groupBy(*by, "cell", "device", "cat").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    fits = F.filter(
        "rules",
        lambda r: (r["min_us"] <= F.col("hi")) & (r["max_us"] >= F.col("lo")) & (~r["loose_only"] | (F.col("device") == "")),
    )
    by_device = (
        seen.where("device <> ''")
        .join(rules, [*by, "cell", "cat"])
        .select(*by, "device", "cell", F.explode(fits).alias("r"))
        .select(*by, "device", "cell", F.lit(None).cast("string").alias("src"), F.col("r.hub").alias("dst"))
    )

    # Device-less rows grouped so that all rows of a group touch the same hubs.
    groups = _profiles(loose.withColumn("kind", F.col("cat")), [*by, *GROUP_KEY])
    hub_of = lambda kind, key: _node(
        "hub", *by, F.lit(kind).alias("kind"), key.alias("key"), F.col("cell").alias("hub_cell")
    )
    type_hubs = F.transform(
        F.filter("rules", lambda r: (r["min_us"] <= F.col("t1")) & (r["max_us"] >= F.col("t0"))), lambda r: r["hub"]
    )
    touched = F.array_compact(
        F.concat(
            F.array(
                F.when(F.col("user") != "", hub_of("user", F.col("user"))),
                F.when(F.col("fk") != "", hub_of("file", F.col("fk"))),
            ),
            F.coalesce(type_hubs, F.array().cast("array<string>")),
        )
    )
    lone = _node("lone", *by, *GROUP_KEY)
    groups = (
        groups.join(rules, [*by, "cell", "cat"], "left")
        .withColumn("hubs", touched)
        .withColumn("node", F.coalesce(F.try_element_at("hubs", F.lit(1)), lone))
        .drop("rules")
    )
    inner = groups.where(F.size("hubs") > 1).select(
        *by,
        F.lit("").alias("device"),
        "cell",
        F.col("node").alias("src"),
        F.explode(F.slice(F.col("hubs"), F.lit(2), F.size("hubs"))).alias("dst"),
    )
    all_edges = edges.unionByName(by_device).unionByName(inner).distinct()
    merged = reasons[0]
    for part in reasons[1:]:
        merged = merged.unionByName(part)
    return all_edges, merged.distinct(), groups.drop("hubs")


GROUP_KEY = ["cell", "user", "fk", "cat", "tk"]


def _file_hub(by: list[str], cell: Column) -> Column:
    return _node("hub", *by, F.lit("file").alias("kind"), F.col("fkey").alias("key"), cell.alias("hub_cell"))


def _loose_path_reasons(rows: DataFrame, by: list[str], w_us: int) -> list[DataFrame]:
    """Same path, at least one row without a device; the earlier row gives the spelling."""
    loose = F.col("device") == ""
    forms = (
        rows.where("npath IS NOT NULL")
        .groupBy(*by, "fkey", "npath", "cell", "path")
        .agg(
            F.min(F.when(loose, F.col("first"))).alias("loose_first"),
            F.max(F.when(loose, F.col("hi"))).alias("loose_hi"),
            F.min(F.when(~loose, F.col("first"))).alias("fixed_first"),
            F.max(F.when(~loose, F.col("hi"))).alias("fixed_hi"),
            F.min("lo").alias("lo"),
            F.min(F.when(loose, F.col("lo"))).alias("loose_lo"),
            F.max(F.when(loose, F.col("last"))).alias("loose_last"),
            F.max("last").alias("last"),
        )
    )
    key = [*by, "fkey", "npath"]
    cells = forms.groupBy(*key, "cell").agg(
        F.max("last").alias("all_last"),
        F.max("loose_last").alias("all_loose_last"),
        F.min("lo").alias("all_lo"),
        F.min("loose_lo").alias("all_loose_lo"),
    )
    here = forms.join(cells.where("all_loose_last IS NOT NULL"), [*key, "cell"]).where(
        (F.col("loose_first") < F.col("all_last")) | (F.col("fixed_first") < F.col("all_loose_last"))
    )
    later = forms.select(*key, "path", "cell", "loose_hi", "fixed_hi").join(
        cells.select(*key, (F.col("cell") - 1).alias("cell"), "all_lo", "all_loose_lo"), [*key, "cell"]
    )
    from_loose = later.where(F.col("all_lo") - F.col("loose_hi") <= w_us)
    to_loose = later.where(F.col("all_loose_lo") - F.col("fixed_hi") <= w_us)
    said = F.concat(F.lit("same file path: "), "path").alias("reason")
    return [
        part.select(*by, _file_hub(by, cell).alias("node"), F.lit("file").alias("signal"), said)
        for part, cell in ((here, F.col("cell")), (from_loose, F.col("cell")), (to_loose, F.col("cell") + 1))
    ]


def _loose_dir_reasons(rows: DataFrame, by: list[str], w_us: int) -> list[DataFrame]:
    """Same directory but another path, at least one row without a device.

    A cell with two paths and a device-less row settles it. Otherwise the single path of the device-less rows is
    compared with each path of the two neighbouring cells: one row against the paths of a cell, never all pairs.
    """
    loose = F.col("device") == ""
    paths = (
        rows.where("dir <> ''")
        .groupBy(*by, "fkey", "dir", "cell", "npath")
        .agg(
            F.min("lo").alias("lo"),
            F.max("hi").alias("hi"),
            F.min(F.when(loose, F.col("lo"))).alias("loose_lo"),
            F.max(F.when(loose, F.col("hi"))).alias("loose_hi"),
        )
    )
    cells = (
        paths.groupBy(*by, "fkey", "dir", "cell")
        .agg(
            F.min("npath").alias("p0"),
            F.max("npath").alias("p1"),
            F.min("loose_lo").alias("loose_lo"),
            F.max("loose_hi").alias("loose_hi"),
        )
        .where("loose_lo IS NOT NULL")
    )
    here = cells.where("p0 <> p1")
    probe = cells.where("p0 = p1").select(
        *by, "fkey", "dir", "p0", "loose_lo", "loose_hi", F.col("cell").alias("hub_cell"),
        F.explode(F.array(F.col("cell") - 1, F.col("cell") + 1)).alias("cell"),
    )
    across = probe.join(paths.drop("loose_lo", "loose_hi"), [*by, "fkey", "dir", "cell"]).where(
        (F.col("npath") != F.col("p0"))
        & (
            ((F.col("cell") > F.col("hub_cell")) & (F.col("lo") - F.col("loose_hi") <= w_us))
            | ((F.col("cell") < F.col("hub_cell")) & (F.col("loose_lo") - F.col("hi") <= w_us))
        )
    )
    said = F.concat(F.lit("related file path (same directory): "), "dir").alias("reason")
    return [
        part.select(*by, _file_hub(by, F.col(cell)).alias("node"), F.lit("file").alias("signal"), said)
        for part, cell in ((here, "cell"), (across, "hub_cell"))
    ]


def _category_rules(rows: DataFrame, by: list[str], w_us: int) -> tuple[DataFrame, DataFrame]:
    """Which rows of a (cell, category) join which relation hub, as time thresholds.

    For a relation ``a -> b`` the linked rows of two neighbouring cells are those of ``a`` up to the window
    before the first ``b``, and those of ``b`` up to the window after the last ``a``; they form one group.
    """
    loose = F.col("device") == ""
    stats = (
        rows.where(F.col("cat") != "other")
        .groupBy(*by, "cell", "cat")
        .agg(
            F.sum("n").alias("n"),
            F.min("lo").alias("lo"),
            F.max("hi").alias("hi"),
            F.sum(F.when(loose, F.col("n")).otherwise(0)).alias("loose_n"),
            F.min(F.when(loose, F.col("lo"))).alias("loose_lo"),
            F.max(F.when(loose, F.col("hi"))).alias("loose_hi"),
        )
    )
    partners = {a: [b for x, b in DIRECTED if x == a] for a in LINKED_CATEGORIES}
    partner = F.create_map(*[F.lit(x) for a in LINKED_CATEGORIES for x in (a, partners[a])])
    a = stats.where("loose_n > 0").select(
        *by,
        F.col("cell").alias("a_cell"),
        F.col("cat").alias("a"),
        "loose_lo",
        "loose_hi",
        F.explode(
            F.flatten(
                F.transform(
                    F.array(F.col("cell") - 1, F.col("cell"), F.col("cell") + 1),
                    lambda c: F.transform(
                        partner[F.col("cat")], lambda p: F.struct(c.alias("cell"), p.alias("cat"))
                    ),
                )
            )
        ).alias("to"),
    ).select(*by, "a_cell", "a", "loose_lo", "loose_hi", "to.cell", "to.cat")
    same = F.col("cell") == F.col("a_cell")
    after = F.col("cell") > F.col("a_cell")
    valid = (
        F.when(same, (F.col("a") != F.col("cat")) | (F.col("n") >= 2))
        .when(after, F.col("lo") - F.col("loose_hi") <= w_us)
        .otherwise(F.col("loose_lo") - F.col("hi") <= w_us)
    )
    hubs = a.join(stats.drop("loose_n", "loose_lo", "loose_hi"), [*by, "cell", "cat"]).where(valid)
    hubs = cut_lineage(hubs.withColumn("hub", _node("type", *by, F.col("a"), F.col("cat"), F.col("a_cell"), F.col("cell"))))
    reason = None
    for x, y in DIRECTED:
        test = (F.col("a") == x) & (F.col("cat") == y)
        said = F.lit(related_reason(x, y))
        reason = F.when(test, said) if reason is None else reason.when(test, said)
    reasons = hubs.select(*by, F.col("hub").alias("node"), F.lit("type_relationship").alias("signal"), reason.alias("reason"))
    low, high = F.lit(-(2**62)), F.lit(2**62)

    def rule(min_us, max_us, loose_only):
        return F.struct(
            F.coalesce(min_us, low).alias("min_us"),
            F.coalesce(max_us, high).alias("max_us"),
            F.lit(loose_only).alias("loose_only"),
            F.col("hub"),
        )

    before = F.col("cell") < F.col("a_cell")
    side_a = hubs.select(
        *by,
        F.col("a_cell").alias("cell"),
        F.col("a").alias("cat"),
        rule(F.when(after, F.col("lo") - w_us), F.when(before, F.col("hi") + w_us), True).alias("rule"),
    )
    side_b = hubs.select(
        *by,
        "cell",
        "cat",
        rule(F.when(before, F.col("loose_lo") - w_us), F.when(after, F.col("loose_hi") + w_us), False).alias("rule"),
    )
    rules = side_a.unionByName(side_b).groupBy(*by, "cell", "cat").agg(F.collect_list("rule").alias("rules"))
    return rules, reasons


# -- assembly ------------------------------------------------------------------------------------------------


def correlate(
    events: DataFrame,
    window_seconds: float = 300,
    min_group_size: int = 2,
    by: list[str] | None = None,
    label: Column | None = None,
    ids_per_part: int = IDS_PER_PART,
) -> Correlation:
    """Group related events into candidate incidents.

    ``by`` keeps groups apart (for example one case per group), ``label`` is an integrity label to count. Rows without
    a device are looked for first; where there are none, nothing has to be linked across devices. ``ids_per_part`` only
    cuts the event list of a large incident into rows.
    """
    w_us = _window_us(window_seconds)
    by = list(by or [])
    rows = _with_cell(features(events, by, label), w_us)
    found = correlate_groups(compact(rows, by), window_seconds, min_group_size, by)
    # Members: each row finds its incident over its (device, cell) or its device-less group.
    homes = found.groups.join(found.incidents.select(*by, "comp", "incident_id", F.col("event_count").alias("size")), [*by, "comp"])
    held = rows.where("device <> ''").select(*by, "device", "cell", "id", "us")
    members = held.join(homes.where("device <> ''").select(*by, "device", "cell", "incident_id", "size").distinct(), [*by, "device", "cell"])
    loose_key = [*by, "cell", "user", "path", "source", "event_type", "tk"]
    loose_homes = homes.where("device = ''").select(*loose_key, "incident_id", "size").distinct()
    loose = _with_group_key(rows.where("device = ''")).select(*loose_key, "id", "us").join(loose_homes, loose_key)
    columns = [*by, "incident_id", "size", "id", "us"]
    members = members.select(*columns).unionByName(loose.select(*columns))
    part = F.pmod(F.xxhash64("id"), F.ceil(F.col("size") / F.lit(ids_per_part))).cast("int").alias("part")
    listed = members.groupBy(*by, "incident_id", part).agg(F.array_sort(F.collect_list(F.struct("us", "id"))).alias("listed"))
    return Correlation(
        incidents=found.incidents.drop("comp"),
        members=members.select(*by, "incident_id", F.col("id").alias("event_id"), from_micros(F.col("us")).alias("ts")),
        reasons=found.reasons.drop("comp"),
        parts=listed.select(*by, "incident_id", "part", F.col("listed.id").alias("event_ids")),
        groups=found.groups,
    )


def correlate_groups(
    groups: DataFrame, window_seconds: float = 300, min_group_size: int = 2, by: list[str] | None = None
) -> Correlation:
    """Incidents of compacted rows. All tables carry ``comp``, the component; there are no members."""
    w_us = _window_us(window_seconds)
    smallest = max(1, int(min_group_size))
    by = list(by or [])
    # Written once, with the columns that follow from the key; everything below reads a few columns of the groups, not the events.
    rows = stored(described(groups))
    bridge = not rows.where("device = ''").isEmpty()

    held = rows.where("device <> ''")
    cells = _profiles(held.withColumn("kind", F.col("cat")), [*by, "device", "cell"], per_category=True)
    cells = _sessions(cells, by, w_us)
    # One row per (device, cell) feeds every table below.
    cells = stored(cells.withColumn("node", _node("session", *by, F.col("device"), F.col("session"))))
    said = _device_reasons(held, cells, by, w_us).join(
        cells.select(*by, "device", "cell", "node"), [*by, "device", "cell"]
    )
    said = said.select(*by, "node", "signal", "reason")
    shared = (
        cells.groupBy(*by, "node", "device").agg(F.sum("n").alias("n")).where("n >= 2").select(
            *by, "node", F.lit("device").alias("signal"), F.concat(F.lit("same device: "), "device").alias("reason")
        )
    )
    said = said.unionByName(shared)
    parts = cells.select(*by, "node", *PROFILE)

    if bridge:
        edges, loose_reasons, loose = _bridge(rows, by, w_us)
        loose, loose_reasons = stored(loose), stored(loose_reasons)
        resolved = edges.join(
            cells.select(*by, "device", "cell", "node"), [*by, "device", "cell"], "left"
        ).select(F.coalesce("src", "node").alias("src"), "dst")
        comps = connected_components(resolved).withColumnRenamed("component", "comp")
        said = said.unionByName(loose_reasons)
        parts = parts.unionByName(loose.select(*by, "node", *PROFILE))

        def settle(df: DataFrame) -> DataFrame:
            return df.join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node")).drop("node")
    else:

        def settle(df: DataFrame) -> DataFrame:
            return df.withColumnRenamed("node", "comp")

    # One row per component, written: all results below start from it.
    resolved_parts = settle(parts)
    whole = resolved_parts.groupBy(*by, "comp").agg(*_merge_profile()).where(F.col("n") >= smallest)
    whole = whole.withColumn("fingerprint", set_hash())
    whole = cut_lineage(whole.withColumn("incident_id", F.concat(F.lit("INC-"), F.substring("fingerprint", 1, 12))))
    named = whole.select(*by, "comp", "incident_id")

    window_text = f"temporal proximity (within {int(window_seconds)}s window)"
    reasons = settle(said).select(*by, "comp", "signal", "reason").distinct()
    always = whole.where("n >= 2").select(
        *by, "comp", F.lit("temporal").alias("signal"), F.lit(window_text).alias("reason")
    )
    reasons = reasons.unionByName(always)
    # Signals need no texts: few rows per node meet the components.
    shown = settle(said.select(*by, "node", "signal").distinct()).select(*by, "comp", "signal")
    shown = shown.unionByName(always.select(*by, "comp", "signal"))
    signals = shown.groupBy(*by, "comp").agg(F.array_sort(F.collect_set("signal")).alias("confidence_signals"))
    incidents = (
        whole.join(_merged_names(resolved_parts, by), [*by, "comp"])
        .join(signals, [*by, "comp"], "left")
        .select(
            *by,
            "comp",
            "incident_id",
            "fingerprint",
            from_micros(F.col("t0")).alias("start_time"),
            from_micros(F.col("t1")).alias("end_time"),
            F.col("n").alias("event_count"),
            "sources",
            "event_types",
            priority(F.col("cats"), F.col("defender_rank"), F.col("windows_rank"), F.col("top_rank")).alias("priority"),
            F.coalesce(F.size("confidence_signals"), F.lit(0)).alias("confidence_score"),
            F.coalesce("confidence_signals", F.array().cast("array<string>")).alias("confidence_signals"),
            *LABEL_COUNTS,
        )
    )
    homes = settle(cells.select(*by, "device", "cell", "node"))
    labelled = held.join(homes, [*by, "device", "cell"]).select(*groups.columns, "comp")
    if bridge:
        key = [*by, *GROUP_KEY]
        loose_homes = settle(loose.select(*key, "node"))
        bare = rows.where("device = ''").join(loose_homes, key)
        labelled = labelled.unionByName(bare.select(*groups.columns, "comp"))
    return Correlation(
        incidents=incidents,
        members=None,
        reasons=reasons.join(named, [*by, "comp"]).select(*by, "comp", "incident_id", "signal", "reason"),
        parts=None,
        groups=labelled,
    )


def in_report_order(incidents: DataFrame, first: int) -> DataFrame:
    """The first incidents of a report, by start and id, with their position from 1."""
    # At most ``first`` rows are left, so numbering them over one window is a bounded step.
    top = incidents.orderBy("start_time", "incident_id").limit(first)
    return top.withColumn("position", F.row_number().over(W.orderBy("start_time", "incident_id")))
