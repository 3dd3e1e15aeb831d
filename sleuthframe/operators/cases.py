"""Case packages: evidence, timeline, findings and summaries, as tables keyed by ``case_id``.

A case holds at most 1000 retrieved events, so everything collected per case here is bounded.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sleuthframe.functions.columns import iso, reference_text, text
from sleuthframe.operators import chain, scoring
from sleuthframe.operators.baseline import Baseline, learn
from sleuthframe.operators.correlate import Correlation, correlate
from sleuthframe.operators.requests import batch_retrieve, validate_requests
from sleuthframe.session import cut_lineage, stored

EVIDENCE_LINES = 200
LINE_CHARS = 400
PATH_CHARS = 200

# Standing statements.
NO_EVIDENCE_SUMMARY = "No matching evidence was found in the collected data, so no findings could be established for this investigation."
NO_EVIDENCE_MESSAGE = "No matching evidence was found in the collected data."
NO_EVIDENCE_CONCLUSION = "The available evidence does not contain any events matching the investigation query, so no findings can be established."
LIMIT_SCOPE = "This report reflects only the collected evidence; activity outside that collection is not represented."
LIMIT_CORRELATION = "Event correlation identifies related events; it is not proof of an attack, intrusion, or malicious intent."
LIMIT_BEHAVIOR = "A behavioral anomaly is a deviation from the observed baseline and does not by itself establish malicious activity."
LIMIT_BASELINE = "Behavioral baseline history was insufficient; the anomaly assessment may be unreliable."
LIMIT_INTEGRITY = "A valid hash chain shows the checked records are internally consistent; it does not prove the events are truthful, benign, or that the wider system is trustworthy."
LIMIT_LEGACY = "Some events predate hash-chaining (LEGACY) and could not be cryptographically verified."
LIMIT_BROWSER = "Browser history records that a URL was visited; it does not establish human intent."
NOT_VERIFIED = "Cryptographic integrity verification was not performed for this investigation."
CONSISTENT_CHAIN = "The checked hash chain is internally consistent (this confirms the records were not altered after hashing; it does not prove the events are truthful or benign)."
TRUNCATED = "The result set was truncated at the configured limit; the evidence and timeline may be incomplete."


class CasePackage:
    """The tables of an investigation; each is planned when it is first asked for.

    The baseline and the chain check use the whole history, not the retrieved rows. A case gets correlation, behavior
    or integrity rows only when its request asks for them.
    """

    def __init__(
        self, events: DataFrame, requests: DataFrame, chain_key: str | None = None, window_seconds: float = 300,
        legacy_per_chain: bool = False,
    ):
        self.events, self.chain_key, self.window_seconds = events, chain_key, window_seconds
        self.legacy_per_chain = legacy_per_chain
        self._asked = requests
        self.requests = validate_requests(requests).where("error IS NULL")

    @cached_property
    def asked_for(self) -> set[str]:
        """The analyses that some request asks for; no other reads the history."""
        flags = ["with_correlation", "with_behavior", "with_integrity"]
        row = self.requests.agg(*[F.coalesce(F.bool_or(f), F.lit(False)).alias(f) for f in flags]).first()
        return {f for f in flags if row[f]}

    @cached_property
    def verdicts(self) -> DataFrame:
        """The chain check of the whole history, made once: labels and counts both come from it."""
        found = chain.verdicts(self.events, self.chain_key, legacy_per_chain=self.legacy_per_chain)
        return stored(found.select("id", "state", "reasons"))

    @cached_property
    def found(self) -> DataFrame:
        """Retrieved rows with their integrity label, as many as each request asks for, written once, read by every table."""
        flags = self.requests.select("case_id", "with_correlation", "with_behavior", "with_integrity")
        rows = batch_retrieve(self.events, self._asked).join(flags, "case_id")
        plain = chain.label_column(False)
        if "with_integrity" not in self.asked_for:
            return cut_lineage(rows.withColumn("integrity", plain))
        bad = chain.invalid_rows(self.verdicts).select("id", F.lit(True).alias("_bad"))
        checked = chain.label_column(True, F.coalesce("_bad", F.lit(False)))
        label = F.when(F.col("with_integrity"), checked).otherwise(plain)
        return cut_lineage(rows.join(bad, "id", "left").withColumn("integrity", label).drop("_bad"))

    @cached_property
    def evidence(self) -> DataFrame:
        return evidence_projection(self.found, F.col("integrity"))

    @cached_property
    def correlation(self) -> Correlation:
        rows = self.found.where("with_correlation")
        return correlate(rows, self.window_seconds, by=["case_id"], label=F.col("integrity"))

    @cached_property
    def baseline(self) -> Baseline:
        return learn(self.events).settled()

    @cached_property
    def behavior(self) -> DataFrame:
        rows = self.found.where("with_behavior")
        # Without a request for it there are no rows, and nothing to learn for them.
        known = self.baseline if "with_behavior" in self.asked_for else learn(self.events.limit(0))
        return scoring.anomalies(scoring.score(rows, known, explain=True, keep=["case_id"]))

    @cached_property
    def integrity(self) -> DataFrame:
        return chain.summarize(self.verdicts)

    @cached_property
    def facts(self) -> DataFrame:
        plain = case_facts(self.requests, self.evidence)
        known = self.baseline if "with_behavior" in self.asked_for else None
        checked = self.integrity if "with_integrity" in self.asked_for else None
        return cut_lineage(_with_totals(plain, self.correlation, self.behavior, known, checked))


def evidence_projection(rows: DataFrame, label: Column) -> DataFrame:
    """Evidence records; ``db_backed`` tells whether the event has a stored id."""
    keys = [c for c in ("case_id", "row_no") if c in rows.columns]
    return rows.select(
        *keys,
        F.col("id").alias("event_id"),
        F.col("id").isNotNull().alias("db_backed"),
        "ts",
        *[text(c).alias(c) for c in
          ("source", "event_type", "description", "severity", "user", "device", "file_path", "metadata")],
        label.alias("integrity"),
        reference_text(F.col("id")).alias("reference"),
    )


def timeline(evidence: DataFrame) -> DataFrame:
    """0-based position per case: timed events by time, then untimed ones in retrieval order."""
    order = W.partitionBy("case_id").orderBy(F.col("ts").asc_nulls_last(), "row_no")
    return evidence.withColumn("position", F.row_number().over(order) - 1).withColumn(
        "has_timestamp", F.col("ts").isNotNull()
    )


def _cut(c: str, cap: int | None) -> Column:
    if cap is None:
        return F.col(c)
    return F.when(F.length(c) > cap, F.concat(F.substring(c, 1, cap), F.lit("..."))).otherwise(F.col(c))


def evidence_lines(
    evidence: DataFrame, lines: int | None = None, line_chars: int | None = None, path_chars: int | None = None
) -> DataFrame:
    """Events of a case as one line of text each; the caller may ask for the first ``lines`` and for shorter texts."""
    first = evidence.withColumn("line_no", F.row_number().over(W.partitionBy("case_id").orderBy("row_no")))
    tail = F.concat_ws(
        ", ",
        F.when(F.col("user") != "", F.concat(F.lit("user="), "user")),
        F.when(F.col("device") != "", F.concat(F.lit("device="), "device")),
        F.when(F.col("file_path") != "", F.concat(F.lit("path="), _cut("file_path", path_chars))),
        F.concat(F.lit("integrity="), "integrity"),
    )
    line = F.concat(
        F.lit("- ["), "reference", F.lit("] "), F.coalesce(iso(F.col("ts")), F.lit("unknown-time")), F.lit(" "),
        "source", F.lit("/"), "event_type", F.lit(" ("), "severity", F.lit("): "), _cut("description", line_chars),
        F.lit(" ["), tail, F.lit("]"),
    )
    if lines is not None:
        first = first.where(F.col("line_no") <= lines)
    return first.select("case_id", "line_no", line.alias("line"))


def _sorted_set(c: str) -> Column:
    return F.array_sort(F.collect_set(F.when(F.col(c) != "", F.col(c))))


def case_facts(requests: DataFrame, evidence: DataFrame) -> DataFrame:
    """One row per request: counts, range, sources and types; also for cases without evidence."""
    facts = evidence.groupBy("case_id").agg(
        F.count("*").alias("evidence_count"),
        F.min("ts").alias("first_time"),
        F.max("ts").alias("last_time"),
        F.count_if(F.col("ts").isNull()).alias("untimed"),
        _sorted_set("source").alias("found_sources"),
        _sorted_set("event_type").alias("found_types"),
        F.count_if(F.col("integrity") == "LEGACY").alias("legacy_rows"),
        F.count_if(F.col("source") == "Browser").alias("browser_rows"),
    )
    none = F.array().cast("array<string>")
    return (
        requests.select("case_id", "question", "max_rows", "warning", "with_correlation", "with_behavior", "with_integrity")
        .join(facts, "case_id", "left")
        .na.fill(0, ["evidence_count", "untimed", "legacy_rows", "browser_rows"])
        .withColumn("found_sources", F.coalesce("found_sources", none))
        .withColumn("found_types", F.coalesce("found_types", none))
        .withColumn("truncated", F.col("evidence_count") >= F.col("max_rows"))
    )


def report_ids(requests: DataFrame, evidence: DataFrame) -> DataFrame:
    """Content fingerprint of a case."""
    ids = evidence.groupBy("case_id").agg(
        F.array_sort(F.collect_list(F.col("event_id").cast("string"))).alias("ids"),
        F.min("ts").alias("t0"),
        F.max("ts").alias("t1"),
        F.count("*").alias("n"),
    )
    payload = F.concat_ws(
        "|",
        text("question"),
        F.coalesce(F.array_join("ids", ","), F.lit("")),
        text(iso(F.col("t0"))),
        text(iso(F.col("t1"))),
        F.coalesce("n", F.lit(0)).cast("string"),
    )
    return requests.select("case_id", "question").join(ids, "case_id", "left").select(
        "case_id", F.concat(F.lit("RPT-"), F.substring(F.sha2(payload, 256), 1, 12)).alias("report_id")
    )


def _with_totals(
    facts: DataFrame, related: Correlation, odd: DataFrame, baseline: Baseline | None, integrity: DataFrame | None
) -> DataFrame:
    """Facts plus the number of findings per case, the baseline status and the chain verdict, null where nobody asked."""
    inc = related.incidents.groupBy("case_id").agg(F.count("*").alias("incident_count"))
    ano = odd.groupBy("case_id").agg(
        F.count("*").alias("anomaly_count"), F.array_sort(F.collect_set("classification")).alias("anomaly_classes")
    )
    out = facts.join(inc, "case_id", "left").join(ano, "case_id", "left").na.fill(0, ["incident_count", "anomaly_count"])
    no_status = F.lit(None).cast("struct<status:string,total_events:bigint>")
    no_check = F.lit(None).cast(
        "struct<valid:boolean,checked_events:bigint,hashed_events:bigint,legacy_events:bigint,invalid_events:bigint>"
    )
    status = baseline.totals().select(F.struct("status", "total_events")).scalar() if baseline else no_status
    check = integrity.select(F.struct("*")).scalar() if integrity is not None else no_check
    out = out.withColumn("_s", status).withColumn("_i", check)
    return out.select(
        "*",
        F.when(F.col("with_behavior"), F.col("_s.status")).alias("baseline_status"),
        F.col("_s.total_events").alias("baseline_events"),
        F.when(F.col("with_integrity"), F.col("_i.valid")).alias("chain_valid"),
        F.when(F.col("with_integrity"), F.col("_i.checked_events")).alias("checked_events"),
        F.when(F.col("with_integrity"), F.col("_i.hashed_events")).alias("hashed_events"),
        F.when(F.col("with_integrity"), F.col("_i.legacy_events")).alias("legacy_events"),
        F.when(F.col("with_integrity"), F.col("_i.invalid_events")).alias("invalid_events"),
    ).drop("_s", "_i")


def correlation_findings(related: Correlation) -> DataFrame:
    """Incidents of a case with their ids and reasons as arrays."""
    ids = related.members.groupBy("case_id", "incident_id").agg(
        F.array_sort(F.collect_list(F.struct("ts", "event_id"))).alias("m")
    )
    why = related.reasons.groupBy("case_id", "incident_id").agg(
        F.array_sort(F.collect_set("reason")).alias("correlation_reasons")
    )
    key = ["case_id", "incident_id"]
    out = related.incidents.join(ids, key).join(why, key, "left")
    return out.withColumn("event_ids", F.col("m.event_id")).drop("m")


def integrity_counts(evidence: DataFrame) -> DataFrame:
    """Evidence rows per label and case."""
    return evidence.groupBy("case_id", "integrity").agg(F.count("*").alias("n"))


def _n(c: str) -> Column:
    return F.col(c).cast("string")


def integrity_status(facts: DataFrame) -> DataFrame:
    failed = F.concat(
        F.lit("Hash-chain verification found "), _n("invalid_events"), F.lit(" record(s) that failed integrity checks.")
    )
    older = F.when(
        F.col("legacy_events") > 0,
        F.concat(F.lit(" "), _n("legacy_events"), F.lit(" legacy event(s) predate hash-chaining and could not be cryptographically verified.")),
    ).otherwise("")
    said = F.when(F.col("chain_valid").isNull(), NOT_VERIFIED).otherwise(
        F.concat(F.when(F.col("chain_valid"), CONSISTENT_CHAIN).otherwise(failed), older)
    )
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return facts.select(
        "case_id",
        F.col("chain_valid").isNotNull().alias("available"),
        F.col("chain_valid").alias("valid"),
        zero("checked_events"),
        zero("hashed_events"),
        zero("legacy_events"),
        zero("invalid_events"),
        said.alias("summary"),
    )


def warnings(facts: DataFrame) -> DataFrame:
    """Ordered warnings without repeats, one row each."""
    items = F.array_compact(
        F.array(
            F.col("warning"),
            F.when(
                F.col("baseline_status") == "insufficient_history",
                F.concat(F.lit("behavioral baseline insufficient: "), _n("baseline_events"), F.lit(" event(s), 20 required.")),
            ),
            F.when(
                F.col("untimed") > 0,
                F.concat(_n("untimed"), F.lit(" event(s) had no usable timestamp; they are listed after timestamped events in the timeline.")),
            ),
            F.when(F.col("truncated"), TRUNCATED),
        )
    )
    return facts.select("case_id", F.posexplode(F.array_distinct(items)).alias("position", "warning"))


def limitations(facts: DataFrame) -> DataFrame:
    items = F.array_compact(
        F.array(
            F.lit(LIMIT_SCOPE),
            F.when(F.col("incident_count") > 0, LIMIT_CORRELATION),
            F.when((F.col("anomaly_count") > 0) | F.col("baseline_status").isNotNull(), LIMIT_BEHAVIOR),
            F.when(F.col("baseline_status") == "insufficient_history", LIMIT_BASELINE),
            F.when(F.col("chain_valid").isNotNull(), LIMIT_INTEGRITY),
            F.when(F.col("legacy_rows") > 0, LIMIT_LEGACY),
            F.when(F.col("browser_rows") > 0, LIMIT_BROWSER),
        )
    )
    return facts.select("case_id", F.posexplode(items).alias("position", "limitation"))


def _span(f: str = " between ", g: str = " at ") -> Column:
    first, last = iso(F.col("first_time")), iso(F.col("last_time"))
    return (
        F.when(F.col("first_time").isNull(), "")
        .when(F.col("first_time") == F.col("last_time"), F.concat(F.lit(g), first))
        .otherwise(F.concat(F.lit(f), first, F.lit(" and "), last))
    )


def summaries(facts: DataFrame, per_source: DataFrame) -> DataFrame:
    """One-line summary of a case; ``per_source(case_id, source, n)`` gives the breakdown."""
    shown = per_source.groupBy("case_id").agg(
        F.array_join(
            F.array_sort(F.collect_list(F.concat("source", F.lit("="), F.col("n").cast("string")))), ", "
        ).alias("breakdown")
    )
    insufficient = F.col("baseline_status") == "insufficient_history"
    line = F.concat_ws(
        " ",
        F.concat(F.lit("Retrieved "), _n("evidence_count"), F.lit(" matching event(s) ["), "breakdown", F.lit("].")),
        F.when(
            F.col("first_time").isNotNull(),
            F.concat(F.lit("Time range: "), iso(F.col("first_time")), F.lit(" to "), iso(F.col("last_time")), F.lit(".")),
        ),
        F.when(
            F.col("incident_count") > 0,
            F.concat(_n("incident_count"), F.lit(" candidate incident(s) of related events (correlation, not proof of an attack).")),
        ),
        F.when(
            F.col("anomaly_count") > 0,
            F.concat(_n("anomaly_count"), F.lit(" event(s) deviate from the behavioral baseline (review-worthy, not confirmed malicious).")),
        ).when(insufficient, "Behavioral baseline has insufficient history to assess anomalies."),
        F.when(F.col("chain_valid"), "Integrity: hash chain intact for the checked events.").when(
            ~F.col("chain_valid"),
            F.concat(F.lit("Integrity: chain verification found issues ("), _n("invalid_events"), F.lit(" records).")),
        ),
    )
    return facts.join(shown, "case_id", "left").select(
        "case_id", F.when(F.col("evidence_count") == 0, NO_EVIDENCE_MESSAGE).otherwise(line).alias("summary")
    )


def sentences(facts: DataFrame) -> DataFrame:
    """Executive summary and conclusion."""
    sources = F.array_join("found_sources", ", ")
    insufficient = F.col("baseline_status") == "insufficient_history"
    executive = F.concat(
        F.lit("The investigation retrieved "), _n("evidence_count"), F.lit(" event(s)"), _span(),
        F.when(F.size("found_sources") > 0, F.concat(F.lit(" from source(s): "), sources)).otherwise(""), F.lit("."),
        F.when(F.col("incident_count") > 0, F.concat(F.lit(" "), _n("incident_count"), F.lit(" candidate incident(s) of related events were identified through correlation (related events, not a confirmed attack)."))).otherwise(""),
        F.when(F.col("anomaly_count") > 0, F.concat(F.lit(" "), _n("anomaly_count"), F.lit(" event(s) deviated from the available behavioral baseline (review-worthy, not confirmed malicious activity).")))
        .when(insufficient, " Behavioral baseline history was insufficient to assess anomalies.").otherwise(""),
        F.when(F.col("chain_valid"), " The checked hash chain was internally consistent.")
        .when(~F.col("chain_valid"), " Hash-chain verification reported integrity issues.").otherwise(""),
    )
    conclusion = F.concat_ws(
        " ",
        F.concat(F.lit("The available evidence shows "), _n("evidence_count"), F.lit(" event(s)"), _span(), F.lit(" from source(s): "), sources, F.lit(".")),
        F.when(F.col("incident_count") > 0, F.concat(F.lit("The correlation engine identified "), _n("incident_count"), F.lit(" candidate incident(s) of related events; this establishes a relationship between the events, not a confirmed attack, intrusion, or intent."))),
        F.when(F.col("anomaly_count") > 0, F.concat(F.lit("The behavioral engine classified "), _n("anomaly_count"), F.lit(" event(s) as "), F.array_join("anomaly_classes", ", "), F.lit(" relative to the available baseline; this indicates deviation from observed patterns, not confirmed malicious activity.")))
        .when(insufficient, "The behavioral baseline had insufficient history, so no reliable anomaly determination was made."),
        F.when(F.col("chain_valid"), "The integrity check found the checked hash chain to be internally consistent.")
        .when(~F.col("chain_valid"), F.concat(F.lit("The integrity check found "), _n("invalid_events"), F.lit(" record(s) that failed verification.")))
        .otherwise("Cryptographic integrity verification was not performed for this evidence."),
    )
    empty = F.col("evidence_count") == 0
    return facts.select(
        "case_id",
        F.when(empty, NO_EVIDENCE_SUMMARY).otherwise(executive).alias("executive_summary"),
        F.when(empty, NO_EVIDENCE_CONCLUSION).otherwise(conclusion).alias("conclusion"),
    )


def buckets(facts: DataFrame, related: Correlation, odd: DataFrame) -> DataFrame:
    """Observed facts, correlation, behavior and integrity statements, kept apart: (case_id, bucket, statement)."""
    observed = F.array_compact(
        F.array(
            F.when(F.col("evidence_count") == 0, F.lit("No evidence events were retrieved.")).otherwise(
                F.concat(_n("evidence_count"), F.lit(" event(s) were retrieved from source(s): "), F.array_join("found_sources", ", "), F.lit("."))
            ),
            F.when(F.col("first_time").isNotNull(), F.concat(F.lit("The earliest event occurred at "), iso(F.col("first_time")), F.lit(" and the latest at "), iso(F.col("last_time")), F.lit("."))),
            F.when(F.col("untimed") > 0, F.concat(_n("untimed"), F.lit(" event(s) had no usable timestamp and are not placed by time on the chronological timeline."))),
            F.when(F.size("found_types") > 0, F.concat(F.lit("Observed event type(s): "), F.array_join("found_types", ", "), F.lit("."))),
        )
    )
    a = facts.select("case_id", F.lit("observed_facts").alias("bucket"), F.explode(observed).alias("statement"))
    b = correlation_findings(related).select(
        "case_id",
        F.lit("correlation_findings").alias("bucket"),
        F.concat(
            F.lit("Candidate incident "), "incident_id", F.lit(" ("), "priority", F.lit(" priority) groups events ["),
            F.array_join(F.transform("event_ids", lambda i: i.cast("string")), ", "),
            F.lit("] as related because: "), F.array_join("correlation_reasons", "; "), F.lit("."),
        ).alias("statement"),
    )
    c = odd.select(
        "case_id",
        F.lit("behavioral_findings").alias("bucket"),
        F.concat(
            reference_text(F.col("id")), F.lit(" was classified "), "classification", F.lit(" (score "),
            F.col("anomaly_score").cast("string"), F.lit(") relative to the available baseline: "),
            F.array_join("reasons", "; "), F.lit("."),
        ).alias("statement"),
    )
    short = facts.where((F.col("baseline_status") == "insufficient_history") & (F.col("anomaly_count") == 0)).select(
        "case_id",
        F.lit("behavioral_findings").alias("bucket"),
        F.lit("Behavioral baseline history was insufficient to assess anomalies.").alias("statement"),
    )
    d = integrity_status(facts).select("case_id", F.lit("integrity_findings").alias("bucket"), F.col("summary").alias("statement"))
    return a.unionByName(b).unionByName(c).unionByName(short).unionByName(d)
