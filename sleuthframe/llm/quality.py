"""Quality rules of documents, and of the hosts that they come from.

Each document is measured once. Two base rules reject a document on their own. Softer rules are too weak for that: they
bind only at hosts where their failures are the custom. Failures are summed by host, each host's rate is shrunk towards a
beta prior that is fitted to all hosts, and the host's verdict is joined back: a document that breaks a soft rule goes if
its host's shrunk rate for this rule, or for the base rules, reaches the limit. A document that breaks no rule stays.

Defined cases: null and empty texts have no words and fail; a null host is a host of its own; repeated rows count each;
an empty table gives an empty result; other columns travel inside ``_doc`` and can't clash.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sleuthframe.llm.tables import WORD, keyed, settle

MIN_WORDS = 50
REPEAT_PERCENT = 50
HOST_LIMIT = 0.5
# The prior counts for as many documents at least: a host of a few documents is never judged by them alone.
PRIOR_LEAST = 10.0
SYMBOLS = "#*$%&|<>"

# Soft rules: name -> condition on the measures under which a document fails.
SOFT = {
    "symbols": "n_symbols * 10 > n_words",
    "lines": "n_dup_lines * 10 > n_lines * 3",
    "length": "word_chars > n_words * 15 OR word_chars < n_words * 2",
    "repeats": "n_repeat_words * 10 > n_words * 3",
}

MEASURES = "n_words long, word_chars long, n_symbols long, n_lines long, n_dup_lines long, n_repeat_words long"


def repeated(words: list[str]) -> int:
    """Words inside three-word windows that occur twice or more."""
    if len(words) < 4:
        return 0
    seen: dict[str, int] = {}
    ids = np.array([seen.setdefault(w, len(seen)) for w in words], "uint64")
    # Two windows are joined in pairs first, so the codes stay exact for any number of words.
    _, pairs = np.unique(ids[:-1] * np.uint64(len(seen)) + ids[1:], return_inverse=True)
    codes = pairs[:-1].astype("uint64") * np.uint64(len(seen)) + ids[2:]
    _, of, times = np.unique(codes, return_inverse=True, return_counts=True)
    often = times[of] > 1
    covered = np.zeros(len(words), bool)
    for shift in range(3):
        covered[shift : shift + len(often)] |= often
    return int(covered.sum())


def measure(rows: DataFrame) -> DataFrame:
    """Measures of ``rows(_file, _row, id, host, text)``; the text is left behind."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        word = re.compile(WORD)
        for frame in frames:
            out = []
            for text in frame.pop("text"):
                text = text or ""
                words = word.findall(text)
                lines = [x for x in text.split("\n") if word.search(x)]
                out.append(
                    (
                        len(words),
                        sum(map(len, words)),
                        sum(map(text.count, SYMBOLS)),
                        len(lines),
                        len(lines) - len(set(lines)),
                        repeated(words),
                    )
                )
            names = [x.split()[0] for x in MEASURES.split(", ")]
            yield pd.concat([frame, pd.DataFrame(out, columns=names, index=frame.index)], axis=1)

    # Ids and hosts travel as text: pandas would turn whole numbers beside a null into floats.
    texts = rows.select("_file", "_row", F.col("id").cast("string"), F.col("host").cast("string"), "text")
    return texts.mapInPandas(run, f"_file long, _row long, id string, host string, {MEASURES}")


def host_rates(judged: DataFrame, rules: list[str]) -> DataFrame:
    """One row per host: documents, failures by rule, and rates shrunk towards the prior of each rule."""
    hosts = settle(
        judged.groupBy("host").agg(
            F.count("*").alias("docs"), *[F.sum(F.col(f"fails_{r}").cast("long")).alias(f"n_{r}") for r in rules]
        )
    )
    # The prior needs four sums per rule over the hosts.
    sums = hosts.agg(
        F.count("*").alias("hosts"),
        F.sum("docs").alias("docs"),
        *[F.sum(f"n_{r}").alias(f"n_{r}") for r in rules],
        *[F.sum(F.col(f"n_{r}") * F.col(f"n_{r}") / F.col("docs")).alias(f"q_{r}") for r in rules],
    ).first()
    out = hosts
    for r in rules:
        a, b = beta_prior(sums["hosts"], sums["docs"] or 0, sums[f"n_{r}"] or 0, sums[f"q_{r}"] or 0.0)
        out = out.withColumn(f"rate_{r}", (F.col(f"n_{r}") + F.lit(a)) / (F.col("docs") + F.lit(a + b)))
    return out


def beta_prior(hosts: int, docs: int, failures: int, squares: float) -> tuple[float, float]:
    """Beta prior by moments: mean of all documents, spread of host rates beyond what chance alone makes.

    ``squares`` is the sum of failures^2 / documents over hosts. Without spread the prior is as strong as the documents of
    an average host, and never weaker than PRIOR_LEAST documents.
    """
    if not docs:
        return 0.5, 0.5
    mean = min(max(failures / docs, 0.5 / docs), 1 - 0.5 / docs)
    strength = docs / hosts
    if hosts > 1:
        between = squares / docs - (failures / docs) ** 2
        chance = mean * (1 - mean) * hosts / docs
        if between > chance:
            strength = min(mean * (1 - mean) / (between - chance) - 1, strength)
    strength = max(strength, PRIOR_LEAST)
    return mean * strength, (1 - mean) * strength


def judge(
    rows: DataFrame, min_words: int = MIN_WORDS, repeat_percent: int = REPEAT_PERCENT, host_limit: float = HOST_LIMIT
) -> DataFrame:
    """Measures with base_failed, failed soft rules and kept, for ``rows(_file, _row, id, host, text)``."""
    base = (F.col("n_words") < min_words) | (F.col("n_repeat_words") * 100 > F.col("n_words") * repeat_percent)
    judged = measure(rows).withColumns(
        {"fails_base": base, **{f"fails_{r}": F.expr(rule) for r, rule in SOFT.items()}}
    )
    judged = settle(judged)
    rules = ["base", *SOFT]
    verdicts = settle(
        host_rates(judged, rules).select("host", *[(F.col(f"rate_{r}") >= host_limit).alias(f"bad_{r}") for r in rules])
    )
    both = judged.alias("d").join(verdicts.alias("h"), F.col("d.host").eqNullSafe(F.col("h.host")), "left")
    against = F.lit(False)
    for r in SOFT:
        against = against | (F.col(f"fails_{r}") & (F.col(f"bad_{r}") | F.col("bad_base")))
    kept = ~F.col("fails_base") & ~F.coalesce(against, F.lit(False))
    return both.select("d.*", F.col("fails_base").alias("base_failed"), kept.alias("kept"))


def judged_rows(docs: DataFrame, id_col: str = "doc_id", host_col: str = "source", text_col: str = "text") -> DataFrame:
    """(_file, _row, id, host, text) of a table."""
    return keyed(docs).select(
        "_file",
        "_row",
        F.col(f"_doc.`{id_col}`").alias("id"),
        F.col(f"_doc.`{host_col}`").alias("host"),
        F.col(f"_doc.`{text_col}`").alias("text"),
    )


def keep_good(docs: DataFrame, **options) -> DataFrame:
    """The documents that the rules keep, with all their columns."""
    rows = keyed(docs)
    texts = rows.select(
        "_file", "_row", F.col("_doc.doc_id").alias("id"), F.col("_doc.source").alias("host"), F.col("_doc.text").alias("text")
    )
    kept = settle(judge(texts, **options).where("kept").select("_file", "_row"))
    return rows.join(kept, ["_file", "_row"], "left_semi").select("_doc.*")
