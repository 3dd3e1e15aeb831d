"""Rules that read filters out of a text column (analyst questions or notes).

Functions with a ``low`` argument take the lower-cased text; ``with_lower`` adds it as a column that is computed once.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sleuthframe.functions.columns import strip

# Ordered patterns and the label each one gives.
SOURCE_RULES = [
    (r"\busb\b|\bremovable\b|\bthumb ?drive\b|\bflash ?drive\b", "USB"),
    (r"\bfile ?system\b|\bfiles?\b|\bfolder\b|\bdirector(?:y|ies)\b", "FileSystem"),
    (r"\bbrowser\b|\bbrowsing\b|\bweb\b|\bwebsite\b|\burl\b|\bvisited?\b", "Browser"),
    (r"\bdefender\b|\bantiviru?s\b|\banti-viru?s\b|\bmalware\b|\bthreat\b|\bvirus\b", "Defender"),
    (r"\bwindows event\b|\bevent log\b|\blog[- ]?on\b|\blog[- ]?in\b|\bsign[- ]?in\b", "Windows"),
]
EVENT_TYPE_RULES = [
    (r"\bdelet(?:e|ed|ion|ions)\b|\bremoved file\b", "FILE_DELETED"),
    (r"\bcreat(?:e|ed|ion|ions)\b|\bnew file\b", "FILE_CREATED"),
    (r"\bmodif(?:y|ied|ication|ications)\b|\bchanged? file\b|\bedited?\b", "FILE_MODIFIED"),
    (r"\brenamed?\b|\brenaming\b", "FILE_RENAMED"),
    (r"\b(?:connect(?:ed|ion)?|plugged ?in|inserted?|mounted)\b", "USB_CONNECTED"),
    (r"\b(?:disconnect(?:ed|ion)?|unplugged|ejected|removed drive)\b", "USB_DISCONNECTED"),
    (r"\bvisit(?:ed|s)?\b|\bbrowsed?\b", "BROWSER_VISIT"),
]
SEVERITY_RULES = [
    (r"\bcritical\b", "CRITICAL"),
    (r"\bhigh[- ]?(?:severity|risk|priority)?\b|\bsevere\b", "HIGH"),
    (r"\bmedium[- ]?severity\b|\bmoderate\b", "MEDIUM"),
    (r"\bwarnings?\b", "WARNING"),
    (r"\blow[- ]?severity\b", "LOW"),
    (r"\binformational\b|\binfo\b", "INFO"),
]
TIMELINE_WORDS = r"\b(timeline|sequence|chronolog|what happened)\b"
CORRELATION_WORDS = r"\b(related|connected|correlat(?:e|ed|ion)|incidents?|linked|together|what else|around (?:this|that|the))\b"
BEHAVIOR_WORDS = r"\b(suspicious|unusual|anomal(?:y|ous|ies)|abnormal|weird|strange|out of the ordinary|off[- ]hours|unexpected)\b"
EXPLAIN_WORDS = r"\b(why|explain|how did|what does this mean|what happened here)\b"
INTEGRITY_WORDS = r"\b(tamper(?:ed|ing)?|integrity|altered|modified evidence|verif(?:y|ied)|chain of custody)\b"
FILENAME = r"[A-Za-z0-9_\-][A-Za-z0-9_\-.]*\.[A-Za-z0-9]{1,8}"
PATH = r"""(?:[A-Za-z]:\\|\\\\|/)[^\s"']+"""
QUOTED = r"""['"]([^'"]{2,})['"]"""
USER = r"""(?i)\buser\s+(?:named\s+|account\s+)?['"]?([A-Za-z0-9._\-\\]+)"""
DEVICE = r"""(?i)\b(?:device|host|hostname|machine|computer|endpoint)\s+['"]?([A-Za-z0-9._\-]+)"""
BETWEEN = r"\bbetween\b\s+(.+?)\s+\band\b\s+(.+)"
AFTER = r"\bafter\b\s+(.+)"
BEFORE = r"\bbefore\b\s+(.+)"
AROUND = r"\b(?:around|about|near|at)\b\s+(.+)"
CLOCK = r"\b(\d{1,2})(?::(\d{2}))?\s*(a\.?m\.?|p\.?m\.?)?\b"

# Texts of which one occurs wherever the pattern matches. Looking for them costs a fraction of the pattern.
NEEDED = dict(zip(
    [p for rules in (SOURCE_RULES, EVENT_TYPE_RULES, SEVERITY_RULES) for p, _ in rules]
    + [TIMELINE_WORDS, CORRELATION_WORDS, BEHAVIOR_WORDS, EXPLAIN_WORDS, INTEGRITY_WORDS, BETWEEN, AFTER, BEFORE, AROUND],
    [
        ["usb", "removable", "drive"], ["file", "folder", "director"], ["brows", "web", "url", "visit"],
        ["defender", "antivir", "anti-vir", "malware", "threat", "virus"], ["windows event", "log", "sign"],
        ["delet", "removed file"], ["creat", "new file"], ["modif", "change", "edite"], ["renam"],
        ["connect", "plugged", "inserte", "mounted"], ["disconnect", "unplugged", "ejected", "removed drive"], ["visit", "browse"],
        ["critical"], ["high", "severe"], ["medium", "moderate"], ["warning"], ["severity"], ["info"],
        ["timeline", "sequence", "chronolog", "what happened"],
        ["related", "connected", "correlat", "incident", "linked", "together", "what else", "around th"],
        ["suspicious", "unusual", "anomal", "abnormal", "weird", "strange", "out of the ordinary", "hours", "unexpected"],
        ["why", "explain", "how did", "what does this mean", "what happened here"],
        ["tamper", "integrity", "altered", "modified evidence", "verif", "chain of custody"],
        ["between"], ["after"], ["before"], ["around", "about", "near", "at"],
    ],
    strict=True,
))


# Word borders, digits and spaces follow Unicode, so an accented letter is part of a word.
UNICODE = "(?U)"


def with_lower(rows: DataFrame, column: str) -> DataFrame:
    """Add ``low``. A generated row keeps it from being merged into each of the many rules that read it."""
    return rows.select("*", F.explode(F.array(F.lower(F.coalesce(column, F.lit(""))))).alias("low"))


def _by_letters(t: Column, match) -> Column:
    """``match(prefix)`` without Unicode character classes where the text is ASCII, which is the same there and cheaper."""
    return F.when(F.octet_length(t) == F.length(t), match("")).otherwise(match(UNICODE))


def _may_have(low: Column, pattern: str) -> Column:
    return reduce(or_, [F.contains(low, F.lit(t)) for t in NEEDED[pattern]])


def _has(low: Column, pattern: str) -> Column:
    return _may_have(low, pattern) & _by_letters(low, lambda prefix: low.rlike(prefix + pattern))


def _once(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, however often ``use`` names it."""
    return F.transform(F.array(value), use)[0]


def _extract(t: Column, pattern: str, group: int) -> Column:
    return _by_letters(t, lambda prefix: F.regexp_extract(t, prefix + pattern, group))


def _extract_all(t: Column, pattern: str, group: int) -> Column:
    return _by_letters(t, lambda prefix: F.regexp_extract_all(t, F.lit(prefix + pattern), F.lit(group)))


def _all_labels(low: Column, rules) -> Column:
    return F.array_compact(F.array(*[F.when(_has(low, p), F.lit(x)) for p, x in rules]))


def source_labels(low: Column) -> Column:
    return _all_labels(low, SOURCE_RULES)


def event_type_labels(low: Column) -> Column:
    return _all_labels(low, EVENT_TYPE_RULES)


def severity_label(low: Column) -> Column:
    """First rule that matches, else null."""
    return F.coalesce(*[F.when(_has(low, p), F.lit(x)) for p, x in SEVERITY_RULES])


def intent(low: Column) -> Column:
    """Later kinds win over earlier ones; plain search when nothing matches."""
    return (
        F.when(_has(low, EXPLAIN_WORDS), "explain")
        .when(_has(low, BEHAVIOR_WORDS), "behavior")
        .when(_has(low, CORRELATION_WORDS), "correlation")
        .when(_has(low, TIMELINE_WORDS), "timeline")
        .otherwise("search")
    )


def wants_correlation(low: Column) -> Column:
    return _has(low, CORRELATION_WORDS) | _has(low, EXPLAIN_WORDS)


def wants_behavior(low: Column) -> Column:
    return _has(low, BEHAVIOR_WORDS) | _has(low, EXPLAIN_WORDS)


def wants_integrity(low: Column) -> Column:
    return _has(low, INTEGRITY_WORDS)


def _found(t: Column, pattern: str, group: int) -> Column:
    return _once(_extract(t, pattern, group), lambda hit: F.when(hit != "", hit))


def path_token(t: Column) -> Column:
    return _found(t, PATH, 0)


def keyword_tokens(t: Column) -> Column:
    """File names, then quoted texts, in order and without repeats."""
    none = F.array().cast("array<string>")
    names = F.when(t.rlike(r"\.[A-Za-z0-9]"), _extract_all(t, FILENAME, 0)).otherwise(none)
    quoted = F.transform(_extract_all(t, QUOTED, 1), lambda q: strip(q))
    return F.array_distinct(F.filter(F.concat(names, quoted), lambda x: x != ""))


def user_token(t: Column) -> Column:
    return _found(t, USER, 1)


def device_token(t: Column) -> Column:
    return _found(t, DEVICE, 1)


def clock_hour(t: Column) -> Column:
    """Hour 0-23 of the first clock time in a lower-cased text, else null."""
    hour = F.regexp_extract(t, UNICODE + CLOCK, 1).try_cast("int")
    half = F.regexp_replace(F.regexp_extract(t, UNICODE + CLOCK, 3), r"\.", "")

    def value(x: Column) -> Column:
        h = x["hour"]
        return F.when((x["half"] == "pm") & (h < 12), h + 12).when((x["half"] == "am") & (h == 12), 0).otherwise(h)

    full = _once(F.struct(hour.alias("hour"), half.alias("half")), value)
    return _once(full, lambda v: F.when(v <= 23, v))


def _hour_after(low: Column, pattern: str, group: int = 1) -> Column:
    return F.when(_may_have(low, pattern), _once(_extract(low, pattern, group), clock_hour))


def hour_window(low: Column) -> Column:
    """struct(start, end): between, after, before, around; null bounds without a clock time."""
    hours = F.struct(
        _hour_after(low, BETWEEN).alias("a"),
        _hour_after(low, BETWEEN, 2).alias("b"),
        _hour_after(low, AFTER).alias("after"),
        _hour_after(low, BEFORE).alias("before"),
        _hour_after(low, AROUND).alias("around"),
    )

    def window(h: Column) -> Column:
        both = h["a"].isNotNull() & h["b"].isNotNull()

        def pick(x, y, z, w):
            return F.when(both, x).when(h["after"].isNotNull(), y).when(h["before"].isNotNull(), z).otherwise(w)

        return F.struct(
            pick(F.least(h["a"], h["b"]), h["after"], F.lit(0), h["around"]).alias("start"),
            pick(F.greatest(h["a"], h["b"]), F.lit(23), h["before"], h["around"]).alias("end"),
        )

    return _once(hours, window)
