"""Personal data in texts: patterns propose spans, validators confirm them, nearby words adjust the score.

A kind of span has a pattern, a validator (digit counts, the Luhn sum, the remainder modulo 97, parts of an address) and a
prior score. Context words in the WINDOW characters before a span or right after it raise its score, counter words lower
it. The four base kinds are kept whenever their validator agrees; the kinds that the method adds need the score LIMIT.

All work is one pass of DataFrame functions per row, without a shuffle: the text between the matches of a pattern
(split) and the matches themselves (regexp_extract_all) give the places by running sums of lengths in code points.
The patterns use possessive loops, which neither backtrack nor recurse on long inputs, and start only where a run of
their characters starts or where the last match ended, so that a long run is read once.

Defined cases: null and empty texts have no spans; repeated rows are documents of their own; an empty table gives an
empty result; other columns stay as they are in ``redact``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WINDOW = 40
LIMIT = 0.5
NEAR = 0.35
AGAINST = 0.3

LOCAL = "[A-Za-z0-9._%+-]"
LABEL = "[A-Za-z0-9-]"


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str
    prior: float
    context: str  # pattern of words that speak for it
    base: bool = False
    marks: str = ""  # characters one of which every match has; a text without them is not searched


KINDS = (
    Kind(
        "email",
        rf"(?:\G|(?<!{LOCAL})){LOCAL}++@{LABEL}++(?:\.{LABEL}++)++",
        0.9,
        "mail|contact|kontakt|courriel",
        True,
        "@",
    ),
    Kind("ip", r"(?=[0-9])(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", 0.6, r"\bip\b|address|server|host|adresse", True),
    # A run of digits with single blanks or hyphens in between, 16 to 19 digits in all.
    Kind(
        "card",
        r"(?=[0-9])(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){15,18}(?![\x20-]?[0-9])",
        0.7,
        "card|visa|master|credit|karte|carte|tarjeta",
        True,
    ),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", 0.7, "phone|tel|call|mobile|fax|handy", True, "+"),
    # Added by the method: account numbers, cards of 13 to 15 digits, phone numbers without a plus, identity numbers.
    Kind("iban", r"(?=[A-Z])(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}(?![A-Za-z0-9])", 0.8, "iban|account|konto|bank|compte"),
    Kind(
        "short_card",
        r"(?=[0-9])(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){12,14}(?![\x20-]?[0-9])",
        0.2,
        "card|visa|amex|credit|karte|carte|tarjeta",
    ),
    Kind(
        "local_phone",
        r"(?=[(0-9])(?<![0-9+().\x20-])(?:\([0-9]{2,5}\)\x20?|[0-9]{2,5}[\x20-])[0-9]{3,4}[\x20-][0-9]{3,5}(?![0-9-])",
        0.2,
        "phone|tel|call|mobile|fax|handy",
    ),
    Kind("ssn", r"(?=[0-9])(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", 0.4, "ssn|social security|identity"),
)
BASE = tuple(k.name for k in KINDS if k.base)
# Words that speak against numbers of any kind.
COUNTER = "invoice|order no|serial|version|isbn|tracking|example only"


def add_running(df: DataFrame, values: str, name: str, block: int = 256) -> DataFrame:
    """Add the running sums of an array of numbers, summed inside blocks first, so a long array doesn't cost its square.

    What a lambda reads from outside is a column of its own, as Spark evaluates a lambda's body anew for each element.
    """
    zero, none = F.lit(0).cast("long"), F.array().cast("array<bigint>")

    def sums(items: Column, base: Column) -> Column:
        last = lambda acc: F.when(F.size(acc) > 0, F.element_at(acc, -1)).otherwise(base)
        return F.aggregate(items, none, lambda acc, x: F.concat(acc, F.array(last(acc) + x)))

    size = F.size(values)
    starts = F.when(size > 0, F.sequence(F.lit(0), ((size - 1) / block).cast("int"))).otherwise(
        F.array().cast("array<int>")
    )
    blocks, totals, ends = f"{name}_blocks", f"{name}_totals", f"{name}_ends"
    df = df.withColumn(blocks, F.transform(starts, lambda b: F.slice(F.col(values), b * block + 1, F.lit(block))))
    df = df.withColumn(totals, F.transform(blocks, lambda b: F.aggregate(b, zero, lambda acc, x: acc + x)))
    df = df.withColumn(ends, sums(F.col(totals), zero))
    bases = F.zip_with(ends, totals, lambda e, t: e - t)
    return df.withColumn(name, F.flatten(F.zip_with(blocks, bases, sums))).drop(blocks, totals, ends)


def digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Sum of the Luhn check divides by ten; every second digit from the right counts double."""
    back = F.reverse(number)
    places = F.sequence(F.lit(1), F.length(number))
    one = lambda i: F.substr(back, i, F.lit(1)).cast("int")
    twice = lambda d: d * 2 - F.when(d > 4, 9).otherwise(0)
    total = F.aggregate(
        places, F.lit(0), lambda acc, i: acc + F.when(i % 2 == 0, twice(one(i))).otherwise(one(i))
    )
    return total % 10 == 0


def mod97(account: Column) -> Column:
    """An account number is valid if, its first four signs moved to the end and letters read as 10 to 35, it is 1 mod 97."""
    plain = F.replace(account, F.lit(" "), F.lit(""))
    moved = F.concat(F.substr(plain, F.lit(5), F.length(plain)), F.substr(plain, F.lit(1), F.lit(4)))
    places = F.sequence(F.lit(1), F.length(moved))

    def step(acc: Column, i: Column) -> Column:
        sign = F.ascii(F.substr(moved, i, F.lit(1)))
        return F.when(sign < 58, acc * 10 + sign - 48).otherwise(acc * 100 + sign - 55) % 97

    return F.length(plain).between(15, 34) & (F.aggregate(places, F.lit(0), step) == 1)


def valid(kind: str, match: Column) -> Column:
    """The validator of a kind."""
    number = digits(match)
    if kind == "ip":
        part = r"0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
        return match.rlike(rf"^{part}\.{part}\.{part}\.{part}$")
    if kind == "card":
        return F.length(number).between(16, 19) & luhn(number)
    if kind == "phone":
        return F.length(number).between(8, 15)
    if kind == "iban":
        return mod97(match)
    if kind == "short_card":
        return F.length(number).between(13, 15) & luhn(number) & ~number.rlike("^0")
    if kind == "local_phone":
        return F.length(number).between(8, 13)
    if kind == "ssn":
        return ~match.rlike("^(?:000|666|9..)-") & ~match.rlike("-00-") & ~match.rlike("-0000$")
    return F.lit(True)


SPAN = "array<struct<kind:string,start:bigint,end:bigint,score:double,match:string>>"


def add_spans(df: DataFrame, text: Column, kind: Kind, name: str) -> DataFrame:
    """Add the confirmed and scored spans of one kind, in order of their starts; ends are exclusive, in code points."""
    found, gaps, lengths, ends = f"{name}_found", f"{name}_gaps", f"{name}_lengths", f"{name}_to"
    none = F.array().cast("array<string>")
    matches = F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0))
    searched = F.contains(text, F.lit(kind.marks)) if kind.marks else text.isNotNull()
    df = df.withColumn(found, F.when(searched, matches).otherwise(none))
    df = df.withColumn(gaps, F.when(F.size(found) > 0, F.split(text, kind.pattern, -1)).otherwise(none))
    both = F.zip_with(gaps, found, lambda g, m: (F.length(g) + F.length(m)).cast("long"))
    # One gap more than matches: the last has no end of a match.
    df = df.withColumn(lengths, F.slice(both, F.lit(1), F.size(found)))
    df = add_running(df, lengths, ends)

    def span(match: Column, i: Column) -> Column:
        end = F.get(ends, i)
        before, after = F.right(F.get(gaps, i), F.lit(WINDOW)), F.left(F.get(gaps, i + 1), F.lit(WINDOW))
        near = F.lower(F.concat(before, F.lit(" "), after))
        score = (
            F.lit(kind.prior)
            + F.when(near.rlike(kind.context), NEAR).otherwise(0.0)
            - F.when(near.rlike(COUNTER), AGAINST).otherwise(0.0)
        )
        return F.struct(
            F.lit(kind.name).alias("kind"),
            (end - F.length(match)).cast("bigint").alias("start"),
            end.cast("bigint").alias("end"),
            F.least(F.greatest(score, F.lit(0.0)), F.lit(1.0)).alias("score"),
            match.alias("match"),
        )

    spans = F.filter(F.transform(found, span), lambda s: valid(kind.name, s["match"]))
    if not kind.base:
        spans = F.filter(spans, lambda s: s["score"] >= LIMIT)
    kept = F.when(F.size(found) > 0, spans).otherwise(F.array().cast(SPAN)).cast(SPAN)
    return df.withColumn(name, kept).drop(found, gaps, lengths, ends)


def overlaps(one: Column, two: Column) -> Column:
    return (one["start"] < two["end"]) & (two["start"] < one["end"])


def find(df: DataFrame, text: Column, name: str = "spans") -> DataFrame:
    """Add ``name``: all spans, by kind as listed, then by start. An added span that overlaps a base span goes."""
    for kind in KINDS:
        df = add_spans(df, text, kind, f"_{name}_{kind.name}")
    base = F.concat(*[F.col(f"_{name}_{k.name}") for k in KINDS if k.base])
    df = df.withColumn(f"_{name}_base", base)
    held = F.col(f"_{name}_base")
    added = [
        F.filter(F.col(f"_{name}_{k.name}"), lambda s: ~F.exists(held, lambda b: overlaps(s, b)))
        for k in KINDS
        if not k.base
    ]
    return df.withColumn(name, F.concat(held, *added)).drop(*[f"_{name}_{k.name}" for k in KINDS], f"_{name}_base")


def joined(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    one = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    return F.array_join(F.transform(spans, one), ",")


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The documents with every span replaced by its kind in angle brackets; overlapping spans become one."""
    text = F.col(f"`{text_col}`")
    by_start = F.array_sort(
        F.transform(F.col("_spans"), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")))
    )
    start = F.struct(F.array().cast("array<string>").alias("parts"), F.lit(0).cast("bigint").alias("at"))

    def step(acc: Column, s: Column) -> Column:
        before = F.substr(text, (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int"))
        shown = F.concat(acc["parts"], F.array(before, F.concat(F.lit("<"), s["kind"], F.lit(">"))))
        fresh = F.struct(shown.alias("parts"), s["end"].alias("at"))
        merged = F.struct(acc["parts"].alias("parts"), F.greatest(acc["at"], s["end"]).alias("at"))
        return F.when(s["start"] >= acc["at"], fresh).otherwise(merged)

    def finish(acc: Column) -> Column:
        return F.concat(F.array_join(acc["parts"], ""), F.substr(text, (acc["at"] + 1).cast("int"), F.length(text)))

    rest = docs.columns
    found = find(docs, text, "_spans")
    clean = F.when(F.size("_spans") > 0, F.aggregate(by_start, start, step, finish)).otherwise(text)
    return found.withColumn("_clean", clean).select(
        *[F.col("_clean").alias(c) if c == text_col else F.col(f"`{c}`") for c in rest]
    )
