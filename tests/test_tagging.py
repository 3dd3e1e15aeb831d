import random

from pyspark.sql import functions as F

from sleuthframe.functions import tagging as tag


def test_needed_texts_lose_no_match(spark):
    rng = random.Random(5)
    words = (
        "usb thumbdrive flash drive filesystem file files folder directory directories browsing web website visited antivirs anti-virus "
        "virus windows event log-on sign in deletions removed new modified changed edit edited renaming inserted insert ejected browsed "
        "critical high-risk severe medium moderate warnings low severity low-severity info chronolog what happened here around this "
        "else off hours off-hours off-hour why how did verify chain of custody between and after before about near at 9 pm 25 é ſ ſign"
    ).split()
    texts = [rng.choice([" ", "  ", "-", "é", "\n"]).join(rng.choices(words, k=rng.randrange(1, 9))) for _ in range(1500)]
    rows = tag.with_lower(spark.createDataFrame([(t,) for t in texts], "text string"), "text")
    low = F.col("low")
    wrong = F.lit(0)
    for pattern in tag.NEEDED:
        plain = tag._by_letters(low, lambda prefix, p=pattern: low.rlike(prefix + p))
        wrong = wrong + (plain & ~tag._may_have(low, pattern)).cast("int")
    assert rows.agg(F.sum(wrong)).first()[0] == 0


def test_each_hour_rule_is_matched_once(spark):
    rows = tag.with_lower(spark.createDataFrame([("between 2 pm and 9 am",), ("after 25",), ("near 12 a.m.",)], "text string"), "text")
    found = rows.select("text", tag.hour_window(F.col("low")).alias("w"))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count(tag.AFTER) <= 2
    got = {r["text"]: tuple(r["w"]) for r in found.collect()}
    assert got == {"between 2 pm and 9 am": (9, 14), "after 25": (None, None), "near 12 a.m.": (0, 0)}
