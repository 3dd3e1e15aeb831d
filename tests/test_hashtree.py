import hashlib

import pytest
from pyspark.sql import functions as F

from sleuthframe.operators import chain, hashtree


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def model(rows, fan):
    """{(level, at): (n, digest)} of {id: hash}."""
    level, nodes, children = 0, {}, sorted((k, d, 1) for k, d in rows)
    while not level or max(k for k, *_ in children) > 0 or level == 0:
        level += 1
        groups = {}
        for k, d, n in children:
            groups.setdefault(k // fan, []).append((k, d, n))
        children = []
        for at, part in sorted(groups.items()):
            digest = sha("\n".join([f"{level}:{at}", *(f"{k}:{d}" for k, d, _ in part)]))
            n = sum(x[2] for x in part)
            nodes[(level, at)] = (n, digest)
            children.append((at, digest, n))
        if max(k for k, *_ in children) == 0:
            return nodes


@pytest.fixture(scope="module")
def stored(make_events):
    return chain.build_chain(make_events([{"at": i} for i in range(70)]), chain.segment(20)).cache()


def changed(stored, now, fan):
    out = hashtree.differences(hashtree.tree(stored, fan), hashtree.tree(now, fan), fan).collect()
    return sorted((r["first_id"], r["last_id"], r["what"]) for r in out)


@pytest.mark.parametrize("fan", [3, 64])
def test_tree(stored, fan):
    nodes = hashtree.tree(stored, fan)
    want = model([(r["id"], r["event_hash"]) for r in stored.collect()], fan)
    assert {(r["level"], r["at"]): (r["n"], r["digest"]) for r in nodes.collect()} == want
    top = hashtree.root(nodes).collect()
    assert len(top) == 1 and top[0]["n"] == 70
    old = hashtree.tree(stored.where("id <= 37"), fan)
    longer = hashtree.extend(old, stored.where(f"id >= {38 // fan * fan}"), 38, fan)
    assert sorted(map(str, longer.collect())) == sorted(map(str, nodes.collect()))


def test_lost_rows_are_named(stored):
    assert changed(stored, stored, 4) == []
    assert changed(stored, stored.where("id <= 66"), 4) == [(64, 67, "shrunk"), (68, 71, "lost")]
    assert changed(stored, stored.where("id < 21 OR id > 40"), 4) == [(20, 23, "shrunk"), *((i, i + 3, "lost") for i in range(24, 40, 4)), (40, 43, "shrunk")]
    assert changed(stored.where("id <= 66"), stored, 4) == [(64, 67, "grown"), (68, 71, "new")]
    edit = stored.withColumn("event_hash", F.when(F.col("id") == 9, "ff").otherwise(F.col("event_hash")))
    assert changed(stored, edit, 4) == [(8, 11, "changed")]
    copies = stored.unionByName(stored.where("id = 9"))
    assert changed(stored, copies, 4) == [(8, 11, "grown")]


def test_verify_sees_what_links_do_not(stored):
    nodes = hashtree.tree(stored)

    def verdict(rows):
        return chain.verify(rows, "chain", stored_tree=nodes).first()

    assert verdict(stored)["status"] == "VALID" and verdict(stored)["root_matches"]
    for rows, missing in ((stored.where("id < 70"), 1), (stored.where("chain <> '1'"), 20), (stored.where("id % 20 <> 0"), 3)):
        assert chain.verify(rows, "chain").first()["status"] == "VALID"
        seen = verdict(rows)
        assert seen["status"] == "INVALID" and seen["missing_events"] == missing and not seen["valid"]
    gone = verdict(stored.limit(0))
    assert gone["status"] == "INVALID" and gone["missing_events"] == 70
    assert chain.verify(stored.limit(0), "chain", stored_tree=hashtree.tree(stored.limit(0))).first()["status"] == "NO_EVENTS"


def test_paths(spark, stored):
    nodes = hashtree.tree(stored, 4)
    proof = hashtree.paths(nodes, stored, spark.createDataFrame([(1,), (40,), (70,), (99,)], "id bigint"), 4)
    root = hashtree.root(nodes).first()["digest"]
    rows = proof.join(stored.select("id", "event_hash"), "id").cache()
    assert rows.count() == 3
    check = lambda i, h, r=root: rows.select(hashtree.proves(i, h, F.col("path"), F.lit(r), 4).alias("ok")).collect()
    assert all(r["ok"] for r in check(F.col("id"), F.col("event_hash")))
    assert not any(r["ok"] for r in check(F.col("id"), F.lit("ff")))
    assert not any(r["ok"] for r in check(F.col("id") + 4, F.col("event_hash")))
    assert not any(r["ok"] for r in check(F.col("id"), F.col("event_hash"), sha("other")))
    assert not rows.select(hashtree.proves(F.col("id"), F.col("event_hash"), F.slice("path", 1, 2), F.lit(root), 4).alias("ok")).where("ok").count()
