"""Operators that join, rank or group documents, against plain Python."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from sleuthframe.llm import backoff, mixing, multiset, neardup, sharding
from sleuthframe.llm.queries import QUERIES
from sleuthframe.llm.tables import keyed, numbered, read

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_id(x):
    return None if x is None else int(x)


def test_numbered(spark):
    df = spark.range(1000).select((F.col("id") % 7).alias("k"), F.lit(2).alias("w"))
    got = numbered(df, [F.col("k")], {"before": "w"}).collect()
    assert sorted(r["_pos"] for r in got) == list(range(1000))
    assert all(r["before"] == 2 * r["_pos"] for r in got)
    by_place = [r["k"] for r in sorted(got, key=lambda r: r["_pos"])]
    assert by_place == sorted(by_place)


# -- mixing --------------------------------------------------------------------------------------------------


def shares(sizes):
    """Targets by sharing again and again; sources in order, null last."""
    names = sorted([s for s in sizes if s is not None]) + ([None] if None in sizes else [])
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    target, left, open_ = {}, 1.5 * sum(sizes.values()), set(names)
    while open_:
        unit = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if unit * weight[s] > 2 * sizes[s]}
        if not full:
            return target | {s: unit * weight[s] for s in open_}
        target |= {s: 2.0 * sizes[s] for s in full}
        left -= sum(target[s] for s in full)
        open_ -= full
    return target


@pytest.mark.parametrize("which", ["odd", "given"])
def test_mix(spark, docs, data, which):
    table = docs if which == "odd" else read(spark, data, "documents")
    size, source = Counter(), {}
    rows = mixing.curriculum(mixing.document_keys(keyed(table))).collect()
    texts = table.select("doc_id", "text", "source").collect()
    totals = defaultdict(int)
    for r in texts:
        totals[r["source"]] += len(WORD.findall(r["text"] or ""))
    want = shares(totals)
    taken, of = Counter(), Counter()
    for r in rows:
        taken[r["source"]] += r["taken"]
        of[(r["_file"], r["_row"])] += r["taken"]
        assert r["target"] == pytest.approx(want[r["source"]])
        assert r["source_size"] == totals[r["source"]]
        assert (r["position"] is None) == (r["taken"] == 0)
        assert r["position"] is None or 0 <= r["position"] <= 1
        size[(r["_file"], r["_row"])] = r["size"]
        source[(r["_file"], r["_row"])] = r["source"]
    assert len(size) == len(texts)
    for s, t in want.items():
        assert abs(taken[s] - t) <= 1
    assert all(of[k] <= 2 * size[k] for k in of)
    mixed = mixing.mix(table).collect()
    assert sum(len(WORD.findall(r["_doc"]["text"])) for r in mixed) == sum(taken.values())
    assert [r["position"] for r in mixed] == sorted(r["position"] for r in mixed)


def test_schedule_is_inverted(spark):
    for knots in mixing.SCHEDULES:
        grid = [i / 50 for i in range(51)]
        df = spark.createDataFrame([(x,) for x in grid], "x double").select(mixing._inverse(F.col("x"), knots).alias("t"))
        fine = np.linspace(0, 1, 20001)
        weight = np.interp(fine, np.linspace(0, 1, len(knots)), knots)
        area = np.concatenate([[0], np.cumsum((weight[1:] + weight[:-1]) / 2)])
        got = [r["t"] for r in df.collect()]
        assert np.allclose(np.interp(got, fine, area / area[-1]), grid, atol=1e-6)


def test_mix_of_nothing(empty):
    assert mixing.mix(empty).count() == 0
    assert mixing.curriculum(mixing.document_keys(keyed(empty))).count() == 0


# -- near duplicates -----------------------------------------------------------------------------------------


def low(text):
    return re.sub("[A-Z]", lambda m: m.group().lower(), text or "")


def grams(text, k):
    w = WORD.findall(low(text))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def components(texts, k):
    """Smallest index of each text's group, by comparing all pairs."""
    sets = [grams(t, k) for t in texts]
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and min(len(a), len(b)) * 100 >= 80 * max(len(a), len(b)):
                both = len(a & b)
                if 100 * both >= 80 * (len(a) + len(b) - both):
                    x, y = find(i), find(j)
                    parent[max(x, y)] = min(x, y)
    return sets, [find(i) for i in range(len(sets))]


@pytest.mark.parametrize("which,k", [("odd", 2), ("given", 2), ("chain", 2), ("given", 5)])
def test_groups(spark, docs, data, which, k):
    if which == "chain":
        words = [f"w{i}" for i in range(60)]
        texts = [" ".join(words[i : i + 40]) for i in range(0, 20)]  # neighbours are alike, ends aren't
        texts += [" ".join(words[:30] + [f"z{i}"] + words[31:50]) for i in range(40)]
        table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    else:
        table = docs if which == "odd" else read(spark, data, "documents")
    rows = table.select("doc_id", "text").collect()
    rows.sort(key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0))
    sets, root = components([r["text"] for r in rows], k)
    want = Counter((r["doc_id"], len(s), rows[c]["doc_id"]) for r, s, c in zip(rows, sets, root, strict=True))
    got = neardup.groups(neardup.text_rows(keyed(table)), shingle=k).collect()
    assert Counter((r["id"], r["n_shingles"], r["component_id"]) for r in got) == want
    kept = [r for r in got if r["kept"]]
    assert len(kept) == len(set(root))
    assert neardup.keep_one(table, shingle=k).count() == len(kept)


def test_groups_of_nothing(empty):
    assert neardup.groups(neardup.text_rows(keyed(empty))).count() == 0


def test_signature_estimates_similarity():
    maker = neardup.Sketcher(1, permutations=2000)
    a, b = (maker.signature(maker.shingles(" ".join(map(str, r)))) for r in (range(0, 90), range(10, 100)))
    assert np.mean(a == b) == pytest.approx(0.8, abs=0.03)
    assert np.mean(a[:2000] == b[:2000]) == pytest.approx(0.8, abs=0.04)
    assert len(set(neardup.bands(a).tolist())) == 800


# -- language model ------------------------------------------------------------------------------------------


def model_scores(rows, weights):
    token = lambda t: WORD.findall(low(t)) + [None]
    train = [token(r["text"]) for r in rows if zlib.crc32(str("" if r["doc_id"] is None else r["doc_id"]).encode()) % 5 != 1]
    grams = [Counter(), Counter(), Counter()]
    held = [Counter(), Counter()]
    for t in train:
        full = ["<s>", "<s>", *t]
        for i in range(2, len(full)):
            for order in range(3):
                grams[order][tuple(full[i - order : i + 1])] += 1
            for order in range(2):
                held[order][tuple(full[i - order - 1 : i])] += 1
    n, v = sum(grams[0].values()), len(grams[0])

    def chance(history, w):
        p = (grams[0][(w,)] + 0.5) / (n + 0.5 * (v + 1))
        for order in range(2):
            h = history[1 - order :]
            p = (grams[order + 1][(*h, w)] + weights[order] * p) / (held[order][h] + weights[order])
        return p

    out = {}
    for r in rows:
        t = token(r["text"])
        full = ["<s>", "<s>", *t]
        each = [chance(tuple(full[i - 2 : i]), full[i]) for i in range(2, len(full))]
        base = [(grams[0][(w,)] + 0.5) / (n + 0.5 * (v + 1)) for w in t]
        out[r["doc_id"]] = (len(t), sum(grams[0][(w,)] > 0 for w in t), n, sum(map(math.log10, base)), sum(map(math.log10, each)))
    # The model is a distribution over the words and one unknown one.
    for history in list(held[1])[:3]:
        assert sum(chance(history, w) for (w,) in grams[0]) + chance(history, "never seen") == pytest.approx(1)
    return out


@pytest.mark.parametrize("which,weights,block", [("odd", (3.0, 0.5), 2048), ("odd", (50.0, 10.0), 5), ("given", (50.0, 10.0), 2048)])
def test_scores(spark, docs, data, monkeypatch, which, weights, block):
    monkeypatch.setattr(backoff, "BLOCK_DOCS", block)
    table = docs if which == "odd" else read(spark, data, "documents")
    want = model_scores(table.select("doc_id", "text").collect(), weights)
    got = backoff.score_documents(table, weights=weights).collect()
    assert len(got) == table.count()
    for r in got:
        numbers = (r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"], r["score"])
        assert numbers == pytest.approx(want[plain_id(r["id"])], rel=1e-9)
        assert r["train"] == (zlib.crc32(str(r["id"] if r["id"] is not None else "").encode()) % 5 != 1)


def test_numbers_are_packed():
    for numbers in ([], [0], [5, 0, 255], [256, 1], [2**57 - 1, 2**40]):
        assert backoff.unpack(backoff.pack(np.array(numbers, "uint64"))).tolist() == numbers


@pytest.mark.parametrize("block", [backoff.BLOCK_DOCS, 7])
def test_rare_words_are_contexts_at_any_size(spark, monkeypatch, tmp_path, block):
    # 300,000 tokens, so a word that is there twice has less than 1e-5 of them.
    monkeypatch.setattr(backoff, "BLOCK_DOCS", block)
    texts = ["common filler words " * 2500] * 40 + ["rare pair here", "rare pair there", "a rare pair", "pair rare"] * 3 + ["seen twice", "seen twice", "seen once"]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    path = str(tmp_path / "documents.parquet")
    frame.coalesce(1).write.parquet(path)
    table = spark.read.parquet(path)
    want = model_scores(table.collect(), (backoff.WEIGHT_ONE, backoff.WEIGHT_TWO))
    got = backoff.score_documents(table).collect()
    assert len(got) == len(texts)
    for r in got:
        mine = (r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"], r["score"])
        assert mine == pytest.approx(want[plain_id(r["id"])], rel=1e-9)


def test_blocks_are_bounded_in_bytes(spark, docs, monkeypatch):
    want = {(r["_file"], r["_row"]): r["score"] for r in backoff.score_documents(docs).collect()}
    monkeypatch.setattr(backoff, "BLOCK_BYTES", 3000)
    rows = keyed(docs).select("_file", "_row", F.col("_doc.text").alias("text"))
    sizes = backoff.in_blocks(rows).groupBy("block").agg(F.sum(F.octet_length("text")).alias("size"), F.count("*").alias("n"))
    sizes = sizes.collect()
    assert sum(r["n"] for r in sizes) == docs.count()
    assert all((r["size"] or 0) < 6000 or r["n"] == 1 for r in sizes)
    assert max(r["size"] or 0 for r in sizes) > 6000 and max(r["n"] for r in sizes) > 1
    got = {(r["_file"], r["_row"]): r["score"] for r in backoff.score_documents(docs).collect()}
    assert got == pytest.approx(want, rel=1e-9)


def test_held_out_texts_gain(spark, data):
    got = QUERIES["op6_backoff_scores"](spark, data).where("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert got[0] > got[1]


def test_scores_of_nothing(empty):
    assert backoff.score_documents(empty).count() == 0


# -- fingerprints --------------------------------------------------------------------------------------------


def test_edited_texts(docs, rows):
    got = multiset.edited(docs).select("id", "text", "edited", "n_chars", "lanes", "edited_lanes").collect()
    assert len(got) == len(rows)
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    texts = [r[1] or "" for r in order]
    for i, r in enumerate(order):
        if r[0] in (2, 3):  # next to repeated rows, whose order is open
            continue
        own, nxt = texts[i], texts[(i + 1) % len(texts)]
        half = len(own) // 2
        mine = next(g for g in got if g["id"] == r[0])
        assert mine["n_chars"] == len(own)
        assert mine["edited"] == own[: len(own) - half] + nxt[:half]
    by_text = defaultdict(set)
    for g in got:
        by_text[g["text"]].add(tuple(g["lanes"]))
    assert all(len(x) == 1 for x in by_text.values())


def test_fingerprints_add_up(spark):
    texts = ["a b. c d\nx y", "x y\na b. c d", "a b. c d", "x y", "", "a b. c d\nx z"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    lanes = {r["i"]: r["f"] for r in multiset.with_fingerprint(df, F.col("text"), "f").collect()}
    assert lanes[0] == lanes[1] != lanes[5]
    assert lanes[4] == [0] * multiset.LANES
    one = spark.createDataFrame([(lanes[0], lanes[2], lanes[3])], "whole array<long>, a array<long>, b array<long>")
    r = one.select(multiset.combine(F.col("a"), F.col("b")).alias("p"), multiset.combine(F.col("whole"), F.col("a"), -1).alias("m")).first()
    assert r["p"] == lanes[0] and r["m"] == lanes[3]


def test_likeness(spark, data):
    got = QUERIES["op7_multiset_fingerprints"](spark, data).collect()
    assert all(0 <= r["near_next"] <= 1 and 0 <= r["near_edited"] <= 1 for r in got)
    assert np.mean([r["near_edited"] > r["near_next"] for r in got]) > 0.9
    text = {r["doc_id"]: r["text"] for r in read(spark, data, "documents").collect()}
    order = sorted(text)
    for a, b in zip(order, order[1:] + order[:1], strict=True):
        r = next(x for x in got if x["doc_id"] == a)
        half = len(text[a]) // 2
        want = text[a][: len(text[a]) - half] + text[b][:half]
        assert r["edited_sha256"] == hashlib.sha256(want.encode()).hexdigest()


# -- shards --------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("which", ["odd", "given"])
def test_shards(spark, docs, data, which):
    table = docs if which == "odd" else read(spark, data, "documents")
    got = sharding.shard_rows(table, shards=5).collect()
    assert len(got) == table.count()
    slots = defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    sizes = [len(slots[i]) for i in range(5)]
    assert max(sizes) - min(sizes) <= 1
    for source, n in Counter(r["_doc"]["source"] for r in got).items():
        each = Counter(r["shard"] for r in got if r["_doc"]["source"] == source)
        assert all(abs(each[i] - n / 5) <= 2 for i in range(5))


def test_shards_of_nothing(empty, tmp_path, docs, spark):
    assert sharding.shard_rows(empty).count() == 0
    sharding.write_shards(docs, str(tmp_path / "s"), shards=3)
    assert spark.read.parquet(str(tmp_path / "s")).count() == docs.count()


@pytest.mark.parametrize("own", [60])
def test_template_pages_write_few_pairs(spark, own, tmp_path):
    """Pages that share a template but are no near copies: all meet in buckets, hardly any pair is written."""
    rng = np.random.default_rng(own)
    template = [f"t{i}" for i in range(100)]
    texts = [" ".join(template[:50] + [f"p{rng.integers(1 << 40)}" for _ in range(own)] + template[50:]) for _ in range(400)]
    path = str(tmp_path / "d")
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(path)
    rows = neardup.text_rows(keyed(spark.read.parquet(path)))
    made = neardup.sketch(rows, 2).select(F.col("id").cast("long").alias("node"), F.col("n_shingles").alias("n"), "bands", "short")
    spread = made.select(F.explode("bands").alias("bucket"), "node", "n", F.col("node").alias("family"))
    pairs = neardup.chance_pairs(spread, made, 80).count()
    assert pairs <= 20 * len(texts)
    got = neardup.groups(rows, shingle=2).collect()
    assert len({r["component_id"] for r in got}) == len(texts)
