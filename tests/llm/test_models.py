"""Whitening, conversation repair and embedding near-duplicates, against plain Python."""

import hashlib
import math
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from sleuthframe.llm import binary_codes, conversations, whitening
from sleuthframe.llm.queries import QUERIES
from sleuthframe.llm.tables import read

VECTORS = "vec_id long, embedding array<float>, label int, id string, n int, node long, x string, component int, _file string"
TURNS = "conv_id long, turn long, role string, text string, key string, at long, copy int, block int, _row long"


def usable(v):
    return v is not None and all(c is not None and math.isfinite(c) for c in v)


@pytest.fixture(scope="module")
def odd_vectors():
    rng = np.random.default_rng(3)
    base = rng.standard_normal((6, 12))
    out = [rng.standard_normal(12).tolist() for _ in range(150)]
    for b in base:
        out += [(b + s * rng.standard_normal(12)).tolist() for s in (0.02, 0.1, 0.2, 0.3) for _ in range(30)]
    out += [(3 * base[0]).tolist(), (0.5 * base[0]).tolist(), *[base[1].tolist()] * 40]
    out += [None, [], [0.0] * 12, [float("nan")] * 12, [1.0, float("inf")] + [0.0] * 10, [None] * 12, [1.0] * 5, [1.0] * 5]
    rows = [(i, v, i % 3, "x", 1, 2, "y", 3, "z") for i, v in enumerate(out)]
    return [*rows, (None, base[0].tolist(), *rows[0][2:]), rows[5], rows[5]]


def write(spark, tmp_path_factory, name, rows, schema):
    folder = str(tmp_path_factory.mktemp(name))
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(f"{folder}/{name}.parquet")
    return folder


# -- whitening -----------------------------------------------------------------------------------------------


def check_whitening(table, got, dimension):
    rows = [(r["vec_id"], r["embedding"]) for r in table if usable(r["embedding"]) and len(r["embedding"]) == dimension]
    x = [[math.floor(64 * c) + 1_000_000 for c in v] for _, v in rows]
    fit = np.array(sorted(set(map(tuple, x))), dtype=object)
    n, s = len(fit), fit.sum(axis=0)
    a = ((fit * n - s) / n).astype("float64")
    values, vectors = np.linalg.eigh(a.T @ a / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    k = min(16, dimension)
    assert len(got) == k * len(rows)
    assert {r["n"] for r in got} == {n}
    assert len({r["identity_error"] for r in got}) == 1 and got[0]["identity_error"] <= 1e-9
    for i in range(k):
        assert all(r["explained"] == pytest.approx(values[i] / values.sum(), rel=1e-9) for r in got if r["component"] == i + 1)
    want = defaultdict(list)
    for (key, _), one in zip(rows, x, strict=True):
        d = np.array(one, dtype=object) * n - s
        want[key].append((int((d * d).sum()), (d / n).astype("float64") @ vectors[:, :k] / np.sqrt(values[:k])))
    found = defaultdict(list)
    for r in got:
        found[(r["vec_id"], r["component"])].append(r)
    signs = {}
    for key, many in want.items():
        for i in range(k):
            here = found[(key, i + 1)]
            assert [r["deviation"] for r in here] == [m[0] for m in many]
            for r, m in zip(here, many, strict=True):
                if abs(m[1][i]) > 1e-6:
                    assert signs.setdefault(i, math.copysign(1, r["whitened"] * m[1][i])) * r["whitened"] == pytest.approx(m[1][i], rel=1e-7, abs=1e-9)


@pytest.mark.parametrize("which", ["odd", "given"])
def test_whitening(spark, data, odd_vectors, tmp_path_factory, which):
    folder = data if which == "given" else write(spark, tmp_path_factory, "embeddings", odd_vectors, VECTORS)
    got = QUERIES["op11_embedding_whitening"](spark, folder).collect()
    check_whitening(read(spark, folder, "embeddings").collect(), got, 64 if which == "given" else 12)


def test_whitening_without_variance(spark, tmp_path_factory):
    rng = np.random.default_rng(1)
    flat = [(i, [float(a), 2.0 * float(a), 7.0, float(b)]) for i, (a, b) in enumerate(rng.standard_normal((60, 2)).round(1))]
    folder = write(spark, tmp_path_factory, "embeddings", flat, "vec_id long, embedding array<double>")
    got = QUERIES["op11_embedding_whitening"](spark, folder).collect()
    assert {r["component"] for r in got} >= {1, 2} and 4 not in {r["component"] for r in got}
    assert got[0]["identity_error"] < 1e-4
    for rows in ([], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])], [(1, None), (None, [])]):
        folder = write(spark, tmp_path_factory, "embeddings", rows, "vec_id long, embedding array<float>")
        assert QUERIES["op11_embedding_whitening"](spark, folder).count() == 0


def test_whitening_numbers_beyond_a_long(spark, tmp_path_factory):
    rows = [(i, [float(3 ** (40 * (i % 2))), float(i)]) for i in range(9)]
    folder = write(spark, tmp_path_factory, "embeddings", rows, "vec_id long, embedding array<double>")
    got = QUERIES["op11_embedding_whitening"](spark, folder).collect()
    assert got and all(r["deviation"] is None for r in got)


def test_ill_conditioned_rows_are_orthogonalised(spark):
    rng = np.random.default_rng(2)
    wide = rng.standard_normal((400, 8)) * np.array([1e6, 1e4, 1e3, 100, 50, 20, 10, 5])
    x = [([int(c) for c in row],) for row in np.round(wide @ np.linalg.qr(rng.standard_normal((8, 8)))[0] * 100)]
    fit = spark.createDataFrame(x, "x array<long>").repartition(3)
    model = whitening.fit_whitening(fit)
    assert model.passes >= 3 and len(model.values) == 8
    assert whitening.identity_error(fit, model) < 1e-9


# -- conversations -------------------------------------------------------------------------------------------

BLANKS = " \t\n\x0b\x0c\r"


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if kind == 0:
            continue
        if kind == 1:
            text = ""
        elif kind == 2:
            text = text.translate(str.maketrans("", "", ".!?"))
        elif kind == 4:
            role = "user"
        out += [(turn, role, text)] * (2 if kind == 3 else 1)
    return out


def cheapest(rows, faults):
    """(cost, audit, repaired) by trying every edit at every place, cheapest labels by state."""
    after = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}
    names = {"u": "user", "a": "assistant"}

    def inserted(labels):
        for _ in range(4):
            for state, (cost, audit, lines) in list(labels.items()):
                for r, to in after[state].items():
                    if r != "s":
                        new = (cost + 5, audit + "I", [*lines, names[r] + ":"])
                        if to not in labels or new[:2] < labels[to][:2]:
                            labels[to] = new
        return labels

    labels = {"": (0, "", [])}
    for (_, role, text), fault in zip(rows, faults, strict=True):
        new = {}

        def put(state, label, new=new):
            if state not in new or label[:2] < new[state][:2]:
                new[state] = label

        for state, (cost, audit, lines) in inserted(labels).items():
            put(state, (cost + 2, audit + "D", lines))
            if fault in ("blank", "duplicate"):
                continue
            more = 5 if fault == "truncated" else 0
            for r, to in after[state].items():
                if role[:1] == r:
                    put(to, (cost + more, audit + "K", [*lines, f"{role}:{text}"]))
                if r != "s":
                    put(to, (cost + 1 + more, audit + "R", [*lines, f"{names[r]}:{text}"]))
        labels = new
    labels = inserted(labels)
    return min((labels[s] for s in ("", "a") if s in labels), key=lambda x: x[:2])


def expected(rows):
    """Rows must be in order."""
    seen, faults = set(), []
    for _, role, text in rows:
        shown = text.rstrip(BLANKS)
        faults.append("blank" if not shown else "duplicate" if (role, text) in seen else "truncated" if shown[-1] not in ".!?" else None)
        seen.add((role, text))
    turns = [t for t, *_ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    initials = [r[:1] for _, r, _ in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
    cost, audit, lines = cheapest(rows, faults)
    return (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit,
            hashlib.sha256("\n".join(lines).encode()).hexdigest())


def results(spark, folder):
    got = QUERIES["op12_conversation_repair"](spark, folder).collect()
    out = {r["conv_id"]: tuple(r)[1:] for r in got}
    assert len(out) == len(got)
    return out


def odd_turns():
    """Turns are distinct within a conversation, so that the order is given."""
    rng = random.Random(4)
    roles = ["user", "assistant", "user", "assistant", "system", None, "", "tool", "usr", "User"]
    texts = ["Yes.", "No!", "Why?", "open", "", " \n", None, "a\nb.", "end. \t", "é漢😀?", "x" * 3000 + ".", "user:", "Yes. "]
    rows = []
    for conv in range(60):
        n = rng.randrange(1, 14) if conv else 90
        for turn in range(n):
            if rng.random() < 0.9:
                plain = rng.random() < 0.7
                role = ("user", "assistant")[turn % 2] if plain else rng.choice(roles)
                rows.append((conv, turn * rng.choice((1, 1, 1, 1)), role, rng.choice(texts) if not plain else f"t{turn}."))
    for conv in (None, 100):
        rows += [(conv, None, "user", "Who?"), (conv, 5, "assistant", "Me."), (conv, 9, "assistant", "Me.")]
    rows += [(200, 1, "user", "only one."), (201, None, None, None)]
    return rows


@pytest.mark.parametrize("block", [256, 4])
@pytest.mark.parametrize("which", ["odd", "given"])
def test_repair(spark, data, tmp_path_factory, monkeypatch, which, block):
    monkeypatch.setattr(conversations, "BLOCK", block)
    monkeypatch.setattr(conversations, "FAN", 3)
    if which == "given":
        folder, rows = data, [tuple(r)[:4] for r in read(spark, data, "conversations").collect()]
    else:
        rows = odd_turns()
        random.Random(1).shuffle(rows)
        wide = [(*r, "k", 1, 2, 3, 4) for r in rows]
        folder = write(spark, tmp_path_factory, "conversations", wide, TURNS)
    groups = defaultdict(list)
    for r in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0)):
        groups[r[0]].append(r)
    want = {conv: expected(damaged(many)) for conv, many in groups.items()}
    assert results(spark, folder) == want


def test_repair_ties(spark, tmp_path_factory):
    """Rows of one turn: any order is fine, but reruns agree and repeats stand together."""
    rows = [(1, 0, r, t) for r in ("user", "assistant") for t in ("a.", "b.", "a.")] * 3 + [(1, 0, "user", "a.")] * 700
    folder = write(spark, tmp_path_factory, "conversations", [(*r, "k", 1, 2, 3, 4) for r in rows], TURNS)
    one, two = results(spark, folder), results(spark, folder)
    left = damaged(rows)
    assert one == two and one[1][2] == len(left) - len(set(left)) and len(one[1][6]) >= len(left)


def test_repair_of_nothing(spark, tmp_path_factory):
    assert results(spark, write(spark, tmp_path_factory, "conversations", [], TURNS)) == {}
    dropped = next(t for t in range(1000) if zlib.crc32(f"7:{t}".encode()) % 20 == 0)
    rows = [(7, dropped, "user", "gone.", "k", 1, 2, 3, 4)]
    got = results(spark, write(spark, tmp_path_factory, "conversations", rows, TURNS))
    assert got == {7: (0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())}


def test_search_meets_in_the_middle():
    rng = random.Random(2)
    for _ in range(300):
        codes = "".join(rng.choice("suaoUAOSxxua") for _ in range(rng.randrange(1, 12)))
        rows = [(i, {"s": "system", "u": "user", "a": "assistant", "o": "o", "x": "user"}[c.lower()], f"{i}.") for i, c in enumerate(codes)]
        faults = ["blank" if c == "x" else "truncated" if c.isupper() else None for c in codes]
        assert conversations.search(codes) == cheapest(rows, faults)[:2]


# -- near-duplicate embeddings -------------------------------------------------------------------------------


def brute_links(rows, cosine=0.95):
    good = [i for i, (_, v) in enumerate(rows) if usable(v) and len(v) and any(v)]
    parent, links = list(range(len(rows))), [0] * len(rows)

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for length in {len(rows[i][1]) for i in good}:
        at = [i for i in good if len(rows[i][1]) == length]
        unit = np.array([rows[i][1] for i in at], "float64")
        unit /= np.linalg.norm(unit, axis=1, keepdims=True)
        same = unit @ unit.T >= cosine
        for x, y in zip(*np.nonzero(np.triu(same, 1)), strict=True):
            a, b = at[x], at[y]
            links[a] += 1
            links[b] += 1
            parent[max(find(a), find(b))] = min(find(a), find(b))
    groups = defaultdict(list)
    for i in range(len(rows)):
        groups[find(i)].append(rows[i][0])
    smallest = {g: min((x for x in ids if x is not None), default=None) for g, ids in groups.items()}
    return links, [smallest[find(i)] for i in range(len(rows))]


@pytest.mark.parametrize("block", [512, 16])
def test_near_copies(spark, odd_vectors, tmp_path_factory, monkeypatch, block):
    """A block of 16 makes most buckets of the copies larger than one block."""
    monkeypatch.setattr(binary_codes, "BLOCK", block)
    folder = write(spark, tmp_path_factory, "embeddings", odd_vectors, VECTORS)
    rows = sorted([(r["vec_id"], r["embedding"]) for r in read(spark, folder, "embeddings").collect()], key=str)
    links, smallest = brute_links(rows)
    got = sorted(map(tuple, QUERIES["op13_embedding_duplicates"](spark, folder).collect()), key=str)
    assert len(got) == len(rows)
    want = sorted([(r[0], n, c, r[0] == c) for r, n, c in zip(rows, links, smallest, strict=True)], key=str)
    # Every link found is real; of the links there are, pairs at the very threshold may be missed.
    assert sum(g[1] for g in got) >= 0.98 * sum(links) and all(g[1] <= w[1] for g, w in zip(got, want, strict=True))
    assert sum(g[2:] == w[2:] for g, w in zip(got, want, strict=True)) >= 0.98 * len(want)
    tight = [i for i, w in enumerate(want) if w[1] >= 40]
    assert tight and all(got[i][2] == want[i][2] for i in tight)


def test_no_near_copies(spark, data, tmp_path_factory):
    got = QUERIES["op13_embedding_duplicates"](spark, data).collect()
    assert len(got) == 500 and all(r["n_links"] == 0 and r["kept"] and r["component_id"] == r["vec_id"] for r in got)
    folder = write(spark, tmp_path_factory, "embeddings", [], VECTORS)
    assert QUERIES["op13_embedding_duplicates"](spark, folder).count() == 0
    folder = write(spark, tmp_path_factory, "embeddings", [(4, [1.0], *[None] * 7), (2, [2.0], *[None] * 7)], VECTORS)
    assert sorted(map(tuple, QUERIES["op13_embedding_duplicates"](spark, folder).collect())) == [(2, 1, 2, True), (4, 1, 2, False)]


def test_rotation_is_balanced():
    rng = np.random.default_rng(0)
    sample = rng.standard_normal((3000, 16)) @ np.diag(np.linspace(3, 0.3, 16)) + 0.4
    sample /= np.linalg.norm(sample, axis=1, keepdims=True)
    coder = binary_codes.fit_coder(sample, 10_000)
    share = coder.code(sample).mean(axis=0)
    assert np.all((share > 0.3) & (share < 0.7))
    turn = coder.turn[:, :16]
    assert np.allclose(turn @ turn.T, np.eye(16), atol=1e-9)
