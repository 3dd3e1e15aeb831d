"""Operators that work text by text, against plain Python."""

import re
import zlib
from array import array
from collections import Counter

import numpy as np
import pytest
from tokenizers import Tokenizer

from sleuthframe.llm import attribution, packing, pii, quality, token_files
from sleuthframe.llm.encode import PIECES, PLAIN, WORDS, Encoder, encoder, public
from sleuthframe.llm.tables import read

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def whole(name, text):
    return Tokenizer.from_file(public(name)).encode(text or "", add_special_tokens=False)


@pytest.mark.parametrize("name", PIECES)
def test_pieces_give_the_ids_of_whole_texts(rows, spark, data, name):
    known = encoder(public(name))
    texts = [r[1] for r in rows] + [r["text"] for r in read(spark, data, "documents").select("text").limit(60).collect()]
    direct = Tokenizer.from_file(public(name))
    for t in texts:
        assert known.encode(t) == array("I", direct.encode(t or "", add_special_tokens=False).ids).tobytes()


def test_plain_pieces_go_straight_to_the_model_of_the_word_tokenizer():
    """A whole call takes several times as long as the model alone, and most pieces of a text are met once."""

    class Library:
        def __init__(self, inner):
            self.inner, self.asked = inner, []

        def encode(self, piece, **more):
            self.asked.append(piece)
            return self.inner.encode(piece, **more)

    name = "word_bpe_49k.json"
    known = Encoder(public(name), PIECES[name], plain=PLAIN[name])
    known.tokenizer = direct = Library(known.tokenizer)
    ids = lambda x: array("I", direct.inner.encode(x, add_special_tokens=False).ids).tobytes()
    plain = ["Word", "ÉTÉ", "Œuvre", "straße", "ſ", "don't", "I'LL", "'Reve'm'", "x1234", "été2024;", "(a)-[b]", "end.", ",", "--", "A'S's"]
    assert [known.encode(x) for x in plain] == [ids(x) for x in plain]
    assert direct.asked == []
    other = ["İstanbul", "e\u0301t\u00e9", "a\u00d7b", "½", "漢字", "a\x7fb", "a\x1cb", "a<b", "<|endoftext|>", "x<|startoftext|>'s"]
    assert [known.encode(x) for x in other] == [ids(x) for x in other]
    assert direct.asked == other
    # Every plain character alone and beside a letter, a digit and a sign.
    for c in filter(PLAIN[name].fullmatch, map(chr, range(0x250))):
        for x in (c, f"a{c}B", f"1{c}2", f"'{c}", f"{c}'S", f"!{c}?", f"é{c}É"):
            assert known.encode(x) == ids(x), x


def test_token_files(spark, docs, rows, empty):
    folder = token_files.write_tokens(docs, file_docs=7)
    got = token_files.read_tokens(spark, folder).orderBy("start").collect()
    ids = [whole("byte_bpe_50k.json", r[1]).ids + [2] for r in rows]
    crc = lambda x: zlib.crc32(array("I", x).tobytes())
    want = sorted((("" if r[0] is None else str(r[0])), len(x), crc(x)) for r, x in zip(rows, ids, strict=True))
    assert sorted((g["key"].split("\t")[0], g["n_tokens"], g["ids_crc32"]) for g in got) == want
    keys = [-1 if g["key"] == "" else int(g["key"].split("\t")[0]) for g in got]
    assert keys == sorted(keys)
    assert [g["start"] for g in got] == list(np.cumsum([0] + [g["n_tokens"] for g in got])[:-1])
    folder_of = token_files.TokenFolder(spark, folder)
    assert list(folder_of.get(12)) == ids[12]
    assert list(folder_of.get(9_007_199_254_740_993)) == ids[-1]
    assert folder_of.get(555) is None
    assert token_files.read_tokens(spark, token_files.write_tokens(empty)).count() == 0


def test_perfect_hash_is_minimal():
    keys = [f"k{i}" for i in range(5000)]
    index = token_files.build_index(keys)
    slots, _ = token_files.find_slots(index, len(keys), keys)
    assert sorted(slots) == list(range(5000))
    file = token_files.TokenFile(token_files.pack_file(keys[:9], [b"\x01\0\0\0" * i for i in range(9)], 2))
    assert file.get("k3").tolist() == [1, 1, 1]
    assert file.get("stranger") is None


def test_section_counts(docs, rows, empty):
    got = {}
    for r in attribution.token_counts(docs).collect():
        got.setdefault(r["doc_id"], []).append(r)
    for key, text, *_ in rows:
        if key is None or key == 3:
            continue
        mine = sorted(got[key], key=lambda r: r["section"])
        found = whole("byte_bpe_50k.json", text)
        assert sum(r["n_tokens"] for r in mine) == len(found.ids)
        assert sum(r["token_share"] for r in mine) == pytest.approx(len(found.ids))
        for r in mine:
            assert r["n_tokens"] == sum(r["start"] <= a < r["end"] for a, _ in found.offsets)
    assert len(got[3]) == 3
    assert attribution.token_counts(empty).count() == 0


WORD_PIECES = ["a", " Zebra", "Alyñor", " straße", "œuvre", "ɏɐ", "ƀǃȿ", "ñandú", " É", "don't", "x1", "×÷", "日本", "e\u0301t", "  two"]


def test_plain_words_go_to_the_model():
    """Ids and spans of plain words are those of a whole call, which they don't take."""
    known = Encoder(public("byte_bpe_50k.json"), PIECES["byte_bpe_50k.json"], WORDS["byte_bpe_50k.json"])
    words = [p for p in WORD_PIECES if known.words.fullmatch(p)]
    assert len(words) == 8 and not any(known.words.fullmatch(s) for s in known.special)
    every = "".join(chr(c) for c in range(0x250) if known.words.fullmatch(chr(c)))
    pieces = [*WORD_PIECES, every, *(f" {c}" for c in every)]
    want = {p: known.tokenizer.encode(p, add_special_tokens=False) for p in pieces}
    calls, direct = [], known.tokenizer

    class Watched:
        def encode(self, piece, **more):
            calls.append(piece)
            return direct.encode(piece, **more)

    known.tokenizer = Watched()
    spans = attribution.Spans(known)
    for p in pieces:
        assert known.known[p] == array("I", want[p].ids).tobytes()
        assert array("i", spans[p]).tolist() == [x for span in want[p].offsets for x in span]
    assert sorted(set(calls)) == sorted(set(WORD_PIECES) - set(words))


def test_sections_of_documents_laid_out_together(spark, rows, monkeypatch):
    """One frame for many documents: none takes tokens of its neighbour, also where sections leave gaps or miss an end."""
    cut = lambda t: (np.arange(1, len(t), 5), np.minimum(np.arange(1, len(t), 5) + 3, len(t)))
    texts = [r[1] for r in rows] + ["", None, "née à Œ", "\n"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    for rule in ("start", "most"):
        got = attribution.token_counts(docs, rule=rule, sections=cut).orderBy("doc_id", "section").collect()
        want = []
        for key, text in enumerate(texts):
            begin, end = cut(text or "")
            offsets = np.array(whole("byte_bpe_50k.json", text).offsets or np.empty((0, 2)), "int64")
            counts = attribution.allocate(offsets[:, 0], offsets[:, 1], begin, end, rule)
            want += [(key, i, *x) for i, x in enumerate(zip(begin, end, *counts, strict=True))]
        assert [tuple(r) for r in got] == want
    frames = []
    monkeypatch.setattr(attribution.pd, "DataFrame", lambda data: frames.append(len(data["section"])) or data)

    class Local:
        def select(self, *columns):
            return self

        def mapInPandas(self, run, schema):
            found = {"id": [str(i) for i in range(len(texts))], "text": texts}
            list(run(iter([found])))
            raise StopIteration

    with pytest.raises(StopIteration):
        attribution.token_counts(Local())
    assert len(frames) == 1


@pytest.mark.parametrize("rule", ["start", "most"])
def test_crossing_tokens(rule):
    first, last = np.array([0, 3, 5, 9]), np.array([3, 5, 9, 10])
    begin, end = np.array([0, 6]), np.array([6, 10])
    n, share, crossing = attribution.allocate(first, last, begin, end, rule)
    assert n.tolist() == ([3, 1] if rule == "start" else [2, 2])
    assert share.tolist() == [2.25, 1.75]
    assert crossing.tolist() == [1, 1]


EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(d):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def base_spans(text):
    number = lambda m: re.sub("[^0-9]", "", m.group())
    out = [("email", *m.span()) for m in EMAIL.finditer(text)]
    out += [("ip", *m.span()) for m in IP.finditer(text) if all(int(x) <= 255 for x in m.group().split("."))]
    out += [("card", *m.span()) for m in CARD.finditer(text) if 16 <= len(number(m)) <= 19 and luhn(number(m))]
    return out + [("phone", *m.span()) for m in PHONE.finditer(text) if 8 <= len(number(m)) <= 15]


def test_base_spans(spark, docs, empty):
    import random

    rng = random.Random(2)
    bits = "a @ . - _ % 1 2 25 + ( ) é 😀 4111111111111111 192.168.1.1 x@y.z 0001 GB82WEST12345698765432".split() + [" "]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randrange(60))) for _ in range(400)]
    texts += ["1" * 20000, "a" * 20000 + "@b.c", "1.1.1.1 " * 600, "+1 " * 3000, "1 " * 9000]
    df = docs.select("text").unionByName(spark.createDataFrame([(t,) for t in texts], "text string"))
    for r in pii.find(df, df["text"]).collect():
        text = r["text"] or ""
        assert [(s.kind, s.start, s.end) for s in r["spans"] if s.kind in pii.BASE] == base_spans(text)
        assert all(text[s.start : s.end] == s.match for s in r["spans"])
    assert pii.find(empty, empty["text"]).count() == 0


def test_added_spans_and_redaction(spark, docs):
    texts = [
        "iban GB82 WEST 1234 5698 7654 32 here",
        "iban GB82 WEST 1234 5698 7654 33 here",
        "amex card 378282246310005 ok",
        "number 378282246310005 ok",
        "mail a.b@c.de, call +1 (212) 555-0100!",
        "nothing to see",
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    got = {r["i"]: r["text"] for r in pii.redact(df).collect()}
    assert got == {
        0: "iban <iban> here", 1: texts[1], 2: "amex card <short_card> ok", 3: texts[3],
        4: "mail <email>, call <phone>!", 5: texts[5],
    }
    assert pii.redact(docs).columns == docs.columns


def measures(text):
    w = WORD.findall(text or "")
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    grams = Counter(zip(w, w[1:], w[2:], strict=False))
    often = {j for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for j in range(i, i + 3)}
    return (len(w), sum(map(len, w)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(often))


def test_quality_measures(docs, rows, empty):
    got = Counter(
        tuple(r) for r in quality.judge(quality.judged_rows(docs)).select(
            "id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"
        ).collect()
    )
    want = Counter()
    for r in rows:
        m = measures(r[1])
        want[(None if r[0] is None else str(r[0]), *m, m[0] < 50 or 100 * m[4] > 50 * m[0])] += 1
    assert got == want
    assert quality.judge(quality.judged_rows(empty)).count() == 0
    kept = quality.keep_good(docs)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} <= {int(k[0]) for k in want if k[0] and not k[-1]}


def test_host_verdicts(spark):
    good = " ".join(f"word{i}" for i in range(80))
    noisy = good + " " + "#" * 20
    made = [(i, noisy, "bad") for i in range(60)] + [(60, good, "bad")]
    made += [(100 + i, good, f"h{i % 9}") for i in range(300)] + [(500, noisy, "h1"), (501, noisy, "tiny")]
    df = spark.createDataFrame(made, "doc_id long, text string, source string")
    gone = {r[0] for r in df.select("doc_id").collect()} - {r["doc_id"] for r in quality.keep_good(df).collect()}
    assert gone == set(range(60))  # a noisy text elsewhere, or alone on its host, and a clean one there stay
    a, b = quality.beta_prior(10, 1000, 100, 12.0)
    assert a / (a + b) == pytest.approx(0.1)


def fit(lengths, capacity):
    """Best-fit decreasing, piece by piece."""
    room, place = [], []
    for x in sorted(lengths, reverse=True):
        best = min((r, i) for i, r in enumerate(room) if r >= x)[1] if any(r >= x for r in room) else None
        if best is None:
            room.append(capacity)
            best = len(room) - 1
        room[best] -= x
        place.append(best)
    return sorted(room)


def test_runs_equal_best_fit_decreasing():
    import random

    rng = random.Random(4)
    for _ in range(60):
        capacity = rng.choice([7, 30, 100])
        lengths = [min(capacity, int(rng.expovariate(3 / capacity)) + 1) for _ in range(rng.randrange(1, 150))]
        runs = packing.best_fit_decreasing(dict(Counter(lengths)), capacity)
        used = Counter()
        for run in runs:
            for i in range(run.items):
                spot = run.bin + i // run.each
                assert used[spot] == run.offset + i % run.each * run.length
                used[spot] += run.length
        assert sum(r.items for r in runs) == len(lengths)
        assert sorted(capacity - x for x in used.values()) == fit(lengths, capacity)


def test_packing(docs, rows, empty):
    got = packing.pack(docs, capacity=64).collect()
    ids = [whole("word_bpe_49k.json", r[1]).ids + [0] for r in rows]
    crc = lambda x: zlib.crc32(array("I", x).tobytes())
    want = Counter(
        (r[0], at // 64, at, len(x[at : at + 64]), crc(x[at : at + 64]))
        for r, x in zip(rows, ids, strict=True)
        for at in range(0, len(x), 64)
    )
    assert Counter(tuple(g)[:5] for g in got) == want
    at = {}
    for g in sorted(got, key=lambda g: (g["sequence_id"], g["offset"])):
        assert g["offset"] == at.get(g["sequence_id"], 0)
        at[g["sequence_id"]] = g["offset"] + g["length"]
    assert max(at.values()) <= 64
    assert sorted(64 - x for x in at.values()) == fit([len(x[i : i + 64]) for x in ids for i in range(0, len(x), 64)], 64)
    assert packing.pack(empty).count() == 0
