"""The pipeline, stage by stage, against what each stage alone must do."""

import re
import zlib
from array import array

from tokenizers import Tokenizer

import __spark_entry__ as entry_points
import corpus_pipeline
from sleuthframe.llm import quality
from sleuthframe.llm.encode import public
from sleuthframe.llm.tables import read, shared_folder
from test_tables import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_registered():
    numbers = {re.match(r"op(\d+)_", q)[1] for q in entry_points.queries() if q.startswith("op")}
    assert numbers == {str(i) for i in range(1, 14)}
    assert "pipeline" in entry_points.queries()


def test_stages(spark, data):
    corpus_pipeline.prepare(spark)
    docs = read(spark, data, "documents")
    columns, steps = docs.columns, [docs]
    for name, stage in corpus_pipeline.STAGES:
        path = shared_folder(spark, name)
        stage(spark, steps[-1], data).write.parquet(path)
        steps.append(spark.read.parquet(path))
    assert all(s.columns == columns for s in steps[:-1])
    judged = {int(r["id"]): r["kept"] for r in quality.judge(quality.judged_rows(docs)).collect()}
    good = sorted(steps[1].collect())
    assert {r["doc_id"] for r in good} == {k for k, v in judged.items() if v}
    _, root = components([r["text"] for r in good], 5)
    unique = {good[i]["doc_id"] for i in set(root)}
    single = {r["doc_id"]: r["text"] for r in steps[2].collect()}
    assert set(single) == unique and steps[2].count() == len(unique)
    clean = {r["doc_id"]: r["text"] for r in steps[3].collect()}
    assert set(clean) == unique
    assert any("<email>" in t for t in clean.values()) or not any(re.search(r"\w@\w+\.\w", t) for t in single.values())
    assert all(clean[k] == t for k, t in single.items() if not re.search(r"[0-9@]", t))
    taken = {}
    for r in steps[4].collect():
        assert clean[r["doc_id"]].startswith(r["text"])
        taken[r["doc_id"]] = taken.get(r["doc_id"], 0) + len(WORD.findall(r["text"]))
    assert all(n <= 2 * len(WORD.findall(clean[k])) for k, n in taken.items())
    encode = Tokenizer.from_file(public("word_bpe_49k.json")).encode
    want = []
    for r in steps[4].collect():
        ids = encode(r["text"], add_special_tokens=False).ids + [0]
        for at in range(0, len(ids), 2048):
            part = ids[at : at + 2048]
            want.append((r["doc_id"], at // 2048, at, len(part), zlib.crc32(array("I", part).tobytes())))
    got = steps[5].collect()
    assert sorted(tuple(r)[:5] for r in got) == sorted(want)
    assert len({r["sequence_id"] for r in got}) <= sum(w[3] for w in want) // 2048 + 2


def test_stages_on_hard_rows(spark, docs, rows, tmp_path):
    """Nulls, empty and long texts, repeated rows, clashing column names; long enough ones pass the quality rules."""
    corpus_pipeline.prepare(spark)
    long = [f"w{i} alpha beta{i}" for i in range(300)]
    longer = "\n".join(f"v{i} gamma delta{i}" for i in range(9000)) + " mail a.b@c.de now"
    more = [
        (None, " ".join(long) + " mail a.b@c.de now", None, None, None, None, None, None, None),
        (900, " ".join(long[:250]), "en", None, 1, "f", 1, 2, 3),
        (901, longer, None, "é", 1, None, None, None, None),
        (902, longer, None, "b", 1, None, None, None, None),
    ]
    folder = str(tmp_path / "in")
    spark.createDataFrame([*rows, *more, more[1]], docs.schema).repartition(2).write.parquet(f"{folder}/documents.parquet")
    columns, docs, kept = docs.columns, read(spark, folder, "documents"), []
    for name, stage in corpus_pipeline.STAGES:
        path = shared_folder(spark, name)
        stage(spark, docs, folder).write.parquet(path)
        docs = spark.read.parquet(path)
        kept.append(docs)
    assert all(k.columns == columns for k in kept[:-1])
    good, unique, clean, mixed = ([tuple(r)[:2] for r in k.collect()] for k in kept[:-1])
    assert all(t and len(WORD.findall(t)) >= 50 for _, t in good)
    ids = [i for i, _ in unique]
    assert len(ids) == len(set(ids)) and 900 in ids and 901 in ids and 902 not in ids
    assert len(clean) == len(unique) and not any("a.b@c.de" in t for _, t in clean)
    assert {i for i, _ in mixed} <= set(ids)
    pieces = kept[-1].collect()
    assert all(r["length"] <= 2048 for r in pieces) and {r["doc_id"] for r in pieces} == {i for i, _ in mixed}


def test_empty_table(spark, empty, tmp_path):
    empty.write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
