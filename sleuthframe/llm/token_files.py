"""Token ids in binary files with a minimal perfect hash index per file.

A file holds the raw ids of a bounded range of documents in ascending order, and an index over their keys. The index is a
minimal perfect hash: n keys fall on n slots without a collision, and a slot keeps a fingerprint of its key, the place of
the ids and their number. A key is found in constant time without being stored; a foreign key is told by the fingerprint.

File format, little-endian: 8 bytes magic; unsigned 32-bit length of the header; header (JSON: documents, buckets, ids,
width in bytes); one signed 32-bit displacement per bucket; per slot fingerprint (u4), first id (u8), number of ids (u4);
per document in ascending order its slot (u4); ids (u2 if the vocabulary fits, else u4); keys as UTF-8 lines.

Defined cases: null and empty texts have the end id only; null ids come first and have the key of an empty line; repeated
ids are told apart by a running number in the key; an empty table gives no files; only id and text are used.
"""

from __future__ import annotations

import bisect
import json
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sleuthframe.llm.encode import encoder, public
from sleuthframe.llm.tables import file_system, settle, shared_folder

MAGIC = b"TOKIDS\x01\n"
END_ID = 2
FILE_IDS = 8_000_000
FILE_DOCS = 65_536
KEYS_PER_BUCKET = 3
SLOT = np.dtype([("mark", "<u4"), ("first", "<u8"), ("number", "<u4")])


# -- minimal perfect hash ------------------------------------------------------------------------------------


def hashes(keys: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes per key."""
    both = [xxhash.xxh3_128_intdigest(k.encode()) for k in keys]
    low = np.array([x & 0xFFFFFFFFFFFFFFFF for x in both], "uint64")
    return np.array([x >> 64 for x in both], "uint64"), low


def slots_at(high: np.ndarray, low: np.ndarray, displacement: np.ndarray, n: int) -> np.ndarray:
    """Slots of keys under displacements."""
    with np.errstate(over="ignore"):
        x = high + displacement.astype("uint64") * (low | np.uint64(1))
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        return ((x ^ (x >> np.uint64(32))) % np.uint64(n)).astype("int64")


def build_index(keys: list[str]) -> np.ndarray:
    """Displacements by bucket: the first number under which a bucket's keys meet free slots only.

    Large buckets choose first. A bucket of one key names its slot outright, as a negative number.
    """
    n = len(keys)
    buckets = max(1, -(-n // KEYS_PER_BUCKET))
    high, low = hashes(keys)
    home = (low % np.uint64(buckets)).astype("int64")
    order = np.argsort(home, kind="stable")
    bounds = np.searchsorted(home[order], np.arange(buckets + 1))
    sizes = np.diff(bounds)
    displacement = np.zeros(buckets, "int32")
    free = np.ones(n, bool)
    for bucket in np.argsort(-sizes, kind="stable"):
        members = order[bounds[bucket] : bounds[bucket + 1]]
        if len(members) < 2:
            break
        tried = 0
        while True:
            block = np.arange(tried, tried + 64)
            at = slots_at(high[members][:, None], low[members][:, None], block[None, :], n)
            good = free[at].all(axis=0)
            for j in np.flatnonzero(good):
                if len(set(at[:, j])) == len(members):
                    free[at[:, j]] = False
                    displacement[bucket] = tried + j
                    break
            else:
                tried += 64
                continue
            break
    rest = np.flatnonzero(free)
    single = np.flatnonzero(sizes == 1)
    displacement[single] = -rest[: len(single)] - 1
    return displacement


def find_slots(displacement: np.ndarray, n: int, keys: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Slot and fingerprint of each key, whether or not the index knows it."""
    high, low = hashes(keys)
    own = displacement[(low % np.uint64(len(displacement))).astype("int64")].astype("int64")
    spread = slots_at(high, low, np.maximum(own, 0), n)
    return np.where(own < 0, -own - 1, spread), (high >> np.uint64(32)).astype("uint32")


# -- files ---------------------------------------------------------------------------------------------------


def pack_file(keys: list[str], parts: list[bytes], width: int) -> bytes:
    """A file of documents in the given order; ``parts`` are their ids as unsigned 32-bit integers."""
    n = len(keys)
    displacement = build_index(keys)
    slot, mark = find_slots(displacement, n, keys)
    numbers = np.array([len(p) // 4 for p in parts], "uint64")
    table = np.zeros(n, SLOT)
    table["mark"][slot] = mark
    table["first"][slot] = np.cumsum(numbers) - numbers
    table["number"][slot] = numbers
    ids = np.frombuffer(b"".join(parts), "<u4").astype(f"<u{width}")
    header = json.dumps({"documents": n, "buckets": len(displacement), "ids": len(ids), "width": width}).encode()
    sections = [displacement.astype("<i4"), table, slot.astype("<u4"), ids]
    return b"".join(
        [MAGIC, np.uint32(len(header)).tobytes(), header, *[s.tobytes() for s in sections], "\n".join(keys).encode()]
    )


class TokenFile:
    """Keyed access to the ids of one file."""

    def __init__(self, raw: bytes):
        if raw[:8] != MAGIC:
            raise ValueError("not a token file")
        at = 12 + int(np.frombuffer(raw, "<u4", 1, 8)[0])
        head = json.loads(raw[12:at])
        self.documents = head["documents"]
        self.displacement = np.frombuffer(raw, "<i4", head["buckets"], at)
        at += self.displacement.nbytes
        self.table = np.frombuffer(raw, SLOT, self.documents, at)
        at += self.table.nbytes
        self.order = np.frombuffer(raw, "<u4", self.documents, at)
        at += self.order.nbytes
        self.ids = np.frombuffer(raw, f"<u{head['width']}", head["ids"], at)
        self.keys = raw[at + self.ids.nbytes :].decode().split("\n")

    def places(self, keys: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """First id and number of ids of each key; -1 for keys that the file doesn't hold."""
        slot, mark = find_slots(self.displacement, self.documents, keys)
        row = self.table[slot]
        known = row["mark"] == mark
        return np.where(known, row["first"].astype("int64"), -1), np.where(known, row["number"].astype("int64"), -1)

    def get(self, key: str) -> np.ndarray | None:
        """The ids of a document."""
        first, number = self.places([key])
        return None if first[0] < 0 else self.ids[first[0] : first[0] + number[0]].astype("<u4")


def write_tokens(
    docs: DataFrame,
    folder: str | None = None,
    path: str | None = None,
    end_id: int = END_ID,
    id_col: str = "doc_id",
    text_col: str = "text",
    file_ids: int = FILE_IDS,
    file_docs: int = FILE_DOCS,
) -> str:
    """Write the ids of all whole texts in ascending order of the ids of the documents; returns the folder.

    A task writes its range of documents into files of bounded size. A file gets its name when it is whole, and only the
    names that the successful attempts report enter the manifest, so a task that runs again leaves the result as it is.
    """
    spark = docs.sparkSession
    folder = folder or shared_folder(spark, "tokens")
    path = path or public("byte_bpe_50k.json")
    closing = np.asarray([end_id], "<u4").tobytes()

    def write(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = encoder(path)
        store, base = file_system(folder)
        width = 2 if max(known.tokenizer.get_vocab_size(), end_id + 1) <= 1 << 16 else 4
        part, number = TaskContext.get().partitionId(), 0
        keys, parts, size, last, times = [], [], 0, None, 0

        def flush() -> pd.DataFrame:
            name = f"part-{part:05d}-{number:05d}-{uuid.uuid4().hex}.tokens"
            store.create_dir(base, recursive=True)
            with store.open_output_stream(f"{base}/{name}.writing") as out:
                out.write(pack_file(keys, parts, width))
            store.move(f"{base}/{name}.writing", f"{base}/{name}")
            return pd.DataFrame([(part, number, name, len(keys), size // 4, keys[0], keys[-1])])

        for frame in frames:
            for key, text in zip(frame["id"], frame["text"], strict=True):
                key = "" if key is None else key
                times = times + 1 if key == last else 0
                last = key
                raw = known.encode(text) + closing
                if keys and (size + len(raw) > 4 * file_ids or len(keys) >= file_docs):
                    yield flush()
                    keys, parts, size, number = [], [], 0, number + 1
                keys.append(f"{key}\t{times}" if times else key)
                parts.append(raw)
                size += len(raw)
        if keys:
            yield flush()

    texts = docs.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{text_col}`").alias("text"))
    order = [F.asc_nulls_first("_id"), F.xxhash64("text")]
    ranged = texts.repartitionByRange(*order).sortWithinPartitions(*order)
    files = settle(
        ranged.select(F.col("_id").cast("string").alias("id"), "text").mapInPandas(
            write, "part int, number int, name string, documents long, ids long, first_key string, last_key string"
        )
    )
    # One row per file of bounded size.
    before = Window.orderBy("part", "number").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum("ids").over(before), F.lit(0))
    files.withColumn("start", start).coalesce(1).write.parquet(f"{folder}/manifest")
    return folder


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    """One row per file: name, documents, ids, ids of all files before it, first and last key."""
    return spark.read.parquet(f"{folder}/manifest")


def read_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """(key, start, n_tokens, ids_crc32) of every document, read back through the index of its file."""
    files = manifest(spark, folder)
    spread = files.select("name", "start").repartition(max(1, files.count()), "name")

    def load(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, base = file_system(folder)
        for frame in frames:
            for name, start in zip(frame["name"], frame["start"], strict=True):
                with store.open_input_file(f"{base}/{name}") as f:
                    file = TokenFile(f.read())
                first, number = file.places(file.keys)
                if (first < 0).any() or (file.order != find_slots(file.displacement, file.documents, file.keys)[0]).any():
                    raise ValueError(f"index of {name} doesn't match its keys")
                ids = file.ids
                crc = [
                    zlib.crc32(ids[a : a + k].astype("<u4").tobytes())
                    for a, k in zip(first.tolist(), number.tolist(), strict=True)
                ]
                yield pd.DataFrame(
                    {"key": file.keys, "start": start + first, "n_tokens": number, "ids_crc32": np.array(crc, "int64")}
                )

    return spread.mapInPandas(load, "key string, start long, n_tokens long, ids_crc32 long")


class TokenFolder:
    """Keyed access to all files of a folder, for whole-number ids: the manifest names the file, its index the place."""

    def __init__(self, spark: SparkSession, folder: str):
        self.store, self.base = file_system(folder)
        rows = manifest(spark, folder).orderBy("part", "number").collect()  # one row per file
        self.files = [(r["first_key"], r["name"]) for r in rows]
        self.firsts = [_number(r["first_key"]) for r in rows]
        self.open: dict[str, TokenFile] = {}

    def get(self, key: int, occurrence: int = 0) -> np.ndarray | None:
        """The ids of a document, or null."""
        name = f"{key}\t{occurrence}" if occurrence else str(key)
        at = bisect.bisect_right(self.firsts, (key, occurrence)) - 1
        # Equal ids may go on in later files; the running number starts anew with each task.
        while 0 <= at < len(self.files):
            file = self._file(self.files[at][1])
            found = file.get(name)
            if found is not None:
                return found
            at = at - 1 if self.firsts[at][0] == key else -1
        return None

    def _file(self, name: str) -> TokenFile:
        if name not in self.open:
            with self.store.open_input_file(f"{self.base}/{name}") as f:
                self.open[name] = TokenFile(f.read())
        return self.open[name]


def _number(key: str) -> tuple[float, int]:
    head, _, times = key.partition("\t")
    return (float("-inf") if head == "" else int(head), int(times or 0))
