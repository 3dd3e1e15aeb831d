"""Documents with hard cases, written as Parquet like the given tables."""

import random

import pytest

from sleuthframe.llm.queries import prepare

LINE = "the quick brown fox jumps over the lazy dog while 12 men row home, "
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _file string, _row long, _pos int, size int"


def odd_rows():
    rng = random.Random(11)
    words = "alpha Beta gamma delta été 漢字 x1 don't 3,14 end. 😀 -- a\xa0b".split(" ")
    texts = [None, "", " \n\t ", "one", "one two", "ONE two", "a\n\nb\n", "x" * 5000, "é" * 700 + " ",
             LINE * 400, "same line\nsame line\nother\nsame line", "<|endoftext|> and  <|endoftext|>x",
             "call +1 (212) 555-0100 or card 4111 1111 1111 1111 iban GB82 WEST 1234 5698 7654 32 a.b@c.de 10.0.0.255",
             "\r\n\x0b\x0c line   with   blanks  ", LINE * 8, LINE * 8]
    for _ in range(30):
        texts.append(" ".join(rng.choice(words) for _ in range(rng.randrange(1, 120))))
    base = [f"w{rng.randrange(400)}" for _ in range(200)]
    for _ in range(12):
        near = list(base)
        for _ in range(rng.randrange(0, 9)):
            near[rng.randrange(200)] = f"n{rng.randrange(99)}"
        texts.append(" ".join(near))
    rows = [(i, t, None, (None, "a", "b", "é", "hot", "hot")[i % 6], None, "f", 1, 2, 3) for i, t in enumerate(texts)]
    rows += [(None, "null id text", "en", "a", 1, None, None, None, None), rows[3], rows[3], (9_007_199_254_740_993, "big", *rows[3][2:])]
    return rows


@pytest.fixture(scope="session")
def rows():
    return odd_rows()


@pytest.fixture(scope="session")
def docs(spark, tmp_path_factory):
    prepare(spark)
    path = str(tmp_path_factory.mktemp("docs") / "documents.parquet")
    spark.createDataFrame(odd_rows(), SCHEMA).repartition(3).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="session")
def empty(spark):
    prepare(spark)
    return spark.createDataFrame([], SCHEMA)
