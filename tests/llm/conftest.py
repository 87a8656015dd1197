import random
import struct

import pytest
import xxhash

#: Rows that every operator on documents must take: nulls in any column, empty and blank texts, repeated rows,
#: one id twice, a very long text, ties, and columns whose names operators might use themselves.
DOCS = "doc_id long, text string, lang string, source string, n_chars long, size long, h long, rank string, component string, key string, n long"


def hard_rows():
    rng = random.Random(5)
    words = [rng.choice("abcdefghij") * rng.randint(1, 4) for _ in range(60)]
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))
    long = "\n".join(say(30) for _ in range(120))
    base = "\n".join(say(12) for _ in range(6))
    texts = [None, "", " \t\n\x0b", "one", "one two three", base, base, base + " extra", base.replace("a", "b", 1), long, long[:-40] + " tail", "é\u00a0ß\u2003ü x " * 9, say(40), say(40) + "\n" + base, "x" * 5000, "# $ % & * | < >" * 5, say(25).upper()]
    rows = [(i * 3, t, "en", ["s0", "s1", None][i % 3], None if t is None else len(t), i, None, "r", "c", "k", 1) for i, t in enumerate(texts)]
    rows += [rows[5], rows[5], (15, "another text of the same id " + say(20), None, "s1", 1, None, 1, None, None, None, None), (None, base, "en", "s0", 1, 1, 1, "", "", "", 1), (None, None, None, None, None, None, None, None, None, None, None)]
    return rows


@pytest.fixture(scope="session")
def docs(spark):
    return spark.createDataFrame(hard_rows(), DOCS)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)


def spark_hash(*values):
    """What xxhash64 gives in Spark for strings, whole numbers (as long) and nulls, one after the other."""
    h = 42
    for v in values:
        if v is not None:
            h = xxhash.xxh64_intdigest(v.encode() if isinstance(v, str) else struct.pack("<q", v), h)
    return h - 2**64 if h >= 2**63 else h


@pytest.fixture(scope="session")
def hashed():
    return spark_hash


#: A text beyond any page of a book, for each operator.
LONG = "\n".join(" ".join(f"w{(i * 7919 + k * k) % 9973}" for k in range(14)) for i in range(9000))


@pytest.fixture(scope="session")
def long_docs(spark):
    rows = [(1, LONG, "a"), (2, LONG + " end", "a"), (3, "short text of a few words", "b"), (4, LONG[:700_000], "b")]
    return spark.createDataFrame(rows, "doc_id long, text string, source string")
