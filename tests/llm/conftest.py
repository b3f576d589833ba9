import random
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))


@pytest.fixture(scope="session")
def texts():
    """(doc_id, text): copies, near copies, shared passages and lines, nulls, empties, a long
    text, one-letter runs, odd white space, and several scripts."""
    r = random.Random(3)
    vocabulary = ["".join(r.choice("abcdeghlnorstu") for _ in range(r.randint(2, 8))) for _ in range(400)] + ["été", "Straße", "ñandú", "日本"]

    def words(n):
        return [r.choice(vocabulary) for _ in range(n)]

    def prose(n):
        w = words(n)
        return "".join(x + ("\n" if r.random() < 0.08 else " ") for x in w).strip()

    passage, line = " ".join(words(60)), " ".join(words(35))
    docs = [(i, prose(r.choice([3, 20, 80, 200]))) for i in range(60)]
    docs += [(100 + i, docs[5 + i % 3][1]) for i in range(12)]
    docs += [(200 + i, " ".join([*docs[9][1].split()[: 40 + i], "changed", *docs[9][1].split()[41 + i :]])) for i in range(5)]
    docs += [(300 + i, f"{prose(30)}\n{passage}\n{prose(15)}") for i in range(6)]
    docs += [(400 + i, f"{prose(10)}\n{line}\n{line}\n{prose(5)}") for i in range(3)]
    docs += [(500, None), (501, ""), (502, None), (503, " \t\r\n"), (504, "x"), (505, "x y"), (506, "a" * 700), (507, "Er " * 300), (508, " ".join(words(9000))), (509, " nb sp\x00 nul\x1c fs"), (510, "Er " * 120 + prose(40))]
    return docs


@pytest.fixture
def documents(spark, texts):
    """The texts with columns whose names clash with those that operators might use."""
    rows = [(d, t, "en", "s", len(t or ""), d, "x", d) for d, t in texts]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, chunk long, key string, _d long").repartition(3)


@pytest.fixture
def none(documents):
    return documents.limit(0)
