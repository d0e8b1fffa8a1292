from __future__ import annotations

import random

import pytest

FIELDS = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, key string"


def corpus(seed: int = 1, n: int = 40) -> list[tuple]:
    """Unrelated texts, exact and near copies, a shared passage, and the awkward ones: null, empty, blank, short, repeated rows, a null id."""
    r = random.Random(seed)
    words = ["".join(r.choice("abcdefgé") for _ in range(r.randint(2, 7))) for _ in range(400)]
    fresh = lambda k: [r.choice(words) for _ in range(k)]
    passage, rows = fresh(60), []
    for i in range(n):
        own = fresh(r.randint(1, 150))
        if i % 5 == 1:
            own = own[:20] + passage + own[20:]
        if i % 7 == 3 and rows:
            own = rows[-1][1].split()
            if i % 2:
                own[len(own) // 2] = "changed"
        rows.append((i, " ".join(own)))
    rows += [(100, None), (101, ""), (102, " \n\t "), (103, "One two"), (104, "one TWO"), (105, "ha " * 300), (5, rows[5][1]), (106, rows[5][1].upper()), (None, rows[6][1]), (107, "<|endoftext|> naïve ΣΑΣ 漢字\n\n#$% " + rows[7][1])]
    return [(i, t, "en" if (i or 0) % 3 else None, f"src{(i or 0) % 4}", len(t or ""), True, "x") for i, t in rows]


@pytest.fixture(scope="session")
def rows() -> list[tuple]:
    return corpus()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, FIELDS).repartition(3).cache()


@pytest.fixture(scope="session")
def nothing(spark, docs):
    return spark.createDataFrame([], FIELDS)
