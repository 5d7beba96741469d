import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, `body` string, `odd.name` int"
SYLLABLES = "the an er re on ti en le la de un qu es ra mi do ta ch ge st".split()


def words(rng, n):
    return " ".join("".join(rng.choice(SYLLABLES) for _ in range(rng.randint(1, 3))) for _ in range(n))


def odd_rows(seed=1, n=60):
    """Ordinary texts, copies, near copies, shared passages, nulls, blanks, very long ones, repeated rows."""
    rng = random.Random(seed)
    passage = words(rng, 40)
    texts = []
    for i in range(n):
        t = words(rng, rng.randint(1, 160))
        if i % 6 == 0:
            t = t[: len(t) // 2] + passage + t[len(t) // 2 :]
        if i % 7 == 0 and texts:
            t = rng.choice([x for x in texts if x])
        if i % 11 == 0:
            t = t.replace(" ", "\n", 5) + "\n\nend\nend"
        texts.append(t)
    texts += [None, "", " \n\t ", "x", "é€😀 A-Z", "ab " * 9000, "ab " * 9000 + "c", "z" * 5000, "A\x00b\x0bc d", passage, passage.upper(), "Theİ K secret"]
    rows = [(i, t, "en", None if i % 13 == 0 else f"s{i % 5}" if i % 3 else "hot", None if t is None else len(t), "clash", i) for i, t in enumerate(texts)]
    return rows + [rows[3], rows[3], (None, "no id here at all", "en", "hot", None, None, None)]


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def rows():
    return [(r[0], r[1]) for r in odd_rows()]
