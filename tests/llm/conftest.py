import random

import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def words(rng, n, pool=400):
    return [f"w{rng.randrange(pool)}" for _ in range(n)]


def corpus(seed=7):
    """Texts with copies, near copies, shared passages, junk, nulls, empties and repeated rows."""
    rng = random.Random(seed)
    passage = " ".join(words(rng, 120, 10**6))
    out = [None, "", " \n\t ", "one", "One two", "é ü ñ 日本", "a b c d", "A b C d"]
    for _ in range(60):
        out.append(" ".join(words(rng, rng.randrange(5, 300), 10**6)))
    for base in out[10:16]:
        for _ in range(6):
            w = base.split()
            for _ in range(max(1, len(w) // 60)):
                w[rng.randrange(len(w))] = f"x{rng.random()}"
            out.append(" ".join(w))
        out += [base, base.upper()]
    out += [f"{rng.random()} {passage} {rng.random()}" for _ in range(8)]
    out += ["### $$$ %%% " * 30, "same line here now\n" * 20, "of the " * 100, "SHOUT LOUDLY HERE NOW " * 15, "ab" * 900, "z" * 1300]
    return out


@pytest.fixture(scope="session")
def texts():
    return corpus()


@pytest.fixture(scope="session")
def docs(spark, texts):
    rows = [(k, t, "en", [f"s{k % 5}", None, "hot"][k % 3], len(t or "")) for k, t in enumerate(texts)]
    rows += [rows[20], (None, "no id at all but text", None, "s1", None)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
