import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, key long, n long, comp long, tokens long, label int, hash long, copies int"


def _sentence(rng, n):
    return " ".join(rng.choice(["alpha", "beta", "Gamma", "delta", "epsilon", "zeta", "eta", "theta"]) + str(rng.randint(0, 400)) for _ in range(n))


@pytest.fixture(scope="session")
def texts():
    """Texts with exact copies, near copies, a shared passage, blanks and odd bytes, by id; id None for two of them."""
    rng = random.Random(5)
    base = [_sentence(rng, rng.randint(60, 160)) for _ in range(30)]
    passage = _sentence(rng, 60)
    out = list(base) + [base[0], base[0].upper(), base[1], base[1]]
    for b in base[2:14]:
        words = b.split()
        for _ in range(rng.randint(1, 4)):
            words[rng.randrange(len(words))] = "changed" + str(rng.randint(0, 99))
        out.append(" ".join(words))
    for b in base[14:18]:
        out.append(b[: len(b) // 2] + "\n" + passage + "\n" + b[len(b) // 2 :])
    out += ["", None, " \t\n ", "one", "one two three", "ONE two  three", "a\x00b \u00e9t\u00e9 \u4e2d\u6587", "x " * 3000, "x " * 3001]
    return [*enumerate(out), (None, "null id text here"), (None, None), (7, base[7]), (3, "another text of the same id")]


@pytest.fixture(scope="session")
def docs(spark, texts):
    rows = [(i, t, ("en", "de", None)[k % 3], f"src{k % 5}" if k % 7 else None, None if t is None else len(t), 1, 2, 3, 4, 5, 0, 7, 8) for k, (i, t) in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
