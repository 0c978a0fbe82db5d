import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, size string, label string"


def sentence(r: random.Random, words: list[str], n: int) -> str:
    return " ".join(r.choice(words) for _ in range(n)).capitalize() + "."


@pytest.fixture(scope="session")
def rows():
    """Odd and ordinary documents: nulls, blanks, ties, repeated rows, near copies, a long text, clashing extra columns."""
    r = random.Random(3)
    words = ["".join(r.choice("abcdefghij") for _ in range(r.randrange(2, 8))) for _ in range(300)]
    texts = [" ".join(sentence(r, words, r.randrange(4, 14)) for _ in range(r.randrange(1, 25))) for _ in range(60)]
    base = texts[0].split()
    near = [" ".join(base[:i] + ["zz"] + base[i + 1 :]) for i in range(3, min(len(base), 60), 9)]
    texts += near + [texts[1], texts[1], texts[2].upper(), None, "", "  \n\t ", "one", "one two three", "one two three", "word " * 400, "\n".join([texts[5]] * 3), " ".join(texts[:30]) * 3, "Grüße aus <s>[INST] Köln ß"]
    out = [(i, t, "en", None if i % 11 == 5 else f"s{i % 3}" if i % 2 else "s0", len(t or ""), 1.5, "x", None) for i, t in enumerate(texts)]
    out.append(out[7])
    out.append((None, texts[9], None, "s1", None, None, None, None))
    return out


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
