import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, k long"


def make_rows():
    """Documents with copies, near copies, shared passages and lines, nulls, empty, odd and very long texts."""
    r = random.Random(5)
    vocab = ["".join(r.choice("abcdeghinorstuéñ") for _ in range(r.randint(2, 9))) for _ in range(400)]
    prose = lambda n: " ".join(r.choice(vocab) for _ in range(n))
    passage, line, base = prose(45), "Shared line of plain words that many of the documents have in common", prose(120)
    texts = [prose(r.randint(1, 150)) for _ in range(25)]
    texts += [f"{prose(15)}\n{passage}\t{prose(20)}" for _ in range(6)]
    texts += [f"{prose(60)}\n  {line.upper() if i % 2 else line}\x0b\n{prose(9)}" for i in range(7)]
    texts += [base, base, base.upper(), base.replace(" ", "  ", 3)]
    for i in range(8):
        w = base.split()
        w[10 * i + 3] = f"edit{i}"
        texts.append(" ".join(w))
    texts += [None, "", " \n\t ", "one", "a b c d", "x\n\nx\n", "\u00a0non breaking\u2028words", "the cat " * 700, prose(6000), "9" * 3000, "a" * 5000 + "@"]
    rows = [(i, t, "en", f"s{i % 3}", len(t or ""), "clash", i) for i, t in enumerate(texts)]
    r.shuffle(rows)
    return [*rows, rows[0], rows[0], (None, base, None, None, None, None, None), (None, None, None, None, None, None, None)]


@pytest.fixture(scope="session")
def docs(spark):
    return spark.createDataFrame(make_rows(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def rows(docs):
    return [(x["doc_id"], x["text"]) for x in docs.collect()]
