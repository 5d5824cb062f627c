import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars int, size string, h long"


def hard_rows(seed=5):
    """Rows with nulls in any column, empty and very long texts, ties, repeated rows and columns whose names clash."""
    r = random.Random(seed)
    vocabulary = [f"{a}{b}{c}" for a in "bdfgklmn" for b in "aeiou" for c in ("", "rt", "s", "nd", "ß", "é")]
    prose = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    passage = prose(120)
    long_ = prose(30_000)
    texts = [prose(r.randint(1, 300)) for _ in range(60)]
    texts += [passage, f"{prose(40)} {passage}", f"{passage} {prose(30)} {passage}", f"{prose(10)} {passage[:450]}", passage[:400], passage[:399]]
    near = prose(200).split()
    for k in range(6):
        changed = list(near)
        for i in range(0, k * 2, 2):
            changed[i * 9] = "changed"
        texts.append(" ".join(changed))
    texts += [long_, f"{long_} end", "", " ", "\n\n", None, None, "1234 5678 !!", "a", "ab ab ab ab ab", "x" * 900, "Word", "\0null\0", "日本語のテキスト" * 60, "a\x0bb\x1fc d"]
    texts += ["same text here for all of them"] * 7 + [f"{passage}\n{passage}\n{passage}"]
    rows = [(k, t, r.choice(["en", "de", None]), r.choice(["web", "book", "code", None]), None if t is None else len(t), "clash", k % 3) for k, t in enumerate(texts)]
    rows += [rows[3], rows[3], (None, "text without an id but with words", "en", "web", 5, None, None), (None, None, None, None, None, None, None), (-5, texts[7], "en", "web", 1, None, None)]
    r.shuffle(rows)
    return rows


@pytest.fixture(scope="session")
def rows():
    return hard_rows()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(4)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
