import random

import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, words string, row string, bucket int, key int, node int"


def prose(rng, n):
    return " ".join(rng.choice(["the", "of", "and", "to", "thing", "ering", "stone", "river", "house", "walk", "light", "Ärger", "naïve", "x1", "—"]) + rng.choice(["", "", ",", ".", "s"]) for _ in range(n))


def edge_texts():
    rng = random.Random(5)
    base = prose(rng, 120)
    near = base.split()
    near[60] = "changed"
    texts = [base, base, base.upper(), " ".join(near), prose(rng, 200), prose(rng, 60), "", None, "  \n\t ", "one", "one two", "One  TWO", "a b c", "same line\nsame line\nsame line\n\nsame line"]
    texts += [prose(rng, 4000), "ab" * 3000, "漢字かな交じり文" * 40, "emoji 😀😀 zwj 👩‍👩‍👧 é  nbsp　wide", "<|endoftext|> in <|endoftext|>", "*** ### $$$ " * 60, "stop it. " * 80]
    return texts


@pytest.fixture(scope="session")
def edge_rows():
    rows = [(i, t, ["en", "de", None, "xx"][i % 4], f"src{i % 3}", None if t is None else len(t)) for i, t in enumerate(edge_texts())]
    rows.append((None, "no id but some words here", "en", "src0", 25))
    rows.append((4, rows[4][1], "en", "src1", None))  # a repeated row
    return rows


@pytest.fixture(scope="session")
def edge_docs(spark, edge_rows):
    """Nulls, empty and long texts, ties, repeated rows, and columns whose names clash with inner ones."""
    return spark.createDataFrame([(*r, "w", "r", 1, 2, 3) for r in edge_rows], SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
