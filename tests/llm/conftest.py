import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, id long, row string"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho".split()


def prose(seed, n=60):
    chooser = random.Random(seed)
    return " ".join(chooser.choice(WORDS) + str(chooser.randrange(30)) for _ in range(n))


@pytest.fixture(scope="session")
def table(spark):
    """Documents from (doc_id, text[, lang[, source]]), with extra columns of clashing names."""

    def build(*rows):
        full = [
            (d, t, *(rest[:2] + (None, None))[:2], None if t is None else len(t), True, 7, "x")
            for d, t, *rest in rows
            for rest in [tuple(rest)]
        ]
        return spark.createDataFrame(full, SCHEMA)

    return build


@pytest.fixture(scope="session")
def odd(table):
    """Nulls, empty and blank texts, a very long text, ties and repeated rows."""
    long = prose(99, 30_000)
    return table(
        (1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "One"), (6, prose(1)), (7, prose(1) + "  "),
        (8, long, "en", None), (9, long, None, "src0"), (10, "é ñ 中文 😀"), (11, "12 34 !!"), (None, prose(2)),
        (None, None), (12, prose(3)), (12, prose(3)), (13, "x" * 200_000),
    )


@pytest.fixture(scope="session")
def empty(table, odd):
    return odd.where("false")
