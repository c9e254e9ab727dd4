import random

import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
#: Extra columns named as anything inside the operators is, and with a dot and a tick.
CLASHES = [f"{i} as `{n}`" for i, n in enumerate(
    "th own gone my_own my_th keep size group best n a b key u v __id __th __gone __spans __items spans items h line x first "
    "doc_id2 chunk bucket keys counts n_tokens score p state values places fh votes piece shard cost a.b c`d".replace("`", "``").split()
)]
_HALVES = [a + b for a in "ka lo mi nu per sta tri vo zan".split() for b in "dor el fin gast hum ik".split()]
WORDS = [a + b for a in _HALVES for b in _HALVES]


def prose(seed: int, n: int, words=WORDS) -> str:
    r = random.Random(seed)
    out = [r.choice(words) for _ in range(n)]
    for i in range(12, n, 13):
        out[i] += r.choice([".", ",", ".\n"])
    return " ".join(out)


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in any column, empty and very long texts, repeated rows, ties."""
    long = prose(1, 60_000)
    rows = [
        (1, prose(2, 80), "en", "a", 5), (2, None, "en", "a", None), (3, "", None, None, 0), (4, " \n\t ", "de", "b", 4),
        (None, prose(3, 90), "en", "a", 1), (5, long, "en", "a", len(long)), (6, prose(2, 80), "en", "b", 5), (7, prose(4, 70), None, "a", 7),
        (7, prose(4, 70), None, "a", 7), (8, "one", "en", "a", 3), (9, "éß\U0001f600 \x00 x", "fr", "c", 9), (None, None, None, None, None),
    ]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
