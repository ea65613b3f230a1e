import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"

PROSE = "the quick brown fox jumps over the lazy dog while seven bright stars shine above quiet northern hills"


def variant(n: int, words: int = 60) -> str:
    """Prose of its own for each n."""
    return " ".join(f"{PROSE.split()[(k * (n + 3)) % 17]}{(k * k + n * 31) % 97}" for k in range(words))


ROWS = [
    (1, variant(1), "en", "a", 1),
    (2, None, "en", "a", 0),
    (3, "", "en", None, 0),
    (4, " \t\n ", "de", "b", 4),
    (5, variant(5), None, "b", 1),
    (6, variant(5), "en", "c", 1),
    (6, variant(5), "en", "c", 1),
    (7, variant(7) + " end", "en", "c", 1),
    (8, variant(7), "en", "a", 1),
    (9, "x" * 120_000, "en", "a", 1),
    (10, variant(10, 4000), "en", "a", 1),
    (11, "one", "en", "a", 1),
    (12, "Grün über Ärger\u00a0und \u2028 Straße", "de", "b", 1),
    (None, variant(13), "en", None, 1),
]


@pytest.fixture(scope="session")
def odd(spark):
    """NULLs in any column, blank, long and repeated texts, repeated ids."""
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def clashing(odd):
    """The same rows with more columns, named like those that the operators make."""
    names = "row _row key id _id n t w wh h s value size place part shard slot node tie content digest pick salt label quality score kept sketch root words end total ids"
    return odd.selectExpr("*", *(f"{k} as {name}" for k, name in enumerate(names.split())))


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.fixture(scope="session")
def same():
    """Asserts that two frames hold the same rows."""

    def check(a, b):
        assert a.columns == b.columns
        assert rows(a) == rows(b)

    return check
