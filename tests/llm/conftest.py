import pytest

#: Nulls, empty and blank texts, repeated rows, ties, one very long text.
ROWS = [
    (1, "The cat sat on the mat with the other cat and slept there", "en", "a"),
    (1, "The cat sat on the mat with the other cat and slept there", "en", "a"),
    (2, "THE CAT sat on the mat with the other cat and slept there", "en", "b"),
    (3, None, None, None),
    (4, "", "en", "a"),
    (5, " \t\n", "de", None),
    (6, "der Hund und die Katze sind nicht im Haus und schlafen", "de", "b"),
    (7, "word " * 30_000, "en", "b"),
    (None, "le chat est sur la table avec le chien et il dort", "fr", "a"),
    (8, "12345 !!", None, "a"),
    (9, "É é À", "fr", "b"),
    (10, "é É à", "fr", "b"),
]


@pytest.fixture(scope="session")
def awkward(spark):
    """The rows above, with columns whose names the operators use inside."""
    df = spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string")
    for name in ("kept", "place", "gone_key", "own_key", "rep", "row", "shard", "size", "n", "digest", "score", "target", "_metadata", "a.b"):
        df = df.selectExpr("*", f"'x' AS `{name}`")
    return df


@pytest.fixture(scope="session")
def empty(awkward):
    return awkward.limit(0)
