import pytest

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns that an operator might use for itself.
CLASHES = ["score", "predicted", "spans", "text_in", "copies", "Size", "h_", "d_", "place_", "kept", "token_ids", "decoded", "row_", "fp", "target"]


def prose(k, n=70):
    """A text of n words that shares no 5-gram with prose of another k."""
    return " ".join(f"w{k}x{j}" for j in range(n)) + "."


@pytest.fixture(scope="session")
def awkward(spark):
    """Null, empty, tied, repeated and very long texts, null ids and sources."""
    rows = [
        (1, prose(1), "en", "a"), (2, prose(1), "en", "b"), (2, prose(1), "en", "b"), (3, None, "en", None), (None, prose(2), None, None),
        (None, None, None, "a"), (4, "", "de", "é"), (5, "   \n\t ", "de", "b"), (6, prose(3, 40_000), "fr", "b"), (7, "x" * 200_000, "fr", "c"),
        (8, prose(1) + " tail", "en", "c"), (9, "one two", "en", "a"), (10, "one two", "en", "a"),
    ]
    return spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], COLUMNS)


@pytest.fixture(scope="session")
def clashing(awkward):
    """The same rows with columns under names that operators use themselves."""
    from pyspark.sql import functions as F

    return awkward.select("*", *[F.concat(F.lit("own"), F.coalesce(F.col("source"), F.lit(""))).alias(c) for c in CLASHES])


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], COLUMNS)
