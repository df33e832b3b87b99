import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, row long, fp string, node string, size string"


@pytest.fixture(scope="session")
def edge_docs(spark):
    """Nulls in every column, empty, very long and repeated texts, repeated rows, clashing extra columns."""
    long = "alpha beta gamma delta " * 30_000
    rows = [
        (1, "The quick brown fox jumps over the lazy dog, and all rights reserved.", "en", "a", 10),
        (2, "the quick brown fox jumps over the lazy dog, and all rights reserved.", "en", "a", 10),
        (3, None, None, None, None),
        (4, "", "en", "a", 0),
        (5, " \t\n ", "en", "b", 4),
        (6, long, "en", "b", len(long)),
        (7, "Größe ÄÖÜ ñandú 日本語 😀 \x1c x²", "de", "c", 9),
        (8, "12345 67890 --- !!!", "en", "c", 9),
        (9, "CC BY CC BY-SA general public license", "en", "c", 9),
        (9, "CC BY CC BY-SA general public license", "en", "c", 9),
        (None, "a text without an id", "en", None, 9),
        (10, "x", "fr", "d", 1),
    ]
    return spark.createDataFrame([(*r, 1, "f", "n", "s") for r in rows], SCHEMA)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
