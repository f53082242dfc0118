import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))


@pytest.fixture(scope="session")
def docs(spark):
    """Documents with nulls, empty and repeated texts, and columns whose names clash with the operators' own."""
    rows = [
        (1, "Hello World", "en", "a"),
        (2, "hello world", "en", "a"),
        (3, None, None, "b"),
        (4, "", "en", None),
        (5, "one two three four five six seven eight nine ten", "en", "a"),
        (5, "one two three four five six seven eight nine ten", "en", "a"),
        (6, "Überall ist die schöne Straße, und der Weg ist weit", "de", "a"),
        (7, "x" * 5000, "en", "a"),
        (8, "word " * 30000, "en", "a"),
        (9, "123 456 !!!", "en", "a"),
        (10, "日本語 テスト 😀", "ja", "a"),
    ]
    return spark.createDataFrame([(*r, 0, 0, 0) for r in rows], "doc_id long, text string, lang string, source string, keep_id int, digest int, key int")


@pytest.fixture(scope="session")
def empty(docs):
    return docs.limit(0)
