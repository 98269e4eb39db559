"""Small tables for the text operators."""
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def make(spark):
    """A documents table from (doc_id, text) pairs; every lang is ``en`` unless a third value says otherwise."""
    def table(*rows, extra=None):
        filled = [(r[0], r[1], r[2] if len(r) > 2 else "en", "src0", len(r[1] or "")) for r in rows]
        df = spark.createDataFrame(filled, DOCS)
        return df if extra is None else df.selectExpr("*", *extra)
    return table
