import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

SMALL = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, fingerprint string, sequence_id string, key string"


@pytest.fixture(scope="session")
def llm(spark):
    from accesslake.llm.common import shipped

    return shipped(spark)


@pytest.fixture(scope="session")
def small(llm):
    from accesslake import Tables

    return Tables(llm, SMALL)


@pytest.fixture(scope="session")
def odd(llm):
    """Null ids and texts, empty and long texts, texts without white space, repeated rows, names that clash."""
    long = " ".join(f"word{i % 977}x{i % 13}" for i in range(30000))
    texts = [None, "", "a", " \n\t ", "one two three", "one two three", long, "x" * 5000, "日本語のテキスト" * 40, "a" * 900, "tab\tend ", "  two  spaces \n\n x", "<|endoftext|> done"]
    rows = [(i, t, "en", "s", len(t or ""), "f", "q", "k") for i, t in enumerate(texts)]
    rows += [(None, "one two three", None, None, None, None, None, None), (None, None, None, None, None, None, None, None), (3, " \n\t ", "en", "s", 4, "f", "q", "k"), (3, " \n\t ", "en", "s", 4, "f", "q", "k")]
    return llm.createDataFrame(rows, DOCS)


@pytest.fixture(scope="session")
def empty(llm):
    return llm.createDataFrame([], DOCS)
