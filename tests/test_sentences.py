"""Sentences that begin or end with digits, above all with the number of their place, and blanks."""

import pytest

from lexispark.plans import registry
from tests.oracle import compare

TEXTS = [
    "0 zero is here 0. 1 one is there 1. 22 two of them 2. It is three.",
    "  First 0; 1.19.37.233.111 second 1; 2; 3 3 3 third 33. 4",
    " ".join(f"{i} word{i % 3} this {i}." for i in range(24)),
    "  One.  　Two words.   . Three ",
    "0x in 0x. 1y and 1y. Three words in it",
    "0",
    "First one. Then a word. Last word\n",
    "",
    None,
]


@pytest.mark.parametrize("name", ["sentences", "best_context_for_prompt", "context_topk", "context_topk_all"])
def test_digits_and_blanks(spark, tmp_path, name):
    rows = [(i, t, "en", "web") for i, t in enumerate(TEXTS)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").coalesce(1).write.parquet(str(tmp_path / "made"))
    next((tmp_path / "made").glob("*.parquet")).rename(tmp_path / "documents.parquet")
    assert compare(spark, registry.queries()[name], registry.oracle_sql()[name], str(tmp_path))
