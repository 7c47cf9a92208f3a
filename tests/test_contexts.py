"""Contexts, words and sentences of letters whose lower case depends on Java or on their
neighbours, of letters newer than Java, of ids below zero and of none."""

import pytest

from lexispark.plans import registry
from tests.oracle import compare

TEXTS = {
    "sigma": [(1, "ΟΔΟΣ'Α ὁδός. ΟΔΟΣ ΟΔΟΣ’ΒΣ; ΣΑΣ σας Σας"), (2, "ΑΣ́Α ασ ΑΣ. Σ")],
    "dotted": [(1, "İSTANBUL istanbul'da İstanbul here. Two İ then İX word"), (2, "ISTANBUL word worḋ")],
    "newer": [(1, "aࡰb c\U00010570d. \U00010597d e"), (2, "x\U00031350y zⰯ Zⱟ")],
    "below": [(-i, f"shared shares{'abcdefgh'[i]} share. Sharing them") for i in range(8)],
    "mark": [(1, "One\x01two. Three\x01. \x01"), (2, "\x01Four. Five")],
    "none": [(None, "One two ONE. Two one One oneself"), (3, "one two. three ONE"), (-5, "One Two two")],
}
CASES = [(n, k) for n in ("context_topk", "context_topk_all") for k in TEXTS] + [(n, k) for n in ("form_occurrences", "lemma_frequency", "best_context_for_prompt") for k in ("sigma", "dotted", "newer")] + [("sentences", "mark")]


@pytest.mark.parametrize("name,texts", CASES)
def test_odd_texts(spark, tmp_path, name, texts):
    rows = [(i, t, "el", "web") for i, t in TEXTS[texts]]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").coalesce(1).write.parquet(str(tmp_path / "made"))
    next((tmp_path / "made").glob("*.parquet")).rename(tmp_path / "documents.parquet")
    assert compare(spark, registry.queries()[name], registry.oracle_sql()[name], str(tmp_path))
