"""Word edges of the contract are of ASCII: a letter with an accent ends a word."""

import pytest
from pyspark.sql import functions as F

from pagewarden.functions import pii
from pagewarden.functions import text as T


@pytest.mark.parametrize("words,want", [("Doías de y", True), ("Do\u00f1ez que", True), ("Doias de y", False), ("Do it", True), ("Open\u00e9 what is", False), ("la analysis\u00f3 es", True), ("la xanalysis es", False)])
def test_questions(spark, words, want):
    assert spark.range(1).select(T.is_question(F.lit(words))).first()[0] is want


def test_fields(spark):
    category = lambda label: spark.range(1).select(pii.field_category(F.lit("textbox"), F.lit(label), F.create_map().cast("map<string,string>"))).first()[0]
    assert [category(x) for x in ("\u00e9pin", "spin", "PIN\u00f3", "\u00f1cc number", "accnumber")] == ["credential", None, "credential", "payment_card", None]
