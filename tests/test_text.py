import pytest
from pyspark.sql import functions as F

from kinmatch.functions import text as T

INDIC = ["प्राइवेट", "লিমিটেড", "ਪ੍ਰਾਈਵੇਟ", "પ્રાઇવેટ", "ପ୍ରାଇଭେଟ", "லிமிடெட்", "ప్రైవేట్", "ಪ್ರೈವೇಟ್", "ലിമിറ്റഡ്"]


@pytest.mark.parametrize("word", INDIC)
def test_indic_marks_stay(word):
    assert T.clean(word) == word


@pytest.mark.parametrize("raw, want", [("Payne Énterprises", "payne enterprises"), ("Thermal & Fils SASU", "thermal fils sasu"), ("Europ & Frères Distribution S.A.", "europ freres distribution s a"), ("", ""), ("   ", ""), ("...,,,---", ""), (None, ""), ("Straße", "strasse")])
def test_clean(spark, raw, want):
    assert T.clean(raw) == want
    assert spark.createDataFrame([(raw,)], "x string").select(T.clean_latin(F.col("x"))).first()[0] == want


@pytest.mark.parametrize("raw, want", [("AF-0684", ["af684"]), ("AF-684", ["af684"]), ("1056-1060", ["1056", "1060"]), ("4-8", ["4", "8"]), ("48", ["48"]), ("000", ["0"]), ("A-00-7", ["a07"]), ("Wz-187C", ["wz187c"]), ("none", []), (None, [])])
def test_numeric_keys(spark, raw, want):
    assert spark.createDataFrame([(raw,)], "x string").select(T.numeric_keys(F.col("x"))).first()[0] == want


def test_ngrams_locations_forms(spark):
    row = spark.createDataFrame([("ab cd", "12 Main St, Lyon, 69001 France", ["acme", "ltd"])], "a string, b string, c array<string>")
    assert row.select(T.char_ngrams(F.col("a"))).first()[0] == ["abc", "bcd"]
    assert sorted(row.select(T.location_tokens(F.col("b"))).first()[0]) == ["69001", "France", "Lyon"]
    assert row.select(T.written_out(F.col("c"))).first()[0] == ["acme", "limited"]


def test_jaro_winkler_and_token_set():
    assert round(T.jaro_winkler_of("martha", "marhta"), 4) == 0.9611
    assert round(T.jaro_winkler_of("dixon", "dicksonx"), 4) == 0.8133
    assert T.jaro_winkler_of("", "a") == 0 and T.jaro_winkler_of("a", "a") == 1
    assert T.token_set_ratio_of("acme corp", "corp acme ltd") == 1.0
    assert 0 < T.token_set_ratio_of("acme corp", "acne corp") < 1


def test_scripts_and_splits(spark):
    assert T.main_script("Hello") == "Latin" and T.main_script("प्राइवेट") == "Devanagari" and T.main_script("12") == "None"
    parts = spark.range(500).select(T.entity_split(F.col("id").cast("string")).alias("p")).groupBy("p").count().collect()
    assert {r.p for r in parts} == {"fit", "cal", "tune"} and max(r["count"] for r in parts) > 300
