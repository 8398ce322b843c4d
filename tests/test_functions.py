"""Text functions and similarity on hand-made cases."""

import itertools

import pytest
from pyspark.sql import functions as F

from registra.functions import similarity as S
from registra.functions import text as X


def values(spark, column, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r.v for r in df.select("i", column(F.col("t")).alias("v")).orderBy("i").collect()]


def test_identifier(spark):
    assert values(spark, X.identifier, ["abc1234567", "A8C12E4567", "ABCI23456O", "xABC1234567", "ABC12345", None]) == ["ABC1234567", None, "ABC1234560", "ABC1234567", None, None]
    assert values(spark, X.is_canonical_id, ["abc1234567", "ABCD1234567", None]) == [True, False, False]


def test_digits_and_counts(spark):
    assert values(spark, X.digits, ["O1l|S", "12 B", None]) == ["01115", "128", None]
    assert values(spark, X.count_text, ["1o2", "–5", "1,234", "12345678", "x"]) == [102, -5, 1234, None, None]


def test_houses(spark):
    assert values(spark, X.building_key, ["12/3", "12A", "12 - 4 - 1", "0", "NIL", None, "7"]) == ["12-3", "12", "12-4", None, None, None, "7"]


def test_file_names(spark):
    df = spark.createDataFrame([("AC012-PART-034 Revision 2.pdf",), ("x",)], "t string")
    ac, part = X.file_parts(F.col("t"))
    assert [tuple(r) for r in df.select(ac, part, X.revision(F.col("t"))).collect()] == [(12, 34, 2), (None, None, 0)]


def test_names_and_reasons(spark):
    assert values(spark, X.clean_name, ["Name: 1. Ab-Cd", "Father's Name : X  Y", " q "]) == ["ab-cd", "father's name : x y", "q"]
    assert values(spark, X.reason_text, ["E", "s 12", "Z", None]) == ["Expired", "Shifted", None, None]


def lcs(a, b):
    best = 0
    for n in range(len(a), 0, -1):
        for c in itertools.combinations(a, n):
            it = iter(b)
            if all(x in it for x in c):
                return n
    return best


@pytest.mark.parametrize("a,b", [("abcbdab", "bdcaba"), ("", "x"), ("aaa", "aa"), ("kitten", "sitting"), ("அம்மா", "அமமா")])
def test_lcs(a, b):
    assert S.lcs_length(a, b) == lcs(a, b) == S.lcs_length(b, a)


def test_jaro_winkler():
    assert S.jaro_winkler("martha", "marhta") == pytest.approx(0.9611, abs=1e-4)
    assert S.jaro_winkler("dixon", "dicksonx") == pytest.approx(0.8133, abs=1e-4)
    assert S.jaro_winkler("", "a") == 0 and S.jaro_winkler("a", "a") == 1


def test_name_scores_and_enums(spark):
    df = spark.createDataFrame([("ab", "ab"), ("anna maria", "maria"), ("martha", "marhta"), ("xyz", "qrs"), ("", "a")], "a string, b string")
    got = {(r.a, r.b): r.score for r in S.name_scores(df, "a", "b").collect()}
    assert got[("ab", "ab")] == 1 and got[("anna maria", "maria")] == 0.95 and got[("xyz", "qrs")] == 0 and got[("", "a")] == 0 and got[("martha", "marhta")] > 0.96
    texts = spark.createDataFrame([("it is Male",), ("femal",), ("zzz",), (None,)], "t string")
    assert {r.t: r.match for r in S.enum_match(texts, "t", ["Female", "Male"]).collect()} == {"it is Male": "Male", "femal": "Female", "zzz": None, None: None}


def test_nfc(spark):
    assert values(spark, S.nfc, ["é  x\n", None]) == ["é x", None]
