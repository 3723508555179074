"""Tokenisers, stop words, stemmer, options: vectors derived by hand."""

import pytest
from pyspark.sql import functions as F

from lexloom.functions import porter
from lexloom.functions.text import BENCH_STOP_WORDS, STOP_WORDS, index_terms, index_words, query_terms
from lexloom.operators.membership import METHODS, count_members
from lexloom.options import IndexOptions, OptionError, QueryOptions


def words(spark, text, f):
    return spark.createDataFrame([(text,)], "t string").select(f(F.col("t")).alias("w")).collect()[0].w


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("Apple banana ", ["Apple", "banana"]),
        ("Apple banana", ["Apple"]),
        ("U.S.-based 3.5% ", ["U", "S", "based", "3", "5"]),
        ("don't e-mail a@b.c ", ["don", "t", "e", "mail", "a@b", "c"]),
        ("<TEXT> hi </TEXT>\n", ["hi"]),
        ("<b>bold a<b>c x> >y z ", ["a<b>c", ">y", "z"]),
        ("<F P=100> ", ["P"]),
        ("", []),
        (None, []),
        ("one", []),
        ("x" * 200 + " ", ["x" * 200]),
    ],
)
def test_index_words(spark, text, expected):
    assert words(spark, text, index_words) == expected


def test_index_terms(spark):
    assert words(spark, "Éa ÀB ", lambda c: index_terms(c, True)) == ["Éa", "Àb"]
    assert words(spark, "the The ", lambda c: index_terms(c, False, True)) == ["The"]
    assert words(spark, "x" * 200 + " ab ", lambda c: index_terms(c, max_len=100)) == ["ab"]


@pytest.mark.parametrize(
    ("line", "expected"),
    [
        ("foreign minorities, Germany", ["foreign", "minorities", "germany"]),
        ('well-known don\'t "x"', ["well-known", "don't", '"x"']),
        ("<tag tag> a/b", ["tag>", "a", "b"]),
        ("É", ["é"]),
        (" \t ", []),
        (None, []),
    ],
)
def test_query_terms(spark, line, expected):
    assert words(spark, line, lambda c: query_terms(c, True)) == expected


def test_stems():
    table = {"hoping": "hop", "filing": "fil", "mating": "mate", "disabled": "disabl", "agreed": "agre", "entering": "ent", "ies": "i", "yes": "ye", "happy": "happi", "sky": "sky", "is": "is", "ed": "ed", "": ""}
    assert {w: porter.stem(w) for w in table} == table
    classic = {"hoping": "hope", "filing": "file", "entering": "enter", "caresses": "caress", "ponies": "poni", "cats": "cat", "plastered": "plaster", "motoring": "motor", "conflated": "conflat", "relational": "relat", "conditional": "condit", "vietnamization": "vietnam", "hopefulness": "hope", "formaliti": "formal", "electriciti": "electr", "adjustment": "adjust", "adoption": "adopt", "controlling": "control", "falling": "fall", "rate": "rate", "cease": "ceas"}
    assert {w: porter.stem(w, compat=False) for w in classic} == classic


def test_lists():
    assert len(set(STOP_WORDS)) == 41 and max(map(len, STOP_WORDS)) == 4
    assert len(set(BENCH_STOP_WORDS)) == 49


def test_options():
    assert IndexOptions.parse("IndexOptions(CaseFolding,DoStemming)") == IndexOptions(True, False, True)
    assert IndexOptions.parse("IndexOptions(CaseFolding, DoStemming)") == IndexOptions(True)
    assert IndexOptions.parse("IndexOptions()") == IndexOptions()
    assert QueryOptions.parse("QueryOptions(UseHeadline,UseNarrative)") == QueryOptions(True, False, True)
    with pytest.raises(OptionError):
        IndexOptions.parse("Index")
    assert "case_folding: True" in str(IndexOptions(True))


def test_membership_methods_agree(spark):
    tokens = spark.createDataFrame([(w,) for w in ("the", "cat", "a", "make", "zz", "the")], "term string")
    for n, expected in ((10, 1), (20, 1), (49, 4)):
        rows = count_members(tokens, BENCH_STOP_WORDS[:n]).collect()
        assert {r.method for r in rows} == set(METHODS)
        assert {r.n for r in rows} == {expected}
