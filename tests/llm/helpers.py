"""Small tables with every awkward case, and tables of the test data."""

SF = "/root/testdata/sf0.001"
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def awkward(spark, extra="bigint"):
    """Nulls in every column, empty and long texts, ties, repeated rows, and columns named like outputs."""
    long = " ".join(f"word{i % 977}" for i in range(60_000)) + ". End of it."
    rows = [
        (1, "One plain line of words here.\nAnother plain line of words there.", "en", "a", 60),
        (1, "One plain line of words here.\nAnother plain line of words there.", "en", "a", 60),
        (2, None, None, None, None),
        (3, "", "en", "", 0),
        (4, " \n\t ", "en", "a", 4),
        (None, "One plain line of words here.\nAnd a third.", "en", "b", 40),
        (5, long, "en", "b", len(long)),
        (6, "é 你好 ́x İ", "fr", None, 9),
        (7, "a", "de", "c", 1),
    ]
    clash = [(*r, i, f"t{i}", None, float(i)) for i, r in enumerate(rows)]
    return spark.createDataFrame(clash, f"{DOCS}, component_id {extra}, removed_spans string, copy int, score double")


def nothing(spark):
    return spark.createDataFrame([], DOCS)


def table(spark, name, sf=SF):
    return spark.read.parquet(f"{sf}/{name}.parquet")
