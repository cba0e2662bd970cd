"""The position bound of problem 9."""

from pyspark.sql import functions as F

from tidemark.llm import leaks


def test_position_bound_excludes_what_cannot_reach(spark):
    # item of 50 words, 20 needed: a hit at the item's end and the text's start leaves too few, though the text is long
    rows = [("end meets start", 44, 44, 0, 300), ("around", 20, 20, 100, 300), ("also early in the item", 2, 44, 0, 300), ("short text", 10, 10, 3, 9)]
    df = spark.createDataFrame([(n, 50, *x) for n, *x in rows], "name string, item_words int, item_pos int, item_last int, pos int, n_words int")
    assert {x.name for x in df.filter(leaks._may_reach(F.lit(20))).collect()} == {"around", "also early in the item"}
