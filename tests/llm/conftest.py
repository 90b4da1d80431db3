import pytest

DOC = "doc_id long, text string, lang string, source string, n_chars long, _lx_score string"


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in any column, empty and long texts, repeated rows, a clashing column."""
    long = " ".join(f"word{i} the" for i in range(20000))
    rows = [(1, "Licensed under the Apache License, Version 2.0.\ntoken=abcdef12", "en", "s", 3, "x"), (1, "Licensed under the Apache License, Version 2.0.\ntoken=abcdef12", "en", "s", 3, "x"), (2, None, None, None, None, None), (None, "one two three four five six", None, "s", 1, None)]
    rows += [(3, "", "en", "t", 0, "y"), (4, long, "en", None, 9, "z"), (5, long + " end", "en", "t", 9, "z"), (6, " \n \t", "en", "t", 3, ""), (4, "one two three four five six", "en", "t", 1, "")]
    return spark.createDataFrame(rows, DOC)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], DOC)
