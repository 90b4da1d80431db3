import pytest
from pyspark.sql import functions as F

from lexarium.operators import rules

TEXT = "IF (a >= 10 AND NOT (b = 'x')) OR a < 2 THEN 'yes' ELSE 'no'"


def test_round_trip():
    rule = rules.parse(TEXT)
    assert rules.parse(rules.render(rule)) == rule


@pytest.mark.parametrize("bad", ["IF THEN 1", "IF a > THEN 1", "IF a > 1", "IF a > 1 THEN 2 3"])
def test_bad_rules_are_refused(bad):
    with pytest.raises(ValueError):
        rules.parse(bad)


def test_unknown_wins_over_a_true_arm(spark):
    df = spark.createDataFrame([(1, None), (12, "y"), (12, "x"), (None, "y")], "a int, b string")
    got = [r[0] for r in df.select(rules.compile_rule(rules.parse(TEXT), {"a": F.col("a"), "b": F.col("b")})).collect()]
    assert got == [None, "yes", "no", None]
