"""Running totals over groups that lie in several segments."""

import random

from quarry.operators.prefix import SEGMENT, running, segmented


def test_equal_to_plain_totals(spark):
    from pyspark.sql import functions as F

    r = random.Random(3)
    data = [("hot" if r.random() < 0.6 else r.choice(["a", "b", None, "z"]), i, r.randrange(-9, 9)) for i in range(900)]
    rows = segmented(spark.createDataFrame(data, "g string, o int, v long").repartition(3), ["g"], ["o"])
    assert rows.where("g = 'hot'").select(SEGMENT).distinct().count() > 1
    got = {x["o"]: (x["n"], x["s"], x["k"], x["s_all"], x["k_all"]) for x in running(rows, ["g"], ["o"], sums={"n": F.lit(1), "s": F.col("v")}, xors={"k": F.col("v")}).collect()}
    want, state = {}, {}
    for g, o, v in data:
        n, s, k = state.get(g, (0, 0, 0))
        state[g] = want[o] = (n + 1, s + v, k ^ v)
    assert got == {o: (*want[o], *state[g][1:]) for g, o, _ in data}


def test_empty(spark):
    from pyspark.sql import functions as F

    rows = segmented(spark.createDataFrame([], "g string, o int"), ["g"], ["o"])
    assert running(rows, ["g"], ["o"], sums={"n": F.lit(1)}).collect() == []
