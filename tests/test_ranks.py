"""Global ranks by ranges equal those of one sort."""

from pyspark.sql import functions as F

from decaytrace.operators.ranks import ranked


def test_ranks_equal_a_sort(spark):
    data = [((None, "a", "b")[k % 3 if k % 2 else 1], None if k % 17 == 0 else k * 31 % 97, k) for k in range(300)]
    df = spark.createDataFrame(data, "g string, v long, n long").repartition(7)
    got = ranked(df, [F.col("v").desc_nulls_last(), F.col("n").asc()], ["g"]).collect()
    order = lambda r: (r[1] is None, -(r[1] or 0), r[2])
    want = {r[2]: k for g in (None, "a", "b") for k, r in enumerate(sorted((r for r in data if r[0] == g), key=order))}
    assert {r["n"]: r["rank"] for r in got} == want
    flat = ranked(df, [F.col("n").desc()], column="place").collect()
    assert {r["n"]: r["place"] for r in flat} == {k: 299 - k for k in range(300)}
    assert ranked(df.limit(0), [F.col("n").asc()], ["g"]).count() == 0
