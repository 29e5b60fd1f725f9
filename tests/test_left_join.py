"""rows without a key take no part in a join."""

from pyspark.sql import functions as F

from tidewatch.operators import reports as R


def test_rows_without_a_key_stay_out_of_the_join(spark):
    """The exchange would send all alerts without a user to one task."""
    alerts = spark.range(2000).select("id", F.lit("low").alias("severity"), F.lit("open").alias("status"),
                                      F.when(F.col("id") < 10, F.col("id") % 4).alias("acknowledged_by")).checkpoint()
    users = spark.createDataFrame([(1, "a", "x"), (2, "b", "y"), (2, "b", "y"), (None, "n", "z")], "id long, username string, role string")
    got = R.alerts_with_users(alerts, users)
    names = sorted((r["id"], r["acknowledged_by_name"]) for r in got.where("acknowledged_by is not null").collect())
    assert names == sorted((i, n) for i in range(10) for n in {0: [None], 1: ["a"], 2: ["b", "b"], 3: [None]}[i % 4])
    rest = got.where("acknowledged_by is null")
    assert rest.count() == 1990 and rest.where("acknowledged_by_name is not null or acknowledged_by_role is not null").count() == 0
    joined = got._jdf.queryExecution().optimizedPlan().toString().split("Join LeftOuter")[1]
    assert "Filter isnotnull(acknowledged_by" in joined
