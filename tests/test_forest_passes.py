"""what a pass of a forest over the rows costs."""

from pyspark.sql import functions as F

from tidewatch.operators import supervised as S


def test_forests_keep_the_node_of_every_row(spark):
    """No walk down from the root in every pass, and the same trees."""
    from pyspark.ml.functions import array_to_vector
    u = lambda s: F.pmod(F.xxhash64("id", F.lit(s)), F.lit(1000)).cast("double") / 1000
    df = spark.range(0, 3000, 1, 3).select(array_to_vector(F.array(*[u(s) for s in range(5)])).alias("features"),
                                           (u(0) + u(1) > 0.3).cast("double").alias("_y"), F.floor(u(2) * 3 + u(6)).cast("double").alias("_t"),
                                           F.lit(1.5).alias("_w")).persist()
    small = {"numTrees": 4, "maxDepth": 6}
    for forest in (S.stage1_estimator("rf", overrides=small), S.stage2_estimator("rf", small), S._multiclass_estimator("rf", small)):
        assert forest.getCacheNodeIds()
        trees = [f.fit(df).toDebugString.split("\n", 1)[1] for f in (forest, forest.copy({forest.cacheNodeIds: False}))]
        assert trees[0] == trees[1] and trees[0].count("If") > 20
    df.unpersist()
