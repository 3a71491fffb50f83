from pyspark.sql import functions as F

from twintally.sources.staging import FREES_SHUFFLES, freeing, stage


def shuffle_files(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {name for k in range(files.size()) if (name := files.apply(k).getName()).startswith("shuffle_")}


def test_shuffle_files_go_when_a_table_is_staged(spark):
    df = spark.range(10_000).groupBy((F.col("id") % 100).alias("k")).count()
    before = shuffle_files(spark)
    table = stage(df, "sums")
    assert not shuffle_files(spark) - before
    assert table.count() == df.count() == 100


def test_the_setting_is_given_back(spark):
    before = spark.conf.get(FREES_SHUFFLES, None)
    with freeing(spark):
        with freeing(spark):
            assert spark.conf.get(FREES_SHUFFLES) == "true"
        assert spark.conf.get(FREES_SHUFFLES) == "true"
    assert spark.conf.get(FREES_SHUFFLES, None) == before
    spark.conf.set(FREES_SHUFFLES, "false")
    try:
        with freeing(spark):
            pass
        assert spark.conf.get(FREES_SHUFFLES) == "false"
    finally:
        spark.conf.unset(FREES_SHUFFLES)
