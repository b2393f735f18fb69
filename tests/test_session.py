"""What stored tables leave behind."""

import time

from pyspark.sql import functions as F

from telemetra.session import REMOVE_SHUFFLES, materialize


def shuffle_blocks(spark) -> set[str]:
    found = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllBlocks()
    return {name for i in range(found.size()) if (name := found.apply(i).name()).startswith("shuffle_")}


def test_a_stored_table_leaves_no_shuffle_files(spark):
    before, setting = shuffle_blocks(spark), spark.conf.get(REMOVE_SHUFFLES, None)
    counts = spark.range(100_000).groupBy((F.col("id") % 1000).alias("k")).agg(F.count(F.lit(1)).alias("n"))
    stored = materialize(counts.join(counts.withColumnRenamed("n", "m"), "k").repartition(7, "n"))
    until = time.time() + 10
    while shuffle_blocks(spark) - before and time.time() < until:
        time.sleep(0.2)
    assert not shuffle_blocks(spark) - before
    assert spark.conf.get(REMOVE_SHUFFLES, None) == setting
    assert stored.agg(F.sum("n")).first()[0] == 100_000 == counts.agg(F.sum("n")).first()[0]
