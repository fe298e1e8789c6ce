"""Scale property: a customer holding a third of the rows does not land in one window partition."""

import random

from pyspark.sql import functions as F

from ledgerscope.operators.windows import SLICE_COL, US_PER_DAY, slice_copies, with_slices
from tests.conftest import day, make_txn


def _largest_share(df):
    sizes = [r["count"] for r in df.groupBy(F.spark_partition_id().alias("p")).count().collect()]
    return max(sizes) / sum(sizes)


def test_hot_customer_is_split(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        rnd = random.Random(2)
        rows = [(f"t{i:05d}", "HOT" if i % 3 == 0 else f"C{rnd.randrange(400)}",
                 day(rnd.randrange(28), rnd.randrange(24), rnd.randrange(60)), 10) for i in range(6000)]
        txn = make_txn(spark, rows).repartition(8)
        plain = _largest_share(txn.repartition(16, "customer_id"))
        pts = (with_slices(txn, "timestamp", US_PER_DAY // 4)
               .withColumn("_j", F.explode(F.sequence(F.lit(-1), F.lit(1))))
               .repartition(16, "customer_id", SLICE_COL))
        copies = slice_copies(txn, ["customer_id"], "timestamp", 2 * US_PER_DAY, ["amount"], "transaction_id")
        assert plain > 0.3                      # one task would hold the hot customer
        assert _largest_share(pts) < 0.15       # prefix points on 6-hour slices spread it
        assert _largest_share(copies) < 0.15    # short windows: overlapping slices spread it too
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
