"""Hot-key experiment: one customer gets every third transaction of the sf0.1 view (a test-only variant).

Prints, per partitioning of the window input, the largest shuffle partition (64 partitions, no coalescing).
"""

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
from pyspark.sql import functions as F
from ledgerscope.session import get_session
from ledgerscope.sources.tables import txn_view
from ledgerscope.operators.windows import slice_copies, prefix_rolling, US_PER_DAY
spark = get_session("local[8]", shuffle_partitions=64)
spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
t = txn_view(spark, "/root/testdata/sf0.1")
hot = t.withColumn("customer_id", F.when(F.substring("transaction_id", -1, 1).isin("0", "3", "6"), F.lit("CUST_HOT"))
                   .otherwise(F.col("customer_id")))
n = hot.count(); h = hot.filter("customer_id = 'CUST_HOT'").count()
print("rows", n, "hot", h)
def dist(df, label):
    sizes = [r[1] for r in df.groupBy(F.spark_partition_id()).count().collect()]
    print(f"{label}: partitions {len(sizes)}, largest {max(sizes)}, total {sum(sizes)}, largest share {max(sizes)/sum(sizes):.3f}")
dist(hot.repartition("customer_id"), "plain W(customer) partitioning")
dist(slice_copies(hot, ["customer_id"], "timestamp", 30 * US_PER_DAY, ["amount", "transaction_id"], "transaction_id"), "slices, 30-day slices")
dist(slice_copies(hot, ["customer_id"], "timestamp", 30 * US_PER_DAY, ["amount", "transaction_id"], "transaction_id", 3 * US_PER_DAY), "slices, 3-day slices (10 copies)")
# prefix points after their repartition: rebuild the point table as prefix_rolling does
from ledgerscope.operators.windows import with_slices, SLICE_COL, T_COL
base = with_slices(hot, "timestamp", US_PER_DAY // 4)
pts = base.withColumn("_j", F.explode(F.sequence(F.lit(-1), F.lit(1)))).repartition("customer_id", SLICE_COL)
dist(pts, "prefix points, 6-hour slices")
