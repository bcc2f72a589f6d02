"""Tables of a row for each photo don't go through the driver, however well their files compress."""

from pyspark.sql import functions as F

from lumenflow.plans.tables import durable


def test_small_files_of_many_rows_are_shuffled(spark):
    settings = {"spark.sql.autoBroadcastJoinThreshold": "3m", "spark.sql.maxBroadcastTableSize": "3m"}
    before = {k: spark.conf.get(k) for k in settings}
    left, right = (durable(spark.range(300_000).withColumn(k, F.lit(1)), k) for k in ("a", "b"))
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        out = durable(left.join(right, "id"), "joined")  # a broadcast of 7 MB would fail
        assert spark.conf.get("spark.sql.autoBroadcastJoinThreshold") == "3m" and not spark.conf.get("spark.sql.adaptive.autoBroadcastJoinThreshold", None)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert out.count() == 300_000
