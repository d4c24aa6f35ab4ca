"""What the two classifiers shuffle, where the labels are too large to broadcast."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from palimpsest.llm import quality, toxicity


@pytest.fixture(scope="module")
def tables(spark):
    rng = np.random.default_rng(3)
    words = ["".join(rng.choice(list("abcdefghijklmnop"), 7)) for _ in range(1000)]
    texts = [" ".join(rng.choice(words, 500)) + (" badword" if i % 4 == 0 else "") for i in range(1200)]
    docs = spark.createDataFrame(pd.DataFrame({"doc_id": range(1200), "text": texts})).repartition(4)
    labels = docs.filter("doc_id % 5 < 2").select("doc_id", (F.col("doc_id") % 4 == 0).cast("int").alias("toxic"), (F.col("doc_id") % 3 > 0).cast("int").alias("quality"))
    docs.cache().count()
    return docs, labels.cache()


def shuffled(spark, run) -> int:
    """Bytes that the stages of a run write to shuffles."""
    context = spark.sparkContext._jsc.sc()

    def written() -> int:
        context.listenerBus().waitUntilEmpty()
        found = context.statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), spark._jvm.java.util.ArrayList())
        return sum(found.apply(i).shuffleWriteBytes() for i in range(found.size()))

    before = written()
    run()
    return written() - before


def both_ways(spark, run) -> list[int]:
    """What a run shuffles with labels broadcast at any size and at none."""
    found = []
    for most in ("100m", "-1"):
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", most)
        try:
            found.append(shuffled(spark, run))
        finally:
            spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    return found


def once(spark, docs) -> int:
    """The bytes of all texts dealt once."""
    return shuffled(spark, lambda: docs.repartition(4, "doc_id").write.format("noop").mode("overwrite").save())


def test_quality_shuffles_statistics_not_texts(spark, tables):
    small, large = both_ways(spark, lambda: quality.fit(*tables))
    assert large < 0.3 * once(spark, tables[0]) and large < 1.2 * small


def test_toxicity_shuffles_texts_once(spark, tables):
    small, large = both_ways(spark, lambda: toxicity.fit(*tables))
    assert large < once(spark, tables[0]) and large < 1.2 * small
