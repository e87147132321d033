"""A plan fitted on a batch table gives the same rows on a stream."""

import tempfile

from tabsieve.operators.prepare import Action, apply_actions
from tabsieve.sources.derived import dirty_customer
from tabsieve.streaming.apply import fit_actions

ACTIONS = [
    Action("normalize_nulls", "segment"),
    Action("trim_whitespace", "segment"),
    Action("normalize_categories", "segment"),
    Action("impute_missing", "segment", "mode"),
    Action("impute_missing", "acctbal", "median"),
    Action("cap_outliers", "acctbal"),
]


def test_fitted_equals_batch(spark, sf_dir):
    df = dirty_customer(spark, sf_dir)
    batch = apply_actions(df, ACTIONS, order_by="c_custkey")
    fitted = fit_actions(df, ACTIONS, order_by="c_custkey")
    assert sorted(fitted.transform(df).collect()) == sorted(batch.collect())


def test_fitted_on_stream(spark, sf_dir):
    df = dirty_customer(spark, sf_dir)
    fitted = fit_actions(df, ACTIONS, order_by="c_custkey")
    src = tempfile.mkdtemp(prefix="stream-src-", dir="/tmp")
    df.write.mode("overwrite").parquet(src)
    stream = spark.readStream.schema(df.schema).parquet(src)
    q = fitted.transform(stream).writeStream.format("memory").queryName("cleaned_stream").start()
    q.processAllAvailable()
    q.stop()
    got = sorted(spark.sql("select * from cleaned_stream").collect())
    assert got == sorted(fitted.transform(df).collect())
