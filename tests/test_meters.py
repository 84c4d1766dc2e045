"""Live counts against the batch reports, with repeated batches and a restart in between."""

from pyspark.sql import functions as F

from sluiceway.operators import metrics
from sluiceway.operators.validation import gate_operations
from sluiceway.plans import fixtures as fx
from sluiceway.streaming import meters


def rows(df):
    return sorted(map(str, df.collect()))


def test_live_counts_equal_the_reports(spark, sf_dir, tmp_path):
    path = str(tmp_path / "meters")
    classified, gated = fx.classified(spark, sf_dir).persist(), gate_operations(fx.messages(spark, sf_dir)).persist()
    for i in range(3):
        part = F.pmod("seq", F.lit(3)) == i
        for _ in range(1 + (i == 1)):  # a batch that is written again
            meters.meter_requests(classified.filter(part), path, i)
            meters.meter_messages(gated.filter(part), path, i, limit=8)
    requests, messages = (meters.read_counts(spark, f"{path}/{kind}") for kind in ("requests", "messages"))
    assert rows(metrics.request_report(requests)) == rows(metrics.request_metrics(classified))
    assert rows(metrics.response_report(requests)) == rows(metrics.response_counts(classified))
    assert rows(metrics.consumer_report(messages)) == rows(metrics.consumer_metrics(gated))
    assert rows(metrics.sink_report(messages)) == rows(metrics.sink_metrics(gated, limit=8))
    assert len(list((tmp_path / "meters" / "requests").iterdir())) == 2
    assert requests.count() < 200  # as many as kinds of rows
    classified.unpersist()
    gated.unpersist()
