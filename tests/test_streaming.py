"""The streaming diagnosis gives the batch report's rows for the operations that arrived."""

import tempfile

from tests.test_reports import ri_tables

from supplyscope.plans.receiving import receiving_diagnosis
from supplyscope.sources.tables import parquet_tables
from supplyscope.streaming import diagnose_stream, operations_stream


def test_stream_matches_batch(spark, ebs):
    t = ri_tables(ebs)
    land, sink, ckpt = (tempfile.mkdtemp(prefix=p) for p in ("land-", "sink-", "ckpt-"))
    ops = t["cll_f189_entry_operations"]
    ops.where("operation_id <= 2").write.mode("append").parquet(land)
    ops.where("operation_id > 2").write.mode("append").parquet(land)
    q = diagnose_stream(spark, operations_stream(spark, land, max_files_per_trigger=1), t, sink, ckpt,
                        available_now=True)
    q.awaitTermination(120)
    got = spark.read.parquet(sink).drop("batch_id")
    want = receiving_diagnosis(t, sort=False)
    key = repr
    assert sorted(map(tuple, got.select(*want.columns).collect()), key=key) == \
        sorted(map(tuple, want.collect()), key=key)
    assert spark.read.parquet(sink).select("batch_id").distinct().count() >= 2


def test_stream_sees_rows_that_land_after_the_start(spark, ebs):
    t = ri_tables(ebs)
    root, land, sink, ckpt = (tempfile.mkdtemp(prefix=p) for p in ("root-", "land-", "sink-", "ckpt-"))
    for name in t:
        rows = t[name].where("false") if name == "cll_f189_invoices" else t[name]
        rows.write.mode("overwrite").parquet(f"{root}/{name}")
    seen = []

    def tables():
        if not seen:  # the invoices land when the first batch has begun
            t["cll_f189_invoices"].write.mode("append").parquet(f"{root}/cll_f189_invoices")
        seen.append(1)
        return parquet_tables(spark, root)

    t["cll_f189_entry_operations"].write.mode("append").parquet(land)
    q = diagnose_stream(spark, operations_stream(spark, land), tables, sink, ckpt, available_now=True)
    q.awaitTermination(120)
    want = receiving_diagnosis(t, sort=False)
    got = spark.read.parquet(sink).select(*want.columns)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)
