import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import labels
from ledgerloom.operators import review


def test_exports(spark, tmp_path):
    rows = spark.range(500).select(F.concat(F.lit("c"), F.lpad("id", 4, "0")).alias("case_id"), F.lit("run_facts").alias("export_view"), F.lit("=1+1").alias("left_reference"))
    for name, one in (("one", True), ("parts", False)):
        review.write_csv(rows, str(tmp_path / name), "case_id", one_file=one)
        files = sorted((tmp_path / name).glob("part-*"))
        lines = [x for f in files for x in f.read_bytes().decode().split("\r\n") if x]
        ids = [x.split(",")[4] for x in lines if not x.startswith("export_view")]
        assert ids == [f"c{i:04}" for i in range(500)] and "'=1+1" in lines[1] and (not one or len(files) == 1)
    out = tmp_path / "json"
    review.write_json(rows, str(out), "run-1", "run_facts", "case_id")
    head = json.loads("".join(f.read_text() for f in (out / "head").glob("part-*")))
    assert head == {"view": "run_facts", "timezone": "UTC", "decimal_encoding": "canonical decimal strings", "run_id": "run-1", "total": 500}
    got = [json.loads(x)["case_id"] for f in sorted((out / "rows").glob("part-*")) for x in Path(f).read_text().splitlines()]
    assert got == [f"c{i:04}" for i in range(500)]
    with pytest.raises(Exception, match="already exists"):
        review.write_json(rows, str(out), "run-2", "run_facts", "case_id")
    empty = tmp_path / "empty"
    review.write_json(rows.limit(0), str(empty), "run-1", "run_facts", "case_id")
    assert json.loads("".join(f.read_text() for f in (empty / "head").glob("part-*")))["total"] == 0


def test_labels_and_pages(spark):
    df = spark.createDataFrame([(0,), (120_000_000,), (30_000_000,), (1_500_000,), (7,), (-1_000_000,), (None,)], "us bigint")
    got = [tuple(r) for r in df.select(labels.duration(F.col("us")), labels.seconds(F.col("us"))).collect()]
    assert got == [("0 s", "0"), ("2 min", "120"), ("30 s", "30"), ("1500 ms", "1.5"), ("7 µs", "0.000007"), ("-1 s", "-1"), ("—", None)]
    words = spark.range(1).select(labels.candidate_sentence(F.lit("R1"), F.lit(9500), F.lit(None).cast("string")), labels.comparison_sentence(F.lit("unit_price"), F.lit("1"), F.lit(None).cast("string"), F.lit("MISSING"))).first()
    assert tuple(words) == ("Under the current policy, R1 scores 9500 of 10000. It is free now.", "Unit Price: 1 against missing, missing.")
    with pytest.raises(ValueError):
        review.offset_page(df, 0, "us")
