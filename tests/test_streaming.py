from datetime import datetime, timedelta

from assayer.streaming import drift_monitor, limits


def test_limit_audit_stream_equals_batch_and_drops_late_rows(spark, tmp_path):
    start = datetime(2024, 1, 1)
    schema = "ts timestamp, user_id bigint, class string"
    first = [(start + timedelta(seconds=i), 1, "auth") for i in range(12)] + [(start + timedelta(seconds=5), 2, "auth")] * 3
    second = [(start + timedelta(hours=2), 1, "auth")]
    # rows are judged late by the watermark of the batch before, so one more batch comes first
    third = [(start + timedelta(hours=2, seconds=1), 1, "auth")]
    late = [(start + timedelta(seconds=20), 2, "auth")] * 50
    closing = [(start + timedelta(hours=9), 9, "auth")]
    for i, part in enumerate((first, second, third, late, closing)):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    rules = {"auth": (10, 300), "read": (240, 60)}
    batch = limits.limit_audit(spark.createDataFrame(first + second + third + closing, schema), "user_id", rules)
    stream = (spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(str(tmp_path / "in")))
    audit = limits.limit_audit_stream(stream, "user_id", rules, "1 minute")
    q = audit.writeStream.format("memory").queryName("audit").outputMode("append").trigger(availableNow=True).option(
        "checkpointLocation", str(tmp_path / "cp")).start()
    q.awaitTermination(120)
    got = sorted(tuple(r) for r in spark.table("audit").collect())
    assert got == sorted(tuple(r) for r in batch.collect())
    assert [(r[0], r[4]) for r in got] == [(1, 12)]


def test_drift_monitor_compares_each_arrival_with_the_last(spark, tmp_path):
    folder = tmp_path / "incoming" / "orders"
    folder.mkdir(parents=True)
    other = tmp_path / "incoming" / "items"
    other.mkdir()

    def arrive(path, header, row, n):
        path.write_text(header + "\n" + "".join(row(i) + "\n" for i in range(n)))

    def run():
        drift_monitor.watch(spark, str(tmp_path / "incoming"), str(tmp_path / "hist"), str(tmp_path / "cp")).awaitTermination(180)
        return {(r["dataset"], r["arrival"]): r for r in drift_monitor.monitor_history(spark, str(tmp_path / "hist")).collect()}

    arrive(folder / "a.csv", "id,region,amount", lambda i: f"{i},{'NS'[i % 2]},{i * 1.5}", 40)
    seen = run()
    assert [r["status"] for r in seen.values()] == ["baseline"]
    arrive(folder / "b.csv", "id,region,total", lambda i: f"{i},{'NS'[i % 2]},{i * 1.5}", 80)
    seen = run()
    latest = seen[max(k for k in seen if k[0] == "orders")]
    assert latest["severity"] == "critical" and (latest["added"], latest["removed"], latest["row_delta"]) == (1, 1, 40)
    arrive(other / "c.csv", "id,price", lambda i: f"{i},{i}", 10)
    seen = run()
    assert sum(r["status"] == "baseline" for r in seen.values()) == 2 and len(seen) == 3
    assert len(run()) == 3


def test_limit_audit_reads_its_events_once_and_leaves_out_what_has_no_limit(spark):
    at = datetime(1969, 12, 31, 23, 58)  # windows before the epoch are aligned as well
    rows = [(at, 1, "auth")] * 3 + [(at + timedelta(minutes=2), 1, "auth")] * 2 + [(at, None, "read")] * 4 + [(None, 1, "auth")] * 9 + [(at, 1, "other")] * 9
    events = spark.createDataFrame(rows, "ts timestamp, user_id bigint, class string")
    audit = limits.limit_audit(events, "user_id", {"auth": (1, 300), "read": (3, 60), "mcp": (1, 60)})
    got = sorted((r["class"], r["user_id"], r["window_start"], (r["window_end"] - r["window_start"]).seconds, r["events"], r["allowed"]) for r in audit.collect())
    assert got == [("auth", 1, datetime(1969, 12, 31, 23, 55), 300, 3, 1), ("auth", 1, datetime(1970, 1, 1), 300, 2, 1), ("read", None, at, 60, 4, 3)]
    assert limits.limit_audit(events.limit(0), "user_id").count() == 0
    plan = audit._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LogicalRDD") == 1 and plan.count("Aggregate") == 1


def test_classes_with_windows_of_one_length_share_a_stateful_operator(spark, tmp_path):
    schema = "ts timestamp, user_id bigint, class string"
    spark.createDataFrame([], schema).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    plan = limits.limit_audit_stream(stream, "user_id")._jdf.queryExecution().analyzed().toString()
    assert plan.count("Aggregate") == 3
