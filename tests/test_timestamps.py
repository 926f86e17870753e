from casegrid.operators import timestamps as T


def test_rows_are_kept_and_unknown_devices_read_as_utc(spark):
    rows = spark.createDataFrame([("1", "d", " 2024-07-01 10:00 ", "k"), ("2", None, "2024-07-01 10:00", "k"), ("3", "x", None, "k"), ("4", "d", "y" * 5000, "k")], "id string, device_id string, timestamp string, utc_ms string")
    devices = spark.createDataFrame([("d", "iOS"), ("d", "iOS"), (None, "iOS")], "device_id string, os_type string")
    zone = spark.createDataFrame([("d", "Asia/Kolkata")], "device_id string, zone_name string")
    got = {r.id: r.utc_ms for r in T.with_instant(rows, T.device_facts(devices, zone)).collect()}
    assert got == {"1": 1719808200000, "2": 1719828000000, "3": None, "4": None}


def test_found_leaves_out_plain_values(spark, data):
    rows = T.p4_found(spark, data)
    assert rows.columns == ["source_table", "record_id", "utc_ms"]
    assert rows.count() == rows.distinct().count() > 0
