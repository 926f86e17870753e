import json
import sqlite3
import zipfile

import pytest
from pyspark.sql import functions as F

from casegrid.operators import guard
from casegrid.sources import readers, sinks
from casegrid.streaming import windows

CASES = [
    ("SELECT * FROM messages LIMIT 10", True), ("SELECT * FROM messages", False), ("DROP TABLE messages", False), ("SELECT * FROM users LIMIT 5", False), ("SELECT * FROM messages LIMIT 5000", False),
    ("SELECT * FROM messages LIMIT 5; DELETE FROM messages", False), ("SELECT * FROM messages -- x\nLIMIT 5", False), ("", False), ("SELECT 'drop table' AS x FROM calls LIMIT 1", True),
    ("SELECT * FROM messages, secrets LIMIT 1", False), ("WITH a AS (SELECT app FROM messages) SELECT * FROM a LIMIT 3", True), ("SELECT * FROM (SELECT * FROM secrets LIMIT 2) LIMIT 1", False), ("SELEC x", False),
    ("SELECT (SELECT max(x) FROM secrets) FROM calls LIMIT 1", False), ("INSERT INTO messages SELECT * FROM messages LIMIT 1", False),
]


@pytest.mark.parametrize("sql,ok", CASES)
def test_guard(spark, sql, ok):
    assert guard.inspect(spark, sql).ok is ok


def test_run_adds_limit_and_audits(spark, data, tmp_path):
    guard.register(spark, data)
    log = str(tmp_path / "audit.log")
    assert guard.run(spark, "select msg_id from messages;", audit=log).count() == 100
    with pytest.raises(ValueError):
        guard.run(spark, "delete from messages", audit=log)
    assert [json.loads(x)["status"] for x in open(log)] == ["OK", "REJECTED"]


def test_json_csv_kv_and_tables(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"version": 1, "contacts": [{"name": "A", "phone": "+911"}, {"name": "B"}]}')
    got = [json.loads(r.record) for r in readers.read_json(spark, str(tmp_path / "a.json")).collect()]
    assert got == [{"name": "A", "phone": "+911"}, {"name": "B"}]
    (tmp_path / "b.json").write_text('[{"name": "C"}]')
    assert readers.read_json(spark, str(tmp_path / "b.json")).count() == 1
    (tmp_path / "c.csv").write_text("Name\tPhone\nA\t+919876543210\n")
    assert readers.read_csv(spark, str(tmp_path / "c.csv")).first().Phone == "+919876543210"
    (tmp_path / "d.txt").write_text("Caller: +911\nDuration: 5\n\nCaller: +912\n")
    assert [r.record["caller"] for r in readers.read_key_values(spark, str(tmp_path / "d.txt")).collect()] == ["+911", "+912"]
    t = spark.createDataFrame([("| a | b |\n|---|---|\n| 1 | 2 |\n| 3 |",)], "value string")
    assert [r.record for r in readers.pipe_tables(t).collect()] == [{"a": "1", "b": "2"}]


def test_xml_and_jsonl(spark, tmp_path):
    (tmp_path / "x.xml").write_text('<r><messages><message id="1"><from>+911</from><text>hi</text></message></messages></r>')
    rows = readers.read_xml(spark, str(tmp_path / "x.xml"), "message", readers.strings("_id", "from", "text"))
    assert rows.first().asDict() == {"_id": "1", "from": "+911", "text": "hi"}
    c = readers.canonical_messages(rows).first()
    assert (c.sender_digits, c.text, c.app) == ("911", "hi", "unknown")
    (tmp_path / "m.jsonl").write_text('{"from": "+911", "timestamp": "2021-01-01T00:00:00Z"}\n{"from": "2", "timestamp": "soon"}\n')
    m = readers.canonical_messages(readers.read_jsonl(spark, str(tmp_path / "m.jsonl"), readers.strings("from", "timestamp"))).collect()
    assert m[0].timestamp is not None and m[1].timestamp is None


def test_archives_and_files(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("in/x.txt", "x")
        z.writestr("../bad.txt", "y")
    rows = readers.archive_members(spark, str(tmp_path)).collect()
    assert [(r.member, r.size) for r in rows] == [("in/x.txt", 1)]
    f = readers.files(spark, str(tmp_path)).withColumn("c", readers.category(F.col("extension"))).first()
    assert (f.filename, f.c) == ("a.zip", "archive")


def test_sqlite(spark, tmp_path):
    with sqlite3.connect(tmp_path / "t.db") as db:
        db.execute("create table messages (sender text, n int)")
        db.executemany("insert into messages values (?, ?)", [(f"+{i}", i) for i in range(10)])
    rows = readers.read_sqlite(spark, str(tmp_path / "t.db"), "messages")
    assert sorted(int(r.n) for r in rows.collect()) == list(range(10)) and rows.rdd.getNumPartitions() == 4


def test_sinks(spark, tmp_path):
    path = str(tmp_path / "t")
    batch = spark.createDataFrame([("c1", "f", 1), ("c1", "f", 1), ("c1", "f", 2), ("c2", None, 3)], "case_id string, src string, at int")
    assert sinks.append_new(spark, batch, path, ["case_id", "src", "at"]) == {"inserted": 3, "skipped": 1}
    assert sinks.append_new(spark, batch, path, ["case_id", "src", "at"]) == {"inserted": 1, "skipped": 3}
    up = str(tmp_path / "u")
    a = spark.createDataFrame([("c1", "k", 1), ("c2", "m", 1)], "case_id string, id string, v int")
    sinks.upsert(spark, a, up, "id", "v")
    sinks.upsert(spark, spark.createDataFrame([("c1", "k", 2)], "case_id string, id string, v int"), up, "id", "v")
    assert {(r.id, r.v) for r in spark.read.parquet(up).collect()} == {("k", 2), ("m", 1)}


def test_stream_equals_batch(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    rows = [{"id": i, "type": "call" if i % 3 else "message", "sender": "a", "timestamp": f"2024-01-01T0{i % 5}:00:00Z"} for i in range(20)]
    for k in range(4):
        (folder / f"{k}.json").write_text("\n".join(json.dumps(r) for r in rows[k * 5 : k * 5 + 5]))
    schema = "id int, type string, sender string, timestamp timestamp"
    from pyspark.sql.types import StructType

    s = windows.read_stream(spark, str(folder), StructType.fromDDL(schema))
    got = windows.run_once(windows.window_counts(s, late="1 day"), "counts_test", str(tmp_path / "cp"), "complete")
    want = windows.window_counts(spark.read.schema(schema).json(str(folder)))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


@pytest.mark.parametrize("scheme", ["", "file:"])
def test_writers_see_what_is_stored(spark, tmp_path, scheme):
    path = f"{scheme}{tmp_path}/t"
    rows = lambda *r: spark.createDataFrame(list(r), "case_id string, k string, v int")
    assert not sinks.exists(spark, path)
    assert sinks.append_new(spark, rows(("A", "x", 1), ("A", "x", 1), ("B", "y", 2)), path, ["case_id", "k"]) == {"inserted": 2, "skipped": 1}
    assert sinks.append_new(spark, rows(("A", "x", 5), ("A", "z", 3)), path, ["case_id", "k"]) == {"inserted": 1, "skipped": 1}
    sinks.upsert(spark, rows(("A", "x", 9)), path, "k", "v")
    spark.catalog.refreshByPath(path)
    assert {(r.case_id, r.k, r.v) for r in spark.read.parquet(path).collect()} == {("A", "x", 9), ("A", "z", 3), ("B", "y", 2)}
    assert sinks.delete_case(spark, path, "A") and not sinks.delete_case(spark, path, "A")
    assert {r.k for r in spark.read.parquet(path).collect()} == {"y"}
    assert sinks.manifest({"t": spark.read.parquet(path)}, f"{scheme}{tmp_path}/m.json") == {"t": 1}
