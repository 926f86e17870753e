import json
import zipfile

import numpy as np
from pyspark.sql import functions as F

from casegrid.functions import media as M
from casegrid.functions import schemas as S
from casegrid.operators import retrieval as R
from casegrid.sources import evidence as E


def test_formats(spark, tmp_path):
    for name, member in (("a.zip", "Extraction Data/x"), ("b.zip", "oxygen.db"), ("c.zip", "notes.txt")):
        with zipfile.ZipFile(tmp_path / name, "w") as z:
            z.writestr(member, "x")
    (tmp_path / "d.xml").write_text("<?xml version='1.0'?><a/>")
    got = {r.path.rsplit("/", 1)[1]: r.format for r in E.detect_formats(spark, str(tmp_path)).collect()}
    assert got == {"a.zip": "cellebrite_pa", "b.zip": "oxygen", "c.zip": "unknown", "d.xml": "generic_xml"}


def test_xml_artifacts(spark):
    doc = b"""<report><messages><Message From="+91 98" id="1"><Text>hello</Text></Message><sms><from>a</from><to>b</to><body>hi</body></sms></messages>
 <contacts><Contact><Name>Asha</Name><Phone>1</Phone><Phone>2</Phone></Contact></contacts><Note><x>y</x></Note></report>"""
    rows = E.xml_artifacts(spark.createDataFrame([("p", bytearray(doc)), ("bad", bytearray(b"<a"))], "path string, content binary"))
    got = {r.tag: (r.kind, r.fields, r["values"]) for r in rows.collect()}
    assert set(got) == {"Message", "sms", "Contact"} and got["Message"][1] == {"from": "+91 98", "id": "1", "text": "hello"}
    assert got["sms"][:2] == ("message", {"from": "a", "to": "b", "body": "hi"}) and got["Contact"][2]["phone"] == ["1", "2"]
    table = E.canonical(E.columns_of(rows, "message", ["from", "to", "body", "text"]), "messages", "C1")
    assert sorted((r.sender_raw, r.text, r.sender_digits, r.app) for r in table.collect()) == [("+91 98", "hello", "9198", "unknown"), ("a", "hi", "", "unknown")]


def test_case_from_json_lines(spark, tmp_path):
    (tmp_path / "messages.jsonl").write_text("\n".join(json.dumps(x) for x in [{"from": "+91 98765 43210", "to_person": "12", "body": "hi", "date": "2024-05-01T10:00:00Z"}, {"sender": "x", "timestamp": "soon"}]))
    (tmp_path / "calls.json").write_text(json.dumps({"caller": "1", "callee": "22", "duration": "1:05"}))
    (tmp_path / "locations.jsonl").write_text('{"lat": "0", "lon": "77.5"}\n{"lat": "99", "lon": "1"}')
    (tmp_path / "contacts.jsonl").write_text('{"name": " "}\n{"phone": "555"}')
    case = E.read_case(spark, str(tmp_path), "C9")
    assert set(case) == {"messages", "calls", "locations", "contacts"}
    m = case["messages"].orderBy("sender_raw").collect()
    assert (m[0].sender_digits, m[0].sender_suffix_4, m[0].text, str(m[0].timestamp)) == ("919876543210", "3210", "hi", "2024-05-01 10:00:00") and m[1].timestamp is None
    assert case["calls"].first().duration_seconds == 65 and case["contacts"].count() == 1
    assert [(r.latitude, r.longitude) for r in case["locations"].collect()] == [(0.0, 77.5)]


def test_perceptual_hash(spark):
    r = np.random.default_rng(1)
    picture = np.kron(r.uniform(0, 255, (8, 9)), np.ones((5, 6)))
    a, b, c = M.hash_of(picture), M.hash_of(picture + r.normal(0, 1, picture.shape)), M.hash_of(picture[::-1, ::-1])
    df = spark.createDataFrame([(a, b, c)], "a string, b string, c string").select(M.hash_distance(F.col("a"), F.col("a")), M.hash_distance(F.col("a"), F.col("b")), M.hash_distance(F.col("a"), F.col("c")))
    zero, near, far = df.first()
    assert zero == 0 and near <= 6 < far and len(a) == 16
    own = spark.createDataFrame([(picture.tolist(),), (None,), ([],)], "p array<array<double>>").select(M.perceptual_hash("p").alias("h")).collect()
    assert [x.h for x in own] == [a, None, None]


def test_tags_and_descriptions(spark):
    df = spark.createDataFrame([(["Car", "person", "knife", "car"],), ([],), (None,), (["dog"],)], "c array<string>").select(M.tags(F.col("c")).alias("t"), M.description(F.col("c")).alias("d"))
    got = df.collect()
    assert got[0].t == ["person_detected", "vehicle_car", "vehicle_detected", "weapon_detected", "weapon_knife"] and got[1].t == got[2].t == got[3].t == []
    assert got[3].d == "This image contains one dog." and got[1].d == got[2].d == "No objects detected in this image."


def test_mapping_rules(spark):
    rules = S.mapping_rules({"phone": "phone", "timestamp": "datetime", "note": "text"}, ["PhoneNumber", "created_at", "x"])
    assert rules == [("PhoneNumber", "phone", "normalize_phone", "is_valid_phone"), ("created_at", "timestamp", "parse_datetime", "is_valid_datetime")]
    row = S.apply_rules(spark.createDataFrame([("98765 43210", "2024-05-01 10:00:00")], "PhoneNumber string, created_at string"), rules).first()
    assert row.phone == "+919876543210" and str(row.timestamp) == "2024-05-01 10:00:00"
    assert S.struct_of({"a": "datetime", "b": "uuid"}).simpleString() == "struct<a:timestamp,b:string>"


def test_hybrid_retrieval_and_cache(spark):
    m = spark.createDataFrame([(f"m{i}", c, "WhatsApp", t) for i, (c, t) in enumerate([("A", "meet at the depot"), ("A", "bring the receipt"), ("B", "receipt of the depot"), ("C", "receipt")])], "msg_id string, case_id string, app string, text string")
    m = m.withColumns({c: F.lit(None).cast("string") for c in ("sender_raw", "sender_digits", "receiver_raw", "receiver_digits", "timestamp")})
    k = spark.createDataFrame([("k1", "A", "Receipt Roy", None, "5", None)], "contact_id string, case_id string, name string, phone_raw string, phone_digits string, email string")
    index = R.case_index([R.chunk_messages(m), R.chunk_contacts(k), R.chunk_messages(m)])
    assert index.count() == 5
    got = R.retrieve(index, "chat about the receipt", ["A", "B"]).orderBy("position").collect()
    assert {r.doc_id for r in got} == {"A_msg_m0", "A_msg_m1", "B_msg_m2"} and all(r.data_type == "message" for r in got)
    assert got[0].doc_id in ("A_msg_m1", "B_msg_m2") and got[-1].doc_id == "A_msg_m0"
    assert R.retrieve(index, "xyzzy", ["A"]).count() == 0 and R.retrieve(index.where("false"), "receipt", ["A"]).count() == 0
    cache, made = R.QueryCache(2), []
    for q, kind in (("a", None), ("A ", None), ("a", "call"), ("b", None), ("a", None)):
        cache.get(q, ["x"], 5, kind, lambda: made.append(1))
    assert len(made) == 4  # the first two are one; the last was dropped


def test_vector_search_in_small_blocks_against_brute_force(spark):
    r = np.random.default_rng(4)
    v, q = r.normal(size=(200, 8)), r.normal(size=(23, 8))
    vectors = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)] + [(900, None)], "id long, vec array<double>").repartition(5)
    queries = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(q)] + [(99, None)], "query_id long, q array<double>")
    got = {(x.query_id, x["rank"]): x.id for x in R.vector_search(vectors, queries, 4, block=3, most_bytes=500).collect()}
    assert got == {(i, k + 1): int(j) for i in range(23) for k, j in enumerate(np.argsort(-(v @ q[i]), kind="stable")[:4])}
    assert R.vector_search(vectors, queries.where("false"), 4).count() == R.vector_search(vectors.where("false"), queries, 4).count() == 0
