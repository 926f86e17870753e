import pytest
from pyspark.sql import functions as F

from casegrid.functions import persons as N
from casegrid.functions import phones as P
from casegrid.functions import places as PL
from casegrid.functions import records as R
from casegrid.functions import text as T
from casegrid.operators.retrieval import is_broad, route


def one(spark, value, column, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(column(F.col("v")).alias("x")).first().x


@pytest.mark.parametrize("raw,want", [("+919876543210", "+919876543210"), ("919876543210", "+919876543210"), ("09876543210", "+919876543210"), ("9876543210", "+919876543210"), ("00919876543210", "+919876543210"), ("+1-415-555-1234", "+14155551234"), ("", None), (None, None)])
def test_e164(spark, raw, want):
    assert one(spark, raw, P.e164) == want


@pytest.mark.parametrize("raw,n,want", [("1234567890", 2, "90"), ("1234567890", 4, "7890"), ("", 2, ""), (None, 2, ""), ("1", 2, "")])
def test_suffix(spark, raw, n, want):
    assert one(spark, raw, lambda c: P.suffix(c, n)) == want


@pytest.mark.parametrize("raw,want", [("tel:+91-91513-98781", "919151398781"), ("(+91) 915 139 8781", "919151398781"), ("00971501723194", "971501723194"), ("98765 43210", "919876543210"), ("562-263", "562263"), ("group:riders", None), (None, None)])
def test_with_country(spark, raw, want):
    assert one(spark, raw, P.with_country) == want


@pytest.mark.parametrize("a,b,want", [("Rajesh Sharma", "rajesh sharma", 1.0), ("Rajesh Sharma", "Sharma Rajesh", 0.95), ("", "x", 0.0)])
def test_similarity(spark, a, b, want):
    got = spark.createDataFrame([(a, b)], "a string, b string").select(T.name_similarity(F.col("a"), F.col("b")).alias("x")).first().x
    assert got == pytest.approx(want)


def test_similarity_formula(spark):
    got = spark.createDataFrame([("Rajesh", "Rajeesh")], "a string, b string").select(T.name_similarity(F.col("a"), F.col("b")).alias("x")).first().x
    assert got == pytest.approx(0.4 * (1 - 1 / 7))


@pytest.mark.parametrize("raw,want", [("1:02:03", 3723), ("2:05", 125), ("180 seconds", 180), ("3m 20s", 200), ("45", 45), ("x", None), (None, None)])
def test_seconds(spark, raw, want):
    assert one(spark, raw, T.seconds_of) == want


@pytest.mark.parametrize("raw,want", [("नमस्ते", "Devanagari"), ("hello", "Latin"), ("", "Latin"), ("মাফ করো", "Bengali"), (None, "Latin")])
def test_script(spark, raw, want):
    assert one(spark, raw, T.main_script) == want


@pytest.mark.parametrize("raw,want", [("a@b.co", "email"), ("+919876543210", "phone"), ("1234567", "phone"), ("12", "text"), ("1.5", "text"), ("true", "text"), ("2024-01-01", "text"), ("2024-01-01T10:00:00Z", "datetime"), ("01/02/2024 10:00:00", "datetime"), ("hello", "text"), ("", "text"), (None, "unknown")])
def test_field_type(spark, raw, want):
    assert one(spark, raw, T.field_type) == want


def test_key_values_last_wins(spark):
    assert one(spark, "Caller: a\nCallee: b\nCaller: c\nno pair", T.key_values) == {"callee": "b", "caller": "c"}


def test_entities(spark):
    text = "see https://x.org/a at 10:30 PM on 2024-05-01 or 1/2/24, ₹ 5,000 or 500 USD, call +91 98765 43210, 12 Hill Road, 26.1, 71.25, ask Amit Kumar Rao, 1BvBMSEYstWetqTFn5Au4m4GFg7xJaNVN2"
    find = lambda kind: one(spark, text, lambda c: T.entities(c, kind))
    assert find("url") == ["https://x.org/a"] and find("time") == ["10:30 PM"] and find("date") == ["1/2/24", "2024-05-01", "24-05-01"]
    assert find("money") == ["500 USD", "₹ 5,000"] and find("coordinates") == ["26.1, 71.25"] and find("location") == ["12 Hill Road"]
    assert find("potential_names") == ["Amit Kumar Rao", "Hill Road"] and find("crypto_wallet") == ["1BvBMSEYstWetqTFn5Au4m4GFg7xJaNVN2"]
    assert one(spark, None, lambda c: T.entities(c, "url")) == []
    kinds = {x.kind for x in one(spark, text, T.all_entities)}
    assert {"url", "time", "date", "money", "coordinates", "location", "phone", "potential_names", "crypto_wallet"} == kinds


def test_suspicious_patterns(spark):
    df = spark.createDataFrame([("Send the BITCOIN to 1BvBMSEYstWetqTFn5Au4m4GFg7xJaNVN2", "+1 415 555"), ("hello", "+91 98"), (None, None)], "t string, s string")
    got = [[(p.pattern_type, p.confidence) for p in r.p] for r in df.select(T.suspicious_patterns(F.col("t"), F.col("s")).alias("p")).collect()]
    assert got == [[("cryptocurrency", 0.9), ("suspicious_content", 0.7), ("foreign_contact", 0.8)], [], []]


@pytest.mark.parametrize("a,b", [("José García", "jose garcia"), ("Zoë", "zoe"), ("ÅNGSTRÖM", "angstrom")])
def test_names_without_accents(spark, a, b):
    assert one(spark, a, T.plain_name) == b


@pytest.mark.parametrize("text,phone,name,score", [
    ("राज कुमार", "+919876543210", True, None), ("Mr. Rajesh Sharma", "+919123456789", True, None), ("Priya", "+919876543210", True, 0.56), ("Message sent", None, False, 0.466667),
    ("Smt. अनिता वर्मा", "+919123456789", True, None), ("John Smith", "+14155551234", True, None), ("అనిల్ రెడ్డి", "+919876543210", True, None), ("Call me later", None, False, None), ("Dr. Suresh Kumar", "+919123456789", True, None), ("", None, False, 0.0), (None, None, False, 0.0),
])
def test_persons(spark, text, phone, name, score):
    got = spark.createDataFrame([(text, phone)], "t string, p string").select(N.detect(F.col("t"), F.col("p"), in_contacts=True).alias("d")).first().d
    assert got.is_name == name and (score is None or got.confidence == score)


@pytest.mark.parametrize("text,fields,want", [
    ("Call with 9876543210, duration 3 mins at 2024-05-01 10:00:00", None, ("call_log", 0.95)), ("+91 9876543210 for 45s", None, ("call_log", 0.85)), ("hi", {"sender": "a", "text": "b"}, ("message", 0.85)),
    ("chat with 9876543210 on 2024-05-01T10:00:00", None, ("message", 0.75)), ("9876543210", {"name": "A"}, ("contact", 0.9)), ("mail a@b.example", None, ("contact", 0.7)), ("nothing", None, ("unknown", 0.5)), (None, None, ("unknown", 0.5)),
])
def test_record_kinds(spark, text, fields, want):
    got = spark.createDataFrame([(text, fields)], "text string, fields map<string,string>").select(R.classify(F.col("text"), F.col("fields")).alias("k")).first().k
    assert tuple(got) == want


def test_record_fields(spark):
    rows = [("Name: Asha Rao, 9876543210 a@b.example", None), ("incoming, duration 2 hours, 9876543210 to (415) 555-1234", {"Caller": "x"}), ("", {"from": "p", "body": "hello", "to": "q"})]
    got = [r.record_fields for r in R.segment(spark.createDataFrame(rows, "text string, fields map<string,string>"), fields="fields").collect()]
    assert got[0] == {"name": "Asha Rao", "phone": "+919876543210", "email": "a@b.example"}
    assert got[1]["caller"] == "x" and got[1]["duration_seconds"] == "7200" and got[1]["call_type"] == "incoming"
    assert got[2] == {"sender": "p", "message_text": "hello", "receiver": "q"}


@pytest.mark.parametrize("text,want", [("28.6139, 77.2090", (28.6139, 77.209, "decimal_string")), ("[0, 77.5]", (0.0, 77.5, "exif")), ("28°36'50\"N, 77°12'32\"E", (28.613889, 77.208889, "dms")), ("95, 10", None), ("x", None), (None, None)])
def test_coordinates(spark, text, want):
    got = one(spark, text, PL.coordinate)
    assert (got and (round(got.latitude, 6), round(got.longitude, 6), got.form)) == want


def test_addresses_and_kinds_of_place(spark):
    got = one(spark, "221B Baker Street, Apt 4, London, NW1 6XE, UK", PL.address)
    assert (got.street_number, got.unit, got.postal_code, got.country, got.confidence) == ("221B Baker", "Apt 4", "NW1 6XE", "UK", 0.95)
    assert one(spark, "Moscow, Russia", PL.address).country is None and one(spark, " ", PL.address) is None
    assert one(spark, "10 Main, Austin, TX 73301", PL.address).state == "TX"
    df = spark.createDataFrame([("City Hospital", 1), ("x", 12), ("x", 6), (None, 1)], "t string, n int").select(PL.kind_of_place(F.col("t"), F.col("n")).alias("k"))
    assert [r.k for r in df.collect()] == ["hospital", "frequent", "regular", "poi"]


@pytest.mark.parametrize("question,kind,broad", [("show me all contacts", "contact", True), ("whatsapp chat about money", "message", True), ("who called last week?", "call", True), ("photos of the car", "media", True), ("gps of the depot", "location", False), ("what happened", None, False)])
def test_router(question, kind, broad):
    assert (route(question), is_broad(question)) == (kind, broad)


def test_masks(spark):
    assert one(spark, "1234 5678 9012 3456, 123456789012, 9876543210", T.mask_numbers) == "[CARD], [ID], [PHONE]"
