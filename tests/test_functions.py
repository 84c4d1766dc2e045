import gzip
import ipaddress
import zlib

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from sluiceway.functions import address, keys, payload
from sluiceway.operators.admission import inflate_payloads, with_client_addr
from sluiceway.operators.records import record_sizes, with_ingest_ts
from sluiceway.schemas import REQUESTS


def test_client_addr(spark):
    cases = {
        "127.0.0.2, 127.0.0.3, 127.0.0.4": "127.0.0.2",
        " 10.0.0.1 ,x": " 10.0.0.1 ",
        ",10.0.0.1": ",10.0.0.1",
        "": "",
        "one": "one",
        None: "9.9.9.9",
    }
    df = spark.createDataFrame([(c, "9.9.9.9") for c in cases], "f string, r string")
    got = [r[0] for r in df.select(address.client_addr(F.col("f"), F.col("r"))).collect()]
    assert got == list(cases.values())


def expected_bytes(text):
    try:
        ip = ipaddress.ip_address(text)
    except ValueError:
        return None
    if ip.version == 6 and ip.ipv4_mapped:
        ip = ip.ipv4_mapped
    return ip.packed


@settings(max_examples=4, deadline=None)
@given(
    st.lists(st.ip_addresses().map(str), min_size=40, max_size=80),
    st.lists(st.text("0123456789af:.", max_size=20).filter(lambda t: not any(p.startswith("0") and len(p) > 1 for p in t.replace(":", ".").split("."))), min_size=40, max_size=80),
)
def test_address_bytes(spark, real, noise):
    fixed = [
        "256.1.1.1", "1.2.3", "::", "::1", "1::", "1:2:3:4:5:6:7", "1::2::3", ":::", "::ffff:1.2.3.4",
        "64:ff9b::1.2.3.4", "1:2:3:4:5:6:7::", "12345::", "1:2:3:4:5:6:7:8:9", "1:2:3:4:5:6:1.2.3.4",
        ":1:2:3:4:5:6:7", "host", "",
    ]
    cases = [*real, *noise, *fixed]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, a string")
    got = {r.i: r.b and bytes(r.b) for r in df.select("i", address.address_bytes("a").alias("b")).collect()}
    assert {cases[i]: b for i, b in got.items()} == {c: expected_bytes(c) for c in cases}


def test_unusable_forwarded_address_falls_back(spark):
    rows = [(0, {"x-forwarded-for": ["unknown"]}), (1, {}), (2, {"x-forwarded-for": ["127.0.0.2, 127.0.0.3"]})]
    df = spark.createDataFrame([(i, 0, 0, "GET", "/", "10.1.2.3", h, bytearray()) for i, h in rows], REQUESTS)
    got = {r.seq: bytes(r.ip_addr) for r in with_client_addr(df).collect()}
    assert got == {0: bytes([10, 1, 2, 3]), 1: bytes([10, 1, 2, 3]), 2: bytes([127, 0, 0, 2])}


def test_salted_keys(spark):
    at = 1360493115891
    doc = "06b87727-2946-4b1e-b654-8bafb60bb995"
    cases = {
        doc: b"\x86" + b"20130210" + doc.encode(), "80": b"\x0020130210" + b"80", "ff": b"\x7f20130210ff",
        "7": b"\x8720130210" + b"7", "zz": None, "1z": None, "": None, None: None,
    }
    df = spark.createDataFrame([(c, at) for c in cases], "id string, ts long")
    key = keys.salted_key(F.col("id"), F.col("ts"))
    got = df.select(key.alias("k"), keys.display_key(key).alias("d")).collect()
    assert [r.k and bytes(r.k) for r in got] == list(cases.values())
    assert got[0].d == '"\\x8620130210' + doc + '"'
    no_date = spark.createDataFrame([("06", None)], "id string, ts long")
    assert no_date.select(keys.salted_key(F.col("id"), F.col("ts"))).first()[0] is None


ONE_VALUE = [
    '{ "baz" : "blah" }', "[]", "1", '"x"', " null ", "[1, 2]", '{"a":1,"a":2}', "-0.5e3",
    '{"a":{"b":[{"c":"\\u00e9"}]}}', '{"v":1,"~end":1}',
]
NO_VALUE = [
    '{ "baz : 7 }', '{"a":1} x', "{'a':1}", "01", "1,2", '1,"a":2', "1]", '1,0] "x"', "1}", "tru", '{"a"}', "[1,]",
]


def test_json(spark):
    both = [(c, True, True) for c in ONE_VALUE] + [(c, False, False) for c in NO_VALUE]
    streams = [("", False, True), ("  ", False, True), ("1 2", False, True), ('{"a":1}{"b":2}', False, True), ("NaN", None, False)]
    cases = both + streams
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)], "i int, p string")
    p = F.col("p").cast("binary")
    out = df.select("i", payload.valid_json(p).alias("one"), payload.valid_json(p, "token_stream").alias("run"))
    for r in out.collect():
        text, one, run = cases[r.i]
        assert one is None or r.one == one, text
        assert r.run == run, text


def test_a_payload_cannot_forge_its_frame(spark):
    """Even a payload that closes the frame with the digest of another payload is refused."""
    import hashlib

    inner = hashlib.md5(b"1").hexdigest()
    df = spark.createDataFrame([(f'1,"{inner}"] x',), ("1",)], "p string")
    assert [r[0] for r in df.select(payload.valid_json(F.col("p"))).collect()] == [False, True]


def test_bad_utf8_is_no_json(spark):
    df = spark.createDataFrame([(bytearray(b'"\xff"'),)], "p binary")
    assert df.select(payload.valid_json(F.col("p"))).first()[0] is False


def test_inflate(spark):
    body = b'{"k": 1}' * 500
    raw = zlib.compressobj(wbits=-15)
    raw = raw.compress(body) + raw.flush()
    zl = zlib.compress(body)
    rows = [
        ("gzip", None, gzip.compress(body), body), ("deflate", None, zl, body), ("deflate", None, raw, body),
        (None, "application/json+zlib; v=1", zl, body), (None, "application/json", body, body),
        ("gzip", None, gzip.compress(body)[:-9], None), ("deflate", None, b"junk", None), ("br", None, body, body),
    ]
    data = [
        (i, 0, 0, "POST", "/", "", {k: [v] for k, v in (("content-encoding", e), ("content-type", t)) if v}, bytearray(b))
        for i, (e, t, b, _) in enumerate(rows)
    ]
    out = inflate_payloads(spark.createDataFrame(data, REQUESTS)).orderBy("seq").collect()
    assert [r.body and bytes(r.body) for r in out] == [r[3] for r in rows]
    assert [r.inflate_failed for r in out] == [r[3] is None for r in rows]


def test_ingest_ts(spark):
    cases = ['{"b": 1.50, "a": [1]}', '{"ingest_ts": 5}', "[1]", "7", "junk", "", '{"a":1} x', None]
    df = spark.createDataFrame([(i, None if c is None else bytearray(c.encode()), 77) for i, c in enumerate(cases)], "i int, payload binary, ts_ms long")
    out = with_ingest_ts(df).orderBy("i").collect()
    got = [r.payload and bytes(r.payload).decode() for r in out]
    assert got[1] == '{"ingest_ts":77}' and got[6] == '{"a":1,"ingest_ts":77}'
    assert '"ingest_ts":77' in got[0] and '"a": [1]' in got[0]
    assert got[2:6] == [None] * 4 and [r.reason for r in out[2:6]] == ["not_an_object"] * 4
    assert out[7].payload is None and out[7].reason is None


def test_record_sizes(spark):
    df = spark.createDataFrame([("é", bytearray("éa".encode()))], "key string, value binary")
    assert tuple(record_sizes(df, with_values=True).first()) == ("é", 1, 3, "éa")


def test_unknown_json_mode(spark):
    with pytest.raises(ValueError):
        payload.valid_json(F.lit("1"), "other")
