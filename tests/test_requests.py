import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from sluiceway.functions import keys, paths
from sluiceway.operators import admission
from sluiceway.operators.messages import obsolete_ids, quarantine, to_messages
from sluiceway.plans import fixtures as fx
from sluiceway.schemas import MESSAGES, REQUESTS
from sluiceway.sources.policy_file import policy_frame

UUID = "a5de4d2b-9a31-4b8c-9d5e-000000000001"


def requests(spark, *rows):
    """Rows of (method, uri, body, headers)."""
    full = [(i, 0, 1000 + i, m, u, "127.0.0.1", h or {}, bytearray(b)) for i, (m, u, b, h) in enumerate(rows)]
    return spark.createDataFrame(full, REQUESTS)


def outcomes(spark, rows, rules=None, namespaces=("bar", "foo_*"), **kw):
    policy = policy_frame(spark, rules or {"bar.allow.delete.access": "true"})
    out = admission.classify_requests(requests(spark, *rows), policy, list(namespaces), **kw)
    return [(r.outcome, r.reason) for r in out.orderBy("seq").collect()]


def test_fixture_equals_its_sql(spark, sf_dir):
    """The twin definitions of the fixture rows agree on this engine as well."""
    from sluiceway.plans.oracles import _TABLES

    fx.events(spark, sf_dir).createOrReplaceTempView("events")
    sql = _TABLES["req"].replace("epoch_us(ts)//1000", "unix_millis(CAST(ts AS TIMESTAMP))").replace("//", "div")
    ours, theirs = fx.requests_flat(spark, sf_dir), spark.sql(sql)
    assert ours.exceptAll(theirs).count() == 0 and theirs.exceptAll(ours).count() == 0


def test_path_split(spark):
    uris = ["/submit/foo/fakeid", "/1/2/3/4/5/6/7/8/9/10", "//a///b?x=1#y", "", "/", "nopath"]
    df = spark.createDataFrame([(u,) for u in uris], "u string")
    path = paths.path_elements(F.col("u"))
    got = [(r.p, r.third) for r in df.select(path.alias("p"), paths.path_element(path, 3).alias("third")).collect()]
    assert got[0] == (["submit", "foo", "fakeid"], None)
    assert len(got[1][0]) == 10 and got[1][1] == "4"
    assert got[2][0] == ["a", "b?x=1#y"]
    assert [g[0] for g in got[3:]] == [[], [], []]


def test_api_versions(spark):
    yes = ["1", "2", "3", "1.2", "9.999", "123", "123.456"]
    no = ["no", "", "1.2.3", "bogus.bogus", "1\n", None]
    df = spark.createDataFrame([(v,) for v in yes + no], "v string")
    got = [r[0] for r in df.select(paths.is_api_version(F.col("v"))).collect()]
    assert got == [True] * len(yes) + [False] * len(no)


def test_request_fields(spark):
    df = requests(
        spark,
        ("POST", "/1.0/submit/bar/bogusid/part1/part2/part3", b"x", {"user-agent": ["ua/1"]}),
        ("POST", "/submit/bar", b"x", None),
    )
    a, b = admission.assign_ids(admission.parse_requests(df)).orderBy("seq").collect()
    assert (a.api_version, a.endpoint, a.namespace, a.id) == ("1.0", "submit", "bar", "bogusid")
    assert a.partition == ["part1", "part2", "part3"] and a.user_agent == "ua/1"
    assert b.api_version is None and len(b.id) == 36 and b.partition == []
    c = admission.assign_ids(admission.parse_requests(df), stable=False).orderBy("seq").collect()[1]
    assert len(c.id) == 36 and c.id != b.id


def test_access(spark):
    rows = [
        ("POST", "/bad", b"x", None),
        ("POST", "/submit/foo_blah/fakeid", b"x", None),
        ("GET", f"/submit/bar/{UUID}", b"", None),
        ("DELETE", f"/submit/bar/{UUID}", b"", None),
        ("DELETE", f"/submit/foo_blah/{UUID}", b"", None),
        ("PATCH", f"/submit/bar/{UUID}", b"x", None),
        ("POST", f"/fetch/bar/{UUID}", b"x", None),
        ("POST", f"/submit/bar/{UUID}", b"", None),
        ("PUT", f"/submit/bar/{UUID}", b"x", None),
        ("POST", "/submit/foo_", b"x", None),
        ("POST", "/", b"x", None),
        ("POST", "", b"x", None),
        ("POST", "/", b"x" * 11, None),
        (None, f"/submit/bar/{UUID}", b"x", None),
    ]
    assert outcomes(spark, rows, limit=10) == [
        (404, "namespace"), (404, "id"), (403, "get_denied"), (200, None), (403, "delete_denied"),
        (403, "method_denied"), (404, "endpoint"), (400, "empty_body"), (201, None), (404, "namespace"),
        (200, None), (200, None), (413, "body_too_large"), (500, "method_missing"),
    ]


def test_whitelist_is_a_search_unless_anchored(spark):
    df = spark.createDataFrame([(n,) for n in ["foo", "baz", "xbarx", "testpilot_", "testpilot_1", None]], "n string")
    loose = admission.valid_namespace(F.col("n"), ["foo", "bar", "testpilot_*"])
    tight = admission.valid_namespace(F.col("n"), ["foo", "bar", "testpilot_*"], anchored=True)
    got = df.select(loose.alias("a"), tight.alias("b")).collect()
    assert [r.a for r in got] == [True, False, True, False, True, False]
    assert [r.b for r in got] == [True, False, False, False, True, False]
    with pytest.raises(ValueError):
        admission.valid_namespace(F.col("n"), [])


def test_body_limit(spark):
    df = requests(spark, ("POST", "/", b"foo", None))
    assert admission.max_body(df, 1).count() == 0
    assert admission.max_body(df, 3).count() == 1
    assert admission.max_body(df, 4).count() == 1
    for bad in (0, -1):
        with pytest.raises(ValueError):
            admission.max_body(df, bad)


def test_uuid_forms(spark):
    cases = {UUID: (True, True), "fakeid": (False, False), "1-2-3-4-5": (True, False), UUID + "\n": (False, False)}
    df = spark.createDataFrame([(c,) for c in cases], "c string")
    got = df.select(keys.valid_uuid(F.col("c")), keys.valid_uuid(F.col("c"), strict=True)).collect()
    assert [tuple(r) for r in got] == list(cases.values())


def java_split(header):
    """Comma split that drops trailing empty entries; an empty header is one empty entry."""
    parts = header.split(",")
    if len(parts) > 1:
        while parts and parts[-1] == "":
            parts.pop()
    return [p.strip(" \t") for p in parts]


@settings(max_examples=5, deadline=None)
@given(st.lists(st.lists(st.text("a, \t", max_size=6), max_size=3), min_size=30, max_size=60))
def test_obsolete_header_split(spark, headers):
    headers = headers + [["a,b,,"], [","], [""], [",a"], ["deadbeef, livebeef"], ["a", "b", "c,d"]]
    df = spark.createDataFrame([(i, h) for i, h in enumerate(headers)], "i int, h array<string>")
    got = {r.i: r.ids for r in df.select("i", obsolete_ids(F.col("h")).alias("ids")).collect()}
    assert got == {i: [d for v in h for d in java_split(v)] for i, h in enumerate(headers)}


def test_expansion(spark):
    h = "x-obsolete-document"
    rows = [
        ("POST", f"/1.0/submit/bar/{UUID}/p1", b"x", None),
        ("POST", f"/submit/bar/{UUID}", b"x", {h: ["deadbeef"]}),
        ("PUT", f"/submit/bar/{UUID}", b"x", {h: ["deadbeef, livebeef", "a", "b,c"]}),
        ("POST", f"/submit/bar/{UUID}", b"", {h: ["deadbeef"]}),
        ("DELETE", f"/submit/bar/{UUID}", b"", {h: ["deadbeef"]}),
        ("POST", "/", b"x", {h: ["deadbeef"]}),
        ("POST", f"/submit/foo_1/{UUID}", b"x", {h: ["gone"], "x-forwarded-for": ["::1, 10.0.0.1"]}),
    ]
    classified = admission.classify_requests(
        requests(spark, *rows), policy_frame(spark, {"bar.allow.delete.access": "true"}), ["bar", "foo_*"]
    )
    messages = to_messages(classified)
    assert messages.schema.names == MESSAGES.names
    got = [(r.seq, r.ord, r.operation, r.id, r.payload) for r in messages.orderBy("seq", "ord").collect()]
    up, gone = "CREATE_UPDATE", "DELETE"
    assert got == [
        (0, 0, up, UUID, b"x"),
        (1, 0, up, UUID, b"x"), (1, 1, gone, "deadbeef", None),
        (2, 0, up, UUID, b"x"), (2, 1, gone, "deadbeef", None), (2, 2, gone, "livebeef", None),
        (2, 3, gone, "a", None), (2, 4, gone, "b", None), (2, 5, gone, "c", None),
        (4, 0, gone, UUID, None),
        (6, 0, up, UUID, b"x"), (6, 1, gone, "gone", None),
    ]
    by_seq = {r.seq: r for r in messages.filter("ord = 0").collect()}
    assert (by_seq[0].api_version, by_seq[0].partition, by_seq[0].ts_ms) == ("1.0", ["p1"], 1000)
    assert by_seq[0].ip_addr == bytes([127, 0, 0, 1]) and by_seq[6].ip_addr == bytes(15) + b"\x01"
    assert [r.reason for r in quarantine(classified).collect()] == ["empty_body"]


def test_stateless_steps_take_a_stream(spark, tmp_path):
    requests(spark, ("POST", f"/submit/bar/{UUID}", b"x", None)).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(REQUESTS).parquet(str(tmp_path / "in"))
    out = to_messages(admission.classify_requests(stream, policy_frame(spark, {"a": "b"}), ["bar"]))
    q = out.writeStream.format("memory").queryName("taken").trigger(availableNow=True).start()
    q.awaitTermination()
    assert [r.id for r in spark.table("taken").collect()] == [UUID]
