"""The receiver: protobuf by hand, JSON, chunks, errors; and sources from plugins."""

import gzip
import http.client
import json
import struct
import threading
from types import SimpleNamespace

import pytest

from tidemark import registry
from tidemark.sources import collector, otlp
from tidemark.sources.detect import SOURCES, adapt, detect


def varint(n):
    out = b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def field(number, value):
    """A field: bytes or text by length, integers as varints, floats and tuples (format, value) as fixed."""
    if isinstance(value, (bytes, str)):
        raw = value.encode() if isinstance(value, str) else value
        return varint(number << 3 | 2) + varint(len(raw)) + raw
    if isinstance(value, int):
        return varint(number << 3) + varint(value % (1 << 64))
    form, value = value if isinstance(value, tuple) else ("<d", value)
    return varint(number << 3 | (1 if struct.calcsize(form) == 8 else 5)) + struct.pack(form, value)


def pair(key, number, value):
    return field(1, key) + field(2, field(number, value))


SPAN = field(1, bytes(range(16))) + field(2, b"\1" * 8) + field(4, b"") + field(5, "call") + field(6, 3) + field(7, ("<Q", 1_700_000_000_000_000_000)) + field(9, pair("n", 3, -5)) + field(9, pair("t", 1, "é")) + field(9, pair("f", 4, 0.5)) + field(9, pair("b", 2, 1)) + field(11, field(2, "e")) + field(15, field(3, 2)) + field(99, "later")
TRACES = field(1, field(1, field(1, pair("service.name", 1, "x"))) + field(2, field(1, field(1, "lib")) + field(2, SPAN)))


@pytest.fixture
def post(tmp_path):
    server = collector.server(str(tmp_path / "in"), port=0)
    thread = threading.Thread(target=server.serve_forever, daemon=True)
    thread.start()

    def send(path, body, headers=None, chunks=None):
        connection = http.client.HTTPConnection(*server.server_address)
        connection.request("POST", path, chunks if chunks else body, headers or {"Content-Type": "application/x-protobuf"}, encode_chunked=bool(chunks))
        return connection.getresponse().status

    yield send
    server.shutdown()
    server.server_close()


def test_protobuf(spark, post, tmp_path):
    assert post("/v1/traces", TRACES) == 200
    assert post("/v1/traces/", gzip.compress(TRACES), {"Content-Type": "application/x-protobuf", "Content-Encoding": "gzip"}) == 200
    assert post("/v1/traces", None, {"Content-Type": "application/x-protobuf", "Transfer-Encoding": "chunked"}, chunks=iter([TRACES[:7], TRACES[7:]])) == 200
    rows = otlp.spans(otlp.read_documents(spark, str(tmp_path / "in"))).collect()
    assert len(rows) == 3 and len({json.dumps(r.asDict(True) | {"ordinal": 0}, default=str) for r in rows}) == 1
    r = rows[0]
    assert (r.trace_id, r.span_id, r.parent_id, r.name, r.start, r.outcome) == (bytes(range(16)).hex(), "01" * 8, None, "call", 1_700_000_000_000_000_000, "error")
    assert r.attributes == {"n": "-5", "t": "é", "f": "0.5", "b": "true"} and r.resource == {"service.name": "x"} and r.events[0].name == "e"


def test_logs_and_metrics(spark, post, tmp_path):
    record = field(1, ("<Q", 5)) + field(5, field(1, "said")) + field(6, pair("k", 1, "v")) + field(10, b"\2" * 8)
    assert post("/v1/logs", field(1, field(2, field(2, record)))) == 200
    point = field(2, ("<Q", 1)) + field(3, ("<Q", 2)) + field(6, ("<q", -3)) + field(5, field(4, b"\3" * 8))
    histogram = field(1, field(4, ("<Q", 3)) + field(6, struct.pack("<3Q", 1, 0, 2)) + field(7, struct.pack("<2d", 0.5, 1.5)))
    metrics = field(2, field(1, "m") + field(7, field(1, point) + field(2, 2) + field(3, 1))) + field(2, field(1, "h") + field(9, histogram))
    assert post("/v1/metrics", field(1, field(2, metrics))) == 200
    docs = otlp.read_documents(spark, str(tmp_path / "in"))
    (log,) = otlp.logs(docs).collect()
    assert (log.at, log.body, log.attributes, log.span_id, log.trace_id) == (5, "said", {"k": "v"}, "02" * 8, None)
    points = {r.name: r for r in otlp.metric_points(docs).collect()}
    assert (points["m"].value, points["m"].temporality, points["m"].monotonic) == (-3.0, "cumulative", True)
    document = json.loads(next((tmp_path / "in").glob("metrics*.json")).read_text())
    data = [m for m in document["resourceMetrics"][0]["scopeMetrics"][0]["metrics"] if m["name"] == "h"][0]["histogram"]["dataPoints"][0]
    assert data == {"count": "3", "bucketCounts": ["1", "0", "2"], "explicitBounds": [0.5, 1.5]}


def test_json_and_errors(spark, post, tmp_path):
    assert post("/v1/logs", json.dumps({"resourceLogs": []}), {"Content-Type": "application/json"}) == 200
    assert post("/v1/other", b"") == post("/traces", b"") == 404
    assert post("/v1/traces", b"\x0a\xff") == post("/v1/traces", TRACES[:-3]) == 400
    assert post("/v1/logs", b"{", {"Content-Type": "application/json"}) == 400
    assert otlp.read_documents(spark, str(tmp_path / "in")).count() == 1


def test_source_plugins(spark, tmp_path, monkeypatch):
    (tmp_path / "x.json").write_text(json.dumps({"resourceSpans": [{"scopeSpans": [{"spans": [{"traceId": "t", "spanId": "s", "name": "mine", "startTimeUnixNano": "1"}]}]}]}))
    plugin = SimpleNamespace(NAME="mine", detect=lambda docs: "a name of mine" if not otlp.spans(docs).where("name = 'mine'").isEmpty() else None, convert=lambda docs: otlp.spans(docs).select("name"))
    broken = SimpleNamespace(name="broken", load=lambda: 1 / 0)
    monkeypatch.setattr(registry, "entry_points", lambda group: [broken, SimpleNamespace(name="mine", load=lambda: plugin)] if group == "tidemark.sources" else [])
    found = tuple(registry.sources().found.values())
    assert found == (*SOURCES, plugin)
    assert detect(otlp.read_documents(spark, str(tmp_path)), found) == (plugin, "a name of mine")
    assert adapt(spark, str(tmp_path), sources=found).head()[0] == "mine"
    assert adapt(spark, str(tmp_path), "mine", sources=found).count() == 1


def test_source_plugin_with_files_of_its_own_and_prices(spark, tmp_path):
    from tidemark.sources.detect import SOURCES, UnknownSource, adapt

    asked = []

    def load(spark, path):
        asked.append(path)
        files = spark.read.option("pathGlobFilter", "*.mine").text(path)
        return None if files.isEmpty() else files

    plugin = SimpleNamespace(NAME="mine", PRICED=True, load=load, convert=lambda docs, prices: docs.selectExpr("value", f"'{prices}' as prices"))
    (tmp_path / "a.mine").write_text("one line")
    sources = (*SOURCES, plugin)
    assert [tuple(r) for r in adapt(spark, str(tmp_path), prices={1: 2}, sources=sources).collect()] == [("one line", "{1: 2}")]
    assert adapt(spark, str(tmp_path), "mine", sources=sources).count() == 1 and len(asked) == 2
    with pytest.raises(UnknownSource):
        adapt(spark, str(tmp_path), sources=SOURCES)
    with pytest.raises(UnknownSource):
        adapt(spark, str(tmp_path), "other", sources=sources)


def test_attributes_in_linear_time(spark):
    """Ten thousand attributes, of a key given twice the last."""
    import time

    from pyspark.sql import functions as F

    value = F.struct(*[F.when(F.lit(c == "stringValue"), F.col("id").cast("string")).alias(c) for c in ("stringValue", "intValue", "doubleValue", "boolValue", "arrayValue", "kvlistValue")])
    rows = spark.range(10_000).select(F.struct((F.col("id") % 9_000).cast("string").alias("key"), value.alias("value")).alias("a"))
    listed = rows.agg(F.sort_array(F.collect_list("a")).alias("a")).select(F.array_sort(F.col("a"), lambda x, y: (x["value"]["stringValue"].cast("int") - y["value"]["stringValue"].cast("int")).cast("int")).alias("a")).cache()
    listed.count()
    began = time.perf_counter()
    found = listed.select(otlp.attribute_map(F.col("a")).alias("m")).head().m
    assert len(found) == 9_000 and found["5"] == "9005" and found["8999"] == "8999" and time.perf_counter() - began < 20
