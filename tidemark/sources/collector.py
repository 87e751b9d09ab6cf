"""A receiver of OTLP over HTTP: each request becomes one JSON document in a folder.

Protobuf bodies are read by field numbers from the tables below, without a library;
JSON bodies are checked and kept.  The folder is what otlp.read_documents reads.
"""

from __future__ import annotations

import base64
import gzip
import json
import os
import struct
import time
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from itertools import count

# Fixed values of the public protocol: for each message its fields as number: (JSON name, type).  A type is a message's
# name, a scalar, or either in a list for repeated fields.  Scalars: s text, x hexadecimal id, b bytes, v small integer,
# z signed integer, V 64-bit integer as text, I signed one, f 64-bit fixed as text, i 32-bit fixed, d double, t boolean.
_NUMBER = {2: ("startTimeUnixNano", "f"), 3: ("timeUnixNano", "f"), 4: ("asDouble", "d"), 5: ("exemplars", ["exemplar"]), 6: ("asInt", "F"), 7: ("attributes", ["pair"]), 8: ("flags", "v")}
_SERIES = {1: ("dataPoints", ["number"])}
MESSAGES: dict[str, dict[int, tuple]] = {
    "traces": {1: ("resourceSpans", ["resource_spans"])},
    "logs": {1: ("resourceLogs", ["resource_logs"])},
    "metrics": {1: ("resourceMetrics", ["resource_metrics"])},
    "resource_spans": {1: ("resource", "resource"), 2: ("scopeSpans", ["scope_spans"]), 3: ("schemaUrl", "s")},
    "resource_logs": {1: ("resource", "resource"), 2: ("scopeLogs", ["scope_logs"]), 3: ("schemaUrl", "s")},
    "resource_metrics": {1: ("resource", "resource"), 2: ("scopeMetrics", ["scope_metrics"]), 3: ("schemaUrl", "s")},
    "scope_spans": {1: ("scope", "scope"), 2: ("spans", ["span"]), 3: ("schemaUrl", "s")},
    "scope_logs": {1: ("scope", "scope"), 2: ("logRecords", ["record"]), 3: ("schemaUrl", "s")},
    "scope_metrics": {1: ("scope", "scope"), 2: ("metrics", ["metric"]), 3: ("schemaUrl", "s")},
    "resource": {1: ("attributes", ["pair"]), 2: ("droppedAttributesCount", "v")},
    "scope": {1: ("name", "s"), 2: ("version", "s"), 3: ("attributes", ["pair"]), 4: ("droppedAttributesCount", "v")},
    "pair": {1: ("key", "s"), 2: ("value", "value")},
    "value": {1: ("stringValue", "s"), 2: ("boolValue", "t"), 3: ("intValue", "I"), 4: ("doubleValue", "d"), 5: ("arrayValue", "values"), 6: ("kvlistValue", "pairs"), 7: ("bytesValue", "b")},
    "values": {1: ("values", ["value"])},
    "pairs": {1: ("values", ["pair"])},
    "span": {
        1: ("traceId", "x"), 2: ("spanId", "x"), 3: ("traceState", "s"), 4: ("parentSpanId", "x"), 5: ("name", "s"), 6: ("kind", "v"), 7: ("startTimeUnixNano", "f"), 8: ("endTimeUnixNano", "f"),
        9: ("attributes", ["pair"]), 10: ("droppedAttributesCount", "v"), 11: ("events", ["event"]), 12: ("droppedEventsCount", "v"), 13: ("links", ["link"]), 14: ("droppedLinksCount", "v"), 15: ("status", "status"), 16: ("flags", "i"),
    },
    "event": {1: ("timeUnixNano", "f"), 2: ("name", "s"), 3: ("attributes", ["pair"]), 4: ("droppedAttributesCount", "v")},
    "link": {1: ("traceId", "x"), 2: ("spanId", "x"), 3: ("traceState", "s"), 4: ("attributes", ["pair"]), 5: ("droppedAttributesCount", "v"), 6: ("flags", "i")},
    "status": {2: ("message", "s"), 3: ("code", "v")},
    "record": {
        1: ("timeUnixNano", "f"), 2: ("severityNumber", "v"), 3: ("severityText", "s"), 5: ("body", "value"), 6: ("attributes", ["pair"]), 7: ("droppedAttributesCount", "v"), 8: ("flags", "i"),
        9: ("traceId", "x"), 10: ("spanId", "x"), 11: ("observedTimeUnixNano", "f"), 12: ("eventName", "s"),
    },
    "metric": {1: ("name", "s"), 2: ("description", "s"), 3: ("unit", "s"), 5: ("gauge", "gauge"), 7: ("sum", "sum"), 9: ("histogram", "histogram"), 10: ("exponentialHistogram", "exponential"), 11: ("summary", "summary"), 12: ("metadata", ["pair"])},
    "gauge": _SERIES,
    "sum": _SERIES | {2: ("aggregationTemporality", "v"), 3: ("isMonotonic", "t")},
    "histogram": {1: ("dataPoints", ["buckets_point"]), 2: ("aggregationTemporality", "v")},
    "exponential": {1: ("dataPoints", ["exponential_point"]), 2: ("aggregationTemporality", "v")},
    "summary": {1: ("dataPoints", ["summary_point"])},
    "number": _NUMBER,
    "buckets_point": {
        2: ("startTimeUnixNano", "f"), 3: ("timeUnixNano", "f"), 4: ("count", "f"), 5: ("sum", "d"), 6: ("bucketCounts", ["f"]), 7: ("explicitBounds", ["d"]), 8: ("exemplars", ["exemplar"]),
        9: ("attributes", ["pair"]), 10: ("flags", "v"), 11: ("min", "d"), 12: ("max", "d"),
    },
    "exponential_point": {
        1: ("attributes", ["pair"]), 2: ("startTimeUnixNano", "f"), 3: ("timeUnixNano", "f"), 4: ("count", "f"), 5: ("sum", "d"), 6: ("scale", "z"), 7: ("zeroCount", "f"), 8: ("positive", "buckets"), 9: ("negative", "buckets"),
        10: ("flags", "v"), 11: ("exemplars", ["exemplar"]), 12: ("min", "d"), 13: ("max", "d"), 14: ("zeroThreshold", "d"),
    },
    "buckets": {1: ("offset", "z"), 2: ("bucketCounts", ["V"])},
    "summary_point": {2: ("startTimeUnixNano", "f"), 3: ("timeUnixNano", "f"), 4: ("count", "f"), 5: ("sum", "d"), 6: ("quantileValues", ["quantile"]), 7: ("attributes", ["pair"]), 8: ("flags", "v")},
    "quantile": {1: ("quantile", "d"), 2: ("value", "d")},
    "exemplar": {2: ("timeUnixNano", "f"), 3: ("asDouble", "d"), 4: ("spanId", "x"), 5: ("traceId", "x"), 6: ("asInt", "F"), 7: ("filteredAttributes", ["pair"])},
}


class BadBody(ValueError):
    """A request's body isn't what its content type says."""


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        if at >= len(data) or shift > 63:
            raise BadBody("a number is cut off")
        value |= (data[at] & 127) << shift
        shift += 7
        at += 1
        if data[at - 1] < 128:
            return value, at


def _fields(data: bytes):
    """(number, wire type, raw value) of each field."""
    at = 0
    while at < len(data):
        tag, at = _varint(data, at)
        wire = tag & 7
        if wire == 0:
            raw, at = _varint(data, at)
        else:
            size, at = _varint(data, at) if wire == 2 else ({1: 8, 5: 4}.get(wire), at)
            if size is None or at + size > len(data):
                raise BadBody("a field is cut off or of an unknown kind")
            raw, at = data[at : at + size], at + size
        yield tag >> 3, wire, raw


_FIXED = {"f": "<Q", "F": "<q", "i": "<I", "d": "<d"}


def _scalar(kind: str, raw):
    """The JSON form of a scalar: 64-bit integers as text, ids in hexadecimal."""
    if kind in MESSAGES:
        return decode(kind, raw)
    if kind in _FIXED:
        (value,) = struct.unpack(_FIXED[kind], raw)
        return str(value) if kind in "fF" else value
    if kind == "s":
        return raw.decode("utf-8", "replace")
    if kind in "xb":
        return raw.hex() if kind == "x" else base64.b64encode(raw).decode()
    if kind == "t":
        return bool(raw)
    if kind == "z":
        return (raw >> 1) ^ -(raw & 1)
    if kind == "I":
        return str(raw - (1 << 64) if raw >> 63 else raw)
    return str(raw) if kind == "V" else raw


def _unpacked(kind: str, raw: bytes):
    """The scalars of a packed list."""
    at, width = 0, struct.calcsize(_FIXED[kind]) if kind in _FIXED else 0
    while at < len(raw):
        if width:
            value, at = raw[at : at + width], at + width
        else:
            value, at = _varint(raw, at)
        yield _scalar(kind, value)


def decode(message: str, data: bytes) -> dict:
    """A message's JSON form; unknown fields are skipped."""
    out: dict = {}
    try:
        for number, wire, raw in _fields(data):
            name, kind = MESSAGES[message].get(number, (None, None))
            if name is None:
                continue
            if isinstance(kind, list):
                packed = wire == 2 and kind[0] not in MESSAGES and kind[0] not in "sxb"
                out.setdefault(name, []).extend(_unpacked(kind[0], raw) if packed else [_scalar(kind[0], raw)])
            elif not (kind == "x" and not raw):  # an empty id is none
                out[name] = _scalar(kind, raw)
    except (struct.error, TypeError, AttributeError) as error:
        raise BadBody(f"not a message of {message}: {error}") from None
    return out


_numbers = count()


def store(folder: str, signal: str, document: dict) -> str:
    """Write one document; its name appears only when it is whole."""
    os.makedirs(folder, exist_ok=True)
    path = os.path.join(folder, f"{signal}-{time.time_ns()}-{next(_numbers):06d}.otlp.json")
    with open(f"{path}.part", "w", encoding="utf-8") as file:
        json.dump(document, file)
    os.replace(f"{path}.part", path)
    return path


def handler(folder: str) -> type[BaseHTTPRequestHandler]:
    class Receiver(BaseHTTPRequestHandler):
        def log_message(self, *args):
            pass

        def _body(self) -> bytes:
            if self.headers.get("Transfer-Encoding", "").lower() == "chunked":
                parts = []
                while size := int(self.rfile.readline().split(b";")[0], 16):
                    parts.append(self.rfile.read(size))
                    self.rfile.readline()
                while self.rfile.readline().strip():  # trailers
                    pass
                body = b"".join(parts)
            else:
                body = self.rfile.read(int(self.headers.get("Content-Length") or 0))
            return gzip.decompress(body) if self.headers.get("Content-Encoding") == "gzip" else body

        def _answer(self, code: int, kind: str = "text/plain", body: bytes = b"") -> None:
            self.send_response(code)
            self.send_header("Content-Type", kind)
            self.send_header("Content-Length", str(len(body)))
            self.end_headers()
            self.wfile.write(body)

        def do_POST(self):
            base, _, signal = self.path.rstrip("/").rpartition("/")
            if base != "/v1" or signal not in ("traces", "logs", "metrics"):
                return self._answer(404)
            as_json = self.headers.get("Content-Type", "").startswith("application/json")
            try:
                body = self._body()
                document = json.loads(body) if as_json else decode(signal, body)
            except (ValueError, OSError, EOFError) as error:
                return self._answer(400, body=str(error).encode())
            store(folder, signal, document)
            # An empty answer says that all was taken.
            return self._answer(200, *(("application/json", b"{}") if as_json else ("application/x-protobuf",)))

    return Receiver


def server(folder: str, host: str = "127.0.0.1", port: int = 4318) -> ThreadingHTTPServer:
    return ThreadingHTTPServer((host, port), handler(folder))


def serve(folder: str, host: str = "127.0.0.1", port: int = 4318) -> None:
    """Receive until interrupted."""
    with server(folder, host, port) as running:
        try:
            running.serve_forever()
        except KeyboardInterrupt:
            pass
