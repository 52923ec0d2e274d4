import io
import json
import threading
import time
import urllib.error
import urllib.request
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest
from sparktab import serving
from sparktab.operators.store import Store
from sparktab.plans.compress import compress
from sparktab.sources import remote


@pytest.fixture
def page(spark):
    server = serving.web_server(spark, 0)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_address[1]}"
    server.shutdown()
    server.server_close()


def test_page_and_compression(page):
    assert b"sparktab" in urllib.request.urlopen(page + "/").read()
    payload = json.dumps([{"i": i, "pad": "the same long text in every row"} for i in range(30)]).encode()
    found = json.load(urllib.request.urlopen(urllib.request.Request(page + "/compress", payload)))
    assert found["status"] == "table" and found["after"] < found["before"]
    for path, body, status in (("/none", None, 404), ("/none", b"x", 404), ("/compress", b"", 400)):
        with pytest.raises(urllib.error.HTTPError) as e:
            urllib.request.urlopen(urllib.request.Request(page + path, body))
        assert e.value.code == status


def test_tools_over_json_rpc(spark, tmp_path):
    body = "a long sentence to be stored, " * 20
    payload = json.dumps([{"i": i, "b": f"{body}{i}"} for i in range(12)]).encode()
    done = compress(spark.createDataFrame([("it", payload)], "doc_id string, raw binary"), with_store=True)
    Store(spark, str(tmp_path)).commit(done.moved, done.ids)
    name = done.ids.first().document_id
    asked = [
        {"jsonrpc": "2.0", "id": 1, "method": "initialize", "params": {}}, {"jsonrpc": "2.0", "method": "notifications/initialized"}, {"jsonrpc": "2.0", "id": 2, "method": "tools/list"},
        {"jsonrpc": "2.0", "id": 3, "method": "tools/call", "params": {"name": "fetch", "arguments": {"document": name, "ids": ["1", 99]}}},
        {"jsonrpc": "2.0", "id": 4, "method": "tools/call", "params": {"name": "fetch", "arguments": {"document": name}}}, {"jsonrpc": "2.0", "id": 5, "method": "other"},
    ]
    out = io.StringIO()
    serving.serve_tools(spark, str(tmp_path), io.StringIO("\n".join(map(json.dumps, asked)) + "\nno json\n[]\n"), out)
    answers = [json.loads(x) for x in out.getvalue().splitlines()]
    assert [a["id"] for a in answers] == [1, 2, 3, 4, 5, None, None]
    assert answers[1]["result"]["tools"][0]["name"] == "fetch"
    text = answers[2]["result"]["content"][0]["text"]
    assert f"{body}0" in text and "unknown_id" in text
    assert [a["error"]["code"] for a in answers[3:]] == [-32602, -32601, -32700, -32600]


def test_payloads_from_addresses(spark, tmp_path):
    times = []

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            times.append(time.monotonic())
            self.send_response(200 if self.path == "/a" else 500)
            self.end_headers()
            self.wfile.write(b'[{"i": 1}, {"i": 2}]')

        def log_message(self, *args):
            pass

    server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    root = f"http://127.0.0.1:{server.server_address[1]}"
    rows = [("a", root + "/a"), ("b", root + "/b"), ("c", "file:///etc/passwd"), ("d", None), ("e", root + "/a")]
    bad = remote.saved(remote.read_addresses(spark.createDataFrame(rows, "doc_id string, address string"), pause=0.3), str(tmp_path / "t"))
    server.shutdown()
    server.server_close()
    assert sorted(r.doc_id for r in bad.collect()) == ["b", "c", "d"]
    assert {r.doc_id: bytes(r.raw) for r in spark.read.parquet(str(tmp_path / "t")).filter("raw is not null").collect()} == {x: b'[{"i": 1}, {"i": 2}]' for x in "ae"}
    assert len(times) == 3 and min(b - a for a, b in zip(times, times[1:])) > 0.25
