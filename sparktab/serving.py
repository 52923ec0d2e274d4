"""The same functions for other programs: a local web page, and tools over JSON-RPC on standard input."""

from __future__ import annotations

import json
import sys
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from typing import IO

from pyspark.sql import SparkSession

from .operators.fetch import fetch
from .operators.store import Store
from .plans.compress import compress

#: Where the page is served, and the largest payload it takes in bytes.
HOST, PORT, MOST_BYTES = "127.0.0.1", 8737, 16 << 20

PAGE = """<!doctype html><meta charset="utf-8"><title>sparktab</title>
<h1>sparktab</h1><textarea id="in" rows="12" cols="90" placeholder="JSON"></textarea><br><button id="go">Compress</button>
<p id="note"></p><pre id="out"></pre>
<script>
document.getElementById("go").onclick = async () => {
  const answer = await fetch("/compress", {method: "POST", body: document.getElementById("in").value});
  const found = await answer.json();
  document.getElementById("note").textContent = found.error || `${found.before} to ${found.after} tokens (${found.saved}% saved). ${found.note}`;
  document.getElementById("out").textContent = found.document || "";
};
</script>"""


def compressed(spark: SparkSession, raw: bytes) -> dict:
    """What became of one payload."""
    if not raw:
        return {"error": "the input is empty"}
    row = compress(spark.createDataFrame([("it", raw)], "doc_id string, raw binary")).documents.first()
    return {k: row[k] for k in ("document", "status", "note", "dropped", "before", "after", "saved")}


def web_server(spark: SparkSession, port: int = PORT) -> ThreadingHTTPServer:
    """``GET /`` is the page, ``POST /compress`` takes a payload and answers in JSON; this machine only."""

    class Handler(BaseHTTPRequestHandler):
        def _answer(self, status: int, kind: str, body: bytes) -> None:
            self.send_response(status)
            self.send_header("Content-Type", kind)
            self.send_header("Content-Length", str(len(body)))
            self.end_headers()
            self.wfile.write(body)

        def do_GET(self) -> None:
            if self.path == "/":
                self._answer(200, "text/html; charset=utf-8", PAGE.encode())
            else:
                self._answer(404, "text/plain", b"not found")

        def do_POST(self) -> None:
            length = self.headers.get("Content-Length", "")
            if self.path != "/compress":
                self._answer(404, "application/json", b'{"error":"not found"}')
            elif not length.isdigit() or int(length) > MOST_BYTES:
                self._answer(413, "application/json", b'{"error":"too large"}')
            else:
                found = compressed(spark, self.rfile.read(int(length)))
                self._answer(400 if "error" in found else 200, "application/json", json.dumps(found).encode())

        def log_message(self, *args) -> None:
            pass

    return ThreadingHTTPServer((HOST, port), Handler)


TOOL = {
    "name": "fetch",
    "description": "Values that a document keeps in the store, by the id on its #store line and the numbers of its handles; with a query only the parts around it.",
    "inputSchema": {
        "type": "object",
        "properties": {"document": {"type": "string"}, "ids": {"type": "array", "items": {"type": "string"}}, "query": {"type": "string"}},
        "required": ["document", "ids"],
    },
}


def answered(spark: SparkSession, root: str, message: dict) -> dict | None:
    """The answer to one JSON-RPC message; a notification has none."""
    method, given = message.get("method"), message.get("params") or {}
    if "id" not in message:
        return None

    def answer(**body) -> dict:
        return {"jsonrpc": "2.0", "id": message["id"], **body}

    if method == "initialize":
        return answer(result={"protocolVersion": given.get("protocolVersion", "2024-11-05"), "capabilities": {"tools": {}}, "serverInfo": {"name": "sparktab", "version": "1"}})
    if method == "ping":
        return answer(result={})
    if method == "tools/list":
        return answer(result={"tools": [TOOL]})
    if method != "tools/call" or given.get("name") != TOOL["name"]:
        return answer(error={"code": -32601, "message": f"unknown method: {method}"})
    wanted = given.get("arguments") or {}
    ids = wanted.get("ids")
    if not isinstance(wanted.get("document"), str) or not isinstance(ids, list):
        return answer(error={"code": -32602, "message": "document and ids are needed"})
    held = Store(spark, root)
    asked = spark.createDataFrame([("it", wanted["document"], [str(x) for x in ids])], "request string, document string, ids array<string>")
    found = fetch(asked, held.index, held.objects, wanted.get("query") or None).orderBy("pos").collect()
    text = "\n\n".join(f"[{r.cell_id}] {r.state}" + (f"\n{r.content}" if r.content is not None else "") for r in found)
    return answer(result={"content": [{"type": "text", "text": text}], "isError": False})


def serve_tools(spark: SparkSession, root: str, source: IO[str] = sys.stdin, sink: IO[str] = sys.stdout) -> None:
    """JSON-RPC, one message a line, until the input ends."""
    for line in source:
        if not line.strip():
            continue
        try:
            message = json.loads(line)
            out = answered(spark, root, message) if isinstance(message, dict) else {"jsonrpc": "2.0", "id": None, "error": {"code": -32600, "message": "not a request"}}
        except ValueError:
            out = {"jsonrpc": "2.0", "id": None, "error": {"code": -32700, "message": "not JSON"}}
        if out is not None:
            sink.write(json.dumps(out) + "\n")
            sink.flush()
