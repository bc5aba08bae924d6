"""A corpus as a tool server: JSON-RPC 2.0, one message a line, over any pair of text streams."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable
from typing import TextIO

from . import __version__
from .operators.fusion import EmbeddingRequired
from .operators.lexical import QueryError

PARSE, REQUEST, METHOD, PARAMS, INTERNAL = -32700, -32600, -32601, -32602, -32603
PROTOCOL = "2024-11-05"


class ParamError(ValueError):
    pass


def _tool(name: str, text: str, **fields: str) -> dict:
    """A tool's description; a field's type ends in "!" where it is required."""
    return {"name": name, "description": text, "inputSchema": {"type": "object", "properties": {k: {"type": v.rstrip("!")} for k, v in fields.items()}, "required": [k for k, v in fields.items() if v.endswith("!")]}}


TOOLS = [
    _tool("search", "Ranked chunks for a query", query="string!", mode="string", limit="integer", format="string"),
    _tool("status", "Counts of documents and chunks, and the latest time of indexing"),
    _tool("read_chunk", "One chunk with its document", chunk_id="integer!"),
    _tool("list_docs", "Documents by path"),
    _tool("config", "A setting, or put a new value", key="string!", value="string"),
    _tool("index", "Index the files below a path", path="string!"),
    _tool("update", "Bring the index up to date with a path", path="string!"),
]


class Server:
    def __init__(self, corpus, provider=None) -> None:
        self.corpus, self.provider = corpus, provider
        self.known = {t["name"]: t["inputSchema"] for t in TOOLS}

    # -- tools -------------------------------------------------------------

    def call(self, name: str, a: dict) -> object:
        schema = self.known.get(name)
        if schema is None:
            raise ParamError(f"no such tool: {name}")
        kinds = {"string": str, "integer": int}
        for k in schema["required"]:
            if k not in a:
                raise ParamError(f"{k} is missing")
        for k, v in a.items():
            want = schema["properties"].get(k)
            if want and (not isinstance(v, kinds[want["type"]]) or isinstance(v, bool)):
                raise ParamError(f"{k} must be of type {want['type']}")
        c = self.corpus
        if name == "search":
            return [json.loads(x) for x in c.search(a["query"], a.get("mode", "hybrid"), a.get("limit", 10), self.provider, format_filter=a.get("format")).toJSON().collect()]
        if name == "status":
            return c.status()
        if name == "read_chunk":
            found = c.read_chunk(a["chunk_id"])
            if found is None:
                raise ParamError(f"no chunk {a['chunk_id']}")
            return found
        if name == "list_docs":
            return [json.loads(x) for x in c.list_documents().toJSON().collect()]
        if name == "config":
            if "value" in a:
                c.set_config(a["key"], a["value"])
            return {a["key"]: c.config(a["key"])}
        return vars(c.index(a["path"], self.provider))

    # -- messages ----------------------------------------------------------

    def _result(self, method: str, params: dict) -> object:
        if method == "initialize":
            return {"protocolVersion": PROTOCOL, "capabilities": {"tools": {}}, "serverInfo": {"name": "lectern", "version": __version__}}
        if method == "ping":
            return {}
        if method == "tools/list":
            return {"tools": TOOLS}
        try:
            out, bad = self.call(str(params.get("name")), params.get("arguments") or {}), False
        except (QueryError, EmbeddingRequired) as e:  # the caller's query, not the call
            out, bad = str(e), True
        return {"content": [{"type": "text", "text": out if isinstance(out, str) else json.dumps(out, ensure_ascii=False)}], "isError": bad}

    def answer(self, line: str) -> str | None:
        """The reply to one line; None to a notification."""
        error: Callable[[object, int, str], str] = lambda i, code, text: json.dumps({"jsonrpc": "2.0", "id": i, "error": {"code": code, "message": text}})
        try:
            m = json.loads(line)
        except ValueError:
            return error(None, PARSE, "not JSON")
        if not isinstance(m, dict) or not isinstance(m.get("method"), str):
            return error(m.get("id") if isinstance(m, dict) else None, REQUEST, "not a request")
        i, method, params = m.get("id"), m["method"], m.get("params") or {}
        if "id" not in m:
            return None
        if method not in ("initialize", "ping", "tools/list", "tools/call"):
            return error(i, METHOD, f"no such method: {method}")
        if not isinstance(params, dict) or not isinstance(params.get("arguments") or {}, dict):
            return error(i, PARAMS, "params must be an object")
        try:
            return json.dumps({"jsonrpc": "2.0", "id": i, "result": self._result(method, params)}, ensure_ascii=False)
        except ParamError as e:
            return error(i, PARAMS, str(e))
        except Exception as e:
            return error(i, INTERNAL, f"{type(e).__name__}: {e}"[:500])

    def run(self, lines: Iterable[str], out: TextIO) -> None:
        for line in lines:
            if line.strip() and (reply := self.answer(line)) is not None:
                out.write(reply + "\n")
                out.flush()
