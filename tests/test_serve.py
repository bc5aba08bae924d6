import io
import json

from lectern.serve import Server


class Stub:
    def status(self):
        return {"documents": 2}

    def read_chunk(self, i):
        return {"id": i} if i == 1 else None

    def config(self, key):
        return self.values.get(key)

    def set_config(self, key, value):
        self.values[key] = value

    values: dict = {}


def ask(method, params=None, i=1):
    return json.loads(Server(Stub()).answer(json.dumps({"jsonrpc": "2.0", "id": i, "method": method, "params": params or {}})))


def call(name, **arguments):
    return ask("tools/call", {"name": name, "arguments": arguments})


def test_messages():
    assert ask("initialize")["result"]["serverInfo"]["name"] == "lectern" and ask("ping")["result"] == {}
    assert len(ask("tools/list")["result"]["tools"]) == 7
    assert ask("no")["error"]["code"] == -32601
    assert json.loads(Server(Stub()).answer("{"))["error"]["code"] == -32700
    assert json.loads(Server(Stub()).answer("[]"))["error"]["code"] == -32600
    assert Server(Stub()).answer('{"jsonrpc": "2.0", "method": "notifications/initialized"}') is None


def test_tools():
    assert json.loads(call("status")["result"]["content"][0]["text"]) == {"documents": 2}
    assert json.loads(call("read_chunk", chunk_id=1)["result"]["content"][0]["text"]) == {"id": 1}
    for bad in (call("read_chunk"), call("read_chunk", chunk_id="1"), call("read_chunk", chunk_id=2), call("none")):
        assert bad["error"]["code"] == -32602
    assert json.loads(call("config", key="k", value="v")["result"]["content"][0]["text"]) == {"k": "v"}
    assert call("list_docs")["error"]["code"] == -32603


def test_loop():
    out = io.StringIO()
    Server(Stub()).run(['{"id": 1, "method": "ping"}\n', "\n", '{"method": "x"}\n', '{"id": 2, "method": "ping"}\n'], out)
    assert [json.loads(x)["id"] for x in out.getvalue().splitlines()] == [1, 2]
