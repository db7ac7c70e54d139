import json
import urllib.error
import urllib.request

import pytest

from heddle.engine import Engine
from heddle.server import serve


def test_endpoints(spark):
    server = serve(Engine(spark), port=0)

    def ask(path, body=None):
        url = f"http://127.0.0.1:{server.server_port}/{path}"
        return json.loads(urllib.request.urlopen(urllib.request.Request(url, None if body is None else body.encode())).read())

    try:
        assert ask("exec/expr", "1 + 2") == 3 and ask("exec/parse", "LET $a = 1;") == ["let"]
        assert "o" in ask("exec/script", "LET $x = 7; SELECT 'v' AS a FROM dual INTO o; ALTER o KEY 1 PARTITION 2;")
        assert ask("ds/sample?name=o&limit=1") == [{"key": 1, "record": {"a": "v"}}] and ask("ds/part?name=o&part=0") == []
        assert ask("variables") == {"x": 7} and ask("options")["loop_iteration_limit"] == 32
        assert [d["name"] for d in ask("ds")] == ["dual", "o"] and ask("ds/lineage?name=o")[-1][0] == "ALTERED"
        assert "keyedMath" in ask("entities")["operations"] and ask("ds/persist?name=o") and ask("ds/renounce?name=o")
        for path, body, code in (("nothing", None, 404), ("ds/sample?name=o", None, 404), ("exec/script", "SELECT;", 400)):
            with pytest.raises(urllib.error.HTTPError) as e:
                ask(path, body)
            assert e.value.code == code
    finally:
        server.shutdown()
