import pytest
from pyspark.sql import functions as F

from tests.conftest import SMALL
from threadmill.engine import Engine, mask_config, merge_config
from threadmill.functions import plugins
from threadmill.model import ListFilter, QueryItem
from threadmill.operators import graph
from threadmill.operators import vectors as V
from threadmill.plans import tables


@pytest.fixture(scope="module")
def engine(spark):
    s, t = tables.sessions(spark, SMALL), tables.turns(spark, SMALL)
    made = V.embed(V.chunks(t), V.hash_embedder(), "hash64")
    nodes, edges = graph.build(s)
    pages = spark.createDataFrame([("projects/a.md", "alpha", "Text on beta", [1.0] * 64)], "path string, stem string, body string, embedding array<double>")
    return Engine(spark, s, t, made, nodes, edges, pages, V.hash_embedder())


def test_recall(engine):
    word = engine.index.postings.groupBy("term").count().orderBy(F.desc("count"), "term").first().term
    got = engine.recall(word, 5).collect()
    assert 0 < len(got) <= 5 and got[0].score == 1.0
    assert engine.recall([QueryItem("keyword", word), QueryItem("semantic", word)], 5).count() > 0
    assert engine.recall([QueryItem("keyword", word), QueryItem("temporal", "since 2030-01-01")], 5).count() == 0
    assert engine.recall(word, topic="nothing").count() == 0


def test_the_rest(engine):
    one = engine.turns.first()
    assert engine.get(f"{one.session_id}:{one.turn_index}").count() == 1 and engine.get(one.session_id, full=True).first().content
    rows, total = engine.list(ListFilter(page_size=3))
    assert rows.count() == 3 and total.first().total >= 3
    assert engine.status().first().coverage == 100.0
    assert engine.graph_query(f"session:{one.session_id}", 2).count() > 0
    assert engine.wiki_search("alpha", "keyword").first().score == 2.0 and engine.wiki_search("alpha").count() == 1
    assert engine.daily("2024-01-01").count() > 0 and engine.lint().where("severity = 'error'").count() == 0
    assert engine.related(engine.sessions.limit(1).select(F.col("id").alias("session_id"))).count() > 0


def test_denied_tools(engine):
    e = Engine(engine.spark, engine.sessions, engine.turns, denied=("status",))
    with pytest.raises(PermissionError):
        e.status()
    with pytest.raises(ValueError):
        Engine(engine.spark, engine.sessions, engine.turns, denied=("nope",))


def test_config_patch():
    assert merge_config({"a": {"b": 1, "c": 2}}, {"a": {"b": None, "d": 3}, "token": "x"}) == {"a": {"c": 2, "d": 3}}


def test_config_view():
    config = {"graph": {"cloud_api_key": "k", "url": "u", "deep": {"token": "t"}}, "password": None, "n": 1}
    assert mask_config(config, environment={"X_API_KEY": "v", "Y_TOKEN": "", "HOME": "/"}) == {"graph": {"cloud_api_key": "<masked>", "url": "u", "deep": {"token": "<masked>"}}, "password": None, "n": 1, "env_indicators": {"X_API_KEY": True, "Y_TOKEN": False}}
    assert config["graph"]["cloud_api_key"] == "k"


def test_expansion_finds_more(engine):
    words = [r.term for r in engine.index.postings.groupBy("term").count().orderBy("count", "term").limit(2).collect()]
    e = Engine(engine.spark, engine.sessions, engine.turns, index=engine.index, expander=lambda system, q: words[1])
    assert {r.session_id for r in e.recall(words[0], 50).collect()} <= {r.session_id for r in e.recall(words[0], 50, expand=True).collect()}
    assert e.query_cache.count() == 1 and e.recall(words[0], expand=True).count() > 0 and e.query_cache.count() == 1


def test_models_and_progress():
    from datetime import datetime, timedelta

    m, now = plugins.Models(), datetime(2024, 1, 1)
    down = lambda: 1 / 0
    assert m.list("a", down, ["x"], now) == (["x"], "fallback") and m.list("a", lambda: ["y"], ["x"], now) == (["y"], "dynamic")
    assert m.list("a", down, ["x"], now + timedelta(minutes=59)) == (["y"], "cached") and m.list("a", down, ["x"], now + timedelta(hours=2)) == (["x"], "fallback")
    assert m.list("a", lambda: ["z"], [], now, force=True) == (["z"], "dynamic") and m.list("b", None, ["w"], now) == (["w"], "fallback")
    c = plugins.Channel(2)
    q = c.listen()
    for i in range(5):
        c("p", i)
    assert "".join(plugins.server_sent(q)) == 'event: progress\ndata: {"phase": "p", "n": 3}\n\nevent: progress\ndata: {"phase": "p", "n": 4}\n\n'


def test_http_backends():
    import json
    import threading
    from http.server import BaseHTTPRequestHandler, HTTPServer

    class Server(BaseHTTPRequestHandler):
        def do_POST(self):  # noqa: N802
            asked = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            many = [[float(len(t)), 1.0] for t in asked.get("input", [])]
            said = {"/a": {"embeddings": many}, "/b": {"data": [{"index": i, "embedding": v} for i, v in reversed(list(enumerate(many)))]}, "/c": {"embedding": [float(len(asked.get("prompt", "")))]}, "/d": {"embeddings": []}}[self.path]
            self.send_response(200)
            self.end_headers()
            self.wfile.write(json.dumps(said).encode())

        def log_message(self, *args):
            pass

    server = HTTPServer(("127.0.0.1", 0), Server)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    at = f"http://127.0.0.1:{server.server_port}"
    assert plugins.http_embedder(at + "/a", "m")(["ab", "c"]) == [[2.0, 1.0], [1.0, 1.0]] == plugins.http_embedder(at + "/b", "m", "key")(["ab", "c"])
    assert plugins.single_http_embedder(at + "/c", "m")(["ab", "c"]) == [[2.0], [1.0]]
    with pytest.raises(ValueError):
        plugins.http_embedder(at + "/d", "m")(["x"])
    assert plugins.choose_embedder("d", {"d": lambda: plugins.http_embedder(at + "/d", "m"), "onnx": lambda: plugins.onnx_embedder("/no/such"), "a": lambda: plugins.http_embedder(at + "/a", "m")}, ("onnx", "a"))[0] == "a"
    server.shutdown()


def test_pooling():
    import numpy as np

    got = plugins.mean_pool(np.array([[[3.0, 0.0], [0.0, 4.0], [9.0, 9.0]], [[1.0, 1.0]] * 3]), np.array([[1, 1, 0], [0, 0, 0]]))
    assert got.round(6).tolist() == [[0.6, 0.8], [0.0, 0.0]]


def test_tokens_of_index_and_query_agree(spark):
    """Every character of the lower planes that this Python knows, between two words."""
    import unicodedata

    from threadmill.functions import text as X

    texts = [f"ab{chr(c)}cd".lower() for c in [*range(1, 0x3100), *range(0xFE00, 0xFFFE)] if unicodedata.category(chr(c)) not in ("Cn", "Cs")]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", X.tokens(F.col("t")).alias("w")).collect()
    wrong = [r.t for r in got if list(r.w) != X.query_tokens(r.t)]
    assert not wrong, [hex(ord(t[2])) for t in wrong][:20]
    assert X.query_terms(spark, "Ab\u3000CD e\xa0fg") == ["ab", "cd", "fg"]
    assert X.query_tokens("안녕\u3000세계 hello\xa0world") == ["안녕", "세계", "hello", "world"]
