import json
import threading
import urllib.error
import urllib.request
from urllib.parse import quote

import pytest

from tokenloom.serve import server
from tokenloom.sources import annotated
from tokenloom.sources.store import Store

from .test_store import painter


@pytest.fixture(scope="module")
def url(spark, tmp_path_factory):
    store = Store(spark, str(tmp_path_factory.mktemp("serve") / "t"))
    store.add_sentences(annotated.sentences_of_json(spark, *[painter(i) for i in range(5)]))
    s = server(store)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{s.server_address[1]}"
    s.shutdown()
    s.server_close()


def call(url, body=None):
    try:
        with urllib.request.urlopen(urllib.request.Request(url, None if body is None else body.encode(), {"Content-Type": "application/json"}), timeout=60) as r:
            return r.status, json.load(r)
    except urllib.error.HTTPError as e:
        return e.code, json.load(e)


def test_search_by_page(url):
    status, one = call(f"{url}/v1/search?query={quote('[tag=VERB] >agent [word=Maria]')}&limit=3&count=true")
    assert status == 200 and len(one["hits"]) == 3 and one["total_hits"] == 5 and one["hits"][0]["matches"][0]["spans"][1]["text"] == "Maria"
    status, two = call(f"{url}/v1/search", json.dumps({"query": "[tag=VERB] >agent [word=Maria]", "limit": 3, "cursor": one["next_cursor"]}))
    assert status == 200 and [h["doc_id"] for h in one["hits"] + two["hits"]] == [f"d{i}" for i in range(5)] and two["exhausted"]


def test_other_paths(url):
    assert call(f"{url}/health") == (200, {"status": "ok"}) and call(f"{url}/v1/index")[1]["sentences"] == 10 and "/v1/search" in call(f"{url}/openapi.json")[1]["paths"]
    assert call(f"{url}/no")[0] == 404 and call(f"{url}/no", "{}")[0] == 404


@pytest.mark.parametrize("body", ["", "{", "[]", "{}", '{"query": 1}', '{"query": "["}', '{"query": "a", "limit": "x"}', '{"query": "a", "limit": 0}', '{"query": "a", "cursor": "zz"}', '{"query": "a", "more": 1}'])
def test_bad_requests(url, body):
    assert call(f"{url}/v1/search", body)[0] == 400
