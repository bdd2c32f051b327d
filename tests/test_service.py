import json
import threading
import urllib.error
import urllib.request
from concurrent.futures import ThreadPoolExecutor

import pytest

import micro
from gregaria.service import READS, Service, server
from gregaria.sources import snapshot
from gregaria.sources.csv_graph import load_csv


@pytest.fixture(scope="module")
def post(spark, tmp_path_factory):
    root = f"file://{tmp_path_factory.mktemp('store')}/graph"
    snapshot.save(load_csv(spark, micro.write(tmp_path_factory.mktemp("csv"))), root)
    running = server(Service(spark, root))
    thread = threading.Thread(target=running.serve_forever)
    thread.start()

    def call(name, arguments=None, method="POST"):
        data = None if method == "GET" else json.dumps(arguments or {}).encode()
        with urllib.request.urlopen(urllib.request.Request("http://{}:{}/{}".format(*running.server_address, name), data, method=method)) as answer:
            return json.loads(answer.read())

    yield call
    running.shutdown()
    running.server_close()
    thread.join()


def test_reads(post):
    assert [r["message_id"] for r in post("ic2", {"person_id": 1, "max_ms": micro.ms(9), "limit": 2})] == [204, 202]
    assert post("ic1", {"person_id": 1, "first_name": "Bob"})[0]["friend_id"] in (2, 9)
    assert post("is1", {"person_id": 999}) == []
    with ThreadPoolExecutor(4) as pool:
        assert list(pool.map(lambda i: post("ic13", {"person1": 1, "person2": i})[0]["shortest_path_length"], (1, 2, 5, 6))) == [0, 1, 3, -1]


def test_updates_are_seen_and_numbered(post):
    before = len(post("is3", {"person_id": 8}))
    assert post("iu8", {"person_id": 8, "person2_id": 5, "creation_ms": micro.ms(50)}) == {"version": 2}
    assert post("iu8", [{"person_id": 8, "person2_id": 6, "creation_ms": micro.ms(50)}, {"person_id": 8, "person2_id": 99, "creation_ms": 1}]) == {"version": 3}
    assert len(post("is3", {"person_id": 8})) == before + 2


@pytest.mark.parametrize(("name", "arguments", "status"), [("ic99", {}, 404), ("ic2", {"person": 1}, 400), ("iu8", {"person": 1}, 400), ("is1", [], 400)])
def test_errors(post, name, arguments, status):
    with pytest.raises(urllib.error.HTTPError) as error:
        post(name, arguments)
    assert error.value.code == status


def test_listing(post):
    listed = post("", method="GET")
    assert set(READS) < set(listed) and len(listed) == 29 and listed["ic9"] == ["person_id", "max_ms", "limit"]
