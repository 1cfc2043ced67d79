import pytest

from logweave import cli
from logweave.api import Store


@pytest.fixture
def call(spark, tmp_path):
    store = Store.open_or_create(spark, f"{tmp_path}/store")
    return lambda *a: cli.run(Store.open_or_create(spark, store.path), cli.parser().parse_args([store.path, *a]))


def test_verbs(call):
    assert call("get", "a") == (1, ["(not found)"])
    assert call("put", "a", "1") == (0, ["ok 1"])
    assert call("cas", "a", "2", "3") == (1, ["failed, actual: 1"])
    assert call("cas", "b", "-", "x") == (0, ["ok"])
    assert call("scan", "a") == (0, ["a\t1", "b\tx"])
    assert call("scan", "a", "b", "--limit", "5") == (0, ["a\t1"])
    assert call("del", "a") == (0, ["ok 3"])
    assert call("get", "a") == (1, ["(not found)"]) and call("get", "a", "--snapshot", "1") == (0, ["1"])
    assert call("cas", "b", "x", "-") == (0, ["ok"]) and call("scan", "") == (0, [""][:0])
    assert call("status") == (0, ["last_seq 4"])


def test_clear_and_load(spark, tmp_path):
    store = Store.create(spark, f"{tmp_path}/store")
    store.write([("a", "1"), ("b", "2")])
    rows = spark.createDataFrame([(b"b", b"3"), (b"c", b"4")], "key binary, value binary")
    assert store.clear_and_load(rows) == 3
    assert [(bytes(r[0]), bytes(r[1])) for r in store.dump().orderBy("key").collect()] == [(b"b", b"3"), (b"c", b"4")]
