"""Collections: changes, transactions, schemas, indexes, listeners."""

import datetime as dt
from dataclasses import dataclass

import pytest
from pyspark.sql import functions as F

from folio.functions import codec
from folio.sources.collection import Collection
from folio.sources.snapshot import Conflict, advanced
from folio.streaming.watch import watch


@pytest.fixture
def c(spark, tmp_path):
    return Collection.open(spark, str(tmp_path / "c"))


def london(q):
    return q.where("city").equals("London")


def test_put_get_delete(c):
    assert c.count() == 0 and c.find_by_id(1) is None and c.insert_all([]) == range(0)
    assert c.insert({"name": "Alice"}) == 1
    assert list(c.insert_all([{"name": "Bob", "age": 3}, {"age": 2.5}])) == [2, 3]
    assert c.find_by_id(1) == {"_id": 1, "name": "Alice", "age": None}
    assert c.find_by_id(3)["age"] == 2.5 and c.find_by_id(2)["age"] == 3.0
    c.put(2, {"name": "Bobby"})
    c.put(10, {"name": "Ten"})
    assert c.insert({"name": "next"}) == 11
    assert c.find_by_id(2) == {"_id": 2, "name": "Bobby", "age": None}
    assert c.delete(1) and not c.delete(1) and not c.exists(1) and c.exists(2)
    assert c.range_search(2, 10) == [2, 3, 10]
    assert [r["_id"] for r in c.get_all().collect()] == [2, 3, 10, 11]
    assert sorted(r["_id"] for r in c.find_by_ids([3, 3, 10, 77]).collect()) == [3, 10]
    assert c.insert({"name": "ids are not used again"}) == 12


def test_update(c):
    c.insert_all([{"city": "London", "score": 10}, {"city": "London", "score": 20}, {"city": "Paris", "score": 30}])
    assert c.update(1, {"score": 11, "tag": ["a"]}) and not c.update(9, {"score": 1})
    assert c.find_by_id(1) == {"_id": 1, "city": "London", "score": 11, "tag": ["a"]}
    assert c.update(1, {"tag": None}) and c.find_by_id(1)["tag"] is None
    before = len(c.store.versions())
    assert c.update_where(london, {"score": 99}) == 2 and c.update_where(lambda q: q.where("city").equals("x"), {"score": 1}) == 0
    assert len(c.store.versions()) == before + 1
    assert [r["score"] for r in c.get_all().collect()] == [99, 99, 30]
    assert c.update_where(london, {"score": "high"}) == 2  # the field now holds numbers and strings
    assert [r[0] for r in c.get_all().select(F.expr("try_variant_get(score, '$', 'string')")).collect()] == ["high", "high", "30"]
    assert c.sum_where(None, "score") == 30
    assert c.delete_where(london) == 2 and c.delete_where(london) == 0 and c.count() == 1


def test_aggregates(c):
    c.insert_all([{"city": x, "salary": y} for x, y in (("London", 50000), ("London", 70000), ("Paris", 60000), ("Tokyo", 80000))])
    none = lambda q: q.where("city").equals("x")
    assert (c.count_where(london), c.sum_where(london, "salary"), c.avg_where(london, "salary")) == (2, 120000, 60000)
    assert (c.sum_where(none, "salary"), c.avg_where(none, "salary"), c.min_where(none, "salary")) == (0, None, None)
    assert (c.min_where(None, "salary"), c.max_where(None, "salary"), c.max_where(None, "city")) == (50000, 80000, "Tokyo")
    assert c.avg_where(None, "city") is None


def test_types(c):
    @dataclass
    class Geo:
        latitude: float
        longitude: float

    doc = {
        "small": 42, "large": 9223372036854775807, "negative": -5, "zero": 0, "pi": 3.14, "tiny": 1.23e-10, "text": "你好🌍", "empty": "", "lines": "a\nb", "yes": True,
        "at": dt.datetime(2024, 1, 2, 3, 4, 5, 678000), "nothing": None, "user": {"name": "x", "address": {"city": "y"}}, "tags": ["a", "b"], "matrix": [[1, 2], [3]], "raw": b"\x00\xff",
    }
    c.insert(doc | {"home": type("P", (), {"latitude": 1.5, "longitude": 2.0})()})
    got = c.find_by_id(1)
    assert {k: bytes(v) if isinstance(v, bytearray) else v for k, v in got.items() if k in doc} == {k: v for k, v in doc.items() if v is not None}
    assert got["home"] == {"latitude": 1.5, "longitude": 2.0}
    c.insert({"mixed": [1, "a", {"b": None}], "small": "text now"})
    row = c.df().where("_id = 2").select(F.to_json("mixed").alias("m"), F.expr("variant_get(small, '$', 'string')").alias("s")).first()
    assert row["m"] == '[1,"a",{"b":null}]' and row["s"] == "text now"
    assert c.find_by_id(1)["pi"] == 3.14


def test_adapters(c):
    @dataclass
    class Person:
        name: str
        age: int

    class Other:
        pass

    c.registry.register(7, Person)
    c.registry.register(7, Person)
    with pytest.raises(ValueError):
        c.registry.register(7, Other)
    with pytest.raises(ValueError):
        c.registry.register(8, Other)
    key = c.insert(Person("Ann", 5))
    assert c.find_object(key) == Person("Ann", 5) and c.find_object(99) is None
    assert codec.Registry().encode(3) == {"value": 3, "runtime_type": "int"}


def test_user_ids(c):
    c.insert_all([{"id": "abc", "t": 1}, {"t": 2}])
    assert [r["id"] for r in c.documents().orderBy("_id").collect()] == ["abc", "2"]
    c.update(1, {"t": 5})
    assert c.find_by_id(1)["id"] == "abc"


def test_dataframe_ids_follow_order(spark, c):
    c.insert({"val": -1})
    assert c.insert_all(spark.range(0, 6000, 1, 5).select(F.col("id").alias("val"))) == range(2, 6002)
    assert c.df().where(F.col("_id") != F.col("val") + 2).where("val >= 0").count() == 0
    assert c.query().where("val").equals(5999).find_ids() == [6001]
    assert c.insert_all(spark.range(0).select(F.col("id").alias("val"))) == range(0)


def test_transactions(spark, c):
    c.insert({"n": 1})
    with pytest.raises(RuntimeError, match="undo"), c.transaction():
        c.insert({"n": 2})
        c.delete(1)
        assert c.count() == 1 and c.find_by_id(2)["n"] == 2
        raise RuntimeError("undo")
    assert c.query().find_ids() == [1]
    with c.transaction():
        assert c.insert({"n": 2}) == 2
        assert c.update(2, {"n": 3})
        with pytest.raises(RuntimeError), c.transaction():
            pass
    other = Collection.open(spark, c.store.path)
    assert [r["n"] for r in other.get_all().collect()] == [1, 3]
    before = len(c.store.versions())
    with c.batch():
        for i in range(3):
            c.insert({"n": i})
    assert len(c.store.versions()) == before + 1 and c.count() == 5
    assert c.df(version=1).count() == 1


def test_writers_do_not_overwrite_each_other(spark, c):
    c.insert({"n": 1})
    state = c.store.load()
    with pytest.raises(Conflict):
        c.store.publish(state, ["again"])
    real, calls = c.store.publish, []

    def late(m, kinds):
        if not calls:
            calls.append(1)
            Collection(spark, c.store.path).insert({"n": 2})
        return real(m, kinds)

    c.store.publish = late
    assert c.insert({"n": 3}) == 3 and c.count() == 3
    assert advanced(state, version=9).version == 9


def test_lifecycle(spark, tmp_path):
    with Collection.open(spark, str(tmp_path / "x")) as c:
        c.insert({"a": 1})
        assert c.is_open
    c.close()
    assert not c.is_open
    with pytest.raises(RuntimeError):
        c.count()
    assert Collection.open(spark, str(tmp_path / "x")).count() == 1
    m = Collection.memory(spark)
    m.insert({"a": 1})
    assert m.count() == 1


def test_migrations(spark, tmp_path):
    path = str(tmp_path / "m")
    Collection.open(spark, path).insert({"value": 1})
    double = lambda df: df.withColumn("value", F.col("value") * 2)
    assert Collection.open(spark, path, version=3, migrations={1: double, 2: double}).find_by_id(1)["value"] == 4
    assert Collection.open(spark, path, version=3, migrations={1: double, 2: double, 3: double}).find_by_id(1)["value"] == 4


def test_indexes_and_compaction(spark, tmp_path):
    c = Collection.open(spark, str(tmp_path / "i"), hash_indexes=["city"], sorted_indexes=["age"], bitmap_indexes=["on"], composite_indexes=[["city", "age"]], fts_indexes=["text"])
    docs = [{"city": x, "age": i, "on": i % 2 == 0, "text": f"word{i} in {x}"} for i, x in enumerate(["London", "Paris", "London"])]
    for d in docs:
        c.insert(d)
    assert c.query().where("text").fts("london in").find_ids() == [1, 3]
    c.reindex()
    assert "postings" in c.query().where("text").fts("in").explain()
    assert c.query().where("text").fts("london in").find_ids() == [1, 3]
    c.insert({"text": "late london in"})  # the inverted table does not cover it, so its text is scanned
    assert "postings" in c.query().where("text").fts("in").explain()
    assert c.query().where("text").fts("london in").find_ids() == [1, 3, 4]
    before = c.get_all().collect()
    c.compact(files=1, vacuum=True)
    assert c.get_all().collect() == before and len(c.store.load().files) == 1 and len(c.store.versions()) == 1
    assert {tuple(r) for r in c.describe().collect()} == {("city", 4, 1, 2), ("age", 4, 1, 3), ("on", 4, 1, 2), ("text", 4, 0, 4)}
    assert "[hash]" in c.query().where("city").equals("x").explain()
    with pytest.raises(ValueError):
        c.reindex("nothing")
    with pytest.raises(ValueError):
        c.add_composite_index([])
    c.add_composite_index(["age"])
    assert [i.kind for i in c.indexes()].count("hash") == 2
    auto = Collection.open(spark, str(tmp_path / "auto"), auto_compact_files=2)
    for i in range(4):
        auto.insert({"n": i})
    assert auto.count() == 4 and len(auto.store.load().files) <= 3


def test_changes_rewrite_only_files_that_hold_the_rows(c):
    c.insert({"n": 1})
    c.insert({"n": 2})
    files = c.store.load().files
    c.update(2, {"n": 3})
    assert files[0] in c.store.load().files and files[1] not in c.store.load().files


def test_watch(c, tmp_path):
    seen = []

    def listen():
        watch(c, "n", lambda v, ids: seen.append((v, [r[0] for r in ids.collect()])), str(tmp_path / "w"), once=True).awaitTermination()

    c.insert_all([{"n": 1}, {"m": 2}])
    listen()
    listen()
    c.delete(1)
    listen()
    assert seen == [(1, [1]), (2, [])]


def test_any_field_name_is_legal(c):
    assert c.query().where("nope").equals(1).find() == [] and c.query().where("a b`c").is_null().sort_by("x.y").find_ids() == []
    c.insert_all([{"a b`c": 1, "x.y": 2}, {"x.y": "two"}])
    assert c.query().where("a b`c").equals(1).find_ids() == [1] and c.query().where("x.y").equals("two").find_ids() == [2]
    assert c.sum_where(None, "nope") == 0 and c.sum_where(None, "x.y") == 2 and c.min_where(None, "nope") is None
    assert c.update_where(lambda q: q.where("nope").is_null(), {"x.y": 9}) == 2 and c.query().where("x.y").equals(9).count() == 2
    assert c.delete_where(lambda q: q.where("nope").equals(1)) == 0


def test_an_update_may_widen_its_own_field(c):
    c.insert_all([{"n": 3}, {"n": 8}, {"n": 9}])
    assert c.update_where(lambda q: q.where("n").greater_than(5), {"n": "high"}) == 2
    assert c.query().where("n").equals("high").find_ids() == [2, 3] and c.query().where("n").less_than(5).find_ids() == [1]
    assert c.update_where(lambda q: q.where("n").equals("high").limit(1), {"n": 1.5}) == 1 and c.query().where("n").less_than(2).find_ids() == [2]
    assert c.delete_where(lambda q: q.sort_by("n").skip(1).limit(1)) == 1 and c.query().find_ids() == [2, 3]


def test_put_a_dataframe(spark, c):
    c.insert_all(spark.range(100).select(F.col("id").alias("n")))
    c.put_all(spark.createDataFrame([(5, "five"), (500, "new")], "_id long, n string"))
    assert c.count() == 101 == c.df().count() and c.query().where("n").equals("five").find_ids() == [5] and c.insert({"n": 1}) == 501
    for bad in ([(5, 1), (5, 2)], [(None, 1)], [(0, 1)]):
        with pytest.raises(ValueError):
            c.put_all(spark.createDataFrame(bad, "_id long, n long"))
    before = len(c.store.versions())
    c.put_all(spark.createDataFrame([], "_id long, n long"))
    assert len(c.store.versions()) == before


def test_encryption_behind_the_opener(spark, tmp_path):
    key, path = b"k" * 32, str(tmp_path / "secret")
    c = Collection.open(spark, path, encryption_key=key, fts_indexes=["name"])
    at = dt.datetime(2024, 1, 2, 3, 4, 5, 678901)
    c.insert({"name": "Alice Hidden", "at": at, "raw": b"\x00\xff", "mixed": 1, "big": 2**62 + 1, "f": 1e-300})
    c.insert({"mixed": "text", "tags": ["a"], "user": {"city": "Y"}})
    c.insert_all(spark.createDataFrame([("Hidden Bob",)], "name string"))
    c.update_where(lambda q: q.where("mixed").equals("text"), {"name": "Carol Hidden"})
    c.compact()
    for p in (tmp_path / "secret" / "data").rglob("*"):
        assert not p.is_file() or b"Hidden" not in p.read_bytes()
    again = Collection.open(spark, path, encryption_key=key)
    one = again.find_by_id(1)
    assert (one["name"], one["at"], bytes(one["raw"]), one["big"], one["f"]) == ("Alice Hidden", at, b"\x00\xff", 2**62 + 1, 1e-300)
    assert again.query().where("name").fts("hidden").find_ids() == [1, 2, 3] and again.query().where("mixed").equals(1).find_ids() == [1]
    assert again.find_by_id(2)["tags"] == ["a"] and again.find_by_id(2)["user"] == {"city": "Y"}
    with pytest.raises(Exception, match="(?i)aes|crypto"):
        Collection.open(spark, path, encryption_key=b"x" * 32).df().collect()


def test_keys_open_few_files(spark, c):
    for i in range(4):
        c.insert({"n": i})
    m = c.store.load()
    assert m.holding(2, 2) == (m.files[1],) and m.live == 4
    assert c.find_by_id(2)["n"] == 1 and not c.exists(9) and c.range_search(2, 3) == [2, 3]
    c.update(2, {"n": 7})
    c.compact(files=1)
    m = c.store.load()
    assert m.keys == {m.files[0]: (1, 4)} and (m.live, m.dead) == (4, 0) and c.find_by_id(2)["n"] == 7


def test_compaction_by_the_share_of_deleted_documents(spark, tmp_path):
    for share, gone, kind in ((0.5, 6, "compact"), (0.9, 2, "delete")):
        c = Collection.open(spark, str(tmp_path / str(gone)), auto_compact_share=share)
        c.insert_all([{"n": n} for n in range(10)])
        assert c.delete_where(lambda q: q.where("n").less_than(gone)) == gone  # noqa: B023
        assert c.count() == 10 - gone == c.df().count() and c.store.load().kinds == (kind,)


def test_transact_starts_again(spark, c):
    c.insert({"n": 1})
    calls = []

    def work(t):
        calls.append(1)
        if len(calls) == 1:
            Collection(spark, t.store.path).insert({"n": 2})
        return t.insert({"n": 3})

    assert c.transact(work) == 3 and len(calls) == 2 and c.count() == 3


def test_vacuum_spares_young_data(spark, c):
    c.insert({"n": 1})
    c.store.write(spark.createDataFrame([(5, 1)], "_id long, n long"))  # of a writer that has not published yet
    c.compact(vacuum=True)
    folders = lambda: len(c.store._fs.listStatus(c.store._at("data")))
    assert folders() == 3
    c.compact(vacuum=True, grace=0)
    assert folders() == 1 and c.count() == 1


def test_json_files(spark, c, tmp_path):
    (tmp_path / "x.json").write_text('{"a": 1, "b": {"c": [1, 2]}}\n{"a": 2.5}\n')
    assert c.import_json(str(tmp_path / "x.json")) == range(1, 3)
    assert c.query().where("b.c").is_not_null().find_ids() == [1] and c.sum_where(None, "a") == 3.5
    c.export_json(str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 2


def test_cache_follows_versions(c):
    c.insert_all([{"n": 1}, {"n": 2}])
    c.cache()
    assert "InMemoryTableScan" in c.query().where("n").equals(2).explain(plan=True) and c.query().where("n").equals(2).find_ids() == [2]
    other = Collection(c.spark, c.store.path)
    other.insert({"n": 2})  # of another writer: what is held is of an earlier version
    assert c.query().where("n").equals(2).find_ids() == [2, 3]
    c.cache()
    c.delete(2)
    assert "InMemoryTableScan" not in c.query().explain(plan=True) and c.query().where("n").equals(2).find_ids() == [3]
