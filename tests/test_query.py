"""The query builder against literal results and a brute-force evaluator."""

import json
import random
import re

import pytest
from pyspark.sql import functions as F

from folio.operators import aggregates
from folio.plans.query import Postings, Query

PEOPLE = [(1, "Alice", "London", 30), (2, "Bob", "Paris", 25), (3, "Charlie", "London", 35), (4, "Diana", "Tokyo", 22)]


@pytest.fixture(scope="module")
def people(spark):
    return Query(spark.createDataFrame(PEOPLE, "_id long, name string, city string, age long").cache())


def test_people(people):
    assert people.where("city").equals("London").count() == 2
    assert people.where("city").equals("London").or_().where("city").equals("Paris").count() == 3
    assert people.where("city").is_in(["London", "Tokyo"]).count() == 3
    assert people.where("city").not_().equals("London").count() == 2
    assert people.where("city").always_true().count() == 4
    assert people.where("age").between(25, 32).count() == 2
    assert people.where("age").greater_than(29).count() == 2
    assert people.range_search(2, 3).find_ids() == [2, 3]
    assert people.where("name").starts_with("Ch").find_first()["_id"] == 3
    assert people.where("name").equals("nobody").find_first() is None


def test_order_and_pages(people):
    assert people.sort_by("age").find_ids() == [4, 2, 1, 3]
    assert people.sort_by("city", descending=True).find_ids() == [4, 2, 3, 1]
    assert people.sort_by("age").limit(2).skip(1).find_ids() == [2, 1]
    assert people.limit(0).find_ids() == []
    assert people.where("city").equals("London").limit(1).count() == 1
    assert [r["name"] for r in people.sort_by("age").select("name").find()] == ["Diana", "Bob", "Alice", "Charlie"]
    assert people.where("city").equals("none").sort_by("age").find_ids() == []
    assert {r["_id"] for r in people.where("city").equals("London").find_stream()} == {1, 3}


def test_immutable(people):
    base = people.where("city").equals("London")
    base.where("age").greater_than(100)
    assert base.count() == 2


def test_explain(people):
    text = people.where("city").not_().equals("London").or_().where("age").between(1, 2).sort_by("age", True).skip(3).limit(4).explain()
    for part in ("not equals city", "OR group 1", "between age 1 2", "sort age desc", "skip 3", "limit 4", "[scan]"):
        assert part in text
    assert "Filter" in people.where("age").equals(1).explain(plan=True)


def test_pushdown(spark, tmp_path, people):
    people.source.write.parquet(str(tmp_path / "p"))
    plan = Query(spark.read.parquet(str(tmp_path / "p"))).where("city").is_in(["London", "Paris"]).and_("name").starts_with("A").select("_id").explain(plan=True)
    assert "PushedFilters: [IsNotNull(name), In(city, [London,Paris]), StringStartsWith(name,A)]" in plan or ("In(city" in plan and "StringStartsWith(name,A)" in plan)
    assert "age" not in plan.split("ReadSchema")[1].split("\n")[0]


def _tokens(text):
    return {t for t in re.split(r"[^\w]+", text.lower(), flags=re.ASCII) if len(t) >= 2}


def _holds(verb, value, args):
    if verb == "is_null":
        return value is None
    if value is None:
        return False
    a = args[0] if args else None
    return {
        "equals": lambda: a is not None and value == a,
        "between": lambda: args[0] <= value <= args[1],
        "greater_than": lambda: value > a,
        "greater_or_equal_to": lambda: value >= a,
        "less_than": lambda: value < a,
        "less_than_or_equal_to": lambda: value <= a,
        "contains": lambda: a != "" and a in value,
        "starts_with": lambda: value.startswith(a),
        "is_in": lambda: value in [x for x in a if x is not None],
        "is_not_null": lambda: True,
        "always_true": lambda: True,
        "fts": lambda: bool(_tokens(a)) and _tokens(a) <= _tokens(value),
        "fts_prefix": lambda: bool(_tokens(a)) and all(any(t.startswith(w) for t in _tokens(value)) for w in _tokens(a)),
        "fts_contains": lambda: bool(_tokens(a)) and all(any(w in t for t in _tokens(value)) for w in _tokens(a)),
    }[verb]()


def _expected(rows, groups):
    live = [g for g in groups if g]
    out = []
    for row in rows:
        def one(c):
            field, verb, args, neg = c
            value = row[field]
            hit = _holds(verb, value, args)
            if not neg or verb in ("is_null", "is_not_null", "always_true"):
                return hit
            known = value is not None and (not verb.startswith("fts") or bool(_tokens(value)))
            return known and not hit

        if not live or any(all(one(c) for c in g) for g in live):
            out.append(row["_id"])
    return out


def test_random_queries(spark):
    rng = random.Random(5)
    words = ["red", "blue", "a", "Gear x", "gear", "", "é blue", "ring_1 red"]
    rows = [{"_id": i, "n": rng.choice([None, 0, 1, 2, 3, 4]), "s": rng.choice([None, *words]) if rng.random() < 0.5 else " ".join(rng.choices(words, k=3))} for i in range(1, 60)]
    source = spark.createDataFrame([(r["_id"], r["n"], r["s"]) for r in rows], "_id long, n long, s string").cache()
    for _ in range(40):
        groups, query = [[]], Query(source)
        for _ in range(rng.randint(0, 4)):
            if rng.random() < 0.3:
                groups.append([])
                query = query.or_()
                continue
            if rng.random() < 0.5:
                field, verb = "n", rng.choice(["equals", "between", "greater_than", "greater_or_equal_to", "less_than", "less_than_or_equal_to", "is_in", "is_null", "is_not_null", "always_true"])
                value = lambda: rng.randint(-1, 5)
            else:
                field, verb = "s", rng.choice(["equals", "contains", "starts_with", "is_in", "fts", "fts_prefix", "fts_contains", "is_null"])
                value = lambda: rng.choice(["red", "g", "", "Gear red", "a", "blu"])
            args = () if verb in ("is_null", "is_not_null", "always_true") else (value(), value()) if verb == "between" else ([value(), None, value()][: rng.randint(0, 3)],) if verb == "is_in" else (value(),)
            if verb == "equals" and rng.random() < 0.1:
                args = (None,)
            neg = rng.random() < 0.4
            groups[-1].append((field, verb, args, neg))
            f = query.where(field)
            query = getattr(f.not_() if neg else f, verb)(*args)
        assert query.find_ids() == _expected(rows, groups), groups


def test_random_queries_over_mixed_types(spark):
    """Fields whose documents disagree on the type, and literals of any type: Python compares within a family only."""
    rng = random.Random(11)
    family = lambda v: "n" if isinstance(v, int | float) and not isinstance(v, bool) else type(v).__name__
    values = [None, 0, 1, 2.5, -3, 10**15 + 1, True, False, "1", "true", "red", "", "Gear x"]
    rows = [{"_id": i, "m": rng.choice(values), "n": rng.choice([None, 1, 2, 3])} for i in range(1, 80)]
    text = spark.createDataFrame([(r["_id"], json.dumps(r["m"]), r["n"]) for r in rows], "_id long, m string, n long")
    source = text.withColumn("m", F.parse_json("m")).cache()

    def holds(value, verb, args):
        if verb == "is_null":
            return value is None
        same = [a for a in args if family(a) == family(value)]
        if value is None or (verb not in ("is_in", "always_true") and len(same) < len(args)):
            return False
        if verb in ("contains", "starts_with", "fts") and not isinstance(value, str):
            return False
        if verb == "is_in":
            return any(family(a) == family(value) and a == value for a in args[0])
        return _holds(verb, value, args)

    for _ in range(120):
        field, verb = rng.choice(["m", "m", "n", "nope", "m.x"]), rng.choice(["equals", "between", "greater_than", "less_than_or_equal_to", "is_in", "is_null", "always_true", "contains", "starts_with", "fts"])
        args = () if verb in ("is_null", "always_true") else ([rng.choice(values) for _ in range(3)],) if verb == "is_in" else tuple(rng.choice(values[1:]) for _ in range(2 if verb == "between" else 1))
        neg = rng.random() < 0.4
        get = lambda r: r.get(field)  # noqa: B023, E731
        want = []
        for r in rows:
            v, hit = get(r), holds(get(r), verb, args)
            known = v is not None and (verb != "fts" or (isinstance(v, str) and bool(_tokens(v))))
            want += [r["_id"]] * (hit if not neg or verb in ("is_null", "always_true") else known and not hit)
        f = Query(source).where(field)
        assert getattr(f.not_() if neg else f, verb)(*args).find_ids() == want, (field, verb, args, neg)

    order = {"n": 0, "str": 1, "bool": 2}
    ranked = sorted((r for r in rows if r["m"] is not None), key=lambda r: (order[family(r["m"])], r["m"], r["_id"]))
    nulls = [r["_id"] for r in rows if r["m"] is None]
    assert Query(source).sort_by("m").find_ids() == [r["_id"] for r in ranked] + nulls
    assert Query(source).sort_by("nope", descending=True).limit(2).find_ids() == [79, 78]
    numbers = [r["m"] for r in rows if family(r["m"]) == "n"]
    assert aggregates.total(source, "m").first()[0] == pytest.approx(sum(numbers)) and aggregates.average(source, "nope").first()[0] is None
    assert aggregates.cardinality(source, "m").first()[0] == len({json.dumps(r["m"]) for r in rows if r["m"] is not None})
    assert aggregates.least(source, "m").first()[0].toPython() == min(numbers) and aggregates.greatest(source, "m").first()[0].toPython() is True
    assert aggregates.greatest(source, "nope").first()[0] is None and aggregates.grouped(source, "nope").count() == 0
    assert {r["field"]: (r["rows"], r["nulls"]) for r in aggregates.statistics(source, ["m", "nope"]).collect()} == {"m": (79, len(nulls)), "nope": (79, 79)}


def test_names_with_dots_and_paths(spark):
    df = spark.createDataFrame([(1, 5, {"b": 7}), (2, 6, {"b": 8})], "_id long, `a.b` long, a struct<b: long>").withColumn("v", F.to_variant_object(F.struct(F.col("_id").alias("k"))))
    assert Query(df).where("a.b").equals(5).find_ids() == [1]
    assert Query(df.drop("a.b")).where("a.b").equals(8).find_ids() == [2]
    assert Query(df).where("v.k").greater_than(1).or_().where("v.nope.x").always_true().find_ids() == [2]
    assert [r["a.b"] for r in Query(df).sort_by("a.b", True).select("a.b").find()] == [6, 5]


def test_postings_answer_alike(spark):
    from folio.operators import fts

    df = spark.createDataFrame([(1, "Hello world from London"), (2, "Paris is beautiful"), (3, "London has big ben"), (4, None), (5, "")], "_id long, text string")
    table = fts.postings(df, "text")
    for text, want in {"london": [1, 3], "london big": [3], "LONDON": [1, 3], "": [], "nonexistent": [], "l": []}.items():
        assert Query(df).where("text").fts(text).find_ids() == want
        held = {"text": Postings(table, df)}
        assert Query(df, postings=held).where("text").fts(text).find_ids() == want
        half = {"text": Postings(table, df.where("_id > 2"), df.where("_id <= 2"))}
        assert Query(df, postings=half).where("text").fts(text).find_ids() == want
        assert Query(df, postings=held).where("_id").greater_than(1).and_("text").fts(text).find_ids() == [i for i in want if i > 1]
    short = spark.createDataFrame([(1, "I am here"), (2, "You are there")], "_id long, text string")
    assert Query(short).where("text").fts("am").find_ids() == [1]
    assert [tuple(r) for r in fts.stats(df, "text").collect()] == [(10, 3, 11)]
