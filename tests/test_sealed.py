"""Encrypted documents: a round trip, nonces, wrong keys."""

import pytest

from folio.functions.sealed import seal, unseal

KEY = b"0123456789abcdef"
SCHEMA = "name string, age long, tags array<string>"


def test_round_trip(spark):
    rows = [(1, "Alice", 30, ["a", "b"]), (2, None, None, None), (3, "", 0, []), (4, "é🌍", -1, ["x"])]
    df = spark.createDataFrame(rows, "_id long, " + SCHEMA)
    hidden = seal(df, KEY)
    assert hidden.columns == ["_id", "sealed"]
    assert sorted(map(tuple, unseal(hidden, KEY, SCHEMA).collect()), key=repr) == sorted(rows, key=repr)


def test_equal_rows_differ_when_sealed(spark):
    df = spark.createDataFrame([(1, "x"), (2, "x")], "_id long, name string")
    assert len({bytes(r.sealed) for r in seal(df, KEY).collect()}) == 2


def test_wrong_key(spark):
    hidden = seal(spark.createDataFrame([(1, "x")], "_id long, name string"), KEY)
    with pytest.raises(Exception, match="(?i)aes|crypto"):
        unseal(hidden, KEY[::-1], "name string").collect()
    with pytest.raises(ValueError):
        seal(hidden, b"short")
