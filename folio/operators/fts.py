"""Full-text predicates over token sets, and the inverted table that answers them without reading texts."""

from __future__ import annotations

import re
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_WORD = r"[^\w]+"
LEAST = 2


def tokens(c: Column) -> Column:
    """Lower-case runs of ASCII letters, digits and underscores, of two characters or more."""
    return F.regexp_extract_all(F.lower(c), F.lit(rf"\w{{{LEAST},}}"), F.lit(0))


def has_tokens(c: Column) -> Column:
    return F.lower(c).rlike(rf"\w{{{LEAST}}}")


def query_tokens(text: str) -> list[str]:
    return list(dict.fromkeys(t for t in re.split(_WORD, text.lower(), flags=re.ASCII) if len(t) >= LEAST))


def _each(text: str, test) -> Column:
    wanted = query_tokens(text)
    return reduce(and_, [test(t) for t in wanted]) if wanted else F.lit(False)


def matches(c: Column, text: str) -> Column:
    """Every token of the query is a token of the text; a query without tokens finds nothing."""
    low = F.lower(c)
    # the substring search leaves few texts to the slower search for word bounds
    return _each(text, lambda t: low.contains(t) & low.rlike(rf"(?<!\w){t}(?!\w)"))


def prefix_matches(c: Column, text: str) -> Column:
    """Every token of the query starts some token; ``*`` is allowed and has no meaning of its own."""
    low = F.lower(c)
    return _each(text, lambda t: low.contains(t) & low.rlike(rf"(?<!\w){t}"))


def search_prefix(c: Column, text: str) -> Column:
    """prefix_matches, but that a query without tokens finds every text that has any."""
    return prefix_matches(c, text) if query_tokens(text) else has_tokens(c)


def part_matches(c: Column, text: str) -> Column:
    """Every token of the query is part of some token; one that is in the text lies in a token of it."""
    low = F.lower(c)
    return _each(text, low.contains)


def postings(df: DataFrame, field: str, key: str = "_id") -> DataFrame:
    """One row (token, key) for each distinct token of each row."""
    return df.select(F.col(key), F.explode(F.array_distinct(tokens(F.col(field)))).alias("token")).select("token", key)


def posting_keys(table: DataFrame, text: str, key: str = "_id") -> DataFrame:
    """Keys of the rows that have every token of the query, from an inverted table."""
    wanted = query_tokens(text)
    if not wanted:
        return table.select(key).limit(0)
    hits = table.where(F.col("token").isin(wanted))
    if len(wanted) == 1:
        return hits.select(key)
    return hits.groupBy(key).agg(F.count("*").alias("n")).where(F.col("n") == len(wanted)).select(key)


def stats(df: DataFrame, field: str) -> DataFrame:
    """terms, documents and postings of a field's inverted table, in one pass."""
    found = df.select(F.posexplode(F.array_distinct(tokens(F.col(field)))).alias("at", "t"))
    return found.agg(F.countDistinct("t").alias("terms"), F.count_if(F.col("at") == 0).alias("documents"), F.count(F.lit(1)).alias("postings"))
