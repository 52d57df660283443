"""The registered queries of the engine, each with the SQL that gives the same rows."""

from __future__ import annotations

import datetime as dt
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from folio.operators import aggregates, fts
from folio.plans import layout
from folio.plans.query import Query
from folio.sources.collection import Collection

Tables = Callable[[str], DataFrame]
_BUILT: dict[str, tuple[Callable[[Tables], DataFrame], str | None]] = {}

#: documents with their labels, null where there are none: the table for everything about nulls
_DL = "(SELECT d.doc_id, d.lang, d.n_chars, l.quality, l.toxic FROM documents d LEFT JOIN labels l USING (doc_id))"
#: the tokens of a text
_TOK = "list_distinct(list_filter(regexp_split_to_array(lower({c}), '[^\\w]+'), lambda x: length(x) >= 2))"


def labelled(t: Tables) -> DataFrame:
    return t("documents").join(t("labels"), "doc_id", "left").select("doc_id", "lang", "n_chars", "quality", "toxic")


def add(name: str, build: Callable[[Tables], DataFrame], sql: str | None) -> None:
    assert name not in _BUILT
    _BUILT[name] = (build, sql)


def q(df: DataFrame, key: str) -> Query:
    return Query(df, key=key)


def rows(name: str, table: str, key: str, build: Callable[[Query], Query], where: str) -> None:
    """A query that filters one table."""
    if table == "DL":
        add(name, lambda t: build(q(labelled(t), key)).df(), f"SELECT * FROM {_DL} WHERE {where}")
    else:
        add(name, lambda t: build(q(t(table), key)).df(), f"SELECT * FROM {table} WHERE {where}")


# scans
add("full_scan", lambda t: q(t("orders"), "o_orderkey").df(), "SELECT * FROM orders")
add("scan_ids", lambda t: q(t("orders"), "o_orderkey").ids(), "SELECT o_orderkey FROM orders")
rows("pk_get", "orders", "o_orderkey", lambda x: x.where("o_orderkey").equals(42), "o_orderkey = 42")
rows("pk_range", "orders", "o_orderkey", lambda x: x.range_search(100, 200), "o_orderkey BETWEEN 100 AND 200")
add("exists", lambda t: t("orders").where("o_orderkey = 42").limit(1).agg((F.count("*") > 0).alias("found")), "SELECT count(*) > 0 AS found FROM orders WHERE o_orderkey = 42")
add("row_count", lambda t: aggregates.count(t("lineitem")), "SELECT count(*) AS count FROM lineitem")
add(
    "find_by_ids",
    lambda t: t("orders").join(t("orders").sparkSession.createDataFrame([(1,), (7,), (7,), (99,), (10**12,)], "o_orderkey long").distinct(), "o_orderkey", "left_semi"),
    "SELECT * FROM orders WHERE o_orderkey IN (1, 7, 99, 1000000000000)",
)
add("projection", lambda t: q(t("customer"), "c_custkey").where("c_mktsegment").equals("BUILDING").select("c_custkey", "c_name").df(), "SELECT c_custkey, c_name FROM customer WHERE c_mktsegment = 'BUILDING'")

# equality and ranges
rows("eq_str", "customer", "c_custkey", lambda x: x.where("c_mktsegment").equals("BUILDING"), "c_mktsegment = 'BUILDING'")
rows("eq_int", "DL", "doc_id", lambda x: x.where("quality").equals(1), "quality = 1")
rows("not_eq", "DL", "doc_id", lambda x: x.where("quality").not_().equals(1), "quality IS NOT NULL AND quality <> 1")
rows("eq_null", "DL", "doc_id", lambda x: x.where("quality").equals(None), "false")
rows("not_eq_null", "DL", "doc_id", lambda x: x.where("quality").not_().equals(None), "quality IS NOT NULL")
rows("between", "lineitem", "l_orderkey", lambda x: x.where("l_quantity").between(10, 12), "l_quantity BETWEEN 10 AND 12")
rows("between_inverted", "lineitem", "l_orderkey", lambda x: x.where("l_quantity").between(12, 10), "false")
rows("not_between", "DL", "doc_id", lambda x: x.where("quality").not_().between(1, 5), "quality IS NOT NULL AND NOT quality BETWEEN 1 AND 5")
rows("gt", "lineitem", "l_orderkey", lambda x: x.where("l_quantity").greater_than(49), "l_quantity > 49")
rows("gte", "lineitem", "l_orderkey", lambda x: x.where("l_quantity").greater_or_equal_to(49), "l_quantity >= 49")
rows("lt", "DL", "doc_id", lambda x: x.where("quality").less_than(1), "quality < 1")
rows("lte", "lineitem", "l_orderkey", lambda x: x.where("l_quantity").less_than_or_equal_to(2), "l_quantity <= 2")
rows("not_gt", "DL", "doc_id", lambda x: x.where("toxic").not_().greater_than(0), "toxic IS NOT NULL AND NOT toxic > 0")
rows(
    "date_range", "orders", "o_orderkey", lambda x: x.where("o_orderdate").between(dt.datetime(1995, 1, 1), dt.datetime(1995, 6, 30)),
    "o_orderdate BETWEEN TIMESTAMP '1995-01-01' AND TIMESTAMP '1995-06-30'",
)

# fields that are nowhere, literals of another type, fields of mixed types
rows("missing_field_eq", "orders", "o_orderkey", lambda x: x.where("nope").equals(1), "false")
rows("missing_not_eq", "orders", "o_orderkey", lambda x: x.where("nope").not_().equals(1), "false")
rows("missing_is_null", "nation", "n_nationkey", lambda x: x.where("nope").is_null().and_("n.ope").is_null(), "true")
rows("eq_wrong_type", "orders", "o_orderkey", lambda x: x.where("o_orderkey").equals("42").or_().where("o_orderpriority").greater_than(3), "false")
rows("not_eq_wrong_type", "nation", "n_nationkey", lambda x: x.where("n_nationkey").not_().equals("3"), "true")
rows("contains_non_string", "orders", "o_orderkey", lambda x: x.where("o_orderkey").contains("1").or_().where("o_totalprice").starts_with("1").or_().where("o_orderkey").fts("10"), "false")
rows("search_prefix_all", "nation", "n_nationkey", lambda x: x.where("n_name").search_prefix(""), "regexp_matches(lower(n_name), '[a-z0-9_]{2}')")


def mixed(t: Tables) -> DataFrame:
    """m holds a number in one document of four, a string in the next, then a boolean, then nothing."""
    value = F.when(F.col("doc_id") % 4 == 0, F.to_json(F.struct(F.col("n_chars").alias("v")))).when(F.col("doc_id") % 4 == 1, F.to_json(F.struct(F.col("lang").alias("v")))).when(F.col("doc_id") % 4 == 2, F.lit('{"v":true}'))
    return t("documents").select("doc_id", "n_chars", F.try_variant_get(F.parse_json(value), "$.v", "variant").alias("m"))


def _mixed(name: str, build: Callable[[Query], Query], where: str) -> None:
    add(name, lambda t: build(q(mixed(t), "doc_id")).select("doc_id").df(), f"SELECT doc_id FROM documents WHERE {where}")


_mixed("mixed_eq", lambda x: x.where("m").equals("en").or_().where("m").equals(True).or_().where("m").equals(120), "(doc_id % 4 = 1 AND lang = 'en') OR doc_id % 4 = 2 OR (doc_id % 4 = 0 AND n_chars = 120)")
_mixed("mixed_not_eq", lambda x: x.where("m").not_().equals("en"), "doc_id % 4 <> 3 AND NOT (doc_id % 4 = 1 AND lang = 'en')")
_mixed("mixed_range", lambda x: x.where("m").between(200, 900.5).or_().where("m").greater_than("es"), "(doc_id % 4 = 0 AND n_chars BETWEEN 200 AND 900.5) OR (doc_id % 4 = 1 AND lang > 'es')")
_mixed("mixed_strings", lambda x: x.where("m").contains("e").or_().where("m").starts_with("1"), "doc_id % 4 = 1 AND contains(lang, 'e')")
_mixed("mixed_in", lambda x: x.where("m").is_in(["de", True, 300, None]), "(doc_id % 4 = 1 AND lang = 'de') OR doc_id % 4 = 2 OR (doc_id % 4 = 0 AND n_chars = 300)")
_mixed("mixed_is_null", lambda x: x.where("m").is_null(), "doc_id % 4 = 3")
add("mixed_sum", lambda t: aggregates.total(mixed(t), "m").select(F.col("sum").cast("double").alias("sum")), "SELECT sum(n_chars)::DOUBLE AS sum FROM documents WHERE doc_id % 4 = 0")
add("missing_sum", lambda t: aggregates.total(t("orders"), "nope").select(F.col("sum").cast("double").alias("sum")), "SELECT 0::DOUBLE AS sum")
add("json_path", lambda t: q(t("events").select("event_id", F.parse_json("props").alias("props")), "event_id").where("props.k").between(10, 20).and_("props.x").is_null().ids(), "SELECT event_id FROM events WHERE (props::JSON ->> '$.k')::BIGINT BETWEEN 10 AND 20")

# strings and lists
rows("contains", "part", "p_partkey", lambda x: x.where("p_name").contains("ol"), "contains(p_name, 'ol')")
rows("contains_ignore_case", "part", "p_partkey", lambda x: x.where("p_name").contains("GE", ignore_case=True), "contains(lower(p_name), 'ge')")
rows("contains_empty", "part", "p_partkey", lambda x: x.where("p_name").contains(""), "false")
rows("not_contains", "orders", "o_orderkey", lambda x: x.where("o_orderpriority").not_().contains("URGENT"), "NOT contains(o_orderpriority, 'URGENT')")
rows("prefix", "orders", "o_orderkey", lambda x: x.where("o_orderpriority").starts_with("1-"), "starts_with(o_orderpriority, '1-')")
rows("prefix_empty", "DL", "doc_id", lambda x: x.where("lang").starts_with(""), "lang IS NOT NULL")
rows("not_prefix", "orders", "o_orderkey", lambda x: x.where("o_orderpriority").not_().starts_with("1-"), "NOT starts_with(o_orderpriority, '1-')")
rows("in_list", "nation", "n_nationkey", lambda x: x.where("n_regionkey").is_in([1, 3, 3]), "n_regionkey IN (1, 3)")
rows("in_empty", "nation", "n_nationkey", lambda x: x.where("n_regionkey").is_in([]), "false")
rows("in_with_null", "DL", "doc_id", lambda x: x.where("quality").is_in([1, None]), "quality = 1")
rows("not_in", "nation", "n_nationkey", lambda x: x.where("n_regionkey").not_().is_in([1, 3]), "n_regionkey NOT IN (1, 3)")
rows("not_in_with_null", "DL", "doc_id", lambda x: x.where("quality").not_().is_in([1, None]), "quality IS NOT NULL AND quality <> 1")
rows("is_null", "DL", "doc_id", lambda x: x.where("quality").is_null(), "quality IS NULL")
rows("is_not_null", "DL", "doc_id", lambda x: x.where("quality").is_not_null(), "quality IS NOT NULL")
rows("always_true", "DL", "doc_id", lambda x: x.where("quality").not_().always_true(), "quality IS NOT NULL")

# combinations
rows("or_groups", "orders", "o_orderkey", lambda x: x.where("o_orderstatus").equals("F").or_().where("o_totalprice").greater_than(400000), "o_orderstatus = 'F' OR o_totalprice > 400000")
rows(
    "dnf_mixed", "events", "event_id",
    lambda x: x.where("event_type").equals("click").and_("value").greater_than(50).or_().where("user_id").between(1, 20).and_("event_type").not_().equals("view"),
    "(event_type = 'click' AND value > 50) OR (user_id BETWEEN 1 AND 20 AND event_type <> 'view')",
)
rows("double_not", "orders", "o_orderkey", lambda x: x.where("o_orderstatus").not_().not_().equals("F"), "o_orderstatus = 'F'")
rows("trailing_or", "orders", "o_orderkey", lambda x: x.or_().where("o_orderstatus").equals("P").or_(), "o_orderstatus = 'P'")
add("empty_groups", lambda t: q(t("nation"), "n_nationkey").or_().or_().df(), "SELECT * FROM nation")
rows("composite_eq2", "lineitem", "l_orderkey", lambda x: x.where("l_returnflag").equals("R").and_("l_linestatus").equals("F"), "l_returnflag = 'R' AND l_linestatus = 'F'")
rows(
    "composite_eq3", "lineitem", "l_orderkey", lambda x: x.where("l_returnflag").equals("R").and_("l_linestatus").equals("F").and_("l_linenumber").equals(1),
    "l_returnflag = 'R' AND l_linestatus = 'F' AND l_linenumber = 1",
)
rows(
    "custom_predicate", "customer", "c_custkey", lambda x: Query(x.source.where(F.length("c_name") % 2 == 0), key="c_custkey").where("c_acctbal").greater_than(0),
    "length(c_name) % 2 = 0 AND c_acctbal > 0",
)

# order and pages
_TOP = "o_orderstatus = 'F' AND o_totalprice BETWEEN 1000 AND 50000"
add("topk", lambda t: q(t("orders"), "o_orderkey").where("o_orderstatus").equals("F").and_("o_totalprice").between(1000, 50000).sort_by("o_totalprice", descending=True).limit(10).df(), f"SELECT * FROM orders WHERE {_TOP} ORDER BY o_totalprice DESC, o_orderkey DESC LIMIT 10")
add("sort_asc", lambda t: q(t("orders"), "o_orderkey").sort_by("o_orderpriority").limit(50).df(), "SELECT * FROM orders ORDER BY o_orderpriority, o_orderkey LIMIT 50")
add("sort_desc_ties", lambda t: q(t("orders"), "o_orderkey").sort_by("o_orderpriority", descending=True).limit(50).df(), "SELECT * FROM orders ORDER BY o_orderpriority DESC, o_orderkey DESC LIMIT 50")
add("sort_nulls_last", lambda t: q(labelled(t), "doc_id").sort_by("quality").skip(350).limit(100).df(), f"SELECT * FROM {_DL} ORDER BY quality ASC NULLS LAST, doc_id LIMIT 100 OFFSET 350")
add("sort_desc_nulls_last", lambda t: q(labelled(t), "doc_id").sort_by("quality", descending=True).skip(350).limit(100).df(), f"SELECT * FROM {_DL} ORDER BY quality DESC NULLS LAST, doc_id DESC LIMIT 100 OFFSET 350")
add("skip_limit", lambda t: q(t("orders"), "o_orderkey").limit(20).skip(30).df(), "SELECT * FROM orders ORDER BY o_orderkey LIMIT 20 OFFSET 30")
add("find_first", lambda t: q(t("orders"), "o_orderkey").where("o_orderstatus").equals("P").sort_by("o_totalprice").limit(1).df(), "SELECT * FROM orders WHERE o_orderstatus = 'P' ORDER BY o_totalprice, o_orderkey LIMIT 1")
add("limit_zero", lambda t: q(t("orders"), "o_orderkey").limit(0).df(), "SELECT * FROM orders LIMIT 0")
add("filter_none_sorted", lambda t: q(t("orders"), "o_orderkey").where("o_orderstatus").equals("none").sort_by("o_totalprice").df(), "SELECT * FROM orders WHERE false")
add("sort_only", lambda t: q(labelled(t), "doc_id").where("quality").always_true().sort_by("quality").limit(40).df(), f"SELECT * FROM {_DL} WHERE quality IS NOT NULL ORDER BY quality, doc_id LIMIT 40")



# whole sorts: every row with its position
def ranked(x: Query) -> DataFrame:
    """All rows of a sorted query and ``rank``, their position from 1. No task holds more than its range of the order."""
    df = x.df()
    spark, path = df.sparkSession, scratch(df.sparkSession)
    df.withColumn("__at", F.monotonically_increasing_id()).write.parquet(path)
    kept = spark.read.parquet(path).withColumn("__part", F.shiftright("__at", 33))
    firsts, at = [], 1
    for r in kept.groupBy("__part").count().orderBy("__part").collect():
        firsts.append((r["__part"], at))
        at += r["count"]
    known = F.broadcast(spark.createDataFrame(firsts, "__part long, __first long"))
    return kept.join(known, "__part").withColumn("rank", F.col("__first") + F.col("__at").bitwiseAND((1 << 33) - 1)).drop("__part", "__at", "__first")


def _whole(name: str, build: Callable[[Tables], Query], source: str, order: str, columns: str = "*") -> None:
    add(name, lambda t: ranked(build(t)), f"SELECT {columns}, row_number() OVER (ORDER BY {order}) AS rank FROM {source}")


_whole("sort_asc_all", lambda t: q(t("orders"), "o_orderkey").sort_by("o_orderpriority"), "orders", "o_orderpriority, o_orderkey")
_whole("sort_desc_ties_all", lambda t: q(t("orders"), "o_orderkey").sort_by("o_orderpriority", descending=True), "orders", "o_orderpriority DESC, o_orderkey DESC")
_whole("sort_nulls_last_all", lambda t: q(labelled(t), "doc_id").sort_by("quality"), _DL, "quality ASC NULLS LAST, doc_id")
_whole("sort_desc_nulls_last_all", lambda t: q(labelled(t), "doc_id").sort_by("quality", descending=True), _DL, "quality DESC NULLS LAST, doc_id DESC")
_whole("sort_only_all", lambda t: q(labelled(t), "doc_id").where("quality").always_true().sort_by("quality"), f"{_DL} WHERE quality IS NOT NULL", "quality, doc_id")

_whole("missing_sort", lambda t: q(t("orders"), "o_orderkey").sort_by("nope"), "orders", "o_orderkey")
_whole("mixed_sort", lambda t: q(mixed(t), "doc_id").sort_by("m").select("doc_id"), "documents", "CASE doc_id % 4 WHEN 3 THEN NULL ELSE doc_id % 4 END NULLS LAST, CASE doc_id % 4 WHEN 0 THEN n_chars END, CASE doc_id % 4 WHEN 1 THEN lang END, doc_id", "doc_id")

# aggregates
add("group_having", lambda t: aggregates.rolled(t("lineitem"), ["l_returnflag", "l_linestatus"], {"n": ("count", "l_linenumber"), "total": ("sum", "l_linenumber")}, having="n > 100"), "SELECT l_returnflag, l_linestatus, count(l_linenumber) AS n, sum(l_linenumber)::BIGINT AS total FROM lineitem GROUP BY ALL HAVING count(l_linenumber) > 100")
add("group_rollup", lambda t: aggregates.rolled(t("lineitem"), ["l_returnflag", "l_linestatus"], {"top": ("max", "l_quantity")}, how="rollup"), "SELECT l_returnflag, l_linestatus, max(l_quantity) AS top FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
add("group_cube", lambda t: aggregates.rolled(t("orders"), ["o_orderstatus", "o_orderpriority"], {"low": ("min", "o_totalprice")}, how="cube"), "SELECT o_orderstatus, o_orderpriority, min(o_totalprice) AS low FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")
add("count_where", lambda t: aggregates.count(q(t("orders"), "o_orderkey").where("o_orderstatus").equals("F").df()), "SELECT count(*) AS count FROM orders WHERE o_orderstatus = 'F'")
add("count_paginated", lambda t: aggregates.count(q(t("orders"), "o_orderkey").where("o_orderstatus").equals("F").skip(5).limit(7).df()), "SELECT count(*) AS count FROM (SELECT 1 FROM orders WHERE o_orderstatus = 'F' LIMIT 7 OFFSET 5)")
add("sum_where", lambda t: aggregates.total(q(t("lineitem"), "l_orderkey").where("l_returnflag").equals("R").df(), "l_quantity"), "SELECT sum(l_quantity) AS sum FROM lineitem WHERE l_returnflag = 'R'")
add("sum_int", lambda t: aggregates.total(t("lineitem"), "l_linenumber"), "SELECT sum(l_linenumber)::BIGINT AS sum FROM lineitem")
add("sum_empty_zero", lambda t: aggregates.total(q(t("lineitem"), "l_orderkey").where("l_returnflag").equals("X").df(), "l_linenumber"), "SELECT 0::BIGINT AS sum")
add("avg_where", lambda t: aggregates.average(q(t("lineitem"), "l_orderkey").where("l_returnflag").equals("R").df(), "l_quantity"), "SELECT avg(l_quantity) AS avg FROM lineitem WHERE l_returnflag = 'R'")
add("avg_empty_null", lambda t: aggregates.average(q(t("lineitem"), "l_orderkey").where("l_returnflag").equals("X").df(), "l_quantity"), "SELECT avg(l_quantity) AS avg FROM lineitem WHERE l_returnflag = 'X'")
add("avg_not_numeric", lambda t: aggregates.average(t("customer"), "c_name"), "SELECT NULL::DOUBLE AS avg")
add("min_str", lambda t: aggregates.least(t("part"), "p_name"), "SELECT min(p_name) AS min FROM part")
add("max_str", lambda t: aggregates.greatest(t("part"), "p_name"), "SELECT max(p_name) AS max FROM part")
add("min_ts", lambda t: aggregates.least(q(t("orders"), "o_orderkey").where("o_orderstatus").equals("F").df(), "o_orderdate"), "SELECT min(o_orderdate) AS min FROM orders WHERE o_orderstatus = 'F'")
add("max_ts", lambda t: aggregates.greatest(t("orders"), "o_orderdate"), "SELECT max(o_orderdate) AS max FROM orders")
add("distinct_values", lambda t: aggregates.cardinality(labelled(t), "quality"), f"SELECT count(DISTINCT quality) AS distinct FROM {_DL}")
add("grouped_ids", lambda t: aggregates.grouped(labelled(t), "quality", "doc_id").select("quality", F.array_join("ids", ",").alias("ids")), f"SELECT quality, string_agg(doc_id::VARCHAR, ',' ORDER BY doc_id) AS ids FROM {_DL} WHERE quality IS NOT NULL GROUP BY quality")
add("duplicates", lambda t: aggregates.duplicates(t("documents"), "text"), "SELECT text, count(*) AS count FROM documents WHERE text IS NOT NULL GROUP BY text HAVING count(*) > 1")
add("describe", lambda t: layout.describe(labelled(t), ["lang", "quality", "toxic"]), " UNION ALL ".join(f"SELECT '{f}' AS field, count(*) AS rows, count(*) - count({f}) AS nulls, count(DISTINCT {f}) AS distinct FROM {_DL}" for f in ("lang", "quality", "toxic")))

# full text
_D = _TOK.format(c="text")


def _fts(name: str, verb: str, text: str, where: str, negate: bool = False) -> None:
    def build(t: Tables) -> DataFrame:
        f = q(t("documents"), "doc_id").where("text")
        return getattr(f.not_() if negate else f, verb)(text).ids()

    add(name, build, f"SELECT doc_id FROM (SELECT doc_id, {_D} AS t FROM documents) WHERE {where}")


_fts("fts_one", "fts", "the", "list_contains(t, 'the')")
_fts("fts_and", "fts", "the with", "list_has_all(t, ['the', 'with'])")
_fts("fts_case", "fts", "THE, With!", "list_has_all(t, ['the', 'with'])")
_fts("fts_short", "fts", "a", "false")
_fts("fts_empty", "fts", "", "false")
_fts("fts_star", "fts", "the*", "list_contains(t, 'the')")
_fts("fts_not", "fts", "the", "len(t) > 0 AND NOT list_contains(t, 'the')", negate=True)
_fts("fts_prefix", "fts_prefix", "thon* wh", "len(list_filter(t, lambda x: starts_with(x, 'thon'))) > 0 AND len(list_filter(t, lambda x: starts_with(x, 'wh'))) > 0")
_fts("fts_contains", "fts_contains", "inthe", "len(list_filter(t, lambda x: contains(x, 'inthe'))) > 0")
add("fts_posting_lookup", lambda t: fts.posting_keys(fts.postings(t("documents"), "text", "doc_id"), "the with", "doc_id"), f"SELECT doc_id FROM documents WHERE list_has_all({_D}, ['the', 'with'])")
add("fts_posting_stats", lambda t: fts.stats(t("documents"), "text"), f"SELECT (SELECT count(DISTINCT x) FROM (SELECT unnest({_D}) AS x FROM documents)) AS terms, count(*) AS documents, sum(len(t))::BIGINT AS postings FROM (SELECT {_D} AS t FROM documents) WHERE len(t) > 0")
add("fts_names", lambda t: q(t("part"), "p_partkey").where("p_name").fts("Gear red").ids(), f"SELECT p_partkey FROM part WHERE list_has_all({_TOK.format(c='p_name')}, ['red', 'gear'])")
add("json_field_filter", lambda t: t("events").where(F.try_variant_get(F.try_parse_json("props"), "$.k", "long") > 50).select("event_id"), "SELECT event_id FROM events WHERE (props::JSON ->> '$.k')::BIGINT > 50")


# changes, on copies of tables in a folder of their own
def scratch(spark: SparkSession) -> str:
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = tempfile.gettempdir()
    return f"{base.rstrip('/')}/folio/collection-{uuid.uuid4().hex}"


def stored(t: Tables, name: str, order: str, **options) -> Collection:
    df = t(name)
    c = Collection.open(df.sparkSession, scratch(df.sparkSession), **options)
    c.insert_all(df.orderBy(order))
    return c


def _changed(name: str, table: str, order: str, step: Callable[[Collection], DataFrame | None], sql: str, **options) -> None:
    def build(t: Tables) -> DataFrame:
        c = stored(t, table, order, **options)
        found = step(c)
        return c.df() if found is None else found

    add(name, build, sql)


_CUST = "c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment"
_IDS = f"SELECT row_number() OVER (ORDER BY c_custkey) AS _id, {_CUST} FROM customer"
_changed("insert_all", "customer", "c_custkey", lambda c: None, _IDS)


def _put(c: Collection) -> None:
    c.put_all({3: {"c_custkey": -3, "c_name": "put"}, 10**6: {"c_custkey": -4, "c_name": "new"}})


_changed("put_upsert", "customer", "c_custkey", _put, f"SELECT * FROM ({_IDS}) WHERE _id <> 3 UNION ALL SELECT 3, -3, 'put', NULL, NULL, NULL UNION ALL SELECT 1000000, -4, 'new', NULL, NULL, NULL")


def _merge(c: Collection) -> None:
    c.update(5, {"c_name": "merged", "vip": True})


_changed("update_merge", "customer", "c_custkey", _merge, f"SELECT _id, c_custkey, CASE WHEN _id = 5 THEN 'merged' ELSE c_name END AS c_name, c_nationkey, c_acctbal, c_mktsegment, CASE WHEN _id = 5 THEN true END AS vip FROM ({_IDS})")


def _put_df(c: Collection) -> None:
    new = c.df().where("c_mktsegment = 'BUILDING'").withColumn("c_name", F.upper("c_name"))
    c.put_all(new.unionByName(c.df().where("_id = 1").withColumn("_id", F.lit(5_000_000))).drop("c_acctbal"))


_changed("put_df", "customer", "c_custkey", _put_df, f"SELECT _id, c_custkey, CASE WHEN c_mktsegment = 'BUILDING' THEN upper(c_name) ELSE c_name END AS c_name, c_nationkey, CASE WHEN c_mktsegment <> 'BUILDING' THEN c_acctbal END AS c_acctbal, c_mktsegment FROM ({_IDS}) UNION ALL SELECT 5000000, c_custkey, c_name, c_nationkey, NULL, c_mktsegment FROM ({_IDS}) WHERE _id = 1")


def _widened(c: Collection) -> DataFrame:
    c.update_where(lambda x: x.where("c_nationkey").greater_than(5), {"c_nationkey": "high"})
    return c.query().select("_id").df().join(c.df().select("_id", F.try_variant_get("c_nationkey", "$", "string").alias("nation")), "_id")


_changed("update_widens", "customer", "c_custkey", _widened, f"SELECT _id, CASE WHEN c_nationkey > 5 THEN 'high' ELSE c_nationkey::VARCHAR END AS nation FROM ({_IDS})")


def _first_deleted(c: Collection) -> None:
    c.delete_where(lambda x: x.where("c_mktsegment").equals("BUILDING").sort_by("c_acctbal").limit(7))


_changed("delete_page", "customer", "c_custkey", _first_deleted, f"SELECT * FROM ({_IDS}) WHERE _id NOT IN (SELECT _id FROM ({_IDS}) WHERE c_mktsegment = 'BUILDING' ORDER BY c_acctbal, _id LIMIT 7)")


def _singles(c: Collection) -> None:
    with c.batch():
        c.insert({"c_custkey": -1, "c_name": "one"})
        c.delete(2)
        c.delete(10**9)


_changed("insert_delete_one", "customer", "c_custkey", _singles, f"SELECT * FROM ({_IDS}) WHERE _id <> 2 UNION ALL SELECT (SELECT count(*) + 1 FROM customer), -1, 'one', NULL, NULL, NULL")


def _sealed(c: Collection) -> None:
    c.update_where(lambda x: x.where("c_mktsegment").equals("BUILDING"), {"c_name": "sealed"})
    c.compact()


_changed("sealed_round_trip", "customer", "c_custkey", _sealed, f"SELECT _id, c_custkey, CASE WHEN c_mktsegment = 'BUILDING' THEN 'sealed' ELSE c_name END AS c_name, c_nationkey, c_acctbal, c_mktsegment FROM ({_IDS})", encryption_key=b"0123456789abcdef")


def _autocompact(c: Collection) -> DataFrame:
    c.delete_where(lambda x: x.where("c_custkey").greater_than(10))
    m = c.store.load()
    return c.df().select("_id").withColumn("kind", F.lit(m.kinds[0])).withColumn("dead", F.lit(m.dead).cast("long"))


_changed("autocompact", "customer", "c_custkey", _autocompact, f"SELECT _id, 'compact' AS kind, 0::BIGINT AS dead FROM ({_IDS}) WHERE c_custkey <= 10", auto_compact_share=0.5)


def _streamed(c: Collection) -> DataFrame:
    found = [(r["_id"], r["c_name"]) for r in c.find_stream(lambda x: x.where("c_mktsegment").equals("BUILDING"))]
    return c.spark.createDataFrame(found, "_id long, c_name string")


_changed("find_stream", "customer", "c_custkey", _streamed, f"SELECT _id, c_name FROM ({_IDS}) WHERE c_mktsegment = 'BUILDING'")


def _json_copy(c: Collection) -> DataFrame:
    path = scratch(c.spark)
    c.export_json(path)
    other = Collection.open(c.spark, scratch(c.spark))
    other.import_json(path)
    return other.df().drop("_id")


_changed("json_copy", "customer", "c_custkey", _json_copy, f"SELECT {_CUST} FROM customer")


def _update_where(c: Collection) -> None:
    c.update_where(lambda x: x.where("c_mktsegment").equals("BUILDING"), {"c_nationkey": 99})


_changed("update_where", "customer", "c_custkey", _update_where, f"SELECT _id, c_custkey, c_name, CASE WHEN c_mktsegment = 'BUILDING' THEN 99 ELSE c_nationkey END AS c_nationkey, c_acctbal, c_mktsegment FROM ({_IDS})")


def _delete_where(c: Collection) -> None:
    c.delete_where(lambda x: x.where("c_acctbal").less_than(0))


_changed("delete_where", "customer", "c_custkey", _delete_where, f"SELECT * FROM ({_IDS}) WHERE NOT coalesce(c_acctbal < 0, false)")


def _rollback(c: Collection) -> None:
    try:
        with c.transaction():
            c.delete_where(lambda x: x.where("c_custkey").greater_than(10))
            raise RuntimeError("undo")
    except RuntimeError:
        pass


_changed("tx_rollback", "customer", "c_custkey", _rollback, _IDS)


def _commit(c: Collection) -> None:
    with c.transaction():
        c.delete_where(lambda x: x.where("c_custkey").greater_than(10))
        c.update_where(lambda x: x.where("c_custkey").equals(1), {"c_name": "first"})


_changed("tx_commit", "customer", "c_custkey", _commit, f"SELECT _id, c_custkey, CASE WHEN c_custkey = 1 THEN 'first' ELSE c_name END AS c_name, c_nationkey, c_acctbal, c_mktsegment FROM ({_IDS}) WHERE c_custkey <= 10")


def _migrate(c: Collection) -> DataFrame:
    steps = {1: lambda df: df.withColumn("role", F.lit("user")), 2: lambda df: df.withColumn("c_nationkey", F.col("c_nationkey") * 2)}
    return Collection.open(c.spark, c.store.path, version=3, migrations=steps).df()


_changed("migrate_chain", "customer", "c_custkey", _migrate, f"SELECT _id, c_custkey, c_name, c_nationkey * 2 AS c_nationkey, c_acctbal, c_mktsegment, 'user' AS role FROM ({_IDS})")
_changed("compact_identity", "customer", "c_custkey", lambda c: c.compact(files=2, vacuum=True), _IDS, sorted_indexes=["c_acctbal"])


def _indexed_text(c: Collection) -> DataFrame:
    c.reindex()
    return c.query().where("text").fts("the with").select("doc_id").df()


_changed("fts_posting_index", "documents", "doc_id", _indexed_text, f"SELECT doc_id FROM documents WHERE list_has_all({_D}, ['the', 'with'])", fts_indexes=["text"])


def _watch(c: Collection) -> DataFrame:
    from folio.streaming.watch import watch

    seen: list[DataFrame] = []
    watch(c, "user_id", lambda _, ids: seen.append(ids), f"{c.store.path}/watch", once=True).awaitTermination()
    return seen[-1]


def _late_text(c: Collection) -> DataFrame:
    c.reindex()
    c.delete_where(lambda x: x.where("doc_id").less_than(20))
    c.insert({"doc_id": -1, "text": "with the late one"})
    return c.query().where("text").fts("the with").select("doc_id").df()


_changed("fts_posting_late", "documents", "doc_id", _late_text, f"SELECT doc_id FROM documents WHERE doc_id >= 20 AND list_has_all({_D}, ['the', 'with']) UNION ALL SELECT -1", fts_indexes=["text"])
_changed("watch_snapshot", "events", "event_id", _watch, "SELECT row_number() OVER (ORDER BY event_id) AS _id FROM events WHERE user_id IS NOT NULL")


#: schemas by path: a table is opened without a job once it is known
_SCHEMAS: dict[str, StructType] = {}


def table(spark: SparkSession, path: str) -> DataFrame:
    if path not in _SCHEMAS:
        _SCHEMAS[path] = spark.read.parquet(path).schema
    return spark.read.schema(_SCHEMAS[path]).parquet(path)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def bound(build: Callable[[Tables], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        return lambda spark, sf_dir: build(lambda name: table(spark, f"{sf_dir}/{name}.parquet"))

    return {name: bound(build) for name, (build, _) in _BUILT.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _BUILT.items() if sql is not None}
