"""Filters: a JSON filter language, a guard for user SQL, request checks and post-filters."""

from __future__ import annotations

import json
import re
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import text

# Fixed values -------------------------------------------------------------------------
OPERATORS = ("eq", "ne", "gt", "gte", "lt", "lte", "in", "between", "like", "is_null")
DENIED = frozenset({
    "INSERT", "UPDATE", "DELETE", "DROP", "EXEC", "EXECUTE", "CREATE", "ALTER", "TRUNCATE", "GRANT", "REVOKE", "COPY", "VACUUM", "MERGE", "CALL",
    "UNION", "INTERSECT", "EXCEPT", "INFORMATION_SCHEMA", "PG_CATALOG", "PG_AUTHID", "PG_SHADOW", "PG_ROLES", "PG_USER", "PG_USER_MAPPINGS", "PG_SLEEP",
})
FORBIDDEN_PARTS = ("--", "/*", "*/", ";", "#")
MOST_SQL = 10_000
# ---------------------------------------------------------------------------------------


class FilterError(ValueError):
    """A request that is refused before anything runs."""


def _scalar(value: Any) -> bool:
    return value is None or isinstance(value, (str, int, float, bool))


def validate(request: Any, fields: set[str] | None = None) -> dict[str, dict[str, Any]]:
    """The filter as a dict, or FilterError. ``None`` filters nothing."""
    if request is None:
        return {}
    if isinstance(request, str):
        try:
            request = json.loads(request)
        except ValueError as e:
            raise FilterError("the filter isn't JSON") from e
    if not isinstance(request, dict):
        raise FilterError("the filter isn't an object")
    for name, clause in request.items():
        own = re.fullmatch(r"metadata\.[A-Za-z_]\w*", name)
        if not own and not re.fullmatch(r"[A-Za-z_]\w*", name):
            raise FilterError(f"not a field name: {name}")
        if not own and fields and name not in fields:
            raise FilterError(f"no such field: {name}")
        if not isinstance(clause, dict) or not clause:
            raise FilterError(f"{name} needs an object of operators")
        for op, value in clause.items():
            shape = {"in": isinstance(value, list) and value and all(map(_scalar, value)), "between": isinstance(value, list) and len(value) == 2 and all(map(_scalar, value)), "is_null": isinstance(value, bool)}
            if op not in OPERATORS:
                raise FilterError(f"no such operator: {op}")
            if not shape.get(op, _scalar(value)):
                raise FilterError(f"{op} doesn't take {value!r}")
    return request


def _bound(value: Any) -> str | None:
    return "true" if value is True else "false" if value is False else None if value is None else str(value)


def condition(request: Any, df: DataFrame, metadata: str = "metadata_json") -> Column:
    """The filter as one column that Catalyst can push down.

    Values are bound as text and take the field's type; metadata values compare as text.
    """
    clauses = []
    types = dict(df.dtypes)
    for name, clause in validate(request, set(df.columns)).items():
        own = name.startswith("metadata.")
        field = F.get_json_object(metadata, f"$.{name[9:]}") if own else F.col(name)
        lit = lambda v, own=own, name=name: F.lit(_bound(v)) if own else F.lit(_bound(v)).cast(types[name])
        for op, value in clause.items():
            clauses.append({
                "eq": lambda f, v: f == lit(v), "ne": lambda f, v: f != lit(v), "gt": lambda f, v: f > lit(v), "gte": lambda f, v: f >= lit(v),
                "lt": lambda f, v: f < lit(v), "lte": lambda f, v: f <= lit(v), "in": lambda f, v: f.isin(*[lit(x) for x in v]),
                "between": lambda f, v: f.between(lit(v[0]), lit(v[1])), "like": lambda f, v: f.cast("string").like(_bound(v)), "is_null": lambda f, v: f.isNull() if v else f.isNotNull(),
            }[op](field, value))
    return reduce(lambda a, b: a & b, clauses, F.lit(True))


def filtered(df: DataFrame, request: Any, select: list[str] | None = None, metadata: str = "metadata_json") -> DataFrame:
    """Rows that pass the filter, all columns or the listed ones."""
    if select and (unknown := [c for c in select if c not in df.columns]):
        raise FilterError(f"no such field: {', '.join(unknown)}")
    rows = df.filter(condition(request, df, metadata))
    return rows.select(*select) if select else rows


def check_sql(sql: str) -> str:
    """The statement if it is one plain SELECT, else FilterError."""
    if not sql or len(sql) > MOST_SQL:
        raise FilterError("empty or too long")
    if any(p in sql for p in FORBIDDEN_PARTS):
        raise FilterError("comments and statement separators aren't allowed")
    words = [w.upper() for w in re.findall(r"[A-Za-z_]\w*", sql)]
    if not words or words[0] != "SELECT" or not sql.lstrip()[:6].upper() == "SELECT":
        raise FilterError("only SELECT is allowed")
    if denied := sorted(DENIED.intersection(words)):
        raise FilterError(f"not allowed: {', '.join(denied)}")
    return sql


def run_sql(spark: SparkSession, sql: str) -> DataFrame:
    return spark.sql(check_sql(sql))


def import_rows(spark: SparkSession, request: dict[str, Any]) -> DataFrame:
    """Rows of a registered table by filter, or of a guarded statement: exactly one of the two."""
    if ("table" in request) == ("sql" in request):
        raise FilterError("give either a table or a statement")
    if "sql" in request:
        return run_sql(spark, request["sql"])
    return filtered(spark.table(request["table"]), request.get("filter"), request.get("select"), request.get("metadata", "metadata_json"))


def check_request(query: str, namespaces: list[str], top_k: int = 10, timeout_ms: int = 5000) -> str:
    """The query cut to 2000 bytes of whole characters, if all else is in range."""
    if any(not re.fullmatch(r"[A-Za-z0-9_-]{1,64}", n) and n != "*" for n in namespaces):
        raise FilterError("a namespace name is malformed")
    if not 1 <= top_k <= 100 or not 100 <= timeout_ms <= 30_000:
        raise FilterError("top_k or timeout_ms is out of range")
    return query.encode()[:2000].decode("utf-8", "ignore")


def post_filter(hits: DataFrame, *, types: list[int] | None = None, not_types: list[int] | None = None, path_glob: str | None = None, created_after: str | None = None, doc_id: int | None = None) -> DataFrame:
    """Hits of documents that aren't deleted and pass every given test."""
    tests = [F.coalesce(F.col("status"), F.lit("")) != "deleted"] if "status" in hits.columns else []
    if types:
        tests.append(F.col("block_type").isin(*types))
    if not_types:
        tests.append(~F.col("block_type").isin(*not_types))
    if path_glob:
        tests.append(text.glob_match(F.col("source_path"), path_glob))
    if created_after:
        tests.append(F.col("created_at") >= created_after)
    if doc_id is not None:
        tests.append(F.col("doc_id") == doc_id)
    return hits.filter(reduce(lambda a, b: a & b, tests, F.lit(True)))


def document_blocks(blocks: DataFrame, doc_id: int, top_k: int) -> DataFrame:
    """All non-empty blocks of one document in chunk order with score 1: no retrieval."""
    rows = blocks.filter((F.col("doc_id") == doc_id) & (F.length("content_text") > 0))
    return rows.withColumn("score", F.lit(1.0)).orderBy("chunk_index").limit(top_k)


def metadata_overlay(document: Column, block: Column) -> Column:
    """Document metadata with the block's on top, as a string map."""
    as_map = lambda c: F.coalesce(F.from_json(c, "map<string,string>"), F.create_map().cast("map<string,string>"))
    own = as_map(block)
    return F.map_concat(F.map_filter(as_map(document), lambda k, _: ~F.map_contains_key(own, k)), own)


def importable(files: DataFrame, ignore: list[str], extensions: list[str]) -> DataFrame:
    """Files worth importing: no dot or backup file, no ignored pattern, a listed extension if any are."""
    name = F.lower(F.element_at(F.split("path", "/"), -1))
    ext = F.regexp_extract(name, r"\.([^.]+)$", 1)
    bad = name.startswith(".") | name.endswith("~")
    for pattern in ignore:
        bad = bad | name.rlike(text.wildcard_regex(pattern.lower()))
    return files.filter(~bad & ext.isin(*[e.lower().lstrip(".") for e in extensions]) if extensions else ~bad)


def contains_text(rows: DataFrame, column: str, needle: str, order_col: str, limit: int = 20, tie: str = "id") -> DataFrame:
    """Case-insensitive substring search, newest first; ``%`` and ``_`` are plain characters."""
    hit = F.contains(F.lower(F.col(column)), F.lower(F.lit(needle)))
    return rows.filter(hit).orderBy(F.desc(order_col), tie).limit(max(1, min(100, limit)))


def mine(rows: DataFrame, user_id: str, session_id: str | None = None, metadata: str = "metadata_json") -> DataFrame:
    """Rows whose metadata names this user, and this session if one is given."""
    test = F.get_json_object(metadata, "$.user_id") == user_id
    if session_id is not None:
        test = test & (F.get_json_object(metadata, "$.session_id") == session_id)
    return rows.filter(F.coalesce(test, F.lit(False)))


def expired(queried_at: Column, ttl_seconds: Column, now_s: int) -> Column:
    """A positive lifetime that has run out; an unreadable time never expires."""
    at = F.unix_timestamp(F.try_to_timestamp(queried_at))
    return F.coalesce((ttl_seconds > 0) & (F.lit(now_s) > at + ttl_seconds), F.lit(False))


def readable(resources: DataFrame, grants: DataFrame, tenant_id: str, user_id: str, write: bool = False) -> DataFrame:
    """Resources that a user may read (owned, granted or public), or write (owned, or granted as editor or admin)."""
    roles = ["EDITOR", "ADMIN"] if write else ["VIEWER", "EDITOR", "ADMIN"]
    by = (F.col("subject") == F.lit(f"user:{user_id}")) | (F.col("subject") == F.lit(f"tenant:{tenant_id}"))
    granted = grants.filter(by & F.col("role").isin(*roles)).select("namespace_id").distinct().withColumn("granted", F.lit(True))
    allowed = (F.col("owner_tenant") == tenant_id) | F.coalesce("granted", F.lit(False))
    if not write:
        allowed = allowed | F.coalesce("is_public", F.lit(False))
    return resources.join(granted, "namespace_id", "left").filter(allowed).drop("granted")


def page(rows: DataFrame, offset: int, limit: int, *order: Column, most: int = 200) -> tuple[DataFrame, int, bool]:
    """(rows of the page, total, has_next); an offset past the end is an error unless it is 0."""
    total, limit = rows.count(), max(1, min(most, limit))
    if offset and offset >= total:
        raise FilterError(f"offset {offset} is past the {total} rows")
    return rows.orderBy(*order).offset(offset).limit(limit), total, offset + limit < total


def paired_sample(relevant: DataFrame, docs: DataFrame, negatives: int, seed: int) -> DataFrame:
    """query_id, doc_id, relevant: every query's relevant documents and a seeded sample of others.

    ``relevant`` (query_id, doc_id). The sample is the ``negatives`` documents of the smallest
    seeded hashes, the same for every query but for its own relevant ones.
    """
    seeded = F.md5(F.concat(F.lit(f"{seed}:"), F.col("doc_id").cast("string")))
    some = docs.select("doc_id").distinct().orderBy(seeded, "doc_id").limit(max(0, negatives))
    pairs = relevant.select("query_id").distinct().crossJoin(F.broadcast(some))  # ``negatives`` rows
    good = relevant.select("query_id", "doc_id").distinct()
    return good.withColumn("relevant", F.lit(True)).unionByName(pairs.join(good, ["query_id", "doc_id"], "left_anti").withColumn("relevant", F.lit(False)))


def newest(rows: DataFrame, by: str, n: int, *order: Column) -> DataFrame:
    at = Window.partitionBy(by).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(at)).filter(F.col("_n") <= n).drop("_n")
