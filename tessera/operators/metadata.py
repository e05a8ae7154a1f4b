"""One metadata block per document: a sentence and a JSON record from what is known of it."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import text

#: The record's fields in order.
FIELDS = (
    "block_id", "block_type", "doc_id", "namespace_id", "filename", "mime_type", "file_size_bytes", "upload_time", "page_count", "chunk_count", "parent_count", "child_count", "parser", "parser_version",
    "enricher", "enricher_version", "chunker", "chunker_version", "processing_time_ms", "source_uri", "lang", "parse_status", "parse_failed_page", "tags", "ingestion_status", "custom_metadata",
)


def iso_utc(ms: Column) -> Column:
    return F.when(ms > 0, F.date_format(F.timestamp_millis(ms), "yyyy-MM-dd'T'HH:mm:ss'Z'"))


def block_text(docs: DataFrame) -> Column:
    """The sentence: clauses of what is there, in a fixed order, parted by commas."""
    has = set(docs.columns)
    some = lambda c: F.when(F.col(c) != "", F.col(c)) if c in has else F.lit(None).cast("string")
    count = lambda c, what: F.when(F.col(c) > 0, F.concat(F.col(c).cast("string"), F.lit(f" {what}"))) if c in has else F.lit(None).cast("string")
    upload = F.concat(iso_utc(F.col("upload_ms")), F.lit(" uploaded")) if "upload_ms" in has else F.lit(None).cast("string")
    tags = F.when(F.size("tags") > 0, F.concat(F.lit("tags: "), F.array_join("tags", " / "))) if "tags" in has else F.lit(None).cast("string")
    parser = F.concat(F.lit("parser: "), some("parser"))
    return F.concat_ws(", ", some("filename"), F.concat(some("mime_type"), F.lit(" document")), count("page_count", "pages"), count("chunk_count", "chunks"), upload, some("lang"), parser, tags)


def metadata_json(docs: DataFrame) -> Column:
    """The record with all its fields; what isn't known is null."""
    has = set(docs.columns)
    known = {c: F.col(c) for c in FIELDS if c in has}
    known["block_type"] = F.lit("metadata")
    status = F.coalesce(known.get("parse_status", F.lit(None)), F.lit("ok"))
    known["parse_status"] = status
    known["ingestion_status"] = F.when(status == "failed", "failed").otherwise("completed")
    if "page_count" in known:
        known["page_count"] = F.when(F.col("page_count") >= 0, F.col("page_count"))
    if "upload_ms" in has:
        known["upload_time"] = iso_utc(F.col("upload_ms"))
    return F.to_json(F.struct(*(known.get(c, F.lit(None).cast("string")).alias(c) for c in FIELDS)), {"ignoreNullFields": "false"})


def metadata_blocks(docs: DataFrame, also: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, ``also``, block_text, metadata_json, doc_title, topics, missing (fields that were expected)."""
    missing = F.array_compact(F.array(F.when(F.col("page_count") < 0, "page_count"))) if "page_count" in docs.columns else F.array(F.lit("page_count"))
    topics = F.array_join("tags", " ") if "tags" in docs.columns else F.lit("")
    return docs.select("doc_id", *also, block_text(docs).alias("block_text"), metadata_json(docs).alias("metadata_json"), text.title_of(F.col("filename")).alias("doc_title"), topics.alias("topics"), missing.alias("missing"))


MOST_DEPTH = 16


def _flat(value: object, prefix: str, depth: int) -> dict[str, str]:
    out: dict[str, str] = {}
    if isinstance(value, dict) and depth < MOST_DEPTH:
        for k, v in value.items():
            out |= _flat(v, f"{prefix}.{k}" if prefix else k, depth + 1)
    elif prefix and value is not None:
        out[prefix] = value if isinstance(value, str) else json.dumps(value, separators=(",", ":"), ensure_ascii=False)
    return out


def flat_json(column: Column) -> Column:
    """An object's members as a string map, inner names joined by dots; anything but an object is an empty map.

    Objects deeper than ``MOST_DEPTH`` stay as JSON, as arrays do; nulls are left out.
    """

    @F.pandas_udf("map<string,string>")
    def run(raw: pd.Series) -> pd.Series:
        return pd.Series([_flat(v, "", 0) if isinstance(v := _parsed(x), dict) else {} for x in raw])

    return run(column)


def json_set(column: Column, path: str, value: Column) -> Column:
    """The JSON object with the member at a dotted path set to a string; what isn't an object becomes one."""
    names = path.split(".")

    @F.pandas_udf("string")
    def run(raw: pd.Series, new: pd.Series) -> pd.Series:
        out = []
        for x, v in zip(raw, new, strict=True):
            top = found if isinstance(found := _parsed(x), dict) else {}
            at = top
            for n in names[:-1]:
                at[n] = at[n] if isinstance(at.get(n), dict) else {}
                at = at[n]
            at[names[-1]] = v
            out.append(json.dumps(top, separators=(",", ":"), ensure_ascii=False))
        return pd.Series(out)

    return run(column, value)


def _parsed(raw: str | None) -> object:
    try:
        return json.loads(raw) if raw else None
    except ValueError:
        return None
