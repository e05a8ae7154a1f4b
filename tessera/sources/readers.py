"""Sources: lookups and scans, files by format, directories, tables, snapshots and logs."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.operators.ordering import numbered
from tessera.runtime import spread

# Fixed values -------------------------------------------------------------------------
MIME_TYPES = {
    "pdf": "application/pdf", "docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document", "doc": "application/msword",
    "xlsx": "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet", "xls": "application/vnd.ms-excel", "pptx": "application/vnd.openxmlformats-officedocument.presentationml.presentation",
    "md": "text/markdown", "markdown": "text/markdown", "txt": "text/plain", "csv": "text/csv", "html": "text/html", "htm": "text/html", "json": "application/json", "xml": "application/xml",
    "png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "tiff": "image/tiff", "tif": "image/tiff", "bmp": "image/bmp", "tmp": "application/x-temp", "bak": "application/x-temp",
    "exe": "application/x-executable", "dll": "application/x-executable", "so": "application/x-executable", "ttf": "font/ttf", "otf": "font/ttf", "woff": "font/ttf",
}
FILE_BLOCK, SCAN_BLOCK, FULL_LEVEL, SKIP_LEVEL = 1, 2, 3, 0
SKIPPED = ("application/x-temp", "application/x-executable", "font/ttf")
# ---------------------------------------------------------------------------------------


def documents_by(docs: DataFrame, **equal: object) -> DataFrame:
    """Point and status lookups: equality on columns, pushed down to the scan."""
    for column, value in equal.items():
        docs = docs.filter(F.col(column) == value)
    return docs


def by_ids(rows: DataFrame, ids: DataFrame, key: str = "doc_id") -> DataFrame:
    """Point lookups of a whole table of ids: rows whose key is among them, each once."""
    return rows.join(ids.select(key).distinct(), key, "left_semi")


def by_content_hash(stored: DataFrame, wanted: DataFrame) -> DataFrame:
    """content_hash, doc_id: the first document of each wanted hash, by the hashes as stored."""
    hit = stored.join(wanted.select("content_hash").distinct(), "content_hash", "left_semi")
    return hit.groupBy("content_hash").agg(F.min("doc_id").alias("doc_id"))


def with_block_counts(docs: DataFrame, blocks: DataFrame) -> DataFrame:
    """Documents with n_blocks: the stored count, or the true one where 0 is stored."""
    true = block_counts(blocks)
    return docs.join(true, "doc_id", "left").withColumn("n_blocks", F.when(F.col("stored") == 0, F.coalesce("n_blocks", F.lit(0))).otherwise(F.col("stored")).cast("long"))


def watcher_statistics(files: DataFrame) -> DataFrame:
    """Files seen, imported and skipped of every watched directory, and of all (``overall`` 1)."""
    some = lambda state: F.sum(F.when(F.col("state") == state, 1).otherwise(0))
    return files.rollup("directory").agg(F.count("*").alias("total"), some("imported").alias("imported"), some("skipped").alias("skipped"), F.grouping("directory").cast("int").alias("overall"))


def blocks_of(blocks: DataFrame, doc_id: int) -> DataFrame:
    return blocks.filter(F.col("doc_id") == doc_id).orderBy("chunk_index")


def deleted_before(docs: DataFrame, cutoff_ms: int) -> DataFrame:
    return docs.filter((F.col("status") == "deleted") & (F.col("deleted_at") <= cutoff_ms))


def block_counts(blocks: DataFrame) -> DataFrame:
    return blocks.groupBy("doc_id").agg(F.count("*").alias("n_blocks"))


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))


def with_format(files: DataFrame, path: str = "path") -> DataFrame:
    """Adds ext, mime, block_type and level: images are scans, temporary files, programs and fonts are skipped."""
    dim = files.sparkSession.createDataFrame(list(MIME_TYPES.items()), "ext string, mime string")
    joined = files.withColumn("ext", extension(F.col(path))).join(F.broadcast(dim), "ext", "left")  # len(MIME_TYPES) rows
    mime = F.coalesce("mime", F.lit("application/octet-stream"))
    block = F.when(mime.startswith("image/"), SCAN_BLOCK).otherwise(FILE_BLOCK)
    return joined.withColumns({"mime": mime, "block_type": block, "level": F.when(mime.isin(*SKIPPED), SKIP_LEVEL).otherwise(FULL_LEVEL)})


def needs_ocr(mime: Column, has_text: Column) -> Column:
    return mime.startswith("image/") | ((mime == "application/pdf") & ~has_text)


def scan_directory(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """path, modified, size, content of all files below a folder whose name matches."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder)
    return files.select("path", F.col("modificationTime").alias("modified"), F.col("length").alias("size"), "content")


def watch_directory(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """The same as a stream: each new file once."""
    return spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("pathGlobFilter", pattern).load(folder)


def html_text(source: str | None) -> str:
    """Visible text of a page, one line per block element."""
    body = re.sub(r"(?is)<(script|style|head|noscript)\b.*?</\1\s*>", " ", source or "")
    body = re.sub(r"(?s)<!--.*?-->", " ", body)
    body = re.sub(r"(?i)<(br|/?(p|div|li|ul|ol|h[1-6]|tr|td|table|section|article|nav|footer|header))\b[^>]*>", "\n", body)
    lines = (" ".join(x.split()) for x in html.unescape(re.sub(r"(?s)<[^>]*>", "", body)).split("\n"))
    return "\n".join(x for x in lines if x)


def parse_file(mime: str, content: bytes) -> tuple[list[tuple[int, str]], str | None]:
    """((page, text), error) of one file. Formats that need a foreign parser are reported as such."""
    if not mime.startswith("text/") and mime not in ("application/json", "application/xml"):
        return [], f"no parser for {mime}"
    body = content.decode("utf-8", "replace")
    if mime in ("text/html", "application/xml"):
        body = html_text(body)
    elif mime == "text/markdown":
        body = re.sub(r"(?m)^#{1,6}\s+|^[ \t]*[-*+]\s+|[*_`]{1,3}", "", re.sub(r"!?\[([^\]]*)\]\([^)]*\)", r"\1", body))
    return list(enumerate(body.split("\f"), 1)), None


def parse_files(files: DataFrame) -> DataFrame:
    """path, page, text, error: a row per page; a failed file is one row with its error."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, mime, content in zip(batch["path"], batch["mime"], batch["content"], strict=True):
                pages, error = parse_file(mime, content or b"")
                rows += [(path, n, t, None) for n, t in pages] or [(path, None, None, error)]
            yield pd.DataFrame(rows, columns=["path", "page", "text", "error"]).astype({"page": "Int32"})

    return spread(with_format(files).select("path", "mime", "content")).mapInPandas(run, "path string, page int, text string, error string")


def needs_fallback(pages: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Per document: parse again by OCR? No page, over half failed, or unsure; never if locked or corrupt.

    Confidences are added in page order, by a running sum that spills, so a mean at the
    threshold falls on the same side however the rows are dealt.
    """
    so_far = Window.partitionBy("doc_id").orderBy("page", "confidence").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    added = F.struct(F.count(F.lit(1)).over(so_far).alias("n"), F.sum(F.col("confidence").cast("double")).over(so_far).alias("total"))
    locked = F.max(F.when(F.col("error").isin("password", "corrupt"), 1).otherwise(0)) == 1
    failed = F.avg(F.when(F.col("ok"), 0.0).otherwise(1.0))
    sure = F.coalesce(F.max("added")["total"] / F.nullif(F.count("confidence"), F.lit(0)), F.lit(0.0))
    return pages.withColumn("added", added).groupBy("doc_id").agg(((~locked) & ((F.count("page") == 0) | (failed > 0.5) | (sure < threshold))).alias("fallback"))


def rows_to_text(rows: DataFrame, columns: list[str], id_col: str, merge: int = 1) -> DataFrame:
    """first_id, n_rows, text of imported rows: ``name: value`` lines, ``merge`` rows a block."""
    line = F.concat(*[x for c in columns for x in (F.lit(f"{c}: "), F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit("\n"))])
    named = rows.select(F.col(id_col).alias("row_id"), line.alias("body"))
    if merge <= 1:
        return named.select(F.col("row_id").alias("first_id"), F.lit(1).alias("n_rows"), F.col("body").alias("text"))
    grouped = numbered(named, "n", "row_id").withColumn("g", F.floor(F.col("n") / merge)).groupBy("g").agg(F.array_sort(F.collect_list(F.struct("row_id", "body"))).alias("rs"))
    return grouped.select(F.col("rs")[0]["row_id"].alias("first_id"), F.size("rs").alias("n_rows"), F.array_join(F.transform("rs", lambda r: r["body"]), "\n---\n").alias("text"))


def replace_source(existing: DataFrame, fresh: DataFrame, prefix: str, column: str = "source") -> DataFrame:
    """Overwrite all rows of one source prefix."""
    return existing.filter(~F.coalesce(F.startswith(F.col(column), F.lit(prefix)), F.lit(False))).unionByName(fresh)


def submit_batch(docs: DataFrame, stored: DataFrame, on_duplicate: str = "error") -> DataFrame:
    """The outcome of every submitted document: accepted, replaced, skipped or rejected, with its error.

    ``on_duplicate`` says what becomes of a doc_id that is stored: error, skip or replace.
    """
    if on_duplicate not in ("error", "skip", "replace"):
        raise ValueError(f"on_duplicate can't be {on_duplicate}")
    known = stored.select("doc_id").distinct().withColumn("known", F.lit(True))
    checked = check_batch(docs).join(known, "doc_id", "left")
    there = F.coalesce("known", F.lit(False))
    met = {"error": "rejected", "skip": "skipped", "replace": "replaced"}[on_duplicate]
    outcome = F.when(F.col("error").isNotNull(), "rejected").when(there, met).otherwise("accepted")
    error = F.when(F.col("error").isNull() & there & F.lit(on_duplicate == "error"), "exists").otherwise(F.col("error"))
    return checked.withColumn("outcome", outcome).withColumn("error", error).drop("known")


def check_batch(docs: DataFrame, most_docs: int = 100, most_bytes: int = 10 << 20) -> DataFrame:
    """Submitted documents with ``error``: too_many, duplicate_id, empty, too_large, or null."""
    n = docs.groupBy("doc_id").agg(F.count("*").alias("n"))
    total = docs.agg(F.count("*").alias("total"))
    joined = docs.join(n, "doc_id").crossJoin(F.broadcast(total))  # one row
    size = F.octet_length(F.coalesce("text", F.lit("")))
    error = F.when(F.col("total") > most_docs, "too_many").when(F.col("n") > 1, "duplicate_id").when(size == 0, "empty").when(size > most_bytes, "too_large")
    return joined.withColumn("error", error).drop("n", "total")


# --- snapshots and logs -----------------------------------------------------------------


def save_snapshot(df: DataFrame, folder: str, version: int, keep: int = 2) -> str:
    """A versioned copy; all but the newest ``keep`` versions go."""
    path = f"{folder}/v{version:010d}"
    df.write.mode("overwrite").parquet(path)
    for old in snapshots(df.sparkSession, folder)[:-keep]:
        fs, p = _hadoop(df.sparkSession, f"{folder}/{old}")
        fs.delete(p, True)
    return path


def snapshots(spark: SparkSession, folder: str) -> list[str]:
    """Complete versions, oldest first."""
    fs, path = _hadoop(spark, folder)
    if not fs.exists(path):
        return []
    names = [s.getPath() for s in fs.listStatus(path) if s.isDirectory()]
    done = [p.getName() for p in names if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
    return sorted(n for n in done if re.fullmatch(r"v\d{10}", n))


def load_snapshot(spark: SparkSession, folder: str) -> DataFrame | None:
    found = snapshots(spark, folder)
    return spark.read.parquet(f"{folder}/{found[-1]}") if found else None


def _hadoop(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p
