"""Sources and sinks: pinned raw files, documents as JSON, recorded answers, append-only logs, tables of results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DOCUMENT = (
    "doc_id string, source_sha256 string, text string, "
    "sections array<struct<id string, number string, heading string, char_start bigint, char_end bigint, article string>>, "
    "pages array<struct<page int, char_start bigint, char_end bigint>>, "
    "segments array<struct<id string, section_id string, page int, char_start bigint, char_end bigint>>"
)


def raw_files(spark: SparkSession, folder: str, pins: DataFrame) -> DataFrame:
    """Files with their digest and what speaks against them; pins: (name, pin)."""
    files = spark.read.format("binaryFile").load(folder).select(F.element_at(F.split("path", "/"), -1).alias("name"), "content")
    rows = files.withColumn("digest", F.sha2("content", 256)).join(pins, "name", "left")
    fault = F.when(F.lower("name").endswith(".pdf"), "not_supported").when(F.col("pin").isNull(), "no_pin").when(F.col("pin") != F.col("digest"), "pin_mismatch")
    return rows.select("name", "content", "digest", fault.alias("fault"))


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Documents in JSON, by a fixed schema."""
    return spark.read.schema(DOCUMENT).json(path)


def document_faults(docs: DataFrame) -> DataFrame:
    """The first structural rule that a document breaks."""
    n = F.length("text")
    ends = lambda parts: F.transform(parts, lambda p: p["char_end"])
    starts = lambda parts: F.transform(parts, lambda p: p["char_start"])

    def tiles(parts: F.Column) -> F.Column:
        return (F.get(starts(parts), F.lit(0)) == 0) & (F.element_at(ends(parts), -1) == n) & (F.slice(starts(parts), F.lit(2), F.size(parts)) == F.slice(ends(parts), F.lit(1), F.size(parts) - 1))

    ids = F.transform("segments", lambda s: s["id"])
    fault = (
        F.when((n == 0) & (F.size("sections") + F.size("pages") + F.size("segments") > 0), "parts_of_empty_text")
        .when((n > 0) & ~F.coalesce(tiles(F.col("pages")), F.lit(False)), "pages_do_not_tile")
        .when((n > 0) & ~F.coalesce(tiles(F.col("sections")), F.lit(False)), "sections_do_not_tile")
        .when(F.size(F.array_distinct(ids)) < F.size(ids), "segment_ids_repeat")
        .when(F.exists("segments", lambda s: s["char_end"] <= s["char_start"]), "empty_segment")
    )
    return docs.select("doc_id", fault.alias("fault"))


def recorded_answers(spark: SparkSession, folder: str, schema: str, keys: tuple[str, ...]) -> DataFrame:
    """Recorded JSON answers by file name; one that can't be read or has other keys is a miss."""
    rows = spark.read.option("wholetext", True).text(folder).select(F.regexp_extract(F.input_file_name(), r"([^/]+)\.json$", 1).alias("fingerprint"), "value")
    ok = F.array_sort(F.json_object_keys("value")) == F.array_sort(F.array(*map(F.lit, keys)))
    return rows.where(F.coalesce(ok, F.lit(False))).select("fingerprint", F.from_json("value", schema).alias("answer"))


def append_log(rows: DataFrame, path: str) -> None:
    """One JSON object a line, added to what is there."""
    rows.write.mode("append").json(path)


def filing_date(index: F.Column) -> F.Column:
    """The date that follows the label of an index page."""
    return F.to_date(F.regexp_extract(index, r"(?s)Filing Date</div>\s*<div[^>]*>\s*([0-9]{4}-[0-9]{2}-[0-9]{2})", 1))


def markdown_table(rows: DataFrame, most: int = 200) -> str:
    """A result of at most `most` rows as a table in Markdown, in the order of its columns; a larger one is an error."""
    found = [tuple(r) for r in rows.orderBy(*rows.columns).limit(most + 1).collect()]
    if len(found) > most:
        raise ValueError(f"more than {most} rows")
    lines = ["| " + " | ".join(rows.columns) + " |", "|" + "---|" * len(rows.columns)]
    return "\n".join(lines + ["| " + " | ".join("-" if v is None else str(v) for v in r) + " |" for r in found]) + "\n"


def drifted(path: str, table: str, start: str = "<!-- tables:start -->", end: str = "<!-- tables:end -->") -> bool:
    """Whether the part of a local report between the marks is other than `table`."""
    with open(path, encoding="utf-8") as f:
        text = f.read()
    if text.count(start) != 1 or text.count(end) != 1:
        raise ValueError("the report's marks are missing or repeated")
    return text.split(start)[1].split(end)[0].strip() != table.strip()
