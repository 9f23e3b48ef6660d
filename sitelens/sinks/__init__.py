"""Report sinks (O43, O44): header names and column order of each report,
written as ordinary Spark tables (CSV with a header row, Parquet or JSON).

Lists are kept as arrays in the DataFrames and joined into text only here
and in the report plans that the programs print as text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import (HEADER_URL, HEADERS_BLOCK_REPORT, HEADERS_DOMAINS, HEADERS_LINKS,
                      HEADERS_MEDIA)

# report kind -> [(column, header)] in output order
LAYOUTS: dict[str, list[tuple[str, str]]] = {
    "blocks": list(zip(("block_name", "variant_name", "layout_name", "language", "occurrence",
                        "last_modified", "page_url"), HEADERS_BLOCK_REPORT)),
    "links": list(zip(("url", "href_links"), HEADERS_LINKS)),
    "link_rows": list(zip(("url", "link"), HEADERS_LINKS)),
    "domains": list(zip(("url", "href_links", "brand_domains", "non_brand_domains"), HEADERS_DOMAINS)),
    "media": list(zip(("url", "template_ids"), HEADERS_MEDIA)),
}


# Null marker in CSV output: keeps '' (a page without links) apart from null
# (no last-modified date) when a report is read back.
CSV_NULL = "\\N"


def _csv(writer):
    # values are written as they are: the joined lists start with a newline
    return (writer.option("header", "true").option("ignoreLeadingWhiteSpace", "false")
            .option("ignoreTrailingWhiteSpace", "false").option("nullValue", CSV_NULL))


def read_report(spark, path: str, schema: str):
    """Read a CSV report written by ``write_report``/``write_report_by_sheet``."""
    return (spark.read.schema(schema).option("header", "true").option("multiLine", "true")
            .option("nullValue", CSV_NULL).csv(path))


def with_headers(df: DataFrame, kind: str) -> DataFrame:
    """The report's columns renamed to its headers, in header order.
    kind='matrix': ``Url`` then one column per vocabulary name, as given."""
    if kind == "matrix":
        return df.select(F.col("url").alias(HEADER_URL), *[F.col(f"`{c}`") for c in df.columns if c != "url"])
    return df.select(*[F.col(c).alias(h) for c, h in LAYOUTS[kind]])


def write_report(df: DataFrame, path: str, kind: str, fmt: str = "csv", mode: str = "overwrite") -> None:
    """Write a report with its headers. CSV gets a header row and
    quotes values holding newlines (the joined link lists)."""
    out = with_headers(df, kind)
    w = out.write.mode(mode)
    if fmt == "csv":
        _csv(w).csv(path)
    else:
        w.format(fmt).save(path)


def write_report_by_sheet(df: DataFrame, path: str, kind: str = "media", fmt: str = "csv",
                          mode: str = "overwrite") -> None:
    """One output section per input sheet (``sheet=<name>/`` folders)."""
    cols = [F.col(c).alias(h) for c, h in LAYOUTS[kind]] + [F.col("sheet")]
    w = df.select(*cols).write.mode(mode).partitionBy("sheet")
    if fmt == "csv":
        _csv(w).csv(path)
    else:
        w.format(fmt).save(path)
