"""Link tables on disk."""

from __future__ import annotations

from pyspark.sql import DataFrame

EDGE_FORMATS = ("parquet", "csv")


def write_edges(links: DataFrame, path: str, fmt: str = "parquet", mode: str = "errorifexists") -> None:
    """Write ``(src, dst, tag, depth)`` rows of a link table.

    ``links`` has ``src_url, url, tag`` and optionally ``depth``.
    """
    if fmt not in EDGE_FORMATS:
        raise ValueError(f"format must be one of {EDGE_FORMATS}")
    columns = ["src_url AS src", "url AS dst", "tag"]
    columns.append("depth" if "depth" in links.columns else "CAST(NULL AS INT) AS depth")
    writer = links.selectExpr(*columns).write.mode(mode)
    if fmt == "csv":
        writer = writer.option("header", True)
    writer.format(fmt).save(path)
