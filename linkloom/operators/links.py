"""From captured pages to a link table.

Extraction, resolution and per-page uniqueness all happen inside the page's
own row, so the stage has no shuffle: the wide body column is read, turned into
an array of links and dropped before anything moves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkloom.functions._let import chain_columns
from linkloom.functions.markup import TAG_PRIMARY, TAG_RELATED, link_tokens, token_links
from linkloom.functions.urls import BASE, BASE_FIELDS, is_data_url, resolve_links


def _unique_links(resolved: Column) -> tuple[Column, Column]:
    """Distinct related targets, and distinct primary targets not among them.

    A target seen both ways counts as related.
    """

    def targets(kind: int) -> Column:
        return F.array_distinct(
            F.transform(F.filter(resolved, lambda r: r["tag"] == kind), lambda r: r["url"])
        )

    return targets(TAG_RELATED), targets(TAG_PRIMARY)


def page_links(
    pages: DataFrame,
    url: str = "url",
    body: str = "body",
    content_type: str = "content_type",
    keep: list[str] | None = None,
) -> DataFrame:
    """``(<keep>, src_url, url, tag)``: unique resolved links of each page row.

    ``data:`` links and references that do not parse are left out; a fragment
    is part of a link's identity.
    """
    keep = keep or []
    df = pages.select(
        *keep, F.col(url).alias("src_url"), link_tokens(F.col(body), F.col(content_type)).alias("__tokens")
    )
    raws = F.array_distinct(F.filter(token_links(F.col("__tokens")), lambda r: ~is_data_url(r["raw"])))
    df = df.select(*keep, "src_url", raws.alias("__raws"))
    df, base = chain_columns(df, BASE, {"raw": F.col("src_url")}, "__b_")
    base = {k: base[k] for k in BASE_FIELDS}
    df = df.select(*keep, "src_url", resolve_links(base, F.col("__raws")).alias("__links"))
    related, primary = _unique_links(F.col("__links"))
    df = df.select(*keep, "src_url", related.alias("__rel"), primary.alias("__pri"))
    tagged = F.concat(
        F.transform("__rel", lambda u: F.struct(u.alias("url"), F.lit(TAG_RELATED).alias("tag"))),
        F.transform(
            F.array_except("__pri", "__rel"), lambda u: F.struct(u.alias("url"), F.lit(TAG_PRIMARY).alias("tag"))
        ),
    )
    # the outer form keeps Catalyst from deriving a filter that would extract twice
    return df.select(*keep, "src_url", F.inline_outer(tagged)).filter(F.col("url").isNotNull())
