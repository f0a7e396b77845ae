"""Scopes: composable predicates deciding which links are followed.

A scope is a tree of leaves over ``(url, tag, depth)``.  It can be used as a
boolean Column, or applied to a DataFrame with :meth:`Scope.filter`, which lets
leaves add helper columns or joins instead of nesting everything in one
expression.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from functools import cache, reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.functions._let import settled
from linkloom.functions.ignore_list import bundled
from linkloom.functions.markup import TAG_RELATED
from linkloom.functions.regex_match import matches_any
from linkloom.functions.urls import plain_place, prefix_candidates, prefix_key, url_scheme, with_prefix_candidates
from linkloom.plans import storage
from linkloom.sources.lists import IGNORE_PATH_SETTING, default_ignores

#: filters compare prefix sets up to this size in place and join larger ones, with the same rows
MAX_INLINE_PREFIXES = 1000

#: prefix tables up to these sizes are broadcast, one join a depth; larger ones meet the URLs in a shuffle
BROADCAST_PREFIXES, BROADCAST_BYTES, BROADCAST_DEPTHS = 500_000, 64 << 20, 16

#: prefixes a Column compares with; it holds them in one row
MAX_COLUMN_PREFIXES = 100_000

#: candidates looked up apart from the shuffle, since many URLs may share them
HOT_CANDIDATES = 1000

Check = Callable[[Column, Column, Column], Column]


@dataclass(frozen=True)
class Scope:
    """One node of a scope tree; ``check(url, tag, depth)`` gives a Column."""

    check: Check
    uses_depth: bool = False
    operator: str = "leaf"
    parts: tuple["Scope", ...] = ()
    #: ``mark(df, name)`` adds the leaf's verdict on ``df.url`` as a column
    mark: Callable[[DataFrame, str], DataFrame] | None = field(default=None)
    #: what a leaf tests, where its Column does not tell
    about: Callable[[], str] | None = field(default=None)
    #: whether ``mark`` joins the URLs to a table, which costs a walk's round more than testing its URLs one by one
    joins: Callable[[], bool] | None = field(default=None)

    def joins_table(self) -> bool:
        """True if a leaf joins URLs to a table of its own."""
        return any(p.joins_table() for p in self.parts) or (self.joins is not None and self.joins())

    def describe(self) -> str:
        """The same text for scopes that decide alike, in any session; prefix sets are read for it."""
        if self.operator != "leaf":
            return f"{self.operator}({', '.join(p.describe() for p in self.parts)})"
        return self.about() if self.about else str(self.column())

    def column(self, url: str = "url", tag: str = "tag", depth: str = "depth") -> Column:
        return self.check(F.col(url), F.col(tag), F.col(depth))

    def filter(self, df: DataFrame) -> DataFrame:
        """Rows in scope; ``df`` needs ``url``, and ``tag``/``depth`` if they are used."""
        kept = df.columns
        for part in conjuncts(self):
            df, condition = part.bind(df)
            df = df.filter(condition)
        return df.select(*kept)

    def bind(self, df: DataFrame) -> tuple[DataFrame, Column]:
        """``df`` with the helper columns this scope needs, and its verdict."""
        if self.operator == "leaf":
            if self.mark is None:
                return df, self.column()
            name = f"__scope{len(df.columns)}"
            return self.mark(df, name), F.col(name)
        verdicts = []
        for part in self.parts:
            df, verdict = part.bind(df)
            verdicts.append(verdict)
        return df, _combine(self.operator, verdicts)


def _combine(operator: str, verdicts: list[Column]) -> Column:
    if operator == "and":
        return reduce(and_, verdicts, F.lit(True))
    return reduce(or_, verdicts, F.lit(False))


def conjuncts(scope: Scope) -> list[Scope]:
    """The scopes that must all hold."""
    if scope.operator != "and":
        return [scope]
    return [c for part in scope.parts for c in conjuncts(part)]


def _compound(operator: str, parts: tuple[Scope, ...]) -> Scope:
    return Scope(
        check=lambda url, tag, depth: _combine(operator, [p.check(url, tag, depth) for p in parts]),
        uses_depth=any(p.uses_depth for p in parts),
        operator=operator,
        parts=parts,
    )


def all_of(*scopes: Scope) -> Scope:
    """Every scope holds; true if there are none."""
    return _compound("and", scopes)


def any_of(*scopes: Scope) -> Scope:
    """At least one scope holds; false if there are none."""
    return _compound("or", scopes)


def user_scope(check: Check, uses_depth: bool = True) -> Scope:
    """A scope from any function of the url, tag and depth columns."""
    return Scope(check=check, uses_depth=uses_depth)


def depth_scope(limit: int) -> Scope:
    """Links fewer than ``limit`` steps away from a seed."""
    return Scope(check=lambda url, tag, depth: depth < F.lit(limit), uses_depth=True)


def scheme_scope(schemes: Iterable[str]) -> Scope:
    allowed = list(schemes)
    return Scope(check=lambda url, tag, depth: url_scheme(url).isin(allowed))


def related_scope() -> Scope:
    """Resources of a page, wherever they are."""
    return Scope(check=lambda url, tag, depth: tag == F.lit(TAG_RELATED))


def content_digest(df: DataFrame) -> str:
    """The number of rows and a sum of their hashes: equal for equal tables in any order."""
    hashes = F.xxhash64(*df.columns).cast("decimal(38,0)"), F.xxhash64(F.lit(1), *df.columns).cast("decimal(38,0)")
    row = df.agg(F.count(F.lit(1)), *[F.sum(h) for h in hashes]).first()
    return "-".join(str(v or 0) for v in row)


def _default_patterns() -> list[str]:
    spark = SparkSession.getActiveSession()
    if spark is None or spark.conf.get(IGNORE_PATH_SETTING, None) is None:
        return [pattern for _, pattern in bundled()]
    return sorted(r["pattern"] for r in default_ignores(spark).collect())


def ignore_scope(
    extra: Iterable[str] = (), defaults: Iterable[str] | None = None
) -> Scope:
    """URLs matched by none of the default and extra patterns.

    The default ones are the bundled list, or the collection the session names
    (:data:`linkloom.sources.lists.IGNORE_PATH_SETTING`).
    """
    base = _default_patterns() if defaults is None else list(defaults)
    patterns = base + list(extra)
    digest = hashlib.sha256("\n".join(sorted(set(patterns))).encode()).hexdigest()
    return Scope(check=lambda url, tag, depth: ~matches_any(url, patterns), about=lambda: f"ignore {digest}")


def _mark_inline(df: DataFrame, name: str, keys: list[str]) -> DataFrame:
    kept = df.columns
    df = df.select(*kept, settled(plain_place(F.col("url"))).alias("__plain"))
    # a NULL goes through the steps at no cost, so URLs in normal form skip them
    df = with_prefix_candidates(df.withColumn("__odd", F.when(F.col("__plain").isNull(), F.col("url"))), "__odd", "__cand")
    # a key of d parts can equal the d-th candidate only
    by_depth = defaultdict(list)
    for key in keys:
        by_depth[key.count("/") + 1].append(key)
    plain = [F.substring_index("__plain", "/", d).isin(of) for d, of in sorted(by_depth.items())]
    hit = F.when(F.col("__plain").isNotNull(), _combine("or", plain)).otherwise(F.exists("__cand", lambda c: c.isin(keys)))
    return df.select(*kept, F.coalesce(hit, F.lit(False)).alias(name))


@dataclass(frozen=True)
class PrefixTable:
    """Distinct prefix keys written once, with what decides how URLs meet them."""

    rows: DataFrame
    count: int
    size: int
    depths: list[int]

    @classmethod
    def of(cls, keys: DataFrame) -> "PrefixTable":
        """``keys``: one column.  A key's depth is its place among a URL's candidates, the host being 1."""
        spark = keys.sparkSession
        key = F.col(keys.columns[0])
        distinct = keys.select(key.alias("prefix")).where(key.isNotNull()).distinct()
        path = storage.fresh_dir(spark, "prefixes")
        distinct.withColumn("depth", F.size(F.split("prefix", "/"))).write.parquet(path)
        rows = spark.read.schema("prefix string, depth int").parquet(path)
        n, size, depths = rows.agg(
            F.count(F.lit(1)), F.sum(F.octet_length("prefix")), F.sort_array(F.collect_set("depth"))
        ).first()
        return cls(rows, n, size or 0, depths)

    @property
    def fits_broadcast(self) -> bool:
        return self.count <= BROADCAST_PREFIXES and self.size <= BROADCAST_BYTES and len(self.depths) <= BROADCAST_DEPTHS

    def mark(self, df: DataFrame, name: str) -> DataFrame:
        """``df`` with a column telling whether ``url`` falls under one of the prefixes."""
        if self.fits_broadcast:
            return self._mark_in_place(df, name)
        inside = self.matches(df.select("url")).withColumn(name, F.lit(True))
        joined = df.join(inside, "url", "left")
        return joined.select(*df.columns, F.coalesce(F.col(name), F.lit(False)).alias(name))

    def _mark_in_place(self, df: DataFrame, name: str) -> DataFrame:
        """One broadcast join a depth: a key of depth d can equal the d-th candidate only.  Nothing is shuffled."""
        kept = df.columns
        df = with_prefix_candidates(df, "url", "__cand")
        hits = []
        for depth in self.depths:
            hit = f"__hit{depth}"
            keys = self.rows.where(F.col("depth") == depth).select(F.col("prefix").alias("__key"), F.lit(True).alias(hit))
            df = df.withColumn("__key", F.get("__cand", F.lit(depth - 1))).join(F.broadcast(keys), "__key", "left").drop("__key")
            hits.append(F.coalesce(F.col(hit), F.lit(False)))
        return df.select(*kept, _combine("or", hits).alias(name))

    def matches(self, urls: DataFrame) -> DataFrame:
        """Distinct URLs under one of the prefixes, by a shuffle of their candidates.

        A sketch of heavy hitters names the candidates that most URLs share (hosts,
        top folders).  Those among the prefixes are compared in place; the others are
        too rare to make a large partition, so the prefixes are not repeated.
        """
        listed = with_prefix_candidates(urls.select("url").distinct(), "url", "candidates")
        candidates = listed.select("url", F.explode("candidates").alias("prefix"))
        top = candidates.agg(F.expr(f"approx_top_k(prefix, {HOT_CANDIDATES})").alias("k"))
        hot = [item.item for item in top.first().k or []]
        known = [r.prefix for r in self.rows.where(F.col("prefix").isin(hot)).select("prefix").collect()]
        under_hot = F.exists("candidates", lambda c: c.isin(known))
        at_once = listed.where(F.coalesce(under_hot, F.lit(False))).select("url")
        rare = candidates.where(~F.col("prefix").isin(hot)).join(self.rows.select("prefix"), "prefix", "left_semi")
        return at_once.unionByName(rare.select("url")).distinct()


def prefix_scope(prefixes: Iterable[str] | DataFrame) -> Scope:
    """URLs having one of the given URLs as a prefix, by whole path segments.

    The scheme and a leading ``www.`` do not count.  A DataFrame (first column:
    URL) may be of any size, and building the scope starts no job.  Applied with
    :meth:`Scope.filter`, few prefixes are compared in place and more are joined;
    :meth:`Scope.column` compares with all of them, read by a scalar subquery when
    the query runs, and fails beyond :data:`MAX_COLUMN_PREFIXES`: use the filter there.
    """
    if not isinstance(prefixes, DataFrame):
        prefixes = SparkSession.active().createDataFrame([(u,) for u in prefixes], "url string")
    keys = prefixes.select(prefix_key(F.col(prefixes.columns[0])).alias("prefix"))
    keys = keys.filter(F.col("prefix").isNotNull()).distinct()

    @cache
    def few() -> list[str]:
        return sorted(r["prefix"] for r in keys.limit(MAX_INLINE_PREFIXES + 1).collect())

    @cache
    def many() -> PrefixTable:
        return PrefixTable.of(keys)

    def mark(df: DataFrame, name: str) -> DataFrame:
        if len(few()) > MAX_INLINE_PREFIXES:
            return many().mark(df, name)
        return _mark_inline(df, name, few())

    def check(url: Column, tag: Column, depth: Column) -> Column:
        some = keys.limit(MAX_COLUMN_PREFIXES + 1).agg(F.collect_set("prefix").alias("known"))
        too_many = F.raise_error(F.lit(f"more than {MAX_COLUMN_PREFIXES} prefixes: use Scope.filter"))
        known = some.select(F.when(F.size("known") <= MAX_COLUMN_PREFIXES, F.col("known")).otherwise(too_many)).scalar()
        return F.coalesce(F.arrays_overlap(prefix_candidates(url), known), F.lit(False))

    return Scope(
        check=check,
        mark=mark,
        about=lambda: f"prefixes {content_digest(keys)}",
        joins=lambda: len(few()) > MAX_INLINE_PREFIXES,
    )


def _lower_host(url: Column) -> Column:
    return F.concat(
        F.lower(F.regexp_extract(url, r"^([^/]*//[^/?#]*)?", 0)), F.regexp_replace(url, r"^[^/]*//[^/?#]*", "")
    )


def seed_scope(seeds: Iterable[str] | DataFrame) -> Scope:
    """URLs below one of the seeds (whose hosts compare in lower case)."""
    if not isinstance(seeds, DataFrame):
        seeds = SparkSession.active().createDataFrame([(u,) for u in seeds], "url string")
    return prefix_scope(seeds.select(_lower_host(F.col("url")).alias("url")))


def site_scope(
    seeds: Iterable[str] | DataFrame,
    schemes: Iterable[str] = ("http", "https"),
    depth: int = 100,
    only_prefixes: Iterable[str] | DataFrame | None = None,
    excludes: Iterable[str] = (),
    exclude_related: bool = False,
    ignores: Iterable[str] | None = None,
) -> Scope:
    """Scope of a full walk: near pages under the seeds, with their resources."""
    under = seed_scope(seeds) if only_prefixes is None else prefix_scope(only_prefixes)
    base = all_of(scheme_scope(schemes), depth_scope(depth), under)
    reachable = base if exclude_related else any_of(base, related_scope())
    return all_of(reachable, ignore_scope(excludes, ignores))


def links_scope(
    seeds: Iterable[str] | DataFrame, schemes: Iterable[str] = ("http", "https"), depth: int = 10
) -> Scope:
    """Scope of a link survey: pages under the seeds, no ignore list."""
    return all_of(scheme_scope(schemes), depth_scope(depth), seed_scope(seeds))


def prefix_matches(urls: DataFrame, prefixes: DataFrame) -> DataFrame:
    """Distinct URLs of ``urls`` that fall under one of ``prefixes`` (one column of prefix keys)."""
    return semi_join_prefixes(urls.select("url"), prefixes).distinct()


def semi_join_prefixes(urls: DataFrame, prefixes: DataFrame) -> DataFrame:
    """Rows of ``urls`` whose URL falls under one of ``prefixes`` (one column of prefix keys, any number).

    A table small enough is broadcast and no row of ``urls`` moves; see :class:`PrefixTable`.
    """
    return PrefixTable.of(prefixes).mark(urls, "__under").where("__under").drop("__under")
