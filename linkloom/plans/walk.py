"""Frontier expansion to a fixpoint over a captured corpus.

Links are extracted and resolved once, before the first round, and written as an
edge table bucketed by source URL in normal form.  A round then joins narrow rows
only:

    frontier ⋈ edges  →  least parent  →  normal form  ▷  visited  →  scope  →  first seen  →  next round

Many edges lead to few URLs, so normal forms are made of what is left when equal
links of a round are one row, and the scope is asked about those not visited yet.
Only under a scope that joins URLs to a table of its own (many prefixes) both are
done on the edges, once, as far as the scope does not need the depth.

Edges and visited URLs are bucketed tables, as many buckets as their size asks
for, so neither is shuffled again: only the new candidates move.  Edges are sorted
by the key they are bucketed by; a round with a small frontier names its keys, so
it reads their buckets and pages only.  A page with very many links gets several slots in the edge table, and its
frontier row is repeated once per slot, so no bucket holds one page's links
whole.  Every round is a committed table partition; lineage never grows, and a
restart goes on after the last committed round.  What rounds test candidates
against is a table of runs: small neighbouring rounds are merged into one, so many
rounds do not become many files.

A state folder remembers what its walk was begun with, and a walk with another
scope, seeds, corpus or links is refused there or begins anew.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.functions._let import settled
from linkloom.functions.markup import TAG_PRIMARY, TAG_RELATED
from linkloom.functions.urls import normalize_url, with_normalized_url
from linkloom.operators.frontier import (
    anti_join_seen,
    candidates_in_scope,
    first_seen,
    lookup_responses,
)
from linkloom.operators.links import page_links
from linkloom.operators.responses import handle, is_redirect, is_retry, redirect_edges
from linkloom.operators.scope import Scope, all_of, conjuncts, content_digest
from linkloom.plans import storage

#: links of one page beyond which its edges are spread over several buckets
HOT_LINKS = 1_000_000
#: values of an IN that Parquet scans compare pages with one by one
IN_FILTER_SETTING = "spark.sql.parquet.pushdown.inFilterThreshold"
#: edge bytes a bucket is meant to hold, and the least worth one
BUCKET_BYTES = 128 << 20
LEAST_BUCKET_BYTES = 1 << 20
LEAST_BUCKETS = 4
#: frontier keys that a round may name to its edge scan
NAMED_KEYS = 1_000
#: runs of visited URLs beyond which the newest are merged
MAX_RUNS = 8

Handler = Callable[[DataFrame], DataFrame]


@dataclass
class WalkResult:
    """Visited URLs with their responses' outcome, and where they are kept."""

    visited: DataFrame
    responses: DataFrame
    rounds: int
    state_dir: str
    #: False if ``max_rounds`` ended it while there was still something new
    complete: bool

    @property
    def saved(self) -> DataFrame:
        """Visited URLs whose response was saved."""
        return self.responses.filter(F.col("status") < 400)

    @property
    def missing(self) -> DataFrame:
        """Visited URLs the corpus has no usable response for."""
        return self.responses.filter(is_retry(F.col("status")))


@dataclass
class _Corpus:
    """Responses keyed by normal URL, each URL answered once.

    ``heads`` are the answers without their bodies; ``full`` still has every
    row, with its body, and ``keys`` tell which of them are ``chosen``.  Choosing
    is done on narrow rows: bodies are read where links are extracted and are
    never shuffled for it.
    """

    full: DataFrame
    heads: DataFrame
    keys: list[str]
    chosen: DataFrame | None

    def answered(self) -> DataFrame:
        """The answers with their bodies."""
        return self.full if self.chosen is None else self.full.join(self.chosen, self.keys, "left_semi")

    def only_chosen(self, links: DataFrame) -> DataFrame:
        """Of links made from ``full`` (with ``keys``), those of the answers."""
        return links if self.chosen is None else links.join(self.chosen, self.keys, "left_semi")


def _keyed(corpus: DataFrame, order_by: str | None, max_attempts: int | None) -> _Corpus:
    """One answer per URL: the first attempt needing no retry (else the last), then the least ``order_by``."""
    full = with_normalized_url(corpus).filter(F.col("url").isNotNull())
    heads = full.drop("body")
    retry = is_retry(F.col("status"))
    order: dict[str, Column] = {}
    if "attempt" in corpus.columns:
        if max_attempts is not None:
            limit = F.col("attempt") < max_attempts
            full, heads = full.filter(limit), heads.filter(limit)
        order["retry"] = retry
        order["rank"] = F.when(retry, -F.col("attempt")).otherwise(F.col("attempt"))
    keys = [k for k in ("attempt", order_by) if k and k in corpus.columns]
    if not keys:
        return _Corpus(full, heads, [], None)
    picked = F.min(F.struct(*[c.alias(n) for n, c in order.items()], *keys))
    if keys == [order_by]:
        chosen = heads.groupBy("url").agg(F.min(order_by).alias(order_by))
    else:
        chosen = heads.groupBy("url").agg(picked.alias("o")).select("url", *[f"o.{k}" for k in keys])
    keys = ["url", *keys]
    return _Corpus(full, heads.join(chosen, keys, "left_semi"), keys, chosen)


def outgoing_links(corpus: _Corpus, handler: Handler | None, given: DataFrame | None) -> DataFrame:
    """``(src_url, url, tag, src_tag)`` of all responses, redirects included.

    Links are the ``given`` ones, or the handler's, or extracted.  Given ones may
    start at any page; those of pages that were not saved are left out by :func:`_laid_out`.

    A redirect passes on the tag its source was reached with, so it gives one
    row per tag, valid for that source tag only; ``src_tag`` is NULL otherwise.
    """
    saved = corpus.heads.filter(F.col("status") < 400)
    if given is not None:
        links = with_normalized_url(given.select("src_url", "url", "tag"), "src_url", "src_url")
        links = links.filter(F.col("src_url").isNotNull())
    elif handler is not None:
        links = handle(corpus.answered(), handler)
    else:
        extra = [k for k in corpus.keys if k != "url"]
        links = page_links(corpus.full.filter(F.col("status") < 400), keep=extra)
        if "url" in corpus.keys:
            links = links.withColumnsRenamed({"url": "__dst", "src_url": "url"})
            links = corpus.only_chosen(links).withColumnsRenamed({"url": "src_url", "__dst": "url"})
        else:
            links = corpus.only_chosen(links)
        links = links.select("src_url", "url", "tag")
    moved = saved.filter(is_redirect(F.col("status"), F.col("location"))).select(
        "url", "status", "location", F.lit(None).cast("int").alias("tag"), F.lit(0).alias("depth")
    )
    # resolved first, then given a row for each tag
    tags = F.explode(F.array(F.lit(TAG_PRIMARY), F.lit(TAG_RELATED)))
    redirects = redirect_edges(moved).select("src_url", "url", tags.alias("tag")).withColumn("src_tag", F.col("tag"))
    return links.withColumn("src_tag", F.lit(None).cast("int")).unionByName(redirects)


def _split_scope(scope: Scope) -> tuple[Scope, list[Scope]]:
    """The part that can be tested on an edge alone, and the parts needing depth."""
    parts = conjuncts(scope)
    return all_of(*[p for p in parts if not p.uses_depth]), [p for p in parts if p.uses_depth]


def _freeze(scope: Scope, df: DataFrame, frozen: list[str]) -> tuple[DataFrame, Scope]:
    """Evaluate the depth-free subtrees of ``scope`` once, as columns of ``df``."""
    if not scope.uses_depth:
        name = f"ok{len(frozen)}"
        df, verdict = scope.bind(df)
        df = df.withColumn(name, F.coalesce(verdict, F.lit(False)))
        frozen.append(name)
        return df, Scope(check=lambda url, tag, depth: F.col(name))
    if scope.operator == "leaf":
        return df, scope
    parts = []
    for part in scope.parts:
        df, kept = _freeze(part, df, frozen)
        parts.append(kept)
    return df, Scope(
        check=lambda url, tag, depth: _joined(scope.operator, [p.check(url, tag, depth) for p in parts]),
        uses_depth=True,
    )


def _joined(operator: str, verdicts):
    out = verdicts[0]
    for v in verdicts[1:]:
        out = (out & v) if operator == "and" else (out | v)
    return out


class _State:
    """Tables of one walk, below one folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self.buckets = 0
        self.tables: list[str] = []
        #: runs of visited URLs: first and last round, rows
        self.runs: list[tuple[int, int, int]] = []

    def begin(self, inputs: dict[str, str], on_change: str) -> None:
        """Remember what the walk is made of; a folder of another walk is refused or cleared."""
        marker = self.path("inputs")
        if storage.is_complete(self.spark, marker):
            known = json.loads(self.spark.read.text(marker, wholetext=True).first()[0])
            changed = sorted(k for k in {*known, *inputs} if known.get(k) != inputs.get(k))
            if not changed:
                return
            if on_change == "refuse":
                raise ValueError(f"{self.folder} holds a walk with another {', '.join(changed)}")
            storage.remove_tree(self.spark, self.folder)
        self.spark.createDataFrame([(json.dumps(inputs),)], "value string").coalesce(1).write.mode("overwrite").text(marker)

    def lay_out(self, edge_bytes: int) -> None:
        """Fix the number of buckets by the edges' size; a resumed walk keeps the one it began with."""
        layout = self.path("layout")
        if not storage.is_complete(self.spark, layout):
            few = min(self.spark.sparkContext.defaultParallelism, -(-edge_bytes // LEAST_BUCKET_BYTES))
            buckets = max(LEAST_BUCKETS, few, -(-edge_bytes // BUCKET_BYTES))
            self.spark.range(1).select(F.lit(buckets).alias("buckets")).write.mode("overwrite").parquet(layout)
        self.buckets = self.spark.read.parquet(layout).first()["buckets"]

    def path(self, name: str) -> str:
        return f"{self.folder}/{name}"

    def once(self, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        """Write a table unless an earlier run has, and read it back."""
        if not storage.is_complete(self.spark, self.path(name)):
            make().write.mode("overwrite").parquet(self.path(name))
        return self.spark.read.parquet(self.path(name))

    def _name(self, label: str) -> str:
        name = f"linkloom_{label}_{uuid.uuid4().hex[:12]}"
        self.tables.append(name)
        return name

    def bucketed_once(self, label: str, keys: list[str], make: Callable[[], DataFrame]) -> str:
        """A bucketed table of that content, dealt by its keys already; returns its catalog name."""
        path, name = self.path(label), self._name(label)
        if not storage.is_complete(self.spark, path):
            df = make()
            # small pages, so that a scan which names its keys skips most of a file
            writer = df.write.mode("overwrite").option("path", path).option("parquet.page.row.count.limit", 2_000)
            writer.bucketBy(self.buckets, *keys).sortBy(*keys).saveAsTable(name)
            return name
        schema = self.spark.read.parquet(path).schema
        self._create(name, path, schema, keys, None)
        return name

    def _create(self, name: str, path: str, schema, keys: list[str], partition: str | None) -> None:
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
        by = ", ".join(f"`{k}`" for k in keys)
        split = f"PARTITIONED BY (`{partition}`)" if partition else ""
        self.spark.sql(
            f"CREATE TABLE {name} ({columns}) USING parquet {split} "
            f"CLUSTERED BY ({by}) INTO {self.buckets} BUCKETS LOCATION '{path}'"
        )

    def visited_table(self, schema) -> str:
        """The visited rounds as one table, a partition per committed round."""
        name = self._name("visited")
        self._create(name, self.path("visited"), schema, ["url"], "round")
        k = 0
        while self.round_done(k) is not None:
            self._attach(name, k)
            k += 1
        return name

    def _round_path(self, k: int) -> str:
        return self.path(f"visited/round={k}")

    def _attach(self, table: str, k: int) -> None:
        self.spark.sql(f"ALTER TABLE {table} ADD IF NOT EXISTS PARTITION (round={k})")

    def round_done(self, k: int) -> int | None:
        """Rows of a committed round (from file footers), None if not committed."""
        if not storage.is_complete(self.spark, self._round_path(k)):
            return None
        # a schema is given because an empty round has no files
        return self.spark.read.schema("url string").parquet(self._round_path(k)).count()

    def commit_round(self, table: str, k: int, rows: DataFrame) -> None:
        """Write round ``k`` and make it a partition; a repeated write replaces it."""
        name = self._name("round")
        writer = rows.select("url", "tag", "depth", "parent").write.mode("overwrite")
        writer.option("path", self._round_path(k)).bucketBy(self.buckets, "url").saveAsTable(name)
        self._attach(table, k)

    def seen_table(self) -> str:
        """URLs of all committed rounds as one table, a partition per run."""
        name = self._name("seen")
        schema = self.spark.createDataFrame([], "url string, run string").schema
        self._create(name, self.path("runs"), schema, ["url"], "run")
        merged: dict[int, int] = {}
        for child in storage.children(self.spark, self.path("runs")):
            first, _, last = child.removeprefix("run=").partition("-")
            if storage.is_complete(self.spark, self.path(f"runs/{child}")):
                merged[int(first)] = max(int(last), merged.get(int(first), 0))
        k = 0
        while self.round_done(k) is not None:
            last = merged.get(k, k)
            self._add_run(name, k, last, sum(self.round_done(j) for j in range(k, last + 1)))
            k = last + 1
        return name

    def _run_path(self, first: int, last: int) -> str:
        return self._round_path(first) if first == last else self.path(f"runs/run={first}-{last}")

    def _add_run(self, table: str, first: int, last: int, rows: int) -> None:
        location = self._run_path(first, last)
        self.spark.sql(f"ALTER TABLE {table} ADD IF NOT EXISTS PARTITION (run='{first}-{last}') LOCATION '{location}'")
        self.runs.append((first, last, rows))

    def add_round(self, table: str, k: int) -> None:
        """Make round ``k`` a run; of many runs, merge the newest until the one before is much larger."""
        self._add_run(table, k, k, self.round_done(k))
        if len(self.runs) <= MAX_RUNS:
            return
        newest = [self.runs.pop()]
        rows = newest[0][2]
        while self.runs and (len(newest) < 2 or self.runs[-1][2] <= 2 * rows):
            newest.insert(0, self.runs.pop())
            rows += newest[0][2]
        first, last = newest[0][0], newest[-1][1]
        names = [f"{a}-{b}" for a, b, _ in newest]
        urls = self.spark.table(table).where(F.col("run").isin(names)).select("url")
        writer = urls.write.mode("overwrite").option("path", self._run_path(first, last))
        writer.bucketBy(self.buckets, "url").saveAsTable(self._name("run"))
        for run in names:
            self.spark.sql(f"ALTER TABLE {table} DROP IF EXISTS PARTITION (run='{run}')")
        self._add_run(table, first, last, rows)

    def drop_tables(self) -> None:
        for name in self.tables:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")


@dataclass
class _Open:
    """What the edges leave open: the normal form of their targets, and a filter of candidates by scope."""

    normalize: Callable[[DataFrame], DataFrame]
    in_scope: Callable[[DataFrame], DataFrame]


def _edge_table(links: DataFrame, scope: Scope) -> tuple[DataFrame, _Open]:
    """Edges, and what is left to do for each round's candidates."""
    columns = ["src_url", "url", "tag", "src_tag"]
    if not scope.joins_table():
        # one expression, made once: planning a chain of steps costs a small round more than its rows do
        normal = normalize_url(F.col("url"))

        def in_normal_form(df: DataFrame) -> DataFrame:
            others = [c for c in df.columns if c != "url"]
            return df.select(*others, settled(normal).alias("url")).filter(F.col("url").isNotNull())

        return links.filter(F.col("url").isNotNull()).select(*columns), _Open(in_normal_form, scope.filter)
    static, dynamic = _split_scope(scope)
    edges = candidates_in_scope(links, static)
    frozen: list[str] = []
    rest = []
    for part in dynamic:
        edges, kept = _freeze(part, edges, frozen)
        rest.append(kept)

    def by_rest(candidates: DataFrame) -> DataFrame:
        for part in rest:
            candidates = candidates.filter(part.check(F.col("url"), F.col("tag"), F.col("depth")))
        return candidates

    return edges.select(*columns, *frozen), _Open(lambda df: df, by_rest)


def _slots_of(df: DataFrame, hot: DataFrame) -> DataFrame:
    """``df`` with the number of slots that the edges of its ``src_url`` have.  Hot pages are few: broadcast."""
    found = df.join(F.broadcast(hot), F.xxhash64("src_url") == F.col("src_hash"), "left").drop("src_hash")
    return found.withColumn("slots", F.coalesce(F.col("slots"), F.lit(1)))


def _with_slots(edges: DataFrame, hot: DataFrame) -> DataFrame:
    """Edges with the key they are bucketed by: the source and, of a page with very many links, a slot."""
    spread = F.pmod(F.xxhash64("url"), F.col("slots")).cast("int")
    return _slots_of(edges, hot).withColumn("slot", spread).withColumn("key", _edge_key()).drop("slots")


def _edge_key() -> Column:
    return F.xxhash64("src_url", "slot")


def _each_slot(pages: DataFrame, hot: DataFrame) -> DataFrame:
    """Pages (``src_url``), a row for each slot of their edges."""
    every = F.explode(F.sequence(F.lit(0), F.col("slots") - 1))
    return _slots_of(pages, hot).withColumn("slot", every).withColumn("key", _edge_key()).drop("slots", "slot")


def _laid_out(edges: DataFrame, hot: DataFrame, pages: DataFrame | None, buckets: int) -> DataFrame:
    """Edges dealt by their key, those of ``pages`` (``url``) only if given.

    The same shuffle serves the check and the buckets, and slots spread the links of one page.
    """
    dealt = _with_slots(edges, hot).repartition(buckets, "key")
    if pages is None:
        return dealt
    known = _each_slot(pages.select(F.col("url").alias("src_url")), hot).withColumnsRenamed({"src_url": "page", "key": "page_key"})
    known = known.repartition(buckets, "page_key")
    # a key is a hash, so the address decides; said so that the key alone stays the join's
    same = F.coalesce(F.col("src_url") == F.col("page"), F.lit(False))
    return dealt.join(known, (F.col("key") == F.col("page_key")) & same, "left_semi")


def _sources(frontier: DataFrame, hot: DataFrame) -> DataFrame:
    """The frontier, a row for each slot of its edges."""
    named = frontier.select(F.col("url").alias("src_url"), F.col("tag").alias("from_tag"), F.col("depth").alias("from_depth"))
    return _each_slot(named, hot)


def _named_keys(sources: DataFrame, rows: int) -> list[int] | None:
    """The edge keys of a small frontier (of ``rows`` rows), None of a larger one."""
    if rows > NAMED_KEYS:
        return None
    keys = [r["key"] for r in sources.select("key").distinct().limit(NAMED_KEYS + 1).collect()]
    return keys if len(keys) <= NAMED_KEYS else None


def _expand(sources: DataFrame, edges: DataFrame, keys: list[int] | None) -> DataFrame:
    """Join the frontier to its edges by their key; ``keys`` are all there are, if given."""
    if keys is not None:
        edges = edges.where(F.col("key").isin(keys))
    from_url = sources.withColumnRenamed("src_url", "from_url")
    joined = edges.join(from_url, "key")
    # a key is a hash, so the address decides; said so that the key alone stays the join's
    same = F.coalesce(F.col("src_url") == F.col("from_url"), F.lit(False))
    valid = F.col("src_tag").isNull() | (F.col("src_tag") == F.col("from_tag"))
    return joined.filter(same & valid).withColumn("depth", F.col("from_depth") + 1).withColumn("parent", F.col("src_url"))


def _reduced(found: DataFrame) -> DataFrame:
    """Found rows, the least parent of equal ones.

    Rows are grouped by a number before the text: addresses share their first
    letters, which are all that a sort compares fast.
    """
    equal = [c for c in found.columns if c != "parent"]
    least = found.groupBy(F.xxhash64("url").alias("__hash"), *equal).agg(F.min("parent").alias("parent"))
    return least.drop("__hash")


def _after_all(in_scope: Callable[[DataFrame], DataFrame], candidates: DataFrame) -> DataFrame:
    """``candidates`` in scope, tested here: Catalyst would ask every edge, far below their reduction.

    A settled copy of the address is tested, and the one that rows are dealt by is kept.
    """
    kept = candidates.columns
    others = [c for c in kept if c != "url"]
    apart = candidates.select(*others, F.col("url").alias("__dealt"), settled(F.col("url")).alias("url"))
    return in_scope(apart).select(*others, F.col("__dealt").alias("url"))


def _inputs(seeds: DataFrame, keyed: _Corpus, scope: Scope, links: DataFrame | None, handler: Handler | None, version: str | None) -> dict[str, str]:
    """What a walk is made of, each as a short text.  Bodies are not read: ``version`` speaks for them."""
    code = getattr(handler, "__code__", None)
    return {
        "seeds": content_digest(seeds.select("url", "tag", "depth")),
        "corpus": version or content_digest(keyed.heads.drop("parts")),
        "links": content_digest(links.select("src_url", "url", "tag")) if links is not None else "",
        "handler": handler and hashlib.sha256(code.co_code if code else repr(handler).encode()).hexdigest() or "",
        "scope": hashlib.sha256(scope.describe().encode()).hexdigest(),
    }


def walk(
    seeds: DataFrame,
    corpus: DataFrame,
    scope: Scope,
    *,
    links: DataFrame | None = None,
    handler: Handler | None = None,
    order_by: str | None = None,
    max_rounds: int | None = None,
    max_attempts: int | None = None,
    state_dir: str | None = None,
    keep: bool = False,
    hot_links: int = HOT_LINKS,
    on_change: str = "refuse",
    corpus_version: str | None = None,
) -> WalkResult:
    """Follow links from ``seeds`` through ``corpus`` until nothing new is in scope.

    ``corpus`` is a fetch log or page table with ``url, status, location,
    content_type, body``; with an ``attempt`` column (from 0) later attempts
    answer retries, all of them or up to ``max_attempts``.  ``order_by`` names a
    column deciding between rows with the same URL (needed only if there are any).
    ``links`` (``src_url, url, tag``) replaces extraction from bodies;
    ``handler`` makes such links from the saved responses.

    ``state_dir`` makes a walk restartable: called again with the same folder,
    it goes on after the last finished round.  Intermediate tables are removed
    at the end unless ``keep``; the visited table stays, as it is the result.
    If the folder's walk had another scope, corpus (all but its bodies), seeds, links or handler,
    ``on_change`` says whether to ``refuse`` or to ``rebuild``; ``corpus_version``, if given, stands for the corpus, which
    is then not read for this.
    """
    if on_change not in ("refuse", "rebuild"):
        raise ValueError(f"unknown on_change {on_change!r}")
    spark = corpus.sparkSession
    # a folder of our own: what else lies in the caller's is neither read nor removed
    folder = f"{state_dir.rstrip('/')}/linkloom-state" if state_dir else storage.fresh_dir(spark, "walk")
    state = _State(spark, folder)
    keyed = _keyed(corpus, order_by, max_attempts)
    if state_dir:
        state.begin(_inputs(seeds, keyed, scope, links, handler, corpus_version), on_change)

    # what the edges leave open of the scope refers to their columns, so it is
    # rebuilt when a walk resumes; that reads no more than a bounded part of its prefixes
    plan, left = _edge_table(outgoing_links(keyed, handler, links), scope)
    if not storage.is_complete(spark, state.path("links")):
        storage.remove_tree(spark, state.path("edges"))  # of an earlier layout, if any
    staged = state.once("links", lambda: plan)
    hot = state.once(
        "hot_pages",
        lambda: staged.groupBy(F.xxhash64("src_url").alias("src_hash"))
        .agg(F.count("*").alias("n"))
        .filter(F.col("n") > hot_links)
        .select("src_hash", F.ceil(F.col("n") / hot_links).cast("int").alias("slots")),
    )
    if state.round_done(0) is None:
        # an unfinished beginning under another layout is written anew
        state.lay_out(storage.byte_size(spark, state.path("links")))
    else:
        state.lay_out(0)
    saved = None if links is None else keyed.heads.filter(F.col("status") < 400)
    edges = spark.table(state.bucketed_once("edges", ["key"], lambda: _laid_out(staged, hot, saved, state.buckets)))
    decided = [c for c in edges.columns if c not in ("src_url", "url", "tag", "src_tag", "slot", "key")]
    visited = state.visited_table(
        spark.createDataFrame([], "url string, tag int, depth int, parent string, round int").schema
    )
    seen = state.seen_table()

    rounds = 0
    if state.round_done(0) is None:
        start = candidates_in_scope(seeds.select("url", "tag", "depth", F.lit("").alias("parent")), scope)
        state.commit_round(visited, 0, first_seen(start, "parent"))
        state.add_round(seen, 0)
    named = spark.conf.get(IN_FILTER_SETTING)
    while (rows := state.round_done(rounds)) and (max_rounds is None or rounds < max_rounds):
        if state.round_done(rounds + 1) is None:
            frontier = spark.table(visited).filter(F.col("round") == rounds).select("url", "tag", "depth")
            sources = _sources(frontier, hot)
            keys = _named_keys(sources, rows)
            if keys is not None:
                spark.conf.set(IN_FILTER_SETTING, NAMED_KEYS)
            try:
                found = _expand(sources, edges, keys).select("url", "tag", "depth", "parent", *decided)
                unseen = anti_join_seen(left.normalize(_reduced(found)), spark.table(seen))
                state.commit_round(visited, rounds + 1, first_seen(_after_all(left.in_scope, unseen), "parent"))
            finally:
                spark.conf.set(IN_FILTER_SETTING, named)
            state.add_round(seen, rounds + 1)
        rounds += 1

    complete = not state.round_done(rounds)
    state.drop_tables()
    if not keep:
        for name in ("links", "hot_pages", "edges", "runs"):
            storage.remove_tree(spark, state.path(name))
    found = spark.read.parquet(state.path("visited")).select("url", "tag", "depth", "parent")
    answered = keyed.answered()
    answers = answered.select("url", *[c for c in answered.columns if c not in ("url", "tag", "depth", "parent")])
    return WalkResult(found, lookup_responses(found, answers), rounds, folder, complete)
