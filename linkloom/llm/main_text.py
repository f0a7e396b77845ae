"""Main text of web pages: runs repeated across a host's pages go, unique runs and marked articles stay.

A page has two token streams, the words and block tags of its marked article and those outside it.  The
suffixes of a host's streams are sorted by their first tokens, which is the
host's suffix array as far as runs of that length go: neighbours that agree there and lie
on distinct pages are a repeated substring, and consecutive ones a longer one.  Spark sorts and reduces
the suffixes by host and prefix, so no host meets in one place.  A marked article stays whatever repeats
in it, so its suffixes take part where they agree with one outside an article.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pandas.util import hash_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.llm.common import written
from linkloom.llm.page_blocks import MAIN, MARKED, blocks

#: shared suffixes that may be broadcast (8 bytes each)
BROADCAST_SUFFIXES = 4_000_000
#: pages whose articles are taken apart at once
SLICE_PAGES = 256
_HOST = re.compile(r"://([^/?#]*)", re.S)
_FACTOR = np.uint64(0x9E3779B97F4A7C15)
_SHIFT = np.uint64(29)

PARSED = (
    "page_id long, url string, main string, main_tags array<string>, has_main boolean, blocks array<string>, marked array<boolean>,"
    " sizes array<int>, content long, suffixes array<long>"
)


def host(url: str | None) -> str:
    """What stands after the first ``://``, up to ``/``, ``?`` or ``#``, A-Z lower-cased."""
    found = _HOST.search(url or "")
    return re.sub("[A-Z]+", lambda m: m.group().lower(), found[1]) if found else ""


def _hashes(words: list[str]) -> np.ndarray:
    # the hash would end at a NUL, for which browsers show the replacement character
    if any("\0" in w for w in words):
        words = [w.replace("\0", "\ufffd") for w in words]
    return hash_array(np.array(words, object)) if words else np.zeros(0, np.uint64)


def _prefix_keys(tokens: np.ndarray, hosts: np.ndarray, least: int) -> np.ndarray:
    """A key of the host and of the first ``least`` tokens of the suffix at each place."""
    n = len(tokens) - least + 1
    key = hosts[: max(n, 0)].copy()
    for k in range(least):
        key = (key ^ tokens[k : k + max(n, 0)]) * _FACTOR
        key ^= key >> _SHIFT
    return key.view(np.int64)


def _suffixes(words: list[str], counts: np.ndarray, hosts: list[str], least: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the suffixes of streams that lie on end, and how many each stream has; suffixes end with their stream."""
    keys = _prefix_keys(_hashes(words), np.repeat(_hashes(hosts), counts), least)
    left = np.repeat(np.cumsum(counts), counts) - np.arange(len(words))
    return keys[left[: len(keys)] >= least], np.maximum(counts - least + 1, 0)


def _parse(batch: pa.RecordBatch, least: int) -> pa.RecordBatch:
    ids, urls, pages = (batch.column(c) for c in ("page_id", "url", "html"))
    mains, main_tags, has_main, texts, marked, sizes, words, contents = [], [], [], [], [], [], [], []
    per_page = []
    for html in pages.to_pylist():
        found = blocks(html or "")
        main = [b.text for b in found if b.role == MAIN]
        main_tags.append([b.tag for b in found if b.role == MAIN])
        rest = [b for b in found if b.role != MAIN]
        mains.append("\n".join(main))
        has_main.append(bool(main))
        texts.append([b.text for b in rest])
        marked.append([b.role == MARKED for b in rest])
        before = len(words)
        of = []
        for b in rest:
            tokens = b.text.split(" ")
            words.append(f"<{b.tag}>")
            words += tokens
            of.append(1 + len(tokens))
        sizes.append(of)
        per_page.append(len(words) - before)
        contents.append("\n".join([*main, "\v", *texts[-1]]))
    keys, own = _suffixes(words, np.array(per_page, np.int64), [host(u) for u in urls.to_pylist()], least)
    ends = np.concatenate(([0], np.cumsum(own))).astype(np.int32)
    return pa.RecordBatch.from_arrays(
        [
            ids,
            urls,
            pa.array(mains, pa.string()),
            pa.array(main_tags, pa.list_(pa.string())),
            pa.array(has_main),
            pa.array(texts, pa.list_(pa.string())),
            pa.array(marked, pa.list_(pa.bool_())),
            pa.array(sizes, pa.list_(pa.int32())),
            pa.array(_hashes(contents).view(np.int64)),
            pa.ListArray.from_arrays(pa.array(ends), pa.array(keys)),
        ],
        ["page_id", "url", "main", "main_tags", "has_main", "blocks", "marked", "sizes", "content", "suffixes"],
    )


def parse_pages(pages: DataFrame, least: int) -> DataFrame:
    """``page_id, url``, the marked main text, the other blocks, and the suffix keys of the stream outside."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield _parse(batch, least)

    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").mapInArrow(run, PARSED)


def _article_suffixes(parsed: DataFrame, least: int, known=None) -> DataFrame:
    """``suffix, content`` of the streams inside marked articles; if ``known`` (sorted, broadcast) is given, of those only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_PAGES):
                urls, mains, tags, contents = (c.to_pylist() for c in batch.slice(at, SLICE_PAGES).columns)
                words, counts = [], []
                for main, of in zip(mains, tags):
                    before = len(words)
                    for tag, text in zip(of, main.split("\n")):
                        words.append(f"<{tag}>")
                        words += text.split(" ")
                    counts.append(len(words) - before)
                keys, own = _suffixes(words, np.array(counts, np.int64), [host(u) for u in urls], least)
                content = np.repeat(np.array(contents, np.int64), own)
                if known is not None:
                    hit = _among(known.value, keys)
                    keys, content = keys[hit], content[hit]
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(content)], ["suffix", "content"])

    marked = parsed.where("has_main").select("url", "main", "main_tags", "content")
    return marked.mapInArrow(run, "suffix long, content long")


def _among(keys: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Which values are among the sorted keys."""
    at = np.minimum(np.searchsorted(keys, values), max(len(keys) - 1, 0))
    return keys[at] == values if len(keys) else np.zeros(len(values), bool)


def _sorted_keys(keys: DataFrame):
    """The ``suffix`` column, sorted and broadcast."""
    return keys.sparkSession.sparkContext.broadcast(np.sort(keys.select("suffix").toArrow()["suffix"].to_numpy()))


def shared_suffixes(parsed: DataFrame, least: int, broadcast_suffixes: int = BROADCAST_SUFFIXES) -> DataFrame:
    """``suffix``: keys outside marked articles at which suffixes of distinct pages of a host agree, in or outside of articles.

    Pages of equal text are one page.
    """
    spread = [F.min("content").alias("lo"), F.max("content").alias("hi")]
    rows = parsed.select(F.explode("suffixes").alias("suffix"), "content")
    outside = written(rows.groupBy("suffix").agg(*spread), "outside-suffixes")
    if outside.count() <= broadcast_suffixes:
        inside = _article_suffixes(parsed, least, _sorted_keys(outside))
    else:
        inside = _article_suffixes(parsed, least).join(outside, "suffix", "left_semi")
    inside = inside.groupBy("suffix").agg(*spread)
    both = outside.unionByName(inside).groupBy("suffix").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    return both.where("lo <> hi").select("suffix")


def _covered(at: np.ndarray, sizes: np.ndarray, least: int) -> np.ndarray:
    """Tokens of each block that lie in repeated runs; ``at``: the places of the page's shared suffixes."""
    edges = np.zeros(int(sizes.sum()) + 1, np.int64)
    np.add.at(edges, at, 1)
    np.add.at(edges, at + least, -1)
    inside = np.cumsum(edges[:-1]) > 0
    ends = np.concatenate(([0], np.cumsum(sizes)))
    counts = np.concatenate(([0], np.cumsum(inside)))
    return counts[ends[1:]] - counts[ends[:-1]]


def _judge(least: int, share: float, places):
    """An Arrow function: the text of pages that mark none, and how many tokens outside lie in repeated runs."""

    @F.arrow_udf("struct<text: string, n_outside: long, n_repeated: long>")
    def judge(texts: pa.Array, marked: pa.Array, sizes: pa.Array, shared: pa.Array) -> pa.Array:
        out = []
        for ts, marks, of, at in zip(texts.to_pylist(), marked.to_pylist(), sizes, places(shared)):
            of = of.values.to_numpy()
            covered = _covered(at, of, least)
            # a block stays if most of it is unique and no mark says what else it is
            kept = None if ts is None else [t for t, mark, n, c in zip(ts, marks, of, covered) if not mark and c <= share * n]
            text = None if kept is None else "\n".join(kept)
            out.append({"text": text, "n_outside": int(of.sum()), "n_repeated": int(covered.sum())})
        return pa.array(out, pa.struct([("text", pa.string()), ("n_outside", pa.int64()), ("n_repeated", pa.int64())]))

    return judge


def main_text(pages: DataFrame, least: int = 6, share: float = 0.5, broadcast_suffixes: int = BROADCAST_SUFFIXES) -> DataFrame:
    """``page_id, url, text, n_chars, n_outside, n_repeated`` of every page.

    ``text`` is the page's marked article, whole (:func:`linkloom.llm.page_blocks.blocks`
    says what is marked); of a page that marks none, its blocks but for those marked
    as something else and those of which more than ``share`` lies in runs of ``least`` tokens or more (words, and a
    tag for each block) that stand on another page of the host too, inside or outside its article.  Blocks are joined by one line break.  ``n_outside`` counts
    the tokens outside the marked article, ``n_repeated`` those of them in repeated runs.

    A null or empty page has an empty text, as has one that is all repeated; a null url has the empty host; pages of
    equal text count as one page, so copies do not repeat each other; repeated
    ids have a row each; very long pages are read whole; an empty table gives no
    rows; other columns are ignored.
    """
    parsed = written(parse_pages(pages, least).withColumn("row", F.monotonically_increasing_id()), "pages", compact=True)
    shared = written(shared_suffixes(parsed, least, broadcast_suffixes), "shared-suffixes")
    inputs = [F.when(~F.col("has_main"), F.col("blocks")), "marked", "sizes"]
    if shared.count() <= broadcast_suffixes:
        values = _sorted_keys(shared)

        def places(own: pa.Array) -> list[np.ndarray]:
            hit = _among(values.value, own.flatten().to_numpy(zero_copy_only=False))
            return [np.flatnonzero(x) for x in np.split(hit, np.cumsum([len(x) for x in own])[:-1])]

        joined, shares = parsed, "suffixes"
    else:

        def places(own: pa.Array) -> list[np.ndarray]:
            return [np.array(x or [], np.int64) for x in own.to_pylist()]

        # narrow rows meet the shared suffixes; a page's places come back to it
        hits = parsed.select("row", F.posexplode("suffixes").alias("at", "suffix")).join(shared, "suffix")
        hits = written(hits.groupBy("row").agg(F.collect_set("at").alias("hits")), "page-repeats")
        joined, shares = parsed.join(hits, "row", "left"), "hits"
    done = joined.select("page_id", "url", "main", _judge(least, share, places)(*inputs, shares).alias("t"))
    text = F.coalesce("t.text", "main")
    return done.select("page_id", "url", text.alias("text"), F.length(text).cast("long").alias("n_chars"), "t.n_outside", "t.n_repeated")
