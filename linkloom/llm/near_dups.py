"""Near duplicates: SuperMinHash signatures, banding, verification, union-find.

Documents with the same shingle set are one node.  Nodes that agree in a band of
their signatures are candidates; a bucket's candidates are compared with a pivot,
not with each other; members that stay in other components meet further pivots.
Where buckets still hold several components after that, all their members are
joined exactly, on the shingles that are rare among them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pandas.util import hash_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from linkloom.llm import tokens
from linkloom.llm.common import byte_slices, give_back, text_key, written
from linkloom.llm.components import components

#: words a shingle
WIDTH = 5
#: signature length and rows a band: at similarity 0.75 all 32 bands miss with probability 5e-6
PLACES, ROWS = 128, 4
#: bytes of text made into shingles at once
SLICE_BYTES = 512 << 10
#: a link is compared in full if this share of the signature agrees; at 0.75 the estimate
#: falls below it with probability 4e-6 (it is 5 deviations off)
LIKELY = 0.55
#: pivots more that a bucket gives to the members the first one left apart
MORE_PIVOTS = 3
#: from this many documents on, a shingle's count decides how late it comes in the exact join's order
OFTEN = 16
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
_R40 = np.uint64((1 << 40) - 1)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M2
    x = (x ^ (x >> np.uint64(27))) * _M1
    return x ^ (x >> np.uint64(31))


def shingle_sets(texts: pa.Array, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """Sorted 64-bit hashes of each text's distinct shingles, all on end, and where each text's begin.

    Words are what stands between ASCII white space, A-Z lower-cased.  Fewer than
    ``width`` words are one shingle; null and empty texts have none.
    """
    # lowered before the cast: of a slice, Arrow's cast keeps offsets that its lower-casing gets wrong
    words = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")).cast(pa.large_string()))
    coded = words.flatten().dictionary_encode()
    of = np.repeat(np.arange(len(texts)), np.diff(words.offsets.to_numpy()))
    codes = coded.indices.to_numpy(zero_copy_only=False)
    names = coded.dictionary.to_numpy(zero_copy_only=False).astype(object)
    if len(names):
        real = (names != "")[codes]
        of, codes = of[real], codes[real]
    if not len(codes):
        return np.zeros(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
    h = hash_array(names, categorize=False)[codes]
    sizes = np.bincount(of, minlength=len(texts))
    first = np.cumsum(sizes) - sizes
    rolled = np.full(len(h), width, np.uint64)
    for k in range(width):
        rolled = rolled * _M1 + np.concatenate((_mix(h[k:]), np.zeros(min(k, len(h)), np.uint64)))
    whole = np.flatnonzero((sizes > 0) & (sizes < width))
    valid = np.arange(len(h)) - first[of] <= (sizes - width)[of]
    rolled, owner = _mix(rolled[valid]), of[valid]
    if len(whole):
        short = np.zeros(len(whole), np.uint64)
        for i, d in enumerate(whole):
            short[i] = xxhash.xxh3_64_intdigest(h[first[d] : first[d] + sizes[d]].tobytes())
        rolled, owner = np.concatenate((rolled, short)), np.concatenate((owner, whole))
    order = np.lexsort((rolled, owner))
    rolled, owner = rolled[order], owner[order]
    new = np.ones(len(rolled), bool)
    new[1:] = (rolled[1:] != rolled[:-1]) | (owner[1:] != owner[:-1])
    return rolled[new], np.searchsorted(owner[new], np.arange(len(texts) + 1))


def super_minhash(hashes: np.ndarray, bounds: np.ndarray, places: int = PLACES) -> np.ndarray:
    """SuperMinHash signatures as 16-bit codes, a row per set (rows of empty sets mean nothing).

    A row holds the codes' high bytes, then their low ones: the high bytes alone
    estimate a similarity, and are half of what a comparison has to carry.

    In step j every element throws a value of rank j at one place of its own random
    permutation, so ranks are correlated over the places; a place keeps its least
    value.  A set stops once its worst place holds a rank that later steps cannot
    beat, which is after one step for sets much larger than the signature.
    """
    n = len(bounds) - 1
    of = np.repeat(np.arange(n), np.diff(bounds))
    best = np.full((n, places), np.uint64((1 << 64) - 1))
    flat = best.reshape(-1)
    live = np.arange(len(hashes))
    permutation: np.ndarray | None = None
    for j in range(places):
        x = _mix(hashes[live] + np.uint64((j + 1) * int(_M1) % (1 << 64)))
        k = j + (((x >> np.uint64(40)) * np.uint64(places - j)) >> np.uint64(24)).astype(np.int64)
        if j == 0:
            place = k
        else:
            rows = np.arange(len(live))
            place = permutation[rows, k].astype(np.int64)
            permutation[rows, k] = permutation[rows, j]
            permutation[rows, j] = place
        np.minimum.at(flat, of[live] * places + place, (np.uint64(j) << np.uint64(40)) | (x & _R40))
        open_sets = (best.max(axis=1) >> np.uint64(40)) > np.uint64(j)
        still = open_sets[of[live]]
        if not still.any():
            break
        if j == 0:
            k, live = k[still], live[still]
            permutation = np.tile(np.arange(places, dtype=np.uint8 if places <= 256 else np.uint16), (len(live), 1))
            rows = np.arange(len(live))
            permutation[rows, 0] = k
            permutation[rows, k] = 0
        else:
            live, permutation = live[still], permutation[still]
    codes = _mix(best)
    return np.hstack([(codes >> np.uint64(shift)).astype(np.uint8) for shift in (56, 48)])


def _sliced(batches: Iterator[pa.RecordBatch], *texts: str) -> Iterator[pa.RecordBatch]:
    """The rows in small batches, between which a task holds little; what others left in its worker goes first, its own at the end."""
    tokens.release()
    give_back()
    for batch in batches:
        yield from byte_slices(batch, list(texts or ["text"]), SLICE_BYTES * max(len(texts), 1))
    give_back()


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in _sliced(batches):
        hashes, bounds = shingle_sets(batch.column("text"))
        sizes = np.diff(bounds)
        steps = range(0, batch.num_rows, 512)  # bounds the permutations' memory
        parts = [bounds[i : i + 513] for i in steps]
        codes = [row for p in parts for row in super_minhash(hashes[p[0] : p[-1]], p - p[0])]
        prints = [xxhash.xxh3_128_digest(hashes[a:b].tobytes()) for a, b in zip(bounds[:-1], bounds[1:])]
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"),
                batch.column("key_text"),
                pa.array(sizes),
                pa.array([p if n else None for p, n in zip(prints, sizes)], pa.binary()),
                pa.array([c.tobytes() if n else None for c, n in zip(codes, sizes)], pa.binary()),
            ],
            ["doc_id", "key_text", "n_shingles", "set_hash", "codes"],
        )


def sign(docs: DataFrame) -> DataFrame:
    """``doc_id, key_text, n_shingles, set_hash, codes`` per row; the last two are null for texts without words."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", text_key(F.col("text")).alias("key_text"))
    return rows.mapInArrow(_sign, "doc_id long, key_text long, n_shingles long, set_hash binary, codes binary")


def _agreement(a: pa.Array, b: pa.Array) -> pa.Array:
    x, y = (np.frombuffer(b"".join(c.to_pylist()), np.uint8).reshape(len(c), -1) for c in (a, b))
    return pa.array((x == y).mean(axis=1) if len(a) else np.zeros(0))


def _linked(percent: int):
    """Keeps ``a, b`` rows whose texts' full shingle sets have the similarity asked for."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _sliced(batches, "text_a", "text_b"):
            coded = [batch.column(c).dictionary_encode() for c in ("text_a", "text_b")]
            sets = [shingle_sets(c.dictionary) for c in coded]
            at = [c.indices.to_numpy() for c in coded]
            keep = []
            for i, j in zip(*at):
                x, y = (h[b[k] : b[k + 1]] for (h, b), k in zip(sets, (i, j)))
                common = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * common >= percent * (len(x) + len(y) - common) and len(x) > 0)
            yield pa.RecordBatch.from_arrays(
                [batch.column(c).filter(pa.array(keep, pa.bool_())) for c in ("a", "b")], ["a", "b"]
            )

    return check


def verified(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, percent: int) -> DataFrame:
    """The ``a, b`` rows of ``pairs`` that are links: by signatures, and then by the full sets."""
    agreement = F.arrow_udf(_agreement, "double")
    high = F.substring("codes", 1, PLACES)
    side = {c: nodes.select(F.col("id").alias(c), high.alias(f"codes_{c}")) for c in "ab"}
    likely = pairs.join(side["b"], "b").join(side["a"], "a").where(agreement("codes_a", "codes_b") >= LIKELY)
    likely = written(likely.select("a", "b"), "likely")
    wanted = likely.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(wanted, "doc_id", "left_semi")
    texts = written(texts, "candidate-texts")
    side = {c: texts.select(F.col("doc_id").alias(c), F.col("text").alias(f"text_{c}")) for c in "ab"}
    return likely.join(side["b"], "b").join(side["a"], "a").mapInArrow(_linked(percent), "a long, b long")


def _pairs(rows: DataFrame, percent: int) -> DataFrame:
    """Distinct ``a < b`` of ``id, n, pivot, pivot_n`` rows whose sizes allow a link."""
    alike = f"100 * least(n, pivot_n) >= {percent} * greatest(n, pivot_n)"
    pairs = rows.where("id <> pivot").where(alike).select(F.least("id", "pivot").alias("a"), F.greatest("id", "pivot").alias("b"))
    return written(pairs.distinct(), "pairs")


def _stars(roots: DataFrame) -> DataFrame:
    """Components as links: every node's to its root, which stand for all links found so far."""
    return roots.select(F.col("id").alias("a"), F.col("root").alias("b"))


def _split_buckets(members: DataFrame, roots: DataFrame) -> DataFrame:
    """``members`` of buckets with several components, with ``root, largest``."""
    placed = members.join(roots, "id", "left").select(*members.columns, F.coalesce("root", "id").alias("root"))
    placed = written(placed, "placed")
    sizes = placed.groupBy("bucket", "root").count().groupBy("bucket")
    largest = sizes.agg(F.max(F.struct("count", "root")).alias("m"), F.count(F.lit(1)).alias("roots"))
    largest = largest.where("roots > 1").select("bucket", F.col("m.root").alias("largest"))
    return written(placed.join(largest, "bucket"), "split-buckets")


def _shingle_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in _sliced(batches):
        hashes, bounds = shingle_sets(batch.column("text"))
        n = np.diff(bounds)
        keys = [xxhash.xxh3_64_intdigest(hashes[a:b].tobytes()) for a, b in zip(bounds[:-1], bounds[1:])]
        columns = [batch.column("doc_id").to_numpy(), np.array(keys, np.uint64).view(np.int64), n]
        columns = [np.repeat(c, n) for c in columns] + [hashes.view(np.int64)]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["id", "key", "n", "bucket"])


def _rare_shingles(ids: DataFrame, docs: DataFrame, percent: int) -> DataFrame:
    """``bucket, id, n, rank``: the rarest shingles of every text, of which links must share one.

    Ranks count from 1 in one common order of all shingles, the rarest first.  Sets
    that have the similarity asked for share one of the first ``n - ceil(t n) + 1``
    of either; a passage that many documents share comes last.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    texts = texts.join(ids.withColumnRenamed("id", "doc_id"), "doc_id", "left_semi")
    rows = written(texts.mapInArrow(_shingle_rows, "id long, key long, n long, bucket long"), "shingles")
    often = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("often")).where(F.col("often") >= OFTEN)
    order = Window.partitionBy("id", "key").orderBy(F.coalesce("often", F.lit(0)), "bucket")
    ranked = rows.join(often, "bucket", "left").withColumn("rank", F.row_number().over(order))
    return ranked.where(f"rank <= n - ({percent} * n + 99) div 100 + 1").select("bucket", "id", "n", "rank")


def _compare_rest(members: DataFrame, roots: DataFrame, nodes: DataFrame, docs: DataFrame, percent: int) -> DataFrame:
    """``id, root`` over all links, after the first pivots' comparisons left some members in components of their own.

    First every bucket gives its other members some more pivots of its largest
    component.  The members of buckets that are still split, mostly texts that only
    share a passage, are joined on their rare shingles; members of a shingle's
    largest component meet only those outside it.
    """
    split = _split_buckets(members, roots)
    if split.isEmpty():
        return roots
    drawn = [
        F.min(F.struct(F.xxhash64("id", "bucket", F.lit(k)).alias("h"), F.col("id").alias("pivot"), F.col("n").alias("pivot_n")))
        for k in range(MORE_PIVOTS)
    ]
    pivots = split.where("root = largest").groupBy("bucket").agg(F.array_distinct(F.array(*drawn)).alias("p"))
    rows = split.where("root <> largest").join(pivots, "bucket").select("id", "n", F.inline("p"))
    pairs = _pairs(rows, percent)
    roots = components(_stars(roots).unionByName(verified(pairs, nodes, docs, percent)))
    split = _split_buckets(split.select("bucket", "id", "n"), roots)
    if split.isEmpty():
        return roots
    rare = _split_buckets(_rare_shingles(split.select("id").distinct(), docs, percent), roots)
    outside = rare.where("root <> largest").select(
        "bucket", F.col("root").alias("pivot_root"), F.col("id").alias("pivot"), F.col("n").alias("pivot_n"), F.col("rank").alias("pivot_rank")
    )
    # what two sets can share from their first common shingle on, and what a link must share
    met = (
        rare.join(outside, "bucket")
        .where("root <> pivot_root and (root = largest or id < pivot)")
        .where(f"(least(n - rank, pivot_n - pivot_rank) + 1) * (100 + {percent}) >= {percent} * (n + pivot_n)")
    )
    return components(_stars(roots).unionByName(verified(_pairs(met, percent), nodes, docs, percent)))


def near_duplicates(docs: DataFrame, percent: int = 75) -> DataFrame:
    """The near-duplicate component of every document.  Very long texts are compared whole.

    Documents whose distinct 5-word shingles have a Jaccard similarity of
    ``percent`` or more are linked.  Returns ``doc_id, n_shingles, component_id,
    kept``: the smallest ``doc_id`` reachable over links, and whether it is the
    row's own.  Null texts and texts without words are linked with nothing.  Rows
    that repeat an id are judged by their own texts; rows with a null id take no
    part: their ``component_id`` is null and they are kept.  Other columns are
    ignored; an empty table gives no rows.
    """
    return _judged(docs, percent).drop("key_text")


def _judged(docs: DataFrame, percent: int) -> DataFrame:
    """``doc_id, key_text, n_shingles, component_id, kept`` of every row."""
    signed = written(sign(docs), "signed")
    classes = (
        signed.where("n_shingles > 0 and doc_id is not null")
        .groupBy("set_hash")
        .agg(
            F.min("doc_id").alias("id"),
            F.count(F.lit(1)).alias("size"),
            F.first("n_shingles").alias("n"),
            F.first("codes").alias("codes"),
        )
    )
    nodes = written(classes, "nodes")
    planes = [F.lit(0), F.lit(PLACES)]
    band = F.transform(
        F.sequence(F.lit(0), F.lit(PLACES // ROWS - 1)),
        lambda b: F.xxhash64(b, *(F.substring(F.col("codes"), plane + b * ROWS + 1, F.lit(ROWS)) for plane in planes)),
    )
    banded = nodes.select(F.explode(band).alias("bucket"), "id", "n")
    one = F.struct("id", "n")
    buckets = banded.groupBy("bucket").agg(F.min(one).alias("pivot"), F.max(one).alias("other"), F.count(F.lit(1)).alias("size"))
    buckets = written(buckets.where("size > 1"), "buckets")
    pivot = [F.col("pivot.id").alias("pivot"), F.col("pivot.n").alias("pivot_n")]
    members = written(banded.join(buckets.where("size > 2").select("bucket", *pivot), "bucket"), "members")
    pairs = buckets.where("size = 2").select("other.*", *pivot)
    pairs = _pairs(pairs.unionByName(members.drop("bucket")), percent)
    roots = components(verified(pairs, nodes, docs, percent))
    roots = _compare_rest(members.select("bucket", "id", "n"), roots, nodes, docs, percent)
    labels = (
        nodes.join(roots, "id", "left")
        .where("size > 1 or root is not null")
        .select("set_hash", F.coalesce("root", "id").alias("component_id"))
    )
    labels = written(labels, "labels")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return signed.join(labels, "set_hash", "left").select(
        "doc_id",
        "key_text",
        "n_shingles",
        component.alias("component_id"),
        F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"),
    )


def drop_near_duplicates(docs: DataFrame, percent: int = 75) -> DataFrame:
    """The documents that stay, one of each component, with all their columns.

    Of rows that repeat an id, those go whose own text is in another's component;
    rows with a null id and rows equal in id and text all stay.
    """
    gone = _judged(docs, percent).where("not kept").select(F.col("doc_id").alias("__gone"), F.col("key_text").alias("__text")).distinct()
    keyed = docs.withColumn("__key", text_key(F.col("text")))
    same = (F.col("doc_id") == F.col("__gone")) & (F.col("__key") == F.col("__text"))
    return keyed.join(gone, same, "left_anti").select(*docs.columns)
