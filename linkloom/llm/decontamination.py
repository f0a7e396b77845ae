"""Benchmark decontamination: windows of benchmark words looked up in every document.

Everything runs in the JVM.  The distinct window hashes of the benchmark are a
broadcast hash set as long as their measured number allows it, and a shuffled one
beyond; hits are verified word by word before they count.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkloom.llm.common import ascii_lower, text_key, written

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: the same words before lower-casing
CASED_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: window hashes that may be broadcast (16 bytes each, some 100 MB with the table around them)
BROADCAST_WINDOWS = 2_000_000
#: documents with hits whose keys may be broadcast to fetch their texts
BROADCAST_DOCUMENTS = 1_000_000


def words(text: Column) -> Column:
    return F.regexp_extract_all(ascii_lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


def _windows(array: Column, size: Column, length: int, of) -> Column:
    """``of(position, window)`` for every window of ``length`` items, positions from 0."""
    positions = F.when(size >= length, F.sequence(F.lit(0), size - length)).otherwise(F.array().cast("array<int>"))
    return F.transform(positions, lambda i: of(i, F.slice(array, i + 1, length)))


def benchmark_windows(benchmark: DataFrame, n: int) -> DataFrame:
    """``len, hash, words, items``: the distinct windows and the ids of the items that hold them.

    An item of fewer than ``n`` words is one window; items without words have none.
    """
    items = benchmark.select("item_id", words(F.col("text")).alias("w")).where("size(w) > 0")
    size = F.size("w")
    cut = F.when(size < n, F.array(F.col("w"))).otherwise(_windows(F.col("w"), size, n, lambda _, w: w))
    return (
        items.select("item_id", F.explode(cut).alias("words"))
        .groupBy("words")
        .agg(F.collect_set(F.col("item_id").cast("string")).alias("items"))
        .select(F.size("words").alias("len"), _hash(F.transform("words", lambda w: F.xxhash64(w))).alias("hash"), "words", "items")
    )


def _hash(hashes: Column) -> Column:
    return F.xxhash64(hashes)


def _keys() -> list[Column]:
    return [F.coalesce("doc_id", F.lit(-1)).alias("key_id"), text_key(F.col("text")).alias("key_text")]


def window_hits(docs: DataFrame, windows: DataFrame) -> DataFrame:
    """``doc_id, key_id, key_text, n_words, len, pos, hash``: a row of ``len`` 0 per document, and its hits by hash.

    A shuffled join moves windows only: the documents' own rows do not take part in it.
    """
    lengths = [r[0] for r in windows.select("len").distinct().collect()]  # at most n numbers
    keys = windows.select("len", "hash").distinct()
    small = keys.count() <= BROADCAST_WINDOWS
    rows = docs.select("doc_id", *_keys(), F.transform(words(F.col("text")), lambda w: F.xxhash64(w)).alias("h"))
    rows = rows.withColumn("n_words", F.size("h").cast("long"))
    named = ["doc_id", "key_id", "key_text", "n_words"]

    def entry(length: int):
        return lambda i, w: F.struct(F.lit(length).alias("len"), i.alias("pos"), _hash(w).alias("hash"))

    none = F.array(F.struct(F.lit(0).alias("len"), F.lit(-1).alias("pos"), F.lit(0).cast("long").alias("hash")))
    size = F.col("n_words").cast("int")
    cut = [_windows(F.col("h"), size, length, entry(length)) for length in lengths]
    if small:
        every = rows.select(*named, F.inline(F.concat(none, *cut)))
        known = F.broadcast(keys).withColumn("known", F.lit(True))
        return every.join(known, ["len", "hash"], "left").where("len = 0 or known").drop("known")
    own = rows.select(*named, F.inline(none))
    return own.unionByName(rows.select(*named, F.inline(F.concat(*cut))).join(keys, ["len", "hash"], "left_semi"))


def _bound(value: Column, then) -> Column:
    """``then(value)``, ``value`` being computed once however often it is used."""
    return F.transform(F.array(value), then)[0]


def _texts_of(docs: DataFrame, claimed: DataFrame) -> DataFrame:
    """``key_id, key_text, text`` of the claimed documents; only their texts are shuffled if their keys may be broadcast."""
    texts = docs.select(*_keys(), "text")
    keys = claimed.select("key_id", "key_text")
    if keys.count() <= BROADCAST_DOCUMENTS:
        texts = texts.join(F.broadcast(keys), ["key_id", "key_text"], "left_semi")
    return texts


def contamination(docs: DataFrame, benchmark: DataFrame, n: int = 13, share: int = 20, spans: bool = False) -> DataFrame:
    """How far each document consists of benchmark windows.  Very long texts are judged whole, in one row.

    Returns ``doc_id, n_words, n_hit, n_items, items_sha256, contaminated`` per
    input row; ``contaminated`` if at least one word in ``share`` is hit.  Null and
    empty texts have no words; an empty benchmark hits nothing, an empty table of documents gives no rows; rows that repeat an
    id are judged by their own texts; null ids and other columns are allowed.
    With ``spans``, ``intervals`` (array of ``first, last`` word positions, end
    exclusive) and the row keys ``key_id, key_text`` come too.
    """
    windows = written(benchmark_windows(benchmark, n), "windows")
    found = written(window_hits(docs, windows), "window-hits")
    hits = found.where("len > 0").select("key_id", "key_text", "len", "pos", "hash").distinct()
    claimed = (
        hits.join(windows.select("len", "hash", "words"), ["len", "hash"])
        .groupBy("key_id", "key_text")
        .agg(F.collect_list(F.struct("pos", "len", "hash", "words")).alias("claims"))
    )
    claimed = written(claimed, "window-claims")
    # the words of a text are made once, not for each claim
    right = _bound(
        F.struct(words(F.col("text")).alias("w"), F.col("claims")),
        lambda x: F.filter(x["claims"], lambda c: F.slice(x["w"], c["pos"] + 1, c["len"]) == c["words"]),
    )
    verified = (
        _texts_of(docs, claimed)
        .join(claimed, ["key_id", "key_text"])
        .dropDuplicates(["key_id", "key_text"])
        .select("key_id", "key_text", right.alias("claims"))
        .select(
            "key_id",
            "key_text",
            F.array_sort(
                F.transform("claims", lambda c: F.struct(c["pos"].alias("first"), (c["pos"] + c["len"]).alias("last")))
            ).alias("intervals"),
            F.array_distinct(F.transform("claims", lambda c: c.dropFields("pos"))).alias("found"),
        )
    )
    verified = written(verified, "window-verified")
    covered = F.aggregate(
        "intervals",
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("to")),
        lambda acc, x: F.struct(
            (acc["n"] + F.greatest(F.lit(0), x["last"] - F.greatest(x["first"], acc["to"]))).cast("long").alias("n"),
            F.greatest(acc["to"], x["last"]).alias("to"),
        ),
    )["n"]
    # which items a window stands in matters only where it is found
    items = (
        verified.select("key_id", "key_text", F.inline("found"))
        .join(windows, ["len", "hash", "words"])
        .select("key_id", "key_text", F.explode("items").alias("item"))
        .groupBy("key_id", "key_text")
        .agg(F.array_sort(F.collect_set("item")).alias("items"))
    )
    items = items.select("key_id", "key_text", F.size("items").cast("long").alias("n_items"), F.concat_ws(",", "items").alias("items"))
    verified = verified.select("key_id", "key_text", "intervals", covered.alias("n_hit")).join(items, ["key_id", "key_text"], "left")
    verified = written(verified, "window-items")
    per_doc = found.where("len = 0").select("doc_id", "key_id", "key_text", "n_words")
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    extra = ["key_id", "key_text", F.coalesce("intervals", F.array().cast(verified.schema["intervals"].dataType)).alias("intervals")]
    return per_doc.join(verified, ["key_id", "key_text"], "left").select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"),
        F.sha2(F.coalesce("items", F.lit("")), 256).alias("items_sha256"),
        ((n_hit > 0) & (share * n_hit >= F.col("n_words"))).alias("contaminated"),
        *(extra if spans else []),
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, n: int = 13, share: int = 20, action: str = "drop") -> DataFrame:
    """``docs`` without contaminated documents (``drop``) or without every hit word (``spans``).

    All columns of ``docs`` are returned as they are, ``text`` changed by ``spans``
    only where a word is hit: the word goes, the separators around it stay.
    """
    if action not in ("drop", "spans"):
        raise ValueError(f"unknown action {action!r}")
    judged = contamination(docs, benchmark, n, share, spans=True)
    keyed = docs.withColumns(
        {"__id": F.coalesce("doc_id", F.lit(-1)), "__key": text_key(F.col("text"))}
    )
    judged = judged.where("contaminated" if action == "drop" else "n_hit > 0").select(
        F.col("key_id").alias("__id"), F.col("key_text").alias("__key"), F.col("intervals").alias("__intervals")
    )
    judged = written(judged.dropDuplicates(["__id", "__key"]), "contaminated")
    if action == "drop":
        return keyed.join(judged, ["__id", "__key"], "left_anti").select(*docs.columns)
    kept = F.transform(
        F.regexp_extract_all("text", F.lit(CASED_WORD), F.lit(0)),
        lambda w, i: F.when(F.exists("__intervals", lambda x: (x["first"] <= i) & (i < x["last"])), "").otherwise(w),
    )
    gaps = F.split("text", CASED_WORD, -1)
    rebuilt = F.concat(
        F.array_join(F.zip_with(F.slice(gaps, F.lit(1), F.size(gaps) - 1), kept, lambda g, w: F.concat(g, w)), ""), F.element_at(gaps, -1)
    )
    text = F.when(F.col("__intervals").isNotNull(), rebuilt).otherwise(F.col("text"))
    return keyed.join(judged, ["__id", "__key"], "left").select(
        *[text.alias("text") if c == "text" else F.col(c) for c in docs.columns]
    )
