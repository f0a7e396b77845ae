"""Language of a text by n-gram filters that answer for all languages at once.

A Bloom filter whose entries are bit masks, one bit per language: the masks at an
n-gram's places, ANDed, name all languages that contain it.  A text's n-grams are
looked up together, their bits are counted per language, the counts are corrected
for what the filter answers by chance, and the largest decides.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from linkloom.llm import tokens
from linkloom.llm.common import give_back, id_remainder

#: labelled documents per language that the filters are learned from
SAMPLE = 2000
#: n-grams per language in the filters
GRAMS = 8000
#: a language contains an n-gram if it has it at least so often as the language that has it most
COMMON = 0.3
NONE = "und"
HASHES = 2
#: text bytes whose n-grams are held at once (some 80 bytes of arrays each); a longer text is held alone
SLICE_BYTES = 256 << 10
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """By code point: its lower-case letter, or 0 if it is none."""
    return np.array([ord(c.lower()[0]) if c.isalpha() else 0 for c in map(chr, range(0x110000))], np.uint32)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _M2
    return x ^ (x >> np.uint64(29))


def slices(texts: pa.Array) -> Iterator[slice]:
    """Runs of texts of at most ``SLICE_BYTES`` together, or of one that is longer."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    begin = held = 0
    for k, size in enumerate(sizes.tolist()):
        if k > begin and held + size > SLICE_BYTES:
            yield slice(begin, k)
            begin, held = k, 0
        held += size
    if begin < len(sizes):
        yield slice(begin, len(sizes))


def grams(texts: pa.Array, n: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the letter n-grams of all texts on end, and where each text's begin.

    Runs of what are no letters count as one word boundary, texts begin and end
    with one, and an n-gram has a letter in its second place.
    """
    raw = [(t or "").encode("utf-32-le", "surrogatepass") for t in texts.to_pylist()]
    sizes = np.fromiter(map(len, raw), np.int64, len(raw)) // 4
    codes = _letters()[np.frombuffer(b"\0\0\0\0".join([*raw, b""]), "<u4")]
    of = np.repeat(np.arange(len(raw)), sizes + 1)
    keep = np.ones(len(codes), bool)
    keep[1:] = (codes[1:] != 0) | (codes[:-1] != 0)
    codes, of = np.concatenate(([0], codes[keep])).astype(np.uint64), of[keep]
    if len(codes) < n:
        return np.zeros(0, np.uint64), np.zeros(len(raw) + 1, np.int64)
    h = np.zeros(len(codes) - n + 1, np.uint64)
    for k in range(n):
        h = (h + codes[k : len(codes) - n + 1 + k]) * _M1
    begins = codes[1 : len(h) + 1] != 0  # codes[i + 1] belongs to of[i]
    return _mix(h[begins]), np.searchsorted(of[: len(h)][begins], np.arange(len(raw) + 1))


@dataclass
class LanguageFilters:
    languages: list[str]
    bits: np.ndarray  # places x words of 64 languages
    chance: np.ndarray  # by language: what part of absent n-grams it answers for

    def masks(self, hashes: np.ndarray) -> np.ndarray:
        size = np.uint64(len(self.bits))
        found = self.bits[(hashes % size).astype(np.int64)]
        for k in range(1, HASHES):
            found = found & self.bits[((_mix(hashes + np.uint64(k) * _M1)) % size).astype(np.int64)]
        return found

    def shares(self, texts: pa.Array) -> np.ndarray:
        """By text and language: the corrected share of the text's n-grams that the language contains."""
        return np.concatenate([np.zeros((0, len(self.languages))), *(self._shares(texts[part]) for part in slices(texts))])

    def _shares(self, texts: pa.Array) -> np.ndarray:
        hashes, bounds = grams(texts)
        masks = self.masks(hashes)
        n = np.diff(bounds)
        out = np.zeros((len(n), len(self.languages)))
        for k in range(len(self.languages)):
            has = (masks[:, k // 64] >> np.uint64(k % 64)) & np.uint64(1)
            sums = np.concatenate(([0], np.cumsum(has, dtype=np.int64)))
            out[:, k] = np.diff(sums[bounds]) / np.maximum(n, 1)
        return np.clip((out - self.chance) / (1 - self.chance), 0, 1) * (n > 0)[:, None]


def build_filters(by_language: dict[str, np.ndarray], bits_per_gram: int = 16) -> LanguageFilters:
    languages = sorted(by_language)
    most = max((len(g) for g in by_language.values()), default=0)
    empty = LanguageFilters(
        languages, np.zeros((max(64, most * bits_per_gram), max(1, -(-len(languages) // 64))), np.uint64), np.zeros(0)
    )
    size = np.uint64(len(empty.bits))
    for k, language in enumerate(languages):
        g = by_language[language].astype(np.uint64)
        for i in range(HASHES):
            place = g if i == 0 else _mix(g + np.uint64(i) * _M1)
            np.bitwise_or.at(empty.bits[:, k // 64], (place % size).astype(np.int64), np.uint64(1) << np.uint64(k % 64))
    full = [((empty.bits[:, k // 64] >> np.uint64(k % 64)) & np.uint64(1)).mean() for k in range(len(languages))]
    empty.chance = np.array(full) ** HASHES
    return empty


def learn_filters(labelled: DataFrame, sample: int = SAMPLE, top: int = GRAMS) -> LanguageFilters:
    """Filters of the ``top`` most frequent n-grams of each language in ``labelled`` (``text, lang``).

    N-grams that are far more frequent in another language are left out (``COMMON``).
    About ``sample`` rows per language, chosen by a hash of id and text, are read for
    n-grams; the rest only counts.
    """
    spark = labelled.sparkSession
    labelled = labelled.where("lang is not null and text is not null").select("lang", "text", F.xxhash64("doc_id", "text").alias("h"))
    counts = {lang: n for lang, n in labelled.groupBy("lang").count().collect()}  # one row per language
    if not counts:
        return build_filters({})
    # as an Arrow table: a list is sent through Python workers of a kind of their own, which then stay beside the others
    shares = pa.table({"lang": pa.array(list(counts), pa.string()), "part": [min(1.0, sample / n) for n in counts.values()]})
    parts = spark.createDataFrame(shares, "lang string, part double")
    chosen = labelled.join(F.broadcast(parts), "lang").where(
        F.pmod(F.col("h"), F.lit(1 << 20)) < F.col("part") * (1 << 20)
    )

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens.release()
        for batch in batches:
            langs = np.array(batch.column("lang").to_pylist())
            for lang in np.unique(langs):
                texts = batch.column("text").filter(pa.array(langs == lang))
                for part in slices(texts):
                    found, n = np.unique(grams(texts[part])[0], return_counts=True)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([lang] * len(found)), pa.array(found.view(np.int64)), pa.array(n)], ["lang", "gram", "n"]
                    )
        give_back()

    totals = (
        chosen.select("lang", "text")
        .mapInArrow(count, "lang string, gram long, n long")
        .groupBy("lang", "gram")
        .agg(F.sum("n").alias("n"))
    )
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    kept = totals.withColumn("rank", rank).where(F.col("rank") <= top).select("lang", "gram", "n").toArrow()
    langs, found, n = np.array(kept["lang"].to_pylist()), kept["gram"].to_numpy().view(np.uint64), kept["n"].to_numpy()
    names, which = np.unique(langs, return_inverse=True)
    often = n / np.array([n[langs == name].sum() for name in names])[which] if len(n) else n
    _, at = np.unique(found, return_inverse=True)
    most = np.zeros(at.max(initial=-1) + 1)
    np.maximum.at(most, at, often)
    contains = often >= COMMON * most[at]
    return build_filters({lang: found[contains & (langs == lang)] for lang in counts})


def predict(docs: DataFrame, filters: LanguageFilters) -> DataFrame:
    """``docs`` (all columns) with ``lang_pred`` and ``score``, the share of n-grams the language contains.

    A text that is null or has no letter is ``und`` with score 0, as is every text
    if no language was learned.  Ties go to the first language by name.
    """
    shared = docs.sparkSession.sparkContext.broadcast(filters)

    @F.arrow_udf("struct<lang_pred: string, score: double>")
    def judge(texts: pa.Array) -> pa.Array:
        tokens.release()
        model = shared.value
        letter = _letters()
        known = [bool(t) and any(letter[ord(c)] for c in t) for t in texts.to_pylist()]
        shares = model.shares(texts) if model.languages else np.zeros((len(texts), 1))
        names = [*model.languages, NONE]
        best = np.where(np.array(known, bool) & bool(model.languages), shares.argmax(1), len(names) - 1)
        score = np.where(best < len(model.languages), shares.max(1), 0.0)
        give_back()
        return pa.StructArray.from_arrays(
            [pa.array([names[b] for b in best], pa.string()), pa.array(score)], ["lang_pred", "score"]
        )

    names = [c for c in docs.columns if c not in ("lang_pred", "score")]
    return docs.select(*names, judge("text").alias("__judged")).select(*names, "__judged.lang_pred", "__judged.score")


def identify(docs: DataFrame, folds: int = 4, held: int = 2) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` of every document, learned from those not held out.

    A document is held out if crc32 of its id modulo ``folds`` is ``held``; rows
    with a null id are not held out and not learned from.  Very long texts are
    judged whole; an empty table gives no rows; other columns are ignored.
    """
    fold = id_remainder(F.col("doc_id"), folds)
    filters = learn_filters(docs.where(fold != held))
    rows = docs.select("doc_id", F.coalesce(fold == held, F.lit(False)).alias("held_out"), "text")
    return predict(rows, filters).select("doc_id", "held_out", "lang_pred", "score")
