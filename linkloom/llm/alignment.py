"""Alignment of the tokens of two public tokenizers over the same texts.

A batch's tokens are two tables of starts, keyed by document.  An as-of merge finds
for each token start the other side's token that covers it; both directions
together are all overlaps, and places where both sides have an end cut the tokens
into groups.  Counts of linked ids are documents of the whole corpus.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.llm.common import written
from linkloom.llm.tokens import LONGEST, SLICE_CHARS, SLICE_WORDS, byte_alphabet, flat, gather, strings

#: bytes of text aligned at once
SLICE_BYTES = 512 << 10
#: what a worker remembers of words, some bytes
REMEMBERED_BYTES = 32 << 20
#: a remembered word's own cost beside its ids
ENTRY_BYTES = 230
#: ids are packed by twos into one number
ID_BITS = 21
#: words that are encoded as one text
JOINED_WORDS = 500
#: id pairs whose counts may be broadcast (16 bytes each), the commonest first
BROADCAST_PAIRS = 2_000_000

#: ``align`` returns these on demand
OUTPUTS = {
    "a_ids": "array<int>",
    "b_ids": "array<int>",
    "a_group": "array<int>",
    "b_group": "array<int>",
    "links": "array<struct<a: int, b: int>>",
    "groups": "string",
    "groups_sha256": "string",
    "pairs": "array<long>",
    "times": "array<int>",
}


class ByteLevel:
    """A byte-level vocabulary (``.json``); texts are led by a space, special strings are plain text."""

    #: the split before the merges looks at one place's neighbours only
    SPLITS = '{"type":"ByteLevel","add_prefix_space":false,"trim_offsets":true,"use_regex":true}'

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        form = json.loads(self.tokenizer.to_str())
        self.by_words = form["normalizer"] is None and form["pre_tokenizer"] == json.loads(self.SPLITS)
        alphabet = {c: b for b, c in enumerate(byte_alphabet())}
        self.bytes = [b""] * self.tokenizer.get_vocab_size(with_added_tokens=True)
        for token, i in self.tokenizer.get_vocab(with_added_tokens=True).items():
            known = all(c in alphabet for c in token)
            self.bytes[i] = bytes(alphabet[c] for c in token) if known else token.encode()

    def encode(self, texts: list[str]) -> list[bytes]:
        coded = self.tokenizer.encode_batch_fast([" " + t for t in texts], add_special_tokens=False)
        return [np.array(e.ids, "<u4").tobytes() for e in coded]


class Pieces:
    """A sentence-piece model (``.model``), which leads texts with a space itself."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(self.model.vocab_size())
        pieces = [self.model.id_to_piece(i) for i in ids]
        # words are apart if no piece has a space behind another character
        self.by_words = not any("▁" in p.lstrip("▁") for p in pieces)
        self.bytes = [
            bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace("▁", " ").encode()
            for i, p in zip(ids, pieces)
        ]

    def encode(self, texts: list[str]) -> list[bytes]:
        return [np.array(ids, "<u4").tobytes() for ids in self.model.encode(texts, num_threads=1)]


@dataclass
class Coded:
    """Words' ids on one side, on end: how many each word has, and whether they spell a space and the word."""

    ids: np.ndarray
    sizes: np.ndarray
    exact: np.ndarray

    @staticmethod
    def on_end(parts: list[Coded]) -> Coded:
        return Coded(*(np.concatenate(x) for x in zip(*((c.ids, c.sizes, c.exact) for c in parts))))

    def take(self, order: np.ndarray) -> Coded:
        return Coded(gather(self.ids, self.sizes, order)[0], self.sizes[order], self.exact[order])

    def first(self, n: int) -> Coded:
        """The first words; a copy, which holds nothing of the others."""
        return Coded(self.ids[: int(self.sizes[:n].sum())].copy(), self.sizes[:n].copy(), self.exact[:n].copy())


NONE = Coded(np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, bool))


class Side:
    """One tokenizer in a worker: ids of words, whether they spell the word, byte lengths, decimal texts."""

    def __init__(self, path: str):
        self.vocabulary = (Pieces if path.endswith(".model") else ByteLevel)(path)
        if len(self.vocabulary.bytes) >= 1 << ID_BITS:
            raise ValueError(f"{path}: more than {1 << ID_BITS} ids")
        self.lengths = np.array([len(b) for b in self.vocabulary.bytes], np.int64)
        #: tokens that begin with a space, as every word does
        self.leads = np.array([b[:1] == b" " for b in self.vocabulary.bytes])
        self.spelling = np.frombuffer(b"".join(self.vocabulary.bytes), np.uint8)

    def spelled(self, ids: np.ndarray) -> bytes:
        table = self.vocabulary.bytes
        return b"".join([table[i] for i in ids.tolist()])

    def coded(self, words: pa.Array) -> Coded:
        """Ids of each of some words."""
        # words that white space neither holds nor ends are encoded as the words of a text
        odd = pc.match_substring_regex(words, NOT_APART).to_numpy(zero_copy_only=False)
        apart = np.flatnonzero(~odd if self.vocabulary.by_words else np.zeros(len(words), bool))
        out, done, rest = [NONE], [np.zeros(0, np.int64)], np.ones(len(words), bool)
        for run in _runs(words, apart):
            for took, coded in self._joined(words.take(pa.array(run))):
                out.append(coded)
                done.append(run[took])
                rest[done[-1]] = False
        for run in _runs(words, np.flatnonzero(rest)):
            out.append(self._alone(strings(words.take(pa.array(run)))))
            done.append(run)
        order = np.empty(len(words), np.int64)
        order[np.concatenate(done)] = np.arange(len(words))
        return Coded.on_end(out).take(order)

    def _alone(self, words: list[str]) -> Coded:
        parts = self.vocabulary.encode(words)
        exact = [self.spelled(np.frombuffer(ids, "<u4")) == (" " + w).encode() for w, ids in zip(words, parts)]
        return Coded(*flat(parts), np.array(exact, bool))

    def _joined(self, words: pa.Array) -> Iterator[tuple[slice, Coded]]:
        """Ids of the words that texts of JOINED_WORDS spell, each with its words alone, and the places of these."""
        names, sizes = strings(words), _byte_sizes(words)
        cuts = [*range(0, len(names), JOINED_WORDS), len(names)]
        texts = [" ".join(names[i:j]) for i, j in zip(cuts[:-1], cuts[1:])]
        ids, counts = flat(self.vocabulary.encode(texts))
        ends = np.concatenate(([0], np.cumsum(counts)))
        pending = [(0, len(texts))]
        while pending:  # texts that are not all as they should be are looked at by halves
            i, j = pending.pop()
            coded = self._taken_apart(sizes[cuts[i] : cuts[j]], " " + " ".join(texts[i:j]), ids[ends[i] : ends[j]])
            if coded is not None:
                yield slice(cuts[i], cuts[j]), coded
            elif j - i > 1:
                pending += [(i, (i + j) // 2), ((i + j) // 2, j)]

    def _taken_apart(self, sizes: np.ndarray, text: str, ids: np.ndarray) -> Coded | None:
        """The ids of each word (of ``sizes`` bytes) of a text, from the text's; nothing unless they spell every word."""
        starts = np.flatnonzero(self.leads[ids])
        lengths = self.lengths[ids]
        if len(starts) != len(sizes) or starts[0] or (np.add.reduceat(lengths, starts) != sizes + 1).any():
            return None
        if gather(self.spelling, self.lengths, ids)[0].tobytes() != text.encode():
            return None
        return Coded(ids, np.diff(np.append(starts, len(ids))), np.ones(len(sizes), bool))

    def _marked(self, words: list[str]) -> list[bytes]:
        """Ids of each word and a last number, 1 if they spell a space and the word."""
        coded = self.coded(pa.array(words, pa.string()))
        ends = np.cumsum(coded.sizes)
        parts = zip((ends - coded.sizes).tolist(), ends.tolist(), coded.exact.tolist())
        return [coded.ids[i:j].tobytes() + bytes([exact, 0, 0, 0]) for i, j, exact in parts]


def _byte_sizes(words: pa.Array) -> np.ndarray:
    return pc.binary_length(words).to_numpy(zero_copy_only=False).astype(np.int64)


def _runs(words: pa.Array, at: np.ndarray) -> Iterator[np.ndarray]:
    """The places ``at`` by runs that are encoded at once: so many words and bytes, a longer word alone."""
    ends = np.cumsum(_byte_sizes(words.take(pa.array(at))))
    begin = 0
    while begin < len(at):
        before = ends[begin - 1] if begin else 0
        end = min(begin + SLICE_WORDS, max(begin + 1, int(np.searchsorted(ends, before + SLICE_CHARS, side="right"))))
        yield at[begin:end]
        begin = end


class Words:
    """Ids of words on both sides: new ones are encoded, the rest comes from memory bounded in bytes."""

    def __init__(self, sides: tuple[Side, Side], limit: int | None = None):
        self.sides, self.limit = sides, limit or REMEMBERED_BYTES
        self._hold([], [NONE, NONE], np.zeros(0, np.int64))

    def _hold(self, names: list[str], coded: list[Coded], uses: np.ndarray) -> None:
        self.names, self.coded, self.uses = names, coded, uses
        self.numbers = dict(zip(names, range(len(names))))

    def __call__(self, words: pa.Array) -> tuple[np.ndarray, list[Coded]]:
        """A number of each of the distinct ``words``, and what each side has by number."""
        names, known = strings(words), len(self.names)
        number = np.fromiter(map(self.numbers.get, names, repeat(-1)), np.int64, len(names))
        new = np.flatnonzero(number < 0)
        missing = words.take(pa.array(new))
        # long words seldom come again: they have the last numbers, which are not kept
        long = pc.greater(pc.utf8_length(missing), LONGEST).to_numpy(zero_copy_only=False)
        by_length = np.argsort(long, kind="stable")
        new, missing = new[by_length], missing.take(pa.array(by_length))
        number[new] = known + np.arange(len(new))
        coded = [Coded.on_end([held, one.coded(missing)]) for held, one in zip(self.coded, self.sides)]
        kept = known + int((~long).sum())
        self.uses = np.append(self.uses, np.zeros(kept - known, np.int64))
        self.uses[number[number < kept]] += 1
        self.coded = [c.first(kept) for c in coded]
        short = strings(missing[: kept - known])
        self.names += short
        self.numbers.update(zip(short, range(known, kept)))
        self._age()
        return number, coded

    def _age(self) -> None:
        """Beyond the limit, the half that came most often stays, the newest of equal ones; what came before counts half."""
        while ENTRY_BYTES * len(self.names) + 4 * sum(len(c.ids) for c in self.coded) > self.limit:
            n = len(self.names)
            stay = np.sort(n - 1 - np.argsort(-self.uses[::-1], kind="stable")[: n // 2])
            self._hold([self.names[i] for i in stay.tolist()], [c.take(stay) for c in self.coded], self.uses[stay] // 2)


@lru_cache(maxsize=4)
def side(path: str) -> Side:
    return Side(path)


@lru_cache(maxsize=2)
def known_words(a_path: str, b_path: str) -> Words:
    return Words((side(a_path), side(b_path)))


@lru_cache(maxsize=2)
def _decimals(n: int, first: str) -> np.ndarray:
    """``first`` and ``,`` before each id's decimal text, at 2 * id and 2 * id + 1."""
    return np.array([mark + str(i) for i in range(n) for mark in (first, ",")], object)


#: texts in which spaces always stand alone between other characters fall into words there
_SPACE = r"[\s\p{Z}\x0b\x1c-\x1f\x{85}]"
NOT_WORDS = rf"^{_SPACE}|{_SPACE}{_SPACE}| $"
#: words that are encoded alone
NOT_APART = rf"^{_SPACE}|{_SPACE}$| |^$"


def _words(texts: pa.Array, by_words: bool) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The distinct words of the texts, the words of each text on end, and where each text begins."""
    whole = pc.match_substring_regex(texts, NOT_WORDS) if by_words else pa.array(np.ones(len(texts), bool))
    split = pc.split_pattern(pc.if_else(whole, "", texts).cast(pa.large_string()), " ")
    bounds = split.offsets.to_numpy()
    bounds = bounds - bounds[0]
    coded = split.flatten().dictionary_encode()
    words, order = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    # any other text is one word
    at = np.flatnonzero(whole.to_numpy(zero_copy_only=False))
    more = texts.take(pa.array(at)).cast(pa.large_string()).dictionary_encode()
    order[bounds[at]] = len(words) + more.indices.to_numpy(zero_copy_only=False)
    return pa.concat_arrays([words, more.dictionary]), order, bounds


def _coded(one: Side, texts: pa.Array, coded: Coded, order: np.ndarray, word_bounds: np.ndarray):
    """Ids of the texts' tokens, the text of each, and which texts the tokens spell."""
    ids, ends = gather(coded.ids, coded.sizes, order)
    bounds = ends[word_bounds]
    right = np.ones(len(texts), bool)
    of = np.repeat(np.arange(len(texts)), np.diff(bounds))
    exact = coded.exact[order]
    if not exact.all():
        # where a word is spelled otherwise, the whole text decides
        doubtful = np.add.reduceat(np.append(~exact, False), word_bounds[:-1]) * (np.diff(word_bounds) > 0)
        for i in np.flatnonzero(doubtful):
            right[i] = one.spelled(ids[bounds[i] : bounds[i + 1]]) == (" " + texts[i].as_py()).encode()
    return ids.astype(np.int64), of, right


def covering(doc: np.ndarray, start: np.ndarray, other_doc: np.ndarray, other_start: np.ndarray) -> np.ndarray:
    """For each token start the place of the other side's last token of the document that starts there or before."""
    left = pd.DataFrame({"doc": doc, "start": start})
    right = pd.DataFrame({"doc": other_doc, "start": other_start, "at": np.arange(len(other_doc))})
    found = pd.merge_asof(left, right, on="start", by="doc", direction="backward")
    return found["at"].to_numpy().astype(np.int64)


def _starts(one: Side, ids: np.ndarray, of: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Byte offset of each token, documents lying one behind the other."""
    ends = np.cumsum(one.lengths[ids])
    before = ends - one.lengths[ids]
    first = np.searchsorted(of, np.arange(len(begins)))
    base = np.concatenate((before, [0]))[np.minimum(first, len(before))]
    return before - base[of] + begins[of]


def _cut(values: np.ndarray, of: np.ndarray, n: int) -> np.ndarray:
    return np.searchsorted(of, np.arange(n + 1)).astype(np.int32)


def _aligned(texts: pa.Array, known: Words, wanted: list[str]) -> dict[str, pa.Array]:
    """The columns of ``align`` for some texts (no nulls)."""
    n, (a, b) = len(texts), known.sides
    words, order, bounds = _words(texts, a.vocabulary.by_words and b.vocabulary.by_words)
    number, coded = known(words)
    (a_ids, a_of, a_right), (b_ids, b_of, b_right) = (
        _coded(one, texts, c, number[order], bounds) for one, c in zip((a, b), coded)
    )
    sizes = pc.binary_length(texts.cast(pa.large_string())).to_numpy(zero_copy_only=False).astype(np.int64)
    right = a_right & b_right & (sizes > 0)
    if not right.all():
        a_ids, a_of, b_ids, b_of = a_ids[right[a_of]], a_of[right[a_of]], b_ids[right[b_of]], b_of[right[b_of]]
    begins = np.concatenate(([0], np.cumsum(sizes + 1)[:-1]))
    a_start, b_start = _starts(a, a_ids, a_of, begins), _starts(b, b_ids, b_of, begins)

    b_cover = covering(a_of, a_start, b_of, b_start)
    a_cover = covering(b_of, b_start, a_of, a_start)
    # a token that starts inside another is linked by its own direction, equal starts by the first
    a_joint = b_start[b_cover] == a_start
    b_joint = a_start[a_cover] == b_start
    inner = np.flatnonzero(~b_joint)
    link_a = np.concatenate((np.arange(len(a_ids)), a_cover[inner]))
    link_b = np.concatenate((b_cover, inner))
    a_group, b_group = np.cumsum(a_joint) - 1, np.cumsum(b_joint) - 1

    count = lambda of: pa.array(np.bincount(of, minlength=n).astype(np.int64))
    out = {"n_a": count(a_of), "n_b": count(b_of), "n_groups": count(a_of[a_joint]), "n_links": count(a_of[link_a])}
    a_cut, b_cut = _cut(a_ids, a_of, n), _cut(b_ids, b_of, n)
    lists = lambda cut, values: pa.ListArray.from_arrays(pa.array(cut), pa.array(values.astype(np.int32)))
    first_group = np.concatenate((a_group, [0]))[np.minimum(a_cut[:-1], len(a_group))]
    if "a_ids" in wanted:
        out |= {"a_ids": lists(a_cut, a_ids), "b_ids": lists(b_cut, b_ids)}
    if "a_group" in wanted:
        out |= {"a_group": lists(a_cut, a_group - first_group[a_of]), "b_group": lists(b_cut, b_group - first_group[b_of])}
    if "links" in wanted:
        by_place = np.lexsort((link_b, link_a))
        la, lb, of = link_a[by_place], link_b[by_place], a_of[link_a[by_place]]
        fields = [pa.array((v - cut[of]).astype(np.int32)) for v, cut in ((la, a_cut), (lb, b_cut))]
        out["links"] = pa.ListArray.from_arrays(pa.array(_cut(la, of, n)), pa.StructArray.from_arrays(fields, ["a", "b"]))
    if "groups" in wanted or "groups_sha256" in wanted:
        # a group's tokens of one side, then the other's
        groups = int(a_joint.sum())
        a_size, b_size = np.bincount(a_group, minlength=groups), np.bincount(b_group, minlength=groups)
        text = np.empty(len(a_ids) + len(b_ids), object)
        b_first = np.concatenate(([True], b_group[1:] != b_group[:-1]))[: len(b_ids)]
        text[np.arange(len(a_ids)) + (np.cumsum(b_size) - b_size)[a_group]] = _decimals(len(a.lengths), ";")[2 * a_ids + ~a_joint]
        text[np.arange(len(b_ids)) + np.cumsum(a_size)[b_group]] = _decimals(len(b.lengths), "|")[2 * b_ids + ~b_first]
        cut = a_cut.astype(np.int64) + b_cut
        strings = ["".join(text[i:j].tolist())[1:] for i, j in zip(cut[:-1], cut[1:])]
        if "groups" in wanted:
            out["groups"] = pa.array(strings, pa.string())
        if "groups_sha256" in wanted:
            out["groups_sha256"] = pa.array([hashlib.sha256(s.encode()).hexdigest() if s else "" for s in strings], pa.string())
    if "pairs" in wanted:
        keys = (a_of[link_a] << (2 * ID_BITS)) | (a_ids[link_a] << ID_BITS) | b_ids[link_b]
        keys, times = np.unique(keys, return_counts=True)
        cut = pa.array(_cut(keys, keys >> (2 * ID_BITS), n))
        out["pairs"] = pa.ListArray.from_arrays(cut, pa.array(keys & ((1 << (2 * ID_BITS)) - 1)))
        out["times"] = pa.ListArray.from_arrays(cut, pa.array(times.astype(np.int32)))
    return out


def _slices(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Runs of rows of some SLICE_BYTES, a longer text alone."""
    sizes = np.cumsum(pc.binary_length(texts.cast(pa.large_string())).to_numpy(zero_copy_only=False))
    begin = 0
    while begin < len(texts):
        before = sizes[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(sizes, before + SLICE_BYTES, side="right")))
        yield begin, end
        begin = end


def align(docs: DataFrame, a_path: str, b_path: str, outputs: list[str]) -> DataFrame:
    """``doc_id, n_a, n_b, n_groups, n_links`` and ``outputs`` of every document.

    ``outputs`` are among OUTPUTS: ids of both sides, the group of each token (from
    0), links as token places, the groups as text (``a1,a2|b1;a3|b2``) or its sha256,
    and the distinct linked ids with how often they are linked.  Each path is a
    byte-level ``.json`` vocabulary or a sentence-piece ``.model``.  Null and empty
    texts, and texts which the tokens of a side do not spell (with a space before
    them), have no tokens: zeros, empty lists and texts.  Long texts are aligned whole,
    in memory that grows with the text; repeated ids and rows have a row each, null ids are kept,
    an empty table has no rows, other columns are ignored.
    """
    names = ["n_a", "n_b", "n_groups", "n_links", *outputs]
    schema = "doc_id long, n_a long, n_b long, n_groups long, n_links long" + "".join(f", {o} {OUTPUTS[o]}" for o in outputs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pc.fill_null(batch.column("text"), "")
            for i, j in _slices(texts):
                out = _aligned(texts[i:j], known_words(a_path, b_path), outputs)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id")[i:j], *(out[c] for c in names)], ["doc_id", *names])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


def pair_counts(aligned: DataFrame) -> DataFrame:
    """``pair, n, best``: documents that link the ids, and whether that is the most of their first id."""
    counts = written(aligned.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count(F.lit(1)).alias("n")), "pair-counts")
    first = F.shiftright("pair", ID_BITS)
    most = counts.groupBy(first.alias("a")).agg(F.max("n").alias("most"))
    return counts.join(most, first == F.col("a")).select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def _commonest(counts: DataFrame, limit: int) -> int:
    """The least count such that at most ``limit`` pairs have it or more; the counts' own counts are few."""
    by_count = counts.groupBy("n").agg(F.count(F.lit(1)).alias("pairs"))
    total = counts.count()
    if total <= limit:
        return 0
    # counts that many pairs share are small numbers: look from the largest down, in ever wider steps
    least = counts.agg(F.max("n")).first()[0] + 1
    step = least
    while step > 1:
        step = (step + 1) // 2
        lower = max(1, least - step)
        if by_count.where(F.col("n") >= lower).agg(F.sum("pairs")).first()[0] <= limit:
            least = lower
    return least


def with_corpus_counts(aligned: DataFrame, broadcast_pairs: int = BROADCAST_PAIRS) -> DataFrame:
    """``aligned`` (written; with ``pairs, times`` and a ``row`` number) with ``n_best, count_sum`` instead of those.

    ``count_sum`` adds over a document's links how many documents link their ids, and ``n_best``
    counts links for which that is the most of their first id.  The commonest
    ``broadcast_pairs`` are looked up where the document lies, so none of the others,
    which are joined, is in many documents.
    """
    counts = written(pair_counts(aligned), "pair-best")
    least = _commonest(counts, broadcast_pairs)
    common = counts.where(F.col("n") >= least).orderBy("pair").toArrow()
    known = (
        common["pair"].to_numpy(),
        common["n"].to_numpy().astype(np.int64) * 2 + common["best"].to_numpy().astype(np.int64),
    )
    shared = aligned.sparkSession.sparkContext.broadcast(known)

    @F.arrow_udf("struct<n_best: long, count_sum: long, rest: array<struct<pair: long, times: int>>>")
    def look_up(pairs: pa.Array, times: pa.Array) -> pa.Array:
        keys, values = shared.value
        pair, often = (x.flatten().to_numpy(zero_copy_only=False).astype(np.int64) for x in (pairs, times))
        of = np.repeat(np.arange(len(pairs)), pc.list_value_length(pairs).to_numpy(zero_copy_only=False))
        at = np.minimum(np.searchsorted(keys, pair), max(len(keys) - 1, 0))
        hit = keys[at] == pair if len(keys) else np.zeros(len(pair), bool)
        value = np.where(hit, values[at], 0) if len(keys) else np.zeros(len(pair), np.int64)

        def total(x: np.ndarray) -> pa.Array:
            ends = np.concatenate(([0], np.cumsum(x)))
            cut = np.searchsorted(of, np.arange(len(pairs) + 1))
            return pa.array(ends[cut[1:]] - ends[cut[:-1]])

        cut = np.searchsorted(of[~hit], np.arange(len(pairs) + 1)).astype(np.int32)
        rest = pa.StructArray.from_arrays([pa.array(pair[~hit]), pa.array(often[~hit].astype(np.int32))], ["pair", "times"])
        return pa.StructArray.from_arrays(
            [total(often * (value & 1)), total(often * (value >> 1)), pa.ListArray.from_arrays(pa.array(cut), rest)],
            ["n_best", "count_sum", "rest"],
        )

    names = [c for c in aligned.columns if c not in ("pairs", "times", "row")]
    found = aligned.select("row", *names, look_up("pairs", "times").alias("l")).select("row", *names, "l.*")
    if not least:
        return found.select(*names, "n_best", "count_sum")
    found = written(found, "aligned-common")
    rare = found.select("row", F.inline("rest")).join(counts.where(F.col("n") < least), "pair").groupBy("row")
    rare = rare.agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("b"), F.sum(F.col("times") * F.col("n")).alias("c"))
    zero = F.lit(0).cast("long")
    return found.join(rare, "row", "left").select(
        *names, (F.col("n_best") + F.coalesce("b", zero)).alias("n_best"), (F.col("count_sum") + F.coalesce("c", zero)).alias("count_sum")
    )


def alignment_digest(docs: DataFrame, a_path: str, b_path: str, broadcast_pairs: int = BROADCAST_PAIRS) -> DataFrame:
    """``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256`` of every document."""
    aligned = align(docs, a_path, b_path, ["groups_sha256", "pairs", "times"])
    aligned = written(aligned.withColumn("row", F.monotonically_increasing_id()), "aligned", compact=True)
    return with_corpus_counts(aligned, broadcast_pairs).select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"
    )
