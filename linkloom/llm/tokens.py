"""Token ids of whole texts by a public tokenizer, in Arrow batches.

How a text may be taken apart is read off the tokenizer's own file.  Where its
normaliser and splitter are the known word form, white space separates and is
dropped, so the ids of a text are those of its words one after another; distinct
words are split the same way and the library's merges run once for each new part.
Any other tokenizer encodes whole texts.  Memory is bounded in bytes.
"""

from __future__ import annotations

import gc
import json
import os
import re
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from linkloom.llm.common import give_back

#: what a worker remembers of words before it begins anew, some bytes
REMEMBERED_BYTES = 48 << 20
#: a remembered word's own cost beside its characters and ids
ENTRY_BYTES = 160
#: longer words seldom come again
LONGEST = 24
#: words, and characters, that the library encodes at once
SLICE_WORDS = 8_000
SLICE_CHARS = 256 << 10

#: fixed values: normaliser and splitter of the word form
WORD_NORMALIZER = {
    "type": "Sequence",
    "normalizers": [
        {"type": "NFC"},
        {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "},
        {"type": "Lowercase"},
    ],
}
WORD_SPLITTER = {
    "type": "Sequence",
    "pretokenizers": [
        {
            "type": "Split",
            "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"},
            "behavior": "Removed",
            "invert": True,
        },
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}
#: letters for which the word form's normaliser only lower-cases; "<" may begin a special token
LETTERS = "a-zß-öø-ÿœ"
OTHERS = r"[^\x21-\x3b\x3d-\x7eÀ-ÖØ-öø-ÿŒœ]"
PARTS = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{LETTERS}]+|[0-9]|\n|[^{LETTERS}0-9\n]+")


def byte_alphabet() -> list[str]:
    """The character of each byte in byte-level vocabularies: printable ones stand for themselves."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = [b for b in range(256) if b not in plain]
    return [chr(b) if b in plain else chr(256 + others.index(b)) for b in range(256)]


def gather(ids: np.ndarray, sizes: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of ``ids``, of ``sizes`` on end, put in ``order``; where each begins and the last ends."""
    starts = np.cumsum(sizes) - sizes
    took = sizes[order]
    ends = np.concatenate(([0], np.cumsum(took)))
    narrow = np.int32 if max(len(ids), ends[-1]) < 1 << 31 else np.int64
    at = np.repeat((starts[order] - ends[:-1]).astype(narrow), took)
    at += np.arange(len(at), dtype=narrow)
    return ids[at], ends


def strings(texts: pa.Array) -> list[str]:
    """An array without nulls as a list; by way of numpy, which is several times faster."""
    return texts.to_numpy(zero_copy_only=False).tolist()


def flat(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Little-endian 32-bit ids of byte strings on end, and how many each has."""
    return np.frombuffer(b"".join(parts), "<u4"), np.fromiter(map(len, parts), np.int64, len(parts)) // 4


def slices(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Runs of at most SLICE_WORDS texts and some SLICE_CHARS characters; a longer text is one run."""
    begin, chars = 0, 0
    for i, text in enumerate(texts):
        if i > begin and (i - begin >= SLICE_WORDS or chars + len(text) > SLICE_CHARS):
            yield begin, i
            begin, chars = i, 0
        chars += len(text)
    if texts:
        yield begin, len(texts)


class Remembered:
    """Encoded words: new ones go to ``encode`` in slices, the rest comes from memory bounded in bytes.

    Memory is two halves: a full one becomes the older, from which words that come again move over.
    """

    def __init__(self, encode: Callable[[list[str]], list[bytes]], limit: int = REMEMBERED_BYTES):
        self.encode, self.limit = encode, limit
        self.memory: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.held = 0

    def _keep(self, words: list[str], coded: list[bytes]) -> None:
        short = {word: ids for word, ids in zip(words, coded) if len(word) <= LONGEST}
        self.memory |= short
        self.held += ENTRY_BYTES * len(short) + sum(map(len, short)) + sum(map(len, short.values()))

    def _age(self) -> None:
        if self.held > self.limit // 2:
            self.memory, self.older, self.held = {}, self.memory, 0

    def __call__(self, words: list[str]) -> list[bytes]:
        """The ids of distinct ``words``."""
        found = list(map(self.memory.get, words))
        new = [i for i, ids in enumerate(found) if ids is None]
        if self.older:
            for i in new:
                found[i] = self.older.get(words[i])
            again = [i for i in new if found[i] is not None]
            self._keep([words[i] for i in again], [found[i] for i in again])
            new = [i for i in new if found[i] is None]
        missing = [words[i] for i in new]
        for begin, end in slices(missing):
            coded = self.encode(missing[begin:end])
            for i, ids in zip(new[begin:end], coded):
                found[i] = ids
            self._keep(missing[begin:end], coded)
            self._age()
        self._age()
        return found


class TextEncoder:
    """Encodes Arrow string arrays; one per tokenizer file and worker."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        form = json.loads(self.tokenizer.to_str())
        self.by_words = (
            form["normalizer"] == WORD_NORMALIZER
            and form["pre_tokenizer"] == WORD_SPLITTER
            and form["model"]["type"] == "BPE"
            and not form["model"]["dropout"]
            and all("<" in t["content"] and not re.search(r"\s", t["content"]) for t in form["added_tokens"])
        )
        self.model = self.tokenizer.model
        self.alphabet = dict(enumerate(byte_alphabet()))
        self.parts = Remembered(self._merged)
        self.words = Remembered(self._encoded, REMEMBERED_BYTES // 4)

    def _encoded(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _merged(self, parts: list[str]) -> list[bytes]:
        """Ids of parts of words: the library's merges alone."""
        merge, alphabet, out = self.model.tokenize, self.alphabet, []
        for part in parts:
            symbols = part if part.isascii() else part.encode().decode("latin-1").translate(alphabet)
            out.append(array("I", [t.id for t in merge(symbols)]).tobytes())
        return out

    def _of_words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct words on end, and how many each has."""
        odd = pc.match_substring_regex(words, OTHERS).to_numpy(zero_copy_only=False)
        at, other = np.flatnonzero(~odd), np.flatnonzero(odd)
        ids, sizes = np.zeros(0, np.uint32), np.zeros(0, np.int64)
        if len(at):
            joined = "\n".join(strings(words.take(pa.array(at)))).lower()
            parts = pa.array(PARTS.findall(joined) + ["\n"]).dictionary_encode()
            names, coded = strings(parts.dictionary), parts.indices.to_numpy(zero_copy_only=False)
            end = names.index("\n")
            names[end] = "a"  # has ids like any other; none is taken
            part_ids, part_sizes = flat(self.parts(names))
            part_sizes_of = part_sizes[coded]
            part_sizes_of[coded == end] = 0
            closes = np.flatnonzero(coded == end)
            sizes = np.diff(np.concatenate(([0], np.cumsum(part_sizes_of)[closes])))
            ids, _ = gather(part_ids, part_sizes, coded[coded != end])
        if len(other):
            more_ids, more_sizes = flat(self.words(strings(words.take(pa.array(other)))))
            ids, sizes = np.concatenate((ids, more_ids)), np.concatenate((sizes, more_sizes))
        order = np.empty(len(words), np.int64)
        order[np.concatenate((at, other))] = np.arange(len(words))
        ids, bounds = gather(ids, sizes, order)
        return ids, np.diff(bounds)

    def encode(self, texts: pa.Array, end_id: int | None) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts on end (null: empty), each text closed by ``end_id``; where each text begins."""
        if texts.offset:  # of a slice, Arrow's cast keeps offsets that other functions get wrong
            texts = texts.take(pa.array(np.arange(len(texts))))
        texts = pc.fill_null(texts, "").cast(pa.large_string())
        if self.by_words:
            words = pc.ascii_split_whitespace(texts)
            bounds = words.offsets.to_numpy()
            bounds = bounds - bounds[0]
            coded = words.flatten().dictionary_encode()
            ids, sizes = self._of_words(coded.dictionary)
            order = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        else:
            whole = strings(texts)
            ids, sizes = flat([ids for begin, end in slices(whole) for ids in self._encoded(whole[begin:end])])
            order, bounds = np.arange(len(whole)), np.arange(len(whole) + 1)
        # one more "word" holds the end id and closes each text
        ids = np.append(ids, np.uint32(end_id or 0))
        sizes = np.append(sizes, 0 if end_id is None else 1)
        order = np.insert(order, bounds[1:], len(sizes) - 1)
        ids, ends = gather(ids, sizes, order)
        return ids, ends[bounds + np.arange(len(bounds))]


@lru_cache(maxsize=2)
def encoder(path: str) -> TextEncoder:
    return TextEncoder(path)


def release() -> None:
    """Give back the vocabularies and words of earlier tasks: a worker serves one operator after another."""
    if encoder.cache_info().currsize:
        encoder.cache_clear()
        gc.collect()  # an encoder and its memory refer to each other
        give_back()


def public_vocabulary(name: str) -> str:
    """The place of a public tokenizer's file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def default_tokenizer() -> str:
    """The public vocabulary file the queries use."""
    return public_vocabulary("word_bpe_49k.json")
