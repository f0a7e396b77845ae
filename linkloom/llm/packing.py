"""Packing documents into training sequences: large items matched first, gaps best-fit after.

What decides a packing is how many pieces there are of each length, at most
``capacity`` numbers whatever the corpus.  The plan is made on these counts: it
says which ranks of a length go into which sequences.  Spark then ranks the pieces
within their lengths and each looks its place up.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from linkloom.llm.common import byte_slices, give_back, written
from linkloom.llm.tokens import encoder

#: pieces of one length are ranked in so many shares
RANK_SHARES = 256
#: bytes of text encoded at once
SLICE_BYTES = 1 << 20


@dataclass
class Run:
    """``count`` pieces of one length from rank ``rank`` on, ``each`` of them to a sequence from ``sequence`` on."""

    rank: int
    count: int
    sequence: int
    offset: int
    each: int = 1


@dataclass
class Plan:
    runs: dict[int, list[Run]] = field(default_factory=dict)
    sequences: int = 0


def plan_packing(counts: dict[int, int], capacity: int) -> Plan:
    """Where the pieces of each length go.  ``counts``: pieces by length.

    Lengths above a third of the capacity, longest first, take the longest partner
    that fits, so at most two share a sequence; then shorter lengths, longest
    first, go to the tightest gap they fit into, and to new sequences in the end.
    Sequences that look alike are handled as one block, so the work and the plan
    depend on the number of lengths only.
    """
    plan = Plan({length: [] for length in counts})
    left = {length: n for length, n in counts.items() if n}
    ranks = dict.fromkeys(left, 0)
    gaps: dict[int, list[tuple[int, int]]] = {}  # gap -> blocks (first sequence, sequences)
    open_gaps: list[int] = []  # sorted

    def put(length: int, count: int, sequence: int, offset: int, each: int = 1) -> None:
        plan.runs[length].append(Run(ranks[length], count, sequence, offset, each))
        ranks[length] += count
        left[length] -= count

    def leave(gap: int, sequence: int, count: int) -> None:
        if gap and count:
            if gap not in gaps:
                gaps[gap] = []
                bisect.insort(open_gaps, gap)
            gaps[gap].append((sequence, count))

    large = sorted(length for length in left if 3 * length > capacity)
    while large:
        longest = large[-1]
        if not left[longest]:
            large.pop()
            continue
        at = bisect.bisect_right(large, capacity - longest) - 1
        while at >= 0 and left[large[at]] < 1 + (large[at] == longest):  # one alone is no partner of its own
            if not left[large[at]]:
                del large[at]
            at -= 1
        first = plan.sequences
        if at < 0:
            n = left[longest]
            put(longest, n, first, 0)
            leave(capacity - longest, first, n)
        elif large[at] == longest:
            n = left[longest] // 2
            put(longest, 2 * n, first, 0, 2)
            leave(capacity - 2 * longest, first, n)
        else:
            n = min(left[longest], left[large[at]])
            put(longest, n, first, 0)
            put(large[at], n, first, longest)
            leave(capacity - longest - large[at], first, n)
        plan.sequences += n

    for length in sorted((length for length in left if 3 * length <= capacity), reverse=True):
        while left[length]:
            at = bisect.bisect_left(open_gaps, length)
            if at < len(open_gaps):
                gap = open_gaps[at]
                first, n = gaps[gap].pop()
                if not gaps[gap]:
                    del gaps[gap], open_gaps[at]
            else:
                gap, first = capacity, plan.sequences
                n = -(-left[length] // (capacity // length))
                plan.sequences += n
            each = gap // length
            count = min(left[length], n * each)
            full, rest = divmod(count, each)
            put(length, count, first, capacity - gap, each)
            leave(gap - each * length, first, full)
            if rest:
                leave(gap - rest * length, first + full, 1)
                full += 1
            leave(gap, first + full, n - full)
    return plan


def pack(pieces: DataFrame, capacity: int, order_by: list[str]) -> DataFrame:
    """``pieces`` (with a ``length`` of 1 to ``capacity``) with ``sequence_id`` and ``offset``.

    The pieces of a sequence follow each other from offset 0 without gaps.  Pieces
    of a length are ranked by ``order_by`` in hashed shares, so that a length which
    holds most pieces does not meet in one task; rows equal in ``order_by`` and
    ``length`` must be interchangeable.
    """
    share = F.pmod(F.xxhash64(*order_by), F.lit(RANK_SHARES)).cast("int")
    pieces = pieces.withColumn("__share", share)
    # at most capacity x RANK_SHARES rows
    counts = pieces.groupBy("length", "__share").count().toArrow()
    length, at, n = (counts[c].to_numpy().astype(np.int64) for c in ("length", "__share", "count"))
    lengths, row = np.unique(length, return_inverse=True)
    by_share = np.zeros((len(lengths), RANK_SHARES), np.int64)
    by_share[row, at] = n
    plan = plan_packing(dict(zip(lengths.tolist(), by_share.sum(axis=1).tolist())), capacity)
    starts = dict(zip(lengths.tolist(), np.cumsum(by_share, axis=1) - by_share))
    runs = {
        length: np.array([(r.rank, r.sequence, r.offset, r.each) for r in of], np.int64).T
        for length, of in plan.runs.items()
    }
    shared = pieces.sparkSession.sparkContext.broadcast((starts, runs))

    @F.arrow_udf("struct<sequence_id: long, offset: long>")
    def place(length: pa.Array, share: pa.Array, rank: pa.Array) -> pa.Array:
        starts, runs = shared.value
        lengths, shares, ranks = (x.to_numpy().astype(np.int64) for x in (length, share, rank))
        out = np.zeros((2, len(lengths)), np.int64)
        for one in np.unique(lengths):
            rows = np.flatnonzero(lengths == one)
            number = starts[one][shares[rows]] + ranks[rows]
            rank0, sequence, offset, each = runs[one]
            run = np.searchsorted(rank0, number, side="right") - 1
            over, inner = np.divmod(number - rank0[run], each[run])
            out[:, rows] = sequence[run] + over, offset[run] + inner * one
        return pa.StructArray.from_arrays([pa.array(out[0]), pa.array(out[1])], ["sequence_id", "offset"])

    rank = F.row_number().over(Window.partitionBy("length", "__share").orderBy(*order_by)) - 1
    names = [c for c in pieces.columns if c != "__share"]
    placed = pieces.withColumn("__rank", rank.cast("long"))
    return placed.select(*names, place("length", "__share", "__rank").alias("__place")).select(
        *names, "__place.sequence_id", "__place.offset"
    )


def token_pieces(
    docs: DataFrame, tokenizer: str, capacity: int = 4096, end_id: int = 1, with_ids: bool = False
) -> DataFrame:
    """Documents as pieces of at most ``capacity`` tokens; only longer documents are cut.

    A document is its ids and ``end_id`` (null text: ``end_id`` alone).  Returns
    ``doc_id, piece, start, length, ids_crc32`` and, if asked for, the ``ids``.
    """
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + (
        ", ids array<int>" if with_ids else ""
    )

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for batch in batches for part in byte_slices(batch, ["text"], SLICE_BYTES)):
            ids, bounds = encoder(tokenizer).encode(batch.column("text"), end_id)
            n = -(-np.diff(bounds) // capacity)
            of = np.repeat(np.arange(len(n)), n)
            piece = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
            begin = bounds[of] + piece * capacity
            end = np.minimum(begin + capacity, bounds[of + 1])
            raw = memoryview(np.ascontiguousarray(ids, "<u4")).cast("B")
            crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(begin, end)]
            columns = [
                batch.column("doc_id").take(pa.array(of)),
                pa.array(piece.astype(np.int32)),
                pa.array(piece * capacity),
                pa.array(end - begin),
                pa.array(crc, pa.int64()),
            ]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                cuts = np.append(begin, bounds[-1]).astype(np.int32)
                columns.append(pa.ListArray.from_arrays(pa.array(cuts), pa.array(ids.astype(np.int32))))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names)
        give_back()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(cut, schema)


def pack_documents(
    docs: DataFrame, tokenizer: str, capacity: int = 4096, end_id: int = 1, with_ids: bool = False
) -> DataFrame:
    """Tokenize and pack ``docs``; every document gets a place, an empty table no rows.

    Returns the columns of :func:`token_pieces` with ``sequence_id`` and ``offset``.
    Rows that repeat an id are packed as often as they occur; a null id is kept.
    Pieces are written once, so that counting and placing see the same rows.
    """
    pieces = written(token_pieces(docs, tokenizer, capacity, end_id, with_ids), "pieces")
    return pack(pieces, capacity, ["doc_id", "piece", "ids_crc32"])


def sequences(packed: DataFrame) -> DataFrame:
    """``sequence_id, n_tokens, ids`` of packed pieces that carry their ids; a group holds ``capacity`` ids at most."""
    return (
        packed.groupBy("sequence_id")
        .agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("parts"), F.sum("length").alias("n_tokens"))
        .select("sequence_id", "n_tokens", F.flatten("parts.ids").alias("ids"))
    )
