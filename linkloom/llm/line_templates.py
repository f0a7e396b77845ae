"""Line dedup by templates: a fixed-depth tree over token counts and leading tokens.

A line's leaf is its number of tokens and its first tokens, tokens with digits
counting as variable.  Lines of a leaf that agree in most positions share one
template, whose other positions are variable; any other line is a template of its
own.  Lines that fit none are parted by the token at their most constant open position
and tried again until nothing parts, so a leaf may hold several templates and noise.
The sentences of a line are messages like lines, so that a passage inside a line is
found as well.  Templates that occur in two or more documents are dropped from all but the first.

The tree is never built in one place.  A first pass reduces leaves to whether two
documents and two lines meet in them; only messages of leaves that two documents share are
written, as hashes, and tokens only of leaves with several lines.  Leaves of many
lines are parted by Spark until their parts are small enough for a task.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from linkloom.functions._let import settled
from linkloom.llm.common import give_back, text_key, written
from linkloom.llm.messages import WHOLE, Messages, messages, template_tree

SPACES = " \t\n\x0b\x0c\r"
#: what ends a sentence of a line, others behind it
SENTENCE_END = re.compile(r"[.!?](?=[\x20\x09])|[\u3002\uFF01\uFF1F](?=[^\n])")
#: bytes of text handled at once
SLICE_BYTES = 1 << 19
#: shared leaves that may be broadcast (9 bytes each)
BROADCAST_LEAVES = 4_000_000
#: lines whose generalised templates may be broadcast (some 100 bytes each)
BROADCAST_TEMPLATES = 500_000
#: lines of a leaf that one task may part
SMALL_LEAF = 5_000


def _keys() -> list[Column]:
    return [F.coalesce("doc_id", F.lit(-1)).alias("key_id"), text_key(F.col("text")).alias("key_text")]


def _digest(c: Column) -> Column:
    """128 bits of a struct, as two numbers."""
    return F.struct(F.xxhash64(c).alias("a"), F.xxhash64(c, F.lit(1)).alias("b"))


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    sizes = np.cumsum(pc.binary_length(batch.column("text")).to_numpy(zero_copy_only=False).astype(np.int64))
    begin = 0
    while begin < batch.num_rows:
        before = sizes[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(sizes, before + SLICE_BYTES, side="right")))
        yield batch.slice(begin, end - begin)
        begin = end


def _leaves(texts: DataFrame, least_tokens: int, leading: int, least_general: int) -> DataFrame:
    """``leaf, mixed``: the leaves that two documents share; mixed, if two lines that may be generalised meet in them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _slices(batch):
                m = messages(part.column("text"), least_tokens, leading)
                doc = part.column("doc").to_numpy()[m.text]
                line = m.a.view(np.int64)
                # one row for each leaf of the slice
                order = np.argsort(m.leaf, kind="stable")
                first = np.flatnonzero(np.concatenate(([True], np.diff(m.leaf[order]) != 0))) if len(order) else order
                reduced = [f.reduceat(x[order], first) if len(first) else x[:0] for x in (doc, line) for f in (np.minimum, np.maximum)]
                general = (m.n >= least_general)[order][first]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x) for x in (m.leaf[order][first].view(np.int64), *reduced, general)],
                    ["leaf", "doc_lo", "doc_hi", "line_lo", "line_hi", "general"],
                )
        give_back()

    schema = "leaf long, doc_lo long, doc_hi long, line_lo long, line_hi long, general boolean"
    spread = texts.select("doc", "text").mapInArrow(run, schema).groupBy("leaf").agg(
        F.min("doc_lo").alias("doc_lo"), F.max("doc_hi").alias("doc_hi"),
        F.min("line_lo").alias("line_lo"), F.max("line_hi").alias("line_hi"), F.max("general").alias("general"),
    )
    shared = spread.where("doc_lo <> doc_hi").select("leaf", F.expr("line_lo <> line_hi and general").alias("mixed"))
    return written(shared, "leaves")


MESSAGE = "key_id long, key_text long, pos int, part int, at int, n int, a long, b long, leaf long"


def _message_rows(batch: pa.RecordBatch, m: Messages, keep: np.ndarray, mixed: np.ndarray, leaves: bool) -> pa.RecordBatch:
    """Rows of the messages at ``keep``; tokens of each line of the slice that ``mixed`` says so of, once.

    ``leaves`` asks for the leaf of every message, not only of those with tokens.
    """
    at = pa.array(m.at[keep].astype(np.int32), mask=m.at[keep] < 0)
    some = np.flatnonzero(mixed)
    _, first = np.unique(m.a[keep[some]], return_index=True)
    want = np.zeros(len(keep), bool)
    want[some[first]] = True
    sizes = np.where(want, m.n[keep], 0)
    ends = np.concatenate(([0], np.cumsum(sizes)))
    places = np.repeat(m.lo[keep] - ends[:-1], sizes) + np.arange(ends[-1])
    tokens = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(m.tokens[places].view(np.int64)))
    tokens = pc.if_else(pa.array(want), tokens, pa.scalar(None, tokens.type))
    numbers = [x[keep].astype(np.int32) for x in (m.pos, m.part)]
    hashes = [x[keep].view(np.int64) for x in (m.a, m.b)]
    leaf = pa.array(m.leaf[keep].view(np.int64), mask=None if leaves else ~want)
    columns = [
        *(pa.array(batch.column(c).to_numpy()[m.text[keep]]) for c in ("key_id", "key_text")),
        *map(pa.array, numbers), at, pa.array(m.n[keep].astype(np.int32)), *map(pa.array, hashes), leaf, tokens,
    ]
    return pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in MESSAGE.split(", ")] + ["tokens"])


def _shared_messages(texts: DataFrame, leaves: DataFrame, least_tokens: int, leading: int, least_general: int) -> DataFrame:
    """The messages of shared leaves, written: columns of MESSAGE and, once a slice for lines of mixed leaves, ``tokens``."""
    schema = f"{MESSAGE}, tokens array<long>"
    few = leaves.count() <= BROADCAST_LEAVES
    known = None
    if few:
        table = leaves.orderBy("leaf").toArrow()
        pair = (table["leaf"].to_numpy(), table["mixed"].to_numpy())
        known = texts.sparkSession.sparkContext.broadcast(pair)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _slices(batch):
                m = messages(part.column("text"), least_tokens, leading)
                leaf, general = m.leaf.view(np.int64), m.n >= least_general
                keep, mixed = np.arange(len(leaf)), general
                if known is not None:
                    keys, flags = known.value
                    at = np.minimum(np.searchsorted(keys, leaf), max(len(keys) - 1, 0))
                    hit = keys[at] == leaf if len(keys) else np.zeros(len(leaf), bool)
                    keep = np.flatnonzero(hit)
                    mixed = flags[at[keep]] & general[keep]
                yield _message_rows(part, m, keep, mixed, known is None)
        give_back()

    rows = texts.select("key_id", "key_text", "text").mapInArrow(run, schema)
    if not few:
        rows = rows.join(leaves, "leaf").withColumn("tokens", F.when(F.col("mixed"), F.col("tokens"))).drop("mixed")
    return written(rows, "messages", compact=True)


def _in_tasks(members: DataFrame, same: float, constant: float) -> DataFrame:
    """``line, template`` of the lines of small nodes (``node, line, tokens``), each node's tree grown in one task."""

    def grow(node: int, lines: np.ndarray, tokens: np.ndarray) -> Iterator[tuple]:
        if len(lines) > 1:
            number = template_tree(tokens.reshape(len(lines), -1).view(np.uint64), same, constant)
            of = np.flatnonzero(number)
            yield lines[of, 0], lines[of, 1], np.full(len(of), node), number[of]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = None  # the last node of a batch may go on in the next
        for batch in batches:
            nodes, a, b = (batch.column(c).to_numpy() for c in ("node", "a", "b"))
            of = batch.column("tokens")
            bounds, flat = of.offsets.to_numpy() - of.offsets[0].as_py(), of.flatten().to_numpy()
            lines = np.stack((a, b), axis=1)
            cuts = [0, *(np.flatnonzero(np.diff(nodes)) + 1).tolist(), len(nodes)]
            done = []
            for i, j in zip(cuts[:-1], cuts[1:]):
                if j == i:
                    continue
                one = (nodes[i], lines[i:j], flat[bounds[i] : bounds[j]])
                if kept is not None and kept[0] == one[0]:
                    one = (one[0], *(np.concatenate(x) for x in zip(kept[1:], one[1:])))
                elif kept is not None:
                    done += grow(*kept)
                kept = one
            if done:
                yield _found(done)
        if kept is not None and (done := list(grow(*kept))):
            yield _found(done)

    ordered = members.select("node", "line.a", "line.b", "tokens").repartition("node").sortWithinPartitions("node", "a", "b")
    rows = ordered.mapInArrow(run, "a long, b long, node long, number long")
    return rows.select(F.struct("a", "b").alias("line"), _digest(F.struct("node", "number")).alias("template"))


def _found(parts: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*parts)], ["a", "b", "node", "number"])


def _general(members: DataFrame, same: float, constant: float) -> DataFrame:
    """``line, template`` of the lines that share a generalised template with others of their node."""
    found = []
    while True:
        sizes = members.groupBy("node").count().where(F.col("count") > SMALL_LEAF).select("node")
        large = written(sizes, "large-nodes")
        if large.isEmpty():
            found.append(_in_tasks(members, same, constant))
            break
        found.append(written(_in_tasks(members.join(large, "node", "left_anti"), same, constant), "found"))
        members = members.join(large, "node", "left_semi")
        templates, splits = _node_templates(members, same, constant)
        fits = F.forall("fixed", lambda f: F.get("tokens", f["at"]) == f["token"])
        told = members.join(templates, "node", "left").withColumn("fits", F.coalesce(fits, F.lit(False)))
        told = written(told, "large-told")
        found.append(told.where("fits").select("line", _digest(F.struct("node", "fixed")).alias("template")))
        # lines that fit no template part by their token at one position of the node
        rest = told.where("not fits").select("node", "line", "tokens").join(splits, "node")
        node = F.xxhash64("node", F.lit("split"), F.get("tokens", F.col("split")))
        members = written(rest.select(node.alias("node"), "line", "tokens"), "large-rest")
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def _node_templates(members: DataFrame, same: float, constant: float) -> tuple[DataFrame, DataFrame]:
    """``node, fixed`` of the nodes whose lines share a template, and ``node, split`` to part the rest of any node by.

    The split is at the position where most lines have a token that others have as
    well, though not all, and fewest such tokens occur.
    """
    sizes = members.groupBy("node").agg(F.count(F.lit(1)).alias("size"), F.max(F.size("tokens")).alias("width"))
    sizes = written(sizes.where(F.col("size") > 1), "node-sizes")
    at = members.select("node", F.posexplode("tokens").alias("at", "token")).groupBy("node", "at", "token").count()
    at = written(at.where("count > 1").join(sizes, "node"), "node-tokens")
    # at most one token can hold more than half of a position
    fixed = (
        at.where(F.col("count") >= same * F.col("size"))
        .groupBy("node", "width")
        .agg(F.sort_array(F.collect_list(F.struct("at", "token"))).alias("fixed"))
        .where(F.size("fixed") >= constant * F.col("width"))
    )
    open_at = at.where("count < size").groupBy("node", "at").agg(F.sum("count").alias("of"), F.count(F.lit(1)).alias("tokens"))
    splits = open_at.groupBy("node").agg(F.max_by("at", F.struct("of", -F.col("tokens"), -F.col("at"))).alias("split"))
    return written(fixed.select("node", "fixed"), "node-templates"), written(splits, "node-splits")


def recurring_lines(
    docs: DataFrame,
    least_tokens: int = 3,
    leading: int = 3,
    same: float = 0.9,
    constant: float = 0.7,
    least_general: int = 6,
) -> DataFrame:
    """``key_id, key_text, pos, part, at, n, n_docs, first``: messages whose template occurs in two documents or more.

    Messages are lines (``part`` is WHOLE) and the sentences of lines; ``n`` is the
    number of tokens and ``at`` the sentence's place in the document.  ``first`` marks
    those of the template's first document (the smallest key).  Positions count from
    0.  Lines of fewer than ``least_tokens`` tokens are never templates; messages of
    fewer than ``least_general`` are not generalised.
    """
    texts = docs.where("text is not null").select(*_keys(), "text").withColumn("doc", F.xxhash64("key_id", "key_text"))
    leaves = _leaves(texts, least_tokens, leading, least_general)
    found = _shared_messages(texts, leaves, least_tokens, leading, least_general)
    lines = found.where("tokens is not null").groupBy("leaf", "a", "b").agg(F.first("tokens").alias("tokens"))
    members = written(lines.select(F.col("leaf").alias("node"), F.struct("a", "b").alias("line"), "tokens"), "leaf-lines")
    general = written(_general(members, same, constant), "line-templates")
    # hashes as plain columns: rows of longs are sorted by their prefixes
    known = general.select("line.a", "line.b", "template")
    if general.count() <= BROADCAST_TEMPLATES:
        known = F.broadcast(known)
    rows = found.select("key_id", "key_text", "pos", "part", "at", "n", "a", "b").join(known, ["a", "b"], "left").select(
        "key_id", "key_text", "pos", "part", "at", "n",
        F.coalesce("template.a", "a").alias("template_a"), F.coalesce("template.b", "b").alias("template_b"),
    )
    template = ["template_a", "template_b"]
    spread = (
        rows.select(*template, "key_id", "key_text")
        .distinct()
        .groupBy(*template)
        .agg(F.count(F.lit(1)).alias("n_docs"), F.min("key_id").alias("first_id"))
    )
    spread = written(spread.where("n_docs > 1"), "recurring")
    return rows.join(spread, template).select(
        "key_id", "key_text", "pos", "part", "at", "n", "n_docs", (F.col("key_id") == F.col("first_id")).alias("first")
    )


def _by_document(messages: DataFrame, least_docs: int, least_tokens: int, least_pair: int) -> DataFrame:
    """``key_id, key_text, found``: a document's recurring messages; ``goes`` marks lines that go wherever they stand."""
    least = F.when(F.col("n_docs") >= least_docs, least_tokens).otherwise(least_pair)
    goes = (F.col("part") == WHOLE) & (F.col("n") >= least)
    message = F.struct("pos", "part", F.coalesce("at", F.lit(-1)).alias("at"), "n", goes.alias("goes"))
    # every copy of a row finds the same messages, so a set of them is enough
    rows = messages.where(F.col("at").isNotNull() | goes)
    return rows.groupBy("key_id", "key_text").agg(F.collect_set(message).alias("found"))


def _cut(at: np.ndarray, n: np.ndarray, goes: np.ndarray, least_run: int) -> np.ndarray:
    """Which messages of a document go: such lines, and sentences in recurring runs of ``least_run`` tokens."""
    gone = goes.copy()
    sentences = np.flatnonzero(at >= 0)
    sentences = sentences[np.argsort(at[sentences])]
    run = np.cumsum(np.diff(at[sentences], prepend=-2) != 1)
    words = np.bincount(run, n[sentences])
    gone[sentences[words[run] >= least_run]] = True
    return gone


def _sentences(line: str) -> list[str]:
    cuts = [0, *(end.end() for end in SENTENCE_END.finditer(line)), len(line)]
    return [line[i:j] for i, j in zip(cuts[:-1], cuts[1:])]


def _left(text: str, pos: np.ndarray, part: np.ndarray) -> dict:
    """A text without some lines and sentences, and how many lines went as a whole."""
    gone = defaultdict(set)
    for p, j in zip(pos.tolist(), part.tolist()):
        gone[p].add(j)
    rows, dropped = text.split("\n"), 0
    for p, parts in gone.items():
        left = ""
        if WHOLE not in parts:
            left = "".join(x for j, x in enumerate(_sentences(rows[p])) if j not in parts)
            left = left.lstrip(SPACES) if 0 in parts else left
        rows[p] = left if left.strip(SPACES) else None
        dropped += rows[p] is None
    return {"text": "\n".join(r for r in rows if r is not None), "n": dropped}


def _without(text: Column, found: Column, least_run: int) -> Column:
    """``text, n`` of texts without their recurring messages; null where there are none to drop."""

    def run(texts: pa.Array, found: pa.Array) -> pa.Array:
        bounds, flat = found.offsets.to_numpy(), found.values
        pos, part, at, n = (flat.field(c).to_numpy() for c in ("pos", "part", "at", "n"))
        goes = flat.field("goes").to_numpy(zero_copy_only=False)
        out = []
        for i in np.flatnonzero(found.is_valid().to_numpy(zero_copy_only=False)).tolist():
            out += [None] * (i - len(out))
            mine = slice(bounds[i], bounds[i + 1])
            gone = _cut(at[mine], n[mine], goes[mine], least_run)
            out.append(_left(texts[i].as_py(), pos[mine][gone], part[mine][gone]) if gone.any() else None)
        out += [None] * (len(texts) - len(out))
        return pa.array(out, pa.struct([("text", pa.string()), ("n", pa.int64())]))

    return F.arrow_udf(run, StructType([StructField("text", StringType()), StructField("n", LongType())]))(text, found)


def drop_recurring_lines(
    docs: DataFrame,
    copy_share: float | None = None,
    least_docs: int = 3,
    least_tokens: int = 3,
    least_pair: int = 8,
    least_run: int = 20,
    **options,
) -> DataFrame:
    """``docs`` with ``text`` freed of recurring lines and passages, and ``n_lines, n_dropped``.

    Of a recurring template only the first document's lines stay.  It recurs in two
    documents, but lines of fewer than ``least_pair`` tokens that do not stand in a
    recurring passage go from ``least_docs`` documents on.  Within a line,
    recurring sentences go where they and their recurring neighbours, also of the
    lines beside, make up ``least_run`` tokens; a passage's unfinished sentence at
    either end stays.  ``n_dropped`` counts lines of which nothing is left.  A document of
    which more than ``copy_share`` of the lines would go is a copy as a whole: it
    is left as it is for document-level dedup (None: there is no such limit).
    Null texts stay null and have 0 lines; rows that repeat an id count as one
    document if their texts agree; a null id is the first document; other columns,
    also with the names used here, are kept.  Very long texts are handled whole, in one
    row; an empty table gives no rows.
    """
    messages = recurring_lines(docs, least_tokens=least_tokens, **options).where("not first")
    found = _by_document(written(messages, "recurring-messages"), least_docs, least_tokens, least_pair)
    found = written(found, "document-messages")
    n_lines = F.when(F.col("text").isNotNull(), F.size(F.split("text", "\n", -1))).otherwise(0).cast("long")
    keyed = docs.withColumns(dict(zip(("__id", "__text"), (c for c in _keys()))))
    joined = keyed.join(
        found.withColumnsRenamed({"key_id": "__id", "key_text": "__text", "found": "__found"}), ["__id", "__text"], "left"
    )
    # settled: a filter on the result would else have every text rewritten twice, by two Python workers a task
    rewritten = settled(_without(F.when(F.col("__found").isNotNull(), F.col("text")), F.col("__found"), least_run))
    joined = joined.select("*", rewritten.alias("__left"))
    left = F.when(F.lit(True) if copy_share is None else F.col("__left.n") <= copy_share * n_lines, F.col("__left"))
    others = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    return joined.withColumn("__left", left).select(
        *[F.coalesce("__left.text", "text").alias("text") if c == "text" else F.col(c) for c in others],
        n_lines.alias("n_lines"),
        F.coalesce("__left.n", F.lit(0)).cast("long").alias("n_dropped"),
    )
