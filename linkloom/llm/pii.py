"""Personal data: fixed forms, and bootstrapped patterns of the words around them.

Everything runs in the JVM.  Spans of the fixed forms are the seeds.  The words
next to them become lexical patterns; patterns and the tokens they stand by form a
graph whose scores are passed back and forth a few rounds; patterns of high
confidence then mark tokens that no fixed form describes.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkloom.llm.common import text_key, written

#: the fixed forms; each starts where a run starts or the last match ended, and gives
#: nothing back, so the time is linear in the text and long runs need no stack
FORMS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: what a text must contain to be searched for a form
HINTS = {"email": "@", "ip": ".", "phone": "+"}
KINDS = list(FORMS)
OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
#: tokens that may be identifiers: white-space words with a digit or an at sign
TOKEN = r"(?:\G|(?<!\S))[^\s0-9@]*+[0-9@]\S*+"
TRIMMED = "\"'`()[]{}<>.,;:!?*#$%&|="

BLOCK = 128


def _let(value: Column, of: Callable[[Column], Column]) -> Column:
    """``of(value)`` with ``value`` evaluated once."""
    return F.element_at(F.transform(F.array(value), of), 1)


def _running(sizes: Column) -> Column:
    """Sums of all earlier numbers; in blocks, so that the time stays near linear."""
    zero = F.lit(0).cast("long")

    def sums(numbers: Column, start: Column) -> Column:
        return F.aggregate(
            numbers, F.array(start), lambda acc, x: F.concat(acc, F.array((F.element_at(acc, -1) + x).cast("long")))
        )

    def blocks(v: Column) -> Column:
        parts = F.transform(F.sequence(F.lit(0), F.ceil(F.size(v) / BLOCK).cast("int") - 1), lambda b: F.slice(v, b * BLOCK + 1, BLOCK))
        return _let(
            parts,
            lambda p: _let(
                sums(F.transform(p, lambda b: F.aggregate(b, zero, lambda a, x: a + x)), zero),
                lambda before: F.flatten(F.transform(p, lambda b, i: F.slice(sums(b, before[i]), F.lit(1), F.size(b)))),
            ),
        )

    return F.when(F.size(sizes) > 0, _let(sizes, blocks)).otherwise(F.array().cast("array<long>"))


def _matches(text: Column, form: str) -> Column:
    """All matches as ``start, end, value, before``: positions in code points, and the text since the last match."""
    found, gaps = F.regexp_extract_all(text, F.lit(form), F.lit(0)), F.split(text, form, -1)

    def place(f: Column, g: Column) -> Column:
        length = F.zip_with(F.slice(g, F.lit(1), F.size(f)), f, lambda x, y: (F.length(x) + F.length(y)).cast("long"))
        return _let(
            _running(length),
            lambda at: F.transform(
                f,
                lambda v, i: F.struct(
                    (at[i] + F.length(g[i])).alias("start"),
                    (at[i] + F.length(g[i]) + F.length(v)).alias("end"),
                    v.alias("value"),
                    g[i].alias("before"),
                ),
            ),
        )

    return _let(found, lambda f: F.when(F.size(f) > 0, _let(gaps, lambda g: place(f, g))))


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    def add(acc: Column, i: Column) -> Column:
        d = F.substring(digits, F.length(digits) - i, F.lit(1)).cast("int")
        twice = F.when(i % 2 == 1, F.when(d > 4, 2 * d - 9).otherwise(2 * d)).otherwise(d)
        return acc + twice

    return F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), add) % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return value.rlike(rf"^{OCTET}(?:\.{OCTET}){{3}}$")
    digits = _digits(value)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return F.when(F.length(digits).between(13, 19), _luhn(digits)).otherwise(False)


def _form_spans(text: Column, kind: str) -> Column:
    """Valid spans of one form as ``kind`` (its number), ``start``, ``end``, and a hash of the ``value``."""
    hint = text.contains(HINTS[kind]) if kind in HINTS else text.rlike("[0-9]")
    valid = F.filter(_matches(text, FORMS[kind]), lambda m: _valid(kind, m["value"]))
    spans = F.transform(
        valid,
        lambda m: F.struct(
            F.lit(KINDS.index(kind)).alias("kind"), m["start"].alias("start"), m["end"].alias("end"),
            F.xxhash64(_digits(m["value"]) if kind != "email" else m["value"]).alias("value"),
        ),
    )
    empty = F.array().cast("array<struct<kind:int,start:bigint,end:bigint,value:bigint>>")
    return F.coalesce(F.when(hint, spans), empty)


def _last_words(c: Column) -> Column:
    """The last two words of a text, lower-cased, digits hidden."""
    return F.regexp_replace(F.lower(F.regexp_extract(F.right(c, F.lit(80)), r"(\S+\s+\S+|\S+)\s*$", 1)), "[0-9]", "0")


def base_spans(docs: DataFrame) -> DataFrame:
    """Per row: ``doc_id``, row keys, the fixed-form ``base`` spans by kind and start, and candidate ``tokens``."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", text.alias("text"))
    rows = rows.select(
        "doc_id",
        F.coalesce("doc_id", F.lit(-1)).alias("key_id"),
        text_key(F.col("text")).alias("key_text"),
        F.concat(*[_form_spans(F.col("text"), k) for k in KINDS]).alias("base"),
        F.when(F.col("text").rlike("[0-9@]"), _matches(F.col("text"), TOKEN)).alias("tokens"),
    )

    def describe(t: Column) -> Column:
        left = F.length(t["value"]) - F.length(F.ltrim(t["value"], F.lit(TRIMMED)))
        core = F.trim(t["value"], F.lit(TRIMMED))
        return F.struct(
            (t["start"] + left).alias("start"),
            (t["start"] + left + F.length(core)).alias("end"),
            core.alias("value"),
            _last_words(t["before"]).alias("left"),
        )

    tokens = F.filter(
        F.transform("tokens", describe),
        lambda t: (t["left"] != "") & ((F.length(_digits(t["value"])) >= 4) | t["value"].contains("@") | t["value"].startswith("+")),
    )
    return rows.withColumn("tokens", tokens)


def occurrences(base: DataFrame) -> DataFrame:
    """Tokens beside words: ``kind`` is that of a fixed form beginning in the token, null for a token outside all."""
    rows = base.where("size(tokens) > 0").select("key_id", "key_text", "base", F.explode("tokens").alias("t"))
    begins = F.filter("base", lambda b: (b["start"] >= F.col("t.start")) & (b["start"] < F.col("t.end")))
    touched = F.exists("base", lambda b: (b["start"] < F.col("t.end")) & (F.col("t.start") < b["end"]))
    return (
        rows.select("key_id", "key_text", "t.start", "t.end", "t.value", "t.left", begins.alias("b"), touched.alias("touched"))
        .where("size(b) > 0 or not touched")
        .select(
            "key_id", "key_text", "start", "end", "left",
            F.coalesce(F.get("b", F.lit(0))["value"].cast("string"), "value").alias("value"),
            F.get("b", F.lit(0))["kind"].alias("kind"),
        )
    )


def score_patterns(found: DataFrame, rounds: int, support: int) -> DataFrame:
    """``left, kind, confidence`` of patterns beside at least ``support`` different seeds of a kind.

    An edge joins a pattern and a token it stands by.  A pattern's confidence is
    the mean score of its tokens (one more token of score 0 smooths it); a token's
    is 1 for a seed, else one minus the product of its patterns' doubts.
    """
    edges = written(found.select("left", "value", "kind").distinct(), "pii-edges")
    seeded = edges.where("kind is not null").groupBy("left", "kind").agg(F.count(F.lit(1)).alias("seeds"))
    seeded = written(seeded.where(F.col("seeds") >= support), "pii-seeded")
    # each pattern's edges, per kind it may mean; seeds of other kinds count against it
    graph = edges.withColumnRenamed("kind", "own").join(seeded.select("left", "kind"), "left")
    graph = written(graph, "pii-graph")
    scores = None
    for _ in range(rounds):
        score = F.when(F.col("own") == F.col("kind"), 1.0)
        rows = graph
        if scores is not None:
            rows = rows.join(scores, ["value", "kind"], "left")
            score = score.when(F.col("own").isNull(), F.coalesce("score", F.lit(0.0)))
        patterns = rows.groupBy("left", "kind").agg(
            (F.sum(score.otherwise(0.0)) / (F.count(F.lit(1)) + 1)).alias("confidence")
        )
        patterns = written(patterns, "pii-patterns")
        doubt = F.log(F.greatest(1 - F.col("confidence"), F.lit(1e-6)))
        scores = (
            graph.where("own is null")
            .join(patterns, ["left", "kind"])
            .groupBy("value", "kind")
            .agg((1 - F.exp(F.sum(doubt))).alias("score"))
        )
        scores = written(scores, "pii-scores")
    return patterns


def personal_data(docs: DataFrame, rounds: int = 3, support: int = 3, least: float = 0.75) -> DataFrame:
    """Spans of personal data in every row's whole text.

    Returns ``doc_id, n_email, n_ip, n_card, n_phone`` (fixed forms),
    ``base_sha256``, ``spans`` (all, as ``kind:start:end``), ``n_added`` (those that
    patterns of confidence ``least`` or more found).  Null text counts as empty;
    rows that repeat an id are judged by their own texts; null ids are allowed and
    other columns ignored.
    """
    base = written(base_spans(docs), "pii-base")
    found = written(occurrences(base), "pii-tokens")
    patterns = score_patterns(found, rounds, support).where(F.col("confidence") >= least)
    best = patterns.groupBy("left").agg(F.max(F.struct("confidence", (-F.col("kind")).alias("minus"))).alias("b"))
    best = written(best.select("left", (-F.col("b.minus")).alias("kind")), "pii-best")
    added = (
        found.where("kind is null")
        .drop("kind")
        .join(best, "left")
        .groupBy("key_id", "key_text")
        .agg(F.collect_set(F.struct("kind", "start", "end")).alias("added"))
    )
    added = written(added, "pii-added")
    none = F.array().cast(added.schema["added"].dataType)
    plain = F.transform("base", lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    rows = base.drop("tokens").withColumn("base", plain).join(added, ["key_id", "key_text"], "left").withColumn("added", F.coalesce("added", none))
    names = F.array(*map(F.lit, KINDS))

    def listed(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", names[s["kind"]], s["start"], s["end"])), ",")

    return rows.select(
        "doc_id",
        *[
            (F.size("base") - F.size(F.array_remove("base.kind", k))).cast("long").alias(f"n_{name}")
            for k, name in enumerate(KINDS)
        ],
        F.sha2(listed(F.col("base")), 256).alias("base_sha256"),
        listed(F.array_sort(F.concat("base", "added"))).alias("spans"),
        F.size("added").cast("long").alias("n_added"),
    )

