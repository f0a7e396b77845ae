"""URL functions built from Spark's own string, array and regex expressions.

Parsing follows RFC 3986 with the leniency walkers need (non-ASCII hosts,
blanks in paths), which rules out ``parse_url``.  A reference that cannot be
parsed gives NULL, so callers drop it with an ordinary null filter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkloom.functions._let import Env, Step, chain_array, chain_columns, chain_expr, inline_expr, prefixed, settled

# Character classes (RFC 3986).  Fixed values.
_UNRESERVED = r"A-Za-z0-9\-._~"
_PATH_LEGAL = _UNRESERVED + r":/\[\]@!$&'()*+,;="
_PATH_STRICT = _UNRESERVED + r"$&+,/:;=@"
_FRAGMENT_LEGAL = _UNRESERVED + r":/\[\]@!$&'()*+,;=?%"
_QUERY_VALUE_LEGAL = _UNRESERVED + r"/?"
_SIMPLE_SEGMENT = r"[A-Za-z0-9\-_~!$&'()*+,;=:@]"

_SCHEME = r"^([A-Za-z][A-Za-z0-9+.\-]*):"
_BAD_ESCAPE = r"%(?:[^0-9A-Fa-f]|[0-9A-Fa-f][^0-9A-Fa-f]|[0-9A-Fa-f]?$)"
_CONTROL = r"[\x00-\x1f\x7f]"
_BAD_USERINFO = r"[^A-Za-z0-9\-._:~!$&'()*+,;=%@]"
_BAD_HOST = r"[\x20#/?@\\^`{|}]"
_BAD_HOST_ESCAPE = r"%(?:[^89A-Fa-f]|[89A-Fa-f][^0-9A-Fa-f]|[89A-Fa-f]?$)"
_BAD_PORT = r":[^:\]]*[^0-9:\]][^:\]]*$"
_DOT_SEGMENT = r"(?:^|/)\.\.?(?:/|$)"
_CLEAN_QUERY = rf"(?:\?[{_SIMPLE_SEGMENT[1:-1]}./?]++)?"
_ROOT_RELATIVE = rf"^(?:/{_SIMPLE_SEGMENT}[{_SIMPLE_SEGMENT[1:-1]}.]*+)++/?{_CLEAN_QUERY}$"
_CLEAN_ABSOLUTE = (
    rf"^https?://[A-Za-z0-9][A-Za-z0-9\-]*+(?:\.[A-Za-z0-9\-]++)*+"
    rf"(?:/{_SIMPLE_SEGMENT}[{_SIMPLE_SEGMENT[1:-1]}.]*+)*+/?{_CLEAN_QUERY}$"
)
_CLEAN_SIBLING = rf"^[A-Za-z0-9\-_~][A-Za-z0-9\-_.~]*+(?:/{_SIMPLE_SEGMENT}[{_SIMPLE_SEGMENT[1:-1]}.]*+)*+/?{_CLEAN_QUERY}$"
# a URL that already is in normal form, for the common case
_NORMAL = (
    rf"^https?://[a-z0-9][a-z0-9\-]*+(?:\.[a-z0-9\-]++)*+"
    rf"(?:/{_SIMPLE_SEGMENT}[{_SIMPLE_SEGMENT[1:-1]}.]*+)*+/?(?:\?[{_UNRESERVED}]++=[{_UNRESERVED}]*+)?$"
)
_REPLACEMENT = "�"


def _lit(s: str) -> Column:
    return F.lit(s)


def _after(c: Column, head: Column, skip: int) -> Column:
    """What follows ``head`` and ``skip`` more characters in ``c``."""
    return F.substring(c, F.length(head) + F.lit(skip + 1), F.length(c))


def _escape_runs(c: Column, legal: str) -> Column:
    """Percent-encode (UTF-8) every run of characters outside ``legal``."""
    encoded = F.array_join(
        F.transform(
            F.regexp_extract_all(c, _lit(f"[{legal}]+|[^{legal}]+"), F.lit(0)),
            lambda run: F.when(
                run.rlike(f"^[^{legal}]"),
                F.replace(F.replace(F.url_encode(run), _lit("+"), _lit("%20")), _lit("*"), _lit("%2A")),
            ).otherwise(run),
        ),
        "",
    )
    return F.when(c.rlike(f"[^{legal}]"), encoded).otherwise(c)


def _percent_decode(c: Column) -> Column:
    """Decode ``%xx`` only (a plus sign stays); NULL when malformed."""
    return F.try_url_decode(F.replace(c, _lit("+"), _lit("%2B")))


def _upper_escapes(c: Column) -> Column:
    pieces = F.split(c, "%")
    return F.concat(
        F.get(pieces, F.lit(0)),
        F.array_join(
            F.transform(
                F.slice(pieces, 2, F.greatest(F.size(pieces) - 1, F.lit(0))),
                lambda p: F.concat(_lit("%"), F.upper(F.substring(p, 1, 2)), F.substring(p, F.lit(3), F.length(p))),
            ),
            "",
        ),
    )


def _fold_dots(path: Column) -> Column:
    """Join of the path's segments after ``.`` and ``..`` have been applied."""
    empty = F.array().cast("array<string>")
    return F.array_join(
        F.aggregate(
            F.split(path, "/"),
            empty,
            lambda acc, seg: F.when(seg == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))))
            .when(seg == ".", acc)
            .otherwise(F.concat(acc, F.array(seg))),
        ),
        "/",
    )


# --------------------------------------------------------------------------
# Parsing
# --------------------------------------------------------------------------

# RFC 3986, appendix B: scheme, authority, path, query, fragment.
_URL = r"(?s)^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"


def _piece(group: int):
    return lambda e: F.regexp_extract(e["raw"], _URL, group)


# every step reads the text itself, so a step costs the same wherever it is used
PARSE: list[Step] = [
    ("scheme", lambda e: F.lower(F.regexp_extract(e["raw"], _URL, 1))),
    ("authority", _piece(2)),
    ("tail", _piece(3)),
    ("query", _piece(4)),
    ("fragment", _piece(5)),
    ("has_authority", lambda e: e["raw"].rlike(r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//")),
    ("is_opaque", lambda e: e["raw"].rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:(?!/)")),
    ("path", lambda e: F.when(e["is_opaque"], _lit("")).otherwise(e["tail"])),
    ("host", lambda e: F.substring_index(e["authority"], "@", -1)),
    ("valid", lambda e: _is_valid(e)),
]


def _userinfo(e: Env) -> Column:
    return F.regexp_extract(e["authority"], "^(.*@)", 1)


def _is_valid(e: Env) -> Column:
    bad = (
        e["raw"].rlike(_CONTROL)
        | (e["raw"].contains("%") & (e["path"].rlike(_BAD_ESCAPE) | e["fragment"].rlike(_BAD_ESCAPE)))
        # a colon in the first segment of something that has no scheme
        | e["raw"].rlike(r"^(?![A-Za-z][A-Za-z0-9+.\-]*:)[^/?#]*:")
        | e["host"].rlike(_BAD_HOST)
        | (e["host"].contains(":") & e["host"].rlike(_BAD_PORT))
        | (e["host"].contains("%") & e["host"].rlike(_BAD_HOST_ESCAPE))
        | (e["authority"].contains("@") & _userinfo(e).rlike(_BAD_USERINFO))
    )
    return F.coalesce(~bad, F.lit(False))


def _parts_struct(e: Env) -> Column:
    return F.when(
        e["valid"],
        F.struct(
            e["scheme"].alias("scheme"),
            e["authority"].alias("authority"),
            e["host"].alias("host"),
            F.regexp_extract(e["host"], r":([0-9]*)$", 1).alias("port"),
            e["tail"].alias("path"),
            e["query"].alias("query"),
            e["fragment"].alias("fragment"),
        ),
    )


def url_parts(c: Column) -> Column:
    """``struct<scheme,authority,host,port,path,query,fragment>``, NULL if unparsable.

    ``host`` keeps the port; the opaque part of a URL such as ``mailto:a@b`` is
    given as its path.
    """
    return inline_expr(PARSE, {"raw": c}, _parts_struct)


def url_valid(c: Column) -> Column:
    """True where the text parses as a URL reference."""
    return inline_expr(PARSE, {"raw": c}, lambda e: e["valid"])


# --------------------------------------------------------------------------
# Normalisation
# --------------------------------------------------------------------------


def _normal_host(e: Env) -> Column:
    host = F.lower(e["host"])
    stripped = (
        F.when(e["scheme"] == "http", F.regexp_replace(host, r":80$", ""))
        .when(e["scheme"] == "https", F.regexp_replace(host, r":443$", ""))
        .otherwise(host)
    )
    return F.concat(_userinfo(e), stripped)


def _normal_segments(e: Env) -> Column:
    path = e["decoded"]
    folded = _fold_dots(path)
    rooted = F.when((e["host"] != "") & ~folded.startswith("/"), F.concat(_lit("/"), folded)).otherwise(folded)
    closed = F.when(
        F.substring_index(path, "/", -1).isin(".", "..") & ~rooted.endswith("/"), F.concat(rooted, _lit("/"))
    ).otherwise(rooted)
    dotless = F.when(path.rlike(_DOT_SEGMENT), closed).otherwise(path)
    return F.regexp_replace(dotless, "/{2,}", "/")


def _normal_query(e: Env) -> Column:
    query = e["query"]

    def pair(p: Column) -> Column:
        key = F.substring_index(p, "=", 1)
        return F.struct(key.alias("k"), _after(p, key, 1).alias("v"))

    pairs = F.transform(F.filter(F.split(query, "&"), lambda p: p != ""), pair)
    plain = F.array_join(
        F.transform(F.array_sort(pairs), lambda p: F.concat(p["k"], _lit("="), p["v"])), "&"
    )
    decoded = F.filter(
        F.transform(
            pairs,
            lambda p: F.struct(F.try_url_decode(p["k"]).alias("k"), F.try_url_decode(p["v"]).alias("v")),
        ),
        lambda p: p["k"].isNotNull() & p["v"].isNotNull(),
    )
    key_legal = r"^%&=+#\x00-\x20\x7f"
    encoded = F.array_join(
        F.transform(
            F.array_sort(decoded),
            lambda p: F.concat(
                _escape_runs_negated(p["k"], key_legal[1:]),
                _lit("="),
                F.replace(_escape_runs(p["v"], _QUERY_VALUE_LEGAL), _lit("%20"), _lit("+")),
            ),
        ),
        "&",
    )
    # nothing decodable leaves the query as it was
    rewritten = F.when(encoded == "", query).otherwise(encoded)
    return (
        F.when(~query.contains("&") & query.rlike(rf"^[{_UNRESERVED}/?]*=[{_UNRESERVED}/?]*$"), query)
        .when(query == "", query)
        .when(query.rlike(rf"^[{_UNRESERVED}/?=&]*$") & ~query.rlike(r"=[^&]*="), plain)
        .otherwise(rewritten)
    )


def _escape_runs_negated(c: Column, illegal: str) -> Column:
    """Percent-encode only the characters listed in ``illegal``."""
    return F.when(
        c.rlike(f"[{illegal}]"),
        F.array_join(
            F.transform(
                F.regexp_extract_all(c, _lit(f"[{illegal}]|[^{illegal}]+"), F.lit(0)),
                lambda run: F.when(run.rlike(f"^[{illegal}]"), F.url_encode(run)).otherwise(run),
            ),
            "",
        ),
    ).otherwise(c)


def _join_normal(e: Env) -> Column:
    has_root = (e["scheme"] != "") | e["has_authority"]
    text = F.concat(
        F.when(e["scheme"] != "", F.concat(e["scheme"], _lit(":"))).otherwise(_lit("")),
        F.when(e["is_opaque"], e["tail"]).otherwise(
            F.concat(
                F.when(has_root, F.concat(_lit("//"), e["nhost"])).otherwise(_lit("")),
                e["npath"],
            )
        ),
        F.when(e["nquery"] != "", F.concat(_lit("?"), e["nquery"])).otherwise(_lit("")),
    )
    return F.when(e["valid"], text)


NORMALIZE: list[Step] = PARSE + [
    ("nhost", _normal_host),
    ("unescaped", lambda e: F.when(e["path"].contains("%"), _percent_decode(e["path"])).otherwise(e["path"])),
    # escapes that are not UTF-8 text stay as they are, in upper case
    ("opaque_bytes", lambda e: F.coalesce(e["unescaped"].contains(_REPLACEMENT), F.lit(True))),
    ("decoded", lambda e: F.when(e["opaque_bytes"], e["path"]).otherwise(e["unescaped"])),
    ("segments", _normal_segments),
    (
        "npath",
        lambda e: F.when(e["opaque_bytes"], _upper_escapes(e["segments"])).otherwise(
            _escape_runs(e["segments"], _PATH_LEGAL)
        ),
    ),
    ("nquery", _normal_query),
]


def normalize_url(c: Column) -> Column:
    """Canonical form of a URL; NULL if it does not parse.

    Lower-case scheme and host, no default port, dot segments and repeated
    slashes removed, no fragment, query sorted by key then value, minimal
    percent-escaping.  A trailing slash, ``www.`` and the scheme are kept.
    """
    return F.when(c.rlike(_NORMAL), c).otherwise(chain_expr(NORMALIZE, {"raw": c}, _join_normal))


def with_normalized_url(df: DataFrame, column: str = "url", output: str = "url") -> DataFrame:
    """Set ``output`` to the normal form of ``column`` (generated-code form)."""
    keep = df.columns
    # settled, so the steps are not planned once per branch of a union below
    df = df.select(*keep, settled(F.col(column)).alias("__n_given"))
    # a NULL goes through the steps at no cost, so URLs in normal form skip them
    given = F.col("__n_given")
    df = df.withColumn("__n_raw", F.when(~given.rlike(_NORMAL), given))
    df, env = chain_columns(df, NORMALIZE, {"raw": F.col("__n_raw")}, "__n_")
    others = [k for k in keep if k != output]
    result = F.when(F.col("__n_raw").isNull(), given).otherwise(_join_normal(env))
    df = df.select(*others, settled(result).alias(output))
    return df.select(*keep, *([] if output in keep else [output]))


def with_url_parts(df: DataFrame, column: str = "url", output: str = "parts") -> DataFrame:
    """Add :func:`url_parts` of ``column`` as ``output`` (generated-code form)."""
    keep = df.columns
    df, env = chain_columns(df, PARSE, {"raw": F.col(column)}, "__p_")
    return df.select(*keep, settled(_parts_struct(env)).alias(output))


# --------------------------------------------------------------------------
# Resolution
# --------------------------------------------------------------------------

def _network(e: Env) -> Column:
    return F.when(e["has_authority"], F.concat(_lit("//"), e["authority"])).otherwise(_lit(""))


#: what resolution needs from a base URL, computed once per base
BASE: list[Step] = PARSE + [
    ("prefix", lambda e: F.when(e["scheme"] != "", F.concat(e["scheme"], _lit(":"))).otherwise(_lit(""))),
    ("origin", lambda e: F.concat(e["prefix"], _network(e))),
    ("dir", lambda e: F.regexp_replace(e["path"], "[^/]*$", "")),
]
BASE_FIELDS = ["raw", "valid", "prefix", "origin", "path", "dir", "query", "fragment", "is_opaque", "tail"]


def _choose(e: Env, absolute: Column, network: Column, document: Column, other: Column) -> Column:
    """Pick by the form of the reference: own scheme, own host, nothing but ?/#, or a path."""
    return (
        F.when(e["scheme"] != "", absolute)
        .when(e["has_authority"], network)
        .when(e["path"] == "", document)
        .otherwise(other)
    )


def _resolve_steps(base: Env) -> list[Step]:
    """Steps turning a reference ``raw`` into its target, against a parsed base."""

    def root(e: Env) -> Column:
        own = F.concat(e["scheme"], _lit(":"), F.when(e["is_opaque"], e["tail"]).otherwise(_network(e)))
        return _choose(e, own, F.concat(base["prefix"], _network(e)), base["origin"], base["origin"])

    def full_path(e: Env) -> Column:
        inherited = F.when(base["is_opaque"], base["tail"]).otherwise(base["path"])
        merged = F.when(e["path"].startswith("/"), e["path"]).otherwise(F.concat(base["dir"], e["path"]))
        return _choose(e, e["path"], e["path"], inherited, merged)

    def query(e: Env) -> Column:
        inherited = F.when(e["has_query"], e["query"]).otherwise(base["query"])
        return _choose(e, e["query"], e["query"], inherited, e["query"])

    def fragment(e: Env) -> Column:
        same = ~e["has_query"] & (e["fragment"] == "")
        inherited = F.when(same, base["fragment"]).otherwise(e["fragment"])
        return _choose(e, e["fragment"], e["fragment"], inherited, e["fragment"])

    def closed(e: Env) -> Column:
        """RFC 3986 dot-segment removal; a final dot segment leaves a slash."""
        ends_open = F.substring_index(e["full"], "/", -1).isin(".", "..")
        return F.when(ends_open, F.concat(e["folded"], _lit("/"))).otherwise(e["folded"])

    return PARSE + [
        ("has_query", lambda e: e["raw"].rlike(r"^[^#]*\?")),
        ("full", full_path),
        ("folded", lambda e: F.when(e["full"].rlike(_DOT_SEGMENT), _fold_dots(e["full"])).otherwise(e["full"])),
        ("closed", closed),
        (
            # the result is rooted unless there was no path at all
            "target",
            lambda e: F.when((e["full"] == "") | e["closed"].startswith("/"), e["closed"]).otherwise(
                F.concat(_lit("/"), e["closed"])
            ),
        ),
        ("root", root),
        ("printed", lambda e: _printed_path(e["target"])),
        ("tquery", query),
        ("tfragment", fragment),
    ]


def _printed_path(path: Column) -> Column:
    """Escape a path holding illegal characters; a legal one is left alone."""
    return F.when(
        path.rlike(f"[^{_PATH_LEGAL}%]"),
        _escape_runs(F.coalesce(_percent_decode(path), path), _PATH_STRICT),
    ).otherwise(path)


def _join_resolved(base: Env, e: Env) -> Column:
    return F.when(
        e["valid"] & base["valid"],
        F.concat(
            e["root"],
            e["printed"],
            F.when(e["tquery"] != "", F.concat(_lit("?"), e["tquery"])).otherwise(_lit("")),
            F.when(e["tfragment"] != "", F.concat(_lit("#"), _escape_runs(e["tfragment"], _FRAGMENT_LEGAL))).otherwise(
                _lit("")
            ),
        ),
    )


def _quick_rules(base: Env, ref: Column) -> list[tuple[Column, Column]]:
    """Clean references, told by their look and resolved without parsing."""
    usable = base["valid"] & ~base["is_opaque"]
    return [
        (usable & ref.rlike(_ROOT_RELATIVE), F.concat(base["origin"], ref)),
        (usable & ref.rlike(_CLEAN_ABSOLUTE), ref),
        (
            usable & base["dir"].rlike(_ROOT_RELATIVE) & ref.rlike(_CLEAN_SIBLING),
            F.concat(base["origin"], base["dir"], ref),
        ),
    ]


def _quick(base: Env, ref: Column) -> Column:
    (c1, v1), *more = _quick_rules(base, ref)
    out = F.when(c1, v1)
    for condition, value in more:
        out = out.when(condition, value)
    return out


def resolve_links(base: Env, raws: Column) -> Column:
    """``array<struct<url,tag>>`` of ``raws`` (``array<struct<raw,tag>>``).

    ``base`` holds :data:`BASE` columns of the page.  Links that do not parse
    are left out.
    """
    tried = F.transform(
        raws, lambda r: F.struct(_quick(base, r["raw"]).alias("url"), r["tag"].alias("tag"), r["raw"].alias("raw"))
    )
    quick = F.transform(
        F.filter(tried, lambda t: t["url"].isNotNull()),
        lambda t: F.struct(t["url"].alias("url"), t["tag"].alias("tag")),
    )
    rest = F.filter(tried, lambda t: t["url"].isNull())
    full = chain_array(
        rest,
        ["raw", "tag"],
        _resolve_steps(base),
        lambda e: F.struct(_join_resolved(base, e).alias("url"), e["tag"].alias("tag")),
    )
    return F.concat(quick, F.filter(full, lambda r: r["url"].isNotNull()))


def resolve_url(base: Column, ref: Column) -> Column:
    """RFC 3986 reference resolution; NULL when either side does not parse."""
    names = ["b_" + f for f in BASE_FIELDS]

    def with_base(fn):
        return lambda e: fn({n[2:]: e[n] for n in names}, e)

    steps = prefixed(BASE, "b_")
    order = [name for name, _ in _resolve_steps({f: F.lit(None) for f in BASE_FIELDS})]
    for i, name in enumerate(order):
        steps.append((name, with_base(lambda b, e, i=i: _resolve_steps(b)[i][1](e))))
    return chain_expr(
        steps, {"b_raw": base, "raw": ref}, with_base(lambda b, e: _join_resolved(b, e))
    )


def with_resolved_url(df: DataFrame, base: str, ref: str, output: str = "url") -> DataFrame:
    """Set ``output`` to ``ref`` resolved against ``base`` (generated-code form)."""
    keep = [c for c in df.columns if c != output]
    df = df.withColumn("__r_base", F.col(base)).withColumn("__r_ref", F.col(ref))
    df, b = chain_columns(df, BASE, {"raw": F.col("__r_base")}, "__rb_")
    df, e = chain_columns(df, _resolve_steps(b), {"raw": F.col("__r_ref")}, "__rr_")
    return df.select(*keep, settled(_join_resolved(b, e)).alias(output))


# --------------------------------------------------------------------------
# Prefixes and small predicates
# --------------------------------------------------------------------------


def _bare_host(e: Env) -> Column:
    return F.regexp_replace(e["host"], r"^www\.", "")


def _plain_path(e: Env) -> Column:
    return F.when(e["path"].contains("%"), F.coalesce(_percent_decode(e["path"]), e["path"])).otherwise(e["path"])


def prefix_key(c: Column) -> Column:
    """Host without a leading ``www.`` and path without one trailing slash."""
    return inline_expr(
        PARSE,
        {"raw": c},
        lambda e: F.when(e["valid"], F.concat(_bare_host(e), F.regexp_replace(_plain_path(e), "/$", ""))),
    )


def _candidates(e: Env) -> Column:
    host = _bare_host(e)
    segments = F.filter(F.split(_plain_path(e), "/"), lambda s: s != "")
    # a running join: each element extends the one before it
    return F.aggregate(
        segments,
        F.array(host),
        lambda acc, seg: F.concat(acc, F.array(F.concat_ws("/", F.element_at(acc, -1), seg))),
    )


def prefix_candidates(c: Column) -> Column:
    """Every prefix a URL falls under: its host, then one more segment each."""
    return inline_expr(PARSE, {"raw": c}, lambda e: F.when(e["valid"], _candidates(e)))


def with_prefix_candidates(df: DataFrame, column: str = "url", output: str = "candidates") -> DataFrame:
    """Add :func:`prefix_candidates` of ``column`` (generated-code form)."""
    keep = df.columns
    df, env = chain_columns(df, PARSE, {"raw": F.col(column)}, "__c_")
    return df.select(*keep, settled(F.when(env["valid"], _candidates(env))).alias(output))


def plain_place(c: Column) -> Column:
    """Host and path of a URL in normal form, as prefixes have them; NULL of any other, without parsing it.

    Its candidate of ``d`` parts is what stands before the ``d``-th slash.
    """
    rest = F.substring_index(F.substring_index(c, "://", -1), "?", 1)
    bare = F.when(rest.startswith("www."), F.substring(rest, 5, F.length(rest))).otherwise(rest)
    # the end is the text's, not that of its last line
    return F.when(c.rlike(_NORMAL.removesuffix("$") + r"\z"), F.regexp_replace(bare, "/$", ""))


def url_scheme(c: Column) -> Column:
    """Lower-case scheme of a URL, empty when it has none."""
    return F.lower(F.regexp_extract(c, _SCHEME, 1))


def is_data_url(c: Column) -> Column:
    """True for a raw link that starts with exactly ``data:``."""
    return c.startswith("data:")
