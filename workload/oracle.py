"""The queries of ``workload/queries.py`` in DuckDB's SQL.

Each text is put together from named common table expressions, so the derived
tables are stated once.  The SQL works in its own way: list functions and RE2
where Spark uses higher-order functions, a recursive CTE where Spark loops.
"""

from __future__ import annotations

from linkloom.functions.ignore_list import FAMILIES, bundled
from linkloom.functions.regex_match import alternation
from workload import derived as D

CTES: dict[str, tuple[list[str], str]] = {}
ORACLE: dict[str, str] = {}


def cte(name: str, needs: str, text: str) -> None:
    CTES[name] = (needs.split(), text)


def oracle(name: str, needs: str, final: str) -> None:
    order: list[str] = []

    def visit(n: str) -> None:
        for dep in CTES[n][0]:
            visit(dep)
        if n not in order:
            order.append(n)

    for n in needs.split():
        visit(n)
    head = "WITH RECURSIVE " + ",\n".join(f"{n} AS ({CTES[n][1]})" for n in order) if order else ""
    ORACLE[name] = f"{head}\n{final}"


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def filled(template: str, key: str) -> str:
    parts = template.replace("{{", "\0").replace("}}", "\1").split("{id}")
    texts = [quoted(p.replace("\0", "{").replace("\1", "}")) for p in parts]
    return f" || CAST({key} AS VARCHAR) || ".join(texts)


# -- derived tables ---------------------------------------------------------

cte(
    "raw_urls",
    "",
    r"""
SELECT page_id AS id,
  CASE page_id % 12
    WHEN 0 THEN url
    WHEN 1 THEN upper(origin) || rest
    WHEN 2 THEN origin || CASE WHEN starts_with(url, 'https:') THEN ':443' ELSE ':80' END || rest
    WHEN 3 THEN origin || '//x/' || rest
    WHEN 4 THEN origin || '/a/../b/./c/..' || rest
    WHEN 5 THEN url || '#frag'
    WHEN 6 THEN bare || '?b=2&a=1&a=0&a-b=1&z'
    WHEN 7 THEN bare || '/wp-admin/'
    WHEN 8 THEN bare || '?replytocom=1'
    WHEN 9 THEN 'mailto:u' || page_id || '@example.com'
    WHEN 10 THEN regexp_replace(url, '^https?', 'ftp')
    ELSE bare || '/%7euser/%c3%a9' END AS url,
  CASE WHEN page_id % 5 = 0 THEN 1 ELSE 0 END AS tag, CAST(page_id % 15 AS INT) AS depth
FROM (SELECT page_id, url, regexp_extract(url, '^(https?://[^/]+)', 1) AS origin,
        regexp_replace(url, '^https?://[^/]+', '') AS rest, regexp_replace(url, '[?#].*$', '') AS bare
      FROM pages)""",
)
cte(
    "fetch_log",
    "",
    r"""
SELECT event_id, ts, 'http://host' || user_id || '.example.com/p/' || k AS url,
  CASE WHEN event_id % 5 = 0 THEN 1 ELSE 0 END AS tag, CAST(event_id % 15 AS INT) AS depth, status,
  CASE WHEN status IS NULL THEN 'timeout' END AS error,
  CASE WHEN event_type = 'click' THEN '/p/' || ((k + 1) % 100) ELSE '' END AS location,
  CAST(floor(value) AS BIGINT) AS size
FROM (SELECT *, CAST(regexp_extract(props, '(\d+)', 1) AS INT) AS k,
        CASE WHEN event_type IN ('view', 'purchase') THEN 200 WHEN event_type = 'click' THEN 302
             WHEN event_type = 'signup' THEN 404 WHEN event_id % 4 = 0 THEN 429
             WHEN event_id % 4 = 1 THEN NULL ELSE 503 END AS status
      FROM events)""",
)
cte(
    "many_urls",
    "",
    """
SELECT 'http://h' || l_suppkey || '.example.com/cat/' || l_partkey ||
  CASE l_linenumber WHEN 1 THEN '/wp-admin/' WHEN 2 THEN '?replytocom=1' ELSE '/item.html?id=7' END AS url
FROM lineitem""",
)
cte(
    "html_cases",
    "",
    f"""
SELECT page_id AS id, url, html || {filled(D.EXTRA_HTML, "page_id")} AS html FROM pages""",
)
cte("css_cases", "", f"SELECT page_id AS id, {filled(D.EXTRA_CSS, 'page_id')} || html AS css FROM pages")
cte(
    "frontier_rows",
    "fetch_log",
    """
SELECT url, tag, depth, ts AS not_before, CASE WHEN event_id % 10 = 0 THEN 'active' ELSE 'pending' END AS state,
  CAST(event_id % 3 AS INT) AS attempt
FROM fetch_log""",
)
cte(
    "site_links",
    "",
    f"""
SELECT '{D.SHOP}/region/' || n_regionkey AS src_url, '{D.SHOP}/nation/' || n_nationkey AS url, 0 AS tag FROM nation
UNION ALL SELECT '{D.SHOP}/nation/' || c_nationkey, '{D.SHOP}/customer/' || c_custkey, 0 FROM customer
UNION ALL SELECT '{D.SHOP}/customer/' || o_custkey, '{D.SHOP}/order/' || o_orderkey, 0 FROM orders
UNION ALL SELECT '{D.SHOP}/order/' || l_orderkey, '{D.SHOP}/part/' || l_partkey, 0 FROM lineitem
UNION ALL SELECT '{D.SHOP}/part/' || l_partkey, '{D.ASSETS}/supplier/' || l_suppkey, 1 FROM lineitem
UNION ALL SELECT '{D.ASSETS}/supplier/' || s_suppkey, '{D.SHOP}/nation/' || s_nationkey, 0 FROM supplier""",
)
cte(
    "site_responses",
    "",
    f"""
SELECT '{D.SHOP}/region/' || r_regionkey AS url, 200 AS status, '' AS location FROM region
UNION ALL SELECT '{D.SHOP}/nation/' || n_nationkey, 200, '' FROM nation
UNION ALL SELECT '{D.SHOP}/customer/' || c_custkey, CASE WHEN c_acctbal < 0 THEN 404 ELSE 200 END, '' FROM customer
UNION ALL SELECT '{D.SHOP}/order/' || o_orderkey,
  CASE o_orderstatus WHEN 'P' THEN 503 WHEN 'O' THEN 302 ELSE 200 END,
  CASE o_orderstatus WHEN 'O' THEN '/customer/' || o_custkey ELSE '' END FROM orders
UNION ALL SELECT '{D.SHOP}/part/' || p_partkey, 200, '' FROM part
UNION ALL SELECT '{D.ASSETS}/supplier/' || s_suppkey, 200, '' FROM supplier""",
)

# -- URLs -------------------------------------------------------------------

_PARSED = r"""
SELECT *, lower(regexp_extract({u}, '^([A-Za-z][A-Za-z0-9+.-]*):', 1)) AS scheme,
  regexp_extract({u}, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)', 1) AS authority,
  regexp_extract({u}, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)', 1) AS path,
  regexp_extract({u}, '^[^?#]*\?([^#]*)', 1) AS query,
  regexp_extract({u}, '^[^#]*#(.*)$', 1) AS fragment,
  regexp_matches({u}, '^[A-Za-z][A-Za-z0-9+.-]*:(?:[^/]|$)') AS is_opaque,
  NOT (regexp_matches({u}, '[\x00-\x1f\x7f]')
    OR regexp_matches(regexp_replace({u}, '\?[^#]*', ''), '%(?:[^0-9A-Fa-f]|[0-9A-Fa-f][^0-9A-Fa-f]|[0-9A-Fa-f]?$)')
    OR (NOT regexp_matches({u}, '^[A-Za-z][A-Za-z0-9+.-]*:') AND regexp_matches({u}, '^[^/?#]*:'))) AS valid
FROM {source}"""


def parsed(name: str, source: str, needs: str, column: str = "url") -> None:
    cte(name, needs, _PARSED.format(u=column, source=source))


# dot segments: a fold over one-element lists
_FOLD = (
    "array_to_string(list_reduce(list_transform(string_split({p}, '/'), lambda x: [x]), "
    "lambda acc, x: CASE WHEN x[1] = '..' THEN list_slice(acc, 1, len(acc) - 1) WHEN x[1] = '.' THEN acc "
    "ELSE list_concat(acc, x) END), '/')"
)
_ENDS_OPEN = r"regexp_matches({p}, '(^|/)\.\.?$')"
_ESCAPE = (
    "array_to_string(list_transform(regexp_extract_all({p}, '[{legal}]+|[^{legal}]+'), "
    "lambda r: CASE WHEN regexp_matches(r, '^[^{legal}]') THEN url_encode(r) ELSE r END), '')"
)
_PATH_LEGAL = r"A-Za-z0-9\-._~:/\[\]@!$&''()*+,;="


def normalized(name: str, source: str, needs: str, column: str = "url") -> None:
    """CTE adding ``norm``, the normal form of a column (NULL if invalid)."""
    parsed(f"{name}_p", source, needs, column)
    cte(
        f"{name}_d",
        f"{name}_p",
        f"""
SELECT *, CASE WHEN is_opaque THEN '' WHEN NOT valid THEN path ELSE url_decode(path) END AS dpath,
  CASE scheme WHEN 'http' THEN regexp_replace(lower(authority), ':80$', '')
              WHEN 'https' THEN regexp_replace(lower(authority), ':443$', '') ELSE lower(authority) END AS nhost,
  array_to_string(list_transform(list_sort(list_transform(
    list_filter(string_split(query, '&'), lambda q: q <> ''),
    lambda q: {{'k': split_part(q, '=', 1), 'v': regexp_replace(q, '^[^=]*=?', '')}})),
    lambda s: s.k || '=' || s.v), '&') AS nquery
FROM {name}_p""",
    )
    folded = _FOLD.format(p="dpath")
    cte(
        f"{name}_f",
        f"{name}_d",
        f"""
SELECT *, regexp_replace(
    CASE WHEN {_ENDS_OPEN.format(p="dpath")} AND NOT ends_with(folded, '/') THEN folded || '/' ELSE folded END,
    '/+', '/', 'g') AS fpath
FROM (SELECT *, CASE WHEN dpath = '' THEN '' WHEN authority <> '' AND NOT starts_with({folded}, '/')
        THEN '/' || {folded} ELSE {folded} END AS folded FROM {name}_d)""",
    )
    cte(
        name,
        f"{name}_f",
        f"""
SELECT *, CASE WHEN NOT valid THEN NULL
  WHEN is_opaque THEN scheme || ':' || path || CASE WHEN nquery <> '' THEN '?' || nquery ELSE '' END
  ELSE CASE WHEN scheme <> '' THEN scheme || ':' ELSE '' END
    || CASE WHEN scheme <> '' OR authority <> '' THEN '//' || nhost ELSE '' END
    || {_ESCAPE.format(p="fpath", legal=_PATH_LEGAL)}
    || CASE WHEN nquery <> '' THEN '?' || nquery ELSE '' END END AS norm
FROM {name}_f""",
    )


def resolved(name: str, source: str, needs: str) -> None:
    """CTE adding ``target``: column ``raw`` resolved against column ``url``."""
    parsed(f"{name}_r", source, needs, "raw")
    cte(
        f"{name}_b",
        f"{name}_r",
        r"""
SELECT *, regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) AS origin,
  regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS bpath,
  regexp_extract(url, '^[^?#]*\?([^#]*)', 1) AS bquery, regexp_extract(url, '#(.*)$', 1) AS bfragment,
  raw LIKE '%?%' AND NOT regexp_matches(raw, '^[^?]*#') AS has_query
FROM {0}_r""".format(name),
    )
    cte(
        f"{name}_t",
        f"{name}_b",
        r"""
SELECT *, CASE WHEN scheme <> '' AND NOT is_opaque THEN scheme || '://' || authority
               WHEN is_opaque THEN scheme || ':' || path
               WHEN starts_with(raw, '//') THEN regexp_extract(url, '^[a-z]+:') || '//' || authority
               ELSE origin END AS troot,
  CASE WHEN is_opaque THEN '' WHEN scheme <> '' OR starts_with(raw, '//') OR starts_with(path, '/') THEN path
       WHEN path = '' THEN bpath ELSE regexp_replace(bpath, '[^/]*$', '') || path END AS full_path,
  CASE WHEN scheme = '' AND NOT starts_with(raw, '//') AND path = '' AND NOT has_query THEN bquery
       ELSE query END AS tquery,
  CASE WHEN raw = '' THEN bfragment ELSE fragment END AS tfragment
FROM {0}_b""".format(name),
    )
    fold = _FOLD.format(p="full_path")
    legal = _PATH_LEGAL + "%"
    cte(
        name,
        f"{name}_t",
        f"""
SELECT *, CASE WHEN valid THEN troot || {_ESCAPE.format(p="tpath", legal=legal)}
    || CASE WHEN tquery <> '' THEN '?' || tquery ELSE '' END
    || CASE WHEN tfragment <> '' THEN '#' || tfragment ELSE '' END END AS target
FROM (SELECT *, CASE WHEN full_path = '' THEN '' WHEN NOT starts_with(closed, '/') THEN '/' || closed ELSE closed END AS tpath
  FROM (SELECT *, CASE WHEN {_ENDS_OPEN.format(p="full_path")} THEN {fold} || '/' ELSE {fold} END AS closed FROM {name}_t))""",
    )


normalized("raw_norm", "raw_urls", "raw_urls")
parsed("raw_parsed", "raw_urls", "raw_urls")
cte(
    "raw_prefix",
    "raw_parsed",
    """
SELECT *, regexp_replace(regexp_replace(authority, '^.*@', ''), '^www\\.', '') AS bare,
  CASE WHEN is_opaque THEN '' ELSE url_decode(path) END AS plain FROM raw_parsed WHERE valid""".replace("\\\\", "\\"),
)
oracle(
    "url_parts",
    "raw_parsed",
    """SELECT id, scheme, authority, regexp_replace(authority, '^.*@', '') AS host,
  regexp_extract(authority, ':([0-9]*)$', 1) AS port, path, query, fragment FROM raw_parsed""",
)
oracle("normalize_url", "raw_norm", "SELECT id, norm AS url FROM raw_norm")
oracle("prefix_key", "raw_prefix", "SELECT id, bare || regexp_replace(plain, '/$', '') AS prefix FROM raw_prefix")
oracle(
    "prefix_candidates",
    "raw_prefix",
    """SELECT id, CAST(n AS INT) AS n, array_to_string(list_concat([bare], list_slice(segs, 1, n)), '/') AS candidate
FROM (SELECT id, bare, segs, unnest(range(0, len(segs) + 1)) AS n
      FROM (SELECT id, bare, list_filter(string_split(plain, '/'), lambda s: s <> '') AS segs FROM raw_prefix))""",
)

# -- link extraction --------------------------------------------------------

_ATTRS = """(?:[^>"'']|"[^"]*"|''[^'']*'')*"""


def _raw_text(tag: str) -> str:
    return rf"<{tag}(?:[\s/]{_ATTRS})?>.*?</{tag}[\s/>]"


_TOKEN = (
    "(?is)<!--.*?-->|<[!?][^>]*>|("
    + "|".join(_raw_text(t) for t in ("style", "script", "iframe"))
    + rf"|<(?:a|link|img|source|object)[\s/]{_ATTRS}>)|"
    + "|".join(_raw_text(t) for t in ("textarea", "title", "noscript", "xmp"))
    + rf"|</?[a-z]{_ATTRS}>"
)
_ATTRIBUTE = r"""([^\s"''>/=]+)(?:\s*=\s*("[^"]*"|''[^'']*''|[^\s"''>][^\s>]*))?"""
_CSS = """(?:@import|:).*url\\(["'']?([^''"\\)]+)["'']?\\)"""


def _unescaped(c: str) -> str:
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        c = f"replace({c}, {quoted(entity)}, {quoted(char)})"
    return c


def links_of(name: str, source: str, needs: str) -> None:
    """CTEs: ``<name>`` (id, url, raw, tag) from tags, ``<name>_style`` from styles."""
    cte(
        f"{name}_tok",
        needs,
        f"SELECT id, url, token FROM (SELECT id, url, unnest(regexp_extract_all(html, '{_TOKEN}', 1)) AS token FROM {source}) WHERE token <> ''",
    )
    cte(
        f"{name}_attr",
        f"{name}_tok",
        rf"""
SELECT *, list_transform(regexp_extract_all(inner_text, '{_ATTRIBUTE}', 1), lambda n: lower(n)) AS names,
  regexp_extract_all(inner_text, '{_ATTRIBUTE}', 2) AS vals
FROM (SELECT id, url, element, CASE element WHEN 'object' THEN 'data' WHEN 'a' THEN 'href' WHEN 'link' THEN 'href' ELSE 'src' END AS wanted,
    regexp_extract(token, '(?is)^<[a-z]+({_ATTRS})>', 1) AS inner_text
  FROM (SELECT *, lower(regexp_extract(token, '^<([A-Za-z]+)', 1)) AS element FROM {name}_tok)
  WHERE element <> 'style')""",
    )
    value = "CASE WHEN left(v, 1) IN ('\"', '''') THEN substr(v, 2, length(v) - 2) ELSE v END"
    cte(
        name,
        f"{name}_attr",
        f"""
SELECT id, url, {_unescaped(value)} AS raw, CASE WHEN element = 'a' THEN 0 ELSE 1 END AS tag
FROM (SELECT *, coalesce(vals[list_position(names, wanted)], '') AS v FROM {name}_attr WHERE list_contains(names, wanted))""",
    )
    cte(
        f"{name}_style",
        f"{name}_tok",
        rf"""
SELECT id, url, unnest(regexp_extract_all(regexp_replace(token, '(?is)^<style{_ATTRS}>', ''), '{_CSS}', 1)) AS raw, 1 AS tag
FROM {name}_tok WHERE regexp_matches(token, '(?i)^<style[\s/>]')""",
    )


links_of("case_links", "html_cases", "html_cases")
cte(
    "case_raw",
    "case_links case_links_style",
    "SELECT * FROM case_links UNION ALL SELECT * FROM case_links_style",
)
resolved("case_targets", "(SELECT * FROM case_raw WHERE NOT starts_with(raw, 'data:'))", "case_raw")
cte(
    "page_edges",
    "case_targets",
    "SELECT id, url AS src, target AS url, max(tag) AS tag FROM case_targets WHERE target IS NOT NULL GROUP BY id, url, target",
)
resolved("case_resolved", "case_links", "case_links")
oracle("resolve_url", "case_resolved", "SELECT id, raw, target FROM case_resolved")
oracle("is_data_url", "case_links", "SELECT starts_with(raw, 'data:') AS is_data, count(*) AS n FROM case_links GROUP BY 1")
oracle("html_links", "case_links", "SELECT id, raw, tag FROM case_links")
oracle("html_links_parsed", "case_links", "SELECT id, raw, tag FROM case_links")
oracle("style_links", "case_links_style", "SELECT id, raw, tag FROM case_links_style")
oracle("css_links", "css_cases", f"SELECT id, unnest(regexp_extract_all(css, '{_CSS}', 1)) AS raw, 1 AS tag FROM css_cases")
oracle(
    "raw_links",
    "case_raw css_cases",
    f"""SELECT id, raw, tag FROM case_raw WHERE id % 3 <> 2 -- the rest is served as plain text
UNION ALL SELECT -id - 1, unnest(regexp_extract_all(css, '{_CSS}', 1)), 1 FROM css_cases""",
)
oracle("page_links_of_pages", "page_edges", "SELECT id, url, tag FROM page_edges")
oracle(
    "link_targets",
    "page_edges",
    """SELECT regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS host, count(*) AS links,
  CAST(sum(tag) AS BIGINT) AS related, count(DISTINCT id) AS pages FROM page_edges GROUP BY 1""",
)
oracle(
    "edge_table",
    "page_edges",
    "SELECT src, tag, count(*) AS n, max(url) AS last, 1 AS depth FROM page_edges GROUP BY src, tag",
)

# -- scopes -----------------------------------------------------------------

_IGNORE = quoted(alternation([p for _, p in bundled()]))
cte("norm", "raw_norm", "SELECT id, norm AS url, tag, depth FROM raw_norm WHERE norm IS NOT NULL")


def _in_scope(name: str, condition: str, needs: str = "norm") -> None:
    oracle(name, needs, f"SELECT id FROM norm WHERE {condition}")


_in_scope("depth_scope", "depth < 10")
_in_scope("scheme_scope", "split_part(url, ':', 1) IN ('http', 'ftp')")
_in_scope("related_scope", "tag = 1")
_in_scope("all_of", "depth < 10 AND split_part(url, ':', 1) = 'https'")
_in_scope("any_of", "depth < 3 OR tag = 1")
_in_scope("user_scope", "length(url) > 40 OR depth = 0")

# a URL is under a prefix if, one slash appended to both, it starts with it
_KEY = r"regexp_replace(regexp_replace(regexp_replace({u}, '[?#].*$', ''), '^[a-z]+://(www\.)?', ''), '/$', '')"
cte("page_keys", "", f"SELECT DISTINCT {_KEY.format(u='url')} AS k FROM pages")
cte(
    "norm_keys",
    "norm",
    rf"""SELECT id, array_to_string(list_slice(parts, 1, n), '/') AS k
FROM (SELECT id, parts, unnest(range(1, len(parts) + 1)) AS n
  FROM (SELECT id, list_filter(string_split(url_decode({_KEY.format(u="url")}), '/'), lambda s: s <> '') AS parts FROM norm))""",
)
cte("under_seeds", "norm_keys page_keys", "SELECT DISTINCT id FROM norm_keys JOIN page_keys USING (k)")
_in_scope("seed_scope", "id IN (SELECT id FROM under_seeds)", "norm under_seeds")
_in_scope(
    "links_scope",
    "id IN (SELECT id FROM under_seeds) AND depth < 10 AND split_part(url, ':', 1) IN ('http', 'https')",
    "norm under_seeds",
)
_in_scope(
    "site_scope",
    f"""((id IN (SELECT id FROM under_seeds) AND depth < 12 AND split_part(url, ':', 1) IN ('http', 'https')) OR tag = 1)
  AND NOT regexp_matches(url, {_IGNORE}) AND NOT regexp_matches(url, 'utm_source=')""",
    "norm under_seeds",
)
_PREFIXED = """SELECT m.url, count(*) AS n FROM many_urls m
WHERE EXISTS (SELECT 1 FROM supplier s
  WHERE starts_with(regexp_replace(m.url, '[?].*$', '') || '/', 'http://h' || s_suppkey || '.example.com/cat/' || s_nationkey || '/'))
GROUP BY m.url"""
oracle("prefix_scope", "many_urls", _PREFIXED)
oracle("semi_join_prefixes", "many_urls", _PREFIXED)
oracle(
    "ignore_scope",
    "many_urls",
    f"SELECT url, count(*) AS n FROM many_urls WHERE NOT regexp_matches(url, {_IGNORE}) GROUP BY url",
)
_FAMILY_COUNTS = " UNION ALL ".join(
    f"SELECT {quoted(f)} AS family, count(*) AS urls FROM both_urls WHERE regexp_matches(url, {quoted(alternation(p))})"
    for f, p in FAMILIES.items()
)
cte("both_urls", "many_urls norm", "SELECT url FROM many_urls UNION ALL SELECT url FROM norm")
oracle("ignore_families", "both_urls", f"SELECT family, urls FROM ({_FAMILY_COUNTS}) WHERE urls > 0")

# -- list sources -----------------------------------------------------------

oracle("read_url_list", "raw_urls", "SELECT url, 0 AS tag, 0 AS depth FROM raw_urls")
oracle(
    "read_exclude_patterns",
    "many_urls",
    r"""SELECT url, count(*) AS n FROM many_urls
WHERE NOT EXISTS (SELECT 1 FROM nation WHERE starts_with(url, 'http://h' || n_nationkey || '.example')) GROUP BY url""",
)
oracle(
    "read_ignore_json",
    "many_urls",
    r"""SELECT url, count(*) AS n FROM many_urls WHERE NOT EXISTS
  (SELECT 1 FROM nation WHERE ends_with(regexp_extract(url, '/cat/(\d+)/', 1), CAST(n_nationkey AS VARCHAR))
     AND regexp_matches(url, '/cat/\d+/')) GROUP BY url""",
)
oracle(
    "seeds",
    "site_links",
    f"""SELECT url, tag, 1 AS depth, src_url AS parent FROM site_links JOIN region ON src_url = '{D.SHOP}/region/' || r_regionkey""",
)

# -- response handling ------------------------------------------------------

_RETRY = "(status IS NULL OR status = 429 OR status >= 500)"
oracle("needs_retry", "fetch_log", f"SELECT event_id, url, status, error FROM fetch_log WHERE {_RETRY}")
oracle("successful", "fetch_log", "SELECT event_id, url, status FROM fetch_log WHERE status < 400")
oracle(
    "redirect_edges",
    "fetch_log",
    r"""SELECT url AS src_url, regexp_extract(url, '^(http://[^/]+)', 1) || location AS url, tag, depth + 1 AS depth
FROM fetch_log WHERE status BETWEEN 300 AND 399 AND location <> ''""",
)
oracle(
    "classify",
    "fetch_log",
    f"""SELECT event_id, CASE WHEN {_RETRY} THEN 'retry' WHEN status >= 400 THEN 'dropped'
  WHEN status >= 300 AND location <> '' THEN 'saved+redirect' ELSE 'saved' END AS outcome FROM fetch_log""",
)
oracle(
    "handler",
    "fetch_log",
    "SELECT regexp_extract(url, '^(http://[^/]+)', 1) || '/' AS url, count(*) AS n FROM fetch_log WHERE status < 400 GROUP BY 1",
)

# -- frontier ---------------------------------------------------------------

oracle(
    "first_seen",
    "fetch_log",
    """SELECT url, tag, depth FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY depth, tag) AS rn FROM fetch_log) WHERE rn = 1""",
)
oracle(
    "first_seen_parent",
    "site_links",
    """SELECT url, tag, depth, src_url FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY depth, tag, src_url) AS rn
  FROM (SELECT *, CAST(length(src_url) AS INT) AS depth FROM site_links)) WHERE rn = 1""",
)
oracle(
    "anti_join_seen",
    "fetch_log",
    f"SELECT DISTINCT url FROM fetch_log WHERE {_RETRY} EXCEPT SELECT url FROM fetch_log WHERE status < 400",
)
oracle(
    "expand_frontier",
    "site_links",
    f"""SELECT url, tag, CAST(length(o_orderstatus) + 1 AS INT) AS depth, count(*) AS n, min(src_url) AS parent
FROM site_links JOIN orders ON src_url = '{D.SHOP}/order/' || o_orderkey GROUP BY ALL""",
)
normalized("pages_norm", "(SELECT page_id, url FROM pages)", "")
oracle(
    "enqueue",
    "norm pages_norm",
    f"""SELECT url, tag, depth FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY depth, tag) AS rn FROM norm
  WHERE split_part(url, ':', 1) IN ('http', 'https') AND depth < 14 AND NOT regexp_matches(url, {_IGNORE}))
WHERE rn = 1 AND url NOT IN (SELECT norm FROM pages_norm WHERE norm IS NOT NULL)""",
)
_T = "strftime({0}, '%Y-%m-%d %H:%M:%S.%f') AS {0}"
oracle(
    "due_batch",
    "frontier_rows",
    f"""SELECT url, {_T.format("not_before")} FROM (SELECT * FROM frontier_rows WHERE state = 'pending'
  AND not_before <= (SELECT min(not_before) + INTERVAL 10 DAY FROM frontier_rows) ORDER BY not_before, url LIMIT 100)""",
)
oracle(
    "due_scan",
    "frontier_rows",
    f"""SELECT url, {_T.format("not_before")}, attempt FROM frontier_rows WHERE state = 'pending'
  AND not_before <= (SELECT min(not_before) + INTERVAL 10 DAY FROM frontier_rows)""",
)
_RETRIES = f"""SELECT url, tag, depth, {_T.format("not_before")}, 'pending' AS state, 1 AS attempt
FROM (SELECT *, ts + INTERVAL 180 SECOND AS not_before FROM fetch_log WHERE {_RETRY})"""
oracle("retry_schedule", "fetch_log", _RETRIES)
oracle(
    "requeue_active",
    "frontier_rows",
    "SELECT 'pending' AS state, attempt, count(*) AS n FROM frontier_rows GROUP BY attempt",
)
oracle("backlog", "frontier_rows", "SELECT state, count(*) AS n FROM frontier_rows GROUP BY state")
cte("captured", "pages_norm", "SELECT norm AS url, min(page_id) AS page_id FROM pages_norm WHERE norm IS NOT NULL GROUP BY norm")
oracle(
    "lookup_responses",
    "norm fetch_log captured",
    """SELECT url, page_id, CASE WHEN page_id IS NULL THEN 'retry' ELSE 'saved' END AS outcome
FROM (SELECT url FROM norm UNION SELECT url FROM fetch_log) LEFT JOIN captured USING (url)""",
)
cte("open_pages", "site_responses", "SELECT * FROM site_responses WHERE status < 400")
cte(
    "shop_edges",
    "site_links open_pages",
    f"""SELECT DISTINCT l.src_url, l.url, l.tag, CAST(NULL AS INT) AS src_tag FROM site_links l JOIN open_pages p ON l.src_url = p.url
UNION SELECT url, '{D.SHOP}' || location, t.tag, t.tag FROM open_pages, (VALUES (0), (1)) t(tag) WHERE status >= 300""",
)
cte(
    "walk",
    "shop_edges",
    f"""SELECT '{D.SHOP}/region/' || r_regionkey AS url, 0 AS tag, 0 AS depth FROM region
UNION SELECT e.url, e.tag, w.depth + 1 FROM walk w JOIN shop_edges e ON e.src_url = w.url AND (e.src_tag IS NULL OR e.src_tag = w.tag)
  WHERE w.depth < 8 AND (e.tag = 1 OR starts_with(e.url, '{D.SHOP}/'))""",
)
cte(
    "reached",
    "walk",
    "SELECT url, tag, depth FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY depth, tag) AS rn FROM walk) WHERE rn = 1",
)
_OUTCOME = """CASE WHEN status IS NULL OR status >= 500 THEN 'retry' WHEN status >= 400 THEN 'dropped'
  WHEN status >= 300 THEN 'saved+redirect' ELSE 'saved' END AS outcome"""
oracle(
    "walk_bfs",
    "reached shop_edges site_responses",
    f"""SELECT r.url, r.tag, r.depth, coalesce(min(p.url), '') AS parent, {_OUTCOME.replace("status", "any_value(s.status)")}
FROM reached r LEFT JOIN site_responses s USING (url) LEFT JOIN shop_edges e ON e.url = r.url AND e.tag = r.tag
LEFT JOIN reached p ON p.url = e.src_url AND p.depth = r.depth - 1 AND (e.src_tag IS NULL OR e.src_tag = p.tag)
GROUP BY r.url, r.tag, r.depth""",
)
oracle(
    "walk_resume",
    "reached site_responses",
    f"SELECT url, tag, depth, {_OUTCOME} FROM reached LEFT JOIN site_responses USING (url)",
)
cte("plain_pages", "pages_norm", "SELECT page_id AS id, norm AS url, html FROM pages_norm JOIN captured USING (page_id) JOIN pages USING (page_id)")
CTES["plain_pages"] = (
    ["captured"],
    "SELECT c.page_id AS id, c.url, html FROM captured c JOIN pages p USING (page_id)",
)
links_of("plain_links", "plain_pages", "plain_pages")
resolved(
    "plain_resolved",
    "(SELECT * FROM plain_links UNION ALL SELECT * FROM plain_links_style)",
    "plain_links plain_links_style",
)
normalized("plain_norm", "(SELECT target, tag AS link_tag FROM plain_resolved WHERE target IS NOT NULL AND NOT starts_with(raw, 'data:'))", "plain_resolved", "target")
oracle(
    "walk_pages",
    "plain_norm captured",
    """SELECT url, tag, depth, CASE WHEN page_id IS NULL THEN 'retry' ELSE 'saved' END AS outcome
FROM (SELECT url, 0 AS tag, 0 AS depth FROM captured
  UNION ALL SELECT norm, min(link_tag), 1 FROM plain_norm WHERE scheme IN ('http', 'https') AND norm NOT IN (SELECT url FROM captured) GROUP BY norm)
LEFT JOIN captured USING (url)""",
)

# -- statistics -------------------------------------------------------------

_BYTES = "CASE WHEN status < 400 THEN size ELSE 0 END"
oracle(
    "fetch_stats",
    "fetch_log",
    f"""SELECT urls, bytes, bytes / (micros / 1e6) / 1000 AS kb_per_s
FROM (SELECT count(status) AS urls, CAST(sum({_BYTES}) AS BIGINT) AS bytes, epoch_us(max(ts)) - epoch_us(min(ts)) AS micros FROM fetch_log)""",
)
_HISTOGRAM = "SELECT status, count(*) AS urls FROM fetch_log WHERE status IS NOT NULL GROUP BY status"
oracle("status_histogram", "fetch_log", _HISTOGRAM)
oracle("status_map", "fetch_log", _HISTOGRAM)
cte(
    "periods",
    "fetch_log",
    f"""SELECT time_bucket(INTERVAL 10 SECOND, ts) + INTERVAL 10 SECOND AS period_end, status, count(*) AS u, sum({_BYTES}) AS b
FROM fetch_log WHERE status IS NOT NULL GROUP BY 1, 2""",
)
oracle(
    "stats_every",
    "periods",
    f"""SELECT {_T.format("period_end")}, CAST(sum(u) OVER w AS BIGINT) AS urls, CAST(sum(b) OVER w AS BIGINT) AS bytes
FROM (SELECT period_end, sum(u) AS u, sum(b) AS b FROM periods GROUP BY 1) WINDOW w AS (ORDER BY period_end)""",
)
oracle(
    "stats_every_by_status",
    "periods",
    f"""SELECT {_T.format("period_end")}, status, CAST(sum(u) OVER w AS BIGINT) AS urls, CAST(sum(b) OVER w AS BIGINT) AS bytes
FROM periods WINDOW w AS (PARTITION BY status ORDER BY period_end)""",
)
oracle(
    "stats_report",
    "periods fetch_log",
    f"""SELECT {_T.format("period_end")}, CAST(sum(u) OVER w AS BIGINT) AS urls, CAST(sum(b) OVER w AS BIGINT) AS bytes,
  CAST(u AS BIGINT) AS period_urls, CAST(b AS BIGINT) AS period_bytes,
  CAST(sum(b) OVER w AS BIGINT) / ((epoch_us(period_end) - epoch_us((SELECT min(ts) FROM fetch_log WHERE status IS NOT NULL))) / 1e6) / 1000 AS kb_per_s
FROM (SELECT period_end, sum(u) AS u, sum(b) AS b FROM periods GROUP BY 1) WINDOW w AS (ORDER BY period_end)""",
)
oracle("bytes_read", "fetch_log", f"SELECT CAST(sum({_BYTES}) AS BIGINT) AS bytes FROM fetch_log")
oracle("saved_count", "fetch_log", "SELECT count(*) AS saved FROM fetch_log WHERE status < 400")

# -- archives ---------------------------------------------------------------

_LINE = "chr(13) || chr(10)"
cte(
    "archived",
    "fetch_log",
    f"""SELECT url, ts, 'request' AS warc_type, 'GET ' || regexp_replace(url, '^http://[^/]+', '') || ' HTTP/1.1' || {_LINE}
    || 'Host: ' || regexp_extract(url, '^http://([^/]+)', 1) || {_LINE} || 'User-Agent: linkloom/1.0' || {_LINE} || {_LINE} AS payload
  FROM fetch_log WHERE status < 400
UNION ALL SELECT url, ts, 'response', 'HTTP/1.1 ' || CASE status WHEN 200 THEN '200 OK' ELSE '302 Found' END || {_LINE}
    || 'Content-Type: text/html' || {_LINE} || CASE WHEN location <> '' THEN 'Location: ' || location || {_LINE} ELSE '' END
    || {_LINE} || repeat('x', size) FROM fetch_log WHERE status < 400""",
)
_DIGEST = "md5(url || chr(10) || strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || chr(10) || warc_type)"
oracle(
    "warc_records",
    "archived",
    f"""SELECT '<urn:uuid:' || substr(d, 1, 8) || '-' || substr(d, 9, 4) || '-' || substr(d, 13, 4) || '-' || substr(d, 17, 4)
    || '-' || substr(d, 21, 12) || '>' AS record_id, warc_type, url AS target_uri, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS date,
  'application/http; msgtype=' || warc_type AS content_type, CAST(strlen(payload) AS BIGINT) AS content_length, md5(payload) AS payload_md5
FROM (SELECT *, {_DIGEST} AS d FROM archived)""",
)
_ARCHIVE = "SELECT warc_type, count(*) AS records, CAST(sum(strlen(payload)) AS BIGINT) AS bytes FROM archived GROUP BY 1"
oracle("warc_files", "archived", _ARCHIVE)
oracle("warc_reruns", "archived", _ARCHIVE)
oracle("stream_to_warc", "archived", _ARCHIVE)

# -- streams ----------------------------------------------------------------

oracle(
    "stream_frontier",
    "norm",
    f"SELECT DISTINCT url FROM norm WHERE split_part(url, ':', 1) IN ('http', 'https') AND NOT regexp_matches(url, {_IGNORE})",
)
oracle(
    "stream_stats",
    "fetch_log",
    f"SELECT status, count(*) AS urls, CAST(sum({_BYTES}) AS BIGINT) AS bytes FROM fetch_log WHERE status IS NOT NULL GROUP BY status",
)
# released once the clock has passed the end of the second an item is due in
oracle(
    "stream_retries",
    "fetch_log",
    _RETRIES + " WHERE date_trunc('second', not_before) + INTERVAL 1 SECOND <= (SELECT max(ts) FROM fetch_log)",
)
for restarted in ("stream_frontier", "stream_retries"):
    ORACLE[f"{restarted}_restart"] = ORACLE[restarted]
