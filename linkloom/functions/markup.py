"""Link extraction from HTML and CSS text, as Column expressions.

One pass of a single regular expression cuts a page into the pieces that
matter: comments and raw-text bodies are consumed, so nothing inside them can
look like a tag, and only link-bearing tags and ``<style>`` elements are kept.
Quantifiers are possessive where the JVM's matcher would otherwise recurse, so
page length is not limited.
"""

from __future__ import annotations

import json
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

# Link kinds.  Fixed values.
TAG_PRIMARY = 0  # another page
TAG_RELATED = 1  # a resource of the page

# Which attribute of which element is a link, and its kind.  Fixed values.
LINK_RULES = [
    ("a", "href", TAG_PRIMARY),
    ("link", "href", TAG_RELATED),
    ("img", "src", TAG_RELATED),
    ("script", "src", TAG_RELATED),
    ("iframe", "src", TAG_RELATED),
    ("source", "src", TAG_RELATED),
    ("object", "data", TAG_RELATED),
]

# A url() or @import reference in CSS.  Fixed value; (?d) keeps "." from
# stopping at line ends other than \n.
CSS_LINK = r"""(?d)(?:@import|:).*url\(["']?([^'"\)]+)["']?\)"""

_ATTRS = r"""(?:[^>"']++|"[^"]*+"|'[^']*+')*+"""
_END = r"(?=[\s/>])"
# elements whose content is text, not markup; the first two and iframe carry links
_RAW_TEXT = ["style", "script", "iframe", "textarea", "title", "noscript", "xmp", "noembed", "noframes"]
_KEPT_RAW = ["style", "script", "iframe"]


def _element(name: str) -> str:
    """A raw-text element up to its end tag, or to the end of the text."""
    return rf"<{name}{_END}{_ATTRS}>(?:(?!</{name}[\s/>])[\s\S])*+"


def _token_pattern() -> str:
    kept = "|".join([_element(n) for n in _KEPT_RAW] + [rf"<(?:a|link|img|source|object){_END}{_ATTRS}>"])
    skipped = "|".join(_element(n) for n in _RAW_TEXT if n not in _KEPT_RAW)
    return rf"(?i)<!--(?:-?>|[\s\S]*?(?:--!?>|\z))|<[!?][^>]*+>?|({kept})|{skipped}|</?[a-z]{_ATTRS}>"


TOKEN = _token_pattern()


def _attribute_pattern(elements: str, attribute: str) -> str:
    """Group 1: the first ``attribute`` of the tag, with its value if it has one."""
    value = r"""(?:\s*+=\s*+(?:"[^"]*+"|'[^']*+'|[^\s>"'][^\s>]*+|(?=>)))"""
    other = rf"(?!{attribute}(?:[\s=/>]))[^\s/>=][^\s/>=]*+{value}?+"
    return rf"(?i)^<(?:{elements})(?:[\s/]++(?:{other})?+)*+(?<=[\s/])({attribute}(?=[\s=/>]){value}?+)"


def _names(attribute: str) -> str:
    return "|".join(element for element, attr, _ in LINK_RULES if attr == attribute)


def _value(found: Column) -> Column:
    """The value in ``name = value``, without its quotes."""
    text = F.regexp_replace(found, r"^[^=]*+=\s*+", "")
    unquoted = F.when(
        text.startswith('"') | text.startswith("'"), F.substring(text, F.lit(2), F.length(text) - 2)
    ).otherwise(text)
    return F.when(found.contains("="), unquoted).otherwise(F.lit(""))


# --------------------------------------------------------------------------
# Character references
# --------------------------------------------------------------------------

# Code points 0x80-0x9f mean Windows-1252 in HTML; the map follows from the codec.
_C1 = {cp: bytes([cp]).decode("cp1252", errors="ignore") or chr(cp) for cp in range(0x80, 0xA0)}


def _map(pairs: dict) -> Column:
    """A map literal; folded to a constant when the query is planned."""
    return F.from_json(F.lit(json.dumps(pairs)), "map<string,string>")


def _code_point(n: Column) -> Column:
    """The character of a numeric reference (HTML's replacement rules)."""
    return (
        F.when(n.isNull() | (n == 0) | (n > 0x10FFFF) | n.between(0xD800, 0xDFFF), F.lit("�"))
        .when(n.between(0x80, 0x9F), F.element_at(_map(_C1), n.cast("string")))
        .otherwise(F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32"))
    )


def _reference(p: Column) -> Column:
    """Text after an ampersand, with the reference it starts with decoded."""
    name = F.regexp_extract(p, "^[A-Za-z0-9]+;?", 0)
    decimal = F.regexp_extract(p, "^#([0-9]+)", 1)
    hexa = F.regexp_extract(p, "^#[xX]([0-9A-Fa-f]+)", 1)
    rest = F.regexp_replace(p, "^(?:#[0-9]+|#[xX][0-9A-Fa-f]+|[A-Za-z0-9]+);?", "")
    known = F.element_at(_map(html5), name)
    # without its semicolon a name before "=" is query text, not a reference
    blocked = p.rlike("^[A-Za-z0-9]+=")

    def number(digits: Column, base: int) -> Column:
        value = F.regexp_replace(digits, "^0+(?=.)", "")
        return F.when(F.length(value) < 10, F.conv(value, base, 10).cast("long"))

    return (
        F.when(decimal != "", F.concat(_code_point(number(decimal, 10)), rest))
        .when(hexa != "", F.concat(_code_point(number(hexa, 16)), rest))
        .when(name == "amp;", F.concat(F.lit("&"), rest))
        .when((name == "") | blocked | known.isNull(), F.concat(F.lit("&"), p))
        .otherwise(F.concat(known, rest))
    )


def decode_references(c: Column) -> Column:
    """Decode HTML character references the way an attribute value is decoded."""
    pieces = F.split(c, "&")
    tail = F.slice(pieces, F.lit(2), F.greatest(F.size(pieces) - 1, F.lit(0)))
    full = F.concat(F.get(pieces, F.lit(0)), F.array_join(F.transform(tail, _reference), ""))
    return (
        F.when(~c.contains("&"), c)
        .when(~c.rlike("&(?!amp;)"), F.replace(c, F.lit("&amp;"), F.lit("&")))
        .otherwise(full)
    )


# --------------------------------------------------------------------------
# Extraction
# --------------------------------------------------------------------------


def _tokens(html: Column) -> Column:
    return F.filter(F.regexp_extract_all(html, F.lit(TOKEN), F.lit(1)), lambda t: t != "")


def _is_style(token: Column) -> Column:
    return token.rlike(r"(?i)^<style[\s/>]")


def _style_text(token: Column) -> Column:
    return F.regexp_replace(token, rf"(?i)^<style{_ATTRS}>", "")


def _attribute(token: Column) -> Column:
    """``struct<text,tag>``: the link attribute of a tag ('' if it has none)."""
    text = (
        F.when(
            token.rlike(r"(?i)^<(?:a|link)[\s/>]"),
            F.regexp_extract(token, _attribute_pattern(_names("href"), "href"), 1),
        )
        .when(
            token.rlike(r"(?i)^<object[\s/>]"),
            F.regexp_extract(token, _attribute_pattern(_names("data"), "data"), 1),
        )
        .otherwise(F.regexp_extract(token, _attribute_pattern(_names("src"), "src"), 1))
    )
    kind = F.when(token.rlike(r"(?i)^<a[\s/>]"), F.lit(TAG_PRIMARY)).otherwise(F.lit(TAG_RELATED))
    return F.struct(text.alias("text"), kind.alias("tag"))


def _related(urls: Column) -> Column:
    return F.transform(urls, lambda u: F.struct(u.alias("raw"), F.lit(TAG_RELATED).alias("tag")))


def _up_to_last_url(css: Column) -> Column:
    """The text up to the end of its last ``url()``.

    Nothing after that can match, and the greedy pattern would look through it
    once per colon.
    """
    last = F.substring_index(css, "url(", -1)
    head = F.substring(css, F.lit(1), F.length(css) - F.length(last))
    return F.concat(head, F.substring_index(last, ")", 1), F.when(last.contains(")"), ")").otherwise(""))


def _css_urls(css: Column) -> Column:
    return F.when(
        css.contains("url("), F.regexp_extract_all(_up_to_last_url(css), F.lit(CSS_LINK), F.lit(1))
    ).otherwise(F.array().cast("array<string>"))


def css_links(css: Column) -> Column:
    """Links of a stylesheet: the last ``url()`` of each declaration line."""
    return _related(_css_urls(css))


def _links_of_tags(tokens: Column) -> Column:
    found = F.filter(
        F.transform(F.filter(tokens, lambda t: ~_is_style(t)), _attribute), lambda f: f["text"] != ""
    )
    values = F.transform(found, lambda f: F.struct(_value(f["text"]).alias("raw"), f["tag"].alias("tag")))
    return F.transform(
        values, lambda v: F.struct(decode_references(v["raw"]).alias("raw"), v["tag"].alias("tag"))
    )


def _links_of_styles(tokens: Column) -> Column:
    sheets = F.filter(tokens, lambda t: _is_style(t) & t.contains("url("))
    return F.flatten(F.transform(sheets, lambda t: css_links(_style_text(t))))


def html_links(html: Column) -> Column:
    """Links held by tag attributes, in page order, as ``array<struct<raw,tag>>``."""
    return _links_of_tags(_tokens(html))


def style_block_links(html: Column) -> Column:
    """Links in the text of ``<style>`` elements."""
    return _links_of_styles(_tokens(html))


def link_tokens(body: Column, content_type: Column) -> Column:
    """The link-bearing pieces of a response body, by (case-sensitive) content type.

    A stylesheet is one piece, marked the way a ``<style>`` element is.
    """
    return (
        F.when(content_type.startswith("text/html"), _tokens(body))
        .when(content_type.startswith("text/css"), F.array(F.concat(F.lit("<style>"), body)))
        .otherwise(F.array().cast("array<string>"))
    )


def token_links(tokens: Column) -> Column:
    """``array<struct<raw,tag>>`` of the pieces found by :func:`link_tokens`."""
    return F.concat(_links_of_tags(tokens), _links_of_styles(tokens))


def raw_links(body: Column, content_type: Column) -> Column:
    """Unresolved links of a response body (tags first, then styles)."""
    return token_links(link_tokens(body, content_type))
