"""Addresses, pages and JSON texts."""

from __future__ import annotations

import html
import json
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kassabon.workers import sent_whole

from .text import any_of, clean_text, none_if_empty, once, without_repeated_lines

sent_whole(__name__)


def _bare(x: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(x, r"(?is)<(script|style)[^>]*>.*?</(script|style)>", " "), r"(?s)<[^>]+>", " ")


def strip_html(x: Column) -> Column:
    """Text of a page: scripts and styles go, other tags become blanks, blanks become one."""
    return F.trim(F.regexp_replace(decode_entities(_bare(x)), r"\s+", " "))


def page_text(x: Column) -> Column:
    """As ``strip_html`` with every entity read; null if nothing is left."""
    return none_if_empty(F.trim(F.regexp_replace(unescape(_bare(x)), r"(?U)\s+", " ")))


def decode_entities(x: Column) -> Column:
    """The six named entities, the ampersand first, then code points."""
    for name, sign in (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " ")):
        x = F.replace(x, F.lit(name), F.lit(sign))
    return once(_code_points, F.split(x, "&#"))


def _code_points(parts: Column) -> Column:
    """Parts of a text between the marks of code points as one text; what is no code point keeps its mark."""

    def read(part: Column) -> Column:
        digits = F.regexp_extract(part, "^(x[0-9a-fA-F]{1,6}|X[0-9a-fA-F]{1,6}|[0-9]{1,7});", 1)
        point = F.when(F.lower(digits).startswith("x"), F.conv(F.substring(digits, 2, 6), 16, 10)).otherwise(digits).try_cast("long")
        fits = point.between(1, 0x10FFFF) & ~point.between(0xD800, 0xDFFF)
        sign = F.decode(F.unhex(F.lpad(F.hex(point), 8, "0")), "UTF-32")
        return F.when(fits, F.concat(sign, F.substr(part, F.char_length(digits) + 2))).otherwise(F.concat(F.lit("&#"), part))

    return F.concat(F.get(parts, 0), F.array_join(F.transform(F.slice(parts, 2, F.greatest(F.size(parts), F.lit(1))), read), ""))


@F.pandas_udf(T.StringType())
def unescape(x: pd.Series) -> pd.Series:
    """All named and numeric entities, which Spark has no function for."""
    return x.map(html.unescape, na_action="ignore")


@F.pandas_udf(T.StringType())
def without_marks(x: pd.Series) -> pd.Series:
    """Compatibility decomposition without combining marks, which Spark has no function for."""
    return x.map(lambda t: "".join(c for c in unicodedata.normalize("NFKD", t) if not unicodedata.combining(c)), na_action="ignore")


def page_title(x: Column) -> Column:
    """og:title or twitter:title in either order of attributes, else the title element."""
    found = [none_if_empty(meta(x, name)) for name in ("og:title", "twitter:title")]
    title = none_if_empty(F.trim(F.regexp_replace(F.regexp_extract(x, r"(?is)<title[^>]*>(.*?)</title>", 1), r"\s+", " ")))
    return decode_entities(F.coalesce(*found, title))


def meta(x: Column, name: str) -> Column:
    one = rf"""(?is)<meta[^>]+(?:property|name)=["']{name}["'][^>]+content=["']([^"']*)["']"""
    two = rf"""(?is)<meta[^>]+content=["']([^"']*)["'][^>]+(?:property|name)=["']{name}["']"""
    return F.coalesce(none_if_empty(F.regexp_extract(x, one, 1)), none_if_empty(F.regexp_extract(x, two, 1)))


def links(x: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(x, F.lit(r'href="([^"]*)"'), F.lit(1)))


def sitemap_locations(x: Column) -> Column:
    found = F.regexp_extract_all(x, F.lit(r"(?is)<loc>\s*(.*?)\s*</loc>"), F.lit(1))
    return F.array_distinct(F.transform(found, lambda u: F.regexp_replace(decode_entities(u), r"[\x00-\x1f\x7f]+", "")))


def json_ld(x: Column) -> Column:
    """JSON texts of a page's ld+json blocks."""
    return F.regexp_extract_all(x, F.lit(r"""(?is)<script[^>]+type=["']application/ld\+json["'][^>]*>(.*?)</script>"""), F.lit(1))


@F.pandas_udf(T.ArrayType(T.StringType()))
def typed_objects(x: pd.Series, kind: pd.Series) -> pd.Series:
    """JSON texts of the objects of a type in a JSON text, looking into lists and @graph."""

    def find(node, kind):
        if isinstance(node, list):
            for child in node:
                yield from find(child, kind)
        elif isinstance(node, dict):
            own = node.get("@type")
            if kind in (own if isinstance(own, list) else [own]):
                yield json.dumps(node, ensure_ascii=False, sort_keys=True)
            yield from find(node.get("@graph") or [], kind)

    def one(text, kind):
        try:
            return list(find(json.loads(text), kind))
        except (TypeError, ValueError, RecursionError):
            return []

    return pd.Series([one(t, k) for t, k in zip(x, kind, strict=True)], dtype=object)


@F.pandas_udf(T.StringType())
def first_value(x: pd.Series, key: pd.Series) -> pd.Series:
    """The first scalar under a key anywhere in a JSON text, depth first."""

    def find(node, key):
        if isinstance(node, dict):
            if key in node and not isinstance(node[key], dict | list) and node[key] is not None:
                return str(node[key])
            node = list(node.values())
        if isinstance(node, list):
            return next((v for v in (find(child, key) for child in node) if v is not None), None)
        return None

    def one(text, key):
        try:
            return find(json.loads(text), key)
        except (TypeError, ValueError, RecursionError):
            return None

    return pd.Series([one(t, k) for t, k in zip(x, key, strict=True)], dtype=object)


@F.pandas_udf(T.ArrayType(T.StringType()))
def instruction_steps(x: pd.Series) -> pd.Series:
    """Texts of recipe instructions: a text, a list, or sections of steps."""

    def flat(node):
        if isinstance(node, str):
            yield from (line.strip() for line in node.splitlines() if line.strip())
        elif isinstance(node, list):
            for child in node:
                yield from flat(child)
        elif isinstance(node, dict):
            yield from flat(node.get("itemListElement") or node.get("text") or node.get("name") or [])

    def one(text):
        try:
            return list(flat(json.loads(text)))
        except (TypeError, ValueError, RecursionError):
            return []

    return pd.Series([one(t) for t in x], dtype=object)


def host_of(url: Column) -> Column:
    """The host in lower case, without a user before it or a port after it; an IPv6 address keeps its brackets."""
    return F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#]*@)?(\[[^\]/?#]*\]|[^/?#:@]*)", 1))


# Parts of the hosts of platforms; the first that fits counts.
PLATFORMS = (
    ("instagram", ("instagram.com",)),
    ("tiktok", ("tiktok.com",)),
    ("facebook", ("facebook.com", "fb.watch")),
    ("pinterest", ("pinterest.", "pin.it")),
    ("youtube", ("youtube.com", "youtu.be")),
)


def platform(url: Column) -> Column:
    host = host_of(url)
    out = F.lit("blog")
    for name, parts in reversed(PLATFORMS):
        out = F.when(any_of(*[host.contains(x) for x in parts]), name).otherwise(out)
    return out


# Hosts that aren't public.
PRIVATE = r"^$|^localhost$|\.local$|^127\.|^10\.|^192\.168\.|^172\.(1[6-9]|2[0-9]|3[01])\.|^\[?::1\]?$"


def safe_url(url: Column) -> Column:
    """The address if it is http(s) and its host isn't private, else null."""
    return F.when(F.lower(url).rlike("^https?://") & ~host_of(url).rlike(PRIVATE), url)


def subtitle_text(x: Column) -> Column:
    """Spoken lines of a caption file: no headers, counters, time lines or lines said twice in a row."""
    bare = F.transform(F.split(x, r"\r?\n"), lambda w: F.trim(strip_html(w)))
    # What a line that isn't spoken looks like.
    unsaid = r"(?i)^(WEBVTT|NOTE|STYLE|REGION)\b|^[0-9]+$|^[0-9]{1,2}:[0-9]{2}(:[0-9]{2})?[.,][0-9]{3}\s+-->"
    spoken = F.filter(bare, lambda w: (w != "") & ~w.rlike(unsaid))
    return F.trim(F.regexp_replace(F.array_join(without_repeated_lines(spoken), " "), r"\s+", " "))


def id_suffix(url: Column) -> Column:
    """The number that ends a path after a slash or hyphen."""
    path = F.regexp_extract(url, r"^[^?#]*", 0)
    return none_if_empty(F.regexp_extract(path, r"[-/]([0-9]+)(?:\.html)?/?$", 1))


def file_url(path: Column, base: str) -> Column:
    """An absolute address from a file path; backslashes turn, leading slashes go."""
    return F.when(path.startswith("http"), path).otherwise(F.concat(F.lit(base), F.regexp_replace(F.replace(path, F.lit("\\"), F.lit("/")), "^/+", "")))


def json_list_text(x: Column) -> Column:
    """Items of a JSON list, or values of a JSON object, joined by arrows; other texts stay."""
    said = lambda items: F.array_join(F.filter(items, lambda i: clean_text(i).isNotNull()), " > ")
    inside = F.coalesce(said(F.from_json(x, "array<string>")), said(F.map_values(F.from_json(x, "map<string,string>"))))
    holds = x.rlike(r"^[\[{]") & F.try_parse_json(x).isNotNull()
    return F.when(holds, none_if_empty(inside)).otherwise(none_if_empty(x))
