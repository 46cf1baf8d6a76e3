"""Pictures, videos and captions that stores and posts list."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kassabon.workers import sent_whole

from .web import host_of, safe_url

sent_whole(__name__)

# Endings of media files.
MEDIA = r"\.(mp4|webm|mov|mkv|m4a|mp3|wav|ogg)$"
DEEPEST = 4


def url_path(url: Column) -> Column:
    return F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def is_reel(url: Column) -> Column:
    return url_path(url).rlike("(?i)^/(reel|reels)/")


def is_video_page(url: Column) -> Column:
    """Pages of reels and videos, by host, path or a parameter v."""
    asked = F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)
    return host_of(url).contains("fb.watch") | url_path(url).rlike("(?i)/(reel|reels|watch|videos)/") | asked.rlike("(^|&)v(=|&|$)")


def is_media_file(url: Column) -> Column:
    return F.lower(url_path(url)).rlike(MEDIA)


def largest_image(images: Column) -> Column:
    """Address of the image (url, width, height) with the most pixels, the first among equals; missing sizes count as 0."""
    area = lambda x: F.coalesce(x["width"], F.lit(0)).cast("long") * F.coalesce(x["height"], F.lit(0)).cast("long")
    sized = F.filter(F.transform(images, lambda x, i: F.struct(area(x).alias("area"), (-i).alias("turn"), x["url"].alias("url"))), lambda x: x["url"].isNotNull() & (x["url"] != ""))
    return F.array_max(sized)["url"]


def preferred_video(urls: Column) -> Column:
    """The first address of a media file, one that holds .mp4 before others."""
    files = F.filter(F.transform(urls, lambda u, i: F.struct(u.contains(".mp4").alias("mp4"), (-i).alias("turn"), u.alias("url"))), lambda x: is_media_file(x["url"]))
    return F.array_max(files)["url"]


def image_of_width(images: Column, width: int = 400) -> Column:
    """Address of the last image (url, width) of that width, else of the last image."""
    fits = F.filter(images, lambda x: (x["width"] == width) & (x["url"] != ""))
    return F.coalesce(F.try_element_at(fits, F.lit(-1))["url"], F.try_element_at(images, F.lit(-1))["url"])


def main_image(images: Column) -> Column:
    """The first image (image, mainImage) that is marked, else the first with an address."""
    named = F.filter(images, lambda x: x["image"] != "")
    return F.coalesce(F.get(F.filter(named, lambda x: x["mainImage"]), 0), F.get(named, 0))["image"]


def asset_image(assets: Column) -> Column:
    """Address of the first primary asset (type, url), else of the first that is no seal, else of any."""
    named = F.filter(assets, lambda x: x["url"] != "")
    first = lambda test: F.get(F.filter(named, test), 0)["url"]
    return F.coalesce(first(lambda x: x["type"] == "primary"), first(lambda x: ~F.coalesce(x["type"] == "seal", F.lit(False))), F.get(named, 0)["url"])


def transcript(direct: list[Column], segments: Column) -> Column:
    """The first text that says something, else the segments (text) joined by blanks."""
    said = F.filter(F.transform(segments, lambda x: F.trim(x["text"])), lambda t: t.isNotNull() & (t != ""))
    return F.coalesce(*[F.nullif(F.trim(c), F.lit("")) for c in direct], F.nullif(F.array_join(said, " "), F.lit("")))


@F.pandas_udf(T.ArrayType(T.StringType()))
def _texts(x: pd.Series) -> pd.Series:
    """Texts of a JSON text of any shape in reading order, at most DEEPEST lists and objects down."""

    def walk(node, depth):
        if depth > DEEPEST:
            return
        if isinstance(node, str):
            yield node
        elif isinstance(node, list | dict):
            for child in node.values() if isinstance(node, dict) else node:
                yield from walk(child, depth + 1)

    def one(text):
        try:
            return list(walk(json.loads(text), 0))
        except (TypeError, ValueError, RecursionError):
            return []

    return pd.Series([one(t) for t in x], dtype=object)


def first_safe_url(x: Column) -> Column:
    """The first public http(s) address among the texts of a JSON text of unknown shape."""
    return F.get(F.filter(F.transform(_texts(x), safe_url), lambda u: u.isNotNull()), 0)
