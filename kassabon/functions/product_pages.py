"""What a product page of SPAR says, as rows: a table function that reads each page once.

Its sections hold articles (a heading and a text) and a table of nutrients, whose amounts count for the
basis of the row before them; pictures, prices and the JSON-LD product stand elsewhere on the page.
"""

from __future__ import annotations

import html as entities
import itertools
import json
import re
import unicodedata
from collections.abc import Iterator
from typing import Any
from urllib.parse import urljoin

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kassabon.workers import sent_whole

sent_whole(__name__)

#: kind: raw (all of it as JSON), field, section, article, nutrient, basis, image or breadcrumb; place from 0 within a kind (articles: within a section).
PARTS = "kind string, section string, place int, name string, value string, basis string"

# How the store's pages are marked.
BASE = "https://www.spar.nl"
PICTURES = ("media.spar.nl/", "/content/img/product-not-available")
I, IS = re.IGNORECASE, re.IGNORECASE | re.DOTALL
CLASSED = r"""<{tag}[^>]*class=["'][^"']*{name}[^"']*["'][^>]*>"""
SECTION = re.compile(CLASSED.format(tag="details", name=r"collapsible[^\"']*content") + r"(.*?)</details>", IS)
SECTION_BODY = re.compile(CLASSED.format(tag="section", name="product-information-block") + r"(.*?)</section>", IS)
HEADING = re.compile(r"<h2[^>]*>(.*?)</h2>", IS)
ARTICLE = re.compile(r"<article[^>]*>(.*?)</article>", IS)
STRONG = re.compile(r"<strong[^>]*>(.*?)</strong>", IS)
NUTRIENT = re.compile(r"<p[^>]*>\s*<span[^>]*>(.*?)</span>\s*<span[^>]*>(.*?)</span>\s*</p>", IS)
NUTRIENT_TABLE = "product-information-table"
NUTRIENTS, KIND_OF_TABLE = "voedingswaarden", "soort"
TITLE = re.compile(CLASSED.format(tag="h1", name="c-offer__title") + r"(.*?)</h1>", IS)
SUBTITLE = re.compile(CLASSED.format(tag="h2", name="c-offer__subtitle") + r"(.*?)</h2>", IS)
PRICE = re.compile(CLASSED.format(tag="div", name="c-offer__price") + ".*?" + CLASSED.format(tag="span", name="c-price__euro") + r"(.*?)</span>.*?" + CLASSED.format(tag="span", name="c-price__cent") + r"(.*?)</span>", IS)
CANONICAL = re.compile(r"""<link[^>]+rel=["']canonical["'][^>]+href=["']([^"']+)["']""", I)
PICTURE = re.compile(r"""\b(?:data-src|src)=["']([^"']+)["']""", I)
DATA_PRICE = re.compile(r'"price"\s*:\s*"?(\d+(?:[.,]\d+)?)"?', I)
DATA_ID = re.compile(r'"twid"\s*:\s*"?(\d+)"?', I)
JSON_LD = re.compile(r"""<script[^>]+type=["']application/ld\+json["'][^>]*>(.*?)</script>""", IS)
NUTRI_SCORE = [re.compile(p, I) for p in (r"nutri[-_\s]?score[^a-e0-9]{0,25}([a-e])\b", r"nutriscore[^a-e0-9]{0,25}([a-e])\b", r"nutri[-_\s]?score[-_\s]?([a-e])(?:\.|_|-|/)")]
UNSEEN = re.compile(r"<(script|style)\b.*?</\1>|<br\s*/?>|<[^>]+>", IS)
GTINS = ("gtin13", "gtin", "gtin14", "gtin8")


def said(value: Any) -> str | None:
    """Text of a value or of markup; the texts of a list joined by bars; null if nothing is left."""
    if isinstance(value, list):
        return " | ".join(t for t in map(said, value) if t) or None
    if value is None or value == {}:
        return None
    return " ".join(entities.unescape(UNSEEN.sub(" ", str(value))).split()) or None


def key_of(title: str | None) -> str:
    plain = "".join(c for c in unicodedata.normalize("NFKD", title or "") if not unicodedata.combining(c))
    return re.sub("[^a-z0-9]+", "_", plain.lower()).strip("_")


def address(value: Any) -> str | None:
    text = said(value)
    return urljoin(BASE, text) if text else None


def number_of(url: str) -> str | None:
    found = re.search(r"-(\d+)/?(?:[?#].*)?$", url)
    return found[1] if found else None


def first(pattern: re.Pattern[str], page: str) -> str | None:
    found = pattern.search(page)
    return said(found[1]) if found else None


def shown_price(page: str) -> str | None:
    found = PRICE.search(page)
    euro, cent = (re.sub(r"\D", "", said(part) or "") for part in found.groups()) if found else ("", "")
    return f"{euro}.{(cent or '00').zfill(2)[:2]}" if euro else None


def typed(node: Any) -> Iterator[tuple[set[str], dict[str, Any]]]:
    """Every object within a JSON value with the names of its types."""
    if isinstance(node, dict):
        own = node.get("@type")
        yield {str(t).lower() for t in (own if isinstance(own, list) else [own])}, node
    for child in node.values() if isinstance(node, dict) else node if isinstance(node, list) else ():
        yield from typed(child)


def linked_data(page: str) -> tuple[dict[str, Any], dict[str, Any]]:
    """The first product and the first list of breadcrumbs of the page's JSON-LD."""
    product: dict[str, Any] | None = None
    crumbs: dict[str, Any] | None = None
    for block in JSON_LD.findall(page):
        data = None
        for text in (block.strip(), entities.unescape(block.strip())):
            try:
                data = json.loads(text)
                break
            except (ValueError, RecursionError):
                continue
        for types, node in typed(data):
            if product is None and "product" in types:
                product = node
            elif crumbs is None and "breadcrumblist" in types:
                crumbs = node
        if product is not None and crumbs is not None:
            break
    return product or {}, crumbs or {}


def breadcrumbs(crumbs: dict[str, Any]) -> list[dict[str, Any]]:
    out = []
    for item in crumbs.get("itemListElement") or []:
        if isinstance(item, dict):
            inner = item.get("item")
            holder, link = (inner, inner.get("@id")) if isinstance(inner, dict) else (item, inner)
            name, url = said(holder.get("name")), address(link)
            if name or url:
                out.append({"position": item.get("position"), "name": name, "url": url})
    return out


def articles(body: str) -> dict[str, str]:
    out = {}
    for article in ARTICLE.findall(body):
        head = STRONG.search(article)
        if head:
            name, value = key_of(said(head[1])), said(article[: head.start()] + article[head.end() :])
            if name and value:
                out[name] = value
    return out


def sections(page: str) -> dict[str, dict[str, Any]]:
    """Sections by key; of two of a key the later one counts. ``html`` is the section's body."""
    out = {}
    for part in SECTION.findall(page):
        head = HEADING.search(part)
        title = said(head[1]) if head else None
        inner = SECTION_BODY.search(part)
        body = inner[1] if inner else part
        if key_of(title):
            out[key_of(title)] = {"title": title, "text": said(body), "articles": articles(body), "html": body}
    return out


def nutrients(section: dict[str, Any] | None) -> tuple[list[dict[str, str | None]], str | None]:
    """Rows of name, value and the basis that holds there; and the last basis, else what stands before the table."""
    if not section:
        return [], None
    rows, basis = [], None
    for name, value in ((said(a), said(b)) for a, b in NUTRIENT.findall(section["html"])):
        if name and value and key_of(name) == KIND_OF_TABLE:
            basis = value
        elif name and value:
            rows.append({"name": name, "value": value, "basis": basis})
    return rows, basis or said(section["html"].split(NUTRIENT_TABLE, 1)[0])


def pictures(page: str, given: Any) -> list[str]:
    def flat(value: Any) -> Iterator[Any]:
        if isinstance(value, list):
            for item in value:
                yield from flat(item)
        else:
            yield value

    urls = [address(v) for v in [*flat(given), *PICTURE.findall(page)]]
    return list(dict.fromkeys(u for u in urls if u and any(p in u for p in PICTURES)))


def nutri_score(page: str) -> str | None:
    text = entities.unescape(page)
    return next((found[1].upper() for p in NUTRI_SCORE if (found := p.search(text))), None)


def page_record(page: str, url: str) -> dict[str, Any]:
    """All that a page says, as it is landed."""
    product, crumbs = linked_data(page)
    offers = product.get("offers")
    offer = next((o for o in (offers if isinstance(offers, list) else [offers]) if isinstance(o, dict)), {})
    parts = sections(page)
    rows, basis = nutrients(parts.get(NUTRIENTS))
    inside = lambda section: parts.get(section, {}).get("articles") or {}
    link, price = CANONICAL.search(page), DATA_PRICE.search(page)
    twid = DATA_ID.search(page)
    return {
        "url": url, "canonical_url": address(link[1]) if link else url, "source": "spar_product_page_jsonld_html",
        "json_ld_product": product or None, "json_ld_offer": offer or None, "breadcrumbs": breadcrumbs(crumbs),
        "product_name": said(product.get("name")) or first(TITLE, page), "brand": said(product.get("brand")),
        "package": first(SUBTITLE, page) or inside("omschrijving").get("inhoud_en_gewicht"), "category": said(product.get("category")),
        "sku": said(product.get("sku")) or number_of(url), "gtin13": next((g for name in GTINS if (g := said(product.get(name)))), None), "twid": twid[1] if twid else None,
        "price_jsonld": said(offer.get("price")), "price_visible": shown_price(page), "price_data_layer": price[1].replace(",", ".") if price else None,
        "price_currency": said(offer.get("priceCurrency")), "price_valid_until": said(offer.get("priceValidUntil")), "availability": said(offer.get("availability")),
        "images": pictures(page, product.get("image")), "ingredients": inside("ingredienten").get("ingredienten"), "allergen_info": inside("ingredienten").get("allergie_informatie"),
        "nutrients": rows, "nutrient_basis": basis, "nutriscore": nutri_score(page),
        "product_information_sections": {k: {n: s[n] for n in ("title", "text", "articles")} for k, s in parts.items() if s["text"] or s["articles"]},
    }


Part = tuple[str, str | None, int, str | None, str | None, str | None]


def page_parts(page: str | None, url: str | None) -> Iterator[Part]:
    """The rows of PARTS for a page; a null page has none."""
    if page is None:
        return
    record = page_record(page, url or "")
    yield "raw", None, 0, None, json.dumps(record, ensure_ascii=False, separators=(",", ":")), None
    fields = [(k, v) for k, v in record.items() if isinstance(v, str) and k not in ("source", "nutrient_basis")]
    yield from (("field", None, i, k, v, None) for i, (k, v) in enumerate(fields))
    for i, (key, section) in enumerate(record["product_information_sections"].items()):
        yield "section", key, i, section["title"], section["text"], None
        yield from (("article", key, j, name, value, None) for j, (name, value) in enumerate(section["articles"].items()))
    yield from (("nutrient", NUTRIENTS, i, n["name"], n["value"], n["basis"]) for i, n in enumerate(record["nutrients"]))
    if record["nutrient_basis"]:
        yield "basis", NUTRIENTS, 0, None, record["nutrient_basis"], None
    yield from (("image", None, i, None, url, None) for i, url in enumerate(record["images"]))
    yield from (("breadcrumb", None, i, b["name"], b["url"], None) for i, b in enumerate(record["breadcrumbs"]))


class PageParts:
    """``page_parts`` as a table function."""

    def eval(self, page: str | None, url: str | None) -> Iterator[Part]:
        yield from page_parts(page, url)


class PageRecord:
    """The first row of ``page_parts`` alone, the record as it is landed: the others are neither made nor sent."""

    def eval(self, page: str | None, url: str | None) -> Iterator[Part]:
        yield from itertools.islice(page_parts(page, url), 1)


def register(spark: SparkSession, name: str = "page_parts") -> None:
    """Make ``SELECT ... FROM pages p, LATERAL page_parts(p.html, p.url)`` work; batches of pages reach Python as Arrow."""
    spark.udtf.register(name, F.udtf(PageParts, returnType=PARTS, useArrow=True))


def parts(pages: DataFrame, html: str = "html", url: str = "url") -> DataFrame:
    """``pages`` joined laterally with the parts of each; of a page without parts nothing is left. The columns of PARTS may not be among those of ``pages``."""
    spark = pages.sparkSession
    register(spark)
    return spark.sql(f"SELECT p.*, t.* FROM {{pages}} p, LATERAL page_parts(p.`{html}`, p.`{url}`) t", pages=pages)


def page_envelopes(pages: DataFrame, scraped_at: Column, html: str = "html", url: str = "url") -> DataFrame:
    """(value): the envelope of each page as a JSON line, by its article number, else its own number, else the one of its address."""
    spark = pages.sparkSession
    spark.udtf.register("page_record", F.udtf(PageRecord, returnType=PARTS, useArrow=True))
    raw = spark.sql(f"SELECT t.* FROM {{pages}} p, LATERAL page_record(p.`{html}`, p.`{url}`) t", pages=pages)
    at = lambda path: F.get_json_object("value", path)
    number = F.coalesce(at("$.gtin13"), at("$.sku"))
    head = F.to_json(F.struct(F.lit("spar").alias("store"), F.date_format(scraped_at, "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").alias("scraped_at"), number.alias("external_id")), {"ignoreNullFields": "false"})
    return raw.select(F.concat(F.rtrim(head, F.lit("}")), F.lit(',"raw":'), F.col("value"), F.lit("}")).alias("value"))
