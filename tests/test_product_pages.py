"""The page table function: rows of planted pages, odd pages, and the lateral join."""

import json
import random

from kassabon.functions import product_pages
from pyspark.sql import functions as F

rng = random.Random(2)


def planted(i):
    """A page, and the rows that it was made of."""
    rows, html = [], ["<html><head>"]
    title, price = f"Product {i} & co", f"{i}.{i % 10}"
    product = {"@context": "x", "@graph": [{"@type": ["Thing", "Product"], "name": f"  {title} ", "sku": i, "image": ["//media.spar.nl/a.jpg", ["https://elsewhere.nl/b.jpg"]], "offers": [None, {"price": price}]}]}
    html.append(f'<script type="application/ld+json">{json.dumps(product)}</script><script type="application/ld+json">{{broken</script>')
    html.append('<script type="application/ld+json">{"@type":"breadcrumblist","itemListElement":[{"position":1,"item":{"@id":"/x","name":"Eten"}},{"position":2,"name":"Kaas","item":"/y"},7]}</script></head>')
    rows += [("image", None, 0, None, "https://media.spar.nl/a.jpg", None), ("breadcrumb", None, 0, "Eten", "https://www.spar.nl/x", None), ("breadcrumb", None, 1, "Kaas", "https://www.spar.nl/y", None)]
    if i % 2:
        html.append("<img src='https://media.spar.nl/a.jpg' data-src='https://media.spar.nl/c.jpg'>")
        rows.append(("image", None, 1, None, "https://media.spar.nl/c.jpg", None))
    names = rng.sample(["Bewaren", "Gebruik", "Contact gegevens", "Crème"], rng.randint(0, 4))
    for place, name in enumerate(names):
        key = {"Contact gegevens": "contact_gegevens", "Crème": "creme"}.get(name, name.lower())
        html.append(f"<details class='a-collapsible b content'><h2 class=t>{name}</h2><section class='product-information-block'><article>no heading</article><article><strong>Één:</strong>  tekst<br/>{i}</article><article><strong>Leeg</strong> </article></section></details>")
        rows += [("section", key, place, name, f"no heading Één: tekst {i} Leeg", None), ("article", key, 0, "een", f"tekst {i}", None)]
    if i % 3 == 0:
        html.append(f"<DETAILS class='collapsible-content'><h2>Voedingswaarden</h2><p>per stuk</p><div class='product-information-table'><p><span>Energie</span><span>{i} kJ</span></p><p><span>Soort</span><span>100 g</span></p><p><span>Vet</span><span> </span></p><p> <span>Zout</span> <span>1 g</span></p></div></DETAILS>")
        rows += [("section", "voedingswaarden", len(names), "Voedingswaarden", f"Voedingswaarden per stuk Energie {i} kJ Soort 100 g Vet Zout 1 g", None), ("nutrient", "voedingswaarden", 0, "Energie", f"{i} kJ", None), ("nutrient", "voedingswaarden", 1, "Zout", "1 g", "100 g"), ("basis", "voedingswaarden", 0, None, "100 g", None)]
    return "".join(html), rows, {"product_name": title, "sku": str(i), "price_jsonld": price}


def test_lateral_join(spark):
    pages = [planted(i) for i in range(40)]
    df = spark.createDataFrame([(i, h, None) for i, (h, _, _) in enumerate(pages)] + [(99, None, "u")], "page_id long, html string, url string").repartition(3)
    got = product_pages.parts(df).collect()
    for i, (_, rows, fields) in enumerate(pages):
        own = [tuple(r)[3:] for r in got if r["page_id"] == i]
        assert sorted(map(repr, (r for r in own if r[0] not in ("raw", "field")))) == sorted(map(repr, rows))
        assert fields.items() <= {r[3]: r[4] for r in own if r[0] == "field"}.items()
    assert not [r for r in got if r["page_id"] == 99]


def test_prices_and_links():
    record = product_pages.page_record('<link rel="canonical" href="/p-12"><div class="c-offer__price x"><b></b><span class="c-price__euro">1.</span><span class="c-price__cent">9</span></div>"price": "2,50" "twid":33 nutri-score: b!', "https://www.spar.nl/kaas-77/")
    assert {k: record[k] for k in ("canonical_url", "price_visible", "price_data_layer", "twid", "nutriscore", "sku")} == {"canonical_url": "https://www.spar.nl/p-12", "price_visible": "1.09", "price_data_layer": "2.50", "twid": "33", "nutriscore": "B", "sku": "77"}
    assert product_pages.page_record("", "u")["canonical_url"] == "u"
    assert product_pages.nutrients({"html": 'note <div class="product-information-table">'}) == ([], 'note <div class="')


def test_envelopes(spark):
    rows = [("https://www.spar.nl/a-5", '<script type="application/ld+json">{"@type":"Product","gtin":"871"}</script>'), ("https://www.spar.nl/b-6?x", "<p>no data"), ("https://www.spar.nl/c", "")]
    lines = product_pages.page_envelopes(spark.createDataFrame(rows, "url string, html string"), F.timestamp_seconds(F.lit(0))).collect()
    got = {json.loads(r["value"])["raw"]["url"]: json.loads(r["value"])["external_id"] for r in lines}
    assert got == {"https://www.spar.nl/a-5": "871", "https://www.spar.nl/b-6?x": "6", "https://www.spar.nl/c": None}
