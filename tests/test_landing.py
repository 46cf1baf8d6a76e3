"""Recorded pages of five stores: the format, the walks and the envelopes against a plain merge."""

import json
import random
from pathlib import Path

import pytest
from kassabon.plans import envelopes
from kassabon.sources import landing
from pyspark.sql import functions as F

rng = random.Random(11)


def write(root, store, kind, leaf, answers, name="a"):
    path = Path(root, store, kind, leaf)
    path.mkdir(parents=True, exist_ok=True)
    lines = [json.dumps({"page": p, "body": b} | ({"key": k[0]} if k else {}), ensure_ascii=False) for p, b, *k in answers]
    Path(path, f"{name}.jsonl").write_text("\n".join(lines) + "\n\n", encoding="utf-8")


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    """A landing folder of five stores, and the cards and details that a walk finds in it."""
    top, want = str(tmp_path_factory.mktemp("landing")), {}
    # ah: 1 under 10 and 11, 3 a leaf by itself, 4 recorded but in no category
    write(top, "ah", "categories", "all", [(0, [{"id": 1, "name": "Fruit"}, {"id": 2, "name": "Kaas"}, {"id": 3, "name": "Los"}])])
    write(top, "ah", "children", "1", [(0, {"children": [{"id": 10, "name": "Appel"}, {"id": 11, "name": "Peer"}]})])
    write(top, "ah", "children", "2", [(0, {"children": [{"id": 11, "name": "Jong"}, {"id": 12, "name": "Oud"}]})])
    ah = {leaf: [[{"webshopId": rng.randint(1, 400), "title": f"{leaf} {p} é", "n": 1.5} for _ in range(4)] for p in range(40)] for leaf in ("10", "11", "12", "3", "4")}
    ah["12"][1] = [{"title": "no id"}, {"webshopId": None}]
    for leaf, pages in ah.items():
        said = {"10": 40, "11": 3, "12": None, "3": 2, "4": 2}[leaf]
        answers = [(p, {"products": cards} | ({"page": {"totalPages": said}} if said else {})) for p, cards in enumerate(pages) if (leaf, p) not in {("11", 1), ("3", 0)}]
        write(top, "ah", "listing", leaf, answers[:20])
        write(top, "ah", "listing", leaf, answers[20:], "b")
    found = {}
    for leaf, pages in (("10", range(30)), ("11", (0, 2)), ("12", (0,))):
        for p in pages:
            for card in ah[leaf][p]:
                if card.get("webshopId"):
                    found.setdefault(str(card["webshopId"]), card)
    told = {i: {"productCard": {"title": f"detail {i}"}} for i in range(1, 400, 2)}
    write(top, "ah", "detail", "odd", [(i, d, i) for i, d in told.items()] + [(500, None, 2), (501, {"newer": 1}, 3)])
    told[3] = {"newer": 1}
    want["ah"] = {i: {"card": c, "detail": told.get(int(i))} for i, c in found.items()}
    # jumbo: 100 products said, of which 96 and more were recorded
    jumbo = [{"id": f"{i % 90}STK", "n": i} for i in range(144)]
    write(top, "jumbo", "listing", "all", [(p, {"data": {"searchProducts": {"count": 100, "products": jumbo[p : p + 24]}}}) for p in (0, 24, 72, 96, 120)])
    write(top, "jumbo", "detail", "all", [(p, {"data": {"products": [{"sku": f"{i}STK", "p": p} for i in range(30 * p, 30 * p + 50)] + [{"none": 1}]}}) for p in range(2)])
    found = {}
    for card in [*jumbo[:48], *jumbo[72:120]]:
        found.setdefault(card["id"], card)
    want["jumbo"] = {i: {"listing": c, "detail": next(({"sku": i, "p": p} for p in (1, 0) if 30 * p <= int(i[:-3]) < 30 * p + 50), None)} for i, c in found.items()}
    # plus: b before a by order; c stops at an empty page, d isn't at the top
    menu = [{"Category_str": {"Slug": s, "Name": s.upper(), "ExternalId": e, "ParentExternalId": parent, "HasChild": True, "SortOrder": o}} for s, e, parent, o in (("a", 1, 0, 2), ("b", 2, 0, 1), ("c", 3, 0, 3), ("d", 4, 1, 0), ("e", 0, 0, 0), ("a", 9, 0, 0))]
    write(top, "plus", "menu", "all", [(0, {"data": {"CategoriesJson": json.dumps(menu)}})])
    plus = {s: [[{"SKU": str(rng.randint(1, 30)), "Slug": f"p-{s}-{p}-{i}", "Leaf": s} for i in range(3)] for p in range(5)] for s in "abcd"}
    plus["b"][0][0] = {"SKU": "", "Slug": "by-slug-777", "Leaf": "b"}
    plus["c"][2] = []
    pages_said = {"a": [2, 3, 3, 3, 3], "b": [5] * 5, "c": [5] * 5, "d": [5] * 5}
    for s, pages in plus.items():
        write(top, "plus", "listing", s, [(p + 1, {"data": {"TotalPages": pages_said[s][p], "ProductList": {"List": [{"PLP_Str": c} if p % 2 else c for c in cards]}}}) for p, cards in enumerate(pages) if (s, p) != ("b", 3)])
    found = {}
    for s, n in (("b", 3), ("a", 3), ("c", 2)):
        for cards in plus[s][:n]:
            for card in cards:
                found.setdefault(card["SKU"] or "777", card)
    slugs = [c["Slug"] for c in found.values()][::2]
    write(top, "plus", "detail", "all", [(i, {"data": {"ProductOut": {"Name": s}, "Label": 1}}, s) for i, s in enumerate(slugs)] + [(999, {"data": {"Label": 2}}, "by-slug-777")])
    want["plus"] = {i: {"plp": c} | ({"pdp": {"ProductOut": {"Name": c["Slug"]}, "Label": 1}} if c["Slug"] in slugs else {}) for i, c in found.items()}
    # dirk
    write(top, "dirk", "departments", "all", [(0, {"data": {"listDepartments": {"departments": [{"id": 1, "webGroups": [{"webGroupId": 7}, {"webGroupId": 5}]}, {"id": 2, "webGroups": None}, {"id": 3, "webGroups": [{"webGroupId": 6}]}]}}})])
    dirk = {g: [{"productId": rng.randint(1, 25), "normalPrice": 1.25} for _ in range(10)] for g in (5, 6, 7)}
    for g, cards in dirk.items():
        write(top, "dirk", "listing", str(g), [(0, {"data": {"listWebGroupProducts": {"productAssortment": [None, *cards, {"productId": None}]}}})])
    found = {}
    for g in (7, 5, 6):
        for card in dirk[g]:
            found.setdefault(str(card["productId"]), card | {"_webGroupId": g})
    one = {"headerText": "x", "images": [None, {"image": "artikelen\\a b.png", "mainImage": True}, {"image": None}]}
    shown = {"headerText": "x", "images": [{"image": "artikelen\\a b.png", "mainImage": True, "image_url": "https://web-fileserver.dirk.nl/artikelen/a%20b.png?width=500"}, {"image": None, "image_url": None}]}
    write(top, "dirk", "detail", "all", [(i, {"data": {"product": one if i % 2 else {"headerText": "y"}}}, i) for i in range(1, 20)])
    want["dirk"] = {i: {"list": c, "detail": None if int(i) >= 20 else shown if int(i) % 2 else {"headerText": "y"}} for i, c in found.items()}
    # aldi: detail pages hold JSON in a JSON text
    hits = [{"objectID": str(i % 40), "productSlug": f"s{i % 40}" if i % 3 else "", "n": i} for i in range(60)]
    write(top, "aldi", "listing", "all", [(p, {"nbPages": 2, "hits": hits[p * 25 : p * 25 + 25]}) for p in range(3)])
    page = lambda calls: f'<html><script id="__NEXT_DATA__" type="application/json">{json.dumps({"props": {"pageProps": {"apiData": json.dumps(calls)}}})}</script></html>'
    write(top, "aldi", "detail", "all", [(i, page([["OTHER", {"res": {}}], ["PRODUCT_DETAIL_GET", {"res": {"products": [{"ean": str(i)}] if i % 2 else []}}]]), f"s{i}") for i in range(40)])
    found = {}
    for hit in hits[:50]:
        found.setdefault(hit["objectID"], hit)
    want["aldi"] = {i: c | ({"detail": {"ean": i}} if c["productSlug"] and int(i) % 2 else {}) for i, c in found.items()}
    return top, want


def read(spark, root, store):
    lines = envelopes.gathered(envelopes.recorded(spark, root, store), store, F.timestamp_seconds(F.lit(0))).collect()
    return [json.loads(r["value"]) for r in lines]


@pytest.mark.parametrize("store", ["ah", "jumbo", "plus", "dirk", "aldi"])
def test_envelopes(spark, root, store):
    got = read(spark, root[0], store)
    assert {(g["store"], g["scraped_at"]) for g in got} == {(store, "1970-01-01T00:00:00.000000Z")}
    assert len({g["external_id"] for g in got}) == len(got)
    assert {g["external_id"]: g["raw"] for g in got} == root[1][store]


def test_files_are_chosen_and_read_apart(spark, root):
    pages = landing.read_recorded(spark, root[0])
    assert pages.rdd.getNumPartitions() == len(list(Path(root[0]).rglob("*.jsonl")))
    listing = landing.read_recorded(spark, root[0], store="ah", kind="listing", leaves=["10", "12"])
    assert listing.rdd.getNumPartitions() == 4
    assert {r["page"] for r in listing.filter("leaf = '10'").collect()} == set(range(30))
    few = landing.read_recorded(spark, root[0], store="ah", kind="listing", leaves=["10"], before=7)
    assert {r["page"] for r in few.collect()} == set(range(7))
    assert landing.read_recorded(spark, root[0], store="plus", kind="listing", leaves=["c"]).count() == 2
    assert landing.read_recorded(spark, root[0], store="none").count() == 0
    # Two scans of one table keep their own filters.
    both = pages.filter("kind = 'menu'").select("kind").union(pages.filter("kind = 'departments'").select("kind"))
    assert sorted(r[0] for r in both.collect()) == ["departments", "menu"]


def test_plain_tables_give_the_same(spark, root):
    rows = spark.createDataFrame(landing.read_recorded(spark, root[0]).collect(), "store string, kind string, leaf string, page long, key string, body string")
    lines = envelopes.gathered(envelopes.kinds_of(rows, "dirk"), "dirk", F.timestamp_seconds(F.lit(0))).collect()
    assert {json.loads(r["value"])["external_id"] for r in lines} == set(root[1]["dirk"])


def test_columns(spark, root):
    light = landing.read_recorded(spark, root[0], "store", "page")
    assert light.columns == ["store", "page"]
    assert light.filter("store = 'jumbo'").agg(F.max("page")).first()[0] == 120


def test_record_and_read(spark, tmp_path):
    rows = [("ah", "listing", "a/b c%", p, None if p % 2 else f'k"{p}', '{"x":"é\\n"}') for p in range(25)]
    pages = spark.createDataFrame(rows, "store string, kind string, leaf string, page long, key string, body string")
    landing.record(pages, str(tmp_path / "out"), 10)
    back = landing.read_recorded(spark, str(tmp_path / "out"))
    assert back.rdd.getNumPartitions() == 3
    assert sorted(tuple(r) for r in back.collect()) == sorted(rows, key=lambda r: r[3])


def test_limit_and_repeats(spark, root):
    listing, leaves = landing.read_recorded(spark, root[0], store="jumbo", kind="listing"), spark.createDataFrame([("all", 0)], "leaf string, place long")
    found = envelopes.cards(listing.unionByName(listing), leaves, "jumbo")
    assert found.count() == len(root[1]["jumbo"])
    few = envelopes.envelopes(found, None, "jumbo", F.timestamp_seconds(F.lit(0)), limit=5).collect()
    assert sorted(json.loads(r["value"])["raw"]["listing"]["n"] for r in few) == [0, 1, 2, 3, 4]
