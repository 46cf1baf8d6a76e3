"""Recipes that break one rule each, and rows that are in exactly one of both tables."""

import copy
import json

from kassabon.plans import recipe_checks

RECIPE = {
    "title": "Soep",
    "description": None,
    "servings": 4.0,
    "prepTimeMinutes": 0,
    "ingredients": [{"rawText": "2 uien", "ingredientName": "ui", "quantity": 2, "optional": False}, {"rawText": "zout", "ingredientName": "zout", "quantity": None, "quantitySource": "missing"}],
    "instructions": [{"text": "Kook."}, {"text": "Eet.", "source": "ai_suggestion"}],
    "tags": ["  snel ", "x" * 32],
    "sourceUrl": "https://example.org/1",
    "sourcePlatform": "blog",
    "confidenceScore": 1,
    "completeness": {"status": "incomplete", "missingFields": ["servings"]},
}
ABSENT = object()


def changed(*path_and_value):
    *path, value = path_and_value
    doc = copy.deepcopy(RECIPE)
    at = doc
    for p in path[:-1]:
        at = at[p]
    if value is ABSENT:
        del at[path[-1]]
    else:
        at[path[-1]] = value
    return json.dumps(doc)


CASES = [
    (json.dumps(RECIPE), []),
    (changed("tags", ABSENT), []),
    (changed("servings", None), []),
    (changed("completeness", "missingFields", ABSENT), []),
    (changed("tags", [" " + "y" * 32 + " "]), []),
    (changed("tags", ["\U0001f600" * 16]), []),
    (changed("imageUrl", "data:image/png;base64,AA"), []),
    (changed("title", ""), ["title"]),
    (changed("title", None), ["title"]),
    (changed("title", 3), ["title"]),
    (changed("servings", 0), ["servings"]),
    (changed("servings", 2.5), ["servings"]),
    (changed("servings", "4"), ["servings"]),
    (changed("cookTimeMinutes", -1), ["cookTimeMinutes"]),
    (changed("tags", None), ["tags"]),
    (changed("tags", ["a"] * 9), ["tags"]),
    (changed("tags", ["  "]), ["tags"]),
    (changed("tags", ["\U0001f600" * 17]), ["tags"]),
    (changed("imageUrl", "example.org/x.png"), ["imageUrl"]),
    (changed("sourceUrl", "https://"), ["sourceUrl"]),
    (changed("sourcePlatform", "radio"), ["sourcePlatform"]),
    (changed("confidenceScore", 1.01), ["confidenceScore"]),
    (changed("confidenceScore", "1"), ["confidenceScore"]),
    (changed("confidenceScore", ABSENT), ["confidenceScore"]),
    (changed("completeness", ABSENT), ["completeness.status"]),
    (changed("completeness", "missingFields", ["salt"]), ["completeness.missingFields"]),
    (changed("ingredients", []), ["ingredients"]),
    (changed("ingredients", ["ui"]), ["ingredients"]),
    (changed("ingredients", {}), ["ingredients"]),
    (changed("ingredients", 1, "ingredientName", ""), ["ingredients.ingredientName"]),
    (changed("ingredients", 0, "quantity", "2"), ["ingredients.quantity"]),
    (changed("ingredients", 0, "optional", None), ["ingredients.optional"]),
    (changed("ingredients", 1, "quantitySource", "guess"), ["ingredients.quantitySource"]),
    (changed("instructions", ABSENT), ["instructions"]),
    (changed("instructions", 0, "source", "x"), ["instructions.source"]),
    ("[1]", ["not_an_object"]),
    ("null", ["not_an_object"]),
    ("{broken", ["not_json"]),
    (json.dumps(RECIPE) + " \n", []),
    (json.dumps(RECIPE) + " x", ["not_json"]),
    (json.dumps(RECIPE) + "]", ["not_json"]),
    (json.dumps(RECIPE) + "}", ["not_json"]),
    (json.dumps(RECIPE) + "," + json.dumps(RECIPE), ["not_json"]),
    ('{"title":"a","title":"b"}', ["not_json"]),
    ("", ["not_json"]),
    (None, ["not_json"]),
]


def test_each_rule(spark):
    rows = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(CASES)], "id int, said string")
    good, bad = recipe_checks.judged_recipes(rows, "said")
    got = {r.id: [] for r in good.select("id").collect()}
    rejected = bad.collect()
    assert not got.keys() & {r.id for r in rejected}
    assert all(r.said == CASES[r.id][0] for r in rejected)  # as it came
    got |= {r.id: r.reasons for r in rejected}
    assert got == {i: reasons for i, (_, reasons) in enumerate(CASES)}


def test_defaults(spark):
    rows = spark.createDataFrame([(1, json.dumps(RECIPE)), (2, changed("tags", ABSENT))], "id int, said string")
    one, two = recipe_checks.with_defaults(recipe_checks.judged_recipes(rows, "said")[0]).orderBy("id").collect()
    assert [(i.ingredientName, i.quantity, i.optional, i.ingredientSource, i.quantitySource) for i in one.ingredients] == [("ui", 2.0, False, "source", "source"), ("zout", None, False, "source", "missing")]
    assert [tuple(s) for s in one.instructions] == [("Kook.", "source"), ("Eet.", "ai_suggestion")]
    assert one.tags == ["snel", "x" * 32] and two.tags == [] and one.missing_fields == ["servings"]


def test_empty_table(spark):
    good, bad = recipe_checks.judged_recipes(spark.createDataFrame([], "id int, said string"), "said")
    assert good.count() == bad.count() == 0
