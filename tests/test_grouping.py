"""Groups and reviews on small tables."""

from kassabon.plans import grouping, queries
from pyspark.sql import functions as F


def test_all_candidates(spark, monkeypatch):
    """No limit by None; the registered query sets none."""
    rows = [(f"{s}{i}", s, f"melk{chr(97 + i)}", None, None, None, None) for i in range(5) for s in ("ah", "plus")]
    silver = spark.createDataFrame(rows, "id string, store string, name string, ean string, price double, base_price double, base_price_unit string")
    none = silver.select(F.col("id").alias("silver_product_id")).limit(0)
    assert grouping.review_candidates(silver, none, most=None).count() == 5
    assert grouping.review_candidates(silver, none, most=3).count() == 3
    made, given = grouping.review_candidates, []
    monkeypatch.setattr(grouping, "review_candidates", lambda *a, **k: given.append(k) or made(*a, **k))
    plan = queries.tf15_review_candidates(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert given == [{"most": None}] and "Limit 2000" not in plan


GROUPS = "group_key string, canonical_name string, ean string, source string, confidence double"
MEMBERS = "group_key string, silver_product_id string, source string, confidence double"
NAMES = "group_key string, alias string, language string, confidence double"
MAPPINGS = "silver_product_id string, group_key string, confidence double, mapping_source string, review_status string"
CANDIDATES = "candidate_key string, candidate_kind string, canonical_name string, silver_ids array<string>, confidence double, status string, source string"


def test_approved_substitute(spark):
    """An ingredient with names and mappings; the exact group of its member stays."""
    make = spark.createDataFrame
    silver = make([("1", "melk"), ("2", "halfvolle melk"), ("3", None), ("4", "kaas")], "id string, name string")
    products = make([("p1", "1", "ean:1", None), ("p2", "2", None, "review:a"), ("p3", "3", None, "s"), ("p4", "4", "ean:1", None)], "id string, silver_product_id string, exact_group_key string, ingredient_key string")
    groups = make([("ean:1", "melk", "1", "ean", 1.0)], GROUPS)
    members = make([("ean:1", "1", "ean", 1.0), ("ean:1", "4", "ean", 1.0)], MEMBERS)
    found = make([("s", "substitute", "melk", ["1", "2", "3"], 0.62, "pending", "rule"), ("e", "exact", "kaas", ["4"], 0.72, "pending", "rule"), ("n", "exact", "x", ["2"], 0.72, "pending", "rule")], CANDIDATES)
    reviews = make([("s", "approve", "ai", 0.9), ("e", "approve", None, None), ("n", "reject", None, None)], "candidate_key string, action string, reviewer string, ai_confidence double")
    names = make([("s", "melk", "nl", 0.5)], NAMES)
    got = grouping.apply_reviews(found, reviews, silver, products, groups, members, make([], GROUPS + ", group_kind string"), names, make([], MAPPINGS))
    rows = {k: sorted(map(tuple, t.collect()), key=str) for k, t in got.items()}
    assert rows["groups"] == [("e", "kaas", None, "manual", 0.72), ("ean:1", "melk", "1", "ean", 1.0)]
    assert rows["members"] == [("e", "4", "manual", 0.72), ("ean:1", "1", "ean", 1.0)]
    assert rows["ingredients"] == [("s", "melk", None, "ai", 0.9, "substitute")]
    assert rows["aliases"] == [("s", "halfvolle melk", "nl", 0.9), ("s", "melk", "nl", 0.5)]
    assert rows["mappings"] == [(i, "s", 0.9, "ai_batch", "approved") for i in "123"]
    assert rows["products"] == [("p1", "1", "ean:1", "s"), ("p2", "2", None, "s"), ("p3", "3", None, "s"), ("p4", "4", "e", None)]
    assert rows["report"] == [("e", "approved", 1), ("n", "rejected", 0), ("s", "approved", 2)]
