"""Landed rows kept as variants: parsed once, silver the same."""

import re

from kassabon.plans import queries, silver
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def test_silver_of_parsed_rows(spark, tmp_path):
    lines = queries.landed(spark, SF)
    odd = spark.createDataFrame([('{"store":"ah","external_id":null,"raw":{"card":{"title":" Melk "}}}',), ('{"store":"aldi","external_id":"x1","raw":{"name":"Kaas","assets":[{"type":1},{"type":"primary","url":"k.png"}]}}',), ('{"store":"aldi","external_id":"x2","raw":{"assets":"none"}}',), ("{broken",)], "value string")
    rows = silver.bronze(lines.select("value").unionByName(odd), F.lit("2024-01-03").cast("timestamp"))
    silver.parsed(rows).write.parquet(str(tmp_path / "bronze"))
    kept = spark.read.parquet(str(tmp_path / "bronze"))
    got = silver.silver(kept)
    want = silver.silver(rows)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert got.filter("name = 'Kaas' and image_url = 'k.png'").count() == 1
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert not re.search(r"parse_json|parseJson|get_json_object|from_json", plan)


def test_landing_on_parsed_rows(spark):
    when = F.lit("2024-01-03").cast("timestamp")
    line = lambda n: (f'{{"store":"ah","external_id":"{n}","raw":{{"card":{{"title":"P{n}"}}}}}}',)
    old = silver.parsed(silver.bronze(spark.createDataFrame([line(1), line(2)], "value string"), when))
    after, counts = silver.land(old, spark.createDataFrame([line(2), line(3), line(3)], "value string"), when, "second")
    assert [tuple(r) for r in counts.collect()] == [(1, 1)]
    assert sorted(r.external_id for r in silver.silver(after).collect()) == ["1", "2", "3"]
