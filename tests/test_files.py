"""Landed files, exports and the incremental refresh."""

import json

from kassabon.sources import files, sinks
from kassabon.streaming import incremental
from pyspark.sql import functions as F


def test_lines_there_and_back(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a", None), (2, "é\n", 2.5)], "k long, t string, x double")
    sinks.write_jsonl(rows, str(tmp_path / "lines"))
    got = [json.loads(r["value"]) for r in files.read_jsonl(spark, str(tmp_path / "lines")).collect()]
    assert sorted(got, key=lambda r: r["k"]) == [{"k": 1, "t": "a"}, {"k": 2, "t": "é\n", "x": 2.5}]
    (tmp_path / "blank.jsonl").write_text('\n  {"a": 1} \n\n')
    assert [r["value"] for r in files.read_jsonl(spark, str(tmp_path / "blank.jsonl")).collect()] == ['{"a": 1}']


def test_csv_columns(spark, tmp_path):
    path = tmp_path / "export.csv"
    path.write_text('﻿Product Name,bonus_price,Price\n"a ""b""\nc",1.00,2\n,,3\n', encoding="utf-8")
    df = files.read_csv(spark, str(path))
    assert df.columns == ["Product Name", "bonus_price", "Price"]
    spoken, rest = files.promotion_columns(df)
    got = df.select(files.find_column(df, "title", "productname").alias("name"), spoken.alias("spoken"), rest.alias("rest"), files.find_column(df, "none").alias("none")).collect()
    assert [r["name"] for r in got] == ['a "b" c', None]
    assert [(r["spoken"], r["rest"]) for r in got] == [({"bonus_price": "1.00"}, {"Product Name": 'a "b"\nc', "Price": "2"}), ({}, {"Price": "3"})]
    assert files.read_csv(spark, str(path), limit=1).count() == 1


def test_pages(spark, tmp_path):
    (tmp_path / "page.html").write_text("<p>\n1</p>")
    got = files.read_pages(spark, str(tmp_path / "page.html")).first()
    assert got["html"] == "<p>\n1</p>" and got["url"].endswith("page.html")


def envelope(number, day, price):
    return json.dumps({"store": "spar", "external_id": str(number), "scraped_at": f"2024-01-0{day}T00:00:00Z", "raw": {"product_name": f"p{number}", "price_visible": price}}) + "\n"


def test_incremental_refresh(spark, tmp_path):
    landing, log = tmp_path / "landing", str(tmp_path / "log")
    table = incremental.silver_table(spark, str(tmp_path / "state"), buckets=8)
    landing.mkdir()

    def rows(number=None):
        got = table.read(number).select("external_id", F.col("price").cast("string").alias("price"), F.dayofmonth("first_seen_at").alias("first"), F.dayofmonth("last_seen_at").alias("last")).collect()
        return sorted(map(tuple, got))

    def refreshed():
        incremental.start(spark, str(landing), table, log).awaitTermination()
        return rows()

    assert table.state() == (-1, -1, {})
    (landing / "1.jsonl").write_text(envelope(1, 2, "1,00") + envelope(2, 2, "2,00"))
    assert refreshed() == [("1", "1.00", 2, 2), ("2", "2.00", 2, 2)]
    # a newer row, a late one, and a new product
    (landing / "2.jsonl").write_text(envelope(1, 3, "1,50") + envelope(2, 1, "9,00") + envelope(3, 3, "3,00"))
    want = [("1", "1.50", 2, 3), ("2", "2.00", 2, 2), ("3", "3.00", 3, 3)]
    assert refreshed() == want
    commits = table.commits()
    assert refreshed() == want  # nothing landed
    # the same batch again changes nothing, a later one with the same rows only leaves its mark
    merge = incremental.refresh_batch(table)
    merge(files.read_jsonl(spark, str(landing / "2.jsonl")), 1)
    assert table.commits() == commits
    merge(files.read_jsonl(spark, str(landing / "2.jsonl")), 7)
    assert (rows(), table.state()[1]) == (want, 7)
    assert len(rows(0)) == 2


def test_repeats_within_the_watermark(spark, tmp_path):
    landing = tmp_path / "landing"
    landing.mkdir()
    (landing / "1.jsonl").write_text(envelope(1, 2, "1,00") * 2 + envelope(2, 2, "2,00") + '{"store":"spar","external_id":"9"}\n')
    out = []
    query = incremental.without_repeats(incremental.read_landing(spark, str(landing))).writeStream.foreachBatch(lambda df, _: out.extend(df.collect())).option("checkpointLocation", str(tmp_path / "log"))
    query.trigger(availableNow=True).start().awaitTermination()
    (landing / "2.jsonl").write_text(envelope(1, 2, "1,00") + envelope(3, 2, "3,00"))
    query.trigger(availableNow=True).start().awaitTermination()
    assert sorted(json.loads(r["value"])["external_id"] for r in out) == ["1", "2", "3", "9"]


def test_state_by_product(spark, tmp_path):
    """Late, repeated and replayed lines: the last row that the stream gives of each product is the batch's result."""
    landing = tmp_path / "landing"
    landing.mkdir()
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", incremental.ROCKS)
    out = {}

    def take(df, _):
        for r in df.collect():
            out[r["external_id"]] = (r["first_seen_at"], r["last_seen_at"], json.loads(r["value"])["raw"]["price_visible"])

    try:
        for i, text in enumerate([envelope(1, 2, "1,00") + envelope(2, 2, "2,00") + envelope(1, 1, "0,50"), envelope(1, 3, "1,50") + envelope(2, 1, "9,00") + '{"store":"spar"}\n', envelope(1, 3, "1,50") + envelope(2, 2, "2,00"), envelope(3, 4, "3,00")]):
            (landing / f"{i}.jsonl").write_text(text)
            out_before = dict(out)
            stream = incremental.latest_envelopes(incremental.read_landing(spark, str(landing))).writeStream.outputMode("update").foreachBatch(take).option("checkpointLocation", str(tmp_path / "log"))
            stream.trigger(availableNow=True).start().awaitTermination()
            if i == 2:
                assert out == out_before  # repeats bring no news
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    day = lambda d: 1_704_067_200_000_000 + (d - 1) * 86_400_000_000
    assert out == {"1": (day(1), day(3), "1,50"), "2": (day(2), day(2), "2,00"), "3": (day(4), day(4), "3,00")}


def test_windowed_counts(spark):
    events = spark.createDataFrame([("a", "2024-01-01 00:10:00"), ("a", "2024-01-01 00:50:00"), ("b", "2024-01-01 01:00:00")], "store string, at string").select("store", F.to_timestamp("at").alias("scraped_at"))
    got = sorted((r["store"], r["window"]["start"].hour, r["n"]) for r in incremental.windowed_counts(events).collect())
    assert got == [("a", 0, 2), ("b", 1, 1)]
