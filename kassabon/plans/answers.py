"""Answers of models: their text, tags and new keys by request, and decisions held against what they must say."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kassabon.functions.text import once

# What a decision may say, and the flags that it must set.
DECISIONS = ("approve", "reject", "needs_review")
FLAGS = ("diet_or_quality_variant_mixed", "package_mismatch", "brand_or_private_label_mismatch", "insufficient_information")

_OUTPUT = "array<struct<content:array<struct<type:string,text:string>>>>"


def _at(text: Column | str, path: str) -> Column:
    return F.get_json_object(text, path)


def output_text(body: Column) -> Column:
    """The text of a response: its own, else that of the first piece of content that is text."""
    chunks = F.flatten(F.transform(F.from_json(_at(body, "$.output"), _OUTPUT), lambda x: F.coalesce(x["content"], F.array().cast("array<struct<type:string,text:string>>"))))
    said = F.filter(chunks, lambda c: c["type"].isin("output_text", "text") & (c["text"] != ""))
    own = _at(body, "$.output_text")
    return F.coalesce(F.when(F.trim(own) != "", own), F.get(said, 0)["text"])


def answered(lines: DataFrame, requests: DataFrame) -> DataFrame:
    """(custom_id, stands_for, text) of each line (value) whose request (custom_id, stands_for as JSON text) is known and that says something in JSON."""
    texts = lines.select(_at("value", "$.custom_id").alias("custom_id"), output_text(_at("value", "$.response.body")).alias("text"))
    return texts.join(requests.select("custom_id", "stands_for"), "custom_id").filter(F.try_parse_json("text").isNotNull())


def _items(rows: DataFrame) -> DataFrame:
    """(custom_id, named, item): each object of an answer's items whose id the request knows, with what it stands for."""
    items = rows.select("custom_id", F.from_json("stands_for", "map<string,string>").alias("names"), F.explode(F.from_json(_at("text", "$.items"), "array<string>")).alias("item"))
    named = F.try_element_at("names", _at("item", "$.id"))
    return items.filter(F.col("item").startswith("{")).select("custom_id", named.alias("named"), "item").filter("named <> ''")


def tag_answers(lines: DataFrame, requests: DataFrame) -> DataFrame:
    """(name_search, canonical_key, display_name, is_organic, confidence, tag) of answers about one name, or several by id. ``tag`` is what was said, as JSON text."""
    rows = answered(lines, requests)
    one = rows.filter(F.col("stands_for").startswith('"')).select(F.get(F.from_json(F.concat(F.lit("["), "stands_for", F.lit("]")), "array<string>"), 0).alias("name_search"), F.col("text").alias("tag"))
    many = _items(rows.filter(F.col("stands_for").startswith("{"))).select(F.col("named").alias("name_search"), F.col("item").alias("tag"))
    both = one.filter("name_search <> ''").unionByName(many)
    return both.select("name_search", _at("tag", "$.canonical_key").alias("canonical_key"), _at("tag", "$.display_name").alias("display_name"), _at("tag", "$.is_organic").try_cast("boolean").alias("is_organic"), _at("tag", "$.confidence").try_cast("double").alias("confidence"), "tag")


def key_form(x: Column) -> Column:
    """A key of lower-case letters and digits with single underscores between."""
    plain = F.regexp_replace(F.lower(F.trim(x)), r"[^\p{L}\p{N}_]", "_")
    return F.regexp_replace(F.regexp_replace(plain, "_+", "_"), "^_|_$", "")


def remap_answers(lines: DataFrame, requests: DataFrame) -> DataFrame:
    """(old_key, coarse_key, display_name, confidence, reason) of answers that give keys a coarser one."""
    items = _items(answered(lines, requests)).select(F.col("named").alias("old_key"), key_form(_at("item", "$.coarse_key")).alias("coarse_key"), _at("item", "$.display_name").alias("display_name"), _at("item", "$.confidence").try_cast("double").alias("confidence"), _at("item", "$.reason").alias("reason"))
    return items.filter("coarse_key <> ''")


def _broken(said: Column, kind: Column) -> Column:
    """The rules that a decision (a variant) on a candidate of a kind breaks."""
    kind_of = lambda path: F.coalesce(F.schema_of_variant(F.try_variant_get(said, path, "variant")), F.lit("VOID"))
    value = lambda path: F.coalesce(F.try_variant_get(said, path, "string"), F.lit(""))
    number = kind_of("$.confidence").rlike("^(BIGINT|INT|SMALLINT|TINYINT|DOUBLE|FLOAT|DECIMAL.*)$") & F.coalesce(F.try_variant_get(said, "$.confidence", "double").between(0, 1), F.lit(False))
    spoken = lambda path: (kind_of(path) == "STRING") & (F.trim(value(path)) != "")
    rules = {
        "not_an_object": F.coalesce(F.schema_of_variant(said).startswith("OBJECT"), F.lit(False)),
        "decision": value("$.decision").isin(*DECISIONS),
        "group_kind": (kind_of("$.group_kind") == "STRING") & value("$.group_kind").eqNullSafe(kind),
        "confidence": number,
        "canonical_name": spoken("$.canonical_name"),
        "reason": spoken("$.reason"),
        "safety_flags": kind_of("$.safety_flags").startswith("OBJECT"),
        **{f"safety_flags.{f}": kind_of(f"$.safety_flags.{f}") == "BOOLEAN" for f in FLAGS},
    }
    return F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), name) for name, ok in rules.items()]))


def with_decision_reasons(rows: DataFrame, text: str, kind: str = "candidate_kind") -> DataFrame:
    """Every decision of a model (JSON in ``text``) on a candidate of a ``kind`` with ``reasons``, a word for each rule that it breaks: parsed and judged once."""
    return rows.withColumn("reasons", once(_broken, F.try_parse_json(text), F.col(kind)))


def judged_decisions(rows: DataFrame, text: str, kind: str = "candidate_kind") -> tuple[DataFrame, DataFrame]:
    """(valid, rejected) decisions, the rejected with their ``reasons``. Every row is in one of both; each reads all rows, so take ``with_decision_reasons`` where both are wanted."""
    judged = with_decision_reasons(rows, text, kind)
    return judged.filter(F.size("reasons") == 0).drop("reasons"), judged.filter(F.size("reasons") > 0)
