"""Groups of equal and substitutable products, and the queue of candidates for review."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kassabon.functions import numbers, text
from kassabon.operators.keyed import one_per_key, ordered_list
from kassabon.operators.numbered import numbered
from kassabon.sources.sinks import insert_new, upsert

NO_EAN = ("null", "none", "n/a")
# The order in which stores name a group.
STORE_RANK = ("ah", "jumbo", "plus", "dirk", "spar", "aldi")


def ean_keys(silver: DataFrame) -> DataFrame:
    """Silver rows with a usable article number and their group key of number, pack and quality."""
    ean = F.trim("ean")
    rows = silver.filter(F.col("name").isNotNull() & ean.isNotNull() & (ean != "") & ~F.lower(ean).isin(*NO_EAN))
    pack = text.pack_signature(F.col("name"), F.col("price"), F.col("base_price"), F.col("base_price_unit"))
    key = F.concat(F.lit("ean:"), ean, F.lit(":pack:"), pack, F.lit(":variant:"), text.variant_signature(F.col("name")))
    return rows.withColumn("ean", ean).withColumn("group_key", key)


def ean_groups(silver: DataFrame, least: int = 2) -> DataFrame:
    """(group_key, ean, canonical_name, member_count) of keys with several members."""
    got = ean_keys(silver).groupBy("group_key", "ean").agg(F.min("name").alias("canonical_name"), F.count(F.lit(1)).alias("member_count"))
    return got.filter(F.col("member_count") >= least)


def plain_ean_groups(silver: DataFrame) -> DataFrame:
    """Earlier rule: a group for each number, named by the store of highest rank."""
    rows = ean_keys(silver)
    rank = F.coalesce(F.nullif(F.array_position(F.array(*[F.lit(s) for s in STORE_RANK]), F.col("store")), F.lit(0)), F.lit(99))
    named = one_per_key(rows.withColumn("_rank", rank), ["ean"], [F.col("_rank"), F.col("name"), F.col("id")])
    return named.select(F.concat(F.lit("ean:"), "ean").alias("group_key"), "ean", F.col("name").alias("canonical_name"))


def group_members(silver: DataFrame, groups: DataFrame) -> DataFrame:
    return ean_keys(silver).join(groups.select("group_key"), "group_key").select("group_key", F.col("id").alias("silver_product_id"), F.lit("ean").alias("source"), F.lit(1.0).alias("confidence"))


def aliases(silver: DataFrame, groups: DataFrame) -> DataFrame:
    return ean_keys(silver).join(groups.select("group_key"), "group_key").select("group_key", F.col("name").alias("alias")).distinct()


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _moved(products: DataFrame, to: DataFrame, column: str, groups: DataFrame) -> DataFrame:
    """``products`` with ``column`` set by ``to`` (silver_product_id, _to) where it was null or a group of article numbers, and whether it changed."""
    own = groups.filter("source = 'ean'").select(F.col("group_key").alias(column), F.lit(True).alias("_ean"))
    rows = products.join(own, column, "left").join(to, "silver_product_id", "left")
    moves = F.col("_to").isNotNull() & (F.col(column).isNull() | F.col("_ean").isNotNull()) & ~F.col(column).eqNullSafe(F.col("_to"))
    return rows.withColumn("_moved", moves).withColumn(column, F.when(moves, F.col("_to")).otherwise(F.col(column))).select(*products.columns, "_moved")


def refresh_exact_groups(silver: DataFrame, products: DataFrame, groups: DataFrame, members: DataFrame, ingredients: DataFrame, names: DataFrame, mappings: DataFrame) -> dict[str, DataFrame]:
    """All tables after article-number groups were made anew, exact and substitute, and a report of the eight steps.

    Groups and memberships that a person or a model made stay; a product keeps such a group.
    ``products`` has id, silver_product_id, exact_group_key and ingredient_key; ``groups``
    group_key, canonical_name, ean, source and confidence, ``ingredients`` group_kind too;
    ``members`` group_key, silver_product_id, source and confidence; ``names`` (aliases) group_key,
    alias, language and confidence; ``mappings`` silver_product_id, group_key, confidence,
    mapping_source and review_status.
    """
    old = F.coalesce((F.col("source") == "ean") & F.col("group_key").startswith("ean:"), F.lit(False))
    cleared, counts = products, []
    for column, table, step in (("exact_group_key", groups, "cleared_exact_products"), ("ingredient_key", ingredients, "cleared_substitute_products")):
        gone = table.filter(old).select(F.col("group_key").alias(column), F.lit(True).alias("_gone"))
        marked = cleared.join(gone, column, "left")
        counts.append((step, marked.filter("_gone")))
        cleared = marked.withColumn(column, F.when(F.col("_gone").isNull(), F.col(column))).select(*products.columns)
    others, other_ingredients = groups.filter(~old), ingredients.filter(~old)
    lost = lambda rows, table: rows.join(table.filter(old).select("group_key"), "group_key", "left_anti").select(*rows.columns)
    fresh = ean_groups(silver).select("group_key", "canonical_name", "ean", F.lit("ean").alias("source"), F.lit(1.0).alias("confidence"))

    groups_after = upsert(others, fresh, ["group_key"])
    found = group_members(silver, groups_after)
    kept = lost(members, groups)
    members_after = upsert(kept, found, ["silver_product_id"], when=lambda before: before("source") == "ean", order=[F.col("group_key")])
    written = found.join(kept.filter("source is null or source <> 'ean'").select("silver_product_id"), "silver_product_id", "left_anti")
    exact = _moved(cleared, members_after.select("silver_product_id", F.col("group_key").alias("_to")), "exact_group_key", groups_after)
    counts += [("exact_groups", fresh), ("exact_members", written), ("public_exact_products", exact.filter("_moved"))]

    fresh_ingredients = fresh.withColumn("group_kind", F.lit("substitute"))
    ingredients_after = upsert(other_ingredients, fresh_ingredients, ["group_key"], keep=("group_kind",))
    named = aliases(silver, ingredients_after).withColumns({"language": F.lit("nl"), "confidence": F.lit(1.0)})
    kept_names = lost(names, ingredients)
    names_after = kept_names.unionByName(insert_new(kept_names, named, ["group_key", "alias"]).select(*names.columns))
    mapped = group_members(silver, ingredients_after).select("silver_product_id", "group_key", "confidence", F.lit("rule").alias("mapping_source"), F.lit("approved").alias("review_status"))
    mappings_after = upsert(lost(mappings, ingredients), mapped, ["silver_product_id", "group_key"])
    approved = mappings_after.filter("review_status = 'approved'").join(ingredients_after.filter("source = 'ean'").select("group_key"), "group_key", "left_semi")
    approved = approved.groupBy("silver_product_id").agg(F.min("group_key").alias("_to"))
    both = _moved(exact.drop("_moved"), approved, "ingredient_key", ingredients_after)
    counts += [("substitute_groups", fresh), ("substitute_mappings", mapped), ("public_substitute_products", both.filter("_moved"))]
    report = _union([table.agg(F.lit(step).alias("step"), F.count(F.lit(1)).cast("int").alias("rows_affected")).select("step", "rows_affected") for step, table in counts])
    return {"groups": groups_after, "members": members_after, "products": both.drop("_moved"), "ingredients": ingredients_after, "aliases": names_after, "mappings": mappings_after, "report": report}


def _features(silver: DataFrame, places: int) -> DataFrame:
    quantity = numbers.pack_quantity(F.col("price"), F.col("base_price"), places)
    return silver.filter("name is not null").withColumn("variant_sig", text.variant_signature(F.col("name"))).withColumn("pack_qty", quantity)


def _candidate_key(kind: str, name: str) -> Column:
    return F.concat(F.lit(f"{kind}:name:"), F.col(name), F.lit(":variant:"), F.col("variant_sig"), F.lit(":unit:"), F.coalesce("base_price_unit", F.lit("")), F.lit(":qty:"), F.coalesce(F.col("pack_qty").cast("string"), F.lit("")))


def review_candidates(silver: DataFrame, members: DataFrame, most: int | None = 2000) -> DataFrame:
    """Candidates of both kinds: equal names without a number, and generic names of one pack; each over several stores.

    ``most`` keeps the first of each kind; None keeps all, in no order.
    """
    free = silver.filter(F.coalesce(F.trim("ean"), F.lit("")) == "").join(members.select(F.col("silver_product_id").alias("id")), "id", "left_anti")
    exact = _features(free, 3).withColumn("norm_name", text.catalog_norm(F.col("name"))).filter("norm_name is not null")
    exact = exact.withColumn("candidate_key", _candidate_key("exact", "norm_name"))
    substitute = _features(silver.filter("price is not null"), 2).withColumn("generic_name", text.generic_name(F.col("name")))
    substitute = substitute.filter("generic_name <> '' and base_price_unit in ('kg', 'l') and pack_qty is not null")
    substitute = substitute.withColumn("candidate_key", _candidate_key("substitute", "generic_name"))
    out = None
    for kind, rows, largest, confidence, order in (("exact", exact, 10, 0.72, ("store", "name")), ("substitute", substitute, 16, 0.62, ("store", "price", "name"))):
        got = rows.groupBy("candidate_key").agg(F.min("name").alias("canonical_name"), F.count(F.lit(1)).alias("member_count"), F.count_distinct("store").alias("store_count"), ordered_list("id", *order).alias("silver_ids"))
        got = got.filter((F.col("member_count").between(2, largest)) & (F.col("store_count") >= 2))
        if most is not None:
            got = got.orderBy(F.desc("store_count"), F.desc("member_count"), "canonical_name", "candidate_key").limit(most)
        got = got.withColumn("candidate_kind", F.lit(kind)).withColumn("confidence", F.lit(confidence)).withColumn("status", F.lit("pending")).withColumn("source", F.lit("rule"))
        out = got if out is None else out.unionByName(got)
    return out


def candidate_members(candidates: DataFrame) -> DataFrame:
    """(candidate_key, silver_product_id, position from 1) of pending candidates."""
    rows = candidates.filter("status = 'pending'").select("candidate_key", F.posexplode("silver_ids").alias("at", "silver_product_id"))
    return rows.select("candidate_key", "silver_product_id", (F.col("at") + 1).alias("position"))


def apply_reviews(candidates: DataFrame, reviews: DataFrame, silver: DataFrame, products: DataFrame, groups: DataFrame, members: DataFrame, ingredients: DataFrame, names: DataFrame, mappings: DataFrame) -> dict[str, DataFrame]:
    """All tables after reviews (candidate_key, action, reviewer of 'ai' or 'manual', ai_confidence), and the products each changed.

    Approving an exact candidate makes a group of its members, approving another an ingredient
    with their names and mappings, with the first known of the confidences; exact groups stay as
    they were then. Reject and needs_later only change the status. Settled candidates are left
    alone. Tables are as in ``refresh_exact_groups``.
    """
    pending = candidates.join(one_per_key(reviews, ["candidate_key"], [F.col("action")]), "candidate_key", "left")
    act = F.when((F.col("status") == "pending") & F.col("action").isin("approve", "reject", "needs_later"), F.col("action"))
    status = F.when(act == "approve", "approved").when(act == "reject", "rejected").when(act == "needs_later", "needs_later").otherwise(F.col("status"))
    done = pending.withColumn("_act", act)
    sure = F.coalesce("ai_confidence", "confidence", F.lit(0.8))
    approved = done.filter("_act = 'approve'").withColumns({"source": F.coalesce("reviewer", F.lit("manual")), "confidence": sure, "group_key": F.col("candidate_key"), "ean": F.lit(None).cast("string")})
    exact = F.coalesce(F.col("candidate_kind") == "exact", F.lit(False))
    rows = approved.withColumn("silver_product_id", F.explode("silver_ids"))
    of_group, of_ingredient = rows.filter(exact), rows.filter(~exact)
    made = approved.filter(~exact).withColumn("group_kind", F.lit("substitute"))
    called = of_ingredient.join(silver.filter("name is not null").select(F.col("id").alias("silver_product_id"), F.col("name").alias("alias")), "silver_product_id").withColumn("language", F.lit("nl"))
    mapped = of_ingredient.withColumns({"mapping_source": F.when(F.col("source") == "ai", "ai_batch").otherwise("manual"), "review_status": F.lit("approved")})

    after, changed = products, []
    for column, part in (("exact_group_key", of_group), ("ingredient_key", of_ingredient)):
        to = part.groupBy("silver_product_id").agg(F.min("group_key").alias("_to"))
        moved = after.join(to, "silver_product_id", "left")
        changed.append(moved.filter(F.col("_to").isNotNull() & ~F.col(column).eqNullSafe(F.col("_to"))).select(F.col("_to").alias("candidate_key")))
        after = moved.withColumn(column, F.coalesce("_to", column)).select(*products.columns)
    counts = _union(changed).groupBy("candidate_key").agg(F.count(F.lit(1)).cast("int").alias("rows_affected"))
    report = done.filter("_act is not null").select("candidate_key", status.alias("status")).join(counts, "candidate_key", "left").fillna(0, ["rows_affected"])
    return {
        "candidates": done.withColumn("status", status).select(*candidates.columns),
        "groups": upsert(groups, approved.filter(exact).select(*groups.columns), ["group_key"], keep=("ean",)),
        "members": upsert(members, of_group.select(*members.columns), ["silver_product_id"], order=[F.col("group_key")]),
        "products": after,
        "ingredients": upsert(ingredients, made.select(*ingredients.columns), ["group_key"], keep=("group_kind", "ean")),
        "aliases": names.unionByName(insert_new(names, called.select(*names.columns), ["group_key", "alias"])),
        "mappings": upsert(mappings, mapped.select(*mappings.columns), ["silver_product_id", "group_key"]),
        "report": report,
    }


def review_queue(candidates: DataFrame, silver: DataFrame, status: str = "pending", kind: str | None = None, limit: int = 50) -> DataFrame:
    """Candidates with their products as a JSON list, the surest first."""
    rows = candidates.filter(F.col("status") == status)
    if kind:
        rows = rows.filter(F.col("candidate_kind") == kind)
    listed = rows.select("candidate_key", F.posexplode("silver_ids").alias("position", "id")).join(silver.select("id", "store", "name", "price"), "id")
    listed = listed.groupBy("candidate_key").agg(F.to_json(F.array_sort(F.collect_list(F.struct("position", "id", "store", "name", "price")))).alias("products"))
    return rows.join(listed, "candidate_key", "left").select("candidate_key", "candidate_kind", "canonical_name", "confidence", "products").orderBy(F.desc("confidence"), "candidate_key").limit(limit)


def model_approved(candidates: DataFrame, kind: str | None = None, limit: int = 100) -> DataFrame:
    """Pending candidates whose stored decision says approve."""
    rows = candidates.filter((F.col("status") == "pending") & (F.get_json_object("ai_decision", "$.decision") == "approve"))
    if kind:
        rows = rows.filter(F.col("candidate_kind") == kind)
    return rows.orderBy(F.col("ai_confidence").desc_nulls_last(), F.desc("confidence"), "candidate_key").limit(min(limit, 100)).select("candidate_key")


def batches(rows: DataFrame, *order: str, size: int = 80, segments: int = 1, salt: str = "catalog") -> DataFrame:
    """Rows with their segment, group and place for batch requests: groups of ``size`` in a total order."""
    placed = numbered(rows, *order, place="_row")
    total = placed.count()
    group = F.floor(F.col("_row") / size).cast("long")
    per = max(1, -(-(-(-total // size)) // segments))
    segment = (F.floor(group / per) + 1).cast("int")
    name = F.format_string(f"{salt}-segment-%02d-group-%05d", segment, group - (segment - 1) * per + 1)
    return placed.select(*rows.columns, segment.alias("segment"), name.alias("custom_id"), (F.col("_row") % size).cast("int").alias("item_index"))


def batch_answers(lines: DataFrame, manifest: DataFrame) -> DataFrame:
    """Answers (custom_id, body) matched to the manifest's rows (custom_id, item_index, silver_product_id).

    A response with a repeated or unknown index is dropped whole.
    """
    shape = "array<struct<itemIndex:int,canonicalName:string,category:string,aliases:array<string>,confidence:double>>"
    items = lines.select("custom_id", F.explode(F.from_json(F.get_json_object("body", "$.items"), shape)).alias("x")).select("custom_id", "x.*")
    known = items.join(manifest.withColumnRenamed("item_index", "itemIndex"), ["custom_id", "itemIndex"], "left")
    whole = known.groupBy("custom_id").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("itemIndex").alias("d"), F.count("silver_product_id").alias("k"))
    return known.join(whole.filter("n = d and n = k").select("custom_id"), "custom_id", "left_semi")


def gold(silver: DataFrame, mappings: DataFrame, sure: float = 0.85) -> DataFrame:
    """Mappings of known products with a name: the first of each product, approved where sure enough."""
    named = mappings.filter(F.trim("canonicalName") != "").join(silver.select(F.col("id").alias("silver_product_id")), "silver_product_id", "left_semi")
    first = one_per_key(named, ["silver_product_id"], [F.col("custom_id"), F.col("itemIndex")])
    return first.select("silver_product_id", text.normalized_name(F.col("canonicalName")).alias("canonical_name"), "category", "aliases", "confidence", F.when(F.col("confidence") >= sure, "approved").otherwise("pending").alias("review_status"))
