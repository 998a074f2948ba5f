"""From raw sources to the labelled benchmark: routing, panel audit, assembly and its checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalloom.functions.labels import DISAGREEMENT, GOLD_TEXT, REMOVE, REMOVE_VOTES, lookup, ordinal, ordinal_median, pairs_mean, rating
from evalloom.functions.text import chat_prompt, filled, first_with_prefix
from evalloom.operators.relations import duplicates, missing_from, stacked

#: How urgency words and physician categories become labels; None goes to a panel.
URGENCY = {"em": "D", "sc": "A", "ne": None}
CATEGORIES = {"emergent": "D", "conditionally-emergent": None, "non-emergent": None}
THEME, CATEGORY_PREFIX = "theme:emergency_referrals", "physician_agreed_category:"
DIRECT_METHODS = ("direct", "median")


def routed_by(df: DataFrame, column: str, routes: dict[str, str | None]) -> tuple[DataFrame, DataFrame]:
    """Rows with their direct label (null: to be reviewed), and rows of an unknown route, which are an error."""
    label = F.lit(None).cast("string")
    for k, v in routes.items():
        label = F.when(F.col(column) == k, F.lit(v)).otherwise(label)
    known = F.coalesce(F.col(column).isin(*routes), F.lit(False))
    return df.filter(known).withColumn("mapped_label", label), df.filter(~known)


def categorised(df: DataFrame, tags: str, theme: str = THEME, prefix: str = CATEGORY_PREFIX) -> tuple[DataFrame, DataFrame]:
    """Rows tagged with the theme, routed by the category that their first tag with the prefix names; as from routed_by."""
    return routed_by(df.filter(F.array_contains(tags, theme)).withColumn("category", first_with_prefix(F.col(tags), prefix)), "category", CATEGORIES)


def first_variants(df: DataFrame, variant: str, gold: str) -> tuple[DataFrame, DataFrame]:
    """The first variant of each case with its normalised label, and those of them whose label is unknown."""
    out = df.filter(F.col(variant) == 1).withColumn("normalized_label", F.try_element_at(lookup(GOLD_TEXT), F.col(gold))).withColumn("is_edge_case", F.contains(gold, F.lit("/")))
    return out.filter("normalized_label IS NOT NULL"), out.filter("normalized_label IS NULL")


def raters(labels: DataFrame, columns: list[str]) -> DataFrame:
    """The distinct raters that any of the columns names; blanks aside."""
    return labels.select(F.explode(F.array(*columns)).alias("rater")).filter("rater <> ''").distinct()


def card_counts(cards: DataFrame, sets: dict[str, list[str]]) -> DataFrame:
    """(counted, value, n): counts of cards by each set of columns, values joined by colons, in one pass."""
    columns = sorted({c for cols in sets.values() for c in cols})
    grouped = cards.groupingSets([[F.col(c) for c in cols] for cols in sets.values()], *columns).agg(F.count("*").alias("n"), F.grouping_id(*columns).alias("_set"))
    mark = {sum(1 << (len(columns) - 1 - i) for i, c in enumerate(columns) if c not in cols): (name, cols) for name, cols in sets.items()}
    named = [F.when(F.col("_set") == k, F.struct(F.lit(name).alias("counted"), F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in cols]).alias("value"))) for k, (name, cols) in mark.items()]
    return grouped.select(F.coalesce(*named).alias("x"), "n").select("x.*", "n")


def bundle_counts(examples: DataFrame, family: str, source: str, split: str, label: str) -> DataFrame:
    """(counted, value, n): examples, distinct families and sources, and examples by split and by label."""
    whole = examples.agg(F.count("*").alias("examples"), F.countDistinct(family).alias("families"), F.countDistinct(source).alias("sources"))
    rows = whole.select(F.explode(F.array(*[F.struct(F.lit(c).alias("counted"), F.lit("").alias("value"), F.col(c).alias("n")) for c in whole.columns])).alias("x")).select("x.*")
    return rows.unionByName(card_counts(examples, {"split": [split], "label": [label]}))


def edited(df: DataFrame, edits: DataFrame, key: str, text: str) -> DataFrame:
    """Texts replaced by their edit, where one is marked and not blank."""
    good = edits.filter((F.lower("is_edited") == "true") & (F.trim(F.coalesce("edited_text", F.lit(""))) != "")).select(key, F.col("edited_text").alias("_edit"))
    return df.join(good, key, "left").withColumn(text, F.coalesce("_edit", text)).drop("_edit")


def panel(votes: str) -> dict[str, Column]:
    """What an array of votes says: removals, mean pairwise distance, routing and label."""
    removals = F.size(F.filter(votes, lambda v: v == REMOVE))
    scores = F.filter(F.transform(votes, ordinal), lambda v: v.isNotNull())
    apart = pairs_mean(scores)
    out = removals >= REMOVE_VOTES
    return {"remove_votes": removals, "avg_distance": apart, "mapping_method": F.when(out, "excluded_review").when(apart > DISAGREEMENT, "excluded_disagreement").otherwise("median"), "panel_label": F.when(~out, rating(ordinal_median(scores)))}


def audit_panel(labels: DataFrame, votes: str, raters: str, key: str) -> DataFrame:
    """(key, problem): released rows that disagree with what their votes say.

    labels has remove_votes, avg_sd, mapping_method and normalized_label as released.
    """
    said = panel(votes)
    rules = [
        (F.exists(votes, lambda v: F.coalesce(v, F.lit("")) == "") | F.exists(raters, lambda v: F.coalesce(v, F.lit("")) == ""), "incomplete_panel"),
        (F.size(F.array_distinct(raters)) != F.size(raters), "repeated_rater"),
        (~said["remove_votes"].eqNullSafe(F.col("remove_votes")), "remove_votes_differ"),
        (F.abs(said["avg_distance"] - F.col("avg_sd")) > 1e-9, "distance_differs"),
        (~said["mapping_method"].eqNullSafe(F.col("mapping_method")), "routing_differs"),
        (~F.coalesce(said["panel_label"], F.lit("")).eqNullSafe(F.coalesce("normalized_label", F.lit(""))), "label_differs"),
    ]
    surveyed = labels.filter("mapping_method <> 'excluded_manual'")
    return surveyed.select(key, F.explode(F.filter(F.array(*[F.when(c, F.lit(p)) for c, p in rules]), lambda p: p.isNotNull())).alias("problem"))


def assembled(direct: list[DataFrame], surveyed: DataFrame, raw: DataFrame, keys: list[str], columns: list[str]) -> tuple[DataFrame, dict[str, DataFrame]]:
    """The benchmark in file order (ordinal), and the checks that must be empty before it is written.

    surveyed rows take their text from raw by key, mandatorily; direct rows come first.
    """
    found = surveyed.join(raw, keys)
    blocks = [d.withColumn("_block", F.lit(i)) for i, d in enumerate([*direct, found])]
    rows = stacked(*blocks).filter("normalized_label IS NOT NULL")
    out = rows.select(*columns, F.struct("_block", "ordinal").alias("position"), F.when(F.coalesce(F.col("mapping_method").isin(*DIRECT_METHODS), F.lit(False)), "primary").otherwise("ambiguous").alias("split"))
    return out, {"survey rows without a source": missing_from(surveyed, raw, keys), "repeated keys": duplicates(out, keys)}


def prompts(df: DataFrame, text: str, is_chat: Column, template: str, note: str) -> DataFrame:
    """Adds the chat prompt and the question prompt; an unfilled placeholder raises."""
    values = {"{{CONVERSATION_NOTE}}": F.when(is_chat, note).otherwise(""), "{{CASE}}": F.col(text)}
    return df.withColumns({"conversational_prompt": chat_prompt(F.col(text), is_chat), "qa_prompt": filled(F.lit(template), values)})


def drift(cards: DataFrame, rows: DataFrame, keys: list[str], fields: dict[str, str]) -> DataFrame:
    """(keys, field): where a card no longer says what its benchmark row says; a row that is gone counts as all."""
    j = cards.join(rows.select(*keys, *[F.col(v).alias(f"_{v}") for v in fields.values()], F.lit(True).alias("_here")), keys, "left")
    tests = [F.when(F.col("_here").isNull(), F.lit("missing_row"))] + [F.when(F.col("_here") & ~F.col(k).eqNullSafe(F.col(f"_{v}")), F.lit(k)) for k, v in fields.items()]
    return j.select(*keys, F.explode(F.filter(F.array(*tests), lambda x: x.isNotNull())).alias("field"))
