"""Decisions from suspects by fixed rules, in the place of a judge."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: What is done about each kind; kinds that are not here are dismissed.
RULES = {
    "pseudo_heading": "demote",
    "cross_page_break": "merge",
    "page_artifact": "drop",
    "residual_markup": "strip",
    "empty_table": "drop",
    "split_list": "mergeList",
    "missed_heading": "promote",
    "trailing_marker": "split",
    "extra_char": "deleteChar",
    "caption_heading": "extractCaption",
    "caption_artifact": "dropCaption",
}
#: Tables are only joined where somebody looks at their pictures.
VISION_RULES = RULES | {"split_table": "mergeTable"}
DEFAULT_LEVEL = 2


def decide(suspects: DataFrame, rules: dict[str, str] = RULES) -> DataFrame:
    """A decision for each suspect that has a rule: markup goes by its first reason, headings take their sibling's level, captions go behind the table."""
    op = F.create_map(*[F.lit(x) for pair in rules.items() for x in pair])[F.col("kind")]
    level = F.when(F.col("kind") == "missed_heading", F.coalesce("value", F.lit(DEFAULT_LEVEL))).when(
        F.col("kind") == "caption_heading", F.coalesce(F.col("detail").try_cast("int"), F.lit(DEFAULT_LEVEL))
    )
    # the first reason of the markup; others show again in the next round
    reason = F.substring_index("detail", ",", 1)
    pattern = F.when(reason == "latex", "latex_dollar").otherwise(reason)
    caption = F.when(F.col("kind").isin("caption_heading", "caption_artifact"), F.col("value"))
    return suspects.where("has_op").withColumn("op", op).where("op is not null").select(
        "doc_id", "ord", "kind", "op",
        F.when(F.col("op").isin("merge", "mergeList", "mergeTable"), F.col("next_ord")).alias("ord_b"),
        F.when(F.col("op").isin("split", "deleteChar"), F.col("value")).alias("offset"), level.cast("int").alias("level"),
        F.when(F.col("op") == "strip", pattern).alias("pattern"), caption.cast("int").alias("caption_index"), F.lit("after").alias("position"),
        F.lit(False).alias("join_seam"), F.lit("policy").alias("reason"),
    )
