"""Which stage of a configuration lost the evidence: one CASE over per-stage satisfaction flags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STAGES = ("representation", "ann_index", "candidate_generation", "fusion", "reranker_demotion", "final_cutoff", "budget_cutoff")


def attribute(row) -> Column:
    """The verdict from flags: each is true, false or null, null meaning that the configuration has no such stage.

    ``row`` maps all_chunks, exact_union, union, fused, reranker_input, final, budget to columns;
    is_hybrid and has_rerank to booleans. A configuration with a budget delivers the packed list,
    even an empty one, so a hit is judged on it.
    """
    no = lambda c: ~F.coalesce(c, F.lit(False))
    yes = lambda c: F.coalesce(c, F.lit(False))
    delivered = F.when(row["budget"].isNotNull(), row["budget"]).otherwise(row["final"])
    return (
        F.when(yes(delivered), F.lit(None).cast("string"))
        .when(no(row["all_chunks"]), "representation")
        .when(yes(row["exact_union"]) & no(row["union"]), "ann_index")
        .when(no(row["union"]), "candidate_generation")
        .when(row["is_hybrid"] & row["fused"].isNotNull() & no(row["fused"]), "fusion")
        .when(row["has_rerank"] & row["reranker_input"].isNotNull() & no(row["final"]), "reranker_demotion")
        .when(no(row["final"]), "final_cutoff")
        .when(row["budget"].isNotNull() & no(row["budget"]), "budget_cutoff")
    )


def branch_diagnostics(dense: Column, sparse: Column) -> Column:
    """map of the existing branches to whether each alone satisfies gold; null without branches."""
    pairs = F.filter(
        F.array(F.struct(F.lit("dense").alias("k"), dense.alias("v")), F.struct(F.lit("sparse").alias("k"), sparse.alias("v"))),
        lambda p: p["v"].isNotNull(),
    )
    return F.when(F.size(pairs) > 0, F.map_from_entries(pairs))


def violations(results: DataFrame) -> DataFrame:
    """Rows that break the invariant: a hit has no stage, a miss has one."""
    return results.where(~F.coalesce("refused", F.lit(False)) & (F.col("hit") != F.col("stage_attribution").isNull()))
