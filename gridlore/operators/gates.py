"""Gates before a catalog changes: proposals have to be whole, and changes need proposals and tests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: Keys that a proposal has, what a digest looks like.
REQUIRED = ("affected_profiles", "changes", "source_id", "source_sha256", "tests")
SHA256 = "^[0-9a-fA-F]{64}$"


def proposal_errors(content: Column) -> Column:
    """What is wrong with the JSON text of a proposal, in order; an empty array if nothing is."""
    keys = F.json_object_keys(content)
    missing = F.array_sort(F.array_except(F.array(*map(F.lit, REQUIRED)), keys))
    at = lambda name: F.get_json_object(content, f"$.{name}")
    empty = lambda name: F.coalesce(F.json_array_length(at(name)) == 0, F.lit(True))
    checks = [
        (F.size(missing) > 0, F.concat(F.lit("missing required key(s): "), F.array_join(missing, ", "))),
        (F.coalesce(F.trim(at("source_id")), F.lit("")) == "", F.lit("source_id must be non-empty")),
        (~F.coalesce(at("source_sha256").rlike(SHA256), F.lit(False)), F.lit("source_sha256 must be a 64-character SHA-256 digest")),
        *[(empty(name), F.lit(f"{name} must be a non-empty list")) for name in ("affected_profiles", "changes", "tests")],
    ]
    found = F.filter(F.array(*[F.when(bad, text) for bad, text in checks]), lambda x: x.isNotNull())
    return F.when(keys.isNull(), F.array(F.lit("invalid proposal JSON"))).otherwise(found)


def review(changes: DataFrame, proposals: DataFrame, catalog: tuple[str, ...], proposal_prefix: str, test_prefix: str) -> DataFrame:
    """(change_id, errors): what keeps a change of the catalog from passing; other changes have no errors.

    changes has a row for each (change_id, path), proposals (path, content).  A path is one of the catalog if it starts with one of ``catalog``.
    A proposal that the change names but that is not there is invalid.
    """
    p = F.col("path")
    ours = F.lit(False)
    for prefix in catalog:
        ours = ours | p.startswith(prefix)
    named = p.startswith(proposal_prefix) & p.endswith(".json")
    read = proposals.select("path", proposal_errors(F.col("content")).alias("wrong"))
    joined = changes.join(read, "path", "left").withColumn("wrong", F.when(named, F.coalesce("wrong", F.array(F.lit("invalid proposal JSON")))))
    told = F.transform("wrong", lambda w: F.concat(p, F.lit(": "), w))
    by_change = joined.groupBy("change_id").agg(
        F.max(ours).alias("touched"), F.max(named).alias("proposed"), F.max(p.startswith(test_prefix)).alias("tested"), F.array_sort(F.flatten(F.collect_list(told))).alias("wrong")
    )
    general = F.array(
        F.when(~F.col("proposed"), "changes of the catalog or its sources need a reviewed proposal"),
        F.when(~F.col("tested"), "changes of the catalog or its sources need a change of the tests"),
    )
    errors = F.concat(F.filter(general, lambda x: x.isNotNull()), "wrong")
    return by_change.select("change_id", F.when(F.col("touched"), errors).otherwise(F.array().cast("array<string>")).alias("errors"))
