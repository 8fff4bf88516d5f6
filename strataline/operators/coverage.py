"""How far each run was seen: ten partitions of a model, capability records, and two axes for statuses that mix them.

Statuses form an order in which what is worst says the most, and aggregates count them, so results don't depend on the
order of producers, and partial sums merge. A producer that is absent (no row) is another thing than one that saw
nothing (a row with counts of zero): every run has a row for each partition of the catalogue, whatever is missing.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What a partition, a capability and a signal may say.
STATES = ("complete", "partial", "failed", "unavailable", "not-applicable")
SIGNAL_STATES = ("complete", "partial", "failed", "skipped")


@dataclass(frozen=True)
class Partition:
    """A part of a model and how its status follows from what its producers say.

    rule is one of: always (grounded in evidence, so complete); lanes (repositories that are eligible, the worst of their states);
    maps (lanes whose absence leaves the part partial, and in which open references do too); surface (registrations that an artifact details);
    stores (the worst of the states of repositories that have any); available (how many repositories have it); candidates (all or partial); capped (partial where a cap was hit); present (there or not).
    """

    name: str
    rule: str


# The parts of a model.
PARTITIONS = (
    Partition("repositories", "always"), Partition("files", "always"), Partition("symbols_and_calls", "lanes"), Partition("routes", "surface"), Partition("tables", "stores"),
    Partition("access_model", "available"), Partition("external_boundaries", "candidates"), Partition("deployable_units", "capped"), Partition("dependency_imports", "maps"), Partition("modules", "present"),
)


def worst_state(counts: dict[str, Column]) -> Column:
    """The state of a whole by how many of its parts have each state; no parts are unavailable."""
    total, active = reduce(Column.__add__, counts.values()), reduce(Column.__add__, [c for s, c in counts.items() if s != "not-applicable"])
    worst = F.when(total == 0, "unavailable").when(counts["failed"] > 0, "failed").when(active == 0, "not-applicable").when(counts["unavailable"] == active, "unavailable")
    return worst.when(counts["partial"] + counts["unavailable"] > 0, "partial").otherwise("complete")


def coverage_partitions(runs: DataFrame, observed: DataFrame, eligible: DataFrame, partitions: tuple[Partition, ...] = PARTITIONS) -> DataFrame:
    """run, partition, status, repositories, eligible, missing, found, unresolved, reason: one row for each partition of each run.

    runs: run, repositories (how many it has). observed: run, partition, repository, state, found, unresolved, capped: what producers say
    of repositories; a partition with any row is present. eligible: run, partition, repository: what should be seen.
    Of several rows for one repository its worst state counts. found of a partition that is a surface without its artifact
    (state unavailable) counts registrations known from elsewhere.
    """
    rank = F.create_map(*[x for i, s in enumerate(("complete", "not-applicable", "partial", "unavailable", "failed")) for x in (F.lit(s), F.lit(i))])
    per = observed.groupBy("run", "partition", "repository").agg(F.max_by("state", rank[F.col("state")]).alias("state"), F.sum("found").alias("found"), F.sum("unresolved").alias("unresolved"), F.bool_or("capped").alias("capped"))
    wanted = eligible.select("run", "partition", "repository").distinct().withColumn("wanted", F.lit(True))
    both = per.join(wanted, ["run", "partition", "repository"], "full_outer")
    n = lambda condition: F.count_if(F.coalesce(condition, F.lit(False)))
    sums = both.groupBy("run", "partition").agg(
        *[n(F.col("state") == s).alias(f"n_{s}") for s in STATES], n(F.col("state").isNotNull()).alias("seen"), n(F.col("wanted")).alias("eligible"), n(F.col("wanted") & F.col("state").isNull()).alias("missing"),
        F.coalesce(F.sum("found"), F.lit(0)).alias("found"), F.coalesce(F.sum("unresolved"), F.lit(0)).alias("unresolved"), F.coalesce(F.bool_or("capped"), F.lit(False)).alias("capped"),
    )
    catalogue = F.array(*[F.struct(F.lit(p.name).alias("partition"), F.lit(p.rule).alias("rule")) for p in partitions])
    whole = runs.select("run", "repositories", F.inline(catalogue)).join(sums, ["run", "partition"], "left")
    whole = whole.fillna(0).fillna(False)
    count = {s: F.col(f"n_{s}") for s in STATES}
    worst, seen, there = worst_state(count), F.col("seen"), F.col("seen") - F.col("n_unavailable")
    states = {
        "always": F.lit("complete"),
        "lanes": F.when(F.col("eligible") == 0, "not-applicable").when(seen == 0, "unavailable").otherwise(worst),
        "maps": F.when(F.col("eligible") == 0, "not-applicable").when(seen == 0, "partial").when(worst == "failed", "failed").when((F.col("missing") > 0) | (F.col("unresolved") > 0), "partial").otherwise(worst),
        "surface": F.when(there > 0, F.when(F.col("capped") | (F.col("unresolved") > 0), "partial").otherwise("complete")).when(F.col("found") == 0, "not-applicable").otherwise("partial"),
        "stores": worst,
        "available": F.when(there == 0, "unavailable").when((there < F.col("repositories")) | F.col("capped"), "partial").otherwise("complete"),
        "candidates": F.when((there > 0) & (there >= F.col("repositories")) & ~F.col("capped"), "complete").otherwise("partial"),
        "capped": F.when(F.col("capped"), "partial").otherwise("complete"),
        "present": F.when(seen > 0, "complete").otherwise("unavailable"),
    }
    status = reduce(lambda c, r: c.when(F.col("rule") == r, states[r]), states, F.when(F.lit(False), ""))
    reason = F.when(F.col("status") == "complete", "").when(F.col("status") == "not-applicable", "nothing-eligible").when(F.col("n_failed") > 0, "producer-failed").when(seen == 0, "artifact-absent").when(F.col("missing") > 0, "repositories-missing").when(F.col("capped"), "cap-hit").when(F.col("unresolved") > 0, "open-references").otherwise("producer-partial")
    return whole.withColumn("status", status).select("run", "partition", "status", F.col("seen").alias("repositories"), "eligible", "missing", "found", "unresolved", reason.alias("reason"))


def capability_records(expected: DataFrame, observed: DataFrame, producers: DataFrame) -> DataFrame:
    """run, capability, applicable, status, expected, observed, missing (sorted artifacts) of each capability.

    expected: run, capability, applicable, artifact (null for none); observed: run, artifact that is there; producers: run,
    capability, state of each producer, skipped ones included. An applicable capability that no producer speaks of has failed.
    """
    there = observed.select("run", "artifact").distinct().withColumn("there", F.lit(True))
    artifacts = expected.join(there, ["run", "artifact"], "left").groupBy("run", "capability").agg(
        F.bool_or("applicable").alias("applicable"), F.array_sort(F.collect_set("artifact")).alias("expected"), F.array_sort(F.collect_set(F.when(F.col("there"), F.col("artifact")))).alias("observed")
    )
    state = F.when(F.col("state") == "skipped", "unavailable").otherwise(F.col("state"))
    said = producers.groupBy("run", "capability").agg(*[F.count_if(state == s).alias(f"n_{s}") for s in STATES], F.count("*").alias("n"))
    both = artifacts.join(said, ["run", "capability"], "left").fillna(0)
    n, out = F.col("n"), F.col("n_unavailable")
    status = F.when(~F.col("applicable"), "not-applicable").when(n == 0, "failed").when(out == n, "unavailable").when(F.col("n_failed") > 0, "failed").when(F.col("n_partial") + out > 0, "partial").otherwise("complete")
    return both.select("run", "capability", "applicable", status.alias("status"), "expected", "observed", F.array_except("expected", "observed").alias("missing"))


def two_axes(status: Column, applicable: Column | None = None, kind: str = "signal") -> Column:
    """(applicability, status, reason) of a status that may mix both: of a signal (always applicable), a capability (with its flag) or a store's coverage. Null where a status is unknown or contradicts its flag."""
    known = status.isin(*(SIGNAL_STATES if kind == "signal" else STATES))
    out = status == "not-applicable" if kind == "datastore-coverage" else ~applicable if applicable is not None else F.lit(False)
    clash = F.lit(False) if kind == "datastore-coverage" else (status == "not-applicable") & ~out
    prefix = "signal-status" if kind == "signal" else "capability-status" if kind == "capability" else kind
    gone = "capability-not-applicable" if kind == "capability" else f"{prefix}-not-applicable"
    one = lambda a, s, r: F.struct(F.lit(a).alias("applicability"), s.alias("status"), r.alias("reason"))
    return F.when(known & ~clash, F.when(out, one("not-applicable", F.lit("complete"), F.lit(gone))).otherwise(one("applicable", status, F.concat(F.lit(f"{prefix}-"), status))))
