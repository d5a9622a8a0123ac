"""Configuration checks, barriers and validity windows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def validate(df: DataFrame, rules: Sequence[tuple[str, Column]]) -> DataFrame:
    """evaluate every rule (name, condition that must hold) on every row.

    The reference stops at the first failing assert; here ``failures``
    lists all failed rule names in rule order (comma-joined),
    ``first_failure`` is the one the reference would raise, ``valid``
    says whether none failed.  A rule whose condition is null (a null
    input) counts as failed.
    """
    failed = [F.when(~F.coalesce(cond, F.lit(False)), F.lit(name)) for name, cond in rules]
    return df.withColumns({
        "failures": F.concat_ws(",", *failed),
        "first_failure": F.coalesce(*failed),
        "n_failures": sum((F.when(f.isNotNull(), 1).otherwise(0) for f in failed), F.lit(0)).cast("bigint"),
    }).withColumn("valid", F.col("n_failures") == 0)


# Rule builders for the reference's checks.
def at_least(col: str, n) -> Column:
    return F.col(col) >= F.lit(n)


def positive(col: str) -> Column:
    return F.col(col) > F.lit(0)


def non_empty(col: str) -> Column:
    return F.length(F.col(col)) > 0


def all_distinct(*cols: str) -> Column:
    """``len({a, b, c}) == 3``."""
    return F.size(F.array_distinct(F.array(*[F.col(c) for c in cols]))) == len(cols)


def barrier_violations(parents: DataFrame, children: DataFrame, parent_key: str, child_key: str,
                       parent_ts: str, child_ts: str) -> DataFrame:
    """T5: a child may start only after its parent started.  Children are
    reduced to (first start, count) per parent before the join, then each
    parent with ``first_child_ts <= parent_ts`` is a violation."""
    firsts = (children.groupBy(F.col(child_key).alias("_ff_k"))
              .agg(F.min(child_ts).alias("first_child_ts"), F.count(F.lit(1)).alias("n_children")))
    j = parents.join(firsts, parents[parent_key] == firsts["_ff_k"]).drop("_ff_k")
    return j.where(F.col("first_child_ts") <= F.col(parent_ts))


def validity_status(df: DataFrame, issued: str, asof: str | Column, valid_days: int | str = 730,
                    backdate_days: int = 1) -> DataFrame:
    """``not_before = issued - 1 day``, ``not_after = issued +
    valid_days``, and the status at ``asof``: ``not_yet`` / ``valid`` /
    ``expired`` (both ends inclusive, as for X.509)."""
    at = F.lit(asof).cast(df.schema[issued].dataType) if isinstance(asof, str) else asof
    days = F.lit(valid_days) if isinstance(valid_days, int) else F.col(valid_days)
    out = df.withColumns({
        "not_before": F.col(issued) - F.make_dt_interval(days=F.lit(backdate_days)),
        "not_after": F.col(issued) + F.make_dt_interval(days=days),
    })
    status = (F.when(at < F.col("not_before"), F.lit("not_yet"))
              .when(at > F.col("not_after"), F.lit("expired"))
              .otherwise(F.lit("valid")))
    return out.withColumn("status", status)


# The reference's checks, in its assert order (first failure = the one it raises).
def cluster_rules(workers: str = "workers", ipc: str = "dask_ipc", dash: str = "dask_dash",
                  nanny: str = "dask_nanny") -> list[tuple[str, Column]]:
    """Cluster creation/attach: workers > 0, each port >= 1024, ports distinct."""
    return [("workers_positive", positive(workers)),
            ("ipc_port_unprivileged", at_least(ipc, 1024)),
            ("dash_port_unprivileged", at_least(dash, 1024)),
            ("nanny_port_unprivileged", at_least(nanny, 1024)),
            ("ports_distinct", all_distinct(ipc, dash, nanny))]


def node_rules(wait: str = "wait") -> list[tuple[str, Column]]:
    """Node and command polling: the wait interval is positive."""
    return [("wait_positive", positive(wait))]


def ssh_rules(name: str = "name", user: str = "user", key: str = "fn_private", port: str = "port",
              cipher: str = "cipher") -> list[tuple[str, Column]]:
    """SSH settings: non-empty host, user, key path and cipher; port > 0."""
    return [("name_set", non_empty(name)), ("user_set", non_empty(user)),
            ("key_set", non_empty(key)), ("port_positive", positive(port)),
            ("cipher_set", non_empty(cipher))]


def certificate_rules(valid_days: str = "valid_days", prefix: str = "name") -> list[tuple[str, Column]]:
    """Certificates: positive validity, non-empty prefix."""
    return [("valid_days_positive", positive(valid_days)), ("prefix_set", non_empty(prefix))]
