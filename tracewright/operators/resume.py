"""Taking up a collection where it stopped: which records are complete, which jobs remain, which record of a key holds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEY = ["task_slug", "base_traj_id", "divergence_step", "alt_index"]
#: Statuses after which a job is tried again.
RETRYABLE = ("retry_exhausted", "worker_exception")


def is_complete(status: Column, files_exist: Column) -> Column:
    """There is a status, it is final, and a generated branch has its files."""
    known = F.trim(F.coalesce(status, F.lit("")))
    return (known != "") & ~known.isin(*RETRYABLE) & ((known != "generated") | F.coalesce(files_exist, F.lit(False)))


def latest(records: DataFrame, key: list[str] = KEY, order: str = "ord") -> DataFrame:
    """The last record of each key; max_by combines before the shuffle."""
    rest = [c for c in records.columns if c not in key]
    return records.groupBy(key).agg(F.max_by(F.struct(*rest), F.col(order)).alias("_r")).select(*key, "_r.*")


def remaining(jobs: DataFrame, records: DataFrame, key: list[str] = KEY) -> DataFrame:
    """Jobs without a complete record."""
    done = records.where(is_complete(F.col("status"), F.col("files_exist"))).select(key)
    return jobs.join(done, key, "left_anti")


def remaining_requests(requests: DataFrame, records: DataFrame, job: list[str], key: list[str] = KEY) -> DataFrame:
    """Requests (a row for each of their keys) of which any key has no complete record."""
    done = records.where(is_complete(F.col("status"), F.col("files_exist"))).select(*key, F.lit(True).alias("_done")).distinct()
    return requests.join(done, key, "left").groupBy(job).agg(F.bool_and(F.coalesce("_done", F.lit(False))).alias("_all")).where(~F.col("_all")).drop("_all")


def merged(in_flight: DataFrame, index: DataFrame, key: list[str] = KEY, order: str = "ord") -> DataFrame:
    """One record a key: of the index before one in flight, the later of equals."""
    both = in_flight.withColumn("_p", F.lit(0)).unionByName(index.withColumn("_p", F.lit(1)))
    rest = [c for c in both.columns if c not in [*key, "_p"]]
    return both.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct("_p", order)).alias("_r")).select(*key, "_r.*")


def all_retryable(statuses: Column) -> Column:
    return (F.size(statuses) > 0) & F.forall(statuses, lambda s: s.isin(*RETRYABLE))


#: What of a request may differ when a run is taken up again.
MAY_DIFFER = ["resume", "num_workers", "client_max_tokens_override", "client_timeout_override", "client_max_retries_override", "external_retry_attempts"]


def check_request(before: dict, now: dict) -> None:
    """An error that names what differs between the request of a run and the one that takes it up again."""
    differs = sorted(k for k in (before.keys() | now.keys()) - set(MAY_DIFFER) if (k in before, before.get(k)) != (k in now, now.get(k)))
    if differs:
        raise ValueError(f"not the request of the run: {', '.join(differs)}")


def complete(records: DataFrame, key: list[str] = KEY, order: str = "ord") -> DataFrame:
    """The last complete record of each key; keys without one have none."""
    return latest(records.where(is_complete(F.col("status"), F.col("files_exist"))), key, order)
