"""Plans, wallets, ledgers and metered usage."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

BILLED = "Interview completed - Interview ID "
CYCLE_DAYS = 30
# Plan, billing, price a user, interviews, résumé scans, job posts, seats; an absent number has no limit.
PLANS = (
    ("starter", "monthly", 66, 10, 500, 5, 4),
    ("starter", "yearly", 720, 150, 500, 5, 4),
    ("growth", "monthly", 45, 30, None, 20, 11),
    ("growth", "yearly", 499, 360, None, 20, 11),
)
# Other names of the metered features.
FEATURES = {
    "interview_credit": "interview", "resume": "resume_score", "resume_scan": "resume_score", "job": "job_post",
    "job_posting": "job_post", "user": "user_add", "user_seat": "user_add",
}


def plans(spark: SparkSession) -> DataFrame:
    schema = "plan string, billing string, price int, interview int, resume_score int, job_post int, user_add int"
    return spark.createDataFrame(list(PLANS), schema).withColumn("days", F.when(F.col("billing") == "yearly", 365).otherwise(CYCLE_DAYS))


def feature(c: Column) -> Column:
    name = F.lower(F.trim(c))
    known = F.create_map(*[F.lit(x) for kv in FEATURES.items() for x in kv])
    return F.coalesce(F.try_element_at(known, name), name)


def remaining(total: Column, used: Column) -> Column:
    """What is left of a total, at least 0; null where there is no limit."""
    return F.when(total.isNotNull(), F.greatest(total - used, F.lit(0)))


def allowed(total: Column, used: Column, amount: Column) -> Column:
    return total.isNull() | (F.greatest(total - used, F.lit(0)) >= amount)


def subscribed(wanted: DataFrame, catalogue: DataFrame, now: str) -> DataFrame:
    """Rows of a new subscription for (agency_id, plan, billing, users): totals, price and expiry."""
    at = F.lit(now).cast("timestamp")
    joined = wanted.join(F.broadcast(catalogue), ["plan", "billing"])  # a handful of plans
    return joined.select(
        "agency_id", "plan", "billing", (F.col("price") * F.col("users")).alias("total_price"), "interview", "resume_score", "job_post",
        F.timestamp_add("DAY", F.col("days"), at).alias("expires_at"),
    )


def billed_usage(ledger: DataFrame, since: str) -> DataFrame:
    """(user_id, used): amounts debited for interviews since the cycle began."""
    own = (F.col("transaction_type") == "DEBIT") & F.col("description").startswith(BILLED) & (F.col("created_at") >= F.lit(since).cast("timestamp"))
    return ledger.filter(own).groupBy("user_id").agg(F.sum("amount").cast("long").alias("used"))


def seats(users: DataFrame) -> DataFrame:
    return users.groupBy("agency_id").agg(F.count_if("is_active").alias("seats"))


def billable(status: Column, recording: Column, transcript: Column, summary: Column, score: Column) -> Column:
    full = lambda c: F.coalesce(c, F.lit("")) != ""
    return (F.lower(F.trim(F.coalesce(status, F.lit("")))) == "completed") | F.coalesce(recording, F.lit(False)) | full(transcript) | full(summary) | score.isNotNull()


def charges(interviews: DataFrame, candidates: DataFrame, jobs: DataFrame, users: DataFrame, ledger: DataFrame) -> DataFrame:
    """(user_id, agency_id, interview_id, balance_after): one charge for each billable interview not yet in the ledger.

    The candidate's agency, else its job's, pays through its administrator of the smallest id, whose balance
    never falls below 0; running it again on a ledger that holds its rows gives none.
    """
    of_job = jobs.select(F.col("id").alias("job_id"), F.col("agency_id").alias("_job_agency"))
    who = candidates.join(of_job, "job_id", "left").select(F.col("id").alias("candidate_id"), F.coalesce("agency_id", "_job_agency").alias("agency_id"))
    due = interviews.filter("is_billable").select(F.col("id").alias("interview_id"), "candidate_id").join(who, "candidate_id").filter("agency_id is not null")
    admins = users.filter("role = 'admin'").groupBy("agency_id").agg(F.min(F.struct("id", "wallet_balance")).alias("a"))
    priced = due.join(admins.select("agency_id", F.col("a.id").alias("user_id"), F.coalesce("a.wallet_balance", F.lit(0)).alias("_balance")), "agency_id")
    keyed = priced.withColumn("description", F.concat(F.lit(BILLED), F.col("interview_id").cast("string")))
    fresh = keyed.join(ledger.select("user_id", "description"), ["user_id", "description"], "left_anti").dropDuplicates(["user_id", "description"])
    part = F.left(F.col("interview_id").cast("string"), F.lit(4))  # ids sort as text, so parts are in order
    nth = running(fresh.withColumn("_part", part).withColumn("_one", F.lit(1)), ["user_id"], "_part", ["interview_id"], "_one", "_nth")
    return nth.select("user_id", "agency_id", "interview_id", F.greatest(F.col("_balance") - F.col("_nth"), F.lit(0)).cast("int").alias("balance_after"))


def running(df: DataFrame, keys: Sequence[str], part: str, order: Sequence[str], amount: str, name: str) -> DataFrame:
    """The frame with a running sum of ``amount`` in order within each key, in two steps.

    ``part`` goes up with the order: sums of parts run over few rows, and rows only within their part, so a key that has a third
    of all rows is spread.
    """
    parts = df.groupBy(*keys, part).agg(F.sum(amount).alias("_n"))
    earlier = F.sum("_n").over(W.partitionBy(*keys).orderBy(part).rowsBetween(W.unboundedPreceding, -1))
    placed = parts.select(*keys, part, F.coalesce(earlier, F.lit(0)).alias("_before"))
    within = F.sum(amount).over(W.partitionBy(*keys, part).orderBy(*order).rowsBetween(W.unboundedPreceding, 0))
    rows = df.withColumn("_within", within).join(placed, [*keys, part])
    return rows.withColumn(name, F.col("_before") + F.col("_within")).drop("_before", "_within")


def discounted(price: Column, kind: Column, value: Column) -> Column:
    off = F.when(kind == "percentage", price * value / 100).when(kind == "amount", value).otherwise(0.0)
    return F.round(F.greatest(price - F.coalesce(off, F.lit(0.0)), F.lit(0.0)), 2)


def upserted(old: DataFrame, new: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Rows of both frames, the last by ``order`` of each key; new rows win over old ones."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    w = W.partitionBy(*keys).orderBy(F.col("_new").desc(), *[F.col(o).desc() for o in order])
    return both.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn", "_new")


def consumed(usage: DataFrame, limits: dict[str, int | None], anchor: str, days: int = CYCLE_DAYS) -> DataFrame:
    """Usage events with cycle, accepted and used_after: an event over the limit of its cycle is refused and uses nothing."""
    at = F.lit(anchor).cast("timestamp")
    cycle = F.floor((F.unix_timestamp("ts") - F.unix_timestamp(at)) / (days * 86400)).cast("int")

    rows, keys = usage.withColumn("cycle", cycle), ["agency_id", "feature", "cycle"]
    limit = F.create_map(*[F.lit(x) for k, n in limits.items() if n is not None for x in (k, n)]) if any(n is not None for n in limits.values()) else None
    limited = rows.withColumn("_limit", F.try_element_at(limit, F.col("feature"))) if limit is not None else rows.withColumn("_limit", F.lit(None).cast("int"))
    free = limited.filter("_limit is null").drop("_limit").withColumn("_day", F.date_trunc("day", "ts"))
    open_ = running(free, keys, "_day", ["ts", "id"], "amount", "used_after").drop("_day").withColumn("accepted", F.lit(True))
    dealt = limited.filter("_limit is not null").repartition(*keys).sortWithinPartitions(*keys, "ts", "id")
    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in limited.schema.fields], "accepted boolean, used_after long"])
    held = dealt.mapInArrow(_within_limits(keys), schema).drop("_limit")
    return held.unionByName(open_.withColumn("used_after", F.col("used_after").cast("long")))


def _within_limits(keys: Sequence[str]):
    """Streams over sorted uses: runs of a key are taken whole by prefix sums, and searched on only behind a refusal."""

    def taken(amount: np.ndarray, used: int, limit: int) -> tuple[np.ndarray, np.ndarray]:
        ok, at = np.zeros(len(amount), bool), 0
        left = limit - used
        while at < len(amount):
            sums = np.cumsum(amount[at:])
            n = int(np.searchsorted(sums, left, side="right")) if (amount[at:] >= 0).all() else int(amount[at] <= left)
            ok[at : at + n] = True
            left -= int(sums[n - 1]) if n else 0
            more = np.flatnonzero(amount[at + n :] <= left)
            if not len(more):
                break
            at += n + int(more[0])
        return ok, used + np.cumsum(np.where(ok, amount, 0))

    def run(batches):
        key, used = None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            amount, limit = (np.asarray(batch.column(x), dtype=np.int64) for x in ("amount", "_limit"))
            own = list(zip(*(batch.column(k).to_pylist() for k in keys), strict=True))
            edges = [0, *(i for i in range(1, len(own)) if own[i] != own[i - 1]), len(own)]
            ok, after = np.zeros(len(own), bool), np.zeros(len(own), np.int64)
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                if own[a] != key:
                    key, used = own[a], 0
                ok[a:b], after[a:b] = taken(amount[a:b], used, int(limit[a]))
                used = int(after[b - 1])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ok), pa.array(after)], [*batch.schema.names, "accepted", "used_after"])

    return run


def first_within(events: DataFrame, keys: Sequence[str], seconds: int, at: str = "ts", order: str = "id") -> DataFrame:
    """Events that come first, or at least ``seconds`` after the last one that was kept, of their key.

    Rows are dealt by key and sorted by Spark, then streamed: a task holds one time and one batch, however long a key's rows are, and within a
    batch it jumps from one kept event to the next, so only these cost a step.
    """
    timed = events.withColumn("_t", F.unix_micros(F.col(at).cast("timestamp")))
    dealt = timed.repartition(*keys).sortWithinPartitions(*keys, "_t", order)
    # where a key begins, found by Spark's own comparison of keys
    key = F.xxhash64(*keys, *[F.col(k).isNull() for k in keys])
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in events.schema.fields)
    columns, window = events.columns, seconds * 1_000_000

    def run(batches):
        own, last = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            keyed, times = np.asarray(batch.column("_key")), np.asarray(batch.column("_t").fill_null(np.iinfo(np.int64).min))
            edges = np.concatenate([[0], np.flatnonzero(np.diff(keyed)) + 1, [len(keyed)]]).tolist()
            kept = []
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                if keyed[a] != own:
                    own, last = keyed[a], None
                i = a if last is None else a + int(np.searchsorted(times[a:b], last + window))
                while i < b:
                    kept.append(i)
                    last = int(times[i])
                    i = max(i + 1, a + int(np.searchsorted(times[a:b], last + window)))
            yield batch.select(columns).take(pa.array(kept, pa.int64()))

    return dealt.withColumn("_key", key).mapInArrow(run, schema)


def template_choice(wanted: DataFrame, templates: DataFrame) -> DataFrame:
    """(agency_id, status, template_id): the agency's selected template, else any of its own, else a global one."""
    w = wanted.alias("w").join(templates.filter("is_active").alias("t"), (F.col("w.status") == F.col("t.status")) & F.col("t.agency_id").eqNullSafe(F.col("w.agency_id")))
    general = templates.filter("is_active and agency_id is null").alias("t")
    g = wanted.alias("w").join(general, F.col("w.status") == F.col("t.status"))
    pick = lambda df, rank: df.select("w.agency_id", "w.status", "t.id", "t.is_selected", "t.is_default", "t.updated_at", "t.created_at", F.lit(rank).alias("rank"))
    both = pick(w, 0).union(pick(g, 1))
    order = [F.col("rank"), F.col("is_selected").desc(), F.col("is_default").desc(), F.col("updated_at").desc_nulls_last(), F.col("created_at").desc(), F.col("id")]
    one = F.row_number().over(W.partitionBy("agency_id", "status").orderBy(*order))
    return both.withColumn("_rn", one).filter("_rn = 1").select("agency_id", "status", F.col("id").alias("template_id"))


def usage_log(uses: DataFrame, per: str = "day") -> DataFrame:
    """(id, agency_id, feature, before, after): each use with its counter before and after it.

    Uses are summed by day first; the days' running sums and those within a day make the counter, so no task holds
    all uses of a busy agency.
    """
    rows = running(uses.withColumn("_day", F.date_trunc(per, "ts")), ["agency_id", "feature"], "_day", ["ts", "id"], "amount", "after")
    return rows.select("id", "agency_id", "feature", (F.col("after") - F.col("amount")).cast("long").alias("before"), F.col("after").cast("long").alias("after"))
