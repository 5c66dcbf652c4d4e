"""Queue tables as data: claims, grouped read modes, outcomes, metrics, change pages. A queue is a DataFrame
(id, payload, status, visible_at, attempt_count, max_attempts, created_at, ...); each function returns the rows of its result."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.spread import running, unused
from ..operators.state import dedupe_capped

STATUSES = ("pending", "processing", "completed", "dead")


def claimable(queue: DataFrame, now: Column) -> DataFrame:
    """Pending rows that are visible, and processing ones whose time ran out, with attempts left."""
    return queue.where(F.col("status").isin("pending", "processing") & (F.col("visible_at") <= now) & (F.col("attempt_count") < F.col("max_attempts")))


def claim(queue: DataFrame, now: Column, batch: int = 10, order: tuple[str, ...] = ("created_at", "id")) -> DataFrame:
    """The next batch: a top-k, so each task sends `batch` rows at most."""
    return claimable(queue, now).orderBy(*order).limit(batch)


def fifo(messages: DataFrame, mode: str, group: str, order: str, batch: int) -> DataFrame:
    """standard: by order; grouped: the oldest group's messages first, group by group; round-robin: one of each group in turn;
    head: only the first of each group."""
    w = Window.partitionBy(group).orderBy(order)
    if mode == "standard":
        return messages.orderBy(order).limit(batch)
    if mode == "head":
        # a minimum is combined before the shuffle, a rank isn't
        return messages.groupBy(F.col(group).alias("_g")).agg(F.min_by(F.struct(*messages.columns), order).alias("_r")).select("_r.*").orderBy(order).limit(batch)
    ranked = messages.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= batch)
    if mode == "round-robin":
        return ranked.orderBy("_rank", order).limit(batch).drop("_rank")
    if mode != "grouped":
        raise ValueError(f"no read mode {mode!r}")
    firsts = ranked.withColumn("_first", F.min(order).over(Window.partitionBy(group)))
    return firsts.orderBy("_first", order).limit(batch).drop("_rank", "_first")


def settle(queue: DataFrame, outcomes: DataFrame, now: Column, retry_after: str = "INTERVAL 30 SECONDS") -> DataFrame:
    """The queue after outcomes(id, ok): done rows completed, failed ones pending again later, or dead after their last attempt."""
    o = outcomes.select(F.col("id").alias("_id"), "ok")
    done, failed = F.coalesce(F.col("ok"), F.lit(False)), F.col("ok").isNotNull() & ~F.coalesce(F.col("ok"), F.lit(False))
    attempts = F.col("attempt_count") + F.col("ok").isNotNull().cast("int")
    status = F.when(done, "completed").when(failed & (attempts >= F.col("max_attempts")), "dead").when(failed, "pending").otherwise(F.col("status"))
    joined = queue.join(o, queue.id == F.col("_id"), "left")
    return joined.withColumns({"status": status, "attempt_count": attempts, "visible_at": F.when(failed, now + F.expr(retry_after)).otherwise(F.col("visible_at"))}).select(*queue.columns)


def metrics(queue: DataFrame) -> DataFrame:
    return queue.groupBy().agg(*(F.count_if(F.col("status") == s).alias(s) for s in STATUSES), F.count(F.lit(1)).alias("total"))


def requeue_dead(queue: DataFrame, now: Column) -> DataFrame:
    dead = F.col("status") == "dead"
    return queue.withColumns({"visible_at": F.when(dead, now).otherwise(F.col("visible_at")), "attempt_count": F.when(dead, 0).otherwise(F.col("attempt_count")), "status": F.when(dead, "pending").otherwise(F.col("status"))})


def archive(queue: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(what stays, what goes to the archive)."""
    done = F.col("status") == "completed"
    return queue.where(~done), queue.where(done)


def change_page(table: DataFrame, ts: str, seq: str, cursor: tuple | None, n: int) -> DataFrame:
    """The next n changes after a (ts, seq) cursor: a filter and a top-k."""
    rows = table if cursor is None else table.where((F.col(ts) > F.lit(cursor[0])) | ((F.col(ts) == F.lit(cursor[0])) & (F.col(seq) > F.lit(cursor[1]))))
    return rows.orderBy(ts, seq).limit(n)


def publish(queue: DataFrame, payloads: DataFrame, now: Column, delay_s: int = 0, max_attempts: int = 3, group: Column | None = None) -> DataFrame:
    """The queue with payloads(id, payload) appended; `group` goes to a column of that name, for the read modes of fifo()."""
    new = payloads.select("id", "payload", F.lit("pending").alias("status"), (now + F.expr(f"INTERVAL {int(delay_s)} SECONDS")).alias("visible_at"), F.lit(0).alias("attempt_count"), F.lit(max_attempts).alias("max_attempts"), now.alias("created_at"), *([] if group is None else [group.alias("group")]))
    return queue.unionByName(new, allowMissingColumns=True)


def purge(queue: DataFrame) -> DataFrame:
    """The queue without the messages that wait; what is being worked on, or is over, stays."""
    return queue.where(F.col("status") != "pending")


def drop_repeated(changes: DataFrame, key: str, order: str, feed: str, most: int = 10_000) -> DataFrame:
    """Changes of each feed that are not among the last `most` ones let through: polled pages overlap."""
    return dedupe_capped(changes, key, order, feed, most)


def pending(log: DataFrame, entry: str, seq: str, time: str, kind: str) -> DataFrame:
    """What a log of a group's deliveries, claims and acknowledgements (`kind`: deliver, claim, ack) leaves pending: entry, deliveries (claims too), delivered_at
    (the latest), first_seq. An acknowledgement ends an entry; a later delivery opens it again, claims of what isn't open count for nothing."""
    tag = unused(log, "_l")
    marks = {f"{tag}{k}": ("max", F.when(F.col(kind) == k, F.col(seq))) for k in ("deliver", "ack")}
    rows = running(log.where(F.col(entry).isNotNull()), seq, marks, [entry])
    acked, opened = F.coalesce(f"{tag}ack", F.lit(-1)), F.coalesce(f"{tag}deliver", F.lit(-1))
    counted = F.col(kind).isin("deliver", "claim") & (opened > acked)
    spans = rows.withColumn(f"{tag}a", acked).groupBy(F.col(entry).alias("entry"), f"{tag}a").agg(
        F.count_if(counted).alias("deliveries"), F.max(F.when(counted, F.col(time))).alias("delivered_at"), F.min(F.when(counted, F.col(seq))).alias("first_seq")
    )
    last = spans.groupBy("entry").agg(F.max_by(F.struct("deliveries", "delivered_at", "first_seq"), f"{tag}a").alias("r"))
    return last.select("entry", "r.*").where("deliveries > 0")


def recover(waiting: DataFrame, now: Column, min_idle_us: int, max_deliveries: int | None = None, count: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(entries claimed anew, dead letters) of pending(): those idle for min_idle_us, the `count` first by first_seq if it is given. A claim is a
    delivery more; with max_deliveries those that have come to it are dead letters."""
    idle = waiting.where(now - F.col("delivered_at") >= min_idle_us)
    idle = idle if count is None else idle.orderBy("first_seq").limit(count)
    claimed = idle.select("entry", (F.col("deliveries") + 1).alias("deliveries"), (now - F.col("delivered_at")).alias("idle_us"), "first_seq")
    if max_deliveries is None:
        return claimed, claimed.limit(0)
    return claimed.where(F.col("deliveries") < max_deliveries), claimed.where(F.col("deliveries") >= max_deliveries)
