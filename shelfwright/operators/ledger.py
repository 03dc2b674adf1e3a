"""An append-only log of review events: deduplication, snapshots, conflicts, content digests and a hash chain."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwright.operators.ordered import with_previous


def deliveries(events: DataFrame) -> DataFrame:
    """The first delivery of each event_id (ties by content), with the number of deliveries; events without an id are left out."""
    rest = [c for c in events.columns if c not in ("event_id", "received_at")]
    first = events.filter("event_id is not null").groupBy("event_id").agg(F.min(F.struct("received_at", *rest)).alias("f"), F.count("*").alias("n_deliveries"))
    return first.select("event_id", "f.*", "n_deliveries")


def snapshot(events: DataFrame) -> DataFrame:
    """(target, record_id, label, status, n_events): the state of each key; conflict where corrections disagree, active with one label, else audit_only."""
    d = deliveries(events).filter("record_id is not null and target is not null")
    s = d.groupBy("target", "record_id").agg(
        F.array_sort(F.collect_set(F.when(F.col("action") == "correct", F.col("label")))).alias("labels"), F.max(F.struct("occurred_at", "event_id", "action")).alias("last"), F.count("*").alias("n_events")
    )
    status = F.when(F.size("labels") > 1, "conflict").when(F.size("labels") == 1, "active").otherwise("audit_only")
    return s.select("target", "record_id", F.when(F.size("labels") == 1, F.col("labels")[0]).alias("label"), status.alias("status"), F.col("last.action").alias("last_action"), "n_events")


def alias_conflicts(events: DataFrame) -> DataFrame:
    """(target, group_id, n_labels, n_records): groups whose records were corrected to different labels."""
    d = deliveries(events).filter("action = 'correct' and label is not null and group_id is not null")
    return d.groupBy("target", "group_id").agg(F.count_distinct("label").alias("n_labels"), F.count_distinct("record_id").alias("n_records")).filter("n_labels > 1")


def eligibility(events: DataFrame, now: DataFrame) -> DataFrame:
    """(event_id, role): the most protected split an event touches by record or by group: test, validation, train or unknown."""
    d = deliveries(events).select("event_id", F.lower(F.trim("record_id")).alias("record_id"), F.lower(F.trim("group_id")).alias("group_id"))
    rank = F.when(F.col("split") == "test", 3).when(F.col("split") == "validation", 2).when(F.col("split") == "train", 1).otherwise(0)
    ranked = now.withColumn("r", rank)
    by_record = d.join(ranked.select("record_id", "r"), "record_id").select("event_id", "r")
    by_group = d.join(ranked.filter("group_id is not null").groupBy("group_id").agg(F.max("r").alias("r")), "group_id").select("event_id", "r")
    best = by_record.unionByName(by_group).groupBy("event_id").agg(F.max("r").alias("r"))
    role = F.when(F.col("r") == 3, "test").when(F.col("r") == 2, "validation").when(F.col("r") == 1, "train").otherwise("unknown")
    return d.select("event_id").join(best, "event_id", "left").select("event_id", role.alias("role"))


def event_digests(events: DataFrame) -> DataFrame:
    """(event_id, target, digest, previous): digests of the id, target, record, action and label of each target's events in order, with the digest of the one before.

    No chain: a digest doesn't depend on the events before it; see hash_chain().
    """
    d = deliveries(events)
    digest = F.sha2(F.concat_ws("|", *[F.coalesce(F.col(c), F.lit("")) for c in ("event_id", "target", "record_id", "action", "label")]), 256)
    chain = d.withColumn("digest", digest).select("event_id", "target", "digest", "occurred_at")
    return with_previous(chain, ["target"], ["occurred_at", "event_id"], "digest", "previous").select("event_id", "target", "digest", "previous")


def hash_chain(events: DataFrame) -> DataFrame:
    """(event_id, target, seq, previous, digest): each target's events as they were received, chained by digests from 64 zeros on.

    A digest covers the event's place, the digest before it and all columns of its first delivery, so a changed, removed or moved event
    alters every later digest of its target. Columns are digested in parallel; the chain itself is sequential, and only digests are folded,
    row by row, in one sorted task a target.
    """
    d = deliveries(events)
    kinds = dict(d.dtypes)
    plain = lambda c: F.unix_micros(F.col(c).cast("timestamp")).cast("string") if kinds[c].startswith("timestamp") else F.col(c).cast("string")
    # lengths keep values apart; NULL has none
    content = F.sha2(F.concat_ws(",", *[F.coalesce(F.concat(F.length(plain(c)).cast("string"), F.lit(":"), plain(c)), F.lit("-")) for c in sorted(events.columns)]), 256)
    rows = d.select("event_id", "target", "received_at", content.alias("content")).repartition("target").sortWithinPartitions("target", "received_at", "event_id")

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, seq, digest = "", 0, ""
        for batch in batches:
            out = []
            for target, content in zip(batch.column(1).to_pylist(), batch.column(3).to_pylist(), strict=True):
                if not seq or target != last:
                    last, seq, digest = target, 0, "0" * 64
                seq, previous = seq + 1, digest
                digest = hashlib.sha256(f"{seq}|{previous}|{content}".encode()).hexdigest()
                out.append((seq, previous, digest))
            cols = list(zip(*out, strict=True)) or [()] * 3
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(list(c), t) for c, t in zip(cols, (pa.int64(), pa.string(), pa.string()), strict=True))], names=["event_id", "target", "seq", "previous", "digest"])

    return rows.mapInArrow(fold, "event_id string, target string, seq long, previous string, digest string")


def verify_chain(events: DataFrame, chain: DataFrame) -> DataFrame:
    """(event_id, target, seq, valid): whether each link of a stored chain (see hash_chain) is what the events give and follows the link before it.

    An event without a link and a link without an event are invalid; a changed event breaks its own link and, through the digests, all later ones.
    """
    fresh = hash_chain(events).select("event_id", F.col("target").alias("t"), F.col("seq").alias("s"), F.col("previous").alias("p"), F.col("digest").alias("d"))
    j = chain.join(fresh, "event_id", "full")
    same = F.col("target").eqNullSafe(F.col("t")) & (F.col("seq") == F.col("s")) & (F.col("previous") == F.col("p")) & (F.col("digest") == F.col("d"))
    return j.select("event_id", F.coalesce("target", "t").alias("target"), F.coalesce("seq", "s").alias("seq"), F.coalesce(same, F.lit(False)).alias("valid"))


def states(events: DataFrame) -> DataFrame:
    """(target, record_id, state, n_events): what the reviews of a record amount to; disagreement goes before a hold, a hold before a decision."""
    d = deliveries(events).filter("record_id is not null and target is not null")
    held = F.coalesce(F.array_contains(F.split("flags", ";"), "second_look"), F.lit(False))
    s = d.groupBy("target", F.lower(F.trim("record_id")).alias("record_id")).agg(
        F.count_distinct(F.when(F.col("action") == "correct", F.col("label"))).alias("labels"), F.max(F.col("action") == "reject").alias("rejected"), F.max(held).alias("held"), F.count("*").alias("n_events")
    )
    one = F.col("labels") == 1
    state = F.when(F.col("labels") > 1, "label_conflict").when(one & F.col("rejected"), "corrected_and_rejected").when(F.col("held"), "held").when(one, "corrected").when(F.col("rejected"), "rejected").otherwise("approved")
    return s.select("target", "record_id", state.alias("state"), "n_events")
