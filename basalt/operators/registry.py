"""Service registry: instances from JSON, snapshots, ordered application of deltas, and the addresses of a service.

Instances are rows (app, id, host, secure_port, port, status, metadata) with entry_seq and arrival_seq, their places in
what the server sent.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: In the order in which instances are preferred.
STATUSES = ("UP", "STARTING", "DOWN", "OUT_OF_SERVICE", "UNKNOWN")

PORT = "struct<`$`: int, `@enabled`: string>"
PAYLOAD = f"applications struct<versions__delta: string, apps__hashcode: string, application: array<struct<name: string, instance: array<struct<instanceId: string, hostName: string, ipAddr: string, status: string, overriddenStatus: string, port: {PORT}, securePort: {PORT}, metadata: map<string, variant>, actionType: string>>>>>"


def status(text: Column) -> Column:
    """A known status, else UNKNOWN."""
    return F.when(F.upper(text).isin(*STATUSES), F.upper(text)).otherwise("UNKNOWN")


def rank(status_: Column) -> Column:
    return F.coalesce(F.array_position(F.array(*(F.lit(s) for s in STATUSES)), status_) - 1, F.lit(len(STATUSES) - 1)).cast("int")


def instances(payloads: DataFrame, text: str = "payload", prefer_address: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """The instances of JSON payloads. Unnamed applications and instances without a host are left out; a port counts only if enabled, else -1.

    Metadata holds strings, numbers and booleans as text, without nulls, arrays and objects; the effective status, which
    an override replaces, is only added to it.
    """
    parsed = payloads.select(*keep, F.from_json(text, PAYLOAD).alias("p"))
    apps = parsed.select(*keep, F.col("p.applications.apps__hashcode").alias("stamp"), F.posexplode("p.applications.application").alias("entry_seq", "a"))
    each = apps.where("a.name is not null").select(*keep, "stamp", "entry_seq", F.col("a.name").alias("app"), F.posexplode("a.instance").alias("arrival_seq", "i"))
    first, second = ("i.ipAddr", "i.hostName") if prefer_address else ("i.hostName", "i.ipAddr")
    port = lambda c: F.when(F.lower(F.col(f"{c}.`@enabled`")) == "true", F.coalesce(F.col(f"{c}.`$`"), F.lit(-1))).otherwise(-1)
    overridden = F.when(F.coalesce(F.col("i.overriddenStatus"), F.lit("UNKNOWN")) != "UNKNOWN", F.col("i.overriddenStatus")).otherwise(F.col("i.status"))
    scalar = lambda v: v.isNotNull() & ~F.is_variant_null(v) & ~F.schema_of_variant(v).rlike("^(ARRAY|OBJECT)")
    texts = F.transform_values(F.map_filter("i.metadata", lambda k, v: scalar(v)), lambda k, v: v.cast("string"))
    metadata = F.coalesce(texts, F.create_map().cast("map<string,string>"))
    return each.select(
        *keep, "stamp", "entry_seq", "arrival_seq", "app", F.coalesce("i.instanceId", first).alias("id"), F.coalesce(first, second).alias("host"), port("i.securePort").alias("secure_port"), port("i.port").alias("port"),
        status(F.col("i.status")).alias("status"), F.map_zip_with(metadata, F.create_map(F.lit("status"), status(overridden)), lambda k, a, b: F.coalesce(b, a)).alias("metadata"), F.upper("i.actionType").alias("action"),
    ).where("host is not null")


def snapshot(found: DataFrame) -> DataFrame:
    """One row for each app and id: of one entry the best status wins, of several entries the first. seq orders an app's instances."""
    best = Window.partitionBy("app", "id").orderBy("entry_seq", rank(F.col("status")), "arrival_seq")
    order = Window.partitionBy("app").orderBy("entry_seq", rank(F.col("status")), "arrival_seq")
    kept = found.withColumn("k_", F.row_number().over(best)).where("k_ = 1").drop("k_")
    return kept.withColumn("seq", F.row_number().over(order)).drop("entry_seq", "arrival_seq")


def ordered(found: DataFrame) -> DataFrame:
    """Instances with place: by status, ties as they arrived."""
    window = Window.partitionBy("app").orderBy(rank(F.col("status")), "arrival_seq")
    return found.withColumn("place", F.row_number().over(window))


PHASES = {"DELETED": 0, "MODIFIED": 1, "ADDED": 2}


class Instances:
    """The instances of one application while deltas are applied."""

    def __init__(self, rows: dict[str, str] | None = None):
        self.rows = dict(rows or {})

    def apply(self, changes: Iterator[tuple[str, str, str]]) -> None:
        """Applies (action, id, status) changes that are in the order of phases: a MODIFIED one only while there are instances, an ADDED one in place of an equal id."""
        sort = False
        for action, name, state in changes:
            if action == "DELETED":
                self.rows.pop(name, None)
            elif action == "ADDED" or (action == "MODIFIED" and self.rows):
                self.rows.pop(name, None)
                self.rows[name] = state
                sort = True
        if sort:
            place = {s: k for k, s in enumerate(STATUSES)}
            self.rows = dict(sorted(self.rows.items(), key=lambda x: place.get(x[1], len(STATUSES))))


def apply_deltas(changes: DataFrame) -> DataFrame:
    """(app, id, status, place) after all deltas. changes: app, delta, seq, action, id, status.

    Within a delta deletions go first, then modifications, then additions; unknown actions are ignored. Rows are dealt
    by app and sorted, and stream through with one application's instances in memory, however many deltas it has.
    """
    phase = F.create_map(*(F.lit(x) for pair in PHASES.items() for x in pair))[F.col("action")]
    rows = changes.withColumn("phase", phase).where("phase is not null").select("app", "delta", "phase", "seq", "action", "id", "status")
    dealt = rows.repartition("app").sortWithinPartitions("app", "delta", "phase", "seq")

    def folded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now: tuple | None = None
        held, pending = Instances(), []

        def result(app: str) -> pd.DataFrame:
            n = len(held.rows)
            text = {"app": [app] * n, "id": [*held.rows], "status": [*held.rows.values()]}
            return pd.DataFrame(text, dtype=object).assign(place=pd.array(range(1, n + 1), dtype="int32"))

        for batch in batches:
            for app, delta, action, name, state in zip(*(batch[c] for c in ("app", "delta", "action", "id", "status")), strict=True):
                if now != (app, delta):
                    held.apply(iter(pending))
                    pending = []
                    if now and now[0] != app:
                        yield result(now[0])
                        held = Instances()
                    now = (app, delta)
                pending.append((action, name, state))
        if now:
            held.apply(iter(pending))
            yield result(now[0])

    return dealt.mapInPandas(folded, "app string, id string, status string, place int")


def deduplicated(deltas: DataFrame, stamp: str = "stamp", order: str = "delta", by: Sequence[str] = ()) -> DataFrame:
    """Deltas (a row each) whose stamp differs from the one before, of the same server where `by` names it. The first stays unless its stamp is null.

    Without `by` the deltas are dealt to sorted ranges, of which only the last stamp (a row for each range) meets the next.
    """
    fresh = lambda before: ~F.col(stamp).eqNullSafe(before)
    if by:
        return deltas.withColumn("before_", F.lag(stamp).over(Window.partitionBy(*by).orderBy(order))).where(fresh(F.col("before_"))).drop("before_")
    ranged = deltas.repartitionByRange(order).sortWithinPartitions(order).withColumn("part_", F.spark_partition_id())
    inner = Window.partitionBy("part_").orderBy(order)
    placed = ranged.withColumn("before_", F.lag(stamp).over(inner)).withColumn("k_", F.row_number().over(inner))
    last = ranged.groupBy("part_").agg(F.max_by(F.struct(stamp), order).alias("last_"))
    ends = last.select("part_", F.lag(F.col("last_")[stamp]).over(Window.orderBy("part_")).alias("end_"))
    whole = placed.join(F.broadcast(ends), "part_")
    return whole.where(fresh(F.when(F.col("k_") == 1, F.col("end_")).otherwise(F.col("before_")))).select(*deltas.columns)


class Poller:
    """What a registry's client asks for next: everything at first, changes from then on, and everything again after changes were refused.

    fetch_all() gives the instances, fetch_changes() a table of changes or None if the server refuses them.
    """

    def __init__(self, fetch_all: Callable[[], DataFrame], fetch_changes: Callable[[], DataFrame | None], changes: bool = True):
        self.fetch_all, self.fetch_changes, self.changes, self.full_next = fetch_all, fetch_changes, changes, True

    def step(self) -> tuple[str, DataFrame | None]:
        """("snapshot", instances), ("delta", changes) or ("refused", None); the caller applies it and waits for the next turn."""
        if self.full_next:
            found = self.fetch_all()
            self.full_next = not self.changes
            return "snapshot", found
        found = self.fetch_changes()
        if found is None:
            self.full_next = True
            return "refused", None
        return "delta", found


def replace_snapshot(spark: SparkSession, fresh: DataFrame, path: str, stamp: str) -> bool:
    """Writes a snapshot under its stamp and points readers to it; an equal stamp changes nothing. Whether it was written."""
    pointer = f"{path}/current"
    try:
        if spark.read.text(pointer).first()[0] == stamp:
            return False
    except Exception as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
    fresh.write.mode("overwrite").parquet(f"{path}/stamp={stamp}")
    spark.createDataFrame([(stamp,)], "value string").coalesce(1).write.mode("overwrite").text(pointer)
    return True


def current_snapshot(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/stamp={spark.read.text(f'{path}/current').first()[0]}")


def lookup(found: DataFrame, name: str) -> DataFrame:
    """Instances of an application by name in upper case, as the server stores it; names stored otherwise never match."""
    return found.where(F.col("app") == name.upper())


def uris(found: DataFrame, by: tuple[str, ...] = ("app", "id"), default: str | None = None) -> DataFrame:
    """by, n and uri: https first, then http, of ports that are enabled; the caller's default address comes last."""
    port = lambda scheme, c, usual: F.when(F.col(c) >= 0, F.concat(F.lit(f"{scheme}://"), F.col("host"), F.when(F.col(c) == usual, "").otherwise(F.concat(F.lit(":"), F.col(c).cast("string")))))
    each = F.array_compact(F.array(port("https", "secure_port", 443), port("http", "port", 80)))
    if default is not None:
        each = F.concat(F.array_remove(F.array_distinct(each), default), F.array(F.lit(default)))
    return found.select(*by, F.posexplode(each).alias("n", "uri"))
