"""Versioned state history as window replays.

Every replay partitions by the entity name and orders by ``(ts, seq)``; Spark
sorts each partition once and evaluates all windows of the same spec in one
pass (spilling to disk when a name's history is large).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pipework.functions import time as T
from pipework.functions.scalars import key_leaf, key_name
from pipework.operators.asof import asof_join
from pipework.operators.scan import chunked_scan, hour_chunk, ordered_scan, split_heavy
from pipework.session import written

# --- fixed values: messages and states -----------------------------------
ROLLBACK_MISSING = "version %d does not exist"
FLOW_NOT_FOUND = 'flow "%s" not found'
BAD_POINTER = "invalid active version"
SPEC_MISSING = 'spec missing for "%s" version %s'
NAME_REQUIRED = "flow name is required"
MAX_VERSION = "18446744073709551615"   # unsigned 64 bits
STATUS_STATE = "FLOW_STATE_DEPLOYING"
STATUS_MESSAGE = "flow runtime created"
# -------------------------------------------------------------------------

ORDER = ("ts", "seq")



def replay(oplog: DataFrame, key: str = "name", order=ORDER, chunk: Column | None = None,
           heavy_rows: int | None = None) -> DataFrame:
    """D1 per-op replay under the documented rule: inside a delete-epoch each
    put takes the next integer and versions are immutable; a rollback is valid
    iff ``1 ≤ v ≤ puts so far``; a delete starts a new epoch.

    Adds ``epoch``, ``puts`` (puts so far in the epoch), ``put_version``
    (puts) and ``valid`` (rollbacks). The pointer is derived from these by
    aggregation (:func:`final_pointer`).

    Ordinary names are replayed by one window each; names of over ``heavy_rows``
    ops by :func:`_chunked_replay`, with the same result."""
    light, heavy = split_heavy(oplog, [key], heavy_rows)
    run = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    puts = F.sum((F.col("op") == "put").cast("long")).over(run)
    x = light.withColumns({"epoch": F.sum((F.col("op") == "delete").cast("long")).over(run), "_p": puts})
    # puts of the epoch = puts so far less those up to the last delete
    gone = F.last(F.when(F.col("op") == "delete", F.col("_p")), ignorenulls=True).over(run)
    x = _judged(x.withColumn("puts", F.col("_p") - F.coalesce(gone, F.lit(0))).drop("_p"))
    if heavy is None:
        return x
    return x.unionByName(_chunked_replay(heavy, key, order, chunk).select(*x.columns))


def _judged(y: DataFrame) -> DataFrame:
    valid = (F.col("op") == "rollback") & (F.col("version") >= 1) & (F.col("version") <= F.col("puts"))
    return (y.withColumn("put_version", F.when(F.col("op") == "put", F.col("puts")))
             .withColumn("valid", F.when(F.col("op") == "rollback", F.coalesce(valid, F.lit(False)))))


def _chunked_replay(oplog: DataFrame, key: str, order, chunk: Column | None) -> DataFrame:
    """The replay of heavy names. A name is split into time chunks. Running deletes and
    puts-since-the-last-delete are computed per ``(name, chunk)`` and carried
    across chunks through a small per-chunk table (a segmented prefix sum),
    so a hot name is spread over its chunks instead of one task; the big data
    is shuffled once, by ``(name, chunk)``."""
    keys, order = [key], list(order)
    ch = chunk if chunk is not None else hour_chunk(order[0])
    is_put = (F.col("op") == "put").cast("long")
    is_del = (F.col("op") == "delete").cast("long")
    ordc = F.struct(*order)

    x = oplog.withColumn("_chunk", ch)
    run = Window.partitionBy(*keys, "_chunk").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    loc = (x.withColumn("_lE", F.sum(is_del).over(run))
            .withColumn("_lP", F.sum(is_put).over(run))
            .withColumn("_lD", F.last(F.when(F.col("op") == "delete", F.col("_lP")), ignorenulls=True).over(run)))
    # per chunk: deletes, puts, and puts after its last delete (null if none)
    summ = loc.groupBy(*keys, "_chunk").agg(
        F.max_by("_lE", ordc).alias("_cE"), F.max_by("_lP", ordc).alias("_cP"),
        F.max_by(F.col("_lP") - F.col("_lD"), ordc).alias("_cAfter"))
    before = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    s2 = (summ.withColumn("_pE", F.coalesce(F.sum("_cE").over(before), F.lit(0)))
              .withColumn("_g", F.coalesce(F.sum((F.col("_cE") > 0).cast("long")).over(before), F.lit(0))))
    # puts since the last delete before a chunk = puts after the delete in the
    # last chunk holding one + all puts of the chunks since then
    seg = Window.partitionBy(*keys, "_g").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    base = F.last(F.when(F.col("_cE") > 0, F.col("_cAfter")), ignorenulls=True).over(before)
    carry = (s2.withColumn("_carry", F.coalesce(base, F.lit(0)) + F.coalesce(F.sum("_cP").over(seg), F.lit(0)))
               .select(*keys, "_chunk", "_pE", "_carry"))
    carry = carry.select(F.col(key).alias("_key"), F.col("_chunk").alias("_at"), "_pE", "_carry")
    y = loc.join(carry, F.col(key).eqNullSafe(F.col("_key")) & F.col("_chunk").eqNullSafe(F.col("_at")), "inner").drop("_key", "_at")
    puts = F.when(F.col("_lD").isNotNull(), F.col("_lP") - F.col("_lD")).otherwise(F.col("_carry") + F.col("_lP"))
    y = y.withColumn("epoch", F.col("_pE") + F.col("_lE")).withColumn("puts", puts)
    return _judged(y).drop("_lE", "_lP", "_lD", "_pE", "_carry", "_chunk")


def final_pointer(replayed: DataFrame, key: str = "name", order=ORDER) -> DataFrame:
    """Active version after each name's last op, by partial aggregations
    only (skew-safe). Between two puts of an epoch the pointer is the last
    valid rollback since the put, else the put's own version; so it is fixed
    by the last ``(epoch, puts)`` segment of the name."""
    ordc = F.struct(*order)
    last = replayed.groupBy(key).agg(F.max_by(F.struct("epoch", "puts"), ordc).alias("_s"))
    rb = (replayed.where(F.col("valid"))
                  .groupBy(key, "epoch", "puts").agg(F.max_by("version", ordc).cast("long").alias("_rb")))
    j = last.select(key, F.col("_s.epoch").alias("epoch"), F.col("_s.puts").alias("puts")) \
            .join(rb, [key, "epoch", "puts"], "left")
    act = F.coalesce(F.col("_rb"), F.when(F.col("puts") > 0, F.col("puts")))
    return j.select(key, "epoch", act.alias("active_version"))


def current_versions(replayed: DataFrame, key: str = "name", value: str = "spec") -> DataFrame:
    """All versions of the latest epoch with the active flag (deleted names
    have no row). The per-name pointer is one row per name; the join back is
    left to AQE (broadcast when small, skewed partitions split)."""
    ptr = final_pointer(replayed, key)
    puts = replayed.where(F.col("op") == "put").select(key, "epoch", "put_version", value)
    return (puts.join(ptr, [key, "epoch"], "inner")
                .select(key, F.col("put_version").alias("version"), value,
                        (F.col("put_version") == F.col("active_version")).alias("is_active")))


def active_pointer(replayed: DataFrame, key: str = "name") -> DataFrame:
    """(name, active_version) for names whose latest op left a pointer."""
    return final_pointer(replayed, key).where(F.col("active_version").isNotNull()).drop("epoch")


def rollback_errors(replayed: DataFrame, key: str = "name") -> DataFrame:
    """D3: rejected rollbacks with the store's message."""
    return (replayed.where((F.col("op") == "rollback") & ~F.col("valid"))
                    .select(key, "ts", "seq", "version",
                            F.format_string(ROLLBACK_MISSING, F.col("version").cast("long")).alias("error")))


def _pointer_scan(batches, by: list[str], exits: bool):
    """Ordered fold of the store's code rule over rows sorted by the group ``by``.
    State is (group, active, max version): constant memory, streamed batch by
    batch, from the entry state (_a, _t) that a group's rows carry. Gives each row
    with what it wrote and the pointer after it (only op and version are looked
    at, the other columns pass through as they came), or with ``exits`` just
    each group's last state."""
    import pyarrow as pa
    cur, active, top = None, 0, 0
    schema = None

    def ended():
        return pa.RecordBatch.from_arrays([pa.array([v], schema.field(n).type) for n, v in zip(by, cur)]
                                          + [pa.array([active], pa.int64()), pa.array([top], pa.int64())], names=[*by, "_xa", "_xt"])
    for b in batches:
        schema = b.schema
        groups = list(zip(*(b.column(n).to_pylist() for n in by), strict=True))
        ops, versions, entry_a, entry_t = (b.column(n).to_pylist() for n in ("op", "version", "_a", "_t"))
        written, pointer = [], []
        for i, (group, op, v) in enumerate(zip(groups, ops, versions, strict=True)):
            if group != cur:
                if exits and cur is not None:
                    yield ended()
                cur, active, top = group, entry_a[i], entry_t[i]
            put = None
            if op == "put":
                active += 1
                top = max(top, active)
                put = active
            elif op == "rollback" and v is not None and 1 <= v <= top:
                active = v
            written.append(put)
            pointer.append(active or None)
        if not exits:
            cols = [b.column(n) for n in schema.names] + [pa.array(written, pa.int64()), pa.array(pointer, pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, names=[*schema.names, "written", "active"])
    if exits and cur is not None:
        yield ended()


def _fold(ops: DataFrame, by: list[str], exits: bool = False) -> DataFrame:
    """:func:`_pointer_scan` of every group in order; the entry states go."""
    types = {f.name: f.dataType.simpleString() for f in ops.schema}
    out = {**{n: types[n] for n in by}, "_xa": "bigint", "_xt": "bigint"} if exits else {**types, "written": "bigint", "active": "bigint"}
    rows = ops.repartition(*by).sortWithinPartitions(*by, *ORDER)
    return rows.mapInArrow(lambda it: _pointer_scan(it, by, exits), ", ".join(f"`{n}` {t}" for n, t in out.items())).drop("_a", "_t")


def _speculative_fold(ops: DataFrame, key: str, chunk: Column) -> DataFrame:
    """The fold of names too heavy for one task, over their chunks side by side.

    Every chunk is folded from a guessed entry state (as many versions as there were
    puts before it). Where the state that the chunk before it really ends in is another,
    the chunk is folded again from that one, and so on until no entry differs: then the
    chain is that of the sequential fold. A wrong guess is healed by the first
    rollback that is valid either way, so few chunks are folded more than
    twice; at worst there are as many rounds as chunks. Per round only the chunks'
    states are kept, never rows."""
    by = [key, "epoch", "_chunk"]
    rows = written(ops.withColumn("_chunk", chunk).where(F.col(key).isNotNull()))
    before = Window.partitionBy(key, "epoch").orderBy("_chunk")
    puts = rows.groupBy(*by).agg(F.sum((F.col("op") == "put").cast("long")).alias("_p"))
    so_far = F.coalesce(F.sum("_p").over(before.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    todo = written(puts.select(*by, so_far.alias("_a"), so_far.alias("_t")))
    states = None
    while True:
        exits = todo.join(_fold(rows.join(todo, by), by, exits=True), by)
        states = written(exits if states is None else states.join(todo.select(*by), by, "left_anti").unionByName(exits))
        real = [F.coalesce(F.lag(x).over(before), F.lit(0).cast("long")).alias(n) for n, x in (("_ra", "_xa"), ("_rt", "_xt"))]
        wrong = states.select(*by, "_a", "_t", *real).where("_ra <> _a OR _rt <> _t")
        todo = written(wrong.select(*by, F.col("_ra").alias("_a"), F.col("_rt").alias("_t")))
        if todo.isEmpty():
            return _fold(rows.join(states.select(*by, "_a", "_t"), by), by).drop("_chunk")


def replay_pointer(oplog: DataFrame, key: str = "name", value: str = "spec", chunk: Column | None = None,
                   heavy_rows: int | None = None) -> DataFrame:
    """D2, the store's code rule: next version = active + 1, so a put after a
    rollback overwrites a newer version. The rule is a sequential fold between
    two deletes of a name: a streaming scan over rows partitioned by
    ``(name, delete epoch)`` (a delete opens its epoch, so it only resets), or for
    names of over ``heavy_rows`` ops by :func:`_speculative_fold`. The
    results are then reduced with partial aggregations:

    * a version's value = the last put that wrote it in the latest epoch;
    * the active version = the pointer after the name's last op.

    Rows without a name are left out.
    """
    base = oplog.select(key, *ORDER, "op", F.col("version").cast("long").alias("version"), value)
    light, heavy = split_heavy(base, [key], heavy_rows)
    deletes = (F.col("op") == "delete").cast("long")
    run = Window.partitionBy(key).orderBy(*ORDER).rowsBetween(Window.unboundedPreceding, 0)
    start = {n: F.lit(0).cast("long") for n in ("_a", "_t")}
    scanned = _fold(light.withColumn("epoch", F.sum(deletes).over(run)).withColumns(start), [key, "epoch"])
    if heavy is not None:
        ch = chunk if chunk is not None else hour_chunk(ORDER[0])
        ops = chunked_scan(heavy, [key], list(ORDER), ch, sums={"epoch": deletes})
        scanned = scanned.unionByName(_speculative_fold(ops, key, ch).select(*scanned.columns))
    order = F.struct(*ORDER)
    last = scanned.groupBy(key).agg(F.max("epoch").alias("_e"), F.max_by("active", order).alias("active_version"))
    writes = (scanned.where(F.col("written").isNotNull())
                     .groupBy(key, "epoch", F.col("written").alias("version"))
                     .agg(F.max_by(value, order).alias(value)))
    return (writes.join(last, key, "inner").where(F.col("epoch") == F.col("_e"))
                  .select(key, "version", value, (F.col("version") == F.col("active_version")).alias("is_active")))


def version_chain(replayed: DataFrame, sizes: DataFrame, key: str = "name", heavy_rows: int | None = None) -> DataFrame:
    """C12's input along the real chain: each version of a replay (D1) beside the one
    before it in the same epoch, as ``a_*`` and ``b_*`` columns. ``sizes`` has a put's
    ``seq`` and its spec's ``spec_name``, ``queues`` and ``stages``."""
    puts = replayed.where(F.col("op") == "put").select(key, *ORDER, "epoch", F.col("put_version").alias("version"))
    spec = F.struct("epoch", "spec_name", "queues", "stages")
    seen = ordered_scan(puts.join(sizes, "seq"), [key], list(ORDER), hour_chunk(ORDER[0]), prevs={"_was": spec}, heavy_rows=heavy_rows)
    both = {"a_name": "_was.spec_name", "a_q": "_was.queues", "a_s": "_was.stages", "b_name": "spec_name", "b_q": "queues", "b_s": "stages"}
    return seen.where(F.col("_was.epoch") == F.col("epoch")).select(key, "epoch", "version", *[F.col(c).alias(n) for n, c in both.items()])


# D5 / D6 / D7 / D8 --------------------------------------------------------
def flow_list(versions: DataFrame, key: str = "name") -> DataFrame:
    """Names with a resolvable active pointer → active spec."""
    return versions.where("is_active").select(key, F.col("version").alias("active_version"), "spec")


def flow_summaries(flows: DataFrame, status: DataFrame, key: str = "name") -> DataFrame:
    """Every listed flow with its status (null when none)."""
    return flows.join(status.select(key, "state", "message"), key, "left") \
                .select(key, "active_version", "state", "message")


def flow_get(requests: DataFrame, kv: DataFrame, status: DataFrame, key: str = "name", order=("ts", "rev")) -> DataFrame:
    """D5 in bulk on the store's final state: pointer → spec → optional status.
    ``result`` is ``ok`` or the store's error: no pointer, a pointer that is no
    version, or a pointer to a version without a spec."""
    last = kv.groupBy("key").agg(F.max_by(F.struct("op", "value"), F.struct(*order)).alias("_v"))
    live = last.where(F.col("_v.op") == "put").select("key", F.col("_v.value").alias("value"))
    pointer = live.where(F.col("key").endswith("/active")).select(
        key_name("key").alias(key), F.lit(True).alias("_there"), pointer_version("value").alias("version"))
    spec = version_specs(live).select(F.col("name").alias(key), "version", F.col("value").alias("spec"))
    x = requests.select(key).distinct().join(pointer, key, "left").join(spec, [key, "version"], "left")
    error = (F.when(F.col("_there").isNull(), F.format_string(FLOW_NOT_FOUND, F.col(key)))
              .when(F.col("version").isNull(), F.lit(BAD_POINTER))
              .when(F.col("spec").isNull(), F.format_string(SPEC_MISSING, F.col(key), F.col("version"))))
    x = x.join(status.select(key, "state", "workload"), key, "left").withColumn("result", F.coalesce(error, F.lit("ok")))
    ok = F.col("result") == "ok"
    return x.select(key, F.when(ok, F.col("version")).try_cast("long").alias("active_version"), "spec",
                    *[F.when(ok, F.col(c)).alias(c) for c in ("state", "workload")], "result")


def upserts(requests: DataFrame) -> DataFrame:
    """The name each request writes under. An update takes its argument
    (``name``) over the spec's own name; a create takes the spec's name and
    fails without one. Adds ``target`` and ``error``."""
    own = F.when(F.coalesce("spec_name", F.lit("")) != "", F.col("spec_name"))
    update = F.col("op") == "update"
    return (requests.withColumn("target", F.when(update, F.col("name")).otherwise(own))
                    .withColumn("error", F.when(~update & own.isNull(), F.lit(NAME_REQUIRED))))


# D9 / D10 -----------------------------------------------------------------
def pointer_version(value) -> Column:
    """An active pointer's text as a version (digits without leading zeros), or
    null: base-10 digits only, unsigned 64 bits."""
    v = F.col(value) if isinstance(value, str) else value
    digits = F.regexp_replace(v, r"^0+(?=[0-9])", "")
    fits = (F.length(digits) <= 20) & (digits.try_cast("decimal(20,0)") <= F.lit(MAX_VERSION).cast("decimal(20,0)"))
    return F.when(v.rlike(r"\A[0-9]+\z") & fits, digits)


def version_specs(kv: DataFrame) -> DataFrame:
    """Rows of ``…/<name>/versions/<n>/spec`` keys, with name and version."""
    parts = F.split("key", "/")
    at = lambda i: F.try_element_at(parts, F.lit(i))
    return kv.where((key_leaf("key") == "spec") & (at(-3) == "versions")).withColumns({"name": at(-4), "version": at(-2)})


def watch_events(kv: DataFrame, heavy_rows: int | None = None) -> DataFrame:
    """Change events for ``…/active`` keys. A put on a missing key is
    ADDED, a later put UPDATED, a delete of a live key DELETED (deleting a
    missing key emits nothing). A put's value names a version: the event
    carries the spec that this version has at that revision (none if it has
    none then). Puts whose value is no version are dropped; deleted events
    carry neither."""
    act = kv.where(F.col("key").endswith("/active"))
    # previous op of the same key: skew-safe ordered scan (hot keys split by time)
    ev = ordered_scan(act, ["key"], ["ts", "rev"], hour_chunk("ts"), prevs={"_prev": F.col("op")}, heavy_rows=heavy_rows)
    etype = (F.when(F.col("op") == "delete",
                    F.when(F.col("_prev") == "put", F.lit("DELETED")))
              .when(F.col("_prev").isNull() | (F.col("_prev") == "delete"), F.lit("ADDED"))
              .otherwise(F.lit("UPDATED")))
    ev = ev.select("ts", "rev", "key", key_name("key").alias("name"), etype.alias("event_type"),
                   F.when(F.col("op") == "put", pointer_version("value")).alias("version"))
    ev = ev.where(F.col("event_type").isNotNull() & ((F.col("event_type") == "DELETED") | F.col("version").isNotNull()))
    ev = asof_join(ev, version_specs(kv), ["name", "version"], ["ts", "rev"], ["op", "value"], "_at", hour_chunk("ts"), heavy_rows)
    return ev.select("ts", "rev", "key", F.col("name").alias("flow"), "event_type", F.col("version").try_cast("long").alias("version"),
                     F.when(F.col("_at.op") == "put", F.col("_at.value")).alias("spec"))


def watch_event_counts(events: DataFrame) -> DataFrame:
    return events.groupBy("event_type", "flow").agg(F.count(F.lit(1)).alias("events"))


# D11 ----------------------------------------------------------------------
def coalesced_lag(work: DataFrame, key: str = "key") -> DataFrame:
    """Queue lag per ``get``: time since the *last* ``add`` of the key after
    the previous ``get`` (re-adds overwrite the enqueue time); no add → 0.
    That last add, if any, is exactly the row before the ``get``, so this is
    a previous-row lookup — done as a skew-safe ordered scan."""
    x = ordered_scan(work, [key], list(ORDER), hour_chunk("ts"),
                     prevs={"_pop": F.col("op"), "_pts": F.col("ts")})
    lag = (T.epoch_us("ts") - T.epoch_us("_pts")) / F.lit(1e6)
    return (x.where(F.col("op") == "get")
             .select("ts", "seq", key, F.when(F.col("_pop") == "add", lag).otherwise(F.lit(0.0)).alias("lag_s")))


def queue_depth(work: DataFrame, step_s: int = 60, key: str = "key") -> DataFrame:
    """Work-queue depth (distinct pending keys) sampled at each step end.

    Per key, pending toggles on ``add`` and off on ``get``; the ±1 transitions
    are summed per step (map-side), and the per-step totals are a :func:`gauge`."""
    pend = (F.col("op") == "add").cast("long")
    x = ordered_scan(work.withColumn("_p", pend), [key], list(ORDER), hour_chunk("ts"),
                     prevs={"_pp": F.col("_p")})
    x = x.withColumn("_d", F.col("_p") - F.coalesce(F.col("_pp"), F.lit(0)))
    per = x.groupBy(T.bucket_index("ts", step_s).alias("_b")).agg(F.sum("_d").alias("_d"))
    return gauge(per, step_s, "depth")


def gauge(per: DataFrame, step_s: int, name: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Running sum of ``_d`` over steps ``_b`` as a gauge per ``by`` (none: one
    series): it keeps its value in steps without a change, from the first step to
    the last. Steps are summed within days; only a series' daily totals (one row a
    day) meet in one window."""
    steps = max(1, 86_400 // step_s)
    x = per.withColumn("_day", F.floor(F.col("_b") / F.lit(steps)).cast("long")).withColumn("_series", F.struct(F.lit(0).alias("_"), *by))
    days = x.groupBy("_series", "_day").agg(F.sum("_d").alias("_t"), F.min("_b").alias("_first"))
    w = Window.partitionBy("_series").orderBy("_day")
    days = days.select("_series", "_day", F.coalesce(F.sum("_t").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"),
                       F.lead("_first").over(w).alias("_after"))
    d = Window.partitionBy("_series", "_day").orderBy("_b")
    x = x.join(days, ["_series", "_day"]).select(
        *by, "_b", (F.col("_before") + F.sum("_d").over(d.rowsBetween(Window.unboundedPreceding, 0))).cast("long").alias(name),
        F.coalesce(F.lead("_b").over(d), F.col("_after"), F.col("_b") + 1).alias("_next"))
    x = x.select(*by, name, F.explode(F.sequence(F.col("_b"), F.col("_next") - 1)).alias("_b"))
    return x.select(*by, T.index_to_ts(F.col("_b") + 1, step_s).alias("ts"), name)


def flows_as_of(replayed: DataFrame, before: Column, key: str = "name") -> DataFrame:
    """:func:`flow_list` of the log's prefix ``before``, from a replay of the whole
    log: what the replay adds to a row depends on earlier rows only."""
    return flow_list(current_versions(replayed.where(before), key), key)


# D12 ----------------------------------------------------------------------
def desired_state_plan(desired: DataFrame, actual: DataFrame, key: str = "name",
                       rendered: str = "spec") -> DataFrame:
    """Desired vs deployed by SHA-256 checksum of the rendered spec text →
    create / update / unchanged / delete."""
    d = desired.select(key, F.sha2(F.col(rendered).cast("string"), 256).alias("desired_checksum"))
    a = actual.select(key, F.sha2(F.col(rendered).cast("string"), 256).alias("actual_checksum"))
    j = d.join(a, key, "full_outer")
    action = (F.when(F.col("actual_checksum").isNull(), F.lit("create"))
               .when(F.col("desired_checksum").isNull(), F.lit("delete"))
               .when(F.col("desired_checksum") != F.col("actual_checksum"), F.lit("update"))
               .otherwise(F.lit("unchanged")))
    return j.select(key, "desired_checksum", "actual_checksum", action.alias("action"))


# D13 ----------------------------------------------------------------------
def latest_status(reconciles: DataFrame, kv: DataFrame | None = None, key: str = "flow_name", heavy_rows: int | None = None) -> DataFrame:
    """Status written by the last successful reconcile of each flow. With ``kv``
    a reconcile reads the pointer and its spec as they are at its time, and
    writes a status with that version only if there is a spec: flows that never
    had one at a reconcile have no row."""
    ok = reconciles.where("ok").select(F.col(key).alias("name"), "ts")
    out = [F.col("name"), F.lit(STATUS_STATE).alias("state"), F.lit(STATUS_MESSAGE).alias("message"),
           F.concat("name", F.lit("-runtime")).alias("workload"), F.col("last_updated")]
    if kv is None:
        return ok.groupBy("name").agg(F.max("ts").alias("last_updated")).select(*out)
    order = ["ts", "rev"]
    ok = ok.withColumn("rev", F.lit(2**63 - 1))   # after the store's changes of the same instant
    pointers = kv.where(F.col("key").endswith("/active")).withColumn("name", key_name("key"))
    seen = asof_join(ok, pointers, ["name"], order, ["op", "value"], "_ptr", hour_chunk("ts"), heavy_rows)
    seen = seen.withColumn("version", F.when(F.col("_ptr.op") == "put", pointer_version(F.col("_ptr.value")))).drop("_ptr")
    seen = asof_join(seen.where(F.col("version").isNotNull()), version_specs(kv), ["name", "version"], order, ["op", "value"], "_at", hour_chunk("ts"), heavy_rows)
    seen = seen.where((F.col("_at.op") == "put") & F.col("_at.value").isNotNull())
    last = seen.groupBy("name").agg(F.max("ts").alias("last_updated"), F.max_by("version", "ts").alias("version"))
    return last.select(*out, F.col("version").try_cast("long").alias("active_version"))
