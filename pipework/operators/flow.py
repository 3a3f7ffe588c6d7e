"""Declarative record flows on DataFrames.

A flow spec (the dict form of a FlowSpec) names queues and stages. Each queue
becomes one DataFrame edge; stages are registered Python callables:

* a **source** produces a DataFrame (``threads`` independent workers),
* a **transform** maps DataFrame → DataFrame (one output row per input row),
* a **sink** selects what it writes (the write itself is a batch ``write`` or
  a ``writeStream``; see :mod:`pipework.streaming.runner`).

Edges follow the reference's wiring rules: several consumers of one queue
*compete* (each row goes to exactly one: a deterministic hash split), several
producers of one queue *merge* (bag union). Queue schemas gate rows exactly
like the runners do (B1/B2), and transforms inherit ``schema_id``.

The builder only composes lazy DataFrames; Catalyst plans the whole flow as
one job per sink. ``threads`` multiplies sources (behaviour 2); for
transforms and sinks parallelism comes from partitions, so it is ignored.
"""

from __future__ import annotations

import dataclasses
import threading
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from pipework.operators import schema_gate as G
from pipework.operators import wiring as R
from pipework.operators.telemetry import account, counters

DEFAULT_CAPACITY = 128


class FlowError(ValueError):
    """A flow that the runtime refuses to start (bad wiring or config)."""


# ---------------------------------------------------------------------------
# stage registry
# ---------------------------------------------------------------------------
@dataclass
class StageType:
    name: str
    kind: str                       # source | transform | sink
    config: type | None
    build: Callable


_REGISTRY: dict[str, StageType] = {}


def stage(type_name: str, kind: str, config: type | None = None):
    """Register a stage implementation under ``type_name``.

    ``build(spark, cfg)`` returns the stage callable: for sources
    ``produce(threads) -> DataFrame``; for transforms and sinks
    ``fn(df) -> DataFrame``."""
    if kind not in ("source", "transform", "sink"):
        raise ValueError(f"unknown stage kind {kind!r}")

    def deco(build):
        _REGISTRY[type_name] = StageType(type_name, kind, config, build)
        return build
    return deco


def registered(type_name: str) -> StageType:
    try:
        return _REGISTRY[type_name]
    except KeyError:
        raise FlowError(f"unknown stage type {type_name!r}") from None


def parse_config(cls: type | None, raw: dict | None):
    """Typed config; unknown keys are rejected (the flow aborts)."""
    raw = dict(raw or {})
    if cls is None:
        if raw:
            raise FlowError(f"stage takes no config, got {sorted(raw)}")
        return None
    names = {f.name for f in dataclasses.fields(cls)}
    unknown = sorted(set(raw) - names)
    if unknown:
        raise FlowError(f"unknown config field(s) {unknown} for {cls.__name__}")
    return cls(**raw)


# ---------------------------------------------------------------------------
# edges: competing split (A5) and fan-in
# ---------------------------------------------------------------------------
def split_hash(key: Column, queue: str = "") -> Column:
    """Stable 32-bit hash of queue and key: first 8 hex digits of their MD5. The
    queue's name is part of it, so that a queue after another one is split
    anew; a null key counts as empty."""
    text = F.concat(F.lit(queue), F.coalesce(key.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def competing_split(df: DataFrame, n: int, key: Column | str, queue: str = "") -> list[DataFrame]:
    """Partition rows among ``n`` competing consumers: disjoint and complete.
    Each branch is a filter on the same lineage (no shuffle)."""
    k = F.col(key) if isinstance(key, str) else key
    h = split_hash(k, queue)
    return [df.where(F.pmod(h, F.lit(n)) == i) for i in range(n)]


def assign_consumer(df: DataFrame, n: int, key: Column | str, name: str = "consumer", queue: str = "") -> DataFrame:
    k = F.col(key) if isinstance(key, str) else key
    return df.withColumn(name, F.pmod(split_hash(k, queue), F.lit(n)))


def fan_in(frames: list[DataFrame]) -> DataFrame:
    """Bag union of every producer of a queue."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def _default_split_key(df: DataFrame) -> Column:
    if "span_id" in df.columns:
        return F.col("span_id")
    return F.to_json(F.struct(*[F.col(c) for c in df.columns]))


# ---------------------------------------------------------------------------
# spec checks done by the runtime before starting
# ---------------------------------------------------------------------------
def _queue_schema(q: dict) -> str | None:
    sch = q.get("schema")
    return (sch or {}).get("schema_id") or None


def check_spec(spec: dict) -> None:
    names = [s.get("name") or "" for s in spec.get("stages") or []]
    if "" in names:
        raise FlowError("stage name is required")
    if len(set(names)) < len(names):   # edges go by stage name
        raise FlowError(f"duplicate stage name: {next(n for n in names if names.count(n) > 1)}")
    queues: dict[str, dict] = {}
    for q in spec.get("queues") or []:
        name = q.get("name", "")
        cap = q.get("capacity", DEFAULT_CAPACITY)
        if not cap or cap <= 0:
            raise FlowError(R.MSG_CAPACITY % name)
        if "schema" in q and q["schema"] is not None and not (q["schema"] or {}).get("schema_id"):
            raise FlowError(R.MSG_SCHEMA_ID % name)
        if name in queues:
            raise FlowError(R.MSG_QUEUE_TWICE % name)
        if q.get("type") not in (*R.QUEUE_TYPES, None):
            raise FlowError(R.MSG_QUEUE_TYPE % name)
        queues[name] = q
    for s in spec.get("stages") or []:
        st = registered(s.get("type", ""))
        if (bool(s.get("input_queue")), bool(s.get("output_queue"))) != R.WIRING[st.kind]:
            raise FlowError(R.MSG_WIRING % (st.kind, s.get("name")))
        for side in ("input_queue", "output_queue"):
            if s.get(side) and s[side] not in queues:
                raise FlowError(f"unknown queue {s[side]!r} for stage {s.get('name')}")
        if int(s.get("threads", 1) or 0) < 1:
            raise FlowError(f"stage {s.get('name')!r} must declare at least one thread")


# ---------------------------------------------------------------------------
# the runner (A7): build every edge lazily
# ---------------------------------------------------------------------------
COUNTERS = ("dequeue", "process", "error", "enqueue")
#: The kind of stage that doesn't have a counter.
_NOT_COUNTED = {"dequeue": "source", "enqueue": "sink"}


def _observed(o: Observation, wait_s: float) -> dict | None:
    """What was observed; None if no job that ran held the observation."""
    got: list[dict] = []
    waiter = threading.Thread(target=lambda: got.append(o.get), daemon=True)
    waiter.start()
    waiter.join(wait_s)
    return got[0] if got else None


@dataclass
class FlowRun:
    queues: dict[str, DataFrame] = field(default_factory=dict)
    sinks: dict[str, DataFrame] = field(default_factory=dict)
    # per stage: (stage name, type, kind, rows seen before gating, rows produced, in/out queue schema)
    trace: list = field(default_factory=list)
    # stage name → its observations, of a run with ``observe``
    observed: dict[str, list[Observation]] = field(default_factory=dict)
    reached: set[str] = field(default_factory=set)   # names of the stages whose rows end in a sink

    def counts(self, wait_s: float = 60.0) -> dict[str, dict[str, int | None]]:
        """§2.F counters per stage as the jobs that wrote the sinks observed them: no
        scan of their own, so ask after :func:`write_sinks` and only for a run
        with ``observe``. A counter that its kind of stage doesn't have is None, and
        so are all counters of a stage that leads to no sink (nothing ran it). Rows
        computed again after the loss of an executor may count again, as in any
        accumulator; :meth:`metrics` is exact and scans."""
        if not self.observed:
            raise FlowError("the flow was composed without observe=True")
        kinds = {name: kind for name, _type, kind, *_ in self.trace}
        out = {}
        for name, parts in self.observed.items():
            got = [_observed(o, wait_s) if name in self.reached else None for o in parts]
            ran = all(g is not None for g in got)
            out[name] = {c: sum(g.get(c) or 0 for g in got) if ran and _NOT_COUNTED.get(c) != kinds[name] else None for c in COUNTERS}
        return out

    def metrics(self) -> DataFrame:
        """§2.F counters per stage (label ``stage`` = stage type, behaviour 7)."""
        parts = []
        for name, typ, kind, seen, produced, in_s, out_s in self.trace:
            if kind == "transform":   # input is judged on what it saw, output on what it produced
                halves = [account(seen, "sink", in_s).withColumn("enqueue", F.lit(0).cast("long")),
                          account(produced, "source", None, out_s).withColumns(
                              {"dequeue": F.lit(0).cast("long"), "process": F.lit(0).cast("long")})]
            else:
                halves = [account(seen, kind, in_s, out_s)]
            for half in halves:
                parts.append(half.agg(*[F.sum(c).alias(c) for c in COUNTERS]).select(
                    F.lit(name).alias("stage_name"), F.lit(typ).alias("stage"), F.lit(kind).alias("_kind"), *COUNTERS))
        return (fan_in(parts).groupBy("stage_name", "stage", "_kind").agg(*[F.sum(c).alias(c) for c in COUNTERS])
                .select("stage_name", "stage", *[F.when(F.col("_kind") != _NOT_COUNTED.get(c, ""), F.coalesce(c, F.lit(0).cast("long"))).alias(c)
                                                 for c in COUNTERS]))


def run_flow(spark: SparkSession, spec: dict, set_schema: bool = False,
             share_queues: bool = False, clock: Callable[[dict, DataFrame], Column] | None = None,
             sources: dict[str, DataFrame] | None = None, observe: bool = False) -> FlowRun:
    """Compose the flow's DataFrames. ``set_schema=True`` lets transforms
    stamp their output queue's schema id instead of inheriting it.

    A queue read by several consumers is otherwise recomputed once per
    consumer when the sinks are written; ``share_queues=True`` (batch only)
    checkpoints such queues once into the shared checkpoint dir first.

    ``sources`` gives rows of source stages (by name) in place of what they would
    produce, for one micro-batch of a stream.

    Every push by a source or transform stamps ``enqueue_ts`` (A18) with
    ``clock(stage, rows)``, by default the current time.

    ``observe=True`` counts each stage's rows in the jobs that write the sinks
    (:meth:`FlowRun.counts`)."""
    clock = clock or (lambda _stage, _rows: F.current_timestamp().cast("timestamp_ntz"))
    check_spec(spec)
    queues = {q["name"]: q for q in spec.get("queues") or []}
    stages = list(spec.get("stages") or [])
    kinds = {s["name"]: registered(s["type"]).kind for s in stages}
    consumers: dict[str, list[dict]] = {}
    producers: dict[str, list[dict]] = {}
    for s in stages:
        if s.get("input_queue"):
            consumers.setdefault(s["input_queue"], []).append(s)
        if s.get("output_queue"):
            producers.setdefault(s["output_queue"], []).append(s)

    run = FlowRun()
    outputs: dict[str, DataFrame] = {}      # stage name → rows it enqueues
    inputs: dict[str, DataFrame] = {}       # stage name → rows it dequeues (before gate)

    def watched(s: dict, df: DataFrame, kind: str, *schemas, only=COUNTERS) -> DataFrame:
        if not observe:
            return df
        o = Observation()
        run.observed.setdefault(s["name"], []).append(o)
        sums = [F.sum(c).alias(n) for n, c in counters(kind, *schemas).items() if n in only]
        return df.observe(o, *sums)

    def queue_df(qname: str, stack=()) -> DataFrame:
        if qname in run.queues:
            return run.queues[qname]
        if qname in stack:
            raise FlowError(f"cycle through queue {qname!r}")
        frames = [stage_out(p, stack + (qname,)) for p in producers.get(qname, [])]
        if not frames:
            raise FlowError(f"queue {qname!r} has no producer")
        merged = fan_in(frames)
        if share_queues and len(consumers.get(qname, [])) > 1 and not merged.isStreaming:
            from pipework.session import materialize
            merged = materialize(merged)
        run.queues[qname] = merged
        return run.queues[qname]

    def stage_in(s: dict, stack) -> DataFrame:
        if s["name"] in inputs:
            return inputs[s["name"]]
        q = s["input_queue"]
        df = queue_df(q, stack)
        group = consumers[q]
        if len(group) > 1:
            idx = [c["name"] for c in group].index(s["name"])
            df = competing_split(df, len(group), _default_split_key(df), q)[idx]
        inputs[s["name"]] = df
        return df

    def stage_out(s: dict, stack) -> DataFrame:
        if s["name"] in outputs:
            return outputs[s["name"]]
        st = registered(s["type"])
        out_schema = _queue_schema(queues[s["output_queue"]])
        given = (sources or {}).get(s["name"]) if st.kind == "source" else None
        fn = st.build(spark, parse_config(st.config, s.get("config"))) if given is None else None
        if st.kind == "source":
            raw = given if given is not None else fn(int(s.get("threads", 1) or 1))
            run.trace.append((s["name"], s["type"], "source", raw, raw, None, out_schema))
            produced = watched(s, raw, "source", None, out_schema)
        else:
            in_schema = _queue_schema(queues[s["input_queue"]])
            seen = stage_in(s, stack)   # input is judged on what it saw, output on what it produced
            produced = fn(G.gate_input(watched(s, seen, "sink", in_schema), in_schema))
            if set_schema and out_schema:
                produced = produced.withColumn("schema_id", F.lit(out_schema))
            run.trace.append((s["name"], s["type"], "transform", seen, produced, in_schema, out_schema))
            produced = watched(s, produced, "source", None, out_schema, only=("error", "enqueue"))
        if "enqueue_ts" in produced.columns:
            produced = produced.withColumn("enqueue_ts", clock(s, produced))
        outputs[s["name"]] = G.stamp_output(produced, out_schema)
        return outputs[s["name"]]

    for s in stages:
        if kinds[s["name"]] == "sink":
            st = registered(s["type"])
            fn = st.build(spark, parse_config(st.config, s.get("config")))
            seen = stage_in(s, ())
            in_schema = _queue_schema(queues[s["input_queue"]])
            run.trace.append((s["name"], s["type"], "sink", seen, seen, in_schema, None))
            run.sinks[s["name"]] = fn(G.gate_input(watched(s, seen, "sink", in_schema), in_schema))
            run.reached |= {s["name"], *_upstream(s, producers)}
    for q in queues:
        if q in producers:
            queue_df(q)
    return run


def _upstream(s: dict, producers: dict[str, list[dict]]) -> set[str]:
    """Names of the stages whose rows come to ``s``."""
    seen: set[str] = set()
    ahead = [s]
    while ahead:
        for p in producers.get(ahead.pop().get("input_queue") or "", []):
            if p["name"] not in seen:
                seen.add(p["name"])
                ahead.append(p)
    return seen


def source_frames(spark: SparkSession, spec: dict) -> dict[str, DataFrame]:
    """What each source stage produces, by stage name."""
    out = {}
    for s in spec.get("stages") or []:
        st = registered(s.get("type", ""))
        if st.kind == "source":
            out[s["name"]] = st.build(spark, parse_config(st.config, s.get("config")))(int(s.get("threads", 1) or 1))
    return out


def admission_limits(spec: dict) -> dict[str, int]:
    """A10: for each source the smallest capacity of a queue on any of its ways to a
    sink (0 if none declares one): the tightest queue holds back the source."""
    caps = {q["name"]: q.get("capacity") or 0 for q in spec.get("queues") or []}
    stages = spec.get("stages") or []
    out = {}
    for s in stages:
        if registered(s.get("type", "")).kind != "source":
            continue
        seen, ahead = set(), [s["output_queue"]]
        while ahead:
            q = ahead.pop()
            if q not in seen:
                seen.add(q)
                ahead += [t["output_queue"] for t in stages if t.get("input_queue") == q and t.get("output_queue")]
        out[s["name"]] = min((caps[q] for q in seen if caps.get(q, 0) > 0), default=0)
    return out


# ---------------------------------------------------------------------------
# all sinks or none
# ---------------------------------------------------------------------------
def hadoop_path(spark: SparkSession, path: str):
    """(file system, path) of any store that Spark reaches."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def _finish_publish(spark: SparkSession, base: str) -> None:
    """Move what a manifest names from staging to its place; repeatable at any point."""
    fs, manifest = hadoop_path(spark, f"{base}/_publish")
    if not fs.exists(manifest):
        return
    for entry in fs.listStatus(manifest):
        name = entry.getPath().getName()
        staged, place = (hadoop_path(spark, f"{base}/{x}")[1] for x in (f"_staging/{name}", name))
        if fs.exists(staged):   # else it has been moved already
            fs.delete(place, True)
            if not fs.rename(staged, place):
                raise FlowError(f"cannot publish sink {name!r}")
    fs.delete(manifest, True)


def write_sinks(run: FlowRun, base_path: str, fmt: str = "parquet") -> dict[str, str]:
    """Job mode (A8): drain every sink to ``base_path/<sink>``, all of them or none.

    Every sink is written to a staging folder first; a manifest of their names,
    put in place by one rename, is the point of commit; then the folders are
    moved. A failing sink leaves the outputs as they were. A run that ended
    after its commit is finished by the next one."""
    base = base_path.rstrip("/")
    spark = next(iter(run.sinks.values())).sparkSession
    _finish_publish(spark, base)
    fs, staging = hadoop_path(spark, f"{base}/_staging")
    fs.delete(staging, True)
    try:
        for name, df in run.sinks.items():
            df.write.format(fmt).save(f"{base}/_staging/{name}")
        for name in run.sinks:
            fs.create(hadoop_path(spark, f"{base}/_staging/_manifest/{name}")[1]).close()
    except Exception:
        fs.delete(staging, True)
        raise
    if not fs.rename(hadoop_path(spark, f"{base}/_staging/_manifest")[1], hadoop_path(spark, f"{base}/_publish")[1]):
        raise FlowError("cannot commit the outputs")
    _finish_publish(spark, base)
    fs.delete(staging, True)
    return {name: f"{base}/{name}" for name in run.sinks}
