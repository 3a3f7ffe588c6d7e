"""Catalogue quality: generic constraint checks over any table,
plus the flow-spec rules (normalise, validate, fingerprint, diff, codec).

Every check is one aggregation or one join over whole tables and returns a
violations frame, so checks compose with ``unionByName``. Duplicate and
non-empty checks aggregate (map-side combined), so a hot key costs one
counter, not one task holding all its rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pipework.operators import wiring as R
from pipework.operators.wiring import MSG_SCHEMA_ID  # noqa: F401

DEFAULT_CAPACITY = 128

# --- fixed values: validation messages (verbatim) ------------------------
MSG_NIL = "flow spec is nil"
MSG_NAME = "flow name is required"
MSG_STAGES = "flow must contain at least one stage"
MSG_QUEUE_NAME = "queue name is required"
MSG_QUEUE_DUP = "duplicate queue name %s"
MSG_STAGE_NAME = "stage name is required"
MSG_STAGE_DUP = "duplicate stage %s"
MSG_TYPE = "stage %s missing type"
MSG_THREADS = "stage %s must declare at least one thread"
MSG_INPUT = "stage %s references unknown input queue %s"
MSG_OUTPUT = "stage %s references unknown output queue %s"
# -------------------------------------------------------------------------


def quoted(c) -> Column:
    """Go's %q for plain names: wrap in double quotes, escape \\ and \"."""
    col = F.col(c) if isinstance(c, str) else c
    return F.concat(F.lit('"'), F.regexp_replace(col, r'(["\\])', r'\\$1'), F.lit('"'))


# ---------------------------------------------------------------------------
# generic checks (C2-C9 on any table)
# ---------------------------------------------------------------------------
def null_counts(df: DataFrame, table: str, cols: list[str] | None = None) -> DataFrame:
    """Null rows per column in one pass → (tbl, col, null_rows)."""
    cols = cols or df.columns
    agg = df.agg(*[F.count(F.when(F.col(c).isNull(), 1)).alias(c) for c in cols])
    stack = F.explode(F.array(*[F.struct(F.lit(c).alias("col"), F.col(c).alias("n")) for c in cols]))
    return agg.select(stack.alias("s")).select(F.lit(table).alias("tbl"), "s.col",
                                               F.col("s.n").alias("null_rows"))


def required_counts(df: DataFrame, table: str, cols: list[str]) -> DataFrame:
    """Null-or-empty text per column in one pass → (tbl, col, violations)."""
    agg = df.agg(*[F.count(F.when(F.coalesce(F.col(c).cast("string"), F.lit("")) == "", 1)).alias(c)
                   for c in cols])
    stack = F.explode(F.array(*[F.struct(F.lit(c).alias("col"), F.col(c).alias("n")) for c in cols]))
    return agg.select(stack.alias("s")).select(F.lit(table).alias("tbl"), "s.col",
                                               F.col("s.n").alias("violations"))


def non_empty(parent: DataFrame, child: DataFrame, parent_key: list[str], child_key: list[str]) -> DataFrame:
    """C4: parents without any child row (left anti join)."""
    ck = child.select(*[F.col(c).alias(p) for c, p in zip(child_key, parent_key)])
    return parent.join(ck, parent_key, "left_anti")


def duplicates(df: DataFrame, keys: list[str], name: str = "n") -> DataFrame:
    """Key groups that occur more than once, with their count."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias(name)).where(F.col(name) > 1)


def below_min(df: DataFrame, col: str, minimum) -> DataFrame:
    """Rows whose value is below the lower bound (null is not checked)."""
    return df.where(F.col(col) < F.lit(minimum))


def missing_reference(child: DataFrame, parent: DataFrame, child_cols: list[str],
                      parent_cols: list[str]) -> DataFrame:
    """Child rows whose non-null reference has no parent."""
    p = parent.select(*[F.col(a).alias(b) for a, b in zip(parent_cols, child_cols)]).distinct()
    c = child.where(F.lit(True) if not child_cols else
                    F.expr(" AND ".join(f"`{c}` IS NOT NULL" for c in child_cols)))
    return c.join(p, child_cols, "left_anti")


def conditional(df: DataFrame, when: Column, then: Column) -> DataFrame:
    """Rows where ``when`` holds but ``then`` does not."""
    return df.where(when & ~F.coalesce(then, F.lit(False)))


# ---------------------------------------------------------------------------
# flow spec rules
#
# A spec row carries its own queues and stages, so every rule is a
# row-local expression over its arrays (sort, adjacent duplicate, membership):
# no join, no window, no extra shuffle beyond building the spec rows.
# ---------------------------------------------------------------------------
def sorted_queues(col: str = "queues") -> Column:
    """Queues by (name, capacity, schema id) — struct order, nulls first."""
    return F.array_sort(F.transform(col, lambda q: F.struct(
        q["name"].alias("name"), q["capacity"].alias("capacity"), q["schema_id"].alias("schema_id"))))


def sorted_stages(col: str = "stages") -> Column:
    """Stages by name (ties by type, threads, input, output)."""
    return F.array_sort(F.transform(col, lambda s: F.struct(
        s["name"].alias("name"), s["type"].alias("type"), s["threads"].alias("threads"),
        s["input_queue"].alias("input_queue"), s["output_queue"].alias("output_queue"))))


def _cap(c: Column) -> Column:
    return F.coalesce(F.when(c != 0, c), F.lit(DEFAULT_CAPACITY).cast("long"))


def normalize(specs: DataFrame, key: str = "flow_id") -> DataFrame:
    """Queues and stages sorted by name, capacity 0/unset → 128. Pure
    (the input rows are not changed)."""
    q = F.transform(sorted_queues(), lambda x: x.withField("capacity", _cap(x["capacity"])))
    return specs.select(key, "name", F.coalesce(q, F.array()).alias("queues"),
                        F.coalesce(sorted_stages(), F.array()).alias("stages"))


def normalized_queues(specs: DataFrame, key: str = "flow_id") -> DataFrame:
    """C1 for queues, flat: one row per queue with its normalised position."""
    n = normalize(specs, key)
    return (n.select(key, F.posexplode("queues").alias("pos", "q"))
             .select(key, F.col("pos").cast("long").alias("pos"), "q.name", "q.capacity", "q.schema_id"))


def normalized_stages(specs: DataFrame, key: str = "flow_id") -> DataFrame:
    """C1 for stages, flat."""
    n = normalize(specs, key)
    return (n.select(key, F.posexplode("stages").alias("pos", "s"))
             .select(key, F.col("pos").cast("long").alias("pos"), "s.*"))


def line_positions(lines: DataFrame, key: str = "flow_id") -> DataFrame:
    """C1 for stages that come one per line: ``pos`` becomes the normalised position
    (the order of :func:`sorted_stages`), one window per spec, nothing nested."""
    order = Window.partitionBy(key).orderBy("stage_name", "stage_type", "threads", "input_queue", "output_queue")
    return lines.withColumn("pos", (F.row_number().over(order) - 1).cast("long"))


def line_duplicates(lines: DataFrame, key: str = "flow_id", more: dict[str, Column] | None = None) -> DataFrame:
    """C5/C6 on flat spec lines: names that occur more than once in a spec, by kind
    (queue: with different declarations; stage; ``more``: further names a line
    has) → (key, kind, name, n). One pass; counts are partial aggregates."""
    declared = F.struct("capacity", "schema_id")
    said = {"queue": ("input_queue", F.col("declares_queue")), "stage": ("stage_name", F.lit(False)),
            **{k: (c, F.lit(False)) for k, c in (more or {}).items()}}
    names = [F.struct(F.lit(k).alias("kind"), (F.col(c) if isinstance(c, str) else c).alias("name"), F.when(d, declared).alias("decl"))
             for k, (c, d) in said.items()]
    per = (lines.select(key, F.explode(F.array(*names)).alias("r")).select(key, "r.*")
                .groupBy(key, "kind", "name").agg(F.count(F.lit(1)).alias("_n"), F.count_distinct("decl").alias("_q")))
    return (per.select(key, "kind", "name", F.when(F.col("kind") == "queue", F.col("_q")).otherwise(F.col("_n")).alias("n"))
               .where(F.col("n") > 1))


def line_references(lines: DataFrame, key: str = "flow_id") -> DataFrame:
    """C8/C9 on flat spec lines: references to queues that their spec doesn't declare
    → (key, pos, queue, side). Positions and declared names come from one shuffle by spec."""
    own = Window.partitionBy(key)
    names = F.collect_set(F.when(F.col("declares_queue"), F.col("input_queue"))).over(own)
    sides = F.array(*[F.struct(F.col(f"{x}_queue").alias("queue"), F.lit(x).alias("side")) for x in ("input", "output")])
    refs = line_positions(lines.withColumn("_names", names), key).select(key, "pos", "_names", F.explode(sides).alias("r"))
    return refs.where(F.col("r.queue").isNotNull() & ~F.array_contains("_names", F.col("r.queue"))).select(key, "pos", "r.*")


def _viol(field: str, message: Column, section: int, pos, rule: int) -> Column:
    """A violation and its place in the reference's order of checks: section
    (0 flow, 1 queues, 2 stages, then the runtime's: 3 queues, 4 stages), position of the element, rule."""
    pos = pos if isinstance(pos, Column) else F.lit(pos)
    return F.struct(F.lit(field).alias("field"), message.alias("message"), F.lit(section).cast("long").alias("section"),
                    pos.cast("long").alias("position"), F.lit(rule).cast("long").alias("rule"))


def with_sorted(specs: DataFrame) -> DataFrame:
    """Project the sorted queue/stage arrays and queue names once, so the
    per-element rules read columns instead of re-sorting per element."""
    typed = "type" in specs.schema["queues"].dataType.elementType.names
    kind = F.array_sort(F.transform("queues", lambda q: F.struct(
        q["name"].alias("name"), q["capacity"].alias("capacity"), q["schema_id"].alias("schema_id"),
        (q["type"] if typed else F.lit(None).cast("string")).alias("type"))))
    return (specs.withColumn("_q", kind).withColumn("_st", sorted_stages())
                 .withColumn("_names", F.transform("_q", lambda x: x["name"])))


def runtime_violations(kinds: dict[str, str]) -> tuple[Column, Column]:
    """C10, the runtime's rules on queues and wiring; ``kinds`` has the kind of each
    stage type (of other types the wiring isn't judged)."""
    q, st = F.col("_q"), F.col("_st")
    said = lambda c: F.coalesce(c, F.lit("")) != ""
    qv = F.flatten(F.transform(q, lambda x, i: F.array(
        F.when(F.coalesce(x["capacity"], F.lit(0)) <= 0, _viol("queues.capacity", F.format_string(R.MSG_CAPACITY, x["name"]), 3, i, 0)),
        F.when(x["schema_id"] == "", _viol("queues.schema", F.format_string(R.MSG_SCHEMA_ID, x["name"]), 3, i, 1)),
        F.when(x["type"].isNotNull() & ~x["type"].isin(*R.QUEUE_TYPES),
               _viol("queues.type", F.format_string(R.MSG_QUEUE_TYPE, x["name"]), 3, i, 2)))))

    def wrong(x, i):
        hit = F.lit(None)
        for kind, (has_in, has_out) in R.WIRING.items():
            types = [t for t, k in kinds.items() if k == kind]
            if types:
                bad = (said(x["input_queue"]) != F.lit(has_in)) | (said(x["output_queue"]) != F.lit(has_out))
                hit = F.when(x["type"].isin(*types) & bad, F.lit(kind)).otherwise(hit)
        return F.when(hit.isNotNull(), _viol("stages.wiring", F.format_string(R.MSG_WIRING, hit, x["name"]), 4, i, 0))
    return qv, F.transform(st, wrong)


def violations(specs: DataFrame, key: str = "flow_id", kinds: dict[str, str] | None = None) -> Column:
    """C2-C9, and C10 with ``kinds`` (:func:`runtime_violations`), of one spec row as an array of
    (field, message, section, position, rule), the last three giving the reference's check order:
    the spec's own rules first, the runtime's after them. Expects :func:`with_sorted`."""
    q, st, names = F.col("_q"), F.col("_st"), F.col("_names")
    empty = lambda c: F.coalesce(c, F.lit("")) == ""
    flow = F.array(
        F.when(F.col("name").isNull() & F.col("stages").isNull(), _viol("spec", F.lit(MSG_NIL), 0, 0, 0)),
        F.when(empty(F.col("name")), _viol("name", F.lit(MSG_NAME), 0, 0, 1)),
        F.when(F.coalesce(F.size("stages"), F.lit(0)) <= 0, _viol("stages", F.lit(MSG_STAGES), 0, 0, 2)))
    qv = F.flatten(F.transform(q, lambda x, i: F.array(
        F.when(empty(x["name"]), _viol("queues.name", F.lit(MSG_QUEUE_NAME), 1, i, 0)),
        F.when(~empty(x["name"]) & (F.get(q, i - 1)["name"] == x["name"]),
               _viol("queues.name", F.format_string(MSG_QUEUE_DUP, quoted(x["name"])), 1, i, 1)))))
    sv = F.flatten(F.transform(st, lambda x, i: F.array(
        F.when(empty(x["name"]), _viol("stages.name", F.lit(MSG_STAGE_NAME), 2, i, 0)),
        F.when(~empty(x["name"]) & (F.get(st, i - 1)["name"] == x["name"]),
               _viol("stages.name", F.format_string(MSG_STAGE_DUP, quoted(x["name"])), 2, i, 1)),
        F.when(empty(x["type"]),
               _viol("stages.type", F.format_string(MSG_TYPE, quoted(x["name"])), 2, i, 2)),
        F.when(F.coalesce(x["threads"], F.lit(0)) < 1,
               _viol("stages.threads", F.format_string(MSG_THREADS, quoted(x["name"])), 2, i, 3)),
        F.when(x["input_queue"].isNotNull() & ~F.coalesce(F.array_contains(names, x["input_queue"]), F.lit(False)),
               _viol("stages.input_queue", F.format_string(MSG_INPUT, quoted(x["name"]), quoted(x["input_queue"])),
                     2, i, 4)),
        F.when(x["output_queue"].isNotNull() & ~F.coalesce(F.array_contains(names, x["output_queue"]), F.lit(False)),
               _viol("stages.output_queue", F.format_string(MSG_OUTPUT, quoted(x["name"]), quoted(x["output_queue"])),
                     2, i, 5)))))
    more = runtime_violations(kinds) if kinds is not None else ()
    allv = F.concat(flow, *[F.coalesce(v, F.array()) for v in (qv, sv, *more)])
    return F.filter(allv, lambda v: v.isNotNull())


def validate(specs: DataFrame, key: str = "flow_id", kinds: dict[str, str] | None = None) -> DataFrame:
    """Every violation (the reference stops at the first in order, see
    :func:`first_errors`). One projection + explode per spec row."""
    w = with_sorted(specs)
    return (w.select(key, F.explode(violations(w, key, kinds)).alias("v"))
             .select(key, "v.field", "v.message", "v.section", "v.position", "v.rule"))


def first_errors(violations_df: DataFrame, key: str = "flow_id") -> DataFrame:
    """What the reference returns: the first violation per spec."""
    return violations_df.groupBy(key).agg(F.min_by(F.struct("field", "message"), F.struct("section", "position", "rule")).alias("e")) \
                        .select(key, "e.field", "e.message")


def first_error(specs: DataFrame, key: str = "flow_id", kinds: dict[str, str] | None = None) -> DataFrame:
    """The reference's answer per spec: the violation with the smallest
    place in that order, via a partial aggregation over the (small) violations frame.
    Computing it row-locally would make Catalyst inline the whole rule set
    once per extracted field."""
    return first_errors(validate(specs, key, kinds), key)


def validation_summary(specs: DataFrame, key: str = "flow_id", kinds: dict[str, str] | None = None) -> DataFrame:
    w = with_sorted(specs)
    flags = w.select((F.size(violations(w, key, kinds)) > 0).alias("_bad"))
    return flags.agg(F.count(F.when(~F.col("_bad"), 1)).alias("valid"),
                     F.count(F.when(F.col("_bad"), 1)).alias("invalid"))


def _sealed(c: Column) -> Column:
    """A value as text that can't run into its neighbours: length, colon, text; null is its own mark."""
    t = c.cast("string")
    return F.coalesce(F.concat(F.length(t).cast("string"), F.lit(":"), t), F.lit("-"))


def fingerprint(cols: list[str]) -> Column:
    """C11 for rows: SHA-256 hex, equal only for rows equal in every column."""
    return F.sha2(F.concat(*[_sealed(F.col(c)) for c in cols]), 256)


def spec_fingerprint(specs: DataFrame, key: str = "flow_id") -> DataFrame:
    """C11 for specs: SHA-256 of the normalised spec, so that the order of
    declarations and an unset capacity don't matter."""
    n = normalize(specs, key)
    part = lambda x, names: F.concat(*[_sealed(x[c]) for c in names])
    q = F.concat_ws(";", F.transform("queues", lambda x: part(x, ("name", "capacity", "schema_id"))))
    st = F.concat_ws(";", F.transform("stages", lambda x: part(x, ("name", "type", "threads", "input_queue", "output_queue"))))
    return n.select(key, F.sha2(F.concat(_sealed(F.col("name")), _sealed(q), _sealed(st)), 256).alias("fingerprint"))


def diff_lines(pairs: DataFrame, *keys: str) -> DataFrame:
    """C12 on a frame holding both versions side by side
    (``a_name, a_q, a_s, b_name, b_q, b_s``): ``field: a → b`` lines, only
    for the fields that changed."""
    lines = F.array(
        F.when(F.col("a_name") != F.col("b_name"),
               F.format_string("name: %s → %s", quoted("a_name"), quoted("b_name"))),
        F.when(F.col("a_q") != F.col("b_q"), F.format_string("queues: %d → %d", "a_q", "b_q")),
        F.when(F.col("a_s") != F.col("b_s"), F.format_string("stages: %d → %d", "a_s", "b_s")))
    return pairs.select(*(keys or ("flow_id",)), F.explode(F.filter(lines, lambda x: x.isNotNull())).alias("change"))


def diff(a: DataFrame, b: DataFrame, key: str = "flow_id") -> DataFrame:
    """C12 between two spec tables (joined on ``key``)."""
    j = a.select(key, F.col("name").alias("a_name"), F.size("queues").alias("a_q"), F.size("stages").alias("a_s")) \
         .join(b.select(key, F.col("name").alias("b_name"), F.size("queues").alias("b_q"),
                        F.size("stages").alias("b_s")), key, "inner")
    return diff_lines(j, key)


def stage_references(specs: DataFrame, key: str = "flow_id") -> DataFrame:
    """C8/C9 inside each spec: every normalised stage with flags telling
    whether its input / output queue is declared by the same spec (a
    membership test on the row's own queue names, no join)."""
    names = F.transform("queues", lambda q: q["name"])
    n = normalize(specs, key).withColumn("_names", names)
    return (n.select(key, "_names", F.posexplode("stages").alias("pos", "s"))
             .select(key, F.col("pos").cast("long").alias("pos"), "s.name", "s.input_queue", "s.output_queue",
                     F.coalesce(F.array_contains("_names", F.col("s.input_queue")), F.lit(False)).alias("input_ok"),
                     F.coalesce(F.array_contains("_names", F.col("s.output_queue")), F.lit(False)).alias("output_ok")))


def json_roundtrip(specs: DataFrame, key: str = "flow_id") -> DataFrame:
    """Encode each spec to JSON, decode it back with the same schema and
    compare field by field."""
    body = F.struct("name", "queues", "stages")
    schema = specs.select(body.alias("b")).schema["b"].dataType
    enc = specs.select(key, body.alias("orig"), F.to_json(body).alias("json"))
    dec = enc.withColumn("back", F.from_json("json", schema, {"mode": "FAILFAST"}))
    return dec.select(key, (F.col("back") == F.col("orig")).alias("roundtrip_ok"),
                      F.size("back.stages").cast("long").alias("n_stages"),
                      F.size("back.queues").cast("long").alias("n_queues"))
