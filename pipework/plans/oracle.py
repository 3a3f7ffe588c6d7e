"""Independent DuckDB SQL for every checked query.

The base tables are views registered by the checker. Derived inputs are
re-declared here as CTEs straight from the derivation rules (they do not
reuse any Spark code), so a wrong Spark operator cannot agree with its own
oracle by construction.
"""

from __future__ import annotations

MS_BOUNDS = (0.0, 5.0, 10.0, 25.0, 50.0, 75.0, 100.0, 250.0, 500.0, 750.0,
             1000.0, 2500.0, 5000.0, 7500.0, 10000.0)
S_BOUNDS = (0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0)
NS_BOUNDS = tuple(b * 1e6 for b in MS_BOUNDS)

FIX = {
    "ev": """SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events""",
    "payloads": """SELECT event_id, ts, user_id, event_type, value, k,
        encode(props) AS payload, CAST(octet_length(encode(props)) AS BIGINT) AS size,
        ts AS enqueue_ts, md5(CAST(user_id AS VARCHAR)) AS trace_id,
        substr(md5(CAST(event_id AS VARCHAR)), 1, 16) AS span_id, k * 3 AS flags,
        CASE event_type WHEN 'click' THEN '' WHEN 'error' THEN 'wrong' ELSE 'events' END AS schema_id
        FROM ev""",
    "rt": """SELECT ts, event_id, event_type AS queue, event_type AS stage,
        schema_id IN ('', 'events') AS enqueued, schema_id NOT IN ('', 'events') AS error,
        CASE WHEN schema_id IN ('', 'events')
             THEN make_timestamp(epoch_us(ts) + CAST(round(value * 1000.0) AS BIGINT)) END AS dequeue_ts,
        value * 1e6 AS dwell_ns, value * 1e6 AS latency_ns
        FROM payloads""",
    "access": """SELECT ts, event_id AS request_id, user_id, event_type, k,
        CASE WHEN k % 2 = 0 THEN 'GET' ELSE 'POST' END AS method,
        '/v1/' || event_type AS route,
        CAST(CASE WHEN k % 20 = 0 THEN 503 WHEN k % 10 = 5 THEN 404 ELSE 200 END AS BIGINT) AS status,
        value AS latency_ms, '/pipelines.v1.FlowService/' || event_type AS rpc_method,
        'flow-api' AS service
        FROM ev""",
    "reconcile": """SELECT ts, request_id, 'flow_' || CAST(user_id % 20 AS VARCHAR) AS flow_name,
        status < 500 AS ok, latency_ms AS duration_ms FROM access""",
    "work": """SELECT ts, event_id AS seq, user_id AS key,
        CASE WHEN event_type = 'view' THEN 'get' ELSE 'add' END AS op FROM events""",
    "logs": """SELECT TIMESTAMP '2024-01-01 00:00:00' + to_minutes(doc_id) AS ts, source AS service,
        CASE WHEN doc_id % 10 = 0 THEN 'error' ELSE 'info' END AS severity, text AS message, doc_id
        FROM documents""",
    "spans": """SELECT trace_id, span_id,
        lag(span_id) OVER (PARTITION BY trace_id ORDER BY ts, event_id) AS parent_span_id,
        event_type AS service, ts AS start_ts,
        make_timestamp(epoch_us(ts) + CAST(round(value * 1000.0) AS BIGINT)) AS end_ts,
        CASE WHEN event_type = 'error' THEN 'error' ELSE 'ok' END AS status, event_id
        FROM payloads""",
    "oplog": """SELECT 'flow_' || CAST(o_custkey AS VARCHAR) AS name, o_orderdate AS ts, o_orderkey AS seq,
        CASE o_orderstatus WHEN 'O' THEN 'put' WHEN 'P' THEN 'delete' ELSE 'rollback' END AS op,
        CASE WHEN o_orderstatus = 'F' THEN o_orderkey % 3 + 1 END AS version,
        CASE WHEN o_orderstatus = 'O' THEN o_totalprice END AS spec
        FROM orders""",
    "kv": """SELECT TIMESTAMP '2024-01-01 00:00:00' + to_seconds((o_orderkey * 7919) % 2592000) AS ts, o_orderkey AS rev,
        '/pipelines/flows/flow_' || CAST(o_custkey AS VARCHAR) ||
          CASE o_orderkey % 4 WHEN 0 THEN '/status' WHEN 1 THEN '/active'
               ELSE '/versions/' || CAST(1 + (o_orderkey // 4) % 3 AS VARCHAR) || '/spec' END AS key,
        CASE WHEN o_orderstatus = 'P' THEN 'delete' ELSE 'put' END AS op,
        CASE WHEN o_orderstatus = 'P' THEN NULL WHEN o_orderkey % 4 <> 1 THEN CAST(CAST(floor(o_totalprice) AS BIGINT) AS VARCHAR)
             WHEN o_orderkey % 29 = 0 THEN 'latest' ELSE CAST(1 + (o_orderkey // 4) % 3 AS VARCHAR) END AS value
        FROM orders""",
    "spec_lines": """SELECT l_orderkey AS flow_id,
        CASE WHEN l_orderkey % 97 = 0 THEN '' ELSE 'f' || CAST(l_orderkey AS VARCHAR) END AS flow,
        l_linenumber AS pos, 's' || CAST(l_partkey % 50 AS VARCHAR) AS stage_name,
        CASE WHEN l_returnflag = 'R' THEN '' ELSE l_returnflag END AS stage_type,
        CAST(CAST(trunc(l_quantity) AS BIGINT) % 4 AS BIGINT) AS threads,
        'q' || CAST(l_suppkey % 10 AS VARCHAR) AS input_queue,
        CASE WHEN l_linenumber % 2 = 0 THEN 'q' || CAST((l_suppkey + 1) % 10 AS VARCHAR) END AS output_queue,
        l_linenumber % 5 <> 0 AS declares_queue,
        CAST((l_linenumber % 3) * 64 AS BIGINT) AS capacity, l_shipdate AS shipdate
        FROM lineitem""",
}
DEPS = {
    "payloads": ["ev"], "rt": ["ev", "payloads"], "access": ["ev"],
    "reconcile": ["ev", "access"], "spans": ["ev", "payloads"],
}


def with_(*names: str) -> str:
    order: list[str] = []
    for n in names:
        for d in DEPS.get(n, []) + [n]:
            if d not in order:
                order.append(d)
    return "WITH " + ",\n".join(f"{n} AS ({FIX[n]})" for n in order) + "\n"


def le_case(v: str, bounds) -> str:
    parts = " ".join(f"WHEN {v} <= {float(b)!r} THEN {float(b)!r}" for b in sorted(bounds))
    return f"CASE {parts} ELSE 'inf'::DOUBLE END"


def lower_case(le: str, bounds) -> str:
    bs = sorted(float(b) for b in bounds)
    parts = [f"WHEN {le} = {bs[0]!r} THEN 0.0"]
    parts += [f"WHEN {le} = {cur!r} THEN {prev!r}" for prev, cur in zip(bs, bs[1:])]
    return f"CASE {' '.join(parts)} ELSE {bs[-1]!r} END"


def quantile_sql(src: str, value: str, keys: list[str], bounds, q: float = 0.95,
                 scale: float = 1.0, step: int = 60, ts: str = "ts") -> str:
    """Bucketed quantile per (step bucket, keys) as a SELECT over ``src``."""
    k = ", ".join(keys)
    kc = (", " + k) if keys else ""
    part = "b" + kc
    sc = f" / {float(scale)!r}" if scale != 1.0 else ""
    return f"""
    qc AS (SELECT CAST(floor(epoch_us({ts}) / {step * 1000000}.0) AS BIGINT) AS b{kc},
                  {le_case(value, bounds)} AS le, count(*) AS cnt
           FROM {src} GROUP BY ALL),
    qs AS (SELECT *, sum(cnt) OVER (PARTITION BY {part} ORDER BY le ROWS UNBOUNDED PRECEDING) AS cum,
                  sum(cnt) OVER (PARTITION BY {part}) AS tot FROM qc),
    qp AS (SELECT {part}, min(le) AS le FROM qs WHERE cum >= {q!r} * tot GROUP BY ALL),
    qv AS (SELECT qs.b{''.join(', qs.' + c for c in keys)}, qs.le, qs.cnt, qs.cum, qs.tot
           FROM qs JOIN qp USING ({part}, le)),
    qr AS (SELECT make_timestamp((b + 1) * {step * 1000000}) AS ts{kc},
             CASE WHEN le = 'inf'::DOUBLE THEN {float(max(bounds))!r}
                  ELSE ({lower_case('le', bounds)}) + (le - ({lower_case('le', bounds)}))
                       * ({q!r} * tot - (cum - cnt)) / cnt END{sc} AS v
           FROM qv)
    """


# ---------------------------------------------------------------------------
# dashboard panels
# ---------------------------------------------------------------------------
def _state(v: str, thr: float) -> str:
    return f"CASE WHEN {v} >= {float(thr)!r} THEN 'red' ELSE 'green' END"


def _legend(keys) -> str:
    return "concat_ws(' ', " + ", ".join(f"CAST({k} AS VARCHAR)" for k in keys) + ")"


def rate_sql(fix: list[str], src: str, keys: list[str], thr: float, ts: str = "ts",
             extra: str = "") -> str:
    kc = "".join(", " + k for k in keys)
    leg = f", {_legend(keys)} AS legend" if keys else ""
    return with_(*fix) + (", " + extra if extra else "") + f""", r AS (
        SELECT CAST(floor(epoch_us({ts}) / 60000000.0) AS BIGINT) AS b{kc}, count(*) AS n
        FROM {src} GROUP BY ALL)
    SELECT make_timestamp((b + 1) * 60000000) AS ts{kc}, round(n / 60.0, 6) AS value{leg},
           {_state('round(n / 60.0, 6)', thr)} AS state FROM r"""


def p95_sql(fix: list[str], src: str, value: str, keys: list[str], bounds, thr: float,
            scale: float = 1.0) -> str:
    kc = "".join(", " + k for k in keys)
    leg = f", {_legend(keys)} AS legend" if keys else ""
    return with_(*fix) + "," + quantile_sql(src, value, keys, bounds, scale=scale) + f"""
    SELECT ts{kc}, round(v, 6) AS value{leg}, {_state('round(v, 6)', thr)} AS state FROM qr"""


def stat_sql(fix: list[str], src: str, thr: float, ts: str = "ts") -> str:
    return with_(*fix) + f""", r AS (
        SELECT CAST(floor(epoch_us({ts}) / 60000000.0) AS BIGINT) AS b, count(*) / 60.0 AS v
        FROM {src} GROUP BY ALL),
    l AS (SELECT make_timestamp((max(b) + 1) * 60000000) AS ts, arg_max(v, b) AS v FROM r)
    SELECT ts, round(v, 6) AS value, {_state('round(v, 6)', thr)} AS state FROM l"""


DEPTH = """depth_d AS (
        SELECT ts, CAST(op = 'add' AS BIGINT)
             - coalesce(lag(CAST(op = 'add' AS BIGINT)) OVER (PARTITION BY key ORDER BY ts, seq), 0) AS d
        FROM work),
    depth_m AS (SELECT CAST(floor(epoch_us(ts) / 60000000.0) AS BIGINT) AS b, sum(d) AS d FROM depth_d GROUP BY b),
    depth_r AS (SELECT unnest(range((SELECT min(b) FROM depth_m), (SELECT max(b) FROM depth_m) + 1)) AS b),
    depth AS (SELECT make_timestamp((r.b + 1) * 60000000) AS ts,
                     CAST(sum(coalesce(m.d, 0)) OVER (ORDER BY r.b ROWS UNBOUNDED PRECEDING) AS BIGINT) AS depth
              FROM depth_r r LEFT JOIN depth_m m ON m.b = r.b)"""

LAG = """lag_seg AS (
        SELECT *, sum(CAST(op = 'get' AS BIGINT)) OVER (PARTITION BY key ORDER BY ts, seq ROWS UNBOUNDED PRECEDING)
                  - CAST(op = 'get' AS BIGINT) AS seg FROM work),
    lag_add AS (
        SELECT *, max(CASE WHEN op = 'add' THEN ts END) OVER (PARTITION BY key, seg ORDER BY ts, seq
                  ROWS UNBOUNDED PRECEDING) AS last_add FROM lag_seg),
    lags AS (SELECT ts, seq, key, coalesce((epoch_us(ts) - epoch_us(last_add)) / 1e6, 0.0) AS lag_s
             FROM lag_add WHERE op = 'get')"""

VERSIONS = """kv_n AS (SELECT *, split_part(key, '/', 4) AS name, row_number() OVER (ORDER BY ts, rev) AS n FROM kv),
    vers AS (SELECT name, split_part(key, '/', 6) AS version, n, ts, op, value FROM kv_n WHERE key LIKE '%/versions/%/spec')"""

WATCH = VERSIONS + """,
    w_prev AS (
        SELECT *, lag(op) OVER (PARTITION BY key ORDER BY n) AS prev FROM kv_n WHERE key LIKE '%/active'),
    w_ev AS (
        SELECT ts, rev, n, name AS flow,
               CASE WHEN op = 'delete' THEN CASE WHEN prev = 'put' THEN 'DELETED' END
                    WHEN prev IS NULL OR prev = 'delete' THEN 'ADDED' ELSE 'UPDATED' END AS event_type,
               CASE WHEN op = 'put' AND regexp_full_match(value, '[0-9]+') THEN value END AS version
        FROM w_prev),
    watch AS (
        SELECT e.ts, e.rev, e.flow, e.event_type, CAST(e.version AS BIGINT) AS version, CASE WHEN v.op = 'put' THEN v.value END AS spec
        FROM (SELECT * FROM w_ev WHERE event_type IS NOT NULL AND (event_type = 'DELETED' OR version IS NOT NULL)) e
        ASOF LEFT JOIN vers v ON e.flow = v.name AND e.version = v.version AND e.n >= v.n)"""


def _logs_sql(service: str) -> str:
    return with_("logs") + f"""SELECT ts, service, severity, message, doc_id FROM logs
        WHERE service = '{service}' ORDER BY ts DESC, doc_id DESC"""


def _traces_sql(service: str, limit: int | None = 20) -> str:
    return with_("spans") + f""", hit AS (SELECT DISTINCT trace_id FROM spans WHERE service = '{service}'),
    t AS (SELECT trace_id, min(start_ts) AS start_ts, max(end_ts) AS end_ts, count(*) AS span_count,
                 arg_min(service, (start_ts, span_id)) AS root_service
          FROM spans WHERE trace_id IN (SELECT trace_id FROM hit) GROUP BY trace_id)
    SELECT trace_id, root_service, start_ts, span_count,
           round((epoch_us(end_ts) - epoch_us(start_ts)) / 1000.0, 3) AS duration_ms
    FROM t ORDER BY start_ts DESC, trace_id DESC""" + (f" LIMIT {limit}" if limit else "")


def panel_sql() -> dict[str, str]:
    rt_deq = "(SELECT dequeue_ts AS ts, queue, dwell_ns FROM rt WHERE dequeue_ts IS NOT NULL)"
    ok = "(SELECT * FROM reconcile WHERE ok)"
    fail = "(SELECT * FROM reconcile WHERE NOT ok)"
    s = {
        "rt_enqueue": rate_sql(["rt"], "(SELECT * FROM rt WHERE enqueued)", ["queue"], 80),
        "rt_dequeue": rate_sql(["rt"], rt_deq, ["queue"], 80),
        "rt_dwell_p95": p95_sql(["rt"], rt_deq, "dwell_ns", ["queue"], NS_BOUNDS, 500, 1e6),
        "rt_stage_rate": rate_sql(["rt"], "(SELECT * FROM rt WHERE enqueued)", ["stage"], 80),
        "rt_stage_p95": p95_sql(["rt"], "(SELECT * FROM rt WHERE enqueued)", "latency_ns", ["stage"],
                                NS_BOUNDS, 500, 1e6),
        "rt_stage_errors": rate_sql(["rt"], "(SELECT * FROM rt WHERE error)", ["stage"], 5),
        "api_http_rate": rate_sql(["access"], "access", ["method", "route", "status"], 80),
        "api_http_p95": p95_sql(["access"], "access", "latency_ms", ["method", "route"], MS_BOUNDS, 500),
        "api_grpc_rate": rate_sql(["access"], "access", ["rpc_method"], 80),
        "api_grpc_p95": p95_sql(["access"], "access", "latency_ms", ["rpc_method"], MS_BOUNDS, 500),
        "ctl_reconcile_ok": rate_sql(["reconcile"], ok, ["flow_name"], 5),
        "ctl_reconcile_fail": rate_sql(["reconcile"], fail, ["flow_name"], 1),
        "ctl_watch_rate": rate_sql(["kv"], "watch", ["event_type"], 10, extra=WATCH),
        "ctl_queue_depth": with_("work") + ", " + DEPTH + f"""
            SELECT ts, round(depth, 6) AS value, {_state('round(depth, 6)', 50)} AS state FROM depth""",
        "ctl_queue_lag_p95": with_("work") + ", " + LAG + ", lagf AS (SELECT ts, 'flow_' || CAST(key % 20 AS VARCHAR) AS flow_name, lag_s FROM lags)," + quantile_sql("lagf", "lag_s", ["flow_name"], S_BOUNDS) + f"""
            SELECT ts, flow_name, round(v, 6) AS value, flow_name AS legend, {_state('round(v, 6)', 5)} AS state FROM qr""",
        "ovw_http_rate": stat_sql(["access"], "access", 1),
        "ovw_http_5xx": stat_sql(["access"], "(SELECT * FROM access WHERE regexp_full_match(CAST(status AS VARCHAR), '5..'))", 1),
        "ovw_http_p95": with_("access") + "," + quantile_sql("access", "latency_ms", [], MS_BOUNDS) + f"""
            , l AS (SELECT max(ts) AS ts, arg_max(v, ts) AS v FROM qr)
            SELECT ts, round(v, 6) AS value, {_state('round(v, 6)', 500)} AS state FROM l""",
        "ovw_enqueue": stat_sql(["rt"], "(SELECT * FROM rt WHERE enqueued)", 80),
        "ovw_dequeue": stat_sql(["rt"], rt_deq, 80),
        "ovw_stage_errors": stat_sql(["rt"], "(SELECT * FROM rt WHERE error)", 1),
        "ovw_reconcile_ok": stat_sql(["reconcile"], ok, 80),
        "ovw_reconcile_fail": stat_sql(["reconcile"], fail, 1),
        "ovw_queue_depth": with_("work") + ", " + DEPTH + f"""
            , l AS (SELECT max(ts) AS ts, arg_max(depth, ts) AS v FROM depth)
            SELECT ts, round(v, 6) AS value, {_state('round(v, 6)', 10)} AS state FROM l""",
        "api_logs": _logs_sql("src1"), "ctl_logs": _logs_sql("src2"), "rt_logs": _logs_sql("src3"),
        "api_traces": _traces_sql("click"), "ctl_traces": _traces_sql("view"), "rt_traces": _traces_sql("purchase", None),
    }
    newest = {"rt_dwell_p95": ("rt", "ts"), "api_http_rate": ("access", "ts"),
              "ctl_queue_depth": ("work", "ts")}
    for k, (src, ts) in newest.items():
        s[f"{k}_6h"] = f"""SELECT p.* FROM ({s[k]}) p WHERE p.{ts} > (SELECT n - INTERVAL 6 HOUR FROM ({with_(src)}
            SELECT max({ts}) AS n FROM {src}))"""
    s["ovw_http_5xx_6h"] = f"""SELECT max(ts) AS ts, max(value) AS value, coalesce(max(state), 'green') AS state FROM ({s["ovw_http_5xx"]}) p
        WHERE ts > (SELECT n - INTERVAL 6 HOUR FROM ({with_("access")} SELECT max(ts) AS n FROM access))"""
    return s


# ---------------------------------------------------------------------------
# alert rules
# ---------------------------------------------------------------------------
# fixed values, stated a second time on purpose: an oracle shares nothing with the code it checks
RULES = {
    "alert_api_errors": ("ApiHighErrorRate", "api", 'Flow API 5xx error rate above "0.05"',
                         "The Flow API is returning elevated 5xx responses over the last 10m."),
    "alert_api_latency": ("ApiHighLatency", "api", "Flow API p95 latency above 500ms",
                          "The Flow API 95th percentile latency is higher than expected."),
    "alert_reconcile_failures": ("ControllerReconcileFailures", "controller", "Flow controller reconcile failures detected",
                                 "Flow controller reconcile failures were observed in the last 10m."),
    "alert_queue_depth": ("ControllerQueueDepthHigh", "controller", "Flow controller queue depth above 100",
                          "The controller work queue depth is elevated."),
    "alert_dwell": ("RuntimeQueueDwellHigh", "runtime", "Runtime queue dwell p95 above 5000ms",
                    "Runtime queues are taking longer than expected to process items."),
    "alert_stage_errors": ("RuntimeStageErrors", "runtime", "Runtime stage errors detected",
                           "Stage errors were detected in the last 10m."),
}


def _bucket(ts: str = "ts") -> str:
    return f"CAST(floor(epoch_us({ts}) / 60000000.0) AS BIGINT) + 1"


def _alert_tail(key: str, cond: str) -> str:
    """``cond`` is a CTE (e BIGINT minute-end index, v DOUBLE) of true instants."""
    name, comp, summ, text = RULES[key]
    summ = summ.replace("'", "''")
    return f""", isl AS (SELECT e, v, e - row_number() OVER (ORDER BY e) AS g FROM {cond}),
    fa AS (SELECT e, v, min(e) OVER (PARTITION BY g) AS s FROM isl)
    SELECT '{name}' AS alertname, make_timestamp(e * 60000000) AS ts, round(v, 6) AS value,
           make_timestamp(s * 60000000) AS active_since,
           CASE WHEN (e - s) * 60 >= 600 THEN 'firing' ELSE 'pending' END AS state,
           'warning' AS severity, '{comp}' AS component, '{summ}' AS summary, '{text}' AS description
    FROM fa"""


def _grid_quantile(src: str, value: str, bounds, window_min: int) -> str:
    return f"""gq AS (SELECT {_bucket()} AS e, {le_case(value, bounds)} AS le, count(*) AS cnt FROM {src} GROUP BY ALL),
    gg AS (SELECT e + k AS e, le, sum(cnt) AS cnt FROM gq, range(0, {window_min}) r(k) GROUP BY ALL),
    gs AS (SELECT *, sum(cnt) OVER (PARTITION BY e ORDER BY le ROWS UNBOUNDED PRECEDING) AS cum,
                  sum(cnt) OVER (PARTITION BY e) AS tot FROM gg),
    gp AS (SELECT e, min(le) AS le FROM gs WHERE cum >= 0.95 * tot GROUP BY e),
    gv AS (SELECT gs.* FROM gs JOIN gp USING (e, le)),
    gr AS (SELECT e, CASE WHEN le = 'inf'::DOUBLE THEN {float(max(bounds))!r}
                  ELSE ({lower_case('le', bounds)}) + (le - ({lower_case('le', bounds)}))
                       * (0.95 * tot - (cum - cnt)) / cnt END AS v FROM gv)"""


def alert_sql() -> dict[str, str]:
    s = {}
    s["alert_api_errors"] = with_("access") + f""", per AS (
        SELECT {_bucket()} AS e, count(*) AS tot,
               count(CASE WHEN regexp_full_match(CAST(status AS VARCHAR), '5..') THEN 1 END) AS err
        FROM access GROUP BY 1),
    w AS (SELECT e + k AS e, sum(tot) AS tot, sum(err) AS err FROM per, range(0, 10) r(k) GROUP BY 1),
    c AS (SELECT e, err / tot AS v FROM w WHERE tot >= 20 AND err / tot > 0.05)""" + _alert_tail("alert_api_errors", "c")
    s["alert_api_latency"] = with_("access") + ", " + _grid_quantile("access", "latency_ms", MS_BOUNDS, 5) + \
        ", c AS (SELECT e, v FROM gr WHERE v > 500)" + _alert_tail("alert_api_latency", "c")
    s["alert_reconcile_failures"] = with_("reconcile") + f""", per AS (
        SELECT {_bucket()} AS e, count(*) AS n FROM reconcile WHERE NOT ok GROUP BY 1),
    c AS (SELECT e + k AS e, CAST(sum(n) AS DOUBLE) AS v FROM per, range(0, 10) r(k) GROUP BY 1 HAVING sum(n) >= 1)""" + \
        _alert_tail("alert_reconcile_failures", "c")
    s["alert_queue_depth"] = with_("work") + ", " + DEPTH + f""",
    c AS (SELECT CAST(epoch_us(ts) / 60000000 AS BIGINT) + k AS e, CAST(max(depth) AS DOUBLE) AS v
          FROM depth, range(0, 10) r(k) GROUP BY 1 HAVING max(depth) > 100)""" + _alert_tail("alert_queue_depth", "c")
    deq = "(SELECT dequeue_ts AS ts, dwell_ns FROM rt WHERE dequeue_ts IS NOT NULL)"
    s["alert_dwell"] = with_("rt") + ", " + _grid_quantile(deq, "dwell_ns", NS_BOUNDS, 5) + \
        ", c AS (SELECT e, v / 1e6 AS v FROM gr WHERE v / 1e6 > 5000)" + _alert_tail("alert_dwell", "c")
    s["alert_stage_errors"] = with_("rt") + f""", per AS (
        SELECT {_bucket()} AS e, count(*) AS n FROM rt WHERE error GROUP BY 1),
    c AS (SELECT e + k AS e, CAST(sum(n) AS DOUBLE) AS v FROM per, range(0, 10) r(k) GROUP BY 1 HAVING sum(n) >= 1)""" + \
        _alert_tail("alert_stage_errors", "c")
    return s


# ---------------------------------------------------------------------------
# generic monitoring operators and record-derived metrics
# ---------------------------------------------------------------------------
SAMPLES = """smp_m AS (SELECT CAST(floor(epoch_us(ts) / 60000000.0) AS BIGINT) + 1 AS e, queue, count(*) AS n
                  FROM rt WHERE enqueued GROUP BY ALL),
    samples AS (SELECT make_timestamp(e * 60000000) AS ts, queue,
                       CAST(sum(n) OVER (PARTITION BY queue, (e * 60000000 - 1) // 86400000000
                                         ORDER BY e ROWS UNBOUNDED PRECEDING) AS DOUBLE) AS value
                FROM smp_m)"""

INCREASE = """inc_d AS (SELECT queue, ts, value, lag(value) OVER (PARTITION BY queue ORDER BY ts) AS prev FROM samples),
    inc_x AS (SELECT queue, ts, epoch_us(ts) AS us,
                     CASE WHEN prev IS NULL THEN 0.0 WHEN value < prev THEN value ELSE value - prev END AS delta
              FROM inc_d)"""


def _inc_window(w_s: int) -> str:
    return f"""sum(delta) OVER (PARTITION BY queue ORDER BY us RANGE BETWEEN {w_s * 1000000 - 1} PRECEDING AND CURRENT ROW)"""


def _qrate(src: str, keys: list[str]) -> str:
    kc = "".join(", " + k for k in keys)
    return f"""SELECT make_timestamp((CAST(floor(epoch_us(ts) / 60000000.0) AS BIGINT) + 1) * 60000000) AS ts{kc},
               count(*) / 60.0 AS value FROM {src} GROUP BY ALL"""


def monitoring_sql() -> dict[str, str]:
    s = {}
    s["sel_eq"] = with_("access") + """SELECT request_id, ts, status, latency_ms FROM access
        WHERE method = 'GET' AND route = '/v1/click'"""
    s["sel_regex"] = with_("access") + """SELECT request_id, ts, status FROM access
        WHERE regexp_full_match(CAST(status AS VARCHAR), '5..')"""
    s["increase_10m"] = with_("rt") + ", " + SAMPLES + ", " + INCREASE + f"""
        SELECT queue, ts, round({_inc_window(600)}, 6) AS increase FROM inc_x"""
    s["rate_1m"] = with_("rt") + ", " + SAMPLES + ", " + INCREASE + f"""
        SELECT queue, ts, round({_inc_window(60)} / 60.0, 6) AS rate FROM inc_x"""
    s["max_over_time"] = with_("work") + ", " + DEPTH + """
        SELECT ts, max(depth) OVER (ORDER BY epoch_us(ts) RANGE BETWEEN 599999999 PRECEDING AND CURRENT ROW) AS max_depth
        FROM depth"""
    qr = f"qr AS ({_qrate('(SELECT * FROM rt WHERE enqueued)', ['queue'])})"
    s["sum_all"] = with_("rt") + ", " + qr + " SELECT ts, round(sum(value), 6) AS value FROM qr GROUP BY ts"
    s["max_all"] = with_("rt") + ", " + qr + " SELECT ts, round(max(value), 6) AS value FROM qr GROUP BY ts"
    s["sum_by"] = with_("access") + f""", r AS ({_qrate('access', ['method', 'status'])})
        SELECT ts, status, round(sum(value), 6) AS value FROM r GROUP BY ts, status"""
    s["error_ratio"] = with_("access") + f""",
        e AS ({_qrate("(SELECT * FROM access WHERE regexp_full_match(CAST(status AS VARCHAR), '5..'))", [])}),
        t AS ({_qrate('access', [])})
        SELECT t.ts, round(CASE WHEN t.value = 0 THEN NULL ELSE e.value / t.value END, 6) AS ratio
        FROM e JOIN t ON e.ts = t.ts"""
    s["vector_and"] = with_("access") + f""",
        e AS ({_qrate("(SELECT * FROM access WHERE regexp_full_match(CAST(status AS VARCHAR), '5..'))", ['route'])}),
        t AS ({_qrate('access', ['route'])})
        SELECT ts, route, round(value, 6) AS value FROM e
        WHERE (ts, route) IN (SELECT (ts, route) FROM t WHERE value * 60 >= 2)"""
    s["hist_p95"] = with_("rt") + ", " + f"""hc AS (SELECT queue, {le_case('dwell_ns / 1e6', MS_BOUNDS)} AS le, count(*) AS cnt
            FROM rt WHERE dequeue_ts IS NOT NULL GROUP BY ALL),
        hs AS (SELECT *, sum(cnt) OVER (PARTITION BY queue ORDER BY le ROWS UNBOUNDED PRECEDING) AS cum,
                      sum(cnt) OVER (PARTITION BY queue) AS tot FROM hc),
        hp AS (SELECT queue, min(le) AS le FROM hs WHERE cum >= 0.95 * tot GROUP BY queue),
        hv AS (SELECT hs.* FROM hs JOIN hp USING (queue, le))
        SELECT queue, round(CASE WHEN le = 'inf'::DOUBLE THEN 10000.0 ELSE ({lower_case('le', MS_BOUNDS)})
               + (le - ({lower_case('le', MS_BOUNDS)})) * (0.95 * tot - (cum - cnt)) / cnt END, 6) AS p95_ms FROM hv"""
    s["p95_sketch"] = with_("access") + """ SELECT CAST(ts AS DATE) AS day, route, count(*) AS n, true AS within
        FROM access WHERE latency_ms IS NOT NULL GROUP BY 1, 2"""
    s["bucketize"] = with_("access") + f""", bc AS (SELECT route, {le_case('latency_ms', MS_BOUNDS)} AS le, count(*) AS cnt
            FROM access GROUP BY ALL)
        SELECT route, le, CAST(sum(cnt) OVER (PARTITION BY route ORDER BY le ROWS UNBOUNDED PRECEDING) AS BIGINT) AS cum
        FROM bc WHERE le <> 'inf'::DOUBLE
        UNION ALL SELECT route, 'inf'::DOUBLE AS le, CAST(sum(cnt) AS BIGINT) AS cum FROM bc GROUP BY route"""
    s["alert_for"] = with_("rt") + """, b AS (SELECT DISTINCT queue, CAST(floor(epoch_us(ts) / 60000000.0) AS BIGINT) + 1 AS e
            FROM rt WHERE enqueued),
        i AS (SELECT *, e - row_number() OVER (PARTITION BY queue ORDER BY e) AS g FROM b),
        f AS (SELECT *, min(e) OVER (PARTITION BY queue, g) AS st FROM i)
        SELECT queue, make_timestamp(e * 60000000) AS ts, make_timestamp(st * 60000000) AS active_since,
               CASE WHEN (e - st) * 60 >= 180 THEN 'firing' ELSE 'pending' END AS state FROM f"""
    s["last_not_null"] = with_("rt") + ", " + qr + """
        SELECT queue, max(ts) AS ts, round(arg_max(value, ts), 6) AS value FROM qr GROUP BY queue"""
    s["threshold_state"] = with_("access") + """, p AS (SELECT CAST(ts AS DATE) AS day, route, count(*) AS requests
            FROM access GROUP BY ALL)
        SELECT day, route, requests, CASE WHEN requests >= 80 THEN 'red' ELSE 'green' END AS state FROM p"""
    s["time_range"] = with_("access") + """SELECT request_id, ts, status FROM access
        WHERE ts >= (SELECT max(ts) FROM access) - INTERVAL 6 HOUR AND ts <= (SELECT max(ts) FROM access)"""
    s["logs_recent"] = _logs_sql("src0")
    s["traces_recent"] = _traces_sql("error")
    s["m_enqueue"] = with_("rt") + "SELECT queue, count(CASE WHEN enqueued THEN 1 END) AS enqueue FROM rt GROUP BY queue"
    s["m_dequeue"] = with_("rt") + "SELECT queue, count(dequeue_ts) AS dequeue FROM rt GROUP BY queue"
    s["m_dwell"] = with_("rt") + """, x AS (SELECT queue, (epoch_us(dequeue_ts) - epoch_us(ts)) * 1000 AS ns FROM rt)
        SELECT queue, count(*) AS n, round(sum(ns) / 1e6, 3) AS sum_ms, round(max(ns) / 1e6, 3) AS max_ms
        FROM x WHERE ns > 0 GROUP BY queue"""
    s["m_process"] = with_("rt") + "SELECT stage, count(CASE WHEN enqueued THEN 1 END) AS process FROM rt GROUP BY stage"
    s["m_latency"] = with_("rt") + """SELECT stage, count(*) AS n, round(sum(latency_ns) / 1e6, 3) AS sum_ms,
        round(max(latency_ns) / 1e6, 3) AS max_ms FROM rt WHERE enqueued GROUP BY stage"""
    s["m_errors"] = with_("rt") + "SELECT stage, count(CASE WHEN error THEN 1 END) AS errors FROM rt GROUP BY stage"
    s["m_reconcile"] = with_("reconcile") + """SELECT flow_name, count(CASE WHEN ok THEN 1 END) AS success,
        count(CASE WHEN NOT ok THEN 1 END) AS failure FROM reconcile GROUP BY flow_name"""
    s["m_http"] = with_("access") + """SELECT method, route, status, count(*) AS requests,
        CAST(sum(floor(latency_ms)) AS BIGINT) AS latency_ms_sum FROM access GROUP BY ALL"""
    s["m_grpc"] = with_("access") + """SELECT rpc_method, count(*) AS requests,
        count(CASE WHEN status >= 500 THEN 1 END) AS errors,
        CAST(sum(floor(latency_ms)) AS BIGINT) AS latency_ms_sum FROM access GROUP BY ALL"""
    s["span_status"] = with_("access") + """SELECT request_id,
        CASE WHEN status >= 500 THEN 'error' ELSE 'unset' END AS http_span_status,
        CASE WHEN status >= 500 THEN 'error' ELSE 'ok' END AS grpc_span_status FROM access"""
    s["span_chain"] = with_("payloads") + """SELECT trace_id, span_id,
        CASE WHEN trace_id <> repeat('0', 32) THEN lag(span_id) OVER (PARTITION BY trace_id ORDER BY ts, event_id) END AS parent_span_id,
        CASE WHEN trace_id <> repeat('0', 32) THEN row_number() OVER (PARTITION BY trace_id ORDER BY ts, event_id) END AS hop
        FROM payloads"""
    s["m_drops"] = with_("payloads") + """SELECT event_type AS queue, 'schema_mismatch' AS reason, count(*) AS dropped
        FROM payloads WHERE schema_id NOT IN ('', 'events') GROUP BY event_type"""
    s["m_queue_depth"] = with_("rt") + """, e AS (
        SELECT queue, CAST(floor(epoch_us(ts) / 60000000.0) AS BIGINT) AS b, 1 AS d FROM rt WHERE enqueued
        UNION ALL SELECT queue, CAST(floor(epoch_us(dequeue_ts) / 60000000.0) AS BIGINT), -1 FROM rt
        WHERE dequeue_ts IS NOT NULL),
        p AS (SELECT queue, b, sum(d) AS d FROM e GROUP BY queue, b),
        r AS (SELECT queue, b, sum(d) OVER (PARTITION BY queue ORDER BY b ROWS UNBOUNDED PRECEDING) AS depth FROM p),
        span AS (SELECT queue, min(b) AS lo, max(b) AS hi FROM p GROUP BY queue),
        grid AS (SELECT queue, unnest(generate_series(lo, hi)) AS b FROM span)
        SELECT g.queue, make_timestamp((g.b + 1) * 60000000) AS ts, CAST(r.depth AS BIGINT) AS depth
        FROM grid g ASOF JOIN r ON g.queue = r.queue AND g.b >= r.b"""
    s["trace_summary"] = with_("spans") + """SELECT trace_id, count(*) AS spans, min(start_ts) AS start_ts,
        max(end_ts) AS end_ts, round((epoch_us(max(end_ts)) - epoch_us(min(start_ts))) / 1000.0, 3) AS duration_ms,
        count(CASE WHEN status = 'error' THEN 1 END) AS error_spans,
        count(CASE WHEN parent_span_id IS NULL THEN 1 END) AS roots FROM spans GROUP BY trace_id"""
    return s


# ---------------------------------------------------------------------------
# versioned history, registry, gates, scalars
# ---------------------------------------------------------------------------
def _replay_ctes(src: str = "oplog") -> str:
    return f"""r1 AS (SELECT *, sum(CAST(op = 'delete' AS BIGINT)) OVER (PARTITION BY name ORDER BY ts, seq
                  ROWS UNBOUNDED PRECEDING) AS epoch FROM {src}),
    r2 AS (SELECT *, CAST(sum(CAST(op = 'put' AS BIGINT)) OVER (PARTITION BY name, epoch ORDER BY ts, seq
                  ROWS UNBOUNDED PRECEDING) AS BIGINT) AS puts FROM r1),
    r3 AS (SELECT *, CASE WHEN op = 'put' THEN puts
                          WHEN op = 'rollback' AND version >= 1 AND version <= puts THEN version END AS ptr,
                  CASE WHEN op = 'rollback' THEN version >= 1 AND version <= puts END AS valid FROM r2),
    r4 AS (SELECT *, last_value(ptr IGNORE NULLS) OVER (PARTITION BY name, epoch ORDER BY ts, seq
                  ROWS UNBOUNDED PRECEDING) AS active FROM r3),
    lastrow AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY ts DESC, seq DESC) AS rn
                FROM r4) WHERE rn = 1),
    cur AS (SELECT r4.* FROM r4 JOIN lastrow l ON r4.name = l.name AND r4.epoch = l.epoch),
    hv AS (SELECT c.name, c.puts AS version, c.spec, c.puts = l.active AS is_active
           FROM cur c JOIN lastrow l ON c.name = l.name WHERE c.op = 'put'),
    fl AS (SELECT name, version AS active_version, spec FROM hv WHERE is_active)"""


STATUS = """st AS (SELECT flow_name AS name, 'FLOW_STATE_DEPLOYING' AS state, 'flow runtime created' AS message,
                  flow_name || '-runtime' AS workload, max(ts) AS last_updated
           FROM reconcile WHERE ok GROUP BY flow_name)"""

CANON = """CASE lower(trim({f})) WHEN 'arrow' THEN 'IN_MEMORY_SCHEMA_FORMAT_ARROW'
        WHEN 'apache-arrow' THEN 'IN_MEMORY_SCHEMA_FORMAT_ARROW' WHEN 'json' THEN 'IN_MEMORY_SCHEMA_FORMAT_JSON'
        WHEN 'protobuf' THEN 'IN_MEMORY_SCHEMA_FORMAT_PROTOBUF' WHEN 'proto' THEN 'IN_MEMORY_SCHEMA_FORMAT_PROTOBUF'
        WHEN 'flatbuffers' THEN 'IN_MEMORY_SCHEMA_FORMAT_FLATBUFFERS'
        WHEN 'flatbuffer' THEN 'IN_MEMORY_SCHEMA_FORMAT_FLATBUFFERS' END"""

REGISTRY = f"""sops AS (SELECT p_brand AS schema_id, p_partkey AS seq,
          CASE WHEN p_size % 13 = 0 THEN 'delete' ELSE 'put' END AS op,
          (['json', ' Apache-Arrow ', 'proto', 'FlatBuffer', 'protobuf', 'arrow', 'xml', ''])[p_partkey % 8 + 1] AS format,
          p_type AS raw_schema FROM part),
    serr AS (SELECT *, CASE WHEN coalesce(schema_id, '') = '' THEN 'schema id is required'
                            WHEN ({CANON.format(f='format')}) IS NULL THEN 'schema format is required'
                            WHEN coalesce(raw_schema, '') = '' THEN 'schema payload is required' END AS error
             FROM sops),
    sv AS (SELECT schema_id, seq, op, {CANON.format(f='format')} AS format, raw_schema FROM serr
           WHERE op <> 'put' OR error IS NULL),
    sr1 AS (SELECT *, sum(CAST(op = 'delete' AS BIGINT)) OVER (PARTITION BY schema_id ORDER BY seq
                  ROWS UNBOUNDED PRECEDING) AS epoch FROM sv),
    sr2 AS (SELECT *, CASE WHEN op = 'put' THEN CAST(sum(CAST(op = 'put' AS BIGINT)) OVER (PARTITION BY schema_id, epoch
                  ORDER BY seq ROWS UNBOUNDED PRECEDING) AS BIGINT) END AS version FROM sr1),
    scur0 AS (SELECT *, max(epoch) OVER (PARTITION BY schema_id) AS last_epoch FROM sr2),
    scur1 AS (SELECT * FROM scur0 WHERE epoch = last_epoch AND op = 'put'),
    scur AS (SELECT schema_id, version, format, raw_schema,
                    version = max(version) OVER (PARTITION BY schema_id) AS is_active FROM scur1),
    sact AS (SELECT schema_id, version AS active FROM scur WHERE is_active)"""


def state_sql() -> dict[str, str]:
    s = {}
    s["history_replay"] = with_("oplog") + ", " + _replay_ctes() + " SELECT name, version, spec, is_active FROM hv"
    s["rollback_errors"] = with_("oplog") + ", " + _replay_ctes() + """ SELECT name, ts, seq, version,
        printf('version %d does not exist', version) AS error FROM r4 WHERE op = 'rollback' AND NOT valid"""
    s["history_replay_pointer"] = with_("oplog") + """,
    ep AS (SELECT *, sum(CAST(op = 'delete' AS BIGINT)) OVER (PARTITION BY name ORDER BY ts, seq
           ROWS UNBOUNDED PRECEDING) AS epoch FROM oplog),
    live AS (SELECT e.* FROM ep e JOIN (SELECT name, max(epoch) AS epoch FROM ep GROUP BY name) m
             ON e.name = m.name AND e.epoch = m.epoch WHERE op <> 'delete'),
    ops AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY ts, seq) AS rn FROM live),
    fold AS (SELECT * FROM (
        WITH RECURSIVE f(name, rn, active, vers) AS (
            SELECT DISTINCT name, CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST([] AS DOUBLE[]) FROM ops
            UNION ALL
            SELECT f.name, o.rn,
                   CASE WHEN o.op = 'put' THEN f.active + 1
                        WHEN o.op = 'rollback' AND o.version >= 1 AND o.version <= len(f.vers) THEN o.version
                        ELSE f.active END,
                   CASE WHEN o.op = 'put' THEN list_concat(list_concat(f.vers[1:f.active], [o.spec]), f.vers[f.active + 2:])
                        ELSE f.vers END
            FROM f JOIN ops o ON o.name = f.name AND o.rn = f.rn + 1)
        SELECT * FROM f)),
    fin AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY rn DESC) AS k FROM fold) WHERE k = 1),
    ex AS (SELECT name, active, vers, unnest(range(1, len(vers) + 1)) AS i FROM fin)
    SELECT name, CAST(i AS BIGINT) AS version, vers[i] AS spec, i = active AS is_active FROM ex"""
    s["flow_list"] = with_("oplog") + ", " + _replay_ctes() + " SELECT * FROM fl"
    s["latest_status"] = with_("kv", "reconcile") + ", " + VERSIONS + """,
        rec AS (SELECT flow_name AS name, ts FROM reconcile WHERE ok),
        ptr AS (SELECT name, ts, op, value FROM kv_n WHERE key LIKE '%/active'),
        seen AS (SELECT r.name, r.ts, CASE WHEN p.op = 'put' AND regexp_full_match(p.value, '[0-9]+') THEN p.value END AS version
                 FROM rec r ASOF JOIN ptr p ON r.name = p.name AND r.ts >= p.ts),
        done AS (SELECT s.name, s.ts, s.version FROM seen s ASOF JOIN vers v ON s.name = v.name AND s.version = v.version AND s.ts >= v.ts
                 WHERE v.op = 'put')
        SELECT name, 'FLOW_STATE_DEPLOYING' AS state, 'flow runtime created' AS message, name || '-runtime' AS workload,
               max(ts) AS last_updated, CAST(arg_max(version, ts) AS BIGINT) AS active_version FROM done GROUP BY name"""
    s["flow_upsert"] = """WITH r AS (SELECT o_orderkey AS seq, CASE WHEN o_orderkey % 2 = 0 THEN 'create' ELSE 'update' END AS op,
               'flow_' || CAST(o_custkey AS VARCHAR) AS name,
               CASE WHEN o_orderkey % 7 = 0 THEN '' ELSE 'spec_' || CAST(o_orderkey % 100 AS VARCHAR) END AS spec_name FROM orders)
        SELECT seq, op, CASE WHEN op = 'update' THEN name ELSE nullif(spec_name, '') END AS target,
               CASE WHEN op = 'create' AND spec_name = '' THEN 'flow name is required' END AS error FROM r"""
    s["flow_summaries"] = with_("oplog", "reconcile") + ", " + _replay_ctes() + ", " + STATUS + """
        SELECT fl.name, fl.active_version, st.state, st.message FROM fl LEFT JOIN st ON fl.name = st.name"""
    s["flow_get"] = with_("kv", "reconcile") + ", " + VERSIONS + ", " + STATUS + """,
        req AS (SELECT DISTINCT 'flow_' || CAST(c_custkey AS VARCHAR) AS name FROM customer),
        fin AS (SELECT key, any_value(name) AS name, arg_max(op, n) AS op, arg_max({'v': value}, n).v AS value FROM kv_n GROUP BY key),
        ptr AS (SELECT name, CASE WHEN regexp_full_match(value, '[0-9]+') THEN value END AS version FROM fin WHERE key LIKE '%/active' AND op = 'put'),
        spc AS (SELECT name, split_part(key, '/', 6) AS version, value AS spec FROM fin WHERE key LIKE '%/versions/%/spec' AND op = 'put'),
        got AS (SELECT req.name, p.version, s.spec, CASE WHEN p.name IS NULL THEN 'flow "' || req.name || '" not found'
                       WHEN p.version IS NULL THEN 'invalid active version'
                       WHEN s.spec IS NULL THEN 'spec missing for "' || req.name || '" version ' || p.version ELSE 'ok' END AS result
                FROM req LEFT JOIN ptr p ON p.name = req.name LEFT JOIN spc s ON s.name = p.name AND s.version = p.version)
        SELECT g.name, CASE WHEN result = 'ok' THEN CAST(version AS BIGINT) END AS active_version, spec,
               CASE WHEN result = 'ok' THEN st.state END AS state, CASE WHEN result = 'ok' THEN st.workload END AS workload, result
        FROM got g LEFT JOIN st ON st.name = g.name"""
    s["watch_events"] = with_("kv") + ", " + WATCH + " SELECT rev, flow, event_type, version, spec FROM watch"
    s["watch_event_counts"] = with_("kv") + ", " + WATCH + """ SELECT event_type, flow, count(*) AS events
        FROM watch GROUP BY ALL"""
    s["coalesced_lag"] = with_("work") + ", " + LAG + " SELECT key, seq, ts, round(lag_s, 6) AS lag_s FROM lags"
    snap = "(SELECT * FROM oplog WHERE ts < TIMESTAMP '1998-01-01 00:00:00')"
    s["desired_state_plan"] = with_("oplog") + ", " + _replay_ctes() + ", " + \
        _replay_ctes(snap).replace("r1 AS", "a1 AS").replace(" r1", " a1").replace("r2", "a2").replace("r3", "a3") \
        .replace("r4", "a4").replace("lastrow", "alast").replace("cur", "acur").replace("hv", "ahv").replace("fl AS", "afl AS") + """,
        d AS (SELECT name, sha256(CAST(CAST(spec AS DECIMAL(18, 2)) AS VARCHAR)) AS desired_checksum FROM fl),
        a AS (SELECT name, sha256(CAST(CAST(spec AS DECIMAL(18, 2)) AS VARCHAR)) AS actual_checksum FROM afl)
        SELECT coalesce(d.name, a.name) AS name, desired_checksum, actual_checksum,
               CASE WHEN actual_checksum IS NULL THEN 'create' WHEN desired_checksum IS NULL THEN 'delete'
                    WHEN desired_checksum <> actual_checksum THEN 'update' ELSE 'unchanged' END AS action
        FROM d FULL OUTER JOIN a ON d.name = a.name"""
    reg = "WITH " + REGISTRY + " "
    s["schema_create"] = reg + "SELECT schema_id, seq, version FROM sr2 WHERE op = 'put'"
    s["schema_create_errors"] = reg + "SELECT schema_id, seq, error FROM serr WHERE op = 'put' AND error IS NOT NULL"
    s["schema_get"] = reg + """, req AS (SELECT DISTINCT p_brand AS schema_id, CAST(p_size % 3 + 1 AS BIGINT) AS version FROM part)
        SELECT req.schema_id, req.version AS requested_version, scur.version, scur.format,
               CASE WHEN scur.version IS NULL THEN 'not found' ELSE 'ok' END AS result
        FROM req LEFT JOIN sact ON req.schema_id = sact.schema_id
        LEFT JOIN scur ON scur.schema_id = req.schema_id
                 AND scur.version = coalesce(CASE WHEN req.version <> 0 THEN req.version END, sact.active)"""
    s["schema_active"] = reg + "SELECT schema_id, version, format, raw_schema FROM scur WHERE is_active"
    s["schema_resolve"] = reg + """, refs AS (SELECT DISTINCT p_brand AS schema_id, CAST(p_size % 4 AS BIGINT) AS version FROM part),
        w AS (SELECT refs.*, coalesce(CASE WHEN refs.version <> 0 THEN refs.version END, sact.active) AS want
              FROM refs LEFT JOIN sact ON refs.schema_id = sact.schema_id)
        SELECT w.schema_id, w.version AS requested_version,
               CASE WHEN scur.format IS NOT NULL THEN w.want END AS resolved_version, scur.format
        FROM w LEFT JOIN scur ON scur.schema_id = w.schema_id AND scur.version = w.want"""
    s["schema_list"] = reg + "SELECT schema_id, version, is_active FROM scur"
    s["schema_history"] = reg + "SELECT schema_id, version, format, raw_schema, is_active FROM scur"
    s["schema_stamp"] = with_("payloads") + """SELECT event_id, CASE WHEN schema_id = '' THEN 'events' ELSE schema_id END AS schema_id
        FROM payloads WHERE schema_id IN ('', 'events')"""
    s["schema_gate"] = with_("payloads") + "SELECT event_id, schema_id FROM payloads WHERE schema_id = 'events'"
    s["schema_rejects"] = with_("payloads") + """SELECT * FROM (SELECT event_id, 'events' AS queue, 'events' AS expected_schema_id,
        CASE WHEN schema_id = '' THEN 'missing_schema_id' WHEN schema_id <> 'events' THEN 'schema_mismatch' END AS reason
        FROM payloads) WHERE reason IS NOT NULL"""
    s["schema_pipeline"] = with_("payloads") + """SELECT event_id, 'events_normalized' AS schema_id, 'set_schema' AS mode
        FROM payloads WHERE schema_id IN ('', 'events')"""
    s["attr_get"] = with_("payloads") + "SELECT event_id, k, CAST(NULL AS VARCHAR) AS tenant FROM payloads"
    s["attr_set"] = with_("payloads") + """SELECT event_id, k AS k_before, k * 2 AS k_after, 'acme' AS tenant,
        3 AS n_attrs FROM payloads"""
    s["attr_erase"] = with_("payloads") + """SELECT event_id, true AS found_k, false AS found_k_again,
        1 AS n_after_one, true AS null_after_two FROM payloads"""
    s["attr_typed"] = with_("payloads") + """SELECT event_id, event_id % 16 AS partition, value, event_type = 'error' AS failed, k,
        CAST(NULL AS VARCHAR) AS k_as_string, CASE WHEN k IS NOT NULL THEN 'BIGINT' END AS k_type,
        CAST(NULL AS VARCHAR) AS user_type, 4 AS n_attrs FROM payloads"""
    s["attr_has"] = with_("payloads") + "SELECT event_id, event_type <> 'view' AS has_attrs FROM payloads"
    s["has_trace"] = with_("payloads") + "SELECT event_id, user_id % 10 <> 0 AS has_trace FROM payloads"
    s["is_empty"] = with_("payloads") + """SELECT event_id, payload IS NULL OR size = 0 AS is_empty,
        schema_id <> '' AS has_schema_id FROM payloads"""
    s["flag_bits"] = with_("payloads") + "SELECT event_id, flags, flags & 255 AS trace_flags FROM payloads"
    s["key_parse"] = with_("kv") + """SELECT rev, key, string_split(key, '/')[-2] AS name, string_split(key, '/')[-1] AS leaf,
        '/pipelines/flows/' || string_split(key, '/')[-2] || '/versions/1/spec' AS version_key FROM kv"""
    s["format_alias"] = "WITH " + REGISTRY + f""" SELECT seq, format, {CANON.format(f='format')} AS canonical,
        CASE WHEN ({CANON.format(f='format')}) IS NULL
             THEN printf('unsupported schema format "%s" (use arrow, json, protobuf, flatbuffers)', format) END AS error
        FROM sops"""
    s["version_parse"] = """WITH v AS (SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN p_brand
                                   ELSE CAST(p_size - 3 AS VARCHAR) END AS text FROM part),
        p AS (SELECT *, CASE WHEN regexp_full_match(text, '[0-9]+') THEN CAST(text AS BIGINT) END AS n FROM v)
        SELECT p_partkey, text, CASE WHEN n > 0 AND n <= 4294967295 THEN n END AS version,
               CASE WHEN n IS NULL OR n > 4294967295 THEN printf('invalid schema version "%s"', text)
                    WHEN n = 0 THEN 'schema version must be greater than 0' END AS error FROM p"""
    return s


# ---------------------------------------------------------------------------
# record flows
# ---------------------------------------------------------------------------
def _h(key: str, queue: str) -> str:
    return f"CAST(('0x' || substr(md5('{queue}' || coalesce(CAST({key} AS VARCHAR), '')), 1, 8)) AS BIGINT)"


def flow_sql() -> dict[str, str]:
    s = {}
    s["seq_source"] = """SELECT p_partkey, CAST(w.worker AS BIGINT) AS worker, CAST(q.seq AS BIGINT) AS seq,
        p_brand || ' #' || CAST(q.seq AS VARCHAR) AS text
        FROM part, LATERAL (SELECT unnest(range(0, p_size % 3 + 1)) AS worker) w,
             LATERAL (SELECT unnest(range(0, p_size % 5 + 1)) AS seq) q"""
    s["pass_through"] = with_("payloads") + "SELECT event_id, schema_id, flags, trace_id, span_id FROM payloads"
    s["text_sink"] = with_("payloads") + "SELECT decode(payload) AS value FROM payloads WHERE size > 0"
    s["competing_split"] = with_("payloads") + f"""SELECT event_id,
        {_h('CASE WHEN event_id % 3 <> 0 THEN event_id END', 'q')} % 2 AS consumer FROM payloads"""
    s["fan_in"] = with_("payloads") + "SELECT event_id, schema_id FROM payloads"
    s["flow_simple_pipeline"] = "SELECT text AS value FROM documents WHERE octet_length(encode(text)) > 0"
    s["flow_fanout"] = with_("payloads") + f"""SELECT decode(payload) AS value,
        CASE WHEN {_h('span_id', 'q_in')} % 2 = 0 THEN 'sink_a' ELSE 'sink_b' END AS sink FROM payloads WHERE size > 0"""
    s["flow_job_mode"] = with_("payloads") + """, c AS (SELECT count(CASE WHEN schema_id IN ('', 'events') THEN 1 END) AS ok,
            count(CASE WHEN schema_id NOT IN ('', 'events') THEN 1 END) AS bad FROM payloads)
        SELECT 'source' AS stage_name, 'table_source' AS stage, CAST(NULL AS BIGINT) AS dequeue, ok AS process,
               bad AS error, ok AS enqueue FROM c
        UNION ALL SELECT 'normalize', 'noop_transform', ok, ok, ok, 0 FROM c
        UNION ALL SELECT 'sink', 'stdout_sink', 0, 0, 0, CAST(NULL AS BIGINT) FROM c"""
    s["custom_transform"] = with_("payloads") + "SELECT upper(decode(payload)) AS value FROM payloads WHERE size > 0"
    s["csv_ingest"] = "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders"
    s["enqueue_stamp"] = with_("payloads") + """SELECT event_id, 'source' AS hop, ts AS enqueue_ts FROM payloads
        UNION ALL SELECT event_id, 'transform' AS hop,
            make_timestamp(epoch_us(ts) + CAST(round(value * 2 * 1000.0) AS BIGINT)) AS enqueue_ts FROM payloads"""
    return s


# ---------------------------------------------------------------------------
# spec catalogue quality
# ---------------------------------------------------------------------------
SPEC_CTES = """sf AS (SELECT DISTINCT flow_id, flow AS name FROM spec_lines),
    sq AS (SELECT DISTINCT flow_id, input_queue AS name, capacity,
                  CASE WHEN pos % 4 = 0 THEN '' WHEN pos % 4 = 1 THEN 'orders' END AS schema_id
           FROM spec_lines WHERE declares_queue),
    nq AS (SELECT flow_id, row_number() OVER (PARTITION BY flow_id ORDER BY name, capacity, schema_id NULLS FIRST) - 1 AS pos,
                  name, CASE WHEN capacity <> 0 THEN capacity ELSE 128 END AS capacity, schema_id, sq.capacity AS raw FROM sq),
    ns AS (SELECT flow_id, row_number() OVER (PARTITION BY flow_id ORDER BY name, type, threads,
                  input_queue NULLS FIRST, output_queue NULLS FIRST) - 1 AS pos, name, type, threads, input_queue, output_queue
           FROM (SELECT flow_id, stage_name AS name, stage_type AS type, threads, input_queue, output_queue FROM spec_lines)),
    qn AS (SELECT DISTINCT flow_id, name FROM nq)"""

VIOL = """vq AS (SELECT *, row_number() OVER (PARTITION BY flow_id, name ORDER BY pos) AS nth FROM nq),
    vs AS (SELECT *, row_number() OVER (PARTITION BY flow_id, name ORDER BY pos) AS nth FROM ns),
    viol AS (
      SELECT flow_id, 'name' AS field, 'flow name is required' AS message, CAST(0 AS BIGINT) AS section,
             CAST(0 AS BIGINT) AS position, CAST(1 AS BIGINT) AS rule FROM sf WHERE name = ''
      UNION ALL SELECT flow_id, 'queues.name', 'duplicate queue name "' || name || '"', 1, pos, 1
                FROM vq WHERE name <> '' AND nth > 1
      UNION ALL SELECT flow_id, 'stages.name', 'duplicate stage "' || name || '"', 2, pos, 1
                FROM vs WHERE name <> '' AND nth > 1
      UNION ALL SELECT flow_id, 'stages.type', 'stage "' || name || '" missing type', 2, pos, 2
                FROM vs WHERE type = ''
      UNION ALL SELECT flow_id, 'stages.threads', 'stage "' || name || '" must declare at least one thread',
                2, pos, 3 FROM vs WHERE threads < 1
      UNION ALL SELECT flow_id, 'stages.input_queue',
                'stage "' || name || '" references unknown input queue "' || input_queue || '"', 2, pos, 4
                FROM vs WHERE input_queue IS NOT NULL
                  AND NOT EXISTS (SELECT 1 FROM qn WHERE qn.flow_id = vs.flow_id AND qn.name = vs.input_queue)
      UNION ALL SELECT flow_id, 'stages.output_queue',
                'stage "' || name || '" references unknown output queue "' || output_queue || '"', 2, pos, 5
                FROM vs WHERE output_queue IS NOT NULL
                  AND NOT EXISTS (SELECT 1 FROM qn WHERE qn.flow_id = vs.flow_id AND qn.name = vs.output_queue)
      UNION ALL SELECT flow_id, 'queues.capacity', 'queue capacity must be > 0: ' || name, 3, pos, 0 FROM vq WHERE raw = 0
      UNION ALL SELECT flow_id, 'queues.schema', 'queue schema_id is required: ' || name, 3, pos, 1 FROM vq WHERE schema_id = ''
      UNION ALL SELECT flow_id, 'queues.type', 'unsupported queue type for queue: ' || name, 3, pos, 2 FROM vq WHERE name = 'q7'
      UNION ALL SELECT flow_id, 'stages.wiring', 'invalid source stage wiring: ' || name, 4, pos, 0
                FROM vs WHERE type = 'A' AND NOT (input_queue IS NULL AND output_queue IS NOT NULL)
      UNION ALL SELECT flow_id, 'stages.wiring', 'invalid transform stage wiring: ' || name, 4, pos, 0
                FROM vs WHERE type = 'N' AND NOT (input_queue IS NOT NULL AND output_queue IS NOT NULL))"""

TABLE_COLS = {
    "lineitem": ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
                 "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"],
    "orders": ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"],
    "customer": ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"],
}


def _spec_counts(src: str, name_expr: str) -> str:
    return f"""SELECT a.flow_id, {name_expr} AS name, a.ns, coalesce(b.nq, 0) AS nq FROM
        (SELECT flow_id, any_value(flow) AS flow, count(*) AS ns FROM {src} GROUP BY flow_id) a
        LEFT JOIN (SELECT flow_id, count(*) AS nq FROM (SELECT DISTINCT flow_id, input_queue, capacity,
                   CASE WHEN pos % 4 = 0 THEN '' WHEN pos % 4 = 1 THEN 'orders' END FROM {src} WHERE declares_queue)
                   GROUP BY flow_id) b ON a.flow_id = b.flow_id"""


def catalogue_sql() -> dict[str, str]:
    s = {}
    base = with_("spec_lines") + ", " + SPEC_CTES + " "
    s["spec_normalize"] = base + """SELECT flow_id, 'queue' AS kind, pos, name, capacity FROM nq
        UNION ALL SELECT flow_id, 'stage', pos, name, CAST(NULL AS BIGINT) FROM ns"""
    s["dq_not_null"] = " UNION ALL ".join(
        f"SELECT '{t}' AS tbl, '{c}' AS col, count(*) - count({c}) AS null_rows FROM {t}"
        for t, cols in TABLE_COLS.items() for c in cols)

    def req(t, cols, src=None):
        return " UNION ALL ".join(
            f"SELECT '{t}' AS tbl, '{c}' AS col, count(*) FILTER (WHERE coalesce(CAST({c} AS VARCHAR), '') = '') AS violations FROM {src or t}"
            for c in cols)
    s["dq_required"] = base + " UNION ALL ".join([
        req("customer", ["c_name", "c_mktsegment"]), req("orders", ["o_orderstatus", "o_orderpriority"]),
        req("specs.stages", ["stage_name", "type"], "(SELECT stage_name, stage_type AS type FROM spec_lines)"),
        req("specs", ["name"], "sf")])
    s["dq_non_empty"] = """SELECT o_orderkey FROM orders o
        WHERE NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey)"""
    s["dq_unique"] = base + """SELECT flow_id, name, count(*) AS n, 'queue' AS kind FROM nq GROUP BY ALL HAVING count(*) > 1
        UNION ALL SELECT flow_id, name, count(*), 'stage' FROM ns GROUP BY flow_id, name HAVING count(*) > 1
        UNION ALL SELECT l_orderkey, CAST(l_linenumber AS VARCHAR), count(*), 'lineitem' FROM lineitem
                  GROUP BY 1, 2 HAVING count(*) > 1"""
    s["dq_min_value"] = base + "SELECT flow_id, pos, name, threads FROM ns WHERE threads < 1"
    s["dq_foreign_key"] = base + """SELECT flow_id, pos, input_queue AS queue, 'input' AS side FROM ns
            WHERE input_queue IS NOT NULL AND NOT EXISTS (SELECT 1 FROM qn WHERE qn.flow_id = ns.flow_id AND qn.name = ns.input_queue)
        UNION ALL SELECT flow_id, pos, output_queue, 'output' FROM ns
            WHERE output_queue IS NOT NULL AND NOT EXISTS (SELECT 1 FROM qn WHERE qn.flow_id = ns.flow_id AND qn.name = ns.output_queue)
        UNION ALL SELECT l_orderkey, CAST(l_linenumber AS BIGINT), CAST(l_partkey AS VARCHAR), 'lineitem.l_partkey'
            FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM part WHERE p_partkey = l_partkey)"""
    s["dq_conditional"] = base + """SELECT flow_id, pos, name, 'queue schema_id is required: ' || name AS message
        FROM nq WHERE schema_id = ''"""
    seal = lambda c: f"coalesce(length(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')"
    s["row_fingerprint"] = "SELECT o_orderkey, sha256(" + " || ".join(seal(c) for c in (
        "o_orderkey", "o_custkey", "o_orderstatus", "CAST(o_totalprice AS DECIMAL(18, 2))", "o_orderdate", "o_orderpriority")) + \
        ") AS fingerprint FROM orders"
    side = lambda t, cols: f"""(SELECT string_agg({' || '.join(seal(c) for c in cols)}, ';' ORDER BY pos) AS x, flow_id
        FROM {t} GROUP BY flow_id)"""
    s["spec_fingerprint"] = base + f"""SELECT sf.flow_id, sha256({seal('sf.name')} || {seal("coalesce(q.x, '')")} || {seal("coalesce(st.x, '')")}) AS fingerprint
        FROM sf LEFT JOIN {side('nq', ('name', 'capacity', 'schema_id'))} q ON q.flow_id = sf.flow_id
        LEFT JOIN {side('ns', ('name', 'type', 'threads', 'input_queue', 'output_queue'))} st ON st.flow_id = sf.flow_id"""
    s["spec_diff"] = with_("spec_lines") + f""",
        pa AS ({_spec_counts("(SELECT * FROM spec_lines WHERE shipdate < TIMESTAMP '1997-01-01 00:00:00')",
                             "'f' || CAST(a.flow_id AS VARCHAR)")}),
        ca AS ({_spec_counts("spec_lines", "a.flow")}),
        j AS (SELECT pa.flow_id, pa.name AS a_name, pa.nq AS a_q, pa.ns AS a_s, ca.name AS b_name, ca.nq AS b_q, ca.ns AS b_s
              FROM pa JOIN ca ON pa.flow_id = ca.flow_id)
        SELECT flow_id, 'name: "' || a_name || '" → "' || b_name || '"' AS change FROM j WHERE a_name <> b_name
        UNION ALL SELECT flow_id, 'queues: ' || a_q || ' → ' || b_q FROM j WHERE a_q <> b_q
        UNION ALL SELECT flow_id, 'stages: ' || a_s || ' → ' || b_s FROM j WHERE a_s <> b_s"""
    s["spec_version_diff"] = with_("oplog", "spec_lines") + f""",
        vp AS (SELECT *, sum(CAST(op = 'delete' AS BIGINT)) OVER (PARTITION BY name ORDER BY ts, seq ROWS UNBOUNDED PRECEDING) AS epoch FROM oplog),
        vv AS (SELECT name, seq, ts, CAST(epoch AS BIGINT) AS epoch, row_number() OVER (PARTITION BY name, epoch ORDER BY ts, seq) AS version
               FROM vp WHERE op = 'put'),
        vc AS ({_spec_counts("spec_lines", "'spec_' || CAST(a.flow_id % 3 AS VARCHAR)")}),
        vj AS (SELECT vv.name, epoch, version, vc.name AS spec_name, nq, ns FROM vv JOIN vc ON vv.seq = vc.flow_id),
        vd AS (SELECT name, epoch, version, spec_name AS b_name, nq AS b_q, ns AS b_s, lag(spec_name) OVER w AS a_name, lag(nq) OVER w AS a_q,
                      lag(ns) OVER w AS a_s FROM vj WINDOW w AS (PARTITION BY name, epoch ORDER BY version))
        SELECT name, epoch, version, 'name: "' || a_name || '" → "' || b_name || '"' AS change FROM vd WHERE a_name <> b_name
        UNION ALL SELECT name, epoch, version, 'queues: ' || a_q || ' → ' || b_q FROM vd WHERE a_q <> b_q
        UNION ALL SELECT name, epoch, version, 'stages: ' || a_s || ' → ' || b_s FROM vd WHERE a_s <> b_s"""
    s["json_roundtrip"] = with_("spec_lines") + f""", c AS ({_spec_counts("spec_lines", "a.flow")})
        SELECT flow_id, true AS roundtrip_ok, ns AS n_stages, nq AS n_queues FROM c"""
    s["spec_load"] = with_("spec_lines") + f""", c AS ({_spec_counts("spec_lines", "a.flow")})
        SELECT flow_id, name, ns AS n_stages, nq AS n_queues,
               CASE WHEN flow_id % 50 = 0 THEN 'unknown field "extra"' END AS error FROM c"""
    s["spec_validate"] = base + ", " + VIOL + " SELECT flow_id, field, message, section, position, rule FROM viol"
    s["spec_first_error"] = base + ", " + VIOL + """ SELECT flow_id, arg_min(field, (section, position, rule)) AS field,
        arg_min(message, (section, position, rule)) AS message FROM viol GROUP BY flow_id"""
    s["spec_validation_summary"] = base + ", " + VIOL + """ SELECT
        count(*) FILTER (WHERE flow_id NOT IN (SELECT flow_id FROM viol)) AS valid,
        count(*) FILTER (WHERE flow_id IN (SELECT flow_id FROM viol)) AS invalid FROM sf"""
    return s
