"""The telemetry views as SQL text for the check engine, in dependency order."""

VIEWS = {
    "svc": """SELECT *, CASE user_id % 3 WHEN 0 THEN 'svc-a' WHEN 1 THEN 'svc-b' ELSE 'svc-c' END AS service FROM events""",
    "logs_v": """SELECT event_id AS id, ts AS timestamp, 'default' AS namespace, service,
  CASE event_type
    WHEN 'error'    THEN 'Exception: connection refused to 10.0.' || CAST(user_id AS VARCHAR) || '.1 after ' || CAST(CAST(FLOOR(value) AS INT) AS VARCHAR) || 'ms'
    WHEN 'purchase' THEN 'Slow query warning: took ' || CAST(CAST(FLOOR(value) AS INT) AS VARCHAR) || 'ms (threshold: 500ms)'
    WHEN 'view'     THEN 'debug cache hit for key item:' || CAST(event_id AS VARCHAR)
    WHEN 'click'    THEN 'Request completed in ' || CAST(CAST(FLOOR(value) AS INT) AS VARCHAR) || 'ms with status 200'
    ELSE 'Received GET /api/users/' || CAST(user_id AS VARCHAR) END AS message,
  CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'purchase' THEN 'WARN' WHEN 'view' THEN 'DEBUG' ELSE 'INFO' END AS severity
FROM svc""",
    "traces_v": """SELECT event_id AS id, ts AS timestamp, CAST(event_id AS VARCHAR) AS trace_id, service, event_type AS operation,
  value*10 AS duration_ms, value*10 > 500 AS is_slow, event_type='error' AS has_error FROM svc""",
    "metrics_v": """SELECT event_id AS id, ts AS timestamp, event_type AS metric_name, service,
  CASE WHEN event_id % 97 = 0 THEN 'n/a' ELSE CAST(value AS VARCHAR) END AS value FROM svc""",
    "counter_v": """SELECT service, event_type, ts,
  CAST(ROW_NUMBER() OVER (PARTITION BY service, event_type ORDER BY ts, event_id) % 50 AS DOUBLE) AS value FROM svc""",
    "bucket_v": """SELECT s.service, DATE_TRUNC('day', s.ts) AS eval_ts, b.le, SUM(CASE WHEN s.value <= b.le THEN 1 ELSE 0 END)::BIGINT AS cum
FROM svc s CROSS JOIN (VALUES (CAST(10 AS DOUBLE)),(25),(50),(100),(250),(CAST('Infinity' AS DOUBLE))) b(le)
GROUP BY 1,2,3""",
    "wide_v": """SELECT service, DATE_TRUNC('hour', ts) AS timestamp, COUNT(*)/3600.0E0 AS request_rate,
  AVG(CASE WHEN event_type='error' THEN 1.0E0 ELSE 0.0E0 END) AS error_rate,
  PERCENTILE_CONT(0.5) WITHIN GROUP (ORDER BY value*10) AS latency_p50,
  PERCENTILE_CONT(0.99) WITHIN GROUP (ORDER BY value*10) AS latency_p99,
  2.0E8 + SUM(value)*1.0E5 AS jvm_heap_used, AVG(value)/1000 AS jvm_gc_pause_seconds,
  LEAST(1.0E0, COUNT(*)/20.0E0) AS cpu_usage, 0.4E0 + LEAST(0.5E0, MAX(value)/1000) AS memory_usage
FROM svc GROUP BY 1,2""",
    "k8s_v": """SELECT o_orderkey AS id, CAST(o_orderkey AS VARCHAR) AS uid, o_orderdate AS timestamp, 'kubernetes' AS source,
  'pod-' || CAST(o_custkey % 20 AS VARCHAR) AS pod,
  CASE o_orderkey % 6 WHEN 0 THEN 'OOMKilled' WHEN 1 THEN 'BackOff' WHEN 2 THEN 'Scheduled' WHEN 3 THEN 'Pulled' WHEN 4 THEN 'Unhealthy' ELSE 'Started' END AS reason,
  CASE WHEN o_orderstatus='F' THEN 'Warning' ELSE 'Normal' END AS event_type, o_orderpriority AS message FROM orders""",
    "parent_v": "SELECT l_orderkey AS id, l_linenumber AS pos, l_partkey AS child_id FROM lineitem",
    "child_v": "SELECT p_partkey AS id, p_name AS name FROM part WHERE p_partkey % 50 <> 0",
    "eval_v": """SELECT l.doc_id AS id, l.quality AS y, l.toxic AS y_hat, d.n_chars*1.0E0 AS score
FROM labels l JOIN documents d ON l.doc_id=d.doc_id""",
    "cluster_v": """SELECT vec_id AS id, label AS true_label,
  CASE WHEN vec_id % 11 = 0 THEN -1 ELSE CAST((label + vec_id % 2) % 8 AS INT) END AS cid FROM embeddings""",
    "now_v": "SELECT MAX(ts) AS as_of FROM events",
    "k8s_now_v": "SELECT MAX(o_orderdate) AS as_of FROM orders",
}

NEEDS = {
    "logs_v": ["svc"], "traces_v": ["svc"], "metrics_v": ["svc"], "counter_v": ["svc"], "bucket_v": ["svc"], "wide_v": ["svc"],
}


def add_view(name: str, body: str, *needs: str) -> None:
    """Register a derived view that several checks share."""
    VIEWS[name] = body
    NEEDS[name] = list(needs)


def sql(body: str, *views: str) -> str:
    """``WITH`` the named views and what they need, then ``body``."""
    wanted: list[str] = []

    def visit(name: str) -> None:
        for n in NEEDS.get(name, []):
            visit(n)
        if name not in wanted:
            wanted.append(name)

    for v in views:
        visit(v)
    body = body.strip()
    head = ",\n".join(f"{v} AS ({VIEWS[v]})" for v in wanted)
    if not wanted:
        return body
    if body.upper().startswith("WITH "):
        return f"WITH {head},\n{body[5:]}"
    return f"WITH {head}\n{body}"


def fixed(expr: str, n: int) -> str:
    """The rounding of ``functions.scalar.fixed`` as SQL."""
    return f"CAST(ROUND(CAST(ROUND({expr}, {n + 4}) AS DECIMAL(38, {n + 4})), {n}) AS DOUBLE)"
