"""Fixed values that decide results: names, thresholds, caps and formats."""

# -- fixed values: the eight metric features, in model order ------------------
FEATURES = [
    "request_rate", "error_rate", "latency_p50", "latency_p99",
    "jvm_heap_used", "jvm_gc_pause_seconds", "cpu_usage", "memory_usage",
]

# -- fixed values: log severities ---------------------------------------------
CHART_SEVERITIES = ["ERROR", "WARN", "INFO", "DEBUG"]

# -- fixed values: severity words, tried in this order ------------------------
SEVERITY_PATTERNS = [
    ("ERROR", "error|exception|stacktrace|fatal"),
    ("WARN", "warn"),
    ("DEBUG", "debug|trace"),
]

# -- fixed values: cluster event reasons that are always kept -----------------
IMPORTANT_REASONS = [
    "OOMKilled", "CrashLoopBackOff", "BackOff", "Failed", "FailedScheduling",
    "Evicted", "Unhealthy", "ImagePullBackOff", "ErrImagePull",
]

# -- fixed values: text length and slow calls ---------------------------------
SLOW_MS = 500

# -- fixed values: source metric name -> feature ------------------------------
METRIC_TO_FEATURE = {
    "http_server_requests_seconds_count": "request_rate",
    "http_server_requests_seconds_sum": "latency_p50",
    "http_request_rate": "request_rate",
    "http_error_rate": "error_rate",
    "http_latency_p50": "latency_p50",
    "http_latency_p99": "latency_p99",
    "jvm_memory_used": "jvm_heap_used",
    "jvm_gc_duration": "jvm_gc_pause_seconds",
    "jvm_memory_used_bytes": "jvm_heap_used",
    "jvm_gc_pause_seconds_sum": "jvm_gc_pause_seconds",
    "process_cpu_usage": "cpu_usage",
    "jvm_memory_usage_after_gc": "memory_usage",
    "request_rate": "request_rate",
    "error_rate": "error_rate",
    "latency_p50": "latency_p50",
    "latency_p99": "latency_p99",
    "jvm_heap_used": "jvm_heap_used",
    "jvm_gc_pause_seconds": "jvm_gc_pause_seconds",
    "cpu_usage": "cpu_usage",
    "memory_usage": "memory_usage",
}

# -- fixed values: capacity thresholds of the forecast alerts -----------------
CAPACITY_THRESHOLDS = {
    "cpu_usage": 0.85,
    "memory_usage": 0.90,
    "error_rate": 0.05,
    "latency_p99": 500.0,
    "jvm_heap_used": 450e6,
}

# -- fixed values: model settings ---------------------------------------------
WINDOW_ROWS = 60
WINDOW_STRIDE = 15
SEQUENCE_ROWS = 30
SEQUENCE_ANOMALY_SHARE = 0.3
LATENT_DIM = 32
ERROR_PERCENTILE = 0.95
FOREST_TREES = 200
FOREST_SAMPLE = 256
FOREST_CONTAMINATION = 0.05
FOREST_WEIGHT = 0.4
SEQUENCE_WEIGHT = 0.6
ANOMALY_CUT = 0.5
HORIZON = 15
FORECAST_MEMBERS = 20
TAIL_WINDOWS = [5, 15, 30]
HEAP_NORM = 512e6
EPS = 1e-8
SEED = 42

# -- fixed values: health states, in display order ----------------------------
HEALTH_ORDER = ["HEALTHY", "DEGRADED", "CRITICAL", "UNKNOWN"]
ANOMALY_SEVERITIES = ["critical", "high", "medium", "low"]
PRIORITIES = [("immediate", "Immediate"), ("short_term", "Short-term"), ("long_term", "Long-term")]
DURATION_BUCKETS = [
    ("0–100", 0.0, 100.0), ("100–500", 100.0, 500.0), ("500–1k", 500.0, 1000.0),
    ("1k–2k", 1000.0, 2000.0), (">2k", 2000.0, float("inf")),
]

# -- fixed values: parameter bounds of the queries ----------------------------
BOUNDS = {
    "since_minutes": (1, 1440),
    "since_hours": (1, 168),
    "limit_large": (1, 5000),
    "limit": (1, 1000),
    "limit_trends": (1, 500),
    "limit_analysis": (1, 50),
}

# -- fixed values: prices of the cost roll-up ---------------------------------
INPUT_USD_PER_MILLION = 3.0
OUTPUT_USD_PER_MILLION = 15.0
GPU_USD_PER_HOUR = 0.5
MODEL_MS_PER_CALL = 200.0
REPORT_MS_PER_CALL = 3000.0
