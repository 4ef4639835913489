"""Log templates, embeddings, pattern clusters and incident sequences.

Messages are collapsed to templates first: everything costly runs on distinct templates, weighted by their counts.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline
from pyspark.ml.feature import IDF, PCA, HashingTF, Normalizer, RegexTokenizer
from pyspark.sql import Column, DataFrame, Window, functions as F

from tidewatch.functions.series import floor_ts, micros, row_frames, with_last, with_position
from tidewatch.ml.density import density_clusters
from tidewatch.session import broadcast_if_small, settled

# -- fixed values: masks of variable parts, applied in this order -------------
MASKS = [
    (r"\"[^\"]*\"|'[^']*'", "<str>"),
    (r"[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}", "<ip>"),
    (r"[0-9a-fA-F]{8}-[0-9a-fA-F-]{27,}", "<id>"),
    (r"[0-9]+(\.[0-9]+)?", "<n>"),
]
MIN_CLUSTER = 5
MIN_SAMPLES = 3
MIN_SIMILARITY = 0.6
LEVELS = 100                         # levels of distance between equal and wholly different templates
BLOCK = 1000
SKETCH = 4                           # words of 64 bits


def template(message: Column) -> Column:
    for pattern, mask in MASKS:
        message = F.regexp_replace(message, pattern, mask)
    return message


def templates(logs: DataFrame, message: str = "message") -> DataFrame:
    """Distinct templates with their message count."""
    return logs.groupBy(template(F.col(message)).alias("template")).agg(F.count(F.lit(1)).alias("n"))


def embedder(features: int = 1024) -> Pipeline:
    """Unit-length TF-IDF vectors of a ``template`` column."""
    return Pipeline(stages=[
        RegexTokenizer(inputCol="template", outputCol="tokens", pattern=r"\s+"), HashingTF(inputCol="tokens", outputCol="tf", numFeatures=features),
        IDF(inputCol="tf", outputCol="tfidf"), Normalizer(inputCol="tfidf", outputCol="vector")])


def embed(logs: DataFrame, message: str = "message") -> tuple[DataFrame, object]:
    """``(templates with vector, fitted pipeline)``."""
    t = templates(logs, message)
    model = embedder().fit(t)
    return model.transform(t).select("template", "n", "vector"), model


def reduce(vectors: DataFrame, k: int = 15) -> DataFrame:
    return PCA(k=k, inputCol="vector", outputCol="reduced").fit(vectors).transform(vectors)


# ---- clusters ---------------------------------------------------------------
def tokens_of(t: str = "template") -> Column:
    return F.array_distinct(F.split(F.lower(F.trim(t)), r"\s+"))


def jaccard(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))


def rare_tokens(t: DataFrame, counts: DataFrame, least: float) -> DataFrame:
    """``id, of, token``: a row for each of the rarest tokens of a set. Two sets whose Jaccard coefficient is at least ``least`` share
    one of these: the smaller share of a set that the other must hold leaves no more than the rest of it out.

    ``of`` stands for the set, which is not copied: its size ``n``, the place ``i`` of the token by rarity, and a sketch of four times 64 bits, each the
    parity of the tokens that fall on it."""
    bit = F.pmod(F.xxhash64("token"), F.lit(64 * SKETCH))
    placed = t.select("id", F.explode("tokens").alias("token")).join(broadcast_if_small(counts), "token").withColumn("_bit", bit)
    one = F.expr("shiftleft(1L, CAST(_bit % 64 AS INT))")
    words = [F.bit_xor(F.when(F.floor(F.col("_bit") / 64) == k, one).otherwise(F.lit(0).cast("long"))).alias(f"_w{k}") for k in range(SKETCH)]
    ranked = placed.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("c", "token"))).alias("_by"), *words)
    n = F.size("_by")
    first = F.slice("_by", F.lit(1), F.least(n, n - F.ceil(n * least - 1e-9).cast("int") + 1))
    out = ranked.select("id", n.alias("n"), *[f"_w{k}" for k in range(SKETCH)], F.posexplode(F.transform(first, lambda x: x["token"])).alias("i", "token"))
    return out.select("id", F.struct("n", "i", *[f"_w{k}" for k in range(SKETCH)]).alias("of"), "token")


def may_be_similar(a: str, b: str, least: float) -> Column:
    """Whether two sets that share a token can have a Jaccard coefficient of at least ``least``, by their ``of``. True for all that have, at the first token they share:
    no more than the rest of each set from there on is common, and no more bits differ than tokens do."""
    a, b = F.col(a), F.col(b)
    both = a["n"] + b["n"]
    common = F.least(a["n"] - a["i"], b["n"] - b["i"])
    apart = sum((F.bit_count(a[f"_w{k}"].bitwiseXOR(b[f"_w{k}"])) for k in range(SKETCH)), F.lit(0))
    return (common * (1 + least) >= both * least - 1e-6) & (apart * (1 + least) <= both * (1 - least) + 1e-6)


def token_counts(t: DataFrame) -> DataFrame:
    return t.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("c"))


def in_blocks(rows: DataFrame, sizes: DataFrame) -> DataFrame:
    """``rows`` with ``_n``, the number of blocks of about ``BLOCK`` rows that the table of ``sizes`` has for their token, and ``_own``, the row's number."""
    blocks = sizes.groupBy("token").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("_n"))
    return rows.join(broadcast_if_small(blocks), "token").withColumn("_own", F.pmod(F.xxhash64("id"), F.col("_n")).cast("int"))


def similar_pairs(t: DataFrame, least: float = MIN_SIMILARITY) -> DataFrame:
    """All links ``a, b, similarity`` (``b`` the smaller id) between templates with a Jaccard coefficient of at least ``least``, which is above 0.

    Pairs that share one of their rare tokens are verified, after their sizes and sketches have ruled most of them out. The templates of a token meet in
    cells of about ``BLOCK`` by ``BLOCK``, so that no task gets all the pairs of a full one; the token sets are joined to what is left."""
    rare = settled(rare_tokens(t, token_counts(t), least))
    own = in_blocks(rare, rare)
    left = own.withColumn("_to", F.explode(F.sequence(F.lit(0), F.col("_own")))).select("token", F.col("_own").alias("_i"), F.col("_to").alias("_j"), F.col("id").alias("x"), F.col("of").alias("ox"))
    right = own.withColumn("_from", F.explode(F.sequence(F.col("_own"), F.col("_n") - 1))).select("token", F.col("_from").alias("_i"), F.col("_own").alias("_j"), F.col("id").alias("y"), F.col("of").alias("oy"))
    apart = (F.col("_i") != F.col("_j")) | (F.col("x") > F.col("y"))
    met = left.join(right, ["token", "_i", "_j"]).filter(apart & may_be_similar("ox", "oy", least))
    met = settled(met.select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct())
    links = met.join(t.select(F.col("id").alias("a"), F.col("tokens").alias("ta")), "a").join(t.select(F.col("id").alias("b"), F.col("tokens").alias("tb")), "b")
    return links.select("a", "b", jaccard(F.col("ta"), F.col("tb")).alias("similarity")).filter(F.col("similarity") >= least).distinct()


def template_id(t: str = "template") -> Column:
    """Sixty bits of the digest of a template."""
    return F.conv(F.substring(F.md5(t), 1, 15), 16, 10).cast("bigint")


def cluster(logs: DataFrame, message: str = "message", least: float = MIN_SIMILARITY, smallest: int = MIN_CLUSTER, samples: int = MIN_SAMPLES) -> DataFrame:
    """``template, n, cluster_id``: hierarchical density clusters of templates, a message being a point; -1 is noise.

    The distance of two templates is one less their Jaccard coefficient, in hundredths rounded up; templates less similar than ``least`` are never
    joined. The cluster id is the smallest ``template_id`` in it. See ``density`` for what is a cluster.
    """
    t = settled(templates(logs, message).where("template IS NOT NULL").withColumn("id", template_id()).withColumn("tokens", tokens_of()))
    level = F.greatest(F.lit(1), F.ceil(LEVELS * (1 - F.col("similarity")) - 1e-9)).cast("int")
    pairs = similar_pairs(t, least).select("a", "b", level.alias("level"))
    labels = density_clusters(t.select("id", "n"), pairs, round(LEVELS * (1 - least)), smallest, samples)
    return t.join(labels, "id").select("template", "n", F.coalesce("label", F.lit(-1)).alias("cluster_id"))


def with_cluster(logs: DataFrame, clusters: DataFrame, message: str = "message") -> DataFrame:
    """Lines with the cluster of their template. Where the clusters are many, a template's lines are dealt out by the skew join."""
    return logs.withColumn("template", template(F.col(message))).join(broadcast_if_small(clusters.select("template", "cluster_id")), "template")


# ---- patterns ---------------------------------------------------------------
def patterns(logs: DataFrame, cid: str = "cluster_id", order: Sequence[str] = ("timestamp", "id")) -> DataFrame:
    """One row per cluster: size, representative, keywords, severity and service distribution, three examples."""
    rows = logs.filter(F.col(cid) != -1)
    at = F.struct(*order)
    sizes = rows.groupBy(cid).agg(F.count(F.lit(1)).alias("size"), F.min_by("message", at).alias("representative"))
    counts = rows.select(cid, F.explode(F.filter(F.split("message", r"\s+"), lambda t: t != "")).alias("token")).groupBy(cid, "token").agg(F.count(F.lit(1)).alias("c"))
    top = counts.withColumn("_r", F.row_number().over(Window.partitionBy(cid).orderBy(F.desc("c"), "token"))).filter("_r <= 10")
    common = top.join(sizes.select(cid, "size"), cid).filter(F.col("c") > F.col("size") * 0.3)
    words = common.groupBy(cid).agg(F.slice(F.transform(F.array_sort(F.collect_list(F.struct("_r", "token"))), lambda x: x["token"]), 1, 8).alias("pattern_keywords"))
    tally = lambda c, name: rows.filter(F.col(c).isNotNull()).groupBy(cid, c).agg(F.count(F.lit(1)).alias("n")).groupBy(cid).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(c, "n")))).alias(name))
    early = rows.withColumn("_r", F.row_number().over(Window.partitionBy(cid).orderBy(*order))).filter("_r <= 3")
    examples = early.groupBy(cid).agg(F.transform(F.array_sort(F.collect_list(F.struct("_r", "message"))), lambda x: x["message"]).alias("examples"))
    out = sizes.join(words, cid, "left").join(tally("severity", "severity_distribution"), cid, "left").join(tally("service", "service_distribution"), cid, "left").join(examples, cid)
    none = F.create_map().cast("map<string,bigint>")
    return out.withColumns({"pattern_keywords": F.coalesce("pattern_keywords", F.array().cast("array<string>")),
                            **{c: F.coalesce(c, none) for c in ("severity_distribution", "service_distribution")}})


def pattern_label() -> Column:
    """``SEVERITY: kw kw kw`` with the most frequent severity (ties to the first by name); ``unknown`` without any."""
    entries = F.transform(F.map_entries("severity_distribution"), lambda e: F.struct((-e["value"]).alias("n"), e["key"].alias("k")))
    return F.coalesce(F.concat(F.array_min(entries)["k"], F.lit(": "), F.array_join(F.slice("pattern_keywords", 1, 3), " ")), F.lit("unknown"))


def pattern_summary(p: DataFrame, cid: str = "cluster_id") -> DataFrame:
    total = p.agg(F.count(F.lit(1)).alias("total_patterns"))          # one row
    return p.select(F.col(cid).alias("cluster_id"), pattern_label().alias("label"), "size", "pattern_keywords", "severity_distribution",
                    F.substring("representative", 1, 100).alias("representative")).join(F.broadcast(total))


def assign(messages: DataFrame, clusters: DataFrame, labels: DataFrame | None = None, least: float = MIN_SIMILARITY) -> DataFrame:
    """New messages to known clusters: equal template first, else the cluster of the most similar of all templates.

    Adds ``cluster_id`` (-1 for a new pattern), ``confidence`` and ``is_new_pattern``. Only distinct templates are matched.
    """
    logs = messages.withColumn("template", template(F.col("message")))
    fresh = settled(logs.select("template").distinct()).withColumn("tokens", tokens_of())
    known = clusters.filter("cluster_id <> -1").select("template", "cluster_id")
    exact = fresh.join(known, "template").select("template", "cluster_id", F.lit(1.0).alias("confidence"))
    old = known.withColumn("tokens", tokens_of()).withColumn("id", F.struct("cluster_id", "template"))
    new = fresh.join(known, "template", "left_anti").withColumn("id", F.col("template"))
    counts = settled(token_counts(old.select("tokens").unionByName(new.select("tokens"))))
    offers = settled(rare_tokens(old, counts, least))
    parts = in_blocks(offers, offers).select("token", F.col("_own").alias("_i"), F.col("id").alias("near"), F.col("of").alias("oy"))
    asked = in_blocks(rare_tokens(new, counts, least), offers).withColumn("_i", F.explode(F.sequence(F.lit(0), F.col("_n") - 1))).select(F.col("id").alias("template"), F.col("of").alias("ox"), "token", "_i")
    met = settled(asked.join(parts, ["token", "_i"]).filter(may_be_similar("ox", "oy", least)).select("template", "near").distinct())
    sets = met.join(new.select("template", "tokens"), "template").join(old.select(F.col("id").alias("near"), F.col("tokens").alias("other")), "near")
    close = sets.select("template", F.col("near.cluster_id").alias("cluster_id"), jaccard(F.col("tokens"), F.col("other")).alias("confidence")).filter(F.col("confidence") >= least)
    best = close.groupBy("template").agg(F.max_by(F.struct("cluster_id", "confidence"), F.struct("confidence", "cluster_id")).alias("b")).select("template", "b.*")
    found = exact.unionByName(best)
    out = logs.join(broadcast_if_small(settled(found)), "template", "left").withColumns({
        "cluster_id": F.coalesce("cluster_id", F.lit(-1)), "confidence": F.round(F.coalesce("confidence", F.lit(0.0)), 4)}).withColumn("is_new_pattern", F.col("cluster_id") == -1)
    if labels is not None:
        out = out.join(labels.select("cluster_id", "label"), "cluster_id", "left").withColumn("cluster_label", F.coalesce("label", F.lit("unknown/new_pattern"))).drop("label")
    return out.drop("template")


def window_patterns(lines: DataFrame, windows: DataFrame, summary: DataFrame, seconds: int = 3600) -> DataFrame:
    """``service, window_id, log_lines, new_patterns_detected, log_patterns``: the patterns of the lines of each window's service and time, by cluster id.

    ``lines``: service, timestamp, severity and ``cluster_id``, as ``assign`` gives it; ``windows``: window_id, service, timestamp, a row per step of ``seconds``;
    ``summary``: cluster_id, label, size. A line is in a window if its step is not before the first nor after the last of the window, also where the metrics have
    a gap, so in as many windows as overlap there. Lines in no window are together in a row of their service without ``window_id``.

    Lines are counted per step and cluster first; only the counts meet the windows, at the last step with metrics that is not after their own.
    """
    step = floor_ts("timestamp", seconds)
    counts = settled(lines.groupBy("service", step.alias("at"), "cluster_id").agg(F.count(F.lit(1)).alias("lines"), F.count_if(F.col("severity") == "ERROR").alias("errors")))
    spans = settled(windows.groupBy("service", "window_id").agg(F.collect_set(step).alias("_steps"), F.max(step).alias("_end")).select("service", "window_id", "_end", F.explode("_steps").alias("_row")))
    marks = spans.select("service", F.col("_row").alias("at"), F.col("_row")).unionByName(counts.select("service", "at", F.lit(None).cast("timestamp_ntz").alias("_row")))
    rows = with_last(marks.groupBy("service", "at").agg(F.max("_row").alias("_own")), ["service"], ["at"], "at", "_own", "_row").select("service", "at", "_row")
    placed = counts.join(rows, ["service", "at"], "left").alias("c")
    inside = (F.col("c.service") == F.col("w.service")) & (F.col("c._row") == F.col("w._row")) & (F.col("c.at") <= F.col("w._end"))
    met = placed.join(spans.alias("w"), inside, "left").groupBy("c.service", "w.window_id", "c.cluster_id").agg(F.sum("c.lines").alias("lines"), F.sum("c.errors").alias("errors"))
    named = met.join(broadcast_if_small(summary.select("cluster_id", "label", "size")), "cluster_id", "left")
    new = F.col("cluster_id") == -1
    pattern = F.struct("cluster_id", "label", "size", "lines", "errors")
    return named.groupBy("service", "window_id").agg(
        F.sum("lines").alias("log_lines"), F.sum(F.when(new, F.col("lines")).otherwise(0)).alias("new_patterns_detected"),
        F.array_sort(F.collect_list(F.when(~new, pattern))).alias("log_patterns"))


# ---- incident sequences -----------------------------------------------------
# -- fixed values: recognised steps and the ordered sequences of known incidents --
STEPS = [
    ("heap_warning", "JVM heap usage at"), ("gc_pause", "GC pause:"), ("oom_error", "OutOfMemoryError"), ("startup_failure", "Application startup failed"),
    ("retry_attempt", "Retry attempt"), ("circuit_breaker", "Circuit breaker"), ("service_unavailable", "HTTP 503 from"), ("connection_refused", "Connection refused to"),
    ("slo_breach", "Response time"), ("db_pool_exhausted", "Database connection pool exhausted"), ("slow_query", "Slow query detected"),
    ("pool_exhaustion", "Connection pool nearing capacity"), ("tx_rollback", "Transaction rolled back"),
]
INCIDENTS = {
    "memory_leak_sequence": ["heap_warning", "heap_warning", "gc_pause", "heap_warning", "oom_error", "startup_failure"],
    "cascade_failure_sequence": ["retry_attempt", "circuit_breaker", "service_unavailable", "connection_refused", "slo_breach", "db_pool_exhausted"],
    "db_overload_sequence": ["slow_query", "pool_exhaustion", "slow_query", "db_pool_exhausted", "tx_rollback"],
}


def step_of(message: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, text in reversed(STEPS):
        out = F.when(message.startswith(text), name).otherwise(out)
    return out


def incident_sequences(logs: DataFrame, within_seconds: int = 24 * 3600, key: str = "service", order: Sequence[str] = ("timestamp", "id")) -> DataFrame:
    """Runs of the known sequences among the recognised lines of a service: ``service, incident, start, end``.

    For each incident only its own steps are kept; a run is those steps in order and adjacent. The frame is as long as
    the sequence, so a busy service is never gathered.
    """
    stepped = logs.withColumn("step", step_of(F.col("message"))).filter("step IS NOT NULL").select(key, *order, "step")
    parts = []
    for name, steps in INCIDENTS.items():
        n = len(steps)
        mine = with_position(stepped.filter(F.col("step").isin(*set(steps))), [key], order, order[0])
        halo, w, own = row_frames(mine, [key], "idx", 0, n - 1)
        runs = halo.withColumn("_steps", F.collect_list("step").over(w)).withColumn("end", F.last(order[0]).over(w)).filter(F.col(own))
        hit = (F.col("_steps") == F.array(*[F.lit(s) for s in steps])) & (micros("end") - micros(order[0]) <= within_seconds * 1_000_000)
        parts.append(runs.filter(hit).select(key, F.lit(name).alias("incident"), F.col(order[0]).alias("start"), "end"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
