"""Size estimates of tables."""
from pyspark.sql import functions as F

from tidewatch.ml import logs as L
from tidewatch.session import broadcast_if_small, cut


def test_broadcast_of_a_table_with_an_endless_estimate(spark):
    df = cut(spark.range(3))
    for _ in range(9):                                  # the estimate is cubed nine times
        df = cut(df.join(df.select("id"), "id").join(df.select("id"), "id").distinct())
    assert sorted(r.id for r in broadcast_if_small(df).distinct().collect()) == [0, 1, 2]


def test_settled_rows_are_estimated_by_their_files(spark):
    from tidewatch.session import settled

    df = settled(cut(spark.range(3).crossJoin(spark.range(10**9).withColumnRenamed("id", "k")).where("k < 2")))
    assert df.count() == 6 and int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) < 100_000


def test_lines_are_assigned_where_clusters_take_rounds(spark):
    chain = [" ".join(f"{chr(97 + j % 26)}{chr(97 + j // 26)}w" for j in range(i, i + 20)) for i in range(40)]     # each like the next, the ends unlike
    rows = [(10 * i + k, i, "s", text, "INFO") for i, text in enumerate(chain) for k in range(6)]
    lines = spark.createDataFrame(rows, "id long, timestamp long, service string, message string, severity string")
    clusters = cut(L.cluster(lines))
    assert L.assign(lines, clusters).count() == len(rows)
    fresh = lines.withColumn("message", F.concat("message", F.lit(" other")))
    found = {r.is_new_pattern for r in L.assign(fresh, clusters).collect()}
    assert found <= {True, False} and None not in found


def test_token_sets_are_not_copied_for_each_rare_token(spark):
    texts = [(i, [f"{c}{(i * 7 + c * c) % 90}" for c in range(60)]) for i in range(200)]
    t = spark.createDataFrame(texts, "id long, tokens array<string>")
    rare = L.rare_tokens(t, L.token_counts(t), 0.6)
    assert not [f for f in rare.schema.fields if f.dataType.simpleString().startswith("array")]
    assert {r.k for r in rare.groupBy("id").agg(F.count("token").alias("k")).collect()} == {25}          # 60 - 36 + 1
