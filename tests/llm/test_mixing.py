import math

from pyspark.sql import functions as F

from postlane.llm import mixing


def test_cdf_is_the_poisson_distribution(spark):
    for rate in (0.01, 0.7, 3.0, 250.0, 9000.0):
        cdf, lowest = spark.range(1).select(mixing.poisson_cdf(F.lit(rate)), mixing.lowest_count(F.lit(rate))).first()
        total, expected = 0.0, []
        for k in range(lowest, lowest + len(cdf)):
            total += math.exp(k * math.log(rate) - rate - math.lgamma(k + 1))
            expected.append(total)
        assert max(abs(a - b) for a, b in zip(cdf, expected)) < 1e-9
        assert abs(cdf[-1] - 1) < 1e-9


def test_sources_reach_their_shares(spark):
    docs = spark.range(20_000).select(
        F.col("id").alias("doc_id"),
        F.repeat(F.lit("x"), F.lit(100)).alias("text"),
        F.when(F.col("id") % 10 < 6, "big").when(F.col("id") % 10 < 8, "small").otherwise("rest").alias("source"),
    )
    mixed = mixing.mix_sources(docs, {"big": 0.3, "small": 0.5}, 0.2, epochs=1.5, seed=3)
    counts = {r["source"]: r["count"] for r in mixed.groupBy("source").count().collect()}
    for source, share in (("big", 0.3), ("small", 0.5), ("rest", 0.2)):
        assert abs(counts[source] / 30_000 - share) < 0.02


def test_same_draw_for_any_partitioning_and_global_order(spark):
    docs = spark.range(2000).selectExpr("id as doc_id", "'abc' as text", "'s' as source")
    a = mixing.mix_sources(docs, {"s": 1.0}, 0.0, seed=5)
    b = mixing.mix_sources(docs.repartition(7), {"s": 1.0}, 0.0, seed=5)
    rows = [(r["doc_id"], r["copy_no"], r["shuffle_key"]) for r in a.collect()]
    assert rows == [(r["doc_id"], r["copy_no"], r["shuffle_key"]) for r in b.collect()]
    assert [r[2] for r in rows] == sorted(r[2] for r in rows)
    assert [r[0] for r in rows] != sorted(r[0] for r in rows)


def test_odd_rows(documents, odd_rows):
    df = documents(*odd_rows, clashing=True)
    out = mixing.mix_sources(df, {"s1": 0.5}, 0.5, epochs=3.0)
    assert set(out.columns) == set(df.columns) | {"shuffle_key"}
    rows = out.collect()
    assert {r["doc_id"] for r in rows} <= {r[0] for r in odd_rows}
    assert all(isinstance(r["copy_no"], int) for r in rows)
    assert all(r["a.b"] == "x" for r in rows)


def test_empty_table_and_massless_group(documents):
    assert mixing.mix_sources(documents(), {"s": 1.0}, 0.0).count() == 0
    # Without mass a group's rate is one; the draw then decides as usual.
    out = mixing.mix_sources(documents((1, None, None, "s"), (2, "abc", None, "t")), {"s": 0.5}, 0.5)
    assert out.where("source = 's'").count() >= 0


def test_a_massless_group_is_drawn_at_rate_one(spark):
    docs = spark.range(20_000).selectExpr("id as doc_id", "if(id % 2 = 0, '', null) as text", "'s' as source")
    docs = docs.unionByName(spark.range(20_000, 20_100).selectExpr("id as doc_id", "'abc' as text", "'t' as source"))
    out = mixing.mix_sources(docs, {"s": 0.5}, 0.5).where("source = 's'")
    counts = [r["count"] for r in out.groupBy("doc_id").count().collect()]
    assert abs(1 - len(counts) / 20_000 - math.exp(-1)) < 0.02
    assert abs(sum(n > 1 for n in counts) / 20_000 - (1 - 2 * math.exp(-1))) < 0.02
    assert abs(sum(counts) / 20_000 - 1) < 0.03
