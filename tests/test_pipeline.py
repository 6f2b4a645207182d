"""All stages on generated rows."""

from pyspark.sql import functions as F

from tracewell.plans import pipeline
from tracewell.sources import generator


def test_end_to_end(spark):
    rows = generator.transactions(spark, 600)
    some = rows.where("attack_type = 'Normal'").limit(1).select(F.get(F.split("output_addresses", r"\|"), F.lit(0)).alias("address"), F.lit("Bank").alias("entity_name"))
    watch = rows.where("attack_type = 'Peel_Chain'").orderBy("row_idx").limit(1).select(F.get(F.split("input_addresses", r"\|"), F.lit(0)).alias("indicator"), F.lit("address").alias("type"), F.lit("bad").alias("label"), F.lit(0.9).alias("severity"))
    got = pipeline.run(rows, some, watch).join(rows.select("row_idx", "attack_type"), "row_idx").collect()
    assert len(got) == 600 and all(r.explanation and r.risk_tier and 0 <= r.risk_score <= 100 for r in got)
    assert sum(r.detected_type == r.attack_type or r.attack_type == "Normal" for r in got) >= 0.98 * len(got)
    assert {r.detected_type for r in got} >= {"CoinJoin_Mixer", "Peel_Chain", "FanOut_Dispersal", "Fee_Spike", "Normal_P2P", "Whitelisted_Institutional"}
    hit = [r for r in got if r.watchlist_label]
    assert len(hit) == 1 and hit[0].score_graph == 100.0 and hit[0].explanation.startswith("Direct watchlist match: bad")
    assert [r for r in got if r.whitelisted_side == "output"][0].whitelist_factor == 0.15
    bare = pipeline.run(rows.limit(50), some).collect()
    assert len(bare) == 50 and all(r.score_graph == 0.0 for r in bare)


def test_lists_in_any_notation(spark):
    rows = generator.transactions(spark, 60)
    lists = [c for c in rows.columns if c.endswith(("_addresses", "_amounts"))]
    other = rows.withColumns({c: F.concat(F.lit("["), F.replace(c, F.lit("|"), F.lit(", ")), F.lit("]")) for c in lists})
    none = rows.limit(0).select(F.lit("").alias("address"), F.lit("").alias("entity_name"))
    assert sorted(pipeline.run(other, none).collect()) == sorted(pipeline.run(rows, none).collect())
