"""Both sides of a reconciliation, derived from the test tables ``orders`` and ``customer``, and decisions over them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.references import Decisions

#: The same derivation for DuckDB: CTEs l and r with the columns of ``records``, and both as recs.
SQL = """
o AS (SELECT o_orderkey AS k, c_mktsegment AS seg, CAST(o_totalprice AS DECIMAL(18,2)) AS amount, CAST(o_orderdate AS TIMESTAMP) AS d FROM orders JOIN customer ON o_custkey = c_custkey),
b AS (SELECT k, seg AS instrument, CASE WHEN k % 2 = 0 THEN 'BUY' ELSE 'SELL' END AS side, CASE k % 3 WHEN 0 THEN 'USD' WHEN 1 THEN 'EUR' ELSE 'GBP' END AS currency,
  CAST(k % 97 + 1 AS BIGINT) AS quantity, CAST(amount * 100 AS BIGINT) AS cents, d + to_seconds(k * 7919 % 86400) AS executed_at, CASE WHEN k % 13 = 0 THEN 'CANCELLED' ELSE 'SETTLED' END AS state FROM o),
l AS (SELECT 'L' AS rec_side, 'L' || k AS id, k, 'T' || k AS reference, instrument, side, currency, quantity, CASE WHEN k % 6 <> 0 THEN cents END AS price_cents, cents, executed_at, state FROM b),
r AS (SELECT 'R' AS rec_side, 'R' || k AS id, k, CASE WHEN k % 4 = 0 THEN NULL WHEN k % 17 = 0 THEN 'T' || (k - 1) ELSE 'T' || k END AS reference, instrument, side, currency, CASE WHEN k % 53 <> 0 THEN quantity END AS quantity,
  CASE WHEN k % 6 <> 0 THEN cents END AS price_cents, cents + CASE WHEN k % 7 = 0 THEN 3 ELSE 0 END + CASE WHEN k % 19 = 0 THEN 500 ELSE 0 END AS cents,
  executed_at + to_seconds(CASE WHEN k % 5 = 0 THEN 30 ELSE 0 END) + to_seconds(CASE WHEN k % 23 = 0 THEN 300 ELSE 0 END) AS executed_at, state FROM b WHERE k % 11 <> 0
  UNION ALL SELECT 'R', 'Q' || k, k, NULL, instrument, side, currency, quantity, CASE WHEN k % 6 <> 0 THEN cents END, cents + 50, executed_at + to_seconds(CASE WHEN k % 16 = 0 THEN 400 ELSE 60 END), state FROM b WHERE k % 8 = 0 AND k % 11 <> 0),
recs AS (SELECT * FROM l UNION ALL SELECT * FROM r)"""


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """rec_side, id, reference, instrument, side, currency, quantity, unit_price, gross_amount, executed_at, state (and k).

    Every eighth key has a rival on the right (Q): near in amount and time, so left records without a reference pair are contested."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderdate")
    customer = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", "c_mktsegment")
    k = F.col("o_orderkey")
    amount = F.col("o_totalprice").cast("decimal(18,2)")
    time = F.col("o_orderdate").cast("timestamp") + F.make_dt_interval(secs=(k * 7919 % 86400).cast("decimal(18,6)"))
    base = orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).select(
        k.alias("k"), F.col("c_mktsegment").alias("instrument"), F.when(k % 2 == 0, "BUY").otherwise("SELL").alias("side"), F.when(k % 3 == 0, "USD").when(k % 3 == 1, "EUR").otherwise("GBP").alias("currency"),
        (k % 97 + 1).cast("decimal(28,12)").alias("quantity"), F.when(k % 6 != 0, amount).cast("decimal(28,12)").alias("unit_price"), amount.cast("decimal(28,12)").alias("gross_amount"),
        time.alias("executed_at"), F.when(k % 13 == 0, "CANCELLED").otherwise("SETTLED").alias("state"),
    )
    k = F.col("k")
    names = ["rec_side", "id", "k", "reference", "instrument", "side", "currency", "quantity", "unit_price", "gross_amount", "executed_at", "state"]
    text = k.cast("string")
    left = base.withColumn("rec_side", F.lit("L")).withColumn("id", F.concat(F.lit("L"), text)).withColumn("reference", F.concat(F.lit("T"), text))
    right = base.where(k % 11 != 0).withColumn("rec_side", F.lit("R")).withColumn("id", F.concat(F.lit("R"), text))
    right = right.withColumn("reference", F.when(k % 4 == 0, None).when(k % 17 == 0, F.concat(F.lit("T"), (k - 1).cast("string"))).otherwise(F.concat(F.lit("T"), text)))
    more = F.when(k % 7 == 0, F.expr("0.03BD")).otherwise(F.expr("0.00BD")) + F.when(k % 19 == 0, F.expr("5.00BD")).otherwise(F.expr("0.00BD"))
    late = F.when(k % 5 == 0, 30).otherwise(0) + F.when(k % 23 == 0, 300).otherwise(0)
    right = right.withColumn("gross_amount", (F.col("gross_amount").cast("decimal(18,2)") + more).cast("decimal(28,12)")).withColumn("executed_at", F.col("executed_at") + F.make_dt_interval(secs=late.cast("decimal(18,6)")))
    right = right.withColumn("quantity", F.when(k % 53 != 0, F.col("quantity")))
    rival = base.where("k % 8 = 0 and k % 11 <> 0").withColumn("rec_side", F.lit("R")).withColumn("id", F.concat(F.lit("Q"), text)).withColumn("reference", F.lit(None).cast("string"))
    rival = rival.withColumn("gross_amount", (F.col("gross_amount").cast("decimal(18,2)") + F.expr("0.50BD")).cast("decimal(28,12)"))
    rival = rival.withColumn("executed_at", F.col("executed_at") + F.make_dt_interval(secs=F.when(k % 16 == 0, 400).otherwise(60).cast("decimal(18,6)")))
    return left.select(*names).unionByName(right.select(*names)).unionByName(rival.select(*names))


def decisions(recs: DataFrame) -> Decisions:
    """Links of every 101st key, accepted left records of every 103rd, rejected edges of every 107th, reserved right records of every 109th."""
    k = recs.where("rec_side = 'L'").select("k")
    name = lambda side: F.concat(F.lit(side), F.col("k").cast("string"))
    pair = [name("L").alias("left_id"), name("R").alias("right_id")]
    return Decisions(k.where("k % 101 = 0").select(*pair), k.where("k % 103 = 0 and k % 101 <> 0").select(name("L").alias("id")), k.where("k % 107 = 0").select(*pair), k.where("k % 109 = 0 and k % 101 <> 0").select(name("R").alias("id")))
