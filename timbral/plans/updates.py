"""Registered queries of compressed updates and of files written and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from timbral.operators import compression, learning
from timbral.plans.queries import query
from timbral.session import table

ROUNDS = list(range(1, 8))
#: Rows that a task groups, about, where groups are nearly as many as rows.
TASK_ROWS = 1 << 20
UPDATES = """u as (select l_linenumber as round, l_suppkey as client, case when l_returnflag = 'R' then 1 else 0 end as param, l_partkey % 32 as place, sum(l_discount - 0.05) as value from lineitem group by 1, 2, 3, 4)"""


def updates(spark: SparkSession, sf: str) -> DataFrame:
    """(round, client, param, place, value): line numbers are rounds, suppliers clients."""
    rows = table(spark, sf, "lineitem")
    key = [F.col("l_linenumber").alias("round"), F.col("l_suppkey").alias("client"), F.when(F.col("l_returnflag") == "R", 1).otherwise(0).alias("param"), (F.col("l_partkey") % 32).alias("place")]
    return rows.groupBy(*key).agg(F.sum(F.col("l_discount") - 0.05).alias("value"))


def rounds_sql(sent: str, places: int) -> str:
    """All rounds as chained tables; `sent` is an expression over c (corrected), rank r and count n."""
    parts = [UPDATES, "s0 as (select client, param, place, 0.0::double as plain, 0.0::double as sent, 0.0::double as residual from u where false)"]
    for k in ROUNDS:
        parts.append(f"j{k} as (select coalesce(a.client, b.client) as client, coalesce(a.param, b.param) as param, coalesce(a.place, b.place) as place, coalesce(a.value, 0) as v, round(coalesce(a.value, 0) + coalesce(b.residual, 0), 9) as c, coalesce(b.plain, 0) as plain, coalesce(b.sent, 0) as sent from (select * from u where round = {k}) a full join s{k - 1} b on a.client = b.client and a.param = b.param and a.place = b.place)")
        parts.append(f"t{k} as (select *, row_number() over (partition by client, param order by abs(c) desc, place) as r, count(*) over (partition by client, param) as n, max(abs(c)) over (partition by client, param) / 127 as step from j{k})")
        parts.append(f"s{k} as (select client, param, place, plain + v as plain, sent + {sent} as sent, c - {sent} as residual from t{k})")
    return f"with {', '.join(parts)} select client, param, place, round(plain, {places}) + 0 as plain, round(sent, {places}) + 0 as sent, round(residual, {places}) + 0 as residual from s{ROUNDS[-1]}"


def settled(found: DataFrame, places: int) -> DataFrame:
    return found.select("client", "param", "place", *[(F.round(c, places) + 0).alias(c) for c in ("plain", "sent", "residual")])


@query(rounds_sql("case when r <= greatest(1, floor(n * 0.1)) then c else 0 end", 6))
def feedback_topk(spark, sf):
    return settled(compression.compress_rounds(updates(spark, sf), ROUNDS), 6)


@query(rounds_sql("round_even(c / (case when step > 0 then step else 1 end), 0) * (case when step > 0 then step else 1 end)", 6))
def feedback_quantize(spark, sf):
    return settled(compression.compress_rounds(updates(spark, sf), ROUNDS, method="quantize"), 6)


@query(f"with {UPDATES}, t as (select *, row_number() over (partition by client, param order by abs(round(value, 9)) desc, place) as r, count(*) over (partition by client, param) as n, max(place) over (partition by client, param) as last from u where round = 1), k as (select unnest(range(32)) as place), g as (select distinct client, param, last from t) select g.client, g.param, k.place, round(coalesce(case when r <= greatest(1, floor(n * 0.1)) then value end, 0), 6) + 0 as value from g join k on k.place <= g.last left join t on t.client = g.client and t.param = g.param and t.place = k.place")
def decompressed_round(spark, sf):
    """The first round's messages, and what the receiver makes of them."""
    sent = compression.message(compression.compress_round(updates(spark, sf).where("round = 1")))
    return compression.decompress(sent).select("client", "param", "place", (F.round("value", 6) + 0).alias("value"))


def secret_sql(part: str) -> str:
    """A uniform number in SQL from 48 bits of a digest of secret, part and key."""
    return f"((('0x' || substr(sha256('hush:{part}:' || l_orderkey || ':' || l_linenumber || ':' || l_partkey), 1, 12))::bigint + 0.5::double) / 281474976710656::double)"


@query(f"""with n as (select l_suppkey, sqrt(sum(l_discount * l_discount)) as norm from lineitem group by 1)
select l_orderkey, l_linenumber, round(sum(l_discount * least(1, 0.5 / (norm + 1e-10)) + sqrt(-2 * ln({secret_sql("size")})) * cos(2 * pi() * {secret_sql("turn")}) * (0.5 * sqrt(2 * ln(1.25 / 1e-5)) / 0.8)), 5) + 0 as noisy from lineitem join n using (l_suppkey) group by 1, 2""")
def gaussian_gradients(spark, sf):
    """Discounts clipped to norm 0.5 by supplier, with Gaussian noise at epsilon 0.8 and delta 1e-5."""
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_discount").alias("v"))
    found = learning.private_updates(rows, "l_suppkey", ["l_orderkey", "l_linenumber", "l_partkey"], "v", 0.5, 0.8, 1e-5, "hush")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // TASK_ROWS))
    laid = found.repartition(parts, "l_orderkey", "l_linenumber")  # nearly each row is a group: a task's grow with its rows
    return laid.groupBy("l_orderkey", "l_linenumber").agg((F.round(F.sum("noisy"), 5) + 0).alias("noisy"))
