"""Views of retail tables (events, customer, orders, lineitem, ...) as the logical tables.

Two adapters.  :class:`ClickWarehouse` reads the click events; :class:`OrderWarehouse` reads
order lines as a larger event stream with the same columns.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stepfall import schemas
from stepfall.constants import DECOY_SCREENS, FUNNEL
from stepfall.sources.tables import denormalise, records

# Click kind -> logical event for even and odd event ids.
EVENT_NAMES = {
    "signup": ("app_open", "home_view"),
    "view": ("product_browse", "product_detail_view"),
    "click": ("add_to_cart", "checkout_start"),
    "purchase": ("payment_submit", "order_confirmed"),
    "error": ("crash", "api_error"),
}

# What is assumed to be planted in each case: fault, cohort, target.
PLANTED = (
    ("case_0", "dead_screen", "os = 'HOUSEHOLD'", 8.0, False, False),
    ("case_1", "crash_concentration", "os = 'BUILDING' AND device_age_months > 24", 4.0, False,
     True),
    ("case_2", "none", "", 0.0, True, False),
)


def _pick(key: str, options) -> str:
    """SQL: the option numbered by the expression ``key``, from 0."""
    listed = ", ".join("NULL" if o is None else f"'{o}'" for o in options)
    return f"element_at(array({listed}), CAST({key} AS INT) + 1)"


# Columns of the retail tables; declaring them saves a schema-inference job per read.
COLUMNS = {
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, "
              "value double, props string",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, "
                "c_mktsegment string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "region": "r_regionkey int, r_name string",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, "
              "o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, "
                "l_quantity double, l_extendedprice double, l_discount double, l_tax double, "
                "l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, "
            "p_retailprice double",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "labels": "doc_id bigint, quality int, toxic int",
    "benchmark": "item_id bigint, text string",
    "embeddings": "vec_id bigint, embedding array<float>, label int",
}


class _Retail:
    base_date: dt.date
    window_days: int
    changepoint_day: int

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, str(sf_dir).rstrip("/")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.schema(COLUMNS[name]).parquet(f"{self.sf_dir}/{name}.parquet")

    @property
    def cases(self) -> DataFrame:
        rows = [(case, self.base_date, self.window_days, self.changepoint_day, trap, simpson,
                 target) for case, _, _, target, trap, simpson in PLANTED]
        return records(self.spark, rows, schemas.CASES)

    @property
    def answers(self) -> DataFrame:
        """Planted fault per case, without user ids."""
        rows = [(case, fault != "none", fault, cohort) for case, fault, cohort, *_ in PLANTED]
        planted = records(self.spark, rows, T._parse_datatype_string(
            "instance_id string, has_fault boolean, fault_type string, "
            "affected_cohort_predicate string"))
        return self.cases.join(planted, "instance_id").withColumn(
            "decoy_screens", F.array(*map(F.lit, DECOY_SCREENS))
        ).withColumn(
            "acceptable_mechanisms",
            F.array(F.when(F.col("has_fault"), F.col("fault_type"))
                    .otherwise(F.lit("innocent_dropoff"))))

    @property
    def user_rows(self) -> DataFrame:
        """Every customer as a user, without the acquisition time."""
        geo = (self.table("nation")
               .join(self.table("region"), F.col("n_regionkey") == F.col("r_regionkey"))
               .selectExpr("n_nationkey AS c_nationkey", "r_name AS geo"))
        return self.table("customer").join(geo, "c_nationkey", "left").selectExpr(
            "concat('case_', c_custkey % 3) AS instance_id",
            "CAST(c_custkey AS STRING) AS user_id",
            "c_mktsegment AS os",
            _pick("c_nationkey % 3", ("flagship", "mid", "budget")) + " AS device_type",
            "CAST(floor((c_acctbal + 1000) / 200) AS INT) AS device_age_months",
            "geo",
            _pick("c_custkey % 3", ("organic", "paid", "referral")) + " AS channel",
            "c_custkey % 2 = 0 AS is_returning")

    def denormalised(self, raw: DataFrame) -> DataFrame:
        return denormalise(raw, self.user_rows)


class ClickWarehouse(_Retail):
    """Click events: 30 days from 2024-01-01, changepoint on day 15."""

    base_date, window_days, changepoint_day = dt.date(2024, 1, 1), 30, 15

    @property
    def raw_events(self) -> DataFrame:
        """Events without user attributes; ``canonical`` is the restricted companion column."""
        canonical = " ".join(
            f"WHEN '{kind}' THEN if(event_id % 2 = 0, '{even}', '{odd}')"
            for kind, (even, odd) in EVENT_NAMES.items())
        screens = " ".join(f"WHEN '{name}' THEN '{where}'" for name, where in FUNNEL)
        day = f"datediff(ts, DATE '{self.base_date}')"
        return self.table("events").withColumn(
            "canonical", F.expr(f"CASE event_type {canonical} END")).selectExpr(
            "concat('case_', user_id % 3) AS instance_id",
            "CAST(user_id AS STRING) AS user_id",
            f"concat(user_id, '_', {day} div 3) AS session_id",
            "ts AS event_ts",
            "CASE event_id div 2 % 4 WHEN 0 THEN canonical "
            "WHEN 1 THEN array_join(transform(split(canonical, '_'), w -> initcap(w)), '') "
            "WHEN 2 THEN concat('evt_', canonical) ELSE replace(canonical, '_', '-') END "
            "AS event_name",
            "canonical",
            f"CASE canonical {screens} ELSE 'checkout' END AS screen",
            "if(event_id % 5 = 0, NULL, CAST(floor(value * 20) AS INT)) AS latency_ms",
            "canonical = 'crash' AS is_crash",
            "CASE WHEN canonical IN ('payment_submit', 'order_confirmed') THEN "
            + _pick("event_id % 8 div 2", ("card", "upi", "wallet", "cod"))
            + " END AS payment_method")

    @property
    def events(self) -> DataFrame:
        return self.denormalised(self.raw_events)

    @property
    def users(self) -> DataFrame:
        seen = self.table("events").groupBy(F.col("user_id").cast("string").alias("user_id")).agg(
            F.min("ts").alias("acquired_ts"))
        return self.user_rows.join(seen, "user_id", "left")

    @property
    def surface_forms(self) -> DataFrame:
        """Names seen firing, plus silent ones made from document sources.

        Documentation and status follow from the name, so both engines agree on them.
        """
        fired = self.raw_events.select("event_name", "canonical").distinct()
        kebab, evt = F.col("event_name").contains("-"), F.col("event_name").startswith("evt_")
        firing = fired.select(
            F.col("event_name").alias("name"), "canonical", F.lit(True).alias("fires"),
            (~(kebab & F.col("canonical").contains("view"))).alias("documented"),
            F.when(evt, F.lit("deprecated")).otherwise(F.lit("active")).alias("status"),
            F.when(evt | kebab, F.lit(0.25)).otherwise(F.lit(1.0)).alias("weight"))
        silent = self.table("documents").select("source").distinct().select(
            F.concat(F.lit("legacy_"), F.lower("source")).alias("name"),
            F.lit("cart_view").alias("canonical"), F.lit(False).alias("fires"),
            F.lit(True).alias("documented"), F.lit("deprecated").alias("status"),
            F.lit(0.0).alias("weight"))
        return firing.unionByName(silent)


class OrderWarehouse(_Retail):
    """Order lines as events: one session per order, line numbers as the first seven stages."""

    base_date, window_days, changepoint_day = dt.date(1995, 1, 1), 2557, 1200

    @property
    def raw_events(self) -> DataFrame:
        stages = [name for name, _ in FUNNEL[:7]]
        screens = [where for _, where in FUNNEL[:7]]
        stage = _pick("l_linenumber - 1", stages)
        joined = self.table("lineitem").join(
            self.table("orders"), F.col("l_orderkey") == F.col("o_orderkey"))
        return joined.selectExpr(
            "concat('case_', o_custkey % 3) AS instance_id",
            "CAST(o_custkey AS STRING) AS user_id",
            "CAST(l_orderkey AS STRING) AS session_id",
            "o_orderdate + make_dt_interval(0, 0, l_linenumber, 0) AS event_ts",
            f"{stage} AS event_name", f"{stage} AS canonical",
            _pick("l_linenumber - 1", screens) + " AS screen",
            "CAST(floor(l_extendedprice / 20) AS INT) AS latency_ms",
            "l_returnflag = 'R' AND l_linestatus = 'F' AS is_crash",
            _pick("CAST(left(o_orderpriority, 1) AS INT) - 1",
                  ("card", "upi", "wallet", "cod", None)) + " AS payment_method")

    @property
    def events(self) -> DataFrame:
        return self.denormalised(self.raw_events)

    @property
    def users(self) -> DataFrame:
        seen = self.table("orders").groupBy(
            F.col("o_custkey").cast("string").alias("user_id")).agg(
            F.min("o_orderdate").alias("acquired_ts"))
        return self.user_rows.join(seen, "user_id", "left")
