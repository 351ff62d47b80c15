"""The payments tables, derived from the general test tables (TESTDATA.md).

Order lines play card transactions: a line number repeated within an order is a client retry, the
ship date is the write time, suppliers are merchants and customers are card holders. The `events`
table plays the event stream and the run ledger.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tillwork.functions.scalars import mask_last4
from tillwork.session import small

# Seed rates to CAD (fixed values).
FX = {"CAD": "1.000000", "USD": "1.370000", "GBP": "1.840000", "EUR": "1.490000"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fx_rates(spark: SparkSession) -> DataFrame:
    rows = [(code, rate) for code, rate in FX.items()]
    return spark.createDataFrame(rows, "currency string, rate string").select(
        "currency", F.col("rate").cast("decimal(12,6)").alias("rate_to_cad"))


SUPPLIERS_SENT = 1_000_000
LINE = ("l_orderkey", "l_linenumber")      # what transaction_id is made of
ORDER = LINE[0]


def raw_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keyed_transactions(spark, sf_dir).drop(*LINE)


def order_of(transaction_id: str) -> Column:
    """The order's key in a transaction_id."""
    return F.split_part(transaction_id, F.lit("-"), F.lit(1)).cast("bigint")


def _source_row_id() -> Column:
    return F.concat_ws("-", F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string"))


def _placed_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of known suppliers with their region: two numbers a supplier, and as long as they can be sent
    whole, the lines need not move for them."""
    lines, suppliers, nations = (table(spark, sf_dir, n) for n in ("lineitem", "supplier", "nation"))
    places = small(suppliers.join(nations, suppliers.s_nationkey == nations.n_nationkey).select("s_suppkey", "n_regionkey"), SUPPLIERS_SENT)
    return lines.join(places, F.col("l_suppkey") == F.col("s_suppkey"))


def dealt_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines that transactions are made of, narrow as they are and dealt by order, with the columns by
    which the newest copy is told. An order takes all copies of its transactions with it, so that one can
    be told before the orders join."""
    return (_placed_lines(spark, sf_dir).select(
        *LINE, "l_partkey", "l_suppkey", "l_extendedprice", "l_linestatus", "l_returnflag", "l_discount", "l_tax", "l_shipdate", "n_regionkey")
        .repartition(ORDER).withColumns({"updated_at": F.col("l_shipdate"), "id": _source_row_id()}))


def keyed_transactions(spark: SparkSession, sf_dir: str, holders: bool = True, lines: DataFrame | None = None) -> DataFrame:
    """The raw transactions with the two columns of their id, by the first of which the join has dealt them
    already. Customers join the orders, which are fewer and narrower than the lines; without `holders` they
    are left out, with the columns customer_email and ip_country. `lines` are some of the `dealt_lines`."""
    orders, customers = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    if lines is None:
        lines = _placed_lines(spark, sf_dir)
    online = F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")
    declined = F.col("o_orderstatus") == "P"

    def quoted(value):
        return F.concat(F.lit('"'), value, F.lit('"'))

    def online_only(value):
        return F.when(online, value).otherwise(F.lit("null"))

    raw_payload = F.concat(
        F.lit('{"network":'), F.when(F.col("l_linenumber") % 3 == 0, '"amex"').otherwise('"visa"'),
        F.lit(',"response_code":'), F.when(declined, '"05"').otherwise('"00"'),
        F.lit(',"avs_result":'), online_only(quoted(F.expr("substring('YANZ', cast(l_partkey % 4 as int) + 1, 1)"))),
        F.lit(',"cvv_result":'), online_only(F.when(F.col("l_partkey") % 9 == 0, '"N"').otherwise('"M"')),
        F.lit(',"three_ds":'), online_only(F.when(
            F.col("l_linenumber") % 2 == 0, '{"version":"2.2","authenticated":true}')
            .otherwise('{"version":"2.1","authenticated":false}')),
        F.lit(',"network_risk_score":'), (F.col("l_partkey") % 100).cast("string"),
        F.lit(',"device":'), online_only(F.lit('{"type":"mobile","os":"android"}')), F.lit("}"))
    currency = (F.when(F.col("n_regionkey") == 1, "usd").when(F.col("n_regionkey") == 3, "eur")
                .when(F.col("n_regionkey") == 4, "gbp").otherwise("cad"))
    status = (F.when(declined, "declined").when(F.col("o_orderstatus") == "O", "authorized")
              .when(F.col("l_linestatus") == "F", "settled").otherwise("captured"))
    personal = []
    if holders:
        orders = orders.join(customers.select("c_custkey", "c_name", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"), "left")
        personal = [F.col("c_name").alias("customer_email"),
                    F.when(online, F.concat(F.lit("C"), F.col("c_nationkey").cast("string"))).alias("ip_country")]
    email, country = personal[:1], personal[1:]
    return (
        lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .select(
            *LINE,
            F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"))
            .alias("transaction_id"),
            _source_row_id().alias("id"),
            F.col("l_suppkey").cast("string").alias("merchant_id"),
            F.col("o_custkey").cast("string").alias("customer_id"),
            F.col("o_custkey").cast("string").alias("card_token"),
            *email,
            F.col("l_extendedprice").cast("decimal(18,2)").alias("amount"),
            currency.alias("currency"), status.alias("status"),
            F.when(online, "ecommerce").otherwise("chip").alias("entry_mode"),
            *country,
            raw_payload.alias("raw_payload"),
            F.col("o_orderdate").alias("created_at"), F.col("l_shipdate").alias("updated_at"),
            "l_returnflag", "l_discount", "l_tax"))


def raw_merchants(spark: SparkSession, sf_dir: str) -> DataFrame:
    suppliers, nations = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "nation")
    return (suppliers.join(nations, suppliers.s_nationkey == nations.n_nationkey).select(
        F.col("s_suppkey").cast("string").alias("merchant_id"), F.col("s_name").alias("name"),
        F.concat(F.lit("category-"), (F.col("s_suppkey") % 7).cast("string")).alias("category"),
        F.lpad((F.col("s_suppkey") % 7 + 5000).cast("string"), 4, "0").alias("mcc"),
        F.col("n_name").alias("country"), F.lit("CAD").alias("currency"),
        (F.col("s_suppkey") % 2 == 0).alias("card_present"),
        F.expr("timestamp_ntz'2020-01-01 00:00:00'").alias("created_at"),
        F.expr("timestamp_ntz'2020-01-01 00:00:00'").alias("updated_at")))


def merchant_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every merchant's first version and, for one in three, a later change of category."""
    base = raw_merchants(spark, sf_dir)
    changed = (base.where(F.col("merchant_id").cast("bigint") % 3 == 0)
               .withColumn("category", F.concat("category", F.lit("-new")))
               .withColumn("updated_at", F.expr("timestamp_ntz'2021-06-01 00:00:00'")))
    return base.unionByName(changed)


def raw_refunds(transactions: DataFrame) -> DataFrame:
    return transactions.where("l_returnflag = 'R' and status <> 'declined'").select(
        F.concat(F.lit("re_"), "transaction_id").alias("refund_id"), "transaction_id",
        (F.col("amount") * F.col("l_discount").cast("decimal(12,6)")).cast("decimal(18,2)").alias("amount"),
        F.lit("requested").alias("reason"), F.col("updated_at").alias("created_at"), "updated_at")


def raw_chargebacks(transactions: DataFrame) -> DataFrame:
    tax = F.col("l_tax")
    return transactions.where("l_returnflag = 'A' and status <> 'declined'").select(
        F.concat(F.lit("cb_"), "transaction_id").alias("chargeback_id"), "transaction_id", "amount",
        F.when(tax >= 0.06, "10.4").otherwise("13.1").alias("reason_code"), F.lit("dispute").alias("reason"),
        F.when(tax.isin(0.0, 0.03), "open").when(tax < 0.05, "won").otherwise("lost").alias("status"),
        F.col("updated_at").alias("created_at"), "updated_at")


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").cast("string").alias("customer_id"), F.col("c_name").alias("full_name"),
        F.concat(F.lit(" "), F.col("c_name"), F.lit("@Example.com ")).alias("email"),
        F.concat(F.lit("403-555-"), F.lpad((F.col("c_custkey") % 10000).cast("string"), 4, "0")).alias("phone"),
        F.concat(F.lit("C"), F.col("c_nationkey").cast("string")).alias("country"),
        F.expr("timestamp_ntz'2020-01-01 00:00:00'").alias("created_at"),
        F.expr("timestamp_ntz'2020-01-01 00:00:00'").alias("updated_at"))


def cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").cast("string").alias("card_token"), F.col("c_custkey").cast("string").alias("customer_id"),
        F.lower("c_mktsegment").alias("brand"), F.lpad((F.col("c_custkey") % 1_000_000).cast("string"), 6, "4").alias("bin"),
        mask_last4("c_name").alias("last4"), F.concat(F.lit("C"), F.col("c_nationkey").cast("string")).alias("issuer_country"),
        F.expr("timestamp_ntz'2020-01-01 00:00:00'").alias("created_at"))


def event_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transactions of the event stream: user as card, event type as merchant."""
    k = F.get_json_object("props", "$.k").cast("int")
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("transaction_id"), F.col("user_id").alias("card_token"),
        F.col("event_type").alias("merchant_id"), F.col("value").cast("decimal(18,2)").alias("amount"),
        F.col("ts").alias("created_at"),
        F.when(~F.col("event_type").isin("click", "view"), (k % 5).cast("string")).alias("ip_country"),
        (F.col("event_type") == "error").alias("label"))


# The run ledger: one run per event, of the kind its type gives.

def _ledger_events(spark, sf_dir, *kinds):
    k = F.get_json_object("props", "$.k").cast("bigint")
    finished = F.timestamp_micros(F.unix_micros(F.col("ts").cast("timestamp"))
                                  + F.round(F.col("value") * 6_000_000).cast("bigint")).cast("timestamp_ntz")
    return (table(spark, sf_dir, "events").where(F.col("event_type").isin(*kinds))
            .select("event_id", "event_type", "value", F.col("ts").alias("started_at"),
                    finished.alias("finished_at"), k.alias("k")))


def ingest_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    failed = F.col("k") % 20 == 0
    return _ledger_events(spark, sf_dir, "click").select(
        F.col("event_id").cast("string").alias("run_id"), "started_at", "finished_at",
        F.when(failed, "error").otherwise("success").alias("status"), F.lit(False).alias("full_refresh"),
        F.col("k").alias("records_read"), F.when(failed, F.concat(F.lit("failure "), F.col("k").cast("string"))).alias("error"))


def build_invocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ledger_events(spark, sf_dir, "view").select(
        F.col("event_id").cast("string").alias("invocation_id"), "started_at", "finished_at")


def node_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model builds and tests, each assigned to the invocation that started last before it."""
    from tillwork.operators.ordered import asof_left

    nodes = _ledger_events(spark, sf_dir, "purchase", "signup")
    owned = asof_left(nodes, build_invocations(spark, sf_dir).withColumnRenamed("started_at", "began"),
                      "started_at", "began", ["invocation_id"])
    is_test = F.col("event_type") == "signup"
    names = F.array(*[F.lit(n) for n in ("fct_transactions", "dim_merchants", "merchant_daily", "txn_features")])
    kinds = F.array(*[F.lit(n) for n in ("incremental", "table", "table", "table")])
    slot = (F.col("k") % 4).cast("int")
    good = F.when(is_test, "pass").otherwise("success")
    status = (F.when(F.col("k") % 10 == 0, F.when(is_test, "fail").otherwise("error"))
              .when(F.col("k") % 10 == 1, "skipped").otherwise(good))
    return owned.where("invocation_id is not null").select(
        "invocation_id", F.col("event_id").cast("string").alias("unique_id"),
        F.get(names, slot).alias("name"), F.when(is_test, "test").otherwise("model").alias("resource_type"),
        F.when(is_test, "test").otherwise(F.get(kinds, slot)).alias("materialized"), status.alias("status"),
        "started_at", F.col("finished_at").alias("completed_at"),
        F.col("value").cast("decimal(18,2)").alias("execution_seconds"),
        F.when(F.col("k") % 7 == 0, F.col("k")).alias("rows_affected"), (F.col("k") * 10).alias("relation_rows"),
        F.when(F.col("k") % 5 == 0, F.col("k") * 1_000_000).alias("bytes_billed"),
        F.when(F.col("k") % 10 == 0, F.concat(F.lit("broken "), F.col("k").cast("string"))).alias("message"))
