"""Packet, flow, prediction and payload views over the given tables, each with its SQL text.

The tables carry no network columns, so the views derive them from the rows:
``events`` become packets (one flow per user), ``lineitem`` rows become flow
records and scored predictions, ``documents`` become payloads.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

FORWARD = ("click", "view", "signup")


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def epoch_seconds(c: str):
    return F.unix_micros(F.col(c).cast("timestamp")).cast("double") / F.lit(1000000.0)


def _pick(number, *values):
    """The value at position ``number`` of a short list."""
    out = None
    for i, v in enumerate(values):
        test = number == i
        out = F.when(test, v) if out is None else out.when(test, v)
    return out


def packets(spark: SparkSession, sf: str) -> DataFrame:
    return packets_of(table(spark, sf, "events")).drop("ts")


def table_stream(spark: SparkSession, sf: str, name: str, files_per_trigger: int | None = None) -> DataFrame:
    """A given table, one file or a folder of part files, as a file stream."""
    stream = spark.readStream.schema(table(spark, sf, name).schema)
    if files_per_trigger:
        stream = stream.option("maxFilesPerTrigger", files_per_trigger)
    return stream.parquet(f"{sf}/{name}.parque[t]")  # a stream takes a single file only by a pattern


def packet_stream(spark: SparkSession, sf: str, files_per_trigger: int = 1) -> DataFrame:
    """The packet view over ``events`` as a file stream, with ``ts`` for watermarks."""
    return packets_of(table_stream(spark, sf, "events", files_per_trigger))


def packets_of(e: DataFrame) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    kind = F.col("event_type")
    protocol = (
        F.when(kind == "click", "TCP").when(kind == "view", "UDP").when(kind == "signup", "TLS")
        .when(kind == "purchase", "HTTPS").otherwise("ICMP")
    )
    return e.withColumn("k", k).select(
        F.col("event_id").alias("pkt_id"),
        F.col("user_id").alias("flow_id"),
        epoch_seconds("ts").alias("t"),
        F.col("value").alias("size"),
        F.when(kind.isin(*FORWARD), "forward").otherwise("backward").alias("direction"),
        protocol.alias("protocol"),
        F.col("k"),
        F.concat(F.lit("10.0.0."), F.col("k")).alias("src_ip"),
        F.concat(F.lit("10.1.0."), F.col("user_id") % 7).alias("dst_ip"),
        F.when(F.col("k") % 3 == 0, 443).otherwise(F.col("k")).alias("dst_port"),
        _pick(F.col("k") % 4, "SYN", "SYN|ACK", "ACK|FIN", "RST").alias("flags"),
        _pick(F.col("k") % 5, "TLSv1.0", "TLSv1.1", "TLSv1.2", "TLSv1.3").alias("tls_version"),
        _pick(F.col("k") % 6, "ClientHello", "ServerHello", "Certificate", "KeyExchange").alias("handshake_type"),
        F.when(F.col("k") % 7 < 3, F.col("k") * 10 + 500).alias("cert_length"),
        _pick(
            F.col("k") % 5, "TLS_ECDHE_RSA_WITH_AES_256_GCM_SHA384", "TLS_RSA_WITH_AES_128_CBC_SHA",
            "TLS_CHACHA20_POLY1305_SHA256", "TLS_RSA_WITH_RC4_128_SHA",
        ).alias("cipher_suite"),
        (kind == "error").cast("int").alias("label"),
        F.col("ts").cast("timestamp").alias("ts"),
    )


PACKETS = """packets AS (
  SELECT event_id AS pkt_id, user_id AS flow_id,
         CAST(epoch_us(ts) AS DOUBLE) / CAST(1000000 AS DOUBLE) AS t, value AS size,
         CASE WHEN event_type IN ('click','view','signup') THEN 'forward' ELSE 'backward' END AS direction,
         CASE event_type WHEN 'click' THEN 'TCP' WHEN 'view' THEN 'UDP' WHEN 'signup' THEN 'TLS'
              WHEN 'purchase' THEN 'HTTPS' ELSE 'ICMP' END AS protocol,
         k, '10.0.0.' || k AS src_ip, '10.1.0.' || (user_id % 7) AS dst_ip,
         CASE WHEN k % 3 = 0 THEN 443 ELSE k END AS dst_port,
         CASE k % 4 WHEN 0 THEN 'SYN' WHEN 1 THEN 'SYN|ACK' WHEN 2 THEN 'ACK|FIN' WHEN 3 THEN 'RST' END AS flags,
         CASE k % 5 WHEN 0 THEN 'TLSv1.0' WHEN 1 THEN 'TLSv1.1' WHEN 2 THEN 'TLSv1.2' WHEN 3 THEN 'TLSv1.3' END AS tls_version,
         CASE k % 6 WHEN 0 THEN 'ClientHello' WHEN 1 THEN 'ServerHello' WHEN 2 THEN 'Certificate' WHEN 3 THEN 'KeyExchange' END AS handshake_type,
         CASE WHEN k % 7 < 3 THEN k * 10 + 500 END AS cert_length,
         CASE k % 5 WHEN 0 THEN 'TLS_ECDHE_RSA_WITH_AES_256_GCM_SHA384' WHEN 1 THEN 'TLS_RSA_WITH_AES_128_CBC_SHA'
              WHEN 2 THEN 'TLS_CHACHA20_POLY1305_SHA256' WHEN 3 THEN 'TLS_RSA_WITH_RC4_128_SHA' END AS cipher_suite,
         CAST(event_type = 'error' AS INTEGER) AS label
  FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events))"""

# packets with the time since the packet before it in the flow
IAT = (
    PACKETS
    + """,
iat AS (SELECT *, t - lag(t) OVER (PARTITION BY flow_id ORDER BY t, pkt_id) AS iat,
               row_number() OVER (PARTITION BY flow_id ORDER BY t, pkt_id) AS rn FROM packets)"""
)


def short_packets(spark: SparkSession, sf: str) -> DataFrame:
    """Many short flows: one per order, a packet per line."""
    li = table(spark, sf, "lineitem")
    return li.select(
        F.col("l_orderkey").alias("flow_id"),
        epoch_seconds("l_shipdate").alias("t"),
        (F.col("l_partkey") * 100000000 + F.col("l_linenumber") * 10000000 + F.col("l_suppkey")).alias("pkt_id"),
        F.col("l_extendedprice").alias("size"),
        F.concat_ws("|", "l_returnflag", "l_linestatus").alias("flags"),
    )


SHORT = """short AS (
  SELECT l_orderkey AS flow_id, CAST(epoch_us(l_shipdate) AS DOUBLE) / CAST(1000000 AS DOUBLE) AS t,
         l_partkey * 100000000 + l_linenumber * 10000000 + l_suppkey AS pkt_id,
         l_extendedprice AS size, l_returnflag || '|' || l_linestatus AS flags FROM lineitem)"""

FLOW_NUMERIC = ["quantity", "price", "discount", "tax"]


def flow_table(spark: SparkSession, sf: str) -> DataFrame:
    """Flow records: four numeric features, a class, a scenario and a unique id."""
    li = table(spark, sf, "lineitem")
    return li.select(
        F.concat_ws(
            "-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.unix_date(F.to_date("l_shipdate")),
            F.round(F.col("l_extendedprice") * 100).cast("long"),
        ).alias("row_id"),
        F.col("l_quantity").alias("quantity"),
        F.col("l_extendedprice").alias("price"),
        F.col("l_discount").alias("discount"),
        F.col("l_tax").alias("tax"),
        F.col("l_linenumber").alias("line"),
        F.col("l_returnflag").alias("label"),
        F.col("l_linestatus").alias("scenario"),
        (F.col("l_returnflag") == "R").cast("int").alias("attack"),
    )


FLOWS = """flows AS (
  SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, epoch_us(l_shipdate) // 86400000000,
                   CAST(round(l_extendedprice * CAST(100 AS DOUBLE)) AS BIGINT)) AS row_id, l_quantity AS quantity,
         l_extendedprice AS price, l_discount AS discount, l_tax AS tax, l_linenumber AS line,
         l_returnflag AS label, l_linestatus AS scenario, CAST(l_returnflag = 'R' AS INTEGER) AS attack
  FROM lineitem)"""


def dirty_flows(spark: SparkSession, sf: str) -> DataFrame:
    """Flow records with missing and infinite values in fixed places."""
    f = flow_table(spark, sf)
    return f.select(
        "row_id", "label", "scenario",
        F.when(F.col("line") == 3, None).otherwise(F.col("quantity")).alias("quantity"),
        F.when(F.col("line") == 2, float("inf")).when(F.col("line") == 5, float("nan"))
        .otherwise(F.col("price")).alias("price"),
        F.when((F.col("line") == 3) | (F.col("line") == 4), None).otherwise(F.col("tax")).alias("tax"),
        F.when(F.col("line") == 6, None).otherwise(F.col("label")).alias("kind"),
    )


DIRTY = (
    FLOWS
    + """,
dirty AS (SELECT row_id, label, scenario, CASE WHEN line = 3 THEN NULL ELSE quantity END AS quantity,
          CASE WHEN line = 2 THEN CAST('inf' AS DOUBLE) WHEN line = 5 THEN CAST('nan' AS DOUBLE) ELSE price END AS price,
          CASE WHEN line IN (3, 4) THEN NULL ELSE tax END AS tax,
          CASE WHEN line = 6 THEN NULL ELSE label END AS kind FROM flows),
blank AS (SELECT row_id, label, scenario, quantity, CASE WHEN isnan(price) OR isinf(price) THEN NULL ELSE price END AS price,
          tax, kind FROM dirty)"""
)


def predictions(spark: SparkSession, sf: str) -> DataFrame:
    """Scored rows of two binary models."""
    f = flow_table(spark, sf)
    p = F.col("discount") * 10
    p2 = F.col("tax") * 12.5
    return f.select(
        "row_id", F.col("attack").alias("y"), F.least(p, F.lit(1.0)).alias("p"), F.least(p2, F.lit(1.0)).alias("p2"),
        "label", "scenario",
        (p >= 0.5).cast("int").alias("pred"), (p2 >= 0.5).cast("int").alias("pred2"), "quantity",
    )


PRED = (
    FLOWS
    + """,
pred AS (SELECT row_id, attack AS y, least(discount * CAST(10 AS DOUBLE), CAST(1 AS DOUBLE)) AS p,
         least(tax * CAST(12.5 AS DOUBLE), CAST(1 AS DOUBLE)) AS p2, label, scenario,
         CAST(discount * CAST(10 AS DOUBLE) >= 0.5 AS INTEGER) AS pred,
         CAST(tax * CAST(12.5 AS DOUBLE) >= 0.5 AS INTEGER) AS pred2, quantity FROM flows)"""
)


def class_predictions(spark: SparkSession, sf: str) -> DataFrame:
    """Scored rows of a three-class model: true class 0..2, predicted class, probabilities."""
    f = flow_table(spark, sf)
    true = F.when(F.col("label") == "A", 0).when(F.col("label") == "N", 1).otherwise(2)
    a = F.col("discount") * 5
    b = (F.lit(1.0) - a) * (F.col("quantity") / 100.0)
    c = F.lit(1.0) - a - b
    pred = F.when((a >= b) & (a >= c), 0).when(b >= c, 1).otherwise(2)
    return f.select("row_id", "scenario", true.alias("y"), pred.alias("pred"), F.array(a, b, c).alias("proba"))


CLASS_PRED = (
    FLOWS
    + """,
cls0 AS (SELECT row_id, scenario, CASE label WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS y,
         discount * CAST(5 AS DOUBLE) AS a, quantity / CAST(100 AS DOUBLE) AS w FROM flows),
cls1 AS (SELECT *, (CAST(1 AS DOUBLE) - a) * w AS b FROM cls0),
cls2 AS (SELECT *, CAST(1 AS DOUBLE) - a - b AS c FROM cls1),
cls AS (SELECT row_id, scenario, y, CASE WHEN a >= b AND a >= c THEN 0 WHEN b >= c THEN 1 ELSE 2 END AS pred, a, b, c FROM cls2)"""
)


def edges(spark: SparkSession, sf: str) -> DataFrame:
    """Who talks to whom: customer to supplier, grouped by order priority."""
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_suppkey", "l_linenumber")
    return o.join(li, o.o_orderkey == li.l_orderkey).select(
        F.col("o_orderpriority").alias("flow_id"),
        F.concat(F.lit("c"), "o_custkey").alias("src_ip"),
        F.concat(F.lit("s"), "l_suppkey").alias("dst_ip"),
        F.col("l_linenumber").alias("dst_port"),
    )


EDGES = """edges AS (
  SELECT o_orderpriority AS flow_id, 'c' || o_custkey AS src_ip, 's' || l_suppkey AS dst_ip, l_linenumber AS dst_port
  FROM orders JOIN lineitem ON o_orderkey = l_orderkey)"""


def payloads(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select(
        F.col("doc_id").alias("payload_id"), F.col("source").alias("flow_id"), F.encode("text", "UTF-8").alias("payload")
    )


PAYLOADS = """payloads AS (SELECT doc_id AS payload_id, source AS flow_id, encode(text) AS payload FROM documents)"""


def tls_lines(spark: SparkSession, sf: str) -> DataFrame:
    """TLS flow records in long form: one row per packet with the suite, certificate
    and extension it offers. The long form keeps a flow of any size spread over tasks."""
    li = table(spark, sf, "lineitem")
    return li.select(
        F.col("l_orderkey").alias("flow_id"),
        F.concat_ws("_", F.lit("TLS"), "l_returnflag", (F.col("l_suppkey") % 3).cast("string")).alias("suite"),
        F.col("l_quantity").cast("int").alias("cert_size"),
        F.concat(F.lit("CA "), F.col("l_returnflag")).alias("issuer"),
        (F.col("l_partkey") % 365).cast("int").alias("validity_days"),
        F.col("l_linenumber").cast("string").alias("ext"),
        epoch_seconds("l_shipdate").alias("ts"),
        (F.col("l_partkey") * 100000000 + F.col("l_linenumber") * 10000000 + F.col("l_suppkey")).alias("pkt_id"),
        F.when(F.col("l_linestatus") == "O", "client_to_server").otherwise("server_to_client").alias("direction"),
        F.col("l_extendedprice").alias("size"),
    )


TLS_LINES = """tls AS (
  SELECT l_orderkey AS flow_id, 'TLS_' || l_returnflag || '_' || CAST(l_suppkey % 3 AS VARCHAR) AS suite,
         CAST(l_quantity AS INTEGER) AS cert_size, 'CA ' || l_returnflag AS issuer,
         CAST(l_partkey % 365 AS INTEGER) AS validity_days, CAST(l_linenumber AS VARCHAR) AS ext,
         CAST(epoch_us(l_shipdate) AS DOUBLE) / CAST(1000000 AS DOUBLE) AS ts,
         l_partkey * 100000000 + l_linenumber * 10000000 + l_suppkey AS pkt_id,
         CASE WHEN l_linestatus = 'O' THEN 'client_to_server' ELSE 'server_to_client' END AS direction,
         l_extendedprice AS size FROM lineitem)"""
