"""Queries for sources and sinks (A). Files are written by Spark from the given tables and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowsieve.functions.columns import stable
from flowsieve.operators.alerts import risk_level
from flowsieve.plans import fixtures as fx, views as v
from flowsieve.plans.flow_queries import settle
from flowsieve.plans.registry import query, st, sts
from flowsieve.session import scratch_path
from flowsieve.sources import capture as ca, tables as tb


def _csv(spark, df, label, **options):
    path = scratch_path(spark, label)
    writer = df.write.option("header", "true")
    for k, x in options.items():
        writer = writer.option(k, x)
    writer.csv(path)
    return path


@query("A01_csv_scan", "SELECT CAST(p_partkey AS BIGINT) AS p_partkey, p_name, p_retailprice, p_brand AS label FROM part")
def a01(spark, sf):
    part = v.table(spark, sf, "part").select("p_partkey", "p_name", "p_retailprice", F.col("p_brand").alias("label"))
    path = _csv(spark, part, "csv-scan")
    return tb.read_csv(spark, path, "label", "p_partkey long, p_name string, p_retailprice double, label string")


@query("A02_large_csv_scan", f"WITH {v.FLOWS} SELECT scenario, label, count(*) AS n, {sts('sum(price) AS price', 'avg(quantity) AS quantity')} FROM flows GROUP BY 1, 2")
def a02(spark, sf):
    path = _csv(spark, v.flow_table(spark, sf), "large-csv")
    df = tb.read_csv(spark, path, "label", "row_id string, quantity double, price double, discount double, tax double, line int, label string, scenario string, attack int")
    return settle(df.groupBy("scenario", "label").agg(F.count(F.lit(1)).alias("n"), F.sum("price").alias("price"), F.avg("quantity").alias("quantity")))


@query("A03_text_scan_latin1", "SELECT CAST(p_partkey AS VARCHAR) AS id, 'café ' || p_name AS name FROM part")
def a03(spark, sf):
    df = v.table(spark, sf, "part").select(F.col("p_partkey").alias(" id"), F.concat(F.lit("café "), "p_name").alias("name"))
    return tb.read_text_table(spark, _csv(spark, df, "latin1", encoding="ISO-8859-1"))


@query("A04_encoding_fallback", "SELECT CAST(p_partkey AS VARCHAR) AS id, 'maße ' || p_name AS name FROM part UNION ALL SELECT CAST(s_suppkey AS VARCHAR), 'grüße ' || s_name FROM supplier")
def a04(spark, sf):
    a = v.table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.concat(F.lit("maße "), "p_name").alias("name"))
    b = v.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.concat(F.lit("grüße "), "s_name").alias("name"))
    paths = [_csv(spark, a, "utf8"), _csv(spark, b, "latin1", encoding="ISO-8859-1")]
    return tb.read_any_encoding(spark, tb.list_files(spark, paths, "*.csv"))


def _arff_rows(spark, sf):
    f = v.flow_table(spark, sf)
    return f.withColumns({"quantity": F.when(F.col("line") == 3, None).otherwise(F.col("quantity")), "tax": F.when(F.col("line") == 4, None).otherwise(F.col("tax"))})


_ARFF = "arff AS (SELECT CASE WHEN line = 3 THEN NULL ELSE quantity END AS quantity, price, CASE WHEN line = 4 THEN NULL ELSE tax END AS tax, row_id, label AS class1, scenario FROM flows)"


@query("A05_arff_scan", f"WITH {v.FLOWS}, {_ARFF} SELECT quantity, price, tax, row_id, class1 FROM arff")
def a05(spark, sf):
    folder = fx.write_arff(_arff_rows(spark, sf), scratch_path(spark, "arff"))
    return tb.read_arff(spark, tb.list_files(spark, folder, "part-*"))


@query("A06_arff_folders", f"WITH {v.FLOWS}, {_ARFF} SELECT quantity, price, tax, row_id, class1 FROM arff")
def a06(spark, sf):
    rows = _arff_rows(spark, sf)
    folders = [fx.write_arff(rows.where(F.col("scenario") == s), scratch_path(spark, f"arff-{s}")) for s in ("F", "O")]
    return tb.read_arff(spark, tb.list_files(spark, folders, "part-*"))


@query("A11_combine_scenarios", f"""WITH {v.FLOWS}, {_ARFF}, m AS (SELECT quantile_cont(quantity, 0.5) AS q, quantile_cont(tax, 0.5) AS t FROM arff)
SELECT {sts('coalesce(quantity, q) AS quantity', 'price AS price', 'coalesce(tax, t) AS tax')}, row_id, class1, scenario, CAST(scenario = 'O' AS BIGINT) AS label FROM arff, m""")
def a11(spark, sf):
    rows = _arff_rows(spark, sf)
    base = scratch_path(spark, "scenarios")
    folders = {"F": f"{base}/a1-no-vpn", "O": f"{base}/a2-vpn"}
    for s, folder in folders.items():
        fx.write_arff(rows.where(F.col("scenario") == s), folder)
    # the text sink cannot name its parts *.arff, so the reader is given the files
    files = {s: tb.list_files(spark, folder, "part-*") for s, folder in folders.items()}
    return settle(tb.combine_scenarios(spark, files, label_from="path").drop("source_file"))


@query("A07_capture_scan", f"""WITH {v.PACKETS} SELECT {st('t')} AS timestamp, CASE protocol WHEN 'TCP' THEN '10.0.0.' || k WHEN 'UDP' THEN '10.0.0.' || k END AS src_ip,
 CASE WHEN protocol IN ('TCP','UDP') THEN '10.1.0.' || (flow_id % 7) END AS dst_ip, CASE WHEN protocol IN ('TCP','UDP') THEN CAST(pkt_id % 60000 + 1024 AS BIGINT) END AS src_port,
 CASE WHEN protocol IN ('TCP','UDP') THEN CAST(dst_port AS BIGINT) END AS dst_port, CASE WHEN protocol IN ('TCP','UDP') THEN protocol END AS protocol,
 CAST(CASE protocol WHEN 'TCP' THEN 54 + k % 20 WHEN 'UDP' THEN 42 + k % 20 ELSE 42 END AS BIGINT) AS length FROM packets""")
def a07(spark, sf):
    p = v.packets(spark, sf).withColumn("t_us", F.round(F.col("t") * 1000000).cast("long"))
    files = fx.capture_files(spark, p)
    return settle(ca.read_captures(spark, files, piece=20000).drop("path", "offset", "raw"))


@query("A08_packet_vectors", f"""WITH {v.PAYLOADS}, r AS (SELECT payload_id, hex(payload) AS h FROM payloads),
x AS (SELECT payload_id, list_transform(range(0, least(length(h) // 2, 1500)), lambda i: CAST('0x' || substr(h, i * 2 + 1, 2) AS INTEGER) / CAST(255 AS DOUBLE)) AS v FROM r)
SELECT payload_id, CAST(1500 AS BIGINT) AS length, {sts('list_sum(v) AS total', 'list_sum(list_transform(v, lambda e, i: e * i)) AS weighted')} FROM x""")
def a08(spark, sf):
    vec = v.payloads(spark, sf).select("payload_id", ca.packet_vector("payload").alias("v"))
    total = F.aggregate("v", F.lit(0.0), lambda a, x: a + x)
    weighted = F.aggregate(F.transform("v", lambda x, i: x * (i + 1)), F.lit(0.0), lambda a, x: a + x)
    return settle(vec.select("payload_id", F.size("v").alias("length"), total.alias("total"), weighted.alias("weighted")))


@query("A10_csv_union", """SELECT CAST(c_acctbal AS VARCHAR) AS balance, CAST(c_custkey AS VARCHAR) AS key, c_mktsegment AS segment FROM customer
 UNION ALL SELECT CAST(s_acctbal AS VARCHAR), CAST(s_suppkey AS VARCHAR), NULL FROM supplier""")
def a10(spark, sf):
    c = v.table(spark, sf, "customer").select(F.col("c_custkey").alias("key "), F.col("c_mktsegment").alias(" segment"), F.col("c_acctbal").alias("balance"))
    s = v.table(spark, sf, "supplier").select(F.col("s_acctbal").alias("balance"), F.col("s_suppkey").alias("key"))
    folders = [_csv(spark, c, "union-a"), _csv(spark, s, "union-b")]
    out = scratch_path(spark, "combined")
    return tb.combine_csv(spark, folders, out)


@query("A13_rows_per_file", "SELECT l_linestatus AS status, count(*) AS n_rows FROM lineitem GROUP BY 1")
def a13(spark, sf):
    path = scratch_path(spark, "per-file")
    v.flow_table(spark, sf).write.partitionBy("scenario").option("header", "true").csv(path)
    files = tb.list_files(spark, path, "*.csv")
    per = tb.rows_per_file(spark, files).groupBy(F.regexp_extract("path", "scenario=([^/]+)/", 1).alias("status"))
    return per.agg(F.sum("n_rows").alias("n_rows"))


@query("A14_batch_status", """SELECT s AS scenario, count(*) AS n_rows, count(*) FILTER (bad) AS n_bad, CASE WHEN count(*) FILTER (bad) = 0 THEN 'success' WHEN count(*) FILTER (NOT bad) > 0 THEN 'partial' ELSE 'error' END AS status
FROM (SELECT l_linestatus AS s, l_linestatus = 'O' AND l_linenumber = 1 AS bad FROM lineitem) GROUP BY 1""")
def a14(spark, sf):
    f = v.flow_table(spark, sf)
    q = F.when((F.col("scenario") == "O") & (F.col("line") == 1), F.lit("many")).otherwise(F.col("quantity").cast("string"))
    path = scratch_path(spark, "batch")
    f.select("row_id", q.alias("quantity"), "scenario").write.partitionBy("scenario").option("header", "true").csv(path)
    _, status = tb.read_batch(spark, tb.list_files(spark, path, "*.csv"), "row_id string, quantity double")
    per = status.groupBy(F.regexp_extract("file", "scenario=([^/]+)/", 1).alias("scenario")).agg(F.sum("n_rows").alias("n_rows"), F.sum("n_bad").alias("n_bad"))
    return per.withColumn("status", F.when(F.col("n_bad") == 0, "success").when(F.col("n_bad") < F.col("n_rows"), "partial").otherwise("error"))


@query("A15_reader_by_extension", "SELECT CAST(p_partkey AS VARCHAR) AS id, p_name AS name FROM part")
def a15(spark, sf):
    path = _csv(spark, v.table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name")), "by-extension")
    parts = [tb.load(spark, f) for f in tb.list_files(spark, path, "*.csv")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query("A16_sinks_round_trip", "SELECT kind, CAST(c_custkey AS BIGINT) AS id, c_acctbal AS balance FROM customer, (VALUES ('csv'), ('json'), ('parquet')) v(kind)")
def a16(spark, sf):
    c = v.table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("balance"))
    schema = "id long, balance double"
    parts = []
    for kind in ("csv", "json", "parquet"):
        path = tb.write_table(c, scratch_path(spark, f"sink-{kind}"), kind)
        reader = spark.read.schema(schema).option("header", "true")
        parts.append(reader.format(kind).load(path).select(F.lit(kind).alias("kind"), "id", "balance"))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("A17_prediction_store", "SELECT event_type AS model_type, count(*) AS n FROM events GROUP BY 1 UNION ALL SELECT 'total', count(*) FROM events")
def a17(spark, sf):
    e = v.table(spark, sf, "events").select("event_id", F.col("value").alias("score"), F.col("event_type").alias("model_type"))
    path = tb.store_predictions(e, scratch_path(spark, "predictions"))
    return tb.prediction_report(spark, path, "event_id long, score double, model_type string")
