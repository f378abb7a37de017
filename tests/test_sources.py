"""Readers on small files with the quirks they must cope with."""

import struct

import pandas as pd
import pytest
from pyspark.sql import functions as F

from flowsieve.plans import fixtures as fx
from flowsieve.sources import capture as ca, tables as tb

ARFF = """% made by hand
@RELATION flows
@attribute duration NUMERIC
@ATTRIBUTE 'flow class' {VPN, plain},
@attribute rate real
@DATA
1.5, VPN, 2
?, plain, oops,
3,VPN
% note
4,"plain",
"""


def write(path, text, encoding="utf-8"):
    path.write_bytes(text.encode(encoding))
    return str(path)


def test_arff_quirks(spark, tmp_path):
    f = write(tmp_path / "a.arff", ARFF + "5,?,7\n")
    df = tb.read_arff(spark, [f])
    assert df.columns == ["duration", "flow class", "rate"]
    rows = sorted(map(tuple, df.collect()), key=str)
    assert rows == sorted([(1.5, "VPN", 2.0), (None, "plain", None), (5.0, None, 7.0)], key=str)


def test_arff_files_with_unlike_headers(spark, tmp_path):
    a = write(tmp_path / "a.arff", "@relation r\n@attribute x numeric\n@data\n1\n2\n")
    b = write(tmp_path / "b.arff", "@relation r\n@attribute y string\n@attribute x numeric\n@data\nu,3\n")
    rows = {(r["x"], r["y"]) for r in tb.read_arff_folders(spark, [str(tmp_path)]).collect()}
    assert rows == {(1.0, None), (2.0, None), (3.0, "u")}
    assert tb.list_files(spark, str(tmp_path), "*.arff") == [f"file:{a}", f"file:{b}"]


def test_csv_label_must_exist(spark, tmp_path):
    f = write(tmp_path / "a.csv", "a, Label\n1,x\n")
    assert tb.read_csv(spark, f, "Label").columns == ["a", "Label"]
    with pytest.raises(ValueError):
        tb.read_csv(spark, f, "attack")


def test_encoding_is_judged_by_all_bytes(spark, tmp_path):
    a = write(tmp_path / "a.csv", "name\nplain\n" * 400 + "grün\n", "latin-1")
    b = write(tmp_path / "b.csv", "name\ngrün\n")
    got = [r["name"] for r in tb.read_any_encoding(spark, [a, b]).where(F.col("name").startswith("gr")).collect()]
    assert got == ["grün", "grün"]


def test_union_of_headers_and_row_limit(spark, tmp_path):
    a = write(tmp_path / "a.csv", " b,a\n1,2\n3,4\n5,6\n")
    b = write(tmp_path / "b.csv", "a,c\n7,8\n")
    df = tb.read_csv_union(spark, [a, b])
    assert df.columns == ["a", "b", "c"] and df.count() == 4
    assert tb.read_csv_union(spark, [a, b], per_file=2).count() == 3


def test_batch_status(spark, tmp_path):
    a = write(tmp_path / "a.csv", "x,y\n1,2\n3,4\n")
    b = write(tmp_path / "b.csv", "x,y\n1,2\nbad,4\n")
    c = write(tmp_path / "c.csv", "x,y\nbad,4\n")
    good, status = tb.read_batch(spark, [a, b, c], "x int, y int")
    assert good.count() == 3
    assert {r["file"][-5:]: r["status"] for r in status.collect()} == {"a.csv": "success", "b.csv": "partial", "c.csv": "error"}


def test_file_kind():
    assert tb.file_kind("/x/A.CSV") == "csv" and tb.file_kind("b.cap") == "pcap"
    with pytest.raises(ValueError):
        tb.file_kind("c.txt")


def test_combine_scenarios(spark, tmp_path):
    for name, rows in (("no-vpn.csv", "x,kind\n1,a\n,a\n1,a\n"), ("vpn.csv", "x,kind\n3,\n")):
        (tmp_path / name[:2]).mkdir(exist_ok=True)
        write(tmp_path / name[:2] / name, rows)
    df = tb.combine_scenarios(spark, {"s1": str(tmp_path / "no"), "s2": str(tmp_path / "vp")}, kind="csv")
    rows = {(r["x"], r["kind"], r["scenario"], r["source_file"], r["label"]) for r in df.collect()}
    assert rows == {("1", "a", "s1", "no-vpn.csv", 0), ("3", "a", "s2", "vpn.csv", 1)}


def test_captures_in_many_pieces(spark, tmp_path):
    packets = pd.DataFrame({
        "t_us": [1_000_000 * i + 250 for i in range(80)], "kind": ["TCP"] * 50 + ["UDP"] * 20 + ["ARP"] * 10, "src": range(80), "dst": [9] * 80,
        "sport": range(2000, 2080), "dport": [443] * 80, "size": [i % 7 for i in range(80)],
    })
    raw = fx.capture_bytes(packets)
    f = tmp_path / "a.pcap"
    f.write_bytes(raw + struct.pack("<IIII", 1, 1, 500, 500) + b"cut")  # a record the capture did not finish
    df = ca.read_captures(spark, [str(f)], with_raw=True, piece=600).orderBy("offset").collect()
    assert len(df) == 80 and len({r["offset"] for r in df}) == 80
    assert [r["protocol"] for r in df] == ["TCP"] * 50 + ["UDP"] * 20 + [None] * 10
    assert df[3]["timestamp"] == pytest.approx(3.00025) and df[3]["src_ip"] == "10.0.0.3" and df[3]["dst_port"] == 443
    assert df[79]["src_port"] is None and df[5]["length"] == len(df[5]["raw"])


def test_captures_in_other_byte_orders(spark, tmp_path):
    frame = fx.frame_bytes("UDP", 1, 2, 53, 5353, 4)
    big = struct.pack(">IHHiIII", 0xA1B23C4D, 2, 4, 0, 0, 65535, 1) + struct.pack(">IIII", 7, 500_000_000, len(frame), 99) + frame
    (tmp_path / "b.pcap").write_bytes(big)
    row = tb.load(spark, str(tmp_path / "b.pcap")).first()
    assert (row["timestamp"], row["length"], row["src_port"], row["protocol"]) == (7.5, 99, 53, "UDP")


def test_packet_vector(spark):
    df = spark.createDataFrame([("f", 0, bytearray(b"\xff\x00\x33")), ("f", 1, bytearray(b"x" * 9)), ("f", 2, None)], "file string, n int, raw binary")
    got = {r["n"]: list(r["vector"]) for r in ca.packet_vectors(df, "file", "n", "raw", 4, 3).collect()}
    assert got[0] == [1.0, 0.0, 0.2, 0.0] and got[1] == [120 / 255] * 4 and got[2] == [0.0] * 4


def test_prediction_store(spark, tmp_path):
    df = spark.createDataFrame([(1, "cnn"), (2, "lstm"), (3, "cnn")], "id int, model_type string")
    path = tb.store_predictions(df, str(tmp_path / "p"))
    got = {r["model_type"]: r["n"] for r in tb.prediction_report(spark, path, "id int, model_type string").collect()}
    assert got == {"cnn": 2, "lstm": 1, "total": 3}


def test_columns_go_by_name_in_a_folder(spark, tmp_path):
    write(tmp_path / "a.csv", "x, y,t\n1,2,u\n")
    write(tmp_path / "b.csv", "\ufeffy,x\n20,10\n")
    write(tmp_path / "c d.csv", '"x","z, w",y\n100,"p,q",200\n')
    write(tmp_path / "e.csv", "")
    df = tb.read_csv(spark, str(tmp_path), with_path="f")
    assert df.columns == ["x", "y", "t", "z, w", "f"]
    assert sorted(tuple(r)[:4] for r in df.collect()) == [("1", "2", "u", None), ("10", "20", None, None), ("100", "200", None, "p,q")]
    typed = tb.read_csv(spark, str(tmp_path), "y", "y int, x long, gone double")
    assert typed.dtypes == [("y", "int"), ("x", "bigint"), ("gone", "double")]
    assert sorted((r["x"], r["y"], r["gone"]) for r in typed.collect()) == [(1, 2, None), (10, 20, None), (100, 200, None)]


def test_folders_of_csv(spark, tmp_path):
    spark.range(5).selectExpr("id", "id % 2 AS part").write.partitionBy("part").option("header", "true").csv(str(tmp_path / "p"))
    df = tb.read_csv(spark, str(tmp_path / "p"))
    assert df.columns == ["id", "part"] and sorted(tuple(r) for r in df.collect()) == [(str(i), i % 2) for i in range(5)]
    (tmp_path / "empty").mkdir()
    write(tmp_path / "empty" / "a.csv", "")
    assert tb.read_csv(spark, str(tmp_path / "empty"), schema="a int").count() == 0
    (tmp_path / "same").mkdir()
    write(tmp_path / "same" / "a.csv", "x,x,,b`.c\n1,2,3,4\n")
    got = tb.read_csv(spark, str(tmp_path / "same"))
    assert got.columns == ["x", "x_1", "_c2", "b`.c"] and tuple(got.first()) == ("1", "2", "3", "4")


def test_packed_csv(spark, tmp_path):
    import gzip

    (tmp_path / "a.csv.gz").write_bytes(gzip.compress(b"b,a\n1,2\n"))
    write(tmp_path / "b.csv", "a,b\n4,3\n")
    assert sorted((r["a"], r["b"]) for r in tb.read_csv(spark, str(tmp_path)).collect()) == [("2", "1"), ("4", "3")]


def test_scenarios_of_unlike_column_order(spark, tmp_path):
    write(tmp_path / "a-vpn.csv", "x,y\n1,2\n")
    write(tmp_path / "b.csv", "y,x\n20,10\n")
    df = tb.combine_scenarios(spark, {"s": str(tmp_path)}, kind="csv")
    assert {(r["x"], r["y"], r["source_file"], r["label"]) for r in df.collect()} == {("1", "2", "a-vpn.csv", 1), ("10", "20", "b.csv", 0)}


def test_rows_per_file_keeps_folders_apart(spark, tmp_path):
    files = []
    for folder, rows in (("a", "1\n2\n"), ("b", "3\n")):
        (tmp_path / folder).mkdir()
        files.append(write(tmp_path / folder / "same.csv", "x\n" + rows))
    got = {(r["path"].split("/")[-2], r["file_name"], r["n_rows"]) for r in tb.rows_per_file(spark, files).collect()}
    assert got == {("a", "same.csv", 2), ("b", "same.csv", 1)}


SPARSE_ARFF = r"""@relation r
@attribute n numeric
@attribute 'the kind' {'a,b', Plain, "it's"}
@attribute t string
@attribute m real
@data
1,'a,b',"x, y",2
{0 5, 3 2}
{1 "it's", 2 'q, {r}'}
{}
{0 1, 0 2}
{9 1}
{x}
3, 'don\'t', ?, '?'
@home,Plain,it's,4
1,2
"""


def test_quoted_and_sparse_arff(spark, tmp_path):
    f = write(tmp_path / "s.arff", SPARSE_ARFF)
    got = sorted(map(tuple, tb.read_arff(spark, [f]).collect()), key=str)
    assert got == sorted([
        (1.0, "a,b", "x, y", 2.0), (5.0, "a,b", None, 2.0), (0.0, "it's", "q, {r}", 0.0), (0.0, "a,b", None, 0.0),
        (3.0, "don't", None, None), (None, "Plain", "it's", 4.0),
    ], key=str)
    row = tb.rejected_rows(spark, [f]).first()
    assert (row["n_rows"], row["n_rejected"]) == (10, 4)


def test_arff_without_a_header_is_an_error(spark, tmp_path):
    f = write(tmp_path / "bare.arff", "1,2\n3,4\n")
    g = write(tmp_path / "good.arff", "@relation r\n@attribute x numeric\n@data\n1\n")
    with pytest.raises(ValueError, match="bare.arff"):
        tb.read_arff(spark, [f, g])


def test_long_cells_do_not_overflow(spark, tmp_path):
    long = "v, " * 60000
    f = write(tmp_path / "l.arff", f"@relation r\n@attribute t string\n@attribute x numeric\n@data\n'{long}',7\n")
    row = tb.read_arff(spark, [f]).first()
    assert len(row["t"]) == len(long) and row["x"] == 7.0
