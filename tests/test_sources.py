"""Readers and writers: round trips on files made here."""

import struct

import pytest

from tallyframe.sources import files as I


def test_manifest_and_ingest(spark, tmp_path):
    root = tmp_path / "img"
    root.mkdir()
    (root / "a.png").write_bytes(b"one")
    (root / "b.png").write_bytes(b"two")
    (tmp_path / "list.txt").write_text("a.png 3\nb.png 4\nbroken line here\nmissing.png 5\n")
    good, bad = I.read_manifest(spark, str(tmp_path / "list.txt"))
    assert good.count() == 3 and [r["line_no"] for r in bad.collect()] == [2]
    made = {r["key"]: (r["label"], bytes(r["content"])) for r in I.ingest_images(spark, good, str(root)).collect()}
    assert made == {"00000000_a.png": (3, b"one"), "00000001_b.png": (4, b"two")}


def test_fixed_records(spark, tmp_path):
    (tmp_path / "batch.bin").write_bytes(b"".join(bytes([i]) + bytes([i * 2] * 6) for i in range(5)) + b"\x01\x02")
    rows = I.read_fixed_records(spark, str(tmp_path / "batch.bin"), 6).collect()
    assert {(r["idx"], r["label"], bytes(r["data"])) for r in rows} == {(i, i, bytes([i * 2] * 6)) for i in range(5)}


def test_idx_pair(spark, tmp_path):
    (tmp_path / "im").write_bytes(struct.pack(">4I", 2051, 3, 2, 2) + bytes(range(12)))
    (tmp_path / "la").write_bytes(struct.pack(">2I", 2049, 3) + bytes([7, 8, 9]))
    rows = I.read_idx(spark, str(tmp_path / "im"), str(tmp_path / "la")).collect()
    assert {(r["idx"], r["label"], bytes(r["data"])) for r in rows} == {(i, 7 + i, bytes(range(4 * i, 4 * i + 4))) for i in range(3)}
    (tmp_path / "bad").write_bytes(struct.pack(">2I", 2050, 3) + bytes(3))
    with pytest.raises(ValueError):
        I.read_idx(spark, str(tmp_path / "im"), str(tmp_path / "bad"))


def test_idx_pairs_of_many_files(spark, tmp_path):
    """Files pair up in order of their paths, sizes may differ, a pair may be empty, and idx runs on."""
    at = 0
    for k, (n, side) in enumerate([(3, 2), (0, 2), (2, 3)]):
        pixels = bytes((at + i) % 251 for i in range(n) for _ in range(side * side))
        (tmp_path / f"im{k}").write_bytes(struct.pack(">4I", 2051, n, side, side) + pixels)
        (tmp_path / f"la{k}").write_bytes(struct.pack(">2I", 2049, n) + bytes(200 + at + i for i in range(n)))
        at += n
    rows = I.read_idx(spark, str(tmp_path / "im*"), str(tmp_path / "la*")).collect()
    want = {(i, 200 + i, side, bytes([i] * side * side)) for i, side in enumerate([2, 2, 2, 3, 3])}
    assert {(r["idx"], r["label"], r["height"], bytes(r["data"])) for r in rows} == want and len(rows) == 5
    (tmp_path / "la3").write_bytes(struct.pack(">2I", 2049, 1) + b"x")
    with pytest.raises(ValueError):  # a label file without images
        I.read_idx(spark, str(tmp_path / "im*"), str(tmp_path / "la*"))


def test_windows(spark, tmp_path):
    (tmp_path / "w.txt").write_text("# 0\n/a.jpg\n3\n10\n20\n2\n1 0.9 0 0 5 5\n2 0.1 1 1 4 4\n# 1\n/b.jpg\n3\n8\n8\n0\n")
    im, win = I.read_windows(spark, str(tmp_path / "w.txt"))
    assert {(r["image_index"], r["path"], r["n"]) for r in im.collect()} == {(0, "/a.jpg", 2), (1, "/b.jpg", 0)}
    assert {(r["image_index"], r["label"], r["overlap"], r["x2"]) for r in win.collect()} == {(0, 1, 0.9, 5), (0, 2, 0.1, 4)}


def test_sidecars_predictions_gt(spark, tmp_path):
    (tmp_path / "s.csv").write_text("Country, Decade\nUS, 1900\n")
    assert I.read_sidecars(spark, str(tmp_path / "s.csv")).first()["fields"] == {"Country": "US", "Decade": "1900"}
    (tmp_path / "p.txt").write_text("a 0.1 0.9\n\nb 0.5 0.5\n")
    assert {r["name"]: r["probs"] for r in I.read_predictions(spark, str(tmp_path / "p.txt")).collect()} == {"a": [0.1, 0.9], "b": [0.5, 0.5]}
    (tmp_path / "g.txt").write_text("a cat dog\nb cat\n")
    assert {tuple(r) for r in I.read_gt(spark, str(tmp_path / "g.txt")).collect()} == {("a", "cat", "dog"), ("b", "cat", None)}


def test_logs(spark, tmp_path):
    (tmp_path / "r1.log").write_text("x\ny\n")
    (tmp_path / "r2.log").write_text("z")
    rows = {(r["run"], r["line_no"], r["value"]) for r in I.read_logs(spark, str(tmp_path / "*.log")).collect()}
    assert {("r1", 0, "x"), ("r1", 1, "y"), ("r2", 0, "z")} <= rows


def test_vector_set(spark, tmp_path):
    df = spark.createDataFrame([(i, [float(i)] * 3, [1.0]) for i in range(10)], "idx int, data array<double>, label array<double>")
    I.write_vector_set(df, str(tmp_path / "v"), ["data", "label"])
    back = I.read_vector_set(spark, str(tmp_path / "v"))
    assert back.count() == 10 and dict(back.dtypes)["data"] == "array<float>"
    with pytest.raises(ValueError):
        I.write_vector_set(df.selectExpr("idx", "data", "if(idx > 5, label, null) label"), str(tmp_path / "w"), ["data", "label"])


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([(i, 1 + i % 2, 1 + i % 3, "p%d" % i) for i in range(30)], "key int, height int, width int, path string")
    I.write_by_size(df, str(tmp_path / "size"))
    assert spark.read.parquet(str(tmp_path / "size")).groupBy("height", "width").count().count() == 6
    I.write_splits(df.selectExpr("path", "key as label", "if(key < 5, 'test', 'train') split"), str(tmp_path / "split"))
    assert spark.read.text(str(tmp_path / "split" / "split=test")).count() == 5
    det = spark.createDataFrame([("f", 1, [0.25, 0.75])], "file string, x1 int, probs array<double>")
    I.write_detections(det, str(tmp_path / "det"), 2)
    assert spark.read.csv(str(tmp_path / "det"), header=True).first()["class1"] == "0.75"
    I.write_log_csv(spark.createDataFrame([("train", 1, 0.5)], "phase string, iteration int, loss double"), str(tmp_path / "csv"), ";")
    assert spark.read.csv(str(tmp_path / "csv"), header=True, sep=";").first()["loss"] == "0.5"
