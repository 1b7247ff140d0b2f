import hashlib
import io
import zipfile

import pytest

from skylode.operators import ledger
from skylode.operators.audits import ContractError
from skylode.sources import readers, writers
from skylode.streaming import live


def test_csv_has_no_byte_order_mark(spark, tmp_path):
    (tmp_path / "m.csv").write_text("﻿image,source,scene_id,cluster_id\n a.jpg ,official,s,c\n", encoding="utf-8")
    df = readers.read_source_manifest(spark, str(tmp_path / "m.csv"))
    assert df.columns[0] == "image" and df.first()["image"] == "a.jpg"
    (tmp_path / "n.csv").write_text("image,source,scene_id,cluster_id\na.jpg,other,s,c\n")
    with pytest.raises(ContractError):
        readers.read_source_manifest(spark, str(tmp_path / "n.csv"))


def test_labels(spark, tmp_path):
    (tmp_path / "a.txt").write_text("24 0.5 0.5 0.1 0.1\n\n3 0.5 0.5\n0 0.2 0.2 0.1 0.1 0.9\n")
    rows = readers.read_labels(spark, str(tmp_path)).orderBy("line_no").collect()
    assert [(r.image, r.line_no, r.fine) for r in rows] == [("a", 1, 24), ("a", 4, 0)]
    with pytest.raises(ContractError):
        readers.read_labels(spark, str(tmp_path), strict=True)


def test_archives(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        for name in ("x/images/train/B.jpg", "x/labels/train/b.txt", "x/labels/train/classes.txt", "x/curation_quarantine/q.jpg", "x/curation_quarantine/q.txt"):
            z.writestr(name, name)
    entries = readers.archive_entries(spark, str(tmp_path / "a.zip"), digest=True)
    images, labels = readers.image_entries(entries), readers.label_entries(entries)
    assert [(r.split, r.key) for r in images.collect()] == [("train", "b.jpg")]
    assert readers.joined_labels(images, labels).first()["label_entry"] == "x/labels/train/b.txt"
    assert tuple(readers.quarantine_counts(entries).first()) == (1, 1, 0)
    assert {r.entry: r.sha256 for r in entries.collect()} == {n: hashlib.sha256(n.encode()).hexdigest() for n in zipfile.ZipFile(tmp_path / "a.zip").namelist()}


def test_the_last_label_in_an_archive_wins(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "b 1.zip", "w") as z:
        for name in ("z/labels/val/a.txt", "a/labels/val/A.txt", "a/labels/val/c.txt"):
            z.writestr(name, "")
    entries = readers.archive_entries(spark, str(tmp_path / "*.zip"))
    assert {r.entry for r in readers.label_entries(entries, last_wins=True).collect()} == {"a/labels/val/A.txt", "a/labels/val/c.txt"}


def test_an_archive_is_read_by_seeks(spark, tmp_path):
    """Its directory costs its end alone, whatever its length."""
    with zipfile.ZipFile(tmp_path / "large.zip", "w", zipfile.ZIP_STORED) as z:
        z.writestr("images/train/a.jpg", bytes(50 << 20))
        z.writestr("images/train/b.jpg", b"b")
    read = spark.sparkContext.accumulator(0)

    class Counted(io.FileIO):
        def readinto(self, into):
            n = super().readinto(into)
            read.add(n)
            return n

    found = readers.archive_entries(spark, str(tmp_path / "large.zip"), opened=lambda p: io.BufferedReader(Counted("/" + p.removeprefix("file:").lstrip("/"))))
    assert [(r.entry, r.size) for r in found.orderBy("position").collect()] == [("images/train/a.jpg", 50 << 20), ("images/train/b.jpg", 1)]
    assert 0 < read.value < 1 << 20


def test_jsonl_and_missing_files(spark, tmp_path):
    writers.write_jsonl(spark.createDataFrame([(1, None)], "a int, b string"), str(tmp_path / "o"))
    assert readers.read_jsonl(spark, str(tmp_path / "o"), "a int, b string").collect() == [(1, None)]
    assert readers.read_jsonl(spark, str(tmp_path / "none"), "a int").count() == 0


def test_outputs_are_written_once(spark, tmp_path):
    path = str(tmp_path / "r.json")
    writers.put_text(spark, path, "{}")
    with pytest.raises(ContractError):
        writers.put_text(spark, path, "{}")
    writers.put_text(spark, path, "new", overwrite=True)
    assert (tmp_path / "r.json").read_text() == "new" and not list(tmp_path.glob("*.tmp"))
    writers.put_csv(spark.createDataFrame([("é,1", 2)], "a string, b int"), str(tmp_path / "r.csv"))
    assert (tmp_path / "r.csv").read_bytes() == "\ufeffa,b\r\n\"é,1\",2\r\n".encode()
    record = writers.envelope({"b": 1, "a": "é"})
    assert writers.verified(record) == {"b": 1, "a": "é"}
    with pytest.raises(ContractError):
        writers.verified(record | {"record": {"b": 2}})
    assert "| - |" in writers.markdown([{"x": None}], ["x"])


def test_a_ledger_is_verified_as_it_grows(spark, tmp_path):
    rows = [("l", i, f"p{i}") for i in range(1, 6)]
    chain = ledger.build_chain(spark.createDataFrame(rows, "ledger string, sequence long, payload string")).cache()
    src = str(tmp_path / "src")
    chain.where("sequence <= 2").coalesce(1).write.parquet(src)
    stream = live.verify_live(spark.readStream.schema(chain.schema).parquet(src))
    q = stream.writeStream.format("memory").queryName("problems").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    chain.where("sequence = 4").coalesce(1).write.mode("append").parquet(src)
    q.processAllAvailable()
    q.stop()
    assert [tuple(r) for r in spark.table("problems").collect()] == [("l", 4, "sequence")]


def test_a_forged_successor_of_a_bad_event_is_found(spark, tmp_path):
    chain = ledger.build_chain(spark.createDataFrame([("l", i, f"p{i}") for i in range(1, 4)], "ledger string, sequence long, payload string"))
    one, two, _ = chain.orderBy("sequence").collect()
    forged = ledger.build_chain(spark.createDataFrame([("l", 1, "p1"), ("l", 2, "x"), ("l", 3, "y")], "ledger string, sequence long, payload string")).orderBy("sequence").collect()
    rows = [one, two.__class__(*[v if n != "payload" else "changed" for n, v in two.asDict().items()]), forged[2]]
    spark.createDataFrame([tuple(r) for r in rows], chain.schema).coalesce(1).write.parquet(str(tmp_path / "src"))
    q = live.verify_live(spark.readStream.schema(chain.schema).parquet(str(tmp_path / "src"))).writeStream.format("memory").queryName("forged").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted(tuple(r) for r in spark.table("forged").collect()) == [("l", 2, "digest"), ("l", 3, "sequence")]


def test_windows_of_events(spark):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    assert live.windowed_metrics(events).groupBy().sum("n").first()[0] == events.count()
    assert live.sessions(events).groupBy().sum("n").first()[0] == events.count()
