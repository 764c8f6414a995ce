import json
from datetime import datetime as D

import pandas as pd
from pyspark.sql import functions as F

from kbspark.sources import pages, scan
from kbspark.streaming import flows


def test_scan(spark, tmp_path):
    for p, t in {"src/a.rs": "fn a", "src/b.log": "x", "src/keep.log": "x", ".hidden/x": "x", "target/o.rs": "x", "img.PNG": "x", "sub/out/z.rs": "z", "sub/.gitignore": "out/\n", ".gitignore": "*.log\n!keep.log\n# c\n", "storage/logs/l.txt": "l"}.items():
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_text(t)
    (tmp_path / "bad.txt").write_bytes(b"\xff\xfe\x00")
    files = scan.read_files(scan.list_files(spark, str(tmp_path)), str(tmp_path))
    assert {r.path for r in scan.discover(files).collect()} == {"src/a.rs", "src/keep.log"}
    assert {r.path for r in scan.discover(files, ["src/"], [".hidden"]).collect()} == {".hidden/x"}
    assert scan.read_files(scan.list_files(spark, str(tmp_path)), str(tmp_path), lossy=True).where("path = 'bad.txt'").count() == 1


def test_pages(spark, tmp_path):
    df = spark.createDataFrame([(1, "A b!", D(2024, 1, 2), "x"), (2, "A b!", D(2024, 1, 2), None)], "id long, title string, at timestamp, body string")
    p = pages.page_names(df, "note", "at", "title", "id").withColumn("text", pages.page_text({"id": F.col("id")}, F.coalesce("body", F.lit(""))))
    assert pages.write_pages(p, str(tmp_path / "w")) == 2
    assert sorted(x.name for x in (tmp_path / "w").iterdir()) == ["note-2024-01-02-0001-a-b.md", "note-2024-01-02-0002-a-b.md"]
    assert pages.snapshot(df, str(tmp_path / "s")) == {"rows": 2, "copied": 2, "equal": 1}
    assert json.loads(pages.rendered(df, "jsonl", ["id"]).first().line) == {"id": 1}


def rate(rows, limit, window):
    out, start, n = {}, {}, {}
    for u, t, i in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        if u not in start or (t - start[u]).total_seconds() >= window:
            start[u], n[u] = t, 0
        n[u] += 1
        out[i] = n[u] <= limit
    return out


def test_rate_limit(spark, tmp_path):
    rows = [(u, D(2024, 1, 1, 0, (7 * i + u) % 60, i % 60), 100 * u + i) for u in (1, 2) for i in range(40)]
    df = spark.createDataFrame(rows, "user long, at timestamp, id long")
    want = rate(rows, 3, 300)
    assert {r.id: r.allowed for r in flows.rate_limited(df, 3, 300).collect()} == want
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    q = flows.rate_limit_stream(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), 3, 300).writeStream.format("memory").queryName("rates").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {r.id: r.allowed for r in spark.table("rates").collect()} == want


def test_ingest(spark, tmp_path):
    schema = "project string, path string, content string, received_at timestamp"
    src, out, cp = (str(tmp_path / x) for x in ("src", "out", "cp"))

    def arrive(n, *files):
        pdf = pd.DataFrame([("p", path, text, pd.Timestamp(2024, 1, n)) for path, text in files], columns=["project", "path", "content", "received_at"])
        spark.createDataFrame(pdf, schema).coalesce(1).write.mode("append").parquet(src)
        flows.ingest(spark, src, schema, out, cp, 2, 0).awaitTermination(120)

    arrive(1, ("a", "1\n2\n3"), ("b", "x"))
    arrive(2, ("a", "1\n2\n4"))
    arrive(3, ("a", "1\n2"))
    rows = sorted((r.batch, r.path, r.line_start, r.text, r.retired) for r in spark.read.parquet(out).collect())
    assert rows == [(0, "a", 1, "1\n2", False), (0, "a", 3, "3", False), (0, "b", 1, "x", False), (1, "a", 3, "4", False), (2, "a", 3, None, True)]


def test_sessions(spark):
    df = spark.createDataFrame([(1, D(2024, 1, 1, 0, 0)), (1, D(2024, 1, 1, 0, 0, 59)), (1, D(2024, 1, 1, 0, 5))], "path long, at timestamp")
    assert sorted(r.n for r in flows.sessions(df, "path", "at", "60 seconds").collect()) == [1, 2]
