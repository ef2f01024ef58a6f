import json

import pytest
from pyspark.sql import functions as F

from arglake.sources import convert, harvest, readers, sinks
from arglake.streaming import incremental

RECORD = """<record><header{status}><identifier>oai:x/rec/{i}</identifier><datestamp>2020-01-0{i}T00:00:00Z</datestamp></header><metadata><dc><dc:title> T{i} </dc:title><dc:creator>A</dc:creator><dc:creator>B</dc:creator><dc:language>en</dc:language></dc></metadata></record>"""


def test_records(spark, tmp_path):
    (tmp_path / "r.xml").write_text("<repository xmlns:dc='http://x'>" + "".join(RECORD.format(i=i, status=' status="deleted"' if i == 2 else "") for i in (1, 2, 3)) + "</repository>")
    rows = {r.identifier: r for r in readers.records(spark, f"file://{tmp_path}/r.xml").collect()}
    assert set(rows) == {"1", "2", "3"} and rows["1"].title == "T1" and rows["1"].authors == "A;B"
    assert rows["2"].status == "deleted" and rows["3"].subjects is None and rows["1"].languages == ["en"]


def test_json_sources(spark, tmp_path):
    (tmp_path / "t.json").write_text(json.dumps([["Root", 1, "", 0], ["Kid", "2", "1", "1"], ["Odd", 3, "1,x", None], ["short", 4]]))
    got = {r.category_id: (r.name, r.parent_ids, r.primary_parent) for r in readers.taxonomy_json(spark, f"file://{tmp_path}/t.json").collect()}
    assert got == {1: ("Root", [], None), 2: ("Kid", [1], 1), 3: ("Odd", [], None)}
    (tmp_path / "a.json").write_text(json.dumps([{"id": "p", "categories": "16, 10"}, {"id": "q", "categories": "1,z"}, {"id": "r"}]))
    assert {r.paper_id: r.category_ids for r in readers.assignments_json(spark, f"file://{tmp_path}/a.json").collect()} == {"p": [16, 10], "q": [], "r": []}


def test_documents_and_outputs(spark, tmp_path):
    docs, out = tmp_path / "d", tmp_path / "o"
    docs.mkdir()
    out.mkdir()
    for name in ("a.md", "a_cleaned.txt", "b.txt", "b.md", "c.doctags.txt"):
        (docs / name).write_text(name)
    assert {r.identifier: r.text for r in readers.documents(spark, f"file://{docs}").collect()} == {"a": "a_cleaned.txt", "b": "b.md"}
    (out / "1.json").write_text(json.dumps([{"id": "x", "text": "1"}]))
    (out / "2.json").write_text(json.dumps({"outputs": [{"id": "y", "text": "2"}]}))
    (out / "3.json").write_text(json.dumps({"id": "z", "text": "3"}))
    (out / "l.jsonl").write_text('{"id": "x", "text": "1"}\n{"id": "w", "text": "4"}\nnot json\n')
    assert {r.id for r in readers.generations(spark, f"file://{out}").collect()} == {"x", "y", "z"}
    assert sorted(r.id for r in readers.reload_checkpoints(spark, f"file://{out}").collect()) == ["w", "x", "y", "z"]
    assert readers.newest(spark, f"file://{out}", ["*.none", "*.jsonl"]).endswith("l.jsonl")


def test_csv(spark, tmp_path):
    df = spark.createDataFrame([("b", ["x", "y"], None), ("a", [], "t\n\"q\"")], "identifier string, authors array<string>, note string")
    sinks.csv(df, f"file://{tmp_path}/c", order="identifier")
    rows = {r.identifier: (r.authors, r.note) for r in readers.csv_rows(spark, f"file://{tmp_path}/c").collect()}
    assert rows == {"b": ("x;y", ""), "a": ("", 't\n"q"')}
    (tmp_path / "dup.csv").write_text("identifier, v\n1,a\n,b\n1,c\n")
    assert [(r.identifier, r.v) for r in readers.csv_rows(spark, f"file://{tmp_path}/dup.csv").collect()] == [("1", "c")]
    assert sinks.reordered(spark.createDataFrame([(1, 2)], "zz int, title int")).columns == ["title", "zz"]
    assert [r.line for r in sinks.markdown(spark.createDataFrame([(1, None)], "a int, b string")).collect()] == ["| a | b |", "|---|---|", "| 1 |  |"]


def test_harvest(monkeypatch):
    pages = {"": ("<r><record><header><identifier>i1</identifier></header></record><resumptionToken>t2</resumptionToken></r>"), "t2": "<r><record><header><identifier>i2</identifier></header></record></r>"}
    seen = []

    def get(url):
        seen.append(url)
        if len(seen) == 1:
            raise OSError("once")
        return pages["t2" if "resumptionToken=t2" in url else ""].encode()

    monkeypatch.setattr(harvest, "fetch", lambda url, f=harvest.fetch: f(url, get=get, sleep=lambda s: None))
    assert [i for i, _ in harvest._Reader({"url": "http://x"}).read(None)] == ["i1", "i2"]
    s = harvest._Stream({"url": "http://x"})
    rows, end = s.read(s.initialOffset())
    assert [i for i, _ in rows] == ["i1"] and end == {"token": "t2", "page": 1}
    _, last = s.read(end)
    assert s.read(last) [1] == last


def test_jobs_and_streams(spark, tmp_path):
    def factory():
        def f(p):
            if p == "bad":
                raise ValueError("no")
            return None if p == "none" else p.upper()

        return f

    got = {r.id: (r.status, r.output) for r in convert.run_jobs(spark.createDataFrame([(1, "a"), (2, "bad"), (3, "none")], "id long, p string"), "id", "p", factory).collect()}
    assert got == {1: ("success", "A"), 2: ("failed", None), 3: ("empty", None)}
    src = f"file://{tmp_path}/src"
    rows = spark.createDataFrame([(i, f"k{i % 3}", float(i)) for i in range(30)], "id long, kind string, value double")
    rows.repartition(5).write.parquet(src)
    live = incremental.drain(incremental.running_latency(incremental.stream_table(spark, src, 1), "kind"), "live")
    want = rows.groupBy("kind").agg(F.count("value").alias("n"), F.avg("value").alias("mean"), F.max("value").alias("most"))
    assert sorted(map(str, live.collect())) == sorted(map(str, want.collect()))
    for _ in range(2):  # the second run finds nothing new
        incremental.save_each(incremental.stream_table(spark, src), f"file://{tmp_path}/out", f"file://{tmp_path}/cp").awaitTermination()
    assert spark.read.json(f"file://{tmp_path}/out").count() == 30
    up = f"file://{tmp_path}/up"
    incremental.upsert_each(incremental.stream_table(spark, src, 1), up, f"file://{tmp_path}/cp2", "kind", "id").awaitTermination()
    assert sorted((r.kind, r.id) for r in incremental.latest(spark, up).collect()) == [("k0", 27), ("k1", 28), ("k2", 29)]


def test_harvest_windows_in_parallel(spark, tmp_path):
    """Two windows of three and two pages: a task each, a restart in the middle, nothing lost or read twice."""
    import http.server
    import threading
    import urllib.parse

    pages = {"a": [["a1", "a2"], ["a3"], ["a4"]], "b": [["b1"], ["b2", "b3"]]}
    asked = []

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            q = urllib.parse.parse_qs(urllib.parse.urlparse(self.path).query)
            w, n = q["resumptionToken"][0].split(":") if "resumptionToken" in q else ({"2020": "a", "2021": "b"}[q["from"][0]], 0)
            asked.append((w, int(n)))
            token = f"{w}:{int(n) + 1}" if int(n) + 1 < len(pages[w]) else ""
            body = "".join(f"<record><header><identifier>{i}</identifier></header></record>" for i in pages[w][int(n)])
            self.send_response(200)
            self.end_headers()
            self.wfile.write(f"<OAI><ListRecords>{body}<resumptionToken>{token}</resumptionToken></ListRecords></OAI>".encode())

        def log_message(self, *_):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        spark.dataSource.register(harvest.HarvestSource)
        seen, tasks = [], []

        def keep(batch, number):
            rows = batch.withColumn("task", F.spark_partition_id()).collect()
            seen.extend((number, r.identifier) for r in rows)
            tasks.append(len({r.task for r in rows}))
            if number == 1 and not (tmp_path / "failed").exists():
                (tmp_path / "failed").touch()
                raise RuntimeError("lost in the middle")

        def run():
            stream = spark.readStream.format("oai").option("url", f"http://127.0.0.1:{server.server_port}/oai").option("windows", "2020/2020,2021/2021").option("state", f"{tmp_path}/state").load()
            query = stream.writeStream.foreachBatch(keep).option("checkpointLocation", f"file://{tmp_path}/cp").trigger(processingTime="100 milliseconds").start()
            try:
                while not (query.lastProgress and query.lastProgress["numInputRows"] == 0):
                    if query.awaitTermination(0.2):
                        break
            finally:
                query.stop()

        with pytest.raises(Exception, match="lost in the middle"):
            run()
        run()
        run()  # all windows have ended
        last = dict((i, n) for n, i in seen)  # a batch that ran again gives the same rows
        assert sorted(last) == ["a1", "a2", "a3", "a4", "b1", "b2", "b3"]
        assert len({(n, i) for n, i in seen}) == 7 and tasks[0] == 2
        assert sorted(set(asked)) == [("a", 0), ("a", 1), ("a", 2), ("b", 0), ("b", 1)]
    finally:
        server.shutdown()
