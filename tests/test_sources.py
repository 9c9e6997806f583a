"""Scans, sinks and streams on files made here."""

import gzip
import hashlib
import zipfile

import numpy as np
import pytest
from pyspark.errors import SparkRuntimeException
from pyspark.sql import functions as F

from tessera.functions.text import sha
from tessera.sources import scans, sinks
from tessera.streaming import incremental


def test_csv_and_json(spark, tmp_path):
    (tmp_path / "m.csv").write_text('id,title\n1,"a ""b""\nc"\n2,\n')
    assert [tuple(r) for r in scans.csv_manifest(spark, str(tmp_path / "m.csv")).collect()] == [("1", 'a "b"\nc'), ("2", "")]
    (tmp_path / "x.jsonl").write_text('{"id":1,"text":"a"}\n{"id":2,"text":"b"}\n{"id":3,"te')
    assert [r["id"] for r in scans.json_lines(spark, str(tmp_path / "x.jsonl"), "id long, text string").collect()] == [1, 2]
    (tmp_path / "y.jsonl").write_text('{"id":1,"te\n{"id":2,"text":"b"}\n')
    with pytest.raises(SparkRuntimeException):
        scans.json_lines(spark, str(tmp_path / "y.jsonl"), "id long, text string").collect()
    digest = hashlib.sha256(b"a").hexdigest()
    (tmp_path / "z.jsonl").write_text(f'{{"text":"a","sha":"{digest}"}}\n')
    assert scans.hashed_json_lines(spark, str(tmp_path / "z.jsonl"), "text string, sha string", "text", "sha").count() == 1


def test_json_lines_by_ranges(spark, tmp_path):
    line = '{"id":%d,"text":"' + "a" * 90 + '"}\n'
    good = "".join(line % i for i in range(40))
    cases = {"whole": good, "open": good[:-1], "torn": good + '{"id":9,"te', "long": good + '{"id":9,"text":"' + "b" * 600, "blank": "\n" + good + "\n\n {", "empty": "", "alone": "{"}
    cases |= {"mark": "\ufeff" + good + "{"}
    wrong = {"middle": good + "{\n" + good, "fed": good + "{\n", "both": good + "{\n" + good + "{", "earlier": good + "{\n" + good[:-1]}
    for name, text in (cases | wrong).items():
        (tmp_path / f"{name}.jsonl").write_text(text)
    held = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "256")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        for name, text in cases.items():
            df = scans.json_lines(spark, str(tmp_path / f"{name}.jsonl"), "id long, text string")
            assert sorted(r["id"] for r in df.collect()) == (list(range(40)) if len(text) > 1 else []), name
        assert scans.json_lines(spark, str(tmp_path / "whole.jsonl"), "id long, text string").rdd.getNumPartitions() > 8
        for name in wrong:
            with pytest.raises(SparkRuntimeException):
                scans.json_lines(spark, str(tmp_path / f"{name}.jsonl"), "id long, text string").collect()
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)


def test_slices(spark, tmp_path):
    data = "però così".encode()
    (tmp_path / "s.txt").write_bytes(data)
    ok = (str("s.txt"), 0, 5, hashlib.sha256(data[:5]).hexdigest())
    schema = "file string, byte_start long, byte_end long, sha256 string"
    assert scans.byte_slices(spark, str(tmp_path / "s.txt"), spark.createDataFrame([ok], schema)).first()["text"] == "però"
    with pytest.raises(SparkRuntimeException):
        scans.byte_slices(spark, str(tmp_path / "s.txt"), spark.createDataFrame([(*ok[:3], "0")], schema)).collect()


def test_tagged_and_separated(spark, tmp_path):
    text = '<text id="1" url="u">\na\n</text>\nb\n</text>\n<text id="2" url="v">\nc\n</text>\n'
    with gzip.open(tmp_path / "t.gz", "wt") as f:
        f.write(text)
    got = sorted(tuple(r) for r in scans.tagged_documents(spark, str(tmp_path / "t.gz")).collect())
    assert got == [("1", "u", "a\n</text>\nb"), ("2", "v", "c")]
    with pytest.raises(ValueError):
        list(scans.tagged_stream(iter(['<text id="1" url="u">', "a"])))
    (tmp_path / "d").mkdir()
    (tmp_path / "d/a.txt").write_text("one\ntwo\n<|endoftext|>\nthree\n<|endoftext|>\n")
    assert [r["text"] for r in scans.separated_documents(spark, str(tmp_path / "d")).collect()] == ["one\ntwo", "three"]
    assert [r["text"].count("\n") for r in scans.whole_texts(spark, str(tmp_path / "d")).collect()] == [5]
    (tmp_path / "d/b.txt").write_text("torn")
    with pytest.raises(ValueError):
        scans.separated_documents(spark, str(tmp_path / "d"))


def test_wiki_and_sql(spark, tmp_path):
    page = "<page><title>{0}</title><ns>0</ns><id>{1}</id><revision><id>9</id><timestamp>t</timestamp><text>x {0}</text></revision></page>"
    (tmp_path / "w.xml").write_text(f"<mediawiki>{page.format('A', 1)}{page.format('B', 2)}</mediawiki>")
    titles = spark.createDataFrame([("B",)], "title string")
    assert [r["id"] for r in scans.wiki_pages(spark, str(tmp_path / "w.xml"), titles).collect()] == [2]
    (tmp_path / "d.sql").write_text("-- dump\nINSERT INTO `t` VALUES (1,'a\\'b,(c)',NULL),(2,'d''e\\n','x');\nINSERT INTO `u` VALUES (1);\n")
    got = [tuple(r) for r in scans.sql_dump(spark, str(tmp_path / "d.sql"), "t", ["id", "name", "more"]).collect()]
    assert got == [("1", "a'b,(c)", None), ("2", "d'e\n", "x")]


def test_markup():
    html = '<html><head><title>t</title></head><body><nav><a href="/n">n</a></nav><h1>Head</h1><p>one &amp; <b>two</b><br>three</p><div class="ad">ad</div><script>x</script><a href="/u">U</a><a href="/u">V</a></body></html>'
    assert scans.page_text(html) == "Head\none & two\nthree\nU V".replace("U V", "UV")
    links = scans.page_links(html)
    assert [(x["url"], x["label"], x["heading"]) for x in links] == [("/n", "n", ""), ("/u", "U", "Head")]
    tei = '<TEI xmlns="http://www.tei-c.org/ns/1.0"><teiHeader><title>T</title><author>A</author></teiHeader><text><body><head>H</head><l>v one<note>n</note></l><l>v two</l><p>par</p></body></text></TEI>'
    got = scans.tei_views(tei)
    assert got["verse"] == ["v one", "v two"] and got["notes"] == ["n"] and "n" not in got["running"].split() and got["title"] == "T"


def test_archives_and_tokens(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("x.txt", "short")
        z.writestr("y.txt", "longer text")
        z.writestr("c.bin", "no")
    held = scans.archives(spark, str(tmp_path / "a.zip"))
    assert held.count() == 2 and scans.largest_text_member(held).first()["name"] == "y.txt"
    np.array([1, 65_535, 7], "<u2").tofile(tmp_path / "t.bin")
    assert scans.token_file(spark, str(tmp_path / "t.bin")).first()["tokens"] == [1, 65_535, 7]


def test_other_scans(spark, tmp_path):
    (tmp_path / "s.json").write_text('{"response":{"docs":[{"id":"1","title":["a","b"]},{"id":"2"}]}}')
    assert [r["id"] for r in scans.solr_records(spark, str(tmp_path / "s.json")).collect()] == ["1", "2"]
    base = spark.createDataFrame([("a", 1, "old"), ("b", 1, "b")], "k string, o int, v string")
    new = spark.createDataFrame([("a", 2, "new")], "k string, o int, v string")
    assert {r["k"]: r["v"] for r in scans.upsert(base, new, "k", "o").collect()} == {"a": "new", "b": "b"}
    df = spark.createDataFrame([('{"a":["x",{"b":"y"}],"c":1}',), (None,)], "j string")
    assert [r[0] for r in df.select(scans.json_strings(F.col("j"))).collect()] == [["x", "y"], []]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(2, "b|x", "drop"), (1, "a", "drop")], "id int, t string, more string")
    sinks.csv(df, str(tmp_path / "c"), ["id", "t"], "id", one_file=True)
    assert [r["id"] for r in scans.csv_manifest(spark, str(tmp_path / "c")).collect()] == ["1", "2"]
    assert '"a"' in sinks.json_report(df) and "b\\|x" in sinks.markdown_report(df, "T")
    index = sinks.text_shards(df, str(tmp_path / "s"), "id", "t", 10)
    assert spark.read.parquet(str(tmp_path / "s")).count() == 2 and index.count() == 2
    sinks.publish(spark, df, str(tmp_path / "p"), [lambda x: x.count() == 2])
    with pytest.raises(ValueError):
        sinks.publish(spark, df.limit(1), str(tmp_path / "p"), [lambda x: x.count() == 2])
    assert spark.read.parquet(str(tmp_path / "p")).count() == 2
    toks = spark.createDataFrame([("p", 1, [1, 2]), ("p", 2, [3])], "pool string, i int, tokens array<int>")
    sinks.token_table(toks, str(tmp_path / "k"), "pool", "i", "tokens", 2)
    assert {(r["i"], r["first"], r["shard"]) for r in spark.read.parquet(str(tmp_path / "k")).collect()} == {(1, 0, 0), (2, 2, 1)}


def test_streams_resume(spark, tmp_path):
    src = tmp_path / "src"
    spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "id int, text string").coalesce(1).write.parquet(str(src))
    run = lambda: incremental.run_available(incremental.distinct_texts(incremental.files(spark, str(src), "id int, text string"), sha(F.col("text"))), str(tmp_path / "out"), str(tmp_path / "ck"))
    run()
    spark.createDataFrame([(4, "b"), (5, "c")], "id int, text string").coalesce(1).write.mode("append").parquet(str(src))
    run()
    assert sorted(r["text"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["a", "b", "c"]
    incremental.run_batches(incremental.files(spark, str(src), "id int, text string"), str(tmp_path / "ck2"), incremental.overwrite_batch(str(tmp_path / "b")))
    assert spark.read.parquet(str(tmp_path / "b")).count() == 5
    with pytest.raises(ValueError):
        incremental.same_source({"size": 1}, {"size": 2})


def test_event_time(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    events.coalesce(1).write.parquet(str(tmp_path / "e"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "e"))
    q = incremental.windowed_counts(stream, "ts", "event_type", "1 day", "1 hour").writeStream.format("memory").queryName("win").outputMode("complete").option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("win").agg(F.sum("n")).first()[0] == events.count()
    q = incremental.running_totals(stream, "event_type", "value").writeStream.format("memory").queryName("tot").outputMode("update").option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = {r["event_type"]: r["n"] for r in spark.table("tot").groupBy("event_type").agg(F.max("n").alias("n")).collect()}
    assert got == {r["event_type"]: r["count"] for r in events.groupBy("event_type").count().collect()}
