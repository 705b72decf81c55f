import json
import time

import pytest
from pyspark.sql import functions as F

from veilworks.operators import scoring
from veilworks.operators.generate import phone_col
from veilworks.operators.spans import detect
from veilworks.sources import corpora, metrics, reports
from veilworks.streaming import sessions

ENTITY = [("PERSON", 0, 3, "Jan")]


KEY = bytes(range(32))


def gold(spark, *rows):
    return spark.createDataFrame(rows, corpora.GOLD)


def test_gold_round_trip(spark, tmp_path):
    docs = gold(spark, ("a", "synthetic", "najem", "Jan ż", ENTITY), ("b", "real", None, "x", []))
    corpora.write_gold(docs, str(tmp_path / "g"))
    back = corpora.read_gold(spark, str(tmp_path / "g"), str(tmp_path / "missing"))
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, docs.collect()))
    with pytest.raises(ValueError, match="source"):
        corpora.read_gold(spark, str(tmp_path / "g"), source="real")
    (tmp_path / "h").mkdir()
    (tmp_path / "h" / "x.jsonl").write_text('{"doc_id": "a", "source": "real", "text": "t", "entities": []}\n\n{broken\n')
    with pytest.raises(Exception):
        corpora.read_gold(spark, str(tmp_path / "h")).collect()


def test_gold_rules(spark):
    bad = gold(
        spark,
        ("type", "real", "c", "Jan", [("ORG", 0, 3, "Jan")]), ("range", "real", "c", "Jan", [("PERSON", 2, 2, "")]), ("text", "real", "c", "Jan", [("PERSON", 0, 3, "Ewa")]),
        ("over", "real", "c", "Janina", [("PERSON", 0, 4, "Jani"), ("PERSON", 3, 6, "ina")]), ("twice", "real", "c", "", []), ("twice", "real", "c", "", []), ("src", "x", "c", "", []), ("ok", "real", "c", "Janina", [("PERSON", 0, 4, "Jani"), ("LOCATION", 3, 6, "ina")]),
    )
    got = {(r.doc_id, r.violation) for r in corpora.violations(bad).collect()}
    assert got == {("type", "entity type"), ("range", "entity range"), ("text", "entity text"), ("over", "entity overlap"), ("twice", "doc_id occurs again"), ("src", "source")}


def test_corpus_builder(spark, tmp_path):
    (tmp_path / "najem.txt").write_text("Umowa {{PERSON:a}} tel. {{PHONE_NUMBER:t}}, {{PERSON:a}}.", encoding="utf-8")
    (tmp_path / "dzielo.txt").write_text("Brak", encoding="utf-8")
    templates = corpora.read_templates(spark, str(tmp_path / "*.txt"))
    values = lambda n, kind, role: F.when(kind == "PERSON", F.concat(F.lit("Osoba "), n.cast("string"), role)).otherwise(phone_col(n))
    docs = corpora.build_corpus(templates, values, count=6, seed=1)
    rows = docs.orderBy("doc_id").collect()
    assert len(rows) == 6 and {r.doc_id for r in rows} >= {"syn-dzielo-000", "syn-najem-001"}
    assert corpora.violations(docs).count() == 0
    assert rows == corpora.build_corpus(templates, values, count=6, seed=1).orderBy("doc_id").collect()


def test_thresholds(tmp_path):
    table, default = corpora.parse_thresholds("default: 0.5\nthresholds:\n  NIP: 2\n  PESEL: x # bad\n  PERSON: 0.1\n")
    assert (table["NIP"], table["PESEL"], table["PERSON"], default) == (1.0, 0.25, 0.1, 0.5)
    path = tmp_path / "t.yaml"
    live = corpora.ThresholdFile(str(path))
    assert live.current()[1] == 0.3
    path.write_text("default: 0.7\n")
    assert live.current()[1] == 0.7


def test_reports(spark, tmp_path):
    docs = gold(spark, ("a", "real", "c", "Jan", ENTITY), ("b", "synthetic", "c", "Jan", ENTITY))
    leaks = spark.createDataFrame([("a", "PERSON", "Jan", "Jan", 0, 3, "exact"), ("b", "PERSON", "Jan", "Jan", 0, 3, "exact")], "doc_id string, type string, original string, form_found string, start int, end int, match_mode string")
    reports.leaks_csv(leaks, docs, str(tmp_path / "l"))
    back = {r.doc_id: r.original for r in spark.read.csv(str(tmp_path / "l"), header=True).collect()}
    assert back == {"a": "[REDACTED]", "b": "Jan"}
    stats = scoring.latency(spark.createDataFrame([("c", 1.0)], "channel string, ms double"), "channel")
    reports.latency_csv(stats, str(tmp_path / "m"), "channel")
    assert spark.read.csv(str(tmp_path / "m"), header=True).columns == ["channel", "p50", "p90", "p99", "mean", "n"]


@pytest.fixture
def rocks(spark):
    before = spark.conf.get(sessions.PROVIDER)
    spark.conf.set(sessions.PROVIDER, sessions.ROCKSDB)
    yield spark
    spark.conf.set(sessions.PROVIDER, before)


def test_session_stream(spark, tmp_path, rocks):
    schema = "session string, turn int, text string"
    src = tmp_path / "in"
    spark.createDataFrame([("a", 1, "PESEL 44051401359"), ("b", 1, "NIP 1234563218")], schema).coalesce(1).write.parquet(str(src))
    out = str(tmp_path / "out")

    def run():
        """All that is there, with the state that an earlier run left."""
        stream = spark.readStream.schema(schema).parquet(str(src))
        fakes = sessions.pseudonymize_stream(stream, KEY, idle=None).writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "cp"))
        assert fakes.trigger(availableNow=True).start().awaitTermination(120)

    run()
    spark.createDataFrame([("a", 2, "znów 44051401359")], schema).coalesce(1).write.mode("append").parquet(str(src))
    run()
    got = [(r.session, r.fake) for r in spark.read.parquet(out).collect()]
    mine = [f for s, f in got if s == "a"]
    assert len(mine) == 2 and mine[0] == mine[1] and len(got) == 3


def test_deletion_in_the_stream(spark, tmp_path, rocks):
    """What comes after a deletion knows nothing of what came before it; an unknown session may be deleted."""
    schema = "session string, turn int, text string"
    text = "PESEL 44051401359"
    spark.createDataFrame([("a", 1, text), ("a", 2, text + " i NIP 1234563218"), ("a", 4, text)], schema).write.parquet(str(tmp_path / "in"))
    spark.createDataFrame([("a", 2), ("b", 1)], "session string, turn int").write.parquet(str(tmp_path / "gone"))
    found = sessions.passed(detect(spark.readStream.schema(schema).parquet(str(tmp_path / "in"))), KEY)
    gone = sessions.deletions(spark.readStream.schema("session string, turn int").parquet(str(tmp_path / "gone")))
    q = sessions.map_stream(found.unionByName(gone), idle=None).writeStream.format("memory").queryName("deleted").outputMode("append").option("checkpointLocation", str(tmp_path / "cp"))
    q = q.trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    rows = sorted((r.ord >> 20, r.fake) for r in spark.table("deleted").collect())
    assert [t for t, _ in rows] == [1, 2, 2, 4] and rows[0][1] in (rows[1][1], rows[2][1])
    assert [(r.value.people, r.value.messages) for r in sessions.stored(spark, str(tmp_path / "cp")).collect()] == [(0, 1)]


def test_access_log(spark):
    rows = spark.createDataFrame([("s", 200, [1, 2], {"total": 1.5}), (None, 503, None, None)], "session string, status int, entities array<int>, timing_ms map<string,double>")
    got = [json.loads(r.value) for r in reports.access_log(rows.withColumn("text", F.lit("tajne"))).collect()]
    assert (got[0]["entities_detected"], got[0]["timing_ms"], got[0]["status"]) == (2, {"total": 1.5}, 200)
    assert got[1]["entities_detected"] is None and got[1]["session"] is None and "text" not in got[1]


def test_window_stream(spark, tmp_path):
    src = tmp_path / "ev"
    spark.createDataFrame([("2024-01-01 00:00:10", "detect", 5.0), ("2024-01-01 00:00:40", "detect", 7.0), ("2024-01-01 00:01:10", "detect", 9.0)], "t string, channel string, ms double").select(F.to_timestamp("t").alias("ts"), "channel", "ms").write.parquet(str(src))
    stream = spark.readStream.schema("ts timestamp, channel string, ms double").parquet(str(src))
    q = sessions.latency_windows(stream).writeStream.format("memory").queryName("windows").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        q.processAllAvailable()
        got = sorted((r.window.start.minute, r.n, r["mean"]) for r in spark.table("windows").collect())
    finally:
        q.stop()
    assert got == [(0, 2, 6.0), (1, 1, 9.0)]


def test_sessions_end_by_event_time(spark, tmp_path, rocks):
    """A session whose last message lies before the watermark by more than idle is forgotten, one that went on is not."""
    schema, src, out, cp = "session string, turn int, text string, at timestamp", tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "cp")

    def pass_on(*rows):
        spark.createDataFrame(rows, "session string, turn int, text string, at string").withColumn("at", F.to_timestamp("at")).coalesce(1).write.mode("append").parquet(str(src))
        q = sessions.pseudonymize_stream(spark.readStream.schema(schema).parquet(str(src)), KEY, idle=60, at="at", late="1 second")
        assert q.writeStream.format("parquet").option("path", out).option("checkpointLocation", cp).trigger(availableNow=True).start().awaitTermination(120)

    text = "PESEL 44051401359"
    pass_on(("a", 1, text, "2024-01-01 00:00:00"), ("b", 1, text, "2024-01-01 00:00:00"))
    pass_on(("b", 2, text, "2024-01-01 00:00:50"), ("c", 1, "bez danych", "2024-01-01 00:01:30"))
    pass_on(("c", 2, text, "2024-01-01 00:01:31"))
    meta = {r.key.session: r.value for r in sessions.stored(spark, cp).collect()}
    assert set(meta) == {"b", "c"} and meta["b"].messages == 2 and meta["c"].messages == 1  # nothing was stored for c's first
    assert (meta["b"].created_at.second, meta["b"].last_activity.second) == (0, 50)
    assert {r.key.session for r in sessions.stored(spark, cp, "reverse").collect()} == {"b", "c"}


def test_state_holds_no_original_and_costs_by_the_batch(spark, tmp_path, rocks):
    """A restarted stream over a session of many mentions: a batch of one mention reads and writes a few keys."""
    schema, src, cp = "session string, turn int, text string", tmp_path / "in", tmp_path / "cp"
    mails = [f"osoba{i:05d}@poczta.pl" for i in range(3000)]
    spark.createDataFrame([("a", i, " ".join(mails[i * 500 : i * 500 + 500])) for i in range(6)], schema).coalesce(1).write.parquet(str(src))

    def run():
        q = sessions.pseudonymize_stream(spark.readStream.schema(schema).parquet(str(src)), KEY, idle=None).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(cp)).trigger(availableNow=True).start()
        assert q.awaitTermination(300)
        return [o["numRowsUpdated"] for p in q.recentProgress for o in p["stateOperators"]], [o["allUpdatesTimeMs"] for p in q.recentProgress for o in p["stateOperators"]]

    first, _ = run()
    spark.createDataFrame([("a", 9, "znów osoba00007@poczta.pl i nowa@poczta.pl")], schema).coalesce(1).write.mode("append").parquet(str(src))
    second, _ = run()
    assert sum(first) >= 6000 and sum(second) < 20
    got = spark.read.parquet(str(tmp_path / "out"))
    assert got.count() == 3002 and got.select("fake").distinct().count() == 3001
    kept = b"".join(p.read_bytes() for p in cp.rglob("*") if p.is_file())
    assert b"osoba00007" not in kept and b"nowa@poczta" not in kept and len(kept) > 10000
    assert sessions.stored(spark, str(cp), "forward").count() == 3001


def test_lines_of_gold(spark, tmp_path):
    """Lines are counted over parts of a file, blank ones included, and a line that is no document is named."""
    folder = tmp_path / "g"
    folder.mkdir()
    good = lambda i, source="real": json.dumps({"doc_id": f"d{i}", "source": source, "contract_type": "x", "text": "Jan " * 200, "entities": []})
    lines = [good(i) for i in range(200)]
    lines[3], lines[50], lines[120], lines[199] = "", "{no json", good(120, "web"), good(7)
    (folder / "a.jsonl").write_text("\n".join(lines) + "\n")
    (folder / "b.jsonl").write_text(good(900) + "\n\n" + good(901, "web"))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        assert corpora.gold_lines(spark, str(folder)).rdd.getNumPartitions() > 3
        got = {(r.file.rsplit("/", 1)[1], r.line, r.violation) for r in corpora.located(spark, str(folder)).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == {("a.jsonl", 51, "no document"), ("a.jsonl", 121, "source"), ("a.jsonl", 8, "doc_id occurs again"), ("a.jsonl", 200, "doc_id occurs again"), ("b.jsonl", 3, "source")}
    with pytest.raises(ValueError, match=r"b.jsonl:3: d901: source"):
        corpora.read_gold(spark, str(folder / "b.jsonl"))


def test_observed_metrics(spark, tmp_path):
    df = spark.createDataFrame([("a@b.pl c@d.pl",), ("x",), (None,)], "text string")
    rows, seen = metrics.observed(detect(df))
    assert rows.count() == 3 and seen.get == {"rows": 3, "chars": 14, "entities": 2, "rows_with_entities": 1}
    df.write.parquet(str(tmp_path / "in"))
    lines = []
    listener = metrics.Lines(lines.append)
    spark.streams.addListener(listener)
    try:
        stream = metrics.observed_stream(detect(spark.readStream.schema("text string").parquet(str(tmp_path / "in"))))
        assert stream.writeStream.format("noop").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination(120)
        for _ in range(50):
            if lines:
                break
            time.sleep(0.2)
    finally:
        spark.streams.removeListener(listener)
    got = json.loads(lines[0])
    assert (got["rows"], got["entities"], got["batch"]) == (3, 2, 0) and "a@b.pl" not in lines[0]
