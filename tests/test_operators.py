"""Operators on small inputs: readers, artifacts, state, time zones, text of other scripts."""

from __future__ import annotations

import hashlib
import random
import hmac
import io
import json
import tarfile
import zipfile
from datetime import datetime
from zoneinfo import ZoneInfo

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import dates, hashing, text
from corpusloom.operators import joins, leakage, projections, quality, ranking
from corpusloom.plans import artifacts
from corpusloom.sources import files, generated
from corpusloom.streaming import sessions


def one(spark, values, *columns):
    return [r[0] if len(r) == 1 else tuple(r) for r in spark.createDataFrame([(v,) for v in values], "v string").select(*columns).collect()]


def test_korean_text(spark):
    v = F.col("v")
    assert one(spark, ["가나다", "강", "abc", None], text.has_final_consonant("v")) == [False, True, None, None]
    assert one(spark, ["해달은 좋다"], text.repair_particle("v", "해달", "은", "는")) == ["해달은 좋다"]
    assert one(spark, ["나무은 좋다"], text.repair_particle("v", "나무", "은", "는")) == ["나무는 좋다"]
    assert one(spark, ["각", "ﬁn", None], text.nfc(v)) == ["각", "ﬁn", None]
    assert one(spark, ["ＡＢ ﬁ", "Straße"], text.answer_key(v)) == ["abfi", "strasse"]
    assert one(spark, ["년주: 甲子, 월주: 乙丑"], text.labelled_values("v", ["년주", "월주"])) == [{"년주": "甲子", "월주": "乙丑"}]
    assert one(spark, ["1999년 3월 4일 또는 2001-2-30, 2001.02.03"], text.iso_dates("v")) == [["1999-03-04", "2001-02-03"]]
    assert one(spark, ["漢字 甲"], quality.foreign_characters("v", "㐀-鿿", ["甲"])) == [["字", "漢"]]
    assert one(spark, ["a\x00  b\r\n\n c "], text.normalize_lines("v")) == ["a b\nc"]


def test_canonical_json(spark):
    bad = ['{"a":1,"a":2}', "{", None, '{"a":NaN}']
    assert one(spark, bad, hashing.canonical_json(F.col("v"))) == [None] * 4
    assert one(spark, ['{"b":[1, {"d":"é","c":null}], "a":1}'], hashing.canonical_json(F.col("v"))) == ['{"a":1,"b":[1,{"c":null,"d":"é"}]}']
    key = b"k"
    assert one(spark, ["x", None], hashing.signed_id("doc", F.col("v"), key)) == ["doc_" + hmac.new(key, b"doc\0x", hashlib.sha256).hexdigest(), None]
    assert one(spark, ['see {x} {"n":{"k":1}} and {"k": [2]}'], hashing.embedded_objects(F.col("v"), "k")) == [['{"k":1}', '{"k": [2]}']]


def test_archives(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("x/good.json", json.dumps([{"k": 1}, {"k": 2}]))
        z.writestr("x/bad.json", b"\xff\xfe")
        z.writestr("../evil.json", "[]")
    (tmp_path / "b.zip").write_bytes(b"no archive")
    path = f"file://{tmp_path}/*.zip"
    assert sorted(r.k for r in files.read_zip_json(spark, path, "k:int").collect()) == [1, 2]
    rows = files.zip_members(spark.read.format("binaryFile").load(path)).collect()
    assert {r.member: r.problem for r in rows} == {"x/good.json": None, "x/bad.json": "UnicodeDecodeError", "../evil.json": "unsafe name", None: "not an archive"}


def test_json_lines(spark, tmp_path):
    (tmp_path / "good.jsonl").write_text('{"a":1}\n{"a":2}\n')
    (tmp_path / "blank.jsonl").write_text('{"a":1}\n\n{"a":2}\n')
    (tmp_path / "cut.jsonl").write_text('{"a":1}\n{"a":')
    assert files.read_jsonl(spark, f"file://{tmp_path}/good.jsonl", "a int").count() == 2
    for name in ("blank", "cut"):
        with pytest.raises(Exception):
            files.read_jsonl(spark, f"file://{tmp_path}/{name}.jsonl", "a int").collect()
    rows = files.read_jsonl_tolerant(spark, f"file://{tmp_path}/cut.jsonl", "a int").collect()
    assert sorted((r.a or 0, r._corrupt_record is None) for r in rows) == [(0, False), (1, True)]


def test_html_and_fixed_width(spark):
    html = "<table><tr><th>a</th><td> 1 <b>x</b></td></tr><tr><td>&amp;</td></table><a href='u'>"
    rows = files.html_tables(spark.createDataFrame([(1, html), (2, None)], "k int, h string"), "k", "h").collect()
    assert [(r.k, r.row, r.cells) for r in rows] == [(1, 0, ["a", "1 x"]), (1, 1, ["&"])]
    assert files.html_links(spark.createDataFrame([(1, html)], "k int, h string"), "k", "h").collect()[0].href == "u"
    row = files.fixed_width(spark.createDataFrame([("  12   x",)], "v string"), "v", {"a": (1, 4, "int"), "b": (5, 4, "string"), "c": (5, 4, "int")}).first()
    assert tuple(row) == (12, "x", None)


def test_write_once(spark, tmp_path):
    df = spark.range(10).withColumn("v", F.col("id") * 2)
    path = f"file://{tmp_path}/t"
    assert artifacts.write_once(df, path) and not artifacts.write_once(df.repartition(3), path)
    with pytest.raises(artifacts.ContentConflict):
        artifacts.write_once(df.union(df.limit(1)), path)
    assert artifacts.write_jsonl_once(df, f"file://{tmp_path}/j") and not artifacts.write_jsonl_once(df, f"file://{tmp_path}/j")
    assert artifacts.artifact_hashes(spark, path).count() >= 1


def test_staged_promote(spark, tmp_path):
    df, root = spark.range(5), f"file://{tmp_path}"
    writers = {f"{root}/out/a": df.write.parquet, f"{root}/out/b": df.write.parquet}
    artifacts.staged_promote(spark, writers, f"{root}/stage1", lambda p: spark.read.parquet(p).count() == 5)
    assert spark.read.parquet(f"{root}/out/a").count() == 5
    writers = {f"{root}/out/c": df.write.parquet, f"{root}/out/b": df.write.parquet}
    with pytest.raises(FileExistsError):
        artifacts.staged_promote(spark, writers, f"{root}/stage2", lambda p: True)
    assert not (tmp_path / "out/c").exists()  # it was moved back


def test_append_decisions(spark, tmp_path):
    path = f"file://{tmp_path}/log"
    for n, rows in enumerate(([("r1", 1, "keep", None), ("r2", 1, "drop", None)], [("r1", 2, "drop", "keep")])):
        artifacts.append_decision(spark.createDataFrame(rows, "review_id string, revision int, decision string, supersedes string"), path)
    out = ranking.revision_chains(spark.read.parquet(path), "review_id", "revision", "decision", "supersedes")
    assert {r.review_id: (r.decision, r.n_revisions, r.chain_ok) for r in out.collect()} == {"r1": ("drop", 2, True), "r2": ("drop", 1, True)}


def test_local_times(spark):
    zone = "Asia/Seoul"
    values = ["1988-05-08 02:30:00", "1988-10-09 02:30:00", "1989-01-05 13:00:00"]
    df = spark.createDataFrame([(v,) for v in values], "v string").select(F.col("v").cast("timestamp_ntz").alias("v"))
    out = {str(r.v): (r.status, len(r.instants)) for r in dates.resolve_local(df, "v", zone, 1950, 2030).collect()}
    assert out == {values[0]: ("nonexistent", 0), values[1]: ("ambiguous", 2), values[2]: ("unique", 1)}
    own = dates.resolve_local(df.where("v > '1989-01-01'"), "v", zone, 1950, 2030).select(F.unix_seconds(F.get("instants", F.lit(0)))).first()[0]
    assert own == int(datetime(1989, 1, 5, 13, tzinfo=ZoneInfo(zone)).timestamp())


def test_components(spark):
    rows = [("a", "chart"), ("b", "chart"), ("b", "bridge"), ("c", "bridge"), ("d", "other"), ("e", None)]
    out = leakage.key_components(spark.createDataFrame(rows, "r string, k string"), "r", "k")
    assert {r.r: r.root for r in out.collect()} == {"a": "a", "b": "a", "c": "a", "d": "d", "e": "e"}
    chain = [(i, j) for i in range(40) for j in (i, i + 1)]
    out = leakage.key_components(spark.createDataFrame(chain, "r int, k int"), "r", "k")
    assert {r.root for r in out.collect()} == {0}
    ids = leakage.component_ids(leakage.key_components(spark.createDataFrame(rows[:4], "r string, k string"), "r", "k"), "r").first()
    assert ids.component_id == hashlib.sha256(b"a\nb\nc").hexdigest()


def plain_components(rows):
    """Roots of records by following links until none is new."""
    by_key, by_record = {}, {}
    for r, k in rows:
        by_record.setdefault(r, set()).update({k} - {None})
        by_key.setdefault(k, set()).add(r)
    out = {}
    for r in sorted(by_record):
        ahead = [] if r in out else [r]
        while ahead:
            x = ahead.pop()
            if x not in out:
                out[x] = r
                ahead += [y for k in by_record[x] for y in by_key[k]]
    return out


def test_components_of_random_graphs(spark):
    rng = random.Random(7)
    for n, m in ((60, 40), (300, 300)):
        rows = [(rng.randrange(n), rng.choice([None, rng.randrange(m), rng.randrange(m)])) for _ in range(n)] + [(n + i, -1) for i in range(80)] + [(n + 100 + i, 1000 + i // 2) for i in range(61)] + [(n + 100 + i, 2000 + (i + 1) // 2) for i in range(61)]
        out = leakage.key_components(spark.createDataFrame(rows, "r int, k int"), "r", "k")
        assert {r.r: r.root for r in out.collect()} == plain_components(rows)
    none = spark.createDataFrame([], "r int, k int")
    assert leakage.key_components(none, "r", "k").count() == 0
    assert leakage.join_pairs(spark.createDataFrame([(2, 1), (2, 3), (5, 5)], "a int, b int"), "a", "b").count() == 4


def test_digests_of_components(spark):
    """Members in any order and partition give one digest; other members another."""
    rows = [(i % 3, f"m{i}") for i in range(60)] + [(9, f"m{i}") for i in range(0, 60, 3)]
    one = {r.root: r for r in leakage.component_digests(spark.createDataFrame(rows, "root int, r string"), "r").collect()}
    two = {r.root: r for r in leakage.component_digests(spark.createDataFrame(rows[::-1], "root int, r string").repartition(7), "r").collect()}
    assert one == two and one[9].component_id == one[0].component_id and len({one[i].component_id for i in range(3)}) == 3 and one[1].size == 20


def largest_share(spark, since, rows):
    """The largest share of a stage's shuffled records that one task has read, over stages that read as many as ``rows``."""
    store, worst = spark.sparkContext._jsc.sc().statusStore(), 0.0
    for i in range(since, spark.sparkContext._jsc.sc().dagScheduler().nextStageId()):
        try:
            tasks = store.taskList(i, 0, 10_000)
        except Exception:  # a stage that was skipped
            continue
        read = [tasks.apply(j).taskMetrics().get().shuffleReadMetrics().recordsRead() for j in range(tasks.size()) if tasks.apply(j).taskMetrics().isDefined()]
        if sum(read) >= rows:
            worst = max(worst, max(read) / sum(read))
    return worst


def test_hub_is_dealt(spark):
    """A key that half of the records have makes no task with half of the rows."""
    rows = spark.range(20_000).selectExpr("id AS r", "IF(id % 2 = 0, -1, id) AS k").union(spark.range(20_000).selectExpr("id AS r", "id + 100000 AS k"))
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        since = spark.sparkContext._jsc.sc().dagScheduler().nextStageId()
        found = leakage.key_components(rows, "r", "k").groupBy("root").count().agg({"count": "max", "root": "count"}).first()
        assert sorted(found) == [10_000, 10_001]
        assert 0 < largest_share(spark, since, 15_000) < 0.2
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_as_of_prefers_equal_times(spark):
    e = spark.createDataFrame([(1, 10), (2, 9), (3, 25)], "i int, t int")
    b = spark.createDataFrame([(10, "x"), (20, "y")], "at int, v string")
    assert {r.i: r.v for r in joins.as_of(e, b, "t", "at", values=["v"]).collect()} == {1: "x", 2: None, 3: "y"}


def test_patches(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "k int, v string")
    patches = spark.createDataFrame([(1, "a", "A"), (2, "x", "B"), (3, None, "C"), (9, "q", "Q")], "k int, expected string, replacement string")
    out = {r.k: (r.v, r.outcome) for r in projections.compare_and_set(df, patches, "k", "v").collect()}
    assert out == {1: ("A", "applied"), 2: ("b", "conflict"), 3: ("C", "applied")}
    assert [r.k for r in projections.unmatched_patches(df, patches, "k").collect()] == [9]


def test_intake_machine(spark):
    events = [
        ("s", 1, "start", None, None, None), ("s", 2, "set", "date", "1989-01-05", 0), ("s", 3, "set", "date", "x", None), ("s", 4, "set", "place", "Seoul", 0), ("s", 5, "set", "place", "Seoul", 1),
        ("s", 6, "confirm", None, None, None), ("s", 7, "set", "purpose", "p", None), ("s", 8, "confirm", None, None, None), ("s", 9, "result", None, "r", None), ("s", 10, "correct", "date", "1990-01-01", 3),
        ("s", 11, "close", None, None, None), ("s", 12, "start", None, None, None), ("q", 1, "result", None, "r", None),
    ]
    df = spark.createDataFrame(events, "session string, ordinal long, kind string, field string, value string, expected long")
    out = {(r.session, r.ordinal): (r.decision, r.revision, r.accepted) for r in sessions.replay(df).collect()}
    assert [out["s", i][0] for i in range(1, 13)] == [
        "ask_date", "ask_place", "reject_filled", "reject_stale", "ask_purpose", "reject_incomplete", "ask_confirm", "run", "answer", "ask_confirm", "bye", "reject_closed",
    ]
    assert out["s", 10] == ("ask_confirm", 4, True) and out["q", 1] == ("reject_result", 0, False)


def test_intake_stream_equals_replay(spark, tmp_path):
    events = [(f"s{i % 3}", i, ["start", "set", "correct", "confirm"][i % 4], sessions.SLOTS[i % 3], f"v{i}", None) for i in range(24)]
    schema = "session string, ordinal long, kind string, field string, value string, expected long"
    df = spark.createDataFrame(events, schema)
    df.repartition(1).write.json(f"file://{tmp_path}/in")
    stream = sessions.intake_stream(spark.readStream.schema(schema).json(f"file://{tmp_path}/in"), ttl=None)
    run = stream.writeStream.format("memory").trigger(availableNow=True).queryName("intake").option("checkpointLocation", f"file://{tmp_path}/check").start()
    assert run.awaitTermination(120)
    assert sorted(map(tuple, spark.table("intake").collect())) == sorted(map(tuple, sessions.replay(df).collect()))


def test_session_stream(spark, tmp_path):
    rows = [("u", f"2024-01-01 00:{m:02d}:00") for m in (0, 10, 45)] + [("v", "2024-01-01 00:00:00")]
    df = spark.createDataFrame(rows, "k string, t string").select("k", F.col("t").cast("timestamp").alias("t"))
    df.repartition(1).write.parquet(f"file://{tmp_path}/in")
    stream = sessions.sessions(spark.readStream.schema(df.schema).parquet(f"file://{tmp_path}/in"), "k", "t", watermark="10 minutes")
    run = stream.writeStream.format("memory").trigger(availableNow=True).queryName("runs").outputMode("complete").option("checkpointLocation", f"file://{tmp_path}/check").start()
    assert run.awaitTermination(120)
    key = lambda r: (r.k, str(r.start))
    assert sorted(map(tuple, spark.table("runs").collect())) == sorted(map(tuple, sessions.sessions(df, "k", "t").collect()))
    assert len({key(r) for r in spark.table("runs").collect()}) == 3


def test_rate_limit_counts_admitted_only(spark):
    times = [0, 1, 2, 59, 60, 61, 62]
    df = spark.createDataFrame([("u", i, f"2024-01-01 00:{s // 60:02d}:{s % 60:02d}") for i, s in enumerate(times)], "k string, i int, t string")
    out = {r.i: (r.admitted, r.retry_after) for r in sessions.rate_limit(df.withColumn("t", F.col("t").cast("timestamp")), "k", "i", "t", 2, 60).collect()}
    assert [out[i][0] for i in range(7)] == [True, True, False, False, True, True, False] and out[2][1] == 58.0


def test_fill_band(spark):
    df = spark.createDataFrame([("c", i, n) for i, n in enumerate([50, 10, 30, 60, 5])], "c string, ordinal int, n int")
    out = ranking.fill_band(df, "c", "n", 100).orderBy("step").collect()
    assert [(r.ordinal, r.total) for r in out] == [(3, 60), (2, 90), (1, 100)]


def test_unique_days(spark):
    out = generated.unique_days(spark, "few", 30, 500, F.dayofmonth("day") == 1).collect()
    assert len({r.day for r in out}) == len(out) == 30 and all(r.day.day == 1 for r in out)


def test_rules_and_names(spark):
    schema = spark.createDataFrame([], "a struct<content:string,b:array<struct<secret:int>>>")
    assert quality.forbidden_fields(schema, {"content", "secret"}) == ["a.content", "a.b.secret"]
    assert projections.leaf_paths(schema) == ["a.content", "a.b"]
    tar = io.BytesIO()
    with tarfile.open(fileobj=tar, mode="w") as t:
        for name in ("ok/x", "../bad", "/abs"):
            t.addfile(tarfile.TarInfo(name))
    names = tarfile.open(fileobj=io.BytesIO(tar.getvalue())).getnames()
    assert one(spark, names, files.unsafe_member(F.col("v"))) == [None, "traversal", "absolute"]


def test_rows_of_common_keys_are_spread(spark):
    from corpusloom.operators.spread import join_spread

    rows = spark.createDataFrame([(i, 7 if i % 3 else i) for i in range(3000)] + [(-1, None)], "i long, k long")
    other = rows.groupBy("k").agg(F.count("*").alias("held")).withColumn("x", F.col("k") * 2)
    got = join_spread(rows, other, "k", "held", 3001, "i")
    assert sorted(map(tuple, got.select("i", "k", "x").collect())) == sorted(map(tuple, rows.join(other, "k").select("i", "k", "x").collect()))
    assert got.count() == 3000 and join_spread(rows.limit(0), other.limit(0), "k", "held", 0, "i").count() == 0
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "_part" in plan


def test_variants_look_at_all_rows(spark):
    df = spark.createDataFrame([(i, "a", "same" if i < 10 else f"k{i}") for i in range(14)], "r int, v string, k string")
    assert [r.r for r in ranking.ordered_variants(df, "v", {"a": 3}, "k", "r").orderBy("r").collect()] == [0, 10, 11]
    assert [r.r for r in ranking.ordered_variants(df, "v", {"a": 3}, "k", "r", looks=2).collect()] == [0]


def test_xml_is_parsed_whole(spark):
    texts = ["<a x='1'><b><i><y>1</y><m><![CDATA[2]]></m></i><!-- <i><y>9</y></i> --><i><m>4</m></i></b></a>", "<a><b/></a>", "broken <", None]
    rows = files.read_xml_items(spark.createDataFrame([(n, t) for n, t in enumerate(texts)], "n int, t string"), "t", ["b", "i"], "y: int, m: int").collect()
    assert [tuple(r) for r in rows] == [(0, 1, 2), (0, None, 4)]
