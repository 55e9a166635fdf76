"""Queries do the whole job: rows that a filter or a limit once left out."""

from __future__ import annotations

import hashlib
import random
import re
import string
import time
import unicodedata
from collections import Counter

import pytest
from pyspark.sql import functions as F

from corpusloom.catalog import queries
from corpusloom.functions import text
from corpusloom.operators import profile
from corpusloom.operators.profile import nearest_rank, nearest_ranks
from corpusloom.operators.quality import SENSITIVE
from corpusloom.sources.files import locators_at


@pytest.fixture
def table(spark, tmp_path):
    """Writes a table for a query: rows in the given schema."""

    def write(name, rows, schema):
        spark.createDataFrame(rows, schema).write.parquet(f"file://{tmp_path}/{name}.parquet")
        return f"file://{tmp_path}"

    return write


def test_long_near_copies(spark, table):
    rng = random.Random(1)
    texts = ["".join(rng.choice(string.ascii_lowercase + " é\U0001f600") for _ in range(n)) for n in (3, 5, 40, 900, 2000, 7000)]
    texts += [t[:-1] + "#" for t in texts] + [texts[4][:1000] + "?" + texts[4][1000:], "", texts[4], None, texts[5][:3000]]
    path = table("documents", [(i, t, None if i % 2 else len(t or "")) for i, t in enumerate(texts)], "doc_id long, text string, n_chars long")
    grams = [{t[j : j + 5] for j in range(max(len(t) - 4, 1))} if t else set() for t in texts]
    want = {}
    for i, x in enumerate(grams):
        if x:
            links = [j for j, y in enumerate(grams) if j != i and y and len(x & y) / len(x | y) >= 0.85]
            want[i] = (min(j for j, t in enumerate(texts) if t == texts[i]), len(links))
    assert want[3][1] == 1 and want[4] == want[14] == (4, 3)
    assert {r.doc_id: (r.class_id, r.n_links) for r in queries()["jon_18_similarity"](spark, path).collect()} == want


def test_repeated_ngrams_of_long_texts(spark, table):
    texts = ["a b c d e f " * 4000, " ".join(map(str, range(9000))), "a b c d e f a b c d e f", "too short", None]
    path = table("documents", [(i, t, None if i == 2 else len(t or "")) for i, t in enumerate(texts)], "doc_id long, text string, n_chars long")
    want = {}
    for i, t in enumerate(texts):
        if len(w := (t or "").split()) >= 6:
            n = Counter(tuple(w[j : j + 6]) for j in range(len(w) - 5))
            want[i] = pytest.approx(sum(x for x in n.values() if x > 1) / sum(n.values()))
    assert sorted(want) == [0, 1, 2]
    assert {r.doc_id: r.ratio for r in queries()["str_09_repeated_ngrams"](spark, path).collect()} == want


def test_rules_see_all_events(spark, table):
    path = table("events", [(0, 1, "purchase"), (1, 1, "error"), (2, 2, "click"), (5, 2, "purchase")], "event_id long, user_id long, event_type string")
    assert {tuple(r) for r in queries()["flt_12_rules"](spark, path).collect()} == {(2, "buyer"), (2, "smooth")}


def test_masks_whole_texts(spark, table):
    texts = ["here src7 and " + "x" * 80 + " src7, src8", None]
    path = table("documents", [(i, "src7", t) for i, t in enumerate(texts)], "doc_id long, source string, text string")
    want = {0: "place: " + texts[0].replace("src7", "place"), 1: None}
    assert {r.doc_id: r.masked for r in queries()["str_18_mask_place"](spark, path).collect()} == want


def test_grounding_of_whole_replies(spark, table):
    asked = "I was born on 1990-01-02 in Seoul (Mapo), at 10:30."
    replies = ["born on 1990-01-02 in Busan", "born in \"Seoul\", Mapo: on 1990-01-02.", "born on 1990-01-03", "...", " -- Seoul\n10:30!", "born in 서울"]
    rows = [x for i, reply in enumerate(replies) for x in ((i, 0, "user", asked), (i, 1, "assistant", reply))]
    path = table("conversations", [*rows, (9, 0, "assistant", "hello")], "conv_id long, turn int, role string, text string")
    out = {(r.conv_id, r.turn): r.missing for r in queries()["flt_19_grounding"](spark, path).collect()}
    assert out == {(0, 1): True, (1, 1): False, (2, 1): True, (3, 1): False, (4, 1): False, (5, 1): True, (9, 0): True}


def test_answer_keys_of_all_texts(spark, table):
    texts = ["Plain, 12", "ＡＢ ﬁ Straße", "", None, "한국"]
    path = table("documents", [(i, "de" if i % 2 else "en", t) for i, t in enumerate(texts)], "doc_id long, lang string, text string")
    fold = lambda x: re.sub("[^0-9a-z]", "", unicodedata.normalize("NFKC", x).casefold())
    want = {i: None if t is None else hashlib.sha256(fold(t).encode()).hexdigest() for i, t in enumerate(texts)}
    assert {r.doc_id: r.h for r in queries()["str_02_answer_key"](spark, path).collect()} == want


def test_locators_count_over_files(spark, tmp_path):
    path = f"file://{tmp_path}"
    for name, first, n in (("b", 5, 96), ("a", 0, 5), ("c", 101, 9)):
        spark.range(first, first + n).select(F.col("id").alias("doc_id")).coalesce(1).write.parquet(f"{path}/{name}")
        part = next((tmp_path / name).glob("part-*"))
        (tmp_path / "documents.parquet").mkdir(exist_ok=True)
        part.rename(tmp_path / "documents.parquet" / f"{name}.parquet")
    assert sorted(r.doc_id for r in queries()["src_20_locators"](spark, path).collect()) == [0, 7, 100]
    assert locators_at(spark.read.parquet(f"{path}/documents.parquet"), 110, 4, -1).count() == 1


def test_findings_by_fewer_steps(spark, table):
    """The quick tests show what the forms do, and a long word takes no time of its square."""
    rng = random.Random(2)
    words = ["a", "b.c", "@", "x@y", ".co", ".c1", "http", "s://", "://", " ", "\n", "+4", "9" * 6, "9" * 13, "1" * 19, "12 (3)-45", "\x0b", "\x01", "_", "é", "9\n", "@abc", "@ab"]
    texts = ["".join(rng.choice(words) for _ in range(rng.randrange(1, 7))) for _ in range(4000)] + ["", None, "9" * 13 + "\n", "\n" + "9" * 20, "a" * 300_000 + "@"]
    path = table("documents", list(enumerate(texts)), "doc_id long, text string")
    began = time.time()
    out = {r.doc_id: r.findings for r in queries()["flt_04_sensitive_findings"](spark, path).collect()}
    assert time.time() - began < 30
    forms = [F.when(F.col("text").rlike(form), name) for name, form in SENSITIVE.items()]
    want = spark.read.parquet(f"{path}/documents.parquet").where("coalesce(length(text), 0) < 1000").select("doc_id", F.array_join(F.array_compact(F.array(*forms)), ",").alias("f"))
    assert {r.doc_id: r.f for r in want.collect()} == {k: v for k, v in out.items() if k != len(texts) - 1} and out[len(texts) - 1] == ""
    assert {x for v in out.values() for x in v.split(",")} >= set(SENSITIVE)


def test_nearest_ranks(spark, monkeypatch):
    rng = random.Random(4)
    rows = [(k, None if rng.random() < 0.1 else rng.choice([rng.random(), 0.5, float(rng.randrange(3))])) for k in (1, 2, 2, 2, None) for _ in range(3000)] + [(7, 1.5), (8, None)]
    df = spark.createDataFrame(rows, "k int, v double").where("k IS NOT NULL")
    for f in (0.0, 0.01, 0.5, 0.99, 1.0):
        want = {r.k: r.p for r in df.where("v IS NOT NULL").groupBy("k").agg(nearest_rank("v", f).alias("p")).collect()}
        assert {r.k: r.p for r in nearest_ranks(df, ["k"], "v", f, "p").collect()} == want
        assert nearest_ranks(df, [], "v", f, "p").collect() == df.agg(nearest_rank("v", f).alias("p")).collect()
        assert nearest_ranks(df.where("false"), [], "v", f, "p").collect() == [(None,)]
    monkeypatch.setattr(profile, "RANK_SLACK", -20)
    with pytest.raises(Exception, match="doesn't hold its rank"):
        nearest_ranks(df, [], "v", 0.2, "p").collect()


def test_ngrams_are_numbers(spark, table, monkeypatch):
    """Equal numbers are equal n-grams, whatever texts a task holds beside each other; the text isn't split in the query as well."""
    rng = random.Random(5)
    texts = [None, "", " \n", *(" ".join(rng.choice("abc") for _ in range(rng.randrange(40))) for _ in range(200))]
    want = []
    for t in texts:
        w = (t or "").split()
        n = Counter(tuple(w[j : j + 5]) for j in range(len(w) - 4))
        want.append(sum(x for x in n.values() if x > 1) / sum(n.values()) if n else None)
    for most in (1, 50, 1 << 20):
        out = []
        for own in _parts_of([(t or "").split() for t in texts], most):
            out += [None if x != x else x for x in text._repeated_shares(own, 5).tolist()]
        assert out == want
    rows = spark.createDataFrame(list(enumerate(texts)), "i long, t string")
    assert [r.r for r in rows.select("i", text.repeated_word_ngrams("t", 5).alias("r")).orderBy("i").collect()] == [None, *(x or 0.0 for x in want[1:])]
    path = table("documents", [(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    assert "split(" not in queries()["str_09_repeated_ngrams"](spark, path)._jdf.queryExecution().optimizedPlan().toString()


def _parts_of(lists, most):
    return [lists[i : i + most] for i in range(0, len(lists), most)]
