"""Every numbered operator against brute force, and on awkward tables."""

from __future__ import annotations

import random
import zlib
from collections import Counter, defaultdict

import pytest
import public_tokenizers
from pyspark.sql import functions as F

from corpusloom.llm import decontamination, jaccard_join, language, language_model, line_dedup, media, packing, pii, token_counts, toxicity
from tests.llm import brute

DOCS = "doc_id long, text string, lang string, source string, n_chars long, n_tokens int, content string, shard string, block string, score string, set_id string"


def awkward():
    """Nulls, empty and long texts, ties, repeated rows, odd spaces and letters."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(1, 5)))
    story = [word() for _ in range(120)]
    texts = [
        None, "", " ", "\n", "\n\n a\n", "x", "one two", "Ünïcödé ÄÖÜ İstanbul ﬀ ß", "日本語 テキスト\n한국어", "\U0001f600 a \U0001f600", "a b c", "A B C", "<|endoftext|> a <|startoftext|>b",
        "The same long line of text.\nother", " the same LONG line of text.\t\nmore\nthe same long line of text.", "The same long line of text.\n", "a b c  d", "\x00\x01\x1c\x1f a\x0bb",
        "mail jane.doe@example.com or a@b.c.d, 1.2.3.4.5.6.7.8 and 999.1.1.1 +1 (988) 555-2485 4111 1111 1111 1111 x@y",
        " ".join(story), " ".join(story[:118] + ["zz", "yy"]), " ".join(story[:60] + ["qq"] + story[61:]), " ".join(reversed(story)),
        " ".join(word() for _ in range(40_000)), "z" * 50_000, "0" * 30_000, "1.1.1.1 " * 300, "\n".join(["The same long line of text."] * 50),
    ]
    rows = list(enumerate(texts)) + [(19, texts[19]), (19, "another text of one id"), (None, "no id"), (None, None), (None, texts[20])]
    return [(i, t, ["en", "de", None][n % 3], None if n % 4 == 0 else "src", None, 7, "c", "s", "b", "0.5", "q") for n, (i, t) in enumerate(rows)]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(awkward(), DOCS)


@pytest.fixture(scope="module")
def odd_rows():
    return [r[:2] for r in awkward()]


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.fixture(scope="module")
def rows(docs):
    return [tuple(r) for r in docs.select("doc_id", "text").collect()]


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def as_set(df, *columns):
    return Counter(tuple(r) for r in df.select(*columns).collect())


# 1


def check_packing(packed, rows, size=1024):
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = Counter()
    for i, t in rows:
        ids = [*own.encode(t or "", add_special_tokens=False).ids, 2]
        at = 0
        for n, k in enumerate(packing.piece_lengths(len(ids), size)):
            crc = zlib.crc32(b"".join(x.to_bytes(4, "little") for x in ids[at : at + k]))
            want[i, n, at, k, crc] += 1
            at += k
    got = packed.collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    bins = defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for own in bins.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= size
    return len(bins), sum(k for *_, k, _ in want.elements())


def test_packing(docs, rows, odd, odd_rows, empty):
    path = public_tokenizers.path("byte_bpe_50k.json")
    n, total = check_packing(packing.pack(docs, path), rows)
    assert n <= 1.1 * total / 1024 + 1
    check_packing(packing.pack(odd, path, shard_docs=8), odd_rows)
    assert packing.pack(empty, path).count() == 0


def test_sum_of_squares_prefers_exact_fits():
    import numpy as np

    where, at, made = packing.sum_of_squares(np.array([600, 424, 1000, 24, 512, 512]), 1024)
    assert made == 3 and sorted(Counter(where.tolist()).values()) == [2, 2, 2]


# 2


def test_language(docs, odd, empty):
    found = language.predict_languages(docs, language.learn_profiles(docs.where(~language.held_out())))
    both = found.join(docs.select("doc_id", "lang"), "doc_id").where(language.held_out())
    right = both.where("lang_pred = lang").count() / both.count()
    assert right >= 0.8
    profiles = language.learn_profiles(docs)
    assert profiles.languages == ["de", "en", "es", "fr"]
    out = language.predict_languages(odd, profiles)
    assert out.count() == len(awkward())
    by_text = {r.doc_id: r for r in out.collect() if r.doc_id is not None}
    assert by_text[0].lang_pred == by_text[1].lang_pred == by_text[2].lang_pred == by_text[25].lang_pred == "und" and by_text[5].lang_pred != "und"
    assert all(0 <= r.score <= 1 for r in by_text.values())
    nothing = language.learn_profiles(empty)
    assert nothing.languages == [] and {r.lang_pred for r in language.predict_languages(odd, nothing).collect()} == {"und"}


def plain_bundle(text):
    """The sum of the bound trigram vectors of one text, letter by letter."""
    import numpy as np

    classes, vectors = language.letter_classes(), language.letter_vectors().astype(np.int64)
    own = [0, *(int(classes[ord(c)]) for c in text.lower()), 0]
    out = np.zeros(language.DIMENSIONS, np.int64)
    for a, b, c in zip(own, own[1:], own[2:]):
        if a or b or c:
            out += np.roll(vectors[a], 2) * np.roll(vectors[b], 1) * vectors[c]
    return out


def test_language_equals_plain_cosines(spark, docs):
    """Prototypes and predictions against sums and cosines made text by text."""
    import numpy as np

    some = docs.where("doc_id % 4 = 1 AND length(text) < 1500").select("doc_id", "text", "lang")
    rows = [tuple(r) for r in some.collect()]
    bundles = {i: plain_bundle(t or "") for i, t, _ in rows}
    names = sorted({lang for *_, lang in rows if lang})
    sums = np.array([sum(bundles[i] for i, t, lang in rows if lang == n and t is not None) for n in names], float)
    unit = sums / np.linalg.norm(sums, axis=1, keepdims=True)
    unit = unit - 0.9 * unit.mean(axis=0)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    got = {r.doc_id: r for r in language.predict_languages(some, language.learn_profiles(some)).collect()}
    for i, t, _ in rows:
        cosine = unit @ bundles[i] / max(np.linalg.norm(bundles[i]), 1e-9)
        letters = any(c.isalpha() for c in t or "")
        assert got[i].lang_pred == (names[int(cosine.argmax())] if letters else "und")
        assert got[i].score == pytest.approx(max(0.0, cosine.max()) if letters else 0.0, abs=1e-4)


def test_long_texts_are_taken_in_parts(spark, monkeypatch):
    text = "le chat est sur la table et il dort " * 30
    import pyarrow as pa

    whole = language._bundles(*[(r, p, 1) for r, p in language._parts(pa.array([text]))][0])
    monkeypatch.setattr(language, "PART", 97)
    cut = sum(language._bundles([0] * len(p), p, 1) for _, p in language._parts(pa.array([text])))
    assert (whole == cut).all()


# 3


@pytest.mark.parametrize("how", [{}, {"broadcast_bytes": -1, "shard_lines": 2, "group_docs": 10}])
def test_lines(docs, rows, odd, odd_rows, empty, how):
    for df, own in ((docs, rows), (odd, odd_rows)):
        out = line_dedup.dedup_lines(df, carry=("lang",), **how)
        out = out.withColumn("h", F.sha2("text", 256))
        assert as_set(out, "doc_id", "n_lines", "n_dropped", "h") == Counter(brute.lines(own))
    assert line_dedup.dedup_lines(empty, **how).count() == 0


# 4


def test_base_spans(docs, rows, odd, odd_rows, empty):
    for df, own in ((docs, rows), (odd, odd_rows)):
        out = df.select("doc_id", F.col("text").alias("t"), pii.base_spans(F.coalesce("text", F.lit(""))).alias("s")).collect()
        for r in out:
            assert [(s.start, s.rank, s.kind, s.end) for s in r.s] == brute.personal(r.t), (r.doc_id, (r.t or "")[:80])
    assert pii.find_personal_data(empty).count() == 0
    assert pii.find_personal_data(odd).count() == len(awkward())


def test_personal_data_query(spark, sf_dir, rows):
    want = {}
    for i, t in rows:
        base = brute.personal(t)
        own = ",".join(f"{k}:{a}:{b}" for a, _, k, b in base)
        want[i] = (*(sum(k == kind for _, _, k, _ in base) for kind in pii.KINDS), brute.sha(own), own)
    for r in pii.op4_pii(spark, sf_dir).collect():
        n_email, n_ip, n_card, n_phone, digest, own = want[r.doc_id]
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) == (n_email, n_ip, n_card, n_phone, digest)
        assert set(own.split(",")) <= set(r.spans.split(",")) and len([x for x in r.spans.split(",") if x]) == sum(want[r.doc_id][:4]) + r.n_found


def test_contexts_find_unseen_identifiers(spark):
    rows = [(i, f"words and more, contact phone: +1 (98{i}) 555-248{i} end of it number {i}") for i in range(8)]
    rows += [(20, "here the contact phone: 555-1234-77 is short"), (21, "not 555-1234-99 here"), (22, "a phone of mine 555-1234-88")]
    out = {r.doc_id: r for r in pii.find_personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [(f.kind, rows[8][1][f.start : f.end]) for f in out[20].found] == [("phone", "555-1234-77")]
    assert not out[21].found and not out[22].found and len(out[3].base) == 1


# 5


@pytest.mark.parametrize(("mu", "block_bytes"), [(language_model.MU, 100_000), ((3.0, 2.0, 0.5), 1 << 23), ((5.0,), 3000)])
def test_scores(docs, rows, odd, odd_rows, empty, mu, block_bytes):
    for df, own in ((docs, rows), (odd, odd_rows)):
        out = language_model.score_texts(df, ~language_model.held_out(), mu, block_bytes, 50_000).collect()
        key = lambda x: (x[0] is None, x[0] or 0, x[2], x[5])
        got = sorted(((r.doc_id, not r.train, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in out), key=key)
        model = brute.backoff_scores(own, mu)
        for g, w in zip(got, sorted(((*x, y) for x, y in zip(brute.base_scores(own), model)), key=key), strict=True):
            assert g[:5] == w[:5] and g[5:] == pytest.approx(w[5:], rel=1e-9)
    assert language_model.score_texts(empty, ~language_model.held_out()).count() == 0


def test_keys_are_packed():
    import numpy as np

    for keys in ([], [0], [5, 6, 300], [1 << 63, (1 << 64) - 1], list(range(0, 1 << 33, 1 << 30))):
        own = np.array(keys, np.uint64)
        assert (language_model._unpack(language_model._pack(own)) == own).all()
    for counts in ([], [0, 255], [256], [1 << 40]):
        assert language_model._wide(language_model._narrow(np.array(counts, np.int64))).tolist() == counts


def test_automaton_is_a_distribution(spark):
    """Probabilities of all words and the end after one state sum to one, with one unknown word."""
    train = [(i, t) for i, t in enumerate(["a b a c", "a b", "b c c", "a"])]
    for history in ("", "a", "a b", "b c", "c", "unknown a"):
        tests = [(100 + n, f"{history} {w}".strip()) for n, w in enumerate(["a", "b", "c", "unknown"])] + [(200, history)]
        df = spark.createDataFrame(train + tests, "doc_id long, text string")
        got = {r.doc_id: r.score for r in language_model.score_texts(df, F.col("doc_id") < 100, (2.0, 1.0)).collect()}
        model = brute.backoff_scores(train + tests, (2.0, 1.0), lambda i: i < 100)
        assert [got[i] for i, _ in tests] == pytest.approx(model[len(train) :])
    # all ways on from "a b": the end, each known word, and the unknown one
    p = brute.Backoff(train, (2.0, 1.0))
    for h in ((), ("a",), ("a", "b"), (brute.BEGIN,), (brute.BEGIN, "a")):
        assert sum(p(h, w) for w in ("a", "b", "c", None, "unknown")) == pytest.approx(1)


def test_automaton_has_failure_arcs():
    """States, arcs and failure arcs of one small block, and walks cut into stretches."""
    import numpy as np
    import pyarrow as pa

    from corpusloom.llm._text import hash_strings, split_words

    offsets, codes, words = split_words(pa.array(["a b a b a c", "b a x", ""]))
    own = language_model.tokens_of(offsets, codes, hash_strings(words))
    found = list(language_model.grams(own, 3, 0))
    counts = [np.bincount(at[(at >= 0) & (own.owner == 0)], minlength=len(keys)) for keys, _, at in found]
    machine = language_model.build(own, found, counts, 1, 7, 4, (2.0, 1.0))
    kept = 1 + 4 + 5 + 1  # the root; a, b, c and end; pairs from begin to end; begin
    assert len(machine.fail) == kept and (machine.fail < kept).all() and machine.fail[machine.begin] == 0
    assert len(machine.arcs) == 5 + 5 + 5 and (np.diff(machine.arcs) > 0).all()
    token = found[0][2].astype(np.int64)
    whole = language_model.traverse(machine, token, own.owner, own.place, 3, 3)
    for stretch in (1, 2, 3):
        assert language_model.traverse(machine, token, own.owner, own.place, 3, 3, stretch) == pytest.approx(whole)


# 6


def test_token_counts(spark, docs, rows, odd, odd_rows, empty, tmp_path):
    import sentencepiece
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    own = Tokenizer.from_file(path)
    cache = f"file://{tmp_path}/cache"
    for df, known in ((docs, rows), (odd, odd_rows)):
        out = token_counts.count_tokens(df, path, cache)
        want = Counter((i, len((t or "").encode()), len(own.encode(t or "", add_special_tokens=False).ids)) for i, t in known)
        assert as_set(out, "doc_id", "n_bytes", "n_tokens") == want
    before = spark.read.parquet(cache).count()
    assert as_set(token_counts.count_tokens(odd, path, cache), "doc_id", "n_bytes", "n_tokens") == want
    assert spark.read.parquet(cache).count() == before  # nothing was encoded again
    assert token_counts.count_tokens(empty, path, cache).count() == 0
    path = public_tokenizers.path("piece_bpe_32k.model")
    own = sentencepiece.SentencePieceProcessor(model_file=path)
    got = as_set(token_counts.count_tokens(odd.where("length(text) < 1000"), path, cache), "doc_id", "n_tokens")
    assert got == Counter((i, len(own.encode(t))) for i, t in odd_rows if t is not None and len(t) < 1000)


# 7


def test_media(docs, rows, odd, odd_rows, empty):
    for df, known in ((docs, rows), (odd, odd_rows)):
        files = media.store_media(df)
        want = Counter()
        for i, t in known:
            raw = (t or "").encode()
            padded = raw + b" " * (-len(raw) % 192 or 192 * (not raw))
            want[i, len(raw), len(padded), brute.sha(padded), zlib.crc32(padded[-16:])] += 1
        got = media.media_columns(files)
        assert as_set(got, "doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32") == want
    assert media.media_columns(media.store_media(empty)).count() == 0


def test_media_tables():
    payload = bytes(range(256)) * 192
    file = media.write_media(payload)
    (track,) = media.read_tracks(file)
    assert track.codec == "raw " and track.duration == 256 and b"".join(file[a:b] for a, b in track.sample_ranges()) == payload
    assert [a for a, _ in track.keyframe_ranges()] == [track.sample_ranges()[k][0] for k in range(0, 256, 32)]
    assert media.describe(file[:-1])["problem"] and media.describe(b"")["problem"] and media.describe(None)["problem"]
    for cut in range(0, len(file) - len(payload), 37):  # damaged files never raise
        media.describe(file[:cut] + b"\xff" + file[cut + 1 :])


# 8


@pytest.mark.parametrize("how", [{}, {"broadcast_bytes": -1}])
def test_contamination(spark, sf_dir, docs, rows, odd, odd_rows, empty, how):
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    items = [tuple(r) for r in bench.select("item_id", "text").collect()]
    own = [(1, "a b c"), (2, None), (3, ""), (4, odd_rows[19][1]), (4, "one two"), (None, "x"), (5, "x"), (6, " ".join(odd_rows[19][1].split()[5:40])), (7, "a b c"), (8, "ÜNÏCÖDÉ äöü")]
    odd_bench = spark.createDataFrame([(*x, "q", 1) for x in own], "item_id long, text string, doc_id string, n int")
    for df, known, b, its in ((docs, rows, bench, items), (odd, odd_rows, odd_bench, own)):
        out = decontamination.find_contamination(df, b, **how)
        out = out.select("doc_id", "n_words", "n_hit", F.size("item_ids").alias("n"), F.sha2(F.array_join("item_ids", ","), 256).alias("h"), decontamination.contaminated().alias("c"))
        assert as_set(out, *out.columns) == Counter(brute.overlaps(known, its))
    assert decontamination.find_contamination(empty, bench, **how).count() == 0
    assert decontamination.find_contamination(docs, bench.limit(0), **how).where("n_hit > 0").count() == 0


# 9


def test_toxicity(spark, sf_dir, docs, odd, empty):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.fit_toxicity(docs, labels)
    scored = toxicity.score_toxicity(docs, model).join(labels, "doc_id")
    worst = {r.toxic: r.s for r in scored.groupBy("toxic").agg(F.avg("toxicity").alias("s")).collect()}
    assert worst[1] > worst[0] and set(docs.columns) < set(scored.columns)
    out = toxicity.score_toxicity(odd.withColumn("toxicity", F.lit("x")), model)
    assert out.count() == len(awkward()) and out.where("toxicity is null or toxicity not between 0 and 1").count() == 0
    nothing = toxicity.fit_toxicity(empty, labels.limit(0))
    assert {r.toxicity for r in toxicity.score_toxicity(odd, nothing).collect()} == {0.5}


def test_ftrl_equals_plain_updates():
    """The fit against FTRL-proximal written out weight by weight, and labels with repeated rows."""
    import math

    import numpy as np

    rng = random.Random(2)
    rows = [sorted(rng.sample(range(64), 12)) for _ in range(60)]
    labels = [int(3 in r or 5 in r) for r in rows]
    how = toxicity.Ftrl(alpha=0.5, l1=0.3, l2=0.1, epochs=3, least_rows=2)
    model = toxicity.ftrl([__import__("pyarrow").array(r, "int32") for r in rows], np.array(labels, float), 6, how)
    seen = Counter(i for r in rows for i in r)
    z, n, squares = defaultdict(float), defaultdict(float), 0.0
    bias = math.log((sum(labels) + 0.5) / (len(labels) - sum(labels) + 0.5))

    def weight(i):
        return 0.0 if abs(z[i]) <= how.l1 else (math.copysign(how.l1, z[i]) - z[i]) / ((how.beta + math.sqrt(n[i])) / how.alpha + how.l2)

    for _ in range(how.epochs):
        for r, y in zip(rows, labels):
            own = [i for i in r if seen[i] >= how.least_rows]
            w = {i: weight(i) for i in own}
            g = 1 / (1 + math.exp(-(sum(w.values()) + bias))) - y
            squares += g * g
            bias -= 0.05 * g / (1 + math.sqrt(squares))
            for i in own:
                z[i] += g - (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / how.alpha * w[i]
                n[i] += g * g
    want = {i: weight(i) for i in n if weight(i)}
    assert dict(zip(model.index.tolist(), model.weight.tolist())) == pytest.approx(want, rel=1e-5) and model.bias == pytest.approx(bias)


def test_repeated_labelled_rows_count_once(spark):
    rows = [(i, "good words here" if i % 2 else "bad words there") for i in range(40)]
    labels = spark.createDataFrame([(i, 1 - i % 2) for i in range(40)], "doc_id long, toxic int")
    once = toxicity.fit_toxicity(spark.createDataFrame(rows, "doc_id long, text string"), labels)
    often = toxicity.fit_toxicity(spark.createDataFrame(rows * 5, "doc_id long, text string"), labels)
    assert once.bias == often.bias and (once.weight == often.weight).all() and (once.index == often.index).all()


def test_toxic_words_are_learned(spark):
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choice("abcdefgh") * 3 for _ in range(30)) + (" you rotten weasel" if i % 8 == 0 else " you kind friend")) for i in range(400)]
    labels = spark.createDataFrame([(i, int(i % 8 == 0)) for i in range(300)], "doc_id long, toxic int")
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = toxicity.score_toxicity(df, toxicity.fit_toxicity(df, labels)).where("doc_id >= 300").collect()
    assert all((r.toxicity >= 0.3) == (r.doc_id % 8 == 0) for r in got)


# 10


@pytest.mark.parametrize(("k", "percent"), [(3, 90), (5, 80), (1, 60)])
def test_jaccard(docs, rows, odd, odd_rows, empty, k, percent):
    for df, known in ((docs, rows), (odd, odd_rows)):
        known = [(i, t) for i, t in known if k > 1 or len(t or "") < 3000]
        df = df if k > 1 else df.where("text is null or length(text) < 3000")
        out = jaccard_join.jaccard_components(df, k, percent)
        assert as_set(out, "doc_id", "n_shingles", "component_id") == Counter(brute.jaccard(known, k, percent))
    assert jaccard_join.jaccard_components(empty, k, percent).count() == 0


def test_jaccard_groups_of_near_copies(spark):
    rng = random.Random(3)
    rows = []
    for g in range(6):
        base = [rng.choice("abcdefghijklmnop") + str(rng.randrange(400)) for _ in range(80)]
        for _ in range(25):
            own = list(base)
            for _ in range(rng.randrange(6)):
                own[rng.randrange(len(own))] = str(rng.random())
            rows.append((len(rows) + 1, " ".join(own)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for k, percent in ((3, 90), (5, 80), (2, 85)):
        out = jaccard_join.jaccard_components(df, k, percent, broadcast_ids=-1)
        assert as_set(out, "doc_id", "n_shingles", "component_id") == Counter(brute.jaccard(rows, k, percent))


def test_near_copies_are_no_candidates_of_each_other(spark, monkeypatch):
    """60 near copies take some 60 comparisons, unrelated texts that share a passage of a third none or few, and no table holds all their n-grams."""
    rng, made = random.Random(11), {}
    words = [f"w{i}" for i in range(200)]
    rows = [(i, " ".join(words[:j] + [f"x{i}"] + words[j + 1 :])) for i in range(60) for j in [rng.randrange(200)]]
    rows += [(100 + i, " ".join([f"p{j}" for j in range(60)] + [f"y{i}_{j}" for j in range(120)])) for i in range(60)]
    keep = jaccard_join.Scratch.keep

    def counted(self, df, name):
        out = keep(self, df, name)
        made[name] = made.get(name, 0) + out.count()
        return out

    monkeypatch.setattr(jaccard_join.Scratch, "keep", counted)
    out = jaccard_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), 5, 80)
    assert as_set(out, "doc_id", "n_shingles", "component_id") == Counter(brute.jaccard(rows, 5, 80))
    assert made["jaccard-candidates"] <= 400 and made["jaccard-shown"] <= 60 * 196 / 2


def test_a_group_just_below_the_threshold_lists_few_candidates(spark, monkeypatch):
    """Of 11,175 pairs of a group whose texts are 83 % alike, hardly any is listed; a few texts of it do link."""
    rng, made = random.Random(13), {}
    words = [f"w{i}" for i in range(200)]
    rows = []
    for i in range(150):
        own = list(words)
        for j in rng.sample(range(200), 3):
            own[j] = f"x{i}_{j}"
        rows.append((i, " ".join(own)))
    rows += [(200 + i, rows[i][1] + " end") for i in range(0, 150, 10)] + [(400, " ".join(words))]
    keep = jaccard_join.Scratch.keep

    def counted(self, df, name):
        out = keep(self, df, name)
        made[name] = made.get(name, 0) + out.count()
        return out

    monkeypatch.setattr(jaccard_join.Scratch, "keep", counted)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = Counter(brute.jaccard(rows, 3, 90))
    assert as_set(jaccard_join.jaccard_components(df, 3, 90), "doc_id", "n_shingles", "component_id") == want
    assert made["jaccard-candidates"] <= 4 * len(rows)
    assert as_set(jaccard_join.jaccard_components(df, 3, 90, part_rows=7), "doc_id", "n_shingles", "component_id") == want
