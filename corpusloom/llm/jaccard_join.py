"""N-gram Jaccard join with vertically partitioned overlap counts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.llm._store import Scratch, materialise
from corpusloom.llm._text import chunks, hash_strings, mix, split_words, texts
from corpusloom.llm.components import components
from corpusloom.operators.parts import BLOCK, shown_parts
from corpusloom.operators.spread import join_spread

#: The order of n-grams is cut into 2**FRAGMENT_BITS fragments.
FRAGMENT_BITS = 3
#: A set's sketch: numbers of 64 bits, each of an equal share of the hashes.
SKETCH_BITS = 3
SKETCH = [f"s{i}" for i in range(1 << SKETCH_BITS)]
#: Bytes of text whose n-grams a task holds at once.
CHUNK = 4 << 20
#: Sets that may be broadcast as a list of three numbers each, 12 MB.
BROADCAST_IDS = 500_000
#: Sets of one part that a task compares with all others of it.
PART_ROWS = 20_000
#: Sets of a large part that one round of links compares with all others of it, and such rounds.
CENTRES, ROUNDS = 8, 2
#: Sets that make a part a large one; pairs within smaller ones are few.
LARGE = 64

_NO_ID = -(1 << 63)


def shingle_sets(values: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and sorted distinct hashes of each text's ``k``-word shingles.

    A text of fewer words is one shingle; one of no word has none.
    """
    offsets, codes, words = split_words(pc.ascii_lower(values))
    n = np.diff(offsets)
    word = hash_strings(words)[codes]
    short = np.minimum(n, k)
    owner = np.repeat(np.arange(len(n)), np.where(n > 0, n - short + 1, 0))
    first = np.concatenate([np.arange(a, b - s + 1) for a, b, s in zip(offsets[:-1].tolist(), offsets[1:].tolist(), short.tolist()) if s] or [np.zeros(0, np.int64)])
    size = short[owner]
    found = word[first] if len(first) else np.zeros(0, np.uint64)
    for i in range(1, k):
        more = size > i
        found = np.where(more, mix(found, word[np.minimum(first + i, len(word) - 1)]), found) if len(found) else found
    ends = np.searchsorted(owner, np.arange(len(n) + 1)).tolist()
    for a, b in zip(ends, ends[1:]):
        found[a:b].sort()
    fresh = np.ones(len(found), bool)
    fresh[1:] = (owner[1:] != owner[:-1]) | (found[1:] != found[:-1])
    owner, found = owner[fresh], found[fresh]
    return np.searchsorted(owner, np.arange(len(n) + 1)), found.view(np.int64)


def _summaries(k: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text", CHUNK):
            offsets, found = shingle_sets(texts(batch, "text"), k)
            ends = offsets.tolist()
            shown = [shown_parts(found[a:b].view(np.uint64), np.ones(b - a, np.int64), percent / 100) for a, b in zip(ends, ends[1:])]
            starts = pa.array(np.concatenate([[0], np.cumsum([len(x[0]) for x in shown])]), pa.int32())
            lists = [pa.ListArray.from_arrays(starts, pa.array(np.concatenate([x[i] for x in shown] or [np.zeros(0, np.int64)]))) for i in (0, 2)]
            sketch = [pa.array(x) for x in np.ascontiguousarray(_sketches(offsets, found).T)]
            columns = [batch.column("doc_id"), batch.column("content"), _set_ids(offsets, found), pa.array(np.diff(offsets).astype(np.int64)), *sketch, *lists]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "content", "set_id", "n", *SKETCH, "parts", "bits"])

    return run


def _sketches(offsets: np.ndarray, found: np.ndarray) -> np.ndarray:
    """Each set's sketch: an n-gram's first bits name a number, the next six turn a bit of it."""
    grams = found.view(np.uint64)
    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    piece = (grams >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)
    turned = np.uint64(1) << (grams >> np.uint64(58 - SKETCH_BITS) & np.uint64(63))
    sketch = np.zeros((len(offsets) - 1, 1 << SKETCH_BITS), np.uint64)
    starts = np.flatnonzero(np.diff(owner << SKETCH_BITS | piece, prepend=-1))
    if len(starts):
        sketch[owner[starts], piece[starts]] = np.bitwise_xor.reduceat(turned, starts)
    return sketch.view(np.int64)


def _set_ids(offsets: np.ndarray, found: np.ndarray) -> pa.Array:
    """A digest of each set, null for empty ones."""
    ends = offsets.tolist()
    ids = [xxhash.xxh3_64_intdigest(found[a:b].tobytes()) if b > a else None for a, b in zip(ends, ends[1:])]
    return pa.array([None if x is None else x - (1 << 64) * (x >> 63) for x in ids], pa.int64())


def _fragments(k: int, bits: int):
    """Each wanted set, cut by its n-grams' first ``bits`` bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text", CHUNK):
            offsets, found = shingle_sets(texts(batch, "text"), k)
            meant = pc.fill_null(pc.equal(_set_ids(offsets, found), batch.column("set_id")), False).to_numpy(zero_copy_only=False)
            n = np.diff(offsets)
            owner = np.repeat(np.arange(len(n)), n)
            keep = meant[owner]  # another text of the same hash isn't meant
            owner, grams = owner[keep], found[keep]
            piece = (grams.view(np.uint64) >> np.uint64(64 - bits)).astype(np.int64)
            starts = np.flatnonzero(np.diff(owner << bits | piece, prepend=-1))
            rows = owner[starts]
            ends = np.append(starts, len(grams)).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(grams))
            ids = batch.column("set_id").take(pa.array(rows))
            yield pa.RecordBatch.from_arrays([ids, pa.array(n[rows].astype(np.int64)), pa.array(piece[starts]), lists], names=["set_id", "n", "fragment", "grams"])

    return run


def _needed(n: Column, m: Column, percent: int) -> Column:
    """The least overlap of linked sets of ``n`` and ``m``: ceil(t (n + m) / (1 + t))."""
    return F.ceil((n + m) * percent / (100 + percent) - F.lit(1e-9))


def _could_link(x: str, y: str, percent: int) -> Column:
    """Whether the sizes and the bits of a shared part's block allow enough overlap."""
    n, m = F.col(f"{x}.n"), F.col(f"{y}.n")
    near = F.bit_count(F.col(f"{x}.bits").bitwiseXOR(F.col(f"{y}.bits"))) < BLOCK
    return near & (n * 100 >= m * percent) & (m * 100 >= n * percent)


def _alike(x: str, y: str, percent: int) -> Column:
    """Whether the sketches differ in no more bits than n-grams that linked sets don't share.

    Only an n-gram that one of the sets lacks can turn a bit of one sketch alone, so
    linked sets differ in at most n + m - 2 ceil(t (n + m) / (1 + t)) bits.
    """
    n, m = F.col(f"{x}.n"), F.col(f"{y}.n")
    differ = sum((F.bit_count(F.col(f"{x}.{c}").bitwiseXOR(F.col(f"{y}.{c}"))) for c in SKETCH[1:]), F.bit_count(F.col(f"{x}.{SKETCH[0]}").bitwiseXOR(F.col(f"{y}.{SKETCH[0]}"))))
    return differ <= n + m - 2 * _needed(n, m, percent)


def _similar_sketches(pairs: DataFrame, members: DataFrame, percent: int) -> DataFrame:
    """``pairs`` (a, b) without those whose sketches differ in too many bits to link."""
    sketches = members.select("set_id", "n", *SKETCH)
    both = pairs.alias("p").join(sketches.alias("x"), F.col("p.a") == F.col("x.set_id")).join(sketches.alias("y"), (F.col("p.b") == F.col("y.set_id")) & _alike("x", "y", percent))
    return both.select("p.a", "p.b")


def _linked(pairs: DataFrame, fragments: DataFrame, percent: int) -> DataFrame:
    """Those of ``pairs`` (a, b) that link: overlaps are counted by fragment and summed."""
    left = fragments.select(F.col("set_id").alias("a"), F.col("n").alias("n_a"), "fragment", F.col("grams").alias("grams_a"))
    right = fragments.select(F.col("set_id").alias("b"), F.col("n").alias("n_b"), "fragment", F.col("grams").alias("grams_b"))
    partial = pairs.join(left, "a").join(right, ["b", "fragment"]).select("a", "b", "n_a", "n_b", F.size(F.array_intersect("grams_a", "grams_b")).cast("long").alias("both"))
    total = partial.groupBy("a", "b", "n_a", "n_b").agg(F.sum("both").alias("both"))
    return total.where(F.col("both") * 100 >= (F.col("n_a") + F.col("n_b") - F.col("both")) * percent).select("a", "b")


def _stars(rows: DataFrame, total: int, percent: int) -> DataFrame:
    """Pairs of each part's chosen set, the largest, with its other sets."""
    chosen = rows.groupBy("part").agg(F.max(F.struct("n", "set_id", "bits")).alias("c"), F.count("*").alias("held"))
    both = join_spread(rows, chosen, "part", "held", total, "set_id").where(F.col("set_id") != F.col("c.set_id"))
    both = both.select(F.struct("n", "set_id", "bits").alias("x"), F.col("c").alias("y")).where(_could_link("x", "y", percent))
    return both.select(F.least("x.set_id", "y.set_id").alias("a"), F.greatest("x.set_id", "y.set_id").alias("b")).distinct()


def _open(rows: DataFrame, total: int) -> DataFrame:
    """``rows`` of parts that sets of several components show, with ``main`` and ``held``: the part's largest set's component, and its number of rows."""
    chosen = rows.groupBy("part").agg(F.max_by("root", F.struct("n", "set_id")).alias("main"), F.count("*").alias("held"), F.min("root").alias("low"), F.max("root").alias("high"))
    return join_spread(rows, chosen.where("low <> high").drop("low", "high"), "part", "held", total, "set_id")


def _could_join(x: str, y: str, percent: int) -> Column:
    return (F.col(f"{x}.root") != F.col(f"{y}.root")) & _could_link(x, y, percent) & _alike(x, y, percent)


def _more_stars(rows: DataFrame, total: int, percent: int, turn: int) -> DataFrame:
    """Pairs of a few sets of each large part, any outside its chosen component, with its sets of other components.

    Components that many links tie are joined by these, so those links needn't be listed.
    """
    own = F.struct("set_id", "root", "n", "bits", *SKETCH)
    centres = [F.min_by(own, F.xxhash64("set_id", F.lit(turn * CENTRES + i))) for i in range(CENTRES)]
    chosen = rows.where("root <> main").groupBy("part").agg(F.array_distinct(F.array(*centres)).alias("c"), F.max("held").alias("held"))
    chosen = chosen.select("part", "held", F.explode("c").alias("y"))
    both = join_spread(rows.select("part", F.col("set_id").alias("by"), own.alias("x")), chosen, "part", "held", total, "by").where(_could_join("x", "y", percent))
    return both.select(F.least("x.set_id", "y.set_id").alias("a"), F.greatest("x.set_id", "y.set_id").alias("b")).distinct()


def _rest(rows: DataFrame, percent: int, part_rows: int) -> DataFrame:
    """All pairs that share a part, are of different components and have sketches near enough to link.

    One side are sets outside the part's chosen component, so the sets that already
    form one aren't paired with each other. Sketches are compared where the two meet: of
    a large group just below the threshold no pairs are listed but those that pass. A
    part's outside sets are dealt to tasks by ``part_rows``, its others repeated for each.
    """
    cuts = F.ceil(F.col("held") / part_rows).cast("long")
    columns = ["part", "set_id", "root", "main", "n", "bits", *SKETCH]
    outside = rows.where("root <> main").select(*columns, F.pmod(F.xxhash64("set_id"), cuts).alias("cut"))
    others = rows.select(*columns, F.explode(F.sequence(F.lit(0).cast("long"), cuts - 1)).alias("cut"))
    once = (F.col("y.root") == F.col("y.main")) | (F.col("x.set_id") < F.col("y.set_id"))
    pair = outside.alias("x").join(others.alias("y"), (F.col("x.part") == F.col("y.part")) & (F.col("x.cut") == F.col("y.cut")) & once & _could_join("x", "y", percent))
    return pair.select(F.least("x.set_id", "y.set_id").alias("a"), F.greatest("x.set_id", "y.set_id").alias("b")).distinct()


def jaccard_components(docs: DataFrame, k: int = 5, percent: int = 80, fragment_bits: int = FRAGMENT_BITS, broadcast_ids: int = BROADCAST_IDS, part_rows: int = PART_ROWS) -> DataFrame:
    """(doc_id, content, n_shingles, root, component_id) for each row of ``docs`` (doc_id, text).

    Two rows link when 100 times the intersection of their sets of ``k``-word shingles
    is at least ``percent`` times the union; component_id is the smallest doc_id that
    links reach, ``root`` a number of the component, and ``content`` a hash of the text. Equal sets are one class from the start. Then:

    1. Each class cuts its set at the same places into more parts than linked sets may
       differ in, and shows those that one of them must be equal in (operators/parts.py).
       Parts that no other class shows are done with, so shared passages alone seldom go
       further: all of a part has to lie in them.
    2. Sizes, the bits of a shared part's block and the sets' sketches, one bit of
       parity for several n-grams, rule out most pairs before they are listed.
    3. Candidate pairs are verified exactly: the order of n-grams is cut into
       2**fragment_bits fragments, a pair's overlap is counted in each apart, and the counts summed.
       Pairs aren't listed within a group: every part first links its sets to one of
       them, large ones twice link those of different components to a few more, and then
       only pairs of components that are still different are listed. So no link between
       components is lost.

    A null or empty text has no shingle and is a component of its own. Rows of one
    doc_id are apart; a row that has no id in a component without any gets null.
    Other columns are ignored.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    scratch = Scratch(docs.sparkSession)
    rows = rows.withColumn("content", F.xxhash64(F.coalesce("text", F.lit("")))).withColumn("id", F.coalesce("doc_id", F.lit(_NO_ID)))
    held = Scratch(docs.sparkSession)
    about = held.keep(rows.mapInArrow(_summaries(k, percent), f"doc_id long, content long, set_id long, n long, {', '.join(f'{c} long' for c in SKETCH)}, parts array<long>, bits array<long>"), "jaccard-parts")
    sets = about.where("n > 0")
    least = F.min(F.struct(F.coalesce("doc_id", F.lit(_NO_ID)).alias("id"), F.col("content"), F.struct("parts", "bits").alias("shown"))).alias("m")
    classes = sets.groupBy("set_id", "n").agg(least)
    shown = classes.select("set_id", "n", F.explode(F.arrays_zip("m.shown.parts", "m.shown.bits")).alias("p")).select("set_id", "n", F.col("p.parts").alias("part"), F.col("p.bits").alias("bits"))
    shown = scratch.keep(shown.withColumn("held", F.count("*").over(Window.partitionBy("part"))).where("held > 1"), "jaccard-shown")
    members = sets.groupBy("set_id", "n").agg(F.min(F.struct(F.coalesce("doc_id", F.lit(_NO_ID)).alias("id"), "content", *SKETCH)).alias("m")).select("set_id", "n", "m.*")
    members = scratch.keep(members, "jaccard-members")
    about = materialise(about.drop("parts", "bits", *SKETCH), "jaccard-sets")
    held.discard()
    total = shown.count()

    def found(pairs: DataFrame) -> DataFrame:
        pairs = scratch.keep(pairs, "jaccard-candidates")
        near = scratch.keep(members.select("set_id", "id", "content").join(pairs.select(F.explode(F.array("a", "b")).alias("set_id")).distinct(), "set_id"), "jaccard-near")
        picked = rows.select("id", "content", "text").join(F.broadcast(near) if near.count() <= broadcast_ids else near, ["id", "content"]).select("set_id", "text")
        parts = picked.mapInArrow(_fragments(k, fragment_bits), "set_id long, n long, fragment long, grams array<long>")
        parts = scratch.keep(parts, "jaccard-fragments")
        if not parts.groupBy("set_id", "fragment").count().where("count > 1").isEmpty():  # rows of one id and text
            parts = scratch.keep(parts.dropDuplicates(["set_id", "fragment"]), "jaccard-fragments")
        return scratch.keep(_linked(pairs, parts, percent), "jaccard-links")

    links = found(_similar_sketches(_stars(shown.drop("held"), total, percent), members, percent))
    roots = components(links)

    def rooted(rows: DataFrame) -> DataFrame:
        return _open(rows.join(roots.withColumnRenamed("node", "set_id"), "set_id", "left").withColumn("root", F.coalesce("root", "set_id")), total)

    sketches = members.select("set_id", *SKETCH)
    large = shown.where(F.col("held") >= LARGE).drop("held")
    for turn in range(ROUNDS):
        opened = scratch.keep(rooted(large) if turn else rooted(large).join(sketches, "set_id"), "jaccard-open")
        if opened.isEmpty():
            break
        links = found(_more_stars(opened, total, percent, turn))
        if not links.isEmpty():
            roots = components(links.union(roots.select("node", "root")))
        large = opened.drop("root", "main", "held")
    links = found(_rest(rooted(shown.drop("held")).join(sketches, "set_id"), percent, part_rows))
    if not links.isEmpty():
        roots = components(links.union(roots.select("node", "root")))
    scratch.discard()
    joined = about.join(roots.withColumnRenamed("node", "set_id"), "set_id", "left").withColumn("root", F.coalesce("root", "set_id"))
    worded = joined.where("n > 0")
    least = worded.groupBy("root").agg(F.min("doc_id").alias("least"), F.count("*").alias("held"))
    columns = ["doc_id", "content", F.col("n").alias("n_shingles"), "root"]
    told = join_spread(worded.withColumn("by", F.xxhash64("doc_id", "content")), least, "root", "held", about.count(), "by").select(*columns, F.col("least").alias("component_id"))
    return told.union(joined.where("n = 0").select(*columns, F.col("doc_id").alias("component_id")))


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet"), k=3, percent=90)
    return found.select("doc_id", "n_shingles", "component_id")
