"""The prefix trie of conversations: owned chains found by binary search, aggregated bottom-up."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Mapping

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.llm._store import Scratch, materialise
from corpusloom.operators.spread import join_spread

#: Places of a conversation that one window holds; longer ones are summed by blocks.
BLOCK = 1024
#: Characters of a list of ids that one row holds.
PIECE = 4096

_NODE = "conv_id long, depth int, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"


def number_turns(turns: DataFrame, scratch: Scratch) -> DataFrame:
    """(conv_id, place, n, a, b, length) for each row of ``turns`` (conv_id, turn, role, text).

    ``place`` counts a conversation's turns from 1 in the order of turn (null first, then
    role, then a digest of the text), and ``n`` says how many it has; (a, b) is a digest of
    role and text, and ``length`` the text's code points. A null role or text is empty,
    and rows without a conv_id are left out.

    Rows are dealt by ranges of the whole order, so a long conversation lies in many
    tasks; each counts its rows, and the counts of earlier ones are added. Texts
    aren't shuffled.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    rows = turns.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), F.xxhash64(role, text).alias("a"),
        F.xxhash64(F.lit("second"), text, role).alias("b"), F.length(text).cast("long").alias("length"),
    )
    order = ["conv_id", F.asc_nulls_first("turn"), "role", "a", "b"]
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("seen", F.monotonically_increasing_id())
    part, at = F.shiftright("seen", 33).alias("part"), F.col("seen").bitwiseAND((1 << 33) - 1).alias("at")
    sorted_rows = Scratch(turns.sparkSession)
    dealt = sorted_rows.keep(dealt.select("conv_id", part, at, "a", "b", "length"), "trie-turns")
    parts = dealt.groupBy("conv_id", "part").agg(F.min("at").alias("first"), F.count("*").alias("held"))
    own = Window.partitionBy("conv_id")
    before = F.coalesce(F.sum("held").over(own.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select("conv_id", "part", (before - F.col("first") + 1).alias("shift"), F.sum("held").over(own).alias("n"))
    found = dealt.join(parts, ["conv_id", "part"]).select("conv_id", (F.col("at") + F.col("shift")).alias("place"), "n", "a", "b", "length")
    found = scratch.keep(found, "trie-numbered")
    sorted_rows.discard()
    return found


def graft(numbered: DataFrame, base: Column, borrowed: Column, most: int, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Conversations whose first turns are another one's: (conv_id, n) and (conv_id, depth, n, a, b, length).

    Conversation c gets the first ``borrowed`` (a column of conv_id, ``most`` at the most)
    turns of conversation ``base``, all of them if it has fewer and none if it's absent,
    and then its own after as many.
    """
    convs = numbered.where("place = 1").select("conv_id", F.col("n").alias("own_n"), base.alias("base"), borrowed.cast("long").alias("h"))
    others = numbered.where("place = 1").select(F.col("conv_id").alias("base"), F.col("n").alias("base_n"))
    got = F.least("h", F.coalesce("base_n", F.lit(0)))
    convs = convs.join(others, "base", "left").withColumn("got", got)
    convs = scratch.keep(convs.withColumn("n", F.col("got") + F.greatest(F.col("own_n") - F.col("h"), F.lit(0))).drop("base_n"), "trie-conversations")
    first = numbered.where(F.col("place") <= most).select(F.col("conv_id").alias("base"), F.col("place").alias("depth"), "a", "b", "length")
    lent = convs.join(first, "base").where(F.col("depth") <= F.col("h")).select("conv_id", "depth", "n", "a", "b", "length")
    own = numbered.drop("n").withColumn("h", borrowed.cast("long")).where(F.col("place") > F.col("h"))
    own = join_spread(own, convs.select("conv_id", "got", "n", "own_n"), "conv_id", "own_n", numbered.count(), "place")
    own = own.select("conv_id", (F.col("place") - F.col("h") + F.col("got")).alias("depth"), "n", "a", "b", "length")
    return convs.select("conv_id", "n"), lent.union(own)


def running(rows: DataFrame, key: str, place: str, how: Mapping[str, str], scratch: Scratch, name: str, back: bool = False, block: int = BLOCK) -> DataFrame:
    """``rows`` with columns of ``how`` summed ("sum") or xored ("xor") up to each place of its key, or from it on (``back``).

    Places are distinct whole numbers without gaps. A window holds a block of places;
    totals of a key's whole blocks, one number for ``block`` rows, are then summed in
    another and added, so a key with many rows is dealt to many tasks.
    """
    total = {"sum": F.sum, "xor": F.bit_xor}
    both = {"sum": lambda x, y: x + y, "xor": lambda x, y: x.bitwiseXOR(y)}
    ordered = lambda w, c: w.orderBy(F.desc(c) if back else F.asc(c)).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    own = rows.withColumn("_block", F.floor(F.col(place) / block))
    inside = ordered(Window.partitionBy(key, "_block"), place)
    own = scratch.keep(own.withColumns({c: total[x](c).over(inside) for c, x in how.items()}), name)
    if (own.agg(F.max("_block")).first()[0] or 0) < 1:
        return own.drop("_block")
    whole = own.where(F.col(place) % block == 0).where("_block > 0") if back else own.where(F.col(place) % block == block - 1)
    over = ordered(Window.partitionBy(key), "_block")
    before = whole.select(key, (F.col("_block") + (-1 if back else 1)).alias("_block"), *(total[x](c).over(over).alias(f"_{c}") for c, x in how.items()))
    found = own.join(before, [key, "_block"], "left")
    return found.withColumns({c: F.coalesce(both[x](F.col(c), F.col(f"_{c}")), c) for c, x in how.items()}).drop("_block", *(f"_{c}" for c in how))


def first_owned(convs: DataFrame, prefixes: DataFrame, nodes: DataFrame, root: int, longest: int, scratch: Scratch) -> DataFrame:
    """(conv_id, n, depth, above, cum): from which depth on a conversation is its prefix's smallest member.

    A conversation that owns a prefix owns all longer ones of its own, so the depth is
    found by halving: every round joins each open conversation's prefix at its middle
    depth with the prefixes' smallest members. The depth is n + 1 if it owns none.
    ``above`` owns the prefix before, whose texts have ``cum`` code points. The root's
    owner begins at depth 0. Conversations of one prefix, as many as there may be, are
    dealt to many tasks.
    """
    state = convs.select("conv_id", "n", F.lit(1).cast("long").alias("lo"), (F.col("n") + 1).alias("hi"), F.lit(root).cast("long").alias("above"), F.lit(0).cast("long").alias("cum"))
    state, n_convs, closed = scratch.keep(state, "trie-search"), convs.count(), []
    for _ in range(longest.bit_length()):
        closed.append(state.where("lo >= hi"))
        probes = state.where("lo < hi").withColumn("depth", F.floor((F.col("lo") + F.col("hi")) / 2))
        at = prefixes.select("conv_id", "depth", F.struct("depth", "p", "q").alias("prefix"), F.col("cum").alias("cum_here"))
        probes = scratch.keep(probes.join(at, ["conv_id", "depth"]), "trie-probes")
        held = probes.groupBy("prefix").agg(F.count("*").alias("held"))
        least = nodes.select(F.struct("depth", "p", "q").alias("prefix"), "owner").join(held, "prefix")
        told = join_spread(probes, least, "prefix", "held", n_convs, "conv_id")
        owned = F.col("owner") == F.col("conv_id")
        state = scratch.keep(told.select(
            "conv_id", "n", F.when(owned, F.col("lo")).otherwise(F.col("depth") + 1).alias("lo"), F.when(owned, F.col("depth")).otherwise(F.col("hi")).alias("hi"),
            F.when(owned, F.col("above")).otherwise(F.col("owner")).alias("above"), F.when(owned, F.col("cum")).otherwise(F.col("cum_here")).alias("cum"),
        ), "trie-search")
    found = state
    for part in closed:
        found = found.union(part)
    top = F.col("conv_id") == root
    found = found.select("conv_id", "n", F.when(top, 0).otherwise(F.col("lo")).alias("depth"), F.when(~top, F.col("above")).alias("above"), "cum")
    return scratch.keep(found, "trie-owned")


def chain_tops(owned: DataFrame, scratch: Scratch) -> DataFrame:
    """(conv_id, above, at, cum, weight, leaves, saved) of each chain's first node, from the innermost chains outwards.

    A chain are the nodes that a conversation owns; it hangs on node (above, at). Its
    members are its own conversation, those that end in it without owning a node, and
    the members of chains that hang on it. Each round takes chains on which no open one
    hangs and adds them to those they hang on; there are as many as chains lie in each other.
    Of a member that leaves the chain where texts have P code points, all from the chain's
    first node to there are saved once: so sums of weight * P + saved suffice.
    """
    ends = owned.where("depth > n").groupBy(F.col("above").alias("conv_id")).agg(F.count("*").alias("w"), F.sum("cum").alias("s"))
    chains = owned.where("depth <= n")
    inner = chains.where("above IS NOT NULL").groupBy(F.col("above").alias("conv_id")).agg(F.count("*").alias("open"))
    zero = lambda c, x=0: F.coalesce(c, F.lit(x)).cast("long").alias(c)
    pending = chains.join(ends, "conv_id", "left").join(inner, "conv_id", "left")
    pending = pending.select("conv_id", "n", "above", (F.col("depth") - 1).alias("at"), "cum", zero("w"), zero("s"), zero("open"), F.lit(0).cast("long").alias("leaves"), F.lit(-1).cast("long").alias("last"))
    pending, done = scratch.keep(pending, "trie-chains"), None
    while not pending.isEmpty():
        saved = F.col("s") - F.col("cum") * F.col("w")
        tops = pending.where("open = 0").select(
            "conv_id", "above", "at", "cum", (F.col("w") + 1).alias("weight"), (F.col("leaves") + F.when(F.col("last") < F.col("n"), 1).otherwise(0)).alias("leaves"), saved.alias("saved")
        )
        done = tops if done is None else done.union(tops)
        added = tops.where("above IS NOT NULL").groupBy(F.col("above").alias("conv_id")).agg(
            F.sum("weight").alias("w2"), F.sum(F.col("weight") * F.col("cum") + F.col("saved")).alias("s2"), F.count("*").alias("open2"), F.sum("leaves").alias("leaves2"), F.max("at").alias("last2"),
        )
        more = lambda c: (F.col(c) + F.coalesce(f"{c}2", F.lit(0))).alias(c)
        rest = pending.where("open > 0").join(added, "conv_id", "left")
        rest = rest.select("conv_id", "n", "above", "at", "cum", more("w"), more("s"), (F.col("open") - F.coalesce("open2", F.lit(0))).alias("open"), more("leaves"), F.greatest("last", F.coalesce("last2", F.lit(-1))).alias("last"))
        pending = scratch.keep(rest, "trie-chains")
    return done


def _packed(piece: int):
    """Sorted rows (owner, depth, conv_id): ids of a node joined by commas, in rows of about ``piece`` characters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, node, size = [], None, 0
            for owner, depth, conv_id in zip(*(batch.column(c).to_pylist() for c in ("owner", "depth", "conv_id"))):
                if (owner, depth) != node or size >= piece:
                    node, size = (owner, depth), 0
                    out.append((owner, depth, conv_id, []))
                out[-1][3].append(str(conv_id))
                size += len(out[-1][3][-1]) + 1
            columns = [pa.array([r[i] for r in out], pa.int64()) for i in range(3)] + [pa.array([",".join(r[3]) for r in out], pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=["owner", "depth", "first", "ids"])

    return run


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A node's sorted pieces, one after another, into one SHA-256."""
    node, digest = None, None
    row = lambda: pa.RecordBatch.from_arrays([pa.array([node[0]], pa.int64()), pa.array([node[1]], pa.int64()), pa.array([digest.hexdigest()])], names=["owner", "depth", "ends_sha256"])
    for batch in batches:
        done = []
        for owner, depth, ids in zip(*(batch.column(c).to_pylist() for c in ("owner", "depth", "ids"))):
            if (owner, depth) == node:
                digest.update(b",")
            else:
                if node:
                    done.append(row())
                node, digest = (owner, depth), hashlib.sha256()
            digest.update(ids.encode())
        if done:
            yield pa.Table.from_batches(done).combine_chunks().to_batches()[0]
    if node:
        yield row()


def end_digests(owned: DataFrame, piece: int = PIECE) -> DataFrame:
    """(owner, depth, ends_sha256) of nodes at which conversations end.

    A digest runs over the ids of a node in order, so the last step has a node's list in
    one task, as text in rows of ``piece`` characters, of which a batch is held at a
    time; ids are sorted and joined before that in tasks of equal shares.
    """
    owner = F.when(F.col("depth") <= F.col("n"), F.col("conv_id")).otherwise(F.col("above"))
    ends = owned.select(owner.alias("owner"), F.col("n").alias("depth"), "conv_id")
    order = ["owner", "depth", "conv_id"]
    pieces = ends.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_packed(piece), "owner long, depth long, first long, ids string")
    return pieces.repartition("owner", "depth").sortWithinPartitions("owner", "depth", "first").mapInArrow(_hashed, "owner long, depth long, ends_sha256 string")


def conversation_trie(turns: DataFrame, base: Column | None = None, borrowed: Column | None = None, most: int = 0, block: int = BLOCK, piece: int = PIECE) -> DataFrame:
    """The trie of all prefixes of conversations, a row for each node.

    ``turns``: (conv_id, turn, role, text), in the order of number_turns. With ``base`` and
    ``borrowed``, columns of conv_id, conversations are rebuilt first (graft). A node is a
    distinct sequence of first turns (role, text), equal by a digest of 128 bits and its
    depth; conv_id is its smallest member, so (conv_id, depth) names it. n_convs counts
    members, n_children nodes one turn longer, n_leaves childless nodes from it on,
    saved_tokens sums (n_convs - 1) times the code points of the last text from it on, and
    ends_sha256 is of the decimal ids of the members that end there, by comma.

    A null role or text is empty; rows without a conv_id are left out, repeated rows are
    turns of their own, other columns are ignored, and an empty table has no node. A
    conversation of very many turns, a prefix of very many conversations and a chain on
    which very many hang are each dealt to many tasks.
    """
    spark = turns.sparkSession
    scratch = Scratch(spark)
    numbered = number_turns(turns, scratch)
    if base is None:
        convs, rows = numbered.where("place = 1").select("conv_id", "n"), numbered.withColumnRenamed("place", "depth")
    else:
        convs, rows = graft(numbered, base, borrowed, most, scratch)
    root, longest = convs.agg(F.min("conv_id"), F.max("n")).first()
    if root is None:
        scratch.discard()
        return spark.createDataFrame([], _NODE)
    rows = rows.select("conv_id", "depth", "n", F.xxhash64("depth", "a", "b").alias("p"), F.xxhash64("b", "depth", "a").alias("q"), "length", F.col("length").alias("cum"))
    prefixes = running(rows, "conv_id", "depth", {"p": "xor", "q": "xor", "cum": "sum"}, scratch, "trie-prefixes", block=block)
    nodes = prefixes.groupBy("depth", "p", "q").agg(F.min(F.struct("conv_id", "n")).alias("m"), F.first("length").alias("length"), F.first("cum").alias("cum"))
    nodes = scratch.keep(nodes.select("depth", "p", "q", F.col("m.conv_id").alias("owner"), F.col("m.n").alias("n"), "length", "cum"), "trie-nodes")
    owned = first_owned(convs, prefixes, nodes, root, longest, scratch)
    tops = chain_tops(owned, scratch)
    none = F.lit(None).cast("long").alias("above")
    hung = tops.where("above IS NOT NULL").select(F.col("above").alias("owner"), F.col("at").alias("depth"), F.col("weight").alias("w"), (F.col("weight") * F.col("cum") + F.col("saved")).alias("s"), "leaves", F.lit(1).alias("chains"), none)
    ends = owned.where("depth > n").select(F.col("above").alias("owner"), F.col("n").alias("depth"), F.lit(1), "cum", F.lit(0), F.lit(0), none)
    begun = owned.where("depth <= n").select(F.col("conv_id").alias("owner"), "depth", F.lit(0), F.lit(0), F.lit(0), F.lit(0), "above")
    sums = [F.sum(c).alias(c) for c in ("w", "s", "leaves", "chains")]
    there = hung.union(ends).union(begun).groupBy("owner", "depth").agg(*sums, F.max("above").alias("above"))
    top = owned.where("depth = 0").select(F.col("conv_id").alias("owner"), F.col("depth").cast("long").alias("depth"), "n", F.lit(0).alias("length"), F.lit(0).alias("cum"))
    every = nodes.select("owner", "depth", "n", "length", "cum").union(top)
    joined = every.join(there, ["owner", "depth"], "left").join(end_digests(owned, piece), ["owner", "depth"], "left").fillna(0, ["w", "s", "leaves", "chains"])
    last = F.col("depth") == F.col("n")
    joined = joined.withColumn("leaves", F.col("leaves") + F.when(last & (F.col("chains") == 0), 1).otherwise(0))
    summed = running(joined, "owner", "depth", {"w": "sum", "s": "sum", "leaves": "sum"}, scratch, "trie-summed", back=True, block=block)
    parent = F.when(F.col("depth") > 0, F.coalesce("above", "owner"))
    found = summed.select(
        F.col("owner").alias("conv_id"), F.col("depth").cast("int").alias("depth"), parent.alias("parent_conv_id"), (F.col("w") + 1).alias("n_convs"), (F.col("chains") + F.when(last, 0).otherwise(1)).alias("n_children"),
        F.col("leaves").alias("n_leaves"), (F.col("s") - (F.col("cum") - F.col("length")) * F.col("w")).alias("saved_tokens"), F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"),
    )
    found = materialise(found, "trie")
    scratch.discard()
    return found


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation c takes its first crc32(c) % 6 turns from conversation c - c % 100."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    borrowed = F.crc32(F.col("conv_id").cast("string").cast("binary")) % 6
    return conversation_trie(turns, F.col("conv_id") - F.col("conv_id") % 100, borrowed, 5)


#: The same rows by prefixes as texts. Turns of equal number are ordered by role and text.
SQL = r"""
WITH crc_table AS (
    SELECT list(list_reduce([CAST(i AS BIGINT)] || list_transform(range(8), lambda k: CAST(k AS BIGINT)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) ORDER BY i) AS t FROM range(256) r(i)
), numbered AS (
    SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS place,
        coalesce(role, '') AS role, coalesce(text, '') AS text
    FROM conversations WHERE conv_id IS NOT NULL
), convs AS (
    SELECT conv_id, conv_id - conv_id % 100 AS base, xor(list_reduce([4294967295] || list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: CAST(ord(x) AS BIGINT)),
        lambda c, b: xor(c // 256, t[xor(c, b) % 256 + 1])), 4294967295) % 6 AS h
    FROM (SELECT DISTINCT conv_id FROM numbered), crc_table
), turns AS (
    SELECT convs.conv_id, 0 AS own, place, role, text FROM convs JOIN numbered ON numbered.conv_id = convs.base AND place <= h
    UNION ALL SELECT conv_id, 1, place, role, text FROM convs JOIN numbered USING (conv_id) WHERE place > h
), rebuilt AS (
    SELECT convs.conv_id, list(sha256(to_json([role, text])) ORDER BY own, place) FILTER (place IS NOT NULL) AS marks, list(length(text) ORDER BY own, place) FILTER (place IS NOT NULL) AS sizes
    FROM convs LEFT JOIN turns USING (conv_id) GROUP BY convs.conv_id
), held AS (
    SELECT conv_id, coalesce(len(marks), 0) AS n, marks, sizes FROM rebuilt
), prefixes AS (
    SELECT conv_id, n, d, CASE WHEN d = 0 THEN '' ELSE array_to_string(marks[1:d], ' ') END AS p, CASE WHEN d > 0 THEN CASE WHEN d = 1 THEN '' ELSE array_to_string(marks[1:d - 1], ' ') END END AS above,
        CASE WHEN d = 0 THEN 0 ELSE sizes[d] END AS size
    FROM held, LATERAL (SELECT unnest(range(n + 1)) AS d)
), nodes AS (
    SELECT p, any_value(above) AS above, any_value(d) AS depth, any_value(size) AS size, min(conv_id) AS conv_id, count(*) AS n_convs,
        coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (n = d), '') AS ends
    FROM prefixes GROUP BY p
), children AS (
    SELECT above AS p, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY above
), full_nodes AS (
    SELECT nodes.*, coalesce(n_children, 0) AS n_children FROM nodes LEFT JOIN children USING (p)
), below AS (
    SELECT x.p, sum((f.n_children = 0)::INT) AS n_leaves, sum((f.n_convs - 1) * f.size) AS saved_tokens
    FROM full_nodes f JOIN prefixes x ON x.conv_id = f.conv_id AND x.d <= f.depth GROUP BY x.p
)
SELECT f.conv_id, CAST(f.depth AS INT) AS depth, a.conv_id AS parent_conv_id, f.n_convs, f.n_children, CAST(n_leaves AS BIGINT) AS n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens, sha256(f.ends) AS ends_sha256
FROM full_nodes f JOIN below USING (p) LEFT JOIN nodes a ON a.p = f.above
"""
