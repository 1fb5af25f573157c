"""Prefix trie of conversations by leaf-peeling message passing.

A node is a distinct sequence of first turns. A sequence is told apart by sums of hashes of (place, role, text), so the sums up to
each turn are prefix sums: built-in window sums over stretches of a conversation, shifted by the stretches before. Nodes are
then one aggregate over all turns, and every node has a name from then on: the smallest conversation that goes through it
and its depth.

Subtree totals are passed from the leaves up. Nodes that have one child and hand their name on to it form chains with the node that
ends them, and a chain is one station: it holds a counter of children that haven't reported. Each round the stations
whose counter is 0 send their totals to the node above, sums of messages are made before they meet, and the counters go
down, until only the root's station is left and finishes. Rounds are as many as branchings lie above each other, not as
turns. Totals inside a chain are differences of prefix sums.

No task holds a conversation, a node's members or its children: turns are numbered in stored range partitions, long
conversations are cut into stretches, lookups of parents with very many children are broadcast (1,000 of them at most, by
their share of all nodes), and the digests of members are fed from blobs of bounded size.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.ordering import ranged
from .common import drop_stored, small_batches, stored

#: Turns of a stretch: what one window holds of a conversation.
STRETCH = 4096
#: A parent is hot when it has more than this share of all nodes as children; there are fewer than 1 / HOT of them.
HOT = 1e-3
#: Conversation ids in a blob.
BLOB = 8192

SUMS = [f"s{i}" for i in range(4)]
KEY = ["depth", *SUMS]


def _prefix_sums(df: DataFrame, key: str, at: str, sums: dict[str, Column]) -> DataFrame:
    """df with one sum for each name over the rows of the key up to and including this one, by `at`, which is unique within the key."""
    cut = df.withColumns({"cell_": (F.col(at) / STRETCH).cast("long"), **{f"{n}_v": c for n, c in sums.items()}})
    inside = Window.partitionBy(key, "cell_").orderBy(at).rowsBetween(Window.unboundedPreceding, 0)
    local = cut.withColumns({n: F.sum(f"{n}_v").over(inside) for n in sums}).drop(*[f"{n}_v" for n in sums])
    # only conversations of more than one stretch have something to carry
    totals = cut.groupBy(key, "cell_").agg(*[F.sum(f"{n}_v").alias(f"{n}_c") for n in sums], F.count(F.lit(1)).alias("rows_"))
    before = Window.partitionBy(key).orderBy("cell_").rowsBetween(Window.unboundedPreceding, -1)
    carry = totals.select(key, "cell_", *[F.sum(f"{n}_c").over(before).alias(f"{n}_c") for n in sums]).where(F.col("cell_") > 0)
    out = local.join(carry, [key, "cell_"], "left")
    return out.withColumns({n: F.col(n) + F.coalesce(F.col(f"{n}_c"), F.lit(0)) for n in sums}).drop("cell_", *[f"{n}_c" for n in sums])


def rebuilt(conversations: DataFrame, heads: Column, donor: Column, most: int) -> tuple[DataFrame, DataFrame]:
    """Conversations whose first turns come from another one: turns (conv, depth, length, size, digest) and conversations (conv, length).

    `heads` and `donor` are expressions of conv: how many turns are taken from, and from which conversation; heads is at most
    `most`. A conversation keeps its own turns after its first `heads`. Turns go by turn, nulls first, ties by role and then by the
    digest of role and text; rows said twice are two turns."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    digest = F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256)
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv"), "turn", role.alias("role"), F.octet_length(text).cast("long").alias("size"), digest.alias("digest")).where("conv is not null")
    held = ranged(rows.withColumn("tie", F.monotonically_increasing_id()), [F.asc("conv"), F.asc_nulls_first("turn"), F.asc("role"), F.asc("digest"), F.asc("tie")])
    # a row for each conversation and range that meet
    parts = held.groupBy("pid_", "conv").agg(F.count(F.lit(1)).alias("n"), F.min("ln_").alias("start"))
    parts = parts.withColumn("before", F.sum("n").over(Window.partitionBy("conv").orderBy("pid_")) - F.col("n"))
    counts = parts.groupBy("conv").agg(F.sum("n").alias("turns")).withColumns({"heads": heads.cast("long"), "donor": donor.cast("long")})
    given = counts.select(F.col("conv").alias("donor"), F.col("turns").alias("has"))
    taken = F.least("heads", F.coalesce("has", F.lit(0)))
    convs = stored(counts.join(given, "donor", "left").select("conv", "donor", "heads", taken.alias("taken"), (taken + F.greatest(F.col("turns") - F.col("heads"), F.lit(0))).alias("length")), "conversations")
    placed = held.join(parts.join(convs, "conv"), ["pid_", "conv"]).withColumn("place", F.col("before") + F.col("ln_") - F.col("start") + 1)
    own = placed.where("place > heads").select("conv", (F.col("taken") + F.col("place") - F.col("heads")).alias("depth"), "length", "size", "digest")
    lent = placed.where(F.col("place") <= most).select(F.col("conv").alias("donor"), F.col("place").alias("depth"), "size", "digest")
    return own.unionByName(convs.drop("taken").join(lent, "donor").where("depth <= heads").select("conv", "depth", "length", "size", "digest")), convs.select("conv", "length")


def _named(nodes: DataFrame) -> DataFrame:
    """Nodes with n_children and `parent` (the smallest conversation of the parent, null for the root)."""
    above = [(F.col("depth") - 1).alias("depth"), *[F.col(f"p{i}").alias(s) for i, s in enumerate(SUMS)]]
    children = nodes.where("depth > 0").select(*above).groupBy(*KEY).agg(F.count(F.lit(1)).alias("n_children"))
    counted = stored(nodes.join(children, KEY, "left").fillna(0, ["n_children"]), "counted-nodes")
    limit = int(counted.count() * HOT)
    parents = counted.where("n_children > 0").select(F.col("depth").alias("up_"), *[F.col(s).alias(f"p{i}") for i, s in enumerate(SUMS)], F.col("conv_id").alias("parent"), "n_children")
    on = ["up_", *[f"p{i}" for i in range(len(SUMS))]]
    asked = counted.withColumn("up_", F.col("depth") - 1)
    met = asked.join(F.broadcast(parents.where(F.col("n_children") > limit).drop("n_children")), on, "left")
    rest = met.where("parent is null and depth > 0").drop("parent").join(parents.where(F.col("n_children") <= limit).drop("n_children"), on)
    return met.where("parent is not null or depth = 0").unionByName(rest).drop("up_")


def _blobs(size: int):
    """Sorted rows (key, conv) as rows (key, part, serial, blob) of at most so many ids each."""

    def blobs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        part, serial, key, ids, out = TaskContext.get().partitionId(), 0, None, [], []
        names = [*KEY, "part", "serial", "blob"]

        def close():
            nonlocal serial
            serial += 1
            out.append((*key, part, serial, ",".join(ids)))

        for batch in batches:
            for *this, conv in batch.itertuples(index=False, name=None):
                if ids and (this != key or len(ids) >= size):
                    close()
                    ids = []
                key = this
                ids.append(str(conv))
            if out:
                yield pd.DataFrame(out, columns=names)
                out = []
        if ids:
            close()
            yield pd.DataFrame(out, columns=names)

    return blobs


def _hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One SHA-256 for each key over its blobs in order, joined by commas."""
    key, digest, names = None, None, [*KEY, "ends_sha256"]
    for batch in batches:
        out = []
        for *this, blob in batch.itertuples(index=False, name=None):
            if this != key:
                if key is not None:
                    out.append((*key, digest.hexdigest()))
                key, digest = this, hashlib.sha256()
            else:
                digest.update(b",")
            digest.update(blob.encode())
        if out:
            yield pd.DataFrame(out, columns=names)
    if key is not None:
        yield pd.DataFrame([(*key, digest.hexdigest())], columns=names)


def _ends(rows: DataFrame) -> DataFrame:
    """(key, ends_sha256) of (key, conv): the digest of the conversations that end in a node, numerically ascending."""
    longs = ", ".join(f"{c} long" for c in KEY)
    order = [*KEY, "conv"]
    blobs = rows.select(*order).repartitionByRange(*order).sortWithinPartitions(*order).mapInPandas(_blobs(BLOB), f"{longs}, part int, serial int, blob string")
    fed = blobs.repartition(*KEY).sortWithinPartitions(*KEY, "part", "serial").select(*KEY, "blob")
    with small_batches(rows.sparkSession):  # a blob may hold a hundred kilobytes
        return stored(fed.mapInPandas(_hashed, f"{longs}, ends_sha256 string"), "ends")


def peeled(stations: DataFrame, *, most_rounds: int | None = None) -> DataFrame:
    """stations (conv_id, end, parent, up, left, leaves, saved, weight, ...) with leaves and saved of all that hangs below them.

    `left` counts the children that have yet to report, (parent, up) names the station above by (conv_id, end). A station
    with left = 0 sends leaves and saved + weight. The loop ends when none waits; each round's stations are
    stored, and only those that still wait are read again."""
    waiting, done, rounds = stored(stations, "stations"), [], 0
    while True:
        ready, open_ = waiting.where("left = 0"), waiting.where("left > 0")
        done.append(ready)
        if open_.isEmpty():
            return reduce(DataFrame.unionByName, done)
        rounds += 1
        if ready.isEmpty() or (most_rounds and rounds > most_rounds):
            raise RuntimeError(f"stations wait for children that don't report, in round {rounds}")
        sent = ready.where("parent is not null").groupBy(F.col("parent").alias("conv_id"), F.col("up").alias("end")).agg(F.count(F.lit(1)).alias("c_"), F.sum("leaves").alias("l_"), F.sum(F.col("saved") + F.col("weight")).alias("v_"))
        told = lambda c: F.coalesce(F.col(c), F.lit(0))
        waiting = stored(open_.join(sent, ["conv_id", "end"], "left").withColumns({"left": F.col("left") - told("c_"), "leaves": F.col("leaves") + told("l_"), "saved": F.col("saved") + told("v_")}).drop("c_", "l_", "v_"), "stations")


def prefix_trie(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """The nodes of the trie: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    `turns` are (conv, depth from 1 without gaps, length, size, digest), `convs` are (conv, length), those without turns too.
    Two turns are equal when their digests are. A node's own saving is (n_convs - 1) * size of its last turn; the root's is 0."""
    hashed = F.sha2(F.concat(F.col("depth").cast("string"), F.lit(":"), F.col("digest")).cast("binary"), 256)
    lanes = {f"u{i}": F.conv(F.substring("h_", 8 * i + 1, 8), 16, 10).cast("long") for i in range(len(SUMS))}
    summed = _prefix_sums(turns.withColumn("h_", hashed).select("conv", "depth", "length", "size", "h_").withColumns(lanes).drop("h_"), "conv", "depth", {s: F.col(f"u{i}") for i, s in enumerate(SUMS)})
    summed = stored(summed.select("conv", *KEY, "length", "size", *[(F.col(s) - F.col(f"u{i}")).alias(f"p{i}") for i, s in enumerate(SUMS)]), "prefixes")
    zero = {s: F.lit(0).cast("long") for s in SUMS}
    ended = F.min(F.when(F.col("depth") == F.col("length"), F.col("conv"))).alias("first_end")
    inner = summed.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n_convs"), F.min("conv").alias("conv_id"), F.min("size").alias("size"), *[F.min(f"p{i}").alias(f"p{i}") for i in range(len(SUMS))], ended)
    root = convs.withColumn("depth", F.lit(0).cast("long")).agg(F.count(F.lit(1)).alias("n_convs"), F.min("conv").alias("conv_id"), ended).where("n_convs > 0")
    root = root.withColumns({"depth": F.lit(0).cast("long"), "size": F.lit(0).cast("long"), **zero, **{f"p{i}": F.lit(0).cast("long") for i in range(len(SUMS))}})
    nodes = stored(inner.unionByName(root), "nodes")
    ends = _ends(summed.where("depth = length").select(*KEY, "conv").unionByName(convs.where("length = 0").select(F.lit(0).cast("long").alias("depth"), *[c.alias(n) for n, c in zero.items()], "conv")))
    drop_stored(summed)

    named = _named(nodes).join(ends, KEY, "left").select("conv_id", "depth", "parent", "n_convs", "n_children", ((F.col("n_convs") - 1) * F.col("size")).alias("w"), F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"), (F.col("first_end") == F.col("conv_id")).alias("ends_here"))
    # a chain ends where there isn't exactly one child, or where the child has another name
    last = ((F.col("n_children") != 1) | F.coalesce("ends_here", F.lit(False))).cast("int")
    named = named.withColumn("last", last)
    linked = _prefix_sums(named, "conv_id", "depth", {"chain": F.col("last"), "upto": F.col("w")})
    linked = stored(linked.withColumn("chain", F.col("chain") - F.col("last")), "linked-nodes")
    drop_stored(nodes)
    stations = linked.groupBy("conv_id", "chain").agg(F.max("depth").alias("end"), F.min("depth").alias("top"), F.min_by("parent", "depth").alias("parent"), F.sum("w").alias("weight"), F.max("upto").alias("all"), F.max_by("n_children", "depth").alias("left"))
    stations = stations.withColumns({"up": F.col("top") - 1, "leaves": (F.col("left") == 0).cast("long"), "saved": F.lit(0).cast("long")})
    total = peeled(stations).select("conv_id", "chain", "leaves", "saved", "all", F.explode(F.sequence((F.col("top") / STRETCH).cast("long"), (F.col("end") / STRETCH).cast("long"))).alias("stretch"))
    out = linked.withColumn("stretch", (F.col("depth") / STRETCH).cast("long")).join(total, ["conv_id", "chain", "stretch"])
    return out.select("conv_id", "depth", F.col("parent").alias("parent_conv_id"), "n_convs", "n_children", F.col("leaves").alias("n_leaves"), (F.col("saved") + F.col("all") - F.col("upto") + F.col("w")).alias("saved_tokens"), "ends_sha256")


def conversation_trie(conversations: DataFrame, heads: Column | None = None, donor: Column | None = None, most: int = 0) -> DataFrame:
    """The trie of all conversations, as they are or with their first `heads` turns from another conversation (see `rebuilt`).

    Null role or text counts as empty. Rows of null conv_id take no part. Turns go by turn, nulls first, ties by role and then by digest;
    rows said twice are two turns. Texts of any length count whole, by their digest. Conversations without a turn of
    their own exist only if they are rebuilt from rows that others have. An empty table gives no rows, not even a root. Only
    the four columns conv_id, turn, role and text are read, whatever others are called. The same table gives the same rows again."""
    nothing = F.lit(0)
    return prefix_trie(*rebuilt(conversations, heads if heads is not None else nothing, donor if donor is not None else F.col("conv"), most))


def query(spark, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    heads = F.crc32(F.col("conv").cast("string").cast("binary")) % 9
    return conversation_trie(rows, heads, F.col("conv") - F.col("conv") % 5, 8)


ORACLE = r"""
WITH t AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS place
  FROM conversations WHERE conv_id IS NOT NULL
), c AS (
  SELECT conv_id, conv_id - conv_id % 5 AS donor,
         xor(list_reduce(list_concat([4294967295], list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda s: CAST(ascii(s) AS BIGINT))),
             lambda x, y: list_reduce(list_concat([xor(x, y)], CAST(range(8) AS BIGINT[])), lambda a, b: xor(a >> 1, 3988292384 * (a & 1)))), 4294967295) % 9 AS h
  FROM t GROUP BY conv_id
), k AS (SELECT c.*, least(h, (SELECT count(*) FROM t WHERE t.conv_id = c.donor)) AS k FROM c),
r AS (
  SELECT k.conv_id, place AS depth, role, text FROM k JOIN t ON t.conv_id = k.donor AND place <= h
  UNION ALL SELECT k.conv_id, k + place - h, role, text FROM k JOIN t ON t.conv_id = k.conv_id AND place > h
), p AS (
  SELECT conv_id, depth, octet_length(encode(text)) AS size,
         string_agg(length(role) || ':' || role || length(text) || ':' || text, '' ORDER BY depth) OVER (PARTITION BY conv_id ORDER BY depth) AS key,
         count(*) OVER (PARTITION BY conv_id) AS n
  FROM r
  UNION ALL SELECT conv_id, 0, 0, '', (SELECT count(*) FROM r WHERE r.conv_id = k.conv_id) FROM k
), g AS (
  SELECT depth, key, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * min(size) AS w,
         sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (depth = n), '')) AS ends_sha256
  FROM p GROUP BY depth, key
), u AS (
  SELECT g.*, a.conv_id AS parent_conv_id FROM g LEFT JOIN p ON p.conv_id = g.conv_id AND p.depth = g.depth - 1 LEFT JOIN g a ON a.depth = p.depth AND a.key = p.key
), m AS (SELECT parent_conv_id AS conv_id, depth - 1 AS depth, count(*) AS n FROM u WHERE parent_conv_id IS NOT NULL GROUP BY ALL),
f AS (SELECT u.*, coalesce(m.n, 0) AS n_children FROM u LEFT JOIN m USING (conv_id, depth)),
s AS (
  SELECT a.conv_id, a.depth, count(*) FILTER (f.n_children = 0) AS n_leaves, sum(f.w) AS saved
  FROM f JOIN p ON p.conv_id = f.conv_id AND p.depth <= f.depth JOIN g a ON a.depth = p.depth AND a.key = p.key GROUP BY ALL
)
SELECT f.conv_id, CAST(f.depth AS BIGINT) AS depth, parent_conv_id, n_convs, n_children, n_leaves, CAST(saved AS BIGINT) AS saved_tokens, ends_sha256
FROM f JOIN s USING (conv_id, depth)
"""
