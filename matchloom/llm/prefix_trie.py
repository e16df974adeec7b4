"""Prefix trie of conversations by partition refinement.

All conversations start in one class, the root. Round d splits every active class by its members' d-th turn; a class of one
member is retired, and its tail is emitted as a chain of nodes with one child each. Classes with more than ``SMALL`` turns
and members are split round by round over the whole cluster; a smaller one goes whole to one task, which splits it to the
end in the same way, so a task never holds an unbounded class. Both ways give the same nodes whatever ``SMALL`` is. Then the
nodes are folded back from the deepest level up. Texts are read once: from then on a turn is its SHA-256 and length.

A node is named by its smallest member and its depth. Rounds on the cluster number as many as the turns that a class of
over ``SMALL`` shares.

Defined results: turns are ordered by turn (null first), equal turns by their digests, and repeated rows count as often
as they come; null role or text is empty; rows of a null conv_id belong to no conversation; a negative conv_id's
base is the next multiple of five below it; an empty table has no root and no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from matchloom.llm.common import cut, read_table, replicated, spread

#: Turns and members of a class up to which one task splits it to the end.
SMALL = 1000
#: Turns dealt together when a long conversation is joined or emitted.
CHUNK = 4096
#: The most head turns that a rebuilt conversation takes from its base.
MOST_HEAD = 8
NO_ENDS = hashlib.sha256(b"").hexdigest()
NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"


def turn_table(rows: DataFrame) -> DataFrame:
    """conv_id, pos (from 0), digest and bytes of every turn, numbered in order within its conversation.

    Rows are dealt by ranges of the whole order and numbered within their partition, so a conversation of any length
    spreads over tasks; what a partition adds is counted once for each conversation and partition.
    """
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    digest = F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256))
    turns = rows.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", digest.alias("digest"), F.octet_length(text).cast("long").alias("bytes"), F.monotonically_increasing_id().alias("at"))
    order = ["conv_id", F.asc_nulls_first("turn"), "digest", "at"]
    dealt = cut(turns).repartitionByRange(*order).sortWithinPartitions(*order)
    dealt = cut(dealt.select("conv_id", "digest", "bytes", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("i")))
    own = dealt.groupBy("conv_id", "part").agg(F.min("i").alias("first"), F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row a partition
    starts = own.select("conv_id", "part", (before - F.col("first")).alias("shift"))
    return dealt.join(starts, ["conv_id", "part"]).select("conv_id", (F.col("i") + F.col("shift")).alias("pos"), "digest", "bytes")


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """conv_id and length of every rebuilt conversation, and its turns (conv_id, depth from 1, digest, bytes).

    The first h turns come from conversation c - c mod 5, the rest are its own after its first h; h is crc32(c) mod 9.
    """
    h = (F.crc32(F.col("conv_id").cast("string")) % (MOST_HEAD + 1)).cast("long")
    sizes = turns.groupBy("conv_id").agg(F.count("*").alias("n"))
    convs = sizes.select("conv_id", "n", h.alias("h"), (F.col("conv_id") - F.pmod("conv_id", F.lit(5))).alias("base"))
    bases = sizes.select(F.col("conv_id").alias("base"), F.col("n").alias("base_n"))
    convs = convs.join(bases, "base", "left").withColumn("k", F.least("h", F.coalesce("base_n", F.lit(0))))
    convs = cut(convs.select("conv_id", "base", "n", "h", "k", (F.col("k") + F.greatest(F.lit(0), F.col("n") - F.col("h"))).alias("len")))
    heads = turns.where((F.col("pos") < MOST_HEAD) & (F.pmod("conv_id", F.lit(5)) == 0)).withColumnRenamed("conv_id", "base")
    head = convs.where("k > 0").join(heads, "base").where("pos < k").select("conv_id", (F.col("pos") + 1).alias("depth"), "digest", "bytes")
    # a long conversation meets its own row once for every CHUNK turns
    chunked = convs.select("conv_id", "h", "k", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("n") / CHUNK))).alias("chunk"))
    tail = turns.withColumn("chunk", F.floor(F.col("pos") / CHUNK)).join(chunked, ["conv_id", "chunk"]).where("pos >= h").select("conv_id", (F.col("pos") - F.col("h") + F.col("k") + 1).alias("depth"), "digest", "bytes")
    # files hold ranges of depths, so a round reads its own depth
    return convs.select("conv_id", "len"), cut(head.unionByName(tail).repartitionByRange("depth", "conv_id").sortWithinPartitions("depth"))


def ends_of(members: DataFrame) -> DataFrame:
    """conv_id, depth and the SHA-256 of the joined ids ``member`` of every node that any conversation ends at.

    Tasks join the ids of their ranges to pieces; the pieces of a node are then streamed through its hash in order.
    """

    def pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for at in range(0, len(b), CHUNK):
                g = b.iloc[at : at + CHUNK].groupby(["conv_id", "depth"], sort=False)["member"]
                yield pd.DataFrame([(*k, v.iloc[0], ",".join(map(str, v))) for k, v in g], columns=["conv_id", "depth", "first", "text"])

    def digests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, state = None, None
        for b in batches:
            done = []
            for k, text in zip(zip(b["conv_id"], b["depth"]), b["text"]):
                if k != key:
                    if key is not None:
                        done.append((*key, state.hexdigest()))
                    key, state = k, hashlib.sha256(text.encode())
                else:
                    state.update(b"," + text.encode())
            yield pd.DataFrame(done, columns=["conv_id", "depth", "ends_sha256"])
        if key is not None:
            yield pd.DataFrame([(*key, state.hexdigest())], columns=["conv_id", "depth", "ends_sha256"])

    order = ["conv_id", "depth", "member"]
    joined = members.repartitionByRange(*order).sortWithinPartitions(*order).mapInPandas(pieces, "conv_id long, depth long, first long, text string")
    streamed = joined.repartition("conv_id", "depth").sortWithinPartitions("conv_id", "depth", "first")
    return streamed.mapInPandas(digests, "conv_id long, depth long, ends_sha256 string")


def _refine(rows: pd.DataFrame) -> pd.DataFrame:
    """All nodes of whole small classes; rows: top, at, level (0 is the class's own node), conv_id, depth, parent, len, digest, bytes."""
    rows = rows.sort_values(["level", "conv_id"], kind="stable")
    convs, conv = np.unique(rows["conv_id"].to_numpy(), return_inverse=True)
    level, depth, size = (rows[c].to_numpy() for c in ("level", "depth", "bytes"))
    digest = pd.factorize(rows["digest"])[0]
    member_of = np.full(len(convs), -1)  # each conversation's class, as a node number of the level above
    length = np.zeros(len(convs), dtype=np.int64)
    length[conv] = rows["len"].to_numpy()
    levels, tails = [], []
    starts = np.searchsorted(level, np.arange(level.max() + 2))
    tops = rows.groupby(["top", "at"]).ngroup().to_numpy()
    parents = rows["parent"].to_numpy(dtype=object)
    active = np.ones(len(convs), dtype=bool)
    for r in range(len(starts) - 1):
        at = np.arange(starts[r], starts[r + 1])
        at = at[active[conv[at]]]
        if not len(at):
            break
        c = conv[at]
        key = tops[at] if r == 0 else member_of[c] * (digest.max() + 1) + digest[at]
        _, first, cls, n = np.unique(key, return_index=True, return_inverse=True, return_counts=True)  # the first of a class has its smallest id
        own, d = convs[c[first]], depth[at[first]]
        above = member_of[c[first]]
        parent = parents[at[first]] if r == 0 else levels[-1]["own"][above].astype(object)
        levels.append({"own": own, "depth": d, "above": above, "parent": parent, "n": n, "weight": np.where(d > 0, (n - 1) * size[at[first]], 0), "ends": [[] for _ in own], "children": np.zeros(len(own), np.int64), "leaves": np.zeros(len(own), np.int64), "saved": np.zeros(len(own), np.int64)})
        for i in np.flatnonzero(length[c] == depth[at]):
            levels[-1]["ends"][cls[i]].append(int(convs[c[i]]))
        member_of[c] = cls
        alone = n[cls] == 1
        active[c[alone]] = False
        for i in np.flatnonzero(alone & (length[c] > depth[at])):  # the chain below this node
            tails.append((convs[c[i]], depth[at[i]], length[c[i]]))
            levels[-1]["children"][cls[i]] = levels[-1]["leaves"][cls[i]] = 1
    for r in range(len(levels) - 1, -1, -1):
        x = levels[r]
        x["leaves"] = np.where(x["children"] == 0, 1, x["leaves"])
        x["saved"] += x["weight"]
        if r:
            for into, what in (("children", np.ones(len(x["own"]), np.int64)), ("leaves", x["leaves"]), ("saved", x["saved"])):
                np.add.at(levels[r - 1][into], x["above"], what)
    out = [pd.DataFrame({"conv_id": x["own"], "depth": x["depth"], "parent_conv_id": pd.array(x["parent"], dtype="Int64"), "n_convs": x["n"], "n_children": x["children"], "n_leaves": x["leaves"], "saved_tokens": x["saved"], "ends_sha256": [hashlib.sha256(",".join(map(str, e)).encode()).hexdigest() for e in x["ends"]]}) for x in levels]
    for c, d, last in tails:
        ends = [NO_ENDS] * (last - d - 1) + [hashlib.sha256(str(c).encode()).hexdigest()]
        out.append(pd.DataFrame({"conv_id": c, "depth": np.arange(d + 1, last + 1), "parent_conv_id": pd.array([c] * (last - d), dtype="Int64"), "n_convs": 1, "n_children": [1] * (last - d - 1) + [0], "n_leaves": 1, "saved_tokens": 0, "ends_sha256": ends}))
    return pd.concat(out, ignore_index=True)


def refine_small(members: DataFrame, turns: DataFrame) -> DataFrame:
    """Nodes of the small classes; ``members`` has top, at (its depth), parent, conv_id and len."""
    below = members.join(turns, "conv_id").where("depth > at")
    cols = ["top", "at", "parent", "conv_id", "len", "depth", "digest", "bytes"]
    own = members.select("top", "at", "parent", "conv_id", "len", F.col("at").alias("depth"), F.lit(None).cast("binary").alias("digest"), "top_bytes").withColumnRenamed("top_bytes", "bytes")
    rows = own.unionByName(below.select(*cols)).repartition("top", "at").sortWithinPartitions("top", "at")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pd.DataFrame] = []

        def flush(rows: pd.DataFrame) -> pa.RecordBatch:
            done = _refine(rows.assign(level=rows["depth"] - rows["at"]))
            return pa.RecordBatch.from_pandas(done, preserve_index=False)

        for b in batches:
            b = b.to_pandas(integer_object_nulls=True).astype({"top": "int64", "at": "int64"})
            last = (b["top"] == b["top"].iloc[-1]) & (b["at"] == b["at"].iloc[-1])
            whole = b[~last]
            if len(held) and not (held[0]["top"].iloc[0] == b["top"].iloc[-1] and held[0]["at"].iloc[0] == b["at"].iloc[-1]):
                whole, held = pd.concat([*held, whole]), []
            if len(whole):
                yield flush(whole)
            held.append(b[last])
        if held:
            yield flush(pd.concat(held))

    return rows.mapInArrow(run, NODE)


def _tails(singles: DataFrame) -> DataFrame:
    """Chains of conversations that are alone in their class: nodes from depth ``at`` to ``len``, in chunks that are dealt out."""
    chunks = singles.select("conv_id", "len", "parent", "at", F.explode(F.sequence("at", F.greatest("at", "len"), F.lit(CHUNK).cast("long"))).alias("lo"))
    each = chunks.repartition("conv_id", "lo").withColumn("depth", F.explode(F.sequence("lo", F.least("len", F.col("lo") + CHUNK - 1))))
    last = F.col("depth") == F.col("len")
    return each.select(
        "conv_id", "depth", F.when(F.col("depth") == F.col("at"), F.col("parent")).otherwise(F.col("conv_id")).alias("parent_conv_id"), F.lit(1).cast("long").alias("n_convs"), F.when(last, 0).otherwise(1).cast("long").alias("n_children"),
        F.lit(1).cast("long").alias("n_leaves"), F.lit(0).cast("long").alias("saved_tokens"), F.when(last, F.sha2(F.col("conv_id").cast("string"), 256)).otherwise(NO_ENDS).alias("ends_sha256"),
    )


def trie(convs: DataFrame, turns: DataFrame, small: int = SMALL) -> DataFrame:
    """All nodes of the trie of conversations (conv_id, len) and their turns (conv_id, depth, digest, bytes)."""
    spark = convs.sparkSession
    root = convs.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n"), F.sum("len").alias("turns")).first()
    if root.n == 0:
        return spark.createDataFrame([], NODE)
    none = F.lit(None).cast("long")
    if root.n == 1:
        return _tails(convs.select("conv_id", "len", none.alias("parent"), F.lit(0).cast("long").alias("at")))
    if root.n + root.turns <= small:
        return refine_small(convs.select(F.lit(root.conv_id).alias("top"), F.lit(0).cast("long").alias("at"), none.alias("parent"), "conv_id", "len", F.lit(0).cast("long").alias("top_bytes")), turns)
    large = [spark.createDataFrame([(root.conv_id, 0, None, root.n, 0)], "conv_id long, depth long, parent long, n long, bytes long")]
    active = convs.select("conv_id", "len", F.lit(root.conv_id).alias("cls"))
    smalls, singles, enders = [], [], []
    while True:
        d = len(large)
        enders.append(active.where(F.col("len") == d - 1).select(F.col("cls").alias("conv_id"), F.lit(d - 1).cast("long").alias("depth"), F.col("conv_id").alias("member")))
        here = active.where(F.col("len") >= d).join(turns.where(F.col("depth") == d).select("conv_id", "digest", "bytes"), "conv_id")
        weight = F.sum(F.col("len") - d + 1)
        # few: each has over ``small`` turns and members
        split = cut(here.groupBy("cls", "digest").agg(F.min("conv_id").alias("own"), F.count("*").alias("n"), weight.alias("w"), F.min("bytes").alias("b")).where((F.col("n") > 1) & (F.col("n") + F.col("w") > small)))
        named = here.withColumn("p", spread("conv_id")).join(replicated(split.select("cls", "digest", "own"), "p"), ["cls", "digest", "p"], "left").drop("p")
        named = cut(named)
        w = Window.partitionBy("cls", "digest")  # of at most ``small`` members
        rest = named.where("own is null").select("conv_id", "len", "cls", "bytes", F.min("conv_id").over(w).alias("top"), F.count("*").over(w).alias("n"))
        at = F.lit(d).cast("long").alias("at")
        singles.append(rest.where("n = 1").select("conv_id", "len", F.col("cls").alias("parent"), at))
        smalls.append(rest.where("n > 1").select("top", at, F.col("cls").alias("parent"), "conv_id", "len", F.col("bytes").alias("top_bytes")))
        if split.isEmpty():
            break
        large.append(split.select(F.col("own").alias("conv_id"), F.lit(d).cast("long").alias("depth"), F.col("cls").alias("parent"), "n", F.col("b").alias("bytes")))
        active = named.where("own is not null").select("conv_id", "len", F.col("own").alias("cls"))
    near = turns.where(F.col("depth") <= len(large) + small)  # no member of a small class has later turns
    below = cut(refine_small(_all(smalls), near).unionByName(_tails(_all(singles))))
    return below.unionByName(_fold(large, below, enders))


def _fold(large: list[DataFrame], below: DataFrame, enders: list[DataFrame]) -> DataFrame:
    """The nodes of the large classes, from the deepest level up, with what their children hold."""

    def summed(nodes: DataFrame) -> DataFrame:
        return nodes.groupBy(F.col("parent_conv_id").alias("conv_id"), (F.col("depth") - 1).alias("depth")).agg(F.count("*").alias("c"), F.sum("n_leaves").alias("l"), F.sum("saved_tokens").alias("s"))

    nodes = cut(_all(large))
    keys = nodes.select("conv_id", "depth")
    rest = cut(summed(below.join(keys.select(F.col("conv_id").alias("parent_conv_id"), (F.col("depth") + 1).alias("depth")), ["parent_conv_id", "depth"], "left_semi")))
    folded: DataFrame | None = None
    levels = []
    for d in range(len(large) - 1, -1, -1):
        children = rest.where(F.col("depth") == d)
        if folded is not None:
            children = children.unionByName(summed(folded)).groupBy("conv_id", "depth").agg(*(F.sum(x).alias(x) for x in "cls"))
        own = (F.col("n") - 1) * F.col("bytes")
        folded = nodes.where(F.col("depth") == d).join(children, ["conv_id", "depth"], "left").select(
            "conv_id", "depth", F.col("parent").alias("parent_conv_id"), F.col("n").alias("n_convs"), F.coalesce("c", F.lit(0)).cast("long").alias("n_children"),
            F.coalesce("l", F.lit(1)).cast("long").alias("n_leaves"), (own + F.coalesce("s", F.lit(0))).cast("long").alias("saved_tokens"),
        )
        folded = cut(folded)
        levels.append(folded)
    return _all(levels).join(ends_of(_all(enders)), ["conv_id", "depth"], "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(NO_ENDS)))


def _all(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All nodes of the trie of every rebuilt conversation."""
    turns = turn_table(read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"))
    return trie(*rebuilt(cut(turns)))


_CRC = "xor(list_reduce(list_prepend(4294967295::UBIGINT, [ascii(x)::UBIGINT FOR x IN string_split(CAST(conv_id AS VARCHAR), '')]), lambda c, b: list_reduce(list_prepend(xor(c, b), [0::UBIGINT FOR i IN range(8)]), lambda x, y: xor(x >> 1, (x & 1) * 3988292384::UBIGINT))), 4294967295::UBIGINT)"
#: A node is the list of its turns' digests up to it; a subtree's sums go over all nodes that start with it.
ORACLE_OP13 = f"""WITH t AS MATERIALIZED (SELECT conv_id, sha256(strlen(role) || ':' || role || text) AS digest, strlen(text) AS bytes,
  row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(strlen(role) || ':' || role || text)) - 1 AS pos
  FROM (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL)),
c AS MATERIALIZED (SELECT conv_id, conv_id - ((conv_id % 5) + 5) % 5 AS base, CAST({_CRC} % {MOST_HEAD + 1} AS BIGINT) AS h, count(*) AS n FROM t GROUP BY conv_id),
r AS MATERIALIZED (SELECT c.conv_id, 0 AS part, pos, digest, bytes FROM c JOIN t ON t.conv_id = c.base WHERE pos < h
  UNION ALL SELECT c.conv_id, 1, pos, digest, bytes FROM c JOIN t USING (conv_id) WHERE pos >= h),
s AS MATERIALIZED (SELECT conv_id, row_number() OVER w AS depth, bytes, sha256(string_agg(digest, '') OVER w) AS node FROM r WINDOW w AS (PARTITION BY conv_id ORDER BY part, pos)
  UNION ALL SELECT conv_id, 0, 0, '' FROM c),
l AS (SELECT conv_id, max(depth) AS len FROM s GROUP BY conv_id),
n AS MATERIALIZED (SELECT node, depth, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(bytes) AS own,
  sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE depth = len), '')) AS ends_sha256 FROM s JOIN l USING (conv_id) GROUP BY node, depth),
e AS MATERIALIZED (SELECT DISTINCT a.node, b.node AS below FROM s a JOIN s b ON a.conv_id = b.conv_id AND b.depth = a.depth + 1),
u AS MATERIALIZED (SELECT DISTINCT a.node, b.node AS below FROM s a JOIN s b ON a.conv_id = b.conv_id AND b.depth >= a.depth),
k AS (SELECT node, count(*) AS n_children FROM e GROUP BY node),
f AS (SELECT u.node, count(*) FILTER (WHERE k.node IS NULL) AS n_leaves, sum(n.own) AS saved_tokens FROM u JOIN n ON n.node = u.below LEFT JOIN k ON k.node = u.below GROUP BY u.node),
p AS (SELECT e.below AS node, n.conv_id AS parent_conv_id FROM e JOIN n USING (node))
SELECT n.conv_id, n.depth, p.parent_conv_id, n.n_convs, coalesce(k.n_children, 0) AS n_children, f.n_leaves, CAST(f.saved_tokens AS BIGINT) AS saved_tokens, n.ends_sha256
FROM n JOIN f USING (node) LEFT JOIN k USING (node) LEFT JOIN p USING (node)"""
