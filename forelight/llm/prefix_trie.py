"""The prefix trie of conversations: which turns each shares with others, from digests alone.

Every turn becomes a SHA-256 digest of its role and text, and texts travel no further. The prefix
of depth d is named by the XOR of two 64-bit hashes of (place, turn) over its first d turns, so
prefixes of a conversation of any length come from block-wise running XORs. One aggregation over
all prefixes gives each distinct prefix, a node, its least conversation, its *owner*. Whoever owns
a prefix owns all longer ones, so the first depth a conversation owns is found by binary search:
all conversations ask at once for the owner of the prefix in the middle of what is left, by one
join a round. From there to its end a conversation owns a chain of nodes. The probe one turn above
names the chain it hangs from, and chains pass what they gathered to the chain above, then to that
2, 4, 8 ... links above, until sums over whole subtrees are complete.

A conversation of any length is handled in blocks of ``WIDTH`` turns, and its search goes down a
tree of blocks, so no group of rows grows with the data. Prefixes, chains and conversations that
hold very many rows meet the others by broadcast: at most ``FEW`` of them can be so large.

Defined results: rows without conv_id belong to no conversation and are left out; null roles and
texts are empty; turns alike in number (or both null) are ordered by their digests, so repeated
rows are turns of their own; a table without conversations has no nodes; further columns are
ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .common import Tables, cut, lookup, ship, trim

#: turns a block; ids a block of an ends digest
WIDTH, IDS = 256, 4096
#: at most so many keys are broadcast as hot: those that hold over 1/FEW of all rows
FEW = 5000
#: keys below this many rows are never hot
LEAST_HOT = 64

KEY = ["depth", "x1", "x2"]


def ordered_turns(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv_id, place from 1, content, bytes) of every turn in order, and (conv_id, n) of every
    conversation. Ranges of the sorted rows are numbered on their own and moved by the rows before,
    so a conversation of any size is split over tasks."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    content = F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256))
    thin = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", content.alias("content"), F.octet_length(text).cast("long").alias("bytes"))
    # the row number parts repeated rows; it is fixed by the checkpoint
    thin = cut(thin.withColumn("row", F.monotonically_increasing_id()))
    order = [F.col("turn").asc_nulls_first(), F.col("content"), F.col("row")]
    parted = cut(thin.repartitionByRange(F.col("conv_id"), *order).withColumn("part", F.spark_partition_id()))
    sizes = cut(parted.groupBy("conv_id", "part").agg(F.count("*").alias("n")))
    earlier = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # One conversation at most goes on from one range into the next: no more rows than ranges.
    before = sizes.withColumn("before", F.sum("n").over(earlier)).where("before is not null").drop("n")
    inside = F.row_number().over(Window.partitionBy("conv_id", "part").orderBy(*order))
    placed = parted.withColumn("inside", inside).join(F.broadcast(before), ["conv_id", "part"], "left")
    return placed.select("conv_id", (F.col("inside") + F.coalesce("before", F.lit(0))).alias("place"), "content", "bytes"), cut(sizes.groupBy("conv_id").agg(F.sum("n").alias("n")))


def _met(rows: DataFrame, by: str, table: DataFrame, keys: list[str], values: list[str], weight: str, hot: int) -> DataFrame:
    """``rows`` left joined with ``table``, which has each key once. Keys that over ``hot`` rows ask for
    are broadcast; the rows that found theirs are spread by the hash of column ``by`` in the second join."""
    value = F.struct(*values)
    few = F.broadcast(table.where(F.col(weight) > hot).select(*keys, value.alias("hot__")))
    # 0, but not as a constant: the planner would leave a constant out of the keys that rows are dealt by
    zero = F.least(F.col(weight), F.lit(0)).cast("long")
    rest = table.where(F.col(weight) <= hot).select(*keys, zero.alias("spread__"), value.alias("cold__"))
    told = rows.join(few, keys, "left").withColumn("spread__", F.when(F.col("hot__").isNotNull(), F.xxhash64(by)).otherwise(F.lit(0)))
    found = F.coalesce("hot__", "cold__")
    return told.join(rest, [*keys, "spread__"], "left").select(*rows.columns, *[found[v].alias(v) for v in values])


def _hot(rows: int) -> int:
    return max(LEAST_HOT, rows // FEW)


def regrafted(turns: DataFrame, convs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Each conversation c with its first h turns replaced by those of conversation c - c % 5, h being
    crc32(c) % 9: turns (conv_id, place, content, bytes, length) and conversations (conv_id, length)."""
    head = F.crc32(F.col("conv_id").cast("string").cast("binary")) % 9
    parent = F.col("conv_id") - F.col("conv_id") % 5
    own = convs.select("conv_id", "n", head.alias("h"), parent.alias("parent"))
    have = convs.select(F.col("conv_id").alias("parent"), F.col("n").alias("parent_n"))
    base = F.least("h", F.coalesce("parent_n", F.lit(0)))
    told = cut(own.join(have, "parent", "left").select("conv_id", "n", "h", "parent", base.alias("base"), (base + F.greatest(F.lit(0), F.col("n") - F.col("h"))).alias("length")))
    first = turns.where((F.col("place") <= 8) & (F.col("conv_id") % 5 == 0)).withColumnRenamed("conv_id", "parent")
    heads = first.join(told.select("conv_id", "parent", "h", "length"), "parent").where("place <= h").select("conv_id", "place", "content", "bytes", "length")
    hot = _hot(told.agg(F.sum("n")).first()[0] or 0)
    rest = _met(turns.where(F.col("place") > head), "place", told, ["conv_id"], ["h", "base", "length"], "n", hot)
    tails = rest.select("conv_id", (F.col("place") - F.col("h") + F.col("base")).alias("place"), "content", "bytes", "length")
    return heads.unionByName(tails), told.select("conv_id", "length")


def _prefixes(turns: DataFrame, longest: int, width: int) -> DataFrame:
    """conv_id, depth, x1, x2, bytes, length: the digest of every prefix, and the bytes of its last text."""
    block = F.expr(f"(place - 1) div {width}")
    hashed = turns.select("conv_id", F.col("place").alias("depth"), "bytes", "length", block.alias("block"), *(F.xxhash64(F.lit(k), "place", "content").alias(f"y{k}") for k in (1, 2)))
    running = Window.partitionBy("conv_id", "block").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    local = hashed.select("conv_id", "depth", "bytes", "length", "block", *(F.bit_xor(f"y{k}").over(running).alias(f"x{k}") for k in (1, 2)))
    if longest <= width:
        return local.drop("block")
    local = cut(local)
    ends = local.where((F.col("length") > width) & ((F.col("depth") % width == 0) | (F.col("depth") == F.col("length"))))
    earlier = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    before = ends.select("conv_id", "block", *(F.bit_xor(f"x{k}").over(earlier).alias(f"z{k}") for k in (1, 2))).where("block > 0")
    whole = local.join(before, ["conv_id", "block"], "left")
    return whole.select("conv_id", "depth", "bytes", "length", *(F.col(f"x{k}").bitwiseXOR(F.coalesce(f"z{k}", F.lit(0))).alias(f"x{k}") for k in (1, 2)))


def _first_owned(rows: DataFrame, nodes: DataFrame, hot: int) -> DataFrame:
    """``rows``: conv_id, at, keys (prefixes, shortest first), up. Binary search of the first key that
    conv_id owns: conv_id, at, size, first (from 1; size + 1: none), up (the owner of the key before)."""
    done = None
    active = rows.withColumns({"low": F.lit(1), "high": F.size("keys") + 1})
    while True:
        middle = F.element_at("keys", F.expr("(low + high) div 2").cast("int"))
        asked = active.select("*", *(middle[k].alias(k) for k in KEY))
        told = _met(asked, "conv_id", nodes, KEY, ["owner"], "n", hot)
        mine = F.col("owner") == F.col("conv_id")
        half = F.expr("cast((low + high) div 2 as int)")
        active = cut(told.select("conv_id", "at", "keys", F.when(mine, F.col("up")).otherwise(F.col("owner")).alias("up"), F.when(mine, F.col("low")).otherwise(half + 1).alias("low"), F.when(mine, half).otherwise(F.col("high")).alias("high")))
        ended = active.where("low >= high").select("conv_id", "at", F.size("keys").alias("size"), F.col("low").alias("first"), "up")
        done = ended if done is None else done.unionByName(ended)
        active = active.where("low < high")
        if active.isEmpty():
            return done


def chains(prefixes: DataFrame, nodes: DataFrame, longest: int, width: int, hot: int) -> DataFrame:
    """conv_id, first, up: the first depth that each conversation owns, if any, and the owner of the
    prefix one turn shorter (null for depth 1)."""
    levels = [prefixes.groupBy("conv_id", F.expr(f"(depth - 1) div {width}").alias("at")).agg(F.sort_array(F.collect_list(F.struct(*KEY))).alias("keys"), F.max("length").alias("length"))]
    while width ** len(levels) < longest:
        long = levels[-1].where(F.col("length") > width ** len(levels))
        levels[-1] = cut(levels[-1])
        levels.append(long.groupBy("conv_id", F.expr(f"at div {width}").alias("at")).agg(F.sort_array(F.collect_list(F.element_at("keys", -1))).alias("keys"), F.max("length").alias("length")))
    below = None
    for k in reversed(range(len(levels))):
        here = levels[k]
        rows = here.where(F.col("length") <= width ** (k + 1)).select("conv_id", "at", "keys", F.lit(None).cast("long").alias("up"))
        if below is not None:
            rows = rows.unionByName(here.select("conv_id", "at", "keys").join(below, ["conv_id", "at"]).select(*rows.columns))
        found = _first_owned(rows, nodes, hot).where("first <= size")
        below = found.select("conv_id", (F.col("at") * width + F.col("first") - 1).alias("at"), "up")
    return below.select("conv_id", (F.col("at") + 1).alias("first"), "up")


def _subtree_sums(links: DataFrame, hot: int) -> DataFrame:
    """``links``: conv_id, up, saved, leaves. Sums over each conversation's chain and all that hang from
    it: after j rounds they hold what is less than 2**j links below, and ``up`` is 2**j links above."""
    state = links
    while not state.where("up is not null").isEmpty():
        sent = cut(state.where("up is not null").groupBy(F.col("up").alias("to")).agg(F.sum("saved").alias("s"), F.sum("leaves").alias("l"), F.count("*").alias("c")))
        above = sent.join(state.select(F.col("conv_id").alias("to"), F.col("up").alias("next")), "to").select(F.col("to").alias("up"), "next", "c")
        moving = _met(state.where("up is not null"), "conv_id", above, ["up"], ["next"], "c", hot).withColumn("up", F.col("next")).drop("next")
        both = moving.unionByName(state.where("up is null"))
        got = both.join(sent.select(F.col("to").alias("conv_id"), "s", "l"), "conv_id", "left")
        state = cut(got.select("conv_id", "up", (F.col("saved") + F.coalesce("s", F.lit(0))).alias("saved"), (F.col("leaves") + F.coalesce("l", F.lit(0))).alias("leaves")))
    return state


def _hash_streams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by node and block: one digest a node of its blocks of ids, joined by commas."""
    key, state = None, None
    out = []
    for batch in batches:
        for d, x1, x2, ids in zip(*(batch.column(c).to_pylist() for c in (*KEY, "ids")), strict=True):
            if (d, x1, x2) == key:
                state.update(b",")
            else:
                if key is not None:
                    out.append((*key, state.hexdigest()))
                key, state = (d, x1, x2), hashlib.sha256()
            state.update(ids.encode())
    if key is not None:
        out.append((*key, state.hexdigest()))
    yield pa.RecordBatch.from_pydict({c: [r[i] for r in out] for i, c in enumerate((*KEY, "ends_sha256"))}, pa.schema([("depth", pa.int64()), ("x1", pa.int64()), ("x2", pa.int64()), ("ends_sha256", pa.string())]))
    trim()


def _ends(lasts: DataFrame) -> DataFrame:
    """depth, x1, x2, ends_sha256 of the nodes at which conversations end. Ids become strings in blocks of
    ``IDS`` numbers; only the hashing of one node's blocks, a chain by definition, is one task's."""
    ids = F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda x: x.cast("string")), ",")
    blocks = cut(lasts.groupBy(*KEY, F.floor(F.col("conv_id") / F.lit(IDS)).alias("block")).agg(ids.alias("ids")))
    counted = cut(blocks.groupBy(*KEY).agg(F.count("*").alias("blocks"), F.min("ids").alias("ids")))
    one = counted.where("blocks = 1").select(*KEY, F.sha2(F.col("ids").cast("binary"), 256).alias("ends_sha256"))
    many = lookup(blocks, cut(counted.where("blocks > 1").select(*KEY)), KEY, "left_semi", FEW)
    dealt = many.repartition(*KEY).sortWithinPartitions(*KEY, "block").select(*KEY, "ids")
    return one.unionByName(dealt.mapInArrow(_hash_streams, "depth long, x1 long, x2 long, ends_sha256 string"))


def trie(turns: DataFrame, convs: DataFrame, width: int = WIDTH) -> DataFrame:
    """The nodes of the trie over ``turns`` (conv_id, place, content, bytes, length) of the conversations
    ``convs`` (conv_id, length): conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256."""
    spark = turns.sparkSession
    ship(spark)
    shape = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
    root, count, longest, total = convs.agg(F.min("conv_id"), F.count("*"), F.max("length"), F.sum("length")).first()
    if not count:
        return spark.createDataFrame([], shape)
    hot = _hot(total)
    tables = Tables(spark)
    prefixes = tables.put(_prefixes(turns, longest, width))
    least = F.min(F.struct("conv_id", (F.col("depth") == F.col("length")).alias("last")))
    grouped = prefixes.groupBy(*KEY).agg(least.alias("m"), F.count("*").alias("n"), F.max("bytes").alias("bytes"))
    nodes = tables.put(grouped.select(*KEY, F.col("m.conv_id").alias("owner"), F.col("m.last").alias("last"), "n", ((F.col("n") - 1) * F.col("bytes")).alias("saved")))

    found = tables.put(chains(prefixes, nodes, longest, width, hot))
    at = [F.col("up").alias("owner"), (F.col("first") - 1).alias("depth")]
    inner = found.where("up is not null")
    own = nodes.groupBy("owner").agg(F.sum("saved").alias("saved"), F.max("depth").alias("end"))
    crowns = inner.select(*at).distinct().withColumn("crowned", F.lit(True))
    tops = own.join(crowns, (own["owner"] == crowns["owner"]) & (own["end"] == crowns["depth"]), "left").select(own["owner"].alias("conv_id"), "saved", F.when(F.col("crowned"), 0).otherwise(1).cast("long").alias("leaves"))
    sums = _subtree_sums(cut(found.join(tops, "conv_id").select("conv_id", "up", "saved", "leaves")), hot)
    hung = inner.join(sums.drop("up"), "conv_id").groupBy(*at).agg(F.sum("saved").alias("s"), F.sum("leaves").alias("l"), F.count("*").alias("c"))

    zero = F.lit(0).cast("long")
    going = F.when(F.col("last"), 0).otherwise(1)
    told = nodes.join(hung, ["owner", "depth"], "left").select(*KEY, "owner", "n", F.expr(f"(depth - 1) div {width}").alias("block"), (going + F.coalesce("c", zero)).cast("long").alias("n_children"), (F.col("saved") + F.coalesce("s", zero)).alias("s"), F.when(F.col("last") & F.col("c").isNull(), 1).otherwise(F.coalesce("l", zero)).cast("long").alias("l"))
    told = told.join(found.select(F.col("conv_id").alias("owner"), F.col("first").alias("depth"), F.coalesce("up", F.lit(root)).alias("above")), ["owner", "depth"], "left")
    below = Window.partitionBy("owner", "block").orderBy(F.col("depth").desc()).rowsBetween(Window.unboundedPreceding, 0)
    told = tables.put(told.withColumns({"saved_tokens": F.sum("s").over(below), "n_leaves": F.sum("l").over(below)}))
    if longest > width:
        later = Window.partitionBy("owner").orderBy(F.col("block").desc()).rowsBetween(Window.unboundedPreceding, -1)
        blocks = told.groupBy("owner", "block").agg(F.sum("s").alias("s"), F.sum("l").alias("l"))
        more = blocks.select("owner", "block", F.sum("s").over(later).alias("more_s"), F.sum("l").over(later).alias("more_l")).where("more_s is not null")
        told = told.join(more, ["owner", "block"], "left").withColumns({"saved_tokens": F.col("saved_tokens") + F.coalesce("more_s", zero), "n_leaves": F.col("n_leaves") + F.coalesce("more_l", zero)})

    turnless = convs.where("length = 0").select("conv_id", *(F.lit(0).cast("long").alias(k) for k in KEY))
    ends = _ends(prefixes.where("depth = length").select("conv_id", *KEY).unionByName(turnless))
    # the root: what its children gathered; one row
    top = told.where("depth = 1").agg(F.sum("saved_tokens").alias("saved_tokens"), F.count("*").alias("n_children"), F.sum("n_leaves").alias("n_leaves"))
    first = top.select(*(F.lit(0).cast("long").alias(k) for k in KEY), F.lit(root).alias("conv_id"), F.lit(None).cast("long").alias("parent_conv_id"), F.lit(count).alias("n_convs"), "n_children", F.coalesce("n_leaves", F.lit(1)).cast("long").alias("n_leaves"), F.coalesce("saved_tokens", zero).alias("saved_tokens"))
    rest = told.select(*KEY, F.col("owner").alias("conv_id"), F.coalesce("above", "owner").alias("parent_conv_id"), F.col("n").alias("n_convs"), "n_children", "n_leaves", "saved_tokens")
    out = rest.unionByName(first).join(ends, KEY, "left")
    nothing = F.lit(hashlib.sha256().hexdigest())
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", nothing).alias("ends_sha256"))


def conversation_trie(conversations: DataFrame, width: int = WIDTH) -> DataFrame:
    """The trie of the conversations as they are."""
    turns, convs = ordered_turns(conversations)
    lengths = convs.withColumnRenamed("n", "length")
    hot = _hot(convs.agg(F.sum("n")).first()[0] or 0)
    told = _met(turns, "place", convs.withColumn("length", F.col("n")), ["conv_id"], ["length"], "n", hot)
    return trie(told, lengths, width)


def regrafted_trie(conversations: DataFrame, width: int = WIDTH) -> DataFrame:
    """The trie of the conversations rebuilt by ``regrafted``."""
    return trie(*regrafted(*ordered_turns(conversations)), width)
