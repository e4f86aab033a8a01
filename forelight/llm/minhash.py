"""Near-duplicate groups by MinHash bands, odd sketches and exact confirmation.

A text's set holds its distinct shingles of two words (A-Z lower-cased, words cut at
ASCII white space); one word alone is one shingle. Equal sets become one node, named
by a 128-bit hash. 112 MinHash samples give 28 bands of four rows, which a pair of
similarity 0.8 misses all together with probability 4e-7, and are folded into a parity
bitmap of 512 bits, whose XOR population count grows with the samples that differ. A
candidate pair goes on if that count is under the value that a pair of similarity 0.8
exceeds with probability below 1e-6; then its two full sets are compared exactly.

Candidates come in three rounds, so that no group emits all its pairs. First every member
meets one other, the least of the first members of its buckets. Then those that are still apart
meet the least and the greatest member of all their buckets. Where buckets still hold
several components, the rows outside the largest component of their cluster ask the
others of like size, block by block: the stored sketches first, then the full sets of the
rows that had a plausible partner, emitting confirmed links only. Pairs already in one
component need no confirmation. No pair carries a text: texts travel to the member that many are
compared with, once a pair, and that member's own once to every ``BLOCK`` of them.

Defined results: null, empty and blank texts have no shingles and are linked with
nothing, each its own component; a null doc_id can't name a component unless all its
group lacks one; rows with equal doc_id and text share their result; an empty table
gives an empty result.
"""

from __future__ import annotations

import hashlib

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from .common import cut, join_uneven, lookup, ship, split_words, trim
from .components import components

BANDS, ROWS, BITS = 28, 4, 512
SAMPLES = BANDS * ROWS
#: XOR population count up to which a pair stays a candidate
MOST_BITS = 84
NUMERATOR, DENOMINATOR = 80, 100
#: row ids or buckets that may be broadcast (under 100 bytes each); more are joined by a shuffle
BROADCAST_ROWS = 200_000
#: members from which a bucket is not dealt to one task
HOT = 500
#: rows, and shingles of all of them, that one block of the second round holds on either side, about
BLOCK, BLOCK_SHINGLES = 1024, 500_000
#: texts whose samples are held at a time
AT_ONCE = 1000

_RNG = np.random.default_rng(20240229)
_MULTIPLY = (_RNG.integers(0, 1 << 32, SAMPLES, dtype=np.uint64) | np.uint64(1)).astype(np.uint32)
_ADD = _RNG.integers(0, 1 << 32, SAMPLES, dtype=np.uint64).astype(np.uint32)
_SALT = _RNG.integers(0, 1 << 63, SAMPLES, dtype=np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambler of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's shingles."""
    words = split_words(text)
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    if len(h) == 1:
        return _mix(h ^ np.uint64(0x5851F42D4C957F2D))
    return np.unique(_mix(h[:-1] * np.uint64(0x9E3779B97F4A7C15) + _mix(h[1:])))


def samples(s: np.ndarray) -> np.ndarray:
    x = (s >> np.uint64(32)).astype(np.uint32)
    least = np.full(SAMPLES, 0xFFFFFFFF, np.uint32)
    for k in range(0, len(x), 1024):
        np.minimum(least, (x[k : k + 1024, None] * _MULTIPLY + _ADD).min(axis=0), out=least)
    return least


def band_hashes(least: np.ndarray) -> np.ndarray:
    """docs x SAMPLES -> docs x BANDS."""
    m = least.reshape(len(least), BANDS, ROWS).astype(np.uint64)
    out = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), m.shape[:2]).copy()
    for r in range(ROWS):
        out = _mix(out * np.uint64(0x9E3779B97F4A7C15) + m[:, :, r])
    return out.view(np.int64)


def odd_sketches(least: np.ndarray) -> np.ndarray:
    """docs x SAMPLES -> docs x BITS/64: the parity of the samples that fall on each bit."""
    at = (_mix(least.astype(np.uint64) ^ _SALT) % np.uint64(BITS)).astype(np.int64)
    bits, rows = np.zeros((len(least), BITS), np.uint8), np.arange(len(least))
    for k in range(SAMPLES):
        bits[rows, at[:, k]] ^= 1
    return np.packbits(bits, axis=1).view("<i8")


def signed(text: Column) -> Column:
    """n, sid (128 bits), bands and odd sketch of each text."""

    @F.pandas_udf("n long, sid binary, bands array<long>, odd array<long>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            parts = [_signed(texts.iloc[k : k + AT_ONCE]) for k in range(0, len(texts), AT_ONCE)]
            yield pd.concat(parts, ignore_index=True) if parts else _signed(texts)
            del texts, parts
            trim()

    return run(text)


def _signed(texts: pd.Series) -> pd.DataFrame:
    n, sids, least = [], [], np.full((len(texts), SAMPLES), 0xFFFFFFFF, np.uint32)
    for i, t in enumerate(texts):
        s = shingles(t if isinstance(t, str) else None)
        n.append(len(s))
        sids.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
        if len(s):
            least[i] = samples(s)
    return pd.DataFrame({"n": n, "sid": sids, "bands": list(band_hashes(least)), "odd": list(odd_sketches(least))})


def _row_id(salt: int) -> Column:
    """Half of a 128-bit name of a row's doc_id and text."""
    return F.xxhash64(F.lit(salt), F.col("doc_id"), F.col("text"))


def signatures(docs: DataFrame) -> DataFrame:
    ship(docs.sparkSession)
    return docs.select("doc_id", _row_id(1).alias("r1"), _row_id(2).alias("r2"), signed(F.col("text")).alias("s")).select("doc_id", "r1", "r2", "s.*")


def _differing_bits(a: str, b: str) -> Column:
    out = F.lit(0)
    for k in range(BITS // 64):
        out = out + F.bit_count(F.col(a)[k].bitwiseXOR(F.col(b)[k]))
    return out


def _plausible(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs a, b whose set sizes and odd sketches allow the similarity; with owners."""
    one = sets.select(F.col("sid").alias("a"), F.col("n").alias("na"), F.col("odd").alias("oa"))
    two = sets.select(F.col("sid").alias("b"), F.col("n").alias("nb"), F.col("odd").alias("ob"))
    both = pairs.join(one, "a").join(two, "b")
    return both.where((DENOMINATOR * F.least("na", "nb") >= NUMERATOR * F.greatest("na", "nb")) & (_differing_bits("oa", "ob") <= MOST_BITS)).select("a", "b")


def linked(x: np.ndarray, y: np.ndarray) -> bool:
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both > 0 and DENOMINATOR * both >= NUMERATOR * (len(x) + len(y) - both)


def _texts(nodes: DataFrame, sets: DataFrame, docs: DataFrame) -> DataFrame:
    """sid, text of the named sets."""
    owners = cut(nodes.join(sets.select("sid", "owner"), "sid").select("sid", F.col("owner.r1").alias("r1"), F.col("owner.r2").alias("r2")))
    if owners.count() <= BROADCAST_ROWS:
        owners = F.broadcast(owners)
    return docs.select(_row_id(1).alias("r1"), _row_id(2).alias("r2"), "text").join(owners, ["r1", "r2"]).select("sid", "text").dropDuplicates(["sid"])


def _confirm(pairs: DataFrame, sets: DataFrame, docs: DataFrame) -> DataFrame:
    """The pairs a (a hub, which may have very many partners), b whose full sets are similar enough, as
    u, v. A member's text goes to its hub, with the names only of the pair; a hub's text goes once to
    each part of ``BLOCK`` members, whose rows then pass by it one after the other."""
    asked = cut(pairs)
    hubs = cut(asked.groupBy("a").agg(F.count("*").alias("c"), F.ceil(F.count("*") / BLOCK).cast("int").alias("parts")))
    dealt = join_uneven(asked, hubs, "a", "c", HOT, BROADCAST_ROWS)
    members = dealt.select(F.col("b").alias("sid"), F.col("a").alias("hub"), F.pmod(F.xxhash64("b"), F.col("parts")).cast("int").alias("part"), F.lit(1).alias("kind"))
    own = hubs.select(F.col("a").alias("sid"), F.col("a").alias("hub"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(0).alias("kind"))
    roles = cut(members.unionByName(own))
    rows = roles.join(_texts(roles.select("sid").distinct(), sets, docs), "sid")
    return rows.repartition("hub", "part").sortWithinPartitions("hub", "part", "kind").select("hub", "kind", "sid", "text").mapInArrow(_alike, "u binary, v binary")


def _alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows hub, kind, sid, text in which each hub's own (kind 0) comes before its members: the linked."""
    known = np.empty(0, np.uint64)
    for batch in batches:
        u, v = [], []
        for hub, kind, sid, text in zip(*(batch.column(c) for c in ("hub", "kind", "sid", "text")), strict=True):
            if not kind.as_py():
                known = shingles(text.as_py())
            elif linked(known, shingles(text.as_py())):
                u.append(hub.as_py())
                v.append(sid.as_py())
        yield pa.RecordBatch.from_arrays([pa.array(u, pa.binary()), pa.array(v, pa.binary())], ["u", "v"])
        del batch
        trim()


def _plausible_rows(odd: np.ndarray, size: np.ndarray, label: np.ndarray, ask: np.ndarray):
    """Of each asking row i: the other rows that size and sketch allow, under other labels."""
    rest = np.flatnonzero(~ask)
    for i in np.flatnonzero(ask).tolist():
        low, high = np.minimum(size[i], size[rest]), np.maximum(size[i], size[rest])
        near = rest[(label[rest] != label[i]) & (DENOMINATOR * low >= NUMERATOR * high)]
        yield i, near[np.bitwise_count(odd[near] ^ odd[i]).sum(axis=1) <= MOST_BITS]


def block_near(block: pd.DataFrame) -> pd.DataFrame:
    """The rows of a block that have a plausible partner: all that need their texts."""
    odd = np.stack(block["odd"].to_list()).astype(np.int64).view(np.uint64)
    keep = np.zeros(len(block), bool)
    for i, near in _plausible_rows(odd, block["n"].to_numpy(), pd.factorize(block["label"])[0], block["ask"].to_numpy(bool)):
        if len(near):
            keep[i] = keep[near] = True
    return block[keep]


def block_links(block: pd.DataFrame) -> pd.DataFrame:
    """Confirmed links of a block's asking rows (ask) to its other rows, between different
    labels: one for each asking row and label. Sketches first, then the full sets."""
    sets = [shingles(t) for t in block["text"]]
    odd = np.stack(block["odd"].to_list()).astype(np.int64) if "odd" in block else odd_sketches(np.stack([samples(s) for s in sets]))
    label = pd.factorize(block["label"])[0]
    sid = block["sid"].tolist()
    u, v = [], []
    for i, near in _plausible_rows(odd.view(np.uint64), np.array([len(s) for s in sets]), label, block["ask"].to_numpy(bool)):
        done = set()
        for j in near.tolist():
            if label[j] not in done and linked(sets[i], sets[j]):
                done.add(label[j])
                u.append(sid[i])
                v.append(sid[j])
    trim()
    return pd.DataFrame({"u": u, "v": v})


def _stray_links(crowded: DataFrame, found: DataFrame, sets: DataFrame, docs: DataFrame) -> DataFrame:
    """Links between members of a bucket that the first round left in different components.

    Only buckets of over three members can have a pair that has not met. Overlapping
    buckets form clusters; in each, the rows outside its largest component ask all rows
    of like size, in blocks of bounded size on either side."""
    named = crowded.where("members > 3").join(found.withColumnRenamed("node", "sid"), "sid", "left").withColumn("label", F.coalesce("label", "sid"))
    mixed = named.groupBy("bucket").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x <> y").select("bucket")
    left = cut(lookup(named, cut(mixed), ["bucket"], "inner", BROADCAST_ROWS).select("low", "sid", "label").distinct())
    clusters = components(left.select(F.col("low").alias("u"), F.col("sid").alias("v"))).select(F.col("node").alias("sid"), F.col("label").alias("cluster"))
    # Sizes of linked sets differ by a fifth at most: by a class of this logarithm.
    size_class = F.floor(F.log("n") / F.log(F.lit(DENOMINATOR / NUMERATOR))).cast("int")
    nodes = cut(left.select("sid", "label").distinct().join(clusters, "sid").join(sets.select("sid", "n", "odd"), "sid").withColumn("k", size_class))
    main = nodes.groupBy("cluster", "label").agg(F.count("*").alias("c")).groupBy("cluster").agg(F.max(F.struct("c", "label"))["label"].alias("main"))
    asking = lookup(nodes, cut(main), ["cluster"], "inner", BROADCAST_ROWS).where("label <> main").select("sid", "label", "cluster", "n", "odd", F.explode(F.array(F.col("k") - 1, F.col("k"), F.col("k") + 1)).alias("k"))
    parts = lambda rows, name: rows.groupBy("cluster", "k").agg(F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("n") / BLOCK_SHINGLES)).cast("int").alias(name))
    jobs = cut(parts(asking, "x_parts").join(parts(nodes, "y_parts"), ["cluster", "k"]))
    own = lambda c: F.pmod(F.xxhash64("sid"), F.col(c)).cast("int")
    every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    here = ["sid", "label", "cluster", "k", "n", "odd"]
    asks = lookup(asking, jobs, ["cluster", "k"], "inner", BROADCAST_ROWS).select(*here, F.lit(True).alias("ask"), own("x_parts").alias("x"), every("y_parts").alias("y"))
    others = lookup(nodes, jobs, ["cluster", "k"], "inner", BROADCAST_ROWS).select(*here, F.lit(False).alias("ask"), every("x_parts").alias("x"), own("y_parts").alias("y"))
    block = ["cluster", "k", "x", "y"]
    dealt = asks.unionByName(others)
    near = cut(dealt.groupBy(*block).applyInPandas(lambda b: block_near(b), dealt.schema))
    texts = _texts(near.select("sid").distinct(), sets, docs)
    return near.join(texts, "sid").groupBy(*block).applyInPandas(lambda b: block_links(b), "u binary, v binary")


def _roots(links: DataFrame) -> DataFrame:
    """node, label of the trees in which every v has one u, which is less: labels are roots. Each round
    takes a node twice as far up."""
    state = links.select(F.col("v").alias("node"), F.col("u").alias("label"))
    while True:
        up = state.select(F.col("node").alias("label"), F.col("label").alias("top"))
        moved = cut(state.join(up, "label", "left").select("node", F.coalesce("top", "label").alias("label"), F.col("top").isNotNull().alias("moved")))
        state = moved.drop("moved")
        if moved.where("moved").isEmpty():
            return state.unionByName(state.select(F.col("label").alias("node"), "label").distinct())


def _apart(pairs: DataFrame, found: DataFrame) -> DataFrame:
    """The pairs a, b that are not in one component."""
    label = lambda c: found.select(F.col("node").alias(c), F.col("label").alias(f"label_{c}"))
    told = pairs.join(label("b"), "b", "left").join(label("a"), "a", "left")
    return told.where(F.coalesce("label_a", "a") != F.coalesce("label_b", "b")).select("a", "b")


def _joined(found: DataFrame, links: DataFrame) -> DataFrame:
    """The components ``found`` (node, label) when further links u, v are known: only labels are joined."""
    if links.isEmpty():
        return found
    label = lambda c: found.select(F.col("node").alias(c), F.col("label").alias(f"label_{c}"))
    edges = links.join(label("u"), "u", "left").join(label("v"), "v", "left").select(F.coalesce("label_u", "u").alias("u"), F.coalesce("label_v", "v").alias("v"))
    over = components(edges)
    fresh = over.join(found, "node", "left_anti")
    moved = found.join(over.select(F.col("node").alias("label"), F.col("label").alias("top")), "label", "left").select("node", F.coalesce("top", "label").alias("label"))
    return cut(moved.unionByName(fresh))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every document, and its r1, r2."""
    docs = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    rows = cut(signatures(docs))
    some = rows.where("n > 0")
    sets = cut(some.groupBy("sid").agg(F.count("*").alias("copies"), F.min("doc_id").alias("first_doc"), F.min(F.struct("r1", "r2")).alias("owner"), F.first("n").alias("n"), F.first("bands").alias("bands"), F.first("odd").alias("odd")))
    dealt = sets.select("sid", F.explode("bands").alias("bucket"))
    buckets = cut(dealt.groupBy("bucket").agg(F.count("*").alias("members"), F.min("sid").alias("low"), F.max("sid").alias("high")).where("members > 1"))
    crowded = cut(join_uneven(dealt, buckets, "bucket", "members", HOT, BROADCAST_ROWS))

    # Round one, one pair a member: with the least of all first members of its buckets.
    first = crowded.where("sid <> low").groupBy("sid").agg(F.min("low").alias("a")).select("a", F.col("sid").alias("b"))
    found = _roots(cut(_confirm(_plausible(first, sets), sets, docs)))
    # Round two, the first and last members of all its buckets, where they are still apart.
    to_low = crowded.where("sid <> low").select(F.col("low").alias("a"), F.col("sid").alias("b"))
    to_high = crowded.where("sid <> high AND sid <> low").select(F.col("high").alias("a"), F.col("sid").alias("b"))
    stars = to_low.unionByName(to_high).distinct().join(first, ["a", "b"], "left_anti")
    found = _joined(found, cut(_confirm(_plausible(_apart(stars, found), sets), sets, docs)))
    # Round three, whoever in a bucket has not met.
    found = _joined(found, cut(_stray_links(crowded, found, sets, docs)))

    firsts = sets.select("sid", "first_doc")
    grouped = found.join(firsts, found["node"] == firsts["sid"]).select("sid", "label", "first_doc")
    least = grouped.groupBy("label").agg(F.min("first_doc").alias("component_id"))
    named = grouped.join(least, "label").select("sid", "component_id")
    named = cut(sets.select("sid", "first_doc", "copies").join(named, "sid", "left").select("sid", "copies", F.coalesce("component_id", "first_doc").alias("component_id")))
    mine = rows.select("doc_id", "r1", "r2", "n", "sid")
    component = F.col("component_id")
    out = join_uneven(mine.where("n > 0"), named, "sid", "copies", HOT, BROADCAST_ROWS).unionByName(mine.where("n = 0").withColumns({"copies": F.lit(1).cast("long"), "component_id": F.col("doc_id")}))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"), "r1", "r2")


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """``docs`` with one document of each group; same columns."""
    gone = cut(near_duplicates(docs).where("not kept").select("r1", "r2").distinct())
    if gone.count() <= BROADCAST_ROWS:
        gone = F.broadcast(gone)
    with_ids = docs.withColumns({"r1__": _row_id(1), "r2__": _row_id(2)})
    return with_ids.join(gone.select(F.col("r1").alias("r1__"), F.col("r2").alias("r2__")), ["r1__", "r2__"], "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
