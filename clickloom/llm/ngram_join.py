"""Similarity join of word-shingle sets (Jaccard 3/4 or more) by universe partition and pigeonhole.

Two sets of d and e shingles with that similarity differ in at most (d+e)/7
shingles.  Shingles are hashed into segments, as many as suit the size band;
if a set has more non-empty segments than that bound, one of them is equal in
both sets.  In small bands a segment also has its one-deletion neighbourhood,
which finds segments that differ in one shingle and so counts twice.

Which segments a set relies on is allocated by cost, the number of other sets
a segment meets.  Segments that meet nobody cost nothing: a set that has enough
of these has no partner and leaves (as nearly all do, however common the
passages in them).  The rest probe their cheapest segments.  Sets that cannot
reach the bound (chance crowds their few shingles into few segments) are joined
among themselves by prefixes.

Segments of large bands travel as packed numbers, five bytes each, in one
shuffle.  Equal sets are one node.  Candidates are verified on the sets: some
rounds of one partner per node, the hub of those it shares segments with, then
all pairs that still lie in different components, so a large group of copies
costs links in proportion to its size, not pairs.  Parity sketches turn away
most of these pairs where they meet, before their sets are moved.  Segments
have one order, and each brings those its set has shortly before it: two sets
that share one of these have met there and need not meet again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from clickloom.llm.common import binary, checked_broadcast, components, exchange, freed, from_planes, keyed, materialize, partitions, pieces, planes, small_batches, table
from clickloom.llm.shingles import mix, shingle_set
from clickloom.plans.registry import Query

#: Least set size of each band: 1, then at least 16/9 of the one before.
BANDS = [1]
while BANDS[-1] < 1 << 40:
    BANDS.append(-(-BANDS[-1] * 16 // 9))
#: Bands that start below this size use one-deletion neighbourhoods.
SMALL = 32
#: Segments per shingle of the largest set that a space serves.
DENSITY = 0.42
#: Packed segments a task holds before it hands them on.
HELD = 250_000
#: Parts of a bucket, by signature, that are sorted one after the other (a power of two).
SLICES = 8
#: Rounds of one partner each before all pairs still apart are compared.
ROUNDS = 3
#: Segments of a set ahead of one of its own that go along with it, to tell pairs that have met there.
RECENT = 8

_low = np.uint64((1 << 40) - 1)


def largest_partner(n: int) -> int:
    return 4 * n // 3


#: Larger sets have no place in a small band.
LARGEST_SMALL = largest_partner(next(b for b in BANDS if b >= SMALL) - 1)


def need(n: int) -> int:
    """Segments a set must rely on: one more than it can differ from any partner."""
    return (n + largest_partner(n)) // 7 + 1


def spaces(n: int) -> list[int]:
    """The set's own band, and the band below if a set there can be its partner."""
    k = int(np.searchsorted(BANDS, n, side="right")) - 1
    return [k] if k == 0 or n > largest_partner(BANDS[k] - 1) else [k, k - 1]


def segments(k: int) -> int:
    return int(DENSITY * largest_partner(BANDS[k + 1] - 1)) + 2


def _signature(sums: np.ndarray, segment: np.ndarray, k: int) -> np.ndarray:
    return mix(mix(sums) + segment.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(k + 1))


def _spread(shingles: np.ndarray) -> np.ndarray:
    return mix(shingles + np.uint64(1)) >> np.uint64(32)


def _places(spread: np.ndarray, k: int) -> np.ndarray:
    return ((spread * np.uint64(segments(k))) >> np.uint64(32)).view(np.int64)


def signatures(shingles: np.ndarray, ks: list[int]) -> Iterator[np.ndarray]:
    """The signatures of ``cut`` in several spaces, without a sort: sums by halves of 32 bits, exact as doubles."""
    spread, weight = _spread(shingles), mix(shingles)
    low, high = (weight & np.uint64(0xFFFFFFFF)).astype(float), (weight >> np.uint64(32)).astype(float)
    for k in ks:
        at = _places(spread, k)
        used = np.flatnonzero(np.bincount(at))
        sums = np.bincount(at, low)[used].astype(np.uint64) + (np.bincount(at, high)[used].astype(np.uint64) << np.uint64(32))
        yield _signature(sums, used, k)


def cut(shingles: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Segments of a set in space k: (number, signature, size) each, and the sums behind them by shingle."""
    at = _places(_spread(shingles), k)
    order = np.argsort(at, kind="stable")
    at, weight = at[order], mix(shingles[order])
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    sums = np.add.reduceat(weight, first)
    size = np.diff(np.append(first, len(at)))
    without = np.repeat(sums, size) - weight
    return at[first], _signature(sums, at[first], k), size, without


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Size and identity of each set, the units it could rely on per space, and prefixes where these are too few."""
    for batch in pieces(batches):
        out = []
        for row, doc_id, text in zip(batch["row"].to_pylist(), batch["doc_id"].to_pylist(), binary(batch["text"])):
            s = shingle_set(text)
            n, raw = len(s), s.tobytes()
            units, prefix, spread = [], None, _spread(s)
            for k in spaces(n) if n else []:
                size = np.bincount(_places(spread, k))
                units.append(int((size > 0).sum()) + (int((size > 1).sum()) if BANDS[k] < SMALL else 0))
                if units[-1] < need(n):
                    prefix = s[: n - -(-3 * n // 4) + 1].view(np.int64).tolist()
            out.append((row, doc_id, n, xxhash.xxh3_128_digest(raw), units, prefix))
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int32()), pa.list_(pa.int64())]
        columns = zip(*out) if out else [[]] * 6
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], ["row", "doc_id", "n", "identity", "units", "prefix"])


def _packed(buckets: int):
    """Signatures of large bands as blocks: (space, bucket) with low 40 bits and rows, packed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, counts, ks, held, n_held = [], [], [], [], 0

        def flush() -> pa.RecordBatch:
            sig, row, k = np.concatenate(held), np.repeat(rows, counts), np.repeat(ks, counts)
            bucket = (sig >> np.uint64(40)) % np.uint64(buckets)
            order = np.lexsort((k, bucket))
            sig, row, k, bucket = sig[order] & _low, row[order], k[order], bucket[order]
            first = np.flatnonzero(np.concatenate([[True], (bucket[1:] != bucket[:-1]) | (k[1:] != k[:-1])]))
            payload = []
            for a, b in zip(first, np.append(first[1:], len(sig))):
                low = sig[a:b]
                payload.append(low.astype("<u4").tobytes() + (low >> np.uint64(32)).astype(np.uint8).tobytes() + planes(row[a:b]))
            arrays = [pa.array(bucket[first].astype(np.int32)), pa.array(k[first].astype(np.int32)), pa.array(payload, pa.binary())]
            return pa.RecordBatch.from_arrays(arrays, ["bucket", "space", "payload"])

        for batch in pieces(batches):
            for row, text in zip(batch["row"].to_pylist(), binary(batch["text"])):
                s = shingle_set(text)
                large = [k for k in spaces(len(s)) if BANDS[k] >= SMALL] if len(s) else []
                for k, sig in zip(large, signatures(s, large)):
                    rows.append(row), counts.append(len(sig)), ks.append(k), held.append(sig)
                    n_held += len(sig)
                if n_held >= HELD:
                    yield flush()
                    rows, counts, ks, held, n_held = [], [], [], [], 0
        if held:
            yield flush()

    return run


UNITS = "row long, space int, unit long, kind int, form int, wide int, sig long, cost long"


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Signatures of one partition's buckets that more than one row has, with the number of other rows."""
    keys, sigs, rows = [], [], []
    for batch in batches:
        for bucket, space, payload in zip(batch["bucket"].to_pylist(), batch["space"].to_pylist(), batch["payload"]):
            raw = np.frombuffer(payload.as_buffer(), np.uint8)  # read where it lies
            n = len(raw) // 13
            sig = raw[: 4 * n].view("<u4").astype(np.uint64) | (raw[4 * n : 5 * n].astype(np.uint64) << np.uint64(32))
            sigs.append(sig | (np.uint64(bucket) << np.uint64(40)))
            rows.append(from_planes(raw[5 * n :]))
            keys.append(np.full(n, space, np.int8))
    if not sigs:
        return
    sig, row, space = np.concatenate(sigs), np.concatenate(rows), np.concatenate(keys)
    del sigs, rows, keys, raw, payload, batch
    pa.default_memory_pool().release_unused()
    for part in range(SLICES):
        at = np.flatnonzero(sig & np.uint64(SLICES - 1) == np.uint64(part))
        at = at[np.argsort(sig[at])]
        again = sig[at[1:]] == sig[at[:-1]]
        at = at[np.append(again, False) | np.append(False, again)] if len(at) else at  # the rest meets nobody
        if not len(at):
            continue
        at = at[np.lexsort((row[at], space[at], sig[at]))]
        first = np.flatnonzero(np.append(True, (sig[at[1:]] != sig[at[:-1]]) | (space[at[1:]] != space[at[:-1]])))
        size = np.diff(np.append(first, len(at)))
        many = np.repeat(size, size)
        at, many = at[many > 1], many[many > 1]
        for start in range(0, len(at), 200_000):
            x, cost = at[start : start + 200_000], many[start : start + 200_000].astype(np.int64) - 1
            s = sig[x].view(np.int64)
            zero = np.zeros(len(x), np.int32)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c) for c in (row[x], space[x].astype(np.int32), s, zero, zero, zero, s, cost)],
                ["row", "space", "unit", "kind", "form", "wide", "sig", "cost"],
            )


def _small(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Signatures of small bands: each segment's own (form 0) and those of it without one shingle (form 1)."""
    for batch in pieces(batches):
        out = [[], [], [], [], [], []]
        for row, text in zip(batch["row"].to_pylist(), binary(batch["text"])):
            s = shingle_set(text)
            for k in (k for k in spaces(len(s)) if len(s) and BANDS[k] < SMALL):
                at, sig, size, without = cut(s, k)
                more = np.repeat(size > 1, size)
                seg = np.concatenate([at, np.repeat(at, size)[more]])
                less = _signature(without, np.repeat(at, size), k)[more]
                for column, values in zip(out, ([row] * len(seg), [k] * len(seg), seg.tolist(), [0] * len(at) + [1] * len(less), (size > 1).astype(int).tolist() + [1] * len(less), np.concatenate([sig, less]).view(np.int64).tolist())):
                    column += values
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds)], ["row", "space", "unit", "form", "wide", "sig"])


def _small_units(docs: DataFrame) -> DataFrame:
    """Units of small bands that meet others: kind 0 an equal segment, kind 1 one that differs in one shingle."""
    sigs = materialize(docs.select("row", "text").mapInArrow(freed(_small), "row long, space int, unit long, form int, wide int, sig long"), "small-segments")
    met = sigs.groupBy("space", "sig").agg(F.sum(F.when(F.col("form") == 0, 1).otherwise(0)).alias("own"), F.sum("form").alias("less"))
    met = met.where("own > 0 AND own + less > 1")
    found = sigs.join(met, ["space", "sig"])
    equal = found.where("form = 0 AND own > 1").select("row", "space", "unit", F.lit(0).alias("kind"), "form", "wide", "sig", (F.col("own") - 1).alias("cost"))
    near = found.where("(form = 0 AND less > 0) OR form = 1").select("row", "space", "unit", F.lit(1).alias("kind"), "form", "wide", "sig", F.when(F.col("form") == 0, F.col("less")).otherwise(F.col("own")).alias("cost"))
    return equal.union(near)


def _allocate(units: DataFrame, nodes: DataFrame) -> DataFrame:
    """Units of the sets that cannot rely on free ones, each with ``probe``: whether the set relies on it."""
    # a neighbourhood is no cheaper than its own segment, so that it is never relied on without it
    wider = units.where("kind = 0 AND wide = 1").withColumn("kind", F.lit(1)).withColumn("cost", F.lit(0).cast("long"))
    units = units.drop("wide").union(wider.drop("wide"))
    large = F.col("space") >= sum(b < SMALL for b in BANDS)
    # a large band has one row a unit
    met = units.groupBy("row", "space").agg(F.sum(F.when(large, 1).otherwise(0)).alias("large"), F.count_distinct(F.when(~large, F.struct("unit", "kind"))).alias("small"))
    need_of = F.floor((F.col("n") + F.floor(4 * F.col("n") / 3)) / 7) + 1
    own = F.when(F.col("space") == _band("n"), F.get("units", F.lit(0))).otherwise(F.get("units", F.lit(1)))
    still = met.join(nodes.select("row", "n", "units"), "row").select("row", "n", "space", (need_of - own + F.col("large") + F.col("small")).alias("still"))
    still = checked_broadcast(materialize(still.where("still > 0"), "still"))
    left = units.join(still, ["row", "space"]).groupBy("row", "n", "space", "still", "unit", "kind", "form", "sig").agg(F.max("cost").alias("cost"))
    one, both = Window.partitionBy("row", "space", "unit"), Window.partitionBy("row", "space")
    priced = left.withColumn("price", F.sum("cost").over(Window.partitionBy("row", "space", "unit", "kind")))
    priced = priced.withColumn("price", F.when(F.col("kind") == 1, F.max("price").over(one)).otherwise(F.col("price")))
    turn = F.dense_rank().over(both.orderBy("price", "kind", "unit"))
    return priced.select(F.col("row").alias("node"), "n", "space", "kind", "form", "sig", "cost", (turn <= F.col("still")).alias("probe"))


def _partners(equal: DataFrame, tried: DataFrame | None) -> DataFrame:
    """(a, b): for each set b the one it shares most relied-on signatures with, of one hub per signature.

    ``equal``: space, sig, node, n, probe, weight, component.  The hub is the
    set that meets most others: of a group of copies, the one edited least.
    """
    hubs = equal.groupBy("space", "sig").agg(
        F.max(F.struct("weight", (-F.col("node")).alias("node"), "n", "component")).alias("hub"), F.max("probe").alias("any"),
        F.min("component").alias("least"), F.max("component").alias("most"),
    )
    hubs = hubs.where("any AND least < most").select("space", "sig", (-F.col("hub.node")).alias("a"), F.col("hub.n").alias("m"), F.col("hub.component").alias("hub_component"))
    stars = equal.join(hubs, ["space", "sig"]).where((F.col("component") != F.col("hub_component")) & _fits("m", "n"))
    shared = stars.groupBy("a", F.col("node").alias("b")).agg(F.count("*").alias("shared"))
    if tried is not None:
        # written first: Spark would otherwise look up every shared segment instead of every pair
        shared = materialize(shared, "shared").join(tried, ["a", "b"], "left_anti")
    best = shared.groupBy("b").agg(F.max(F.struct("shared", (-F.col("a")).alias("a"))).alias("best"))
    return materialize(best.select((-F.col("best.a")).alias("a"), "b"), "partners")


def _band(n: str):
    """Number of the band of a size."""
    out = F.lit(0)
    for k, least in enumerate(BANDS[1:], 1):
        out = F.when(F.col(n) >= least, k).otherwise(out)
    return out


def _similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = []
        for a, b in zip(batch["left_set"].to_pylist(), batch["right_set"].to_pylist()):
            x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
            common = len(np.intersect1d(x, y, assume_unique=True))
            keep.append(100 * common >= 75 * (len(x) + len(y) - common))
        yield pa.RecordBatch.from_arrays([batch["a"], batch["b"]], ["a", "b"]).filter(pa.array(keep, pa.bool_()))


def sketch(shingles: np.ndarray) -> np.ndarray:
    """512 parity bits: two sets differ in at least as many shingles as their sketches differ in bits."""
    at = (mix(shingles + np.uint64(2)) >> np.uint64(55)).astype(np.int64)
    return np.packbits(np.bincount(at, minlength=512).astype(np.uint8) & 1).view(np.int64)


SKETCH = [f"bits_{i}" for i in range(8)]
SETS = "node long, set binary, " + ", ".join(f"{c} long" for c in SKETCH)


def _set_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches):
        sets = [shingle_set(t) for t in binary(batch["text"])]
        bits = np.array([sketch(s) for s in sets], np.int64).reshape(-1, 8)
        yield pa.RecordBatch.from_arrays([batch["row"], pa.array([s.tobytes() for s in sets], pa.binary()), *(pa.array(bits[:, i]) for i in range(8))], ["node", "set", *SKETCH])


def _verify(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    left = sets.select(F.col("node").alias("a"), F.col("set").alias("left_set"))
    right = sets.select(F.col("node").alias("b"), F.col("set").alias("right_set"))
    return materialize(pairs.join(left, "a").join(right, "b").mapInArrow(freed(_similar), "a long, b long"), "links")


def _fits(left: str, right: str):
    return 4 * F.least(left, right) >= 3 * F.greatest(left, right)


def _ahead(rows: DataFrame) -> DataFrame:
    """Adds ``ahead``: the last RECENT segments of the set before this one, and ``ahead_probe``: those it relies on.

    Segments of many sets come first: two sets that share this one then mostly share one of the last.
    """
    last = Window.partitionBy("node").orderBy("kind", "space", F.desc("size"), "sig", "form").rowsBetween(-RECENT, -1)
    return rows.withColumns({"ahead": F.collect_list("sig").over(last), "ahead_probe": F.collect_list(F.when(F.col("probe"), F.col("sig"))).over(last)})


def _meetings(named: DataFrame, sketches: DataFrame) -> DataFrame:
    """(a, b): sets of different components that a common segment, relied on by one of them, leaves possible; a few rows a pair.

    ``named``: space, sig, kind, node, n, form, probe, component.  A pair comes
    from the first such segment at the latest: nothing ahead of it turns it away.
    """
    apart = named.groupBy("space", "sig", "kind").agg(F.min("component").alias("least"), F.max("component").alias("most"), F.max("probe").alias("any"), F.count("*").alias("size"))
    apart = apart.where("any AND least < most").select("space", "sig", "kind", "size")
    left = _ahead(named.join(apart, ["space", "sig", "kind"])).join(sketches, "node").select("space", "sig", "kind", "node", "n", "form", "probe", "component", "ahead", "ahead_probe", *SKETCH)
    right = left.select("space", "sig", "kind", *(F.col(c).alias(f"right_{c}") for c in ("node", "n", "form", "probe", "component", "ahead", "ahead_probe", *SKETCH)))
    apart_bits = sum((F.bit_count(F.col(c).bitwiseXOR(F.col(f"right_{c}"))) for c in SKETCH), F.lit(0))
    met = left.join(right, ["space", "sig", "kind"]).where(
        (F.col("component") != F.col("right_component"))
        & (F.col("probe") | F.col("right_probe"))
        & ((F.col("kind") == 0) & (F.col("node") < F.col("right_node")) | (F.col("kind") == 1) & (F.col("form") < F.col("right_form")))
        & _fits("n", "right_n")
        & (7 * apart_bits <= F.col("n") + F.col("right_n"))  # more differing bits: too many differing shingles
        & ((F.col("kind") == 1) | ~(F.arrays_overlap("ahead_probe", "right_ahead") | F.arrays_overlap("ahead", "right_ahead_probe")))
    )
    return met.select(F.least("node", "right_node").alias("a"), F.greatest("node", "right_node").alias("b"))


@small_batches
def similarity_classes(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id (least doc_id reachable over links), one row per input row.

    Words: A-Z lower-cased, split at ASCII white space.  Shorter texts are one
    shingle, null and blank texts have none and no links.  Equal texts are
    linked.  Rows that share a doc_id, or lack one, count each for itself; a
    class without any doc_id has a null component_id.
    """
    spark = docs.sparkSession
    docs = keyed(docs)
    sets = materialize(docs.select("row", "doc_id", "text").mapInArrow(freed(_sets), "row long, doc_id long, n long, identity binary, units array<int>, prefix array<long>"), "sets")
    same = sets.where("n > 0").groupBy("identity").agg(F.min("row").alias("node"), F.count("*").alias("rows")).where("rows > 1")
    nodes = materialize(sets.join(same.drop("rows"), "identity", "left").withColumn("node", F.coalesce("node", "row")).drop("identity"), "nodes")

    buckets = partitions(spark)
    copies = checked_broadcast(materialize(nodes.where("row <> node").select("row"), "copies"))
    single = docs.select("row", "text").join(copies, "row", "left_anti")
    small = nodes.where((F.col("n") > 0) & (F.col("n") <= LARGEST_SMALL) & (F.col("row") == F.col("node"))).select("row")
    few = docs.select("row", "text").join(checked_broadcast(materialize(small, "small")), "row", "left_semi")
    blocks = single.mapInArrow(freed(_packed(buckets)), "bucket int, space int, payload binary")
    units = materialize(exchange(blocks).mapInArrow(freed(_met), UNITS).union(_small_units(few)), "units")
    relied = materialize(_allocate(units, nodes), "relied")
    equal = relied.where("kind = 0").select("space", "sig", "node", "n", "probe", "cost")
    weight = relied.where("kind = 0").groupBy("node").agg(F.sum("cost").alias("weight"))
    equal = materialize(equal.drop("cost").join(weight, "node"), "equal")

    prefixes = nodes.where("prefix IS NOT NULL AND row = node").select("node", "n", F.explode("prefix").alias("token"))
    other = prefixes.select(F.col("node").alias("b"), F.col("n").alias("m"), "token")
    crowded = prefixes.join(other, "token").where((F.col("node") < F.col("b")) & _fits("n", "m")).select(F.col("node").alias("a"), "b").distinct()
    needed = relied.select(F.col("node").alias("row")).union(prefixes.select(F.col("node").alias("row"))).distinct()
    needed = checked_broadcast(materialize(needed, "needed"))
    tokens = materialize(docs.select("row", "text").join(needed, "row", "left_semi").mapInArrow(freed(_set_rows), SETS), "token-sets")

    # one partner each, again while that links most of those still apart
    best = _partners(equal.withColumn("component", F.col("node")), None)
    links, tried = _verify(best.union(crowded), tokens), best
    label = components(links)
    for _ in range(ROUNDS - 1):
        apart = equal.join(label, "node", "left").withColumn("component", F.coalesce("component", "node"))
        best = _partners(apart, tried)
        more = _verify(best, tokens)
        tried = tried.union(best)
        if more.isEmpty():
            break
        links = links.union(more)
        label = components(links)

    # every pair that relies on a common segment and is still apart
    named = materialize(relied.drop("cost").join(label, "node", "left").withColumn("component", F.coalesce("component", "node")), "named")
    pairs = _meetings(named, tokens.drop("set")).distinct()
    done = tried.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    pairs = materialize(pairs, "pairs")  # as in _partners
    more = _verify(pairs.join(done, ["a", "b"], "left_anti"), tokens)
    label = label if more.isEmpty() else components(links.union(more))

    found = nodes.join(label, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = found.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    return found.join(least, "component").select("doc_id", F.col("n").alias("n_shingles"), "component_id", "row")


def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity_classes(table(spark, sf_dir, "documents")).drop("row")


QUERIES: dict[str, tuple[Query, str | None]] = {"op7_ngram_join": (op7_ngram_join, None)}
