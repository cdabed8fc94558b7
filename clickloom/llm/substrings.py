"""Every byte of a 100-byte string that also starts earlier is removed, by suffix arrays over shards.

Two equal strings of ``LENGTH`` bytes have the same least hash among their
``GRAM``-byte pieces, so only runs of positions whose least hash occurs twice
can repeat; all others never leave the scan.  Runs with one least hash meet in
a shard; a hash with more than ``SPLIT`` runs is dealt over several.  A shard
drops runs that repeat whole, sorts the suffixes of the rest (Larsson-Sadakane
refinement), finds common prefixes (Kasai, one lane a run), and keeps the
earliest of each class of equal strings.  What the shards of a split hash kept
is merged: their sorted strings are searched by bisection in one directory.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clickloom.llm.common import binary, exchange, from_planes, keyed, materialize, partitions, planes, table
from clickloom.llm.shingles import mix
from clickloom.plans.registry import Query

LENGTH, GRAM = 100, 32
#: Positions of a run at most, bytes hashed at a time, runs that a task holds before it hands them on.
RUN, PIECE, HELD = 512, 1 << 21, 2_000_000
#: Runs with one least hash that one shard takes, and bytes of runs whose suffixes are sorted together.
SPLIT = 4096
#: Buckets of a partition.
SPREAD = 8


def least_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every start of a LENGTH-byte string the least hash of its GRAM-byte pieces, and where the first such piece starts."""
    h, size, factor = data.astype(np.uint64) + np.uint64(1), 1, 0x9E3779B97F4A7C15
    while size < GRAM:
        h = h[:-size] * np.uint64(factor) + h[size:]
        size, factor = 2 * size, factor * factor % (1 << 64)
    h, at, size, span = mix(h), np.arange(len(data) - GRAM + 1, dtype=np.int32), 1, LENGTH - GRAM + 1
    while size < span:
        step = min(size, span - size)
        left = h[:-step] <= h[step:]
        h, at, size = np.where(left, h[:-step], h[step:]), np.where(left, at[:-step], at[step:]), size + step
    return h, at


def runs_of(texts: list[bytes]) -> tuple[np.ndarray, ...]:
    """Runs of string starts with one least hash: (number of the text, first start, starts, hash, whether the piece
    with this hash occurs twice in the run, so that the run may repeat itself)."""
    parts = [(i, a, t[a : a + PIECE + LENGTH - 1]) for i, t in enumerate(texts) for a in range(0, max(0, len(t) - LENGTH + 1), PIECE)]
    out, group, size = [], [], 0
    for part in [*parts, None]:
        if group and (part is None or size + len(part[2]) > PIECE):
            data = np.frombuffer(b"".join(p[2] for p in group), np.uint8)
            least, at = least_hashes(data)
            ends = np.cumsum([len(p[2]) for p in group])
            begins = ends - [len(p[2]) for p in group]
            valid = np.zeros(len(least) + 1, bool)
            fresh = np.ones(len(least) + 1, bool)
            fresh[1:-1] = least[1:] != least[:-1]
            for a, b in zip(begins, ends):
                valid[a : b - LENGTH + 1] = True
                fresh[a] = fresh[b - LENGTH + 1] = True
            first = np.flatnonzero(fresh)
            n = np.diff(first)
            moves = np.concatenate([[0], np.cumsum(at[1:] != at[:-1])])
            inner = moves[first[1:] - 1] > moves[first[:-1]]
            first = first[:-1]
            first, n, inner = first[valid[first]], n[valid[first]], inner[valid[first]]
            if (n > RUN).any():  # cut long runs
                cuts = -(-n // RUN)
                turn = np.arange(cuts.sum()) - np.repeat(np.cumsum(cuts) - cuts, cuts)
                first, n, inner = np.repeat(first, cuts) + turn * RUN, np.minimum(RUN, np.repeat(n, cuts) - turn * RUN), np.repeat(inner, cuts)
            part_of = np.searchsorted(ends, first, side="right")
            text = np.array([p[0] for p in group])[part_of]
            start = first - begins[part_of] + np.array([p[1] for p in group])[part_of]
            out.append((text, start, n, least[first], inner))
            group, size = [], 0
        if part is not None:
            group.append(part)
            size += len(part[2])
    if not out:
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64), np.zeros(0, bool))
    return tuple(np.concatenate(x) for x in zip(*out))


def _packed(buckets: int):
    """All runs as blocks by bucket of their hash: low 40 bits, row, start, length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n_held = [], 0

        def flush() -> pa.RecordBatch:
            row, start, n, h = (np.concatenate(x) for x in zip(*held))
            bucket = (h >> np.uint64(40)) % np.uint64(buckets)
            order = np.argsort(bucket, kind="stable")
            row, start, n, h, bucket = row[order], start[order], n[order], h[order] & np.uint64((1 << 40) - 1), bucket[order]
            first = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
            payload = []
            for a, b in zip(first, np.append(first[1:], len(h))):
                low = h[a:b]
                payload.append(low.astype("<u4").tobytes() + (low >> np.uint64(32)).astype(np.uint8).tobytes() + n[a:b].astype("<u2").tobytes() + planes(row[a:b]) + planes(start[a:b]))
            return pa.RecordBatch.from_arrays([pa.array(bucket[first].astype(np.int32)), pa.array(payload, pa.binary())], ["bucket", "payload"])

        for batch in batches:
            rows = batch["row"].to_numpy()
            text, start, n, h, inner = runs_of(binary(batch["text"]))
            if len(h):
                held.append((rows[text], start, n + (inner << 15), h))  # the high bit of 16: the run may repeat itself
                n_held += len(h)
            if n_held >= HELD:
                yield flush()
                held, n_held = [], 0
        if held:
            yield flush()

    return run


HITS = "row long, start long, n int, hash long, shards int, inner boolean"


def _repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs whose hash occurs twice, with the number of shards that the hash is dealt over."""
    parts = []
    for batch in batches:
        for bucket, payload in zip(batch["bucket"].to_pylist(), batch["payload"].to_pylist()):
            raw, k = np.frombuffer(payload, np.uint8), len(payload) // 23
            h = raw[: 4 * k].view("<u4").astype(np.uint64) | (raw[4 * k : 5 * k].astype(np.uint64) << np.uint64(32)) | (np.uint64(bucket) << np.uint64(40))
            parts.append((h, raw[5 * k : 7 * k].view("<u2"), from_planes(raw[7 * k : 15 * k]), from_planes(raw[15 * k :])))
    if not parts:
        return
    h, n, row, start = (np.concatenate(x) for x in zip(*parts))
    parts.clear()
    order = np.argsort(h, kind="stable")
    h, inner = h[order], n[order] >> 15 == 1
    first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
    size = np.diff(np.append(first, len(h)))
    many = np.repeat(size, size)
    keep = np.flatnonzero((many > 1) | inner)
    for at in range(0, len(keep), 200_000):
        x = keep[at : at + 200_000]
        y = order[x]
        shards = -(-many[x] // SPLIT)
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in (row[y], start[y], (n[y] & 0x7FFF).astype(np.int32), h[x].view(np.int64), shards.astype(np.int32), inner[x])], ["row", "start", "n", "hash", "shards", "inner"])


SLICES = "shard long, hash long, shards int, inner boolean, doc_id long, row long, start long, slice binary"


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of every repeated run, with the shard it is dealt to."""
    for batch in batches:
        for lo in range(0, batch.num_rows, 256):
            out = []
            part = batch.slice(lo, 256)
            for row, doc_id, text, hits in zip(part["row"].to_pylist(), part["doc_id"].to_pylist(), binary(part["text"]), part["hits"].to_pylist()):
                for x in hits:
                    turn = row % x["shards"]
                    out.append((x["hash"] + turn * 1_000_003, x["hash"], x["shards"], x["inner"], doc_id, row, x["start"], text[x["start"] : x["start"] + x["n"] + LENGTH - 1]))
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 8, kinds)], [c.split()[0] for c in SLICES.split(", ")])


def suffix_array(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(suffixes in order, rank of each) by Larsson-Sadakane refinement: only groups still unsorted are sorted again."""
    n = len(data)
    padded = np.concatenate([data.astype(np.uint64) + np.uint64(1), np.zeros(7, np.uint64)])
    key = np.zeros(n, np.uint64)
    for i in range(7):  # 9 bits a byte, so that the end sorts first
        key = (key << np.uint64(9)) | padded[i : i + n]
    order = np.argsort(key, kind="stable")
    new = np.concatenate([[True], key[order][1:] != key[order][:-1]]) if n else np.zeros(0, bool)
    starts = np.flatnonzero(new)
    rank = np.empty(n, np.int64)
    rank[order] = np.repeat(starts, np.diff(np.append(starts, n)))  # a group is named by its first place
    size = np.diff(np.append(starts, n))
    active = np.flatnonzero(np.repeat(size > 1, size))  # places whose group has more than one suffix
    h = 7
    while len(active):
        at = order[active]
        group = rank[at]
        after = np.where(at + h < n, rank[np.minimum(at + h, n - 1)] + 1, 0)
        by = np.argsort(group * (n + 1) + after, kind="stable")  # groups stay where they are
        at, group, after = at[by], group[by], after[by]
        order[active] = at
        new = np.concatenate([[True], (group[1:] != group[:-1]) | (after[1:] != after[:-1])])
        starts = np.flatnonzero(new)
        size = np.diff(np.append(starts, len(at)))
        rank[at] = np.repeat(active[starts], size)
        active = active[np.repeat(size > 1, size)]
        h *= 2
    return order, rank


def common_prefixes(data: np.ndarray, order: np.ndarray, rank: np.ndarray, starts: np.ndarray, longest: int = LENGTH) -> np.ndarray:
    """Kasai: by rank, the common prefix with the suffix before, at most ``longest``; lanes of text from ``starts`` go side by side."""
    n = len(data)
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    padded = np.concatenate([data.astype(np.int16), np.arange(-1, -longest - 2, -1, dtype=np.int16)])  # the end equals nothing
    ends = np.append(starts[1:], n)
    out = np.zeros(n, np.int64)
    have, at = np.zeros(len(starts), np.int64), starts.copy()
    lanes = np.arange(len(starts))
    while len(lanes):
        i = at[lanes]
        j = before[i]
        l = np.where(j >= 0, np.maximum(have[lanes] - 1, 0), 0)
        growing = np.flatnonzero((j >= 0) & (l < longest))
        while len(growing):
            more = padded[np.minimum(i[growing] + l[growing], n)] == padded[np.minimum(j[growing] + l[growing], n)]
            more &= (i[growing] + l[growing] < n) & (j[growing] + l[growing] < n)
            growing = growing[more]
            l[growing] += 1
            growing = growing[l[growing] < longest]
        out[rank[i]] = l
        have[lanes] = l
        at[lanes] += 1
        lanes = lanes[at[lanes] < ends[lanes]]
    return out


def _intervals(starts: np.ndarray) -> list[tuple[int, int]]:
    """Bytes that strings from these ascending starts cover, as runs."""
    if not len(starts):
        return []
    first = np.flatnonzero(np.concatenate([[True], np.diff(starts) > LENGTH]))
    last = np.append(first[1:], len(starts)) - 1
    return list(zip(starts[first].tolist(), (starts[last] + LENGTH).tolist()))


REMOVED = "row long, first long, last long, hash long, cut long, strings binary, origins binary"
_names = [c.split()[0] for c in REMOVED.split(", ")]
_kinds = [pa.int64()] * 5 + [pa.binary()] * 2


def sort_shard(slices: list[tuple]) -> tuple[list[tuple[int, int, int]], list[tuple]]:
    """Of (hash, shards, inner, doc_id, row, start, bytes): intervals (row, first, last) to remove, and for split hashes
    the strings kept, as (hash, sorted strings, doc_ids, rows, starts)."""
    origin = lambda x: (x[3] is not None, x[3] or 0, x[4], x[5])  # noqa: E731  rows without a doc_id come first
    removed, kept = [], {}
    for x in slices:  # runs that repeat whole
        seen = kept.get((x[0], x[6]))
        if seen is None or origin(x) < origin(seen):
            kept[x[0], x[6]] = x
            x = seen
        if x is not None:
            removed.append((x[4], x[5], x[5] + len(x[6])))
    by_hash: dict[int, int] = {}
    for h, _ in kept:
        by_hash[h] = by_hash.get(h, 0) + 1
    rest = [x for x in kept.values() if by_hash[x[0]] > 1 or x[1] > 1 or x[2]]
    if not rest:
        return removed, []
    lengths = np.array([len(x[6]) for x in rest])
    data = np.frombuffer(b"".join(x[6] for x in rest), np.uint8)
    starts = np.cumsum(lengths) - lengths
    order, rank = suffix_array(data)
    group = np.cumsum(common_prefixes(data, order, rank, starts) < LENGTH)  # by rank: equal strings have one number
    windows = lengths - LENGTH + 1
    lane = np.repeat(np.arange(len(rest)), windows)
    turn = np.arange(windows.sum()) - np.repeat(np.cumsum(windows) - windows, windows)
    here = starts[lane] + turn
    first_of = np.array([x[5] for x in rest])[lane] + turn
    by_origin = sorted(range(len(rest)), key=lambda i: origin(rest[i])[:3])
    place, last = np.empty(len(rest), np.int64), None
    for k, i in enumerate(by_origin):
        place[i] = k if last is None or origin(rest[i])[:3] != origin(rest[last])[:3] else place[last]
        last = i
    number = group[rank[here]]
    by = np.lexsort((first_of, place[lane], number))
    repeat = np.zeros(len(by), bool)
    # the same string of the same place may stand in two runs of a text; it repeats nothing then
    sorted_number, sorted_place, sorted_first = number[by], place[lane][by], first_of[by]
    head = np.concatenate([[True], sorted_number[1:] != sorted_number[:-1]])
    lead = np.flatnonzero(head)[np.cumsum(head) - 1]
    repeat[by] = (sorted_place != sorted_place[lead]) | (sorted_first != sorted_first[lead])
    bounds = np.append(np.cumsum(windows) - windows, windows.sum())
    for i in np.unique(lane[repeat]):
        own = slice(bounds[i], bounds[i + 1])
        removed += [(rest[i][4], a, b) for a, b in _intervals(first_of[own][repeat[own]])]
    split = []
    for h in {x[0] for x in rest if x[1] > 1}:
        mine = np.flatnonzero(np.array([x[0] == h for x in rest])[lane] & ~repeat)
        mine = mine[np.argsort(rank[here[mine]])]  # in the order of the suffix array
        strings = [data[a : a + LENGTH].tobytes() for a in here[mine]]
        split.append((h, strings, [rest[i][3] for i in lane[mine]], [rest[i][4] for i in lane[mine]], first_of[mine].tolist()))
    return removed, split


def _sorted(cuts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, shard = [], 0, None

        def done() -> pa.RecordBatch:
            removed, split = sort_shard(held)
            out = [(*x, None, None, None, None) for x in removed]
            for h, strings, docs, rows, starts in split:
                cut = np.array([hash_of(s) % cuts for s in strings])
                for c in np.unique(cut):
                    at = np.flatnonzero(cut == c)
                    origins = np.array([[-(1 << 62) if docs[i] is None else docs[i], rows[i], starts[i]] for i in at], "<i8")
                    out.append((None, None, None, h, int(c), b"".join(strings[i] for i in at), origins.tobytes()))
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 7, _kinds)], _names)

        for batch in batches:
            columns = [batch[c].to_pylist() for c in ("shard", "hash", "shards", "inner", "doc_id", "row", "start", "slice")]
            for s, *x in zip(*columns):
                if s != shard and size > PIECE:  # whole shards, until the bytes are enough for one suffix array
                    yield done()
                    held, size = [], 0
                shard = s
                held.append(tuple(x))
                size += len(x[-1])
        if held:
            yield done()

    return run


def hash_of(string: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(string, digest_size=6).digest(), "little")


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted strings of the shards of a split hash: all but the earliest of equal ones are removed."""
    lists: dict[tuple[int, int], list] = {}
    for batch in batches:
        for h, c, strings, origins in zip(*(batch[x].to_pylist() for x in ("hash", "cut", "strings", "origins"))):
            lists.setdefault((h, c), []).append((np.frombuffer(strings, f"V{LENGTH}"), np.frombuffer(origins, "<i8").reshape(-1, 3)))
    for found in lists.values():
        # void arrays neither sort nor compare in order: their hexadecimal text does both
        texts = [np.array([bytes(s).hex() for s in strings]) for strings, _ in found]
        directory = np.unique(np.concatenate(texts))
        number = np.concatenate([np.searchsorted(directory, t) for t in texts])
        origins = np.concatenate([o for _, o in found])
        by = np.lexsort((origins[:, 2], origins[:, 1], origins[:, 0], number))
        later = by[np.concatenate([[False], number[by][1:] == number[by][:-1]])]
        rows, starts = origins[later, 1], origins[later, 2]
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (rows, starts, starts + LENGTH)], ["row", "first", "last"])


def _cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["row", "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"]
    for batch in batches:
        out = []
        for row, doc_id, text, spans in zip(batch["row"].to_pylist(), batch["doc_id"].to_pylist(), binary(batch["text"]), batch["removed"].to_pylist()):
            runs: list[list[int]] = []
            for x in sorted((x["first"], x["last"]) for x in spans or []):
                if runs and x[0] <= runs[-1][1]:
                    runs[-1][1] = max(runs[-1][1], x[1])
                else:
                    runs.append([*x])
            kept = b"".join(text[a:b] for a, b in zip([0, *(r[1] for r in runs)], [*(r[0] for r in runs), len(text)]))
            out.append((row, doc_id, len(text), len(text) - len(kept), len(runs), hashlib.sha256(kept).hexdigest(), runs))
        kinds = [pa.int64()] * 5 + [pa.string(), pa.list_(pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 7, kinds)], names)


def repeated_strings(docs: DataFrame) -> DataFrame:
    """One row per input row: row, doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans (removed [first, last) runs).

    A string that starts twice stays where it starts first: in the smallest
    doc_id (none before any; rows of one doc_id by their written number), then
    at the earliest byte.  Null texts are empty.
    """
    spark = docs.sparkSession
    docs = keyed(docs)
    buckets = SPREAD * partitions(spark)
    blocks = docs.select("row", "text").mapInArrow(_packed(buckets), "bucket int, payload binary")
    hits = exchange(blocks).mapInArrow(_repeated, HITS)
    by_row = materialize(hits.groupBy("row").agg(F.collect_list(F.struct("start", "n", "hash", "shards", "inner")).alias("hits")), "repeated-runs")
    slices = docs.join(by_row, "row").select("row", "doc_id", "text", "hits").mapInArrow(_slices, SLICES)
    dealt = slices.repartition(partitions(spark), "shard").sortWithinPartitions("shard")
    found = materialize(dealt.mapInArrow(_sorted(partitions(spark)), REMOVED), "removed")
    split = found.where("row IS NULL").select("hash", "cut", "strings", "origins").repartition(partitions(spark), "hash", "cut")
    later = split.mapInArrow(_merged, "row long, first long, last long")
    removed = found.where("row IS NOT NULL").select("row", "first", "last").union(later)
    removed = materialize(removed.groupBy("row").agg(F.collect_list(F.struct("first", "last")).alias("removed")), "removed-by-row")
    out = "row long, doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<array<long>>"
    return docs.join(removed, "row", "left").select("row", "doc_id", "text", "removed").mapInArrow(_cut_out, out)


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_strings(table(spark, sf_dir, "documents")).drop("row", "spans")


QUERIES: dict[str, tuple[Query, str | None]] = {"op6_suffix_dedup": (op6_suffix_dedup, None)}
