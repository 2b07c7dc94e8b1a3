"""N-gram Jaccard join in the metric space of shingle sets.

Texts x and y link when 1 - |x & y| / |x | y| is 0.2 at most. Then the sets differ in a quarter of the shingles of either at
most, and |x ^ y|, the count of shingles that only one has, is a metric too; a parity map (the parity of a set's shingles on each of some
bits) bounds it from below, and the Hamming distance of maps is itself a metric. The steps:

1. Texts with equal sets form a class; all else runs on classes.
2. Two linked classes share a shingle among the first fifth of either's set, in any one order of all shingles; the order puts
   shingles of many texts last. Most texts are as far from each other as can be, so pivots are drawn where texts meet: each shared
   shingle names one of its classes, and a class takes the pivot that its shingles name most, if their maps are near. That
   makes Voronoi regions of near copies; a class without a pivot near is a region of its own.
3. Windows: a class that shares such a shingle with another region is replicated to it, unless by the triangle inequality (the map
   distance to its pivot is above the region's radius and what links may differ by) it has no link there.
4. Regions are joined exactly, each in a task, from whole sets; of a region's links those come out that connect it, so what comes
   out never outgrows what goes in. Regions too large for a task are parted around their pivot: members linked with it are connected
   already, only those further out but within twice the limit (the window) can have links to them, and the outer part is joined
   recursively around a pivot of its own.
5. Links connect classes to components.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import superkmers as S
from . import textkernel as K
from .components import components
from .shared import bucketed, forget, written

SHINGLE = 5
#: Two sets link when 100 * intersection >= PERCENT * union.
PERCENT = 80
#: What tells sets apart: size and two digests.
SAME = ["n", "d1", "d2"]
#: Shingles that come last in the order: HOT_TEXTS texts have them, repeated sets of a task's chunk counted once; HOT_MOST at most. It only decides the order, in which those of
#: the smallest hashes come first, so only hashes in this share of all are counted.
HOT_TEXTS, HOT_MOST, COUNTED = 8, 1 << 20, 0.22
CHUNK, DEALT = 3_000_000, 1_000_000
#: Keys per bucket of step 2, and bytes of text per bucket of counts.
BUCKET_KEYS, COUNT_BYTES = 500_000, 32 << 20
_SEEDS = K.mix(np.arange(1, 3, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
#: Bits of a shingle's hash that travel as a key.
KEY_BITS = 40
#: A class is in a pivot's region if their maps differ by this share of the smaller set at most. It only decides how well regions fit.
NEAR = 0.5
#: Regions that meet in one shingle beyond which its classes meet in one more region instead of in each other's.
MEETING = 32
#: Members and shingles of a region that a task joins; how often a larger one is parted before its parts are joined pair by pair, and the least share of members that must be linked with pivots for another time.
REGION_ROWS, REGION_SHINGLES, ROUNDS, PROGRESS = 8192, 2_000_000, 6, 0.05
#: Bits of the filter of texts to be fetched: 16 for each text, so many at most (16 MB); beyond that more texts pass, and none is lost.
FILTER_BITS = 27


def sets(block: K.Block, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The shingle sets of a block of lower-cased rows: row and hash of each shingle, by row and hash, and where each row begins."""
    words = K.tokens(block)
    hashes = K.word_hashes(block, words)
    at, value = K.window_hashes(hashes, words, k)
    row = words.row[at]
    count = np.diff(words.first)
    short = np.flatnonzero((count > 0) & (count < k))
    if len(short):
        row = np.concatenate([row, short])
        value = np.concatenate([value, K.span_hash(K.running(hashes), words.first[short], words.first[short + 1])])
    # by row and the upper bits first, which one sort of numbers does; equal there, yet not equal, is next to impossible
    bits = np.uint64(max(1, block.n.bit_length()))
    order = np.argsort(row.astype(np.uint64) << np.uint64(64) - bits | value >> bits)
    same = (value[order[1:]] >> bits == value[order[:-1]] >> bits) & (row[order[1:]] == row[order[:-1]])
    if (value[order[1:]] != value[order[:-1]])[same].any():
        order = np.lexsort((value, row))
    row, value = row[order], value[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (value[1:] != value[:-1])
    row, value = row[new], value[new]
    return row, value, np.searchsorted(row, np.arange(block.n + 1))


def _digests(value: np.ndarray, begins: np.ndarray, seed: int) -> np.ndarray:
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(K.mix(value ^ _SEEDS[seed]))])
    return total[begins[1:]] - total[begins[:-1]]


def _dealt(key: np.ndarray, buckets: int, *more: np.ndarray):
    """Blobs of keys and what goes with them, by bucket."""
    bucket = (key % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket.astype(np.uint64) << np.uint64(KEY_BITS) | key)
    key, bucket, more = key[order], bucket[order], [x[order] for x in more]
    names, head = np.unique(bucket, return_index=True)
    for b, x, y in zip(names, head, np.append(head[1:], len(bucket)), strict=True):
        blob = S.packed(np.diff(np.concatenate([[np.uint64(0)], key[x:y]])), *(m[x:y] for m in more))  # sorted keys go as steps
        yield pa.RecordBatch.from_arrays([pa.array([int(b)], pa.int64()), pa.array([blob], pa.binary())], ["bucket", "blob"])


def _counted(buckets: int):
    """Keys of small hashes and in how many texts each is, by bucket."""
    most = np.uint64(int(COUNTED * 2**64))

    def counts(parts):
        key = np.sort(np.concatenate(parts))
        head = np.flatnonzero(np.concatenate([np.ones(min(1, len(key)), bool), key[1:] != key[:-1]]))
        return _dealt(key[head], buckets, np.diff(np.append(head, len(key))).astype(np.int32))

    def run(batches):
        parts, held, seen = [], 0, np.zeros(0, np.uint64)
        for batch in batches:
            for block in K.blocks(K.column(batch, "text"), lower=True):
                row, value, begins = sets(block)
                digest = _digests(value, begins, 0)
                fresh = np.zeros(block.n, bool)
                fresh[np.unique(digest, return_index=True)[1]] = True
                fresh &= ~np.isin(digest, seen)
                seen = np.concatenate([seen, digest[fresh]])
                parts.append(value[fresh[row] & (value < most)] >> np.uint64(64 - KEY_BITS))
                held += len(parts[-1])
                if held > CHUNK:
                    yield from counts(parts)
                    parts, held, seen = [], 0, np.zeros(0, np.uint64)
        if held:
            yield from counts(parts)

    return run


def _hot(table: pa.Table) -> pa.Table:
    blobs = [S.unpacked(b.as_py()) for b in table["blob"]]
    key, n = np.concatenate([np.cumsum(b[0], dtype=np.uint64) for b in blobs]), np.concatenate([b[1] for b in blobs])
    order = np.argsort(key)
    key, n = key[order], n[order].astype(np.int64)
    head = np.flatnonzero(np.concatenate([np.ones(min(1, len(key)), bool), key[1:] != key[:-1]]))
    total = np.add.reduceat(n, head) if len(head) else n
    big = total >= HOT_TEXTS
    return pa.table([pa.array(K.as_long(key[head[big]])), pa.array(total[big])], ["key", "n"])


def prefix_size(n: np.ndarray) -> np.ndarray:
    """How many of a set of n, in any order, hold one of the shared shingles of each link."""
    return np.where(n > 0, n - (n * PERCENT + 99) // 100 + 1, 0)


def map_level(n: np.ndarray) -> np.ndarray:
    """A set of n has a map of 2**level bits: two to four a shingle, within bounds."""
    return np.clip(np.ceil(np.log2(np.maximum(2 * n, 1))).astype(np.int64), 6, 17)


def parity_maps(row: np.ndarray, value: np.ndarray, level: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The maps of sets, end to end, and where each begins (in bytes). A map of one bit less is its two halves, one upon the other."""
    begins = np.concatenate([[0], np.cumsum(1 << level)])
    bit = begins[row] + (value & ((1 << level[row]) - 1).astype(np.uint64)).astype(np.int64)
    return np.packbits(np.bincount(bit, minlength=begins[-1]).astype(np.uint8) & 1), begins // 8


def _folded(maps: np.ndarray, to: int) -> np.ndarray:
    """Maps, one a row, of 2**to bits."""
    while maps.shape[1] > (1 << to) // 8:
        half = maps.shape[1] // 2
        maps = maps[:, :half] ^ maps[:, half:]
    return maps


def map_distances(a: pa.Array, b: pa.Array, most: np.ndarray) -> np.ndarray:
    """Hamming distances of pairs of maps, at the level of the smaller one and at ``most``."""
    size = np.stack([pc.binary_length(x).to_numpy(zero_copy_only=False) for x in (a, b)]) * 8
    kind = np.concatenate([np.log2(size).astype(np.int64), [most]])
    out = np.zeros(len(a), np.int64)
    sides = [x.to_pylist() for x in (a, b)]
    distinct, back = np.unique(kind, axis=1, return_inverse=True)
    for i, (ka, kb, to) in enumerate(distinct.T.tolist()):
        at = np.flatnonzero(back.ravel() == i)
        to = min(ka, kb, to)
        left, right = (_folded(np.frombuffer(b"".join(side[j] for j in at.tolist()), np.uint8).reshape(len(at), -1), to) for side in sides)
        out[at] = np.bitwise_count(left ^ right).sum(axis=1, dtype=np.int64)
    return out


def differ(n: np.ndarray) -> np.ndarray:
    """Most shingles by which a set linked with one of n differs from it: it is 20 % of the union, which is n / 0.8 at most."""
    return n * (100 - PERCENT) // PERCENT


def _sketch(shared):
    """Of each set: size, digests, its first shingles in the common order, and its map."""

    def run(batches):
        hot = shared.value
        for batch in batches:
            for block in K.blocks(K.column(batch, "text"), lower=True):
                row, value, begins = sets(block)
                n = np.diff(begins)
                late = np.zeros(len(value), np.int64)
                if len(hot) and len(value):
                    key = value >> np.uint64(64 - KEY_BITS)
                    at = np.minimum(np.searchsorted(hot, key), len(hot) - 1)
                    late = (hot[at] == key).astype(np.int64)
                size = prefix_size(n)
                early = np.cumsum(1 - late)
                early = early - np.concatenate([[0], early])[begins[:-1]][row]  # place among the row's early ones, from 1
                count = np.bincount(row, 1 - late, block.n).astype(np.int64)
                rank = np.where(late == 0, early - 1, count[row] + np.arange(len(value)) - begins[row] - early)
                keep = rank < size[row]
                # keys in order, as 5 bytes each: a false match costs a comparison, no more
                ends = np.concatenate([[0], np.cumsum(size)])
                first = np.zeros(ends[-1], np.uint64)
                first[ends[row[keep]] + rank[keep]] = value[keep] >> np.uint64(64 - KEY_BITS)
                raw = first.view(np.uint8).reshape(-1, 8)[:, :5].tobytes()
                ends = (5 * ends).tolist()
                maps, at = parity_maps(row, value, map_level(n))
                maps, at = maps.tobytes(), at.tolist()
                arrays = [pa.array(n, pa.int64()), pa.array(K.as_long(_digests(value, begins, 0))), pa.array(K.as_long(_digests(value, begins, 1))), pa.array([raw[x:y] for x, y in zip(ends, ends[1:], strict=False)], pa.binary()), pa.array([maps[x:y] for x, y in zip(at, at[1:], strict=False)], pa.binary())]
                rest = [K.column(batch, c).slice(block.first, block.n) for c in ("rid", "doc_id", "doc", "text_hash")]
                yield pa.RecordBatch.from_arrays([*rest, *arrays], ["rid", "doc_id", "doc", "text_hash", *SAME, "prefix", "map"])

    return run


def _deal(buckets: int):
    """The keys of classes, as blobs by bucket."""

    def flush(parts):
        key, rid, home, n, place = (np.concatenate([p[i] for p in parts]) for i in range(5))
        return _dealt(key, buckets, rid, home - rid, n.astype(np.int32), place.astype(np.int32))

    def run(batches):
        parts, held = [], 0
        for batch in batches:
            prefix = K.column(batch, "prefix").to_pylist()
            size = np.array([len(x) // 5 for x in prefix], np.int64)
            raw = np.frombuffer(b"".join(prefix), np.uint8).reshape(-1, 5)
            key = np.zeros((len(raw), 8), np.uint8)
            key[:, :5] = raw
            place = np.arange(len(raw)) - np.repeat(np.cumsum(size) - size, size)
            parts.append((key.view(np.uint64).ravel(), *(np.repeat(K.column(batch, c).to_numpy(), size) for c in ("rid", "home", "n")), place))
            held += len(key)
            if held > DEALT:
                yield from flush(parts)
                parts, held = [], 0
        if parts:
            yield from flush(parts)

    return run


def _entries(table: pa.Table) -> tuple[np.ndarray, ...]:
    """A bucket's keys, classes, homes, sizes and places (in the class's order), by key and size: those with a neighbour in the same key that is near enough in size, as others have no link there."""
    blobs = [S.unpacked(b.as_py()) for b in table["blob"]]
    key = np.concatenate([np.cumsum(b[0], dtype=np.uint64) for b in blobs])
    rid, home = np.concatenate([b[1] for b in blobs]), np.concatenate([b[1] + b[2] for b in blobs])
    n, place = (np.concatenate([b[i] for b in blobs]).astype(np.int64) for i in (3, 4))
    order = np.lexsort((n, key))
    key, rid, home, n, place = key[order], rid[order], home[order], n[order], place[order]
    pair = (key[1:] == key[:-1]) & (100 * n[:-1] >= PERCENT * n[1:])
    keep = np.concatenate([pair, [False]]) | np.concatenate([[False], pair])
    return key[keep], rid[keep], home[keep], n[keep], place[keep]


def _distinct(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs and how often each comes."""
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    head = np.flatnonzero(new)
    return a[head], b[head], np.diff(np.append(head, len(a)))


def _votes(table: pa.Table) -> pa.Table:
    """The other class that most of a class's keys name as pivot, and how many do: each key names that of the smallest hash."""
    key, rid, _, _, _ = _entries(table)
    order = np.lexsort((K.mix(rid.view(np.uint64) ^ np.uint64(0x5851F42D4C957F2D)), key))
    key, rid = key[order], rid[order]
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    named = rid[np.flatnonzero(new)[np.cumsum(new) - 1]] if len(key) else rid
    other = rid != named
    rid, named, votes = _distinct(rid[other], named[other])
    order = np.lexsort((named, -votes, rid))
    best = order[np.concatenate([np.ones(min(1, len(rid)), bool), rid[order][1:] != rid[order][:-1]])]
    rid, named, votes = rid[best], named[best], votes[best]
    return pa.table([pa.array(rid), pa.array(named), pa.array(votes, pa.int64())], ["rid", "named", "votes"])


def _windows(meeting: int):
    """Regions other than its own that a class meets in a key, of each two the larger's class going to the smaller; where more than ``meeting`` meet, all go to a region named by the smallest."""
    return lambda table: _meet(table, meeting)


def _meet(table: pa.Table, meeting: int) -> pa.Table:
    key, rid, home, n, place = _entries(table)
    order = np.lexsort((n, home, key))
    key, rid, home, n, place = key[order], rid[order], home[order], n[order], place[order]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (home[1:] != home[:-1])
    head = np.flatnonzero(new)
    size = np.diff(np.append(head, len(key)))
    least, most = (n[head], n[head + size - 1]) if len(n) else (n, n)
    early = np.minimum.reduceat(place, head) if len(n) else n
    keys, homes = key[head], home[head]
    _, back, regions = np.unique(keys, return_inverse=True, return_counts=True)
    crowd = regions[back] > meeting if len(keys) else np.zeros(0, bool)
    own = np.repeat(crowd, size)
    # the group's smallest home names the region: near copies share it in most of their keys, so they meet there once
    begin = np.flatnonzero(np.concatenate([np.ones(min(1, len(keys)), bool), keys[1:] != keys[:-1]]))
    smallest = np.repeat(homes[begin], np.diff(np.append(begin, len(keys))))
    found = [(rid[own], -1 - np.repeat(smallest, size)[own])]
    open_ = np.flatnonzero(~crowd)
    gap = 1
    while gap < meeting and gap < len(open_):  # each region with the one ``gap`` further on in the same key
        a, b = open_[:-gap], open_[gap:]
        keep = (keys[a] == keys[b]) & (100 * most[a] >= PERCENT * least[b]) & (100 * most[b] >= PERCENT * least[a])
        if not (keys[a] == keys[b]).any():
            break
        a, b = a[keep], b[keep]
        member = np.repeat(head[b] - (np.cumsum(size[b]) - size[b]), size[b]) + np.arange(size[b].sum())
        to = np.repeat(a, size[b])
        # a link's first shared key has only unshared ones before it on either side, and those are bounded
        fits = (place[member] + early[to]) * (100 + PERCENT) <= (100 - PERCENT) * (n[member] + most[to])
        fits &= (100 * most[to] >= PERCENT * n[member]) & (100 * n[member] >= PERCENT * least[to])
        found.append((rid[member[fits]], homes[to[fits]]))
        if len(found) > 8:
            found = [_distinct(*(np.concatenate([f[i] for f in found]) for i in (0, 1)))[:2]]
        gap += 1
    rid, region, _ = _distinct(*(np.concatenate([f[i] for f in found]) for i in (0, 1)))
    return pa.table([pa.array(rid), pa.array(region)], ["rid", "region"])


def _near(batches):
    """Classes whose map is near that of the pivot they name: with the distance, and the smaller level."""
    for batch in batches:
        far = map_distances(K.column(batch, "map"), K.column(batch, "pivot_map"), np.full(len(batch), 99))
        n, pivot_n = K.column(batch, "n").to_numpy(), K.column(batch, "pivot_n").to_numpy()
        keep = far <= NEAR * np.minimum(n, pivot_n)
        out = batch.filter(pa.array(keep))
        level = np.minimum(map_level(n), map_level(pivot_n))[keep]
        yield pa.RecordBatch.from_arrays([K.column(out, "rid"), K.column(out, "pivot"), pa.array(far[keep]), pa.array(level)], ["rid", "pivot", "far", "level"])


def _inside(batches):
    """Windows whose class may, by the triangle inequality, have a link in the region."""
    for batch in batches:
        far = map_distances(K.column(batch, "map"), K.column(batch, "pivot_map"), K.column(batch, "level").to_numpy())
        n, pivot_n, radius = (K.column(batch, c).to_numpy() for c in ("n", "pivot_n", "radius"))
        alone = (100 - PERCENT) * (n + pivot_n) // (100 + PERCENT)  # of two sets: 20 % of the union, which is less than their sum by the other 80 %
        keep = far <= np.where(radius >= 0, radius + differ(n), alone)
        out = batch.filter(pa.array(keep))
        yield pa.RecordBatch.from_arrays([K.column(out, "rid"), K.column(out, "region")], ["rid", "region"])


def _whole_regions(batches):
    """Rows that come by region, as tables of whole regions."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not len(batch):
            continue
        region = K.column(batch, "region").to_numpy()
        last = region[-1]
        open_from = int(np.searchsorted(region == last, True))
        if open_from or (held and K.column(held[-1], "region")[-1].as_py() != last):
            held.append(batch.slice(0, open_from))
            yield pa.Table.from_batches([h for h in held if len(h)])
            held = []
        held.append(batch.slice(open_from))
    if held:
        yield pa.Table.from_batches(held)


def _partnered(maps: list[bytes], n: np.ndarray, home: np.ndarray) -> np.ndarray:
    """Which sets may, by their maps and sizes, be linked with another one of another home."""
    level, found = map_level(n), np.zeros(len(n), bool)
    for to in np.unique(level).tolist():  # linked sets differ by one level at most
        at = np.flatnonzero((level == to) | (level == to + 1))
        rows = np.concatenate([_folded(np.frombuffer(maps[i], np.uint8).reshape(1, -1), to) for i in at.tolist()]).view(np.uint64)
        for i in np.flatnonzero(level[at] == to).tolist():
            far = np.bitwise_count(rows ^ rows[i]).sum(axis=1, dtype=np.int64)
            a = at[i]
            fits = (far * (100 + PERCENT) <= (100 - PERCENT) * (n[at] + n[a])) & (home[at] != home[a]) & (100 * n[at] >= PERCENT * n[a]) & (100 * n[a] >= PERCENT * n[at])
            if fits.any():
                found[a] = True
                found[at[fits]] = True
    return found


def _sift(batches):
    """Classes that meet where many regions do, those without a possible link there left out; the rows come by region."""
    for table in _whole_regions(batches):
        region, n, home = (table[c].to_numpy() for c in ("region", "n", "home"))
        maps = table["map"].to_pylist()
        head = np.flatnonzero(np.concatenate([[True], region[1:] != region[:-1]])).tolist()
        keep = np.concatenate([_partnered(maps[a:b], n[a:b], home[a:b]) for a, b in zip(head, [*head[1:], len(n)], strict=True)])
        yield from table.select(["rid", "region"]).filter(pa.array(keep)).combine_chunks().to_batches()


def _shares(value: np.ndarray, begins: np.ndarray, i: int, others: np.ndarray) -> np.ndarray:
    """How many shingles set i shares with each of the others."""
    own = value[begins[i] : begins[i + 1]]
    size = begins[others + 1] - begins[others]
    ends = np.cumsum(size)
    them = value[np.repeat(begins[others] - (ends - size), size) + np.arange(ends[-1])]
    hit = own[np.minimum(np.searchsorted(own, them), len(own) - 1)] == them
    return np.add.reduceat(hit.astype(np.int64), ends - size)


def region_links(value: np.ndarray, begins: np.ndarray, own: np.ndarray, home: np.ndarray, part: np.ndarray) -> list[tuple[int, int]]:
    """Links that connect a region's members, by place: of those that are ``own`` (which come first), with each other and with the rest, where ``home`` differs.
    ``part``: members known to be connected have equal numbers."""
    m = len(own)
    n = begins[1:] - begins[:-1]
    links: list[tuple[int, int]] = []
    part = np.unique(part, return_inverse=True)[1]
    maps = None
    if m > 4:
        level = int(map_level(n).min())
        raw, _ = parity_maps(np.repeat(np.arange(m), n), value, np.full(m, level))
        maps = raw.reshape(m, -1).view(np.uint64)
    for i in range(min(m - 1, int(own.sum()))):
        others = np.arange(i + 1, m)
        others = others[(part[others] != part[i]) & (home[others] != home[i])]
        others = others[(100 * n[others] >= PERCENT * n[i]) & (100 * n[i] >= PERCENT * n[others])]
        if maps is not None and len(others):
            far = np.bitwise_count(maps[others] ^ maps[i]).sum(axis=1, dtype=np.int64)
            others = others[far * (100 + PERCENT) <= (100 - PERCENT) * (n[others] + n[i])]
        # one of each part is enough where it links; so a part goes once it does
        while len(others):
            now, others = others[:256], others[256:]
            both = _shares(value, begins, i, now)
            for j in now[100 * both >= PERCENT * (n[now] + n[i] - both)].tolist():
                if part[j] != part[i]:
                    links.append((i, j))
                    part[part == part[j]] = part[i]
            others = others[part[others] != part[i]]
        if (part == part[0]).all():
            break
    return links


def _sets_of(texts, whole) -> tuple[np.ndarray, np.ndarray]:
    """The sets of compressed texts one after another, and where each begins. Texts are unpacked and cut block by block, so that besides the sets a task holds one block's arrays."""
    values, sizes, held, size = [np.zeros(0, np.uint64)], [np.zeros(1, np.int64)], [], 0
    for x in [*texts, None]:
        if x is not None:
            held.append(whole(x.as_buffer()))
            size += len(held[-1])
        if held and (x is None or size >= K.BLOCK_BYTES):
            for block in K.blocks(pa.array(held, pa.large_binary()), lower=True):
                _, value, begins = sets(block)
                values.append(value)
                sizes.append(np.diff(begins))
            held, size = [], 0
    return np.concatenate(values), np.cumsum(np.concatenate(sizes))


def _join(batches):
    """Links of regions; the rows come by region, those that are own first."""
    whole = zstandard.ZstdDecompressor().decompress

    def joined(table: pa.Table):
        out = [[], []]
        region = table["region"].to_numpy()
        head = np.flatnonzero(np.concatenate([[True], region[1:] != region[:-1]]))
        tail = np.append(head[1:], len(region))
        size = table["n"].to_numpy()
        rid, own, home, part = (table[c].to_numpy() for c in ("rid", "own", "home", "part"))
        done = 0
        while done < len(head):  # regions together, up to a bound of shingles
            upto = done + 1
            total = size[head[done] : tail[done]].sum()
            while upto < len(head) and total + size[head[upto] : tail[upto]].sum() < 500_000:
                total += size[head[upto] : tail[upto]].sum()
                upto += 1
            a, b = head[done], tail[upto - 1]
            value, begins = _sets_of(table["text"].slice(a, b - a), whole)
            for x, y in zip(head[done:upto], tail[done:upto], strict=True):
                if y - x < 2:
                    continue
                v = begins[x - a : y - a + 1]
                for i, j in region_links(value[v[0] : v[-1]], v - v[0], own[x:y], home[x:y], part[x:y]):
                    out[0].append(rid[x + i])
                    out[1].append(rid[x + j])
            done = upto
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], ["a", "b"])

    for table in _whole_regions(batches):
        yield joined(table)


def _measure(batches):
    """Shared shingles and union of text and pivot_text."""
    whole = zstandard.ZstdDecompressor().decompress
    for batch in batches:
        for at in range(0, len(batch), 256):
            part = batch.slice(at, 256)
            found = [sets(next(K.blocks(pa.array([whole(x.as_buffer()) for x in K.column(part, side)], pa.large_binary()), lower=True, limit=1 << 60))) for side in ("text", "pivot_text")]
            (row_a, a, from_a), (row_b, b, from_b) = found
            salt = K.mix(np.arange(len(part), dtype=np.uint64) + np.uint64(7))
            _, where, _ = np.intersect1d(a ^ salt[row_a], b ^ salt[row_b], assume_unique=True, return_indices=True)
            both = np.bincount(row_a[where], minlength=len(part))
            rest = [i for i, c in enumerate(part.schema.names) if c != "pivot_text"]
            yield pa.RecordBatch.from_arrays([*(part.column(i) for i in rest), pa.array(both, pa.int64()), pa.array(np.diff(from_a) + np.diff(from_b) - both, pa.int64())], [*(part.schema.names[i] for i in rest), "shared", "total"])


def _filter(need: DataFrame, texts: int):
    """The text hashes of ``need`` as a Bloom filter, broadcast; two probes a hash."""
    bits = min(FILTER_BITS, max(16, int(16 * texts).bit_length()))
    at = [F.col("text_hash").bitwiseAND((1 << bits) - 1), F.shiftrightunsigned("text_hash", 64 - bits)]
    found = need.select(F.explode(F.array(*at)).alias("at")).groupBy(F.shiftright("at", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 63 as int))")).alias("bits")).toArrow()
    words = np.zeros(1 << bits - 6, np.uint64)
    words[found["word"].to_numpy()] = found["bits"].to_numpy().view(np.uint64)
    return need.sparkSession.sparkContext.broadcast((bits, words))


def _needed(shared):
    """Compressed texts of the rows whose hash passes the filter."""

    def run(batches):
        (bits, words), one = shared.value, np.uint64(1)
        for batch in batches:
            th = K.column(batch, "text_hash").to_numpy().view(np.uint64)
            keep = np.ones(len(th), bool)
            for at in (th & np.uint64((1 << bits) - 1), th >> np.uint64(64 - bits)):
                keep &= (words[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63)) & one).astype(bool)
            yield from S._zip([batch.filter(pa.array(keep))])

    return run


LINKED = f"100 * shared >= {PERCENT} * total"
_MEMBER = "region long, rid long, own boolean, home long, part long, n long"


def _parts(df: DataFrame, total: int) -> int:
    """Partitions for so many shingles."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // REGION_SHINGLES))


def _joined_regions(members: DataFrame, total: int) -> DataFrame:
    """``members`` (of _MEMBER, and text) -> links (a, b)."""
    dealt = members.repartition(_parts(members, total), "region").sortWithinPartitions("region", F.desc("own"), "rid")
    return dealt.mapInArrow(K.tidy(_join), "a long, b long")


def _too_large(region_rows: int) -> F.Column:
    return (F.col("rows") > region_rows) | (F.col("shingles") > REGION_SHINGLES)


def _sizes(members: DataFrame) -> DataFrame:
    return members.groupBy("region").agg(F.count("*").alias("rows"), F.sum("n").alias("shingles"), F.max("own").alias("any"))


def _chunks(prefix: str, region_rows: int) -> F.Column:
    """Parts of a side, half a task's bound each."""
    return F.ceil(F.greatest(F.col(f"{prefix}rows") / (region_rows / 2), F.col(f"{prefix}shingles") / (REGION_SHINGLES / 2))).cast("int")


def _parted(large: DataFrame, region_rows: int, rounds: int) -> DataFrame:
    """Links of regions too large for a task; ``large`` as ``_joined_regions`` takes it, written."""
    links = None
    chunk = lambda n: F.pmod(F.xxhash64("rid", F.lit(5)), n)
    named = lambda *parts: -1 - F.shiftrightunsigned(F.xxhash64("region", *parts), 1)
    for round_ in range(rounds):
        # the pivot: a region's own, or else one of its own members by a hash; copies of its text go to all the tasks that measure
        first = F.struct(~F.col("own"), F.col("rid") != F.col("region"), F.xxhash64("rid", F.lit(round_)))
        pivot = large.groupBy("region").agg(F.min_by(F.struct("rid", "text"), first).alias("p"))
        spread = int(large.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        pivot = pivot.select("region", F.col("p.rid").alias("pivot"), F.col("p.text").alias("pivot_text"), F.explode(F.sequence(F.lit(0), F.lit(spread - 1))).alias("salt"))
        both = large.withColumn("salt", F.pmod(F.xxhash64("rid"), F.lit(spread)).cast("int")).join(pivot, ["region", "salt"]).drop("salt")
        both = written(both.select(*large.columns, "pivot", "pivot_text").mapInArrow(K.tidy(_measure), f"{_MEMBER}, text binary, pivot long, shared long, total long"), "measured")
        inner = F.expr(LINKED)
        found = both.filter(inner & (F.col("rid") != F.col("pivot"))).select(F.col("pivot").alias("a"), F.col("rid").alias("b"))
        # outer members within twice the limit of the pivot may have links with inner ones: chunks of either side meet
        limit = 2 * (1 - PERCENT / 100)
        side = F.when(inner, "i").when(1 - F.col("shared") / F.col("total") <= limit + 1e-9, "w")
        sides = both.withColumn("side", side)
        size = sides.groupBy("region").pivot("side", ["i", "w"]).agg(F.count("rid").alias("rows"), F.sum("n").alias("shingles"))
        size = size.select("region", _chunks("i_", region_rows).alias("ni"), _chunks("w_", region_rows).alias("nw")).filter("ni > 0 and nw > 0")
        meet = sides.filter("side is not null").join(size, "region")
        every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
        meet = meet.withColumn("i", F.when(F.col("side") == "i", F.array(chunk(F.col("ni")).cast("int"))).otherwise(F.sequence(F.lit(0), F.col("ni") - 1))).withColumn("i", F.explode("i"))
        meet = meet.withColumn("w", F.when(F.col("side") == "w", F.array(chunk(F.col("nw")).cast("int"))).otherwise(F.sequence(F.lit(0), F.col("nw") - 1))).withColumn("w", F.explode("w"))
        meet = meet.select(named(F.lit(round_), "i", "w").alias("region"), "rid", (F.col("side") == "i").alias("own"), F.col("rid").alias("home"), F.when(F.col("side") == "i", F.col("pivot")).otherwise(F.col("rid")).alias("part"), "n", "text")
        found = found.union(_joined_regions(meet, both.agg(F.sum("n")).first()[0] or 0))
        # the outer part goes on by itself
        outer = both.filter(~inner).select(*large.columns).withColumn("region", named(F.lit(round_)))
        size = _sizes(outer).filter("rows > 1 and any")
        outer = written(outer.join(size.select("region", _too_large(region_rows).alias("large")), "region"), "outer")
        found = found.union(_joined_regions(outer.filter("not large").drop("large"), outer.agg(F.sum("n")).first()[0] or 0))
        links = written(found if links is None else links.union(found), "links")
        before, large = both.count(), outer.filter("large").drop("large")
        left = large.count()
        if not left:
            return links
        if left > (1 - PROGRESS) * before:
            break
    # what no pivot parts: chunk by chunk, each pair of chunks a region
    size = _sizes(large).select("region", _chunks("", region_rows).alias("parts"))
    each = large.join(size, "region").withColumn("x", chunk(F.col("parts")).cast("int")).withColumn("y", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    pair = each.select(named(F.least("x", "y"), F.greatest("x", "y")).alias("region"), "rid", F.lit(True).alias("own"), F.col("rid").alias("home"), "part", "n", "text")
    return links.union(_joined_regions(pair, each.agg(F.sum("n")).first()[0] or 0))


def _joined(docs: DataFrame, region_rows: int = REGION_ROWS, meeting: int = MEETING, rounds: int = ROUNDS) -> tuple[DataFrame, DataFrame]:
    """What the steps give: a row for each row of ``docs`` with its set's key (n, d1, d2), and a row for each key but that of the empty set, with its component's root, smallest id and first text."""
    text = F.coalesce("text", F.lit(""))
    keyed = S.keyed(docs)
    sc = docs.sparkSession.sparkContext
    size = keyed.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    counted = keyed.mapInArrow(K.tidy(_counted(max(1, -(-size // COUNT_BYTES)))), "bucket long, blob binary")
    hot = counted.groupBy("bucket").applyInArrow(_hot, "key long, n long").orderBy(F.desc("n"), "key").limit(HOT_MOST)
    hot = np.sort(hot.select("key").toArrow()["key"].to_numpy().view(np.uint64))
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("doc_id").cast("long"), F.lit(S._LEAST)).alias("doc"), F.xxhash64(text).alias("text_hash"), text.alias("text"))
    sketch = written(rows.mapInArrow(K.tidy(_sketch(sc.broadcast(hot))), "rid long, doc_id long, doc long, text_hash long, n long, d1 long, d2 long, prefix binary, map binary"), "sketch")
    ids = written(sketch.filter("n > 0").groupBy(*SAME).agg(F.min("rid").alias("class"), F.min("doc_id").alias("least_id"), F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc", "text_hash")).alias("first")), "classes")
    # rows with sets and maps are dealt by rid once, and joined from there
    classes = bucketed(sketch.select("rid", "doc", "text_hash", "n", "prefix", "map").join(ids.select(F.col("class").alias("rid")), "rid", "left_semi"), "classes", "rid")
    keys = classes.agg(F.sum(F.octet_length("prefix") / 5)).first()[0] or 0
    buckets = max(1, -(-int(keys) // BUCKET_KEYS))
    dealt = lambda df: df.select("rid", "home", "n", "prefix").mapInArrow(K.tidy(_deal(buckets)), "bucket long, blob binary").groupBy("bucket")

    # 2. regions
    votes = dealt(classes.withColumn("home", F.col("rid"))).applyInArrow(_votes, "rid long, named long, votes long")
    votes = votes.groupBy("rid", "named").agg(F.sum("votes").alias("votes")).groupBy("rid").agg(F.max(F.struct("votes", "named")).named.alias("pivot"))
    voted = written(votes, "votes")
    votes = voted.select("rid").union(voted.select("pivot")).distinct().join(voted, "rid", "left")
    active = bucketed(votes.join(classes.select("rid", "n", "map"), "rid"), "active", "rid")
    forget(voted)
    pivots = active.select(F.col("rid").alias("pivot"), F.col("n").alias("pivot_n"), F.col("map").alias("pivot_map"))
    near = active.filter("pivot is not null").join(pivots, "pivot").select("rid", "n", "map", "pivot", "pivot_n", "pivot_map")
    measured = written(near.mapInArrow(K.tidy(_near), "rid long, pivot long, far long, level long"), "near")
    near = measured.join(measured.select(F.col("pivot").alias("rid")).distinct(), "rid", "left_anti")
    homes = written(active.select("rid", "n").join(near, "rid", "left").select("rid", "n", F.coalesce("pivot", "rid").alias("home"), F.coalesce("far", F.lit(-1)).alias("far"), F.coalesce("level", F.lit(99)).alias("level")), "homes")
    forget(measured)
    # a region of one has radius -1
    radius = homes.groupBy(F.col("home").alias("region")).agg(F.max("far").alias("radius"), F.min("level").alias("level"))

    # 3. windows
    window = dealt(classes.select("rid", "prefix").join(homes, "rid")).applyInArrow(_windows(meeting), "rid long, region long").distinct()
    window = written(window, "window")
    bounds = radius.join(pivots.withColumnRenamed("pivot", "region"), "region")
    inside = window.filter("region >= 0").join(active.select("rid", "n", "map"), "rid").join(bounds, "region").select("rid", "n", "map", "region", "pivot_n", "pivot_map", "radius", "level")
    inside = inside.mapInArrow(K.tidy(_inside), "rid long, region long")
    # where many regions met: within a task's bound, maps tell who may have a link there
    crowd = window.filter("region < 0").join(active.select("rid", "n", "map"), "rid").join(homes.select("rid", "home"), "rid")
    size = crowd.groupBy("region").agg(F.count("*").alias("rows")).select("region", (F.col("rows") > region_rows).alias("crowded"))
    crowd = crowd.join(size, "region")
    sifted = crowd.filter("not crowded").select("region", "rid", "n", "home", "map").repartition("region").sortWithinPartitions("region").mapInArrow(K.tidy(_sift), "rid long, region long")
    inside = inside.union(sifted).union(crowd.filter("crowded").select("rid", "region"))
    guests = inside.join(homes.select("rid", "n", "home"), "rid").select("region", "rid", (F.col("region") < 0).alias("own"), F.when(F.col("region") < 0, F.col("home")).otherwise(F.col("rid")).alias("home"), F.col("rid").alias("part"), "n")
    hosts = homes.select(F.col("home").alias("region"), "rid", F.lit(True).alias("own"), F.col("rid").alias("home"), F.col("rid").alias("part"), "n")
    drawn = written(hosts.union(guests), "members")
    forget(window)
    forget(active)
    forget(homes)
    size = _sizes(drawn).filter("rows > 1").select("region", _too_large(region_rows).alias("large"))
    members = written(drawn.join(size, "region").join(classes.select("rid", "doc", "text_hash"), "rid"), "members")
    forget(drawn)
    forget(classes)

    # 4. links
    need = members.select("doc", "text_hash").distinct()
    some = members.agg(F.count_distinct("rid"), F.sum("n"), F.max("large")).first()
    texts = keyed.mapInArrow(K.tidy(_needed(_filter(need, some[0]))), "doc long, text_hash long, text binary").dropDuplicates(["doc", "text_hash"])
    members = members.join(texts, ["doc", "text_hash"]).select("region", "rid", "own", "home", "part", "n", "text", "large")
    links = _joined_regions(members.filter("not large").drop("large"), some[1] or 0)
    if some[2]:
        links = links.union(_parted(written(members.filter("large").drop("large"), "large"), region_rows, rounds))
    links = written(links, "links")

    # 5. components
    roots = components(links)
    forget(links)
    labelled = ids.join(roots.select(F.col("node").alias("class"), "root"), "class", "left").select(*SAME, "least_id", "first", F.coalesce("root", "class").alias("root"))
    return sketch, labelled


def jaccard_components(docs: DataFrame, **bounds: int) -> DataFrame:
    """doc_id, n_shingles and component_id of each row of ``docs`` (doc_id, an integer, and text).

    A text with fewer than SHINGLE words is one shingle; one without words (or null) has none, is linked with nothing and is its own component.
    component_id is the smallest doc_id of the component, nulls apart (null if there is no other). Rows that share a doc_id are
    documents of their own. Other columns are ignored. An empty table gives no rows. ``bounds``: region_rows, meeting and rounds, as the constants REGION_ROWS, MEETING and ROUNDS.
    """
    sketch, labelled = _joined(docs, **bounds)
    least = labelled.groupBy("root").agg(F.min("least_id").alias("component_id"))
    named = labelled.join(least, "root").select(*SAME, "component_id")
    out = sketch.select("doc_id", *SAME).join(named, SAME, "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def representatives(docs: DataFrame) -> DataFrame:
    """doc and text_hash (as ``superkmers.keyed`` has them) of the first text of each component: that of the smallest doc_id, nulls last, then of the smallest hash.

    Rows that share both are equal texts of one id; texts without words are in no component."""
    return _joined(docs)[1].groupBy("root").agg(F.min("first").alias("first")).select("first.doc", "first.text_hash")


def op1_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
