"""N-gram Jaccard join with prefix trees, and the groups of near copies that it gives."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, components, mix, packed, parts, scratch, slices, small, span_hashes, trimmed, unpacked, utf8, word_spans, written

#: Words of an n-gram, and the least Jaccard similarity of a pair.
N, THRESHOLD = 2, 0.6
#: N-grams that are ordered by how many texts have them; all others come before them, by hash. Any order gives the same pairs, a better one gives them sooner.
HOT = 400_000
#: Texts of a batch that must share an n-gram for the batch to report it.
HOT_IN_BATCH = 4
#: Min-hashes by which large groups are found first, texts that make a group large, and texts of it that the others are compared with.
HASHES, LARGE, CENTRES = 4, 8, 8
#: Texts of large groups whose group is told to all tasks, at most; it only saves work, so those of the largest groups come first.
LABELS = 500_000
#: Sets of a block of a large group, whose blocks meet two by two; components of over WIDE blocks meet in this way too, in blocks of so many times the size.
BLOCK, WIDE = 1024, 8
#: Prefix elements of a shard, on average; times as many that it may have if a pair's share would get small otherwise; least size of a set for each shard of its band, so that it doesn't.
SHARD, WIDEST, SHARE = 1_500_000, 4, 25
#: Parts of a prefix whose ends are told; low bits of an element that aren't sent for verification, and the lowest bit of a frequent one's rank.
PARTS, CUT, RANK_BIT = 4, 16, 40
_U = np.uint64
_ODD = [_U(x | 1) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]


def ngrams(x: np.ndarray, o: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and text of each n-gram of words; a text with fewer words has one of all its words."""
    start, end, doc = word_spans(x, o)
    h = span_hashes(x, start, end)
    if not len(h):
        return h, doc
    per = np.bincount(doc, minlength=len(o) - 1)
    first = np.cumsum(per) - per
    at = np.arange(len(h)) - first[doc]
    room = np.maximum(per[doc] - n, 0)
    keep = np.flatnonzero(at <= room)
    g = np.zeros(len(keep), dtype=_U)
    for k in range(n):
        i = keep + k
        has = at[keep] + k < per[doc[keep]]
        g = np.where(has, mix(g * _U(0x9E3779B97F4A7C15) + h[np.minimum(i, len(h) - 1)] + _U(k + 1)), g)
    return g, doc[keep]


def ordered_sets(column: pa.Array, n: int, hot: tuple[np.ndarray, np.ndarray]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each slice of the texts its first text, and the sets one after the other: elements in the global order, and the bounds of each set."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    b, offsets = utf8(pc.utf8_lower(column.cast(pa.large_string())))
    for i, j in slices(offsets, 1_500_000):
        g, doc = ngrams(b[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], n)
        g = g >> _U(1)
        keys, rank = hot
        if len(keys) and len(g):
            p = np.minimum(np.searchsorted(keys, g), len(keys) - 1)
            g = np.where(keys[p] == g, (_U(1) << _U(63)) | rank[p].astype(_U) << _U(RANK_BIT), g)
        order = np.lexsort((g, doc))
        g, doc = g[order], doc[order]
        new = np.ones(len(g), dtype=bool)
        new[1:] = (g[1:] != g[:-1]) | (doc[1:] != doc[:-1])
        g, doc = g[new], doc[new]
        yield i, g, np.searchsorted(doc, np.arange(j - i + 1))


NO_HOT = (np.zeros(0, dtype=_U), np.zeros(0, dtype=np.int64))


def signatures(g: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A 63-bit number for each set, whatever the order of its elements."""
    c = np.concatenate([np.zeros(1, _U), np.cumsum(mix(g + _U(0x632BE59BD9B4E019)), dtype=_U)])
    return (mix(c[bounds[1:]] - c[bounds[:-1]] + (np.diff(bounds).astype(_U) << _U(32))) >> _U(1)).astype(np.int64)


def _scan(docs: DataFrame, n: int, least: int) -> DataFrame:
    """Rows (doc_id, sig, m, z) of all texts that have words, m being min-hashes and z the set's size, and (key, n) of n-grams that many texts of a batch share."""

    def run(batches):
        for batch in batches:
            ids = batch.column(0).cast(pa.int64())
            keep, sigs, seen, least_of, sizes = [], [], [], [], []
            # the hash order here; the signatures are those of the unordered sets
            for i, g, bounds in ordered_sets(batch.column(1), n, NO_HOT):
                has = np.flatnonzero(np.diff(bounds) > 0)
                keep.append(i + has)
                sigs.append(signatures(g, bounds)[has])
                sizes.append(np.diff(bounds)[has])
                least_of.append(np.stack([np.minimum.reduceat(g * a, bounds[:-1][has]) if len(has) else g[:0] for a in _ODD[:HASHES]], axis=1))
                k, c = np.unique(g, return_counts=True)
                seen.append((k[c > 1], c[c > 1]))
            k = np.concatenate([x for x, _ in seen] or [np.zeros(0, _U)])
            c = np.concatenate([x for _, x in seen] or [np.zeros(0, np.int64)])
            u, which = np.unique(k, return_inverse=True)
            total = np.bincount(which, weights=c, minlength=len(u)).astype(np.int64)
            u, total = u[total >= least], total[total >= least]
            rows = np.concatenate(keep) if keep else np.zeros(0, np.int64)
            a = ids.take(pa.array(rows))
            none = pa.nulls(len(u), pa.int64())
            gone = pa.nulls(len(rows), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.concat_arrays([a, none]), pa.concat_arrays([pa.array(np.concatenate(sigs) if sigs else np.zeros(0, np.int64)), none]), pa.concat_arrays([gone, pa.array(u.astype(np.int64))]), pa.concat_arrays([gone, pa.array(total)]), pa.concat_arrays([pa.array([x.tobytes() for y in least_of for x in y], pa.binary()), pa.nulls(len(u), pa.binary())]), pa.concat_arrays([pa.array(np.concatenate(sizes) if sizes else np.zeros(0, np.int64)), none])],
                names=["doc_id", "sig", "key", "n", "m", "z"],
            )

    return docs.select("doc_id", "text").where("doc_id is not null").mapInArrow(trimmed(run), "doc_id bigint, sig bigint, key bigint, n bigint, m binary, z bigint")


def prefix_length(size: np.ndarray, t: float) -> np.ndarray:
    """Elements from the front of a set of which one at least is in every set as similar as t."""
    return size - np.ceil(t * size - 1e-9).astype(np.int64) + 1


def need(a: np.ndarray, b: np.ndarray, t: float) -> np.ndarray:
    """Least overlap of sets of these sizes that are as similar as t."""
    return np.ceil(t / (1 + t) * (a + b) - 1e-9).astype(np.int64)


def bands(t: float, largest: int) -> np.ndarray:
    """Least sizes of bands of sets, and one beyond the largest: a set is as similar as t only to sets of its own band and those next to it."""
    out = [1]
    while out[-1] <= largest:
        out.append(int(np.floor(out[-1] / t + 1e-9)) + 1)
    return np.array(out, dtype=np.int64)


def lists_of(edges: np.ndarray, elements: np.ndarray, shard: int) -> np.ndarray:
    """How many shards the prefix elements of each band (and of the next one, whose sets come too) get: as `shard` has it, but not so many that
    a shard's share of the overlap that a pair needs gets under a few elements, unless shards would get too large then."""
    both = elements + np.append(elements[1:], 0)
    few = np.minimum(-(-both // shard), np.maximum(edges[:-1] // SHARE, 1))
    return np.where(elements > 0, np.maximum(np.maximum(few, -(-both // (shard * WIDEST))), 1), 0)


def _prefixes(docs: DataFrame, n: int, t: float, hot, labels, edges: np.ndarray, lists: np.ndarray) -> DataFrame:
    """Rows (shard, data): prefix elements of the sets of a batch, packed by shard of the element. Each band of sizes has its own shards, which get the sets of the next band too."""
    base = np.cumsum(lists) - lists

    def blobs(kk, ww, qq, sig, size, ends, known, group) -> pa.RecordBatch:
        k, w, q256, sig = np.concatenate(kk), np.concatenate(ww), np.concatenate(qq), np.concatenate(sig)
        size, ends = np.concatenate(size).astype(np.int32), np.concatenate(ends)
        # a set that occurs twice in the batch is sent once
        _, first, which = np.unique(sig, return_index=True, return_inverse=True)
        once = first[which[w]] == w
        k, w, q256 = k[once], w[once], q256[once]
        m = mix(k)
        del k, once
        own = np.searchsorted(edges, size, "right") - 1
        out = []
        for down in (0, 1):
            band = np.maximum(own - down, 0)
            to = (own >= down) & (lists[band] > 0)
            i = np.flatnonzero(to[w])
            shard = base[band[w[i]]] + (m[i] % lists[band[w[i]]].astype(_U)).astype(np.int64)
            # elements that are alike in the bits that are sent only add candidates
            order = np.argsort((shard.astype(_U) << _U(32)) | (m[i] >> _U(32)))
            i, shard = i[order], shard[order]
            cuts = np.flatnonzero(np.diff(shard, prepend=-1, append=-1))
            for x, y in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                part = i[x:y]
                u, first, idx = np.unique(sig[w[part]], return_index=True, return_inverse=True)
                of = w[part][first]
                at = np.minimum(np.searchsorted(known, u), max(len(known) - 1, 0))
                label = np.where(known[at] == u, group[at], 0) if len(known) else np.zeros(len(u))
                out.append((int(shard[x]), packed(np.diff(m[part] >> _U(32), prepend=_U(0)).astype(np.uint32), idx.astype(np.uint32), q256[part], np.diff(u, prepend=0), size[of], ends[of].reshape(-1), label.astype(np.uint32))))
        return pa.RecordBatch.from_arrays([pa.array([q for q, _ in out], pa.int32()), pa.array([x for _, x in out], pa.binary())], names=["shard", "data"])

    def run(batches):
        keys, (known, group) = hot.value, labels.value
        held: list[tuple] = []
        elements = sets = 0
        for batch in batches:
            for _, g, bounds in ordered_sets(batch.column(0), n, keys):
                sig, size = signatures_of(g, bounds, keys), np.diff(bounds)
                p = np.where(size > 0, prefix_length(size, t), 0)
                first = np.cumsum(p) - p
                at = np.arange(int(p.sum())) - np.repeat(first - bounds[:-1], p)
                # what the set has behind the element, in 256ths of its size, and where the parts of its prefix end
                left = np.repeat(bounds[1:], p) - at - 1
                behind = (left * 256 // np.maximum(np.repeat(size, p), 1)).astype(np.uint8)
                ends = np.zeros((len(p), PARTS), dtype=np.uint16)
                has = np.flatnonzero(p > 0)
                for j in range(PARTS):
                    ends[has, j] = g[bounds[:-1][has] + part_length(p[has], j) - 1] >> _U(48)
                held.append((g[at], np.repeat(np.arange(sets, sets + len(p)), p), behind, sig, size, ends))
                elements += len(at)
                sets += len(p)
                if elements > 1_000_000:
                    yield blobs(*zip(*held), known, group)
                    held, elements, sets = [], 0, 0
        if elements:
            yield blobs(*zip(*held), known, group)

    return docs.select("text").where("doc_id is not null and text is not null").mapInArrow(trimmed(run), "shard int, data binary")


def part_length(prefix: np.ndarray, j: int) -> np.ndarray:
    """Elements in the first j + 1 of PARTS parts of a prefix."""
    return -(-prefix * (j + 1) // PARTS)


def signatures_of(g: np.ndarray, bounds: np.ndarray, hot: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Signatures of sets whose hot elements stand as ranks: those of the sets of hashes."""
    keys, rank = hot
    if len(keys):
        back = np.empty(len(keys), dtype=_U)
        back[rank] = keys
        is_hot = (g >> _U(63)) > 0
        g = np.where(is_hot, back[np.where(is_hot, g & _U((1 << 63) - 1), _U(0)).astype(np.int64) >> RANK_BIT], g)
    return signatures(g, bounds)


def _pairs(t: float, edges: np.ndarray, lists: np.ndarray, pair_shards: int):
    """Of one shard of elements: packed counts of the common elements of each pair of sets that may be similar enough, by shard of the pair. The smaller set of a pair is of the shard's band."""
    of_band = np.repeat(np.arange(len(lists)), lists)

    def run(table: pa.Table) -> pa.Table:
        band = int(of_band[table["shard"][0].as_py()])
        shards, upto = int(lists[band]), int(edges[band + 1])
        us, zs, es, gs = [], [], [], []
        read = lambda data: unpacked(data.as_buffer(), np.uint32, np.uint32, np.uint8, np.int64, np.int32, np.uint16, np.uint32)
        for data in table["data"]:
            *_, u, z, e, label = read(data)
            us.append(np.cumsum(u))
            zs.append(z)
            es.append(e.reshape(-1, PARTS))
            gs.append(label)
        # sets by size
        u, first, which = np.unique(np.concatenate(us), return_index=True, return_inverse=True)
        size = np.concatenate(zs)[first].astype(np.int64)
        order = np.argsort(size, kind="stable")
        number = np.empty(len(u), dtype=np.int64)
        number[order] = np.arange(len(u))
        u, first, size, which = u[order], first[order], size[order], number[which]
        ends, label = np.concatenate(es)[first], np.concatenate(gs)[first].astype(np.int32)
        del us, zs, es, gs, order, number
        # an entry is one number: element, set, what the set has behind it. Those that several batches have sent of a set count once
        bits = _U(max(1, len(u).bit_length()) + 8)
        entries, at = [], 0
        for data in table["data"]:
            k, i, q, sent, *_ = read(data)
            s = which[at : at + len(sent)]
            once = (first[s] == np.arange(at, at + len(sent)))[i]
            at += len(sent)
            k = np.cumsum(k, dtype=np.uint32)[once].astype(_U) >> (bits - _U(32)) if bits > 32 else np.cumsum(k, dtype=np.uint32)[once].astype(_U)
            entries.append((k << bits) | (s[i[once]].astype(_U) << _U(8)) | q[once].astype(_U))
        v = np.concatenate(entries)
        del entries, which, first
        v.sort()
        few = _U((1 << int(bits) - 8) - 1)
        s = ((v >> _U(8)) & few).astype(np.int32)
        start = np.flatnonzero(np.diff(v >> bits, prepend=~_U(0)))
        # partners of an entry: those after it in its list that aren't too large, but for those of its own large group
        fit = np.searchsorted(size, np.floor(size / t + 1e-9), "right").astype(_U)
        walkers = int(np.searchsorted(size, upto))  # sets that are the smaller one of a pair here
        free = label[s] == 0
        some = not free.all()
        if some:
            mine = label[s]
            mixed = np.minimum.reduceat(np.where(free, (1 << 31) - 1, mine), start) != np.maximum.reduceat(mine, start)
            every = free | np.repeat(mixed, np.diff(np.append(start, len(v))))  # lists in which several large groups meet are taken whole
            single = np.flatnonzero(free).astype(np.int32 if len(v) < 1 << 31 else np.int64)
            del mine, mixed
        prefix = prefix_length(size, t)
        after = np.stack([size, *(size - part_length(prefix, j) for j in range(PARTS))], axis=1)
        kept: list[tuple] = []
        n_of = np.bincount(s[s < walkers], minlength=walkers)
        ends_at = np.cumsum(n_of)
        i0 = 0
        while i0 < walkers:
            # walkers with about a million entries
            i1 = max(i0 + 1, int(np.searchsorted(ends_at, (ends_at[i0 - 1] if i0 else 0) + 1_000_000, "right")))
            has = np.flatnonzero((s >= i0) & (s < i1))
            i0 = i1
            has = has[np.argsort(s[has], kind="stable")]
            end = np.searchsorted(v, ((v[has] >> bits) << bits) + (fit[s[has]] << _U(8)), "left")
            lo = has + 1
            if some:
                e = every[has]
                lo = np.where(e, lo, np.searchsorted(single, has, "right"))
                end = np.where(e, end, np.searchsorted(single, end, "left"))
            n = np.maximum(end - lo, 0)
            del end
            # by the pair's first set, so that all of a pair comes at once and pairs that have too little go before others come
            go = n > 0
            has, lo, n = has[go], lo[go], n[go]
            of, total = s[has], np.cumsum(n)
            at = 0
            while at < len(has):
                to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + 1_000_000, "right")))
                to = int(np.searchsorted(of, of[to - 1], "right"))
                c = n[at:to]
                a = np.repeat(has[at:to], c)
                b = np.arange(len(a)) - np.repeat(np.cumsum(c) - c, c) + np.repeat(lo[at:to], c)
                at = to
                if some:
                    b = np.where(every[a], b, single[np.minimum(b, max(len(single) - 1, 0))] if len(single) else b)
                x, y = s[a], s[b]
                other = x != y
                if some:
                    other &= (label[x] == 0) | (label[x] != label[y])
                za, zb = size[x], size[y]
                ra, rb = (v[a] & _U(255)).astype(np.int64), (v[b] & _U(255)).astype(np.int64)
                # at most so much is before the element, and behind it: sets that stand too differently around it can't be similar
                rest = np.minimum(np.minimum((ra + 1) * za // 256 + 1, za - 1), np.minimum((rb + 1) * zb // 256 + 1, zb - 1))
                other &= np.minimum(za - 1 - ra * za // 256, zb - 1 - rb * zb // 256) + 1 + rest >= need(za, zb, t)
                x, y, count, least = _by_pair(x[other], y[other], rest[other])
                za, zb = size[x], size[y]
                share = -(-np.maximum(need(za, zb, t) - (case := _beyond(ends, after, x, y)), 1) // shards)
                ok = count >= share
                kept.append((x[ok].astype(np.int32), y[ok].astype(np.int32), count[ok].astype(np.uint32), share[ok].astype(np.uint32), np.minimum(least, case)[ok].astype(np.uint32)))
        del v, s, free
        a, b, count, share, least = (np.concatenate(x) for x in zip(*kept)) if kept else [np.zeros(0, np.int32)] * 5
        kept.clear()
        pair = (mix(u[a].astype(_U) ^ mix(u[b].astype(_U))) % _U(pair_shards)).astype(np.int64)
        order = np.argsort(pair, kind="stable")
        cuts = np.searchsorted(pair[order], np.arange(pair_shards + 1))
        out = []
        for r in range(pair_shards):
            o = order[cuts[r] : cuts[r + 1]]
            if not len(o):
                continue
            ids, w = np.unique(np.concatenate([a[o], b[o]]), return_inverse=True)
            # by signature
            ids_by = np.argsort(u[ids])
            place = np.empty(len(ids), dtype=np.int64)
            place[ids_by] = np.arange(len(ids))
            ids, w = ids[ids_by], place[w]
            x, y = w[: len(o)].astype(np.int32), w[len(o) :].astype(np.uint32)
            out.append((r, packed(np.diff(u[ids], prepend=0), size[ids].astype(np.int32), np.diff(x, prepend=np.int32(0)), y, count[o], least[o], share[o], np.array([shards], np.int32))))
        return pa.table({"shard": pa.array([r for r, _ in out], pa.int32()), "data": pa.array([d for _, d in out], pa.binary())})

    return trimmed(run)


def _by_pair(a: np.ndarray, b: np.ndarray, rest: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Each pair, how often it comes, and the least of its rests (or a little more, if sets are huge)."""
    if not len(a):
        return a, b, np.zeros(0, np.int64), rest
    low = int(a.min())
    left, right = (int(a.max()) - low).bit_length(), int(b.max()).bit_length()
    coarse = _U(max(0, int(rest.max()).bit_length() + left + right - 64))
    width = _U(64 - left - right)
    v = ((((a - low).astype(_U) << _U(right)) | b.astype(_U)) << width) | (rest.astype(_U) >> coarse) if left + right else rest.astype(_U)
    v.sort()
    pair = v >> width if left + right else np.zeros(len(v), _U)
    start = np.flatnonzero(np.concatenate([[True], pair[1:] != pair[:-1]]))
    count = np.diff(np.append(start, len(v)))
    pair, least = pair[start], (v[start] & ((_U(1) << width) - _U(1)) if left + right else v[start])
    least = ((least + _U(1)) << coarse) - _U(1)
    return (pair >> _U(right)).astype(np.int64) + low, (pair & _U((1 << right) - 1)).astype(np.int64), count, least.astype(np.int64)


def _beyond(ends: np.ndarray, after: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """At most so many common elements aren't in both prefixes: those beyond the end of the prefix that ends first, of which neither set has more than it has there. after: of each
    set, its elements behind each part of its prefix, and before them all."""
    ea, eb = ends[a], ends[b]
    # the parts of y that end before the prefix of x does
    ab = np.minimum(after[a, -1], after[b, (eb < ea[:, -1:]).sum(1)])
    ba = np.minimum(after[b, -1], after[a, (ea < eb[:, -1:]).sum(1)])
    return np.where(ea[:, -1] < eb[:, -1], ab, np.where(ea[:, -1] > eb[:, -1], ba, np.maximum(ab, ba)))


def _enough(t: float):
    """Of one shard of pairs: those whose common prefix elements leave them able to be similar enough. Shards that didn't report a pair have less than its share."""

    def run(table: pa.Table) -> pa.Table:
        A, B, C, R, S, Z, L = [], [], [], [], [], [], []
        for data in table["data"].to_pylist():
            u, z, x, y, c, r, share, shards = unpacked(data, np.int64, np.int32, np.int32, np.uint32, np.uint32, np.uint32, np.uint32, np.int32)
            u, x = np.cumsum(u), np.cumsum(x)
            A.append(u[x])
            B.append(u[y])
            C.append(c)
            R.append(r)
            S.append(share.astype(np.int64))
            Z.append(np.stack([z[x], z[y]]))
            L.append(np.full(len(x), shards[0], dtype=np.int64))
        a, b, c, r, z = np.concatenate(A), np.concatenate(B), np.concatenate(C).astype(np.int64), np.concatenate(R).astype(np.int64), np.concatenate(Z, axis=1).astype(np.int64)
        order = np.lexsort((b, a))
        a, b, c, r, z = a[order], b[order], c[order], r[order], z[:, order]
        share, shards = np.concatenate(S)[order], np.concatenate(L)[order]
        head = np.ones(len(a), dtype=bool)
        head[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        start = np.flatnonzero(head)
        # the last common element of the prefixes leaves the least behind it
        c, r, za, zb = np.add.reduceat(c, start), np.minimum.reduceat(r, start), z[0][start], z[1][start]
        silent = shards[start] - np.diff(np.append(start, len(a)))
        ok = c + silent * (share[start] - 1) + r >= need(za, zb, t)
        return pa.table({"a": a[start][ok], "b": b[start][ok]})

    return trimmed(run)


class Union:
    def __init__(self, n: int):
        self.p = list(range(n))

    def find(self, x: int) -> int:
        while self.p[x] != x:
            self.p[x] = self.p[self.p[x]]
            x = self.p[x]
        return x

    def join(self, a: int, b: int) -> None:
        a, b = self.find(a), self.find(b)
        self.p[max(a, b)] = min(a, b)


def trie_join(sets: list[np.ndarray], t: float, linked: Union | None = None, partners: dict[int, set[int]] | None = None) -> list[tuple[int, int, float]]:
    """Pairs (i, j, similarity) with similarity t at least, of sets given as sorted arrays.

    The sets sorted as sequences are the leaves of their prefix tree in order, and the common length of neighbours says where one
    branches off. A set walks the tree once: the overlap up to a branching point is kept for all leaves below it, and a subtree is left as soon as
    the overlap so far and what remains of both sets can't reach the least overlap. With `partners`, the walk goes only to leaves that are partners of the set. With
    `linked`, leaves in the walker's component are passed over, so that the pairs found only span the components.
    """
    order = sorted(range(len(sets)), key=lambda i: sets[i].astype(">u8").tobytes())
    s = [sets[i] for i in order]
    m = len(s)
    leaf = {i: k for k, i in enumerate(order)}
    common = np.zeros(m + 1, dtype=np.int64)
    for k in range(1, m):
        n = min(len(s[k - 1]), len(s[k]))
        d = np.flatnonzero(s[k - 1][:n] != s[k][:n])
        common[k] = d[0] if len(d) else n
    out = []
    for k in range(m):
        x, nx = s[k], len(s[k])
        if not nx:
            continue
        cum = np.zeros(1, dtype=np.int64)  # overlap after each element of the path that was walked last
        have = at = 0  # elements of it that the next leaf shares; the last leaf that was looked at
        js = range(k + 1, m) if partners is None else sorted(j for i in partners.get(order[k], ()) if (j := leaf[i]) > k)
        for j in js:
            ny = len(s[j])
            least = int(np.ceil(t / (1 + t) * (nx + ny) - 1e-9))
            if min(nx, ny) < least or (linked is not None and linked.find(order[k]) == linked.find(order[j])):
                continue
            if at:
                have = min(have, int(common[at + 1 : j + 1].min()))
            at = j
            y = s[j]
            # the bound at the point where this leaf leaves the path
            if have and int(cum[have]) + min(nx - int(np.searchsorted(x, y[have - 1], "right")), ny - have) < least:
                continue
            tail = y[have:]
            p = np.minimum(np.searchsorted(x, tail), nx - 1)
            cum = np.concatenate([cum[: have + 1], cum[have] + np.cumsum(x[p] == tail)])
            have = ny
            o = int(cum[ny])
            if o >= least and o / (nx + ny - o) >= t - 1e-12:
                out.append((order[k], order[j], o / (nx + ny - o)))
                if linked is not None:
                    linked.join(order[k], order[j])
    return out


def _sets(docs: DataFrame, n: int, hot) -> DataFrame:
    """Rows (sig, data): each set once in a batch, packed."""

    def run(batches):
        keys = hot.value
        for batch in batches:
            seen: set[int] = set()
            sigs, data = [], []
            for _, g, bounds in ordered_sets(batch.column(0), n, keys):
                for q, v in enumerate(signatures_of(g, bounds, keys).tolist()):
                    if bounds[q] < bounds[q + 1] and v not in seen:
                        seen.add(v)
                        sigs.append(v)
                        data.append(packed(np.diff(g[bounds[q] : bounds[q + 1]] >> _U(CUT), prepend=_U(0))))
            yield pa.RecordBatch.from_arrays([pa.array(sigs, pa.int64()), pa.array(data, pa.binary())], names=["sig", "data"])

    return docs.select("text").where("doc_id is not null and text is not null").mapInArrow(trimmed(run), "sig bigint, data binary")


def _links_within(sig: list[int], side: list[int], sets: list[np.ndarray], t: float) -> np.ndarray:
    """How many others each set is similar enough to: in a block (all sides 2), or between two blocks (sides 0 and 1). Overlaps of all are a product of 0-1 matrices, some elements at a time."""
    size = np.array([len(x) for x in sets])
    _, col, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(sets)), size)
    # an element of one set alone is in no overlap
    shared = np.cumsum(times > 1) - 1
    of = times[col] > 1
    row, col = row[of], shared[col[of]]
    order = np.argsort(col, kind="stable")
    row, col = row[order], col[order]
    left, right = (np.flatnonzero(np.isin(side, x)) for x in ((0, 2), (1, 2)))
    common = np.zeros((len(left), len(right)), dtype=np.float32)
    width = 4096
    for c in range(0, int(col[-1]) + 1 if len(col) else 0, width):
        i, j = np.searchsorted(col, (c, c + width))
        m = np.zeros((len(sets), width), dtype=np.float32)
        m[row[i:j], col[i:j] - c] = 1
        common += m[left] @ m[right].T
    common = common.astype(np.int64)
    near = common / (size[left][:, None] + size[right][None] - common) >= t - 1e-12
    near &= np.array(sig)[left][:, None] != np.array(sig)[right][None]
    out = np.zeros(len(sets), dtype=np.int64)
    out[left] += near.sum(1)
    if side[0] != 2:
        out[right] += near.sum(0)
    return out


def _verify(t: float, every: bool):
    """Of some parts, given their sets (data) and their candidate pairs (other): pairs (a, b) that are similar enough, all, or as many as join the groups; and of blocks of large groups
    (sets with a side), links of each set (a) to others there."""

    def run(table: pa.Table) -> pa.Table:
        sets: dict[int, dict[int, np.ndarray]] = {}
        sides: dict[int, dict[int, int]] = {}
        pairs: dict[int, list[tuple[int, int]]] = {}
        for part, sig, data, other, side in zip(table["part"].to_pylist(), table["sig"].to_pylist(), table["data"], table["other"].to_pylist(), table["side"].to_pylist()):
            if other is not None:
                pairs.setdefault(part, []).append((sig, other))
            elif sig not in (g := sets.setdefault(part, {})):
                g[sig] = np.cumsum(unpacked(data.as_py(), _U)[0], dtype=_U)
                if side is not None:
                    sides.setdefault(part, {})[sig] = side
        a, b, links = [], [], []
        for part, g in sets.items():
            sig = list(g)
            if part in sides:
                n = _links_within(sig, [sides[part][v] for v in sig], list(g.values()), t)
                a += sig
                b += [None] * len(sig)
                links += n.tolist()
                continue
            place = {v: i for i, v in enumerate(sig)}
            partners: dict[int, set[int]] = {}
            for x, y in pairs.get(part, ()):
                i, j = place[x], place[y]
                partners.setdefault(i, set()).add(j)
                partners.setdefault(j, set()).add(i)
            for i, j, _ in trie_join(list(g.values()), t, None if every else Union(len(sig)), partners):
                a.append(sig[i])
                b.append(sig[j])
                links.append(1)
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64()), "links": pa.array(links, pa.int64())})

    return trimmed(run)


def _stars(scan: DataFrame, large: int) -> DataFrame:
    """Pairs (a, b) of each of the lowest signatures and each other one among `large` or more that share a min-hash, if they share another one too."""
    nodes = scan.where("sig is not null").groupBy("sig").agg(F.min("m").alias("m"))
    part = lambda m, k: F.substring(m, 8 * k + 1, 8)
    met = nodes.select("sig", "m", F.explode(F.array(*[F.struct(F.lit(k).alias("k"), part("m", k).alias("h")) for k in range(HASHES)])).alias("key")).select("sig", "m", "key.k", "key.h")
    met = written(met, "hashes")
    many = met.groupBy("k", "h").count().where(F.col("count") >= large).drop("count")
    w = Window.partitionBy("k", "h").orderBy("sig")
    centre = met.withColumn("r", F.row_number().over(w)).where(F.col("r") <= CENTRES).select("k", "h", F.struct("sig", "m").alias("a")).join(many, ["k", "h"])
    pairs = met.join(small(written(centre, "centres")), ["k", "h"]).where("a.sig <> sig")
    same = sum((part(F.col("m"), k) == part(F.col("a.m"), k)).cast("int") for k in range(HASHES))
    return pairs.where(same >= 2).select(F.least("a.sig", "sig").alias("a"), F.greatest("a.sig", "sig").alias("b")).distinct()


def _similar(docs: DataFrame, sig: DataFrame, pairs: DataFrame, n: int, t: float, hot, shards: int, block: int, every: bool = False, crowds: DataFrame | None = None) -> DataFrame:
    """Of written candidate pairs (a, b), those that are similar enough (b and links 1): all, or as many as join the groups. The sets of a component meet in one task; those of a component of
    over WIDE `block` sets in one for each two of its blocks that have a pair. A set is made from one of its documents, as `sig` has them, if those are few enough to be told. With `crowds`, rows (node, root) of large groups, also links of each set (a, b null) to others of its group, in parts."""
    comp = components(pairs, "candidates")
    member = written(comp.union(comp.select("root", "root")).distinct(), "members")
    split = lambda m, most: m.join(small(m.groupBy("root").agg(F.expr(f"(count(1) - 1) div {most} + 1").alias("blocks"))), "root")
    own = lambda c: F.pmod(F.xxhash64(c), "blocks")
    part = lambda x, y: F.xxhash64("root", F.least(x, y), F.greatest(x, y))
    of = small(split(member, WIDE * block).select(F.col("node").alias("a"), "root", "blocks"))
    tied = written(pairs.join(of, "a").select("a", "b", F.when(F.col("blocks") == 1, F.col("root")).otherwise(part(own("a"), own("b"))).alias("part")), "tied")
    need_ = tied.select("part", F.col("a").alias("node")).union(tied.select("part", "b")).distinct().withColumn("side", F.lit(None).cast("int"))
    if crowds is not None:
        sent = split(crowds, block).withColumn("_own", own("node")).withColumn("_other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)))
        side = F.when(F.col("_own") == F.col("_other"), 2).otherwise((F.col("_own") > F.col("_other")).cast("int"))
        need_ = need_.union(sent.select(F.xxhash64(F.lit("crowd"), part("_own", "_other")), "node", side))
    need_ = written(need_, "needed")
    one = written(sig.join(small(need_.select(F.col("node").alias("sig")).distinct()), "sig").groupBy("sig").agg(F.min("doc_id").alias("_id")).select("_id").distinct(), "chosen")
    if one.count() <= BROADCAST_ROWS:
        docs = docs.join(F.broadcast(one), docs["doc_id"] == one["_id"], "left_semi")
    need_ = small(need_)
    sets = _sets(docs, n, hot)
    near = sets.join(need_, sets["sig"] == need_["node"]).select("part", "sig", "data", F.lit(None).cast("bigint").alias("other"), "side")
    near = near.union(tied.select("part", "a", F.lit(None).cast("binary"), "b", F.lit(None).cast("int")))
    near = near.withColumn("task", F.pmod(F.xxhash64("part"), F.lit(shards * 4)).cast("int"))
    return near.groupBy("task").applyInArrow(_verify(t, every), "a bigint, b bigint, links bigint")


def groups(docs: DataFrame, n: int = N, t: float = THRESHOLD, hot: int = HOT, hot_in_batch: int = HOT_IN_BATCH, large: int = LARGE, shard: int = SHARD, block: int = BLOCK, links: bool = True) -> DataFrame:
    """Rows (doc_id, group_id, size, links) for every document that is in a group of near copies; group_id is the group's lowest doc_id, links the number of other sets that its own is
    similar to (equal sets are one, so a document with exact copies alone has none; without `links` the column isn't made, which saves work).

    Two documents are near copies if the Jaccard similarity of their sets of word n-grams (lower case, runs of letters, digits and _) is t at
    least; groups are the connected components. The result is exact:

    1. one pass gives each set's signature (equal sets are one from here on) and the n-grams that many texts have, which come last in the global order;
    2. texts that share a min-hash with many others are compared with a few of them, which finds most of each large group without its square of pairs;
    3. each set sends its prefix in that order, packed, to the elements' shards of its band of sizes and of the band below, where lists of one element give pairs (but for those
       that a large group already links), with length bounds; pairs with less than a shard's share of what they need go at once, so each band has few shards;
       common prefix elements are added up over the shards, and pairs that can't reach t any more go;
    4. sets of a candidate component meet (in blocks, if they are many) and are joined by a prefix tree (see `trie_join`);
    5. links inside a large group are counted there block by block, as all of its pairs are looked at and a tree would prune little.

    Texts that are null or have no word are in no group; null doc_ids neither. Rows of the same doc_id are one document as to identity (each of their texts
    counts, and links are added up). A text of fewer than n words has one n-gram of all. A very long text is one set like any other. An empty table gives an empty result; columns other than doc_id and text aren't read.
    """
    spark = docs.sparkSession
    shards = parts(spark)
    scan = written(_scan(docs, n, hot_in_batch), "scan")
    sig = scan.where("sig is not null").select("doc_id", "sig").distinct()
    top = scan.where("key is not null").groupBy("key").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "key").limit(hot).toPandas()
    keys, rank = top["key"].to_numpy(dtype=np.int64).astype(_U), np.arange(len(top), dtype=np.int64)[::-1]
    order = np.argsort(keys)
    ranks = spark.sparkContext.broadcast((keys[order], rank[order].copy()))

    keep: list[DataFrame] = []
    with scratch(keep):
        first = written(_similar(docs, sig, written(_stars(scan, large), "stars"), n, t, ranks, shards, block).select("a", "b"), "first")
        keep.append(first)
    big = components(first, "large")
    sizes = big.groupBy("root").agg((F.count(F.lit(1)) + 1).alias("c")).where(F.col("c") >= large)
    crowds = written(big.union(big.select("root", "root")).distinct().join(small(sizes), "root").orderBy(F.desc("c"), "root", "node").limit(LABELS).select("node", "root"), "known")
    known = crowds.toPandas().sort_values("node")
    label = np.unique(known["root"].to_numpy(dtype=np.int64), return_inverse=True)[1] + 1
    labels = spark.sparkContext.broadcast((known["node"].to_numpy(dtype=np.int64), label))

    # bands of sizes whose sets meet only within them and with the next, and their shards: fewer would not fit, more would split what a pair has in common
    per = scan.where("sig is not null").groupBy("sig").agg(F.first("z").alias("z")).groupBy("z").count().toPandas().astype("int64")
    z, many = per["z"].to_numpy(), per["count"].to_numpy()
    edges = bands(t, int(z.max(initial=0)))
    elements = np.bincount(np.searchsorted(edges, z, "right") - 1, weights=prefix_length(z, t) * many, minlength=len(edges) - 1).astype(np.int64)
    lists = lists_of(edges, elements, shard)
    count = max(1, int(lists.sum()))
    pairs = _prefixes(docs, n, t, ranks, labels, edges, lists).repartition(count, "shard").groupBy("shard").applyInArrow(_pairs(t, edges, lists, shards), "shard int, data binary")
    cand = written(pairs.groupBy("shard").applyInArrow(_enough(t), "a bigint, b bigint"), "pairs")
    found = written(_similar(docs, sig, cand, n, t, ranks, shards, block, links, crowds if links else None), "found")
    near = found.where("b is not null").select("a", "b")
    root = components(first.union(near), "groups")
    # groups of signatures, then of documents; equal sets and equal ids link too
    s = sig.join(small(root), sig["sig"] == root["node"], "left").select("doc_id", "sig", F.coalesce("root", "sig").alias("root"))
    out = ["doc_id", "group_id", "size"]
    if links:
        degree = found.select(F.col("a").alias("_sig"), "links").union(near.select("b", F.lit(1).cast("bigint"))).groupBy("_sig").agg(F.sum("links").alias("links"))
        degree = small(written(degree, "degrees"))
        s = s.join(degree, s["sig"] == degree["_sig"], "left").select("doc_id", "root", F.coalesce("links", F.lit(0)).alias("links"))
        out.append("links")
    else:
        s = s.select("doc_id", "root", F.lit(0).cast("bigint").alias("links"))
    s = written(s, "linked")
    if not s.groupBy("doc_id").count().where("count > 1").isEmpty():
        # one doc_id with several texts: link its groups
        tied = s.groupBy("doc_id").agg(F.min("root").alias("m")).join(s, "doc_id").select(F.col("root").alias("a"), F.col("m").alias("b"))
        again = components(tied, "tied")
        s = s.join(small(again), s["root"] == again["node"], "left").select("doc_id", F.coalesce(again["root"], s["root"]).alias("root"), "links")
        s = s.groupBy("doc_id").agg(F.min("root").alias("root"), F.sum("links").alias("links"))
    g = s.groupBy("root").agg(F.min("doc_id").alias("group_id"), F.count(F.lit(1)).alias("size")).where("size > 1")
    return s.join(g, "root").select(*out)


#: The same by brute force: pairs of different sets with an n-gram in common, and components by recursion.
SQL = rf"""
WITH RECURSIVE t AS (SELECT doc_id, regexp_extract_all(lower(text), '[0-9a-z_\x{{80}}-\x{{10FFFF}}]+') AS w FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
s AS (SELECT DISTINCT doc_id, list_sort(list_distinct(CASE WHEN len(w) < 2 THEN w ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END)) AS g FROM t WHERE len(w) > 0),
u AS (SELECT g, len(g) AS n, row_number() OVER (ORDER BY g) AS k FROM (SELECT DISTINCT g FROM s)),
m AS (SELECT doc_id, k FROM s JOIN u USING (g)),
e AS (SELECT k, n, unnest(g) AS x FROM u),
p AS (SELECT a.k AS a, b.k AS b FROM e a JOIN e b ON a.x = b.x AND a.k < b.k AND a.n >= {THRESHOLD} * b.n AND b.n >= {THRESHOLD} * a.n GROUP BY a.k, b.k, a.n, b.n HAVING count(*) / (a.n + b.n - count(*)) >= {THRESHOLD} - 1e-12),
l AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p),
d AS (SELECT a AS k, count(*) AS links FROM l GROUP BY a),
c AS (SELECT a, b FROM l UNION SELECT x.k, y.k FROM m x JOIN m y USING (doc_id) WHERE x.k <> y.k),
r AS (SELECT k AS a, k AS b FROM u UNION SELECT r.a, c.b FROM r JOIN c ON r.b = c.a),
f AS (SELECT a AS k, min(b) AS root FROM r GROUP BY a),
o AS (SELECT doc_id, min(root) AS root, CAST(sum(coalesce(links, 0)) AS BIGINT) AS links FROM m JOIN f USING (k) LEFT JOIN d USING (k) GROUP BY doc_id),
z AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY root) AS group_id, count(*) OVER (PARTITION BY root) AS size, links FROM o)
SELECT * FROM z WHERE size > 1
"""


def keep_one(docs: DataFrame, **how) -> DataFrame:
    """The documents but for those of a group whose doc_id isn't its lowest, and one row of each doc_id; columns stay as they are."""
    cols = docs.columns
    keep: list[DataFrame] = []
    with scratch(keep):
        drop = written(groups(docs, links=False, **how).where("doc_id <> group_id").select(F.col("doc_id").alias("_gone")), "copies")
        keep.append(drop)
    kept = docs.join(small(drop), docs["doc_id"] == drop["_gone"], "left_anti")
    twice = written(docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias("_twice")), "twice")
    if twice.isEmpty():
        return kept.select(*cols)
    t = small(twice)
    once = kept.join(t, kept["doc_id"] == t["_twice"], "left_anti").select(*cols)
    return once.unionByName(kept.join(t, kept["doc_id"] == t["_twice"], "left_semi").select(*cols).dropDuplicates(["doc_id"]))
