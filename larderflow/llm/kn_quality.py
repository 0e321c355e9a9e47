"""Quality by perplexity under an interpolated modified Kneser-Ney bigram model of trusted text."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, mix, packed, parts, scratch, slices, small, span_hashes, trimmed, unpacked, utf8, word_spans, written

#: Shards that share a context's pairs.
SPREAD = 4
#: Bytes of the filter that tells most unseen pairs and words apart before they are sent; a model too large for it only sends more.
FILTER_BYTES = 64_000_000
#: Words and pairs, the most frequent of each shard, whose values go to all tasks: a fixed number whatever the model's size. They are most of a text and aren't sent.
HOT_WORDS, HOT_PAIRS = 65_536, 1_000_000
#: A language's limit on log perplexity: its HIGH quantile over held-out trusted texts, and MARGIN times as far again as that lies from the median.
HIGH, MARGIN = 0.99, 0.0
#: Words that a text's score is drawn to its language's median with, so that a few words alone don't condemn it.
PRIOR_WORDS = 5
#: Of 16 parts of the trusted texts (by md5 of doc_id), so many train the model; limits come from the others.
TRAIN_PARTS = 8

_U = np.uint64
_WORD = np.ones(256, dtype=bool)
_WORD[[0, 9, 10, 11, 12, 13, 32]] = False
BOS, EOS = 1, 2


def pairs_of(x: np.ndarray, o: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Context, word and text of each bigram; words are runs of bytes that aren't ASCII white space, as 48-bit hashes, and a text has a
    begin as its first context and an end as its last word. A text without words has none."""
    start, end, doc = word_spans(x, o, _WORD)
    h = (span_hashes(x, start, end) >> _U(16)) | _U(4)
    n = np.bincount(doc, minlength=len(o) - 1)
    size = np.where(n > 0, n + 1, 0)
    first = np.cumsum(size) - size
    at = np.arange(len(h)) - (np.cumsum(n) - n)[doc] + first[doc]
    v = np.full(int(size.sum()), BOS, dtype=_U)
    w = np.full(int(size.sum()), EOS, dtype=_U)
    v[at + 1] = h
    w[at] = h
    return v, w, np.repeat(np.arange(len(n)), size)


def pair_key(v: np.ndarray, w: np.ndarray) -> np.ndarray:
    return mix(mix(v) * _U(3) + w) >> _U(16)


def place(v: np.ndarray, shards: int) -> np.ndarray:
    return (mix(v) % _U(shards)).astype(np.int64)


def place_of_pair(v: np.ndarray, w: np.ndarray, shards: int) -> np.ndarray:
    return (mix(v * _U(SPREAD) + mix(w) % _U(SPREAD)) % _U(shards)).astype(np.int64)


def _sums(key: np.ndarray, *cols: np.ndarray) -> list[np.ndarray]:
    """Distinct keys, sorted, and sums of the columns."""
    order = np.argsort(key, kind="stable")
    k = key[order]
    head = np.ones(len(k), dtype=bool)
    head[1:] = k[1:] != k[:-1]
    start = np.flatnonzero(head)
    return [k[start], *(np.add.reduceat(c[order], start) if len(start) else c[:0] for c in cols)]


def _pair_sums(v: np.ndarray, w: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order = np.lexsort((w, v))
    v, w, c = v[order], w[order], c[order]
    head = np.ones(len(v), dtype=bool)
    head[1:] = (v[1:] != v[:-1]) | (w[1:] != w[:-1])
    start = np.flatnonzero(head)
    return v[start], w[start], (np.add.reduceat(c, start) if len(start) else c)


def _blocks(column):
    b, offsets = utf8(column)
    for i, j in slices(offsets, 2_000_000):
        yield i, j, b[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]


def discounts(n: list[int]) -> np.ndarray:
    """Modified Kneser-Ney discounts of counts 0, 1, 2 and 3 or more, from how many have the counts 1 to 4."""
    n1, n2, n3, n4 = n
    if not n1 or not n2:
        return np.array([0.0, 0.5, 0.5, 0.5]) if n1 else np.zeros(4)
    y = n1 / (n1 + 2 * n2)
    d = [0.0, 1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3 if n3 else 2 - 3 * y * n3 / n2]
    return np.array([min(max(x, 0.0), float(i)) for i, x in enumerate(d)])


COLS = "kind int, target int, origin int, data binary, c1 bigint, c2 bigint, c3 bigint, c4 bigint, c5 bigint, c6 bigint"
_TYPES = [pa.int32(), pa.int32(), pa.int32(), pa.binary()] + [pa.int64()] * 6
_NAMES = [x.split()[0] for x in COLS.split(", ")]


def _table(rows: list[tuple]) -> pa.Table:
    cols = list(zip(*(r + (None,) * (10 - len(r)) for r in rows))) or [()] * 10
    return pa.table([pa.array(c, t) for c, t in zip(cols, _TYPES)], names=_NAMES)


def _count(shards: int):
    """Map: bigram counts of a batch, packed by shard."""

    def run(batches):
        for batch in batches:
            got = [_pair_sums(*(z := pairs_of(x, o))[:2], np.ones(len(z[0]), dtype=np.int64)) for _, _, x, o in _blocks(batch.column(0))]
            if not got:
                continue
            v, w, c = _pair_sums(*(np.concatenate(a) for a in zip(*got)))
            s = place_of_pair(v, w, shards)
            order = np.argsort(s, kind="stable")
            cuts = np.searchsorted(s[order], np.arange(shards + 1))
            out = []
            for q in range(shards):
                k = order[cuts[q] : cuts[q + 1]]
                if len(k):
                    out.append((q, packed(np.diff(v[k], prepend=_U(0)), w[k], c[k].astype(np.uint32))))
            yield pa.RecordBatch.from_arrays([pa.array([q for q, _ in out], pa.int32()), pa.array([d for _, d in out], pa.binary())], names=["target", "data"])

    return trimmed(run)


def _merge(shards: int):
    """Of one shard: all its bigrams with their counts (kind 0); what they say of each word, by the word's shard (kind 1); counts of counts (kind 2)."""

    def run(table: pa.Table) -> pa.Table:
        me = table["target"][0].as_py()
        V, W, C = [], [], []
        for data in table["data"].to_pylist():
            v, w, c = unpacked(data, _U, _U, np.uint32)
            V.append(np.cumsum(v, dtype=_U))
            W.append(w)
            C.append(c.astype(np.int64))
        v, w, c = _pair_sums(np.concatenate(V), np.concatenate(W), np.concatenate(C))
        rows: list[tuple] = [(0, me, me, packed(np.diff(v, prepend=_U(0)), w, c.astype(np.uint32)))]
        z, o = np.zeros(len(v), dtype=np.int64), np.ones(len(v), dtype=np.int64)
        word, total, n1, n2, n3, cont = _sums(np.concatenate([v, w]), np.concatenate([c, z]), *(np.concatenate([(x).astype(np.int64), z]) for x in (c == 1, c == 2, c > 2)), np.concatenate([z, o]))
        to = place(word, shards)
        for q in np.unique(to).tolist():
            k = to == q
            rows.append((1, q, me, packed(np.diff(word[k], prepend=_U(0)), *(a[k].astype(np.uint32) for a in (n1, n2, n3, cont)), total[k])))
        rows.append((2, me, me, None, *((c == i).sum().item() for i in (1, 2, 3, 4)), len(c), int(c.sum())))
        return _table(rows)

    return trimmed(run)


def _words(shards: int):
    """Of one shard of words: their statistics over all shards, sent to all that ask for the word and kept here (kind 3); counts of the numbers of
    contexts (kind 4)."""

    def run(table: pa.Table) -> pa.Table:
        me = table["target"][0].as_py()
        got, ask = [], []
        for origin, data in zip(table["origin"].to_pylist(), table["data"].to_pylist()):
            w, *n = unpacked(data, _U, np.uint32, np.uint32, np.uint32, np.uint32, np.int64)
            w = np.cumsum(w, dtype=_U)
            got.append([w, *(a.astype(np.int64) for a in n)])
            ask.append((w, np.full(len(w), origin)))
        word, n1, n2, n3, cont, total = _sums(*(np.concatenate(a) for a in zip(*got)))
        ask.append((word, np.full(len(word), me)))
        aw, to = (np.concatenate(a) for a in zip(*ask))
        order = np.lexsort((aw, to))
        aw, to = aw[order], to[order]
        new = np.ones(len(aw), dtype=bool)
        new[1:] = (aw[1:] != aw[:-1]) | (to[1:] != to[:-1])
        aw, to = aw[new], to[new]
        cuts = np.searchsorted(to, np.arange(shards + 1))
        rows: list[tuple] = []
        for q in range(shards):
            w = aw[cuts[q] : cuts[q + 1]]
            if len(w):
                i = np.searchsorted(word, w)
                rows.append((3, q, me, packed(np.diff(w, prepend=_U(0)), *(a[i].astype(np.uint32) for a in (n1, n2, n3, cont)), total[i])))
        seen = cont > 0
        rows.append((4, me, me, None, *((cont == i).sum().item() for i in (1, 2, 3, 4)), int(seen.sum()), int(cont.sum())))
        return _table(rows)

    return trimmed(run)


class Levels:
    """Discounts and totals that all shards need."""

    def __init__(self, pairs: list[int], words: list[int]):
        self.d2, self.d1 = discounts(pairs[:4]), discounts(words[:4])
        self.vocabulary, self.contexts = words[4] + 1, words[5]  # with the unknown word
        n1, n2, n3 = words[0], words[1], words[4] - words[0] - words[1]
        self.rest = float(self.d1[1] * n1 + self.d1[2] * n2 + self.d1[3] * n3) / max(self.contexts, 1)

    def unigram(self, cont: np.ndarray) -> np.ndarray:
        """Probability of words that follow so many distinct contexts, interpolated with the even distribution."""
        return np.maximum(cont - self.d1[np.minimum(cont, 3)], 0) / max(self.contexts, 1) + self.rest / self.vocabulary

    @property
    def unknown(self) -> float:
        p = float(self.unigram(np.array([0]))[0])
        return float(np.log(p)) if p > 0 else float(np.log(1 / self.vocabulary) - 1)

    def backoff(self, total: np.ndarray, n1: np.ndarray, n2: np.ndarray, n3: np.ndarray) -> np.ndarray:
        """What a context leaves to the unigrams; 1 for one never seen."""
        left = self.d2[1] * n1 + self.d2[2] * n2 + self.d2[3] * n3
        return np.where(total > 0, np.maximum(left, 1e-9) / np.maximum(total, 1), 1.0)


def _bits(keys: np.ndarray, most: int) -> np.ndarray:
    size = 64
    while size < 10 * len(keys) and size * 2 <= max(most, 64):
        size *= 2
    a = np.zeros(size, dtype=bool)
    for k in _probes(keys):
        a[(k & _U(size - 1)).astype(np.int64)] = True
    return np.packbits(a, bitorder="little")


def _probes(keys: np.ndarray) -> list[np.ndarray]:
    h = mix(keys + _U(0x51ED270B))
    return [h, h >> _U(21), (h >> _U(42)) | ((h & _U(0x3FF)) << _U(22))]


class Filter:
    """The shards' bit tables in one array."""

    def __init__(self, tables: list[bytes]):
        a = [np.frombuffer(t, dtype=np.uint8) for t in tables]
        self.base = np.cumsum([0, *(len(x) * 8 for x in a)])[:-1]
        self.mask = np.array([max(len(x) * 8, 1) - 1 for x in a], dtype=_U)
        self.none = np.array([not len(x) for x in a])
        self.bits = np.concatenate([*a, np.zeros(1, np.uint8)])

    def has(self, keys: np.ndarray, shard: np.ndarray) -> np.ndarray:
        base, mask, ok = self.base[shard], self.mask[shard], ~self.none[shard]
        for k in _probes(keys):
            p = base + (k & mask).astype(np.int64)
            ok &= (self.bits[p >> 3] >> (p & 7).astype(np.uint8)) & 1 > 0
        return ok


def _finish(levels: Levels, shards: int):
    """Of one shard: values of its words and pairs (kind 5) and its bit tables for words and pairs (kinds 6 and 7).

    As interpolation gives log P(w | v) = log P(w) + log backoff(v) + log(1 + discounted share / (backoff(v) P(w))), a text's score is a sum of
    values looked up by word and by pair, and a pair not seen adds nothing.
    """

    def run(table: pa.Table) -> pa.Table:
        me = table["target"][0].as_py()
        stats, model = [], None
        for kind, data in zip(table["kind"].to_pylist(), table["data"].to_pylist()):
            if kind == 0:
                v, w, c = unpacked(data, _U, _U, np.uint32)
                model = np.cumsum(v, dtype=_U), w, c.astype(np.int64)
            else:
                w, *n = unpacked(data, _U, np.uint32, np.uint32, np.uint32, np.uint32, np.int64)
                stats.append([np.cumsum(w, dtype=_U), *(a.astype(np.int64) for a in n)])
        word, n1, n2, n3, cont, total = (np.concatenate(a) for a in zip(*stats))
        order = np.argsort(word)
        word, n1, n2, n3, cont, total = (a[order] for a in (word, n1, n2, n3, cont, total))
        p, g = levels.unigram(cont), levels.backoff(total, n1, n2, n3)
        own = place(word, shards) == me
        value = np.log(p) + np.log(g)
        value[word == BOS] = np.log(g[word == BOS])  # it is never predicted
        key, delta = np.zeros(0, dtype=_U), np.zeros(0)
        hot = np.zeros(0, dtype=_U), np.zeros(0, dtype=np.float32)
        if model is not None:
            v, w, c = model
            i, j = np.searchsorted(word, v), np.searchsorted(word, w)
            key = pair_key(v, w)
            delta = np.log1p((c - levels.d2[np.minimum(c, 3)]) / total[i] / (g[i] * p[j]))
            top = np.argsort(-c, kind="stable")[: HOT_PAIRS // shards]
            hot = key[top], delta[top].astype(np.float32)
            order = np.argsort(key)
            key, delta = key[order], delta[order]
        end = word == EOS
        top = np.flatnonzero(own)
        top = top[np.argsort(-total[top], kind="stable")][: HOT_WORDS // shards]
        rows: list[tuple] = [(5, me, me, packed(word[own], value[own].astype(np.float32), key, delta.astype(np.float32)))]
        most = FILTER_BYTES * 8 // shards
        rows += [(6, me, me, _bits(word[own], most // 4).tobytes()), (7, me, me, _bits(key, most).tobytes())]
        rows.append((9, me, me, packed(word[top], value[top].astype(np.float32), *hot)))
        if end.any():
            rows.append((8, me, me, np.log(p[end][:1]).tobytes()))
        return _table(rows)

    return trimmed(run)


REQUEST = "target int, batch bigint, kind int, data binary"


def _hot(found: np.ndarray, at: np.ndarray, hot: tuple[np.ndarray, np.ndarray], doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Of the keys found[at]: the sum of the hot ones' values for each text, and the places of the others."""
    keys, values = hot
    if not len(keys) or not len(at):
        return np.zeros(n), at
    k = found[at]
    i = np.minimum(np.searchsorted(keys, k), len(keys) - 1)
    is_hot = keys[i] == k
    return np.bincount(doc[at[is_hot]], weights=values[i[is_hot]], minlength=n), at[~is_hot]


def _requests(shards: int, filters, hots):
    """Map: of a batch, the pairs and words that the model may have, packed by shard (kind 1), but for hot ones, and to a target below 0, as many as there are shards, what is known of each text without asking:
    its words, how many of them the model may have, and the sum of the hot values (kind: minus the number of questions, less 1)."""

    def run(batches):
        for batch in batches:
            (fw, fp), (hw, hp) = filters.value, hots.value
            hot = np.zeros(batch.num_rows)
            n = batch.num_rows
            known = np.zeros(n, dtype=np.int64)
            every = np.zeros(n, dtype=np.int64)
            parts_: list[tuple] = []
            digest = 0
            for i, j, x, o in _blocks(batch.column(1)):
                v, w, doc = pairs_of(x, o)
                doc = doc + i
                every += np.bincount(doc[v != BOS], minlength=n)
                if len(v):
                    digest = (digest * 31 + int(mix(pair_key(v, w) + np.arange(len(v), dtype=_U)).sum(dtype=_U))) & ((1 << 62) - 1)
                s = place_of_pair(v, w, shards)
                home = place(v, shards)
                u = fw.has(v, home)
                known += np.bincount(doc[u & (v != BOS)], minlength=n)
                key = pair_key(v, w)
                x, u = _hot(v, np.flatnonzero(u), hw, doc, n)
                y, b = _hot(key, np.flatnonzero(fp.has(key, s)), hp, doc, n)
                hot += x + y
                parts_.append((home[u].astype(np.int32), v[u], doc[u].astype(np.int32), s[b].astype(np.int32), key[b], doc[b].astype(np.int32)))
            ids = batch.column(0).cast(pa.int64())
            for k in ids.to_pylist():
                digest = (digest * 1_000_003 + (k or 0)) & ((1 << 62) - 1)
            if not parts_:
                parts_ = [tuple(np.zeros(0, t) for t in (np.int32, _U, np.int32) * 2)]
            su, v, du, sb, key, db = (np.concatenate(a) for a in zip(*parts_))
            lang = batch.column(2)
            base = pa.RecordBatch.from_arrays([ids, lang, pa.array(every), pa.array(known), pa.array(hot)], names=["doc_id", "lang", "words", "known", "hot"])
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, base.schema) as out:
                out.write_batch(base)
            kind = np.uint16 if n < 65536 else np.uint32
            ou, ob = np.lexsort((du, v, su)), np.lexsort((db, key, sb))
            su, v, du, sb, key, db = su[ou], v[ou], du[ou].astype(kind), sb[ob], key[ob], db[ob].astype(kind)
            cu, cb = np.searchsorted(su, np.arange(shards + 1)), np.searchsorted(sb, np.arange(shards + 1))
            rows = []
            for q in range(shards):
                a, b = slice(cu[q], cu[q + 1]), slice(cb[q], cb[q + 1])
                if a.stop > a.start or b.stop > b.start:
                    # of words: how often each text has them
                    vv, dd = v[a], du[a]
                    head = np.ones(len(vv), dtype=bool)
                    head[1:] = (vv[1:] != vv[:-1]) | (dd[1:] != dd[:-1])
                    at = np.flatnonzero(head)
                    times = np.diff(np.append(at, len(vv))).astype(np.uint32)
                    rows.append((q, packed(np.array([n], np.int64), np.diff(vv[at], prepend=_U(0)), _step(vv[at], dd[at].astype(np.uint32)), times, np.diff(key[b], prepend=_U(0)), _step(key[b], db[b].astype(np.uint32)))))
            t = [-1 - digest % shards] + [q for q, _ in rows]
            yield pa.RecordBatch.from_arrays(
                [pa.array(t, pa.int32()), pa.array([digest] * len(t), pa.int64()), pa.array([-len(rows) - 1] + [1] * len(rows), pa.int32()), pa.array([sink.getvalue().to_pybytes()] + [d for _, d in rows], pa.binary())], names=["target", "batch", "kind", "data"]
            )

    return trimmed(run)


def _step(key: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Differences of ascending numbers within runs of one key."""
    d = doc.copy()
    same = key[1:] == key[:-1]
    d[1:][same] -= doc[:-1][same]
    return d


def _unstep(first: np.ndarray, d: np.ndarray) -> np.ndarray:
    """The reverse, given where runs begin."""
    c = np.cumsum(d.astype(np.int64))
    start = np.flatnonzero(first)
    run = np.cumsum(first) - 1
    return c - (c[start] - d[start].astype(np.int64))[run] if len(start) else c


def _answer(levels: Levels):
    """Of one shard: for each batch, the sum of what its texts' words and pairs add here."""

    def run(table: pa.Table) -> pa.Table:
        word, value, key, delta = np.zeros(0, _U), np.zeros(0, np.float32), np.zeros(0, _U), np.zeros(0, np.float32)
        data, kinds = table["data"], table["kind"].to_pylist()
        for k, kind in enumerate(kinds):
            if kind == 5:
                word, value, key, delta = unpacked(data[k].as_py(), _U, np.float32, _U, np.float32)
        batch, out = [], []
        for k, (kind, b) in enumerate(zip(kinds, table["batch"].to_pylist())):
            if kind != 1:
                continue
            n, v, dv, times, p, dp = unpacked(data[k].as_py(), np.int64, _U, np.uint32, np.uint32, _U, np.uint32)
            first = v != 0
            first[:1] = True
            dv = _unstep(first, dv)
            v = np.cumsum(v, dtype=_U)
            first = p != 0
            first[:1] = True
            dp = _unstep(first, dp)
            p = np.cumsum(p, dtype=_U)
            x = _look(word, value, v, levels.unknown)
            x[(v == BOS) & ~np.isin(v, word)] = 0.0
            total = np.bincount(dv, weights=x * times, minlength=n[0]) + np.bincount(dp, weights=_look(key, delta, p, 0.0), minlength=n[0])
            batch.append(b)
            out.append(packed(total.astype(np.float32)))
        return pa.table({"batch": pa.array(batch, pa.int64()), "kind": pa.array([1] * len(batch), pa.int32()), "data": pa.array(out, pa.binary())})

    return trimmed(run)


def _look(keys: np.ndarray, values: np.ndarray, q: np.ndarray, missing: float) -> np.ndarray:
    if not len(keys):
        return np.full(len(q), missing)
    i = np.minimum(np.searchsorted(keys, q), len(keys) - 1)
    return np.where(keys[i] == q, values[i].astype(np.float64), missing)


def _gather(levels: Levels, end: float):
    """Of one batch: its texts' words and log probabilities. An answer that is missing fails the job."""

    def run(table: pa.Table) -> pa.Table:
        kinds, data = table["kind"].to_pylist(), table["data"].to_pylist()
        bases = [k for k, kind in enumerate(kinds) if kind < 0]
        want = {-kinds[k] - 1 for k in bases}
        answers = len(kinds) - len(bases)
        # batches alike in texts and ids are one key; each sends the same
        if len(want) != 1 or answers != want.pop() * len(bases):
            raise RuntimeError("a batch has lost answers")
        t = pa.ipc.open_stream(data[bases[0]]).read_all()
        total = np.zeros(t.num_rows)
        for k, kind in enumerate(kinds):
            if kind > 0:
                total += unpacked(data[k], np.float32)[0]
        n, known = t["words"].to_numpy(), t["known"].to_numpy()
        lp = total / len(bases) + t["hot"].to_numpy() + (n - known) * levels.unknown + end
        lp = pa.array(np.where(n > 0, lp, np.nan), from_pandas=True)
        one = pa.table({"doc_id": t["doc_id"], "lang": t["lang"], "words": t["words"], "log_prob": lp})
        return pa.concat_tables([one] * len(bases))

    return trimmed(run)


def trusted(labels: DataFrame) -> DataFrame:
    return labels.where("quality = 1 and coalesce(toxic, 0) = 0 and doc_id is not null").select(F.col("doc_id").alias("_good")).distinct()


def _train_part() -> F.Column:
    return F.conv(F.substring(F.md5(F.concat(F.lit("fold|"), F.col("_good").cast("string"))), 1, 1), 16, 10).cast("int") < TRAIN_PARTS


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows (doc_id, lang, words, log_prob), one for each document; log_prob is null for a text without words, and for all if no trusted text has any.

    The model counts the bigrams of all trusted texts of the training parts. Counts, word statistics and values live in shards by context and
    meet by shuffles of packed arrays; documents send their words and pairs to the shards, and the sums that come back make their scores. Only totals (a
    few numbers a shard) and the filter of at most FILTER_BYTES pass the driver.
    """
    spark = docs.sparkSession
    shards = parts(spark)
    good = small(trusted(labels).where(_train_part()))
    text = docs.select("doc_id", "text").where("text is not null").join(good, docs["doc_id"] == good["_good"], "left_semi").select("text")
    counts = text.mapInArrow(_count(shards), "target int, data binary").groupBy("target").applyInArrow(_merge(shards), COLS)
    counts = written(counts, "counts")
    sums = ["sum(c1)", "sum(c2)", "sum(c3)", "sum(c4)", "sum(c5)", "sum(c6)"]
    two = [x or 0 for x in counts.where("kind = 2").selectExpr(*sums).first()]
    if not two[5]:
        return docs.select("doc_id", "lang", F.lit(None).cast("bigint").alias("words"), F.lit(None).cast("double").alias("log_prob"))
    words = written(counts.where("kind = 1").groupBy("target").applyInArrow(_words(shards), COLS), "words")
    one = [x or 0 for x in words.where("kind = 4").selectExpr(*sums).first()]
    levels = Levels(two, one)
    model = counts.where("kind = 0").union(words.where("kind = 3")).groupBy("target").applyInArrow(_finish(levels, shards), COLS)
    model = written(model.select("kind", "target", "data"), "model")
    discard(counts, words)
    tables: dict[int, list[bytes]] = {6: [b""] * shards, 7: [b""] * shards}
    end, hot = 0.0, []
    for r in model.where("kind > 5").collect():
        if r["kind"] == 8:
            end = float(np.frombuffer(r["data"], dtype=np.float64)[0])
        elif r["kind"] == 9:
            hot.append(unpacked(bytes(r["data"]), _U, np.float32, _U, np.float32))
        else:
            tables[r["kind"]][r["target"]] = bytes(r["data"])
    hots = []
    for k in (0, 2):
        keys, first = np.unique(np.concatenate([h[k] for h in hot]), return_index=True)
        hots.append((keys, np.concatenate([h[k + 1] for h in hot])[first].astype(np.float64)))
    filters = spark.sparkContext.broadcast((Filter(tables[6]), Filter(tables[7])))
    asked = docs.select("doc_id", "text", "lang").mapInArrow(_requests(shards, filters, spark.sparkContext.broadcast(hots)), REQUEST)
    # texts are read once; what stays with the batch travels beside the questions
    held = model.where("kind = 5").select("target", F.lit(0).cast("bigint").alias("batch"), "kind", "data")
    answers = asked.union(held).groupBy("target").applyInArrow(_pass_or(_answer(levels)), "batch bigint, kind int, data binary")
    return answers.groupBy("batch").applyInArrow(_gather(levels, end), "doc_id bigint, lang string, words bigint, log_prob double")


def _pass_or(answer):
    def run(table: pa.Table) -> pa.Table:
        if table["target"][0].as_py() < 0:
            return table.select(["batch", "kind", "data"])
        return answer(table)

    return trimmed(run)


def classify(docs: DataFrame, labels: DataFrame, high: float = HIGH, margin: float = MARGIN) -> DataFrame:
    """Rows (doc_id, lang, words, perplexity, ceiling, keep), one for each document.

    perplexity is exp of minus log_prob by word (the text's end counts as one); keep says that it isn't above the ceiling of the language:
    exp(q + margin (q - m)), with q and m the `high` quantile and the median of log perplexity over the trusted texts that didn't train the model. Before it is compared, a
    score is averaged with PRIOR_WORDS words at the median. A language without such texts gets the quantiles of all.

    A text that is null or has no word isn't kept (perplexity null). Null languages are one language; rows of the same doc_id are scored each; without any
    trusted text all others are kept. An empty table gives an empty result; other columns aren't read.
    """
    s = written(score(docs, labels), "scores")
    s = s.withColumn("_x", -F.col("log_prob") / (F.col("words") + 1))
    held = small(trusted(labels).where(~_train_part()))
    x = s.where("_x is not null").join(held, s["doc_id"] == held["_good"], "left_semi").select("lang", F.round("_x", 3).alias("x"))
    q = x.groupBy("lang").agg(F.expr(f"percentile(x, array(0.5, {high}))").alias("q"))
    every = x.agg(F.expr(f"percentile(x, array(0.5, {high}))").alias("e"))
    q = small(q.withColumnRenamed("lang", "_l"))
    j = s.join(q, s["lang"].eqNullSafe(q["_l"]), "left").crossJoin(F.broadcast(every)).withColumn("q", F.coalesce("q", "e"))
    mid, top = F.col("q")[0], F.col("q")[1]
    ceiling = top + margin * (top - mid)
    drawn = (F.col("_x") * (F.col("words") + 1) + PRIOR_WORDS * mid) / (F.col("words") + 1 + PRIOR_WORDS)
    keep = F.when(F.coalesce("words", F.lit(-1)) == 0, False).when(F.col("_x").isNull() | ceiling.isNull(), F.col("words").isNull() | (F.col("words") > 0)).otherwise(drawn <= ceiling)
    return j.select("doc_id", "lang", "words", F.exp("_x").alias("perplexity"), F.exp(ceiling).alias("ceiling"), keep.alias("keep"))


def keep_good(docs: DataFrame, labels: DataFrame, **how) -> DataFrame:
    """The documents without those that `classify` doesn't keep; columns and repeated rows stay. Rows of one doc_id go together, if any of them is kept; null
    doc_ids stay."""
    keep: list[DataFrame] = []
    with scratch(keep):
        bad = written(classify(docs, labels, **how).groupBy("doc_id").agg(F.max("keep").alias("k")).where("not k and doc_id is not null").select(F.col("doc_id").alias("_bad")), "rejected")
        keep.append(bad)
    return docs.join(small(bad), docs["doc_id"] == bad["_bad"], "left_anti").select(*[docs[c] for c in docs.columns])
