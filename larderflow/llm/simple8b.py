"""Token ids as Simple-8b words: tokenizing, encoding, decoding."""

from __future__ import annotations

import base64
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import slices, span_hashes, utf8

#: A public byte-level vocabulary as ranks, one "base64 rank" a line.
VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Ids of a block; the offset of its first word is kept.
BLOCK = 128
#: (ids of a word, bits of an id) by selector from 1; selector 0 is the escape: the next word is one id of up to 64 bits.
SELECTORS = [(240, 0), (60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20), (2, 30), (1, 60)]
_COUNT = np.array([1] + [n for n, _ in SELECTORS], dtype=np.int64)
_BITS = np.array([64] + [b for _, b in SELECTORS], dtype=np.int64)


def block_starts(lengths: np.ndarray, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray]:
    """First id and document of each block; blocks start anew with each document."""
    per = -(-lengths // block)
    doc = np.repeat(np.arange(len(lengths)), per)
    first = np.cumsum(per) - per
    inside = np.arange(len(doc)) - first[doc]
    return (np.cumsum(lengths) - lengths)[doc] + inside * block, doc


def encode(ids: np.ndarray, lengths: np.ndarray, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """As `_encode`, a few documents at a time, so that the arrays stay in the CPU's cache."""
    ends = np.concatenate([[0], np.cumsum(lengths)])
    parts = [_encode(ids[ends[i] : ends[j]], lengths[i:j], block) for i, j in slices(ends, 60_000)]
    if not parts:
        return _encode(ids, lengths, block)
    return tuple(np.concatenate(x) for x in zip(*parts))


def _encode(ids: np.ndarray, lengths: np.ndarray, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of all documents, words of each document, offsets of all blocks (in words, from the document's first) and blocks of each document.

    Each word takes as many ids as fit in it; the last word of a block is filled with zeros. All blocks are encoded in step.
    """
    ids = ids.astype(np.uint64)
    n = len(ids)
    start, doc = block_starts(lengths, block)
    end = np.minimum(start + block, np.cumsum(lengths)[doc])
    last = np.repeat(end, end - start).astype(np.int32)  # of each id's block
    take = np.ones(n, dtype=np.int32)
    sel = np.zeros(n, dtype=np.int8)
    at = np.arange(n, dtype=np.int32)
    most = int(ids.max()) if n else 0
    for s in range(15, 0, -1):  # the widest first; more ids a word overwrite it
        count, bits = SELECTORS[s - 1]
        bad = ids >= np.uint64(1 << bits)
        if s == 15:
            sel[~bad] = 15
            continue
        if most < 1 << bits:
            nxt = np.int32(n)
        elif bad.all():
            continue
        else:
            nxt = np.minimum.accumulate(np.where(bad, at, np.int32(n))[::-1])[::-1]
        full = np.minimum(at + np.int32(count), last)
        # a word that isn't filled is worth it only where it ends the block
        better = (nxt >= full) & (full - at > take)
        take = np.where(better, full - at, take)
        sel[better] = s
    cur, live = start.copy(), np.flatnonzero(start < end)
    words_at, words_block, step = [], [], 0
    steps = []
    while len(live):
        c = cur[live]
        words_at.append(c)
        words_block.append(live)
        steps.append(np.full(len(live), step))
        cur[live] = c + take[c]
        live = live[cur[live] < end[live]]
        step += 1
    if not words_at:
        return np.zeros(0, np.uint64), np.zeros(len(lengths), np.int64), np.zeros(0, np.uint32), np.zeros(len(lengths), np.int64)
    wa, wb, ws = np.concatenate(words_at), np.concatenate(words_block), np.concatenate(steps)
    order = np.argsort(wa, kind="stable")
    wa, wb = wa[order], wb[order]
    s = sel[wa]
    size = 1 + (s == 0)
    place = np.cumsum(size) - size
    words = np.zeros(int(size.sum()), dtype=np.uint64)
    esc = s == 0
    words[place[esc] + 1] = ids[wa[esc]]
    for k in range(1, 16):
        m = np.flatnonzero(s == k)
        if not len(m):
            continue
        bits, got = SELECTORS[k - 1][1], take[wa[m]]
        v = np.full(len(m), np.uint64(k) << np.uint64(60), dtype=np.uint64)
        if bits:
            for j in range(int(got.max())):
                has = got > j
                v[has] |= ids[wa[m[has]] + j] << np.uint64(j * bits)
        words[place[m]] = v
    first_word = np.searchsorted(wa, start)
    block_off = np.append(place, len(words))[first_word]
    blocks = np.bincount(doc, minlength=len(lengths))
    doc_words = np.bincount(doc[wb], weights=size, minlength=len(lengths)).astype(np.int64)
    doc_first = np.cumsum(doc_words) - doc_words
    return words, doc_words, (block_off - doc_first[doc]).astype(np.uint32), blocks


def decode(words: np.ndarray, offsets: np.ndarray, n: int, block: int = BLOCK, only: int | None = None) -> np.ndarray:
    """The ids of a document, or of its block `only`; all words of a selector are unpacked at once."""
    out_len = n
    if only is not None:
        stop = offsets[only + 1] if only + 1 < len(offsets) else len(words)
        words, out_len = words[offsets[only] : stop], min(block, n - only * block)
        offsets = np.zeros(1, dtype=np.uint32)
    if not out_len:
        return np.zeros(0, dtype=np.uint64)
    # raw words follow escapes; a raw word may look like an escape itself, so parity inside a run of zeros decides
    s = (words >> np.uint64(60)).astype(np.int64)
    zero = s == 0
    raw = np.zeros(len(words), dtype=bool)
    if zero.any():
        k = 0
        z = np.flatnonzero(zero)
        skip = -1
        for k in z:
            if k != skip:
                raw[k + 1 : k + 2] = True
                skip = k + 1
    head = np.flatnonzero(~raw)
    sel = s[head]
    count = _COUNT[sel]
    # ids of a block start at a multiple of its size; the padding of its last word is cut off
    b = np.searchsorted(offsets, head, "right") - 1
    total = np.cumsum(count) - count
    first = np.searchsorted(head, offsets)
    at = b * block + total - total[first][b]
    limit = np.minimum((b + 1) * block, out_len)
    out = np.zeros(out_len, dtype=np.uint64)
    for k in range(16):
        m = np.flatnonzero(sel == k)
        if not len(m):
            continue
        if k == 0:
            out[at[m]] = words[head[m] + 1]
            continue
        c, bits = SELECTORS[k - 1]
        if not bits:
            continue
        for j in range(c):
            has = at[m] + j < limit[m]
            out[at[m[has]] + j] = (words[head[m[has]]] >> np.uint64(j * bits)) & np.uint64((1 << bits) - 1)
    return out


# --- token ids -----------------------------------------------------------------------------------------------------

#: White space beyond ASCII's; texts with it are tokenized as a whole.
_OTHER_SPACE = re.compile("[\\x1c-\\x1f\\x85\\u00a0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]")
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_encoders: dict = {}


def encoder(path: str):
    if path not in _encoders:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _encoders[path] = tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encoders[path]


def token_bytes(path: str) -> np.ndarray:
    """Length in bytes of each token."""
    if (path, "bytes") not in _encoders:
        ranks = encoder(path)._mergeable_ranks
        n = np.zeros(max(ranks.values()) + 1, dtype=np.int64)
        n[list(ranks.values())] = [len(x) for x in ranks]
        _encoders[path, "bytes"] = n
    return _encoders[path, "bytes"]


def token_ids(column: pa.Array, path: str = VOCABULARY) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts one after the other, and how many each has. Texts are cut before white space that follows another sign, where no
    match of the pattern reaches across; each distinct piece is tokenized once."""
    enc = encoder(path)
    b, offsets = utf8(column)
    lengths = np.zeros(len(offsets) - 1, dtype=np.int64)
    parts = []
    for i, j in slices(offsets, 4_000_000):
        x = b[offsets[i] : offsets[j]]
        o = offsets[i : j + 1] - offsets[i]
        if not len(x):
            continue
        sp = _SPACE[x]
        cut = np.zeros(len(x), dtype=bool)
        cut[1:] = sp[1:] & ~sp[:-1]
        odd = [k for k in range(j - i) if _OTHER_SPACE.search(column[i + k].as_py() or "")] if _OTHER_SPACE.search(x.tobytes().decode()) else []
        for k in odd:
            cut[o[k] : o[k + 1]] = False
        cut[o[:-1][o[:-1] < len(x)]] = True
        start = np.flatnonzero(cut)
        end = np.append(start[1:], len(x))
        h = span_hashes(x, start, end)
        _, first, which = np.unique(h, return_index=True, return_inverse=True)
        raw = x.tobytes()
        s, e = start[first], end[first]
        # pieces that begin with white space may stand one after the other in one text; the bytes of its tokens tell them apart
        spaced = _SPACE[x[s]]
        own = [enc.encode_ordinary(raw[p:q].decode()) for p, q in zip(s[~spaced].tolist(), e[~spaced].tolist())]
        k = np.flatnonzero(spaced)
        one = enc.encode_to_numpy("".join([raw[p:q].decode() for p, q in zip(s[k].tolist(), e[k].tolist())]), disallowed_special=())
        ends = np.searchsorted(np.cumsum(token_bytes(path)[one]), np.cumsum(e[k] - s[k])) + 1
        n = np.zeros(len(first), dtype=np.int64)
        n[k] = np.diff(ends, prepend=0)
        n[~spaced] = [len(z) for z in own]
        flat = np.concatenate([one.astype(np.uint32), np.array([y for z in own for y in z], dtype=np.uint32)])
        order = np.concatenate([k, np.flatnonzero(~spaced)])
        base = np.empty(len(first), dtype=np.int64)
        base[order] = np.cumsum(n[order]) - n[order]
        m = n[which]
        pos = np.cumsum(m) - m
        parts.append(flat[np.repeat(base[which] - pos, m) + np.arange(int(m.sum()))])
        piece_doc = np.searchsorted(o, start, "right") - 1
        lengths[i:j] += np.bincount(piece_doc, weights=m, minlength=j - i).astype(np.int64)
    return (np.concatenate(parts) if parts else np.zeros(0, np.uint32)), lengths


SCHEMA = "doc_id bigint, n_tokens bigint, words binary, block_offsets binary"


def _blobs(a: np.ndarray, counts: np.ndarray) -> pa.Array:
    off = np.zeros(len(counts) + 1, dtype=np.int32)
    np.cumsum(counts * a.dtype.itemsize, out=off[1:])
    return pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(off), pa.py_buffer(np.ascontiguousarray(a))])


def simple8b(docs: DataFrame, path: str = VOCABULARY, block: int = BLOCK) -> DataFrame:
    """Rows (doc_id, n_tokens, words, block_offsets): each text's token ids as little-endian 64-bit words, and the offset in words (32 bits)
    of every block of ids, from which the block is decoded by itself (see `decode`).

    A null or empty text has no tokens and empty binaries. Each row is mapped by itself, without a shuffle; repeated rows stay repeated, an empty table
    gives an empty result, columns other than doc_id and text aren't read. Texts of any length are encoded whole.
    """

    def run(batches):
        for batch in batches:
            ids, lengths = token_ids(batch.column(1), path)
            words, doc_words, off, blocks = encode(ids, lengths, block)
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(lengths), _blobs(words, doc_words), _blobs(off, blocks)], names=["doc_id", "n_tokens", "words", "block_offsets"])

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)
