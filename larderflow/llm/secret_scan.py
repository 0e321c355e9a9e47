"""Secret scans: character Markov models of random strings and of ordinary identifiers."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, utf8, word_spans

#: Shortest run of identifier characters that is scored.
MIN_CHARS = 12
#: Share of random strings among all that are scored; a string is a secret where the likelihood ratio outweighs these odds.
PRIOR = 1e-5
#: Trusted labelled texts from which ordinary words are learnt, at most (the ones of lowest md5 of doc_id): a bounded sample of labelled rows.
TRAIN_TEXTS = 2000
#: Labelled strings of each kind that the generator adds.
GENERATED = 20_000
SEED = 11

_ALPHABET = b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_-"
_CLASS = np.full(256, 66, dtype=np.int64)
_CLASS[list(_ALPHABET)] = np.arange(66)
_RUN = np.zeros(256, dtype=bool)
_RUN[list(_ALPHABET)] = True
_N = 67  # 66 stands for the edge


def generated(n: int = GENERATED, seed: int = SEED, words: list[str] = ()) -> tuple[list[str], list[str]]:
    """Labelled samples: random keys of the usual alphabets, and identifiers as people write them, made of the given words."""
    rng = np.random.default_rng(seed)
    b32, hexa = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "0123456789abcdef"
    b62 = _ALPHABET[:62].decode()
    kinds = [hexa, hexa, hexa.upper(), b32, "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", b62, b62 + "+/", b62 + "_-"]
    rand = []
    for _ in range(n):
        a = kinds[rng.integers(len(kinds))]
        rand.append("".join(a[i] for i in rng.integers(len(a), size=rng.integers(12, 65))))
    words = [w for w in words if w.isascii() and w.isalpha()] or ["value", "index", "table", "record", "count", "name", "order", "customer", "document", "source", "handler", "manager"]
    ordinary = []
    for _ in range(n):
        w = [words[i] for i in rng.integers(len(words), size=rng.integers(2, 5))]
        k = rng.integers(9)
        s = ["_".join(w).lower(), "-".join(w).lower(), "".join(x.capitalize() for x in w), w[0].lower() + "".join(x.capitalize() for x in w[1:]), "_".join(w).upper(), "/".join(w), "".join(w[:2]).upper(), "", ""][k]
        if k == 7:
            s = f"{rng.integers(1990, 2030)}-{rng.integers(1, 13):02}-{rng.integers(1, 29):02}" + ["", f"-{rng.integers(10**6)}"][rng.integers(2)]
        elif k == 8:
            s = "".join(map(str, rng.integers(10, size=rng.integers(12, 20))))
        elif rng.random() < 0.2:
            s += str(rng.integers(1000))
        ordinary.append(s)
    return rand, ordinary


def _contexts(b: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Of strings one after the other, of lengths n: the number of each character with the two before it."""
    k = np.arange(len(b)) - np.repeat(np.cumsum(n) - n, n)
    c = _CLASS[b]
    p1 = np.where(k > 0, np.concatenate([[66], c[:-1]]), 66)
    p2 = np.where(k > 1, np.concatenate([[66, 66], c[:-2]])[: len(c)], 66)
    return (p2 * _N + p1) * _N + c


class Model:
    """Log-likelihood ratio of order-2 character chains, added-k smoothed."""

    def __init__(self, rand: list[str], ordinary: list[str], smooth: float = 0.05):
        tables = []
        for sample in (rand, ordinary):
            n = np.array([len(s.encode()) for s in sample], dtype=np.int64)
            at = _contexts(np.frombuffer("".join(sample).encode(), dtype=np.uint8), n)
            c = np.bincount(at, minlength=_N**3).reshape(_N, _N, _N).astype(np.float64)
            # a context seen seldom leans on the shorter one
            pair = c.sum(0) + smooth
            pair /= pair.sum(1, keepdims=True)
            tables.append(np.log((c + 2 * pair[None]) / (c.sum(2, keepdims=True) + 2)))
        self.table = (tables[0] - tables[1]).astype(np.float32).reshape(-1)

    def scores(self, b: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Ratio of each span of bytes."""
        n = end - start
        if not len(n):
            return np.zeros(0)
        first = np.cumsum(n) - n
        at = np.repeat(start - first, n) + np.arange(int(n.sum()))
        return np.add.reduceat(self.table[_contexts(b[at], n)], first)

    def score(self, s: str) -> float:
        b = np.frombuffer(s.encode(), dtype=np.uint8)
        return float(self.scores(b, np.array([0]), np.array([len(b)]))[0]) if len(b) else 0.0


def train(docs: DataFrame, labels: DataFrame | None, texts: int = TRAIN_TEXTS, seed: int = SEED) -> Model:
    """Models from labelled samples: generated random strings against generated identifiers, made of the words of trusted texts (quality 1 in `labels`, `texts` of them at most), and
    those words of 8 letters or more themselves."""
    every: list[str] = []
    if labels is not None:
        good = labels.where("quality = 1 and doc_id is not null").select("doc_id").distinct().orderBy(F.md5(F.col("doc_id").cast("string"))).limit(texts)
        d = docs.select("doc_id", "text").where("text is not null").join(F.broadcast(good), "doc_id", "left_semi")
        words = d.select(F.explode(F.array_distinct(F.expr("regexp_extract_all(text, '[A-Za-z]{3,}', 0)"))).alias("w")).distinct()
        every = sorted((w for (w,) in words.collect()), key=lambda w: hashlib.md5(w.encode()).digest())
    rand, ordinary = generated(seed=seed, words=[w for w in every if len(w) < 12])
    longer = [w for w in every if len(w) >= 8]
    return Model(rand, ordinary + longer + [w.upper() for w in longer])


def find(model: Model, column, min_chars: int = MIN_CHARS, prior: float = PRIOR):
    """For each slice of the texts: bytes, and value index, start, end and ratio of each secret (within the slice's bytes)."""
    limit = float(np.log((1 - prior) / prior))
    b, offsets = utf8(column)
    for i, j in slices(offsets, 1_000_000):
        x = b[offsets[i] : offsets[j]]
        o = offsets[i : j + 1] - offsets[i]
        if not len(x):
            continue
        start, end, doc = word_spans(x, o, _RUN)
        k = end - start >= min_chars
        start, end, doc = start[k], end[k], doc[k]
        s = model.scores(x, start, end)
        k = s > limit
        yield i, x, o, doc[k], start[k], end[k], s[k]


SCHEMA = "doc_id bigint, start bigint, n_chars bigint, llr double"


def secrets(docs: DataFrame, model: Model, min_chars: int = MIN_CHARS, prior: float = PRIOR) -> DataFrame:
    """Rows (doc_id, start, n_chars, llr), one for each string of a text that is rather random than an identifier; `start` counts characters from 0.

    Strings are runs of ASCII letters, digits and + / _ - of at least `min_chars`; whole texts are read. A null or empty text has no secrets; a
    text that occurs twice gives its rows twice; an empty table gives an empty result; columns other than doc_id and text aren't read.
    """

    def run(batches):
        for batch in batches:
            ids = batch.column(0)
            rows: list[tuple] = []
            for i, x, o, doc, start, end, s in find(model, batch.column(1), min_chars, prior):
                for d, p, q, v in zip(doc.tolist(), start.tolist(), end.tolist(), s.tolist()):
                    rows.append((ids[i + d].as_py(), len(x[o[d] : p].tobytes().decode()), q - p, v))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows)) or [()] * 4, (pa.int64(), pa.int64(), pa.int64(), pa.float64()))], names=["doc_id", "start", "n_chars", "llr"])

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)


def redact(docs: DataFrame, model: Model, mask: str = "<secret>", min_chars: int = MIN_CHARS, prior: float = PRIOR) -> DataFrame:
    """The documents with each secret of `text` replaced by `mask` and n_chars (if there) counted anew; no row is dropped, other columns stay."""
    cols = docs.columns
    schema = docs.schema

    def run(batches):
        for batch in batches:
            t = batch.column(cols.index("text"))
            new: dict[int, str] = {}
            for i, x, o, doc, start, end, _ in find(model, t, min_chars, prior):
                for d in np.unique(doc).tolist():
                    out, at = [], int(o[d])
                    for k in np.flatnonzero(doc == d).tolist():
                        out += [x[at : start[k]].tobytes(), mask.encode()]
                        at = int(end[k])
                    new[i + d] = b"".join([*out, x[at : o[d + 1]].tobytes()]).decode()
            if new:
                vals = {"text": t.to_pylist()}
                for k, s in new.items():
                    vals["text"][k] = s
                if "n_chars" in cols:
                    vals["n_chars"] = batch.column(cols.index("n_chars")).to_pylist()
                    for k, s in new.items():
                        vals["n_chars"][k] = len(s)
                arrays = [pa.array(vals[c], batch.schema.field(c).type) if c in vals else batch.column(n) for n, c in enumerate(cols)]
                batch = pa.RecordBatch.from_arrays(arrays, schema=batch.schema)
            yield batch

    return docs.mapInArrow(run, schema)
