"""Mixing sources to target weights by Pfair scheduling."""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import seeded, small, with_rank

SEED = 7
#: Documents of a block, the unit that is scheduled.
BLOCK = 4
#: Default target weight of a source: its document count to this power (1: as it is, 0: all alike).
TEMPERATURE = 0.5
#: Slots of a scheduling period: target weights are rounded to whole shares of it, one at least.
PERIOD = 1000


def shares(weights: dict, period: int = PERIOD) -> dict:
    """Whole numbers in the proportion of the weights that sum to `period` (more where there are more sources): largest remainders."""
    period = max(period, len(weights))
    total = sum(weights.values())
    free = period - len(weights)
    exact = {s: w / total * period for s, w in weights.items()}
    out = {s: max(1, int(x)) for s, x in exact.items()}
    order = sorted(exact, key=lambda s: (out[s] - exact[s], str(s)))
    k = 0
    while sum(out.values()) < period:
        out[order[k % len(order)]] += 1
        k += 1
    while sum(out.values()) > period and free >= 0:
        out[max(out, key=lambda s: (out[s] - exact[s] if out[s] > 1 else -1e18, str(s)))] -= 1
    return out


def one_period(share: dict) -> dict:
    """Slots of each source's blocks in a period. Block k of a source of share w out of W is released at floor(k W / w) and due at
    ceil((k + 1) W / w); of the released blocks the one due first runs. As the shares fill the period, all are in time, so after any
    number of slots each source has had its share within less than one block."""
    period = sum(share.values())
    names = sorted(share, key=str)
    waiting = [(0, i, 0) for i in range(len(names))]  # (release, source, block)
    ready: list = []
    out: dict = {s: [] for s in names}
    for slot in range(period):
        while waiting and waiting[0][0] <= slot:
            _, i, k = heapq.heappop(waiting)
            w = share[names[i]]
            heapq.heappush(ready, (-(-(k + 1) * period // w), i, k))
        due, i, k = heapq.heappop(ready)
        if slot >= due:
            raise AssertionError("a block is late")
        w = share[names[i]]
        out[names[i]].append(slot)
        if k + 1 < w:
            heapq.heappush(waiting, ((k + 1) * period // w, i, k + 1))
    return out


def schedule(blocks: dict, weights: dict, period: int = PERIOD) -> list[tuple]:
    """Rows (source, phase, first block, end block, first slot, period, share, index in period, slot in period).

    A phase lasts until a source runs out; the others then go on with their weights in proportion, so every block gets a slot.
    """
    left = {s: n for s, n in blocks.items() if n > 0}
    done = dict.fromkeys(left, 0)
    rows, start, phase = [], 0, 0
    while left:
        share = shares({s: weights[s] for s in left}, period)
        whole = sum(share.values())
        at = one_period(share)
        length = min((n - 1) // share[s] * whole + at[s][(n - 1) % share[s]] + 1 for s, n in left.items())
        for s in list(left):
            full, rest = divmod(length, whole)
            used = full * share[s] + sum(x < rest for x in at[s])
            rows += [(s, phase, done[s], done[s] + used, start, whole, share[s], j, x) for j, x in enumerate(at[s])]
            done[s] += used
            left[s] -= used
            if not left[s]:
                del left[s]
        start += length
        phase += 1
    return rows


def mix(docs: DataFrame, weights: dict | None = None, block: int = BLOCK, temperature: float = TEMPERATURE, period: int = PERIOD, seed: int = SEED, together: list[str] | None = None, order: list[str] | None = None) -> DataFrame:
    """Rows (doc_id, source, phase, slot, pos): `slot` is the place of the document's block in the mixture, `pos` its own place in the block.

    Documents of a source are shuffled by a seeded hash of doc_id and cut into blocks; the schedule depends only on the counts of the
    sources, so the driver makes one period of it for each phase (see `schedule`) and the rest is arithmetic on the block's number. `weights` names
    target weights by source (a source without one gets 1, a weight must be positive); without it they follow the counts to the power `temperature`.

    No document is dropped: when a source runs out (a new phase), the others share its place. The last block of a source may
    be shorter. With `together`, what is shuffled are the groups of rows alike in these columns, whose rows follow each other by `order`, and all columns of `docs` stay. Null sources are one source; repeated rows keep their count; an empty table gives an empty result. Other columns aren't read.
    """
    spark = docs.sparkSession
    d = docs.select("doc_id", "source") if together is None else docs
    counts = {r["source"]: r["count"] for r in d.groupBy("source").count().collect()}
    if weights is None:
        target = {s: n**temperature for s, n in counts.items()}
    else:
        target = {s: float(weights.get(s, 1)) for s in counts}
    if any(w <= 0 for w in target.values()):
        raise ValueError("target weights must be positive")
    rows = schedule({s: -(-n // block) for s, n in counts.items()}, target, period)
    plan = spark.createDataFrame(rows, "_s string, phase int, _k0 bigint, _k1 bigint, _t0 bigint, _whole bigint, _share bigint, _j bigint, _x bigint")
    r = with_rank(d.withColumn("_h", seeded(seed, *(together or ["doc_id"]))), "source", "_h", [*(order or []), "doc_id"]).withColumn("_k", F.expr(f"_rank div {block}"))
    spans = plan.where("_j = 0").select("_s", "phase", "_k0", "_k1", "_t0", "_whole", "_share")
    r = r.join(small(spans, len(rows)), r["source"].eqNullSafe(F.col("_s")) & (F.col("_k") >= F.col("_k0")) & (F.col("_k") < F.col("_k1"))).drop("_s")
    r = r.withColumn("_m", F.expr("(_k - _k0) % _share"))
    cells = plan.select("_s", F.col("phase").alias("_p"), "_j", "_x")
    r = r.join(small(cells, len(rows)), r["source"].eqNullSafe(F.col("_s")) & (F.col("phase") == F.col("_p")) & (F.col("_m") == F.col("_j")))
    slot = F.expr("_t0 + (_k - _k0) div _share * _whole + _x")
    return r.select(*d.columns, "phase", slot.alias("slot"), F.expr(f"_rank % {block}").cast("bigint").alias("pos"))
