"""Order-dependent plan shapes that stay parallel under hot keys.

A plain ``Window.partitionBy(key).orderBy(seq)`` puts every row of a key in
one task; if one key holds a third of the data that task holds a third of
the data. The helpers here split each key into *seq buckets* — fixed ranges
of ``2**bits`` consecutive ``seq`` values, so a bucket holds at most
``2**bits`` rows whatever the skew — work inside buckets in parallel, and
stitch buckets together through small per-bucket summaries.
"""

from __future__ import annotations

from functools import reduce
from typing import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DEFAULT_BITS = 16
LEVELS = 3            # of seq buckets at most: 16, 32 and 48 bits wide, so any seq fits however sparse
_BIG = 1 << 60


def _bucket(seq: str, bits: int) -> Column:
    return F.shiftright(F.col(seq), bits)


def levels_for(df: DataFrame, seq: str, bits: int = DEFAULT_BITS) -> int:
    """How many levels of buckets ``df`` needs, by one aggregate of its smallest and
    largest ``seq``: as many as leave at most ``2**bits`` buckets of the widest
    level, whatever the keys. A dense ``seq`` below 2**32 needs one."""
    lo, hi = df.agg(F.min(seq), F.max(seq)).first()
    n = 1
    while lo is not None and n < LEVELS and (hi >> bits * n) - (lo >> bits * n) >= 1 << bits:
        n += 1
    return n


def _join_back(left: DataFrame, right: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Inner join on null-safe equality of ``cols``; the right side's key
    columns are renamed first so self-joined lineages stay unambiguous."""
    r = right
    for c in cols:
        r = r.withColumnRenamed(c, f"__r_{c}")
    on = reduce(lambda a, b: a & b,
                [F.col(c).eqNullSafe(F.col(f"__r_{c}")) for c in cols])
    return left.join(r, on=on, how="inner").drop(*[f"__r_{c}" for c in cols])


def rank_within(df: DataFrame, keys: Sequence[str], seq: str,
                order: Sequence[tuple[str, bool]] = (), name: str = "rank",
                bits: int = DEFAULT_BITS, materialize: bool = False, levels: int | None = None) -> DataFrame:
    """1-based ``row_number`` within ``keys`` ordered by ``order`` then ``seq``.

    ``order`` is a list of ``(column, ascending)`` applied before ``seq``.
    Equal to ``row_number().over(partitionBy(keys).orderBy(order..., seq))``
    when ``seq`` is unique within a key, but no task ever sorts more than one
    (key, order values, seq bucket) group: the local row number inside the
    group is offset by the running count of all earlier groups, computed on
    the per-group count table (one row per group, ~rows / 2**bits).

    The input is read twice (rows and counts). ``materialize=True`` writes it
    once with a reliable ``checkpoint()`` into the shared checkpoint folder,
    for inputs that are expensive to recompute (joins); plain scans are
    cheaper to read twice. ``levels`` of buckets: see :func:`levels_for`, which
    is asked if none is given.
    """
    keys, order = list(keys), list(order)
    if materialize:
        from weft.session import ensure_checkpoint_dir
        ensure_checkpoint_dir(df.sparkSession)
        df = df.checkpoint(eager=True)
    ocols = [c for c, _ in order]
    levels = levels or levels_for(df, seq, bits)
    b = [f"__b{i}" for i in range(levels)]      # seq >> bits, >> 2 bits, ...
    x = df.withColumn(b[0], _bucket(seq, bits))
    x = x.withColumn("__local", F.row_number().over(
        Window.partitionBy(*keys, *ocols, b[0]).orderBy(F.col(seq))))
    # counts by bucket, then by ever wider buckets; each offset window spans
    # the 2**bits buckets of the next wider one, the last the whole key
    counts = [x.groupBy(*keys, *ocols, b[0]).agg(F.count(F.lit(1)).alias("__n"))]
    for k in range(1, levels):
        counts[-1] = counts[-1].withColumn(b[k], F.shiftright(b[k - 1], bits))
        counts.append(counts[-1].groupBy(*keys, *ocols, b[k]).agg(F.sum("__n").alias("__n")))
    sort = [F.col(c).asc() if asc else F.col(c).desc() for c, asc in order] + [F.col(b[-1])]
    top = (Window.partitionBy(*keys) if keys else Window.partitionBy()).orderBy(*sort)
    offsets = counts[-1].withColumn("__off", _before("__n", top)).drop("__n")
    for k in range(levels - 2, -1, -1):
        w = Window.partitionBy(*keys, *ocols, b[k + 1]).orderBy(b[k])
        inner = counts[k].withColumn("__in", _before("__n", w)).drop("__n")
        offsets = _join_back(inner, offsets, keys + ocols + [b[k + 1]])
        offsets = offsets.withColumn("__off", F.col("__off") + F.col("__in")).drop("__in", b[k + 1])
    joined = _join_back(x, offsets, keys + ocols + [b[0]])
    return (joined.withColumn(name, F.col("__off") + F.col("__local"))
            .drop(b[0], "__local", "__off"))


def _before(n: str, w) -> Column:
    """Sum of ``n`` over the rows before this one in a window."""
    return F.coalesce(F.sum(n).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))


def previous_within(df: DataFrame, keys: Sequence[str], seq: str,
                    cols: Sequence[str], prefix: str = "prev_",
                    bits: int = DEFAULT_BITS, levels: int | None = None) -> DataFrame:
    """Add ``prev_<col>`` = value of ``col`` on the previous row of the same
    key by ``seq`` (null on a key's first row), i.e. ``lag(col)`` over
    ``partitionBy(keys).orderBy(seq)`` without gathering a key in one task.

    Inside a seq bucket ``lag`` is local; the first row of a bucket takes the
    last row of the buckets before it, found level by level: in the bucket
    before it within the next wider bucket, else in the wider bucket before
    that one, and so on. No window spans more than ``2**bits`` buckets.
    """
    keys, cols = list(keys), list(cols)
    levels = levels or levels_for(df, seq, bits)
    b = [f"__b{i}" for i in range(levels)]
    carried = list(dict.fromkeys([*cols, seq]))
    x = df.withColumn(b[0], _bucket(seq, bits))
    wl = Window.partitionBy(*keys, b[0]).orderBy(F.col(seq))
    x = x.withColumn("__rn", F.row_number().over(wl))
    for c in carried:
        x = x.withColumn(f"__lag_{c}", F.lag(c).over(wl))
    # one max_by per column: fixed-width columns keep this a hash aggregate
    last = x.groupBy(*keys, b[0]).agg(
        *[F.max_by(F.col(c), F.col(seq)).alias(f"__last_{c}") for c in carried])
    lasts = [last]
    for k in range(1, levels):
        lasts[-1] = lasts[-1].withColumn(b[k], F.shiftright(b[k - 1], bits))
        lasts.append(lasts[-1].groupBy(*keys, b[k]).agg(
            *[F.max_by(F.col(f"__last_{c}"), F.col(b[k - 1])).alias(f"__last_{c}") for c in carried]))
    before = F.struct(*[F.col(f"__last_{c}") for c in carried])  # never null itself
    carry = lasts[-1].select(*keys, b[-1], F.lag(before).over(Window.partitionBy(*keys).orderBy(b[-1])).alias("__c"))
    for k in range(levels - 2, -1, -1):
        w = Window.partitionBy(*keys, b[k + 1]).orderBy(b[k])
        inner = lasts[k].select(*keys, b[k], b[k + 1], F.lag(before).over(w).alias("__in"))
        carry = _join_back(inner, carry, keys + [b[k + 1]])
        carry = carry.select(*keys, b[k], F.coalesce("__in", "__c").alias("__c"))
    j = _join_back(x, carry, keys + [b[0]])
    first = F.col("__rn") == 1
    return j.select(*df.columns,
                    *[F.when(first, F.col(f"__c.__last_{c}")).otherwise(F.col(f"__lag_{c}"))
                      .alias(prefix + c) for c in carried])


def _compose(acc: Column, x: Column) -> Column:
    """(D1,L1,H1) then (D2,L2,H2) for maps y -> clamp_[L,H](y + D)."""
    d2, l2, h2 = x["D"], x["L"], x["H"]
    return F.struct(
        (acc["D"] + d2).alias("D"),
        F.least(h2, F.greatest(l2, acc["L"] + d2)).alias("L"),
        F.least(h2, F.greatest(l2, acc["H"] + d2)).alias("H"),
    )


def _identity() -> Column:
    return F.struct(F.lit(0).cast("bigint").alias("D"),
                    F.lit(-_BIG).cast("bigint").alias("L"),
                    F.lit(_BIG).cast("bigint").alias("H"))


def _fold_sorted(items: Column) -> Column:
    return F.aggregate(F.array_sort(items), _identity(), _compose)


def clamp_fold(steps: DataFrame, keys: Sequence[str], seq: str, delta: str,
               lo: str, hi: str, levels: Sequence[int] = (16, 32, 48)) -> DataFrame:
    """Per key, the composition (in ``seq`` order) of the steps
    ``y -> min(hi, max(lo, y + delta))``, returned as columns ``D, L, H``;
    apply it to a start value with :func:`apply_clamp`.

    Clamp maps are closed under composition —
    ``clamp[L2,H2](clamp[L1,H1](y + D1) + D2) = clamp[L,H](y + D1 + D2)`` with
    ``L = clamp[L2,H2](L1 + D2)``, ``H = clamp[L2,H2](H1 + D2)`` — so the fold
    is a tree reduction: steps are composed inside ``seq >> levels[0]``
    buckets, those summaries inside ``seq >> levels[1]`` buckets, and so on,
    and the rest per key. Every group holds at most ``2**16`` entries, for any
    64-bit ``seq``; no key is ever gathered whole.
    """
    keys = list(keys)
    cur = steps.select(*keys, F.col(seq).alias("__pos"),
                       F.col(delta).cast("bigint").alias("D"),
                       F.col(lo).cast("bigint").alias("L"),
                       F.col(hi).cast("bigint").alias("H"))
    for shift in list(levels) + [None]:
        gk = keys + ([F.shiftright("__pos", shift).alias("__b")] if shift is not None else [])
        agg = cur.groupBy(*gk).agg(
            F.min("__pos").alias("__first"),
            _fold_sorted(F.collect_list(F.struct("__pos", "D", "L", "H"))).alias("__s"))
        cur = agg.select(*keys, F.col("__first").alias("__pos"),
                         F.col("__s.D").alias("D"), F.col("__s.L").alias("L"),
                         F.col("__s.H").alias("H"))
    return cur.drop("__pos")


def apply_clamp(start: Column, d: Column, lo: Column, hi: Column) -> Column:
    """Value of the composed clamp map (D, L, H) at ``start``; identity if no steps."""
    return F.when(d.isNull(), start).otherwise(F.least(hi, F.greatest(lo, start + d)))


def compose_clamps_np(d, lo, hi):
    """The composition (in order) of ``y -> min(hi, max(lo, y + d))`` over
    numpy arrays, as ``(D, L, H)``: a pairwise tree of vectorised
    compositions (O(n) work, O(log n) numpy steps). Identity when empty."""
    import numpy as np
    big = np.int64(_BIG)
    D = np.asarray(d, dtype=np.int64)
    L = np.asarray(lo, dtype=np.int64)
    H = np.asarray(hi, dtype=np.int64)
    if len(D) == 0:
        return 0, -int(big), int(big)
    while len(D) > 1:
        if len(D) % 2:
            D = np.append(D, 0)
            L = np.append(L, -big)
            H = np.append(H, big)
        d0, d1, l0, l1, h0, h1 = D[0::2], D[1::2], L[0::2], L[1::2], H[0::2], H[1::2]
        D = d0 + d1
        L = np.minimum(h1, np.maximum(l1, l0 + d1))
        H = np.minimum(h1, np.maximum(l1, h0 + d1))
    return int(D[0]), int(L[0]), int(H[0])
