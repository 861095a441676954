"""Interval logic on keyed series: runs, merging, complements, snapping, anchors.

One series may hold a large share of all rows, and most of those may fall on one
instant, so no window here spans a whole series. Rows are cut into (series, chunk)
groups, each group is reduced on its own, and what crosses a chunk border is carried
by a second window that sees one row per chunk. Without a ``width`` a chunk is so many
rows of the series in order of time (``ROWS_PER_CHUNK``), whatever the time they span;
with it a chunk is that length of time, which suits series that are even over time and
saves the ranking. ``chunk_width`` derives a length from the busiest series.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import materialize
from .ranks import ranked, summed_before

# Offsets of the level threshold, and limits in seconds.
FLOOR_OFFSET, SPEECH_OFFSET = 25.0, 30.0
SNAP_LIMIT = 0.9
INSIDE_FRACTION = 0.5

# Rows of one series that a task should see at once.
ROWS_PER_CHUNK = 1_000_000

# Rank error of the quantile sketch is n / ACCURACY; the bracket is far wider than that.
ACCURACY, BRACKET = 10000, 0.001


def chunk_of(t: Column | str, width: float) -> Column:
    return F.floor((F.col(t) if isinstance(t, str) else t) / F.lit(float(width))).cast("bigint")


def chunked(df: DataFrame, key: str, order: Sequence[str], width: float | None) -> DataFrame:
    """``df`` with its chunk numbers, which ascend with ``order`` (the time comes first) in each series."""
    if width is not None:
        return df.withColumn("chunk", chunk_of(order[0], width))
    return ranked(df, [F.col(c).asc() for c in order], [key], "chunk").withColumn("chunk", F.expr(f"chunk div {ROWS_PER_CHUNK}"))


def chunk_width(df: DataFrame, key: str, time: str, default: float, rows: int = ROWS_PER_CHUNK) -> float:
    """Chunk length at which the busiest series has about ``rows`` rows per chunk.

    One pass of partial aggregates; a single number comes back. It assumes that a
    series is roughly even over time: pass a shorter length for one that is not.
    """
    per_series = df.groupBy(key).agg(F.count("*").alias("n"), (F.max(time) - F.min(time)).alias("span"))
    needed = per_series.filter(F.col("n") > rows).agg(F.min(F.col("span") / F.ceil(F.col("n") / rows))).first()[0]
    return default if not needed else min(default, float(needed))


# ------------------------------------------------------------------ level threshold

def order_statistics(df: DataFrame, key: str, value: str, shares: Sequence[float], ranks: Sequence[Column]) -> DataFrame:
    """Exact values at 0-based ``ranks`` (expressions of ``n``) in each sorted series.

    A mergeable sketch brackets each rank near its share of the series; exact
    counts below the bracket give the offset; only values inside it are ordered, by
    ranges, so no task sees a whole series. Equal values are counted together first.
    Should a bracket miss its rank, all values of that series are ordered by ranges,
    so the result never depends on the sketch.
    """
    clean = df.filter(F.col(value).isNotNull())
    edges = [p for s in shares for p in (max(s - BRACKET, 0.0), min(s + BRACKET, 1.0))]
    sketch = clean.groupBy(key).agg(F.percentile_approx(value, edges, ACCURACY).alias("q"), F.count("*").alias("n"))
    counts = clean.groupBy(key, value).agg(F.count("*").alias("c"))
    placed = counts.join(sketch, key)
    v = F.col(value)
    tally = []
    for i in range(len(shares)):
        lo, hi = F.get("q", F.lit(2 * i)), F.get("q", F.lit(2 * i + 1))
        tally += [
            F.sum(F.when(v < lo, F.col("c")).otherwise(0)).alias(f"below{i}"),
            F.sum(F.when(v <= hi, F.col("c")).otherwise(0)).alias(f"upto{i}"),
        ]
    bracket = placed.groupBy(key).agg(F.first("q").alias("q"), F.first("n").alias("n"), *tally)
    wanted = []
    for i, rank in enumerate(ranks):
        ok = (F.col(f"below{i}") <= rank) & (rank < F.col(f"upto{i}"))
        wanted.append(
            F.struct(
                F.lit(i).alias("i"),
                rank.cast("bigint").alias("rank"),
                F.when(ok, F.get("q", F.lit(2 * i)).cast("double")).otherwise(float("-inf")).alias("lo"),
                F.when(ok, F.get("q", F.lit(2 * i + 1)).cast("double")).otherwise(float("inf")).alias("hi"),
                F.when(ok, F.col(f"below{i}")).otherwise(0).alias("below"),
            )
        )
    targets = bracket.select(key, "n", F.explode(F.array(*wanted)).alias("w")).select(key, "n", "w.*")
    inside = counts.join(targets, key).filter(v.between(F.col("lo"), F.col("hi")))
    inside = summed_before(inside.select(key, "n", value, "c", "i", "rank", "below"), "c", [v.asc()], [key, "i"])
    hit = inside.withColumn("before", F.col("below") + F.col("before")).filter(
        (F.col("before") <= F.col("rank")) & (F.col("rank") < F.col("before") + F.col("c"))
    )
    return hit.groupBy(key, "n").agg(
        *[F.max(F.when(F.col("i") == i, v)).alias(f"s{i}") for i in range(len(ranks))]
    )


def adaptive_threshold(
    df: DataFrame, key: str, value: str, above_floor: float = FLOOR_OFFSET, below_peak: float = SPEECH_OFFSET
) -> DataFrame:
    """max(5th percentile + a, 90th percentile - b) of each series, by nearest rank."""
    low = F.floor(F.col("n") / F.lit(20.0))
    high = F.floor(F.col("n") * F.lit(0.9))
    stats = order_statistics(df, key, value, (0.05, 0.9), (low, high))
    return stats.select(
        key, F.col("n").alias("rows"), F.col("s0").alias("floor_level"), F.col("s1").alias("peak_level"),
        F.greatest(F.col("s0") + F.lit(above_floor), F.col("s1") - F.lit(below_peak)).alias("threshold"),
    )


# ------------------------------------------------------------------ runs below a level

def below_runs(
    df: DataFrame, key: str, time: str, below: Column, width: float | None = None, tie: str | None = None,
    min_len: float = 0.0, guard: float = 0.0, min_cut: float | None = None, keep_trailing: bool = True,
    step: float = 0.0,
) -> DataFrame:
    """Maximal runs in which ``below`` holds, from the first such row to the next other row.

    A run that is still open at the end of its series ends at the last time plus
    ``step``. Runs shorter than ``min_len`` go; ``guard`` is taken off both ends,
    but not off the end of a series; what is then not longer than ``min_cut`` goes.
    """
    ties = [tie] if tie else []
    rows = df.select(key, F.col(time).alias("t"), *ties, F.coalesce(below, F.lit(False)).alias("below"))
    rows = chunked(rows, key, ["t", *ties], width)
    w = Window.partitionBy(key, "chunk").orderBy("t", *ties)
    marked = rows.select(
        key, "chunk", "t", "below",
        F.lag("below").over(w).alias("was"),
        F.lead("t").over(w).alias("next_t"),
        F.row_number().over(w).alias("rn"),
    )
    begins = F.col("below") & ~F.coalesce("was", F.lit(False))
    so_far = Window.partitionBy(key, "chunk").orderBy("rn").rowsBetween(Window.unboundedPreceding, 0)
    # rows that are not below share number 0, so every chunk keeps a row and its own time span
    numbered = marked.withColumn(
        "run", F.when(F.col("below"), F.sum(begins.cast("int")).over(so_far)).otherwise(0)
    )
    local = numbered.groupBy(key, "chunk", "run").agg(
        F.min("t").alias("start"),
        F.max("t").alias("last"),
        F.max_by("next_t", "rn").alias("end"),
        ((F.min("rn") == 1) & (F.col("run") > 0)).alias("at_head"),
    )
    local = materialize(local.withColumn("at_tail", F.col("end").isNull() & (F.col("run") > 0)), "runs")
    interior = local.filter((F.col("run") > 0) & ~F.col("at_head") & ~F.col("at_tail")).select(
        key, "start", "end", F.lit(False).alias("open_end")
    )
    # one row per chunk: its span, and what its first and last rows say to the neighbours
    chunks = local.groupBy(key, "chunk").agg(
        F.min("start").alias("first_t"),
        F.max("last").alias("last_t"),
        F.max(F.when(F.col("at_head"), F.col("end"))).alias("head_end"),
        F.max(F.when(F.col("at_tail"), F.col("start"))).alias("tail_start"),
        F.bool_or("at_head").alias("head"),
        F.bool_or("at_tail").alias("open"),
        F.bool_or(F.col("at_head") & F.col("at_tail")).alias("whole"),
    )
    forward = Window.partitionBy(key).orderBy("chunk")
    later = Window.partitionBy(key).orderBy(F.desc("chunk")).rowsBetween(Window.unboundedPreceding, -1)
    close = F.when(~F.col("whole"), F.when(F.col("head"), F.col("head_end")).otherwise(F.col("first_t")))
    linked = chunks.withColumn("close", close).select(
        "*",
        F.coalesce(F.lag("open").over(forward), F.lit(False)).alias("joined"),
        F.last("close", ignorenulls=True).over(later).alias("closed_at"),
        F.max("last_t").over(Window.partitionBy(key)).alias("series_end"),
    )
    head = F.when(
        F.col("head") & ~F.col("whole") & ~F.col("joined"),
        F.struct(F.col("first_t").alias("start"), F.col("head_end").alias("end"), F.lit(False).alias("open_end")),
    )
    tail = F.when(
        F.col("open") & ~(F.col("whole") & F.col("joined")),
        F.struct(
            F.col("tail_start").alias("start"),
            F.coalesce("closed_at", F.col("series_end") + F.lit(step)).alias("end"),
            F.col("closed_at").isNull().alias("open_end"),
        ),
    )
    crossing = linked.select(key, F.explode(F.array_compact(F.array(head, tail))).alias("r")).select(key, "r.*")
    runs = interior.unionByName(crossing)
    if not keep_trailing:
        runs = runs.filter(~F.col("open_end"))
    kept = runs.filter(F.col("end") - F.col("start") >= min_len).select(
        key,
        (F.col("start") + F.lit(guard)).alias("start"),
        F.when(F.col("open_end"), F.col("end")).otherwise(F.col("end") - F.lit(guard)).alias("end"),
        "open_end",
    )
    if min_cut is not None:
        kept = kept.filter(F.col("open_end") | (F.col("end") - F.col("start") > min_cut))
    return kept


# ------------------------------------------------------------------ merging and complements

def carry_in(chunk_max: DataFrame, key: str) -> DataFrame:
    """Largest end in all earlier chunks of the series, and in the whole of it."""
    earlier = Window.partitionBy(key).orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    return chunk_max.select(
        key, "chunk", F.max("chunk_end").over(earlier).alias("carry"),
        F.max("chunk_end").over(Window.partitionBy(key)).alias("series_end"),
    )


def merge_intervals(df: DataFrame, key: str, width: float | None = None, start: str = "start", end: str = "end") -> DataFrame:
    """Union of overlapping or touching intervals per series."""
    cut = chunked(df.select(key, F.col(start).alias("start"), F.col(end).alias("end")), key, ["start", "end"], width)
    w = Window.partitionBy(key, "chunk").orderBy("start", "end")
    reach = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    opens = cut.withColumn("opens", (reach.isNull() | (F.col("start") > reach)).cast("int"))
    islands = materialize(
        opens.withColumn("island", F.sum("opens").over(w.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy(key, "chunk", "island")
        .agg(F.min("start").alias("start"), F.max("end").alias("end")),
        "islands",
    )
    ends = islands.groupBy(key, "chunk").agg(F.max("end").alias("chunk_end"))
    in_chunk = Window.partitionBy(key, "chunk")
    absorbed = F.coalesce(F.col("start") <= F.col("carry"), F.lit(False))
    placed = materialize(
        islands.join(carry_in(ends, key), [key, "chunk"]).select(
            key, "chunk", "start", "end", "carry", "series_end",
            absorbed.alias("absorbed"),
            F.max(F.when(absorbed, F.col("end"))).over(in_chunk).alias("absorbed_end"),
            F.lead("start").over(in_chunk.orderBy("start")).isNull().alias("last"),
        ).filter(~F.col("absorbed")),
        "islands",
    )
    # an island whose successor in the chunk is separate is final; the last one stays open
    final = placed.filter(~F.col("last")).select(key, "start", "end")
    # an open island reaches whatever comes before the next chunk that opens one
    reached = F.greatest("carry", "absorbed_end")
    upcoming = F.lead(F.struct(reached.alias("end"))).over(Window.partitionBy(key).orderBy("chunk"))
    tails = placed.filter(F.col("last")).select(
        key, "start", F.greatest("end", F.coalesce(upcoming["end"], F.col("series_end"))).alias("end")
    )
    return final.unionByName(tails)


def keep_ranges(merged: DataFrame, spans: DataFrame, key: str, width: float | None = None) -> DataFrame:
    """What is left of each series' [origin, total] once the merged cuts are taken out.

    ``merged`` holds disjoint cuts, ``spans`` one (key, origin, total) row per
    series. The range after the last cut is always given, as is the whole span of
    a series without cuts.
    """
    cuts = materialize(chunked(merged.select(key, "start", "end"), key, ["start"], width), "cuts")
    carried = carry_in(cuts.groupBy(key, "chunk").agg(F.max("end").alias("chunk_end")), key)
    w = Window.partitionBy(key, "chunk").orderBy("start")
    before = cuts.withColumn("_lag", F.lag("end").over(w)).join(carried, [key, "chunk"]).join(spans, key)
    inner = before.select(
        key,
        F.greatest(F.coalesce("_lag", "carry", "origin"), F.col("origin")).alias("start"),
        F.col("start").alias("end"),
    ).filter(F.col("end") > F.col("start"))
    last = spans.join(cuts.groupBy(key).agg(F.max("end").alias("last_end")), key, "left").select(
        key, F.greatest("origin", "last_end").alias("start"), F.col("total").alias("end")
    )
    return inner.unionByName(last)


# ------------------------------------------------------------------ nearest neighbours in time

def tagged(points: DataFrame, refs: DataFrame, key: str, time: str, at: str, ref: Column) -> DataFrame:
    """Points and references in one frame: ``_t``, ``_chunk``, and one of ``_point`` and ``_ref``."""
    point = F.struct(*[c for c in points.columns if c != "_chunk"])
    left = points.select(key, "_chunk", F.col(time).alias("_t"), point.alias("_point"))
    right = refs.select(key, "_chunk", F.col(at).alias("_t"), ref.alias("_ref"))
    return left.unionByName(right, allowMissingColumns=True)


def nearest_snap(
    points: DataFrame, gaps: DataFrame, key: str, time: str, width: float, limit: float = SNAP_LIMIT
) -> DataFrame:
    """Move each point to the nearest gap midpoint closer than ``limit``; the earlier one on ties.

    Points and midpoints are sorted together in time chunks, so the work is linear
    in both and no pair is built. A midpoint within ``limit`` of a chunk border is
    repeated in the chunk across it, which is all that a point there can need.
    """
    if limit > width:
        raise ValueError("width must be at least the snapping limit")
    mid = (F.col("start") + F.col("end")) / F.lit(2.0)
    near = F.sequence(chunk_of(F.col("mid") - F.lit(limit), width), chunk_of(F.col("mid") + F.lit(limit), width))
    mids = gaps.select(key, mid.alias("mid")).select(key, "mid", F.explode(near).alias("_chunk"))
    both = tagged(points.withColumn("_chunk", chunk_of(time, width)), mids, key, time, "mid", F.col("mid"))
    w = Window.partitionBy(key, "_chunk")
    up_to = Window.unboundedPreceding
    found = both.select(
        "*",
        F.last("_ref", ignorenulls=True).over(w.orderBy("_t", F.col("_ref").isNull()).rowsBetween(up_to, 0)).alias("_before"),
        F.last("_ref", ignorenulls=True).over(w.orderBy(F.desc("_t"), F.col("_ref").isNull()).rowsBetween(up_to, 0)).alias("_after"),
    ).filter(F.col("_point").isNotNull())
    t = F.col("_t")
    d_before = F.when(t - F.col("_before") < limit, t - F.col("_before"))
    d_after = F.when(F.col("_after") - t < limit, F.col("_after") - t)
    pick_after = d_after.isNotNull() & (d_before.isNull() | (d_after < d_before))
    snapped = F.when(pick_after, F.col("_after")).when(d_before.isNotNull(), F.col("_before")).otherwise(t)
    return found.select("_point.*", snapped.alias("snapped"))


def overlap_fraction(
    cuts: DataFrame, drops: DataFrame, key: str, width: float, fraction: float = INSIDE_FRACTION
) -> DataFrame:
    """Does a drop cover more than ``fraction`` of the cut?

    ``drops`` are disjoint (see ``merge_intervals``). A drop that covers more than
    half of a cut contains its midpoint, so only the last drop that starts at or
    before the midpoint can qualify: a lookup, not a range join. A drop is repeated
    in every chunk it spans; as drops are disjoint that adds at most one row per
    chunk of the series.
    """
    if fraction < 0.5:
        raise ValueError("the midpoint argument needs a fraction of at least one half")
    mid = cuts.withColumn("_mid", (F.col("start") + F.col("end")) / F.lit(2.0))
    spanned = F.sequence(chunk_of("start", width), chunk_of(F.greatest("start", "end"), width))
    refs = drops.select(key, "start", "end").withColumn("_chunk", F.explode(spanned))
    both = tagged(
        mid.withColumn("_chunk", chunk_of("_mid", width)), refs, key, "_mid", "start", F.struct("start", "end")
    )
    w = Window.partitionBy(key, "_chunk").orderBy("_t", F.col("_ref").isNull()).rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("_drop", F.last("_ref", ignorenulls=True).over(w)).filter(F.col("_point").isNotNull()).select(
        "_point.*", "_drop"
    )
    covered = F.least("end", "_drop.end") - F.greatest("start", "_drop.start")
    length = F.col("end") - F.col("start")
    inside = F.col("_drop").isNotNull() & (covered > F.lit(fraction) * length)
    return found.select(*cuts.columns, F.coalesce(inside, F.lit(False)).alias("in_drop"))


# ------------------------------------------------------------------ anchors

def anchor_ranges(
    segments: DataFrame, key: str, start: str, anchors: Sequence[tuple[str, str]], step: float = 1
) -> DataFrame:
    """First segment that holds each phrase; an anchor runs to the next one in the list.

    The windows see at most one row per listed phrase and series.
    """
    low = F.lower("text")
    hits = F.array_compact(
        F.array(*[F.when(low.contains(p.lower()), F.struct(F.lit(i).alias("i"), F.lit(name).alias("anchor")))
                  for i, (name, p) in enumerate(anchors)])
    )
    firsts = (
        segments.select(key, F.col(start).alias("_s"), F.explode(hits).alias("h"))
        .groupBy(key, F.col("h.i").alias("i"), F.col("h.anchor").alias("anchor"))
        .agg(F.min("_s").alias("start"))
    )
    ends = segments.groupBy(key).agg((F.max(start) + step).alias("_total"))
    w = Window.partitionBy(key).orderBy("i")
    whole = Window.partitionBy(key)
    laid = firsts.select(
        key, "i", "anchor", "start",
        F.lead("start").over(w).alias("_next"),
        F.coalesce(F.col("start") >= F.lag("start").over(w), F.lit(True)).alias("_ok"),
    )
    return laid.join(ends, key).select(
        key, "anchor", "start", F.coalesce("_next", "_total").alias("end"),
        F.every("_ok").over(whole).alias("in_order"),
        (F.count("*").over(whole) == len(anchors)).alias("complete"),
    )
