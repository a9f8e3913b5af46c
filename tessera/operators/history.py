"""Change history: churn, co-change coupling, timelines, hotspots and sampling of points.

Operators take commit rows ``(sha, author, date, ts, path, added, removed)``; ``ts`` is in milliseconds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import columns as C
from tessera.functions import dims
from tessera.functions.tables import cut

#: Rows above which commits are dealt out by their number, and the rows that a task gets then.
MANY_COMMIT_ROWS, COMMIT_ROWS_A_TASK = 1_000_000, 250_000


def known_only(commits: DataFrame, files: DataFrame) -> DataFrame:
    """Commit rows of known paths, before anything is counted."""
    return commits.join(files.select("path").distinct(), "path", "left_semi")


def churn(commits: DataFrame) -> DataFrame:
    """Per path: commits, distinct authors, lines changed, first and last date (as strings, compared as strings)."""
    return commits.groupBy("path").agg(
        F.count(F.lit(1)).alias("commits"),
        F.countDistinct("author").alias("authors"),
        F.sum(F.col("added") + F.col("removed")).alias("lines_changed"),
        F.min("date").alias("first_commit"),
        F.max("date").alias("last_commit"),
    )


def pair_counts(commits: DataFrame, max_files: int = dims.MAX_COMMIT_FILES) -> DataFrame:
    """``(a, b, shared)``: commits of 2 to ``max_files`` rows that touch both paths.

    Large commits are dropped by a semi join before their paths are gathered, so no array grows with a commit, which makes
    ``max_files``^2 / 2 pairs at most. A commit's paths are one small array, and pairs come from it without a self join.
    Many rows are dealt to tasks by their number, commits first and then pairs, so that what one task counts doesn't grow with
    the input; pairs of few paths are few, and are counted where they are made.
    """
    size = commits.agg(F.count(F.lit(1)).alias("rows"), F.approx_count_distinct("path").alias("paths")).first()
    tasks = -(-size["rows"] // COMMIT_ROWS_A_TASK) if size["rows"] > MANY_COMMIT_ROWS else 0
    if tasks:
        commits = commits.select("sha", "path").repartition(tasks, "sha")
    per = _gate_small(commits, max_files).groupBy("sha").agg(F.count(F.lit(1)).alias("n"), F.collect_set(F.when(F.col("path").isNotNull(), F.col("path"))).alias("paths"))
    gated = per.filter(F.col("n").between(2, max_files)).select(F.array_sort("paths").alias("p"))
    pairs = F.flatten(F.transform("p", lambda a, i: F.transform(F.slice("p", i + 2, F.size("p")), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    every = gated.select(F.explode(pairs).alias("x")).select("x.a", "x.b")
    if tasks and size["paths"] ** 2 // 2 > COMMIT_ROWS_A_TASK:
        every = every.repartition(tasks, "a", "b")
    return every.groupBy("a", "b").agg(F.count(F.lit(1)).alias("shared"))


def _gate_small(commits: DataFrame, max_files: int) -> DataFrame:
    sizes = commits.groupBy("sha").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n").between(2, max_files))
    return commits.join(sizes, "sha", "left_semi")


def coupling(commits: DataFrame, min_shared: int = dims.MIN_SHARED, min_commits: int = dims.MIN_COMMITS, min_score: float = dims.MIN_COUPLING, top: int | None = dims.TOP_COUPLING, max_files: int = dims.MAX_COMMIT_FILES) -> DataFrame:
    """``(a, b, shared, coupling)``: shared commits over the smaller number of commits, the strongest pairs first."""
    counts = pair_counts(commits, max_files).filter(F.col("shared") >= min_shared)
    own = commits.groupBy("path").agg(F.count(F.lit(1)).alias("n"))
    both = counts.join(own.select(F.col("path").alias("a"), F.col("n").alias("na")), "a").join(own.select(F.col("path").alias("b"), F.col("n").alias("nb")), "b")
    score = F.col("shared") / F.least("na", "nb")
    kept = both.filter((F.col("na") >= min_commits) & (F.col("nb") >= min_commits) & (score >= min_score)).select("a", "b", "shared", C.round_half_up(score, 2).alias("coupling"))
    return kept if top is None else kept.orderBy(F.desc("coupling"), F.desc("shared"), "a", "b").limit(top)


def mark_hidden(pairs: DataFrame, imports: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """``pairs`` with ``hidden``: no import ``(source, target)`` in either direction joins the two; both files must exist."""
    if files is not None:
        known = files.select("path").distinct()
        pairs = pairs.join(known.withColumnRenamed("path", "a"), "a", "left_semi").join(known.withColumnRenamed("path", "b"), "b", "left_semi")
    linked = imports.select(F.least("source", "target").alias("a"), F.greatest("source", "target").alias("b"), F.lit(True).alias("linked")).distinct()
    return pairs.join(linked, ["a", "b"], "left").select(*pairs.columns, F.col("linked").isNull().alias("hidden"))


def hidden_coupling(pairs: DataFrame, imports: DataFrame, files: DataFrame | None = None, top: int = dims.TOP_HIDDEN) -> DataFrame:
    return mark_hidden(pairs, imports, files).filter("hidden").drop("hidden").orderBy(F.desc("coupling"), F.desc("shared"), "a", "b").limit(top)


def with_bucket(rows: DataFrame, bounds: DataFrame, ts: str = "ts", buckets: int = dims.BUCKETS) -> DataFrame:
    """``rows`` with ``bucket`` 0 to ``buckets`` - 1 of equal width. ``bounds`` is one row (lo, hi); equal bounds widen by a day."""
    span = F.when(F.col("hi") <= F.col("lo"), F.lit(dims.DAY_MS)).otherwise(F.col("hi") - F.col("lo"))
    place = F.floor((F.col(ts) - F.col("lo")) / span * buckets)
    return rows.join(F.broadcast(bounds)).withColumn("bucket", F.greatest(F.lit(0), F.least(F.lit(buckets - 1), place)).cast("int")).drop("lo", "hi")


def bounds_of(commit_times: DataFrame, ts: str = "ts") -> DataFrame:
    return commit_times.agg(F.min(ts).alias("lo"), F.max(ts).alias("hi"))


def commits_per_bucket(commit_times: DataFrame, ts: str = "ts", buckets: int = dims.BUCKETS) -> DataFrame:
    """``(bucket, n)`` for every bucket; counts all commits, whatever they touch."""
    n = with_bucket(commit_times.select(ts), bounds_of(commit_times, ts), ts, buckets).groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))
    every = commit_times.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket"))
    return every.join(n, "bucket", "left").select("bucket", F.coalesce("n", F.lit(0)).alias("n"))


def activity(rows: DataFrame, commit_times: DataFrame, key: str = "path", ts: str = "ts", buckets: int = dims.BUCKETS) -> DataFrame:
    """Per key: ``first_bucket`` and the dense array ``activity``."""
    placed = with_bucket(rows.select(key, ts), bounds_of(commit_times, ts), ts, buckets)
    n = placed.groupBy(key, "bucket").agg(F.count(F.lit(1)).alias("n"))
    gathered = n.groupBy(key).agg(F.min("bucket").alias("first_bucket"), F.map_from_entries(F.collect_list(F.struct("bucket", "n"))).alias("m"))
    dense = F.transform(F.sequence(F.lit(0), F.lit(buckets - 1)), lambda b: F.coalesce(F.element_at("m", b), F.lit(0)))
    return gathered.select(key, "first_bucket", dense.alias("activity"))


def hotspot_score(complexity: Column, commits: Column, most: Column) -> Column:
    change = F.when(most <= 1, F.lit(0.0)).otherwise(C.clamp01(F.log1p(commits.cast("double")) / F.log1p(most.cast("double"))))
    return C.round_half_up(F.sqrt(C.clamp01(complexity / 40.0) * change), 2)


def hotspots(files: DataFrame, stats: DataFrame, top: int | None = dims.TOP_HOTSPOTS, least: float = 0.05) -> DataFrame:
    """``(path, score, complexity, commits)`` of complex files that change often; ``files(path, complexity)``."""
    own = files.join(stats.select("path", "commits"), "path")
    most = own.agg(F.max("commits").alias("most"))
    scored = own.join(F.broadcast(most)).select("path", hotspot_score(F.col("complexity"), F.col("commits"), F.col("most")).alias("score"), "complexity", "commits")
    kept = scored.filter(F.col("score") > least)
    return kept if top is None else kept.orderBy(F.desc("score"), "path").limit(top)


def pick_evenly(items: DataFrame, order: str, points: int) -> DataFrame:
    """A systematic sample that keeps both ends: row round(i * last / (n - 1)) for i below n; ``points`` is clamped to 2..60.

    Rows get their place by a range exchange and offsets of its partitions, not by one sorted task. The exchange is written
    once, as its bounds come from samples: a second evaluation cuts at other rows. Nulls come last.
    """
    n = max(2, min(60, points))
    by = F.asc_nulls_last(order)
    ranked = cut(items.repartitionByRange(by).sortWithinPartitions(by).withColumn("__part", F.spark_partition_id()).withColumn("__in", F.monotonically_increasing_id()))
    sizes = ranked.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"), F.min("__in").alias("__first"))
    offsets = sizes.select("__part", "__first", F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    placed = ranked.join(F.broadcast(offsets), "__part").withColumn("__at", F.col("__in") - F.col("__first") + F.col("__before"))
    last = sizes.agg((F.sum("__n") - 1).alias("__last"))
    picks = items.sparkSession.range(n).join(F.broadcast(last)).select(F.when(F.col("__last") + 1 <= n, F.col("id")).otherwise(F.floor(F.col("id") * F.col("__last") / F.lit(n - 1) + 0.5)).alias("__at")).distinct()
    return placed.join(F.broadcast(picks), "__at", "left_semi").drop("__part", "__in", "__at", "__first", "__before", "__n")


def nearest(points: DataFrame, moments: DataFrame, point_ts: str, moment_ts: str, point_pos: str) -> DataFrame:
    """Each moment with its nearest point (the first among equals). Points are a small series: their number is checked."""
    if points.count() > 100_000:
        raise ValueError("the series of points is too long to be broadcast")
    series = points.agg(F.array_sort(F.collect_list(F.struct(F.col(point_pos).alias("pos"), F.col(point_ts).alias("at")))).alias("series"))
    gaps = F.transform("series", lambda p: F.struct(F.abs(p["at"] - F.col(moment_ts)).alias("gap"), p["pos"].alias("pos"), p["at"].alias("at")))
    known = F.filter(gaps, lambda g: g["gap"].isNotNull())
    return moments.join(F.broadcast(series)).withColumn("nearest", F.coalesce(F.array_min(known), F.array_min(gaps))).select(*moments.columns, F.col("nearest.pos").alias("nearest_pos"), F.col("nearest.at").alias("nearest_at"), F.col("nearest.gap").alias("gap"))


def bucket_moment(lo: Column, hi: Column, bucket: Column, buckets: int = dims.BUCKETS) -> Column:
    """The moment a bucket stands for: the ends exactly, else its middle."""
    return F.when(bucket <= 0, lo).when(bucket >= buckets - 1, hi).otherwise(lo + (bucket + 0.5) / F.lit(buckets) * (hi - lo))
