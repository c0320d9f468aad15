"""Distance observations and the thresholds learnt from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as C
from ..functions import scoring

PERCENTILES = (0.10, 0.25, 0.50, 0.75, 0.90, 0.95)


def first_observations(observations: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """Of each (query_hash, language) the first arrival (``ts``, then the nearest), unless it is stored already."""
    first = observations.groupBy("query_hash", "language").agg(F.min(F.struct("ts", "distance")).alias("f"))  # pre-aggregated, no sort
    rows = first.select("language", F.col("f.distance").alias("distance"), "query_hash", F.col("f.ts").alias("ts"))
    return rows if existing is None else rows.join(existing.select("query_hash", "language"), ["query_hash", "language"], "left_anti").select("language", "distance", "query_hash", "ts")


def aged(observations: DataFrame, now: int, max_age: int = C.MAX_AGE_SECONDS) -> DataFrame:
    return observations.filter(F.col("ts") >= now - max_age)


def sample_every(rate: float) -> int:
    """Every how many queries one is observed; 0: none."""
    return 0 if rate <= 0 else 1 if rate >= 1 else int(1 / rate)


def sampled(queries: DataFrame, rate: float = C.SAMPLE_RATE) -> DataFrame:
    """Queries (column ``query_no``, counted from 0) that are observed."""
    every = sample_every(rate)
    return queries.filter(F.col("query_no") % every == 0 if every else F.lit(False))


#: Bins of a group's range; only the values of those that hold a wanted rank are put in order.
BINS = 4096


def percentiles(values: DataFrame) -> DataFrame:
    """(grp, p): exact percentiles (linear between neighbours) of (grp, d), as an array in the order of ``PERCENTILES``.

    Equal values are counted first.  A histogram of ``BINS`` bins a group tells which bins hold the wanted ranks, and only
    their values are sorted, so no task holds a group's values.
    """
    counts = values.groupBy("grp", "d").agg(F.count("*").alias("k"))
    ends = counts.groupBy("grp").agg(F.sum("k").alias("n"), F.min("d").alias("lo"), F.max("d").alias("hi"))  # a row for each group
    at = F.least(F.lit(BINS - 1), F.floor((F.col("d") - F.col("lo")) / (F.col("hi") - F.col("lo")) * BINS))
    binned = counts.join(F.broadcast(ends), "grp").withColumn("bin", F.coalesce(F.when(F.col("hi") > F.col("lo"), at), F.lit(0)))
    hist = binned.groupBy("grp", "bin", "n").agg(F.sum("k").alias("k"))  # BINS rows a group at most
    upto = F.sum("k").over(Window.partitionBy("grp").orderBy("bin"))
    hist = hist.withColumn("before", upto - F.col("k"))
    ranks = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(side).alias("side"), (F.floor if side == 0 else F.ceil)(F.lit(p) * (F.col("n") - 1)).alias("rank"), (F.lit(p) * (F.col("n") - 1)).alias("at"))
                                for i, p in enumerate(PERCENTILES) for side in (0, 1)]))
    wanted = hist.select("grp", "bin", "before", "k", ranks.alias("w")).filter((F.col("before") <= F.col("w.rank")) & (F.col("w.rank") < F.col("before") + F.col("k"))).select("grp", "bin", "before", "w.*")
    # two ranks a percentile and group
    needed = F.broadcast(wanted.select("grp", "bin", "before").distinct())
    running = F.sum("k").over(Window.partitionBy("grp", "bin").orderBy("d"))
    placed = binned.select("grp", "bin", "d", "k").join(needed, ["grp", "bin"]).withColumn("end", F.col("before") + running)
    hit = placed.select("grp", "bin", "d", (F.col("end") - F.col("k")).alias("first"), "end").join(F.broadcast(wanted.drop("before")), ["grp", "bin"]).filter((F.col("first") <= F.col("rank")) & (F.col("rank") < F.col("end")))
    side = lambda x: F.max(F.when(F.col("side") == x, F.col("d")))
    each = hit.groupBy("grp", "i").agg(side(0).alias("a"), side(1).alias("b"), F.max("at").alias("at"))
    value = F.col("a") + (F.col("b") - F.col("a")) * (F.col("at") - F.floor("at"))
    return each.groupBy("grp").agg(F.array_sort(F.collect_list(F.struct("i", value.alias("v")))).alias("p")).select("grp", F.transform("p", lambda x: x["v"]).alias("p"))


def distance_stats(observations: DataFrame) -> DataFrame:
    d = F.col("distance").cast("double")
    out = observations.groupBy("language").agg(F.count(d).alias("n"), F.avg(d).alias("mean"), F.stddev_pop(d).alias("std"), F.min(d).alias("min"), F.max(d).alias("max"))
    found = percentiles(observations.select(F.col("language").alias("grp"), d.alias("d")).filter("d is not null"))
    out = out.join(found, out["language"].eqNullSafe(found["grp"]), "left")
    return out.select("language", "n", *[F.round(c, 6).alias(c) for c in ("mean", "std", "min", "max")], *[F.round(F.col("p")[k], 6).alias(f"p{int(round(x * 100))}") for k, x in enumerate(PERCENTILES)])


def thresholds(p10: Column, p90: Column, n: Column) -> list[Column]:
    far = F.least(F.lit(3.0), F.greatest(F.lit(0.5), p90))
    near = F.least(F.lit(0.8), F.greatest(F.lit(0.1), scoring.similarity(p10)))
    return [F.round(far, 6).alias("max_distance"), F.round(near, 6).alias("min_similarity"), scoring.confidence(n).alias("confidence")]


def calibrate(observations: DataFrame, min_samples: int = C.MIN_SAMPLES) -> DataFrame:
    """A row for each language with enough observations, and one over all observations (``_global``)."""
    d = F.col("distance").cast("double")
    rows = observations.filter("language is not null and distance is not null")
    rolled = rows.rollup("language").agg(F.grouping("language").alias("all_of"), F.count("*").alias("n"), F.avg(d).alias("mean"), F.stddev_pop(d).alias("std"))
    key = F.when(F.col("all_of") == 1, C.GLOBAL_KEY).otherwise(F.col("language"))
    rolled = rolled.filter(F.col("n") >= min_samples).withColumn("grp", key)
    both = rows.select(F.explode(F.array(F.col("language"), F.lit(C.GLOBAL_KEY))).alias("grp"), d.alias("d"))
    at = {x: F.col("p")[k] for k, x in enumerate(PERCENTILES)}
    return rolled.join(percentiles(both), "grp").select(F.col("grp").alias("language"), *thresholds(at[0.10], at[0.90], F.col("n")), F.col("n").alias("sample_count"),
                                                        *[F.round(at[x], 6).alias(f"p{int(x * 100)}") for x in (0.5, 0.9, 0.95)], *[F.round(c, 6).alias(c) for c in ("mean", "std")])


def lookup(languages: DataFrame, calibrations: DataFrame) -> DataFrame:
    """(language, max_distance, min_similarity): a language's own row if good enough, else the global one, else the defaults."""
    good = calibrations.filter(scoring.sufficient(F.col("confidence"))).select("language", "max_distance", "min_similarity")
    own = good.filter(F.col("language") != C.GLOBAL_KEY)
    whole = good.filter(F.col("language") == C.GLOBAL_KEY).agg(F.max("max_distance").alias("g_max"), F.max("min_similarity").alias("g_min"))
    rows = languages.join(own, "language", "left").crossJoin(F.broadcast(whole))  # one row
    return rows.select("language", F.coalesce("max_distance", "g_max", F.lit(C.DEFAULT_MAX_DISTANCE)).alias("max_distance"),
                       F.coalesce("min_similarity", "g_min", F.lit(C.DEFAULT_MIN_SIMILARITY)).alias("min_similarity"))


def calibrate_one(observations: DataFrame, language: str, min_samples: int = C.MIN_SAMPLES) -> DataFrame:
    """One language; the calibrator's own minimum holds as well."""
    rows = calibrate(observations.filter(F.col("language") == language), max(min_samples, C.MIN_SAMPLES))
    return rows.filter(F.col("language") != C.GLOBAL_KEY)


def observe(near: DataFrame, query_hash: int, ts: int) -> DataFrame:
    """Observations of one query's neighbours (language, distance); rows without a language do not count."""
    return near.filter(F.col("language").isNotNull()).select("language", F.col("distance").cast("float").alias("distance"), F.lit(query_hash).cast("long").alias("query_hash"), F.lit(ts).cast("long").alias("ts"))


def bootstrap(total: int, threshold: int = C.BOOTSTRAP_ROWS) -> tuple[bool, int]:
    """(still in bootstrap, progress in percent)."""
    return total < threshold, min(100, 100 * total // threshold) if threshold else 100


def running_bootstrap(observations: DataFrame, threshold: int = C.BOOTSTRAP_ROWS, width: int = 65_536) -> DataFrame:
    """For each query in order: the total after it, and whether it is the one that ends bootstrap.

    Queries are summed by ranges of ``width`` numbers; a window runs over the ranges' sums and one over the queries of
    each range, so no task holds all queries.
    """
    each = observations.groupBy("query_no").agg(F.count("*").alias("k")).withColumn("range", F.floor(F.col("query_no") / width))
    sums = each.groupBy("range").agg(F.sum("k").alias("s"))
    before = sums.withColumn("before", F.sum("s").over(Window.orderBy("range")) - F.col("s")).select("range", "before")  # a row for each range
    within = F.sum("k").over(Window.partitionBy("range").orderBy("query_no"))
    total = F.col("before") + F.col("within")
    rows = each.withColumn("within", within).join(before, "range")
    return rows.select("query_no", total.alias("total"), ((total >= threshold) & (total - F.col("k") < threshold)).alias("calibrate"))


def summary(rows: DataFrame) -> str:
    """Languages in order, then all; calibrations are a row a language."""
    got = sorted((r["language"] == C.GLOBAL_KEY, r["language"], r) for r in rows.collect())
    return "\n".join(f"{'global' if last else name}: max_distance={r['max_distance']:.3f} min_similarity={r['min_similarity']:.3f} confidence={r['confidence']} samples={r['sample_count']}" for last, name, r in got) or "not calibrated"
