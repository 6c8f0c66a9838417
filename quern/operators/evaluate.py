"""Quality against golden sets: relevance, hit rates, reciprocal ranks, percentiles, tags and log flags."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as Win
from pyspark.sql import functions as F

from ..sources.tables import written


def relevant(text: Column, source_id: Column, ids: Column, substrings: Column) -> Column:
    """The source is expected, or the text holds an expected string in any case; empty strings don't count."""
    said = F.exists(substrings, lambda s: (s != "") & F.contains(F.lower(text), F.lower(s)))
    return F.coalesce(F.array_contains(ids, source_id), F.lit(False)) | F.coalesce(said, F.lit(False))


def score_items(golden: DataFrame, results: DataFrame) -> DataFrame:
    """golden (id, tags, expected_ids, expected_substrings), results (id, rank, source_id, text): one row for each item."""
    both = golden.join(results, "id", "left")
    hit = relevant(F.col("text"), F.col("source_id"), F.col("expected_ids"), F.col("expected_substrings"))
    first = F.min(F.when(hit, F.col("rank")))
    out = both.groupBy("id").agg(first.cast("long").alias("first_rank"), F.count("rank").alias("returned"))
    at = lambda k: F.coalesce(F.col("first_rank") <= k, F.lit(False)).alias(f"hit_at_{k}")
    return out.select("id", "first_rank", "returned", at(1), at(3), at(5), F.coalesce(1.0 / F.col("first_rank"), F.lit(0.0)).alias("rr"))


def nearest_rank(values: Column, percent: float) -> Column:
    """The value at round-half-even(p / 100 * (n - 1)) of the sorted values; 0 for none. values: an array."""
    v = F.array_sort(values)
    return F.coalesce(F.try_element_at(v, F.greatest(F.lit(1), F.bround(F.lit(percent / 100.0) * (F.size(v) - 1)).cast("int") + 1)), F.lit(0.0))


def exact_percentiles(rows: DataFrame, key: str, value: str, percents: list[int]) -> DataFrame:
    """Nearest-rank percentiles for each key, by ranks rather than by a gathered list: no group meets in one row."""
    counts = rows.where(F.col(value).isNotNull()).groupBy(key, value).agg(F.count(F.lit(1)).alias("c"))
    over = Win.partitionBy(key)
    put = counts.withColumn("upto", F.sum("c").over(over.orderBy(value).rowsBetween(Win.unboundedPreceding, 0))).withColumn("n", F.sum("c").over(over))
    at = lambda p: F.bround(F.lit(p / 100.0) * (F.col("n") - 1)) + 1
    return put.groupBy(key).agg(F.max("n").alias("n"), *(F.min(F.when(F.col("upto") >= at(p), F.col(value))).alias(f"p{p}") for p in percents))


def report(rows: DataFrame) -> DataFrame:
    """Means over rows without error; total counts them all."""
    ok = F.col("error").isNull()
    mean = lambda c: F.coalesce(F.avg(F.when(ok, F.col(c).cast("double"))), F.lit(0.0))
    return rows.agg(F.count(F.lit(1)).alias("total"), F.count_if(~ok).alias("errors"), *(mean(f"hit_at_{k}").alias(f"recall_at_{k}") for k in (1, 3, 5)), mean("rr").alias("mrr"))


def by_tag(rows: DataFrame) -> DataFrame:
    one = rows.where("error is null").select(F.explode("tags").alias("tag"), "hit_at_5", "rr")
    return one.groupBy("tag").agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("hit_at_5").cast("double")).alias("recall_at_5"), F.avg("rr").alias("mrr"))


def log_flags(confidence: Column, returned: Column) -> Column:
    return F.struct((confidence < 0.4).alias("low_confidence"), (returned == 0).alias("empty_result"))


def format_report(row) -> str:
    """A few lines of text from the one row of report()."""
    return "\n".join(f"{k}: {v:.3f}" if isinstance(v, float) else f"{k}: {v}" for k, v in row.asDict().items())


#: Values of a key that one task may sort; keys with more are searched by ranges.
MOST_SORTED = 100_000
#: Ranges that a key's values are counted in, in one round.
RANGES = 4096


def percentiles(rows: DataFrame, key: str, value: str, percents: list[int], most: int = MOST_SORTED, save=written) -> DataFrame:
    """exact_percentiles without a task that sorts all values of a key: (key, n, p<percent>, ...), n being the number of values.

    Keys of up to ``most`` values are ranked by a window. For others each round counts the values in RANGES ranges
    between the least and the greatest one left, and goes on in the range that holds the wanted rank, until all its values are one.
    Counting is partial in the tasks that read the rows, so a key with all rows is as cheap as any.
    NaN comes after all numbers. Null keys are a key; null values don't count; keys without values are left out.
    """
    named = rows.where(F.col(value).isNotNull()).select(F.struct(F.col(key).alias("k")).alias("key"), F.col(value).alias("v"))
    sizes = save(named.groupBy("key").agg(F.count(F.lit(1)).alias("n")))
    few = named.groupBy("key", "v").agg(F.count(F.lit(1)).alias("c")).join(sizes.where(F.col("n") <= most), "key")
    upto = few.withColumn("upto", F.sum("c").over(Win.partitionBy("key").orderBy("v").rowsBetween(Win.unboundedPreceding, 0)))
    rank = lambda p: F.bround(F.lit(p / 100.0) * (F.col("n") - 1)).cast("long") + 1
    small = upto.groupBy("key").agg(F.max("n").alias("n"), *(F.min(F.when(F.col("upto") >= rank(p), F.struct("v"))).alias(f"p{p}") for p in percents))
    small = small.select("key", "n", *(F.col(f"p{p}.v").alias(f"p{p}") for p in percents))
    hot = sizes.where(F.col("n") > most)
    many = hot.count()
    if not many:
        return small.select(F.col("key.k").alias(key), "n", *(f"p{p}" for p in percents))
    sent = lambda d, k: F.broadcast(d) if k <= 10_000 else d
    large = save(named.join(sent(hot, many), "key", "left_semi"))
    wanted = hot.select("key", "n", F.explode(F.array(*(F.struct(F.lit(p).alias("p"), rank(p).alias("rank")) for p in percents))).alias("x")).select("key", "n", "x.p", "x.rank")
    left = save(wanted.withColumn("lo", F.lit(None).cast("double")).withColumn("hi", F.lit(None).cast("double")).withColumn("done", F.lit(False)))
    found = []
    while open_ := left.where("not done").count():
        found.append(left.where("done"))
        left = save(_narrowed(large, sent(left.where("not done"), open_)))
    done = reduce(DataFrame.unionByName, [*found, left]).groupBy("key").agg(F.max("n").alias("n"), *(F.max(F.when(F.col("p") == p, F.col("lo"))).alias(f"p{p}") for p in percents))
    kind = dict(small.dtypes)[f"p{percents[0]}"]
    done = done.select("key", "n", *(F.col(f"p{p}").cast(kind).alias(f"p{p}") for p in percents))
    return small.unionByName(done).select(F.col("key.k").alias(key), "n", *(f"p{p}" for p in percents))


def _narrowed(rows: DataFrame, state: DataFrame) -> DataFrame:
    """A round of percentiles(): for each (key, p) the least and greatest value of the range that holds its rank, and the rank within it.

    Values outside a range that is known by now have been counted before. Infinite values and NaN have ranges of their own.
    """
    v, lo, hi = F.col("v").cast("double"), F.col("lo"), F.col("hi")
    inside = lo.isNull() | ((v >= lo) & (v <= hi))
    plain = ~F.isnan(v) & (F.abs(v) != float("inf"))
    met = rows.join(state, "key").where(inside).select("key", "n", "p", "rank", v.alias("v"), "lo", "hi", plain.alias("plain"))
    # the first round has no range yet: it finds the least and the greatest number
    at = F.when(~F.col("plain"), F.when(F.isnan("v"), RANGES + 1).when(F.col("v") > 0, RANGES).otherwise(-1))
    share = (F.col("v") / 2 - lo / 2) / (hi / 2 - lo / 2)
    at = at.when(lo.isNull() | (lo == hi), 0).otherwise(F.least(F.floor(share * RANGES), F.lit(RANGES - 1))).cast("int")
    ranges = met.groupBy("key", "n", "p", "rank", at.alias("at")).agg(F.count(F.lit(1)).alias("c"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    over = Win.partitionBy("key", "p").orderBy("at")
    before = F.sum("c").over(over.rowsBetween(Win.unboundedPreceding, 0)) - F.col("c")
    put = ranges.withColumn("before", before).where((F.col("before") < F.col("rank")) & (F.col("rank") <= F.col("before") + F.col("c")))
    return put.select("key", "n", "p", (F.col("rank") - F.col("before")).alias("rank"), "lo", "hi", F.col("lo").eqNullSafe(F.col("hi")).alias("done"))


def full_report(rows: DataFrame, save=written) -> DataFrame:
    """One row for all items (tag null) and one for each tag: counts, recall, reciprocal rank, confidence, latency, compression.

    rows: id, tags, error, hit_at_1, hit_at_3, hit_at_5, rr, confidence, latency_ms, chars_before, chars_after. Means, percentiles and ratio are over rows
    without an error; total counts all. An item without tags is in the row for all alone. Ratios and means over nothing are 0.
    """
    tags = F.array_distinct(F.filter(F.coalesce("tags", F.array().cast("array<string>")), lambda t: t.isNotNull()))
    each = save(rows.withColumn("tag", F.explode(F.concat(F.array(F.lit(None).cast("string")), tags))))
    ok = F.col("error").isNull()
    mean = lambda c, name: F.coalesce(F.avg(F.when(ok, F.col(c).cast("double"))), F.lit(0.0)).alias(name)
    total = lambda c: F.sum(F.when(ok, F.col(c)))
    ratio = F.coalesce(F.try_divide(total("chars_after").cast("double"), total("chars_before").cast("double")), F.lit(0.0))
    out = each.groupBy("tag").agg(
        F.count(F.lit(1)).alias("total"), F.count_if(~ok).alias("errors"), *(mean(f"hit_at_{k}", f"recall_at_{k}") for k in (1, 3, 5)), mean("rr", "mrr"), mean("confidence", "mean_confidence"), mean("latency_ms", "mean_latency_ms"), ratio.alias("compression_ratio"),
        F.count_if(ok & (F.col("confidence") < 0.4)).alias("low_confidence"),
    )
    times = percentiles(each.where(ok).select("tag", "latency_ms"), "tag", "latency_ms", [50, 95], save=save)
    times = times.select(F.col("tag").alias("~tag"), F.col("p50").alias("p50_latency_ms"), F.col("p95").alias("p95_latency_ms"))
    joined = out.join(times, F.col("tag").eqNullSafe(F.col("~tag")), "left").drop("~tag")
    return joined.na.fill(0.0, ["p50_latency_ms", "p95_latency_ms"])


def run_items(golden: DataFrame, search, save=written) -> DataFrame:
    """golden (id, query, tags, expected_ids, expected_substrings[, error]) through search, one row for each item, with what went wrong in it.

    search(questions) takes (query_id, query) and returns (query_id, rank, source_id, text) and, where it has them, error, confidence and latency_ms by row.
    A golden item that is broken, a question that is blank and a question whose search reports an error are rows with an error.
    """
    broken = F.col("error") if "error" in golden.columns else F.lit(None).cast("string")
    items = save(golden.withColumn("error", F.coalesce(broken, F.when(F.trim(F.coalesce("query", F.lit(""))) == "", "query is empty"))))
    good = items.where("error is null")
    found = save(search(good.select(F.col("id").alias("query_id"), "query")).withColumnRenamed("query_id", "id"))
    scored = score_items(good, found.where("rank is not null"))
    more = [c for c in ("error", "confidence", "latency_ms") if c in found.columns]
    said = found.groupBy("id").agg(F.max(F.lit(1)).alias("~seen"), *(F.max(c).alias("~error" if c == "error" else c) for c in more))
    out = items.select("id", "tags", "error").join(scored, "id", "left").join(said, "id", "left").drop("~seen")
    if "error" in more:
        out = out.withColumn("error", F.coalesce("error", "~error")).drop("~error")
    no = {f"hit_at_{k}": False for k in (1, 3, 5)}
    return out.na.fill(no).na.fill({"rr": 0.0, "returned": 0})


def save_report(report: DataFrame, folder: str, stamp: str) -> str:
    """The report as JSON lines in a folder named by the time stamp, and as text beside it; the path. A report has a row for each tag."""
    path = f"{folder.rstrip('/')}/report-{stamp}"
    report.coalesce(1).write.mode("errorifexists").json(f"{path}/json")
    lines = [format_report(r) for r in report.orderBy(F.asc_nulls_first("tag")).collect()]
    report.sparkSession.createDataFrame([("\n\n".join(lines),)], "value string").coalesce(1).write.text(f"{path}/text")
    return path
