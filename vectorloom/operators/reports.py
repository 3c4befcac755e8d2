"""Result analytics: which row counts, baselines, pivots, rules and report lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DIGITS = 6


def latest(df: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """The last row of each key. An aggregation of whole rows, which combines before it shuffles, so a hot key is no burden."""
    rest = [c for c in df.columns if c not in key]
    best = df.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("row"))
    return best.select(*key, *[F.col("row")[c].alias(c) for c in rest])


def merge_sources(sources: list[DataFrame], key: list[str], order: list[Column]) -> DataFrame:
    """Rows of all sources; for each key the later source wins, then the later row."""
    out = None
    for i, s in enumerate(sources):
        part = s.withColumn("source_no", F.lit(i))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return latest(out, key, [F.col("source_no"), *order])


def pivot(df: DataFrame, row: str, column: str, values: list[str], cell: Column, missing: str = "–") -> DataFrame:
    """Rows by columns, missing cells marked."""
    wide = df.groupBy(row).pivot(column, values).agg(cell)
    return wide.select(row, *[F.coalesce(F.col(v).cast("string"), F.lit(missing)).alias(v) for v in values])


def against_baseline(df: DataFrame, key: list[str], name: str, baseline: str, value: str) -> DataFrame:
    """Percent of the baseline's value and difference from it, for every other row of the same key."""
    base = df.where(F.col(name) == baseline).select(*key, F.col(value).alias("base"))
    return df.join(base, key, "left").withColumn("percent", F.round(100.0 * F.col(value) / F.col("base"), DIGITS)).withColumn("delta", F.round(F.col(value) - F.col("base"), DIGITS))


def released(df: DataFrame, least_percent: float = 95.0, least_lo: float = -0.02, least_cos: float = 0.94, least_overlap: float = 0.75) -> DataFrame:
    """The release rule, as a column `passes`; an unknown value does not pass."""
    ok = (F.col("percent") >= least_percent) & (F.col("lo") > least_lo) & (F.col("cos") >= least_cos) & (F.col("overlap") >= least_overlap)
    return df.withColumn("passes", F.coalesce(ok, F.lit(False)))


def smallest_passing(df: DataFrame, key: list[str], name: str, size: str) -> DataFrame:
    """The smallest candidate that passes, for each key."""
    return df.where("passes").groupBy(*key).agg(F.min_by(name, F.struct(size, name)).alias(name), F.min(size).alias(size))


def passes_on(df: DataFrame, name: str, at_least: int) -> DataFrame:
    """Candidates that pass on at least so many data sets."""
    return df.groupBy(name).agg(F.count(F.when(F.col("passes"), 1)).alias("n_pass")).where(F.col("n_pass") >= at_least)


def decide(delta: Column, lo: Column, least: float = 0.01) -> Column:
    """A rule fixed beforehand: at least so much better, and significantly."""
    return F.when(delta.isNull() | lo.isNull(), "cannot decide").when((delta >= least) & (lo > 0), "yes").otherwise("no")


def share_of_effect(df: DataFrame, by: list[str], none: str, some: str, both: str) -> DataFrame:
    """How much of the effect of both parts one part gives; null where both have none."""
    part, whole = F.col(some) - F.col(none), F.col(both) - F.col(none)
    return df.groupBy(*by).agg(F.avg(F.round(part / F.nullif(whole, F.lit(0.0)), DIGITS)).alias("share"))


def upsert(old: DataFrame, new: DataFrame, key: list[str], rank: Column) -> DataFrame:
    """New rows replace old ones of the same key; in a fixed order."""
    return old.join(new.select(*key), key, "left_anti").unionByName(new).orderBy(rank, *key)


def nested(qrels: DataFrame) -> DataFrame:
    """(query_id, rel): positive judgements as a map from document to grade."""
    entries = F.sort_array(F.collect_list(F.struct(F.col("doc_id").cast("string"), "grade")))
    return qrels.where("grade > 0").groupBy("query_id").agg(F.map_from_entries(entries).alias("rel"))


def unnest(df: DataFrame, key: str, values: str) -> DataFrame:
    """A map of results by data set as rows."""
    return df.select(key, F.explode(values).alias("dataset", "value"))


def markdown(df: DataFrame, columns: list[str]) -> DataFrame:
    """(line): table rows of a report; nulls are marked."""
    cell = [F.coalesce(F.col(c).cast("string"), F.lit("–")) for c in columns]
    return df.select(F.concat(F.lit("| "), F.concat_ws(" | ", *cell), F.lit(" |")).alias("line"))


def pick(df: DataFrame, equal: dict[str, tuple], near: dict[str, float], tolerance: float = 1e-6) -> DataFrame:
    """Rows whose fields have the given values; a missing field counts as its default. `equal`: field to (value, default); `near`: number that may differ by less than the tolerance, and must be there."""
    for c, (value, default) in equal.items():
        df = df.where(F.coalesce(F.col(c), F.lit(default)) == F.lit(value))
    for c, value in near.items():
        df = df.where(F.abs(F.col(c) - F.lit(value)) < tolerance)
    return df


def tail_mean(df: DataFrame, by: list[str], order: list[Column], value: str, n: int) -> DataFrame:
    """(by, mean) of the last n values of each group, undefined ones (null or NaN) left out after the cut; fewer are all."""
    place = F.row_number().over(Window.partitionBy(*by).orderBy(*[o.desc() for o in order]))  # rank <= n is cut before the shuffle
    last = df.withColumn("__place", place).where(F.col("__place") <= n)
    return last.groupBy(*by).agg(F.round(F.avg(F.nanvl(F.col(value).cast("double"), F.lit(None).cast("double"))), DIGITS).alias("mean"))


def pivot_measures(df: DataFrame, row: str, column: str, values: list[str], measures: dict[str, Column], missing: str = "–") -> DataFrame:
    """Rows by columns with several measures in each cell, as columns value_measure; missing cells are marked."""
    wide = df.groupBy(row).pivot(column, values).agg(*[m.alias(n) for n, m in measures.items()])
    names = [f"{v}_{n}" for v in values for n in measures]
    if len(measures) == 1:  # Spark then leaves the measure's name out
        wide = wide.select(row, *[F.col(v).alias(n) for v, n in zip(values, names)])
    return wide.select(row, *[F.coalesce(F.col(f"`{n}`").cast("string"), F.lit(missing)).alias(n) for n in names])


def predictions(df: DataFrame, rules: list[tuple[str, Column, str, float]]) -> DataFrame:
    """(name, observed, bound, holds) for predictions made beforehand, from one row of results: rules are (name, observed, one of >= < within, bound); holds is null where nothing was observed."""
    test = {">=": lambda x, b: x >= b, "<": lambda x, b: x < b, "within": lambda x, b: F.abs(x) <= b}
    rows = [F.struct(F.lit(n).alias("name"), x.cast("double").alias("observed"), F.lit(float(b)).alias("bound"), test[op](x, F.lit(float(b))).alias("holds")) for n, x, op, b in rules]
    return df.select(F.explode(F.array(*rows)).alias("r")).select("r.name", F.round("r.observed", DIGITS).alias("observed"), "r.bound", "r.holds")


def arms_compared(df: DataFrame, by: list[str], arm: str, value: str, a: str, b: str) -> DataFrame:
    """For each group: the range of the value in two arms, the ratio of the larger mean to the smaller, and whether a is slower; only groups that have both arms."""
    side = lambda x: F.when(F.col(arm) == x, F.col(value))
    g = df.groupBy(*by).agg(*[f(side(x)).alias(f"{x}_{n}") for x in (a, b) for n, f in (("least", F.min), ("most", F.max), ("mean", F.avg))])
    x, y = F.col(f"{a}_mean"), F.col(f"{b}_mean")
    g = g.where(x.isNotNull() & y.isNotNull()).withColumn("slower", x > y).withColumn("ratio", F.round(F.greatest(x, y) / F.nullif(F.least(x, y), F.lit(0.0)), DIGITS))
    return g.select(*by, *[F.round(f"{z}_{n}", DIGITS).alias(f"{z}_{n}") for z in (a, b) for n in ("least", "most")], "ratio", "slower")


def best_known(keys: DataFrame, key: str, sources: list[tuple[str, DataFrame]], value: str, fallback: dict) -> DataFrame:
    """(key, value, origin): for each key the value of the first source that has one, else a constant; sources have one row for each key."""
    out, found = keys.select(key), []
    for i, (name, df) in enumerate(sources):
        out = out.join(df.select(key, F.col(value).alias(f"__{i}")), key, "left")
        found.append((name, F.col(f"__{i}")))
    if fallback:
        found.append(("constant", F.try_element_at(F.create_map(*[F.lit(x) for kv in fallback.items() for x in kv]), F.col(key))))
    origin = F.lit(None).cast("string")
    for name, c in reversed(found):
        origin = F.when(c.isNotNull(), F.lit(name)).otherwise(origin)
    return out.select(key, F.coalesce(*[c for _, c in found]).alias(value), origin.alias("origin"))


def with_kind(kinds: dict[str, DataFrame]) -> DataFrame:
    """Results measured in different ways as one table, each with its kind."""
    out = None
    for name, df in kinds.items():
        part = df.withColumn("kind", F.lit(name))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def decide_by_arms(df: DataFrame, key: list[str], arm: str, value: str, tested: str, references: list[str], spread: Column, least: float = 0.01) -> DataFrame:
    """(key, reference, delta, decision): the tested arm against the first reference arm that a key has; spread is the half-width of the difference's interval. Without the tested arm or any reference nothing can be decided."""
    at = lambda x: F.max(F.when(F.col(arm) == x, F.col(value)))
    g = df.groupBy(*key).agg(at(tested).alias("__t"), *[at(r).alias(f"__{i}") for i, r in enumerate(references)], F.max(spread).alias("__s"))
    known = [F.col(f"__{i}") for i in range(len(references))]
    name = F.lit(None).cast("string")
    for r, c in reversed(list(zip(references, known))):
        name = F.when(c.isNotNull(), F.lit(r)).otherwise(name)
    delta = F.col("__t") - F.coalesce(*known, F.lit(None).cast("double"))
    return g.select(*key, name.alias("reference"), F.round(delta, DIGITS).alias("delta"), decide(delta, delta - F.col("__s"), least).alias("decision"))


def verification(results: DataFrame, reference: DataFrame, tolerance: float = 1e-3) -> DataFrame:
    """One row about a run (query_id, value, ms) against a reference (query_id, value): n, mean, the reference's mean over the same queries, how many differ, latency. Undefined values are left out of means and comparisons."""
    j = results.join(reference.select("query_id", F.col("value").alias("ref")), "query_id", "left")
    ok = lambda c: F.nanvl(F.col(c), F.lit(None).cast("double"))
    ms = F.percentile("ms", F.array(F.lit(0.5), F.lit(0.95)))
    return j.agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg(ok("value")), DIGITS).alias("mean"), F.round(F.avg(ok("ref")), DIGITS).alias("reference_mean"), F.count(F.when(F.abs(ok("value") - ok("ref")) > tolerance, 1)).alias("n_diff"),
        F.round(ms[0], DIGITS).alias("p50"), F.round(ms[1], DIGITS).alias("p95"), F.round(F.avg("ms"), DIGITS).alias("mean_ms"),
    )


def choose(known: DataFrame, key: str, asked: str | None, default: str | None) -> str:
    """The name that a client is to use: the one asked for (an error if there is none of that name), else the default if it is known, else the first by `pos`."""
    names = [r[key] for r in known.orderBy("pos").select(key).collect()]  # a short list of clients
    if asked is not None:
        if asked not in names:
            raise KeyError(f"{asked} is not one of {names}")
        return asked
    if not names:
        raise KeyError("there is nothing to choose from")
    return default if default in names else names[0]


def assign_types(layers: DataFrame, base: str, high: str | None, names: list[str], last: int) -> DataFrame:
    """Layers (layer, name) with the type each is stored in: `high` for the given names and for all of the last layers, else `base`."""
    n = layers.agg((F.max("layer") + 1).alias("n"))
    pick = F.col("name").isin(names) | (F.lit(last) > 0) & (F.col("layer") >= F.col("n") - last)
    return layers.crossJoin(F.broadcast(n)).withColumn("type", F.when(pick & F.lit(high is not None), F.lit(high)).otherwise(F.lit(base))).drop("n")  # one row
