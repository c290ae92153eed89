"""Mixing sources to target weights by entropy balancing.

Document rates stay as close to one as the constraints allow, in the entropy of a count that lies
between 0 and MOST: rates are MOST * e / (e + MOST - 1) with e the exponential of a source's
multiplier times the document's size (in mean sizes of the source). The multipliers solve the convex
dual, one token constraint a source, by Newton's method: each iteration is one distributed sum over
the table of (source, size, documents).

Rates are then rounded into copies. A document has a phase, a hash of its own on a circle, and takes
its rate's whole part, and one copy more where its phase, turned by its source's offset, falls below
the rate's fraction. Over all offsets a source's taken words are its target on average, so some
offsets come close to it from either side; of OFFSETS the closest is used. Documents that share a
phase (equal doc_id, source and text) are counted as a group, in which copies are dealt out evenly.
So no rank over a source is ever needed, and texts are never shuffled.

Defined results: null text has size 0; the null source is a source, last in order; documents of size
0 are never repeated nor taken; rows equal in doc_id, source and text are interchangeable, and their
group takes what its rate gives together; an empty table gives no rows; other columns are kept where
documents are repeated, whatever their names, and not looked at elsewhere. All sums that decide
anything are sums of whole numbers, so results do not depend on the order of tasks.
Sources are a dimension: their statistics (one row each) are held by the driver.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WORD_JAVA, materialise

MOST = 3.0
#: Offsets that are tried, and the points of the circle of phases: a multiple of it.
OFFSETS = 1024
CIRCLE = 1 << 32
#: Newton's sums are whole numbers of this part of a word.
UNIT = 1024
#: Rows of a group that are made from one array.
EXPLODED = 10_000


def code_points(source: str | None) -> tuple:
    """Order of sources: by code point, null last."""
    return (source is None, source or "")


def water_fill(sizes: dict, weights: tuple[int, ...] = (1, 2, 3), most: float = MOST) -> dict:
    """Targets by source: shares of the total by weight, at most `most` times the source's size."""
    order = sorted(sizes, key=code_points)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    target: dict = {}
    open_, left = list(order), float(sum(sizes.values()))
    while open_:
        total = sum(weight[s] for s in open_)
        over = [s for s in open_ if left * weight[s] / total > most * sizes[s]]
        if not over:
            target |= {s: left * weight[s] / total for s in open_}
            break
        target |= {s: float(most * sizes[s]) for s in over}
        left -= sum(target[s] for s in over)
        open_ = [s for s in open_ if s not in target]
    return target


def _rate(level: Column, z: Column) -> Column:
    return F.lit(MOST) / (1 + (MOST - 1) * F.exp(-F.greatest(F.lit(-700.0), F.least(F.lit(700.0), level * z))))


def _levels(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    schema = T.StructType([T.StructField("code", T.LongType()), T.StructField("mean", T.DoubleType()), T.StructField("level", T.DoubleType())])
    return spark.createDataFrame(rows, schema)


def balance(spark: SparkSession, table: DataFrame, stats: dict[int, tuple[float, float]], targets: dict[int, float], rounds: int = 200, tolerance: float = 1e-9) -> dict[int, float]:
    """Multipliers by source code. table: (code, size, n) of sizes above 0; stats: (total, documents).

    A source is done when its sum is within the tolerance, or within half a word, of the target, or
    when its bracket holds no further number. Raises if `rounds` do not get there.
    """
    mean = {c: total / n for c, (total, n) in stats.items() if total > 0}
    level, low, high = dict.fromkeys(mean, 0.0), dict.fromkeys(mean, -math.inf), dict.fromkeys(mean, math.inf)
    todo = []
    for c in mean:
        if targets[c] >= MOST * stats[c][0] * (1 - 1e-12):
            level[c] = math.inf
        else:
            todo.append(c)
    z = F.col("size") / F.col("mean")
    w = _rate(F.col("level"), z)

    def whole(x: Column) -> Column:
        return F.sum(F.round(x * UNIT).cast("decimal(38,0)")).cast("double") / UNIT

    for _ in range(rounds):
        if not todo:
            return level
        # one row a source: small, and joined as Spark sees fit
        sums = table.join(_levels(spark, [(c, mean[c], level[c]) for c in todo]), "code").groupBy("code").agg(whole(F.col("n") * F.col("size") * w).alias("f"), whole(F.col("n") * F.col("size") * z * w * (1 - w / MOST)).alias("g"))
        for r in sums.collect():
            c, miss = r["code"], r["f"] - targets[r["code"]]
            if abs(miss) <= max(0.5, tolerance * targets[c]):
                todo.remove(c)
                continue
            if miss > 0:
                high[c] = level[c]
            else:
                low[c] = level[c]
            step = level[c] - miss / r["g"] if r["g"] > 0 else math.nan
            if not low[c] < step < high[c]:  # Newton left the bracket: halve, or widen it
                step = (low[c] + high[c]) / 2 if math.isfinite(low[c] + high[c]) else (level[c] * 2 + math.copysign(1, -miss))
            if step in (low[c], high[c]):
                todo.remove(c)
            level[c] = step
    raise RuntimeError(f"no balance after {rounds} iterations for {len(todo)} sources")


def _words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD_JAVA)), F.lit(0)).cast("long")


def _phase(seed: int) -> Column:
    """A document's place on the circle, of its doc_id, source and text."""
    return F.pmod(F.xxhash64(F.lit(seed), "doc_id", "source", F.col("text")), F.lit(CIRCLE))


def _turned(whole: Column, fraction: Column, phase: Column, offset: Column) -> Column:
    """Copies of one document: whole, and one more where its turned phase is below its fraction."""
    return whole + (F.pmod(phase + offset, F.lit(CIRCLE)) < fraction).cast("long")


class Mixture:
    """What a mix takes: sources(source, code, source_size, target, mean, level, offset), one row each.

    groups: (doc_id, source, size, phase, n), equal rows together; repeated: whether any n is above 1.
    """

    def __init__(self, docs: DataFrame, *, weights: tuple[int, ...] = (1, 2, 3), seed: int = 42):
        spark, self.seed = docs.sparkSession, seed
        slim = docs.select("doc_id", "source", _words(F.col("text")).alias("size"), _phase(seed).alias("phase"))
        self.groups = groups = materialise(slim.groupBy("doc_id", "source", "size", "phase").agg(F.count("*").alias("n")), "mixing-sizes")
        by_source = groups.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("total"), F.sum(F.when(F.col("size") > 0, F.col("n")).otherwise(0)).alias("n"), F.max("n").alias("most")).collect()
        self.repeated = any(r["most"] > 1 for r in by_source)
        sizes = {r["source"]: r["total"] for r in by_source}
        targets = water_fill(sizes, weights)
        code = {s: i for i, s in enumerate(sorted(sizes, key=code_points))}
        known = T.StructType([T.StructField("source", T.StringType()), T.StructField("code", T.LongType()), T.StructField("source_size", T.LongType()), T.StructField("target", T.DoubleType()), T.StructField("mean", T.DoubleType())])
        mean = {r["source"]: r["total"] / r["n"] if r["total"] else 1.0 for r in by_source}
        coded = spark.createDataFrame([(s, code[s], sizes[s], targets[s], mean[s]) for s in sizes], known)
        with_code = groups.where("size > 0").join(coded.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of")))
        table = materialise(with_code.groupBy("code", "size").agg(F.sum("n").alias("n")), "mixing-counts")
        stats = {code[r["source"]]: (float(r["total"]), float(r["n"])) for r in by_source}
        level = balance(spark, table, stats, {code[s]: t for s, t in targets.items()})
        solved = _levels(spark, [(c, 0.0, min(x, 1e300)) for c, x in level.items()]).drop("mean")
        solved = coded.join(solved, "code", "left").withColumn("level", F.coalesce("level", F.lit(0.0)))
        self.sources = solved.join(self._offsets(solved), "code", "left").withColumn("offset", F.coalesce("offset", F.lit(0).cast("long")))
        self.sources = materialise(self.sources, "mixing-sources")

    @staticmethod
    def _split(n: Column) -> tuple[Column, Column]:
        """The rate of n documents of a size together: its whole part, and its fraction on the circle."""
        one = F.when(F.col("level") >= 1e300, F.lit(MOST)).otherwise(_rate(F.col("level"), F.col("size") / F.col("mean")))
        rate = F.when(F.col("size") > 0, n * one).otherwise(F.lit(0.0))
        return F.floor(rate), F.floor((rate - F.floor(rate)) * CIRCLE)

    def _rated(self, sources: DataFrame) -> DataFrame:
        whole, fraction = self._split(F.col("n"))
        return self.groups.join(sources.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of"))).withColumn("whole", whole).withColumn("fraction", fraction)

    def _offsets(self, solved: DataFrame) -> DataFrame:
        """(code, offset): of the offsets tried, that whose taken words are closest to the target.

        A group's additional copy is taken at the offsets of one arc, so it is two changes along the
        circle; the changes are summed by source and offset, and then along the offsets.
        """
        step = CIRCLE // OFFSETS
        start = F.pmod(F.lit(CIRCLE) - F.col("phase"), F.lit(CIRCLE))
        first, last = F.ceil(start / step), F.ceil((start + F.col("fraction")) / step)
        size = F.col("size").cast("decimal(38,0)")
        rated = self._rated(solved).where("size > 0")
        base = rated.groupBy("code", "target").agg(F.sum(size * F.col("whole")).alias("base"))
        ends = F.array(F.struct(first.alias("k"), size.alias("by")), F.struct(last.alias("k"), (-size).alias("by")))
        change = rated.where("fraction > 0").select("code", F.inline(ends)).groupBy("code", "k").agg(F.sum("by").alias("by"))
        grid = base.select("code", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(2 * OFFSETS - 1).cast("long"))).alias("k"))
        so_far = F.sum(F.coalesce("by", F.lit(0))).over(Window.partitionBy("code").orderBy("k").rowsBetween(Window.unboundedPreceding, 0))
        along = grid.join(change, ["code", "k"], "left").select("code", "k", so_far.alias("got"))
        # an arc may pass the end of the circle: its offsets beyond come again at the beginning
        folded = along.groupBy("code", (F.col("k") % OFFSETS).alias("k")).agg(F.sum("got").alias("got"))
        miss = F.abs((F.col("got") + F.col("base")).cast("double") - F.col("target"))
        return folded.join(base, "code").groupBy("code").agg((F.min_by("k", F.struct(miss.alias("miss"), F.col("k"))) * step).cast("long").alias("offset"))

    def copies(self) -> DataFrame:
        """(doc_id, source, size, source_size, target, copies), a row for each row of the documents.

        A group of equal rows deals its copies out evenly: the first ones take one more.
        """
        rated = self._rated(self.sources).withColumn("together", _turned(F.col("whole"), F.col("fraction"), F.col("phase"), F.col("offset")))
        first = F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"), F.lit(EXPLODED).cast("long")))
        each = rated.withColumn("first", first).withColumn("i", F.explode(F.sequence(F.col("first"), F.least(F.col("n"), F.col("first") + EXPLODED - 1))))
        extra = F.col("i") <= F.pmod(F.col("together"), F.col("n"))
        return each.select("doc_id", "source", "size", "source_size", "target", (F.floor(F.col("together") / F.col("n")) + extra.cast("long")).alias("copies"))


def mix(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies) for every row of docs(doc_id, text, source)."""
    return Mixture(docs.select("doc_id", "text", "source"), **options).copies()


def repeat_documents(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs, each as often as the mix takes it.

    A row's copies follow from its own columns and its source's row, so documents are read once more
    and not moved. Only rows that are equal in doc_id, source and text are numbered, in blocks of
    rows of the input, and each block rounds for itself.
    """
    plan = Mixture(docs.select("doc_id", "text", "source"), **options)
    names = docs.columns
    fields = [F.col(f"d.`{c}`").alias(c) for c in names]
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("d"), F.col("doc_id"), F.col("source"), F.col("text"))
    row = row.select("d", "source", "doc_id", _words(F.col("text")).alias("size"), _phase(plan.seed).alias("phase"))
    rated = row.join(plan.sources.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of")))
    out = None
    if plan.repeated:
        several = plan.groups.where("n > 1").select("phase", F.lit(True).alias("several")).distinct()
        marked = rated.withColumn("block", F.spark_partition_id()).join(several, "phase", "left")
        key = ["doc_id", "source", "size", "phase", "block"]
        i = F.row_number().over(Window.partitionBy(*key).orderBy("doc_id"))
        n = F.count("*").over(Window.partitionBy(*key))
        whole, fraction = plan._split(F.col("n"))
        together = _turned(whole, fraction, F.pmod(F.xxhash64("phase", "block"), F.lit(CIRCLE)), F.col("offset"))
        equal = marked.where("several").withColumn("i", i).withColumn("n", n).withColumn("together", together)
        out = equal.select("d", (F.floor(F.col("together") / F.col("n")) + (F.col("i") <= F.pmod(F.col("together"), F.col("n"))).cast("long")).alias("times"))
        rated = marked.where("several is null")
    whole, fraction = plan._split(F.lit(1))
    own = rated.select("d", _turned(whole, fraction, F.col("phase"), F.col("offset")).alias("times"))
    out = own if out is None else own.unionByName(out)
    return out.where("times > 0").select("d", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times")))).select(*fields)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op10: what the mix takes of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = mix(docs)
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))
