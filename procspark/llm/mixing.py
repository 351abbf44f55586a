"""Mixing sources to target weights by entropy balancing, in DataFrame operations only.

Document rates minimise their divergence from 1 under one token constraint for each source and a bound of 2 on each
rate.  The solution tilts exponentially, rate = min(2, exp(lambda_source * size / scale_source)); Newton steps, kept
within a bracket, find lambda from sums over size classes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import Scratch

#: Weights of sources in order, the share of all words, the bound on repeats.
WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2.0
#: Newton's steps end when every source is so near its target, relatively, or after so many.
TOLERANCE = 1e-9
STEPS = 60
#: Rows of a source that are ordered together, about, when copies are rounded; bins go by the logarithm of the draw.
BIN_ROWS = 50_000


def size_of(text: str | Column) -> Column:
    """Number of words; null has none."""
    col = F.col(text) if isinstance(text, str) else text
    return F.coalesce(F.regexp_count(col, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")


def targets(sources: DataFrame) -> DataFrame:
    """Adds ``weight`` and ``target`` to ``(source, source_size)``, one row for each source.

    Words are shared by weight; a source takes ``MOST`` times its size at most, and the others share what is left.
    The window runs over the sources, not over documents.
    """
    n = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (n % len(WEIGHTS)) + 1).cast("double")
    df = sources.withColumn("weight", weight).withColumn("cap", MOST * F.col("source_size"))
    by_ratio = W.orderBy(F.col("cap") / F.col("weight"), "source")
    everyone = W.partitionBy(F.lit(0))
    all_words = SHARE * F.sum("source_size").over(everyone)
    before = F.coalesce(F.sum("cap").over(by_ratio.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("weight").over(by_ratio.rowsBetween(W.currentRow, W.unboundedFollowing))
    df = df.withColumn("all_words", all_words).withColumn("full", F.col("cap") / F.col("weight") <= (all_words - before) / rest)
    free = F.sum(F.when(~F.col("full"), F.col("weight"))).over(everyone)
    taken = F.coalesce(F.sum(F.when(F.col("full"), F.col("cap"))).over(everyone), F.lit(0.0))
    level = (F.col("all_words") - taken) / free
    return df.withColumn("target", F.when(F.col("full"), F.col("cap")).otherwise(F.col("weight") * level)).select(
        "source", "source_size", "weight", "target"
    )


def _rate(size: str = "size") -> Column:
    tilt = F.exp(F.least(F.col("lam") * F.col(size), F.lit(1.0)))
    return F.when(F.col("always"), F.lit(MOST)).otherwise(F.least(F.lit(MOST), tilt))


def _solve(classes: DataFrame, wanted: DataFrame, scratch: Scratch) -> DataFrame:
    """Adds ``lam`` to the sources; one small aggregate over size classes for each Newton step."""
    state = wanted.select(
        "source",
        "source_size",
        "target",
        (F.col("target") >= MOST * F.col("source_size") * (1 - 1e-12)).alias("always"),
        F.lit(0.0).alias("lam"),
        (-60.0 * F.lit(1.0)).alias("low"),
        F.log(F.lit(MOST)).alias("high"),
        F.lit(None).cast("double").alias("off"),
    )
    state = scratch.cut(state, "state")
    for _ in range(STEPS):
        words = F.col("size") * F.col("n")
        joined = classes.join(state, classes["s"].eqNullSafe(state["source"]))
        slope = F.when(_rate() < MOST, words * F.col("size") * _rate()).otherwise(0.0)
        sums = joined.groupBy("s").agg(F.sum(words * _rate()).alias("now"), F.sum(slope).alias("slope"))
        nxt = state.join(sums, state["source"].eqNullSafe(sums["s"]), "left").withColumn("gap", F.col("now") - F.col("target"))
        low = F.when(F.col("gap") < 0, F.col("lam")).otherwise(F.col("low"))
        high = F.when(F.col("gap") > 0, F.col("lam")).otherwise(F.col("high"))
        step = F.when(F.col("slope") > 0, F.col("lam") - F.col("gap") / F.col("slope"))
        inside = (step > low) & (step < high)
        settled = F.col("always") | F.coalesce(F.abs("gap") <= TOLERANCE * F.greatest("target", F.lit(1.0)), F.lit(True))
        nxt = nxt.select(
            "source",
            "source_size",
            "target",
            "always",
            F.when(settled, F.col("lam")).when(inside, step).otherwise((low + high) / 2).alias("lam"),
            low.alias("low"),
            high.alias("high"),
            F.when(settled, F.lit(0.0)).otherwise(F.abs("gap")).alias("off"),
        )
        before, state = state, scratch.cut(nxt, "state")
        scratch.drop(before)
        if not state.agg(F.max("off")).first()[0]:
            break
    return state.drop("off", "low", "high")


def _draw(number: Column) -> Column:
    """A number above 0 and up to 1 for the row of this number among equal ones."""
    return (F.pmod(F.xxhash64("__alike", number.cast("bigint")), F.lit(1 << 52)) + 1) / F.lit(float(1 << 52))


def _numbered(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """Equal rows with draws by their number among each other.

    They are written with the part that they stand in, and counted by parts: a row that makes up a source isn't
    ordered in one task.
    """
    rows = rows.withColumn("part", F.spark_partition_id()).withColumn("no", F.monotonically_increasing_id())
    rows = scratch.cut(rows, "equal")
    counts = rows.groupBy("__alike", "part").agg(F.count("*").alias("n"))
    earlier = W.partitionBy("__alike").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    before = counts.select("__alike", "part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    own = F.row_number().over(W.partitionBy("__alike", "part").orderBy("no")) - 1
    placed = rows.withColumn("own", own).join(before, ["__alike", "part"])
    return placed.withColumn("__u", _draw(F.col("before") + F.col("own"))).select("__row", "__source", "size", "__alike", "__u")


def mix(docs: DataFrame) -> DataFrame:
    """``docs`` with a struct behind its columns: ``size``, ``source_size``, ``target``, ``rate`` and ``copies`` (0, 1 or 2).

    The struct's name is ``__mix``, with more underscores where a column has it already.

    Copies are the rate's whole part and perhaps one more: within a source documents stand in a repeatable order of
    u / fraction, u a hash of the row, and the first ones get one more until the source's words reach its target.
    Each source ends within about one document of its target.

    Null is a source of its own, the last.  Null and empty texts have size 0 and get their copies, without words.
    Rows with equal id, source and text are numbered, so that each has a draw of its own; which of them gets more copies
    can't be told apart.  An empty table gives an empty result.  Other columns are kept as they are.
    """
    scratch = Scratch(docs.sparkSession)
    alike = F.xxhash64("doc_id", "source", "text")
    sized = docs.select(F.struct("*").alias("__row"), F.col("source").alias("__source"), size_of("text").alias("size"), alike.alias("__alike"))
    slim = scratch.cut(sized.select(F.col("__source").alias("s"), "size", "__alike"), "sizes")
    repeated = scratch.cut(slim.groupBy("__alike").agg(F.count("*").alias("n")).where("n > 1").select("__alike"), "repeated")
    numbered = _numbered(sized.join(repeated, "__alike"), scratch)
    sized = sized.join(repeated, "__alike", "left_anti").withColumn("__u", _draw(F.lit(0))).unionByName(numbered)
    slim = slim.join(repeated, "__alike", "left_anti").withColumn("__u", _draw(F.lit(0))).drop("__alike")
    slim = slim.unionByName(numbered.select(F.col("__source").alias("s"), "size", "__u")).withColumnRenamed("__u", "u")
    slim = scratch.cut(slim, "draws")
    classes = scratch.cut(slim.groupBy("s", "size").agg(F.count("*").alias("n")), "classes")
    sources = classes.groupBy(F.col("s").alias("source")).agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    solved = _solve(classes, targets(sources), scratch)

    # Fractions are rounded up in order of priority until the words that are missing are there.
    rated = slim.join(solved, slim["s"].eqNullSafe(solved["source"])).withColumn("rate", _rate())
    fraction = F.col("rate") - F.floor("rate")
    rated = rated.select(
        "s", "size", F.floor("rate").alias("whole"), F.when(fraction > 0, F.col("u") / fraction).alias("p"), "target"
    )
    sums = rated.groupBy("s").agg(
        (F.max("target") - F.sum(F.col("whole") * F.col("size"))).alias("missing"),
        F.greatest(F.lit(64), F.ceil(F.count("*") / BIN_ROWS)).alias("bins"),
    )
    waiting = rated.where("p is not null").select("s", "size", "p").alias("r")
    binned = waiting.join(sums.alias("m"), F.expr("r.s <=> m.s")).select(
        F.col("r.s").alias("s"), "size", "p", "missing", F.floor(F.log2("p") * F.col("bins")).alias("bin")
    )
    per_bin = binned.groupBy("s", "bin").agg(F.sum("size").alias("words"), F.max("missing").alias("missing"), F.max("p").alias("p"))
    upto = F.sum("words").over(W.partitionBy("s").orderBy("bin"))
    per_bin = per_bin.withColumn("upto", upto).withColumn("from", F.col("upto") - F.col("words"))
    per_bin = scratch.cut(per_bin, "bins")
    whole_bins = per_bin.where("upto <= missing").groupBy("s").agg(F.max("p").alias("cut"))
    split = per_bin.where("upto > missing and `from` < missing").select(F.col("s").alias("s2"), F.col("bin").alias("bin2"), "from")
    inside = binned.join(split, F.expr("s <=> s2 and bin = bin2"))
    run = F.sum("size").over(W.partitionBy("s", "bin").orderBy("p").rangeBetween(W.unboundedPreceding, W.currentRow)) + F.col("from")
    within = inside.withColumn("run", run).where("run - size / 2 <= missing").groupBy("s").agg(F.max("p").alias("cut"))
    cuts = whole_bins.union(within).groupBy("s").agg(F.max("cut").alias("cut"))
    plan = solved.join(cuts, F.expr("source <=> s"), "left").select(
        F.col("source").alias("__s"), "source_size", "target", "lam", "always", F.coalesce("cut", F.lit(-1.0)).alias("cut")
    )
    plan = scratch.cut(plan, "plan")

    out = sized.join(plan, F.expr("__source <=> __s")).withColumn("rate", _rate())
    whole = F.floor("rate")
    more = F.coalesce(F.col("__u") / F.when(F.col("rate") > whole, F.col("rate") - whole) <= F.col("cut"), F.lit(False))
    out = out.withColumn("copies", (whole + more.cast("int")).cast("int"))
    name = "__mix"
    while name in docs.columns:
        name += "_"
    return out.select("__row.*", F.struct("size", "source_size", "target", "rate", "copies").alias(name))


def digest(mixed: DataFrame) -> DataFrame:
    """The columns of the registered query."""
    own = F.col(mixed.columns[-1])
    return mixed.select(
        "doc_id", own["size"].alias("size"), own["source_size"].alias("source_size"), own["target"].alias("target"),
        (own["size"] * own["copies"]).cast("bigint").alias("taken"),
    )


def replicate(mixed: DataFrame) -> DataFrame:
    """Each document as often as it has copies, with the columns it had before it was mixed.

    Null and empty texts and rows without an id are repeated as any others; an empty table stays empty.
    """
    names = {f"c{i}": c for i, c in enumerate(mixed.columns[:-1])}
    plain = mixed.toDF(*names, "mix").where("mix.copies > 0")
    return plain.select(*names, F.explode(F.sequence(F.lit(1), F.col("mix.copies"))).alias("copy")).drop("copy").toDF(*names.values())
