"""Mixing sources to target weights by entropy balancing, in DataFrame operations only.

Each source has a token target T. Among document rates r in (0, cap) that meet
sum(size * r) = T, the one of least relative entropy to the uniform rate is the
exponentially tilted r = cap / (1 + exp(-lambda * size / scale)): the cap turns
the plain exponential into a logistic one. lambda solves the convex dual, one
unknown per source, by Newton steps kept inside a bracket; a step is one
aggregation over all sources at once. Documents of one source and size have one
rate, so the steps run on (source, size, count) rows, an exact summary.

Rates become whole copies by error diffusion along the sizes of a source: the
copies of the first k size classes are the rounded sum of their rates, so a
source's words miss the target by less than one document per class step, and
within a class the copies are dealt by a hash of the document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, numbered, text_of

#: A word is a run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: A size class of more documents is ranked in parts of about this many.
RANKED = 512
#: |lambda| beyond this gives every document of positive size a rate of 0 or cap.
STEEPEST = 745.0


def word_count(text: Column) -> Column:
    """Number of words: white-space runs become one blank each, and the blanks are counted,
    so no array of words is built for a long text."""
    squeezed = F.trim(F.regexp_replace(text, r"[\x20\x09-\x0D]+", " "))
    return F.when(squeezed == "", F.lit(0)).otherwise(F.length(squeezed) - F.length(F.translate(squeezed, " ", "")) + 1).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...], share: float, cap: float) -> DataFrame:
    """(source, source_size, target) from (source, size, n).

    `share` times all sizes is split by the weights, which repeat along the
    sources in code-point order, null last. A target stops at `cap` times the
    source's size and the excess goes to the others by weight: the level t with
    sum(min(weight * t, cap * size)) = share * total. One row per source meets
    in one task here; documents do not.
    """
    per = sizes.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("k") % len(weights) + 1).cast("int"))
    ranked = per.withColumn("k", F.row_number().over(order) - 1).withColumn("weight", weight)
    ranked = ranked.withColumn("most", F.lit(cap) * F.col("source_size")).withColumn("ratio", F.col("most") / F.col("weight"))
    fill = Window.orderBy("ratio", "k")
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    level = ranked.select(
        "*",
        F.coalesce(F.sum("most").over(before), F.lit(0.0)).alias("full"),
        (F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))).alias("rest"),
        (F.sum("source_size").over(whole) * F.lit(share)).alias("budget"),
    )
    # The first source, by ratio, that the level does not fill sets the level for all after it.
    level = level.withColumn("t", F.when((F.col("budget") - F.col("full")) / F.col("rest") <= F.col("ratio"), (F.col("budget") - F.col("full")) / F.col("rest")))
    level = level.withColumn("t", F.first("t", ignorenulls=True).over(fill.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    target = F.least(F.coalesce(F.col("weight") * F.col("t"), F.col("most")), F.col("most"))
    return level.select("source", "source_size", target.alias("target"))


def _rate(cap: float) -> Column:
    return F.lit(cap) / (1 + F.exp(-F.col("lam") * F.col("size") / F.col("scale")))


def balance(sizes: DataFrame, goals: DataFrame, cap: float, *, rounds: int = 60, tolerance: float = 1e-9) -> DataFrame:
    """Solve the dual: (source, scale, lam) for all sources of positive size.

    `lam` is +-STEEPEST where the target is `cap` times the size or nothing. Every
    round is one distributed aggregation; the bracket halves where Newton would leave it.
    """
    scale = sizes.groupBy("source").agg((F.sum(F.col("size") * F.col("n")) / F.sum("n")).alias("scale"))
    live = goals.alias("g").join(scale.alias("s"), F.col("g.source").eqNullSafe(F.col("s.source"))).select("g.source", "source_size", "target", "scale")
    live = live.filter("source_size > 0")
    state = live.select(
        "source",
        "scale",
        "target",
        F.lit(0.0).alias("lam"),
        F.lit(-STEEPEST).alias("lo"),
        F.lit(STEEPEST).alias("hi"),
        ((F.col("target") <= 0) | (F.col("target") >= F.lit(cap) * F.col("source_size"))).alias("done"),
    )
    state = state.withColumn("lam", F.when(F.col("target") <= 0, -STEEPEST).when(F.col("done"), STEEPEST).otherwise(0.0))
    state = materialise(state, "mix-state")
    fixed, moving = state.filter("done"), state.filter("not done")
    rate = _rate(cap)
    for _ in range(rounds):
        # Broadcast only where Spark's size check allows it; a merge join otherwise.
        seen = sizes.alias("z").join(moving.alias("m"), F.col("z.source").eqNullSafe(F.col("m.source"))).select("m.*", "z.size", "z.n")
        seen = seen.withColumn("r", rate)
        mass = F.col("n") * F.col("size")
        step = seen.groupBy("source").agg(
            *[F.first(c).alias(c) for c in ("scale", "target", "lam", "lo", "hi")],
            F.sum(mass * F.col("r")).alias("got"),
            F.sum(mass * F.col("size") / F.col("scale") * F.col("r") * (1 - F.col("r") / F.lit(cap))).alias("slope"),
        )
        over = F.col("got") > F.col("target")
        step = step.withColumn("lo", F.when(over, F.col("lo")).otherwise(F.col("lam"))).withColumn("hi", F.when(over, F.col("lam")).otherwise(F.col("hi")))
        newton = F.col("lam") + F.when(F.col("slope") > 0, (F.col("target") - F.col("got")) / F.col("slope"))
        middle = (F.col("lo") + F.col("hi")) / 2
        step = step.withColumn("done", (F.abs(F.col("got") - F.col("target")) <= F.lit(tolerance) * F.col("target")) | (F.col("hi") - F.col("lo") <= 1e-13))
        step = step.withColumn("lam", F.when(F.col("done"), F.col("lam")).when((newton > F.col("lo")) & (newton < F.col("hi")), newton).otherwise(middle))
        step = materialise(step.select("source", "scale", "target", "lam", "lo", "hi", "done"), "mix-state")
        fixed, moving = fixed.unionByName(step.filter("done")), step.filter("not done")
        if moving.isEmpty():
            break
    return fixed.unionByName(moving).select("source", "scale", "lam")


def mix(docs: DataFrame, *, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, cap: int = 2, row: str | None = None) -> DataFrame:
    """(row, doc_id, size, source_size, target, copies) for every row of `docs`.

    Sizes are words of the whole text; a null text has none, an empty one none,
    and such rows keep the copies of a rate of cap / 2. Null sources are one
    source, last in order. Repeated rows are mixed as rows of their own. Ties are broken by
    doc_id, then by a hash of the text, so only rows alike in both are interchangeable and
    neither a rerun nor another layout of the files changes the texts that are taken.
    `row` names a number column of `docs`; without it one is added.
    An empty table gives no row. Other columns play no part.
    """
    if row is None:
        docs, row = numbered(docs.select("doc_id", "text", "source"), "row_"), "row_"
    narrow = docs.select(
        docs[row].alias("row"),
        docs["doc_id"].alias("doc_id"),
        docs["source"].cast("string").alias("source"),
        word_count(text_of("text")).alias("size"),
        F.xxhash64(docs["text"]).alias("mark"),
    )
    narrow = materialise(narrow, "mix-docs")
    sizes = materialise(narrow.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n")), "mix-sizes")
    goals = materialise(targets(sizes, weights, share, cap), "mix-goals")
    solved = balance(sizes, goals, float(cap))

    classes = sizes.alias("z").join(goals.alias("g"), F.col("z.source").eqNullSafe(F.col("g.source"))).select("z.*", "source_size", "target")
    classes = classes.alias("c").join(solved.alias("s"), F.col("c.source").eqNullSafe(F.col("s.source")), "left").select("c.*", "scale", "lam")
    expected = F.col("n") * F.when((F.col("size") == 0) | F.col("lam").isNull(), F.lit(cap / 2)).when(F.col("lam") >= STEEPEST, F.lit(float(cap))).when(F.col("lam") <= -STEEPEST, F.lit(0.0)).otherwise(_rate(float(cap)))
    along = Window.partitionBy("source").orderBy("size")
    classes = classes.withColumn("expected", expected).withColumn("upto", F.sum("expected").over(along.rowsBetween(Window.unboundedPreceding, 0)))
    copies = F.round(F.col("upto") - F.lit(1e-9)) - F.round(F.greatest(F.col("upto") - F.col("expected") - F.lit(1e-9), F.lit(0.0)))
    classes = classes.withColumn("copies", F.least(F.greatest(copies, F.lit(0.0)), F.lit(cap) * F.col("n")).cast("long"))
    classes = classes.select(
        "source", "size", "n", "source_size", "target",
        F.expr("copies div n").alias("base"),
        (F.col("copies") % F.col("n")).alias("extra"),
        F.ceil(F.col("n") / RANKED).alias("parts"),
    )
    classes = materialise(classes, "mix-classes")

    dealt = narrow.alias("d").join(classes.alias("c"), F.col("d.source").eqNullSafe(F.col("c.source")) & (F.col("d.size") == F.col("c.size")))
    dealt = dealt.select("row", "doc_id", "d.source", "d.size", "source_size", "target", "base", "extra", "n", "parts", "mark", F.xxhash64("doc_id").alias("draw"))
    # The smaller of the two sides (one copy more, or not) is dealt over the parts of a class.
    few = F.least(F.col("extra"), F.col("n") - F.col("extra"))
    dealt = materialise(dealt.withColumn("part", F.pmod("draw", "parts")).withColumn("few", few), "mix-dealt")
    large = dealt.filter("parts > 1")
    counts = large.groupBy("source", "size", "part").agg(F.count(F.lit(1)).alias("m"), F.first("few").alias("few"), F.first("n").alias("n"))
    upto = F.sum("m").over(Window.partitionBy("source", "size").orderBy("part").rowsBetween(Window.unboundedPreceding, 0))
    counts = counts.withColumn("upto", upto).withColumn("quota", F.expr("few * upto div n - few * (upto - m) div n"))
    same = F.col("d.source").eqNullSafe(F.col("q.source")) & (F.col("d.size") == F.col("q.size")) & (F.col("d.part") == F.col("q.part"))
    large = large.alias("d").join(counts.alias("q"), same).select("d.*", "quota")
    dealt = dealt.filter("parts = 1").withColumn("quota", F.col("few")).unionByName(large)
    rank = F.row_number().over(Window.partitionBy("source", "size", "part").orderBy("draw", "doc_id", "mark", "row"))
    picked = rank <= F.col("quota")
    more = F.when(F.col("extra") * 2 <= F.col("n"), picked).otherwise(~picked)
    return dealt.select("row", "doc_id", "size", "source_size", "target", (F.col("base") + more.cast("long")).alias("copies"))
