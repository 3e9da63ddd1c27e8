"""Mixing sources to target weights as a time-varying curriculum. DataFrame functions only.

Targets: the sources, by code point with null last, get the weights in turn; together they get as many words as all
texts have. No source gets more than ``cap`` times its words; what is over goes to the others by weight. That is
target = min(cap * size, level * weight) with one level for all, found from running sums over the sources.

Inside a source the texts are put in the order of a hash of their id and text. The mix walks this order again and again until the
target is reached, so a text is taken ``floor(target / size of source)`` times, and those before the cut once more.

Curriculum: each weight has a schedule, a multiplier over training time given by knots and linear between them. Its
integral is the source's cumulative demand; inverting it at the words that come before a text gives the text's training
position in [0, 1). Documents are range-sorted by position.

Running sums over a source are made in two levels: sums of (source, bucket of the hash), then inside a bucket. A source
has a bucket for about ``bucket_rows`` of its rows, so one with a third of all rows is spread over many. The plan has a
row for each source and bucket, and rows and texts meet it on both, so no join brings a whole source into one task.
``mix_report`` inverts the demand at the exact word; ``mix_documents`` does so to within a bucket, whose words it takes
as spread evenly over its hashes, so that texts meet the plan only and are shuffled once.

Defined cases: null and empty texts have size 0, are never taken and take no part in the order, since any number of them
may share a place; sources that are null form one source, last; a
source of size 0 has target 0; repeated rows each count and share one place in the order; an empty table gives an empty
mix; other columns pass through ``mix_documents``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import WORD_REGEX, materialise, shared_dir

WEIGHTS = (5, 2, 1)
CAP = 3
BUCKET_ROWS = 2_000
#: For each weight: knots (training time, multiplier), linear between.
SCHEDULES = (
    ((0.0, 1.5), (0.5, 1.0), (1.0, 0.5)),
    ((0.0, 1.0), (1.0, 1.0)),
    ((0.0, 0.5), (0.5, 1.0), (1.0, 1.5)),
)


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD_REGEX)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """source, source_size, weight_no, target from rows of (source, size). One row a source."""
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    named = Window.orderBy(F.col("source").asc_nulls_last())
    no = (F.row_number().over(named) - 1) % len(weights)
    weight = F.element_at(F.array(*[F.lit(w).cast("long") for w in weights]), F.col("weight_no") + 1)
    rated = per.withColumn("weight_no", no.cast("int")).withColumn("weight", weight).withColumn("most", F.col("source_size") * cap)
    filled = Window.orderBy((F.col("most") / F.col("weight")), "weight_no", F.col("source").asc_nulls_last())
    before = F.coalesce(F.sum("most").over(filled.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    from_here = F.sum("weight").over(filled.rowsBetween(0, Window.unboundedFollowing))
    total = F.sum("source_size").over(Window.partitionBy())
    # the level, if just the sources before this one are full; it is highest at the first that is not
    levels = rated.withColumn("if_full", (total - before).cast("double") / from_here.cast("double"))
    return levels.withColumn("level", F.max("if_full").over(Window.partitionBy())).select(
        "source", "source_size", "weight_no", F.least(F.col("most").cast("double"), F.col("level") * F.col("weight")).alias("target")
    )


def _place(doc_id: Column, text: Column) -> Column:
    return F.xxhash64(doc_id, F.xxhash64(text), F.lit("mix"))


def _bucket(place: Column, buckets: Column) -> Column:
    """Buckets follow each other as places do."""
    return F.floor((F.shiftright(place, 33) + (1 << 30)) * buckets / (1 << 31)).cast("int")


def _bucketed(rows: DataFrame, source: Column, place: Column, counts: DataFrame) -> DataFrame:
    """rows with _bucket and _buckets, the number of its source's buckets. counts: _source, _buckets, a row a source."""
    joined = rows.join(counts, source.eqNullSafe(F.col("_source"))).drop("_source")
    return joined.withColumn("_bucket", _bucket(place, F.col("_buckets")))


def _planned(sizes: DataFrame, folder: str, counts: DataFrame, weights: tuple[int, ...], cap: int) -> tuple[DataFrame, DataFrame]:
    """Rows with the words of their source before them, and the plan: for each source (_s) and bucket (_b) the words before
    it and in it, with the source's size, target, whole turns and the cut of the last one."""
    placed = _bucketed(sizes, F.col("source"), F.col("place"), counts).withColumnRenamed("_bucket", "bucket").drop("_buckets")
    sums = materialise(placed.groupBy("source", "bucket").agg(F.sum("size").alias("words")), f"{folder}/sums")
    by_source = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(F.col("source").alias("_s"), F.col("bucket").alias("_b"), F.coalesce(F.sum("words").over(by_source), F.lit(0)).alias("bucket_start"), "words")
    targets = source_targets(sums.select("source", F.col("words").alias("size")), weights, cap).withColumn("mixed", F.floor("target").cast("long"))
    turns = F.when(F.col("source_size") > 0, F.expr("mixed div source_size")).otherwise(F.lit(0)).cast("long")
    sources = targets.withColumn("turns", turns).withColumn("cut", F.col("mixed") - F.col("turns") * F.col("source_size"))
    plan = materialise(starts.join(sources, F.col("_s").eqNullSafe(F.col("source"))).drop("source"), f"{folder}/plan")
    own = Window.partitionBy("source", "bucket").orderBy("place", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    inside = placed.filter("size > 0").withColumn("inside", F.coalesce(F.sum("size").over(own), F.lit(0)))
    inside = inside.unionByName(placed.filter("size = 0").withColumn("inside", F.lit(0).cast("long")))  # any number of these may share a place
    rows = inside.join(plan, F.col("source").eqNullSafe(F.col("_s")) & (F.col("bucket") == F.col("_b")))
    return rows.withColumn("start", F.col("bucket_start") + F.col("inside")), plan


def position(done: Column, total: Column, weight_no: Column, schedules=SCHEDULES) -> Column:
    """Training time at which a source has given ``done`` of its ``total`` words: its demand's inverse, in closed form."""
    out = F.lit(None).cast("double")
    for no, knots in enumerate(schedules):
        pieces, sum_ = [], 0.0
        for (t0, m0), (t1, m1) in zip(knots, knots[1:]):
            pieces.append((sum_, t0, m0, (m1 - m0) / (t1 - t0)))
            sum_ += (m0 + m1) / 2 * (t1 - t0)
        demand = done / total * F.lit(sum_)
        own = None
        for c0, t0, m0, slope in pieces:
            d = F.greatest(demand - F.lit(c0), F.lit(0.0))
            root = F.sqrt(F.greatest(F.lit(m0 * m0) + F.lit(2 * slope) * d, F.lit(0.0)))
            at = F.lit(t0) + 2 * d / (F.lit(m0) + root)
            own = at if own is None else F.when(demand >= F.lit(c0), at).otherwise(own)
        out = F.when(weight_no == no, own).otherwise(out)
    return out


def _sizes(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), size_of(F.col("text")).alias("size"), _place(F.col("doc_id").cast("long"), F.col("text").cast("string")).alias("place"))


def _counts(sizes: DataFrame, folder: str, bucket_rows: int) -> DataFrame:
    """_source and the number of its buckets: a row a source, written so that its size is known where it is joined."""
    counted = sizes.groupBy(F.col("source").alias("_source")).agg(F.ceil(F.count("*") / bucket_rows).cast("long").alias("_buckets"))
    return materialise(counted, f"{folder}/counts")


def mix_report(docs: DataFrame, weights=WEIGHTS, cap: int = CAP, schedules=SCHEDULES, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """A row for each document: size, its source's size and target, words taken, first position; sorted by position."""
    folder = shared_dir(docs.sparkSession)
    sizes = materialise(_sizes(docs), f"{folder}/sizes")
    rows, _ = _planned(sizes, folder, _counts(sizes, folder, bucket_rows), weights, cap)
    taken = F.col("turns") * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), F.col("cut") - F.col("start")))
    at = F.when(F.col("taken") > 0, position(F.col("start").cast("double"), F.col("mixed").cast("double"), F.col("weight_no"), schedules))
    out = rows.withColumn("taken", taken.cast("long")).withColumn("position", at)
    # texts that are not taken have no position; they follow, spread evenly
    order = F.coalesce("position", 2 + F.xxhash64("place", F.monotonically_increasing_id()) / F.lit(float(1 << 63)))
    ranged = out.withColumn("order", order).repartitionByRange("order").sortWithinPartitions("order")
    return ranged.select("doc_id", "size", "source_size", "target", "taken", "position")


def mix_documents(docs: DataFrame, weights=WEIGHTS, cap: int = CAP, schedules=SCHEDULES, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """The mix itself: a row for each taken copy, all columns of docs, range-sorted by training position.

    Whole texts only: the text at a source's cut is taken once more if at least half of it lies before the cut. The plan
    is made on ids and sizes; the texts meet only a table of one row a source and bucket."""
    folder = shared_dir(docs.sparkSession)
    sizes = materialise(_sizes(docs), f"{folder}/sizes")
    counts = _counts(sizes, folder, bucket_rows)
    rows, plan = _planned(sizes, folder, counts, weights, cap)
    before = rows.filter((2 * (F.col("cut") - F.col("start")) >= F.col("size")) & (F.col("size") > 0) & (F.col("start") < F.col("cut")))
    last = before.groupBy(F.col("source").alias("_l")).agg(F.max(F.struct("place", F.coalesce("doc_id", F.lit(-(1 << 63))).alias("id"))).alias("last"))
    table = plan.join(last, F.col("_s").eqNullSafe(F.col("_l")), "left").drop("_l")
    table = table.select("_s", "_b", F.struct(*[c for c in table.columns if c not in ("_s", "_b")]).alias("_plan"))
    table = materialise(table, f"{folder}/table")
    # the row as one column, so that no name of its own can clash
    worded = docs.filter(F.rlike(F.col("text").cast("string"), F.lit(WORD_REGEX)))  # others are never taken
    packed = worded.select(F.struct("*").alias("_row"), _place(F.col("doc_id").cast("long"), F.col("text").cast("string")).alias("_place"))
    source, place, buckets = F.col("_row.source").cast("string"), F.col("_place"), F.col("_buckets")
    joined = _bucketed(packed, source, place, counts).join(table, source.eqNullSafe(F.col("_s")) & (F.col("_bucket") == F.col("_b")))
    key = F.struct(place.alias("place"), F.coalesce(F.col("_row.doc_id").cast("long"), F.lit(-(1 << 63))).alias("id"))
    once_more = F.coalesce(key <= F.col("_plan.last"), F.lit(False)).cast("long")
    copies = F.when(size_of(F.col("_row.text").cast("string")) > 0, F.col("_plan.turns") + once_more).otherwise(F.lit(0))
    # words before the text, to within its bucket: a bucket's words are spread evenly over its hashes
    share = (F.shiftright(place, 16).cast("double") / (1 << 48) + 0.5) * buckets - F.col("_bucket")
    start = F.col("_plan.bucket_start") + share * F.col("_plan.words")
    dealt = joined.withColumn("_copies", copies.cast("int")).filter("_copies > 0").withColumn("_copy", F.explode(F.sequence(F.lit(0), F.col("_copies") - 1)))
    done = start + F.col("_copy") * F.col("_plan.source_size")
    placed = dealt.withColumn("_position", position(F.least(done, F.col("_plan.mixed").cast("double")), F.col("_plan.mixed").cast("double"), F.col("_plan.weight_no"), schedules))
    return placed.repartitionByRange("_position").sortWithinPartitions("_position").select("_row.*")
