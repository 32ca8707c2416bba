"""Parcel rules, issues, their summary, and healing.

A rule is a function from parcels to issues ``type, severity, feature_ids, message, auto_fix`` plus the
positions that order them; rules are unioned and numbered. Parcels are boxes with ``id`` and ``conf``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plotline.functions.geometry import BOX, aspect, box_area, box_perimeter, compactness, iou, iou_above, shared_area
from plotline.operators.checkpoints import checkpointed, dealt
from plotline.operators.components import connected_components
from plotline.operators.spatial_join import meeting_pairs

CELL = 25.0
OVERLAP_AREA = 0.05
DUPLICATE_IOU = 0.95
MIN_AREA, MAX_ASPECT = 4.0, 12.0


def measures(parcels: DataFrame, buildings: str | None = None) -> DataFrame:
    """Area, perimeter, compactness, centroid, aspect, and the confidence of a delineated parcel."""
    area, perimeter = box_area(), box_perimeter()
    compact = compactness(area, perimeter)
    n = F.col(buildings) if buildings else F.lit(0)
    conf = F.least(F.lit(0.95), F.greatest(F.lit(0.5), 0.7 * compact + F.when(n > 0, 0.25).otherwise(0.1)))
    return parcels.select(
        "id", F.round(area, 2).alias("area_sqm"), F.round(perimeter, 2).alias("perimeter_m"), F.round(compact, 4).alias("compactness"),
        ((F.col("x0") + F.col("x1")) / 2).alias("cx"), ((F.col("y0") + F.col("y1")) / 2).alias("cy"),
        aspect(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")).alias("aspect"), F.round(conf, 4).alias("confidence"), (conf < 0.65).alias("needs_gt"),
    )


def candidate_pairs(parcels: DataFrame, cell: float = CELL) -> DataFrame:
    """Pairs of parcels that meet, the smaller id as ``a_``; both pair rules share them."""
    return meeting_pairs(parcels, parcels, cell, F.col("a_id") < F.col("b_id"))


def overlap_pairs(pairs: DataFrame, tolerance: float = OVERLAP_AREA) -> DataFrame:
    return pairs.withColumn("shared", shared_area("a_", "b_")).where(F.col("shared") > tolerance)


def duplicate_pairs(pairs: DataFrame, threshold: float = DUPLICATE_IOU) -> DataFrame:
    return pairs.where(iou_above("a_", "b_", threshold)).withColumn("iou", iou("a_", "b_"))


def _pair_issue(pairs: DataFrame, rule: int, kind: str, message, fix: str) -> DataFrame:
    return pairs.select(
        F.lit(rule).alias("rule"), F.col("a_id").alias("first_id"), F.col("b_id").alias("second_id"), F.lit(kind).alias("type"), F.lit("error").alias("severity"),
        F.concat_ws(",", F.col("a_id").cast("string"), F.col("b_id").cast("string")).alias("feature_ids"), message.alias("message"), F.lit(fix).alias("auto_fix"),
    )


def invalid_rule(parcels: DataFrame, pairs: DataFrame) -> DataFrame:
    """Parcels without a geometry, or whose box is turned inside out."""
    missing = F.col("x0").isNull() | F.col("y0").isNull() | F.col("x1").isNull() | F.col("y1").isNull()
    broken = missing | (F.col("x1") < F.col("x0")) | (F.col("y1") < F.col("y0"))
    return parcels.where(broken).select(
        F.lit(1).alias("rule"), F.col("id").alias("first_id"), F.lit(None).cast("long").alias("second_id"), F.lit("invalid").alias("type"), F.lit("error").alias("severity"),
        F.col("id").cast("string").alias("feature_ids"), F.when(missing, "no geometry").otherwise("corners out of order").alias("message"),
        F.when(missing, "delete").otherwise("make_valid").alias("auto_fix"),
    )


def overlap_issues(found: DataFrame) -> DataFrame:
    """Issues of pairs ``a_id, b_id`` that share the area ``shared``."""
    return _pair_issue(found, 2, "overlap", F.format_string("overlap of %.2f sqm", F.round("shared", 2)), "clip_overlap")


def overlap_rule(parcels: DataFrame, pairs: DataFrame) -> DataFrame:
    return overlap_issues(overlap_pairs(pairs))


def duplicate_issues(found: DataFrame) -> DataFrame:
    """Issues of pairs ``a_id, b_id`` that are one parcel by their ``iou``."""
    return _pair_issue(found, 3, "duplicate", F.format_string("IoU %.3f", F.round("iou", 3)), "merge_duplicate")


def duplicate_rule(parcels: DataFrame, pairs: DataFrame) -> DataFrame:
    return duplicate_issues(duplicate_pairs(pairs))


def shape_rule(parcels: DataFrame, pairs: DataFrame) -> DataFrame:
    return shape_issues(parcels, box_area(), aspect(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")))


def shape_issues(parcels: DataFrame, area: Column, ratio: Column) -> DataFrame:
    """Slivers by area and needles by aspect; a parcel may be both."""
    of = lambda rule, kind, message, fix: [
        F.lit(rule).alias("rule"), F.col("id").alias("first_id"), F.lit(None).cast("long").alias("second_id"), F.lit(kind).alias("type"), F.lit("warning").alias("severity"),
        F.col("id").cast("string").alias("feature_ids"), message.alias("message"), F.lit(fix).alias("auto_fix"),
    ]
    small = parcels.where(area < MIN_AREA).select(*of(4, "sliver", F.format_string("area of %.2f sqm", F.round(area, 2)), "merge_sliver"))
    thin = parcels.where(ratio > MAX_ASPECT).select(*of(5, "shape_anomaly", F.format_string("aspect of %.1f", F.round(ratio, 1)), "review"))
    return small.unionByName(thin)


RULES: tuple[Callable[[DataFrame, DataFrame], DataFrame], ...] = (invalid_rule, overlap_rule, duplicate_rule, shape_rule)


def issues(parcels: DataFrame, rules=RULES) -> DataFrame:
    """All rules' issues, in the order of rule and parcels, with ``issue_key``.

    Ids are built from rule and parcels instead of a running number, so that no global sort is needed.
    """
    pairs = candidate_pairs(parcels)
    found = None
    for rule in rules:
        part = rule(parcels, pairs)
        found = part if found is None else found.unionByName(part)
    return keyed(found)


def keyed(found: DataFrame) -> DataFrame:
    """Issues with ``issue_key``."""
    return found.withColumn("issue_key", F.format_string("issue_%d_%05d_%05d", "rule", "first_id", F.coalesce("second_id", F.lit(0))))


def summary(parcels: DataFrame, found: DataFrame) -> DataFrame:
    """One row: totals, clean parcels and percentage, and counts by severity and type."""
    total = parcels.agg(F.count("*").alias("total_parcels"))
    affected = found.select(F.explode(F.split("feature_ids", ",")).alias("f")).agg(F.countDistinct("f").alias("affected"))
    count = lambda c, v: F.count(F.when(F.col(c) == v, 1)).alias(f"n_{v}")
    counts = found.agg(
        F.count("*").alias("total_issues"), *[count("severity", s) for s in ("error", "warning", "info")],
        *[count("type", t) for t in ("invalid", "overlap", "duplicate", "sliver", "shape_anomaly")],
    )
    clean = F.greatest(F.col("total_parcels") - F.col("affected"), F.lit(0))
    one = lambda df: df.withColumn("one", F.lit(1))
    return (
        one(total).join(one(affected), "one").join(one(counts), "one").drop("one").withColumn("clean_parcels", clean)
        .withColumn("clean_percentage", F.round(clean / F.greatest(F.col("total_parcels"), F.lit(1)) * 100, 2)).drop("affected")
    )


#: Pairs of a component of duplicates that are folded in one task at most.
FOLDED = 20_000


def _folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``id`` of the parcels that the fold over each component's pairs drops; pairs come in the order of component and ids."""
    part, first, skip, dropped = None, None, False, set()
    for batch in batches:
        done = []
        for component, a, b, keeps in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if component != part:
                done += dropped
                part, first, dropped = component, None, set()
            if a != first:
                first, skip = a, a in dropped
            if not skip and b not in dropped:
                dropped.add(b if keeps else a)
        yield pa.record_batch([pa.array(done, pa.int64())], names=["id"])
    yield pa.record_batch([pa.array(list(dropped), pa.int64())], names=["id"])


def _dropped_in_rounds(pairs: DataFrame) -> DataFrame:
    """``id`` of the parcels that the fold over ``pairs`` drops, in as many rounds as the longest chain has links.

    Whether a parcel is dropped by an earlier one depends on those before it alone: who has no undecided parcel
    before them is active, and whom an active one outranks is gone.
    """
    keeps = pairs.where("keep_a").select("a_id", "b_id")
    # The parcels still to be settled, the pairs that may settle them, and who was dropped by an earlier parcel.
    left = checkpointed(pairs.select(F.col("a_id").alias("id")).unionByName(pairs.select(F.col("b_id").alias("id"))).distinct())
    edges, gone, active = keeps, None, None
    while left.head(1):
        free = checkpointed(left.join(edges.select(F.col("b_id").alias("id")), "id", "left_anti"))
        dead = checkpointed(edges.join(free.select(F.col("id").alias("a_id")), "a_id", "left_semi").select(F.col("b_id").alias("id")).distinct())
        settled = free.unionByName(dead)
        edges = checkpointed(edges.join(settled.select(F.col("id").alias("b_id")), "b_id", "left_anti").join(settled.select(F.col("id").alias("a_id")), "a_id", "left_anti"))
        left = checkpointed(left.join(settled, "id", "left_anti"))
        active, gone = (free, dead) if active is None else (active.unionByName(free), gone.unionByName(dead))
    if active is None:
        return pairs.select(F.col("a_id").alias("id")).limit(0)
    mine = active.select(F.col("id").alias("a_id"))
    first = keeps.join(mine, "a_id", "left_semi").groupBy("b_id").agg(F.min("a_id").alias("first"))
    beaten = pairs.where("not keep_a").join(mine, "a_id", "left_semi").join(first, "b_id", "left").where(F.col("first").isNull() | (F.col("first") >= F.col("a_id")))
    return gone.unionByName(beaten.select(F.col("a_id").alias("id"))).distinct()


def heal_duplicates(parcels: DataFrame, threshold: float = DUPLICATE_IOU, folded: int = FOLDED) -> DataFrame:
    """Parcels without duplicates: of a pair the one of higher confidence stays, ties keep the first.

    Pairs are taken in the order of ids. A parcel that an earlier one has dropped takes no pair of its own;
    else it drops each later parcel that it outranks, and is dropped itself by one that outranks it and
    that no earlier parcel has dropped. Parcels that pairs link, directly or not, are one component; those of up to
    ``folded`` pairs are streamed by tasks and folded one after another, the others in rounds over all of them.
    """
    pairs = duplicate_pairs(candidate_pairs(parcels), threshold).select("a_id", "b_id", (F.col("a_conf") >= F.col("b_conf")).alias("keep_a"))
    return parcels.join(dropped_duplicates(pairs, folded), "id", "left_anti")


def dropped_duplicates(pairs: DataFrame, folded: int = FOLDED) -> DataFrame:
    """``id`` of the parcels that the fold over duplicates ``a_id, b_id, keep_a`` drops, as in ``heal_duplicates``."""
    pairs = checkpointed(pairs)
    parts = connected_components(pairs.select(F.col("a_id").alias("src"), F.col("b_id").alias("dst"))).select(F.col("node").alias("a_id"), "component")
    placed = pairs.join(parts, "a_id")
    sizes = checkpointed(placed.groupBy("component").agg(F.count("*").alias("n")))
    small = dealt(placed.join(sizes.where(F.col("n") <= folded), "component").select("component", "a_id", "b_id", "keep_a"), "component")
    dropped = small.sortWithinPartitions("component", "a_id", "b_id").mapInArrow(_folded, "id long")
    large = sizes.where(F.col("n") > folded)
    if large.head(1):
        dropped = dropped.unionByName(_dropped_in_rounds(checkpointed(placed.join(large, "component").select("a_id", "b_id", "keep_a"))))
    return dropped.distinct()


def clipped_overlaps(parcels: DataFrame, tolerance: float = OVERLAP_AREA) -> DataFrame:
    """``parcels`` with ``pieces`` (boxes), ``area`` and ``clips``: overlaps cut out of the parcel of lower confidence.

    Of an overlapping pair the one of higher confidence keeps the overlap, ties go to the smaller id; so all
    parcels have one order of priority and what a parcel keeps is its box less all overlaps with those above
    it, in whatever order pairs are taken. A parcel that would keep nothing stays as it is. Overlaps up to
    ``tolerance`` stay. The rest is cut into cells by the overlaps' borders, within the parcel's row, which
    holds one box per overlap.
    """
    pairs = overlap_pairs(candidate_pairs(parcels), tolerance)
    first = F.col("a_conf") >= F.col("b_conf")
    box = F.struct(*[F.greatest(f"a_{c}", f"b_{c}").alias(c) if c[1] == "0" else F.least(f"a_{c}", f"b_{c}").alias(c) for c in BOX])
    cuts = pairs.select(F.when(first, F.col("b_id")).otherwise(F.col("a_id")).alias("id"), box.alias("cut")).groupBy("id").agg(F.collect_list("cut").alias("cuts"))
    stops = lambda low, high: F.array_sort(F.array_distinct(F.concat(F.array(low, high), F.transform("cuts", lambda c: c[low]), F.transform("cuts", lambda c: c[high]))))
    spans = lambda s: F.zip_with(F.slice(s, 1, F.size(s) - 1), F.slice(s, 2, F.size(s) - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    cell = lambda x, y: F.struct(x["a"].alias("x0"), y["a"].alias("y0"), x["b"].alias("x1"), y["b"].alias("y1"))
    cells = F.flatten(F.transform(spans(F.col("xs")), lambda x: F.transform(spans(F.col("ys")), lambda y: cell(x, y))))
    covered = lambda p: F.exists("cuts", lambda c: (c["x0"] <= p["x0"]) & (c["y0"] <= p["y0"]) & (c["x1"] >= p["x1"]) & (c["y1"] >= p["y1"]))
    whole = F.array(F.struct(*[F.col(c) for c in BOX]))
    joined = parcels.join(cuts, "id", "left").withColumn("xs", F.when(F.col("cuts").isNotNull(), stops("x0", "x1"))).withColumn("ys", F.when(F.col("cuts").isNotNull(), stops("y0", "y1")))
    left = F.filter(cells, lambda p: ~covered(p))
    made = joined.withColumn("pieces", F.when(F.col("cuts").isNull(), whole).otherwise(left))
    made = made.withColumn("pieces", F.when(F.size("pieces") == 0, whole).otherwise(F.col("pieces")))
    area = F.aggregate("pieces", F.lit(0.0), lambda s, p: s + (p["x1"] - p["x0"]) * (p["y1"] - p["y0"]))
    return made.select(*parcels.columns, "pieces", area.alias("area"), F.when(F.col("cuts").isNull(), 0).otherwise(F.size("cuts")).cast("long").alias("clips"))


def marked_slivers(parcels: DataFrame, sliver_area: float = 15.0, sliver_compactness: float = 0.05) -> DataFrame:
    area = box_area()
    return parcels.withColumn("sliver", (area < sliver_area) | (compactness(area, box_perimeter()) < sliver_compactness))


def sliver_pairs(marked: DataFrame) -> DataFrame:
    """Slivers ``a_`` with each face ``b_`` that they share a ``border`` with."""
    pairs = meeting_pairs(marked.where("sliver"), marked.where("not sliver"), CELL)
    clamp = lambda low, high: F.greatest(F.least(*high) - F.greatest(*low), F.lit(0.0))
    width = clamp((F.col("a_x0"), F.col("b_x0")), (F.col("a_x1"), F.col("b_x1")))
    height = clamp((F.col("a_y0"), F.col("b_y0")), (F.col("a_y1"), F.col("b_y1")))
    # A touching edge counts once; an overlap counts by the length of its outline.
    border = F.when((width > 0) & (height > 0), 2.0 * (width + height)).otherwise(width + height)
    return pairs.withColumn("border", border).where("border > 0")


def sliver_neighbours(parcels: DataFrame, sliver_area: float = 15.0, sliver_compactness: float = 0.05) -> DataFrame:
    """Slivers with the neighbour that shares most of their border: ``id, neighbour, shared_border``."""
    return (
        sliver_pairs(marked_slivers(parcels, sliver_area, sliver_compactness))
        .groupBy(F.col("a_id").alias("id")).agg(F.max(F.struct("border", (-F.col("b_id")).alias("n"))).alias("best"))
        .select("id", (-F.col("best.n")).alias("neighbour"), F.col("best.border").alias("shared_border"))
    )


def worklist(parcels: DataFrame, threshold: float = 0.65) -> DataFrame:
    """Parcels to verify in the field, or all if there are none; absent values count as false."""
    doubt = F.coalesce(F.col("conf") < threshold, F.lit(False)) | F.coalesce(F.col("needs_gt"), F.lit(False)) | F.coalesce(F.col("status") == "disputed", F.lit(False))
    marked = parcels.withColumn("doubt", doubt)
    some = marked.agg(F.max("doubt").alias("some")).withColumn("one", F.lit(1))
    listed = marked.withColumn("one", F.lit(1)).join(F.broadcast(some), "one").where(F.col("doubt") | ~F.coalesce("some", F.lit(False)))
    return listed.drop("one", "some", "doubt").withColumns(
        {"surveyor_name": F.lit(""), "field_verdict": F.lit("pending"), "boundary_notes": F.lit(""), "inspection_date": F.lit("")}
    )


def or_existing(found: DataFrame, existing: DataFrame) -> DataFrame:
    """The parcels found, or where there are none the existing ones, as such: confidence 0.85, status auto."""
    some = found.agg((F.count("*") == 0).alias("none")).withColumn("one", F.lit(1))
    spare = existing.withColumn("conf", F.lit(0.85)).withColumn("one", F.lit(1)).join(F.broadcast(some), "one").where("none").drop("one", "none")
    mark = lambda df, source: df.withColumn("source", F.lit(source)).withColumn("status", F.lit("auto"))
    return mark(found, "ai").unionByName(mark(spare.select(*found.columns), "existing"))
