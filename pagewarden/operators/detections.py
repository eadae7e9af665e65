"""Detection tables: post-processing, suppression, matching to truth, scores, and variant comparison.

Boxes are columns x, y, width, height. Joins of boxes are on cells of a grid of their image, so that an image
of very many boxes is no product with itself and no one task's. Folds that depend on order run over one
image's boxes as an array where they are few; suppression of many goes by rounds.
"""

from __future__ import annotations

import functools
import tempfile

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagewarden.functions import boxes as B
from pagewarden.functions import values as V

THRESHOLDS = (0.25, 0.35, 0.5, 0.6, 0.7)
_XYWH = ("x", "y", "width", "height")


def a_box(prefix: str = "") -> Column:
    return B.box(*(F.col(f"{prefix}{k}") for k in _XYWH))


#: Side of a grid's cells in pixels: some boxes wide. cell_side() chooses one from a table's boxes.
CELL = 128.0
#: Boxes of an image and class that are folded as one array; more are suppressed by rounds.
DENSE = 2000


def cell_side(boxes: DataFrame) -> float:
    """The power of two at or over most boxes' (nine in ten) longer side, from 16 to 4096; one pass over the table."""
    size = boxes.agg(F.percentile_approx(F.greatest("width", "height"), 0.9)).first()[0] or CELL
    side = 16.0
    while side < min(size, 4096):
        side *= 2
    return side


def _cell(at: Column, side: float) -> Column:
    return F.floor(at / F.lit(side))


def in_cells(boxes: DataFrame, side: float, cell: str = "cell") -> DataFrame:
    """A row for each grid cell that a box touches, edges included; boxes without a place or a size have none."""
    span = lambda a, n: F.sequence(_cell(F.col(a), side), _cell(F.col(a) + F.greatest(F.col(n), F.lit(0.0)), side))
    whole = boxes.where("x IS NOT NULL AND y IS NOT NULL AND width IS NOT NULL AND height IS NOT NULL")
    return whole.withColumn(f"{cell}_x", F.explode(span("x", "width"))).withColumn(f"{cell}_y", F.explode(span("y", "height")))


def _checkpointed(df: DataFrame) -> DataFrame:
    """Lineage ends in the session's checkpoint folder; a local session without one gets a temporary folder."""
    context = df.sparkSession.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        root = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not root and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        context.setCheckpointDir(root or tempfile.mkdtemp(prefix="spark-"))
    return df.checkpoint()


def _suppress_by_rounds(dets: DataFrame, iou_threshold: float, by: tuple[str, ...], side: float) -> DataFrame:
    """The same for groups of any size: each round keeps what no undecided better box overlaps, and drops what that overlaps."""
    boxes = in_cells(dets.select(*by, "idx", "conf", *_XYWH), side)
    keys = [*by, "cell_x", "cell_y"]
    one = boxes.select(*keys, F.struct("conf", "idx").alias("a"), a_box().alias("ab"))
    two = boxes.select(*keys, F.struct("conf", "idx").alias("b"), a_box().alias("bb"))
    better = (F.col("a.conf") > F.col("b.conf")) | ((F.col("a.conf") == F.col("b.conf")) & (F.col("a.idx") < F.col("b.idx")))
    # A pair is told in the cell of its overlap's corner only.
    corner = (_cell(F.greatest(F.col("ab.x"), F.col("bb.x")), side) == F.col("cell_x")) & (_cell(F.greatest(F.col("ab.y"), F.col("bb.y")), side) == F.col("cell_y"))
    pairs = one.join(two, keys).where(better & corner & (B.iou(F.col("ab"), F.col("bb")) > iou_threshold))
    edges = _checkpointed(pairs.select(*by, F.col("a.idx").alias("win"), F.col("b.idx").alias("lose")))
    open_ = _checkpointed(dets.select(*by, "idx"))
    kept = None
    while not open_.isEmpty():
        losers = edges.select(*by, F.col("lose").alias("idx")).distinct()
        now = _checkpointed(open_.join(losers, [*by, "idx"], "left_anti"))
        beaten = _checkpointed(edges.join(now.withColumnRenamed("idx", "win"), [*by, "win"], "left_semi").select(*by, F.col("lose").alias("idx")).distinct())
        kept = now if kept is None else kept.unionByName(now)
        gone = now.unionByName(beaten)
        open_ = _checkpointed(open_.join(gone, [*by, "idx"], "left_anti"))
        edges = edges.join(gone.withColumnRenamed("idx", "win"), [*by, "win"], "left_anti").join(beaten.withColumnRenamed("idx", "lose"), [*by, "lose"], "left_anti")
        edges = _checkpointed(edges)
    return dets.select(*by, "idx", "conf", *_XYWH).where("false") if kept is None else dets.select(*by, "idx", "conf", *_XYWH).join(kept, [*by, "idx"])


def suppress_dense(dets: DataFrame, iou_threshold: float, most: int, by: tuple[str, ...] = ("image_id", "cls"), side: float = CELL, dense: int = DENSE) -> DataFrame:
    """suppress() for tables where an image may hold any number of boxes (idx tells a group's boxes apart).

    Groups of over ``dense`` boxes are suppressed by rounds over pairs that share a cell; the others as arrays. Of what
    a group keeps, the ``most`` most confident stay, which is what stopping there amounts to.
    """
    counts = dets.groupBy(*by).agg(F.count("*").alias("_n"))
    many = _checkpointed(counts.where(F.col("_n") > dense).drop("_n"))
    few = suppress(dets.join(many, list(by), "left_anti"), iou_threshold, most, by)
    left = _suppress_by_rounds(dets.join(many, list(by), "left_semi"), iou_threshold, by, side)
    # Only boxes among a group's most confident kept ones stay: a bounded number, found without sorting whole groups in one task.
    ranked = left.withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("conf"), "idx"))).where(F.col("_r") <= most).drop("_r")
    return few.unionByName(ranked.select(*few.columns))


def suppress(dets: DataFrame, iou_threshold: float, most: int, by: tuple[str, ...] = ("image_id", "cls")) -> DataFrame:
    """Greedy suppression within each image and class: of overlapping boxes the most confident stays.

    ``dets`` has the columns of ``by``, idx, conf and the box. A box is kept when its IoU with every
    kept box is at most the threshold, until ``most`` are kept; equal confidences go by idx.
    """
    entry = F.struct((-F.col("conf")).alias("order"), F.col("idx"), F.col("conf"), *_XYWH)
    ranked = F.sort_array(F.collect_list(entry))
    kind = "array<struct<order:double,idx:int,conf:double,x:double,y:double,width:double,height:double>>"

    def keep(kept: Column, d: Column) -> Column:
        clash = F.exists(kept, lambda k: B.iou(k, d) > iou_threshold)
        return F.when((F.size(kept) < most) & ~clash, F.concat(kept, F.array(d))).otherwise(kept)

    kept = dets.groupBy(*by).agg(ranked.cast(kind).alias("d")).select(*by, F.explode(F.aggregate("d", F.array().cast(kind), keep)).alias("d"))
    return kept.select(*by, "d.idx", "d.conf", *(f"d.{k}" for k in _XYWH))


def match(dets: DataFrame, truth: DataFrame, iou_threshold: float = 0.5) -> DataFrame:
    """(image_id, cls, idx, id, iou): each detection's truth box, one to one.

    Most confident detections choose first (then smaller idx); each takes the free truth box of its
    class with the largest IoU of at least the threshold, of equals the last.
    """
    return _matched(dets, truth, iou_threshold).drop("conf")


def _matched(dets: DataFrame, truth: DataFrame, iou_threshold: float) -> DataFrame:
    """match() with each detection's conf. Both tables are grouped together and not joined: tables that are dealt by image stay where they are."""
    there = F.col("image_id").isNotNull() & F.col("cls").isNotNull()  # told in the lists: a filter would make the scans differ from a caller's own
    d = dets.select("image_id", "cls", F.struct("idx", "conf", a_box().alias("box")).alias("d"))
    t = truth.select("image_id", "cls", F.struct("id", a_box().alias("box")).alias("t"))
    lists = d.unionByName(t, allowMissingColumns=True).groupBy("image_id", "cls").agg(*(F.collect_list(F.when(there, F.col(k))).alias(f"{k}s") for k in "dt"))
    pairs = lists.select("image_id", "cls", F.explode("ds").alias("d"), "ts").select("image_id", "cls", "d", F.explode("ts").alias("t"))
    pairs = pairs.select("image_id", "cls", "d.idx", "d.conf", "t.id", B.iou(F.col("d.box"), F.col("t.box")).alias("iou")).where(F.col("iou") >= iou_threshold)
    entry = F.struct((-F.col("conf")).alias("c"), F.col("idx").cast("long").alias("idx"), (-F.col("iou")).alias("i"), (-F.col("id")).cast("long").alias("t"))
    kind = "array<struct<c:double,idx:bigint,i:double,t:bigint>>"

    def choose(chosen: Column, p: Column) -> Column:
        taken = F.exists(chosen, lambda k: (k["idx"] == p["idx"]) | (k["t"] == p["t"]))
        return F.when(taken, chosen).otherwise(F.concat(chosen, F.array(p)))

    folded = pairs.groupBy("image_id", "cls").agg(F.sort_array(F.collect_list(entry)).cast(kind).alias("p"))
    got = folded.select("image_id", "cls", F.explode(F.aggregate("p", F.array().cast(kind), choose)).alias("m"))
    return got.select("image_id", "cls", F.col("m.idx").alias("idx"), (-F.col("m.t")).alias("id"), (-F.col("m.i")).alias("iou"), (-F.col("m.c")).alias("conf"))


def _share(part: Column, whole: Column) -> Column:
    """part / whole with three decimals; 1 of nothing."""
    return F.when(whole == 0, 1.0).otherwise(B.round3(part / F.when(whole == 0, 1).otherwise(whole)))


def step_scores(dets: DataFrame, truth: DataFrame, iou_threshold: float = 0.5) -> DataFrame:
    """Per image: dom_count, detections, found, correct, recall, precision; images of either table."""
    parts = [
        truth.groupBy("image_id").agg(F.count("*").alias("t"), F.lit(0).alias("d"), F.lit(0).alias("m")),
        dets.groupBy("image_id").agg(F.lit(0).alias("t"), F.count("*").alias("d"), F.lit(0).alias("m")),
        match(dets, truth, iou_threshold).groupBy("image_id").agg(F.lit(0).alias("t"), F.lit(0).alias("d"), F.count("*").alias("m")),
    ]
    s = parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("image_id").agg(F.sum("t").alias("dom_count"), F.sum("d").alias("detections"), F.sum("m").alias("found"))
    return s.withColumn("correct", F.col("found")).withColumn("recall", _share(F.col("found"), F.col("dom_count"))).withColumn("precision", _share(F.col("correct"), F.col("detections")))


def sweep(dets: DataFrame, truth: DataFrame, thresholds=THRESHOLDS, iou_threshold: float = 0.5) -> DataFrame:
    """Scores by confidence threshold, per class and overall (cls null): truth, found, detections, correct, recall, precision.

    Less confident detections never change what more confident ones match, so one matching at the
    lowest threshold serves all: each match and detection counts for every threshold it reaches.
    """
    low = dets.where(F.col("conf") >= min(thresholds))

    def counts_of(df: DataFrame, name: str, reaches) -> DataFrame:
        """Rows of a class that reach each threshold, counted before they are told apart; a class without any has no row."""
        by_class = df.groupBy("cls").agg(*(F.count_if(reaches(float(t))).alias(f"n{i}") for i, t in enumerate(thresholds)))
        each = F.explode(F.array(*(F.struct(F.lit(float(t)).alias("threshold"), F.col(f"n{i}").alias("n")) for i, t in enumerate(thresholds))))
        told = by_class.select("cls", each.alias("e")).where("e.n > 0")
        return told.select("e.threshold", "cls", *(F.col("e.n").alias(c) if c == name else F.lit(0).cast("long").alias(c) for c in "tdm"))

    reached = lambda t: F.col("conf") >= t
    rows = [counts_of(truth, "t", lambda _: F.lit(True)), counts_of(low, "d", reached), counts_of(_matched(low, truth, iou_threshold), "m", reached)]
    counts = rows[0].unionByName(rows[1]).unionByName(rows[2]).groupBy("threshold", "cls").agg(*(F.sum(c).alias(c) for c in "tdm"))
    s = counts.groupingSets([["threshold", "cls"], ["threshold"]], "threshold", "cls").agg(F.sum("t").alias("truth"), F.sum("m").alias("found"), F.sum("d").alias("detections"), F.sum("m").alias("correct"))
    ratio = lambda part, whole: F.when(F.col(whole) == 0, 1.0).otherwise(F.try_divide(F.col(part), F.col(whole)))
    return s.withColumn("recall", ratio("found", "truth")).withColumn("precision", ratio("correct", "detections"))


def best_iou(reference: DataFrame, candidates: DataFrame, side: float = CELL) -> DataFrame:
    """Reference boxes (image_id, id) with the best IoU among the image's candidate boxes, 0 without one."""
    keys = ["image_id", "cell_x", "cell_y"]
    c = in_cells(candidates.select("image_id", *_XYWH), side).select(*keys, a_box().alias("cb"))
    r = in_cells(reference.select("image_id", "id", *_XYWH), side).select(*keys, "id", a_box().alias("rb"))
    # Pairs that share several cells come several times, which changes no maximum.
    met = r.join(c, keys).groupBy("image_id", "id").agg(F.max(B.iou(F.col("rb"), F.col("cb"))).alias("best"))
    return reference.select("image_id", "id").distinct().join(met, ["image_id", "id"], "left").select("image_id", "id", F.coalesce("best", F.lit(0.0)).alias("iou"))


def vision_only(visual: DataFrame, elements: DataFrame, min_confidence: float = 0.5, most: int = 24, max_share: float = 0.25, side: float = CELL) -> DataFrame:
    """Confident boxes that no listed control covers: image_id, idx, role, box, conf and the centre point (px, py).

    ``visual`` has image_id, idx, role, box, conf, matched_id, vw, vh; ``elements`` image_id, box,
    is_visible, is_interactive. The ``most`` most confident of an image stay, of equals the first.
    """
    area = F.col("width") * F.col("height") <= max_share * F.col("vw") * F.col("vh")
    v = visual.where(F.col("matched_id").isNull() & (F.col("conf") >= min_confidence) & (F.col("width") >= 8) & (F.col("height") >= 8) & area)
    v = v.withColumn("p", B.centre(a_box())).withColumn("px", F.col("p.x")).withColumn("py", F.col("p.y")).drop("p")
    v = v.where("px >= 0 AND py >= 0 AND px < vw AND py < vh").withColumn("cell_x", _cell(F.col("px"), side)).withColumn("cell_y", _cell(F.col("py"), side)).alias("v")
    e = in_cells(elements.where("is_visible AND is_interactive").select("image_id", *_XYWH), side).alias("e")
    inside = F.expr("v.image_id = e.image_id AND v.cell_x = e.cell_x AND v.cell_y = e.cell_y AND v.px BETWEEN e.x AND e.x + e.width AND v.py BETWEEN e.y AND e.y + e.height")
    free = v.join(e, inside, "left_anti")
    rank = F.row_number().over(Window.partitionBy("image_id").orderBy(F.desc("conf"), "idx"))
    return free.withColumn("_rank", rank).where(F.col("_rank") <= most).select("image_id", "idx", "role", *_XYWH, "conf", "px", "py")


def reading_order(rows: DataFrame, row_height: float, by: str = "image_id") -> DataFrame:
    """Adds position (from 0) by rows of boxes' centres, then x, then idx."""
    order = Window.partitionBy(by).orderBy(B.reading_row(a_box(), row_height), "x", "idx")
    return rows.withColumn("position", F.row_number().over(order) - 1)


def top_down(rows: DataFrame, by: str = "image_id") -> DataFrame:
    """Adds position (from 0) by y, x, then idx."""
    return rows.withColumn("position", F.row_number().over(Window.partitionBy(by).orderBy("y", "x", "idx")) - 1)


def decode_anchors(anchors: DataFrame, threshold: float, size: int, iou_threshold: float = 0.45, most: int = 300) -> DataFrame:
    """Detections from raw anchors (image_id, anchor, cx, cy, w, h, scores, img_w, img_h).

    Best class over the threshold, back to image pixels, at least 2 pixels a side, suppressed per class;
    boxes with one decimal, confidences with three.
    """
    best = anchors.withColumn("b", V.argmax(F.col("scores"))).where(F.col("b.score") >= threshold)
    placed = best.withColumn("m", B.unletterbox(F.col("cx"), F.col("cy"), F.col("w"), F.col("h"), B.letterbox(F.col("img_w"), F.col("img_h"), size), F.col("img_w"), F.col("img_h")))
    dets = placed.where("m.width >= 2 AND m.height >= 2").select("image_id", F.col("b.cls").alias("cls"), F.col("anchor").cast("int").alias("idx"), F.col("b.score").alias("conf"), "m.x", "m.y", "m.width", "m.height")
    return _rounded(suppress(dets, iou_threshold, most))


def decode_faces(anchors: DataFrame, threshold: float, iou_threshold: float = 0.3, most: int = 200) -> DataFrame:
    """Faces from raw anchors (image_id, anchor, score, x1, y1, x2, y2 as shares, img_w, img_h): at least 1 pixel a side."""
    at = lambda c, hi: F.greatest(F.lit(0.0), F.least(F.col(c) * F.col(hi), F.col(hi)))
    px = anchors.where(F.col("score") >= threshold).select("image_id", F.lit(0).alias("cls"), F.col("anchor").cast("int").alias("idx"), F.col("score").alias("conf"), at("x1", "img_w").alias("x"), at("y1", "img_h").alias("y"), at("x2", "img_w").alias("r"), at("y2", "img_h").alias("b"))
    dets = px.select("image_id", "cls", "idx", "conf", "x", "y", (F.col("r") - F.col("x")).alias("width"), (F.col("b") - F.col("y")).alias("height")).where("width >= 1 AND height >= 1")
    return _rounded(suppress(dets, iou_threshold, most)).drop("cls").withColumn("category", F.lit("face")).withColumn("method", F.lit("ml"))


def _rounded(dets: DataFrame) -> DataFrame:
    return dets.select("image_id", "cls", "idx", B.round3(F.col("conf")).alias("conf"), *(B.round1(F.col(k)).alias(k) for k in _XYWH))


def uncovered(regions: DataFrame, masks: DataFrame, margin: float = 0.0, side: float = CELL) -> DataFrame:
    """Regions (image_id, box) that no mask of their image covers with ``margin`` of their size on every side.

    A mask that covers a region has the corner of it, margin included, in one of its cells.
    """
    dx, dy = f"r.width * {margin}", f"r.height * {margin}"
    corner = [_cell(F.expr(f"{k} - {n} * {margin}"), side).alias(f"_cell_{k}") for k, n in (("x", "width"), ("y", "height"))]
    r, m = regions.select("*", *corner).alias("r"), in_cells(masks.select("image_id", *_XYWH), side).alias("m")
    inside = F.expr(f"r.image_id = m.image_id AND r._cell_x = m.cell_x AND r._cell_y = m.cell_y AND m.x <= r.x - {dx} AND m.y <= r.y - {dy} AND m.x + m.width >= r.x + r.width + {dx} AND m.y + m.height >= r.y + r.height + {dy}")
    return r.join(m, inside, "left_anti").drop("_cell_x", "_cell_y")


def nearest_rank(values: Column, p: float) -> Column:
    """The value at index round(p / 100 * (n - 1)) of an array, halves up."""
    sorted_ = F.array_sort(values)
    return F.get(sorted_, F.floor(F.lit(p / 100.0) * (F.size(values) - 1) + 0.5).cast("int"))


RANGES = 64  # value ranges of a group, numbered apart from each other


def _value_ranks(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """Distinct values per group with _first and _last, the indices their rows have in order, and _n, the group's rows.

    Equal values are counted first. A group's values fall into ranges between approximate quantiles; a range
    starts at the running sum of those before it, and only values within a range are ranked: no group is one task.
    The quantiles are found once and kept: found again in another order of rows they may differ, and ranges with them.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("_c"))
    cuts = counts.groupBy(*(F.col(c).alias(f"_{c}") for c in by)).agg(F.percentile_approx(value, [i / RANGES for i in range(1, RANGES)], 1000).alias("_cuts"), F.sum("_c").alias("_n"))
    cuts = _checkpointed(cuts)
    same = functools.reduce(lambda x, y: x & y, (F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by))
    placed = counts.join(cuts, same).withColumn("_range", F.size(F.filter("_cuts", lambda x: x < F.col(value))))
    before = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = placed.groupBy(*by, "_range").agg(F.sum("_c").alias("_s")).withColumn("_start", F.coalesce(F.sum("_s").over(before), F.lit(0)))
    starts = starts.select(*(F.col(c).alias(f"_s_{c}") for c in by), F.col("_range").alias("_s_range"), "_start")
    at_start = functools.reduce(lambda x, y: x & y, (F.col(c).eqNullSafe(F.col(f"_s_{c}")) for c in by), F.col("_range") == F.col("_s_range"))
    upto = F.sum("_c").over(Window.partitionBy(*by, "_range").orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
    return placed.withColumn("_upto", upto).join(starts, at_start).select(*by, value, "_n", (F.col("_start") + F.col("_upto") - F.col("_c")).alias("_first"), (F.col("_start") + F.col("_upto") - 1).alias("_last"))


def _value_at(value: str, index: Column) -> Column:
    return F.max(F.when((F.col("_first") <= index) & (index <= F.col("_last")), F.col(value)))


def percentile(df: DataFrame, by: list[str], value: str, points: tuple[float, ...]) -> DataFrame:
    """Nearest-rank percentiles p<point> per group: the value at index round(p / 100 * (n - 1)), halves up."""
    at = lambda p: F.floor(F.lit(p / 100.0) * (F.col("_n") - 1) + 0.5)
    return _value_ranks(df, by, value).groupBy(*by).agg(*(_value_at(value, at(p)).alias(f"p{p:g}") for p in points))


def upper_median(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """The value at index floor(n / 2) per group."""
    return _value_ranks(df, by, value).groupBy(*by).agg(_value_at(value, F.floor(F.col("_n") / 2)).alias("median"))


def image_recall(truth_counts: DataFrame, dets: DataFrame) -> DataFrame:
    """One row: found (sum of min of truth and detections), total, and false_positives on images without truth."""
    n = dets.groupBy("image_id").agg(F.count("*").alias("n"))
    j = truth_counts.select("image_id", "truth").join(n, "image_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return j.agg(F.sum(F.least("truth", "n")).alias("found"), F.sum("truth").alias("total"), F.sum(F.when(F.col("truth") == 0, F.col("n")).otherwise(0)).alias("false_positives"))


def compare_variants(runs: DataFrame, baseline: str) -> DataFrame:
    """Latency by variant and resolution against the baseline variant: runs, mean, p50, p95, speedup.

    ``runs`` has variant, resolution, ms. Speed-ups have two decimals, and are null without a baseline.
    """
    by = ["variant", "resolution"]
    points = percentile(runs, by, "ms", (50, 95)).join(runs.groupBy(*by).agg(F.count("ms").alias("runs"), B.round1(F.avg("ms")).alias("mean")), by)
    base = points.where(F.col("variant") == baseline).select("resolution", F.col("p50").alias("base"))
    return points.join(base, "resolution", "left").select(*by, "runs", "mean", "p50", "p95", B.half_up(F.try_divide("base", "p50"), 100).alias("speedup"))


def size_share(size: Column, base: Column) -> Column:
    """Whole percent of a baseline's size; 100 without a baseline."""
    return F.floor(F.coalesce(F.try_divide(size * 100, base), F.lit(100.0)) + 0.5).cast("int")


def confidence_summary(dets: DataFrame, *by: str) -> DataFrame:
    """Detections, least and mean confidence (one decimal) per group."""
    return dets.groupBy(*by).agg(F.count("*").alias("detections"), F.min("conf").alias("min_confidence"), B.round1(F.avg("conf")).alias("mean_confidence"))


def live_precision(visual: DataFrame, by: str = "image_id") -> DataFrame:
    """Whole percent of boxes matched or added per image; 100 without boxes (a null row per image)."""
    good = F.count_if(F.col("matched_id").isNotNull()) + F.count_if(F.col("added_as").isNotNull())
    n = F.count("conf")
    return visual.groupBy(by).agg(F.when(n == 0, 100).otherwise(F.floor(F.try_divide(good * 100, n) + 0.5)).cast("int").alias("precision"))
