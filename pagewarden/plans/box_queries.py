"""Queries over boxes derived from lineitem: suppression, matching, scores, candidates, masks, order, geometry."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagewarden.functions import boxes as B
from pagewarden.functions import values as V
from pagewarden.operators import captures as C
from pagewarden.operators import detections as D
from pagewarden.operators import store
from pagewarden.plans import views
from pagewarden.plans.views import DETS, RUNS, TRUTH, duck, iou

VW, VH = 320.0, 180.0


def dets(spark, sf):
    return views.run(spark, sf, DETS)


def truth(spark, sf):
    return views.run(spark, sf, TRUTH)


def _visual(spark, sf):
    """Detections as vision boxes; every third is matched to a listed element."""
    role = F.element_at(F.array(F.lit("button"), F.lit("textbox"), F.lit("link")), F.col("cls") + 1)
    matched = F.when(F.col("idx") % 3 == 0, F.concat(F.lit("el_"), F.col("idx").cast("string")))
    added = F.when(F.col("idx") % 7 == 0, F.concat(F.lit("vis_"), F.col("idx").cast("string")))
    return dets(spark, sf).withColumn("role", role).withColumn("matched_id", matched).withColumn("added_as", added).withColumn("vw", F.lit(VW)).withColumn("vh", F.lit(VH))


def _elements(spark, sf):
    return truth(spark, sf).withColumn("is_visible", F.col("id") % 2 == 0).withColumn("is_interactive", F.col("cls") < 2)


def nms(spark, sf):
    return D.suppress(dets(spark, sf), 0.45, 300)


def match(spark, sf):
    return D.match(dets(spark, sf), truth(spark, sf)).withColumn("iou", F.round("iou", 9))


def step_scores(spark, sf):
    return D.step_scores(dets(spark, sf), truth(spark, sf))


def sweep(spark, sf):
    return D.sweep(dets(spark, sf), truth(spark, sf)).withColumn("recall", F.round("recall", 9)).withColumn("precision", F.round("precision", 9))


def best_iou(spark, sf):
    per_image = D.best_iou(truth(spark, sf), dets(spark, sf).where("conf >= 0.5")).groupBy("image_id")
    return per_image.agg(F.round(F.avg("iou"), 6).alias("mean_iou"), F.count("*").alias("boxes"))


def vision_only(spark, sf):
    return D.vision_only(_visual(spark, sf), _elements(spark, sf), 0.6)


def reading_order(spark, sf):
    rows = D.reading_order(dets(spark, sf), 24).select("image_id", "idx", F.col("position").alias("controls"))
    lines = D.reading_order(dets(spark, sf), 8).select("image_id", "idx", F.col("position").alias("lines"))
    down = D.top_down(dets(spark, sf)).select("image_id", "idx", F.col("position").alias("down"))
    return rows.join(lines, ["image_id", "idx"]).join(down, ["image_id", "idx"])


def _regions(spark, sf):
    method = F.when(F.col("idx") % 2 == 0, "ml").otherwise("dom")
    return dets(spark, sf).select("image_id", "idx", "x", "y", "width", "height", F.lit("other").alias("category"), F.col("conf").alias("confidence"), method.alias("method"), F.lit(2.0).alias("dpr"), F.lit(VW).alias("img_w"), F.lit(VH).alias("img_h"))


def masks(spark, sf):
    m = C.masks(_regions(spark, sf))
    return m.groupBy("image_id", "method").agg(F.count("*").alias("masks"), *(F.round(F.sum(k), 6).alias(f"sum_{k}") for k in ("x", "y", "width", "height")))


def uncovered(spark, sf):
    regions = truth(spark, sf).select("image_id", "id", "x", "y", "width", "height")
    return D.uncovered(regions, dets(spark, sf)).groupBy("image_id").agg(F.count("*").alias("uncovered"))


def geometry(spark, sf):
    b = D.a_box()
    vw, vh = F.lit(VW), F.lit(VH)
    cols: dict[str, Column] = {
        "word": B.grid_word(b, vw, vh), "seen": B.element_visible(b, vw, vh), "inside": B.in_viewport(b, vw, vh), "clip_area": F.coalesce(B.clip(b, vw, vh)["width"] * B.clip(b, vw, vh)["height"], F.lit(0.0)),
        "cx": B.centre(b)["x"], "cy": B.centre(b)["y"], "css_x": B.to_css(b, F.lit(1.5))["x"], "px_y": B.to_px(b, F.lit(1.5))["y"],
        "kept": B.label_clip(b, vw, vh).isNotNull(),
    }
    return dets(spark, sf).select("image_id", "idx", *(c.alias(n) for n, c in cols.items()))


def label_boxes(spark, sf):
    """Label lines back to boxes: normalised centre and size to pixels."""
    d = dets(spark, sf).withColumn("line", B.norm_line(F.col("cls"), D.a_box(), F.lit(VW), F.lit(VH)))
    n = lambda i: F.get(F.split("line", " "), F.lit(i)).cast("double")
    b = d.withColumn("b", B.from_norm(n(1), n(2), n(3), n(4), F.lit(VW), F.lit(VH)))
    return b.select("image_id", "idx", *(F.round(f"b.{k}", 2).alias(k) for k in ("x", "y", "width", "height")))


def anchors(spark, sf):
    """Raw anchors of a 640 model from the boxes, decoded and suppressed."""
    d = dets(spark, sf)
    scores = F.array(*(F.when(F.col("cls") == c, F.col("conf")).otherwise(F.lit(0.1)) for c in range(3)))
    a = d.select("image_id", F.col("idx").alias("anchor"), ((F.col("x") + F.col("width") / 2) * 2).alias("cx"), ((F.col("y") + F.col("height") / 2) * 2 + 140).alias("cy"), (F.col("width") * 2).alias("w"), (F.col("height") * 2).alias("h"), scores.alias("scores"), F.lit(VW).alias("img_w"), F.lit(VH).alias("img_h"))
    return D.decode_anchors(a, 0.35, 640)


def class_argmax(spark, sf):
    s = F.array(F.col("l_discount"), F.col("l_tax"), F.lit(0.05))
    best = views.table(spark, sf, "lineitem").select(V.argmax(s).alias("b"))
    return best.groupBy(F.col("b.cls").alias("cls")).agg(F.count("*").alias("n"), F.round(F.sum("b.score"), 6).alias("score"))


def region_counts(spark, sf):
    method = F.element_at(F.array(*map(F.lit, ("ml", "dom", "heuristic", "ocr"))), (F.col("idx") % 4 + 1).cast("int"))
    r = dets(spark, sf).withColumn("method", method).withColumn("category", F.when(F.col("cls") == 2, "photo").otherwise("face"))
    return C.count_regions(r, "image_id")


def region_words(spark, sf):
    r = dets(spark, sf).withColumn("category", F.element_at(F.array(*map(F.lit, ("face", "email", "phone"))), F.col("cls") + 1))
    return C.describe_redactions(r, "image_id", "idx")


def union_regions(spark, sf):
    parts = [_regions(spark, sf).where(f"method = '{m}'").select("image_id", "idx", "category", "confidence", "method") for m in ("ml", "dom")]
    return C.all_regions(*parts).groupBy("method").agg(F.count("*").alias("regions"), F.round(F.sum("confidence"), 6).alias("confidence"))


def percentiles(spark, sf):
    return D.percentile(views.run(spark, sf, RUNS), ["variant", "resolution"], "ms", (50, 90, 95))


def medians(spark, sf):
    return D.upper_median(views.run(spark, sf, RUNS), ["variant"], "ms")


def variants(spark, sf):
    return D.compare_variants(views.run(spark, sf, RUNS), "view")


def image_recall(spark, sf):
    t = dets(spark, sf).groupBy("image_id").agg(F.count_if(F.col("idx") % 5 != 0).alias("truth")).withColumn("truth", F.when(F.col("image_id") % 11 == 0, 0).otherwise(F.col("truth")))
    return D.image_recall(t, dets(spark, sf).where("conf >= 0.5"))


def live_precision(spark, sf):
    return D.live_precision(_visual(spark, sf))


def confidences(spark, sf):
    return D.confidence_summary(dets(spark, sf), "cls")


def seen_elements(spark, sf):
    e = truth(spark, sf).select("image_id", F.concat(F.lit("el_"), F.col("id").cast("string")).alias("id"))
    return C.seen_by_vision(e, _visual(spark, sf)).groupBy("image_id").agg(F.count("*").alias("listed"), F.count_if("seen").alias("seen"))


def baskets(spark, sf):
    return store.totals(views.run(spark, sf, views.BASKETS))


def frame_merge(spark, sf):
    """Two frames a page from the first boxes; odd ones answered with the boxes of their class."""
    d = dets(spark, sf)
    nonce = F.concat_ws("-", F.col("image_id").cast("string"), F.col("idx").cast("string"))
    pages = d.where("idx > 2").select("image_id", F.col("image_id").alias("page_id"), F.col("idx").alias("pos"), F.concat(F.lit("el_"), F.col("idx").cast("string")).alias("id"), "x", "y", "width", "height", F.lit(True).alias("is_visible")).drop("image_id")
    frames = d.where("idx <= 2").select(F.col("image_id").alias("page_id"), F.col("idx").alias("frame_no"), nonce.alias("nonce"), "x", "y", "width", "height", F.col("x").alias("origin_x"), F.col("y").alias("origin_y"))
    inner = d.where("idx = 1").select(nonce.alias("nonce"), F.lit(0).alias("pos"), F.lit("el_f1_0").alias("id"), F.lit(1.0).alias("x"), F.lit(1.0).alias("y"), F.lit(5.0).alias("width"), F.lit(5.0).alias("height"), F.lit(True).alias("is_visible"))
    merged, unread = C.merge_frames(pages, frames, inner)
    m = merged.where("embedded").select("page_id", F.col("position").alias("embedded_at"))
    u = unread.groupBy("page_id").agg(F.count("*").alias("unread"))
    return m.join(u, "page_id", "left").select("page_id", "embedded_at", F.coalesce("unread", F.lit(0)).alias("unread"))


QUERIES = {f.__name__ if f.__name__ != "nms" else "box_nms": f for f in (
    nms, match, step_scores, sweep, best_iou, vision_only, reading_order, masks, uncovered, geometry, label_boxes, anchors, class_argmax, region_counts,
    region_words, union_regions, percentiles, medians, variants, image_recall, live_precision, confidences, seen_elements, baskets, frame_merge,
)}

_D, _T = f"({duck(DETS)})", f"({duck(TRUTH)})"
_CHOSEN = f"""
    pairs AS (
      SELECT image_id, cls, d.idx, d.conf, t.id, {iou('d', 't')} AS iou FROM d JOIN t USING (image_id, cls) WHERE {iou('d', 't')} >= 0.5),
    folded AS (
      SELECT image_id, cls, list_reduce(list([{{idx: idx, id: id, iou: iou}}] ORDER BY conf DESC, idx, iou DESC, id DESC),
        lambda acc, p: CASE WHEN len(list_filter(acc, lambda k: k.idx = p[1].idx OR k.id = p[1].id)) > 0 THEN acc ELSE list_concat(acc, p) END) AS l
      FROM pairs GROUP BY image_id, cls),
    m AS (SELECT image_id, cls, unnest(l) AS k FROM folded)"""
_SHARE = "CASE WHEN {1} = 0 THEN 1.0::DOUBLE ELSE floor({0}::DOUBLE / {1} * 1000 + 0.5) / 1000 END"
_R1 = "floor(({0}) * 10 + 0.5) / 10.0::DOUBLE"
_WITH = f"WITH d AS {_D}, t AS {_T}"
_PAD = """
    px AS (SELECT *, CASE WHEN idx % 2 = 0 THEN 1.0 ELSE 2.0 END::DOUBLE AS s FROM d),
    b AS (SELECT image_id, idx, CASE WHEN idx % 2 = 0 THEN 'ml' ELSE 'dom' END AS method, x * s AS x, y * s AS y, width * s AS w, height * s AS h FROM px),
    g AS (SELECT *, CASE WHEN method = 'ml' THEN greatest(4, w * 0.15::DOUBLE) ELSE greatest(4, least(h * 0.15::DOUBLE, 8)) END AS gx,
                    CASE WHEN method = 'ml' THEN greatest(4, h * 0.15::DOUBLE) ELSE greatest(4, least(h * 0.15::DOUBLE, 8)) END AS gy FROM b),
    e AS (SELECT image_id, method, greatest(0, least(floor(x - gx), 320)) AS x0, greatest(0, least(floor(y - gy), 180)) AS y0,
                 greatest(0, least(ceil(x + w + gx), 320)) AS x1, greatest(0, least(ceil(y + h + gy), 180)) AS y1 FROM g)"""
_RANK = "floor({p} / 100.0::DOUBLE * (n - 1) + 0.5)"
_PCT = "WITH r AS (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY ms) - 1 AS i, count(*) OVER (PARTITION BY {by}) AS n FROM (" + duck(RUNS) + ") WHERE ms IS NOT NULL)"

ORACLE_SQL = {
    "box_nms": f"""
      WITH d AS {_D}, g AS (
        SELECT image_id, cls, list_reduce(list([{{idx: idx, conf: conf, x: x, y: y, width: width, height: height}}] ORDER BY conf DESC, idx),
          lambda acc, p: CASE WHEN len(acc) < 300 AND len(list_filter(acc, lambda k: {iou('k', 'p[1]')} > 0.45::DOUBLE)) = 0 THEN list_concat(acc, p) ELSE acc END) AS l
        FROM d GROUP BY image_id, cls),
      u AS (SELECT image_id, cls, unnest(l) AS k FROM g)
      SELECT image_id, cls, k.idx AS idx, k.conf AS conf, k.x AS x, k.y AS y, k.width AS width, k.height AS height FROM u""",
    "match": f"{_WITH}, {_CHOSEN} SELECT image_id, cls, k.idx::BIGINT AS idx, k.id::BIGINT AS id, round(k.iou, 9) AS iou FROM m",
    "step_scores": f"""{_WITH}, {_CHOSEN},
      s AS (SELECT image_id, sum(a)::BIGINT AS dom_count, sum(b)::BIGINT AS detections, sum(c)::BIGINT AS found FROM (
        SELECT image_id, 1 AS a, 0 AS b, 0 AS c FROM t UNION ALL SELECT image_id, 0, 1, 0 FROM d UNION ALL SELECT image_id, 0, 0, 1 FROM m) GROUP BY image_id)
      SELECT image_id, dom_count, detections, found, found AS correct, {_SHARE.format('found', 'dom_count')} AS recall, {_SHARE.format('found', 'detections')} AS precision FROM s""",
    "sweep": f"""{_WITH.replace('d AS (', 'd AS (SELECT * FROM (', 1).replace('), t AS', ') WHERE conf >= 0.25::DOUBLE), t AS', 1)}, {_CHOSEN},
      th AS (SELECT unnest([0.25, 0.35, 0.5, 0.6, 0.7]::DOUBLE[]) AS threshold),
      mc AS (SELECT m.image_id, m.cls, d.conf FROM m JOIN d ON d.image_id = m.image_id AND d.cls = m.cls AND d.idx = m.k.idx),
      s AS (SELECT threshold, cls, sum(a)::BIGINT AS truth, sum(c)::BIGINT AS found, sum(b)::BIGINT AS detections, sum(c)::BIGINT AS correct FROM (
        SELECT threshold, cls, 1 AS a, 0 AS b, 0 AS c FROM t, th
        UNION ALL SELECT threshold, cls, 0, 1, 0 FROM d JOIN th ON conf >= threshold
        UNION ALL SELECT threshold, cls, 0, 0, 1 FROM mc JOIN th ON conf >= threshold) GROUP BY GROUPING SETS ((threshold, cls), (threshold)))
      SELECT *, round(CASE WHEN truth = 0 THEN 1.0 ELSE found::DOUBLE / truth END, 9) AS recall, round(CASE WHEN detections = 0 THEN 1.0 ELSE correct::DOUBLE / detections END, 9) AS precision FROM s""",
    "best_iou": f"""{_WITH}, b AS (
        SELECT t.image_id, t.id, max(coalesce({iou('t', 'd')}, 0)) AS iou FROM t LEFT JOIN d ON d.image_id = t.image_id AND d.conf >= 0.5::DOUBLE GROUP BY t.image_id, t.id)
      SELECT image_id, round(avg(iou), 6) AS mean_iou, count(*) AS boxes FROM b GROUP BY image_id""",
    "vision_only": f"""{_WITH}, v AS (
        SELECT *, ['button', 'textbox', 'link'][cls + 1] AS role, {_R1.format('x + width / 2')} AS px, {_R1.format('y + height / 2')} AS py FROM d
        WHERE idx % 3 <> 0 AND conf >= 0.6::DOUBLE AND width >= 8 AND height >= 8 AND width * height <= 0.25 * 320 * 180),
      f AS (SELECT * FROM v WHERE px >= 0 AND py >= 0 AND px < 320 AND py < 180 AND NOT EXISTS (
        SELECT 1 FROM t WHERE t.image_id = v.image_id AND t.id % 2 = 0 AND t.cls < 2 AND px BETWEEN t.x AND t.x + t.width AND py BETWEEN t.y AND t.y + t.height)),
      r AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY conf DESC, idx) AS n FROM f)
      SELECT image_id, idx, role, x, y, width, height, conf, px, py FROM r WHERE n <= 24""",
    "reading_order": f"""WITH d AS {_D} SELECT image_id, idx,
        (row_number() OVER (PARTITION BY image_id ORDER BY floor((y + height / 2) / 24 + 0.5), x, idx) - 1)::INT AS controls,
        (row_number() OVER (PARTITION BY image_id ORDER BY floor((y + height / 2) / 8 + 0.5), x, idx) - 1)::INT AS lines,
        (row_number() OVER (PARTITION BY image_id ORDER BY y, x, idx) - 1)::INT AS down FROM d""",
    "masks": f"""WITH d AS {_D}, {_PAD}
      SELECT image_id, method, count(*) AS masks, round(sum({_R1.format('x0 * 0.5::DOUBLE')}), 6) AS sum_x, round(sum({_R1.format('y0 * 0.5::DOUBLE')}), 6) AS sum_y,
             round(sum({_R1.format('(x1 - x0) * 0.5::DOUBLE')}), 6) AS sum_width, round(sum({_R1.format('(y1 - y0) * 0.5::DOUBLE')}), 6) AS sum_height
      FROM e WHERE x1 > x0 AND y1 > y0 GROUP BY image_id, method""",
    "uncovered": f"""{_WITH} SELECT image_id, count(*) AS uncovered FROM t WHERE NOT EXISTS (SELECT 1 FROM d WHERE d.image_id = t.image_id
        AND d.x <= t.x AND d.y <= t.y AND d.x + d.width >= t.x + t.width AND d.y + d.height >= t.y + t.height) GROUP BY image_id""",
    "geometry": f"""WITH d AS {_D}, c AS (SELECT *, (x + width / 2) / 320 AS gx, (y + height / 2) / 180 AS gy,
          greatest(0, least(x + width, 320) - greatest(x, 0)) AS cw, greatest(0, least(y + height, 180) - greatest(y, 0)) AS ch FROM d),
      w AS (SELECT *, CASE WHEN gx < 1.0::DOUBLE / 3 THEN 'left' WHEN gx > 2.0::DOUBLE / 3 THEN 'right' END AS col, CASE WHEN gy < 1.0::DOUBLE / 3 THEN 'top' WHEN gy > 2.0::DOUBLE / 3 THEN 'bottom' END AS r FROM c)
      SELECT image_id, idx, coalesce(r || '-' || col, r, col, 'center') AS word, width > 0 AND height > 0 AND x + width >= 0 AND y + height >= 0 AND x <= 320 AND y <= 180 AS seen,
        width > 0 AND height > 0 AND x + width > 0 AND y + height > 0 AND x < 320 AND y < 180 AS inside, CASE WHEN cw > 0 AND ch > 0 THEN cw * ch ELSE 0 END AS clip_area,
        {_R1.format('x + width / 2')} AS cx, {_R1.format('y + height / 2')} AS cy,
        {_R1.format('x * (1 / 1.5::DOUBLE)')} AS css_x, {_R1.format('y * 1.5::DOUBLE')} AS px_y, coalesce(cw >= 4 AND ch >= 4 AND cw * ch >= 0.5 * width * height, false) AS kept FROM w""",
    "label_boxes": f"WITH d AS {_D} SELECT image_id, idx, round(x, 2) AS x, round(y, 2) AS y, round(width, 2) AS width, round(height, 2) AS height FROM d",
    "class_argmax": """WITH b AS (SELECT CASE WHEN greatest(l_discount, l_tax, 0.05::DOUBLE) = l_discount THEN 0 WHEN greatest(l_tax, 0.05::DOUBLE) = l_tax THEN 1 ELSE 2 END AS cls,
        greatest(l_discount, l_tax, 0.05::DOUBLE) AS score FROM lineitem) SELECT cls::INT AS cls, count(*) AS n, round(sum(score), 6) AS score FROM b GROUP BY cls""",
    "region_counts": f"""WITH d AS {_D}, k AS (SELECT image_id, CASE WHEN cls = 2 THEN 'photo' ELSE ['ml', 'dom', 'heuristic', 'ocr'][idx % 4 + 1] END AS k FROM d)
      SELECT image_id, count(*) FILTER (k = 'ml')::INT AS faces, count(*) FILTER (k = 'photo')::INT AS photos, count(*) FILTER (k = 'dom')::INT AS fields,
             count(*) FILTER (k = 'heuristic')::INT AS text, count(*) FILTER (k = 'ocr')::INT AS ocr FROM k GROUP BY image_id""",
    "region_words": f"""WITH d AS {_D}, c AS (SELECT image_id, cls, count(*) AS n, min(idx) AS pos FROM d GROUP BY image_id, cls)
      SELECT image_id, string_agg(n || ' ' || ['face', 'email address', 'phone number'][cls + 1] || CASE WHEN n = 1 THEN '' ELSE 's' END, ', ' ORDER BY pos) AS hidden FROM c GROUP BY image_id""",
    "union_regions": f"WITH d AS {_D} SELECT CASE WHEN idx % 2 = 0 THEN 'ml' ELSE 'dom' END AS method, count(*) AS regions, round(sum(conf), 6) AS confidence FROM d GROUP BY 1",
    "percentiles": _PCT.format(by="variant, resolution") + "SELECT variant, resolution, " + ", ".join(f"max(ms) FILTER (i = {_RANK.format(p=p)}) AS p{p}" for p in (50, 90, 95)) + " FROM r GROUP BY variant, resolution",
    "medians": _PCT.format(by="variant") + "SELECT variant, max(ms) FILTER (i = floor(n / 2)) AS median FROM r GROUP BY variant",
    "variants": _PCT.format(by="variant, resolution") + f""", p AS (SELECT variant, resolution, count(*) AS runs, {_R1.format('avg(ms)')} AS mean, max(ms) FILTER (i = {_RANK.format(p=50)}) AS p50, max(ms) FILTER (i = {_RANK.format(p=95)}) AS p95 FROM r GROUP BY variant, resolution)
      SELECT p.variant, p.resolution, p.runs, p.mean, p.p50, p.p95, floor(b.p50 / p.p50 * 100 + 0.5) / 100.0::DOUBLE AS speedup FROM p LEFT JOIN p b ON b.resolution = p.resolution AND b.variant = 'view'""",
    "image_recall": f"""WITH d AS {_D}, t AS (SELECT image_id, CASE WHEN image_id % 11 = 0 THEN 0 ELSE count(*) FILTER (idx % 5 <> 0) END AS truth, count(*) FILTER (conf >= 0.5::DOUBLE) AS n FROM d GROUP BY image_id)
      SELECT sum(least(truth, n))::BIGINT AS found, sum(truth)::BIGINT AS total, sum(CASE WHEN truth = 0 THEN n ELSE 0 END)::BIGINT AS false_positives FROM t""",
    "live_precision": f"WITH d AS {_D} SELECT image_id, floor((count(*) FILTER (idx % 3 = 0) + count(*) FILTER (idx % 7 = 0)) * 100 / count(*) + 0.5)::INT AS precision FROM d GROUP BY image_id",
    "confidences": f"WITH d AS {_D} SELECT cls, count(*) AS detections, min(conf) AS min_confidence, {_R1.format('avg(conf)')} AS mean_confidence FROM d GROUP BY cls",
    "seen_elements": f"""{_WITH} SELECT image_id, count(*) AS listed, count(*) FILTER (EXISTS (SELECT 1 FROM d WHERE d.image_id = t.image_id AND d.idx = t.id AND d.idx % 3 = 0)) AS seen FROM t GROUP BY image_id""",
    "baskets": f"""WITH i AS ({duck(views.BASKETS)}), b AS (SELECT basket, price, (row_number() OVER (PARTITION BY basket ORDER BY price DESC, item) - 1) // 3 AS s FROM i WHERE kind = 'book'),
      o AS (SELECT basket, sum(greatest(p - 999, 0)) AS off FROM (SELECT basket, s, sum(price) AS p FROM b GROUP BY basket, s HAVING count(*) = 3) GROUP BY basket),
      t AS (SELECT i.basket, sum(price)::DOUBLE AS subtotal, count(*) FILTER (kind = 'laptop' AND price < 60000) * 2000 AS laptops FROM i GROUP BY i.basket),
      d AS (SELECT t.basket, subtotal, (coalesce(off, 0) + laptops)::DOUBLE AS discount FROM t LEFT JOIN o ON o.basket = t.basket)
      SELECT basket, subtotal, discount, CASE WHEN subtotal - discount >= 999 THEN 0 ELSE 49 END::INT AS delivery, subtotal - discount + CASE WHEN subtotal - discount >= 999 THEN 0 ELSE 49 END AS total FROM d""",
    "frame_merge": f"""WITH d AS {_D}, f AS (SELECT image_id, y + height AS bottom FROM d WHERE idx = 1), n AS (SELECT image_id, max(idx) AS idxs FROM d GROUP BY image_id)
      SELECT f.image_id AS page_id, (SELECT count(*) FROM d WHERE d.image_id = f.image_id AND d.idx > 2 AND d.idx < coalesce((SELECT min(e.idx) FROM d e WHERE e.image_id = f.image_id AND e.idx > 2 AND e.y >= f.bottom), 1000000))::INT AS embedded_at,
             CASE WHEN idxs >= 2 THEN 1 ELSE 0 END::BIGINT AS unread FROM f JOIN n USING (image_id)""",
}
