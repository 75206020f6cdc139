"""Queries of distances, groups, geometry and grids."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import compare as K
from ..operators import geometry as G
from .base import CELLS, VECTORS, cells, query, r6, rounded, sql6, table, vectors


def _centres(spark, d):
    """id (label), vec: the mean vector of each label."""
    long = vectors(spark, d).select("label", F.posexplode("v").alias("pos", "x")).groupBy("label", "pos").agg(F.avg("x").alias("x"))
    return long.groupBy(F.col("label").alias("id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda s: s["x"]).alias("vec"))


_DIST = CELLS + ", k AS (SELECT label, pos, avg(v) AS v FROM c GROUP BY ALL), dist AS (SELECT a.label AS a, b.label AS b, sqrt(sum(pow(a.v - b.v, 2))) AS d FROM k a JOIN k b USING (pos) WHERE a.label <> b.label GROUP BY 1, 2)"


def _dist(spark, d):
    one = K.pairwise_distances(_centres(spark, d), block=4)
    return one.unionByName(one.select(F.col("b").alias("a"), F.col("a").alias("b"), "d"))


@query(f"WITH {_DIST} SELECT a, b, {sql6('d')} AS d, {sql6('d / (SELECT sum(d) FROM dist)')} AS share FROM dist WHERE a < b")
def j5_pairwise_distances(spark, d):
    return rounded(K.normalised(K.pairwise_distances(_centres(spark, d), block=4)), ["a", "b"], ["d", "share"])


@query(f"WITH {_DIST}, skewed AS (SELECT a, b, d * (1 + a / 10) AS d FROM dist) SELECT x.a, x.b, {sql6('(x.d + y.d) / 2')} AS mean, {sql6('abs(x.d - y.d)')} AS gap FROM skewed x JOIN skewed y ON x.a = y.b AND x.b = y.a WHERE x.a < x.b")
def j6_symmetrize(spark, d):
    skewed = _dist(spark, d).withColumn("d", F.col("d") * (1 + F.col("a") / 10))
    return rounded(K.symmetrize(skewed), ["a", "b"], ["mean", "gap"])


def _groups(spark, d):
    return vectors(spark, d).select(F.col("label").alias("item"), (F.col("label") % 3).alias("grp")).distinct()


@query(f"WITH {_DIST}, m AS (SELECT a % 3 AS group_a, b % 3 AS group_b, avg(d) AS d FROM dist GROUP BY 1, 2) SELECT group_a, group_b, {sql6('d / (SELECT max(d) FROM m)')} AS distance FROM m")
def a42_group_distances(spark, d):
    return rounded(K.group_distances(_dist(spark, d), _groups(spark, d)), ["group_a", "group_b"], ["distance"])


@query(f"WITH {_DIST}, r AS (SELECT a, b, row_number() OVER (PARTITION BY a ORDER BY d, b) AS k FROM dist), h AS (SELECT k, sum(CASE WHEN a % 3 = b % 3 THEN 1 ELSE 0 END) AS n FROM r GROUP BY k) SELECT k, {sql6('sum(n) OVER (ORDER BY k) / (SELECT sum(n) FROM h)')} AS share FROM h")
def w9_knn_group_curve(spark, d):
    made = K.knn_group_curve(_dist(spark, d), _groups(spark, d))
    return made.select(F.col("k").cast("long").alias("k"), r6("share").alias("share"))


_NEAR = VECTORS + ", m AS (SELECT a.id AS a, b.id AS b, a.label AS la, b.label AS lb, sqrt(list_sum(list_transform(range(1, 65), lambda i: pow(a.v[i] - b.v[i], 2)))) AS d FROM s a JOIN s b ON a.id <> b.id), n AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY d, b) AS k FROM m)"


@query(f"WITH {_NEAR} SELECT a, b, k, {sql6('d')} AS d FROM n WHERE k <= 5")
def j5_nearest_neighbours(spark, d):
    made = K.nearest_neighbours(vectors(spark, d), 5, vec="v").rows
    return made.select("a", "b", F.col("k").cast("long").alias("k"), r6("d").alias("d"))


@query(
    f"WITH {_NEAR}, h AS (SELECT k, sum(CASE WHEN la = lb THEN 1 ELSE 0 END) AS n FROM n WHERE k <= 10 GROUP BY k), z AS (SELECT sum(n * (n - 1)) AS pairs, sum(n) AS items FROM (SELECT count(*) AS n FROM s GROUP BY label))"
    f" SELECT k, {sql6('sum(n) OVER (ORDER BY k) / pairs')} AS share, {sql6('k / (items - 1)')} AS random FROM h, z"
)
def w9_knn_group_shares(spark, d):
    rows = vectors(spark, d)
    made = K.knn_group_shares(K.nearest_neighbours(rows, 10, vec="v").rows, rows.select(F.col("id").alias("item"), F.col("label").alias("grp")))
    return made.select(F.col("k").cast("long").alias("k"), r6("share").alias("share"), r6("random").alias("random"))


def _boxes(spark, d):
    """det_id, image, cls, box and score of each order line."""
    li = table(spark, d, "lineitem")
    x, y = (F.col("l_partkey") % 50).cast("double"), (F.col("l_suppkey") % 40).cast("double")
    return li.select(
        (F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("det_id"), (F.col("l_orderkey") % 500).alias("image"), F.col("l_returnflag").alias("cls"),
        x.alias("xmin"), y.alias("ymin"), (x + 5 + F.col("l_linenumber") * 3).alias("xmax"), (y + 5 + F.col("l_quantity") / 2).alias("ymax"), (F.col("l_extendedprice") / 1000).alias("score"),
    )


_BOXES = "b AS (SELECT l_orderkey * 100 + l_linenumber AS det_id, l_orderkey % 500 AS image, l_returnflag AS cls, CAST(l_partkey % 50 AS DOUBLE) AS xmin, CAST(l_suppkey % 40 AS DOUBLE) AS ymin, l_partkey % 50 + 5 + l_linenumber * 3.0::DOUBLE AS xmax, l_suppkey % 40 + 5 + l_quantity / 2 AS ymax, l_extendedprice / 1000 AS score FROM lineitem)"


_HIT = "(greatest(least(k.xmax, r.xmax) - greatest(k.xmin, r.xmin), 0) * greatest(least(k.ymax, r.ymax) - greatest(k.ymin, r.ymin), 0))"
_AREAS = "(k.xmax - k.xmin) * (k.ymax - k.ymin) + (r.xmax - r.xmin) * (r.ymax - r.ymin)"


@query(
    f"WITH RECURSIVE {_BOXES}, o AS (SELECT *, row_number() OVER (PARTITION BY image, cls ORDER BY score DESC, det_id) AS n FROM b),"
    # the boxes kept so far travel along, best score first
    " g AS (SELECT image, cls, CAST(0 AS BIGINT) AS n, CAST([] AS STRUCT(det_id BIGINT, score DOUBLE, xmin DOUBLE, ymin DOUBLE, xmax DOUBLE, ymax DOUBLE)[]) AS kept FROM o WHERE n = 1"
    f" UNION ALL SELECT r.image, r.cls, r.n, CASE WHEN len(list_filter(g.kept, lambda k: {_HIT} / ({_AREAS} - {_HIT}) > 0.3)) = 0"
    " THEN list_append(g.kept, {'det_id': r.det_id, 'score': CAST(r.score AS DOUBLE), 'xmin': CAST(r.xmin AS DOUBLE), 'ymin': CAST(r.ymin AS DOUBLE), 'xmax': CAST(r.xmax AS DOUBLE), 'ymax': CAST(r.ymax AS DOUBLE)}) ELSE g.kept END"
    " FROM g JOIN o r ON r.image = g.image AND r.cls = g.cls AND r.n = g.n + 1)"
    " SELECT k.det_id, image, cls, k.score FROM (SELECT image, cls, unnest(arg_max(kept, n)) AS k FROM g GROUP BY image, cls)"
)
def j8_nms(spark, d):
    return G.nms(_boxes(spark, d), ["image", "cls"]).select("det_id", "image", "cls", "score")


@query(f"WITH {_BOXES}, r AS (SELECT *, row_number() OVER (PARTITION BY cls ORDER BY score DESC, det_id) AS k FROM b) SELECT cls, score, det_id, xmin, ymin, xmax, ymax FROM r WHERE k = 1")
def a38_best_windows(spark, d):
    return G.best_windows(_boxes(spark, d)).select("cls", "score", "det_id", "xmin", "ymin", "xmax", "ymax")


@query("SELECT CASE WHEN l_discount >= 0.07 THEN 'foreground' ELSE 'background' END AS kind, CASE WHEN l_discount >= 0.07 THEN l_linenumber ELSE 0 END::BIGINT AS label, count(*) AS n FROM lineitem WHERE l_discount >= 0.07 OR l_discount < 0.03 GROUP BY 1, 2")
def a39_window_classes(spark, d):
    rows = table(spark, d, "lineitem").select(F.col("l_linenumber").cast("long").alias("label"), F.col("l_discount").alias("overlap"))
    return G.window_classes(rows, 0.07, 0.03).select("kind", F.col("label").cast("long").alias("label"), "n")


_MASS = CELLS + ", m AS (SELECT id, h, w, abs(v) AS v FROM c), z AS (SELECT id, sum(h * v) / sum(v) AS ch, sum(w * v) / sum(v) AS cw FROM m GROUP BY id)"


def _mass(spark, d):
    return cells(spark, d).select("id", "h", "w", F.abs("v").alias("v"))


@query(f"WITH {_MASS} SELECT id, {sql6('ch')} AS ch, {sql6('cw')} AS cw FROM z")
def a44_center_of_mass(spark, d):
    return rounded(G.center_of_mass(_mass(spark, d), ["id"]), ["id"], ["ch", "cw"])


@query(f"WITH {_MASS}, y AS (SELECT id, sum(h * v) / sum(v) AS ch, sum(w * v) / sum(v) AS cw FROM m JOIN z USING (id) WHERE pow(h - ch, 2) + pow(w - cw, 2) <= 9 GROUP BY id) SELECT id, {sql6('ch / 7')} AS ch, {sql6('cw / 7')} AS cw FROM y")
def a44_center_of_mass_recentred(spark, d):
    return rounded(G.center_of_mass(_mass(spark, d), ["id"], iters=1, radius=3.0, normalize=True), ["id"], ["ch", "cw"])


def _axis(a: str, out: str) -> str:
    return (
        f"{out} AS (SELECT id, min({a} + (half - (upto - m)) / m) AS {out} FROM (SELECT *, sum(m) OVER (PARTITION BY id ORDER BY {a}) AS upto, sum(m) OVER (PARTITION BY id) / 2 AS half"
        f" FROM (SELECT id, {a}, sum(v) AS m FROM m GROUP BY 1, 2)) WHERE upto >= half AND upto - m < half GROUP BY id)"
    )


@query(f"WITH {_MASS}, {_axis('h', 'mh')}, {_axis('w', 'mw')} SELECT id, {sql6('mh.mh')} AS mh, {sql6('mw.mw')} AS mw FROM mh JOIN mw USING (id)")
def a45_median_center(spark, d):
    return rounded(G.median_center(_mass(spark, d), ["id"]), ["id"], ["mh", "mw"])


@query(f"WITH {VECTORS} SELECT id, {sql6('abs(0.5 * list_sum(list_transform(range(0, 4), lambda i: v[2 * i + 1] * v[2 * ((i + 1) % 4) + 2] - v[2 * i + 2] * v[2 * ((i + 1) % 4) + 1])))')} AS area FROM s")
def a46_polygon_area(spark, d):
    return vectors(spark, d).select("id", r6(G.polygon_area(F.slice("v", 1, 8))).alias("area"))


@query(
    f"WITH {VECTORS}, q AS (SELECT id, v[1] AS ax, v[2] AS ay, 1 + abs(v[3]) AS aw, 1 + abs(v[4]) AS ah, v[5] AS bx, v[6] AS b_y, 1 + abs(v[7]) AS bw, 1 + abs(v[8]) AS bh FROM s), i AS (SELECT *, greatest(least(ax + aw, bx + bw) - greatest(ax, bx), 0) * greatest(least(ay + ah, b_y + bh) - greatest(ay, b_y), 0) AS n FROM q)"
    f" SELECT id, {sql6('n / (aw * ah + bw * bh - n)')} AS iou FROM i"
)
def a46_polygon_iou(spark, d):
    v = lambda i: F.element_at("v", i)

    def box(o: int):
        x, y, w, h = v(o), v(o + 1), 1 + F.abs(v(o + 2)), 1 + F.abs(v(o + 3))
        return F.array(x, y, x + w, y, x + w, y + h, x, y + h)

    rows = vectors(spark, d).select("id", box(1).alias("a"), box(5).alias("b"))
    return rows.select("id", r6(G.polygon_iou("a", "b")).alias("iou"))


#: Arrowheads: four corners, the third one drawn in, going round one way for a and the other for b.
_DARTS = (
    VECTORS + ", q AS (SELECT id, 'a' AS side, [v[1], v[2] + 2, v[1] + 1.5, v[2] - 1.5, v[1], v[2] - abs(v[3]), v[1] - 1.5, v[2] - 1.5] AS p FROM s"
    " UNION ALL SELECT id, 'b', [v[4] - 1.5, v[5] - 1, v[4] - abs(v[6]), v[5], v[4] - 1.5, v[5] + 1, v[4] + 2, v[5]] FROM s)"
    ", g AS (SELECT id, side, p[2 * i + 1] AS x1, p[2 * i + 2] AS y1, p[2 * ((i + 1) % 4) + 1] AS x2, p[2 * ((i + 1) % 4) + 2] AS y2 FROM q, (SELECT unnest(range(0, 4)) AS i))"
    ", n AS (SELECT a.id, a.y1 + ((b.x1 - a.x1) * (b.y2 - b.y1) - (b.y1 - a.y1) * (b.x2 - b.x1)) / d * (a.y2 - a.y1) AS y FROM (SELECT a, b, (a.x2 - a.x1) * (b.y2 - b.y1) - (a.y2 - a.y1) * (b.x2 - b.x1) AS d FROM g a JOIN g b ON a.id = b.id AND a.side = 'a' AND b.side = 'b')"
    " WHERE d <> 0 AND ((b.x1 - a.x1) * (b.y2 - b.y1) - (b.y1 - a.y1) * (b.x2 - b.x1)) / d BETWEEN 0 AND 1 AND ((b.x1 - a.x1) * (a.y2 - a.y1) - (b.y1 - a.y1) * (a.x2 - a.x1)) / d BETWEEN 0 AND 1)"
    ", h AS (SELECT id, y AS lo, lead(y) OVER (PARTITION BY id ORDER BY y) AS hi FROM (SELECT DISTINCT id, y FROM (SELECT id, y1 AS y FROM g UNION ALL SELECT id, y FROM n)))"
    ", c AS (SELECT g.id, side, lo, hi, row_number() OVER (PARTITION BY g.id, side, lo ORDER BY x1 + ((lo + hi) / 2 - y1) * (x2 - x1) / (y2 - y1)) - 1 AS k, x1 + ((lo + hi) / 2 - y1) * (x2 - x1) / (y2 - y1) AS x"
    " FROM g JOIN h ON g.id = h.id AND least(y1, y2) < (lo + hi) / 2 AND (lo + hi) / 2 < greatest(y1, y2))"
    ", t AS (SELECT id, side, lo, hi, min(x) AS l, max(x) AS r FROM c GROUP BY id, side, lo, hi, k // 2)"
    ", z AS (SELECT id, sum((hi - lo) * (r - l)) FILTER (side = 'a') AS area_a, sum((hi - lo) * (r - l)) FILTER (side = 'b') AS area_b FROM t GROUP BY id)"
    ", w AS (SELECT a.id, sum((a.hi - a.lo) * greatest(least(a.r, b.r) - greatest(a.l, b.l), 0)) AS shared FROM t a JOIN t b ON a.id = b.id AND a.lo = b.lo AND a.side = 'a' AND b.side = 'b' GROUP BY a.id)"
)


@query(f"WITH {_DARTS} SELECT id, {sql6('area_a')} AS area_a, {sql6('area_b')} AS area_b, {sql6('coalesce(shared, 0) / (area_a + area_b - coalesce(shared, 0))')} AS iou FROM z LEFT JOIN w USING (id)")
def a46_polygon_iou_concave(spark, d):
    v = lambda i: F.element_at("v", i)
    a = F.array(v(1), v(2) + 2, v(1) + 1.5, v(2) - 1.5, v(1), v(2) - F.abs(v(3)), v(1) - 1.5, v(2) - 1.5)
    b = F.array(v(4) - 1.5, v(5) - 1, v(4) - F.abs(v(6)), v(5), v(4) - 1.5, v(5) + 1, v(4) + 2, v(5))
    rows = vectors(spark, d).select("id", a.alias("a"), b.alias("b"))
    return rows.select("id", r6(G.polygon_area("a")).alias("area_a"), r6(G.polygon_overlap("a", "b")["area_b"]).alias("area_b"), r6(G.polygon_iou("a", "b")).alias("iou"))


def _sizes(spark, d):
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), (F.col("p_size") + 20).alias("height"), (F.col("p_size") * 2 + 16).alias("width"))


_SIZES = "z AS (SELECT p_partkey AS id, p_size + 20 AS height, p_size * 2 + 16 AS width FROM part)"
_STARTS = "list_distinct(list_concat(range(0, CAST({0} - 16 + 1 AS BIGINT), 12), [CAST({0} - 16 AS BIGINT)]))"


@query(
    f"WITH {_SIZES}, t AS (SELECT id, height, width, y, unnest({_STARTS.format('width')}) AS x FROM (SELECT *, unnest({_STARTS.format('height')}) AS y FROM z))"
    " SELECT id, y, x, CAST(CASE WHEN y = 0 THEN y ELSE y + 2 END AS BIGINT) AS y0, CAST(CASE WHEN y + 16 >= height THEN height ELSE y + 14 END AS BIGINT) AS y1, CAST(CASE WHEN x = 0 THEN x ELSE x + 2 END AS BIGINT) AS x0, CAST(CASE WHEN x + 16 >= width THEN width ELSE x + 14 END AS BIGINT) AS x1 FROM t"
)
def f17_tile_boxes(spark, d):
    made = G.tile_boxes(_sizes(spark, d), 16, 12, pad=2)
    return made.select("id", *[F.col(c).cast("long").alias(c) for c in ("y", "x", "y0", "y1", "x0", "x1")])


@query(f"WITH {CELLS} SELECT id, h, w, {sql6('v')} AS v FROM c")
def f18_stitch_tiles(spark, d):
    """Grids cut into overlapping tiles and put together again."""
    c = cells(spark, d)
    boxes = G.tile_boxes(vectors(spark, d).select("id", F.lit(8).alias("height"), F.lit(8).alias("width")), 4, 2, pad=1)
    inside = boxes.join(c.select("id", "h", "w", "v"), "id").where("h >= y and h < y + 4 and w >= x and w < x + 4")
    values = F.transform(F.array_sort(F.collect_list(F.struct("h", "w", "v"))), lambda s: s["v"])
    tiles = inside.groupBy("id", "y", "x", "y0", "y1", "x0", "x1").agg(values.alias("values"))
    made = G.stitch_tiles(tiles, tile=4)
    return made.select("id", F.col("h").cast("long").alias("h"), F.col("w").cast("long").alias("w"), r6("v").alias("v"))


@query(f"WITH {_SIZES}, k AS (SELECT *, unnest(range(0, 10)) AS crop FROM z) SELECT id, crop, CAST(CASE crop % 5 WHEN 0 THEN 0 WHEN 1 THEN 0 WHEN 4 THEN (height - 12) // 2 ELSE height - 12 END AS BIGINT) AS top, CAST(CASE crop % 5 WHEN 0 THEN 0 WHEN 2 THEN 0 WHEN 4 THEN (width - 10) // 2 ELSE width - 10 END AS BIGINT) AS \"left\", crop >= 5 AS mirrored FROM k")
def f19_ten_crops(spark, d):
    made = G.ten_crops(_sizes(spark, d), 12, 10)
    return made.select("id", F.col("crop").cast("long").alias("crop"), F.col("top").cast("long").alias("top"), F.col("left").cast("long").alias("left"), "mirrored")


@query(
    "WITH b AS (SELECT l_orderkey * 100 + l_linenumber AS id, CAST(l_partkey % 60 AS DOUBLE) AS x1, CAST(l_suppkey % 50 AS DOUBLE) AS y1, l_partkey % 60 + l_quantity AS x2, l_suppkey % 50 + 4.0::DOUBLE * l_linenumber AS y2 FROM lineitem),"
    " s AS (SELECT *, (x2 - x1 + 1) / 2 AS hw, (y2 - y1 + 1) / 2 AS hh FROM b), t AS (SELECT id, x1 + hw AS cx, y1 + hh AS cy, greatest(hw, hh) AS r FROM s),"
    " q AS (SELECT id, round(cx - r * 1.25) AS a, round(cy - r * 1.25) AS b, round(cx + r * 1.25) AS c, round(cy + r * 1.25) AS e FROM t)"
    " SELECT id, CAST(greatest(a, 0) AS BIGINT) AS bx1, CAST(greatest(b, 0) AS BIGINT) AS by1, CAST(least(c, 99) AS BIGINT) AS bx2, CAST(least(e, 79) AS BIGINT) AS by2, CAST(greatest(-a, 0) AS BIGINT) AS pad_x1, CAST(greatest(-b, 0) AS BIGINT) AS pad_y1, CAST(greatest(c - 99, 0) AS BIGINT) AS pad_x2, CAST(greatest(e - 79, 0) AS BIGINT) AS pad_y2 FROM q"
)
def f20_context_box(spark, d):
    li = table(spark, d, "lineitem")
    x, y = (F.col("l_partkey") % 60).cast("double"), (F.col("l_suppkey") % 50).cast("double")
    rows = li.select((F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("id"), x.alias("x1"), y.alias("y1"), (x + F.col("l_quantity")).alias("x2"), (y + 4 * F.col("l_linenumber")).alias("y2"), F.lit(100).alias("width"), F.lit(80).alias("height"))
    made = G.context_box(rows, 50, 5, square=True)
    return made.select("id", *[F.col(c).cast("long").alias(c) for c in ("bx1", "by1", "bx2", "by2", "pad_x1", "pad_y1", "pad_x2", "pad_y2")])
