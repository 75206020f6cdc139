"""Queries of encodings, joins, sampling and sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.vectors import argmax_topk
from ..operators import joins as J
from ..operators import prep as P
from ..operators import sampling as S
from ..operators.scoring import parse_transforms
from ..sources import files as I
from .base import PREDS, VECTORS, images, preds, query, r6, rounded, sql6, table, vectors


def _docs(spark, d):
    return table(spark, d, "documents")


@query("SELECT doc_id, quality, toxic, coalesce(quality, -1) AS quality_label, coalesce(toxic, -1) AS toxic_label FROM documents LEFT JOIN labels USING (doc_id)")
def p1_select_labels(spark, d):
    rows = _docs(spark, d).select("doc_id").join(table(spark, d, "labels"), "doc_id", "left")
    return P.select_labels(rows, ["quality", "toxic"]).select("doc_id", *[F.col(c).cast("int").alias(c) for c in ("quality", "toxic", "quality_label", "toxic_label")])


@query("WITH v AS (SELECT source, row_number() OVER (ORDER BY min(doc_id)) - 1 AS code FROM documents GROUP BY source) SELECT doc_id, source, code AS source_code FROM documents JOIN v USING (source)")
def p2_encode_first_seen(spark, d):
    made, _ = P.encode_first_seen(_docs(spark, d).select("doc_id", "source"), "source", "doc_id")
    return made.select("doc_id", "source", F.col("source_code").cast("long").alias("source_code"))


@query("WITH o AS (SELECT source, row_number() OVER (ORDER BY min(doc_id)) - 1 AS code FROM documents WHERE lang = 'en' GROUP BY source), n AS (SELECT source, row_number() OVER (ORDER BY min(doc_id)) - 1 + (SELECT count(*) FROM o) AS code FROM documents WHERE source NOT IN (SELECT source FROM o) GROUP BY source) SELECT source AS value, code FROM o UNION ALL SELECT source, code FROM n")
def p2_grown_vocabulary(spark, d):
    rows = _docs(spark, d)
    made = P.vocabulary(rows, "source", "doc_id", P.vocabulary(rows.where("lang = 'en'"), "source", "doc_id"))
    return made.select("value", F.col("code").cast("long").alias("code"))


@query(f"SELECT doc_id, {sql6('TRY_CAST(CASE WHEN doc_id % 7 = 0 THEN lang ELSE CAST(n_chars AS VARCHAR) END AS DOUBLE) * 0.01 - 0.5')} AS target FROM documents")
def p3_scale_target(spark, d):
    text = F.when(F.col("doc_id") % 7 == 0, F.col("lang")).otherwise(F.col("n_chars").cast("string"))
    return _docs(spark, d).select("doc_id", r6(P.scale_target(text, 0.01, -0.5)).alias("target"))


_SUB = "CASE lang WHEN 'en' THEN 0.0 WHEN 'de' THEN 0.5 WHEN 'fr' THEN 1.0 END"


@query(f"SELECT doc_id, lang, CAST({_SUB} AS DOUBLE) AS lang_value, CASE WHEN {_SUB} IS NULL THEN 'lang: ' || lang END AS reason FROM documents")
def p4_substitute(spark, d):
    good, bad = P.substitute(_docs(spark, d).select("doc_id", "lang"), "lang", {"en": 0, "de": 0.5, "fr": 1})
    return good.withColumn("reason", F.lit(None).cast("string")).unionByName(bad)


@query("SELECT doc_id, CAST(n_chars > 500 AS INT) AS flag FROM documents")
def p5_binary_flag(spark, d):
    return _docs(spark, d).select("doc_id", P.binary_flag(F.when(F.col("n_chars") > 500, "Y").otherwise("N")).alias("flag"))


@query("SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'manual' WHEN doc_id % 10 < 4 THEN source || '-g' || doc_id % 10 WHEN doc_id % 6 < 3 THEN source || '-m' || doc_id % 6 ELSE '' END AS layout FROM documents")
def p6_choose_layout_type(spark, d):
    rows = _docs(spark, d).select("doc_id", F.col("source").alias("collection"), F.when(F.col("doc_id") % 5 == 0, "manual").otherwise("").alias("manual"), (F.col("doc_id") % 10).alias("gl_code"), (F.col("doc_id") % 6).alias("meta_code"))
    sources = rows.select("collection").distinct()
    make = lambda kind, n: sources.withColumn("code", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).select("collection", F.col("code").cast("long").alias("code"), F.concat("collection", F.lit(f"-{kind}"), F.col("code").cast("string")).alias("layout"))
    return P.choose_layout_type(rows, make("g", 4), make("m", 3)).select("doc_id", "layout")


@query("SELECT doc_id, source, (row_number() OVER (PARTITION BY source ORDER BY n_chars, doc_id) - 1) // 10 AS group_no FROM documents")
def p7_group_number(spark, d):
    made = P.group_number(_docs(spark, d), "source", ["n_chars", "doc_id"], 10)
    return made.select("doc_id", "source", F.col("group_no").cast("long").alias("group_no"))


@query("SELECT vec_id AS id, CAST(label AS BIGINT) AS label FROM embeddings WHERE vec_id % 3 <> 0 AND label <> 4")
def p8_p9_selector_and_ignore(spark, d):
    from ..operators.metrics import drop_ignored

    rows = vectors(spark, d).withColumn("selector", F.col("id") % 3)
    return drop_ignored(P.filter_by_selector(rows, "selector"), "label", 4).select("id", "label")


_DRAW = "(((({k}) + {s}) % 2147483648 * 1103515245 + 12345) % 2147483648 // 8 * 1103515245 + 12345) % 2147483648"


def _draw(k: str, s: int, below: str = "") -> str:
    d = _DRAW.format(k=k, s=s)
    return f"({d}) // 64 % {below}" if below else f"({d})"


@query(f"SELECT vec_id AS id, CAST(label AS BIGINT) AS label FROM embeddings WHERE label < 6 ORDER BY {_draw('vec_id', 3)}, vec_id LIMIT 100")
def p10_subset(spark, d):
    return S.subset(vectors(spark, d).select("id", "label"), 6, 100, "id", 3)


@query("SELECT doc_id FROM documents WHERE text <> '' AND sha1(text) <> (SELECT min(sha1(text)) FROM documents)")
def p11_drop_bad_payloads(spark, d):
    rows = _docs(spark, d).select("doc_id", F.col("text").alias("content"))
    worst = rows.agg(F.min(F.sha1(F.col("content").cast("binary"))).alias("s")).first()["s"]
    return P.drop_bad_payloads(rows, worst or "").select("doc_id")


@query(f"SELECT doc_id, CASE WHEN {_draw('doc_id', 5, '1000')} < 200 THEN 'test' ELSE 'train' END AS split FROM documents")
def u5_split(spark, d):
    return S.split(_docs(spark, d).select("doc_id"), "doc_id", 0.2, 5)


_SIZE = "SELECT p_partkey AS id, CAST({h} AS BIGINT) AS new_h, CAST({w} AS BIGINT) AS new_w FROM ({rows})"
_SIZES = "SELECT p_partkey, CAST(p_size + 10 AS DOUBLE) AS h, CAST(p_size % 7 * 19 + 12 AS DOUBLE) AS w FROM part"


def _target(spark, d, spec, **o):
    rows = table(spark, d, "part").select(F.col("p_partkey").alias("id"), (F.col("p_size") + 10).alias("height"), (F.col("p_size") % 7 * 19 + 12).alias("width"))
    return P.target_size(rows, spec, **o).select("id", F.col("new_h").cast("long").alias("new_h"), F.col("new_w").cast("long").alias("new_w"))


def _side_sql(other: str, tall: str) -> str:
    """The other side, cut to a whole number, to the nearest multiple of 12 away from 64."""
    rows = f"SELECT p_partkey, {tall} AS tall, CAST(floor({other}) AS BIGINT) AS o FROM ({_SIZES})"
    rows = f"SELECT p_partkey, tall, o - (((o - 64) % 12) + 12) % 12 + CASE WHEN (((o - 64) % 12) + 12) % 12 >= 6 THEN 12 ELSE 0 END AS o FROM ({rows})"
    return _SIZE.format(h="CASE WHEN tall THEN 64 ELSE o END", w="CASE WHEN tall THEN o ELSE 64 END", rows=rows)


@query(_side_sql("greatest(least(h, w) * 64 / greatest(h, w), 64 / 1.5::DOUBLE)", "h >= w"))
def p13_target_size_long_side(spark, d):
    return _target(spark, d, "64l", truncate=1.5, ar_bin=12)


@query(_side_sql("least(greatest(h, w) * 64 / least(h, w), 64 * 1.5::DOUBLE)", "h <= w"))
def p13_target_size_short_side(spark, d):
    return _target(spark, d, "64s", truncate=1.5, ar_bin=12)


_AREA = (
    f"SELECT p_partkey, held, list_filter(list_transform(range(0, 20), lambda k: 0.5::DOUBLE + k * 0.25::DOUBLE), lambda g: g >= held)[1] AS up FROM (SELECT p_partkey, least(greatest(h / w, 0.5), 2.0)::DOUBLE AS held FROM ({_SIZES}))"
)
_AREA = f"SELECT p_partkey, CASE WHEN up - held > 0.125 THEN up - 0.25 ELSE up END AS r FROM ({_AREA})"
_AREA = f"SELECT p_partkey, r, list_filter(range(1, 400), lambda x: floor(r * x) * x >= 4096)[1] - 1 AS w FROM ({_AREA})"


@query(_SIZE.format(h="floor(r * w)", w="w", rows=_AREA))
def p13_target_size_area(spark, d):
    return _target(spark, d, "64a", ar_bin2=0.25)


@query("WITH f AS (SELECT length(text) AS n FROM documents ORDER BY doc_id LIMIT 1) SELECT doc_id AS key, length(text) AS size, n AS expected FROM documents, f WHERE length(text) <> n")
def p14_check_sizes(spark, d):
    made = P.check_sizes(_docs(spark, d), "text", "doc_id")
    return made.select(F.col("doc_id").alias("key"), F.col("size").cast("long").alias("size"), F.col("expected").cast("long").alias("expected"))


@query("SELECT page_id, lower(regexp_extract(url, '(\\.[^.]*)$', 1)) AS encoding FROM pages")
def p15_guess_encoding(spark, d):
    return table(spark, d, "pages").select("page_id", P.guess_encoding("url").alias("encoding"))


@query(f"WITH {VECTORS} SELECT id, label, {sql6('list_sum(v) + 2 * list_sum(x)')} AS weighed, CAST(74 AS BIGINT) AS n FROM s WHERE id % 5 <> 0")
def j1_stitch_sources(spark, d):
    rows = vectors(spark, d)
    other = rows.where("id % 5 <> 0").select("id", F.transform("x", lambda z: z * 2).alias("vec"), "label")
    made = J.stitch_sources([rows.select("id", F.col("v").alias("vec"), "label"), other])
    return made.select("id", "label", r6(F.aggregate("vec", F.lit(0.0), lambda s, z: s + z)).alias("weighed"), F.size("vec").cast("long").alias("n"))


@query("SELECT vec_id AS id, CASE WHEN vec_id % 5 = 0 THEN 1 ELSE 2 END::BIGINT AS present, CASE WHEN vec_id % 5 = 0 THEN 1 ELSE 2 END::BIGINT AS labels FROM embeddings WHERE vec_id % 5 = 0 OR vec_id % 7 = 0")
def j1_stitch_mismatches(spark, d):
    rows = vectors(spark, d)
    other = rows.where("id % 5 <> 0").withColumn("label", F.when(F.col("id") % 7 == 0, F.col("label") + 1).otherwise(F.col("label")))
    return J.stitch_mismatches([rows, other])


@query("WITH k AS (SELECT lang AS cls, row_number() OVER (ORDER BY lang) AS cls_id FROM documents GROUP BY lang) SELECT doc_id AS name, toxic AS pred, lang AS cls, cls_id FROM labels JOIN documents USING (doc_id) JOIN k ON k.cls = lang")
def j2_join_gt(spark, d):
    from pyspark.sql.window import Window

    classes = _docs(spark, d).groupBy(F.col("lang").alias("cls")).count().select("cls", F.row_number().over(Window.orderBy("cls")).cast("long").alias("cls_id"))
    gt = _docs(spark, d).select(F.col("doc_id").alias("name"), F.col("lang").alias("cls"))
    preds_ = table(spark, d, "labels").select(F.col("doc_id").alias("name"), F.col("toxic").alias("pred"))
    return J.join_gt(preds_, gt, classes)


@query(f"WITH {VECTORS}, q AS (SELECT id // 4 AS id, id % 4 AS t, v FROM s) SELECT a.id, a.t AS transform, {sql6('list_sum(list_transform(range(1, 65), lambda i: a.v[i] * b.v[i]))')} AS dot FROM q a JOIN q b ON a.id = b.id AND b.t = 0")
def j3_pair_with_base(spark, d):
    from ..functions.vectors import dot
    from ..operators.compare import pair_with_base

    rows = preds(spark, d).select(F.floor(F.col("id") / 4).alias("id"), (F.col("id") % 4).alias("transform"), F.col("v").alias("vec"), "probs")
    return pair_with_base(rows, 0).select("id", "transform", r6(dot("vec", "vec0")).alias("dot"))


@query(
    f"WITH r AS (SELECT vec_id AS id, label, row_number() OVER (ORDER BY vec_id) - 1 AS idx, count(*) OVER () AS n FROM embeddings), q AS (SELECT i AS pair, {_draw('i * 2', 9, 'n')} AS a, {_draw('i * 2 + 1', 9, 'n')} AS b FROM (SELECT unnest(range(0, (SELECT CAST(count(*) AS BIGINT) * 2 FROM embeddings))) AS i), (SELECT count(*) AS n FROM embeddings))"
    " SELECT q.pair, x.id AS a, y.id AS b, CAST(x.label = y.label AS INT) AS similar_label FROM q JOIN r x ON x.idx = q.a JOIN r y ON y.idx = q.b"
)
def j4_make_pairs(spark, d):
    rows = vectors(spark, d)
    return S.make_pairs(rows, 2 * rows.count(), "id", seed=9).withColumnRenamed("similar", "similar_label")


@query("SELECT o_orderkey AS image_index, o_custkey AS owner, l_linenumber AS \"window\", l_quantity AS overlap FROM orders JOIN lineitem ON l_orderkey = o_orderkey")
def j7_join_windows(spark, d):
    im = table(spark, d, "orders").select(F.col("o_orderkey").alias("image_index"), F.col("o_custkey").alias("owner"))
    w = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("image_index"), F.col("l_linenumber").alias("window"), F.col("l_quantity").alias("overlap"))
    return J.join_windows(im, w)


@query("SELECT 'i' || doc_id AS item, n_chars, toxic, quality FROM documents JOIN labels USING (doc_id)")
def j10_match_triples(spark, d):
    path = lambda folder, ext: F.concat(F.lit(folder), F.col("doc_id").cast("string"), F.lit(ext)).alias("path")
    docs, labels = _docs(spark, d), table(spark, d, "labels")
    return J.match_triples(docs.select(path("a/b/i", ".png"), "n_chars"), labels.select(path("gt/i", ".txt"), "toxic"), labels.select(path("i", ""), "quality"))


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def j11_pending(spark, d):
    return J.pending(_docs(spark, d).select("doc_id"), table(spark, d, "labels"), ["doc_id"])


_TOP = "list_reverse_sort(list_transform(range(1, 11), lambda i: {'v': probs[i], 'i': i - 1}))[1:3]"


@query(f"WITH {PREDS}, t AS (SELECT id, {_TOP} AS t FROM p), u AS (SELECT id, CAST(k AS BIGINT) AS rank, CAST(t[k].i AS BIGINT) AS cls, t[k].v AS p FROM t, (SELECT unnest(range(1, 4)) AS k)), n AS (SELECT DISTINCT CAST(label AS BIGINT) AS cls, 'class ' || label AS name FROM embeddings) SELECT id, rank, cls, {sql6('p')} AS p, name FROM u LEFT JOIN n USING (cls)")
def t6_j12_top_predictions(spark, d):
    names = vectors(spark, d).select(F.col("label").alias("cls"), F.concat(F.lit("class "), F.col("label").cast("string")).alias("name")).distinct()
    top = preds(spark, d).select("id", F.posexplode(argmax_topk("probs", 3, with_values=True)).alias("k", "t"))
    top = top.select("id", (F.col("k") + 1).cast("long").alias("rank"), F.col("t.i").cast("long").alias("cls"), r6("t.v").alias("p"))
    return J.label_names(top, names).select("id", "rank", "cls", "p", "name")


@query(
    f"WITH {PREDS}, sc AS (SELECT id, i - 1 AS leaf, probs[i] AS p FROM p, (SELECT unnest(range(1, 11)) AS i)), pm AS (SELECT leaf, unnest([leaf, 100 + leaf // 2, 200 + leaf // 5, 300]) AS node, unnest([1.0, 1.0, 1.0, 1.0]) AS w FROM (SELECT unnest(range(0, 10)) AS leaf)),"
    f" m AS (SELECT id, node, sum(p * w) AS mass FROM sc JOIN pm USING (leaf) GROUP BY ALL), g AS (SELECT id, node, mass * (3.5 - node // 100 - 0.1 * (node % 3)) AS gain FROM m), r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY gain DESC, node) AS rank FROM g) SELECT id, rank, CAST(node AS BIGINT) AS node, {sql6('gain')} AS gain FROM r WHERE rank <= 5"
)
def j13_hedged_topk(spark, d):
    scores = preds(spark, d).select("id", F.posexplode("probs").alias("leaf", "p")).withColumn("leaf", F.col("leaf").cast("long"))
    leaves = scores.select("leaf").distinct()
    n = F.col("leaf")
    nodes_of = leaves.select("leaf", F.explode(F.array(n, F.floor(n / 2) + 100, F.floor(n / 5) + 200, F.lit(300).cast("long"))).alias("node")).withColumn("p_node", F.lit(1.0))
    nodes = nodes_of.select("node").distinct().select("node", (3.5 - F.floor(F.col("node") / 100)).cast("double").alias("infogain"), (F.col("node") % 3).cast("double").alias("preference"))
    made = J.hedged_topk(scores, nodes_of, nodes)
    return made.select("id", F.col("rank").cast("long").alias("rank"), "node", r6("gain").alias("gain"))


@query(f"SELECT doc_id, {_draw('doc_id', 11)} AS place FROM documents")
def t1_shuffle(spark, d):
    return S.shuffle(_docs(spark, d).select("doc_id"), "doc_id", 11).withColumn("place", S.draw("doc_id", 11))


@query(f"SELECT doc_id FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS r FROM documents) WHERE r >= {_draw('0', 4, '50')}")
def t5_rand_skip(spark, d):
    return S.rand_skip(_docs(spark, d).select("doc_id"), 50, "doc_id", 4)


@query(
    f"WITH r AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS place, {_draw('doc_id', 6, '5')} + 1 AS gap FROM documents), a AS (SELECT source, coalesce(sum(gap) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS at FROM r)"
    " SELECT source, doc_id FROM r WHERE EXISTS (SELECT 1 FROM a WHERE a.source = r.source AND a.at = r.place)"
)
def t5_thin(spark, d):
    return S.thin(_docs(spark, d).select("source", "doc_id"), "doc_id", 5, 6, "source")


@query(
    f"WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS place, {_draw('doc_id', 6, '5')} + 1 AS gap FROM documents), a AS (SELECT coalesce(sum(gap) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pick FROM r)"
    " SELECT doc_id FROM r WHERE place IN (SELECT pick FROM a)"
)
def t5_thin_whole(spark, d):
    return S.thin(_docs(spark, d).select("doc_id"), "doc_id", 5, 6)


@query("SELECT doc_id AS id, text, 'documents' AS origin FROM documents UNION ALL SELECT item_id, text, 'benchmark' FROM benchmark")
def u1_union_sources(spark, d):
    return J.union_sources({"documents": _docs(spark, d).select(F.col("doc_id").alias("id"), "text"), "benchmark": table(spark, d, "benchmark").select(F.col("item_id").alias("id"), "text")}, "origin")


@query("SELECT doc_id, 'left' AS side FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) UNION ALL SELECT DISTINCT doc_id, 'right' FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)")
def u2_key_diff(spark, d):
    return J.key_diff(_docs(spark, d), table(spark, d, "labels"), "doc_id")


@query(
    f"WITH r AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS idx, count(*) OVER (PARTITION BY source) AS size FROM documents), w AS (SELECT source, size, sum(size) OVER (ORDER BY source) / sum(size) OVER () AS hi, (sum(size) OVER (ORDER BY source) - size) / sum(size) OVER () AS lo FROM (SELECT source, count(*)::DOUBLE AS size FROM documents GROUP BY 1)),"
    f" b AS (SELECT i AS mix_batch, {_draw('i', 2)} / 2147483648.0::DOUBLE AS u FROM (SELECT unnest(range(0, 60)) AS i)), p AS (SELECT mix_batch, source, size, row_number() OVER (PARTITION BY source ORDER BY mix_batch) - 1 AS nth FROM b JOIN w ON u >= lo AND u < hi), q AS (SELECT mix_batch, source, slot, CAST((nth * 8 + slot) % size AS BIGINT) AS at FROM p, (SELECT unnest(range(0, 8)) AS slot))"
    " SELECT mix_batch, slot, q.source, doc_id FROM q JOIN r ON r.source = q.source AND r.idx = q.at"
)
def u3_mix_sources(spark, d):
    made = S.mix_sources(_docs(spark, d).select("source", "doc_id"), None, 60, 8, "doc_id", seed=2)
    return made.select("mix_batch", F.col("slot").cast("long").alias("slot"), "source", "doc_id")


@query(
    f"WITH f AS (SELECT vec_id AS id, label, row_number() OVER (ORDER BY vec_id) - 1 AS idx, count(*) OVER () AS n FROM embeddings WHERE label <> 0), g AS (SELECT vec_id AS id, label, row_number() OVER (ORDER BY vec_id) - 1 AS idx, count(*) OVER () AS n FROM embeddings WHERE label = 0), s AS (SELECT i // 16 AS batch, i % 16 AS slot FROM (SELECT unnest(range(0, 640)) AS i))"
    f" SELECT batch, slot, id, CAST(label AS BIGINT) AS label FROM s JOIN f ON idx = {_draw('batch * 16 + slot', 9, 'n')} WHERE slot < 4 UNION ALL SELECT batch, slot, id, label FROM s JOIN g ON idx = {_draw('batch * 16 + slot', 8, 'n')} WHERE slot >= 4"
)
def u4_sample_quota(spark, d):
    return S.sample_quota(vectors(spark, d).select("id", "label"), 40, 16, 0.25, "id", seed=8)


@query("SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS idx, (row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1) // 16 AS batch, (row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1) % 16 AS slot FROM documents")
def w10_assign_batches(spark, d):
    made = S.assign_batches(_docs(spark, d).select("source", "doc_id"), 16, "doc_id", "source")
    return made.select("source", "doc_id", *[F.col(c).cast("long").alias(c) for c in ("idx", "batch", "slot")])


_EPOCHS = "o AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS place, count(*) OVER (PARTITION BY source) AS size FROM documents), r AS (SELECT o.*, CAST(e AS BIGINT) AS epoch FROM o, (SELECT unnest(range(0, 3)) AS e))"


@query(f"WITH {_EPOCHS} SELECT source, doc_id, epoch, epoch * size + place AS idx, (epoch * size + place) // 16 AS batch, (epoch * size + place) % 16 AS slot FROM r")
def w10_batches_that_wrap(spark, d):
    made = S.assign_batches(_docs(spark, d).select("source", "doc_id"), 16, "doc_id", "source", epochs=3)
    return made.select("source", "doc_id", *[F.col(c).cast("long").alias(c) for c in ("epoch", "idx", "batch", "slot")])


@query(f"WITH {_EPOCHS} SELECT source, doc_id, epoch, epoch * size + place AS idx, epoch * ((size + 15) // 16) + place // 16 AS batch, place % 16 AS slot FROM r")
def w10_batches_cut_off(spark, d):
    made = S.assign_batches(_docs(spark, d).select("source", "doc_id"), 16, "doc_id", "source", epochs=3, no_wrap=True)
    return made.select("source", "doc_id", *[F.col(c).cast("long").alias(c) for c in ("epoch", "idx", "batch", "slot")])


@query("SELECT doc_id, row_number() OVER (ORDER BY n_chars, doc_id) - 1 AS idx FROM documents")
def w10_global_index(spark, d):
    return S.with_index(_docs(spark, d).select("doc_id", "n_chars"), ["n_chars", "doc_id"]).select("doc_id", "idx")


@query("SELECT item_id AS image_index, 'p' || item_id AS path, CAST(3 AS BIGINT) AS channels, CAST(len(regexp_split_to_array(text, '\\s+')) AS BIGINT) AS n FROM benchmark")
def s5_windows_images(spark, d):
    return _windows(spark, d)[0].select(F.col("image_index").cast("long").alias("image_index"), "path", F.col("channels").cast("long").alias("channels"), F.col("n").cast("long").alias("n"))


@query(f"WITH w AS (SELECT item_id AS image_index, unnest(regexp_split_to_array(text, '\\s+')) AS w, generate_subscripts(regexp_split_to_array(text, '\\s+'), 1) - 1 AS i FROM benchmark) SELECT image_index, i AS \"window\", length(w) AS label, {sql6('i / 100')} AS overlap, i AS x1, i + 1 AS y1, i + 10 AS x2, i + 20 AS y2 FROM w")
def s5_windows(spark, d):
    w = _windows(spark, d)[1]
    return w.select("image_index", "window", "label", "overlap", "x1", "y1", "x2", "y2").select(*[F.col(c).cast("long").alias(c) for c in ("image_index", "window", "label", "x1", "y1", "x2", "y2")], r6("overlap").alias("overlap"))


def _windows(spark, d):
    """Window-file blocks with a window for each word of a benchmark item."""
    words = F.split("text", r"\s+")
    line = F.transform(words, lambda w, i: F.concat_ws(" ", F.length(w).cast("string"), (i / 100).cast("string"), i.cast("string"), (i + 1).cast("string"), (i + 10).cast("string"), (i + 20).cast("string")))
    text = F.concat_ws("\n", F.col("item_id").cast("string"), F.concat(F.lit("p"), F.col("item_id").cast("string")), F.lit("3"), F.lit("80"), F.lit("90"), F.size(words).cast("string"), F.array_join(line, "\n"))
    return I.parse_windows(table(spark, d, "benchmark").select(text.alias("value")))


@query(f"SELECT doc_id, f.key AS field, f.value AS value FROM (SELECT doc_id, unnest([{{'key': 'Language', 'value': lang}}, {{'key': 'Source', 'value': source}}, {{'key': 'Size', 'value': CAST(n_chars AS VARCHAR)}}]) AS f FROM documents)")
def s6_sidecars(spark, d):
    files = _docs(spark, d).select(F.col("doc_id").cast("string").alias("path"), F.concat(F.lit("Language,Source,Size\n"), F.concat_ws(",", "lang", "source", F.col("n_chars").cast("string"))).alias("value"))
    return I.parse_sidecars(files).select(F.col("path").cast("long").alias("doc_id"), F.explode("fields").alias("field", "value"))


@query(f"WITH {VECTORS} SELECT 'i' || id AS name, {sql6('list_sum(x)')} AS total, CAST(10 AS BIGINT) AS n FROM s")
def s7_predictions(spark, d):
    lines = vectors(spark, d).select(F.concat_ws(" ", F.concat(F.lit("i"), F.col("id").cast("string")), F.array_join(F.transform("x", lambda z: z.cast("string")), " ")).alias("value"))
    return I.parse_predictions(lines).select("name", r6(F.aggregate("probs", F.lit(0.0), lambda s, z: s + z)).alias("total"), F.size("probs").cast("long").alias("n"))


@query(f"WITH {PREDS} SELECT id, label, {', '.join(sql6(f'probs[{i + 1}]') + f' AS class{i}' for i in range(10))} FROM p")
def s12_detection_table(spark, d):
    made = I.detection_table(preds(spark, d).select("id", "label", "probs"), 10)
    return rounded(made, ["id", "label"], [f"class{i}" for i in range(10)])


@query("SELECT source, doc_id FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS r FROM documents) WHERE r <= 3")
def s13_sample_per_class(spark, d):
    return I.sample_per_class(_docs(spark, d).select("source", "doc_id"), "source", "doc_id", 3)


@query("SELECT doc_id AS key, CAST(n_chars % 10 AS BIGINT) AS label, CAST(NULL AS INT) AS dbid, CAST(n_chars % 10 AS BIGINT) AS collection FROM documents")
def s14_record_round_trip(spark, d):
    rec = _docs(spark, d).select(F.col("doc_id").alias("key"), F.lit(1).alias("channels"), F.lit(1).alias("height"), F.lit(1).alias("width"), F.col("text").cast("binary").alias("data"), (F.col("n_chars") % 10).alias("label"))
    doc = I.record_to_doc(rec)
    back = I.doc_to_record(doc.withColumn("dbid", F.col("collection")))
    return back.select("key", "label").join(doc.select("key", "dbid", "collection"), "key")


@query("SELECT source, '{\"n\":' || count(*) || ',\"longest\":' || max(n_chars) || '}' AS json FROM documents GROUP BY source")
def f24_stats_json(spark, d):
    return I.stats_json(_docs(spark, d).groupBy("source").agg(F.count("*").alias("n"), F.max("n_chars").alias("longest")), "source")


@query("SELECT doc_id AS line_no, CAST(k AS BIGINT) AS step, CASE k WHEN 0 THEN 'crop' WHEN 1 THEN lang ELSE 'mirror' END AS op, CASE k WHEN 0 THEN CAST(n_chars AS VARCHAR) || ',8' ELSE '' END AS args, lang <> 'de' AS fixed FROM documents, (SELECT unnest(range(0, 3)) AS k)".replace("WHEN 1 THEN lang", "WHEN 1 THEN CASE WHEN lang = 'de' THEN 'dense' ELSE lang END"))
def f16_parse_transforms(spark, d):
    spec = F.format_string("Crop %d 8 ; %s;MIRROR # a comment", F.col("n_chars"), F.when(F.col("lang") == "de", "dense").otherwise(F.col("lang")))
    made = parse_transforms(_docs(spark, d).select(F.col("doc_id").alias("line_no"), spec.alias("value")))
    return made.select("line_no", F.col("step").cast("long").alias("step"), "op", F.array_join("args", ",").alias("args"), "fixed")


def _linear(x):
    import numpy as np

    w = (np.arange(x.shape[1])[:, None] * np.arange(1, 4)[None] % 7 - 3) / 10.0
    z = np.exp(x @ w - (x @ w).max(1, keepdims=True))
    return z / z.sum(1, keepdims=True)


_SCORE = VECTORS + ", z0 AS (SELECT id, label, list_transform(range(1, 4), lambda j: list_sum(list_transform(range(0, 64), lambda i: v[i + 1] * ((i * j) % 7 - 3) / 10.0))) AS z FROM s), pr AS (SELECT id, label, list_transform(z, lambda a: exp(a - list_max(z)) / list_sum(list_transform(z, lambda b: exp(b - list_max(z))))) AS q FROM z0)"


@query(f"WITH {_SCORE} SELECT id, {sql6('q[1]')} AS p0, {sql6('q[2]')} AS p1, {sql6('q[3]')} AS p2 FROM pr")
def d1_score(spark, d):
    from ..operators.scoring import score

    made = score(vectors(spark, d).select("id", "v"), _linear, vec="v")
    return made.select("id", *[r6(F.element_at("probs", i + 1)).alias(f"p{i}") for i in range(3)])


@query(f"WITH {_SCORE} SELECT printf('%010d', id) AS key, 'probs' AS name, {sql6('q[1] + 2 * q[2] + 3 * q[3]')} AS weighed FROM pr UNION ALL SELECT printf('%010d', id), 'head', {sql6('v[1] + 2 * v[2]')} FROM s")
def d2_extract_features(spark, d):
    from ..operators.scoring import extract_features

    made = extract_features(vectors(spark, d), lambda x: {"probs": _linear(x), "head": x[:, :2]}, ["probs", "head"], vec="v")
    weighed = lambda n: made[n].select("key", F.lit(n).alias("name"), r6(F.aggregate(F.transform("vec", lambda z, i: z * (i + 1)), F.lit(0.0), lambda s, z: s + z)).alias("weighed"))
    return weighed("probs").unionByName(weighed("head"))


@query(f"WITH {VECTORS} SELECT printf('%010d', id) AS key, CAST(c AS BIGINT) AS channel, {sql6('list_max(v[16 * c + 1:16 * c + 16])')} AS top FROM s, (SELECT unnest(range(0, 4)) AS c)")
def d2_extract_features_pooled(spark, d):
    """Each embedding as 4 channels of 4 by 4: the largest value of each."""
    from ..operators.scoring import extract_features

    made = extract_features(vectors(spark, d), lambda x: {"grid": x.reshape(-1, 4, 4, 4)}, ["grid"], vec="v", pool=True)["grid"]
    return made.select("key", F.posexplode("vec").alias("channel", "top")).select("key", F.col("channel").cast("long").alias("channel"), r6("top").alias("top"))


def _tiles(spark, d):
    from ..operators.geometry import tile_boxes

    im = images(spark, d)
    boxes = tile_boxes(im.select("key", "label", "height", "width", "pixels"), 4, 4)
    values = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda r: F.slice("pixels", ((F.col("y") + r) * 8 + F.col("x") + 1).cast("int"), 4)))
    return boxes.select("key", "label", "y", "x", values.alias("values"))


def _bright(x):
    import numpy as np

    m = x.mean(1) / 255
    return np.stack([1 - m, m], 1)


@query("WITH px AS (SELECT vec_id AS key, CAST(i - 1 AS BIGINT) AS pos, floor(greatest(0.0, least(255.0, (CAST(embedding[i] AS DOUBLE) + 3.0) * 42.5))) AS v FROM embeddings, (SELECT unnest(range(1, 65)) AS i)) SELECT key, CAST(k AS BIGINT) AS cls, round(CASE WHEN k = 1 THEN avg(v) / 255 ELSE 1 - avg(v) / 255 END, 6) + 0.0 AS p FROM px, (SELECT unnest(range(0, 2)) AS k) GROUP BY key, k")
def d4_predict_tiled(spark, d):
    from ..operators.scoring import predict_tiled

    made = predict_tiled(_tiles(spark, d), _bright, key="key")
    return made.select("key", F.col("cls").cast("long").alias("cls"), r6("p").alias("p"))


@query("WITH px AS (SELECT vec_id AS key, i AS pos, floor(greatest(0.0, least(255.0, (CAST(embedding[i] AS DOUBLE) + 3.0) * 42.5))) AS v FROM embeddings, (SELECT unnest(range(1, 65)) AS i)) SELECT key, CAST(count(*) AS BIGINT) AS n, sum(pos * (255 - v)) AS weighed FROM px GROUP BY key")
def d4_predict_stitched(spark, d):
    """Negatives of the pictures, made a tile of 5 by 5 at a time; a pixel's place counts in the sum."""
    from ..operators.scoring import predict_stitched

    made = predict_stitched(images(spark, d), lambda x: 255 - x, 5, 3, 1)
    weighed = F.aggregate(F.transform("pixels", lambda v, i: v * (i + 1)), F.lit(0.0), lambda s, v: s + v)
    return made.select("key", F.size("pixels").cast("long").alias("n"), weighed.alias("weighed"))


#: Pixels (0 to 255) of each embedding as an 8 by 8 picture.
_PX = "px AS (SELECT vec_id AS key, CAST(label AS BIGINT) AS label, CAST((i - 1) // 8 AS BIGINT) AS y, CAST((i - 1) % 8 AS BIGINT) AS x, floor(greatest(0.0, least(255.0, (CAST(embedding[i] AS DOUBLE) + 3.0) * 42.5))) AS v FROM embeddings, (SELECT unnest(range(1, 65)) AS i))"


def _axis(n: int, m: int) -> str:
    """(line, w): what each of n lines weighs in the sum over m lines made of them by bilinear resizing."""
    place = f"least(greatest((i + 0.5::DOUBLE) * {n} / {m} - 0.5, 0), {n - 1})"
    ends = f"SELECT CAST(floor(a) AS BIGINT) AS lo, a - floor(a) AS f FROM (SELECT {place} AS a FROM (SELECT unnest(range(0, {m})) AS i))"
    return f"(SELECT line, sum(w) AS w FROM (SELECT lo AS line, 1 - f AS w FROM ({ends}) UNION ALL SELECT least(lo + 1, {n - 1}), f FROM ({ends})) GROUP BY line)"


def _sums(x):
    """A model: the sum of the values (exact for these pictures and sizes)."""
    return x.sum(1)[:, None]


@query(
    f"WITH {_PX} SELECT key AS image_index, CAST(sy AS BIGINT) AS y1, CAST(sx AS BIGINT) AS x1, CAST(sy + 5 AS BIGINT) AS y2, CAST(sx + 4 AS BIGINT) AS x2, sum(v * a.w * b.w) AS total"
    f" FROM (SELECT unnest([0, 3]) AS sy), (SELECT unnest([0, 4]) AS sx), {_axis(5, 4)} a, {_axis(4, 4)} b, px WHERE y = sy + a.line AND x = sx + b.line GROUP BY key, sy, sx"
)
def d3_detect(spark, d):
    from ..operators.scoring import detect

    im = images(spark, d).select(F.col("key").alias("image_index"), "height", "width", "pixels")
    win = im.select("image_index", F.inline(F.array(*[F.struct(F.lit(y).alias("y1"), F.lit(x).alias("x1"), F.lit(y + 5).alias("y2"), F.lit(x + 4).alias("x2")) for y in (0, 3) for x in (0, 4)])))
    made = detect(im, win, _sums, 4)
    return made.select("image_index", *[F.col(c).cast("long").alias(c) for c in ("y1", "x1", "y2", "x2")], F.element_at("probs", 1).alias("total"))


# the window (1, 1) to (4, 4) grows from -1 to 7, is 9 pixels at 8/9 of their size, so 0 to 6 stand from 1 on as 7 by 7; the ninth line is fill
@query(f"WITH {_PX} SELECT key AS image_index, sum(v) + 15 * 100 AS total FROM px WHERE y < 7 AND x < 7 GROUP BY key")
def d3_detect_context(spark, d):
    """Crops with context beyond the picture's corner, filled with 100."""
    from ..operators.scoring import detect

    im = images(spark, d).select(F.col("key").alias("image_index"), "height", "width", "pixels")
    win = im.select("image_index", *[F.lit(v).alias(c) for c, v in (("y1", 1), ("x1", 1), ("y2", 4), ("x2", 4))])
    return detect(im, win, _sums, 8, context_pad=2, mean=100.0).select("image_index", F.element_at("probs", 1).alias("total"))


@query(
    f"WITH {_PX}, t AS (SELECT key * 100 + (y // 4 * 4) * 10 + x // 4 * 4 AS patch, label % 2 AS label, avg(v) / 255 AS m FROM px GROUP BY ALL)"
    f" SELECT patch, label, {sql6('CASE WHEN label = 1 THEN m ELSE 1 - m END')} AS p FROM t ORDER BY patch LIMIT 1000"
)
def d5_label_patches(spark, d):
    from ..operators.scoring import label_patches

    t = _tiles(spark, d).select((F.col("key") * 100 + F.col("y") * 10 + F.col("x")).alias("patch"), (F.col("label") % 2).alias("label"), "values")
    return label_patches(t, _bright, 1000).select("patch", "label", r6("p").alias("p"))


@query()
def f21_augment(spark, d):
    from ..operators.scoring import augment

    made = augment(images(spark, d), ["none", "mirror", "crop 4 4 ; mirror", "randcrop 6 6", "shift 1 2", "gauss 5", "salt 0.1", "resize 5 7"], seed=3)
    return made.select("key", "transform", "height", "width", r6(F.aggregate("pixels", F.lit(0.0), lambda s, z: s + z)).alias("total"))


@query(f"WITH {_PX} SELECT key, CAST(25 AS BIGINT) AS n, {sql6('sum(v * a.w * b.w)')} AS total FROM px JOIN {_axis(8, 5)} a ON y = a.line JOIN {_axis(8, 5)} b ON x = b.line GROUP BY key")
def f22_resize_center_crop(spark, d):
    from ..operators.scoring import resize_center_crop

    return resize_center_crop(images(spark, d), 5).select("key", F.size("pixels").cast("long").alias("n"), r6(F.aggregate("pixels", F.lit(0.0), lambda s, z: s + z)).alias("total"))


class _Shift:
    """A user's operator: adds a constant to the values."""

    def __init__(self, by: float):
        self.by = by

    def setup(self) -> None:
        self.by = float(self.by)

    def shape(self) -> str:
        return "id long, total double"

    def forward(self, batch):
        import pandas as pd

        return pd.DataFrame({"id": batch["id"], "total": [float(sum(v)) + self.by for v in batch["x"]]})


@query(f"WITH {VECTORS} SELECT id, {sql6('list_sum(x) + 1.5')} AS total FROM s")
def d6_user_operator(spark, d):
    from ..operators.scoring import apply_op, register_op

    register_op("shift", _Shift)
    return rounded(apply_op(vectors(spark, d).select("id", "x"), "shift", 1.5), ["id"], ["total"])


class _Spread:
    """A user's aggregate: count, mean and variance of a column, by joining means and sums of squares."""

    def __init__(self, column: str):
        self.column = column

    def state(self) -> str:
        return "n long, mean double, m2 double"

    def shape(self) -> str:
        return "n long, mean double, variance double"

    def init(self):
        return 0, 0.0, 0.0

    def update(self, state, batch):
        x = batch[self.column].dropna().to_numpy(float)
        return self.merge(state, (len(x), x.mean(), ((x - x.mean()) ** 2).sum()) if len(x) else self.init())

    def merge(self, a, b):
        n = a[0] + b[0]
        if n == 0:
            return a
        gap = b[1] - a[1]
        return n, a[1] + gap * b[0] / n, a[2] + b[2] + gap * gap * a[0] * b[0] / n

    def finish(self, state):
        return state[0], state[1] if state[0] else None, state[2] / state[0] if state[0] else None


@query(f"SELECT l_returnflag, l_linestatus, count(*) AS n, {sql6('avg(l_discount)')} AS mean, {sql6('var_pop(l_discount)')} AS variance FROM lineitem GROUP BY ALL")
def d6_user_aggregate(spark, d):
    from ..operators.scoring import apply_aggregate, register_aggregate

    register_aggregate("spread", _Spread)
    rows = table(spark, d, "lineitem").select("l_returnflag", "l_linestatus", F.col("l_discount").cast("double").alias("x"))
    return rounded(apply_aggregate(rows, ["l_returnflag", "l_linestatus"], "spread", "x"), ["l_returnflag", "l_linestatus", "n"], ["mean", "variance"])


_CHOICE = f"{_PX}, u AS (SELECT *, {_draw('key', 21)} / 2147483648.0::DOUBLE * 8 AS u FROM px), t AS (SELECT *, CASE WHEN u < 5 THEN 'none' WHEN u < 7 THEN 'crop 4 4' ELSE 'mirror' END AS transform FROM u)"


@query(f"WITH {_CHOICE} SELECT key, transform, CAST(sqrt(count(*)) AS INT) AS height, sum(v * (x + 1)) AS total FROM (SELECT key, transform, y, v, CASE transform WHEN 'mirror' THEN 7 - x WHEN 'crop 4 4' THEN x - 2 ELSE x END AS x FROM t) WHERE transform <> 'crop 4 4' OR (x BETWEEN 0 AND 3 AND y BETWEEN 2 AND 5) GROUP BY key, transform")
def f21_random_choice(spark, d):
    """One of three transforms a picture, 5 to 2 to 1; columns count in the sum."""
    from ..operators.scoring import augment_choice

    made = augment_choice(images(spark, d), ["none", "crop 4 4", "salt 0.5", "mirror"], [5, 2, 0, 1], seed=21)
    total = F.aggregate(F.transform("pixels", lambda v, i: v * (i % F.col("width") + 1)), F.lit(0.0), lambda s, v: s + v)
    return made.select("key", "transform", "height", total.alias("total"))


_PHASES = f"{_PX}, o AS (SELECT vec_id AS key, 'train' AS phase, {_draw('vec_id * 3', 8, '4')} AS top, {_draw('vec_id * 3 + 1', 8, '4')} AS lft, {_draw('vec_id * 3 + 2', 8, '2')} = 1 AS mirrored FROM embeddings UNION ALL SELECT vec_id, 'test', 1, 1, {_draw('vec_id * 3 + 2', 8, '2')} = 1 FROM embeddings)"


@query(f"WITH {_PHASES} SELECT key, phase, CAST(top AS BIGINT) AS top, CAST(lft AS BIGINT) AS \"left\", mirrored, sum(v * (CASE WHEN mirrored THEN 4 - (x - lft) ELSE x - lft END + 5 * (y - top) + 1)) AS weighed FROM o JOIN px USING (key) WHERE y BETWEEN top AND top + 4 AND x BETWEEN lft AND lft + 4 GROUP BY key, phase, top, lft, mirrored")
def f21_phase_crop(spark, d):
    """Crops of 5 by 5 for training and for testing."""
    from ..operators.scoring import phase_crop

    weighed = F.aggregate(F.transform("pixels", lambda v, i: v * (i + 1)), F.lit(0.0), lambda s, v: s + v)
    one = lambda phase: phase_crop(images(spark, d), 5, phase, True, 8).select("key", F.lit(phase).alias("phase"), F.col("top").cast("long").alias("top"), F.col("left").cast("long").alias("left"), "mirrored", weighed.alias("weighed"))
    return one("train").unionByName(one("test"))
