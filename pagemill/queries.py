"""Registered queries over the driver's tables, with the same in DuckDB SQL.

documents stands for text layers (a line for each line break), embeddings for logits, quads and probability maps, pages for
file names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import ctc, geometry, layout, text
from .functions.text import SPACE
from .operators import batching

VOCABULARY = "abcdefg"
LETTERS = "etaoinshrdlu"
NBSP = " "


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _docs(spark, sf_dir):
    return _t(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "lang")


def _blocks(lines):
    """A text layer with a line of two spans and a box for each given line, and a picture block."""
    box = lambda n, i: F.array(F.lit(0.0), 12.0 * i, 6.0 * F.length(n), 12.0 * i + 10)
    spans = lambda n: F.transform(F.array(F.substring(n, F.lit(1), F.lit(5)), F.substring(n, F.lit(6), F.length(n))), lambda s: F.struct(s.alias("text")))
    told = F.transform(lines, lambda n, i: F.struct(box(n, i).alias("bbox"), spans(n).alias("spans")))
    none = F.slice(told, F.lit(1), F.lit(0))
    return F.array(F.struct(F.lit(0).alias("type"), told.alias("lines")), F.struct(F.lit(1).alias("type"), none.alias("lines")))


def _text_pages(docs, lines):
    page = docs.select("doc_id", layout.layer_regions(_blocks(lines)).alias("r"))
    return page.select("doc_id", F.lit(1).alias("page"), layout.method(F.col("r")).alias("method"), F.size("r").alias("n_results"), layout.page_text(F.col("r")).alias("page_text"))


def text_pages(spark, sf_dir):
    docs = _docs(spark, sf_dir)
    return _text_pages(docs, F.split("text", "\n"))


_STRIP = f"regexp_replace(regexp_replace(%s, '^{SPACE}+', ''), '{SPACE}+$', '')"
_LINES = f"list_filter(list_transform(string_split(%s, chr(10)), lambda x: {_STRIP % 'x'}), lambda x: x <> '')"
_PAGES = "SELECT doc_id, 1::INTEGER AS page, CASE WHEN len(l) > 0 THEN 'text' ELSE 'ocr' END AS method, len(l)::INTEGER AS n_results, coalesce(array_to_string(l, chr(10)), '') AS page_text FROM"
_DOCS = "(SELECT doc_id, coalesce(text, '') t, lang FROM documents)"
SQL: dict[str, str] = {}
SQL["text_pages"] = f"{_PAGES} (SELECT doc_id, {_LINES % 't'} l FROM {_DOCS})"


def _dirty(c):
    """Odd space round every line and blank lines between; every tenth document is blank."""
    odd = F.regexp_replace(c, "\n", f"\t\x1c\n {NBSP}\n{NBSP} ")
    return F.when(F.col("doc_id") % 10 == 0, f"{NBSP}\n\t \n").otherwise(F.concat(F.lit(f"{NBSP}\t"), odd))


def text_pages_dirty(spark, sf_dir):
    return _text_pages(_docs(spark, sf_dir), F.split(_dirty(F.col("text")), "\n"))


_DIRTY = "CASE WHEN doc_id % 10 = 0 THEN chr(160) || chr(10) || chr(9) || ' ' || chr(10) ELSE chr(160) || chr(9) || replace(t, chr(10), chr(9) || chr(28) || chr(10) || ' ' || chr(160) || chr(10) || chr(160) || ' ') END"
SQL["text_pages_dirty"] = f"{_PAGES} (SELECT doc_id, {_LINES % 'd'} l FROM (SELECT doc_id, {_DIRTY} d FROM {_DOCS}))"


def text_layer_lines(spark, sf_dir):
    r = _docs(spark, sf_dir).select("doc_id", F.posexplode(layout.layer_regions(_blocks(F.split("text", "\n")))).alias("region_ord", "r"))
    return r.select("doc_id", "region_ord", "r.text", "r.confidence")


SQL["text_layer_lines"] = f"SELECT doc_id, (i - 1)::INTEGER AS region_ord, l[i] AS text, 1.0::DOUBLE AS confidence FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) i FROM (SELECT doc_id, {_LINES % 't'} l FROM {_DOCS}))"


def page_method_routing(spark, sf_dir):
    docs = _docs(spark, sf_dir)
    of = docs.select("doc_id", layout.layer_regions(_blocks(F.split("text", "\n"))).alias("r"))
    own = of.where("doc_id % 10 <> 0").select("doc_id", layout.method(F.col("r")).alias("method"), F.size("r").alias("n_results"))
    forced = of.where("doc_id % 10 = 0").select("doc_id", layout.method(F.col("r"), True).alias("method"), F.lit(0).alias("n_results"))
    return own.unionByName(forced)


SQL["page_method_routing"] = f"SELECT doc_id, CASE WHEN doc_id % 10 <> 0 AND len(l) > 0 THEN 'text' ELSE 'ocr' END AS method, (CASE WHEN doc_id % 10 <> 0 THEN len(l) ELSE 0 END)::INTEGER AS n_results FROM (SELECT doc_id, {_LINES % 't'} l FROM {_DOCS})"


def suffix_dispatch(spark, sf_dir):
    n = F.col("page_id") % 5
    name = F.when(n == 0, F.concat("page_id", F.lit(".pdf"))).when(n == 1, F.concat("page_id", F.lit(".PDF"))).when(n == 2, F.concat("page_id", F.lit(".png"))).when(n == 3, F.concat("page_id", F.lit(".pdf.png"))).otherwise(".pdf")
    return _t(spark, sf_dir, "pages").select(text.file_kind(F.concat(F.lit("/in/"), name)).alias("kind")).groupBy("kind").agg(F.count("*").alias("n"))


SQL["suffix_dispatch"] = "SELECT kind, count(*) AS n FROM (SELECT CASE WHEN page_id % 5 IN (0, 1) THEN 'pdf' ELSE 'image' END AS kind FROM pages) GROUP BY kind"


def _logits(spark, sf_dir):
    x = F.transform("embedding", lambda v: v.cast("double"))
    return _t(spark, sf_dir, "embeddings").select("vec_id", F.array(*(F.slice(x, 8 * i + 1, 8) for i in range(8))).alias("logits"))


_STEPS = "SELECT vec_id, unnest(range(0, 8)) s, embedding[8 * s + 1:8 * s + 8]::DOUBLE[] t FROM embeddings"


def ctc_greedy_decode(spark, sf_dir):
    return _logits(spark, sf_dir).select("vec_id", ctc.text(F.col("logits"), VOCABULARY).alias("text"))


SQL["ctc_greedy_decode"] = f"WITH k AS (SELECT vec_id, s, list_position(t, list_max(t)) - 1 k FROM ({_STEPS})), g AS (SELECT *, lag(k) OVER (PARTITION BY vec_id ORDER BY s) p FROM k) SELECT vec_id, coalesce(string_agg(substr('{VOCABULARY}', (k + 1)::BIGINT, 1), '' ORDER BY s) FILTER (k < 7 AND p IS DISTINCT FROM k), '') AS text FROM g GROUP BY vec_id"


def ctc_confidence(spark, sf_dir):
    return _logits(spark, sf_dir).select("vec_id", F.round(ctc.confidence(F.col("logits")), 6).alias("confidence"))


SQL["ctc_confidence"] = f"SELECT vec_id, round(min(1 / list_sum(list_transform(t, lambda x: exp(x - list_max(t))))), 6) AS confidence FROM ({_STEPS}) GROUP BY vec_id"


def _targets(spark, sf_dir):
    """Logits with a target of 0 to 9 classes below the blank, some longer than the steps can spell."""
    target = F.transform(F.sequence(F.lit(0), F.lit(8)), lambda i: (F.col("vec_id") * (i + 3) % 23 % 7).cast("int"))
    return _logits(spark, sf_dir).select("vec_id", "logits", F.slice(target, F.lit(1), (F.col("vec_id") % 10).cast("int")).alias("target"))


def ctc_loss(spark, sf_dir):
    x = _targets(spark, sf_dir)
    return x.select("vec_id", F.size("target").alias("n"), F.round(ctc.loss(F.col("logits"), F.col("target"), 7), 6).alias("loss"))


def ctc_loss_mean(spark, sf_dir):
    x = _targets(spark, sf_dir).withColumn("loss", ctc.loss(F.col("logits"), F.col("target"), 7))
    return x.select(F.round(ctc.mean_loss(F.col("loss"), F.col("target")), 6).alias("loss"))


# by probabilities, not logarithms, and a row for each step: eight steps cannot underflow
_LOSS = f"""
WITH RECURSIVE v AS (SELECT vec_id, list_slice(list_transform(range(0, 9), lambda i: (vec_id * (i + 3) % 23 % 7)::INTEGER), 1, vec_id % 10) AS target FROM embeddings),
m AS (SELECT vec_id, len(target)::INTEGER n, list_concat([7], flatten(list_transform(target, lambda c: [c, 7]))) m FROM v),
p AS (SELECT vec_id, s, list_transform(t, lambda x: exp(x) / list_sum(list_transform(t, lambda y: exp(y)))) p FROM ({_STEPS})),
a AS (
  SELECT vec_id, n, m, 0 s, list_transform(range(1, len(m) + 1), lambda i: CASE WHEN i <= 2 THEN p[m[i] + 1] ELSE 0.0 END) a FROM m JOIN p USING (vec_id) WHERE p.s = 0
  UNION ALL
  SELECT a.vec_id, n, m, a.s + 1, list_transform(range(1, len(m) + 1), lambda i: p[m[i] + 1] * (a.a[i] + CASE WHEN i > 1 THEN a.a[i - 1] ELSE 0.0 END + CASE WHEN i > 2 AND m[i] <> 7 AND m[i] <> m[i - 2] THEN a.a[i - 2] ELSE 0.0 END))
  FROM a JOIN p ON p.vec_id = a.vec_id AND p.s = a.s + 1
), e AS (SELECT vec_id, n, a[len(m)] + CASE WHEN n > 0 THEN a[len(m) - 1] ELSE 0.0 END q FROM a WHERE s = 7),
l AS (SELECT vec_id, n, CASE WHEN q > 0 THEN -ln(q) ELSE 0.0 END loss FROM e)
"""
SQL["ctc_loss"] = _LOSS + "SELECT vec_id, n, round(loss, 6) AS loss FROM l"
SQL["ctc_loss_mean"] = _LOSS + "SELECT round(avg(loss / greatest(n, 1)), 6) AS loss FROM l"


def ctc_encode_targets(spark, sf_dir):
    codes = text.encode_targets(F.col("text"), LETTERS)
    return _docs(spark, sf_dir).select("doc_id", F.size(codes).alias("n"), F.array_join(codes.cast("array<string>"), ",").alias("codes"))


SQL["ctc_encode_targets"] = f"SELECT doc_id, len(c)::INTEGER AS n, coalesce(array_to_string(list_transform(c, lambda x: (instr('{LETTERS}', x) - 1)::VARCHAR), ','), '') AS codes FROM (SELECT doc_id, list_filter(string_split(t, ''), lambda x: x <> '' AND instr('{LETTERS}', x) > 0) c FROM {_DOCS})"


def _quads(spark, sf_dir, of=lambda v, i: v.cast("double")):
    """Every eight values of a vector as a quad."""
    each = _t(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(F.transform(F.sequence(F.lit(0), (F.size("embedding") / 8).cast("int") - 1), lambda k: F.slice("embedding", k * 8 + 1, 8))).alias("quad", "v"))
    return each.select("vec_id", "quad", geometry.points(F.transform("v", of)).alias("q"))


def quad_order_points(spark, sf_dir):
    q = _quads(spark, sf_dir).select("vec_id", "quad", F.posexplode(geometry.order_points(F.col("q"))).alias("corner", "p"))
    return q.select("vec_id", "quad", "corner", "p.x", "p.y")


_POINTS = "SELECT vec_id, (j // 4)::INTEGER quad, j % 4 i, embedding[2 * j + 1]::DOUBLE x, embedding[2 * j + 2]::DOUBLE y FROM (SELECT vec_id, embedding, unnest(range(0, len(embedding) // 2)) j FROM embeddings)"
_ORDER = "WITH p AS ({}), a AS (SELECT *, row_number() OVER (PARTITION BY vec_id, quad ORDER BY y, i) r FROM p), b AS (SELECT *, row_number() OVER (PARTITION BY vec_id, quad, r > 2 ORDER BY x, y, i) k FROM a) SELECT vec_id, quad, (CASE WHEN r <= 2 THEN k - 1 ELSE 4 - k END)::INTEGER AS corner, {} FROM b"
SQL["quad_order_points"] = _ORDER.format(_POINTS, "x, y")


def quad_order_ties(spark, sf_dir):
    q = _quads(spark, sf_dir, lambda v, i: F.floor(v.cast("double") * F.when(i % 2 == 0, 10).otherwise(4)))
    return q.select("vec_id", "quad", F.posexplode(geometry.order_points(F.col("q"))).alias("corner", "p")).select("vec_id", "quad", "corner", "p.i")


# within a half points come in order of x, then of input
SQL["quad_order_ties"] = _ORDER.format("SELECT vec_id, quad, i, floor(x * 10) x, floor(y * 4) y FROM (" + _POINTS + ")", "i::INTEGER AS i").replace("ORDER BY x, y, i", "ORDER BY x, i")


def quad_shoelace_area(spark, sf_dir):
    return _quads(spark, sf_dir).select("vec_id", "quad", F.round(geometry.area(F.col("q")), 9).alias("area"))


_NEXT = "SELECT *, lead(x, 1, f) OVER w nx, lead(y, 1, g) OVER w ny FROM (SELECT *, first_value(x) OVER w f, first_value(y) OVER w g FROM p WINDOW w AS (PARTITION BY vec_id, quad ORDER BY i)) WINDOW w AS (PARTITION BY vec_id, quad ORDER BY i)"
SQL["quad_shoelace_area"] = f"WITH p AS ({_POINTS}), n AS ({_NEXT}) SELECT vec_id, quad, round(abs(sum(x * ny - nx * y)) / 2, 9) AS area FROM n GROUP BY vec_id, quad"


def unclip_distance(spark, sf_dir):
    return _quads(spark, sf_dir, lambda v, i: v.cast("double") * 100).select("vec_id", "quad", F.round(geometry.unclip_distance(F.col("q")), 6).alias("distance"))


SQL["unclip_distance"] = f"WITH p AS (SELECT vec_id, quad, i, x * 100 x, y * 100 y FROM ({_POINTS})), n AS ({_NEXT}), a AS (SELECT vec_id, quad, abs(sum(x * ny - nx * y)) / 2 a, sum(sqrt(pow(x - nx, 2) + pow(y - ny, 2))) l FROM n GROUP BY vec_id, quad) SELECT vec_id, quad, CASE WHEN a < 1 OR l < 1 THEN 0.0 ELSE round(a * 2.44 / l, 6) END AS distance FROM a"


def rescale_clip(spark, sf_dir):
    v = geometry.rescale_clip(F.col("v").cast("double") * 4000, 640 / 672, 640)
    return _t(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("i", "v")).select("vec_id", "i", F.round(v, 6).alias("v"))


SQL["rescale_clip"] = "SELECT vec_id, (i - 1)::INTEGER AS i, round(greatest(0.0, least(embedding[i]::DOUBLE * 4000 * (640.0::DOUBLE / 672), 640.0)), 6) AS v FROM (SELECT vec_id, embedding, unnest(range(1, len(embedding) + 1)) i FROM embeddings)"


def crop_bounds(spark, sf_dir):
    return _quads(spark, sf_dir, lambda v, i: v.cast("double") * 1000).select("vec_id", "quad", geometry.crop_bounds(F.col("q"), 640, 480).alias("b")).select("vec_id", "quad", "b.*")


SQL["crop_bounds"] = f"SELECT *, x1 <= x0 OR y1 <= y0 AS empty FROM (SELECT vec_id, quad, greatest(0, least(min(trunc(x * 1000)::INTEGER), 640)) AS x0, greatest(0, least(min(trunc(y * 1000)::INTEGER), 480)) AS y0, greatest(0, least(max(trunc(x * 1000)::INTEGER), 640)) AS x1, greatest(0, least(max(trunc(y * 1000)::INTEGER), 480)) AS y1 FROM ({_POINTS}) GROUP BY vec_id, quad)"


def ceil32_scale(spark, sf_dir):
    h = F.col("n_chars")
    return _t(spark, sf_dir, "documents").select("doc_id", geometry.ceil32(h).alias("h32"), F.round(geometry.ratio(h, geometry.ceil32(h)), 9).alias("scale"))


SQL["ceil32_scale"] = "SELECT doc_id, (n_chars + 31) // 32 * 32 AS h32, round(n_chars::DOUBLE / ((n_chars + 31) // 32 * 32), 9) AS scale FROM documents"


def _widths(spark, sf_dir):
    return _t(spark, sf_dir, "documents").select("doc_id", "lang", geometry.recognizer_width(F.col("n_chars"), 8 + F.col("doc_id") % 57).alias("w"))


_WIDTHS = "SELECT doc_id, lang, greatest(8, trunc(n_chars * (32.0::DOUBLE / (8 + doc_id % 57)))::INTEGER) AS w FROM documents"


def recog_width(spark, sf_dir):
    return _widths(spark, sf_dir).select("doc_id", "w")


def width_bucket(spark, sf_dir):
    return batching.width_buckets(_widths(spark, sf_dir), ["lang"], "w", "doc_id")


def bucket_padding(spark, sf_dir):
    return batching.bucket_padding(width_bucket(spark, sf_dir), ["lang"]).select("doc_id", "bucket", "padding")


_BUCKETS = f"SELECT *, ((row_number() OVER (PARTITION BY lang ORDER BY w, doc_id) - 1) // 4)::INTEGER AS bucket FROM ({_WIDTHS})"
SQL["recog_width"] = f"SELECT doc_id, w FROM ({_WIDTHS})"
SQL["width_bucket"] = _BUCKETS
SQL["bucket_padding"] = f"SELECT doc_id, bucket, max(w) OVER (PARTITION BY lang, bucket) - w AS padding FROM ({_BUCKETS})"


def region_score_filter(spark, sf_dir):
    cells = _t(spark, sf_dir, "embeddings").select("vec_id", F.explode(F.transform("embedding", lambda v: (v.cast("double") + 1) / 2)).alias("p"))
    return batching.score_filter(cells, ["vec_id"], "p", 0.5, 28, 0.54).select("vec_id", "n", F.round("score", 6).alias("score"))


SQL["region_score_filter"] = "SELECT vec_id, n, round(score, 6) AS score FROM (SELECT vec_id, count(*) n, sum(p) / (count(*) + 1e-6) score FROM (SELECT vec_id, unnest(list_transform(embedding, lambda x: (x::DOUBLE + 1) / 2)) p FROM embeddings) WHERE p > 0.5 GROUP BY vec_id) WHERE n >= 28 AND score >= 0.54"


def zip_truncate(spark, sf_dir):
    """All words of a text with 1 to 700 numbers, so that either side can be the shorter."""
    left = F.sequence(F.lit(0), (F.col("doc_id") * 37 % 700).cast("int"))
    z = _docs(spark, sf_dir).select("doc_id", left.alias("a"), F.split("text", "[ \n]+").alias("b")).select("doc_id", F.explode(batching.zip_shorter(F.col("a"), F.col("b"))).alias("z"))
    return z.select("doc_id", F.col("z.a").alias("ord"), F.col("z.b").alias("word"))


SQL["zip_truncate"] = f"SELECT doc_id, (i - 1)::INTEGER AS ord, w[i] AS word FROM (SELECT doc_id, w, unnest(range(1, least(doc_id * 37 % 700 + 1, len(w)) + 1)) i FROM (SELECT doc_id, regexp_split_to_array(t, '[ \\n]+') w FROM {_DOCS}))"


def scatter_default(spark, sf_dir):
    found = _t(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("string").alias("text"), F.col("toxic").cast("double").alias("confidence"))
    return batching.fill_defaults(_t(spark, sf_dir, "documents").select("doc_id"), found, ["doc_id"])


SQL["scatter_default"] = "SELECT d.doc_id, coalesce(l.quality::VARCHAR, '') AS text, coalesce(l.toxic::DOUBLE, 0.0) AS confidence FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id"


def bbox_to_quad(spark, sf_dir):
    """Every four values of a vector as a box."""
    each = _t(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(F.transform(F.sequence(F.lit(0), (F.size("embedding") / 4).cast("int") - 1), lambda k: F.slice(F.transform("embedding", lambda v: v.cast("double")), k * 4 + 1, 4))).alias("box", "v"))
    q = each.select("vec_id", "box", F.posexplode(geometry.bbox_quad(F.col("v"))).alias("corner", "p"))
    return q.select("vec_id", "box", "corner", F.col("p")[0].alias("x"), F.col("p")[1].alias("y"))


SQL["bbox_to_quad"] = "SELECT vec_id, b::INTEGER AS box, (c - 1)::INTEGER AS corner, embedding[4 * b + [1, 3, 3, 1][c]]::DOUBLE AS x, embedding[4 * b + [2, 2, 4, 4][c]]::DOUBLE AS y FROM (SELECT vec_id, embedding, b, unnest(range(1, 5)) c FROM (SELECT vec_id, embedding, unnest(range(0, len(embedding) // 4)) b FROM embeddings))"


def pad_right(spark, sf_dir):
    x = F.transform(F.col("embedding"), lambda v: v.cast("double"))
    return _t(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(geometry.pad_right(x, (60 + F.col("vec_id") % 9).cast("int"))).alias("i", "v"))


SQL["pad_right"] = "SELECT vec_id, (i - 1)::INTEGER AS i, CASE WHEN i <= len(embedding) THEN embedding[i]::DOUBLE ELSE 0.0 END AS v FROM (SELECT vec_id, embedding, unnest(range(1, greatest(60 + vec_id % 9, len(embedding)) + 1)) i FROM embeddings)"


def threshold_mask(spark, sf_dir):
    p = F.transform("embedding", lambda v: v.cast("double"))
    return _t(spark, sf_dir, "embeddings").select("vec_id", F.size(F.filter(p, lambda v: geometry.mask(v))).cast("long").alias("n"))


SQL["threshold_mask"] = "SELECT vec_id, len(list_filter(embedding, lambda x: x::DOUBLE > 0.252 AND NOT isnan(x)))::BIGINT AS n FROM embeddings"


def pixel_normalize(spark, sf_dir):
    """All values of a vector as pixels of three channels."""
    e = _t(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("i", "v")).withColumn("channel", F.col("i") % 3)
    v = F.floor((F.col("v").cast("double") + 1) * 127)
    norm = F.when(F.col("channel") == 0, geometry.normalize(v, 0)).when(F.col("channel") == 1, geometry.normalize(v, 1)).otherwise(geometry.normalize(v, 2))
    return e.select("vec_id", "i", F.round(norm, 6).alias("v"))


SQL["pixel_normalize"] = "SELECT vec_id, i::INTEGER AS i, round((floor((embedding[i + 1]::DOUBLE + 1) * 127) / 255.0 - [0.485, 0.456, 0.406][i % 3 + 1]::DOUBLE) / [0.229, 0.224, 0.225][i % 3 + 1]::DOUBLE, 6) AS v FROM (SELECT vec_id, embedding, unnest(range(0, len(embedding))) i FROM embeddings)"


def head_n_regions(spark, sf_dir):
    r = layout.reading_order(layout.layer_regions(_blocks(F.split("text", "\n"))))
    return _docs(spark, sf_dir).select("doc_id", F.posexplode(F.slice(r, 1, 5)).alias("ord", "r")).select("doc_id", "ord", "r.text")


SQL["head_n_regions"] = f"SELECT doc_id, (i - 1)::INTEGER AS ord, l[i] AS text FROM (SELECT doc_id, l, unnest(range(1, least(len(l), 5) + 1)) i FROM (SELECT doc_id, {_LINES % 't'} l FROM {_DOCS}))"


def confidence_format(spark, sf_dir):
    c = (F.col("event_id") % 997) / 997.0
    return _t(spark, sf_dir, "events").select("event_id", text.percent(c).alias("shown"))


SQL["confidence_format"] = "SELECT event_id, format('{:.1f}%', 100 * ((event_id % 997) / 997.0::DOUBLE)) AS shown FROM events"


def regions_json(spark, sf_dir):
    """Through JSON and back: what the fields hold is what counts."""
    r = _docs(spark, sf_dir).select("doc_id", F.to_json(layout.page(F.lit(1), F.lit("text"), layout.layer_regions(_blocks(F.split("text", "\n"))))).alias("j"))
    from .schema import PAGE

    return r.select("doc_id", F.from_json("j", PAGE).alias("p")).select("doc_id", "p.page", "p.method", F.posexplode("p.results").alias("ord", "r")).select("doc_id", "page", "method", "ord", "r.text", F.col("r.quad")[2][0].alias("x1"))


SQL["regions_json"] = f"SELECT doc_id, 1::INTEGER AS page, 'text' AS method, (row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1)::INTEGER AS ord, s AS text, 6.0::DOUBLE * n AS x1 FROM (SELECT doc_id, i, {_STRIP % 'x'} s, length(x) n FROM (SELECT doc_id, i, l[i] x FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) i FROM (SELECT doc_id, string_split(t, chr(10)) l FROM {_DOCS})))) WHERE s <> ''"


def palette_cycle(spark, sf_dir):
    r = text_layer_lines(spark, sf_dir)
    return r.groupBy(F.pmod("region_ord", F.lit(5)).alias("colour")).agg(F.count("*").alias("n"))


SQL["palette_cycle"] = f"SELECT region_ord % 5 AS colour, count(*) AS n FROM ({SQL['text_layer_lines']}) GROUP BY 1"


def page_counts(spark, sf_dir):
    r = text_layer_lines(spark, sf_dir)
    return r.groupBy("doc_id").agg(F.count("*").alias("n_regions"), F.sum(F.length("text")).alias("n_chars"))


SQL["page_counts"] = f"SELECT doc_id, count(*) AS n_regions, sum(length(text))::BIGINT AS n_chars FROM ({SQL['text_layer_lines']}) GROUP BY doc_id"


def _maps(embeddings: DataFrame, run, schema: str) -> DataFrame:
    return embeddings.select("vec_id", "embedding").mapInArrow(run, schema)


def components_8conn(spark, sf_dir):
    """Regions of each vector's 8 x 8 map above 0.05."""

    def run(batches):
        from .operators.kernels import components

        for b in batches:
            n = [components(np.array(v, np.float32).reshape(8, 8) > 0.05)[1] for v in b.column("embedding").to_pylist()]
            yield pa.record_batch({"vec_id": b.column("vec_id"), "n": pa.array(n, pa.int32())})

    return _maps(_t(spark, sf_dir, "embeddings"), run, "vec_id long, n int")


# labels grow by the least neighbour until none changes; 8 x 8 cells are few
SQL["components_8conn"] = """
WITH RECURSIVE c AS (SELECT vec_id, i, i // 8 y, i % 8 x FROM (SELECT vec_id, embedding, unnest(range(0, 64)) i FROM embeddings) WHERE embedding[i + 1] > 0.05::FLOAT),
e AS (SELECT a.vec_id, a.i a, b.i b FROM c a JOIN c b ON a.vec_id = b.vec_id AND abs(a.y - b.y) <= 1 AND abs(a.x - b.x) <= 1),
r AS (SELECT vec_id, i a, i b FROM c UNION SELECT r.vec_id, r.a, e.b FROM r JOIN e ON r.vec_id = e.vec_id AND r.b = e.a)
SELECT v.vec_id, count(DISTINCT m)::INTEGER AS n FROM embeddings v LEFT JOIN (SELECT vec_id, a, min(b) m FROM r GROUP BY vec_id, a) l ON v.vec_id = l.vec_id GROUP BY v.vec_id
"""


def min_area_rect(spark, sf_dir):
    """Area of the least rectangle round a vector's values as points."""

    def run(batches):
        from .operators.kernels import min_area_rect as rect
        from .operators.kernels import polygon_area

        for b in batches:
            a = [round(polygon_area(rect(np.array(v, float).reshape(-1, 2))), 6) for v in b.column("embedding").to_pylist()]
            yield pa.record_batch({"vec_id": b.column("vec_id"), "area": pa.array(a, pa.float64())})

    return _maps(_t(spark, sf_dir, "embeddings"), run, "vec_id long, area double")


# the least rectangle has a side along two of the points, so every direction between two is tried
SQL["min_area_rect"] = """
WITH p AS (SELECT vec_id, i, embedding[2 * i + 1]::DOUBLE x, embedding[2 * i + 2]::DOUBLE y FROM (SELECT vec_id, embedding, unnest(range(0, len(embedding) // 2)) i FROM embeddings)),
d AS (SELECT vec_id, i, j, ux / n ux, uy / n uy FROM (SELECT a.vec_id, a.i, b.i j, b.x - a.x ux, b.y - a.y uy, sqrt(pow(b.x - a.x, 2) + pow(b.y - a.y, 2)) n FROM p a JOIN p b ON a.vec_id = b.vec_id AND a.i < b.i) WHERE n > 0),
r AS (SELECT d.vec_id, d.i, d.j, (max(x * ux + y * uy) - min(x * ux + y * uy)) * (max(y * ux - x * uy) - min(y * ux - x * uy)) area FROM d JOIN p ON d.vec_id = p.vec_id GROUP BY d.vec_id, d.i, d.j)
SELECT vec_id, round(min(area), 6) AS area FROM r GROUP BY vec_id
"""


def image_detect_stub(spark, sf_dir):
    """A dark box on white, drawn from each vector, found again by the stand-in detector."""

    def run(batches):
        from .backends import DarkDetector

        detector = DarkDetector()
        for b in batches:
            rows = []
            for i, v in zip(b.column("vec_id").to_pylist(), b.column("embedding").to_pylist()):
                image = np.full((96, 128, 3), 255, np.uint8)
                image[20 : 40 + int(abs(v[0]) * 50), 30 : 60 + int(abs(v[1]) * 50)] = 0
                rows += [{"vec_id": i, "ord": k, **{c: round(float(q[p][d]), 3) for c, p, d in (("x0", 0, 0), ("y0", 0, 1), ("x1", 2, 0), ("y1", 2, 1))}} for k, q in enumerate(detector.detect(image))]
            yield pa.RecordBatch.from_pylist(rows, pa.schema([("vec_id", pa.int64()), ("ord", pa.int32()), *((c, pa.float64()) for c in ("x0", "y0", "x1", "y1"))]))

    return _maps(_t(spark, sf_dir, "embeddings"), run, "vec_id long, ord int, x0 double, y0 double, x1 double, y1 double")


# the outline runs through pixel centres; it grows by area * ratio / length and is cut at the image
SQL["image_detect_stub"] = """
WITH b AS (SELECT vec_id, 29.0::DOUBLE + trunc(abs(embedding[2]::DOUBLE) * 50) w, 19.0::DOUBLE + trunc(abs(embedding[1]::DOUBLE) * 50) h FROM embeddings),
g AS (SELECT *, w * h * 2.44::DOUBLE / (2 * (w + h)) d FROM b)
SELECT vec_id, 0::INTEGER AS ord, round(greatest(30 - d, 0.0)::FLOAT::DOUBLE, 3) AS x0, round(greatest(20 - d, 0.0)::FLOAT::DOUBLE, 3) AS y0,
  round(least(30 + w + d, 128.0)::FLOAT::DOUBLE, 3) AS x1, round(least(20 + h + d, 96.0)::FLOAT::DOUBLE, 3) AS y1 FROM g
"""


def image_roundtrip(spark, sf_dir):
    """A vector's values as pixels, written as PNG and read again: their sum by place."""

    def run(batches):
        from .sources.images import decode_png, encode_png

        for b in batches:
            sums = []
            for v in b.column("embedding").to_pylist():
                flat = (np.floor(np.abs(np.array(v, float)) * 255) % 256).astype(np.uint8)
                image = np.pad(flat, (0, -len(flat) % 6)).reshape(2, -1, 3)
                back = decode_png(encode_png(image)).ravel().astype(np.int64)
                sums.append(int((back * np.arange(1, len(back) + 1)).sum()))
            yield pa.record_batch({"vec_id": b.column("vec_id"), "checksum": pa.array(sums, pa.int64())})

    return _maps(_t(spark, sf_dir, "embeddings"), run, "vec_id long, checksum long")


SQL["image_roundtrip"] = "SELECT vec_id, sum((i + 1) * (floor(abs(embedding[i + 1]::DOUBLE) * 255)::BIGINT % 256))::BIGINT AS checksum FROM (SELECT vec_id, embedding, unnest(range(0, len(embedding))) i FROM embeddings) GROUP BY vec_id"

QUERIES = {
    f.__name__: f
    for f in (
        text_pages, text_pages_dirty, text_layer_lines, page_method_routing, suffix_dispatch, ctc_greedy_decode, ctc_confidence, ctc_loss, ctc_loss_mean, ctc_encode_targets,
        quad_order_points, quad_order_ties, quad_shoelace_area, unclip_distance, rescale_clip, crop_bounds, ceil32_scale, recog_width, width_bucket,
        bucket_padding, region_score_filter, zip_truncate, scatter_default, bbox_to_quad, pad_right, threshold_mask, pixel_normalize, head_n_regions,
        confidence_format, regions_json, palette_cycle, page_counts, components_8conn, min_area_rect, image_detect_stub, image_roundtrip,
    )
}
