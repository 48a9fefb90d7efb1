"""Quality rules whose thresholds come from the data: quantile sketches for each language and source.

Five measures of a text are integers. Each group's measure is summarised by a sketch: counts of buckets that keep the top
ten bits of the value, so the relative error is below 1/512. Sketches of parts of the data add up to the sketch of the
whole, whatever the order. Buckets are counted with map-side aggregation, so a shuffle carries at most one row a task,
group, measure and bucket, however large one source is.

A text passes if no measure lies beyond its group's fence: the upper quartile plus ``reach`` times the spread between
quartiles (and a least spread). Every group, of any size, goes by its own sketch. Thresholds return to the rows by a join on
the group's keys.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Carried, Scratch, slices, with_fields
from .words import Words, ranges

#: Measures by per mille, and the least spread between quartiles that counts (fixed parameters of the rules).
MEASURES = {"symbols": 20, "dup_lines": 40, "repeats": 100, "long_words": 500, "short_words": 500}
REACH = 4
SYMBOL = np.zeros(256, bool)
SYMBOL[list(b"#*$%&|<>")] = True
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")


def windows_of_three(code: np.ndarray, at: np.ndarray, kinds: int) -> np.ndarray:
    """Whole numbers that are equal for equal windows of codes below ``kinds``."""
    if kinds < 1 << 21:
        return (code[at] << 42) | (code[at + 1] << 21) | code[at + 2]
    pair = np.unique(code[at] * kinds + code[at + 1], return_inverse=True)[1]
    return pair * kinds + code[at + 2]


def counts(texts: pa.Array) -> dict[str, np.ndarray]:
    """COUNTS of each text (null: all 0). Lines count if they hold a word."""
    w = Words(texts)
    n = len(texts)
    words, owner = w.counts(), w.owner()
    inner = ((w.data & 0xC0) != 0x80) & ~np.isin(w.data, (32, 9, 10, 11, 12, 13))
    by_text = lambda mask: np.diff(np.concatenate([[0], np.cumsum(mask)])[w.offsets])
    code, names = w.codes()
    code = code.astype(np.int64)
    repeats = np.zeros(len(w) + 1, np.int64)
    windows = np.maximum(words - 2, 0)
    if windows.sum():
        at = np.repeat(w.first[:-1], windows) + ranges(windows)
        key = windows_of_three(code, at, len(names))
        order = np.argsort(key, kind="stable")  # so equal windows of one text are neighbours
        key, mine = key[order], owner[at[order]]
        same = np.flatnonzero((key[1:] == key[:-1]) & (mine[1:] == mine[:-1]))
        twice = at[np.unique(np.concatenate([order[same], order[same + 1]]))]
        np.add.at(repeats, twice, 1)
        np.add.at(repeats, twice + 3, -1)
    repeats = np.add.reduceat(np.append(np.cumsum(repeats)[:-1] > 0, False).astype(np.int64), np.minimum(w.first[:-1], len(w))) * (words > 0) if n else words
    lines, dup = np.zeros(n, np.int64), np.zeros(n, np.int64)
    data, offsets = w.data.tobytes(), w.offsets.tolist()
    for i in np.flatnonzero(words).tolist():
        got = [x for x in data[offsets[i] : offsets[i + 1]].split(b"\n") if x and x.split(None, 1)]
        lines[i], dup[i] = len(got), len(got) - len(set(got))
    return dict(zip(COUNTS, (words, by_text(inner), by_text(SYMBOL[w.data]), dup, repeats, lines), strict=True))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches):
        for name, v in counts(b.column("text")).items():
            b = b.append_column(name, pa.array(v, pa.int64()))
        yield b


def measured(rows: DataFrame) -> DataFrame:
    """Adds COUNTS and base_failed to rows with a column text."""
    schema = with_fields(rows, ", ".join(f"{c} long" for c in COUNTS))
    return rows.mapInArrow(_count, schema).withColumn("base_failed", F.expr("n_words < 50 OR 100 * n_repeat_words > 50 * n_words"))


def values() -> list:
    """Each measure as a whole number; texts without words have 0."""
    size = F.expr("1000 * word_chars div greatest(n_words, 1)")
    return [
        F.expr("1000 * n_symbols div greatest(n_words, 1)").alias("symbols"),
        F.expr("1000 * n_dup_lines div greatest(n_lines, 1)").alias("dup_lines"),
        F.expr("1000 * n_repeat_words div greatest(n_words, 1)").alias("repeats"),
        size.alias("long_words"),
        F.greatest(F.lit(0), 20000 - size).alias("short_words"),
    ]


def bucket(v):
    """The value with all but its ten top bits cleared."""
    return F.expr(f"shiftleft(shiftright({v}, greatest(length(bin({v})) - 10, 0)), greatest(length(bin({v})) - 10, 0))")


def sketches(rows: DataFrame) -> DataFrame:
    """lang, source, measure, bucket, n. Sketches of coarser groups are sums of these."""
    long = rows.select("lang", "source", F.explode(F.array(*(F.struct(F.lit(m).alias("measure"), F.col(m).alias("v")) for m in MEASURES))).alias("x"))
    return long.select("lang", "source", "x.measure", bucket("x.v").alias("bucket")).groupBy("lang", "source", "measure", "bucket").agg(F.count("*").alias("n"))


def fences(sketch: DataFrame, reach: int = REACH) -> DataFrame:
    """A row for each group, with the fence of every measure."""
    keys = ("lang", "source")
    group = Window.partitionBy(*keys, "measure")
    run = sketch.select("*", F.sum("n").over(group.orderBy("bucket")).alias("upto"), F.sum("n").over(group).alias("all"))
    least = F.create_map(*(F.lit(x) for kv in MEASURES.items() for x in kv))[F.col("measure")]
    cut = run.groupBy(*keys, "measure").agg(
        F.min(F.when(4 * F.col("upto") >= F.col("all"), F.col("bucket"))).alias("q1"),
        F.min(F.when(4 * F.col("upto") >= 3 * F.col("all"), F.col("bucket"))).alias("q3"),
    )
    cut = cut.withColumn("fence", F.col("q3") + reach * F.greatest(F.col("q3") - F.col("q1"), least))
    return cut.groupBy(*keys).agg(*(F.max(F.when(F.col("measure") == m, F.col("fence"))).alias(f"max_{m}") for m in MEASURES))


def judge(docs: DataFrame, text: str = "text", reach: int = REACH) -> DataFrame:
    """Adds COUNTS, base_failed and kept to docs, which needs lang and source.

    Null texts count as empty; texts with fewer than 50 words fail the base rule. A null lang or source is a group of its
    own. Repeated rows count as often as they come. An empty table stays empty. Other columns of any type and name stay,
    but for those with the new names, which are replaced.
    """
    scratch = Scratch(docs.sparkSession)
    carried = Carried(docs, *COUNTS, "base_failed", "kept", text=text, lang="lang", source="source")
    rows = scratch.write(measured(carried.frame), "measured")
    rows = rows.select("*", *(v.alias(f"v_{m}") for m, v in zip(MEASURES, values())))
    sketch = scratch.write(sketches(rows.select("lang", "source", *(F.col(f"v_{m}").alias(m) for m in MEASURES))), "sketches")
    limits = fences(sketch, reach).withColumnsRenamed({"lang": "of_lang", "source": "of_source"})
    out = rows.join(limits, rows["lang"].eqNullSafe(limits["of_lang"]) & rows["source"].eqNullSafe(limits["of_source"]), "left")
    fine = ~F.col("base_failed")
    for m in MEASURES:
        fine = fine & (F.col(f"v_{m}") <= F.col(f"max_{m}"))
    return out.withColumn("kept", F.coalesce(fine, F.lit(False))).select(*carried.columns(), *COUNTS, "base_failed", "kept")


def digest(df: DataFrame) -> DataFrame:
    return df.select("doc_id", *COUNTS[:5], "base_failed", "kept")


WORD = r"[^\x20\x09-\x0D]+"

SQL = rf"""
WITH w AS (SELECT doc_id, lang, source, coalesce(text, '') t, regexp_extract_all(coalesce(text, ''), '{WORD}') w FROM documents),
l AS (SELECT *, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{WORD}')) l FROM w),
g AS (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 1, 1))) i FROM w),
r AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i:i+2]) n FROM g),
p AS (SELECT doc_id, count(DISTINCT p) n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) p FROM r WHERE n > 1) GROUP BY doc_id),
c AS (SELECT l.doc_id, lang, source, len(w)::BIGINT n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT word_chars,
  length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT n_symbols, (len(l) - len(list_distinct(l)))::BIGINT n_dup_lines,
  coalesce(p.n, 0)::BIGINT n_repeat_words, len(l)::BIGINT n_lines FROM l LEFT JOIN p ON l.doc_id = p.doc_id),
v AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words base_failed, 1000 * n_symbols // greatest(n_words, 1) symbols,
  1000 * n_dup_lines // greatest(n_lines, 1) dup_lines, 1000 * n_repeat_words // greatest(n_words, 1) repeats,
  1000 * word_chars // greatest(n_words, 1) long_words, greatest(0, 20000 - 1000 * word_chars // greatest(n_words, 1)) short_words FROM c),
u AS (UNPIVOT (SELECT lang, source, doc_id, {", ".join(MEASURES)} FROM v) ON {", ".join(MEASURES)} INTO NAME measure VALUE x),
k AS (SELECT lang, source, measure, (x >> greatest(length(bin(x)) - 10, 0)) << greatest(length(bin(x)) - 10, 0) b FROM u),
s AS (SELECT lang, source, measure, b, count(*) n FROM k GROUP BY ALL),
q AS (SELECT *, sum(n) OVER (PARTITION BY lang, source, measure ORDER BY b) upto, sum(n) OVER (PARTITION BY lang, source, measure) total FROM s),
f AS (SELECT lang, source, measure, min(b) FILTER (4 * upto >= total) q1, min(b) FILTER (4 * upto >= 3 * total) q3 FROM q GROUP BY ALL),
t AS (SELECT *, q3 + {REACH} * greatest(q3 - q1, CASE measure {" ".join(f"WHEN '{m}' THEN {x}" for m, x in MEASURES.items())} END) fence FROM f),
o AS (SELECT u.doc_id, bool_or(u.x > t.fence) beyond FROM u JOIN t ON u.measure = t.measure AND u.lang IS NOT DISTINCT FROM t.lang AND u.source IS NOT DISTINCT FROM t.source GROUP BY u.doc_id)
SELECT v.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT beyond AS kept
FROM v JOIN o ON v.doc_id = o.doc_id
"""
