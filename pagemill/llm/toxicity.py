"""Toxicity by compression distance: two zstandard dictionaries, and how much shorter the toxic one makes a window.

Training. zstandard trains the ordinary dictionary on windows of ordinary texts. The toxic one is trained in rounds. Toxic
texts are dealt to ``FOLDS`` folds; a dictionary trained on the windows of the other folds is held against the ordinary one, and
a fold's windows stay that it shortens by more bytes than nearly all (``QUANTILE``) ordinary windows. A window that stays is
cut to its shortest part that saves as much. The next round trains on what stayed, and so on. The last dictionary grows by
training again on the windows that it does not shorten yet. It is laid before the ordinary content, so that both give
ordinary text the same length. Windows are chosen by compressed lengths alone.

Score. Overlapping windows of eight words are compressed with either dictionary; a fixed tail that both hold keeps the
compressor from storing short windows plainly, so lengths stay comparable. The bytes saved beyond the first of each window
are added up and set against the number of windows in two ways (its root, and itself); a logistic curve in these two,
calibrated on labelled texts that the dictionaries have not seen, gives the score; its threshold 0.7 lies where a fixed share
of the ordinary ones (``SPARED``) is below.

The fit reads a bounded sample of labelled rows (``SAMPLE``, picked by a hash of the id; for the dictionaries at most
``EXCERPTS`` even excerpts of a text); scoring is one pass over whole texts with no shuffle. What is sent to the executors is
the two dictionaries, ``ORDINARY`` and ``TOXIC`` bytes at most.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Carried, named, slices, with_fields

#: Words of a window and from one to the next: of scored texts, and of toxic texts that a dictionary is trained on.
WIDTH, STEP = 8, 4
FINE, FINE_STEP = 3, 1
#: Labelled rows read at most: toxic and ordinary ones for the dictionaries, and any for calibration.
SAMPLE = {"toxic": 2500, "ordinary": 2500, "calibration": 6000}
#: Of a text in the dictionaries' sample at most so many excerpts of so many words, each of so many bytes at most.
EXCERPTS, EXCERPT_WORDS, WORD_BYTES = 64, 32, 64
ORDINARY, TOXIC, TAIL = 110_000, 1_000, 64
#: Bytes of the first round's toxic dictionary and of each that the last one grows by, and zstandard's segment there.
FIRST, GROWTH, SEGMENT, GRAM = 20_000, 1_000, 16, 6
FOLDS, ROUNDS, QUANTILE, LEAST = 4, 4, 0.99, 8
LIMIT = 0.7
#: Share of ordinary calibration rows that the threshold leaves below it.
SPARED = 0.995


def tidy(text: str) -> bytes:
    return b" " + b" ".join(text.lower().encode().split()) + b" "


def windows(text: bytes, width: int = WIDTH, step: int = STEP) -> list[bytes]:
    w = text.split()
    return [b" " + b" ".join(w[i : i + width]) + b" " for i in range(0, max(1, len(w) - width + step), step)] if w else []


def excerpts(text: str | None) -> str:
    """The whole text if it is short, else excerpts spread evenly over it."""
    w = (text or "").split()
    if len(w) > EXCERPTS * EXCERPT_WORDS:
        w = [x for i in np.linspace(0, len(w) - EXCERPT_WORDS, EXCERPTS).astype(int).tolist() for x in w[i : i + EXCERPT_WORDS]]
    return " ".join(x[:WORD_BYTES] for x in w)


def trained(samples: list[bytes], size: int, segment: int, gram: int) -> bytes:
    """Content of a dictionary that zstandard trains, without its header; nothing if the samples are too few."""
    import zstandard

    try:
        whole = zstandard.train_dictionary(size, samples, k=segment, d=gram).as_bytes()
    except zstandard.ZstdError:
        return b""
    # the header ends with the three starting offsets of the format: 1, 4, 8
    at = whole.find(b"\x01\0\0\0\x04\0\0\0\x08\0\0\0")
    return whole[at + 12 :] if at >= 0 else whole


def unlike(texts: list[str], hashes: int = 6) -> list[str]:
    """Without texts that share one of their least five-word hashes with an earlier one: copies would fill a dictionary."""
    seen: set[int] = set()
    out = []
    for t in texts:
        w = tidy(t).split()
        least = sorted({zlib.crc32(b" ".join(w[i : i + 5])) for i in range(max(1, len(w) - 4))})[:hashes]
        if seen.isdisjoint(least):
            out.append(t)
        seen.update(least)
    return out


class Savings:
    """How many bytes the toxic dictionary saves on each window."""

    def __init__(self, ordinary: bytes, toxic: bytes):
        import zstandard as z

        self.tail = ordinary[-TAIL:]
        p = z.ZstdCompressionParameters.from_level(5, source_size=256, dict_size=len(toxic), strategy=z.STRATEGY_LAZY, min_match=4, search_log=6, write_content_size=False, write_checksum=False, write_dict_id=False)
        self.of = []
        for content in (ordinary, toxic):
            d = z.ZstdCompressionDict(content, dict_type=z.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(compression_params=p)
            self.of.append(z.ZstdCompressor(dict_data=d, compression_params=p).compress)

    def of_windows(self, texts: list[bytes]) -> np.ndarray:
        plain, toxic = self.of
        return np.array([len(plain(x)) - len(toxic(x)) for x in (t + self.tail for t in texts)], np.int64)

    def __call__(self, text: str | None) -> np.ndarray:
        return self.of_windows(windows(tidy(text or "")))

    def shortest(self, window: bytes, saved: int) -> bytes:
        """The shortest run of the window's words that saves as much, but for one byte."""
        w = window.split()
        parts = sorted((b" " + b" ".join(w[i:j]) + b" " for i in range(len(w)) for j in range(i + 1, len(w) + 1)), key=len)
        return next((p for p, s in zip(parts, self.of_windows(parts).tolist()) if s >= saved - 1), window)


def laid(front: bytes, ordinary: bytes) -> bytes:
    return b" " + front + b" " + ordinary


def grown(samples: list[bytes], ordinary: bytes) -> bytes:
    """Content trained on the samples, then on those that it does not shorten, until ``LEAST`` are left or none is gained."""
    content, left = b"", samples
    while len(left) >= LEAST and len(content) < TOXIC:
        more = trained(left, GROWTH, SEGMENT, GRAM)
        kinds = sorted(set(left))
        saved = dict(zip(kinds, Savings(ordinary, laid(more + content, ordinary)).of_windows(kinds).tolist()))
        rest = [w for w in left if saved[w] <= 1]
        if not more or len(left) - len(rest) < LEAST:
            break
        content, left = more + content, rest
    return content[-TOXIC:]


def dictionaries(toxic: list[str], ordinary: list[str]) -> tuple[bytes, bytes]:
    """(ordinary, toxic) content. If no window of toxic texts can be told from ordinary ones, both are the same."""
    good = [tidy(t) for t in ordinary]
    rng = np.random.default_rng(0)
    some = lambda w, n: [w[i] for i in rng.permutation(len(w))[:n]]
    parts = some([w for t in good for w in windows(t, WIDTH, WIDTH)], 50_000)
    base = trained(parts, ORDINARY, 64, 8) or b"".join(dict.fromkeys(parts))[-ORDINARY:]
    held = some([w for t in good for w in windows(t, FINE, FINE_STEP)], 20_000)
    folds: list[list[bytes]] = [[] for _ in range(FOLDS)]
    for i, t in enumerate(unlike(toxic)):
        folds[i % FOLDS] += windows(tidy(t), FINE, FINE_STEP)
    now = folds
    for r in range(ROUNDS):
        after = []
        for f, mine in enumerate(folds):
            others = [w for g in range(FOLDS) if g != f for w in now[g]]
            s = Savings(base, laid(grown(others, base) if r else trained(others, FIRST, 32, GRAM), base))
            cut = max(1, int(np.quantile(s.of_windows(held), QUANTILE))) if held else 1
            kinds = sorted(set(mine))
            part = {w: s.shortest(w, v) for w, v in zip(kinds, s.of_windows(kinds).tolist()) if v > cut}
            after.append([part[w] for w in mine if w in part])
        now = after
    front = grown([w for fold in now for w in fold], base)
    return base, laid(front, base) if front else base


def evidence(saved: np.ndarray) -> list[float]:
    """Bytes saved beyond the first of each window, by the root of the number of windows and by the number."""
    total = float(np.maximum(saved - 1, 0).sum())
    return [1.0, total / np.sqrt(len(saved) + 4), 10 * total / (len(saved) + 4)]


FEATURES = 3


def _evidence(ordinary: bytes, toxic: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        saved = Savings(ordinary, toxic) if ordinary else lambda t: np.zeros(0, np.int64)
        for b in slices(batches):
            rows = [evidence(saved(t)) for t in b.column("text").to_pylist()]
            yield b.append_column("evidence", pa.array(rows, pa.list_(pa.float64())))

    return run


def _excerpts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches):
        yield b.set_column(b.schema.get_field_index("text"), "text", pa.array([excerpts(t) for t in b.column("text").to_pylist()], pa.string()))


def calibrated(x: np.ndarray, y: np.ndarray, ridge: float = 0.01) -> np.ndarray:
    """Weights of a logistic curve, by Newton steps, moved so that the share ``SPARED`` of ordinary rows scores below LIMIT."""
    w = np.zeros(x.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (p - y) + ridge * w)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    w[0] += np.log(LIMIT / (1 - LIMIT)) - np.quantile((x @ w)[y == 0], SPARED, method="higher") - 1e-9
    return w


def remainder(id_col, parts: int = 3):
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % parts


class Model:
    def __init__(self, ordinary: bytes, toxic: bytes, weights: np.ndarray):
        self.ordinary, self.toxic, self.weights = ordinary, toxic, weights

    def score(self, docs: DataFrame, text: str = "text") -> DataFrame:
        """Adds score (double, 0 to 1). Null and empty texts score as texts without windows. Repeated rows score alike; an
        empty table stays empty; other columns of any type and name stay, but a column score is replaced."""
        carried = Carried(docs, "score", text=text)
        z = sum((F.col("evidence")[i] * float(w) for i, w in enumerate(self.weights)), F.lit(0.0))
        z = F.greatest(F.lit(-700.0), F.least(F.lit(700.0), z))
        got = carried.frame.mapInArrow(_evidence(self.ordinary, self.toxic), with_fields(carried.frame, "evidence array<double>"))
        return got.select(*carried.columns(), (1 / (1 + F.exp(-z))).alias("score"))


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", label: str = "toxic", id_col: str = "doc_id", held: int = 1, sample: dict[str, int] = SAMPLE) -> Model:
    """Learns from labelled rows whose crc32(id as text) mod 3 is not ``held``.

    Ids are picked by hash, three quarters of them for the dictionaries and the rest for calibration, at most ``sample`` of each
    kind; excerpts and evidence of these alone come to the driver. Null ids and labels are left out; of a repeated id one
    label and one text count. Without toxic or without ordinary rows every score is a half.
    """
    known = labels.select(named(id_col).cast("long").alias("id"), named(label).cast("int").alias("y")).where(F.col("y").isNotNull() & (remainder("id") != held))
    known = known.groupBy("id").agg(F.max("y").alias("y")).withColumn("h", F.xxhash64("id")).withColumn("part", F.pmod("h", F.lit(4)))
    pick = lambda rows, n: [(r[0], r[1]) for r in rows.orderBy("h", "id").limit(n).select("id", "y").collect()]
    mine = known.where("part > 0")
    chosen = pick(mine.where("y = 0"), sample["ordinary"]) + pick(mine.where("y = 1"), sample["toxic"])
    checked = pick(known.where("part = 0"), sample["calibration"])

    def texts(ids: list) -> DataFrame:
        few = docs.sparkSession.createDataFrame(ids, "id long, y int")
        return docs.select(named(id_col).cast("long").alias("id"), named(text).alias("text")).join(F.broadcast(few), "id").select("id", "y", "text")

    rows = texts(chosen).mapInArrow(_excerpts, "id long, y int, text string").groupBy("id").agg(F.max("y").alias("y"), F.min("text").alias("text")).collect() if chosen else []
    by = [[r["text"] for r in sorted(rows, key=lambda r: r["id"]) if r["y"] == y] for y in (0, 1)]
    if not by[0] or not by[1]:
        return Model(b"", b"", np.zeros(FEATURES))
    ordinary, toxic = dictionaries(by[1], by[0])
    got = []
    if checked:
        got = texts(checked).mapInArrow(_evidence(ordinary, toxic), "id long, y int, text string, evidence array<double>")
        got = got.groupBy("id").agg(F.max("y").alias("y"), F.max("evidence").alias("evidence")).collect()
    if len({r["y"] for r in got}) < 2:
        return Model(b"", b"", np.zeros(FEATURES))
    got.sort(key=lambda r: r["id"])
    return Model(ordinary, toxic, calibrated(np.array([r["evidence"] for r in got]), np.array([r["y"] for r in got], float)))


def digest(scored: DataFrame) -> DataFrame:
    return scored.select("doc_id", F.coalesce(remainder("doc_id") == 1, F.lit(False)).alias("held_out"), "score", (F.col("score") >= LIMIT).cast("int").alias("predicted"))
