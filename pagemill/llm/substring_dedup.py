"""Removal of repeated word windows by super-k-mer partitioning.

A window is ``width`` consecutive words of one text. Of the ``gram``-word grams in a window the one with the least hash is
its minimiser; consecutive windows with one minimiser travel as one packed string (their words, one blank between) to the
minimiser's bucket. Equal windows have equal minimisers, so each bucket sees all copies of its windows, sorts them and
counts them exactly: equal hashes only propose, bytes decide. A packed string finds its way back to its documents by 128 bits
of a cryptographic digest.

Scale. Equal packed strings are merged before the shuffle, so a group of copies costs one row a task. A minimiser that
many different strings share (a common line inside different texts) would make one bucket hot: a first pass counts
minimisers, and grams above a share of the whole come last in the order, so that windows go by their rarer grams. That
changes only where windows meet. At most ``1 / share`` grams can be demoted, which bounds the broadcast. Buckets are sorted
by Spark (which spills) and read in bounded chunks at minimiser boundaries. A bucket with more than ``BUCKET`` bytes of unlike
strings is not held: each of its windows leaves as a row with its digest, and Spark adds up the counts, partly before its
shuffle. So what a worker holds does not grow with the input.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ROW, Carried, Scratch, row_key, shuffle_width, slices, with_fields
from .words import Words, digest as digests, gram_hashes, mix, ranges

WIDTH, GRAM = 35, 4
#: Windows of one packed string at most; longer runs of one minimiser are cut.
RUN = 4096
#: Grams with more than this share of all super-k-mers are demoted.
HOT_SHARE = 1e-4
FLUSH_BYTES, CHUNK = 10 << 20, 3 << 20
#: Bytes of one minimiser's strings that a worker holds at most.
BUCKET = 12 << 20
TOP = np.uint64(1 << 63)


class Cuts:
    """Super-k-mers of a batch: a, the first word; n, the number of windows; mini; owner, the text."""

    def __init__(self, texts: pa.Array, width: int, gram: int, hot: np.ndarray):
        self.words = w = Words(texts, tidy=True)
        self.h = h = w.hashes()
        windows = np.maximum(w.counts() - width + 1, 0)
        at = np.repeat(w.first[:-1], windows) + ranges(windows)
        if not len(at):
            self.a = self.n = self.owner = np.zeros(0, np.int64)
            self.mini = np.zeros(0, np.uint64)
            return
        low = gram_hashes(h, gram) >> np.uint64(1)
        if len(hot):
            low = np.where(hot[np.minimum(np.searchsorted(hot, low), len(hot) - 1)] == low, low | TOP, low)
        span, done = width - gram + 1, 1
        while done < span:
            step = min(done, span - done)
            low = np.minimum(low[: len(low) - step], low[step:])
            done += step
        low = low[at]
        owner = np.repeat(np.arange(len(windows)), windows)
        new = np.ones(len(at), bool)
        new[1:] = (low[1:] != low[:-1]) | (owner[1:] != owner[:-1])
        first = np.flatnonzero(new)
        size = np.diff(np.append(first, len(at)))
        if len(size) and size.max() > RUN:
            parts = -(-size // RUN)
            first = np.repeat(first, parts) + ranges(parts) * RUN
            size = np.minimum(np.repeat(size, parts) - ranges(parts) * RUN, RUN)
        self.a, self.n, self.mini, self.owner = at[first], size, low[first], owner[first]
        self.width = width

    def packed(self) -> list[bytes]:
        data, lo, hi = self.words.data.tobytes(), self.words.start[self.a], self.words.end[self.a + self.n + self.width - 2]
        return [data[x:y] for x, y in zip(lo.tolist(), hi.tolist())]


def keys(packed: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """128 bits for each packed string."""
    both = np.frombuffer(digests(packed, 16), np.int64).reshape(-1, 2)
    return both[:, 0].copy(), both[:, 1].copy()


def _minimisers(width, gram):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Counts by minimiser; only those that a fair number of this task's strings share."""
        parts, total, none = [], 0, np.zeros(0, np.uint64)
        for b in slices(batches):
            c = Cuts(b.column("text"), width, gram, none)
            if len(c.a):
                # enough to tell most strings of one minimiser apart
                key = (mix(c.h[c.a] ^ mix(c.h[c.a + c.n + width - 2])) + c.n.astype(np.uint64)).view(np.int64)
                mini, n = np.unique(_distinct(c.mini.view(np.int64), key)[0], return_counts=True)
                total += int(n.sum())
                parts.append((mini[n > 1], n[n > 1]))
        if parts:
            mini, inv = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
            n = np.bincount(inv, np.concatenate([p[1] for p in parts]), len(mini)).astype(np.int64)
            keep = n >= max(2, total * HOT_SHARE / 4)
            yield pa.record_batch({"mini": np.append(mini[keep], 0), "n": np.append(n[keep], 0), "total": np.append(np.zeros(keep.sum(), np.int64), total)})

    return run


def _distinct(a, b):
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    return a[new], b[new]


def _pack(width, gram, hot):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, list[int]] = {}
        size = 0

        def flush():
            rows = pa.record_batch({"mini": pa.array([v[0] for v in held.values()], pa.int64()), "n": pa.array([v[1] for v in held.values()], pa.int64()), "packed": pa.array(list(held), pa.binary())})
            held.clear()
            return rows

        for b in slices(batches):
            c = Cuts(b.column("text"), width, gram, hot)
            for mini, packed in zip(c.mini.view(np.int64).tolist(), c.packed() if len(c.a) else []):
                if (v := held.get(packed)) is None:
                    held[packed] = [mini, 1]
                    size += len(packed) + 64
                else:
                    v[1] += 1
            if size > FLUSH_BYTES:
                yield flush()
                size = 0
        if held:
            yield flush()

    return run


def _window_places(width: int, texts: list[bytes]):
    """Words of packed strings, and of each of their windows the first word and the string."""
    w = Words(pa.array(texts, pa.large_binary()))
    windows = w.counts() - width + 1
    return w, windows, np.repeat(w.first[:-1], windows) + ranges(windows), np.repeat(np.arange(len(texts)), windows)


def _merged(packed: list[bytes], n: list[int]) -> dict[bytes, int]:
    total: dict[bytes, int] = {}
    for p, k in zip(packed, n):
        total[p] = total.get(p, 0) + k
    return total


COUNTED = "k1 long, k2 long, mask binary, window binary, i int, n long"


def _count_chunk(width: int, packed: list[bytes], n: list[int]) -> Iterator[pa.RecordBatch]:
    """Sorts the windows of one chunk; gives for each string with repeated windows its key and which (null: all)."""
    total = _merged(packed, n)
    texts = list(total)
    w, windows, at, owner = _window_places(width, texts)
    times = np.fromiter(total.values(), np.int64, len(texts))
    gram = gram_hashes(w.hashes(), width)[at]
    order = np.argsort(gram, kind="stable")
    s = gram[order]
    again = np.flatnonzero(s[1:] == s[:-1]) + 1
    repeated = np.zeros(len(at), bool)
    if len(again):
        data, lo, hi = w.data.tobytes(), w.start[at[order]], w.end[at[order] + width - 1]
        same = np.fromiter((data[a:b] == data[c:d] for a, b, c, d in zip(lo[again].tolist(), hi[again].tolist(), lo[again - 1].tolist(), hi[again - 1].tolist())), bool, len(again))
        repeated[order[again[same]]] = repeated[order[again[same] - 1]] = True
        for value in np.unique(s[again[~same]]).tolist():  # unlike windows with one hash: compare the whole run by bytes
            x, y = np.searchsorted(s, np.uint64(value), "left"), np.searchsorted(s, np.uint64(value), "right")
            seen: dict[bytes, int] = {}
            for j in range(x, y):
                t = data[lo[j] : hi[j]]
                if t in seen:
                    repeated[order[[j, seen[t]]]] = True
                seen[t] = j
    repeated |= times[owner] > 1
    hits = np.bincount(owner, repeated, len(texts)).astype(np.int64)
    rows = np.flatnonzero(hits)
    if not len(rows):
        return
    k1, k2 = keys([texts[i] for i in rows.tolist()])
    begin = np.concatenate([[0], np.cumsum(windows)])
    masks = [None if hits[i] == windows[i] else np.packbits(repeated[begin[i] : begin[i + 1]]).tobytes() for i in rows.tolist()]
    none = lambda kind: pa.nulls(len(rows), kind)
    yield pa.record_batch({"k1": k1, "k2": k2, "mask": pa.array(masks, pa.binary()), "window": none(pa.binary()), "i": none(pa.int32()), "n": none(pa.int64())})


def _let_out(width: int, packed: list[bytes], n: list[int]) -> Iterator[pa.RecordBatch]:
    """A row for each window of a bucket that is too large to hold: digest, string and number there, copies."""
    total = _merged(packed, n)
    texts = list(total)
    for x in range(0, len(texts), 2000):
        some = texts[x : x + 2000]
        w, windows, at, owner = _window_places(width, some)
        data, lo, hi = w.data.tobytes(), w.start[at], w.end[at + width - 1]
        k1, k2 = keys(some)
        window = [data[a:b] for a, b in zip(lo.tolist(), hi.tolist())]
        window = pa.array([digests([t], 16) for t in window], pa.binary())
        times = np.fromiter((total[t] for t in some), np.int64, len(some))
        yield pa.record_batch({"k1": k1[owner], "k2": k2[owner], "mask": pa.nulls(len(at), pa.binary()), "window": window, "i": ranges(windows).astype(np.int32), "n": times[owner]})


def _count(width: int, bucket: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packed: list[bytes] = []
        n: list[int] = []
        size = own = start = 0  # bytes held, those of the last minimiser, and where its strings begin
        last, wide = None, None
        for b in batches:
            for mini, k, p in zip(*(b.column(c).to_pylist() for c in ("mini", "n", "packed"))):
                if mini != last:
                    if wide is not None:
                        yield from _let_out(width, packed, n)
                        packed, n, size = [], [], 0
                    elif size > CHUNK:
                        yield from _count_chunk(width, packed, n)
                        packed, n, size = [], [], 0
                    last, wide, own, start = mini, None, 0, len(packed)
                packed.append(p)
                n.append(k)
                size += len(p)
                own += len(p)
                if own > bucket:
                    if start:
                        yield from _count_chunk(width, packed[:start], n[:start])
                    yield from _let_out(width, packed[start:], n[start:])
                    packed, n, size, own, start, wide = [], [], 0, 0, 0, mini
        if packed:
            yield from _let_out(width, packed, n) if wide is not None else _count_chunk(width, packed, n)

    return run


def _as_masks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        masks = []
        for i in b.column("i").to_pylist():
            bits = np.zeros(max(i) + 1, bool)
            bits[i] = True
            masks.append(np.packbits(bits).tobytes())
        yield pa.record_batch({"k1": b.column("k1"), "k2": b.column("k2"), "mask": pa.array(masks, pa.binary())})


def repeated_strings(counted: DataFrame) -> DataFrame:
    """k1, k2, mask of all strings with repeated windows, from what the buckets gave."""
    found = counted.where("window is null").select("k1", "k2", "mask")
    out = counted.where("window is not null")
    if not out.limit(1).count():
        return found
    often = out.groupBy("window").agg(F.sum("n").alias("n")).where("n > 1").select("window")
    bits = out.join(often, "window").groupBy("k1", "k2").agg(F.collect_set("i").alias("i"))  # at most RUN of a string
    return found.unionByName(bits.mapInArrow(_as_masks, "k1 long, k2 long, mask binary"))


def _places(width, gram, hot):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            c = Cuts(b.column("text"), width, gram, hot)
            if len(c.a):
                k1, k2 = keys(c.packed())
                row = {x: np.asarray(b.column(x))[c.owner] for x in ROW}
                yield pa.record_batch({"k1": k1, "k2": k2, **row, "a": c.a - c.words.first[c.owner], "n": c.n})

    return run


def _remove(width):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            w = Words(b.column("text"), tidy=True)
            data = w.data.tobytes()
            counts, removed, kept = w.counts(), [], []
            for i, hits in enumerate(b.column("hits").to_pylist()):
                f, n = int(w.first[i]), int(counts[i])
                if not hits:
                    removed.append(0)
                    kept.append(data[w.start[f] : w.end[f + n - 1]] if n else b"")
                    continue
                gone = np.zeros(n + 1, np.int64)
                for x in hits:
                    windows = np.arange(x["n"]) if x["mask"] is None else np.flatnonzero(np.unpackbits(np.frombuffer(x["mask"], np.uint8), count=x["n"]))
                    np.add.at(gone, x["a"] + windows, 1)
                    np.add.at(gone, x["a"] + windows + width, -1)
                gone = np.cumsum(gone)[:n] > 0
                removed.append(int(gone.sum()))
                stay = np.flatnonzero(~gone) + f
                kept.append(b" ".join([data[s:e] for s, e in zip(w.start[stay].tolist(), w.end[stay].tolist())]))
            out = b.drop_columns(["hits"])
            for name, col in (("n_words", pa.array(counts, pa.int64())), ("n_removed", pa.array(removed, pa.int64())), ("kept", pa.array(kept, pa.binary()).cast(pa.string()))):
                out = out.append_column(name, col)
            yield out

    return run


def hot_minimisers(df: DataFrame, width: int, gram: int) -> np.ndarray:
    found = df.select("text").mapInArrow(_minimisers(width, gram), "mini long, n long, total long").groupBy("mini").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
    total = found.agg(F.sum("total")).first()[0] or 0
    rows = found.where(F.col("n") > max(64, total * HOT_SHARE)).select("mini").collect() if total else []
    return np.sort(np.array([r[0] for r in rows], np.int64).view(np.uint64))


def remove_repeats(docs: DataFrame, width: int = WIDTH, gram: int = GRAM, text: str = "text", bucket: int = BUCKET) -> DataFrame:
    """Adds n_words, n_removed (long) and kept (string: the words that stay, joined by one blank) to every row.

    A word goes if a window of ``width`` words that covers it starts anywhere else too, in any row or later in its own.
    Null and empty texts, and texts with fewer words than a window, lose nothing (null: no words, kept is empty). Repeated
    rows count as copies of each other, so all lose their windows. An empty table stays empty. Columns of docs stay, of any
    type and name, except that n_words, n_removed and kept are replaced.
    """
    spark: SparkSession = docs.sparkSession
    carried = Carried(docs, "n_words", "n_removed", "kept", text=text)
    scratch = Scratch(spark)
    plain = carried.frame.select("text")
    hot = hot_minimisers(plain, width, gram)
    buckets = plain.mapInArrow(_pack(width, gram, hot), "mini long, n long, packed binary").repartition(shuffle_width(spark), "mini").sortWithinPartitions("mini")
    repeated = repeated_strings(scratch.write(buckets.mapInArrow(_count(width, bucket), COUNTED), "counted"))
    del buckets
    scratch.drop()
    keyed = carried.frame.select("row", "text", *row_key(carried.frame))
    places = keyed.select(*ROW, "text").mapInArrow(_places(width, gram, hot), f"k1 long, k2 long, {ROW[0]} long, {ROW[1]} long, a long, n long")
    hits = places.join(repeated, ["k1", "k2"]).groupBy(*ROW).agg(F.collect_set(F.struct("a", "n", "mask")).alias("hits"))
    full = keyed.join(hits, list(ROW), "left").select("row", "text", "hits")
    out = full.mapInArrow(_remove(width), with_fields(full.drop("hits"), "n_words long, n_removed long, kept string"))
    return out.select(*carried.columns(), "n_words", "n_removed", "kept")


def digest(df: DataFrame) -> DataFrame:
    return df.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def brute_force(texts: list[str | None], width: int = WIDTH) -> list[tuple[int, int, str]]:
    """The definition, for tests."""
    from collections import Counter

    words = [(t or "").encode().split() for t in texts]
    seen = Counter(tuple(w[i : i + width]) for w in words for i in range(len(w) - width + 1))
    out = []
    for w in words:
        gone = {j for i in range(len(w) - width + 1) if seen[tuple(w[i : i + width])] > 1 for j in range(i, i + width)}
        kept = b" ".join(x for j, x in enumerate(w) if j not in gone)
        out.append((len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return out
