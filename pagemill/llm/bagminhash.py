"""Near-duplicates by BagMinHash: weighted Jaccard of word-shingle multisets.

Signature. A shingle with count c owns the weights 1..c, cut into the dyadic intervals (0, 1], (1, 2], (2, 4], ... Each
interval of each shingle has a Poisson process of its own, seeded by shingle and interval, with a rate of its length. A point
has a time, a component of the signature, and the unit of its interval it fell in (found by halving, one random bit a level);
it counts if that unit lies below c. A component's value is its first counted point. Two texts agree in a component with
probability sum(min) / sum(max), without bias. Points after a time by which all components are filled are never made; where
one is still empty, the text's time is extended.

Search. Texts with equal words are one node. ``BANDS`` bands of ``ROWS`` components each (miss probability 2e-5 at 0.8)
propose. Instead of all pairs of a band, every node meets the band's hub, the node with the most company over all bands, so
a group of copies costs links in proportion to its size; exact overlap decides. Then connected components are formed. A band
that still spans several of them is dealt to cells of bounded size, in which members of unlike components are compared: by
weight, by their signatures (5.3 standard deviations below the threshold, which one pair in 10 million at the threshold
misses), and those that have a partner left by exact overlap of their texts. Members of the band's largest component meet only
those outside it, so a large group of copies costs rows in proportion to its size. Only links leave a cell.

Wide bands. Members of bands with very many members outside the largest component meet where they share one of their rarest
shingles instead. In any order of all shingles, two texts at the threshold t share one of the first w - ceil(t * w) + 1 of
the w shingles of each (the first one they share lies there), so this loses no pair; rarest first keeps these groups small.
A group that is itself wide is taken within each wide band, and what is still wide is compared chunk by chunk. There the cells
compare counts of shingles in bins, which bound the overlap from above, instead of signatures.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from fractions import Fraction
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ROW, Carried, Scratch, grouped, named, row_key, shuffle_width, slices, trim
from .words import Words, digest, gram_hashes, mix, ranges

SHINGLE, THRESHOLD, BANDS, ROWS = 5, 0.8, 28, 5
#: Members of a band that meet at once, and bytes of text signed at once.
CELL, SIGN_BYTES = 1024, 1 << 20
#: Cells' worth of members outside its largest component from which members of a band meet by their rarest shingles.
WIDE = 8
#: Slots in which shingles are counted to tell the rare ones, and bins of a text's shingles that bound an overlap.
SLOTS, BINS = 1 << 20, 128
FULL = np.uint64(0xFFFFFFFFFFFFFFFF)
GOLD, SECOND = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def _times(x: np.uint64, k: int) -> np.uint64:
    return np.uint64(int(x) * k & 0xFFFFFFFFFFFFFFFF)


def shingles(w: Words, h: np.ndarray, n: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles and their texts; a shorter text has one shingle of all its words."""
    words = w.counts()
    windows = np.where(words >= n, words - n + 1, 0)
    at = np.repeat(w.first[:-1], windows) + ranges(windows)
    small = np.flatnonzero((words > 0) & (words < n))
    own = np.zeros(len(small), np.uint64)
    for k in range(1, n):
        own[words[small] == k] = gram_hashes(h, k)[w.first[small[words[small] == k]]]
    owner = np.concatenate([np.repeat(np.arange(len(words)), windows), small])
    grams = gram_hashes(h, n)
    return np.concatenate([grams[at] if len(at) else grams[:0], own]), owner


def bags(gram: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each text and their counts."""
    _, index, count = np.unique(mix(gram ^ mix(owner.astype(np.uint64) + np.uint64(1))), return_index=True, return_counts=True)
    return gram[index], owner[index], count


def signatures(gram: np.ndarray, owner: np.ndarray, count: np.ndarray, texts: int, size: int) -> np.ndarray:
    """texts x size; rows without shingles keep the largest value."""
    sig = np.full(texts * size, FULL)
    levels = np.ceil(np.log2(count)).astype(np.int64) + 1
    take = np.repeat(np.arange(len(gram)), levels)
    level = ranges(levels)
    length = np.where(level > 0, 1 << np.maximum(level - 1, 0), 1)
    below = np.where(level > 0, length, 0)
    seed = mix(gram[take] + level.astype(np.uint64) * GOLD)
    text, most = owner[take], count[take]
    weight = np.bincount(owner, count, texts)
    limit = size * (math.log(size) + 4) / np.maximum(weight, 1)
    todo = weight > 0
    while todo.any():
        live = np.flatnonzero(todo[text])
        time = np.zeros(len(live))
        k = 0
        while len(live):
            k += 1
            r = mix(seed[live] + _times(SECOND, k))
            time = time - np.log(((r >> np.uint64(11)).astype(float) + 0.5) / (1 << 53)) / length[live]
            on = time <= limit[text[live]]
            live, time, r = live[on], time[on], r[on]
            r = mix(r ^ GOLD)
            unit = (r >> np.uint64(32)).astype(np.int64) & (length[live] - 1)
            hit = below[live] + unit < most[live]
            point = (time[hit].view(np.uint64) & ~np.uint64(0xFFFFFF)) | (mix(r[hit]) & np.uint64(0xFFFFFF))
            np.minimum.at(sig, text[live][hit] * size + ((r[hit] & np.uint64(0xFFFFFFFF)) % np.uint64(size)).astype(np.int64), point)
        todo &= (sig.reshape(texts, size) == FULL).any(1)
        limit = limit * 3
    return sig.reshape(texts, size)


def _sign(bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, limit=SIGN_BYTES):
            w = Words(b.column("text"), tidy=True)
            h, n = w.hashes(), b.num_rows
            bag = bags(*shingles(w, h))
            sig = signatures(*bag, n, bands * rows)
            keys = [gram_hashes(np.ascontiguousarray(sig[:, i * rows : (i + 1) * rows]).ravel(), rows)[::rows] if n else np.zeros(0, np.uint64) for i in range(bands)]
            keys = np.stack([mix(k + _times(GOLD, i + 1)) for i, k in enumerate(keys)], 1).view(np.int64)
            short = (mix(sig) & np.uint64(0xFFFF)).astype(np.uint16)
            empty, data, at = w.counts() == 0, w.data.tobytes(), w.offsets.tolist()
            node = [data[x:y].rstrip(b" ") for x, y in zip(at, at[1:])]
            out = b.drop_columns(["text"])
            out = out.append_column("node", pa.array([None if e else digest([x], 16) for e, x in zip(empty.tolist(), node)], pa.binary()))
            out = out.append_column("weight", pa.array(np.bincount(bag[1], bag[2], n).astype(np.int64)))
            out = out.append_column("bands", pa.array([None if e else k for e, k in zip(empty.tolist(), keys)], pa.list_(pa.int64())))
            yield out.append_column("sig", pa.array([x.tobytes() for x in short], pa.binary()))

    return run


def overlaps(x: np.ndarray, y: np.ndarray, ratio: tuple[int, int]) -> bool:
    """Of sorted shingle lists: the j-th copy of a value in one meets the j-th in the other."""
    low, high = np.searchsorted(y, x, "left"), np.searchsorted(y, x, "right")
    nth = np.arange(len(x)) - np.searchsorted(x, x, "left")
    both = int((nth < high - low).sum())
    return ratio[1] * both >= ratio[0] * (len(x) + len(y) - both)


def sorted_shingles(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All shingles by text and value, and where each text begins."""
    w = Words(texts)
    gram, owner = shingles(w, w.hashes())
    order = np.lexsort((gram, owner))
    return gram[order], np.searchsorted(owner[order], np.arange(len(texts) + 1))


def _verify(ratio: tuple[int, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(slices(batches, "text_a"), "text_b"):
            (x, f), (y, g) = (sorted_shingles(b.column(c)) for c in ("text_a", "text_b"))
            keep = [overlaps(x[f[i] : f[i + 1]], y[g[i] : g[i + 1]], ratio) for i in range(b.num_rows)]
            yield b.filter(pa.array(keep, pa.bool_())).select(["a", "b"])

    return run


def copies(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Shingles by text, the j-th copy of one with a hash of its own, and where each text begins: overlaps are those of sets."""
    gram, first = sorted_shingles(texts)
    at = np.arange(len(gram))
    new = np.ones(len(gram), bool)
    new[1:] = gram[1:] != gram[:-1]
    new[first[:-1][first[:-1] < len(gram)]] = True
    return mix(gram + (at - np.maximum.accumulate(np.where(new, at, 0))).astype(np.uint64) * GOLD), first


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(SLOTS, np.int64)
    for b in slices(batches):
        total += np.bincount((copies(b.column("text"))[0] & np.uint64(SLOTS - 1)).astype(np.int64), minlength=SLOTS)
    on = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(on), pa.array(total[on])], ["slot", "n"])


def _mark(ratio: tuple[int, int], often: np.ndarray):
    """Of each text its rarest shingles, by the counts of their slots: as many as hold one of any text at the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            token, first = copies(b.column("text"))
            weight = np.diff(first)
            owner = np.repeat(np.arange(b.num_rows), weight)
            bins = np.bincount(owner * BINS + (token >> np.uint64(32)).astype(np.int64) % BINS, minlength=b.num_rows * BINS).astype(np.uint32)
            token = token[np.lexsort((token, often[(token & np.uint64(SLOTS - 1)).astype(np.int64)], owner))]
            many = np.minimum(weight + ratio[0] * weight // -ratio[1] + 1, weight)
            marks = token[np.repeat(first[:-1], many) + ranges(many)].view(np.int64)
            out = b.select(["node"]).append_column("weight", pa.array(weight.astype(np.int64)))
            out = out.append_column("sig", pa.array([x.tobytes() for x in bins.reshape(-1, BINS)], pa.binary()))
            yield out.append_column("marks", pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(many)]).astype(np.int32)), pa.array(marks)))

    return run


class Cell:
    """Members of a cell of a band: the chunk of side 0 against itself, or against the chunk of side 1.

    Where they are bounded, sig holds the counts of their shingles in bins, else their signature.
    """

    def __init__(self, rows: list[dict], ratio: tuple[int, int], bounded: bool = False):
        self.rows, self.ratio, self.bounded = rows, ratio, bounded
        names = {c: i for i, c in enumerate(dict.fromkeys(r["comp"] for r in rows))}
        self.comp, self.comps = np.array([names[r["comp"]] for r in rows]), len(names)
        self.side, self.weight = np.array([r["side"] for r in rows]), np.array([r["weight"] for r in rows])
        self.sig = np.stack([np.frombuffer(r["sig"], np.uint32 if bounded else np.uint16) for r in rows])
        n, least = self.sig.shape[1], ratio[0] / ratio[1]
        # what agrees this rarely is below the threshold, but for one pair in 10 million at the threshold itself
        self.agree = least * n - 5.3 * math.sqrt(least * (1 - least) * n)

    def near(self, x: int, y: np.ndarray) -> np.ndarray:
        if not self.bounded:
            return (self.sig[y] == self.sig[x]).sum(1) >= self.agree
        both = np.minimum(self.sig[y], self.sig[x]).sum(1, dtype=np.int64)
        return self.ratio[1] * both >= self.ratio[0] * (self.weight[x] + self.weight[y] - both)

    def pairs(self) -> Iterator[tuple[int, np.ndarray]]:
        """Members, and those of other components that may reach the threshold with them; a pair comes once."""
        if self.comps < 2:
            return
        crossed, number = self.side.max() != self.side.min(), np.arange(len(self.rows))
        upper, lower = self.weight * self.ratio[1], self.weight * self.ratio[0]
        for x in range(len(self.rows)):
            if crossed and self.side[x]:
                continue
            other = (self.comp != self.comp[x]) & (upper >= lower[x]) & (upper[x] >= lower)
            y = np.flatnonzero(other & ((self.side != self.side[x]) if crossed else number > x))
            if len(y):
                y = y[self.near(x, y)]
            if len(y):
                yield x, y


def _meet(ratio: tuple[int, int], bounded: bool):
    """The members of a cell that have anyone to be compared with."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in grouped(batches, "cell"):
            keep: set[int] = set()
            for x, y in Cell(rows, ratio, bounded).pairs():
                keep |= {x, *y.tolist()}
            if keep:
                yield pa.RecordBatch.from_pylist([rows[i] for i in sorted(keep)], CELL_TYPE)
            trim()

    return run


def _compare(ratio: tuple[int, int], bounded: bool):
    """Links between components inside a cell, by exact overlap."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in grouped(batches, "cell"):
            c, out = Cell(rows, ratio, bounded), []
            root = np.arange(c.comps)
            gram, first = sorted_shingles(pa.array([r["text"] for r in rows], pa.string()))
            for x, y in c.pairs():
                for i in y.tolist():
                    if root[c.comp[i]] != root[c.comp[x]] and overlaps(gram[first[x] : first[x + 1]], gram[first[i] : first[i + 1]], ratio):
                        out.append({"a": min(rows[x]["node"], rows[i]["node"]), "b": max(rows[x]["node"], rows[i]["node"])})
                        root[root == root[c.comp[i]]] = root[c.comp[x]]
            if out:
                yield pa.RecordBatch.from_pylist(out, pa.schema([("a", pa.binary()), ("b", pa.binary())]))
            trim()

    return run


CELL_SCHEMA = "cell long, side int, node binary, comp binary, weight long, sig binary"
CELL_TYPE = pa.schema([("cell", pa.int64()), ("side", pa.int32()), ("node", pa.binary()), ("comp", pa.binary()), ("weight", pa.int64()), ("sig", pa.binary())])


def several(members: DataFrame) -> DataFrame:
    """Of band, node, comp: the members of bands with more than one component; main tells those of the largest one, n how
    many are not in it, m how many are."""
    sizes = members.groupBy("band", "comp").agg(F.count("*").alias("k"))
    bands = sizes.groupBy("band").agg(F.max(F.struct("k", "comp")).alias("top"), F.sum("k").alias("all")).where("all > top.k")
    return members.join(bands, "band").select("band", "node", "comp", (F.col("comp") == F.col("top.comp")).alias("main"), (F.col("all") - F.col("top.k")).alias("n"), F.col("top.k").alias("m"))


def marked(far: DataFrame, texts: DataFrame, scratch: Scratch, ratio: tuple[int, int], most: int) -> tuple[DataFrame, DataFrame]:
    """Of members of wide bands: groups (as bands) by their rarest shingles, and node, weight, sig with the counts in bins.

    Members of unlike components that share a band and reach the threshold share a group. Of groups with the same members one
    stays. A group with more than ``most`` members outside its largest component is taken within each band.
    """
    kinds = "band", "node", "comp", "main", "n", "m"
    text = scratch.write(texts.join(far.select("node").distinct(), "node"), "far")
    counts = text.mapInArrow(_count, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    often = np.zeros(SLOTS, np.uint32)
    often[counts.column("slot").to_numpy()] = np.minimum(counts.column("n").to_numpy(), 0xFFFFFFFF)
    marks = scratch.write(text.mapInArrow(_mark(ratio, often), "node binary, weight long, sig binary, marks array<long>"), "marks")
    each = marks.select("node", F.explode("marks").alias("band")).join(far.select("node", "comp").distinct(), "node")
    comp, node = F.xxhash64("comp"), (F.xxhash64("node"), F.xxhash64(F.lit(7), "node"))
    sets = each.groupBy("band").agg(F.min(comp).alias("x"), F.max(comp).alias("y"), F.count("*").alias("k"), *(F.bit_xor(h).alias(f"h{i}") for i, h in enumerate(node)))
    one = sets.where("x <> y").groupBy("k", "h0", "h1").agg(F.min("band").alias("band")).select("band")
    groups = scratch.write(several(scratch.write(each.join(one, "band"), "unlike")), "groups")
    wide = groups.where(F.col("n") > most).select(F.col("band").alias("mark"), "node")
    within = wide.join(far.select("band", "node", "comp"), "node").select(F.xxhash64("band", "mark").alias("band"), "node", "comp")
    return groups.where(F.col("n") <= most).select(*kinds).unionByName(several(scratch.write(within, "within")).select(*kinds)), marks.select("node", "weight", "sig")


def dealt(members: DataFrame, cell: int) -> DataFrame:
    """cell, side, node, comp. Members outside the largest component are cut into chunks that meet each other and each chunk
    of the largest one; chunks of the largest one do not meet."""
    mine, chunks, main = F.pmod(F.xxhash64("node"), F.ceil(F.col("n") / cell)).cast("int"), F.ceil(F.col("n") / cell).cast("int"), F.ceil(F.col("m") / cell).cast("int")
    few = members.where("not main").withColumn("mine", mine)
    inner = few.withColumn("other", F.explode(F.sequence(F.lit(0), chunks - 1)))
    inner = inner.select(F.xxhash64("band", F.least("mine", "other"), F.greatest("mine", "other")).alias("cell"), (F.col("mine") > F.col("other")).cast("int").alias("side"), "node", "comp")
    across = few.withColumn("other", F.explode(F.sequence(F.lit(0), main - 1))).select(F.xxhash64(F.lit(1), "band", "mine", "other").alias("cell"), F.lit(0).alias("side"), "node", "comp")
    large = members.where("main").withColumn("mine", F.pmod(F.xxhash64("node"), main).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), chunks - 1)))
    large = large.select(F.xxhash64(F.lit(1), "band", "other", "mine").alias("cell"), F.lit(1).alias("side"), "node", "comp")
    return inner.unionByName(across).unionByName(large)


def components(links: DataFrame, scratch: Scratch, tag: str) -> DataFrame:
    """node, comp: the least node that links reach. Labels pass to neighbours and jump to their label's label until none changes."""
    edges = scratch.write(links.select("a", "b").union(links.select("b", "a")).distinct(), f"edges_{tag}")
    labels = scratch.write(edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("comp")), f"labels_{tag}_0")
    step = 0
    while True:
        step += 1
        near = edges.join(labels.select(F.col("node").alias("b"), "comp"), "b").groupBy(F.col("a").alias("node")).agg(F.min("comp").alias("m"))
        hooked = labels.join(near, "node").select("node", F.col("comp").alias("old"), F.least("comp", "m").alias("comp"))
        up = labels.select(F.col("node").alias("comp"), F.col("comp").alias("above"))
        new = scratch.write(hooked.join(up, "comp", "left").select("node", F.least("comp", "above").alias("comp"), "old"), f"labels_{tag}_{step}")
        changed = new.where("comp <> old").limit(1).count()
        labels = new.select("node", "comp")
        scratch.drop(f"labels_{tag}_{step - 1}")
        if not changed:
            scratch.drop(f"edges_{tag}")
            return labels


def classes(docs: DataFrame, id_col: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, bands: int = BANDS, rows: int = ROWS, cell: int = CELL, wide: int = WIDE) -> DataFrame:
    """A row for each row of docs: the key of its row (ROW), id_col, class_id, class_size and first (the row that stays).

    Texts whose shingle multisets overlap by ``threshold`` or more are linked; a class is a connected component, class_id the
    least id in it. Null and empty texts (no words) are classes of their own. Repeated rows are copies of each other, and one
    is first. Null ids come after others; a class of null ids has a null class_id. An empty table stays empty. Other columns
    only count for the key of the row.
    """
    scratch, ratio = Scratch(docs.sparkSession), Fraction(str(threshold)).as_integer_ratio()
    width = shuffle_width(docs.sparkSession)
    source = docs.select(*row_key(docs), named(id_col).cast("long").alias("id"), named(text).alias("text"))
    keys = ", ".join(f"{c} long" for c in ROW)
    signed = scratch.write(source.mapInArrow(_sign(bands, rows), f"{keys}, id long, node binary, weight long, bands array<long>, sig binary").withColumn("n", F.monotonically_increasing_id()), "signed")
    nodes = signed.where("node is not null").groupBy("node").agg(*(F.first(c).alias(c) for c in ("bands", "weight", "sig")), F.min(F.struct(*ROW)).alias("row"))
    nodes = scratch.write(nodes, "nodes")
    each = nodes.select("node", "weight", F.explode("bands").alias("band"))
    shared = each.groupBy("band").agg(F.count("*").alias("n")).where("n > 1")
    members = scratch.write(each.join(shared, "band"), "members")
    central = members.groupBy("node").agg(F.sum("n").alias("score"))
    hubs = members.join(central, "node").groupBy("band").agg(F.max(F.struct("score", "node", "weight")).alias("hub"))
    near = F.least("weight", "hub.weight") * ratio[1] >= F.greatest("weight", "hub.weight") * ratio[0]  # else the overlap cannot do
    first = members.join(hubs, "band").where((F.col("node") != F.col("hub.node")) & near)
    pairs = first.select(F.least("node", "hub.node").alias("a"), F.greatest("node", "hub.node").alias("b")).distinct()
    need = nodes.join(members.select("node").distinct(), "node", "left_semi").select("node", "row.*")
    texts = scratch.write(source.select(*ROW, "text").join(need, list(ROW)).select("node", "text").dropDuplicates(["node"]), "texts")
    a, b = (texts.select(F.col("node").alias(c), F.col("text").alias(f"text_{c}")) for c in "ab")
    met = pairs.join(a, "a").join(b, "b").select("a", "b", "text_a", "text_b")
    links = scratch.write(met.mapInArrow(_verify(ratio), "a binary, b binary"), "links")
    comps = components(links, scratch, "one")
    # bands that still span several components: their members meet in cells, first by signatures, then by text
    label = members.join(comps, "node", "left").select("band", "node", F.coalesce("comp", "node").alias("comp"))
    label = scratch.write(several(label), "several")
    far = label.where(F.col("n") > cell * wide)
    rounds = [(label.where(F.col("n") <= cell * wide), nodes.select("node", "weight", "sig"), False)]
    if far.limit(1).count():
        rounds.append((*marked(far, texts, scratch, ratio, cell * wide), True))
    at_cell = lambda df: df.repartition(width, "cell").sortWithinPartitions("cell")
    found = []
    for i, (groups, facts, bounded) in enumerate(rounds):
        cells = dealt(groups, cell).join(facts, "node").select("cell", "side", "node", "comp", "weight", "sig")
        close = scratch.write(at_cell(cells).mapInArrow(_meet(ratio, bounded), CELL_SCHEMA), f"close_{i}")
        found.append(scratch.write(at_cell(close.join(texts, "node")).mapInArrow(_compare(ratio, bounded), "a binary, b binary"), f"more_{i}"))
        scratch.drop(f"close_{i}")
    more = reduce(DataFrame.union, found)
    if more.limit(1).count():
        comps = components(links.union(more), scratch, "two")
    scratch.drop("nodes", "members", "texts", "several", "far", "marks", "unlike", "groups", "within")
    labelled = signed.drop("bands", "weight", "sig").join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node", F.concat(F.lit("empty ").cast("binary"), F.col("n").cast("string").cast("binary"))))
    kinds = labelled.groupBy("comp").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "n")).alias("least"), F.count("*").alias("class_size"))
    out = labelled.join(scratch.write(kinds, "kinds"), "comp")  # written, so that the join's shuffle can split a large class
    return out.select(*ROW, F.col("id").alias(id_col), F.col("least.id").alias("class_id"), "class_size", (F.col("n") == F.col("least.n")).alias("first"))


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """One row of each class, with the columns of docs, of any type and name.

    The row with the least id stays (null ids come last). Null and empty texts all stay, but for repeated rows, of which one
    stays. An empty table stays empty.
    """
    keys = classes(docs, id_col, text, **how).where("first").select(*ROW).distinct()
    carried = Carried(docs)
    rows = docs.select(F.struct(*(named(c) for c in docs.columns)).alias("row"), *row_key(docs))
    return rows.join(keys, list(ROW)).dropDuplicates(list(ROW)).select(*carried.columns())


def overlap(a: str, b: str, n: int = SHINGLE) -> float:
    """Weighted Jaccard by the definition, for tests."""
    bag = []
    for t in (a, b):
        w = t.encode().split()
        bag.append(Counter(tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))) if w else Counter())
    return sum((bag[0] & bag[1]).values()) / max(1, sum((bag[0] | bag[1]).values()))
