"""Katz backoff model of any order: Good-Turing discounts, exactly normalised backoff weights, scores for every text.

    P(w | h) = d(c(hw)) c(hw) / c(h)        if hw was seen, else  alpha(h) P(w | h without its first word)
    P(w)     = d(c(w)) c(w) / N             if w was seen, else the mass that discounting left (one unknown word)

with alpha(h) such that P(. | h) sums to 1 over the known words and the unknown one; a context never seen backs off whole.
Before a text's first word stands a mark as often as the order asks.

Layout. Texts become blocks of some million tokens: a table in the shared folder with each block's word list and token codes.
Orders are handled one after the other, as P of an order needs P of the one below. Only a block's distinct n-grams travel, as
compressed arrays, to the buckets of that order's count table (a table in the shared folder, a partition for some contexts);
what comes back to a block are the counts of exactly those n-grams and their contexts' sums. Words go by their hash and get
numbers there. N-grams go by their context, so that one bucket sees all followers of a context; a context with more than
1 / ``hot`` of all tokens goes by n-gram instead, and its sums (at most ``hot`` contexts by construction) are added up afterwards.
The number of buckets follows the tokens. The driver sees count-of-count numbers and those bounded sums only.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, grouped, grow, named, shrink, shuffle_width, slices, trim
from .words import Words, mix

#: Counts up to TOP are discounted.
TOP = 5
ORDER = 2
#: Tokens of a block, and of a bucket on average at most.
BLOCK_TOKENS, BUCKET_TOKENS = 1_500_000, 400_000
HOT = 4096
#: Keys of the end of a text and of the context before its first word.
END, BEGIN = np.uint64(1), np.uint64(2)


def discounts(n: list[int]) -> list[float]:
    """Katz's d for counts 0..TOP, of n[r] items with count r (r up to TOP + 1).

    Where Good-Turing gives no value in (0, 1) (few data), absolute discounting by n1 / (n1 + 2 n2), or a half, is used for all.
    """
    d = [1.0]
    if all(n[1 : TOP + 2]):
        a = (TOP + 1) * n[TOP + 1] / n[1]
        d += [((r + 1) * n[r + 1] / (r * n[r]) - a) / (1 - a) if a != 1 else 0.0 for r in range(1, TOP + 1)]
    if len(d) == 1 or not all(0 < x < 1 for x in d[1:]):
        cut = n[1] / (n[1] + 2 * n[2]) if n[1] and n[2] else 0.5
        d = [1.0, *((r - cut) / r for r in range(1, TOP + 1))]
    return d


class Unigrams:
    """P(w) by count. total: tokens; kinds: distinct; n: count of counts."""

    def __init__(self, total: int, kinds: int, n: list[int]):
        self.total, self.kinds, self.d = total, kinds, np.array(discounts(n))
        left = sum((1 - self.d[r]) * r * n[r] for r in range(1, TOP + 1)) / total if total else 1.0
        # with no count small enough to discount, the unknown word gets the share of one more token
        self.scale = 1.0 if left > 0 else total / (total + 1)
        self.unknown = left if left > 0 else 1 / (total + 1)

    def p(self, c: np.ndarray) -> np.ndarray:
        c = c.astype(np.int64)
        known = self.d[np.where(c <= TOP, c, 0)] * c * (self.scale / max(self.total, 1))
        return np.where(c > 0, known, self.unknown)


def backoff(d: np.ndarray, c: np.ndarray, n: np.ndarray, seen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """alpha and the scale of seen followers, for contexts with count c, n[:, r - 1] followers of count r, and the
    sum of P(w) over followers."""
    safe = np.maximum(c, 1).astype(float)
    left = (n * np.arange(1, TOP + 1) * (1 - d[1:])).sum(1) / safe
    none = left <= 0
    scale = np.where(none, safe / (safe + 1), 1.0)
    left = np.where(none, 1 / (safe + 1), left)
    return np.where(c > 0, left / np.maximum(1 - seen, 1e-300), 1.0), scale


# blocks


def _block(block: int, parts: list) -> dict:
    h = np.concatenate([p[0] for p in parts])
    counts = np.concatenate([p[1] for p in parts])
    train = np.concatenate([p[2] for p in parts])
    words, inverse, times = np.unique(h, return_inverse=True, return_counts=True)
    order = np.argsort(-times, kind="stable")
    rank = np.empty(len(order), np.uint32)
    rank[order] = np.arange(len(order), dtype=np.uint32)
    codes, words = rank[inverse], words[order]
    learn = np.bincount(codes, np.repeat(train, counts), len(words)).astype(np.uint32)
    # the context before the first word is listed too, as the last entry, with the number of texts learned from
    return {
        "block": block,
        "ids": [x for p in parts for x in p[3]],
        "train": train.astype(np.uint8).tobytes(),
        "counts": shrink(counts.astype(np.uint32)),
        "tokens": int(counts.sum()),
        "words": np.append(words, BEGIN).tobytes(),
        "learn": shrink(np.append(learn, np.uint32(train.sum()))),
        "codes": shrink(codes),
    }


BLOCK = "block long, ids array<long>, tokens long, train binary, counts binary, words binary, learn binary, codes binary"
BLOCK_TYPE = pa.schema([("block", pa.int64()), ("ids", pa.list_(pa.int64())), ("tokens", pa.int64()), *((c, pa.binary()) for c in ("train", "counts", "words", "learn", "codes"))])


def _blocks(batches: Iterator[pa.RecordBatch], tokens: int) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    number, parts, size = TaskContext.get().partitionId() << 32, [], 0
    for b in slices(batches):
        w = Words(b.column("text"), lower=True)
        counts = w.counts() + 1
        h = np.empty(len(w) + b.num_rows, np.uint64)
        ends = np.cumsum(counts) - 1
        place = np.ones(len(h), bool)
        place[ends] = False
        h[place], h[ends] = w.hashes(), END
        parts.append((h, counts, np.asarray(b.column("train").fill_null(False).cast(pa.uint8())).astype(bool), b.column("id").to_pylist()))
        size += len(h)
        if size > tokens:
            yield pa.RecordBatch.from_pylist([_block(number, parts)], BLOCK_TYPE)
            number, parts, size = number + 1, [], 0
    if parts:
        yield pa.RecordBatch.from_pylist([_block(number, parts)], BLOCK_TYPE)


def _split(bucket: np.ndarray, *keys: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Indices of each bucket's entries, in the order of keys (the last first)."""
    order = np.lexsort((*keys, bucket))
    cuts = np.flatnonzero(np.diff(bucket[order].astype(np.int64), prepend=-1))
    for x, y in zip(cuts.tolist(), np.append(cuts[1:], len(order)).tolist()):
        yield int(bucket[order[x]]), order[x:y]


MAIL = "bucket long, block long, a binary, b binary, c binary, d binary"
MAIL_TYPE = pa.schema([("bucket", pa.int64()), ("block", pa.int64()), *((c, pa.binary()) for c in "abcd")])


def _mail(rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, MAIL_TYPE)


# words


def _send_words(buckets: int):
    def run(batches):
        for b in batches:
            for row in b.to_pylist():
                words, learn = np.frombuffer(row["words"], np.uint64), grow(row["learn"], np.uint32)
                yield _mail([{"bucket": k, "block": row["block"], "a": words[i].tobytes(), "b": shrink(learn[i])} for k, i in _split(words % np.uint64(buckets), words)])

    return run


def _add_words(buckets: int):
    def run(batches):
        for bucket, rows in grouped(batches, "bucket"):
            words = [np.frombuffer(r["a"], np.uint64) for r in rows]
            kinds, inverse = np.unique(np.concatenate(words), return_inverse=True)
            total = np.bincount(inverse, np.concatenate([grow(r["b"], np.uint32) for r in rows]), len(kinds)).astype(np.int64)
            order = np.argsort(-total, kind="stable")
            number = np.empty(len(order), np.int64)
            number[order] = np.arange(len(order)) * buckets + bucket
            out, at = [], 0
            for r, w in zip(rows, words):
                i = inverse[at : at + len(w)]
                at += len(w)
                out.append({"bucket": bucket, "block": r["block"], "a": shrink(number[i]), "b": shrink(total[i])})
            real = total[(kinds != BEGIN) & (total > 0)]
            few = np.bincount(real[real <= TOP + 1], minlength=TOP + 2)
            out.append({"bucket": bucket, "block": -1, "a": np.array([real.sum(), len(real), *few[1:]], np.int64).tobytes()})
            yield _mail(out)

    return run


class Grams:
    """The distinct n-grams of a block: number of the context among the n-grams one shorter (the last: the begin of a text),
    word, n-gram that stays without the first word; of: which one each token ends."""

    def __init__(self, k: Block, of: np.ndarray, key: np.ndarray, often: np.ndarray):
        before = np.empty(len(of), np.int64)
        before[1:] = of[:-1]
        before[k.first] = len(key) - 1
        both, at, self.of = np.unique(before * k.kinds + k.codes, return_index=True, return_inverse=True)
        self.context, self.word = np.divmod(both, k.kinds)
        self.short, self.context_key, self.often = of[at], key[self.context], often[self.context]

    def learned(self, k: Block) -> np.ndarray:
        return np.bincount(self.of, np.repeat(k.train, k.counts), len(self.word)).astype(np.int64)

    def key(self, k: Block) -> np.ndarray:
        return mix(mix(self.context_key.astype(np.uint64) + np.uint64(1)) ^ k.number_of[self.word].astype(np.uint64)).view(np.int64)

    def split(self, k: Block, buckets: int, tokens: int, hot: int) -> Iterator[tuple[int, np.ndarray]]:
        c, w = self.context_key, k.number_of[self.word]
        place = mix(c.astype(np.uint64) + np.uint64(1))
        far = self.often * hot > tokens
        place = np.where(far, mix(place ^ w.astype(np.uint64)), place)
        return _split(place % np.uint64(buckets), w, c)


class Block:
    """A block with what has come back to it: grams, count and p of the highest order that is known."""

    def __init__(self, rows: list[dict], buckets: int, hot: int, uni: Unigrams, known: list[Known], final: bool):
        own = next(r for r in rows if r["kind"] == 0)
        self.number, self.ids = own["block"], own["ids"]
        self.train, self.counts = np.frombuffer(own["train"], np.uint8).astype(bool), grow(own["counts"], np.uint32).astype(np.int64)
        words, self.codes = np.frombuffer(own["words"], np.uint64), grow(own["codes"], np.uint32).astype(np.int64)
        self.kinds = len(words)
        back = {(r["kind"], r["bucket"]): r for r in rows}
        self.number_of, self.total = np.empty(len(words), np.int64), np.empty(len(words), np.int64)
        for b, i in _split(words % np.uint64(buckets), words):
            r = back[1, b]
            self.number_of[i], self.total[i] = grow(r["a"], np.int64), grow(r["b"], np.int64)
        self.first = np.cumsum(self.counts) - self.counts
        # what the next order's contexts are: n-gram of each token, key and count of each, with the begin of a text at the end
        self.of, self.key, self.count = self.codes, self.number_of, self.total
        self.p = uni.p(self.total)
        for order, sums in enumerate(known, 2):
            self.learn(order, back, buckets, hot, uni, sums, not final or order <= len(known))

    def grams(self) -> Grams:
        return Grams(self, self.of, self.key, self.count)

    def learn(self, order: int, back: dict, buckets: int, hot: int, uni: Unigrams, sums: Known, more: bool) -> None:
        """From order - 1 to order; more: another order will follow."""
        g = self.grams()
        n_grams = len(g.word)
        count, alpha, scale = np.empty(n_grams, np.int64), np.empty(n_grams), np.empty(n_grams)
        for bucket, i in g.split(self, buckets, uni.total, hot):
            r = back[order, bucket]
            count[i] = grow(r["a"], np.int64)
            new = np.flatnonzero(np.diff(g.context_key[i], prepend=g.context_key[i[0]] - 1))
            c, runs = i[new], np.diff(np.append(new, len(i)))
            n, seen = grow(r["b"], np.uint32).reshape(TOP, -1).T.astype(np.int64), grow(r["c"], np.float64)
            far = g.often[c] * hot > uni.total
            if far.any():
                at = np.searchsorted(sums.key, g.context_key[c[far]])
                n[far], seen[far] = sums.n[at], sums.seen[at]
            x, y = backoff(sums.d, g.often[c], n, seen)
            alpha[i], scale[i] = np.repeat(x, runs), np.repeat(y, runs)
        of = np.maximum(g.often, 1)
        p = np.where(count > 0, sums.d[np.where(count <= TOP, count, 0)] * count / of * scale, alpha * self.p[g.short])
        begin = self.key[-1], self.count[-1]
        self.of, self.p = g.of, p
        if more:
            self.key, self.count = np.append(g.key(self), begin[0]), np.append(count, begin[1])


class Known:
    """An order's discounts, and the sums of its frequent contexts."""

    def __init__(self, rows: list):
        sums = {r["key"]: r for r in rows}
        few = sums.pop(-1, None)
        names = sorted(sums)
        self.key = np.array(names, np.int64)
        self.n = np.array([[sums[c][x] for x in COLS[1:-1]] for c in names], np.int64).reshape(-1, TOP)
        self.seen = np.array([sums[c]["seen"] for c in names], float)
        self.d = np.array(discounts([few[c] for c in COLS] if few else [0] * (TOP + 2)))


def _blocks_of(batches, *how):
    for _, rows in grouped(batches, "block"):
        yield Block(rows, *how)
        trim()


def _send_grams(buckets: int, hot: int, uni: Unigrams, known: list[Known]):
    """Of a block's n-grams, for each bucket: contexts (a), words (b), learned counts and lower P (c), contexts' counts and runs (d)."""

    def run(batches):
        for k in _blocks_of(batches, buckets, hot, uni, known, False):
            g, out = k.grams(), []
            learned = g.learned(k)
            lower = k.p[g.short].view(np.int64) if known else k.total[g.word]
            for bucket, i in g.split(k, buckets, uni.total, hot):
                c = g.context_key[i]
                new = np.flatnonzero(np.diff(c, prepend=c[0] - 1))
                runs = np.diff(np.append(new, len(i)))
                out.append({"bucket": bucket, "block": k.number, "a": shrink(np.diff(c[new], prepend=0)), "b": shrink(k.number_of[g.word[i]]), "c": shrink(np.stack([learned[i], lower[i]]).ravel()), "d": shrink(np.stack([g.often[i[new]], runs]).ravel())})
                if len(out) == 64:
                    yield _mail(out)
                    out = []
            if out:
                yield _mail(out)

    return run


def _followers(context, c, p):
    """For sorted contexts: where each begins, followers with count 1..TOP, and the sum of P."""
    starts = np.flatnonzero(np.diff(context, prepend=context[0] - 1))
    n = np.stack([np.add.reduceat((c == r).astype(np.int64), starts) for r in range(1, TOP + 1)], 1)
    return starts, n, np.add.reduceat(np.where(c > 0, p, 0.0), starts)


def _add_grams(uni: Unigrams, share: int, first: bool):
    def run(batches):
        for bucket, rows in grouped(batches, "bucket"):
            heads = [grow(r["d"], np.int64).reshape(2, -1) for r in rows]
            runs = np.concatenate([h[1] for h in heads])
            context = np.repeat(np.concatenate([np.cumsum(grow(r["a"], np.int64)) for r in rows]), runs)
            often = np.repeat(np.concatenate([h[0] for h in heads]), runs)
            words = [grow(r["b"], np.int64) for r in rows]
            size, word = [len(x) for x in words], np.concatenate(words)
            both = [grow(r["c"], np.int64).reshape(2, -1) for r in rows]
            learned, lower = (np.concatenate([x[i] for x in both]) for i in (0, 1))
            order = np.lexsort((word, context))
            s, t = context[order], word[order]
            new = np.ones(len(s), bool)
            new[1:] = (s[1:] != s[:-1]) | (t[1:] != t[:-1])
            start = np.flatnonzero(new)
            gram = np.empty(len(s), np.int64)
            gram[order] = np.cumsum(new) - 1
            count, lower = np.add.reduceat(learned[order], start), lower[order[start]]
            starts, n, seen = _followers(s[start], count, uni.p(lower) if first else lower.view(np.float64))
            names, often = s[start][starts], often[order[start]][starts]
            hot = often * share > uni.total
            out, at = [], 0
            for r, m, h in zip(rows, size, heads):
                which = np.searchsorted(names, context[at + np.cumsum(h[1]) - h[1]])
                out.append({"bucket": bucket, "block": r["block"], "a": shrink(count[gram[at : at + m]]), "b": shrink(np.ascontiguousarray(n[which].T.astype(np.uint32)).ravel()), "c": shrink(seen[which])})
                at += m
            few = np.bincount(count[count <= TOP + 1], minlength=TOP + 2)
            out.append({"bucket": bucket, "block": -1, "a": few.astype(np.int64).tobytes(), "b": names[hot].tobytes(), "c": n[hot].astype(np.int64).tobytes(), "d": seen[hot].tobytes()})
            yield _mail(out)
            trim()

    return run


COLS = [f"n{r}" for r in range(TOP + 2)]
SUMS = ", ".join(["key long", *(f"{c} long" for c in COLS), "seen double"])


def _sums(batches):
    """Partial sums as rows: counts of counts (key -1), and those of each frequent context."""
    for b in batches:
        for r in b.to_pylist():
            keys, seen = np.frombuffer(r["b"], np.int64), np.frombuffer(r["d"], float)
            n = np.zeros((len(keys) + 1, TOP + 2), np.int64)
            n[0], n[1:, 1:-1] = np.frombuffer(r["a"], np.int64), np.frombuffer(r["c"], np.int64).reshape(-1, TOP)
            yield pa.record_batch({"key": np.append(-1, keys), **{c: n[:, i] for i, c in enumerate(COLS)}, "seen": np.append(0.0, seen)})


# scores


def _score(buckets: int, hot: int, uni: Unigrams, known: list[Known]):
    kinds = [("id", pa.int64()), ("train", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())]

    def run(batches):
        for k in _blocks_of(batches, buckets, hot, uni, known, True):
            add = lambda v: np.add.reduceat(v, k.first) if len(k.first) else v
            base = np.log10((k.total + 1) / (uni.total + uni.kinds + 1))
            cols = (k.ids, k.train, k.counts, add((k.total[k.codes] > 0).astype(np.int64)), np.full(len(k.ids), uni.total), add(base[k.codes]), add(np.log10(k.p)[k.of]))
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, (_, t) in zip(cols, kinds)], names=[x for x, _ in kinds])

    return run


def _with(kind: int, df: DataFrame) -> DataFrame:
    """One shape for what meets at a block."""
    have = set(df.columns)
    cols = {"block": "long", "kind": "int", "bucket": "long", "ids": "array<long>", **{c: "binary" for c in ("train", "counts", "words", "codes", "a", "b", "c")}}
    return df.select(*((F.lit(kind) if c == "kind" else F.col(c) if c in have else F.lit(None)).cast(t).alias(c) for c, t in cols.items()))


def score(docs: DataFrame, id_col: str = "doc_id", train_col: str = "train", text: str = "text", order: int = ORDER, hot: int = HOT, block: int = BLOCK_TOKENS) -> DataFrame:
    """Learns from the rows with ``train_col`` true and scores all, with contexts of ``order`` - 1 words.

    Gives id_col, train_col, n_tokens (words and the end), n_known, train_tokens, base_score (add-one unigram) and score
    (log10 probability under the model). A null text has the end only; a null in train_col counts as false; rows with a null
    or a repeated id are scored like any other. Repeated rows are learned from as often as they come. With nothing to learn
    from, every token is the unknown word with probability 1. An empty table stays empty. Other columns are ignored.
    """
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession)
    width = shuffle_width(spark)
    blocks = scratch.write(docs.select(named(id_col).cast("long").alias("id"), named(train_col).alias("train"), named(text).alias("text")).mapInArrow(lambda batches: _blocks(batches, block), BLOCK), "blocks")
    tokens = blocks.agg(F.sum("tokens")).first()[0] or 0
    buckets = max(4 * width, -(-tokens // BUCKET_TOKENS))
    at = lambda df, key: df.repartition(width, key).sortWithinPartitions(key, "block" if key == "bucket" else "kind")
    words = scratch.write(at(blocks.mapInArrow(_send_words(buckets), MAIL), "bucket").mapInArrow(_add_words(buckets), MAIL), "words")
    stats = [np.frombuffer(r[0], np.int64) for r in words.where("block = -1").select("a").collect()]
    sums = np.sum(stats, 0).tolist() if stats else [0] * (TOP + 3)
    uni = Unigrams(sums[0], sums[1], [0, *sums[2:]])
    met, known = _with(0, blocks).unionByName(_with(1, words.where("block >= 0"))), []
    for n in range(2, order + 1):
        scratch.drop()
        sent = at(met, "block").mapInArrow(_send_grams(buckets, hot, uni, known), MAIL)
        counts = scratch.write(at(sent, "bucket").mapInArrow(_add_grams(uni, hot, n == 2), MAIL), f"order_{n}")
        del sent
        known = [*known, Known(counts.where("block = -1").mapInArrow(_sums, SUMS).groupBy("key").agg(*(F.sum(c).alias(c) for c in (*COLS, "seen"))).collect())]
        met = met.unionByName(_with(n, counts.where("block >= 0")))
    scratch.drop()
    out = "id long, train boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return at(met, "block").mapInArrow(_score(buckets, hot, uni, known), out).withColumnsRenamed({"id": id_col, "train": train_col})


def held_out(df: DataFrame, id_col: str = "doc_id", parts: int = 7, part: int = 2):
    """crc32 of the id as text, modulo parts (a null id is learned from)."""
    return F.coalesce(F.crc32(df[id_col].cast("string").cast("binary")) % parts == part, F.lit(False))


def brute_force(texts: list[str | None], train: list[bool], order: int = ORDER) -> tuple[list[tuple[int, int, float, float]], Unigrams, object]:
    """The same model from dictionaries, for tests: rows, and P(w | h) as a function of a tuple of words (0: begin)."""
    lower = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
    docs = [[*(t or "").encode().translate(lower).split(), None] for t in texts]
    learn = [d for d, t in zip(docs, train) if t]
    grams = lambda d, n: list(zip(*(([0] * (n - 1) + d)[i:] for i in range(n))))
    count = [Counter(g for d in learn for g in grams(d, n)) for n in range(1, order + 1)]
    few = [[0, *(sum(v == r for v in c.values()) for r in range(1, TOP + 2))] for c in count]
    uni, d = Unigrams(sum(count[0].values()), len(count[0]), few[0]), [np.array(discounts(f)) for f in few]
    followers: list[dict] = [{} for _ in range(order)]
    for n, c in enumerate(count):
        for g, k in c.items():
            followers[n].setdefault(g[:-1], []).append((g[-1], k))

    def p(h: tuple, w):
        if not h:
            return float(uni.p(np.array([count[0][(w,)]]))[0])
        f = followers[len(h)].get(h)
        if not f:
            return p(h[1:], w)
        of = sum(c for _, c in f)
        n = np.array([[sum(c == r for _, c in f) for r in range(1, TOP + 1)]])
        alpha, scale = backoff(d[len(h)], np.array([of]), n, np.array([sum(p(h[1:], x) for x, _ in f)]))
        c = count[len(h)][(*h, w)]
        return float((d[len(h)][c] if c <= TOP else 1.0) * c / of * scale[0]) if c else float(alpha[0]) * p(h[1:], w)

    rows = []
    for t in docs:
        base = sum(math.log10((count[0][(w,)] + 1) / (uni.total + uni.kinds + 1)) for w in t)
        rows.append((len(t), sum(count[0][(w,)] > 0 for w in t), base, sum(math.log10(p(g[:-1], g[-1])) for g in grams(t, order))))
    return rows, uni, p
