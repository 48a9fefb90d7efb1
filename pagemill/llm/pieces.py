"""Sampled segmentation with a SentencePiece vocabulary, and lossless decoding.

The lattice of a text has a node before and after each character and an arc for each piece; a character without a piece of its
own has an arc of byte pieces. Forward filtering sums the weights of all paths to every node; backward sampling then walks from
the end and picks each arriving arc with its share of the sum. That draws a whole segmentation with probability proportional
to the product of its arcs' weights.

Pieces never hold a blank mark after another character, nor a line break (checked when the vocabulary is loaded), so a
text's lattice falls apart into chunks between these, and equal chunks share one lattice. All chunks of a batch are
filtered together, position by position, and all their occurrences walk together. Each choice's random number is a hash of
seed, row key, chunk number and step, so a row's segmentation does not depend on partitions, batches or retries.

Weights: exp(alpha * score) for unigram vocabularies; a BPE vocabulary's scores are ranks r, and a piece weighs
(r + 2) ** -alpha. A byte piece weighs as the last rank.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Carried, slices, with_fields
from .words import mix, ranges

MARK = "▁"
#: Stands for a blank mark that the source text holds itself; no valid text has it.
OWN = "\ud800"
BASE = np.uint64(0xC2B2AE3D27D4EB4F)
ALPHA, SEED = 1.0, 0
#: Distinct chunks kept by a worker.
CACHE = 400_000
STEP = np.uint64(0x9E3779B97F4A7C15)


def uniform(row: np.ndarray, chunk: np.ndarray, step: int) -> np.ndarray:
    """In [0, 1), by row key, chunk number in the row, and step."""
    h = mix(mix(row ^ mix(chunk.astype(np.uint64) + np.uint64(1))) + np.uint64(int(STEP) * (step + 1) & 0xFFFFFFFFFFFFFFFF))
    return (h >> np.uint64(11)).astype(float) / (1 << 53)


@lru_cache(1)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = np.uint64(pow(int(BASE), -1, 1 << 64))
    return tuple(np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, b)])) for b in (BASE, inverse))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**0..n-1 at least and their inverses, modulo 2**64."""
    return _powers(max(1 << 16, 1 << (n - 1).bit_length()))


class Vocabulary:
    def __init__(self, path: str, alpha: float):
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [m.id_to_piece(i) for i in range(m.get_piece_size())]
        special = [m.is_control(i) or m.is_unknown(i) or m.is_unused(i) for i in range(len(names))]
        self.byte = {int(n[3:5], 16): i for i, n in enumerate(names) if m.is_byte(i)}
        plain = {n: i for i, n in enumerate(names) if i not in self.byte.values() and not special[i]}
        score = np.array([m.get_score(i) for i in range(len(names))])
        ranks = all(s == int(s) for s in score)
        self.lone = -alpha * np.log(len(names) + 2) if ranks else alpha * (score.min() - 10)
        # whitespace runs of a BPE vocabulary have no rank and come as the last
        weight = -alpha * np.log(np.minimum(-score, len(names)) + 2) if ranks else alpha * score
        self.of = {n: (i, float(weight[i])) for n, i in plain.items()}
        self.longest = max(map(len, plain))
        self.chunk = re.compile(f"{MARK}*[^{MARK}\n]+|{MARK}+|\n")
        if len(self.byte) < 256 or any(MARK in n.lstrip(MARK) or "\n" in n for n in plain):
            raise ValueError("the vocabulary needs 256 byte pieces, and no piece with a later blank mark or a line break")
        text = "".join(plain)
        codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        size = np.array([len(n) for n in plain])
        h = self.hashes(codes)(np.cumsum(size) - size, np.cumsum(size))
        order = np.argsort(h)
        self.hash, self.id, self.weight = h[order], np.array(list(plain.values()))[order], np.array([self.of[n][1] for n in plain])[order]
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[(h >> np.uint64(44)).astype(np.int64)] = True
        self.content = [b"" if s else n.replace(MARK, " ").encode() for n, s in zip(names, special)]
        for b, i in self.byte.items():
            self.content[i] = bytes([b])

    @staticmethod
    def hashes(codes: np.ndarray):
        """Of any stretches of codes."""
        up, down = powers(len(codes) + 1)
        prefix = np.concatenate([np.zeros(1, np.uint64), np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * up[: len(codes)])])
        return lambda x, y: mix((prefix[y] - prefix[x]) * down[x] + (y - x).astype(np.uint64))

    def arcs(self, types: list[str]) -> tuple[np.ndarray, ...]:
        """(from node, to node, piece or -1 - code point, log weight) of all types, sorted by to node; first node of each."""
        size = np.array([len(t) for t in types])
        codes = np.frombuffer("".join(types).encode("utf-32-le", "surrogatepass"), np.uint32)
        hashes, first = self.hashes(codes), np.cumsum(size) - size
        owner = np.repeat(np.arange(len(types)), size)
        left = np.repeat(first + size, size) - np.arange(len(codes))
        out = []
        for n in range(1, self.longest + 1):
            x = np.flatnonzero(left >= n)
            h = hashes(x, x + n)
            on = self.maybe[(h >> np.uint64(44)).astype(np.int64)]
            x, h = x[on], h[on]
            at = np.minimum(np.searchsorted(self.hash, h), len(self.hash) - 1)
            hit = self.hash[at] == h
            x, at = x[hit], at[hit]
            out.append((x, x + n, self.id[at], self.weight[at]))
            if n == 1:
                none = np.ones(len(codes), bool)
                none[x] = False
                y = np.flatnonzero(none)
                code = np.where(codes[y] == ord(OWN), ord(MARK), codes[y]).astype(np.int64)
                out.append((y, y + 1, -1 - code, self.lone * self.bytes_of(code)))
        x, y, piece, w = (np.concatenate(c) for c in zip(*out))
        shift = owner[x]
        order = np.lexsort((x, y + shift))
        return (x + shift)[order], (y + shift)[order], piece[order], w[order], first + np.arange(len(types)), size

    @staticmethod
    def bytes_of(code: np.ndarray) -> np.ndarray:
        return 1 + (code >= 0x80) + (code >= 0x800) + (code >= 0x10000)


class Lattices:
    """Filtered lattices of the chunks seen by this worker. Arcs by to node; cut: the node's share up to the arc; arrive: its first."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.clear()

    def clear(self):
        self.of: dict[str, int] = {}
        self.cut, self.source, self.piece, self.arrive = (np.zeros(0, k) for k in (float, np.int32, np.int32, np.int32))
        self.end, self.nodes = np.zeros(0, np.int64), 0
        self.root = np.zeros(0, bool)

    def add(self, types: list[str]) -> None:
        if not types:
            return
        x, y, piece, w, first, size = self.v.arcs(types)
        nodes = int(first[-1] + size[-1] + 1)
        root = np.zeros(nodes, bool)
        root[first] = True
        total = np.full(nodes, -np.inf)
        total[first] = 0
        position = np.arange(nodes) - np.repeat(first, size + 1)
        level = position[y]
        order = np.argsort(level, kind="stable")  # within a level still by to node
        cuts = np.flatnonzero(np.diff(level[order], prepend=0))
        for a, b in zip(cuts, np.append(cuts[1:], len(order))):
            i = order[a:b]
            begin = np.flatnonzero(np.diff(y[i], prepend=-1))
            total[y[i[begin]]] = np.logaddexp.reduceat(total[x[i]] + w[i], begin)
        share = np.exp(total[x] + w - total[y])
        begin = np.flatnonzero(np.diff(y, prepend=-1))
        counts = np.diff(np.append(begin, len(y)))
        for n in range(1, int(counts.max())):  # sums within a node only, so that no other chunk touches the rounding
            i = begin[counts > n] + n
            share[i] += share[i - 1]
        share[begin + counts - 1] = 1.0
        arrive = np.zeros(nodes, np.int32)
        arrive[y[begin]] = begin + len(self.cut)
        self.cut, self.arrive = np.concatenate([self.cut, share]), np.concatenate([self.arrive, arrive])
        self.source = np.concatenate([self.source, (x + self.nodes).astype(np.int32)])
        self.piece = np.concatenate([self.piece, piece.astype(np.int32)])
        self.end = np.concatenate([self.end, first + size + self.nodes])
        self.root = np.concatenate([self.root, root])
        self.nodes += nodes
        for t in types:
            self.of[t] = len(self.of)

    def sample(self, texts: list[str | None], keys: np.ndarray) -> list[np.ndarray]:
        """Piece ids of each text."""
        chunks = [self.v.chunk.findall((" " + t).replace(MARK, OWN).replace(" ", MARK)) if t else [] for t in texts]
        flat = list(chain.from_iterable(chunks))
        kinds = set(flat)
        new = [c for c in kinds if c not in self.of]
        if len(self.of) + len(new) > CACHE:
            self.clear()
            new = list(kinds)
        self.add(new)
        counts = np.array([len(c) for c in chunks])
        kind = np.fromiter(map(self.of.__getitem__, flat), np.int64, len(flat))
        row, number = np.repeat(keys, counts), ranges(counts)
        live, node = np.arange(len(kind)), self.end[kind] if len(kind) else kind
        took: list[tuple[np.ndarray, np.ndarray]] = []
        while len(live):
            u, arc = uniform(row[live], number[live], len(took)), self.arrive[node]
            on = np.flatnonzero(self.cut[arc] <= u)
            while len(on):
                arc[on] += 1
                on = on[self.cut[arc[on]] <= u[on]]
            took.append((live, arc))
            node = self.source[arc]
            on = ~self.root[node]
            live, node = live[on], node[on]
        if not took:
            return [np.zeros(0, np.int32) for _ in texts]
        who, arc = (np.concatenate(c) for c in zip(*took))
        when = np.repeat(np.arange(len(took)), [len(t[0]) for t in took])
        order = np.lexsort((-when, who))
        who, piece = who[order], self.piece[arc[order]]
        spell = piece < 0
        if spell.any():
            many = np.where(spell, self.v.bytes_of(-1 - piece.astype(np.int64)), 1)
            spelled = {c: [self.v.byte[b] for b in chr(-1 - c).encode()] for c in np.unique(piece[spell]).tolist()}
            nth, who, piece = ranges(many), np.repeat(who, many), np.repeat(piece, many)
            for c, ids in spelled.items():
                hit = piece == c
                piece = np.where(hit, np.array(ids)[np.where(hit, nth, 0)], piece)
        ends = np.searchsorted(who, np.cumsum(counts))
        return [x.astype(np.int32) for x in np.split(piece, ends[:-1])]


@lru_cache(2)
def lattices(path: str, alpha: float) -> Lattices:
    return Lattices(Vocabulary(path, alpha))


def decode_ids(v: Vocabulary, ids) -> str:
    """The text whose segmentation ids are, whatever the segmentation."""
    return b"".join(map(v.content.__getitem__, ids))[1:].decode()


def row_keys(ids: pa.Array, seed: int) -> np.ndarray:
    """Keys of rows by a whole number (null: as 0) and the seed."""
    values = np.asarray(ids.cast(pa.int64()).fill_null(0)).astype(np.uint64)
    return mix(mix(values + np.uint64(1)) ^ np.uint64(seed & 0xFFFFFFFFFFFFFFFF))


IDS = "ids array<int>"


def _encode(path: str, alpha: float, seed: int, check: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maker = lattices(path, alpha)
        for b in slices(batches):
            texts = b.column("text").to_pylist()
            ids = maker.sample(texts, row_keys(b.column("key"), seed))
            b = b.append_column("ids", pa.array(ids, pa.list_(pa.int32())))
            if check:
                b = b.append_column("n_pieces", pa.array([len(x) for x in ids], pa.int64()))
                b = b.append_column("ids_crc32", pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in ids], pa.int64()))
                b = b.append_column("lossless", pa.array([decode_ids(maker.v, x.tolist()) == (t or "") for x, t in zip(ids, texts)], pa.bool_()))
            yield b

    return run


def encode(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", alpha: float = ALPHA, seed: int = SEED) -> DataFrame:
    """Adds ids (array of int). Null and empty texts have none; rows with equal keys and texts get equal ids, also where
    rows repeat; a null key counts as 0. An empty table stays empty. Other columns stay, but a column ids is replaced."""
    carried = Carried(docs, "ids", text=text, key=key)
    return carried.frame.mapInArrow(_encode(path, alpha, seed, False), with_fields(carried.frame, IDS)).select(*carried.columns(), "ids")


def decode(df: DataFrame, path: str, ids: str = "ids", alpha: float = ALPHA) -> DataFrame:
    """Adds decoded (string) from an array of ids of encode; null ids decode to an empty text. Other columns stay, but a
    column decoded is replaced."""
    carried = Carried(df, "decoded", ids=ids)

    def run(batches):
        v = lattices(path, alpha).v
        for b in batches:
            yield b.append_column("decoded", pa.array([decode_ids(v, x or ()) for x in b.column("ids").to_pylist()], pa.string()))

    return carried.frame.mapInArrow(run, with_fields(carried.frame, "decoded string")).select(*carried.columns(), "decoded")


def checked(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", alpha: float = ALPHA, seed: int = SEED) -> DataFrame:
    """encode and decode in one pass: adds ids, n_pieces, ids_crc32 (of little-endian 32-bit ids) and lossless; the text goes."""
    carried = Carried(docs, "ids", "n_pieces", "ids_crc32", "lossless", text=text, key=key)
    out = carried.frame.mapInArrow(_encode(path, alpha, seed, True), with_fields(carried.frame, f"{IDS}, n_pieces long, ids_crc32 long, lossless boolean"))
    return out.select(*(c for c, name in zip(carried.columns(), carried.names) if name != text), "ids", "n_pieces", "ids_crc32", "lossless")


def brute_force(v: Vocabulary, text: str, key: np.uint64) -> list[int]:
    """The same draw chunk by chunk from dictionaries, for tests."""
    out: list[int] = []
    for number, chunk in enumerate(v.chunk.findall((" " + text).replace(MARK, OWN).replace(" ", MARK)) if text else []):
        into: list[list] = [[] for _ in range(len(chunk) + 1)]
        total = [0.0] + [-np.inf] * len(chunk)
        for y in range(1, len(chunk) + 1):
            for x in range(max(0, y - v.longest), y):
                if (part := chunk[x:y]) in v.of:
                    into[y].append((x, [v.of[part][0]], v.of[part][1]))
                elif y - x == 1:
                    ids = [v.byte[b] for b in part.replace(OWN, MARK).encode()]
                    into[y].append((x, ids, v.lone * len(ids)))
            total[y] = np.logaddexp.reduce([total[x] + w for x, _, w in into[y]])
        y, step, parts = len(chunk), 0, []
        while y:
            u, at = float(uniform(np.array([key]), np.array([number]), step)[0]), 0.0
            for x, ids, w in into[y]:
                at += np.exp(total[x] + w - total[y])
                if u < at:
                    break
            parts.append(ids)
            y, step = x, step + 1
        out += [i for p in reversed(parts) for i in p]
    return out
