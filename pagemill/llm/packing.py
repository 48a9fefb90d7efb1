"""Tokenised pieces and sum-of-squares packing into fixed-length sequences.

A text becomes byte-level BPE ids and a closing id. Only pieces' lengths take part in packing. Pieces are dealt by a hash
to groups of about ``group`` pieces; a group is packed in one task, longest first: a piece goes where the sum over gaps of
(open sequences with that gap) squared becomes smallest, and opens a sequence only if it fits nowhere. A group's memory is bounded by its piece count, the number of
groups follows the input, and what a group leaves open (a few sequences) is a bounded share of the whole.
"""

from __future__ import annotations

import heapq
import json
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Carried, Scratch, shuffle_width, with_fields

LENGTH = 2048
GROUP = 20_000
#: Split pattern of the byte-level vocabulary (a fixed value of the public tokenizer).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(2)
def encoder(path: str):
    """tiktoken with the vocabulary of a byte-level tokenizers file: the same ids, several times as fast.

    Strings of special tokens in a text become their ids, as that library does by default.
    """
    import tiktoken

    with open(path, encoding="utf-8") as f:
        model = json.load(f)
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(printable)]
    byte = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(rest)}
    special = {t["content"]: t["id"] for t in model.get("added_tokens", ())}
    ranks = {bytes(byte[c] for c in t): i for t, i in model["model"]["vocab"].items() if t not in special}
    return tiktoken.Encoding("byte_bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)


def _pieces(path: str, length: int, end: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        special = enc.special_tokens_set
        for b in batches:
            rows, out, held = [], {"piece": [], "start": [], "length": [], "ids_crc32": [], "ids": []}, 0
            for i, t in enumerate(b.column("text")):
                ids = np.append(enc.encode_to_numpy(t.as_py() or "", allowed_special=special).astype("<u4"), np.uint32(end))
                start, to, piece = 0, len(ids) % length or min(length, len(ids)), 0
                while start < len(ids):
                    part = ids[start:to]
                    rows.append(i)
                    for name, v in zip(out, (piece, start, len(part), zlib.crc32(part.tobytes()), part.astype(np.int32) if with_ids else None)):
                        out[name].append(v)
                    start, to, piece = to, to + length, piece + 1
                held += len(ids)
                if held > 2_000_000 or i + 1 == b.num_rows:
                    yield _rows(b, rows, out, with_ids)
                    rows, out, held = [], {k: [] for k in out}, 0

    return run


def _rows(b, rows, out, with_ids):
    new = b.take(pa.array(rows, pa.int32()))
    for name, kind in (("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), *([("ids", pa.list_(pa.int32()))] if with_ids else [])):
        new = new.append_column(name, pa.array(out[name], kind))
    return new


def tokenized_pieces(docs: DataFrame, path: str, text: str = "text", length: int = LENGTH, end: int = 0, with_ids: bool = True) -> DataFrame:
    """Other columns of docs with piece, start, length, ids_crc32 and (with_ids) ids; the text itself goes.

    A text longer than ``length`` ids is cut into pieces of that length of which the first may be shorter. Null and empty
    texts give one piece that holds the closing id only. Columns of docs with the new names are replaced.
    """
    new = ("piece", "start", "length", "ids_crc32", "ids")
    carried = Carried(docs, *(c for c in new if c != text), text=text)
    schema = with_fields(carried.frame, "piece int, start long, length long, ids_crc32 long" + (", ids array<int>" if with_ids else ""))
    out = carried.frame.mapInArrow(_pieces(path, length, end, with_ids), schema)
    return out.select(*(c for c, name in zip(carried.columns(), carried.names) if name != text), *new[: 4 + with_ids])


def sum_of_squares(lengths: np.ndarray, capacity: int, opens: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Sequence and offset of each length, in the given order; lengths are 1..capacity. Ties go to the narrowest gap.

    A new sequence is opened only where no gap fits; with ``opens`` opening one is a choice like any gap, as in the rule for
    lengths that come in any order. Longest first, that needs more sequences (sf0.1: 4947 against 4936, which is the least
    possible; in random order 4995 against 5015).
    """
    open_ = np.zeros(capacity + 1, np.int64)
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    seq, at, used = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64), 0
    gaps: list[int] = []  # a heap of gaps that may be open, so that the scan starts at the widest
    for i, s in enumerate(lengths.tolist()):
        # change of the sum of squares if gap g takes s: 2 (N(g - s) - N(g)) + 2, or 1 - 2 N(g) if that closes it
        top = -gaps[0] if gaps else 0
        while gaps and not open_[top]:
            heapq.heappop(gaps)
            top = -gaps[0] if gaps else 0
        gap = capacity
        if top >= s:
            now = open_[s : top + 1]
            change = 2 * (open_[: top + 1 - s] - now) + 2
            change[0] = 1 - 2 * now[0]
            change[now == 0] = np.iinfo(np.int64).max
            j = int(change.argmin())
            fresh = 2 * open_[capacity - s] + 1 if s < capacity else 0
            if now[j] and not (opens and fresh < change[j]):
                gap = s + j
        if gap < capacity:
            k = stacks[gap].pop()
            open_[gap] -= 1
        else:
            k, used, gap = used, used + 1, capacity
        seq[i], at[i] = k, capacity - gap
        left = gap - s
        if left:
            if not open_[left]:
                heapq.heappush(gaps, -left)
            open_[left] += 1
            stacks[left].append(k)
    return seq, at


def _pack(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(parts):
            t = pa.Table.from_batches(parts).combine_chunks()
            t = t.sort_by([("length", "descending"), ("tie", "ascending"), ("copy", "ascending")])
            seq, at = sum_of_squares(t["length"].to_numpy(), length)
            base = np.int64(t["group"][0].as_py()) << np.int64(32)
            t = t.append_column("sequence_id", pa.array(seq + base)).append_column("offset", pa.array(at)).drop_columns(["group"])
            return t.to_batches()

        held, last = [], None
        for b in batches:
            group = np.asarray(b.column("group"))
            cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(group)]
            for x, y in zip(cuts, cuts[1:]):
                if held and group[x] != last:
                    yield from done(held)
                    held = []
                held.append(b.slice(x, y - x))
                last = group[x]
        if held:
            yield from done(held)

    return run


def pack(pieces: DataFrame, length: int = LENGTH, group: int = GROUP) -> DataFrame:
    """Adds sequence_id and offset to pieces with a column ``length`` from 1 to the capacity.

    Offsets of a sequence's pieces are gapless from 0. Equal rows are separate pieces. An empty table stays empty. Other
    columns of any type and name stay, except that sequence_id and offset are replaced. Only lengths, and a hash of the
    plain columns that settles ties, travel to the groups.
    """
    spark, scratch = pieces.sparkSession, Scratch(pieces.sparkSession)
    carried = Carried(pieces, "sequence_id", "offset", length="length")
    nested = {f.name for f in pieces.schema.fields if f.dataType.typeName() in ("struct", "array", "map", "variant")}
    plain = [c for c, name in zip(carried.columns(), carried.names) if name not in nested]
    kept = scratch.write(carried.frame.withColumns({"copy": F.monotonically_increasing_id(), "tie": F.xxhash64(*plain)}), "pieces")
    groups = max(1, -(-kept.count() // group))
    lengths = kept.select("copy", "length", "tie", F.pmod(F.xxhash64("tie", "copy"), F.lit(groups)).alias("group"))
    lengths = lengths.repartition(min(groups, shuffle_width(spark)), "group").sortWithinPartitions("group")
    placed = lengths.mapInArrow(_pack(length), "copy long, length long, tie long, sequence_id long, offset long")
    return kept.join(placed.select("copy", "sequence_id", "offset"), "copy").select(*carried.columns(), "sequence_id", "offset")


def pack_documents(docs: DataFrame, path: str, text: str = "text", length: int = LENGTH, end: int = 0, with_ids: bool = True) -> DataFrame:
    """tokenized_pieces, then pack: a row for each piece.

    Null and empty texts are one piece with the closing id only; repeated rows are packed as often as they come; an empty
    table gives no rows; other columns stay, except those of the names that are added.
    """
    return pack(tokenized_pieces(docs, path, text, length, end, with_ids), length)
