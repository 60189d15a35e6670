"""Packing documents into token sequences of a fixed length.

Plan: one Arrow pass tokenises every whole text and cuts only those that are
longer than a sequence; the pieces (about 50 bytes each, no token) are written to
the shared folder. Whole sequences need no partner and are placed at once. The
others are dealt at random into groups of bounded size, each packed by one task:
best fit by falling size, then a swap-based local search that moves documents or
exchanges them one-for-one or two-for-one between underfull bins, always raising
the sum of squared fills, until bins run empty. A group of ``GROUP_PIECES``
pieces leaves one badly filled bin at most, so the groups cost less than one
sequence in a thousand.

The search is a heuristic with limits, all parameters of ``improve``: a bin offers its
``MOST_ITEMS`` largest pieces for exchanges of two pieces, asks the ``MOST_BINS`` bins
with the most room for two of theirs, and the search ends after ``PATIENCE`` bins in a
row that it can't empty, or at the lower bound. They bound the work, not the pieces
packed: every piece has a place after best fit already.

Edge cases: a null or empty text is the closing id alone (one piece of length 1).
A text of exactly ``capacity`` tokens is one piece. Repeated rows are packed as
often as they occur; null ids are carried. An empty table gives an empty result.
Extra columns of the input are ignored and may have any names.
"""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from decisium.llm import tokens
from decisium.runtime import materialise

CAPACITY = 2048
#: Pieces that one task packs.
GROUP_PIECES = 16_384
#: Bins in a row that the local search may fail to empty before it ends.
PATIENCE = 24
MOST_ITEMS = 32
MOST_BINS = 64

_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def token_pieces(docs: DataFrame, capacity: int = CAPACITY, tokenizer_path: str | None = None, end_id: int = 0) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every document's ids and the closing id."""
    path = tokenizer_path or tokens.default_path()
    end = int(end_id).to_bytes(4, "little")

    def cut(batches):
        import pyarrow as pa

        wp = tokens.word_pieces(path)
        step = 4 * capacity
        for batch in batches:
            doc, piece, start, length, crc = [], [], [], [], []
            for key, text in zip(batch.column(0).to_pylist(), tokens.text_bytes(batch.column(1)), strict=True):
                ids = wp.ids(text) + end
                for k, at in enumerate(range(0, len(ids), step)):
                    part = ids[at : at + step] if len(ids) > step else ids
                    doc.append(key)
                    piece.append(k)
                    start.append(at // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
            yield pa.RecordBatch.from_arrays(
                [pa.array(doc, pa.int64()), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                names=["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(cut, _PIECES)


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Bins of item numbers: items by falling size, each into the fullest bin that takes it."""
    order = sorted(range(len(sizes)), key=lambda i: (-sizes[i], i))
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms, bins = 0, []  # bit r of rooms: some bin has exactly r left
    for i in order:
        size = sizes[i]
        fits = rooms >> size
        if fits:
            room = size + (fits & -fits).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                rooms &= ~(1 << room)
            bins[b].append(i)
            room -= size
        else:
            b, room = len(bins), capacity - size
            bins.append([i])
        by_room[room].append(b)
        rooms |= 1 << room
    return bins


def improve(
    sizes: list[int], bins: list[list[int]], capacity: int, patience: int = PATIENCE, most_items: int = MOST_ITEMS, most_bins: int = MOST_BINS
) -> list[list[int]]:
    """Empty bins by local search; every accepted exchange raises the sum of squared fills.

    The least filled bin gives: a document moves to the tightest bin that takes
    it, or is exchanged for a smaller one of a bin with room for the difference,
    or two of its documents for one, or one for two. The receiver is never less
    filled than the giver, so each exchange raises the squared fill and the
    search ends. It stops at the lower bound ``ceil(sum / capacity)``, or after
    ``patience`` bins in a row that could not be emptied.
    """
    size = np.asarray(sizes, np.int64)
    bins = [list(b) for b in bins]
    where = np.zeros(len(sizes), np.int64)
    for b, items in enumerate(bins):
        where[items] = b
    fill = np.array([size[b].sum() for b in bins], np.int64) if bins else np.zeros(0, np.int64)
    live = len(bins)
    least = -(-int(size.sum()) // capacity)
    frozen = np.zeros(len(bins), bool)
    failed = 0

    def put(item: int, to: int) -> None:
        old = int(where[item])
        bins[old].remove(item)
        bins[to].append(item)
        fill[old] -= size[item]
        fill[to] += size[item]
        where[item] = to

    while live > least and failed < patience:
        open_ = np.flatnonzero(~frozen & (fill > 0) & (fill < capacity))
        if len(open_) < 2:
            break
        giver = int(open_[np.argmin(fill[open_])])
        moved = True
        while moved and bins[giver]:
            moved = False
            room = capacity - fill
            room[giver] = 0
            room[fill == 0] = 0
            room[fill < fill[giver]] = 0
            space = room[where]  # room beside each item
            near = np.flatnonzero(space > 0)
            for x in sorted(bins[giver], key=lambda i: -sizes[i]):
                takes = np.flatnonzero(room >= size[x])
                if len(takes):
                    put(x, int(takes[np.argmin(room[takes])]))
                    moved = True
                    break
                gain = size[x] - size[near]
                good = (gain > 0) & (gain <= space[near])
                if good.any():
                    y = int(near[np.argmax(np.where(good, gain, 0))])
                    to = int(where[y])
                    put(x, to)
                    put(y, giver)
                    moved = True
                    break
            if moved:
                continue
            own = sorted(bins[giver], key=lambda i: -sizes[i])[:most_items]
            for n, x1 in enumerate(own):  # two of the giver's for one
                for x2 in own[n + 1 :]:
                    gain = size[x1] + size[x2] - size[near]
                    good = (gain > 0) & (gain <= space[near])
                    if good.any():
                        y = int(near[np.argmax(np.where(good, gain, 0))])
                        to = int(where[y])
                        put(x1, to)
                        put(x2, to)
                        put(y, giver)
                        moved = True
                        break
                if moved:
                    break
            if moved:
                continue
            widest = np.argsort(-room, kind="stable")[:most_bins]
            widest = widest[room[widest] > 0]
            for x in own:  # one of the giver's for two of a receiver
                for b in widest:
                    pair = _two_below(sizes, bins[b], sizes[x], int(room[b]))
                    if pair:
                        put(x, int(b))
                        put(pair[0], giver)
                        put(pair[1], giver)
                        moved = True
                        break
                if moved:
                    break
        if not bins[giver]:
            live -= 1
            failed = 0
        else:
            frozen[giver] = True
            failed += 1
    return [b for b in bins if b]


def _two_below(sizes: list[int], items: list[int], most: int, room: int) -> tuple[int, int] | None:
    """Two of ``items`` whose sizes add up to less than ``most`` by ``room`` at most."""
    ranked = sorted(items, key=lambda i: sizes[i])
    lo, hi = 0, len(ranked) - 1
    while lo < hi:
        both = sizes[ranked[lo]] + sizes[ranked[hi]]
        if both >= most:
            hi -= 1
        elif most - both > room:
            lo += 1
        else:
            return ranked[lo], ranked[hi]
    return None


def pack(pieces: DataFrame, capacity: int = CAPACITY, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """``pieces`` with sequence_id and offset: every piece in exactly one place, offsets gapless from 0."""
    rows = materialise(pieces.withColumn("row_no", F.monotonically_increasing_id()), "pieces")
    whole = rows.filter(F.col("length") >= capacity)
    part = rows.filter(F.col("length") < capacity)
    groups = max(1, -(-part.count() // group_pieces))
    group = F.pmod(F.xxhash64("row_no", "ids_crc32"), F.lit(groups))

    def place(pdf):
        pdf = pdf.sort_values("row_no", ignore_index=True)
        sizes = pdf["length"].tolist()
        bins = improve(sizes, best_fit(sizes, capacity), capacity)
        sequence = np.zeros(len(sizes), np.int64)
        offset = np.zeros(len(sizes), np.int64)
        for b, items in enumerate(bins):
            at = 0
            for i in items:
                sequence[i], offset[i] = b, at
                at += sizes[i]
        first = int(pdf["group_no"].iloc[0]) << 32 if len(pdf) else 0
        return pdf.assign(sequence_id=sequence + first, offset=offset).drop(columns=["group_no", "row_no"])

    out = f"{_PIECES}, sequence_id long, offset long"
    packed = part.withColumn("group_no", group).groupBy("group_no").applyInPandas(place, out)
    alone = whole.select("doc_id", "piece", "start", "length", "ids_crc32", (-F.col("row_no") - 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return packed.unionByName(alone)


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, tokenizer_path: str | None = None, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """Every document of ``docs`` (doc_id, text) packed into sequences of ``capacity`` tokens."""
    return pack(token_pieces(docs, capacity, tokenizer_path), capacity, group_pieces)
