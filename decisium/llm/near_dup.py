"""Near-duplicate groups by circulant MinHash, banding and exact Jaccard verification.

A document's set holds 64-bit hashes of its distinct shingles of ``shingle``
words (ASCII letters lower-cased). Two permutations make all signature
coordinates: the first scatters a shingle to a place in a universe of ``UNIVERSE``
places, the second is read from that place onwards, so coordinate k is the
minimum over the set of the second permutation shifted by k. A set's signature is
the minimum of contiguous slices of one table. Coordinates are cut into bands of r
rows, with the largest r at which a pair at the threshold escapes all bands with
a probability of at most ``MISS``.

1. One Arrow pass sketches every text: set size, fingerprint of the set, band keys
   (about 300 bytes a document), written to the shared folder.
2. Documents with equal sets are one class; only its smallest id goes on.
3. Each band bucket links its members to its smallest id, a number of edges
   linear in its size. Their connected components are the candidate groups.
4. A group's texts meet in one task, which verifies all of its pairs on full sets
   through an inverted index and gives the links that joined sets, never pairs. A
   group of over ``GROUP`` members is cut into classes of set size (linked sets lie in
   the same or neighbouring ones) and these into blocks. First a block is verified
   alone, with a few leaders of its group; this joins copies of one another, with
   work in proportion to the group. Then each member outside the group's largest
   component so found meets every member of other components whose class allows a
   link: exact for groups of any size, with no cap.
5. Components of the verified links, over smallest ids.

Texts are read twice and only those of candidate groups are shuffled. The table
of candidates is sent to every task only if it counts at most ``BROADCAST_ROWS``
rows; beyond, texts and candidates are joined by id.

Edge cases: null, empty and blank texts have an empty set and are linked with
nothing. A text of fewer words than a shingle has one element, its whole
sequence. Rows with equal ids are one document. A row without id is linked with
nothing, has no component and is kept. An empty table gives an empty result.
Extra columns are ignored.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from decisium.llm.graph import components
from decisium.llm.spread import spread_join
from decisium.llm.tokens import text_bytes
from decisium.runtime import materialise

COORDINATES = 256
UNIVERSE = 1 << 20
MISS = 1e-6
GROUP = 1024
#: Leaders of each size class of a large group.
LEADERS = 8
BROADCAST_ROWS = 2_000_000
#: Text that is hashed at a time.
CHUNK_BYTES = 1 << 20

_MIX1, _MIX2, _BASE = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), 0x9E3779B97F4A7C15
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def bands_for(threshold: float, coordinates: int = COORDINATES, miss: float = MISS) -> tuple[int, int]:
    """(bands, rows a band)."""
    best = (coordinates, 1)
    for rows in range(1, 17):
        if (1 - threshold**rows) ** (coordinates // rows) <= miss:
            best = (coordinates // rows, rows)
    return best


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


@lru_cache(1)
def _powers(bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the odd base and of its inverse modulo 2**64."""
    out = []
    for p in (_BASE, pow(_BASE, -1, 1 << 64)):
        a = np.full(1 << bits, p, np.uint64)
        a[0] = 1
        out.append(np.cumprod(a))
    return out[0], out[1]


def _word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text number) of every word of the texts in order."""
    data = b" ".join(texts) + b" "
    ends = np.cumsum([len(t) + 1 for t in texts])
    low = _LOWER[np.frombuffer(data, np.uint8)]
    word = ~_SPACE[low]
    edge = np.flatnonzero(word[1:] != word[:-1]) + 1
    if word[0]:
        edge = np.concatenate([[0], edge])
    start, stop = edge[::2], edge[1::2]
    up, down = _powers(max(21, int(len(low)).bit_length()))
    total = np.zeros(len(low) + 1, np.uint64)
    np.cumsum((low.astype(np.uint64) + np.uint64(1)) * up[: len(low)], out=total[1:])
    return _mix((total[stop] - total[start]) * down[start]), np.searchsorted(ends, start, side="right")


def shingle_sets(texts: list[bytes], shingle: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    out: list[np.ndarray] = []
    first, size = 0, 0
    for i in range(len(texts) + 1):
        if i < len(texts) and (not size or size + len(texts[i]) <= CHUNK_BYTES):
            size += len(texts[i]) + 1
            continue
        if first < i:
            h, owner = _word_hashes(texts[first:i])
            bounds = np.searchsorted(owner, np.arange(i - first + 1))
            run = h.copy() if len(h) else h
            for j in range(1, shingle):
                run[: len(h) - j] = _mix(run[: len(h) - j] * np.uint64(_BASE) + h[j:]) if j < len(h) else run[: len(h) - j]
            for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                if b - a >= shingle:
                    out.append(np.unique(run[a : b - shingle + 1]))
                elif b > a:
                    s = h[a : a + 1]
                    for j in range(a + 1, b):
                        s = _mix(s * np.uint64(_BASE) + h[j : j + 1])
                    out.append(s + np.uint64(b - a))
                else:
                    out.append(h[:0])
        if i < len(texts):
            first, size = i, len(texts[i]) + 1
    return out


@lru_cache(4)
def _second_permutation(coordinates: int, universe: int) -> np.ndarray:
    """Row s is the second permutation read from place s onwards."""
    p = np.random.default_rng(20240229).permutation(universe).astype(np.int32)
    return np.lib.stride_tricks.sliding_window_view(np.concatenate([p, p[: coordinates - 1]]), coordinates)


def signature(found: np.ndarray, coordinates: int = COORDINATES, universe: int = UNIVERSE) -> np.ndarray:
    """The circulant MinHash signature of a set that isn't empty."""
    table = _second_permutation(coordinates, universe)
    place = ((found * np.uint64(_BASE)) >> np.uint64(64 - (universe - 1).bit_length())).astype(np.int64)
    low = table[place[:4096]].min(0)
    for i in range(4096, len(place), 4096):
        low = np.minimum(low, table[place[i : i + 4096]].min(0))
    return low


def band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A 64-bit key for each band of each signature; equal rows of equal bands give equal keys."""
    cut = sig[:, : bands * rows].astype(np.uint64).reshape(len(sig), bands, rows)
    key = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(_BASE), cut.shape[:2])
    for r in range(rows):
        key = _mix(key * np.uint64(_BASE) + cut[:, :, r])
    return key.view(np.int64)


def sketch(docs: DataFrame, shingle: int, bands: int, rows: int, coordinates: int = COORDINATES) -> DataFrame:
    """(doc_id, n_shingles, set_key binary, bands array<long>) of every row."""

    def run(batches):
        import pyarrow as pa
        import xxhash

        for batch in batches:
            sets = shingle_sets(text_bytes(batch.column(1)), shingle)
            some = [s for s in sets if len(s)]
            keys = band_keys(np.stack([signature(s, coordinates) for s in some]), bands, rows) if some else np.zeros((0, bands), np.int64)
            lengths = np.array([bands if len(s) else 0 for s in sets], np.int32)
            offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary()),
                    pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys.ravel())),
                ],
                names=["doc_id", "n_shingles", "set_key", "bands"],
            )

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n_shingles long, set_key binary, bands array<long>")


def joining_links(sets: list[np.ndarray], num: int, den: int, part: np.ndarray | None = None, asks: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links that join the sets as all links between them would.

    ``part``: sets of equal numbers are joined already. ``asks``: only pairs with one of these are wanted.
    """
    n = len(sets)
    part = np.arange(n) if part is None else np.unique(part, return_inverse=True)[1]
    asks = np.ones(n, bool) if asks is None else asks
    size = np.array([len(s) for s in sets], np.int64)
    shingle, code = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(n), size)
    order = np.argsort(code, kind="stable")
    members = owner[order]
    count = np.bincount(code, minlength=len(shingle))
    begin = np.cumsum(count) - count
    own = np.cumsum(size) - size
    links = []
    for u in range(n - 1):
        wanted = (part != part[u]) & (asks | asks[u]) & (den * size >= num * size[u]) & (den * size[u] >= num * size)
        wanted[: u + 1] = False
        if not wanted.any():
            continue
        c = code[own[u] : own[u] + size[u]]
        c = c[count[c] > 1]
        if not len(c):
            continue
        m = count[c]
        at = np.repeat(begin[c] - (np.cumsum(m) - m), m) + np.arange(int(m.sum()))
        both = np.bincount(members[at], minlength=n)
        for v in np.flatnonzero(wanted & (den * both >= num * (size[u] + size - both))).tolist():
            if part[v] != part[u]:
                links.append((u, v))
                part[part == part[v]] = part[u]
    return links


_TASK = ["group_id", "phase", "near", "i", "far", "j"]


def verified_links(places: DataFrame, docs: DataFrame, shingle: int, num: int, den: int) -> DataFrame:
    """(a, b) verified links that join the members of each task; ``places``: (member_id, *_TASK, part, asks)."""

    def run(batches):
        import pyarrow as pa

        key, rows = None, []

        def done():
            found: dict[int, tuple] = {}
            for doc, part, asks, text in rows:  # rows with equal ids are one document; its first text by bytes stands for it
                old = found.get(doc)
                found[doc] = (part, asks, text) if old is None else (part, asks or old[1], min(text, old[2]))
            ids = sorted(found)
            if len(ids) < 2:
                return []
            part, asks = np.array([found[i][0] for i in ids]), np.array([found[i][1] for i in ids])
            return [(ids[v], ids[u]) for u, v in joining_links(shingle_sets([found[i][2] for i in ids], shingle), num, den, part, asks)]

        links: list[tuple[int, int]] = []
        for batch in batches:
            tasks = list(zip(*(batch.column(c).to_pylist() for c in range(len(_TASK))), strict=True))
            members = zip(*(batch.column(len(_TASK) + c).to_pylist() for c in range(3)), text_bytes(batch.column(len(_TASK) + 3)), strict=True)
            for task, member in zip(tasks, members, strict=True):
                if task != key:
                    links += done() if rows else []
                    key, rows = task, []
                rows.append(member)
        links += done() if rows else []
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in links], pa.int64()) for k in (0, 1)], names=["a", "b"])

    places = _sent(materialise(places, "places"))
    met = docs.select(F.col("doc_id").cast("long").alias("own_id"), F.col("text").cast("string").alias("text")).join(places, F.col("own_id") == F.col("member_id"))
    met = met.select(*_TASK, "member_id", "part", "asks", "text").repartition(*_TASK).sortWithinPartitions(*_TASK)
    return materialise(met.mapInArrow(run, "a long, b long"), "links")


def _task(phase: int, near="0", i="0", far="0", j="0", asks="true", part="member_id") -> list:
    """The columns of ``places``, given as SQL."""
    values = dict(zip(_TASK, ["group_id", phase, near, i, far, j], strict=True))
    return ["member_id", *[F.expr(f"CAST({v} AS BIGINT)").alias(k) for k, v in values.items()], F.expr(part).alias("part"), F.expr(asks).alias("asks")]


def _sent_plan(blocks: DataFrame) -> DataFrame:
    return _sent(materialise(blocks, "blocks"))


def _beside(rows: DataFrame, plan: DataFrame, blocks: str) -> DataFrame:
    """``rows`` (group_id, cls) once for each of the ``blocks`` (``other``, ``block``) of their class and its neighbours."""
    near = rows.withColumn("other", F.explode(F.array(*[F.col("cls") + d for d in (-1, 0, 1)])))
    held = plan.filter(F.col(blocks) > 0).select(F.col("group_id").alias("plan_group"), F.col("cls").alias("plan_cls"), F.col(blocks).alias("n_blocks"))
    near = near.join(held, (F.col("group_id") == F.col("plan_group")) & (F.col("other") == F.col("plan_cls"))).drop("plan_group", "plan_cls")
    return near.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_blocks") - 1)))


def large_group_links(members: DataFrame, docs: DataFrame, shingle: int, num: int, den: int, group: int) -> DataFrame:
    """(a, b) links that join the members (member_id, group_id, n_shingles) of groups that one task can't verify."""
    # linked sets' sizes differ by den / num at most, so their classes by 1; the width leaves room for rounding
    cls = F.floor(F.ln(F.col("n_shingles").cast("double")) / (np.log(den / num) * (1 + 1e-9) if den > num else 1e-9)).cast("long")
    members = materialise(members.withColumn("cls", cls).withColumn("mark", F.xxhash64("member_id")), "large")
    size = F.ceil(F.count("*") / float(group)).cast("long")

    plan = _sent_plan(members.groupBy("group_id", "cls").agg(size.alias("blocks")))
    own = members.join(plan, ["group_id", "cls"]).withColumn("own_block", F.pmod("mark", "blocks"))
    leaders = members.groupBy("group_id", "cls", F.pmod("mark", F.lit(LEADERS))).agg(F.min("member_id").alias("member_id"))
    first = own.select(*_task(1, "cls", "own_block")).unionByName(_beside(leaders, plan, "blocks").select(*_task(1, "other", "block")))
    links = verified_links(first, docs, shingle, num, den)

    joined = components(links).select(F.col("node").alias("member_id"), "root")
    parted = materialise(members.join(joined, "member_id", "left").withColumn("part", F.coalesce("root", "member_id")).drop("root"), "parted")
    largest = parted.groupBy("group_id", "part").agg(F.count("*").alias("n")).groupBy("group_id").agg(F.max(F.struct("n", "part"))["part"].alias("settled"))
    rest = materialise(parted.join(_sent_plan(largest), "group_id").filter("part <> settled").drop("settled"), "rest")
    if rest.isEmpty():
        return links
    rest_plan = _sent_plan(rest.groupBy("group_id", "cls").agg(size.alias("rest_blocks")))
    asking = rest.join(rest_plan, ["group_id", "cls"]).withColumn("own_block", F.pmod("mark", "rest_blocks"))
    asked = parted.join(plan, ["group_id", "cls"]).withColumn("own_block", F.pmod("mark", "blocks"))
    second = _beside(asking, plan, "blocks").select(*_task(2, "cls", "own_block", "other", "block", "true", "part")).unionByName(
        _beside(asked, rest_plan, "rest_blocks").select(*_task(2, "other", "block", "cls", "own_block", "false", "part"))
    )
    return links.unionByName(verified_links(second, docs, shingle, num, den))


def near_duplicates(docs: DataFrame, shingle: int = 5, num: int = 80, den: int = 100, group: int = GROUP) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept): documents are linked if den * intersection >= num * union."""
    bands, rows = bands_for(num / den)
    drawn = materialise(sketch(docs, shingle, bands, rows), "sketch")
    some = drawn.filter(F.col("set_key").isNotNull() & F.col("doc_id").isNotNull())
    classes = materialise(some.groupBy("set_key").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies")), "classes")
    total = classes.agg(F.sum("copies")).first()[0] or 0
    copied = classes.filter("copies > 1")
    lone = spread_join(some, copied, "set_key", "copies", total, "left").filter(F.col("rep").isNull() | (F.col("rep") == F.col("doc_id")))
    lone = materialise(lone.select("doc_id", "n_shingles", "bands"), "lone")
    keyed = lone.select("doc_id", F.explode("bands").alias("key"))
    hubs = keyed.groupBy("key").agg(F.min("doc_id").alias("hub"), F.max("doc_id").alias("last"), F.count("*").alias("n")).filter("hub < last").drop("last")
    edges = spread_join(keyed, materialise(hubs, "hubs"), "key", "n", total * bands).filter("hub < doc_id")
    groups = components(materialise(edges.select(F.col("doc_id").alias("a"), F.col("hub").alias("b")).distinct(), "candidates"))
    sizes = materialise(groups.groupBy("root").agg((F.count("*") + 1).alias("n")), "sizes")
    members = spread_join(groups, sizes.withColumn("n_group", F.col("n")), "root", "n", total).select(F.col("node").alias("member_id"), F.col("root").alias("group_id"), "n_group")
    members = materialise(members.unionByName(sizes.select(F.col("root").alias("member_id"), F.col("root").alias("group_id"), F.col("n").alias("n_group"))), "members")
    links = verified_links(members.filter(F.col("n_group") <= group).select(*_task(0)), docs, shingle, num, den)
    large = members.filter(F.col("n_group") > group).select("member_id", "group_id")
    if not large.isEmpty():
        shingles = lone.groupBy(F.col("doc_id").alias("member_id")).agg(F.min("n_shingles").alias("n_shingles"))
        links = links.unionByName(large_group_links(large.join(shingles, "member_id"), docs, shingle, num, den, group))
    joined = components(links).select(F.col("node").alias("linked_id"), "root")
    # a copy's component is its representative's; all others' is their own
    of_class = copied.join(joined, F.col("rep") == F.col("linked_id"), "left").select("set_key", "rep", F.coalesce("root", "rep").alias("root"), "copies")
    copies = spread_join(some.select("doc_id", "set_key"), materialise(of_class, "copied"), "set_key", "copies", total).filter("doc_id <> rep")
    label = joined.unionByName(copies.select(F.col("doc_id").alias("linked_id"), "root")).groupBy("linked_id").agg(F.min("root").alias("root"))
    ids = drawn.select("doc_id", "n_shingles")
    out = ids.filter(F.col("doc_id").isNotNull()).join(label, F.col("doc_id") == F.col("linked_id"), "left").drop("linked_id")
    out = out.unionByName(ids.filter(F.col("doc_id").isNull()).withColumn("root", F.lit(None).cast("long")))
    component = F.coalesce("root", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def deduplicated(docs: DataFrame, shingle: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """``docs`` with one document of each near-duplicate group.

    Rows with equal ids are one document: of those with equal texts the smallest row stays.
    """
    found = materialise(near_duplicates(docs, shingle, num, den), "found")
    gone = _sent(materialise(found.filter(~F.col("kept")).select(F.col("doc_id").alias("gone_id")).distinct(), "gone"))
    kept = docs.join(gone, docs["doc_id"] == gone["gone_id"], "left_anti")
    again = materialise(found.filter(F.col("kept") & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("again_id")).count().filter("count > 1").select("again_id"), "again")
    if again.isEmpty():
        return kept
    again = _sent(again)
    once = kept.join(again, kept["doc_id"] == again["again_id"], "left_anti")
    rows = kept.join(again, kept["doc_id"] == again["again_id"], "left_semi").select(F.struct(*[kept[c] for c in docs.columns]).alias("own_row"))
    rows = rows.groupBy(F.col("own_row.doc_id").alias("own_id"), F.col("own_row.text").alias("own_text")).agg(F.min("own_row").alias("own_row"))
    return once.unionByName(rows.select("own_row.*"))


def _sent(ids: DataFrame) -> DataFrame:
    """``ids`` (a written table), to be sent to every task if they are few enough."""
    return F.broadcast(ids) if ids.count() <= BROADCAST_ROWS else ids
