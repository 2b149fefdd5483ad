"""SimHash near-duplicates, with pigeonring filtering of candidate pairs.

The 64 bits of a fingerprint stand on a ring of ``SEGMENTS`` segments. If two
fingerprints differ in at most ``tau`` bits, then from some segment on, every chain
of l consecutive segments differs in at most floor(l * tau / SEGMENTS) bits: the
strong form of the pigeonhole principle. With 4 segments and 3 bits the budgets of
a chain are 0, 1, 2 and 3. A key holds what the first two budgets fix exactly: the
whole first segment, and the half of the second that stays equal when it differs in
one bit at most. Pairs that share a key go through the rest of the chain and then
the full Hamming check.

Only distinct fingerprints are compared. A key with many fingerprints is cut into
blocks of bounded size; each pair of blocks is one small group, and a group emits
links that span its components, not all its pairs.

Texts alike to 0.8 by their 5-word shingles differ in about 15 % of the bits, too many for keys made of exact
segments. For these (``without_near_copies``) candidates come from bands of min-hashes, and the pigeonring prunes
them on fingerprints of 256 bits before the shingles themselves decide.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, parquet_path, place, without_places, written
from .components import connected_components
from .neighbours import neighbour_pairs, pairs_apart
from .passages import _MIX, _mixed, _whole_groups, shingles_of_all

SEGMENTS = 4
BITS = 64
#: Fingerprints in a block of a key; a group compares two blocks at most.
BLOCK = 256


def fingerprint_of(text: str | None, width: int = 3) -> int:
    """Signed 64-bit SimHash of the ``width``-word shingles of the whole text."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    if len(words) < width:
        shingles = [b" ".join(words)]
    else:
        shingles = map(b" ".join, zip(*(words[k:] for k in range(width)), strict=False))
    n = max(len(words) - width + 1, 1)
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(s, 42) for s in shingles), np.uint64, n)
    votes = np.zeros(BITS, np.int64)
    for at in range(0, n, 65_536):
        part = np.unpackbits(hashes[at : at + 65_536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        votes += part.sum(axis=0, dtype=np.int64)
    return int(np.packbits(votes * 2 > n, bitorder="little").view(np.int64)[0])


def fingerprints(
    docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), text: str = "text", width: int = 3
) -> DataFrame:
    """Columns ``keep`` and ``fp``, the signed 64-bit fingerprint of the whole text.

    A-Z count as a-z; a null or empty text, or one of separators only, gives 0.
    """
    taken = docs.select(*[F.col(c) for c in keep], F.col(text).alias("_text"))
    schema = ", ".join(f"`{c}` {t}" for c, t in taken.dtypes[:-1]) + ", fp bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = [fingerprint_of(x.as_py(), width) for x in batch.column(len(keep))]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[: len(keep)], pa.array(fp, pa.int64())], names=[*keep, "fp"]
            )

    return taken.mapInArrow(run, schema)


def spanning_links(fp: np.ndarray, start: int, tau: int = 3) -> list[tuple[int, int]]:
    """Links that connect what the ring chain from segment ``start`` and the Hamming check connect."""
    size = BITS // SEGMENTS
    ring = fp >> np.uint64(size * start)  # the chain's first segment in the lowest bits
    if start:
        ring = ring | (fp << np.uint64(BITS - size * start))
    left, out = np.arange(len(fp)), []
    while len(left):  # breadth first over what is not yet connected
        front, left = left[:1], left[1:]
        while len(front) and len(left):
            found = np.zeros(len(left), bool)
            for at in range(0, len(front), 64):
                some = front[at : at + 64]
                diff = ring[some][:, None] ^ ring[left][None, :]
                close = np.bitwise_count(diff) <= tau
                for length in range(1, SEGMENTS):
                    low = diff & np.uint64((1 << size * length) - 1)
                    close &= np.bitwise_count(low) <= length * tau // SEGMENTS
                close &= ~found[None, :]
                hit = close.any(axis=0)
                out += zip(some[close.argmax(axis=0)[hit]].tolist(), left[hit].tolist(), strict=True)
                found |= hit
            front, left = left[found], left[~found]
    return out


def near_links(distinct: DataFrame, tau: int = 3, block: int = BLOCK) -> DataFrame:
    """Links (``a``, ``b``) between the fingerprints of ``distinct(fp)``, each once in the table.

    They connect exactly what all pairs at ``tau`` (3 at most) or fewer bits connect.
    """
    if tau >= SEGMENTS:
        raise ValueError("the first segment of a chain must be equal: tau is 3 at most")
    size, half = BITS // SEGMENTS, BITS // SEGMENTS // 2
    keys = []
    for start in range(SEGMENTS):
        first = F.shiftrightunsigned("fp", size * start).bitwiseAND((1 << size) - 1)
        second = F.shiftrightunsigned("fp", size * ((start + 1) % SEGMENTS)).bitwiseAND((1 << size) - 1)
        for part in range(2):
            same = F.shiftrightunsigned(second, half * part).bitwiseAND((1 << half) - 1)
            tag = (start * 2 + part) << (size + half)
            keys.append(first.bitwiseOR(F.shiftleft(same, size)).bitwiseOR(F.lit(tag).cast("bigint")))
    keyed = distinct.select("fp", F.explode(F.array(*keys)).alias("key"))
    counted = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    blocks = F.ceil(F.col("n") / block).cast("int")
    mine = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    placed = keyed.join(counted, "key").withColumn("blocks", blocks).withColumn("mine", mine)
    pairs = placed.select(
        "key", "fp", "mine", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    ).select(
        "key", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "fp"
    )
    groups = pairs.groupBy("key", "i", "j").agg(F.collect_list("fp").alias("fps")).where(F.size("fps") > 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            starts = (batch.column(0).to_numpy() >> (size + half)) // 2
            a, b = [], []
            for start, value in zip(starts.tolist(), batch.column(1), strict=True):
                fp = value.values.to_numpy(zero_copy_only=False).view(np.uint64)
                for x, y in spanning_links(fp, start, tau):
                    a.append(fp[x])
                    b.append(fp[y])
            yield pa.record_batch(
                {k: pa.array(np.array(v, np.uint64).view(np.int64)) for k, v in (("a", a), ("b", b))}
            )

    found = groups.select("key", "fps").mapInArrow(run, "a bigint, b bigint")
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def near_duplicates(
    docs: DataFrame, text: str = "text", doc_id: str = "doc_id", tau: int = 3, width: int = 3
) -> DataFrame:
    """``doc_id``, ``fp`` and ``component_id``, one row per row of ``docs``.

    Rows whose fingerprints differ in at most ``tau`` bits are linked; a component's
    id is its smallest non-null doc_id. Null, empty and blank texts have
    fingerprint 0 and are linked like others. Repeated rows stay repeated. An empty
    table gives an empty result. Columns of other names are neither read nor kept.
    """
    taken = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    prints = written(fingerprints(taken, width=width), "fp")
    classes = _smallest(prints, "doc_id", tau).select("fp", F.col("smallest").alias("component_id"))
    return prints.join(classes, "fp").select("doc_id", "fp", "component_id")


def _smallest(prints: DataFrame, column: str, tau: int) -> DataFrame:
    """``fp``, ``root`` and ``smallest`` (value of ``column`` in the component) of each distinct fingerprint."""
    distinct = prints.groupBy("fp").agg(F.min(column).alias("least"))
    roots = connected_components(near_links(distinct.select("fp"), tau))
    rooted = distinct.join(roots, distinct.fp == roots.node, "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root")
    )
    named = rooted.groupBy("root").agg(F.min("least").alias("smallest"))
    return rooted.select("fp", "root").join(named, "root").select("fp", "root", "smallest")


def without_near_duplicates(
    docs: DataFrame, text: str = "text", doc_id: str = "doc_id", tau: int = 3, width: int = 3
) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns: of each component the one with the
    smallest doc_id (a null id only if all are null; of equal ids, the first by file and row).

    A row is named by its place in a file, so anything but a plain read of Parquet is
    written first.
    """
    spark, path = docs.sparkSession, parquet_path(docs, "near-dedup-input")
    rows = spark.read.schema(docs.schema).parquet(path).select(
        F.struct(F.col(doc_id).isNull().alias("no_id"), F.col(doc_id).alias("id"), place().alias("place")).alias("who"),
        F.col(text).alias("text"),
    )
    prints = written(fingerprints(rows, ("who",), width=width), "fp")
    goes = prints.join(_smallest(prints, "who", tau), "fp").where("who <> smallest")
    return without_places(spark, path, docs.schema, goes.select("who.place.file", "who.place.row"))


#: Near copies: words of a shingle, and the Jaccard similarity of the shingle sets from which on texts are alike.
WIDTH, SIMILAR = 5, 0.8
#: Two texts alike to 0.8 share none of the bands with a probability of (1 - 0.8^ROWS)^BANDS, about 0.0002.
BANDS, ROWS = 16, 4
#: Words of a wide fingerprint, and bits of them in which texts alike to 0.8 differ at most: they differ in 39 on average,
#: with a deviation of 5.7.
WORDS, WIDE_TAU = 4, 66
#: Nodes of a band's group up to which its pairs are listed; those of larger groups meet in cells of two blocks of CELL nodes.
LISTED, CELL = 64, 512
_SALTS = _mixed(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64) * _MIX[0])


def shingle_set(text: str | None) -> np.ndarray:
    """Sorted distinct hashes of the 5-word shingles; a shorter text is one shingle, one without words none."""
    for width in range(WIDTH, 0, -1):
        found = np.unique(shingles_of_all([text], width)[0])
        if len(found):
            return found
    return found


def bands_of(held: np.ndarray) -> np.ndarray:
    """One key for each band of min-hashes of a shingle set; an empty set has none."""
    if not len(held):
        return np.zeros(0, np.int64)
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(held), 4096):
        part = held[at : at + 4096]
        least = np.minimum(least, _mixed(part[None, :] ^ _SALTS[:, None]).min(axis=1))
    out = np.arange(BANDS, dtype=np.uint64)
    for k in range(ROWS):
        out = _mixed(out * _MIX[0] ^ least.reshape(BANDS, ROWS)[:, k])
    return out.view(np.int64)


def wide_fingerprint(held: np.ndarray) -> np.ndarray:
    """SimHash of a shingle set in WORDS words of 64 bits."""
    votes = np.zeros(WORDS * BITS, np.int64)
    for at in range(0, len(held), 8192):
        words = _mixed(held[at : at + 8192, None] * _MIX[1] ^ _SALTS[None, :WORDS])
        votes += np.unpackbits(words.view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(votes * 2 > len(held), bitorder="little").view(np.int64)


def ring_close(a: np.ndarray, b: np.ndarray, tau: int) -> np.ndarray:
    """Which columns of two arrays (words by rows), each word one segment, pass the pigeonring and the Hamming check.

    If at most ``tau`` bits differ, from some segment on every chain of l segments differs in at most
    floor(l * tau / segments) bits.
    """
    diff = np.bitwise_count((a ^ b).view(np.uint64)).astype(np.int64)
    n = len(diff)
    ring = np.cumsum(np.concatenate([diff, diff]), axis=0)
    budgets = (np.arange(1, n + 1) * tau // n)[:, None]
    chains = [ring[k : k + n] - (ring[k - 1] if k else 0) for k in range(n)]
    return np.any([(c <= budgets).all(axis=0) for c in chains], axis=0)


def alike(one: np.ndarray, two: np.ndarray) -> bool:
    both = len(np.intersect1d(one, two, assume_unique=True))
    return both >= SIMILAR * (len(one) + len(two) - both)


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    lists = pa.list_(pa.int64())
    for batch in batches:
        sets = [shingle_set(x) for x in batch.column(1).to_pylist()]
        node = np.array([xxhash.xxh3_64_intdigest(s.tobytes()) for s in sets], np.uint64).view(np.int64)
        bands, prints = pa.array([bands_of(s) for s in sets], lists), pa.array([wide_fingerprint(s) for s in sets], lists)
        sizes = pa.array([len(s) for s in sets], pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(node), sizes, bands, prints], names=["who", "node", "n", "bands", "fp"])


def _neighbours(banded: DataFrame) -> DataFrame:
    """Distinct pairs of nodes that share a band, are its first or next to each other by id, and pass the pigeonring."""

    def paired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, x, y, _ in neighbour_pairs(batches, 1, 1):
            close = may_be_alike(rows[2:], x, y)
            one, two = rows[1, x[close]], rows[1, y[close]]
            yield pa.record_batch({"a": np.maximum(one, two), "b": np.minimum(one, two)})

    dealt = banded.repartition("band").sortWithinPartitions("band", "node")
    words = [F.col("fp")[k].alias(f"f{k}") for k in range(WORDS)]
    return dealt.select("band", "node", "n", *words).mapInArrow(paired, "a bigint, b bigint").where("a <> b").distinct()


def may_be_alike(rows: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Whether columns x and y of ``rows`` (sizes of sets, then wide fingerprints) can be alike to SIMILAR: sizes of such sets
    are so too, and their fingerprints pass the pigeonring."""
    n, m = rows[0, x], rows[0, y]
    close = np.minimum(n, m) >= SIMILAR * np.maximum(n, m) - 1e-9
    close[close] = ring_close(rows[1:, x[close]], rows[1:, y[close]], WIDE_TAU)
    return close


def shares_band(bands: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Number of the first band that columns x and y share; BANDS if there is none."""
    equal = bands[:, x] == bands[:, y]
    return np.where(equal.any(axis=0), equal.argmax(axis=0), BANDS)


_WIDE = [*(f"f{k}" for k in range(WORDS)), *(f"b{k}" for k in range(BANDS))]


def _listed(small: DataFrame) -> DataFrame:
    """All pairs ``a``, ``b`` of different classes (``ra``, ``rb``) in groups of LISTED nodes or fewer that can be alike, each once: a pair counts
    in the first band that it shares. ``small(band, pos, node, root, n, fp, bands)``."""

    def paired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _whole_groups(batches, 1):
            starts = np.flatnonzero(np.append(True, rows[0, 1:] != rows[0, :-1]))
            for at, end in zip(starts.tolist(), [*starts[1:].tolist(), rows.shape[1]], strict=True):
                group = rows[:, at:end]
                for x, y in pairs_apart(group[3]):
                    first = shares_band(group[5 + WORDS :], x, y) == group[1, 0]
                    first[first] = may_be_alike(group[4 : 5 + WORDS], x[first], y[first])
                    x, y = x[first], y[first]
                    made = {"a": group[2, x], "b": group[2, y], "ra": group[3, x], "rb": group[3, y]}
                    yield pa.record_batch({k: pa.array(v) for k, v in made.items()})

    wide = [F.col("fp")[k].alias(f"f{k}") for k in range(WORDS)] + [F.col("bands")[k].alias(f"b{k}") for k in range(BANDS)]
    rows = small.select("band", F.col("pos").cast("bigint").alias("pos"), "node", "root", "n", *wide)
    return rows.repartition("band").sortWithinPartitions("band").mapInArrow(paired, "a bigint, b bigint, ra bigint, rb bigint")


def _cells(large: DataFrame) -> DataFrame:
    """``cell`` and ``node``: cells of two blocks each, in which all nodes of different classes meet that share one of the groups in
    ``large(band, node, root)``.

    Nodes that share groups, directly or by way of others, are dealt to blocks of about CELL. A class that is larger than a block has blocks of its
    own, and these are not paired with each other. A node comes once for each block that its own is paired with, however many groups it is in.
    """
    stars = large.groupBy("band").agg(F.min("node").alias("first"))
    links = large.join(stars, "band").select(F.col("node").alias("a"), F.col("first").alias("b"))
    together = connected_components(links.distinct()).select("node", F.col("root").alias("set"))
    members = written(large.select("node", "root").distinct().join(together, "node"), "near-members")
    sizes = members.groupBy("set", "root").agg(F.count("*").alias("own"))
    rest = sizes.where(F.col("own") <= CELL).groupBy("set").agg(F.sum("own").alias("rest"))
    placed = members.join(sizes, ["set", "root"]).join(rest, "set", "left")
    alone = F.col("own") > CELL
    part = F.when(alone, F.col("root"))
    number = F.pmod(F.xxhash64("node"), F.ceil(F.when(alone, F.col("own")).otherwise(F.col("rest")) / CELL))
    placed = placed.select("set", "node", part.alias("part"), F.xxhash64("set", part, alone, number).alias("block"))
    blocks = placed.select("set", "part", "block").distinct()
    other = blocks.toDF("set", "other_part", "other")
    pairs = blocks.join(other, "set").where((F.col("block") <= F.col("other")) & ~F.coalesce(F.col("part") == F.col("other_part"), F.lit(False)))
    named = pairs.select(F.xxhash64("block", "other").alias("cell"), F.explode(F.array_distinct(F.array("block", "other"))).alias("block"))
    return placed.select("block", "node").join(named, "block").select("cell", "node")


def spanning(held: np.ndarray, sets: list[np.ndarray], x: np.ndarray, y: np.ndarray) -> list[tuple[int, int]]:
    """Of the pairs (x, y) those that are alike and connect what all alike pairs connect. ``held``: classes, connected beforehand.

    With many pairs the sizes of what two sets share come from products of blocks of their incidence matrix; with few, pair by pair.
    """
    n, lengths = len(sets), np.array([len(s) for s in sets])
    all_, owner = np.concatenate(sets), np.repeat(np.arange(n), lengths)
    values, number, often = np.unique(all_, return_inverse=True, return_counts=True)
    several = often > 1
    column = np.cumsum(several) - 1
    inside = several[number]
    row, col, width = owner[inside], column[number[inside]], int(several.sum())
    if len(x) * 2_000 > n * width:
        shared = np.zeros((n, n), np.float32)
        for at in range(0, width, 4_096):
            some = (col >= at) & (col < at + 4_096)
            block = np.zeros((n, min(4_096, width - at)), np.float32)
            block[row[some], col[some] - at] = 1
            shared += block @ block.T
        both = shared[x, y]
        ok = both >= SIMILAR * (lengths[x] + lengths[y] - both) - 1e-6
        x, y = x[ok], y[ok]
    parent: dict[int, int] = {}

    def root(k: int) -> int:
        while parent.setdefault(k, k) != k:
            k = parent[k]
        return k

    out = []
    for one, two in zip(x.tolist(), y.tolist(), strict=True):
        a, b = root(int(held[one])), root(int(held[two]))
        if a != b and alike(sets[one], sets[two]):
            parent[a] = b
            out.append((one, two))
    return out


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links within cells. Rows (cell, node, root, n, wide fingerprint, bands, text) are sorted by cell; a cell has two blocks of nodes at most."""
    held: list[pa.RecordBatch] = []

    def links(cell: pa.Table) -> pa.RecordBatch:
        cell = cell.combine_chunks()
        numbers = np.stack([cell.column(k).to_numpy() for k in range(1, 4 + WORDS + BANDS)])
        sets, a, b = None, [], []
        for x, y in pairs_apart(numbers[1]):
            ok = shares_band(numbers[3 + WORDS :], x, y) < BANDS
            ok[ok] = may_be_alike(numbers[2 : 3 + WORDS], x[ok], y[ok])
            if ok.any():
                sets = sets or [shingle_set(t) for t in cell.column(4 + WORDS + BANDS).to_pylist()]
                for one, two in spanning(numbers[1], sets, x[ok], y[ok]):
                    a.append(numbers[0, one])
                    b.append(numbers[0, two])
        return pa.record_batch({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    for batch in batches:
        cells = batch.column(0).to_numpy()
        cuts = [0, *(np.flatnonzero(cells[1:] != cells[:-1]) + 1).tolist(), len(cells)]
        for at, end in zip(cuts[:-1], cuts[1:], strict=True):
            part = batch.slice(at, end - at)
            if held and part.num_rows and held[0].column(0)[0] != part.column(0)[0]:
                yield links(pa.Table.from_batches(held))
                held = []
            if part.num_rows:
                held.append(part)
    if held:
        yield links(pa.Table.from_batches(held))


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of a cell's pairs that are alike. Its texts come first, at most two blocks of CELL; pairs that are connected already are passed over."""
    cell, sets, parent = None, {}, {}

    def root(x: int) -> int:
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for batch in batches:
        a, b = [], []
        for now, one, two, ra, rb, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if now != cell:
                cell, sets, parent = now, {}, {}
            if two is None:
                sets[one] = shingle_set(text)
                continue
            x, y = root(ra), root(rb)
            if x != y and alike(sets[one], sets[two]):
                parent[x] = y
                a.append(one)
                b.append(two)
        yield pa.record_batch({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def near_copy_links(rows: DataFrame, prints: DataFrame) -> DataFrame:
    """Links ``a``, ``b`` between nodes (texts with one shingle set) alike to SIMILAR, that connect what all pairs that share a band connect.

    Each node is first compared with its neighbour and the first node of its bands' groups, so that large groups of copies become one
    class at little cost. What is still apart in a group is then compared pair by pair: small groups list their pairs, large ones send their texts
    to cells of bounded size, which emit spanning links only. No pair is left out, whatever a group's size; work grows with the square
    only of texts that look alike without being so.
    """
    distinct = prints.dropDuplicates(["node"]).select("node", "n", "bands", "fp", F.posexplode("bands").alias("pos", "band"))
    banded = written(distinct.select("node", "n", "pos", "band", "bands", "fp"), "near-bands")
    holders = prints.groupBy("node").agg(F.min("who.place").alias("place"))

    def with_texts(wanted: DataFrame) -> DataFrame:
        """``wanted(node, ...)`` with the nodes' texts."""
        named = written(wanted.select("node").distinct().join(holders, "node"), "near-named")
        small = named.count() <= BROADCAST_ROWS
        texts = rows.select(F.col("who.place").alias("place"), "text").join(F.broadcast(named) if small else named, "place")
        return wanted.join(written(texts.select("node", "text"), "near-texts"), "node")

    def compared(pairs: DataFrame) -> DataFrame:
        """Alike pairs of ``pairs(a, b, ra, rb)``, each in a cell of its own."""
        pairs = written(pairs.withColumn("cell", F.xxhash64("a", "b")), "near-pairs")
        ends = pairs.select("cell", F.explode(F.array("a", "b")).alias("node")).distinct()
        none = F.lit(None).cast("bigint")
        held = with_texts(ends).select("cell", F.col("node").alias("a"), none.alias("b"), none.alias("ra"), none.alias("rb"), "text")
        both = held.union(pairs.select("cell", "a", "b", "ra", "rb", F.lit(None).cast("string")))
        dealt = both.repartition("cell").sortWithinPartitions("cell", F.col("b").isNotNull(), "a", "b")
        return written(dealt.mapInArrow(_compared, "a bigint, b bigint"), "near-links")

    near = _neighbours(banded)
    links = compared(near.select("a", "b", F.col("a").alias("ra"), F.col("b").alias("rb")))
    roots = connected_components(links).withColumnRenamed("node", "_n")
    rooted = banded.join(roots, F.col("node") == F.col("_n"), "left").withColumn("root", F.coalesce("root", "node"))
    rooted = written(rooted.drop("_n"), "near-rooted")
    mixed = rooted.groupBy("band").agg(F.count("*").alias("size"), F.min("root").alias("_lo"), F.max("root").alias("_hi")).where("_lo <> _hi").select("band", "size")
    mixed = written(mixed, "near-mixed")
    open_ = written(rooted.join(F.broadcast(mixed) if mixed.count() <= BROADCAST_ROWS else mixed, "band"), "near-open")
    few = compared(_listed(open_.where(F.col("size") <= LISTED)))
    large = open_.where(F.col("size") > LISTED)
    wide = [F.col("fp")[k].alias(f"f{k}") for k in range(WORDS)] + [F.col("bands")[k].alias(f"b{k}") for k in range(BANDS)]
    known = large.dropDuplicates(["node"]).select("node", "root", "n", *wide)
    meeting = with_texts(written(_cells(large.select("band", "node", "root")), "near-cells")).join(known, "node")
    dealt = meeting.select("cell", "node", "root", "n", *_WIDE, "text").repartition("cell").sortWithinPartitions("cell", "node")
    many = written(dealt.mapInArrow(_met, "a bigint, b bigint"), "near-links")
    return links.union(few).union(many)


def without_near_copies(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns: of each component of texts alike to SIMILAR the one
    with the smallest doc_id (a null id only if all are null; of equal ids, the first by file and row).

    Null texts and texts without words are one component. Rows are named by their place in a file, so repeated rows,
    repeated or null ids and columns of any other name do no harm; anything but a plain read of Parquet is written
    first. An empty table gives an empty result.
    """
    spark, path = docs.sparkSession, parquet_path(docs, "near-dedup-input")
    rows = spark.read.schema(docs.schema).parquet(path).select(
        F.struct(F.col(doc_id).isNull().alias("no_id"), F.col(doc_id).alias("id"), place().alias("place")).alias("who"),
        F.col(text).alias("text"),
    )
    who = rows.schema["who"].dataType.simpleString()
    prints = written(rows.mapInArrow(_signed, f"who {who}, node bigint, n bigint, bands array<bigint>, fp array<bigint>"), "near-prints")
    roots = connected_components(near_copy_links(rows, prints))
    nodes = prints.groupBy("node").agg(F.min("who").alias("least"))
    rooted = nodes.join(roots.withColumnRenamed("node", "n"), F.col("node") == F.col("n"), "left").select(
        "node", "least", F.coalesce("root", "node").alias("root")
    )
    stays = rooted.groupBy("root").agg(F.min("least").alias("smallest"))
    goes = prints.select("who", "node").join(rooted.select("node", "root"), "node").join(stays, "root")
    return without_places(spark, path, docs.schema, goes.where("who <> smallest").select("who.place.file", "who.place.row"))
