"""Near duplicates on word shingles by SetSketch registers.

Each text's shingle set is sketched into truncated, exponentially spaced minima
(a mergeable sketch whose registers agree about as often as two sets overlap).
Bands of registers propose candidates, a joint likelihood estimate drops pairs
that are far below the threshold, and links are confirmed on the full sets.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluiceway.llm.components import connected_components
from sluiceway.llm.staging import written
from sluiceway.llm.textbatch import mix, pieces, shingle_sets, texts_of

# SetSketch parameters: registers, base and rate of the exponentials, largest value
REGISTERS = 128
BAND = 4  # registers of 16 bits in a band, so that a band is one long
BASE = 1.001
RATE = 20.0
TOP = (1 << 16) - 2

# a pair is verified unless its estimate lies this many deviations below the threshold
DEVIATIONS = 5.0

# members and shingles of a block of a candidate group
BLOCK_MEMBERS = 256
BLOCK_SHINGLES = 200_000

_LOG_BASE = math.log(BASE)
_FACTORS = mix(np.arange(1, REGISTERS + 1, dtype=np.uint64)) | np.uint64(1)
_FOLDS = np.array([0x2545F4914F6CDD1D, 0xD6E8FEB86659FD93], dtype=np.uint64)


def registers(shingles: np.ndarray) -> np.ndarray:
    """The register values (16 bits each) of a non-empty set of hashes.

    Register i is the floor of 1 - log_b of the least exponential of the set,
    truncated to 0 and TOP + 1; registers of a union are the larger of the two.
    """
    low = np.full(REGISTERS, np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(shingles), 512):
        part = shingles[at : at + 512, None] * _FACTORS
        np.minimum(low, part.min(axis=0), out=low)
    uniform = (low.astype(np.float64) + 0.5) / 2.0**64
    exponential = -np.log1p(-np.minimum(uniform, 1 - 2.0**-53)) / RATE
    value = np.floor(1 - np.log(exponential) / _LOG_BASE)
    return np.clip(value, 0, TOP + 1).astype(np.uint16)


def merged(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The registers of the union of two sketched sets."""
    return np.maximum(a, b)


def likely_similarity(
    more: np.ndarray, fewer: np.ndarray, size_a: np.ndarray, size_b: np.ndarray
) -> np.ndarray:
    """Jaccard similarities of greatest likelihood, for known set sizes.

    ``more`` and ``fewer`` count the registers in which a exceeds b and b
    exceeds a. The log-likelihood is concave; its slope is bisected.
    """
    u = size_a / (size_a + size_b)
    v = 1.0 - u
    more, fewer = more.astype(float), fewer.astype(float)
    same = REGISTERS - more - fewer
    scale = (BASE - 1) / BASE
    low = np.zeros_like(u)
    high = np.minimum(u / v, v / u)
    for _ in range(30):
        j = (low + high) / 2
        x, y = np.maximum(u - v * j, 0), np.maximum(v - u * j, 0)
        p = -np.log1p(-x * scale) / _LOG_BASE
        q = -np.log1p(-y * scale) / _LOG_BASE
        dp = -v * scale / (1 - x * scale) / _LOG_BASE
        dq = -u * scale / (1 - y * scale) / _LOG_BASE
        with np.errstate(divide="ignore", invalid="ignore"):
            slope = (
                np.where(more > 0, more * dp / np.maximum(p, 1e-300), 0)
                + np.where(fewer > 0, fewer * dq / np.maximum(q, 1e-300), 0)
                - same * (dp + dq) / np.maximum(1 - p - q, 1e-300)
            )
        rising = slope > 0
        low, high = np.where(rising, j, low), np.where(rising, high, j)
    return (low + high) / 2


def _sketch(size: int):
    schema = pa.schema(
        [
            ("doc_id", pa.int64()),
            ("n_shingles", pa.int64()),
            ("set_a", pa.int64()),
            ("set_b", pa.int64()),
            ("bands", pa.list_(pa.int64())),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = texts_of(batch.column(1))
            counts, folds, bands = [], [], []
            for start, stop in pieces(texts):
                for shingles in shingle_sets(texts[start:stop], size):
                    counts.append(len(shingles))
                    if not len(shingles):
                        folds.append((None, None))
                        bands.append(None)
                        continue
                    # the sum does not depend on order: equal sets, equal folds
                    fold = mix(shingles[:, None] ^ _FOLDS).sum(axis=0).view(np.int64)
                    folds.append((int(fold[0]), int(fold[1])))
                    bands.append(registers(shingles).view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).cast(pa.int64()),
                    pa.array(counts, pa.int64()),
                    pa.array([a for a, _ in folds], pa.int64()),
                    pa.array([b for _, b in folds], pa.int64()),
                    pa.array(bands, pa.list_(pa.int64())),
                ],
                schema=schema,
            )

    return run


# what a member is in a unit of work: one that looks for links, or one of the block it
# looks into, which may stand apart from the group's smallest member or be linked with it
SEARCHING, APART, WITH_REP = 0, 1, 2


class _Members:
    """Distinct members of a unit of work, their sets and sketches, and a forest over them."""

    def __init__(self, members: list[tuple[int, bytes, np.ndarray, int]], size: int):
        unique = {(node, text, mark): bands for node, text, bands, mark in members}
        self.nodes = np.array([node for node, _, _ in unique], dtype=np.int64)
        self.marks = np.array([mark for _, _, mark in unique])
        texts = [text for _, text, _ in unique]
        self.sets: list[np.ndarray] = []
        for start, stop in pieces(texts):
            self.sets.extend(shingle_sets(texts[start:stop], size))
        self.sizes = np.array([len(s) for s in self.sets], dtype=float)
        self.sketch = np.stack([np.asarray(b, dtype=np.int64).view(np.uint16) for b in unique.values()])
        seen: dict[int, int] = {}
        self.root = [seen.setdefault(int(node), i) for i, node in enumerate(self.nodes)]

    def top(self, i: int) -> int:
        while self.root[i] != i:
            self.root[i] = self.root[self.root[i]]
            i = self.root[i]
        return i

    def join(self, i: int, j: int) -> None:
        a, b = self.top(i), self.top(j)
        self.root[max(a, b)] = min(a, b)

    def links(self, i: int, others: np.ndarray, percent: int) -> Iterator[tuple[int, int]]:
        """Confirmed links of member i that join it with further trees of the forest."""
        sizes = self.sizes[others]
        near = others[np.minimum(sizes, self.sizes[i]) * 100 >= percent * np.maximum(sizes, self.sizes[i])]
        if not len(near):
            return
        more = (self.sketch[i] > self.sketch[near]).sum(axis=1)
        fewer = (self.sketch[i] < self.sketch[near]).sum(axis=1)
        guess = likely_similarity(more, fewer, np.full(len(near), self.sizes[i]), self.sizes[near])
        share = percent / 100
        floor = share - DEVIATIONS * math.sqrt(share * (1 - share) / REGISTERS)
        order = np.argsort(-guess, kind="stable")
        for j in near[order[guess[order] >= floor]]:
            if self.top(i) == self.top(j):
                continue
            shared = len(np.intersect1d(self.sets[i], self.sets[j], assume_unique=True))
            if 100 * shared >= percent * (len(self.sets[i]) + len(self.sets[j]) - shared):
                self.join(i, j)
                yield int(self.nodes[i]), int(self.nodes[j])


def _within(key: tuple, rows: list, size: int, percent: int) -> Iterator[tuple]:
    """Links inside a block that holds its group's smallest member; (rep, node, null) for
    members that are not joined with it, if the group has other blocks."""
    rep, _, blocks = key
    members = _Members(rows, size)
    for i in range(1, len(members.nodes)):
        for a, b in members.links(i, np.arange(i), percent):
            yield rep, a, b
    if blocks > 1:
        joined = {members.top(int(i)) for i in np.flatnonzero(members.nodes == rep)}
        for i, node in enumerate(members.nodes):
            if members.top(i) not in joined:
                yield rep, int(node), None


def _across(key: tuple, rows: list, size: int, percent: int) -> Iterator[tuple]:
    """Links of searching members into a block. Those with the smallest member are one tree already."""
    members = _Members(rows, size)
    settled = np.flatnonzero(members.marks == WITH_REP)
    for i in settled[1:]:
        members.join(int(settled[0]), int(i))
    for i in np.flatnonzero(members.marks == SEARCHING):
        # two members that both search meet twice: one of the times is enough
        again = (members.marks == APART) & (members.nodes > members.nodes[i])
        for a, b in members.links(int(i), np.flatnonzero(again | (members.marks == WITH_REP)), percent):
            yield key[0], a, b


_UNIT = ["rep", "k", "m", "node", "text", "bands", "mark"]
_LINKS = "rep long, a long, b long"


def _linked(unit: DataFrame, links, size: int, percent: int) -> DataFrame:
    """``links`` of every unit of work (rep, k, m), one of them in memory at a time."""
    schema = pa.schema([("rep", pa.int64()), ("a", pa.int64()), ("b", pa.int64())])

    def out(key, rows):
        found = list(links(key, rows, size, percent)) if len(rows) > 1 else []
        columns = list(zip(*found, strict=True)) or [(), (), ()]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows = None, []
        for batch in batches:
            keys = zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True)
            nodes, marks = batch.column(3).to_pylist(), batch.column(6).to_pylist()
            texts = texts_of(batch.column(4))
            bands = batch.column(5)
            for at, now in enumerate(keys):
                if now != key:
                    yield out(key, rows)
                    key, rows = now, []
                rows.append((nodes[at], texts[at], bands[at].values.to_numpy(), marks[at]))
        yield out(key, rows)

    return (
        unit.select(_UNIT)
        .repartition("rep", "k", "m")
        .sortWithinPartitions("rep", "k", "m", "node")
        .mapInArrow(run, _LINKS)
    )


def _parts(of: DataFrame, name: str, least: int) -> DataFrame:
    """Groups whose members in ``of`` go in ``least`` blocks or more, and in how many.

    Written, so that a join of a group with a large part of all members can be split.
    """
    count = F.ceil(
        F.greatest(F.count("*") / F.lit(BLOCK_MEMBERS), F.sum("n_shingles") / F.lit(BLOCK_SHINGLES))
    )
    return written(of.groupBy("rep").agg(count.alias(name)).where(F.col(name) >= least), "blocks")


def _numbers(count: str):
    return F.sequence(F.lit(0).cast("long"), F.col(count) - 1)


def _group_links(
    groups: DataFrame, nodes: DataFrame, source: DataFrame, size: int, percent: int
) -> DataFrame:
    """``a``, ``b``: a forest of confirmed links of the members of every group.

    First every block of a group is compared within itself and with the group's smallest
    member, so that near copies of one text are joined in one pass over them, however many there
    are. Only members that this leaves apart then look into the group's other blocks.
    """
    # groups of one block, by far the most, are not listed
    placed = (
        groups.join(_parts(groups, "blocks", 2), "rep", "left")
        .withColumn("blocks", F.coalesce("blocks", F.lit(1).cast("long")))
        .withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")))
    )
    candidates = groups.select("node").distinct().join(nodes.select("node", "bands"), "node")
    texts = source.join(candidates, F.col("doc_id") == F.col("node")).select("node", "text", "bands")
    first = written(
        _linked(
            placed.withColumn(
                "k", F.explode(F.when(F.col("node") == F.col("rep"), _numbers("blocks")).otherwise(F.array("own")))
            )
            .select("rep", "k", F.col("blocks").alias("m"), "node", F.lit(SEARCHING).alias("mark"))
            .join(texts, "node"),
            _within,
            size,
            percent,
        ),
        "links",
    )
    links = first.where("b is not null").select("a", "b")
    apart = first.where("b is null").select("rep", F.col("a").alias("node")).distinct()
    if apart.isEmpty():
        return links
    left = placed.join(apart, ["rep", "node"])
    parts = _parts(left, "parts", 1)
    searching = left.join(parts, "rep").select(
        "rep",
        F.pmod(F.xxhash64("node"), F.col("parts")).alias("k"),
        F.explode(_numbers("blocks")).alias("m"),
        "node",
        F.lit(SEARCHING).alias("mark"),
    )
    searched = (
        placed.join(parts, "rep")
        .join(apart.withColumn("mark", F.lit(APART)), ["rep", "node"], "left")
        .select(
            "rep",
            F.explode(_numbers("parts")).alias("k"),
            F.col("own").alias("m"),
            "node",
            F.coalesce("mark", F.lit(WITH_REP)).alias("mark"),
        )
    )
    unit = written(searching.unionByName(searched), "apart")
    # the texts of these groups only: while they are few, no other text is shuffled again
    needed = written(unit.select("node").distinct(), "needed")
    again = (
        source.join(needed, F.col("doc_id") == F.col("node"))
        .select("node", "text")
        .join(nodes.select("node", "bands").join(needed, "node", "left_semi"), "node")
    )
    more = _linked(unit.join(again, "node"), _across, size, percent)
    return links.unionByName(written(more, "links").select("a", "b"))


def near_duplicates(
    docs: DataFrame,
    shingle: int = 5,
    percent: int = 80,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """``doc_id``, ``n_shingles``, ``component_id`` and ``kept`` for every row.

    Words are runs of non-blank characters, A-Z lower-cased. Texts are linked
    when 100 * intersection >= ``percent`` * union of their shingle sets.
    ``component_id`` is the smallest id that links reach, ``kept`` tells whether
    the row has that id.

    Null and wordless texts have an empty set and are linked with nothing. Rows
    with equal sets are one class before any pair is looked at. Rows that share
    an id count as one document. A row without an id stands alone: its
    ``component_id`` is null and it is kept. An empty table gives no rows.

    Two texts at the threshold share no band with a chance of (1 - 0.8**4)**32,
    about 5e-8. Candidates of a bucket meet at the bucket's smallest member;
    large groups are cut into blocks, so that no group has to fit in one task.
    Every block is compared within itself and with that member; what is not joined
    with it looks into the other blocks. Only a forest of confirmed links leaves a
    block, never its pairs.
    """
    source = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")
    )
    sketches = written(
        source.mapInArrow(
            _sketch(shingle),
            "doc_id long, n_shingles long, set_a long, set_b long, bands array<long>",
        ),
        "sketches",
    )
    with_set = sketches.where("n_shingles > 0 and doc_id is not null")
    nodes = written(
        with_set.groupBy("set_a", "set_b").agg(
            F.min("doc_id").alias("node"),
            F.first("bands").alias("bands"),
            F.first("n_shingles").alias("n_shingles"),
        ),
        "classes",
    )
    banded = nodes.select("node", "n_shingles", F.posexplode("bands").alias("band", "value"))
    # written, so that the join below can split a bucket with a large part of all texts
    shared = written(
        banded.groupBy("band", "value")
        .agg(F.min("node").alias("rep"), F.max("node").alias("last"))
        .where("rep <> last")
        .drop("last"),
        "buckets",
    )
    groups = written(
        banded.join(shared.hint("merge"), ["band", "value"])
        .groupBy("rep", "node")
        .agg(F.first("n_shingles").alias("n_shingles")),
        "candidates",
    )
    links = _group_links(groups, nodes, source, shingle, percent)
    components = connected_components(links)
    labels = (
        nodes.select("set_a", "set_b", "node")
        .join(components, "node", "left")
        .select("set_a", "set_b", F.coalesce("component", "node").alias("component"))
    )
    found = sketches.drop("bands").join(
        labels, ["set_a", "set_b"], "left"
    )
    component = F.when(F.col("doc_id").isNull(), F.lit(None).cast("long")).otherwise(
        F.coalesce("component", "doc_id")
    )
    return found.select(
        "doc_id",
        "n_shingles",
        component.alias("component_id"),
        F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"),
    )
