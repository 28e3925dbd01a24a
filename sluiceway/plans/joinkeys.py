"""Columns of the sources that later steps join with each other.

The plan of a flow tells which columns are compared in joins, and which column each
was made from. Columns of different sources that are compared, directly or through others, are one key.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping

from pyspark.sql import Column, DataFrame, functions as F

from sluiceway.functions.expression import quoted
from sluiceway.session import new_scratch_path

_STEPS = 1 << 20
_TASK_PAIRS = 10_000_000  # pairs of rows that one task compares
_BLOCK_ROWS = 512  # neighbouring rows of a key that go to the same tiles
_PART_BLOCKS = 64  # blocks that one task numbers
_DEALT_ROWS = 2_000_000  # rows that one task deals to tiles
_ROW, _BLOCK, _TILE, _KEY = "row of the side", "block of the side", "tile of the join", "key of the tile"


def _parts(of, name: str) -> Iterator:
    found = getattr(of, name)()
    yield from (found.apply(i) for i in range(found.length()))


def _kind(of) -> str:
    return of.getClass().getSimpleName()


def _attribute(expression) -> int | None:
    """The number of a column that stands alone or under casts."""
    while _kind(expression) == "Cast":
        expression = expression.child()
    return expression.exprId().id() if _kind(expression) == "AttributeReference" else None


def _compared(condition) -> Iterator[tuple[int, int]]:
    todo = [condition]
    while todo:
        one = todo.pop()
        if _kind(one) == "And":
            todo += [one.left(), one.right()]
        elif _kind(one) in ("EqualTo", "EqualNullSafe"):
            left, right = _attribute(one.left()), _attribute(one.right())
            if left is not None and right is not None:
                yield left, right


class _Groups:
    def __init__(self):
        self.above: dict[int, int] = {}

    def top(self, x: int) -> int:
        while self.above.setdefault(x, x) != x:
            x = self.above[x]
        return x

    def join(self, a: int, b: int) -> None:
        self.above[self.top(a)] = self.top(b)


def shared_keys(sources: Mapping[int, DataFrame], result: DataFrame) -> list[dict[int, list[str]]]:
    """For each key that at least two sources share: its columns, by source."""
    groups, seen = _Groups(), set()
    todo = [result._jdf.queryExecution().analyzed()]
    defined: dict[int, list[int]] = {}
    used: list[tuple[int, list[int]]] = []
    numbers = lambda node: [column.exprId().id() for column in _parts(node, "output")]
    while todo:
        node = todo.pop()
        if node.hashCode() in seen:
            continue
        seen.add(node.hashCode())
        todo += _parts(node, "children")
        if _kind(node) == "CTERelationDef":
            defined[node.id()] = numbers(node)
        elif _kind(node) == "CTERelationRef":
            used.append((node.cteId(), numbers(node)))
        elif _kind(node) in ("Join", "Filter"):
            condition = node.condition()
            if _kind(node) == "Join":
                condition = condition.get() if condition.isDefined() else None
            for a, b in _compared(condition) if condition is not None else ():
                groups.join(a, b)
        elif _kind(node) == "Project":
            for one in _parts(node, "projectList"):
                if _kind(one) == "Alias" and (made_from := _attribute(one.child())) is not None:
                    groups.join(one.exprId().id(), made_from)
    for number, columns in used:
        for ours, theirs in zip(columns, defined[number], strict=True):
            groups.join(ours, theirs)
    found: dict[int, dict[int, list[str]]] = {}
    for i, frame in sources.items():
        for column in _parts(frame._jdf.queryExecution().analyzed(), "output"):
            key = groups.top(column.exprId().id())
            found.setdefault(key, {}).setdefault(i, []).append(column.name())
    return [columns for columns in found.values() if len(columns) > 1]


def in_sample(column: str, share: float) -> Column:
    """True for the values of a key that are in a sample of its values, in whichever source they stand."""
    value = F.xxhash64(quoted(column).cast("string"))
    return F.pmod(value, F.lit(_STEPS)) < F.lit(max(1, round(share * _STEPS)))


def _in_blocks(df: DataFrame, key: str, value: str, n_rows: int, label: str) -> DataFrame:
    """The rows that can have a partner, in order of key and value, with the number of their block.

    They are written once to the shared folder: a second reading must find the same numbers.
    """
    order = [quoted(key), quoted(value), F.col(_ROW)]
    placed = (
        df.where(quoted(key).isNotNull() & quoted(value).isNotNull())
        .withColumn(_ROW, F.monotonically_increasing_id())  # parts rows of one value
        .repartitionByRange(-(-n_rows // (_PART_BLOCKS * _BLOCK_ROWS)), *order)
        .sortWithinPartitions(*order)
        .withColumn(_BLOCK, F.expr(f"monotonically_increasing_id() div {_BLOCK_ROWS}"))
        .drop(_ROW)
    )
    path = new_scratch_path(df.sparkSession, label)
    placed.write.parquet(path)
    return df.sparkSession.read.schema(placed.schema).parquet(path)


def _blocks(df: DataFrame, key: str, number: str, bound: Column) -> DataFrame:
    return df.groupBy(quoted(key).alias("key"), F.col(_BLOCK).alias(number)).agg(bound)


def _dealt(df: DataFrame, key: str, tiles: DataFrame, number: str, pairs: int, tasks: int) -> DataFrame:
    """The rows once for each tile of their block, the tile's number in place of the key."""
    tiles = tiles.select(F.col("key").alias(_KEY), F.col(number).alias(_BLOCK), _TILE)
    df = df.repartition(-(-pairs // (_BLOCK_ROWS * _DEALT_ROWS)), quoted(key), F.col(_BLOCK))
    rows = df.join(tiles, (quoted(key) == F.col(_KEY)) & (df[_BLOCK] == tiles[_BLOCK]))
    kept = [F.col(_TILE).alias(key) if c == key else quoted(c) for c in df.columns if c != _BLOCK]
    return rows.select(kept).repartition(tasks, quoted(key))


def dealt_by_pairs(
    less: DataFrame, less_key: str, less_value: str, more: DataFrame, more_key: str, more_value: str
) -> tuple[DataFrame, DataFrame]:
    """Both sides of an inner join on few keys with many rows, where ``more_value`` > ``less_value`` too.

    Rows of a key with neighbouring values form a block. Two blocks that can hold a pair are a tile, whose rows meet in
    one task; a task gets about _TASK_PAIRS pairs. The tile's number takes the key's place, so the join may compare the
    keys but not return them. Rows of a tile meet the same few rows in the same order, which column files hold in few
    bytes. A join with no more pairs than one task compares is left as it is.
    """
    ours = more.groupBy(quoted(more_key).alias("key")).agg(F.count(F.lit(1)).alias("ours"))
    theirs = less.groupBy(quoted(less_key).alias("key")).agg(F.count(F.lit(1)).alias("theirs"))
    # one row comes to the driver
    pairs, n_more, n_less = (
        ours.join(theirs, "key").agg(F.sum(F.col("ours") * F.col("theirs")), F.sum("ours"), F.sum("theirs")).first()
    )
    tasks = -(-(pairs or 0) // _TASK_PAIRS)
    if tasks <= 1:
        return less, more
    less = _in_blocks(less, less_key, less_value, n_less, "less")
    more = _in_blocks(more, more_key, more_value, n_more, "more")
    lower = _blocks(less, less_key, "lower", F.min(quoted(less_value)).alias("least"))
    upper = _blocks(more, more_key, "upper", F.max(quoted(more_value)).alias("most"))
    tiles = lower.join(upper, "key").where("most > least")
    tiles = tiles.select("key", "lower", "upper", F.monotonically_increasing_id().alias(_TILE))
    path = new_scratch_path(less.sparkSession, "tiles")
    tiles.write.parquet(path)
    tiles = less.sparkSession.read.schema(tiles.schema).parquet(path)
    return (
        _dealt(less, less_key, tiles, "lower", pairs, tasks),
        _dealt(more, more_key, tiles, "upper", pairs, tasks),
    )
