"""Rows of a group against other rows of the same group, in blocks: how tables of pairs are scored without holding or writing them.

One side, the *held* one, is cut into blocks of a bounded number of rows, whatever a group's size; each row of the other side, the *streamed* one, goes to
every block of its group and passes by there in batches. So a task's memory is one block and one batch, a hot group is many tasks, and
nothing goes through the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..tables import written


def dealt(held: DataFrame, streamed: DataFrame, group: str, by: str, size: int, beside: DataFrame | None = None) -> DataFrame:
    """Rows of both sides with ``block`` and ``side`` (0: held), dealt out by group and block and sorted by side. ``by`` spreads the held rows over the
    blocks of their group; each side has null in the columns of the other. Rows ``beside`` go with the held ones of their ``by``, more columns of which they
    have."""
    # a row a group, written so that the planner knows how small it is and leaves the held rows where they are
    blocks = written(held.groupBy(group).agg(F.ceil(F.count("*") / size).cast("int").alias("_blocks")), "blocks")
    held = held if beside is None else held.unionByName(beside, allowMissingColumns=True)
    own = held.join(blocks, group).withColumn("block", F.expr(f"CAST(pmod(xxhash64({by}), _blocks) AS INT)")).withColumn("side", F.lit(0)).drop("_blocks")
    others = streamed.join(blocks, group).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1))).withColumn("side", F.lit(1)).drop("_blocks")
    rows = own.unionByName(others, allowMissingColumns=True)
    return rows.repartition(group, "block").sortWithinPartitions(group, "block", "side")


def block_by_block(batches, group: str, hold: Callable, match: Callable, most: int) -> Iterator[pa.RecordBatch]:
    """Runs over sorted batches of ``dealt`` rows: ``hold`` makes an object of the held rows of a block (a table), ``match`` record batches of that object
    and up to ``most`` streamed rows."""
    now, parts, held = None, [], None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        keys = list(zip(table.column(group).to_pylist(), table.column("block").to_pylist(), table.column("side").to_pylist()))
        starts = [k for k in range(len(keys)) if k == 0 or keys[k] != keys[k - 1]]
        for start, end in zip(starts, [*starts[1:], len(keys)]):
            kb, block, side = keys[start]
            if (kb, block) != now:
                now, parts, held = (kb, block), [], None
            piece = table.slice(start, end - start)
            if side == 0:
                parts.append(piece)
                continue
            if held is None and not parts:
                continue  # no held rows came to this block
            if held is None:
                held, parts = hold(pa.concat_tables(parts).combine_chunks()), []
            if held is None:
                continue
            for at in range(0, len(piece), most):
                yield from match(held, piece.slice(at, most).combine_chunks())


def vectors_of(column: pa.ChunkedArray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By number of dimensions: positions of the vectors that have it, and these as rows of unit length (zero vectors stay zero rows, so that their
    cosine is 0). Null and empty vectors are left out."""
    lists = column.combine_chunks()
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) and lists.num_chunks else lists
    if not len(lists):
        return {}
    sizes = np.nan_to_num(lists.value_lengths().to_numpy(zero_copy_only=False).astype(float)).astype(np.int64)
    values = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    ends = np.cumsum(sizes)
    out = {}
    for d in np.unique(sizes[sizes > 0]).tolist():
        at = np.flatnonzero(sizes == d)
        rows = values[(ends[at] - d)[:, None] + np.arange(d)] if len(out) or (sizes != d).any() else values.reshape(-1, d)
        norm = np.sqrt((rows * rows).sum(axis=1, keepdims=True))
        out[d] = at, np.divide(rows, norm, out=np.zeros_like(rows), where=norm > 0)
    return out


def cosines(held: dict, streamed: dict, shape: tuple[int, int]) -> np.ndarray:
    """(held, streamed) cosines of two results of ``vectors_of``; 0 where dimensions differ."""
    out = np.zeros(shape)
    for d, (at, rows) in streamed.items():
        if d in held:
            out[np.ix_(held[d][0], at)] = held[d][1] @ rows.T
    return out
