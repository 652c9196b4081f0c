"""The adjacency of a graph as arrays in the shared folder, so that a pass over all edges reads files and shuffles nothing.

Nodes are numbered from 0 to n - 1. Row r of the adjacency (the numbers of the nodes that r hears from) lies in block
r % parts, as its row r // parts; a block holds its rows that aren't empty, where each starts, and their columns."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.tables import opened, read_array, write_array

#: Nodes a block has at most, where there are more blocks than four a core.
MOST = 200_000


def parts_for(spark: SparkSession, n: int) -> int:
    return max(1, min(n, max(4 * spark.sparkContext.defaultParallelism, -(-n // MOST))))


def over(spark: SparkSession, parts: int) -> DataFrame:
    """A row `id` per block, in as many tasks as there are cores."""
    return spark.range(0, parts, 1, max(1, min(parts, spark.sparkContext.defaultParallelism)))


def write_nodes(nodes: DataFrame, folder: str) -> int:
    """Writes the columns of nodes (id, ...; numbers, ids distinct) as arrays in the order of the ids; returns n."""
    names = nodes.columns

    def run(batches):
        import numpy as np
        import pyarrow as pa

        held = list(batches)
        cols = {c: np.concatenate([b.column(i).to_numpy(zero_copy_only=False) for b in held]) if held else np.zeros(0) for i, c in enumerate(names)}
        order = np.argsort(cols["id"], kind="stable")
        for c in names:
            write_array(f"{folder}/{c}", cols[c][order])
        yield pa.RecordBatch.from_pydict({"n": [len(order)]})

    return sum(r["n"] for r in nodes.where("id is not null").repartition(1).mapInArrow(run, "n long").collect())


def _finder(ids):
    """A function from ids to (positions in ids, whether they are there)."""
    import numpy as np

    n, first = len(ids), ids[0]
    if ids[-1] - first + 1 == n:
        return lambda x: (np.clip(x - first, 0, n - 1), (x >= first) & (x < first + n))

    def found(x):
        at = np.minimum(np.searchsorted(ids, x), n - 1)
        return at, ids[at] == x

    return found


def write_adjacency(edges: DataFrame, folder: str, n: int, parts: int, both: bool = False, numbered: bool = False) -> int:
    """Writes edges (source_id, target_id) by target, or by either end if both; edges between unknown nodes fall away.

    The rows of a block are cut, parallel edges become one; how often each column came goes to folder/deg. numbered: nodes
    have a column place, else their number is that of the id in order. Returns the number of different edges."""

    def keyed(batches):
        import numpy as np
        import pyarrow as pa

        found = _finder(read_array(f"{folder}/id", "i8"))
        place = read_array(f"{folder}/place", "i8") if numbered else None
        for b in batches:
            (s, ok), (t, ok2) = (found(b.column(i).to_numpy(zero_copy_only=False)) for i in (0, 1))
            s, t = s[ok & ok2], t[ok & ok2]
            if place is not None:
                s, t = place[s], place[t]
            for row, col in ((t, s), (s, t)) if both else ((t, s),):
                yield pa.RecordBatch.from_arrays([pa.array((row % parts).astype(np.int32)), pa.array(row // parts * n + col)], names=["b", "key"])

    def pack(batches):
        import numpy as np
        import pyarrow as pa

        held = {}
        for batch in batches:
            bs, keys = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for b in np.unique(bs).tolist():
                held.setdefault(b, []).append(keys[bs == b] if bs[0] != bs[-1] or bs.min() != bs.max() else keys)
        sizes = []
        for b in list(held):
            keys, times = np.unique(np.concatenate(held.pop(b)), return_counts=True)
            rows, cols = keys // n, keys % n
            start = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]])
            write_array(f"{folder}/rows/{b}", rows[start])
            write_array(f"{folder}/start/{b}", start)
            write_array(f"{folder}/cols/{b}", cols.astype(np.int32))
            order = np.lexsort((cols, cols % parts))
            cols, times = cols[order], times[order]
            first = np.flatnonzero(np.r_[True, cols[1:] != cols[:-1]])
            cols, times = cols[first], np.add.reduceat(times, first)
            bounds = np.searchsorted(cols % parts, np.arange(parts + 1))
            write_array(f"{folder}/deg/{b}", np.r_[bounds, np.stack([cols, times], 1).ravel()])
            sizes.append(len(keys))
        yield pa.RecordBatch.from_pydict({"m": sizes}, schema=pa.schema([("m", pa.int64())]))

    pairs = edges.select("source_id", "target_id").where("source_id is not null and target_id is not null").mapInArrow(keyed, "b int, key long")
    sizes = pairs.repartitionById(parts, "b").mapInArrow(pack, "m long").collect()  # a row per block that isn't empty
    return sum(r["m"] for r in sizes)


def there(folder: str, name: str) -> set:
    """Numbers of the blocks that have an array of this name."""
    from pyarrow import fs

    at, path = opened(f"{folder}/{name}")
    return {int(f.base_name) for f in at.get_file_info(fs.FileSelector(path, allow_not_found=True)) if f.base_name.isdigit()}


def block(folder: str, b: int):
    """(rows, start, cols) of a block that isn't empty."""
    return read_array(f"{folder}/rows/{b}", "i8"), read_array(f"{folder}/start/{b}", "i8"), read_array(f"{folder}/cols/{b}", "i4")


def out_degrees(folder: str, n: int, parts: int, b: int, blocks: set):
    """How often each node of block b is a column, repeats counted."""
    import numpy as np

    out = np.zeros(len(range(b, n, parts)))
    for other in blocks:
        lo, hi = read_array(f"{folder}/deg/{other}", "i8", b, 2)
        got = read_array(f"{folder}/deg/{other}", "i8", parts + 1 + 2 * int(lo), 2 * int(hi - lo)).reshape(-1, 2)
        out[got[:, 0] // parts] += got[:, 1]
    return out


def gathered(folder: str, name: str, n: int, parts: int):
    """The array whose places b, b + parts, ... lie in folder/name/b."""
    import numpy as np

    out = np.empty(n)
    for b in range(parts):
        out[b::parts] = read_array(f"{folder}/{name}/{b}", "f8")
    return out


def drop(folder: str, name: str) -> None:
    at, path = opened(f"{folder}/{name}")
    at.delete_dir(path)
