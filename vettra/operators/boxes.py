"""Areas and cells of boxes, many groups at a time in numpy; what is held at once is bounded, however many boxes a group has."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa

#: Intervals, or cells, that are held at a time.
HELD = 2_000_000


def flat(column: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(row, corners): the boxes (x0, y0, x1, y1) in a column of arrays of structs, with the rows they stand in; boxes without area or with nulls are left out."""
    rows, corners = [np.zeros(0, np.int64)], [np.zeros((0, 4))]
    at = 0
    for part in column.chunks if isinstance(column, pa.ChunkedArray) else [column]:
        boxes = part.flatten()  # without the items of null arrays
        corners.append(np.column_stack([np.asarray(c.cast(pa.float64()).to_numpy(zero_copy_only=False)) for c in boxes.flatten()]) if len(boxes) else np.zeros((0, 4)))
        rows.append(np.repeat(np.arange(at, at + len(part)), part.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)))
        at += len(part)
    row, box = np.concatenate(rows), np.concatenate(corners)
    fine = (box[:, 0] < box[:, 2]) & (box[:, 1] < box[:, 3])
    return row[fine], box[fine]


def spread(first: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(item, value): for each item i the values first[i], first[i] + 1 and so on, counts[i] of them."""
    item = np.repeat(np.arange(len(counts)), counts)
    return item, np.arange(len(item)) - np.repeat(np.cumsum(counts) - counts, counts) + first[item]


def union_areas(row: np.ndarray, box: np.ndarray, n: int, held: int = HELD) -> np.ndarray:
    """The area that the boxes of each row 0 to n - 1 cover together: slabs between their x edges, each with the union of its y intervals."""
    area = np.zeros(n)
    if not len(row):
        return area
    x, group = np.concatenate([box[:, 0], box[:, 2]]), np.concatenate([row, row])
    order = np.lexsort((x, group))
    new = np.ones(len(order), bool)
    new[1:] = (group[order][1:] != group[order][:-1]) | (x[order][1:] != x[order][:-1])
    rank = np.empty(len(order), np.int64)
    rank[order] = np.cumsum(new) - 1
    first, last = rank[: len(row)], rank[len(row) :]
    edge, owner = x[order][new], group[order][new]
    levels, top = np.unique(box[:, 3], return_inverse=True)
    covers = np.cumsum(np.bincount(first, minlength=len(edge)) - np.bincount(last, minlength=len(edge)))  # boxes over each slab
    cuts = np.unique(np.searchsorted(np.cumsum(covers), np.arange(0, covers.sum() + held, held), side="left"))
    for lo, hi in zip(np.concatenate([[0], cuts[cuts > 0]]), np.concatenate([cuts[cuts > 0], [len(edge)]])):
        inside = np.flatnonzero((first < hi) & (last > lo))
        start = np.maximum(first[inside], lo)
        item, slab = spread(start, np.minimum(last[inside], hi) - start)
        if not len(item):
            continue
        item = inside[item]
        place = np.lexsort((box[item, 1], slab))
        item, slab = item[place], slab[place]
        ends = levels[np.maximum.accumulate(slab * len(levels) + top[item]) - slab * len(levels)]  # the highest end so far in the slab
        low = box[item, 1].copy()
        again = np.flatnonzero(slab[1:] == slab[:-1]) + 1
        low[again] = np.maximum(low[again], ends[again - 1])
        height = np.bincount(slab - lo, np.maximum(0.0, box[item, 3] - low), hi - lo)
        width = np.diff(edge, append=edge[-1])[lo:hi]
        some = np.flatnonzero(height)
        area += np.bincount(owner[lo:hi][some], (height * width)[some], n)
    return area


def cells(row: np.ndarray, box: np.ndarray, code: Callable, held: int = HELD) -> Iterator[np.ndarray]:
    """The codes of the cells (row, x, y) under the boxes, a few boxes at a time."""
    x, y = box[:, 0].astype(np.int64), box[:, 1].astype(np.int64)
    width, height = box[:, 2].astype(np.int64) - x, box[:, 3].astype(np.int64) - y
    part = np.cumsum(width * height) // held
    for own in np.split(np.arange(len(row)), np.flatnonzero(np.diff(part)) + 1):
        item, i = spread(np.zeros(len(own), np.int64), (width * height)[own])
        item = own[item]
        yield code(row[item], x[item] + i // height[item], y[item] + i % height[item])


def shared_cells(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], n: int, held: int = HELD) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(lo, hi, shared, all): for the rows lo to hi, a few rows at a time, how many cells lie under boxes of both sides and of either."""
    size = np.zeros(n)
    for row, box in (a, b):
        size += np.bincount(row, (box[:, 2] - box[:, 0]) * (box[:, 3] - box[:, 1]), n)
    cuts = np.flatnonzero(np.diff(np.cumsum(size) // held)) + 1
    for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), n]):
        (r, p), (s, q) = (tuple(v[(row >= lo) & (row < hi)] for v in (row, box)) for row, box in (a, b))
        every = np.concatenate([p, q])
        if not len(every):
            yield lo, hi, np.zeros(hi - lo, np.int64), np.zeros(hi - lo, np.int64)
            continue
        x0, y0, x1, y1 = int(every[:, 0].min()), int(every[:, 1].min()), int(every[:, 2].max()), int(every[:, 3].max())
        w, h = x1 - x0, y1 - y0
        code = lambda row, x, y: ((row - lo) * w + x - x0) * h + y - y0  # noqa: B023, E731
        if (hi - lo) * w * h <= 16 * held:  # a mask for each row and side
            one, other = np.zeros((2, (hi - lo) * w * h), bool)
            for mask, side in ((one, (r, p)), (other, (s, q))):
                for found in cells(*side, code, held):
                    mask[found] = True
            both, either = ((m.reshape(hi - lo, w * h)).sum(axis=1) for m in (one & other, one | other))
        else:  # boxes far apart: sets of cells
            one, other = (reduce(np.union1d, cells(*side, code, held), np.zeros(0, np.int64)) for side in ((r, p), (s, q)))
            count = lambda codes: np.bincount(codes // (w * h), minlength=hi - lo)  # noqa: B023, E731
            both = count(np.intersect1d(one, other, assume_unique=True))
            either = count(one) + count(other) - both
        yield lo, hi, both, either
