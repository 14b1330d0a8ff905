"""Best-fit packing into sequences of several permitted lengths.

Texts longer than the largest length are cut into pieces of that length and a rest. Pieces are placed longest first: each
goes to the open bin with the least room that still holds it. When none does, the bin size is opened that costs least for
the piece: the price of its length, less what the room left for others is worth. In the end each bin shrinks to the
shortest permitted length that holds its contents. How much of the room others will fill is not known beforehand, so a
lot is packed for several assumptions, and the packing with the least total price is taken.

Packing is a map: each task packs what it reads, in lots of bounded size, so nothing is shuffled, a hot source or a large
group of copies changes nothing, and a lost executor's bins are made again from the same rows with the same numbers. The
price is at most some half-empty bins for each lot of many thousand pieces.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.shared import PORTION

# Parameters: permitted sequence lengths in tokens, pieces packed together, fixed price of a sequence in tokens.
LENGTHS = (256, 512, 1024, 2048, 4096)
LOT = 100_000
OVERHEAD = 16.0
#: Assumed shares of the room left in a new bin that other pieces fill.
FILLED = (1.0, 0.97, 0.9, 0.5)

ROWS = "doc_id {id_type}, piece int, first long, n_tokens int, bin_id long, bin_length int, bin_offset int"
KINDS = (pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int32())
#: Bins are numbered from partition x this, lot after lot.
BINS_PER_TASK = 1 << 36


def word_count(text: Column) -> Column:
    """Tokens as runs of anything but ASCII white space; none for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^ \t\n\x0B\f\r]+")), F.lit(0))


def token_price(length: int) -> float:
    """The price of a sequence: its tokens, and a fixed part."""
    return length + OVERHEAD


def opened_for(size: int, lengths: Sequence[int], price: Callable[[int], float], filled: float) -> int:
    """The permitted length that costs least for a piece: its price less what the room that others will fill is worth.

    Room is worth the best price per token of any length; filled is the share of the room expected to be used.
    """
    worth = min(price(c) / c for c in lengths)
    fitting = [c for c in lengths if c >= size]
    return min(fitting, key=lambda c: (price(c) - filled * worth * (c - size), c))


def pack(
    sizes: Sequence[int], lengths: Sequence[int], price: Callable[[int], float] = token_price, filled: float = 1.0
) -> tuple[list[int], list[int], list[int]]:
    """(bin of each piece, its offset there, length of each bin) for pieces of 1 to max(lengths) tokens."""
    lengths = sorted(lengths)
    bins, offsets = [0] * len(sizes), [0] * len(sizes)
    used: list[int] = []
    rooms: list[int] = []  # the different rooms of open bins, ascending
    holding: dict[int, list[int]] = {}  # bins by room
    opened: dict[int, int] = {}
    capacity: list[int] = []
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        size = sizes[i]
        at = bisect_left(rooms, size)
        if at < len(rooms):
            room = rooms[at]
            own = holding[room].pop()
            if not holding[room]:
                del holding[room], rooms[at]
        else:
            if size not in opened:
                opened[size] = opened_for(size, lengths, price, filled)
            own = len(used)
            used.append(0)
            capacity.append(opened[size])
        bins[i], offsets[i] = own, used[own]
        used[own] += size
        room = capacity[own] - used[own]
        if room:
            if room not in holding:
                holding[room] = []
                insort(rooms, room)
            holding[room].append(own)
    return bins, offsets, [lengths[bisect_left(lengths, n)] for n in used]


def packed(
    docs: DataFrame,
    n_tokens: Column | None = None,
    id_col: str = "doc_id",
    lengths: Sequence[int] = LENGTHS,
    lot: int = LOT,
    price: Callable[[int], float] = token_price,
    start: Callable[[], Callable[[list], list]] | None = None,
) -> DataFrame:
    """One row per piece: doc_id, piece (from 0), first (the piece's first token), n_tokens, bin_id, bin_length, bin_offset.

    n_tokens: tokens of a row, the words of `text` unless given. start: counts the tokens of `text` instead, as over_texts
    has it, in the worker that packs them; a column that is computed in Python takes a second worker in every task. A row without tokens (null, empty or blank text, or a
    count below 1) gives one row with n_tokens 0 and no bin. A very long text takes as many pieces as it needs. Repeated
    rows are packed as often as they come, rows without an id too. Equally long pieces keep the order of the input, and of
    bins with equal room the one filled last is taken. Other columns are ignored. bin_id is unique over the result.
    """
    lengths = sorted(set(lengths))
    longest = lengths[-1]
    if start is not None:
        counted = F.col("text")
    else:
        counted = F.coalesce((word_count(F.col("text")) if n_tokens is None else n_tokens).cast("long"), F.lit(0))
    rows = docs.select(F.col(id_col).alias("doc_id"), counted.alias("n"))

    def in_lots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        next_bin = (context.partitionId() if context else 0) * BINS_PER_TASK
        count = start() if start is not None else lambda numbers: numbers
        waiting: list[tuple] = []
        for batch in batches:
            kind = batch.schema.field(0).type
            for at in range(0, batch.num_rows, PORTION):
                ids, counts = (c.slice(at, PORTION).to_pylist() for c in batch.columns)
                empty: list[tuple] = []
                for doc_id, n in zip(ids, count(counts), strict=True):
                    if n <= 0:
                        empty.append((doc_id, 0, 0, 0, None, None, None))
                    for piece, first in enumerate(range(0, n, longest)):
                        waiting.append((doc_id, piece, first, min(longest, n - first)))
                        if len(waiting) == lot:
                            packing, next_bin = _lot(waiting, lengths, price, next_bin)
                            waiting = []
                            yield _rows(packing, kind)
                if empty:
                    yield _rows(empty, kind)
            pa.default_memory_pool().release_unused()
        if waiting:
            yield _rows(_lot(waiting, lengths, price, next_bin)[0], kind)

    return rows.mapInArrow(in_lots, ROWS.format(id_type=rows.schema["doc_id"].dataType.simpleString()))


def cheapest(sizes: Sequence[int], lengths: Sequence[int], price: Callable[[int], float] = token_price):
    """The packing with the least total price over the assumptions, the first of equal ones."""
    tried = [pack(sizes, lengths, price, filled) for filled in FILLED]
    return min(tried, key=lambda packing: sum(map(price, packing[2])))


def _lot(pieces: list[tuple], lengths: Sequence[int], price: Callable, next_bin: int) -> tuple[list[tuple], int]:
    bins, offsets, bin_lengths = cheapest([p[3] for p in pieces], lengths, price)
    placed = zip(pieces, bins, offsets, strict=True)
    return [(*p, next_bin + b, bin_lengths[b], o) for p, b, o in placed], next_bin + len(bin_lengths)


def _rows(rows: list[tuple], id_kind: pa.DataType) -> pa.RecordBatch:
    names = ["doc_id", "piece", "first", "n_tokens", "bin_id", "bin_length", "bin_offset"]
    columns = zip(zip(*rows, strict=True), (id_kind, *KINDS), strict=True)
    return pa.record_batch([pa.array(values, kind) for values, kind in columns], names)


def sequences(packed_rows: DataFrame) -> DataFrame:
    """One row per bin: bin_id, bin_length, n_tokens, n_pieces."""
    return (
        packed_rows.where("bin_id is not null")
        .groupBy("bin_id", "bin_length")
        .agg(F.sum("n_tokens").alias("n_tokens"), F.count("*").alias("n_pieces"))
    )
