"""Periodic runs of words, found with an enhanced suffix array.

Each text has a suffix array of its word numbers, the inverse of it and the array of longest
common prefixes. A square ``vv`` that the next word breaks is a branching tandem: its suffix and
the one ``|v|`` words later lie in the same interval of common prefixes of depth ``|v|``, in
different children of it. So for each interval the suffixes of all children but the largest are
tested: is the suffix ``depth`` words after, or before, in the interval too, and in another child?
The suffixes tested are at most ``n log n``. A tandem is rotated to the left as far as its words
agree, which gives the run it ends; runs over the same words have one period, the least.

Texts of a slice are worked on together by whole-array steps. A suffix never meets one of another
text, since the text is the first thing that suffixes are sorted by. No tree is built.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textlab.llm.common import words
from textlab.llm.textarrays import chunks

#: A run has at least LEAST_WORDS words and LEAST_TIMES times its period.
LEAST_WORDS, LEAST_TIMES = 6, 4
#: Suffixes of intervals that are tested at a time.
TESTED = 1_000_000


class SuffixArrays:
    """Suffix array, its inverse and the ranks by doubled prefixes of several texts at once.

    ``suffixes`` are places of words in the order of the suffixes that begin there, text by text,
    and ``inverse`` says where each place is among them. ``levels[k]`` ranks the places by their
    2 ** k words; two places have the same rank only if these words are equal, all there and of the
    same text. ``begin`` and ``end`` are the bounds of the text of each place.
    """

    def __init__(self, numbers: np.ndarray, first: np.ndarray):
        n = self.n = len(numbers)
        text = np.repeat(np.arange(len(first) - 1), np.diff(first))
        self.begin, self.end = first[:-1][text], first[1:][text]
        key = text * (int(numbers.max(initial=0)) + 1) + numbers
        order = np.argsort(key)
        new = np.ones(n, bool)
        new[1:] = key[order[1:]] != key[order[:-1]]
        rank = np.empty(n, np.int32)
        # A rank is the place in the order of the first suffix that has it.
        rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
        self.levels = [rank]
        unsorted = np.flatnonzero(~(new & np.r_[new[1:], True]))
        length = 1
        # Only suffixes that share their rank with another are sorted further.
        while len(unsorted):
            places = order[unsorted]
            after = places + length
            following = np.where(after < self.end[places], rank[np.minimum(after, n - 1)], -1)
            group = rank[places].astype(np.int64)
            by = np.argsort(group * (n + 1) + following + 1)
            places, group, following = places[by], group[by], following[by]
            order[unsorted] = places
            new = np.ones(len(places), bool)
            new[1:] = (group[1:] != group[:-1]) | (following[1:] != following[:-1])
            rank = rank.copy()
            rank[places] = np.maximum.accumulate(np.where(new, unsorted, 0))
            self.levels.append(rank)
            unsorted = unsorted[~(new & np.r_[new[1:], True])]
            length *= 2
        self.suffixes, self.inverse = order, rank

    def common_after(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Words that the suffixes at ``a`` and ``b`` begin with both."""
        out = np.zeros(len(a), np.int64)
        live = np.flatnonzero(self.levels[0][a] == self.levels[0][b]) if len(a) else out
        at_a, at_b = a[live], b[live]
        end_a, end_b = self.end[at_a], self.end[at_b]
        found = np.zeros(len(live), np.int64)
        for k in range(len(self.levels) - 1, -1, -1):
            rank = self.levels[k]
            inside = (at_a < end_a) & (at_b < end_b)
            same = rank[np.minimum(at_a, self.n - 1)] == rank[np.minimum(at_b, self.n - 1)]
            step = (inside & same).astype(np.int64) << k
            found += step
            at_a, at_b = at_a + step, at_b + step
        out[live] = found
        return out

    def common_before(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Words that end right before ``a`` and before ``b`` in the same sequence, ``a`` < ``b``."""
        found, begin, a, b = np.zeros(len(a), np.int64), self.begin[a] if len(a) else a, a.copy(), b.copy()
        for k in range(len(self.levels) - 1, -1, -1):
            left, rank = 1 << k, self.levels[k]
            inside = a - left >= begin
            same = rank[np.maximum(a - left, 0)] == rank[np.maximum(b - left, 0)]
            step = (inside & same).astype(np.int64) << k
            found += step
            a, b = a - step, b - step
        return found


#: Rounds in which pointers to smaller values jump, before the rest is searched by halving.
JUMPS = 12


def last_before(values: np.ndarray, strict: bool) -> np.ndarray:
    """For each place the last one before it with a smaller (or else no larger) value.

    ``values[0]`` is below all others; its own result is 0.
    """
    n = len(values)
    out = np.maximum(np.arange(n) - 1, 0)
    beats = (lambda x, y: x < y) if strict else (lambda x, y: x <= y)
    live = np.flatnonzero(~beats(values[out], values))
    live = live[live > 0]
    for _ in range(JUMPS):
        if not len(live):
            return out
        out[live] = out[out[live]]
        live = live[~beats(values[out[live]], values[live])]
    if len(live):
        least = [values]
        while 2 << (len(least) - 1) <= n:
            half, below = 1 << (len(least) - 1), least[-1]
            # least[k][i] is the least of the 2 ** k values up to i.
            least.append(np.r_[below[:half], np.minimum(below[half:], below[:-half])])
        at, wanted = out[live], values[live]
        for k in range(len(least) - 1, -1, -1):
            at = np.where((at + 1 >= 1 << k) & ~beats(least[k][at], wanted), at - (1 << k), at)
        out[live] = at
    return out


def tandems(arrays: SuffixArrays):
    """Places and periods of the branching tandems, in parts; some come twice."""
    n, sa, isa = arrays.n, arrays.suffixes, arrays.inverse
    if n < 2:
        return
    depth = np.full(n + 1, -1, np.int64)
    depth[1:n] = arrays.common_after(sa[:-1], sa[1:])
    before = last_before(depth, strict=False)
    # The next smaller value is the last one before in the reversed array, without the last -1.
    turned = np.r_[-1, depth[1:][::-1]]
    after = (n + 1 - last_before(turned, strict=True))[::-1][:-1]
    after = np.r_[n, after]
    split = np.flatnonzero(depth > 0)
    if not len(split):
        return
    # Places of equal depth in one interval cut it into children; the first of them stands for it.
    head = np.arange(n + 1)
    inner = split[depth[before[split]] == depth[split]]
    head[inner] = before[inner]
    while True:
        further = head[head[inner]]
        inner = inner[further != head[inner]]
        if not len(inner):
            break
        head[inner] = head[head[inner]]
    mine = head[split]
    final = np.zeros(n + 1, np.int64)
    final[mine] = split
    heads = np.flatnonzero(final)
    first = np.r_[before[split], final[heads]]
    past = np.r_[split, after[heads]]
    owner = np.r_[mine, heads]
    size = past - first
    largest = np.zeros(n + 1, np.int64)
    np.maximum.at(largest, owner, size)
    among = np.flatnonzero(size == largest[owner])
    left_out = np.zeros(n + 1, np.int64)
    left_out[owner[among]] = among
    small = np.flatnonzero(left_out[owner] != np.arange(len(owner)))
    first, past, owner, size = first[small], past[small], owner[small], size[small]
    low, high, deep = before[owner], after[owner], depth[owner]
    cuts = np.flatnonzero(np.diff(np.cumsum(size) // TESTED, prepend=-1))
    for a, b in zip(cuts, [*cuts[1:], len(size)]):
        child = np.repeat(np.arange(a, b), size[a:b])
        inside = np.arange(len(child)) - np.repeat(np.cumsum(size[a:b]) - size[a:b], size[a:b])
        place = sa[first[child] + inside]
        d = deep[child]
        for other, begins in ((place + d, place), (place - d, place - d)):
            there = (other >= arrays.begin[place]) & (other < arrays.end[place])
            at = isa[np.clip(other, 0, n - 1)]
            found = there & (at >= low[child]) & (at < high[child]) & ((at < first[child]) | (at >= past[child]))
            yield begins[found], d[found]


def runs_of(numbers: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and period of the runs of texts given by their word numbers; starts count from
    the first word of all, and runs are in the order of start, then period."""
    arrays = SuffixArrays(numbers, first)
    found = list(tandems(arrays))
    place = np.concatenate([p for p, _ in found]) if found else np.empty(0, np.int64)
    period = np.concatenate([d for _, d in found]) if found else np.empty(0, np.int64)
    start = place - arrays.common_before(place, place + period)
    end = place + 2 * period
    long = end - start >= np.maximum(LEAST_WORDS, LEAST_TIMES * period)
    start, end, period = start[long], end[long], period[long]
    # Runs of the same words have the same least period, the first in this order.
    by = np.lexsort((period, end, start))
    start, end, period = start[by], end[by], period[by]
    new = np.ones(len(start), bool)
    new[1:] = (start[1:] != start[:-1]) | (end[1:] != end[:-1])
    start, end, period = start[new], end[new], period[new]
    by = np.lexsort((period, start))
    return start[by], end[by], period[by]


SPAN = T.StructType([T.StructField(name, T.LongType()) for name in ("start", "length", "period")])


def with_runs(df: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``df``, or its columns named in ``keep``, with ``runs`` of the words of the texts and the
    ``collapsed`` text; columns of these names are replaced.

    A run is a stretch of words with a least period, LEAST_WORDS words and LEAST_TIMES periods long
    at least, that no word on either side goes on with. Runs are in the order of start, then
    period. The collapsed text has the words, joined by one blank, that no run covers after its
    first period. Null, empty and blank texts have no runs and collapse to the empty text. Repeated
    rows are treated alike; an empty table gives no rows.
    """
    kept = [c for c in (df.columns if keep is None else keep) if c not in ("runs", "collapsed")]
    packed = df.select(F.struct(*kept).alias("row"), F.col(text).cast("string").alias("text"))
    schema = T.StructType(
        [packed.schema["row"], T.StructField("runs", T.ArrayType(SPAN)), T.StructField("collapsed", T.StringType())]
    )

    def find(batches):
        for batch in batches:
            for part in chunks(batch, "text"):
                yield pa.RecordBatch.from_arrays([part.column("row"), *collapsed(part.column("text"))], ["row", "runs", "collapsed"])

    return packed.mapInArrow(find, schema).select("row.*", "runs", "collapsed")


def collapsed(column: pa.Array) -> tuple[pa.Array, pa.Array]:
    """The runs of each text and the text without their repetitions."""
    split = [(t or "").encode().split() for t in column.to_pylist()]
    first = np.r_[0, np.cumsum([len(w) for w in split], dtype=np.int64)]
    numbers = pa.array([w for words in split for w in words], pa.large_binary()).dictionary_encode().indices
    start, end, period = runs_of(numbers.to_numpy(zero_copy_only=False).astype(np.int64), first)
    text = np.searchsorted(first, start, "right") - 1
    change = np.zeros(first[-1] + 1, np.int64)
    np.add.at(change, start + period, 1)
    np.add.at(change, end, -1)
    kept = np.cumsum(change)[:-1] == 0
    for k in np.unique(text):
        split[k] = [w for w, keep in zip(split[k], kept[first[k] : first[k + 1]]) if keep]
    offsets = np.searchsorted(text, np.arange(len(split) + 1)).astype(np.int32)
    spans = pa.StructArray.from_arrays([start - first[text], end - start, period], ["start", "length", "period"])
    return pa.ListArray.from_arrays(offsets, spans), pa.array([b" ".join(w).decode() for w in split], pa.string())


def looped(text: Column, id_column: Column) -> Column:
    """A text of which the words from a certain one on go in a loop, for a tenth of the ids.

    With ``h`` the CRC-32 of the id, texts with ``h % 10 = 0`` change; null ids and texts without
    words don't.
    """
    h = F.crc32(F.encode(id_column.cast("string"), "UTF-8"))
    found = words(text)

    def loop(at: Column) -> Column:
        w, n, g = at["w"], F.size(at["w"]).cast("long"), at["g"]
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8))
        heard = F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: F.when(i < a, i).otherwise(a + (i - a) % p))
        return F.array_join(F.transform(heard, lambda i: F.get(w, i.cast("int"))), " ")

    one = F.array(F.struct(found.alias("w"), F.floor(h / 10).alias("g")))
    changed = F.get(F.transform(one, lambda at: F.when(F.size(at["w"]) > 0, loop(at)).otherwise(F.lit(""))), F.lit(0))
    return F.when(h % 10 == 0, changed).otherwise(text)


def run_digests(df: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row the number of runs, the run with the most periods, and hashes of all runs and of the
    collapsed text, after the texts of a tenth of the ids are put in a loop (see ``looped``).

    The best run has the greatest exact quotient of length and period, then the least start, then
    the least period; without runs its columns are null. Null ids stay.
    """
    rows = df.select(F.col(id_col), looped(F.col(text).cast("string"), F.col(id_col)).alias("text"))
    found = with_runs(rows, keep=[id_col])

    def better(a: Column, b: Column) -> Column:
        left, right = a["length"] * b["period"], b["length"] * a["period"]
        return (
            F.when(left != right, F.when(left > right, -1).otherwise(1))
            .when(a["start"] != b["start"], F.when(a["start"] < b["start"], -1).otherwise(1))
            .otherwise(F.when(a["period"] < b["period"], -1).when(a["period"] > b["period"], 1).otherwise(0))
        )

    best = F.get(F.array_sort("runs", better), F.lit(0))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return found.withColumn("best", best).select(
        id_col,
        F.size("runs").cast("long").alias("n_runs"),
        F.col("best.start").alias("start"),
        F.col("best.length").alias("length"),
        F.col("best.period").alias("period"),
        F.floor(F.col("best.length") * 1000 / F.col("best.period")).cast("long").alias("exponent_milli"),
        F.sha2(F.encode(F.array_join(lines, ""), "UTF-8"), 256).alias("runs_sha256"),
        F.sha2(F.encode("collapsed", "UTF-8"), 256).alias("collapsed_sha256"),
    )
