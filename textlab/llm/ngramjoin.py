"""N-gram Jaccard join: a size-aware join with a heavy and a light side.

Documents are sets of word shingles, and two of them link at a Jaccard similarity of
``share`` or more. Sets of at most ``boundary`` shingles are light: each enumerates its subsets of
the size that a partner must share, and sets that meet in a subset link. Larger sets are heavy:
inverted lists of their rarest shingles are scanned for candidates, which are then counted out.
The boundary is where the counted cost of both ways is least.

Before that, two steps leave out most sets. Equal sets become one class. And a set of which too
few shingles occur in any other set can't have a partner; this takes one shuffle of shortened
hashes, in which a task sends every shingle once, however often it occurs.
"""

from __future__ import annotations

from fractions import Fraction
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from textlab.llm.common import partitions, stored
from textlab.llm.components import components
from textlab.llm.textarrays import MIX, Words, chunks, give_back, mixed

#: Bits of a hash that are sent to find out whether a shingle occurs elsewhere. Chance meetings
#: only keep a set that could have been left out.
SENT_BITS = 40
#: Largest boundary that is considered, and rounds in which only the heads of lists are compared.
MOST_BOUNDARY, HEAD_ROUNDS = 32, 2
NO_ID = -(2**63)


def least_overlap(n, r, share: Fraction):
    """Shingles that sets of n and r must share to link."""
    p, q = share.numerator, share.numerator + share.denominator
    return -((-p * (n + r)) // q)


def least_size(n, share: Fraction):
    """Least size of a partner of a set of n, and least overlap with any partner."""
    return -((-share.numerator * n) // share.denominator)


class Sets:
    """The sets of a slice of a batch: hashes sorted by value, each with its row."""

    def __init__(self, batch: pa.RecordBatch, width: int, fold: bool):
        words = Words(batch.column("text"), fold)
        hashed, at = words.runs(width)
        row = words.row[at]
        short = np.flatnonzero((words.counts > 0) & (words.counts < width))
        if len(short):
            whole = [words.hashes[words.first[i] : words.first[i + 1]] for i in short]
            lone = np.zeros(len(short), np.uint64)
            for k, w in enumerate(whole):
                value = np.array([len(w)], np.uint64)
                for x in w:
                    value = mixed(value * np.uint64(3) + x)
                lone[k] = value[0]
            hashed, row = np.r_[hashed, lone], np.r_[row, short]
        order = np.lexsort((row, hashed)) if len(short) else np.argsort(hashed, kind="stable")
        hashed, row = hashed[order], row[order]
        new = np.ones(len(hashed), bool)
        new[1:] = (hashed[1:] != hashed[:-1]) | (row[1:] != row[:-1])
        self.hashes, self.row, self.rows = hashed[new], row[new], words.rows
        self.sizes = np.bincount(self.row, minlength=self.rows)

    def signatures(self) -> tuple[np.ndarray, np.ndarray]:
        sums = []
        for k in (0, 1):
            out = np.zeros(self.rows, np.uint64)
            np.add.at(out, self.row, mixed(self.hashes ^ MIX[k]))
            sums.append(out.view(np.int64))
        return tuple(sums)

    def lists(self) -> list[bytes]:
        """Per row its hashes in their order, as bytes."""
        order = np.argsort(self.row, kind="stable")
        ends = np.cumsum(self.sizes)
        data = self.hashes[order]
        return [data[e - n : e].tobytes() for n, e in zip(self.sizes, ends)]


class Stored:
    """Sets that are columns of a table, with the same members as Sets."""

    def __init__(self, batch: pa.RecordBatch):
        lists = [np.frombuffer(x, np.uint64) for x in batch.column("tokens").to_pylist()]
        self.rows = len(lists)
        self.sizes = np.array([len(x) for x in lists], np.int64)
        hashed = np.concatenate(lists) if lists else np.empty(0, np.uint64)
        row = np.repeat(np.arange(self.rows), self.sizes)
        order = np.argsort(hashed, kind="stable")
        self.hashes, self.row = hashed[order], row[order]

    def signatures(self):
        return np.zeros(self.rows, np.int64), np.zeros(self.rows, np.int64)


HEADER = np.dtype([("id", "<i8"), ("n", "<i8"), ("s1", "<i8"), ("s2", "<i8"), ("shared", "<i8")])
SENT = "bucket int, chunk bigint, kind int, data binary"
SIZED = "id bigint, n bigint, s1 bigint, s2 bigint, shared bigint"


def sent(sets, ids: np.ndarray, chunk: int, buckets: int):
    """What a slice sends: a header with its rows, and per bucket the shingles it holds.

    A shingle of several rows is known to be shared by all of them; it goes out once, without a
    row. Values are coded as byte planes of differences, which the shuffle compresses.
    """
    tokens = sets.hashes >> np.uint64(64 - SENT_BITS)
    row = sets.row
    new = np.ones(len(tokens), bool)
    new[1:] = tokens[1:] != tokens[:-1]
    starts = np.flatnonzero(new)
    many = np.diff(np.r_[starts, len(tokens)]) > 1
    shared = np.bincount(row[np.repeat(many, np.diff(np.r_[starts, len(tokens)]))], minlength=sets.rows)
    header = np.empty(sets.rows, HEADER)
    header["id"], header["n"], header["shared"] = ids, sets.sizes, shared
    header["s1"], header["s2"] = sets.signatures()
    rows = [(-1 - chunk % buckets, chunk, 0, header.tobytes())]
    tokens, owner = tokens[starts], np.where(many, 0, row[starts] + 1).astype(np.uint32)
    bucket = tokens // np.uint64(-(-(1 << SENT_BITS) // buckets))
    cuts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]) if len(bucket) else []
    for a, b in zip(cuts, [*cuts[1:], len(tokens)]):
        steps = np.diff(tokens[a:b], prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T[: SENT_BITS // 8]
        owners = owner[a:b].view(np.uint8).reshape(-1, 4).T
        rows.append((int(bucket[a]), chunk, 1, steps.tobytes() + owners.tobytes()))
    return pa.RecordBatch.from_pylist([dict(zip(("bucket", "chunk", "kind", "data"), r)) for r in rows], SENT_SCHEMA)


SENT_SCHEMA = pa.schema([("bucket", pa.int32()), ("chunk", pa.int64()), ("kind", pa.int32()), ("data", pa.binary())])


def received(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    width = SENT_BITS // 8
    planes = np.frombuffer(data, np.uint8).reshape(width + 4, -1)
    steps = np.zeros((planes.shape[1], 8), np.uint8)
    steps[:, :width] = planes[:width].T
    return np.cumsum(steps.view(np.uint64).ravel()), np.ascontiguousarray(planes[width:].T).view(np.uint32).ravel()


def met(table: pa.Table) -> pa.Table:
    """Of one bucket: per slice how many shingles of each row came from another slice too."""
    if table["kind"][0].as_py() == 0:
        return table
    chunk = table["chunk"].to_numpy()
    parts = [received(x.as_py()) for x in table["data"]]
    tokens = np.concatenate([p[0] for p in parts])
    order = np.argsort(tokens, kind="stable")
    tokens = tokens[order]
    twice = np.zeros(len(tokens), bool)
    same = tokens[1:] == tokens[:-1]
    twice[1:] |= same
    twice[:-1] |= same
    shared = np.empty(len(tokens), bool)
    shared[order] = twice
    out, at = [], 0
    for c, (_, owner) in zip(chunk, parts):
        hits = owner[shared[at : at + len(owner)]]
        at += len(owner)
        counts = np.bincount(hits[hits > 0] - 1).astype("<u4")
        if len(counts):
            out.append((int(table["bucket"][0].as_py()), int(c), 1, counts.tobytes()))
    del parts, tokens, order, twice, shared
    give_back()
    return pa.Table.from_pylist([dict(zip(("bucket", "chunk", "kind", "data"), r)) for r in out], SENT_SCHEMA)


def summed(table: pa.Table) -> pa.Table:
    """The rows of one slice with all their shared shingles."""
    header, counts = None, []
    for kind, data in zip(table["kind"].to_pylist(), table["data"].to_pylist()):
        if kind == 0:
            header = np.frombuffer(data, HEADER).copy()
        else:
            counts.append(np.frombuffer(data, "<u4"))
    for c in counts:
        header["shared"][: len(c)] += c
    return pa.table({k: header[k] for k in HEADER.names})


#: Shingles that a bucket has about; a task of Python holds one bucket at a time.
BUCKET_SHINGLES = 600_000


def shared_counts(sets: DataFrame, read, shingles: Column) -> DataFrame:
    """Size, signature and number of shared shingles of each row.

    ``read`` makes (sets, ids) slices of a batch. A slice is named by its task and number, so the
    table must be a file scan or another input that gives the same rows when a task is repeated.
    ``shingles`` is about the number of shingles of a row; buckets are as many as their sum asks for.
    """
    total = sets.agg(F.sum(shingles)).first()[0] or 0
    buckets = max(partitions(sets.sparkSession), -(-int(total) // BUCKET_SHINGLES))

    def send(batches):
        part, number = TaskContext.get().partitionId() << 24, 0
        for batch in batches:
            for found, ids in read(batch):
                yield sent(found, ids, part + number, buckets)
                number += 1
        give_back()

    moved = sets.mapInArrow(send, SENT)
    counted = moved.groupBy("bucket").applyInArrow(met, SENT)
    return counted.groupBy("chunk").applyInArrow(summed, SIZED)


def text_reader(width: int, fold: bool):
    def read(batch):
        for part in chunks(batch, "text"):
            yield Sets(part, width, fold), part.column("id").to_numpy()

    return read


def set_reader(batch):
    yield Stored(batch), batch.column("id").to_numpy()


def with_partners(sized: DataFrame, share: Fraction) -> DataFrame:
    """Rows whose shared shingles are enough for a partner of any size."""
    return sized.filter((F.col("n") > 0) & (share.denominator * F.col("shared") >= share.numerator * F.col("n")))


def subset_sizes(n: int, share: Fraction) -> list[int]:
    """Sizes of common subsets that a set of n needs with its possible partners."""
    sizes = {least_overlap(n, r, share) for r in range(least_size(n, share), n * share.denominator // share.numerator + 1) if least_overlap(n, r, share) <= min(n, r)}
    return sorted(sizes)


def chosen_boundary(sets: DataFrame, share: Fraction) -> int:
    """The size up to which enumerating subsets costs less than scanning lists.

    A subset is a row that is grouped once; a shingle of a heavy set is a row that is counted,
    joined and sorted. Sets just below the boundary are on both sides.
    """
    small = sets.filter(F.col("n") <= 2 * MOST_BOUNDARY).groupBy("n").agg(F.count(F.lit(1)).alias("sets")).collect()
    sizes = {r["n"]: r["sets"] for r in small}

    def cost(x: int) -> int:
        light = sum(k * sum(comb(n, c) for c in subset_sizes(n, share)) for n, k in sizes.items() if n <= x)
        return light + sum(4 * k * n for n, k in sizes.items() if n >= least_size(x + 1, share))

    return min(range(MOST_BOUNDARY + 1), key=lambda x: (cost(x), x))


def light_links(sets: DataFrame, boundary: int, share: Fraction) -> DataFrame:
    """Links ``a``, ``b`` that connect all light sets which belong together.

    Sets that share a subset of the size they need link. All those in one bucket do so with its
    smallest set, if with any, so they are linked with that alone.
    """

    def enumerate_subsets(batches):
        for batch in batches:
            out = []
            for id_, tokens in zip(batch.column("id").to_pylist(), batch.column("tokens").to_pylist()):
                values = np.frombuffer(tokens, np.uint64)
                n = len(values)
                marks = [mixed(values ^ m) for m in MIX]
                for c in subset_sizes(n, share):
                    dropped = np.array(list(combinations(range(n), n - c)), np.int64).reshape(comb(n, c), n - c)
                    keys = [(m.sum() - m[dropped].sum(axis=1, dtype=np.uint64)).view(np.int64) for m in marks]
                    out.append(pa.RecordBatch.from_arrays([pa.array(np.full(len(dropped), v)) for v in (id_, n, c)] + [pa.array(k) for k in keys], ["id", "n", "c", "k1", "k2"]))
            yield from out

    rows = sets.filter(F.col("n") <= boundary).select("id", "tokens").mapInArrow(enumerate_subsets, "id bigint, n bigint, c bigint, k1 bigint, k2 bigint")
    rows = stored(rows, "subsets")
    heads = stored(rows.groupBy("c", "k1", "k2").agg(F.min(F.struct("n", "id")).alias("head"), F.count(F.lit(1)).alias("m")).filter("m > 1").drop("m"), "heads")
    p, q = share.numerator, share.numerator + share.denominator
    joined = rows.join(heads, ["c", "k1", "k2"]).filter((F.col("head.id") != F.col("id")) & (p * (F.col("n") + F.col("head.n")) <= q * F.col("c")))
    return joined.select(F.col("head.id").alias("a"), F.col("id").alias("b")).distinct()


def inverted_lists(sets: DataFrame, share: Fraction) -> DataFrame:
    """``token``, ``id``, ``n``, ``at``: the rarest shingles of each set that others have too.

    Two sets that link share one of their first n - least_size(n) + 1 shingles in any one order;
    with rare ones first the lists are short. ``at`` is the place in that order.
    """

    def explode(batches):
        for batch in batches:
            lists = [np.frombuffer(x, np.int64) for x in batch.column("tokens").to_pylist()]
            n = np.array([len(x) for x in lists], np.int64)
            ids = batch.column("id").to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(lists)), pa.array(np.repeat(ids, n)), pa.array(np.repeat(n, n))], ["token", "id", "n"])

    rows = sets.select("id", "tokens").mapInArrow(explode, "token bigint, id bigint, n bigint")
    counted = rows.groupBy("token").agg(F.count(F.lit(1)).alias("df")).filter("df > 1")
    counted = stored(counted, "frequencies")
    known = rows.join(counted, "token")
    # Shingles of no other set come first; they have no list.
    of_set = W.partitionBy("id")
    known = known.withColumn("common", F.count(F.lit(1)).over(of_set))
    known = known.withColumn("at", F.col("n") - F.col("common") + F.row_number().over(of_set.orderBy("df", "token")) - 1)
    p, q = share.numerator, share.denominator
    return known.filter(F.col("at") <= F.col("n") - F.ceil(F.lit(p) * F.col("n") / q)).select("token", "id", "n", "at")


def fits(share: Fraction):
    """Whether two entries of a list, x and y, can belong to sets that link."""
    p, q = share.numerator, share.numerator + share.denominator
    most = F.least(F.col("x.n") - F.col("x.at"), F.col("y.n") - F.col("y.at"))
    return q * most >= p * (F.col("x.n") + F.col("y.n"))


def verified(pairs: DataFrame, sets: DataFrame, share: Fraction) -> DataFrame:
    """Of candidate pairs ``a``, ``b`` those that link, by counting what they share."""

    def count(batches):
        p, q = share.numerator, share.numerator + share.denominator
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("x"), batch.column("y")):
                u, v = (np.frombuffer(t.as_buffer(), np.uint64) for t in (x, y))
                both = len(np.intersect1d(u, v, assume_unique=True))
                keep.append(q * both >= p * (len(u) + len(v)))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    left = pairs.join(sets.select(F.col("id").alias("a"), F.col("tokens").alias("x")), "a")
    both = left.join(sets.select(F.col("id").alias("b"), F.col("tokens").alias("y")), "b")
    return both.select("a", "b", "x", "y").mapInArrow(count, "a bigint, b bigint")


def heavy_links(sets: DataFrame, share: Fraction) -> DataFrame:
    """Links ``a``, ``b`` that connect all heavy sets which belong together.

    First each entry of a list is compared with the head of the list alone, its smallest set, a
    few times over with heads of other groups. That joins up large groups of near copies at the
    cost of their size. Then all entries of a list whose sets are still apart are compared with
    each other, so no link between groups is lost; links inside a group add nothing.
    """
    lists = stored(inverted_lists(sets, share), "lists")
    order = lambda: [F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b")]
    links, grouped = None, lists.withColumn("group", F.col("id"))
    for _ in range(HEAD_ROUNDS):
        spread = grouped.groupBy("token").agg(F.min(F.struct("group", "n", "id", "at")).alias("head"), F.max("group").alias("last"))
        heads = stored(spread.filter(F.col("head.group") != F.col("last")).select("token", "head.*"), "heads")
        pairs = grouped.alias("x").join(heads.alias("y"), "token").filter((F.col("x.group") != F.col("y.group")) & fits(share))
        found = verified(stored(pairs.select(*order()).distinct(), "pairs"), sets, share)
        links = stored(found if links is None else links.unionByName(found), "links")
        grouped = stored(regrouped(lists, components(links)), "grouped")
    apart = grouped.groupBy("token").agg(F.min("group").alias("lo"), F.max("group").alias("hi")).filter("lo != hi")
    rest = stored(grouped.join(stored(apart.select("token"), "apart"), "token"), "rest")
    pairs = rest.alias("x").join(rest.alias("y"), "token").filter((F.col("x.group") < F.col("y.group")) & fits(share))
    found = verified(stored(pairs.select(*order()).distinct(), "pairs"), sets, share)
    return links.unionByName(found)


def regrouped(lists: DataFrame, groups: DataFrame) -> DataFrame:
    groups = stored(groups, "groups")
    joined = lists.join(groups, F.col("id") == F.col("node"), "left")
    return joined.select("token", "id", "n", "at", F.coalesce("component", "id").alias("group"))


def near_components(df: DataFrame, id_col: str = "doc_id", text: str = "text", width: int = 5, share: Fraction = Fraction(4, 5), fold: bool = True) -> DataFrame:
    """One row per row of ``df``: its id, ``n_shingles`` and ``component_id``.

    The component is the smallest id that can be reached over links, its own included. Texts with
    fewer words than ``width`` are one shingle; null and empty texts, and texts without words,
    have none and link with nothing. Equal texts always link. Null ids are one document that is
    smaller than all others, and so are rows that repeat an id: the id has the component of all
    its texts. Other columns are not read; an empty table gives no rows.
    """
    rows = df.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("id"), F.col(text).cast("string").alias("text"))
    sized = stored(shared_counts(rows, text_reader(width, fold), F.octet_length("text") / 6), "sized")
    likely = with_partners(sized, share)
    classes = likely.groupBy("n", "s1", "s2").agg(F.min("id").alias("id"), F.max("id").alias("last"))
    classes = stored(classes, "classes")
    sets = stored(class_sets(rows, classes.select("id", "n", "s1", "s2"), width, fold), "sets")
    left = with_partners(shared_counts(sets.select("id", "tokens"), set_reader, F.octet_length("tokens") / 8), share).select("id")
    sets = stored(sets.join(stored(left, "left"), "id", "left_semi"), "sets")
    boundary = chosen_boundary(sets, share)
    light = light_links(sets, boundary, share)
    heavy = heavy_links(sets.filter(F.col("n") >= least_size(boundary + 1, share)), share)
    # A class is linked with its copies, which have other ids than its first one.
    copies = likely.join(classes.filter("id != last").select("n", "s1", "s2", F.col("id").alias("a")), ["n", "s1", "s2"])
    copies = copies.filter("id != a").select("a", F.col("id").alias("b"))
    groups = stored(components(light.unionByName(heavy).unionByName(copies)), "components")
    out = sized.join(groups, F.col("id") == F.col("node"), "left")
    real = lambda c: F.when(c != NO_ID, c)
    return out.select(
        real(F.col("id")).alias(id_col), F.col("n").alias("n_shingles"), real(F.coalesce("component", "id")).alias("component_id")
    )


def class_sets(rows: DataFrame, classes: DataFrame, width: int, fold: bool) -> DataFrame:
    """``id``, ``n`` and ``tokens`` of one text per class."""

    def make(batches):
        for batch in batches:
            for part in chunks(batch, "text"):
                sets = Sets(part, width, fold)
                signed = zip(sets.sizes, *sets.signatures(), part.column("n").to_numpy(), part.column("s1").to_numpy(), part.column("s2").to_numpy())
                same = pa.array([tuple(x[:3]) == tuple(x[3:]) for x in signed], pa.bool_())
                out = pa.RecordBatch.from_arrays([part.column("id"), part.column("n"), pa.array(sets.lists(), pa.binary())], ["id", "n", "tokens"])
                yield out.filter(same)

    # The classes grow with the corpus, so they are never broadcast, however few they are.
    found = rows.hint("merge").join(classes, "id").select("id", "text", "n", "s1", "s2").mapInArrow(make, "id bigint, n bigint, tokens binary")
    return found


def distinct_documents(df: DataFrame, id_col: str = "doc_id", text: str = "text", width: int = 5, share: Fraction = Fraction(4, 5)) -> DataFrame:
    """The rows of ``df`` without those that have a near copy with a smaller id.

    Of rows that repeat an id one stays.
    """
    found = stored(near_components(df, id_col, text, width, share), "near")
    losers = found.filter(~F.col("component_id").eqNullSafe(F.col(id_col))).select(F.col(id_col).alias("_id")).distinct()
    repeated = stored(found.groupBy(F.col(id_col).alias("_id")).agg(F.count(F.lit(1)).alias("k")).filter("k > 1").select("_id"), "repeated")
    losers = stored(losers, "losers")
    kept = df.join(losers, df[id_col].eqNullSafe(losers["_id"]), "left_anti")
    if repeated.isEmpty():
        return kept
    again = df[id_col].eqNullSafe(repeated["_id"])
    return kept.join(repeated, again, "left_anti").unionByName(kept.join(repeated, again, "left_semi").dropDuplicates([id_col]))
