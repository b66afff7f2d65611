"""Substring dedup: suffixes are split by prefixes of varying length into groups that fit in
memory, and in the suffix trees of each group the nodes at a depth of WINDOW words are repeats.

Two windows of words are equal only if they agree in the run of GRAM words with the least hash,
their anchor. So a window is told by the suffix that begins at its anchor and, read backwards, by
the words in front of it. Suffixes are split by the GRAM words at their anchor, and prefixes that
occur once are dropped: they can't be part of a repeat. A prefix with more than MOST_RUNS different
continuations is made longer: its windows are halved by the place of their anchor, which gives
each half more words in common, and again until a group fits, at the latest when the prefix is
the whole window. In a group the suffixes are sorted, forwards and backwards, and the longest
common prefixes of neighbours are the depths of the nodes of the two trees. Windows with their
anchor at word o are equal if they lie below one node of depth window - o and one of depth o.
Texts that are equal as a whole are one class.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textlab.functions.groups import salted_join
from textlab.llm.common import partitions, stored
from textlab.llm.textarrays import MIX, Words, chunks, mixed

WINDOW, GRAM = 35, 8
#: Runs of suffixes in a group, and different runs under one prefix above which it is made longer.
GROUP_RUNS, MOST_RUNS = 8_000, 1_000
NO_ID = -(2**63)


class Anchored:
    """The windows of the texts of a slice, in runs that have the same anchor.

    ``lo`` and ``end`` are the first and past the last window of each run, ``anchor`` its place,
    ``key`` the hash of its GRAM words, ``row`` its text; ``first`` are the bounds of each text.
    """

    def __init__(self, column: pa.Array, window: int):
        self.words = words = Words(column)
        grams = words.hashes[: max(0, len(words.hashes) - GRAM + 1)].copy()
        for j in range(1, GRAM):
            grams = mixed(grams * np.uint64(5) + words.hashes[j : len(grams) + j])
        n = len(words.hashes) - window + 1
        inside = words.row[: max(n, 0)] == words.row[window - 1 :] if n > 0 else np.empty(0, bool)
        starts = np.flatnonzero(inside)
        width = window - GRAM + 1
        at, size = np.arange(len(grams)), 1
        while size * 2 <= width:
            a, b = at[: len(at) - size], at[size:]
            at = np.where(grams[a] <= grams[b], a, b)
            size *= 2
        if n > 0:
            a, b = at[starts], at[starts + width - size]
            anchor = np.where(grams[a] <= grams[b], a, b)
        else:
            anchor = np.empty(0, np.int64)
        new = np.ones(len(starts), bool)
        new[1:] = (anchor[1:] != anchor[:-1]) | (starts[1:] != starts[:-1] + 1)
        cut = np.flatnonzero(new)
        self.lo, self.anchor = starts[cut], anchor[cut]
        self.end = self.lo + np.diff(np.r_[cut, len(starts)])
        self.key = grams[self.anchor] if len(cut) else np.empty(0, np.uint64)
        self.row = words.row[self.lo]
        self.first = np.r_[0, np.cumsum(np.bincount(self.row, minlength=words.rows))]

    def signatures(self) -> tuple[np.ndarray, np.ndarray]:
        """128 bits of the sequence of words of each text."""
        words, sums = self.words, []
        place = (np.arange(len(words.hashes)) - words.first[words.row]).astype(np.uint64)
        for m in MIX:
            out = np.zeros(words.rows, np.uint64)
            np.add.at(out, words.row, mixed(words.hashes ^ mixed(place * m + m)))
            sums.append(out.view(np.int64))
        return tuple(sums)


def plain(text: str | None) -> bytes:
    """The words of a text with one blank between them."""
    return b" ".join((text or "").encode().split())


def scanned(rows: DataFrame, window: int) -> DataFrame:
    """Per row of ``id``, ``text``: ``n``, signature, digest of its words, keys of its anchors."""

    def scan(batches):
        for batch in batches:
            for part in chunks(batch, "text"):
                found = Anchored(part.column("text"), window)
                s1, s2 = found.signatures()
                digests = [hashlib.sha256(plain(t)).hexdigest() for t in part.column("text").to_pylist()]
                keys = [found.key[a:b].tobytes() for a, b in zip(found.first, found.first[1:])]
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), pa.array(found.words.counts), pa.array(s1), pa.array(s2), pa.array(digests), pa.array(keys, pa.binary())],
                    ["id", "n", "s1", "s2", "sha", "keys"],
                )

    return rows.mapInArrow(scan, "id bigint, n bigint, s1 bigint, s2 bigint, sha string, keys binary")


def shared_anchors(texts: DataFrame) -> DataFrame:
    """``s1``, ``s2``, ``runs``: of each class the numbers of its anchors that occur elsewhere."""

    def explode(batches):
        for batch in batches:
            lists = [np.frombuffer(x, np.int64) for x in batch.column("keys").to_pylist()]
            n = np.array([len(x) for x in lists], np.int64)
            if n.sum():
                ordinal = np.concatenate([np.arange(k, dtype=np.int32) for k in n])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(lists)), pa.array(np.repeat(batch.column("s1").to_numpy(), n)), pa.array(np.repeat(batch.column("s2").to_numpy(), n)), pa.array(ordinal)],
                    ["key", "s1", "s2", "ordinal"],
                )

    anchors = texts.select("s1", "s2", "keys").mapInArrow(explode, "key bigint, s1 bigint, s2 bigint, ordinal int")
    counted = anchors.groupBy("key").agg(F.count(F.lit(1)).alias("m")).filter("m > 1")
    counted = stored(counted.select("key"), "keys")
    known = anchors.join(counted, "key")
    # At most as many as a text has anchors.
    return known.groupBy("s1", "s2").agg(F.sort_array(F.collect_list("ordinal")).alias("runs"))


def fields(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def digest(content: np.ndarray, size: int, *salt: int) -> bytes:
    """Of some words, apart for different numbers ``salt``."""
    return hashlib.blake2b(content.tobytes(), digest_size=size, salt=np.array(salt, np.int32).tobytes()).digest()


RUNS = "s1 bigint, s2 bigint, ordinal int, key bigint, offset int, windows int, c1 bigint, c2 bigint, content binary"


def cut_runs(texts: DataFrame, window: int) -> DataFrame:
    """The words under each run of windows whose anchor occurs elsewhere, as hashes."""

    def cut(batches):
        for batch in batches:
            for part in chunks(batch, "text"):
                found = Anchored(part.column("text"), window)
                runs = part.column("runs").to_pylist()
                ordinal = np.array([x for numbers in runs for x in numbers], np.int64)
                if not len(ordinal):
                    continue
                row = np.repeat(np.arange(len(runs)), [len(numbers) for numbers in runs])
                run = found.first[row] + ordinal
                lo, end = found.lo[run], found.end[run]
                offset = found.anchor[run] - lo
                content = [found.words.hashes[a : b + window - 1] for a, b in zip(lo, end)]
                marks = b"".join(digest(c, 16, o, window) for c, o in zip(content, offset))
                marks = np.frombuffer(marks, np.int64).reshape(-1, 2)
                signs = [part.column(c).to_numpy()[row] for c in ("s1", "s2")]
                places = [x.astype(np.int32) for x in (offset, end - lo)]
                columns = [*signs, ordinal.astype(np.int32), found.key[run].view(np.int64), *places, marks[:, 0], marks[:, 1]]
                content = pa.array([c.tobytes() for c in content], pa.binary())
                yield pa.RecordBatch.from_arrays([*[pa.array(x) for x in columns], content], fields(RUNS))

    return texts.select("text", "s1", "s2", "runs").mapInArrow(cut, RUNS)


PIECES = (
    "key bigint, o1 bigint, o2 bigint, base int, c1 bigint, c2 bigint, offset int, windows int, "
    "least int, most int, m bigint, content binary"
)


def longer_prefixes(pieces: DataFrame, window: int) -> DataFrame:
    """Pieces with the windows of each given one whose anchor is at words ``least`` to the middle, and
    those beyond; ``key`` is of the words that all windows of a half share, ``base`` the number of the
    first of its windows in the run ``o1``, ``o2``."""

    def halves(batches):
        for batch in batches:
            out = {k: [] for k in fields(PIECES)}
            for r in batch.to_pylist():
                words = np.frombuffer(r["content"], np.uint64)
                middle = (r["least"] + r["most"]) // 2
                for least, most in ((r["least"], middle), (middle + 1, r["most"])):
                    first = max(0, r["offset"] - most)
                    last = min(r["windows"] - 1, r["offset"] - least)
                    if first > last:
                        continue
                    content = words[first : last + window]
                    offset = r["offset"] - first
                    key = digest(content[offset - least : offset + window - most], 8, least, most)
                    marks = np.frombuffer(digest(content, 16, offset, most - least), np.int64)
                    new = {
                        "key": int(np.frombuffer(key, np.int64)[0]), "base": r["base"] + first, "c1": int(marks[0]), "c2": int(marks[1]),
                        "offset": offset, "windows": last - first + 1, "least": least, "most": most, "content": content.tobytes(),
                    }
                    for k, values in out.items():
                        values.append(new[k] if k in new else r[k])
            if out["key"]:
                yield pa.RecordBatch.from_pydict(out, batch.schema)

    return pieces.select(*fields(PIECES)).mapInArrow(halves, PIECES)


def prefix_groups(kinds: DataFrame, window: int) -> tuple[DataFrame, DataFrame | None]:
    """Runs and pieces of runs under prefixes that fit in memory, each once with its number ``m``, and
    the pieces of the runs that were cut (None: none were)."""
    pieces = kinds.select(
        "key", F.col("c1").alias("o1"), F.col("c2").alias("o2"), F.lit(0).alias("base"), "c1", "c2", "offset", "windows",
        F.lit(0).alias("least"), F.lit(window - GRAM).alias("most"), "m", "content",
    )
    apart = ["key", "c1", "c2", "offset", "windows", "m", "content"]
    different, fitting, cuts = pieces, [], []
    while True:
        counted = different.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.first("least").alias("a"), F.first("most").alias("b"))
        large = stored(counted.filter((F.col("n") > MOST_RUNS) & (F.col("a") < F.col("b"))).select("key"), "large")
        if large.isEmpty():
            fitting.append(different.select(*apart))
            break
        fitting.append(different.join(large, "key", "left_anti").select(*apart))
        pieces = stored(longer_prefixes(pieces.join(large, "key"), window), "pieces")
        cuts.append(pieces.select("o1", "o2", "base", "c1", "c2"))
        first = [F.first(c).alias(c) for c in ("offset", "windows", "least", "most", "content")]
        different = stored(pieces.groupBy("key", "c1", "c2").agg(*first, F.sum("m").alias("m")), "different")
    return reduce(DataFrame.unionByName, fitting), reduce(DataFrame.unionByName, cuts) if cuts else None


def nodes(table: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of the rows, each of ``lengths`` words, and the common words of each with the one before."""
    order = np.lexsort(table.T[::-1]) if table.shape[1] else np.arange(len(table))
    same = np.cumprod(table[order[1:]] == table[order[:-1]], axis=1, dtype=np.int8).sum(axis=1)
    common = np.zeros(len(order), np.int64)
    common[1:] = np.minimum(same, np.minimum(lengths[order[1:]], lengths[order[:-1]]))
    return order, common


def below(order: np.ndarray, common: np.ndarray, depth: int) -> np.ndarray:
    """For each row the number of its node at this depth."""
    node = np.empty(len(order), np.int64)
    node[order] = np.cumsum(common < depth)
    return node


def tree_repeats(runs: DataFrame, window: int) -> DataFrame:
    """``c1``, ``c2``, ``at``: the windows of each run or piece that occur elsewhere, by suffix trees."""
    front = window - GRAM

    def subtrees(table: pa.Table) -> pa.Table:
        contents = [np.frombuffer(x, np.uint64) for x in table["content"].to_pylist()]
        windows, offset, m = (table[c].to_numpy().astype(np.int64) for c in ("windows", "offset", "m"))
        after = windows - 1 - offset + window
        right = np.zeros((len(contents), window), np.uint64)
        left = np.zeros((len(contents), front), np.uint64)
        for i, words in enumerate(contents):
            right[i, : after[i]] = words[offset[i] :]
            left[i, : offset[i]] = words[: offset[i]][::-1]
        forwards, backwards = nodes(right, after), nodes(left, offset)
        starts = np.r_[0, np.cumsum(windows)]
        repeated = np.zeros(starts[-1], bool)
        for o in range(front + 1):
            has = np.flatnonzero((offset >= o) & (offset - o < windows))
            if len(has):
                node = below(*forwards, window - o)[has] * (len(contents) + 1) + below(*backwards, o)[has]
                _, place = np.unique(node, return_inverse=True)
                repeated[starts[has] + offset[has] - o] = np.bincount(place, m[has])[place] > 1
        at = [np.flatnonzero(repeated[a:b]).astype(np.int32) for a, b in zip(starts, starts[1:])]
        keep = pa.array([len(x) > 0 for x in at], pa.bool_())
        return table.select(["c1", "c2"]).append_column("at", pa.array(at, pa.list_(pa.int32()))).filter(keep)

    return runs.groupBy("group").applyInArrow(subtrees, "c1 bigint, c2 bigint, at array<int>")


def repeats_of_runs(kinds: DataFrame, window: int) -> DataFrame:
    """``c1``, ``c2``, ``at``: the windows of each different run that occur elsewhere."""
    fitting, cuts = prefix_groups(kinds, window)
    fitting = stored(fitting, "fitting")
    groups = max(partitions(kinds.sparkSession), 1 + fitting.count() // GROUP_RUNS)
    found = tree_repeats(fitting.withColumn("group", F.pmod(F.xxhash64("key"), F.lit(groups))), window)
    found = stored(found, "repeated")
    if cuts is None:
        return found
    moved = F.transform("at", lambda x: x + F.col("base"))
    return found.unionByName(cuts.join(found, ["c1", "c2"]).select(F.col("o1").alias("c1"), F.col("o2").alias("c2"), moved.alias("at")))


def repeated_windows(df: DataFrame, id_col: str, text: str, window: int) -> tuple[DataFrame, DataFrame]:
    """The scanned rows with the size ``m`` of their class, and the texts of classes of one row
    that have repeats, with their ``marks``: number of an anchor and places of its windows."""
    rows = df.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("id"), F.col(text).cast("string").alias("text"))
    found = stored(scanned(rows, window), "scanned")
    least = F.min(F.struct("id", "keys"))
    classes = found.filter(F.col("n") >= window).groupBy("n", "s1", "s2").agg(least.alias("x"), F.count(F.lit(1)).alias("m"))
    classes = stored(classes.select("s1", "s2", "m", "x.id", "x.keys"), "classes")
    shared = stored(shared_anchors(classes), "shared")
    wanted = stored(classes.select("s1", "s2", "m", "id").join(shared, ["s1", "s2"]), "wanted")

    def same(batches):
        """Rows that repeat an id may have other texts; these go."""
        for batch in batches:
            for part in chunks(batch, "text"):
                s1, s2 = Anchored(part.column("text"), window).signatures()
                keep = (s1 == part.column("s1").to_numpy()) & (s2 == part.column("s2").to_numpy())
                yield part.filter(pa.array(keep))

    # The wanted texts grow with the corpus, so their table is never broadcast, however small.
    texts = rows.hint("merge").join(wanted, "id").select("text", "s1", "s2", "m", "runs")
    texts = stored(texts.mapInArrow(same, texts.schema), "texts")
    runs = stored(cut_runs(texts, window), "runs")
    # Equal runs are one kind, so what a passage has in common is looked at once.
    first = [F.first(c).alias(c) for c in ("content", "windows", "offset")]
    kinds = stored(runs.groupBy("key", "c1", "c2").agg(*first, F.count(F.lit(1)).alias("m")), "kinds")
    repeated = stored(repeats_of_runs(kinds, window), "marks")
    marks = runs.select("s1", "s2", "ordinal", "c1", "c2").join(repeated, ["c1", "c2"])
    marked = marks.groupBy("s1", "s2").agg(F.collect_list(F.struct("ordinal", "at")).alias("marks"))
    lone = texts.filter("m = 1").join(marked, ["s1", "s2"])
    # Only classes of more than one row are met, and the rows of a large one are dealt out.
    copies = classes.filter("m > 1").select("s1", "s2", "m")
    return stored(salted_join(found.drop("keys"), copies, ["s1", "s2"], "left"), "sized"), lone


KEPT = "s1 bigint, s2 bigint, removed bigint, kept_sha string, kept string"


def kept_words(lone: DataFrame, window: int, with_text: bool) -> DataFrame:
    """What is left of texts with repeats."""

    def keep(batches):
        for batch in batches:
            for part in chunks(batch, "text"):
                found = Anchored(part.column("text"), window)
                words = found.words
                removed = np.zeros(len(words.hashes) + 1, np.int64)
                for row, marks in enumerate(part.column("marks").to_pylist()):
                    for mark in marks:
                        lo = found.lo[found.first[row] + mark["ordinal"]]
                        starts = lo + np.array(mark["at"], np.int64)
                        np.add.at(removed, starts, 1)
                        np.add.at(removed, starts + window, -1)
                gone = np.cumsum(removed)[:-1] > 0
                data = words.raw.tobytes()
                out = {k: [] for k in ("removed", "sha", "kept")}
                for row in range(words.rows):
                    a, b = words.first[row], words.first[row + 1]
                    left = a + np.flatnonzero(~gone[a:b])
                    kept = b" ".join([data[s:e] for s, e in zip(words.starts[left], words.ends[left])])
                    for k, v in zip(out, (b - a - len(left), hashlib.sha256(kept).hexdigest(), kept.decode() if with_text else None)):
                        out[k].append(v)
                yield pa.RecordBatch.from_arrays(
                    [part.column("s1"), part.column("s2"), pa.array(out["removed"], pa.int64()), pa.array(out["sha"], pa.string()), pa.array(out["kept"], pa.string())],
                    [c.split()[0] for c in KEPT.split(", ")],
                )

    return lone.select("text", "s1", "s2", "marks").mapInArrow(keep, KEPT)


def repeated_words(df: DataFrame, id_col: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """One row per row of ``df``: id, ``n_words``, ``n_removed`` and ``kept_sha256``.

    A word goes if a window of ``window`` words over it starts anywhere else too, in the same
    text or another one; all windows are judged on the input. Null and empty texts have no words.
    Of equal texts of at least a window's length nothing is left, and rows that repeat an id are
    texts of their own. Other columns are not read; an empty table gives no rows.
    """
    found, lone = repeated_windows(df, id_col, text, window)
    kept = stored(kept_words(lone, window, with_text=False).drop("kept"), "kept")
    # Copies have nothing kept; each goes its own way, so that no task gets all of a class.
    apart = F.when(F.col("m") > 1, F.xxhash64("id", "s1")).otherwise(0)
    joined = found.withColumn("apart", apart).join(kept.withColumn("apart", F.lit(0).cast("long")), ["s1", "s2", "apart"], "left")
    copied = F.coalesce(F.col("m") > 1, F.lit(False))
    return joined.select(
        F.when(F.col("id") != NO_ID, F.col("id")).alias(id_col),
        F.col("n").alias("n_words"),
        F.when(copied, F.col("n")).otherwise(F.coalesce("removed", F.lit(0))).alias("n_removed"),
        F.when(copied, hashlib.sha256(b"").hexdigest()).otherwise(F.coalesce("kept_sha", "sha")).alias("kept_sha256"),
    )


def without_repeats(df: DataFrame, id_col: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """``df`` with the words that ``repeated_words`` counts taken out of its text.

    Texts without repeats stay as they are; the others keep their words with one blank between
    them. Ids have to be unique here.
    """
    found, lone = repeated_windows(df, id_col, text, window)
    kept = kept_words(lone, window, with_text=True).select("s1", "s2", "kept")
    changed = found.filter("m > 1").select("id", F.lit("").alias("kept")).unionByName(found.join(kept, ["s1", "s2"]).select("id", "kept"))
    changed = stored(changed.select(F.col("id").alias("__id"), F.col("kept").alias("__kept")), "changed")
    key = F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID))
    joined = df.join(changed, key == F.col("__id"), "left")
    return joined.withColumn(text, F.coalesce("__kept", F.col(text).cast("string"))).select(*df.columns)
