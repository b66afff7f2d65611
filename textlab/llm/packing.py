"""Packing by power-of-two decomposition.

A document of L tokens is cut into pieces whose lengths are the powers of two that L is made of
(and as many of the greatest length as fit), longest first. Every piece is a sequence of its own,
and sequences of equal length follow each other, so a batch needs no padding and no sequence
crosses documents.
"""

from __future__ import annotations

import json
import unicodedata
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textlab.llm.common import ranked, string_or_empty
from textlab.llm.textarrays import chunks, give_back

GREATEST = 4096
END_ID = 2
#: Fixed value: how the tokenizer splits a text into parts that are coded one by one.
PARTS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
# The normaliser and splitter that go with it, as tokenizer files state them.
NORMALIZER = {
    "type": "Sequence",
    "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}],
}
SPLITTER = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": PARTS}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}
#: Marks that often stand after a word.
MARKS = tuple(".,;:!?")
#: Words and parts whose ids a task keeps at a time; when it is full it starts anew.
KEPT = 300_000
#: Places of the table that knows which words have been seen once; only then they are kept.
SEEN = 1 << 22


class Kept(dict):
    """Results of ``make`` for keys that come again; what comes once only is not kept."""

    def __init__(self, make):
        self.make, self.seen = make, bytearray(SEEN)

    def __missing__(self, key: str) -> bytes:
        found = self.make(key)
        place = hash(key) & (SEEN - 1)
        if self.seen[place] or len(self) < KEPT // 2:
            if len(self) >= KEPT:
                self.clear()
            self[key] = found
        else:
            self.seen[place] = 1
        return found


def coded_by_words(spec: dict) -> bool:
    """Whether a tokenizer file codes words one by one, as ``Codes`` does."""
    marked = all("<|" in t["content"] and not any(c.isspace() for c in t["content"]) for t in spec["added_tokens"])
    plain = not any(t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"])
    cut = spec["truncation"] or spec["padding"]
    return marked and plain and not cut and (spec["normalizer"], spec["pre_tokenizer"]) == (NORMALIZER, SPLITTER)


class Codes:
    """Ids of texts as bytes of unsigned 32-bit numbers.

    The tokenizer drops white space and codes the parts between on their own, so a text's ids
    are those of its words one after the other. Normalising and splitting a whole text costs far
    more than the coding, which here is done once per distinct part.
    """

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.tokenizer = Tokenizer.from_file(path)
        self.by_words = coded_by_words(json.loads(self.tokenizer.to_str()))
        self.find = regex.compile(PARTS).findall
        self.bytes_of = ByteLevel(add_prefix_space=False, use_regex=False)
        self.parts, self.words = Kept(self.part), Kept(self.word)

    def part(self, part: str) -> bytes:
        plain = part.isascii() and part.isprintable()
        spelled = part if plain else self.bytes_of.pre_tokenize_str(part)[0][0]
        return array("I", [t.id for t in self.tokenizer.model.tokenize(spelled)]).tobytes()

    def word(self, word: str) -> bytes:
        if "<|" in word:  # special tokens are found before anything else
            return self.whole(word)
        plain = lowered(word if word.isascii() else unicodedata.normalize("NFC", word))
        if plain.isalpha():  # letters only are one part, and so are marks after them
            return self.parts[plain]
        if plain[-1:] in MARKS and plain[:-1].isalpha():
            return self.parts[plain[:-1]] + self.parts[plain[-1]]
        return b"".join(map(self.parts.__getitem__, self.find(plain)))

    def whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def ids(self, text: str) -> bytes:
        if not self.by_words:
            return self.whole(text)
        return b"".join(map(self.words.__getitem__, text.replace("\n", " ").split(" ")))


def lowered(word: str) -> str:
    """Lower case letter by letter, as the tokenizer has it: a sigma at the end is no exception."""
    return word.lower() if "\u03a3" not in word else "".join(c.lower() for c in word)


_CODES: dict[str, Codes] = {}


def codes(path: str) -> Codes:
    """The codes of this worker process."""
    if path not in _CODES:
        _CODES[path] = Codes(path)
    return _CODES[path]


def lengths(total: int, greatest: int = GREATEST) -> list[int]:
    """Lengths of the pieces of a document of ``total`` tokens, longest first."""
    rest = total % greatest
    return [greatest] * (total // greatest) + [1 << b for b in range(greatest.bit_length() - 2, -1, -1) if rest >> b & 1]


def pieces(df: DataFrame, tokenizer: str, keep_ids: bool = True, greatest: int = GREATEST, end_id: int = END_ID, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """The pieces of all texts: ``doc_id``, ``start``, ``length``, ``ids_crc32``, ``doc_tokens``
    and, if asked for, ``ids``. Null texts count as empty and are the end id alone; repeated rows
    are cut each for itself; other columns are not read."""

    def cut(batches):
        known = codes(tokenizer)
        end = np.array([end_id], "<u4").tobytes()
        # Texts of a batch are large: their pieces leave in parts, and what is freed would stay with the worker.
        for batch in batches:
            for slice_ in list(chunks(batch, "text")) or [batch]:
                rows, value = {k: [] for k in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids")}, None
                for doc, value in zip(slice_.column(0).to_pylist(), slice_.column(1)):
                    data = known.ids(value.as_py()) + end
                    total, start = len(data) // 4, 0
                    for length in lengths(total, greatest):
                        part = data[4 * start : 4 * (start + length)]
                        for k, v in zip(rows, (doc, start, length, zlib.crc32(part), total)):
                            rows[k].append(v)
                        if keep_ids:
                            rows["ids"].append(np.frombuffer(part, "<u4"))
                        start += length
                out = pa.RecordBatch.from_arrays([pa.array(rows[k], kinds[k]) for k in names], names)
                del rows, slice_, value
                yield out
                del out
            del batch
            give_back()

    kinds = {k: pa.int64() for k in ("doc_id", "start", "length", "ids_crc32", "doc_tokens")} | {"ids": pa.list_(pa.int64())}
    names = [k for k in kinds if keep_ids or k != "ids"]
    schema = ", ".join(f"{k} {'array<bigint>' if k == 'ids' else 'bigint'}" for k in names)
    read = df.select(F.col(id_col).cast("long").alias("doc_id"), string_or_empty(F.col(text)).alias("text"))
    return read.mapInArrow(cut, schema)


def packed(cut: DataFrame) -> DataFrame:
    """Pieces with ``sequence_id`` and ``offset``: sequences of one piece, equal lengths together.

    The sequences are numbered by length, the longest first, and inside a length by a hash of the
    document, so that neighbours in a batch come from all over the table.
    """
    order = [F.col("length").desc(), F.xxhash64("doc_id", "start"), F.col("doc_id"), F.col("start")]
    return ranked(cut, order, "sequence_id").withColumn("offset", F.lit(0).cast("long"))


def document_packing(df: DataFrame, tokenizer: str, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Where each piece of each document goes."""
    return packed(pieces(df, tokenizer, keep_ids=False, id_col=id_col, text=text))
