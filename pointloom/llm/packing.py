"""Packing by concatenating and cutting: the tokens of all documents end to end, in windows of one length.

The first pass encodes every document, with its place among the tokens of its partition, and is written. Prefix sums over the partitions' totals (first
within blocks of partitions, then over blocks) give each partition's place in the whole. The second pass cuts documents at the windows' borders,
each by itself, without a shuffle. To lay the pieces of a window together, only those at a task's borders meet by shuffle.
"""

from __future__ import annotations

import hashlib
import json
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pointloom.llm.common import blocks, column, live, texts_of, written
from pointloom.llm.pretokens import _L, _N, _S, Recent
from pointloom.llm.token_counts import _model, _spelt

LENGTH, END = 4096, 2
#: Pieces of text that a worker keeps with their ids (some 200 bytes each).
CACHE = 400_000
#: Partitions whose totals are summed in one group.
PARTS = 1024
#: A longer text that needs the library is cut before a blank and a plain letter, where no token crosses.
CHOP = 1 << 16

#: The layout of the tokenizer whose texts can be split without the library.
SPLIT = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
_LAYOUT = (["NFC", "Replace", "Lowercase"], ["Split", "ByteLevel"])
# The same split within Latin-1, where NFC changes nothing.
_NARROW = re.compile(f"'(?:[stmd]|re|ve|ll)|[{_L}]+|[{_N}]|[^{_S}{_L}{_N}]+").findall
_SAFE = re.compile(" (?=[A-Za-z0-9])")


def _known(spec: dict) -> bool:
    norm, pre = spec.get("normalizer") or {}, spec.get("pre_tokenizer") or {}
    kinds = [x["type"] for x in norm.get("normalizers", [])], [x["type"] for x in pre.get("pretokenizers", [])]
    if kinds != _LAYOUT or spec["model"]["type"] != "BPE" or spec["model"].get("dropout"):
        return False
    space, (split, level) = norm["normalizers"][1], pre["pretokenizers"]
    return space["pattern"] == {"Regex": "\\s+"} and space["content"] == " " and split["pattern"] == {"Regex": SPLIT} and split["invert"] and split["behavior"] == "Removed" and not level["add_prefix_space"] and not level["use_regex"]


class Encoder:
    """Ids of texts as little-endian unsigned 32-bit integers, as the library gives them.

    Texts within Latin-1 are split here, and their pieces looked up in a cache; other texts, those with special strings, and all texts where the
    tokenizer has another layout, go through the library.
    """

    def __init__(self, tokenizer_json: str):
        from tokenizers import Tokenizer

        spec = json.loads(tokenizer_json)
        self.library = Tokenizer.from_str(tokenizer_json)
        self.library.no_truncation()
        self.library.no_padding()
        self.marks = [t["content"] for t in spec.get("added_tokens", [])]
        self.split = _NARROW if _known(spec) else None
        tokenize = _model(tokenizer_json).tokenize if self.split else None
        self.pieces = Recent(CACHE, lambda piece: np.array([t.id for t in tokenize(_spelt(piece))], "<u4").tobytes())

    def __call__(self, text: str) -> bytes:
        if self.split and not any(m in text for m in self.marks):
            try:
                text.encode("latin-1")
                return b"".join(map(self.pieces.__getitem__, self.split(text.lower())))
            except UnicodeEncodeError:
                pass
        cuts = [0]
        while self.split and len(text) - cuts[-1] > CHOP and (at := _SAFE.search(text, cuts[-1] + CHOP)):
            cuts.append(at.start())
        return b"".join(np.array(self.library.encode(text[a:b], add_special_tokens=False).ids, "<u4").tobytes() for a, b in zip(cuts, [*cuts[1:], len(text)]))


def encoded(docs: DataFrame, tokenizer: str, end: int = END) -> DataFrame:
    """doc_id, n and ids (binary) of every whole text with ``end`` after it, and its place: part (a partition) and before (tokens ahead of it there).

    Written to the shared folder, so that places hold whatever is run again.
    """
    with open(tokenizer, encoding="utf-8") as f:
        spec = f.read()
    shared, mark, last = docs.sparkSession.sparkContext.broadcast(spec), hashlib.sha256(spec.encode()).digest(), np.array([end], "<u4").tobytes()

    def work(batches):
        from pyspark import TaskContext

        encode, part, before = live(("ids", mark), lambda: Encoder(shared.value)), TaskContext.get().partitionId(), 0
        for batch in blocks(batches):
            ids = [encode(text) + last for text in batch.column("text").to_pylist()]
            n = np.array([len(x) // 4 for x in ids], np.int64)
            at = before + np.cumsum(n) - n
            before += int(n.sum())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.full(len(n), part, np.int64)), pa.array(at), pa.array(n), pa.array(ids, pa.binary())], names=["doc_id", "part", "before", "n", "ids"])

    return written(texts_of(docs).mapInArrow(work, f"{column('doc_id', docs)}, part bigint, before bigint, n bigint, ids binary"))


def offsets(made: DataFrame, parts: int = PARTS) -> DataFrame:
    """(part, base): tokens of all partitions before each. A row for each partition of the input that has documents."""
    totals = made.groupBy("part").agg(F.max(F.col("before") + F.col("n")).alias("total")).withColumn("block", F.floor(F.col("part") / parts))
    ahead = lambda w: F.coalesce(F.sum("total").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = totals.groupBy("block").agg(F.sum("total").alias("total"))
    blocks_ = sums.select("block", ahead(Window.orderBy("block")).alias("start"))
    return totals.withColumn("own", ahead(Window.partitionBy("block").orderBy("part"))).join(blocks_, "block").select("part", (F.col("start") + F.col("own")).alias("base"))


def pack(docs: DataFrame, tokenizer: str, length: int = LENGTH, end: int = END) -> DataFrame:
    """doc_id, start, length, ids (binary), doc_tokens, sequence_id and offset of every piece of every document.

    Sequence s holds the tokens from s * length on of all documents end to end, in the order of the input's partitions and rows; all but the last are
    full. A null text counts as empty and has the end token alone; repeated rows and null ids are documents of their own; an empty table gives no rows.
    The offsets, which are broadcast, take 16 bytes for each partition of the input.
    """
    made = encoded(docs, tokenizer, end)
    placed = made.join(F.broadcast(offsets(made)), "part").withColumn("at", F.col("base") + F.col("before"))
    at, n = F.col("at"), F.col("n")

    def piece(s):
        start, stop = F.greatest(F.lit(0), s * length - at), F.least(n, (s + 1) * length - at)
        return F.struct(start.alias("start"), (stop - start).alias("length"), F.substring("ids", (start * 4 + 1).cast("int"), ((stop - start) * 4).cast("int")).alias("ids"), s.alias("sequence_id"), (at + start - s * length).alias("offset"))

    pieces = F.transform(F.sequence(F.floor(at / length), F.floor((at + n - 1) / length)), piece)
    return placed.select("doc_id", n.alias("doc_tokens"), F.explode(pieces).alias("p")).select("doc_id", "p.start", "p.length", "p.ids", "doc_tokens", "p.sequence_id", "p.offset")


def padded(n: int, length: int) -> int:
    """The size of a sequence of n tokens: ``length``, unless n is a power of two."""
    return n if n & (n - 1) == 0 else length


def sequences(pieces: DataFrame, length: int = LENGTH, pad: int = 0) -> DataFrame:
    """(sequence_id, n, ids): whole sequences of rows of pack(), with ``pad`` after the n tokens up to their size.

    A task lays together what it reads in order; only sequences that it has in part, at its borders, are sent on.
    """

    def work(batches):
        held: list = []  # sequence, where it begins, where it ends, chunks

        def row():
            return {"sequence_id": [held[0]], "offset": [held[1]], "ids": [b"".join(held[3])]}

        schema = pa.schema([("sequence_id", pa.int64()), ("offset", pa.int64()), ("ids", pa.binary())])
        for batch in blocks(batches, "ids"):
            for s, at, ids in zip(*(batch.column(c).to_pylist() for c in ("sequence_id", "offset", "ids"))):
                if held and (held[0] != s or held[2] != at):
                    yield pa.RecordBatch.from_pydict(row(), schema)
                    held = []
                held = held or [s, at, at, []]
                held[2] += len(ids) // 4
                held[3].append(ids)
        if held:
            yield pa.RecordBatch.from_pydict(row(), schema)

    laid = written(pieces.select("sequence_id", F.col("offset"), "ids").mapInArrow(work, "sequence_id bigint, offset bigint, ids binary"))
    whole = laid.where(F.octet_length("ids") == 4 * length).select("sequence_id", "ids")
    border = laid.where(F.octet_length("ids") < 4 * length).groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("parts"))
    joined = border.select("sequence_id", F.aggregate("parts", F.lit(b""), lambda a, x: F.concat(a, x["ids"])).alias("ids"))
    n = F.floor(F.octet_length("ids") / 4)
    power = F.bit_count(n) == 1
    padding = F.unhex(F.repeat(F.lit(np.array([pad], "<u4").tobytes().hex()), (F.lit(length) - n).cast("int")))
    return whole.unionByName(joined).select("sequence_id", n.alias("n"), F.when(power, F.col("ids")).otherwise(F.concat("ids", padding)).alias("ids"))


def digest(pieces: DataFrame) -> DataFrame:
    """What op13 reports of rows of pack()."""
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
