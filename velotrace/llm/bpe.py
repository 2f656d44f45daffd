"""Encoding texts with a public byte-level BPE vocabulary (problem 8)."""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Callable, Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from velotrace.session import arrow_map

TOKENIZERS = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k.json"

# Fixed value: how byte-level BPE of 50k ids divides a text before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(maxsize=1)
def divider() -> Callable[[str], list[str]]:
    """Divides a text by PATTERN.

    Texts whose characters all lie in Unicode's first plane, nearly all, go through the standard library's engine, which is more than twice as fast
    once \\p{L}, \\p{N} and \\s are written as the characters that they stand for there; others through the engine that knows these classes.
    """
    plane = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x10000)]))
    classes = {}
    for name in (r"\p{L}", r"\p{N}", r"\s"):
        code = np.array([ord(c) for c in regex.findall(name, plane)])
        begin = np.flatnonzero(np.r_[True, np.diff(code) != 1])
        classes[name] = "".join(rf"\u{code[a]:04x}-\u{code[b - 1]:04x}" for a, b in zip(begin, np.r_[begin[1:], len(code)], strict=True))
    inside = PATTERN.replace(r"[^\s\p{L}\p{N}]", "[^" + "".join(classes.values()) + "]").replace(r"\S", f"[^{classes[r'\s']}]")
    for name, chars in classes.items():
        inside = inside.replace(name, f"[{chars}]")
    plain, general = re.compile(inside).findall, regex.compile(PATTERN).findall
    return lambda text: plain(text) if text.isascii() or len(text.encode("utf-16-le", "surrogatepass")) == 2 * len(text) else general(text)


#: Pieces of text whose ids a worker remembers; beyond it forgets all and starts again.
REMEMBERED = 200_000
#: Longer pieces are not remembered.
LONGEST_REMEMBERED = 64
#: A vocabulary file above this size is not broadcast but refused.
LARGEST_FILE = 64 << 20


def byte_letters() -> list[str]:
    """The letter by which vocabulary files write each byte: itself if printable, else the next free one from 256 on."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = [b for b in range(256) if b not in printable]
    return [chr(b) if b in printable else chr(256 + rest.index(b)) for b in range(256)]


class Bpe:
    """Encoder and decoder of one vocabulary file."""

    def __init__(self, content: bytes):
        model = json.loads(content)["model"]
        letter = {c: b for b, c in enumerate(byte_letters())}
        vocab: dict[str, int] = model["vocab"]
        self.single = [vocab[c] for c in byte_letters()]
        self.strings = {i: bytes(letter[c] for c in s) for s, i in vocab.items() if all(c in letter for c in s)}
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, m in enumerate(model["merges"]):
            a, b = m.split(" ") if isinstance(m, str) else m
            self.merges[vocab[a], vocab[b]] = (rank, vocab[a + b])
        self.find = divider()
        self.known: dict[str, tuple[int, ...]] = {}

    def merge(self, raw: bytes) -> list[int]:
        """Ids of one piece: the queue gives the best-ranked neighbouring pair, leftmost first.

        Symbols are a doubly linked list over byte positions. A queued pair is stale if one of its
        symbols has been merged since, which shows in their ids, as a merge changes the id at the left place and clears the right.
        """
        n = len(raw)
        ids = [self.single[b] for b in raw]
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]
        merges, push, pop = self.merges, heapq.heappush, heapq.heappop
        queue = []
        for i in range(n - 1):
            m = merges.get((ids[i], ids[i + 1]))
            if m:
                queue.append((m[0], i, ids[i], ids[i + 1], m[1]))
        heapq.heapify(queue)
        while queue:
            _, i, left, right, new = pop(queue)
            j = after[i]
            if ids[i] != left or j < 0 or ids[j] != right:
                continue
            ids[i], ids[j] = new, -1
            k = after[j]
            after[i] = k
            if k >= 0:
                before[k] = i
                m = merges.get((new, ids[k]))
                if m:
                    push(queue, (m[0], i, new, ids[k], m[1]))
            h = before[i]
            if h >= 0:
                m = merges.get((ids[h], new))
                if m:
                    push(queue, (m[0], h, ids[h], new, m[1]))
        return [x for x in ids if x >= 0]

    def piece(self, s: str) -> tuple[int, ...]:
        ids = self.known.get(s)
        if ids is None:
            ids = tuple(self.merge(s.encode("utf-8", "replace")))
            if len(s) <= LONGEST_REMEMBERED:
                if len(self.known) >= REMEMBERED:
                    self.known.clear()
                self.known[s] = ids
        return ids

    def encode(self, text: str | None) -> list[int]:
        """Ids of a text; none for a null or empty text. Strings of special tokens are ordinary text."""
        out: list[int] = []
        if text:
            known, piece = self.known.get, self.piece
            for s in self.find(text):
                out += known(s) or piece(s)
        return out

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        known, piece = self.known.get, self.piece
        return sum([len(known(s) or piece(s)) for s in self.find(text)])

    def decode(self, ids: list[int]) -> str:
        return b"".join(self.strings[i] for i in ids).decode("utf-8", "replace")


_LOADED: dict[int, Bpe] = {}


def loaded(content: Broadcast) -> Bpe:
    """The encoder of a broadcast file, made once in a worker."""
    key = content._jbroadcast.id() if content._jbroadcast is not None else content._path  # noqa: SLF001
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = Bpe(content.value)
    return _LOADED[key]


def vocabulary(spark: SparkSession, folder: str = TOKENIZERS, name: str = VOCABULARY) -> Broadcast:
    """The vocabulary file, read here and sent to all workers; its size is checked."""
    path = Path(folder) / name
    if path.stat().st_size > LARGEST_FILE:
        raise ValueError(f"{path} is larger than {LARGEST_FILE} bytes")
    return spark.sparkContext.broadcast(path.read_bytes())


#: Splits of a text table of this many bytes in the mean are dealt out anew, as encoding is work per text.
LARGEST_SPLIT = 256 << 20
#: Spark's estimate of a size of which nothing is known.
UNKNOWN = (1 << 63) - 1


def dealt(documents: DataFrame, *cols: Column | str) -> DataFrame:
    """The columns, as the table is split; texts move only if its splits are fewer than the cores or too large.

    Then they are dealt out evenly by a hash, into twice as many parts as there are cores, or more by the size of the input.
    """
    df = documents.select(*cols)
    plan = df._jdf.queryExecution()  # noqa: SLF001
    if "Exchange" in plan.executedPlan().toString():
        return df  # comes from a shuffle, whose parts follow its size
    size = int(str(plan.optimizedPlan().stats().sizeInBytes()))
    size = 0 if size >= UNKNOWN else size
    cores, splits = documents.sparkSession.sparkContext.defaultParallelism, df.rdd.getNumPartitions()
    if splits >= cores and size <= splits * LARGEST_SPLIT:
        return df
    return df.repartition(max(2 * cores, 2 * size // LARGEST_SPLIT), F.xxhash64(*df.columns))


def slices(batch: pa.RecordBatch, column: str, most_bytes: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with limited text each (a single longer text is a part of its own)."""
    size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    begin = 0
    while begin < batch.num_rows:
        done = size[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(size, done + most_bytes, "right")))
        yield batch.slice(begin, end - begin)
        begin = end


def encoder(content: Broadcast) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(content)
        for whole in batches:
            for batch in slices(whole, "text"):
                lists = [np.array(bpe.encode(v.as_py()), np.int32) for v in batch.column("text")]
                offsets = np.r_[0, np.cumsum([len(x) for x in lists])].astype(np.int32)
                ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(lists) if lists else np.zeros(0, np.int32)))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), ids], ["doc_id", "ids"])

    return run


def encode(documents: DataFrame, folder: str = TOKENIZERS, name: str = VOCABULARY) -> DataFrame:
    """doc_id, ids: the ids of every text, without special tokens.

    Null and empty texts give an empty list; blank texts the ids of their blanks; very long
    words cost n log n. A null doc_id is kept, repeated rows come out as often. No rows give none.
    """
    content = vocabulary(documents.sparkSession, folder, name)
    return arrow_map(dealt(documents, F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), encoder(content), "doc_id long, ids array<int>")


def counter(content: Broadcast) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(content)
        for batch in batches:
            n = pa.array([bpe.count(v.as_py()) for v in batch.column("text")], pa.int64())
            names = [c for c in batch.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), n], [*names, "n_tokens"])

    return run


def count_tokens(documents: DataFrame, *keep: str, folder: str = TOKENIZERS, name: str = VOCABULARY) -> DataFrame:
    """The kept columns and n_tokens of every text (0 for null and empty ones)."""
    content = vocabulary(documents.sparkSession, folder, name)
    df = dealt(documents, *keep, F.col("text").cast("string").alias("text"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name != "text")
    return arrow_map(df, counter(content), f"{fields}, n_tokens long")


def decoder(content: Broadcast) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(content)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([None if v is None else bpe.decode(v) for v in batch.column("ids").to_pylist()], pa.string())], ["doc_id", "text"])

    return run


def decode(encoded: DataFrame, folder: str = TOKENIZERS, name: str = VOCABULARY) -> DataFrame:
    """doc_id, text from doc_id, ids; an empty list gives an empty text, a null one null."""
    content = vocabulary(encoded.sparkSession, folder, name)
    return arrow_map(encoded.select("doc_id", "ids"), decoder(content), "doc_id long, text string")


