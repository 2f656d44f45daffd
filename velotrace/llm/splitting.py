"""Cutting long texts into overlapping pieces at natural boundaries (problem 10)."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from velotrace.llm.bpe import TOKENIZERS, VOCABULARY, dealt, loaded, slices, vocabulary
from velotrace.session import arrow_map

#: Boundaries by strength: end of a paragraph, a line, a sentence, a word; between letters and signs; inside a long word.
STRENGTHS = "PLSWTC"
LINE_ENDS = "\n\r\u0085  "
SENTENCE_ENDS = ".!?…。！？"
CLOSERS = "\"')]}”’»"
#: Stands for the tokens of a unit before its last.
INNER = "x"
#: A piece of text of more tokens is cut inside, where a token ends together with a character.
LONG_UNIT = 40


def strength(last: str, rest: str, breaks: int, bare: str) -> str:
    """How natural a cut is between the characters last and rest (none at the end), where two pieces of the tokenizer's pattern meet.

    breaks: line ends among the blanks up to there; bare: the last character that is no closing mark.
    """
    if last in LINE_ENDS:
        if rest and rest in LINE_ENDS:
            return "T"  # amid a row of line ends
        return "P" if breaks > 1 else "L"
    if not rest:
        return "P"
    if rest.isspace():
        return "S" if bare in SENTENCE_ENDS else "W"
    return "W" if last.isspace() else "T"


def line_ends(blanks: str, rest: str) -> int:
    """Line ends among blanks before rest; carriage return and line feed are one."""
    n = sum(map(blanks.count, LINE_ENDS)) - blanks.count("\r\n")
    return n - (blanks[-1] == "\r" and rest == "\n")


def stretches_of(raw: bytes, lengths: list[int]) -> tuple[list[int], list[int]]:
    """Tokens and bytes of the stretches of a long word, which end where a token ends together with a character. lengths: bytes of its tokens.

    A stretch of more than LONG_UNIT tokens goes on to be cut at its characters, which count as their bytes (a character never has more tokens).
    """
    weights, sizes, n, begin, end = [], [], 0, 0, 0
    for k in lengths:
        n, end = n + 1, end + k
        if end < len(raw) and raw[end] & 0xC0 == 0x80:
            continue
        each = [end - begin]
        if n > LONG_UNIT:
            each = np.diff([i for i in range(begin, end) if raw[i] & 0xC0 != 0x80], append=end).tolist()
        weights += [n] if n <= LONG_UNIT else each
        sizes += each
        n, begin = 0, end
    return weights, sizes


def units(text: str, parts: list[str], counts: list[int], lengths: Callable[[str], list[int]]) -> tuple[str, np.ndarray]:
    """Marks of a text, a letter per counted token, of which a unit's last is its boundary's strength; and the bytes up to there (0 at other tokens).

    parts and counts: the text by the tokenizer's pattern, and the tokens of each part; lengths gives the bytes of a part's tokens. Strengths that
    follow from the characters on both sides of an end alone are remembered.
    """
    marks, weights, sizes, breaks, bare = [], [], [], 0, " "
    remembered: dict[str, str] = {}
    plain = text.isascii()
    width = len if plain else (lambda s: len(s.encode("utf-8", "replace")))
    for s, n, following in zip(parts, counts, [*parts[1:], ""], strict=True):
        last, rest = s[-1], following[:1]
        if last.isspace():
            word = s.rstrip()
            breaks = line_ends(s[len(word) :], rest) + (0 if word else breaks)
        else:
            breaks = 0
        if last not in CLOSERS:
            bare = last
        elif opened := s.rstrip(CLOSERS):
            bare = opened[-1]
        sides = last + rest
        letter = remembered.get(sides)
        if letter is None:
            letter = strength(last, rest, breaks, bare)
            if last not in LINE_ENDS and last not in CLOSERS:
                remembered[sides] = letter
        if n <= LONG_UNIT:
            marks.append(INNER * (n - 1) + letter)
            weights.append(n)
            sizes.append(width(s))
            continue
        tokens, each = stretches_of(s.encode("utf-8", "replace"), lengths(s))
        marks += [INNER * (w - 1) + "C" for w in tokens[:-1]] + [INNER * (tokens[-1] - 1) + letter]
        weights += tokens
        sizes += each
    upto = np.cumsum(weights, dtype=np.int64)
    places = np.zeros(upto[-1] if len(upto) else 0, np.int32)
    places[upto - 1] = np.cumsum(sizes)
    return "".join(marks), places


MARKED = "doc_id long, text string, n_tokens long, marks string, places array<int>"


def marker(content: Broadcast, limit: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """doc_id, text to rows MARKED; texts within the limit get no marks."""
    names = [f.split()[0] for f in MARKED.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(content)
        lengths = lambda s: [len(bpe.strings[i]) for i in bpe.piece(s)]
        for whole in batches:
            for batch in slices(whole, "text", 1 << 20):
                rows = []
                for v in batch.column("text"):
                    text = v.as_py()
                    parts = bpe.find(text or "")
                    counts = [len(bpe.piece(s)) for s in parts]
                    n = sum(counts)
                    rows.append((n, *((None, None) if n <= limit else units(text, parts, counts, lengths))))
                arrays = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.int64(), pa.string(), pa.list_(pa.int32())))]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text"), *arrays], names)

    return run


def cutting_pattern(most: int) -> str:
    """Alternatives by strength: strong boundaries only in the last part of the room, weaker ones anywhere, and any unit's end at last."""
    half, most_of = most // 2, most * 3 // 4
    return "|".join(
        [f"[{STRENGTHS}{INNER}]{{{half},{most - 1}}}P", f"[{STRENGTHS}{INNER}]{{{half},{most - 1}}}[PL]", f"[{STRENGTHS}{INNER}]{{{half},{most - 1}}}[PLS]"]
        + [f"[{STRENGTHS}{INNER}]{{{most_of},{most - 1}}}[PLSW]", f"[{STRENGTHS}{INNER}]{{0,{most - 1}}}[PLSW]", f"[{STRENGTHS}{INNER}]{{0,{most - 1}}}[{STRENGTHS}]"]
    )


def marked(documents: DataFrame, limit: int, folder: str, name: str) -> DataFrame:
    content = vocabulary(documents.sparkSession, folder, name)
    return arrow_map(dealt(documents, F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), marker(content, limit), MARKED)


def split(documents: DataFrame, limit: int = 1000, overlap: int = 50, slack: int = 4, folder: str = TOKENIZERS, name: str = VOCABULARY) -> DataFrame:
    """doc_id, n_tokens (of the text), n_pieces, piece (from 0), start_byte, end_byte (of the text in UTF-8), boundary, piece_text.

    A text of at most limit tokens is one piece. Others are written as marks, one letter per token, and cut by one
    regular expression with bounded quantifiers: at the strongest boundary in the second half of the room,
    else at a weaker one, in words too long for that between tokens that end with a character. Every further piece begins up to overlap tokens before the
    cut, at the first boundary there. Room for new text is limit - overlap - slack, slack for pieces whose
    ends get other tokens than they had in the text. boundary: the strength at the end, see STRENGTHS.

    Null and empty texts give one piece as they are; repeated rows give repeated pieces. No rows give none.
    """
    if not 0 <= overlap < limit - slack - overlap:
        raise ValueError("overlap leaves no room")
    rows = marked(documents, limit, folder, name)
    short = rows.where(F.col("marks").isNull()).select(
        "doc_id", "n_tokens", F.lit(1).alias("n_pieces"), F.lit(0).alias("piece"), F.lit(0).alias("start_byte"), F.coalesce(F.octet_length("text"), F.lit(0)).alias("end_byte"), F.lit("P").alias("boundary"), F.col("text").alias("piece_text")
    )
    stretches = F.regexp_extract_all("marks", F.lit(cutting_pattern(limit - overlap - slack)), F.lit(0))
    sizes = F.transform(stretches, lambda s: F.struct(F.length(s).alias("n"), F.right(s, F.lit(1)).alias("boundary")))
    nothing = F.array().cast("array<struct<cut:int,boundary:string>>")
    running = F.aggregate(
        sizes, nothing, lambda acc, s: F.concat(acc, F.array(F.struct((F.coalesce(F.try_element_at(acc, F.lit(-1))["cut"], F.lit(0)) + s["n"]).alias("cut"), s["boundary"].alias("boundary"))))
    )
    cuts = rows.where(F.col("marks").isNotNull()).select("doc_id", "n_tokens", "places", F.col("text").cast("binary").alias("raw"), running.alias("cuts"))
    at = lambda token: F.element_at("places", token)

    def back(cut: Column) -> Column:
        """Place of the first unit's end at most overlap tokens before a cut, the text's begin if that is nearer."""
        near = F.transform(F.sequence(F.greatest(cut - overlap, F.lit(1)), cut), at)
        return F.when(cut > overlap, F.element_at(F.filter(near, lambda p: p > 0), 1)).otherwise(F.lit(0))

    def ends(c: Column, i: Column) -> Column:
        begin = F.when(i > 0, back(F.element_at("cuts", F.greatest(i, F.lit(1)))["cut"])).otherwise(F.lit(0))
        return F.struct(i.alias("piece"), begin.alias("start_byte"), at(c["cut"]).alias("end_byte"), c["boundary"].alias("boundary"))

    # places are bytes, whose part of a text is found without reading it from the start; pieces are made
    # inside the row, so that a long text is not repeated for each of them
    placed = cuts.select("doc_id", "n_tokens", "raw", F.transform("cuts", ends).alias("ends"))
    text = lambda e: F.substring(F.col("raw"), e["start_byte"] + 1, e["end_byte"] - e["start_byte"]).cast("string")
    pieces = F.transform("ends", lambda e: F.struct(e["piece"].alias("piece"), e["start_byte"].alias("start_byte"), e["end_byte"].alias("end_byte"), e["boundary"].alias("boundary"), text(e).alias("piece_text")))
    long = placed.select("doc_id", "n_tokens", F.size("ends").alias("n_pieces"), F.explode(pieces).alias("p")).select("doc_id", "n_tokens", "n_pieces", "p.*")
    return short.unionByName(long)


def split_documents(documents: DataFrame, limit: int = 1000, **how: object) -> DataFrame:
    """doc_id of the documents that split() cuts, once each."""
    return split(documents, limit, **how).where((F.col("piece") == 1) & F.col("doc_id").isNotNull()).select("doc_id").distinct()
