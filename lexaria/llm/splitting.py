"""Cutting oversized texts into pieces at natural boundaries."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lexaria.llm.tokens import TOKENIZER, encoding, token_lengths


def boundary_strengths(raw: bytes, offsets: np.ndarray) -> np.ndarray:
    """How strongly the text pauses before each byte offset: 6 before a heading, 5 at a blank line, 4 at a line end, 3 after a sentence, 2 after a clause, 1 between words, 0 inside one, -1 inside a character."""
    b = np.frombuffer(b"\0\0" + raw + b"\0", dtype=np.uint8)
    at = offsets + 2
    here, last, last2 = b[at], b[at - 1], b[at - 2]
    space = np.isin(here, (32, 9, 10, 13))
    out = np.zeros(len(offsets), dtype=np.int8)
    out[space | np.isin(last, (32, 9, 13))] = 1
    out[space & np.isin(last, (44, 58, 59))] = 2
    # the last byte of the three-byte ellipsis counts as a stop
    out[space & (np.isin(last, (46, 33, 63)) | ((last == 0xA6) & (last2 == 0x80)))] = 3
    out[(last == 10) & (here != 10)] = 4
    out[(last == 10) & (here != 10) & (last2 == 10)] = 5
    out[(last == 10) & np.isin(here, (35, 61))] = 6
    out[(here & 0xC0) == 0x80] = -1
    return out


class RangeMax:
    """Sparse table: position of the largest value in any range up to ``width`` long, the last of equals."""

    def __init__(self, values: np.ndarray, width: int):
        self.values = values
        self.levels = [np.arange(len(values))]
        span = 1
        while 2 * span <= min(width, len(values)):
            a, b = self.levels[-1][:-span], self.levels[-1][span:]
            self.levels.append(np.where(values[b] >= values[a], b, a))
            span *= 2

    def query(self, lo: int, hi: int) -> int:
        """Position in [lo, hi]."""
        k = (hi - lo + 1).bit_length() - 1
        a, b = int(self.levels[k][lo]), int(self.levels[k][hi - (1 << k) + 1])
        return b if self.values[b] >= self.values[a] else a


def cut_points(strengths: np.ndarray, n: int, limit: int, overlap: int) -> list[tuple[int, int]]:
    """Token ranges of the pieces of a text of ``n`` tokens. ``strengths[i]`` is the pause before token i.

    Each piece ends at the strongest boundary between half the limit (always beyond the overlap, so that every step goes forward) and the limit,
    the rightmost of equals; the next begins ``overlap`` tokens before that end.
    """
    if n <= limit:
        return [(0, n)]
    least = min(limit, max(limit // 2, overlap + 1))
    table = RangeMax(strengths, limit - least + 1)
    pieces, start = [], 0
    while start + limit < n:
        end = table.query(start + least, start + limit)
        pieces.append((start, end))
        start = end - overlap
    pieces.append((start, n))
    return pieces


def split_texts(df: DataFrame, id_col: str, text_col: str, limit: int, overlap: int, *, path: str = TOKENIZER) -> DataFrame:
    """(id, piece, pieces, start, n_tokens, piece_text): the pieces of every text, in order from 0.

    Pieces have at most ``limit`` tokens and neighbours share ``overlap`` tokens. A token that is part of a character at a cut
    belongs wholly to the text on both sides as bytes; cuts inside a character are only taken where the window has no other.
    ``start`` is the first token's number; a text within the limit is one piece. NULL texts give no rows, empty
    texts one empty piece; repeated rows are split once per row.
    """
    if not 0 <= overlap < limit:
        raise ValueError("0 <= overlap < limit must hold")
    names = [id_col, "piece", "pieces", "start", "n_tokens", "piece_text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e, lengths = encoding(path), token_lengths(path)
        for b in batches:
            ids, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            out: list[list] = [[] for _ in names]
            for doc, text in zip(ids, texts):
                if text is None:
                    continue
                raw = text.encode("utf-8", "surrogatepass")
                ends = np.cumsum(lengths[np.array(e.encode_ordinary(text), dtype=np.int64)])
                n = len(ends)
                offsets = np.r_[0, ends]
                pieces = cut_points(boundary_strengths(raw, offsets) if n > limit else np.zeros(0), n, limit, overlap)
                for k, (a, z) in enumerate(pieces):
                    for x, v in zip(out, (doc, k, len(pieces), a, z - a, raw[offsets[a] : offsets[z]].decode("utf-8", "ignore"))):
                        x.append(v)
            yield pa.record_batch([pa.array(out[0], b.schema.field(0).type), *(pa.array(x, pa.int32()) for x in out[1:5]), pa.array(out[5], pa.string())], names=names)

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col), F.col(text_col)).mapInArrow(run, f"`{id_col}` {kind}, piece int, pieces int, start int, n_tokens int, piece_text string")
