"""Token counts of whole texts; huge documents by overlapping chunks that are spliced where both agree for sure."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import texts
from .packing import groups_of
from .tokens import ByteCounts, byte_counts, stable

#: Characters of a chunk and of the overlap of two chunks; texts of up to one chunk are encoded whole.
CHUNK, OVERLAP = 32_768, 512
#: No boundary this close to either end of the overlap is trusted: a special string might be cut there.
EDGE = 64


def spliced(counts: ByteCounts, text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> int:
    """Tokens of text from its chunks alone.

    A boundary that both chunks have is taken if it is stable (see stable()): every tokenization of the text has it
    then, so the tokens before it come from the left chunk, those after it from the right one. Where the overlap holds
    none it is doubled, and once it fills the left chunk that one is doubled, so that what is encoded again stays in
    proportion to the text.
    """
    total, start, lead = 0, 0, 0  # lead: tokens of the left chunk that an earlier chunk has counted
    end = min(chunk, len(text))
    at, before, n = counts.bounds(text[:end])
    while end < len(text):
        wide, p = overlap, None
        while end < len(text):
            s = max(start, end - wide)
            if s == start:
                end = min(len(text), end + max(chunk, end - start))
                at, before, n = counts.bounds(text[start:end])
                continue
            e = min(len(text), s + chunk + wide)
            at2, before2, n2 = counts.bounds(text[s:e])
            common = np.intersect1d(at + start, at2 + s, assume_unique=True)
            common = common[(common > s + EDGE) & (common < end - EDGE)]
            if (p := next((x for x in common[::-1].tolist() if stable(text, x)), None)) is not None:
                break
            wide *= 2
        if p is None:
            break
        total += int(before[np.searchsorted(at, p - start)]) - lead
        lead = int(before2[np.searchsorted(at2, p - s)])
        start, end, at, before, n = s, e, at2, before2, n2
    return total + n - lead


def token_counts(docs: DataFrame, path: str, *, limit: int = 1024, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens and over_limit (n_tokens > limit) of every whole text, without a shuffle.

    Null and empty texts have 0 bytes and 0 tokens; a null doc_id is kept; repeated rows give a row each; an empty table
    gives none. Columns besides doc_id and text are ignored. No begin, end or added special tokens; special strings
    inside a text count as the library's default takes them.
    """

    def run(batches):
        counts = byte_counts(path)
        for batch in batches:
            for piece in groups_of(batch):
                own = piece.column("text").to_pylist()
                whole = iter(counts.whole([t for t in own if len(t) <= chunk]))
                n = np.array([next(whole) if len(t) <= chunk else spliced(counts, t, chunk, overlap) for t in own], np.int64)
                size = np.array([len(t.encode()) for t in own], np.int64)
                yield pa.RecordBatch.from_arrays([piece.column("doc_id"), pa.array(size), pa.array(n), pa.array(n > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    docs = texts(docs)
    return docs.mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, n_bytes long, n_tokens long, over_limit boolean")
