"""Token counts of sections: a document is encoded once, whole, and its tokens are joined to its sections.

Tokens' spans follow from the ids, as each stands for a known number of bytes. Sections are given as spans,
or are the text's lines (each with the newline that ends it). An interval join by binary search finds the
section where a token starts and the one where it ends. A token within one section counts there; one that
crosses a boundary counts where most of its bytes lie, and in the earlier section on a tie. Counts of a
document's sections, with what lies outside all of them, add up to its tokens.

Cases: a null or empty text has no sections by lines and thus no rows; tokens outside all given sections
count in section -1; repeated rows come back each; a null doc_id stays null; an empty table gives
an empty result; other columns are not read. Sections must be ascending and must not overlap.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from cohesio.llm import byte_bpe


def line_starts(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends (in bytes) of the lines of a text; a last line without characters is none."""
    ends = np.flatnonzero(np.frombuffer(raw, dtype=np.uint8) == 10) + 1
    if not len(ends) or ends[-1] != len(raw):
        ends = np.append(ends, len(raw))
    return np.concatenate([[0], ends[:-1]]), ends


def attributed(lengths: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The section of each token (-1: none), given tokens' lengths and sections' spans, in bytes."""
    stop = np.cumsum(lengths)
    begin = stop - lengths
    first = np.searchsorted(starts, begin, side="right") - 1  # the last section that starts at or before it
    last = np.searchsorted(starts, stop - 1, side="right") - 1
    got = np.where((first >= 0) & (begin < ends[first]), first, -1)
    for t in np.flatnonzero(first != last).tolist():
        most, best = 0, -1
        for k in range(max(int(first[t]), 0), int(last[t]) + 1):
            common = min(int(stop[t]), int(ends[k])) - max(int(begin[t]), int(starts[k]))
            if common > most:
                most, best = common, k
        got[t] = best
    return got


def counts(docs: DataFrame, sections: str | None = None, tokenizer: str | None = None) -> DataFrame:
    """doc_id, section, start, end (code points), n_tokens: a row for each section, from 0, of each document.

    sections names a column array<struct<start, end>> in code points; without it sections are lines.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = byte_bpe.load(tokenizer)
        for whole in batches:
            for at in range(0, whole.num_rows, 2000):
                batch = whole.slice(at, 2000)
                texts = [t or "" for t in batch.column(1).to_pylist()]
                given = batch.column(2).to_pylist() if sections else [None] * len(texts)
                keys, out = [], [[], [], [], []]
                for key, text, ids, own in zip(batch.column(0).to_pylist(), texts, encoder.encode(texts), given):
                    raw = text.encode()
                    if not raw and not own:
                        continue
                    bytes_ = np.frombuffer(raw, dtype=np.uint8)
                    chars = np.concatenate([[0], np.cumsum((bytes_ & 0xC0) != 0x80)])  # code points before each byte
                    if own is None and not sections:
                        starts, ends = line_starts(raw)
                    else:
                        place = np.append(np.flatnonzero((bytes_ & 0xC0) != 0x80), len(raw))
                        starts = place[[min(s["start"], len(place) - 1) for s in own or []]]
                        ends = place[[min(s["end"], len(place) - 1) for s in own or []]]
                    if len(starts):
                        section = attributed(encoder.n_bytes[np.frombuffer(ids, dtype="<u4")], starts, ends)
                    else:
                        section = np.full(len(ids) // 4, -1)
                    n = np.bincount(section + 1, minlength=len(starts) + 1)
                    lo = 0 if n[0] else 1
                    numbers = np.arange(lo - 1, len(starts))
                    none = [-1] if lo == 0 else []
                    keys += [key] * len(numbers)
                    for column, values in zip(out, (numbers, np.concatenate([none, chars[starts]]), np.concatenate([none, chars[ends]]), n[lo:])):
                        column.append(values)
                if out[0]:
                    yield pa.RecordBatch.from_arrays([pa.array(keys, type=pa.int64()), *(pa.array(np.concatenate(c).astype(np.int64)) for c in out)], names=["doc_id", "section", "start", "end", "n_tokens"])

    rows = docs.select("doc_id", "text", *([sections] if sections else []))
    return rows.mapInArrow(task, "doc_id long, section long, start long, end long, n_tokens long")
