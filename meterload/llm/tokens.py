"""Token counts of a document's sections, by encoding each document once.

A section's tokens are not what its text gives when encoded alone: tokens reach over the borders. So each document is
encoded as a whole, the byte span of every token follows from the lengths of the vocabulary's entries, and the
token spans are interval-joined to the section spans (both are sorted, so a binary search does it).

Sections of a text are its lines, each with the line feed that ends it; empty lines belong to the section before
them (at the start of a text, to the first one). A section has a kind: heading (the first line, if it is short and another
one follows), table (at least two bars), list (begins with a dash, star or number) or prose.

A token that crosses a border goes to one section, by an explicit rule:
* "majority" (default): the section that has most of its bytes, the first one of equals;
* "start": the section that has its first byte.
Counts of a document's sections always add up to its number of tokens. `share` splits crossing tokens by bytes
instead; it adds up to the same number. `n_crossing` counts tokens that the section has in part.

Defined cases: a null or empty text has no section and gives no row. Rows that repeat a doc_id give their sections
each. Strings that look like special tokens are ordinary text. Other columns are not read. Very long words are
encoded in whole.

The vocabulary is a file of byte-level BPE ranks whose path is a parameter. It is read on the driver and sent to the
executors; its size is fixed (VOCABULARY_LIMIT is checked).
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterload.llm.common import as_bytes

DEFAULT_VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: How byte-level BPE of this family cuts a text before merging (a fixed value of the vocabulary).
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"
VOCABULARY_LIMIT = 64 << 20
HEADING = 120
RULES = ("majority", "start")

SCHEMA = ("doc_id long, section int, kind string, byte_start long, byte_end long, n_chars long, n_tokens long, "
          "n_crossing long, share double")


class Encoder:
    """A vocabulary on a worker: token ids and the number of bytes of each id."""

    _kept: dict[int, Encoder] = {}

    def __init__(self, data: bytes, pattern: str) -> None:
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in data.splitlines() if line)}
        self.encoding = tiktoken.Encoding("given", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.sizes = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, rank in ranks.items():
            self.sizes[rank] = len(token)

    @classmethod
    def of(cls, data: bytes, pattern: str) -> Encoder:
        key = hash((data, pattern))
        if key not in cls._kept:
            cls._kept[key] = cls(data, pattern)
        return cls._kept[key]

    def ends(self, text: str) -> np.ndarray:
        """Byte offsets at which the tokens of a text end."""
        return np.cumsum(self.sizes[self.encoding.encode_ordinary(text)])


def section_starts(text: bytes) -> np.ndarray:
    """Byte offsets at which the sections of a text start; the first is 0."""
    raw = np.frombuffer(text, np.uint8)
    breaks = np.flatnonzero(raw == 10) + 1
    starts = np.append(0, breaks[breaks < len(raw)])
    # A line that holds nothing but its line feed belongs to the section before it, or after it at the start.
    empty = raw[starts] == 10
    filled = starts[~empty]
    return np.append(0, filled[filled > 0][1 if empty[0] else 0:]) if len(filled) else np.zeros(1, np.int64)


def kind_of(line: str, first: bool, more: bool) -> str:
    line = line.strip()
    if line.count("|") >= 2:
        return "table"
    if line[:2] in ("- ", "* ", "• ") or (line[:1].isdigit() and line.lstrip("0123456789")[:2] in (". ", ") ")):
        return "list"
    return "heading" if first and more and len(line) <= HEADING else "prose"


def attribute(ends: np.ndarray, starts: np.ndarray, size: int, rule: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """n_tokens, n_crossing and share per section, from token ends and section starts."""
    n = len(starts)
    begins = np.append(0, ends[:-1])
    first = np.searchsorted(starts, begins, side="right") - 1
    last = np.searchsorted(starts, ends, side="left") - 1
    stops = np.append(starts[1:], size)
    crossing = np.flatnonzero(last > first)
    owner = first.copy()
    share = np.bincount(np.delete(first, crossing), minlength=n).astype(float)
    parts = np.zeros(n, np.int64)
    for t in crossing.tolist():
        at = np.arange(first[t], last[t] + 1)
        held = np.minimum(stops[at], ends[t]) - np.maximum(starts[at], begins[t])
        share[at] += held / held.sum()
        parts[at] += 1
        if rule == "majority":
            owner[t] = at[int(np.argmax(held))]
    return np.bincount(owner, minlength=n), parts, share


def section_tokens(
    docs: DataFrame, vocabulary: str = DEFAULT_VOCABULARY, pattern: str = PATTERN, rule: str = "majority",
) -> DataFrame:
    """One row per section of each document, with the columns of SCHEMA."""
    if rule not in RULES:
        raise ValueError(f"rule is one of {RULES}")
    if os.path.getsize(vocabulary) > VOCABULARY_LIMIT:
        raise ValueError("the vocabulary is larger than VOCABULARY_LIMIT")
    with open(vocabulary, "rb") as file:
        shared = docs.sparkSession.sparkContext.broadcast(file.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.of(shared.value, pattern)
        for batch in batches:
            out: list[list] = [[] for _ in SCHEMA.split(", ")]
            for doc, raw in zip(batch.column("doc_id").to_pylist(), as_bytes(batch, "text")):
                if not raw:
                    continue
                starts = section_starts(raw)
                stops = np.append(starts[1:], len(raw))
                tokens, parts, share = attribute(encoder.ends(raw.decode()), starts, len(raw), rule)
                lines = [raw[a:b].decode() for a, b in zip(starts.tolist(), stops.tolist())]
                n = len(starts)
                columns = ([doc] * n, range(n), [kind_of(s, i == 0, n > 1) for i, s in enumerate(lines)], starts.tolist(),
                           stops.tolist(), [len(s) for s in lines], tokens.tolist(), parts.tolist(), share.tolist())
                for column, values in zip(out, columns):
                    column.extend(values)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, type=f.type) for c, f in zip(out, _ARROW)], schema=_ARROW)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, SCHEMA)


_ARROW = pa.schema([
    ("doc_id", pa.int64()), ("section", pa.int32()), ("kind", pa.string()), ("byte_start", pa.int64()),
    ("byte_end", pa.int64()), ("n_chars", pa.int64()), ("n_tokens", pa.int64()), ("n_crossing", pa.int64()),
    ("share", pa.float64())])
