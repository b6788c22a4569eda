"""Token counts by section: texts are encoded whole and once, and tokens dealt to sections by their places.

The tokens of a text are adjacent spans of its bytes; so are its sections (lines with the newline that ends
them, or given fields). Both lists are in order, so one merge joins the intervals. A token that lies in
several sections goes to one by an explicit rule: "start" (that of its first byte), "end" (that of its last)
or "most" (that with most of its bytes, the earlier of equals).
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm import textkit
from graphloom.llm.durable import map_arrow

RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the pattern by which this vocabulary cuts texts before merging.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
RULES = ("start", "end", "most")


@dataclass
class Vocabulary:
    ranks: dict[bytes, int]
    pattern: str = PATTERN

    @staticmethod
    def load(path: str = RANKS, pattern: str = PATTERN) -> Vocabulary:
        with open(path, "rb") as f:
            return Vocabulary({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}, pattern)


_ready: dict[tuple, tuple] = {}


def _encoding(v: Vocabulary):
    key = (v.pattern, len(v.ranks), hash(frozenset(v.ranks.items())))
    if key not in _ready:
        import tiktoken

        size = np.zeros(max(v.ranks.values(), default=0) + 1, np.int64)
        for piece, rank in v.ranks.items():
            size[rank] = len(piece)
        _ready[key] = (tiktoken.Encoding("own", pat_str=v.pattern, mergeable_ranks=v.ranks, special_tokens={}), size)
    return _ready[key]


def attribute(token_ends: np.ndarray, section_starts: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """The section of each token, and whether the token lies in more than one. Tokens end at token_ends, the
    first starts at 0; sections start at section_starts, the first at 0."""
    starts = np.concatenate(([0], token_ends[:-1])) if len(token_ends) else token_ends
    a = np.searchsorted(section_starts, starts, "right") - 1
    b = np.searchsorted(section_starts, token_ends - 1, "right") - 1
    if rule == "start":
        own = a
    elif rule == "end":
        own = b
    elif rule == "most":
        own = a.copy()
        bounds = np.append(section_starts, np.iinfo(np.int64).max)
        for t in np.flatnonzero(a != b):
            share = [min(token_ends[t], bounds[s + 1]) - max(starts[t], bounds[s]) for s in range(a[t], b[t] + 1)]
            own[t] = a[t] + int(np.argmax(share))
    else:
        raise ValueError(f"rule {rule}")
    return own, a != b


def token_counts(docs: DataFrame, vocabulary: Vocabulary, rule: str = "start", fields: list[str] | None = None) -> DataFrame:
    """(doc_id, section, first_char, end_char, n_tokens, n_crossing), a row for each section of docs.

    Sections are the lines of `text`, numbered from 0; with `fields` they are these columns, joined without
    anything between, and `section` is the place in that list. n_tokens are the tokens the rule gives to the
    section, n_crossing those of them that reach into others; empty lines at a text's end and empty fields
    are sections without tokens. The counts of a text add up to its tokens. Null texts and fields count as
    empty; an empty text has one empty section. Null and repeated ids keep their rows; other columns are not
    read.
    """
    if rule not in RULES:
        raise ValueError(f"rule {rule}")
    columns = fields or ["text"]
    names = ["doc_id", "section", "first_char", "end_char", "n_tokens", "n_crossing"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding, size = _encoding(vocabulary)
        for batch in batches:
            parts = [c.fill_null("") for c in batch.columns[1:]]
            for i, j, *_ in textkit.chunks(parts[0]):
                out: list[tuple] = []
                rows = [c.slice(i, j - i).to_pylist() for c in parts]
                for d, own in enumerate(zip(*rows, strict=True)):
                    text = "".join(own)
                    raw = np.frombuffer(text.encode(), np.uint8)
                    ends = np.cumsum(size[encoding.encode_ordinary(text)]) if text else np.empty(0, np.int64)
                    if fields:
                        starts = np.concatenate(([0], np.cumsum([len(x.encode()) for x in own])[:-1])).astype(np.int64)
                    else:
                        starts = np.concatenate(([0], np.flatnonzero(raw == 10) + 1)).astype(np.int64)
                    section, crossing = attribute(ends, starts, rule)
                    n = len(starts)
                    chars = np.concatenate(([0], np.cumsum((raw & 0xC0) != 0x80)))[np.append(starts, len(raw))]
                    out.append((np.full(n, d), np.arange(n), chars[:-1], chars[1:], np.bincount(section, minlength=n), np.bincount(section[crossing], minlength=n)))
                flat = [np.concatenate([x[k] for x in out]) for k in range(6)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i).take(pa.array(flat[0])), *[pa.array(x.astype(np.int32)) for x in flat[1:]]], names)

    schema = "doc_id long, section int, first_char int, end_char int, n_tokens int, n_crossing int"
    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), *[F.col(c).cast("string").alias(f"field{k}") for k, c in enumerate(columns)]), run, schema)
