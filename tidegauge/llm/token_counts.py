"""Token counts of the sections of a document, by offset-mapped attribution.

A whole document is encoded once, so tokens are those that a model sees. The byte
lengths of its tokens add up to spans, spans are mapped to characters, and a merge
of two sorted lists - token starts and section bounds - joins each token to the
section or sections that it overlaps. A token that crosses a boundary is allotted
by one of three rules.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Pre-tokenisation pattern that goes with a vocabulary of ranks, unless another is given.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: "first": to the section with its first character; "most": to the one with most of
#: its characters, the earlier on a tie; "shared": in proportion to the characters.
RULES = ("first", "most", "shared")


@cache
def _encoding(path: str, pattern: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    lengths = np.zeros(max(ranks.values()) + 1, np.int64)
    for token, rank in ranks.items():
        lengths[rank] = len(token)
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), lengths


def token_spans(text: str, path: str, pattern: str = PATTERN) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends, in characters, of the tokens of the whole text.

    A token that starts or ends within a character counts as if it started or ended
    before that character's end: a character belongs to the token with its last byte.
    """
    encoding, lengths = _encoding(path, pattern)
    ids = np.asarray(encoding.encode_ordinary(text), np.int64)
    ends = np.cumsum(lengths[ids])
    raw = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    if len(raw) == len(text):
        chars = ends
    else:
        complete = np.append((raw[1:] & 0xC0) != 0x80, True) if len(raw) else np.zeros(0, bool)
        chars = np.append(0, np.cumsum(complete))[ends]
    return np.append(0, chars[:-1])[: len(chars)], chars


def allotted(starts: np.ndarray, ends: np.ndarray, bounds: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of each section and how many of them cross a boundary (counted where allotted,
    under "shared" in each section touched). ``bounds`` are the section ends, in order;
    section k is [bounds[k-1], bounds[k]). A token without a character of its own goes to the section at its start."""
    n = len(bounds)
    if not n or not len(starts):
        return np.zeros(n), np.zeros(n, np.int64)
    first = np.minimum(np.searchsorted(bounds, starts, side="right"), n - 1)
    last = np.minimum(np.searchsorted(bounds, np.maximum(ends - 1, starts), side="right"), n - 1)
    crossing = last > first
    if rule == "first" or not crossing.any():
        to = first
        return np.bincount(to, minlength=n).astype(float), np.bincount(to[crossing], minlength=n)
    tokens = np.bincount(first[~crossing], minlength=n).astype(float)
    crossed = np.zeros(n, np.int64)
    for s, e, a, b in zip(starts[crossing], ends[crossing], first[crossing], last[crossing], strict=True):
        cuts = np.concatenate([[s], bounds[a:b], [e]])
        inside = np.diff(cuts)
        if rule == "shared":
            tokens[a : b + 1] += inside / (e - s)
            crossed[a : b + 1] += inside > 0
        else:
            tokens[a + int(inside.argmax())] += 1
            crossed[a + int(inside.argmax())] += 1
    return tokens, crossed


def section_tokens(
    docs: DataFrame,
    vocabulary: str,
    rule: str = "first",
    pattern: str = PATTERN,
    text: str = "text",
    doc_id: str = "doc_id",
    sections: str | None = None,
) -> DataFrame:
    """``doc_id``, ``section`` (from 0), ``char_start``, ``char_end``, ``n_tokens`` and ``n_crossing``.

    ``vocabulary`` is the path, on every executor, of a file of ranks. Sections are
    the lines of the text, each with its line feed, unless ``sections`` names a
    column with an array of section ends in characters (nulls ignored; sorted; the
    last section always ends with the text). Token counts of a document's sections
    add up to its tokens. Null and empty texts have no sections and so no rows;
    repeated rows are counted each; an empty table gives an empty result. A null id is kept. Columns of other names, also those of
    the result, are not read.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    taken = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("_text"), *([F.col(sections).alias("_ends")] if sections else []))
    kind = taken.dtypes[0][1]
    schema = f"doc_id {kind}, section int, char_start bigint, char_end bigint, n_tokens double, n_crossing bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, parts = [], []
            for i, value in enumerate(batch.column(1)):
                body = value.as_py()
                if not body:
                    continue
                if sections:
                    given = batch.column(2)[i].as_py() or []
                    bounds = np.array(sorted({min(max(x, 0), len(body)) for x in given if x is not None} | {len(body)}), np.int64)
                    bounds = bounds[bounds > 0]
                else:
                    points = np.frombuffer(body.encode("utf-32-le", "surrogatepass"), np.uint32)
                    bounds = np.flatnonzero(points == 10) + 1
                    if not len(bounds) or bounds[-1] != len(body):
                        bounds = np.append(bounds, len(body))
                tokens, crossing = allotted(*token_spans(body, vocabulary, pattern), bounds, rule)
                rows.append(np.full(len(bounds), i))
                parts.append((np.arange(len(bounds)), np.append(0, bounds[:-1]), bounds, tokens, crossing))
            if not rows:
                continue
            columns = [np.concatenate(c) for c in zip(*parts, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(np.concatenate(rows))),
                    pa.array(columns[0], pa.int32()),
                    *[pa.array(c, pa.int64()) for c in columns[1:3]],
                    pa.array(columns[3], pa.float64()),
                    pa.array(columns[4], pa.int64()),
                ],
                names=["doc_id", "section", "char_start", "char_end", "n_tokens", "n_crossing"],
            )

    return taken.mapInArrow(run, schema)
