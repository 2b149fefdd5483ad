"""Fill-in-the-middle texts, cut for all rows of a batch at once on Arrow's UTF-8 buffers.

A token is a word with the separators before it, or the separators that end a text. A look-up gives each byte's class;
a token ends where a word's byte stands beside a separator, or where a document ends. Sums of these ends, begun anew
in each document, rank them, and one sorted search finds the bytes at which all rows are cut. Bytes of characters
beyond ASCII are bytes of words, so cuts never split a character.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
#: Bytes of texts that are cut at a time; a longer text is taken alone.
STEP_BYTES = 4 << 20

_WORD, _BLANK, _REST = 1, 2, 3
_CLASS = np.full(256, _WORD, np.uint8)
_CLASS[[0x20, *range(0x09, 0x0E)]] = _BLANK
_CLASS[0x80:0xC0] = _REST  # later bytes of a character


def buffers_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, one after the other, and where each starts; the last entry is the end. Null is empty."""
    texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = texts.fill_null("")
    _, offsets, data = texts.buffers()
    starts = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[starts[0] : starts[-1]], starts - starts[0]


def steps(starts: np.ndarray, most: int = STEP_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows with ``most`` bytes at most, or one row."""
    row = 0
    while row < len(starts) - 1:
        end = max(int(np.searchsorted(starts, starts[row] + most, side="right")) - 1, row + 1)
        yield row, end
        row = end


def marks_in(raw: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the three marks stand in ``raw``, and the row of each."""
    if len(raw) < 3:
        return np.zeros((2, 0), np.int64)
    second = raw[1:-1]
    found = np.flatnonzero(
        (raw[:-2] == PREFIX[0]) & (raw[2:] == PREFIX[2]) & ((second == PREFIX[1]) | (second == SUFFIX[1]) | (second == MIDDLE[1]))
    )
    rows = np.searchsorted(starts, found, side="right") - 1
    inside = found + 3 <= starts[rows + 1]
    return found[inside], rows[inside]


def token_ends(raw: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where tokens end in ``raw``, in order, and how many of these each document has."""
    kind = _CLASS[raw]
    boundary = np.zeros(len(raw) + 1, bool)  # of the byte before a place and the one at it
    boundary[1:-1] = (kind[:-1] != _BLANK) & (kind[1:] == _BLANK)
    filled = starts[1:] > starts[:-1]
    boundary[starts[:-1]] = False  # what stands before a document is another one
    boundary[starts[1:][filled]] = True
    ends = np.flatnonzero(boundary)
    owner = np.searchsorted(starts, ends, side="left") - 1
    return ends, np.bincount(owner, minlength=len(starts) - 1)


def cuts(raw: np.ndarray, starts: np.ndarray, draws: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tokens of each document, and the bytes of ``raw`` where its prefix and its middle end: after the smaller and the larger
    of the two ``draws`` modulo one more than the tokens."""
    ends, n = token_ends(raw, starts)
    before = np.cumsum(n) - n
    ranks = np.arange(len(ends)) - np.repeat(before, n) + 1  # sums that begin anew in each document
    wide = int(n.max(initial=0)) + 1
    keys = np.repeat(np.arange(len(n)), n) * wide + ranks
    units = draws % (n + 1)
    out = []
    for k in (units.min(axis=0), units.max(axis=0)):
        at = np.searchsorted(keys, np.arange(len(n)) * wide + k)
        out.append(np.where(k == 0, starts[:-1], ends[np.minimum(at, len(ends) - 1)] if len(ends) else starts[:-1]))
    return n, *out


def filled(texts: pa.Array, digests: np.ndarray, rate: int, spm: int) -> tuple[list, ...]:
    """``n``, ``form``, ``prefix_chars``, ``middle_chars`` and ``output`` of each text; ``digests`` are four draws a row."""
    raw, starts = buffers_of(texts)
    out: tuple[list, ...] = ([], [], [], [], [])
    for row, end in steps(starts):
        data, at = raw[starts[row] : starts[end]], starts[row : end + 1] - starts[row]
        h = digests[:, row:end].astype(np.int64)
        n, low, high = cuts(data, at, h[:2])
        plain = (np.diff(at) == 0) | (h[2] % 100 >= rate)
        plain[marks_in(data, at)[1]] = True
        first = np.append(0, np.cumsum(_CLASS[data] != _REST))  # characters that start before each byte
        chars = [first[low] - first[at[:-1]], first[high] - first[low]]
        form = np.where(plain, "plain", np.where(h[3] % 100 < spm, "spm", "psm"))
        view = memoryview(data)
        for f, a, b, c, d in zip(form.tolist(), *(x.tolist() for x in (at[:-1], low, high, at[1:])), strict=True):
            if f == "plain":
                out[4].append(bytes(view[a:d]))
            elif f == "spm":
                out[4].append(b"".join((SUFFIX, view[c:d], PREFIX, view[a:b], MIDDLE, view[b:c])))
            else:
                out[4].append(b"".join((PREFIX, view[a:b], SUFFIX, view[c:d], MIDDLE, view[b:c])))
        out[0].extend(n.tolist())
        out[1].extend(form.tolist())
        for k in (0, 1):
            out[2 + k].extend(np.where(plain, None, chars[k].astype(object)).tolist())
    return out


def restored(outputs: pa.Array, forms: list[str | None]) -> list[bytes]:
    """The texts that outputs of these forms were made of, from the places of their marks."""
    raw, starts = buffers_of(outputs)
    back: list[bytes] = []
    for row, end in steps(starts):
        data, at = raw[starts[row] : starts[end]], starts[row : end + 1] - starts[row]
        some = np.array([f or "plain" for f in forms[row:end]])
        found, rows = marks_in(data, at)
        cut = some[rows] != "plain"
        places = found[cut].reshape(-1, 3)  # such an output has its three marks and no other
        view, k = memoryview(data), 0
        for f, a, d in zip(some.tolist(), at[:-1].tolist(), at[1:].tolist(), strict=True):
            if f == "plain":
                back.append(bytes(view[a:d]))
                continue
            one, two, three = places[k].tolist()
            k += 1
            parts = [view[one + 3 : two], view[two + 3 : three]]
            prefix, suffix = parts if f == "psm" else parts[::-1]
            back.append(b"".join((prefix, view[three + 3 : d], suffix)))
    return back


def transformed(
    docs: DataFrame, text: str = "text", doc_id: str = "doc_id", seed: int = 42, rate: int = 50, spm: int = 80
) -> DataFrame:
    """``doc_id``, ``n`` (tokens), ``form``, ``prefix_chars``, ``middle_chars`` and ``output``, one row per row of ``docs``.

    The draws are the first four groups of eight digits of the SHA-256 of ``seed:doc_id``, so reruns agree and equal ids
    are cut alike; a null id counts as the empty text. ``rate`` per cent of the texts are cut, of these ``spm`` per cent
    with the suffix in front. A null or empty text and one that holds a mark stay plain, as does what is not drawn; their
    chars are null. Prefix, middle and suffix can be empty. An empty table gives an empty result. Columns of other names,
    clashing ones too, are neither read nor kept. There is no shuffle.
    """
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit("")))
    taken = docs.select(F.col(doc_id).alias("doc_id"), F.unhex(F.sha2(key, 256)).alias("digest"), F.col(text).alias("text"))
    kind = taken.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            digests = np.frombuffer(b"".join(batch.column(1).to_pylist()), ">u4").reshape(-1, 8)[:, :4].T
            n, form, prefix, middle, output = filled(batch.column(2), digests, rate, spm)
            columns = [batch.column(0), pa.array(n, pa.int64()), pa.array(form), pa.array(prefix, pa.int64()), pa.array(middle, pa.int64())]
            texts = pa.array(output, pa.binary()).cast(pa.string(), safe=False)
            yield pa.RecordBatch.from_arrays([*columns, texts], names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    return taken.mapInArrow(run, f"doc_id {kind}, n bigint, form string, prefix_chars bigint, middle_chars bigint, output string")


def with_restored(made: DataFrame) -> DataFrame:
    """``made(doc_id, n, form, prefix_chars, middle_chars, output)`` with digests of the output and of the text that is rebuilt from it.

    A null output counts as empty.
    """
    names = ["doc_id", "n", "form", "prefix_chars", "middle_chars"]
    taken = made.select(*names, "output")
    schema = ", ".join(f"{c} {t}" for c, t in taken.dtypes[:-1]) + ", output_sha256 string, restored_sha256 string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, starts = buffers_of(batch.column(5))
            view, at = memoryview(raw), starts.tolist()
            one = [hashlib.sha256(view[a:b]).hexdigest() for a, b in zip(at[:-1], at[1:], strict=True)]
            two = [hashlib.sha256(x).hexdigest() for x in restored(batch.column(5), batch.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:5], pa.array(one, pa.string()), pa.array(two, pa.string())], names=[*names, "output_sha256", "restored_sha256"]
            )

    return taken.mapInArrow(run, schema)
