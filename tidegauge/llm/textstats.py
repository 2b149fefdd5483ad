"""Statistics of one text, on its UTF-8 bytes. ``bytes.split()`` cuts at exactly the word separators."""

from __future__ import annotations

import numpy as np

#: Odd multipliers of a rolling hash; any odd numbers do.
_FACTORS = (np.arange(1, 65, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)

NAMES = (
    "n_words",
    "word_chars",
    "n_symbols",
    "n_dup_lines",
    "n_repeat_words",
    "symbol_rate",
    "upper_rate",
    "digit_rate",
    "mark_rate",
    "end_rate",
    "bar_rate",
    "distinct_rate",
    "top_word_rate",
    "stutter_rate",
    "repeat_rate",
    "dup_line_rate",
    "word_length",
    "line_words",
    "log_words",
)
BASE = NAMES[:5]

_CLASS = np.zeros(256, np.uint8)
for _i, _chars in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b"!?", b".,;:", b"|", b"#*$%&<>"), 1):
    _CLASS[list(_chars)] = _i


def repeated_words(words: list[bytes], width: int = 8) -> int:
    """Words that lie in a window of ``width`` words found twice or more in the text."""
    n = len(words) - width + 1
    if n < 2:
        return 0
    hashes = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    rolled = hashes[:n] * _FACTORS[0]
    for k in range(1, width):
        rolled = rolled + hashes[k : k + n] * _FACTORS[k]
    order = np.sort(rolled)
    if not (order[1:] == order[:-1]).any():
        return 0
    # equal windows have equal hashes; whether equal hashes are equal windows is decided exactly
    seen: dict[bytes, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words))
    length = 1
    while length * 2 <= width:  # ids of runs of twice the length, from pairs of ids
        m = len(ids) - length
        ids = np.unique(ids[:m] * (int(ids.max()) + 1) + ids[length:], return_inverse=True)[1]
        length *= 2
    if length < width:
        m = len(words) - width + 1
        ids = np.unique(ids[:m] * (int(ids.max()) + 1) + ids[width - length : width - length + m], return_inverse=True)[1]
    twice = np.bincount(ids)[ids] > 1
    cover = np.zeros(len(words) + 1, np.int64)
    np.add.at(cover, np.flatnonzero(twice), 1)
    np.add.at(cover, np.flatnonzero(twice) + width, -1)
    return int((np.cumsum(cover[:-1]) > 0).sum())


def stats(text: str | None) -> tuple[float, ...]:
    """Values in the order of NAMES; a null text has no words."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    n = len(words)
    blank = sum(raw.count(c) for c in (b" ", b"\t", b"\n", b"\x0b", b"\x0c", b"\r"))
    chars = len(text or "") - blank
    lines = [x for x in raw.split(b"\n") if x.strip()]
    dup_lines = len(lines) - len(set(lines))
    repeats = repeated_words(words)
    kinds = np.bincount(_CLASS[np.frombuffer(raw, np.uint8)], minlength=7)
    symbols = int(kinds[5] + kinds[6])
    per_char, per_word = 1 / max(chars, 1), 1 / max(n, 1)
    counts = np.unique(np.fromiter(map(hash, words), np.int64, n), return_counts=True)[1] if n else np.zeros(1)
    stutter = sum(map(bytes.__eq__, words, words[1:]))
    return (
        n,
        chars,
        symbols,
        dup_lines,
        repeats,
        symbols * per_char,
        int(kinds[1]) * per_char,
        int(kinds[2]) * per_char,
        int(kinds[3]) * per_word,
        int(kinds[4]) * per_word,
        int(kinds[5]) * per_word,
        len(counts) / max(n, 1) ** 0.9 if n else 0.0,
        int(counts.max()) * per_word,
        stutter * per_word,
        repeats * per_word,
        dup_lines / max(len(lines), 1),
        chars * per_word,
        n / max(len(lines), 1),
        float(np.log1p(n)),
    )
