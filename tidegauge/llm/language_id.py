"""Language identification with hyperdimensional profiles.

Each letter owns a random +/-1 vector, drawn from its code point. An n-gram binds
its letters' vectors, each rotated by its place, with a product. A text bundles
(adds) the vectors of its n-grams; a language's prototype bundles the unit vectors
of its texts. A text gets the language whose prototype has the largest cosine.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DIM = 1024
SEED = 20_240_501
#: Letters of text that one numpy step takes; longer texts are taken in pieces.
STEP_LETTERS = 400_000
STEP_TEXTS = 48
#: Letters whose vectors a worker keeps; beyond, it starts anew.
KEPT_LETTERS = 20_000


@cache
def _is_letter() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def _spaced(text: str, first: bool, last: bool) -> np.ndarray:
    """Code points of the letters, lower case, with one 0 for whatever stands between words."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    points = np.concatenate([[0] * first, np.where(_is_letter()[points], points, 0), [0] * last]).astype(np.int64)
    return points[np.concatenate([[True], (points[1:] != 0) | (points[:-1] != 0)])]


class Encoder:
    """Turns texts into bundled n-gram vectors. Code 0 is the gap between words."""

    def __init__(self, dim: int = DIM, n: int = 3, seed: int = SEED):
        self.dim, self.n, self.seed = dim, n, seed
        self._clear()

    def _clear(self) -> None:
        self.code_of = np.zeros(0x110000, np.int32)
        self.used = 1
        self.rotated = [np.empty((64, self.dim), np.int8) for _ in range(self.n)]
        self._put(0, 0)

    def _put(self, code: int, point: int) -> None:
        if code >= len(self.rotated[0]):
            self.rotated = [np.concatenate([m, np.empty_like(m)]) for m in self.rotated]
        rng = np.random.Generator(np.random.Philox(key=[self.seed, point]))
        vector = (rng.integers(0, 2, self.dim, np.int8) * 2 - 1).astype(np.int8)
        for place in range(self.n):
            self.rotated[place][code] = np.roll(vector, self.n - 1 - place)

    def _coded(self, points: np.ndarray) -> np.ndarray:
        """Codes of letters (0 stays 0); new letters get vectors."""
        new = np.unique(points[(self.code_of[points] == 0) & (points != 0)])
        if self.used + len(new) > KEPT_LETTERS and self.used > 1:
            self._clear()
            new = np.unique(points[points != 0])
        for point in new.tolist():
            self._put(self.used, point)
            self.code_of[point] = self.used
            self.used += 1
        return self.code_of[points]

    def bundle(self, texts: list[str | None]) -> np.ndarray:
        """One row per text; a row of zeros where the text is null or has no letter."""
        out = np.zeros((len(texts), self.dim), np.float64)
        rows: list[int] = []
        parts: list[np.ndarray] = []
        size = 0
        for i, text in enumerate(texts):
            text = text or ""
            for at in range(0, len(text), STEP_LETTERS):
                # n - 1 letters are read again, so that no n-gram is lost between pieces
                piece = text[max(0, at - self.n + 1) : at + STEP_LETTERS]
                points = _spaced(piece, at == 0, at + STEP_LETTERS >= len(text))
                if points.any():
                    rows.append(i)
                    parts.append(points)
                    size += len(points)
                if size >= STEP_LETTERS or len(parts) >= STEP_TEXTS:
                    self._add(out, rows, parts)
                    rows, parts, size = [], [], 0
        if parts:
            self._add(out, rows, parts)
        return out

    def _add(self, out: np.ndarray, rows: list[int], parts: list[np.ndarray]) -> None:
        codes = self._coded(np.concatenate(parts)).astype(np.int64)
        owner = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
        last = len(codes) - self.n + 1
        if last <= 0:
            return
        gram = np.zeros(last, np.int64)
        for place in range(self.n):
            gram = gram * self.used + codes[place : place + last]
        inside = owner[:last] == owner[self.n - 1 :]
        gram, owner = gram[inside], owner[:last][inside]
        if self.used**self.n <= 4_000_000:
            seen = np.bincount(gram, minlength=1) > 0
            grams, column = np.flatnonzero(seen), np.cumsum(seen)[gram] - 1
        else:
            grams, column = np.unique(gram, return_inverse=True)
        rest, bound = grams, None
        for place in range(self.n - 1, -1, -1):
            vectors = self.rotated[place][rest % self.used]
            rest = rest // self.used
            bound = vectors if bound is None else np.multiply(bound, vectors, out=bound)
        counts = np.bincount(owner * len(grams) + column, minlength=len(parts) * len(grams))
        bundled = counts.reshape(len(parts), -1).astype(np.float32) @ bound.astype(np.float32)
        np.add.at(out, rows, bundled)


def _unit(vectors: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(vectors, axis=1, keepdims=True)
    return np.divide(vectors, norm, out=np.zeros_like(vectors), where=norm > 0)


def prototypes(
    docs: DataFrame,
    text: str = "text",
    lang: str = "lang",
    per_language: int = 2_000,
    dim: int = DIM,
    n: int = 3,
) -> dict[str, np.ndarray]:
    """Prototype of each language of ``docs``, a table of labelled texts.

    Rows with a null language are left out. About ``per_language`` texts of each
    language are bundled, picked by a hash of the text (all, where there are fewer);
    this bounds what is learned from, not what is predicted. Partial bundles are
    made in the map tasks; the driver gets one vector per language and task of the
    last sum, not texts.
    """
    rows = docs.select(F.col(lang).cast("string").alias("lang"), F.col(text).alias("text")).where(
        F.col("lang").isNotNull()
    )
    # a row per language, like the prototypes themselves; texts are picked without a join
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return {}
    share = F.create_map(*[F.lit(x) for k, n in sizes.items() for x in (k, min(1.0, per_language / n))])[F.col("lang")]
    picked = rows.where(F.pmod(F.xxhash64("text"), F.lit(1_000_000)) < share * 1_000_000)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, sums = Encoder(dim, n), {}
        for batch in batches:
            names = batch.column("lang").to_pylist()
            vectors = _unit(encoder.bundle(batch.column("text").to_pylist()))
            for name in set(names):
                mine = vectors[[x == name for x in names]].sum(axis=0)
                sums[name] = sums[name] + mine if name in sums else mine
        if sums:
            yield pa.record_batch(
                {
                    "lang": pa.array(np.repeat(list(sums), dim).tolist(), pa.string()),
                    "place": pa.array(np.tile(np.arange(dim), len(sums)), pa.int32()),
                    "value": pa.array(np.concatenate(list(sums.values()))),
                }
            )

    summed = (
        picked.mapInArrow(partial, "lang string, place int, value double")
        .groupBy("lang", "place")
        .agg(F.sum("value").alias("value"))
        .groupBy("lang")
        .agg(F.array_sort(F.collect_list(F.struct("place", "value"))).alias("v"))
        .select("lang", F.col("v.value").alias("value"))
    )
    found = {r["lang"]: np.array(r["value"]) for r in summed.collect()}
    return {k: v for k, v in sorted(found.items()) if np.any(v)}


def identify(
    docs: DataFrame,
    profiles: dict[str, np.ndarray],
    keep: tuple[str, ...] = ("doc_id",),
    text: str = "text",
    n: int = 3,
) -> DataFrame:
    """Columns ``keep`` with ``lang_pred`` and ``score`` (the cosine, 0 to 1).

    A text that is null or has no letter, or an empty set of profiles, gives
    ``und`` and 0. Ties go to the profile that comes first. Whole texts are read, in
    pieces of bounded size; repeated rows give repeated results. An empty table gives an empty result. Columns of other
    names, also ``_text`` and ``score``, are not read.
    """
    names = list(profiles)
    matrix = _unit(np.array([profiles[k] for k in names])) if names else np.zeros((0, DIM))
    taken = docs.select(*[F.col(c) for c in keep], F.col(text).alias("_text"))
    schema = ", ".join(f"`{c}` {t}" for c, t in taken.dtypes[:-1]) + ", lang_pred string, score double"

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(matrix.shape[1], n)
        for batch in batches:
            bundled = _unit(encoder.bundle(batch.column(len(keep)).to_pylist()))
            cosine = bundled @ matrix.T
            known = np.any(bundled != 0, axis=1) & bool(names)
            best = cosine.argmax(axis=1) if names else np.zeros(len(bundled), int)
            pred = [names[b] if k else "und" for b, k in zip(best, known, strict=True)]
            top = np.clip(cosine.max(axis=1), 0, 1) if names else np.zeros(len(bundled))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[: len(keep)], pa.array(pred, pa.string()), pa.array(np.where(known, top, 0.0))],
                names=[*keep, "lang_pred", "score"],
            )

    return taken.mapInArrow(predict, schema)
