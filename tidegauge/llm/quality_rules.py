"""Quality rules: word and line statistics, and a learned decision list over them.

Sequential covering: a rule for bad documents grows by the threshold literal with
the best FOIL gain until it covers no good row, is pruned on rows that it has not
seen, and takes the rows that it covers out; this repeats until a rule no longer
reaches the precision asked for. The rules become one ordered Spark conditional
expression, first match wins, default keep.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .textstats import BASE, NAMES, stats

#: Statistics that rules may test: rates, so that length alone rejects nothing.
TESTED = tuple(n for n in NAMES if n not in BASE and n != "log_words")


def with_stats(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """Columns ``keep`` and one column for each of NAMES, of every whole text; a null text has no words."""
    taken = docs.select(*[F.col(c) for c in keep], F.col(text).alias("_text"))
    schema = ", ".join(
        [f"`{c}` {t}" for c, t in taken.dtypes[:-1]] + [f"{n} {'bigint' if n in BASE else 'double'}" for n in NAMES]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [stats(x.as_py()) for x in batch.column(len(keep))]
            columns = zip(*rows, strict=True) if rows else [[]] * len(NAMES)
            made = [pa.array(c, pa.int64() if n in BASE else pa.float64()) for n, c in zip(NAMES, columns, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], *made], names=[*keep, *NAMES])

    return taken.mapInArrow(run, schema)


def labelled_stats(
    docs: DataFrame, labels: DataFrame, label: str, most: int, names: tuple[str, ...], text: str = "text"
) -> DataFrame:
    """``doc_id``, ``label`` and statistics ``names`` of about ``most`` labelled documents, picked by a hash of the id.

    The bound holds for labelled rows that a model is fitted on, nothing else; it also bounds what is broadcast. Ids
    are picked, not rows: of an id's repeated rows or labels the least values count, so that reruns agree. Texts stay
    where they are read; only statistics are shuffled.
    """
    known = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull())
    known = known.groupBy("doc_id").agg(F.min(label).alias("label"))
    share = min(1.0, most / max(known.count(), 1))
    picked = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(share * (1 << 30)))
    texts = docs.select("doc_id", F.col(text).alias("text")).join(F.broadcast(picked), "doc_id")
    made = with_stats(texts, ("doc_id", "label")).select("doc_id", "label", *names)
    return made.groupBy("doc_id").agg(F.min(F.struct("label", *names)).alias("r")).select("doc_id", "r.*")


@dataclass(frozen=True)
class Rule:
    """All literals hold: (statistic, "<=" or ">", threshold)."""

    literals: tuple[tuple[str, str, float], ...]

    def covers(self, columns: dict[str, np.ndarray]) -> np.ndarray:
        out = np.ones(len(next(iter(columns.values()))), bool)
        for name, sign, at in self.literals:
            out &= columns[name] <= at if sign == "<=" else columns[name] > at
        return out

    def condition(self) -> Column:
        out = F.lit(True)
        for name, sign, at in self.literals:
            out = out & (F.col(name) <= at if sign == "<=" else F.col(name) > at)
        return out

    def __str__(self) -> str:
        return " and ".join(f"{n} {s} {at:.6g}" for n, s, at in self.literals)


def _grow(x: dict[str, np.ndarray], bad: np.ndarray, most_literals: int, cuts: int) -> Rule | None:
    inside = np.ones(len(bad), bool)
    literals: list[tuple[str, str, float]] = []
    while len(literals) < most_literals and (inside & ~bad).any():
        p0, n0 = (inside & bad).sum(), (inside & ~bad).sum()
        best: tuple[float, tuple[str, str, float] | None] = (1e-9, None)
        for name, values in x.items():
            mine = values[inside]
            steps = np.unique(np.quantile(mine, np.linspace(0, 1, cuts + 2), method="nearest"))
            for at in ((steps[1:] + steps[:-1]) / 2).tolist():  # midway between values that occur
                low = values <= at
                for sign, hit in (("<=", low), (">", ~low)):
                    p, n = (inside & bad & hit).sum(), (inside & ~bad & hit).sum()
                    if p and p + n < p0 + n0:
                        gain = p * (np.log2(p / (p + n)) - np.log2(p0 / (p0 + n0)))
                        if gain > best[0]:
                            best = (float(gain), (name, sign, at))
        if best[1] is None:
            break
        literals.append(best[1])
        inside &= Rule((best[1],)).covers(x)
    return Rule(tuple(literals)) if literals else None


def _pruned(rule: Rule, x: dict[str, np.ndarray], bad: np.ndarray) -> Rule:
    def worth(k: int) -> tuple[float, int]:
        hit = Rule(rule.literals[:k]).covers(x)
        p, n = (hit & bad).sum(), (hit & ~bad).sum()
        return ((p - n) / (p + n) if p + n else -1.0, -k)

    return Rule(rule.literals[: max(range(1, len(rule.literals) + 1), key=worth)])


def learn(
    x: dict[str, np.ndarray],
    bad: np.ndarray,
    precision: float = 0.95,
    least: int = 3,
    most_rules: int = 20,
    most_literals: int = 4,
    cuts: int = 48,
) -> list[Rule]:
    """Ordered rules for the rows where ``bad``. Every third row prunes, the others grow.

    A rule is taken if, over all rows not yet covered, it covers ``least`` bad rows
    and at least ``precision`` of what it covers is bad. No bad rows give no rules.
    """
    rules: list[Rule] = []
    for_pruning = np.arange(len(bad)) % 3 == 2
    left = np.ones(len(bad), bool)
    while len(rules) < most_rules and (left & bad & ~for_pruning).any():
        part = lambda rows: ({k: v[rows] for k, v in x.items()}, bad[rows])
        rule = _grow(*part(left & ~for_pruning), most_literals, cuts)
        if rule is None:
            break
        short = _pruned(rule, *part(left & for_pruning))
        for candidate in (short, rule):
            hit = candidate.covers(x) & left
            p, n = (hit & bad).sum(), (hit & ~bad).sum()
            if p >= least and p >= precision * (p + n):
                break
        else:
            break
        rules.append(candidate)
        left &= ~hit
    return rules


def fit(
    docs: DataFrame, labels: DataFrame, most_labelled: int = 6_000, precision: float = 0.95, text: str = "text"
) -> list[Rule]:
    """Rules for documents whose ``labels.quality`` is 0, from about ``most_labelled`` labelled documents.

    Rows with a null id or label teach nothing; a null text has no words; an id that is repeated counts once for each pair of text
    and label. Without labelled documents there are no rules. Columns of other names are not read.
    """
    rows = labelled_stats(docs, labels, "quality", most_labelled, TESTED, text).drop("doc_id").toPandas()
    rows = rows.sort_values(list(rows.columns), ignore_index=True).sample(frac=1, random_state=7)
    if rows.empty:
        return []
    return learn({n: rows[n].to_numpy() for n in TESTED}, rows["label"].to_numpy() == 0, precision)


def verdict(rules: list[Rule]) -> Column:
    """The decision list: false at the first rule that holds, else true."""
    out = None
    for rule in rules:
        out = F.when(rule.condition(), F.lit(False)) if out is None else out.when(rule.condition(), F.lit(False))
    return F.lit(True) if out is None else out.otherwise(F.lit(True))


def base_failed() -> Column:
    """Fewer than 20 words, or over 30 % of the words repeat in 8-word windows."""
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def judged(docs: DataFrame, rules: list[Rule], keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """``keep``, all statistics, ``base_failed`` and ``kept`` of every row.

    Null, empty and blank texts have no words and fail the base; repeated rows get
    repeated results, an empty table an empty one. Other columns are not read.
    """
    return (
        with_stats(docs, keep, text)
        .withColumn("base_failed", base_failed())
        .withColumn("kept", ~F.col("base_failed") & verdict(rules))
    )


def passing(docs: DataFrame, rules: list[Rule], text: str = "text") -> DataFrame:
    """The rows of ``docs`` that are kept, with all their columns, whatever their names.

    Null, empty and short texts fail the base rules; repeated rows get one verdict; null ids are judged like others. Without rules
    only the base rules decide. An empty table gives an empty result.
    """
    names = docs.columns
    plain = docs.select(*[F.col(c).alias(f"c{i}") for i, c in enumerate(names)])
    kept = judged(plain, rules, tuple(plain.columns), f"c{names.index(text)}").where("kept")
    return kept.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(names)])
