"""Quality rules as a learned decision list over text statistics.

Sequential covering: each step grows one conjunction of thresholds for either
verdict on two thirds of the labelled rows still undecided and prunes it from its
end on the other third; the rarer verdict's rule is taken if it is good enough
there, else the other's. The rows it covers are then decided. What is left takes the default. The list becomes one ordered Spark
conditional expression over integer statistics, so it can be read, stored and
run without Python.

Learning sees every labelled row. A step is one aggregation of counts by
statistic and cell of its value (statistics x cells rows come back to the
driver, whatever the number of documents).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from math import log2

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import checkpointed
from .blocks import SPACE, text_blocks
from .langid import remainder

#: Longest conjunction, longest list.
MAX_CONDITIONS = 3
MAX_RULES = 12
#: A rule needs this share of right verdicts on the pruning rows, and this many rows there.
PRECISION = 0.9
MIN_ROWS = 8
#: Cells of a statistic: values beyond the last one share it.
CELLS = 64

_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_DIGIT = np.zeros(256, dtype=bool)
_DIGIT[48:58] = True
_UPPER = np.zeros(256, dtype=bool)
_UPPER[65:91] = True

#: Counted in every text, as longs.
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_distinct_words", "n_digits", "n_upper", "n_ended_lines")


@dataclass(frozen=True)
class Statistic:
    """``per`` x numerator / denominator in whole numbers (0 where the denominator is 0), cut into cells of ``step``."""

    name: str
    over: str
    under: str | None = None
    per: int = 1000
    step: int = 20

    def sql(self) -> str:
        if self.under is None:
            return f"`{self.over}`"
        return f"coalesce({self.per}L * `{self.over}` div nullif(`{self.under}`, 0L), 0L)"


STATISTICS = (
    Statistic("words", "n_words", step=25),
    Statistic("word_length_100", "word_chars", "n_words", 100, 25),
    Statistic("symbols_per_1000_words", "n_symbols", "n_words", 1000, 50),
    Statistic("repeated_lines_per_1000", "n_dup_lines", "n_lines"),
    Statistic("repeated_words_per_1000", "n_repeat_words", "n_words"),
    Statistic("distinct_words_per_1000", "n_distinct_words", "n_words"),
    Statistic("digits_per_1000_letters", "n_digits", "word_chars", 1000, 5),
    Statistic("capitals_per_1000_letters", "n_upper", "word_chars", 1000, 10),
    Statistic("words_per_line", "n_words", "n_lines", 1, 2),
    Statistic("ended_lines_per_1000", "n_ended_lines", "n_lines"),
)


@dataclass(frozen=True)
class Condition:
    """statistic >= bound, or statistic < bound."""

    statistic: Statistic
    at_least: bool
    bound: int

    def sql(self) -> str:
        return f"{self.statistic.sql()} {'>=' if self.at_least else '<'} {self.bound}L"

    def __str__(self) -> str:
        return f"{self.statistic.name} {'>=' if self.at_least else '<'} {self.bound}"


@dataclass(frozen=True)
class Rule:
    conditions: tuple[Condition, ...]
    keep: bool

    def sql(self) -> str:
        return " AND ".join(c.sql() for c in self.conditions) or "true"

    def __str__(self) -> str:
        return f"{' and '.join(map(str, self.conditions))}: {'keep' if self.keep else 'reject'}"


@dataclass(frozen=True)
class DecisionList:
    """Rules in order; the first that holds decides, else the default."""

    rules: tuple[Rule, ...] = field(default=())
    default: bool = True

    def verdict(self) -> Column:
        """Ordered conditional expression over the columns of :func:`statistics`: keep or not."""
        cases = " ".join(f"WHEN {r.sql()} THEN {str(r.keep).lower()}" for r in self.rules)
        return F.expr(f"CASE {cases} ELSE {str(self.default).lower()} END" if cases else str(self.default).lower())

    def fired(self) -> Column:
        """Number of the rule that decides, from 1; 0 for the default."""
        cases = " ".join(f"WHEN {r.sql()} THEN {k}" for k, r in enumerate(self.rules, 1))
        return F.expr(f"CASE {cases} ELSE 0 END" if cases else "0")

    def __str__(self) -> str:
        return "\n".join([*map(str, self.rules), f"else: {'keep' if self.default else 'reject'}"])


def _line_counts(text: bytes) -> tuple[int, int, int]:
    """Lines with a word, those equal to an earlier line, those that end a sentence."""
    lines = [line for line in text.split(b"\n") if line.split()]
    ended = sum(line.rstrip(b" \t\v\f\r")[-1:] in (b".", b"!", b"?") for line in lines)
    return len(lines), len(lines) - len(set(lines)), ended


def _word_counts(text: bytes) -> tuple[int, int, int]:
    """Words, words inside three-word windows that occur twice or more, distinct words."""
    words = text.split()
    windows = list(zip(words, words[1:], words[2:]))
    covered = 0
    if len(set(windows)) < len(windows):
        seen, again = set(), set()
        for w in windows:
            (again if w in seen else seen).add(w)
        end = 0  # first word not yet counted
        for k, w in enumerate(windows):
            if w in again:
                covered += k + 3 - max(end, k)
                end = k + 3
    return len(words), covered, len(set(words))


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, one long for each of COUNTS) of every row, from its whole text.

    Words are runs without ASCII white space; equality is of bytes. A null text
    counts as empty: zeros. Repeated rows are counted each, extra columns ignored.
    """

    def sums(marks: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        total = np.concatenate(([0], np.cumsum(marks)))
        return total[offsets[1:]] - total[offsets[:-1]]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, raw, offsets in text_blocks(batches, "t"):
            whole = raw.tobytes()
            texts = [whole[a:b] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
            words, lines = np.array([_word_counts(t) for t in texts]), np.array([_line_counts(t) for t in texts])
            solid = ~SPACE[raw] & ((raw & 0xC0) != 0x80)
            found = {
                "n_words": words[:, 0], "word_chars": sums(solid, offsets), "n_symbols": sums(_SYMBOL[raw], offsets), "n_dup_lines": lines[:, 1],
                "n_repeat_words": words[:, 1], "n_lines": lines[:, 0], "n_distinct_words": words[:, 2], "n_digits": sums(_DIGIT[raw], offsets),
                "n_upper": sums(_UPPER[raw], offsets), "n_ended_lines": lines[:, 2],
            }
            yield pa.RecordBatch.from_arrays([part.column(0), *[pa.array(found[c].astype(np.int64)) for c in COUNTS]], names=["id", *COUNTS])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"))
    found = rows.mapInArrow(task, f"id {kind}, " + ", ".join(f"{c} long" for c in COUNTS))
    return found.withColumnRenamed("id", id_col)


def base_failed() -> Column:
    """The fixed rule before the learned ones: too few words, or most of them inside repeated windows."""
    return F.expr("n_words < 50 OR 100L * n_repeat_words > 50L * n_words")


def _gain(p: int, n: int, p0: int, n0: int) -> float:
    """FOIL's gain of a condition that leaves p right and n wrong rows of p0 and n0."""
    return p * (log2(p / (p + n)) - log2(p0 / (p0 + n0))) if p else 0.0


def _cells(rows: DataFrame, partial: dict[bool, list[Condition]]) -> dict:
    """Rows by verdict grown, statistic, cell and label, of the growing rows that its conditions cover; one job."""
    flags = F.array(*[F.struct(F.lit(keep).alias("verdict"), F.expr(Rule(tuple(c), keep).sql()).alias("inside")) for keep, c in partial.items()])
    cells = F.array(*[F.struct(F.lit(k).alias("stat"), F.expr(f"cast(least({s.sql()} div {s.step}L, {CELLS - 1}L) as int)").alias("cell")) for k, s in enumerate(STATISTICS)])
    open_rows = rows.where("grows").select("good", F.explode(flags).alias("f"), cells.alias("cells")).where("f.inside")
    counts = open_rows.select("good", "f.verdict", F.explode("cells").alias("c")).groupBy("verdict", "c.stat", "c.cell", "good").count()
    found = {keep: np.zeros((len(STATISTICS), CELLS, 2), dtype=np.int64) for keep in partial}
    for r in counts.collect():  # verdicts x statistics x cells x labels rows
        found[r.verdict][r.stat, r.cell, int(r.good)] = r["count"]
    return found


def _best(counts: np.ndarray, keep: bool) -> Condition | None:
    """The condition of highest gain; ties go to the first statistic, ``at least`` first, and the middle of its equal bounds."""
    right, wrong = (counts[:, :, int(side)] for side in (keep, not keep))
    p0, n0 = int(right[0].sum()), int(wrong[0].sum())
    if not p0 or not n0:
        return None
    gains: dict[tuple[int, bool], list[float]] = {}
    for k in range(len(STATISTICS)):
        below = np.cumsum(right[k])[:-1].tolist(), np.cumsum(wrong[k])[:-1].tolist()
        gains[k, True] = [_gain(p0 - p, n0 - n, p0, n0) for p, n in zip(*below)]
        gains[k, False] = [_gain(p, n, p0, n0) for p, n in zip(*below)]
    most = max(max(g) for g in gains.values())
    if most <= 1e-9:
        return None
    k, at_least = next(at for at, g in gains.items() if max(g) >= most)
    equal = [cell for cell, g in enumerate(gains[k, at_least], 1) if g >= most]
    return Condition(STATISTICS[k], at_least, equal[(len(equal) - 1) // 2] * STATISTICS[k].step)


def _pruned(rows: DataFrame, grown: dict[bool, list[Condition]], precision: float, min_rows: int) -> Rule | None:
    """The prefix that does best on the pruning rows, of the first verdict in ``grown`` that has a good enough one."""
    prefixes = [Rule(tuple(c[:k]), keep) for keep, c in grown.items() for k in range(1, len(c) + 1)]
    if not prefixes:
        return None
    sums = [F.count(F.expr(f"CASE WHEN {r.sql()} AND good = {want} THEN 1 END")) for r in prefixes for want in (str(r.keep).lower(), str(not r.keep).lower())]
    row = rows.where("NOT grows").agg(*sums).first()
    worth = {}
    for k, r in enumerate(prefixes):
        right, wrong = row[2 * k], row[2 * k + 1]
        if right + wrong >= min_rows and right >= precision * (right + wrong):
            worth[r] = (right + 1) / (right + wrong + 2)  # Laplace's estimate, so that few rows prove little
    for keep in grown:
        if own := [r for r in worth if r.keep == keep]:
            return max(own, key=worth.get)
    return None


def learn(rows: DataFrame, max_rules: int = MAX_RULES, max_conditions: int = MAX_CONDITIONS, precision: float = PRECISION,
          min_rows: int = MIN_ROWS) -> DecisionList:
    """Learn a list from rows of COUNTS, ``good`` (boolean) and ``grows`` (boolean: grow or prune).

    Rows without ``good`` teach nothing. No rows, or rows of one label, give a
    list of the default alone (keep, or that label).
    """
    left = checkpointed(rows.where("good IS NOT NULL AND grows IS NOT NULL").select("good", "grows", *COUNTS))
    rules: list[Rule] = []
    while len(rules) < max_rules:
        grown: dict[bool, list[Condition]] = {False: [], True: []}
        growing = {True, False}
        for depth in range(max_conditions):
            counts = _cells(left, {keep: grown[keep] for keep in growing})
            if not depth and counts[True][0, :, 0].sum() > counts[True][0, :, 1].sum():
                grown = {True: [], False: []}  # the rarer verdict first
            for keep in list(growing):
                found = _best(counts[keep], keep)
                if found is None:
                    growing.discard(keep)
                else:
                    grown[keep].append(found)
            if not growing:
                break
        found = _pruned(left, grown, precision, min_rows)
        if found is None:
            break
        rules.append(found)
        left = left.where(f"NOT ({found.sql()})")
    rest = {r.good: r["count"] for r in left.groupBy("good").count().collect()}
    return DecisionList(tuple(rules), rest.get(True, 0) >= rest.get(False, 0))


def train(stats: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality", **limits) -> DecisionList:
    """Learn from the labelled rows of ``stats`` that pass the fixed rule.

    An id whose labels disagree teaches nothing, nor does a null id or label;
    rows of one id learn each. A hash of the id deals rows to growing (two
    thirds) and pruning.
    """
    agreed = labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("boolean").alias("_good")).where("_id IS NOT NULL AND _good IS NOT NULL")
    agreed = agreed.groupBy("_id").agg(F.min("_good").alias("good"), F.max("_good").alias("_most")).where("good = _most").drop("_most")
    plain = stats.select(F.col(id_col).alias("_key"), *COUNTS).where(~base_failed())
    joined = plain.join(agreed, F.col("_key") == F.col("_id"))
    return learn(joined.withColumn("grows", remainder("_key", 3) != 0), **limits)


def judge(stats: DataFrame, rules: DecisionList) -> DataFrame:
    """``stats`` with base_failed, rule (number of the one that decided, 0: the default) and kept."""
    return stats.withColumns({"base_failed": base_failed(), "rule": rules.fired(), "_keep": rules.verdict()}).withColumn(
        "kept", ~F.col("base_failed") & F.col("_keep")
    ).drop("_keep")
