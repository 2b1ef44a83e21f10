"""Quality rules whose cutoffs are certified on labelled documents.

Every rule compares one measure of a text with a cutoff.  All rules together make one sequence of rule
sets, from lenient to strict: each step takes up the next cutoff of one rule, and a set rejects what
any of its rules rejects.  A step is accepted in a stratum when an exact (Clopper-Pearson) upper bound
on the share of good documents its whole set rejects is at most ``risk``; the first refusal ends the
sequence, so only the strata need a Bonferroni correction.  With probability 1 - ``error`` over the
labels no stratum loses more than ``risk`` of its good documents to all rules together.  A stratum
with too few labels to certify the first step goes without rules.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelcast.llm.words import chunks, mix, split_words, window_hashes, window_starts, word_hashes
from panelcast.llm.workers import tidy
from panelcast.session import cut_lineage

_SYMBOL = np.isin(np.arange(256), np.frombuffer(b"#*$%&|<>", np.uint8))
_EXCLAIM = np.isin(np.arange(256), np.frombuffer(b"!?", np.uint8))
_UPPER = np.isin(np.arange(256), np.arange(65, 91))
_LETTER = _UPPER | np.isin(np.arange(256), np.arange(97, 123))
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_letters", "n_exclaims", "n_distinct")
WINDOW = 3


@dataclass(frozen=True)
class Rule:
    """Reject a document when ``share`` (an SQL expression over the measures) is above a cutoff."""

    name: str
    share: str
    cutoffs: tuple[float, ...]
    weight: float = 1.0


#: Cutoffs from lenient to strict, and weights (among equal levels, heavier rules step first), fixed before any label is seen.
RULES = (
    Rule("symbols", "n_symbols / greatest(word_chars, 1)", (0.30, 0.20, 0.15, 0.10, 0.07, 0.05, 0.03), 3),
    Rule("capitals", "n_upper / greatest(n_letters, 1)", (0.95, 0.90, 0.80, 0.60, 0.40, 0.25, 0.15), 2),
    Rule("exclaims", "n_exclaims / greatest(n_words, 1)", (1.0, 0.8, 0.6, 0.4, 0.25, 0.15, 0.10), 2),
    Rule("repeats", "n_repeat_words / greatest(n_words, 1)", (0.50, 0.45, 0.40, 0.35, 0.30, 0.25, 0.20)),
    Rule("repeated lines", "n_dup_lines / greatest(n_lines, 1)", (0.60, 0.50, 0.40, 0.30, 0.25, 0.20, 0.15)),
    Rule("few different words", "1 - n_distinct / greatest(n_words, 1)", (0.98, 0.95, 0.92, 0.90, 0.85)),
)


@dataclass(frozen=True)
class QualityConfig:
    risk: float = 0.02
    error: float = 0.05
    min_words: int = 50
    max_repeat_percent: int = 50
    stratum: str = "lang"
    rules: tuple[Rule, ...] = field(default=RULES)


def _per_row(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    sums = np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))
    return sums[offsets[1:]] - sums[offsets[:-1]]


def _lines(text: bytes) -> tuple[int, int]:
    lines = [x for x in text.split(b"\n") if x.strip()]
    return len(lines), len(lines) - len(set(lines))


def measure_chunk(values: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """The measures of each row of a chunk."""
    w = split_words(values, offsets)
    rows = len(offsets) - 1
    h = word_hashes(w)
    cover = np.zeros(len(w.start) + 1, np.int64)
    starts = window_starts(w.first, WINDOW)
    if len(starts):
        grams = window_hashes(h, WINDOW)[starts] + mix(w.row[starts].astype(np.uint64))
        order = np.argsort(grams)
        same = grams[order][1:] == grams[order][:-1]
        twice = np.zeros(len(starts), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        np.add.at(cover, starts[twice], 1)
        np.add.at(cover, starts[twice] + WINDOW, -1)
    repeated = np.cumsum(cover[:-1]) > 0
    _, first = np.unique(h + mix(w.row.astype(np.uint64)), return_index=True)  # different words of each row
    raw = values.tobytes()
    lines = [_lines(raw[a:b]) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
    solid = np.zeros(len(values) + 1, np.int64)
    np.add.at(solid, w.start, 1)
    np.add.at(solid, w.end, -1)
    solid = np.cumsum(solid[:-1]) > 0
    return {
        "n_words": np.diff(w.first),
        "word_chars": _per_row(solid & ((values & 0xC0) != 0x80), offsets),
        "n_symbols": _per_row(_SYMBOL[values], offsets),
        "n_dup_lines": np.array([d for _, d in lines], np.int64),
        "n_repeat_words": _per_row(repeated, w.first),
        "n_lines": np.array([n for n, _ in lines], np.int64),
        "n_upper": _per_row(_UPPER[values], offsets),
        "n_letters": _per_row(_LETTER[values], offsets),
        "n_exclaims": _per_row(_EXCLAIM[values], offsets),
        "n_distinct": np.bincount(w.row[first], minlength=rows).astype(np.int64),
    }


def with_measures(docs: DataFrame, prefix: str = "") -> DataFrame:
    """All columns of ``docs`` and the measures of ``text``; null text measures 0 throughout."""
    names = [prefix + m for m in MEASURES]
    if clash := {n.lower() for n in names} & {c.lower() for c in docs.columns}:
        raise ValueError(f"columns {sorted(clash)} are in the way; choose another prefix")

    def run(batches):
        for batch in batches:
            for a, b, values, offsets in chunks(batch.column("text")):
                m = measure_chunk(values, offsets)
                out = [*batch.slice(a, b - a).columns, *(pa.array(m[x].astype(np.int64)) for x in MEASURES)]
                yield pa.RecordBatch.from_arrays(out, [*batch.schema.names, *names])

    schema = docs.select("*", *(F.lit(0).cast("bigint").alias(n) for n in names)).schema
    return docs.mapInArrow(tidy(run), schema)


def _log_tail(k: int, n: int, p: float) -> float:
    """log P(X <= k) of a binomial(n, p)."""
    if p <= 0:
        return 0.0
    if p >= 1:
        return 0.0 if k >= n else -math.inf
    log = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p) for i in range(k + 1)]
    top = max(log)
    return top + math.log(sum(math.exp(x - top) for x in log))


def upper_bound(rejected: int, n: int, error: float) -> float:
    """Exact one-sided upper confidence bound on a share, ``rejected`` of ``n`` seen."""
    if rejected >= n:
        return 1.0
    lo, hi, goal = rejected / n, 1.0, math.log(error)
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if _log_tail(rejected, n, mid) > goal else (lo, mid)
    return hi


def base_failed(config: QualityConfig, prefix: str = ""):
    n, r = f"`{prefix}n_words`", f"`{prefix}n_repeat_words`"
    return F.expr(f"{n} < {config.min_words} OR 100 * {r} > {config.max_repeat_percent} * {n}")


def steps(rules: tuple[Rule, ...]) -> list[tuple[Rule, float]]:
    """The sequence: first cutoffs of all rules, then second ones, and so on; heavier rules first."""
    order = sorted((j, -r.weight, i) for i, r in enumerate(rules) for j in range(len(r.cutoffs)))
    return [(rules[i], rules[i].cutoffs[j]) for j, _, i in order]


def certify(measured: DataFrame, labels: DataFrame, config: QualityConfig = QualityConfig()) -> dict[str | None, dict[str, float]]:
    """Accepted cutoff of each rule by stratum (a null stratum is one of its own).

    ``measured`` has doc_id, the stratum column and the measures; ``labels`` doc_id and quality.  A
    document with several labels is good if one says so; null labels and null ids count as unlabelled.
    One row for each stratum and step reaches the driver.
    """
    good = labels.where("quality IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("quality").alias("quality")).where("quality = 1")
    held = measured.where(~base_failed(config)).join(good.select("doc_id"), "doc_id", "left_semi")
    sequence = steps(config.rules)
    last = F.lit(len(sequence))
    fires = [F.when(F.expr(f"({rule.share}) > {cutoff!r}"), F.lit(i)).otherwise(last) for i, (rule, cutoff) in enumerate(sequence)]
    rows = held.select(F.col(config.stratum).alias("stratum"), F.least(last, last, *fires).alias("step")).groupBy("stratum", "step").count().collect()
    counts: dict[str | None, dict[int, int]] = {}
    for r in rows:
        counts.setdefault(r["stratum"], {})[r["step"]] = r["count"]
    out: dict[str | None, dict[str, float]] = {}
    for stratum, by_step in counts.items():
        out[stratum] = {}
        n, rejected = sum(by_step.values()), 0
        for i, (rule, cutoff) in enumerate(sequence):
            rejected += by_step.get(i, 0)
            if rejected > config.risk * n or upper_bound(rejected, n, config.error / len(counts)) > config.risk:
                break
            out[stratum][rule.name] = cutoff
    return out


def verdict(cutoffs: dict[str | None, dict[str, float]], config: QualityConfig = QualityConfig(), prefix: str = ""):
    """True when a document passes the base test and the certified rules of its stratum."""
    def share(rule: Rule) -> str:
        return re.sub(r"\b(" + "|".join(MEASURES) + r")\b", lambda m: f"`{prefix}{m[0]}`", rule.share)

    passes = F.lit(True)
    for stratum, own in sorted(cutoffs.items(), key=lambda x: (x[0] is None, str(x[0]))):
        fails = F.lit(False)
        for rule in config.rules:
            if rule.name in own:
                fails = fails | F.expr(f"({share(rule)}) > {own[rule.name]!r}")
        passes = F.when(F.col(config.stratum).eqNullSafe(F.lit(stratum)), ~fails).otherwise(passes)
    return ~base_failed(config, prefix) & passes


def quality_verdicts(docs: DataFrame, labels: DataFrame, config: QualityConfig = QualityConfig()) -> DataFrame:
    """doc_id, the stratum, the measures, base_failed and kept of every document.

    Null and empty texts have no words and fail the base test.  A repeated row is judged like the first.
    Without labels only the base test applies.  An empty table gives an empty one.
    """
    measured = cut_lineage(with_measures(docs.select("doc_id", config.stratum, "text")).drop("text"))
    cutoffs = certify(measured, labels, config)
    return measured.withColumn("base_failed", base_failed(config)).withColumn("kept", verdict(cutoffs, config))


def keep_good(docs: DataFrame, labels: DataFrame, config: QualityConfig = QualityConfig()) -> DataFrame:
    """The rows of ``docs`` that pass, unchanged; measures are taken twice so that no text is shuffled."""
    measured = cut_lineage(with_measures(docs.select("doc_id", config.stratum, "text")).drop("text"))
    cutoffs = certify(measured, labels, config)
    prefix = "_measure_"
    return with_measures(docs, prefix).where(verdict(cutoffs, config, prefix)).select(*(f"`{c}`" for c in docs.columns))
