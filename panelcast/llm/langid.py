"""Language identification with a string kernel.

The kernel of two texts is the blended spectrum of presence: the number of hashed character n-grams
(n = 1, 2, 3) that both contain, divided by the geometric mean of their own numbers.  A Nystroem map
over landmark texts turns it into finite features, on which one-versus-rest kernel ridge regression is
solved in closed form.  Landmarks and training texts come from a bounded sample of labelled rows; every
text is then scored whole, many at a time, by products of presence matrices with the folded model.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelcast.llm.words import chunks
from panelcast.llm.workers import tidy


@dataclass(frozen=True)
class KernelConfig:
    """``sample`` bounds the training rows a language gives, ``landmarks`` those it gives to the Nystroem map."""

    sample: int = 400
    landmarks: int = 32
    orders: tuple[int, ...] = (1, 2, 3)
    buckets: int = 1 << 13
    ridge: float = 1e-3
    rows: int = 256


@dataclass(frozen=True)
class KernelModel:
    labels: tuple[str, ...]
    landmarks: np.ndarray  # buckets x landmarks, 0 / 1 divided by the root of the landmark's own number
    weights: np.ndarray  # landmarks x labels
    bias: np.ndarray


def _code_points(values: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased code points of a chunk, runs of what is not a letter as one space, and their offsets."""
    lead = (values & 0xC0) != 0x80
    points = np.frombuffer(values.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    at = np.concatenate(([0], np.cumsum(lead)))[offsets]
    return points, at


_TABLE = np.zeros(0x3000, np.uint32)


def _fold_table() -> np.ndarray:
    """Lower-case letter of every code point below 0x3000; 32 for what is no letter."""
    if not _TABLE[65]:
        for c in range(len(_TABLE)):
            low = chr(c).lower()
            _TABLE[c] = ord(low) if chr(c).isalpha() and len(low) == 1 else c if chr(c).isalpha() else 32
    return _TABLE


def _fold(points: np.ndarray) -> np.ndarray:
    table = _fold_table()
    out = table[np.minimum(points, len(table) - 1)]
    high = points >= len(table)
    if high.any():
        different, back = np.unique(points[high], return_inverse=True)
        out[high] = np.array([c if chr(c).isalpha() else 32 for c in different.tolist()], np.uint32)[back]
    return out


def presence(values: np.ndarray, offsets: np.ndarray, config: KernelConfig) -> tuple[np.ndarray, np.ndarray]:
    """Which hashed n-grams each row contains (rows x buckets, uint8) and whether it has a letter."""
    points, at = _code_points(values, offsets)
    folded = _fold(points)
    rows = len(offsets) - 1
    row = np.repeat(np.arange(rows), np.diff(at))
    out = np.zeros((rows, config.buckets), np.uint8)
    letter = np.zeros(rows, bool)
    letter[row[folded != 32]] = True
    mask, flat = np.uint32(config.buckets - 1), out.reshape(-1)
    base = row * config.buckets
    code = np.zeros(len(folded), np.uint32)
    for n in range(1, max(config.orders) + 1):
        if len(folded) < n:
            break
        m = len(folded) - n + 1
        code = code[:m] * np.uint32(0x9E3779B1) + folded[n - 1 :] + np.uint32(n)
        if n not in config.orders:
            continue
        mixed = code ^ (code >> np.uint32(15))
        slot = ((mixed * np.uint32(0x85EBCA6B)) >> np.uint32(13)) & mask
        inside = base[:m] == base[n - 1 :]
        if n == 1:
            inside &= folded != 32
        flat[base[:m][inside] + slot[inside]] = 1
    return out, letter


def _own(features: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(features.sum(axis=1, dtype=np.float32), 1))


def _unit(x: Column) -> Column:
    """A number in [0, 1) from a 64-bit hash."""
    return F.shiftrightunsigned(x, 11) / F.lit(float(1 << 53))


def _sampled(docs: DataFrame, config: KernelConfig) -> list:
    """About ``sample`` labelled texts of every language as packed presence vectors; the same on every run."""
    labelled = docs.where("lang IS NOT NULL AND text IS NOT NULL").select("lang", "text", "_at")
    counts = {r["lang"]: r["count"] for r in labelled.groupBy("lang").count().collect()}
    if not counts:
        return []
    share = F.create_map(*(F.lit(x) for lang, n in sorted(counts.items()) for x in (lang, min(1.0, config.sample / n))))
    drawn = labelled.where(F.col("_at") < share[F.col("lang")]).select("lang", "text", "_at")

    def run(batches):
        for batch in batches:
            for a, b, values, offsets in chunks(batch.column("text"), 1 << 19):
                found, letter = presence(values, offsets, config)
                bits = pa.array([x.tobytes() for x in np.packbits(found, axis=1)], pa.binary())
                out = [batch.column("lang")[a:b], batch.column("_at")[a:b], bits, pa.array(letter)]
                yield pa.RecordBatch.from_arrays(out, ["lang", "_at", "bits", "letter"])

    rows = drawn.mapInArrow(tidy(run), "lang string, _at double, bits binary, letter boolean").where("letter").collect()
    return sorted(rows, key=lambda r: (r["lang"], r["_at"], bytes(r["bits"])))


def fit(docs: DataFrame, key: Column, config: KernelConfig = KernelConfig()) -> KernelModel | None:
    """A model from the rows of ``docs`` (text, lang) with both; ``key`` is a 64-bit hash that draws the sample.

    None when there is no usable row.  One language gives a model that always answers with it.
    """
    rows = _sampled(docs.select("text", "lang", _unit(key).alias("_at")), config)
    if not rows:
        return None
    labels = tuple(sorted({r["lang"] for r in rows}))
    x = np.unpackbits(np.array([np.frombuffer(bytes(r["bits"]), np.uint8) for r in rows]), axis=1).astype(np.float32)
    lang = np.array([labels.index(r["lang"]) for r in rows])
    x /= _own(x)[:, None]
    marks = np.concatenate([np.flatnonzero(lang == i)[: config.landmarks] for i in range(len(labels))])
    landmarks = x[marks].T.copy()
    inner = (landmarks.T @ landmarks).astype(np.float64)
    value, vector = np.linalg.eigh(inner)
    keep = value > 1e-6 * value[-1]
    whiten = vector[:, keep] / np.sqrt(value[keep])
    z = (x @ landmarks).astype(np.float64) @ whiten
    mean = z.mean(axis=0)
    y = np.where(lang[:, None] == np.arange(len(labels)), 1.0, -1.0)
    weight = 1.0 / np.bincount(lang, minlength=len(labels))[lang]  # languages count alike
    zc = (z - mean) * np.sqrt(weight)[:, None]
    gram = zc.T @ zc + config.ridge * np.eye(z.shape[1])
    offset = (y * weight[:, None]).sum(axis=0) / weight.sum()
    solved = np.linalg.solve(gram, zc.T @ ((y - offset) * np.sqrt(weight)[:, None]))
    weights = whiten @ solved
    return KernelModel(labels, landmarks, weights.astype(np.float32), (offset - mean @ solved).astype(np.float32))


def _predict(values: np.ndarray, offsets: np.ndarray, model: KernelModel, config: KernelConfig) -> tuple[list[str], np.ndarray]:
    found, letter = presence(values, offsets, config)
    x = found.astype(np.float32)
    x /= _own(x)[:, None]
    f = (x @ model.landmarks) @ model.weights + model.bias
    e = np.exp(4 * (f - f.max(axis=1, keepdims=True)))
    p = e / e.sum(axis=1, keepdims=True)
    best = p.argmax(axis=1)
    names = [model.labels[i] if ok else "und" for i, ok in zip(best.tolist(), letter.tolist(), strict=True)]
    return names, np.where(letter, p[np.arange(len(p)), best], 0.0).astype(np.float64)


def _rows(column: pa.Array, rows: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    for a in range(0, len(column), rows):
        for i, j, values, offsets in chunks(column.slice(a, rows)):
            yield a + i, a + j, values, offsets


def identify(docs: DataFrame, model: KernelModel | None, config: KernelConfig = KernelConfig()) -> DataFrame:
    """All columns of ``docs`` with lang_pred and score (0 to 1), from the whole of ``text`` alone.

    ``und`` with score 0 for a null or empty text, one without a letter, or without a model.  Other columns,
    nulls in them and repeated rows pass through; lang_pred and score must not be among them.
    """
    if clash := {"lang_pred", "score"} & {c.lower() for c in docs.columns}:
        raise ValueError(f"columns {sorted(clash)} are in the way")
    held = docs.sparkSession.sparkContext.broadcast(model)  # at most buckets x landmarks x languages numbers

    def run(batches):
        for batch in batches:
            names, scores = [], [np.empty(0)]
            if held.value is None:
                names, scores = ["und"] * batch.num_rows, [np.zeros(batch.num_rows)]
            else:
                for _, _, values, offsets in _rows(batch.column("text"), config.rows):
                    n, s = _predict(values, offsets, held.value, config)
                    names += n
                    scores.append(s)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(names, pa.string()), pa.array(np.concatenate(scores), pa.float64())], [*batch.schema.names, "lang_pred", "score"]
            )

    schema = docs.select("*", F.lit("").alias("lang_pred"), F.lit(0.0).alias("score")).schema
    return docs.mapInArrow(tidy(run), schema)
