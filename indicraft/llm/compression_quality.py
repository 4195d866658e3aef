"""Quality by compression: dictionaries of good and of bad text, and which of the two shortens a text more.

Two zstandard dictionaries are built from labelled texts. A text is cut into blocks and every block is compressed
with either dictionary; the sum of both sizes over all blocks, normalised like a compression distance,
(bad - good) / max(bad, good), says which kind it resembles. How far the good dictionary and the text itself shorten it
enter beside it, since stuttering text shrinks by itself. A logistic calibration, fitted on labelled
texts that built no dictionary, makes a score of these.

Defined cases: null and empty texts have no blocks and get the score of no evidence; copies and repeated
rows score alike; without labelled rows of both kinds every score is the prior (0.5 without any label).
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import col, fresh, map_texts, text_or_empty
from .toxicity import _logistic, _without_copies, label_counts, labelled_sample, prior_shift

#: Labelled documents that fitting may take of each kind, and characters of all of them.
SAMPLE_PER_LABEL = 1_500
SAMPLE_CHARS = 12_000_000
DICTIONARY_BYTES = 112 * 1024
BLOCK_BYTES = 1_024
LEVEL = 3


@dataclass
class CompressionModel:
    good: bytes
    bad: bytes
    calibration: np.ndarray


def blocks(data: bytes) -> list[bytes]:
    return [data[k : k + BLOCK_BYTES] for k in range(0, len(data), BLOCK_BYTES)]


def dictionary(texts: list[bytes]) -> bytes:
    """A dictionary from the blocks of texts; the blocks themselves where there are too few to train one."""
    samples = [b for t in texts for b in blocks(t)]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-DICTIONARY_BYTES:] or b" " * 8


@lru_cache(maxsize=8)
def _compressor(raw: bytes | None) -> zstandard.ZstdCompressor:
    shared = {"level": LEVEL, "write_content_size": False, "write_checksum": False, "write_dict_id": False}
    if raw is None:
        return zstandard.ZstdCompressor(**shared)
    held = zstandard.ZstdCompressionDict(raw)
    held.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(dict_data=held, **shared)


def evidence(good: bytes, bad: bytes, texts: list[str]) -> np.ndarray:
    """Rows of (1, size difference, the worst block's, good shortening, own shortening, the densest block's, log length).

    Differences are normalised by the larger size; a block shorter than a quarter counts in the sums only.
    """
    by_good, by_bad, plain = _compressor(good).compress, _compressor(bad).compress, _compressor(None).compress
    out = np.zeros((len(texts), 7))
    out[:, 0] = 1
    for k, text in enumerate(texts):
        data = text.encode()
        if not data:
            continue
        parts = blocks(data)
        n = np.array([len(p) for p in parts])
        g, b = np.array([len(by_good(p)) for p in parts]), np.array([len(by_bad(p)) for p in parts])
        full = n >= min(n[0], BLOCK_BYTES // 4)
        gap = (b - g) / np.maximum(b, g)
        total = (b.sum() - g.sum()) / max(b.sum(), g.sum())
        out[k, 1:] = 10 * total, 10 * gap[full].min(), np.log(g.sum() / n.sum()), np.log(len(plain(data)) / len(data)), np.log((g / n)[full].min()), np.log(len(data)) / 10
    return out


def fit_compression(docs: DataFrame, labels: DataFrame, target: str = "quality", **names) -> CompressionModel:
    """Fit on a bounded sample of labelled rows (`SAMPLE_PER_LABEL`, `SAMPLE_CHARS`), copies once."""
    sample = {"per_label": SAMPLE_PER_LABEL, "chars": SAMPLE_CHARS} | names
    counts = label_counts(docs, labels, target, **{k: v for k, v in names.items() if k == "id"})
    return train_compression(labelled_sample(docs, labels, target, **sample), counts)


def train_compression(rows: list[tuple[str, int]], counts: tuple[int, int] | None = None) -> CompressionModel:
    """`counts`: rows labelled 0 and 1 in the table that `rows` are a sample of, if they are not all of it."""
    shift = prior_shift(rows, counts)
    rows = _without_copies(rows)
    y = np.array([v for _, v in rows], dtype=float)
    if len(set(y.tolist())) < 2:
        prior = 0.0 if not len(y) else 3.0 if y[0] else -3.0
        return CompressionModel(b" " * 8, b" " * 8, np.array([prior, 0, 0, 0, 0, 0, 0]))
    build = [k for k in range(len(rows)) if k % 2]
    made = [dictionary([rows[k][0].encode() for k in build if y[k] == v]) for v in (1, 0)]
    rest = [k for k in range(len(rows)) if not k % 2]
    if len(set(y[rest].tolist())) < 2:
        rest = list(range(len(rows)))
    calibration = _logistic(evidence(*made, [rows[k][0] for k in rest]), y[rest], ridge=0.1)
    calibration[0] += shift
    return CompressionModel(*made, calibration)


def score_quality(docs: DataFrame, model: CompressionModel, text: str = "text", threshold: float = 0.7) -> DataFrame:
    """Append `score` (higher: better text) and `predicted`, in the scan's own tasks."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    source = fresh(docs, "text_in")
    keep = [col(c) for c in docs.columns if c.lower() not in ("score", "predicted")]

    def run(batch: pa.RecordBatch) -> dict:
        model = held.value
        x = evidence(model.good, model.bad, batch.column(batch.schema.names.index(source)).to_pylist())
        score = 1 / (1 + np.exp(-np.clip(x @ model.calibration, -30, 30)))
        return {"score": score, "predicted": (score >= threshold).astype(np.int32)}

    add = T.StructType([T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    return map_texts(docs.select(*keep, text_or_empty(text).alias(source)), run, add, source).drop(source)
