"""Toxic spans by a linear-chain conditional random field, summed up to a document score.

Labels exist per document only, so token labels are derived first: in documents labelled toxic, a
token is labelled toxic when one of its features (the word, a prefix or suffix of it) is far more
common in toxic than in clean training documents. A two-state chain learns from these, with a weight
per feature and per transition; forward-backward gives each token's marginal. Expected toxic tokens,
the largest marginal and the length enter a logistic calibration fitted on documents that the chain
has not seen.

Defined cases: null and empty texts have no tokens and get the score of no evidence; ties and
repeated rows score alike; words of texts of any length are found in the text as it is; an empty table gives no rows; an input without labelled rows of both kinds gives a model that scores
everything at the prior (0.5 without any label).
"""

from __future__ import annotations

import re
import sys
import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import col, fresh, map_texts, text_or_empty

#: Labelled documents that training may take of each kind, and characters of all of them.
SAMPLE_PER_LABEL = 1_500
SAMPLE_CHARS = 10_000_000
#: Neutral tokens in a row that training keeps; scoring uses every token.
NEUTRAL_RUN = 6
WORD = re.compile(r"[^\W\d_]+")


def word_features(word: str) -> list[str]:
    out = ["=" + word]
    out += ["^" + word[:k] for k in range(3, min(len(word), 9))]
    out += ["$" + word[-k:] for k in range(3, min(len(word), 6))]
    return out


@dataclass
class ToxicModel:
    weights: dict[str, float]
    bias: float
    transitions: np.ndarray  # log-potentials [from, to]
    start: np.ndarray
    calibration: np.ndarray

    def emission(self, word: str) -> float:
        get = self.weights.get
        return self.bias + sum(w for f in word_features(word) if (w := get(f)) is not None)


def labelled_sample(docs: DataFrame, labels: DataFrame, target: str, id: str = "doc_id", text: str = "text",
                    per_label: int = SAMPLE_PER_LABEL, chars: int = SAMPLE_CHARS) -> list[tuple[str, int]]:
    """At most `per_label` whole labelled texts of each kind, in the order of a hash of the id.

    The bound is the only sampling in this operator; scoring covers every row. Ids are chosen
    first, so the join that fetches texts sees a few thousand rows. Texts are taken in hash
    order until `chars` is reached.
    """
    marks = labels.select(F.col(id).alias("i"), F.col(target).cast("int").alias("y")).filter("i is not null and y in (0, 1)").distinct()
    chosen = None
    for y in (0, 1):
        part = marks.filter(F.col("y") == y).orderBy(F.xxhash64("i", F.lit(11)), "i").limit(per_label)
        chosen = part if chosen is None else chosen.unionByName(part)
    found = docs.select(col(id).alias("i"), F.length(text_or_empty(text)).alias("n"), text_or_empty(text).alias("t")).join(F.broadcast(chosen), "i")
    order = [F.xxhash64("i", F.lit(11)), F.col("i"), F.col("y"), F.xxhash64("t")]
    rows, used = [], 0
    for r in sorted(found.select(F.struct(*order).alias("o"), "n", "y", "t").toLocalIterator(), key=lambda r: tuple(r["o"])):
        if used + r["n"] <= chars:
            used += r["n"]
            rows.append((r["t"], r["y"]))
    return rows


def label_counts(docs: DataFrame, labels: DataFrame, target: str, id: str = "doc_id") -> tuple[int, int]:
    """Rows of `docs` labelled 0 and 1: what `labelled_sample` draws from."""
    marks = labels.select(F.col(id).alias("i"), F.col(target).cast("int").alias("y")).filter("i is not null and y in (0, 1)").distinct()
    n = docs.select(col(id).alias("i")).join(marks, "i").agg(F.count_if(F.col("y") == 0).alias("n0"), F.count_if(F.col("y") == 1).alias("n1")).first()
    return n["n0"], n["n1"]


def prior_shift(rows: list[tuple[str, int]], counts: tuple[int, int] | None) -> float:
    """What the log-odds of a fit on the sample `rows` lack where label 0 and 1 have `counts` rows."""
    ones = sum(y for _, y in rows)
    if counts is None or not (ones and len(rows) - ones and all(counts)):
        return 0.0
    return float(np.log(counts[1] / counts[0]) - np.log(ones / (len(rows) - ones)))


def forward_backward(s: np.ndarray, first: np.ndarray, trans: np.ndarray, start: np.ndarray):
    """(marginals of state 1, summed pair marginals) of texts laid end to end.

    Products of the 2x2 potentials run over blocks side by side, then across blocks, so the work is
    linear in the tokens and a text of any length takes no longer Python loop than many short ones.
    The first token of a text ignores what came before: both rows of its potentials are equal.
    """
    n = len(s)
    if n == 0:
        return np.zeros(0), np.zeros((2, 2))
    size = max(1, int(np.sqrt(n)))
    blocks = -(-n // size)
    e = np.exp(np.clip(s, -30, 30))
    low = np.maximum(1.0, e)
    flat = []
    for i in (0, 1):
        for j in (0, 1):
            m = np.where(first, np.exp(start[j]), np.exp(trans[i, j])) * (e if j else 1.0) / low
            cell = np.full(blocks * size, 1.0 if i == j else 0.0)
            cell[:n] = m
            flat.append(np.ascontiguousarray(cell.reshape(blocks, size).T))
    c00, c01, c10, c11 = flat  # each [step, block]
    f00, f01, f10, f11 = (np.empty_like(c00) for _ in range(4))
    g00, g01, g10, g11 = (np.empty_like(c00) for _ in range(4))
    f00[0], f01[0], f10[0], f11[0] = c00[0], c01[0], c10[0], c11[0]
    for k in range(1, size):
        f00[k] = f00[k - 1] * c00[k] + f01[k - 1] * c10[k]
        f01[k] = f00[k - 1] * c01[k] + f01[k - 1] * c11[k]
        f10[k] = f10[k - 1] * c00[k] + f11[k - 1] * c10[k]
        f11[k] = f10[k - 1] * c01[k] + f11[k - 1] * c11[k]
        if k % 6 == 0:
            top = np.maximum(np.maximum(f00[k], f01[k]), np.maximum(f10[k], f11[k]))
            for f in (f00, f01, f10, f11):
                f[k] /= top
    g00[-1], g01[-1], g10[-1], g11[-1] = 1.0, 0.0, 0.0, 1.0
    for k in range(size - 2, -1, -1):
        g00[k] = c00[k + 1] * g00[k + 1] + c01[k + 1] * g10[k + 1]
        g01[k] = c00[k + 1] * g01[k + 1] + c01[k + 1] * g11[k + 1]
        g10[k] = c10[k + 1] * g00[k + 1] + c11[k + 1] * g10[k + 1]
        g11[k] = c10[k + 1] * g01[k + 1] + c11[k + 1] * g11[k + 1]
        if k % 6 == 0:
            top = np.maximum(np.maximum(g00[k], g01[k]), np.maximum(g10[k], g11[k]))
            for g in (g00, g01, g10, g11):
                g[k] /= top
    left, right = np.empty((blocks, 2)), np.empty((blocks, 2))
    x, y = 0.5, 0.5
    ends = [f[-1].tolist() for f in (f00, f01, f10, f11)]
    for b in range(blocks):
        left[b] = x, y
        x, y = x * ends[0][b] + y * ends[2][b], x * ends[1][b] + y * ends[3][b]
        x, y = x / (x + y), y / (x + y)
    x, y = 0.5, 0.5
    head = [c[0].tolist() for c in (c00, c01, c10, c11)]
    rest = [g[0].tolist() for g in (g00, g01, g10, g11)]
    for b in range(blocks - 1, -1, -1):
        right[b] = x, y
        u, w = rest[0][b] * x + rest[1][b] * y, rest[2][b] * x + rest[3][b] * y
        x, y = head[0][b] * u + head[1][b] * w, head[2][b] * u + head[3][b] * w
        x, y = x / (x + y), y / (x + y)
    a0, a1 = left[:, 0] * f00 + left[:, 1] * f10, left[:, 0] * f01 + left[:, 1] * f11
    b0, b1 = g00 * right[:, 0] + g01 * right[:, 1], g10 * right[:, 0] + g11 * right[:, 1]
    a1 = (a1 / (a0 + a1)).T.reshape(-1)[:n]
    b1 = (b1 / (b0 + b1)).T.reshape(-1)[:n]
    a0, b0 = 1 - a1, 1 - b1
    p = a1 * b1 / (a0 * b0 + a1 * b1)
    inner = np.flatnonzero(~first)
    t = np.exp(trans)
    q = [[(a1 if i else a0)[inner - 1] * t[i, j] * (e[inner] * b1[inner] if j else b0[inner]) for j in (0, 1)] for i in (0, 1)]
    total = q[0][0] + q[0][1] + q[1][0] + q[1][1]
    return p, np.array([[(q[i][j] / total).sum() for j in (0, 1)] for i in (0, 1)])


def _evidence(p: np.ndarray, first_at: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Rows of (1, log expected toxic tokens, largest marginal, log tokens) per text."""
    out = np.zeros((len(sizes), 4))
    out[:, 0], out[:, 1] = 1, np.log(0.01)
    full = np.flatnonzero(sizes)
    if len(full):
        starts = first_at[full]
        out[full, 1] = np.log(np.add.reduceat(p, starts) + 0.01)
        out[full, 2] = np.maximum.reduceat(p, starts)
        out[full, 3] = np.log1p(sizes[full])
    return out


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (p - y) + ridge * w * (np.arange(len(w)) > 0)
        hess = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.diag((np.arange(len(w)) > 0) + 1e-6)
        step = np.linalg.solve(hess, grad)
        w = w - step * min(1.0, 5 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-8:
            break
    return w


def _layout(texts: list[list[str]]):
    sizes = np.array([len(x) for x in texts], dtype=np.int64)
    first_at = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64) if len(sizes) else sizes
    first = np.zeros(int(sizes.sum()), dtype=bool)
    first[first_at[sizes > 0]] = True
    return sizes, first_at, first


def _without_copies(rows: list[tuple[str, int]]) -> list[tuple[str, int]]:
    """One training text of each group of copies, so that no text's words count many times over."""
    seen, out = set(), []
    for t, y in rows:
        w = WORD.findall(t.lower())
        shingles = (" ".join(w[i : i + 5]).encode() for i in range(max(1, len(w) - 4)))
        least = [2**32, 2**32]
        for x in shingles:
            least = [min(m, zlib.crc32(x, salt)) for salt, m in enumerate(least)]
        marks = {(salt, y, m) for salt, m in enumerate(least)}
        if not marks & seen:
            out.append((t, y))
        seen |= marks
    return out


def _thinned(words: list[int]) -> list[int]:
    out, run = [], 0
    for w in words:
        run = run + 1 if w == 0 else 0
        if run <= NEUTRAL_RUN:
            out.append(w)
    return out


def train(rows: list[tuple[str, int]], rounds: int = 60, least_docs: int = 3, ratio: float = 8.0, z: float = 2.8, ridge: float = 0.02,
          counts: tuple[int, int] | None = None) -> ToxicModel:
    """Fit chain and calibration on (text, label) rows; a third of the rows is kept for calibration.

    `counts`: rows labelled 0 and 1 in the table that `rows` are a sample of, if they are not all of it.
    """
    shift = prior_shift(rows, counts)
    rows = _without_copies(rows)
    y_all = np.array([y for _, y in rows])
    flat = ToxicModel({}, 0.0, np.zeros((2, 2)), np.zeros(2), np.zeros(4))
    if len(set(y_all.tolist())) < 2:
        if len(y_all):
            flat.calibration[0] = 3.0 if y_all[0] else -3.0
        return flat
    # one string object per distinct word keeps the driver's memory small
    words = [[sys.intern(w.lower()) for w in WORD.findall(t)] for t, _ in rows]
    chain = [i for i in range(len(rows)) if i % 3]
    df: dict[int, Counter] = {0: Counter(), 1: Counter()}
    for i in chain:
        if y_all[i]:
            df[1].update({f for w in set(words[i]) for f in word_features(w)})
    df[1] = Counter({f: a for f, a in df[1].items() if a >= least_docs})
    for i in chain:
        if not y_all[i]:
            df[0].update({f for w in set(words[i]) for f in word_features(w) if f in df[1]})
    n1, n0 = max(1, int(y_all[chain].sum())), max(1, int((1 - y_all[chain]).sum()))
    keep, marked = {}, set()
    for f, a in df[1].items():
        b = df[0].get(f, 0)
        pa_, pb = (a + 0.5) / (n1 + 1), (b + 0.5) / (n0 + 1)
        strength = np.log(pa_ / pb) / np.sqrt(1 / (a + 0.5) + 1 / (b + 0.5))
        if strength > 1.5:
            keep[f] = len(keep)
        if pa_ / pb > ratio and strength > z:
            marked.add(f)
    # distinct words share their emission; a word without a kept feature has the bias only
    ids: dict[str, int] = {}
    owners: list[list[int]] = [[]]
    toxic_word = [False]

    def number(word: str) -> int:
        at = ids.get(word)
        if at is None:
            own = [keep[f] for f in word_features(word) if f in keep]
            if not own:
                at = 0
            else:
                at = len(owners)
                owners.append(own)
                toxic_word.append(any(f in marked for f in word_features(word)))
            ids[word] = at
        return at

    seq = [_thinned([number(w) for w in words[i]]) for i in chain]
    tokens = np.array([w for x in seq for w in x], dtype=np.int64)
    _, _, first = _layout(seq)
    doc_toxic = np.repeat(y_all[chain], [len(x) for x in seq]).astype(bool)
    gold = (doc_toxic & np.array(toxic_word)[tokens]).astype(np.int64)
    flat_f = np.array([f for own in owners for f in own], dtype=np.int64)
    flat_w = np.repeat(np.arange(len(owners)), [len(o) for o in owners])
    inner = np.flatnonzero(~first)
    gold_pairs = np.bincount(gold[inner - 1] * 2 + gold[inner], minlength=4).reshape(2, 2)
    gold_start = np.bincount(gold[first], minlength=2)
    theta = np.zeros(len(keep) + 1 + 4 + 2)
    theta[len(keep)] = -3.0
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    k = len(keep)
    for step in range(1, rounds + 1):
        emission = np.bincount(flat_w, weights=theta[flat_f], minlength=len(owners)) + theta[k]
        p, pairs = forward_backward(emission[tokens], first, theta[k + 1 : k + 5].reshape(2, 2), theta[k + 5 :])
        over = p - gold
        by_word = np.bincount(tokens, weights=over, minlength=len(owners))
        grad = np.concatenate([
            np.bincount(flat_f, weights=by_word[flat_w], minlength=k), [over.sum()], (pairs - gold_pairs).ravel(),
            np.array([(1 - p[first]).sum(), p[first].sum()]) - gold_start,
        ]) + ridge * theta
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        theta = theta - 0.25 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    model = ToxicModel({f: float(theta[i]) for f, i in keep.items()}, float(theta[k]), theta[k + 1 : k + 5].reshape(2, 2), theta[k + 5 :], np.zeros(4))
    unseen = [i for i in range(len(rows)) if i % 3 == 0]
    if len(set(y_all[unseen].tolist())) < 2:
        unseen = list(range(len(rows)))
    sizes, first_at, first = _layout([words[i] for i in unseen])
    cache: dict[str, float] = {}
    s = np.array([cache[w] if w in cache else cache.setdefault(w, model.emission(w)) for i in unseen for w in words[i]], dtype=float)
    p, _ = forward_backward(s, first, model.transitions, model.start)
    x = _evidence(p, first_at, sizes)
    # the bounds of the sample may balance the labels; the shift makes scores chances at the table's own ratio
    model.calibration = _logistic(x, y_all[unseen].astype(float))
    model.calibration[0] += shift
    return model


def score_toxicity(docs: DataFrame, model: ToxicModel, text: str = "text", threshold: float = 0.7, span_at: float = 0.5) -> DataFrame:
    """Append `score`, `predicted` and `spans` (start, end in code points, end exclusive, with the marginal).

    One pass in the scan's tasks: no shuffle, and memory follows a few MB of text at a time. A column
    of the input that has one of these names is dropped in favour of the new one.
    """
    docs = docs.select(*[col(c) for c in docs.columns if c.lower() not in ("score", "predicted", "spans")])
    held = docs.sparkSession.sparkContext.broadcast(model)
    seen: dict[str, float] = {}
    # a string column crosses to Python once, anything else as a copy cast to text
    plain = isinstance(docs.schema[text].dataType, T.StringType)
    source = text if plain else fresh(docs, "text_in")
    span = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("p", T.DoubleType())])
    add = T.StructType([T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType()), T.StructField("spans", T.ArrayType(span))])

    def run(batch: pa.RecordBatch) -> dict:
        model = held.value
        if len(seen) > 150_000:
            seen.clear()
        texts = [t or "" for t in batch.column(batch.schema.names.index(source)).to_pylist()]
        # words come from the text as it is, since lower case may change its length
        words = [WORD.findall(t) for t in texts]
        for w in set().union(*words) - seen.keys():
            seen[w] = model.emission(w.lower())
        sizes, first_at, first = _layout(words)
        s = np.fromiter((seen[w] for x in words for w in x), dtype=float, count=int(sizes.sum()))
        p, _ = forward_backward(s, first, model.transitions, model.start)
        scores = 1 / (1 + np.exp(-np.clip(_evidence(p, first_at, sizes) @ model.calibration, -30, 30)))
        hot = np.flatnonzero(p >= span_at)
        spans: list[list[dict]] = [[] for _ in texts]
        for d in np.unique(np.searchsorted(np.cumsum(sizes), hot, side="right")).tolist():
            base, out = int(first_at[d]), spans[d]
            last = -2
            for k, m in enumerate(WORD.finditer(texts[d])):
                if p[base + k] >= span_at:
                    if out and last == k - 1:
                        out[-1]["end"], out[-1]["p"] = m.end(), max(out[-1]["p"], float(p[base + k]))
                    else:
                        out.append({"start": m.start(), "end": m.end(), "p": float(p[base + k])})
                    last = k
        return {"score": scores, "predicted": (scores >= threshold).astype(np.int32), "spans": spans}

    if plain:
        return map_texts(docs, run, add, source)
    return map_texts(docs.withColumn(source, text_or_empty(text)), run, add, source).drop(source)


def fit_toxicity(docs: DataFrame, labels: DataFrame, **names) -> ToxicModel:
    counts = label_counts(docs, labels, "toxic", **{k: v for k, v in names.items() if k == "id"})
    return train(labelled_sample(docs, labels, "toxic", **names), counts=counts)
