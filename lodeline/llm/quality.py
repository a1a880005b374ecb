"""Document quality from a linear-chain conditional random field over lines.

Every line is labelled good or bad. A line's potential weighs its own features and those of the lines before and
after it; a 2 x 2 table of transition potentials ties neighbouring labels. Forward-backward gives each line's marginal
probability of being good; their mean, weighted by line length, is calibrated to the probability of document label 1.

Only documents are labelled, so lines' labels are latent in training: a good document has good lines only, a bad one at
least one bad line (``gradient``). A document of both kinds of lines then gets marginals of both kinds.

Training uses a bounded sample: at most ``sample_docs`` labelled documents (the smallest hashes of their ids) of at
most ``sample_lines`` lines each. Their line features, not their texts, go to the driver. Scoring covers every row and
whole texts, and reads nothing but the text.

Defined cases: null and empty texts are one empty line, in training and in scoring; repeated rows are each scored; several
labels of one id count as their maximum, and of several texts of one id the least is learnt from; with labels of one
class only every score is that class's smoothed share, with none it is 0.5; an empty table gives an empty result; other
columns pass through ``score`` untouched.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodeline.llm.common import crc_mod, ship, slices, texts_of
from lodeline.llm.words import NOT_SPACE, split

#: Characters that mark up or decorate rather than write.
SYMBOLS = b"#*$%&|<>"
OWN = 15


def _mask(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


_UPPER = _mask(bytes(range(65, 91)))
_LETTER = _mask(bytes(range(65, 91)) + bytes(range(97, 123)))
_KINDS = [_UPPER, _LETTER, _mask(SYMBOLS), _mask(b"!"), _mask(b"0123456789"), _mask(b",.;:?"), _mask(b"|"), ~_mask(bytes(range(128, 192)))]


def line_features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features, length in characters, index of each text's first line and one more) of all lines of the texts."""
    raw = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    ends = np.flatnonzero(raw == 10)
    starts = np.concatenate([[0], ends[:-1] + 1])
    lines = np.concatenate([[0], np.cumsum([t.count(b"\n") + 1 for t in texts])]).astype(np.int64)
    counts = []
    total = np.zeros(len(raw) + 1, np.int32)
    for kind in _KINDS:
        np.cumsum(kind[raw], out=total[1:], dtype=np.int32)
        counts.append((total[ends] - total[starts]).astype(np.float64))
    upper, letter, symbol, bang, digit, stop, bar, chars = counts
    words = split(texts, NOT_SPACE)
    line = np.searchsorted(starts, words.at, "right") - 1
    n = len(starts)
    many = np.bincount(line, minlength=n).astype(np.float64)
    span = np.bincount(line, weights=words.ends - words.starts, minlength=n)
    shift = np.uint64(64 - max(1, n.bit_length()))
    key = np.unique((line.astype(np.uint64) << shift) | (words.hashes >> (np.uint64(64) - shift)))
    kinds = np.bincount((key >> shift).astype(np.int64), minlength=n).astype(np.float64)
    twin = np.zeros(len(line), bool)
    if len(line) > 1:
        twin[1:] = (line[1:] == line[:-1]) & (words.hashes[1:] == words.hashes[:-1])
    twins = np.bincount(line[twin], minlength=n).astype(np.float64)
    # A line's hash is the sum of its words' hashes times their places; equal to an earlier line of its text or not.
    place = np.arange(len(line), dtype=np.uint64) - np.searchsorted(line, line).astype(np.uint64)
    sums = np.concatenate([[np.uint64(0)], np.cumsum(words.hashes * (place * np.uint64(2) + np.uint64(1)), dtype=np.uint64)])
    first = np.searchsorted(line, np.arange(n + 1))
    whole = sums[first[1:]] - sums[first[:-1]]
    owner = np.repeat(np.arange(len(texts)), np.diff(lines))
    order = np.lexsort((whole, owner))
    again = np.zeros(n, bool)
    again[order[1:]] = (whole[order[1:]] == whole[order[:-1]]) & (owner[order[1:]] == owner[order[:-1]]) & (many[order[1:]] > 0)
    some, size = np.maximum(many, 1), np.maximum(chars, 1)
    tail = raw[np.maximum(ends - 1, starts)]
    closed = (chars > 0) & np.isin(tail, list(b".!?\"')"))
    out = np.stack(
        [
            np.ones(n),
            np.log1p(chars) / 8,
            many == 0,
            upper / np.maximum(letter, 1),
            np.minimum(1, 4 * upper / size),
            np.minimum(1, 10 * symbol / size),
            np.minimum(1, 10 * bang / size),
            np.minimum(1, 5 * digit / size),
            np.minimum(2, span / some / 10),
            kinds / some,
            np.minimum(1, 4 * twins / some),
            np.minimum(1, 4 * stop / some),
            np.minimum(1, 2 * bar / some),
            closed,
            again,
        ],
        axis=1,
    )
    return out, chars, lines


def with_neighbours(own: np.ndarray, lines: np.ndarray) -> np.ndarray:
    """Each line's features beside those of the line before and after it; zeros beyond the ends of a text."""
    before, after = np.zeros_like(own), np.zeros_like(own)
    before[1:], after[:-1] = own[:-1], own[1:]
    full = lines[:-1][np.diff(lines) > 0]
    before[full] = 0
    after[lines[1:][np.diff(lines) > 0] - 1] = 0
    return np.concatenate([own, before, after], axis=1)


def forward_backward(e: np.ndarray, lines: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log odds of the forward and backward messages at each line; their sum is the marginal's log odds.

    e: log odds of each line's own potential; t[i, j]: transition potential from label i to label j.
    Sequences advance together, the longest ones last.
    """
    a, b = np.empty_like(e), np.empty_like(e)
    order = np.argsort(-np.diff(lines), kind="stable")
    first, last = lines[:-1][order], lines[1:][order] - 1
    sizes = np.diff(lines)[order]
    active = len(sizes) - np.searchsorted(sizes[::-1], np.arange(1, int(sizes.max(initial=0)) + 1), "left")
    for step, n in enumerate(active):
        at = first[:n] + step
        if step == 0:
            a[at] = e[at]
        else:
            p = a[at - 1]
            a[at] = e[at] + np.logaddexp(p + t[1, 1], t[0, 1]) - np.logaddexp(p + t[1, 0], t[0, 0])
    for step, n in enumerate(active):
        at = last[:n] - step
        if step == 0:
            b[at] = 0
        else:
            q = e[at + 1] + b[at + 1]
            b[at] = np.logaddexp(t[1, 1] + q, t[1, 0]) - np.logaddexp(t[0, 1] + q, t[0, 0])
    return a, b


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))


@dataclass
class Crf:
    weights: np.ndarray
    transitions: np.ndarray
    scale: tuple[float, float]
    constant: float | None = None

    def marginals(self, x: np.ndarray, lines: np.ndarray) -> np.ndarray:
        """Log odds of each line being good."""
        a, b = forward_backward(x @ self.weights, lines, self.transitions)
        return a + b

    def raw(self, texts: list[bytes]) -> np.ndarray:
        own, chars, lines = line_features(texts)
        return document_odds(self.marginals(with_neighbours(own, lines), lines), chars, lines)

    def score(self, texts: list[bytes]) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(texts), self.constant)
        return _sigmoid(self.scale[0] * self.raw(texts) + self.scale[1])


def document_odds(odds: np.ndarray, chars: np.ndarray, lines: np.ndarray) -> np.ndarray:
    """Log odds of the length-weighted mean marginal of each text's lines."""
    weight = chars + 1
    p = np.add.reduceat(_sigmoid(odds) * weight, lines[:-1]) / np.add.reduceat(weight, lines[:-1])
    p = np.clip(p, 1e-4, 1 - 1e-4)
    return np.log(p / (1 - p))


def gradient(theta: np.ndarray, x: np.ndarray, lines: np.ndarray, labels: np.ndarray, whole: float = 0.1) -> tuple[float, np.ndarray]:
    """Log-likelihood of document labels and its gradient, exact, with lines' labels latent.

    A document of label 1 has good lines only; one of label 0 has at least one bad line, any of them. So the first give
    log P(all good), the second log(1 - P(all good)), and a bad document's clean lines may stay good. That most bad
    documents are bad throughout comes in with a weight of ``whole``: the second also give whole * log P(all bad).
    """
    w, t = theta[:-4], theta[-4:].reshape(2, 2)
    e = x @ w
    a, b = forward_backward(e, lines, t)
    odds = a + b
    p = _sigmoid(odds)
    inner = np.ones(len(e), bool)
    inner[lines[1:] - 1] = False
    left = np.flatnonzero(inner)
    q = (e + b)[left + 1]
    pair = np.stack([np.full(len(left), t[0, 0]), t[0, 1] + q, t[1, 0] + a[left], t[1, 1] + a[left] + q])
    pair -= np.logaddexp.reduce(pair, axis=0)

    def alike(sign: int, same: np.ndarray) -> np.ndarray:
        """log P(all lines of the label): that of the first line, and of each step, given the line before."""
        steps = np.zeros(len(e))
        steps[left] = same + np.logaddexp(0, -sign * odds[left])
        return np.minimum(np.add.reduceat(steps, lines[:-1]) - np.logaddexp(0, -sign * odds[lines[:-1]]), -1e-12)

    all_good, all_bad, good = alike(1, pair[3]), alike(-1, pair[0]), labels == 1
    to_good = np.repeat(np.where(good, 1.0, np.exp(all_good) / np.expm1(all_good)), np.diff(lines))
    to_bad = np.repeat(np.where(good, 0.0, whole), np.diff(lines))
    moves = np.array([to_bad[left].sum(), 0.0, 0.0, to_good[left].sum()]) - np.exp(pair) @ (to_good + to_bad)[left]
    value = float(np.where(good, all_good, np.log(-np.expm1(all_good)) + whole * all_bad).sum())
    return value, np.concatenate([x.T @ (to_good * (1 - p) - to_bad * p), moves])


def fit(own: list[np.ndarray], chars: list[np.ndarray], labels: np.ndarray, rounds: int = 400, ridge: float = 1e-5, whole: float = 0.1) -> Crf:
    """Maximum likelihood by Adam, then a logistic calibration of the documents' odds."""
    if len(set(labels.tolist())) < 2:
        constant = 0.5 if not len(labels) else float((labels.sum() + 0.5) / (len(labels) + 1))
        return Crf(np.zeros(3 * OWN), np.zeros((2, 2)), (1.0, 0.0), constant)
    lines = np.concatenate([[0], np.cumsum([len(x) for x in own])]).astype(np.int64)
    x, size = with_neighbours(np.concatenate(own), lines), np.concatenate(chars)
    theta = np.zeros(x.shape[1] + 4)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, rounds + 1):
        grad = gradient(theta, x, lines, labels, whole)[1] / len(labels) - ridge * theta
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
        theta = theta + 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    crf = Crf(theta[:-4], theta[-4:].reshape(2, 2), (1.0, 0.0))
    z = document_odds(crf.marginals(x, lines), size, lines)
    crf.scale = calibrate(z, labels)
    return crf


def calibrate(z: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> tuple[float, float]:
    """Slope and intercept of a ridge logistic regression, by Newton steps."""
    beta = np.array([1.0, 0.0])
    x = np.stack([z, np.ones_like(z)], axis=1)
    for _ in range(25):
        p = _sigmoid(x @ beta)
        grad = x.T @ (y - p) - ridge * (beta - [1.0, 0.0])
        hess = (x * (p * (1 - p) + 1e-9)[:, None]).T @ x + ridge * np.eye(2)
        beta = beta + np.clip(np.linalg.solve(hess, grad), -2, 2)
    return float(beta[0]), float(beta[1])


def train(docs: DataFrame, labels: DataFrame, sample_docs: int = 2000, sample_lines: int = 2000) -> Crf:
    ship(docs.sparkSession)
    known = labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & (crc_mod(F.col("doc_id")) != 2))
    sample = known.groupBy("doc_id").agg(F.max("quality").cast("int").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_docs)

    def run(batches):
        for batch in batches:
            texts, out = texts_of(batch.column(1)), []
            for a, b in slices(texts):
                own, chars, lines = line_features(texts[a:b])
                for i in range(b - a):
                    cut = slice(lines[i], lines[i + 1])
                    out.append((own[cut].astype(np.float32).tobytes(), chars[cut].astype(np.float32).tobytes()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x for x, _ in out], pa.binary()), pa.array([c for _, c in out], pa.binary())], ["label", "x", "chars"])

    # The sample has at most sample_docs rows, so it may go to every executor.
    chosen = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").filter(F.coalesce(F.regexp_count("text", F.lit("\n")), F.lit(0)) < sample_lines)
    # One text of each id, chosen before the shuffle, so an id of very many rows is one row of each task.
    once = chosen.groupBy("doc_id", "label").agg(F.min("text").alias("text"))
    rows = once.orderBy("doc_id").limit(sample_docs).select("label", "text").mapInArrow(run, "label int, x binary, chars binary").collect()
    own = [np.frombuffer(r.x, np.float32).reshape(-1, OWN).astype(np.float64) for r in rows]
    chars = [np.frombuffer(r.chars, np.float32).astype(np.float64) for r in rows]
    return fit(own, chars, np.array([r.label for r in rows], np.int64))


def score(docs: DataFrame, model: Crf, keep: list[str], minimum: float | None = None) -> DataFrame:
    """``keep`` columns of each row of ``docs`` with its quality_score; with ``minimum``, only rows of at least that."""
    ship(docs.sparkSession)
    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField("quality_score", T.DoubleType())])
    k = len(keep)

    def run(batches):
        for batch in batches:
            texts = texts_of(batch.column(k))
            values = np.concatenate([np.zeros(0)] + [model.score(texts[a:b]) for a, b in slices(texts)])
            out = pa.RecordBatch.from_arrays([*batch.columns[:k], pa.array(values, pa.float64())], [*batch.schema.names[:k], "quality_score"])
            yield out if minimum is None else out.filter(pa.array(values >= minimum))

    return docs.select(*[F.col(f"`{c}`") for c in keep], F.col("text").alias("_text")).mapInArrow(run, schema)


def op2_quality_crf(spark, sf_dir: str) -> DataFrame:
    """Whole ``documents``, learnt from the labelled rows that are not held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    found = score(docs, model, ["doc_id"])
    return found.select(
        "doc_id",
        F.coalesce(crc_mod(F.col("doc_id")) == 2, F.lit(False)).alias("held_out"),
        F.col("quality_score").alias("score"),
        (F.col("quality_score") >= 0.7).cast("int").alias("predicted"),
    )


def keep_good(docs: DataFrame, labels: DataFrame, minimum: float = 0.7) -> DataFrame:
    """The rows of ``docs`` whose score is at least ``minimum``, all columns. Labels of fewer than two classes teach
    nothing, so then all rows stay."""
    model = train(docs, labels)
    if model.constant is not None:
        return docs
    names = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    inner = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()], F.col("text"))
    kept = score(inner, model, list(names.values()), minimum)
    return kept.select(*[F.col(n).alias(c) for c, n in names.items()])
