"""Line quality by a linear-chain conditional random field.

Every line of a text is labelled bad (0) or good (1). A line's features are its own binned measurements
and those of the lines before and after it. Forward-backward gives each line's marginal; a document's
score is the mean marginal of label 1, weighted by line length.

Training: documents carry one label, which all their lines take. The sample is the first max_docs labelled documents
in the order of a hash, ended early where their lines would exceed max_lines; it holds whole documents of any length, and
only their measurements reach the driver. For training, a chain of more than SEGMENT lines is cut into
several, of which none is left out. Scoring covers every document and every line as one chain.

Edge cases: null and empty texts are one empty line and get that line's marginal; a text of any length is one chain, in
time and memory linear in its lines; blank lines weigh 1; a null doc_id is scored and never held out; repeated rows are
each scored; several labels of one doc_id count as good if any is good; of rows that
repeat a labelled doc_id the one with fewest lines trains; without any label of one of the two classes, and
so with empty tables, the score is 0.5; an empty documents table gives no rows; columns of other names, and
ones that differ from doc_id, text or quality in case only, play no part and stay as they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows, pick, positional, small_batches, written

THRESHOLD = 0.7
#: Bounds of the training sample, documents and lines in all.
MAX_DOCS, MAX_LINES = 4000, 200_000
#: Lines of a chain in training, and lines whose gradient is taken at once.
SEGMENT, CHUNK_LINES = 256, 50_000
_BINS = 8
#: Settings of the training: chosen on a split of the training rows of sf0.1 (see README), never on held-out ones.
ROUNDS, RATE, L2 = 150, 0.08, 1e-4
N_MEASURES = 10


def measures(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(lines x N_MEASURES, lengths in code points + 1)."""
    lines = (text or "").split("\n")
    data = (text or "").encode("utf-8", "surrogatepass")
    raw = np.frombuffer(data + b"\n", np.uint8)
    ends = np.flatnonzero(raw == 10)
    starts = np.concatenate(([0], ends[:-1] + 1))
    sizes = np.maximum(ends - starts, 1).astype(float)

    def share(table: np.ndarray) -> np.ndarray:
        total = np.concatenate(([0], np.cumsum(table[raw], dtype=np.int64)))
        return (total[ends] - total[starts]) / sizes

    out = np.empty((len(lines), N_MEASURES))
    for j, t in enumerate(_TABLES):
        out[:, j] = share(t)
    lengths = np.empty(len(lines))
    for i, line in enumerate(lines):
        words = line.split()
        n = len(words) or 1
        lengths[i] = len(line) + 1
        out[i, 5] = np.log1p(len(line))
        out[i, 6] = len(line) / n
        out[i, 7] = len(set(words)) / n
        out[i, 8] = sum(map(str.__eq__, words, words[1:])) / n
        out[i, 9] = sum(map(str.isalnum, words)) / n
    # as the training sample holds them
    return out.astype(np.float32).astype(float), lengths


def _table(chars: bytes) -> np.ndarray:
    t = np.zeros(256, np.int8)
    t[list(chars)] = 1
    return t


_TABLES = [_table(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"), _table(b"0123456789"), _table(b".,;:?'\"()-"), _table(b"!#$%&*+/<=>@[\\]^_`{|}~"), _table(b" \t")]


class LineCRF:
    """Two-label chain over binned features of a line and its neighbours."""

    def __init__(self, cuts: np.ndarray, weights: np.ndarray, trans: np.ndarray):
        self.cuts, self.weights, self.trans = cuts, weights, trans

    def bins(self, x: np.ndarray) -> np.ndarray:
        """Feature ids, lines x (3 * N_MEASURES): own, previous, next. Each place has a bin for 'no such line'."""
        own = np.empty(x.shape, np.int64)
        for j in range(x.shape[1]):
            own[:, j] = np.searchsorted(self.cuts[j], x[:, j], side="right")
        return neighbours(own)

    def emissions(self, ids: np.ndarray) -> np.ndarray:
        return self.weights[ids].sum(axis=1)

    def marginals(self, s: np.ndarray) -> np.ndarray:
        """P(label 1) of each line; s: emission scores for label 1 over label 0."""
        t00, t01, t10, t11 = np.exp(self.trans - self.trans.max()).ravel().tolist()
        p = 1 / (1 + np.exp(-np.clip(s, -60, 60)))
        ps, n = p.tolist(), len(p)
        f = [0.0] * n
        a0, a1 = 1 - ps[0], ps[0]
        f[0] = a1
        for i in range(1, n):
            b0, b1 = (a0 * t00 + a1 * t10) * (1 - ps[i]), (a0 * t01 + a1 * t11) * ps[i]
            z = b0 + b1
            a0, a1 = b0 / z, b1 / z
            f[i] = a1
        out, b0, b1 = [0.0] * n, 1.0, 1.0
        for i in range(n - 1, -1, -1):
            x1, x0 = f[i] * b1, (1 - f[i]) * b0
            out[i] = x1 / (x0 + x1)
            q0, q1 = (1 - ps[i]) * b0, ps[i] * b1
            b0, b1 = t00 * q0 + t01 * q1, t10 * q0 + t11 * q1
            z = b0 + b1
            b0, b1 = b0 / z, b1 / z
        return np.array(out)

    def score(self, text: str | None) -> float:
        x, lengths = measures(text)
        return float(np.average(self.marginals(self.emissions(self.bins(x))), weights=lengths))


def neighbours(own: np.ndarray) -> np.ndarray:
    """Own, previous and next bins as ids into one weight vector."""
    n, k = own.shape
    width = _BINS + 1
    before, after = np.full_like(own, _BINS), np.full_like(own, _BINS)
    before[1:], after[:-1] = own[:-1], own[1:]
    base = np.arange(k) * width
    return np.concatenate([own + base, before + base + k * width, after + base + 2 * k * width], axis=1)


def _cuts(measured: list[np.ndarray]) -> np.ndarray:
    """Edges of each measure's bins: its quantiles, or those of its uncommon values where most are equal."""
    cuts = np.empty((N_MEASURES, _BINS - 1))
    for j in range(N_MEASURES):
        col = np.concatenate([x[:, j] for x in measured])
        cuts[j] = np.quantile(col, np.linspace(0, 1, _BINS + 1)[1:-1])
        odd = col[col != np.median(col)]
        if len(np.unique(cuts[j])) < 4 and len(odd):
            cuts[j] = np.sort(np.quantile(odd, np.linspace(0, 1, _BINS + 1)[1:-1]))
    return cuts


class _Chunk:
    """Chains of about CHUNK_LINES lines, laid out by time step: at step t the first alive[t] chains have a line."""

    def __init__(self, chains: list[tuple[np.ndarray, int, float]]):
        chains = sorted(chains, key=lambda c: -len(c[0]))
        lens = np.array([len(ids) for ids, _, _ in chains])
        self.top = int(lens[0])
        self.alive = [int((lens > t).sum()) for t in range(self.top)]
        self.at = np.concatenate(([0], np.cumsum(self.alive)))
        self.ids = np.concatenate([np.stack([chains[d][0][t] for d in range(n)]) for t, n in enumerate(self.alive)])
        labels, weights = np.array([y for _, y, _ in chains]), np.array([w for _, _, w in chains])
        self.labels = np.concatenate([labels[:n] for n in self.alive])
        self.weights = np.concatenate([weights[:n] for n in self.alive])
        # each line that has one before it, and that one
        self.later = np.arange(self.at[1], self.at[-1])
        self.earlier = np.concatenate([np.arange(self.at[t - 1], self.at[t - 1] + self.alive[t]) for t in range(1, self.top)] or [np.empty(0, np.int64)])

    def gradient(self, weights: np.ndarray, trans: np.ndarray) -> tuple[float, np.ndarray]:
        """(log-likelihood, its gradient in the weights and transitions), lines weighted."""
        at, alive, total = self.at, self.alive, int(self.at[-1])
        e = np.zeros((total, 2))
        e[:, 1] = weights[self.ids].sum(axis=1)
        alpha, beta = np.empty((total, 2)), np.zeros((total, 2))
        alpha[: at[1]] = e[: at[1]]
        for t in range(1, self.top):
            prev = alpha[at[t - 1] : at[t - 1] + alive[t]]
            alpha[at[t] : at[t + 1]] = np.logaddexp(prev[:, :1] + trans[0], prev[:, 1:] + trans[1]) + e[at[t] : at[t + 1]]
        for t in range(self.top - 2, -1, -1):
            nxt = beta[at[t + 1] : at[t + 2]] + e[at[t + 1] : at[t + 2]]
            beta[at[t] : at[t] + alive[t + 1]] = np.logaddexp(nxt[:, :1] + trans[:, 0], nxt[:, 1:] + trans[:, 1])
        g = alpha + beta
        z = np.logaddexp(g[:, 0], g[:, 1])
        p1 = np.exp(g[:, 1] - z)
        # observed less expected
        out = np.bincount(self.ids.ravel(), np.repeat((self.labels - p1) * self.weights, self.ids.shape[1]), len(weights))
        y, w = self.labels[self.later], self.weights[self.later]
        pairs = np.zeros((2, 2))
        for i in range(2):
            for j in range(2):
                p = np.exp(alpha[self.earlier, i] + trans[i, j] + e[self.later, j] + beta[self.later, j] - z[self.later])
                pairs[i, j] = (w * ((y == i) & (y == j))).sum() - (w * p).sum()
        said = (self.weights * e[:, 1] * self.labels).sum() + (w * trans[y, y]).sum() - (self.weights[: at[1]] * z[: at[1]]).sum()
        return float(said), np.concatenate([out, pairs.ravel()])


def _chunks(crf: LineCRF, docs: list[tuple[np.ndarray, int]]) -> list[_Chunk]:
    """All lines of docs (measures, label) as chunks of chains. A document weighs the same whatever its number of lines."""
    out, held, size = [], [], 0
    for x, y in docs:
        ids = crf.bins(x)
        for lo in range(0, len(ids), SEGMENT):
            held.append((ids[lo : lo + SEGMENT], y, 1.0 / len(ids)))
            size += len(held[-1][0])
            if size >= CHUNK_LINES:
                out.append(_Chunk(held))
                held, size = [], 0
    return [*out, _Chunk(held)] if held else out


def train(docs: list[tuple[np.ndarray, int]], rounds: int = ROUNDS, rate: float = RATE, l2: float = L2) -> LineCRF:
    """Fit by Adam on the mean log-likelihood of a line. docs: (measures, label)."""
    n_weights = 3 * N_MEASURES * (_BINS + 1)
    if len({y for _, y in docs}) < 2:
        return LineCRF(np.zeros((N_MEASURES, _BINS - 1)), np.zeros(n_weights), np.zeros((2, 2)))
    crf = LineCRF(_cuts([x for x, _ in docs]), np.zeros(n_weights), np.zeros((2, 2)))
    chunks = _chunks(crf, docs)
    params = np.zeros(n_weights + 4)
    m, v = np.zeros_like(params), np.zeros_like(params)
    for k in range(1, rounds + 1):
        grad = sum(c.gradient(params[:n_weights], params[n_weights:].reshape(2, 2))[1] for c in chunks) / len(docs) - l2 * params
        m = 0.9 * m + 0.1 * grad
        v = 0.999 * v + 0.001 * grad**2
        params += rate * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.999**k)) + 1e-8)
    return LineCRF(crf.cuts, params[:n_weights], params[n_weights:].reshape(2, 2))


def is_held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, max_docs: int = MAX_DOCS, max_lines: int = MAX_LINES) -> LineCRF:
    """Train on labelled rows that are not held out: a bounded sample, the same rows at each run."""
    marks = pick(labels, "doc_id", "quality").where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    chosen = (
        marks.where(~is_held_out()).select("doc_id", "quality", F.xxhash64("doc_id", F.lit(17)).alias("h")).orderBy("h", "doc_id").limit(max_docs)
    )
    rows = pick(docs, "doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "quality", "h")

    def start():
        def row(doc_id: int, text: str | None, quality: int, h: int) -> Iterator[tuple]:
            x, _ = measures(text)
            yield h, doc_id, len(x), x.astype(np.float32).tobytes(), int(quality > 0)

        return row

    measured = map_rows(rows, start, "h long, doc_id long, lines long, x binary, quality int")
    once = measured.groupBy("h", "doc_id", "quality").agg(F.min(F.struct("lines", "x")).alias("m")).select("h", "doc_id", "m.lines", "m.x", "quality")
    sample = written(once, "qualitysample")
    sizes = sample.select("h", "doc_id", "lines").orderBy("h", "doc_id").limit(max_docs).collect()
    total, last = 0, None
    for r in sizes:
        total += r.lines
        if last is not None and total > max_lines:
            break
        last = r.h
    found = sample.where(F.col("h") <= last).select("h", "doc_id", "x", "quality").collect() if last is not None else []
    return train([(np.frombuffer(bytes(r.x), np.float32).reshape(-1, N_MEASURES).astype(float), r.quality) for r in sorted(found)])


def score(docs: DataFrame, crf: LineCRF, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted. No shuffle; the model has a fixed size."""

    def start():
        def row(doc_id: int | None, text: str | None) -> Iterator[tuple]:
            s = crf.score(text)
            yield doc_id, s, int(s >= threshold)

        return row

    scored = map_rows(pick(docs, "doc_id", "text"), start, "doc_id long, score double, predicted int")
    return scored.select("doc_id", is_held_out().alias("held_out"), "score", "predicted")


def accepted(docs: DataFrame, crf: LineCRF, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs, all columns, whose text scores at least the threshold."""
    inner, (text,), back = positional(docs, "text")

    @F.pandas_udf("double")
    def scored(texts):
        return texts.map(crf.score)

    small_batches(docs.sparkSession)
    return back(inner.where(scored(F.coalesce(text, F.lit(""))) >= threshold))
