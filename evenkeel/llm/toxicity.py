"""Toxic spans by a linear-chain conditional random field, and document scores from its marginals.

Fit: token statistics of the labelled training rows choose indicative features (words, and word beginnings and ends of
four to six letters).  A token with such a feature in a toxic row is labelled toxic, every other token clean; on these
labelled tokens a two-state chain (clean, toxic) is trained.  Tokens without a feature are background.

Background runs of any length are one step, in training as in scoring: powers of one 2 x 2 matrix, and the expected
transitions inside a run, have closed forms.  So whole texts are trained on and scored, and marginals are exact.  Every
step of the training is one pass of sums over the stored sequences; only these sums reach the driver.

Score: forward-backward over the whole text.  The log odds that any token is toxic and the expected number of toxic
tokens among those with a feature go through a logistic calibration to a document score.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dealt, durable, extended, held_out, map_arrow, quoted, rest

_WORD = re.compile(r"[^\W_]+")
_CACHE = 400_000


@dataclass(frozen=True)
class Settings:
    """Of the fit.  Only the labelled sample is bounded; every document is scored over its whole text."""

    max_train_docs: int = 15_000  # labelled rows, smallest hash of the id first; all of them, whole, train the chain
    min_toxic_docs: int = 8
    min_log_odds: float = 2.0
    min_z: float = 5.0
    steps: int = 40  # of the optimiser, at most; it ends before when the gradient is small
    ridge: float = 1e-4
    transitions: bool = True  # False: a list of weighted features without a chain, to compare with
    threshold: float = 0.5


@dataclass
class Model:
    """weights: a log weight of the toxic state by feature; trans: log weights of the steps from clean to toxic, from toxic
    to clean and from toxic to toxic, against clean to clean (0); a chain begins in the clean state; calibration: bias
    and two slopes."""

    weights: dict[str, float] = field(default_factory=dict)
    bias: float = -6.0
    trans: tuple[float, float, float] = (0.0, 0.0, 0.0)
    calibration: tuple[float, float, float] = (-4.0, 0.0, 0.0)


def features(word: str) -> Iterator[str]:
    """Feature names of a lower-case word."""
    yield "=" + word
    for n in (4, 5, 6):
        if len(word) > n:
            yield "^" + word[:n]
            yield "$" + word[-n:]


@dataclass
class Lattice:
    """What forward-backward gives for a batch: per sequence logz (over the score of its all-clean path), per hit the
    joint marginals of the states before and at it, and the vectors on both sides of each run of background."""

    logz: np.ndarray
    pairs: np.ndarray
    run_left: np.ndarray
    run_right: np.ndarray


class Chain:
    """The two-state chain over sequences of hits (tokens with a feature) and runs of background between them."""

    def __init__(self, bias: float, trans: tuple[float, float, float]):
        enter, leave, stay = trans
        self.step = np.exp([[0.0, enter], [leave, stay]])  # from state to state, whatever the token says
        self.run = self.step * np.exp([0.0, bias])  # a background token
        (a, b), (c, d) = self.run
        root = math.sqrt((a - d) ** 2 + 4 * b * c)
        self.top, low = (a + d + root) / 2, (a + d - root) / 2
        self.ratio = low / self.top
        # run ** n = top ** n * (main + ratio ** n * side)
        self.main = (self.run - low * np.eye(2)) / root
        self.side = (self.top * np.eye(2) - self.run) / root

    def over(self, left: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Row vectors moved over runs of n background tokens, by run ** n / top ** n."""
        return np.maximum(left @ self.main + (self.ratio**n)[:, None] * (left @ self.side), 0)

    def back(self, right: np.ndarray, n: np.ndarray) -> np.ndarray:
        """The same for column vectors, from the right."""
        return np.maximum(right @ self.main.T + (self.ratio**n)[:, None] * (right @ self.side.T), 0)

    def forward_backward(self, sizes: np.ndarray, gaps: np.ndarray, weights: np.ndarray) -> Lattice:
        """sizes: hits of each sequence; gaps: lengths of the runs before each hit and after the last, one more than
        hits; weights: of the toxic state at each hit.  gaps and weights are flat, sequence by sequence."""
        n, hits = len(sizes), len(weights)
        first_hit = np.cumsum(sizes) - sizes
        first_gap = first_hit + np.arange(n)
        order = np.argsort(-sizes, kind="stable")
        longest = int(sizes.max(initial=0))
        active = np.searchsorted(-sizes[order], -np.arange(longest), side="left")  # sequences with a hit number j
        most = np.maximum(weights, 0)
        emit = np.exp(np.stack([-most, weights - most], 1))
        gaps = gaps.astype(float)

        left = np.zeros((n, 2))
        left[:, 0] = 1
        logz = np.zeros(n)
        run_left, run_right = np.empty((hits + n, 2)), np.empty((hits + n, 2))
        before, after = np.empty((hits, 2)), np.empty((hits, 2))
        for j in range(longest):
            s = order[: active[j]]
            hit, gap = first_hit[s] + j, first_gap[s] + j
            run_left[gap] = left[s]
            before[hit] = self.over(left[s], gaps[gap])
            new = (before[hit] @ self.step) * emit[hit]
            scale = new.sum(1)
            left[s] = new / scale[:, None]
            logz[s] += gaps[gap] * math.log(self.top) + most[hit] + np.log(scale)
        last = first_gap + sizes
        run_left[last] = left
        logz += gaps[last] * math.log(self.top) + np.log(self.over(left, gaps[last]).sum(1))

        run_right[last] = 1.0
        right = self.back(run_right[last], gaps[last])
        right /= right.sum(1, keepdims=True)
        for j in range(longest - 1, -1, -1):
            s = order[: active[j]]
            hit, gap = first_hit[s] + j, first_gap[s] + j
            after[hit] = right[s]
            new = (emit[hit] * right[s]) @ self.step.T
            run_right[gap] = new / new.sum(1, keepdims=True)
            new = self.back(run_right[gap], gaps[gap])
            right[s] = new / new.sum(1, keepdims=True)
        pairs = before[:, :, None] * self.step * (emit * after)[:, None, :]
        pairs /= pairs.sum((1, 2), keepdims=True)
        return Lattice(logz, pairs, run_left, run_right)

    def run_pairs(self, left: np.ndarray, right: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Expected transitions inside runs of n background tokens, by state and next state."""
        n = n.astype(float)
        powers = self.ratio**n
        some = (1 - powers) / (1 - self.ratio)  # the sum of ratio ** k over k < n
        both = np.where(n > 0, n * self.ratio ** np.maximum(n - 1, 0), 0.0)
        l1, l2 = left @ self.main, left @ self.side
        r1, r2 = right @ self.main.T, right @ self.side.T
        outer = lambda x, y: x[:, :, None] * y[:, None, :]
        wide = lambda x: x[:, None, None]
        total = wide(n) * outer(l1, r1) + wide(some) * (outer(l1, r2) + outer(l2, r1)) + wide(both) * outer(l2, r2)
        norm = (self.over(left, n) * right).sum(1)
        return np.maximum(total * self.run / self.top, 0) / wide(norm)


def log_odds(logz: np.ndarray) -> np.ndarray:
    """Log odds that some token is toxic, from the log of all paths' weight over that of the all-clean path."""
    more = np.maximum(logz, 0)
    return np.where(more < 30, np.log(np.maximum(np.expm1(np.minimum(more, 30)), 1e-15)), more)


class Tagger:
    """Runs a model over texts."""

    def __init__(self, model: Model):
        self.m, self.seen = model, {}
        self.chain = Chain(model.bias, model.trans)

    def weight(self, word: str) -> float | None:
        """Weight of the toxic state at a word, or None for background."""
        known = self.m.weights
        found = [known[f] for f in features(word.lower()) if f in known]
        return self.m.bias + sum(found) if found else None

    def hits(self, text: str) -> tuple[list[int], list[float], int]:
        """Numbers and weights of the tokens that aren't background, and the number of tokens."""
        seen = self.seen
        if len(seen) > _CACHE:
            seen.clear()
        words = _WORD.findall(text)
        for w in set(words).difference(seen):
            seen[w] = self.weight(w)
        at = [i for i, e in enumerate(map(seen.__getitem__, words)) if e is not None]
        return at, [seen[words[i]] for i in at], len(words)

    def run(self, found: list[tuple[list[int], list[float], int]]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
        """Of texts as hits() gives them: log odds that some token is toxic, the expected number of toxic hits, and the
        toxic marginal of each hit."""
        sizes = np.array([len(at) for at, _, _ in found], np.int64)
        gaps = np.concatenate([np.zeros(0), *(np.diff([-1, *at, n]) - 1 for at, _, n in found)])
        weights = np.array([w for _, ws, _ in found for w in ws], float)
        lattice = self.chain.forward_backward(sizes, gaps, weights)
        toxic = lattice.pairs[:, :, 1].sum(1)
        ends = np.cumsum(sizes)
        marginals = [toxic[a:b] for a, b in zip(ends - sizes, ends, strict=True)]
        return log_odds(lattice.logz), np.array([m.sum() for m in marginals]), marginals

    def scores(self, found: list[tuple[list[int], list[float], int]]) -> tuple[np.ndarray, list[np.ndarray]]:
        """Document scores, and the toxic marginal of each hit."""
        odds, expected, marginals = self.run(found)
        bias, by_odds, by_number = self.m.calibration
        z = bias + by_odds * odds + by_number * np.log1p(expected)
        return 1 / (1 + np.exp(-np.clip(z, -500, 500))), marginals

    def score(self, text: str) -> float:
        return float(self.scores([self.hits(text)])[0][0])

    def places(self, text: str, at: list[int], marginals: np.ndarray, at_least: float = 0.5) -> list[tuple[int, int, float]]:
        """(start, end, marginal) in code points of the text itself, of the hits whose marginal reaches at_least."""
        wanted = {i: float(p) for i, p in zip(at, marginals, strict=True) if p >= at_least}
        if not wanted:
            return []
        return [(*m.span(), wanted[i]) for i, m in enumerate(_WORD.finditer(text)) if i in wanted]

    def spans(self, text: str, at_least: float = 0.5) -> list[tuple[int, int, float]]:
        found = self.hits(text)
        return self.places(text, found[0], self.scores([found])[1][0], at_least)


# Training


@dataclass
class Sequences:
    """A batch of stored training sequences as flat arrays."""

    times: np.ndarray  # how often each occurs
    toxic: np.ndarray
    sizes: np.ndarray  # hits of each
    gaps: np.ndarray
    owner: np.ndarray  # hit of each feature
    feature: np.ndarray

    @classmethod
    def of(cls, batch: pa.RecordBatch) -> Sequences:
        times, toxic, gaps, hits = batch.columns
        inner = hits.flatten()
        per_hit = np.diff(inner.offsets.to_numpy()) if len(inner) else np.zeros(0, np.int64)
        return cls(
            times.to_numpy(zero_copy_only=False).astype(float),
            toxic.to_numpy(zero_copy_only=False),
            np.diff(hits.offsets.to_numpy()).astype(np.int64),
            gaps.flatten().to_numpy(),
            np.repeat(np.arange(len(inner)), per_hit),
            inner.flatten().to_numpy(),
        )

    def weights(self, model_weights: np.ndarray, bias: float) -> np.ndarray:
        return bias + np.bincount(self.owner, model_weights[self.feature], int(self.sizes.sum()))


def likelihood_sums(batch: Sequences, theta: np.ndarray, k: int) -> np.ndarray:
    """[log likelihood, sequences, *gradient] of a batch; theta: k feature weights, the bias and the three transitions."""
    bias, trans = theta[k], theta[k + 1 :]
    chain = Chain(bias, tuple(trans))
    weights = batch.weights(theta[:k], bias)
    lattice = chain.forward_backward(batch.sizes, batch.gaps, weights)
    n = len(batch.sizes)
    of_hit, of_gap = np.repeat(np.arange(n), batch.sizes), np.repeat(np.arange(n), batch.sizes + 1)
    label = (batch.toxic == 1).astype(float)[of_hit]  # a token with a feature in a toxic row is toxic

    # Transitions of the labelled path: into and out of each hit, by the length of the run there.
    first = np.zeros(len(batch.gaps), bool)
    first[np.cumsum(batch.sizes + 1) - (batch.sizes + 1)] = True
    last = np.zeros(len(batch.gaps), bool)
    last[np.cumsum(batch.sizes + 1) - 1] = True
    toxic_row = (batch.toxic == 1)[of_gap]
    some = batch.gaps > 0
    enters = toxic_row & ~last & (first | some)
    leaves = toxic_row & ~first & some
    stays = toxic_row & ~last & ~first & ~some
    path = np.stack([enters, leaves, stays], 1).astype(float)

    pairs = chain.run_pairs(lattice.run_left, lattice.run_right, batch.gaps)
    moves = lambda x: np.stack([x[:, 0, 1], x[:, 1, 0], x[:, 1, 1]], 1)
    t_hit, t_gap = batch.times[of_hit], batch.times[of_gap]
    surprise = label - lattice.pairs[:, :, 1].sum(1)
    by_feature = np.bincount(batch.feature, (t_hit * surprise)[batch.owner], k)
    by_bias = t_hit @ surprise - t_gap @ pairs[:, :, 1].sum(1)
    by_move = t_gap @ (path - moves(pairs)) - t_hit @ moves(lattice.pairs)
    value = t_hit @ (label * weights) + t_gap @ (path @ trans) - batch.times @ lattice.logz
    return np.concatenate([[value, batch.times.sum()], by_feature, [by_bias], by_move])


def maximise(evaluate: Callable[[np.ndarray], tuple[float, np.ndarray]], start: np.ndarray, steps: int, memory: int = 8, small: float = 1e-3) -> np.ndarray:
    """Limited-memory quasi-Newton ascent; evaluate gives value and gradient at a point."""
    x, (value, grad) = start, evaluate(start)
    past: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(steps):
        if np.abs(grad).max() < small:
            break
        way, coefficients = grad.copy(), []
        for s, y in reversed(past):
            a = (s @ way) / (s @ y)
            coefficients.append(a)
            way -= a * y
        way *= (past[-1][0] @ past[-1][1]) / (past[-1][1] @ past[-1][1]) if past else 1 / max(1.0, np.abs(grad).max())
        for (s, y), a in zip(past, reversed(coefficients), strict=True):
            way += s * (a - (y @ way) / (s @ y))
        # y below is the fall of the gradient, so that s @ y > 0 where the value is concave.
        length = 1.0
        while length > 1e-6:
            there = x + length * way
            value2, grad2 = evaluate(there)
            if value2 >= value + 1e-4 * length * (grad @ way):
                break
            length /= 4
        else:
            break
        s, y = there - x, grad - grad2
        if s @ y > 1e-12:
            past = [*past, (s, y)][-memory:]
        x, value, grad = there, value2, grad2
    return x


def _logistic(x: np.ndarray, y: np.ndarray, times: np.ndarray) -> np.ndarray:
    """Ridge logistic regression by Newton steps; rows count as often as times says."""
    x = np.hstack([np.ones((len(x), 1)), x])
    w = np.zeros(x.shape[1])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (times * (p * (1 - p) + 1e-9))[:, None]).T @ x + 1e-2 * np.eye(len(w))
        d = np.linalg.solve(h, x.T @ (times * (y - p)) - 1e-2 * w)
        w += d
        if abs(d).max() < 1e-8:
            break
    return w


def _words_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        words = [sorted({w.lower() for w in _WORD.findall(t or "")}) for t in b.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(words, pa.list_(pa.string()))], ["toxic", "words"])


def _features_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names, kinds = ["feature", "toxic", "clean"], (pa.string(), pa.int64(), pa.int64())
    for b in batches:
        words, toxic, clean = (x.to_pylist() for x in b.columns)
        rows = [(f, t, c) for w, t, c in zip(words, toxic, clean, strict=True) for f in features(w)]
        columns = zip(*rows, strict=True) if rows else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(columns, kinds, strict=True)], names)


def _sample(docs: DataFrame, labels: DataFrame, most: int, id_col: str, text_col: str) -> DataFrame:
    """(toxic, text): one row for each id of the sample that docs hold."""
    usable = F.col("toxic").isNotNull() & F.col(id_col).isNotNull() & ~held_out(F.col(id_col))
    ids = labels.where(usable).groupBy(F.col(id_col).alias("__id")).agg(F.max("toxic").cast("int").alias("toxic"))
    ids = ids.orderBy(F.xxhash64("__id"), "__id").limit(most)
    texts = docs.select(F.col(id_col).alias("__id"), F.col(text_col).cast("string").alias("text"))
    rows = texts.join(F.broadcast(ids), "__id").groupBy("__id", "toxic").agg(F.max("text").alias("text"))
    return durable(rows.select("toxic", "text"), "toxic-train")


def _indicative(train: DataFrame, n_toxic: int, n_clean: int, s: Settings) -> list[str]:
    """Features that tell toxic rows: frequent, far above their odds in clean rows, and above chance."""
    words = train.mapInArrow(_words_of, "toxic int, words array<string>").select("toxic", F.explode("words").alias("word"))
    is_toxic = F.col("toxic") == 1
    counts = words.groupBy("word").agg(F.count_if(is_toxic).alias("t"), F.count_if(~is_toxic).alias("c"))
    named = counts.mapInArrow(_features_of, "feature string, toxic long, clean long")
    named = named.groupBy("feature").agg(F.sum("toxic").alias("t"), F.sum("clean").alias("c"))
    odds = F.log((F.col("t") + 0.5) / (n_toxic + 1.0)) - F.log((F.col("c") + 0.5) / (n_clean + 1.0))
    share, n = n_toxic / (n_toxic + n_clean), F.col("t") + F.col("c")
    z = (F.col("t") - n * share) / F.sqrt(n * share * (1 - share))  # against toxic rows at their share
    least = max(2, min(s.min_toxic_docs, n_toxic // 8))
    found = named.where((F.col("t") >= least) & (odds >= s.min_log_odds) & (z >= s.min_z))
    return sorted(r["feature"] for r in found.select("feature").collect())


def _sequences(train: DataFrame, index: dict[str, int]) -> DataFrame:
    """(times, toxic, gaps, hits): the training rows as feature numbers of their hits and lengths of the background runs
    around these; equal rows are one row with a number, so rows without a hit shrink to their lengths."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, list[int]] = {}
        for b in batches:
            all_gaps, all_hits = [], []
            for t in b.column(1).to_pylist():
                words = _WORD.findall(t or "")
                for w in set(words).difference(known):
                    known[w] = [index[f] for f in features(w.lower()) if f in index]
                at = [i for i, w in enumerate(words) if known[w]]
                all_hits.append([known[words[i]] for i in at])
                all_gaps.append((np.diff([-1, *at, len(words)]) - 1).tolist())
            columns = [b.column(0), pa.array(all_gaps, pa.list_(pa.int32())), pa.array(all_hits, pa.list_(pa.list_(pa.int32())))]
            yield pa.RecordBatch.from_arrays(columns, ["toxic", "gaps", "hits"])

    rows = train.mapInArrow(run, "toxic int, gaps array<int>, hits array<array<int>>")
    grouped = durable(rows.groupBy("toxic", "gaps", "hits").agg(F.count("*").alias("times")), "toxic-grouped")
    spread = dealt(grouped.select("times", "toxic", "gaps", "hits"), 4_000)
    return durable(spread.sortWithinPartitions("toxic", "gaps", "hits"), "toxic-sequences")


def _train(sequences: DataFrame, k: int, s: Settings) -> np.ndarray:
    """theta that maximises the conditional log likelihood less a ridge."""
    free = np.ones(k + 4)
    free[k + 1 :] = s.transitions

    def evaluate(theta: np.ndarray) -> tuple[float, np.ndarray]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            parts = [likelihood_sums(Sequences.of(b), theta, k) for b in batches if b.num_rows]
            if parts:
                yield pa.RecordBatch.from_arrays([pa.array([np.sum(parts, 0)], pa.list_(pa.float64()))], ["sums"])

        rows = sequences.mapInArrow(run, "sums array<double>").collect()  # one row of k + 6 numbers a task
        sums = np.sum([r["sums"] for r in rows], 0)
        total, grad = sums[1], sums[2:]
        return sums[0] / total - s.ridge * theta @ theta / 2, (grad / total - s.ridge * theta) * free

    start = np.concatenate([np.ones(k), [-6.0], np.zeros(3)])
    return np.round(maximise(evaluate, start, s.steps), 6)


def fit(docs: DataFrame, labels: DataFrame, settings: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Train on labelled rows outside the held-out fold, at most settings.max_train_docs of them by hash of the id.

    labels(id_col, toxic): repeated ids count as toxic if any row is; null ids and null labels are no labels.  Of
    documents with the same id the one with the largest text counts, so a repeated id is one training row.  Null texts
    are empty; very long texts are trained on whole.  Without a toxic and a clean training row, or without an indicative
    feature, the model scores every text alike, near the share of toxic rows.
    """
    train = _sample(docs, labels, settings.max_train_docs, id_col, text_col)
    totals = {r["toxic"]: r["count"] for r in train.groupBy("toxic").count().collect()}
    n1, n0 = totals.get(1, 0), sum(v for k, v in totals.items() if k != 1)
    prior = math.log((n1 + 0.5) / (n0 + 0.5)) if n0 + n1 else -4.0
    names = _indicative(train, n1, n0, settings) if n1 and n0 else []
    if not names:
        return Model(calibration=(prior, 0.0, 0.0))
    k = len(names)
    sequences = _sequences(train, {f: i for i, f in enumerate(names)})
    theta = _train(sequences, k, settings)
    model = Model(dict(zip(names, theta[:k].tolist(), strict=True)), float(theta[k]), tuple(theta[k + 1 :].tolist()))

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chain = Chain(model.bias, model.trans)
        for b in batches:
            x = Sequences.of(b)
            lattice = chain.forward_backward(x.sizes, x.gaps, x.weights(theta[:k], model.bias))
            owner = np.repeat(np.arange(len(x.sizes)), x.sizes)
            expected = np.bincount(owner, lattice.pairs[:, :, 1].sum(1), len(x.sizes))
            columns = [pa.array(lattice.logz, pa.float64()), pa.array(expected, pa.float64()), b.column(1), b.column(0)]
            yield pa.RecordBatch.from_arrays(columns, ["logz", "expected", "toxic", "times"])

    # Four numbers for each distinct sequence of the sample: at most max_train_docs rows, whatever their length.
    rows = sequences.mapInArrow(told, "logz double, expected double, toxic int, times long").collect()
    logz, expected, toxic, times = (np.array(x, float) for x in zip(*rows, strict=True))
    odds = log_odds(logz)
    x = np.stack([odds, np.log1p(expected)], 1)
    model.calibration = tuple(np.round(_logistic(x, (toxic == 1).astype(float), times), 6).tolist())
    return model


def score(docs: DataFrame, model: Model, text_col: str = "text", spans: bool = False, score_col: str = "score") -> DataFrame:
    """docs with score_col (double), and on demand toxic_spans (array of start, end, marginal in code points).

    Null text scores as empty text, very long texts are scored whole.  One pass without a shuffle; input columns of the
    result's names are replaced, all others pass through unchanged, repeated rows are scored alike, an empty table gives
    an empty table.
    """
    kind = ", toxic_spans array<struct<start:int,end:int,p:double>>" if spans else ""
    docs = docs.select(*quoted(rest(docs, score_col, *["toxic_spans"] * spans)))
    schema = extended(docs.schema, f"`{score_col}` double" + kind)
    i = docs.columns.index(text_col)
    span_type = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("p", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = Tagger(model)
        for b in batches:
            texts = [t or "" for t in b.column(i).to_pylist()]
            found = [tagger.hits(t) for t in texts]
            scores, marginals = tagger.scores(found)
            new = [pa.array(scores, pa.float64())]
            if spans:
                places = [tagger.places(t, f[0], m) for t, f, m in zip(texts, found, marginals, strict=True)]
                new.append(pa.array([[{"start": x, "end": y, "p": p} for x, y, p in some] for some in places], span_type))
            yield pa.RecordBatch.from_arrays([*b.columns, *new], schema.names)

    return map_arrow(docs, run, schema)
