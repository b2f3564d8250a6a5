"""Operator 8, mixing to target weights with soft domain membership.

A classifier over hashed words, trained on a bounded sample of labelled rows,
gives every document a posterior over the domains.  Documents get nonnegative
rates such that the expected tokens of each domain (rate x tokens x posterior,
summed) come as close to the targets as least squares allows.  The fit is
projected descent in the metric of the tokens: a step moves a document's rate
along its posterior, and rates outside the floor and the ceiling are set to
them.  A step is the one that, rates set to their limits and all, comes nearest
to the targets at a small price for moving (a proximal step, where plain projected
gradient takes the residual over the greatest curvature: with a rare domain that needs
thousands of passes over all documents); as many numbers
as there are domains name it, and a damped Newton iteration with halved steps
finds them, with the Gram matrix of the documents that are free to move; one pass looks at all halvings.  The
price falls from step to step.  A step after which the squared distance from the
targets is not smaller is dropped, and a plain gradient step, halved likewise,
is taken instead.  The fit ends when the targets are met, the projected gradient
vanishes or a step at the least price gains nothing, which says the same.  Where a domain is nearly absent, the floor of all others
and the ceiling decide how near its target comes; without a ceiling its few
documents are repeated as often as the target asks for.  A rate depends only on
the document's posterior and the few steps so far, so nothing is kept per
document between rounds: each is one aggregate over the written posteriors, with
the steps as constants, and only a few numbers per pair of domains come back.

Documents without words have no tokens and keep the starting rate; null texts
are empty.  A domain without tokens is left out of the fit, its target with it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from messlab.llm.linear import Model, fit, labelled, sigmoid
from messlab.llm.storage import free, stored

GRAMS = ("word", "pair")
#: Labelled documents that training sees at most; steps after which a fit fails; distance from the targets that ends it.
SAMPLE, ROUNDS, TOLERANCE = 9_000, 200, 1e-6
#: Length of the projected gradient, as a share of the one without limits, that counts as none.
VANISHED = 1e-4
#: Price of moving, as a share of the Gram matrix's mean diagonal: of the first step, and of all later ones.
#: Halvings of a step, looked at together.
DAMPING, LEAST_DAMPING = 1e-3, 1e-7
HALVINGS = 12
#: Domains of the labels table, and the weights that the mixture aims at.
DOMAINS = ("clean", "poor", "toxic")
WEIGHTS = (0.85, 0.10, 0.05)


def domain(quality: str = "quality", toxic: str = "toxic") -> Column:
    """Number of the domain of a labels row: toxic before poor; null if a label is missing."""
    return F.when(F.col(toxic) == 1, 2).when(F.col(toxic).isNotNull() & (F.col(quality) == 0), 1).when(
        F.col(toxic).isNotNull() & F.col(quality).isNotNull(), 0)


def train(docs: DataFrame, labels: DataFrame, truth: Column, classes: int, id: str = "doc_id", text: str = "text",
          sample: int = SAMPLE) -> Model:
    """One-against-rest weights of the domains."""
    return fit(labelled(docs, labels, truth, F.lit(True), id, text, sample), GRAMS, classes)[0]


def posterior(model: Model):
    """A column function: text to (tokens, posterior)."""
    @F.pandas_udf("tokens long, posterior array<double>")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            texts = texts.tolist()
            odds = sigmoid(model.margins(texts)) + 1e-9
            yield pd.DataFrame({"tokens": [len((t or "").split()) for t in texts],
                                "posterior": list(odds / odds.sum(1, keepdims=True))})
    return predict.asNondeterministic()


def rate_of(own: Column, steps: list[np.ndarray], floor: float, ceiling: float = float("inf")) -> Column:
    """A document's rate after the steps: 1, moved and projected once per step."""
    if not steps:
        return F.lit(1.0)
    moves = F.array(*[F.array(*map(F.lit, map(float, s))) for s in steps])
    return F.aggregate(moves, F.lit(1.0), lambda r, s: F.least(F.lit(float(ceiling)), F.greatest(
        F.lit(float(floor)), r - F.aggregate(F.zip_with(own, s, lambda p, g: p * g), F.lit(0.0), lambda a, b: a + b))))


class Fit:
    """Aggregates over documents(tokens, posterior), and the steps found so far."""

    def __init__(self, documents: DataFrame, size: int, floor: float, ceiling: float):
        self.documents, self.size, self.floor, self.ceiling = documents.select("tokens", "posterior"), size, floor, ceiling
        self.steps: list[np.ndarray] = []
        self.passes = 0

    def natural(self) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of each domain, and their Gram matrix, at the starting rate."""
        return self.total(added([], [np.zeros(self.size)], float("-inf"), float("inf")), 1)[0][:2]

    def after(self, candidates: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray, float, float]]:
        """For each candidate for one more step, all in one pass: tokens of each domain, Gram matrix of the documents
        within their limits, half the squared move plus its price times the rate, and the squared move; all weighed
        by tokens."""
        return self.total(added(self.steps, candidates, self.floor, self.ceiling), len(candidates))

    def total(self, partial, candidates: int) -> list[tuple[np.ndarray, np.ndarray, float, float]]:
        self.passes += 1
        names = [f"v{k}" for k in range(self.size + self.size ** 2 + 2)]
        parts = self.documents.mapInArrow(partial, "c int, " + ", ".join(f"{n} double" for n in names))
        found = np.zeros((candidates, len(names)))
        for r in parts.groupBy("c").agg(*[F.sum(n).alias(n) for n in names]).collect():
            found[r["c"]] = r[1:]
        return [(v[:self.size], v[self.size:-2].reshape(self.size, self.size), v[-2], v[-1]) for v in found]


def added(steps: list[np.ndarray], candidates: list[np.ndarray], floor: float, ceiling: float):
    """For mapInArrow over (tokens, posterior): a row of the sums of :meth:`Fit.after` for each candidate c."""
    steps, candidates = list(steps), list(candidates)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = len(candidates[0])
        out = np.zeros((len(candidates), size + size * size + 2))
        for batch in batches:
            tokens = batch.column("tokens").to_numpy().astype(float)
            p = batch.column("posterior").flatten().to_numpy().reshape(-1, size)
            before = np.ones(len(tokens))
            for s in steps:
                before = np.clip(before - p @ s, floor, ceiling)
            for c, step in enumerate(candidates):
                along = p @ step
                wanted = before - along
                rate = np.clip(wanted, floor, ceiling)
                weighed = p * (tokens * ((wanted >= floor) & (wanted <= ceiling)))[:, None]
                move = (rate - before) ** 2
                out[c] += np.concatenate([(rate * tokens) @ p, (weighed.T @ p).reshape(-1),
                                          [tokens @ (move / 2 + along * rate), tokens @ move]])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(out), dtype=np.int32)), *map(pa.array, out.T)],
                                         ["c", *[f"v{k}" for k in range(out.shape[1])]])
    return run


def proximal(fit_: Fit, targets: np.ndarray, present: np.ndarray, price: float, enough: float,
             start: tuple, tried: np.ndarray, found: tuple) -> tuple[np.ndarray, np.ndarray]:
    """(step, tokens reached): the step at which price x step is what remains from the targets.

    It is where a concave function is greatest, whose slope is the rest of that equation.  Newton's direction is
    halved until the function rises enough; all halvings are looked at in one pass.  ``tried`` and ``found`` are the
    step that is right if the limits leave all as it is, and its sums.  Where no halving rises, the best step so far is returned.
    """
    def slope(reached, step):
        return np.where(present, reached - targets - price * step, 0.0)

    def height(state, step):
        return state[2] - step @ targets - price / 2 * (step @ step)

    step, state = np.zeros(len(targets)), start
    if height(found, tried) > height(start, step):
        step, state = tried, found
    while np.abs(rest := slope(state[0], step)).max() > enough:
        direction = np.linalg.solve(state[1] + price * np.eye(len(step)), rest)
        parts = [0.5 ** k for k in range(HALVINGS)]
        for part, found in zip(parts, fit_.after([step + part * direction for part in parts])):
            tried = step + part * direction
            gain = height(found, tried) - height(state, step)
            if gain > 0 and gain >= 1e-4 * part * (rest @ direction) or np.abs(slope(found[0], tried)).max() <= enough:
                step, state = tried, found
                break
        else:
            break
    return step, state[0]


def fit_rates(documents: DataFrame, weights: tuple[float, ...], total: float | None = None, floor: float = 0.0,
              ceiling: float = float("inf"), rounds: int = ROUNDS, tolerance: float = TOLERANCE) -> tuple[list[np.ndarray], np.ndarray]:
    """(steps, targets) for documents(tokens, posterior); ``total`` tokens are wanted.

    By default the total is such that the domain most in excess of its weight keeps its tokens.  A fit that has not
    ended after ``rounds`` steps raises an error that says how far it came.
    """
    size = len(weights)
    fit_ = Fit(documents, size, floor, ceiling)
    natural, gram = fit_.natural()
    present = natural > 0
    share = np.where(present, np.array(weights, float), 0.0)
    share = share / share.sum() if share.sum() else share
    if total is None:
        total = max((n / s for n, s in zip(natural, share) if s > 0), default=0.0)
    targets = share * total
    scale, longest = max(1.0, targets.sum()), np.linalg.norm(gram, 2)
    damping, reached = DAMPING, None
    while longest:
        if reached is None:  # of rates within the limits, an empty step moves none
            reached = fit_.after([np.zeros(size)])[0][0]
        residual = np.where(present, reached - targets, 0.0)
        if np.abs(residual).max() / scale <= tolerance:  # met
            break
        if len(fit_.steps) == rounds:
            raise RuntimeError(f"no fit after {rounds} steps: tokens {reached.tolist()}, targets {targets.tolist()}")
        price = damping * np.trace(gram) / size
        state, gradient, whole = fit_.after([np.zeros(size), residual / longest, residual / price])
        if gradient[3] <= VANISHED ** 2 * (residual @ gram @ residual) / longest ** 2:  # as near as the limits allow
            break
        enough = max(tolerance * scale / 10, np.abs(residual).max() / 100)
        step, met = proximal(fit_, targets, present, price, enough, state, residual / price, whole)
        here, last = residual @ residual, damping == LEAST_DAMPING
        damping = max(damping / 100, LEAST_DAMPING)
        rest = np.where(present, met - targets, 0.0)
        if rest @ rest >= here:  # a projected gradient step, halved until it comes nearer
            shorter = [0.5 ** k * residual / longest for k in range(HALVINGS)]
            for step, (met, *_) in zip(shorter, fit_.after(shorter)):
                rest = np.where(present, met - targets, 0.0)
                if rest @ rest < here:
                    break
            else:
                break
        fit_.steps.append(step)
        reached = met
        if last and here - rest @ rest <= tolerance * here:  # a nearly free move gains nothing
            break
    return fit_.steps, targets


def mixed(docs: DataFrame, labels: DataFrame, weights: tuple[float, ...] = WEIGHTS, total: float | None = None,
          floor: float = 0.0, id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: id, tokens, posterior of each domain, rate."""
    model = train(docs, labels, domain(), len(DOMAINS), id, text)
    found = stored(docs.select(F.col(id).alias("id"), posterior(model)(F.col(text)).alias("p")).select("id", "p.*"),
                   "posteriors")
    steps, _ = fit_rates(found, weights, total, floor)
    return found.select(F.col("id").alias(id), "tokens",
                        *[F.col("posterior")[k].alias(f"p_{d}") for k, d in enumerate(DOMAINS)],
                        rate_of(F.col("posterior"), steps, floor).alias("rate"))


def resample(docs: DataFrame, labels: DataFrame, weights: tuple[float, ...] = WEIGHTS, floor: float = 1.0,
             ceiling: float = 4.0, id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents, all columns, each as often as its rate says.

    The part of a rate past the last whole number is the chance of one more
    row, drawn by a hash of id and text.  With the default floor no document
    goes; sources short of their weight are repeated, up to the ceiling.
    """
    model = train(docs, labels, domain(), len(DOMAINS), id, text)
    own, again = free(docs, "_p"), free(docs, "_again")
    found = stored(docs.withColumn(own, posterior(model)(F.col(text))), "posteriors")
    steps, _ = fit_rates(found.select(f"{own}.*"), weights, None, floor, ceiling)
    draw = F.pmod(F.xxhash64(F.lit(37), F.col(id), F.col(text)), F.lit(1 << 30)) / float(1 << 30)
    rate = rate_of(F.col(f"{own}.posterior"), steps, floor, ceiling)
    return found.withColumn(again, F.explode(F.array_repeat(F.lit(1), F.floor(rate + draw).cast("int")))).drop(own, again)
