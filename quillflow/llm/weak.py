"""Weak supervision: a generative label model over voters, and a linear classifier on soft labels.

A vote is 0 (abstain), 1 (says no) or 2 (says yes). The label model is a latent class model: each class
is a mixture of kinds (say, one kind of fault, or one language's insults), a row belongs to one kind,
and each voter votes with its own rates in each kind. Kinds are what makes voters of one class
correlate: voters that repeat one another, or that never meet, share or split a kind, so they aren't
counted as independent evidence. `fit` estimates all rates by expectation-maximisation over distinct
vote rows with weights, so its cost follows the number of distinct rows, not of documents. Rows whose
class is known keep it (semi-supervised); the others follow the votes.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

ABSTAIN, NO, YES = 0, 1, 2
ROUNDS = 80
#: Rows that a voter's rates in its whole class count as, beside the rows of a kind.
SMOOTH = 1.0
#: Kinds of the class for which voters speak, at most.
KINDS = 8


@dataclass
class LabelModel:
    """prior of each kind; which kinds are of class yes; rates[kind, voter, vote]."""

    prior: np.ndarray
    yes: np.ndarray
    rates: np.ndarray

    def _kinds(self, votes: np.ndarray) -> np.ndarray:
        """log P(kind, votes), rows x kinds."""
        votes = np.asarray(votes, np.int64)
        kinds, voters = self.rates.shape[:2]
        table = np.log(self.rates).transpose(1, 2, 0).reshape(3 * voters, kinds)
        out = np.repeat(np.log(self.prior)[None], len(votes), axis=0)
        for j in range(voters):
            out += table[3 * j + votes[:, j]]
        return out

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        """The probability of yes for each row of votes."""
        p = np.exp((log := self._kinds(votes)) - log.max(axis=1, keepdims=True, initial=-np.inf))
        return p[:, self.yes].sum(axis=1) / p.sum(axis=1)

    def class_rates(self, yes: bool) -> np.ndarray:
        """rates[voter, vote] in a class, averaged over its kinds."""
        of = self.yes == yes
        return np.tensordot(self.prior[of] / self.prior[of].sum(), self.rates[of], 1)

    def accuracies(self) -> np.ndarray:
        """For each voter, how often it is right when it votes."""
        share = self.prior[self.yes].sum()
        on, off = self.class_rates(True), self.class_rates(False)
        right = share * on[:, YES] + (1 - share) * off[:, NO]
        said = share * on[:, 1:].sum(axis=1) + (1 - share) * off[:, 1:].sum(axis=1)
        return right / np.maximum(said, 1e-12)

    def correlations(self, yes: bool) -> np.ndarray:
        """voters x voters: correlation of saying yes (class yes) or no (class no) within the class."""
        of, said = self.yes == yes, YES if yes else NO
        weight = self.prior[of] / self.prior[of].sum()
        p = self.rates[of][:, :, said]
        mean = weight @ p
        both = p.T @ (weight[:, None] * p)
        spread = np.sqrt(mean * (1 - mean))
        out = (both - mean[:, None] * mean[None]) / np.maximum(spread[:, None] * spread[None], 1e-12)
        np.fill_diagonal(out, 1.0)
        return out


def seeds(votes: np.ndarray, weight: np.ndarray, said: int, kinds: int) -> list[int]:
    """Voters that start kinds: each says `said` on the most rows (by weight) that the ones before leave."""
    hit, left, out = votes == said, np.asarray(weight, float).copy(), []
    for _ in range(kinds - 1):
        cover = left @ hit
        best = int(np.argmax(cover)) if len(cover) else 0
        if not len(cover) or cover[best] <= 0:
            break
        out.append(best)
        left = np.where(hit[:, best], 0.0, left)
    return out


def fit(votes: np.ndarray, weight: np.ndarray, start: np.ndarray, known: np.ndarray | None = None, said: int = YES, kinds: int = KINDS) -> LabelModel:
    """The model of vote rows (n x voters) with their weights.

    start: each row's first guess of P(yes). known: -1, or the row's class, which it keeps. The class for
    which voters speak (`said`) has up to `kinds` kinds, one for each of the voters that `seeds` names
    and one for the rest; the other class has one.
    """
    votes, weight = np.asarray(votes, np.int64), np.asarray(weight, float)
    known = np.full(len(votes), -1) if known is None else np.asarray(known)
    q = np.where(known >= 0, known, np.asarray(start, float))
    spoken = q if said == YES else 1 - q
    lead = seeds(votes, weight * spoken, said, kinds)
    kind = np.full(len(votes), len(lead))
    for k in reversed(range(len(lead))):
        kind[votes[:, lead[k]] == said] = k
    many = len(lead) + 1
    yes = np.concatenate((np.full(many, said == YES), [said != YES]))
    r = np.zeros((len(votes), many + 1))
    r[np.arange(len(votes)), kind] = spoken
    r[:, -1] = 1 - spoken
    allowed = np.where(known[:, None] < 0, True, yes[None] == (known[:, None] == 1))
    model = None
    hot = [(votes == v).astype(float) for v in (ABSTAIN, NO, YES)]
    for _ in range(ROUNDS):
        mass = r * weight[:, None]
        size = mass.sum(axis=0)
        count = np.stack([mass.T @ h for h in hot], axis=2)
        rates = np.empty_like(count)
        for side in (True, False):
            of = yes == side
            whole = count[of].sum(axis=0) + 1 / 3
            whole /= whole.sum(axis=1, keepdims=True)
            rates[of] = (count[of] + SMOOTH * whole[None]) / (size[of][:, None, None] + SMOOTH)
        prior = (size + 0.1) / (size + 0.1).sum()
        model = LabelModel(prior, yes, rates)
        log = np.where(allowed, model._kinds(votes), -np.inf)
        r = np.exp(log - log.max(axis=1, keepdims=True, initial=-np.inf)) if len(log) else r
        r /= np.maximum(r.sum(axis=1, keepdims=True), 1e-300)
    return model


@dataclass
class Entries:
    """A sparse matrix of n x width by its entries."""

    n: int
    width: int
    rows: np.ndarray
    columns: np.ndarray
    values: np.ndarray

    def __matmul__(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.rows, weights=self.values * w[self.columns], minlength=self.n)

    def back(self, v: np.ndarray) -> np.ndarray:
        """The transpose times v."""
        return np.bincount(self.columns, weights=self.values * v[self.rows], minlength=self.width)

    def absolute(self) -> Entries:
        """The same with absolute values."""
        return Entries(self.n, self.width, self.rows, self.columns, np.abs(self.values))


class Dense(np.ndarray):
    """A dense matrix with the same two products."""

    def back(self, v: np.ndarray) -> np.ndarray:
        """The transpose times v."""
        return np.asarray(self).T @ v

    def absolute(self) -> Dense:
        """The same with absolute values."""
        return np.abs(self).view(Dense)


def logistic(x: Entries | Dense, y: np.ndarray, weight: np.ndarray, penalty: float = 1e-4, rounds: int = 300) -> np.ndarray:
    """Weights (last: bias) of a logistic regression on soft labels y, by accelerated gradient steps.

    A feature's step is the inverse of its bound on the curvature: a quarter of its values times their
    rows' sums.
    """
    n, width = len(y), x.width if isinstance(x, Entries) else x.shape[1]
    kind = float if isinstance(x, Entries) else x.dtype
    weight = (weight / max(weight.sum(), 1e-12)).astype(kind)
    y = y.astype(kind)
    size = x.absolute()
    reach = weight * (np.asarray(size @ np.ones(width, kind)) + 1)
    step = 1 / (np.append(size.back(reach), reach.sum()) / 4 + penalty)
    share = float(np.clip(weight @ y, 1e-4, 1 - 1e-4)) if n else 0.5
    w = np.append(np.zeros(width), np.log(share / (1 - share))).astype(kind)
    ahead = w.copy()
    for k in range(rounds):
        logit = ahead[-1] + np.asarray(x @ ahead[:-1])
        slope = weight * (1 / (1 + np.exp(-np.clip(logit, -30, 30))) - y)
        gradient = np.append(x.back(slope) + penalty * ahead[:-1], slope.sum())
        new = (ahead - step * gradient).astype(kind)
        ahead = (new + k / (k + 3) * (new - w)).astype(kind)
        w = new
    return np.asarray(w, float)
