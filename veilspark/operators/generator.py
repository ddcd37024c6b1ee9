"""A generator of coded rows: latent points, a linear map to each attribute's logits, and mixtures of what they say.

Every latent point gives independent categorical distributions, one an attribute; the answer to a
table of any degree is the mean over the points of the outer products. Maps are fitted to measured tables by Adam.
Its size is set by the configuration and the public domains, not by rows.
"""

from __future__ import annotations

import math
from collections.abc import Mapping
from dataclasses import dataclass

import numpy as np

#: Names that options may also be given by.
OPTIONS = {"T": "rounds", "embedding_dim": "latent", "batch_size": "components", "lr": "rate", "max_iters": "inner"}


@dataclass(frozen=True)
class GeneratorConfig:
    """``rounds`` of choice and measurement with the budget share ``alpha`` of choice; ``components`` latent points of ``latent`` numbers;
    learning ``rate``, falling by a cosine over the rounds to ``eta_min`` if that is given; ``inner`` steps a round, each on
    at most ``max_idxs`` measured cells (None: all); ``resample`` draws the latent points anew at every step
    and for every row; tables of ``degree`` attributes, or those of each feature with the target (``target_star``)."""

    rounds: int = 10
    alpha: float = 0.5
    components: int = 128
    latent: int = 128
    rate: float = 0.05
    eta_min: float | None = None
    inner: int = 100
    max_idxs: int | None = None
    resample: bool = False
    degree: int = 2
    target_star: bool = False

    def __post_init__(self):
        if self.rounds < 1 or self.inner < 0 or self.components < 1 or self.latent < 1 or self.degree < 1:
            raise ValueError("rounds, components, latent and degree are at least 1, inner steps at least 0")
        if not 0 < self.alpha < 1:
            raise ValueError(f"alpha must lie inside (0, 1), not {self.alpha}")
        if self.max_idxs is not None and self.max_idxs < 1:
            raise ValueError("a step needs a cell")

    @classmethod
    def of(cls, **options) -> GeneratorConfig:
        """A configuration from options by either name; unknown ones are an error."""
        named = {OPTIONS.get(k, k): v for k, v in options.items()}
        if unknown := sorted(set(named) - set(cls.__dataclass_fields__)):
            raise ValueError(f"unknown generator options {unknown}")
        if len(named) < len(options):
            raise ValueError("an option is given twice")
        return cls(**named)

    def rate_of(self, round_: int, rounds: int) -> float:
        """The learning rate of a round."""
        if self.eta_min is None:
            return self.rate
        return self.eta_min + (self.rate - self.eta_min) * (1 + math.cos(math.pi * round_ / max(1, rounds))) / 2


class Mixture:
    def __init__(self, attributes: Mapping[str, int], config: GeneratorConfig, seed: int):
        self.attributes, self.config = dict(attributes), config
        self.rng = np.random.default_rng(seed)
        self.z = self._latent(config.components, self.rng)
        self.maps = {a: self.rng.normal(scale=0.5 / math.sqrt(config.latent), size=(config.latent + 1, s)) for a, s in attributes.items()}
        self.means = {a: np.zeros_like(w) for a, w in self.maps.items()}
        self.squares = {a: np.zeros_like(w) for a, w in self.maps.items()}
        self.steps = 0

    def _latent(self, n: int, rng: np.random.Generator) -> np.ndarray:
        z = rng.normal(size=(n, self.config.latent))
        return np.concatenate([z, np.ones((n, 1))], axis=1)  # the last column is a bias

    def state(self) -> tuple[np.ndarray, dict[str, np.ndarray]]:
        """All that sampling needs."""
        return self.z, self.maps

    @classmethod
    def restored(cls, attributes: Mapping[str, int], config: GeneratorConfig, state) -> Mixture:
        out = cls.__new__(cls)
        out.attributes, out.config, (out.z, out.maps) = dict(attributes), config, state
        return out

    def parts(self, z: np.ndarray | None = None) -> dict[str, np.ndarray]:
        """Each point's distribution of each attribute."""
        out = {}
        for a, w in self.maps.items():
            logits = (self.z if z is None else z) @ w
            e = np.exp(logits - logits.max(axis=1, keepdims=True))
            out[a] = e / e.sum(axis=1, keepdims=True)
        return out

    @staticmethod
    def _product(p: Mapping[str, np.ndarray], set_: tuple[str, ...]) -> np.ndarray:
        """A row a point: the outer product of its distributions of ``set_``, flat."""
        out = np.ones((len(next(iter(p.values()))), 1))
        for a in set_:
            out = (out[:, :, None] * p[a][:, None, :]).reshape(len(out), -1)
        return out

    def answer(self, set_: tuple[str, ...]) -> np.ndarray:
        """The table of an attribute set of any degree, as shares."""
        p = self.parts()
        return (self._product(p, set_[:-1]).T @ p[set_[-1]]).reshape([self.attributes[a] for a in set_]) / len(self.z)

    def fit(self, measured: Mapping[tuple[str, ...], np.ndarray], round_: int = 0, rounds: int = 1) -> None:
        """``inner`` Adam steps towards the measured tables."""
        c = self.config
        rate = c.rate_of(round_, rounds)
        sizes = [m.size for m in measured.values()]
        for _ in range(c.inner):
            if c.resample:
                self.z = self._latent(c.components, self.rng)
            used = None
            if c.max_idxs is not None and sum(sizes) > c.max_idxs:
                used = np.zeros(sum(sizes), bool)
                used[self.rng.choice(sum(sizes), c.max_idxs, replace=False)] = True
            p, begin = self.parts(), 0
            grads = {a: np.zeros_like(v) for a, v in p.items()}
            for (set_, m), size in zip(measured.items(), sizes):
                some = None if used is None else used[begin : begin + size].reshape(m.shape)
                begin += size
                if some is not None and not some.any():
                    continue
                k = len(self.z)
                gap = (self._product(p, set_[:-1]).T @ p[set_[-1]]).reshape(m.shape) / k - m
                if some is not None:
                    gap = gap * some
                for i, a in enumerate(set_):
                    rest = self._product(p, set_[:i] + set_[i + 1 :])
                    grads[a] += rest @ np.moveaxis(gap, i, -1).reshape(-1, m.shape[i]) / k
            self.steps += 1
            for a, g in grads.items():
                g = self.z.T @ (p[a] * (g - (g * p[a]).sum(axis=1, keepdims=True)))
                self.means[a] = 0.9 * self.means[a] + 0.1 * g
                self.squares[a] = 0.99 * self.squares[a] + 0.01 * g * g
                hat = self.means[a] / (1 - 0.9**self.steps)
                self.maps[a] -= rate * hat / (np.sqrt(self.squares[a] / (1 - 0.99**self.steps)) + 1e-9)

    def sample(self, n: int, rng: np.random.Generator) -> np.ndarray:
        """``n`` coded rows: a latent point each (one of those fitted, or a new one if points are drawn anew), and a draw per attribute."""
        if self.config.resample:
            p, at = self.parts(self._latent(n, rng)), np.arange(n)
        else:
            p, at = self.parts(), rng.integers(0, len(self.z), n)
        out = np.empty((n, len(self.attributes)), np.int32)
        for j, (a, s) in enumerate(self.attributes.items()):
            upto = p[a].cumsum(axis=1)
            out[:, j] = np.minimum((rng.random((n, 1)) > upto[at]).sum(axis=1), s - 1)
        return out
