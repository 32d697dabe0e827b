"""Digital recursive filters as associative scans: second-order sections over blocks and chunks of samples.

A cascade of sections is one linear system. A block of samples answers with its
response from rest, and with an affine map of the state before it; the maps of
blocks are composed by doubling, so nothing loops over samples, and a chunk of a
long track can be filtered without the chunks before it.
"""

from __future__ import annotations

import functools

import numpy as np

# The K-weighting of ITU-R BS.1770 as analogue prototypes.
SHELF = {"gain_db": 3.999843853973347, "f0": 1681.974450955533, "q": 0.7071752369554196}
HIGHPASS = {"f0": 38.13547087602444, "q": 0.5003270373238773}
BLOCK = 64


def k_weighting(rate: int) -> np.ndarray:
    """The two sections (b0, b1, b2, 1, a1, a2) of the K-weighting at ``rate``, by the bilinear transform."""
    k, vh = np.tan(np.pi * SHELF["f0"] / rate), 10 ** (SHELF["gain_db"] / 20)
    vb, q = vh**0.4996667741545416, SHELF["q"]
    a0 = 1 + k / q + k * k
    shelf = [(vh + vb * k / q + k * k) / a0, 2 * (k * k - vh) / a0, (vh - vb * k / q + k * k) / a0, 1.0, 2 * (k * k - 1) / a0, (1 - k / q + k * k) / a0]
    k, q = np.tan(np.pi * HIGHPASS["f0"] / rate), HIGHPASS["q"]
    a0 = 1 + k / q + k * k
    return np.array([shelf, [1.0, -2.0, 1.0, 1.0, 2 * (k * k - 1) / a0, (1 - k / q + k * k) / a0]])


def butterworth(order: int, rate: float, low: float | None = None, high: float | None = None) -> np.ndarray:
    """Sections of a digital low-pass (``high``), high-pass (``low``) or band-pass (both) of even order (a band-pass: any)."""
    poles = -np.exp(1j * np.pi * (2 * np.arange(order) + 1 - order) / (2 * order))
    edge = lambda f: 4 * np.tan(np.pi * f / rate)
    if low and high:
        width, centre = edge(high) - edge(low), np.sqrt(edge(low) * edge(high))
        half = poles * width / 2
        root = np.sqrt(half**2 - centre**2)
        poles, zeros, gain = np.concatenate([half + root, half - root]), np.zeros(order), width**order
    elif high:
        poles, zeros, gain = poles * edge(high), np.zeros(0), edge(high) ** order
    else:
        poles, zeros, gain = edge(low) / poles, np.zeros(order), 1.0
    gain = float(np.real(gain * np.prod(4 - zeros) / np.prod(4 - poles)))
    ends = np.concatenate([(4 + zeros) / (4 - zeros), -np.ones(len(poles) - len(zeros))])
    digital = (4 + poles) / (4 - poles)
    upper = digital[np.argsort(-np.abs(digital))]
    upper = upper[np.imag(upper) > 0]
    ends = np.sort(ends)
    sections = []
    for k, p in enumerate(upper):
        a, b = ends[k], ends[len(ends) - 1 - k]
        sections.append([1.0, -(a + b), a * b, 1.0, -2 * p.real, abs(p) ** 2])
    out = np.array(sections)
    out[0, :3] *= gain
    return out


class Cascade:
    """Sections as one system: y = C s + D x, then s' = A s + B x, for states in transposed direct form."""

    def __init__(self, sections: np.ndarray):
        n = 2 * len(sections)
        self.sections, self.order = sections, n

        def step(s: np.ndarray, x: float) -> tuple[float, np.ndarray]:
            new = np.empty(n)
            for k, (b0, b1, b2, _, a1, a2) in enumerate(sections):
                y = b0 * x + s[2 * k]
                new[2 * k], new[2 * k + 1] = b1 * x - a1 * y + s[2 * k + 1], b2 * x - a2 * y
                x = y
            return x, new

        self.D, self.B = step(np.zeros(n), 1.0)
        unit = [step(np.eye(n)[k], 0.0) for k in range(n)]
        self.C, self.A = np.array([u[0] for u in unit]), np.column_stack([u[1] for u in unit])
        powers = [np.eye(n)]
        for _ in range(BLOCK):
            powers.append(self.A @ powers[-1])
        self.seen = np.array([self.C @ p for p in powers[:BLOCK]])
        impulse = np.concatenate([[self.D], self.seen[: BLOCK - 1] @ self.B])
        lag = np.arange(BLOCK)[:, None] - np.arange(BLOCK)[None, :]
        self.own = np.where(lag >= 0, impulse[np.maximum(lag, 0)], 0.0)
        self.left = np.array([powers[BLOCK - 1 - j] @ self.B for j in range(BLOCK)])
        self.powers = powers

    def after(self, n: int) -> np.ndarray:
        """What ``n`` silent samples make of a state."""
        return np.linalg.matrix_power(self.A, n)

    def rest(self) -> np.ndarray:
        """The state that an endless input of ones leads to."""
        return np.linalg.solve(np.eye(self.order) - self.A, self.B)

    def ringing(self, n: int) -> np.ndarray:
        """(n, order): the share of each state in each of the next ``n`` outputs of a silent input."""
        out = np.empty((-(-n // BLOCK), BLOCK, self.order))
        step, now = self.powers[BLOCK], np.eye(self.order)
        for k in range(len(out)):
            out[k] = self.seen @ now
            now = step @ now
        return out.reshape(-1, self.order)[:n]

    def run(self, x: np.ndarray, state: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(y, state after) of ``x`` (channels, samples) from ``state`` (channels, order), or from rest."""
        channels, n = x.shape
        state = np.zeros((channels, self.order)) if state is None else state
        m = n // BLOCK
        blocks = x[:, : m * BLOCK].reshape(channels, m, BLOCK)
        y = blocks @ self.own.T
        before = np.concatenate([state[:, None, :], blocks @ self.left], axis=1)
        power, d = self.powers[BLOCK], 1
        while d <= m:
            before[:, d:] = before[:, d:] + before[:, :-d] @ power.T
            power, d = power @ power, 2 * d
        y = (y + before[:, :m] @ self.seen.T).reshape(channels, m * BLOCK)
        r, s = n - m * BLOCK, before[:, m]
        if not r:
            return y, s
        tail = x[:, m * BLOCK :]
        y = np.concatenate([y, tail @ self.own[:r, :r].T + s @ self.seen[:r].T], axis=1)
        return y, s @ self.powers[r].T + tail @ self.left[BLOCK - r :]

    def both_ways(self, x: np.ndarray) -> np.ndarray:
        """Zero-phase: forward and backward over ends mirrored about their last sample; forward alone where the track is shorter than those."""
        edge = 3 * (self.order + 1)
        if x.shape[1] <= edge:
            return self.run(x)[0]
        x = np.concatenate([2 * x[:, :1] - x[:, edge:0:-1], x, 2 * x[:, -1:] - x[:, -2 : -edge - 2 : -1]], axis=1)
        for _ in range(2):
            x = self.run(x, x[:, :1] * self.rest())[0][:, ::-1]
        return x[:, edge:-edge]


@functools.lru_cache(maxsize=64)
def weighting(rate: int) -> Cascade:
    return Cascade(k_weighting(rate))


@functools.lru_cache(maxsize=64)
def band_pass(rate: int, low: float, high: float) -> Cascade | None:
    """Second order, the edges held between 5 Hz and 0.95 of half the rate; None where nothing is left between them."""
    low, high = max(low, 5.0), min(high, rate / 2 * 0.95)
    return Cascade(butterworth(2, rate, low, high)) if low < high else None


@functools.lru_cache(maxsize=64)
def low_pass(rate: int, cutoff: float) -> Cascade:
    return Cascade(butterworth(4, rate, high=min(cutoff, rate / 2 * 0.9)))
