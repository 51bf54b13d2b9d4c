"""Filter design and zero-phase filtering in numpy, from the textbook definitions.

Analog prototype poles, frequency transform, bilinear transform, second-order sections. Designs run on the driver and
are a few numbers; filtering is applied to whole series where they lie.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

#: Chebyshev pass-band ripple in dB; the notch's quality factor.
RIPPLE, NOTCH_Q = 0.5, 35.0


def _prototype(order: int, ripple: float | None) -> tuple[np.ndarray, float]:
    k = np.arange(1, order + 1)
    if ripple is None:
        return np.exp(1j * np.pi * (2 * k + order - 1) / (2 * order)), 1.0
    eps = np.sqrt(10 ** (ripple / 10) - 1)
    mu, theta = np.arcsinh(1 / eps) / order, np.pi * (2 * k - 1) / (2 * order)
    poles = -np.sinh(mu) * np.sin(theta) + 1j * np.cosh(mu) * np.cos(theta)
    gain = float(np.real(np.prod(-poles)))
    return poles, gain / np.sqrt(1 + eps**2) if order % 2 == 0 else gain


def design(kind: str, order: int, cutoff: float | tuple[float, float], fs: float, ripple: float | None = None) -> np.ndarray:
    """Second-order sections (k, 6) of a low, high, band or stop filter; Butterworth, or Chebyshev-I with a ripple."""
    check(kind, order, cutoff, fs)
    poles, gain = _prototype(order, ripple)
    edges = 2 * np.tan(np.pi * np.atleast_1d(np.asarray(cutoff, float)) / fs)
    if kind in ("low", "high"):
        w = edges[0]
        if kind == "low":
            zeros, poles, gain = np.zeros(0), poles * w, gain * w**order
        else:
            gain = gain * float(np.real(1 / np.prod(-poles)))
            zeros, poles = np.zeros(order), w / poles
    else:
        width, mid = edges[1] - edges[0], edges[0] * edges[1]
        if kind == "band":
            half = poles * width / 2
            root = np.sqrt(half**2 - mid + 0j)
            zeros, gain = np.zeros(order), gain * width**order
        else:
            gain = gain * float(np.real(1 / np.prod(-poles)))
            half = width / 2 / poles
            root = np.sqrt(half**2 - mid + 0j)
            zeros = np.concatenate((np.full(order, 1j * np.sqrt(mid)), np.full(order, -1j * np.sqrt(mid))))
        poles = np.concatenate((half + root, half - root))
    gain = gain * float(np.real(np.prod(2 - zeros) / np.prod(2 - poles)))
    zeros = np.concatenate(((2 + zeros) / (2 - zeros), -np.ones(len(poles) - len(zeros))))
    poles = (2 + poles) / (2 - poles)
    return _sections(zeros, poles, gain)


def _paired(roots: np.ndarray) -> list[np.ndarray]:
    """Conjugate pairs first, then real roots by twos."""
    up = sorted(roots[np.imag(roots) > 1e-12], key=lambda r: (abs(r), np.real(r)))
    real = sorted(np.real(roots[np.abs(np.imag(roots)) <= 1e-12]))
    return [np.array([r, np.conj(r)]) for r in up] + [np.array(real[k : k + 2]) for k in range(0, len(real), 2)]


def _sections(zeros: np.ndarray, poles: np.ndarray, gain: float) -> np.ndarray:
    """Poles nearest the unit circle take the nearest zeros."""
    pairs = sorted(_paired(poles), key=lambda p: -np.abs(p).max())
    left = list(zeros)
    rows = []
    for pair in pairs:
        mine: list[complex] = []
        while len(mine) < len(pair) and left:
            k = int(np.argmin([abs(z - pair[0]) for z in left]))
            z = left.pop(k)
            mine.append(z)
            if abs(np.imag(z)) > 1e-12:
                k = int(np.argmin([abs(x - np.conj(z)) for x in left]))
                mine.append(left.pop(k))
        b, a = np.real(np.poly(mine)), np.real(np.poly(pair))
        rows.append(np.concatenate((np.pad(b, (0, 3 - len(b))), np.pad(a, (0, 3 - len(a))))))
    sos = np.array(rows)
    sos[0, :3] *= gain
    return sos[::-1] if len(sos) > 1 else sos


def notch(f0: float, fs: float, q: float = NOTCH_Q) -> np.ndarray:
    w0 = f0 / (fs / 2)
    beta = np.tan(w0 / q * np.pi / 2)
    g = 1 / (1 + beta)
    return np.array([[g, -2 * g * np.cos(w0 * np.pi), g, 1, -2 * g * np.cos(w0 * np.pi), 2 * g - 1]])


def fir(kind: str, order: int, cutoff: float | tuple[float, float], fs: float) -> np.ndarray:
    """Hamming-windowed sinc taps; the order is made even for high and stop. Unit gain in the first pass-band."""
    check(kind, order, cutoff, fs)
    order += order % 2 if kind in ("high", "stop") else 0
    edges = np.atleast_1d(np.asarray(cutoff, float)) / (fs / 2)
    bands = {"low": [(0.0, edges[0])], "high": [(edges[0], 1.0)], "band": [(edges[0], edges[-1])], "stop": [(0.0, edges[0]), (edges[-1], 1.0)]}[kind]
    m = np.arange(order + 1) - order / 2
    taps = sum(b * np.sinc(b * m) - a * np.sinc(a * m) for a, b in bands) * (0.54 - 0.46 * np.cos(2 * np.pi * np.arange(order + 1) / order))
    a, b = bands[0]
    at = 0.0 if a == 0 else 1.0 if b == 1 else (a + b) / 2
    return taps / np.sum(taps * np.cos(np.pi * m * at))


def check(kind: str, order: int, cutoff, fs: float) -> None:
    edges = [float(x) for x in np.atleast_1d(np.asarray(cutoff, float))]
    if kind not in ("low", "high", "band", "stop"):
        raise ValueError(f"unknown filter kind {kind!r}")
    if order <= 0 or any(e <= 0 for e in edges):
        raise ValueError("order and cutoffs must be positive")
    if any(e >= fs / 2 for e in edges):
        raise ValueError("cutoffs must be below half the sampling rate")
    if kind in ("band", "stop") and (len(edges) != 2 or edges[0] >= edges[1]):
        raise ValueError("a band needs a lower and a higher cutoff")


def default_cutoff(kind: str, fs: float) -> float | tuple[float, float]:
    """Half of Nyquist, a hundredth of it, or both, to 2 decimals."""
    nyquist = fs / 2
    high, low = round(0.5 * nyquist, 2), round(0.01 * nyquist, 2)
    return {"low": high, "high": low, "band": (low, high), "stop": (low, high)}[kind]


def response(sos: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Complex gain at angular frequencies w (pi is Nyquist)."""
    z = np.exp(-1j * w)
    out = np.ones_like(z)
    for b0, b1, b2, a0, a1, a2 in sos:
        out = out * (b0 + b1 * z + b2 * z**2) / (a0 + a1 * z + a2 * z**2)
    return out


def _steady(section: np.ndarray) -> tuple[float, float]:
    """The state of a section that a constant 1 has always fed."""
    b0, b1, b2, _, a1, a2 = section
    y = (b0 + b1 + b2) / (1 + a1 + a2)
    z2 = b2 - a2 * y
    return b1 - a1 * y + z2, z2


#: Samples of a block in which a section's recurrence is a matrix product.
BLOCK = 128


@lru_cache(256)
def _products(section: tuple[float, ...]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of one section over a block: samples to outputs, state to outputs, samples to next state, state to next state."""
    b0, b1, b2, _, a1, a2 = section
    step, feed = np.array([[-a1, 1.0], [-a2, 0.0]]), np.array([b1 - a1 * b0, b2 - a2 * b0])
    powers = np.empty((BLOCK + 1, 2, 2))
    powers[0] = np.eye(2)
    for k in range(BLOCK):
        powers[k + 1] = step @ powers[k]
    impulse = np.concatenate(([b0], powers[: BLOCK - 1, 0] @ feed))
    lag = np.arange(BLOCK)[:, None] - np.arange(BLOCK)
    return np.where(lag >= 0, impulse[np.abs(lag)], 0.0).T, powers[:BLOCK, 0].T, powers[BLOCK - 1 :: -1] @ feed, powers[BLOCK]


def passed(section: np.ndarray, x: np.ndarray, z1: float, z2: float) -> tuple[np.ndarray, float, float]:
    """One section over x from state (z1, z2), and the state behind x. In a block the output is linear in its samples and
    the state before it: products give all blocks' own part at once, and only the states are stepped from block to block."""
    if not len(x):
        return x, z1, z2
    own, given, push, step = _products(tuple(map(float, section)))
    wide = np.concatenate((x, np.zeros(-len(x) % BLOCK))).reshape(-1, BLOCK)
    pushed = wide @ push
    states, now = np.empty((len(wide), 2)), np.array([z1, z2])
    for j in range(len(wide)):
        states[j] = now
        now = step @ now + pushed[j]
    y = (wide @ own + states @ given).reshape(-1)[: len(x)]
    _, b1, b2, _, a1, a2 = section
    before = b2 * x[-2] - a2 * y[-2] if len(x) > 1 else z2
    return y, b1 * x[-1] - a1 * y[-1] + before, b2 * x[-1] - a2 * y[-1]


def _forward(sos: np.ndarray, x: np.ndarray) -> np.ndarray:
    level = x[0]
    for s in sos:
        z1, z2 = _steady(s)
        x, level = passed(s, x, z1 * level, z2 * level)[0], level * s[:3].sum() / s[3:].sum()
    return x


def reflection(sos: np.ndarray) -> int:
    """Samples reflected at each end: three times the order."""
    return 3 * (2 * len(sos) - min(int((sos[:, 2] == 0).sum()), int((sos[:, 5] == 0).sum())))


def zero_phase(sos: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Forward and backward over x with odd reflections at both ends and steady initial states. A series no longer
    than the reflection comes back as it is."""
    pad = reflection(sos)
    if len(x) <= pad:
        return x.copy()
    wide = np.concatenate((2 * x[0] - x[pad:0:-1], x, 2 * x[-1] - x[-2 : -pad - 2 : -1]))
    return _forward(sos, _forward(sos, wide)[::-1])[::-1][pad:-pad].copy()


def zero_phase_fir(taps: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The same with taps alone."""
    pad = 3 * (len(taps) - 1)
    if len(x) <= pad:
        return x.copy()
    wide = np.concatenate((2 * x[0] - x[pad:0:-1], x, 2 * x[-1] - x[-2 : -pad - 2 : -1]))
    for _ in range(2):
        wide = np.convolve(np.concatenate((np.full(len(taps) - 1, wide[0]), wide)), taps, "valid")[::-1]
    return wide[pad:-pad].copy()
