"""Spectral measures and export steps of decoded audio, in NumPy, one sound at a time (frames, or frames x channels)."""

from __future__ import annotations

import numpy as np

from . import audio as A

#: Frame and hop of the spectra, and the bands of the cepstrum.
FRAME, HOP, BANDS, COEFFICIENTS = 2048, 512, 40, 13


def mono(x: np.ndarray) -> np.ndarray:
    return x.mean(axis=1) if x.ndim == 2 else x


def spectra(x: np.ndarray) -> np.ndarray:
    """Magnitudes, frames x bins, of Hann windows; a sound shorter than a frame is padded to one."""
    y = mono(x)
    y = np.pad(y, (0, max(0, FRAME - len(y))))
    at = np.arange(0, len(y) - FRAME + 1, HOP)
    return np.abs(np.fft.rfft(y[at[:, None] + np.arange(FRAME)] * np.hanning(FRAME), axis=1))


def _bands(rate: int) -> np.ndarray:
    """Triangles spaced evenly on the mel scale, bands x bins."""
    to, back = (lambda f: 2595 * np.log10(1 + f / 700)), (lambda m: 700 * (10 ** (m / 2595) - 1))
    edges = back(np.linspace(0, to(rate / 2), BANDS + 2))
    f = np.arange(FRAME // 2 + 1) * rate / FRAME
    low, mid, high = edges[:-2, None], edges[1:-1, None], edges[2:, None]
    return np.clip(np.minimum((f - low) / (mid - low), (high - f) / (high - mid)), 0, None)


def cepstrum(x: np.ndarray, rate: int) -> np.ndarray:
    """The mean of COEFFICIENTS mel-frequency cepstral coefficients over all frames."""
    level = np.log(spectra(x) ** 2 @ _bands(rate).T + 1e-10)
    k = np.arange(COEFFICIENTS)[:, None]
    basis = np.cos(np.pi * k * (np.arange(BANDS) + 0.5) / BANDS) * np.sqrt(np.where(k == 0, 1, 2) / BANDS)
    return (level @ basis.T).mean(axis=0)


def harmonic_share(x: np.ndarray, width: int = 17) -> float:
    """The share of energy that lasts (medians along time) rather than strikes (medians along frequency)."""
    s = spectra(x)

    def medians(a: np.ndarray) -> np.ndarray:
        padded = np.pad(a, ((width // 2, width // 2), (0, 0)), mode="edge")
        return np.median(np.lib.stride_tricks.sliding_window_view(padded, width, axis=0), axis=-1)

    last, strike = medians(s) ** 2, medians(s.T).T ** 2
    mask = last / np.maximum(last + strike, 1e-20)
    whole = (s**2).sum()
    return float((mask * s**2).sum() / whole) if whole > 0 else 0.0


def flat_tops(x: np.ndarray, run: int = 3) -> float:
    """The share of samples in runs of equal samples at the sound's own peak: clipping that was turned down later."""
    y = np.abs(mono(x))
    if not len(y) or y.max() == 0:
        return 0.0
    top = y >= y.max() * (1 - 1e-4)
    edges = np.flatnonzero(np.diff(np.r_[False, top, False].astype(int)))
    long = edges[1::2] - edges[::2]
    return float(long[long >= run].sum() / len(y))


def measures(x: np.ndarray, rate: int) -> dict[str, float | list[float] | None]:
    """Centre, spread and roll-off of the spectrum (Hz), flatness, zero crossings, levels, crest, attack and decay (ms),
    onsets a second, harmonic share, flat tops and cepstrum; silence has levels only."""
    y = mono(x)
    peak, level = float(np.abs(y).max(initial=0.0)), float(np.sqrt((y * y).mean())) if len(y) else 0.0
    out: dict = {"peak": peak, "rms": level, "crest": peak / level if level > 0 else None}
    names = ("centre_hz", "spread_hz", "rolloff_hz", "flatness", "crossings_hz", "attack_ms", "decay_ms", "onsets_hz", "harmonic", "flat_tops", "cepstrum")
    if peak == 0:
        return out | dict.fromkeys(names)
    s = spectra(x)
    f = np.arange(s.shape[1]) * rate / FRAME
    mean = s.mean(axis=0)
    centre = float((f * mean).sum() / mean.sum())
    env = np.abs(y)
    top = int(env.argmax())
    rising = np.flatnonzero(env[: top + 1] >= 0.1 * peak)
    over = np.flatnonzero(env[top:] >= 0.1 * peak)
    return out | {
        "centre_hz": centre,
        "spread_hz": float(np.sqrt(((f - centre) ** 2 * mean).sum() / mean.sum())),
        "rolloff_hz": float(f[np.searchsorted(np.cumsum(mean), 0.85 * mean.sum())]),
        "flatness": float(np.exp(np.log(mean**2 + 1e-20).mean()) / (mean**2).mean()),
        "crossings_hz": float((np.signbit(y[1:]) != np.signbit(y[:-1])).sum() * rate / max(1, len(y) - 1)),
        "attack_ms": (top - rising[0]) * 1000.0 / rate,
        "decay_ms": over[-1] * 1000.0 / rate,
        "onsets_hz": len(A.onsets(x, rate)[0]) * rate / len(y),
        "harmonic": harmonic_share(x),
        "flat_tops": flat_tops(x),
        "cepstrum": cepstrum(x, rate).tolist(),
    }


# --- export --------------------------------------------------------------------------------------------------------


def centred(x: np.ndarray) -> np.ndarray:
    """Without its offset, channel by channel."""
    return x - x.mean(axis=0) if len(x) else x


def trimmed(x: np.ndarray, rate: int, floor_db: float = -60.0, pad_s: float = 0.005) -> np.ndarray:
    """Without what lies under the floor before and after the sound, but for a little room."""
    level = np.abs(x).max(axis=1) if x.ndim == 2 else np.abs(x)
    loud = np.flatnonzero(level > level.max(initial=0.0) * 10 ** (floor_db / 20))
    if not len(loud):
        return x[:0]
    room = int(pad_s * rate)
    return x[max(0, loud[0] - room) : loud[-1] + 1 + room]


def faded(x: np.ndarray, rate: int, in_s: float = 0.001, out_s: float = 0.005) -> np.ndarray:
    """With short linear fades at both ends."""
    a, b = min(len(x), int(in_s * rate)), min(len(x), int(out_s * rate))
    gain = np.ones(len(x))
    gain[:a] *= np.linspace(0, 1, a, endpoint=False)
    gain[len(x) - b :] *= np.linspace(1, 0, b)
    return x * (gain[:, None] if x.ndim == 2 else gain)


def levelled(x: np.ndarray, peak_db: float = -1.0, most_db: float = 24.0) -> np.ndarray:
    """At a peak level, raised by no more than `most_db`; silence stays."""
    peak = np.abs(x).max(initial=0.0)
    return x * min(10 ** (peak_db / 20) / peak, 10 ** (most_db / 20)) if peak > 0 else x


def limited(x: np.ndarray, ceiling: float = 0.98, knee: float = 0.9) -> np.ndarray:
    """Bent over above the knee so that nothing passes the ceiling."""
    size, room = np.abs(x), ceiling - knee
    return np.where(size <= knee, x, np.sign(x) * (knee + room * np.tanh((size - knee) / room)))


def repitched(x: np.ndarray, semitones: float) -> np.ndarray:
    """Played faster or slower by linear interpolation: pitch and length change together."""
    speed = 2 ** (semitones / 12)
    at = np.arange(0, max(0, len(x) - 1) + 1e-9, speed)
    places = np.arange(len(x))
    return np.stack([np.interp(at, places, c) for c in x.T], axis=1) if x.ndim == 2 else np.interp(at, places, x)


def exported(x: np.ndarray, rate: int, semitones: float = 0.0, to_mono: bool = False) -> np.ndarray:
    """The steps of an export in order: offset, mono (where both channels agree or on demand), pitch, edges, level, fades, ceiling."""
    y = centred(x)
    alike = A.correlation(y)
    if y.ndim == 2 and (to_mono or y.shape[1] == 1 or (alike is not None and alike > 0.999)):
        y = mono(y)
    if semitones:
        y = repitched(y, semitones)
    return limited(faded(levelled(trimmed(y, rate)), rate))
