"""Tempo, bar and pitch arithmetic as Column expressions. Null in, null out, unless said otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def fold_closed(x: Column, lo: float = 60.0, hi: float = 200.0) -> Column:
    """Into [lo, hi] by octaves: doubled below lo, halved above hi; null where not positive."""
    up = x * F.pow(F.lit(2.0), F.ceil(F.log2(F.lit(lo) / x)))
    down = x / F.pow(F.lit(2.0), F.ceil(F.log2(x / F.lit(hi))))
    return F.when(x <= 0, None).when(x < lo, up).when(x > hi, down).otherwise(x)


def fold_half_open(x: Column, lo: float, hi: float) -> Column:
    """Into [lo, hi): x = hi is halved."""
    up = x * F.pow(F.lit(2.0), F.ceil(F.log2(F.lit(lo) / x)))
    down = x / F.pow(F.lit(2.0), F.floor(F.log2(x / F.lit(hi))) + 1)
    return F.when(x <= 0, None).when(x < lo, up).when(x >= hi, down).otherwise(x)


def beats(duration: Column, bpm: Column) -> Column:
    return duration * bpm / 60.0


def whole_bars(duration: Column, bpm: Column, tolerance: float = 0.02) -> Column:
    """Whether a duration is whole 4/4 bars, to a share of a bar."""
    bars = beats(duration, bpm) / 4.0
    return (bars >= 0.5) & (F.abs(bars - F.round(bars)) <= tolerance)


#: Bars that a loop usually has (fixed values).
BARS = (1, 2, 4, 8, 16)


def tempo_confidence(duration: Column, bpm: Column, off_beats: float = 0.5) -> Column:
    """1 where the duration is whole bars at the tempo, its double or half; 0 at `off_beats` off or more."""
    off = F.least(*(F.abs(beats(duration, bpm) * m - 4.0 * b) for m in (1.0, 2.0, 0.5) for b in BARS))
    return F.when((duration > 0) & (bpm > 0), F.greatest(F.lit(0.0), 1.0 - off / off_beats))


def tempos_agree(a: Column, b: Column, tolerance: float = 0.02) -> Column:
    """Within a tolerance at the tempo, its double or half."""
    out = F.lit(False)
    for m in (1.0, 2.0, 0.5):
        out = out | (F.abs(a * m - b) <= tolerance * b)
    return out


def tempo_chain(duration: Column, *sources: tuple[str, Column]) -> Column:
    """struct(bpm, src): the first source whose tempo, double or half makes whole bars; null where none does."""
    out = None
    for name, bpm in sources:
        for m in (1.0, 2.0, 0.5):
            fits = F.when(whole_bars(duration, bpm * m) & (bpm * m).between(50, 250), F.struct((bpm * m).alias("bpm"), F.lit(name).alias("src")))
            out = fits if out is None else F.coalesce(out, fits)
    return out


def named_bpm(text: Column) -> Column:
    """A tempo written as `120bpm` or `120 bpm`, between 50 and 250."""
    found = F.regexp_extract(F.lower(text), r"([0-9]{2,3}) ?bpm", 1)
    value = F.when(found != "", found).cast("int")
    return F.when(value.between(50, 250), value)


def pitch_distance(a: Column, b: Column) -> Column:
    """Semitones between two pitch classes, round the circle of twelve."""
    d = F.pmod(a - b, F.lit(12))
    return F.least(d, 12 - d)


def retune_shift(note: Column, target: int = 0) -> Column:
    """The shortest way from a note to the target's pitch class: -6 to 5 semitones."""
    return F.pmod(F.lit(target) - note + 6, F.lit(12)) - 6


def length_tempo(duration: Column, low: float = 60.0, high: float = 200.0, middle: float = 120.0) -> Column:
    """The tempo at which a duration is whole bars that lies nearest to the middle (in octaves), within the limits."""
    able = F.filter(F.array(*(F.struct(F.abs(F.log2(240.0 * b / duration / middle)).alias("off"), (240.0 * b / duration).alias("bpm")) for b in BARS)), lambda x: x["bpm"].between(low, high))
    return F.when(duration > 0, F.array_min(able)["bpm"])


def tempo_with_fallbacks(duration: Column, sources: list[tuple[str, Column]], fallbacks: list[tuple[str, Column]]) -> Column:
    """struct(bpm, src): the chain's answer, else the first fallback there is, as it stands, else the length's own tempo."""
    found = tempo_chain(duration, *sources)
    late = [F.when(bpm.isNotNull(), F.struct(bpm.cast("double").alias("bpm"), F.lit(name).alias("src"))) for name, bpm in fallbacks]
    own = length_tempo(duration)
    return F.coalesce(found, *late, F.when(own.isNotNull(), F.struct(own.alias("bpm"), F.lit("length").alias("src"))))
