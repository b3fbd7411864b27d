"""Derived features and quality from measured columns; null where a source is missing unless said otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CREST_MOST = 8.0


def sub_weight(harmonicity: Column, brightness: Column) -> Column:
    return harmonicity * (1.0 - brightness)


def transient_score(crest: Column) -> Column:
    return F.least(crest / CREST_MOST, F.when(crest.isNotNull(), F.lit(1.0)))


def spectral_balance(brightness: Column) -> Column:
    return (1.0 - brightness) / (brightness + 0.05)


def is_pitched(harmonicity: Column, confidence: Column) -> Column:
    """Three states: null is not measured; without a confidence the harmonicity alone must be higher."""
    both = (harmonicity > 0.6) & (confidence > 0.5)
    return F.when(harmonicity.isNull(), None).when(confidence.isNull(), harmonicity > 0.7).otherwise(both)


def reliable_tempo(bpm: Column, confidence: Column) -> Column:
    return bpm.isNotNull() & (F.coalesce(confidence, F.lit(0.0)) > 0.6)


def loop_confidence(classes: Column, signature: Column) -> Column:
    """The signature's share of the named class, or the larger of both."""
    first, second = signature[0], signature[1]
    pick = F.when(F.array_contains(classes, "Loop"), first).when(F.array_contains(classes, "OneShot"), second).otherwise(F.greatest(first, second))
    return F.when(F.size(signature) >= 2, pick)


def timbral_unit(*parts: Column) -> Column:
    """The parts as a vector of length one; zeros for a zero vector."""
    n = F.sqrt(sum((p * p for p in parts), F.lit(0.0)))
    return F.when(n > 0, F.array(*(p / n for p in parts))).when(n == 0, F.array(*(F.lit(0.0) for _ in parts)))


def attack_class(crest: Column, duration: Column) -> Column:
    label = F.when((duration < 0.08) & (crest >= 8.0), "snap").when((crest < 3.0) & (duration > 0.5), "swell").when((crest >= 3.0) & (duration <= 0.5), "punch")
    return F.when(crest.isNotNull() & duration.isNotNull(), label.otherwise("swell"))


def quality(clipped: Column, offset: Column, level: Column) -> Column:
    """1 less half for clipping, up to .35 for a DC offset over .02 and .35 for near silence; not under 0."""
    dc = F.coalesce(offset, F.lit(0.0))
    score = 1.0 - F.when(clipped, 0.5).otherwise(0.0) - F.when(dc > 0.02, F.least(F.lit(0.35), (dc - 0.02) * 12.0)).otherwise(0.0)
    return F.greatest(F.lit(0.0), score - F.when(level < 0.004, 0.35).otherwise(0.0))


def drum_subtype(category: Column, brightness: Column, harmonicity: Column, noisiness: Column, crest: Column, duration: Column) -> Column:
    """The kind of kick, snare or hat; an unknown measure lets no rule that needs it hold; null for other categories."""
    name = F.lower(category)
    kick = F.when((brightness < 0.10) & (harmonicity > 0.70) & (duration > 0.25), "sub_kick").when((brightness > 0.45) & (crest > 6.0) & (duration < 0.15), "click_kick")
    snare = F.when((brightness > 0.70) & (crest > 9.0), "rimshot").when((brightness > 0.55) & (duration > 0.30) & (noisiness > 0.70), "clap")
    known = brightness.isNotNull()
    hat = F.when(known & (duration > 0.80), "cymbal").when((duration < 0.15) & (brightness > 0.60), "closed_hat").when((duration >= 0.15) & (brightness > 0.55), "open_hat")
    rules = F.when(name.contains("kick"), kick.otherwise("acoustic_kick")).when(name.contains("snare"), snare.otherwise("snare"))
    return rules.when(name.contains("hat") | name.contains("shaker"), hat.otherwise("closed_hat"))


#: The tonal hierarchy profiles of Krumhansl and Kessler (1982), from the tonic upwards.
MAJOR = (6.35, 2.23, 3.48, 2.33, 4.38, 4.09, 2.52, 5.19, 2.39, 3.66, 2.29, 2.88)
MINOR = (6.33, 2.68, 3.52, 5.38, 2.60, 3.53, 2.54, 4.75, 3.98, 2.69, 3.34, 3.17)
NOTES = ("C", "C#", "D", "D#", "E", "F", "F#", "G", "G#", "A", "A#", "B")


def key_of(chroma: Column, least: float = 0.7) -> Column:
    """struct(r, key): the best Pearson correlation of twelve pitch-class weights with the 24 rotated profiles.

    Under `least` the key is null; a flat or silent chroma has neither. Ties go to the first key from C upwards, major first.
    """
    profiles = []
    for root in range(12):
        for mode, profile in (("major", MAJOR), ("minor", MINOR)):
            centre = sum(profile) / 12
            length = sum((p - centre) ** 2 for p in profile) ** 0.5
            unit = [F.lit((profile[(i - root) % 12] - centre) / length) for i in range(12)]
            profiles.append(F.struct(F.lit(-len(profiles)).alias("place"), F.lit(f"{NOTES[root]} {mode}").alias("key"), F.array(*unit).alias("unit")))
    total = lambda xs: F.aggregate(xs, F.lit(0.0), lambda a, x: a + x)
    bound = lambda value, then: F.transform(F.array(value), then)[0]  # noqa: E731  (evaluates a value once)

    def scored(dev: Column) -> Column:
        size = F.sqrt(total(F.transform(dev, lambda x: x * x)))
        each = lambda p: F.struct((total(F.zip_with(dev, p["unit"], lambda x, y: x * y)) / size).alias("r"), p["place"].alias("place"), p["key"].alias("key"))
        return F.when(size > 0, F.array_max(F.transform(F.array(*profiles), each)))

    weight = F.transform(F.slice(chroma, 1, 12), lambda x: x.cast("double"))
    dev = bound(weight, lambda w: bound(total(w) / 12, lambda m: F.transform(w, lambda x: x - m)))
    best = bound(dev, scored)
    return bound(best, lambda b: F.when(b.isNotNull(), F.struct(b["r"].alias("r"), F.when(b["r"] >= least, b["key"]).alias("key"))))
