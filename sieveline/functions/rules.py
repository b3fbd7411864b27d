"""Rules over names, paths and measures as Column expressions. Rule tables are parameters: (label, pattern) in order."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

Rules = list[tuple[str, str]]


def all_labels(text: Column, rules: Rules) -> Column:
    """The labels whose patterns are in the text, in the table's order; null text has none."""
    return F.filter(F.array(*(F.when(text.rlike(p), label) for label, p in rules)), lambda x: x.isNotNull())


def first_label(text: Column, rules: Rules, *further: Column) -> Column:
    """The first rule that fits the text, else the first that fits the next text; null where none does."""
    return F.coalesce(*(F.when(t.rlike(p), label) for t in (text, *further) for label, p in rules))


def only_label(text: Column, rules: Rules, tie: Column | None = None) -> Column:
    """The label of a text that names exactly one kind; of several, the one that `tie` names, else null."""
    found = all_labels(text, rules)
    told = F.get(F.filter(found, lambda x: x == tie), F.lit(0)) if tie is not None else F.lit(None).cast("string")
    return F.when(F.size(found) == 1, F.get(found, F.lit(0))).when(F.size(found) > 1, told)


def leaning(near: Column, far: Column, strong: Rules, weak: Rules) -> Column:
    """Labels of a path: strong rules before weak ones, and what name and folder say before what stands above them."""

    def said(text: Column) -> Column:
        sure = all_labels(text, strong)
        return F.when(F.size(sure) > 0, sure).otherwise(all_labels(text, weak))

    own = said(near)
    return F.when(F.size(own) > 0, own).otherwise(said(far))


def vetoed(candidates: Column, may_stay: Callable[[Column], Column]) -> Column:
    """The candidates that may stay; all of them where none may, as a veto never empties a set."""
    left = F.filter(candidates, may_stay)
    return F.when(F.size(left) > 0, left).otherwise(candidates)


def ruled_out(text: Column, out: str, spare: str | None = None, content: str | None = None) -> Column:
    """Whether a text is excluded: it fits `out`, unless it fits `spare`, which counts for nothing where `content` fits."""
    spared = F.lit(False)
    if spare:
        spared = text.rlike(spare)
        spared = spared & ~text.rlike(content) if content else spared
    return F.coalesce(text.rlike(out) & ~spared, F.lit(False))


def folders(path: Column) -> Column:
    """The folders of a path, outermost first."""
    parts = F.filter(F.split(path, "/"), lambda x: x != "")
    return F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))


def near_folder(path: Column, generic: str) -> Column:
    """The folder that describes a file: the innermost that is not generic, else the outermost of all."""
    every = folders(path)
    telling = F.filter(every, lambda x: ~F.lower(x).rlike(generic))
    return F.coalesce(F.try_element_at(telling, F.lit(-1)), F.try_element_at(every, F.lit(1)))


def shape(name: Column, folder: Column, rules: Rules, hit: str, loop: str) -> Column:
    """The shape that a name states, else its folder; a folder makes no loop of a name that names a hit."""
    own, outer = first_label(name, rules), first_label(folder, rules)
    return F.coalesce(own, F.when(~((outer == loop) & name.rlike(hit)), outer))


#: Fixed values of the shape that sound alone tells: seconds, events and onsets a second.
LOOP_MIN_S, LOOP_MIN_EVENTS, ONESHOT_MAX_S = 1.0, 4, 1.5
ONSET_LOOP_MIN_S, ONSET_LOOP_MIN_HZ = 1.5, 1.0
SUSTAINED_SHARE, SUSTAINED_MAX_HZ = 0.8, 2.0


def sound_shape(seconds: Column, events: Column, onset_hz: Column, harmonic: Column) -> Column:
    """loop, oneshot or null, by length, events between silences, onset rate and harmonic share."""
    held = F.coalesce((harmonic >= SUSTAINED_SHARE) & (onset_hz < SUSTAINED_MAX_HZ), F.lit(False))
    steady = (seconds > ONSET_LOOP_MIN_S) & (onset_hz >= ONSET_LOOP_MIN_HZ) & (onset_hz * seconds >= LOOP_MIN_EVENTS) & ~held
    loop = ((seconds >= LOOP_MIN_S) & (events >= LOOP_MIN_EVENTS)) | F.coalesce(steady, F.lit(False))
    return F.when(seconds.isNull(), None).when(events.isNull(), F.when(seconds < ONESHOT_MAX_S, "oneshot")).when(loop, "loop").when(events <= 1, "oneshot")


#: Beats that a file cut to a grid has at least, and how far off a whole beat it may end.
GRID_MIN_BEATS, GRID_TOL_S = 4, 0.010


def on_grid(seconds: Column, bpm: Column, spared: Column) -> Column:
    """Whether a length is a whole number of beats of a stated tempo; never for what `spared` names one sound."""
    beats = seconds * bpm / 60.0
    whole = (F.round(beats) >= GRID_MIN_BEATS) & (F.abs(beats - F.round(beats)) * 60.0 / bpm <= GRID_TOL_S)
    return F.coalesce(whole & ~spared, F.lit(False))


#: Onsets that make a hit suspect, and the deviation under which sounds are evenly spaced.
MANY_ONSETS, REGULAR_CV = 7, 0.2


def mislabeled_loop(mode: str | None, tagged: Column, onsets: Column, steady: Column) -> Column:
    """Whether a hit is a loop: by tag or by many onsets at a steady tempo, or (mode tag_and_onset) by both a tag and many onsets."""
    hot = F.coalesce(onsets >= MANY_ONSETS, F.lit(False))
    either = tagged | (hot & F.coalesce(steady, F.lit(False)))
    return {"tag_or_onset": either, "tag_and_onset": tagged & hot}.get(mode or "", F.lit(False))


def sample_chain(mode: str | None, events: Column, regularity: Column, echo: Column) -> Column:
    """Whether a file holds several sounds: two (strict), or three evenly spaced ones (regular); echoes are one sound."""
    several = {"strict": events >= 2, "regular": (events >= 3) & (regularity < REGULAR_CV)}.get(mode or "", F.lit(False))
    return F.coalesce(several & ~F.coalesce(echo, F.lit(False)), F.lit(False))


def outside_window(note: Column, sure: Column, low: Column, high: Column) -> Column:
    """Whether a sure note lies outside the limits; unknown notes and limits shut nobody out."""
    return F.coalesce(sure & ~note.between(F.coalesce(low, note), F.coalesce(high, note)), F.lit(False))


def contrast(score: Column, anti: Column, least: float) -> Column:
    """Whether a sound is nearer to what it should be than to what it must not be, and near enough."""
    return (score >= least) & F.coalesce(score > anti, F.lit(True))


def evidence(*witnesses: tuple[str, Column]) -> Column:
    """The first witness that speaks for an item, null where none does."""
    return F.coalesce(*(F.when(F.coalesce(seen, F.lit(False)), name) for name, seen in witnesses))


def hat_seconds(duration: Column, attack_ms: Column, decay_ms: Column) -> Column:
    """How long a hat sounds: attack and decay where both are known, never more than the file."""
    return F.least(duration, F.coalesce((attack_ms + decay_ms) / 1000.0, duration))


def tokens(text: Column, stop: list[str]) -> Column:
    """Distinct lower-case words and numbers without stop words, in the order of their first place."""
    return F.array_except(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0)), F.array(*(F.lit(w) for w in stop)))


def json_list(text: Column) -> Column:
    """A JSON list of strings; [] where the text is no list, null where there is none."""
    return F.when(text.isNotNull(), F.coalesce(F.from_json(text, "array<string>", {"mode": "PERMISSIVE"}), F.array().cast("array<string>")))


def vendor(path: Column, layout: Column, umbrellas: Column, depth: int = 1) -> Column:
    """The vendor (depth 1) or pack (depth 2) that a path is capped under, null where the layout names none.

    In folders by type, and in flat ones, nobody is named; under an umbrella the name is one folder deeper.
    """
    every = F.filter(F.split(path, "/"), lambda x: x != "")
    under = (layout == "umbrella") & F.array_contains(umbrellas, F.get(every, F.lit(0)))
    size = F.when(under, depth + 1).otherwise(depth)
    return F.when(~layout.isin("types", "flat") & (F.size(every) > size), F.concat_ws("/", F.slice(every, F.lit(1), size)))


#: Semitones above C of the keys' spellings (fixed values).
PITCHES = {"C": 0, "C#": 1, "Db": 1, "D": 2, "D#": 3, "Eb": 3, "E": 4, "F": 5, "F#": 6, "Gb": 6, "G": 7, "G#": 8, "Ab": 8, "A": 9, "A#": 10, "Bb": 10, "B": 11, "Cb": 11, "B#": 0, "E#": 5, "Fb": 4}
KEY = r"(?:^|[ _-])([A-G])(#|b)? ?(maj(?:or)?|min(?:or)?|m)?(?=$|[ _.-])"


def key_in(name: Column) -> Column:
    """struct(pitch, mode) of the key that a name states (Am, F# min, Bb); null without one, or where two differ.

    A bare letter states nothing; a mode that is not said is null.
    """
    parts = [F.regexp_extract_all(name, F.lit(KEY), F.lit(i)) for i in (1, 2, 3)]
    number = F.create_map(*(F.lit(x) for pair in PITCHES.items() for x in pair))
    one = F.transform(F.arrays_zip(parts[0].alias("l"), parts[1].alias("a"), parts[2].alias("m")), lambda x: F.struct(number[F.concat(x["l"], x["a"])].alias("p"), x["a"].alias("a"), x["m"].alias("m")))
    real = F.filter(one, lambda x: (x["a"] != "") | (x["m"] != ""))
    pitches = F.array_distinct(F.transform(real, lambda x: x["p"]))
    modes = F.array_distinct(F.filter(F.transform(real, lambda x: F.when(x["m"].startswith("maj"), "major").when(x["m"] != "", "minor")), lambda m: m.isNotNull()))
    return F.when((F.size(pitches) == 1) & (F.size(modes) <= 1), F.struct(F.get(pitches, F.lit(0)).alias("pitch"), F.try_element_at(modes, F.lit(1)).alias("mode")))


SHARPS = ("C", "C#", "D", "D#", "E", "F", "F#", "G", "G#", "A", "A#", "B")


def renoted(name: Column, note: Column, shift: Column) -> Column:
    """The name with its note token (C3, F#2) rewritten to the note it plays once shifted; as it is where it names none.

    note: the MIDI number that the token names (C-2 is 0).
    """
    plays = note + shift
    letters = F.array(*(F.lit(x) for x in SHARPS))
    token = F.concat(F.element_at(letters, (F.pmod(plays, F.lit(12)) + 1).cast("int")), (F.floor(plays / 12) - 2).cast("string"))
    return F.when(note.isNull() | shift.isNull(), name).otherwise(F.regexp_replace(name, F.lit(r"(?i)(^|[ _-])[a-g][#b]?-?[0-9](?=$|[ _.-])"), F.concat(F.lit("$1"), token)))


def edition_name(name: Column, words: str) -> Column:
    """What editions of one recording share: the stem's words in lower case without edition words."""
    stem = F.regexp_replace(F.lower(name), r"\.[a-z0-9]+$", "")
    return F.concat_ws(" ", F.filter(F.split(stem, r"[^a-z0-9#]+"), lambda w: (w != "") & ~w.rlike(f"^({words})$")))


def pitch_verdict(named: Column, vendor: Column, heard: Column, tolerance: float = 0.5) -> Column:
    """What three nullable roots decide: keep the name, renote it, fill it in, or nothing known.

    Two that agree (octaves aside) overrule the third; a sound heard a fifth over its name may be that note's third
    harmonic, so the name stays.
    """

    def off(a: Column, b: Column) -> Column:
        return F.pmod(a - b + 6, F.lit(12)) - 6

    def agree(a: Column, b: Column) -> Column:
        return F.coalesce(F.abs(off(a, b)) <= tolerance, F.lit(False))

    fifth = F.coalesce(F.round(off(heard, named)) == -5, F.lit(False))
    return (
        F.when(named.isNull(), F.when(agree(vendor, heard), "fill both").when(vendor.isNull() & heard.isNotNull(), "fill heard").when(heard.isNull() & vendor.isNotNull(), "fill vendor"))
        .when(agree(named, heard) | agree(named, vendor) | (heard.isNull() & vendor.isNull()), "keep")
        .when(heard.isNull() | fifth, "conflict")
        .when(agree(vendor, heard), "retune")
        .otherwise("renote")
    )


def phrase(is_loop: Column, marked: Column, tonal: Column, drums: Column) -> Column:
    """Whether a loop is a phrase: its maker marks it as one, or something tells that it is tonal and nothing names drums."""
    yes = lambda x: F.coalesce(x, F.lit(False))
    return yes(is_loop) & (yes(marked) | (yes(tonal) & ~yes(drums)))
