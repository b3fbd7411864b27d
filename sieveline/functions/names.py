"""Words, keys and notes in names and paths, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def words(text: Column) -> Column:
    """Lower-case words: cut at signs, between letters and digits, and inside camelCase."""
    t = F.regexp_replace(text, r"([a-z])([A-Z])", "$1 $2")
    t = F.regexp_replace(t, r"([A-Za-z])([0-9])", "$1 $2")
    t = F.regexp_replace(t, r"([0-9])([A-Za-z])", "$1 $2")
    return F.filter(F.split(F.lower(t), r"[^a-z0-9]+"), lambda w: w != "")


def pack_of(path: Column, umbrellas: tuple[str, ...] = ()) -> Column:
    """The first folder, or the second under an umbrella folder."""
    parts = F.split(path, "/")
    return F.when(parts[0].isin(*umbrellas) if umbrellas else F.lit(False), F.try_element_at(parts, F.lit(2))).otherwise(parts[0])


def content_key(pack: Column, name: Column, duration: Column) -> Column:
    """The same recording in editions of one pack: pack without edition words, lower stem, duration to 1/100."""
    plain = F.trim(F.regexp_replace(F.lower(pack), r"\b(v[0-9]+|deluxe|lite|free|demo|edition)\b", ""))
    stem = F.regexp_replace(F.lower(name), r"\.[a-z0-9]+$", "")
    return F.struct(plain.alias("pack"), stem.alias("stem"), F.round(duration, 2).alias("seconds"))


def without_tokens(name: Column, pattern: str) -> Column:
    """A set's key: the name's words without those that fit the pattern (notes, velocities, numbers)."""
    return F.concat_ws(" ", F.filter(words(name), lambda w: ~w.rlike(pattern)))


def round_robin(name: Column) -> Column:
    """struct(key, number) of a name that ends in rr<n>; number null where it does not."""
    number = F.regexp_extract(F.lower(name), r"[ _-]rr([0-9]+)$", 1)
    key = F.regexp_replace(F.lower(name), r"[ _-]rr[0-9]+$", "")
    return F.struct(key.alias("key"), F.when(number != "", number).cast("int").alias("number"))


#: Semitones above C of the note letters (fixed values).
NOTES = {"c": 0, "d": 2, "e": 4, "f": 5, "g": 7, "a": 9, "b": 11}


def note_of(name: Column) -> Column:
    """The MIDI note written as a word like C3 or F#2 (C-2 is 0); null unless there is exactly one."""
    found = F.regexp_extract_all(F.lower(name), F.lit(r"(?:^|[ _-])([a-g][#b]?-?[0-9])(?=$|[ _.-])"), F.lit(1))
    token = found[0]
    letter = F.create_map(*(F.lit(x) for pair in NOTES.items() for x in pair))[F.substring(token, 1, 1)]
    shift = F.when(token.contains("#"), 1).when(F.substring(token, 2, 1) == "b", -1).otherwise(0)
    octave = F.regexp_extract(token, r"(-?[0-9])$", 1).cast("int")
    return F.when(F.size(found) == 1, letter + shift + 12 * (octave + 2))


def safe_name(name: Column, limit: int = 64) -> Column:
    """A name without signs that file systems refuse, white space folded, cut in the middle to the limit."""
    t = F.trim(F.regexp_replace(F.regexp_replace(name, r'[<>:"/\\|?*\x00-\x1F]', " "), r"\s+", " "))
    head, tail = (limit - 1) - (limit - 1) // 2, (limit - 1) // 2
    return F.when(F.length(t) <= limit, t).otherwise(F.concat(F.substring(t, 1, head), F.lit("~"), F.right(t, F.lit(tail))))


def ascii_name(name: Column) -> Column:
    """Compatibility decomposition without marks; what is not ASCII then is left out."""
    parts = F.reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit("decompose"), name, F.lit(True))
    return F.regexp_replace(parts, r"[^\x20-\x7E]", "")
