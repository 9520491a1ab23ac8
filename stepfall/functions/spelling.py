"""Spellings of a snake_case event name, and the key they all share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TRANSFORMS = ("snake", "camel", "pascal", "kebab", "evt", "track", "abbrev")


def _drop_vowels(word: Column) -> Column:
    return F.when(
        F.length(word) > 3,
        F.concat(F.substring(word, 1, 1),
                 F.regexp_replace(F.substring(word, F.lit(2), F.length(word)), "[aeiou]", "")),
    ).otherwise(word)


def pascal(snake: Column) -> Column:
    return F.array_join(F.transform(F.split(snake, "_"), F.initcap), "")


def camel(snake: Column) -> Column:
    head = F.element_at(F.split(snake, "_"), 1)
    return F.concat(head, F.substring(pascal(snake), F.length(head) + 1, F.length(snake)))


def abbreviated(snake: Column) -> Column:
    return F.array_join(F.transform(F.split(snake, "_"), _drop_vowels), "_")


def spellings(snake: Column) -> dict[str, Column]:
    return {
        "snake": snake,
        "camel": camel(snake),
        "pascal": pascal(snake),
        "kebab": F.translate(snake, "_", "-"),
        "evt": F.concat(F.lit("evt_"), snake),
        "track": F.concat(F.lit("track_"), snake),
        "abbrev": abbreviated(snake),
    }


def name_skeleton(name: Column) -> Column:
    """One key for every spelling of a base name.

    Prefix off, split at ``_``, ``-`` and case changes, lower case, then the vowel drop,
    which changes nothing when applied twice.
    """
    plain = F.regexp_replace(name, "^(evt_|track_)", "")
    parted = F.regexp_replace(F.translate(plain, "-", "_"), "([a-z0-9])([A-Z])", "$1_$2")
    return F.array_join(F.transform(F.split(F.lower(parted), "_"), _drop_vowels), "_")


def sentence_of(snake: Column) -> Column:
    """Description of an event nobody wrote a purpose for: ``Cart view event.``"""
    text = F.replace(snake, F.lit("_"), F.lit(" "))
    return F.concat(F.upper(F.substring(text, 1, 1)),
                    F.lower(F.substring(text, F.lit(2), F.length(text))), F.lit(" event."))
