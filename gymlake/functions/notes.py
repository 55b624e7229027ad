"""Session notes parsing and formatting as native Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gymlake.functions.text import strip

# Markers and defaults of the notes format.
TYPE_MARKER = "Workout Type:"
EXERCISES_MARKER = "Exercises:"
LEGACY_SUFFIX = " Workout:"
DEFAULT_TYPE_STRICT = "Custom"
DEFAULT_TYPE_SQL = "General Training"
NO_EXERCISES_SQL = "No exercises specified"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _lines(notes: Column) -> Column:
    return F.split(notes, "\n", -1)


def _has_text(notes: Column) -> Column:
    return notes.isNotNull() & (F.length(notes) > 0)


def _type_after_marker(first_line: Column) -> Column:
    # text between the first marker and the next one (or end of line), stripped
    return strip(F.get(F.split(first_line, TYPE_MARKER, -1), 1))


def parse_notes_strict(notes) -> Column:
    """F1 -> struct(workout_type, exercises).

    Type follows ``Workout Type:`` on line 1, else ``Custom``; exercises are the
    later lines whose stripped text starts with a digit.
    """
    notes = _c(notes)
    lines = _lines(notes)
    first = lines.getItem(0)
    rest = F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(0)))
    stripped = F.transform(rest, lambda x: strip(x))
    exercises = F.filter(stripped, lambda x: x.rlike("^[0-9]"))
    wtype = F.when(_has_text(notes) & first.contains(TYPE_MARKER), _type_after_marker(first)) \
             .otherwise(F.lit(DEFAULT_TYPE_STRICT))
    ex = F.when(_has_text(notes), exercises).otherwise(F.array().cast("array<string>"))
    return F.struct(wtype.alias("workout_type"), ex.alias("exercises"))


def parse_notes_lenient(notes) -> Column:
    """like F1, but a legacy first line ``Push Workout:`` gives ``Push`` and
    every non-blank later line is an exercise."""
    notes = _c(notes)
    lines = _lines(notes)
    first = lines.getItem(0)
    rest = F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(0)))
    exercises = F.filter(F.transform(rest, lambda x: strip(x)), lambda x: F.length(x) > 0)
    wtype = (F.when(~_has_text(notes), F.lit(DEFAULT_TYPE_STRICT))
             .when(first.contains(TYPE_MARKER), _type_after_marker(first))
             .otherwise(F.replace(first, F.lit(LEGACY_SUFFIX), F.lit(""))))
    ex = F.when(_has_text(notes), exercises).otherwise(F.array().cast("array<string>"))
    return F.struct(wtype.alias("workout_type"), ex.alias("exercises"))


def _after_last_until_newline(notes: Column, marker: str) -> Column:
    return F.trim(F.substring_index(F.substring_index(notes, marker, -1), "\n", 1))


def parse_notes_sql(notes) -> Column:
    """the SQL flavour.  Type is the text after the *last* marker up to the
    newline (space-trimmed), else ``General Training``; exercises are the text after
    the last ``Exercises:`` on that line, split on commas (empty -> [])."""
    notes = _c(notes)
    wtype = F.when(notes.ilike(f"%{TYPE_MARKER}%"), _after_last_until_newline(notes, TYPE_MARKER)) \
             .otherwise(F.lit(DEFAULT_TYPE_SQL))
    ex_text = F.when(notes.ilike(f"%{EXERCISES_MARKER}%"),
                     _after_last_until_newline(notes, EXERCISES_MARKER)) \
               .otherwise(F.lit(NO_EXERCISES_SQL))
    ex_list = F.when(F.length(ex_text) == 0, F.array().cast("array<string>")) \
               .otherwise(F.transform(F.split(ex_text, ",", -1), lambda x: F.trim(x)))
    return F.struct(wtype.alias("workout_type"), ex_text.alias("exercises_text"),
                    ex_list.alias("exercises"))


def format_notes(workout_type, exercises, notes) -> Column:
    """``Workout Type: X`` + numbered exercise block + free text."""
    workout_type, exercises, notes = _c(workout_type), _c(exercises), _c(notes)
    numbered = F.transform(exercises, lambda e, i: F.concat((i + 1).cast("string"), F.lit(". "), e,
                                                             F.lit("\n")))
    block = F.when(F.coalesce(F.size(exercises), F.lit(0)) > 0,
                   F.concat(F.lit("\nExercises:\n"), F.array_join(numbered, ""))).otherwise(F.lit(""))
    tail = F.when(_has_text(notes), F.concat(F.lit("\n"), notes)).otherwise(F.lit(""))
    return F.concat(F.lit(f"{TYPE_MARKER} "), workout_type, block, tail)
