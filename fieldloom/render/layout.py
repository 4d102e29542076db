"""Small matters of layout: a result over several runs, the width of text, tab stops."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def over_runs(text: Column, runs: Column) -> Column:
    """The text cut evenly for so many runs, the first ones longer by one where it doesn't come out even; one run or none has
    all of it."""
    n = F.greatest(runs.cast("int"), F.lit(1))
    base, more = F.floor(F.length(text) / n).cast("int"), (F.length(text) % n).cast("int")
    start = lambda i: i * base + F.least(i, more) + 1
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substring(text, start(i), base + F.when(i < more, 1).otherwise(0)))


#: Shares of the font size that blanks, narrow characters and others are wide.
BLANK, NARROW, OTHER = 0.33, 0.25, 0.5
NARROW_LETTERS = "ilI.,:;|!"


def text_width(text: Column, size: Column) -> Column:
    """Estimated width in points; line breaks have none."""
    count = lambda pattern: F.regexp_count(text, F.lit(pattern)).cast("double")
    breaks, blanks, narrow = count(r"[\n\r]"), count("[  ]"), count("[" + NARROW_LETTERS.replace("|", r"\|") + "]")
    others = F.length(text) - breaks - blanks - narrow
    return size * (blanks * BLANK + narrow * NARROW + others * OTHER)


def tab_stop(at: Column, stops: Column, every: float = 36.0) -> Column:
    """Where a tab at a position goes: the first stop (an ascending array of points) behind it, else the next multiple of the
    default distance."""
    own = F.get(F.filter(stops, lambda s: s > at + 0.01), 0)
    return F.coalesce(own, (F.floor(at / every) + 1) * every)
