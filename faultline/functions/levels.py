"""Level words, numbers and priorities as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Level words and the level each stands for.
LEVEL_WORDS = {
    "trace": "TRACE", "trc": "TRACE", "finest": "TRACE", "verbose": "TRACE",
    "debug": "DEBUG", "dbg": "DEBUG", "fine": "DEBUG",
    "info": "INFO", "inf": "INFO", "information": "INFO", "informational": "INFO",
    "notice": "NOTICE",
    "warn": "WARN", "warning": "WARN", "wrn": "WARN",
    "error": "ERROR", "err": "ERROR", "severe": "ERROR",
    "fatal": "FATAL", "critical": "FATAL", "crit": "FATAL", "panic": "FATAL",
    "alert": "FATAL", "emerg": "FATAL", "emergency": "FATAL",
}
# Rank of a level, lowest first.
LEVEL_ORDER = ["TRACE", "DEBUG", "INFO", "NOTICE", "WARN", "ERROR", "FATAL"]
# Level of each syslog severity 0..7.
SYSLOG_LEVELS = ["FATAL", "FATAL", "FATAL", "ERROR", "WARN", "NOTICE", "INFO", "DEBUG"]

#: Alternation of the words, longest first, for use inside larger patterns.
WORD_PATTERN = "|".join(sorted(LEVEL_WORDS, key=lambda w: (-len(w), w)))

_WORD_MAP = "map(" + ",".join(f"'{k}','{v}'" for k, v in LEVEL_WORDS.items()) + ")"


def level_of_word(word: Column) -> Column:
    """Level a word stands for, null for any other word."""
    return F.try_element_at(F.expr(_WORD_MAP), F.lower(F.trim(word)))


def level_of_python_number(n: Column) -> Column:
    """Numbers of Python's logging module."""
    return (F.when(n >= 50, "FATAL").when(n >= 40, "ERROR").when(n >= 30, "WARN")
            .when(n >= 25, "NOTICE").when(n >= 20, "INFO").when(n >= 10, "DEBUG").when(n > 0, "TRACE"))


def level_of_priority(pri: Column) -> Column:
    """Severity within a syslog priority value."""
    return F.try_element_at(F.array(*[F.lit(x) for x in SYSLOG_LEVELS]), F.pmod(pri, F.lit(8)) + 1)


def level_of_status(status: Column) -> Column:
    """Level of an HTTP status: 5xx ERROR, 4xx WARN, any other INFO."""
    return F.when(status >= 500, "ERROR").when(status >= 400, "WARN").when(status.isNotNull(), "INFO")


def level_rank(level: Column) -> Column:
    """1 for TRACE up to 7 for FATAL, 0 for none."""
    return F.array_position(F.array(*[F.lit(x) for x in LEVEL_ORDER]), F.coalesce(level, F.lit("")))
