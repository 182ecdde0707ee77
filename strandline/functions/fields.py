"""Column expressions for annotation text: numbers, white space, attributes."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_U32 = 4294967295
#: White space as Unicode has it; the regular expressions of the JVM alone know the ASCII kind.
SPACE = r"\s\p{Z}\x85"


def trimmed(text: Column) -> Column:
    return F.regexp_replace(text, rf"^[{SPACE}]+|[{SPACE}]+\z", "")


def u32(text: Column, signed: bool = False) -> Column:
    """An unsigned 32-bit number from digits (with ``signed`` also after a plus), as a long; null for anything else."""
    number = text.try_cast("long")
    return F.when(text.rlike(r"^\+?0*[0-9]{1,10}\z" if signed else r"^0*[0-9]{1,10}\z") & (number <= MAX_U32), number)


def once(value: Column) -> Column:
    """The same value from a generator, so that what uses it doesn't compute it again each time."""
    return F.explode(F.array(value))


def first_value(text: Column, key: str, until: str) -> Column:
    """What follows the first ``key=``, wherever it stands, up to a character of ``until``; null without the key, may be empty."""
    wanted = re.escape(key).replace('"', r"\"") + "="
    return F.when(F.instr(text, key + "=") > 0, F.regexp_extract(text, f"{wanted}([^{until}]*)", 1))


def indexed_value(text: Column, key: str, until: str) -> Column:
    """As ``first_value``, but of the first ``key=`` that has a value; null if none has."""
    return F.nullif(F.regexp_extract(text, re.escape(key) + f"=([^{until}]+)", 1), F.lit(""))


def jvm_pattern(pattern: str) -> str:
    """Named groups written ``(?P<name>`` as the JVM writes them."""
    return pattern.replace("(?P<", "(?<")


def any_pattern(patterns: list[str]) -> str:
    r"""Classes such as ``\w`` are those of Unicode, and only a line feed ends a line for ``.``, ``^`` and ``$``."""
    return "(?dU)" + "|".join(f"(?:{jvm_pattern(p)})" for p in patterns)
