"""Leak detectors as predicates on text, and samples that show without leaking."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Check:
    kind: str
    include: str
    exclude: str = ""
    luhn: bool = False
    needs: tuple[str, ...] = ()  # a match holds one of these, which is quicker to tell
    quick: str = ""  # the same as ``include`` for a search, without going back over long runs


# The detectors' patterns. Each exclusion is what masking itself writes, or no personal data.
CHECKS = (
    Check("email", r"(?i)[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", r"(?i)@(example\.(invalid|com|org|net)|test|localhost)\z", needs=("@",),
          quick=r"(?i)(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"),
    Check("phone", r"(^|[^A-Za-z0-9_])(\+|00)[0-9][0-9 ()._-]{5,16}[0-9]", r"\+1555", needs=("+", "00")),
    Check("ip", r"\b([0-9]{1,3}\.){3}[0-9]{1,3}\b", r"\b(203\.0\.113\.|10\.|127\.|192\.168\.|172\.(1[6-9]|2[0-9]|3[01])\.)", needs=(".",)),
    Check("payment card", r"\b[0-9]{13,19}\b", luhn=True),
    Check("secret token", r"(AKIA[0-9A-Z]{16}|sk_live_[0-9a-zA-Z]{24}|ghp_[0-9a-zA-Z]{36}|eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,})", "REDACTED", needs=("AKIA", "sk_live_", "ghp_", "eyJ")),
    Check("national id", r"(^|[^0-9])([0-8][0-9]{2}-[0-9]{2}-[0-9]{4})([^0-9]|$)", r"(^|[^0-9])(000|666|9[0-9]{2})-", needs=("-",)),
)
KINDS = tuple(c.kind for c in CHECKS)


def custom_checks(patterns: list[tuple[str, str]]) -> list[Check]:
    """User checks by (name, regex): an empty regex is skipped, an empty name is `custom`."""
    return [Check(name or "custom", regex) for name, regex in patterns if regex]


def luhn(digits: Column) -> Column:
    """13 to 19 digits with a right check digit."""
    n = F.length(digits)
    return F.coalesce(digits.rlike(r"^[0-9]{13,19}\z") & n.between(13, 19) & F.call_function("luhn_check", digits), F.lit(False))


def matches(text: Column, check: Check, token_level: bool = False) -> Column:
    """Does the text hold what the check looks for? A null holds nothing.

    Exclusions speak for the whole text; with ``token_level`` they only speak for the match they
    apply to, so a masked value doesn't hide a real one beside it.
    """
    if token_level and check.exclude:
        found = F.exists(F.regexp_extract_all(text, F.lit(check.include), F.lit(0)), lambda m: ~m.rlike(check.exclude))
    else:
        found = text.rlike(check.quick or check.include)
        if check.exclude:
            found &= ~text.rlike(check.exclude)
    if check.luhn:
        found &= F.exists(F.regexp_extract_all(text, F.lit("[0-9]{13,19}"), F.lit(0)), luhn)
    if check.needs:
        found = reduce(lambda a, b: a | b, (text.contains(x) for x in check.needs)) & found
    return F.coalesce(found, F.lit(False))


def redact_sample(text: Column) -> Column:
    """Trimmed, on one line; three characters at either end and at most twelve stars between."""
    s = F.regexp_replace(F.regexp_replace(text, "\n", " "), r"^\s+|\s+\z", "")
    n = F.length(s)
    stars = lambda k: F.repeat(F.lit("*"), k.cast("int"))
    return F.when(n <= 6, stars(n)).otherwise(F.concat(F.substring(s, 1, 3), stars(F.least(n - 6, F.lit(12))), F.substring(s, -3, 3)))
