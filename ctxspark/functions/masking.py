"""Masking of personal data and secrets: an ordered fold of replacements with a counter for each rule."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

_VALUE = r"""\s*(?:=|:|"|')\s*['"]?([A-Za-z0-9\-_.+/]{20,})['"]?"""

# Rule, pattern (any case), placeholder; the order decides what a text is counted as.
RULES: list[tuple[str, str, str]] = [
    ("signed_urls", r"""https?://[^\s"']+(?:[?&](?:X-Amz-Signature|x-goog-signature|sig|sv=)[^&\s"']+|[?&](?:X-Amz-Security-Token|X-Amz-Credential)[^&\s"']+|[?&]sas=[^&\s"']+)[^\s"']*""", "[REDACTED_SIGNED_URL]"),
    ("jwts", r"\beyJ[A-Za-z0-9\-_]+\.[A-Za-z0-9\-_]+\.[A-Za-z0-9\-_]+\b", "[REDACTED_JWT]"),
    ("api_keys", r"(?:api[_\-]?key|secret[_\-]?key|private[_\-]?key|access[_\-]?key|client[_\-]?secret|app[_\-]?secret|auth[_\-]?token|app[_\-]?key|service[_\-]?key)" + _VALUE, "[REDACTED_API_KEY]"),
    ("access_tokens", r"(?:access[_\-]?token|refresh[_\-]?token|id[_\-]?token|session[_\-]?token|auth[_\-]?token|csrf[_\-]?token)" + _VALUE, "[REDACTED_TOKEN]"),
    ("emails", r"[a-z0-9._%+\-]+@[a-z0-9.\-]+\.[a-z]{2,}", "[REDACTED_EMAIL]"),
    ("phones", r"(?:\+?(?:1[-.\s]?)?(?:\(\d{1,4}\)|\d{1,4})[-.\s]?\d{3}[-.\s]?\d{4,9})", "[REDACTED_PHONE]"),
    ("nics", r"\b(?:\d{9}[VXvx]|\d{12})\b", "[REDACTED_NIC]"),
    ("tins", r"\b(?:\d{2}-\d{7}|\d{3}-\d{2}-\d{4}|\d{10})\b", "[REDACTED_TIN]"),
    ("vats", r"\b[A-Z]{2}\d{8,12}\b", "[REDACTED_VAT]"),
    ("credit_cards", r"\b(?:4\d{12}(?:\d{3})?|5[1-5]\d{14}|3[47]\d{13}|3(?:0[0-5]|[68]\d)\d{11}|6(?:011|5\d{2})\d{12}|(?:2131|1800|35\d{3})\d{11})\b", "[REDACTED_CC]"),
    ("ips", r"\b(?:(?:25[0-5]|2[0-4]\d|[01]?\d\d?)\.){3}(?:25[0-5]|2[0-4]\d|[01]?\d\d?)\b", "[REDACTED_IP]"),
]
OFF_BY_DEFAULT = {"ips"}


def enabled_rules(disabled: set[str] = OFF_BY_DEFAULT) -> list[tuple[str, str, str]]:
    return [r for r in RULES if r[0] not in disabled]


#: What any match of a rule holds, as tests that cost less than the rule. They are made on the text before the first rule: a
#: placeholder holds no part of a later rule's match, so such a match stands between placeholders, in the text as it was.
_DIGITS = r"[0-9]{3}(?:[-.\s]?[0-9]{4}|-[0-9]{2}-[0-9]{4})"
_WORDS = {"jwts": ("eyj",), "api_keys": ("key", "secret", "token"), "access_tokens": ("token",)}
_SIGNS = {"signed_urls": "://", "emails": "@"}


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once a row, however often body names it."""
    return F.transform(F.array(value), body)[0]


def _hints(text: Column, rules: list[tuple[str, str, str]]) -> Column:
    """For each rule, whether the text may hold a match of it; null for a null text."""
    def each(low: Column, digits: Column) -> Column:
        found = []
        for name, _, _ in rules:
            if name in _WORDS:
                found.append(functools.reduce(Column.__or__, [low.contains(w) for w in _WORDS[name]]))
            elif name in _SIGNS:
                found.append(text.contains(_SIGNS[name]))
            else:
                found.append(F.lit(True) if name == "ips" else digits)
        return F.array(*found)

    return _let(F.lower(text), lambda low: _let(text.rlike(_DIGITS), lambda digits: each(low, digits)))


def _folded(text: Column, disabled: set[str]) -> Column:
    """text (masked) and counts (of each enabled rule) of a text."""
    rules = enabled_rules(disabled)

    def apply(state: Column, i: int, hints: Column) -> Column:
        pattern, placeholder = F.lit("(?i)" + rules[i][1]), F.lit(rules[i][2])

        def replaced(s: Column, n: Column) -> Column:
            return F.struct(F.when(n > 0, F.regexp_replace(s["text"], pattern, placeholder)).otherwise(s["text"]).alias("text"), F.concat(s["counts"], F.array(n)).alias("counts"))

        return _let(state, lambda s: _let(F.when(~hints[i], 0).otherwise(F.regexp_count(s["text"], pattern)), lambda n: replaced(s, n)))

    def fold(t: Column, hints: Column) -> Column:
        state = F.struct(t.alias("text"), F.array().cast("array<int>").alias("counts"))
        for i in range(len(rules)):
            state = apply(state, i, hints)
        return state

    return _let(text, lambda t: _let(_hints(t, rules), lambda hints: fold(t, hints)))


def mask(text: Column, disabled: set[str] = OFF_BY_DEFAULT) -> Column:
    return _folded(text, disabled)["text"]


def mask_counts(text: Column, disabled: set[str] = OFF_BY_DEFAULT) -> dict[str, Column]:
    """Matches of each rule on the text as the rules before it left it, and their total."""
    found = _folded(text, disabled)["counts"]
    counts = {name: F.lit(0) for name, _, _ in RULES}
    counts |= {name: found[i] for i, (name, _, _) in enumerate(enabled_rules(disabled))}
    counts["total"] = F.aggregate(found, F.lit(0), lambda s, n: s + n)
    return counts


def contains_pii(text: Column, disabled: set[str] = OFF_BY_DEFAULT) -> Column:
    rules = enabled_rules(disabled)
    return _let(_hints(text, rules), lambda hints: functools.reduce(Column.__or__, [hints[i] & text.rlike("(?i)" + pattern) for i, (_, pattern, _) in enumerate(rules)], F.lit(False)))


def redact(text: Column) -> Column:
    """Masking of output; empty text stays as it is."""
    return F.when(text.isNull() | (text == ""), text).otherwise(mask(text))
