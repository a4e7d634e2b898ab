"""Personal-data detection as Column expressions.

Hints live in one bit mask per value, so that a field's hints are a `bit_or`
(a plain hash aggregate) and are spelled out only on the small result tables.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from docstrata.functions.paths import last_segment

# Name patterns on the last path segment, in hint order.
NAME_PATTERNS = [
    ("email", "email"),
    ("e[-_]?mail", "email"),
    ("phone", "phone"),
    ("mobile", "phone"),
    ("tel(?:ephone)?", "phone"),
    ("password", "password"),
    ("passwd", "password"),
    ("pwd", "password"),
    ("secret", "secret"),
    ("token", "token"),
    ("api[-_]?key", "api_key"),
    ("access[-_]?key", "access_key"),
    ("auth", "auth"),
    ("ssn", "ssn"),
    ("serial", "ssn"),
    ("social[-_]?security", "ssn"),
    ("credit[-_]?card", "credit_card"),
    ("card[-_]?number", "credit_card"),
    ("cvv", "cvv"),
    ("cvc", "cvv"),
    ("address", "address"),
    ("birth[-_]?date", "birthdate"),
    ("dob", "birthdate"),
    ("ip[-_]?address", "ip_address"),
    (r"\Aci\z", "ci"),
    (r"\Adi\z", "di"),
    ("salt", "salt"),
    ("name", "name"),
]

# A segment with this name marks everything below it.
ANCESTOR_NAMES = ["address", "location"]

# White space, inside of brackets, as patterns of the value lists mean it on any regular expression engine.
SPACES = r"\t\n\x0B\f\r\x{20}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}"

# Patterns over whole string values, in hint order.
VALUE_PATTERNS = [
    (r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}", "email"),
    (r"\+?\d{1,4}[-." + SPACES + r"]?\(?\d{1,3}\)?[-." + SPACES + r"]?\d{1,4}[-." + SPACES + r"]?\d{1,9}", "phone"),
    (r"\d{3}[-]?\d{2}[-]?\d{4}", "ssn"),
    (r"\d{4}[-" + SPACES + r"]?\d{4}[-" + SPACES + r"]?\d{4}[-" + SPACES + r"]?\d{4}", "credit_card"),
    (r"eyJ[a-zA-Z0-9_-]+\.eyJ[a-zA-Z0-9_-]+\.[a-zA-Z0-9_-]+", "jwt"),
    ("(?i:[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12})", "uuid"),
    (r"(?:(?:25[0-5]|2[0-4]\d|[01]?\d\d?)\.){3}(?:25[0-5]|2[0-4]\d|[01]?\d\d?)", "ip_address"),
    (r"(?:[0-9a-fA-F]{1,4}:){7}[0-9a-fA-F]{1,4}", "ip_address"),
]

# Warning sentence of each hint.
WARNINGS = {
    "email": "Email address detected",
    "phone": "Phone number detected",
    "password": "Password field detected",
    "secret": "Secret field detected",
    "token": "Token field detected",
    "api_key": "API key detected",
    "access_key": "Access key detected",
    "auth": "Authentication field detected",
    "ssn": "SSN detected",
    "credit_card": "Credit card number detected",
    "cvv": "CVV detected",
    "address": "Address field detected",
    "birthdate": "Birthdate detected",
    "ip_address": "IP address detected",
    "jwt": "JWT token detected",
    "uuid": "UUID detected",
    "ci": "CI detected",
    "di": "DI detected",
    "salt": "Salt value detected",
    "name": "Name field detected",
}

# What a matching value must look like before its pattern is worth running.
_VALUE_GUARDS = {
    "email": lambda v: F.contains(v, F.lit("@")),
    "phone": lambda v: (F.length(v) <= 32) & F.substring(v, 1, 1).between("+", "9"),
    "ssn": lambda v: F.length(v).between(9, 11),
    "credit_card": lambda v: F.length(v).between(16, 19),
    "jwt": lambda v: F.startswith(v, F.lit("eyJ")),
    "uuid": lambda v: F.length(v) == 36,
    "ip_address": lambda v: F.length(v).between(7, 39),
}


def hint_order(custom: Sequence[str] = ()) -> list[str]:
    """Every hint a detector with these custom patterns can return, in report order."""
    names = [hint for _, hint in NAME_PATTERNS] + ANCESTOR_NAMES
    names += [custom_hint(p) for p in custom]
    names += [hint for _, hint in VALUE_PATTERNS]
    return list(dict.fromkeys(names))


def custom_hint(pattern: str) -> str:
    stem = pattern[:-2] if pattern.endswith(".*") else pattern
    return stem.split(".")[-1] or pattern


def custom_match(path: Column, pattern: str) -> Column:
    """``p.*``: below the first segment called ``p``; otherwise the exact path. Any case."""
    if not pattern.endswith(".*"):
        return F.lower(path) == pattern.lower()
    prefix = pattern[:-2].lower()
    segments = F.transform(F.split(F.lower(path), r"\."), lambda s: F.regexp_replace(s, r"\[\*\]\z", ""))
    found = F.array_position(segments, prefix)
    return (found > 0) & (found < F.size(segments))


def _ancestor_match(path: Column, name: str) -> Column:
    return F.lower(path).rlike(rf"(?:\A|\.){name}(?:\.|\z)")


def _bits(matches: list[tuple[Column, str]], custom: Sequence[str]) -> Column:
    """OR the bits of all hints whose condition holds."""
    position = {hint: i for i, hint in enumerate(hint_order(custom))}
    by_hint: dict[str, Column] = {}
    for condition, hint in matches:
        by_hint[hint] = by_hint[hint] | condition if hint in by_hint else condition
    mask = F.lit(0).cast("bigint")
    for hint, condition in by_hint.items():
        mask = mask + F.when(condition, F.lit(1 << position[hint]).cast("bigint")).otherwise(F.lit(0).cast("bigint"))
    return mask


def path_hint_mask(path: Column, custom: Sequence[str] = ()) -> Column:
    """Hints that follow from the path alone. Meant for tables of distinct paths."""
    name = last_segment(path)
    matches = [(name.rlike(f"(?i){pattern}"), hint) for pattern, hint in NAME_PATTERNS]
    matches += [(_ancestor_match(path, n), n) for n in ANCESTOR_NAMES]
    matches += [(custom_match(path, p), custom_hint(p)) for p in custom]
    return _bits(matches, custom)


def value_hint_mask(value: Column, custom: Sequence[str] = ()) -> Column:
    """Hints that follow from a string value (NULL for other types gives 0)."""
    matches = [
        (F.coalesce(_VALUE_GUARDS[hint](value) & value.rlike(rf"\A(?:{pattern})\z"), F.lit(False)), hint)
        for pattern, hint in VALUE_PATTERNS
    ]
    return _bits(matches, custom)


def _name_alternatives(wanted: Sequence[str] | None = None) -> str:
    kept = [p for p, hint in NAME_PATTERNS if wanted is None or hint in wanted]
    return "(?i)" + "|".join(kept)


def is_pii_field(path: Column, custom: Sequence[str] = ()) -> Column:
    """Path-only predicate: one combined pattern, cheap enough for every row."""
    found = last_segment(path).rlike(_name_alternatives())
    for name in ANCESTOR_NAMES:
        found = found | (F.contains(F.lower(path), F.lit(name)) & _ancestor_match(path, name))
    for pattern in custom:
        found = found | custom_match(path, pattern)
    return found


def name_suggests(path: Column, hint: str) -> Column:
    return last_segment(path).rlike(_name_alternatives([hint]))


def has_hint(mask: Column, hint: str, custom: Sequence[str] = ()) -> Column:
    return mask.bitwiseAND(F.lit(1 << hint_order(custom).index(hint)).cast("bigint")) != 0


def detect_mask(path: Column, value: Column, custom: Sequence[str] = ()) -> Column:
    return path_hint_mask(path, custom).bitwiseOR(value_hint_mask(value, custom))


def hints_of(mask: Column, custom: Sequence[str] = ()) -> Column:
    """Spell a mask out as an array of hint names, in report order. The mask is evaluated once."""

    def spelled(m: Column) -> Column:
        return F.array_compact(F.array(*[F.when(has_hint(m, h, custom), F.lit(h)) for h in hint_order(custom)]))

    return F.element_at(F.transform(F.array(mask), spelled), 1)


def detect_pii(path: Column, value: Column, custom: Sequence[str] = ()) -> Column:
    return hints_of(detect_mask(path, value, custom), custom)


def has_pii(path: Column, value: Column, custom: Sequence[str] = ()) -> Column:
    return is_pii_field(path, custom) | (value_hint_mask(value, custom) != 0)


def pii_warning(hints: Column) -> Column:
    sentences = F.create_map(*[F.lit(x) for pair in WARNINGS.items() for x in pair])
    spelled = F.transform(
        hints, lambda h: F.coalesce(F.try_element_at(sentences, h), F.concat(F.lit("PII: "), h))
    )
    return F.when(F.size(hints) > 0, F.array_join(spelled, ", "))
