"""Free-text redaction and report formatting as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docstrata.functions.pii import SPACES

# What is cut out of free text, in this order. Word boundaries are spelled out
# because only ASCII letters, digits and underscores count as word characters here.
_START, _END = "(?<![0-9A-Za-z_])", "(?![0-9A-Za-z_])"
TEXT_PATTERNS = [
    r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}",
    r"\+?\d{1,4}[-." + SPACES + r"]?\(?\d{1,3}\)?[-." + SPACES + r"]?\d{1,4}[-." + SPACES + r"]?\d{1,9}",
    _START + r"\d{3}[-.]?\d{2}[-.]?\d{4}" + _END,
    _START + r"\d{4}[-" + SPACES + r"]?\d{4}[-" + SPACES + r"]?\d{4}[-" + SPACES + r"]?\d{4}" + _END,
    r"eyJ[a-zA-Z0-9_-]+\.eyJ[a-zA-Z0-9_-]+\.[a-zA-Z0-9_-]+",
]
REDACTED = "[REDACTED]"
PREVIEW_LENGTH = 100
SHOWN_PATHS = 3


def redact_text(text: Column) -> Column:
    for pattern in TEXT_PATTERNS:
        text = F.regexp_replace(text, pattern, REDACTED)
    return text


def redact_uri_credentials(uri: Column) -> Column:
    """Only the first `//user:password@` is hidden."""
    return F.regexp_replace(uri, r"(?s)\A(.*?)//[^:]+:[^@]+@", "$1//***:***@")


def preview_text(text: Column, max_length: int = PREVIEW_LENGTH) -> Column:
    short = F.when(
        F.length(text) > max_length, F.concat(F.left(text, F.lit(max_length - 3)), F.lit("..."))
    ).otherwise(text)
    return F.translate(short, "\n\r", " ")


def percent(ratio: Column) -> Column:
    return F.concat(F.round(ratio * 100).cast("bigint").cast("string"), F.lit("%"))


def format_count(n: Column) -> Column:
    thousands = F.concat(F.lit("~"), F.round(n / 1000).cast("bigint").cast("string"), F.lit("K"))
    return F.when(n >= 1000, thousands).otherwise(F.concat(F.lit("~"), n.cast("string")))


def format_type_ratio(type_list: Column) -> Column:
    """`type_list`: array of struct(type, ratio) in first-seen order."""
    # Negated ratio first and the first-seen position second give "by ratio, first seen on ties".
    ranked = F.array_sort(
        F.transform(
            type_list,
            lambda t, i: F.struct((-t["ratio"]).alias("r"), i.alias("i"), t["type"].alias("t")),
        )
    )
    shown = F.array_join(
        F.transform(ranked, lambda t: F.concat(t["t"], F.lit("("), percent(-t["r"]), F.lit(")"))), ", "
    )
    return (
        F.when(F.size(type_list) == 0, F.lit("-"))
        .when(F.size(type_list) == 1, F.element_at(type_list, 1)["type"])
        .otherwise(shown)
    )


def format_examples(examples: Column) -> Column:
    values = F.transform(F.slice(examples, 1, 3), lambda e: e["value"])
    return F.when(F.coalesce(F.size(examples), F.lit(0)) <= 0, F.lit("-")).otherwise(F.array_join(values, ", "))


def format_notes(mixed: Column, hints: Column, low: Column, high: Column) -> Column:
    notes = F.concat_ws(
        " | ",
        F.when(mixed, F.lit("Mixed")),
        F.when(F.size(hints) > 0, F.concat(F.lit("PII: "), F.array_join(hints, ", "))),
        F.when(low.isNotNull(), F.format_string("min: %.2f, max: %.2f", low, high)),
    )
    return F.when(notes == "", F.lit("-")).otherwise(notes)


def _diff_side(sign: str, paths: Column, count_rest: bool) -> Column:
    rest = (
        F.concat(F.lit("... (+"), (F.size(paths) - SHOWN_PATHS).cast("string"), F.lit(" more)"))
        if count_rest
        else F.lit("...")
    )
    return F.when(
        F.size(paths) > 0,
        F.concat(
            F.lit(sign),
            F.array_join(F.slice(paths, 1, SHOWN_PATHS), ", "),
            F.when(F.size(paths) > SHOWN_PATHS, rest).otherwise(F.lit("")),
        ),
    )


def format_diff(added: Column, missing: Column, count_rest: bool = True) -> Column:
    text = F.concat_ws(", ", _diff_side("+", added, count_rest), _diff_side("-", missing, count_rest))
    return F.when(text == "", F.lit("-")).otherwise(text)


def compose_summary(purpose: Column, structure: Column, notes: Column) -> Column:
    return F.concat_ws(" ", purpose, structure, F.when(notes != "", notes))


def extract_json_block(text: Column) -> Column:
    """First `{` to last `}`, as a VARIANT; NULL when there is none or it does not parse."""
    block = F.regexp_substr(text, F.lit(r"(?s)\{.*\}"))
    return F.try_parse_json(block)
