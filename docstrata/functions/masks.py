"""Masking of single values as Column expressions."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docstrata.functions import pii
from docstrata.options import ProfileOptions

# Longest run of stars, most characters shown per side, share shown per side.
MAX_STARS = 10
MAX_SHOWN = 3
SHOWN_SHARE = 4


def _stars(n: Column) -> Column:
    return F.repeat(F.lit("*"), n.cast("int"))


def _first(text: Column, n: Column | int) -> Column:
    return F.left(text, F.lit(n) if isinstance(n, int) else n)


def _last(text: Column, n: Column | int) -> Column:
    return F.right(text, F.lit(n) if isinstance(n, int) else n)


def _bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate `value` once and use it in `body`."""
    return F.element_at(F.transform(F.array(value), body), 1)


def mask_string(text: Column, mode: str = "balanced") -> Column:
    return _bind(text, lambda t: _mask_string(t, mode))


def _mask_string(text: Column, mode: str) -> Column:
    size = F.length(text)
    hidden = F.when(size <= 2, _stars(size))
    if mode == "strict":
        return hidden.otherwise(F.concat(_first(text, 1), _stars(F.least(size - 1, F.lit(MAX_STARS)))))
    shown = F.least(F.lit(MAX_SHOWN), F.floor(size / SHOWN_SHARE).cast("int"))
    return (
        hidden.when(size <= SHOWN_SHARE, F.concat(_first(text, 1), _stars(size - 2), _last(text, 1)))
        .otherwise(
            F.concat(
                _first(text, shown), _stars(F.least(size - shown * 2, F.lit(MAX_STARS))), _last(text, shown)
            )
        )
    )


def mask_email(text: Column) -> Column:
    def masked(parts: Column) -> Column:
        local, domain = F.get(parts, F.lit(0)), F.coalesce(F.get(parts, F.lit(1)), F.lit(""))
        local_out = F.when(F.length(local) > 1, F.concat(_first(local, 1), F.lit("***"))).otherwise(F.lit("*"))
        domain_out = F.when(
            F.contains(domain, F.lit(".")),
            F.concat(
                _first(F.substring_index(domain, ".", 1), 1), F.lit("***."), F.substring_index(domain, ".", -1)
            ),
        ).otherwise(mask_string(domain))
        return F.when(domain == "", mask_string(F.array_join(parts, "@"))).otherwise(
            F.concat(local_out, F.lit("@"), domain_out)
        )

    return _bind(F.split(text, "@"), masked)


def mask_phone(text: Column, mask_short: bool = False) -> Column:
    shortest = 5 if mask_short else 4

    def masked(digits: Column) -> Column:
        return F.when(F.length(digits) < shortest, _stars(F.length(text))).otherwise(
            F.concat(_stars(F.length(digits) - 4), _last(digits, 4))
        )

    return _bind(F.regexp_replace(text, "[^0-9]", ""), masked)


def mask_number(text: Column, mask_short: bool = False) -> Column:
    """Masks the printed number: first and last character stay."""
    size = F.length(text)
    short = _stars(size) if mask_short else text
    return F.when(size <= 2, short).otherwise(F.concat(_first(text, 1), _stars(size - 2), _last(text, 1)))


# Tags whose text is shown as it is, and the names shown for opaque values.
_VERBATIM = ("null", "undefined", "boolean")
_NUMBERS = ("int", "long", "double")
_OPAQUE = {
    "decimal": "[Decimal128]",
    "regex": "[BSONRegExp]",
    "timestamp": "[Timestamp]",
    "binData": "[Binary]",
    "minKey": "[MinKey]",
    "maxKey": "[MaxKey]",
}


def mask_value(
    type_: Column,
    text: Column,
    size: Column,
    email: Column,
    phone: Column,
    mode: str = "balanced",
    mask_short: bool = False,
) -> Column:
    """Mask by type tag; on strings an e-mail hint wins over a phone hint, then the plain mask."""
    out = (
        F.when(type_ == "string", F.when(email, mask_email(text)).when(phone, mask_phone(text, mask_short))
               .otherwise(mask_string(text, mode)))
        .when(type_.isin(*_NUMBERS), mask_number(text, mask_short))
        .when(type_.isin(*_VERBATIM), text)
        .when(type_ == "date", F.regexp_replace(text, "[0-9]", "*"))
        .when(type_ == "array", text)
        .when(type_ == "objectId", mask_string(text, mode))
        .when(type_ == "object", F.concat(F.lit("{Object("), size.cast("string"), F.lit(" keys)}")))
    )
    for tag, shown in _OPAQUE.items():
        out = out.when(type_ == tag, F.lit(shown))
    return out.otherwise(F.lit("[Unknown]"))


def should_mask(policy: str, hit: Column) -> Column:
    return {"all": F.lit(True), "pii": hit, "off": F.lit(False)}[policy]


def render_example(
    path: Column,
    type_: Column,
    text: Column,
    size: Column,
    value_mask: Column,
    policy: str = "pii",
    mode: str = "balanced",
    custom: Sequence[str] = (),
    mask_short: bool = False,
) -> Column:
    """The text shown for a value under a policy; `value_mask` holds its value-pattern hints."""
    if policy == "off":
        return text
    email = pii.name_suggests(path, "email") | pii.has_hint(value_mask, "email", custom)
    phone = pii.name_suggests(path, "phone") | pii.has_hint(value_mask, "phone", custom)
    masked = mask_value(type_, text, size, email, phone, mode, mask_short)
    hit = pii.is_pii_field(path, custom) | (value_mask != 0)
    return F.when(should_mask(policy, hit), masked).otherwise(text)


def mask_table(df: DataFrame, options: ProfileOptions = ProfileOptions()) -> DataFrame:
    """Mask every string leaf of a table under the policy; other types and the schema stay as they are.

    Nested structs, arrays and maps are rebuilt in place; a leaf's path names its struct fields.
    """
    columns = [
        _mask_leaf(F.col(f"`{f.name}`"), f.dataType, escape_name(f.name), options).alias(f.name) for f in df.schema.fields
    ]
    return df.select(*columns)


def escape_name(name: str) -> str:
    return name.replace("\\", "\\\\").replace(".", "\\.").replace("$", "\\$")


def _mask_leaf(value: Column, kind: T.DataType, path: str, options: ProfileOptions) -> Column:
    if isinstance(kind, T.StringType):
        at = F.lit(path)
        mask = pii.value_hint_mask(value, options.pii_patterns)
        shown = render_example(
            at, F.lit("string"), value, F.lit(0), mask, options.redact, options.redact_mode,
            options.pii_patterns, options.mask_short,
        )
        return F.when(value.isNotNull(), shown)
    if isinstance(kind, T.StructType):
        parts = [_mask_leaf(value[f.name], f.dataType, f"{path}.{escape_name(f.name)}", options).alias(f.name) for f in kind]
        return F.when(value.isNotNull(), F.struct(*parts))
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda x: _mask_leaf(x, kind.elementType, f"{path}.[*]", options))
    if isinstance(kind, T.MapType):
        return F.transform_values(value, lambda k, x: _mask_leaf(x, kind.valueType, path, options))
    return value
