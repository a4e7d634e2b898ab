"""Path rows of typed tables, planned from the schema.

A table whose columns have types needs no look at its values to know its paths: every row has the same ones, but for nulls,
array lengths and map keys. The schema is turned into one `inline` over an array of row structs, nested arrays and maps into
`transform` inside it. There is no VARIANT, no probe of the depth and no chain of levels; only the columns that the wanted
fields are made of are read from the source. Results equal those of `flatten_documents(documents_from_table(...))`.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docstrata.functions.paths import TRUNCATED, WILDCARD
from docstrata.operators.flatten import _ISO, CUT, EXTENDED_TAGS, ORDER_BITS, VALUE, _index_bits, _key_segment, _placed, flatten_documents, js_number_text
from docstrata.options import ProfileOptions
from docstrata.sources.readers import document_id, documents_from_table

_INTEGERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
_INDEX = re.compile(r"\[[0-9]+\]")
_SHOWN_NAMES = 3
#: What a row of `flatten_documents` holds beside its document.
OUTPUTS = ("path", "pos", "depth", "type", "text", "size", "num", "kind", "solo")


def is_static(schema: T.StructType, options: ProfileOptions = ProfileOptions()) -> bool:
    """Can rows of this schema be planned? Not with VARIANT values, Extended JSON tags or a budget of keys."""

    def fits(kind: T.DataType) -> bool:
        if isinstance(kind, T.StructType):
            tagged = len(kind.fields) == 1 and kind.fields[0].name in EXTENDED_TAGS
            return not tagged and all(fits(f.dataType) for f in kind.fields)
        if isinstance(kind, T.ArrayType):
            return fits(kind.elementType)
        if isinstance(kind, T.MapType):
            # keys that are tags are known with the values only
            return False
        return isinstance(kind, (*_INTEGERS, T.StringType, T.BooleanType, T.FloatType, T.DoubleType, T.DecimalType, T.DateType, T.TimestampType, T.TimestampNTZType, T.BinaryType, T.NullType))

    return options.max_keys_per_doc is None and fits(schema)


def _literal(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


class _Planner:
    def __init__(self, options: ProfileOptions, outputs: Sequence[str]):
        self.options, self.outputs, self.names = options, outputs, 0

    def row(self, **columns: str) -> str:
        return "named_struct(" + ", ".join(f"'{c}', {columns[c]}" for c in self.outputs) + ")"

    def scalar(self, x: str, kind: T.DataType) -> tuple[str, str, str]:
        """SQL: type tag, text and number of a value that is not null."""
        none = "cast(null as double)"
        if isinstance(kind, _INTEGERS):
            tag = "'int'" if not isinstance(kind, T.LongType) else f"if({x} between -2147483648 and 2147483647, 'int', 'long')"
            return tag, f"cast({x} as string)", f"cast({x} as double)"
        if isinstance(kind, (T.FloatType, T.DoubleType, T.DecimalType)):
            d = f"cast({x} as double)"
            whole = f"not isnan({d}) and abs({d}) <> double('infinity') and rint({d}) = {d}"
            tag = f"if({whole}, if({d} between -2147483648 and 2147483647, 'int', 'long'), 'double')"
            if isinstance(kind, T.DecimalType):
                # a VARIANT prints decimals without trailing zeros
                text = f"regexp_replace(regexp_replace(cast({x} as string), '(\\\\.[0-9]*?)0+$', '$1'), '\\\\.$', '')"
                return ("'decimal'" if self.options.typed_decimals else tag), text, d
            return tag, js_number_text(d), f"if(isnan({d}), null, {d})"
        if isinstance(kind, T.BooleanType):
            return "'boolean'", f"cast({x} as string)", none
        if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
            return "'date'", f"date_format({x}, '{_ISO}')", none
        if isinstance(kind, T.BinaryType):
            return "'binData'", f"lower(hex({x}))", none
        return "'string'", f"cast({x} as string)", none

    def rows(self, x: str, kind: T.DataType, path: str, depth: int, pos: str, room: str, solo: str, element: bool) -> str:
        """SQL: array of the rows of a value and of all below it. `element`: it stands in an array."""
        o = self.options
        holds = isinstance(kind, (T.StructType, T.ArrayType))
        place = {"pos": pos, "depth": str(depth), "solo": solo}
        value, cut = {**place, "path": path, "kind": str(VALUE)}, {**place, "path": f"concat({path}, '.{TRUNCATED}')", "kind": str(CUT)}
        null = {"type": "'null'", "text": "'null'", "size": "0", "num": "cast(null as double)"}
        if o.max_depth is not None and depth > o.max_depth:
            if not element:
                return f"array({self.row(**cut, **null)})"
            if holds:
                return f"array(if({x} is null, {self.row(**value, **null)}, {self.row(**cut, **null)}))"
        if not holds:
            tag, text, num = self.scalar(x, kind)
            own = self.row(
                **value, type=f"if({x} is null, 'null', {tag})", text=f"if({x} is null, 'null', {text})", size="0", num=num
            )
            return f"array({own})"
        if isinstance(kind, T.ArrayType):
            text = f"concat('[Array(', size({x}), ')]')"
            own = self.row(**value, type="'array'", text=text, size=f"size({x})", num=null["num"])
            self.names += 1
            e, i, r = (f"{letter}{self.names}" for letter in "eir")
            inside = self.rows(
                e, kind.elementType, f"concat({path}, '.{WILDCARD}')", depth + 1, f"{r}.pos", f"{r}.room",
                f"({solo} and size({x}) < 2)", element=True,
            )
            shown = x if o.max_array_sample is None else f"slice({x}, 1, {o.max_array_sample})"
            # the place of an element depends on `pos` and `room`, by which name `_placed` reads them
            before = f"named_struct('pos', {pos}, 'room', {room})"
            placed = _placed(i).replace("room", "q.room").replace("pos", "q.pos")
            moved = f"transform(array({before}), q -> named_struct('pos', {placed}, 'room', greatest(q.room - {_index_bits(i)}, 0)))[0]"
            below = f"flatten(transform({shown}, ({e}, {i}) -> flatten(transform(array({moved}), {r} -> {inside}))))"
        else:
            names = sorted((f.name for f in kind.fields), key=lambda n: n.encode())
            text = ", ".join(names[:_SHOWN_NAMES]) + ("..." if len(names) > _SHOWN_NAMES else "")
            own = self.row(**value, type="'object'", text=_literal("{" + text + "}"), size=str(len(names)), num=null["num"])
            below = self.members(x, kind, path, depth, pos, room, solo)
        return f"if({x} is null, array({self.row(**value, **null)}), concat(array({own}), {below}))"

    def members(self, x: str | None, kind: T.StructType, path: str, depth: int, pos: str, room: str, solo: str) -> str:
        """SQL: rows of a struct's members; those of the table itself for `x` None."""
        parts, plain = [], []
        for field in kind.fields:
            name = field.name
            column = f"`{name.replace('`', '``')}`"
            at = column if x is None else f"{x}.{column}"
            segment = _literal(WILDCARD) if _INDEX.fullmatch(name) else _key_segment(_literal(name))
            if name == "":
                below = path
            else:
                below = segment if path == "''" else f"concat({path}, '.', {segment})"
            single = name != "" and not _INDEX.fullmatch(name) and not (isinstance(field.dataType, T.StructType) and any(f.name == "" for f in field.dataType.fields))
            rows = self.rows(at, field.dataType, below, depth + 1, pos, room, solo if single else "false", element=False)
            plain.append(rows[len("array(") : -1]) if rows.startswith("array(") else parts.append(rows)
        if plain:
            parts.insert(0, f"array({', '.join(plain)})")
        return f"concat({', '.join(parts)})" if parts else "array()"


def _wanted(schema: T.StructType, fields: Sequence[str] | None) -> T.StructType:
    """The part of a schema that the wanted fields, and all below them, are made of."""
    if fields is None:
        return schema

    def prune(kind: T.StructType, prefix: str) -> Iterator[T.StructField]:
        for field in kind.fields:
            path = f"{prefix}{field.name}"
            if any(w == path or path.startswith(f"{w}.") for w in fields):
                yield field
            elif any(w.startswith(f"{path}.") for w in fields):
                inside = field.dataType
                kept = T.StructType(list(prune(inside, f"{path}."))) if isinstance(inside, T.StructType) else inside
                yield T.StructField(field.name, kept, field.nullable)

    return T.StructType(list(prune(schema, "")))


def flatten_table(
    df: DataFrame,
    collection: str,
    doc_id: str,
    options: ProfileOptions = ProfileOptions(),
    fields: Sequence[str] | None = None,
    outputs: Sequence[str] = OUTPUTS,
) -> DataFrame:
    """The rows of `flatten_documents` for a typed table.

    `fields` names columns, or members by their dotted path, that rows are wanted of (and of all below them): a column that
    none needs is not read. `outputs` leaves out what of a row is not needed, for instance the texts. A row whose id is null
    gets one from its place. Schemas that cannot be planned (see `is_static`) go through VARIANT.
    """
    missing = set(outputs) - set(OUTPUTS)
    if missing:
        raise ValueError(f"no such outputs: {sorted(missing)}")
    schema = _wanted(df.schema, fields)
    kept = ["collection", "doc_id", *outputs, "keys_refused", "depth_cut"]
    if not is_static(schema, options):
        columns = [f.name for f in schema.fields]
        kept_columns = df.select(*dict.fromkeys([doc_id, *columns]))
        rows = flatten_documents(documents_from_table(kept_columns, collection, doc_id, columns), options)
        return rows.select(*kept)
    planner = _Planner(options, [*outputs, *({"kind"} - set(outputs))])
    sql = planner.members(None, schema, "''", 0, "0L", str(ORDER_BITS), "true" if "" not in schema.names else "false")
    # ids come first: beside a generator they would be made for each of its rows
    name = "doc_id" + "_" * max(map(len, df.columns))
    named = df.select(document_id(df, doc_id).alias(name), *[F.col(f"`{c}`") for c in schema.names])
    rows = named.select(F.lit(collection).alias("collection"), F.col(name).alias("doc_id"), F.inline(F.expr(sql)))
    return rows.selectExpr("*", "0L as keys_refused", f"cast(kind = {CUT} as int) as depth_cut").select(*kept)


def table_totals(df: DataFrame, collection: str) -> DataFrame:
    """docs(collection, docs) of a typed table: a count that reads no column."""
    return df.agg(F.count(F.lit(1)).alias("docs")).select(F.lit(collection).alias("collection"), "docs")
