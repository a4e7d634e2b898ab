"""Flattening documents into typed path rows.

Documents are expanded in place by a chain of `variant_explode` steps, one per
nesting level: each step replaces an open container by itself plus its direct
children. The chain is narrow (no shuffle), and unused output columns are pruned
through it. Documents that nest deeper than `PLAIN_LEVELS` take a longer chain of
their own, with the same result. Only a key budget makes the rows of a document
that may exceed it be ranked in pre-order.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docstrata.functions.paths import TRUNCATED, WILDCARD, normalize_path
from docstrata.options import ProfileOptions
from docstrata.session import cut_lineage

VALUE, MARKER, CUT = 0, 1, 2

# Documents that nest deeper are expanded apart, so that the plan of all others stays short.
PLAIN_LEVELS = 7
# At most so many collections with documents of several kinds are named in a filter.
SPLIT_COLLECTIONS = 100
# Bits of `pos`. An array index takes 4, 12, 28 or 60 of them, by its size.
ORDER_BITS = 60
# Levels analysed together; more would exceed the analyzer's iteration limit.
LEVELS_PER_STATEMENT = 4
# Printed documents in which a key may hold more than ASCII letters, digits and underscores; values may match too.
_ODD_KEY = r'\\|""\s*:|[^A-Za-z0-9_"][A-Za-z0-9_]*"\s*:'

# Extended JSON keys that turn an object into one typed value.
EXTENDED_TAGS = {
    "$oid": "objectId",
    "$date": "date",
    "$numberDecimal": "decimal",
    "$numberLong": "long",
    "$numberInt": "int",
    "$numberDouble": "double",
    "$binary": "binData",
    "$timestamp": "timestamp",
    "$regularExpression": "regex",
    "$minKey": "minKey",
    "$maxKey": "maxKey",
    "$undefined": "undefined",
}

_ISO = r"yyyy-MM-dd\'T\'HH:mm:ss.SSS\'Z\'"


def js_number_text(d: str) -> str:
    """SQL text of a double as a script language prints it.

    No `.0`, plain digits from 1e-6 to below 1e21, otherwise an exponent with its sign; every digit is kept.
    """
    shown, digits, power = (
        rf"regexp_replace(regexp_extract(t, '([0-9.]+)E', 1), '\\.0$', '')",
        rf"replace(regexp_replace(regexp_extract(t, '([0-9.]+)E', 1), '\\.0$', ''), '.', '')",
        "cast(regexp_extract(t, 'E(-?[0-9]+)', 1) as int)",
    )
    sign = f"if({d} < 0, '-', '')"
    plain = (
        f"if({power} < 0, concat('0.', repeat('0', -{power} - 1), {digits}), "
        f"if(length({digits}) <= {power} + 1, rpad({digits}, {power} + 1, '0'), "
        f"concat(left({digits}, {power} + 1), '.', substr({digits}, {power} + 2))))"
    )
    powered = f"concat({shown}, 'e', if({power} > 0, '+', ''), {power})"
    long = f"concat({sign}, if(abs({d}) >= 1e-6 and abs({d}) < 1e21, {plain}, {powered}))"
    return (
        f"case when isnan({d}) then 'NaN' "
        f"when rint({d}) = {d} and abs({d}) < 9e15 then cast(cast({d} as bigint) as string) "
        f"when abs({d}) >= 1e-3 and abs({d}) < 1e7 or abs({d}) = double('infinity') then cast({d} as string) "
        f"else transform(array(cast({d} as string)), t -> {long})[0] end"
    )


def _get(v: str, type_: str, at: str = "$") -> str:
    return f"try_variant_get({v}, '{at}', '{type_}')"


def _is_wrapper(s: str) -> str:
    """SQL: does this schema text describe an Extended JSON value, i.e. one known key alone?"""
    keys = "|".join(k[1:] for k in EXTENDED_TAGS)
    shape = rf"\\AOBJECT<`\\$(?:{keys})`: (?:[A-Z0-9_(),]+|OBJECT<[^<>]*>)>\\z"
    return f"(startswith({s}, 'OBJECT<`$') and {s} rlike '{shape}')"


def _extended_key(s: str) -> str:
    """SQL: the wrapper key of an Extended JSON value, NULL for any other value."""
    return f"if({_is_wrapper(s)}, regexp_extract({s}, '`([^`]*)`', 1), null)"


def _as_long(v: str, s: str) -> str:
    return f"if({s} = 'BIGINT', {_get(v, 'bigint')}, null)"


def _as_double(v: str, s: str) -> str:
    return f"if(startswith({s}, 'DECIMAL') or {s} in ('DOUBLE', 'FLOAT'), {_get(v, 'double')}, null)"


def _tag_case(s: str, b: str, d: str, extended_key: str, typed_decimals: bool) -> str:
    """SQL: type tag from the schema text and the value read as long, double and wrapper key."""
    cases = " ".join(f"when '{k}' then '{t}'" for k, t in EXTENDED_TAGS.items())
    whole = f"not isnan({d}) and abs({d}) <> double('infinity') and rint({d}) = {d}"
    decimal = f"when startswith({s}, 'DECIMAL') then 'decimal' " if typed_decimals else ""
    return (
        f"case when {s} = 'STRING' then 'string' "
        f"when {s} = 'BIGINT' then if({b} between -2147483648 and 2147483647, 'int', 'long') "
        f"when startswith({s}, 'OBJECT') then if({extended_key} is null, 'object', case {extended_key} {cases} end) "
        f"when startswith({s}, 'ARRAY') then 'array' "
        f"when {s} = 'VOID' then 'null' "
        f"when {s} = 'BOOLEAN' then 'boolean' {decimal}"
        f"when {d} is not null then if({whole}, if({d} between -2147483648 and 2147483647, 'int', 'long'), 'double') "
        f"when {s} = 'DATE' or startswith({s}, 'TIMESTAMP') then 'date' "
        f"when {s} = 'BINARY' then 'binData' else 'undefined' end"
    )


def type_tag(v: str, s: str, options: ProfileOptions, extended_json: bool = True) -> str:
    """SQL: type tag of the VARIANT `v` whose `schema_of_variant` text is `s`."""
    key = _extended_key(s) if extended_json else "cast(null as string)"
    return _tag_case(s, _as_long(v, s), _as_double(v, s), key, options.typed_decimals)


def _extended_text(v: str, key: str) -> str:
    value = f"element_at(map_values({_get(v, 'map<string,variant>')}), 1)"
    raw = _get(value, "string")
    millis = f"coalesce(cast({_get(value, 'string', '$.$numberLong')} as bigint), {_get(value, 'bigint')})"
    when = f"coalesce(try_cast({raw} as timestamp), timestamp_millis({millis}))"
    return (
        f"case {key} when '$date' then date_format({when}, '{_ISO}') "
        f"when '$binary' then lower(hex(unbase64({_get(value, 'string', '$.base64')}))) "
        f"when '$undefined' then 'undefined' else {raw} end"
    )


def _key_segment(key: str) -> str:
    return f"replace(replace(replace({key}, '\\\\', '\\\\\\\\'), '.', '\\\\.'), '$', '\\\\$')"


def value_type(v: str, options: ProfileOptions = ProfileOptions(), extended_json: bool = True) -> Column:
    """Type tag of the VARIANT column (or SQL expression) `v`."""
    return F.expr(type_tag(v, f"schema_of_variant({v})", options, extended_json))


def _index_bits(index: str) -> str:
    return f"case when {index} < 15 then 4 when {index} < 270 then 12 when {index} < 65805 then 28 else 60 end"


def _placed(index: str) -> str:
    """SQL: `pos` with an array index behind those before it, in an order-preserving code of growing width.

    An index that no longer fits leaves `pos` as it is.
    """
    code = (
        f"case when {index} < 15 then bigint({index}) when {index} < 270 then 3840L + ({index} - 15) "
        f"when {index} < 65805 then 268369920L + ({index} - 270) else 1152921500311879680L + ({index} - 65805) end"
    )
    return f"if(room >= {_index_bits(index)}, pos + shiftleft({code}, room - {_index_bits(index)}), pos)"


class _Chain:
    """Builds the expansion chain for one set of options, as one SQL statement.

    A level's rows carry the VARIANT itself and its schema text; type tag, printed form and
    size are derived once, after the last level.
    """

    def __init__(
        self, options: ProfileOptions, raw_paths: bool, extended_json: bool, ranked: bool, markers: bool,
        plain_keys: bool = False, leaves: bool = True, arrays_only: bool = False,
    ):
        self.options = options
        self.raw_paths = raw_paths
        # Wrapper keys begin with a dollar sign.
        self.extended = extended_json and not plain_keys
        self.ranked = ranked
        self.markers = markers
        self.plain_keys = plain_keys
        self.leaves = leaves or ranked
        self.arrays_only = arrays_only

    def has_empty_key(self, schema: str) -> str:
        if self.plain_keys:
            return "false"
        # Keys print sorted, so an empty key comes first.
        return f"coalesce(startswith({schema}, 'OBJECT<``:'), false)"

    def root(self) -> str:
        """One open root per document, without a row of its own."""
        return (
            "select collection, doc_id, '' as path, 0 as depth, "
            f"{VALUE} as kind, 0L as pos, {ORDER_BITS} as room, not {self.has_empty_key('schema_of_variant(v)')} as solo, "
            "cast(array() as array<int>) as ord, 'OBJECT' as s, '' as tag, v as w, true as open from {documents}"
        )

    def level(self, before: str, depth: int) -> str:
        """Open containers become themselves (step 0), their children (1) and element tags (2..)."""
        o = self.options
        itself, children = "named_struct('step', 0, 'tag', tag)", "named_struct('step', 1, 'tag', '')"
        steps = f"array({children})" if depth == 1 else f"array({itself}, {children})"
        if self.markers and depth > 1:
            elements = _get("w", "array<variant>")
            if o.max_array_sample is not None:
                elements = f"slice({elements}, 1, {o.max_array_sample})"
            tags = f"transform({elements}, x -> {type_tag('x', 'schema_of_variant(x)', o, self.extended)})"
            marks = f"transform(array_distinct({tags}), (t, i) -> named_struct('step', 2 + i, 'tag', t))"
            steps = f"if(startswith(s, 'ARRAY'), concat({steps}, {marks}), {steps})"
        split = (
            f"select * except (tag), inline(if(open, {steps}, array({itself}))) as (step, tag) from {before}"
        )
        sampled = "" if o.max_array_sample is None else f" and (e.key is not null or e.pos < {o.max_array_sample})"
        opened = (
            "select p.*, e.pos as at, e.key, e.value, if(p.step = 1, schema_of_variant(e.value), p.s) as es, "
            "try_variant_get(p.w, '$[1]', 'variant') is null as single "
            f"from ({split}) p, lateral variant_explode_outer(if(p.step = 1, p.w, null)) as e "
            f"where p.step <> 1 or (e.pos is not null{sampled})"
        )
        index = "concat('[', at, ']')" if self.raw_paths else f"'{WILDCARD}'"
        index_like = "(startswith(key, '[') and key rlike '^\\\\[[0-9]+\\\\]\\\\z')"
        named = _key_segment("key") if self.raw_paths else f"if({index_like}, '{WILDCARD}', {_key_segment('key')})"
        if self.plain_keys:
            index_like, named = "false", "key"
        segment = f"if(key is null, {index}, {named})"
        empty = "" if self.plain_keys else "when key = '' then path "
        child_path = f"case {empty}when path = '' then {segment} else concat(path, '.', {segment}) end"
        marker_path = f"if(path = '', '{WILDCARD}', concat(path, '.{WILDCARD}'))"
        is_open = "(startswith(es, 'OBJECT') or startswith(es, 'ARRAY'))"
        if self.extended:
            is_open = f"({is_open} and not {_is_wrapper('es')})"
        kind = str(VALUE)
        kept = "left(es, 1) in ('O', 'A')"
        if o.max_depth is not None and depth > o.max_depth:
            # Array elements are depth-checked only when they are plain containers.
            cut = f"(key is not null or {is_open})"
            child_path = f"if({cut}, concat({child_path}, '.{TRUNCATED}'), {child_path})"
            kind, kept, is_open = f"if({cut}, {CUT}, {VALUE})", cut, "false"
        child_solo = (
            f"solo and if(key is null, single, key <> '' and not {index_like}) and not {self.has_empty_key('es')}"
        )
        if self.plain_keys:
            child_solo = "solo and (key is not null or single)"

        def pick(keep: str, child: str, marker: str) -> str:
            if self.markers and depth > 1:
                return f"case step when 0 then {keep} when 1 then {child} else {marker} end"
            return f"if(step = 0, {keep}, {child})"

        columns = {
            "path": pick("path", child_path, marker_path),
            "depth": pick("depth", str(depth), str(depth)),
            "kind": pick("kind", kind, str(MARKER)),
            "pos": pick("pos", f"if(key is null, {_placed('at')}, pos)", _placed("step")),
            "room": pick("room", f"if(key is null, greatest(room - {_index_bits('at')}, 0), room)", "0"),
            "solo": pick("solo", child_solo, "false"),
            "ord": pick("ord", "concat(ord, array(at))", "concat(ord, array(1000000 + step))") if self.ranked else "ord",
            "s": "es",
            "tag": "tag",
            "w": pick("w", "value", "null"),
            "open": f"step = 1 and {is_open}",
        }
        listed = ", ".join(f"{sql} as {name}" for name, sql in columns.items())
        wanted = "" if self.leaves else f" where step <> 1 or {kept}"
        rows = f"select collection, doc_id, {listed} from ({opened}){wanted}"
        # A budget counts all rows, so none is dropped before it.
        return f"select * from ({rows}) where {self.may_hold_array()}" if self.arrays_only and not self.ranked else rows

    def may_hold_array(self) -> str:
        """SQL: is a row, or can a row below it be, an array or inside one? The schema text is read once at most."""
        # Element types that an array's schema text hides are inside that array.
        return "(contains(path, '[') or " + ("contains(s, 'ARRAY'))" if self.plain_keys else "s rlike 'ARRAY|\\\\[')")

    def described(self, state: DataFrame) -> DataFrame:
        """Type tag, printed form and size; the values they share are read once, one step earlier."""
        if self.arrays_only and not self.ranked:
            # The type tag would tell it too, but a filter on that takes the schema text apart many times for each row.
            state = state.where(_in_array("startswith(s, 'ARRAY')", self.raw_paths))
        key = _extended_key("s") if self.extended else "cast(null as string)"
        named = f"startswith(s, 'OBJECT') and kind = {VALUE}"
        read = state.selectExpr(
            "*",
            f"{_as_long('w', 's')} as b",
            f"{_as_double('w', 's')} as d",
            f"{key} as x",
            f"if({named}, map_keys({_get('w', 'map<string,variant>')}), null) as names",
            f"if(startswith(s, 'ARRAY') and kind = {VALUE}, size({_get('w', 'array<variant>')}), null) as n",
        )
        other = read.selectExpr(
            "*",
            "case when x is not null then " + _extended_text("w", "x") + " "
            "when d is not null and s in ('DOUBLE', 'FLOAT') then " + js_number_text("d") + " "
            "when s = 'DATE' or startswith(s, 'TIMESTAMP') then "
            f"date_format({_get('w', 'timestamp')}, '{_ISO}') "
            f"when s = 'BINARY' then lower(hex({_get('w', 'binary')})) end as rare",
        )
        tag = _tag_case("s", "b", "d", "x", self.options.typed_decimals)
        shown = "concat('{', array_join(slice(names, 1, 3), ', '), if(size(names) > 3, '...', ''), '}')"
        return other.selectExpr(
            "collection", "doc_id", "path", "depth", "kind", "pos", "solo", "ord",
            f"case kind when {VALUE} then {tag} when {MARKER} then tag else 'null' end as type",
            f"case when kind = {MARKER} then concat('[', tag, ']') when kind = {CUT} or s = 'VOID' then 'null' "
            f"when s = 'STRING' then {_get('w', 'string')} when s = 'BIGINT' then cast(b as string) "
            f"when rare is not null then rare when names is not null then {shown} "
            f"when n is not null then concat('[Array(', n, ')]') else {_get('w', 'string')} end as text",
            "coalesce(n, if(x is null, size(names), 0), 0) as size",
            f"case when kind <> {VALUE} then null when x like '$number%' then try_cast(rare as double) "
            "when d is not null then if(isnan(d), null, d) else cast(b as double) end as num",
            f"if(kind = {VALUE} and s = 'STRING', {_get('w', 'string')}, null) as string",
        )

    def run(self, documents: DataFrame, levels: int) -> DataFrame:
        state = self._sql(documents, [self.root()])
        for start in range(1, levels + 1, LEVELS_PER_STATEMENT):
            stop = min(start + LEVELS_PER_STATEMENT, levels + 1)
            state = self._sql(
                state, [self.level("{documents}" if d == start else f"l{d - start - 1}", d) for d in range(start, stop)]
            )
        return self.described(state)

    @staticmethod
    def _sql(documents: DataFrame, selects: list[str]) -> DataFrame:
        """Run selects over `{documents}`, each one reading the one before as l0, l1, ..."""
        named = ", ".join(f"l{i} as ({select})" for i, select in enumerate(selects))
        statement = f"with {named} select * from l{len(selects) - 1}"
        # Other braces in the statement belong to string literals.
        statement = statement.replace("{", "{{").replace("}", "}}").replace("{{documents}}", "{documents}")
        return documents.sparkSession.sql(statement, documents=documents)


def _in_array(is_array: str, raw_paths: bool) -> str:
    """SQL: is a row an array, or does its path hold an index?"""
    index = "path rlike '\\\\[[0-9]+\\\\]' or " if raw_paths else ""
    return f"{index}contains(path, '{WILDCARD}') or kind = {VALUE} and {is_array}"


def _let(name: str, value: str, body: str) -> str:
    """SQL: evaluate `value` once and use it as `name` in `body`."""
    return f"transform(array({value}), {name} -> {body})[0]"


# Schema texts that do not tell how deep a document is.
_HIDES_DEPTH = "(contains(s, '`') or contains(s, 'VARIANT'))"
# SQL: the brackets of a schema text.
_BRACKETS = "regexp_replace(s, '[^<>]+', '')"


def _openings(text: str) -> str:
    return f"length({text}) - length(translate({text}, '[{{', ''))"


def _bracket_depth() -> str:
    """SQL: how deep the brackets `n` of a schema text nest; never too few."""
    nested, depth = "n", []
    for _ in range(PLAIN_LEVELS + 1):
        depth.append(f"cast({nested} <> '' as int)")
        nested = f"replace({nested}, '<>', '')"
    return f"if({nested} = '', {' + '.join(depth)}, length(n) div 2)"


def _levels_needed(options: ProfileOptions) -> str:
    """SQL: levels needed to expand document `v`; negative if a key budget may cut it.

    Never too few: the depth is read off the schema text, or, where that hides something (a
    VARIANT element type, quoted keys), bounded by the number of opening brackets.
    """
    exact = _let("n", _BRACKETS, _bracket_depth())
    cap = options.max_keys_per_doc
    # The document is printed only where its text is looked at.
    opens = _openings("cast(x as string)" if cap is None else "t")
    bound = f"if({_HIDES_DEPTH}, {opens}, {exact})"
    # Every row costs a separator or an opening bracket, and brings at most one marker with it.
    rows = "2 * (length(t) - length(translate(t, ',[{', ''))) + 2"
    ranked = "false" if cap is None else f"if(length(t) <= {cap}, false, {rows} > {cap})"
    if options.max_depth is not None:
        bound = f"least({bound}, {options.max_depth + 1})"
    levels = _let("d", f"cast(greatest(1, {bound}) as int)", f"if({ranked}, -d, d)")
    if cap is not None:
        levels = _let("t", "cast(x as string)", levels)
    return _let("x", "v", _let("s", "schema_of_variant(x)", levels))


def classify(documents: DataFrame, options: ProfileOptions = ProfileOptions()) -> DataFrame:
    """Add `levels`: how far each document must be expanded, negative where rows need ranking.

    Negative levels are those of documents that a key budget may cut. Stored with the documents, it saves `flatten_documents` its own look at them.
    """
    return documents.withColumn("levels", F.expr(_levels_needed(options)))


class Look(NamedTuple):
    """What a look at all documents tells about expanding them, under these options or stricter depth and array caps.

    depths: levels of the deepest plain, deep and ranked document, None without any; mixed: collections with deep or ranked
    documents; plain_keys: no key holds more than ASCII letters, digits and underscores, or is empty; totals: documents per
    collection as `document_counts` gives them, if they were asked for.
    """

    options: ProfileOptions
    depths: tuple[int | None, int | None, int | None]
    mixed: list[str]
    plain_keys: bool
    totals: DataFrame | None = None


def look(documents: DataFrame, options: ProfileOptions = ProfileOptions(), counted: bool = False) -> Look:
    """One aggregate over the documents. Those expanded several times need to be looked at once only, without caps.

    With `counted` its rows, one per collection, are checkpointed, so that totals need no look of their own.
    """
    if "levels" in documents.columns or options.max_keys_per_doc is not None:
        seen = documents if "levels" in documents.columns else classify(documents, options)
        docs = F.expr("if(v is null, 0L, 1L)") if counted else F.lit(1)
        seen = seen.select("collection", "levels", F.lit(True).alias("odd"), docs.alias("docs"))
    else:
        # Column by column: within a lambda function all of it, parsing included, would be interpreted row by row.
        seen = documents.selectExpr("collection", "v", "schema_of_variant(v) as s")
        seen = seen.selectExpr("collection", "s", f"if({_HIDES_DEPTH}, cast(v as string), null) as t")
        odd = F.contains("s", F.lit("`")) | F.coalesce(F.col("t").rlike(_ODD_KEY), F.lit(False))
        seen = seen.select("collection", "s", F.expr(_openings("t")).alias("opens"), F.coalesce(odd, F.lit(False)).alias("odd"))
        seen = seen.groupBy("collection", "s", "opens", "odd").agg(F.count("s").alias("docs"))
        bound = f"if(opens is null, {_let('n', _BRACKETS, _bracket_depth())}, opens)"
        if options.max_depth is not None:
            bound = f"least({bound}, {options.max_depth + 1})"
        seen = seen.selectExpr("collection", f"cast(greatest(1, {bound}) as int) as levels", "odd", "docs")
    plain, deep, ranked = _kinds()
    deepest = [F.max(F.when(kind, F.abs("levels"))).alias(name) for name, kind in (("plain", plain), ("deep", deep), ("ranked", ranked))]
    per_collection = seen.groupBy("collection").agg(*deepest, F.max("odd").alias("odd"), F.sum("docs").alias("docs"))
    totals = None
    if counted:
        per_collection = cut_lineage(per_collection)
        totals = per_collection.where("docs > 0").select("collection", "docs")
    special = F.when(F.col("deep").isNotNull() | F.col("ranked").isNotNull(), F.col("collection"))
    # Where counts are asked for, the optimizer keeps the grouping by schema text, which spares all documents the steps after it.
    *depths, mixed, odd, _ = per_collection.agg(
        F.max("plain"), F.max("deep"), F.max("ranked"), F.collect_set(special), F.max("odd"), F.sum("docs")
    ).first()
    return Look(options, tuple(depths), mixed, odd is False, totals)


def _kinds() -> tuple[Column, Column, Column]:
    levels = F.col("levels")
    return levels.between(1, PLAIN_LEVELS), levels > PLAIN_LEVELS, levels < 0


def flatten_documents(
    documents: DataFrame,
    options: ProfileOptions = ProfileOptions(),
    raw_paths: bool = False,
    extended_json: bool = True,
    markers: bool = False,
    leaves: bool = True,
    strings: bool = False,
    arrays_only: bool = False,
    seen: Look | None = None,
) -> DataFrame:
    """documents(collection, doc_id, v VARIANT) -> one row per path occurrence.

    Columns: collection, doc_id, path, pos (orders the occurrences of one path within the
    document), depth, type, text, size, num (numbers other than NaN), kind (0 value, 1
    array-element-type marker, 2 depth cut), solo (no other row of this document can have this
    path), keys_refused, depth_cut; with `strings` also string (text of strings alone, cheaper than text).
    Marker rows are returned only with `markers`, but always count towards the key budget.
    Without `leaves`, rows of values that are no containers may be left out. With `arrays_only`, only arrays and rows whose
    path holds an index or wildcard are returned, and documents are followed no further than these lie.

    One aggregate over the documents (see `look`, or `classify`) fixes how many levels are unrolled, so the
    plan is as long as the deepest ordinary document and no longer. `seen` is its result where it is known.
    """
    if seen is None:
        seen = look(documents, options)
    depths, mixed = seen.depths, seen.mixed
    if options.max_depth is not None:
        depths = [None if d is None else min(d, options.max_depth + 1) for d in depths]
    if "levels" not in documents.columns:
        documents = classify(documents, seen.options)
    plain, deep, ranked = _kinds()
    # Documents are told apart by a filter that parses and measures them once more; collections of plain ones need none.
    apart = F.col("collection").isin(mixed) if 0 < len(mixed) <= SPLIT_COLLECTIONS else None

    def chain(docs: DataFrame, depth: int, ranked: bool) -> DataFrame:
        return _Chain(options, raw_paths, extended_json, ranked, markers or ranked, seen.plain_keys, leaves, arrays_only).run(docs, depth)

    kept = ["collection", "doc_id", "path", "pos", "depth", "type", "text", "size", "num", "kind", "solo"]
    kept += ["string"] if strings else []
    rows = []

    def of_kind(kind: Column) -> DataFrame:
        if sum(d is not None for d in depths) == 1:
            return documents
        if apart is None:
            return documents.where(kind)
        return documents.where(F.coalesce(~apart, F.lit(True)) | kind if kind is plain else apart & kind)

    for kind, depth in zip((plain, deep), depths, strict=False):
        if depth or (kind is plain and not any(depths)):
            expanded = chain(of_kind(kind) if any(depths) else documents, depth or 1, ranked=False)
            rows.append(expanded.selectExpr(*kept, "0L as keys_refused", f"cast(kind = {CUT} as int) as depth_cut"))
    if depths[2]:
        within = _within_budget(chain(of_kind(ranked), depths[2], ranked=True), options.max_keys_per_doc)
        if not markers:
            within = within.where(F.col("kind") != MARKER)
        if arrays_only:
            within = within.where(_in_array("type = 'array'", raw_paths))
        rows.append(within.select(*kept, "keys_refused", "depth_cut"))
    union = rows[0]
    for more in rows[1:]:
        union = union.unionByName(more)
    return union


def _within_budget(rows: DataFrame, cap: int) -> DataFrame:
    """Rank the rows of each document in pre-order and keep the first `cap`.

    A refused row is counted only when its parent was admitted. Counters travel on the
    first row of the document. A window partition is one document's rows.
    """
    doc = "partition by collection, doc_id"
    ranked = rows.selectExpr("*", f"row_number() over ({doc} order by ord) as rank")
    ranked = ranked.selectExpr("*", f"max(if(rank = {cap}, ord, null)) over ({doc}) as edge")
    refused = f"(rank > {cap} and (size(ord) = 1 or slice(ord, 1, size(ord) - 1) <= edge))"
    counted = ranked.selectExpr(
        "*",
        f"if(rank = 1, sum(cast({refused} as bigint)) over ({doc}), 0L) as keys_refused",
        f"if(rank = 1, sum(cast({refused} and kind = {CUT} as int)) over ({doc}), 0L) as late_cut",
    )
    return counted.where(f"rank <= {cap}").withColumn(
        "depth_cut", F.expr(f"cast(late_cut as int) + cast(kind = {CUT} as int)")
    )


def normalize_wildcards(paths: DataFrame) -> DataFrame:
    """Pool array elements: index segments of raw paths become `[*]`."""
    return paths.withColumn("path", normalize_path(F.col("path")))
