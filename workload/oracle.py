"""Plain SQL over the same tables for every registered query that SQL can state."""

from __future__ import annotations

from docstrata.sources.fixtures import STATEMENTS

# Stated here once more, so that a wrong value in the library is a difference and not the same mistake twice.
# Longest run of stars, most characters shown per side, share shown per side.
MAX_STARS, MAX_SHOWN, SHOWN_SHARE = 10, 3, 4

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

# Hints that names and ancestors give, and those of values, in report order.
NAME_HINTS = (
    "email phone password secret token api_key access_key auth ssn credit_card cvv address birthdate ip_address ci di salt name location"
).split()
VALUE_HINTS = "email phone ssn credit_card jwt uuid ip_address".split()

# --- documents -> path rows ----------------------------------------------------------------------

_PATH = r"""regexp_replace(replace(substr(fullkey, 3), '"', ''), '\[\d+\]', '.[*]', 'g')"""
_TYPE = """case jt when 'OBJECT' then 'object' when 'ARRAY' then 'array' when 'VARCHAR' then 'string'
 when 'BOOLEAN' then 'boolean' when 'NULL' then 'null'
 else case when cast(atom as double) <> floor(cast(atom as double)) then 'double'
 when cast(atom as double) between -2147483648 and 2147483647 then 'int' else 'long' end end"""
_TEXT = """case jt when 'OBJECT' then '{' || array_to_string(json_keys(value)[1:3], ', ')
 || case when len(json_keys(value)) > 3 then '...' else '' end || '}'
 when 'ARRAY' then '[Array(' || json_array_length(value) || ')]'
 when 'VARCHAR' then json_extract_string(value, '$') when 'NULL' then 'null' when 'BOOLEAN' then cast(atom as varchar)
 else case when cast(atom as double) = floor(cast(atom as double)) then cast(cast(cast(atom as double) as bigint) as varchar)
 else cast(cast(atom as double) as varchar) end end"""


def flat(*fixtures: str, name: str = "flat", label: str | None = None) -> str:
    """CTEs `docs` and `flat` over one or more fixture collections."""
    docs = " union all ".join(
        f"select '{label or f}' as collection, doc_id, j from ({STATEMENTS[f]}) s" for f in fixtures
    )
    return f"""{name}_docs as ({docs}),
{name}_tree as (select d.collection, d.doc_id, t.id, t.parent, t.fullkey, t.key, t.type as jt, t.atom, t.value
 from {name}_docs d, json_tree(d.j) t where t.parent is not null),
{name} as (select collection, doc_id, id, parent, {_PATH} as path, {_TYPE} as type, {_TEXT} as text,
 case jt when 'OBJECT' then len(json_keys(value)) when 'ARRAY' then json_array_length(value) else 0 end as size
 from {name}_tree)"""


def with_flat(body: str, *fixtures: str, **kw) -> str:
    return f"with {flat(*fixtures, **kw)} {body}"


FIELD_ROWS = "select * from flat where path not like '%.[*]'"

# --- shared expressions --------------------------------------------------------------------------


def natural_key(x: str) -> str:
    digits = "ltrim(t, '0')"
    run = f"case when regexp_matches(t, '^[0-9]') then lpad(cast(length({digits}) as varchar), 8, '0') || {digits} else t end"
    return f"array_to_string(list_transform(regexp_extract_all(lower({x}), '[0-9]+|[^0-9]+'), lambda t: {run}), '')"


def path_key(x: str) -> str:
    return natural_key(f"replace({x}, '.', chr(1))")


def mask_string(x: str, strict: bool = False) -> str:
    n = f"length({x})"
    if strict:
        return (
            f"case when {n} <= 2 then repeat('*', {n}) else left({x}, 1) || repeat('*', least({n} - 1, {MAX_STARS})) end"
        )
    v = f"least({MAX_SHOWN}, {n} // {SHOWN_SHARE})"
    return (
        f"case when {n} <= 2 then repeat('*', {n}) "
        f"when {n} <= {SHOWN_SHARE} then left({x}, 1) || repeat('*', {n} - 2) || right({x}, 1) "
        f"else left({x}, {v}) || repeat('*', least({n} - 2 * {v}, {MAX_STARS})) || right({x}, {v}) end"
    )


def mask_email(x: str) -> str:
    local, domain = f"split_part({x}, '@', 1)", f"split_part({x}, '@', 2)"
    return (
        f"case when {domain} = '' then {mask_string(x)} else "
        f"case when length({local}) > 1 then left({local}, 1) || '***' else '*' end || '@' || "
        f"case when contains({domain}, '.') then left(split_part({domain}, '.', 1), 1) || '***.' || "
        f"split_part({domain}, '.', -1) else {mask_string(domain)} end end"
    )


def mask_phone(x: str) -> str:
    d = f"regexp_replace({x}, '[^0-9]', '', 'g')"
    return (
        f"case when length({d}) < 4 then repeat('*', length({x})) "
        f"else repeat('*', length({d}) - 4) || right({d}, 4) end"
    )


def mask_number(x: str) -> str:
    return f"case when length({x}) <= 2 then {x} else left({x}, 1) || repeat('*', length({x}) - 2) || right({x}, 1) end"


def last_segment(x: str) -> str:
    return f"split_part({x}, '.', -1)"


def custom_hint(pattern: str) -> str:
    return pattern.removesuffix(".*").split(".")[-1] or pattern


def hint_order(custom: tuple[str, ...] = ()) -> list[str]:
    return list(dict.fromkeys([*NAME_HINTS, *map(custom_hint, custom), *VALUE_HINTS]))


def hint_list(path: str, value: str | None, custom: tuple[str, ...] = ()) -> str:
    """Hints as a list, in report order; `value` is NULL for anything but strings."""
    by_hint: dict[str, list[str]] = {}
    for pattern, hint in NAME_PATTERNS:
        by_hint.setdefault(hint, []).append(f"regexp_matches({last_segment(path)}, '(?i){pattern}')")
    for name in ANCESTOR_NAMES:
        by_hint.setdefault(name, []).append(f"list_contains(string_split(lower({path}), '.'), '{name}')")
    for pattern in custom:
        by_hint.setdefault(custom_hint(pattern), []).append(custom_match(path, pattern))
    for pattern, hint in VALUE_PATTERNS:
        tests = by_hint.setdefault(hint, [])
        if value is not None:
            tests.append(f"coalesce(regexp_matches({value}, '\\A(?:{pattern})\\z'), false)")
    order = [h for h in hint_order(custom) if by_hint.get(h)]
    cases = ", ".join(f"case when {' or '.join(by_hint[h])} then '{h}' end" for h in order)
    return f"list_filter([{cases}], lambda x: x is not null)"


def custom_match(path: str, pattern: str) -> str:
    if not pattern.endswith(".*"):
        return f"lower({path}) = '{pattern.lower()}'"
    segments = f"string_split(lower({path}), '.')"
    at = f"coalesce(list_position({segments}, '{pattern[:-2].lower()}'), 0)"
    return f"({at} > 0 and {at} < len({segments}))"


def joined(hints: str) -> str:
    return f"array_to_string({hints}, ', ')"


STRING_VALUE = "case when type = 'string' then text end"


def masked(hints: str) -> str:
    """Balanced mask of a path row whose hints are the list `hints`."""
    return f"""case type when 'string' then case when list_contains({hints}, 'email') then {mask_email('text')}
 when list_contains({hints}, 'phone') then {mask_phone('text')} else {mask_string('text')} end
 when 'int' then {mask_number('text')} when 'long' then {mask_number('text')} when 'double' then {mask_number('text')}
 when 'object' then '{{Object(' || size || ' keys)}}' else text end"""


def rendered(name: str = "rendered", source: str = FIELD_ROWS) -> str:
    """CTEs: field rows with their hints and the text shown under policy `pii`."""
    return f"""{name}_hints as (select *, {hint_list('path', STRING_VALUE)} as hints from ({source}) r),
{name} as (select *, case when len(hints) > 0 then {masked('hints')} else text end as shown from {name}_hints)"""


def fields(name: str = "fields", source: str = "flat", docs: str = "flat_docs") -> str:
    """CTEs `fields` and `types` of a profile (without examples)."""
    return f"""{name}_rows as (select * from {source} where path not like '%.[*]'),
{name}_totals as (select collection, count(*) as docs from {docs} group by 1),
{name}_types as (select collection, path, type, count(*) as n, min((doc_id, id)) as first
 from {name}_rows group by 1, 2, 3),
{name}_listed as (select collection, path, list(type order by first) as type_list, list(n order by first) as n_list,
 cast(sum(n) as bigint) as occurrences, count(*) filter (where type <> 'null') > 1 as mixed_type
 from {name}_types group by 1, 2),
{name}_stats as (select collection, path, min(cast(text as double)) as lo, max(cast(text as double)) as hi,
 avg(cast(text as double)) as av from {name}_rows where type in ('int', 'long', 'double') group by 1, 2),
{name}_presence as (select collection, path, count(distinct doc_id) as present_count from {name}_rows group by 1, 2),
{name} as (select p.collection, p.path, p.present_count, t.docs - p.present_count as absent_count,
 p.present_count / t.docs as present_ratio, p.present_count / t.docs < 0.95 as optional, l.type_list, l.n_list,
 l.occurrences, l.mixed_type, s.lo, s.hi, s.av
 from {name}_presence p join {name}_totals t using (collection) join {name}_listed l using (collection, path)
 left join {name}_stats s using (collection, path))"""


def field_hints(name: str = "fh", source: str = "fields_rows") -> str:
    names = ", ".join(f"'{h}'" for h in hint_order())
    return f"""{name}_each as (select collection, path, unnest({hint_list('path', STRING_VALUE)}) as hint from {source}),
{name} as (select collection, path,
 list_sort(list(distinct list_position([{names}], hint))) as ranks from {name}_each group by 1, 2),
{name}_text as (select collection, path,
 array_to_string(list_transform(ranks, lambda r: ([{names}])[r]), ', ') as hints from {name})"""


def examples(name: str = "ex", k: int = 3) -> str:
    """CTE of the first k distinct shown values per type; needs `rendered`."""
    return f"""{name}_first as (select collection, path, type, shown, min((doc_id, id)) as seen_at from rendered group by 1, 2, 3, 4),
{name} as (select *, row_number() over (partition by collection, path, type order by seen_at, shown) as rank from {name}_first
 qualify row_number() over (partition by collection, path, type order by seen_at, shown) <= {k}),
{name}_type as (select *, min(seen_at) over (partition by collection, path, type) as type_at from {name}),
{name}_list as (select collection, path, list(shown order by type_at, rank) as shown_list from {name}_type group by 1, 2)"""


# --- shapes --------------------------------------------------------------------------------------


def shapes(fixture: str) -> str:
    """CTEs `shape` (paths of every document) and `signed` (one row per shape)."""
    key = path_key("p")
    return f"""shape_rows as (select collection, doc_id, id, replace(substr(fullkey, 3), '"', '') as p,
 len(string_split(replace(substr(fullkey, 3), '"', ''), '.')) as depth, jt, value from flat_tree where fullkey not like '%[%'),
shape_leaf as (select * from shape_rows where depth <= 3 and (depth = 3 or jt <> 'OBJECT')),
shape_doc as (select collection, doc_id, list(p order by {key}, p) as paths from shape_leaf group by 1, 2),
shape as (select d.collection, d.doc_id, coalesce(s.paths, []::varchar[]) as paths,
 sha256(array_to_string(coalesce(s.paths, []::varchar[]), '|')) as signature
 from flat_docs d left join shape_doc s using (collection, doc_id)),
signed as (select collection, signature, count(*) as n, min(doc_id) as first_doc, any_value(paths) as paths from shape group by 1, 2),
ranked as (select *, row_number() over (partition by collection order by n desc, first_doc, signature) as rank,
 n / sum(n) over (partition by collection) as ratio from signed),
top as (select * from ranked where rank <= 10),
diffed as (select t.*, p.paths as base,
 list_filter(t.paths, lambda x: not list_contains(p.paths, x)) as added,
 list_filter(p.paths, lambda x: not list_contains(t.paths, x)) as missing
 from top t join top p on p.collection = t.collection and p.rank = 1)"""


def diff_text(added: str = "added", missing: str = "missing", count_rest: bool = True) -> str:
    def side(sign: str, x: str) -> str:
        rest = f"'... (+' || (len({x}) - 3) || ' more)'" if count_rest else "'...'"
        return (
            f"case when len({x}) > 0 then '{sign}' || array_to_string({x}[1:3], ', ') || "
            f"case when len({x}) > 3 then {rest} else '' end end"
        )

    return f"coalesce(nullif(concat_ws(', ', {side('+', added)}, {side('-', missing)}), ''), '-')"


def preview(x: str) -> str:
    short = f"case when length({x}) > 100 then left({x}, 97) || '...' else {x} end"
    return f"replace(replace({short}, chr(13), ''), chr(10), ' ')"


def percent(x: str) -> str:
    return f"(cast(round({x} * 100) as bigint) || '%')"
