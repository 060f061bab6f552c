"""The same expressions as SQL text for the checking engine."""

from stmtwarden.functions import text as T


def plain(pattern: str) -> str:
    """Pattern without possessive quantifiers, quoted as a SQL literal."""
    return "'" + pattern.replace("*+", "*").replace("++", "+").replace("'", "''") + "'"


def fingerprint(x: str, upper_names: bool = False) -> str:
    quoted = lambda words: ", ".join(f"'{k}'" for k in words)
    before = "COALESCE(UPPER(k[i - 1]), '')"
    function = (
        f"(COALESCE(k[i + 1], '') = '(' AND {before} NOT IN ({quoted(T.BEFORE_NAMES)}) AND NOT ({before} = 'ON' AND UPPER(k[1]) = 'CREATE') "
        "AND NOT starts_with(t, '`'))"
    )
    word = "UPPER(t)" if upper_names else f"CASE WHEN UPPER(t) IN ({quoted(T.UPPER_WORDS)}) OR {function} THEN UPPER(t) ELSE t END"
    kept = (
        f"list_filter(regexp_extract_all({x}, {plain(T.TOKEN)}), lambda t: NOT (starts_with(t, '/*') OR starts_with(t, '--') "
        "OR starts_with(t, '#')) AND t <> ';')"
    )
    shown = (
        f"list_transform([{kept}], lambda k: array_to_string(list_transform(k, lambda t, i: CASE WHEN regexp_matches(t, '^[''\"0-9]') "
        f"OR regexp_matches(t, '^\\.[0-9]') THEN '?' ELSE {word} END), ' '))[1]"
    )
    return f"COALESCE(NULLIF({shown}, ''), {x})"


def code_text(x: str) -> str:
    bare = (
        f"CASE WHEN contains({x}, '--') OR contains({x}, '/*') OR contains({x}, '#') "
        f"THEN regexp_replace({x}, {plain(T.STRING_OR_COMMENT)}, '\\1 ', 'g') ELSE {x} END"
    )
    return f"trim(regexp_replace(regexp_replace({bare}, '\\s+', ' ', 'g'), '[;\\s]+$', ''))"


def masked_text(x: str) -> str:
    empty = "'" * 6  # the literal of two quotes
    return f"upper(regexp_replace({code_text(x)}, {plain(T.STRING)}, {empty}, 'g'))"


def sql_kind(x: str) -> str:
    c = masked_text(x)
    return (
        f"CASE WHEN regexp_matches({c}, {plain(T.WITH_CHANGE)}) THEN 'DML' WHEN regexp_matches({c}, '^[\\s(]*(SELECT|WITH)\\b') THEN 'DQL' "
        f"WHEN regexp_matches({c}, '^\\s*(INSERT|UPDATE|DELETE|REPLACE)\\b') THEN 'DML' ELSE 'DDL' END"
    )


def json_md5(**fields: str) -> str:
    parts = []
    for n, (name, value) in enumerate(fields.items()):
        parts.append(f"'{',' if n else '{'}\"{name}\":'")
        text = f"COALESCE(CAST({value} AS VARCHAR), '')"
        for raw, esc in (("\\", "\\\\"), ('"', '\\"'), ("<", "\\u003c"), (">", "\\u003e"), ("&", "\\u0026")):
            text = f"REPLACE({text}, '{raw}', '{esc}')"
        parts.append(f"'\"' || {text} || '\"'")
    return "MD5(" + " || ".join(parts) + " || '}')"


OUTER = r"\bouter\b"


def predicate(sql: str) -> str:
    """A rule's Spark predicate in the checking engine's words."""
    import re

    sql = re.sub(r"regexp_count\((\w+), r'([^']*)'\)", r"len(regexp_extract_all(\1, '\2'))", sql)
    sql = re.sub(r"regexp_replace\((\w+), r'([^']*)', ''\)", r"regexp_replace(\1, '\2', '', 'g')", sql)
    sql = sql.replace("regexp_like(", "regexp_matches(").replace("startswith(", "starts_with(").replace("octet_length(", "strlen(")
    return sql.replace(" r'", " '")


def _names(lists: str) -> str:
    parts = f"string_split(array_to_string({lists}, ','), ',')"
    bare = f"list_transform({parts}, lambda x: regexp_extract(x, '^[ `]*([A-Z0-9_$]+)', 1))"
    return f"list_distinct(list_filter({bare}, lambda x: x <> ''))"


def text_features(source: str) -> str:
    """CTEs f0-f4 with the features of the text rules."""
    import re

    from stmtwarden.lint import text_rules as R

    outer = "masked"
    for _ in range(12):
        outer = f"regexp_replace({outer}, {plain(R.PARENS)}, '~', 'g')"
    node = "{{'t': {}, 'open': '', 'cur': 0, 'top': 0}}"
    depth = (
        f"list_reduce(list_prepend({node.format(chr(39) * 2)}, list_transform(regexp_extract_all(masked, {plain(R.DEPTH_TOKEN)}), lambda t: {node.format('t')})), "
        "lambda a, x: {'t': '', 'open': CASE WHEN x.t = ')' THEN a.open[2:] WHEN ends_with(x.t, 'SELECT') THEN 'S' || a.open ELSE 'P' || a.open END, "
        "'cur': CASE WHEN x.t = ')' THEN a.cur - CASE WHEN a.open[1:1] = 'S' THEN 1 ELSE 0 END WHEN ends_with(x.t, 'SELECT') THEN a.cur + 1 ELSE a.cur END, "
        "'top': CASE WHEN ends_with(x.t, 'SELECT') THEN greatest(a.top, a.cur + 1) ELSE a.top END}).top"
    )
    every = lambda pat, g=0, col="masked": f"regexp_extract_all({col}, {plain(pat)}, {g})"
    clauses = ", ".join(f"trim(regexp_extract(outer_text, {plain(p)}, 1)) AS {name}" for name, (_, p) in R.CLAUSES.items())
    conditions = ", ".join(f"{re.sub(OUTER, 'outer_text', predicate(sql))} AS {name}" for name, sql in R.CONDITIONS.items())
    return f"""
f0 AS (SELECT *, {code_text('sql_text')} AS code, {masked_text('sql_text')} AS masked FROM {source}),
f1 AS (SELECT *, regexp_extract(masked, {plain(R.KIND)}, 1) AS kind, regexp_extract(masked, {plain(R.WHERE_ALL)}, 1) AS where_all,
  {outer} AS outer_text, {depth} AS select_depth,
  len(list_filter({every(T.STRING, 0, 'code')}, lambda s: regexp_matches(s, '^[''"] | [''"]$'))) > 0 AS padded_literal,
  CASE WHEN starts_with(masked, 'CREATE') THEN CAST([] AS VARCHAR[]) ELSE list_transform({every(R.TABLE, 1)}, lambda t: replace(t, '`', '')) END AS table_names,
  COALESCE(list_max(list_transform(list_filter({every(R.IN_LIST, 1)}, lambda x: NOT regexp_matches(x, '^ ?SELECT ')), lambda x: len(string_split(x, ',')))), 0) AS in_list_max,
  {_names(f"list_concat({every(R.INDEX_COLUMNS, 1)}, {every(R.INLINE_KEY, 1)})")} AS index_columns, {_names(every(R.NOT_NULL, 1))} AS not_null_columns FROM f0),
f2 AS (SELECT *, {clauses} FROM f1),
f3 AS (SELECT *, CASE WHEN kind = 'UPDATE' THEN update_list ELSE from_list END AS tables_part,
  TRY_CAST(CASE WHEN contains(limit_text, ',') THEN regexp_extract(limit_text, '^([0-9]+)', 1) ELSE regexp_extract(limit_text, 'OFFSET ([0-9]+)', 1) END AS BIGINT) AS limit_offset,
  TRY_CAST(CASE WHEN contains(limit_text, ',') THEN regexp_extract(limit_text, '([0-9]+)$', 1) ELSE regexp_extract(limit_text, '^([0-9]+)', 1) END AS BIGINT) AS limit_count,
  COALESCE(list_max(list_transform(table_names, lambda t: len(list_filter(table_names, lambda x: x = t)))), 0) AS table_uses_max,
  len(list_distinct(table_names)) AS table_count, len(list_filter(index_columns, lambda x: NOT list_contains(not_null_columns, x))) AS nullable_index_columns,
  len(index_columns) AS index_column_count, len(list_filter(table_names, lambda t: NOT contains(t, '.'))) > 0 AS bare_table,
  {conditions} FROM f2)"""


def violations(source: str, rules, *keys: str) -> str:
    """SELECT of keys, rule_name, level for every rule a row of ``source`` breaks."""
    import re

    parts = []
    for r in rules:
        test = re.sub(OUTER, "outer_text", predicate(r.sql()))
        parts.append(f"CASE WHEN {test} THEN '{r.name}:{r.level}' END")
    listed = "list_filter([" + ",\n ".join(parts) + "], lambda v: v IS NOT NULL)"
    cols = ", ".join(keys)
    return (
        f"SELECT {cols}, split_part(v, ':', 1) AS rule_name, split_part(v, ':', 2) AS level "
        f"FROM (SELECT {cols}, UNNEST({listed}) AS v FROM {source}) y"
    )
