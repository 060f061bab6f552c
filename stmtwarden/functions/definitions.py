"""Tables, columns and indexes that CREATE and ALTER statements define, as rows.

A statement's literals are taken out first and leave their number, so that no
comma or bracket inside them counts. Its brackets and commas are then marked by
how deep they lie, in one pass over the statement, and the definition list is
cut at the commas of its own depth. Each piece is read by patterns. Names in
back quotes may hold anything but brackets and commas.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stmtwarden.functions.text import STRING, code_text

BODY, ITEM, END, SPEC = "\u0001", "\u0002", "\u0003", "\u0004"
_NAME = r"`[^`]+`|[^\s`.,()\x01-\x04=]+"
_TABLE = rf"(?:{_NAME})(?:\s*\.\s*(?:{_NAME}))?"
CREATE = rf"(?i)^CREATE\s+(?:TEMPORARY\s+)?TABLE\s+(?:IF\s+NOT\s+EXISTS\s+)?({_TABLE})"
ALTER = rf"(?i)^ALTER\s+(?:IGNORE\s+)?TABLE\s+({_TABLE})\s+(.*)$"
INDEX_ON = rf"(?i)^CREATE\s+((?:UNIQUE|FULLTEXT|SPATIAL)\s+)?INDEX\s+({_NAME})(?:\s+USING\s+\w+)?\s+ON\s+({_TABLE})\s*(\(.*)$"
COLUMN_SPEC = rf"(?i)^\s*(?:ADD\s+(?:COLUMN\s+)?(?!(?:CONSTRAINT|PRIMARY|UNIQUE|INDEX|KEY|FULLTEXT|SPATIAL|FOREIGN|CHECK|PARTITION)\b)|MODIFY\s+(?:COLUMN\s+)?|CHANGE\s+(?:COLUMN\s+)?(?:{_NAME})\s+)"
INDEX_SPEC = r"(?i)^\s*ADD\s+(?=(?:CONSTRAINT|PRIMARY|UNIQUE|INDEX|KEY|FULLTEXT|SPATIAL|FOREIGN)\b)"
INDEX_ITEM = r"(?i)^\s*(?:CONSTRAINT\b|PRIMARY\s+KEY\b|UNIQUE\b|(?:FULLTEXT|SPATIAL)\b|(?:INDEX|KEY)\b|FOREIGN\s+KEY\b|CHECK\b|LIKE\b)"
INDEX = rf"(?i)^\s*(?:CONSTRAINT(?:\s+(?!PRIMARY\b|UNIQUE\b)({_NAME}))?\s+)?(PRIMARY\s+KEY|UNIQUE(?:\s+(?:KEY|INDEX))?|(?:FULLTEXT|SPATIAL)(?:\s+(?:KEY|INDEX))?|KEY|INDEX)(?:\s+(?!USING\b)({_NAME}))?(?:\s+USING\s+\w+)?\s*\((.*)\)"
COLUMN = rf"(?i)^\s*({_NAME})\s+([A-Za-z]+[0-9]*)(?:\s+(?:PRECISION|VARYING)\b)?(?:\s*\(([^()]*)\))?(.*)$"
DEFAULT = r"(?i)\bDEFAULT\s+(\((?:[^()]|\([^()]*\))*\)|[^\s(]+(?:\s*\([^()]*\))?)"
NOW = r"(?i)^(?:CURRENT_TIMESTAMP|NOW|LOCALTIME|LOCALTIMESTAMP)(?:\s*\([0-9]*\))?$"

# Other names of a type.
TYPE_NAMES = {"integer": "int", "bool": "tinyint", "boolean": "tinyint", "dec": "decimal", "numeric": "decimal", "fixed": "decimal", "real": "double", "character": "char"}

_ENTRY = "struct<item:string,sort:string>"


def _bare(name: Column) -> Column:
    return F.replace(F.trim(name), F.lit("`"), F.lit(""))


def _marked(text: Column) -> Column:
    """Text with the outermost brackets, their commas and the commas outside all brackets replaced by marks."""
    pieces = F.regexp_extract_all(text, F.lit(r"[(),]|[^(),]+"), F.lit(0))

    def step(at, x):
        deep = at["deep"]
        shown = (
            F.when((x == "(") & (deep == 0), BODY)
            .when((x == ")") & (deep == 1), END)
            .when((x == ",") & (deep == 0), SPEC)
            .when((x == ",") & (deep == 1), ITEM)
            .otherwise(x)
        )
        return F.struct(F.greatest(F.lit(0), deep + F.when(x == "(", 1).when(x == ")", -1).otherwise(0)).alias("deep"), F.array_append(at["out"], shown).alias("out"))

    # Pieces are joined in runs of about the root of their number, as each one added to an array copies it.
    none = F.array().cast("array<string>")

    def run(at, some):
        return F.aggregate(some, F.struct(at["deep"].alias("deep"), none.alias("out")), step, lambda z: F.struct(z["deep"].alias("deep"), F.array_append(at["out"], F.array_join(z["out"], "")).alias("out")))

    def joined(all_):
        wide = F.ceil(F.sqrt(F.size(all_))).cast("int")
        runs = F.transform(F.sequence(F.lit(0), F.floor((F.size(all_) - 1) / wide).cast("int")), lambda k: F.slice(all_, k * wide + 1, wide))
        return F.aggregate(runs, F.struct(F.lit(0).alias("deep"), none.alias("out")), run, lambda at: F.array_join(at["out"], ""))

    return F.get(F.transform(F.array(pieces), lambda all_: F.when(F.size(all_) == 0, "").otherwise(joined(all_))), F.lit(0))


def _plain(text: Column) -> Column:
    """Marks of one specification as brackets and commas again."""
    return F.translate(text, BODY + ITEM + END, "(,)")


def _literal(text: Column, raw) -> Column:
    """What a numbered literal stands for, without its quotes; other texts as they are. ``raw`` gives the literal of a number."""
    whole = raw(F.regexp_extract(text, "^'([0-9]+)'$", 1))
    inner = F.substr(whole, F.lit(2), F.length(whole) - 2)
    return F.when(text.rlike("^'[0-9]+'$"), F.regexp_replace(F.regexp_replace(inner, r"''|\"\"", "'"), r"\\(.)", "$1")).otherwise(text)


def _nth(number: Column) -> Column:
    return F.get("_strings", number.try_cast("int"))


def _with_literals(items: Column) -> Column:
    """Items with the literals they hold, so that a row of one item need not carry all of its statement."""
    numbers = lambda x: F.regexp_extract_all(x["item"], F.lit("'([0-9]+)'"), F.lit(1))
    return F.transform(items, lambda x: F.struct(x["item"].alias("item"), F.transform(numbers(x), lambda n: F.struct(n.alias("n"), _nth(n).alias("text"))).alias("literals")))


def _option(text: Column, word: str, value: str = r"('[0-9]+'|\w+)") -> Column:
    return F.nullif(F.regexp_extract(text, rf"(?i)\b(?:{word})\s*=?\s*{value}", 1), F.lit(""))


def definitions(statements: DataFrame) -> DataFrame:
    """Defining statements cut into parts: (id, action, schema_name, table_name, items, options).

    ``statements``: id, sql_text. ``action`` is create, alter or index; ``items``
    are the pieces of the definition list. Other statements and null texts have
    no row; a list that is not closed ends with the text.
    """
    c = F.col
    code = F.translate(code_text(c("sql_text")), BODY + ITEM + END + SPEC, "    ")
    df = statements.select("id", code.alias("_code")).filter(c("_code").rlike(r"(?i)^(?:CREATE|ALTER)\b.*\b(?:TABLE|INDEX)\b"))
    # A filter on the text is pushed below its columns, so nothing inside the lambda may read the literals: it would cut them out anew for each piece.
    numbered = F.transform(F.split("_code", STRING), lambda x, n: F.concat(F.when(n > 0, F.concat(F.lit("'"), (n - 1).cast("string"), F.lit("'"))).otherwise(""), x))
    df = df.withColumn("_strings", F.regexp_extract_all("_code", F.lit(f"({STRING})"), F.lit(1))).withColumn("_text", F.array_join(numbered, ""))
    df = df.withColumn(
        "action", F.when(c("_text").rlike(CREATE), "create").when(c("_text").rlike(ALTER), "alter").when(c("_text").rlike(INDEX_ON), "index")
    ).filter("action IS NOT NULL")
    df = df.withColumn("_marked", F.when(c("action") != "index", _marked(c("_text"))))
    after = F.regexp_extract("_marked", f"(?s){BODY}(.*?)(?:{END}(.*))?$", 1)
    specs = F.split(F.regexp_extract("_marked", ALTER, 2), SPEC)
    # ADD (a INT, b INT) is a list of its own.
    listed = rf"(?is)^\s*ADD\s+(?:COLUMN\s+)?{BODY}(.*?){END}\s*$"
    one = lambda x, sort: F.struct(x.alias("item"), F.lit(sort).alias("sort"))
    column = lambda x: F.array(one(_plain(F.regexp_replace(x, COLUMN_SPEC, "")), "column"))
    index = lambda x: F.array(one(_plain(F.regexp_replace(x, INDEX_SPEC, "")), "index"))
    altered = F.flatten(
        F.transform(
            specs,
            lambda x: F.when(x.rlike(listed), F.transform(F.split(F.regexp_extract(x, listed, 1), ITEM), lambda y: F.struct(y.alias("item"), F.when(y.rlike(INDEX_ITEM), "index").otherwise("column").alias("sort"))))
            .when(x.rlike(INDEX_SPEC), index(x)).when(x.rlike(COLUMN_SPEC), column(x)).otherwise(F.array().cast(f"array<{_ENTRY}>")),
        )
    )
    created = F.transform(F.split(after, ITEM), lambda x: F.struct(x.alias("item"), F.when(x.rlike(INDEX_ITEM), "index").otherwise("column").alias("sort")))
    on = lambda g: F.regexp_extract("_text", INDEX_ON, g)
    indexed = F.array(one(F.concat_ws(" ", F.coalesce(F.nullif(F.trim(on(1)), F.lit("")), F.lit("INDEX")), on(2), on(4)), "index"))
    table = F.when(c("action") == "create", F.regexp_extract("_text", CREATE, 1)).when(c("action") == "alter", F.regexp_extract("_text", ALTER, 1)).otherwise(on(3))
    dotted = F.contains(table, F.lit("."))
    return df.select(
        "id",
        "action",
        F.when(dotted, _bare(F.substring_index(table, ".", 1))).alias("schema_name"),
        _bare(F.substring_index(table, ".", -1)).alias("table_name"),
        F.when(c("action") == "create", created).when(c("action") == "alter", altered).otherwise(indexed).alias("items"),
        F.when(c("action") == "create", F.regexp_extract("_marked", f"(?s){END}(.*)$", 1)).alias("options"),
        "_strings",
    )


KEYS = ("id", "action", "schema_name", "table_name")


def defined_tables(defined: DataFrame) -> DataFrame:
    """One row per CREATE TABLE, in the shape of a catalogue's tables."""
    c = F.col
    o = c("options")
    text = lambda word: _literal(_option(o, word), _nth)
    return defined.filter("action = 'create'").select(
        *KEYS,
        text("ENGINE").alias("engine"),
        F.lower(text(r"CHARACTER\s+SET|CHARSET")).alias("charset"),
        F.lower(text("COLLATE")).alias("collation_name"),
        F.coalesce(text("COMMENT"), F.lit("")).alias("table_comment"),
        o.rlike(r"(?i)\bPARTITION\s+BY\b").alias("is_partitioned"),
        _option(o, "AUTO_INCREMENT", "([0-9]+)").cast("bigint").alias("auto_increment_start"),
        F.exists("items", lambda x: x["item"].rlike(r"(?i)\bFOREIGN\s+KEY\b|\bREFERENCES\b")).alias("has_foreign_key"),
    )


def _index_items(defined: DataFrame) -> DataFrame:
    """One row per column of each key that is defined as an item."""
    c = F.col
    rows = defined.select(*KEYS, F.posexplode(F.filter("items", lambda x: x["sort"] == "index")).alias("_at", "_item")).filter(c("_item.item").rlike(INDEX))
    part = lambda g: F.regexp_extract("_item.item", INDEX, g)
    rows = rows.select(*KEYS, "_at", _bare(part(1)).alias("_called"), F.upper(F.regexp_replace(part(2), r"\s+", " ")).alias("_sort"), _bare(part(3)).alias("_name"), F.split(part(4), ",").alias("_cols"))
    column = lambda x: F.nullif(_bare(F.regexp_extract(x, rf"^\s*({_NAME})", 1)), F.lit(""))
    rows = rows.withColumn("_cols", F.transform("_cols", column))
    primary = c("_sort") == "PRIMARY KEY"
    given = F.coalesce(F.nullif("_name", F.lit("")), F.nullif("_called", F.lit("")))
    return rows.withColumn("index_name", F.when(primary, F.coalesce(given, F.lit("PRIMARY"))).otherwise(F.coalesce(given, F.get("_cols", F.lit(0))))).select(
        *KEYS,
        "index_name",
        F.posexplode("_cols").alias("_n", "column_name"),
        (primary | F.startswith("_sort", F.lit("UNIQUE"))).alias("is_unique"),
        F.when(F.startswith("_sort", F.lit("FULLTEXT")), "FULLTEXT").when(F.startswith("_sort", F.lit("SPATIAL")), "SPATIAL").otherwise("BTREE").alias("index_type"),
        F.when(primary, "PRIMARY KEY").otherwise("INDEX").alias("constraint_type"),
    ).withColumn("seq", (c("_n") + 1).cast("bigint")).drop("_n")


def _column_items(defined: DataFrame) -> DataFrame:
    c = F.col
    own = F.filter("items", lambda x: x["sort"] == "column")
    # Columns of the key that the list itself names as primary: none of them is nullable.
    keys = F.filter("items", lambda x: (x["sort"] == "index") & x["item"].rlike(r"(?i)^\s*(?:CONSTRAINT\b.*?)?PRIMARY\s+KEY\b"))
    named = F.flatten(F.transform(keys, lambda x: F.transform(F.split(F.regexp_extract(x["item"], INDEX, 4), ","), lambda y: F.lower(_bare(F.regexp_extract(y, rf"^\s*({_NAME})", 1))))))
    # What is the same for all columns of a statement is found out before they become rows: beside the explode it would be anew for each.
    whole = defined.select(*KEYS, named.alias("_pk"), _with_literals(own).alias("_own"))
    rows = whole.select(*KEYS, "_pk", F.posexplode_outer("_own").alias("ordinal", "_item")).filter(c("_item.item").rlike(COLUMN))
    part = lambda g: F.regexp_extract("_item.item", COLUMN, g)
    return rows.select(*KEYS, c("_item.literals").alias("_literals"), "_pk", c("ordinal").cast("bigint").alias("ordinal"), _bare(part(1)).alias("column_name"), F.lower(part(2)).alias("_type"), part(3).alias("_size"), part(4).alias("_rest"))


def defined_columns(defined: DataFrame) -> DataFrame:
    """One row per column that a statement creates, adds, modifies or changes, in the shape of a catalogue's columns.

    ``column_width`` is null where the statement gives none.
    """
    c = F.col
    rows = _column_items(defined)
    rest = c("_rest")
    held = lambda number: F.get(F.filter("_literals", lambda s: s["n"] == number), F.lit(0))["text"]
    key = rest.rlike(r"(?i)\bPRIMARY\s+KEY\b") | F.array_contains("_pk", F.lower("column_name"))
    value = F.nullif(F.regexp_extract("_rest", DEFAULT, 1), F.lit(""))
    value = F.when(value.rlike(NOW), "CURRENT_TIMESTAMP").when(F.upper(value) != "NULL", _literal(value, held))
    other = c("_type")
    for name, same in TYPE_NAMES.items():
        other = F.when(c("_type") == name, same).otherwise(other)
    return rows.select(
        *KEYS,
        "ordinal",
        "column_name",
        other.alias("data_type"),
        F.nullif(F.regexp_extract("_size", r"^\s*([0-9]+)", 1), F.lit("")).cast("bigint").alias("column_width"),
        rest.rlike(r"(?i)\bUNSIGNED\b").alias("is_unsigned"),
        key.alias("is_primary_key"),
        (~(key | rest.rlike(r"(?i)\bNOT\s+NULL\b"))).alias("is_nullable"),
        rest.rlike(r"(?i)\bAUTO_INCREMENT\b").alias("is_auto_increment"),
        value.alias("default_value"),
        F.when(rest.rlike(r"(?i)\bON\s+UPDATE\s+(?:CURRENT_TIMESTAMP|NOW)\b"), "on update CURRENT_TIMESTAMP").otherwise("").alias("extra"),
        F.coalesce(_literal(_option(rest, "COMMENT", "('[0-9]+')"), held), F.lit("")).alias("column_comment"),
        F.lower(_option(rest, r"CHARACTER\s+SET|CHARSET", r"(\w+)")).alias("charset"),
        F.lower(_option(rest, "COLLATE", r"(\w+)")).alias("collation_name"),
    )


def defined_indexes(defined: DataFrame) -> DataFrame:
    """One row per index and column, in the shape of a catalogue's indexes.

    A primary key without a name is ``PRIMARY``, another index without one is
    named after its first column. An indexed expression has no column name.
    """
    c = F.col
    rows = _column_items(defined)
    primary = c("_rest").rlike(r"(?i)\bPRIMARY\s+KEY\b")
    unique = c("_rest").rlike(r"(?i)\bUNIQUE\b")
    kinds = F.array_compact(F.array(F.when(primary, F.lit("PRIMARY KEY")), F.when(unique, F.lit("INDEX"))))
    inline = rows.select(*KEYS, "ordinal", "column_name", F.explode(kinds).alias("constraint_type")).select(
        *KEYS,
        F.when(c("constraint_type") == "INDEX", c("column_name")).otherwise("PRIMARY").alias("index_name"),
        "column_name",
        F.lit(True).alias("is_unique"),
        F.lit("BTREE").alias("index_type"),
        "constraint_type",
        # only one column can be the primary key by itself; more of them keep their order
        F.when(c("constraint_type") == "INDEX", F.lit(1)).otherwise(c("ordinal") + 1).cast("bigint").alias("seq"),
    )
    return _index_items(defined).unionByName(inline)
