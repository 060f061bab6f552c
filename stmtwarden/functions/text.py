"""Statement text functions: tokens, fingerprint, kind, tables.

All work on whole texts and stay in the JVM. The patterns use only syntax
that the checking engine's regexes share, except possessive quantifiers
(``*+``), which never change a match here but keep matching iterative on
long literals.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stmtwarden.functions.words import RESERVED_WORDS

STRING = r"""'[^'\\]*+(?:(?:\\[\s\S]|'')[^'\\]*+)*+'|"[^"\\]*+(?:(?:\\[\s\S]|"")[^"\\]*+)*+\""""
COMMENT = r"/\*[^*]*+\*+(?:[^/*][^*]*+\*+)*+/|--[^\n]*|#[^\n]*"
NUMBER = r"0[xX][0-9A-Fa-f]+|[0-9]+(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?|\.[0-9]+"
WORD = r"[A-Za-z_$@\x{80}-\x{10FFFF}][A-Za-z0-9_$@\x{80}-\x{10FFFF}]*|`[^`]*`"
TOKEN = f"{STRING}|{COMMENT}|{WORD}|{NUMBER}|<=>|<=|>=|<>|!=|:=|\\|\\||&&|[^\\s]"
STRING_OR_COMMENT = f"({STRING})|{COMMENT}"

# Keywords shown in upper case in a fingerprint, beside the reserved words.
KEYWORDS = """
ADD AFTER ALL ALTER ANALYZE AND AS ASC AUTO_INCREMENT AVG BEFORE BETWEEN BIGINT BINARY BLOB BY CALL CASCADE CASE CHANGE CHAR CHARACTER
CHECK COLLATE COLUMN COMMENT COMMIT CONSTRAINT COUNT CREATE CROSS CURRENT_DATE CURRENT_TIME CURRENT_TIMESTAMP DATABASE DATE DATETIME DECIMAL
DEFAULT DELAYED DELETE DESC DESCRIBE DISTINCT DIV DOUBLE DROP DUPLICATE EACH ELSE END ENGINE ENUM ESCAPE EVENT EXCEPT EXISTS EXPLAIN FALSE
FIRST FLOAT FOR FORCE FOREIGN FROM FULL FULLTEXT FUNCTION GRANT GROUP HAVING IF IGNORE IN INDEX INNER INSERT INT INTEGER INTERSECT INTERVAL
INTO IS JOIN KEY KEYS LEFT LIKE LIMIT LOCK MATCH MAX MIN MOD MODIFY NATURAL NOT NULL OFFSET ON OR ORDER OUTER PARTITION PRIMARY PROCEDURE
REFERENCES REGEXP RENAME REPLACE REVOKE RIGHT RLIKE ROLLBACK SCHEMA SELECT SESSION SET SHOW SMALLINT STRAIGHT_JOIN SUM TABLE TEMPORARY TEXT
THEN TIMESTAMP TINYINT TO TRANSACTION TRIGGER TRUE TRUNCATE UNION UNIQUE UNSIGNED UPDATE USE USING VALUES VARCHAR VIEW WHEN WHERE WITH XOR
""".split()

#: Words always shown in upper case.
UPPER_WORDS = sorted({*KEYWORDS, *RESERVED_WORDS})

# What stands before a name that a bracket may follow without making it a function.
BEFORE_NAMES = """
. INTO TABLE UPDATE INSERT REPLACE IGNORE FROM JOIN KEY INDEX UNIQUE FULLTEXT SPATIAL REFERENCES CONSTRAINT EXISTS WITH RECURSIVE VIEW PROCEDURE FUNCTION
CALL AS
""".split()

_LITERAL_STARTS = tuple("'\"0123456789")


def tokens(sql: Column) -> Column:
    """All tokens of a statement, comments included."""
    return F.regexp_extract_all(sql, F.lit(TOKEN), F.lit(0))


def _is_comment(t: Column) -> Column:
    # The two-character operators never start like this; a lone # or - is never a comment token.
    return t.startswith("/*") | t.startswith("--") | t.startswith("#")


def fingerprint(sql: Column, upper_names: bool = False) -> Column:
    """Each literal becomes ``?``, keywords and functions (or all words) are upper-cased.

    Token-level: spacing and comments do not matter, nesting is not looked at. A
    function is a word before a bracket, unless what precedes it makes it a name.
    A text without any token is returned as it is.
    """
    upper = F.upper
    kept = F.filter(tokens(sql), lambda t: ~_is_comment(t) & (t != ";"))
    # ".5" is a literal, a lone "." is not
    is_literal = lambda t: F.substring(t, 1, 1).isin(*_LITERAL_STARTS) | t.rlike(r"^\.[0-9]")

    def shown(k: Column) -> Column:
        creates = upper(F.get(k, F.lit(0))) == "CREATE"

        def is_function(t, i):
            before = F.coalesce(upper(F.get(k, i - 1)), F.lit(""))
            return (F.get(k, i + 1) == "(") & ~before.isin(BEFORE_NAMES) & ~((before == "ON") & creates) & ~F.startswith(t, F.lit("`"))

        def word(t, i):
            return upper(t) if upper_names else F.when(upper(t).isin(UPPER_WORDS), upper(t)).when(is_function(t, i), upper(t)).otherwise(t)

        return F.array_join(F.transform(k, lambda t, i: F.when(is_literal(t), "?").otherwise(word(t, i))), " ")

    # An array of one, so that the tokens are cut once and their neighbours looked up.
    text = F.get(F.transform(F.array(kept), shown), F.lit(0))
    return F.coalesce(F.nullif(text, F.lit("")), sql)


def strip_comments(sql: Column) -> Column:
    """Comments to a space, cut at the first ``;``, spaces collapsed."""
    bare = F.regexp_replace(F.regexp_replace(sql, r"(?s)/\*.*?\*/", " "), r"--[^\n]*", " ")
    return F.trim(F.regexp_replace(F.substring_index(bare, ";", 1), r"\s+", " "))


def code_text(sql: Column) -> Column:
    """Statement without comments and final ``;``, string literals kept."""
    may_comment = F.contains(sql, F.lit("--")) | F.contains(sql, F.lit("/*")) | F.contains(sql, F.lit("#"))
    bare = F.when(may_comment, F.regexp_replace(sql, STRING_OR_COMMENT, "$1 ")).otherwise(sql)
    return F.trim(F.regexp_replace(F.regexp_replace(bare, r"\s+", " "), r"[;\s]+$", ""))


def masked_code(code: Column) -> Column:
    """Upper-cased code with each string literal emptied, so that patterns
    never match inside a literal or a comment."""
    return F.upper(F.regexp_replace(code, STRING, "''"))


def masked_text(sql: Column) -> Column:
    return masked_code(code_text(sql))


#: A statement with common tables whose verb, after the last of them, changes rows.
WITH_CHANGE = r"^\s*WITH\b.*\)\s*(INSERT|UPDATE|DELETE|REPLACE)\b"


def sql_kind(sql: Column) -> Column:
    """DQL for queries, DML for changes of rows, else DDL."""
    text = masked_text(sql)
    return (
        F.when(text.rlike(WITH_CHANGE), "DML")
        .when(text.rlike(r"^[\s(]*(SELECT|WITH)\b"), "DQL")
        .when(text.rlike(r"^\s*(INSERT|UPDATE|DELETE|REPLACE)\b"), "DML")
        .otherwise("DDL")
    )


_TABLE_REF = (
    r"(?:FROM|JOIN|INTO|UPDATE)\s+((?:`[^`]*`|[A-Za-z_$][A-Za-z0-9_$]*)(?:\s*\.\s*(?:`[^`]*`|[A-Za-z_$][A-Za-z0-9_$]*))?)"
)
TABLE_REF = r"(?i)\b" + _TABLE_REF


def referenced_tables(statements: DataFrame, default_schema: str = "schema_name") -> DataFrame:
    """Distinct (id, schema, table) a data statement names after FROM, JOIN,
    INTO or UPDATE; the schema defaults to the statement's own."""
    dml = statements.filter(sql_kind(F.col("sql_text")) != "DDL")
    code = F.regexp_replace(code_text(F.col("sql_text")), STRING, "''")
    refs = F.array_distinct(F.transform(F.regexp_extract_all(code, F.lit(TABLE_REF), F.lit(1)), lambda r: F.regexp_replace(r, r"[`\s]", "")))
    one = dml.select("id", default_schema, F.explode(refs).alias("_ref"))
    dotted = F.col("_ref").contains(".")
    return one.select(
        "id",
        F.when(dotted, F.substring_index("_ref", ".", 1)).otherwise(F.col(default_schema)).alias("schema_name"),
        F.substring_index("_ref", ".", -1).alias("table_name"),
    ).distinct()
