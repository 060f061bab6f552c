"""Statement shapes for the derived ``statement_corpus`` view.

``#`` stands for the key of the row the statement is derived from. The shapes
are inputs only: each text rule has at least one shape that breaks it.
"""

_LONG = "SELECT o_orderkey FROM orders WHERE o_comment = '" + "long text " * 110 + "#' LIMIT 1"
_MANY_IN = "SELECT o_orderkey FROM orders WHERE o_custkey IN (" + ",".join(str(i) for i in range(1, 61)) + ",#) ORDER BY o_orderkey LIMIT 5"
_MORE_IN = "DELETE FROM orders WHERE o_custkey IN (" + ",".join(str(i) for i in range(1, 520)) + ",#) LIMIT 9"
_MANY_ROWS = "INSERT INTO customer (c_custkey) VALUES " + ",".join(f"({i})" for i in range(110)) + ",(#)"
_MANY_MARKS = "SELECT c FROM t WHERE a = # AND b IN (" + ",".join("?" * 105) + ") LIMIT 3"

SHAPES = [
    "SELECT * FROM orders WHERE o_custkey = #",
    "select o_orderkey from orders where o_orderpriority like '%#' order by rand()",
    "UPDATE customer SET c_acctbal = # WHERE c_custkey = #",
    "INSERT INTO customer VALUES (#, 'name#')",
    "DELETE FROM lineitem",
    "SELECT COUNT(*) FROM orders",
    "SELECT c_name FROM customer WHERE 1 = 1 AND c_custkey > # LIMIT 2000",
    "SELECT c_name FROM customer WHERE TRUE",
    "UPDATE part SET p_name = 'x#' LIMIT 10",
    "DELETE FROM part WHERE p_partkey = # ORDER BY p_partkey LIMIT 5",
    "SELECT a.c_name, b.o_orderkey FROM customer a JOIN orders b WHERE a.c_custkey = #",
    "SELECT a.c_name FROM customer a JOIN orders b ON a.c_custkey = b.o_custkey JOIN lineitem l ON l.l_orderkey = b.o_orderkey JOIN part p ON p.p_partkey = l.l_partkey WHERE a.c_custkey = # LIMIT 1",
    "SELECT c_name FROM customer WHERE c_custkey NOT IN (#, 2) AND c_name <> 'x'",
    "SELECT c_name FROM customer WHERE c_custkey != # AND c_name IS NULL",
    "SELECT c_name FROM customer WHERE c_custkey IN (NULL, #)",
    "SELECT c_name FROM customer WHERE c_name LIKE 'abc#' LIMIT 20, 10",
    "SELECT c_name FROM customer WHERE c_name LIKE 'abc%' LIMIT 10 OFFSET 20#",
    "SELECT c_name FROM customer WHERE c_name = ' padded#'",
    "SELECT c_name FROM customer WHERE c_custkey = (SELECT MAX(o_custkey) FROM orders WHERE o_orderkey = #)",
    "SELECT c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderkey > # LIMIT 3)",
    "SELECT a FROM t1 WHERE b IN (SELECT b FROM t2 WHERE c IN (SELECT c FROM t3 WHERE d IN (SELECT d FROM t4 WHERE e IN (SELECT e FROM t5 WHERE f IN (SELECT f FROM t6 WHERE g IN (SELECT g FROM t7 WHERE h = #))))))",
    "SELECT c_name FROM customer WHERE c_custkey = # FOR UPDATE",
    "SELECT c_name FROM customer WHERE c_custkey = # UNION SELECT s_name FROM supplier WHERE s_suppkey = #",
    "SELECT c_name FROM customer WHERE c_custkey = # UNION ALL SELECT s_name FROM supplier WHERE s_suppkey = #",
    "SELECT c_nationkey, SUM(c_acctbal) FROM customer WHERE c_custkey > # GROUP BY 1",
    "SELECT c_nationkey, COUNT(c_name) FROM customer WHERE c_custkey > # GROUP BY c_nationkey HAVING COUNT(c_name) > 3",
    "SELECT c_name FROM customer WHERE c_custkey > # ORDER BY c_name DESC, c_nationkey LIMIT 3",
    "SELECT c_name FROM customer WHERE c_custkey > # ORDER BY c_acctbal + 1, c_a, c_b, c_c LIMIT 3",
    "SELECT SYSDATE(), c_name FROM customer WHERE c_custkey = #",
    "SELECT SLEEP(5) FROM customer WHERE c_custkey = #",
    "SELECT MD5(c_name), SQRT(c_acctbal) FROM customer WHERE c_custkey = #",
    "SELECT GROUP_CONCAT(c_name) FROM customer WHERE FIND_IN_SET(c_name, 'a,b') AND c_custkey = #",
    "SELECT /*+ MAX_EXECUTION_TIME(100) */ c_name FROM customer WHERE c_custkey = #",
    "SELECT c_name FROM customer FORCE INDEX (idx_a) WHERE c_custkey = # ORDER BY c_name",
    "SELECT c_name FROM customer WHERE c_name = NULL AND c_custkey = #",
    "SELECT c_name FROM customer WHERE UPPER(c_name) = 'A#' OR c_custkey + 1 = 5",
    "INSERT INTO customer (c_custkey, c_name) SELECT o_custkey, 'x' FROM orders WHERE o_orderkey = #",
    "INSERT INTO customer (c_custkey) VALUES (#)",
    "REPLACE INTO customer (c_custkey) VALUES (#)",
    "TRUNCATE TABLE t#",
    "DROP TABLE t#",
    "DROP DATABASE shop#",
    "DROP INDEX idx_a ON t#",
    "DROP INDEX `PRIMARY` ON t#",
    "CREATE TABLE t# (id BIGINT UNSIGNED NOT NULL AUTO_INCREMENT PRIMARY KEY, name VARCHAR(20))",
    "CREATE TABLE IF NOT EXISTS t# (id INT NULL, KEY idx_id (id)) TABLESPACE innodb_system",
    "CREATE TEMPORARY TABLE work# (id INT)",
    "CREATE TEMPORARY TABLE tmp_# (id INT NOT NULL, KEY idx_id (id))",
    "CREATE VIEW v# AS SELECT c_name FROM customer",
    "CREATE TRIGGER tr# BEFORE INSERT ON t FOR EACH ROW SET NEW.a = 1",
    "CREATE FUNCTION f#() RETURNS INT RETURN 1",
    "CREATE PROCEDURE p#() SELECT 1",
    "CREATE EVENT e# ON SCHEDULE EVERY 1 DAY DO DELETE FROM t WHERE a = 1",
    "ALTER TABLE t# ADD COLUMN a INT NOT NULL DEFAULT 0 COMMENT 'a' FIRST",
    "ALTER TABLE t# ADD COLUMN b INT AFTER a",
    "ALTER TABLE t# DROP COLUMN a",
    "ALTER TABLE t# DROP PRIMARY KEY",
    "ALTER TABLE t# DROP FOREIGN KEY fk_a",
    "ALTER TABLE t# DEFAULT CHARACTER SET utf8mb4",
    "ALTER TABLE t# CHANGE a b INT",
    "RENAME TABLE t# TO u#",
    "ALTER TABLE t# RENAME TO u#",
    "ALTER TABLE t# AUTO_INCREMENT = 100",
    "CREATE TABLE `t“#”` (id INT)",
    "SET SESSION TRANSACTION ISOLATION LEVEL REPEATABLE READ",
    "SET SESSION TRANSACTION ISOLATION LEVEL READ COMMITTED",
    "SET auto_increment_increment = 2#",
    "GRANT ALL PRIVILEGES ON *.* TO 'u#'@'%' WITH GRANT OPTION",
    "GRANT SELECT ON shop.t TO 'u#'@'%'",
    "SELECT o.o_orderkey FROM orders o JOIN orders p ON o.o_custkey = p.o_custkey JOIN orders q ON q.o_custkey = p.o_custkey JOIN orders r ON r.o_custkey = q.o_custkey WHERE o.o_orderkey = #",
    "SELECT shop.orders.o_orderkey FROM shop.orders WHERE o_orderkey = # LIMIT 1",
    "SELECT c_name customer FROM customer WHERE c_custkey = #",
    "SELECT c_name AS c_name FROM customer AS c WHERE c_custkey = '#'",
    "UPDATE customer SET c_custkey = 5 WHERE c_name = 'n#' ORDER BY c_name",
    "SELECT MAX(o_totalprice), MIN(o_totalprice) FROM orders WHERE o_custkey = #",
    "SELECT c_name FROM customer c, orders o WHERE c.c_custkey = # OR o.o_orderkey = 3",
    "SELECT DISTINCT c_name -- trailing note; #\nFROM customer WHERE c_custkey = #",
    "SELECT c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = #)",
    "SELECT c_name FROM customer ORDER BY c_name",
    "SELECT # FROM dual",
    "garbage statement #",
    "CREATE INDEX idx_a ON t# (a, b)",
    "CREATE DATABASE shop#",
    "ALTER TABLE t# ADD INDEX idx_c (c)",
    "SELECT SUM(o_totalprice) FROM orders WHERE o_custkey BETWEEN 1 AND #",
    _LONG, _MANY_IN, _MORE_IN, _MANY_ROWS, _MANY_MARKS,
]

SHAPE_COUNT = len(SHAPES)


def _literal(text: str) -> str:
    # A newline inside a literal is written with CHR so both engines read it alike.
    parts = ["'" + p.replace("'", "''") + "'" for p in text.split("\n")]
    return parts[0] if len(parts) == 1 else "CONCAT(" + ", CHR(10), ".join(parts) + ")"


SHAPE_VALUES = ", ".join(f"({k}, {_literal(s)})" for k, s in enumerate(SHAPES))
