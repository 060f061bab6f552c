"""Columns of each statement shape, taken from a run and then read against the shape's text.

Each line: shape, table, column, clause, position, operator, function, literal kind,
other table, other column.
"""

ROWS = [
    (0, 'orders', '*', 'select', None, None, None, None, None, None, None),
    (0, 'orders', None, 'table', 0, None, None, None, None, None, None),
    (0, 'orders', 'o_custkey', 'where', 0, '=', None, 'number', None, None, False),
    (1, 'orders', None, 'table', 0, None, None, None, None, None, None),
    (1, 'orders', 'o_orderkey', 'select', 0, None, None, None, None, None, None),
    (1, 'orders', 'o_orderpriority', 'where', 0, 'LIKE', None, 'string', None, None, False),
    (2, 'customer', None, 'table', 0, None, None, None, None, None, None),
    (2, 'customer', 'c_acctbal', 'set', None, None, None, 'number', None, None, None),
    (2, 'customer', 'c_custkey', 'where', 0, '=', None, 'number', None, None, False),
    (3, 'customer', None, 'table', 0, None, None, None, None, None, None),
    (4, 'lineitem', None, 'table', 0, None, None, None, None, None, None),
    (5, 'orders', None, 'table', 0, None, None, None, None, None, None),
    (6, 'customer', None, 'table', 0, None, None, None, None, None, None),
    (6, 'customer', 'c_custkey', 'where', 0, '>', None, 'number', None, None, False),
    (6, 'customer', 'c_name', 'select', 0, None, None, None, None, None, None),
    (7, 'customer', None, 'table', 0, None, None, None, None, None, None),
    (7, 'customer', 'c_name', 'select', 0, None, None, None, None, None, None),
    (8, 'part', None, 'table', 0, None, None, None, None, None, None),
    (8, 'part', 'p_name', 'set', None, None, None, 'string', None, None, None),
    (9, 'part', None, 'table', 0, None, None, None, None, None, None),
    (9, 'part', 'p_partkey', 'order', 0, 'ASC', None, None, None, None, None),
    (9, 'part', 'p_partkey', 'where', 0, '=', None, 'number', None, None, False),
    (10, 'customer', None, 'table', 0, None, None, None, None, None, None),
    (10, 'customer', 'c_custkey', 'where', 0, '=', None, 'number', None, None, False),
    (10, 'customer', 'c_name', 'select', 0, None, None, None, None, None, None),
    (10, 'orders', None, 'table', 1, None, None, None, None, None, None),
    (10, 'orders', 'o_orderkey', 'select', 1, None, None, None, None, None, None),
    (11, 'customer', None, 'table', 0, None, None, None, None, None, None),
    (11, 'customer', 'c_custkey', 'where', 0, '=', None, 'number', None, None, False),
    (11, 'customer', 'c_name', 'select', 0, None, None, None, None, None, None),
    (11, 'lineitem', None, 'table', 2, None, None, None, None, None, None),
    (11, 'lineitem', 'l_orderkey', 'join', 1, '=', None, 'column', 'orders', 'o_orderkey', False),
    (11, 'orders', None, 'table', 1, None, None, None, None, None, None),
    (11, 'orders', 'o_custkey', 'join', 0, '=', None, 'column', 'customer', 'c_custkey', False),
    (11, 'part', None, 'table', 3, None, None, None, None, None, None),
    (11, 'part', 'p_partkey', 'join', 2, '=', None, 'column', 'lineitem', 'l_partkey', False),
    (12, 'customer', None, 'table', 0, None, None, None, None, None, None),
    (12, 'customer', 'c_custkey', 'where', 0, 'NOT IN', None, 'list', None, None, False),
    (12, 'customer', 'c_name', 'select', 0, None, None, None, None, None, None),
    (12, 'customer', 'c_name', 'where', 1, '<>', None, 'string', None, None, False),
    (13, 'customer', None, 'table', 0, None, None, None, None, None, None),
    (13, 'customer', 'c_custkey', 'where', 0, '!=', None, 'number', None, None, False),
    (13, 'customer', 'c_name', 'select', 0, None, None, None, None, None, None),
    (13, 'customer', 'c_name', 'where', 1, 'IS NULL', None, None, None, None, False),
    (14, 'customer', None, 'table', 0, None, None, None, None, None, None),
    (14, 'customer', 'c_custkey', 'where', 0, 'IN', None, 'list', None, None, False),
    (14, 'customer', 'c_name', 'select', 0, None, None, None, None, None, None),
    (15, 'customer', None, 'table', 0, None, None, None, None, None, None),
    (15, 'customer', 'c_name', 'select', 0, None, None, None, None, None, None),
    (15, 'customer', 'c_name', 'where', 0, 'LIKE', None, 'string', None, None, False),
    (16, 'customer', None, 'table', 0, None, None, None, None, None, None),
    (16, 'customer', 'c_name', 'select', 0, None, None, None, None, None, None),
    (16, 'customer', 'c_name', 'where', 0, 'LIKE', None, 'string', None, None, False),
    (17, 'customer', None, 'table', 0, None, None, None, None, None, None),
    (17, 'customer', 'c_name', 'select', 0, None, None, None, None, None, None),
    (17, 'customer', 'c_name', 'where', 0, '=', None, 'string', None, None, False),
    (18, 'customer', None, 'table', 0, None, None, None, None, None, None),
    (18, 'customer', 'c_custkey', 'where', 0, '=', None, 'list', None, None, False),
    (18, 'customer', 'c_name', 'select', 0, None, None, None, None, None, None),
    (19, 'customer', None, 'table', 0, None, None, None, None, None, None),
    (19, 'customer', 'c_custkey', 'where', 0, 'IN', None, 'list', None, None, False),
    (19, 'customer', 'c_name', 'select', 0, None, None, None, None, None, None),
    (20, 't1', None, 'table', 0, None, None, None, None, None, None),
    (20, 't1', 'a', 'select', 0, None, None, None, None, None, None),
    (20, 't1', 'b', 'where', 0, 'IN', None, 'list', None, None, False),
    (21, 'customer', None, 'table', 0, None, None, None, None, None, None),
    (21, 'customer', 'c_custkey', 'where', 0, '=', None, 'number', None, None, False),
    (21, 'customer', 'c_name', 'select', 0, None, None, None, None, None, None),
    (22, 'customer', None, 'table', 0, None, None, None, None, None, None),
    (22, 'customer', 'c_custkey', 'where', 0, '=', None, 'number', None, None, False),
    (22, 'customer', 'c_name', 'select', 0, None, None, None, None, None, None),
    (23, 'customer', None, 'table', 0, None, None, None, None, None, None),
    (23, 'customer', 'c_custkey', 'where', 0, '=', None, 'number', None, None, False),
    (23, 'customer', 'c_name', 'select', 0, None, None, None, None, None, None),
    (24, 'customer', None, 'table', 0, None, None, None, None, None, None),
    (24, 'customer', 'c_acctbal', 'select', None, None, 'SUM', None, None, None, None),
    (24, 'customer', 'c_custkey', 'where', 0, '>', None, 'number', None, None, False),
    (24, 'customer', 'c_nationkey', 'select', 0, None, None, None, None, None, None),
    (25, 'customer', None, 'table', 0, None, None, None, None, None, None),
    (25, 'customer', 'c_custkey', 'where', 0, '>', None, 'number', None, None, False),
    (25, 'customer', 'c_name', 'select', None, None, 'COUNT', None, None, None, None),
    (25, 'customer', 'c_nationkey', 'group', 0, None, None, None, None, None, None),
    (25, 'customer', 'c_nationkey', 'select', 0, None, None, None, None, None, None),
    (26, 'customer', None, 'table', 0, None, None, None, None, None, None),
    (26, 'customer', 'c_custkey', 'where', 0, '>', None, 'number', None, None, False),
    (26, 'customer', 'c_name', 'order', 0, 'DESC', None, None, None, None, None),
    (26, 'customer', 'c_name', 'select', 0, None, None, None, None, None, None),
    (26, 'customer', 'c_nationkey', 'order', 1, 'ASC', None, None, None, None, None),
    (27, 'customer', None, 'table', 0, None, None, None, None, None, None),
    (27, 'customer', 'c_a', 'order', 1, 'ASC', None, None, None, None, None),
    (27, 'customer', 'c_b', 'order', 2, 'ASC', None, None, None, None, None),
    (27, 'customer', 'c_c', 'order', 3, 'ASC', None, None, None, None, None),
    (27, 'customer', 'c_custkey', 'where', 0, '>', None, 'number', None, None, False),
    (27, 'customer', 'c_name', 'select', 0, None, None, None, None, None, None),
    (28, 'customer', None, 'table', 0, None, None, None, None, None, None),
    (28, 'customer', 'c_custkey', 'where', 0, '=', None, 'number', None, None, False),
    (28, 'customer', 'c_name', 'select', 1, None, None, None, None, None, None),
    (29, 'customer', None, 'table', 0, None, None, None, None, None, None),
    (29, 'customer', 'c_custkey', 'where', 0, '=', None, 'number', None, None, False),
    (30, 'customer', None, 'table', 0, None, None, None, None, None, None),
    (30, 'customer', 'c_acctbal', 'select', None, None, 'SQRT', None, None, None, None),
    (30, 'customer', 'c_custkey', 'where', 0, '=', None, 'number', None, None, False),
    (30, 'customer', 'c_name', 'select', None, None, 'MD5', None, None, None, None),
    (31, 'customer', None, 'table', 0, None, None, None, None, None, None),
    (31, 'customer', 'c_custkey', 'where', 0, '=', None, 'number', None, None, False),
    (31, 'customer', 'c_name', 'select', None, None, 'GROUP_CONCAT', None, None, None, None),
    (31, 'customer', 'c_name', 'where', None, None, 'FIND_IN_SET', None, None, None, False),
    (32, 'customer', None, 'table', 0, None, None, None, None, None, None),
    (32, 'customer', 'c_custkey', 'where', 0, '=', None, 'number', None, None, False),
    (32, 'customer', 'c_name', 'select', 0, None, None, None, None, None, None),
    (33, 'customer', None, 'table', 0, None, None, None, None, None, None),
    (33, 'customer', 'c_custkey', 'where', 0, '=', None, 'number', None, None, False),
    (33, 'customer', 'c_name', 'order', 0, 'ASC', None, None, None, None, None),
    (33, 'customer', 'c_name', 'select', 0, None, None, None, None, None, None),
    (34, 'customer', None, 'table', 0, None, None, None, None, None, None),
    (34, 'customer', 'c_custkey', 'where', 1, '=', None, 'number', None, None, False),
    (34, 'customer', 'c_name', 'select', 0, None, None, None, None, None, None),
    (34, 'customer', 'c_name', 'where', 0, '=', None, 'null', None, None, False),
    (35, 'customer', None, 'table', 0, None, None, None, None, None, None),
    (35, 'customer', 'c_custkey', 'where', None, '=', '+', 'number', None, None, True),
    (35, 'customer', 'c_name', 'select', 0, None, None, None, None, None, None),
    (35, 'customer', 'c_name', 'where', None, '=', 'UPPER', 'string', None, None, True),
    (36, 'customer', 'c_custkey', 'insert', 0, None, None, None, None, None, None),
    (36, 'customer', 'c_name', 'insert', 1, None, None, None, None, None, None),
    (36, 'orders', None, 'table', 0, None, None, None, None, None, None),
    (36, 'orders', 'o_orderkey', 'where', 0, '=', None, 'number', None, None, False),
    (37, 'customer', None, 'table', 0, None, None, None, None, None, None),
    (37, 'customer', 'c_custkey', 'insert', 0, None, None, None, None, None, None),
    (38, 'customer', None, 'table', 0, None, None, None, None, None, None),
    (38, 'customer', 'c_custkey', 'insert', 0, None, None, None, None, None, None),
    (69, 'orders', None, 'table', 0, None, None, None, None, None, None),
    (69, 'orders', None, 'table', 1, None, None, None, None, None, None),
    (69, 'orders', None, 'table', 2, None, None, None, None, None, None),
    (69, 'orders', None, 'table', 3, None, None, None, None, None, None),
    (69, 'orders', 'o_custkey', 'join', 0, '=', None, 'column', 'orders', 'o_custkey', False),
    (69, 'orders', 'o_custkey', 'join', 1, '=', None, 'column', 'orders', 'o_custkey', False),
    (69, 'orders', 'o_custkey', 'join', 2, '=', None, 'column', 'orders', 'o_custkey', False),
    (69, 'orders', 'o_orderkey', 'select', 0, None, None, None, None, None, None),
    (69, 'orders', 'o_orderkey', 'where', 0, '=', None, 'number', None, None, False),
    (70, 'orders', None, 'table', 0, None, None, None, None, None, None),
    (70, 'orders', 'o_orderkey', 'select', 0, None, None, None, None, None, None),
    (70, 'orders', 'o_orderkey', 'where', 0, '=', None, 'number', None, None, False),
    (71, 'customer', None, 'table', 0, None, None, None, None, None, None),
    (71, 'customer', 'c_custkey', 'where', 0, '=', None, 'number', None, None, False),
    (71, 'customer', 'c_name', 'select', 0, None, None, None, None, None, None),
    (71, 'customer', 'customer', 'alias', 0, None, None, None, None, None, None),
    (72, 'customer', None, 'table', 0, None, None, None, None, None, None),
    (72, 'customer', 'c_custkey', 'where', 0, '=', None, 'string', None, None, False),
    (72, 'customer', 'c_name', 'alias', 0, None, None, None, None, 'c_name', None),
    (72, 'customer', 'c_name', 'select', 0, None, None, None, None, None, None),
    (73, 'customer', None, 'table', 0, None, None, None, None, None, None),
    (73, 'customer', 'c_custkey', 'set', None, None, None, 'number', None, None, None),
    (73, 'customer', 'c_name', 'order', 0, 'ASC', None, None, None, None, None),
    (73, 'customer', 'c_name', 'where', 0, '=', None, 'string', None, None, False),
    (74, 'orders', None, 'table', 0, None, None, None, None, None, None),
    (74, 'orders', 'o_custkey', 'where', 0, '=', None, 'number', None, None, False),
    (74, 'orders', 'o_totalprice', 'select', None, None, 'MAX', None, None, None, None),
    (74, 'orders', 'o_totalprice', 'select', None, None, 'MIN', None, None, None, None),
    (75, None, 'c_name', 'select', 0, None, None, None, None, None, None),
    (75, 'customer', None, 'table', 0, None, None, None, None, None, None),
    (75, 'customer', 'c_custkey', 'where', 0, '=', None, 'number', None, None, True),
    (75, 'orders', None, 'table', 1, None, None, None, None, None, None),
    (75, 'orders', 'o_orderkey', 'where', 1, '=', None, 'number', None, None, True),
    (76, 'customer', None, 'table', 0, None, None, None, None, None, None),
    (76, 'customer', 'c_custkey', 'where', 0, '=', None, 'number', None, None, False),
    (76, 'customer', 'c_name', 'select', 0, None, None, None, None, None, None),
    (77, 'customer', None, 'table', 0, None, None, None, None, None, None),
    (77, 'customer', 'c_name', 'select', 0, None, None, None, None, None, None),
    (78, 'customer', None, 'table', 0, None, None, None, None, None, None),
    (78, 'customer', 'c_name', 'order', 0, 'ASC', None, None, None, None, None),
    (78, 'customer', 'c_name', 'select', 0, None, None, None, None, None, None),
    (79, 'dual', None, 'table', 0, None, None, None, None, None, None),
    (84, 'orders', None, 'table', 0, None, None, None, None, None, None),
    (84, 'orders', 'o_custkey', 'where', 0, 'BETWEEN', None, 'number', None, None, False),
    (84, 'orders', 'o_totalprice', 'select', None, None, 'SUM', None, None, None, None),
    (85, 'orders', None, 'table', 0, None, None, None, None, None, None),
    (85, 'orders', 'o_comment', 'where', 0, '=', None, 'string', None, None, False),
    (85, 'orders', 'o_orderkey', 'select', 0, None, None, None, None, None, None),
    (86, 'orders', None, 'table', 0, None, None, None, None, None, None),
    (86, 'orders', 'o_custkey', 'where', 0, 'IN', None, 'list', None, None, False),
    (86, 'orders', 'o_orderkey', 'order', 0, 'ASC', None, None, None, None, None),
    (86, 'orders', 'o_orderkey', 'select', 0, None, None, None, None, None, None),
    (87, 'orders', None, 'table', 0, None, None, None, None, None, None),
    (87, 'orders', 'o_custkey', 'where', 0, 'IN', None, 'list', None, None, False),
    (88, 'customer', None, 'table', 0, None, None, None, None, None, None),
    (88, 'customer', 'c_custkey', 'insert', 0, None, None, None, None, None, None),
    (89, 't', None, 'table', 0, None, None, None, None, None, None),
    (89, 't', 'a', 'where', 0, '=', None, 'number', None, None, False),
    (89, 't', 'b', 'where', 1, 'IN', None, 'list', None, None, False),
    (89, 't', 'c', 'select', 0, None, None, None, None, None, None),
]
