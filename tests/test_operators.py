"""Lists, scores, profiles, merges and files on small hand-made inputs."""

import ipaddress
import random

import pytest
from pyspark.sql import functions as F

from stmtwarden.lint.catalog_rules import redundant_index
from stmtwarden.operators import advice, lists, merge, profile, score, series
from stmtwarden.sources import files, pull

BLOCK_SCHEMA = "id long, filter_type string, content string"
STATEMENT_SCHEMA = "id long, endpoints array<string>, sql_text string, sql_fingerprint string, instance_id string, db_user string"


def match(spark, entries, rows):
    block = spark.createDataFrame(entries, BLOCK_SCHEMA)
    df = spark.createDataFrame(rows, STATEMENT_SCHEMA)
    return {r["id"]: r["matched_id"] for r in lists.blocklist_match(df, block).collect()}


ENTRIES = [
    (1, "cidr", "192.168.1.0/24"), (2, "ip", "10.0.0.1"), (3, "host", "Build.example"), (4, "sql", "DROP TABLE"), (5, "fp_sql", "from secret"),
    (6, "instance", "prod"), (7, "db_user", "root"), (8, "cidr", "0.0.0.0/32"), (9, "ip", "fe80::1"),
]
ROWS = [
    (1, ["192.168.1.77"], "x", "x", "i", "u"),
    (2, ["192.168.2.77"], "x", "x", "i", "u"),
    (3, ["1.1.1.1", "10.0.0.1"], "x", "x", "i", "u"),
    (4, ["ci.BUILD.example.org"], "x", "x", "i", "u"),
    (5, [], "a\nDrop Table\nb", "x", "i", "u"),
    (6, [], "x", "SELECT * FROM SECRET", "prod", "root"),
    (7, [], "x", "x", "prod", "root"),
    (8, [], "x", "x", "i", "root"),
    (9, [], "x", "x", "Prod", ""),
    (10, ["fe80::1"], "drop table", "x", "i", "u"),
    (11, ["256.1.1.1"], "x", "x", "i", "u"),
]
EXPECTED = {1: 1, 2: None, 3: 2, 4: 3, 5: 4, 6: 5, 7: 6, 8: 7, 9: None, 10: 9, 11: None}


def test_blocklist_order_and_kinds(spark):
    assert match(spark, ENTRIES, ROWS) == EXPECTED


NETWORKS = ["fe80::/10", "2001:db8::/33", "::/0", "10.0.0.0/8", "0.0.0.0/0", "1.2.3.4/32", "::ffff:1.2.3.4/128", "1:2:3:4:5:6:7:8/127", "::1/128"]
BAD = ["10.0.0.0/33", "10.0.0.0", "10.0.0/8", "fe80::/129", "x/8", "1::2::3/8", "1:2:3/16", "010.0.0.0/8", "1.2.3.4/-1", "fe80::/", ":::/8", None]
ADDRESSES = ["fe80::1", "FEBF::1", "fec0::1", "2001:db8:7fff::", "2001:db8:8000::1", "10.255.0.1", "11.0.0.1", "1.2.3.4", "::ffff:1.2.3.4", "1:2:3:4:5:6:7:9", "1:2:3:4:5:6:7:a", "::1", "::", "1::2::3", "12:3"]


@pytest.mark.parametrize("network", NETWORKS)
def test_networks_of_both_versions(spark, network):
    net = ipaddress.ip_network(network, strict=False)

    def inside(a):
        try:
            return ipaddress.ip_address(a) in net
        except ValueError:
            return False

    got = match(spark, [(1, "cidr", network)], [(n, [a], "x", "x", "i", "u") for n, a in enumerate(ADDRESSES)])
    assert {ADDRESSES[n] for n, m in got.items() if m} == {a for a in ADDRESSES if inside(a)}


def test_bad_entries_match_nothing_and_are_reported(spark):
    entries = [(n, "cidr", x) for n, x in enumerate(BAD)] + [(50, "sql", None), (51, "cidr", "1.2.3.4/32")]
    assert match(spark, entries, [(n, [a], "x", "x", "i", "u") for n, a in enumerate(ADDRESSES)]) == {n: 51 if a == "1.2.3.4" else None for n, a in enumerate(ADDRESSES)}
    assert {r.id for r in lists.bad_entries(spark.createDataFrame(entries, BLOCK_SCHEMA)).collect()} == {*range(len(BAD)), 50}


def first_match(entries, row):
    """The rule itself: endpoints in turn (address, then network, or host), then text, fingerprint, instance and user."""
    _, ends, text, fp, instance, user = row

    def first(kind, test):
        return next((i for i, k, c in sorted(entries) if k == kind and test(c)), None)

    for e in ends:
        try:
            ip = ipaddress.ip_address(e)
            hit = first("ip", lambda c: c == e) or first("cidr", lambda c: ip in ipaddress.ip_network(c, strict=False))
        except ValueError:
            hit = first("host", lambda c: c.lower() in e.lower())
        if hit:
            return hit
    return (
        first("sql", lambda c: c.lower() in text.lower()) or first("fp_sql", lambda c: c.lower() in fp.lower())
        or first("instance", lambda c: c == instance) or (first("db_user", lambda c: c == user) if user else None)
    )


def test_lists_of_all_kinds(spark):
    rnd = random.Random(7)
    words = ["alpha", "beta", "gamma delta", "x", "select", "from t where", "", "ab"]
    kinds = ["sql", "fp_sql", "ip", "cidr", "host", "instance", "db_user"]
    value = {"ip": lambda: f"10.0.{rnd.randint(0, 2)}.{rnd.randint(0, 5)}", "cidr": lambda: f"10.0.{rnd.randint(0, 2)}.0/{rnd.choice([0, 8, 24, 30, 32])}",
             "host": lambda: rnd.choice(["db", "web.x"]), "instance": lambda: f"i{rnd.randint(0, 3)}", "db_user": lambda: f"u{rnd.randint(0, 3)}"}
    entries = [(n + 1, k, value.get(k, lambda: rnd.choice(words[:6] + words[7:]))()) for n, k in enumerate(rnd.choices(kinds, k=12))]
    rows = [
        (n, rnd.sample([value["ip"](), "db.web.x", "none"], rnd.randint(0, 3)), " ".join(rnd.choices(words, k=4)).upper(), " ".join(rnd.choices(words, k=2)),
         f"i{rnd.randint(0, 6)}", rnd.choice(["", "u1", "u9"]))
        for n in range(200)
    ]
    assert match(spark, entries, rows) == {r[0]: first_match(entries, r) for r in rows}


def test_allowlist_takes_the_last_entry(spark):
    allow = spark.createDataFrame([(1, "exact_match", "select 1", None), (2, "fp_match", "", "SELECT ?"), (3, "exact_match", "SELECT 1", None)],
                                  "id long, match_type string, value string, fingerprint string")
    df = spark.createDataFrame([(1, "Select 1", "SELECT ?"), (2, "select 2", "SELECT ?"), (3, "other", "other")], "id long, sql_text string, sql_fingerprint string")
    assert {r.id: r.allowed_by for r in lists.allowlist_match(df, allow).collect()} == {1: 3, 2: 2, 3: None}


def test_priority_operators_and_bad_values(spark):
    df = spark.createDataFrame([(1, "error", "5", "root"), (2, "notice", "x", "app"), (3, "", "50", "app")], "id int, audit_level string, counter string, db_user string")
    conditions = (lists.Condition("audit_level", ">", "2", "int"), lists.Condition("counter", ">=", "50", "int"), lists.Condition("db_user", "CONTAINS", "root", "string"))
    got = {r.id: (r.priority, len(r.reasons)) for r in lists.high_priority(df, conditions).collect()}
    assert got == {1: ("high", 2), 2: ("", 0), 3: ("high", 1)}


@pytest.mark.parametrize(
    "levels, want",
    [(["normal"] * 4, (1.0, 100)), (["error"] * 4, (0.0, 0)), (["normal"] * 3 + ["error"], (0.75, 45)), (["normal"] * 19 + ["notice"], (0.95, 93)),
     (["warn", "normal"], (0.5, 57))],
)
def test_task_score(spark, levels, want):
    df = spark.createDataFrame([(1, lv) for lv in levels], "task_id int, audit_level string")
    r = score.task_score(df).first()
    assert (r.pass_rate, r.score) == want


def test_pass_rate_of_an_empty_task(spark):
    tasks = spark.createDataFrame([(1,), (2,)], "id int")
    df = spark.createDataFrame([(1, "warn")], "task_id int, audit_level string")
    assert {tuple(r) for r in score.task_pass_rate(tasks, df).collect()} == {(1, 0.0, "warn"), (2, 0.0, "")}


def test_profile_with_nulls_and_a_hot_value(spark):
    df = spark.createDataFrame([(i, "hot" if i % 3 else None, None) for i in range(90)], "k int, v string, empty string")
    got = {r.column_name: r for r in profile.column_profile(df, ["k", "v", "empty"], "t").collect()}
    assert (got["v"].distinct_count, got["v"].largest_group, got["v"].non_null_count, got["v"].max_width) == (1, 60, 60, 3)
    assert (got["empty"].distinct_count, got["empty"].largest_group, got["empty"].non_null_count) == (0, 90, 0)
    assert profile.all_null_columns(profile.column_profile(df, ["k", "v", "empty"], "t")).collect()[0].column_name == "empty"


def test_rollup_of_rollups(spark):
    rows = spark.range(1000).selectExpr("id", "concat('s', id % 7) AS sql_id", "concat('text ', id) AS sql_text", "timestamp_seconds(id % 50) AS ts")
    whole = {tuple(r) for r in merge.fingerprint_rollup(rows).collect()}
    halves = merge.fingerprint_rollup(rows.filter("id < 400")).unionByName(merge.fingerprint_rollup(rows.filter("id >= 400")))
    assert {tuple(r) for r in merge.fingerprint_rollup(halves).collect()} == whole


def test_redundant_indexes(spark):
    lists_ = spark.createDataFrame(
        [("t", "i1", ["a"]), ("t", "i2", ["a", "b"]), ("t", "i3", ["a", "b", "c"]), ("t", "i4", ["a", "b"]), ("t", "i5", ["ab"]), ("u", "j", ["a"])],
        "table_name string, index_name string, cols array<string>",
    )
    got = {(r.index_name, r.redundancy, r.covered_by) for r in redundant_index(lists_).collect()}
    assert got == {("i1", "redundant", "i3"), ("i2", "repeat", "i4"), ("i4", "redundant", "i3")}


def test_counter_rate_crosses_windows(spark):
    df = spark.createDataFrame([(1, "2024-01-01 00:59:50", 10), (2, "2024-01-01 01:00:00", 30), (3, "2024-01-01 04:00:00", 30)], "id int, t string, n int")
    df = df.select("id", F.lit("k").alias("key"), F.col("t").cast("timestamp_ntz").alias("ts"), "n")
    got = {r.id: r.rate for r in series.counter_rate(df, "key", "n").collect()}
    assert got == {1: None, 2: 2.0, 3: 0.0}


def test_function_index_by_version(spark):
    cols = spark.createDataFrame([(1, "t", "c", "where", "LOWER")], "id int, table_name string, column_name string, clause string, function string")
    scan = spark.createDataFrame([(1,)], "id int")
    reasons = [advice.function_index(cols, scan, v).first().reason for v in ("5.6.40", "5.7.3", "8.0.12", "8.0.13", "10.1.0")]
    assert reasons == ["rewrite without the function", "index on a virtual column", "index on a virtual column", "function index", "function index"]


def test_script_files(spark, tmp_path):
    (tmp_path / "a.sql").write_text("-- first\nSELECT 1;\n\n\nUPDATE t\nSET a = 'x;y'\nWHERE b = 2;  \nDELETE FROM t")
    (tmp_path / "b.txt").write_text("SELECT 9;")
    rows = files.sql_file_scan(files.read_texts(spark, str(tmp_path), "*.sql")).orderBy("position").collect()
    assert [(r.start_line, r.sql_text) for r in rows] == [(1, "-- first\nSELECT 1"), (5, "UPDATE t\nSET a = 'x;y'\nWHERE b = 2"), (8, "DELETE FROM t")]


def test_mapper_files(spark, tmp_path):
    (tmp_path / "m.xml").write_text(
        '<mapper><select id="a">SELECT * FROM t <where><if test="x != null">a = #{x}</if></where></select>'
        "<delete id='b'><![CDATA[DELETE FROM t WHERE a < 5]]></delete></mapper>"
    )
    rows = files.mapper_xml_scan(files.read_texts(spark, str(tmp_path), "*.xml")).collect()
    assert {(r.tag, r.sql_text) for r in rows} == {("select", "SELECT * FROM t WHERE a = ?"), ("delete", "DELETE FROM t WHERE a < 5")}


def test_export_drops_empty_columns_but_keeps_an_empty_report(spark, tmp_path):
    df = spark.createDataFrame([("a", " ", None), ("b", "", "")], "x string, y string, z string")
    assert files.export_report(df).columns == ["x"]
    assert files.export_report(df.filter("x = 'none'")).columns == ["x", "y", "z"]
    files.write_export(df, str(tmp_path / "out"))
    assert spark.read.option("header", True).csv(str(tmp_path / "out")).columns == ["x"]


def test_pull_start():
    from datetime import datetime, timedelta

    now = datetime(2024, 3, 1)
    assert pull.pull_start(now, None) == now - timedelta(hours=24)
    assert pull.pull_start(now, None, 10_000) == now - timedelta(hours=10_000)
    assert pull.pull_start(now, datetime(2023, 1, 1)) == datetime(2023, 1, 1)


def test_pages_upserts_and_orphans(spark):
    from stmtwarden.operators import retention, search

    df = spark.createDataFrame([(i,) for i in range(5)], "id int")
    assert [r.id for r in search.page(df, ["id"], None, 3).collect()] == [3, 4]
    assert [r.id for r in search.page(df, ["id"], 2, 1).collect()] == [1, 2]
    stored = spark.createDataFrame([("a", 1), ("b", 1)], "sql_id string, v int")
    new = spark.createDataFrame([("a", 2), ("a", 3), ("c", 4)], "sql_id string, v int")
    assert sorted((r.sql_id, r.v) for r in merge.record_upsert(stored, new, newest_by="v").collect()) == [("a", 3), ("b", 1), ("c", 4)]
    assert merge.record_upsert(stored, new).count() == 3
    records = spark.createDataFrame([(1, 1, "2024-01-01"), (2, 9, "2024-01-02"), (3, 9, None), (4, 1, None)], "id int, source_id int, t string")
    records = records.select("id", "source_id", F.col("t").cast("timestamp_ntz").alias("deleted_at"))
    sources = spark.createDataFrame([(1, False)], "id int, is_deleted boolean")
    got = {r.id: str(r.deleted_at)[:10] for r in retention.orphan_cleanup(records, sources, "2024-02-01").collect()}
    assert got == {1: "2024-01-01", 2: "2024-01-02", 3: "2024-02-01", 4: "None"}


def test_kind_of_changes_with_common_tables(spark):
    from stmtwarden.functions.text import sql_kind

    cases = {"WITH x AS (SELECT 1) DELETE FROM t": "DML", "with x as (select ')' ), y as (select 2) update t set a = 1": "DML", "WITH x AS (SELECT ') DELETE') SELECT 1": "DQL", "(SELECT 1)": "DQL", "DROP TABLE t": "DDL"}
    df = spark.createDataFrame([(k,) for k in cases], "s string")
    assert {r.s: r.k for r in df.select("s", sql_kind(F.col("s")).alias("k")).collect()} == cases


def test_blocklist_never_sends_statements_to_all_tasks(spark, tmp_path):
    """A stream's batch is planned from file sizes alone: a small file of statements must not become a join's broadcast side once it is cut into grams."""
    log = spark.createDataFrame([(n, ["10.0.0.1", "host"], "SELECT a", "SELECT a", "i1", "u1") for n in range(3)], "id long, endpoints array<string>, sql_text string, sql_fingerprint string, instance_id string, db_user string")
    log.write.parquet(f"{tmp_path}/log")
    kinds = ("sql", "fp_sql", "host", "instance", "db_user", "ip")
    spark.createDataFrame([(n, kinds[n % 6], chr(97 + n % 26) + "q") for n in range(3000)] + [(3000, "sql", " a"), (3001, "cidr", "10.0.0.0/8")], BLOCK_SCHEMA).write.parquet(f"{tmp_path}/list")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        found = lists.blocklist_match(spark.read.parquet(f"{tmp_path}/log"), spark.read.parquet(f"{tmp_path}/list"))
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert {r.matched_id for r in found.collect()} == {3001}
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert "BuildRight" in plan and "BuildLeft" not in plan
