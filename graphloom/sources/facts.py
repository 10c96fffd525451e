"""Program facts derived from the relational test tables, by SQL that Spark and DuckDB run alike.

Each fact is a query over base tables and earlier facts; `facts(spark, dir)` gives
them as DataFrames, `with_facts(sql)` puts the ones that a query needs before it.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from ..plans.storage import release, settle

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages")

SQL = {
    # Methods are parts; classes are part types and brands.
    "method": """
        SELECT p_partkey AS pid, '<com.' || lower(p_type) || '.' || replace(p_brand, '#',
            '') || ': void m' || CAST(p_partkey AS STRING) || '()>' AS sig,
               'com.' || lower(p_type) || '.' || replace(p_brand, '#', '') AS class,
                   'm' || CAST(p_partkey AS STRING) AS name,
               p_partkey * 10 AS line_start, p_partkey * 10 + p_size AS line_end, p_partkey AS ord,
                   p_size % 7 = 0 AS is_bridge
        FROM part""",
    # A call is a pair of neighbouring lines of an order.
    "part_call": """
        SELECT src, dst, CAST(min(line) AS BIGINT) AS call_line
        FROM (SELECT l_partkey AS src, lead(l_partkey) OVER (PARTITION BY l_orderkey
            ORDER BY l_linenumber, l_partkey) AS dst, l_linenumber AS line FROM lineitem)
        WHERE src <> dst GROUP BY src, dst""",
    "call_edge": """
        SELECT m.sig AS src, n.sig AS dst, c.call_line, CAST(row_number() OVER (PARTITION BY c.src
            ORDER BY c.dst) AS BIGINT) AS ord
        FROM part_call c JOIN method m ON m.pid = c.src JOIN method n ON n.pid = c.dst""",
    # The method of small and standard classes with the most callees.
    "root": "SELECT src AS sig FROM (SELECT src, count(*) AS n FROM call_edge WHERE src LIKE '<com.small.%' OR src LIKE '<com.standard.%' GROUP BY src ORDER BY n DESC, src LIMIT 1)",
    "bridge": "SELECT sig FROM method WHERE is_bridge",
    # Nations are classes that implement regions; customers call methods of regions.
    "class_rel": """
        SELECT n_name AS sub, r_name AS super, 'interface' AS rel FROM nation
            JOIN region ON n_regionkey = r_regionkey""",
    "impl_method": "SELECT '<' || n_name || ': void run()>' AS sig, n_name AS class, 'run' AS name, 0 AS arity FROM nation",
    "invoke": """
        SELECT '<' || c_mktsegment || ': void c' || CAST(c_custkey % 97 AS STRING) || '()>' AS caller,
            r_name AS decl_class, 'run' AS name, 0 AS arity,
               c_custkey % 50 AS line, c_custkey AS ord, c_custkey % 5 = 0 AS special
        FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
    # Statements are events of a user in order of time; n is their number, heir the first of the three before a statement.
    "stmt": """
        SELECT sig, event_id, o, local, count(*) OVER (PARTITION BY sig) AS n,
               coalesce(lag(local, 3) OVER (PARTITION BY sig ORDER BY o), lag(local, 2) OVER (PARTITION BY sig
                   ORDER BY o), lag(local, 1) OVER (PARTITION BY sig ORDER BY o)) AS heir
        FROM (SELECT user_id AS sig, event_id, event_type AS local, CAST(row_number() OVER (PARTITION BY user_id
            ORDER BY ts, event_id) AS BIGINT) AS o FROM events)""",
    "flow_edge": """
        SELECT sig, o AS src, o + CASE WHEN local = 'purchase' THEN 2 ELSE 1 END AS dst, CASE
            WHEN local = 'error' THEN 'F' END AS label
        FROM stmt WHERE o + CASE WHEN local = 'purchase' THEN 2 ELSE 1 END <= n
        UNION ALL SELECT sig, o, o + 3, 'T' FROM stmt WHERE local = 'error' AND o + 3 <= n""",
    "stmt_use": """
        SELECT sig, o AS stmt, CASE event_id % 5 WHEN 0 THEN 'click' WHEN 1 THEN 'error' WHEN 2 THEN 'purchase'
            WHEN 3 THEN 'signup' ELSE 'view' END AS local
        FROM stmt""",
    # The same events as statements of an intermediate form: calls into temporaries, assignments, ifs and switches.
    "ir": """
        SELECT sig, CAST(floor(o / 8) AS BIGINT) AS block, o AS ord, CASE
            WHEN o % 11 <> 0 THEN CAST(floor(o / 3) AS BIGINT) END AS line, local AS text,
               CASE local WHEN 'click' THEN '$stack' || CAST(o % 3 AS STRING) WHEN 'signup' THEN 'x'
                   WHEN 'view' THEN 'y' END AS lhs,
               CASE local WHEN 'click' THEN 'invoke' WHEN 'signup' THEN CASE WHEN o % 2 = 0 THEN 'b.<F>' ELSE 'z' END
                   WHEN 'view' THEN CASE WHEN o % 5 = 0 THEN '$stack0' ELSE 'a' || CAST(o AS STRING) END END AS rhs,
               CASE WHEN local = 'click' THEN 'p.q.Cls' || CAST(o % 3 AS STRING) || '.m' END AS call_target,
                   o % 2 = 0 AS returns_boolean, CAST(o % 4 AS INT) AS arg_count,
               CASE WHEN local = 'error' THEN '$stack1 == 0' END AS condition, local = 'purchase'
                   AND o % 5 = 0 AS is_switch
        FROM stmt""",
    # Overloaded methods and calls of them: customers, and orders that name a customer's method.
    "overload": """
        SELECT '<' || c_mktsegment || ': void ' || sub_sig || '>' AS sig, c_mktsegment AS class, name, sub_sig, arity,
            min(c_custkey) AS ord
        FROM (SELECT c_mktsegment, c_custkey, 'c' || CAST(c_custkey % 97 AS STRING) AS name, CASE
            WHEN c_custkey % 3 = 0 THEN 0 ELSE 1 END AS arity,
                     'c' || CAST(c_custkey % 97 AS STRING) || '(' || CASE c_custkey % 3 WHEN 0 THEN '' WHEN 1 THEN 'int'
                         ELSE 'long' END || ')' AS sub_sig FROM customer)
        GROUP BY c_mktsegment, name, sub_sig, arity""",
    "site": """
        SELECT o_orderkey AS id, c_mktsegment AS class, 'c' || CAST(c_custkey % 97 AS STRING) AS name,
               'c' || CAST(c_custkey % 97 AS STRING) || '(' || CASE o_orderkey % 3 WHEN 0 THEN 'int'
                   WHEN 1 THEN 'Object' ELSE '' END || ')' AS sub_sig, CASE WHEN o_orderkey % 3 = 2 THEN 0
                   ELSE 1 END AS arity
        FROM orders JOIN customer ON o_custkey = c_custkey""",
    # A signup begins a handler of the three statements before it.
    "trap": "SELECT sig, o AS trap_idx, o AS handler, 'java.lang.' || heir AS type FROM stmt WHERE local = 'signup' AND heir IS NOT NULL",
    "cover": """
        SELECT sig, trap_idx, handler - 1 AS block, handler - 1 AS ord FROM trap
        UNION ALL SELECT sig, trap_idx, handler - 2, handler - 2 FROM trap WHERE handler > 2
        UNION ALL SELECT sig, trap_idx, handler - 3, handler - 3 FROM trap WHERE handler > 3""",
    # Statement texts between methods, on the acyclic calls.
    "flat_call": "SELECT src AS caller, dst AS callee, call_line FROM call_edge WHERE src < dst",
    "ddg_node": """
        SELECT caller || '#c' || callee AS id, caller AS sig, call_line AS ord,
            'x' || CAST(call_line AS STRING) || ' = invoke ' || callee || '(a' || CAST(call_line AS STRING) || ', 7)' AS text,
               'ASSIGN_INVOKE' AS kind, replace(callee, ': void', ': int') AS call_target FROM flat_call
        UNION ALL SELECT DISTINCT caller || '#a' || CAST(call_line AS STRING), caller, 0,
               'a' || CAST(call_line AS STRING) || ' = b.<' || regexp_extract(caller, '^<([^:]+):', 1) || '.F' || CAST(call_line AS STRING) || '>', 'ASSIGN', NULL
                   FROM flat_call
        UNION ALL SELECT DISTINCT callee || '#p', callee, 0, 'p := @parameter0: int', 'IDENTITY', NULL FROM flat_call
        UNION ALL SELECT DISTINCT callee || '#q', callee, 1, 'q := @parameter1: int', 'IDENTITY', NULL FROM flat_call
        UNION ALL SELECT DISTINCT callee || '#w', callee, 2, 'b.<' || regexp_extract(callee, '^<([^:]+):', 1) || '.F' || CAST(length(callee) % 5 AS STRING) || '> = p', 'ASSIGN', NULL
            FROM flat_call
        UNION ALL SELECT DISTINCT callee || '#r', callee, 3, 'return p', 'RETURN', NULL FROM flat_call""",
    "local_edge": """
        SELECT caller || '#a' || CAST(call_line AS STRING) AS src, caller || '#c' || callee AS dst, call_line AS ord
            FROM flat_call
        UNION ALL SELECT DISTINCT callee || '#p', callee || '#r', 0 FROM flat_call
        UNION ALL SELECT DISTINCT callee || '#p', callee || '#w', 1 FROM flat_call""",
    # A tree of calls: region, nation, customer, order.
    "tree_node": """
        SELECT r_regionkey AS r, -1 AS n, CAST(-1 AS BIGINT) AS c, CAST(-1 AS BIGINT) AS o, r_name AS sig, NULL AS leaf, NULL AS priority
            FROM region
        UNION ALL SELECT n_regionkey, n_nationkey, -1, -1, n_name, NULL, NULL FROM nation
        UNION ALL SELECT n_regionkey, n_nationkey, c_custkey, -1, c_name, NULL, NULL FROM customer
            JOIN nation ON c_nationkey = n_nationkey
        UNION ALL SELECT n_regionkey, n_nationkey, c_custkey, o_orderkey, c_mktsegment, CASE o_orderstatus
            WHEN 'F' THEN 'filtered' WHEN 'O' THEN 'ref' ELSE 'cycle' END, o_orderpriority
            FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey""",
    # The same tree as calls between methods; an order calls its customer back.
    "body_call": """
        SELECT 'r' || CAST(r_regionkey AS STRING) AS caller, 'n' || CAST(n_nationkey AS STRING) AS callee, CAST(n_nationkey AS BIGINT) AS ord
            FROM nation JOIN region ON n_regionkey = r_regionkey
        UNION ALL SELECT 'n' || CAST(n_nationkey AS STRING), 'c' || CAST(c_custkey AS STRING), c_custkey FROM customer
            JOIN nation ON c_nationkey = n_nationkey
        UNION ALL SELECT 'c' || CAST(c_custkey AS STRING), 'o' || CAST(o_orderkey AS STRING), o_orderkey FROM orders
            JOIN customer ON o_custkey = c_custkey
        UNION ALL SELECT 'o' || CAST(o_orderkey AS STRING), 'c' || CAST(c_custkey AS STRING), c_custkey FROM orders
            JOIN customer ON o_custkey = c_custkey""",
    # Expressions of pages, and the beans they name.
    "el": """
        SELECT 'p' || CAST(p_partkey % 20 AS STRING) || '.jsp' AS jsp, p_partkey AS ord, '#' || chr(123) || lower(p_type) || '.m' || CAST(p_partkey AS STRING) || chr(125) AS el
            FROM part
        UNION ALL SELECT 'p' || CAST(p_partkey % 20 AS STRING) || '.jsp', p_partkey + 1000000, '#' || chr(123) || 'empty x' || chr(125)
            FROM part WHERE p_partkey % 11 = 0
        UNION ALL SELECT 'q.jsp', p_partkey, '$' || chr(123) || lower(p_type) || chr(125) FROM part
            WHERE p_partkey % 13 = 0""",
    "bean": "SELECT DISTINCT lower(p_type) AS bean_name, 'com.' || lower(p_type) || '.Brand2' AS fqcn FROM part WHERE p_type <> 'PROMO'",
    # Pages are suppliers in folders of nations; each includes another in one of the four ways, or names none that exists.
    "web_page": """
        SELECT 'd' || CAST(s_nationkey AS STRING) || '/s' || CAST(s_suppkey AS STRING) || '.jsp' AS jsp,
            s_suppkey AS id,
               CASE s_suppkey % 6 WHEN 0 THEN '<jsp:include  page = "' WHEN 1 THEN '<c:import var="x" url="'
                   WHEN 2 THEN '<ui:include src="' WHEN 3 THEN '<%@ include file="'
                   WHEN 4 THEN '<JSP:Include flush="true" page="'
                   ELSE '<p title="' END
               || CASE WHEN s_suppkey % 10 = 9 THEN 'http://h/x.jsp' WHEN s_suppkey % 10 = 8 THEN '/none.jsp'
                   WHEN s_suppkey % 2 = 0 THEN '/d' || CAST(s_nationkey AS STRING) || '/t.jsp' ELSE 't.jsp' END
               || '">x' AS html
        FROM supplier
        UNION ALL SELECT 'd' || CAST(n_nationkey AS STRING) || '/t.jsp', n_nationkey, '<ui:include src="../d' || CAST((n_nationkey + 1) % 25 AS STRING) || '/t.jsp"/>'
            FROM nation""",
}

#: Facts that queries use several times or that cost a shuffle: written once for each query.
SETTLED = {"call_edge", "stmt", "flow_edge", "ddg_node", "tree_node"}


def needed(sql: str, given: set[str] = frozenset()) -> list[str]:
    """The facts that a query uses, in order of definition; what given facts use themselves doesn't count."""
    found: set[str] = set()
    todo = [sql]
    while todo:
        for name in set(re.findall(r"(?:FROM|JOIN|,)\s+(\w+)", todo.pop())) & set(SQL):
            if name not in found:
                found.add(name)
                if name not in given:
                    todo.append(SQL[name])
    return [k for k in SQL if k in found]


def with_facts(sql: str) -> str:
    """sql with the facts it uses as common table expressions."""
    sql = sql.strip()
    parts = [f"{k} AS ({SQL[k]})" for k in needed(sql)]
    if not parts:
        return sql
    if sql.upper().startswith("WITH RECURSIVE"):
        return f"WITH RECURSIVE {', '.join(parts)}, {sql[len('WITH RECURSIVE') :]}"
    if sql.upper().startswith("WITH"):
        return f"WITH {', '.join(parts)}, {sql[len('WITH') :]}"
    return f"WITH {', '.join(parts)} {sql}"


class Facts:
    """DataFrames of facts and base tables, by attribute; the settled facts are computed once."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir
        self.known: dict[str, DataFrame] = {}

    def __getattr__(self, name: str) -> DataFrame:
        if name in self.known:
            return self.known[name]
        if name in TABLES:
            return self.spark.read.parquet(f"{self.dir}/{name}.parquet")
        if name not in SQL:
            raise AttributeError(name)
        if name in SETTLED:
            self.known[name] = settle(self.sql(SQL[name]), name, "zstd")
            release(self.spark)
            return self.known[name]
        return self.sql(f"SELECT * FROM {name}")

    def sql(self, sql: str) -> DataFrame:
        parts = [k for k in needed(sql, SETTLED) if k not in SETTLED]
        inlined = f"WITH {', '.join(f'{k} AS ({SQL[k]})' for k in parts)} {sql}" if parts else sql
        names = (*TABLES, *SETTLED)
        used = {t for t in names if re.search(rf"(?:FROM|JOIN|,)\s+{t}\b", inlined)}
        text = re.sub(r"((?:FROM|JOIN)\s+)(" + "|".join(names) + r")\b", r"\1{\2}", inlined)
        return self.spark.sql(text, **{t: getattr(self, t) for t in used})
