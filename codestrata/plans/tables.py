"""The driver's tables read as a code history.

The data holds no source code, so each reference relation is a row-local projection of a table: a part or
supplier key names a module, a line item is an import edge, a call and a touched file, an order is a commit,
a customer its author, and the ship month is the snapshot. The expressions below are the *input mapping*, valid
in both SQL dialects; the operators' logic is written twice (DataFrame and SQL) in the query modules."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codestrata.sources import rules_doc


def path_of(key: str) -> str:
    """Module path named by an integer key."""
    return f"""CONCAT('src/', CASE {key} % 6 WHEN 0 THEN 'controllers' WHEN 1 THEN 'services'
 WHEN 2 THEN 'repositories' WHEN 3 THEN 'models' WHEN 4 THEN 'utils' ELSE 'tests' END,
 '/pkg_', CAST({key} % 25 AS STRING), CASE WHEN {key} % 7 = 0 THEN '/db' ELSE '' END,
 '/item_', CAST({key} AS STRING), CASE WHEN {key} % 10 = 0 THEN '_service.py' WHEN {key} % 10 = 1 THEN '.controller.ts'
 WHEN {key} % 10 = 2 THEN '_test.py' WHEN {key} % 5 = 3 THEN '.js' WHEN {key} % 5 = 4 THEN '.tsx' ELSE '.py' END)"""


def hash_of(key: str) -> str:
    """Commit hash of an order key."""
    return f"sha1(CAST({key} AS STRING))"


def class_of(flag: str) -> str:
    """Class a call side belongs to: null for module-level functions."""
    return f"CASE WHEN {flag} = 'N' THEN NULL WHEN {flag} = 'O' THEN NULL ELSE CONCAT('Class', {flag}) END"


def author_of(key: str) -> str:
    """Display name; several customers share one."""
    return f"CONCAT('dev ', CAST({key} % 400 AS STRING))"


def month_of(ts: str) -> str:
    return f"(EXTRACT(YEAR FROM {ts}) * 12 + EXTRACT(MONTH FROM {ts}))"


def iso_of(ts: str) -> str:
    """ISO text with fixed width in both dialects."""
    return f"CAST(CAST({ts} AS DATE) AS STRING)"


def _named(prefix: str, key: str) -> Column:
    """A name of a key; ``format_string`` makes a formatter for every row."""
    return F.concat(F.lit(prefix), F.expr(f"CAST({key} AS STRING)"))


# --- the same relations as SQL, for the twins -------------------------------------------------------------

MODULES_SQL = f"SELECT p_partkey AS k, {path_of('p_partkey')} AS path FROM part"
IMPORTS_SQL = f"""SELECT {path_of('a')} AS src, {path_of('b')} AS dst FROM
 (SELECT DISTINCT l_partkey AS a, l_suppkey AS b FROM lineitem WHERE l_partkey <> l_suppkey)"""
CALLS_SQL = f"""SELECT {path_of('a')} AS caller_module, {class_of('rf')} AS caller_class, CONCAT('fn_', CAST(ln AS STRING)) AS caller_name,
 {path_of('b')} AS callee_module, {class_of('ls')} AS callee_class, CONCAT('fn_', CAST(ln % 3 AS STRING)) AS callee_name FROM
 (SELECT DISTINCT l_partkey AS a, l_returnflag AS rf, l_linenumber AS ln, l_suppkey AS b, l_linestatus AS ls FROM lineitem)"""
MONTHS_SQL = f"""SELECT m, CAST(dense_rank() OVER (ORDER BY m) - 1 AS BIGINT) AS idx FROM
 (SELECT DISTINCT {month_of('l_shipdate')} AS m FROM lineitem)"""
SNAP_IMPORTS_SQL = f"""SELECT {path_of('a')} AS src, {path_of('b')} AS dst, idx FROM
 (SELECT DISTINCT l_suppkey AS a, CAST(l_linenumber AS BIGINT) AS b, {month_of('l_shipdate')} AS m FROM lineitem
  WHERE l_suppkey <> l_linenumber) JOIN months USING (m)"""

LAYER_SQL = """CASE
 WHEN regexp_matches(lower({p}), '(^|/)(test|tests|__tests__|spec|e2e)/|(^|/)(test_[^/]*[.]py|[^/]*_test[.]py|conftest[.]py|[^/]*[.]test[.][^/]*|[^/]*[.]spec[.][^/]*)$') THEN NULL
 WHEN regexp_matches(lower({p}), '(^|/)(controller[.]py|[^/]*_controller[.]py|[^/]*[.]controller[.](ts|js))$') THEN 'controller'
 WHEN regexp_matches(lower({p}), '(^|/)(service[.]py|[^/]*_service[.]py|[^/]*[.]service[.](ts|js))$') THEN 'service'
 WHEN regexp_matches(lower({p}), '(^|/)(database[.]py|[^/]*_repository[.]py|[^/]*[.]repository[.](ts|js))$') THEN 'database'
 WHEN regexp_matches(lower({p}), '([.]entity[.]ts|[.]model[.]js)$') THEN 'model'
 ELSE CASE list_filter(list_reverse(string_split(lower({p}), '/')[:-2]), lambda x: x IN ('controllers','controller','routes','routers','views','handlers','endpoints','entrypoints',
  'services','service','service_layer','usecases','use_cases','application','repositories','repository','dao','db','database','adapters','infrastructure','models','entities','domain'))[1]
  WHEN 'controllers' THEN 'controller' WHEN 'controller' THEN 'controller' WHEN 'routes' THEN 'controller' WHEN 'routers' THEN 'controller'
  WHEN 'views' THEN 'controller' WHEN 'handlers' THEN 'controller' WHEN 'endpoints' THEN 'controller' WHEN 'entrypoints' THEN 'controller'
  WHEN 'services' THEN 'service' WHEN 'service' THEN 'service' WHEN 'service_layer' THEN 'service' WHEN 'usecases' THEN 'service'
  WHEN 'use_cases' THEN 'service' WHEN 'application' THEN 'service' WHEN 'models' THEN 'model' WHEN 'entities' THEN 'model' WHEN 'domain' THEN 'model'
  WHEN 'repositories' THEN 'database' WHEN 'repository' THEN 'database' WHEN 'dao' THEN 'database' WHEN 'db' THEN 'database' WHEN 'database' THEN 'database'
  WHEN 'adapters' THEN 'database' WHEN 'infrastructure' THEN 'database' END END"""


def layer_sql(path: str) -> str:
    return LAYER_SQL.format(p=path)


RULES_SQL = """SELECT * FROM (VALUES
 ('no-controller-to-db', 'calls', 'controller', 'database', false, 3),
 ('no-controller-imports-db', 'imports', 'controller', 'database', false, 2),
 ('no-service-imports-controller', 'imports', 'service', 'controller', false, 2),
 ('no-db-imports-service', 'imports', 'database', 'service', false, 2),
 ('no-db-imports-controller', 'imports', 'database', 'controller', false, 2),
 ('controller-to-service-allowed', 'calls', 'controller', 'service', true, 0),
 ('service-to-db-allowed', 'calls', 'service', 'database', true, 0)
) AS r(rule_name, edge, rule_from, rule_to, allowed, severity)"""

# Function definitions as parsed, repeats included: the caller side of every line, and the callee side of lines
# whose callee is module-level (so some calls have no definition to land on).
FUNCTION_ROWS_SQL = f"""SELECT {path_of('l_partkey')} AS module_path, {class_of('l_returnflag')} AS class_name, CONCAT('fn_', CAST(l_linenumber AS STRING)) AS name,
 CONCAT('fn_', CAST(l_linenumber AS STRING), '(', l_linestatus, ', ', CAST(l_orderkey % 5 AS STRING), ')') AS signature, l_orderkey AS ord FROM lineitem
 UNION ALL SELECT {path_of('l_suppkey')}, {class_of('l_linestatus')}, CONCAT('fn_', CAST(l_linenumber % 3 AS STRING)),
 CONCAT('fn_', CAST(l_linenumber % 3 AS STRING), '(x)'), -1 FROM lineitem WHERE l_linestatus = 'O'"""
FUNCTIONS_SQL = """SELECT module_path, class_name, name, signature FROM (SELECT *, ROW_NUMBER() OVER
 (PARTITION BY module_path, class_name, name ORDER BY ord DESC, signature DESC) AS n FROM function_rows) WHERE n = 1"""
CLASSES_SQL = "SELECT DISTINCT module_path, class_name AS name FROM function_rows WHERE class_name IS NOT NULL"

COMMITS_SQL = f"""SELECT {hash_of('o_orderkey')} AS hash, substr({hash_of('o_orderkey')}, 1, 7) AS short, o_orderkey AS k,
 {author_of('o_custkey')} AS author, substr(sha1(lower(CONCAT('c', CAST(o_custkey AS STRING)))), 1, 12) AS author_id,
 {iso_of('o_orderdate')} AS date, CONCAT(o_orderpriority, ' change ', o_orderstatus) AS subject FROM orders"""
FILES_SQL = f"""SELECT {hash_of('l_orderkey')} AS hash, l_orderkey AS k, {path_of('l_partkey')} AS path,
 CASE WHEN l_returnflag = 'R' THEN {path_of('l_suppkey')} END AS old_path,
 CAST(l_quantity AS BIGINT) AS added, CAST(l_linenumber AS BIGINT) AS deleted FROM lineitem"""


def with_(**relations: str) -> str:
    """WITH clause from named relation texts, in order."""
    return "WITH " + ",\n ".join(f"{name} AS ({text})" for name, text in relations.items())


# --- the same relations as DataFrames ---------------------------------------------------------------------


class Tables:
    """Lazy views over one data folder."""

    def __init__(self, spark: SparkSession, folder: str):
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        self.spark, self.folder = spark, folder.rstrip("/")
        self.rules_document = rules_doc.default_rules()
        self._read: dict[str, DataFrame] = {}

    def table(self, name: str) -> DataFrame:
        if name not in self._read:  # each read infers the schema from the file footer once
            self._read[name] = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        return self._read[name]

    @cached_property
    def rules(self) -> DataFrame:
        return rules_doc.rules_table(self.spark, self.rules_document)

    @cached_property
    def modules(self) -> DataFrame:
        """path, layer_type: one row per part key (keys are unique, so no distinct is needed)."""
        from codestrata.operators.layers import classify

        return self.table("part").select("p_partkey", F.expr(path_of("p_partkey")).alias("path")).withColumn(
            "layer_type", classify(F.col("path"), self.rules_document))

    @cached_property
    def imports(self) -> DataFrame:
        """from, to. Distinct on the integer keys, before the path text is built."""
        pairs = self.table("lineitem").filter("l_partkey <> l_suppkey").select("l_partkey", "l_suppkey").distinct()
        return pairs.select(F.expr(path_of("l_partkey")).alias("from"), F.expr(path_of("l_suppkey")).alias("to"))

    @cached_property
    def calls(self) -> DataFrame:
        keys = self.table("lineitem").select(
            "l_partkey", "l_returnflag", "l_linenumber", "l_suppkey", "l_linestatus").distinct()
        return keys.select(
            F.expr(path_of("l_partkey")).alias("caller_module"), F.expr(class_of("l_returnflag")).alias("caller_class"),
            _named("fn_", "l_linenumber").alias("caller_name"),
            F.expr(path_of("l_suppkey")).alias("callee_module"), F.expr(class_of("l_linestatus")).alias("callee_class"),
            _named("fn_", "l_linenumber % 3").alias("callee_name"))

    @cached_property
    def function_rows(self) -> DataFrame:
        """module_path, class_name, name, signature, ord: definitions before the upsert."""
        li = self.table("lineitem")
        own = li.select(
            F.expr(path_of("l_partkey")).alias("module_path"), F.expr(class_of("l_returnflag")).alias("class_name"),
            _named("fn_", "l_linenumber").alias("name"),
            F.concat(_named("fn_", "l_linenumber"), F.lit("("), "l_linestatus", F.lit(", "), F.expr("CAST(l_orderkey % 5 AS STRING)"), F.lit(")")).alias("signature"),
            F.col("l_orderkey").alias("ord"))
        other = li.filter("l_linestatus = 'O'").select(
            F.expr(path_of("l_suppkey")).alias("module_path"), F.expr(class_of("l_linestatus")).alias("class_name"),
            _named("fn_", "l_linenumber % 3").alias("name"),
            F.concat(_named("fn_", "l_linenumber % 3"), F.lit("(x)")).alias("signature"), F.lit(-1).cast("bigint").alias("ord"))
        return own.unionByName(other)

    @cached_property
    def functions(self) -> DataFrame:
        from codestrata.operators.graph import upsert

        return upsert(self.function_rows, ["module_path", "class_name", "name"], ["ord", "signature"], ["signature"])

    @cached_property
    def classes(self) -> DataFrame:
        rows = self.function_rows.filter("class_name IS NOT NULL")
        return rows.select("module_path", F.col("class_name").alias("name")).distinct()

    @cached_property
    def months(self) -> DataFrame:
        """m, idx: the snapshot sequence (one row per calendar month, so the ranking window is bounded)."""
        from pyspark.sql import Window

        distinct = self.table("lineitem").select(F.expr(month_of("l_shipdate")).cast("bigint").alias("m")).distinct()
        return distinct.withColumn("idx", (F.dense_rank().over(Window.orderBy("m")) - 1).cast("bigint"))

    @cached_property
    def snap_imports(self) -> DataFrame:
        """from, to, idx: import edges per snapshot."""
        keys = self.table("lineitem").filter("l_suppkey <> l_linenumber").select(
            "l_suppkey", F.col("l_linenumber").cast("bigint").alias("l_linenumber"),
            F.expr(month_of("l_shipdate")).cast("bigint").alias("m")).distinct()
        return keys.join(F.broadcast(self.months), "m").select(
            F.expr(path_of("l_suppkey")).alias("from"), F.expr(path_of("l_linenumber")).alias("to"), "idx")

    @cached_property
    def last_idx(self) -> DataFrame:
        return self.months.agg(F.max("idx").alias("last"))

    @cached_property
    def commits(self) -> DataFrame:
        o = self.table("orders")
        return o.select(
            F.expr(hash_of("o_orderkey")).alias("hash"), F.col("o_orderkey").alias("k"),
            F.expr(author_of("o_custkey")).alias("author"),
            F.expr("substr(sha1(lower(CONCAT('c', CAST(o_custkey AS STRING)))), 1, 12)").alias("author_id"),
            F.expr(iso_of("o_orderdate")).alias("date"),
            F.concat("o_orderpriority", F.lit(" change "), "o_orderstatus").alias("subject"),
        ).withColumn("short", F.substring("hash", 1, 7))

    @cached_property
    def commit_files(self) -> DataFrame:
        li = self.table("lineitem")
        return li.select(
            F.expr(hash_of("l_orderkey")).alias("hash"), F.col("l_orderkey").alias("k"),
            F.expr(path_of("l_partkey")).alias("path"),
            F.when(F.col("l_returnflag") == "R", F.expr(path_of("l_suppkey"))).alias("old_path"),
            F.col("l_quantity").cast("bigint").alias("added"), F.col("l_linenumber").cast("bigint").alias("deleted"))
