"""Technologies of repositories (customers) whose files follow from their keys, and the SQL that gives the same facets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataline.operators import fingerprints as P
from strataline.plans.registry import query

_RULES = [
    ("language.go", "language", "manifest-file", "go.mod"), ("language.go", "language", "source-extension", ".go"), ("language.typescript", "language", "config-file", "tsconfig.json"), ("language.typescript", "language", "source-extension", ".TS"),
    ("language.javascript", "language", "manifest-default", "package.json"), ("ecosystem.node", "ecosystem", "manifest-file", "package.json"), ("framework.f", "framework", "package-dependency", "pkg2"), ("framework.m", "framework", "go-require", "example.io/m2"), ("datastore.sql", "datastore", "source-extension", ".sql"),
]


def _files(table) -> DataFrame:
    c = F.col("c_custkey")
    when = lambda condition, path: F.when(condition, path)
    paths = [F.lit("README.md"), when(c % 2 == 0, "package.json"), when(c % 3 == 0, "go.mod"), when(c % 3 == 0, "x.go"), when(c % 5 == 0, "web/tsconfig.json"), when((c % 5 == 0) | (c % 7 == 0), F.concat(F.lit("web/src/a"), "c_nationkey", F.lit(".ts"))), when(c % 11 == 0, "db/q.sql"), when(c % 2 == 0, "node_modules/q/i.go")]
    return table("customer").select(c.alias("repository"), F.explode(F.array_compact(F.array(*paths))).alias("path"))


@query("""WITH t AS (SELECT c_custkey AS c, c_custkey % 2 = 0 AS js, c_custkey % 3 = 0 AS go, c_custkey % 5 = 0 AS web, c_custkey % 5 = 0 OR c_custkey % 7 = 0 AS ts, 'web/src/a' || c_nationkey || '.ts' AS a, c_custkey % 11 = 0 AS db FROM customer), r AS (SELECT *, js OR go OR NOT web AS root FROM t)
SELECT c AS repository, 'language.go' AS profile, 'language' AS kind, '.' AS scopes, 'go.mod,x.go' AS evidence, 'high' AS confidence, 'resolved' AS state FROM r WHERE go
UNION ALL SELECT c, 'language.typescript', 'language', CASE WHEN web AND root THEN '.,web/src' WHEN web THEN 'web/src' ELSE '.' END, CASE WHEN web THEN a || ',web/tsconfig.json' ELSE a END, CASE WHEN web THEN 'high' ELSE 'medium' END, 'resolved' FROM r WHERE ts
UNION ALL SELECT c, 'language.javascript', 'language', '.', 'package.json', 'medium', 'resolved' FROM r WHERE js AND NOT go AND NOT ts
UNION ALL SELECT c, 'ecosystem.node', 'ecosystem', '.', 'package.json', 'high', 'resolved' FROM r WHERE js UNION ALL SELECT c, 'framework.f', 'framework', '.', 'package.json#dependency:pkg2', 'high', 'resolved' FROM r WHERE js AND c % 6 = 2
UNION ALL SELECT c, 'framework.m', 'framework', '.', 'go.mod#require:example.io/m2', 'high', 'resolved' FROM r WHERE go AND c % 4 = 2 UNION ALL SELECT c, 'datastore.sql', 'datastore', '.', 'db/q.sql', 'medium', 'resolved' FROM r WHERE db AND root
UNION ALL SELECT c, 'repository.unclassified', 'repository-trait', '.', CASE WHEN db THEN 'README.md,db/q.sql' ELSE 'README.md' END, 'low', 'unknown' FROM r WHERE NOT js AND NOT go AND NOT ts""")
def technology_facets(table):
    c = F.col("c_custkey")
    declared = table("customer").filter(c % 2 == 0).select(c.alias("repository"), F.lit("package.json").alias("path"), F.concat(F.lit("pkg"), c % 6).alias("package"))
    required = table("customer").filter(c % 3 == 0).select(c.alias("repository"), F.lit("go.mod").alias("path"), F.concat(F.lit("example.io/m"), c % 4).alias("package"))
    files = _files(table)
    rules = files.sparkSession.createDataFrame(_RULES, "profile string, kind string, shape string, value string")
    found = P.with_unclassified(P.facets(P.facts(files, declared, required), rules), files)
    return found.withColumns({"scopes": F.array_join("scopes", ","), "evidence": F.array_join("evidence", ",")})
