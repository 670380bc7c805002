"""File and finding tables that Spark derives from the given ones, with the same derivation in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Paths that documents are given by id; {} is the id.
PATHS = (
    "README.md src/app{}.py src/app{}_test.go src/web/x{}.spec.ts tests/unit/t{}.txt AcmeTests/case{}.swift data/set{}.json data/rows{}.csv logs/run{}.log.json bak/old{}.py notes/plan{}.bak "
    "conf-backup-20240131/c{}.yml package-lock.json web/app{}.js.map api/p{}.pb.go node_modules/m{}/index.js ios/Pods/p{}/a.m .cargo/registry/r{}.rs .yarn/cache/z{}.zip .next/b{}.js my_cache/f{}.bin "
    "web/site{}.min.js img/logo{}.png target/debug/d{}.o CHANGELOG.md LICENSE.md LICENSE-MIT rules/r{}.yaml sig{}.yar TODO.md docs/guide{}.rst tsconfig.{}.json .vscode/s{}.json .vscode/settings.json "
    "deploy/k{}.yml www/p{}.html www/s{}.css docs/page {}.md Dockerfile compose.yaml .github/workflows/ci{}.yml .gitignore CONTRIBUTING.md .github/SECURITY.md .github/CODEOWNERS "
    ".github/ISSUE_TEMPLATE/bug{}.md docs/CODE_OF_CONDUCT.md .idea/w{}.xml x{}.swp pkg/vendor/lib{}.go vendor/v{}.go dist/bundle{}.js .env.example go.mod package.json lib/conftest.py a{}/b/c.toml scripts/run{}.sh config/net{}.conf www/t{}.scss"
).replace("page {}.md", "page\x00{}.md").split()
PATHS = [p.replace("\x00", " ") for p in PATHS]
#: Lines put after a document's text, by id.
LINES = [
    "server = 93.184.216.34",
    "range 10.0.0.0/8 and 8.8.8.8",
    "version: 1.2.3.4",
    "AS13335 is near 203.0.113.7",
    "db = postgres://svc:Xk9mQ2vLp@db.acme.io:5432/x",
    "db = postgres://svc:${DB_PASS}@db.acme.io/x",
    "get http://files.acme.io/a and ftp://ftp.acme.io/b",
    "see http://www.w3.org/2000/svg and http://localhost:80/",
    "TODO: finish; FIXME: later",
    "please update this later",
    "<<<<<<< ours",
    "=======",
    ">>>>>>> theirs",
    "# comment\nKEY=1\nOTHER=2",
    "LONE=3",
    "Lorem ipsum dolor",
    "id 1.3.6.1.4.1.311",
    "ssh root@192.168.0.136",
    "",
]


def pick(options: list[str], id_: Column) -> Column:
    return F.get(F.array(*[F.lit(o) for o in options]), F.pmod(id_, F.lit(len(options))).cast("int"))


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(project, path, tracked, mode, size, text, seq) from documents."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    i = F.col("doc_id")
    return d.select(
        F.col("source").alias("project"),
        F.replace(pick(PATHS, F.expr("doc_id * 7 + doc_id div 61")), F.lit("{}"), i.cast("string")).alias("path"),
        F.lit(True).alias("tracked"),
        F.when(i % 3 == 0, "100755").otherwise("100644").alias("mode"),
        (F.col("n_chars") * 700).alias("size"),
        F.concat(F.col("text"), F.lit("\n"), pick(LINES, F.expr("doc_id div 3"))).alias("text"),
        i.alias("seq"),
    )


def projects(files: DataFrame) -> DataFrame:
    return files.select("project").distinct().withColumn("is_repo", F.lit(True))


def _sql_list(options: list[str]) -> str:
    return "[" + ", ".join("'" + o.replace("'", "''").replace("\n", "' || chr(10) || '") + "'" for o in options) + "]"


FILES_SQL = f"""files AS (
  SELECT source AS project, replace(({_sql_list(PATHS)})[(doc_id * 7 + doc_id // 61) % {len(PATHS)} + 1], '{{}}', doc_id::VARCHAR) AS path,
    CASE WHEN doc_id % 3 = 0 THEN '100755' ELSE '100644' END AS mode, n_chars * 700 AS size,
    text || chr(10) || ({_sql_list(LINES)})[(doc_id // 3) % {len(LINES)} + 1] AS text, doc_id AS seq
  FROM documents)"""


def emissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings as a run emits them, from events: keys repeat."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.selectExpr(
        "'p' || (user_id % 20) AS project",
        "event_type AS gate_id",
        "CASE WHEN event_id % 9 = 0 THEN '' ELSE 'f' || (event_id % 50) || '.go:' || (event_id % 300) || ':r' END AS file_path",
        "CASE WHEN value >= 200 THEN 'error' WHEN value >= 80 THEN 'warning' ELSE 'info' END AS severity",
        "CASE event_id % 3 WHEN 0 THEN 'security,git-hygiene' WHEN 1 THEN 'quality' ELSE '' END AS tags",
        "CASE WHEN event_id % 7 = 0 THEN 'resolved' WHEN event_id % 11 = 0 THEN 'ignored' ELSE 'open' END AS status",
        "unix_millis(CAST(ts AS TIMESTAMP)) AS created_at",
        "unix_millis(CAST(ts AS TIMESTAMP)) AS updated_at",
        "event_id AS emit_seq",
        "event_id AS id",
    )


EMISSIONS_SQL = """emissions AS (
  SELECT 'p' || (user_id % 20)::VARCHAR AS project, event_type AS gate_id,
    CASE WHEN event_id % 9 = 0 THEN '' ELSE 'f' || (event_id % 50)::VARCHAR || '.go:' || (event_id % 300)::VARCHAR || ':r' END AS file_path,
    CASE WHEN value >= 200 THEN 'error' WHEN value >= 80 THEN 'warning' ELSE 'info' END AS severity,
    CASE event_id % 3 WHEN 0 THEN 'security,git-hygiene' WHEN 1 THEN 'quality' ELSE '' END AS tags,
    CASE WHEN event_id % 7 = 0 THEN 'resolved' WHEN event_id % 11 = 0 THEN 'ignored' ELSE 'open' END AS status,
    epoch_us(ts) // 1000 AS created_at, epoch_us(ts) // 1000 AS updated_at, event_id AS emit_seq, event_id AS id
  FROM events)"""
