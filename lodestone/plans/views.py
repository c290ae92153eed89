"""Queries for what the catalogue leaves: sources, sinks, texts, ordered lists, views; with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import paths as P
from ..functions import text as T
from ..lineage import new_folder
from ..operators import evaluation, findings, graph, mining, retrieval, views, wiki
from ..operators.inverted import InvertedIndex
from ..operators.model_stage import ModelStage
from ..sources import repository, sinks
from ..sources import tables as S
from .catalogue import COUPLING, DEGREE, ENDS, FILES, GRAPH, HISTORY, HOT, LINKS, START, _files, _recursive, register

LONG = "cast({} as bigint)"


def _long(*names: str) -> list:
    return [F.col(n).cast("long").alias(n) for n in names]


def _pick(key, *values: str):
    """One of the values by the key's remainder."""
    out = F.lit(values[-1])
    for i, v in reversed(list(enumerate(values[:-1]))):
        out = F.when(key % len(values) == i, F.lit(v)).otherwise(out)
    return out


def _pick_sql(key: str, *values: str) -> str:
    return f"CASE {key} % {len(values)} " + " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values)) + " END"


# --- addresses and paths

_TAILS = ("", ".git", "/tree/main/src", "/", "?tab=readme", "/blob/main/README.md#L3", "/issues?q=1", "/treehouse")
_REPO_URL = f"u AS (SELECT page_id, 'https://host.example/own' || (page_id % 7) || '/name' || page_id AS base, {_pick_sql('page_id', *_TAILS)} AS tail FROM pages)"


def _urls(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("page_id")
    base = F.concat(F.lit("https://host.example/own"), (k % 7).cast("string"), F.lit("/name"), k.cast("string"))
    return S.read(spark, d, "pages").select("page_id", F.concat(base, _pick(k, *_TAILS)).alias("url"))


@register("a01_url_browse", "SELECT page_id, base || CASE tail WHEN '/tree/main/src' THEN '' WHEN '/blob/main/README.md#L3' THEN '#L3' WHEN '/issues?q=1' THEN '?q=1' ELSE tail END AS url FROM u", _REPO_URL)
def _(spark, d):
    return _urls(spark, d).select("page_id", P.normalise_repo_url(F.col("url")).alias("url"))


@register("a02_repo_slug", "SELECT page_id, 'own' || (page_id % 7) AS owner, 'name' || page_id || CASE tail WHEN '/treehouse' THEN tail ELSE '' END AS name FROM u", _REPO_URL)
def _(spark, d):
    return _urls(spark, d).select("page_id", P.repo_slug(F.col("url")).alias("s")).select("page_id", "s.owner", "s.name")


_DIRS = ("src/", "tests/", "docs/", "pkg/Test/", "a/doc/", "", "pkg/sub/")
_NAMES = ("main", "test_x", "x_test", "README", "Makefile", "tests", ".gitignore", "setup", "x", "uv", "Dockerfile")
_EXTS = (".py", ".md", ".toml", "", ".go", ".TXT", ".rs", ".yml", ".bin", ".H", ".json", ".lock", ".tar.gz")
_PATHS = f"p AS (SELECT doc_id, {_pick_sql('doc_id', *_DIRS)} || {_pick_sql('(doc_id // 7)', *_NAMES)} || {_pick_sql('(doc_id // 3)', *_EXTS)} AS path FROM documents)"
_PARTS = "q AS (SELECT *, lower(regexp_extract(path, '[^/]*$')) AS name, lower(regexp_extract(regexp_extract(path, '[^/]*$'), '[^.](\\.[^.]+)$', 1)) AS ext, string_split(lower(path), '/') AS parts FROM p)"


def _quoted(values) -> str:
    return ", ".join(f"'{v}'" for v in values)


def _made_paths(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("doc_id")
    path = F.concat(_pick(k, *_DIRS), _pick(F.floor(k / 7), *_NAMES), _pick(F.floor(k / 3), *_EXTS))
    return S.read(spark, d, "documents").select("doc_id", path.alias("path"))


@register("a08_language", f"SELECT doc_id, path, CASE {' '.join(f"WHEN ext = '{e}' THEN '{l}'" for e, l in P.LANGUAGES.items())} END AS language FROM q", _PATHS, _PARTS)
def _(spark, d):
    return _made_paths(spark, d).select("doc_id", "path", P.language(F.col("path")).alias("language"))


@register(
    "a09_category",
    f"SELECT doc_id, CASE WHEN list_has_any(parts, ['tests', 'test']) OR starts_with(name, 'test_') OR ends_with(name, '_test.py') THEN 'test' WHEN ext IN ({_quoted(P.DOC_EXTENSIONS)}) OR list_has_any(parts, ['docs', 'doc']) OR starts_with(name, 'readme') THEN 'doc' WHEN ext IN ({_quoted(P.LANGUAGES)}) THEN 'code' WHEN ext IN ({_quoted(P.CONFIG_EXTENSIONS)}) OR name IN ({_quoted(P.CONFIG_NAMES)}) THEN 'config' ELSE 'other' END AS category FROM q",
    _PATHS, _PARTS,
)
def _(spark, d):
    return _made_paths(spark, d).select("doc_id", P.category(F.col("path")).alias("category"))


@register("c11_noise", "SELECT doc_id, starts_with(path, '.github/') OR name IN ('uv.lock', 'poetry.lock', 'package-lock.json', 'pyproject.toml', '.pre-commit-config.yaml') AS noise FROM (SELECT doc_id, CASE WHEN doc_id % 17 = 0 THEN '.github/' ELSE '' END || path AS path, regexp_extract(path, '[^/]*$') AS name FROM p)", _PATHS)
def _(spark, d):
    path = F.concat(F.when(F.col("doc_id") % 17 == 0, ".github/").otherwise(""), F.col("path"))
    return _made_paths(spark, d).select("doc_id", P.is_noise(path).alias("noise"))


@register("c04_readme", "SELECT path FROM p WHERE path ILIKE '%readme%' ORDER BY length(path), path LIMIT 1", _PATHS)
def _(spark, d):
    return views.readme(_made_paths(spark, d)).select("path")


@register("q04_files_by_folder", "SELECT folder, array_to_string(list(path ORDER BY path), ',') AS paths FROM (SELECT path, CASE WHEN contains(path, '/') THEN regexp_replace(path, '/[^/]*$', '') ELSE '(root)' END AS folder FROM p WHERE contains(lower(path), 'test') AND NOT ends_with(path, '.bin')) GROUP BY folder", _PATHS)
def _(spark, d):
    files = _made_paths(spark, d).where("not endswith(path, '.bin')").select(F.lit(1).alias("repo_id"), "path", F.lit("code").alias("category"))
    return views.files_by_folder(files, "TEST").select("folder", F.array_join("paths", ",").alias("paths"))


@register("a05_skip_folders", f"SELECT doc_id, len(list_intersect(string_split(folder, '/'), [{_quoted(repository.SKIP_FOLDERS)}])) = 0 AS walked FROM (SELECT doc_id, {_pick_sql('doc_id', 'src', 'node_modules/x', 'a/.git/b', 'a/build', 'builds', '.venv', 'x/dist/y', 'docs')} AS folder FROM documents)")
def _(spark, d):
    folder = _pick(F.col("doc_id"), "src", "node_modules/x", "a/.git/b", "a/build", "builds", ".venv", "x/dist/y", "docs")
    return S.read(spark, d, "documents").select("doc_id", repository.is_walked(F.concat(folder, F.lit("/f.py"))).alias("walked"))


# --- texts of files

_RAW = "r AS (SELECT doc_id, replace(replace(text, ' the ', chr(13) || chr(10)), ' and ', chr(13)) AS raw FROM documents)"


def _raw_texts(spark: SparkSession, d: str) -> DataFrame:
    raw = F.replace(F.replace(F.col("text"), F.lit(" the "), F.lit("\r\n")), F.lit(" and "), F.lit("\r"))
    return S.read(spark, d, "documents").select("doc_id", raw.alias("raw"))


@register("a06_plain_newlines", "SELECT doc_id, md5(t) AS md5, contains(t, chr(13)) AS any_cr FROM (SELECT doc_id, regexp_replace(raw, '\\r\\n?', chr(10), 'g') AS t FROM r)", _RAW)
def _(spark, d):
    t = T.plain_newlines(F.col("raw"))
    return _raw_texts(spark, d).select("doc_id", F.md5(t).alias("md5"), F.coalesce(t.contains("\r"), F.lit(False)).alias("any_cr"))


@register("a07_file_facts", "SELECT doc_id, octet_length(encode(raw)) AS size_bytes, sha1(raw) AS content_sha, length(t) - length(replace(t, chr(10), '')) + 1 AS loc FROM (SELECT *, regexp_replace(raw, '\\r\\n?', chr(10), 'g') AS t FROM r)", _RAW)
def _(spark, d):
    facts = repository.file_facts(_raw_texts(spark, d).select("doc_id", F.col("raw").cast("binary").alias("raw")))
    return facts.select("doc_id", *_long("size_bytes"), "content_sha", *_long("loc"))


@register("l17_sha1", "SELECT page_id, sha1(html) AS sha FROM pages")
def _(spark, d):
    return S.read(spark, d, "pages").select("page_id", F.sha1("html").alias("sha"))


@register("l03_ellipsis", "SELECT doc_id, left(text, 60) AS cut, CASE WHEN length(text) > 80 THEN left(text, 79) || '…' ELSE text END AS short FROM documents")
def _(spark, d):
    text = F.col("text")
    return S.read(spark, d, "documents").select("doc_id", F.left(text, F.lit(60)).alias("cut"), T.ellipsis(text, 80).alias("short"))


@register("l05_first_line", "SELECT doc_id, string_split_regex(raw, '\\r\\n|\\n|\\r')[1] AS line FROM r", _RAW)
def _(spark, d):
    return _raw_texts(spark, d).select("doc_id", T.first_line(F.col("raw")).alias("line"))


_BLANK = "b AS (SELECT doc_id, regexp_replace(regexp_replace(text, chr(10), chr(10) || '  ' || chr(10), 'g'), '\\. ', '.' || chr(10) || chr(10) || ' ', 'g') AS text FROM documents)"


def _blank_lines(spark: SparkSession, d: str) -> DataFrame:
    text = F.replace(F.replace(F.col("text"), F.lit("\n"), F.lit("\n  \n")), F.lit(". "), F.lit(".\n\n "))
    return S.read(spark, d, "documents").select("doc_id", text.alias("text"))


@register("l06_paragraphs", "SELECT doc_id, len(string_split_regex(text, '\\n\\s*\\n')) AS n, string_split_regex(text, '\\n\\s*\\n')[1] AS first FROM b", _BLANK)
def _(spark, d):
    found = T.paragraphs(F.col("text"))
    return _blank_lines(spark, d).select("doc_id", F.size(found).cast("long").alias("n"), found[0].alias("first"))


def _chunk_sql(table: str) -> str:
    edge = "regexp_replace(regexp_replace({}, '^\\s+', ''), '\\s+$', '')"
    return f"""WITH RECURSIVE {_BLANK},
ps AS (SELECT doc_id, string_split_regex(text, '\\n\\s*\\n') AS ps FROM {table}),
walk AS (SELECT doc_id, ps, 1 AS i, ps[1] || chr(10) || chr(10) AS open, CAST(NULL AS VARCHAR) AS closed FROM ps
  UNION ALL SELECT doc_id, ps, i + 1, CASE WHEN i = len(ps) THEN '' WHEN length(open) + length(ps[i + 1]) > 1500 THEN '' ELSE open END || CASE WHEN i = len(ps) THEN '' ELSE ps[i + 1] || chr(10) || chr(10) END,
    CASE WHEN i = len(ps) OR length(open) + length(ps[i + 1]) > 1500 THEN open END FROM walk WHERE i <= len(ps)),
found AS (SELECT doc_id, i, {edge.format('closed')} AS chunk, i > len(ps) AS last FROM walk WHERE closed IS NOT NULL)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS i, length(chunk) AS chars, md5(chunk) AS md5 FROM found WHERE NOT last OR length(chunk) > 0"""


def _chunks(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.posexplode(T.chunks(F.col("text"))).alias("i", "chunk")).select("doc_id", *_long("i"), F.length("chunk").cast("long").alias("chars"), F.md5("chunk").alias("md5"))


@register("f10_chunks_of_paragraphs", _chunk_sql("b"))
def _(spark, d):
    return _chunks(_blank_lines(spark, d))


@register("j14_chunks", _chunk_sql("documents"))
def _(spark, d):
    return _chunks(S.read(spark, d, "documents"))


@register("j14_evidence_rows", _chunk_sql("b").replace("SELECT doc_id, row_number()", ", rows AS (SELECT doc_id, row_number()") + ") SELECT 'docs/' || doc_id || '.md#' || i AS ref_id, 'docs/' || doc_id || '.md' || CASE WHEN i = 0 THEN '' ELSE ' (part ' || (i + 1) || ')' END AS citation, md5 FROM rows")
def _(spark, d):
    path = F.concat(F.lit("docs/"), F.col("doc_id").cast("string"), F.lit(".md"))
    files = _blank_lines(spark, d).select(F.lit(1).alias("repo_id"), path.alias("path"), F.lit("doc").alias("category"), F.col("text").alias("content"))
    return retrieval.evidence_documents(files, None, None).select("ref_id", "citation", F.md5("text").alias("md5"))


@register("j14_evidence_streams", _chunk_sql("documents").replace("SELECT doc_id, row_number()", ", " + S.COMMITS_SQL + ", " + S.ISSUES_SQL + ", rows AS (SELECT doc_id, row_number()") + ") SELECT 'doc' AS stream, count(*) AS n FROM rows UNION ALL SELECT 'commit', count(*) FROM commits UNION ALL SELECT 'issue', count(*) FROM issues")
def _(spark, d):
    path = F.concat(F.lit("docs/"), F.col("doc_id").cast("string"), F.lit(".md"))
    files = S.read(spark, d, "documents").select(F.lit(1).alias("repo_id"), path.alias("path"), F.lit("doc").alias("category"), F.col("text").alias("content"))
    out = retrieval.evidence_documents(files, S.commits(spark, d), S.issues(spark, d).withColumn("body", F.lit(None).cast("string")))
    return out.groupBy("stream").agg(F.count("*").alias("n"))


@register("l07_line_slice", "SELECT doc_id, array_to_string(string_split(text, chr(10))[2:4], chr(10)) AS lines, CASE WHEN contains(text, ' of ') THEN length(left(text, strpos(text, ' of ') - 1)) - length(replace(left(text, strpos(text, ' of ') - 1), chr(10), '')) + 1 END AS line FROM documents")
def _(spark, d):
    text = F.col("text")
    return S.read(spark, d, "documents").select("doc_id", T.line_slice(text, F.lit(2), F.lit(4)).alias("lines"), T.line_of(text, " of ").cast("long").alias("line"))


@register("l09_signature", "SELECT id, CASE p_size % 4 WHEN 0 THEN '' WHEN 1 THEN 'a' WHEN 2 THEN 'a,rest' ELSE 'size,opts' END AS parameters, CASE WHEN p_size % 2 = 0 THEN 'List[int]' END AS result FROM (SELECT p_partkey AS id, p_size FROM part)")
def _(spark, d):
    k = F.col("p_size")
    inside = F.when(k % 4 == 0, "self").when(k % 4 == 1, "self, a: int = 3").when(k % 4 == 2, "cls, a, *rest").otherwise("size, **opts: dict")
    signature = F.concat(F.lit("def f("), inside, F.lit(")"), F.when(k % 2 == 0, " -> List[int] ").otherwise(""))
    return S.read(spark, d, "part").select(F.col("p_partkey").alias("id"), F.array_join(T.parameters(signature), ",").alias("parameters"), T.return_type(signature).alias("result"))


@register("l11_label", "SELECT doc_id, translate(t, '\"[]' || chr(10) || '`', '''() ''') AS label FROM (SELECT doc_id, '[' || left(text, 50) || ']\"`' AS t FROM documents)")
def _(spark, d):
    t = F.concat(F.lit("["), F.left("text", F.lit(50)), F.lit(']"`'))
    return S.read(spark, d, "documents").select("doc_id", T.sanitise_label(t).alias("label"))


@register("l12_xml", "SELECT page_id, md5(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;')) AS md5 FROM pages")
def _(spark, d):
    return S.read(spark, d, "pages").select("page_id", F.md5(T.xml_escape(F.col("html"))).alias("md5"))


@register("l18_json_reply", "SELECT event_id, CASE event_id % 4 WHEN 0 THEN props WHEN 1 THEN props WHEN 2 THEN NULL ELSE NULL END AS body FROM events")
def _(spark, d):
    k, props = F.col("event_id"), F.col("props")
    reply = F.when(k % 4 == 0, props).when(k % 4 == 1, F.concat(F.lit("Here it is:\n```json\n"), props, F.lit("\n```\nThat is all."))).when(k % 4 == 2, F.concat(F.lit("cut off "), F.left(props, F.lit(4)))).otherwise("no object")
    return S.read(spark, d, "events").select("event_id", T.json_object(reply).alias("body"))


@register("l20_clamped_fields", "SELECT doc_id, 8 AS n, least(length(text), 300) AS longest FROM documents")
def _(spark, d):
    fields = F.map_from_arrays(F.array(*[F.lit(f"k{i}") for i in range(10)]), F.array(*[F.col("text")] * 10))
    kept = T.clamp_fields(fields)
    return S.read(spark, d, "documents").select("doc_id", F.size(kept).cast("long").alias("n"), F.array_max(F.transform(F.map_values(kept), F.length)).cast("long").alias("longest"))


@register("l24_plural", "SELECT p_partkey AS id, p_size || CASE WHEN p_size = 1 THEN ' place' ELSE ' places' END AS words FROM part")
def _(spark, d):
    return S.read(spark, d, "part").select(F.col("p_partkey").alias("id"), T.plural(F.col("p_size"), "place").alias("words"))


_ROLE_SQL = {
    "test": "regexp_matches(t, '(?i)(^|/)tests?/|(^|[^A-Za-z0-9])test_')",
    "cache": "regexp_matches(t, '(?i)cach(e|ing)|redis|memoiz|(^|[^A-Za-z0-9])lru([^A-Za-z0-9]|$)')",
    "queue": "regexp_matches(t, '(?i)(^|[^A-Za-z0-9])queue([^A-Za-z0-9]|$)|celery|kafka|(^|[^A-Za-z0-9])mq([^A-Za-z0-9]|$)')",
    "worker": "regexp_matches(t, '(?i)(^|[^A-Za-z0-9])(worker|consumer)([^A-Za-z0-9]|$)|task_runner')",
    "validator": "regexp_matches(t, '(?i)(^|[^A-Za-z0-9])(validate|verify|sanitiz)|validator')",
    "parser": "regexp_matches(t, '(?i)(^|[^A-Za-z0-9])(parse|normali[sz]e|transform|extract|parser)([^A-Za-z0-9]|$)')",
    "calculator": "regexp_matches(t, '(?i)(^|[^A-Za-z0-9])(calculate|compute|predict|estimate|rank|model)([^A-Za-z0-9]|$)')",
    "database": "regexp_matches(t, '(?i)(^|[^A-Za-z0-9])repositor|(^|[^A-Za-z0-9])(backend|storage|save|persist|fetch|query)([^A-Za-z0-9]|$)')",
    "api": "regexp_matches(t, '(?i)dispatch|(^|[^A-Za-z0-9])(route|endpoint|view|handler)([^A-Za-z0-9]|$)')",
}
_ROLES = ("load", "cache_get", "work_queue", "my_worker", "validate_all", "parse_url", "compute", "save_row", "dispatcher", "lruX", "view", "extractor", "model", "mq")


@register("k19_role_counts", f"SELECT role, count(*) AS n FROM (SELECT CASE {' '.join(f"WHEN {sql} THEN '{role}'" for role, sql in _ROLE_SQL.items())} WHEN kind = 'class' THEN 'object' WHEN kind = 'method' THEN 'method' ELSE 'function' END AS role FROM (SELECT kind, {_pick_sql('id', *_ROLES)} || '.' || qualified_name || ' ' || file_path AS t FROM symbols)) GROUP BY role", S.SYMBOLS_SQL)
def _(spark, d):
    name = F.concat(_pick(F.col("id"), *_ROLES), F.lit("."), F.col("qualified_name"))
    role = T.role(name, F.col("file_path"), F.col("kind"))
    return S.symbols(spark, d).groupBy(role.alias("role")).agg(F.count("*").alias("n"))


# --- history and issues as they come

@register("a11_numstat", "SELECT sha, path, CAST(CASE WHEN n % 5 = 0 THEN 0 ELSE n END AS BIGINT) AS insertions, CAST(CASE WHEN n % 5 = 0 THEN 0 ELSE n % 3 END AS BIGINT) AS deletions FROM (SELECT sha, path, insertions AS n FROM commit_files)", S.SYMBOLS_SQL, S.COMMIT_FILES_SQL)
def _(spark, d):
    n = F.col("insertions")
    line = F.when(n % 5 == 0, F.concat(F.lit("-\t-\t"), F.col("path"))).otherwise(F.concat_ws("\t", n.cast("string"), (n % 3).cast("string"), "path"))
    log = S.commit_files(spark, d).groupBy("sha").agg(F.array_join(F.sort_array(F.collect_list(line)), "\n").alias("numstat"))
    return repository.parse_numstat(log.select("sha", F.concat(F.lit("\n"), "numstat", F.lit("\n")).alias("numstat"))).select("sha", "path", *_long("insertions", "deletions"))


@register("a10_newest_commits", "SELECT sha, place FROM (SELECT sha, row_number() OVER (ORDER BY authored_at DESC, sha DESC) AS place FROM commits) WHERE place <= 300", S.COMMITS_SQL)
def _(spark, d):
    return views.placed(S.commits(spark, d), F.desc("authored_at"), F.desc("sha"), limit=300).select("sha", "place")


@register(
    "a14_issue_rows",
    "SELECT event_id AS number, event_type IN ('purchase', 'signup') AS is_pull_request, event_type AS title, 'u' || user_id AS author, 'a,' || event_type AS labels, CAST(floor(epoch(ts)) AS BIGINT) AS created, CASE WHEN event_id % 3 = 0 THEN CAST(floor(epoch(ts)) AS BIGINT) END AS closed FROM events",
)
def _(spark, d):
    e = S.read(spark, d, "events")
    iso = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    pr = F.when(F.col("event_type").isin("purchase", "signup"), F.struct(F.lit("x").alias("url")))
    body = F.struct(F.col("event_id").alias("number"), F.col("event_type").alias("title"), F.struct(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("login")).alias("user"), F.array(F.struct(F.lit("a").alias("name")), F.struct(F.col("event_type").alias("name"))).alias("labels"), iso.alias("created_at"), F.when(F.col("event_id") % 3 == 0, iso).alias("closed_at"), pr.alias("pull_request"))
    rows = repository.parse_issues(e.select(F.to_json(body).alias("json")))
    return rows.select(*_long("number"), "is_pull_request", "title", "author", F.array_join("labels", ",").alias("labels"), F.unix_timestamp("created_at").alias("created"), F.unix_timestamp("closed_at").alias("closed"))


@register("a16_active_repo", "SELECT r_regionkey AS id, r_name AS name FROM region ORDER BY r_regionkey DESC LIMIT 1")
def _(spark, d):
    return mining.latest_repo(S.read(spark, d, "region").select(F.col("r_regionkey").alias("id"), F.col("r_name").alias("name")))


@register("e16_totals", "SELECT repo_id, count(*) FILTER (WHERE is_pull_request) AS pulls, count(*) FILTER (WHERE NOT is_pull_request) AS issues FROM issues GROUP BY repo_id", S.ISSUES_SQL)
def _(spark, d):
    return S.issues(spark, d).groupBy("repo_id").agg(F.count_if("is_pull_request").alias("pulls"), F.count_if(~F.col("is_pull_request")).alias("issues"))


# --- where results go

@register("b01_replace_rows", "SELECT repo_id, count(*) AS n, CAST(sum(v) AS BIGINT) AS v FROM (SELECT 1 AS repo_id, c_custkey * 10 AS v FROM customer WHERE c_custkey % 3 = 0 UNION ALL SELECT 2, c_custkey FROM customer) GROUP BY repo_id")
def _(spark, d):
    path = new_folder(spark, "replace")
    rows = S.read(spark, d, "customer").select(F.col("c_custkey").alias("v"))
    sinks.replace_rows(rows.crossJoin(spark.createDataFrame([(1,), (2,)], "repo_id int")), path)  # two rows
    sinks.replace_rows(rows.where("v % 3 = 0").select((F.col("v") * 10).alias("v"), F.lit(1).alias("repo_id")), path)
    return sinks.read_rows(spark, path).groupBy("repo_id").agg(F.count("*").alias("n"), F.sum("v").alias("v"))


@register("b02_replace_symbols", "SELECT 'symbols' AS entity, repo_id, count(*) AS n FROM (SELECT 2 AS repo_id, id FROM symbols UNION ALL SELECT 1, id FROM symbols WHERE id % 2 = 0) GROUP BY repo_id UNION ALL SELECT 'edges', 2, count(*) FROM edges", *GRAPH)
def _(spark, d):
    at, to = new_folder(spark, "symbols"), new_folder(spark, "edges")
    symbols, edges = S.symbols(spark, d).select("id", "name"), S.edges(spark, d).select("src", "dst", "tenths")
    for repo in (1, 2):
        sinks.replace_rows(symbols.withColumn("repo_id", F.lit(repo)), at)
        sinks.replace_rows(edges.withColumn("repo_id", F.lit(repo)), to)
    sinks.replace_symbols(symbols.where("id % 2 = 0").withColumn("repo_id", F.lit(1)), 1, at, to)
    counts = [sinks.read_rows(spark, p).groupBy("repo_id").agg(F.count("*").alias("n")).select(F.lit(name).alias("entity"), "repo_id", "n") for name, p in (("symbols", at), ("edges", to))]
    return counts[0].unionByName(counts[1])


@register("b03_replace_edges", "SELECT repo_id, count(*) AS n, CAST(sum(tenths) AS BIGINT) AS tenths FROM edges WHERE edge_type = 'call' GROUP BY repo_id", *GRAPH)
def _(spark, d):
    path, edges = new_folder(spark, "edges"), S.edges(spark, d)
    sinks.replace_rows(edges, path)
    sinks.replace_rows(edges.where("edge_type = 'call'"), path)
    return sinks.read_rows(spark, path).groupBy("repo_id").agg(F.count("*").alias("n"), F.sum("tenths").alias("tenths"))


@register("b07_conversations", "SELECT conv_id, count(*) AS turns FROM conversations WHERE conv_id % 5 <> 0 GROUP BY conv_id UNION ALL SELECT 1000000, 1")
def _(spark, d):
    path = new_folder(spark, "conversations")
    sinks.append_rows(S.read(spark, d, "conversations").select(F.lit(1).alias("repo_id"), "conv_id", "turn"), path)
    sinks.append_rows(spark.createDataFrame([(1, 1_000_000, 0)], "repo_id int, conv_id long, turn long"), path)
    sinks.delete_rows(spark, path, "conv_id % 5 = 0 and conv_id < 1000000")
    return sinks.read_rows(spark, path).groupBy("conv_id").agg(F.count("*").alias("turns"))


@register("b09_page_cache", "SELECT page_id % 5 AS repo_id, 's' || (page_id % 9) AS head_sha, arg_max(md5(html), page_id) AS md5 FROM pages WHERE page_id % 5 < 2 GROUP BY ALL")
def _(spark, d):
    repo = (F.col("page_id") % 5).alias("repo_id")
    cache = S.read(spark, d, "pages").select(repo, F.concat(F.lit("s"), (F.col("page_id") % 9).cast("string")).alias("head_sha"), F.col("html").alias("body"), F.col("page_id").alias("kept_at"))
    return sinks.cached_pages(cache, cache.where("repo_id < 2").select("repo_id", "head_sha")).select("repo_id", "head_sha", F.md5("body").alias("md5"))


@register("b12_tickets", "SELECT id, 'K' AS project, left('[' || severity || '] ' || title, 255) AS summary, title || chr(10) || chr(10) || file_path || ':' || start_line AS description, category AS label FROM findings", S.FINDINGS_SQL)
def _(spark, d):
    made = sinks.ticket_payloads(S.findings(spark, d), "K")
    at = {"project": "$.fields.project.key", "summary": "$.fields.summary", "description": "$.fields.description", "label": "$.fields.labels[0]"}
    return made.select("id", *[F.get_json_object("payload", p).alias(n) for n, p in at.items()])


@register("b13_telemetry", "SELECT event_type AS name, count(*) AS calls, CAST(sum(event_id % 97) AS BIGINT) AS total, avg(event_id % 97) AS mean FROM events GROUP BY event_type")
def _(spark, d):
    calls = S.read(spark, d, "events").select(F.col("event_type").alias("name"), (F.col("event_id") % 97).alias("seconds"))
    return sinks.telemetry(calls)


@register("b14_event_lines", "SELECT 'data: {\"id\":' || event_id || ',\"kind\":\"' || event_type || '\"}' || chr(10) || chr(10) AS line FROM events")
def _(spark, d):
    return sinks.event_lines(S.read(spark, d, "events").select(F.col("event_id").alias("id"), F.col("event_type").alias("kind")))


# --- findings

@register("c19_facets", "SELECT id, status = 'new' AS open FROM findings WHERE category = 'logic' AND severity = 'medium'", S.FINDINGS_SQL)
def _(spark, d):
    return findings.facets(S.findings(spark, d), "logic", "medium").select("id", "open")


_FOUND = "fl AS (SELECT 'd' || doc_id || CASE WHEN doc_id % 2 = 0 THEN '.py' ELSE '.md' END AS file_path, text FROM documents WHERE doc_id % 10 <> 0), fd AS (SELECT doc_id AS id, 'd' || doc_id || CASE WHEN doc_id % 2 = 0 THEN '.py' ELSE '.md' END AS file_path, doc_id % 4 AS a, doc_id % 4 + doc_id % 60 - 2 AS e FROM labels)"


@register(
    "d18_finding_files",
    "SELECT id, lang, CASE WHEN lines IS NULL OR n <= 0 THEN '' ELSE array_to_string(lines[f : f + least(n, 46) - 1], chr(10)) || CASE WHEN n > 46 THEN chr(10) || '…' ELSE '' END END AS snippet FROM (SELECT id, CASE WHEN ends_with(file_path, '.py') THEN 'python' END AS lang, string_split(text, chr(10)) AS lines, greatest(a, 1) AS f, least(greatest(e, greatest(a, 1)), len(string_split(text, chr(10)))) - greatest(a, 1) + 1 AS n FROM fd LEFT JOIN fl USING (file_path))",
    _FOUND,
)
def _(spark, d):
    name = F.concat(F.lit("d"), F.col("doc_id").cast("string"), F.when(F.col("doc_id") % 2 == 0, ".py").otherwise(".md"))
    files = S.read(spark, d, "documents").where("doc_id % 10 <> 0").select(F.lit(1).alias("repo_id"), name.alias("path"), F.col("text").alias("content"))
    k = F.col("doc_id")
    found = S.read(spark, d, "labels").select(F.lit(1).alias("repo_id"), k.alias("id"), name.alias("file_path"), (k % 4).alias("start_line"), (k % 4 + k % 60 - 2).alias("end_line"))
    return findings.with_files(found, files).select("id", "lang", "snippet")


@register("b06_ticketed", "SELECT id, CASE WHEN id % 13 = 0 THEN 'ticketed' ELSE status END AS status, CASE WHEN id % 13 = 0 THEN 'https://t/' || id END AS jira_url FROM findings", S.FINDINGS_SQL)
def _(spark, d):
    every = S.findings(spark, d)
    made = every.where("id % 13 = 0").select("id", F.concat(F.lit("https://t/"), F.col("id").cast("string")).alias("jira_url"))
    return findings.ticketed(every, made).select("id", "status", "jira_url")


@register("g11_findings_by_place", "SELECT id, row_number() OVER (ORDER BY file_path, start_line, title) AS place FROM findings", S.FINDINGS_SQL)
def _(spark, d):
    return views.placed(S.findings(spark, d), "file_path", "start_line", "title").select("id", "place")


# --- the graph

@register("c06_touching", "SELECT src, dst, edge_type FROM edges WHERE src % 100 = 0 OR dst % 100 = 0", *GRAPH)
def _(spark, d):
    own = S.symbols(spark, d).where("id % 100 = 0").select("id")
    return views.touching(S.edges(spark, d), own).select("src", "dst", "edge_type")


@register("e25_neighbours", "SELECT id, count(*) AS strength FROM (SELECT CASE WHEN src % 50 = 0 THEN dst ELSE src END AS id FROM edges WHERE (src % 50 = 0) <> (dst % 50 = 0)) GROUP BY id ORDER BY strength DESC, id LIMIT 30", *GRAPH)
def _(spark, d):
    return views.neighbours(S.edges(spark, d), S.symbols(spark, d).where("id % 50 = 0").select("id"), 30)


@register("h05_inner_pairs", "SELECT DISTINCT src, dst FROM edges WHERE src % 10 = 0 AND dst % 10 = 0 AND src <> dst", *GRAPH)
def _(spark, d):
    return views.inner_pairs(S.edges(spark, d), S.symbols(spark, d).where("id % 10 = 0").select("id"))


_STEPS = "pr AS (SELECT DISTINCT src, dst FROM edges WHERE edge_type = 'call'), walk AS (SELECT CAST({root} AS BIGINT) AS id, 1 AS step UNION SELECT p.dst, w.step + 1 FROM walk w JOIN pr p ON p.src = w.id WHERE w.step < 12), st AS (SELECT id, min(step) AS step FROM walk GROUP BY id)"


def _calls(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    pairs = S.edges(spark, d).where("edge_type = 'call'").select("src", "dst").distinct()
    return pairs, S.symbols(spark, d).select("id")


@register("i08_steps", _recursive(*GRAPH, _STEPS.format(root=START)) + " SELECT id, CAST(coalesce(step, 1) AS BIGINT) AS step FROM symbols LEFT JOIN st USING (id)")
def _(spark, d):
    pairs, nodes = _calls(spark, d)
    return views.steps(pairs, nodes, START, depth=11).select("id", *_long("step"))


@register("i09_walkthrough", _recursive(*GRAPH, _STEPS.format(root=START)) + " SELECT id, CAST(coalesce(step, (SELECT max(step) + 1 FROM st)) AS BIGINT) AS step FROM symbols LEFT JOIN st USING (id)")
def _(spark, d):
    pairs, nodes = _calls(spark, d)
    return views.steps(pairs, nodes, START, trailing=True, depth=11).select("id", *_long("step"))


@register("i19_ego", f"SELECT src, dst, edge_type FROM edges WHERE src IN (SELECT id FROM near) AND dst IN (SELECT id FROM near)", *GRAPH, f"near AS (SELECT src AS id FROM edges WHERE src = {START} OR dst = {START} UNION SELECT dst FROM edges WHERE src = {START} OR dst = {START})")
def _(spark, d):
    return views.ego(S.edges(spark, d), START).select("src", "dst", "edge_type")


@register("i20_expand", f"(SELECT 'caller' AS side, src AS id, 4 AS step FROM edges WHERE dst = {START} AND src <> {START} GROUP BY src ORDER BY max(tenths) DESC, src LIMIT 6) UNION ALL (SELECT 'callee', dst, 6 FROM edges WHERE src = {START} AND dst <> {START} GROUP BY dst ORDER BY max(tenths) DESC, dst LIMIT 6)", *GRAPH)
def _(spark, d):
    return views.expand(S.edges(spark, d), START, 5).select("side", "id", *_long("step"))


@register(
    "i21_facts",
    _recursive(*GRAPH, f"walk AS (SELECT CAST({START} AS BIGINT) AS node, 0 AS depth UNION SELECT e.dst, w.depth + 1 FROM walk w JOIN edges e ON e.src = w.node AND e.edge_type = 'call' WHERE w.depth < 2)", f"led AS (SELECT node, min(depth) AS depth FROM walk WHERE node <> {START} GROUP BY node)")
    + f" SELECT id, qualified_name, file_path || ':' || start_line AS citation, coalesce((SELECT string_agg(x, ', ' ORDER BY x) FROM (SELECT DISTINCT edge_type || ':' || s.qualified_name AS x FROM edges e JOIN symbols s ON s.id = e.src WHERE e.dst = {START} ORDER BY x LIMIT 15)), '(none internal)') AS dependents, coalesce((SELECT string_agg(n, ', ' ORDER BY depth, n) FROM (SELECT depth, s.qualified_name AS n FROM led JOIN symbols s ON s.id = led.node ORDER BY depth, n, node LIMIT 15)), '(none resolved)') AS leads_to FROM symbols WHERE id = {START}",
)
def _(spark, d):
    return views.facts(S.edges(spark, d), S.symbols(spark, d), START).select("id", "qualified_name", "citation", "dependents", "leads_to")


@register(
    "i05_call_flow",
    f"""SELECT node, CAST(depth AS INTEGER) AS depth FROM n0 UNION ALL SELECT * FROM n1 UNION ALL SELECT * FROM n2 UNION ALL SELECT * FROM n3""",
    *GRAPH,
    "calls AS (SELECT src, dst, tenths FROM (SELECT src, dst, max(tenths) AS tenths, row_number() OVER (PARTITION BY src ORDER BY max(tenths) DESC, dst) AS n FROM edges WHERE edge_type = 'call' GROUP BY src, dst) WHERE n <= 8)",
    f"n0 AS (SELECT CAST({START} AS BIGINT) AS node, 0 AS depth)",
    "n1 AS (SELECT dst AS node, 1 AS depth FROM calls WHERE src IN (SELECT node FROM n0) AND dst NOT IN (SELECT node FROM n0) GROUP BY dst ORDER BY min((-tenths, src, dst)) LIMIT 47)",
    "n2 AS (SELECT dst AS node, 2 AS depth FROM calls WHERE src IN (SELECT node FROM n1) AND dst NOT IN (SELECT node FROM n0 UNION ALL SELECT node FROM n1) GROUP BY dst ORDER BY min((-tenths, src, dst)) LIMIT (SELECT 47 - count(*) FROM n1))",
    "n3 AS (SELECT dst AS node, 3 AS depth FROM calls WHERE src IN (SELECT node FROM n2) AND dst NOT IN (SELECT node FROM n0 UNION ALL SELECT node FROM n1 UNION ALL SELECT node FROM n2) GROUP BY dst ORDER BY min((-tenths, src, dst)) LIMIT (SELECT 47 - (SELECT count(*) FROM n1) - (SELECT count(*) FROM n2)))",
)
def _(spark, d):
    nodes, _edges = graph.call_flow(S.edges(spark, d), START)
    return spark.createDataFrame(nodes, "node long, depth int")


@register("q07_flow_view", f"SELECT id, qualified_name, CASE WHEN regexp_matches(qualified_name || ' ' || file_path, '(^|/)tests?/') THEN 'test' WHEN kind = 'class' THEN 'object' WHEN kind = 'method' THEN 'method' ELSE 'function' END AS role, CAST(1 AS BIGINT) AS step FROM symbols WHERE id = {START} UNION ALL SELECT id, qualified_name, CASE WHEN regexp_matches(qualified_name || ' ' || file_path, '(^|/)tests?/') THEN 'test' WHEN kind = 'class' THEN 'object' WHEN kind = 'method' THEN 'method' ELSE 'function' END, 2 FROM symbols WHERE id IN (SELECT dst FROM edges WHERE src = {START} AND edge_type = 'call' AND dst <> {START})", *GRAPH)
def _(spark, d):
    nodes, _edges = graph.call_flow(S.edges(spark, d), START, depth=1, fanout=1000, max_nodes=1000)
    flow = spark.createDataFrame(nodes, "node long, depth int")
    first = views.flow_nodes(flow, S.symbols(spark, d))
    return views.merged_nodes(first, first.where("step = 1").withColumn("step", F.lit(9))).select("id", "qualified_name", "role", *_long("step"))


@register("i15_combined", "SELECT 'file' AS level, source, target, weight FROM links UNION ALL SELECT 'symbol', CAST(src AS VARCHAR), CAST(dst AS VARCHAR), count(*) FROM ends WHERE starts_with(src_file, 'src/small/') AND starts_with(dst_file, 'src/small/') GROUP BY ALL", *GRAPH, ENDS, LINKS)
def _(spark, d):
    return graph.combined(S.edges(spark, d), S.symbols(spark, d), "src/small/").select("level", "source", "target", "weight")


@register("i14_symbol_graph_neighbours", "SELECT src, dst, edge_type, tenths FROM ends WHERE (own_s OR src IN (SELECT id FROM more)) AND (own_d OR dst IN (SELECT id FROM more)) AND (own_s OR own_d)", *GRAPH,
    "ends AS (SELECT e.*, starts_with(s.file_path, 'src/small/brand1') AS own_s, starts_with(t.file_path, 'src/small/brand1') AS own_d FROM edges e JOIN symbols s ON s.id = e.src JOIN symbols t ON t.id = e.dst)",
    "linked AS (SELECT src AS id FROM ends WHERE own_s UNION SELECT dst FROM ends WHERE own_d)",
    "more AS (SELECT id FROM (SELECT CASE WHEN own_s THEN dst ELSE src END AS id, count(*) AS n FROM ends WHERE own_s <> own_d GROUP BY 1) ORDER BY n DESC, id LIMIT (SELECT greatest(0, 200 - count(*)) FROM linked))",
)
def _(spark, d):
    return graph.symbol_graph(S.edges(spark, d), S.symbols(spark, d), "src/small/brand1", max_nodes=200).select("src", "dst", "edge_type", "tenths")


@register("g23_most_connected", "SELECT path, CAST(sum(weight) AS BIGINT) AS degree, row_number() OVER (ORDER BY sum(weight) DESC, path) AS place FROM (SELECT source AS path, weight FROM links UNION ALL SELECT target, weight FROM links) GROUP BY path QUALIFY place <= 10", *GRAPH, ENDS, LINKS)
def _(spark, d):
    return views.most_connected(graph.file_graph(S.edges(spark, d), S.symbols(spark, d))).select("path", "degree", "place")


@register("g23_linked_files", "SELECT path, CAST(sum(weight) AS BIGINT) AS weight, row_number() OVER (ORDER BY sum(weight) DESC, path) AS place FROM (SELECT target AS path, weight FROM links WHERE source = 'src/small/brand1.py' UNION ALL SELECT source, weight FROM links WHERE target = 'src/small/brand1.py') GROUP BY path", *GRAPH, ENDS, LINKS)
def _(spark, d):
    return views.linked_files(graph.file_graph(S.edges(spark, d), S.symbols(spark, d)), "src/small/brand1.py").select("path", "weight", "place")


@register("g13_callers_in_order", f"SELECT side, id, row_number() OVER (PARTITION BY side ORDER BY tenths DESC, id, edge_type) AS place FROM (SELECT 'caller' AS side, src AS id, edge_type, tenths FROM ends WHERE dst = {START} UNION ALL SELECT 'callee', dst, edge_type, tenths FROM ends WHERE src = {START})", *GRAPH, ENDS)
def _(spark, d):
    detail = mining.symbol_detail(S.edges(spark, d), S.symbols(spark, d), START)
    return views.placed(detail, F.desc("tenths"), "id", "edge_type", by=("side",)).select("side", "id", "place")


_FAMILIES = "mem AS (SELECT id % 23 AS community, id FROM symbols WHERE NOT starts_with(file_path, 'tests/') AND id % 23 < 20)"
_WEIGHTED = "wg AS (SELECT least(src, dst) AS a, greatest(src, dst) AS b, sum(tenths) AS w FROM ends WHERE NOT starts_with(src_file, 'tests/') AND NOT starts_with(dst_file, 'tests/') GROUP BY ALL), dg AS (SELECT id, CAST(sum(w) AS BIGINT) AS degree FROM (SELECT a AS id, w FROM wg UNION ALL SELECT b, w FROM wg) GROUP BY id)"
_RANKED = "mr AS (SELECT m.community, s.*, coalesce(degree, 0) AS degree, regexp_replace(file_path, '/[^/]*$', '') AS dir FROM mem m JOIN symbols s USING (id) LEFT JOIN dg USING (id))"


def _described(spark: SparkSession, d: str) -> DataFrame:
    symbols = S.symbols(spark, d)
    members = symbols.where("not startswith(file_path, 'tests/') and id % 23 < 20").select("repo_id", (F.col("id") % 23).alias("community"), "id")
    return graph.describe_communities(members, S.edges(spark, d), symbols)


@register(
    "e26_communities",
    "SELECT community, size, folders, primary_dir, label, total, place FROM (SELECT c.*, count(*) OVER () AS total, row_number() OVER (ORDER BY size DESC, community) AS place FROM (SELECT community, count(*) AS size, count(DISTINCT dir) AS folders, (SELECT dir FROM mr y WHERE y.community = x.community GROUP BY dir ORDER BY count(*) DESC, dir LIMIT 1) AS primary_dir, coalesce((SELECT name FROM mr y WHERE y.community = x.community AND kind = 'class' ORDER BY degree DESC, id LIMIT 1), (SELECT regexp_extract(file_path, '[^/]+$') FROM mr y WHERE y.community = x.community GROUP BY file_path ORDER BY count(*) DESC, file_path LIMIT 1)) AS label FROM mr x GROUP BY community) c) WHERE place <= 12",
    *GRAPH, ENDS, _FAMILIES, _WEIGHTED, _RANKED,
)
def _(spark, d):
    return _described(spark, d).select("community", "size", "folders", "primary_dir", "label", *_long("total", "place"))


@register(
    "f04_community_members",
    "SELECT community, id, place FROM (SELECT community, id, row_number() OVER (PARTITION BY community ORDER BY degree DESC, id) AS place FROM mr) WHERE place <= 20 AND community IN (SELECT community FROM mr GROUP BY community ORDER BY count(*) DESC, community LIMIT 12)",
    *GRAPH, ENDS, _FAMILIES, _WEIGHTED, _RANKED,
)
def _(spark, d):
    return _described(spark, d).select("community", F.explode("members").alias("m")).select("community", "m.id", F.col("m.at").cast("long").alias("place"))


# --- ordered lists

@register("g01_coupling_list", "SELECT a, b, co_changes, place FROM (SELECT *, row_number() OVER (ORDER BY strength DESC, co_changes DESC, a, b) AS place FROM coupling) WHERE place <= 12", *HISTORY, COUPLING)
def _(spark, d):
    pairs = mining.coupling(S.commits(spark, d), S.commit_files(spark, d))
    return views.placed(pairs, F.desc("strength"), F.desc("co_changes"), "a", "b", limit=12).select("a", "b", "co_changes", "place")


@register("d19_coupled_files", "SELECT CASE WHEN a = f THEN b ELSE a END AS path, co_changes FROM (SELECT *, (SELECT min(a) FROM coupling) AS f FROM (SELECT * FROM coupling ORDER BY strength DESC, co_changes DESC, a, b LIMIT 500)) WHERE a = f OR b = f ORDER BY strength DESC, co_changes DESC, a, b LIMIT 8", *HISTORY, COUPLING)
def _(spark, d):
    pairs = mining.coupling(S.commits(spark, d), S.commit_files(spark, d))
    first = pairs.agg(F.min("a")).first()[0]
    return mining.coupled_files(pairs, first or "").select("path", "co_changes")


@register("g04_hotspot_list", "SELECT path, churn * (degree + 1) AS raw, row_number() OVER (ORDER BY churn * (degree + 1) DESC, path) AS place FROM hot QUALIFY place <= 5", *GRAPH, S.COMMIT_FILES_SQL, ENDS, DEGREE, HOT)
def _(spark, d):
    hot = mining.hotspots(S.edges(spark, d), S.symbols(spark, d), S.commit_files(spark, d))
    return views.placed(hot, F.desc("raw"), "path", limit=5).select("path", "raw", "place")


@register("g05_tree_list", "SELECT path, symbols, row_number() OVER (ORDER BY path) AS place FROM (SELECT f.path, count(s.id) AS symbols FROM files f LEFT JOIN symbols s ON s.file_path = f.path GROUP BY f.path)", S.SYMBOLS_SQL, FILES)
def _(spark, d):
    return views.placed(mining.tree(_files(spark, d), S.symbols(spark, d)), "path").select("path", "symbols", "place")


@register("g05_symbols_of_files", "SELECT file_path, id, row_number() OVER (PARTITION BY file_path ORDER BY start_line, id) AS place FROM symbols", S.SYMBOLS_SQL)
def _(spark, d):
    return views.placed(S.symbols(spark, d), "start_line", "id", by=("repo_id", "file_path")).select("file_path", "id", "place")


_ENTRY_CODE = ("@app.get('/t')\ndef f(): pass", "def g(): pass", "@bp.route(\"/x/y\")\ndef f(): pass", "@click.command()\ndef f(): pass", "@shared_task\ndef f(): pass", "app.add_url_rule('/u')", "@router.post(path)\ndef f(): pass", "@cli.command\ndef f(): pass", "@celery.task\ndef f(): pass", "@x.task()\ndef f(): pass", "class A: pass")
_ENTRY_KINDS = ("route", None, "route", "cli", "worker", "route", "route", "cli", "worker", "worker", None)
_ENTRY_LABELS = ("/t", None, "/x/y", None, None, "/u", None, None, None, None, None)
_ENTRIES = (
    "en AS (SELECT *, CASE id % 11 " + " ".join(f"WHEN {i} THEN '{k}'" for i, k in enumerate(_ENTRY_KINDS) if k) + " END AS marked, CASE id % 11 " + " ".join(f"WHEN {i} THEN '{x}'" for i, x in enumerate(_ENTRY_LABELS) if x) + " END AS shown, CASE id % 6 WHEN 0 THEN 'create_app' WHEN 1 THEN 'main' ELSE name END AS own FROM symbols WHERE kind <> 'class' AND NOT starts_with(file_path, 'tests/')), "
    "ep AS (SELECT coalesce(marked, CASE WHEN own = 'create_app' THEN 'factory' WHEN own = 'main' AND kind = 'function' THEN 'main' END) AS kind, coalesce(shown, qualified_name) AS label, file_path AS path, CAST(start_line AS BIGINT) AS line, CAST(id AS BIGINT) AS symbol_id FROM en UNION ALL SELECT 'module', doc_id || '.py', 'pkg/' || doc_id || '.py', 3, NULL FROM documents WHERE doc_id % 3 = 0), "
    "eps AS (SELECT * FROM ep WHERE kind IS NOT NULL)"
)


def _entrypoints(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("id")
    name = F.when(k % 6 == 0, "create_app").when(k % 6 == 1, "main").otherwise(F.col("name"))
    symbols = S.symbols(spark, d).withColumn("code", _pick(k, *_ENTRY_CODE)).withColumn("name", name)
    content = F.when(F.col("doc_id") % 3 == 0, "import x\n\nif __name__ == '__main__':\n    x.run()").otherwise("import x")
    files = S.read(spark, d, "documents").select(F.lit(1).alias("repo_id"), F.concat(F.lit("pkg/"), F.col("doc_id").cast("string"), F.lit(".py")).alias("path"), F.lit("code").alias("category"), content.alias("content"))
    return mining.entrypoints(symbols, files)


@register("k07_entrypoints", "SELECT kind, label, path, line, symbol_id FROM eps", S.SYMBOLS_SQL, _ENTRIES)
def _(spark, d):
    return _entrypoints(spark, d).select("kind", "label", "path", "line", "symbol_id")


@register("g07_entrypoint_list", "SELECT kind, path, line, place FROM (SELECT *, row_number() OVER (ORDER BY CASE kind WHEN 'route' THEN 1 WHEN 'factory' THEN 2 WHEN 'cli' THEN 3 WHEN 'worker' THEN 4 WHEN 'main' THEN 5 ELSE 6 END, path, line, symbol_id) AS place FROM eps)", S.SYMBOLS_SQL, _ENTRIES)
def _(spark, d):
    return views.placed(_entrypoints(spark, d), "kind_rank", "path", "line", "symbol_id").select("kind", "path", "line", "place")


@register("q05_entrypoints_by_kind", "SELECT kind, count(*) AS n FROM eps GROUP BY kind", S.SYMBOLS_SQL, _ENTRIES)
def _(spark, d):
    return _entrypoints(spark, d).groupBy("kind").agg(F.count("*").alias("n"))


_DEAD = "dead AS (SELECT id, qualified_name, kind, file_path AS path, start_line AS line, CASE WHEN starts_with(name, '_') THEN 'private' ELSE 'public' END AS visibility FROM symbols s WHERE kind IN ('function', 'method') AND id NOT IN (SELECT dst FROM edges) AND id NOT IN (SELECT symbol_id FROM eps WHERE symbol_id IS NOT NULL) AND NOT starts_with(file_path, 'tests/') AND NOT starts_with(name, 'test_') AND NOT starts_with(code, '@'))"


def _dead(spark: SparkSession, d: str) -> DataFrame:
    return mining.dead_code(S.symbols(spark, d), S.edges(spark, d), _entrypoints(spark, d))


@register("k08_dead_code_entrypoints", "SELECT id, path, line, visibility FROM dead", *GRAPH, _ENTRIES, _DEAD)
def _(spark, d):
    return _dead(spark, d).select("id", "path", "line", "visibility")


@register("g06_dead_code_list", "SELECT id, row_number() OVER (ORDER BY visibility, path, line, id) AS place FROM dead", *GRAPH, _ENTRIES, _DEAD)
def _(spark, d):
    return views.placed(_dead(spark, d), "visibility", "path", "line", "id").select("id", "place")


@register("e16_visibility_totals", "SELECT 1 AS repo_id, count(*) FILTER (WHERE visibility = 'private') AS private, count(*) FILTER (WHERE visibility = 'public') AS public FROM dead", *GRAPH, _ENTRIES, _DEAD)
def _(spark, d):
    return mining.visibility_totals(_dead(spark, d))


@register("g08_folder_list", "SELECT dir, fan_in, row_number() OVER (ORDER BY fan_in DESC, symbols DESC, dir) AS place FROM (SELECT dir, symbols, CAST(round_even(coalesce(i, 0) / 10, 0) AS BIGINT) AS fan_in FROM (SELECT dir, count(*) AS symbols FROM dirs GROUP BY dir) LEFT JOIN (SELECT t.dir, sum(tenths) AS i FROM edges e JOIN dirs s ON e.src = s.id JOIN dirs t ON e.dst = t.id WHERE s.dir <> t.dir GROUP BY t.dir) USING (dir) WHERE NOT starts_with(dir, 'tests')) QUALIFY place <= 12", *GRAPH, "dirs AS (SELECT id, regexp_replace(file_path, '/[^/]*$', '') AS dir FROM symbols)")
def _(spark, d):
    heat = mining.folder_heat(S.edges(spark, d), S.symbols(spark, d))
    return views.placed(heat, F.desc("fan_in"), F.desc("symbols"), "dir", limit=12).select("dir", "fan_in", "place")


_PACKAGE = "pk AS (SELECT CASE WHEN len(string_split(path, '/')) > 2 THEN split_part(path, '/', 1) || '/' || split_part(path, '/', 2) ELSE split_part(path, '/', 1) END AS package FROM files), pr AS (SELECT package FROM pk GROUP BY package ORDER BY count(*) DESC, package LIMIT 1), sm AS (SELECT f.path, substr(f.path, length(pr.package) + 2) AS rest, (SELECT count(*) FROM symbols s WHERE s.file_path = f.path) AS n FROM files f, pr WHERE starts_with(f.path, pr.package || '/')), sp AS (SELECT path, CASE WHEN contains(rest, '/') THEN split_part(rest, '/', 1) ELSE 'core' END AS submodule, n FROM sm)"


@register("f03_submodule_files", "SELECT submodule, string_agg(path, ',' ORDER BY n DESC, path) AS evidence FROM (SELECT *, row_number() OVER (PARTITION BY submodule ORDER BY n DESC, path) AS r FROM sp) WHERE r <= 3 GROUP BY submodule", S.SYMBOLS_SQL, FILES, _PACKAGE)
def _(spark, d):
    return mining.submodules(_files(spark, d), S.symbols(spark, d)).select("submodule", F.array_join("evidence", ",").alias("evidence"))


@register("g15_submodule_list", "SELECT submodule, row_number() OVER (ORDER BY sum(n) DESC, submodule) AS place FROM sp GROUP BY submodule", S.SYMBOLS_SQL, FILES, _PACKAGE)
def _(spark, d):
    return views.placed(mining.submodules(_files(spark, d), S.symbols(spark, d)), F.desc("symbols"), "submodule").select("submodule", "place")


@register("g16_core_models", "SELECT s.id, CAST(sum(e.tenths) AS BIGINT) AS fan_in FROM symbols s JOIN ends e ON e.dst = s.id AND NOT starts_with(e.src_file, 'tests/') WHERE s.kind = 'class' AND starts_with(s.file_path, 'src/small/') GROUP BY s.id HAVING sum(e.tenths) >= 20 ORDER BY fan_in DESC, id LIMIT 3", *GRAPH, ENDS)
def _(spark, d):
    symbols, edges = S.symbols(spark, d), S.edges(spark, d)
    return mining.core_models(symbols, mining.fan_in_out(edges, symbols), "src/small").select("id", "fan_in")


_UP = f"walk AS (SELECT CAST({START} AS BIGINT) AS node, 0 AS depth UNION SELECT e.src, w.depth + 1 FROM walk w JOIN edges e ON e.dst = w.node AND e.edge_type = 'call' WHERE w.depth < 3), up AS (SELECT node AS id, min(depth) AS depth FROM walk WHERE node <> {START} GROUP BY node)"


@register("g14_impact_list", _recursive(*GRAPH, _UP) + f" SELECT CAST({START} AS BIGINT) AS start, id, CAST(depth AS BIGINT) AS depth, starts_with(file_path, 'tests/') AS tests, row_number() OVER (ORDER BY depth, qualified_name, id) AS place FROM up JOIN symbols USING (id)")
def _(spark, d):
    starts = spark.range(START, START + 1)
    return mining.impact_callers(S.edges(spark, d), S.symbols(spark, d), starts).select("start", "id", *_long("depth"), "tests", *_long("place"))


@register("k12_risk_reasons", "SELECT id, direct, CASE WHEN direct = 0 AND NOT entry THEN 'Nothing in the repository calls this; it may still be used from outside.' WHEN tested = 0 AND direct >= 3 THEN 'Called from ' || direct || ' places with no test found on the way: a change is wide and unchecked.' WHEN tested = 0 THEN 'No test was found on the way: check a change by hand.' WHEN direct >= 6 THEN 'Called from ' || direct || ' places, with tests: look at the callers.' ELSE 'Tests were found, and the callers are few.' END AS reason FROM (SELECT s.id, s.id % 40 = 0 AS entry, count(DISTINCT e.src) AS direct, count(DISTINCT e.src) FILTER (WHERE starts_with(e.src_file, 'tests/')) AS tested FROM symbols s LEFT JOIN ends e ON e.dst = s.id AND e.edge_type = 'call' GROUP BY s.id)", *GRAPH, ENDS)
def _(spark, d):
    starts = S.symbols(spark, d).select("id", (F.col("id") % 40 == 0).alias("entrypoint"))
    rows = mining.impact(S.edges(spark, d), S.symbols(spark, d), starts, depth=1).join(starts, "id")
    return rows.select("id", "direct", mining.risk_reason(F.col("direct"), F.col("test_callers"), F.col("entrypoint")).alias("reason"))


@register("g18_codemap_order", "SELECT id, place FROM (SELECT id, row_number() OVER (ORDER BY id % 5, qualified_name, id) AS place FROM symbols) WHERE place <= 22", S.SYMBOLS_SQL)
def _(spark, d):
    nodes = S.symbols(spark, d).withColumn("step", F.col("id") % 5)
    return views.placed(nodes, "step", "qualified_name", "id", limit=22).select("id", "place")


# --- lists of ids and evidence

_TURNS = "t AS (SELECT conv_id * 100 + turn AS rank, (conv_id * 7 + turn) % 40 AS id, role, left(text, 12) AS title FROM conversations)"


def _turns(spark: SparkSession, d: str) -> DataFrame:
    c = S.read(spark, d, "conversations")
    return c.select((F.col("conv_id") * 100 + F.col("turn")).alias("rank"), ((F.col("conv_id") * 7 + F.col("turn")) % 40).alias("id"), "role", F.left("text", F.lit(12)).alias("title"))


@register("d20_in_order", "SELECT id, qualified_name, rank FROM (SELECT id, min(rank) AS rank FROM t GROUP BY id) JOIN symbols USING (id)", S.SYMBOLS_SQL, _TURNS)
def _(spark, d):
    return views.in_order(_turns(spark, d).select("id", "rank"), S.symbols(spark, d).select("id", "qualified_name"))


@register("f11_first_seen", "SELECT id, min(rank) AS rank, arg_min(role, rank) AS role FROM t GROUP BY id", _TURNS)
def _(spark, d):
    return views.first_seen(_turns(spark, d).select("id", "rank", "role"), ["id"], "rank")


@register("h07_distinct_ids", "SELECT conv_id, array_to_string(list(id ORDER BY turn), ',') AS ids FROM (SELECT conv_id, (turn * 3) % 4 AS id, min(turn) AS turn FROM conversations GROUP BY ALL) GROUP BY conv_id")
def _(spark, d):
    c = S.read(spark, d, "conversations").select("conv_id", F.struct("turn", ((F.col("turn") * 3) % 4).alias("id")).alias("x"))
    ordered = F.transform(F.array_sort(F.collect_list("x")), lambda x: x["id"].cast("string"))
    return c.groupBy("conv_id").agg(F.array_join(F.array_distinct(ordered), ",").alias("ids"))


@register("h04_not_shown", "SELECT id, min(rank) AS rank FROM t WHERE id % 3 <> 0 GROUP BY id ORDER BY rank LIMIT 10", _TURNS)
def _(spark, d):
    return views.not_shown(_turns(spark, d).select("id", "rank"), spark.range(0, 60, 3), 10)


@register("h06_merged_evidence", "SELECT role AS stream, title, min(rank) AS rank FROM t GROUP BY ALL ORDER BY rank LIMIT 24", _TURNS)
def _(spark, d):
    rows = _turns(spark, d).select(F.col("role").alias("stream"), F.lit("c").alias("citation"), "title", "rank", "id")
    return views.merged_evidence(rows).select("stream", "title", "rank")


@register("f12_first_callees", "SELECT src, name, place FROM (SELECT src, name, row_number() OVER (PARTITION BY src ORDER BY min(rank)) AS place FROM (SELECT e.src, s.name, e.dst * 2 + CASE edge_type WHEN 'call' THEN 0 ELSE 1 END AS rank FROM edges e JOIN symbols s ON s.id = e.dst) GROUP BY src, name) WHERE place <= 6", *GRAPH)
def _(spark, d):
    names = S.symbols(spark, d).select(F.col("id").alias("dst"), "name")
    rank = F.col("dst") * 2 + F.when(F.col("edge_type") == "call", 0).otherwise(1)
    return views.first_callees(S.edges(spark, d).join(names, "dst").select("src", "name", rank.alias("rank"))).select("src", "name", "place")


@register("d22_definitions", "SELECT name, array_to_string(list(id ORDER BY callers DESC, id), ',') AS ids FROM (SELECT s.id, s.name, count(e.dst) AS callers FROM symbols s LEFT JOIN edges e ON e.dst = s.id GROUP BY s.id, s.name) GROUP BY name", *GRAPH)
def _(spark, d):
    return mining.definitions(S.symbols(spark, d), S.edges(spark, d)).select("name", F.array_join(F.transform("ids", lambda i: i.cast("string")), ",").alias("ids"))


@register("d16_symbol_source", "SELECT id, array_to_string(string_split(text, chr(10))[a:b], chr(10)) AS source FROM (SELECT doc_id AS id, doc_id % 3 + 1 AS a, doc_id % 3 + 1 + doc_id % 4 AS b FROM labels) JOIN documents ON doc_id = id")
def _(spark, d):
    k = F.col("doc_id")
    path = F.concat(F.lit("d"), k.cast("string"))
    files = S.read(spark, d, "documents").select(F.lit(1).alias("repo_id"), path.alias("path"), F.col("text").alias("content"))
    symbols = S.read(spark, d, "labels").select(F.lit(1).alias("repo_id"), k.alias("id"), path.alias("file_path"), (k % 3 + 1).cast("int").alias("start_line"), (k % 3 + 1 + k % 4).cast("int").alias("end_line"))
    return views.source_of(symbols, files)


@register("q06_section_files", "SELECT 's' || (id % 6) AS key, string_agg(DISTINCT file_path, ',' ORDER BY file_path) AS paths FROM symbols GROUP BY 1", S.SYMBOLS_SQL)
def _(spark, d):
    symbols = S.symbols(spark, d)
    made = views.section_files(symbols.select(F.concat(F.lit("s"), (F.col("id") % 6).cast("string")).alias("key"), "id"), symbols.select("id", "file_path"))
    return made.select("key", F.array_join("paths", ",").alias("paths"))


@register("c17_code_evidence", "SELECT id, qualified_name AS title, file_path || ':' || start_line AS citation, left(code, 200) AS snippet, left(code, 1500) AS body, file_path AS path FROM symbols", S.SYMBOLS_SQL)
def _(spark, d):
    return views.code_evidence(S.symbols(spark, d)).drop("stream")


@register("j09_text_evidence", "SELECT 'issue:' || number AS id, title, 'issue #' || number AS citation, title AS snippet FROM issues WHERE NOT is_pull_request UNION ALL SELECT 'issue:' || number, title, 'PR #' || number, title FROM issues WHERE is_pull_request", S.ISSUES_SQL)
def _(spark, d):
    issues = S.issues(spark, d).withColumn("body", F.lit(None).cast("string"))
    return views.text_evidence(retrieval.evidence_documents(None, None, issues)).select("id", "title", "citation", "snippet")


def _length(prompt: str) -> str:
    """A model that needs no network."""
    return str(len(prompt))


@register("j12_model_answers", "SELECT doc_id, CAST(length(text) AS VARCHAR) AS answer, CAST(NULL AS VARCHAR) AS error FROM documents")
def _(spark, d):
    stage = ModelStage(spark, new_folder(spark, "answers"), "length", _length)
    return stage.ask(S.read(spark, d, "documents").select("doc_id", F.col("text").alias("prompt"))).select("doc_id", "answer", "error")


@register("j11_embedding_text", "SELECT id, kind || ' ' || qualified_name || chr(10) || 'def ' || name || '(self, ' || lower(p_type) || ': int) -> ' || lower(replace(p_brand, '#', '')) || chr(10) || left(code, 500) AS text FROM symbols JOIN part ON p_partkey = id", S.SYMBOLS_SQL)
def _(spark, d):
    return retrieval.symbol_embedding_text(S.symbols(spark, d).withColumn("docstring", F.lit(None).cast("string"))).select("id", "text")


# --- search over several fields

_TERMS = "regexp_extract_all(lower({}), '[\\p{{L}}\\p{{N}}_]+')"


def _field_sql(n: int, field: str, boost: float) -> str:
    return f"""w{n} AS (SELECT id, {_TERMS.format(field)} AS terms FROM fx),
s{n} AS (SELECT count(*) AS n, avg(len(terms)) AS avgdl FROM w{n} WHERE len(terms) > 0),
t{n} AS (SELECT id, dl, term, count(*) AS tf FROM (SELECT id, len(terms) AS dl, unnest(terms) AS term FROM w{n}) WHERE term IN (SELECT term FROM qx) GROUP BY ALL),
d{n} AS (SELECT term, count(*) AS df FROM t{n} GROUP BY term),
f{n} AS (SELECT qx.query_id, t{n}.id, {boost} * sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * dl / avgdl))) AS score FROM qx JOIN t{n} USING (term) JOIN d{n} USING (term), s{n} GROUP BY ALL)"""


def _best_field_sql(fields: dict[str, float]) -> str:
    parts = ",\n".join(_field_sql(i, f, b) for i, (f, b) in enumerate(fields.items()))
    union = " UNION ALL ".join(f"SELECT * FROM f{i}" for i in range(len(fields)))
    return parts + f",\nbf AS (SELECT query_id, id, round(max(score), 6) AS score FROM ({union}) GROUP BY ALL)"


_QX = f"qx AS (SELECT n_nationkey AS query_id, unnest(list_distinct({_TERMS.format('q')})) AS term FROM (SELECT n_nationkey, (SELECT name || ' def brand' || n_nationkey FROM symbols WHERE id = n_nationkey * 3) AS q FROM nation))"
_CODE = (
    S.SYMBOLS_SQL,
    """fx AS (SELECT CAST(id AS VARCHAR) AS id, kind, qualified_name, replace(name, '_', ' ') AS name, code, 'Part of ' || file_path AS docstring,
  'def ' || name || '(self, ' || lower(p_type) || ': int) -> ' || lower(replace(p_brand, '#', '')) AS signature FROM symbols JOIN part ON p_partkey = id)""",
    _QX,
    _best_field_sql(retrieval.CODE_FIELDS),
)


def _code_docs(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    symbols = S.symbols(spark, d)
    name = F.replace("name", F.lit("_"), F.lit(" ")).alias("name")
    docs = symbols.select(F.col("id").cast("string").alias("id"), "kind", "qualified_name", name, "code", "signature", F.concat(F.lit("Part of "), "file_path").alias("docstring"))
    nation = S.read(spark, d, "nation").select(F.col("n_nationkey").alias("query_id"))
    asked = nation.join(symbols.select("id", "name"), F.col("id") == F.col("query_id") * 3)
    return docs, asked.select("query_id", F.concat_ws(" ", "name", F.lit("def"), F.concat(F.lit("brand"), F.col("query_id").cast("string"))).alias("text"))


def _code_index(spark: SparkSession, d: str) -> tuple[InvertedIndex, DataFrame]:
    docs, asked = _code_docs(spark, d)
    index = InvertedIndex(spark, new_folder(spark, "code-index"))
    index.replace(docs, list(retrieval.CODE_FIELDS), facets=("kind",))
    return index, asked


@register("j01_code_fields_topk", "SELECT query_id, id, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM bf) WHERE rank <= 10", *_CODE)
def _(spark, d):
    index, asked = _code_index(spark, d)
    return index.search(asked, retrieval.CODE_FIELDS, 10).select("query_id", "id", *_long("rank"))


@register("j05_kind_filtered", "SELECT query_id, id, rank FROM (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM bf JOIN fx USING (id) WHERE kind = 'class') WHERE rank <= 10", *_CODE)
def _(spark, d):
    index, asked = _code_index(spark, d)
    return index.search(asked, retrieval.CODE_FIELDS, 10, F.col("kind") == "class").select("query_id", "id", *_long("rank"))


_EVIDENCE = (
    "fx AS (SELECT CAST(doc_id AS VARCHAR) AS id, source AS stream, lang || ' ' || source AS title, text FROM documents)",
    f"qx AS (SELECT item_id AS query_id, unnest(list_distinct({_TERMS.format('q')})) AS term FROM (SELECT item_id, text || ' en src3' AS q FROM benchmark))",
    _best_field_sql(retrieval.EVIDENCE_FIELDS),
)


@register("j02_stream_filtered", "SELECT query_id, id, rank FROM (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM bf JOIN fx USING (id) WHERE stream IN ('src1', 'src3')) WHERE rank <= 10", *_EVIDENCE)
def _(spark, d):
    docs = S.read(spark, d, "documents").select(F.col("doc_id").cast("string").alias("id"), F.col("source").alias("stream"), F.concat_ws(" ", "lang", "source").alias("title"), "text")
    asked = S.read(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.concat("text", F.lit(" en src3")).alias("text"))
    index = InvertedIndex(spark, new_folder(spark, "evidence-index"))
    index.replace(docs, list(retrieval.EVIDENCE_FIELDS), facets=("stream",))
    return index.search(asked, retrieval.EVIDENCE_FIELDS, 10, F.col("stream").isin("src1", "src3")).select("query_id", "id", *_long("rank"))


@register("b04_stored_postings", f"SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS tf FROM (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({_TERMS.format('text')}) AS term FROM documents) GROUP BY ALL) GROUP BY term")
def _(spark, d):
    index = InvertedIndex(spark, new_folder(spark, "index"))
    docs = S.read(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")
    index.replace(docs.limit(0), ["text"])
    index.replace(docs, ["text"])
    return index.postings().groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("tf"))


_LISTS = "la AS (SELECT c_nationkey AS query_id, c_custkey % 30 AS id, min(c_custkey) AS k FROM customer GROUP BY ALL), l1 AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY k) AS rank FROM la), l2 AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY -k) AS rank FROM la WHERE id % 2 = 0)"


@register(
    "j06_fused_sources",
    "SELECT query_id, id, source, place AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, seen) AS place FROM (SELECT query_id, id, sum(1.0 / (60 + rank)) AS score, arg_max(source, list) AS source, min((list, rank)) AS seen FROM (SELECT *, 0 AS list, 'words' AS source FROM l1 WHERE rank <= 20 UNION ALL SELECT *, 1, 'near' FROM l2 WHERE rank <= 20) GROUP BY query_id, id)) WHERE place <= 8",
    _LISTS,
)
def _(spark, d):
    c = S.read(spark, d, "customer").groupBy(F.col("c_nationkey").alias("query_id"), (F.col("c_custkey") % 30).alias("id")).agg(F.min("c_custkey").alias("k"))
    words = views.placed(c, "k", limit=20, by=("query_id",)).withColumnRenamed("place", "rank").withColumn("source", F.lit("words"))
    near = views.placed(c.where("id % 2 = 0"), F.desc("k"), limit=20, by=("query_id",)).withColumnRenamed("place", "rank").withColumn("source", F.lit("near"))
    columns = ["query_id", "id", "rank", "source"]
    return retrieval.fuse([words.select(*columns), near.select(*columns)], 8).select("query_id", "id", "source", *_long("rank"))


# --- evaluation

_JUDGED = "jd AS (SELECT doc_id AS id, CASE WHEN quality = 1 THEN 'good' WHEN toxic = 1 THEN 'bad' ELSE '?' END AS verdict, CASE WHEN doc_id % 6 = 0 THEN NULL ELSE doc_id % 5 + 1 END AS score FROM labels)"


@register("e20_judge_summary", "SELECT verdict, count(*) AS n, round(avg(score), 2) AS score FROM jd GROUP BY verdict", _JUDGED)
def _(spark, d):
    k = F.col("doc_id")
    verdict = F.when(F.col("quality") == 1, "good").when(F.col("toxic") == 1, "bad").otherwise("?")
    judged = S.read(spark, d, "labels").select(verdict.alias("verdict"), F.when(k % 6 == 0, "not a number").otherwise((k % 5 + 1).cast("string")).alias("score"))
    return evaluation.judge_summary(judged).select("verdict", "n", F.round("score", 2).alias("score"))


@register("e19_metric_means", "SELECT count(*) AS queries, round(avg(a), 3) AS recall_1, round(avg(b), 3) AS mrr FROM (SELECT (o_orderkey % 5) / 4 AS a, 1 / (o_custkey % 7 + 1) AS b FROM orders)")
def _(spark, d):
    rows = S.read(spark, d, "orders").select(F.col("o_orderkey").alias("query_id"), ((F.col("o_orderkey") % 5) / 4).alias("recall_1"), (1 / (F.col("o_custkey") % 7 + 1)).alias("mrr"))
    return evaluation.summarise(rows).select("queries", F.round("recall_1", 3).alias("recall_1"), F.round("mrr", 3).alias("mrr"))


@register("e19_metric_means_empty", "SELECT CAST(0 AS BIGINT) AS queries, 0.0::DOUBLE AS mrr")
def _(spark, d):
    rows = S.read(spark, d, "orders").where("false").select(F.col("o_orderkey").alias("query_id"), (F.col("o_custkey") / 2).alias("mrr"))
    return evaluation.summarise(rows)


# --- references of all kinds

_OWNER = "ow AS (SELECT id, kind, CASE WHEN kind = 'method' THEN regexp_replace(qualified_name, '\\.[^.]*$', '') END AS owner FROM symbols), mt AS (SELECT owner, s.name, min(s.id) AS id FROM symbols s JOIN ow USING (id) WHERE s.kind = 'method' GROUP BY ALL)"
_SELF = "sr AS (SELECT DISTINCT e.src, s.name FROM raw_edges e JOIN symbols s ON s.id = e.dst WHERE e.dst IS NOT NULL)"


@register(
    "i02_self_references",
    "SELECT src, dst, 'call' AS edge_type, 9 AS tenths FROM (SELECT sr.src, mt.id AS dst FROM sr JOIN ow ON ow.id = sr.src AND ow.owner IS NOT NULL JOIN mt ON mt.owner = ow.owner AND mt.name = sr.name) WHERE src <> dst",
    *GRAPH, _OWNER, _SELF,
)
def _(spark, d):
    refs, symbols = _self_references(spark, d)
    return graph.resolve_references(refs, symbols)[0].select("src", "dst", "edge_type", "tenths")


@register(
    "e18_self_counters",
    "SELECT CASE WHEN mt.id IS NULL THEN 'unresolved' ELSE 'receiver' END AS tier, count(*) AS references FROM sr JOIN ow ON ow.id = sr.src AND ow.owner IS NOT NULL LEFT JOIN mt ON mt.owner = ow.owner AND mt.name = sr.name GROUP BY 1",
    *GRAPH, _OWNER, _SELF,
)
def _(spark, d):
    refs, symbols = _self_references(spark, d)
    return graph.resolve_references(refs, symbols)[1].select("tier", "references")


def _self_references(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    symbols = S.symbols(spark, d)
    refs = _called(spark, d).join(symbols.select(F.col("id").alias("dst"), "name"), "dst")
    return refs.select(F.lit(1).alias("repo_id"), "src", F.lit("self").alias("kind"), F.lit(None).cast("string").alias("receiver"), "name").distinct(), symbols


def _called(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    in_order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    return S.read(spark, d, "lineitem").select(F.col("l_partkey").alias("src"), F.lead("l_partkey").over(in_order).alias("dst")).where("dst is not null")


@register(
    "i02_receiver_references",
    "SELECT src, dst, edge_type, max(tenths) AS tenths FROM (SELECT r.src, mt.id AS dst, 'call' AS edge_type, 9 AS tenths FROM rr r JOIN cl ON cl.name = r.receiver JOIN mt ON mt.owner = r.receiver AND mt.name = r.name UNION ALL SELECT r.src, s.id, 'call', 5 FROM rr r JOIN few USING (name) JOIN sy s ON s.name = r.name AND s.kind <> 'class' WHERE r.receiver NOT IN (SELECT name FROM cl)) WHERE src <> dst GROUP BY ALL",
    *GRAPH,
    "sy AS (SELECT id, file_path, CASE WHEN id % 9 = 0 THEN 'class' ELSE 'method' END AS kind, CASE WHEN id % 9 = 0 THEN 'C' || (id % 90) ELSE name || (id % 97) END AS name, CASE WHEN id % 9 = 0 THEN 'C' || (id % 90) ELSE 'C' || (id % 45 // 9 * 9) || '.' || name || (id % 97) END AS qualified_name FROM symbols)",
    "cl AS (SELECT DISTINCT name FROM sy WHERE kind = 'class'), mt AS (SELECT regexp_replace(qualified_name, '\\.[^.]*$', '') AS owner, name, min(id) AS id FROM sy WHERE kind = 'method' GROUP BY ALL)",
    "few AS (SELECT name FROM sy WHERE kind = 'method' GROUP BY name HAVING count(*) <= 8)",
    "rr AS (SELECT DISTINCT e.src, CASE WHEN e.src % 4 = 0 THEN 'x' ELSE 'C' || (e.src % 18) END AS receiver, t.name FROM raw_edges e JOIN sy s ON s.id = e.src JOIN sy t ON t.id = e.dst AND t.kind = 'method')",
)
def _(spark, d):
    k = F.col("id")
    unique = F.concat("name", (k % 97).cast("string"))
    klass = F.concat(F.lit("C"), (k % 90).cast("string"))
    symbols = S.symbols(spark, d).select("repo_id", "id", "file_path", F.when(k % 9 == 0, "class").otherwise("method").alias("kind"), F.when(k % 9 == 0, klass).otherwise(unique).alias("name"), F.when(k % 9 == 0, klass).otherwise(F.concat(F.lit("C"), (F.floor(k % 45 / 9) * 9).cast("string"), F.lit("."), unique)).alias("qualified_name"))
    named = symbols.where("kind = 'method'").select(F.col("id").alias("dst"), "name")
    receiver = F.when(F.col("src") % 4 == 0, "x").otherwise(F.concat(F.lit("C"), (F.col("src") % 18).cast("string")))
    refs = _called(spark, d).join(named, "dst").select(F.lit(1).alias("repo_id"), "src", F.lit("receiver").alias("kind"), receiver.alias("receiver"), "name").distinct()
    return graph.resolve_references(refs, symbols)[0].select("src", "dst", "edge_type", "tenths")


@register("e17_best_names", "SELECT src, dst, edge_type, max(t) AS tenths, min(nm) FILTER (WHERE t = mx) AS name FROM (SELECT src, dst, edge_type, t, 'n' || (CAST(q AS BIGINT) % 5) AS nm, max(t) OVER (PARTITION BY src, dst, edge_type) AS mx FROM raw_edges WHERE q >= 45 AND dst IS NOT NULL AND src <> dst) GROUP BY ALL", S.EDGES_SQL)
def _(spark, d):
    from pyspark.sql import Window

    in_order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    raw = S.read(spark, d, "lineitem").withColumn("dst", F.lead("l_partkey").over(in_order)).where("l_quantity >= 45 and dst is not null")
    tenths = F.when(F.col("l_quantity") >= 48, 10).when(F.col("l_quantity") >= 46, 9).otherwise(5)
    name = F.concat(F.lit("n"), (F.col("l_quantity").cast("long") % 5).cast("string"))
    found = raw.select(F.lit(1).alias("repo_id"), F.col("l_partkey").alias("src"), "dst", F.when(F.col("l_returnflag") == "R", "inherit").otherwise("call").alias("edge_type"), name.alias("name"), tenths.alias("tenths"))
    return graph.best_edges(found).select("src", "dst", "edge_type", "tenths", "name")


# --- pages

@register("k14c_page_order", "SELECT key, row_number() OVER (ORDER BY CASE key WHEN 'core' THEN 0 WHEN 'pipeline' THEN 1 ELSE 2 END, n) AS place FROM (VALUES ('architecture', 1), ('getting-started', 2), ('core', 3), ('pipeline', 4), ('cluster-1', 5)) AS t(key, n)")
def _(spark, d):
    keys = ["architecture", "getting-started", "core", "pipeline", "cluster-1"]
    rows = [(k, i) for i, k in enumerate(wiki.page_order(keys, ["core", "unknown", "pipeline", "core"]), 1)]
    return spark.createDataFrame(rows, "key string, place long")
