"""Queries over the driver's tables and the same in DuckDB's SQL: {name: (query, SQL or None)}."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomlog.functions import prompts, similarity, text
from loomlog.operators import clusters, match, merge, metrics, pool, stats
from loomlog.operators.tables import kept, ranked, shared_dir
from loomlog.plans.pipeline import Pipeline, cleaned
from loomlog.sources import files
from loomlog.sources.config import Config, Preprocessing
from loomlog.sources.store import open_store
from loomlog.streaming import stream

Query = Callable[[SparkSession, str], DataFrame]
_ALL: dict[str, tuple[Query, str | None]] = {}
_STRIPPED = Config(preprocessing=Preprocessing(remove_timestamps=True))


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def put(f: Query) -> Query:
        _ALL[f.__name__] = (f, sql)
        return f

    return put


def queries() -> dict[str, Query]:
    return {name: f for name, (f, _) in _ALL.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _ALL.items() if sql}


# ---------------------------------------------------------------- inputs


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """seq, content, truth, ts: log lines made from events."""
    return _read(spark, sf_dir, "events").selectExpr(
        "event_id as seq",
        """concat(date_format(ts, 'yyyy-MM-dd HH:mm:ss'), ' ', case event_type when 'error' then 'ERROR' when 'signup' then 'WARN' else 'INFO' end, ' ',
        case event_type
          when 'error' then concat('Failed to connect to 10.0.0.', get_json_object(props, '$.k'), ' on port ', cast(5000 + event_id % 7 as string), ' after ', cast(cast(value as decimal(18,2)) as string), ' ms')
          when 'click' then concat('User ', cast(user_id as string), ' clicked item ', get_json_object(props, '$.k'), ' at /var/app/page', get_json_object(props, '$.k'), '/view.html')
          when 'view' then concat('User ', cast(user_id as string), ' viewed page', get_json_object(props, '$.k'))
          when 'purchase' then concat('Order ', cast(event_id + 100000 as string), ' paid ', cast(cast(value as decimal(18,2)) as string), ' by user ', cast(user_id as string))
          else concat('Signup user', cast(user_id as string), '@example.com ok') end) as content""",
        "event_type as truth",
        "cast(ts as timestamp) as ts",
    )


_LOGS = """logs AS (SELECT event_id AS seq, strftime(ts, '%Y-%m-%d %H:%M:%S') || ' ' || CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'signup' THEN 'WARN' ELSE 'INFO' END || ' ' ||
  CASE event_type
    WHEN 'error' THEN 'Failed to connect to 10.0.0.' || json_extract_string(props, '$.k') || ' on port ' || (5000 + event_id % 7)::VARCHAR || ' after ' || value::DECIMAL(18,2)::VARCHAR || ' ms'
    WHEN 'click' THEN 'User ' || user_id::VARCHAR || ' clicked item ' || json_extract_string(props, '$.k') || ' at /var/app/page' || json_extract_string(props, '$.k') || '/view.html'
    WHEN 'view' THEN 'User ' || user_id::VARCHAR || ' viewed page' || json_extract_string(props, '$.k')
    WHEN 'purchase' THEN 'Order ' || (event_id + 100000)::VARCHAR || ' paid ' || value::DECIMAL(18,2)::VARCHAR || ' by user ' || user_id::VARCHAR
    ELSE 'Signup user' || user_id::VARCHAR || '@example.com ok' END AS content, event_type AS truth, ts FROM events)"""


def _lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _sub(sql: str, patterns, by: str) -> str:
    for p in patterns:
        sql = f"regexp_replace({sql}, {_lit(p)}, {_lit(by)}, 'g')"
    return sql


def _strip(c: str) -> str:
    return rf"regexp_replace({c}, '^\s+|\s+$', '', 'g')"


def _clean(c: str, ts: bool = False, ips: bool = False, lower: bool = False) -> str:
    out = _strip(f"coalesce({c}, '')")
    if ts:
        out = _sub(out, text.TIMESTAMPS, "")
    if ips:
        out = _sub(out, (text.CLASSES["ip"], text.CLASSES["ipv6"]), "")
    out = _sub(_sub(out, text.NUMBERS, text.NUMBER), text.PATHS, text.PATH)
    out = f"lower({out})" if lower else out
    return rf"trim(regexp_replace({out}, '\s+', ' ', 'g'))"


def _valid(c: str) -> str:
    return rf"(length({_strip(c)}) >= {text.SHORTEST} AND NOT regexp_matches({_strip(c)}, '^[\W_]+$'))"


def _heuristic(c: str) -> str:
    return _sub(c, text.LADDER.values(), text.WILDCARD)


_TS = "coalesce(" + ", ".join(f"nullif(regexp_extract(content, {_lit(p)}), '')" for p in text.TIMESTAMPS) + ")"
_LEVEL = rf"upper(nullif(regexp_extract(content, '(?i)\b({'|'.join(text.LEVELS)})\b', 1), ''))"
_CLEAN = f"{_LOGS}, c AS (SELECT seq, content, truth, ts, {_clean('content')} AS cleaned FROM logs), v AS (SELECT *, {_heuristic('cleaned')} AS template_pattern FROM c WHERE {_valid('cleaned')})"
_MINED = f"""{_CLEAN}, m AS (SELECT template_pattern, count(*)::BIGINT AS count, min(seq) AS first_seq FROM v GROUP BY 1),
  t AS (SELECT *, 'tmpl_' || lpad((row_number() OVER (ORDER BY first_seq) - 1)::VARCHAR, 4, '0') AS template_id FROM m)"""
_TOKENS = "list_filter(string_split(content, ' '), lambda x: x <> '')"


def _cleaned_logs(spark, sf_dir, config=None) -> DataFrame:
    return cleaned(logs(spark, sf_dir), config)


def _mined_rows(spark, sf_dir) -> DataFrame:
    """Lazy: for queries that read the rows once."""
    return _cleaned_logs(spark, sf_dir).where("valid").withColumn("template_pattern", text.heuristic_template(F.col("cleaned")))


def _mined_once(spark, sf_dir) -> DataFrame:
    """Kept: for queries that read the rows several times."""
    return kept(_mined_rows(spark, sf_dir))


# ---------------------------------------------------------------- scans, cleaning, validity

_LINES = rf"lines AS (SELECT doc_id, unnest(range(len(string_split(text, chr(10)))))::INTEGER AS pos, {_strip('unnest(string_split(text, chr(10)))')} AS content FROM documents)"


@query(f"WITH {_LINES} SELECT doc_id, pos, content FROM lines WHERE length(content) > 0")
def scan_lines(spark, sf_dir):
    return files.column_lines(_read(spark, sf_dir, "documents"), "doc_id", "text")


@query(f"WITH {_LINES} SELECT {_clean('content')} AS cleaned, min(doc_id * 1000000 + pos)::BIGINT AS first_seq FROM lines WHERE length(content) > 0 GROUP BY 1")
def dedup_lines(spark, sf_dir):
    rows = files.column_lines(_read(spark, sf_dir, "documents"), "doc_id", "text")
    return rows.groupBy(text.clean(F.col("content")).alias("cleaned")).agg(F.min(F.col("doc_id") * 1000000 + F.col("pos")).alias("first_seq"))


@query(f"WITH {_LINES} SELECT doc_id, pos FROM lines WHERE length(content) > 0 AND {_valid(_clean('content'))}")
def valid_lines(spark, sf_dir):
    rows = files.column_lines(_read(spark, sf_dir, "documents"), "doc_id", "text")
    return rows.where(text.is_valid(text.clean(F.col("content")))).select("doc_id", "pos")


@query(f"WITH {_LOGS} SELECT seq, {_clean('content')} AS cleaned FROM logs")
def clean_default(spark, sf_dir):
    return logs(spark, sf_dir).select("seq", text.clean(F.col("content")).alias("cleaned"))


@query(f"WITH {_LOGS} SELECT seq, {_clean('content', ts=True)} AS cleaned FROM logs")
def clean_strip_ts(spark, sf_dir):
    return logs(spark, sf_dir).select("seq", text.clean(F.col("content"), remove_timestamps=True).alias("cleaned"))


@query(f"WITH {_LOGS} SELECT seq, {_clean('content', ips=True)} AS cleaned FROM logs")
def clean_strip_ip(spark, sf_dir):
    return logs(spark, sf_dir).select("seq", text.clean(F.col("content"), remove_ips=True).alias("cleaned"))


@query(f"WITH {_LOGS} SELECT seq, {_clean('content', lower=True)} AS cleaned FROM logs")
def clean_lower(spark, sf_dir):
    return logs(spark, sf_dir).select("seq", text.clean(F.col("content"), lowercase=True).alias("cleaned"))


@query("SELECT page_id, " + ", ".join(f"{_sub('url', (p,), f'<{n.upper()}>')} AS {n}, len(regexp_extract_all(url, {_lit(p)}))::INTEGER AS n_{n}" for n, p in text.CLASSES.items()) + " FROM pages")
def mask_by_class(spark, sf_dir):
    url = F.col("url")
    return _read(spark, sf_dir, "pages").select("page_id", *(c for n in text.CLASSES for c in (text.mask_class(url, n).alias(n), text.count_class(url, n).alias(f"n_{n}"))))


@query(rf"SELECT conv_id, turn, trim(regexp_replace(text, '\s+', ' ', 'g')) AS text FROM conversations")
def collapse_whitespace(spark, sf_dir):
    return _read(spark, sf_dir, "conversations").select("conv_id", "turn", text.one_spaced(F.col("text")).alias("text"))


@query(f"WITH {_LOGS} SELECT seq, {_LEVEL} AS level FROM logs")
def extract_level(spark, sf_dir):
    return logs(spark, sf_dir).select("seq", text.level_of(F.col("content")).alias("level"))


@query(f"WITH {_LOGS} SELECT seq, {_TS} AS timestamp FROM logs")
def extract_timestamp(spark, sf_dir):
    return logs(spark, sf_dir).select("seq", text.timestamp_of(F.col("content")).alias("timestamp"))


@query(rf"WITH {_LOGS}, p AS (SELECT seq, content, {_TS} AS timestamp, {_LEVEL} AS level FROM logs), r AS (SELECT *, {_strip("replace(content, timestamp, '')")} AS rest FROM p) SELECT seq, timestamp, level, {_strip(r"regexp_replace(rest, '(?i)\b' || level || '\b', '', 'g')")} AS message FROM r")
def split_components(spark, sf_dir):
    return logs(spark, sf_dir).select("seq", text.components_of(F.col("content")).alias("c")).select("seq", "c.*")


# ---------------------------------------------------------------- tokens, keys, templates


@query(f"WITH {_LOGS} SELECT seq, len({_TOKENS})::INTEGER AS n_tokens FROM logs")
def token_count(spark, sf_dir):
    return logs(spark, sf_dir).select("seq", F.size(text.tokens(F.col("content"))).alias("n_tokens"))


@query(f"WITH {_LOGS} SELECT seq, array_to_string(list_slice({_TOKENS}, 1, 5), '|') AS prefix FROM logs")
def token_prefix(spark, sf_dir):
    return logs(spark, sf_dir).select("seq", F.array_join(clusters.path(F.col("content")), "|").alias("prefix"))


@query(f"WITH {_LOGS} SELECT seq, md5(content) AS log_md5, 'log:' || md5(content) AS cache_key FROM logs")
def log_md5(spark, sf_dir):
    return logs(spark, sf_dir).select("seq", F.md5(F.col("content").cast("binary")).alias("log_md5"), text.log_key(F.col("content")).alias("cache_key"))


@query(f"WITH {_LOGS} SELECT seq, substr(md5(array_to_string(list_slice({_TOKENS}, 1, 3), '_')), 1, 8) AS pattern_hash FROM logs")
def pattern_hash(spark, sf_dir):
    return logs(spark, sf_dir).select("seq", text.pattern_hash(F.col("content")).alias("pattern_hash"))


@query(f"WITH {_CLEAN} SELECT seq, template_pattern FROM v")
def heuristic_template(spark, sf_dir):
    return _mined_rows(spark, sf_dir).select("seq", "template_pattern")


@query(f"WITH {_MINED} SELECT template_id, template_pattern, count, first_seq, 0.9::DOUBLE AS confidence FROM t")
def template_counts(spark, sf_dir):
    return pool.mined(_mined_rows(spark, sf_dir)).select("template_id", "template_pattern", "count", "first_seq", "confidence")


@query(f"WITH {_MINED} SELECT template_id, template_pattern, count FROM t ORDER BY count DESC, first_seq LIMIT 3")
def top_templates(spark, sf_dir):
    return pool.top(pool.mined(_mined_rows(spark, sf_dir)), 3).select("template_id", "template_pattern", "count")


@query(f"WITH {_CLEAN}, f AS (SELECT template_pattern, cleaned AS example, min(seq) AS seq FROM v GROUP BY 1, 2) SELECT template_pattern, example, seq FROM f QUALIFY row_number() OVER (PARTITION BY template_pattern ORDER BY seq DESC) <= 10")
def template_examples_last10(spark, sf_dir):
    return pool.last_examples(_mined_rows(spark, sf_dir)).select("template_pattern", "example", "seq")


@query(f"WITH {_CLEAN} SELECT template_pattern, count(*)::BIGINT AS n, arg_min(cleaned, seq) AS first_sample FROM v GROUP BY 1")
def grouped_results(spark, sf_dir):
    return _mined_rows(spark, sf_dir).groupBy("template_pattern").agg(F.count(F.lit(1)).alias("n"), F.min_by("cleaned", "seq").alias("first_sample"))


@query(f"WITH {_LOGS}, r AS (SELECT seq, row_number() OVER (ORDER BY seq) AS i FROM logs) SELECT ((i - 1) // 1000 + 1)::BIGINT AS chunk, count(*)::BIGINT AS n FROM r GROUP BY 1")
def chunk_numbers(spark, sf_dir):
    rows = ranked(logs(spark, sf_dir).select("seq"), [F.col("seq").asc_nulls_last()])
    return rows.groupBy(files.chunk_number(F.col("rank") + 1).cast("long").alias("chunk")).agg(F.count(F.lit(1)).alias("n"))


# ---------------------------------------------------------------- clusters

_PATHS = f"""{_LOGS}, c AS (SELECT seq, {_clean('content', ts=True)} AS content FROM logs), p AS (SELECT seq, list_slice({_TOKENS}, 1, 5) AS path FROM c WHERE {_valid('content')})"""
_CLUSTERS = f"""{_PATHS}, o AS (SELECT path, seq, row_number() OVER (PARTITION BY path ORDER BY seq) AS k, count(*) OVER (PARTITION BY path) AS size FROM p),
  k AS (SELECT path, size::BIGINT AS size, seq AS reached, 'clus_' || lpad((row_number() OVER (ORDER BY seq) - 1)::VARCHAR, 4, '0') AS cluster_id FROM o WHERE k = 3)"""
_NODES = "n AS (SELECT list_slice(path, 1, d) AS node, count(*) AS lines FROM p, range(1, 6) AS r(d) WHERE d <= len(path) GROUP BY 1)"


def _exact(spark, sf_dir) -> DataFrame:
    rows = _cleaned_logs(spark, sf_dir, _STRIPPED).where("valid").withColumn("log_id", F.col("seq").cast("string"))
    return kept(clusters.with_exact_paths(rows).select("seq", "log_id", "path"))


@query(f"WITH {_CLUSTERS} SELECT array_to_string(path, '|') AS path, size FROM k")
def cluster_exact(spark, sf_dir):
    return clusters.clusters(_exact(spark, sf_dir)).select(F.array_join("path", "|").alias("path"), "size")


@query(f"WITH {_CLUSTERS} SELECT cluster_id, reached, array_to_string(path, '|') AS path FROM k")
def cluster_ids(spark, sf_dir):
    return clusters.clusters(_exact(spark, sf_dir)).select("cluster_id", "reached", F.array_join("path", "|").alias("path"))


@query(f"WITH {_CLUSTERS} SELECT cluster_id, seq::VARCHAR AS log_id FROM p JOIN k USING (path)")
def cluster_members(spark, sf_dir):
    paths = _exact(spark, sf_dir)
    return clusters.members(paths, clusters.clusters(paths))


@query(f"WITH {_CLUSTERS}, {_NODES} SELECT (SELECT count(*) FROM p)::BIGINT AS total_logs, (SELECT count(*) FROM k)::BIGINT AS num_clusters, (SELECT count(*) FROM p)::DOUBLE / (SELECT count(*) FROM k) AS avg_cluster_size, 5 AS max_depth, (SELECT count(*) + 1 FROM n)::BIGINT AS total_nodes")
def tree_stats(spark, sf_dir):
    paths = _exact(spark, sf_dir)
    return clusters.tree_stats(paths, clusters.clusters(paths))


@query(f"WITH {_PATHS}, {_NODES} SELECT array_to_string(node, '|') AS node, len(node)::INTEGER AS depth, lines::BIGINT AS lines FROM n")
def tree_nodes(spark, sf_dir):
    return clusters.nodes(_exact(spark, sf_dir)).select(F.array_join("path", "|").alias("node"), "depth", "lines")


@query(f"WITH {_CLUSTERS} SELECT seq, (SELECT arg_min(cluster_id, len(k.path)) FROM k WHERE len(k.path) <= len(p.path) AND list_slice(p.path, 1, len(k.path)) = k.path) AS cluster_id FROM p")
def prefix_lookup(spark, sf_dir):
    paths = _exact(spark, sf_dir)
    return clusters.lookup(paths, clusters.clusters(paths)).select("seq", "cluster_id")


@query()
def cluster_fuzzy(spark, sf_dir):
    rows = _cleaned_logs(spark, sf_dir, _STRIPPED).where("valid").withColumn("log_id", F.col("seq").cast("string"))
    return clusters.clusters(clusters.with_fuzzy_paths(rows)).select("cluster_id", F.array_join("path", "|").alias("path"), "size", "reached")


@query()
def tree_visualise(spark, sf_dir):
    rows = _cleaned_logs(spark, sf_dir, _STRIPPED).where("valid").withColumn("log_id", F.col("seq").cast("string"))
    paths = clusters.with_fuzzy_paths(rows)
    return clusters.drawn(paths, clusters.clusters(paths))


# ---------------------------------------------------------------- similarity, merging

_NUMERIC = lambda c: f"regexp_matches(replace(replace({c}, '.', ''), '-', ''), '^[0-9]+$')"
_KIND = " OR ".join(f"(regexp_matches(a, {_lit(k)}) AND regexp_matches(b, {_lit(k)}))" for k in similarity.KINDS)
_TOKEN_SIM = f"CASE WHEN a = b THEN 1.0 WHEN {_NUMERIC('a')} AND {_NUMERIC('b')} THEN 0.9 WHEN {_KIND} THEN 0.85 ELSE 1.0 - levenshtein(a, b)::DOUBLE / greatest(length(a), length(b)) END::DOUBLE"
_TOKEN_PAIRS = f"{_LOGS}, w AS (SELECT {_TOKENS} AS ts FROM logs), x AS (SELECT DISTINCT unnest(list_slice(ts, 1, len(ts) - 1)) AS a, unnest(list_slice(ts, 2, len(ts))) AS b FROM w)"


def _token_pairs(spark, sf_dir) -> DataFrame:
    """Distinct pairs of neighbouring tokens."""
    ts = logs(spark, sf_dir).select(text.tokens(F.col("content")).alias("ts"))
    pairs = F.arrays_zip(F.slice("ts", F.lit(1), F.size("ts") - 1).alias("a"), F.slice("ts", F.lit(2), F.size("ts")).alias("b"))
    return ts.select(F.inline(pairs).alias("a", "b")).distinct()


@query(f"WITH {_TOKEN_PAIRS} SELECT a, b, round({_TOKEN_SIM}, 9) AS similarity FROM x")
def token_similarity(spark, sf_dir):
    return _token_pairs(spark, sf_dir).select("a", "b", F.round(similarity.token_similarity(F.col("a"), F.col("b")), 9).alias("similarity"))


@query(f"WITH {_TOKEN_PAIRS} SELECT a, b, levenshtein(a, b)::INTEGER AS distance FROM x")
def levenshtein_pairs(spark, sf_dir):
    return _token_pairs(spark, sf_dir).select("a", "b", F.levenshtein("a", "b").alias("distance"))


#: Templates to compare: the words of each benchmark item and of the next.
_TEMPLATES = rf"t AS (SELECT item_id AS i, array_to_string(list_filter(string_split_regex(text, '\s+'), lambda x: x <> ''), ' ') AS p FROM benchmark), x AS (SELECT a.i AS i, b.i AS j, a.p AS p, b.p AS q FROM t a JOIN t b ON a.i + 1 = b.i)"
_W = lambda c: f"list_filter(string_split({c}, ' '), lambda x: x <> '')"
_SAME = f"len(list_filter(range(1, least(len({_W('p')}), len({_W('q')})) + 1), lambda i: {_W('p')}[i] = {_W('q')}[i]))"
_UNION = f"len(list_distinct(list_concat({_W('p')}, {_W('q')})))"
_JACCARD = f"len(list_distinct(list_intersect({_W('p')}, {_W('q')})))::DOUBLE / {_UNION}"
_PATTERN_SIM = f"CASE WHEN p = q THEN 1.0::DOUBLE ELSE 0.7::DOUBLE * ({_SAME}::DOUBLE / greatest(len({_W('p')}), len({_W('q')}))) + 0.3::DOUBLE * ({_JACCARD}) END"


def _benchmark_pairs(spark, sf_dir) -> DataFrame:
    """Each item's words beside the next item's."""
    t = _read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("i"), F.array_join(text.words(F.col("text")), " ").alias("p"))
    return t.join(t.select((F.col("i") - 1).alias("i"), F.col("i").alias("j"), F.col("p").alias("q")), "i")


@query(f"WITH {_TEMPLATES} SELECT i, j, round({_PATTERN_SIM}, 9) AS similarity FROM x")
def pattern_similarity(spark, sf_dir):
    return _benchmark_pairs(spark, sf_dir).select("i", "j", F.round(similarity.pattern_similarity(F.col("p"), F.col("q")), 9).alias("similarity"))


@query(f"WITH {_TEMPLATES} SELECT i, j, round({_JACCARD}, 9) AS jaccard FROM x")
def token_jaccard(spark, sf_dir):
    return _benchmark_pairs(spark, sf_dir).select("i", "j", F.round(similarity.jaccard(text.words(F.col("p")), text.words(F.col("q"))), 9).alias("jaccard"))


_MERGED = lambda n: f"array_to_string(list_transform(range(1, {n}(len({_W('p')}), len({_W('q')})) + 1), lambda i: CASE WHEN {_W('p')}[i] = {_W('q')}[i] THEN {_W('p')}[i] ELSE '<*>' END), ' ')"


@query(f"WITH {_TEMPLATES} SELECT i, j, {_MERGED('greatest')} AS merged FROM x")
def merge_pad(spark, sf_dir):
    return _benchmark_pairs(spark, sf_dir).select("i", "j", similarity.merge_pad(F.col("p"), F.col("q")).alias("merged"))


@query(f"WITH {_TEMPLATES} SELECT i, j, {_MERGED('least')} AS merged FROM x")
def merge_truncate(spark, sf_dir):
    return _benchmark_pairs(spark, sf_dir).select("i", "j", similarity.merge_truncate(F.col("p"), F.col("q")).alias("merged"))


@query(f"WITH {_TEMPLATES} SELECT i, j, array_to_string(list_sort(list_distinct(list_intersect({_W('p')}, {_W('q')}))), ' ') AS common FROM x")
def static_token_intersection(spark, sf_dir):
    return _benchmark_pairs(spark, sf_dir).select("i", "j", F.array_join(similarity.common_tokens(F.col("p"), F.col("q")), " ").alias("common"))


#: Paths of the exact tree, as templates; at a lower threshold some of them merge.
_PATTERNS = f"{_CLUSTERS}, t AS (SELECT substr(cluster_id, 6)::BIGINT AS i, array_to_string(path, ' ') AS p, size FROM k), x AS (SELECT a.i AS i, b.i AS j, a.p AS p, b.p AS q FROM t a JOIN t b ON a.i < b.i AND abs(length(a.p) - length(b.p)) <= 3)"


def _patterns(spark, sf_dir) -> DataFrame:
    found = clusters.clusters(_exact(spark, sf_dir))
    return found.select(F.substring("cluster_id", 6, 20).cast("long").alias("i"), F.array_join("path", " ").alias("p"), F.col("size").alias("count"), F.lit(0.9).alias("confidence"))


@query(f"WITH {_PATTERNS} SELECT i, j, round({_PATTERN_SIM}, 9) AS similarity FROM x WHERE {_PATTERN_SIM} >= 0.6 AND levenshtein(p, q) <= 3")
def mergeable_pairs(spark, sf_dir):
    return merge.mergeable_pairs(_patterns(spark, sf_dir), 0.6).select("i", "j", F.round("similarity", 9).alias("similarity"))


@query(f"WITH {_PATTERNS}, e AS (SELECT i, j, {_PATTERN_SIM} AS s FROM x WHERE {_PATTERN_SIM} >= 0.6 AND levenshtein(p, q) <= 3) SELECT row_number() OVER (ORDER BY s DESC, i, j) - 1 AS place, i, j FROM e")
def mergeable_pairs_ordered(spark, sf_dir):
    return merge.ordered(merge.mergeable_pairs(_patterns(spark, sf_dir), 0.6)).select("place", "i", "j")


_FOLDED = _MERGED("greatest").replace("lambda i:", "lambda ix:").replace("[i]", "[ix]")
for _old, _new in (("(p, ", "(acc, "), ("(q, ", "(nxt, ")):
    _FOLDED = _FOLDED.replace(_old, _new)


@query(f"""WITH RECURSIVE {_PATTERNS}, e AS (SELECT i, j FROM x WHERE {_PATTERN_SIM} >= 0.6 AND levenshtein(p, q) <= 3),
  g AS MATERIALIZED (SELECT i, list(j ORDER BY j) AS js, row_number() OVER (ORDER BY i) AS k FROM e GROUP BY i),
  w AS (SELECT 0::BIGINT AS k, []::BIGINT[] AS used, NULL::BIGINT AS leader, []::BIGINT[] AS taken
    UNION ALL SELECT g.k, CASE WHEN list_contains(w.used, g.i) THEN w.used ELSE list_concat(w.used, g.js) END, g.i,
      CASE WHEN list_contains(w.used, g.i) THEN [] ELSE list_filter(g.js, lambda y: NOT list_contains(w.used, y)) END FROM w JOIN g ON g.k = w.k + 1),
  a AS (SELECT leader, unnest(taken) AS member FROM w),
  r AS (SELECT coalesce(a.leader, t.i) AS i, t.i AS own, t.p, t.size FROM t LEFT JOIN a ON a.member = t.i),
  f AS (SELECT i, list(p ORDER BY own) AS ps, sum(size)::BIGINT AS count, count(*) - 1 AS n FROM r GROUP BY i)
  SELECT i, CASE WHEN n = 0 THEN ps[1] ELSE list_reduce(ps, lambda acc, nxt: {_FOLDED}) END AS p, count, round(0.9::DOUBLE * pow(0.95::DOUBLE, n), 9) AS confidence, n::INTEGER AS merges FROM f""")
def merge_batch(spark, sf_dir):
    t = kept(_patterns(spark, sf_dir))
    return merge.merged(t, merge.mergeable_pairs(t, 0.6)).select("i", "p", "count", F.round("confidence", 9).alias("confidence"), "merges")


@query(f"WITH {_MINED}, a AS (SELECT * FROM t WHERE template_id = 'tmpl_0000'), b AS (SELECT * FROM t WHERE template_id = 'tmpl_0001'), x AS (SELECT a.template_id, a.template_pattern AS p, b.template_pattern AS q, a.count + b.count AS count FROM a, b) SELECT template_id, {_MERGED('least')} AS template_pattern, count, 0.9::DOUBLE AS confidence FROM x")
def pool_merge(spark, sf_dir):
    t = pool.mined(_mined_once(spark, sf_dir))
    return merge.pool_merge(t.where("template_id = 'tmpl_0000'"), t.where("template_id = 'tmpl_0001'"))


# ---------------------------------------------------------------- assignment, pool

_KNOWN = "SELECT md5(content) AS log_md5, min(template_id) AS template_id FROM v JOIN t USING (template_pattern) WHERE truth IN ('click', 'error') GROUP BY 1"


def _known_kinds(spark, sf_dir) -> DataFrame:
    rows = _mined_once(spark, sf_dir)
    t = pool.mined(rows).select("template_id", "template_pattern")
    return rows.where("truth in ('click', 'error')").join(t, "template_pattern").groupBy(F.md5(F.col("content").cast("binary")).alias("log_md5")).agg(F.min("template_id").alias("template_id"))


@query(f"WITH {_MINED} SELECT seq, template_id FROM v JOIN t USING (template_pattern)")
def assign_templates(spark, sf_dir):
    rows = _mined_once(spark, sf_dir)
    return rows.join(pool.mined(rows).select("template_pattern", "template_id"), "template_pattern").select("seq", "template_id")


@query(f"WITH {_MINED}, h AS ({_KNOWN}) SELECT cache_hit, count(*)::BIGINT AS n FROM (SELECT h.template_id IS NOT NULL AS cache_hit FROM logs LEFT JOIN h ON md5(content) = log_md5) GROUP BY 1")
def cached_vs_uncached(spark, sf_dir):
    return match.by_known_line(logs(spark, sf_dir), _known_kinds(spark, sf_dir)).groupBy("cache_hit").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {_MINED}, h AS ({_KNOWN}) SELECT seq FROM logs WHERE md5(content) NOT IN (SELECT log_md5 FROM h)")
def uncached_lines(spark, sf_dir):
    return match.unknown_lines(logs(spark, sf_dir), _known_kinds(spark, sf_dir)).select("seq")


@query(f"WITH {_LINES}, l AS (SELECT doc_id * 1000000 + pos AS seq, content, {_clean('content')} AS cleaned FROM lines WHERE length(content) > 0) SELECT seq::BIGINT AS seq, 'unknown' AS template_id, content AS template_pattern, 0.0::DOUBLE AS confidence FROM l WHERE NOT {_valid('cleaned')}")
def fallback_rows(spark, sf_dir):
    rows = files.column_lines(_read(spark, sf_dir, "documents"), "doc_id", "text").select((F.col("doc_id") * 1000000 + F.col("pos")).alias("seq"), "content")
    parsed = Pipeline(spark).parse_batch(rows).rows
    return parsed.where("template_id = 'unknown'").select("seq", "template_id", "template_pattern", "confidence")


@query(f"WITH {_CLEAN}, a AS (SELECT template_pattern, count(*) AS count, min(seq) AS first_seq FROM v WHERE truth IN ('click', 'view') GROUP BY 1), b AS (SELECT template_pattern, count(*) AS count, min(seq) AS first_seq FROM v WHERE truth <> 'click' GROUP BY 1), "
       "old AS (SELECT a.template_pattern, a.count + coalesce(b.count, 0) AS count, row_number() OVER (ORDER BY a.first_seq) - 1 AS k FROM a LEFT JOIN b USING (template_pattern)), "
       "new AS (SELECT template_pattern, count, (SELECT max(k) FROM old) + row_number() OVER (ORDER BY first_seq) AS k FROM b WHERE template_pattern NOT IN (SELECT template_pattern FROM a)) "
       "SELECT 'tmpl_' || lpad(k::VARCHAR, 4, '0') AS template_id, template_pattern, count::BIGINT AS count FROM (FROM old UNION ALL SELECT template_pattern, count, k FROM new)")  # fmt: skip
def upsert_templates(spark, sf_dir):
    rows = _mined_once(spark, sf_dir)
    return pool.upsert(pool.mined(rows.where("truth in ('click', 'view')")), pool.mined(rows.where("truth <> 'click'"))).select("template_id", "template_pattern", "count")


@query(f"WITH {_MINED} SELECT seq, template_id FROM v JOIN t USING (template_pattern) WHERE template_id <> 'tmpl_0000'")
def remove_template(spark, sf_dir):
    assigned = assign_templates(spark, sf_dir)
    return pool.removed(assigned, spark.createDataFrame([("tmpl_0000",)], "template_id string")).select("seq", "template_id")


@query(f"WITH {_MINED} SELECT seq, CASE template_id WHEN 'tmpl_0001' THEN 'tmpl_0000' ELSE template_id END AS template_id FROM v JOIN t USING (template_pattern)")
def remap_templates(spark, sf_dir):
    return pool.remapped(assign_templates(spark, sf_dir), spark.createDataFrame([("tmpl_0001", "tmpl_0000")], "template_id string, leader_id string")).select("seq", "template_id")


@query(f"WITH {_LOGS} SELECT seq, CASE truth WHEN 'click' THEN 'click' WHEN 'view' THEN 'view' WHEN 'signup' THEN 'signup' END AS template_id FROM logs")
def match_by_pattern(spark, sf_dir):
    known = [("click", "<*> INFO User <*> clicked item <*> at <*>"), ("view", "<*> INFO User <*> viewed page<*>"), ("signup", "<*> WARN Signup <*> ok")]
    rows = logs(spark, sf_dir).withColumn("cleaned", F.col("content"))
    return match.by_pattern(rows, spark.createDataFrame(known, "template_id string, template_pattern string")).select("seq", "template_id")


#: A template for each type of event.
_OF_TYPE = {
    "error": "<*> ERROR Failed to connect to <*> on port <*> after <*> ms",
    "click": "<*> INFO User <*> clicked item <*> at <*>",
    "view": "<*> INFO User <*> viewed page<*>",
    "purchase": "<*> INFO Order <*> paid <*> by user <*>",
    "signup": "<*> WARN Signup <*> ok",
}


def _variable(n: int) -> str:
    return "CASE truth " + " ".join(f"WHEN '{t}' THEN regexp_extract(content, '^{p.replace('<*>', '(.+?)')}$', {n})" for t, p in _OF_TYPE.items() if p.count("<*>") >= n) + f" END AS var_{n}"


@query(f"WITH {_LOGS} SELECT seq, {', '.join(map(_variable, (1, 2, 3, 4)))} FROM logs")
def extract_variables(spark, sf_dir):
    template = F.element_at(F.create_map(*(F.lit(x) for pair in _OF_TYPE.items() for x in pair)), F.col("truth"))
    rows = logs(spark, sf_dir).select("seq", similarity.variables(F.col("content"), template).alias("v"))
    return rows.select("seq", *(F.try_element_at("v", F.lit(f"var_{i}")).alias(f"var_{i}") for i in (1, 2, 3, 4)))


# ---------------------------------------------------------------- metrics

_LABELS = f"{_MINED}, l AS (SELECT seq, template_pattern AS pred, truth FROM v), g AS (SELECT pred, truth, count(*) AS n FROM l GROUP BY 1, 2)"
_F1 = """r AS (SELECT sum(m) AS tp, sum(s - m) AS fp FROM (SELECT max(n) AS m, sum(n) AS s FROM g GROUP BY pred)), q AS (SELECT sum(s - m) AS fn FROM (SELECT max(n) AS m, sum(n) AS s FROM g GROUP BY truth)),
  f AS (SELECT tp::DOUBLE / (tp + fp) AS precision, tp::DOUBLE / (tp + fn) AS recall FROM r, q)"""
_ARI = """s AS (SELECT (SELECT sum(n * (n - 1) / 2) FROM g)::DOUBLE AS i, (SELECT sum(n * (n - 1) / 2) FROM (SELECT sum(n) AS n FROM g GROUP BY pred))::DOUBLE AS a, (SELECT sum(n * (n - 1) / 2) FROM (SELECT sum(n) AS n FROM g GROUP BY truth))::DOUBLE AS b, (SELECT sum(n) FROM g)::DOUBLE AS n),
  h AS (SELECT (i - a * b / (n * (n - 1) / 2)) / ((a + b) / 2 - a * b / (n * (n - 1) / 2)) AS ari FROM s)"""


def _labels(spark, sf_dir) -> DataFrame:
    return kept(_mined_rows(spark, sf_dir).select("seq", F.col("template_pattern").alias("pred"), "truth"))


def _coarse(df: DataFrame) -> DataFrame:
    """Labels by level, so that predicted and true clusters differ."""
    return df.withColumn("pred", F.regexp_extract("pred", r" (ERROR|WARN|INFO) ", 1))


_COARSE = _LABELS.replace("template_pattern AS pred", "regexp_extract(template_pattern, ' (ERROR|WARN|INFO) ', 1) AS pred")


@query(f"WITH {_LABELS} SELECT avg((CASE WHEN pred LIKE '%' || truth || '%' THEN truth ELSE pred END = truth)::INT)::DOUBLE AS label_accuracy FROM l")
def label_accuracy(spark, sf_dir):
    named = _labels(spark, sf_dir).withColumn("pred", F.when(F.col("pred").contains(F.col("truth")), F.col("truth")).otherwise(F.col("pred")))
    return metrics.label_accuracy(named)


@query(rf"WITH {_CLEAN} SELECT avg((trim(regexp_replace(template_pattern || '  ', '\s+', ' ', 'g')) = trim(regexp_replace({_heuristic('content')}, '\s+', ' ', 'g')))::INT)::DOUBLE AS parsing_accuracy FROM v")
def parsing_accuracy(spark, sf_dir):
    rows = _mined_rows(spark, sf_dir)
    return metrics.parsing_accuracy(rows.select("seq", F.concat("template_pattern", F.lit("  ")).alias("pred"), text.heuristic_template(F.col("content")).alias("truth")))


@query(f"WITH {_COARSE}, {_F1} SELECT 2 * precision * recall / (precision + recall) AS f1, precision, recall FROM f")
def f1_precision_recall(spark, sf_dir):
    return metrics.f1(_coarse(_labels(spark, sf_dir)))


@query(f"WITH {_COARSE}, {_ARI} SELECT ari FROM h")
def ari(spark, sf_dir):
    return metrics.adjusted_rand(_coarse(_labels(spark, sf_dir)))


@query(f"WITH {_COARSE}, p AS (SELECT pred, sum(n) AS np FROM g GROUP BY 1), t2 AS (SELECT truth, sum(n) AS nt FROM g GROUP BY 1) SELECT sum(CASE WHEN n = np AND n = nt THEN n ELSE 0 END)::DOUBLE / sum(n) AS set_accuracy FROM g JOIN p USING (pred) JOIN t2 USING (truth)")
def set_accuracy(spark, sf_dir):
    return metrics.set_accuracy(_coarse(_labels(spark, sf_dir)))


#: True templates are those of all lines, predicted ones those of the lines after the first three, which come in another order.
_TWO_POOLS = "m2 AS (SELECT template_pattern, min(seq) AS first_seq FROM v WHERE seq >= (SELECT min(seq) + 3 FROM v) GROUP BY 1), t2 AS (SELECT template_pattern, 'tmpl_' || lpad((row_number() OVER (ORDER BY first_seq) - 1)::VARCHAR, 4, '0') AS template_id FROM m2), u AS (SELECT avg(coalesce(t2.template_pattern = t.template_pattern, false)::INT)::DOUBLE AS template_accuracy FROM t LEFT JOIN t2 USING (template_id))"


def _two_pools(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    rows = _mined_once(spark, sf_dir)
    first = rows.agg(F.min("seq").alias("first"))
    later = rows.join(first, F.col("seq") >= F.col("first") + 3).drop("first")
    return tuple(pool.mined(r).select("template_id", F.col("template_pattern").alias("pattern")) for r in (later, rows))


@query(f"WITH {_MINED}, {_TWO_POOLS} SELECT template_accuracy FROM u")
def template_accuracy(spark, sf_dir):
    return metrics.template_accuracy(*_two_pools(spark, sf_dir))


@query(f"WITH {_COARSE}, {_F1}, {_ARI}, {_TWO_POOLS} SELECT (SELECT avg((pred = truth)::INT)::DOUBLE FROM l) AS label_accuracy, 2 * precision * recall / (precision + recall) AS f1, precision, recall, ari, template_accuracy FROM f, h, u")
def all_metrics(spark, sf_dir):
    return metrics.all_metrics(_coarse(_labels(spark, sf_dir)), *_two_pools(spark, sf_dir))


# ---------------------------------------------------------------- statistics, prompts

#: Every tenth line is cut to eight characters, which are no valid line; clicks and errors are known.
_MIXED = f"{_MINED}, h AS ({_KNOWN}), d AS (SELECT seq % 10 <> 0 AS ok, h.log_md5 IS NOT NULL AND seq % 10 <> 0 AS hit, template_pattern, content, t.template_id FROM v JOIN t USING (template_pattern) LEFT JOIN h ON md5(content) = h.log_md5)"


def _mixed(spark, sf_dir):
    engine, lines = Pipeline(spark), logs(spark, sf_dir)
    known = engine.parse_batch(lines)
    known.assignments = _known_kinds(spark, sf_dir)
    cut = F.when(F.col("seq") % 10 == 0, F.substring("content", 1, 8)).otherwise(F.col("content"))
    return engine.parse_batch(lines.withColumn("content", cut), known)


@query(f"WITH {_MIXED}, n AS (SELECT count(*) AS n, count(*) FILTER (NOT ok) AS bad, count(*) FILTER (hit) AS hits, count(*) FILTER (ok AND NOT hit) AS used, count(DISTINCT template_id) FILTER (ok) AS ids FROM d) SELECT n::BIGINT AS total_logs, bad::BIGINT AS failed, hits::BIGINT AS cache_hits, used::BIGINT AS llm_calls, ids::BIGINT AS unique_templates, round(0.85::DOUBLE * (n - bad) / n, 9) AS average_confidence, 0.0::DOUBLE AS total_processing_time_ms, hits::DOUBLE / n AS cache_hit_rate, (n - bad)::DOUBLE / n AS success_rate, n::DOUBLE / used AS llm_efficiency, 0.0::DOUBLE AS avg_time_per_log_ms FROM n")
def parse_stats(spark, sf_dir):
    out = stats.parse_stats(_mixed(spark, sf_dir).rows)
    return out.withColumn("average_confidence", F.round("average_confidence", 9))


@query(f"WITH {_MIXED}, y AS (SELECT (SELECT sum(count) FROM t) + (SELECT count(*) FILTER (ok) FROM d) AS n, (SELECT count(*) FROM t) AS k) SELECT k::BIGINT AS total_templates, n::BIGINT AS total_logs, 0.85::DOUBLE AS avg_confidence, (SELECT count(DISTINCT content) FILTER (ok OR truth IN ('click', 'error')) FROM (SELECT content, truth, seq % 10 <> 0 AS ok FROM v))::BIGINT AS associations, n::DOUBLE / k AS avg_logs_per_template FROM y")
def pool_stats(spark, sf_dir):
    r = _mixed(spark, sf_dir)
    return pool.stats(r.templates, r.assignments).withColumn("avg_confidence", F.round("avg_confidence", 9))


@query(f"WITH {_MINED}, h AS ({_KNOWN}), p AS (SELECT count(h.log_md5) AS hits, count(*) - count(h.log_md5) AS misses FROM logs LEFT JOIN h ON md5(content) = log_md5) SELECT 'table' AS backend, hits::BIGINT AS hits, misses::BIGINT AS misses, hits::DOUBLE / (hits + misses) AS hit_rate, 86400 AS ttl, (SELECT count(*) FROM h)::BIGINT AS size, 10000 AS max_size, (SELECT count(*) FROM h) / 10000.0::DOUBLE AS utilization FROM p")
def cache_stats(spark, sf_dir):
    known = _known_kinds(spark, sf_dir)
    return stats.cache_stats(match.by_known_line(logs(spark, sf_dir), known), known)


_CALLS = f"{_LOGS}, u AS (SELECT length(content)::BIGINT AS tokens, CASE seq % 4 WHEN 0 THEN 'gpt-4' WHEN 1 THEN 'gpt-3.5-turbo' WHEN 2 THEN 'gpt-4-turbo-preview' ELSE 'other' END AS model FROM logs)"


def _calls(spark, sf_dir) -> DataFrame:
    model = F.element_at(F.array(*map(F.lit, ("gpt-4", "gpt-3.5-turbo", "gpt-4-turbo-preview", "other"))), (F.col("seq") % 4 + 1).cast("int"))
    return logs(spark, sf_dir).select(F.length("content").cast("long").alias("tokens"), model.alias("model"))


@query(f"WITH {_CALLS} SELECT model, round(sum(tokens / 1000.0::DOUBLE * CASE model WHEN 'gpt-3.5-turbo' THEN 0.001 WHEN 'gpt-4-turbo-preview' THEN 0.02 ELSE 0.045 END::DOUBLE), 6) AS cost FROM u GROUP BY 1")
def llm_cost(spark, sf_dir):
    return _calls(spark, sf_dir).groupBy("model").agg(F.round(F.sum(prompts.cost(F.col("tokens"), F.col("model"))), 6).alias("cost"))


@query(f"WITH {_CALLS} SELECT count(*)::BIGINT AS total_calls, sum(tokens)::BIGINT AS total_tokens, round(sum(tokens / 1000.0::DOUBLE * CASE model WHEN 'gpt-3.5-turbo' THEN 0.001 WHEN 'gpt-4-turbo-preview' THEN 0.02 ELSE 0.045 END::DOUBLE), 4) AS estimated_cost_usd, sum(tokens)::DOUBLE / count(*) AS avg_tokens_per_call FROM u")
def llm_usage(spark, sf_dir):
    return stats.usage(_calls(spark, sf_dir))


@query(f"WITH {_LOGS} SELECT seq, md5({_lit(prompts.TASK)} || chr(10) || {_lit(prompts.ENTITIES)} || chr(10) || {_lit(prompts.RULES)} || chr(10) || 'Line: ' || content || chr(10) || 'Template:') AS prompt_md5 FROM logs")
def prompt_single(spark, sf_dir):
    return logs(spark, sf_dir).select("seq", F.md5(prompts.extraction(F.col("content"), entities=True).cast("binary")).alias("prompt_md5"))


@query(f"WITH {_LOGS}, b AS (SELECT seq // 20 AS batch, string_agg((seq % 20 + 1)::VARCHAR || '. ' || content, chr(10) ORDER BY seq) AS body FROM logs GROUP BY 1) SELECT batch::BIGINT AS batch, md5({_lit(prompts.TASK)} || chr(10) || {_lit(prompts.RULES)} || chr(10) || body || chr(10) || 'One template on each line, in this order:') AS prompt_md5 FROM b")
def prompt_batch(spark, sf_dir):
    lists = logs(spark, sf_dir).groupBy(F.expr("seq div 20").alias("batch")).agg(F.transform(F.sort_array(F.collect_list(F.struct("seq", "content"))), lambda s: s["content"]).alias("ls"))
    return lists.select("batch", F.md5(prompts.batch(F.col("ls")).cast("binary")).alias("prompt_md5"))


@query(f"WITH {_MINED}, x AS (SELECT a.template_id AS i, b.template_id AS j, a.template_pattern AS p, b.template_pattern AS q FROM t a JOIN t b ON a.template_id < b.template_id) SELECT i, j, md5('Are these two templates one event?' || chr(10) || 'A: ' || p || chr(10) || 'B: ' || q || chr(10) || 'Answer MERGE: <template> or KEEP_SEPARATE: <reason>.') AS merging, md5('Does the template fit the line?' || chr(10) || 'Line: ' || p || chr(10) || 'Template: ' || q || chr(10) || 'Answer VALID or INVALID: <reason>.') AS validation, md5('How alike are the events of these lines, from 0 to 1?' || chr(10) || 'A: ' || p || chr(10) || 'B: ' || q || chr(10) || 'Answer with a number.') AS likeness FROM x")
def prompt_pairs(spark, sf_dir):
    t = pool.mined(_mined_rows(spark, sf_dir)).select(F.col("template_id").alias("i"), F.col("template_pattern").alias("p"))
    pairs = t.join(t.select(F.col("i").alias("j"), F.col("p").alias("q")), F.col("i") < F.col("j"))  # a handful of templates
    p, q = F.col("p"), F.col("q")
    return pairs.select("i", "j", *(F.md5(f(p, q).cast("binary")).alias(n) for n, f in (("merging", prompts.merging), ("validation", prompts.validation), ("likeness", prompts.likeness))))


@query(rf"WITH l AS (SELECT doc_id, unnest(range(len(string_split({_strip('text')}, chr(10))))) AS pos, {_strip(f'unnest(string_split({_strip("text")}, chr(10)))')} AS line FROM documents), k AS (SELECT doc_id, pos, regexp_replace(line, '^\d+[\.\)]\s*', '') AS template FROM l WHERE line <> '' AND line NOT LIKE '#%'), n AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS position, template FROM k WHERE template <> '') SELECT doc_id, position::INTEGER AS position, template FROM n WHERE position < 3")
def batch_response_parse(spark, sf_dir):
    return prompts.batch_answer(_read(spark, sf_dir, "documents"), "text", F.lit(3)).select("doc_id", "position", "template")


# ---------------------------------------------------------------- end to end, streams


@query(f"WITH {_MINED} SELECT seq, template_id, template_pattern, 0.85::DOUBLE AS confidence, {_LEVEL} AS log_level, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS timestamp FROM v JOIN t USING (template_pattern)")
def parse_batch_end_to_end(spark, sf_dir):
    rows = Pipeline(spark).parse_batch(logs(spark, sf_dir)).rows
    return rows.select("seq", "template_id", "template_pattern", "confidence", "log_level", F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss").alias("timestamp"))


@query(f"WITH {_MINED}, h AS ({_KNOWN}) SELECT seq, t.template_id, h.log_md5 IS NOT NULL AS cache_hit, h.log_md5 IS NULL AS used_llm FROM v JOIN t USING (template_pattern) LEFT JOIN h ON md5(content) = log_md5")
def parse_batch_with_known(spark, sf_dir):
    engine, lines = Pipeline(spark), logs(spark, sf_dir)
    whole = engine.parse_batch(lines)
    whole.assignments = _known_kinds(spark, sf_dir)
    return engine.parse_batch(lines, whole).rows.select("seq", "template_id", "cache_hit", "used_llm")


@query(f"WITH {_MINED} SELECT seq, template_pattern AS template, {_LEVEL} AS level, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS timestamp, 0.85::DOUBLE AS confidence FROM v JOIN t USING (template_pattern)")
def structured_rows(spark, sf_dir):
    return match.structured(Pipeline(spark).parse_batch(logs(spark, sf_dir)).rows).select("seq", "template", "level", "timestamp", "confidence")


@query(f"WITH {_MINED} SELECT content AS original, template_id, template_pattern AS template, 0.85::DOUBLE AS confidence, true AS used_llm, false AS cache_hit, 0.0::DOUBLE AS processing_time_ms FROM v JOIN t USING (template_pattern)")
def file_result(spark, sf_dir):
    return match.file_result(Pipeline(spark).parse_batch(logs(spark, sf_dir)).rows)


@query(f"""WITH {_LOGS}, c AS (SELECT seq, {_clean('content', ts=True)} AS content FROM logs), v AS (SELECT seq, list_slice({_TOKENS}, 1, 5) AS path, {_heuristic('content')} AS pattern FROM c WHERE {_valid('content')}),
  o AS (SELECT path, pattern, row_number() OVER (PARTITION BY path ORDER BY seq) AS k, count(*) OVER (PARTITION BY path) AS n FROM v WHERE seq % 2 = 0), k AS (SELECT path, pattern FROM o WHERE k = 1 AND n >= 3),
  f AS (SELECT seq, pattern, (SELECT arg_min(k.pattern, len(k.path)) FROM k WHERE len(k.path) <= len(v.path) AND list_slice(v.path, 1, len(k.path)) = k.path) AS found FROM v WHERE seq % 2 = 1)
  SELECT seq, coalesce(found, pattern) AS template_pattern FROM f""")
def parse_batch_by_prefix(spark, sf_dir):
    engine, lines = Pipeline(spark, _STRIPPED), logs(spark, sf_dir)
    known = engine.parse_batch(lines.where("seq % 2 = 0"), match_mode="prefix")
    known.clusters = kept(known.clusters)
    return engine.parse_batch(lines.where("seq % 2 = 1"), known, match_mode="prefix").rows.select("seq", "template_pattern")


@query(f"WITH {_MINED} SELECT seq, template_id, true AS cache_hit FROM v JOIN t USING (template_pattern)")
def state_round_trip(spark, sf_dir):
    engine, lines = Pipeline(spark), logs(spark, sf_dir)
    path = _folder(spark)
    engine.save_state(path, engine.parse_batch(lines))
    return engine.parse_batch(lines, engine.load_state(path)).rows.select("seq", "template_id", "cache_hit")


def _folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark).rstrip('/')}/loomlog-{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"


def _written(spark, sf_dir, kind: str, write: Callable[[DataFrame, str], None]) -> DataFrame:
    """Log lines that were written in this format and read again: content."""
    path = f"{_folder(spark)}.{kind}"
    write(logs(spark, sf_dir).select("seq", F.col("content").alias("log")), path)
    return files.lines(spark, path).select("content")


@query(f"WITH {_LOGS} SELECT content FROM logs")
def scan_csv(spark, sf_dir):
    return _written(spark, sf_dir, "csv", files.write_csv)


@query(f"WITH {_LOGS} SELECT content FROM logs")
def scan_json(spark, sf_dir):
    path = f"{_folder(spark)}.json"
    logs(spark, sf_dir).select(F.col("content").alias("log")).write.json(path)
    return files.json_lines(spark, path, multi_line=False).select("content")


@query(f"WITH {_LOGS} SELECT row_number() OVER (ORDER BY seq) - 1 AS place, content FROM logs")
def scan_text(spark, sf_dir):
    """The lines' places come back from the order of files and lines."""
    path = f"{_folder(spark)}.txt"
    logs(spark, sf_dir).repartitionByRange(4, "seq").sortWithinPartitions("seq").select("content").write.text(path)
    return ranked(files.lines(spark, path), [F.col("seq")], name="place").select("place", "content")


@query(f"WITH {_MINED} SELECT template_id, template_pattern, count FROM t")
def templates_round_trip(spark, sf_dir):
    path, rows = _folder(spark), _mined_once(spark, sf_dir)
    files.write_templates(pool.pool_rows(pool.mined(rows), pool.last_examples(rows)), path)
    return files.read_templates(spark, path).select("template_id", "template_pattern", "count")


@query(f"WITH {_MINED}, h AS ({_KNOWN}), a AS (SELECT md5(content) AS log_md5, min(template_id) AS template_id FROM v JOIN t USING (template_pattern) WHERE truth = 'view' GROUP BY 1) SELECT log_md5, template_id FROM h WHERE template_id <> 'tmpl_0000' UNION ALL SELECT log_md5, template_id FROM a WHERE log_md5 NOT IN (SELECT log_md5 FROM h) AND template_id <> 'tmpl_0000'")
def store_round_trip(spark, sf_dir):
    """Known lines set in two steps by two openings of one store, and some deleted."""
    path, rows = _folder(spark), _mined_once(spark, sf_dir)
    open_store(spark, "file", path).set(_known_kinds(spark, sf_dir))
    t = pool.mined(rows).select("template_id", "template_pattern")
    seen = rows.where("truth = 'view'").join(t, "template_pattern").select(F.md5(F.col("content").cast("binary")).alias("log_md5"), "template_id")
    store = open_store(spark, "file", path)
    store.set(seen)
    store.delete(store.get().where("template_id = 'tmpl_0000'"))
    return open_store(spark, "file", path).get().select("log_md5", "template_id")


def _streamed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a stream of lines."""
    path = f"{sf_dir}/events.parquet"
    schema = spark.read.parquet(path).schema
    folder, name = path.rsplit("/", 1)
    source = spark.readStream.schema(schema).option("pathGlobFilter", name).parquet(folder)
    return source.selectExpr("event_id", "user_id", "concat(event_type, ' by user ', cast(user_id as string), ' in session ', cast(event_id % 97 as string)) as content", "cast(ts as timestamp) as ts")


def _drained(df: DataFrame, mode: str) -> DataFrame:
    """All that the stream yields, through a table in the shared folder."""
    return stream.drained(df, mode, _folder(df.sparkSession))


#: The pattern of a streamed line; numbers of four digits and more are masked by the cleaner already.
_STREAMED = "event_type || ' by user ' || CASE WHEN user_id >= 1000 THEN '<NUM>' ELSE '<*>' END || ' in session <*>'"


@query(f"SELECT {_STREAMED} AS template_pattern, count(*)::BIGINT AS count FROM events GROUP BY 1")
def stream_template_counts(spark, sf_dir):
    return _drained(stream.template_counts(_streamed(spark, sf_dir)), "complete")


@query(f"SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS window_start, {_STREAMED} AS template_pattern, count(*)::BIGINT AS count FROM events GROUP BY 1, 2")
def stream_window_counts(spark, sf_dir):
    """All windows, those still open at the end too."""
    counts = _drained(stream.windowed_counts(_streamed(spark, sf_dir)), "complete")
    return counts.withColumn("window_start", F.date_format("window_start", "yyyy-MM-dd HH:mm:ss"))


@query("""WITH e AS (SELECT user_id, ts, coalesce(ts - lag(ts) OVER w >= INTERVAL 2 HOUR, true) AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
  s AS (SELECT user_id, ts, sum(fresh::INT) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS n FROM e)
  SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, count(*)::BIGINT AS count FROM s GROUP BY user_id, n""")
def stream_sessions(spark, sf_dir):
    found = _drained(stream.sessions(_streamed(spark, sf_dir), "user_id", gap="2 hours"), "complete")
    return found.select("user_id", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "count")


@query("SELECT DISTINCT event_type || ' by user ' || user_id::VARCHAR || ' in session ' || (event_id % 97)::VARCHAR AS content FROM events")
def stream_without_repeats(spark, sf_dir):
    return _drained(stream.without_repeats(_streamed(spark, sf_dir)), "append").select("content")


@query(f"SELECT event_id AS seq, {_STREAMED} AS template_pattern FROM events")
def stream_mined(spark, sf_dir):
    """Every micro-batch is parsed with the templates known so far, and its rows are appended to a table."""
    path, engine, state = _folder(spark), Pipeline(spark), {}

    def parse(batch: DataFrame, number: int) -> None:
        result = engine.parse_batch(batch.select(F.col("event_id").alias("seq"), "content"), state.get("known"))
        result.templates, result.assignments = kept(result.templates), kept(result.assignments)
        result.rows.select("seq", "template_pattern").write.mode("append").parquet(f"{path}/rows")
        state["known"] = result

    stream.mine(_streamed(spark, sf_dir), parse, f"{path}/checkpoint", once=True).awaitTermination()
    return spark.read.schema("seq bigint, template_pattern string").parquet(f"{path}/rows")
