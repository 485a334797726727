"""The data-processing operators of a project-knowledge store as queries over the given tables, with SQL that says the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from knowmill.functions import text as T
from knowmill.functions.vector import cosine_distance, distance_score, l2_squared
from knowmill.operators import code as C
from knowmill.operators import context, graph, hierarchy, ingest, reports
from knowmill.operators import retrieval as R
from knowmill.operators import symbols as S
from knowmill.operators.packed import packed_fields, split_packed
from knowmill.sources.tables import cut, instant, key_of, table, trimmed

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _kb(spark: SparkSession, folder: str) -> DataFrame:
    """Documents at their latest version."""
    return R.current(table(spark, folder, "kb_documents"), "doc_id", rank=F.col("version"))


def _chunks(spark: SparkSession, folder: str) -> DataFrame:
    return R.current(table(spark, folder, "doc_chunks"), "chunk_id")


def _code(spark: SparkSession, folder: str) -> DataFrame:
    return R.current(table(spark, folder, "code_chunks"), "chunk_id")


def _once(spark: SparkSession, folder: str, name: str, key: str) -> DataFrame:
    return R.current(table(spark, folder, name), key)


#: Common table expressions of the SQL side.
KB = "kb AS (SELECT DISTINCT ON (doc_id) * FROM kb_documents ORDER BY doc_id, version DESC)"
CH = "ch AS (SELECT DISTINCT ON (chunk_id) * FROM doc_chunks ORDER BY chunk_id)"
CO = "co AS (SELECT DISTINCT ON (chunk_id) * FROM code_chunks ORDER BY chunk_id)"
DE = "de AS (SELECT DISTINCT ON (decision_id) * FROM decisions ORDER BY decision_id)"
AL = "al AS (SELECT DISTINCT ON (log_id) * FROM activity_log ORDER BY log_id)"
ED = """ed AS (SELECT DISTINCT ON (relationship_id) relationship_id, project_id, type, lower(trim(from_id)) a, lower(trim(to_id)) b, created_at
  FROM relationships WHERE trim(from_id) <> '' AND trim(to_id) <> '' ORDER BY relationship_id)"""
TA = "ta AS (SELECT DISTINCT ON (lower(trim(task_id))) lower(trim(task_id)) k, * FROM tasks ORDER BY lower(trim(task_id)), CAST(updated_at AS TIMESTAMPTZ) DESC)"
BOTH = "bo AS (SELECT relationship_id, type, a here, b there, 'outgoing' direction FROM ed UNION ALL SELECT relationship_id, type, b, a, 'incoming' FROM ed)"


# -- filters and projections


@query(f"""WITH {KB} SELECT doc_id, version, title, CASE WHEN length(content) > 400 THEN substr(content, 1, 400) || '...' ELSE content END summary
FROM kb WHERE status <> 'superseded' AND contains(tags, '|wave-2|') AND priority >= 2""")
def flt_documents(spark, folder):
    """Documents by status, exact tag and least priority (null never passes), with a summary."""
    d = _kb(spark, folder).where((F.col("status") != "superseded") & T.has_tag(F.col("tags"), "wave-2") & (F.col("priority") >= 2))
    return d.select("doc_id", "version", "title", T.summary(F.col("content")).alias("summary"))


@query(rf"""WITH {CO} SELECT chunk_id, file_path FROM co WHERE file_path LIKE 'packages/%/src/db/%\_%.ts' ESCAPE '\'""")
def flt_code_glob(spark, folder):
    """Code chunks whose path matches a glob."""
    return _code(spark, folder).where(F.col("file_path").like(T.glob_to_like("packages/*/src/db/**_*.ts"))).select("chunk_id", "file_path")


@query(f"""WITH {DE} SELECT decision_id, subject, tier, epoch_ms(CAST(created_at AS TIMESTAMPTZ)) created_ms FROM de
WHERE status = 'active' AND contains(lower(subject), 're') AND (contains(tags, '|cache') OR contains(tags, 'cache|') OR tags = 'cache' OR tier <= 2)
ORDER BY CAST(created_at AS TIMESTAMPTZ) DESC, decision_id LIMIT 20 OFFSET 10""")
def flt_decisions_page(spark, folder):
    """A page of active decisions by part of the subject, loose tag or tier, the latest first."""
    d = _once(spark, folder, "decisions", "decision_id").where((F.col("status") == "active") & F.lower("subject").contains("re") & (T.has_tag_loosely(F.col("tags"), "cache") | (F.col("tier") <= 2)))
    d = d.orderBy(instant(F.col("created_at")).desc(), "decision_id").offset(10).limit(20)
    return d.select("decision_id", "subject", "tier", F.unix_millis(instant(F.col("created_at"))).alias("created_ms"))


@query(f"""WITH {KB} SELECT project_id, doc_id, priority FROM (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY priority DESC, doc_id) r FROM kb WHERE priority >= 4 AND status <> 'superseded') WHERE r <= 20""")
def srt_key_documents(spark, folder):
    """Up to twenty documents of high priority in each project."""
    d = _kb(spark, folder).where("priority >= 4 AND status <> 'superseded'")
    return d.withColumn("r", F.row_number().over(W.partitionBy("project_id").orderBy(F.desc("priority"), "doc_id"))).where("r <= 20").select("project_id", "doc_id", "priority")


@query(f"""WITH {AL} SELECT project_id, log_id, action, CAST(r AS INTEGER) place FROM (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY CAST(created_at AS TIMESTAMPTZ) DESC, log_id DESC) r FROM al) WHERE r <= 5""")
def srt_recent_activity(spark, folder):
    """The five latest actions of each project."""
    return reports.recent(_once(spark, folder, "activity_log", "log_id"), "created_at", "log_id").select("project_id", "log_id", "action", "place")


# -- vectors

_ASK_CODE = "(SELECT vector FROM co WHERE len(vector) = 64 AND list_inner_product(vector, vector) > 0 ORDER BY chunk_id LIMIT 1)"


def _first_vector(rows: DataFrame, key: str) -> list[float]:
    """The vector of the first usable row by key, to ask with."""
    usable = rows.where((F.size("vector") == 64) & F.exists("vector", lambda x: x != 0))
    row = usable.orderBy(key).select("vector").first()
    return [float(x) for x in row[0]] if row else [1.0] * 64


_DIST = "1 - list_inner_product(CAST({v} AS DOUBLE[]), CAST({q} AS DOUBLE[])) / (sqrt(list_inner_product(CAST({v} AS DOUBLE[]), CAST({v} AS DOUBLE[]))) * sqrt(list_inner_product(CAST({q} AS DOUBLE[]), CAST({q} AS DOUBLE[]))))"


@query(f"""WITH {CH}, {KB}, q AS (SELECT vector v FROM ch WHERE len(vector) = 64 AND list_inner_product(vector, vector) > 0 ORDER BY chunk_id LIMIT 1),
ok AS (SELECT doc_id FROM kb WHERE status <> 'superseded' AND category <> 'change_record'),
near AS (SELECT ch.*, {_DIST.format(v="ch.vector", q="q.v")} d FROM ch, q WHERE status = 'active' AND doc_id IN (SELECT doc_id FROM ok) AND len(vector) = 64 AND list_inner_product(vector, vector) > 0 ORDER BY d, chunk_id LIMIT 10)
SELECT chunk_id, near.doc_id, kb.title, kb.category, round(greatest(0, least(1, 1 - d / 2)), 6) score FROM near LEFT JOIN kb USING (doc_id) WHERE 1 - d / 2 >= 0.5""")
def vec_search_documents(spark, folder):
    """Cosine search over active chunks of filtered documents, scored and enriched from the latest version."""
    chunks = table(spark, folder, "doc_chunks")
    among = _kb(spark, folder).where("status <> 'superseded' AND category <> 'change_record'")
    found = R.vector_search(chunks.where("status = 'active'"), _first_vector(chunks, "chunk_id"), "chunk_id", 10, 0.5, keep=("doc_id",), documents=among, add=("title", "category"))
    return found.select("chunk_id", "doc_id", "title", "category", F.round("score", 6).alias("score"))


@query(f"""WITH {CO} SELECT chunk_id, file_path, round(greatest(0, least(1, 1 - d / 2)), 6) score FROM (
SELECT chunk_id, file_path, {_DIST.format(v="vector", q=_ASK_CODE)} d FROM co WHERE symbol_type = 'function' AND len(vector) = 64 AND list_inner_product(vector, vector) > 0 ORDER BY d, chunk_id LIMIT 10)""")
def vec_search_code(spark, folder):
    """Cosine search over functions."""
    code = table(spark, folder, "code_chunks")
    found = R.vector_search(code.where("symbol_type = 'function'"), _first_vector(code, "chunk_id"), "chunk_id", 10, keep=("file_path",))
    return found.select("chunk_id", "file_path", F.round("score", 6).alias("score"))


#: Queries: every decision whose id's hash is divisible by 50 (its last seven hexadecimal digits).
_ASKS = "CAST('0x' || substr(md5(decision_id), 26, 7) AS BIGINT) % 50 = 0"
_PAIRS = f"""dv AS (SELECT decision_id, project_id, decision_type, status, vector, CAST(created_at AS TIMESTAMPTZ) t FROM de WHERE len(vector) = 64),
prs AS (SELECT a.decision_id, b.decision_id AS other, round(list_sum(list_transform(range(1, 65), lambda i: (CAST(a.vector[i] AS DOUBLE) - CAST(b.vector[i] AS DOUBLE)) ** 2)), 9) d
FROM dv a JOIN dv b ON a.project_id = b.project_id AND a.decision_type = b.decision_type AND b.status = 'active' AND b.t < a.t WHERE {_ASKS.replace("decision_id", "a.decision_id")}),
near AS (SELECT decision_id, other precedent, d FROM prs QUALIFY row_number() OVER (PARTITION BY decision_id ORDER BY d, other) = 1)"""


def _nearest_earlier(spark, folder) -> DataFrame:
    """(decision_id, precedent, d) of the asking decisions.

    The asking ones are cut into blocks of a project and type, each a row that is broadcast or shuffled to its
    candidates, so that a hot project's candidates are spread over salted parts and each meets a block at a time.
    """
    d = table(spark, folder, "decisions").where(F.size("vector") == 64)
    d = d.select("decision_id", "project_id", "decision_type", "status", "vector", instant(F.col("created_at")).alias("at"))
    asks = R.current(d.where(F.conv(F.substring(F.md5("decision_id"), 26, 7), 16, 10).cast("bigint") % 50 == 0), "decision_id")
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    asks = asks.select("decision_id", "project_id", "decision_type", "vector", "at", salts.alias("salt"))
    b = d.where("status = 'active'").select("project_id", "decision_type", F.col("decision_id").alias("other"), F.col("vector").alias("w"), F.col("at").alias("before"), F.pmod(F.xxhash64("decision_id"), F.lit(SALTS)).cast("int").alias("salt"))
    pairs = asks.join(b, ["project_id", "decision_type", "salt"]).where("before < at").select("decision_id", "other", F.round(l2_squared(F.col("vector"), F.col("w")), 9).alias("d"))
    # only each salted part's best goes on
    return pairs.groupBy("decision_id").agg(F.min(F.struct("d", "other")).alias("x")).select("decision_id", F.col("x.other").alias("precedent"), "x.d")


#: Parts of one project's and type's decisions.
SALTS = 16


@query(f"WITH {DE}, {_PAIRS} SELECT decision_id, precedent, round(d, 6) distance, greatest(0, least(1, 1 - d / 2)) >= 0.85 is_precedent FROM near")
def vec_precedents(spark, folder):
    """Of each asking decision the nearest earlier active one of its project and type by squared L2, and whether it is near enough to be a precedent."""
    return _nearest_earlier(spark, folder).select("decision_id", "precedent", F.round("d", 6).alias("distance"), (distance_score(F.col("d")) >= 0.85).alias("is_precedent"))


@query(f"WITH {DE}, {_PAIRS} SELECT decision_id, coalesce(d <= 0.15, false) has_precedent FROM dv LEFT JOIN near USING (decision_id) WHERE {_ASKS}")
def vec_write_flags(spark, folder):
    """The flag that each asking decision gets when it is written: whether an earlier active one lies within 0.15."""
    d = R.current(table(spark, folder, "decisions").where(F.size("vector") == 64).select("decision_id"), "decision_id")
    d = d.where(F.conv(F.substring(F.md5("decision_id"), 26, 7), 16, 10).cast("bigint") % 50 == 0)
    return d.join(_nearest_earlier(spark, folder), "decision_id", "left").select("decision_id", F.coalesce(F.col("d") <= 0.15, F.lit(False)).alias("has_precedent"))


# -- words

_WORDS = r"regexp_extract_all(lower({t}), '[\p{{L}}\p{{N}}]+')"


def _bm25_sql(rows: str, terms: list[str], text: str = "content") -> str:
    """(of rows) x: every row with bm25 over the counts of all rows."""
    tf = ", ".join(f"len(list_filter(w, lambda x: x = '{t}')) t{i}" for i, t in enumerate(terms))
    df = ", ".join(f"count(*) FILTER (t{i} > 0) d{i}" for i in range(len(terms)))
    score = " + ".join(f"ln(1 + (n - d{i} + 0.5) / (d{i} + 0.5)) * t{i} * 2.2 / (t{i} + 1.2 * (0.25 + 0.75 * dl / avgdl))" for i in range(len(terms)))
    hit = " + ".join(f"t{i}" for i in range(len(terms)))
    return f"""wd AS (SELECT *, coalesce({_WORDS.format(t=text)}, []) w FROM {rows}), tf AS (SELECT *, len(w) dl, {tf} FROM wd),
st AS (SELECT count(*) n, avg(dl) avgdl, {df} FROM tf), bm AS (SELECT tf.*, round({score}, 9) bm25 FROM tf, st WHERE {hit} > 0)"""


TERMS = "replica schema timeout"
_SORTED = sorted(TERMS.split())


@query(f"""WITH {CH}, {_bm25_sql("ch", _SORTED)} SELECT chunk_id, doc_id, round(bm25, 6) bm25, round(bm25 / (bm25 + 1), 6) score FROM (SELECT * FROM bm WHERE status = 'active' ORDER BY bm25 DESC, chunk_id LIMIT 10) WHERE bm25 / (bm25 + 1) >= 0.3""")
def fts_documents(spark, folder):
    """BM25 over document chunks; counts are the whole table's, the status filter comes after."""
    found = R.text_search(table(spark, folder, "doc_chunks"), TERMS, "chunk_id", 10, 0.3, among=F.col("status") == "active", keep=("doc_id",))
    return found.select("chunk_id", "doc_id", F.round("bm25", 6).alias("bm25"), F.round("score", 6).alias("score"))


@query(f"""WITH {CO}, {_bm25_sql("co", _SORTED)} SELECT chunk_id, file_path, round(bm25 / (bm25 + 1), 6) score FROM (SELECT * FROM bm WHERE file_path LIKE 'packages/%.py' ORDER BY bm25 DESC, chunk_id LIMIT 10)""")
def fts_code(spark, folder):
    """BM25 over code chunks under a glob."""
    found = R.text_search(table(spark, folder, "code_chunks"), TERMS, "chunk_id", 10, among=F.col("file_path").like(T.glob_to_like("packages/**.py")), keep=("file_path",))
    return found.select("chunk_id", "file_path", F.round("score", 6).alias("score"))


@query(f"""WITH {CH}, e AS (SELECT chunk_id, unnest({_WORDS.format(t="content")}) term FROM ch) SELECT term, count(DISTINCT chunk_id) AS "rows", count(*) occurrences FROM e GROUP BY term""")
def fts_term_statistics(spark, folder):
    """Rows and occurrences of every word of the chunks."""
    return R.term_statistics(_chunks(spark, folder))


@query(f"""WITH {CH}, e AS (SELECT chunk_id, unnest(w) term, unnest(range(1, len(w) + 1)) pos FROM (SELECT chunk_id, {_WORDS.format(t="content")} w FROM ch)) SELECT term, chunk_id, count(*) tf, CAST(min(pos) AS INTEGER) first_pos, CAST(max(pos) AS INTEGER) last_pos FROM e GROUP BY term, chunk_id""")
def fts_postings(spark, folder):
    """The postings of every word: how often and from where to where it stands in each chunk."""
    return R.postings(_chunks(spark, folder), "chunk_id")


@query(f"""WITH {CH}, {_bm25_sql("ch", _SORTED)}, q AS (SELECT vector v FROM ch WHERE len(vector) = 64 AND list_inner_product(vector, vector) > 0 ORDER BY chunk_id LIMIT 1),
near AS (SELECT chunk_id, row_number() OVER (ORDER BY d, chunk_id) - 1 r FROM (SELECT chunk_id, {_DIST.format(v="vector", q="q.v")} d FROM ch, q WHERE status = 'active' AND len(vector) = 64 AND list_inner_product(vector, vector) > 0 ORDER BY d, chunk_id LIMIT 20)),
word AS (SELECT chunk_id, row_number() OVER (ORDER BY bm25 DESC, chunk_id) - 1 r FROM (SELECT * FROM bm WHERE status = 'active' ORDER BY bm25 DESC, chunk_id LIMIT 20)),
fused AS (SELECT chunk_id, sum(1 / (60 + r)) score FROM (SELECT * FROM near UNION ALL SELECT * FROM word) GROUP BY chunk_id ORDER BY round(score, 12) DESC, chunk_id LIMIT 10)
SELECT chunk_id, doc_id, round(score, 9) score FROM fused JOIN ch USING (chunk_id)""")
def hyb_documents(spark, folder):
    """Vector and word ranks of document chunks fused."""
    chunks = table(spark, folder, "doc_chunks")
    found = R.hybrid_search(chunks, _first_vector(chunks, "chunk_id"), TERMS, "chunk_id", 10, among=F.col("status") == "active", keep=("doc_id",))
    return found.select("chunk_id", "doc_id", F.round("score", 9).alias("score"))


@query(f"""WITH {CO}, {_bm25_sql("co", _SORTED)}, near AS (SELECT chunk_id, row_number() OVER (ORDER BY d, chunk_id) - 1 r FROM (SELECT chunk_id, {_DIST.format(v="vector", q=_ASK_CODE)} d FROM co WHERE len(vector) = 64 AND list_inner_product(vector, vector) > 0 ORDER BY d, chunk_id LIMIT 20)),
word AS (SELECT chunk_id, row_number() OVER (ORDER BY bm25 DESC, chunk_id) - 1 r FROM (SELECT * FROM bm ORDER BY bm25 DESC, chunk_id LIMIT 20)),
fused AS (SELECT chunk_id, sum(1 / (60 + r)) score FROM (SELECT * FROM near UNION ALL SELECT * FROM word) GROUP BY chunk_id ORDER BY round(score, 12) DESC, chunk_id LIMIT 10)
SELECT chunk_id, file_path, round(score, 9) score FROM fused JOIN co USING (chunk_id)""")
def hyb_code(spark, folder):
    """Vector and word ranks of code chunks fused."""
    code = table(spark, folder, "code_chunks")
    return R.hybrid_search(code, _first_vector(code, "chunk_id"), TERMS, "chunk_id", 10, keep=("file_path",)).select("chunk_id", "file_path", F.round("score", 9).alias("score"))


@query(f"""WITH {CH}, {_bm25_sql("ch", _SORTED)} SELECT chunk_id, doc_id, round(bm25 / (bm25 + 1), 6) score FROM (SELECT * FROM bm WHERE status = 'active' ORDER BY bm25 DESC, chunk_id LIMIT 10)""")
def hyb_without_vector(spark, folder):
    """The fused search of document chunks where no embedder answers: word ranks alone."""
    found = R.hybrid_search(table(spark, folder, "doc_chunks"), None, TERMS, "chunk_id", 10, among=F.col("status") == "active", keep=("doc_id",))
    return found.select("chunk_id", "doc_id", F.round("score", 6).alias("score"))


@query(f"""WITH {CH}, p AS (SELECT *, instr(lower(content), 'schema') p1, instr(lower(content), 'replica') p2 FROM ch),
s AS (SELECT *, greatest(0, (CASE WHEN p1 > 0 THEN p1 WHEN p2 > 0 THEN p2 ELSE 1 END) - 1 - 300) st FROM p)
SELECT chunk_id, CASE WHEN ceil(length(content) / 4) <= 150 THEN content ELSE (CASE WHEN st > 0 THEN '...' ELSE '' END) || rtrim(substr(content, CAST(st + 1 AS BIGINT), 600), ' ') || (CASE WHEN st + 600 < length(content) THEN '...' ELSE '' END) END snippet FROM s""")
def txt_snippets(spark, folder):
    """The text around the first query word of every chunk."""
    return _chunks(spark, folder).select("chunk_id", T.snippet(F.col("content"), "schema replica").alias("snippet"))


# -- aggregates


@query(f"""WITH {KB} SELECT category, count(*) n FROM kb WHERE status <> 'superseded' GROUP BY category""")
def agg_categories(spark, folder):
    """Documents of each category."""
    return _kb(spark, folder).where("status <> 'superseded'").groupBy("category").agg(F.count("*").alias("n"))


@query(f"""WITH {CO} SELECT coalesce(nullif(lower(trim(language)), ''), 'unknown') AS "language", count(DISTINCT file_path) files, count(*) chunks FROM co GROUP BY 1""")
def agg_languages(spark, folder):
    """Files and chunks of each language."""
    return reports.language_breakdown(_code(spark, folder))


@query(f"""WITH {KB} SELECT project_id, count(*) documents, count(DISTINCT category) categories, count(*) FILTER (status = 'draft') draft, count(*) FILTER (status = 'active') active,
count(*) FILTER (status = 'approved') approved, count(*) FILTER (status = 'archived') archived FROM kb WHERE status <> 'superseded' GROUP BY project_id""")
def agg_project_overview(spark, folder):
    """Documents and their states in each project, in one pass."""
    return reports.project_overview(_kb(spark, folder))


@query("SELECT doc_id, max(version) \"version\", count(DISTINCT version) versions FROM kb_documents GROUP BY doc_id")
def agg_latest_versions(spark, folder):
    """The latest version of each document and how many there are."""
    return table(spark, folder, "kb_documents").groupBy("doc_id").agg(F.max("version").alias("version"), F.countDistinct("version").alias("versions"))


@query(f"WITH {CH} SELECT doc_id, count(*) chunks, CAST(sum(token_count) AS BIGINT) tokens, max(chunk_index) + 1 - count(DISTINCT chunk_index) gaps FROM ch GROUP BY doc_id")
def agg_chunk_tokens(spark, folder):
    """Chunks, tokens and missing places of each document."""
    return _chunks(spark, folder).groupBy("doc_id").agg(F.count("*").alias("chunks"), F.sum("token_count").alias("tokens"), (F.max("chunk_index") + 1 - F.countDistinct("chunk_index")).alias("gaps"))


@query(f"WITH {CO} SELECT file_path, coalesce(arg_min(coalesce(file_hash, ''), chunk_id), '') hash, count(DISTINCT file_hash) hashes FROM co GROUP BY file_path")
def agg_file_hashes(spark, folder):
    """The hash on each file's first chunk, and how many differ."""
    return _code(spark, folder).groupBy("file_path").agg(F.min_by(F.coalesce("file_hash", F.lit("")), "chunk_id").alias("hash"), F.countDistinct("file_hash").alias("hashes"))


@query(f"""WITH {AL} SELECT coalesce(nullif(trim(actor), ''), 'unknown') actor, count(*) calls, count(DISTINCT action) actions, CAST(sum(coalesce(ceil(length(metadata) / 4), 0)) AS BIGINT) tokens FROM al GROUP BY 1""")
def agg_usage(spark, folder):
    """Calls and estimated tokens of each actor."""
    return reports.usage_by_actor(_once(spark, folder, "activity_log", "log_id"))


@query(f"""WITH {AL} SELECT project_id, strftime(CAST(created_at AS TIMESTAMPTZ) AT TIME ZONE 'UTC', '%Y-%m-%d') AS "day", action, count(*) n FROM al GROUP BY ALL""")
def agg_daily_activity(spark, folder):
    """Actions of each project and day."""
    return reports.daily_activity(_once(spark, folder, "activity_log", "log_id"))


@query(f"""WITH {AL}, m AS (SELECT action, TRY_CAST(metadata AS JSON) m FROM al) SELECT action,
count(*) FILTER (TRY_CAST(m->>'count' AS BIGINT) IS NOT NULL OR TRY_CAST(m->>'ok' AS BOOLEAN) IS NOT NULL OR TRY_CAST(m->>'chunks_deleted' AS BIGINT) IS NOT NULL) parsed,
CAST(coalesce(sum(TRY_CAST(m->>'count' AS BIGINT)), 0) AS BIGINT) counted, CAST(coalesce(sum(TRY_CAST(m->>'chunks_deleted' AS BIGINT)), 0) AS BIGINT) chunks_deleted FROM m GROUP BY action""")
def txt_json_metadata(spark, folder):
    """Numbers inside the log's JSON, malformed text tolerated."""
    return reports.metadata_numbers(_once(spark, folder, "activity_log", "log_id"))


# -- graph and hierarchy


def _edges(spark, folder):
    return graph.edges(table(spark, folder, "relationships"))


@query(f"""WITH {ED}, {BOTH}, {KB} SELECT here, kb.doc_id related_id, kb.title related_title, type, direction, relationship_id FROM bo JOIN kb ON there = lower(trim(kb.doc_id)) WHERE kb.status <> 'superseded'""")
def gr_neighbours(spark, folder):
    """Both ends' neighbours of every edge, superseded documents left out."""
    return graph.neighbours(_edges(spark, folder), _kb(spark, folder))


_NEAR = "CASE type " + " ".join(f"WHEN '{t}' THEN {n}" for t, n in graph.NEARNESS.items()) + f" ELSE {graph.LAST} END"
_BEST = f"""nb AS (SELECT here, kb.doc_id related_id, type, direction, relationship_id, {_NEAR} nearness FROM bo JOIN kb ON there = lower(trim(kb.doc_id)) WHERE kb.status <> 'superseded'),
be AS (SELECT * FROM nb QUALIFY row_number() OVER (PARTITION BY here, related_id ORDER BY nearness, direction DESC, relationship_id) = 1)"""


@query(f"WITH {ED}, {BOTH}, {KB}, {_BEST} SELECT here, related_id, type, direction, relationship_id, nearness FROM be")
def win_best_relation(spark, folder):
    """The nearest relationship of every pair of neighbours."""
    return graph.best_relation(graph.neighbours(_edges(spark, folder), _kb(spark, folder))).select("here", "related_id", "type", "direction", "relationship_id", "nearness")


@query(f"WITH {ED}, {BOTH} SELECT here node, count(*) FILTER (direction = 'outgoing') outgoing, count(*) FILTER (direction = 'incoming') incoming FROM bo GROUP BY here")
def gr_degrees(spark, folder):
    """Edges out of and into every node."""
    return graph.degrees(_edges(spark, folder))


@query(f"WITH {ED} SELECT project_id, a, b, type, count(*) n, min(relationship_id) first_id FROM ed GROUP BY ALL HAVING count(*) > 1")
def jn_repeated_edges(spark, folder):
    """Edges of the same ends and type that stand more than once."""
    return graph.repeated_edges(_edges(spark, folder))


@query(f"WITH {ED}, {KB} SELECT doc_id FROM kb WHERE lower(trim(doc_id)) NOT IN (SELECT b FROM ed) AND lower(trim(doc_id)) NOT IN (SELECT a FROM ed)")
def set_unreferenced_documents(spark, folder):
    """Documents that no relationship names."""
    named = graph.both_directions(_edges(spark, folder)).select(F.col("here").alias("k")).distinct()
    return _kb(spark, folder).withColumn("k", key_of(F.col("doc_id"))).join(named, "k", "left_anti").select("doc_id")


_DEPS = """need AS (SELECT DISTINCT a k, b d FROM ed WHERE type = 'task_depends_on'),
held AS (SELECT need.k, count(*) dependencies, count(*) FILTER (ta.status <> 'done' AND NOT coalesce(ta.is_cancelled, false)) open FROM need JOIN ta ON ta.k = d GROUP BY need.k)"""


@query(f"""WITH {ED}, {TA}, {_DEPS} SELECT task_id, coalesce(dependencies, 0) dependencies, coalesce(open, 0) open,
CASE WHEN dependencies > 0 THEN open > 0 ELSE coalesce(is_blocked, false) AND coalesce(block_reason, '') <> '' END blocked FROM ta LEFT JOIN held USING (k)""")
def gr_blocked_tasks(spark, folder):
    """Whether each task's dependencies block it, as a view."""
    return graph.blocked_tasks(_edges(spark, folder), graph.current_tasks(table(spark, folder, "tasks")))


@query(f"""WITH {ED}, {TA} SELECT ta.task_id, count(DISTINCT w.task_id) waiting FROM ta JOIN ed ON ed.b = ta.k AND type = 'task_depends_on' JOIN ta w ON w.k = ed.a WHERE ta.status = 'done' OR coalesce(ta.is_cancelled, false) GROUP BY ta.task_id""")
def gr_released_dependents(spark, folder):
    """Finished tasks and how many tasks waited for them: one level of propagation as a join."""
    tasks = graph.current_tasks(table(spark, folder, "tasks"))
    done = tasks.where("status = 'done' OR coalesce(is_cancelled, false)").select(F.col("k").alias("b"), "task_id")
    waits = tasks.select(F.col("k").alias("a"), F.col("task_id").alias("waiter"))
    return _edges(spark, folder).where("type = 'task_depends_on'").join(done, "b").join(waits, "a").groupBy("task_id").agg(F.countDistinct("waiter").alias("waiting"))


@query(f"""WITH RECURSIVE {ED}, d AS (SELECT DISTINCT a, b FROM ed WHERE type = 'task_depends_on'),
fw AS (SELECT a s, b n FROM d UNION SELECT fw.s, d.b FROM fw JOIN d ON d.a = fw.n) SELECT DISTINCT s node FROM fw WHERE s = n""")
def gr_dependency_cycles(spark, folder):
    """Tasks on a cycle of dependencies."""
    return graph.cyclic_nodes(_edges(spark, folder).where("type = 'task_depends_on'"))


def _task_tree(spark, folder):
    tasks = table(spark, folder, "tasks")
    nodes = hierarchy.linked(hierarchy.node_rows(tasks, "tasks", "task_id", "parent_id", instant(F.col("updated_at"))))
    return nodes, graph.current_tasks(tasks)


_TREE = """ln AS (SELECT a.*, b.k parent FROM ta a LEFT JOIN ta b ON lower(trim(a.parent_id)) = b.k),
tr AS (SELECT k, [k] up FROM ln WHERE parent IS NULL UNION ALL SELECT c.k, list_append(t.up, c.k) FROM tr t JOIN ln c ON c.parent = t.k),
pairs AS (SELECT k, unnest(up) anc FROM tr)"""


@query(f"""WITH RECURSIVE {TA}, {_TREE}, s AS (SELECT anc k, count(*) - 1 descendants, count(*) FILTER (status = 'done' AND pairs.k <> anc) done,
 count(*) FILTER (status = 'in_progress' AND pairs.k <> anc) in_progress, count(*) FILTER (coalesce(is_blocked, false) AND pairs.k <> anc) blocked FROM pairs JOIN ta ON ta.k = pairs.k GROUP BY anc),
kids AS (SELECT parent k, bool_and(status = 'done') all_done FROM ln WHERE parent IS NOT NULL GROUP BY parent)
SELECT ta.task_id, descendants, done, in_progress, blocked, coalesce(all_done, false) children_all_done, CAST(CASE WHEN descendants > 0 THEN floor(100 * done / descendants + 0.5) ELSE 0 END AS INTEGER) pct
FROM s JOIN ta USING (k) LEFT JOIN kids USING (k)""")
def agg_task_rollup(spark, folder):
    """Counts over all tasks below each task; rings are left out."""
    nodes, tasks = _task_tree(spark, folder)
    one = lambda c: c.cast("bigint")
    own = tasks.select("k", "task_id", one(F.col("status") == "done").alias("d"), one(F.col("status") == "in_progress").alias("p"), one(F.coalesce("is_blocked", F.lit(False))).alias("b"))
    sums = hierarchy.subtree_sums(nodes.join(own, "k").withColumn("n", F.lit(1).cast("bigint")), ["n", "d", "p", "b"])
    kids = nodes.where("parent IS NOT NULL").join(own, "k").groupBy(F.col("parent").alias("k")).agg(F.min("d").alias("all"))
    below = lambda c: F.col(f"s.{c}") - F.col(f"o.{c}")
    r = sums.alias("s").join(own.alias("o"), "k").join(kids, "k", "left")
    n = F.col("s.n") - 1
    return r.select("task_id", n.alias("descendants"), below("d").alias("done"), below("p").alias("in_progress"), below("b").alias("blocked"), F.coalesce(F.col("all") == 1, F.lit(False)).alias("children_all_done"), F.when(n > 0, F.round(100 * below("d") / n)).otherwise(0).cast("int").alias("pct"))


@query(f"""WITH RECURSIVE {TA}, {_TREE}, m AS (SELECT anc k, bool_or(coalesce(ta.priority = 'critical' AND ta.status <> 'done', false)) hit FROM pairs JOIN ta ON ta.k = pairs.k GROUP BY anc)
SELECT task_id, NOT (hit OR parent IS NULL) collapsed, CASE WHEN hit OR parent IS NULL THEN ln.title ELSE '[collapsed]' END title FROM m JOIN ln USING (k)""")
def gr_filter_with_context(spark, folder):
    """Tasks that match a filter stay, with all above them; others are collapsed, roots never."""
    nodes, tasks = _task_tree(spark, folder)
    match = tasks.select("k", "task_id", "title", F.coalesce((F.col("priority") == "critical") & (F.col("status") != "done"), F.lit(False)).cast("bigint").alias("hit"))
    sums = hierarchy.subtree_sums(nodes.join(match.select("k", "hit"), "k"), ["hit"])
    shown = (F.col("hit") > 0) | F.col("parent").isNull()
    return sums.select("k", "parent", "hit").join(match.drop("hit"), "k").select("task_id", (~shown).alias("collapsed"), F.when(shown, F.col("title")).otherwise("[collapsed]").alias("title"))


@query(f"""WITH RECURSIVE {TA}, ln AS (SELECT a.*, b.k parent FROM ta a LEFT JOIN ta b ON lower(trim(a.parent_id)) = b.k),
tr AS (SELECT k, k root, 0 depth FROM ln WHERE parent IS NULL UNION ALL SELECT c.k, t.root, t.depth + 1 FROM tr t JOIN ln c ON c.parent = t.k)
SELECT root, depth, count(*) tasks FROM tr WHERE depth < 5 GROUP BY ALL""")
def gr_tree_levels(spark, folder):
    """Tasks on each of the first five levels of each tree."""
    nodes, _ = _task_tree(spark, folder)
    return hierarchy.nested_sets(nodes.select("src", "k", "id", F.col("parent").alias("p"))).where("root IS NOT NULL AND depth < 5").groupBy("root", "depth").agg(F.count("*").alias("tasks"))


@query(f"""WITH {TA} SELECT task_id, lower(trim(parent_id)) parent, CAST(row_number() OVER (PARTITION BY lower(trim(parent_id)) ORDER BY CAST(created_at AS TIMESTAMPTZ), k) AS INTEGER) place FROM ta WHERE trim(parent_id) <> ''""")
def win_siblings(spark, folder):
    """The place of each task among its siblings by creation. A hot parent's children are placed in two steps: by day, then inside a day."""
    t = graph.current_tasks(table(spark, folder, "tasks")).select("task_id", "k", key_of(F.col("parent_id")).alias("parent"), instant(F.col("created_at")).alias("at")).where("parent IS NOT NULL").withColumn("day", F.to_date("at"))
    days = t.groupBy("parent", "day").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(W.partitionBy("parent").orderBy("day").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = days.select("parent", "day", before.alias("before"))
    inner = F.row_number().over(W.partitionBy("parent", "day").orderBy("at", "k"))
    return t.withColumn("i", inner).join(starts, ["parent", "day"]).select("task_id", "parent", (F.col("before") + F.col("i")).cast("int").alias("place"))


_SUBTREES = """pl AS (SELECT ln.*, row_number() OVER (PARTITION BY parent ORDER BY CAST(created_at AS TIMESTAMPTZ), k) place FROM ln WHERE k IN (SELECT k FROM tr)),
st AS (SELECT k AS "start", k, 0 AS "level", CAST([] AS BIGINT[]) p FROM pl UNION ALL SELECT st."start", c.k, st."level" + 1, list_append(st.p, c.place) FROM st JOIN pl c ON c.parent = st.k WHERE st."level" < 4),
sh AS (SELECT "start", k, "level", row_number() OVER (PARTITION BY "start" ORDER BY "level", p) AS "place" FROM st)"""


def _sets(spark, folder) -> DataFrame:
    """The nested sets of all tasks, siblings by creation."""
    nodes, tasks = _task_tree(spark, folder)
    at = tasks.select("k", instant(F.col("created_at")).alias("at"))
    return cut(hierarchy.nested_sets(nodes.select("src", "k", "id", F.col("parent").alias("p")).join(at, "k").select("src", "k", "id", "p", "at")), "task-sets")


@query(f"""WITH RECURSIVE {TA}, {_TREE}, {_SUBTREES} SELECT "start", k node, CAST("level" AS INTEGER) AS "level", CAST("place" AS INTEGER) AS "place" FROM sh WHERE "place" <= 200""")
def gr_subtrees(spark, folder):
    """Of every task its subtree level by level: five levels and 200 tasks at most, as far as they go."""
    return hierarchy.subtrees(_sets(spark, folder)).select("start", F.col("k").alias("node"), "level", "place")


@query(f"""WITH RECURSIVE {TA}, {_TREE}, {_SUBTREES}, n AS (SELECT anc k, count(*) n FROM pairs GROUP BY anc), c AS (SELECT "start" k, count(*) FILTER ("place" <= 200) shown FROM sh GROUP BY 1), r AS (SELECT k, up[1] root FROM tr)
SELECT r.k node, shown, n.n - shown AS "hidden", t.n in_tree FROM r JOIN n USING (k) JOIN c USING (k) JOIN n t ON t.k = r.root""")
def gr_truncations(spark, folder):
    """How many tasks of each subtree its listing shows and leaves out, and how many the whole tree has."""
    sets = _sets(spark, folder)
    return hierarchy.truncations(sets, hierarchy.subtrees(sets)).select(F.col("k").alias("node"), "shown", "hidden", "in_tree")


_CHOSEN = "CAST('0x' || substr(md5({k}), 1, 7) AS BIGINT) % 50 = 0"


@query(f"""WITH RECURSIVE {TA}, {_TREE} SELECT anc ancestor, k node, CAST(len(up) - 1 AS INTEGER) AS "depth" FROM (SELECT k, up, unnest(up) anc FROM tr) WHERE k <> anc AND {_CHOSEN.format(k="anc")}""")
def gr_descendants(spark, folder):
    """All tasks below the tasks whose key's hash is divisible by 50, by their ranges."""
    sets = _sets(spark, folder)
    return hierarchy.descendants_of(sets, sets.where(_chosen("k"))).select("ancestor", F.col("k").alias("node"), F.col("depth").cast("int").alias("depth"))


def _chosen(key: str):
    return F.conv(F.substring(F.md5(F.col(key)), 1, 7), 16, 10).cast("bigint") % 50 == 0


@query(f"WITH {ED}, p AS (SELECT DISTINCT project_id, type, b a, a b FROM ed WHERE type IN ('related_to', 'references')) SELECT * FROM p ANTI JOIN ed USING (project_id, type, a, b)")
def set_new_edges(spark, folder):
    """The reverses of symmetric relationships that don't stand yet."""
    e = _edges(spark, folder)
    proposed = e.where("type IN ('related_to', 'references')").select("project_id", "type", F.col("b").alias("a"), F.col("a").alias("b"))
    return graph.new_edges(e, proposed)


@query(f"""WITH {ED}, {TA}, r AS (SELECT k FROM ta WHERE status = 'done'), n AS (SELECT k a, lower(trim(parent_id)) b FROM ta WHERE trim(parent_id) <> '' AND status = 'done')
SELECT a, b FROM ed WHERE type = 'task_depends_on' AND a NOT IN (SELECT k FROM r) UNION SELECT a, b FROM n""")
def set_what_if(spark, folder):
    """The dependencies if those of finished tasks were replaced by one on their parent."""
    tasks = graph.current_tasks(table(spark, folder, "tasks")).where("status = 'done'")
    e = _edges(spark, folder).where("type = 'task_depends_on'")
    return graph.what_if(e, tasks.select(F.col("k").alias("node")), tasks.select(F.col("k").alias("a"), key_of(F.col("parent_id")).alias("b")).where("b IS NOT NULL"))


@query(f"""WITH {TA}, {KB}, i AS (SELECT k, unnest(json_extract_string(context_doc_ids, '$[*]')) id FROM ta WHERE json_valid(context_doc_ids)), l AS (SELECT *, lower(trim(id)) d FROM i WHERE trim(id) <> '')
SELECT ta.task_id, count(DISTINCT d) named, count(DISTINCT lower(trim(kb.doc_id))) FILTER (kb.status <> 'superseded') live FROM l JOIN ta USING (k) LEFT JOIN kb ON lower(trim(kb.doc_id)) = d GROUP BY ta.task_id""")
def jn_task_context(spark, folder):
    """The documents that each task names in its JSON list, and how many of them are live; malformed lists name none."""
    latest = table(spark, folder, "tasks").groupBy(key_of(F.col("task_id")).alias("k")).agg(F.max_by(F.struct("task_id", "context_doc_ids"), instant(F.col("updated_at"))).alias("t"))
    named = latest.select("t.task_id", F.explode(F.from_json("t.context_doc_ids", "array<string>")).alias("id")).select("task_id", key_of(F.col("id")).alias("d")).where("d IS NOT NULL").distinct()
    live = _kb(spark, folder).where("status <> 'superseded'").select(key_of(F.col("doc_id")).alias("d"), F.lit(1).alias("live")).distinct()
    return named.join(live, "d", "left").groupBy("task_id").agg(F.count("*").alias("named"), F.count("live").alias("live"))


@query(f"""WITH {AL}, {TA}, m AS (SELECT lower(trim(target_id)) k, arg_max(action, (CAST(created_at AS TIMESTAMPTZ), log_id)) AS "action", arg_max(TRY_CAST(metadata->>'count' AS BIGINT), (CAST(created_at AS TIMESTAMPTZ), log_id)) n
FROM al WHERE target_type = 'task' AND trim(target_id) <> '' AND TRY_CAST(metadata->>'count' AS BIGINT) IS NOT NULL GROUP BY 1) SELECT task_id, m.action, n FROM ta LEFT JOIN m USING (k)""")
def jn_task_log(spark, folder):
    """Each task with the last of its logged JSON objects, looked up by the id they name."""
    log = _once(spark, folder, "activity_log", "log_id").where("target_type = 'task'")
    log = log.select(key_of(F.col("target_id")).alias("k"), "action", F.from_json("metadata", "count bigint")["count"].alias("n"), instant(F.col("created_at")).alias("at"), "log_id").where("k IS NOT NULL AND n IS NOT NULL")
    last = log.groupBy("k").agg(F.max_by(F.struct("action", "n"), F.struct("at", "log_id")).alias("x"))
    return graph.current_tasks(table(spark, folder, "tasks")).select("k", "task_id").join(last, "k", "left").select("task_id", "x.action", "x.n")


@query(f"""WITH {KB}, {CO}, {TA}, i AS (SELECT k, unnest(json_extract_string(context_doc_ids, '$[*]')) id FROM ta WHERE json_valid(context_doc_ids)), q AS (SELECT DISTINCT lower(trim(id)) k FROM i WHERE trim(id) <> ''
UNION SELECT lower(trim(chunk_id)) FROM co WHERE {_CHOSEN.format(k="chunk_id")})
SELECT q.k requested, coalesce(co.chunk_id, '') chunk_id FROM q LEFT JOIN co ON lower(trim(co.chunk_id)) = q.k WHERE q.k NOT IN (SELECT lower(trim(doc_id)) FROM kb WHERE status <> 'superseded')""")
def set_requested_chunks(spark, folder):
    """Requested ids (those that tasks name, and some chunks') that are no live document, looked up among code chunks."""
    lists = table(spark, folder, "tasks").groupBy(key_of(F.col("task_id")).alias("k")).agg(F.max_by("context_doc_ids", instant(F.col("updated_at"))).alias("ids"))
    chunks = table(spark, folder, "code_chunks").select("chunk_id").distinct().select("chunk_id", key_of(F.col("chunk_id")).alias("requested"))
    asked = lists.select(F.explode(F.from_json("ids", "array<string>")).alias("id")).select(key_of(F.col("id")).alias("requested")).unionByName(chunks.where(_chosen("chunk_id")).select("requested")).where("requested IS NOT NULL").distinct()
    live = _kb(spark, folder).where("status <> 'superseded'").select(key_of(F.col("doc_id")).alias("requested"))
    return asked.join(live, "requested", "left_anti").join(chunks, "requested", "left").select("requested", F.coalesce("chunk_id", F.lit("")).alias("chunk_id"))


@query(f"""WITH {TA}, t AS (SELECT lower(trim(root_id)) r, * FROM ta) SELECT root.task_id, count(*) tasks, count(*) FILTER (t.status = 'pending') pending, count(*) FILTER (t.status = 'ready') ready,
count(*) FILTER (t.status = 'in_progress') in_progress, count(*) FILTER (t.status = 'review') review, count(*) FILTER (t.status = 'done') done FROM t JOIN ta root ON root.k = t.r GROUP BY root.task_id""")
def agg_stage_histogram(spark, folder):
    """Tasks by state under each stored root."""
    now = graph.current_tasks(table(spark, folder, "tasks"))
    latest = table(spark, folder, "tasks").groupBy(key_of(F.col("task_id")).alias("k")).agg(F.max_by(F.struct("root_id", "status"), instant(F.col("updated_at"))).alias("t"))
    t = latest.select(key_of(F.col("t.root_id")).alias("k"), "t.status").groupBy("k").agg(F.count("*").alias("tasks"), *[F.count_if(F.col("status") == s).alias(s) for s in ("pending", "ready", "in_progress", "review", "done")])
    return t.join(now.select("k", "task_id"), "k").drop("k")


# -- context

_CAND = """cand AS (SELECT project_id, 'document' kind, doc_id id, CAST(ceil(length(content) / 4) AS INTEGER) tokens, (CASE WHEN priority IS NULL THEN 0.5::DOUBLE ELSE greatest(0, least(1, 1 - priority / 10)) END) * 1.5 score, coalesce(priority, 999) priority, CAST(updated_at AS TIMESTAMPTZ) updated FROM kb WHERE status <> 'superseded' AND category <> 'code_file'
UNION ALL SELECT project_id, 'code', chunk_id, CAST(ceil(length(content) / 4) AS INTEGER), 0.5::DOUBLE * 1.5, 999, CAST(created_at AS TIMESTAMPTZ) FROM co),
top AS (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY score DESC, kind DESC, priority, updated DESC, id) place FROM cand)"""


def _counted(spark, folder) -> tuple[DataFrame, DataFrame]:
    """Current documents and code chunks with their tokens, counted where they are read, so that no contents are shuffled."""
    sized = lambda name, *kept: table(spark, folder, name).select(*kept, T.token_estimate(F.col("content")).alias("tokens"))
    kb = sized("kb_documents", "doc_id", "version", "project_id", "title", "category", "status", "priority", "updated_at")
    return R.current(kb, "doc_id", rank=F.col("version")), R.current(sized("code_chunks", "chunk_id", "project_id", "created_at"), "chunk_id")


@query(f"""WITH RECURSIVE {KB}, {CO}, {_CAND}, fill AS (SELECT project_id, CAST(0 AS BIGINT) place, CAST(0 AS BIGINT) used, '' kind, '' id, 0 tokens, false taken FROM (SELECT DISTINCT project_id FROM top) UNION ALL
SELECT t.project_id, t.place, CASE WHEN used + t.tokens <= 4000 THEN used + t.tokens ELSE used END, t.kind, t.id, t.tokens, used + t.tokens <= 4000 FROM fill f JOIN top t ON t.project_id = f.project_id AND t.place = f.place + 1)
SELECT project_id, CAST(place AS INTEGER) place, kind, id, tokens, CAST(used AS INTEGER) used FROM fill WHERE taken""")
def ctx_overview(spark, folder):
    """Each project's best documents and code under a budget of tokens; what doesn't fit is skipped."""
    return context.budget_fill(context.candidates(*_counted(spark, folder)), 4000)


@query()
def ctx_detailed(spark, folder):
    """For every live document and every code chunk as a request: itself and its related documents under a budget."""
    kb, code = _counted(spark, folder)
    kb = kb.withColumn("k", key_of(F.col("doc_id")))
    asked = kb.where("status <> 'superseded'").select("project_id", "k").unionByName(code.select("project_id", key_of(F.col("chunk_id")).alias("k"))).where("k IS NOT NULL").distinct()
    near = graph.best_relation(graph.neighbours(_edges(spark, folder), kb))
    return context.detailed(asked.withColumn("request", F.col("k")), kb, near, 4000, code, ("project_id", "request"))


# -- ingestion


@query(f"""WITH {KB} SELECT doc_id, CAST(i AS INTEGER) chunk_index, substr(coalesce(content, ''), i * 1800 + 1, 2000) AS "content" FROM (SELECT *, unnest(range(0, CAST(greatest(0, ceil((length(coalesce(content, '')) - 2000) / 1800)) AS BIGINT) + 1)) i FROM kb)""")
def txt_fixed_chunks(spark, folder):
    """Every document in overlapping windows."""
    return ingest.fixed_chunks(_kb(spark, folder), ["doc_id"])


#: Paragraphs folded one by one into chunks, as a recursion over their places.
_PARAGRAPHS = """pa AS (SELECT doc_id, title, category, string_split_regex(coalesce(content, ''), '\\n\\n+') ps FROM kb),
pk AS (SELECT doc_id, title, ps, 1 i, ps[1] now, CAST(NULL AS VARCHAR) done, 0 n FROM pa UNION ALL
SELECT doc_id, title, ps, i + 1, CASE WHEN length(now) + length(ps[i + 1]) + 2 > 2000 AND now <> '' THEN right(now, 200) || chr(10) || chr(10) || ps[i + 1] WHEN now = '' THEN ps[i + 1] ELSE now || chr(10) || chr(10) || ps[i + 1] END,
CASE WHEN length(now) + length(ps[i + 1]) + 2 > 2000 AND now <> '' THEN now END, n + CASE WHEN length(now) + length(ps[i + 1]) + 2 > 2000 AND now <> '' THEN 1 ELSE 0 END FROM pk WHERE i < len(ps)),
pc AS (SELECT doc_id, title, n - 1 AS chunk_index, trim(done) AS "content" FROM pk WHERE done IS NOT NULL UNION ALL SELECT doc_id, title, n, trim(now) FROM pk WHERE i = len(ps) AND trim(now) <> ''),
hd AS (SELECT *, coalesce(nullif(trim(regexp_extract("content", '(?m)^#{1,6}\\s+([^\\r\\n]+)', 1)), ''), title) AS "header" FROM pc),
fu AS (SELECT doc_id, CAST(chunk_index AS INTEGER) chunk_index, "header", 'Document: ' || title || ' | Section: ' || "header" || chr(10) || chr(10) || "content" full_text FROM hd)"""


@query(f"WITH RECURSIVE {KB}, {_PARAGRAPHS} SELECT *, CAST(ceil(length(full_text) / 4) AS INTEGER) token_count FROM fu")
def txt_paragraph_chunks(spark, folder):
    """Every document in packed paragraphs, with header, prefix and tokens."""
    return ingest.decorated(ingest.paragraph_chunks(_kb(spark, folder), ["doc_id", "title"])).select("doc_id", "chunk_index", "header", "full_text", "token_count")


@query()
def txt_document_chunks(spark, folder):
    """Every document in the chunks of its category's strategy, with header, prefix and tokens."""
    return ingest.decorated(ingest.document_chunks(_kb(spark, folder), ["doc_id", "title"])).select("doc_id", "chunk_index", "header", "full_text", "token_count")


@query(f"""WITH {KB}, f AS (SELECT doc_id path, coalesce(content, '') c, list_extract(string_split(doc_id, '/'), -1) name FROM kb WHERE category = 'code_file')
SELECT path, sha256(c) hash, CAST(len(string_split(c, chr(10))) AS INTEGER) lines, regexp_matches(name, '\\.(test|spec)\\.|^test_|_test\\.') is_test, regexp_extract(name, '\\.([^.]+)$', 1) AS "extension" FROM f""")
def src_manifest(spark, folder):
    """Hash, lines, extension and kind of every code file."""
    return ingest.manifest(_kb(spark, folder).where("category = 'code_file'"), "doc_id", "content")


@query("""WITH a AS (SELECT DISTINCT doc_id path, sha256(coalesce(content, '')) hash FROM kb_documents WHERE category = 'code_file' AND version = 1),
b AS (SELECT doc_id path, sha256(coalesce(content, '')) hash FROM (SELECT DISTINCT ON (doc_id) * FROM kb_documents WHERE category = 'code_file' ORDER BY doc_id, version DESC)),
c AS (SELECT DISTINCT file_path path FROM code_chunks), o AS (SELECT a.* FROM a WHERE path IN (SELECT path FROM c))
SELECT path, CASE WHEN o.path IS NULL THEN 'new' WHEN b.path IS NULL THEN 'deleted' WHEN o.hash = b.hash THEN 'same' ELSE 'changed' END "change" FROM o FULL JOIN b USING (path)""")
def jn_file_changes(spark, folder):
    """Code files now against the first versions of those that were chunked: new, changed, same or deleted."""
    kb = table(spark, folder, "kb_documents").where("category = 'code_file'")
    hashed = lambda df: df.select(F.col("doc_id").alias("path"), F.sha2(F.coalesce("content", F.lit("")), 256).alias("hash"))
    seen = table(spark, folder, "code_chunks").select(F.col("file_path").alias("path")).distinct()
    old = hashed(kb.where("version = 1")).distinct().join(seen, "path", "left_semi")
    return ingest.changes(old, hashed(R.current(kb, "doc_id", rank=F.col("version"))))


@query(f"""WITH {KB}, l AS (SELECT doc_id, string_split(coalesce(content, ''), chr(10)) ls FROM kb WHERE category <> 'code_file'),
n AS (SELECT *, CASE WHEN len(ls) > 40 THEN CAST(ceil((len(ls) - 4) / 36) AS INTEGER) ELSE 1 END parts FROM l), e AS (SELECT *, unnest(range(1, parts + 1)) part FROM n)
SELECT doc_id, CAST(part AS INTEGER) part, parts, CAST((part - 1) * 36 + 1 AS INTEGER) first_line, array_to_string(CASE WHEN parts = 1 THEN ls ELSE ls[(part - 1) * 36 + 1:(part - 1) * 36 + 40] END, chr(10)) AS "content" FROM e""")
def txt_line_parts(spark, folder):
    """Documents of more than 40 lines in overlapping parts."""
    return ingest.line_parts(_kb(spark, folder).where("category <> 'code_file'"), ["doc_id"], size=40, overlap=4)


@query()
def txt_symbols(spark, folder):
    """The symbols that every code chunk defines, with scope and lines."""
    return S.symbols(_code(spark, folder), "chunk_id", "file_path").drop("content")


@query()
def txt_symbol_parts(spark, folder):
    """The same with their text behind a line of context, those of more than 200 lines in overlapping parts."""
    return ingest.symbol_parts(S.symbols(_code(spark, folder), "chunk_id", "file_path"), "chunk_id")


@query()
def txt_file_links(spark, folder):
    """What every code chunk's text imports and exports, a row each, in order."""
    found = S.outlines(_code(spark, folder), "chunk_id", "file_path").select("chunk_id", F.explode(F.array(*[F.struct(F.lit(c).alias("fld"), F.col(c).alias("v")) for c in ("imports", "exports")])).alias("x"))
    return found.select("chunk_id", "x.fld", F.posexplode("x.v").alias("pos", "val"))


@query()
def gr_import_edges(spark, folder):
    """Edges between files from the imports of all code chunks."""
    code = table(spark, folder, "code_chunks")
    values = split_packed(packed_fields(table(spark, folder, "kb_documents").where("false"), code).where("fld = 'imports'")).select(F.col("record_id").alias("chunk_id"), F.col("val").alias("import"))
    of = _code(spark, folder).select("chunk_id", "project_id", "file_path", C.language_of(F.col("file_path")).alias("language"))
    imports = values.join(of, "chunk_id").select("project_id", "file_path", "language", "import")
    files = table(spark, folder, "kb_documents").where("category = 'code_file'").select("project_id", F.col("doc_id").alias("path")).unionByName(of.select("project_id", F.col("file_path").alias("path")))
    return C.import_edges(imports, files)


@query(r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) line FROM documents WHERE source = 'commit_log'),
p AS (SELECT doc_id, regexp_extract(line, '^[0-9a-f]{7} (\w+)(\([^)]*\))?: ', 1) t, regexp_extract(line, '^[0-9a-f]{7} \w+\(([^)]*)\): ', 1) s, line FROM l)
SELECT t AS "type", s "scope", count(*) commits, count(DISTINCT doc_id) documents, CAST(max(length(line)) AS INTEGER) longest FROM p WHERE t <> '' GROUP BY ALL""")
def txt_commit_messages(spark, folder):
    """Conventional commit lines by type and scope."""
    lines = table(spark, folder, "documents").where("source = 'commit_log'").select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    p = lines.select("doc_id", "line", F.regexp_extract("line", r"^[0-9a-f]{7} (\w+)(\([^)]*\))?: ", 1).alias("type"), F.regexp_extract("line", r"^[0-9a-f]{7} \w+\(([^)]*)\): ", 1).alias("scope"))
    return p.where("type <> ''").groupBy("type", "scope").agg(F.count("*").alias("commits"), F.countDistinct("doc_id").alias("documents"), F.max(F.char_length("line")).alias("longest"))


#: The types of a conventional commit line.
_TYPES = ["feat", "fix", "refactor", "test", "docs", "chore", "style", "perf", "ci", "build"]


@query(rf"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) line FROM documents WHERE source = 'commit_log'), m AS (SELECT doc_id, regexp_extract(line, '^[0-9a-f]{{7}} (.*)$', 1) m FROM l WHERE regexp_matches(line, '^[0-9a-f]{{7}} ')),
r AS (SELECT doc_id, CASE WHEN regexp_matches(m, '(?i)\[task:[^\]]+\]') THEN 'task' WHEN length(m) > 72 THEN 'length' WHEN NOT regexp_matches(m, '^[a-z]+\([a-z0-9][a-z0-9-]*\): .+$') THEN 'form'
WHEN regexp_extract(m, '^([a-z]+)', 1) NOT IN ({", ".join(f"'{t}'" for t in _TYPES)}) THEN 'type' ELSE 'valid' END verdict FROM m) SELECT verdict, count(*) commits, count(DISTINCT doc_id) documents FROM r GROUP BY verdict""")
def txt_commit_verdicts(spark, folder):
    """Commit lines by the first rule they break: a task reference, over 72 characters, another form, an unknown type."""
    lines = table(spark, folder, "documents").where("source = 'commit_log'").select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    m = lines.where(F.col("line").rlike("^[0-9a-f]{7} ")).select("doc_id", F.regexp_extract("line", "^[0-9a-f]{7} (.*)$", 1).alias("m"))
    verdict = (
        F.when(F.col("m").rlike(r"(?i)\[task:[^\]]+\]"), "task").when(F.char_length("m") > 72, "length").when(~F.col("m").rlike(r"^[a-z]+\([a-z0-9][a-z0-9-]*\): .+$"), "form")
        .when(~F.regexp_extract("m", "^([a-z]+)", 1).isin(_TYPES), "type").otherwise("valid")
    )
    return m.groupBy(verdict.alias("verdict")).agg(F.count("*").alias("commits"), F.countDistinct("doc_id").alias("documents"))


@query("""WITH m AS (SELECT DISTINCT ON (project_id) project_id, TRY_CAST(settings AS JSON) s FROM project_meta ORDER BY project_id) SELECT project_id, len(json_keys(s)) slots, len(list_filter(json_keys(s), lambda k: json_extract_string(s, k) IS NOT NULL)) filled FROM m WHERE s IS NOT NULL""")
def txt_setting_slots(spark, folder):
    """How many slots the settings of each project have and how many are filled; what isn't an object has none."""
    m = table(spark, folder, "project_meta").dropDuplicates(["project_id"]).select("project_id", F.from_json("settings", "map<string,string>").alias("s")).where("s IS NOT NULL")
    return m.select("project_id", F.size("s").alias("slots"), F.size(F.filter(F.map_values("s"), lambda v: v.isNotNull())).alias("filled"))


@query(f"""WITH RECURSIVE {TA}, ln AS (SELECT a.*, b.k parent FROM ta a LEFT JOIN ta b ON lower(trim(a.parent_id)) = b.k),
tr AS (SELECT k, task_id top, 0 d FROM ln WHERE parent IS NULL UNION ALL SELECT c.k, t.top, t.d + 1 FROM tr t JOIN ln c ON c.parent = t.k)
SELECT task_id, depth stored_depth, CAST(d AS INTEGER) true_depth, root_id stored_root, top true_root FROM tr JOIN ta USING (k) WHERE depth IS DISTINCT FROM d OR lower(trim(root_id)) IS DISTINCT FROM lower(top)""")
def gr_wrong_depths(spark, folder):
    """Tasks whose stored depth or root isn't that of the tree."""
    tasks = table(spark, folder, "tasks")
    nodes = hierarchy.node_rows(tasks, "tasks", "task_id", "parent_id", instant(F.col("updated_at")))
    stored = tasks.groupBy(key_of(F.col("task_id")).alias("k")).agg(F.max_by(F.struct("depth", "root_id"), instant(F.col("updated_at"))).alias("t"))
    true = hierarchy.nested_sets(nodes).where("root IS NOT NULL").select("k", F.col("id").alias("task_id"), F.col("depth").cast("int").alias("true_depth"), F.col("top").alias("true_root"))
    both = true.join(stored, "k").select("task_id", F.col("t.depth").alias("stored_depth"), "true_depth", F.col("t.root_id").alias("stored_root"), "true_root")
    same = F.col("stored_depth").eqNullSafe(F.col("true_depth")) & key_of(F.col("stored_root")).eqNullSafe(key_of(F.col("true_root")))
    return both.where(~same)


@query(f"""WITH {TA} SELECT project_id, count(*) flagged FROM ta WHERE regexp_matches(coalesce(block_reason, '') || ' ' || coalesce(description, ''), '(?i)failing|retr(y|ies)|is (missing|stale)') GROUP BY project_id""")
def txt_flagged_notes(spark, folder):
    """Tasks of each project whose notes speak of trouble."""
    tasks = R.current(table(spark, folder, "tasks").withColumn("k", key_of(F.col("task_id"))), "k", rank=instant(F.col("updated_at")))
    notes = F.concat(F.coalesce("block_reason", F.lit("")), F.lit(" "), F.coalesce("description", F.lit("")))
    return tasks.where(notes.rlike("(?i)failing|retr(y|ies)|is (missing|stale)")).groupBy("project_id").agg(F.count("*").alias("flagged"))


@query("""SELECT k AS "key", count(*) AS "rows", count(DISTINCT v) AS "values" FROM (SELECT unnest(json_keys(props)) k, props FROM events WHERE json_valid(props)), LATERAL (SELECT json_extract_string(props, '$."' || k || '"') v) GROUP BY k""")
def txt_json_maps(spark, folder):
    """The keys of open-shaped JSON objects, with how many rows and values each has."""
    parsed = table(spark, folder, "events").select(F.explode(F.from_json("props", "map<string,string>")).alias("key", "v"))
    return parsed.groupBy("key").agg(F.count("*").alias("rows"), F.countDistinct("v").alias("values"))


@query(f"""WITH {CO} SELECT chunk_id, file_path, symbol_name FROM co WHERE project_id = (SELECT project_id FROM code_chunks GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) AND lower(trim(language)) = 'typescript' AND symbol_type = 'function' AND file_path LIKE '%/src/%' ESCAPE '\\'""")
def flt_code(spark, folder):
    """The code chunks of the project that has most, by language, symbol type and glob together."""
    code = table(spark, folder, "code_chunks")
    most = code.groupBy("project_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "project_id").first()
    hit = code.where((F.col("project_id") == (most["project_id"] if most else None)) & (F.lower(trimmed(F.col("language"))) == "typescript") & (F.col("symbol_type") == "function") & F.col("file_path").like(T.glob_to_like("**/src/**")))
    return R.current(hit.select("chunk_id", "file_path", "symbol_name"), "chunk_id")


@query(f"""WITH {DE}, p AS (SELECT project_id, tier, tier_name, count(*) n FROM de GROUP BY ALL) SELECT project_id, tier, CASE tier WHEN 0 THEN 'product_strategy' WHEN 1 THEN 'architecture' WHEN 2 THEN 'functional_design' WHEN 3 THEN 'execution' END expected_name, tier_name, n FROM p""")
def prj_tier_names(spark, folder):
    """Decisions by tier, with the name that belongs to the tier beside the stored one."""
    names = F.create_map(*[F.lit(x) for kv in {0: "product_strategy", 1: "architecture", 2: "functional_design", 3: "execution"}.items() for x in kv])
    d = _once(spark, folder, "decisions", "decision_id").groupBy("project_id", "tier", "tier_name").agg(F.count("*").alias("n"))
    return d.select("project_id", "tier", names[F.col("tier")].alias("expected_name"), "tier_name", "n")
