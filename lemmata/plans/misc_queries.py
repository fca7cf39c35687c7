"""Queries over extraction, sequences, constants, the live corpus and event streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lemmata.functions import columns as C
from lemmata.functions import extract as X
from lemmata.operators import etl, numeric, sequence
from lemmata.plans import api
from lemmata.plans.text_queries import _strip
from lemmata.plans.runtime import shared_folder, table
from lemmata.streaming import live


def extract_envs(s: SparkSession, d: str) -> DataFrame:
    """Statements written as LaTeX environments and taken out again."""
    t = table(s, d, "corpus").filter("trim(statement) <> ''")
    tex = F.concat(F.lit("\\newtheorem{satz}{Satz}\n\\begin{satz}["), F.coalesce("name", F.lit("")), F.lit("]\\label{"), F.coalesce("label", F.lit("")), F.lit("} "), F.col("statement"), F.lit("\n\\end{satz}"))
    return X.table_function(t.select("doc_id", tex.alias("tex")), "doc_id", "tex", "env string, name string, label string, body string", X.environments)


def env_kinds(s: SparkSession, d: str) -> DataFrame:
    """Environments in the statements, with built-in expressions only."""
    t = table(s, d, "corpus").select(F.explode(F.regexp_extract_all("statement", F.lit(r"\\begin\{([a-z]+)\}"), 1)).alias("env"))
    return t.groupBy("env").agg(F.count("*").alias("n"))


def lean_decls(s: SparkSession, d: str) -> DataFrame:
    """Formal sources made of the records, and their declarations."""
    src = F.concat(F.lit("/-- "), F.coalesce("slogan", F.lit("")), F.lit(" -/\ntheorem t_"), F.col("row_id").cast("string"), F.lit(" (h : True) :\n  True := by\n  trivial\n\nlemma l_"), F.col("row_id").cast("string"), F.lit(" : 1 = 1 := rfl\n"))
    return X.table_function(table(s, d, "corpus").select("doc_id", src.alias("src")), "doc_id", "src", "kind string, name string, signature string, doc string", X.declarations)


def wiki_sections(s: SparkSession, d: str) -> DataFrame:
    t = table(s, d, "corpus")
    return t.select("doc_id", F.md5(X.wiki_statement(F.col("statement"))).alias("section"), F.array_join(X.wiki_categories(F.col("statement")), "|").alias("categories"))


def checklist(s: SparkSession, d: str) -> DataFrame:
    return api.applicability_checklist(table(s, d, "corpus"))


def problem_signature(s: SparkSession, d: str) -> DataFrame:
    t = table(s, d, "queries")
    return t.select("query_id", X.need(F.col("query")).alias("need"), F.array_join(X.objects(F.col("query")), "|").alias("objects"))


def problem_givens(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "corpus").select("doc_id", F.coalesce(F.array_size(X.givens(F.col("statement"))), F.lit(0)).alias("n"))


def mapping(s: SparkSession, d: str) -> DataFrame:
    """Scaffolds of every query with its best re-ranked record."""
    c = table(s, d, "candidates").filter("channel = 'rerank' AND NOT isnan(score)").groupBy("query_id").agg(F.max_by("doc_id", F.struct("score", "doc_id")).alias("doc_id"))
    cand = c.join(table(s, d, "corpus").select("doc_id", "statement"), "doc_id")
    return api.mapping_scaffold(table(s, d, "queries").select("query_id", F.col("query").alias("problem")), cand)


def domain_scores(s: SparkSession, d: str) -> DataFrame:
    return X.domain_scores(table(s, d, "queries"), "query_id", "query").select("query_id", "domain", "score")


def search_directives(s: SparkSession, d: str) -> DataFrame:
    return X.directives(table(s, d, "queries"), "query_id", "query")


def input_router(s: SparkSession, d: str) -> DataFrame:
    """Queries and the texts of citations, by what kind of input they are."""
    t = table(s, d, "queries").select(F.col("query").alias("x")).unionByName(table(s, d, "corpus").select(F.col("citations").alias("x")))
    return t.filter("x IS NOT NULL").groupBy(X.input_kind(F.col("x")).alias("kind")).agg(F.count("*").alias("n"))


def json_props(s: SparkSession, d: str) -> DataFrame:
    """Objects out of fenced text (X11)."""
    text = F.concat(F.lit("Answer:\n```json\n"), F.col("props"), F.lit("\n```"))
    return table(s, d, "events").select("event_id", X.json_object(text, "k bigint")["k"].alias("k")).filter("k IS NOT NULL")


def _sequences(s: SparkSession, d: str) -> DataFrame:
    """The quantities of an order, by line, stand for a sequence."""
    t = table(s, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", F.col("l_quantity").cast("bigint").cast("string").alias("q")))).alias("x"))
    return t.select(F.format_string("A%09d", "l_orderkey").alias("a_number"), "l_orderkey", F.transform("x", lambda v: v["q"]).alias("terms"))


def ngram_index(s: SparkSession, d: str) -> DataFrame:
    return sequence.windows(_sequences(s, d))


def sequence_match(s: SparkSession, d: str) -> DataFrame:
    """The sequences whose order is divisible by 20, without their first term, against all."""
    t = _sequences(s, d)
    q = t.filter("l_orderkey % 20 = 0 AND size(terms) >= 5").select(F.col("l_orderkey").alias("query_id"), F.slice("terms", 2, 100).alias("terms"))
    return sequence.match(q, t.select("a_number", "terms"))


GOLD = ["3.14159265358979323846264338327950288", "2.71828182845904523536028747135266250", "2.61803398874989484820458683436563812", "3.14626436994197234232913506571557045", "1.64493406684822643647241516664602519", "0.33333333333333333333333333333333333", "0.62345678901928374655647382910238477"]


def identify_constant(s: SparkSession, d: str) -> DataFrame:
    """Known constants and one without structure."""
    return numeric.identify(s.createDataFrame(list(enumerate(GOLD)), "id int, value string"))


def verify_numeric(s: SparkSession, d: str) -> DataFrame:
    claims = [(GOLD[0], "4*pi/4"), (GOLD[2], "(3+sqrt(5))/2"), (GOLD[4], "pi**2/6"), (GOLD[4], "pi**2/7"), (GOLD[6], "1/0")]
    return api.verify_numeric(s.createDataFrame(claims, "value string, expr string"))


def conjecture_cf(s: SparkSession, d: str) -> DataFrame:
    """The golden ratio from the whole grid of continued fractions."""
    return numeric.conjecture(s, "1.61803398874989484820458683436563811772030917980576")


def add_findings(s: SparkSession, d: str) -> DataFrame:
    """Findings that pass validation, and how many there are by source (L1)."""
    return live.validated(table(s, d, "findings"), dims=16).select("doc_id", "source", "added_ts", "dense").distinct()


def stream_append(s: SparkSession, d: str) -> DataFrame:
    """Findings through the landing folder and the stream, twice: the second run takes nothing again."""
    import uuid

    base = f"{shared_folder(s)}/live-{uuid.uuid4().hex}"
    live.land(table(s, d, "findings"), f"{base}/landing", dims=16)
    for _ in range(2):
        live.ingest(s, f"{base}/landing", f"{base}/table", f"{base}/checkpoint")
    return s.read.parquet(f"{base}/table").groupBy("doc_id").agg(F.count("*").alias("n"))


def findings_snapshot_age(s: SparkSession, d: str) -> DataFrame:
    """A cache of findings: a week old at most at the time of the newest, the newest 200."""
    t = table(s, d, "findings").select(F.col("doc_id").alias("key"), "added_ts").distinct()
    now = t.agg(F.max("added_ts")).first()[0]
    return live.cached(t, now or 0.0)


def _events(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def events_tumbling(s: SparkSession, d: str) -> DataFrame:
    t = live.event_stream_counts(_events(s, d))
    return t.select(F.col("window.start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


def events_session(s: SparkSession, d: str) -> DataFrame:
    t = _events(s, d).groupBy(F.session_window("ts", "30 minutes"), "user_id").agg(F.count("*").alias("n"))
    return t.select("user_id", F.col("session_window.start").cast("timestamp_ntz").alias("start"), "n")


def program_elites(s: SparkSession, d: str) -> DataFrame:
    """The best of all cells as well as of each."""
    e = etl.elites(table(s, d, "events"))
    return e.agg(F.count("*").alias("cells"), F.max("value").alias("best"))


def few_shot(s: SparkSession, d: str) -> DataFrame:
    e = table(s, d, "events")
    return etl.few_shot(etl.elites(e), e.select("event_id", F.col("props").alias("text")))


def relation_search(s: SparkSession, d: str) -> DataFrame:
    """Constants of the wider basis."""
    gold = ["4.44288293815836624701588099006069", "2.17758609030360213050064098220640", "0.62345678901928374655647382910238"]
    rows = [(v, "; ".join(numeric.relations(v))) for v in gold]
    return s.createDataFrame(rows, "value string, relation string")


def continued_fractions(s: SparkSession, d: str) -> DataFrame:
    """Regular continued fractions of known constants and their patterns."""
    return numeric.fractions(s.createDataFrame(list(enumerate(GOLD)), "id int, value string"))


def module_files(s: SparkSession, d: str) -> DataFrame:
    """Categories as module paths, guillemets around the last part (P25)."""
    m = F.concat(F.lit("Lib."), F.col("category"), F.lit(".«"), F.col("paper_id"), F.lit("»"))
    return table(s, d, "corpus").filter("category <> '' AND paper_id IS NOT NULL").select("doc_id", C.module_file(m).alias("file"))


def import_lists(s: SparkSession, d: str) -> DataFrame:
    src = F.concat(F.lit("import Lib."), F.col("category"), F.lit("\nimport Lib.Basic\n\n"), F.col("statement"))
    return table(s, d, "corpus").filter("category IS NOT NULL").select("doc_id", F.array_join(X.imports(src), "|").alias("imports"))


def transcript_grades(s: SparkSession, d: str) -> DataFrame:
    """Transcripts made of queries and their best record, graded by whether the answer names it."""
    c = table(s, d, "candidates").filter("channel = 'rerank' AND NOT isnan(score)").groupBy("query_id").agg(F.max_by("doc_id", F.struct("score", "doc_id")).alias("doc_id"))
    event = lambda kind, tool, text: F.to_json(F.struct(F.lit(kind).alias("type"), tool.alias("tool"), text.alias("text")))
    none = F.lit(None).cast("string")
    t = table(s, d, "queries").join(c, "query_id").select("query_id", "doc_id", F.concat_ws("\n", event("text", none, F.col("query")), F.lit("{broken"), event("tool_use", F.lit("search"), none), event("text", none, F.concat(F.lit("It is "), F.col("doc_id")))).alias("log"))
    rules = t.select("query_id", F.col("doc_id").alias("pattern"), F.lit(True).alias("required")).unionByName(t.select("query_id", F.lit("unavailable").alias("pattern"), F.lit(False).alias("required")))
    a = X.transcripts(t, "query_id", "log")
    return X.graded(a, "query_id", rules).join(a, "query_id").select("query_id", "passed", F.size("tools").alias("tools"))


def tpch_pricing(s: SparkSession, d: str) -> DataFrame:
    """An extra without parity claim: pushed filter, pruned columns, partial sums."""
    t = table(s, d, "lineitem").filter("l_shipdate <= TIMESTAMP_NTZ '1998-09-02 00:00:00'")
    price = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return t.groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("qty"), F.round(F.sum(price), 2).alias("revenue"), F.count("*").alias("n"))


QUERIES = {
    f.__name__: f
    for f in (extract_envs, env_kinds, lean_decls, wiki_sections, checklist, problem_signature, problem_givens, mapping, domain_scores, search_directives, input_router, json_props, ngram_index, sequence_match, identify_constant, verify_numeric, conjecture_cf, add_findings, stream_append, findings_snapshot_age, events_tumbling, events_session, program_elites, few_shot, relation_search, continued_fractions, module_files, import_lists, transcript_grades, tpch_pricing)
}

_NEED = "CASE " + " ".join(f"WHEN contains(lower(t), '{c}') THEN regexp_replace(substr(t, strpos(lower(t), '{c}')), '\\.+$', '')" for c in X.NEED_CUES) + " ELSE t END"
_CUES = ", ".join("({}, '{}', {}, '{}', {})".format(i, n, str(g).lower(), t.replace("'", "''"), 2 if " " in t or "-" in t else 1) for i, (n, (ts, _, _, g)) in enumerate(X.DOMAINS.items()) for t in ts)
_DOM = f"""WITH c(no, domain, generic, term, weight) AS (VALUES {_CUES}), s AS (SELECT query_id, no, domain, generic, sum(weight) AS score FROM queries, c WHERE contains(lower(query), term) GROUP BY ALL),
b AS (SELECT *, max(score) FILTER (NOT generic) OVER (PARTITION BY query_id) AS best FROM s), f AS (SELECT query_id, no, domain, CAST(score AS BIGINT) AS score FROM b WHERE NOT generic AND score * 2 >= best OR best IS NULL)"""
_RES = ", ".join("('{}', {}, '{}')".format(n, i, r.replace("'", "''")) for n, (_, _, rs, _) in X.DOMAINS.items() for i, r in enumerate(rs))
_SEQ = "s AS (SELECT l_orderkey AS k, printf('A%09d', l_orderkey) AS a_number, list(CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) ORDER BY l_linenumber, CAST(CAST(l_quantity AS BIGINT) AS VARCHAR)) AS terms FROM lineitem GROUP BY l_orderkey)"
_GRAMS = "g AS (SELECT k, a_number, terms, unnest(range(0, len(terms) - 3)) AS pos FROM s WHERE len(terms) >= 4)"

ORACLE_SQL = {
    "env_kinds": r"SELECT env, count(*) AS n FROM (SELECT unnest(regexp_extract_all(statement, '\\begin\{([a-z]+)\}', 1)) AS env FROM corpus) GROUP BY env",
    "problem_signature": f"SELECT query_id, {_NEED} AS need, array_to_string(list_sort(list_distinct(list_filter(regexp_extract_all(query, '[\\p{{L}}\\p{{N}}_]+'), lambda w: regexp_full_match(w, '[A-Z][A-Za-z]{{2,}}'))))[1:8], '|') AS objects FROM (SELECT *, regexp_replace(query, '^[\\s\\p{{Z}}]+|[\\s\\p{{Z}}]+$', '', 'g') AS t FROM queries)",
    "domain_scores": _DOM + " SELECT query_id, domain, score FROM f",
    "search_directives": _DOM + f""", r(domain, pos, result) AS (VALUES {_RES}), t AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, no) AS turn FROM f),
x AS (SELECT query_id, result, min((pos, turn)) AS best FROM t JOIN r USING (domain) GROUP BY ALL), n AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY best) AS n FROM x)
SELECT query_id, string_agg(result, '|' ORDER BY n) AS results FROM n WHERE n <= 8 GROUP BY query_id""",
    "input_router": r"SELECT CASE WHEN regexp_matches(trim(x), '^-?[0-9]+(?:\s*,\s*-?[0-9]+){3,}$') THEN 'sequence' WHEN try_cast(trim(x) AS DOUBLE) IS NOT NULL THEN 'numeric' ELSE 'problem' END AS kind, count(*) AS n FROM (SELECT query AS x FROM queries UNION ALL SELECT citations FROM corpus) WHERE x IS NOT NULL GROUP BY 1",
    "json_props": "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events WHERE json_extract(props, '$.k') IS NOT NULL",
    "ngram_index": f"WITH {_SEQ}, {_GRAMS} SELECT a_number, pos, array_to_string(terms[pos+1:pos+4], ',') AS gram FROM g",
    "sequence_match": f"""WITH {_SEQ}, {_GRAMS}, q AS (SELECT k AS query_id, terms[2:] AS t FROM s WHERE k % 20 = 0 AND len(terms) >= 5),
h AS (SELECT query_id, a_number, min(pos) AS off FROM q JOIN g ON g.terms[pos+1:pos+4] = q.t[1:4] WHERE terms[pos+1:pos+len(t)] = t GROUP BY ALL)
SELECT * FROM (SELECT query_id, a_number, off AS "offset", off = 0 AS exact_prefix, row_number() OVER (PARTITION BY query_id ORDER BY a_number) AS place FROM h) WHERE place <= 5""",
    "stream_append": "SELECT doc_id, count(*) AS n FROM findings WHERE trim(statement) <> '' AND trim(source) <> '' AND (dense_vec IS NULL OR len(dense_vec) = 16) GROUP BY doc_id",
    "wiki_sections": r"""
WITH a AS (SELECT doc_id, statement, trim(regexp_extract(statement, '(?is)==\s*(?:theorem|statement|lemma)\s*==\s*(.*?)(?:\n==|\n?$)', 1), ' ') AS s FROM corpus)
SELECT doc_id, md5(CASE WHEN s <> '' THEN s ELSE trim(substr(statement, 1, 800), ' ') END) AS section, array_to_string(regexp_extract_all(statement, '\[\[Category:([^\]|]+)', 1), '|') AS categories FROM a""",
    "problem_givens": rf"""
WITH a AS (SELECT doc_id, regexp_replace({_strip('statement')}, '([.;])\s+', '\1' || chr(1), 'g') AS s FROM corpus)
SELECT doc_id, CAST(coalesce(len(list_filter(regexp_split_to_array(s, chr(1) || '|,\s+'), lambda x: regexp_matches(lower(trim(x)), '^(?:{'|'.join(X.GIVEN_CUES)})'))), 0) AS INTEGER) AS n FROM a""",
    "add_findings": "SELECT DISTINCT doc_id, source, added_ts, dense_vec IS NOT NULL AS dense FROM findings WHERE trim(statement) <> '' AND trim(source) <> '' AND (dense_vec IS NULL OR len(dense_vec) = 16)",
    "findings_snapshot_age": "SELECT DISTINCT doc_id AS key, added_ts FROM findings WHERE added_ts >= (SELECT max(added_ts) FROM findings) - 604800 ORDER BY added_ts DESC, key LIMIT 200",
    "events_tumbling": "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2",
    "events_session": """WITH a AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 30 MINUTE OR lag(ts) OVER (PARTITION BY user_id ORDER BY ts) IS NULL THEN 1 ELSE 0 END AS new FROM events WHERE ts IS NOT NULL),
b AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts RANGE UNBOUNDED PRECEDING) AS s FROM a) SELECT user_id, min(ts) AS start, count(*) AS n FROM b GROUP BY user_id, s""",
    "program_elites": "SELECT count(*) AS cells, max(m) AS best FROM (SELECT event_type, max(value) AS m FROM events WHERE value IS NOT NULL GROUP BY 1)",
    "module_files": "SELECT doc_id, concat('Lib/', replace(category, '.', '/'), '/', paper_id, '.lean') AS file FROM corpus WHERE category <> '' AND paper_id IS NOT NULL",
    "import_lists": "SELECT doc_id, concat('Lib.', regexp_extract(category, '^(\\S*)', 1), '|Lib.Basic') AS imports FROM corpus WHERE category IS NOT NULL",
    "transcript_grades": "SELECT query_id, true AS passed, 1 AS tools FROM queries WHERE query_id IN (SELECT query_id FROM candidates WHERE channel = 'rerank' AND NOT isnan(score))",
    "tpch_pricing": "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL",
}
