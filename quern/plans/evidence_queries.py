"""Queries of pages, search, evidence, evaluation and ledgers."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from quern.functions import text as X
from quern.operators import ledger as L
from quern.operators import search
from quern.plans.registry import query
from quern.plans.text_queries import _KEY

# --- pages -----------------------------------------------------------------


@query("open_url", "SELECT url, page_id, length(html)::INTEGER AS n_chars FROM pages WHERE url IS NOT NULL")
def _(t):
    asked = t.pages.select("url").distinct()
    return t.pages.join(asked, "url", "left_semi").select("url", "page_id", F.length("html").alias("n_chars"))


_BARE = "regexp_replace(html, '(?s)<script.*?</script>|<style.*?</style>|<!--.*?-->', ' ', 'g')"


@query("html_extract", f"SELECT page_id, replace(regexp_extract(html, '(?s)<title>(.*?)</title>', 1), '&amp;', '&') AS title, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace({_BARE}, '<[^>]*>', ' ', 'g'), '&copy;|&middot;', ' ', 'g'), '&amp;', '&', 'g'), '\\s+', ' ', 'g')) AS text, len(regexp_extract_all({_BARE}, 'href=\"([^\"]*)\"', 1))::INTEGER AS n_links FROM pages")
def _(t):
    return t.pages.select("page_id", X.html_struct(F.col("html")).alias("x")).select("page_id", "x.title", "x.text", F.size("x.links").alias("n_links"))


@query("find_text", "SELECT doc_id, instr(text, ' the ')::INTEGER AS first, len(regexp_extract_all(text, ' the '))::INTEGER AS n FROM documents WHERE contains(text, ' the ')")
def _(t):
    return t.documents.where(F.contains("text", F.lit(" the "))).select("doc_id", F.instr("text", " the ").alias("first"), F.regexp_count("text", F.lit(" the ")).alias("n"))


@query("follow_links", "SELECT p.page_id, link, q.page_id AS to_page FROM (SELECT page_id, unnest(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) AS link, regexp_extract(url, '^https?://[^/?#]+') AS host FROM pages) p LEFT JOIN pages q ON q.url = CASE WHEN link[1] = '/' THEN host || link ELSE link END")
def _(t):
    links = t.pages.select("page_id", F.regexp_extract("url", "^https?://[^/?#]+", 0).alias("host"), F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), 1)).alias("link"))
    full = F.when(F.startswith("link", F.lit("/")), F.concat("host", "link")).otherwise(F.col("link"))
    known = t.pages.select(F.col("url").alias("full"), F.col("page_id").alias("to_page"))
    return links.withColumn("full", full).join(known, "full", "left").select("page_id", "link", "to_page")


# --- search ----------------------------------------------------------------

QUERIES = "(VALUES (1, 'loser idiot'), (2, 'the of and'), (3, 'zzzz'), (4, 'under den')) AS q(query_id, query)"
_BM = f"""WITH d AS (SELECT doc_id, string_split({_KEY}, ' ') AS w FROM documents), a AS (SELECT count(*) AS n, avg(len(w)) AS avgdl FROM d),
q AS (SELECT DISTINCT query_id, unnest(string_split(lower(query), ' ')) AS term FROM {QUERIES}), tf AS (SELECT doc_id, dl, term, count(*) AS tf FROM (SELECT doc_id, len(w) AS dl, unnest(w) AS term FROM d) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
s AS (SELECT query_id, doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 6) AS score FROM q JOIN tf USING (term) JOIN df USING (term), a GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id)::INTEGER AS rank FROM s)"""


def _run(t, k):
    return search.bm25(t.documents, t.values(QUERIES), k)


@query("bm25_search", f"{_BM} SELECT query_id, doc_id, score, rank FROM r WHERE rank <= 10")
def _(t):
    return _run(t, 10).select("query_id", "doc_id", "score", "rank")


@query("provider_local", f"{_BM} SELECT query_id, doc_id, 'docs' AS category FROM r WHERE rank <= 3")
def _(t):
    return _run(t, 3).select("query_id", "doc_id", F.lit("docs").alias("category"))


@query("search_topk", f"{_BM} SELECT k, count(r.doc_id)::BIGINT AS n FROM (VALUES (0), (1), (100000)) v(k) LEFT JOIN r ON rank <= k AND query_id = 1 GROUP BY k")
def _(t):
    k = t.values("(VALUES (0), (1), (100000)) AS v(k)")
    r = _run(t, 100000).where("query_id = 1").select("rank", "doc_id")
    return F.broadcast(k).join(r, F.col("rank") <= F.col("k"), "left").groupBy("k").agg(F.count("doc_id").alias("n"))


@query("search_tiebreak", f"{_BM} SELECT query_id, score, min(doc_id) AS first, count(*)::BIGINT AS n FROM r GROUP BY ALL HAVING count(*) > 1")
def _(t):
    return search.bm25_scores(t.documents, t.values(QUERIES)).groupBy("query_id", "score").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).where("n > 1")


@query("search_metadata", f"{_BM} SELECT sha256('doc:' || doc_id) AS source_id, query_id, rank, md5(text) AS content_hash, substr(text, 1, 80) AS excerpt FROM r JOIN documents USING (doc_id) WHERE rank <= 5")
def _(t):
    d = _run(t, 5).join(t.documents.select("doc_id", "text"), "doc_id")
    return d.select(F.sha2(F.concat(F.lit("doc:"), F.col("doc_id")), 256).alias("source_id"), "query_id", "rank", F.md5("text").alias("content_hash"), F.substring("text", 1, 80).alias("excerpt"))


@query("search_pipeline", f"{_BM} SELECT query_id, string_agg(substr(text, 1, 60), ' | ' ORDER BY rank) AS evidence FROM r JOIN documents USING (doc_id) WHERE rank <= 3 GROUP BY query_id")
def _(t):
    d = _run(t, 3).join(t.documents.select("doc_id", "text"), "doc_id")
    parts = F.transform(F.sort_array(F.collect_list(F.struct("rank", F.substring("text", 1, 60).alias("x")))), lambda s: s["x"])
    return d.groupBy("query_id").agg(F.array_join(parts, " | ").alias("evidence"))


@query("result_dedup", f"{_BM} SELECT query_id, min(rank) AS rank FROM r JOIN documents USING (doc_id) WHERE rank <= 50 GROUP BY query_id, md5(text)")
def _(t):
    d = _run(t, 50).join(t.documents.select("doc_id", F.md5("text").alias("h")), "doc_id")
    return d.groupBy("query_id", "h").agg(F.min("rank").alias("rank")).select("query_id", "rank")


_REL = "(doc_id % 3 = 0)"
@query("retrieval_hit_rate", f"{_BM} SELECT round(avg(hit), 9) AS hit_rate FROM (SELECT q.query_id, coalesce(max({_REL}::INT) FILTER (WHERE rank <= 5), 0) AS hit FROM {QUERIES} LEFT JOIN r ON r.query_id = q.query_id GROUP BY 1)")
def _(t):
    hits = _run(t, 5).groupBy("query_id").agg(F.max((F.col("doc_id") % 3 == 0).cast("int")).alias("hit"))
    return t.values(QUERIES).join(hits, "query_id", "left").agg(F.round(F.avg(F.coalesce("hit", F.lit(0))), 9).alias("hit_rate"))


@query("retrieval_topk_rel", f"{_BM} SELECT query_id, round(sum({_REL}::INT) / 5.0, 9)::DOUBLE AS precision FROM r WHERE rank <= 5 GROUP BY query_id")
def _(t):
    return _run(t, 5).groupBy("query_id").agg(F.round(F.sum((F.col("doc_id") % 3 == 0).cast("int")) / 5.0, 9).alias("precision"))


@query("retrieval_source_ok", f"{_BM} SELECT query_id, bool_or(source = 'src0') AS ok FROM r JOIN documents USING (doc_id) WHERE rank <= 10 GROUP BY query_id")
def _(t):
    return _run(t, 10).join(t.documents.select("doc_id", "source"), "doc_id").groupBy("query_id").agg(F.bool_or(F.col("source") == "src0").alias("ok"))


@query("retrieval_evidence_ok", f"{_BM} SELECT query_id, doc_id, contains({_KEY}, 'the') AS ok FROM r JOIN documents USING (doc_id) WHERE rank <= 10")
def _(t):
    d = _run(t, 10).join(t.documents.select("doc_id", "text"), "doc_id")
    return d.select("query_id", "doc_id", F.contains(X.norm_key(F.col("text")), F.lit("the")).alias("ok"))


# --- evidence --------------------------------------------------------------

SOURCES = "(VALUES ('s1', 'https://a/1', 'alpha beta gamma'), ('s2', 'https://a/2', 'delta epsilon')) AS s(source_id, url, content)"
CITES = "(VALUES (1, 'c1', 's1', 'https://a/1', 'alpha beta'), (1, 'c2', 's2', 'https://a/2', 'delta'), (2, 'c3', 's9', 'https://x/9', 'zeta'), (3, 'c4', 's1', 'https://a/2', 'alpha'), (4, 'c5', 's7', 'https://a/2', 'delta'), (5, 'c6', 's1', 'https://a/1', 'omega'), (6, 'c7', NULL, NULL, NULL), (7, 'c1', 's2', 'https://a/2', 'epsilon')) AS c(answer_id, claim, source_id, url, quote)"
_CITED = f"""SELECT c.*, CASE WHEN c.source_id IS NULL THEN 'none' WHEN s.source_id IS NULL AND c.url IN (SELECT url FROM {SOURCES}) THEN 'forged id' WHEN s.source_id IS NULL THEN 'unknown source'
 WHEN c.url <> s.url THEN 'forged url' WHEN NOT contains(s.content, c.quote) THEN 'unsupported quote' ELSE 'valid' END AS verdict FROM {CITES} LEFT JOIN {SOURCES} ON s.source_id = c.source_id"""


def _cited(t):
    return search.check_citations(t.values(CITES), t.values(SOURCES))


@query("evidence_trace", f"SELECT answer_id, claim, s.url AS found FROM {CITES} LEFT JOIN {SOURCES} USING (source_id)")
def _(t):
    s = t.values(SOURCES).select("source_id", F.col("url").alias("found"))
    return t.values(CITES).join(s, "source_id", "left").select("answer_id", "claim", "found")


@query("citation_check", f"SELECT answer_id, claim FROM {CITES} WHERE source_id IS NOT NULL AND source_id NOT IN (SELECT source_id FROM {SOURCES})")
def _(t):
    return t.values(CITES).where("source_id IS NOT NULL").join(t.values(SOURCES), "source_id", "left_anti").select("answer_id", "claim")


@query("quote_check", f"SELECT answer_id, claim, contains(content, quote) AS occurs FROM {CITES} JOIN {SOURCES} USING (source_id)")
def _(t):
    return t.values(CITES).join(t.values(SOURCES).drop("url"), "source_id").select("answer_id", "claim", F.contains("content", F.col("quote")).alias("occurs"))


@query("forged_source", f"SELECT answer_id, claim, verdict FROM ({_CITED})")
def _(t):
    return _cited(t).select("answer_id", "claim", "verdict")


@query("unsupported_claims", f"SELECT answer_id, round(avg((verdict <> 'valid')::INT), 9) AS unsupported FROM ({_CITED}) GROUP BY answer_id")
def _(t):
    return _cited(t).groupBy("answer_id").agg(F.round(F.avg((F.col("verdict") != "valid").cast("int")), 9).alias("unsupported"))


@query("cross_check", f"SELECT claim, count(DISTINCT source_id)::BIGINT AS n_sources, count(DISTINCT source_id) >= 2 AS confirmed FROM {CITES} GROUP BY claim")
def _(t):
    return t.values(CITES).groupBy("claim").agg(F.count_distinct("source_id").alias("n_sources"), (F.count_distinct("source_id") >= 2).alias("confirmed"))


@query("ev_grounding", f"SELECT round(avg((verdict = 'valid')::INT), 9) AS citation_validity, count(DISTINCT answer_id) FILTER (WHERE verdict = 'valid')::BIGINT AS grounded FROM ({_CITED})")
def _(t):
    valid = F.col("verdict") == "valid"
    return _cited(t).agg(F.round(F.avg(valid.cast("int")), 9).alias("citation_validity"), F.count_distinct(F.when(valid, F.col("answer_id"))).alias("grounded"))


# --- evaluation ------------------------------------------------------------

PREDICTIONS = """(VALUES (1, 'logic', 'test', 't1', 'a', 'a', -0.1, true, 30, 10), (2, 'logic', 'test', 't9', 'b', 'c', -2.3, false, 50, 12), (3, 'math', 'test', 't2', '4', '4', -0.2, true, 40, 8), (4, 'math', 'validation', 't2', '5', NULL, -1.2, NULL, 90, 20),
 (5, 'code', 'test', 't3', 'x = 1', 'x = 1', -0.3, true, 70, 30), (6, 'code', 'test', 't9', 'y', 'z', -0.9, false, 20, 5), (7, 'explanation', 'test', 't4', 'a b c', 'a b d', -0.5, true, 60, 9)) AS p(item_id, domain, split, template, gold, pred, logp, flag, ms, tokens)"""
_HIT = "(pred IS NOT DISTINCT FROM gold)::INT"


def _hit():
    return F.col("pred").eqNullSafe(F.col("gold")).cast("int")


@query("ev_perplexity", f"SELECT split, round(exp(-avg(logp::DOUBLE)), 9) AS perplexity FROM {PREDICTIONS} GROUP BY split")
def _(t):
    return t.values(PREDICTIONS).groupBy("split").agg(F.round(F.exp(-F.avg(F.col("logp").cast("double"))), 9).alias("perplexity"))


@query("ev_accuracy", f"SELECT domain, round(avg({_HIT}), 9) AS accuracy FROM {PREDICTIONS} GROUP BY domain")
def _(t):
    return t.values(PREDICTIONS).groupBy("domain").agg(F.round(F.avg(_hit()), 9).alias("accuracy"))


@query("ev_code", f"SELECT round(avg(flag::INT), 9) AS pass_rate, count(*)::BIGINT AS n FROM {PREDICTIONS} WHERE domain = 'code'")
def _(t):
    return t.values(PREDICTIONS).where("domain = 'code'").agg(F.round(F.avg(F.col("flag").cast("int")), 9).alias("pass_rate"), F.count("*").alias("n"))


@query("ev_explanation", f"SELECT item_id, round(2.0 * len(list_intersect(string_split(gold, ' '), string_split(pred, ' '))) / (len(string_split(gold, ' ')) + len(string_split(pred, ' '))), 9)::DOUBLE AS f1 FROM {PREDICTIONS} WHERE domain = 'explanation'")
def _(t):
    g, p = F.split("gold", " "), F.split("pred", " ")
    return t.values(PREDICTIONS).where("domain = 'explanation'").select("item_id", F.round(2.0 * F.size(F.array_intersect(g, p)) / (F.size(g) + F.size(p)), 9).alias("f1"))


@query("ev_instruction", f"SELECT round(avg(coalesce(flag, false)::INT), 9) AS completion FROM {PREDICTIONS}")
def _(t):
    return t.values(PREDICTIONS).agg(F.round(F.avg(F.coalesce("flag", F.lit(False)).cast("int")), 9).alias("completion"))


NEEDS = "(VALUES (1, true, true), (2, true, false), (3, false, false), (4, false, true), (5, false, false)) AS n(id, needed, used)"


@query("ev_tool_needed", f"SELECT round(avg((used)::INT) FILTER (WHERE needed), 9) AS needed_accuracy, round(avg((NOT used)::INT) FILTER (WHERE NOT needed), 9) AS not_needed_accuracy FROM {NEEDS}")
def _(t):
    return t.values(NEEDS).agg(F.round(F.avg(F.when(F.col("needed"), F.col("used").cast("int"))), 9).alias("needed_accuracy"), F.round(F.avg(F.when(~F.col("needed"), (~F.col("used")).cast("int"))), 9).alias("not_needed_accuracy"))


@query("ev_generalization", f"SELECT round(avg({_HIT}), 9) AS unseen FROM {PREDICTIONS} WHERE template NOT IN ('t1', 't2', 't3')")
def _(t):
    seen = t.values("(VALUES ('t1'), ('t2'), ('t3')) AS s(template)")
    return t.values(PREDICTIONS).join(F.broadcast(seen), "template", "left_anti").agg(F.round(F.avg(_hit()), 9).alias("unseen"))


@query("ev_no_collapse", f"SELECT domain, split, count(*)::BIGINT AS n, round(avg({_HIT}), 9) AS accuracy FROM {PREDICTIONS} GROUP BY GROUPING SETS ((domain), (domain, split))")
def _(t):
    return t.values(PREDICTIONS).groupingSets([["domain"], ["domain", "split"]], "domain", "split").agg(F.count("*").alias("n"), F.round(F.avg(_hit()), 9).alias("accuracy"))


CASES = "(VALUES ('A', 'pass'), ('A', 'fail'), ('B', 'pass'), ('C', 'pass'), ('D', 'fail'), ('E', 'pass'), ('F', 'pass'), ('G', 'pass'), ('H', 'fail'), ('H', 'pass')) AS k(family, outcome)"


@query("ev_cases_a_h", f"SELECT family, count(*) FILTER (WHERE outcome = 'pass')::BIGINT AS pass, count(*) FILTER (WHERE outcome = 'fail')::BIGINT AS fail FROM {CASES} GROUP BY family")
def _(t):
    return t.values(CASES).groupBy("family").pivot("outcome", ["pass", "fail"]).count().na.fill(0)


@query("ev_latency", f"SELECT quantile_cont(ms, 0.5)::DOUBLE AS p50, quantile_cont(ms, 0.95)::DOUBLE AS p95, round(1000.0 * sum(tokens) / sum(ms), 6)::DOUBLE AS tokens_per_second FROM {PREDICTIONS}")
def _(t):
    return t.values(PREDICTIONS).agg(F.percentile("ms", 0.5).alias("p50"), F.percentile("ms", 0.95).alias("p95"), F.round(1000.0 * F.sum("tokens") / F.sum("ms"), 6).cast("double").alias("tokens_per_second"))


RUNS = "(VALUES ('p1', 1, 'x'), ('p1', 1, 'x'), ('p2', 1, 'y'), ('p2', 1, 'z'), ('p2', 2, 'y')) AS r(prompt, seed, output)"


@query("ev_repeatability", f"SELECT prompt, seed, count(DISTINCT output) = 1 AS same FROM {RUNS} GROUP BY ALL")
def _(t):
    return t.values(RUNS).groupBy("prompt", "seed").agg((F.count_distinct("output") == 1).alias("same"))


SANDBOX = "(VALUES ('read_file', 'blocked'), ('network', 'blocked'), ('fork', 'contained'), ('write_tmp', 'allowed by design')) AS e(case_id, expected)"
ACTUAL = "(VALUES ('read_file', 'blocked'), ('network', 'not tested'), ('write_tmp', 'allowed by design'), ('env', 'environment-dependent')) AS a(case_id, actual)"


@query("sandbox_matrix", f"SELECT case_id, expected, actual, CASE WHEN actual IS NULL THEN 'not tested' WHEN expected IS NULL THEN 'unexpected' WHEN expected = actual THEN 'as expected' ELSE 'differs' END AS label FROM {SANDBOX} FULL JOIN {ACTUAL} USING (case_id)")
def _(t):
    j = t.values(SANDBOX).join(t.values(ACTUAL), "case_id", "full_outer")
    return j.withColumn("label", F.when(F.col("actual").isNull(), "not tested").when(F.col("expected").isNull(), "unexpected").when(F.col("expected") == F.col("actual"), "as expected").otherwise("differs"))


# --- ledgers ---------------------------------------------------------------

LEDGER = """(VALUES ('e1', 1, 'loss', 3.0, 2.9, 'f1'), ('e1', 2, 'loss', 2.0, 2.4, 'f1'), ('e1', 3, 'loss', 1.5, 2.6, 'f1'), ('e2', 1, 'loss', 3.1, 3.0, 'f1'), ('e2', 2, 'loss', 2.5, 2.2, 'f1'), ('e3', 1, 'loss', 9.0, 9.0, 'f2'), ('e3', 2, 'loss', 'NaN'::DOUBLE, 1.0, 'f2')) AS l(experiment, step, metric, train, validation, fingerprint)"""
_CAST = "(SELECT experiment, step, metric, train::DOUBLE AS train, validation::DOUBLE AS validation, fingerprint FROM " + LEDGER + ") g"


def _ledger(t):
    raw = t.values(LEDGER.replace("'NaN'::DOUBLE", "double('NaN')"))
    return raw.select("experiment", "step", "metric", F.col("train").cast("double").alias("train"), F.col("validation").cast("double").alias("validation"), "fingerprint")


@query("exp_compare", f"SELECT a.step, round(a.validation - b.validation, 9) AS gain FROM {_CAST.replace(') g', ') a')} JOIN {_CAST.replace(') g', ') b')} ON a.step = b.step AND a.experiment = 'e1' AND b.experiment = 'e2'")
def _(t):
    return L.compare(_ledger(t), "e1", "e2")


@query("exp_not_comparable", f"SELECT a.experiment AS a, b.experiment AS b, CASE WHEN a.f = b.f THEN 'COMPARABLE' ELSE 'NOT COMPARABLE' END AS verdict FROM (SELECT DISTINCT experiment, fingerprint AS f FROM {_CAST}) a JOIN (SELECT DISTINCT experiment, fingerprint AS f FROM {_CAST}) b ON a.experiment < b.experiment")
def _(t):
    d = _ledger(t).select("experiment", "fingerprint").distinct()
    a, b = d.toDF("a", "fa"), d.toDF("b", "fb")
    return a.join(b, F.col("a") < F.col("b")).select("a", "b", F.when(F.col("fa") == F.col("fb"), "COMPARABLE").otherwise("NOT COMPARABLE").alias("verdict"))


@query("exp_regression_gate", f"SELECT experiment, step, coalesce(validation <= best + 0.1, true) AS accepted FROM (SELECT *, min(validation) OVER (PARTITION BY experiment ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best FROM {_CAST})")
def _(t):
    return L.regression_gate(_ledger(t), 0.1).select("experiment", "step", "accepted")


@query("exp_overfit_detect", f"SELECT experiment, step FROM (SELECT *, train - lag(train) OVER w AS dt, validation - lag(validation) OVER w AS dv FROM {_CAST} WINDOW w AS (PARTITION BY experiment ORDER BY step)) WHERE dt < 0 AND dv > 0")
def _(t):
    return L.overfit(_ledger(t)).select("experiment", "step")


@query("exp_finite_check", f"SELECT experiment, min(step)::INTEGER AS step FROM {_CAST} WHERE isnan(train) OR isinf(train) GROUP BY experiment")
def _(t):
    bad = F.isnan("train") | (F.abs("train") == float("inf"))
    return _ledger(t).where(bad).groupBy("experiment").agg(F.min("step").alias("step"))


@query("exp_fingerprint", "SELECT sha256(count(*) || ':' || sum(('0x' || substr(h, 1, 8))::BIGINT) || ':' || sum(('0x' || substr(h, 9, 8))::BIGINT) || ':' || sum(('0x' || substr(h, 17, 8))::BIGINT) || ':' || sum(('0x' || substr(h, 25, 8))::BIGINT)) AS fingerprint FROM (SELECT md5(doc_id || ':' || text) AS h FROM documents)")
def _(t):
    return L.fingerprint(t.documents.select(F.md5(F.concat("doc_id", F.lit(":"), "text")).alias("h")))


CHECKS = "(VALUES ('arch', 'a', 'a'), ('tokenizer', 't1', 't2'), ('dataset', NULL, NULL), ('experiment', 'e', NULL)) AS c(part, held, wanted)"


@query("exp_compat_check", f"SELECT bool_and(held IS NOT DISTINCT FROM wanted) AS compatible, string_agg(part, ',' ORDER BY part) FILTER (WHERE held IS DISTINCT FROM wanted) AS differing FROM {CHECKS}")
def _(t):
    same = F.col("held").eqNullSafe(F.col("wanted"))
    return t.values(CHECKS).agg(F.bool_and(same).alias("compatible"), F.array_join(F.sort_array(F.collect_list(F.when(~same, F.col("part")))), ",").alias("differing"))


RESUMED = "(VALUES (1, 0.10, NULL), (2, 0.09, NULL), (3, 0.08, 0.08), (4, 0.07, 0.07), (5, 0.06, 0.065)) AS r(step, whole, resumed)"


@query("exp_resume_check", f"SELECT step, whole = resumed AS continues FROM {RESUMED} WHERE resumed IS NOT NULL")
def _(t):
    return t.values(RESUMED).where("resumed IS NOT NULL").select("step", (F.col("whole") == F.col("resumed")).alias("continues"))


@query("checkpoint_retention", f"SELECT experiment, step FROM {_CAST} QUALIFY row_number() OVER (PARTITION BY experiment ORDER BY validation, step) = 1 OR row_number() OVER (PARTITION BY experiment ORDER BY step DESC) = 1")
def _(t):
    return L.retain(_ledger(t)).select("experiment", "step")


VARIANTS = "(VALUES ('FP32', 40000000, 0.90), ('FP16', 20000000, 0.90), ('INT8', 10000000, 0.89), ('INT4', 5000000, 0.70)) AS v(variant, bytes, quality)"


@query("quant_compare", f"SELECT arg_min(variant, bytes) AS chosen, min(bytes)::INTEGER AS bytes, round(min(bytes) / 1e6, 3) AS mb, round(min(bytes) / 1048576.0, 3)::DOUBLE AS mib FROM {VARIANTS} WHERE quality >= 0.90 - 0.02")
def _(t):
    g = t.values(VARIANTS).where("quality >= 0.90 - 0.02").agg(F.min_by("variant", "bytes").alias("chosen"), F.min("bytes").alias("bytes"))
    return g.withColumn("mb", F.round(F.col("bytes") / 1e6, 3)).withColumn("mib", F.round(F.col("bytes") / 1048576.0, 3).cast("double"))


STATUS = "(VALUES ('t1', 1, 'PLANNED'), ('t1', 2, 'EXECUTED'), ('t1', 3, 'VERIFIED'), ('t2', 1, 'PLANNED'), ('t2', 2, 'FAILED'), ('t3', 1, 'BLOCKED'), ('t2', 3, 'SUPERSEDED')) AS s(task, ts, status)"


@query("status_ledger", f"SELECT task, arg_max(status, ts) AS status FROM {STATUS} GROUP BY task")
def _(t):
    return t.values(STATUS).groupBy("task").agg(F.max_by("status", "ts").alias("status"))


@query("failed_preserved", f"SELECT task, string_agg(status, ' > ' ORDER BY ts) AS history FROM {STATUS} GROUP BY task")
def _(t):
    return t.values(STATUS).groupBy("task").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ts", "status"))), lambda x: x["status"]), " > ").alias("history"))


REQUIRED = "(VALUES ('README.md'), ('model.bin'), ('tokenizer.json'), ('CHECKSUMS')) AS r(file)"
PRESENT = "(VALUES ('README.md'), ('model.bin'), ('notes.txt')) AS p(file)"


@query("release_inventory", f"SELECT coalesce(r.file, p.file) AS file, CASE WHEN p.file IS NULL THEN 'missing' WHEN r.file IS NULL THEN 'unexpected' ELSE 'present' END AS state FROM {REQUIRED} FULL JOIN {PRESENT} ON r.file = p.file")
def _(t):
    r, p = t.values(REQUIRED), t.values(PRESENT)
    of = lambda d, s: d.withColumn("state", F.lit(s))
    return of(r.join(p, "file", "left_anti"), "missing").unionByName(of(p.join(r, "file", "left_anti"), "unexpected")).unionByName(of(r.join(p, "file", "left_semi"), "present"))


GATES = "(VALUES ('data', 'g1', true, 'report'), ('data', 'g2', true, NULL), ('model', 'g3', true, 'log'), ('tools', 'g4', false, 'log')) AS g(section, gate, verified, evidence)"


@query("acceptance_gates", f"SELECT section, bool_and(verified AND evidence IS NOT NULL) AS accepted, count(*)::BIGINT AS n FROM {GATES} GROUP BY section")
def _(t):
    return t.values(GATES).groupBy("section").agg(F.bool_and(F.col("verified") & F.col("evidence").isNotNull()).alias("accepted"), F.count("*").alias("n"))


@query("requirement_matrix", f"SELECT g.gate AS requirement, s.status, CASE WHEN s.status = 'VERIFIED' THEN 'none' ELSE 'act' END AS action FROM {GATES} LEFT JOIN (SELECT task, arg_max(status, ts) AS status FROM {STATUS} GROUP BY task) s ON s.task = replace(g.gate, 'g', 't')")
def _(t):
    s = t.values(STATUS).groupBy("task").agg(F.max_by("status", "ts").alias("status"))
    j = t.values(GATES).withColumn("task", F.replace("gate", F.lit("g"), F.lit("t"))).join(s, "task", "left")
    return j.select(F.col("gate").alias("requirement"), "status", F.when(F.col("status") == "VERIFIED", "none").otherwise("act").alias("action"))


ISSUES = "(VALUES ('P0', 'open'), ('P0', 'fixed'), ('P1', 'open'), ('P3', 'fixed'), ('P0', 'open')) AS i(priority, status)"


@query("issue_triage", f"SELECT priority, status, count(*)::BIGINT AS n FROM {ISSUES} GROUP BY ROLLUP (priority, status)")
def _(t):
    return t.values(ISSUES).rollup("priority", "status").agg(F.count("*").alias("n"))


@query("iterative_loop", f"SELECT domain, round(avg({_HIT}), 9) AS accuracy FROM {PREDICTIONS} GROUP BY domain ORDER BY accuracy, domain LIMIT 2")
def _(t):
    return t.values(PREDICTIONS).groupBy("domain").agg(F.round(F.avg(_hit()), 9).alias("accuracy")).orderBy("accuracy", "domain").limit(2)


@query("exp_failure_record", f"""SELECT experiment, 'validation rose while train fell' AS failure, 'overfit' AS hypothesis, arg_max(fingerprint, step) AS fingerprint, max(step) AS last_step, min(validation) AS best_validation, arg_max(validation, step) AS result, 'stop at the best step' AS decision
FROM {_CAST} GROUP BY experiment HAVING arg_max(validation, step) > min(validation) AND arg_max(train, step) <= min(train)""")
def _(t):
    by_step = lambda c: F.max_by(c, "step")
    runs = _ledger(t).groupBy("experiment").agg(
        by_step("fingerprint").alias("fingerprint"), F.max("step").alias("last_step"), F.min("validation").alias("best_validation"), by_step("validation").alias("result"),
        by_step("train").alias("train"), F.min("train").alias("best_train"),
    )
    failed = runs.where("result > best_validation AND train <= best_train")
    told = {"failure": "validation rose while train fell", "hypothesis": "overfit", "decision": "stop at the best step"}
    return failed.select("experiment", *[F.lit(v).alias(k) for k, v in told.items()], "fingerprint", "last_step", "best_validation", "result")


@query("rep_training", f"SELECT experiment, max(step) AS steps, min(train) AS best_train, min(validation) AS best_validation FROM {_CAST} GROUP BY experiment")
def _(t):
    return _ledger(t).groupBy("experiment").agg(F.max("step").alias("steps"), F.min("train").alias("best_train"), F.min("validation").alias("best_validation"))


@query("incremental_dedup", "SELECT doc_id FROM documents WHERE doc_id >= 500 AND md5(text) NOT IN (SELECT md5(text) FROM documents WHERE doc_id < 500)")
def _(t):
    d = t.documents.select("doc_id", F.md5("text").alias("h"))
    return d.where("doc_id >= 500").join(d.where("doc_id < 500").select("h"), "h", "left_anti").select("doc_id")


@query("src_open_corpus", "SELECT doc_id, source, lang, 'corpus' AS source_type FROM documents")
def _(t):
    return t.documents.select("doc_id", "source", "lang", F.lit("corpus").alias("source_type"))
