"""Queries of sources, dedup, splits, pairs, mixing, tokens, sequences and reports."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from quern.functions import text as X
from quern.operators import dedup, splits
from quern.plans.registry import query
from quern.plans.text_queries import _KEY

# --- dedup -----------------------------------------------------------------


@query("dedup_exact", "SELECT min(doc_id) AS doc_id, count(*)::BIGINT AS copies FROM documents GROUP BY md5(text)")
def _(t):
    return dedup.keep_first(t.documents, F.md5("text"))


@query("dedup_normalized", f"SELECT min(doc_id) AS doc_id, count(*)::BIGINT AS copies FROM documents GROUP BY md5({_KEY})")
def _(t):
    return dedup.keep_first(t.documents, F.md5(X.norm_key(F.col("text"))))


_SHINGLES = f"SELECT DISTINCT doc_id, ('0x' || substr(md5(array_to_string(w[i:i + 4], ' ')), 1, 7))::BIGINT AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM (SELECT doc_id, string_split({_KEY}, ' ') AS w FROM documents))"
_MINHASH = f"SELECT doc_id, k, min(((2654435 * (k + 1) + 1) * h + 40503 * k) % 2147483647) AS m FROM ({_SHINGLES}), (SELECT unnest(range(16)) AS k) GROUP BY ALL"
_PAIRS = f"""WITH s AS MATERIALIZED ({_SHINGLES}), m AS (SELECT doc_id, k, min(((2654435 * (k + 1) + 1) * h + 40503 * k) % 2147483647) AS m FROM s, (SELECT unnest(range(16)) AS k) GROUP BY ALL),
b AS (SELECT doc_id, k // 2 AS band, string_agg(m::VARCHAR, ',' ORDER BY k) AS key FROM m GROUP BY ALL),
p AS (SELECT DISTINCT x.doc_id AS a, y.doc_id AS b FROM b x JOIN b y ON x.band = y.band AND x.key = y.key AND x.doc_id < y.doc_id),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
o AS (SELECT p.a, p.b, count(*) AS o FROM p JOIN s x ON x.doc_id = p.a JOIN s y ON y.doc_id = p.b AND y.h = x.h GROUP BY ALL),
j AS (SELECT a, b, round(o / (na.n + nb.n - o)::DOUBLE, 9) AS jaccard FROM o JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b)"""


@query("dedup_minhash_lsh", _PAIRS + " SELECT a, b FROM p")
def _(t):
    return dedup.lsh_pairs(dedup.min_hashes(dedup.shingle_rows(t.documents)))


@query("jaccard_verify", _PAIRS + " SELECT * FROM j WHERE jaccard >= 0.5")
def _(t):
    return dedup.similar_ids(t.documents, 0.5)


@query("dedup_clusters", "WITH RECURSIVE " + _PAIRS.removeprefix("WITH ") + """, e AS MATERIALIZED (SELECT a, b FROM j WHERE jaccard >= 0.8 UNION SELECT b, a FROM j WHERE jaccard >= 0.8),
r(node, seen) AS (SELECT DISTINCT a, a FROM e UNION SELECT e.b, r.seen FROM r JOIN e ON e.a = r.node) SELECT node AS doc_id, min(seen) AS cluster FROM r GROUP BY node""")
def _(t):
    return dedup.similar_clusters(t.documents, 0.8).select(F.col("node").alias("doc_id"), F.col("root").alias("cluster"))


CODE = "(VALUES (1, 'train', 't1', 'def area(w, h): return w * h'), (2, 'test', 't2', 'def size(a, b): return a * b'), (3, 'train', 't1', 'def area(w, h): return w + h'), (4, 'test', 't1', 'print(1)'), (5, 'train', 't3', 'print( 1 )')) AS c(id, split, template, code)"
_SHAPE = r"regexp_replace(regexp_replace(regexp_replace(code, '\b(def|return|print)\b', '@\1@', 'g'), '(^|[^@A-Za-z_])[A-Za-z_]\w*', '\1ID', 'g'), '\s+', '', 'g')"


@query("dedup_code", f"SELECT a.id AS a, b.id AS b FROM (SELECT *, {_SHAPE} AS s FROM {CODE}) a JOIN (SELECT *, {_SHAPE} AS s FROM {CODE}) b ON a.s = b.s AND a.id < b.id")
def _(t):
    return dedup.same_shape(t.values(CODE))


@query("contam_code", f"SELECT a.id AS a, b.id AS b FROM (SELECT *, {_SHAPE} AS s FROM {CODE}) a JOIN (SELECT *, {_SHAPE} AS s FROM {CODE}) b ON a.s = b.s AND a.id < b.id AND a.split <> b.split")
def _(t):
    c = t.values(CODE).select("id", "split")
    p = dedup.same_shape(t.values(CODE)).join(c.select(F.col("id").alias("a"), F.col("split").alias("sa")), "a").join(c.select(F.col("id").alias("b"), F.col("split").alias("sb")), "b")
    return p.where("sa != sb").select("a", "b")


@query("contam_template", f"SELECT template, count(DISTINCT split)::BIGINT AS n_splits FROM {CODE} GROUP BY template HAVING count(DISTINCT split) > 1")
def _(t):
    return t.values(CODE).groupBy("template").agg(F.count_distinct("split").alias("n_splits")).where("n_splits > 1")


@query("dup_report", f"SELECT count(*)::BIGINT AS n, (count(*) - count(DISTINCT md5(text)))::BIGINT AS exact, (count(*) - count(DISTINCT md5({_KEY})))::BIGINT AS normalized FROM documents")
def _(t):
    d = t.documents.select(F.md5("text").alias("e"), F.md5(X.norm_key(F.col("text"))).alias("k"))
    return d.agg(F.count("*").alias("n"), (F.count("*") - F.count_distinct("e")).alias("exact"), (F.count("*") - F.count_distinct("k")).alias("normalized"))


@query("line_dedup", """WITH l AS (SELECT doc_id, i, string_split(text, chr(10))[i] AS line FROM (SELECT doc_id, text, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents)),
k AS (SELECT *, row_number() OVER (PARTITION BY md5(line) ORDER BY doc_id, i) AS rn FROM l) SELECT doc_id, string_agg(line, chr(10) ORDER BY i) AS text, count(*)::BIGINT AS n_lines FROM k WHERE rn = 1 GROUP BY doc_id""")
def _(t):
    return dedup.first_lines(t.documents)


@query("embedding_similarity", """SELECT a.vec_id, b.vec_id AS near_id, row_number() OVER (PARTITION BY a.vec_id ORDER BY round(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 7) DESC, b.vec_id)::INTEGER AS rank FROM (SELECT * FROM embeddings WHERE vec_id % 20 = 0) a JOIN embeddings b ON a.vec_id <> b.vec_id
QUALIFY rank <= 5""")
def _(t):
    return dedup.nearest_vectors(t.embeddings, t.embeddings.where("vec_id % 20 = 0"), 5)


# --- splits and contamination ---------------------------------------------

_BUCKET = "(('0x' || substr(md5({}), 1, 8))::BIGINT % 100)"
_SPLIT = "CASE WHEN {0} < 80 THEN 'train' WHEN {0} < 90 THEN 'validation' WHEN {0} < 95 THEN 'test' ELSE 'challenge' END"
_BY_ROW = _SPLIT.format(_BUCKET.format("doc_id::VARCHAR"))
_BY_GROUP = _SPLIT.format(_BUCKET.format("source"))


@query("split_hash", f"SELECT doc_id, {_BY_ROW} AS split FROM documents")
def _(t):
    return t.documents.select("doc_id", splits.assign(F.col("doc_id").cast("string")).alias("split"))


@query("split_group", f"SELECT source, {_BY_GROUP} AS split, count(*)::BIGINT AS n FROM documents GROUP BY ALL")
def _(t):
    return t.documents.groupBy("source", splits.assign(F.col("source")).alias("split")).agg(F.count("*").alias("n"))


@query("split_param_range", "SELECT doc_id, CASE WHEN n_chars < 500 THEN 'train' WHEN n_chars < 2000 THEN 'validation' ELSE 'test' END AS split, ntile(4) OVER (ORDER BY n_chars, doc_id)::INTEGER AS quarter FROM documents")
def _(t):
    cut = F.when(F.col("n_chars") < 500, "train").when(F.col("n_chars") < 2000, "validation").otherwise("test")
    return splits.tiles(t.documents.select("doc_id", "n_chars", cut.alias("split")), ["n_chars", "doc_id"], 4, "quarter").drop("n_chars")


@query("challenge_split", "SELECT doc_id, CASE WHEN source IN ('src1', 'src2') THEN 'challenge' ELSE 'other' END AS part FROM documents")
def _(t):
    held = t.values("(VALUES ('src1'), ('src2')) AS h(source)")
    d = t.documents.select("doc_id", "source")
    part = lambda how, name: d.join(F.broadcast(held), "source", how).select("doc_id", F.lit(name).alias("part"))
    return part("left_semi", "challenge").unionByName(part("left_anti", "other"))


def _splitted(t):
    return t.documents.select("doc_id", "text", "source", splits.assign(F.col("doc_id").cast("string")).alias("split"))


@query("contam_exact", f"WITH d AS (SELECT md5(text) AS h, {_BY_ROW} AS split FROM documents) SELECT count(*)::BIGINT AS n_shared FROM (SELECT h FROM d WHERE split = 'train' INTERSECT SELECT h FROM d WHERE split <> 'train')")
def _(t):
    d = _splitted(t).select(F.md5("text").alias("h"), "split")
    return d.where("split = 'train'").select("h").intersect(d.where("split != 'train'").select("h")).agg(F.count("*").alias("n_shared"))


@query("contam_normalized", f"WITH d AS (SELECT doc_id, md5({_KEY}) AS h, {_BY_ROW} AS split FROM documents) SELECT doc_id FROM d WHERE split = 'train' AND h IN (SELECT h FROM d WHERE split <> 'train')")
def _(t):
    d = _splitted(t).select("doc_id", F.md5(X.norm_key(F.col("text"))).alias("h"), "split")
    return d.where("split = 'train'").join(d.where("split != 'train'").select("h"), "h", "left_semi").select("doc_id")




def _grams(row_id: str, table: str) -> str:
    return f"SELECT DISTINCT {row_id}, md5(array_to_string(w[i:i + 7], ' ')) AS g FROM (SELECT {row_id}, w, unnest(range(1, len(w) - 6)) AS i FROM (SELECT {row_id}, string_split({_KEY}, ' ') AS w FROM {table}))"


_NGRAM = f"b AS ({_grams('item_id', 'benchmark')}), d AS ({_grams('doc_id', 'documents')}), n AS (SELECT item_id, count(*) AS n FROM b GROUP BY 1), c AS (SELECT doc_id, item_id, round(count(*) / any_value(n)::DOUBLE, 9) AS share FROM d JOIN b USING (g) JOIN n USING (item_id) GROUP BY ALL)"


@query("contam_ngram", f"WITH {_NGRAM} SELECT * FROM c")
def _(t):
    return splits.ngram_overlap(t.documents, t.benchmark)


@query("decontaminate", f"WITH {_NGRAM} SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM c WHERE share >= 0.5)")
def _(t):
    hit = splits.ngram_overlap(t.documents, t.benchmark).where("share >= 0.5")
    return t.documents.join(hit, "doc_id", "left_anti").select("doc_id")


@query("contam_verdict", f"WITH d AS (SELECT md5(text) AS e, md5({_KEY}) AS k, {_BY_ROW} AS split FROM documents), x AS (SELECT 'exact' AS chk, count(DISTINCT a.e)::BIGINT AS n FROM d a JOIN d b ON a.e = b.e AND a.split = 'train' AND b.split <> 'train' UNION ALL SELECT 'normalized', count(DISTINCT a.k)::BIGINT FROM d a JOIN d b ON a.k = b.k AND a.split = 'train' AND b.split <> 'train') SELECT chk, n, CASE WHEN n = 0 THEN 'PASS' ELSE 'FAIL' END AS verdict FROM x")
def _(t):
    return splits.verdict(_splitted(t))


@query("split_membership", f"SELECT doc_id, source, {_BY_GROUP} AS split FROM documents")
def _(t):
    return t.documents.select("doc_id", "source", splits.assign(F.col("source")).alias("split"))


@query("ev_evaluate_gate", f"WITH d AS (SELECT md5(text) AS h, {_BY_ROW} AS split FROM documents) SELECT CASE WHEN count(*) = 0 THEN 'open' ELSE 'closed' END AS gate FROM (SELECT h FROM d WHERE split = 'train' INTERSECT SELECT h FROM d WHERE split = 'test')")
def _(t):
    d = _splitted(t).select(F.md5("text").alias("h"), "split")
    both = d.where("split = 'train'").select("h").intersect(d.where("split = 'test'").select("h"))
    return both.agg(F.when(F.count("*") == 0, "open").otherwise("closed").alias("gate"))


@query("load_split", f"SELECT doc_id, text FROM (SELECT *, {_BY_GROUP} AS split FROM documents) WHERE split = 'train'")
def _(t):
    return t.documents.withColumn("split", splits.assign(F.col("source"))).where("split = 'train'").select("doc_id", "text")


# --- pairs -----------------------------------------------------------------

ITEMS = "(VALUES ('a', 'doc', 'd1'), ('a', 'code', 'c1'), ('a', 'function', 'f1'), ('a', 'explanation', 'e1'), ('b', 'problem', 'p1'), ('b', 'solution', 's1'), ('b', 'algorithm', 'g1'), ('b', 'implementation', 'i1'), ('c', 'bug', 'b1'), ('c', 'fix', 'x1'), ('c', 'bug', 'b2'), ('d', 'doc', 'd2')) AS i(task, kind, body)"
for _name, _left, _right in (("pair_doc_code", "doc", "code"), ("pair_problem_solution", "problem", "solution"), ("pair_function_explanation", "function", "explanation"), ("pair_bug_fix", "bug", "fix"), ("pair_algorithm_impl", "algorithm", "implementation")):
    query(_name, f"SELECT l.task, l.body AS first, r.body AS second FROM {ITEMS.replace('AS i(', 'AS l(')} JOIN {ITEMS.replace('AS i(', 'AS r(')} ON l.task = r.task AND l.kind = '{_left}' AND r.kind = '{_right}'")(
        lambda t, a=_left, b=_right: splits.pair(t.values(ITEMS), a, b)
    )

PATHS = "(VALUES ('src/test_a.py'), ('src/a.py'), ('src/b.py'), ('test_c.py')) AS f(path)"


@query("pair_test_impl", f"SELECT a.path AS test, b.path AS impl FROM {PATHS.replace('AS f(', 'AS a(')} JOIN {PATHS.replace('AS f(', 'AS b(')} ON b.path = replace(a.path, 'test_', '') AND contains(a.path, 'test_')")
def _(t):
    tests = t.values(PATHS).where("path LIKE '%test\\_%'").select(F.col("path").alias("test"), F.replace("path", F.lit("test_"), F.lit("")).alias("impl"))
    return tests.join(t.values(PATHS).select(F.col("path").alias("impl")), "impl").select("test", "impl")


@query("pair_turns", "SELECT * FROM (SELECT conv_id, turn, text AS prompt, lead(text) OVER w AS reply, role, lead(role) OVER w AS next FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) WHERE role = 'user' AND next = 'assistant'")
def _(t):
    w = W.partitionBy("conv_id").orderBy("turn")
    c = t.conversations.select("conv_id", "turn", F.col("text").alias("prompt"), F.lead("text").over(w).alias("reply"), "role", F.lead("role").over(w).alias("next"))
    return c.where("role = 'user' AND next = 'assistant'")


@query("join_labels", "SELECT doc_id, quality, toxic FROM documents LEFT JOIN labels USING (doc_id)")
def _(t):
    return t.documents.select("doc_id").join(t.labels, "doc_id", "left").select("doc_id", "quality", "toxic")


# --- mixing, curriculum, batches ------------------------------------------

_MIX = "CASE lang WHEN 'en' THEN 0.5 WHEN 'fr' THEN 0.8 ELSE 1.0 END"


@query("data_mixing", f"SELECT doc_id, lang FROM (SELECT doc_id, lang, percent_rank() OVER (PARTITION BY lang ORDER BY md5(doc_id::VARCHAR), doc_id) AS p FROM documents) WHERE p <= {_MIX}")
def _(t):
    return splits.mix(t.documents, "lang", {"en": 0.5, "fr": 0.8}).select("doc_id", "lang")


@query("stratified_sample", "SELECT doc_id, lang FROM documents QUALIFY row_number() OVER (PARTITION BY lang ORDER BY md5(doc_id::VARCHAR), doc_id) <= 20")
def _(t):
    w = W.partitionBy("lang").orderBy(F.md5(F.col("doc_id").cast("string")), "doc_id")
    return t.documents.select("doc_id", "lang", F.row_number().over(w).alias("rn")).where("rn <= 20").select("doc_id", "lang")


STAGES = "(VALUES ('en', 1), ('de', 2), ('fr', 3), ('es', 4)) AS s(lang, stage)"


@query("curriculum_order", f"SELECT doc_id, stage, row_number() OVER (PARTITION BY stage ORDER BY md5(doc_id::VARCHAR), doc_id)::INTEGER AS place FROM documents JOIN {STAGES} USING (lang)")
def _(t):
    d = t.documents.join(F.broadcast(t.values(STAGES)), "lang")
    return d.select("doc_id", "stage", F.row_number().over(W.partitionBy("stage").orderBy(F.md5(F.col("doc_id").cast("string")), "doc_id")).alias("place"))


@query("curriculum_ab", f"SELECT doc_id, rank() OVER (ORDER BY stage, md5(doc_id::VARCHAR), doc_id)::INTEGER AS place_a, rank() OVER (ORDER BY md5(doc_id::VARCHAR), doc_id)::INTEGER AS place_b FROM documents JOIN {STAGES} USING (lang)")
def _(t):
    d = t.documents.join(F.broadcast(t.values(STAGES)), "lang").select("doc_id", "stage", F.md5(F.col("doc_id").cast("string")).alias("h"))
    a = splits.global_rank(d, ["stage", "h", "doc_id"], "place_a")
    return splits.global_rank(a, ["h", "doc_id"], "place_b").select("doc_id", F.col("place_a").cast("int"), F.col("place_b").cast("int"))


@query("composition_ablation", "SELECT name, count(*)::BIGINT AS n FROM (SELECT 'text only' AS name FROM documents WHERE lang = 'en' UNION ALL SELECT 'mixed' FROM documents UNION ALL SELECT 'long only' FROM documents WHERE n_chars > 2000) GROUP BY name")
def _(t):
    kinds = F.array_compact(F.array(F.when(F.col("lang") == "en", "text only"), F.lit("mixed"), F.when(F.col("n_chars") > 2000, "long only")))
    return t.documents.select(F.explode(kinds).alias("name")).groupBy("name").agg(F.count("*").alias("n"))


_EPOCH = "(row_number() OVER (ORDER BY md5('7:0:' || doc_id), doc_id) - 1)"


@query("epoch_shuffle", f"SELECT doc_id, {_EPOCH}::BIGINT AS pos FROM documents")
def _(t):
    return splits.epoch_order(t.documents, 7, 0).select("doc_id", "pos")


@query("batch_assign", f"SELECT batch, count(*)::BIGINT AS n FROM (SELECT {_EPOCH} // 64 AS batch FROM documents) GROUP BY batch")
def _(t):
    return splits.epoch_order(t.documents, 7, 0).groupBy(F.expr("pos div 64").alias("batch")).agg(F.count("*").alias("n"))


@query("sampler_state", f"SELECT 0 AS epoch, 3::BIGINT AS next_batch, count(*)::BIGINT AS remaining, min(doc_id) AS least FROM (SELECT doc_id, {_EPOCH} // 64 AS batch FROM documents) WHERE batch >= 3")
def _(t):
    rest = splits.epoch_order(t.documents, 7, 0).where("pos div 64 >= 3")
    return rest.agg(F.lit(0).alias("epoch"), F.lit(3).cast("long").alias("next_batch"), F.count("*").alias("remaining"), F.min("doc_id").alias("least"))


@query("micro_batching", f"SELECT step, sum(n_chars)::BIGINT AS n_chars, count(DISTINCT batch)::BIGINT AS micro_batches FROM (SELECT n_chars, {_EPOCH} // 64 AS batch, {_EPOCH} // 256 AS step FROM documents) GROUP BY step")
def _(t):
    o = splits.epoch_order(t.documents, 7, 0)
    return o.groupBy(F.expr("pos div 256").alias("step")).agg(F.sum("n_chars").alias("n_chars"), F.count_distinct(F.expr("pos div 64")).alias("micro_batches"))


# --- reports ---------------------------------------------------------------


@query("rep_before_after", f"SELECT 'before' AS stage, count(*)::BIGINT AS n, sum(n_chars)::BIGINT AS n_chars FROM documents UNION ALL SELECT 'after', count(*)::BIGINT, sum(n_chars)::BIGINT FROM documents WHERE n_chars >= 200")
def _(t):
    of = lambda d, n: d.agg(F.lit(n).alias("stage"), F.count("*").alias("n"), F.sum("n_chars").alias("n_chars"))
    return of(t.documents, "before").unionByName(of(t.documents.where("n_chars >= 200"), "after"))


@query("rep_shares", "SELECT lang, count(*)::BIGINT AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 9)::DOUBLE AS pct FROM documents GROUP BY lang")
def _(t):
    g = t.documents.groupBy("lang").agg(F.count("*").alias("n"))
    return g.withColumn("pct", F.round(100.0 * F.col("n") / F.sum("n").over(W.partitionBy()), 9))


@query("rep_dup_pct", "SELECT round(100.0 * (1 - count(DISTINCT md5(text)) / count(*)), 9)::DOUBLE AS dup_pct, round(100.0 * count(*) FILTER (WHERE source = 'src0') / count(*), 9)::DOUBLE AS excluded_pct FROM documents")
def _(t):
    return t.documents.agg(F.round(100.0 * (1 - F.count_distinct(F.md5("text")) / F.count("*")), 9).alias("dup_pct"), F.round(100.0 * F.count_if(F.col("source") == "src0") / F.count("*"), 9).alias("excluded_pct"))


@query("rep_split_counts", f"SELECT split, lang, count(*)::BIGINT AS n, sum(n_chars)::BIGINT AS n_chars FROM (SELECT *, {_BY_GROUP} AS split FROM documents) GROUP BY ROLLUP (split, lang)")
def _(t):
    return t.documents.withColumn("split", splits.assign(F.col("source"))).rollup("split", "lang").agg(F.count("*").alias("n"), F.sum("n_chars").alias("n_chars"))


@query("rep_distributions", "SELECT lang, source, count(*)::BIGINT AS n FROM documents GROUP BY GROUPING SETS ((lang), (source))")
def _(t):
    return t.documents.groupingSets([["lang"], ["source"]], "lang", "source").agg(F.count("*").alias("n"))


@query("rep_verification_rate", "SELECT source, round(count(l.doc_id) / count(*)::DOUBLE, 9) AS verified, round(coalesce(avg(1 - l.quality), 0), 9)::DOUBLE AS malformed FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY source")
def _(t):
    d = t.documents.join(t.labels.withColumn("has", F.lit(1)), "doc_id", "left")
    return d.groupBy("source").agg(F.round(F.count("has") / F.count("*"), 9).alias("verified"), F.round(F.coalesce(F.avg(1 - F.col("quality")), F.lit(0.0)), 9).alias("malformed"))


@query("rep_contamination", f"WITH {_NGRAM} SELECT count(DISTINCT doc_id)::BIGINT AS n_docs, count(DISTINCT item_id)::BIGINT AS n_items, max(share) AS most FROM c")
def _(t):
    return splits.ngram_overlap(t.documents, t.benchmark).agg(F.count_distinct("doc_id").alias("n_docs"), F.count_distinct("item_id").alias("n_items"), F.max("share").alias("most"))


@query("rep_diversity", "SELECT count(DISTINCT source)::BIGINT AS sources, count(DISTINCT lang)::BIGINT AS langs, round(count(DISTINCT md5(text)) / count(*)::DOUBLE, 9) AS uniqueness, (SELECT round(-sum(p * ln(p)), 9) FROM (SELECT count(*) / sum(count(*)) OVER () AS p FROM documents GROUP BY lang)) AS lang_entropy FROM documents")
def _(t):
    p = t.documents.groupBy("lang").count().withColumn("p", F.col("count") / F.sum("count").over(W.partitionBy()))
    entropy = p.agg(F.round(-F.sum(F.col("p") * F.log("p")), 9).alias("lang_entropy"))
    return t.documents.agg(F.count_distinct("source").alias("sources"), F.count_distinct("lang").alias("langs"), F.round(F.count_distinct(F.md5("text")) / F.count("*"), 9).alias("uniqueness")).crossJoin(F.broadcast(entropy))


@query("write_reports", "SELECT source, count(*)::BIGINT AS n, sum(n_chars)::BIGINT AS n_chars, min(doc_id) AS first, max(doc_id) AS last FROM documents GROUP BY source")
def _(t):
    return t.documents.groupBy("source").agg(F.count("*").alias("n"), F.sum("n_chars").alias("n_chars"), F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))


@query("write_provenance", "SELECT source, 'https://example.org/' || source AS url, count(*)::BIGINT AS n_rows, min(lang) AS lang FROM documents GROUP BY source")
def _(t):
    return t.documents.groupBy("source").agg(F.first(F.concat(F.lit("https://example.org/"), F.col("source"))).alias("url"), F.count("*").alias("n_rows"), F.min("lang").alias("lang"))


# --- flagship --------------------------------------------------------------

_FLAG = f"""WITH {_NGRAM}, k AS (SELECT doc_id, text, lang, source, row_number() OVER (PARTITION BY md5({_KEY}) ORDER BY doc_id) AS rn FROM documents WHERE n_chars >= 100),
s AS (SELECT *, {_BY_GROUP} AS split, len(string_split({_KEY}, ' ')) AS words FROM k WHERE rn = 1 AND doc_id NOT IN (SELECT doc_id FROM c WHERE share >= 0.5))
SELECT split, lang, count(*)::BIGINT AS documents, sum(words)::BIGINT AS words, round(100.0 * sum(words) / sum(sum(words)) OVER (), 9)::DOUBLE AS pct FROM s GROUP BY split, lang"""


@query("flagship", _FLAG)
def _(t):
    docs = t.documents.where("n_chars >= 100").withColumn("key", X.norm_key(F.col("text")))
    first = docs.groupBy(F.md5("key").alias("h")).agg(F.min_by(F.struct("doc_id", "lang", "source", F.size(F.split("key", " ")).alias("words")), "doc_id").alias("d")).select("d.*")
    hit = splits.ngram_overlap(t.documents, t.benchmark).where("share >= 0.5")
    g = first.join(hit, "doc_id", "left_anti").groupBy(splits.assign(F.col("source")).alias("split"), "lang").agg(F.count("*").alias("documents"), F.sum("words").alias("words"))
    return g.withColumn("pct", F.round(100.0 * F.col("words") / F.sum("words").over(W.partitionBy()), 9))
