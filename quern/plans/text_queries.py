"""Queries of records, normalisation, filters and quality features."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from quern.functions import text as X
from quern.plans.registry import query

#: Literal inputs; both engines read the same text.
NORM = r"""(VALUES (1, 'prose', 'One  two' || chr(13) || chr(10) || 'three' || chr(7) || '   four '), (2, 'code', 'def f():' || chr(13) || chr(10) || '    return  1' || chr(9)),
 (3, 'markdown', 'a   b ```x   =  1``` c   d'), (4, 'structured', '{"a":  1}'), (5, 'prose', ''), (6, 'code', 'if x:' || chr(10) || '  <|code|>y<|endcode|>'), (7, 'prose', NULL)) AS t(id, kind, raw)"""
FILES = r"""(VALUES ('src/a.py', 'MIT', 'def f():' || chr(10) || '    return 1'), ('vendor/lib/x.js', 'MIT', 'var a=1;'), ('node_modules/y.js', NULL, 'x'), ('dist/app.min.js', 'Apache-2.0', repeat('a=1;', 200)),
 ('gen/api_pb2.py', 'MIT', '# Code generated by tool. DO NOT EDIT.' || chr(10) || 'x = 1'), ('.git/config', NULL, '[core]'), ('logo.png', 'CC0', 'PNG' || chr(1)), ('run.sh', 'Proprietary', 'rm -rf / --no-preserve-root'),
 ('key.txt', 'MIT', '-----BEGIN RSA PRIVATE KEY-----'), ('big.txt', 'CC-BY-4.0', repeat('word and ', 2000)), ('src/test_a.py', 'MIT', 'assert f() == 1'), ('docs/a.md', 'CC-BY-4.0', 'f returns 1')) AS t(path, license, content)"""
POLICY = "(VALUES ('MIT', 'permit'), ('Apache-2.0', 'permit'), ('CC0', 'permit'), ('CC-BY-4.0', 'permit'), ('Proprietary', 'forbid')) AS p(name, decision)"
STOPWORDS = {"de": ["der", "die", "und", "den", "von", "mit"], "en": ["the", "and", "that", "was", "for", "with"], "es": ["los", "del", "las", "por", "con", "el"], "fr": ["les", "des", "et", "une", "pour", "dans"]}

# --- records ---------------------------------------------------------------

RECORD = T.StructType([T.StructField("record_id", T.StringType()), T.StructField("category", T.StringType()), T.StructField("source", T.StringType()), T.StructField("language", T.StringType()), T.StructField("text", T.StringType())])


def to_standard_record(df, category: str = "A"):
    """Any text source as the standard record."""
    made = df.select(F.sha2(F.concat_ws("\u0001", F.col("source"), F.col("doc_id").cast("string"), F.col("text")), 256).alias("record_id"), F.lit(category).alias("category"), "source", F.col("lang").alias("language"), "text")
    return made.to(RECORD)


@query("to_standard_record", "SELECT sha256(source || chr(1) || doc_id || chr(1) || text) AS record_id, 'A' AS category, source, lang AS language, text FROM documents")
def _(t):
    return to_standard_record(t.documents)


@query("stable_record_id", "SELECT doc_id, sha256(source || chr(1) || text) AS record_id FROM documents")
def _(t):
    return t.documents.select("doc_id", F.sha2(F.concat_ws("\u0001", "source", "text"), 256).alias("record_id"))


def segments(conv):
    """A conversation's segments in order: array<struct<ord, kind, text>>."""
    return conv.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct(F.col("turn").alias("ord"), F.col("role").alias("kind"), "text"))).alias("segments"))


@query("segment_messages", "SELECT conv_id, count(*)::BIGINT AS n, string_agg(turn || ':' || role || ':' || length(text), ',' ORDER BY turn) AS shape FROM conversations GROUP BY conv_id")
def _(t):
    shape = F.array_join(F.transform("segments", lambda s: F.concat_ws(":", s["ord"].cast("string"), s["kind"], F.length(s["text"]).cast("string"))), ",")
    return segments(t.conversations).select("conv_id", F.size("segments").cast("long").alias("n"), shape.alias("shape"))


def serialize(segmented):
    return segmented.select("conv_id", F.array_join(F.transform("segments", lambda s: F.concat(F.lit("<|"), s["kind"], F.lit("|>"), s["text"])), "\n").alias("serialized"))


@query("serialize_record", "SELECT conv_id, string_agg('<|' || role || '|>' || text, chr(10) ORDER BY turn) AS serialized FROM conversations GROUP BY conv_id")
def _(t):
    return serialize(segments(t.conversations))


def parse_serialized(c):
    """Control-token text back to (kind, text) segments."""
    kinds = F.regexp_extract_all(c, F.lit(r"<\|([a-z_]+)\|>"), 1)
    bodies = F.slice(F.split(c, r"\n?<\|[a-z_]+\|>"), 2, F.greatest(F.size(kinds), F.lit(1)))
    return F.arrays_zip(kinds.alias("kind"), bodies.alias("text"))


@query("parse_serialized", "SELECT conv_id, turn AS ord, role AS kind, text FROM (SELECT conv_id, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1)::INTEGER AS turn, role, text FROM conversations)")
def _(t):
    parsed = serialize(segments(t.conversations)).select("conv_id", parse_serialized(F.col("serialized")).alias("s"))
    return parsed.select("conv_id", F.posexplode("s").alias("ord", "x")).select("conv_id", "ord", F.col("x.kind").alias("kind"), F.col("x.text").alias("text"))


@query("token_role_tagging", "SELECT conv_id, turn, CASE role WHEN 'assistant' THEN 'target' WHEN 'tool' THEN 'tool-result' WHEN 'user' THEN 'user' ELSE 'context' END AS tag, length(text)::INTEGER AS n_chars FROM conversations")
def _(t):
    tag = F.when(F.col("role") == "assistant", "target").when(F.col("role") == "tool", "tool-result").when(F.col("role") == "user", "user").otherwise("context")
    return t.conversations.select("conv_id", "turn", tag.alias("tag"), F.length("text").alias("n_chars"))


REPAIR = "(VALUES (1, 'BUGGY_INPUT', 'retrun 1', false), (1, 'TARGET_CORRECT_CODE', 'return 1', true), (2, 'TARGET_CORRECT_CODE', 'retrun 2', false), (3, 'PROSE', 'text', true)) AS r(task_id, kind, content, valid)"


@query("repair_pair_fields", f"SELECT task_id, max(content) FILTER (WHERE kind = 'BUGGY_INPUT') AS buggy_input, max(content) FILTER (WHERE kind = 'TARGET_CORRECT_CODE') AS target_correct_code FROM {REPAIR} GROUP BY task_id")
def _(t):
    only = lambda k: F.max(F.when(F.col("kind") == k, F.col("content")))
    return t.values(REPAIR).groupBy("task_id").agg(only("BUGGY_INPUT").alias("buggy_input"), only("TARGET_CORRECT_CODE").alias("target_correct_code"))


@query("debug_exception", f"SELECT task_id, kind FROM {REPAIR} WHERE valid OR kind = 'BUGGY_INPUT'")
def _(t):
    return t.values(REPAIR).where("valid OR kind = 'BUGGY_INPUT'").select("task_id", "kind")


@query("attach_provenance", "SELECT doc_id, source, 'https://example.org/' || source AS url, CASE WHEN doc_id % 2 = 0 THEN 'MIT' ELSE 'LICENSE_UNCLEAR' END AS license, 'unverified' AS verification FROM documents")
def _(t):
    catalog = t.documents.select("source").distinct().withColumn("url", F.concat(F.lit("https://example.org/"), "source"))
    return t.documents.join(catalog, "source").select("doc_id", "source", "url", F.when(F.col("doc_id") % 2 == 0, "MIT").otherwise("LICENSE_UNCLEAR").alias("license"), F.lit("unverified").alias("verification"))


# --- normalisation ---------------------------------------------------------


@query("norm_line_endings", f"SELECT id, regexp_replace(raw, '\r\n?', chr(10), 'g') AS out FROM {NORM}")
def _(t):
    return t.values(NORM).select("id", X.norm_eol(F.col("raw")).alias("out"))


@query("strip_control_chars", f"SELECT id, regexp_replace(raw, '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F]', '', 'g') AS out FROM {NORM}")
def _(t):
    return t.values(NORM).select("id", X.strip_ctrl(F.col("raw")).alias("out"))


@query("collapse_prose_space", f"SELECT id, CASE WHEN kind = 'prose' THEN trim(regexp_replace(raw, ' +', ' ', 'g')) ELSE raw END AS out FROM {NORM}")
def _(t):
    return t.values(NORM).select("id", F.when(F.col("kind") == "prose", X.collapse_spaces(F.col("raw"))).otherwise(F.col("raw")).alias("out"))


_CODE = "regexp_replace(regexp_replace(raw, '\r\n?', chr(10), 'g'), '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F]', '', 'g')"
_MARK = "array_to_string(list_transform(string_split(raw, '```'), lambda x, i: CASE WHEN i % 2 = 1 THEN regexp_replace(x, ' +', ' ', 'g') ELSE x END), '```')"


@query("preserve_code_layout", f"SELECT id, {_CODE} AS out FROM {NORM} WHERE kind = 'code'")
def _(t):
    return t.values(NORM).where("kind = 'code'").select("id", X.norm_code(F.col("raw")).alias("out"))


@query("preserve_code_fences", f"SELECT id, {_MARK} AS out FROM {NORM} WHERE kind = 'markdown'")
def _(t):
    return t.values(NORM).where("kind = 'markdown'").select("id", X.norm_markdown(F.col("raw")).alias("out"))


@query("content_dispatch", f"SELECT id, CASE kind WHEN 'prose' THEN trim(regexp_replace({_CODE}, ' +', ' ', 'g')) WHEN 'code' THEN {_CODE} WHEN 'markdown' THEN {_MARK} ELSE raw END AS out FROM {NORM}")
def _(t):
    return t.values(NORM).select("id", X.normalize(F.col("kind"), F.col("raw")).alias("out"))


@query("preserve_control_tokens", f"SELECT id, len(regexp_extract_all(raw, '<\\|[a-z_]+\\|>'))::INTEGER AS n_before, len(regexp_extract_all({_CODE}, '<\\|[a-z_]+\\|>'))::INTEGER AS n_after FROM {NORM} WHERE raw IS NOT NULL")
def _(t):
    return t.values(NORM).where("raw IS NOT NULL").select("id", X.control_count(F.col("raw")).alias("n_before"), X.control_count(X.norm_code(F.col("raw"))).alias("n_after"))


@query("norm_unicode", "SELECT doc_id, nfc_normalize(text) AS text FROM documents")
def _(t):
    return t.documents.select("doc_id", X.norm_unicode("text").alias("text"))


@query("truncate_content", "SELECT doc_id, substr(text, 1, 200) AS excerpt, length(text) > 200 AS cut FROM documents")
def _(t):
    return t.documents.select("doc_id", F.substring("text", 1, 200).alias("excerpt"), (F.length("text") > 200).alias("cut"))


@query("compress_evidence", r"""WITH s AS (SELECT doc_id, i, string_split_regex(text, '\. +')[i] AS s FROM (SELECT doc_id, text, unnest(range(1, len(string_split_regex(text, '\. +')) + 1)) AS i FROM documents)),
r AS (SELECT doc_id, i, s, (contains(lower(s), 'the'))::INT + (contains(lower(s), 'and'))::INT AS score FROM s),
k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, i) AS rn FROM r)
SELECT doc_id, string_agg(s, ' ' ORDER BY rn) AS evidence FROM k WHERE rn <= 2 GROUP BY doc_id""")
def _(t):
    parts = t.documents.select("doc_id", F.split("text", r"\. +").alias("s"))
    score = lambda x: sum((F.when(F.contains(F.lower(x), F.lit(w)), 1).otherwise(0) for w in ("the", "and")), F.lit(0))
    ranked = F.sort_array(F.transform("s", lambda x, i: F.struct((-score(x)).alias("k"), i.alias("i"), x.alias("x"))))
    return parts.select("doc_id", F.array_join(F.transform(F.slice(ranked, 1, 2), lambda r: r["x"]), " ").alias("evidence"))


_KEY = r"trim(regexp_replace(lower(text), '[^\p{L}\p{N}]+', ' ', 'g'))"


@query("normalized_key", f"SELECT doc_id, md5({_KEY}) AS key FROM documents")
def _(t):
    return t.documents.select("doc_id", F.md5(X.norm_key(F.col("text"))).alias("key"))


@query("shingle", f"""SELECT doc_id, count(*)::BIGINT AS n, count(DISTINCT g)::BIGINT AS n_different, min(g) AS least FROM (
SELECT doc_id, md5(array_to_string(w[i:i + 4], ' ')) AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM (SELECT doc_id, string_split({_KEY}, ' ') AS w FROM documents))) GROUP BY doc_id""")
def _(t):
    made = t.documents.select("doc_id", F.explode(F.array(F.split(X.norm_key(F.col("text")), " "))).alias("w")).select("doc_id", X.shingles(F.col("w"), 5).alias("s"))
    return made.where(F.size("s") > 0).select("doc_id", F.size("s").cast("long").alias("n"), F.size(F.array_distinct("s")).cast("long").alias("n_different"), F.array_min("s").alias("least"))


ANSWERS = "(VALUES (1, 'so 3 + 4 = 7'), (2, 'the answer is -2.5.'), (3, 'none'), (4, '')) AS a(id, said)"


@query("robust_answer_extract", rf"SELECT id, try_cast(regexp_extract_all(said, '-?\d+(?:\.\d+)?')[-1] AS DOUBLE) AS answer FROM {ANSWERS}")
def _(t):
    return t.values(ANSWERS).select("id", X.extract_answer(F.col("said")).alias("answer"))


# --- filters ---------------------------------------------------------------


def license_filter(df, policy, column: str = "license"):
    """Rows whose license the policy permits; a missing license is no permission."""
    return df.join(F.broadcast(policy.where("decision = 'permit'")), F.col(column) == F.col("name"), "left_semi")


@query("license_filter", f"SELECT path FROM {FILES} WHERE license IN (SELECT name FROM {POLICY} WHERE decision = 'permit')")
def _(t):
    return license_filter(t.values(FILES), t.values(POLICY)).select("path")


@query("license_unclear", f"SELECT path, coalesce(license, 'LICENSE_UNCLEAR') AS license, license IS NOT NULL AS included FROM {FILES}")
def _(t):
    return t.values(FILES).select("path", F.coalesce("license", F.lit("LICENSE_UNCLEAR")).alias("license"), F.col("license").isNotNull().alias("included"))


@query("license_detect", r"SELECT doc_id, nullif(regexp_extract(text, '(MIT|Apache|GPL|BSD|Creative Commons|[Cc]opyright|All rights reserved)', 1), '') AS license FROM documents")
def _(t):
    found = F.regexp_extract("text", "(MIT|Apache|GPL|BSD|Creative Commons|[Cc]opyright|All rights reserved)", 1)
    return t.documents.select("doc_id", F.when(found != "", found).alias("license"))


@query("language_filter", "SELECT doc_id, lang FROM documents WHERE lang IN ('en', 'de')")
def _(t):
    return t.documents.where(F.col("lang").isin("en", "de")).select("doc_id", "lang")


_LANGS = ", ".join(f"('{k}', '{w}')" for k, ws in STOPWORDS.items() for w in ws)


def lang_scores(word_array):
    """How many of the words are stop words of each language, as array<struct<hits, lang>>."""
    hits = lambda ws: F.size(F.filter(word_array, lambda x: x.isin(*ws)))
    return F.array(*[F.struct(hits(ws).alias("hits"), F.lit(k).alias("lang")) for k, ws in STOPWORDS.items()])


@query("language_detect", f"""WITH h AS (SELECT doc_id, l, count(*) FILTER (WHERE w = s) AS hits FROM (SELECT doc_id, unnest(string_split({_KEY}, ' ')) AS w FROM documents), (VALUES {_LANGS}) v(l, s) GROUP BY doc_id, l)
SELECT doc_id, arg_max(l, (hits, l)) AS detected, max(hits)::INTEGER AS hits FROM h GROUP BY doc_id""")
def _(t):
    best = F.array_max(lang_scores(F.col("w")))
    return t.documents.select("doc_id", F.explode(F.array(F.split(X.norm_key(F.col("text")), " "))).alias("w")).select("doc_id", best.alias("b")).select("doc_id", F.col("b.lang").alias("detected"), F.col("b.hits").alias("hits"))


_SYM = "len(regexp_extract_all(text, '[{}();=<>]'))"


@query("content_kind", f"SELECT doc_id, CASE WHEN {_SYM} * 20 > length(text) OR len(regexp_extract_all(text, '\\b(def|return|import|class)\\b')) > 3 THEN 'code' ELSE 'text' END AS kind FROM documents")
def _(t):
    code = (F.regexp_count("text", F.lit("[{}();=<>]")) * 20 > F.length("text")) | (F.regexp_count("text", F.lit(r"\b(?:def|return|import|class)\b")) > 3)
    return t.documents.select("doc_id", F.when(code, "code").otherwise("text").alias("kind"))


@query("modality_detect", "SELECT conv_id, turn, CASE WHEN role = 'system' THEN 'instruction' WHEN regexp_matches(text, '[0-9]+ *[-+*/=] *[0-9]+') THEN 'mathematics' WHEN role IN ('user', 'assistant') THEN 'conversational' ELSE 'text' END AS modality FROM conversations")
def _(t):
    m = F.when(F.col("role") == "system", "instruction").when(F.col("text").rlike("[0-9]+ *[-+*/=] *[0-9]+"), "mathematics").when(F.col("role").isin("user", "assistant"), "conversational").otherwise("text")
    return t.conversations.select("conv_id", "turn", m.alias("modality"))


#: The nine categories.
CATEGORIES = "(VALUES ('A', 'language'), ('B', 'logic'), ('C', 'mathematics'), ('D', 'algorithms'), ('E', 'code generation'), ('F', 'debugging'), ('G', 'explanation'), ('H', 'instruction'), ('I', 'tool use')) AS c(category, label)"


#: What a text of each category holds, the first that fits; texts that fit none are language.
CATEGORY_RULES = [
    ("I", r"<\|tool|tool_call"), ("F", r"(?i)\b(traceback|exception|debug)\b"), ("E", r"\b(def|class) \w+|```"), ("D", r"(?i)\b(algorithm|sort|graph)\b"),
    ("C", r"\d+ ?[-+*/=] ?\d+"), ("B", r"(?i)\b(implies|therefore|if and only if)\b"), ("G", r"(?i)\b(because|explains?)\b"), ("H", r"(?i)\b(please|summari[sz]e)\b"),
]
_CATEGORY = "CASE " + " ".join(f"WHEN regexp_matches(text, '{p}') THEN '{k}'" for k, p in CATEGORY_RULES) + " ELSE 'A' END"


@query("category_assign", f"SELECT d.doc_id, c.category, c.label FROM (SELECT doc_id, {_CATEGORY} AS k FROM documents) d JOIN {CATEGORIES} ON c.category = d.k")
def _(t):
    k = F.lit("A")
    for name, pattern in reversed(CATEGORY_RULES):
        k = F.when(F.col("text").rlike(pattern), name).otherwise(k)
    return t.documents.select("doc_id", k.alias("category")).join(F.broadcast(t.values(CATEGORIES)), "category").select("doc_id", "category", "label")


@query("safety_filter", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1) AND NOT regexp_matches(lower(text), '\\b(idiot|moron|scum)\\b')")
def _(t):
    marked = t.labels.where("toxic = 1")
    return t.documents.join(marked, "doc_id", "left_anti").where(~F.lower("text").rlike(r"\b(idiot|moron|scum)\b")).select("doc_id")


def _patterns(table: dict[str, str]) -> str:
    return " UNION ALL ".join(f"SELECT doc_id, '{n}' AS type, unnest(regexp_extract_all(text, '{p}')) AS span FROM documents" for n, p in table.items())


@query("secret_scan", _patterns(X.SECRETS))
def _(t):
    return t.documents.select("doc_id", F.explode(X.spans(F.col("text"), X.SECRETS)).alias("x")).select("doc_id", "x.type", "x.span")


@query("pii_scan", _patterns(X.PERSONAL))
def _(t):
    return t.documents.select("doc_id", F.explode(X.spans(F.col("text"), X.PERSONAL)).alias("x")).select("doc_id", "x.type", "x.span")


@query("malware_scan", f"SELECT path, contains(content, 'rm -rf /') OR contains(content, 'eval(base64') AS hostile FROM {FILES}")
def _(t):
    return t.values(FILES).select("path", (F.contains("content", F.lit("rm -rf /")) | F.contains("content", F.lit("eval(base64"))).alias("hostile"))


@query("binary_filter", f"SELECT path FROM {FILES} WHERE NOT regexp_matches(content, '[\\x00-\\x08]')")
def _(t):
    return t.values(FILES).where(~F.col("content").rlike(r"[\x00-\x08]") & F.is_valid_utf8(F.col("content"))).select("path")


_FLAGS = {
    "generated_filter": ("regexp_matches(content, '^[^\n]*(DO NOT EDIT|Code generated)')", lambda: F.col("content").rlike("^[^\n]*(DO NOT EDIT|Code generated)")),
    "vendored_filter": ("regexp_matches(path, '(^|/)(vendor|node_modules|third_party)/')", lambda: F.col("path").rlike("(^|/)(vendor|node_modules|third_party)/")),
    "minified_filter": ("list_max(list_transform(string_split(content, chr(10)), lambda x: length(x))) > 500", lambda: F.array_max(F.transform(F.split("content", "\n"), F.length)) > 500),
    "huge_file_filter": ("strlen(content) > 10000", lambda: F.octet_length("content") > 10000),
    "repo_metadata_filter": ("regexp_matches(path, '(^|/)\\.git/|\\.(png|jpg|ico|lock)$')", lambda: F.col("path").rlike(r"(^|/)\.git/|\.(png|jpg|ico|lock)$")),
}
for _name, (_sql, _flag) in _FLAGS.items():
    query(_name, f"SELECT path FROM {FILES} WHERE NOT ({_sql})")(lambda t, flag=_flag: t.values(FILES).where(~flag()).select("path"))

REASONS = [("generated", "generated_filter"), ("vendored", "vendored_filter"), ("minified", "minified_filter"), ("huge", "huge_file_filter"), ("metadata", "repo_metadata_filter")]


def reasons():
    """Why a file goes, as an array in a fixed order; empty for files that stay."""
    return F.filter(F.array(*[F.when(_FLAGS[f][1](), n) for n, f in REASONS]), lambda x: x.isNotNull())


_WHY = " UNION ALL ".join(f"SELECT path, {i} AS o, '{n}' AS reason FROM {FILES} WHERE {_FLAGS[f][0]}" for i, (n, f) in enumerate(REASONS))


@query("discard_reason", f"SELECT reason, count(*)::BIGINT AS n FROM ({_WHY}) GROUP BY reason")
def _(t):
    return t.values(FILES).select(F.explode(reasons()).alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


@query("inclusion_reason", f"SELECT f.path, coalesce(arg_min(reason, o), 'included') AS reason FROM {FILES.replace(' AS t(', ' AS f(')} LEFT JOIN ({_WHY}) w ON w.path = f.path GROUP BY f.path")
def _(t):
    return t.values(FILES).select("path", F.coalesce(F.get(reasons(), F.lit(0)), F.lit("included")).alias("reason"))


@query("spam_filter", r"""SELECT doc_id, round(len(list_distinct(w)) / len(w)::DOUBLE, 9) AS unique_share, round(len(regexp_extract_all(text, '[#$%&*!]')) / length(text)::DOUBLE, 9) AS symbol_share FROM (SELECT doc_id, text, string_split_regex(text, '\s+') AS w FROM documents)
WHERE len(list_distinct(w)) * 5 >= len(w) AND len(regexp_extract_all(text, '[#$%&*!]')) * 10 <= length(text)""")
def _(t):
    d = t.documents.select("doc_id", F.size(F.array_distinct(F.split("text", r"\s+"))).alias("u"), F.size(F.split("text", r"\s+")).alias("w"), F.regexp_count("text", F.lit("[#$%&*!]")).alias("s"), F.length("text").alias("c"))
    return d.where("u * 5 >= w AND s * 10 <= c").select("doc_id", F.round(F.col("u") / F.col("w"), 9).alias("unique_share"), F.round(F.col("s") / F.col("c"), 9).alias("symbol_share"))


def syntax_valid(df, lang: str = "lang", code: str = "code"):
    """df with valid: whether Python code parses; null for other languages. Nothing is executed."""
    import ast

    import pandas as pd

    def check(lang, code):
        def one(language, source):
            if language != "python" or source is None:
                return None
            try:
                ast.parse(source)
            except (SyntaxError, ValueError, RecursionError, MemoryError):
                return False
            return True

        return pd.Series([one(x, y) for x, y in zip(lang, code, strict=True)], dtype=object)

    return df.withColumn("valid", F.pandas_udf(check, "boolean")(lang, code))


@query("syntax_valid", "SELECT * FROM (VALUES (1, 'python', 'x = 1', true), (2, 'python', 'def f(:', false), (3, 'c', 'int x;', NULL), (4, 'python', NULL, NULL)) AS t(id, lang, code, valid)")
def _(t):
    return syntax_valid(t.values("(VALUES (1, 'python', 'x = 1'), (2, 'python', 'def f(:'), (3, 'c', 'int x;'), (4, 'python', NULL)) AS t(id, lang, code)"))


# --- quality ---------------------------------------------------------------


@query("q_source_quality", "SELECT source, round(avg(quality), 9) AS source_quality, count(*)::BIGINT AS n FROM documents JOIN labels USING (doc_id) GROUP BY source")
def _(t):
    return t.documents.join(t.labels, "doc_id").groupBy("source").agg(F.round(F.avg("quality"), 9).alias("source_quality"), F.count("*").alias("n"))


@query("q_length", r"SELECT doc_id, length(text)::INTEGER AS n_chars, strlen(text)::INTEGER AS n_bytes, len(regexp_extract_all(text, '\S+'))::INTEGER AS n_words, len(string_split(text, chr(10)))::INTEGER AS n_lines FROM documents")
def _(t):
    return t.documents.select("doc_id", F.length("text").alias("n_chars"), F.octet_length("text").alias("n_bytes"), F.regexp_count("text", F.lit(r"\S+")).alias("n_words"), F.size(F.split("text", "\n")).alias("n_lines"))


@query("q_code_validity")
def _(t):
    return syntax_valid(t.values(FILES).select("path", F.lit("python").alias("lang"), F.col("content").alias("code")).where("path LIKE '%.py'")).select("path", "valid")


@query("q_dup_score", "SELECT doc_id, (count(*) OVER (PARTITION BY md5(text)) - 1)::BIGINT AS copies FROM documents")
def _(t):
    counts = t.documents.groupBy(F.md5("text").alias("h")).agg(F.count("*").alias("n"))
    return t.documents.select("doc_id", F.md5("text").alias("h")).join(counts, "h").select("doc_id", (F.col("n") - 1).alias("copies"))


@query("q_info_density", r"SELECT doc_id, round(len(list_distinct(w)) / len(w)::DOUBLE, 9) AS density FROM (SELECT doc_id, string_split_regex(lower(text), '\s+') AS w FROM documents)")
def _(t):
    d = t.documents.select("doc_id", F.split(F.lower("text"), r"\s+").alias("w"))
    return d.select("doc_id", F.round(F.size(F.array_distinct("w")) / F.size("w"), 9).alias("density"))


_END = "len(regexp_extract_all(text, '[.!?]'))"


@query("q_structural", f"SELECT doc_id, round({_END} / length(text)::DOUBLE, 9) AS end_share, round(length(text) / len(string_split(text, chr(10)))::DOUBLE, 9) AS line_length FROM documents")
def _(t):
    return t.documents.select("doc_id", F.round(F.regexp_count("text", F.lit("[.!?]")) / F.length("text"), 9).alias("end_share"), F.round(F.length("text") / F.size(F.split("text", "\n")), 9).alias("line_length"))


@query("q_license_confidence", f"SELECT path, CASE WHEN license IS NULL THEN 0.0::DOUBLE WHEN decision = 'permit' THEN 1.0 ELSE 0.5 END AS confidence FROM {FILES} LEFT JOIN {POLICY} ON license = name")
def _(t):
    joined = t.values(FILES).join(F.broadcast(t.values(POLICY)), F.col("license") == F.col("name"), "left")
    return joined.select("path", F.when(F.col("license").isNull(), 0.0).when(F.col("decision") == "permit", 1.0).otherwise(0.5).alias("confidence"))


def quality_score(df):
    """A weighted score of density, sentence ends and symbols, with the weight a record gets: 1, 0.5, or 0 for removal."""
    w = F.split("text", r"\s+")
    score = 0.5 * F.size(F.array_distinct(w)) / F.size(w) + 0.3 * F.least(F.lit(1.0), 50 * F.regexp_count("text", F.lit("[.!?]")) / F.length("text")) + 0.2 * (1 - F.least(F.lit(1.0), 10 * F.regexp_count("text", F.lit("[#$%&*]")) / F.length("text")))
    scored = df.withColumn("score", F.round(score, 6))
    return scored.withColumn("weight", F.when(F.col("score") < 0.4, 0.0).when(F.col("score") < 0.7, 0.5).otherwise(1.0))


_SCORE = r"""round(0.5::DOUBLE * len(list_distinct(string_split_regex(text, '\s+'))) / len(string_split_regex(text, '\s+')) + 0.3::DOUBLE * least(1.0, 50 * len(regexp_extract_all(text, '[.!?]')) / length(text)::DOUBLE)
 + 0.2::DOUBLE * (1 - least(1.0, 10 * len(regexp_extract_all(text, '[#$%&*]')) / length(text)::DOUBLE)), 6)"""


@query("quality_score", f"SELECT doc_id, score, CASE WHEN score < 0.4 THEN 0.0::DOUBLE WHEN score < 0.7 THEN 0.5 ELSE 1.0 END AS weight FROM (SELECT doc_id, {_SCORE} AS score FROM documents)")
def _(t):
    return quality_score(t.documents).select("doc_id", "score", "weight")


@query("source_ranking", f"SELECT source, mean, rank() OVER (ORDER BY mean DESC)::INTEGER AS rank FROM (SELECT source, round(avg({_SCORE}), 6) AS mean FROM documents GROUP BY source)")
def _(t):
    per = quality_score(t.documents).groupBy("source").agg(F.round(F.avg("score"), 6).alias("mean"))
    return per.select("source", "mean", F.rank().over(W.orderBy(F.desc("mean"))).alias("rank"))


@query("quality_vs_labels", f"SELECT count(*) FILTER (WHERE s >= 0.7 AND quality = 1)::BIGINT AS tp, count(*) FILTER (WHERE s >= 0.7 AND quality = 0)::BIGINT AS fp, count(*) FILTER (WHERE s < 0.7 AND quality = 1)::BIGINT AS fn, count(*) FILTER (WHERE s < 0.7 AND quality = 0)::BIGINT AS tn FROM (SELECT {_SCORE} AS s, quality FROM documents JOIN labels USING (doc_id))")
def _(t):
    d = quality_score(t.documents).join(t.labels, "doc_id")
    n = lambda c, n: F.count_if(F.expr(c)).alias(n)
    return d.agg(n("score >= 0.7 AND quality = 1", "tp"), n("score >= 0.7 AND quality = 0", "fp"), n("score < 0.7 AND quality = 1", "fn"), n("score < 0.7 AND quality = 0", "tn"))
