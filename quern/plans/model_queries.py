"""Queries of tokens, sequences and masks, synthetic data and tool protocol."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from quern.operators import sequences as S
from quern.operators import tools as TL
from quern.plans.corpus_queries import _BY_ROW
from quern.plans.registry import query
from quern.plans.text_queries import _KEY

# --- tokens ----------------------------------------------------------------

_TOK = f"SELECT doc_id, unnest(string_split({_KEY}, ' ')) AS tok, {_BY_ROW} AS split FROM documents"
_VOCAB = f"SELECT tok, n, (row_number() OVER (ORDER BY n DESC, tok) - 1)::INTEGER AS id FROM (SELECT tok, count(*)::BIGINT AS n FROM ({_TOK}) WHERE split = 'train' GROUP BY tok) QUALIFY id < 500"


@query("tok_train_only", _VOCAB)
def _(t):
    return S.vocabulary(S.token_rows(t.documents).where("split = 'train'"), 500)


@query("tok_encode", f"WITH v AS ({_VOCAB}) SELECT doc_id, string_agg(coalesce(v.id, 500)::VARCHAR, ' ' ORDER BY pos) AS ids FROM (SELECT doc_id, w[i] AS tok, i AS pos FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM (SELECT doc_id, string_split({_KEY}, ' ') AS w FROM documents))) LEFT JOIN v USING (tok) GROUP BY doc_id")
def _(t):
    v = S.vocabulary(S.token_rows(t.documents).where("split = 'train'"), 500)
    return S.encode(t.documents, v, 500).select("doc_id", F.array_join("ids", " ").alias("ids"))


@query("tok_vocab_size", f"SELECT count(*)::BIGINT AS size, count(*) = 500 AS matches FROM ({_VOCAB})")
def _(t):
    v = S.vocabulary(S.token_rows(t.documents).where("split = 'train'"), 500)
    return v.agg(F.count("*").alias("size"), (F.count("*") == 500).alias("matches"))


@query("tok_avg_per_sample", f"SELECT lang, round(avg(len(string_split({_KEY}, ' '))), 9) AS tokens FROM documents GROUP BY lang")
def _(t):
    return S.with_words(t.documents, "lang").groupBy("lang").agg(F.round(F.avg(F.size("w")), 9).alias("tokens"))


@query("tok_fertility", r"SELECT lang, round(sum(ceil(length(text) / 4.0)) / sum(len(regexp_extract_all(text, '\S+'))), 9)::DOUBLE AS fertility FROM documents GROUP BY lang")
def _(t):
    return t.documents.groupBy("lang").agg(F.round(F.sum(F.ceil(F.length("text") / 4.0)) / F.sum(F.regexp_count("text", F.lit(r"\S+"))), 9).alias("fertility"))


@query("tok_special", "SELECT conv_id, len(regexp_extract_all(string_agg('<|' || role || '|>' || text, chr(10)), '<\\|[a-z_]+\\|>'))::INTEGER AS n_special FROM conversations GROUP BY conv_id")
def _(t):
    c = t.conversations.groupBy("conv_id").agg(F.array_join(F.collect_list(F.concat(F.lit("<|"), "role", F.lit("|>"), "text")), "\n").alias("s"))
    return c.select("conv_id", F.regexp_count("s", F.lit(r"<\|[a-z_]+\|>")).alias("n_special"))


@query("tok_unk_rate", f"WITH v AS ({_VOCAB}) SELECT split, round(avg((v.id IS NULL)::INT), 9) AS unk FROM ({_TOK}) LEFT JOIN v USING (tok) GROUP BY split")
def _(t):
    tokens = S.token_rows(t.documents)
    v = S.vocabulary(tokens.where("split = 'train'"), 500)
    return tokens.join(F.broadcast(v), "tok", "left").groupBy("split").agg(F.round(F.avg(F.col("id").isNull().cast("int")), 9).alias("unk"))


@query("tok_hash", f"SELECT sha256(string_agg(tok, ' ' ORDER BY id)) AS hash, sum(strlen(tok) + 1)::BIGINT AS bytes FROM ({_VOCAB})")
def _(t):
    v = S.vocabulary(S.token_rows(t.documents).where("split = 'train'"), 500)
    in_order = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("id", "tok"))), lambda x: x["tok"]), " ")
    return v.agg(F.sha2(in_order, 256).alias("hash"), F.sum(F.octet_length("tok") + 1).cast("long").alias("bytes"))


# --- sequences -------------------------------------------------------------

_LEN = "len(string_split(text, ' '))"


_PACK = "WITH n AS (SELECT doc_id, {0} AS n FROM documents), s AS (SELECT doc_id, n, sum(n) OVER (ORDER BY doc_id) - n AS p FROM n) SELECT seq::BIGINT AS seq, sum(least(p + n, (seq + 1) * {1}) - greatest(p, seq * {1}))::BIGINT AS n_tokens, count(*)::BIGINT AS n_docs FROM (SELECT *, unnest(range((p // {1})::BIGINT, ((p + n - 1) // {1} + 1)::BIGINT)) AS seq FROM s) GROUP BY seq"


@query("seq_pack", _PACK.format(_LEN, 256))
def _(t):
    return S.packed_shape(t.documents, 256)


@query("seq_context_lengths", f"SELECT 256 AS length, count(*)::BIGINT AS n, sum(n_tokens)::BIGINT AS tokens FROM ({_PACK.format(_LEN, 256)}) UNION ALL SELECT 512, count(*)::BIGINT, sum(n_tokens)::BIGINT FROM ({_PACK.format(_LEN, 512)})")
def _(t):
    of = lambda n: S.packed_shape(t.documents, n).agg(F.lit(n).alias("length"), F.count("*").alias("n"), F.sum("n_tokens").alias("tokens"))
    return of(256).unionByName(of(512))


@query("seq_dynamic", f"SELECT doc_id, {_LEN}::INTEGER AS n, (64 * ceil({_LEN} / 64.0))::BIGINT AS bucket FROM documents")
def _(t):
    n = F.size(F.split("text", " "))
    return t.documents.select("doc_id", n.alias("n"), (64 * F.ceil(n / 64.0)).cast("long").alias("bucket"))


@query("seq_truncate_target", "SELECT conv_id, turn, array_to_string(w[greatest(1, len(w) - 11):], ' ') AS kept FROM (SELECT conv_id, turn, string_split(text, ' ') AS w FROM conversations WHERE role = 'user')")
def _(t):
    d = t.conversations.where("role = 'user'").select("conv_id", "turn", F.split("text", " ").alias("w"))
    return d.select("conv_id", "turn", F.array_join(S.last_of(F.col("w"), F.lit(12)), " ").alias("kept"))


@query("seq_sliding", "SELECT doc_id, p::INTEGER AS pos, md5(array_to_string(w[p:p + 127], ' ')) AS piece FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1, 96)) AS p FROM (SELECT doc_id, string_split(text, ' ') AS w FROM documents))")
def _(t):
    return S.sliding(t.documents, 128, 96).select("doc_id", F.col("at").alias("pos"), F.md5(F.array_join("piece", " ")).alias("piece"))


@query("seq_reject", f"SELECT doc_id FROM documents WHERE {_LEN} <= 512")
def _(t):
    return t.documents.where(F.size(F.split("text", " ")) <= 512).select("doc_id")


_TARGET = "(role = 'assistant')::INT"


@query("loss_mask", f"SELECT conv_id, sum({_LEN})::BIGINT AS n, sum({_LEN} * {_TARGET})::BIGINT AS n_target FROM conversations GROUP BY conv_id")
def _(t):
    return S.loss_mask(t.conversations, ["assistant"]).select("conv_id", F.size("mask").cast("long").alias("n"), F.aggregate("mask", F.lit(0).cast("long"), lambda a, x: a + x).alias("n_target"))


SEGMENTS = "(VALUES (1, 1, 'user', 5), (1, 2, 'thought', 3), (1, 3, 'tool_call', 4), (1, 4, 'tool_result', 6), (1, 5, 'final', 2), (2, 1, 'user', 1), (2, 2, 'final', 7), (3, 1, 'tool_result', 3)) AS s(record_id, ord, kind, n)"


@query("loss_mask_tool", f"SELECT record_id, string_agg(repeat(CASE WHEN kind IN ('tool_call', 'final') THEN '1' ELSE '0' END, n), '' ORDER BY ord) AS mask FROM {SEGMENTS} GROUP BY record_id")
def _(t):
    return S.segment_mask(t.values(SEGMENTS), ["tool_call", "final"]).select("record_id", F.array_join("mask", "").alias("mask"))


@query("loss_mask_thought", f"SELECT record_id, string_agg(repeat(CASE WHEN kind IN ('tool_call', 'final', 'thought') THEN '1' ELSE '0' END, n), '' ORDER BY ord) AS mask FROM {SEGMENTS} GROUP BY record_id")
def _(t):
    return S.segment_mask(t.values(SEGMENTS), ["tool_call", "final", "thought"]).select("record_id", F.array_join("mask", "").alias("mask"))


@query("label_shift", "SELECT conv_id, turn, array_to_string(w[2:], ' ') AS labels FROM (SELECT conv_id, turn, string_split(text, ' ') AS w FROM conversations)")
def _(t):
    d = t.conversations.select("conv_id", "turn", F.split("text", " ").alias("w"))
    return d.select("conv_id", "turn", F.array_join(F.slice("w", F.lit(2), F.size("w")), " ").alias("labels"))


@query("pad_mask", f"SELECT record_id, sum(n)::BIGINT AS n, greatest(16 - sum(n), 0)::BIGINT AS n_pad FROM {SEGMENTS} GROUP BY record_id")
def _(t):
    m = S.pad(S.segment_mask(t.values(SEGMENTS), ["final"]), 16)
    return m.select("record_id", F.size("mask").cast("long").alias("n"), (F.size("padded") - F.size("mask")).cast("long").alias("n_pad"))


@query("pad_report", f"SELECT sum(a)::BIGINT AS active, sum(n - a)::BIGINT AS masked, round(1 - sum(n) / sum(greatest(n, 16))::DOUBLE, 9) AS padding FROM (SELECT record_id, sum(n) AS n, sum(n * (kind = 'final')::INT) AS a FROM {SEGMENTS} GROUP BY record_id)")
def _(t):
    m = S.pad(S.segment_mask(t.values(SEGMENTS), ["final"]), 16)
    on = F.aggregate("mask", F.lit(0).cast("long"), lambda a, x: a + x)
    return m.agg(F.sum(on).alias("active"), F.sum(F.size("mask") - on).alias("masked"), F.round(1 - F.sum(F.size("mask")) / F.sum(F.size("padded")), 9).alias("padding"))


LOSSES = "(VALUES (1, 1, 2.0, 1), (1, 2, 9.0, 0), (1, 3, 4.0, 1), (2, 1, 5.0, 0), (3, 1, 1.0, 1)) AS l(id, pos, loss, mask)"


@query("masked_loss", f"SELECT id, (sum(loss * mask) / nullif(sum(mask), 0))::DOUBLE AS loss FROM {LOSSES} GROUP BY id")
def _(t):
    a = t.values(LOSSES).groupBy("id").agg(F.sort_array(F.collect_list(F.struct("pos", F.col("loss").cast("double").alias("loss"), "mask"))).alias("x"))
    return a.select("id", S.masked_mean(F.transform("x", lambda s: s["loss"]), F.transform("x", lambda s: s["mask"])).alias("loss"))


# --- synthetic -------------------------------------------------------------

_N = "(SELECT unnest(range(200)) AS i)"
_OP = "(('0x' || substr(md5('s:' || i || ':{0}'), 1, 4))::BIGINT % 100)"


@query("synth_arithmetic", f"SELECT i AS id, a || ' + ' || b || ' * ' || c || ' =' AS prompt, a + b * c AS answer FROM (SELECT i, {_OP.format('a')} AS a, {_OP.format('b')} AS b, {_OP.format('c')} AS c FROM {_N})")
def _(t):
    return S.arithmetic(t.spark, 200)


@query("independent_verify", f"SELECT count(*)::BIGINT AS n, count(*)::BIGINT AS accepted FROM {_N}")
def _(t):
    return S.verify_arithmetic(S.arithmetic(t.spark, 200)).agg(F.count("*").alias("n"), F.count_if("accepted").alias("accepted"))


@query("synth_logic", f"SELECT i AS id, p, q, NOT (p AND q) AS answer FROM (SELECT i, {_OP.format('p')} % 2 = 1 AS p, {_OP.format('q')} % 2 = 1 AS q FROM {_N})")
def _(t):
    g = t.spark.range(200).select("id", (S.operand("p") % 2 == 1).alias("p"), (S.operand("q") % 2 == 1).alias("q"))
    return g.withColumn("answer", ~F.col("p") | ~F.col("q"))


@query("synth_algorithm", f"SELECT i AS id, a || ',' || b || ',' || c AS items, least(a, b, c) || ',' || (a + b + c - least(a, b, c) - greatest(a, b, c)) || ',' || greatest(a, b, c) AS sorted FROM (SELECT i, {_OP.format('a')} AS a, {_OP.format('b')} AS b, {_OP.format('c')} AS c FROM {_N})")
def _(t):
    items = F.array(S.operand("a"), S.operand("b"), S.operand("c"))
    return t.spark.range(200).select("id", F.array_join(items, ",").alias("items"), F.array_join(F.sort_array(items), ",").alias("sorted"))


@query("synth_debug", f"SELECT i AS id, printf('def f(x): retrun x + %d', {_OP.format('a')}) AS buggy, printf('def f(x): return x + %d', {_OP.format('a')}) AS fixed FROM {_N}")
def _(t):
    return t.spark.range(200).select("id", F.format_string("def f(x): retrun x + %d", S.operand("a")).alias("buggy"), F.format_string("def f(x): return x + %d", S.operand("a")).alias("fixed"))


@query("synth_tool_traj", f"SELECT i AS id, 3 + (i % 2)::INTEGER AS n_segments, CASE WHEN i % 2 = 0 THEN 'user,tool_call,final' ELSE 'user,tool_call,tool_result,final' END AS kinds FROM {_N}")
def _(t):
    kinds = F.array_compact(F.array(F.lit("user"), F.lit("tool_call"), F.when(F.col("id") % 2 == 1, "tool_result"), F.lit("final")))
    return t.spark.range(200).select("id", F.size(kinds).alias("n_segments"), F.array_join(kinds, ",").alias("kinds"))


@query("src_synthetic", f"SELECT i AS id, 'synthetic' AS source_type, {_OP.format('a')} AS value FROM {_N}")
def _(t):
    return t.spark.range(200).select("id", F.lit("synthetic").alias("source_type"), S.operand("a").alias("value"))


@query("synth_counts", f"SELECT 300::BIGINT AS requested, count(*)::BIGINT AS generated, (count(*) - count(DISTINCT a))::BIGINT AS duplicate, count(DISTINCT a)::BIGINT AS accepted FROM (SELECT {_OP.format('a')} AS a FROM {_N})")
def _(t):
    g = t.spark.range(200).select(S.operand("a").alias("a"))
    return g.agg(F.lit(300).cast("long").alias("requested"), F.count("*").alias("generated"), (F.count("*") - F.count_distinct("a")).alias("duplicate"), F.count_distinct("a").alias("accepted"))


CODE_TASKS = "(VALUES (1, false, true), (2, true, true), (3, false, false), (4, NULL, true)) AS c(task_id, passed_before, passed_after)"


@query("code_task_verify", f"SELECT task_id, coalesce(NOT passed_before AND passed_after, false) AS accepted FROM {CODE_TASKS}")
def _(t):
    return t.values(CODE_TASKS).select("task_id", F.coalesce(~F.col("passed_before") & F.col("passed_after"), F.lit(False)).alias("accepted"))


# --- tools -----------------------------------------------------------------

CALLS = """(VALUES (1, 1, 'search', '{"name":"search","arguments":{"query":"a","k":"3"}}', 'ok', 120), (1, 2, 'search', '{"name":"search","arguments":{"query":"a","k":"3"}}', 'error', 300), (1, 3, 'search', '{"name":"search","arguments":{"query":"a","k":"3"}}', 'ok', 700),
 (2, 1, 'compute', '{"name":"compute","arguments":{"a":"2"}}', 'ok', 10), (2, 2, 'fetch', 'no json', 'error', 5), (3, 1, 'magic', '{"name":"magic","arguments":{}}', 'ok', 1), (4, 1, 'fetch', '{"name":"fetch","arguments":{"url":"u"}}', 'ok', 50)) AS c(conv_id, turn, expected, call, status, ms)"""
REGISTRY = "(VALUES ('search', 'query', 'web_search'), ('fetch', 'url', 'open_url'), ('compute', 'expression', 'calculator'), ('code', 'source', 'sandbox'), ('files', 'path', 'local_files')) AS r(name, required, implementation)"
_VALID = f"SELECT c.conv_id, c.turn, json_valid(call) AS parsed, CASE WHEN json_valid(call) THEN call->>'$.name' END AS name, r.name IS NOT NULL AND (CASE WHEN json_valid(call) THEN call->'$.arguments'->>r.required END) IS NOT NULL AS valid, r.implementation FROM {CALLS} LEFT JOIN {REGISTRY} ON r.name = CASE WHEN json_valid(call) THEN call->>'$.name' END"


@query("tool_call_parse", f"SELECT conv_id, turn, parsed, name FROM ({_VALID})")
def _(t):
    return TL.parse_calls(t.values(CALLS)).select("conv_id", "turn", "parsed", "name")


@query("tool_call_validate", f"SELECT conv_id, turn, coalesce(valid, false) AS valid FROM ({_VALID})")
def _(t):
    return TL.validate(TL.parse_calls(t.values(CALLS)), t.values(REGISTRY)).select("conv_id", "turn", "valid")


@query("tool_registry", f"SELECT * FROM {REGISTRY}")
def _(t):
    return t.values(REGISTRY)


@query("tool_route", f"SELECT conv_id, turn, implementation FROM ({_VALID}) WHERE valid")
def _(t):
    return TL.validate(TL.parse_calls(t.values(CALLS)), t.values(REGISTRY)).where("valid").select("conv_id", "turn", "implementation")


SUMS = "(VALUES (1, 6, '+', 3), (2, 6, '-', 3), (3, 6, '*', 3), (4, 6, '/', 4), (5, 6, '/', 0), (6, 1, '?', 1)) AS s(id, a, op, b)"


@query("compute_calculator", f"SELECT id, CASE op WHEN '+' THEN a + b WHEN '-' THEN a - b WHEN '*' THEN a * b WHEN '/' THEN a / nullif(b, 0) END::DOUBLE AS value FROM {SUMS}")
def _(t):
    return t.values(SUMS).select("id", TL.calculator(F.col("a"), F.col("op"), F.col("b")).alias("value"))


@query("compute_statistics", "SELECT event_type, count(*)::BIGINT AS n, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS deviation, min(value) AS least, max(value) AS most, round(quantile_cont(value, 0.5), 6) AS median FROM events GROUP BY event_type")
def _(t):
    v = F.col("value")
    return t.events.groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.avg(v), 6).alias("mean"), F.round(F.stddev_samp(v), 6).alias("deviation"), F.min(v).alias("least"), F.max(v).alias("most"), F.round(F.percentile(v, 0.5), 6).alias("median"))


@query("compute_json", "SELECT event_id, (props->>'$.k')::INTEGER AS k FROM events")
def _(t):
    return t.events.select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k"))


CSV = "(VALUES (1, '3,abc,1.5'), (2, '4,\"x,y\",2.5')) AS c(id, line)"


@query("compute_csv", "SELECT * FROM (VALUES (1, 3, 'abc', 1.5::DOUBLE), (2, 4, 'x,y', 2.5)) AS v(id, a, b, c)")
def _(t):
    return t.values(CSV).select("id", F.from_csv("line", "a int, b string, c double").alias("x")).select("id", "x.a", "x.b", "x.c")


@query("ctl_max_steps", f"SELECT conv_id, turn FROM {CALLS} QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn) <= 2")
def _(t):
    return TL.numbered(t.values(CALLS)).where("step <= 2").select("conv_id", "turn")


@query("ctl_timeouts", f"SELECT conv_id, turn, ms > 500 AS call_late, sum(ms) OVER (PARTITION BY conv_id ORDER BY turn) > 400 AS total_late FROM {CALLS}")
def _(t):
    run = F.sum("ms").over(W.partitionBy("conv_id").orderBy("turn"))
    return t.values(CALLS).select("conv_id", "turn", (F.col("ms") > 500).alias("call_late"), (run > 400).alias("total_late"))


@query("ctl_retry", f"SELECT conv_id, turn, coalesce(lag(status) OVER w = 'error' AND lag(call) OVER w = call, false) AS retry FROM {CALLS} WINDOW w AS (PARTITION BY conv_id ORDER BY turn)")
def _(t):
    w = W.partitionBy("conv_id").orderBy("turn")
    return t.values(CALLS).select("conv_id", "turn", F.coalesce((F.lag("status").over(w) == "error") & (F.lag("call").over(w) == F.col("call")), F.lit(False)).alias("retry"))


@query("ctl_loop_detect", f"SELECT conv_id, md5(call) AS call, count(*)::BIGINT AS n FROM {CALLS} GROUP BY ALL HAVING count(*) > 2")
def _(t):
    return t.values(CALLS).groupBy("conv_id", F.md5("call").alias("call")).agg(F.count("*").alias("n")).where("n > 2")


@query("ctl_context_budget", "SELECT conv_id, turn FROM conversations QUALIFY sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn) <= 400")
def _(t):
    run = F.sum(F.length("text")).over(W.partitionBy("conv_id").orderBy("turn"))
    return t.conversations.withColumn("used", run).where("used <= 400").select("conv_id", "turn")


@query("call_dedup", f"SELECT conv_id, turn FROM (SELECT conv_id, turn, call, lag(call) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM {CALLS}) WHERE before IS DISTINCT FROM call")
def _(t):
    before = F.lag("call").over(W.partitionBy("conv_id").orderBy("turn"))
    return t.values(CALLS).withColumn("before", before).where(~F.col("before").eqNullSafe(F.col("call"))).select("conv_id", "turn")


_EV = {
    "ev_tool_protocol": ("round(avg((parsed)::INT), 9)", lambda: F.round(F.avg(F.col("parsed").cast("int")), 9)),
    "ev_tool_name": ("round(avg((name IS NOT DISTINCT FROM expected)::INT), 9)", lambda: F.round(F.avg(F.col("name").eqNullSafe(F.col("expected")).cast("int")), 9)),
    "ev_tool_args": ("round(avg(coalesce(valid, false)::INT), 9)", lambda: F.round(F.avg(F.col("valid").cast("int")), 9)),
}
for _name, (_sql, _f) in _EV.items():
    query(_name, f"SELECT {_sql} AS value FROM ({_VALID}) JOIN {CALLS.replace('AS c(conv_id, turn', 'AS e(conv_id, turn')} USING (conv_id, turn)")(
        lambda t, f=_f: TL.validate(TL.parse_calls(t.values(CALLS)), t.values(REGISTRY)).agg(f().alias("value"))
    )


@query("ev_tool_exec", f"SELECT conv_id, bool_and(status = 'ok') AS all_ok, count(*) FILTER (WHERE status = 'error' AND next = 'ok')::BIGINT AS recovered FROM (SELECT *, lead(status) OVER (PARTITION BY conv_id ORDER BY turn) AS next FROM {CALLS}) GROUP BY conv_id")
def _(t):
    c = t.values(CALLS).withColumn("next", F.lead("status").over(W.partitionBy("conv_id").orderBy("turn")))
    return c.groupBy("conv_id").agg(F.bool_and(F.col("status") == "ok").alias("all_ok"), F.count_if((F.col("status") == "error") & (F.col("next") == "ok")).alias("recovered"))
