"""Retrieval, assistant, ledger, alert and decision queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import text
from tidemark.operators import alerts, ledger, retrieval, sales, scenarios
from tidemark.plans import glossary, guard, tools
from tidemark.registry import register
from tidemark.sources import star
from tidemark.sources.star import SALES_SQL, STOCK_SQL, table

QUERY = "the thing with that and onnthe"
TERMS = retrieval.query_terms(QUERY)
_TERMS_SQL = ", ".join(f"('{t}')" for t in TERMS)
_LIST = "[" + ", ".join(f"'{t}'" for t in TERMS) + "]"


def chunks(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("text").alias("content"))


@register("tokens_df", "SELECT term, count(*) AS df FROM (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM documents) GROUP BY 1")
def tokens_df(spark, sf_dir):
    return chunks(spark, sf_dir).select(F.explode(F.array_distinct(text.tokens(F.col("content")))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))


_BM25 = f"""words AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS t FROM documents), stats AS (SELECT count(*) AS docs, avg(len(t)) AS avg_len FROM words), q(term) AS (VALUES {_TERMS_SQL}),
hits AS (SELECT doc_id, len(t) AS len, unnest(t) AS term FROM words), tf AS (SELECT doc_id, len, term, count(*) AS tf FROM hits WHERE term IN (SELECT term FROM q) GROUP BY 1, 2, 3), df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
bm AS (SELECT doc_id AS chunk_id, round(sum(ln(1 + (docs - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * (tf * 2.2::DOUBLE) / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * (len / avg_len)))), 6) AS keyword FROM tf JOIN df USING (term), stats GROUP BY 1)"""


@register("bm25", f"WITH {_BM25} SELECT * FROM bm")
def bm25(spark, sf_dir):
    return retrieval.bm25(chunks(spark, sf_dir), QUERY)


def _embed_sql(name: str, source: str) -> str:
    return f"""{name}_n AS (SELECT chunk_id, (('0x' || substr(md5(term), 31, 2))::INTEGER % 128)::INTEGER AS bucket, count(*) AS n FROM (SELECT chunk_id, unnest(regexp_extract_all(lower(content), '[a-z0-9]+')) AS term FROM {source}) GROUP BY 1, 2),
    {name} AS (SELECT chunk_id, bucket, round(n / sqrt(sum(n * n) OVER (PARTITION BY chunk_id)), 6) AS weight FROM {name}_n)"""


_CHUNKS = "chunks AS (SELECT doc_id AS chunk_id, text AS content FROM documents)"
_VECTOR = f"{_CHUNKS}, {_embed_sql('emb', 'chunks')}, qc AS (SELECT 'q' AS chunk_id, '{QUERY}' AS content), {_embed_sql('qe', 'qc')}, vec AS (SELECT e.chunk_id, round(sum(e.weight * q.weight), 6) AS vector FROM emb e JOIN qe q ON e.bucket = q.bucket GROUP BY 1)"


@register("hash_embedding", f"WITH {_CHUNKS}, {_embed_sql('emb', 'chunks')} SELECT * FROM emb")
def hash_embedding(spark, sf_dir):
    return retrieval.hash_embedding(chunks(spark, sf_dir))


_FUSED = f"""{_VECTOR}, {_BM25}, v AS (SELECT chunk_id, vector / max(vector) OVER () AS v FROM vec), k AS (SELECT chunk_id, keyword / max(keyword) OVER () AS k FROM bm),
fused AS (SELECT coalesce(v.chunk_id, k.chunk_id) AS chunk_id, round(coalesce(v, 0), 6) AS vector, round(coalesce(k, 0), 6) AS keyword, round(coalesce(v, 0) * 0.65::DOUBLE + coalesce(k, 0) * (1 - 0.65::DOUBLE), 6) AS fused
  FROM v FULL JOIN k ON v.chunk_id = k.chunk_id ORDER BY fused DESC, chunk_id LIMIT 20)"""


@register("hybrid_fusion", f"WITH {_FUSED} SELECT * FROM fused")
def hybrid_fusion(spark, sf_dir):
    return retrieval.hybrid(chunks(spark, sf_dir), QUERY, 20)


@register(
    "rerank_features",
    f"""WITH {_CHUNKS}, f AS (SELECT chunk_id, content, 0.5::DOUBLE AS fused, len(list_intersect({_LIST}, regexp_extract_all(lower(content), '[a-z0-9]+'))) / {len(TERMS)} AS c,
      CASE WHEN contains(lower(content), '{QUERY}') THEN 1.0 WHEN contains(lower(content), '{' '.join(QUERY.split()[:4])}') THEN 0.4 ELSE 0.0 END::DOUBLE AS phrase,
      CASE WHEN length(content) / 600 >= 1 THEN 1 / (length(content) / 600) ELSE length(content) / 600 END AS l FROM chunks)
    SELECT chunk_id, round(c, 4) AS coverage, phrase, round(l, 4) AS length, round(fused * 0.55::DOUBLE + c * 0.25::DOUBLE + phrase * 0.15::DOUBLE + l * 0.05::DOUBLE, 6) AS rerank FROM f""",
)
def rerank_features(spark, sf_dir):
    return retrieval.rerank(chunks(spark, sf_dir).withColumn("fused", F.lit(0.5)), QUERY).select("chunk_id", "coverage", "phrase", "length", "rerank")


@register(
    "cosine_topk",
    """WITH q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id % 50 = 0), c AS (SELECT query_id, vec_id, round(list_cosine_similarity(embedding::DOUBLE[], q), 6) AS cosine FROM q, embeddings)
    SELECT query_id, vec_id, cosine, row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, vec_id)::INTEGER AS rank FROM c QUALIFY rank <= 10""",
)
def cosine_topk(spark, sf_dir):
    """Every row whose id is divisible by 50 against all rows."""
    e = table(spark, sf_dir, "embeddings")
    return retrieval.cosine_topk_of(e, e.filter("vec_id % 50 = 0"))


@register(
    "structured_answers",
    """WITH a AS (SELECT event_id, CASE event_id % 6 WHEN 0 THEN props WHEN 1 THEN '```json' || chr(10) || props || chr(10) || '```' WHEN 2 THEN 'no object' WHEN 3 THEN 'Here: ' || props || ' done' WHEN 4 THEN '{"other": 1}' ELSE substr(props, 1, length(props) - 1) END AS answer FROM events),
    o AS (SELECT event_id, regexp_extract(answer, '\\{.*\\}', 0, 's') AS j FROM a)
    SELECT event_id, CASE WHEN j = '' OR NOT json_valid(j) THEN 'not_json' WHEN json_extract(j, '$.k') IS NULL THEN 'missing_keys:k' END AS error, CASE WHEN j <> '' AND json_valid(j) THEN json_extract_string(j, '$.k')::BIGINT END AS k FROM o""",
)
def structured_answers(spark, sf_dir):
    """The JSON objects of answers made from the events: plain, fenced, in a sentence, without the key, cut off, or none."""
    p, i = F.col("props"), F.col("event_id") % 6
    answer = F.when(i == 0, p).when(i == 1, F.concat(F.lit("```json\n"), p, F.lit("\n```"))).when(i == 2, "no object").when(i == 3, F.concat(F.lit("Here: "), p, F.lit(" done"))).when(i == 4, '{"other": 1}').otherwise(F.left(p, F.length(p) - 1))
    got = table(spark, sf_dir, "events").select("event_id", text.parse_structured(answer, ["k"]).alias("r"))
    return got.select("event_id", F.col("r.error").alias("error"), F.try_variant_get("r.value", "$.k", "long").alias("k"))


@register(
    "masked_payload",
    """SELECT c_custkey, concat(left(c_name, 1), '***@shop', c_nationkey, '.example.com') AS email, concat('+** *** *** ', right('00' || c_custkey % 100, 2)) AS phone, concat('ask ', left(c_name, 1), '***@x.org or call ********', right('00' || c_custkey % 100, 2), ' now') AS note FROM customer""",
)
def masked_payload(spark, sf_dir):
    """A nested payload made from the customers."""
    name, two = F.regexp_replace("c_name", "#", ""), F.lpad((F.col("c_custkey") % 100).cast("string"), 2, "0")
    contact = F.create_map(F.lit("Email"), F.concat(name, F.lit("@shop"), F.col("c_nationkey").cast("string"), F.lit(".example.com")), F.lit("telp"), F.concat(F.lit("+49 301 234 "), two))
    notes = F.array(F.struct(F.concat(F.lit("ask "), name, F.lit("@x.org or call 01512345"), two, F.lit(" now")).alias("note")))
    rows = text.masked_rows(table(spark, sf_dir, "customer").select("c_custkey", contact.alias("contact"), notes.alias("notes")))
    return rows.select("c_custkey", F.col("contact")["Email"].alias("email"), F.col("contact")["telp"].alias("phone"), F.col("notes")[0]["note"].alias("note"))


@register(
    "acl_filter",
    """WITH d AS (SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN ' Public' WHEN 1 THEN 'internal' WHEN 2 THEN 'confidential' WHEN 3 THEN 'private' ELSE 'other' END AS visibility, CASE WHEN doc_id % 2 = 0 THEN source END AS owner FROM documents),
    v AS (SELECT doc_id, owner, CASE WHEN lower(trim(visibility)) IN ('public', 'internal', 'confidential', 'private') THEN lower(trim(visibility)) ELSE 'public' END AS v FROM d)
    SELECT doc_id FROM v WHERE v IN ('public', 'private') AND (v <> 'private' OR coalesce(owner = 'src3', false))""",
)
def acl_filter(spark, sf_dir):
    k = F.col("doc_id") % 5
    d = table(spark, sf_dir, "documents").select(
        "doc_id", F.when(k == 0, " Public").when(k == 1, "internal").when(k == 2, "confidential").when(k == 3, "private").otherwise("other").alias("visibility"), F.when(F.col("doc_id") % 2 == 0, F.col("source")).alias("owner")
    )
    return retrieval.allowed(d, ["public", "private"], "src3").select("doc_id")


@register("term_offsets", "WITH d AS (SELECT doc_id, lower(text) AS t FROM documents) SELECT doc_id, least(" + ", ".join(f"CASE WHEN instr(t, '{t}') > 0 THEN instr(t, '{t}') - 1 END" for t in TERMS if len(t) > 1) + ")::INTEGER AS char_start FROM d")
def term_offsets(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", retrieval.offsets(F.col("text"), QUERY).alias("char_start"))


@register(
    "chunk_text",
    f"""WITH RECURSIVE body AS (SELECT doc_id, trim(regexp_replace(coalesce(text, ''), '{retrieval.ANY_SPACE}', ' ', 'g')) AS b FROM documents), texts AS (SELECT * FROM body WHERE b <> ''),
    windows AS (
      SELECT doc_id, b, 0 AS pos, CASE WHEN 800 >= length(b) THEN length(b) ELSE 800 END AS lim FROM texts
      UNION ALL
      SELECT doc_id, b, next AS pos, least(next + 800, length(b)) AS lim FROM (SELECT doc_id, b, lim, greatest(stop - 120, pos + 1) AS next, stop FROM (
        SELECT *, CASE WHEN lim < length(b) AND dot > 0 AND lim - pos - dot - 1 > 400 THEN lim - dot ELSE lim END AS stop FROM (SELECT *, strpos(reverse(substr(b, pos + 1, lim - pos)), ' .') AS dot FROM windows))) WHERE stop < length(b)
    ),
    cut AS (SELECT *, CASE WHEN lim < length(b) AND dot > 0 AND lim - pos - dot - 1 > 400 THEN lim - dot ELSE lim END AS stop FROM (SELECT *, strpos(reverse(substr(b, pos + 1, lim - pos)), ' .') AS dot FROM windows))
    SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1)::INTEGER AS chunk_no, trim(substr(b, pos + 1, stop - pos)) AS content FROM cut WHERE trim(substr(b, pos + 1, stop - pos)) <> ''""",
)
def chunk_text(spark, sf_dir):
    return retrieval.chunk(table(spark, sf_dir, "documents"))


@register("html_strip", "SELECT page_id, trim(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g')) AS text FROM pages")
def html_strip(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", text.strip_html(F.col("html")).alias("text"))


@register(
    "conversation_last_turns",
    """WITH l AS (SELECT conv_id, turn, role FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role DESC) <= 10)
    SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role)::INTEGER AS place FROM l""",
)
def conversation_last_turns(spark, sf_dir):
    return ledger.last_turns(table(spark, sf_dir, "conversations")).select("conv_id", "turn", "role", "place")


#: An AI usage ledger from conversations: a model by conversation, tokens by length, no price for one of the models.
USAGE_SQL = """usage AS (SELECT conv_id, CASE conv_id % 3 WHEN 0 THEN 'small' WHEN 1 THEN 'large' ELSE 'local' END AS model, CASE WHEN role = 'user' THEN greatest(1, length(text) // 4) ELSE 0 END AS prompt_tokens,
  CASE WHEN role <> 'user' THEN greatest(1, length(text) // 4) ELSE 0 END AS completion_tokens, DATE '2024-01-01' + (conv_id % 60)::INTEGER AS created_at FROM conversations),
priced AS (SELECT *, CASE WHEN model = 'local' THEN NULL ELSE ((prompt_tokens + 2 * completion_tokens) * CASE WHEN model = 'small' THEN 1 ELSE 5 END / 1000.0)::DECIMAL(18,6) END AS estimated_cost FROM usage)"""
_SUMS = "count(*) AS turns, sum(prompt_tokens)::BIGINT AS prompt_tokens, sum(completion_tokens)::BIGINT AS completion_tokens, sum(prompt_tokens + completion_tokens)::BIGINT AS total_tokens, round(coalesce(sum(estimated_cost), 0), 6)::DOUBLE AS estimated_cost, count(*) FILTER (estimated_cost IS NULL) AS unpriced_rows"


def usage(spark, sf_dir):
    k, n = F.col("conv_id"), ledger.estimate_tokens(F.col("text"))
    u = table(spark, sf_dir, "conversations").select(
        "conv_id", F.when(k % 3 == 0, "small").when(k % 3 == 1, "large").otherwise("local").alias("model"), F.when(F.col("role") == "user", n).otherwise(0).alias("prompt_tokens"),
        F.when(F.col("role") != "user", n).otherwise(0).alias("completion_tokens"), F.date_add(F.lit("2024-01-01").cast("date"), (k % 60).cast("int")).alias("created_at"),
    )
    cost = (F.col("prompt_tokens") + 2 * F.col("completion_tokens")) * F.when(F.col("model") == "small", 1).otherwise(5) / 1000
    return u.withColumn("estimated_cost", F.when(F.col("model") != "local", cost.cast("decimal(18,6)")))


@register("ai_usage_totals", f"WITH {USAGE_SQL} SELECT {_SUMS} FROM priced")
def ai_usage_totals(spark, sf_dir):
    return ledger.usage_totals(usage(spark, sf_dir))


for _key, _col in {"model": "model", "day": "created_at", "conversation": "conv_id"}.items():

    @register(f"ai_usage_by_{_key}", f"WITH {USAGE_SQL} SELECT {_col}, {_SUMS} FROM priced GROUP BY 1")
    def _usage(spark, sf_dir, column=_col):
        return ledger.usage_by(usage(spark, sf_dir), column)


@register(
    "usage_recorded",
    """WITH t AS (SELECT conv_id AS conversation_id, CASE conv_id % 3 WHEN 0 THEN 'small' WHEN 1 THEN 'large' ELSE 'local' END AS model, CASE WHEN length(text) = 0 THEN 0 ELSE greatest(1, length(text) // 4) END AS prompt_tokens, CASE WHEN turn % 2 = 0 THEN turn * 10 + 5 ELSE 3 END AS completion_tokens, turn FROM conversations)
    SELECT conversation_id, model, prompt_tokens::BIGINT AS prompt_tokens, completion_tokens::BIGINT AS completion_tokens, turn AS created_at, round((prompt_tokens * p.i + completion_tokens * p.o) / 1000, 6)::DOUBLE AS estimated_cost FROM t LEFT JOIN (VALUES ('small', 0.5, 1.5), ('large', 4.0, 12.0)) p(m, i, o) ON model = m""",
)
def usage_recorded(spark, sf_dir):
    k = F.col("conv_id") % 3
    turns = table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("conversation_id"), F.when(k == 0, "small").when(k == 1, "large").otherwise("local").alias("model"), F.col("text").alias("prompt"), F.lit("some answer..").alias("answer"), F.lit(None).cast("long").alias("prompt_tokens"),
        F.when(F.col("turn") % 2 == 0, F.col("turn") * 10 + 5).alias("completion_tokens"), F.col("turn").alias("created_at"),
    )
    prices = spark.createDataFrame([("small", 0.5, 1.5), ("large", 4.0, 12.0)], "model string, input_price double, output_price double")
    return ledger.record_usage(turns, prices).withColumn("estimated_cost", F.col("estimated_cost").cast("double"))


@register(
    "document_listing",
    """WITH d AS (SELECT doc_id, source AS title, CASE doc_id % 4 WHEN 0 THEN ' Internal' WHEN 1 THEN 'private' WHEN 2 THEN NULL ELSE 'secret' END AS v, DATE '2024-01-01' + (doc_id * 7 % 100)::INTEGER AS created_at, len(string_split(text, chr(10))) AS n FROM documents)
    SELECT doc_id, title, CASE WHEN lower(trim(v)) IN ('public', 'internal', 'confidential', 'private') THEN lower(trim(v)) ELSE 'public' END AS visibility, created_at, n AS n_chunks FROM d ORDER BY created_at DESC, doc_id DESC LIMIT 100""",
)
def document_listing(spark, sf_dir):
    d, k = table(spark, sf_dir, "documents"), F.col("doc_id") % 4
    docs = d.select("doc_id", F.col("source").alias("title"), F.when(k == 0, " Internal").when(k == 1, "private").when(k == 3, "secret").alias("visibility"), F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") * 7 % 100).cast("int")).alias("created_at"))
    return ledger.documents(docs, d.select("doc_id", F.explode(F.split("text", "\n", -1)).alias("content")))


@register(
    "tool_evidence",
    f"""WITH {SALES_SQL}, t AS (SELECT strftime(transaction_date, '%Y-%m') AS period, round(sum(revenue), 2)::DOUBLE AS revenue, count(*) AS orders FROM sales WHERE transaction_date IS NOT NULL GROUP BY 1)
    SELECT 'data' AS outcome, period, revenue, orders FROM t UNION ALL SELECT 'no_data', NULL, NULL, NULL UNION ALL SELECT 'error', NULL, NULL, NULL UNION ALL SELECT 'error', NULL, NULL, NULL""",
)
def tool_evidence(spark, sf_dir):
    """Evidence of a monthly trend, read back from its JSON, and the outcomes of an empty frame, of an unknown tool and of a refused statement."""
    frame = star.sales(spark, sf_dir)
    answers = [
        tools.execute(spark, "query_sales", {"sales": frame}, {"granularity": "monthly"}), tools.execute(spark, "get_kpi", {"sales": frame.limit(0)}), tools.execute(spark, "nothing", {}),
        tools.execute(spark, "query_sql", {}, {"sql": "SELECT * FROM secret"}, {"orders"}),
    ]
    read = F.from_json("evidence", "period string, revenue double, orders long")
    out = tools.evidence(answers[0].data).select(F.lit(answers[0].outcome).alias("outcome"), read.alias("r")).select("outcome", "r.*")
    return out.unionByName(spark.createDataFrame([(a.outcome,) for a in answers[1:]], "outcome string"), allowMissingColumns=True)


@register("budget_gate", f"WITH {USAGE_SQL} SELECT round(coalesce(sum(estimated_cost), 0), 6)::DOUBLE AS spent, 10.0::DOUBLE AS budget, coalesce(sum(estimated_cost), 0) >= 10 AS blocked FROM priced WHERE created_at >= DATE '2024-02-15' - 30")
def budget_gate(spark, sf_dir):
    return ledger.budget_gate(usage(spark, sf_dir), 10.0, "2024-02-15")


_JOBS = "jobs AS (SELECT CASE event_type WHEN 'purchase' THEN 'done' WHEN 'click' THEN 'running' ELSE event_type END AS status, ts AS started_at FROM events)"


@register(
    "job_status_reconcile",
    f"""WITH {_JOBS} SELECT status, count(*) AS jobs, count(*) FILTER (status = 'running' AND epoch(TIMESTAMP '2024-01-31' - date_trunc('second', started_at)) / 3600 > 24) AS stuck,
    count(*) FILTER (epoch(TIMESTAMP '2024-01-31' - date_trunc('second', started_at)) / 3600 BETWEEN 0 AND 24) AS last_day FROM jobs GROUP BY 1""",
)
def job_status_reconcile(spark, sf_dir):
    e = F.col("event_type")
    jobs = table(spark, sf_dir, "events").select(F.when(e == "purchase", "done").when(e == "click", "running").otherwise(e).alias("status"), F.col("ts").alias("started_at"))
    return ledger.job_status(jobs, "2024-01-31 00:00:00")


@register("latest_event_status", "SELECT user_id, arg_max(event_type, event_id) AS status FROM events GROUP BY 1")
def latest_event_status(spark, sf_dir):
    return ledger.latest(table(spark, sf_dir, "events"), "user_id", ["event_id"], "event_type", "status")


@register("next_version", "SELECT event_type AS model, 'v' || (max(user_id % 20) + 1) AS next_version FROM events GROUP BY 1")
def next_version(spark, sf_dir):
    v = table(spark, sf_dir, "events").select(F.col("event_type").alias("model"), F.concat(F.lit("v"), (F.col("user_id") % 20).cast("string")).alias("version"))
    return ledger.next_version(v)


@register("experiment_ranking", "SELECT p_partkey AS run_id, CASE WHEN p_partkey % 6 <> 0 THEN p_retailprice END AS score, row_number() OVER (ORDER BY CASE WHEN p_partkey % 6 <> 0 THEN p_retailprice END DESC NULLS LAST, p_partkey)::INTEGER AS rank FROM part")
def experiment_ranking(spark, sf_dir):
    runs = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("run_id"), F.when(F.col("p_partkey") % 6 != 0, F.col("p_retailprice")).alias("score"))
    return ledger.rank_experiments(runs, "score")


_OBS = """obs AS (SELECT event_type AS rule, ts::DATE AS "at", sum(value::DECIMAL(18,4)) > 5000 AS fires FROM events GROUP BY 1, 2),
acts AS (SELECT *, CASE WHEN fires AND NOT coalesce(lag(fires) OVER w, false) THEN 'open' WHEN fires THEN 'keep' WHEN coalesce(lag(fires) OVER w, false) THEN 'resolve' ELSE 'none' END AS action FROM obs WINDOW w AS (PARTITION BY rule ORDER BY "at"))"""


def observations(spark, sf_dir):
    g = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("rule"), F.col("ts").cast("date").alias("at")).agg(F.sum(F.col("value").cast("decimal(18,4)")).cast("double").alias("v"))
    return g.select("rule", "at", alerts.fires(F.col("v"), F.lit(">"), F.lit(5000.0)).alias("fires"))


@register("alert_transitions", f"WITH {_OBS} SELECT * FROM acts")
def alert_transitions(spark, sf_dir):
    return alerts.transitions(observations(spark, sf_dir))


@register(
    "alert_episodes",
    f"""WITH {_OBS}, e AS (SELECT *, sum((action = 'open')::INTEGER) OVER (PARTITION BY rule ORDER BY "at") AS episode FROM acts)
    SELECT rule, min("at") AS opened_at, max(CASE WHEN action = 'resolve' THEN "at" END) AS resolved_at, count(*) FILTER (fires) AS observations FROM e WHERE action <> 'none' GROUP BY rule, episode""",
)
def alert_episodes(spark, sf_dir):
    return alerts.episodes(observations(spark, sf_dir))


def _two_days(spark, sf_dir):
    return alerts.trailing(star.sales(spark, sf_dir))


_ALERT_VALUES = f"""{SALES_SQL}, {STOCK_SQL}, w AS (SELECT * FROM sales WHERE transaction_date >= (SELECT max(transaction_date) FROM sales) - 1),
b AS (SELECT branch_name, round(sum(revenue), 2)::DOUBLE AS r FROM w GROUP BY 1),
o AS (SELECT revenue, row_number() OVER (ORDER BY transaction_date NULLS LAST, order_key, line_number, revenue) AS i, count(*) OVER () AS n FROM w),
h AS (SELECT coalesce(sum(revenue) FILTER (i <= n // 2), 0) AS r1, coalesce(sum(revenue) FILTER (i > n // 2), 0) AS r2 FROM o),
f AS (SELECT sum(greatest(revenue, 0))::DECIMAL(38, 6) AS rev, sum(greatest(quantity::DECIMAL(12, 2) * coalesce(cost_price, 0), 0))::DECIMAL(38, 6) AS cogs FROM w),
newest AS (SELECT product_name, sum(stock_qty) AS q FROM (SELECT *, max(snapshot_date) OVER (PARTITION BY product_name) AS m FROM stock) WHERE snapshot_date = m GROUP BY 1),
span AS (SELECT least(30, greatest(1, max(transaction_date) - min(transaction_date) + 1)) AS days FROM w),
d AS (SELECT product_name, sum(quantity) / (SELECT days FROM span) AS a FROM w GROUP BY 1),
health AS (SELECT q, coalesce(a, 0) AS a, CASE WHEN q <= 0 THEN 0.0 WHEN coalesce(a, 0) > 0 THEN q / a ELSE 999.0 END AS days FROM newest LEFT JOIN d USING (product_name)),
inv AS (SELECT count(*) FILTER (q <= 0 OR days <= 7)::DOUBLE AS low, count(*) FILTER (a = 0 AND q > 0)::DOUBLE AS dead, coalesce(min(round(days, 2)), 0)::DOUBLE AS least FROM health),
k AS (SELECT round(sum(revenue), 2)::DOUBLE AS r, count(*)::DOUBLE AS n, round(sum(quantity), 2)::DOUBLE AS u, round(sum(revenue)::DOUBLE / count(*), 2) AS aov FROM w),
vals AS (SELECT unnest(['sales.revenue', 'sales.orders', 'sales.units', 'sales.aov', 'sales.growth_pct', 'branch.revenue_max', 'branch.count', 'inventory.stockout_count', 'inventory.dead_stock_count', 'inventory.min_days_of_stock', 'finance.net_profit', 'finance.margin_pct']) AS metric,
  unnest([r, n, u, aov, (SELECT CASE WHEN r1 <> 0 THEN round((r2 - r1)::DOUBLE / r1::DOUBLE * 100, 2) ELSE 0 END FROM h), (SELECT max(r) FROM b), (SELECT count(*)::DOUBLE FROM b), (SELECT low FROM inv), (SELECT dead FROM inv), (SELECT least FROM inv),
  (SELECT round(rev - cogs, 2)::DOUBLE FROM f), (SELECT CASE WHEN rev <> 0 THEN round((rev - cogs)::DOUBLE / rev::DOUBLE * 100, 2) ELSE 0 END FROM f)]) AS value FROM k)"""


@register("alert_metrics", f"WITH {_ALERT_VALUES} SELECT * FROM vals")
def alert_metrics(spark, sf_dir):
    return alerts.metric_values(_two_days(spark, sf_dir), star.stock(spark, sf_dir))


@register(
    "alert_rules_evaluated",
    f"""WITH {_ALERT_VALUES}, rules(rule, metric, condition, threshold, active) AS (VALUES ('few branches', 'branch.count', 'below', '1000', true), ('dead stock', 'inventory.dead_stock_count', '>=', '1', true), ('bad metric', 'sales.nothing', '>', '0', true),
      ('bad condition', 'sales.revenue', 'about', '0', true), ('bad threshold', 'sales.revenue', '>', 'many', true), ('no revenue', 'sales.revenue', 'lte', '0', true), ('off', 'sales.orders', '>', '0', false))
    SELECT rule, r.metric, value, CASE rule WHEN 'few branches' THEN value < 1000 WHEN 'dead stock' THEN value >= 1 WHEN 'no revenue' THEN value <= 0 ELSE false END AS fires,
      CASE r.metric WHEN 'branch.count' THEN 'low' WHEN 'inventory.dead_stock_count' THEN 'medium' WHEN 'sales.revenue' THEN 'high' END AS severity,
      CASE rule WHEN 'bad metric' THEN 'unknown metric' WHEN 'bad condition' THEN 'unknown condition' WHEN 'bad threshold' THEN 'threshold is no number' END AS error
    FROM rules r LEFT JOIN vals v ON r.metric = v.metric WHERE active""",
)
def alert_rules_evaluated(spark, sf_dir):
    rules = [
        ("few branches", "branch.count", "below", "1000", True), ("dead stock", "inventory.dead_stock_count", ">=", "1", True), ("bad metric", "sales.nothing", ">", "0", True),
        ("bad condition", "sales.revenue", "about", "0", True), ("bad threshold", "sales.revenue", ">", "many", True), ("no revenue", "sales.revenue", "lte", "0", True), ("off", "sales.orders", ">", "0", False),
    ]
    frame = spark.createDataFrame(rules, "rule string, metric string, condition string, threshold string, is_active boolean")
    return alerts.evaluate(frame, alerts.metric_values(_two_days(spark, sf_dir), star.stock(spark, sf_dir)))


#: Evidence by customer from the orders: rows in which every rule fires for some and not for others.
_EVIDENCE = """ev AS (SELECT o_custkey AS case_id, (sum(p) FILTER (o_orderpriority IN ('1-URGENT', '2-HIGH')) - sum(p) FILTER (o_orderpriority NOT IN ('1-URGENT', '2-HIGH')))::DOUBLE AS diff, sum(p)::DOUBLE AS whole,
  count(*) AS n, count(*) FILTER (o_orderstatus = 'F') AS odd, count(*) FILTER (p < 100000) AS risky FROM (SELECT *, o_totalprice::DECIMAL(18, 2) AS p FROM orders) GROUP BY 1),
e AS (SELECT case_id, round(coalesce(diff, 0) / whole * 100, 1) AS growth_pct, CASE o.n % 3 WHEN 0 THEN 'crit' WHEN 1 THEN 'warn' ELSE 'ok' END AS margin_status, n AS n_points, odd AS n_anomalies, round(odd / n, 4) AS peak_score, n AS n_segments, risky AS n_risky,
  100.0::DOUBLE AS first_yhat, (100 - n)::DOUBLE AS last_yhat, round(least(1.0, n / 30), 3)::DOUBLE AS kc, round(least(0.9, 0.4 + n / 60), 3)::DOUBLE AS ac, 0.75::DOUBLE AS fc, round(least(1.0, n / 20), 3)::DOUBLE AS mc FROM ev o)"""


@register(
    "decision_scores",
    f"""WITH {_EVIDENCE}, rules AS (
      SELECT case_id, 'revenue_drop_rule' AS rule, growth_pct < -5 AS fired, least(1.0, abs(growth_pct) / 20) AS sev, kc AS confidence FROM e
      UNION ALL SELECT case_id, 'margin_crit_rule', margin_status IN ('crit', 'warn'), CASE margin_status WHEN 'crit' THEN 0.9 ELSE 0.5 END, kc FROM e
      UNION ALL SELECT case_id, 'anomaly_spike_rule', n_anomalies > 0, least(1.0, 0.5::DOUBLE * least(1.0, n_anomalies / greatest(n_points, 1) * 5) + 0.5::DOUBLE * least(1.0, peak_score)), ac FROM e
      UNION ALL SELECT case_id, 'churn_risk_rule', n_risky > 0, least(1.0, 0.3::DOUBLE + 0.7::DOUBLE * n_risky / greatest(n_segments, 1)), mc FROM e
      UNION ALL SELECT case_id, 'forecast_decline_rule', (first_yhat - last_yhat) / first_yhat * 100 >= 5, least(1.0, (first_yhat - last_yhat) / first_yhat * 100 / 30), fc FROM e
    ), s AS (SELECT case_id, rule, fired, round(CASE WHEN fired THEN sev ELSE 0 END::DOUBLE, 3) AS severity, confidence FROM rules)
    SELECT case_id, rule, fired, severity, confidence, CASE WHEN fired THEN round(100 * (0.6::DOUBLE * severity + 0.4::DOUBLE * confidence), 2) ELSE 0 END::DOUBLE AS score FROM s""",
)
def decision_scores(spark, sf_dir):
    """The five decision rules over evidence rows made from every customer's orders."""
    price, high = F.col("o_totalprice").cast("decimal(18,2)"), F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")
    g = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("case_id")).agg(
        (F.sum(F.when(high, price)) - F.sum(F.when(~high, price))).cast("double").alias("diff"), F.sum(price).cast("double").alias("whole"), F.count(F.lit(1)).alias("n"), F.count_if(F.col("o_orderstatus") == "F").alias("odd"), F.count_if(price < 100000).alias("risky")
    )
    conf = lambda c, most: F.round(F.least(F.lit(most), c), 3)
    e = g.select(
        "case_id", F.round(F.coalesce("diff", F.lit(0.0)) / F.col("whole") * 100, 1).alias("growth_pct"), F.when(F.col("n") % 3 == 0, "crit").when(F.col("n") % 3 == 1, "warn").otherwise("ok").alias("margin_status"), F.col("n").alias("n_points"),
        F.col("odd").alias("n_anomalies"), F.round(F.col("odd") / F.col("n"), 4).alias("peak_score"), F.col("n").alias("n_segments"), F.col("risky").alias("n_risky"), F.lit(100.0).alias("first_yhat"), (100 - F.col("n")).cast("double").alias("last_yhat"),
        conf(F.col("n") / 30, 1.0).alias("kpi_confidence"), conf(0.4 + F.col("n") / 60, 0.9).alias("anomaly_confidence"), conf(F.col("n") / 20, 1.0).alias("ml_confidence"), F.lit(0.75).alias("forecast_confidence"),
    )
    return scenarios.decisions(e, "case_id")


@register("guarded_sql_limit", "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0) ORDER BY o_orderkey LIMIT 200")
def guarded_sql_limit(spark, sf_dir):
    """No limit of its own (the inner one does not count): the default is added."""
    for t in ("orders", "customer"):
        table(spark, sf_dir, t).createOrReplaceTempView(f"guarded_{t}")
    sql = """WITH good AS (SELECT c_custkey FROM guarded_customer WHERE c_acctbal > 0 LIMIT 100000000)
             SELECT o_orderkey, o_orderstatus FROM guarded_orders WHERE o_custkey IN (SELECT c_custkey FROM good) ORDER BY o_orderkey; -- drop"""
    return guard.run(spark, sql, {"guarded_orders", "guarded_customer"})


@register("guarded_sql_lowered_limit", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 5000")
def guarded_sql_lowered_limit(spark, sf_dir):
    table(spark, sf_dir, "orders").createOrReplaceTempView("guarded_orders")
    return guard.run(spark, "SELECT o_orderkey, o_totalprice FROM guarded_orders ORDER BY o_orderkey LIMIT 999999", {"guarded_orders"})


def _glossary_sql() -> str:
    hit = lambda m: "CASE WHEN regexp_matches(q, '(^|\\W)(" + "|".join(glossary.METRICS[m]) + f")($|\\W)') THEN '{m}' END"
    hits = ", ".join(hit(m) for m in sorted(glossary.METRICS))
    return f"""SELECT doc_id, array_to_string(list_slice(list_filter([{hits}], lambda x: x IS NOT NULL), 1, 4), ',') AS metrics FROM (SELECT doc_id, lower({_QUESTION_SQL}) AS q FROM documents)"""


#: A question for each document, with words of the glossary chosen by its id, some of them glued to other letters.
_WORDS = [a for m in glossary.METRICS.values() for a in m]
_QUESTION_SQL = "concat('How is ', " + ", ' and ', ".join(f"[{', '.join(repr(w) for w in _WORDS)}][(doc_id * {k} + {k}) % {len(_WORDS)} + 1], CASE WHEN doc_id % {k} = 0 THEN 'x' ELSE '' END" for k in (7, 5, 3, 11, 13)) + ", '?')"


@register("glossary_match", _glossary_sql())
def glossary_match(spark, sf_dir):
    pick = F.array(*[F.lit(w) for w in _WORDS])
    parts = [F.lit("How is ")]
    for i, k in enumerate((7, 5, 3, 11, 13)):
        at = ((F.col("doc_id") * k + k) % len(_WORDS)).cast("int")
        parts += ([F.lit(" and ")] if i else []) + [F.get(pick, at), F.when(F.col("doc_id") % k == 0, "x").otherwise("")]
    questions = table(spark, sf_dir, "documents").select("doc_id", F.concat(*parts, F.lit("?")).alias("text"))
    return glossary.match(questions).select("doc_id", F.array_join("metrics", ",").alias("metrics"))
