"""Queries over events, conversations and the star schema: usage, dialogues, JSON fields, spans and relational work."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from millrace.functions import json_fields as J
from millrace.functions import vectors as V
from millrace.operators import export, judging, lines, tables, training_tokens
from millrace.plans.registry import register, table
from millrace.session import shared_dir
from millrace.streaming import incremental, jobs, rounds


@register(
    "monthly_usage",
    """WITH s AS (SELECT strftime(ts, '%Y-%m') AS month, count(*) AS calls, CAST(coalesce(sum(CAST(floor(value) AS BIGINT)), 0) AS BIGINT) AS tokens FROM events GROUP BY 1)
       SELECT month, calls, tokens, round(tokens / 1000.0 * 0.0035, 4) AS cost, round(tokens * 100.0 / 100000, 2) AS percent, tokens >= 100000 AS halted FROM s""",
)
def monthly_usage(spark, sf_dir):
    """AG-04, AG-05, FLT-33, ST-07."""
    usage = table(spark, sf_dir, "events").select("ts", F.floor("value").cast("long").alias("tokens"))
    return judging.budget(usage, 100_000).withColumn("cost", F.col("cost").cast("double")).withColumn("percent", F.col("percent").cast("double"))


@register(
    "unit_counts_pivot",
    """SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) FILTER (event_type = 'view') AS "view", count(*) FILTER (event_type = 'click') AS click, count(*) FILTER (event_type = 'error') AS error FROM events GROUP BY 1""",
)
def unit_counts_pivot(spark, sf_dir):
    """AG-07: counts of fixed kinds as columns, zero-filled."""
    days = table(spark, sf_dir, "events").select(F.date_format("ts", "yyyy-MM-dd").alias("day"), "event_type")
    return days.groupBy("day").pivot("event_type", ["view", "click", "error"]).agg(F.count(F.lit(1))).na.fill(0)


@register("props_total", "SELECT event_type, CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS total, count(*) AS n FROM events GROUP BY event_type")
def props_total(spark, sf_dir):
    """JS-01, JS-07: a field of the JSON column summed by type."""
    rows = table(spark, sf_dir, "events").select("event_type", F.try_element_at(J.attributes(F.col("props")), F.lit("k")).try_cast("long").alias("k"))
    return rows.groupBy("event_type").agg(F.sum("k").alias("total"), F.count("*").alias("n"))


@register("latest_state", "SELECT user_id, arg_max(event_type, (ts, event_id)) AS state, max(event_id) FILTER (true) IS NOT NULL AS seen FROM events GROUP BY user_id")
def latest_state(spark, sf_dir):
    """ST-06, SNK-02, WN-15: of each job the last state, reduced before the shuffle."""
    last = tables.last_wins(table(spark, sf_dir, "events").select("user_id", "event_type", "ts", "event_id"), ["user_id"], ["ts", "event_id"])
    return last.select("user_id", F.col("event_type").alias("state"), F.col("event_id").isNotNull().alias("seen"))


# A log of jobs from the events: 40 queues, a job a user. Seconds since 1970 in the SQL.
_JOB_LOG = {
    "queue": "concat('q', user_id % 40)",
    "at": "ts",
    "seq": "event_id",
    "action": "CASE WHEN event_type IN ('signup', 'purchase') THEN 'submit' WHEN event_type = 'error' THEN 'delete' ELSE 'status' END",
    "job_id": "concat('j', user_id)",
    "state": "CASE event_type WHEN 'view' THEN 'JOB_STATE_RUNNING' WHEN 'click' THEN 'JOB_STATE_SUCCEEDED' END",
    "force": "event_type = 'purchase' AND event_id % 5 = 0",
}
_TTL = 6 * 3600
_JOB_SQL = f"""
WITH log AS (SELECT {", ".join(f"{e} AS {c}" for c, e in _JOB_LOG.items() if c != "at")}, CAST(epoch(date_trunc('second', ts)) AS BIGINT) AS tm FROM events),
lists AS (SELECT queue, list({{'tm': tm, 'seq': seq, 'action': action, 'job_id': job_id, 'state': state, 'force': force}} ORDER BY tm, seq) AS es FROM log GROUP BY queue),
closed AS (SELECT queue, list_append(es, {{'tm': (SELECT max(tm) FROM log), 'seq': CAST(NULL AS BIGINT), 'action': 'end', 'job_id': '', 'state': CAST(NULL AS VARCHAR), 'force': false}}) AS es FROM lists),
folded AS (SELECT queue, list_reduce(es, lambda s, e: list_transform([{{
      'jobs': list_transform(s.jobs, lambda j: CASE WHEN j.active AND j.heard + {_TTL} <= e.tm THEN {{'id': j.id, 'state': 'EXPIRED', 'active': false, 'heard': j.heard + {_TTL}, 'no': j.no}} ELSE j END),
      'out': s.out || list_sort(list_transform(list_filter(s.jobs, lambda j: j.active AND j.heard + {_TTL} <= e.tm), lambda j: {{'tm': j.heard + {_TTL}, 'no': j.no, 'seq': CAST(NULL AS BIGINT), 'job_id': j.id, 'result': 'expired', 'state': 'EXPIRED'}})),
      'last': 0}}], lambda t: CASE
    WHEN e.action = 'end' THEN t
    WHEN e.action = 'submit' AND NOT e.force AND len(list_filter(t.jobs, lambda j: j.active)) > 0
      THEN {{'jobs': t.jobs, 'out': t.out || list_transform(list_sort(list_transform(list_filter(t.jobs, lambda j: j.active), lambda j: {{'no': j.no, 'id': j.id, 'state': j.state}}), 'DESC')[1:1], lambda j: {{'tm': e.tm, 'no': 0, 'seq': e.seq, 'job_id': j.id, 'result': 'active_job_exists', 'state': j.state}}), 'last': 0}}
    WHEN e.action = 'submit'
      THEN {{'jobs': list_filter(t.jobs, lambda j: j.id <> e.job_id) || [{{'id': e.job_id, 'state': 'PENDING', 'active': true, 'heard': e.tm, 'no': coalesce(list_max(list_transform(t.jobs, lambda j: j.no)), 0) + 1}}],
             'out': t.out || [{{'tm': e.tm, 'no': 0, 'seq': e.seq, 'job_id': e.job_id, 'result': 'submitted', 'state': 'PENDING'}}], 'last': 0}}
    WHEN len(list_filter(t.jobs, lambda j: j.id = e.job_id)) = 0
      THEN {{'jobs': t.jobs, 'out': t.out || [{{'tm': e.tm, 'no': 0, 'seq': e.seq, 'job_id': e.job_id, 'result': 'not_found', 'state': CAST(NULL AS VARCHAR)}}], 'last': 0}}
    WHEN e.action = 'delete'
      THEN {{'jobs': list_filter(t.jobs, lambda j: j.id <> e.job_id), 'out': t.out || list_transform(list_filter(t.jobs, lambda j: j.id = e.job_id), lambda j: {{'tm': e.tm, 'no': 0, 'seq': e.seq, 'job_id': j.id, 'result': 'deleted', 'state': j.state}}), 'last': 0}}
    ELSE {{'jobs': list_transform(t.jobs, lambda j: CASE WHEN j.id = e.job_id AND j.active THEN {{'id': j.id, 'state': CASE e.state WHEN 'JOB_STATE_SUCCEEDED' THEN 'COMPLETED' ELSE e.state END, 'active': e.state <> 'JOB_STATE_SUCCEEDED', 'heard': e.tm, 'no': j.no}} ELSE j END),
           'out': t.out || list_transform(list_filter(t.jobs, lambda j: j.id = e.job_id), lambda j: {{'tm': e.tm, 'no': 0, 'seq': e.seq, 'job_id': j.id, 'result': CASE WHEN j.active THEN 'updated' ELSE 'unchanged' END,
             'state': CASE WHEN NOT j.active THEN j.state WHEN e.state = 'JOB_STATE_SUCCEEDED' THEN 'COMPLETED' ELSE e.state END}}), 'last': 0}}
    END)[1], {{'jobs': CAST([] AS STRUCT(id VARCHAR, state VARCHAR, active BOOLEAN, heard BIGINT, no BIGINT)[]), 'out': CAST([] AS STRUCT(tm BIGINT, no BIGINT, seq BIGINT, job_id VARCHAR, result VARCHAR, state VARCHAR)[]), 'last': 0}}) AS s FROM closed)
SELECT queue, o.tm AS at_seconds, o.seq AS seq, o.job_id AS job_id, o.result AS result, o.state AS state FROM (SELECT queue, unnest(s.out) AS o FROM folded)"""


@register("job_states", _JOB_SQL)
def job_states(spark, sf_dir):
    """ST-06: what becomes of every job of the log, with refusals, expiries and deletions."""
    log = table(spark, sf_dir, "events").selectExpr(*[f"{e} AS {c}" for c, e in _JOB_LOG.items()])
    return jobs.replay_jobs(log, _TTL).select("queue", F.unix_timestamp("at").alias("at_seconds"), "seq", "job_id", "result", "state")


@register("stream_job_states", _JOB_SQL)
def stream_job_states(spark, sf_dir):
    """ST-06: the same by a stream that keeps jobs and waiting events in its state and wakes itself by timers."""
    base = f"{shared_dir(spark)}/jobs-{uuid.uuid4().hex}"
    stream = incremental.follow(spark, f"{sf_dir}/events.parquet", table(spark, sf_dir, "events").schema)
    found = jobs.follow_jobs(stream.selectExpr(*[f"{e} AS {c}" for c, e in _JOB_LOG.items()]), _TTL)
    found.writeStream.format("parquet").option("checkpointLocation", f"{base}/state").option("path", f"{base}/out").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(jobs.RESULT).parquet(f"{base}/out").select("queue", F.unix_timestamp("at").alias("at_seconds"), "seq", "job_id", "result", "state")


@register(
    "stream_rounds",
    """WITH n AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_custkey, o_orderkey) - 1 AS rank, count(*) OVER () AS total FROM orders)
       SELECT o_orderkey, rank, rank - rank % CAST(ceil(total / 6.0) AS BIGINT) AS start FROM n""",
)
def stream_rounds(spark, sf_dir):
    """ST-04, ST-09: orders worked off in six rounds by two starts of a stream; the second one resumes at the first's next index."""
    base = f"{shared_dir(spark)}/rounds-{uuid.uuid4().hex}"
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey")
    total = rounds.numbered(orders, ["o_custkey", "o_orderkey"], f"{base}/numbered")

    def work(rows, start, stop):
        rows.select("o_orderkey", "rank", F.lit(start).cast("long").alias("start")).write.mode("overwrite").parquet(f"{base}/out/round={start}")

    for most in (2, 0):
        query = rounds.run_rounds(spark, f"{base}/numbered", orders.schema, total, work, f"{base}/state", limit=max(1, -(-total // 6)), max_rounds=most)
        query.processAllAvailable()
        query.stop()
    done = "o_orderkey long, rank long, start long"
    return spark.read.schema(done).parquet(f"{base}/out").select("o_orderkey", "rank", "start") if total else spark.createDataFrame([], done)


@register(
    "daily_windows",
    "SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2",
)
def daily_windows(spark, sf_dir):
    """Event-time windows as a batch."""
    return incremental.windowed_usage(table(spark, sf_dir, "events")).withColumn("start", F.col("start").cast("timestamp_ntz"))


@register("stream_daily_windows", "SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2")
def stream_daily_windows(spark, sf_dir):
    """ST-01, ST-05: the same windows by a stream that reads all there is, keeps its state and ends."""
    schema = table(spark, sf_dir, "events").schema
    base = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    stream = incremental.follow(spark, f"{sf_dir}/events.parquet", schema)
    sums = incremental.windowed_usage(stream)
    query = incremental.run_state(sums, f"{base}/out", f"{base}/state")
    query.awaitTermination()
    versions = spark.read.parquet(f"{base}/out")
    last = tables.last_wins(versions, ["start", "event_type"], ["batch"])
    return last.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", "total")


_MESSAGES = "m AS (SELECT conv_id, list({'turn': turn, 'role': role, 'text': coalesce(text, '')} ORDER BY turn, role, text) AS ms FROM conversations GROUP BY conv_id)"


def _messages(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", F.struct("turn", "role", F.coalesce("text", F.lit("")).alias("text")).alias("t"))
    turns = F.transform(F.sort_array(F.collect_list("t")), lambda t: F.struct(t["role"].alias("role"), t["text"].alias("content")))
    return rows.groupBy("conv_id").agg(turns.alias("messages"))


@register("chat_messages", f"WITH {_MESSAGES} SELECT conv_id, CAST(len(ms) AS INTEGER) AS turns, list_aggregate(list_transform(ms, lambda x: x.role), 'string_agg', ',') AS roles FROM m WHERE len(ms) >= 2")
def chat_messages(spark, sf_dir):
    """FLT-27, AG-17: dialogues of two turns at least with their roles in order."""
    found = _messages(spark, sf_dir)
    return found.where(export.valid_record(found)).select("conv_id", F.size("messages").alias("turns"), F.array_join(F.transform("messages", lambda t: t["role"]), ",").alias("roles"))


@register(
    "dialogue_four_turn",
    f"""WITH {_MESSAGES} SELECT conv_id, list_transform(ms[1:4], lambda x: x.role) = ['user', 'assistant', 'user', 'assistant'] AND len(list_filter(ms[1:4], lambda x: trim(x.text) = '')) = 0 AS strict FROM m""",
)
def dialogue_four_turn(spark, sf_dir):
    """FLT-28."""
    return _messages(spark, sf_dir).select("conv_id", export.strict_dialogue(F.col("messages")).alias("strict"))


@register("messages_by_role", "SELECT role, count(*) AS n, CAST(sum(length(coalesce(text, ''))) AS BIGINT) AS chars FROM conversations GROUP BY role")
def messages_by_role(spark, sf_dir):
    """AG-02 for dialogue turns."""
    return table(spark, sf_dir, "conversations").groupBy("role").agg(F.count("*").alias("n"), F.sum(F.length(F.coalesce("text", F.lit("")))).alias("chars"))


@register(
    "instruction_pairs",
    """WITH t AS (SELECT conv_id, turn, role, text, lead(role) OVER w AS r2, lead(text) OVER w AS t2 FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text))
       SELECT conv_id, turn, text AS instruction, t2 AS output FROM t WHERE role = 'user' AND r2 = 'assistant' AND trim(coalesce(text, '')) <> '' AND trim(coalesce(t2, '')) <> ''""",
)
def instruction_pairs(spark, sf_dir):
    """SFT records from dialogues: a user's turn and the answer that follows."""
    from pyspark.sql import Window

    w = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = table(spark, sf_dir, "conversations").withColumn("r2", F.lead("role").over(w)).withColumn("output", F.lead("text").over(w))
    return rows.where("role = 'user' AND r2 = 'assistant' AND trim(coalesce(text, '')) <> '' AND trim(coalesce(output, '')) <> ''").select("conv_id", "turn", F.col("text").alias("instruction"), "output")


@register(
    "dpo_pairs_valid",
    """WITH a AS (SELECT conv_id, list(text ORDER BY turn, text) AS l FROM conversations WHERE role = 'assistant' AND text IS NOT NULL GROUP BY conv_id)
       SELECT conv_id, CASE WHEN lower(trim(l[1])) <> lower(trim(l[2])) AND length(trim(l[1])) >= 15 AND length(trim(l[2])) >= 15 THEN 'validated' ELSE 'flagged' END AS status FROM a WHERE len(l) >= 2""",
)
def dpo_pairs_valid(spark, sf_dir):
    """FLT-26: a dialogue's first two answers as chosen and rejected."""
    answers = table(spark, sf_dir, "conversations").where("role = 'assistant' AND text IS NOT NULL")
    found = answers.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "text"))).alias("l")).where(F.size("l") >= 2)
    return found.select("conv_id", judging.preference_status(F.lit("?"), F.element_at("l", 1)["text"], F.element_at("l", 2)["text"]).alias("status"))


@register(
    "judge_priority_source",
    """WITH f AS (SELECT conv_id, min(text) FILTER (role = 'system' AND trim(text) <> '') AS s, min(text) FILTER (role = 'user' AND trim(text) <> '') AS u, min(text) FILTER (role = 'assistant' AND trim(text) <> '') AS a FROM conversations GROUP BY conv_id)
       SELECT conv_id, CASE WHEN s IS NOT NULL THEN 'tr_dpo' WHEN u IS NOT NULL THEN 'tr_sft' WHEN a IS NOT NULL THEN 'sft' END AS source FROM f""",
)
def judge_priority_source(spark, sf_dir):
    """JS-11: what a judge looks at first."""
    of = lambda role: F.min(F.when((F.col("role") == role) & (F.trim("text") != ""), F.col("text")))
    firsts = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(of("system").alias("s"), of("user").alias("u"), of("assistant").alias("a"))
    js = lambda c, k: F.when(F.col(c).isNotNull(), F.to_json(F.array(F.struct(F.lit("q").alias("question"), F.col(c).alias(k)))))
    pair = judging.priority_pair(js("s", "chosen"), F.lit("[]"), js("u", "answer"), js("a", "answer"))
    return firsts.select("conv_id", pair["source"].alias("source"))


@register(
    "rewrite_first",
    """WITH p AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, text) AS k FROM conversations WHERE text IS NOT NULL)
       SELECT conv_id, string_agg(CASE WHEN k = 1 THEN 'better: ' || text ELSE text END, '|' ORDER BY k) AS chosen FROM p GROUP BY conv_id""",
)
def rewrite_first(spark, sf_dir):
    """DM-04, JN-16: the first pair of an array gets a new answer."""
    pairs = table(spark, sf_dir, "conversations").where("text IS NOT NULL").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", F.col("text").alias("chosen")))).alias("p"))
    better = judging.rewrite_first(F.col("p"), F.concat(F.lit("better: "), F.element_at("p", 1)["chosen"]))
    return pairs.select("conv_id", F.array_join(F.transform(better, lambda x: x["chosen"]), "|").alias("chosen"))


@register(
    "ranked_answers",
    """WITH a AS (SELECT l_orderkey, l_linenumber, CAST(l_quantity AS BIGINT) AS score, l_returnflag = 'R' AS accepted FROM lineitem),
       r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY accepted DESC, score DESC, l_linenumber) AS k FROM a),
       b AS (SELECT r.l_orderkey, r.l_linenumber, r.k FROM r JOIN r t ON t.l_orderkey = r.l_orderkey AND t.k = 1 WHERE r.k > 1 AND NOT r.accepted AND t.score - r.score >= 5)
       SELECT t.l_orderkey AS question, CAST(t.l_linenumber AS INTEGER) AS chosen, CAST((SELECT arg_max(b.l_linenumber, b.k) FROM b WHERE b.l_orderkey = t.l_orderkey) AS INTEGER) AS rejected FROM r t WHERE t.k = 1""",
)
def ranked_answers(spark, sf_dir):
    """SL-04, SL-05, AG-18, AG-19: the best answer and the worst one that may be rejected."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.struct((F.col("l_returnflag") == "R").alias("accepted"), F.col("l_quantity").cast("long").alias("score"), F.col("l_linenumber").alias("body")).alias("a"))
    listed = rows.groupBy("l_orderkey").agg(F.transform(F.sort_array(F.collect_list(F.struct("l_linenumber", "a"))), lambda x: x["a"]).alias("l"))
    ranked = listed.select("l_orderkey", export.ranked_answers(F.col("l")).alias("r"))
    return ranked.select(F.col("l_orderkey").alias("question"), F.element_at("r", 1)["body"].alias("chosen"), export.rejected_answer(F.col("r"), 5)["body"].alias("rejected"))


@register(
    "interval_union",
    """WITH s AS (SELECT l_orderkey, CAST(l_quantity AS BIGINT) AS a, CAST(l_quantity AS BIGINT) + l_linenumber AS b FROM lineitem),
       m AS (SELECT *, max(b) OVER (PARTITION BY l_orderkey ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM s),
       i AS (SELECT *, sum(CASE WHEN reach IS NULL OR a > reach + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY l_orderkey ORDER BY a, b) AS k FROM m)
       SELECT l_orderkey, min(a) AS start, max(b) AS stop FROM i GROUP BY l_orderkey, k""",
)
def interval_union(spark, sf_dir):
    """WN-07: spans that overlap or touch become one."""
    spans = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_quantity").cast("long").alias("start"), (F.col("l_quantity").cast("long") + F.col("l_linenumber")).alias("stop"))
    return lines.interval_union(spans, "l_orderkey")


@register(
    "segment_lead",
    """WITH f AS (SELECT l_orderkey, CAST(l_quantity AS BIGINT) AS page, min(l_linenumber) AS l_linenumber FROM lineitem GROUP BY 1, 2),
       n AS (SELECT *, lead(page) OVER (PARTITION BY l_orderkey ORDER BY page) AS nxt FROM f)
       SELECT l_orderkey, CAST(l_linenumber AS VARCHAR) AS title, page AS start, coalesce(nxt, 51) - 1 AS stop FROM n WHERE page <= coalesce(nxt, 51) - 1""",
)
def segment_lead(spark, sf_dir):
    """WN-05, WN-16: outline nodes as segments up to the next node; of the nodes of one page the first."""
    nodes = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_linenumber").cast("string").alias("title"), F.col("l_linenumber").alias("node_no"), F.col("l_quantity").cast("long").alias("page"), F.lit(51).cast("long").alias("n_pages"))
    return lines.segments(nodes, "l_orderkey").select("l_orderkey", "title", "start", "stop")


@register(
    "lookup_join",
    """WITH l AS (SELECT n_regionkey, arg_max(n_name, n_nationkey) AS n_name FROM nation WHERE n_regionkey < 4 GROUP BY 1)
       SELECT c.c_custkey, coalesce(l.n_name, '') AS n_name FROM customer c LEFT JOIN l ON l.n_regionkey = c.c_nationkey % 5""",
)
def lookup_join(spark, sf_dir):
    """JN-07: the last nation of a region, '' where there is none."""
    nation = table(spark, sf_dir, "nation").where("n_regionkey < 4").select(F.col("n_regionkey").alias("k"), "n_name", "n_nationkey")
    customers = table(spark, sf_dir, "customer").select("c_custkey", (F.col("c_nationkey") % 5).alias("k"))
    return tables.lookup(customers, nation, "k", "n_name", "", order="n_nationkey").select("c_custkey", "n_name")


@register(
    "top_customers",
    "SELECT c.c_custkey, c.c_name, round(sum(o.o_totalprice), 2) AS total FROM customer c JOIN orders o ON o.o_custkey = c.c_custkey GROUP BY 1, 2 ORDER BY total DESC, c_custkey LIMIT 20",
)
def top_customers(spark, sf_dir):
    """SL-07, SL-08: sums are made before the join, so only a row a customer meets."""
    sums = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.round(F.sum("o_totalprice"), 2).alias("total"))
    return table(spark, sf_dir, "customer").select("c_custkey", "c_name").join(sums, "c_custkey").orderBy(F.desc("total"), "c_custkey").limit(20)


@register(
    "point_ids",
    """WITH h AS (SELECT vec_id, sha1(from_hex('6ba7b8109dad11d180b400c04fd430c8') || encode('x_chunk_' || vec_id)) AS h FROM embeddings)
       SELECT vec_id, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-'
         || CASE WHEN substr(h, 17, 1) IN ('0', '4', '8', 'c') THEN '8' WHEN substr(h, 17, 1) IN ('1', '5', '9', 'd') THEN '9' WHEN substr(h, 17, 1) IN ('2', '6', 'a', 'e') THEN 'a' ELSE 'b' END
         || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS point_id FROM h""",
)
def point_ids(spark, sf_dir):
    """MH-04: stable ids of chunks; the tests compare them with a UUID library."""
    name = F.concat(F.lit("x_chunk_"), F.col("vec_id").cast("string"))
    return table(spark, sf_dir, "embeddings").select("vec_id", V.point_id(name).alias("point_id"))


@register("token_mask_rows")
def token_mask_rows(spark, sf_dir):
    """UD-10, UD-11, CP-11: token rows of all whole dialogues with byte ids. Invariants are tested."""
    rows = training_tokens.token_rows(_messages(spark, sf_dir), "conv_id", longest=None)
    return rows.select("conv_id", "kind", "n_tokens", "n_prompt_tokens", "n_completion_tokens", "n_trainable_tokens", "truncated")
