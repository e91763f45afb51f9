"""Queries over evaluation results, training logs and training arithmetic."""

from __future__ import annotations

from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.operators import clean, evals, quality, tokens, training
from textloom.plans.base import query
from textloom.sources import collectors, config, sinks
from textloom.sources.tables import literal, table, work_path

_ANSWERS = "SELECT doc_id, quality, toxic, 'answer: ' || CASE WHEN quality = 1 THEN 'B' ELSE 'none' END AS a, CASE WHEN toxic = 1 THEN 'C or B' ELSE 'B.' END AS b FROM labels"


def answers(spark, sf_dir):
    """Two tracks' answers to a question whose answer is B, from the labels."""
    labels = table(spark, sf_dir, "labels")
    a = F.concat(F.lit("answer: "), F.when(F.col("quality") == 1, "B").otherwise("none"))
    return labels.select("doc_id", a.alias("a"), F.when(F.col("toxic") == 1, "C or B").otherwise("B.").alias("b"))


_MCQ = f"""SELECT track, count(*) FILTER (choice = 'B') AS correct, count(*) AS total, count(*) FILTER (choice = 'B') / count(*) AS accuracy FROM (
SELECT 'A' AS track, coalesce(nullif(regexp_extract(a, '[A-D]'), ''), '?') AS choice FROM ({_ANSWERS}) UNION ALL
SELECT 'B', coalesce(nullif(regexp_extract(b, '[A-D]'), ''), '?') FROM ({_ANSWERS})) GROUP BY 1"""


@query(_MCQ)
def mcq_accuracy(spark, sf_dir):
    rows = answers(spark, sf_dir).select(F.explode(F.array(*(F.struct(F.lit(t.upper()).alias("track"), evals.choice_of(F.col(t)).alias("choice")) for t in "ab"))).alias("r")).select("r.*")
    return evals.accuracy(rows, F.col("choice") == "B", "track")


@query(f"""WITH m AS ({_MCQ}), x AS (SELECT (SELECT accuracy FROM m WHERE track = 'A') AS a, (SELECT accuracy FROM m WHERE track = 'B') AS b)
SELECT CASE WHEN a > b THEN 'A' WHEN b > a THEN 'B' ELSE 'tie' END AS winner, round(a - b, 4) AS diff FROM x""")
def track_winner(spark, sf_dir):
    one = mcq_accuracy(spark, sf_dir).agg(F.max(F.when(F.col("track") == "A", F.col("accuracy"))).alias("a"), F.max(F.when(F.col("track") == "B", F.col("accuracy"))).alias("b"))
    better, diff = evals.winner(F.col("a"), F.col("b"))
    return one.select(better.alias("winner"), diff.alias("diff"))


@query("SELECT item_id, text || chr(10) || 'A. yes' || chr(10) || 'B. ' || item_id AS prompt FROM benchmark")
def choice_prompts(spark, sf_dir):
    options = F.create_map(F.lit("A"), F.lit("yes"), F.lit("B"), F.col("item_id").cast("string"))
    return table(spark, sf_dir, "benchmark").select("item_id", evals.choice_prompt(F.col("text"), options).alias("prompt"))


_THOUGHTS = """SELECT CASE WHEN turn % 2 = 0 THEN 'A' ELSE 'B' END AS track, CASE WHEN turn % 3 = 0 THEN 'plain ' ELSE '<thinking>' || role || '</thinking>' END || CASE WHEN conv_id % 2 = 0 THEN 'no' ELSE coalesce(text, '') END AS a FROM conversations"""
_TAIL = T.sql_strip("CASE WHEN contains(a, '</thinking>') THEN substr(a, strpos(a, '</thinking>') + 11) ELSE a END")
_THINKING = f"""SELECT track, h / n AS think_tag_rate, s / n AS structured_rate, h AS think_count, s AS structured_count, n AS total FROM (SELECT track, count(*) AS n,
count(*) FILTER (contains(a, '<thinking>') AND contains(a, '</thinking>')) AS h, count(*) FILTER (contains(a, '<thinking>') AND contains(a, '</thinking>') AND length({_TAIL}) > 10) AS s FROM ({_THOUGHTS}) GROUP BY 1)"""


@query(_THINKING)
def thinking_rates(spark, sf_dir):
    """Two tracks' answers, some with a thinking block: how many have one, and how many go on after it."""
    tag = F.when(F.col("turn") % 3 == 0, "plain ").otherwise(F.concat(F.lit("<thinking>"), F.col("role"), F.lit("</thinking>")))
    rest = F.when(F.col("conv_id") % 2 == 0, "no").otherwise(F.coalesce("text", F.lit("")))
    rows = table(spark, sf_dir, "conversations").select(F.when(F.col("turn") % 2 == 0, "A").otherwise("B").alias("track"), F.concat(tag, rest).alias("a"))
    return evals.thinking_rates(rows, "a", "track")


QUESTIONS = [(1, "Which is a prime?", [("A", "4"), ("B", "7"), ("C", "9")], "B"), (2, "Which is even?", [("A", "3"), ("B", "5"), ("C", "8")], "C"), (3, "Which is odd?", [("A", "1"), ("B", "2")], "A")]


@query("""WITH q(id, question, options, answer) AS (VALUES (1, 'Which is a prime?', ['A. 4', 'B. 7', 'C. 9'], 'B'), (2, 'Which is even?', ['A. 3', 'B. 5', 'C. 8'], 'C'), (3, 'Which is odd?', ['A. 1', 'B. 2'], 'A'))
SELECT id, question || chr(10) || array_to_string(options, chr(10)) AS prompt, count(DISTINCT doc_id) FILTER (chr(CAST(65 + doc_id % 4 AS INT)) = answer) AS correct, count(DISTINCT doc_id) AS total
FROM q JOIN labels ON doc_id % 3 + 1 = id GROUP BY 1, 2""")
def literal_questions(spark, sf_dir):
    """A literal table of questions, their prompts, and how many answers (one for each label, a letter by its id) are right."""
    entries = "array<struct<k: string, v: string>>"
    asked = literal(spark, f"id int, question string, options {entries}, answer string", QUESTIONS)
    asked = asked.select("id", "answer", evals.choice_prompt(F.col("question"), F.map_from_entries("options")).alias("prompt"))
    given = table(spark, sf_dir, "labels").select("doc_id", (F.col("doc_id") % 3 + 1).alias("id"), F.chr(65 + F.col("doc_id") % 4).alias("given")).distinct()
    rows = given.join(F.broadcast(asked), "id")  # the literal table
    return evals.accuracy(rows, evals.choice_of(F.col("given")) == F.col("answer"), "id", "prompt").select(F.col("id").cast("int").alias("id"), "prompt", "correct", "total")


CONFIG = {"model": {"hidden": {"size": 64}, "layers": 4}, "training": {"learning": {"rate": 0.1}, "steps": 10, "save": {"every": {"steps": 5}}}, "seed": 7, "generation": {"prompts": 3}}
ARGUMENTS = {"size": 1, "layers": 1, "learning_rate": 0.5, "steps": 1, "training_save_every_steps": 1, "seed": 0, "generate_prompts": 9}


@query("SELECT * FROM (VALUES ('size', '64'), ('layers', '4'), ('learning_rate', '0.1'), ('steps', '10'), ('training_save_every_steps', '5'), ('seed', '7'), ('generate_prompts', '9')) AS t(argument, value)")
def config_arguments(spark, sf_dir):
    """A nested configuration set onto flat arguments: by the whole name, its last part, or ever shorter ends; what fits none is left out."""
    return literal(spark, "argument string, value string", [(k, str(v)) for k, v in config.apply(ARGUMENTS, CONFIG).items()])


@query("SELECT * FROM (VALUES (1, 1, 2, 3), (2, 3, 3, 3), (3, 5, 3, 3), (4, 0, 0, 0), (5, 4, 6, 0)) AS t(id, bos, eos, pad)")
def special_ids(spark, sf_dir):
    """Begin, end and pad ids where a tokenizer lacks some of them, or has 0."""
    given = [(1, 2, 3), (None, None, 3), (5, 0, 3), (None, 0, None), (4, 6, None)]
    return literal(spark, "id int, bos int, eos int, pad int", [(i, *tokens.fallback_ids(*x)) for i, x in enumerate(given, 1)])


@query("SELECT conv_id, turn, 'answer to ' || left(coalesce(text, ''), 20) AS answer FROM conversations WHERE role = 'user'")
def generated_answers(spark, sf_dir):
    """Requests to a text source that is plugged in, here one that needs no network."""
    asked = table(spark, sf_dir, "conversations").where("role = 'user'").select("conv_id", "turn", "text")

    def complete(parts):
        for part in parts:
            yield part[["conv_id", "turn"]].assign(answer="answer to " + part["text"].fillna("").str.slice(0, 20))

    return collectors.generated(asked, complete, "conv_id long, turn long, answer string")


@query("SELECT count(*) AS seen, count(*) FILTER (length(text) >= 50) AS kept, CAST(sum(length(text)) AS BIGINT) AS chars FROM documents")
def progress_counts(spark, sf_dir):
    """Counters that are reported as the rows are written."""
    size = F.length("text")
    rows, found = quality.counted(table(spark, sf_dir, "documents").select("doc_id", "text"), seen=F.count(F.lit(1)), kept=F.count_if(size >= 50), chars=F.sum(size))
    rows.write.format("noop").mode("overwrite").save()
    figures = found.get
    return literal(spark, "seen long, kept long, chars long", [(figures["seen"], figures["kept"], figures["chars"])])


NAMES = ["Nova"]
_PERSONA = " UNION ALL ".join(
    f"SELECT '{t}' AS track, '{k}' AS criterion, round(count(*) FILTER ({' OR '.join(f'contains({t}, {chr(39)}{w}{chr(39)})' for w in words)}) / count(*), 3) AS score FROM s"
    for t in ("a", "b") for k, words in evals.persona(NAMES).items()
)
_SAMPLES = "SELECT CASE WHEN role = 'user' THEN '~ ' || coalesce(text, '') ELSE 'Nova: 仅供参考' END AS a, CASE WHEN turn % 2 = 0 THEN '陪你...' ELSE coalesce(text, '') END AS b FROM conversations"


@query(f"WITH s AS ({_SAMPLES}) {_PERSONA}")
def persona_scores(spark, sf_dir):
    return evals.persona_scores(persona_samples(spark, sf_dir), ["a", "b"], NAMES)


def persona_samples(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations")
    a = F.when(F.col("role") == "user", F.concat(F.lit("~ "), F.coalesce("text", F.lit("")))).otherwise("Nova: 仅供参考")
    b = F.when(F.col("turn") % 2 == 0, "陪你...").otherwise(F.coalesce("text", F.lit("")))
    return rows.select(a.alias("a"), b.alias("b"))


@query(f"""WITH s AS ({_SAMPLES}), m AS ({_MCQ}), t AS ({_THINKING}), p AS ({_PERSONA}), x AS (SELECT (SELECT accuracy FROM m WHERE track = 'A') AS a, (SELECT accuracy FROM m WHERE track = 'B') AS b)
SELECT 'mcq ' || track AS name, round(accuracy, 6) AS value FROM m UNION ALL SELECT 'think ' || track, round(think_tag_rate, 6) FROM t UNION ALL SELECT 'structured ' || track, round(structured_rate, 6) FROM t
UNION ALL SELECT 'persona ' || upper(track) || ' ' || criterion, score FROM p UNION ALL SELECT 'diff ' || CASE WHEN a > b THEN 'A' WHEN b > a THEN 'B' ELSE 'tie' END, round(a - b, 4) FROM x UNION ALL SELECT 'samples', count(*) FROM s""")
def comparison_report(spark, sf_dir):
    """The comparison of two tracks and its samples, written as two JSON files and read back."""
    scores = persona_scores(spark, sf_dir).withColumn("track", F.upper("track"))
    report = evals.comparison(mcq_accuracy(spark, sf_dir), thinking_rates(spark, sf_dir), scores)
    at = work_path(spark, "comparison")
    sinks.comparison(report, persona_samples(spark, sf_dir), at)
    read = spark.read.schema(report.schema).json(f"{at}.json")
    samples = spark.read.schema("a string, b string").json(f"{at}_samples.json")
    tracks = F.array(F.lit("A"), F.lit("B"))
    entry = lambda name, value: F.struct(name.alias("name"), value.cast("double").alias("value"))
    parts = F.concat(
        F.transform(tracks, lambda t: entry(F.concat(F.lit("mcq "), t), F.round(F.col("mcq")[t].accuracy, 6))),
        F.transform(tracks, lambda t: entry(F.concat(F.lit("think "), t), F.round(F.col("thinking")[t].think_tag_rate, 6))),
        F.transform(tracks, lambda t: entry(F.concat(F.lit("structured "), t), F.round(F.col("thinking")[t].structured_rate, 6))),
        F.flatten(F.transform(tracks, lambda t: F.transform(F.map_entries(F.col("personality")[t]), lambda e: entry(F.concat(F.lit("persona "), t, F.lit(" "), e.key), e.value)))),
        F.array(entry(F.concat(F.lit("diff "), F.col("winner")), F.col("diff"))),
    )
    return read.select(F.explode(parts).alias("e")).select("e.*").unionByName(samples.agg(F.lit("samples").alias("name"), F.count(F.lit(1)).cast("double").alias("value")))


@query("""SELECT event_type, round(avg(v), 3) AS avg_latency_sec, round(avg(user_id), 1) AS avg_tokens_generated, round(CASE WHEN avg(v) > 0 THEN avg(user_id) / avg(v) ELSE 0 END, 1) AS tokens_per_sec
FROM (SELECT event_type, CAST(floor(value) AS BIGINT) AS v, user_id FROM events) GROUP BY 1""")
def latency_stats(spark, sf_dir):
    """Events as timed answers: whole seconds, and user numbers as token counts."""
    rows = table(spark, sf_dir, "events").withColumn("v", F.floor("value").cast("long"))
    return evals.latency(rows, "v", "user_id", "event_type")


@query("""SELECT user_id, min(value) AS best_loss, arg_min(event_id, (value, event_id)) AS best_step, arg_max(value, event_id) AS last_loss, max(event_id) AS last_step, round(exp(min(value) / 100), 6) AS best_perplexity
FROM events WHERE value IS NOT NULL GROUP BY 1""")
def run_summary(spark, sf_dir):
    """Users as runs, events as steps, values as losses."""
    rows = evals.run_summary(table(spark, sf_dir, "events"), "user_id", "event_id", "value")
    return rows.withColumn("best_perplexity", F.round(evals.perplexity(F.col("best_loss") / 100), 6))


@query("""SELECT l_orderkey, l_linenumber, round(CASE WHEN s < 100 THEN 0.0003 * (s / 100) ELSE 0.0003 * (0.1 + 0.45 * (1 + cos(pi() * (s - 100) / 900))) END, 12) AS lr
FROM (SELECT l_orderkey, l_linenumber, l_partkey % 1000 AS s FROM lineitem)""")
def lr_schedule(spark, sf_dir):
    step = F.col("l_partkey") % 1000
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.round(training.learning_rate(step, 1000, 0.0003), 12).alias("lr"))


@query("""SELECT o_orderkey, round(ln(1 + exp(-0.1 * ((a - b) - (c - d)))), 9) AS loss FROM (
SELECT o_orderkey, o_totalprice / 1000 AS a, o_totalprice / 1200 AS b, o_custkey / 100 AS c, o_custkey / 130 AS d FROM orders)""")
def dpo_loss(spark, sf_dir):
    loss = training.dpo_loss(F.col("o_totalprice") / 1000, F.col("o_totalprice") / 1200, F.col("o_custkey") / 100, F.col("o_custkey") / 130)
    return table(spark, sf_dir, "orders").select("o_orderkey", F.round(loss, 9).alias("loss"))


@query("SELECT l_orderkey, round(sum(CASE WHEN l_returnflag = 'R' THEN 0 ELSE -l_discount END), 6) AS masked FROM lineitem GROUP BY 1")
def masked_log_prob(spark, sf_dir):
    """Of each order's lines as a sequence: the sum of the terms that are not masked."""
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_discount", "l_returnflag"))).alias("s"))
    values, mask = F.transform("s", lambda x: -x.l_discount), F.transform("s", lambda x: (x.l_returnflag != "R").cast("int"))
    return rows.select("l_orderkey", F.round(training.masked_sum(values, mask), 6).alias("masked"))


@query("SELECT round(-avg(-l_tax), 9) AS loss, count(*) AS n FROM lineitem WHERE CASE WHEN l_linestatus = 'O' THEN 1 ELSE -100 END <> -100")
def masked_cross_entropy(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select((-F.col("l_tax")).alias("lp"), F.when(F.col("l_linestatus") == "O", 1).otherwise(-100).alias("label"))
    return training.cross_entropy(rows, "lp", "label").withColumn("loss", F.round("loss", 9))


@query("SELECT vec_id, round(CAST(embedding[vec_id % 6 + 1] AS DOUBLE), 6) AS lp FROM embeddings WHERE vec_id % 7 <> 0 UNION ALL SELECT vec_id, NULL FROM embeddings WHERE vec_id % 7 = 0")
def gathered_log_probs(spark, sf_dir):
    """A vector's entry at its row's label; none for labels beyond it."""
    label = F.when(F.col("vec_id") % 7 == 0, 1_000_000).otherwise(F.col("vec_id") % 6).cast("int")
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(training.gathered(F.col("embedding"), label).cast("double"), 6).alias("lp"))


@query(f"SELECT x.doc_id, x.a, y.b FROM ({_ANSWERS}) x JOIN ({_ANSWERS}) y USING (doc_id) WHERE doc_id % 5 <> 0 AND doc_id % 7 <> 0")
def compared_answers(spark, sf_dir):
    """Two tracks' answers by prompt, each track without some of them."""
    rows = answers(spark, sf_dir)
    first, second = rows.where("doc_id % 5 <> 0").select("doc_id", F.col("a").alias("answer")), rows.where("doc_id % 7 <> 0").select("doc_id", F.col("b").alias("answer"))
    return evals.compared(first, second, "doc_id", "answer")


_LOGS = "SELECT event_id AS step, CASE WHEN event_id % 4 <> 0 THEN value / 10 END AS loss, event_id / 50.0 AS seconds, CASE WHEN event_id % 10 = 0 THEN value / 25 END AS eval_loss FROM events"


@query(f"""SELECT max(step) AS final_step, round(max(seconds) / 3600, 2) AS total_time_hours, round(min(eval_loss), 6) AS best_eval_loss, arg_min(step, (eval_loss, step)) FILTER (eval_loss IS NOT NULL) AS best_eval_step,
round(arg_max(loss, step) FILTER (loss IS NOT NULL), 6) AS final_train_loss, round(arg_max(eval_loss, step) FILTER (eval_loss IS NOT NULL), 6) AS final_eval_loss,
round(exp(arg_max(eval_loss, step) FILTER (eval_loss IS NOT NULL)), 2) AS final_eval_perplexity FROM ({_LOGS})""")
def training_report(spark, sf_dir):
    """Events as the steps of a run: its logs written as JSON lines, and the report over what is read back, written as one file."""
    events = table(spark, sf_dir, "events").select(F.col("event_id").alias("step"), "value")
    train = events.select("step", F.when(F.col("step") % 4 != 0, F.col("value") / 10).alias("loss"), (F.col("step") / 50.0).alias("seconds"))
    at = work_path(spark, "run")
    sinks.json_lines(train, f"{at}/train_log.jsonl")
    sinks.json_lines(events.where("step % 10 = 0").select("step", (F.col("value") / 25).alias("eval_loss")), f"{at}/eval_log.jsonl")
    logs = (spark.read.schema(schema).json(f"{at}/{name}.jsonl") for name, schema in (("train_log", "step long, loss double, seconds double"), ("eval_log", "step long, eval_loss double")))
    report = evals.training_report(*logs)
    sinks.one_file(report, f"{at}/report.json")
    return spark.read.schema(report.schema).json(f"{at}/report.json")


@query("""WITH p AS (SELECT l_orderkey, l_linenumber, exp(l_quantity / 10 - max(l_quantity / 10) OVER w) AS e FROM lineitem WINDOW w AS (PARTITION BY l_orderkey)),
q AS (SELECT *, e / sum(e) OVER (PARTITION BY l_orderkey) AS p FROM p)
SELECT l_orderkey, l_linenumber FROM (SELECT *, sum(p) OVER (PARTITION BY l_orderkey ORDER BY round(p, 12) DESC, l_linenumber ROWS UNBOUNDED PRECEDING) - p AS before FROM q) WHERE round(before, 9) <= 0.8""")
def nucleus(spark, sf_dir):
    """Order lines as candidate tokens."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_quantity") / 10).alias("logit"))
    return training.nucleus(rows, "l_orderkey", "l_linenumber", "logit", 0.8).select("l_orderkey", "l_linenumber")


@query("SELECT l_orderkey, l_linenumber FROM lineitem QUALIFY rank() OVER (PARTITION BY l_orderkey ORDER BY l_quantity DESC) <= 2")
def topk_logits(spark, sf_dir):
    return training.top_logits(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity"), "l_orderkey", "l_quantity", 2).select("l_orderkey", "l_linenumber")


_SCORES = "SELECT vec_id, list_transform(list_slice(embedding, 1, 4), lambda x: CAST(round(abs(x), 6) AS DOUBLE) + 0.001) AS s FROM embeddings"
_ROUTES = f"""SELECT vec_id, expert, p, p / (sum(p) OVER (PARTITION BY vec_id) + 1e-9) AS weight FROM (
SELECT vec_id, unnest(range(0, 4)) AS expert, unnest(s) AS p FROM ({_SCORES})) QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY p DESC, expert) <= 2"""
_TOP = f"SELECT vec_id, expert, p / (sum(p) OVER (PARTITION BY vec_id) + 1e-9) AS weight FROM (SELECT vec_id, expert, p FROM ({_ROUTES}))"


def scores(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", F.transform(F.slice("embedding", 1, 4), lambda x: F.round(F.abs(x), 6).cast("double") + 0.001).alias("s"))


@query(f"SELECT vec_id, CAST(expert AS INT) AS expert, round(weight, 5) AS weight FROM ({_TOP})")
def topk_route(spark, sf_dir):
    return training.routed(scores(spark, sf_dir), "s", 2).select("vec_id", "expert", F.round("weight", 5).alias("weight"))


@query(f"SELECT vec_id, round(sum(weight * (expert + 1)), 4) AS combined FROM ({_TOP}) GROUP BY 1")
def expert_combine(spark, sf_dir):
    routes = training.routed(scores(spark, sf_dir), "s", 2)
    return training.combined(routes, "vec_id", F.col("expert") + 1).select("vec_id", F.round("combined", 4).alias("combined"))


@query(f"""WITH r AS ({_TOP}), m AS (SELECT i AS expert, avg(p) AS mean FROM (SELECT unnest(range(0, 4)) AS i, unnest(s) AS p FROM ({_SCORES})) GROUP BY 1)
SELECT round(sum(n / a * mean) * 4 * 0.01, 6) AS aux_loss FROM (SELECT expert, count(*) AS n, (SELECT count(*) FROM r) AS a FROM r GROUP BY 1) JOIN m USING (expert)""")
def load_balance(spark, sf_dir):
    own = scores(spark, sf_dir)
    return training.load_balance(own, training.routed(own, "s", 2), "s", 4, 0.01).select(F.round("aux_loss", 6).alias("aux_loss"))


@query("SELECT CAST(1000000000 AS BIGINT) AS tokens, CAST(1000000000 // (512 * 2048) AS BIGINT) AS steps, count(*) AS docs FROM documents")
def token_plan(spark, sf_dir):
    tokens, steps = training.token_plan(5e7, 20, 512, 2048)
    return table(spark, sf_dir, "documents").agg(F.lit(tokens).cast("long").alias("tokens"), F.lit(steps).cast("long").alias("steps"), F.count(F.lit(1)).alias("docs"))


DECODED = [(0, "睡 眠 质量 ， 很 好 。 ok  then"), (1, "（ 一 ） 问：多久？\n答：八 小时"), (2, "问：甲\n答： 乙 答：丙 丁"), (3, "plain  text ")]


@query("SELECT * FROM (VALUES (0, '睡眠质量， 很好。 ok then', '睡眠质量， 很好。 ok then'), (1, '（一） 问：多久？' || chr(10) || '答：八小时', '八小时'), (2, '问：甲答： 乙答：丙丁', '丙丁'), (3, 'plain text', 'plain text')) AS t(id, joined, answer)")
def cjk_decode(spark, sf_dir):
    """Decoded CJK text made clean, and the answer in it, over a literal table."""
    rows = spark.createDataFrame(DECODED, "id int, t string").select("id", clean.join_cjk(F.col("t")).alias("joined"))
    return rows.select("id", "joined", clean.answer_of(F.col("joined")).alias("answer"))
