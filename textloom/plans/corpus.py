"""Queries over the corpus: quality, cleaning, redaction, deduplication, sampling, bookkeeping."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from textloom.functions import text as T
from textloom.operators import clean, dedup, quality, quotas, sample, scrub, tokens
from textloom.plans.base import query
from textloom.sources import collectors, jsonl, mirror, sinks
from textloom.sources.tables import keep, spread, table, work_path
from textloom.streaming import cleanse

_METRICS = f"split AS ({quality.METRICS_SQL[0]}), metrics AS ({quality.METRICS_SQL[1]}), judged AS (SELECT *, {quality.REASON_SQL} AS reason FROM metrics)"


def judged(spark, sf_dir):
    docs = quality.with_metrics(spread(table(spark, sf_dir, "documents")))
    return docs.select(*docs.columns, T.held(quality.reason()).alias("reason"))


@query(f"WITH {_METRICS} SELECT doc_id, reason FROM judged")
def quality_reason(spark, sf_dir):
    return judged(spark, sf_dir).select("doc_id", "reason")


_CLEANED = f"{_METRICS}, cleaned AS (SELECT * REPLACE ({clean.clean_sql('text')} AS text) FROM judged WHERE reason = 'passed')"


def cleaned(spark, sf_dir):
    """Rows that passed, cleaned."""
    docs = judged(spark, sf_dir).where("reason = 'passed'")
    return docs.select(*(c for c in docs.columns if c != "text"), T.held(clean.clean(F.col("text"))).alias("text"))


@query(f"""WITH {_CLEANED}
SELECT reason, count(*) AS n FROM judged GROUP BY 1
UNION ALL SELECT 'too_short_after_clean', count(*) FROM cleaned WHERE length(text) < 50 HAVING count(*) > 0""")
def quality_reason_counts(spark, sf_dir):
    """One pass: a row that passed is cleaned for its length, and counts again where that is too short."""
    rows = judged(spark, sf_dir).select("reason", ((F.col("reason") == "passed") & (F.length(clean.clean(F.col("text"))) < 50)).alias("short"))
    counts = rows.groupBy("reason").agg(F.count(F.lit(1)).alias("n"), F.count_if("short").alias("short"))
    both = F.array(F.struct("reason", "n"), F.struct(F.lit("too_short_after_clean").alias("reason"), F.col("short").alias("n")))
    return counts.select(F.explode(both).alias("r")).select("r.reason", "r.n").where("n > 0")


@query(f"SELECT doc_id, {clean.clean_sql('text')} AS text FROM documents")
def clean_documents(spark, sf_dir):
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", clean.clean(F.col("text")).alias("text"))


@query(f"SELECT page_id, {clean.clean_sql('html')} AS text FROM pages")
def clean_pages(spark, sf_dir):
    return spread(table(spark, sf_dir, "pages").select("page_id", "html")).select("page_id", clean.clean(F.col("html")).alias("text"))


#: Texts in which every cleaning step has something to do; ``#`` is a number of the row.
_MARKED = [
    "<p>Hello &amp; good&#160;bye</p> see https://a.b/c?d=# now", "首页 > 新闻\nBody # text\n 返回列表 x\nlast", "start Copyright © 202# all\nrest", "本网站使用很多 Cookie 来 # 继续浏览即表示同意。end",
    "a\n\n\n\n\nb     c\t\t\t\t\td", '"  quoted # text  "', "  \u3000 one \n\n \u00a0two\u2003\n#", "www.x.y/z<b>bold</b> All Rights Reserved 20#",
]


def marked_texts(spark, sf_dir):
    return filled(table(spark, sf_dir, "documents").select("doc_id"), _MARKED)


def filled(rows, texts):
    """(doc_id, text): one of the texts for each row, by its number, which stands for ``#`` too."""
    own = F.element_at(F.array(*map(F.lit, texts)), (F.col("doc_id") % len(texts) + 1).cast("int"))
    return rows.select("doc_id", F.replace(own, F.lit("#"), (F.col("doc_id") % 10).cast("string")).alias("text"))


def _filled_sql(texts: list[str]) -> str:
    own = ", ".join("'" + t.replace("\n", "' || chr(10) || '").replace("\t", "' || chr(9) || '") + "'" for t in texts)
    return f"SELECT doc_id, replace(list_extract([{own}], CAST(doc_id % {len(texts)} AS INT) + 1), '#', CAST(doc_id % 10 AS VARCHAR)) AS text FROM documents"


@query(f"SELECT doc_id, {clean.clean_sql('text')} AS text FROM ({_filled_sql(_MARKED)})")
def clean_marked(spark, sf_dir):
    """Every cleaning step over made texts."""
    return marked_texts(spark, sf_dir).select("doc_id", clean.clean(F.col("text")).alias("text"))


_N = ", ".join(r[0] for r in scrub.RULES)
_LAST = f"r{len(scrub.RULES) - 1}"


@query(f"WITH d AS (SELECT doc_id, text FROM documents), {scrub.scrub_sql('d')} SELECT doc_id, text, {_N} FROM {_LAST}")
def scrub_documents(spark, sf_dir):
    return scrub.scrub(spread(table(spark, sf_dir, "documents").select("doc_id", "text"))).select("doc_id", "text", *(r[0] for r in scrub.RULES))


_SCRUBBED = f"{_CLEANED}, kept AS (SELECT * FROM cleaned WHERE length(text) >= 50), {scrub.scrub_sql('kept')}"


def scrubbed(spark, sf_dir):
    """Rows that passed, cleaned, long enough still, scrubbed."""
    return scrub.scrub(cleaned(spark, sf_dir).where(F.length("text") >= 50))


_LABEL_SUMS = " UNION ALL ".join(f"SELECT '{label}' AS label, CAST(sum({' + '.join(c for c in cs if c != 'n_address')}) AS BIGINT) AS total FROM {_LAST}" for label, cs in scrub.labels() if cs != ["n_address"])


@query(f"WITH {_SCRUBBED} SELECT label, total FROM ({_LABEL_SUMS}) WHERE total > 0")
def redaction_totals(spark, sf_dir):
    return scrub.redaction_totals(scrubbed(spark, sf_dir))


@query(f"SELECT doc_id, {dedup.FINGERPRINT_SQL.format(t='text')} AS fp FROM documents")
def fingerprint(spark, sf_dir):
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", dedup.fingerprint(F.col("text")).alias("fp"))


#: Texts of which each rule finds something, and some that look alike; ``#`` is a number of the row.
_NAMED = [
    "患者：张三丰，住院号：20#0001，家属 李四光。姓名：王小明", "刘大夫医生和陈主任说：某某，王某，李某某。", "家住湖北省武汉市洪山区珞喻路1037号，旁边是东湖村。", "湖北省武汉市洪山区珞喻路号楼室。和平路口市场",
    "身份证 11010519491231002X 和 1101051949123100211，手机13800138000，座机027-87654321", "微信：abc_12345，QQ: 10#0086，邮箱 a.b@c-d.com.cn。IP 192.168.0.# 和256.1.1.1，卡号 6222 0212 3456 7890 12", "病历号 5#5512 床号：12 名字：赵云 孕妇，钱多多",
]


def named_texts(spark, sf_dir):
    return filled(table(spark, sf_dir, "documents").select("doc_id"), _NAMED)


_ADDRESS_SQL = f"(?:{scrub._PART}){{2,}}"
_DETAILED_SQL = f"len(regexp_extract_all(f, '{scrub.ADDRESS_PART}')) >= {scrub.ADDRESS_LEAST}"


@query(f"""WITH d AS ({_filled_sql(_NAMED)}), {scrub.scrub_sql("d")}, a AS (SELECT *, regexp_extract_all(text, '{_ADDRESS_SQL}') AS found, string_split_regex(text, '{_ADDRESS_SQL}') AS parts FROM {_LAST})
SELECT doc_id, array_to_string(list_transform(range(1, len(parts) + 1), lambda i: parts[i] || CASE WHEN i > len(found) THEN '' WHEN len(regexp_extract_all(found[i], '{scrub.ADDRESS_PART}')) >= {scrub.ADDRESS_LEAST} THEN '{scrub.ADDRESS_PUT}' ELSE found[i] END), '') AS text,
{_N}, CAST(len(list_filter(found, lambda f: {_DETAILED_SQL})) AS BIGINT) AS n_address FROM a""")
def scrub_named(spark, sf_dir):
    """Every redaction rule over Chinese texts, the conditional one for addresses too."""
    return scrub.scrub(named_texts(spark, sf_dir))



def _status_sql(source: str) -> str:
    return f"""SELECT *, CASE WHEN row_number() OVER w = 1 THEN 'unique' WHEN md5(text) IS NOT DISTINCT FROM first_value(md5(text)) OVER w THEN 'exact_dup' ELSE 'near_dup' END AS status
FROM (SELECT *, {dedup.FINGERPRINT_SQL.format(t="text")} AS fp FROM {source}) WINDOW w AS (PARTITION BY fp ORDER BY doc_id)"""


@query(f"SELECT doc_id, status FROM ({_status_sql('documents')})")
def dedup_status(spark, sf_dir):
    return dedup.dedup_status(spread(table(spark, sf_dir, "documents").select("doc_id", "text"))).select("doc_id", "status")


@query(f"SELECT status, count(*) AS n FROM ({_status_sql('documents')}) GROUP BY 1")
def dedup_stats(spark, sf_dir):
    return dedup_status(spark, sf_dir).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


_CLEANSED = f"{_SCRUBBED}, done AS ({_status_sql(_LAST)})"


@query(f"""WITH {_CLEANSED}
SELECT CAST(doc_id AS VARCHAR) AS id, text, lang, source AS industry_type, CAST(length(text) AS BIGINT) AS text_length, num_words FROM done WHERE status = 'unique'""")
def cleanse_corpus(spark, sf_dir):
    """Quality filter, cleaning, redaction, deduplication in id order, cleaned records."""
    done = dedup.judged(cleansed(spark, sf_dir).where("fp IS NOT NULL")).where("status = 'unique'")
    return done.select(F.col("doc_id").cast("string").alias("id"), "text", "lang", F.col("source").alias("industry_type"), F.length("text").cast("long").alias("text_length"), "num_words")


def cleansed(spark, sf_dir):
    """All rows with reason, rule counts and hashes, written once; the text is cleaned and scrubbed, and null where a row failed before or after cleaning."""
    docs = judged(spark, sf_dir)
    own = [c for c in docs.columns if c not in ("text", "reason")]
    docs = docs.select(*own, "reason", T.held(F.when(F.col("reason") == "passed", clean.clean(F.col("text")))).alias("text"))
    short = F.length("text") < 50
    docs = docs.select(*own, "reason", F.coalesce(short, F.lit(False)).alias("short"), F.when(~short, F.col("text")).alias("text"))
    return keep(dedup.hashed(scrub.scrub(docs)), "cleansed")


def stats_record(rows):
    """One row of a cleansing run's figures over the written rows of ``cleansed``: totals, filter rate, and the maps of reasons, statuses and redactions."""
    own = rows.select("own.*")
    reasons = own.groupBy("reason").agg(F.count(F.lit(1)).alias("n"), F.count_if("short").alias("short"))
    both = F.array(F.struct(F.col("reason").alias("k"), "n"), F.struct(F.lit("too_short_after_clean").alias("k"), F.col("short").alias("n")))
    found = {
        "quality_filter_stats": reasons.select(F.explode(both).alias("e")).select("e.*").where("n > 0"),
        "dedup_stats": dedup.judged(rows.where("fp IS NOT NULL")).groupBy(F.col("status").alias("k")).agg(F.count(F.lit(1)).alias("n")),
        "redaction_summary": scrub.redaction_totals(own).select(F.col("label").alias("k"), F.col("total").alias("n")),
    }
    every = None
    for name, counts in found.items():  # a few rows each
        one = counts.select(F.lit(name).alias("of"), "k", "n")
        every = one if every is None else every.unionByName(one)
    maps = [F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("of") == name, F.struct("k", "n"))))).alias(name) for name in found]
    total = F.coalesce(F.sum(F.when((F.col("of") == "quality_filter_stats") & (F.col("k") != "too_short_after_clean"), F.col("n"))), F.lit(0)).alias("total_input")
    kept = F.coalesce(F.sum(F.when((F.col("of") == "dedup_stats") & (F.col("k") == "unique"), F.col("n"))), F.lit(0)).alias("total_output")
    rate = F.format_string("%.2f%%", (1 - F.col("total_output") / F.nullif(F.col("total_input"), F.lit(0))) * 100)
    return every.agg(total, kept, *maps).select("total_input", "total_output", rate.alias("filter_rate"), *found)


def shown(entries):
    return F.array_join(F.transform(F.map_entries(entries), lambda e: F.concat(e.key, F.lit("="), e.value.cast("string"))), ";")


_SHOWN = "(SELECT coalesce(string_agg({k} || '=' || {n}, ';' ORDER BY {k}), '') FROM ({rows}))"


@query(f"""WITH {_CLEANSED}, q AS (SELECT reason AS k, count(*) AS n FROM judged GROUP BY 1 UNION ALL SELECT 'too_short_after_clean', count(*) FROM cleaned WHERE length(text) < 50 HAVING count(*) > 0)
SELECT i AS total_input, o AS total_output, format('{{:.2f}}%', (1 - o / nullif(i, 0)) * 100) AS filter_rate,
  {_SHOWN.format(k="k", n="n", rows="SELECT * FROM q")} AS quality_filter_stats,
  {_SHOWN.format(k="status", n="n", rows="SELECT status, count(*) AS n FROM done GROUP BY 1")} AS dedup_stats,
  {_SHOWN.format(k="label", n="total", rows=f"SELECT * FROM ({_LABEL_SUMS}) WHERE total > 0")} AS redaction_summary
FROM (SELECT (SELECT count(*) FROM documents) AS i, (SELECT count(*) FROM done WHERE status = 'unique') AS o)""")
def cleanse_stats(spark, sf_dir):
    record = stats_record(cleansed(spark, sf_dir))
    return record.select("total_input", "total_output", "filter_rate", *(shown(F.col(c)).alias(c) for c in ("quality_filter_stats", "dedup_stats", "redaction_summary")))


KEYWORDS = ["the", "sch", "tion", "une", "ción", "(x)"]


@query("SELECT doc_id FROM documents WHERE len(regexp_extract_all(coalesce(text, ''), '(?i)the|sch|tion|une|ción|\\(x\\)')) >= 200")
def keyword_filter(spark, sf_dir):
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text")).where(clean.has_keywords(F.coalesce("text", F.lit("")), KEYWORDS, 200)).select("doc_id")


@query("""SELECT doc_id, source FROM (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN '' WHEN doc_id % 3 = 1 THEN NULL ELSE lang END AS text, CASE WHEN doc_id % 2 = 0 THEN text ELSE '' END AS content, source FROM documents)
WHERE len(regexp_extract_all(coalesce(nullif(text, ''), content, ''), '(?i)the|sch|tion|une|ción|\\(x\\)|en')) >= 2""")
def keyword_fallback(spark, sf_dir):
    """Records with ``text`` or, where that is empty or missing, ``content``."""
    docs = table(spark, sf_dir, "documents")
    own = F.when(F.col("doc_id") % 3 == 0, "").when(F.col("doc_id") % 3 == 2, F.col("lang"))
    rows = spread(docs.select("doc_id", "source", own.alias("text"), F.when(F.col("doc_id") % 2 == 0, F.col("text")).otherwise("").alias("content")))
    return rows.where(clean.has_keywords(clean.text_or(F.col("text"), F.col("content")), [*KEYWORDS, "en"], 2)).select("doc_id", "source")


@query("SELECT doc_id, text FROM documents WHERE len(regexp_extract_all(coalesce(text, ''), '(?i)the|sch|tion|une|ción|\\(x\\)')) >= 2 ORDER BY doc_id LIMIT 25")
def keyword_first(spark, sf_dir):
    """The first 25 documents that match, as the scan's stop after so many does."""
    return table(spark, sf_dir, "documents").where(clean.has_keywords(F.coalesce("text", F.lit("")), KEYWORDS, 2)).select("doc_id", "text").orderBy("doc_id").limit(25)


_LONG = f"SELECT doc_id, {T.sql_strip('text')} AS text FROM documents WHERE length({T.sql_strip('text')}) >= 50"
_TOKENS = f"SELECT doc_id, text, CAST(floor(length(text) / 1.5) AS BIGINT) AS tokens FROM ({_LONG})"
_BUDGET = f"SELECT doc_id, tokens, running FROM (SELECT *, CAST(sum(tokens) OVER (ORDER BY doc_id) AS BIGINT) AS running FROM ({_TOKENS})) WHERE running - tokens < 300000"


def long_enough(spark, sf_dir):
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", T.held(T.strip(F.col("text"))).alias("text"))
    return docs.where(F.length("text") >= 50)


def budgeted(spark, sf_dir):
    docs = long_enough(spark, sf_dir).withColumn("tokens", sample.estimated_tokens(F.col("text")))
    return sample.token_budget(docs.select("doc_id", "tokens"), "doc_id", "tokens", 300_000)


@query(_BUDGET)
def token_budget(spark, sf_dir):
    return budgeted(spark, sf_dir).select("doc_id", "tokens", "running")


@query(f"""WITH b AS ({_BUDGET})
SELECT count(*) AS total_docs, CAST(sum(tokens) AS BIGINT) AS total_tokens, (SELECT count(*) FROM documents WHERE length({T.sql_strip("coalesce(text, '')")}) < 50 AND doc_id < (SELECT max(doc_id) FROM b)) AS skipped_short FROM b""")
def budget_stats(spark, sf_dir):
    kept = budgeted(spark, sf_dir).agg(F.count(F.lit(1)).alias("total_docs"), F.sum("tokens").alias("total_tokens"), F.max("doc_id").alias("last"))
    short = table(spark, sf_dir, "documents").where(F.length(T.strip(F.coalesce("text", F.lit("")))) < 50).select("doc_id")
    skipped = short.join(F.broadcast(kept), F.col("doc_id") < F.col("last")).agg(F.count(F.lit(1)).alias("skipped_short"))
    return kept.crossJoin(skipped).select("total_docs", "total_tokens", "skipped_short")


_COUNTED = "len(regexp_extract_all({0}, '''(?:s|t|re|ve|m|ll|d)| ?\\p{{L}}+| ?\\p{{N}}+| ?[^\\s\\p{{L}}\\p{{N}}]+|\\s+'))"


@query(f"""SELECT conv_id, turn, CAST(floor(length(coalesce(text, '')) / 1.5) AS BIGINT) AS estimated, CAST({_COUNTED.format("coalesce(text, '')")} AS BIGINT) AS counted FROM conversations""")
def token_counts(spark, sf_dir):
    """Tokens by the estimate and by a counter that is passed in, here of the words that a byte-level tokenizer splits."""
    text = F.coalesce("text", F.lit(""))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", sample.counted_tokens(text).alias("estimated"), sample.counted_tokens(text, lambda c: F.size(tokens.pretokens(c))).alias("counted"))


@query(f"SELECT count(*) AS docs, coalesce(avg(length(text)), 0) AS mean_chars, CAST(floor(coalesce(sum(length(text)), 0) / 1.5) AS BIGINT) AS est_tokens FROM ({_LONG})")
def corpus_stats(spark, sf_dir):
    n = F.coalesce(F.sum(F.length("text")), F.lit(0))
    return long_enough(spark, sf_dir).agg(F.count(F.lit(1)).alias("docs"), F.coalesce(F.avg(F.length("text")), F.lit(0.0)).alias("mean_chars"), F.floor(n / 1.5).cast("long").alias("est_tokens"))


@query("SELECT doc_id, replace(left(text, 150), chr(10), ' ') || CASE WHEN length(text) > 150 THEN '...' ELSE '' END AS preview FROM documents")
def previews(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", clean.preview(F.col("text")).alias("preview"))


@query("SELECT doc_id FROM documents ORDER BY md5('42:' || doc_id) LIMIT 100")
def seeded_sample(spark, sf_dir):
    """A hundred documents by seeded shuffle."""
    return table(spark, sf_dir, "documents").select("doc_id").orderBy(sample.seeded(F.col("doc_id"), 42)).limit(100)


@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS row_no, (row_number() OVER (ORDER BY o_orderkey) - 1) // 64 AS batch FROM orders QUALIFY batch >= 3")
def batch_skip(spark, sf_dir):
    return sample.skip_batches(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", 64, 3).select("o_orderkey", "row_no", "batch")


@query("""WITH z AS (SELECT doc_id AS id, row_number() OVER (ORDER BY doc_id) AS rank FROM documents WHERE lang = 'en'),
e AS (SELECT doc_id AS id, row_number() OVER (ORDER BY doc_id) AS rank FROM documents WHERE lang <> 'en'),
d AS (SELECT doc_id AS step, doc_id % 10 < 7 AS f, row_number() OVER w AS n, count(*) FILTER (doc_id % 10 < 7) OVER w AS nf, count(*) FILTER (doc_id % 10 >= 7) OVER w AS ns FROM documents WINDOW w AS (ORDER BY doc_id)),
c AS (SELECT (SELECT count(*) FROM z) AS cf, (SELECT count(*) FROM e) AS cs),
s AS (SELECT d.*, c.* FROM d, c WHERE nf > cf OR ns > cs ORDER BY step LIMIT 1)
SELECT z.id, 'first' AS side, CASE WHEN s.n IS NOT NULL AND s.nf <= s.cf AND z.rank > s.nf THEN z.rank + s.cs ELSE coalesce(d.n, z.rank + c.cs) END AS place
FROM z CROSS JOIN c LEFT JOIN s ON true LEFT JOIN d ON d.f AND d.nf = z.rank
UNION ALL
SELECT e.id, 'second', CASE WHEN s.n IS NOT NULL AND s.ns <= s.cs AND e.rank > s.ns THEN e.rank + s.cf ELSE coalesce(d.n, e.rank + c.cf) END
FROM e CROSS JOIN c LEFT JOIN s ON true LEFT JOIN d ON NOT d.f AND d.ns = e.rank""")
def interleave(spark, sf_dir):
    """English and other documents merged by draws at seven to three."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), (F.col("lang") == "en").alias("english"))
    ranked = keep(sample.number_within(docs.where("english IS NOT NULL"), "english", F.col("id"), "rank"), "ranks")
    draws = docs.select(F.col("id").alias("step"), (F.col("id") % 10 < 7).alias("take_first"))
    return sample.interleave(ranked.where("english").select("rank", "id"), ranked.where("NOT english").select("rank", "id"), draws)


_LINES = """SELECT doc_id, CASE doc_id % 13 WHEN 1 THEN '' WHEN 2 THEN '{"id": ' || doc_id WHEN 3 THEN '  ' ELSE
  '{"id":' || doc_id || ',"n":' || n_chars || ',"lang":"' || lang || '"}' END AS value FROM documents"""


def json_rows(spark, sf_dir):
    """Documents as JSON lines, some blank, some cut short."""
    whole = F.concat(F.lit('{"id":'), F.col("doc_id").cast("string"), F.lit(',"n":'), F.col("n_chars").cast("string"), F.lit(',"lang":"'), F.col("lang"), F.lit('"}'))
    value = F.when(F.col("doc_id") % 13 == 1, "").when(F.col("doc_id") % 13 == 2, F.concat(F.lit('{"id": '), F.col("doc_id").cast("string"))).when(F.col("doc_id") % 13 == 3, "  ").otherwise(whole)
    return table(spark, sf_dir, "documents").select("doc_id", value.alias("value"))


_SCHEMA = StructType([StructField("id", LongType()), StructField("n", LongType()), StructField("lang", StringType())])


@query(f"""SELECT doc_id, NOT coalesce(json_valid(value), false) AS json_error, CASE WHEN json_valid(value) THEN CAST(json_extract(value, '$.n') AS BIGINT) END AS n, CASE WHEN json_valid(value) THEN json_extract_string(value, '$.lang') END AS lang FROM ({_LINES})""")
def jsonl_tolerant(spark, sf_dir):
    return jsonl.tolerant(json_rows(spark, sf_dir), _SCHEMA).select("doc_id", "json_error", "n", "lang")


@query(f"SELECT count(*) AS total, count(*) FILTER (NOT json_valid(value)) AS json_errors FROM ({_LINES}) WHERE trim(value) <> ''")
def jsonl_blank_skipping(spark, sf_dir):
    return jsonl.blank_skipping(json_rows(spark, sf_dir), _SCHEMA).agg(F.count(F.lit(1)).alias("total"), F.count_if("json_error").alias("json_errors"))


@query(f"SELECT doc_id, CAST(json_extract(value, '$.n') AS BIGINT) AS n FROM ({_LINES}) WHERE trim(value) <> '' AND json_valid(value)")
def jsonl_strict(spark, sf_dir):
    return jsonl.strict(json_rows(spark, sf_dir).where("doc_id % 13 <> 2"), _SCHEMA).select("doc_id", "n")


def json_files(spark, sf_dir, where="true"):
    """The lines as files in the work folder, in order; their path."""
    path = work_path(spark, "lines")
    sinks.raw_lines(json_rows(spark, sf_dir).where(where).repartitionByRange(4, "doc_id").sortWithinPartitions("doc_id"), path)
    return path


_NUMBERED = f"SELECT *, row_number() OVER (ORDER BY doc_id) - 1 AS line_no FROM ({_LINES})"


@query(f"""SELECT line_no, NOT coalesce(json_valid(value), false) AS json_error, CASE WHEN json_valid(value) THEN CAST(json_extract(value, '$.id') AS BIGINT) END AS id FROM ({_NUMBERED})""")
def jsonl_files(spark, sf_dir):
    """Files of lines scanned with every line counted, in file order."""
    return jsonl.tolerant(jsonl.numbered(jsonl.lines(spark, json_files(spark, sf_dir))), _SCHEMA).select("line_no", "json_error", "id")


@query(f"""SELECT CAST(record AS BIGINT) AS record, CASE WHEN json_valid(value) THEN CAST(json_extract(value, '$.id') AS BIGINT) END AS id
FROM (SELECT *, row_number() OVER (ORDER BY doc_id) - 1 AS record FROM ({_LINES}) WHERE trim(value) <> '') WHERE record % 97 = 5""")
def jsonl_lookup(spark, sf_dir):
    """Records of files by their number, blank lines not counted."""
    index = jsonl.index(jsonl.lines(spark, json_files(spark, sf_dir)))
    wanted = spark.range(5, table(spark, sf_dir, "documents").count(), 97).select(F.col("id").alias("record"))
    return jsonl.tolerant(jsonl.lookup(index, wanted), _SCHEMA).select("record", "id")


@query(f"SELECT doc_id AS id, n_chars AS n, lang FROM documents WHERE doc_id % 13 NOT IN (1, 2, 3)")
def jsonl_records(spark, sf_dir):
    """A JSON data set read with its schema."""
    return jsonl.records(spark, json_files(spark, sf_dir, "doc_id % 13 NOT IN (1, 2, 3)"), _SCHEMA).select("id", "n", "lang")


@query(f"SELECT doc_id, CAST(length({T.sql_strip('text')}) AS BIGINT) AS n FROM documents WHERE length({T.sql_strip('text')}) >= 50")
def hub_stream(spark, sf_dir):
    """A data set of a local mirror read as a stream, its texts stripped and short ones left out."""
    docs = table(spark, sf_dir, "documents")
    stream = mirror.dataset(spark, sf_dir, "documents", docs.schema, streaming=True).select("doc_id", T.strip(F.col("text")).alias("text")).where(F.length("text") >= 50)
    at = work_path(spark, "hub")
    cleanse.drain(stream.select("doc_id", F.length("text").cast("long").alias("n")), f"{at}/out", f"{at}/state")
    return spark.read.schema("doc_id long, n long").parquet(f"{at}/out")


@query("""SELECT doc_id, CAST(item AS INT) AS item, text FROM (
SELECT doc_id, 0 AS item, lang AS text FROM documents UNION ALL SELECT doc_id, 1, source FROM documents UNION ALL SELECT doc_id, 2, 'turn ' || n_chars FROM documents WHERE doc_id % 2 = 0)""")
def collect_texts(spark, sf_dir):
    """Texts of records of mixed shapes: two text keys, a key that is no string, messages on every second record."""
    docs = table(spark, sf_dir, "documents")
    turns = F.when(F.col("doc_id") % 2 == 0, F.array(F.struct(F.concat(F.lit("turn "), F.col("n_chars").cast("string")).alias("content"))))
    value = F.to_json(F.struct(F.col("lang").alias("text"), F.col("n_chars").alias("chosen"), F.col("source").alias("prompt"), turns.alias("messages")))
    return collectors.texts_of_lines(docs.select("doc_id", value.alias("value")), "doc_id").select("doc_id", "item", "text")


@query("""SELECT file, CAST(line_no AS BIGINT) AS line_no, CAST(item AS INT) AS item, text FROM (
SELECT 'even' AS file, row_number() OVER (ORDER BY doc_id) - 1 AS line_no, 0 AS item, lang AS text FROM documents WHERE doc_id % 2 = 0 UNION ALL
SELECT 'odd', row_number() OVER (ORDER BY doc_id) - 1, unnest([0, 1]), unnest([source, 'said ' || n_chars]) FROM documents WHERE doc_id % 2 = 1)""")
def collect_files(spark, sf_dir):
    """The texts of several files of lines, one of which is not there."""
    docs = table(spark, sf_dir, "documents")
    said = F.array(F.struct(F.lit("user").alias("role"), F.concat(F.lit("said "), F.col("n_chars").cast("string")).alias("content")))
    values = {"even": F.to_json(F.struct(F.col("lang").alias("text"), F.col("n_chars").alias("prompt"))), "odd": F.to_json(F.struct(F.col("source").alias("chosen"), said.alias("conversations")))}
    at = work_path(spark, "texts")
    for k, (name, value) in enumerate(values.items()):
        sinks.raw_lines(docs.where(F.col("doc_id") % 2 == k).repartitionByRange(3, "doc_id").sortWithinPartitions("doc_id").select(value.alias("value")), f"{at}/{name}")
    rows = collectors.texts_of_files(spark, [f"{at}/{name}" for name in (*values, "missing")])
    return rows.select(F.element_at(F.split("source", "/"), -1).alias("file"), "line_no", "item", "text")


@query("""SELECT 'k' || item_id AS key, CAST(i AS INT) AS item, t AS text FROM (
SELECT item_id, 0 AS i, text AS t FROM benchmark UNION ALL SELECT item_id, 1, 'c' || item_id FROM benchmark UNION ALL
SELECT item_id, 2, 'r' FROM benchmark WHERE item_id % 2 = 0 UNION ALL SELECT item_id, CASE WHEN item_id % 2 = 0 THEN 3 ELSE 2 END, '' FROM benchmark)""")
def qa_map_texts(spark, sf_dir):
    """A JSON object of questions for each benchmark item; every second has reasoning, none an answer."""
    reasoning = F.when(F.col("item_id") % 2 == 0, "r")
    entry = F.struct(F.col("text").alias("QUESTION"), F.array(F.concat(F.lit("c"), F.col("item_id").cast("string"))).alias("CONTEXTS"), reasoning.alias("reasoning"))
    value = F.to_json(F.create_map(F.concat(F.lit("k"), F.col("item_id").cast("string")), entry))
    return collectors.qa_texts(table(spark, sf_dir, "benchmark").select(value.alias("value")))


CATEGORIES = [("en", 500), ("de", 400), ("fr", 200), ("it", 50)]
_DIM = "(VALUES ('en', 500), ('de', 400), ('fr', 200), ('it', 50)) AS t(category, target)"


def targets(spark):
    return spark.createDataFrame(CATEGORIES, "category string, target long")


def done_rows(spark, sf_dir):
    """Documents that have a label count as done."""
    return table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_semi").select("doc_id", F.col("lang").alias("category"))


_DONE = "(SELECT doc_id, lang AS category FROM documents WHERE doc_id IN (SELECT doc_id FROM labels))"
_GAPS = f"SELECT category, CAST(target AS BIGINT) AS target, count(doc_id) AS done, greatest(CAST(target AS BIGINT) - count(doc_id), 0) AS gap FROM {_DIM} LEFT JOIN {_DONE} d USING (category) GROUP BY category, target"


@query(f"WITH g AS ({_GAPS}) SELECT * FROM g UNION ALL SELECT 'total', CAST(sum(target) AS BIGINT), CAST(sum(done) AS BIGINT), CAST(sum(gap) AS BIGINT) FROM g")
def quota_gap(spark, sf_dir):
    return quotas.with_total(quotas.gaps(targets(spark), done_rows(spark, sf_dir)))


@query("SELECT lang AS category, source, count(*) AS n FROM documents GROUP BY 1, 2")
def category_stats(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy(F.col("lang").alias("category"), "source").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH g AS ({_GAPS}) SELECT category, gap, CAST(b AS INT) AS batch, least(200, gap - b * 200) AS ask FROM g, unnest(range(0, CAST(ceil(gap / 200) AS BIGINT))) AS u(b)")
def request_batches(spark, sf_dir):
    return quotas.request_batches(quotas.gaps(targets(spark), done_rows(spark, sf_dir))).select("category", "gap", "batch", "ask")


@query(f"""SELECT doc_id, category, row_number() OVER (PARTITION BY category ORDER BY doc_id) + coalesce(have, 0) AS sample_idx
FROM (SELECT doc_id, lang AS category FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)) LEFT JOIN (SELECT category, count(*) AS have FROM {_DONE} GROUP BY 1) USING (category)""")
def sequence_numbers(spark, sf_dir):
    new = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left_anti").select("doc_id", F.col("lang").alias("category"))
    return quotas.continued(new, done_rows(spark, sf_dir), "category", "doc_id").select("doc_id", "category", "sample_idx")


@query(f"""SELECT doc_id, category, place FROM (SELECT doc_id, lang AS category, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS place FROM documents)
JOIN {_DIM} USING (category) LEFT JOIN (SELECT category, count(*) AS have FROM {_DONE} GROUP BY 1) USING (category) WHERE place > coalesce(have, 0) AND place <= target""")
def remaining_prompts(spark, sf_dir):
    prompts = table(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("category"))
    return quotas.remaining(prompts, done_rows(spark, sf_dir), targets(spark), "category", "doc_id").select("doc_id", "category", F.col("place").cast("long").alias("place"))


@query(f"""WITH g AS ({_GAPS}) SELECT doc_id, category, place FROM (SELECT doc_id, lang AS category, row_number() OVER (PARTITION BY lang ORDER BY md5('7:' || doc_id)) AS place FROM documents)
JOIN g USING (category) WHERE place <= gap""")
def supplement_draw(spark, sf_dir):
    """As many documents of each category as its gap, by seeded shuffle."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("category"))
    need = quotas.gaps(targets(spark), done_rows(spark, sf_dir))
    return quotas.shuffled_take(docs, "category", sample.seeded(F.col("doc_id"), 7), need).select("doc_id", "category", F.col("place").cast("long").alias("place"))


@query("SELECT text AS prompt, min(doc_id) AS doc_id FROM documents WHERE text NOT IN (SELECT text FROM benchmark) GROUP BY 1")
def new_prompts(spark, sf_dir):
    """Texts that are not known yet, the first of each."""
    known = table(spark, sf_dir, "benchmark").select(F.col("text").alias("prompt"))
    return dedup.new_prompts(table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("prompt")), known, ["prompt"], "doc_id")


@query("""SELECT source AS cat, text AS prompt, min(doc_id) AS doc_id FROM documents x
WHERE lang <> 'en' AND NOT EXISTS (SELECT 1 FROM documents y WHERE y.lang = 'en' AND y.source = x.source AND y.text = x.text) GROUP BY 1, 2""")
def new_prompts_by_category(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", F.col("source").alias("cat"), F.col("text").alias("prompt"))
    return dedup.new_prompts(docs.where("lang <> 'en'"), docs.where("lang = 'en'"), ["cat", "prompt"], "doc_id")


LEGACY = ["en", "fr", "de (x)+y", "nl"]


@query("""SELECT DISTINCT 'en' AS cat, 'p' || doc_id % 7 AS prompt FROM documents WHERE lang = 'en' AND doc_id % 7 <> 3
UNION SELECT DISTINCT 'fr', 'p' || doc_id % 5 FROM documents WHERE lang = 'fr' UNION SELECT DISTINCT 'de (x)+y', 'p' || doc_id % 5 FROM documents WHERE lang = 'de'""")
def legacy_prompts(spark, sf_dir):
    """Per-category text files, with blanks around their lines and blank lines, merged into the prompts that are known; a category without a file is skipped."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang")
    at = work_path(spark, "legacy")
    for name, lang, n in (("en", "en", 7), ("fr", "fr", 5), ("de (x)+y", "de", 5), ("other", "es", 2)):
        line = F.when(F.col("doc_id") % 11 == 0, F.lit("  ")).otherwise(F.concat(F.lit("\u3000p"), (F.col("doc_id") % n).cast("string"), F.lit(" \t")))
        every = docs.where(F.col("lang") == lang).select(F.explode(F.array(line, F.concat(F.lit("p"), (F.col("doc_id") % n).cast("string")))).alias("value"))
        sinks.raw_lines(every, f"{at}/{collectors.safe_name(name)}_prompts.txt")
    known = spark.createDataFrame([("en", "p3"), ("nl", "p1")], "cat string, prompt string")
    return collectors.legacy_prompts(collectors.prompt_lines(spark, f"{at}/*_prompts.txt"), LEGACY, known)


@query("SELECT CAST(k AS VARCHAR) AS sink, count(*) AS n, md5(string_agg(t, '|' ORDER BY t)) AS rows FROM (SELECT 'lines' AS k, '{\"id\": ' || doc_id AS t FROM documents UNION ALL SELECT 'texts', CAST(doc_id AS VARCHAR) FROM documents UNION ALL SELECT 'appended', lang || doc_id FROM documents) GROUP BY 1")
def sink_round_trips(spark, sf_dir):
    """Raw lines, stripped texts and records that two jobs append, written and read back."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang")
    at = work_path(spark, "sinks")
    sinks.raw_lines(docs.select(F.concat(F.lit('{"id": '), F.col("doc_id").cast("string")).alias("value")), f"{at}/lines")
    sinks.texts(docs.select(F.concat(F.lit(" \u3000"), F.col("doc_id").cast("string"), F.lit("\n")).alias("text")), f"{at}/texts")
    for part in (0, 1):
        sinks.append(docs.where(F.col("doc_id") % 2 == part).select("lang", "doc_id"), f"{at}/appended")
    found = {
        "lines": spark.read.text(f"{at}/lines").select(F.col("value").alias("t")),
        "texts": spark.read.schema("text string").json(f"{at}/texts").select(F.col("text").alias("t")),
        "appended": spark.read.schema("lang string, doc_id long").json(f"{at}/appended").select(F.concat("lang", F.col("doc_id").cast("string")).alias("t")),
    }
    out = None
    for name, rows in found.items():
        one = rows.agg(F.lit(name).alias("sink"), F.count(F.lit(1)).alias("n"), F.md5(F.array_join(F.array_sort(F.collect_list("t")), "|")).alias("rows"))
        out = one if out is None else out.unionByName(one)
    return out


@query("""SELECT c AS cat, count(conv_id) AS n, md5(coalesce(string_agg(text, '|' ORDER BY conv_id, turn), '')) AS prompts
FROM (VALUES ('user'), ('assistant'), ('tool')) AS t(c) LEFT JOIN conversations ON role = c GROUP BY 1""")
def prompt_cache(spark, sf_dir):
    dim = spark.createDataFrame([("user",), ("assistant",), ("tool",)], "cat string")
    prompts = table(spark, sf_dir, "conversations").select(F.col("role").alias("cat"), F.struct("conv_id", "turn").alias("ord"), F.col("text").alias("prompt"))
    return collectors.prompt_cache(dim, prompts).select("cat", F.size("prompts").cast("long").alias("n"), F.md5(F.array_join("prompts", "|")).alias("prompts"))


PERSONAS = ["cold", "verbose", "evasive", "wrong"]


@query("SELECT doc_id, list_extract(['cold', 'verbose', 'evasive', 'wrong'], CAST(CAST('0x' || left(md5('11:' || doc_id), 7) AS BIGINT) % 4 AS INT) + 1) AS persona FROM documents")
def rejected_persona(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", quotas.assigned(F.col("doc_id"), PERSONAS, 11).alias("persona"))


@query("SELECT doc_id, CASE lang WHEN 'en' THEN 'plain' WHEN 'de' THEN 'formal' ELSE 'neutral' END AS guide FROM documents")
def guide_lookup(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", quotas.guide(F.col("lang"), {"en": "plain", "de": "formal"}, "neutral").alias("guide"))


@query("SELECT doc_id % 4 AS shard, CAST(sum(length(text)) // 512 AS BIGINT) AS chunks, CAST(sum(length(text)) // 512 * 512 AS BIGINT) AS ids FROM documents GROUP BY 1")
def stream_pack(spark, sf_dir):
    """Documents' ids as a stream, packed by shard with the open chunk as state; a second run from the same checkpoint adds nothing."""
    docs = table(spark, sf_dir, "documents")
    at = work_path(spark, "stream-pack")
    for _ in range(2):
        stream = mirror.dataset(spark, sf_dir, "documents", docs.schema, streaming=True)
        texts = stream.select((F.col("doc_id") % 4).alias("shard"), "text")
        cleanse.drain(cleanse.packed(texts, "shard", 512, tokens.code_point_encoder()), f"{at}/out", f"{at}/state")
    return spark.read.schema("shard long, chunk long, input_ids array<int>").parquet(f"{at}/out").groupBy("shard").agg(F.count_distinct("chunk").alias("chunks"), F.sum(F.size("input_ids")).alias("ids"))


@query("SELECT count(DISTINCT text) AS texts, count(*) AS fingerprints FROM (SELECT DISTINCT fp, min(text) AS text FROM (SELECT text, " + dedup.FINGERPRINT_SQL.format(t="text") + " AS fp FROM documents) GROUP BY fp)")
def stream_dedup(spark, sf_dir):
    """Documents as a stream, deduplicated by fingerprint; whichever comes first stays, so only numbers are the same in every run."""
    docs = table(spark, sf_dir, "documents")
    stream = mirror.dataset(spark, sf_dir, "documents", docs.schema, streaming=True)
    at = work_path(spark, "stream")
    cleanse.drain(stream.withColumn("fp", dedup.fingerprint(F.col("text"))).dropDuplicates(["fp"]).select("doc_id", "text", "fp"), f"{at}/out", f"{at}/state")
    return spark.read.schema("doc_id long, text string, fp string").parquet(f"{at}/out").agg(F.count_distinct("text").alias("texts"), F.count_distinct("fp").alias("fingerprints"))
