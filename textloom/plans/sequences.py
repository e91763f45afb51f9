"""Queries over token sequences and chats: packing, padding, masks, ChatML, preference pairs."""

from __future__ import annotations

from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.operators import chat, clean, sample, tokens
from textloom.plans.base import query
from textloom.sources.tables import spread, table

LENGTH = 256
_IDS = "list_transform(string_split({0}, ''), lambda c: unicode(c) + 16)"


def _wrapped_sql(cut: int) -> str:
    return f"SELECT doc_id, list_concat(list_concat([1], list_slice({_IDS.format('t')}, 1, {cut})), [2]) AS ids FROM (SELECT doc_id, {T.sql_strip('text')} AS t FROM documents) WHERE length(t) >= 50"


def wrapped(spark, sf_dir, length: int):
    """Documents of 50 characters or more as ids between begin and end."""
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", T.held(T.strip(F.col("text"))).alias("t")).where(F.length("t") >= 50)
    return docs.select("doc_id", T.held(tokens.wrapped(tokens.code_points(F.col("t")), length)).alias("ids"))


def packed(spark, sf_dir, most: int | None = None):
    """Documents of 50 characters or more packed to sequences; they travel as texts."""
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", T.held(T.strip(F.col("text"))).alias("t")).where(F.length("t") >= 50)
    ids, size = tokens.segment_ids("t")
    return tokens.pack(tokens.text_segments(docs, "t"), "doc_id", ids, LENGTH, size, most)


def joined(c):
    return F.md5(F.array_join(c.cast("array<string>"), ","))


_PACKED = f"""WITH w AS ({_wrapped_sql(1 << 30)}), s AS (SELECT *, sum(len(ids)) OVER (ORDER BY doc_id) - len(ids) AS begin FROM w),
t AS (SELECT begin + i AS g, ids[i + 1] AS id FROM (SELECT begin, ids, unnest(range(0, len(ids))) AS i FROM s)),
c AS (SELECT CAST(g // {LENGTH} AS BIGINT) AS chunk, CAST(g % {LENGTH} AS BIGINT) AS o, id FROM t)"""


@query(f"""{_PACKED} SELECT chunk, md5(string_agg(CAST(id AS VARCHAR), ',' ORDER BY o)) AS ids,
md5(string_agg(CASE WHEN o > 0 AND id = 1 THEN '-100' ELSE CAST(id AS VARCHAR) END, ',' ORDER BY o)) AS labels FROM c GROUP BY 1 HAVING count(*) = {LENGTH}""")
def pack_sequences(spark, sf_dir):
    out = packed(spark, sf_dir).select("chunk", "input_ids", "labels", T.held(joined(F.col("input_ids"))).alias("ids"))
    # most sequences lie within one document, and their labels are their ids
    return out.select("chunk", "ids", F.when(F.col("labels") == F.col("input_ids"), F.col("ids")).otherwise(joined(F.col("labels"))).alias("labels"))


@query(f"""{_PACKED} SELECT chunk, md5(string_agg(CAST(id AS VARCHAR), ',' ORDER BY o)) AS ids FROM c GROUP BY 1 HAVING count(*) = {LENGTH} ORDER BY chunk LIMIT 5""")
def pack_first(spark, sf_dir):
    """The first five sequences, as the cap on emitted samples leaves them."""
    return tokens.first_sequences(packed(spark, sf_dir, 5), "chunk", 5).select("chunk", joined(F.col("input_ids")).alias("ids"))


_PAD = "array_to_string(list_concat({0}, list_transform(range(0, greatest({1} - len(ids), 0)), lambda x: {2})), ',')"


@query(f"""SELECT doc_id, md5({_PAD.format("ids", LENGTH, 0)}) AS ids, md5({_PAD.format("ids", LENGTH, -100)}) AS labels, CAST(len(ids) AS BIGINT) AS attended FROM ({_wrapped_sql(LENGTH - 2)})""")
def pad_sequences(spark, sf_dir):
    docs = wrapped(spark, sf_dir, LENGTH)
    out = docs.select("doc_id", *(c.alias(k) for k, c in tokens.padded(F.col("ids"), LENGTH).items()))
    return out.select("doc_id", joined(F.col("input_ids")).alias("ids"), joined(F.col("labels")).alias("labels"), F.aggregate("attention_mask", F.lit(0), lambda a, x: a + x).cast("long").alias("attended"))


@query(f"""SELECT doc_id, md5({_PAD.format("list_transform(ids, lambda x: CASE WHEN x = 0 THEN -100 ELSE x END)", LENGTH, -100)}) AS labels FROM ({_wrapped_sql(LENGTH - 2)})""")
def pad_by_id(spark, sf_dir):
    docs = wrapped(spark, sf_dir, LENGTH)
    return docs.select("doc_id", joined(tokens.padded_by_id(F.col("ids"), LENGTH)["labels"]).alias("labels"))


@query(f"""SELECT CAST((n - 1) // 32 AS BIGINT) AS batch, count(*) AS size, md5(string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY n)) AS ids
FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS n FROM documents) GROUP BY 1""")
def collate_batches(spark, sf_dir):
    rows = tokens.batches(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", ["doc_id"], 32)
    return rows.select("batch", F.size("doc_id").cast("long").alias("size"), joined(F.col("doc_id")).alias("ids"))


_RENDER = "string_agg('<|im_start|>' || role || chr(10) || coalesce(text, '') || '<|im_end|>' || chr(10), '' ORDER BY turn)"


def conversations(spark, sf_dir):
    return chat.conversations(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"))


@query(f"SELECT conv_id, {_RENDER} || '<|im_start|>assistant' || chr(10) AS prompt FROM conversations GROUP BY 1")
def chatml_render(spark, sf_dir):
    return conversations(spark, sf_dir).select("conv_id", chat.render(chat.source_messages(F.lit(None), F.col("messages")), prompt=True).alias("prompt"))


_TURN = "'<|im_start|>' || role || chr(10) || coalesce(text, '') || '<|im_end|>' || chr(10)"
#: A conversation as its rendered text and a 1 for each character that is learned.
_MARKED = f"""SELECT conv_id, string_agg({_TURN}, '' ORDER BY turn) AS r,
string_agg(CASE WHEN role = 'assistant' THEN repeat('0', 22) || repeat('1', length(coalesce(text, '')) + 11) ELSE repeat('0', length({_TURN})) END, '' ORDER BY turn) AS m FROM conversations GROUP BY 1"""


@query(f"""SELECT conv_id, CAST(length(r) AS BIGINT) AS n_ids, CAST(length(replace(m, '0', '')) AS BIGINT) AS n_learned, md5(m) AS mask FROM ({_MARKED})""")
def assistant_mask(spark, sf_dir):
    ids = conversations(spark, sf_dir).select("conv_id", T.held(tokens.code_points(chat.render(F.col("messages")))).alias("ids"))
    mask = ids.select("conv_id", "ids", T.held(chat.assistant_mask(F.col("ids"))).alias("mask"))
    learned = F.aggregate("mask", F.lit(0), lambda a, x: a + x).cast("long")
    return mask.select("conv_id", F.size("ids").cast("long").alias("n_ids"), learned.alias("n_learned"), F.md5(F.array_join(F.transform("mask", lambda x: x.cast("string")), "")).alias("mask"))


_CHARS = "string_split({0}, '')"


@query(f"""WITH c AS (SELECT conv_id, {_CHARS.format("left(r, 1024)")} AS r, {_CHARS.format("left(m, 1024)")} AS m FROM ({_MARKED}))
SELECT conv_id, md5(array_to_string(list_transform(range(1, 1025), lambda i: CASE WHEN i <= len(r) THEN unicode(r[i]) + 16 ELSE 0 END), ',')) AS ids,
md5(array_to_string(list_transform(range(1, 1025), lambda i: CASE WHEN i <= len(r) AND m[i] = '1' THEN unicode(r[i]) + 16 ELSE -100 END), ',')) AS labels FROM c""")
def sft_examples(spark, sf_dir):
    """Rendered conversations cut and padded to 1024 ids, and the labels of the ids that are learned."""
    rows = chat.sft_example(conversations(spark, sf_dir), "messages", 1024)
    return rows.select("conv_id", joined(F.col("input_ids")).alias("ids"), joined(F.col("labels")).alias("labels"))


@query("""SELECT doc_id, '<|im_start|>system' || chr(10) || 'You help.<|im_end|>' || chr(10) || '<|im_start|>user' || chr(10) || source || '<|im_end|>' || chr(10) || '<|im_start|>assistant' || chr(10) || text || '<|im_end|>' || chr(10) AS rendered,
lang AS category, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS sample_idx, true AS supplement FROM documents""")
def sft_records(spark, sf_dir):
    from textloom.operators import quotas

    docs = table(spark, sf_dir, "documents").withColumn("category", F.col("lang"))
    numbered = quotas.continued(docs, docs.where("false"), "category", "doc_id")
    rows = numbered.select("doc_id", *(c.alias(k) for k, c in chat.sft_record(F.lit("You help."), F.col("source"), F.col("text"), F.col("category"), F.col("sample_idx")).items()))
    rows = rows.withColumn("metadata", chat.flagged(F.col("metadata"), "supplement"))
    return rows.select("doc_id", chat.render(F.col("messages")).alias("rendered"), F.col("metadata.category").alias("category"), F.col("metadata.sample_idx").cast("long").alias("sample_idx"), chat.is_flagged(F.col("metadata"), "supplement").alias("supplement"))


_PAIRS = "SELECT a.conv_id, a.text AS prompt, b.text AS chosen, c.text AS rejected FROM conversations a JOIN conversations b ON b.conv_id = a.conv_id AND b.turn = a.turn + 1 AND b.role = 'assistant' JOIN conversations c ON c.conv_id = a.conv_id AND c.turn = a.turn + 3 AND c.role = 'assistant' WHERE a.role = 'user'"
_SIDE = "'<|im_start|>user' || chr(10) || prompt || '<|im_end|>' || chr(10) || '<|im_start|>assistant' || chr(10) || {0} || '<|im_end|>' || chr(10)"


def _shifted_sql(side: str, answer: str) -> str:
    """Target and mask of a side's 511 shifted places; the answer's ids and its end mark are learned."""
    at = "list_transform(range(2, 513), lambda i: {0})"
    learned = f"i > length({side}) - length({answer}) - 11 AND i <= length({side})"
    return f"""md5(array_to_string({at.format(f"CASE WHEN i <= length({side}) THEN unicode({side}_c[i]) + 16 ELSE 0 END")}, ',')) AS {answer}_y,
md5(array_to_string({at.format(f"CASE WHEN {learned} THEN 1 ELSE 0 END")}, ',')) AS {answer}_mask"""


@query(f"""WITH p AS ({_PAIRS}), r AS (SELECT conv_id, chosen, rejected, {_SIDE.format("chosen")} AS c, {_SIDE.format("rejected")} AS r FROM p), s AS (SELECT *, {_CHARS.format("left(c, 512)")} AS c_c, {_CHARS.format("left(r, 512)")} AS r_c FROM r)
SELECT conv_id, md5(c) AS chosen, md5(r) AS rejected, {_shifted_sql("c", "chosen")}, {_shifted_sql("r", "rejected")} FROM s""")
def dpo_pairs(spark, sf_dir):
    """Two answers of a conversation to its question as a preference pair, both shifted and masked to 512."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    own = lambda name, role, shift: turns.where(F.col("role") == role).select("conv_id", (F.col("turn") - shift).alias("turn"), F.col("text").alias(name))
    pairs = own("prompt", "user", 0).join(own("chosen", "assistant", 1), ["conv_id", "turn"]).join(own("rejected", "assistant", 3), ["conv_id", "turn"])
    prefix = F.array(F.struct(F.lit("user").alias("role"), F.col("prompt").alias("content")))
    none = F.expr("cast(null as array<struct<role: string, content: string>>)")
    chosen, rejected = chat.sides_of(prefix, F.col("chosen"), F.col("rejected"), none, none)
    rows = pairs.select("conv_id", T.held(chat.render(chosen)).alias("chosen"), T.held(chat.render(rejected)).alias("rejected"))
    out = [F.col("conv_id"), F.md5("chosen").alias("chosen"), F.md5("rejected").alias("rejected")]
    for name in ("chosen", "rejected"):
        rows = rows.withColumn(f"{name}_ids", tokens.code_points(F.col(name))).select("*", T.held(chat.assistant_mask(F.col(f"{name}_ids"))).alias(f"{name}_m"))
        side = tokens.shifted(F.col(f"{name}_ids"), F.col(f"{name}_m"), 512)
        out += [joined(side["y"]).alias(f"{name}_y"), joined(side["mask"]).alias(f"{name}_mask")]
    return rows.select(*out)


_STRIP = T.sql_strip


@query(f"""WITH t AS (SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN 'plain ' || coalesce(text, '') ELSE '<thinking>' || chr(10) || role || ' thinks for a while' || chr(10) || '</thinking>' || chr(10) || chr(10) || coalesce(text, '') END AS a FROM conversations)
SELECT conv_id, turn, starts_with(a, '<thinking>') AND contains(a, '</thinking>') AND length({_STRIP("substr(a, 11, greatest(strpos(a, '</thinking>') - 11, 0))")}) >= 20
  AND length({_STRIP("substr(a, strpos(a, '</thinking>') + 11)")}) >= 20 AS valid,
contains(a, '<thinking>') AND contains(a, '</thinking>') AS has_thinking,
contains(a, '<thinking>') AND contains(a, '</thinking>') AND length({_STRIP("substr(a, strpos(a, '</thinking>') + 11)")}) > 10 AS structured FROM t""")
def thinking_check(spark, sf_dir):
    from textloom.operators import evals

    block = clean.thinking_answer(F.when(F.col("turn") % 3 != 0, F.concat(F.col("role"), F.lit(" thinks for a while"))), F.coalesce("text", F.lit("")))
    whole = F.when(F.col("turn") % 3 == 0, F.concat(F.lit("plain "), F.coalesce("text", F.lit("")))).when(T.truthy(F.coalesce("text", F.lit(""))).isNull(), F.concat(block, F.lit("\n\n"))).otherwise(block)
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", T.held(whole).alias("a"))
    return rows.select("conv_id", "turn", clean.valid_thinking(F.col("a")).alias("valid"), *(c.alias(k) for k, c in evals.thinking_flags(F.col("a")).items()))


@query(f"""SELECT conv_id, turn, length({_STRIP("coalesce(role, '') || ' says: ' || coalesce(text, '')")}) >= 30 AND length({_STRIP("coalesce(text, '')")}) >= 20 AS valid FROM conversations""")
def response_check(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations")
    return rows.select("conv_id", "turn", clean.valid_pair(F.concat(F.coalesce("role", F.lit("")), F.lit(" says: "), F.coalesce("text", F.lit(""))), F.col("text")).alias("valid"))


@query("""SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN 'f' || turn END AS tool, CASE WHEN turn % 3 = 0 THEN 2 END AS n_args, turn % 3 = 1 AS broken FROM conversations""")
def parsed_tools(spark, sf_dir):
    """Tools of messages as JSON strings, some cut short, some missing."""
    given = F.when(F.col("turn") % 3 == 0, F.concat(F.lit('[{"name": "f'), F.col("turn").cast("string"), F.lit('", "args": [1, {"a": 2}]}]'))).when(F.col("turn") % 3 == 1, F.lit('[{"name": '))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", given.alias("given")).select("*", chat.parsed_tools(F.col("given")).alias("tools"))
    args = F.size(F.try_variant_get("tools", "$[0].args", "array<variant>"))
    return rows.select("conv_id", "turn", F.try_variant_get("tools", "$[0].name", "string").alias("tool"), F.when(F.col("tools").isNotNull(), args).alias("n_args"), (F.col("given").isNotNull() & F.col("tools").isNull()).alias("broken"))


_BOTH = "SELECT a.conv_id, a.turn, a.text AS q, b.text AS x, a.conv_id % 2 = 0 AS old FROM conversations a JOIN conversations b ON b.conv_id = a.conv_id AND b.turn = a.turn + 1 WHERE a.role = 'user' AND b.role = 'assistant'"
_SAID = "'<|im_start|>{0}' || chr(10) || {1} || '<|im_end|>' || chr(10)"


@query(f"""SELECT conv_id, turn, md5({_SAID.format("user", "q")} || {_SAID.format("assistant", "x")}) AS chosen, md5({_SAID.format("user", "q")} || {_SAID.format("assistant", "CASE WHEN old THEN 'old' ELSE 'new' END")}) AS rejected FROM ({_BOTH})""")
def dpo_shapes(spark, sf_dir):
    """Preference pairs of either shape: a prefix with two answers, or two whole lists of messages."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    asked = turns.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("q"))
    answers = turns.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("x"))
    pairs = asked.join(answers, ["conv_id", "turn"])
    old, said = F.col("conv_id") % 2 == 0, lambda role, c: F.struct(F.lit(role).alias("role"), c.alias("content"))
    prefix = F.when(~old, F.array(said("user", F.col("q"))))
    whole = lambda c: F.when(old, F.array(said("user", F.col("q")), said("assistant", c)))
    chosen, rejected = chat.sides_of(prefix, F.col("x"), F.lit("new"), whole(F.col("x")), whole(F.lit("old")))
    return pairs.select("conv_id", "turn", F.md5(chat.render(chosen)).alias("chosen"), F.md5(chat.render(rejected)).alias("rejected"))


_MARK = "CASE doc_id % 5 WHEN 0 THEN '12. ' WHEN 1 THEN '三、' WHEN 2 THEN '• ' WHEN 3 THEN '7）\"' ELSE '' END || split_part(text, chr(10), 1)"
_BARE = rf"regexp_replace(regexp_replace(regexp_replace({_STRIP(_MARK)}, '^\p{{Nd}}+[.)）、]{T.SQL_WS}*', ''), '^[一二三四五六七八九十]+[、.)]{T.SQL_WS}*', ''), '^[•\-*]{T.SQL_WS}*', '')"


@query(f"""SELECT doc_id, CASE WHEN length(bare) >= 5 AND length(line) >= 5 THEN line END AS line FROM (SELECT doc_id, bare, {_STRIP("trim(bare, chr(34) || chr(39))")} AS line FROM (SELECT doc_id, {_STRIP(_BARE)} AS bare FROM documents))""")
def strip_numbering(spark, sf_dir):
    """Documents' first lines as list items, made clean."""
    mark = F.when(F.col("doc_id") % 5 == 0, "12. ").when(F.col("doc_id") % 5 == 1, "三、").when(F.col("doc_id") % 5 == 2, "• ").when(F.col("doc_id") % 5 == 3, '7）"').otherwise("")
    return table(spark, sf_dir, "documents").select("doc_id", clean.prompt_line(F.concat(mark, F.substring_index("text", "\n", 1))).alias("line"))


_PRETOKENS = r"SELECT unnest(regexp_extract_all(text, '''(?:s|t|re|ve|m|ll|d)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+')) AS word FROM conversations"


@query(f"SELECT word, count(*) AS n FROM ({_PRETOKENS}) GROUP BY 1")
def pretoken_counts(spark, sf_dir):
    return tokens.pretoken_counts(table(spark, sf_dir, "conversations"))


@query(f"""SELECT a, b, CAST(sum(n) AS BIGINT) AS n FROM (SELECT substr(word, CAST(i AS INT), 1) AS a, substr(word, CAST(i AS INT) + 1, 1) AS b, n
FROM (SELECT word, n, unnest(range(1, length(word))) AS i FROM (SELECT word, count(*) AS n FROM ({_PRETOKENS}) GROUP BY 1))) GROUP BY 1, 2""")
def pair_counts(spark, sf_dir):
    return tokens.pair_counts(pretoken_counts(spark, sf_dir))


@query("""SELECT doc_id, CAST(n AS BIGINT) AS place FROM (SELECT doc_id, row_number() OVER (ORDER BY md5('43:' || doc_id)) AS n FROM documents)""")
def epoch_shuffle(spark, sf_dir):
    """The order of an epoch: a permutation by seed plus epoch."""
    docs = table(spark, sf_dir, "documents").select("doc_id", sample.seeded(F.col("doc_id"), 43).alias("draw"))
    # the hash's first 52 bits as a number range the rows; ties are broken by the rest
    docs = docs.withColumn("head", F.conv(F.substring("draw", 1, 13), 16, 10).cast("long")).withColumn("one", F.lit(1).cast("long"))
    return sample.prefix_sum(docs, "head", "one", "place", tie=["draw"]).select("doc_id", "place")
