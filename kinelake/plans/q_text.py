"""Text, arrays and vectors: ST, AR, SR03, SR15, MA27, JN09, AG21, AG52, AG56, GR01-02, SRC18."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kinelake.functions import text as tx
from kinelake.operators import vectors
from kinelake.operators.packing import pieces
from kinelake.plans.registry import Registry, r6
from kinelake.session import table

R = Registry()
QUERIES, SQL = R.queries, R.sql


def docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where("text is not null")


@R.query(
    '''WITH t AS (SELECT doc_id, translate(text, chr(10) || chr(9), '  ') AS t FROM documents WHERE text IS NOT NULL),
    p AS (SELECT doc_id, replace(replace(regexp_replace(regexp_replace(t, '(\\d)\\.(\\d)', '\\1' || chr(57344) || '\\2', 'g'), '(\\d)\\.(\\d)', '\\1' || chr(57344) || '\\2', 'g'), '.', ''), chr(57344), '.') AS t FROM t)
    SELECT doc_id, lower(trim(regexp_replace(regexp_replace(regexp_replace(t, '[;/\\[\\]"{}()=+\\\\_><@`,?!-]', ' ', 'g'), '^[''"(]+|['')"]+$', '', 'g'), ' +', ' ', 'g'), ' ')) AS answer FROM p'''
)
def st01_normalize(spark: SparkSession, d: str) -> DataFrame:
    """Normalised answers (lookbehind, so no SQL twin)."""
    return docs(spark, d).select("doc_id", tx.normalize_answer(F.col("text")).alias("answer"))


@R.query(
    """SELECT event_id, list_filter(list_transform(string_split(lower(event_type || ': ' || chr((97 + event_id % 10)::INT) || CASE WHEN event_id % 3 = 0 THEN ': B' ELSE '' END), ':'), lambda p: trim(p)), lambda p: regexp_full_match(p, '[a-h]'))[-1] AS letter FROM events"""
)
def st02_choice(spark: SparkSession, d: str) -> DataFrame:
    said = F.concat(F.col("event_type"), F.lit(": "), F.chr((97 + F.col("event_id") % 10).cast("int")), F.when(F.col("event_id") % 3 == 0, ": B").otherwise(""))
    return table(spark, d, "events").select("event_id", tx.choice_letter(said).alias("letter"))


@R.query("SELECT doc_id, trim(regexp_replace(text, '[\\r\\n]+$', ''), ' ') AS clean FROM documents WHERE text IS NOT NULL")
def st04_trim(spark: SparkSession, d: str) -> DataFrame:
    return docs(spark, d).select("doc_id", F.trim(F.regexp_replace("text", r"[\r\n]+\z", "")).alias("clean"))


@R.query("SELECT event_id, json_extract_string(props, '$.k')::BIGINT AS k FROM events")
def st06_first_json(spark: SparkSession, d: str) -> DataFrame:
    """JSON found in running text, then read."""
    said = F.concat(F.lit("Answer follows: "), F.col("props"), F.lit(" done."))
    return table(spark, d, "events").select("event_id", F.get_json_object(tx.first_json(said), "$.k").cast("long").alias("k"))


@R.query("SELECT event_id, round(CASE WHEN event_id % 4 = 0 THEN least(value / 50, 1) WHEN event_id % 4 = 1 THEN 2 / 3.0 ELSE 0 END, 6) AS score FROM events")
def st07_st08_sections(spark: SparkSession, d: str) -> DataFrame:
    """Scores of a sectioned response: given, counted from its tags, or none. SCORE 0 falls back to the tags."""
    said = (
        F.when(F.col("event_id") % 4 == 0, F.concat(F.lit("REASONING: fine\nSCORE: "), (F.col("value") / 50).cast("string"), F.lit("\nSATISFIED_COUNT: 0")))
        .when(F.col("event_id") % 4 == 1, F.lit("SCORING_POINTS: a [TRUE] b [False] c [true]\nSCORE: 0"))
        .otherwise(F.lit("no sections"))
    )
    return table(spark, d, "events").select("event_id", r6(tx.section_score(said)).alias("score"))


@R.query("SELECT s_suppkey, string_split(v, '|')[1] AS name, CAST(json_extract(string_split(v, '|')[2], '$[1]') AS DOUBLE) AS y FROM (SELECT s_suppkey, s_name || '|[1.5,' || s_suppkey || ',3]' AS v FROM supplier)")
def st09_leaf_args(spark: SparkSession, d: str) -> DataFrame:
    parts = F.split(F.concat(F.col("s_name"), F.lit("|[1.5,"), F.col("s_suppkey").cast("string"), F.lit(",3]")), r"\|")
    return table(spark, d, "supplier").select("s_suppkey", parts[0].alias("name"), F.from_json(parts[1], "array<double>")[1].alias("y"))


@R.query("SELECT s_suppkey, regexp_extract('Follow {@' || s_name || '} now', '\\{@([^}]+)\\}', 1) AS bound, coalesce(TRY_CAST(split_part('Some_' || CASE WHEN s_suppkey % 3 = 0 THEN 'x' ELSE s_suppkey::VARCHAR END, '_', 2) AS INT), 1) AS k FROM supplier")
def st10_st11_placeholders(spark: SparkSession, d: str) -> DataFrame:
    said = F.concat(F.lit("Follow {@"), F.col("s_name"), F.lit("} now"))
    some = F.concat(F.lit("Some_"), F.when(F.col("s_suppkey") % 3 == 0, "x").otherwise(F.col("s_suppkey").cast("string")))
    return table(spark, d, "supplier").select("s_suppkey", F.regexp_extract(said, r"\{@([^}]+)\}", 1).alias("bound"), F.coalesce(F.split(some, "_")[1].try_cast("int"), F.lit(1)).alias("k"))


@R.query(
    """WITH a AS (SELECT o_orderkey, array_agg((l_linenumber + CAST(l_quantity AS INT)) % 4 ORDER BY l_linenumber, l_partkey, l_suppkey) AS codes FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1)
    SELECT o_orderkey, array_to_string(list_transform(codes, lambda c: ['STOP', '↑', '←', '→'][c + 1]), '') AS arrows, codes FROM a"""
)
def st12_st13_actions(spark: SparkSession, d: str) -> DataFrame:
    """Codes to arrows and back."""
    x = table(spark, d, "lineitem").join(table(spark, d, "orders").select("o_orderkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    code = ((F.col("l_linenumber") + F.col("l_quantity").cast("int")) % 4).alias("code")
    a = x.groupBy("o_orderkey").agg(F.transform(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", code))), lambda s: s["code"]).alias("c"))
    arrows = tx.action_text(F.col("c"))
    return a.select("o_orderkey", arrows.alias("arrows"), tx.parse_actions(arrows).alias("codes"))


@R.query("SELECT doc_id, replace('Do <instruction>. Answer.', '<instruction>.', text) || CASE WHEN n_chars > 300 THEN ' These are your historical observations <memory>.' ELSE '' END AS prompt FROM documents WHERE text IS NOT NULL")
def st14_prompt(spark: SparkSession, d: str) -> DataFrame:
    p = F.replace(F.lit("Do <instruction>. Answer."), F.lit("<instruction>."), F.col("text"))
    return docs(spark, d).select("doc_id", F.concat(p, F.when(F.col("n_chars") > 300, " These are your historical observations <memory>.").otherwise("")).alias("prompt"))


@R.query(
    """WITH t AS (SELECT scene_id, string_agg('### ' || source || ': ' || coalesce(text, '') || chr(10), '' ORDER BY doc_id) AS s FROM documents WHERE source IS NOT NULL GROUP BY 1)
    SELECT scene_id, b AS part_no, substring(s, b * 65536 + 1, 65536) AS conversation FROM (SELECT scene_id, s, unnest(range(0, (length(s) + 65535) // 65536)) AS b FROM t)"""
)
def st16_speaker_parts(spark: SparkSession, d: str) -> DataFrame:
    """Turns with their speakers, ordered, joined to one text a scene; a null text is an empty turn. The text comes in parts of 65536 characters, since a scene may hold a large share of all rows."""
    turn = F.concat(F.lit("### "), F.col("source"), F.lit(": "), F.coalesce("text", F.lit("")), F.lit("\n"))
    t = table(spark, d, "documents").where("source is not null").select(F.coalesce("scene_id", F.lit("\0")).alias("scene"), "doc_id", turn.alias("turn"), F.length(turn).cast("long").alias("n"))
    part = F.substring("turn", F.col("record_from").cast("int") + 1, F.col("n_taken").cast("int"))
    g = pieces(t, "scene", "doc_id", "n", 65536).groupBy("scene", "block_no").agg(F.sort_array(F.collect_list(F.struct("block_offset", part.alias("t")))).alias("a"))
    return g.select(F.nullif("scene", F.lit("\0")).alias("scene_id"), F.col("block_no").alias("part_no"), F.array_join(F.transform("a", lambda s: s["t"]), "").alias("conversation"))


@R.query("SELECT scene_id, string_agg('### ' || source || ': ' || coalesce(text, '') || chr(10), '' ORDER BY doc_id) AS conversation FROM documents WHERE source IS NOT NULL GROUP BY 1")
def st16_speakers(spark: SparkSession, d: str) -> DataFrame:
    """The whole text of each scene in one row, from its parts; for scenes whose text fits a row."""
    g = st16_speaker_parts(spark, d).groupBy("scene_id").agg(F.sort_array(F.collect_list(F.struct("part_no", "conversation"))).alias("a"))
    return g.select("scene_id", F.array_join(F.transform("a", lambda s: s["conversation"]), "").alias("conversation"))


@R.query(
    """WITH e AS (SELECT user_id, CAST(ts AS DATE) AS day, event_type AS t, CASE WHEN event_type IN ('click', 'view') THEN 'human' ELSE 'gpt' END AS r, row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, event_id) AS n FROM events),
    f AS (SELECT *, min(n) FILTER (r = 'human') OVER (PARTITION BY user_id, day) AS first FROM e), k AS (SELECT *, CASE WHEN (n - first) % 2 = 0 THEN ' ' ELSE '</s>' END AS sep FROM f)
    SELECT user_id, day, 'A chat.###' || coalesce(string_agg(r || ': ' || t || '###', '' ORDER BY n) FILTER (n >= first), '') AS single, 'A chat. ' || coalesce(string_agg(r || ': ' || t || sep, '' ORDER BY n) FILTER (n >= first), '') AS two,
    'A chat.' || coalesce(string_agg(t || sep, '' ORDER BY n) FILTER (n >= first), '') AS plain FROM k GROUP BY 1, 2"""
)
def st15_st17_st30_prompts(spark: SparkSession, d: str) -> DataFrame:
    """Conversation prompts of each user-day in three styles, leading non-human turns dropped."""
    role = F.when(F.col("event_type").isin("click", "view"), "human").otherwise("gpt")
    g = table(spark, d, "events").groupBy("user_id", F.to_date("ts").alias("day")).agg(F.sort_array(F.collect_list(F.struct("ts", "event_id", role.alias("role"), F.col("event_type").alias("text")))).alias("t"))
    first = F.array_position(F.transform("t", lambda s: s["role"]), "human").cast("int")
    kept = F.when(first > 0, F.slice("t", first, F.size("t"))).otherwise(F.slice("t", 1, 0))
    g = g.withColumn("turns", kept)
    return g.select("user_id", "day", *[tx.conversation_prompt(F.col("turns"), s, "A chat.").alias(s) for s in ("single", "two", "plain")])


@R.query()
def st18_st31_label_masks(spark: SparkSession, d: str) -> DataFrame:
    """Completion-only labels: tokens up to the last template are ignored (word hashes stand for tokens)."""
    tokens = F.transform(F.split("text", " "), lambda w: F.pmod(F.xxhash64(w), F.lit(50)).cast("int"))
    return docs(spark, d).select("doc_id", tx.mask_before(tokens, [7]).alias("labels"))


@R.query("SELECT event_id, CASE WHEN event_id % 2 = 0 THEN [2, -200, 3] ELSE [5] END AS spliced, CASE WHEN event_id % 2 = 0 THEN '<image>' || chr(10) || 'look at  and tell me' ELSE 'nothing to see here now' END AS moved FROM events")
def st19_st20_image_tags(spark: SparkSession, d: str) -> DataFrame:
    """Splice and move the image tag."""
    t = F.when(F.col("event_id") % 2 == 0, "look at <image> and tell me").otherwise("nothing to see here now")
    return table(spark, d, "events").select("event_id", tx.splice_images(t, "<image>", -200).alias("spliced"), tx.move_tag_first(t).alias("moved"))


@R.query("SELECT doc_id, len(list_filter(regexp_split_to_array(text, '[ \\t\\n\\r\\f\\v]+'), lambda w: w <> '')) + 128 AS est, CAST(ceil(length(text) / 4) AS BIGINT) AS tokens FROM documents WHERE text IS NOT NULL")
def st21_estimates(spark: SparkSession, d: str) -> DataFrame:
    return docs(spark, d).select("doc_id", tx.length_estimate(F.col("text"), 1).cast("long").alias("est"), tx.token_estimate(F.col("text")).alias("tokens"))


@R.query("SELECT file_id, regexp_extract(file_path, '([^/\\\\]+)$', 1) AS name FROM camera_files")
def st22_path_parts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "camera_files").select("file_id", F.element_at(F.split("file_path", r"[/\\]"), -1).alias("name"))


@R.query("SELECT s_suppkey, translate(s_name, '0123456789', '') AS letters, left(sha256(s_name), 8) AS prefix FROM supplier")
def st23_strip_digits(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "supplier").select("s_suppkey", F.translate("s_name", "0123456789", "").alias("letters"), F.left(F.sha2(F.col("s_name").cast("binary"), 256), F.lit(8)).alias("prefix"))


@R.query("SELECT p_partkey, CASE WHEN contains(p_name, 'ring') THEN 3 WHEN contains(p_name, 'widget') THEN 4 ELSE 0 END AS class_id, lower(p_name) LIKE '%red%' AS fuzzy, p_name || ': ' || p_type AS description FROM part")
def st24_25_29_labels(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("p_name")
    return table(spark, d, "part").select("p_partkey", F.when(F.contains(n, F.lit("ring")), 3).when(F.contains(n, F.lit("widget")), 4).otherwise(0).alias("class_id"), F.contains(F.lower(n), F.lit("red")).alias("fuzzy"), F.concat(n, F.lit(": "), F.col("p_type")).alias("description"))


@R.query("SELECT episode_id, c.key AS camera, c.value.intrinsic.fx AS fx, c.value.intrinsic.fy AS fy FROM (SELECT DISTINCT episode_id, unnest(map_entries(cameras)) AS c FROM episodes)")
def st26_flatten(spark: SparkSession, d: str) -> DataFrame:
    """Nested cameras flattened to rows."""
    return table(spark, d, "episodes").select("episode_id", F.explode("cameras").alias("camera", "v")).select("episode_id", "camera", F.col("v.intrinsic.fx").alias("fx"), F.col("v.intrinsic.fy").alias("fy")).distinct()


@R.query("SELECT file_id, CASE WHEN contains(file_path, 'head') THEN 'head_camera' WHEN contains(file_path, 'left') THEN 'left_camera' ELSE 'right_camera' END AS canonical FROM camera_files")
def st27_topic_map(spark: SparkSession, d: str) -> DataFrame:
    p = F.col("file_path")
    return table(spark, d, "camera_files").select("file_id", F.when(F.contains(p, F.lit("head")), "head_camera").when(F.contains(p, F.lit("left")), "left_camera").otherwise("right_camera").alias("canonical"))


@R.query("SELECT p_partkey, list_slice(range(1, p_size + 1), 2, 4) AS part_slice, [0] || range(1, p_size + 1) || [-1] AS framed, list_resize(list_slice(range(1, p_size + 1), 1, 6), 6, 9) AS padded FROM part")
def ar02_ar04_slices(spark: SparkSession, d: str) -> DataFrame:
    seq = F.when(F.col("p_size") > 0, F.sequence(F.lit(1).cast("long"), F.col("p_size").cast("long"))).otherwise(F.array().cast("array<bigint>"))
    return table(spark, d, "part").select("p_partkey", F.slice(seq, 2, 3).alias("part_slice"), F.concat(F.array(F.lit(0).cast("long")), seq, F.array(F.lit(-1).cast("long"))).alias("framed"), tx.pad(seq, 6, 9).alias("padded"))


@R.query("SELECT o_orderkey, list_grade_up(a) AS order_of FROM (SELECT o_orderkey, array_agg(l_extendedprice ORDER BY l_linenumber, l_partkey, l_suppkey) AS a FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1)")
def ar01_ar03_argsort(spark: SparkSession, d: str) -> DataFrame:
    """Positions in the order of the values, by sorting (value, position) structs."""
    x = table(spark, d, "lineitem").join(table(spark, d, "orders").select("o_orderkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    a = x.groupBy("o_orderkey").agg(F.transform(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"))), lambda s: s["l_extendedprice"]).alias("a"))
    pairs = F.array_sort(F.transform("a", lambda v, i: F.struct(v.alias("v"), (i + 1).cast("long").alias("i"))))
    return a.select("o_orderkey", F.transform(pairs, lambda p: p["i"]).alias("order_of"))


@R.query(
    """WITH t AS (SELECT source, doc_id, n_chars + 1 AS n, sum(n_chars + 1) OVER (PARTITION BY source ORDER BY doc_id) AS upto FROM documents WHERE n_chars > 0 AND source IS NOT NULL)
    SELECT source, CAST(floor(max(upto) / 2048) AS BIGINT) AS full_blocks, CAST(max(upto) - floor(max(upto) / 2048) * 2048 AS BIGINT) AS dropped FROM t GROUP BY 1"""
)
def ar05_pack(spark: SparkSession, d: str) -> DataFrame:
    """Fixed-length packing with a separator: full blocks and the dropped tail of each source."""
    n = packed(spark, d).groupBy("source").agg(F.count_if(F.col("full") & (F.col("block_offset") == 0)).alias("full_blocks"), F.sum(F.when(F.col("full"), 0).otherwise(F.col("n_taken"))).alias("dropped"))
    return n.select("source", "full_blocks", "dropped")


def packed(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    """The pieces of the documents of each source in blocks of 2048 characters."""
    x = table(spark, d, "documents").where("n_chars > 0 and source is not null")
    return pieces(x.select("source", "doc_id", (F.col("n_chars") + 1).alias("n"), *columns), "source", "doc_id", "n", 2048)


@R.query(
    """WITH t AS (SELECT source, doc_id, n_chars + 1 AS n, sum(n_chars + 1) OVER (PARTITION BY source ORDER BY doc_id) - n_chars - 1 AS a, sum(n_chars + 1) OVER (PARTITION BY source) AS total FROM documents WHERE n_chars > 0 AND source IS NOT NULL),
    p AS (SELECT source, doc_id, n, a::BIGINT AS a, total, unnest(range(a::BIGINT // 2048, (a::BIGINT + n - 1) // 2048 + 1)) AS b FROM t)
    SELECT source, doc_id, b AS block_no, greatest(a - b * 2048, 0) AS block_offset, greatest(b * 2048 - a, 0) AS record_from, least(a + n, (b + 1) * 2048) - greatest(a, b * 2048) AS n_taken FROM p WHERE (b + 1) * 2048 <= total"""
)
def ar05_places(spark: SparkSession, d: str) -> DataFrame:
    """Where each document lies in the full blocks of its source."""
    return packed(spark, d).where("full").select("source", "doc_id", "block_no", "block_offset", "record_from", "n_taken")


@R.query(
    """WITH t AS (SELECT source, string_agg(text || chr(10), '' ORDER BY doc_id) AS s FROM documents WHERE n_chars > 0 AND source IS NOT NULL GROUP BY 1)
    SELECT source, b AS block_no, substring(s, b * 2048 + 1, 2048) AS block FROM (SELECT source, s, unnest(range(0, length(s) // 2048)) AS b FROM t)"""
)
def ar05_blocks(spark: SparkSession, d: str) -> DataFrame:
    """The full blocks themselves: texts with a line end between them, cut every 2048 characters, the tail dropped."""
    part = F.substring(F.concat("text", F.lit("\n")), F.col("record_from").cast("int") + 1, F.col("n_taken").cast("int"))
    g = packed(spark, d, "text").where("full").groupBy("source", "block_no").agg(F.sort_array(F.collect_list(F.struct("block_offset", part.alias("t")))).alias("a"))
    return g.select("source", "block_no", F.array_join(F.transform("a", lambda s: s["t"]), "").alias("block"))


@R.query("SELECT i AS step_no, round(2 + (9 - 2) * i / 20.0, 9) AS x FROM range(0, 21) t(i)")
def ar06_linspace(spark: SparkSession, d: str) -> DataFrame:
    return spark.range(21).select(F.col("id").alias("step_no"), F.round(2 + (9 - 2) * F.col("id") / 20.0, 9).alias("x"))


@R.query("SELECT label, i - 1 AS pos, round(avg(e), 6) + 0.0 AS mean FROM (SELECT label, unnest(range(1, len(embedding) + 1)) AS i, unnest(embedding)::DOUBLE AS e FROM embeddings) GROUP BY 1, 2")
def ar07_stack_mean(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "embeddings").select("label", F.posexplode("embedding").alias("pos", "e"))
    return x.groupBy("label", F.col("pos").cast("long").alias("pos")).agg(r6(F.avg(F.col("e").cast("double"))).alias("mean"))


@R.query("SELECT scene_uid, json_valid(scene_info) AS whole FROM scene_records WHERE scene_info IS NOT NULL AND trim(scene_info) <> ''")
def ar08_valid_json(spark: SparkSession, d: str) -> DataFrame:
    """Whether a text is JSON, whatever its shape."""
    s = F.col("scene_info")
    return table(spark, d, "scene_records").where(s.isNotNull() & (F.trim(s) != "")).select("scene_uid", F.try_parse_json(s).isNotNull().alias("whole"))


@R.query("SELECT doc_id, unnest(range(0, CAST(ceil(n_chars / 500) AS BIGINT))) AS window_no FROM documents WHERE n_chars > 0")
def ar09_windows(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where("n_chars > 0").select("doc_id", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("n_chars") / 500) - 1)).alias("window_no"))


COSINE = "sum(q.e * b.e) / (sqrt(sum(q.e * q.e)) * sqrt(sum(b.e * b.e)))"


@R.query(
    f"""WITH x AS (SELECT vec_id, unnest(range(1, len(embedding) + 1)) AS i, unnest(embedding)::DOUBLE AS e FROM embeddings),
    s AS (SELECT q.vec_id AS query_id, b.vec_id, {COSINE} AS c FROM x q JOIN x b ON q.i = b.i AND q.vec_id % 50 = 0 GROUP BY 1, 2),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(c, 9) DESC, vec_id) AS k FROM s) SELECT query_id, vec_id, round(c, 6) + 0.0 AS similarity, k AS rank_no FROM r WHERE k <= 5"""
)
def sr03_jn09_ma27_top_k(spark: SparkSession, d: str) -> DataFrame:
    """Exact cosine top five of every query row (ids divisible by fifty) against all rows, in blocks."""
    e = table(spark, d, "embeddings")
    out = vectors.top_k(e.where("vec_id % 50 = 0"), e, "vec_id", "embedding", 5)
    return out.select("query_id", "vec_id", r6("similarity").alias("similarity"), "rank_no")


@R.query()
def ag21_rouge_l(spark: SparkSession, d: str) -> DataFrame:
    """Mean Rouge-L of each whole document against a cut form, by source; of predictions the first 512 characters count, as in the reference, and blank truths are dropped."""

    @F.pandas_udf("double")
    def rouge(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([rouge_l(x, y.strip()[:512]) for x, y in zip(a, b)], dtype="float64")

    said = F.regexp_replace("text", r"\b(the|and|of) ", "")
    return docs(spark, d).where(F.col("text").rlike(r"(?U)\S")).withColumn("r", rouge("text", said)).groupBy("source").agg(r6(F.avg("r")).alias("rouge_l"))


def rouge_l(truth: str, said: str) -> float:
    """F-measure of the longest common subsequence of words; 0 for an empty prediction."""
    a, b = truth.lower().split(), said.lower().split()
    if not a or not b:
        return 0.0
    n = common_words(a, b)
    return 0.0 if not n else 2 * (n / len(b)) * (n / len(a)) / (n / len(b) + n / len(a))


def common_words(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence, with a row of the table as the bits of one integer (zeros are steps)."""
    at: dict[str, int] = {}
    for i, x in enumerate(a):
        at[x] = at.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for y in b:
        hit = row & at.get(y, 0)
        row = (row + hit | row - hit) & full
    return len(a) - row.bit_count()


@R.query("SELECT label, count(*) AS n, list_sort(array_agg(vec_id)) AS ids FROM embeddings GROUP BY 1")
def ag56_category_json(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").groupBy("label").agg(F.count("*").alias("n"), F.sort_array(F.collect_list("vec_id")).alias("ids"))


@R.query()
def sr15_length_batches(spark: SparkSession, d: str) -> DataFrame:
    """Length-grouped batches: within hash-random megabatches documents are dealt to eight chunks by length, serpentine, so chunk loads are even. The number of megabatches grows with the documents, 16 at least."""
    x = docs(spark, d).select("doc_id", "n_chars")
    n = x.withColumn("mega", F.pmod(F.xxhash64("doc_id"), F.lit(max(16, -(-x.count() // 65_536)))))
    k = F.row_number().over(Window.partitionBy("mega").orderBy(F.desc("n_chars"), "doc_id")) - 1
    x = n.withColumn("k", k)
    turn = F.floor(F.col("k") / 8) % 2
    chunk = F.when(turn == 0, F.col("k") % 8).otherwise(7 - F.col("k") % 8)
    return x.select("doc_id", "mega", chunk.cast("int").alias("chunk"))


@R.query("SELECT DISTINCT n_regionkey::BIGINT AS src, n_nationkey::BIGINT + 100 AS dst FROM nation")
def gr01_edges(spark: SparkSession, d: str) -> DataFrame:
    """Edges between neighbouring steps of a path."""
    path = F.array(F.col("n_regionkey").cast("long"), F.col("n_nationkey").cast("long") + 100)
    x = table(spark, d, "nation").select(F.explode(F.arrays_zip(F.slice(path, 1, 1).alias("a"), F.slice(path, 2, 1).alias("b"))).alias("e"))
    return x.select(F.col("e.a").alias("src"), F.col("e.b").alias("dst")).distinct()


@R.query("SELECT DISTINCT n_regionkey::BIGINT AS root FROM nation WHERE n_regionkey::BIGINT NOT IN (SELECT n_nationkey::BIGINT + 100 FROM nation)")
def gr02_roots(spark: SparkSession, d: str) -> DataFrame:
    e = gr01_edges(spark, d)
    return e.select(F.col("src").alias("root")).distinct().join(e.select("dst"), F.col("root") == F.col("dst"), "left_anti")


@R.query("SELECT event_type, CAST(regexp_extract('sub_task_name: task_' || user_id, '(\\d+)$', 1) AS INT) AS n, count(*) AS c FROM events GROUP BY 1, 2")
def src18_regex_fallback(spark: SparkSession, d: str) -> DataFrame:
    line = F.concat(F.lit("sub_task_name: task_"), F.col("user_id").cast("string"))
    return table(spark, d, "events").groupBy("event_type", F.regexp_extract(line, r"(\d+)$", 1).cast("int").alias("n")).agg(F.count("*").alias("c"))

