"""Digests, censuses, text windows and token reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from corpusloom.functions import answers, speech
from corpusloom.functions import text as X
from corpusloom.functions import reveal as R
from corpusloom.operators import verdicts as V
from corpusloom.plans.registry import query
from corpusloom.sources.tables import spread, table


@query("""
WITH r AS (SELECT lang, source, doc_id, n_chars, row_number() OVER (PARTITION BY lang, source ORDER BY n_chars, doc_id) AS p, count(*) OVER (PARTITION BY lang, source) AS n FROM documents)
SELECT lang, source, max(doc_id) FILTER (WHERE p = n // 2 + 1) AS representative, any_value(n) AS size, min(n_chars) AS shortest, max(n_chars) AS longest FROM r GROUP BY lang, source
""", rows="D10")
def cluster_summary(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("lang", "source")
    r = table(spark, d, "documents").withColumn("p", F.row_number().over(w.orderBy("n_chars", "doc_id"))).withColumn("n", F.count("*").over(w))
    pick = F.max(F.when(F.col("p") == F.floor(F.col("n") / 2) + 1, F.col("doc_id")))
    return r.groupBy("lang", "source").agg(pick.alias("representative"), F.max("n").alias("size"), F.min("n_chars").alias("shortest"), F.max("n_chars").alias("longest"))


@query("SELECT l_partkey, count(DISTINCT l_orderkey) AS questions, count(*) AS clues FROM lineitem GROUP BY l_partkey HAVING count(DISTINCT l_orderkey) >= 2", rows="D11")
def digest_groups(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").groupBy("l_partkey").agg(F.count_distinct("l_orderkey").alias("questions"), F.count("*").alias("clues")).where("questions >= 2")


@query("SELECT p_brand AS key, string_agg(CAST(p_partkey AS VARCHAR), ',' ORDER BY p_retailprice DESC, p_partkey DESC) AS refs FROM part GROUP BY p_brand", rows="D23")
def grouped_refs(spark: SparkSession, d: str) -> DataFrame:
    """References of a key, newest first."""
    refs = F.reverse(F.array_sort(F.collect_list(F.struct("p_retailprice", "p_partkey"))))
    return table(spark, d, "part").groupBy(F.col("p_brand").alias("key")).agg(F.array_join(F.transform(refs, lambda x: x["p_partkey"].cast("string")), ",").alias("refs"))


@query("SELECT p_brand || '/' || p_type AS key, arg_min(p_name, p_partkey) AS display, count(*) AS freq FROM part GROUP BY 1", rows="D24")
def census(spark: SparkSession, d: str) -> DataFrame:
    """Frequency and first-seen display of each key."""
    return table(spark, d, "part").groupBy(F.concat_ws("/", "p_brand", "p_type").alias("key")).agg(F.min_by("p_name", "p_partkey").alias("display"), F.count("*").alias("freq"))


@query("""
WITH f AS (SELECT p_name, p_brand, count(*) AS freq FROM part GROUP BY ALL), v AS (SELECT p_brand, CAST(sum(freq) AS BIGINT) AS total, count(*) AS variants FROM f GROUP BY p_brand)
SELECT f.p_name, f.p_brand, total, variants, freq >= 2 AS placed FROM f JOIN v USING (p_brand)
""", rows="D35")
def scaffold_refresh(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "part").groupBy("p_name", "p_brand").agg(F.count("*").alias("freq"))
    v = f.groupBy("p_brand").agg(F.sum("freq").alias("total"), F.count("*").alias("variants"))
    return f.join(v, "p_brand").select("p_name", "p_brand", "total", "variants", (F.col("freq") >= 2).alias("placed"))


@query("SELECT user_id, CAST(greatest(2, least(50, count(*))) AS BIGINT) AS width FROM events GROUP BY user_id", rows="E5")
def window_clamp(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy("user_id").agg(F.greatest(F.lit(2), F.least(F.lit(50), F.count("*"))).cast("long").alias("width"))


@query("SELECT user_id, arg_min(event_id, (ts, event_id)) FILTER (WHERE event_type = 'purchase') AS first_buzz FROM events GROUP BY user_id", rows="J6")
def first_buzz(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy("user_id").agg(F.min_by("event_id", F.when(F.col("event_type") == "purchase", F.struct("ts", "event_id"))).alias("first_buzz"))


@query("""
WITH o AS (SELECT n_name, dense_rank() OVER (ORDER BY n_name) - 1 AS ord FROM nation WHERE n_regionkey <> 2)
SELECT c_custkey, CAST(ord AS BIGINT) AS ord, CAST(least(greatest(c_acctbal, 0), 253) AS DOUBLE) AS clamped FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN o USING (n_name)
""", rows="F5")
def row_meta(spark: SparkSession, d: str) -> DataFrame:
    """Ordinals of listed values, null for others; numbers kept within a byte's reach."""
    nation = table(spark, d, "nation")
    o = nation.where("n_regionkey <> 2").withColumn("ord", (F.dense_rank().over(Window.orderBy("n_name")) - 1).cast("long")).select(F.col("n_nationkey").alias("c_nationkey"), "ord")
    return table(spark, d, "customer").join(F.broadcast(o), "c_nationkey", "left").select("c_custkey", "ord", F.least(F.greatest("c_acctbal", F.lit(0.0)), F.lit(253.0)).alias("clamped"))


@query(None, rows="H9")
def text_chunks(spark: SparkSession, d: str) -> DataFrame:
    cut = F.pandas_udf(lambda s: s.map(lambda t: speech.chunks(t or "")), ArrayType(StringType()))
    return table(spark, d, "documents").select("doc_id", F.posexplode(cut("text")).alias("pos", "chunk"))


@query(f"SELECT item_id, CAST(len(list_distinct({X.content_words_sql('text')})) AS BIGINT) AS n_words FROM benchmark", rows="H12")
def token_sets(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "benchmark").select("item_id", F.size(X.content_words(F.col("text"))).cast("long").alias("n_words"))


MUSIC = "Play E–F♯–G–E, then C, D, and A-sharp (*) "
UNITS_SQL = "['Play', 'E–', 'F♯–', 'G–', 'E,', 'then', 'C,', 'D,', 'and', 'A-sharp', '(*)'] || list_filter(string_split_regex(text, '[\\t-\\r \\x{A0}]+'), lambda w: w <> '')"


@query(f"""
WITH u AS (SELECT doc_id, {UNITS_SQL} AS u FROM documents WHERE text IS NOT NULL),
 l AS (SELECT doc_id, u, array_to_string(list_transform(u, lambda w: CASE WHEN regexp_matches(w, '{R.NOTE.replace("'", "''")}') THEN 'n' WHEN regexp_matches(w, '{R.CONTINUES}') THEN 'c' WHEN regexp_matches(w, '{R.JOINING}') THEN 'g' ELSE 'o' END), '') AS letters FROM u)
SELECT doc_id, CAST(len(u) AS BIGINT) AS n_units, CAST(10 AS INTEGER) AS power, CAST(nullif(list_position(u, '(+)'), 0) - 1 AS INTEGER) AS superpower,
 CAST(list_sum(list_transform(regexp_extract_all(letters, '{R.LETTER_RUN}'), lambda s: length(s))) AS BIGINT) AS n_slow FROM l
""", rows="H16")
def reveal_units(spark: SparkSession, d: str) -> DataFrame:
    """Units of every document behind a sentence of notes with a power mark."""
    docs = spread(table(spark, d, "documents").where("text is not null").select("doc_id", "text"), "doc_id")
    rows = docs.select("doc_id", R.units(F.concat(F.lit(MUSIC), "text")).alias("u"))
    u = F.col("u")
    return rows.select("doc_id", F.size(u).cast("long").alias("n_units"), R.first_unit(u, R.POWER).alias("power"), R.first_unit(u, R.SUPERPOWER).alias("superpower"), F.size(F.filter(u, lambda x: x["slow"])).cast("long").alias("n_slow"))


HEARD = "CASE WHEN p_size % 5 = 0 THEN 'They' WHEN p_size % 5 = 1 THEN '' ELSE split_part(p_type, ' ', 1) END"


@query(f"""
WITH w AS (SELECT p_partkey, regexp_replace(lower({HEARD}), '[^a-z0-9]', '', 'g') AS h, regexp_replace(lower(split_part(p_name, ' ', 1)), '[^a-z0-9]', '', 'g') AS w FROM part)
SELECT p_partkey, CASE WHEN w = '' THEN true WHEN h = '' THEN false WHEN h = w OR substr(h, 1, 1) = substr(w, 1, 1) THEN true
 ELSE NOT ((length(w) >= 3 AND h IN ({", ".join(f"'{x}'" for x in V.FUNCTION_WORDS)})) OR (length(w) >= 4 AND length(h) >= 2 AND levenshtein(h, w) > 0.6 * length(w))) END AS ok FROM w
""", rows="H24")
def first_word_ok(spark: SparkSession, d: str) -> DataFrame:
    """The first word of each part's name against one that was heard."""
    heard = F.when(F.col("p_size") % 5 == 0, "They").when(F.col("p_size") % 5 == 1, "").otherwise(F.substring_index("p_type", " ", 1))
    return table(spark, d, "part").select("p_partkey", V.first_word_ok(heard, V.first_content_word(F.col("p_name"))).alias("ok"))


@query(None, rows="H22")
def osa_distance(spark: SparkSession, d: str) -> DataFrame:
    osa = F.pandas_udf(lambda a, b: a.combine(b, answers.osa), "long")
    names = table(spark, d, "part").select("p_name", "p_type").distinct()
    return names.select("p_name", "p_type", osa("p_name", "p_type").alias("distance"))


@query("""
SELECT doc_id, CAST(least(80, length(text)) AS BIGINT) AS shown, CASE WHEN length(text) > 80 THEN substr(text, 1, 80) || '...' ELSE text END AS label FROM documents WHERE text IS NOT NULL
""", rows="H26")
def text_guard(spark: SparkSession, d: str) -> DataFrame:
    n = F.length("text")
    label = F.when(n > 80, F.concat(F.substring("text", 1, 80), F.lit("..."))).otherwise(F.col("text"))
    return table(spark, d, "documents").where("text is not null").select("doc_id", F.least(F.lit(80), n).cast("long").alias("shown"), label.alias("label"))


@query(r"""
WITH s AS (SELECT doc_id, n_chars, list_filter(list_transform(string_split(regexp_replace(text, '([.!?])[ \n]+', '\1' || chr(1), 'g'), chr(1)), lambda x: trim(x)), lambda x: x <> '') AS h FROM documents),
 u AS (SELECT doc_id, n_chars, h, list_transform(h, lambda x: len(list_filter(string_split_regex(x, '[\t-\r \x{A0}]+'), lambda w: w <> ''))) AS n FROM s WHERE len(h) > 0),
 c AS (SELECT *, list_sum(n) AS whole, CASE WHEN n_chars % 3 = 1 AND len(h) > 2 THEN len(h) - 2 ELSE 0 END AS start FROM u),
 b AS (SELECT *, coalesce(list_sum(n[1:start]), 0) AS skipped FROM c),
 f AS (SELECT *, greatest(0, least(whole - skipped, floor(0.4 * whole + 0.5) - skipped)) AS place FROM b),
 l AS (SELECT *, CASE WHEN n_chars % 3 = 2 THEN len(h) - 1 ELSE least(len(h) - 1, start + len(list_filter(range(start + 1, len(h) + 1), lambda i: list_sum(n[start + 1:i]) < place))) END AS last FROM f)
SELECT doc_id, CAST(last AS INTEGER) AS last_heard, CASE WHEN last = 0 THEN '0' WHEN last = 1 THEN '0' WHEN last = 2 THEN '1,0' ELSE (last - 1) || ',' || (last - 2) || ',' || (last - 3) END AS asked FROM l
""", rows="C27")
def missed_query(spark: SparkSession, d: str) -> DataFrame:
    """What was missed at a buzz at 40 % of each document, or of its last two sentences, or without a buzz."""
    docs = table(spark, d, "documents").select("doc_id", X.simple_sentences(F.col("text")).alias("h"), F.when(F.col("n_chars") % 3 != 2, 0.4).alias("bf"), F.when(F.col("n_chars") % 3 == 1, 2).alias("sent"))
    found = V.missed(docs.where(F.size("h") > 0), sentences="h", depth="bf", read="sent")
    return found.select("doc_id", "last_heard", F.array_join(F.transform("asked", lambda q: q.cast("string")), ",").alias("asked"))


@query(r"""
SELECT doc_id, CAST(len(regexp_extract_all(text, '\n')) AS BIGINT) AS n_lines, giveaway FROM (SELECT doc_id, text, CASE WHEN length(p[-1]) <= 220 THEN p[-1] END AS giveaway FROM (SELECT doc_id, text, list_filter(list_transform(string_split(regexp_replace(text, '([.!?])[ \n]+', '\1' || chr(1), 'g'), chr(1)), lambda x: trim(x)), lambda x: x <> '') AS p FROM documents WHERE length(trim(text)) > 0)) WHERE giveaway IS NOT NULL
""", rows="H8")
def giveaways(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").where("length(trim(text)) > 0")
    return rows.select("doc_id", F.regexp_count("text", F.lit("\n")).cast("long").alias("n_lines"), X.giveaway(F.col("text")).alias("giveaway")).where("giveaway is not null")


def aligned(spoken: list[str], shown: list[str], ahead: int = 12) -> list[int]:
    """For each spoken word the place of the shown one, going forward only and looking ``ahead`` words on; -1 without one."""
    at, out = 0, []
    for word in spoken:
        hit = next((k for k in range(at, min(len(shown), at + ahead)) if shown[k] == word), -1)
        out.append(hit)
        at = hit + 1 if hit >= 0 else at
    return out


@query(None, rows="C24")
def monotone_alignment(spark: SparkSession, d: str) -> DataFrame:
    """Words of every turn against those of the conversation's next turn."""
    from pyspark.sql.types import LongType

    pair = F.pandas_udf(lambda a, b: a.combine(b, lambda x, y: aligned(str(x or "").lower().split(), str(y or "").lower().split())), ArrayType(LongType()))
    w = Window.partitionBy("conv_id").orderBy("turn")
    rows = table(spark, d, "conversations").withColumn("next", F.coalesce(F.lead("text").over(w), F.lit("")))
    places = rows.select("conv_id", "turn", pair(F.coalesce("text", F.lit("")), "next").alias("p"))
    return places.select("conv_id", "turn", F.size("p").alias("n"), F.size(F.filter("p", lambda x: x >= 0)).alias("n_matched"))
