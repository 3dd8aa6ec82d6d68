"""Scans, sources and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from corpusloom.plans.registry import query
from corpusloom.sources import tables as T
from corpusloom.sources.publish import Published
from corpusloom.sources.tables import table


@query("""
SELECT lang, count(*) AS n_docs, CAST(count(quality) AS BIGINT) AS n_labelled,
       CAST(sum(coalesce(toxic, 0)) AS BIGINT) AS n_toxic, CAST(sum(n_chars) AS BIGINT) AS n_chars
FROM documents LEFT JOIN labels USING (doc_id) GROUP BY lang
""", rows="A2 A3 A4")
def scan_shared_counts(spark: SparkSession, d: str) -> DataFrame:
    docs = T.with_side(table(spark, d, "documents"), table(spark, d, "labels"), "doc_id", "toxic", F.lit(0))
    docs = docs.join(table(spark, d, "labels").select("doc_id", "quality"), "doc_id", "left")
    return docs.groupBy("lang").agg(
        F.count("*").alias("n_docs"), F.count("quality").alias("n_labelled"), F.sum("toxic").cast("long").alias("n_toxic"), F.sum("n_chars").cast("long").alias("n_chars")
    )


@query("""
WITH new AS (SELECT doc_id, md5(concat_ws('|', coalesce(CASE WHEN lang = 'fr' THEN upper(source) ELSE source END, ''), coalesce(CAST(n_chars AS VARCHAR), ''))) AS h
             FROM documents WHERE lang <> 'de'),
     old AS (SELECT doc_id, md5(concat_ws('|', coalesce(source, ''), coalesce(CAST(n_chars AS VARCHAR), ''))) AS h FROM documents WHERE lang <> 'es')
SELECT doc_id, CASE WHEN o.h IS NULL THEN 'added' WHEN n.h IS NULL THEN 'stale' WHEN o.h <> n.h THEN 'changed' ELSE 'same' END AS status
FROM new n FULL OUTER JOIN old o USING (doc_id)
""", rows="A5 A16 G1")
def sink_changed_only(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    source = F.when(F.col("lang") == "fr", F.upper("source")).otherwise(F.col("source"))
    new = docs.where("lang <> 'de'").select("doc_id", T.content_hash(source, F.col("n_chars")).alias("digest"))
    old = docs.where("lang <> 'es'").select("doc_id", T.content_hash(F.col("source"), F.col("n_chars")).alias("digest"))
    return T.changed(new, old, "doc_id")


@query("""
SELECT user_id, max(ts) AS ts, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(event_type, (ts, event_id)) AS event_type
FROM events GROUP BY user_id
""", rows="A6")
def upsert_latest(spark: SparkSession, d: str) -> DataFrame:
    newest = F.max_by(F.struct("ts", "event_id", "event_type"), F.struct("ts", "event_id"))
    return table(spark, d, "events").groupBy("user_id").agg(newest.alias("r")).select("user_id", "r.*")


@query("""
SELECT user_id, event_type, event_id, value FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1
""", rows="A6")
def upsert_composite_key(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events")
    return T.upsert(rows, ["user_id", "event_type"], [F.col("ts"), F.col("event_id")]).select("user_id", "event_type", "event_id", "value")


@query("SELECT doc_id, lang, source FROM documents ANTI JOIN labels USING (doc_id)", rows="A9")
def resume_anti_join(spark: SparkSession, d: str) -> DataFrame:
    done = table(spark, d, "labels").select("doc_id")
    return table(spark, d, "documents").select("doc_id", "lang", "source").join(done, "doc_id", "left_anti")


@query("""
WITH b AS (SELECT p_brand, dense_rank() OVER (ORDER BY p_brand) - 1 AS brand_ord FROM (SELECT DISTINCT p_brand FROM part WHERE p_brand IS NOT NULL)),
     t AS (SELECT p_type, dense_rank() OVER (ORDER BY p_type) - 1 AS type_ord FROM (SELECT DISTINCT p_type FROM part WHERE p_type IS NOT NULL))
SELECT p_partkey, CAST(coalesce(brand_ord, -1) AS BIGINT) AS brand_ord, CAST(coalesce(type_ord, -1) AS BIGINT) AS type_ord
FROM part LEFT JOIN b USING (p_brand) LEFT JOIN t USING (p_type)
""", rows="A11")
def catalog_dictionary(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part").select("p_partkey", "p_brand", "p_type")
    coded = T.ordinals(T.ordinals(part, "p_brand", "brand_ord"), "p_type", "type_ord")
    return coded.select("p_partkey", F.col("brand_ord").cast("long").alias("brand_ord"), F.col("type_ord").cast("long").alias("type_ord"))


@query("""
SELECT o_orderkey, count(*) AS n_refs, string_agg(CAST(l_partkey AS VARCHAR), ',' ORDER BY l_linenumber, l_partkey, l_suppkey) AS parts
FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey
""", rows="A12")
def ref_resolve_ordered(spark: SparkSession, d: str) -> DataFrame:
    refs = table(spark, d, "lineitem").groupBy("l_orderkey").agg(
        F.count("*").alias("n_refs"), F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey"))).alias("r")
    )
    parts = F.array_join(F.transform("r", lambda x: x["l_partkey"].cast("string")), ",")
    orders = table(spark, d, "orders").select("o_orderkey")
    return orders.join(refs, orders["o_orderkey"] == refs["l_orderkey"]).select("o_orderkey", "n_refs", parts.alias("parts"))


@query("SELECT l_orderkey, count(*) AS n FROM lineitem LEFT JOIN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'F') ON l_orderkey = o_orderkey WHERE o_orderkey IS NULL GROUP BY l_orderkey", rows="A13")
def dangling_refs(spark: SparkSession, d: str) -> DataFrame:
    known = table(spark, d, "orders").where("o_orderstatus <> 'F'").select(F.col("o_orderkey").alias("l_orderkey"))
    return table(spark, d, "lineitem").select("l_orderkey").join(known, "l_orderkey", "left_anti").groupBy("l_orderkey").agg(F.count("*").alias("n"))


@query("""
SELECT c_custkey, coalesce(CASE WHEN c_acctbal < 0 THEN c_mktsegment END, n_name, 'none') AS section,
       CASE WHEN c_acctbal < 0 THEN 'own' ELSE 'nation' END AS source
FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey
""", rows="A15")
def topic_overlay(spark: SparkSession, d: str) -> DataFrame:
    own = F.when(F.col("c_acctbal") < 0, F.col("c_mktsegment"))
    rows = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"), "left")
    return rows.select("c_custkey", F.coalesce(own, "n_name", F.lit("none")).alias("section"), F.when(F.col("c_acctbal") < 0, "own").otherwise("nation").alias("source"))


@query("""
WITH l AS (SELECT doc_id, CAST(pos - 1 AS BIGINT) AS pos, line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents)),
     h AS (SELECT *, last_value(CASE WHEN length(line) <= 40 THEN line END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS header FROM l)
SELECT doc_id, pos, CAST(length(line) AS BIGINT) AS n_chars, header FROM h WHERE NOT length(line) <= 40
""", rows="A27 E10")
def dsl_sections(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").where("text is not null")
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    found = T.sections(lines, "doc_id", "pos", "line", F.length("line") <= 40)
    return found.select("doc_id", F.col("pos").cast("long").alias("pos"), F.length("line").cast("long").alias("n_chars"), "header")


@query("""
SELECT CAST(extract(year FROM o_orderdate) AS BIGINT) AS set_year, o_orderkey,
       row_number() OVER (PARTITION BY o_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS number,
       l_partkey, coalesce(l_quantity, 10.0) AS points
FROM orders JOIN lineitem ON o_orderkey = l_orderkey
""", rows="A40 D7")
def packet_flatten(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders").select("o_orderkey", F.year("o_orderdate").cast("long").alias("set_year")).join(
        table(spark, d, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey")
    )
    w = Window.partitionBy("o_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    return rows.select("set_year", "o_orderkey", F.row_number().over(w).cast("long").alias("number"), "l_partkey", F.coalesce("l_quantity", F.lit(10.0)).alias("points"))


@query("""
SELECT n_name AS set_name, CAST(max(r_regionkey) AS BIGINT) AS packet, count(*) AS n FROM nation JOIN region ON n_regionkey = r_regionkey JOIN customer ON c_nationkey = n_nationkey GROUP BY n_name
""", rows="A40")
def set_list(spark: SparkSession, d: str) -> DataFrame:
    dims = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    rows = table(spark, d, "customer").join(dims, F.col("c_nationkey") == F.col("n_nationkey"))
    return rows.groupBy(F.col("n_name").alias("set_name")).agg(F.max("r_regionkey").cast("long").alias("packet"), F.count("*").alias("n"))


@query("SELECT event_id, user_id, true AS more FROM events WHERE event_id > 100 ORDER BY event_id LIMIT 800", rows="A22 J1")
def cursor_pull(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").select(F.col("event_id").alias("seq"), "user_id")
    return T.page_after(rows, 100, 800).select(F.col("seq").alias("event_id"), "user_id", "more")


@query("""
SELECT lang, CAST(floor((row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) - 1) / 100) AS BIGINT) AS batch, doc_id FROM documents
""", rows="A41")
def batch_numbers(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("lang").orderBy(F.desc("n_chars"), "doc_id")
    return table(spark, d, "documents").select("lang", F.floor((F.row_number().over(w) - 1) / 100).cast("long").alias("batch"), "doc_id")


@query("""
SELECT user_id, strftime(day, '%Y-%m-%d') AS day, count(*) FILTER (WHERE first_day = day) AS added, count(*) FILTER (WHERE first_day < day) AS updated FROM (
  SELECT DISTINCT user_id, event_type, date_trunc('day', ts) AS day, min(date_trunc('day', ts)) OVER (PARTITION BY user_id, event_type) AS first_day FROM events)
GROUP BY user_id, day
""", rows="A30")
def change_log(spark: SparkSession, d: str) -> DataFrame:
    days = table(spark, d, "events").select("user_id", "event_type", F.to_date("ts").alias("day")).distinct()
    first = F.min("day").over(Window.partitionBy("user_id", "event_type"))
    rows = days.withColumn("first", first)
    return rows.groupBy("user_id", F.date_format("day", "yyyy-MM-dd").alias("day")).agg(
        F.count_if(F.col("first") == F.col("day")).alias("added"), F.count_if(F.col("first") < F.col("day")).alias("updated")
    )


@query("""
SELECT p_partkey, replace(replace(replace(p_name, chr(9), ' '), chr(10), ' '), chr(13), ' ') || chr(9) || p_brand || chr(9) || lower(replace(p_type, ' ', '_')) AS line FROM part
""", rows="A43")
def tsv_export(spark: SparkSession, d: str) -> DataFrame:
    flat = lambda c: F.regexp_replace(c, r"[\t\n\r]", " ")
    return table(spark, d, "part").select("p_partkey", F.concat_ws("\t", flat("p_name"), flat("p_brand"), F.lower(F.replace("p_type", F.lit(" "), F.lit("_")))).alias("line"))


@query("""
SELECT p_brand AS unit, p_partkey AS pos, split_part(p_type, ' ', 1) AS section, trim(p_name) AS answerline, 'x' || CAST(p_size AS VARCHAR) AS variant, p_type AS topic, CAST(p_retailprice > 1500 AS VARCHAR) AS note,
 CASE WHEN row_number() OVER (PARTITION BY p_brand, split_part(p_type, ' ', 1), lower(trim(p_name)) ORDER BY p_partkey) > 1 THEN 'duplicate' END AS error FROM part
""", rows="A27")
def dsl_entries(spark: SparkSession, d: str) -> DataFrame:
    """Outlines made of parts, a section line before each entry, parsed again."""
    from corpusloom.sources.dsl import entries

    part = table(spark, d, "part")
    entry = F.concat("p_name", F.lit(" = x"), F.col("p_size").cast("string"), F.lit(" -> "), "p_type", F.lit(" | "), (F.col("p_retailprice") > 1500).cast("string"))
    head = F.concat(F.lit("# "), F.substring_index("p_type", " ", 1))
    lines = part.select(F.col("p_brand").alias("unit"), "p_partkey", F.posexplode(F.array(head, F.lit("> blurb"), entry)).alias("k", "line")).withColumn("pos", F.col("p_partkey") * 3 + F.col("k"))
    out = entries(lines.select("unit", "pos", "line"), key="unit", pos="pos", text="line")
    return out.select("unit", ((F.col("pos") - 2) / 3).cast("long").alias("pos"), "section", "answerline", F.get("variants", F.lit(0)).alias("variant"), "topic", "note", "error")


@query("""
SELECT CAST(item_id AS VARCHAR) AS slug, length(text) % 7 <> 3 AS good, CASE WHEN length(text) % 7 <> 3 THEN CAST(length(text) AS BIGINT) END AS n_chars,
 CASE WHEN length(text) % 7 <> 3 THEN CAST(len(string_split(text, ' ')) AS BIGINT) END AS n_works FROM benchmark
""", rows="A1")
def corpus_scan(spark: SparkSession, d: str) -> DataFrame:
    """A file for each benchmark item, some cut off in the middle, and both sides of the tolerant scan over them."""
    at = T.shared_folder(spark, "corpus")
    items = table(spark, d, "benchmark")
    doc = F.to_json(F.struct(F.col("text").alias("title"), F.transform(F.split("text", " "), lambda w: F.struct(w.alias("name"))).alias("works")))
    broken = F.length("text") % 7 == 3
    value = F.when(broken, F.substring(doc, F.lit(1), F.floor(F.length(doc) / 2).cast("int"))).otherwise(doc)
    items.select("item_id", value.alias("value")).repartition("item_id").write.partitionBy("item_id").text(at)
    schema = StructType.fromDDL("title string, works array<struct<name: string>>")
    good, bad = T.tolerant_json(spark, f"{at}/*/*.txt", schema, r"item_id=([^/]+)/")
    found = good.select("slug", F.lit(True).alias("good"), F.length("title").cast("long").alias("n_chars"), F.size("works").cast("long").alias("n_works"))
    none = F.lit(None).cast("long")
    return found.unionByName(bad.select("slug", F.lit(False).alias("good"), none.alias("n_chars"), none.alias("n_works")))


@query("""
SELECT doc_id, coalesce(lang, 'none') AS artifact, CASE WHEN lang = 'fr' THEN upper(source) ELSE source END AS source, CAST(CASE WHEN lang IN ('fr', 'es') THEN 2 ELSE 1 END AS BIGINT) AS since
FROM documents WHERE lang IS DISTINCT FROM 'de'
""", rows="A17")
def publish_versions(spark: SparkSession, d: str) -> DataFrame:
    """Documents by language, published twice: French changes, German goes, Spanish comes, and the rest isn't written again."""
    docs = table(spark, d, "documents").select("doc_id", "source", F.coalesce("lang", F.lit("none")).alias("lang"))
    out = Published(spark, T.shared_folder(spark, "published"))
    out.publish(docs.where("lang <> 'es'"), "lang")
    out.publish(docs.where("lang <> 'de'").withColumn("source", F.when(F.col("lang") == "fr", F.upper("source")).otherwise(F.col("source"))), "lang")
    return out.read("doc_id long, source string").select("doc_id", "artifact", "source", "since")
