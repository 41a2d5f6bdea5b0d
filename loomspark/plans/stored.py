"""Queries on documents that Spark writes as files of their own and reads again, and on judged and found rows."""

import json

from pyspark.sql import functions as F

from ..operators import intel, schema, visibility
from ..operators.graph import shared_folder
from ..registry import dealt, query, table
from ..sources import buckets, documents


def written(df, spark, name, *by):
    """A folder of JSON files, one subfolder for each value of the columns."""
    folder = shared_folder(spark, name)
    df.repartition(*by).write.partitionBy(*by).json(folder)
    return folder


@query("SELECT DISTINCT p_brand AS name FROM part")
def listed_workflows(spark, sf_dir):
    """A document a brand, of some hundred bytes to some hundred thousand, found by their heads."""
    p = table(spark, sf_dir, "part").groupBy("p_brand").agg(F.collect_list(F.struct(F.col("p_partkey").cast("string").alias("id"), F.col("p_name").alias("type"))).alias("nodes"))
    docs = p.select(F.col("p_brand").alias("brand"), F.lit(1).alias("version"), F.col("p_brand").alias("name"), "nodes", F.array().cast("array<string>").alias("edges"))
    return documents.list_documents(spark, written(docs, spark, "listed", "brand")).select("name")


@query("SELECT p_name AS type, count(*) AS nodes, sum(p_size)::DOUBLE AS x, (SELECT count(*) FROM part b WHERE b.p_name = a.p_name AND b.p_size > 25) AS sources FROM part a GROUP BY p_name")
def stored_workflows(spark, sf_dir):
    """Nodes by type, of documents with a node a part and an edge from each large part to itself: as a document is one row, one for each brand and 100,000 keys."""
    node = F.struct(F.col("p_partkey").cast("string").alias("id"), F.col("p_name").alias("type"), F.struct(F.col("p_size").cast("double").alias("x"), F.lit(0.0).alias("y")).alias("position"), F.struct(F.lit("a").alias("prompt")).alias("data"))
    edge = F.when(F.col("p_size") > 25, F.struct(F.col("p_partkey").cast("string").alias("id"), F.col("p_partkey").cast("string").alias("source"), F.col("p_partkey").cast("string").alias("target")))
    docs = table(spark, sf_dir, "part").groupBy("p_brand", F.floor(F.col("p_partkey") / 100_000).alias("block")).agg(F.lit(1).alias("version"), F.collect_list(node).alias("nodes"), F.collect_list(edge).alias("edges"))
    nodes, edges = documents.read_workflows(spark, written(docs, spark, "stored", "p_brand", "block"))
    from_type = edges.join(nodes.select("workflow_id", F.col("node_id").alias("source"), "type"), ["workflow_id", "source"]).groupBy("type").agg(F.count("*").alias("sources"))
    return nodes.groupBy("type").agg(F.count("*").alias("nodes"), F.sum("x").alias("x")).join(from_type, "type", "left").fillna(0, ["sources"])


@query("SELECT c_custkey::VARCHAR AS id, c_name AS \"Name\", CASE WHEN c_acctbal > 0 THEN c_mktsegment END AS \"Segment\" FROM customer")
def exported_clients(spark, sf_dir):
    record = F.struct(F.col("c_custkey").cast("string").alias("id"), F.struct(F.col("c_name").alias("Name"), F.when(F.col("c_acctbal") > 0, F.col("c_mktsegment")).alias("Segment"), F.col("c_acctbal").alias("Other")).alias("fields"))
    pages = table(spark, sf_dir, "customer").groupBy("c_nationkey", F.floor(F.col("c_custkey") / 100_000).alias("block")).agg(F.collect_list(record).alias("records"))
    return documents.read_clients(spark, written(pages, spark, "clients", "c_nationkey", "block"), ["Name", "Segment"]).select("id", "Name", "Segment")


@query(r"SELECT conv_id, turn FROM conversations WHERE role = 'assistant' AND length(text) >= 60 AND regexp_matches(text, '(?i)(^|[^\p{L}\p{N}])the($|[^\p{L}\p{N}])')")
def mentioning_answers(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").where("role = 'assistant'").withColumn("status", F.when(F.length("text") < 60, "error").otherwise("success"))
    return visibility.mentioning(visibility.extract_mentions(c, "the", [])).select("conv_id", "turn")


@query("SELECT conv_id, count(*) AS queries, sum(len(string_split(text, '. ')))::BIGINT AS results FROM conversations GROUP BY 1")
def search_results(spark, sf_dir):
    """A turn as a search, its sentences as results."""
    c = table(spark, sf_dir, "conversations").withColumn("found", F.split("text", r"\. ", -1))
    return intel.result_counts(c, "conv_id", "found")


def fixed_judge(snippets: list[str]) -> list[str]:
    """Praise, blame, prose, broken JSON and unknown labels by a snippet's length; some lengths it cannot stand."""
    out = []
    for s in snippets:
        n = len(s) % 7
        if n == 6:
            raise RuntimeError("no answer")
        label = ["positive", "Negative", "neutral", "glad"][n] if n < 4 else ""
        said = json.dumps({"sentiment": label, "rationale": f"r{n}"})
        out.append(said if n in (0, 2, 3) else f"```json\n{said}\n```" if n == 1 else "I like it" if n == 4 else said[:-3])
    return out


@query("SELECT conv_id, turn, CASE length(text) % 7 WHEN 0 THEN 'positive' WHEN 1 THEN 'negative' ELSE 'neutral' END AS sentiment, CASE length(text) % 7 WHEN 0 THEN 'r0' WHEN 1 THEN 'r1' WHEN 2 THEN 'r2' WHEN 4 THEN 'parse error' WHEN 5 THEN 'parse error' WHEN 6 THEN 'no judge response' END AS rationale FROM conversations")
def judged_turns(spark, sf_dir):
    return visibility.judge_sentiment(table(spark, sf_dir, "conversations"), "text", fixed_judge).select("conv_id", "turn", "sentiment", "rationale")


@query("""SELECT p_partkey, name, CASE name WHEN 'seed' THEN 'integer' WHEN 'rate' THEN 'number' WHEN 'loop' THEN 'string' ELSE CASE WHEN p_size % 2 = 0 THEN 'integer' ELSE 'string' END END AS type,
CASE name WHEN 'seed' THEN p_size - 25 WHEN 'rate' THEN p_size * 1e-5 END::DOUBLE AS minimum, CASE name WHEN 'seed' THEN 2147483647 WHEN 'rate' THEN p_retailprice * 1e9 END::DOUBLE AS maximum,
CASE name WHEN 'kind' THEN '["' || p_brand || '","b"]' END AS enum FROM part, (VALUES ('seed'), ('rate'), ('kind'), ('loop')) n(name)""")
def parameter_bounds(spark, sf_dir):
    """Bounds of any size and sign, and types and choices behind chains of references; a ring of them gives none."""
    exact = lambda c: F.col(c).cast("string")
    own = F.concat(
        F.lit('{"components": {"schemas": {"A": {"$ref": "#/components/schemas/B"}, "B": {"$ref": "#/components/schemas/C"}, "R": {"$ref": "#/components/schemas/S"}, "S": {"$ref": "#/components/schemas/R"}, "C": {"type": "'),
        F.when(F.col("p_size") % 2 == 0, "integer").otherwise("string"), F.lit('", "enum": ["'), "p_brand", F.lit('","b"]}, "Input": {"properties": {"seed": {"type": "integer", "minimum": '), exact("s"), F.lit(', "maximum": 2147483647}, "rate": {"type": "number", "minimum": '), exact("p_size"),
        F.lit('e-05, "maximum": '), exact("p_retailprice"), F.lit('e9}, "kind": {"allOf": [{"$ref": "#/components/schemas/A"}]}, "loop": {"$ref": "#/components/schemas/R"}}}}}}'),
    )
    p = dealt(table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_size", "p_retailprice"), "p_partkey").withColumn("s", F.col("p_size") - 25)
    return schema.schema_params(p.select("p_partkey", own.alias("schema")), "p_partkey").select("p_partkey", "name", "type", "minimum", "maximum", "enum")


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 11 = 5 THEN 'P' ELSE o_orderstatus END AS status, CASE WHEN o_orderkey % 100 = 7 THEN 0.0 ELSE o_totalprice END::DOUBLE AS price, CASE WHEN o_orderkey % 100 = 7 THEN 'now' ELSE '' END AS updated_at FROM orders WHERE o_orderkey % 50 <> 3")
def changed_in_buckets(spark, sf_dir):
    """Orders as a table in buckets: some get another status, some a price, some go."""
    path, o = shared_folder(spark, "orders"), table(spark, sf_dir, "orders")
    rows = o.select("o_orderkey", F.col("o_orderstatus").alias("status"), F.col("o_totalprice").cast("double").alias("price"), F.lit("").alias("updated_at"), F.lit(0).alias("v"))
    buckets.write_table(rows, path, ["o_orderkey"])
    buckets.upsert_rows(spark, path, rows.where("o_orderkey % 11 = 5").withColumns({"status": F.lit("P"), "v": F.lit(1)}), ["o_orderkey"], "v")
    buckets.patch_rows(spark, path, rows.where("o_orderkey % 100 = 7").select("o_orderkey", F.lit(0.0).alias("price")), "o_orderkey", ["price"], F.lit("now"))
    buckets.delete_rows(spark, path, rows.where("o_orderkey % 50 = 3"), ["o_orderkey"])
    return buckets.read_table(spark, path).select("o_orderkey", "status", "price", "updated_at")
