"""The registered queries of this subpackage: thin digests of its operators' results over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe_codec, centroids, conversation_repair, exact_dedup, flac, hpylm, licenses, mixing, ngram_join, quality, rpforest, suffix_dedup, token_count


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.link_components(table(spark, sf_dir, "documents"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_flac_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = flac.decode(flac.encode(table(spark, sf_dir, "documents")))
    size = F.octet_length("pcm").cast("int")
    return read.select(
        "doc_id",
        "n_bytes",
        F.octet_length("pcm").cast("long").alias("payload_bytes"),
        F.sha2("pcm", 256).alias("payload_sha256"),
        F.crc32(F.substring("pcm", size - 31, F.lit(32))).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        "feature",
    )


def op5_hpy_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hpylm.score_texts(table(spark, sf_dir, "documents"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op7_rp_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rpforest.search(table(spark, sf_dir, "embeddings"))


def digest(coded: DataFrame) -> DataFrame:
    """doc_id, n_tokens and the digests of ids and decoded text."""
    ids = F.concat_ws(",", F.col("ids").cast("array<string>"))
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op8_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(bpe_codec.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json")))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(table(spark, sf_dir, "documents"))
    families = F.concat_ws(",", F.transform("notices", lambda x: x["family"]))
    places = F.concat_ws(",", F.transform("notices", lambda x: F.concat(x["start"].cast("string"), F.lit("-"), x["end"].cast("string"))))
    return found.select("doc_id", "n_paragraphs", F.size("notices").alias("n_families"), families.alias("families"), places.alias("places"))


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    return cut.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op11_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = centroids.cluster(table(spark, sf_dir, "embeddings"))
    components = F.concat_ws(",", F.col("centroid").cast("array<string>"))
    return found.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", F.sha2(components, 256).alias("centroid_sha256"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    fixed = conversation_repair.repair(conversation_repair.damage(table(spark, sf_dir, "conversations")), copies="copies")
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit(":"), t["text"])), "\n")
    return fixed.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", F.sha2(lines, 256).alias("repaired_sha256"))


def op13_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.group_copies(table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_token_counts, op2_ngram_jaccard, op3_quality, op4_flac_media, op5_hpy_lm, op6_mixing, op7_rp_forest, op8_bpe_codec, op9_license_scan, op10_suffix_dedup, op11_centroid_clusters, op12_conversation_repair, op13_exact_dedup, pipeline)
    return {f.__name__: f for f in own}


#: Exact all-pairs version on shingle strings.
NGRAM_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents
), g AS (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))) END AS gs FROM w
), s AS (SELECT doc_id, len(gs) AS n, unnest(gs) AS x FROM g
), p AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM s a JOIN s b ON a.x = b.x AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))
), r AS (SELECT doc_id, doc_id AS c FROM g UNION SELECT r.doc_id, p.b FROM r JOIN p ON p.a = r.c)
SELECT g.doc_id, len(g.gs)::BIGINT AS n_shingles, m.component_id
FROM g JOIN (SELECT doc_id, min(c) AS component_id FROM r GROUP BY doc_id) m USING (doc_id)
"""


#: k-means in lists of whole numbers; each round is a pair of CTEs.
CENTROID_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS q, sha256('2:' || vec_id) AS h FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c0 AS (SELECT row_number() OVER (ORDER BY h) - 1 AS c, q AS z FROM (SELECT * FROM v ORDER BY h LIMIT 40)),
""" + ",\n".join(f"""a{i} AS (SELECT vec_id, any_value(q) AS q, min(struct_pack(d := list_sum(list_transform(range(1, 65), lambda i: (q[i] - z[i]) * (q[i] - z[i])))::BIGINT, c := c)) AS m FROM v, c{i} GROUP BY vec_id),
s{i} AS (SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY j) AS z FROM (SELECT c, j, sum(x)::BIGINT AS s, count(*) AS n FROM (SELECT m.c AS c, unnest(q) AS x, unnest(range(64)) AS j FROM a{i}) GROUP BY c, j) GROUP BY c),
c{i + 1} AS (SELECT c{i}.c, coalesce(s{i}.z, c{i}.z) AS z FROM c{i} LEFT JOIN s{i} ON s{i}.c = c{i}.c)""" for i in range(6)) + """
SELECT vec_id, m.c::INT AS cluster, m.d AS distance, sum(m.d) OVER (PARTITION BY m.c)::BIGINT AS cluster_inertia, sum(m.d) OVER ()::BIGINT AS inertia, sha256(array_to_string(z, ',')) AS centroid_sha256
FROM a5 JOIN c5 ON c5.c = m.c
"""

#: The lattice turn by turn: of each state, the least (cost, audit), where insertions come before an edit of a turn.
REPAIR_SQL = r"""
WITH RECURSIVE k AS (SELECT list(list_reduce(list_prepend(c, range(8)), lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END) ORDER BY c) AS t FROM range(256) r(c)),
o AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS s FROM conversations),
p AS (SELECT conv_id, turn, role, text, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(range(1, length(s) + 1), lambda i: ascii(s[i])::BIGINT)), lambda x, b: xor(x >> 8, t[(xor(x, b) & 255) + 1]))) % 20 AS f FROM o, k),
d AS (SELECT conv_id, turn, CASE WHEN f = 4 THEN 'user' ELSE role END AS role, CASE f WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE WHEN f = 3 THEN 2 ELSE 1 END)) AS nth FROM p WHERE f <> 0),
e AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, nth) AS i, regexp_replace(text, '[\x20\x09-\x0D]+$', '') AS cut FROM d),
n AS (SELECT conv_id, i, turn, role, text, CASE WHEN cut = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate' WHEN right(cut, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) || left(role, 1) AS pair FROM e),
ins(s, t, c, a, r) AS (VALUES (0, 0, 0, '', ''), (1, 1, 0, '', ''), (2, 2, 0, '', ''), (3, 3, 0, '', ''), (0, 2, 3, 'I', chr(10) || 'user:'), (1, 2, 3, 'I', chr(10) || 'user:'), (3, 2, 3, 'I', chr(10) || 'user:'), (2, 3, 3, 'I', chr(10) || 'assistant:'), (0, 3, 6, 'II', chr(10) || 'user:' || chr(10) || 'assistant:'), (1, 3, 6, 'II', chr(10) || 'user:' || chr(10) || 'assistant:')),
ed(s, t, c, a, needs, role) AS (VALUES (0, 1, 0, 'K', 's', NULL), (0, 2, 0, 'K', 'u', NULL), (1, 2, 0, 'K', 'u', NULL), (3, 2, 0, 'K', 'u', NULL), (2, 3, 0, 'K', 'a', NULL), (0, 2, 3, 'R', NULL, 'user'), (1, 2, 3, 'R', NULL, 'user'), (3, 2, 3, 'R', NULL, 'user'), (2, 3, 3, 'R', NULL, 'assistant'), (0, 0, 4, 'D', NULL, NULL), (1, 1, 4, 'D', NULL, NULL), (2, 2, 4, 'D', NULL, NULL), (3, 3, 4, 'D', NULL, NULL)),
l AS (SELECT DISTINCT conv_id, 0::BIGINT AS i, 0 AS s, struct_pack(c := 0, a := '', r := '') AS b FROM conversations
  UNION ALL SELECT l.conv_id, n.i, ed.t, min(struct_pack(c := l.b.c + ins.c + ed.c + CASE WHEN n.fault = 'truncated' AND ed.a <> 'D' THEN 3 ELSE 0 END, a := l.b.a || ins.a || ed.a, r := l.b.r || ins.r || CASE WHEN ed.a = 'D' THEN '' ELSE chr(10) || coalesce(ed.role, n.role) || ':' || n.text END))
  FROM l JOIN ins ON ins.s = l.s JOIN n ON n.conv_id IS NOT DISTINCT FROM l.conv_id AND n.i = l.i + 1 JOIN ed ON ed.s = ins.t AND (ed.a = 'D' OR n.fault NOT IN ('blank', 'duplicate')) AND (ed.needs IS NULL OR ed.needs = left(n.role, 1)) GROUP BY l.conv_id, n.i, ed.t),
g AS (SELECT conv_id, max(turn) - min(turn) + 1 - count(DISTINCT turn) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal, max(i) AS i FROM n GROUP BY conv_id),
z AS (SELECT l.conv_id, min(struct_pack(c := l.b.c + ins.c, a := l.b.a || ins.a, r := l.b.r || ins.r)) AS b FROM l LEFT JOIN g ON g.conv_id IS NOT DISTINCT FROM l.conv_id JOIN ins ON ins.s = l.s WHERE l.i = coalesce(g.i, 0) AND ins.t IN (0, 3) GROUP BY l.conv_id)
SELECT z.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, b.c::BIGINT AS cost, b.a AS audit, sha256(substr(b.r, 2)) AS repaired_sha256
FROM z LEFT JOIN g ON g.conv_id IS NOT DISTINCT FROM z.conv_id
"""

DEDUP_SQL = r"""
SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size, doc_id = min(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_ngram_jaccard": NGRAM_SQL, "op11_centroid_clusters": CENTROID_SQL, "op12_conversation_repair": REPAIR_SQL, "op13_exact_dedup": DEDUP_SQL}
