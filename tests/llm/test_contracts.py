"""Names and types of the queries' columns, and their rows, as their contracts fix them."""

import random

import pytest

from loomspark.llm import hpylm, queries

OWN = {
    "op1_token_counts": "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean",
    "op2_ngram_jaccard": "doc_id bigint, n_shingles bigint, component_id bigint",
    "op3_quality": "doc_id bigint, held_out boolean, score double, predicted int",
    "op4_flac_media": "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string",
    "op5_hpy_lm": "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double",
    "op6_mixing": "doc_id bigint, size bigint, source_size bigint, target double, taken bigint",
    "op7_rp_forest": "query_id bigint, rank int, vec_id bigint, score double",
    "op8_bpe_codec": "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string",
    "op10_suffix_dedup": "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string",
}


@pytest.mark.parametrize("name", list(OWN))
def test_columns_and_rows(spark, sf_dir, name):
    out = queries.queries()[name](spark, sf_dir)
    want = [tuple(x.split()) for x in OWN[name].split(", ")]
    assert out.dtypes[: len(want)] == want
    ids = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id") if name != "op7_rp_forest" else spark.read.parquet(f"{sf_dir}/embeddings.parquet").where("vec_id % 20 = 0").select("vec_id").join(spark.range(20), how="cross").select("vec_id")
    assert out.select(out.columns[0]).exceptAll(ids).isEmpty() and out.count() == ids.count()


def test_language_model_learns_pairs(spark):
    """Held-out texts whose words follow each other in fixed ways score far above the base, shuffled ones do not gain."""
    draw, follow = random.Random(5), {f"w{i}": [f"w{(7 * i + k) % 60}" for k in (1, 2)] for i in range(60)}

    def chain(n):
        words = [f"w{draw.randrange(60)}"]
        for _ in range(n):
            words.append(draw.choice(follow[words[-1]]))
        return words

    rows = [(i, " ".join(chain(30))) for i in range(400)]
    odd = [(10_000 + i, " ".join(draw.sample(chain(30), 31))) for i in range(200)]
    got = [r for r in hpylm.score_texts(spark.createDataFrame(rows, "doc_id long, text string")).collect() if r["held_out"]]
    assert len(got) > 30 and sum(r["score"] - r["base_score"] for r in got) / sum(r["n_tokens"] for r in got) > 0.8
    assert all(r["score"] > r["base_score"] for r in got)
    mixed = [r for r in hpylm.score_texts(spark.createDataFrame(rows + odd, "doc_id long, text string")).collect() if r["held_out"] and r["doc_id"] >= 10_000]
    assert sum(r["score"] - r["base_score"] for r in mixed) / sum(r["n_tokens"] for r in mixed) < 0.3
