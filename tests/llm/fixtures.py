"""Small tables with the awkward cases: nulls, empty and long texts, repeats, clashing extra columns."""

import random

SF = "/root/testdata/sf0.01"
EXTRA = "doc_id long, text string, lang string, score double, kept boolean, fp string, shard string, hit_spans string, n_tokens string"


def awkward(spark, texts):
    """A documents table with columns named like the operators' own."""
    rows = [(i, t, "en", 0.5, True, "x", "y", "z", "n") for i, t in enumerate(texts)]
    rows += [(None, None, None, None, None, None, None, None, None), (None, "", None, None, None, None, None, None, None), (0, texts[0] if texts else "", "de", 1.0, False, "", "", "", "")]
    return spark.createDataFrame(rows, EXTRA).repartition(3)


def sample_texts(n=60, seed=5, alphabet="abc \n.,1234@+-é ß%x"):
    r = random.Random(seed)
    return ["".join(r.choice(alphabet) for _ in range(r.randint(0, 120))) for _ in range(n)]


def documents(spark, limit=None):
    import pyarrow.parquet as pq

    rows = pq.read_table(f"{SF}/documents.parquet", columns=["doc_id", "text"]).to_pylist()
    return [(r["doc_id"], r["text"]) for r in rows][:limit]
