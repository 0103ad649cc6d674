"""The near-duplicate stage leaves no texts behind in the scratch folder."""

from pathlib import Path

import corpus_pipeline
from ordstack.llm import near_dedup, simhash
from ordstack.session import scratch_root, store

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars int, other string"


def _docs(spark):
    words = [f"w{i}" for i in range(60)]
    texts = [" ".join(words), " ".join(words), " ".join([*words[:59], "end"]), "short one", "", None, " ".join(words[::-1])]
    rows = [(i, t, "en", "a", len(t or ""), f"o{i}") for i, t in enumerate(texts)]
    rows += [(None, texts[0], "en", "a", 1, "null id"), (6, texts[6], "en", "a", 1, "o6"), (7, "x " * 30, "en", None, 60, "o7")]
    return spark.createDataFrame(rows, SCHEMA)


def test_the_stage_deletes_the_texts_it_stored_and_keeps_its_rows(spark):
    docs = _docs(spark)
    expected = near_dedup.keep_one(store(simhash.keep_one(docs), "expected")).select("doc_id", "text", "other")
    root = Path(scratch_root(spark).removeprefix("file:"))
    before = set(root.iterdir())
    made = corpus_pipeline.simhash_near_dedup(spark, docs, "")
    left = {p.name.rsplit("-", 1)[0] for p in set(root.iterdir()) - before}
    assert left == {"near-kept"}
    assert made.columns == docs.columns
    got = sorted(map(str, made.select("doc_id", "text", "other").collect()))
    assert got == sorted(map(str, expected.collect()))
