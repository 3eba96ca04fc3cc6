import corpus_pipeline
from pipewise.llm import decontamination, line_dedup, quality
from pipewise.llm.shared import read, tokenizer_path
from pipewise.sources.scratch import materialize
from tests.llm.test_line_dedup import brute as brute_lines
from tests.llm.test_near_copies import groups, similar_pairs
from tests.llm.test_packing import check


def test_stages_against_brute_force(spark, sf):
    """Every stage by plain Python on the rows its predecessor kept."""
    from tokenizers import Tokenizer

    docs = read(spark, sf, "documents")
    model = quality.fit(docs, read(spark, sf, "labels"))
    texts, out = {r.doc_id: r.text for r in docs.collect()}, docs
    for name, stage in corpus_pipeline.STAGES:
        out = materialize(stage(spark, out, sf), "stage")
        rows = out.collect()
        kept = {r.doc_id: r["text"] for r in rows} if name != "packing" else {}
        if name == "quality_classifier":
            want = {
                i: t for i, t in texts.items()
                if model.score(quality.word_ngrams(t.encode())) >= quality.THRESHOLD
            }
            assert kept == want
        elif name == "line_dedup":
            assert kept == {i: t for i, _, _, t in brute_lines(list(texts.items()), line_dedup.MIN_DOCS)}
        elif name == "simhash_near_dedup":
            # nothing goes without a near copy that stays, nine tenths of the pairs are found
            pairs = similar_pairs(list(texts.items()), 0.8)
            root = groups(texts, pairs)
            assert all(texts[i] == t for i, t in kept.items())
            assert {i for i, c in root.items() if i == c} <= set(kept)
            left = sum(i in kept and j in kept for i, j in pairs)
            assert pairs and left <= 0.1 * len(pairs)
        elif name == "benchmark_decontamination":
            held = decontamination.contaminated(
                spark.createDataFrame(list(texts.items()), "doc_id long, text string"),
                read(spark, sf, "benchmark"),
            )
            gone = {r.doc_id for r in held.collect()}
            assert gone and kept == {i: t for i, t in texts.items() if i not in gone}
        else:
            tokenizer = Tokenizer.from_file(tokenizer_path())
            tokenizer.encode_special_tokens = True
            check(rows, texts, lambda t: tokenizer.encode(t, add_special_tokens=False).ids)
        texts = kept
    assert sum(r.length for r in rows) > 0


def test_columns_between_stages(spark, sf):
    docs = read(spark, sf, "documents")
    columns = docs.columns
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf)
        assert docs.columns == columns


def test_empty_and_null_rows_pass_every_stage(spark, sf):
    schema = read(spark, sf, "documents").schema
    rows = [(None, None, None, None, None), (1, None, "en", "s", 0), (1, None, "en", "s", 0), (2, "", None, None, 0)]
    for docs in (spark.createDataFrame([], schema), spark.createDataFrame(rows, schema)):
        for _, stage in corpus_pipeline.STAGES[1:]:
            stage(spark, docs, sf).collect()
