"""The pipeline's stages against brute force, each on what the stage before it kept."""

import brute
import corpus_pipeline
import public_tokenizers
from tokenizers import Tokenizer

from stratafile.llm import quality_gam, quality_rules, queries

SMALL = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = queries.table(spark, SMALL, "documents")
    labels = queries.table(spark, SMALL, "labels")
    steps = dict(corpus_pipeline.STAGES)
    assert list(steps) == ["quality classifier", "quality rules", "minhash near-dedup", "pii", "best-fit packing"]
    text = lambda df: {r["doc_id"]: r["text"] for r in df.collect()}

    one = corpus_pipeline.written(steps["quality classifier"](spark, docs, SMALL), "t")
    said = {r["doc_id"] for r in quality_gam.classify(docs, labels).where("predicted = 1").collect()}
    assert one.columns == docs.columns and set(text(one)) == said

    two = corpus_pipeline.written(steps["quality rules"](spark, one, SMALL), "t")
    kept = text(one)
    trusted = {r["doc_id"] for r in labels.where("quality = 1").collect()}
    ratio = brute.ratios(kept, trusted, quality_rules.PAIR_BUCKETS, quality_rules.LEAST_SEEN, quality_rules.SMOOTHING)
    assert two.columns == docs.columns and set(text(two)) == {d for d, t in kept.items() if not brute.base_counts(t)[5] and ratio[d] >= quality_rules.LEAST_RATIO}

    three = corpus_pipeline.written(steps["minhash near-dedup"](spark, two, SMALL), "t")
    groups = brute.near_duplicates(text(two))
    assert three.columns == docs.columns and set(text(three)) == {d for d, (_, c) in groups.items() if d == c}

    four = corpus_pipeline.written(steps["pii"](spark, three, SMALL), "t")
    clean = text(four)
    assert four.columns == docs.columns and set(clean) == set(text(three)) and not any(brute.personal(t) for t in clean.values())
    for d, t in text(three).items():
        assert (clean[d] == t) or brute.personal(t) or "<CONTEXT>" in clean[d]

    five = steps["best-fit packing"](spark, four, SMALL).collect()
    library = Tokenizer.from_file(public_tokenizers.path(queries.BYTE_BPE))
    assert sum(r["length"] for r in five) == sum(len(library.encode(t, add_special_tokens=False).ids) + 1 for t in clean.values())
    total = corpus_pipeline.run(spark, SMALL).collect()
    assert sorted((r["doc_id"], r["piece"], r["ids_crc32"]) for r in total) == sorted((r["doc_id"], r["piece"], r["ids_crc32"]) for r in five)
