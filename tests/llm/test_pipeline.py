"""Each stage of the pipeline on what the one before it kept, against plain versions."""

import random

import corpus_pipeline
import pytest
from brute import blank, contaminated, near_groups, targets, tokens

from rasterloom.llm import common, mixing
from rasterloom.llm import tokens as tok

QUERIES = {"op1_", "op2_", "op3_", "op4_", "op5_", "op6_", "op7_", "op8_", "op9_", "op10_", "op11_", "op12_", "op13_"}


@pytest.fixture(scope="module")
def stages(spark, data):
    """Each stage's name with its input and output."""
    docs, found = common.table(spark, data, "documents"), {}
    for name, stage in corpus_pipeline.STAGES:
        out = common.written(stage(spark, docs, data), name)
        found[name] = (docs, out)
        docs = out
    return found


def test_one_query_for_each_operator():
    import __spark_entry__
    names = [n for n in __spark_entry__.queries() if any(n.startswith(p) for p in QUERIES)]
    assert len(names) == 13 and "pipeline" in __spark_entry__.queries()


def test_columns_go_through(stages):
    first = stages["language_id"][0].columns
    assert all(out.columns == first for _, out in list(stages.values())[:-1])


def test_language_stage_keeps_clean_documents(stages):
    docs, out = stages["language_id"]
    assert out.count() == docs.where("text RLIKE '[A-Za-z]'").count()


def test_near_dedup_stage(stages):
    docs, out = stages["minhash_dedup"]
    groups = near_groups([(r.doc_id, r.text) for r in docs.collect()])
    assert sorted(r.doc_id for r in out.collect()) == sorted(set(groups.values()))


def test_decontamination_stage(stages, spark, data):
    docs, out = stages["decontamination"]
    bench = [(r.item_id, r.text) for r in common.table(spark, data, "benchmark").collect()]
    judged = contaminated([(r.doc_id, r.text) for r in docs.collect()], bench)
    kept = {r.doc_id: r.text for r in out.collect()}
    assert set(kept) == {r[0] for r in judged if not r[5]} and any(r[5] for r in judged)
    assert all(r[2] == 0 for r in contaminated(list(kept.items()), bench)) and all(len(t) == n for t, n in out.select("text", "n_chars").collect())


def test_mixing_stage(stages):
    docs, out = stages["source_mixing"]
    sizes, taken = {}, {}
    for r in docs.collect():
        sizes[r.source] = sizes.get(r.source, 0) + len(blank(r.text))
    for r in out.collect():
        taken[r.source] = taken.get(r.source, 0) + len(blank(r.text))
    for source, target in targets(sizes).items():
        largest = max(len(blank(r.text)) for r in docs.collect() if r.source == source)
        assert abs(taken.get(source, 0) - target) <= largest / 2 + 1
    assert out.groupBy("doc_id").count().agg({"count": "max"}).first()[0] <= 3


def test_token_stage_keeps_training_order(stages):
    """The token files have the copies in the order of their positions, each as the tokenizer encodes it."""
    import public_tokenizers
    from tokenizers import Tokenizer
    mixed_from, _ = stages["source_mixing"]
    docs, out = stages["token_output"]
    texts = {}
    for r in docs.collect():
        assert texts.setdefault(r.doc_id, r.text) == r.text
    found = sorted(out.collect(), key=lambda r: r.start)
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    plain = {r[0]: r[2:] for r in tokens(list(texts.items()), tokenizer)}
    start = 0
    for r in found:
        assert (r.start, (r.n_tokens, r.ids_crc32)) == (start, plain[r.doc_id])
        start += r.n_tokens
    assert sorted(r.doc_id for r in found) == sorted(r.doc_id for r in docs.collect())
    positions = {r.doc_id: list(r.positions) for r in mixing.positions(mixed_from).collect()}
    order = [positions[r.doc_id].pop(0) for r in found]
    assert order == sorted(order) and [r.doc_id for r in found] != sorted(r.doc_id for r in found)


def test_token_order_of_documents_in_memory(spark):
    """Without files, documents go by doc_id, null first."""
    rows = [(3, "c"), (None, "x"), (1, None), (1, "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert not tok.is_stored(docs)
    out = corpus_pipeline.token_output(spark, docs, "").collect()
    assert [r.doc_id for r in sorted(out, key=lambda r: r.start)] == [None, 1, 1, 3]


def test_run_is_the_stages(stages, spark, data):
    names = ("doc_id", "start", "n_tokens", "ids_crc32")
    run = corpus_pipeline.run(spark, data)
    assert sorted(map(tuple, run.select(*names).collect())) == sorted(map(tuple, stages["token_output"][1].select(*names).collect()))


EXTRA = ["key", "hash", "position", "rank", "size", "doc", "row", "target", "seq", "component", "hi", "lo"]


def odd_documents(spark, data):
    """Given documents, and nulls in every column, empty and very long texts, repeated rows, and columns of names that operators use."""
    given = common.table(spark, data, "documents")
    some = [tuple(r) for r in given.select("doc_id", "text", "lang", "source", "n_chars").collect()]
    long = max(some, key=lambda r: len(r[1] or ""))
    rng, mixed = random.Random(1), []
    for _ in range(40):
        words = long[1].split()
        rng.shuffle(words)
        mixed += words
    rows = some + some[:5]  # repeated rows
    rows += [(None, None, None, None, None), (900_001, None, "en", "src1", 0), (900_002, "", None, None, 0), (900_003, " \t\n", "en", "src0", 3), (900_004, "?!", None, "src1", 2),
             (900_005, " ".join(mixed), long[2], None, None), (None, "null id: " + long[1][:3000], long[2], "src0", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return some, docs.selectExpr("*", *(f"'x' AS {c}" for c in EXTRA))


def test_run_on_odd_documents(spark, data, tmp_path):
    some, docs = odd_documents(spark, data)
    top = str(tmp_path)
    docs.write.parquet(f"{top}/documents.parquet")
    bench = common.table(spark, data, "benchmark")
    bench.union(spark.createDataFrame([(None, None), ("e", ""), ("n", None)], "item_id string, text string").selectExpr(f"CAST(item_id AS {bench.schema['item_id'].dataType.simpleString()})" if bench.schema["item_id"].dataType.simpleString() == "string" else "CAST(NULL AS BIGINT) AS item_id", "text")).write.parquet(f"{top}/benchmark.parquet")
    held = common.table(spark, top, "documents")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        held = common.written(stage(spark, held, top), name)
        assert held.columns == docs.columns
        assert held.where("text IS NULL OR NOT text RLIKE '[A-Za-z]'").count() == 0
        if name == "decontamination":  # the mix may leave out a document larger than its source's target
            clean = {r.doc_id for r in held.collect()}
    assert 900_005 in clean and not clean & {900_001, 900_002, 900_003, 900_004}
    copies = {r.doc_id for r in held.collect()}
    assert copies <= clean
    whole = corpus_pipeline.run(spark, top).collect()
    assert {r.doc_id for r in whole} == copies and all(r.n_tokens > 1 for r in whole)


def test_run_on_no_documents(spark, data, tmp_path):
    top = str(tmp_path)
    common.table(spark, data, "documents").where("false").write.parquet(f"{top}/documents.parquet")
    common.table(spark, data, "benchmark").where("false").write.parquet(f"{top}/benchmark.parquet")
    assert corpus_pipeline.run(spark, top).count() == 0
