"""The pipeline: its stages one by one against brute force, and the registered queries."""

import re

import pytest

import __spark_entry__
import corpus_pipeline
from quotemill.llm import catalog, simhash
from quotemill.llm.common import table
from tests.conftest import SMALL
from tests.llm.test_dedup import plain_components, plain_fingerprint
from tests.llm.test_extraction import check_pieces


def test_stages(spark, small):
    docs = small
    items = [" ".join(r.text.split()) for r in table(spark, SMALL, "benchmark").collect()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r.doc_id: r.text for r in docs.collect()}
        docs = stage(spark, docs, SMALL).cache()
        assert docs.columns == small.columns
        after = {r.doc_id: r.text for r in docs.collect()}
        assert set(after) <= set(before) and all(after[i] == before[i] for i in after)
        if name == "language_id":
            want = {i for i, t in before.items() if re.search(r"[^\W\d_]", t)}
        elif name == "exact_dedup":
            best = {}
            for i, t in sorted(before.items()):
                key = re.sub(r"[\x20\x09-\x0D]", "", t)
                if key not in best or len(t) > len(before[best[key]]):
                    best[key] = i
            want = set(best.values())
        elif name == "simhash_near_dedup":
            want = set(plain_components({i: plain_fingerprint(t) for i, t in before.items()}).values())
        else:
            want = {i for i, t in before.items() if not any(x in " ".join(t.split()) for x in items)}
        assert set(after) == want, name
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SMALL)
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == set(after)
    from quotemill.llm import packing

    check_pieces(docs, packing.pack(docs).collect())


def test_run_on_odd_rows(spark, odd, none, tmp_path):
    table(spark, SMALL, "benchmark").write.parquet(str(tmp_path / "benchmark.parquet"))
    for docs, some in ((odd, True), (none, False)):
        docs.write.mode("overwrite").parquet(str(tmp_path / "documents.parquet"))
        got = corpus_pipeline.run(spark, str(tmp_path)).collect()
        assert bool(got) == some
        if some:
            assert {r.doc_id for r in got} >= {9, 10, 12, 13} and not {1, 2, 3, 11} & {r.doc_id for r in got}


def test_repeated_rows_stay_once(spark):
    docs = spark.createDataFrame([(1, "a b c d e"), (1, "a b c d e"), (2, "a b c d e"), (3, "x")], "doc_id long, text string")
    assert sorted(r.doc_id for r in simhash.keep_one(docs).collect()) == [1, 3]


def test_registration():
    names = __spark_entry__.queries()
    assert {re.match(r"op\d+", n)[0] for n in catalog.QUERIES} == {f"op{n}" for n in range(1, 14)}
    assert set(catalog.QUERIES) | {"pipeline"} <= set(names)
    assert set(catalog.CHECKS) <= set(__spark_entry__.oracle_sql())


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_queries_run(spark, name):
    assert catalog.QUERIES[name](spark, SMALL).count() > 0
