"""Every query of the subpackage against its SQL, and the pipeline against its operators row by row."""

import duckdb
import pytest

import __spark_entry__
import corpus_pipeline
from assayloom.llm import quality_rules, secret_scans, simhash_dedup
from assayloom.llm.queries import ORACLE_SQL, QUERIES

DATA = "/root/testdata/sf0.01"
TABLES = ("documents", "pages", "labels", "benchmark", "embeddings")


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{DATA}/{t}.parquet')")
    c = con.execute(ORACLE_SQL[name])
    cols = [d[0] for d in c.description]
    expected = sorted((tuple(r[cols.index(k)] for k in sorted(cols)) for r in c.fetchall()), key=repr)
    df = QUERIES[name](spark, DATA)
    assert sorted(df.columns) == sorted(cols)
    assert sorted((tuple(r[k] for k in sorted(cols)) for r in df.collect()), key=repr) == expected


def test_all_ten_and_the_pipeline_are_registered():
    names = __spark_entry__.queries()
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)) and "pipeline" in names


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    measure = quality_rules.row_measurer()

    good = stages["quality"](spark, docs, DATA)
    kept = {r["doc_id"] for r in good.collect()}
    assert good.columns == docs.columns and kept == {i for i, t in text.items() if measure(t)[6]}

    good = good.cache()
    once = stages["near_duplicates"](spark, good, DATA)
    ids = {r["doc_id"] for r in once.collect()}
    first = {}
    for i in sorted(kept):
        first.setdefault(text[i], i)
    assert once.columns == docs.columns and ids <= set(first.values())
    # whatever went is in a class, by brute force, with one that stayed; nothing else went
    sets = {i: set(simhash_dedup.shingle_set(text[i]).tolist()) for i in kept}
    up = {i: i for i in kept}

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in kept:
        for j in kept:
            if i < j and 0.8 * len(sets[j]) <= len(sets[i]) <= len(sets[j]) / 0.8 + 1 and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = top(i), top(j)
                up[max(a, b)] = min(a, b)
    assert ids == {i for i in kept if up[i] == i}

    masked = stages["secrets"](spark, once, DATA)
    assert {r["doc_id"]: r["text"] for r in masked.collect()} == {i: secret_scans.masked(text[i]) for i in ids}

    mixed = stages["mix"](spark, masked.cache(), DATA)
    assert mixed.columns == docs.columns and {r["doc_id"] for r in mixed.collect()} <= ids
    assert stages["pack"](spark, mixed, DATA).count() == mixed.count()


def test_whole_pipeline_runs(spark):
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert out.count() > 50 and {"doc_id", "n_tokens", "bucket", "batch", "slot"} <= set(out.columns)


def test_pipeline_on_odd_and_no_rows(spark, odd_docs, no_docs, tmp_path):
    """Nulls, blanks, repeats and clashing names pass every stage; an empty table gives no rows."""
    spark.createDataFrame([(3, 1, 0), (None, 0, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for docs in (odd_docs, no_docs):
        now = docs
        for name, stage in corpus_pipeline.STAGES[:-1]:
            now = stage(spark, now, str(tmp_path))
            assert now.columns == docs.columns, name
        assert corpus_pipeline.STAGES[-1][1](spark, now, str(tmp_path)).count() == now.count()
