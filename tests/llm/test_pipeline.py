import __spark_entry__ as entry
import corpus_pipeline
import pytest
from made_up import prose, rows_of

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def stages(spark, tmp_path_factory):
    """Inputs and outputs of all stages over the smallest tables."""
    out, docs = [], spark.read.parquet(f"{SF}/documents.parquet")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path_factory.mktemp("stage") / str(k))
        stage(spark, docs, SF).write.parquet(path)
        out.append((docs, spark.read.parquet(path)))
        docs = out[-1][1]
    return out


def test_columns_and_rows(spark, stages):
    columns = spark.read.parquet(f"{SF}/documents.parquet").columns
    for docs, result in stages[:-1]:
        assert result.columns == columns
        assert 0 < result.count() <= docs.count()
        assert result.exceptAll(docs).count() == 0
    last = corpus_pipeline.run(spark, SF)
    want = stages[-1][1]
    assert last.count() == stages[-1][0].count() and last.exceptAll(want).count() == 0


def test_one_of_each_group_stays(spark, stages):
    docs, result = stages[1]
    sets = {}
    for r in docs.collect():
        w = r.text.lower().split()
        sets[r.doc_id] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or {tuple(w)}
    kept = {r.doc_id for r in result.select("doc_id").collect()}
    alike = lambda a, b: 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])
    assert not any(alike(a, b) for a in kept for b in kept if a < b)
    assert all(any(alike(a, b) for b in sets if b != a) for a in set(sets) - kept)


def test_stages_take_odd_and_empty_rows(spark, odd, none):
    for docs in (odd, none):
        for _, stage in corpus_pipeline.STAGES:
            assert stage(spark, docs, SF).count() <= docs.count()
    copies = spark.createDataFrame(rows_of(["one two three four five six seven"] * 4) + [(9, " ", *[None] * 8)] * 2, odd.schema)
    assert sorted(r.doc_id for r in corpus_pipeline.near_duplicates(spark, copies, SF).collect()) == [0, 9, 9]


def test_groups_of_missing_and_repeated_ids(spark, odd):
    a, b, c, d = (prose(k, 60, 4000) for k in range(4))
    rows = [(k, t, *[None] * 8) for k, t in ((None, a), (None, b), (None, b), (7, c), (7, d), (7, d), (8, a + " end"))]
    docs = spark.createDataFrame(rows, odd.schema)
    got = corpus_pipeline.near_duplicates(spark, docs, SF).collect()
    assert sorted(r.text.removesuffix(" end") for r in got) == sorted([a, b, c, d])


def test_rows_keep_their_numbers_when_files_are_cut_anew(spark, odd, tmp_path):
    texts = [prose(k // 2, 60, 4000) for k in range(40)]
    spark.createDataFrame(rows_of(texts), odd.schema).repartition(9, "doc_id").write.parquet(str(tmp_path / "docs"))
    result = corpus_pipeline.near_duplicates(spark, spark.read.parquet(str(tmp_path / "docs")), SF)
    key = "spark.sql.files.maxPartitionBytes"
    usual = spark.conf.get(key)
    spark.conf.set(key, "1k")
    try:
        got = sorted(r.doc_id for r in result.collect())
    finally:
        spark.conf.set(key, usual)
    assert got == list(range(0, 40, 2))


def test_every_query_is_registered():
    names = list(entry.queries())
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))
    assert set(entry.oracle_sql()) <= set(names)
