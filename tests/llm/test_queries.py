import pytest

import corpus_pipeline
from matchloom.llm import catalogue

DIR = "/root/testdata/sf0.001"
COLUMNS = {
    "op1_substring_dedup": ["doc_id", "n_words", "n_removed", "kept_sha256"],
    "op2_token_counts": ["doc_id", "n_bytes", "n_tokens", "over_limit"],
    "op3_license_scan": ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"],
    "op4_language_id": ["doc_id", "held_out", "lang_pred", "score"],
    "op5_mix_sources": ["doc_id", "size", "source_size", "target", "taken"],
    "op6_pii_surrogates": ["doc_id", "text"],
    "op7_tiff_media": ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"],
    "op8_sentencepiece": ["doc_id", "n_tokens", "round_trip"],
    "op9_jaccard_join": ["doc_id", "n_shingles", "component_id"],
    "op10_embedding_duplicates": ["vec_id", "n_links", "component_id", "kept"],
}


@pytest.mark.parametrize("name", COLUMNS)
def test_every_row_has_a_result(spark, name):
    got = catalogue.QUERIES[name](spark, DIR)
    assert set(COLUMNS[name]) <= set(got.columns)
    table = "embeddings" if name.startswith("op10") else "documents"
    assert got.count() == spark.read.parquet(f"{DIR}/{table}.parquet").count()


def test_the_pipeline(spark, clashing, tmp_path):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    columns, counts = docs.columns, [docs.count()]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, DIR).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        counts.append(docs.count())
        if k < 4:
            assert docs.columns == columns, name
        if name == "near_duplicates":
            assert docs.select("doc_id").distinct().count() == docs.count()
    assert counts[1] > 0.95 * counts[0] and counts[2] <= counts[1] and counts[3] == counts[2] and counts[5] == counts[4]
    assert docs.where("not round_trip").count() == 0
    whole = corpus_pipeline.run(spark, DIR)
    assert sorted(map(tuple, whole.select("doc_id", "ids_sha256").collect())) == sorted(map(tuple, docs.select("doc_id", "ids_sha256").collect()))


def test_the_pipeline_keeps_clashing_columns_and_repeated_rows(spark, clashing, tmp_path):
    docs = clashing
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, DIR).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        if k < 4:
            assert docs.columns == clashing.columns, name
        if name == "near_duplicates":
            assert [r.doc_id for r in docs.collect()] == [1]
    assert {r.doc_id for r in docs.collect()} == {1} and docs.where("not round_trip").count() == 0


def test_operators_leave_no_tables_but_their_results(spark, tmp_path):
    from pathlib import Path

    from matchloom.tables import shared_dir

    place = Path(shared_dir(spark))
    for name in ("op1_substring_dedup", "op3_license_scan", "op5_mix_sources", "op6_pii_surrogates", "op9_jaccard_join", "op10_embedding_duplicates"):
        before = set(place.iterdir())
        held = catalogue.QUERIES[name](spark, DIR)
        n = held.count()
        assert len(set(place.iterdir()) - before) <= 2, name
        # another run does not take what a held result reads
        catalogue.QUERIES[name](spark, DIR)
        assert held.count() == n


def test_the_pipeline_of_an_empty_table(spark, tmp_path):
    docs = spark.read.parquet(f"{DIR}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, DIR).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
    assert docs.count() == 0


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_as_duckdb(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    df = catalogue.QUERIES[name](spark, DIR)
    want = con.execute(catalogue.ORACLES[name])
    names = [c[0] for c in want.description]
    assert sorted(df.columns) == sorted(names)
    assert sorted(map(str, (tuple(r) for r in df.select(*names).collect()))) == sorted(map(str, want.fetchall()))
