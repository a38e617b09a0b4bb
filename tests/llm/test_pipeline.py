import corpus_pipeline
from pagelens.llm import mixing, near_dups, quality, sharding

from .test_decontaminate import _brute as leaks
from .test_near_dups import brute as classes
from .test_quality import _plain_mcd


def test_stages_in_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "decontamination", "mixing", "sharding"]
    assert corpus_pipeline.ORACLE_SQL is None


def test_the_run_against_plain_python(spark, sf_dir):
    """Quality, near-duplicates and leaks are worked out by the plain versions that the operators' tests hold; what the mix takes
    is the operator's own choice (chance from hashes), whose totals its tests hold."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = {r.doc_id: r for r in docs.collect()}
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()
    table = [(r.doc_id, r.text, r.lang, r.source) for r in rows.values()]
    left = {r[0] for r, (failed, d) in zip(table, _plain_mcd(table), strict=True) if not failed and (d is None or d <= quality.CUTOFF)}
    kept = {r.doc_id for r in near_dups.drop_near_duplicates(spark.createDataFrame([rows[d] for d in sorted(left)], docs.schema)).collect()}
    want = set(classes([(d, rows[d].text) for d in sorted(left)]).values())
    assert len(kept ^ want) <= 0.02 * len(want)  # two texts just within the similarity may share no sketch
    left = kept
    left -= {d for d, _ in leaks([(d, rows[d].text) for d in left], [(r.item_id, r.text) for r in items])}
    copies = {r.doc_id: r.copies for r in mixing.mix(spark.createDataFrame([rows[d] for d in sorted(left)], docs.schema)).collect()}
    want = sorted(d for d in left for _ in range(copies[d]))
    out = corpus_pipeline.run(spark, sf_dir)
    got = out.collect()
    assert out.columns == [*docs.columns, "shard"]
    assert sorted(r.doc_id for r in got) == want
    assert all(rows[r.doc_id].text == r.text for r in got)
    shards = {r.doc_id: r.shard for r in sharding.shard_rows(docs, corpus_pipeline.SHARDS).collect()}
    assert all(shards[r.doc_id] == r.shard for r in got)


def test_a_stage_deletes_what_the_one_before_left_and_keeps_what_it_reads(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(40)
    first = corpus_pipeline.keep_quality(spark, docs, sf_dir)
    again = corpus_pipeline.drop_copies(spark, first, sf_dir)  # not written in between: the files that it reads stay
    assert 0 < again.count() <= 40
