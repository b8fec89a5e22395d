"""The pipeline against plain versions of its stages, each on what the stage before it kept."""

import public_tokenizers

import corpus_pipeline

from . import plain
from .test_operators import corpus, odd, table  # noqa: F401


def test_every_stage_on_its_input(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf)
        out.write.parquet(str(tmp_path / name))
        before, docs = docs, spark.read.parquet(str(tmp_path / name))
        seen[name] = (before.collect(), docs.collect())
        assert docs.columns == columns or name == corpus_pipeline.STAGES[-1][0]
    names = [n for n, _ in corpus_pipeline.STAGES]

    given, kept = seen[names[0]]
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    left = {r.doc_id for r in kept}
    assert all(r.doc_id in left for r in given if labels.get(r.doc_id) == 1) and len(left) < len(given)

    given, kept = seen[names[1]]
    expected = dict(zip([r.doc_id for r in given], plain.recurring_lines([(r.doc_id, r.text) for r in given])))
    assert {r.doc_id: r.text for r in kept} == expected and all(r.n_chars == len(r.text) for r in kept)

    given, kept = seen[names[2]]
    assert {r.doc_id for r in kept} == {i for i, e in plain.near_duplicates([(r.doc_id, r.text) for r in given]).items() if e[2]}

    given, kept = seen[names[3]]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    hit = dict(zip([r.doc_id for r in given], plain.decontaminate([r.text for r in given], items)))
    before = {r.doc_id: r.text for r in given}
    assert {r.doc_id for r in kept} == set(before) and any(h[4] for h in hit.values())
    for r in kept:
        assert (r.text == before[r.doc_id]) == (not hit[r.doc_id][4])

    given, rows = seen[names[4]]
    assert {r.doc_id: r.decoded_sha256 for r in rows} == {r.doc_id: plain.sha(r.text or "") for r in given}
    assert {tuple(r) for r in corpus_pipeline.run(spark, sf).collect()} == {tuple(r) for r in rows}
    assert public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def test_stages_on_odd_rows(spark, odd):  # noqa: F811
    """Null and repeated ids, null and empty texts, repeated rows, columns of clashing names, and no rows at all: each stage gives its columns, and no text that was not there."""
    sf = "/root/testdata/sf0.001"
    for rows in (odd, odd[:0]):
        docs = table(spark, rows) if rows else table(spark, odd).limit(0)
        columns = docs.columns
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, sf)
            got = out.collect()
            assert len(got) <= docs.count() and (out.columns == columns or name == corpus_pipeline.STAGES[-1][0])
            if out.columns == columns:
                docs = spark.createDataFrame(got, docs.schema)
        assert bool(got) == bool(rows)


def test_nothing_is_left_behind(spark):
    """A caller's scope removes what operators keep; the pipeline leaves its last table only, which its result reads."""
    import glob

    from orrery.llm.common import documents, scratch
    from orrery.llm.setsketch import near_duplicates
    from orrery.llm.suffixes import drop_repeats

    sf, top = "/root/testdata/sf0.001", spark.conf.get("spark.checkpoint.dir").removeprefix("file://")
    before = set(glob.glob(f"{top}/*"))
    with scratch():
        for f in (near_duplicates, drop_repeats):
            assert f(documents(spark, sf)).count() == documents(spark, sf).count()
        assert set(glob.glob(f"{top}/*")) > before
    assert set(glob.glob(f"{top}/*")) == before
    corpus_pipeline.run(spark, sf).count()
    assert [x.rsplit("/", 1)[-1].rsplit("-", 1)[0] for x in set(glob.glob(f"{top}/*")) - before] == ["stage-benchmark-decontamination"]
