from collections import Counter

import duckdb
from test_mix import check as check_mix
from test_pack import check as check_packing
from test_simhash import near_groups

import corpus_pipeline
from quarryline.llm import line_dedup, mix
from quarryline.llm.common import settle
from quarryline.llm.pack import default_tokenizer

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages_run_on_what_the_one_before_kept(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        out = settle(stage(spark, docs, sf_dir))
        seen.append((name, out))
        if name != "packing":
            assert out.columns == COLUMNS
            docs = out
    by = dict(seen)
    ids = lambda n: [r.doc_id for r in by[n].select("doc_id").collect()]
    first = ids("quality_classifier")
    assert 0 < len(first) < spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    assert sorted(ids("line_dedup")) == sorted(first)
    lines = by["line_dedup"].collect()
    assert all(r.n_chars == len(r.text) for r in lines)
    kept = ids("simhash_near_dedup")
    assert len(kept) == len(set(kept)) < len(first) and set(kept) <= set(first)
    mixed = ids("mix_to_targets")
    assert set(mixed) <= set(kept) and max(map(mixed.count, set(mixed))) <= 3
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(default_tokenizer())
    want = sum(len(t.encode(r.text or "", add_special_tokens=False).ids) + 1 for r in by["mix_to_targets"].collect())
    assert sum(r.length for r in by["packing"].collect()) == want


def test_run_equals_its_stages(spark, sf_dir):
    rows = corpus_pipeline.run(spark, sf_dir).collect()
    again = corpus_pipeline.run(spark, sf_dir).collect()
    key = lambda r: (r.doc_id, r.start, r.length, r.ids_crc32)
    assert sorted(map(key, rows)) == sorted(map(key, again)) and rows


def test_stages_on_no_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, sf_dir).count() == 0, name


def test_each_stage_equals_brute_force_on_its_input(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = settle(corpus_pipeline.quality_classifier(spark, docs, sf_dir))
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    ids = {r.doc_id for r in kept.collect()}
    right = [(i in ids) == (q == 1) for i, q in labels.items()]
    assert sum(right) / len(right) > 0.95

    lines = settle(corpus_pipeline.line_deduplication(spark, kept, sf_dir))
    kept.write.parquet(str(tmp_path / "kept"))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/kept/*.parquet')")
    want = {r[0]: r[3] for r in con.sql(line_dedup.SQL).fetchall()}
    assert {r.doc_id: r.text for r in lines.collect()} == want

    single = settle(corpus_pipeline.simhash_near_dedup(spark, lines, sf_dir))
    parts = near_groups(want)  # by all pairs; the smallest doc_id of each group
    stay = {r.doc_id for r in single.collect()}
    assert set(parts.values()) <= stay and len(stay) == single.count()
    missed = stay - set(parts.values())
    assert len(missed) <= 0.1 * (len(parts) - len(set(parts.values()))) and not {want[i] for i in missed} & {want[i] for i in set(parts.values())}

    mixed = settle(corpus_pipeline.mix_to_targets(spark, single, sf_dir))
    rows = check_mix(mix.mix(single))
    assert Counter(r.doc_id for r in mixed.collect()) == Counter({r.doc_id: r.copies for r in rows if r.copies})

    once = mixed.dropDuplicates(["doc_id"])
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(default_tokenizer())
    texts = {r.doc_id: r.text for r in once.collect()}
    assert check_packing(corpus_pipeline.packing(spark, once, sf_dir).collect(), texts, tokenizer) == 0
