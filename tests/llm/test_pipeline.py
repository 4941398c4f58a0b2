"""The pipeline's stages over small tables, and the driver's registration."""

import re

from pyspark.sql import functions as F

from tests.conftest import SF
from tests.oracle import same


def test_stages_keep_columns_and_ids(spark, tmp_path):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names, ids = docs.columns, {r["doc_id"] for r in docs.select("doc_id").collect()}
    assert len(p.STAGES) == 5
    for k, (_, stage) in enumerate(p.STAGES):
        stage(spark, docs, SF).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        now = {r["doc_id"] for r in docs.select("doc_id").collect()}
        assert now <= ids and docs.count() == len(now)
        assert docs.columns == names if k < 4 else set(docs.columns) == {*names, "shard", "slot"}
        ids = now
    assert len(ids) > 50


def test_stages_of_an_empty_table(spark):
    import corpus_pipeline as p

    for _, stage in p.STAGES:
        empty = spark.createDataFrame([], spark.read.parquet(f"{SF}/documents.parquet").schema)
        assert stage(spark, empty, SF).count() == 0


def test_stages_of_awkward_rows(spark, tmp_path):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    n = docs.count()
    sample = docs.orderBy("doc_id").limit(3)
    long_ = docs.orderBy("doc_id").limit(1).withColumn("text", F.repeat(F.concat("text", F.lit(" ")), 400)).withColumn("doc_id", F.lit(-5).cast("long"))
    odd = sample.unionByName(sample).unionByName(long_)
    for name in docs.columns:
        odd = odd.unionByName(sample.withColumn(name, F.lit(None).cast(docs.schema[name].dataType)))
    odd = odd.unionByName(sample.withColumn("text", F.lit(""))).unionByName(sample.withColumn("text", F.lit(" \n\t")))
    extras = "rec lang_pred accepted score t1 t2 stays least own text_key place cell salt bucket n domain language leaf".split()
    rows = docs.unionByName(odd).withColumns({x: F.lit(f"clash {x}") for x in extras})
    before = None
    for k, (_, stage) in enumerate(p.STAGES):
        out = stage(spark, rows, SF)
        out.write.parquet(str(tmp_path / str(k)))
        rows = spark.read.parquet(str(tmp_path / str(k)))
        assert set(rows.columns) == {*docs.columns, *extras, *(["shard", "slot"] if k == 4 else [])}
        assert rows.where(" OR ".join(f"{x} <> 'clash {x}'" for x in extras)).isEmpty()
        now = rows.count()
        assert 0 < now <= (before or n + odd.count())
        before = now
    assert rows.where("text IS NULL OR trim(text) = ''").isEmpty()


def test_pipeline_by_brute_force(spark):
    """Every stage after the classifier, worked out apart from the operators."""
    import corpus_pipeline as p
    from tests.llm.test_operators import brute_groups, brute_mix, leaks_by_words

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = p.language_id(spark, docs, SF).collect()
    right = {r["doc_id"]: r["lang"] for r in docs.collect()}
    assert sum(r["lang"] == right[r["doc_id"]] for r in rows if right[r["doc_id"]]) > 0.98 * len(rows)
    groups = brute_groups([(r["doc_id"], r["text"]) for r in rows])
    rows = [r for r in rows if groups.get(r["doc_id"], r["doc_id"]) == r["doc_id"]]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    bad = {d for d, _ in leaks_by_words([(r["doc_id"], r["text"]) for r in rows], items)}
    rows = [r for r in rows if r["doc_id"] not in bad]
    used = {x[0] for x in brute_mix([(r["doc_id"], r["text"], r["lang"], r["source"]) for r in rows], p.SHARE, 1)}
    want = {(r["doc_id"], r["text"], r["lang"], r["source"]) for r in rows if r["doc_id"] in used}
    got = p.run(spark, SF).collect()
    assert len(got) == len(want) and {(r["doc_id"], r["text"], r["lang"], r["source"]) for r in got} == want
    slots = {(r["shard"], r["slot"]) for r in got}
    least, extra = divmod(len(got), p.SHARDS)
    assert slots == {(s, k) for s in range(p.SHARDS) for k in range(least + (s < extra))}


def test_decontamination_stage_drops_leaks_alone(spark):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    items = [r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    kept = {r["doc_id"] for r in p.decontamination(spark, docs, SF).collect()}
    leaks = {r["doc_id"] for r in docs.collect() if any(x in r["text"] for x in items if len(re.findall(r"\w+", x)) >= 8)}
    assert leaks and {r["doc_id"] for r in docs.collect()} - kept == leaks


def test_registered_queries(spark, duck):
    from quire.llm.registry import oracle_sql, queries

    assert {re.match(r"op(\d+)_", q)[1] for q in queries()} == set(map(str, range(1, 11)))
    assert set(oracle_sql()) <= set(queries())
    for name, sql in oracle_sql().items():
        same(queries()[name](spark, SF), duck, sql)
