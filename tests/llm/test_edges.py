"""Every operator and stage on an odd table and an empty one."""

import pytest
from pyspark.sql import functions as F

from echofold.llm import forest, linededup, mixing, packing, search, sharding, simhash, suffix, tokens, toxicity

OPERATORS = {
    "packing": lambda d, l: packing.pack(d),
    "simhash": lambda d, l: simhash.groups(d),
    "mixing": lambda d, l: mixing.mix(d),
    "tokens": lambda d, l: tokens.count(d),
    "sharding": lambda d, l: sharding.shard(d),
    "toxicity": lambda d, l: toxicity.judge(d, l),
    "suffix": lambda d, l: suffix.spans(d),
    "linededup": lambda d, l: linededup.dedup(d),
}
ONE_EACH = {"simhash", "mixing", "tokens", "sharding", "toxicity", "linededup"}


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_rows(name, odd, labels):
    got = OPERATORS[name](odd, labels).collect()
    if name in ONE_EACH:
        assert len(got) == odd.count()


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(name, nothing, labels):
    assert OPERATORS[name](nothing, labels).collect() == []


def test_no_labels(docs, labels):
    got = toxicity.judge(docs, labels.limit(0))
    assert got.where("toxic").count() == 0 and got.count() == docs.count()


@pytest.mark.parametrize("run", [linededup.dedup, sharding.shard])
def test_clashing_columns_are_kept(run, odd):
    out = run(odd)
    assert len(set(c.lower() for c in out.columns)) == len(out.columns)
    assert out.count() == odd.count()
    assert sum(c.rstrip("_in") != c or True for c in out.columns) >= len(odd.columns)


def test_stages_keep_the_columns(odd, labels, tmp_path):
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    for stage in (linededup.stage, simhash.stage, mixing.stage, toxicity.stage):
        out = stage(odd.sparkSession, odd, str(tmp_path))
        assert out.columns == odd.columns
        assert out.count() <= odd.count()


def test_repeated_rows_leave_one(odd):
    out = simhash.stage(odd.sparkSession, odd, "")
    ids = [r[0] for r in out.where("doc_id is not null").select("doc_id").collect()]
    assert len(ids) == len(set(ids))
    assert out.where("doc_id is null").count() == 2


def vectors(spark, rows):
    return spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, id string")


def test_odd_vectors(spark):
    v = [1.0, 0.0, 2.0]
    rows = [(0, v), (1, v), (1, v), (2, None), (None, v), (3, [0.0, 0.0, 0.0]), (4, [1.0, None, 2.0]), (5, [float("nan"), 1.0, 1.0]), (6, [1.0]), (7, [])]
    got = {r["vec_id"]: r["group_id"] for r in forest.groups(vectors(spark, rows)).where("vec_id is not null").collect()}
    assert got[1] == 0 and all(got[i] == i for i in (2, 3, 4, 5, 6, 7))
    assert forest.groups(vectors(spark, rows)).count() == len(rows)
    assert forest.groups(vectors(spark, rows)).where("keep and vec_id = 1").count() == 0
    top = search.top_k(vectors(spark, rows), k=3)
    assert top.select("vec_id").distinct().count() == 7  # all but the null vector and the null id
    assert top.where("vec_id = neighbor_id").count() == 0


@pytest.mark.parametrize("run", [forest.groups, search.top_k])
def test_no_vectors(spark, run):
    assert run(vectors(spark, [])).collect() == []
    assert run(vectors(spark, [(1, None)])).where(F.lit(True)).count() <= 1
