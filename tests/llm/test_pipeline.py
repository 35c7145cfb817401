"""The registered queries and the pipeline: their SQL, and brute force stage by stage."""

import hashlib
from collections import Counter

import duckdb
import pytest

import __spark_entry__
import corpus_pipeline
from tests.llm.test_operators import EDGES, LONG, SCHEMA, brute_components, brute_repeats
from tsveil.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_oracle(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "pages"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    ours, theirs = queries.QUERIES[name](spark, SF).toPandas(), con.sql(queries.ORACLE_SQL[name]).df()
    names = sorted(ours.columns)
    assert names == sorted(theirs.columns)
    a, b = (x[names].sort_values(names).reset_index(drop=True) for x in (ours, theirs))
    assert len(a) and a.astype(str).equals(b.astype(str))


def test_all_are_registered():
    names = __spark_entry__.queries()
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)) and "pipeline" in names


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    kept = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs.collect()
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        kept[name] = (before, docs.collect())
        assert docs.columns == columns or k == len(corpus_pipeline.STAGES) - 1
    before, after = kept["language"]
    assert {r["doc_id"] for r in after} == {r["doc_id"] for r in before if any(c.isalpha() for c in r["text"] or "")}
    before, after = kept["near_duplicates"]
    assert {r["doc_id"] for r in after} == {d for d, _, c in brute_components([(r["doc_id"], r["text"]) for r in before]) if d == c}
    before, after = kept["repeats"]
    want = {i: h for i, _, _, h in brute_repeats([(r["doc_id"], r["text"]) for r in before])}
    assert {str(r["doc_id"]): hashlib.sha256(b" ".join((r["text"] or "").encode().split())).hexdigest() for r in after} == want
    before, after = kept["decontamination"]
    gone = {r["doc_id"] for r in before} - {r["doc_id"] for r in after}
    items = {" ".join(r["text"].split()) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    assert {r["doc_id"] for r in before if any(i in " ".join((r["text"] or "").split()) for i in items)} <= gone
    before, after = kept["packing"]
    assert sorted(r["doc_id"] for r in after) == sorted(r["doc_id"] for r in before)


def test_stages_with_null_and_repeated_ids(spark, tmp_path):
    """Each stage on the same rows: ids that are null or occur twice, with equal and with other texts."""
    own = spark.read.parquet(f"{SF}/documents.parquet").limit(40).collect()
    item = spark.read.parquet(f"{SF}/benchmark.parquet").orderBy("item_id").first()["text"]
    rows = [*EDGES, *EDGES, *(tuple(r) for r in own), (None, own[0]["text"], None, None, 1), (own[1]["doc_id"], own[2]["text"], "en", "s", 1)]
    rows += [(None, f"before it {item} and after", "en", "s", 1), (7_000_001, f"again {item}", None, None, None)]
    docs = spark.createDataFrame(rows, SCHEMA)
    texts = [(r[0], r[1]) for r in rows]
    out = {name: stage(spark, docs, SF).collect() for name, stage in corpus_pipeline.STAGES}
    count = lambda found: Counter(str((r[0], r[1])) for r in found)
    # LONG's letters are "w w w ...", which no language explains
    assert count(out["language"]) == count([t for t in texts if any(c.isalpha() for c in t[1] or "") and t[1] != LONG])
    firsts = {(str(d), c) for d, _, c in brute_components(texts)}
    assert {str(r["doc_id"]) for r in out["near_duplicates"]} == {d for d, c in firsts if d == str(c)}
    kept = sorted((str(r["doc_id"]), hashlib.sha256(b" ".join((r["text"] or "").encode().split())).hexdigest()) for r in out["repeats"])
    assert kept == sorted((i, h) for i, _, _, h in brute_repeats(rows))
    clean = count(out["decontamination"])
    assert not any(item in (r["text"] or "") for r in out["decontamination"])
    assert all(clean[str(t)] in (0, n) for t, n in Counter(texts).items()) and clean[str((1, None))] == 2
    assert count([(r["doc_id"], r["n_tokens"]) for r in out["packing"]]) == count([(d, len((t or "").encode().split()) + 1) for d, t in texts])


def test_run(spark):
    assert corpus_pipeline.run(spark, SF).count() > 100
