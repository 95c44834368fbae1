"""The pipeline, stage by stage, and the queries' columns, over the driver's smallest tables."""

from __future__ import annotations

import os

import duckdb
import pytest

import corpus_pipeline
from swarmscope.llm import lang_id, mixing, quality
from swarmscope.llm.queries import QUALITY_LEAST, QUERIES, SQL, remainder
from swarmscope.llm.storage import save

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")

COLUMNS = {
    "op1_nearest": {"query_id": "bigint", "rank": "int", "vec_id": "bigint", "score": "double"},
    "op2_ngram_lm": {"doc_id": "bigint", "held_out": "boolean", "n_tokens": "bigint", "n_known": "bigint", "train_tokens": "bigint", "base_score": "double", "score": "double"},
    "op3_mixing": {"doc_id": "bigint", "size": "bigint", "source_size": "bigint", "target": "double", "taken": "bigint"},
    "op4_packing": {"doc_id": "bigint", "piece": "bigint", "start": "bigint", "n_tokens": "bigint", "sequence": "bigint", "offset": "bigint", "sequence_length": "bigint"},
    "op5_vector_dedup": {"vec_id": "bigint", "n_links": "bigint", "component_id": "bigint", "kept": "boolean"},
    "op6_jaccard_join": {"doc_id": "bigint", "n_shingles": "bigint", "component_id": "bigint"},
    "op7_quality": {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
    "op8_token_files": {"doc_id": "bigint", "start": "bigint", "n_tokens": "bigint", "ids_crc32": "bigint"},
    "op9_language": {"doc_id": "bigint", "held_out": "boolean", "lang_pred": "string", "score": "double"},
    "op10_sharding": {"doc_id": "bigint", "size": "bigint", "text_crc32": "bigint", "law": "string", "shard": "int", "slot": "bigint", "grown_shard": "int"},
}


@pytest.mark.parametrize("name", QUERIES)
def test_columns_and_rows(spark, name):
    out = QUERIES[name](spark, SF)
    assert dict(out.dtypes) == COLUMNS[name]
    source = "embeddings" if "vec_id" in out.columns else "documents"
    rows = spark.read.parquet(f"{SF}/{source}.parquet").count()
    if name == "op1_nearest":
        assert out.count() == 20 * 25
    elif name != "op4_packing":
        assert out.count() == rows


@pytest.mark.parametrize("name", SQL)
def test_sql(spark, name):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    want = con.sql(SQL[name]).df()
    got = QUERIES[name](spark, SF).toPandas()[list(want.columns)]
    show = lambda frame: sorted(tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in frame.values.tolist())
    assert show(got) == show(want)


def components(texts: dict[int, str], width: int, percent: int) -> dict[int, int]:
    sets = {}
    for i, text in texts.items():
        w = text.encode().lower().split()
        sets[i] = {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set()
    root = {i: i for i in sets}
    links = [(i, j) for i in sets for j in sets if i < j and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]) > 0]
    for _ in sets:
        before = dict(root)
        for i, j in links:
            root[i] = root[j] = min(root[i], root[j])
        if before == root:
            break
    return root


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    kept = []
    for name, stage in corpus_pipeline.STAGES:
        docs = save(stage(spark, docs, SF), f"test-{name}")
        kept.append(docs)
        if name != "packing":
            assert docs.columns == columns
    raw = spark.read.parquet(f"{SF}/documents.parquet")
    quality_ids, language_ids, dedup_ids = ({r["doc_id"] for r in k.select("doc_id").collect()} for k in kept[:3])

    voter = quality.fit(raw, spark.read.parquet(f"{SF}/labels.parquet"), remainder(5) != 0)
    scores = {r["doc_id"]: r["quality_score"] for r in quality.score(raw, voter).select("doc_id", "quality_score").collect()}
    assert quality_ids == {i for i, s in scores.items() if s >= QUALITY_LEAST}

    named = lang_id.predict(kept[0], lang_id.fit(kept[0], remainder(4) != 2)).collect()
    assert language_ids == {r["doc_id"] for r in named if r["lang_pred"] != "und" and r["lang_score"] >= corpus_pipeline.SURE_LANGUAGE}

    texts = {r["doc_id"]: r["text"] or "" for r in kept[1].select("doc_id", "text").collect()}
    root = components(texts, corpus_pipeline.SHINGLE, corpus_pipeline.SIMILAR)
    assert dedup_ids == {i for i in texts if root[i] == i}

    sizes = {r["doc_id"]: len((r["text"] or "").encode().split()) for r in kept[2].collect()}
    mixed = [r["doc_id"] for r in kept[3].select("doc_id").collect()]
    assert set(mixed) <= dedup_ids and max(map(mixed.count, set(mixed))) <= 2
    assert sum(sizes[i] for i in mixed) == pytest.approx(1.5 * sum(sizes.values()), rel=0.1)

    packed = kept[4].toPandas()
    assert packed["n_tokens"].sum() == sum(sizes[i] + 1 for i in mixed)
    held = packed.groupby("sequence")["n_tokens"].sum()
    assert (held <= packed.groupby("sequence")["sequence_length"].first()).all()


def test_mixing_reruns_agree(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    a, b = (sorted(r["doc_id"] for r in mixing.mix_sources(d).select("doc_id").collect()) for d in (docs, docs.repartition(7)))
    assert a == b


def test_dedup_keeps_rows_by_identity(spark):
    text = "one two three four five six seven eight nine ten"
    other = "an altogether other text that shares no shingle with it at all"
    rows = [(1, text, "a"), (1, text, "b"), (5, text, "c"), (5, other, "d"), (None, text, "e"), (None, text, "e"), (7, None, "f"), (8, "", "g"), (8, "", "g"), (9, other.upper(), "h"), (5, " ", "i")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n string").repartition(3)
    kept = corpus_pipeline.dedup_stage(spark, docs, SF)
    assert kept.columns == docs.columns
    found = sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=str)
    assert found == sorted([(1, text), (5, other), (None, text), (None, text), (7, None), (8, ""), (5, " ")], key=str)
    assert corpus_pipeline.dedup_stage(spark, docs.limit(0), SF).count() == 0


def test_stages_keep_columns_of_clashing_names(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    clash = docs.selectExpr("*", "'mine' AS quality_score", "doc_id AS lang_score", "'x' AS Lang_Pred", "1 AS name", "2 AS component", "3 AS text_hash")
    for name, stage in corpus_pipeline.STAGES[:4]:
        kept = stage(spark, clash, SF)
        assert kept.columns == clash.columns, name
        first = kept.first()
        assert first["quality_score"] == "mine" and first["lang_score"] == first["doc_id"] and first["Lang_Pred"] == "x"
