"""The pipeline, stage by stage, against plain versions of its decisions."""

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from pyspark.sql import functions as F  # noqa: E402
from small import classes, docs_table, prose  # noqa: E402
from test_near_copies import _plain, _similar  # noqa: E402

import __spark_entry__ as entry  # noqa: E402
from evalgrid.llm import mixing, packing, secret_scan, toxicity  # noqa: E402

STAGES = dict(corpus_pipeline.STAGES)


def test_stages_by_hand(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    kept = STAGES["toxicity"](spark, docs, data)
    model = toxicity.fit(docs, spark.read.parquet(f"{data}/labels.parquet"))
    rows = [r for r in docs.collect() if model.exceed(r["text"])[0] < model.cut]
    assert kept.columns == docs.columns and sorted(kept.collect()) == sorted(rows)

    kept = STAGES["near_duplicates"](spark, kept, data)
    roots = classes({r["doc_id"]: _plain(r["text"]) for r in rows}, _similar)
    rows = [r for r in rows if roots[r["doc_id"]] == r["doc_id"]]
    assert sorted(kept.collect()) == sorted(rows)

    kept = STAGES["secrets"](spark, kept, data)
    texts = {}
    for r in rows:
        out, at = [], 0
        for start, _, end, _ in secret_scan.base_spans(r["text"]):
            out += [r["text"][at:start], secret_scan.MARK] if start >= at else []
            at = max(at, end)
        texts[r["doc_id"]] = "".join([*out, r["text"][at:]])
    assert {r["doc_id"]: r["text"] for r in kept.collect()} == texts
    assert all(r["n_chars"] == len(r["text"]) for r in kept.collect())

    drawn = STAGES["mixing"](spark, kept, data)
    out, chance, flag = mixing.mixed(kept, packing.word_count(F.col("text")), mixing.genre(F.col("text")))
    assert sorted(drawn.collect()) == sorted(out.where(F.col(flag)).select(kept.columns).collect())
    assert drawn.count() > 0.4 * kept.count()

    packed = STAGES["packing"](spark, drawn, data).collect()
    tokens = {}
    for r in packed:
        tokens[r["doc_id"]] = tokens.get(r["doc_id"], 0) + r["n_tokens"]
    assert tokens == {r["doc_id"]: len(r["text"].split()) for r in drawn.collect()}


def test_odd_documents_pass_all_stages(spark, tmp_path):
    rows = [(None, None), (1, ""), (2, "x" * 50_000), (3, prose(3), "en", "s"), (3, prose(3), "en", "s"), (4, prose(4), None, "s"), (5, prose(5), "en", None)]
    docs_table(spark, rows, extra=True).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(3, 0, 1)], "doc_id bigint, toxic int, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 0
    docs_table(spark, rows).where("false").write.parquet(f"{tmp_path}/none/documents.parquet")
    spark.createDataFrame([], "doc_id bigint, toxic int").write.parquet(f"{tmp_path}/none/labels.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0


def test_all_are_registered():
    names = entry.queries()
    assert "pipeline" in names and all(any(q.startswith(f"op{n}_") for q in names) for n in range(1, 14))
    assert corpus_pipeline.ORACLE_SQL is None and len(corpus_pipeline.STAGES) == 5
