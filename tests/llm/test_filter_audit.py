from itertools import permutations

import pytest
from small import EXTRA
from pyspark.sql import functions as F

from evalgrid.llm import filter_audit
from evalgrid.session import scratch_path

DOCS = "doc_id bigint, text string, lang string"
LABELS = "doc_id bigint, quality int, toxic int"
LONG = " ".join(f"w{i}" for i in range(210))


def brute(docs, labels):
    """The five filters applied left to right in every order, document by document."""
    good = {d for d, q, _ in labels if q == 1 and d is not None}
    toxic = {d for d, _, t in labels if t == 1 and d is not None}

    def failing(doc_id, text):
        text = text or ""
        words = text.split()
        out = set()
        if len(words) < 200:
            out.add("A")
        if 100 * len(set(words)) < 50 * len(words):
            out.add("B")
        if 100 * sum("A" <= c <= "Z" for c in text) > 3 * len(text):
            out.add("C")
        if any(c in "#$%&*|" for c in text):
            out.add("D")
        if doc_id is not None and any(o is not None and o < doc_id and (t or "") == text for o, t, _ in docs):
            out.add("E")
        return out

    rows = [(doc_id, lang or "", failing(doc_id, text)) for doc_id, text, lang in docs]
    out, shapley = {}, {}
    for part in {p for _, p, _ in rows}:
        for order in map("".join, permutations("ABCDE")):
            left = [(i, f) for i, p, f in rows if p == part]
            for step, name in enumerate(order, 1):
                gone = [(i, f) for i, f in left if name in f]
                left = [(i, f) for i, f in left if name not in f]
                fails = [f for _, p, f in rows if p == part and name in f]
                shapley[part, name] = shapley.get((part, name), 0) + len(gone)
                out[part, order, step] = [len(left), len(gone), len(fails) - len(gone), sum(f == {name} for f in fails), sum(i in good for i, _ in gone), sum(i in toxic for i, _ in gone)]
    return {(p, o, s, *v, shapley[p, o[s - 1]]) for (p, o, s), v in out.items()}


def write(spark, docs, files, extra=False):
    path = scratch_path(spark, "audited")
    for k in range(files):
        df = spark.createDataFrame(docs[k::files], DOCS).coalesce(1)
        if extra:
            df = df.withColumns({n: F.lit(n) for n in (*EXTRA, "mask", "good", "named", "digest", "n", "id", "salt", "_metadata")})
        df.write.mode("append").parquet(path)
    return path


def audited(spark, docs, labels, files=4, batches=4, extra=False):
    path = write(spark, docs, files, extra)
    rows = filter_audit.audit(spark, path, spark.createDataFrame(labels, LABELS), batches).collect()
    return [tuple(r) for r in rows]


def odd_documents():
    texts = [LONG, None, "", LONG + " #", "A" * 40, "same " * 300, "X Y Z " * 100, "ß" * 50 + " É"]
    docs = [(100 - k, texts[k % 8], [None, "", "en", "de"][k % 4]) for k in range(48)]  # smaller ids arrive later
    docs += [(7, LONG, "en")] * 3 + [(None, LONG, "en"), (None, LONG, None), (2**60 + 1, LONG, "fr"), (2**60, LONG, "fr")]
    return docs


LABELLED = [(k, k % 2, k % 3 - 1) for k in range(50, 101)] + [(60, 1, 1), (60, 0, 0), (None, 1, 1), (7, None, 1)]


@pytest.mark.parametrize("files,batches", [(6, 6), (3, 1)])
def test_equals_applying_filters_document_by_document(spark, files, batches):
    got = audited(spark, odd_documents(), LABELLED, files, batches, extra=files == 3)
    want = brute(odd_documents(), LABELLED)
    assert len(got) == len(want) and set(got) == want


def test_smaller_ids_in_later_runs_retract_earlier_masks(spark):
    docs = odd_documents()
    ledger = filter_audit.FilterAudit(spark, scratch_path(spark, "audit"))
    path, labels = write(spark, docs[:20], 2), spark.createDataFrame(LABELLED, LABELS)
    ledger.ingest(path, labels, buckets=3)
    assert {tuple(r) for r in filter_audit.interactions(ledger.counters()).collect()} == brute(docs[:20], LABELLED)
    spark.createDataFrame(docs[20:], DOCS).coalesce(1).write.mode("append").parquet(path)
    ledger.ingest(path, labels, buckets=3)
    assert {tuple(r) for r in filter_audit.interactions(ledger.counters()).collect()} == brute(docs, LABELLED)
    changes = spark.read.parquet(f"{ledger.checkpoint}/changes/*")
    assert changes.where("n < 0").count() > 0


def test_table_without_rows_or_labels(spark):
    assert audited(spark, [], [], files=1) == []
    docs = [(1, "Hello", "en"), (2, "Hello", "en")]
    assert set(audited(spark, docs, [], files=1)) == brute(docs, [])


def test_labels_are_shuffled_and_not_sent_to_the_driver(spark):
    masked = spark.range(40).selectExpr("id % 30 id", "true named", "cast(id % 8 as int) salt")
    known = filter_audit.labelled(masked, spark.createDataFrame(LABELLED + [(3, 1, 0)], LABELS), "doc_id")
    plan = known._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
    assert sorted((r["id"], r["good"], r["toxic"]) for r in known.collect()) == sorted((k % 30, k % 30 == 3, k % 30 == 7) for k in range(40))
