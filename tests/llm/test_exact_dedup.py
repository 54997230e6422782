import hashlib

import pytest
from pyspark.sql import functions as F
from small import DOCS, EXTRA

from evalgrid.llm import exact_dedup
from evalgrid.session import scratch_path

BLANKS = " \t\n\x0b\f\r"


def write(spark, docs, files=3, extra=False, path=None):
    path = path or scratch_path(spark, "deduplicated")
    for k in range(files):
        df = spark.createDataFrame([(*d, "en", "s", 0) for d in docs[k::files]], DOCS).coalesce(1)
        if extra:
            df = df.withColumns({n: F.lit(n) for n in (*EXTRA, "digest", "file", "keep", "_metadata")})
        df.write.mode("append").parquet(path)
    return path


def brute(docs):
    """(doc_id, keep_id, group_size, kept, digest), sorted; one row of each group stays."""
    groups = {}
    for doc_id, text in docs:
        text = text or ""
        groups.setdefault("".join(c for c in text if c not in BLANKS), []).append((-len(text), doc_id is None, doc_id or 0, doc_id))
    rows = []
    for bare, members in groups.items():
        members.sort(key=lambda m: m[:3])
        for rank, member in enumerate(members):
            rows.append((member[3], members[0][3], len(members), rank == 0, hashlib.sha256(bare.encode()).hexdigest()))
    return sorted(rows, key=repr)


def plain(df):
    rows = df.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest"))).collect()
    return sorted(map(tuple, rows), key=repr)


def odd_documents():
    docs = [(k, text) for k, text in enumerate(["a b", "ab", " a\tb\n", "a b", None, "", " \r\x0b", "x" * 30_000, "x " * 30_000, "é́", "é"])]
    docs += [(50, "a b c")] * 4 + [(None, "a  b c"), (None, "only anonymous"), (None, "only  anonymous"), (49, "abc d"), (48, "ab cd")]
    return docs + [(1000 + k, "hot text") for k in range(40)]


@pytest.mark.parametrize("files,batches", [(5, 5), (2, 1)])
def test_equals_grouping_whole_texts(spark, files, batches):
    path = write(spark, odd_documents(), files, extra=files == 2)
    assert plain(exact_dedup.exact_duplicates(spark, path, batches=batches)) == brute(odd_documents())


def test_another_run_takes_in_only_new_files(spark):
    docs = odd_documents()
    memory = exact_dedup.ExactDuplicates(spark, scratch_path(spark, "memory"))
    path = write(spark, docs[:20])
    memory.ingest(path)
    assert plain(memory.assess(path)) == brute(docs[:20])
    write(spark, docs[20:], path=path)
    memory.ingest(path)
    assert plain(memory.assess(path)) == brute(docs)
    memory.ingest(path)  # nothing new
    assert plain(memory.assess(path)) == brute(docs)


def test_colliding_digests_are_told_apart_by_the_full_text(spark):
    docs = odd_documents()
    path = write(spark, docs)
    memory = exact_dedup.ExactDuplicates(spark, scratch_path(spark, "weak"), digest=lambda bare: F.substring(F.md5(bare), 1, 1).cast("binary"))
    memory.ingest(path)
    got = [tuple(r) for r in memory.assess(path).select("doc_id", "keep_id", "group_size", "kept").collect()]
    assert sorted(got, key=repr) == sorted((r[:4] for r in brute(docs)), key=repr)


def test_empty_table(spark):
    path = write(spark, [], files=1)
    assert plain(exact_dedup.exact_duplicates(spark, path)) == []
