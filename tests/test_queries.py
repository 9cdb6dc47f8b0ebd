"""Every registered query against its SQL, and the entry file without the training-data part."""

import subprocess
import sys

import oracle
import pytest

from sparrowdoc import registry

NAMES = sorted(registry.queries())


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, sf, name):
    df = registry.queries()[name](spark, sf)
    if sql := registry.oracle_sql().get(name):
        assert oracle.difference(df, sql, oracle.connection(sf)) == ""
    assert df.limit(1).count() == 1
    spark.catalog.clearCache()


@pytest.mark.parametrize("missing", ["sparrowdoc.llm", "corpus_pipeline", "zstandard", "public_tokenizers_"])
def test_entry_without_training_part(missing):
    """The other queries stay where the training-data part, or a library that it needs, is absent."""
    code = f"import sys; sys.modules[{missing!r}] = None\nimport __spark_entry__ as e; q = e.queries(); assert 'bm25_topk' in q and set(e.oracle_sql()) <= set(q)\nassert ('pipeline' in q) == ({missing!r} == 'public_tokenizers_'), list(q)"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=__file__.rsplit("/tests/", 1)[0])


def test_title_dedup_is_the_greedy_loop(spark, sf):
    import re
    import unicodedata

    rows = [(r.doc_id, r.source, r.text.split("\n")[0]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    kept = []
    for d, s, t in sorted(rows):
        k = re.sub("[^a-z0-9 ]", "", unicodedata.normalize("NFKD", t).lower().replace("ß", "")).strip()
        alike = lambda o: o == k or (len(min(o, k, key=len)) > 12 and sorted((o, k), key=len)[1].startswith(sorted((o, k), key=len)[0][:35]))
        if k and not any(alike(o) for _, src, o in kept if src == s):
            kept.append((d, s, k))
    got = sorted((r.doc_id, r.source) for r in registry.queries()["title_dedup"](spark, sf).collect())
    assert got == sorted((d, s) for d, s, _ in kept)
