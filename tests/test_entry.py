import os
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__

SF = "/root/testdata/sf0.001"
here = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
needs_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


def test_registry():
    queries, sql = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(sql) <= set(queries) and len(queries) > 80


def test_rest_stands_without_the_corpus_operators(tmp_path):
    code = "import sys; sys.modules['factloom.llm'] = None; import __spark_entry__ as e; assert not [q for q in e.queries() if q.startswith('op') or q == 'pipeline']; print(len(e.queries()))"
    done = subprocess.run([sys.executable, "-c", code], cwd=here, capture_output=True, text=True)
    assert done.returncode == 0 and int(done.stdout) > 70


@needs_tables
def test_flagship(spark):
    assert __spark_entry__.entry(spark).count() > 0


@needs_tables
@pytest.mark.parametrize("name", ["scan_text_sentences", "match_dictionary", "match_concat", "cand_nullable", "between_ngrams", "head_ngrams", "visual_aligned_lemmas", "feat_textual_window", "feature_keys_drop_upsert", "entity_f1", "pdf_link_exact"])
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "orders", "labels", "lineitem"):
        place = f"{SF}/{t}.parquet"
        con.execute(f"create view {t} as select * from read_parquet('{place}{'/*.parquet' if os.path.isdir(place) else ''}')")
    got, want = __spark_entry__.queries()[name](spark, SF).toPandas(), con.execute(__spark_entry__.oracle_sql()[name]).df()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns and len(got) == len(want) > 0
    flat = lambda df: df[columns].astype(str).replace({"None": "nan"}).sort_values(columns).reset_index(drop=True)
    assert flat(got).equals(flat(want))
