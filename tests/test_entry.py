import subprocess
import sys

import duckdb
import pytest

from weftline import registry

SF = "/root/testdata/sf0.001"
HERE = __file__.rsplit("/tests/", 1)[0]


@pytest.mark.parametrize("name", ["motif_m3_count", "motif_m3_decay_weight", "join_threshold", "join_sim_l2", "agg_keep_rows_median", "bucket_sliding", "clustering_coeff", "wcc", "pagerank_10", "snapshot_growth", "tmds_batch", "betweenness", "personal_pagerank", "core_periphery", "top_cascades", "join_threshold_per_key", "pajek_roundtrip", "connections_text", "splice_by_group", "pagerank_per_week", "static_feedforward", "weighted_closeness", "join_haversine", "update_last_match"])
def test_queries_match_their_sql(spark, name):
    c = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents pages".split():
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    d = c.execute(registry.oracle_sql()[name])
    names = sorted(x[0] for x in d.description)
    at = [[x[0] for x in d.description].index(n) for n in names]
    want = sorted(tuple(str(r[i]) for i in at) for r in d.fetchall())
    got = registry.queries()[name](spark, SF)
    assert names == sorted(got.columns)
    assert sorted(tuple(map(str, r)) for r in got.select(*names).collect()) == want


def test_entry_imports_without_the_corpus_operators(tmp_path):
    code = f"import sys; sys.path.insert(0, {HERE!r})\nfor m in ('corpus_pipeline', 'weftline.llm'): sys.modules[m] = None\nimport __spark_entry__ as e; assert 'motif_m3_count' in e.queries() and not [q for q in e.queries() if q[:2] == 'op']"
    # A module that is None raises an import error that names it, as a missing one does.
    assert subprocess.run([sys.executable, "-c", code], capture_output=True, cwd=tmp_path).returncode == 0
