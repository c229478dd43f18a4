"""Language identification: the sample is whole documents, columns of any name pass, edge cases are defined."""

import numpy as np

from weftline.llm import language


def known(spark, n=120):
    rng = np.random.default_rng(0)
    parts = {"aa": ["kala", "moto", "rine", "sul"], "bb": ["xyz", "wqu", "zzt", "qvr"]}
    rows = [(i, " ".join(rng.choice(parts[k], 40)), k) for i, k in enumerate(["aa", "bb"] * (n // 2))]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


def test_columns_of_any_name_and_edge_cases(spark):
    found = language.learn(known(spark))
    rows = [(1, "kala moto rine sul " * 9, "aa", 1, 2), (2, None, None, 1, 2), (3, "12 34", "x", 1, 2), (None, "xyz wqu zzt " * 60_000, "bb", 1, 2)]
    docs = spark.createDataFrame([*rows, rows[0]], "doc_id long, text string, lang string, `my-col` int, `a b` int")
    kept = language.keep_identified(docs, found)
    assert kept.columns == docs.columns and sorted(str(r[0]) for r in kept.collect()) == ["1", "1", "None"]
    assert language.keep_identified(docs.where("false"), found).count() == 0
    got = {r.doc_id: (r.lang_pred, r.rejected) for r in language.identify(docs, found).collect()}
    assert got[1] == ("aa", False) and got[None] == ("bb", False) and got[2] == got[3] == ("und", True)


def test_whole_documents_are_sampled(spark):
    docs = known(spark).collect()
    found = language.learn(spark.createDataFrame(docs), sample_docs=10)
    texts = {r.text for r in docs}
    assert set(found) == {"aa", "bb"} and all(len(x.split(b"\n")) == 10 and set(x.decode().split("\n")) <= texts for x in found.values())
    # A language of long documents only is learned from its shortest one, whole.
    long = [(1, "kala moto " * 40_000, "cc"), (2, "rine sul " * 30_000, "cc"), (3, "short one", "dd"), (4, None, "ee"), (5, "7", "ff"), (6, "x", None)]
    found = language.learn(spark.createDataFrame(long, "doc_id long, text string, lang string"))
    assert found == {"cc": ("rine sul " * 30_000).encode(), "dd": b"short one"}
