import os

import __spark_entry__


def test_every_operator_has_one_query():
    names = __spark_entry__.queries()
    for n in range(1, 11):
        assert len([q for q in names if q.startswith(f"op{n}_")]) == 1
    assert "pipeline" in names
    assert set(__spark_entry__.oracle_sql()) <= set(names)


def test_stages():
    import corpus_pipeline

    assert [s[0].split()[0] for s in corpus_pipeline.STAGES] == ["7", "2", "9", "6", "3"]
    assert os.path.exists(corpus_pipeline.__file__)
