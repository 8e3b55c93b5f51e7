"""The commands end to end on small data."""

import csv
from pathlib import Path

from tidemark.__main__ import main


def test_stream_and_check(spark, tmp_path, capsys):
    messages, store = str(tmp_path / "events"), str(tmp_path / "store")
    main(["produce", "--n", "300", "--users", "15", "--items", "24", "--rate", "1", "--out", messages])
    main(["process", "--messages", messages, "--store", store])
    for entity in ("user", "item"):
        main(["check", "--store", store, "--entity", entity])
    assert capsys.readouterr().out.count("[PASS]") == 2


def test_build_dataset(spark, tmp_path, capsys):
    main(["build-dataset", "--n", "1500", "--users", "20", "--items", "24", "--hours", "24", "--out", str(tmp_path / "t")])
    assert "PASSED" in capsys.readouterr().out
    rows = [r for p in Path(tmp_path / "t").glob("*.csv") for r in csv.DictReader(p.open())]
    assert len(rows) > 100 and {"user_id", "label", "user_category_affinity", "item_popularity_rank_1h"} <= set(rows[0])
    assert all(r["feature_timestamp_used"] < r["label_timestamp"] for r in rows)
