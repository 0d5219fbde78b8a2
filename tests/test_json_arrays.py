"""JSON arrays are bounded however many rows there are."""

import json

from conftest import rows

from tabulon.registry import storage


def test_arrays_do_not_grow_with_the_table(spark, tmp_path, monkeypatch):
    folder = "/root/testdata/sf0.1"
    monkeypatch.setattr(storage, "scratch_path", lambda spark, name: f"{tmp_path}/{name}")
    found = storage.scan_json_array(spark, folder)
    lengths = [len(json.loads(p.read_text())) for p in (tmp_path / "orders").rglob("part-*.txt")]
    assert max(lengths) <= 10_000 and sum(lengths) == found.count() == 150_000
    assert rows(found.exceptAll(storage._orders(spark, folder).select(*found.columns))) == []
