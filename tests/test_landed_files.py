"""Landed files in partitions of about one size, and files of several answers."""

import json

from offerlens.sources import services


def test_small_files_share_partitions(spark, tmp_path):
    (tmp_path / "area=z1").mkdir()
    for k in range(200):
        (tmp_path / "area=z1" / f"{k}.json").write_text(json.dumps({"places": [{"id": str(k)}]}))
    rows = services.landed(spark, str(tmp_path), "places")
    assert rows.rdd.getNumPartitions() <= 8 and sorted(int(r.place_id) for r in rows.collect()) == list(range(200))
    big = [services.File(str(k), "z", 100 << 20) for k in range(5)]
    assert [len(p.files) for p in services.dealt(big, 1)] == [1] * 5 and services.dealt([], 4) == []


def test_a_file_of_several_answers(spark, tmp_path):
    (tmp_path / "area=z1").mkdir()
    lines = [json.dumps({"places": [{"id": "a"}, {"id": "b"}]}), "{not json", json.dumps({"error": 1}), json.dumps({"places": [{"id": "c\u2028\nd"}]}, ensure_ascii=False)]
    (tmp_path / "area=z1" / "many.txt").write_text("\n".join(lines) + "\n")
    assert sorted(r.place_id for r in services.landed(spark, str(tmp_path), "places").collect()) == ["a", "b", "c\u2028\nd"]
