"""Page fixtures: every list of a file, in one reading."""

import json

from pagewarden import sources


def test_files_are_read_once(spark, tmp_path):
    box = {"x": 1, "y": 2, "width": 3, "height": 4}
    page = {"viewport": {"width": 400, "height": 300}, "links": [{"label": "a", "bbox": box}, {"bbox": None}], "frames": [box, None], "buttons": None}
    (tmp_path / "7.json").write_text(json.dumps(page))
    (tmp_path / "8.json").write_text("{}")
    df = sources.read_fixtures(spark, str(tmp_path))
    assert df._jdf.queryExecution().optimizedPlan().toString().count("Relation [") == 1
    rows = sorted((tuple(r) for r in df.collect()), key=repr)
    assert rows == sorted([("7", "link", 0, "a", 1.0, 2.0, 3.0, 4.0, 400.0, 300.0), ("7", "link", 1, None, None, None, None, None, 400.0, 300.0), ("7", "frame", 0, None, 1.0, 2.0, 3.0, 4.0, 400.0, 300.0), ("7", "frame", 1, None, None, None, None, None, 400.0, 300.0)], key=repr)
