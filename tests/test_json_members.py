"""Members of JSON objects read by byte ranges against the library's reading of the whole file."""

import json
import random

import pytest

from assayer.sources import json_members
from assayer.sources import readers as R

ODD = ['}', '{', '},', '"', '\\', '\\"', '", "x": {', '}}', ': {', '], "k": {"duration": 1}', "é日本🙂", "\n", "\\\\", "[", "]", ",", "end\\"]


@pytest.fixture
def small_ranges(spark):
    keys = {"spark.sql.files.maxPartitionBytes": "700", "spark.sql.files.openCostInBytes": "1"}
    before = {k: spark.conf.get(k) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def annotations(seed, n):
    rng = random.Random(seed)
    return {f"v{seed}_{i}" + rng.choice(["", '"', "}", "{,"]): {
        "duration": rng.randint(0, 99) / 4, "timestamps": [[k, k + 0.5] for k in range(rng.randint(0, 4))],
        "sentences": ["".join(rng.choices(ODD, k=rng.randint(0, 6))) for _ in range(rng.randint(0, 4))]} for i in range(n)}


def rows(df):
    return sorted((r.video_id, r.duration, json.dumps(r.timestamps), json.dumps(r.sentences)) for r in df.collect())


def wanted(*objects):
    return sorted((k, float(a["duration"]), json.dumps([[float(x) for x in t] for t in a["timestamps"]]), json.dumps(a["sentences"]))
                  for o in objects for k, a in o.items())


@pytest.mark.parametrize("indent,ascii", [(None, True), (None, False), (2, False)])
def test_ranges_give_what_the_whole_gives(spark, tmp_path, small_ranges, indent, ascii):
    objects = [annotations(s, n) for s, n in enumerate((0, 1, 40, 3))]
    for i, o in enumerate(objects):
        (tmp_path / f"{i}.json").write_text(json.dumps(o, indent=indent, ensure_ascii=ascii) + "\n" * (i % 2))
    (tmp_path / "long.json").write_text(json.dumps({"long": {"duration": 1, "timestamps": [], "sentences": ["}, {" * 3000]}}))
    assert json_members._ranges(spark, str(tmp_path)).rdd.getNumPartitions() > 8
    got = R.annotations(spark, str(tmp_path))
    assert rows(got) == wanted(*objects, {"long": {"duration": 1, "timestamps": [], "sentences": ["}, {" * 3000]}})
    faults = R.annotation_faults(spark, str(tmp_path)).groupBy().sum("members", "faults").first()
    assert tuple(faults) == (sum(map(len, objects)) + 1, 0)


def test_broken_tail_is_kept_out(spark, tmp_path, small_ranges):
    whole = json.dumps(annotations(7, 12))
    for cut in [*range(len(whole) - 60, len(whole), 7), len(whole) // 2, 1, 0]:
        place = tmp_path / str(cut)
        place.mkdir()
        (place / "a.json").write_text(whole[:cut])
        complete = {}
        decoder, at = json.JSONDecoder(), 1
        try:  # members one after the other, as far as they go
            while at < cut:
                key, at = decoder.raw_decode(whole[:cut], at)
                value, at = decoder.raw_decode(whole[:cut], at + 2)
                if at < cut:  # what follows a member shows that it is over
                    complete[key] = value
                at += 2
        except (ValueError, IndexError):
            pass
        got = rows(R.annotations(spark, str(place)))
        assert got in (wanted(complete), wanted(complete | ({key: value} if at >= cut else {}))), cut
        faults = R.annotation_faults(spark, str(place)).first()
        assert faults is None or faults.members - faults.faults == len(got)


def test_odd_files(spark, tmp_path):
    assert R.annotations(spark, str(tmp_path / "none")).count() == 0
    (tmp_path / "a").write_text(' {} \n {"x": {"duration": 2, "timestamps": [], "sentences": []}}\n{"y": {"duration": 3}, "z": 5, "w": null}')
    got = R.annotations(spark, str(tmp_path))
    assert sorted((r.video_id, r.duration) for r in got.collect()) == [("x", 2.0), ("y", 3.0)]
    assert tuple(R.annotation_faults(spark, str(tmp_path)).select("members", "faults").first()) == (4, 2)
