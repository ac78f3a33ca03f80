"""The store of replacements: two runs, changed rules, two writers at once."""

import json

from lumenlog import cli
from lumenlog.config import parse_settings
from lumenlog.operators import mapping as M


def settings(folder, keep):
    rule = {"name": "who", "pattern": r"who-(\w+)", "type": "name", "strategy": "mask", "params": {"keep_start": keep, "keep_end": 0}}
    return parse_settings({"inputs": {"paths": [str(folder / "in")]}, "output": {"file": str(folder / "out"), "overwrite": True}, "parser": {"format": "plaintext"}, "sanitizers": {"custom_rules": [rule], "mapping_store": str(folder / "map"), "hmac_key": "k"}})


def written(spark, folder):
    return sorted(json.loads(r.value)["message"] for r in spark.read.text(str(folder / "out")).collect())


def test_values_keep_their_replacement(spark, tmp_path):
    (tmp_path / "in").mkdir()
    log = tmp_path / "in" / "a.log"
    log.write_text("2024-01-15 08:30:45 [INFO] who-alice and who-bob\n")
    cli.run(spark, settings(tmp_path, 1))
    assert written(spark, tmp_path) == ["who-a**** and who-b**"]
    log.write_text("2024-01-15 08:30:45 [INFO] who-alice then who-carol, who-alice and 10.0.0.1\n")
    cli.run(spark, settings(tmp_path, 3))
    assert written(spark, tmp_path) == ["who-a**** then who-car**, who-a**** and 10.0.*.*"]
    rows = M.MappingStore(str(tmp_path / "map"), "k").entries(spark).collect()
    assert len(rows) == 4 and not any("alice" in str(r) for r in rows)


def test_the_first_writer_wins(spark, tmp_path, monkeypatch):
    store = M.MappingStore(str(tmp_path / "map"), "k")
    frame = lambda rows: spark.createDataFrame(rows, M.ENTRY)
    real, once = M.put_manifest, []

    def late(spark, folder, manifest):
        if not once:  # another run puts its entries between our look and our put
            once.append(1)
            M.MappingStore(store.folder, "k").add(frame([("a", "theirs"), ("c", "theirs")]))
        real(spark, folder, manifest)

    monkeypatch.setattr(M, "put_manifest", late)
    got = {r.hmac_key: r.sanitized_value for r in store.add(frame([("a", "ours"), ("b", "ours")])).collect()}
    assert got == {"a": "theirs", "b": "ours", "c": "theirs"} == {r.hmac_key: r.sanitized_value for r in store.entries(spark).collect()}


def test_nothing_is_stored_of_other_strategies(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.log").write_text("2024-01-15 08:30:45 [INFO] password=abc\n")
    cli.run(spark, settings(tmp_path, 1))
    assert M.MappingStore(str(tmp_path / "map"), "k").entries(spark).count() == 0


