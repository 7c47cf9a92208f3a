"""The keyed state store against a dictionary."""

import random

import pytest

from lexispark.sources import kvstore as K


def rows(store):
    return {r.key: r.value for r in store.read().collect()}


def test_puts_deletes_and_puts_again(spark, tmp_path):
    store, want = K.Store(spark, f"{tmp_path}/s"), {}
    assert rows(store) == {} and store.get("a") is None
    rng = random.Random(4)
    keys = [f"{p}{w}" for p in (K.PROGRESS, K.SESSION) for w in ("iliad", "apology", "")] + [K.SETTINGS, "other", "é€"]
    for step in range(14):
        kind = rng.choice("ppppdwxac") if step else "p"
        if kind == "p":
            new = [(rng.choice(keys), rng.choice([None, "", f"v{step}-{i}"]), i) for i in range(6)]
            store.put(spark.createDataFrame([*new, (None, "x", 9)], "key string, value string, place int").repartition(3))
            want |= {k: v for k, v, _ in new}
        elif kind == "d":
            gone = rng.sample(keys, 2)
            store.delete(spark.createDataFrame([(k,) for k in [*gone, None, "never"]], "key string"))
            want = {k: v for k, v in want.items() if k not in gone}
        elif kind == "w":
            store.delete_work(spark.createDataFrame([("iliad",)], "work_id string"))
            want = {k: v for k, v in want.items() if not k.endswith("_iliad")}
        elif kind == "x":
            store.delete_prefixes("o", K.SESSION)
            want = {k: v for k, v in want.items() if not k.startswith(("o", K.SESSION))}
        elif kind == "a":
            store.delete_all()
            want = {k: v for k, v in want.items() if not k.startswith((K.PROGRESS, K.SESSION)) and k != K.SETTINGS}
        else:
            store.compact()
        assert rows(store) == want, (step, kind)
    assert all(store.get(k) == v for k, v in want.items())
    store.compact()
    assert rows(store) == want and len(list((tmp_path / "s").glob("commit=*"))) == 0 and len(list((tmp_path / "s").glob("snapshot=*"))) == 1


def test_half_written_commits_do_not_count(spark, tmp_path):
    store = K.Store(spark, f"{tmp_path}/s")
    store.put(spark.createDataFrame([("a", "1")], "key string, value string"))
    store.put(spark.createDataFrame([("a", "2")], "key string, value string"))
    (tmp_path / "s" / "commit=1" / "_SUCCESS").unlink()
    assert rows(store) == {"a": "1"}
    store.put(spark.createDataFrame([("a", "3")], "key string, value string"))  # takes its place
    assert rows(store) == {"a": "3"}


def test_errors_are_raised_or_told(spark, tmp_path):
    (tmp_path / "file").write_text("no folder")
    store = K.Store(spark, f"{tmp_path}/file/s")
    with pytest.raises(Exception):  # noqa: B017
        store.put(spark.createDataFrame([("a", "1")], "key string, value string"))
    with pytest.warns(UserWarning):
        store.put(spark.createDataFrame([("a", "1")], "key string, value string"), quiet=True)


def test_settings_over_defaults(spark):
    given = ['{"lastWorkId": "iliad"}', '{"pwaInstallPromptDismissed": true, "more": 1}', '{"lastWorkId": null}', "no json", "[1]", "", None, "{}"]
    d = spark.createDataFrame([(i, v) for i, v in enumerate(given)], "i int, value string")
    got = {r.i: dict(r.settings) for r in K.settings(d, {"lastWorkId": None, "pwaInstallPromptDismissed": "false"}).collect()}
    base = {"lastWorkId": None, "pwaInstallPromptDismissed": "false"}
    assert got == {0: base | {"lastWorkId": "iliad"}, 1: base | {"pwaInstallPromptDismissed": "true", "more": "1"}} | {i: base for i in range(2, 8)}
