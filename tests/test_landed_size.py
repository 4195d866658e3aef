"""What queries leave in the shared folder."""

import os

from __spark_entry__ import queries
from indicraft.session import scratch_root


def test_landed_alerts_are_smaller_than_their_texts(spark, tmp_path):
    n = 3_000
    rows = [(k, "view" if k % 2 else "click") for k in range(n)] + [(7, "view"), (None, "view")]
    spark.createDataFrame(rows, "event_id long, event_type string").write.parquet(str(tmp_path / "events.parquet"))
    root = f"{scratch_root(spark)}/indicraft"
    before = set(os.listdir(root)) if os.path.isdir(root) else set()
    got = {r["event"]: (r["n"], r["description_chars"], r["n_wi"]) for r in queries()["source_load_alerts"](spark, str(tmp_path)).collect()}
    kinds = {kind: [k for k, e in rows if e == kind and k is not None] for kind in ("view", "click")}
    whole = {kind: (len(ks), sum(5000 + k % 10 for k in ks), sum(k % 3 > 0 for k in ks)) for kind, ks in kinds.items()}
    # an alert without an id has an empty one and no description
    whole["view"] = (whole["view"][0] + 1, *whole["view"][1:])
    assert got == whole
    landed = [os.path.join(d, f) for new in set(os.listdir(root)) - before for d, _, files in os.walk(f"{root}/{new}") for f in files]
    assert landed and sum(map(os.path.getsize, landed)) < n * 5000 / 2
