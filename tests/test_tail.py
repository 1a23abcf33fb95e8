"""The tailing source and the dispatch of events by kind."""

import io
import json
import os
import random
import shutil

import pytest

from memlake.streaming import dispatch
from memlake.streaming.tail import complete, lines, tail


def test_parts_have_each_line_once():
    rng = random.Random(1)
    for _ in range(200):
        data = b"".join(rng.choice([b"", b"a", b"bb" * rng.randint(1, 20)]) + b"\n" for _ in range(rng.randint(0, 30))) + rng.choice([b"", b"open"])
        f, size = io.BytesIO(data), len(data)
        at = 0
        got = []
        while (end := complete(f, at, rng.randint(1, 30), size)) > at:
            step = rng.randint(1, 25)
            got += [x for a in range(at, end, step) for x in lines(f, a, min(a + step, end), end, a == at, 30)]
            at = end
        whole = data[: data.rfind(b"\n") + 1].split(b"\n")[:-1]
        assert [None if len(x) > 30 else x for x in whole] == [x for _, _, x in got]
        assert [z - a - 1 for a, z, _ in got] == list(map(len, whole))


def taken(spark, root, checkpoint, out, **options):
    stream = tail(spark, [str(root)], str(checkpoint), "*.jsonl", **options)
    query = stream.writeStream.foreachBatch(lambda b, n: b.write.mode("overwrite").parquet(f"{out}/batch={n}")).option("checkpointLocation", str(checkpoint)).start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    rows = spark.read.option("basePath", str(out)).parquet(str(out))
    return sorted((r["batch"], r["file"].rpartition("/")[2], r["generation"], r["first"], r["kind"], r["raw"]) for r in rows.collect())


@pytest.mark.parametrize("options", [{}, {"batch_bytes": 40, "task_bytes": 7, "record_bytes": 20}])
def test_appends_truncations_and_restarts(spark, tmp_path, options):
    root, checkpoint, out = (tmp_path / x for x in ("logs", "checkpoint", "out"))
    (root / "deep").mkdir(parents=True)
    a, b = root / "a.jsonl", root / "deep" / "b.jsonl"
    a.write_bytes(b'{"n": 1}\n{"n": 2}\n{"n":')
    b.write_bytes(b"\n \n" + b"x" * 50 + b"\n")
    (root / "c.txt").write_bytes(b"no\n")
    long = ("oversized", None) if options else ("line", "x" * 50)
    first = taken(spark, root, checkpoint, out, **options)
    assert [r[1:] for r in first] == sorted([("a.jsonl", 0, 0, "line", '{"n": 1}'), ("a.jsonl", 0, 9, "line", '{"n": 2}'), ("b.jsonl", 0, 3, *long)], key=lambda r: [x for x in first if x[1:] == r])
    with a.open("ab") as f:
        f.write(b' 3}\n{"n": 4}\n')
    again = taken(spark, root, checkpoint, out, **options)
    assert again[: len(first)] == first
    assert [r[1:] for r in again[len(first) :]] == [("a.jsonl", 0, 18, "line", '{"n": 3}'), ("a.jsonl", 0, 27, "line", '{"n": 4}')]
    assert taken(spark, root, checkpoint, out, **options) == again
    a.write_bytes(b'{"n": 5}\n')
    third = [r[1:] for r in taken(spark, root, checkpoint, out, **options)[len(again) :]]
    assert sorted(third, key=repr) == sorted([("a.jsonl", 1, 36, "rewind", None), ("a.jsonl", 1, 0, "line", '{"n": 5}')], key=repr)
    os.remove(b)
    with a.open("ab") as f:
        f.write(b'{"n": 6}\n')
    assert [r[1:] for r in taken(spark, root, checkpoint, out, **options)][-1] == ("a.jsonl", 1, 9, "line", '{"n": 6}')


def event(kind, **fields):
    return json.dumps({"kind": kind, **fields}) + "\n"


def test_dispatch(spark, tmp_path):
    root, checkpoint, out = (str(tmp_path / x) for x in ("queue", "checkpoint", "state"))
    os.makedirs(root)
    with open(f"{root}/1.jsonl", "w") as f:
        f.write(event("store_memory", content="  kept "))
        f.write(event("watcher_chunk", chunk_id="w1", content="one", source_file="s", conversation_id="c", source_end_offset=50, queued_at=1.0))
        f.write(event("watcher_chunk", chunk_id="w2", content="two", source_file="s", conversation_id="c", source_end_offset=150, queued_at=1.0))
        f.write(event("watcher_chunk", chunk_id="w3", content="three", source_file="s", conversation_id="d", source_end_offset=150, queued_at=1.0))
        f.write(event("hook_chunk", content="hooked", session_id="0123456789"))
        f.write(event("watcher_chunk", content="no id") + event("store_memory", content=" ") + event("other") + "{broken\n" + event("rewind_archive", source_file="s", old_offset=1, new_offset=2))
    dispatch.run(tail(spark, [root], checkpoint), out, checkpoint)
    got = {r["chunk_id"]: r for r in dispatch.state(spark, out).collect()}
    hashed = next(k for k in got if k.startswith("rt-"))
    assert set(got) == {"w1", "w2", "w3", hashed, next(k for k in got if k.startswith("manual-"))}
    assert hashed.startswith("rt-01234567-") and got[hashed]["conversation_id"] == "0123456789"
    why = sorted(r["why"] for r in dispatch.events_of(spark, out, "rejected").collect())
    assert why == ["bad bounds", "empty content", "no chunk_id", "no event", "unknown kind"]
    with open(f"{root}/2.jsonl", "w") as f:
        f.write(event("rewind_archive", source_file="s", conversation_id="c", old_offset=200, new_offset=100, rewind_detected_at=2.0))
        f.write(event("enrichment_update", chunk_id="w1", content_hash=got["w1"]["content_hash"], summary="fits", importance=7))
        f.write(event("enrichment_update", chunk_id="w3", content_hash="stale", summary="late", importance=7))
        f.write(event("watcher_chunk", chunk_id="w1", content="one", source_file="s", conversation_id="c", source_end_offset=50))
    dispatch.run(tail(spark, [root], checkpoint), out, checkpoint)
    second = {r["chunk_id"]: r for r in dispatch.state(spark, out).collect()}
    assert {k for k, r in second.items() if r["archived"]} == {"w2"}
    assert (second["w1"]["summary"], second["w1"]["seen_count"], second["w3"]["summary"]) == ("fits", 2, None)
    # a batch that is written again changes nothing
    rows = sorted(map(repr, second.values()))
    shutil.copytree(f"{out}/batch=1", f"{tmp_path}/copy")
    dispatch.put(spark.read.parquet(f"{tmp_path}/copy").drop("route"), 1, out)
    assert sorted(map(repr, dispatch.state(spark, out).collect())) == rows
    # the state from what was written down and what came after
    base = dispatch.compacted(spark, out, f"{tmp_path}/base")
    with open(f"{root}/3.jsonl", "w") as f:
        f.write(event("watcher_chunk", chunk_id="w2", content="two", source_file="s", conversation_id="c", source_end_offset=150))
        f.write(event("watcher_chunk", chunk_id="w1", content="changed", source_file="s", conversation_id="c", source_end_offset=50))
    dispatch.run(tail(spark, [root], checkpoint), out, checkpoint)
    whole = sorted(repr(r[:-2]) for r in dispatch.state(spark, out).collect())
    for n in (0, 1):
        shutil.rmtree(f"{out}/batch={n}")
    rest = sorted(repr(r[:-2]) for r in dispatch.state(spark, out, base).collect())
    assert rest == whole
    third = {r["chunk_id"]: r for r in dispatch.state(spark, out, base).collect()}
    assert not third["w2"]["archived"] and third["w1"]["summary"] is None and third["w1"]["seen_count"] == 3
