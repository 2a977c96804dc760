import json

import pytest

from test_operators import BODIES, call

from tallyard.operators import compaction, concatenation


def test_calls_are_written_once_as_their_own_objects(spark):
    spaced = '{ "request_model" : "m",\n "response": {"id": "s", "x": "{ é"} }'
    bodies = [b for b, _ in BODIES.values()] + [call("m", "12"), f"[{call('m', '12')}, {spaced}]", spaced + " tail", '{"outer": [' + call("n", "1") + "," + call("n", "2") + "]}", None, '{"request_model": "m", "resp']
    records, _ = compaction.compact(spark.createDataFrame([(b,) for b in bodies], "body string").repartition(4))
    got, path = compaction.write_calls(records, target_bytes=1 << 20)
    rows = got.collect()
    want = {c for _, cs in BODIES.values() for c in cs} | {("m", "12"), ("m", "s"), ("n", "1"), ("n", "2")}
    assert len(rows) == len(want) and {(r[0], r[1]) for r in rows} == want
    for r in rows:
        o = json.loads(r["call"])
        assert (o["request_model"], o["response"]["id"]) == (r[0], r[1])
    assert next(r["call"] for r in rows if r[1] == "s") == spaced
    assert spark.read.option("lineSep", compaction.SEPARATOR).text(path).count() == len(want)


def test_objects_have_the_keys_of_calls_in():
    for body, _ in BODIES.values():
        assert sorted((m, i) for m, i, _ in compaction.call_objects(body)) == sorted(compaction.calls_in(body))


def test_every_record_leads_back_to_its_file(spark):
    rows = [("a\x1fb", "x\x1ey"), ("c", ""), ("d", None), (None, "\ufeffz"), ("e", "x\x1ey"), ("f\x1b", "\x1bE\x1f")]
    df = spark.createDataFrame(rows, "file string, body string").repartition(3)
    for target in (1 << 20, 1):  # one file, and more files than tasks
        records, _ = compaction.compact(df, name="file", target_bytes=target)
        got = sorted((r["name"], r["payload"]) for r in records.collect())
        assert got == sorted([("a\x1fb", "x\x1ey"), ("c", ""), ("", "z"), ("e", "x\x1ey"), ("f\x1b", "\x1bE\x1f")])


def test_files_of_lines_are_joined_byte_for_byte(spark, tmp_path):
    (tmp_path / "in").mkdir()
    parts = [b'{"a": 1}\n', b'{"b": 2}', b"", b"\xef\xbb\xbfx\ny\n", b"long " * 400]
    for i, p in enumerate(parts):
        (tmp_path / f"in/f{i}.jsonl").write_bytes(p)
    rows = concatenation.concatenate(spark, f"file://{tmp_path}/in", f"file://{tmp_path}/out", target_bytes=1000).collect()
    assert len(rows) == 4  # the empty file has no bytes to find again
    files = {p.name: p.read_bytes() for p in (tmp_path / "out").iterdir() if not p.name.startswith(".")}
    assert b"".join(files[k] for k in sorted(files)) == b'{"a": 1}\n{"b": 2}\nx\ny\n' + b"long " * 400 + b"\n"
    for r in rows:
        whole = parts[int(r["path"][-7])].removeprefix(b"\xef\xbb\xbf")
        assert files[r["container"]][r["first_byte"] : r["first_byte"] + r["n_bytes"]].rstrip(b"\n") == whole.rstrip(b"\n")


def test_frames_are_joined_whole(spark, tmp_path):
    import zstandard

    (tmp_path / "in").mkdir()
    texts = [b"one " * 5000, b"", b"three", bytes(range(256)) * 2000]
    for i, t in enumerate(texts):
        c = zstandard.ZstdCompressor(level=3, write_checksum=i % 2 == 0, write_content_size=i != 2)
        frame = c.compress(t) if i != 2 else c.compress(t[:2]) + c.compress(t[2:])
        assert concatenation.frames_end(frame) == len(frame) and concatenation.frames_end(frame[:-1]) < len(frame) - 1
        (tmp_path / f"in/f{i}.zst").write_bytes(frame)
    concatenation.concatenate(spark, f"file://{tmp_path}/in", f"file://{tmp_path}/out", "zstd")
    (joined,) = [p for p in (tmp_path / "out").iterdir() if not p.name.startswith(".")]
    with joined.open("rb") as h:
        assert zstandard.ZstdDecompressor().stream_reader(h, read_across_frames=True).read() == b"".join(texts)
    (tmp_path / "in/f9.zst").write_bytes(b"\x28\xb5\x2f\xfd\x04")
    with pytest.raises(Exception, match="inside a frame"):
        concatenation.concatenate(spark, f"file://{tmp_path}/in", f"file://{tmp_path}/out2", "zstd")
