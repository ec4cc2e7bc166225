from __future__ import annotations

import random

import pytest
from cloakframe import sources
from cloakframe.config import Settings
from cloakframe.sources import events as E


def wire(rng, n):
    parts = []
    for i in range(n):
        end = rng.choice([b"\n", b"\r\n"])
        lines = [b"event: delta"] * rng.randint(0, 1) + [b": \xff comment"] * rng.randint(0, 1) + [f"data: {i} ".encode() + b"x" * rng.randint(0, 40)] + [b"data: more"] * rng.randint(0, 1)
        parts.append(b"".join(x + end for x in lines) + end * rng.randint(1, 3))
    return b"".join(parts)


def plain(data):
    """Whole events of some bytes: runs of lines up to an empty one."""
    out, held, at = [], [], 0
    for line in data.split(b"\n")[:-1]:
        at += len(line) + 1
        if line in (b"", b"\r"):
            if held:
                out.append((at, b"\n".join(held) + b"\n" + line + b"\n"))
            held = []
        else:
            held.append(line)
    return out


def lay(folder, data, cuts):
    folder.mkdir(parents=True, exist_ok=True)
    for k, (a, b) in enumerate(zip([0, *cuts], [*cuts, len(data)])):
        (folder / f"part-{k:03d}").write_bytes(data[a:b])


@pytest.mark.parametrize("block", [7, 64, 1 << 20])
def test_any_cut_of_a_stream_gives_each_event_once(tmp_path, monkeypatch, block):
    monkeypatch.setattr(E, "BLOCK", block)
    rng = random.Random(block)
    data = b"\n\n" + wire(rng, 40) + b"data: unfinished"
    lay(tmp_path / "s", data, sorted(rng.sample(range(1, len(data)), 6)))
    stream = E.Bytes(f"file://{tmp_path}", E._listed(f"file://{tmp_path}")["s"])
    for _ in range(12):
        cuts = sorted({0, len(data), *rng.sample(range(1, len(data)), rng.randint(0, 30))})
        got = [e for a, b in zip(cuts, cuts[1:]) for e in E.events(stream, a, b)]
        assert got == plain(data)


def test_fields():
    assert E.fields(b"event: x\r\ndata: a\r\ndata:b\n: c\nid: 1\n\n") == ("x", "a\nb") and E.fields(b"data\n\n") == (None, "")


def test_batch_reads_all_streams(spark, tmp_path):
    E.register(spark)
    rng = random.Random(1)
    datas = {f"s{i}": wire(rng, 30 * i) for i in range(4)}
    for name, data in datas.items():
        lay(tmp_path / "in" / name, data, [len(data) // 3])
    (tmp_path / "in" / "_hidden").mkdir()
    (tmp_path / "in" / "_hidden" / "x").write_bytes(b"data: no\n\n")
    got = spark.read.format("sse").option("path", str(tmp_path / "in")).option("splitBytes", 100).load()
    assert got.rdd.getNumPartitions() > 10
    want = sorted((s, at, *E.fields(e), e) for s, data in datas.items() for at, e in plain(data))
    assert sorted((r.stream_id, r.stop, r.type, r.data, bytes(r.event)) for r in got.collect()) == want
    (tmp_path / "none").mkdir()
    assert spark.read.format("sse").option("path", str(tmp_path / "none")).load().count() == 0


def test_read_stop_and_resume_without_loss(spark, tmp_path):
    """Files grow and come between runs; batches are cut within events; every event arrives once."""
    E.register(spark)
    rng = random.Random(2)
    data = {"a": wire(rng, 60), "b/c": wire(rng, 25)}

    def run():
        rows = spark.readStream.format("sse").option("path", str(tmp_path / "in")).option("splitBytes", 150).option("maxBytesPerBatch", 700).load()
        query = rows.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).start()
        query.processAllAvailable()
        query.stop()
        return sorted((r.stream_id, r.stop, bytes(r.event)) for r in spark.read.parquet(str(tmp_path / "out")).collect())

    half = data["a"][: len(data["a"]) // 2]
    lay(tmp_path / "in" / "a", half, [100, 333])
    assert run() == [("a", *e) for e in plain(half)]
    with (tmp_path / "in" / "a" / "part-002").open("ab") as file:
        file.write(data["a"][len(half) : -50])
    (tmp_path / "in" / "a" / "part-003").write_bytes(data["a"][-50:])
    lay(tmp_path / "in" / "b" / "c", data["b/c"], [40])
    assert run() == sorted((s, *e) for s, d in data.items() for e in plain(d))
    assert run() == sorted((s, *e) for s, d in data.items() for e in plain(d))


def test_files_and_messages_as_bodies(spark, tmp_path):
    for name, body in (("a.json", '{"a": 1}'), ("b.txt", "line one\nline two"), ("c.json", "")):
        (tmp_path / name).write_text(body)
    rows = sources.bodies(spark, str(tmp_path), "h.example").collect()
    assert {r.body for r in rows} == {'{"a": 1}', "line one\nline two"} and len({r.msg_id for r in rows}) == 2 and {r.host for r in rows} == {"h.example"}
    messages = spark.createDataFrame([(1, "H.example", None, '{"a":1}'), (2, "h.example", None, "x"), (3, "other", "application/json", "{}"), (4, None, "application/json", None)], "k int, host string, content_type string, body string")
    assert [r.k for r in sources.requests(messages, Settings(hosts=("h.example",))).collect()] == [1]
    back = spark.createDataFrame([(1, "a {{VEIL_x"), (2, "plain"), (3, None)], "k int, body string")
    assert [r.k for r in sources.responses(back, Settings()).collect()] == [1]
