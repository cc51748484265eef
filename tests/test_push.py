"""Chunks in the state of a stream."""

import json
import random

from tests.test_parse import random_document
from thicket.streaming.documents import assemble_stream, push_events
from thicket.streaming.push import feed


def merged(events):
    """Events with texts in one piece."""
    out = []
    for e in events:
        if out and e["event"] == "characters" == out[-1]["event"]:
            out[-1] = out[-1] | {"value": out[-1]["value"] + e["value"]}
        else:
            out.append({k: e[k] for k in ("event", "depth", "name", "value")})
    return out


def fed(parts):
    out, state = [], ("", [], "", False)
    for k, part in enumerate(parts):
        events, state = feed(state[0], list(state[1]), state[2] + part, k == len(parts) - 1)
        out += events
        if state[3]:
            break
    return merged(out)


def test_events_do_not_depend_on_chunks():
    r = random.Random(4)
    texts = [random_document(random.Random(k)) for k in range(80)]
    texts += ["<!-- a > b --><!DOCTYPE a [<!ENTITY e 'x>y'><!-- ]> -->]><a>&e;<![CDATA[ <b> ]]>]]&gt;<?p d?></a><!-- z -->", "<a b='é>漢'>漢é\n\nq</a>", "<a><b></a>", "<a>&nope;</a>", "<a", "", "<a/>x"]
    for t in texts:
        whole = fed([t])
        for size in (1, 3, 17):
            assert fed([t[k : k + size] for k in range(0, len(t), size)] or [""])[: len(whole) - 1] == whole[:-1]
        cuts = sorted(r.sample(range(len(t) + 1), min(len(t), 4)))
        parts = [t[a:b] for a, b in zip([0, *cuts], [*cuts, len(t)], strict=True)]
        got = fed(parts)
        if whole and whole[-1]["event"] != "error":
            assert got == whole
        else:
            assert got[-1]["event"] == "error"


def test_what_is_held_back_stays_small():
    state, most = ("", [], "", False), 0
    for k in range(10_000):
        _, state = feed(state[0], list(state[1]), state[2] + ("<r>" if not k else f"<i n='{k}'>text {k}\n</i>"), False)
        most = max(most, len(state[2]))
    assert state[1] == ["<r>", '<i n="9999">'] and most < 40


def write(folder, name, rows):
    (folder / f"{name}.json").write_text("\n".join(json.dumps(dict(zip(("doc_id", "seq", "chunk", "last", "ts"), x, strict=True))) for x in rows))


def test_push_events_of_a_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    day = "2024-01-01T{}:00:00Z"
    source = spark.readStream.schema("doc_id long, seq long, chunk string, last boolean, ts timestamp").json(str(tmp_path / "in"))
    run = lambda df, name: df.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / name)).start()
    queries = [run(push_events(source, "1 hour"), "pushed"), run(assemble_stream(source, "1 hour"), "put_together")]
    many = "<r>" + "".join(f"<i>{k}</i>" for k in range(400)) + "</r>"
    chunks = [(9, k, many[k * 7 : k * 7 + 7], (k + 1) * 7 >= len(many), day.format("00")) for k in range(-(-len(many) // 7))]
    random.Random(1).shuffle(chunks)
    steps = [
        [(1, 0, "<a><b>x", False, day.format("00")), (1, 2, "/b></a>", True, day.format("00")), (2, 0, "<a><c/>", False, day.format("00")), (3, 0, "<a></b>", True, day.format("00"))],
        [(1, 1, "y<", False, day.format("00")), (1, 1, "y<", False, day.format("00"))],
        chunks[: len(chunks) // 2],
        chunks[len(chunks) // 2 :],
        [(4, 0, "<z/>", True, day.format("09"))],
        [(5, 0, "<z/>", True, day.format("10"))],
    ]
    for k, rows in enumerate(steps):
        write(tmp_path / "in", str(k), rows)
        for q in queries:
            q.processAllAvailable()
    for q in queries:
        q.stop()
    by_doc = {}
    for r in sorted(spark.table("pushed").collect(), key=lambda r: (r.doc_id, r.number)):
        by_doc.setdefault(r.doc_id, []).append(r.asDict())
    assert all([e["number"] for e in x] == list(range(len(x))) for x in by_doc.values())
    assert merged(by_doc[1]) == fed(["<a><b>xy</b></a>"]) and merged(by_doc[9]) == fed([many])
    assert [e["event"] for e in by_doc[2]] == ["start_element", "error"] and by_doc[3][-1]["event"] == "error"
    got = {(r.doc_id, r.text, r.complete) for r in spark.table("put_together").collect()}
    assert {(1, "<a><b>xy</b></a>", True), (2, "<a><c/>", False), (9, many, True)} <= got
