"""Chat formatting against a fold of whole conversations in plain Python."""

import hashlib
import random
from itertools import groupby

import pytest

from gapspark.llm import chat_format as cf

LOG = "conv_id long, seq long, kind string, message long, role string, text string"


def plain_fold(events):
    """Apply the events one after the other to a list of messages per conversation."""
    out = {}
    for conv, own in groupby(sorted(events, key=lambda e: (str(e[0]), e[1])), key=lambda e: e[0]):
        messages, roles = {}, {}
        for _, _, kind, message, role, text in own:
            if role is not None:
                roles[message] = role
            if kind in ("edit", "regenerate"):
                messages = {m: t for m, t in messages.items() if m < message}
            messages[message] = messages.get(message, "") + (text or "")
        out[conv] = [(roles.get(m, ""), t) for m, t in sorted(messages.items())]
    return {c: m for c, m in out.items() if m}


def random_log(seed, conversations=30):
    rng = random.Random(seed)
    words = ["hi", " there", "</s>", "\\", "<|end|>", "[INST]", "", "é\n", "<\\s>", None]
    events = []
    for conv in range(conversations):
        for seq in range(rng.randint(1, 25)):
            kind = rng.choice(["message", "delta", "delta", "delta", "edit", "regenerate"])
            role = rng.choice(["user", "assistant", "sys<|end|>tem"]) if kind == "message" else None
            events.append((conv if conv else None, seq, kind, rng.randint(0, 5), role, rng.choice(words)))
    return events


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_fold_equals_applying_the_events_in_turn(spark, seed):
    events = random_log(seed)
    df = spark.createDataFrame(random.Random(seed).sample(events, len(events)), LOG)
    got = {}
    for r in cf.fold(df.repartition(3)).collect():
        got.setdefault(r.conv_id, []).append((r.turn, r.role, r.text))
    want = {c: [(i, *m) for i, m in enumerate(ms)] for c, ms in plain_fold(events).items()}
    assert {c: sorted(ms) for c, ms in got.items()} == want


def test_formatted_log_reads_back(spark):
    events = random_log(7)
    rows = cf.digests(cf.format_log(spark.createDataFrame(events, LOG))).collect()
    want = plain_fold(events)
    assert {r.conv_id for r in rows} == set(want)
    for r in rows:
        turns = want[r.conv_id]
        said = "".join(t for role, t in turns if role == "assistant")
        whole = "".join(f"{role}\n{t}\n" for role, t in turns)
        assert (r.n_turns, r.turns_sha256) == (len(turns), hashlib.sha256(whole.encode()).hexdigest())
        assert (r.loss_chars, r.loss_sha256) == (len(said), hashlib.sha256(said.encode()).hexdigest())
        assert r.formatted_chars >= len(whole)


def test_escapes_are_reversible_and_hide_every_mark(spark):
    t = cf.TEMPLATE
    texts = ["", "\\", "\\\\<s>", "<\\s>", "<<s>", "<s></s>[INST] x [/INST]<<SYS>><</SYS>>", "<|start|><|message|><|end|>", "a\n" * 5, "é<|im_end|>\U0001f600"]
    df = spark.createDataFrame([(x,) for x in texts], "text string")
    for text, escaped in df.select("text", t.escape(df.text)).collect():
        assert t.unescape(escaped) == text
        assert not any(mark in escaped for mark in t.strings())


def test_stored_turns_arrive_in_pieces(spark):
    long = "".join(chr(97 + i % 26) for i in range(3456)) + "\U0001f600"
    rows = [(1, 0, "user", long), (1, 0, "user", long), (1, 1, "assistant", None), (2, None, None, "x"), (2, 3, "user", ""), (None, 0, "user", "y")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    events = cf.turn_events(df, piece=100)
    assert events.where("kind = 'delta'").count() == 2 * 34
    got = sorted((tuple(r) for r in cf.fold(events).collect()), key=str)
    want = [(1, 0, "user", long), (1, 1, "user", long), (1, 2, "assistant", ""), (2, 0, "", "x"), (2, 1, "user", ""), (None, 0, "user", "y")]
    assert got == sorted(want, key=str)


def test_extra_columns_and_empty_log(spark):
    df = spark.createDataFrame([(1, 0, "user", "x", "a", 3)], "conv_id long, turn long, role string, text string, message string, seq int")
    assert cf.digests(cf.format_log(cf.turn_events(df))).count() == 1
    assert cf.digests(cf.format_log(cf.turn_events(df.limit(0)))).collect() == []


def test_a_broken_segment_is_an_error(spark):
    segments = cf.render(cf.fold(cf.turn_events(spark.createDataFrame([(1, 0, "user", "x")], "conv_id long, turn long, role string, text string"))))
    broken = segments.selectExpr("conv_id", "turn", "replace(segment, '|end|', '|END|') AS segment", "loss_start", "loss_end")
    with pytest.raises(Exception, match="does not parse"):
        cf.digests(broken).collect()
