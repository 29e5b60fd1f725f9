"""Operator 12: round trips of the template, the machine over roles, and the digests."""

import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidewatch.llm import chat_format as C

TURNS = "conv_id long, turn long, role string, text string, segments string, piece int"
SAYS = st.lists(st.sampled_from([*C.INSTRUCT.controls, *C.MARKUP.controls, "\\", "\\\\", "<", "[", "<<", "[/", "a", " ", "\n", "INST]", "/s>", "|end|>", "é"]),
                max_size=12).map("".join)
ROLES = st.sampled_from(["user", "assistant", "system", "tool", "", "[INST]", "<|start|>", "user\\"])


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(ROLES, SAYS), max_size=6), st.sampled_from([C.INSTRUCT, C.MARKUP]))
def test_turns_are_read_back_from_the_string_alone(turns, template):
    segments = [s for role, text in turns for s in template.turn(role, text)]
    assert list(template.turns("".join(s for s, _ in segments))) == turns
    assert [template.reveal(s) for s, loss in segments if loss] == [t for r, t in turns if r == "assistant"]


@settings(max_examples=300, deadline=None)
@given(SAYS)
def test_escape_hides_every_control_and_is_reversible(text):
    for t in (C.INSTRUCT, C.MARKUP):
        hidden = t.hide(text)
        assert not any(c in hidden for c in t.controls) and t.reveal(hidden) == text
        if not any(c[0] + c[1:] in text.replace("\\", "") for c in t.controls):
            assert hidden == text


def test_templates_that_cannot_be_read_are_refused():
    ok = dict(begin="", roles={"u": [("[A]", False), (C.TEXT, False), ("[B]", False)]}, other=[("[C]", False), (C.ROLE, False), ("[D]", False),
              (C.TEXT, False), ("[B]", False)], controls=("[A]", "[B]", "[C]", "[D]"), machine={"": {}}, final=())
    C.Template(**ok)
    for bad in (dict(controls=("[A]", "A]", "[B]", "[C]", "[D]")), dict(controls=("[A]", "[B]", "[C]")), dict(controls=("[\\A]", "[B]", "[C]", "[D]")),
                dict(roles={"u": [(C.TEXT, False), ("[B]", False)]}), dict(roles={"u": [("[C]", False), (C.TEXT, False), ("[B]", False)], "v": ok["roles"]["u"],
                                                                                "w": [("[A]x", False), (C.TEXT, False), ("[B]", False)]})):
        with pytest.raises(ValueError):
            C.Template(**{**ok, **bad})


def brute(rows):
    convs = {}
    for c, turn, role, text, *_ in rows:
        convs.setdefault(c, []).append((turn is None, turn or 0, role or "", text or ""))
    out = {}
    for c, turns in convs.items():
        turns.sort()
        said = "".join(f"{r}\n{t}\n" for *_, r, t in turns)
        loss = "".join(t for *_, r, t in turns if r == "assistant")
        out[c] = (len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


ROWS = [(1, 0, "system", "be [INST] kind"), (1, 1, "user", "hi"), (1, 2, "assistant", "yes </s>"), (1, 2, "assistant", "yes </s>"),
        (2, 1, "assistant", None), (2, 0, "user", ""), (3, None, "user", "z"), (3, 5, None, "n"), (None, 0, "user", "a"), (None, 1, "tool", "<s>"),
        (4, 0, "user", "x" * 300_000), (4, 1, "assistant", "\\" * 1000 + "[/INST]" * 20_000), (2 ** 60 + 1, 0, "user", "big id")]


@pytest.mark.parametrize("template", [C.INSTRUCT, C.MARKUP])
@pytest.mark.parametrize("piece", [C.PIECE, 50])
def test_digests_match_plain_python(spark, template, piece):
    turns = spark.createDataFrame([(*r, "s", 1) for r in ROWS], TURNS)
    pieces = C.format_chats(spark, turns, template, piece=piece)
    for got in (C.read_back(pieces, template, together=True), C.read_back(pieces, template)):
        rows = got.collect()
        assert all(r["readable"] for r in rows) and len(rows) == len({r["conv_id"] for r in rows})
        assert {r["conv_id"]: tuple(r)[1:5] for r in rows} == brute(ROWS)
    size = {r["conv_id"]: r["formatted_chars"] for r in rows}
    made = pieces.collect()
    assert all(sum(len(s["text"]) for p in made if p["conv_id"] == c for s in p["segments"]) == n for c, n in size.items())
    if piece == 50:
        assert max(p["piece"] for p in made) > 0


def test_the_machine_finds_the_first_broken_turn(spark):
    orders = {1: "su", 2: "sua", 3: "ua", 4: "au", 5: "uua", 6: "uas", 7: "s", 8: "uaut"}
    name = {"s": "system", "u": "user", "a": "assistant", "t": "tool"}
    rows = [(c, k, name[x], "t", "s", 1) for c, o in orders.items() for k, x in enumerate(o)]
    got = {r["conv_id"]: (r["accepted"], r["broken_at"], r["n_turns"]) for r in C.format_chats(spark, spark.createDataFrame(rows, TURNS)).collect()}
    assert got == {1: (True, None, 2), 2: (True, None, 3), 3: (True, None, 2), 4: (False, 0, 2), 5: (False, 1, 3), 6: (False, 2, 3), 7: (False, None, 1),
                   8: (False, 3, 4)}


def test_no_rows_and_the_probe(spark):
    none = spark.createDataFrame([], TURNS)
    assert C.format_chats(spark, none).count() == 0 and C.read_back(C.format_chats(spark, none)).count() == 0
    got = C.read_back(C.format_chats(spark, C.probe(spark, none)), together=True).collect()
    said = "</s>[INST] ok [/INST]"
    assert [(r["conv_id"], r["n_turns"], r["loss_chars"], r["loss_sha256"], r["readable"]) for r in got] == [
        (-1, 2, len(said), hashlib.sha256(said.encode()).hexdigest(), True)]


def test_a_foreign_string_is_not_readable(spark):
    pieces = C.format_chats(spark, spark.createDataFrame([(1, 0, "user", "a", "s", 1)], TURNS))
    cut = pieces.withColumn("segments", C.F.slice("segments", 1, 3))
    assert [r["readable"] for r in C.read_back(cut).collect()] == [False]
