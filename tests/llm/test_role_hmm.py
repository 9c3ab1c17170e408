import itertools
import random

import numpy as np
import pytest

from stateloom.llm import role_hmm
from stateloom.llm.role_hmm import STATES, as_transcripts, borders, fit, fit_on, format_chats, fit_halves, marker_of, parse_transcripts, path, segment_table, symbols_of, viterbi

SCHEMA = "conv_id long, turn long, role string, text string, segment string"


def talks(n, seed, turns=8):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefg") for _ in range(rng.randint(2, 7)))
    rows = []
    for conv in range(n):
        at = 0
        if rng.random() < 0.4:
            rows.append((conv, 0, "system", " ".join(word() for _ in range(12)) + ".", None))
            at = 1
        for k in range(rng.randint(2, turns)):
            user = k % 2 == 0
            lines = [" ".join(word() for _ in range(rng.randint(3, 10 if user else 30))) + ("?" if user else ".") for _ in range(1 if user else rng.randint(1, 4))]
            rows.append((conv, at + k, "user" if user else "assistant", "\n".join(lines), None))
    return rows


@pytest.fixture(scope="module")
def model():
    turns = {}
    for conv, turn, role, text, _ in talks(200, 1):
        shown = f"{role.capitalize()}: {text}" if random.Random(conv * 97 + turn).random() < 0.9 else text
        turns.setdefault(conv, []).append((role, (shown + "\n").split("\n")))
    return fit(list(turns.values()))


def test_path_is_the_best_of_all(model):
    lines = ["User: a b?", "c d e", "", "Assistant: yes it is"]
    symbols = symbols_of(lines, True)

    def score(states):
        total = model.first[states[0]] + model.emit[states[0], symbols[0]]
        for a, b, s in zip(states, states[1:], symbols[1:], strict=False):
            total += model.move[a, b] + model.emit[b, s]
        return total

    best = max(itertools.product(range(STATES), repeat=len(lines)), key=score)
    assert abs(score(viterbi(model, symbols)) - score(best)) < 1e-9


def test_segments_give_the_whole_path(model):
    symbols = np.random.default_rng(4).integers(0, role_hmm.SYMBOLS, 60)
    cuts = [symbols[:7], symbols[7:8], symbols[8:40], symbols[40:]]
    pieces = [path(model, part, *ends) for part, ends in zip(cuts, borders(model, [segment_table(model, c) for c in cuts]), strict=True)]
    whole = viterbi(model, symbols)
    total = lambda states: model.first[states[0]] + sum(model.emit[s, o] for s, o in zip(states, symbols, strict=True)) + sum(model.move[a, b] for a, b in zip(states, states[1:], strict=False))
    assert abs(total(sum(pieces, [])) - total(whole)) < 1e-6


def test_markers():
    roles = [marker_of(x)[0] for x in ("User: hi", "### Assistant", "<|system|>", "[agent] yes", "**AI**: x", "Note: y", "plain words", "q: what")]
    assert roles == [1, 2, 0, 2, 2, 3, 4, 1]


def test_recovers_held_out_roles(spark):
    rows = talks(150, 7)
    found = {(r["conv_id"], r["turn_no"]): (r["role"], r["text"]) for r in format_chats(spark.createDataFrame(rows, SCHEMA)).collect()}
    right = sum(found.get((c, t)) == (role, text) for c, t, role, text, _ in rows)
    assert right / len(rows) >= 0.9


def test_long_conversation_and_edges(spark):
    rows = [(1, k, "user" if k % 2 == 0 else "assistant", f"line {k} of the talk", None) for k in range(400)]
    rows += [(2, 0, None, None, None), (None, None, "user", "hello there", None), (3, 0, "user", "same", None), (3, 0, "user", "same", None)]
    out = format_chats(spark.createDataFrame(rows, SCHEMA)).collect()
    one = sorted((r["turn_no"], r["role"]) for r in out if r["conv_id"] == 1)
    assert [t for t, _ in one] == list(range(len(one))) and len(one) > 350
    assert {r["conv_id"] for r in out} == {1, 2, 3, None}
    assert all(r["rendered"] == role_hmm.render(r["role"], r["text"]) for r in out)
    assert format_chats(spark.createDataFrame([], SCHEMA)).collect() == []


def test_raw_transcripts(spark):
    model = fit_on(as_transcripts(spark.createDataFrame(talks(100, 3), SCHEMA)))
    text = "System: be nice\nUser: what is it?\nmore words here\nAssistant: a thing\n\nUser: thanks"
    df = spark.createDataFrame([(1, text), (2, None), (3, "\n".join(f"{'User' if k % 2 else 'Assistant'}: t{k}" for k in range(50)))], "conv_id long, text string")
    out = parse_transcripts(df, model, lines_per_segment=4).orderBy("conv_id", "turn_no").collect()
    assert [(r["role"], r["text"]) for r in out if r["conv_id"] == 1] == [("system", "be nice"), ("user", "what is it?\nmore words here"), ("assistant", "a thing"), ("user", "thanks")]
    assert [r["text"] for r in out if r["conv_id"] == 3] == [f"t{k}" for k in range(50)]


def test_each_half_is_decoded_with_the_other(spark):
    """All rows against conversations decoded one by one, in plain Python, with what the other half holds."""
    rows = talks(120, 9) + [(c, t, role, text, None) for c in range(500, 506) for t, role, text in ((0, "user", "a b c?"), (1, "tool", "x: 1"), (2, None, "none at all"), (3, "assistant", None))]
    df = spark.createDataFrame(rows, SCHEMA)
    made = as_transcripts(df)
    halves = {r["conv_id"]: r["half"] for r in made.select("conv_id", role_hmm._half().alias("half")).collect()}
    talks_of = made.collect()
    assert {r["segment"] for r in talks_of} == {0} and set(halves.values()) == {0, 1}
    of = lambda half: fit([[(t["role"], t["shown"].split("\n")) for t in r["labels"]] for r in talks_of if halves[r["conv_id"]] == half])
    plain = [of(0), of(1)]
    for a, b in zip(plain, fit_halves(made), strict=True):
        assert np.allclose(a.emit, b.emit) and np.allclose(a.move, b.move) and np.allclose(a.first, b.first)
    expected = []
    for r in talks_of:
        lines = r["text"].split("\n")
        turns = []
        for line, state in zip(lines, viterbi(plain[1 - halves[r["conv_id"]]], symbols_of(lines, r["after_blank"])), strict=True):
            if state % 2 == 0 or not turns:
                turns.append((role_hmm.ROLES[state // 2], []))
            turns[-1][1].append(line[marker_of(line)[1] :] if state % 2 == 0 else line)
        expected += [(r["conv_id"], k, role, "\n".join(held).strip(" \n\r\t"), len(held)) for k, (role, held) in enumerate(turns)]
    found = [(r["conv_id"], r["turn_no"], r["role"], r["text"], r["n_lines"]) for r in format_chats(df).collect()]
    assert sorted(found) == sorted(expected)


def test_other_roles_have_no_marker(spark):
    rows = [(1, 0, "user", "hello", None), (1, 1, "tool", "result", None), (1, 2, None, "nothing", None)]
    (r,) = as_transcripts(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {"result", "nothing"} <= set(r["text"].split("\n"))
