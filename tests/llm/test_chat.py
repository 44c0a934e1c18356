import hashlib

from hypothesis import given, settings
from hypothesis import strategies as st

from gristmill.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string, formatted string, spans int"
HARD = st.text(alphabet="<>[]/\\sINTURP ab\n", max_size=30)


def digest(turns):
    h = hashlib.sha256("".join(f"{r or ''}\n{t or ''}\n" for r, t in turns).encode()).hexdigest()
    loss = "".join(t or "" for r, t in turns if r == "assistant")
    return len(turns), h, len(loss), hashlib.sha256(loss.encode()).hexdigest()


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.one_of(st.sampled_from(["user", "assistant", "system"]), HARD), st.one_of(HARD, st.lists(st.sampled_from(chat.CONTROL)).map("".join))), max_size=6))
def test_escaping_and_reading_back(turns):
    text = chat.render_brackets(turns)
    assert [(r, t) for r, t, _ in chat.parse_brackets(text)] == turns
    (out,) = chat.render_turns(chat.BRACKETS, turns)
    assert out.text == text
    assert [chat.unescape(text[s.text_start : s.text_end]) for s in out.spans] == [t for _, t in turns]
    assert [s.start for s in out.spans[1:]] == [s.end for s in out.spans[:-1]]
    for _, t in turns:
        assert not any(c in chat.escape(t) for c in chat.CONTROL)


def test_whole_conversations(spark):
    turns = {1: [("system", "be good"), ("user", None), ("assistant", "fine [/INST] \\</s>"), (None, "x")], 2: [("assistant", "a" * 50000)], -1: [("user", "</s>[INST] ok [/INST]"), ("assistant", "</s>[INST] ok [/INST]")]}
    turns[3] = [(("user", "assistant")[i % 2], f"turn {i}") for i in range(150)]
    turns[None] = [("user", "nobody's")]
    rows = [(c, i, r, t, "clash", 0) for c, ts in turns.items() for i, (r, t) in enumerate(ts)]
    rows.append((1, 3, None, "x", "clash", 0))
    turns[1].append((None, "x"))
    out = chat.format_conversations(spark.createDataFrame(rows[::-1], SCHEMA), max_turns=16)
    got = {r.conv_id: r for r in chat.digests(out).collect()}
    assert got.keys() == turns.keys()
    for c, ts in turns.items():
        assert (got[c].n_turns, got[c].turns_sha256, got[c].loss_chars, got[c].loss_sha256) == digest(ts)
        assert got[c].formatted_chars == len(chat.render_brackets([(r or "", t or "") for r, t in ts])) and got[c].rewrites == 0
    assert all(s.exact for r in out.collect() for s in r.spans)


def test_empty_table(spark):
    assert chat.digests(chat.format_conversations(spark.createDataFrame([], SCHEMA))).count() == 0


def test_rewritten_history_is_found():
    """A template that shows only the last assistant turn's reasoning."""

    def render(turns, first):
        last = max((i for i, (r, _) in enumerate(turns) if r == "assistant"), default=-1)
        return "".join(f"{r}: {t if i >= last or r == 'user' else t.split('|')[-1]}\n" for i, (r, t) in enumerate(turns))

    out = chat.render_turns(chat.Template(render, lambda t: t), [("user", "q1"), ("assistant", "why|a1"), ("user", "q2"), ("assistant", "hm|a2")])
    assert [(o.rewritten, o.first, len(o.spans)) for o in out] == [(True, 0, 3), (False, 3, 1)]
    assert out[0].text == "user: q1\nassistant: why|a1\nuser: q2\n"
    assert out[1].text[out[1].spans[0].text_start : out[1].spans[0].text_end] == "hm|a2"


def test_template_that_hides_a_text():
    out = chat.render_turns(chat.Template(lambda turns, _: "".join(f"<{r}>" for r, _ in turns), lambda t: t), [("user", "x")])
    assert out[0].spans == [chat.Span(0, 6, -1, -1)]


def test_history_rewritten_after_many_turns(spark):
    """A template that shows only the last 40 turns."""

    def render(turns, first):
        return "".join(f"{r}: {t}\n" for r, t in turns[-40:])

    rows = [(1, i, ("user", "assistant")[i % 2], f"turn {i}") for i in range(70)]
    got = sorted(chat.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), chat.Template(render, lambda t: t)).collect(), key=lambda r: r.part)
    assert [(r.first_turn, len(r.spans), r.rewritten) for r in got] == [(0, 40, True)] + [(i, 1, i < 69) for i in range(40, 70)]
    assert got[-1].formatted == render([r[2:] for r in rows], 0)


def test_turns_that_hold_private_use_characters():
    said = ["\ue000\ue001\ue000", "\ue000\ue001\ue001\ue000", "a\ue000", "\ue001\ue000"]
    turns = [("user" if i % 2 == 0 else "assistant", x) for i, x in enumerate(said * 2)]
    (out,) = chat.render_turns(chat.BRACKETS, turns)
    assert [chat.unescape(out.text[s.text_start : s.text_end]) for s in out.spans] == said * 2
