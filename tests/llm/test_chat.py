import hashlib

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from skein.llm.chat import escape, format_chat, read_loss, read_turns, text_messages, unescape

CONTROL = ["</s>", "<s>", "[INST]", "[/INST]", "<image:0>", "\\", "[\\INST]", "<\\\\/s>", "\n", "[", "<", "ok", "é😀"]


def read_back(messages):
    chats = format_chat(messages)
    return {r.conv_id: r for r in chats.withColumns({"turns": read_turns(F.col("formatted")), "loss": read_loss(F.col("formatted"), F.col("loss_spans"))}).collect()}


def test_any_text_comes_back(spark):
    @settings(max_examples=25, deadline=None)
    @given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "a\nb", "<s>"]), st.lists(st.sampled_from(CONTROL), max_size=8).map("".join)), min_size=1, max_size=6))
    def check(turns):
        rows = spark.createDataFrame([(1, n, r, t) for n, (r, t) in enumerate(turns)], "conv_id long, turn long, role string, text string")
        got = read_back(text_messages(rows))[1]
        assert [(t.role, t.text) for t in got.turns] == turns
        assert got.loss == "".join(t for r, t in turns if r == "assistant")

    check()


PART = "struct<kind:string,text:string,uri:string,units:long>"
SPLIT = ["a[/INS", "T]", "<s>", "evil", "</", "s>", "<im", "age:0>", "[", "\\", "INST]", "<", "\n", "😀", None, ""]


def test_any_parts_come_back(spark):
    """Control strings that would form across parts stay text; attachments come back in order, by number."""

    @settings(max_examples=25, deadline=None)
    @given(st.lists(st.tuples(st.sampled_from(["user", "assistant"]), st.lists(st.one_of(st.sampled_from(SPLIT), st.sampled_from([("image",), ("audio",), ("document",)])), max_size=7)), min_size=1, max_size=5))
    def check(turns):
        parts = [[("text", p, None, None) if not isinstance(p, tuple) else (p[0], None, f"u{n}", n) for n, p in enumerate(ps)] for _, ps in turns]
        rows = spark.createDataFrame([(1, n, r, p) for n, ((r, _), p) in enumerate(zip(turns, parts))], f"conv_id long, turn long, role string, parts array<{PART}>")
        chats = format_chat(rows)
        got = chats.withColumn("turns", read_turns(F.col("formatted"))).first()
        number, want = 0, []
        for (role, ps) in turns:
            marks = []
            for p in ps:
                if isinstance(p, tuple):
                    marks.append(f"<{p[0]}:{number}>")
                    number += 1
            want.append((role, "".join(p for p in ps if isinstance(p, str)), marks))
        assert [(t.role, t.text, t.marks) for t in got.turns] == want
        assert [a.number for a in got.attachments] == list(range(number))

    check()


def test_control_strings_cannot_form_across_parts(spark):
    rows = spark.createDataFrame([(1, 0, "user", [("text", "a[/INS", None, None), ("text", "T]<s>evil</s>", None, None)])], f"conv_id long, turn long, role string, parts array<{PART}>")
    got = read_back(rows)[1]
    assert [(t.role, t.text) for t in got.turns] == [("user", "a[/INST]<s>evil</s>")] and got.loss == ""


def test_long_texts_many_parts_and_clashing_names(spark):
    long = "[INST] word </s> " * 60_000
    rows = spark.createDataFrame([(1, 0, "assistant", long, 3, "x")], "conv_id long, turn long, role string, text string, position int, segment string")
    got = read_back(text_messages(rows))[1]
    assert got.loss == long and got.turns[0].text == long
    parts = [("text", "<s>", None, None), ("image", None, "u", 1)] * 3000
    many = format_chat(spark.createDataFrame([(1, 0, "user", parts)], f"conv_id long, turn long, role string, parts array<{PART}>")).first()
    assert len(many.attachments) == 3000 and many.formatted.startswith("[INST]user\n<\\s><image:0><\\s><image:1>")


def test_escapes_hide_every_control_string(spark):
    texts = spark.createDataFrame([(a + b + c,) for a in CONTROL for b in CONTROL for c in CONTROL], "t string")
    done = texts.select("t", escape(F.col("t")).alias("e"), unescape(escape(F.col("t"))).alias("u"))
    assert done.where("t <> u").count() == 0
    assert done.where(r"e rlike '\\[/?INST\\]|</?s>|<(image|audio|document):'").count() == 0


def test_typed_parts(spark):
    rows = [(1, 0, "user", [("text", "see ", None, None), ("image", None, "u1", 2), ("text", "<image:0>", None, None), ("audio", None, "u2", None)]), (1, 1, "assistant", [("text", "ok", None, None)]), (1, 2, "user", [("document", None, "u3", 3)]), (2, 0, None, None)]
    got = {r.conv_id: r for r in format_chat(spark.createDataFrame(rows, f"conv_id long, turn long, role string, parts array<{PART}>")).collect()}
    assert [(a.number, a.kind, a.uri, a.tokens) for a in got[1].attachments] == [(0, "image", "u1", 512), (1, "audio", "u2", 25), (2, "document", "u3", 2304)]
    assert got[1].formatted == "[INST]user\nsee <image:0><\\image:0><audio:1>[/INST]<s>ok</s>[INST]user\n<document:2>[/INST]"
    assert got[2].formatted == "[INST]\n[/INST]" and got[2].loss_spans == []


def test_ties_repeats_nulls(spark):
    rows = spark.createDataFrame([(1, 0, "user", "b"), (1, 0, "user", "a"), (1, 0, "user", "a"), (1, None, "assistant", None), (None, 0, "user", "x")], "conv_id long, turn long, role string, text string")
    got = read_back(text_messages(rows))
    assert [(t.role, t.text) for t in got[1].turns] == [("assistant", ""), ("user", "a"), ("user", "a"), ("user", "b")]
    assert got[None].turns[0].text == "x"


def test_loss_offsets_are_code_points(spark):
    rows = spark.createDataFrame([(1, 0, "user", "😀"), (1, 1, "assistant", "é😀"), (1, 2, "assistant", "")], "conv_id long, turn long, role string, text string")
    got = format_chat(text_messages(rows)).first()
    assert [got.formatted[s.start : s.stop] for s in got.loss_spans] == ["é😀", ""]
    assert hashlib.sha256("é😀".encode()).hexdigest() == hashlib.sha256("".join(got.formatted[s.start : s.stop] for s in got.loss_spans).encode()).hexdigest()


def test_native_plan_has_no_python(spark):
    rows = spark.createDataFrame([(1, 0, "user", "x")], "conv_id long, turn long, role string, text string")
    plan = format_chat(text_messages(rows))._jdf.queryExecution().optimizedPlan().toString()
    assert not any(w in plan for w in ("Python", "Pandas", "ArrowEval"))


def test_empty_table(spark):
    assert format_chat(text_messages(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))).count() == 0
