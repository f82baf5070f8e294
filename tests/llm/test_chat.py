import hashlib

from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from taskwatch.llm import chat as C
from llm_fixtures import make  # noqa: F401

TURNS = "conv_id long, turn long, role string, text string"


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from([*C.CONTROL, "\\", "-", "\\-", "\n", "<", "|", "[", "x", "é", "n"]), max_size=12).map("".join))
def test_escape_round_trip(text):
    for role in (False, True):
        out = C.escape(text, role)
        assert C.unescape(out) == text and not any(c in out for c in C.CONTROL)
        assert not role or "\n" not in out


def digest(rows):
    rows = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0))
    loss = "".join(t or "" for _, _, r, t in rows if r == "assistant")
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return len(rows), sha("".join(f"{r or ''}\n{t or ''}\n" for _, _, r, t in rows)), len(loss), sha(loss)


def test_turns_read_back_from_the_output(make):
    rows = [(1, k, "assistant" if k % 2 else "user", f"text {k} </s><|end|>\n\\n") for k in range(40)]
    rows += [(2, 0, "user", None), (2, 1, "assistant", ""), (3, 0, None, "no role"), (4, None, "assistant", "no turn"), (4, 5, "assistant", "é\\"),
             (None, 0, "assistant", "no id"), (5, 0, "a\nb<|end|>", "role with control"), (6, 0, "assistant", "z" * 500000)]
    rows += [(7, k, "assistant", f"{k} ") for k in range(3000)]
    got = C.read_back(C.format_turns(C.flatten(make(rows, TURNS).withColumn("parts", C.text_parts(F.col("text"))).withColumn(
        "content", F.lit("clash"))))).collect()
    by = {}
    for r in rows:
        by.setdefault(r[0], []).append(r)
    assert len(got) == len(by)
    for r in got:
        assert (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) == digest(by[r["conv_id"]]), r["conv_id"]


def test_parts_become_placeholders_in_order(spark):
    part = lambda kind, **k: {"kind": kind, "text": None, "ref": None, "width": None, "height": None, "seconds": None,
                              "pages": None, "parts": None} | k
    inner = {k: v for k, v in part("text", text="in <|end|>").items() if k != "parts"}
    parts = [part("text", text="see "), part("image", ref="i.png", width=56, height=29), part("text", text=" and "),
             part("audio", ref="a.wav", seconds=1.01), part("document", ref="d.pdf", pages=2, parts=[inner]), part("hologram", ref="h"), None]
    df = spark.createDataFrame([(1, 0, "user", parts), (1, 1, "assistant", None), (2, 0, "user", [])],
                               f"conv_id long, turn long, role string, parts {C.PARTS}")
    out = {(r["conv_id"], r["turn"]): r for r in C.flatten(df).collect()}
    r = out[1, 0]
    assert r["content"] == "see <|image|> and <|audio|><|document|>in <\\-|end|><|/document|><|other|>"
    assert [(a["number"], a["kind"], a["ref"], a["tokens"]) for a in r["attachments"]] == [
        (0, "image", "i.png", 4), (1, "audio", "a.wav", 26), (2, "document", "d.pdf", 512), (3, "other", "h", 0)]
    assert r["expanded_tokens"] == 542 and out[1, 1]["content"] == "" and out[2, 0]["attachments"] == []
    seg = C.format_turns(C.flatten(df)).where("turn = 0 and conv_id = 1").first()
    assert seg["segment"].startswith("<|turn|>user\nsee ") and seg["loss_from"] == seg["loss_to"]
    assert C.flatten(df.limit(0)).count() == 0 and C.read_back(C.format_turns(C.flatten(df.limit(0)))).count() == 0
