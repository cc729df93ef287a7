"""Write events from the payload to the answer, and what is read by a head, on fixtures of each tool and gate."""

import json

import pytest
from pyspark.sql import functions as F

from marginalia.operators import audit, hook
from marginalia.sources import payloads
from marginalia.sources import scan as S

GO = """package b

func Close() {
\t// fmt.Println(one)
\twork()
\t// fmt.Println(two)
\twork()
\t// fmt.Println(three)
\twork()
\t// fmt.Println(four)
\twork()
}
"""
FILES = {"/w/a/b.go": GO, "/w/c.py": "# x = compute(1)\ny = 2\n", "/w/notes.md": "# x = compute(1)\n", "/w/plain.go": "package b\n"}


def event(tool, path, cwd="/w", session="s", **given):
    return {"session_id": session, "tool_name": tool, "cwd": cwd, "tool_input": {"file_path": path, **given}}


def run(spark, events, memory=(), rules=None):
    raw = [(i, e if isinstance(e, str) else json.dumps(e)) for i, e in enumerate(events)]
    parsed = payloads.payloads(spark.createDataFrame(raw, "write long, value string"), keep=("write",))
    files = spark.createDataFrame([(p, bytearray(t.encode())) for p, t in FILES.items()], "path string, content binary")
    said = spark.createDataFrame(list(memory), "session string, path string, key decimal(20,0)")
    found = hook.review(payloads.writes(parsed), files, said)
    answer = {r.write: json.loads(r.answer) for r in hook.answers(found, said, rules).collect()}
    lines = {}
    for r in found.orderBy("write", "rank").collect():
        lines.setdefault(r.write, []).append(r.line)
    return found, lines, answer


def test_each_tool(spark):
    two = "\t// fmt.Println(two)\n\twork()"
    events = [
        event("Write", "/w/a/b.go", content="not read"),
        event("Edit", "/w/a/b.go", old_string="", new_string=two),
        event("Edit", "/w/a/b.go", old_string="\twork()\n" + two, new_string="\twork()\n" + two),  # changes nothing
        event("Edit", "/w/a/b.go", old_string=two, new_string=""),  # a deletion
        event("MultiEdit", "/w/a/b.go", edits=[{"old_string": "x", "new_string": "// fmt.Println(four)"}, {"old_string": "", "new_string": "// fmt.Println(one)"}]),
        event("Edit", "/w/a/b.go", old_string="", new_string="nowhere in the file"),
        event("Read", "/w/a/b.go"), event("Write", "/w/notes.md"), event("Write", "/w/missing.go"), event("Write", "/w/plain.go"), event("Write", None), "{no json", "null",
        event("Write", "/w/c.py", cwd=""),
        {"tool_name": "Write", "tool_input": {"file_path": "/w/c.py"}},
    ]
    _, lines, answer = run(spark, events)
    assert lines == {0: [4, 6, 8], 1: [6], 4: [4, 10], 13: [1], 14: [1]}
    assert set(answer) == set(lines)
    out = answer[0]["hookSpecificOutput"]
    assert out["hookEventName"] == "PostToolUse" and out["additionalContext"].startswith("Look at a/b.go again") and out["additionalContext"].count("  line ") == 3
    assert answer[0]["systemMessage"] == "3 comments in a/b.go to look at again" and answer[13]["systemMessage"] == "1 comment in c.py to look at again"


def test_a_session_is_told_once(spark):
    first, lines, _ = run(spark, [event("Write", "/w/a/b.go")])
    memory = [tuple(r) for r in hook.remembered(first).collect()]
    assert len(memory) == 3
    rules = spark.createDataFrame([("/w", "AGENTS.md")], "cwd string, name string")
    events = [event("Write", "/w/a/b.go"), event("Write", "/w/a/b.go", session="other"), event("Write", "/w/c.py")]
    _, lines, answer = run(spark, events, memory, rules)
    assert lines == {0: [10], 1: [4, 6, 8], 2: [1]}
    said = {k: a["hookSpecificOutput"]["additionalContext"] for k, a in answer.items()}
    assert "As said earlier" in said[0] and "As said earlier" in said[2]
    assert said[1].endswith("See AGENTS.md.") and "AGENTS.md" not in said[0]


VECTORS = {"history": [1.0, 0.0], "echoing": [0.0, 1.0], "both": [0.9, 0.9], "plain": [0.0, 0.0]}
JUDGED = """package b

// The history of it. Plain words. More plain words. A history again.
var a = 1

// Plain. Plain words here. Plain once more. The history of it.
var c = 1

// Copyright history of someone
var d = 1

// echoing total count
var totalCount = 1

// echoing other words
var e = 1

func f() {
\t// history
\tg()
}
"""


@pytest.fixture
def made(spark):
    files = spark.createDataFrame([("j.go", "go", bytearray(JUDGED.encode()))], "path string, language string, content binary")
    return audit.comments(S.scan(files))


def embedded(rows):
    word = F.when(F.lower("sentence").contains("history"), "history").when(F.lower("sentence").contains("echoing"), "echoing").otherwise("plain")
    pick = F.when(word == "history", F.array(F.lit(1.0), F.lit(0.0))).when(word == "echoing", F.array(F.lit(0.0), F.lit(1.0))).otherwise(F.array(F.lit(0.0), F.lit(0.0)))
    return rows.withColumn("embedding", pick)


def test_a_head_reads_the_first_three_sentences(spark, made):
    head = spark.createDataFrame([(1, "compat", [1.0, 0.0], 0.5), (2, "tautology", [0.0, 1.0], 0.5), (3, "silent", [1.0, 1.0], None)], "class int, name string, direction array<double>, threshold double")
    got = {r.line: (r["class"], round(r.score, 6)) for r in audit.judge(made, head, embedded).collect()}
    # 0.5 past the threshold, less 0.005 for each further sentence; 0.03 more inside a body. A restatement has to share a word.
    assert got == {3: ("compat", 0.49), 12: ("tautology", 0.5), 19: ("compat", 0.53)}


def test_phrases_are_read_one_sentence_at_a_time(spark):
    text = "package b\n\n// One. Two. Three. Kept for old callers.\nvar a = 1\n\n// It is kept\n// for. Now.\nvar b = 1\n\n// Is kept. For others.\nvar c = 1\n"
    files = spark.createDataFrame([("p.go", "go", bytearray(text.encode()))], "path string, language string, content binary")
    got = {r.line: r["class"] for r in audit.judge(audit.comments(S.scan(files))).collect()}
    assert got == {6: "phrase"}


def test_the_worst_of_a_file_comes_first(spark, tmp_path):
    (tmp_path / "a.go").write_text("package a\n\n// kept for old callers\nvar a = 1\n\n// x := compute(1)\n\nvar b = 1\n")
    found = audit.sweep(spark, str(tmp_path)).collect()
    assert [(r.line, r["class"]) for r in found] == [(6, "leftover"), (3, "phrase")]


def test_the_command_quotes_lines(spark, tmp_path, capsys):
    from marginalia.__main__ import main

    (tmp_path / "a.go").write_text("package a\n\n// x := compute(1)\n\nvar b = 1\n")
    assert main(["-x"]) == 2 and main(["-v", str(tmp_path)]) == 0
    out = capsys.readouterr().out
    assert "// x := compute(1)\n    var b = 1" in out
