"""Chunks against a plain reading of the rules, and what must hold of every text."""

import random

import pytest

from memlake.operators import chunking


def text(rng, n):
    return "".join(rng.choice(["word ", "A sentence. ", "really?\n", "line\n", "\n\n", "x" * rng.randint(1, 700) + " ", "é! "]) for _ in range(n))


def plain(t, target=2000):
    """Paragraphs are gathered while they fit; a long one ends what was gathered and is gathered by sentences, or lines with two of overlap."""
    if len(t) <= target:
        return [t]
    out, now = [], ""
    for p in t.split("\n\n"):
        if len(p) + 2 > target:
            if now:
                out.append(now[2:])
                now = ""
            parts = chunking.SENTENCE.split(p)
            if len(parts) > 1:
                s = ""
                for x in parts:
                    if s and len(s) + len(x) + 1 > target:
                        out.append(s[1:])
                        s = ""
                    s += " " + x
                out.append(s[1:])
            else:
                lines = p.split("\n")
                first = k = 0
                while k < len(lines):
                    if k > first and sum(len(x) + 1 for x in lines[first : k + 1]) > target:
                        out.append("\n".join(lines[first:k]))
                        first = k - 2 if k - first > 2 else k
                    k += 1
                out.append("\n".join(lines[first:]))
            continue
        if now and len(now) + len(p) + 2 > target:
            out.append(now[2:])
            now = ""
        now += "\n\n" + p
    return out + ([now[2:]] if now else [])


@pytest.mark.parametrize("seed", range(60))
def test_paragraphs(seed):
    rng = random.Random(seed)
    t = text(rng, rng.randint(0, 120))
    assert list(chunking.by_paragraphs(t)) == plain(t)
    long = "\n".join("y" * rng.randint(0, 300) for _ in range(60))
    assert list(chunking.by_paragraphs(long)) == plain(long)


def test_kinds(spark):
    code = "Look:\n```python\n" + "\n".join(f"x{k} = {k}" for k in range(400)) + "\n```\nand\n```\nplain\n```\n"
    log = "\n".join(f"line {k} " + "." * 60 for k in range(100))
    rows = [
        (1, "  short question? ", "user_message"), (2, "too short", "assistant_text"), (3, "", "stack_trace"), (4, "Trace\n" * 2000, "stack_trace"), (5, code, "ai_code"), (6, log, "build_log"), (7, log, "other"),
        (8, None, "stack_trace"), (9, "y" * 60, None), (10, "no fences but long enough for code", "ai_code"), (11, log[:3000], "file_read"), (12, " \n " * 40, "git_diff"), (1, "once more, same id", "user_message"),
    ]
    got = {}
    for r in chunking.chunked(spark.createDataFrame(rows, "id long, t string, k string").repartition(2), "id", "t", "k").collect():
        got.setdefault(r["id"], []).append(tuple(r)[1:])
    assert sorted(got) == [1, 3, 4, 5, 6, 7, 9, 10, 11]
    assert sorted(c[1] for c in got[1]) == ["  short question? ", "once more, same id"]
    assert got[3] == [(0, "", "stack_trace", None, False)] and got[4][0][1] == "Trace\n" * 2000
    kinds = [(c[2], c[3]) for c in sorted(got[5])]
    assert kinds == [("ai_code", "python")] * (len(kinds) - 2) + [("ai_code", "unknown"), ("assistant_text", None)] and len(kinds) > 3
    first, second = (sorted(got[5])[k][1].split("\n") for k in (0, 1))
    assert first[-2:] == second[:2]
    lines = log.split("\n")
    assert got[6] == [(0, "\n".join(lines[:5]) + "\n\n[... 92 lines elided ...]\n\n" + "\n".join(lines[-3:]), "build_log", None, True)]
    assert [c[1] for c in sorted(got[7])] == plain(log) and all(len(c[1]) <= 2000 for c in got[7])
    assert [c[2] for c in got[9]] == [None] and got[10][0][1] == rows[9][1] and not got[11][0][4]
