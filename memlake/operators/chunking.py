"""Texts into chunks by kind: paragraphs, then sentences, then lines; code by its blocks; traces whole; large outputs masked."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters that a chunk should have, and from which on an output is masked to its first and last lines.
TARGET, LARGE, HEAD, TAIL = 2000, 4000, 5, 3
#: Fewest characters of a text by kind, and of others.
LEAST = {"user_message": 15, "assistant_text": 80, "ai_code": 30, "stack_trace": 0, "file_read": 50, "build_log": 50, "dir_listing": 50, "git_diff": 50, "config": 30}
LEAST_OF_OTHERS = 50
#: Kinds that are never split, that are split as code, and that are masked.
WHOLE, CODE, OUTPUTS = ("stack_trace",), ("ai_code",), ("file_read", "build_log", "dir_listing")
#: A fenced block with its language, the end of a sentence; lines of a chunk that the next one begins with.
BLOCK, SENTENCE, OVERLAP = re.compile(r"```(\w+)?\n(.*?)```", re.DOTALL), re.compile(r"(?<=[.!?])\s+"), 2


def filled(pieces: Iterable[str], joint: str, target: int = TARGET, overlap: int = 0) -> Iterator[str]:
    """The pieces, joined, in runs of at most `target` characters (a joint counted with each piece); a longer piece is a run of its own.
    A run of more than `overlap` pieces leaves its last ones to the next."""
    held: list[str] = []
    size = 0
    for piece in pieces:
        if held and size + len(piece) + len(joint) > target:
            yield joint.join(held)
            held = held[-overlap:] if 0 < overlap < len(held) else []
            size = sum(len(p) + len(joint) for p in held)
        held.append(piece)
        size += len(piece) + len(joint)
    if held:
        yield joint.join(held)


def by_lines(text: str, target: int = TARGET) -> Iterator[str]:
    return filled(text.split("\n"), "\n", target, OVERLAP)


def by_sentences(text: str, target: int = TARGET) -> Iterator[str]:
    """Runs of sentences; of lines where there is one sentence only."""
    sentences = SENTENCE.split(text)
    return filled(sentences, " ", target) if len(sentences) > 1 else by_lines(text, target)


def by_paragraphs(text: str, target: int = TARGET) -> Iterator[str]:
    """The text if it is short; else runs of paragraphs, of which long ones are split at sentences."""
    if len(text) <= target:
        yield text
        return
    run: list[str] = []
    for paragraph in text.split("\n\n"):
        if len(paragraph) + 2 <= target:
            run.append(paragraph)
            continue
        yield from filled(run, "\n\n", target)
        run = []
        yield from by_sentences(paragraph, target)
    yield from filled(run, "\n\n", target)


def masked(text: str) -> str:
    """The first and the last lines, and how many were left out between."""
    lines = text.split("\n")
    return "\n".join([*lines[:HEAD], "", f"[... {max(0, len(lines) - HEAD - TAIL)} lines elided ...]", "", *lines[-TAIL:]])


def chunks_of(text: str, kind: str | None) -> list[tuple[str, str | None, str | None, bool]]:
    """(content, kind, language, masked) of a text's chunks."""
    if len(text.strip()) < LEAST.get(kind, LEAST_OF_OTHERS):
        return []
    if kind in WHOLE:
        return [(text, kind, None, False)]
    if kind in CODE:
        made = [(part, kind, m[1] or "unknown", False) for m in BLOCK.finditer(text) for part in by_lines(m[2].strip())]
        around = BLOCK.sub("", text).strip()
        made += [(around, "assistant_text", None, False)] if around else []
        return made or [(text, kind, None, False)]
    if kind in OUTPUTS and len(text) > LARGE:
        return [(masked(text), kind, None, True)]
    return [(part, kind, None, False) for part in by_paragraphs(text)]


def chunked(df: DataFrame, key: str, text: str, kind: str) -> DataFrame:
    """key, chunk (int, from 0), content, kind, language, masked: what the texts are stored as.

    A text below the least length of its kind has no chunks, nor has a null or
    blank one, but for kinds without such a length; a null kind is one of the
    others. Each row is chunked by itself.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                rows = [(k, n, *c) for k, (t, kind) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)) if t is not None for n, c in enumerate(chunks_of(t, kind))]
                own, number, content, kinds, language, cut = zip(*rows, strict=True) if rows else ((),) * 6
                columns = [batch.column(0).take(pa.array(own, pa.int64())), pa.array(number, pa.int32()), *(pa.array(x, pa.string()) for x in (content, kinds, language)), pa.array(cut, pa.bool_())]
                yield pa.RecordBatch.from_arrays(columns, names=[key, "chunk", "content", "kind", "language", "masked"])

    kind_of_key = df.schema[key].dataType.simpleString()
    return df.select(key, text, F.col(kind)).mapInArrow(run, f"{key} {kind_of_key}, chunk int, content string, kind string, language string, masked boolean")
