"""Line-first cleaning: rules per line, then documents that lose too much text are rejected.

A line fails as punctuation (too many symbols or marks per word), as navigation (items between bars, arrows or
bullets), as shouting, as stuttering (words repeating one after another), as boilerplate (licence, cookie and
sharing phrases) or as a repetition of an earlier line. Lines of fewer than four words are judged together: a block of them,
blank lines left out, is navigation if it has at least five and four fifths end in a letter or digit. The cleaned text is what is left. A document is kept if it passes
the base rules and its cleaning removes at most `most_lost` of its words.

Base figures follow fixed definitions: words are runs of anything but space and the five control blanks.

Defined cases: null and empty texts have no words and fail the base rules; copies and repeated rows get
the same verdict; texts of any length are handled whole, in memory linear in the text; an empty table gives no rows; columns
whose names clash with the new ones, told without case, are replaced, all others are kept.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import col, fresh, map_texts, text_or_empty

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SYMBOL = re.compile(r"[#*$%&|<>]")
NOT_PLAIN = re.compile(r"[^\w\s.,;:'\"()\-]")
BAR = re.compile(r"(?:^|\s)[|»›•·→>](?=\s|$)")
BOILERPLATE = re.compile(
    r"licen[sc]ed under|all rights reserved|terms of (?:use|service)|privacy policy|cookies?\b.*\b(?:use|accept|settings)|click here|"
    r"sign (?:in|up)\b|log ?in\b|subscribe\b|share (?:on|this)|javascript|copyright|\(c\) ?\d{4}|©|work is licensed|permission is hereby granted",
    re.IGNORECASE,
)
RULES = ("punctuation", "navigation", "shouting", "stutter", "boilerplate", "repetition")
MARKS_PER_WORD, BARS_PER_WORD, UPPER_SHARE, STUTTER_SHARE, MOST_LOST = 0.3, 0.2, 0.6, 0.4, 0.3
#: Words from which the shares of a line mean something.
LEAST_WORDS = 4
#: Short lines that make a block, and the share of them that ends as menu items do.
MENU_LINES, MENU_SHARE = 5, 0.8


def line_rule(line: str) -> str | None:
    """The first rule that a line with a word fails, or None."""
    words = WORD.findall(line)
    n = len(words)
    if n < LEAST_WORDS:
        return "boilerplate" if BOILERPLATE.search(line) else None
    if len(BAR.findall(line)) > BARS_PER_WORD * n:
        return "navigation"
    if len(NOT_PLAIN.findall(line)) > MARKS_PER_WORD * n:
        return "punctuation"
    upper, lower = sum(map(str.isupper, words)), sum(map(str.islower, words))
    if upper > UPPER_SHARE * n and upper > lower:
        return "shouting"
    if sum(a == b for a, b in zip(words, words[1:])) > STUTTER_SHARE * n:
        return "stutter"
    if BOILERPLATE.search(line):
        return "boilerplate"
    return None


def menu_lines(lines: list[str], sizes: list[int]) -> set[int]:
    """Places of the short lines that stand in a navigation block; `sizes` are the lines' numbers of words."""
    found: set[int] = set()
    block: list[int] = []
    for k, n in enumerate([*sizes, LEAST_WORDS]):
        if 0 < n < LEAST_WORDS:
            block.append(k)
        elif n:
            items = sum(lines[j].rstrip()[-1:].isalnum() for j in block)
            if len(block) >= MENU_LINES and items >= MENU_SHARE * len(block):
                found.update(block)
            block = []
    return found


def repeat_words(words: list[str]) -> int:
    """Words inside 3-word windows that occur at least twice, the first occurrence included."""
    n = len(words)
    if n < 4:
        return 0
    seen: dict[str, int] = {}
    ids = np.fromiter(map(seen.setdefault, words, range(n)), dtype=np.int64, count=n)
    pair = ids[:-1] * n + ids[1:]
    if n > 2_000_000:  # else three ids fit into 64 bits
        pair = np.unique(pair, return_inverse=True)[1]
    keys = pair[:-1] * n + ids[2:]
    order = np.argsort(keys, kind="stable")
    same = keys[order[1:]] == keys[order[:-1]]
    again = np.zeros(n - 2, bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    covered = np.zeros(n, bool)
    for k in range(3):
        covered[k : n - 2 + k] |= again
    return int(covered.sum())


def inspect(text: str) -> tuple[dict, str]:
    """(figures and verdict, cleaned text)."""
    words = WORD.findall(text)
    n = len(words)
    out = dict.fromkeys(RULES, 0)
    seen, kept, lost, dup_lines = set(), [], 0, 0
    lines = text.split("\n")
    sizes = [len(WORD.findall(line)) for line in lines]
    menus = menu_lines(lines, sizes)
    for k, line in enumerate(lines):
        if sizes[k] == 0:
            kept.append(line)
            continue
        again = line in seen
        dup_lines += again
        seen.add(line)
        rule = "repetition" if again else line_rule(line) or ("navigation" if k in menus else None)
        if rule is None:
            kept.append(line)
        else:
            out[rule] += 1
            lost += sizes[k]
    repeats = repeat_words(words)
    failed = n < 50 or 100 * repeats > 50 * n
    out |= {"n_words": n, "word_chars": sum(map(len, words)), "n_symbols": len(SYMBOL.findall(text)), "n_dup_lines": dup_lines, "n_repeat_words": repeats,
            "base_failed": failed, "lost_words": lost, "kept": not failed and lost <= MOST_LOST * n}
    return out, "\n".join(kept)


LONGS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "lost_words")


def apply_rules(docs: DataFrame, text: str = "text", clean: str | None = None) -> DataFrame:
    """Append the base figures, failed lines per rule (`lines_<rule>`), `lost_words`, `base_failed`, `kept` and, if named, the cleaned text."""
    new = [*LONGS, *[f"lines_{r}" for r in RULES], "base_failed", "kept"]
    source = fresh(docs, "text_in")
    held = [col(c) for c in docs.columns if c.lower() not in {*new, (clean or "kept").lower()}]
    fields = [T.StructField(c, T.BooleanType() if c in ("base_failed", "kept") else T.LongType()) for c in new]

    def run(batch: pa.RecordBatch) -> dict:
        seen = [inspect(t) for t in batch.column(batch.schema.names.index(source)).to_pylist()]
        out = {c: [x[c.removeprefix("lines_")] for x, _ in seen] for c in new}
        return out | ({clean: [c for _, c in seen]} if clean else {})

    add = T.StructType(fields + ([T.StructField(clean, T.StringType())] if clean else []))
    return map_texts(docs.select(*held, text_or_empty(text).alias(source)), run, add, source).drop(source)
