"""Where a text stops: a stack automaton over its structural characters and the state of its tail.

Plain Python without Spark, so that the automaton can be tested alone; the operators call it on Arrow batches.
"""

from __future__ import annotations

import re
from html.entities import name2codepoint
from typing import NamedTuple

# Opening and closing signs, sentence-final marks.
PAIRS = {")": "(", "]": "[", "}": "{", "”": "“", "’": "‘", "»": "«", "）": "（"}
OPENERS = frozenset(PAIRS.values())
FINAL_MARKS = "।॥.?!？！。"

_STRUCTURAL = re.compile(r"[()\[\]{}“”‘’«»（）।॥.?!？！。\"`]|</?[A-Za-z][A-Za-z0-9]*>")
_BROKEN_TAIL = re.compile(r"(?:�+|\\(?:u[0-9A-Fa-f]{0,3}|x[0-9A-Fa-f]?)?|[\ud800-\udbff])\Z")
_ENTITY_TAIL = re.compile(r"&(#(?:[0-9]*|[xX][0-9A-Fa-f]*)|[A-Za-z]*)\Z")
_ENTITY = re.compile(r"&(?:#(?:[0-9]+|[xX][0-9A-Fa-f]+)|[A-Za-z]+);")
_ENTITY_PREFIXES = frozenset(name[:i] for name in name2codepoint for i in range(1, len(name) + 1))
_PERCENT_TAIL = re.compile(r"\S*%[0-9A-Fa-f]?\Z")
_PERCENT = re.compile(r"%[0-9A-Fa-f]{2}")
_ELLIPSIS = re.compile(r"(?:…|\.\.\.+)[\s\"”’}\])]*\Z")
_DIGITS = "0-9०-९"
_CITATION = re.compile(r"[(\[（][^()\[\]（）]*[)\]）]\Z")
_SCORE = re.compile(rf"[\wऀ-ॿ]\s*[:：=]\s*[{_DIGITS}]+(?:[.][{_DIGITS}]+)?(?:\s*/\s*[{_DIGITS}]+)?%?\Z")
#: Tags that need no closing one.
_UNPAIRED = frozenset("<area <base <br <col <dd <dt <hr <img <input <li <link <meta <option <p <source <td <th <tr <wbr".split())
_CLOSERS = "\"”’»}])`*_"
_INVISIBLE_END = "​‌‍⁠﻿"


class End(NamedTuple):
    """How a text ends: state of the automaton (``empty``, ``broken``, ``ellipsis``, ``open``, ``marked``, ``closed`` or ``bare``), its open signs, and its last two words."""

    state: str
    open_signs: str
    last_word: str
    before_last: str


def open_stack(text: str) -> list[tuple[str, int]]:
    """Signs left open at the end, with their places. Straight quotes and markup tags toggle or nest; an unmatched closing sign is ignored, as is a straight quote right behind a letter or digit (inches) with none open, and a tag that needs no closing one."""
    stack: list[tuple[str, int]] = []
    for m in _STRUCTURAL.finditer(text):
        sign = m[0]
        if sign in OPENERS:
            stack.append((sign, m.start()))
        elif sign in PAIRS:
            if any(s == PAIRS[sign] for s, _ in stack):
                while stack and stack[-1][0] != PAIRS[sign]:
                    stack.pop()
                stack.pop()
        elif sign in '"`':
            depth = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == sign), -1)
            if depth >= 0:
                del stack[depth:]
            elif not text[max(0, m.start() - 1) : m.start()].isalnum():
                stack.append((sign, m.start()))
        elif sign[0] == "<":
            tag = sign.strip("</>").lower()
            if f"<{tag}" in _UNPAIRED:
                continue
            if sign[1] != "/":
                stack.append((f"<{tag}", m.start()))
            elif any(s == f"<{tag}" for s, _ in stack):
                while stack[-1][0] != f"<{tag}":
                    stack.pop()
                stack.pop()
    return stack


def broken_tail(body: str) -> bool:
    """Whether ``body`` stops inside a multibyte sequence or an escape.

    An ampersand tail is a torn entity when what follows it begins an entity's name or number, and it stands behind no
    letter or digit (R&D, AT&T) or another entity of the text is whole; a bare ampersand closes nothing. A percent
    tail is a torn escape only in a token with a whole escape or an address (``90%`` is a number).
    """
    if _BROKEN_TAIL.search(body):
        return True
    if tail := _ENTITY_TAIL.search(body):
        name = tail[1]
        if not name:
            return True
        if name[0] == "#" or name in _ENTITY_PREFIXES:
            return not body[max(0, tail.start() - 1) : tail.start()].isalnum() or bool(_ENTITY.search(body))
    if "%" in body[-2:] and (token := _PERCENT_TAIL.search(body.rsplit(maxsplit=1)[-1])):
        return "://" in token[0] or bool(_PERCENT.search(token[0]))
    return False


def unclosed(body: str, stack: list[tuple[str, int]]) -> bool:
    """Whether a final mark at the end leaves ``body`` unfinished all the same, by a sign still open.

    A brace or tag does, wherever opened, as it holds the text; a round or square bracket does when opened within the
    last sentence, a double quote wherever, unless they begin a sentence, which is then whole inside. A single
    typographic quote may be an apostrophe and doesn't count.
    """
    inner = body.rstrip(FINAL_MARKS)
    last_mark = max(inner.rfind(c) for c in FINAL_MARKS)
    for sign, at in stack:
        if sign[0] in "{<":
            return True
        before = body[:at].rstrip()
        inside = before and before[-1] not in FINAL_MARKS + "\"”:"
        if inside and (sign in '“"«`' or (sign in "([（" and at > last_mark)):
            return True
    return False


def end_of(text: str | None) -> End:
    """The state in which ``text`` ends; null and blank texts are ``empty``.

    Broken tails and ellipses come first. Behind a final mark an open sign leaves it ``open`` if ``unclosed`` says so;
    at an end without final mark any open sign does, but for a round or square bracket opened before the last final mark.
    """
    body = (text or "").rstrip().rstrip(_INVISIBLE_END).rstrip()
    if not body:
        return End("empty", "", "", "")
    stack = open_stack(body)
    signs = "".join(s for s, _ in stack)
    if broken_tail(body):
        return End("broken", signs, *last_words(body))
    if _ELLIPSIS.search(body):
        return End("ellipsis", signs, *last_words(body))
    if body[-1] in FINAL_MARKS:
        return End("open" if unclosed(body, stack) else "marked", signs, *last_words(body))
    last_mark = max(body.rfind(c) for c in FINAL_MARKS)
    if any(s not in "([（" or at > last_mark for s, at in stack):
        return End("open", signs, *last_words(body))
    if _CITATION.search(body) or _SCORE.search(body) or body[-1] in _CLOSERS:
        return End("closed", signs, *last_words(body))
    return End("bare", signs, *last_words(body))


def last_words(body: str) -> tuple[str, str]:
    """The last word and the one before it, bare of signs."""
    words = [w.strip("\"“”‘’()[]{}<>,;:।.?!`*") for w in body.rsplit(maxsplit=2)[-2:]]
    return words[-1] if words else "", words[-2] if len(words) > 1 else ""
