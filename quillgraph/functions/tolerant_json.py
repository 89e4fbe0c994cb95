"""Reading JSON that a model wrote almost right: one pass over the text with a stack of open containers.

Accepted beyond the standard: single, typographic and missing quotes, comments,
missing and trailing commas, unescaped quotes and line breaks inside strings,
Python's and JavaScript's literals, fences and prose around the value, and a
tail that is cut off anywhere.  A text that is standard JSON is read by the
standard reader, so its value never changes.
"""

from __future__ import annotations

import json
import re
from typing import Any

FENCE = re.compile(r"```(?:[A-Za-z0-9]+)?")
SKIPPED = re.compile(r"(?:\s|//[^\n]*|/\*.*?(?:\*/|\Z)|#[^\n]*)+", re.DOTALL)
QUOTES = {'"': '"', "'": "'", "`": "`", "“": "”", "‘": "’", "«": "»"}
WORDS = {"true": True, "false": False, "null": None, "none": None, "undefined": None, "nan": None}
BARE = re.compile(r"[^,:{}\[\]\n\"“”]*")
NUMBER = re.compile(r"[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?\Z")
ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f"}
#: A key and its colon behind a string whose comma is missing.
NEXT_KEY = re.compile(r"[\"'“‘`]?[\w -]+[\"'”’`]?\s*:")
MISSING = object()


class Reader:
    def __init__(self, text: str, at: int):
        self.text, self.at = text, at
        #: Open containers, innermost last, and for each the key that waits for its value.
        self.open: list[Any] = []
        self.keys: list[Any] = []

    def skip(self) -> None:
        m = SKIPPED.match(self.text, self.at)
        self.at = m.end() if m else self.at

    def put(self, value: Any) -> None:
        """A value goes into the innermost container, as a key where one is due."""
        inner, key = self.open[-1], self.keys[-1]
        if isinstance(inner, list):
            inner.append(value)
        elif key is MISSING:
            self.keys[-1] = value if isinstance(value, str) else json.dumps(value)
        else:
            inner[key] = value
            self.keys[-1] = MISSING

    def ends_string(self, at: int) -> bool:
        """Does the quote before ``at`` end its string, and isn't merely one inside it?"""
        m = SKIPPED.match(self.text, at)
        after = m.end() if m else at
        if after >= len(self.text) or self.text[after] in ",:}]":
            return True
        return "\n" in self.text[at:after] or (isinstance(self.open[-1], dict) and bool(NEXT_KEY.match(self.text, after)))

    def string(self) -> str:
        close = QUOTES[self.text[self.at]]
        out, text = [], self.text
        self.at += 1
        while self.at < len(text):
            c = text[self.at]
            self.at += 1
            if c == "\\" and self.at < len(text):
                e = text[self.at]
                self.at += 1
                code = text[self.at : self.at + 4]
                if e == "u" and re.fullmatch("[0-9a-fA-F]{4}", code):
                    out.append(chr(int(code, 16)))
                    self.at += 4
                elif e != "\n":
                    out.append(ESCAPES.get(e, e))
            elif c == close and self.ends_string(self.at):
                break
            else:
                out.append(c)
        return re.sub("([\ud800-\udbff])([\udc00-\udfff])", lambda m: (m[1] + m[2]).encode("utf-16", "surrogatepass").decode("utf-16"), "".join(out))

    def bare(self) -> Any:
        m = BARE.match(self.text, self.at)
        cut = m.end() >= len(self.text)
        self.at = max(m.end(), self.at + 1) if not m[0] else m.end()
        word = re.split(r"\s(?://|/\*|#)", m[0])[0].strip()
        low = word.lower()
        if isinstance(self.open[-1], dict) and self.keys[-1] is MISSING:
            return word.strip("'‘’`")
        if low in WORDS:
            return WORDS[low]
        if cut and len(low) > 1 and (whole := next((w for w in ("true", "false", "null") if w.startswith(low)), None)):
            return WORDS[whole]
        if NUMBER.match(word):
            return int(word) if re.fullmatch(r"[+-]?\d+", word) else float(word)
        if re.fullmatch("0[xX][0-9a-fA-F]+", word):
            return int(word, 16)
        return word

    def read(self) -> Any:
        """The value that begins at ``at``, closed where the text ends."""
        root = None
        while True:
            self.skip()
            if self.at >= len(self.text):
                return root
            c = self.text[self.at]
            if c in "{[":
                made: Any = {} if c == "{" else []
                if self.open:
                    self.put(made)
                else:
                    root = made
                self.open.append(made)
                self.keys.append(MISSING)
                self.at += 1
            elif c in "}]":
                self.at += 1
                kind = dict if c == "}" else list
                if any(isinstance(o, kind) for o in self.open):
                    while True:
                        closed = self.open.pop()
                        self.keys.pop()
                        if isinstance(closed, kind):
                            break
                if not self.open:
                    return root
            elif c in ",:":
                self.at += 1
                if c == "," and isinstance(self.open[-1], dict):
                    self.keys[-1] = MISSING
            elif c in QUOTES:
                self.put(self.string())
            elif (value := self.bare()) != "":
                self.put(value)


def tolerant(text: str) -> Any:
    """The first object or list in ``text``, None if there is none."""
    start = min((i for i in (text.find("{"), text.find("[")) if i >= 0), default=-1)
    return None if start < 0 else Reader(text, start).read()


def parse(text: str) -> tuple[Any, str]:
    """(value, how): how is strict, repaired or none."""
    content = FENCE.sub("", text).strip()
    for candidate in dict.fromkeys((text, content)):
        try:
            return json.loads(candidate), "strict"
        except (ValueError, RecursionError):
            continue
    found = tolerant(content)
    return (found, "repaired") if found else (None, "none")


def listed(text: str, key: str) -> list[Any]:
    """The list under ``key``, else the first bracketed list in the text; texts are trimmed, blanks and other values left out."""
    value, _ = parse(text)
    if isinstance(value, dict) and key in value:
        items = value[key] if isinstance(value[key], list) else []
    else:
        content = FENCE.sub("", text)
        start = content.find("[")
        end = content.find("]", start)
        items = [part.strip(" \"'") for part in content[start + 1 : end].split(",")] if 0 <= start < end else []
    return [i.strip() if isinstance(i, str) else i for i in items if (isinstance(i, str) and i.strip()) or isinstance(i, dict)]
