"""Tokens of source texts: words, variables, strings and signs with their lines, and which bracket closes which."""

from __future__ import annotations

import re
from dataclasses import dataclass

_SIGNS = r"(?P<sign>=>|->|::|\S)"
_TEXT = r"\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'"
_C_NOTE = r"//[^\n]*|/\*.*?(?:\*/|\Z)"
#: What is skipped, strings, and words, by style.
STYLES = {
    "c": (_C_NOTE, _TEXT + r"|`(?:\\.|[^`\\])*`", r"@?[^\W\d][\w$]*|\$[\w$]+"),
    "php": (_C_NOTE + r"|\#(?!\[)[^\n]*|<\?(?:php|=)?|\?>", r"\"(?:\\.|[^\"\\])*\"|'(?:\\.|[^'\\])*'", r"\\?[^\W\d][\w\\]*|\$\w+"),
    "sql": (r"--[^\n]*|/\*.*?(?:\*/|\Z)", r"'(?:''|[^'])*'", r"[^\W\d]\w*|\[[^\]\n]+\]|\"[^\"\n]+\"|`[^`\n]+`"),
}
_RULES = {k: re.compile(rf"(?P<note>{note})|(?P<string>{string})|(?P<word>{word})|(?P<number>\d[\w.]*)|{_SIGNS}", re.S) for k, (note, string, word) in STYLES.items()}
_OPEN, _CLOSE = "([{", ")]}"


@dataclass(slots=True)
class Token:
    kind: str
    text: str
    start: int
    end: int
    line: int
    leads: bool  # the first of its line
    note: str | None  # the /** comment right before it

    @property
    def value(self) -> str:
        """A string without its quotes, a quoted name without its marks."""
        return self.text[1:-1] if self.kind == "string" or self.text[0] in '["`' else self.text


class Tokens(list):
    """The tokens of a source; `partner` is the index of the bracket that closes the one at an index (the last token without one)."""

    def __init__(self, source: str, style: str = "c"):
        super().__init__()
        self.source = source
        line, at, note, last = 1, 0, None, 0
        for m in _RULES[style].finditer(source):
            line += source.count("\n", at, m.start())
            at = m.start()
            if m.lastgroup == "note":
                note = m[0] if m[0].startswith("/**") else note
                continue
            self.append(Token(m.lastgroup, m[0], m.start(), m.end(), line, line != last, note))
            note, last = None, line + m[0].count("\n")
        self.partner: dict[int, int] = {}
        waiting: list[int] = []
        for i, t in enumerate(self):
            if t.kind == "sign" and t.text in _OPEN:
                waiting.append(i)
            elif t.kind == "sign" and t.text in _CLOSE:
                while waiting and self[waiting[-1]].text != _OPEN[_CLOSE.index(t.text)]:
                    waiting.pop()
                if waiting:
                    self.partner[waiting.pop()] = i
        for i, t in enumerate(self):
            if t.kind == "sign" and t.text in _OPEN:
                self.partner.setdefault(i, len(self) - 1)

    def text(self, i: int) -> str:
        return self[i].text if 0 <= i < len(self) else ""

    def is_word(self, i: int) -> bool:
        return 0 <= i < len(self) and self[i].kind == "word"

    def is_string(self, i: int) -> bool:
        return 0 <= i < len(self) and self[i].kind == "string"

    def seek(self, i: int, *signs: str) -> int:
        """The first index from i on with one of the signs outside of brackets that open meanwhile; the length without one."""
        while i < len(self):
            if self[i].kind == "sign" and self[i].text in signs:
                return i
            i = self.partner.get(i, i) + 1
        return i

    def generic_end(self, i: int) -> int:
        """After the <...> that begins at i, or i."""
        if self.text(i) != "<":
            return i
        depth = 0
        for j in range(i, len(self)):
            depth += {"<": 1, ">": -1}.get(self[j].text, 0)
            if depth == 0:
                return j + 1
            if self[j].text in (";", "{"):
                break
        return i

    def dotted(self, i: int) -> tuple[str, int]:
        """A name of words joined by dots from i on (quotes removed), and the index after it."""
        parts = []
        while self.is_word(i):
            parts.append(self[i].value)
            i += 1
            if self.text(i) != ".":
                break
            i += 1
        return ".".join(parts), i

    def names(self, i: int, stop: int) -> list[str]:
        """Comma-separated names in [i, stop), without what stands in <> or brackets."""
        out: list[str] = []
        current: list[str] = []
        while i < stop:
            t = self[i]
            if t.text == ",":
                out.append("".join(current))
                current = []
            elif t.text == "<":
                i = max(i, self.generic_end(i) - 1)
            elif i in self.partner:
                i = self.partner[i]
            elif t.kind == "word" or t.text == ".":
                current.append(t.text)
            i += 1
        return [x for x in [*out, "".join(current)] if x]


_TAG = re.compile(r"<(%@|/)?\s*([\w.:]+)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)>")


def tags(source: str):
    """(mark, name, attributes, start, text up to the next tag) of every tag; the mark is %@, / or empty."""
    for m in _TAG.finditer(source):
        pairs = re.findall(r"([\w.:]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)')", m[3])
        after = source.find("<", m.end())
        yield m[1] or "", m[2], {k: a or b for k, a, b in pairs}, m.start(), source[m.end() : after if after >= 0 else len(source)]
