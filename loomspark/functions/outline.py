"""Markdown to a flat outline: pieces of text with their depth, in order.

`outline` is a state machine over the lines of one document, so it runs as one
vectorised function per document; everything after it (parents, leaves,
groups) is windows and joins.
"""

from __future__ import annotations

import logging
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

_LOG = logging.getLogger(__name__)
LIMIT = 500
ARROW = "→"
_MARKED = re.compile("【[^】]+】")
_LABEL = re.compile(r"(?:(?P<bullet>[•*+-])|(?P<label>\d+|[A-Za-zÀ-ÿ]|(?i:[cdilmvx]+))(?:\)|\.))[\t ]+")
_SENTENCE_END = re.compile(r"(?P<marks>[。！？!?.]+)\s+(?=[•*\-{\[('\"0-9A-ZÀ-Ý])")
_CLAUSE_END = re.compile(r"[；：，、,:;]+(?:\s+|\Z)")
_URL = re.compile(r"https?://\S+")
_DASHES = re.compile(r":?-{3,}:?")
#: Words that, with a full stop, do not end a sentence.
ABBREVIATIONS = frozenset(
    w + "."
    for w in """amend ann app apt art ave blvd cal cf ch cit civ col colo corp dr e.g ed eq etc fax fig gen gov hon i.e inc jr
    lt ltd mr mrs ms no op para pp prof rd ref reg rep rev sec sen seq sgt sr st stat supp tel u.s v vol vs""".split()
)


def estimate_tokens(text: str) -> int:
    """About 1.3 tokens a word, one at least."""
    return max(1, int(len(text.split()) * 1.3))


def token_length(text: str) -> int:
    """The estimate, but never more than the bytes there are: a token has at least one."""
    return min(len(text.encode()), estimate_tokens(text))


@dataclass
class Event:
    kind: str
    text: str = ""
    level: int = 0


# --- lines -----------------------------------------------------------------


def _margin(line: str) -> int:
    return len(line) - len(line.lstrip(" \t"))


def is_thematic(line: str) -> bool:
    body = line[_margin(line) :]
    if _margin(line) > 3 or not body or body[0] not in "*-_":
        return False
    marks = "".join(body.split())
    return len(marks) >= 3 and not marks.strip(body[0])


def heading_of(line: str) -> Event | None:
    body = line[_margin(line) :]
    after = body.lstrip("#")
    level = len(body) - len(after)
    if _margin(line) > 3 or not 1 <= level <= 6 or after[:1] not in (" ", "\t"):
        return None
    text = after.lstrip(" \t")
    return Event("heading", text.rstrip(" \t").rstrip("#").rstrip(" \t"), level)


def fence_of(line: str) -> tuple[str, int] | None:
    body = line[_margin(line) :]
    if body[:1] in ("`", "~"):
        n = len(body) - len(body.lstrip(body[0]))
        return (body[0], n) if n >= 3 else None
    return None


def closes(line: str, mark: str, least: int) -> bool:
    s = line.strip()
    return len(s) >= least and not s.strip(mark)


def is_placeholder(line: str) -> bool:
    s = line.strip()
    return s == "[...]" or bool(_MARKED.fullmatch(s))


def is_table_row(line: str) -> bool:
    s = line.strip()
    return len(s) > 1 and s[0] == s[-1] == "|"


def is_grid(line: str) -> bool:
    s = line.strip()
    return len(s) > 4 and s[0] == s[-1] == "+" and not s.strip("-=+")


def is_table_rule(line: str) -> bool:
    cells = line.strip().removeprefix("|").removesuffix("|").split("|")
    return len(cells) > 1 and all(_DASHES.fullmatch(c.strip()) for c in cells)


def opens_html_table(line: str) -> bool:
    s = line.lstrip()[:7].lower()
    return s.startswith("<table") and not (len(s) > 6 and (s[6].isalnum() or s[6] == "_"))


def closes_html_table(line: str) -> bool:
    return line.rstrip().lower().endswith("</table>")


def is_code(line: str) -> bool:
    return line.startswith(("    ", "\t"))


def list_item(line: str) -> tuple[int, str, str] | None:
    """(indent in spaces, marker, rest)."""
    n = _margin(line)
    m = _LABEL.match(line, n)
    if not m:
        return None
    indent = sum(4 if c == "\t" else 1 for c in line[:n])
    return indent, m["bullet"] or m["label"] + ".", line[m.end() :]


def is_link(line: str) -> bool:
    s = line.strip()
    if _URL.fullmatch(s):
        return True
    close = s.find("]")
    return s[:1] == "[" and close > 1 and s[close + 1 : close + 2] == "(" and s[-1] == ")" and len(s) > close + 3 and ")" not in s[close + 2 : -1]


def is_caption(line: str) -> bool:
    s = line.strip()
    return any(len(s) > 2 * n and not s[:n].strip("*_") and s.endswith(s[:n]) for n in (2, 1))


def is_pseudo_heading(lines: list[str], i: int) -> bool:
    """A short line between blank lines that is no list item and does not end like a sentence."""
    s = lines[i].strip()
    if not 0 < len(s) <= 120 or _MARKED.search(s) or list_item(s) or s[-1] in ".!?。！？":
        return False
    return 0 < i < len(lines) - 1 and not lines[i - 1].strip() and not lines[i + 1].strip()


def scan(text: str) -> Iterator[Event]:
    """The blocks and lines of a document; the first kind that fits wins."""
    lines = text.split("\n")
    i, n = 0, len(lines)
    while i < n:
        line, start = lines[i], i
        i += 1
        if not line.strip():
            yield Event("blank")
        elif is_thematic(line):
            yield Event("rule")
        elif fence := fence_of(line):
            while i < n and not closes(lines[i], *fence):
                i += 1
            i = min(n, i + 1)
            yield Event("code", "\n".join(lines[start:i]))
        elif heading := heading_of(line):
            yield heading
        elif is_placeholder(line):
            yield Event("placeholder", line.strip())
        elif opens_html_table(line):
            if not closes_html_table(line):
                while i < n and not closes_html_table(lines[i]):
                    i += 1
                i = min(n, i + 1)
            yield Event("table", "\n".join(lines[start:i]))
        elif is_table_row(line) or is_grid(line):
            while i < n and lines[i].strip() and (is_table_row(lines[i]) or is_table_rule(lines[i]) or is_grid(lines[i])):
                i += 1
            yield Event("table", "\n".join(lines[start:i]))
        elif is_code(line):
            while i < n and (is_code(lines[i]) or not lines[i].strip()):
                i += 1
            yield Event("code", "\n".join(lines[start:i]))
        elif is_pseudo_heading(lines, start):
            yield Event("pseudo", line.strip())
        else:
            yield Event("line", line)


# --- pieces ----------------------------------------------------------------


def sentences(line: str) -> list[str]:
    """Sentences of a line; all but the last keep one space behind them."""
    s = line.strip("\n")
    out, start = [], 0
    for m in _SENTENCE_END.finditer(s):
        before = s[start : m.start()].split()
        if before and before[-1].lower() + m["marks"][0] in ABBREVIATIONS:
            continue
        out.append(s[start : m.end("marks")] + " ")
        start = m.end()
    out.append(s[start:])
    return [x for x in out if x.strip()]


def clauses(text: str) -> list[str]:
    cuts = [0, *(m.end() for m in _CLAUSE_END.finditer(text)), len(text)]
    return [text[a:b] for a, b in zip(cuts, cuts[1:]) if b > a]


def fill_words(text: str, length: Callable[[str], int], limit: int) -> list[str]:
    """Words joined as long as they fit; one that does not fit stands alone."""
    out: list[str] = []
    now = ""
    for word in text.split():
        longer = f"{now} {word}" if now else word
        if length(longer) <= limit:
            now = longer
            continue
        if now:
            out.append(now)
        now = word
        if length(word) > limit and longer == word:
            out.append(word)
            now = ""
    return [*out, now] if now else out or [text]


def _around_marks(text: str, length: Callable[[str], int], limit: int) -> list[str]:
    """Pieces that cut no 【mark】."""
    pieces: list[str] = []
    held = ""

    def let_go() -> None:
        nonlocal held
        if held:
            pieces.extend([held] if length(held) <= limit else fill_words(held, length, limit))
        held = ""

    at = 0
    for m in [*_MARKED.finditer(text), None]:
        between = text[at : m.start() if m else len(text)]
        if between:
            for part in [between] if length(between) <= limit else fill_words(between, length, limit):
                if length(held + part) > limit:
                    let_go()
                held += part
        if m:
            let_go()
            pieces.append(m.group())
            at = m.end()
    let_go()
    return pieces or [text]


def within_limit(text: str, length: Callable[[str], int] = token_length, limit: int = LIMIT) -> list[str]:
    """The text, or pieces of it that keep the limit where they can."""
    if length(text) <= limit:
        return [text]
    if _MARKED.search(text):
        return _around_marks(text, length, limit)
    parts = clauses(text)
    if len(parts) > 1 and all(length(p) <= limit for p in parts):
        return parts
    return fill_words(text, length, limit)


# --- depths ----------------------------------------------------------------


def take_title(events: list[Event]) -> tuple[str, list[Event]]:
    """The first heading, or the first sentence of the first line; of the rest of that line only the next sentence stays."""
    for i, e in enumerate(events):
        if e.kind == "heading":
            return e.text.strip(), events[:i] + events[i + 1 :]
        if e.kind == "line":
            parts = sentences(e.text.strip())
            rest = parts[1].strip() if len(parts) > 1 else ""
            return (parts[0] if parts else e.text).strip(), [*events[:i], *([Event("line", rest)] if rest else []), *events[i + 1 :]]
    return "", events


@dataclass
class _State:
    length: Callable[[str], int]
    limit: int
    out: list[str] = field(default_factory=list)
    heading: int = 0
    pseudo: int = 0
    colon: int | None = None
    resume: int | None = None
    anchor: int = 0
    mark: int | None = None  # depth of the placeholder just seen

    def body(self) -> int:
        return max(1, self.heading + 1, self.pseudo + 1, self.colon + 1 if self.colon is not None else 0, self.resume or 0)

    def put(self, depth: int, text: str) -> None:
        text = text.rstrip("\n")
        if text:
            self.out.append(ARROW * max(0, depth) + text)

    def split(self, depth: int, text: str) -> None:
        for i, piece in enumerate(within_limit(text, self.length, self.limit)):
            self.put(depth + (i > 0), piece)

    def forget(self) -> None:
        self.colon = self.resume = self.mark = None
        self.pseudo = 0

    def line(self, line: str) -> None:
        mark, self.mark = self.mark, None
        if mark is not None and is_caption(line):
            return self.split(mark + 1, line)
        body = self.body()
        if item := list_item(line):
            indent, marker, rest = item
            base = body + (self.colon is None)
            depth = base + indent // 2
            parts = sentences(rest)
            self.split(depth, f"{marker} {parts[0] if parts else rest}")
            for s in parts[1:]:
                self.split(depth, s)
            self.anchor, self.colon = base, None
        elif is_link(line):
            self.put(body, line)
            self.anchor, self.colon = body, None
        else:
            for s in sentences(line):
                self.split(body, s)
                if s.rstrip().endswith((":", "：")):
                    self.colon = body
                elif self.colon == body:
                    self.colon = None
            self.anchor = body
        self.resume = None

    def take(self, e: Event) -> None:
        if e.kind in ("blank", "rule"):
            self.forget()
        elif e.kind in ("code", "table"):
            depth = self.body() + 1
            self.split(depth, e.text)
            self.anchor, self.resume, self.mark = depth, None, None
        elif e.kind == "heading":
            self.forget()
            self.heading = self.anchor = max(1, e.level - 1)
            self.put(self.heading, e.text)
        elif e.kind == "pseudo":
            self.anchor = depth = self.body()
            self.forget()
            self.pseudo = depth
            self.put(depth, e.text)
        elif e.kind == "placeholder":
            self.mark, self.resume = self.anchor + 1, self.anchor
            self.put(self.mark, e.text)
        else:
            self.line(e.text)


def outline_text(text: str | None, title: bool = True, length: Callable[[str], int] = token_length, limit: int = LIMIT) -> str:
    """The outline as lines, each with an arrow for every level of depth."""
    events = list(scan((text or "").replace("\r\n", "\n").replace("\r", "\n")))
    state = _State(length, limit)
    if title:
        first, events = take_title(events)
        if not first and text:
            _LOG.warning("a document has no title")
        state.put(0, first)
    for e in events:
        state.take(e)
    return "\n".join(state.out)


def parse_outline(lines: str) -> list[tuple[int, str]]:
    """(depth, content) of arrow lines; blank ones are left out."""
    out = []
    for line in lines.split("\n"):
        content = line.lstrip(ARROW)
        if content.strip():
            out.append((len(line) - len(content), content))
    return out


def outline(text: str | None, title: bool = True, length: Callable[[str], int] = token_length, limit: int = LIMIT, attached: bool = False) -> list[tuple[int, str]]:
    """Pieces of a document with their depths.

    The lines of a table or code block after its first have depth 0, as blocks
    are written as arrow lines; `attached` gives them the depth of the block.
    """
    if not attached:
        return parse_outline(outline_text(text, title, length, limit))
    state = _State(length, limit)
    events = list(scan((text or "").replace("\r\n", "\n").replace("\r", "\n")))
    if title:
        first, events = take_title(events)
        state.put(0, first)
    for e in events:
        state.take(e)
    return [(len(block) - len(block.lstrip(ARROW)), line) for block in state.out for line in block.lstrip(ARROW).split("\n") if line.strip()]


def parents(depths: list[int]) -> list[int | None]:
    """Index of the nearest earlier entry of smaller depth."""
    stack: list[int] = []
    out: list[int | None] = []
    for i, d in enumerate(depths):
        while stack and depths[stack[-1]] >= d:
            stack.pop()
        out.append(stack[-1] if stack else None)
        stack.append(i)
    return out
