"""What the rules of style sheets say about an element: which of them match, and which of those wins.

A selector is a path in a tree that all selectors of a page share: each step has a compound (tag, id,
classes, attributes) and the combinator before it.  An element matches a step if it fits the compound
and the step before was matched by an open element around it (a blank), its parent (>), the element
before it (+) or any before it under the same parent (~).  Steps are found by the id, a class, the tag
or an attribute of the element, so an element is only held against steps that name something of its own.

Selectors with pseudo-classes or pseudo-elements match nothing; blocks of at-rules are passed over.
"""

from __future__ import annotations

import re
from collections import defaultdict
from dataclasses import dataclass, field

#: Only these decide whether something is seen.
PROPERTIES = {"display": {"none"}, "visibility": {"hidden", "collapse"}}
_COMMENT = re.compile(r"/\*.*?(?:\*/|\Z)", re.S)
_BRACE = re.compile(r"[{}]")
_SIMPLE = re.compile(r"""(?P<tag>\*|[A-Za-z][A-Za-z0-9-]*)|[.](?P<cls>[A-Za-z0-9_-]+)|[#](?P<id>[A-Za-z0-9_-]+)|\[\s*(?P<attr>[A-Za-z0-9_-]+)\s*(?:(?P<op>[~|^$*]?=)\s*(?P<value>"[^"]*"|'[^']*'|[^\]\s"']+)\s*)?\]""")
_COMBINATOR = re.compile(r"\s*([>+~])\s*|\s+")
_FITS = {
    "": lambda has, want: True,
    "=": lambda has, want: has == want,
    "~=": lambda has, want: want in has.split(),
    "|=": lambda has, want: has == want or has.startswith(f"{want}-"),
    "^=": lambda has, want: bool(want) and has.startswith(want),
    "$=": lambda has, want: bool(want) and has.endswith(want),
    "*=": lambda has, want: bool(want) and want in has,
}
Weight = tuple[bool, bool, tuple[int, int, int], int]


def declarations(body: str) -> dict[str, tuple[str, bool]]:
    """The value of each of PROPERTIES that a block sets last, and whether it is important; an important one isn't replaced by another."""
    found: dict[str, tuple[str, bool]] = {}
    for part in body.split(";"):
        name, _, value = part.partition(":")
        if (name := name.strip().lower()) in PROPERTIES:
            value, mark, last = value.strip().lower().partition("!")
            important = bool(mark) and last.strip() == "important"
            if important or not found.get(name, ("", False))[1]:
                found[name] = value.strip(), important
    return found


def rules(css: str) -> list[tuple[str, str]]:
    """(selectors, body) of a style sheet, in order; one look at each character."""
    css, at, out = _COMMENT.sub(" ", css), 0, []
    while (start := css.find("{", at)) >= 0:
        head = re.split("[;}]", css[at:start])[-1].strip()
        if head.startswith("@"):
            depth, at = 0, len(css)
            for m in _BRACE.finditer(css, start):
                depth += 1 if m[0] == "{" else -1
                if not depth:
                    at = m.end()
                    break
            continue
        end = css.find("}", start)
        end = len(css) if end < 0 else end
        out.append((head, css[start + 1 : end]))
        at = end + 1
    return out


@dataclass(frozen=True)
class Compound:
    tag: str = ""
    id: str = ""
    classes: frozenset = frozenset()
    attrs: tuple = ()

    def fits(self, tag: str, attrs: dict, classes: set) -> bool:
        return (not self.tag or self.tag == tag) and (not self.id or self.id == attrs.get("id")) and self.classes <= classes and all(name in attrs and _FITS[op](attrs[name] or "", value) for name, op, value in self.attrs)

    def key(self) -> tuple[str, str]:
        return ("#", self.id) if self.id else (".", min(self.classes)) if self.classes else ("", self.tag) if self.tag else ("[", self.attrs[0][0]) if self.attrs else ("*", "")


def selector(text: str) -> tuple[list[tuple[str, Compound]], tuple[int, int, int]] | None:
    """The steps of a selector as (combinator before, compound), and its specificity; None if it isn't understood."""
    steps, at, combinator, weight = [], 0, "", [0, 0, 0]
    text = text.strip()
    while True:
        tag, id_, classes, attrs, begun = "", "", set(), [], at
        while m := _SIMPLE.match(text, at):
            if m["tag"] and at > begun:
                return None
            if m["tag"] and m["tag"] != "*":
                tag, weight[2] = m["tag"].lower(), weight[2] + 1
            elif m["cls"]:
                classes.add(m["cls"])
                weight[1] += 1
            elif m["id"]:
                if id_ not in ("", m["id"]):
                    return None
                id_, weight[0] = m["id"], weight[0] + 1
            elif m["attr"]:
                attrs.append((m["attr"].lower(), m["op"] or "", (m["value"] or "").strip("\"'")))
                weight[1] += 1
            at = m.end()
        if at == begun:
            return None
        steps.append((combinator, Compound(tag, id_, frozenset(classes), tuple(attrs))))
        if at == len(text):
            return steps, tuple(weight)
        m = _COMBINATOR.match(text, at)
        if not m:
            return None
        combinator, at = m[1] or " ", m.end()


@dataclass
class Around:
    """What was matched by the children of an open element so far: the last, and all."""

    last: frozenset = frozenset()
    any: set = field(default_factory=set)


class Sheet:
    """All rules of a page, as its style elements are met."""

    def __init__(self):
        self.steps: dict[tuple[int, str, Compound], int] = {}
        self.by_key: dict[tuple[str, str], list[tuple[int, int, str, Compound]]] = defaultdict(list)
        self.says: dict[int, list[tuple[tuple[int, int, int], int, dict]]] = defaultdict(list)  # of steps that end selectors
        self.open: dict[int, int] = defaultdict(int)  # how many open elements matched a step
        self.n = 0

    def add(self, css: str) -> None:
        for selectors, body in rules(css):
            found = declarations(body)
            for text in selectors.split(",") if found else ():
                parsed = selector(text)
                self.n += 1
                if parsed:
                    step = -1
                    for combinator, compound in parsed[0]:
                        place = step, combinator, compound
                        if place not in self.steps:
                            self.steps[place] = len(self.steps)
                            self.by_key[compound.key()].append((self.steps[place], *place))
                        step = self.steps[place]
                    self.says[step].append((parsed[1], self.n, found))

    def matched(self, tag: str, attrs: dict, parent: frozenset, around: Around) -> frozenset:
        """The steps that an element matches, given those of its parent and of its siblings."""
        classes = set((attrs.get("class") or "").split())
        keys = [("#", attrs.get("id")), *((".", c) for c in classes), ("", tag), *(("[", a) for a in attrs), ("*", "")]
        out = []
        for key in keys:
            for step, before, combinator, compound in self.by_key.get(key, ()):
                fits = before < 0 or (self.open[before] > 0 if combinator == " " else before in parent if combinator == ">" else before in around.last if combinator == "+" else before in around.any)
                if fits and compound.fits(tag, attrs, classes):
                    out.append(step)
        return frozenset(out)

    def hides(self, matched: frozenset, attrs: dict) -> bool:
        """Whether what wins for an element leaves it unseen: important before not, its own style before rules, then specificity, then the later."""
        own = declarations(attrs.get("style") or "")
        best: dict[str, tuple[Weight, str]] = {}
        says = [(False, weight, n, found) for step in matched for weight, n, found in self.says.get(step, ())]
        for inline, weight, n, found in [*says, (True, (0, 0, 0), 0, own)]:
            for name, (value, important) in found.items():
                rated = (important, inline, weight, n), value
                best[name] = max(best.get(name, rated), rated, key=lambda x: x[0])
        return any(value in PROPERTIES[name] for name, (_, value) in best.items())
