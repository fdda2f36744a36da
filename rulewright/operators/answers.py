"""Free-text answers: cleaning, parsing to rules and assumptions, and rendering."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame

from rulewright.functions.atoms import CLEANING
from rulewright.operators.reason import Framework, Rule

# The answer format. `NEW RULES:` heads a clause per line or NONE, `NEW ASSUMPTIONS:` heads lines of the form
# `a defeated_by c` or NONE, and a line that starts with `=== ` echoes the question.
RULES, ASSUMPTIONS, NOTHING, DEFEATED = "NEW RULES:", "NEW ASSUMPTIONS:", "NONE", "defeated_by"
TERM = r"(?:[A-Za-z_]\w*|-?\d+)"
ATOM = rf"[a-z]\w*(?:\s*\(\s*{TERM}(?:\s*,\s*{TERM})*\s*\))?"
COMPARISON = rf"{TERM}\s*(?:==|!=|<=|>=|=|<|>)\s*{TERM}"

_head = lambda words: re.compile(r"^[ \t]*" + r"[ \t]+".join(words.rstrip(":").split()) + r"[ \t]*:", re.I | re.M)
RULES_HEAD, ASSUMPTIONS_HEAD = _head(RULES), _head(ASSUMPTIONS)
ECHO = re.compile(r"^[ \t]*===[ \t]", re.M)
_ELEMENT = re.compile(rf"(?:not\s+)?{ATOM}|{COMPARISON}")
_ANY_ATOM = r"[A-Za-z_]\w*(?:\([^)]*\))?"
_DECLARED = re.compile(rf"({_ANY_ATOM})\s+{DEFEATED}\s+({_ANY_ATOM})")
_PAIR = re.compile(r"([A-Za-z_]\w*\([^)]*\))\s*,\s*([A-Za-z_]\w*\([^)]*\))\s*$")
_MARKER = re.compile(r"^[-*\d.]+\s*")
_OPERATOR = re.compile(r"\s*(==|!=|<=|>=|=|<|>)\s*")


def clean(text: str) -> str:
    """The text after every replacement of CLEANING, without the other non-ASCII characters and with one blank line at most."""
    for pattern, new in CLEANING:
        text = re.sub(pattern, new, text)
    return text


def split_body(body: str) -> list[str]:
    """Parts between commas outside parentheses; empty parts are dropped."""
    depth, cuts = 0, [-1]
    for i, c in enumerate(body):
        depth = max(0, depth + (c == "(") - (c == ")"))
        if c == "," and not depth:
            cuts.append(i)
    parts = (body[a + 1 : b].strip() for a, b in zip(cuts, [*cuts[1:], len(body)], strict=True))
    return [p for p in parts if p]


def spelt(atom: str) -> str:
    """One spelling of a body element: no white space but after `not` and around a comparison."""
    if re.fullmatch(COMPARISON, atom):
        return _OPERATOR.sub(r" \1 ", atom)
    sign, rest = re.fullmatch(r"(not\s+)?(.*)", atom, re.S).groups()
    return ("not " if sign else "") + re.sub(r"\s+", "", rest)


def parse_rule(line: str) -> Rule | None:
    """A clause without its comment and full stop; None unless the head is an atom and the body holds atoms, `not` atoms and comparisons."""
    head, arrow, body = re.sub(r"\s*%.*$", "", line).strip().rstrip(".").strip().partition(":-")
    parts = split_body(body)
    if not re.fullmatch(ATOM, head.strip()) or (arrow and not parts) or not all(_ELEMENT.fullmatch(p) for p in parts):
        return None
    return Rule(spelt(head.strip()), tuple(map(spelt, parts)))


def parse_assumption(line: str) -> tuple[str | None, str | None, str]:
    """(assumption, contrary, remainder): the remainder keeps the assumption, as a whole rule may stand on the line."""
    m = _DECLARED.search(line)
    if m:
        return spelt(m[1]), spelt(m[2]), (line[: m.start()] + m[1] + line[m.end() :]).strip()
    m = _PAIR.match(line) if ":-" not in line else None
    return (spelt(m[1]), spelt(m[2]), "") if m else (None, None, line)


@dataclass
class Answer:
    rules: list[Rule] = field(default_factory=list)
    assumptions: dict[str, str] = field(default_factory=dict)
    repairs: list[str] = field(default_factory=list)

    def names_something(self) -> bool:
        """A copied template (`<head> :- <body>.`) names nothing."""
        return any("<" not in r.text() for r in self.rules) or any("<" not in a for a in self.assumptions)


def _content(section: str) -> Iterator[str]:
    for line in map(str.strip, section.split("\n")):
        if line and line.upper() != NOTHING:
            yield _MARKER.sub("", line)


def _sections(block: str) -> tuple[str, str]:
    """Texts under the two headers; a block without a header has no rules."""
    second = ASSUMPTIONS_HEAD.search(block) or re.search(ASSUMPTIONS_HEAD.pattern.removeprefix(r"^[ \t]*"), block, re.I)
    first = RULES_HEAD.search(block)
    rules = block[first.end() :] if first else ""
    stop = ASSUMPTIONS_HEAD.search(rules)
    return rules[: stop.start()] if stop else rules, block[second.end() :] if second else ""


def _read(block: str) -> Answer:
    got, misfiled, prose = Answer(), 0, 0
    rules, assumptions = _sections(block)
    for line in _content(rules):
        rule = parse_rule(line)
        if rule:
            got.rules.append(rule)
        else:
            prose += ":-" in line
    for line in _content(assumptions):
        name, contrary, rest = parse_assumption(line)
        if name:
            got.assumptions[name] = contrary
        if ":-" in rest:
            rule = parse_rule(rest)
            if rule:
                got.rules.append(rule)
            misfiled += rule is not None
            prose += rule is None
    got.rules = list(dict.fromkeys(got.rules))
    if misfiled:
        got.repairs.append(f"{misfiled} rules among the assumptions")
    if prose:
        got.repairs.append(f"{prose} lines with an arrow that are no rules")
    return got


def parse_answer(text: str, known: list[str] = ()) -> Answer | None:
    """The last block that names something, else the last block; None where there is neither a header nor anything to read.

    known: assumptions of the background, whose repetition is noted. NONE under both headers is an answer.
    """
    text = clean(text)
    starts = [m.start() for m in RULES_HEAD.finditer(text)]
    blocks = [text[a:b] for a, b in zip(starts or [0], [*starts[1:], len(text)], strict=True)]
    chosen = None
    for i in reversed(range(len(blocks))):
        echo = ECHO.search(blocks[i])
        got = _read(blocks[i][: echo.start()] if echo else blocks[i])
        if chosen is None or got.names_something():
            notes = [f"{len(blocks)} answer blocks"] * (len(blocks) > 1) + ["echo of the question dropped"] * bool(echo) + [f"block {i + 1} taken"] * (i + 1 < len(blocks))
            got.repairs, chosen = notes + got.repairs, got
        if got.names_something():
            break
    if not chosen.rules and not chosen.assumptions:
        if not (RULES_HEAD.search(text) or ASSUMPTIONS_HEAD.search(text)):
            return None
        chosen.repairs.append("empty answer")
    repeated = [a for a in chosen.assumptions if a in known]
    if repeated:
        chosen.repairs.append(f"known assumptions listed: {', '.join(repeated)}")
    return chosen


def render_answer(rules: list[Rule], assumptions: dict[str, str]) -> str:
    left = "\n".join(r.text() for r in rules) or NOTHING
    right = "\n".join(f"{a} {DEFEATED} {c}" for a, c in assumptions.items()) or NOTHING
    return f"{RULES}\n{left}\n\n{ASSUMPTIONS}\n{right}"


def difference(fw: Framework, background: Framework) -> str:
    """The answer text of a framework: what it adds to the background."""
    rules = [r for r in fw.rules if r not in background.rules]
    return render_answer(rules, {a: fw.contrary(a) for a in fw.assumptions if a not in background.assumptions})


def apply_answer(background: Framework, answer: Answer) -> tuple[Framework, list[str]]:
    """The extended framework and its truly new assumptions; a contrary that is written for a known assumption still counts."""
    new = [a for a in answer.assumptions if a not in background.assumptions]
    return background.extended(answer.rules, new, answer.assumptions), new


MODES = ("direct", "reasoned", "guided", "examples", "target")
_LEAD = {
    "direct": "Give the answer only.",
    "reasoned": "Think it through first, then give the answer.",
    "guided": "Find the fewest facts that make the examples hold, then turn each into a rule without constants: drop it if it is not needed, fold it with background rules, or guard the fold by an assumption whose exceptions are learnt in turn. Then give the answer.",
    "examples": "The worked example shows the form of an answer.",
    "target": "Write the decisions line by line, then the answer.",
}
_WORKED = "Worked example: with bird(a)., bird(b)., penguin(b)., flies(a) and not flies(b), the answer is\n" + render_answer([Rule("flies(X)", ("bird(X)", "usual(X)")), Rule("c_usual(X)", ("penguin(X)",))], {"usual(X)": "c_usual(X)"})


def statement(positive: list[str], negative: list[str], background: Framework, learnable: list[str], domain: list[str] = ()) -> str:
    """The problem as text (our own wording)."""
    facts = "\n".join(r.text() for r in background.rules)
    against = "\n".join(f"{a} {DEFEATED} {background.contrary(a)}" for a in background.assumptions)
    lines = [f"Background rules:\n{facts}", f"Assumptions:\n{against or NOTHING}", f"Must hold together: {', '.join(positive) or 'nothing'}\nMust not hold: {', '.join(negative) or 'nothing'}", f"Predicates that may be defined: {', '.join(learnable)}"]
    if domain:
        lines.append(f"Constants: {', '.join(domain)}")
    return "\n\n".join(lines)


def question(positive: list[str], negative: list[str], background: Framework, learnable: list[str], mode: str = "direct", domain: list[str] = ()) -> str:
    """The prompt of a problem in one of MODES."""
    if mode not in MODES:
        raise ValueError(f"no mode {mode}")
    parts = [statement(positive, negative, background, learnable, domain), _LEAD[mode]]
    if mode == "examples":
        parts.append(_WORKED)
    parts.append(f"Give general rules and assumptions under the headers {RULES} and {ASSUMPTIONS}.")
    return "\n\n".join(parts)


PARSED = "answer_id string, parsed boolean, rules array<string>, assumptions array<string>, repairs array<string>"


def parse_answers(df: DataFrame) -> DataFrame:
    """(answer_id, raw) -> one row for each with what could be read; parsed is false and the arrays null where nothing could."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for i, raw in zip(batch["answer_id"], batch["raw"], strict=True):
                got = parse_answer(raw) if isinstance(raw, str) else None
                out.append((i, got is not None, *(([r.text() for r in got.rules], [f"{a} {DEFEATED} {c}" for a, c in got.assumptions.items()], got.repairs) if got else (None, None, None))))
            yield pd.DataFrame(out, columns=["answer_id", "parsed", "rules", "assumptions", "repairs"])

    return df.select("answer_id", "raw").mapInPandas(work, PARSED)
