"""Template residue, filler, error pages and script notices in place of content.

A multi-pattern automaton holds words and short phrases of such messages in many languages, another one the marks
that open template fields. Cells are read paragraph by paragraph; what follows looks only at paragraphs the
automata met. A paragraph is a message if it says that something failed (or what scripts need) and words of
messages cover most of its letters, so prose that merely mentions one is not. A field counts if what stands
between its marks is what fields hold. A document is left out if such paragraphs are much of it.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillweave.llm import residue_lexicon as lexicon

PLACEHOLDER, FILLER, ERROR_PAGE, SCRIPT_NOTICE = "placeholder", "filler", "error_page", "script_notice"

#: Share of a paragraph's letters that words of messages, or of fill-in text, must cover; that of an instruction.
COVERAGE, FILLER_COVERAGE, INSTRUCTION_COVERAGE = 0.7, 0.7, 0.3
#: Letters up to which a word counts neither for nor against.
SHORT = 3
#: Share of a document's characters from which its residue paragraphs make it one to leave out.
EXCLUDE_SHARE = 0.02
FIELD_LENGTH = 60

SUBJECT, FAILURE, PLAIN, ADVICE, STATE, BROWSER, NOUN, GLUE, PLEA = (1 << k for k in range(9))
_ROLES = {"subject": SUBJECT, "failure": FAILURE, "plain": PLAIN, "advice": ADVICE, "state": STATE, "browser": BROWSER, "glue": GLUE}
_ERROR, _SCRIPT = SUBJECT | FAILURE | PLAIN | ADVICE, SUBJECT | FAILURE | ADVICE | STATE | BROWSER | NOUN
_FILL, _CORE, _LATIN = 1, 2, 4

_PARAGRAPHS = re.compile(r"\n[ \t]*\n")
#: A tag has attributes or nothing behind its name; other words in angle brackets are text.
_TAGS = re.compile(r"<(?:/?[A-Za-z][\w:-]*(?:\s[^<>=]*=[^<>]*)?\s*/?|![^<>]*)>")
_WORDS = re.compile(r"[^\W_]+(?:'[^\W_]+)?")
_REPEATED = re.compile(r"\b([^\W\d_]{2,})(?:\W+\1\b){2,}", re.I)
_MATH_OR_CODE = re.compile(r"\$[^$\n]+\$|`[^`\n]+`")
_TRACE = re.compile(r"Traceback \(most recent call last\)|^\s*File \"|^\w+(?:Error|Exception)\b", re.M)
#: Words that a bare status stands with.
_STATUS_WORDS = ("http", "status", "code", "message", "detail", "reason", "title")
_STATUS = re.compile(r"(?<!\w)[45]\d\d(?!\w)")


def _listed(text: str) -> list[str]:
    return [w.strip() for w in text.split(",") if w.strip()]


def _machine(patterns: dict[str, object]) -> ahocorasick.Automaton:
    out = ahocorasick.Automaton()
    for pattern, value in patterns.items():
        out.add_word(pattern, (len(pattern), value))
    out.make_automaton()
    return out


@lru_cache(maxsize=1)
def message_words() -> ahocorasick.Automaton:
    """Pattern -> (roles, whether it stands for all words with that beginning)."""
    roles: dict[str, list] = {}
    listed = [(w, _ROLES[role]) for language in lexicon.MESSAGES.values() for role, words in language.items() for w in _listed(words)]
    for word, role in [*listed, *((w, NOUN) for w in _listed(lexicon.SCRIPT_NOUNS)), *((w, ADVICE | PLEA) for w in _listed(lexicon.PLEAS))]:
        entry = roles.setdefault(word.rstrip("*"), [0, False])
        entry[0] |= role
        entry[1] |= word.endswith("*")
    return _machine({w: tuple(v) for w, v in roles.items()})


@lru_cache(maxsize=1)
def filler_words() -> ahocorasick.Automaton:
    roles: dict[str, int] = {}
    for words, role in ((lexicon.FILLER, _FILL), (lexicon.FILLER_CORES, _FILL | _CORE), (lexicon.LATIN_SIGNS, _LATIN)):
        for w in _listed(words):
            roles[w] = roles.get(w, 0) | role
    return _machine(roles)


_MESSAGE, _FILLING, _INSTRUCTION = "message", "filler", "instruction"


@lru_cache(maxsize=1)
def triggers() -> ahocorasick.Automaton:
    """What a paragraph in lower case must hold to be looked at, with the check it is for. Every check starts from one."""
    found: dict[str, set] = {}
    for word, (_, (role, _)) in ((w, v) for w, v in message_words().items()):
        if role & (FAILURE | PLAIN | NOUN) or word in _STATUS_WORDS:
            found.setdefault(word, set()).add(_MESSAGE)
    for word, (_, role) in filler_words().items():
        if role & (_CORE | _LATIN):
            found.setdefault(word, set()).add(_FILLING)
    for phrase in _listed(lexicon.INSTRUCTIONS):
        found.setdefault(phrase.split("\u2026")[0].strip(), set()).add(_INSTRUCTION)
    for word in _listed(lexicon.BRACKETED):
        found.setdefault("[" + word, set()).add(_INSTRUCTION)
    for word in _listed(lexicon.BRACKET_ENDS):
        found.setdefault(word + "]", set()).add(_INSTRUCTION)
    return _machine({k: tuple(sorted(v)) for k, v in found.items()})


_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


@lru_cache(maxsize=1)
def field_marks() -> ahocorasick.Automaton:
    """Marks that open a field; those that are common otherwise with the first letter of what they hold."""
    first = {"capitals": _UPPER, "line": _UPPER, "braces": "0123456789_abcdefghijklmnopqrstuvwxyz" + _UPPER}
    marks = {}
    for opener, closer, rule in lexicon.FIELDS:
        for letter in first.get(rule, ("",)):
            marks[opener + letter] = (opener, closer, rule)
    return _machine(marks)


def _wide(c: str) -> bool:
    """Whether c is of a script that is written without blanks between words."""
    return c >= "\u2e80"


def _bounded(text: str, start: int, stop: int, ends: bool = True) -> bool:
    def joined(a: str, b: str) -> bool:
        return a.isalnum() and b.isalnum() and not (_wide(a) or _wide(b))

    return not (start and joined(text[start - 1], text[start])) and not (ends and stop < len(text) and joined(text[stop - 1], text[stop]))


def _tidy(paragraph: str) -> str:
    if "<" in paragraph:
        paragraph = _TAGS.sub(" ", paragraph)
    if "&" in paragraph:
        paragraph = html.unescape(paragraph)
    return " ".join(paragraph.replace("\u2019", "'").lower().split())


def _marked(text: str, machine: ahocorasick.Automaton, roles_of) -> np.ndarray:
    """The roles of each character of text, as bits."""
    marks = np.zeros(len(text), np.uint16)
    for end, (size, value) in machine.iter(text):
        start, stop = end - size + 1, end + 1
        role, beginning = roles_of(value)
        if _bounded(text, start, stop, not beginning):
            while beginning and stop < len(text) and text[stop].isalnum() and not _wide(text[stop]):
                stop += 1
            marks[start:stop] |= role
    return marks


def _spans(text: str, least: int = 1) -> Iterator[tuple[int, int]]:
    """The words of text without digits."""
    for m in _WORDS.finditer(text):
        if m.end() - m.start() >= least and not any(c.isdigit() for c in m[0]):
            yield m.span()


def message_kind(text: str, noscript: bool) -> str | None:
    """Whether a tidy paragraph is an error page or a script notice.

    noscript: whether it has an element for readers without scripts, which says by itself what the text is for.
    """
    marks = _marked(text, message_words(), lambda v: v)
    met = int(np.bitwise_or.reduce(marks)) if len(marks) else 0
    if noscript and met & (NOUN | STATE):
        return SCRIPT_NOTICE
    scripts = bool(met & NOUN and met & STATE)
    status = bool(_STATUS.search(text))
    failed = bool(met & FAILURE) or bool(met & PLAIN and (met & (SUBJECT | PLEA) or status)) or bool(status and ("http" in text or text[0] == "{"))
    if not scripts and not failed:
        return None
    wanted = _SCRIPT if scripts else _ERROR
    covered = total = 0
    for a, b in _spans(text):
        part = marks[a:b]
        own = int(((part & wanted) != 0).sum())
        # Short words and glue are neutral; in scripts without blanks each character counts by itself.
        if own or _wide(text[a]) or b - a > SHORT and not (part & GLUE).any():
            covered += own
            total += b - a
    if total and covered >= COVERAGE * total:
        return SCRIPT_NOTICE if scripts else ERROR_PAGE
    return None


def is_filler(text: str, repeats: bool) -> bool:
    """Whether a tidy paragraph is fill-in text: phrases that mean nothing, Latin filler, or few words again and again."""
    marks = _marked(text, filler_words(), lambda v: (v, False))
    words = [(text[a:b], marks[a:b]) for a, b in _spans(text)]
    total = sum(len(w) for w, _ in words)
    if not total:
        return False
    if any((m & _CORE).any() for _, m in words) and sum(int((m & _FILL != 0).sum()) for _, m in words) >= FILLER_COVERAGE * total:
        return True
    n = len(words)
    signs = sum(bool((m & _LATIN).any()) for _, m in words)
    if n >= 5 and signs and len({w for w, _ in words}) > 3:
        latin = sum(bool((m & _LATIN).any()) or w.endswith(lexicon.LATIN_ENDINGS) for w, m in words)
        if signs >= max(2, n // 6) and latin >= 0.9 * n or latin == n < 12:
            return True
    return repeats and n >= 6 and len({w for w, _ in words}) * 3 <= n and all(w.isalpha() for w, _ in words)


_NAME = re.compile(r"-?\s*[^\W\d][\w.-]*(?:\s*\|\s*\w+)?\s*")
_CAPITALS = re.compile(r"[A-Z][A-Z0-9_]*[A-Z]")
_FEW_WORDS = re.compile(r"[^\W\d][\w.]*(?: [^\W\d][\w.]*){0,3}")
_CAPITAL_LINE = re.compile(r"[\s#]*<[A-Z][A-Z _]{2,}>\s*")
_BRACE = re.compile(r"\{(?:\d|[a-z_]{3,}|\w{3,})\}")
_GREETING = re.compile(r"\W*(?:dear|hello|hi|hola|bonjour|hallo|ciao|ol\u00e1) $", re.I)


def _holds_field(text: str, at: int, opener: str, closer: str, rule: str) -> bool:
    """Whether the field that opener begins at `at` is one: closed on its line, and holding what rule says."""
    start = at + len(opener)
    stop = text.find(closer, start, start + FIELD_LENGTH + len(closer))
    if stop <= start or "\n" in text[at:stop]:
        return False
    content, after = text[start:stop], text[stop + len(closer) : stop + len(closer) + 1]
    before = text[at - 1] if at else ""
    if rule == "name":
        return len(content.strip()) > 2 - (opener != "{{") and bool(_NAME.fullmatch(content))
    if rule == "capitals":
        return len(content) > 2 and bool(_CAPITALS.fullmatch(content)) and not (before.isalnum() or before in ("_", "%")) and not (after.isalnum() or after in ("_", "%"))
    if rule == "words":
        return bool(_FEW_WORDS.fullmatch(content))
    if rule == "line":
        first, last = text.rfind("\n", 0, at) + 1, text.find("\n", stop, stop + FIELD_LENGTH)
        last = last if last >= 0 else len(text)
        return at - first <= FIELD_LENGTH and last - stop <= FIELD_LENGTH and bool(_CAPITAL_LINE.fullmatch(text[first:last]))
    return bool(content.strip())


def has_field(paragraph: str) -> bool:
    """Whether a paragraph holds an unfilled template field; formulas and quoted code are left out."""
    prose = _MATH_OR_CODE.sub(" ", paragraph)
    braces = -1  # the end of the last field in single braces
    for end, (size, (opener, closer, rule)) in field_marks().iter(prose):
        at = end - size + 1
        if rule != "braces":
            if _holds_field(prose, at, opener, closer, rule):
                return True
        elif (m := _BRACE.match(prose, at)) and not (at and (prose[at - 1].isalnum() or prose[at - 1] in "\\_{}$^'\"(")) and prose[m.end() : m.end() + 1] != "}":
            if at <= FIELD_LENGTH and _GREETING.fullmatch(prose[:at]):
                return True
            # Two fields of a sentence, with no other braces between them, aren't a formula or a mapping.
            if braces >= 0 and not set("{}\n") & set(prose[braces:at]):
                return True
            braces = m.end()
    return False


@lru_cache(maxsize=1)
def _instruction_ends() -> dict[str, list[str]]:
    """What may follow the beginnings of instructions."""
    out: dict[str, list[str]] = {}
    for phrase in _listed(lexicon.INSTRUCTIONS):
        head, _, tail = phrase.partition("\u2026")
        out.setdefault(head.strip(), []).append(tail.strip())
    return out


def has_instruction(text: str, met: list[tuple[int, int]]) -> bool:
    """Whether a tidy paragraph instructs its author. met: (start, end) of the beginnings of instructions in it."""
    letters = np.zeros(len(text) + 1, np.int64)
    for a, b in _spans(text):
        letters[a + 1 : b + 1] = 1
    letters = np.cumsum(letters)
    least = INSTRUCTION_COVERAGE * letters[-1]
    begins = next((k for k, c in enumerate(text) if c.isalnum()), len(text))
    for start, end in met:
        head = text[start:end]
        if head.startswith("[") or head.endswith("]"):
            if head.endswith("]"):
                start, stop, end = text.rfind("[", max(0, start - FIELD_LENGTH), start), end - 1, len(text)
                if start < 0:
                    continue
            else:
                stop = text.find("]", end, end + FIELD_LENGTH)
            inside = text[start + 1 : stop].strip() if stop > 0 else ""
            # What follows tells a link from a field; a field is a few words.
            if inside and text[stop + 1 : stop + 2] not in ("(", "[", ":") and len(inside.split()) < 7 and _FEW_WORDS.match(inside) and (end >= len(text) or not text[end].isalpha() or _wide(text[end])):
                return True
            continue
        for tail in _instruction_ends().get(head, ()):
            stop = end
            if tail:
                place = text.find(tail, end, end + FIELD_LENGTH)
                if place < 0 or len(text[end:place].split()) > 4 or _wide(head[-1]) and place - end > 12:
                    continue
                stop = place + len(tail)
            if letters[stop] - letters[start] >= least or head.startswith("todo") and start <= begins:
                return True
    return False


def paragraph_kinds(paragraph: str, repeats: bool) -> set[str]:
    """The kinds of residue that one paragraph is. Each check starts from something an automaton met.

    repeats: whether few words that come again and again are filler.
    """
    kinds = set()
    text = _tidy(paragraph)
    met: set[str] = set()
    heads = []
    for end, (size, checks) in triggers().iter(text):
        if not met.issuperset(checks) or _INSTRUCTION in checks:
            if _bounded(text, end - size + 1, end + 1, False):
                met.update(checks)
                if _INSTRUCTION in checks:
                    heads.append((end - size + 1, end + 1))
    if has_field(paragraph) or heads and has_instruction(text, heads):
        kinds.add(PLACEHOLDER)
    noscript = "<noscript" in paragraph.lower()
    if _MESSAGE in met or noscript:
        kind = message_kind(text, noscript)
        if kind and not _TRACE.search(paragraph):
            kinds.add(kind)
    if (_FILLING in met or repeats) and is_filler(text, repeats) and not _TRACE.search(paragraph):
        kinds.add(FILLER)
    return kinds


def cell_residue(body: str, markdown: bool) -> dict[str, int]:
    """The kinds of residue in a markdown or output cell, with the characters of the paragraphs that are it.

    Few words again and again are filler only where one comes three times running: prose may say one sentence of
    each column. Repetition is no phrase, so words are counted; all else comes from the automata.
    """
    repeats = markdown and bool(_REPEATED.search(body))
    kinds: dict[str, int] = {}
    for paragraph in _PARAGRAPHS.split(body.replace("\r\n", "\n").replace("\r", "\n")):
        if paragraph.strip():
            for kind in paragraph_kinds(paragraph, repeats):
                kinds[kind] = kinds.get(kind, 0) + len(paragraph)
    return kinds


def cell_kinds(body: str, markdown: bool) -> set[str]:
    return set(cell_residue(body, markdown))


_CELL_TAG = re.compile(r"^<cell type=(\w+)[^>\n]*>$(.*?)^</cell>$", re.M | re.S)
_PERCENT = re.compile(r"^(# %%(?: \[(\w+)\])?|# Out:)$", re.M)
_PROMPT = re.compile(r"^(In|Out) ?\[[ \d]*\]:$", re.M)
_FENCE = re.compile(r"^```(\w*)$(.*?)^```$", re.M | re.S)


def cells_of(text: str) -> list[tuple[str, str]]:
    """(kind, body) of the cells of a text whose cells are unknown, by the marks of its layout.

    A body may hold what follows a cell without a mark of its own; code ends at the first blank line where
    the layout has no other end.
    """
    text = text.replace("\r\n", "\n").replace("\r", "\n")
    if _CELL_TAG.search(text):
        return [(m[1], m[2]) for m in _CELL_TAG.finditer(text)]
    if marks := list(_PERCENT.finditer(text)):
        out = [("markdown", text[: marks[0].start()])]
        for m, stop in zip(marks, [*(x.start() for x in marks[1:]), len(text)]):
            out.append(("output" if m[1] == "# Out:" else m[2] or "code", text[m.end() : stop]))
        return out
    if marks := list(_PROMPT.finditer(text)):
        out = [("markdown", text[: marks[0].start()])]
        for m, stop in zip(marks, [*(x.start() for x in marks[1:]), len(text)]):
            body = text[m.end() : stop]
            if m[1] == "In":
                code, _, rest = body.partition("\n\n")
                out += [("code", code), ("markdown", rest)]
            else:
                out.append(("output", body))
        return out
    out, at = [], 0
    for m in _FENCE.finditer(text):
        out += [("markdown", text[at : m.start()]), ("output" if m[1] == "output" else "code", m[2])]
        at = m.end()
    return [*out, ("markdown", text[at:])]


def find_residue(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", cells_col: str = "cells") -> DataFrame:
    """(id, kind, share): one row for each kind of residue in a markdown or output cell of a document.

    share is what the paragraphs of that kind are of the document's characters. Null and empty texts have none.
    Where cells are null they are found by the layout of the text. Offsets outside the text are cut to it.
    Repeated documents give repeated rows, extra columns are ignored, an empty table gives no rows, cells are
    read whole. Map-only.
    """
    schema = T.StructType([docs.schema[id_col], T.StructField("kind", T.StringType()), T.StructField("share", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, kinds, shares = [], [], []
            cells = batch.column(2)
            known = cells.is_valid().to_pylist()
            flat = cells.flatten()
            types, starts, ends = (flat.field(i).to_pylist() for i in range(3))
            edges = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(cells), 0).to_numpy(zero_copy_only=False))]).tolist()
            for i, text in enumerate(batch.column(1).to_pylist()):
                if not text:
                    continue
                found: dict[str, int] = {}
                if known[i]:
                    bodies = ((types[k], text[max(0, starts[k]) : max(0, ends[k])]) for k in range(edges[i], edges[i + 1]) if starts[k] is not None and ends[k] is not None)
                else:
                    bodies = iter(cells_of(text))
                for kind, body in bodies:
                    if kind in ("markdown", "output") and body:
                        for k, size in cell_residue(body, kind == "markdown").items():
                            found[k] = found.get(k, 0) + size
                for kind in sorted(found):
                    rows.append(i)
                    kinds.append(kind)
                    shares.append(min(1.0, found[kind] / len(text)))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(kinds, pa.string()), pa.array(shares, pa.float64())], names=schema.names)

    slim = docs.selectExpr(f"`{id_col}`", f"`{text_col}`", f"transform(`{cells_col}`, c -> named_struct('t', c.cell_type, 'a', c.char_start, 'b', c.char_end)) as _cells")
    return slim.mapInArrow(run, schema)


def without_residue(docs: DataFrame, residue: DataFrame, id_col: str = "doc_id", exclude_share: float = EXCLUDE_SHARE) -> DataFrame:
    """The documents of which residue is less than exclude_share; residue: what find_residue() gave for docs.

    A notebook with one forgotten field in a long text stays; one that is largely an error page goes.
    """
    much = residue.groupBy(residue[id_col].alias("_gone")).agg(F.sum("share").alias("_share")).filter(F.col("_share") >= exclude_share)
    return docs.join(much.select("_gone"), docs[id_col] == much["_gone"], "left_anti")
